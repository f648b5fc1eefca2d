"""The newest sound snapshot, and the first sound source."""

import pytest

from terrafolio.sources import snapshots


def rows(spark, n, start=0):
    return spark.range(start, start + n).selectExpr("id", "concat('n', id) AS nome").coalesce(1)


def test_a_corrupt_newest_file_falls_back_to_the_one_before(spark, tmp_path):
    root = f"file://{tmp_path}/snap"
    with pytest.raises(LookupError):
        snapshots.newest_sound(spark, root)
    for k in range(1, 5):
        assert snapshots.write_snapshot(rows(spark, 10 * k), root, f"2024-01-0{k}") == 10 * k
    day, found = snapshots.newest_sound(spark, root)
    assert (day, found.count()) == ("2024-01-04", 40)
    file = next((tmp_path / "snap/run_date=2024-01-04").glob("part-*.parquet"))
    file.write_bytes(file.read_bytes()[:100])  # cut off
    for crc in (tmp_path / "snap/run_date=2024-01-04").glob(".*.crc"):
        crc.unlink()
    assert snapshots.newest_sound(spark, root)[0] == "2024-01-03"
    rows(spark, 7).write.mode("overwrite").parquet(f"{root}/run_date=2024-01-03")  # not what its manifest says
    assert snapshots.newest_sound(spark, root)[0] == "2024-01-02"
    rows(spark, 99).write.parquet(f"{root}/run_date=2024-01-09")  # never finished: no manifest
    (tmp_path / "snap/manifests/2024-01-08.json").write_text("{")
    assert snapshots.newest_sound(spark, root)[0] == "2024-01-02"
    assert snapshots.newest_sound(spark, root, until="2024-01-01")[1].count() == 10
    with pytest.raises(LookupError):
        snapshots.newest_sound(spark, root, least=1000)


def test_the_first_source_that_can_be_read_wins(spark, tmp_path):
    (tmp_path / "bad.parquet").write_text("no parquet")
    sources = [("gone", lambda: spark.read.parquet(f"{tmp_path}/gone")), ("bad", lambda: spark.read.schema("id long").parquet(f"{tmp_path}/bad.parquet")), ("empty", lambda: rows(spark, 0)), ("good", lambda: rows(spark, 3)), ("later", lambda: rows(spark, 5))]
    name, found = snapshots.first_sound(sources)
    assert (name, found.count()) == ("good", 3)
    with pytest.raises(LookupError, match="gone"):
        snapshots.first_sound(sources[:2])
