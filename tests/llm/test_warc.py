"""WARC data source: round trips, foreign archives, predicates that reach the reader, skipped payloads, failed writes."""

import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from terrafolio.llm import warc
from terrafolio.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/archives"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "own", "own") for r in rows], "page_id long, url string, html string, digest string, keeper string").repartition(3)


def brute(rows, least=0):
    out = []
    for p, _, html in rows:
        x = (html or "").encode()
        ids = [q for q, _, y in rows if (y or "").encode() == x and q is not None]
        again = bool(ids) and len(x) >= least and (p is None or p < max(ids))
        out.append((p, len(x), warc.sha1_base32(x), "revisit" if again else "response", max(ids) if again else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a", "x"), (2, "http://b\r\nWARC-Type: fake", "x"), (2, "http://b", "x"), (3, None, None), (4, "http://d", ""), (5, "http://é", "é" * 200_000), (6, "http://f", "WARC/1.1\r\n\r\n\r\n"), (None, "http://g", "x"), (None, "http://h", "alone"), (None, None, "alone"), (9, "http://i", "\x1f\u008b\u0008")]
ROWS += [(100 + i, "http://copies", "many copies") for i in range(50)]


def test_round_trip_equals_brute_force(spark, folder):
    warc.archive(pages(spark, ROWS), folder)
    found = sorted((tuple(r) for r in warc.archived_pages(spark, folder).collect()), key=str)
    assert found == brute(ROWS)
    back = {r["record_id"]: r for r in warc.load(spark, folder).where("record_type = 'response'").collect()}
    assert bytes(back["urn:page:5"]["payload"]).decode() == "é" * 200_000 and back["urn:page:6"]["target_uri"] == "http://f"
    assert back["urn:page:3"]["target_uri"] is None if "urn:page:3" in back else True
    assert {r["target_uri"] for r in warc.load(spark, folder, payload=False).where("record_id = 'urn:page:2'").collect()} == {"http://b", "http://b%0D%0AWARC-Type: fake"}


def test_smaller_payloads_are_stored_each_time(spark, folder):
    warc.archive(pages(spark, ROWS), folder, warc.WarcParams(least_bytes=5))
    assert sorted((tuple(r) for r in warc.archived_pages(spark, folder).collect()), key=str) == brute(ROWS, 5)


def test_no_pages(spark, folder):
    warc.archive(pages(spark, ROWS).where("false"), folder)
    assert warc.archived_pages(spark, folder).collect() == []


def write_some(spark, folder, **options):
    warc.register(spark)
    writer = warc.records(table(spark, SF, "pages")).write.format("warc").mode("append")
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.save(folder)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_predicates_on_headers_reach_the_reader(spark, folder, compression):
    write_some(spark, folder, compression=compression, fileBytes="50000")
    all_rows = warc.load(spark, folder)
    n = all_rows.count()
    assert n == table(spark, SF, "pages").count()
    some = [r["record_id"] for r in all_rows.limit(2).collect()]
    held = all_rows.withColumn("held", F.lit(True)).cache()
    held.count()
    for wanted in ("record_type = 'response'", f"record_id in ('{some[0]}', '{some[1]}')", "target_uri like 'http://%'", "target_uri like '%ref=x'", "target_uri like '%example%'", "refers_to is null", "refers_to is not null", "not record_type = 'response'", "record_id <=> 'urn:page:3'", "record_type is null", f"record_id not in ('{some[0]}', 'x')"):
        df = warc.load(spark, folder).where(wanted)
        plan = df._jdf.queryExecution().executedPlan().toString()
        if "not" not in wanted or "null" in wanted:
            assert ") Filter " not in plan, (wanted, plan)
        assert sorted(r["record_id"] for r in df.collect()) == sorted(r["record_id"] for r in held.where(wanted).collect()), wanted
    held.unpersist()
    both = warc.load(spark, folder).where("record_type = 'response' and payload_length > 100")
    assert both.count() == all_rows.where("payload_length > 100").where("record_type = 'response'").count()


class Counted(warc.Bytes):
    """Says how many bytes were asked for."""

    asked = 0

    def read(self, at, n):
        got = super().read(at, n)
        Counted.asked += len(got)
        return got


@pytest.mark.parametrize("plain", [True, False])
def test_unwanted_payloads_are_not_read(tmp_path, plain):
    import pyarrow.fs

    payload = bytes(zlib.crc32(bytes([i % 251, i // 251 % 251])) % 256 for i in range(300_000))
    path = str(tmp_path / "a.warc")
    with open(path, "wb") as f:
        for i in range(5):
            record = warc.record_bytes({"record_type": "response", "record_id": f"r{i}"}, payload)
            f.write(record if plain else warc.member(record))
    with pyarrow.fs.LocalFileSystem().open_input_file(path) as file:
        Counted.asked = 0
        assert [b for _, b in warc.read_records(Counted(file), lambda h: warc.HEAD)] == [None] * 5
        assert Counted.asked < 50_000
        kept = [(h["warc-record-id"], warc.payload_of(h, b)) for h, b in warc.read_records(Counted(file), lambda h: warc.ALL if h["warc-record-id"] == "<r3>" else warc.SKIP)]
    assert kept == [("<r3>", payload)]
    if not plain:
        assert gzip.open(path).read().count(b"WARC/1.1\r\n") == 5


FOREIGN = (
    b"WARC/1.0\r\nwarc-type: warcinfo\r\nWARC-Record-ID: <urn:x:1>\r\nX-Long: a\r\n b\r\nContent-Length: 4\r\n\r\ninfo\r\n\r\n",
    b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:2>\r\nContent-Type: application/http\r\nContent-Length: 84\r\n\r\nHTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4;x=y\r\nWARC\r\n7\r\n/1.0\r\n\n\r\n0\r\n\r\n\r\n\r\n",
    b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:3>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n%b\r\n\r\n" % (len(gzip.compress(b"zipped")) + 43, gzip.compress(b"zipped")),
)


def test_foreign_archives(spark, tmp_path):
    records = [r.replace(b"Content-Length: 84", b"Content-Length: %d" % len(r.split(b"\r\n\r\n", 1)[1][:-4])) for r in FOREIGN]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "_c.warc").write_bytes(b"not seen")
    (tmp_path / "empty.warc").write_bytes(b"")
    for payload in (True, False):
        rows = warc.load(spark, str(tmp_path), payload).collect()
        assert sorted((r["record_id"], r["record_type"]) for r in rows) == sorted(2 * [("urn:x:1", "warcinfo"), ("urn:x:2", "response"), ("urn:x:3", "response")])
        by = {r["record_id"]: r for r in rows}
        assert by["urn:x:1"]["headers"]["x-long"] == "a b"
        want = [b"info", b"WARC/1.0\r\n\n", b"zipped"] if payload else [None] * 3
        assert [by[f"urn:x:{i}"]["payload"] for i in (1, 2, 3)] == want


@pytest.mark.parametrize("broken", [b"junk", FOREIGN[0][:60], FOREIGN[0][:-6], gzip.compress(FOREIGN[0])[:40]])
def test_broken_archives_raise_and_name_the_file(spark, tmp_path, broken):
    (tmp_path / "a.warc").write_bytes(broken)
    with pytest.raises(Exception, match="a.warc"):
        warc.load(spark, str(tmp_path)).collect()


def test_failed_writes_leave_nothing_and_overwrite_replaces(spark, folder, tmp_path):
    write_some(spark, folder)
    before = warc.load(spark, folder, payload=False).count()
    bad = spark.createDataFrame([("r1", "response", None, bytearray(b"x")), (None, "response", None, bytearray(b"y"))], "record_id string, record_type string, refers_to string, payload binary")
    with pytest.raises(Exception):
        bad.write.format("warc").mode("append").save(folder)
    assert warc.load(spark, folder, payload=False).count() == before
    assert [x.name for x in (tmp_path / "archives").iterdir() if x.name.startswith("_")] == []
    bad.where("record_id is not null").write.format("warc").mode("overwrite").save(folder)
    assert [r["record_id"] for r in warc.load(spark, folder).collect()] == ["r1"]
