"""Groups without a window of their own get the index of all rows."""

from dataclasses import replace

from terrafolio.operators import period
from terrafolio.params import DEFAULT


def test_sparse_groups_get_the_wide_index(spark):
    rows = [("many", m, 100.0 + m) for m in range(12) for _ in range(3)] + [("few", 3, 50.0), (None, 4, 60.0)]
    frame = spark.createDataFrame(rows, "tipo string, mes int, m2 double")
    p = replace(DEFAULT, index_least_rows=9)
    found = {}
    for r in period.price_index(frame, ["tipo"], "m2", p=p).collect():
        found.setdefault(r["tipo"], {})[r["i"]] = (r["w"], r["fator"])
    wide = {r["i"]: r["median"] for r in period.rolling_medians(frame, [], "m2").where("w = 6").collect()}
    expected = {i: (6, wide[11] / m) for i, m in wide.items()}
    assert found.keys() == {"many", "few", None} and len(wide) == 12
    assert found["few"] == found[None] == expected
    assert {w for w, _ in found["many"].values()} == {3} and len(found["many"]) == 12
