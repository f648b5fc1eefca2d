"""Order statistics over ranges and numbering over partitions, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafolio.operators import order

SHARES = (0.0, 0.25, 0.5, 0.75, 1.0)


def brute(values, asks):
    out = {}
    for ask, key, a, tol, grp, own, _ in asks:
        ys = [y for i, k, g, x, y in values if k == key and abs(x - a) / a <= tol and i != own and (grp is None or g != grp)]
        out[ask] = (len(ys), list(np.quantile(ys, SHARES)) if ys else None)
    return out


def found(spark, values, asks, parts=5):
    v = spark.createDataFrame(values, "id long, key string, grp long, x double, y double").repartition(parts)
    q = order.settled(order.counts(v, spark.createDataFrame(asks, "ask long, key string, a double, tol double, grp long, own long, own_x double")))
    got = {r["ask"]: r["q"] for r in order.quantiles(v, q, SHARES).collect()}
    return {r["ask"]: (r["n"], got.get(r["ask"])) for r in q.collect()}


@pytest.mark.parametrize("fan, chunk", [(128, 50_000), (3, 7)])
def test_equals_brute_force(spark, monkeypatch, fan, chunk):
    monkeypatch.setattr(order, "FAN", fan)
    monkeypatch.setattr(order, "CHUNK", chunk)
    rng = random.Random(fan)
    # a key and a group with a third of all rows, ties in both numbers, areas at the very edge of a range
    values = [(i, rng.choice(["hot", "hot", "b", "c"]), rng.choice([1, 1, 2, 3, None]), rng.choice([80.0, 88.0, 72.0, 100.0, 110.0, 90.0, rng.uniform(50, 120)]), float(rng.choice([1, 2, rng.uniform(0, 9)]))) for i in range(400)]
    asks = [(k, rng.choice(["hot", "b", "c", "none"]), rng.choice([80.0, 100.0, 88.0]), rng.choice([0.1, 0.25]), rng.choice([None, 1, 2, 9]), None, None) for k in range(150)]
    asks += [(1000 + i, key, x * rng.choice([1, 0.7]), 0.1, None, i, x) for i, key, _, x, _ in values[::5]]
    for ask, (n, q) in found(spark, values, asks).items():
        want_n, want = brute(values, [a for a in asks if a[0] == ask])[ask]
        assert n == want_n and (q is None) == (want is None), ask
        assert q is None or q == pytest.approx(want), ask


def test_no_values_and_no_asks(spark):
    assert found(spark, [], [(1, "a", 5.0, 0.1, None, None, None)]) == {1: (0, None)}
    assert found(spark, [(1, "a", None, 5.0, 1.0)], []) == {}


def test_numbering_over_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", None, "b"]), rng.randrange(40), i, "own") for i in range(500)]
    df = spark.createDataFrame(rows, "key string, x long, i long, _row string").repartition(7)
    for keys in (["key"], []):
        got = order.numbered(df, keys, [F.col("x"), F.col("i")], "at").collect()
        assert sorted((r["key"] or "", r["x"], r["i"], r["_row"]) for r in got) == sorted((k or "", *rest) for k, *rest in rows)
        for key in {k for k, *_ in rows} if keys else {"all"}:
            own = sorted((x, i) for k, x, i, _ in rows if not keys or k == key)
            assert [own.index((r["x"], r["i"])) for r in got if not keys or r["key"] == key] == [r["at"] for r in got if not keys or r["key"] == key]
    assert order.numbered(df.where("false"), [], [F.col("x")], "at").count() == 0
