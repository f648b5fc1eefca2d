"""Islands of prices change no result and separate tasks."""

import datetime
import random

from terrafolio.operators import checks, history


def loop(rows, share=0.03):
    units = [(c, v, d, d) for _, c, v, d in sorted(rows)]
    while True:
        left, kept = units, []
        while left:
            o = left[0][1]
            near = [u for u in left if abs(u[1] - o) <= share * o]
            left = [u for u in left if abs(u[1] - o) > share * o]
            kept.append((*max(near, key=lambda u: u[2])[:3], min(u[3] for u in near)))
        if len(kept) == len(units):
            return {(u[0], u[3]) for u in units}
        units = kept


def test_islands_equal_one_loop(spark, monkeypatch):
    rng = random.Random(4)
    # a chain of 40 prices that merges over many rounds, and prices with gaps
    prices = [100 * 1.025**k for k in range(40)] + [rng.uniform(1e3, 1e6) for _ in range(200)] + [97.0, 100.0, 103.0]
    rng.shuffle(prices)
    rows = [(k, k, v, datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(300))) for k, v in enumerate(prices)]
    frame = spark.createDataFrame([("a", 80.0, *r) for r in rows], "endereco string, area double, ordem long, codigo long, preco double, criado date")
    found = history.merge_readvertised(frame)
    assert {tuple(r) for r in found.collect()} == loop(rows)
    assert "_island" in found._jdf.queryExecution().toString()


def plain_loop(rows, share=0.03):
    """The rule read plainly: one pass after the other over each building and area, nulls and zeros included."""
    groups, out = {}, []
    for place, area, order, code, price, made in sorted(rows, key=lambda r: r[2]):
        if place is None:
            out.append((code, made))
        else:
            groups.setdefault((place, area), []).append((code, price, made, made))
    for units in groups.values():
        while True:
            used, kept = set(), []
            for i, (_, price, _, _) in enumerate(units):
                if i in used:
                    continue
                cluster = [i] + [j for j in range(i + 1, len(units)) if j not in used and price and units[j][1] and abs(units[j][1] - price) <= share * price]
                used |= set(cluster)
                newest = max((units[j] for j in cluster), key=lambda u: u[2].isoformat() if u[2] else "")
                kept.append((*newest[:3], min((units[j][3] for j in cluster if units[j][3]), default=None)))
            if len(kept) == len(units):
                break
            units = kept
        out += [(u[0], u[3]) for u in units]
    return sorted(out, key=str)


SCHEMA = "endereco string, area double, ordem long, codigo long, preco double, criado date, _gap string, _island string"


def odd_rows(seed, n):
    rng = random.Random(seed)
    day = lambda: rng.choice([None, datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(5))])
    price = lambda: rng.choice([None, 0.0, 100.0, 103.0, 97.0, 106.0, round(rng.uniform(80, 140), 1)])
    return [(rng.choice([None, "a", "a", "b"]), rng.choice([None, 80.0, 80.0]), k, k, price(), day()) for k in range(n)]


def test_nulls_zeros_and_ties_equal_the_plain_loop_and_a_second_run_removes_nothing(spark):
    for seed in (1, 2):
        rows = odd_rows(seed, 250)
        frame = spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA)
        found = sorted(map(tuple, history.merge_readvertised(frame).collect()), key=str)
        assert found == plain_loop(rows)
        kept = frame.join(history.merge_readvertised(frame), "codigo")
        assert history.merge_readvertised(kept).count() == kept.count()
        assert checks.not_settled(kept).count() == 0 and checks.not_settled(frame).count() == len(rows) - len(found)


def test_close_prices_take_no_quadratic_time():
    units = [(k, 100.0 + k * 1e-5, None, None) for k in range(60_000)]
    assert len(history._one_pass(units, 0.03)) == 1
    spread = [(k, 100.0 * 1.04**(k % 300) + k * 1e-9, None, None) for k in range(60_000)]
    assert len(history._one_pass(spread, 0.03)) == 300


def test_many_small_groups_need_no_call_each_and_go_on_over_batches(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, *"abcdefgh"]), rng.choice([None, 60.0, 80.0]), k, k, rng.choice([None, 100.0, 103.0, round(rng.uniform(50, 500), 1)]), rng.choice([None, datetime.date(2024, 1, 1 + k % 9)])) for k in range(600)]
    frame = spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = history.merge_readvertised(frame)
        assert sorted(map(tuple, found.collect()), key=str) == plain_loop(rows)
        assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
