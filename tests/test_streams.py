"""Keyed streams against folds of the same batches, with restarts in between."""

import datetime
import random
from collections import defaultdict

from terrafolio.operators import history
from terrafolio.streaming import keyed

RUN = "codigo long, preco double, visto timestamp"


def runs(n=7):
    rng = random.Random(2)
    out = []
    for k in range(n):
        at = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k, hours=k % 3)
        rows = [(c, rng.choice([10.0, 11.0, 12.0]), at) for c in range(20) if rng.random() < 0.6]
        out.append((at, rows + rows[:3] + [(None, 1.0, at), (99, None, at)]))
    return out


def test_tracked_history_equals_the_fold(spark, tmp_path):
    state = spark.createDataFrame([], history.STATE)
    for k, (at, rows) in enumerate(runs()):
        spark.createDataFrame(rows, RUN).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        state = spark.createDataFrame(history.fold(state, spark.createDataFrame(rows, RUN), at).collect(), history.STATE)
        if k in (1, 2, 6):  # several runs wait; the stream is stopped in between
            stream = spark.readStream.schema(RUN).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            query = keyed.track(stream, f"{tmp_path}/out", f"{tmp_path}/check")
            query.processAllAvailable()
            query.stop()
            found = keyed.tracked(spark, f"{tmp_path}/out")
            assert found.columns == state.columns
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, state.collect())), k
    assert {r["voltas"] for r in state.collect()} > {0} and any(r["saida"] for r in state.collect())


def test_months_close_once_and_late_filings_are_told_apart(spark, tmp_path):
    day = datetime.date
    batches = [
        [(day(2024, 1, 31), 1.0), (day(2024, 1, 1), 2.0), (day(2024, 2, 29), 4.0), (None, 9.0)],
        [(day(2024, 3, 1), 8.0), (day(2024, 1, 15), 16.0), (day(2024, 2, 2), None)],  # January is closed by March only after this batch
        [(day(2024, 1, 20), 32.0), (day(2024, 2, 3), 64.0), (day(2024, 4, 30), 128.0)],  # January is late now, February still open
        [(day(2024, 2, 4), 256.0), (day(2024, 4, 1), 512.0)],
        [(day(2024, 6, 1), 1024.0)],
    ]
    query = None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "dia date, valor double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("dia date, valor double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = keyed.monthly_filings(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").start(f"{tmp_path}/out")
        query.processAllAvailable()
        query.stop()
    found = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert found == [(day(2024, 1, 1), 1, 32.0, True), (day(2024, 1, 1), 3, 19.0, False), (day(2024, 2, 1), 1, 256.0, True), (day(2024, 2, 1), 3, 68.0, False), (day(2024, 3, 1), 1, 8.0, False), (day(2024, 4, 1), 2, 640.0, False)]
    sums = defaultdict(float)
    for mes, _, total, _ in found:
        sums[mes] += total
    for rows in batches:
        for dia, valor in rows:
            if dia and dia.month < 6:
                sums[dia.replace(day=1)] -= valor or 0
    assert set(sums.values()) == {0.0}


def test_the_delay_ends_in_the_month_before_the_open_ones():
    for incomplete in (1, 2, 3, 12):
        days = int(keyed.open_days(incomplete).split(" ")[0])
        for k in range(60):
            first = datetime.date(2020 + k // 12, k % 12 + 1, 1)
            m = first.year * 12 + first.month - 1 - incomplete
            closes = first - datetime.timedelta(days=days)
            assert closes.year * 12 + closes.month - 1 == m, (incomplete, first)
