"""Streams by keyed state: the listing history, and months of filings with those that come late."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

from terrafolio.operators.history import STATE

#: The store that keyed state and timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
LISTING = "preco_inicial double, preco_atual double, mudancas int, visto_primeira long, visto_ultima long, saida long, voltas int"
CHANGE = f"codigo long, {LISTING}"
MONTH = "mes long, n long, total double, atrasada boolean"


def _row(schema: str, *values) -> Row:
    return Row(**dict(zip((f.split(" ")[0] for f in schema.split(", ")), values, strict=True)))


def _keyed_store(spark: SparkSession) -> None:
    if spark.conf.get(STORE[0]) != STORE[1]:
        spark.conf.set(*STORE)


class _Listings(StatefulProcessor):
    """One listing: what ``fold`` keeps of it, with a timer for the first run after the one that it was last seen in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.listing = handle.getValueState("listing", LISTING)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen: dict[int, float] = {}
        for r in rows:
            seen[r["visto"]] = min(r["preco"], seen.get(r["visto"], r["preco"]))
        old = self.listing.get()
        passed = timerValues.getCurrentWatermarkInMs()
        for at, price in sorted(seen.items()):
            if old is None:
                new = (price, price, 0, at, at, None, 0)
            else:
                first, before, changes, since, last, left, returns = old
                # it has left if its timer has told, or would have: another run has been in between
                away = left is not None or last < passed < at
                new = (first, price, changes + (price != before), since, at, None, returns + away)
                self.handle.deleteTimer(last + 1)
            old = new
        self.listing.update(old)
        self.handle.registerTimer(old[4] + 1)
        yield _row(CHANGE, key[0], *old)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        old = self.listing.get()
        if old is None or old[5] is not None or expiredTimerInfo.getExpiryTimeInMs() != old[4] + 1:
            return
        gone = (*old[:5], timerValues.getCurrentWatermarkInMs(), old[6])
        self.listing.update(gone)
        yield _row(CHANGE, key[0], *gone)


def listing_changes(stream: DataFrame) -> DataFrame:
    """The changes of listings' states, as a stream: a row for each listing that a run shows, and for each that a run lacks for the first time.

    ``stream`` has codigo, preco, visto (when its run was, the same for all its rows) and nothing of it may be split: one run is one micro-batch,
    as with one file a run and ``maxFilesPerTrigger`` 1. Rows without a code, price or time are ignored, and of rows that repeat a code in a
    run the smallest price counts. What ``fold`` finds by joining a run with the whole state, timers tell here: a listing's timer
    fires once a later run has moved the watermark, so that a run touches the listings that it has and those that have just left. It
    does so with the next batch, be it one without data.
    """
    _keyed_store(stream.sparkSession)
    known = stream.where("codigo is not null and preco is not null and visto is not null").withWatermark("visto", "0 seconds")
    runs = known.select(F.col("codigo").cast("long"), F.col("preco").cast("double"), F.unix_millis("visto").alias("visto"))
    made = runs.groupBy("codigo").transformWithState(_Listings(), T._parse_datatype_string(CHANGE), "Append", "EventTime")
    time: dict[str, Column] = {c: F.timestamp_millis(c) for c in ("visto_primeira", "visto_ultima", "saida")}
    return made.withColumns(time)


def track(stream: DataFrame, folder: str, checkpoint: str):
    """Starts writing ``listing_changes`` to Parquet below ``folder``; returns the query. After a restart it goes on where it ended."""
    return listing_changes(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).start(folder)


def tracked(spark: SparkSession, folder: str) -> DataFrame:
    """The state of every listing by the last of its changes below ``folder``, in the columns of ``fold``."""
    names = [f.split(" ")[0] for f in STATE.split(", ")]
    last = F.max_by(F.struct(*names), F.greatest("visto_ultima", F.coalesce("saida", "visto_ultima"))).alias("s")
    return spark.read.parquet(folder).groupBy("codigo").agg(last).select("s.*")


class _Months(StatefulProcessor):
    """One month: filings are added up until the watermark closes it; later ones are told apart."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n long, total double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, total = 0, 0.0
        for r in rows:
            n, total = n + 1, total + (r["valor"] or 0.0)
        if key[0] <= timerValues.getCurrentWatermarkInMs():
            yield _row(MONTH, key[0], n, total, True)
            return
        old = self.sums.get()
        self.sums.update((n + old[0], total + old[1]) if old else (n, total))
        if not old:
            self.handle.registerTimer(key[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, total = self.sums.get()
        self.sums.clear()
        yield _row(MONTH, key[0], n, total, False)


def open_days(months: int) -> str:
    """A delay from the first day of a month that always ends in the month before the ``months`` last ones, whatever their lengths."""
    return f"{31 * (months - 1) + 1} days"


def monthly_filings(stream: DataFrame, incomplete: int = 2) -> DataFrame:
    """mes, n, total, atrasada of filings (dia, valor), as a stream in append mode.

    A month is given once, when filings of the ``incomplete``-th month after it have come: the last months are still being filed
    and aren't given. Filings of months that are closed by then come in rows of their own, ``atrasada``, a row for each month and
    batch, so that nothing is lost and a reader may add them or leave them apart. Rows without a day are ignored; a null value counts 0.
    """
    _keyed_store(stream.sparkSession)
    month = F.date_trunc("month", F.col("dia").cast("timestamp"))
    marked = stream.where("dia is not null").select(month.alias("mes"), F.col("valor").cast("double")).withWatermark("mes", open_days(incomplete))
    # the key is a number, not the watermarked column, whose late rows Spark would drop
    keyed = marked.select(F.unix_millis("mes").alias("mes"), "valor")
    made = keyed.groupBy("mes").transformWithState(_Months(), T._parse_datatype_string(MONTH), "Append", "EventTime")
    return made.select(F.timestamp_millis("mes").cast("date").alias("mes"), "n", "total", "atrasada")
