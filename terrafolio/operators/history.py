"""The listing history: a fold of batches into one state row a listing, and the removal of re-advertised units."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafolio.operators.order import free
from terrafolio.params import DEFAULT, Params

STATE = "codigo long, preco_inicial double, preco_atual double, mudancas int, visto_primeira timestamp, visto_ultima timestamp, saida timestamp, voltas int"


def fold(state: DataFrame, batch: DataFrame, now) -> DataFrame:
    """The state after a complete batch seen at ``now``.

    New listings enter; those seen again are refreshed, count a return if they had left, and a change if the price differs;
    active ones that the batch lacks leave at ``now``. Rows of the batch without a code or price are ignored; of rows that
    repeat a code the smallest price counts.
    """
    seen = batch.where("codigo is not null and preco is not null").groupBy("codigo").agg(F.min("preco").alias("preco"))
    s, at = state.select(*(F.col(c) for c in state.columns)), F.lit(now).cast("timestamp")
    both = s.join(seen, "codigo", "full_outer")
    here, known = F.col("preco").isNotNull(), F.col("visto_primeira").isNotNull()
    pick = lambda old, new: F.when(here, new).otherwise(old)
    return both.select(
        "codigo",
        F.coalesce("preco_inicial", "preco").alias("preco_inicial"),
        pick(F.col("preco_atual"), F.col("preco")).alias("preco_atual"),
        (F.coalesce("mudancas", F.lit(0)) + F.when(here & known & (F.col("preco") != F.col("preco_atual")), 1).otherwise(0)).alias("mudancas"),
        F.coalesce("visto_primeira", at).alias("visto_primeira"),
        pick(F.col("visto_ultima"), at).alias("visto_ultima"),
        F.when(here, F.lit(None)).otherwise(F.coalesce("saida", at)).cast("timestamp").alias("saida"),
        (F.coalesce("voltas", F.lit(0)) + F.when(here & F.col("saida").isNotNull(), 1).otherwise(0)).alias("voltas"),
    )


def history_at_once(events: DataFrame) -> DataFrame:
    """What folding daily batches gives, from all rows (codigo, dia, preco) at once with windows instead of a loop.

    Each day with rows is a complete batch.
    """
    day = events.where("codigo is not null and preco is not null").groupBy("codigo", "dia").agg(F.min("preco").alias("preco"))
    days = day.select("dia").distinct().withColumn("k", F.row_number().over(Window.orderBy("dia")))  # one row a day
    w = Window.partitionBy("codigo").orderBy("k")
    rows = day.join(F.broadcast(days), "dia").withColumn("before", F.lag("k").over(w)).withColumn("old", F.lag("preco").over(w))
    out = rows.groupBy("codigo").agg(
        F.min_by("preco", "k").alias("preco_inicial"),
        F.max_by("preco", "k").alias("preco_atual"),
        F.sum(F.when(F.col("old") != F.col("preco"), 1).otherwise(0)).alias("mudancas"),
        F.min("dia").alias("visto_primeira"),
        F.max("dia").alias("visto_ultima"),
        F.max("k").alias("k"),
        F.sum(F.when(F.col("k") - F.col("before") > 1, 1).otherwise(0)).alias("voltas"),
    )
    left = out.join(F.broadcast(days.select((F.col("k") - 1).alias("k"), F.col("dia").alias("saida"))), "k", "left")
    return left.select("codigo", "preco_inicial", "preco_atual", "mudancas", "visto_primeira", "visto_ultima", "saida", "voltas")


def _one_pass(units: list[tuple], share: float) -> list[tuple]:
    """Units (code, price, made, oldest) after each opener, in order, has taken those still free within ``share`` of its price.

    Prices are sorted once and free ones linked, so that each unit is taken once however many lie close; units without a price, or of
    price 0, stay alone. The newest of a cluster stays, the first of equals, with the oldest date of all; unknown dates are older than any.
    """
    by_price = sorted((i for i, u in enumerate(units) if u[1]), key=lambda i: (units[i][1], i))
    prices = [units[i][1] for i in by_price]
    place = {i: k for k, i in enumerate(by_price)}
    following = list(range(len(prices) + 1))  # the first free place from here on

    def next_free(k: int) -> int:
        end = k
        while following[end] != end:
            end = following[end]
        while following[k] != end:
            following[k], k = end, following[k]
        return end

    kept, taken = [], [False] * len(units)
    for i, unit in enumerate(units):
        if taken[i]:
            continue
        cluster = [i]
        if i in place:
            opener = unit[1]
            k = next_free(bisect_left(prices, opener * (1 - share) * (1 - 1e-9)))
            while k < len(prices) and (prices[k] <= opener or prices[k] - opener <= share * opener):
                if opener - prices[k] <= share * opener:
                    taken[by_price[k]] = True
                    following[k] = k + 1
                    if by_price[k] != i:
                        cluster.append(by_price[k])
                k = next_free(k + 1)
        cluster.sort()
        newest = max((units[j] for j in cluster), key=lambda u: (u[2] is not None, u[2] if u[2] is not None else 0))
        kept.append((*newest[:3], min((units[j][3] for j in cluster if units[j][3] is not None), default=None)))
    return kept


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each run of rows with equal keys begins; nulls are equal, and so is what isn't a number."""
    new = np.ones(rows.num_rows, dtype=bool)
    new[1:] = False
    for key in keys:
        column = rows[key].combine_chunks()
        a, b = column.slice(1), column.slice(0, max(len(column) - 1, 0))
        differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        differs = differs | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
        if pa.types.is_floating(column.type):
            differs &= ~pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False).to_numpy(zero_copy_only=False)
        new[1:] |= differs
    return np.flatnonzero(new)


def _settled_groups(rows: pa.Table, starts: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the units that stay of each group of ``rows``, and of rows with their oldest date, after passes until nothing merges."""
    sizes = np.diff(np.append(starts, rows.num_rows))
    alone = starts[sizes == 1]
    kept, oldest = alone.tolist(), alone.tolist()
    made = rows["criado"].combine_chunks()
    ranks = pc.rank(made, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
    ranks[pc.is_null(made).to_numpy(zero_copy_only=False)] = -1
    _, holder = np.unique(ranks, return_index=True)
    holder = dict(zip(ranks[holder].tolist(), holder.tolist()))
    dates = [None if k < 0 else k for k in ranks.tolist()]
    prices = [None if x is None or x != x else x for x in rows["preco"].cast("float64").to_pylist()]
    for start, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        units = [(i, prices[i], dates[i], dates[i]) for i in range(start, start + n)]
        while True:
            left = _one_pass(units, share)
            done, units = len(left) == len(units), left
            if done:
                break
        kept += [u[0] for u in units]
        oldest += [holder[-1 if u[3] is None else u[3]] for u in units]
    return np.array(kept, dtype=np.int64), np.array(oldest, dtype=np.int64)


def merge_readvertised(listings: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """codigo, mais_antigo of what stays: in each building and exact area, units within a few percent of a cluster's opener
    are one, the newest stays with the oldest date of all; repeated until nothing merges. Rows without a building stay.

    ``listings`` has endereco, area, ordem (of arrival), codigo, preco, criado. A null area is an area of its own; units without a
    price, or of price 0, merge with nothing; an unknown date is older than any, and of several the first to arrive stays.
    Order decides here, so groups are looped over in Python: of one building and area, and of prices without a gap that no cluster
    can cross, so that only they are held at once, in time that grows with their number times its logarithm. Groups are mostly of a few
    rows, so sorted rows come in batches of many groups; what a batch leaves unfinished goes on with the next.
    """
    share = p.merge_price_share

    out = listings.select(F.col("codigo"), F.col("criado").alias("mais_antigo")).schema
    gap, island = free(listings, "_gap"), free(listings, "_island")
    by = Window.partitionBy("endereco", "area").orderBy("preco")
    # a hair more than the widest step from an opener to a unit below it; those above are nearer
    apart = F.col("preco") * (1 - p.merge_price_share) * (1 - 1e-9) > F.lag("preco").over(by)
    gaps = listings.where("endereco is not null").withColumn(gap, F.when(apart, 1).otherwise(0))
    islands = gaps.withColumn(island, F.sum(gap).over(by.rowsBetween(Window.unboundedPreceding, 0))).drop(gap)
    keys = ["endereco", "area", island]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            kept, oldest = _settled_groups(rows, starts, share)
            codes, dates = rows["codigo"].combine_chunks().take(pa.array(kept)), rows["criado"].combine_chunks().take(pa.array(oldest))
            yield pa.RecordBatch.from_arrays([codes, dates], names=["codigo", "mais_antigo"])

        held: list[pa.RecordBatch] = []  # of one group, the last met
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts(pa.Table.from_batches([*(b.slice(b.num_rows - 1) for b in held[-1:]), batch]), keys) - bool(held)
            begins = starts[starts >= 0] if held else starts[1:]
            if len(begins):
                rows = pa.Table.from_batches([*held, batch.slice(0, int(begins[-1]))])
                if rows.num_rows:
                    yield from finished(rows, _starts(rows, keys))
                held, batch = [], batch.slice(int(begins[-1]))
            held.append(batch)
        if held:
            yield from finished(pa.Table.from_batches(held), np.zeros(1, dtype=np.int64))

    ordered = islands.select(*keys, "ordem", "codigo", "preco", "criado").repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_last("ordem"))
    return ordered.mapInArrow(settle, out).union(listings.where("endereco is null").select("codigo", F.col("criado").alias("mais_antigo")))
