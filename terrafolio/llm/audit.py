"""Filter interaction audit by adjacent transpositions.

Each document becomes a mask of the filters that it fails. Counts by part and mask, the cells, hold all that any order of the
filters does: a filter removes the documents whose mask has its bit and none of the filters before it. All orders are visited by a
walk that swaps two neighbouring filters at a time, so that each visit counts only the two steps that the swap touches anew;
what each filter removes, added up along the walk, is its Shapley sum.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Orders grow with the factorial of the filters, and each part has a row for each order and step.
MOST_FILTERS = 8
SPACE = r"[\x20\x09-\x0D]+"
SIGNS = "[#$%&*|]"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of one text: A under 200 words, B repeated words, C capitals, D signs. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(SIGNS),
    }


def mask(failures: Sequence[Column]) -> Column:
    """An int whose bit k is set where failure k holds; a failure that is null doesn't hold."""
    total = F.lit(0)
    for k, failed in enumerate(failures):
        total = total + F.when(failed, 1 << k).otherwise(0)
    return total


def document_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, n_good, n_toxic: how many documents of each part (``lang``, null as empty) fail each set of A to E.

    ``docs`` has doc_id, text, lang, ``labels`` doc_id, quality, toxic; other columns are ignored. E fails a document if a row with
    a smaller doc_id holds the same text (null counts as empty). Rows without a doc_id never fail E and have no label; repeated rows
    count each, and of several labels of one doc_id any 1 counts. An empty table has no cells.

    Texts stay in their scan, which leaves a mask and a digest of each. Copies are counted before they are shuffled, so neither a
    group of copies nor a repeated doc_id meets in one task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), mask(list(text_failures(F.col("text")).values())).alias("mask"), F.sha2(text, 256).alias("digest"))
    # rows without a doc_id get a key that no label has, one for each text, so that they don't meet in one task
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), "digest"))
    rows = read.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")).withColumn("key", key)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("key"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(marks, "key", "left").select("doc_id", "digest", "part", "mask", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    # of each text: how many rows there are by part and label, and how many of them have the smallest doc_id there
    rows = rows.withColumn("known", F.col("doc_id").isNotNull())
    groups = rows.groupBy("digest", "known", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"))
    # a text has few of these groups, by its parts and labels, however many copies there are
    groups = groups.withColumn("first", F.min("least").over(Window.partitionBy("digest")))
    spared = F.when(~F.col("known"), F.col("n")).when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), spared.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - spared).alias("n"))))
    split = groups.select("part", "good", "toxic", split.alias("s")).select("part", "good", "toxic", "s.mask", "s.n").where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good"), F.sum(F.col("n") * F.col("toxic")).alias("n_toxic"))


def transpositions(k: int) -> Iterator[tuple[list[int], int | None]]:
    """All orders of ``k`` items, each with the position at which it and the order before it swapped two neighbours.

    The largest item that can still move in its direction moves one place; items above it then turn round.
    """
    order, ways = list(range(k)), [-1] * k
    yield list(order), None
    while True:
        movable = [x for i, x in enumerate(order) if 0 <= i + ways[x] < k and order[i + ways[x]] < x]
        if not movable:
            return
        top = max(movable)
        i = order.index(top)
        j = i + ways[top]
        order[i], order[j] = order[j], order[i]
        for x in range(top + 1, k):
            ways[x] = -ways[x]
        yield list(order), min(i, j)


def walk(cells: np.ndarray, names: Sequence[str]) -> tuple[list[str], dict[str, np.ndarray]]:
    """What every step of every order does, from ``cells`` (measures, parts, masks), whose first measure counts documents.

    Gives the orders, and by measure arrays (orders, steps, parts), and "shapley" (filters, parts).
    """
    k = len(names)
    masks = np.arange(1 << k)
    has = [(masks >> f & 1).astype(bool) for f in range(k)]
    total = cells[0].sum(axis=1)
    failing = [cells[0][:, has[f]].sum(axis=1) for f in range(k)]
    alone = [cells[0][:, 1 << f] for f in range(k)]
    measures, parts = cells.shape[0], cells.shape[1]
    now = np.zeros((k, measures, parts), dtype=np.int64)
    kept = np.zeros((k, parts), dtype=np.int64)

    def step(order: list[int], i: int, before: int) -> None:
        """Count step ``i`` anew, whose earlier filters are the bits of ``before``."""
        removed = has[order[i]] & (masks & before == 0)
        now[i] = cells[:, :, removed].sum(axis=2)
        kept[i] = (kept[i - 1] if i else total) - now[i][0]

    orders: list[str] = []
    n = factorial(k)
    out = {name: np.zeros((n, k, parts), dtype=np.int64) for name in ("kept", "redundant", "unique_fails")}
    lost = np.zeros((n, k, measures, parts), dtype=np.int64)
    shapley = np.zeros((k, parts), dtype=np.int64)
    for at, (order, swapped) in enumerate(transpositions(k)):
        touched = range(k) if swapped is None else (swapped, swapped + 1)
        for i in touched:
            step(order, i, sum(1 << f for f in order[:i]))
        orders.append("".join(names[f] for f in order))
        lost[at], out["kept"][at] = now, kept
        for i, f in enumerate(order):
            shapley[f] += now[i][0]
            out["redundant"][at, i] = failing[f] - now[i][0]
            out["unique_fails"][at, i] = alone[f]
    return orders, out | {"lost": lost, "shapley": shapley}


def interactions(cells: DataFrame, names: Sequence[str], marks: Sequence[str] = ("good", "toxic")) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, <mark>_lost..., shapley of every part, order and step.

    ``cells`` has a row for each part and mask: part (string, not null), mask (bit k: filter k fails), n, and n_<mark> for each mark;
    masks that are absent count 0, those given twice are added up, and other columns are ignored. No cells, no rows. At most 8
    filters of one character each. Each part is at most 2 ** filters numbers in its task; parts are dealt over tasks.
    """
    k = len(names)
    if not 1 <= k <= MOST_FILTERS or any(len(x) != 1 for x in names) or len(set(names)) != k:
        raise ValueError(f"1 to {MOST_FILTERS} filters with distinct names of one character")
    counts = ["n", *(f"n_{m}" for m in marks)]
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *(f"{m}_lost" for m in marks), "shapley"]
    schema = T.StructType([T.StructField(c, T.StringType() if c in ("part", "filter_order") else T.IntegerType() if c == "step" else T.LongType()) for c in columns])
    arrow = pa.schema([(c, pa.string() if c in ("part", "filter_order") else pa.int32() if c == "step" else pa.int64()) for c in columns])
    names = list(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cells = np.zeros((len(counts), 1, 1 << k), dtype=np.int64)
                for cell in row["cells"]:
                    cells[:, 0, cell["mask"]] += [cell[c] for c in counts]
                orders, found = walk(cells, names)
                n = len(orders) * k
                own = {"part": [row["part"]] * n, "filter_order": np.repeat(orders, k), "step": np.tile(np.arange(1, k + 1), len(orders)), "removed": found["lost"][:, :, 0, 0].ravel()}
                own |= {c: found[c][:, :, 0].ravel() for c in ("kept", "redundant", "unique_fails")}
                own |= {f"{m}_lost": found["lost"][:, :, 1 + j, 0].ravel() for j, m in enumerate(marks)}
                own["shapley"] = np.array([found["shapley"][names.index(f), 0] for o in orders for f in o])
                yield pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) for f in arrow], schema=arrow)

    summed = cells.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in counts))
    lists = summed.groupBy("part").agg(F.collect_list(F.struct("mask", *counts)).alias("cells"))
    return lists.mapInArrow(run, schema)
