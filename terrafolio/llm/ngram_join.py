"""N-gram Jaccard join by grouped prefixes.

A document's set of word shingles is put in one global order, rare ones first; two sets of Jaccard similarity t share one of
their first n - ceil(t n) + 1 shingles. Documents with the same size and prefix become one group; groups that share a prefix
shingle are filtered by size and by the position of the shingle, then expanded, and their members verified on whole sets.

To keep large families of near copies from making all their pairs, links are found in two rounds. First each group is
paired with the head of each of its prefix shingles, the group in which the shingle comes first; then only pairs of groups
that aren't yet in one component are left to verify.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafolio.llm.common import Scratch, bytes_of, column_of, map_texts, slices, summed_counters
from terrafolio.llm.components import components
from terrafolio.llm.shingles import mix, shingle_sets


@dataclass(frozen=True)
class JoinParams:
    #: Words of a shingle, and the similarity, in hundredths, from which documents link.
    size: int = 5
    percent: int = 80
    #: log2 of the counters that tell frequent shingles from rare ones. They only order shingles: no result depends on them.
    counter_bits: int = 19
    #: Shingles looked back at to see whether a pair has been met already; it only saves repeats.
    lookback: int = 16
    #: Bytes of text hashed at once.
    batch_bytes: int = 1 << 20


def _frequency(docs: DataFrame, p: JoinParams) -> np.ndarray:
    """For each hash bucket of shingles, how frequent it is over all documents: twice log2 of its count against the median's."""

    def count(part: pa.RecordBatch) -> np.ndarray:
        hashes, _ = shingle_sets(bytes_of(part), p.size)
        return np.bincount((hashes >> np.uint64(64 - p.counter_bits)).astype(np.int64), minlength=1 << p.counter_bits)

    total = summed_counters(docs.select("text"), 1 << p.counter_bits, count, p.batch_bytes).astype(np.float64)
    middle = max(1.0, float(np.median(total)))
    return np.clip(np.floor(2 * np.log2(np.maximum(1, total / middle))), 0, 63).astype(np.uint8)


def _described(docs: DataFrame, levels, p: JoinParams) -> DataFrame:
    """doc_id, n_shingles, two hashes and a sketch of the set, prefix (sorted keys) of each document."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> dict:
        n, s1, s2, prefix, sketches = [], [], [], [], []
        for part in slices(iter([batch]), "text", p.batch_bytes):
            sets, bounds = shingle_sets(bytes_of(part), p.size)
            keys = (levels.value[(sets >> np.uint64(64 - p.counter_bits)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (mix(sets) >> np.uint64(6))
            first, second = mix(sets ^ np.uint64(0x5851F42D4C957F2D)), mix(sets ^ np.uint64(0x14057B7EF767814F))
            for a, b in zip(bounds[:-1], bounds[1:]):
                k = np.sort(keys[a:b])
                size = int(b - a)
                n.append(size)
                s1.append(first[a:b].sum(dtype=np.uint64))
                s2.append(second[a:b].sum(dtype=np.uint64))
                sketches.append(_sketch(sets[a:b]))
                prefix.append(k[: size - -(-p.percent * size // 100) + 1].view(np.int64) if size else np.zeros(0, np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in prefix])]).astype(np.int32)
        return {
            "doc_id": column_of(batch, "doc_id"),
            "n_shingles": n,
            "s1": pa.array(np.array(s1, dtype=np.uint64).view(np.int64)),
            "s2": pa.array(np.array(s2, dtype=np.uint64).view(np.int64)),
            "sketch": pa.array(sketches, pa.binary()),
            "prefix": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64))),
        }

    return map_texts(docs.select("doc_id", "text"), f"doc_id {kind}, n_shingles long, s1 long, s2 long, sketch binary, prefix array<long>", one)


def _may_link(p: JoinParams, na: Column, pa_: Column, nb: Column, pb: Column) -> Column:
    """Size and position filters: false only if sets of these sizes, whose first common key has these positions, can't link."""
    most = F.least(na - pa_, nb - pb)
    return (100 * F.least(na, nb) >= p.percent * F.greatest(na, nb)) & ((100 + p.percent) * most >= p.percent * (na + nb))


def _sketch(hashes: np.ndarray) -> bytes:
    """How many of a set's hashes begin with each pattern of bits; about half a byte a hash, nothing if a count is too large."""
    bits = max(5, int(len(hashes)).bit_length() - 1)
    counts = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def _most_common(x: bytes, y: bytes) -> float:
    """An upper bound of how many hashes two sets have in common, from their sketches."""
    if not x or not y:
        return float("inf")
    a, b = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
    n = min(len(a), len(b))
    return float(np.minimum(a.reshape(n, -1).sum(axis=1), b.reshape(n, -1).sum(axis=1)).sum())


def _paired(pairs: DataFrame, values: DataFrame, name: str, links) -> DataFrame:
    """Those of ``pairs`` (a, b) for which ``links`` holds of their two rows' ``name``; ``values`` has node, n and ``name``."""
    side = lambda node, n, x: values.select(F.col("node").alias(node), F.col("n").alias(n), F.col(name).alias(x))
    both = pairs.join(side("b", "nb", "y"), "b").join(side("a", "na", "x"), "a").select("a", "b", "na", "nb", "x", "y")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(k).to_pylist() for k in (2, 3))
            found = [links(i, j, x.as_py(), y.as_py()) for i, j, x, y in zip(na, nb, batch.column(4), batch.column(5))]
            yield batch.select([0, 1]).filter(pa.array(found, pa.bool_()))

    return both.mapInArrow(keep, both.select("a", "b").schema)


def _verified(pairs: DataFrame, docs: DataFrame, sketches: DataFrame, p: JoinParams, scratch: Scratch) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets link.

    Sketches rule out most of the others first, so that few whole sets are made and moved.
    """
    enough = lambda common, na, nb: 100 * common >= p.percent * (na + nb - common)

    def linked(na: int, nb: int, x: bytes, y: bytes) -> bool:
        common = na + nb - len(np.unique(np.concatenate([np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)])))
        return enough(common, na, nb)

    may = scratch.keep(_paired(pairs, sketches, "sketch", lambda na, nb, x, y: enough(min(_most_common(x, y), na, nb), na, nb)))
    ids = may.select(F.col("a").alias("doc_id")).union(may.select("b")).distinct()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def as_sets(batch: pa.RecordBatch) -> dict:
        rows = []
        for part in slices(iter([batch]), "text", p.batch_bytes):
            sets, bounds = shingle_sets(bytes_of(part), p.size)
            rows += [sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        return {"node": column_of(batch, "doc_id"), "n": [len(r) // 8 for r in rows], "set": rows}

    chosen = docs.join(ids.hint("shuffle_hash"), "doc_id", "left_semi")
    sets = scratch.keep(map_texts(chosen, f"node {kind}, n long, set binary", as_sets).where("n > 0"))
    scratch.release()
    links = scratch.keep(_paired(may, sets, "set", linked))
    scratch.drop(sets, may)
    return links


def near_duplicates(docs: DataFrame, p: JoinParams = JoinParams()) -> DataFrame:
    """doc_id, n_shingles (size of its set), component_id (smallest doc_id that links reach) of every row of ``docs``.

    Documents link when 100 * |A and B| >= percent * |A or B|. Texts that are null, empty or without words have no shingles
    and link with nothing; rows with a null doc_id link with nothing and have a null component. Rows that repeat a doc_id are
    one document if their texts are the same, and are in one component anyway. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text")
    levels = spark.sparkContext.broadcast(_frequency(docs, p))
    described = scratch.keep(_described(docs, levels, p).withColumn("group", F.xxhash64("prefix")))
    some = described.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.keep(some.groupBy("n_shingles", "s1", "s2", "group").agg(F.min("doc_id").alias("node")))
    groups = some.groupBy("n_shingles", "group").agg(F.min(F.struct("doc_id", "prefix")).alias("m")).select(F.col("m.doc_id").alias("gid"), F.col("n_shingles").alias("n"), F.col("m.prefix").alias("prefix"))

    # groups by each of their prefix shingles, and the group in which that comes first
    tokens = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    order = Window.partitionBy("token").orderBy("pos", "n", "gid")
    headed = tokens.select("token", "gid", "n", "pos", F.first(F.struct("gid", "n", "pos")).over(order).alias("head"), F.lead("gid").over(order).alias("next"))
    shared = scratch.keep(headed.where("gid <> head.gid or next is not null").drop("next"))
    first_pairs = scratch.keep(
        shared.where(F.col("gid") != F.col("head.gid"))
        .where(_may_link(p, F.col("n"), F.col("pos"), F.col("head.n"), F.col("head.pos")))
        .select(F.col("head.gid").alias("ga"), F.col("gid").alias("gb"))
        .distinct()
    )

    classes_only = scratch.keep(described.drop("prefix"))
    scratch.drop(described)
    # a group stays if some other group of the shingle has a size that its own size and the shingle's position allow
    by_size = Window.partitionBy("token").orderBy("n", "gid")
    most = F.floor((F.col("n") - F.col("pos")) * (100 + p.percent) / p.percent) - F.col("n")
    less, more = F.lag("n").over(by_size), F.lead("n").over(by_size)
    near = F.when(most < F.col("n"), F.first("n").over(by_size) <= most).otherwise((100 * less >= p.percent * F.col("n")) | (more <= most))
    viable = scratch.keep(shared.select("token", "gid", "n", "pos", near.alias("near")).where("near").drop("near"))
    members = scratch.keep(classes.select("node", F.col("n_shingles").alias("n"), "group").join(classes.groupBy(F.col("n_shingles").alias("n"), "group").agg(F.min("node").alias("gid"), F.count("*").alias("members")), ["n", "group"]).select("gid", "node", "members"))
    sketches = classes_only.where("n_shingles > 0").join(classes, (classes_only["doc_id"] == classes["node"]) & (classes_only["s1"] == classes["s1"]) & (classes_only["s2"] == classes["s2"]), "left_semi")
    sketches = scratch.keep(sketches.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sketch"))

    def expand(group_pairs: DataFrame) -> DataFrame:
        a = members.select(F.col("gid").alias("ga"), F.col("node").alias("a"))
        b = members.select(F.col("gid").alias("gb"), F.col("node").alias("b"))
        return group_pairs.join(a, "ga").join(b, "gb").select("a", "b")

    within = members.where("gid <> node").select(F.col("gid").alias("a"), F.col("node").alias("b"))
    links = _verified(expand(first_pairs).union(within), docs, sketches, p, scratch)
    scratch.release()
    found = scratch.keep(components(links, scratch))

    # what the first round left: pairs of groups that aren't all in one component
    placed = members.join(found.withColumnRenamed("component", "c"), "node", "left").select("gid", "node", F.coalesce("c", "node").alias("c"))
    placed = scratch.keep(placed)
    spans = placed.groupBy("gid").agg(F.min("c").alias("c0"), F.max("c").alias("c1"))
    open_tokens = viable.join(spans, "gid")
    torn = open_tokens.groupBy("token").agg(F.min("c0").alias("t0"), F.max("c1").alias("t1"), F.count("*").alias("k")).where("t0 < t1 and k > 1").select("token")
    # near copies share most of their shingles: with the few before each, a pair is met once and not at every one of them
    lately = F.collect_list("token").over(Window.partitionBy("gid").orderBy("pos").rowsBetween(-p.lookback, -1))
    left = scratch.keep(open_tokens.join(torn, "token").withColumn("before", lately))
    x, y = (left.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("gid", "n", "pos", "c0", "c1", "before"))) for s in ("x", "y"))
    apart = (F.least("c0_x", "c0_y") < F.greatest("c1_x", "c1_y")) & (F.col("gid_x") < F.col("gid_y"))
    second_pairs = x.join(y, (x["token"] == y["token"]) & apart & ~F.arrays_overlap("before_x", "before_y") & _may_link(p, F.col("n_x"), F.col("pos_x"), F.col("n_y"), F.col("pos_y"))).select(F.col("gid_x").alias("ga"), F.col("gid_y").alias("gb")).distinct()
    second_pairs = second_pairs.join(first_pairs.union(first_pairs.select("gb", "ga")), ["ga", "gb"], "left_anti")
    inner = placed.join(spans.where("c0 < c1").select("gid"), "gid")
    inside = inner.select("gid", F.col("node").alias("a"), F.col("c").alias("ca")).join(inner.select("gid", F.col("node").alias("b"), F.col("c").alias("cb")), "gid").where("a < b and ca <> cb").select("a", "b")
    more = _verified(expand(second_pairs).union(inside), docs, sketches, p, scratch)
    scratch.drop(sketches)
    every = components(links.union(more), scratch)

    # members of a class follow its node
    result = classes_only.drop("sketch").join(classes, ["n_shingles", "s1", "s2", "group"], "left")
    result = result.join(every, "node", "left")
    own = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.coalesce("component", "node"))
    return result.select("doc_id", "n_shingles", own.alias("component_id"))


def representatives(docs: DataFrame, p: JoinParams = JoinParams()) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose doc_id is the smallest of its component.

    Rows without shingles all stay, as do rows with a null doc_id; of rows that repeat a doc_id, one stays.
    """
    found = near_duplicates(docs, p).where("doc_id <> component_id").select("doc_id").distinct()
    left = docs.join(found.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    return left.where("doc_id is null").unionByName(left.where("doc_id is not null").dropDuplicates(["doc_id"]))

