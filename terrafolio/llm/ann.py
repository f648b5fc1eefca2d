"""Approximate nearest neighbours by cosine: probed lists, scanned a block of rotated dimensions at a time.

Vectors are scaled to unit length and rotated by one random orthogonal matrix, so that the first d dimensions of a difference
are an unbiased sample of all. While a list is scanned, a candidate is given up after d dimensions as soon as a hypothesis
test says that its whole distance exceeds the query's current k-th best. Those that remain are measured exactly, in double
precision, on the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafolio.llm.common import Scratch, bounded_sample


@dataclass(frozen=True)
class AnnParams:
    k: int = 5
    #: Rows that the lists' centres and the number of probes are fitted on, at most; every row is indexed. There are as many
    #: lists as rows / ``list_rows``, but ``lists`` at least and sample_rows / 16 at most.
    sample_rows: int = 65_536
    lists: int = 64
    #: Recall on the sample that the number of probes is chosen for.
    recall: float = 0.97
    calibration_queries: int = 128
    kmeans_rounds: int = 10
    #: Dimensions scanned between two tests, and the test's width: larger gives up fewer candidates wrongly.
    block_dims: int = 16
    epsilon: float = 2.1
    #: Rows of a list, and queries, that one task group handles; larger lists are split.
    list_rows: int = 4096
    query_rows: int = 2048
    seed: int = 11


@dataclass(frozen=True)
class AnnIndex:
    rotation: np.ndarray
    centres: np.ndarray
    probes: int
    params: AnnParams


def unit(vectors: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of very large or small components neither overflow nor vanish
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and the vector as doubles, of rows whose vector is neither null, empty, zero nor partly null or non-finite.

    Cosines are of vectors of one length, so only those of the commonest length take part, the shortest of equally common
    ones. Other columns are ignored; an empty table gives no rows.
    """
    vector = F.transform("embedding", lambda x: x.cast("double")).alias("v")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = embeddings.select("vec_id", vector).where("vec_id is not null and v is not null and size(v) > 0").where(~bad).where(F.exists("v", lambda x: x != 0))
    common = sound.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).agg(F.min_by("d", F.struct(-F.col("n"), "d"))).first()[0]
    return sound.where(F.size("v") == (common or 0))


def fit(vectors: DataFrame, params: AnnParams = AnnParams()) -> AnnIndex:
    """Centres, rotation and the number of probes from a bounded sample of ``usable`` rows, chosen by a hash of vec_id.

    The sample has 128 rows for each list, ``sample_rows`` at most. Without rows the index has no lists; rows that repeat
    count once in the number of probes; of fewer distinct vectors than lists, each is a centre.
    """
    lists = max(params.lists, min(params.sample_rows // 16, vectors.count() // params.list_rows))
    rows = bounded_sample(vectors, "vec_id", min(params.sample_rows, 128 * lists)).select("v").collect()
    rng = np.random.default_rng(params.seed)
    if not rows:
        return AnnIndex(np.zeros((0, 0)), np.zeros((0, 0)), 1, params)
    x = unit(np.array([r["v"] for r in rows]))
    dims = x.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    n = min(lists, len(np.unique(x, axis=0)))
    centres = np.unique(x, axis=0)[rng.permutation(len(np.unique(x, axis=0)))[:n]]
    for _ in range(params.kmeans_rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.stack([np.bincount(nearest, x[:, j], n) for j in range(dims)], axis=1)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
    # the fewest probes that find enough of the sample's own nearest neighbours; copies, all in the first list, count once
    x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]
    q = x[: params.calibration_queries]
    cosines = q @ x.T
    cosines[np.arange(len(q)), np.arange(len(q))] = -2
    k = min(params.k, len(x) - 1)
    probes = n
    if k > 0:
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        rank = np.empty((len(q), n), dtype=np.int64)
        np.put_along_axis(rank, np.argsort(-(q @ centres.T), axis=1), np.arange(n)[None, :], axis=1)
        nearest = (x @ centres.T).argmax(axis=1)
        probes = int(np.quantile(np.take_along_axis(rank, nearest[near], 1), params.recall)) + 1
    return AnnIndex(rotation, centres, min(n, probes), params)


def _assigned(vectors: DataFrame, index: AnnIndex, probes: int, name: str) -> DataFrame:
    """Each vector with its ``probes`` nearest lists."""
    shared = vectors.sparkSession.sparkContext.broadcast(index.centres)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                x = unit(np.stack(pdf["v"].to_numpy()))
                order = np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({name: np.repeat(pdf["vec_id"].to_numpy(), probes), "v": np.repeat(pdf["v"].to_numpy(), probes), "list": order.ravel()})

    kind = vectors.select("vec_id").schema[0].dataType.simpleString()
    return vectors.mapInPandas(assign, f"{name} {kind}, v array<double>, list int")


def scan(index: AnnIndex, q: np.ndarray, x: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query, the rows of ``x`` that remain: every one of its ``k`` best is among them, but for the test's errors.

    ``own[i, j]`` marks a query's own row, which takes no part.
    """
    p = index.params
    dims = x.shape[1]
    a, b = (q @ index.rotation).astype(np.float64), (x @ index.rotation).astype(np.float64)
    kept: list[list[np.ndarray]] = [[] for _ in q]
    best = np.full((len(q), k), np.inf)
    for start in range(0, len(b), 512):
        rows = b[start : start + 512]
        i, j = np.nonzero(~own[:, start : start + 512])
        partial = np.zeros(len(i))
        for d in range(0, dims, p.block_dims):
            to = min(dims, d + p.block_dims)
            if d == 0:
                block = ((a[:, None, :to] ** 2).sum(-1) + (rows[:, :to] ** 2).sum(-1)[None, :]) - 2 * a[:, :to] @ rows[:, :to].T
                partial = block[i, j]
            else:
                partial = partial + ((a[i, d:to] - rows[j, d:to]) ** 2).sum(axis=1)
            bound = best[i, -1]
            if to < dims:
                live = partial * dims / to <= bound * (1 + p.epsilon / np.sqrt(to)) ** 2
            else:
                live = partial <= bound * (1 + 1e-9) + 1e-12
            i, j, partial = i[live], j[live], partial[live]
            if not len(i):
                break
        if not len(i):
            continue
        cut = np.searchsorted(i, np.arange(len(q) + 1))
        for one in np.unique(i):
            s = slice(cut[one], cut[one + 1])
            kept[one].append(j[s] + start)
            merged = np.concatenate([best[one], partial[s]])
            best[one] = np.partition(merged, k - 1)[:k] if len(merged) > k else merged
            best[one].sort()
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in kept]


def search(vectors: DataFrame, queries: DataFrame, index: AnnIndex) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine in double precision on the original vectors), ``k`` rows a query at most.

    Both are ``usable`` rows. A row with the query's vec_id takes no part; ties go to the smaller vec_id. Rows that repeat a
    vec_id count once, by the nearest of their vectors, as candidates and as queries. A query that finds fewer than ``k`` in its lists is searched again over four times as many, up to all.
    """
    p, spark = index.params, vectors.sparkSession
    scratch = Scratch(spark)
    kind = vectors.select("vec_id").schema[0].dataType.simpleString()
    if not len(index.centres):
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    lists = scratch.keep(_assigned(vectors, index, 1, "vec_id"))
    sizes = {r["list"]: -(-r["count"] // p.list_rows) for r in lists.groupBy("list").count().collect()}  # a row for each list
    probes, best = index.probes, None
    while True:
        found = _nearest(lists, sizes, queries, index, probes)
        if probes >= len(index.centres):
            best = found if best is None else best.union(found)
            break
        found = scratch.keep(found)
        whole = found.where(F.size("best") >= p.k)
        short = queries.join(whole.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
        best = whole if best is None else best.union(whole)
        if short.isEmpty():
            break
        queries, probes = scratch.keep(short.select("vec_id", "v")), min(len(index.centres), 4 * probes)
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def _nearest(lists: DataFrame, sizes: dict[int, int], queries: DataFrame, index: AnnIndex, n_probes: int) -> DataFrame:
    """query_id, best: the ``k`` nearest (s, vec_id), ``s`` being the cosine's opposite, in the ``n_probes`` lists nearest to each.

    Lists of more than ``list_rows`` rows are split among tasks by a hash, as are the queries of a list; each task returns
    its best ``k`` a query, and only those meet.
    """
    p = index.params
    kind = lists.select("vec_id").schema[0].dataType.simpleString()
    probes = _assigned(queries, index, n_probes, "query_id")
    asked = {r["list"]: -(-r["count"] // p.query_rows) for r in probes.groupBy("list").count().collect()}
    spark_map = lambda d: F.create_map(*[F.lit(int(x)) for kv in sorted(d.items()) for x in kv]) if d else F.create_map(F.lit(-1), F.lit(1))
    parts, groups = spark_map(sizes), spark_map(asked)
    part_of = lambda column, most: F.pmod(F.xxhash64(F.col(column).cast("string")), F.greatest(F.coalesce(most[F.col("list")], F.lit(1)), F.lit(1))).cast("int")
    spread = lambda most: F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce(most[F.col("list")], F.lit(1)), F.lit(1)) - 1))
    left = lists.withColumn("part", part_of("vec_id", parts)).withColumn("group", spread(groups))
    right = probes.where(F.col("list").isin([int(x) for x in sizes])).withColumn("group", part_of("query_id", groups)).withColumn("part", spread(parts))
    keys = ["list", "part", "group"]

    def meet(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asks):
            # an id may come with several vectors: its nearest counts, so k ids lie within k times as many rows
            rows = rows.assign(b=[v.tobytes() for v in rows["v"]]).drop_duplicates(["vec_id", "b"]).sort_values(["vec_id", "b"])
            many = int(rows["vec_id"].value_counts().max())
            ids, x = rows["vec_id"].to_numpy(), unit(np.stack(rows["v"].to_numpy()))
            for start in range(0, len(asks), 256):
                block = asks.iloc[start : start + 256]
                of, q = block["query_id"].to_numpy(), unit(np.stack(block["v"].to_numpy()))
                for n, found in enumerate(scan(index, q, x, of[:, None] == ids[None, :], p.k * many)):
                    score = np.clip(exact(q[n], x[found]), -1, 1)
                    order = np.lexsort((ids[found], -score))
                    once = np.sort(np.unique(ids[found[order]], return_index=True)[1])[: p.k]
                    out += [(of[n], ids[found[i]], score[i]) for i in order[once]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, f"query_id {kind}, vec_id {kind}, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, p.k).alias("best"))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of unit vectors, summed in one fixed order, so that equal vectors get equal scores wherever they are met."""
    return (x * q).sum(axis=1)
