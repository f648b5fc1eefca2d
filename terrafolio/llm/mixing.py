"""Mixing to target weights with soft membership.

A classifier fitted on a labelled table gives each document a probability for each domain. Nonnegative rates of the
documents are then fitted by projected gradient least squares, so that the expected tokens of each domain, the sum over
documents of rate * tokens * probability, match the targets. Only those totals, one number a domain, reach the driver: a
document's rate follows from its own probabilities and the few gradients so far.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafolio.llm.common import Scratch, bytes_of, column_of, labelled_sample, map_texts, sampled_texts, slices
from terrafolio.llm.shingles import SPACES

#: Sums that travel as one row.
SLICE = 4096
IS_WORD = np.array([c not in SPACES for c in range(256)])


@dataclass(frozen=True)
class MixingParams:
    #: Labelled documents of each domain that the classifier is fitted on, at most: the bound of the labelled sample.
    docs_per_domain: int = 600
    #: Of all domains together, at most: with many domains, each gets fewer.
    most_docs: int = 20_000
    #: Buckets of the hashed byte pairs that the classifier reads.
    features: int = 1024
    steps: int = 200
    ridge: float = 1e-5
    #: Tokens of the mix as a share of all tokens; weights of the domains, equal where none are given.
    token_share: float = 0.5
    weights: dict[str, float] = field(default_factory=dict)
    #: Fitting ends when every total is within this share of its own target (a target of 0: of all targets), or, where rates of
    #: 0 or more can't reach them, when a pair of steps lowers the squared error by less than ``stall`` of it. ``rounds`` guards
    #: against more steps than any fit should take, with a warning. What is reached is returned with the rates.
    tolerance: float = 1e-5
    stall: float = 0.01
    rounds: int = 200
    batch_bytes: int = 1 << 20


@dataclass(frozen=True)
class DomainModel:
    domains: tuple[str, ...]
    weights: np.ndarray
    params: MixingParams


def describe(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of the shares of each text's hashed byte pairs, and its number of words ``[^\\x20\\x09-\\x0D]+``."""
    data = np.frombuffer(b" ".join(texts) + b"  ", dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    pairs = (data[:-1].astype(np.int64) * 0x9E37 + data[1:].astype(np.int64) * 0x79B1) >> 3
    counts = np.bincount(of * n + pairs[: len(of)] % n, minlength=len(texts) * n).reshape(len(texts), n)
    inside = IS_WORD[data]
    begins = inside[: len(of)] & ~np.concatenate([[False], inside[: len(of) - 1]])
    words = np.bincount(of[begins], minlength=len(texts))
    return np.sqrt(counts / np.maximum(1, sizes)[:, None]), words


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, labelled: DataFrame, p: MixingParams = MixingParams()) -> DomainModel:
    """A softmax regression from ``docs`` (doc_id, text) and ``labelled`` (doc_id, domain); nulls in either are left out.

    Fitted on a bounded sample of each domain. Of several domains of one doc_id the first by name counts, of repeated rows of one the
    least text; empty texts count. Without labelled texts there is one domain, ``all``.
    """
    labels = labelled.select("doc_id", "domain").na.drop().groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sample = labelled_sample(labels, "doc_id", "domain", p.docs_per_domain, p.most_docs)
    chosen = sampled_texts(docs, sample)

    def one(batch):
        rows, _ = describe(bytes_of(batch), p.features)
        return {"key": column_of(batch, "doc_id").cast("string"), "domain": column_of(batch, "domain"), "x": [r.astype(np.float32).tobytes() for r in rows]}

    rows = sorted((r["key"], r["domain"], bytes(r["x"])) for r in map_texts(chosen, "key string, domain string, x binary", one).collect())
    domains = tuple(sorted({d for _, d, _ in rows})) or ("all",)
    k = len(domains)
    if k == 1:
        return DomainModel(domains, np.zeros((p.features + 1, 1)), p)
    x = np.concatenate([np.frombuffer(b"".join(r[2] for r in rows), dtype=np.float32).reshape(len(rows), -1), np.ones((len(rows), 1), np.float32)], axis=1)
    y = np.eye(k, dtype=np.float32)[[domains.index(d) for _, d, _ in rows]]
    weight = (1 / np.maximum(1, y.sum(axis=0)))[y.argmax(axis=1)][:, None] / k
    w, m, v = (np.zeros((x.shape[1], k), np.float32) for _ in range(3))
    for step in range(1, p.steps + 1):
        g = x.T @ ((_softmax(x @ w) - y) * weight).astype(np.float32) + p.ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return DomainModel(domains, w.astype(np.float64), p)


def memberships(docs: DataFrame, model: DomainModel) -> DataFrame:
    """doc_id, n_tokens, p (probabilities of the domains, in their order) of every row; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def one(batch):
        p, tokens = [], []
        for part in slices(iter([batch]), "text", model.params.batch_bytes):
            rows, words = describe(bytes_of(part), model.params.features)
            p += _softmax(np.concatenate([rows, np.ones((len(rows), 1))], axis=1) @ shared.value.weights).tolist()
            tokens += words.tolist()
        return {"doc_id": column_of(batch, "doc_id"), "n_tokens": tokens, "p": p}

    return map_texts(docs.select("doc_id", "text"), f"doc_id {kind}, n_tokens long, p array<double>", one)


def rates(p: np.ndarray, start: float, moves: list[tuple[bool, np.ndarray]]) -> np.ndarray:
    """Rates of documents of probabilities ``p`` after the steps so far, (face, direction) each, projected to 0 or more.

    Steps on a face move only the rates above 0.
    """
    r = np.full(len(p), start)
    for face, move in moves:
        moved = np.maximum(0, r + p @ move)
        r = np.where(r > 0, moved, r) if face else moved
    return r


def _stack(column: pa.Array, k: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, k)


def fit_rates(members: DataFrame, targets: np.ndarray, p: MixingParams) -> tuple[float, list[tuple[bool, np.ndarray]], np.ndarray]:
    """The starting rate, the steps, and the expected tokens by domain that they reach.

    Least squares in the metric of the documents' tokens, weighted by the inverse of sum(tokens * p p'), so that a projected
    gradient step of length 1 never raises the error. Between two such steps there is one on the face of the rates above 0,
    scaled by the inverse of their own sum(tokens * p p'), which is exact but for the projection; it is taken back, and the
    next one shortened, where it raises the error. Each step is one pass, of which k + k * k sums reach the driver, added up in
    slices by tasks.
    """
    k = len(targets)

    def state(moves: list[tuple[bool, np.ndarray]], start: float) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k + k * k)
            for batch in batches:
                if batch.num_rows:
                    t, q = np.asarray(batch.column(0), dtype=np.float64), _stack(batch.column(1), k)
                    r = rates(q, start, moves)
                    free = r > 0
                    total += np.concatenate([(r * t) @ q, ((q[free] * t[free, None]).T @ q[free]).ravel()])
            parts = [total[i : i + SLICE].tobytes() for i in range(0, len(total), SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    sums[i] = sums.get(i, 0) + np.frombuffer(part)
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "sums"])

        schema = "slice int, sums binary"
        total = np.zeros(k + k * k)
        made = members.select("n_tokens", "p").mapInArrow(run, schema)
        # one slice streams through one task; slices of many domains are dealt out
        dealt = made.repartition(1) if len(total) <= SLICE else made.repartition("slice")
        for row in dealt.mapInArrow(add, schema).collect():
            total[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["sums"])
        return total[:k], total[k:].reshape(k, k)

    at_one, gram = state([], 1.0)
    all_tokens = at_one.sum()
    # by each domain's own sum, so that small domains weigh as much as large ones
    ridge = np.diag(np.maximum(1e-12 * np.diag(gram), 1e-18))
    inverse = np.linalg.pinv(gram + ridge)
    squared = lambda totals: float((targets - totals) @ inverse @ (targets - totals))
    start = float(targets.sum() / all_tokens) if all_tokens else 0.0
    moves: list[tuple[bool, np.ndarray]] = []
    reached, free = at_one * start, gram
    face, scale, gained = True, 1.0, np.inf
    for _ in range(p.rounds):
        error = targets - reached
        if not all_tokens or (np.abs(error) <= p.tolerance * np.where(targets > 0, targets, targets.sum())).all():
            return start, moves, reached
        move = scale * (np.linalg.pinv(free + ridge) @ error) if face else inverse @ error
        totals, its_free = state([*moves, (face, move)], start)
        gain = 1 - squared(totals) / squared(reached)
        if gain > 0:
            moves.append((face, move))
            reached, free = totals, its_free
        if face:
            # a step taken back says nothing about how near the end is, unless no length helps
            gained = gain if gain > 0 else np.inf if scale > 1e-3 else 0.0
            scale = min(1.0, 2 * scale) if gain > 0 else scale / 4
        elif gained < p.stall and gain < p.stall:
            return start, moves, reached
        face = not face
    warnings.warn(f"rates are those of {p.rounds} rounds: {reached} for targets of {targets}", stacklevel=2)
    return start, moves, reached


def mix(docs: DataFrame, model: DomainModel) -> DataFrame:
    """Every row of ``docs``, with n_tokens, domain (the likeliest), target and reached (expected tokens of that domain in the
    mix, as asked for and as fitted), rate (0 or more) and copies.

    ``copies`` is the rate rounded up or down by the hash of the doc_id, so that its expectation is the rate. Columns of
    ``docs`` that have one of those names are replaced. Empty texts have no tokens and get the rate of their probabilities.
    Repeated rows count each. Targets of domains are their weights' shares of ``token_share`` of all tokens; where no rates
    reach them, those of the least squared error are taken, and ``reached`` tells.
    """
    p, k = model.params, len(model.domains)
    scratch = Scratch(docs.sparkSession)
    members = scratch.keep(memberships(docs, model).select("n_tokens", "p"))
    total = members.agg(F.sum("n_tokens")).first()[0] or 0
    weights = np.array([max(0.0, p.weights.get(d, 0.0 if p.weights else 1.0)) for d in model.domains])
    weights = weights / weights.sum() if weights.sum() else np.full(k, 1 / k)
    targets = weights * p.token_share * total
    start, moves, reached = fit_rates(members, targets, p)
    scratch.drop(members)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.drop("n_tokens", "domain", "target", "reached", "rate", "copies")
    out = plain.withColumns({"n_tokens": F.lit(0).cast("long"), "domain": F.lit(""), "target": F.lit(0.0), "reached": F.lit(0.0), "rate": F.lit(0.0)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", p.batch_bytes):
            rows, words = describe(bytes_of(part), p.features)
            q = _softmax(np.concatenate([rows, np.ones((len(rows), 1))], axis=1) @ shared.value.weights)
            of = q.argmax(axis=1)
            made = {"n_tokens": pa.array(words, pa.int64()), "domain": pa.array([model.domains[i] for i in of]), "target": pa.array(targets[of]), "reached": pa.array(reached[of]), "rate": pa.array(rates(q, start, moves))}
            yield pa.RecordBatch.from_arrays([made.get(f.name, c) if f.name in made else c for f, c in zip(part.schema, part.columns)], schema=part.schema)

    mixed = out.mapInArrow(run, out.schema)
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    return mixed.withColumn("copies", F.floor(F.col("rate") + chance).cast("long"))


def language_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, domain of the labelled documents: their language, and whether they are of high or low quality."""
    quality = labels.select(F.col("doc_id").alias("_id"), "quality").where("quality in (0, 1)")
    names = F.concat_ws(":", "lang", F.when(F.col("quality") == 1, "high").otherwise("low"))
    return quality.join(docs.select("doc_id", "lang").where("lang is not null"), F.col("_id") == F.col("doc_id")).select("doc_id", names.alias("domain"))


def balanced(domains: tuple[str, ...], low: float = 0.005) -> dict[str, float]:
    """Equal weights of languages, of which texts of low quality make up ``low``: less than rates above 0 everywhere can give,
    so that some documents' rates are held at 0."""
    return {d: low if d.endswith(":low") else 1 - low for d in domains}
