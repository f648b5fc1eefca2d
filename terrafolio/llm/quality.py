"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafolio.llm.common import column_of, labelled_sample, map_texts, sampled_texts, texts_of

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]+|\n")


@dataclass(frozen=True)
class QualityParams:
    #: Labelled documents of each class that vote, at most: the bound of the labelled sample, and of what is broadcast.
    docs_per_label: int = 1500
    terms: int = 3000
    rank: int = 48
    neighbours: int = 15
    #: Power of the cosine that weighs a neighbour's label.
    sharpness: float = 8.0
    #: Documents whose cosines are computed at once.
    block: int = 256


@dataclass(frozen=True)
class QualityModel:
    terms: dict[str, int]
    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    params: QualityParams


def term_counts(text: str) -> dict[str, float]:
    """Weights of a text's terms: its words and runs of marks, and how its tokens look (terms that begin with a NUL)."""
    tokens = TOKEN.findall(text)
    counts = Counter(tokens)
    found: dict[str, float] = Counter()
    upper = title = marks = digits = words = chars = 0
    for x, n in counts.items():
        if x[0].isalpha():
            words += n
            chars += n * len(x)
            if len(x) > 1 and x.isupper():
                upper += n
            elif x[0].isupper():
                title += n
            found[x.lower()] += n
        elif x != "\n":
            if x[0].isdigit():
                digits += n
            else:
                marks += n
                found[x[:4]] += n
    total = max(1, len(tokens))
    weights = {x: 1 + np.log(n) for x, n in found.items()}
    repeats = sum(map(eq, tokens, tokens[1:]))
    looks = {"upper": upper, "title": title, "marks": marks, "digits": digits, "repeats": repeats, "lines": counts.get("\n", 0), "distinct": len(counts)}
    weights |= {f"\0{k}": 10 * v / total for k, v in looks.items()}
    weights["\0length"] = chars / max(1, words) / 2
    return weights


def _latent(model: QualityModel, texts: list[str]) -> np.ndarray:
    """Unit vectors of the texts: the known terms of some texts at a time are summed in one step."""
    out = np.zeros((len(texts), model.projection.shape[1]))
    known, step = model.terms.get, max(1, model.params.block // 4)
    for start in range(0, len(texts), step):
        found = [[(k, w) for x, w in term_counts(t).items() if (k := known(x, -1)) >= 0] for t in texts[start : start + step]]
        sizes = np.array([len(f) for f in found], dtype=np.int64)
        full = np.flatnonzero(sizes)
        if len(full):
            at = np.fromiter((k for f in found for k, _ in f), dtype=np.int64, count=int(sizes.sum()))
            weights = np.fromiter((w for f in found for _, w in f), dtype=np.float64, count=len(at)) * model.idf[at]
            out[start + full] = np.add.reduceat(model.projection[at] * weights[:, None], np.concatenate([[0], np.cumsum(sizes[full])[:-1]]))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, labelled: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    """A model from ``docs`` (doc_id, text) and ``labelled`` (doc_id, label 0 or 1).

    Fitted on ``docs_per_label`` documents of each label at most; other labels and nulls are ignored.
    Without labelled texts, the model has no vectors and scores every text 0.5.
    """
    labelled = labelled.select("doc_id", "label").where("label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    sample = labelled_sample(labelled, "doc_id", "label", params.docs_per_label)
    chosen = sampled_texts(docs, sample)

    def count(batch):
        found = [term_counts(t) for t in texts_of(batch)]
        return {"doc_id": column_of(batch, "doc_id").cast("string"), "label": column_of(batch, "label"), "terms": [list(x) for x in found], "weights": [list(map(float, x.values())) for x in found]}

    rows = map_texts(chosen, "doc_id string, label int, terms array<string>, weights array<double>", count)
    in_docs: dict[str, int] = Counter()
    kept = []
    for row in rows.collect():
        in_docs.update(x for x in row["terms"])
        kept.append((row["doc_id"], row["label"], row["terms"], np.array(row["weights"], dtype=np.float32)))
    kept.sort(key=lambda x: x[:2])
    n = len(kept)
    chosen_terms = sorted(sorted(in_docs, key=lambda x: (x[0] != "\0", -in_docs[x], x))[: params.terms])
    terms = {x: i for i, x in enumerate(chosen_terms)}
    idf = np.array([1.0 if x[0] == "\0" else np.log((1 + n) / (1 + in_docs[x])) + 0.1 for x in chosen_terms])
    matrix = np.zeros((n, len(terms)), dtype=np.float32)
    for i, (_, _, names, weights) in enumerate(kept):
        at = [terms.get(x, -1) for x in names]
        for k, w in zip(at, weights):
            if k >= 0:
                matrix[i, k] = w * idf[k]
    labels = np.array([x[1] for x in kept], dtype=np.float64)
    kept = []
    if not n:
        return QualityModel({}, np.zeros(0), np.zeros((0, 1)), np.zeros((0, 1)), labels, params)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    projection = _right_vectors(matrix, min(params.rank, *matrix.shape))
    vectors = matrix.astype(np.float64) @ projection
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return QualityModel(terms, idf, projection, vectors, labels, params)


def _right_vectors(matrix: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors, by subspace iteration from a fixed start."""
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((matrix.shape[1], min(rank + 8, *matrix.shape))))[0]
    for _ in range(6):
        basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
    left, _, right = np.linalg.svd(matrix @ basis, full_matrices=False)
    return (basis @ right.T)[:, :rank].astype(np.float64)


def vote(model: QualityModel, vectors: np.ndarray) -> np.ndarray:
    """Weighted share of label 1 among each vector's nearest labelled ones, from exact cosines in blocks."""
    p = model.params
    out = np.full(len(vectors), 0.5)
    k = min(p.neighbours, len(model.vectors))
    if not k:
        return out
    prior = np.array([(model.labels == 0).mean(), (model.labels == 1).mean()])
    for start in range(0, len(vectors), p.block):
        block = vectors[start : start + p.block]
        cosines = block @ model.vectors.T
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weights = np.maximum(np.take_along_axis(cosines, near, 1), 0) ** p.sharpness
        ones = (weights * model.labels[near]).sum(axis=1)
        total = weights.sum(axis=1)
        out[start : start + p.block] = (ones + 1e-9 * prior[1]) / (total + 1e-9)
    return np.clip(out, 0, 1)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) of every row, in one pass without a shuffle.

    A null text counts as empty; an empty text is scored by the labels near its (looks-only) vector like any other.
    Repeated rows give repeated results; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(batch):
        return {"doc_id": column_of(batch, "doc_id"), "score": vote(shared.value, _latent(shared.value, texts_of(batch)))}

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), f"doc_id {kind}, score double", one)
