"""Toxicity categories by a classifier chain: each category's linear model also reads the probabilities of those before it.

While fitting, those probabilities are out-of-fold predictions, so that a later model learns how far to trust them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafolio.llm.common import Scratch, WordVectors, bounded_sample, column_of, map_texts, sampled_texts, texts_of

WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]+")


@dataclass(frozen=True)
class ToxicityParams:
    #: Documents that the chain is fitted on, by whether the last category marks them, at most: the labelled sample's bound.
    docs_per_label: int = 4000
    #: A feature is kept if it is in at least so many of the documents that are fitted on, and marks a category there with at
    #: least this z-score; ``features`` bounds the model's size.
    min_docs: int = 5
    min_z: float = 5.0
    features: int = 1500
    prefixes: tuple[int, ...] = (3, 4, 5)
    folds: int = 5
    ridge: float = 1e-3
    steps: int = 120
    cached: int = 200_000


@dataclass(frozen=True)
class ToxicityModel:
    categories: tuple[str, ...]
    features: dict[str, int]
    #: By category: weights of the features, of the earlier categories' log odds, and the intercept.
    weights: tuple[tuple[np.ndarray, np.ndarray, float], ...]
    params: ToxicityParams


def terms_of(text: str) -> dict[str, int]:
    """A text's distinct words, and, as terms that begin with ``#``, tenths of its tokens that are upper case, marks or repeats."""
    tokens = TOKEN.findall(text)
    terms = dict.fromkeys(WORD.findall(text.lower()), 1)
    n = max(1, len(tokens))
    looks = {"upper": sum(t.isupper() and len(t) > 1 for t in tokens), "marks": sum(not t[0].isalnum() for t in tokens), "repeats": sum(map(eq, tokens, tokens[1:]))}
    return terms | {f"#{k}{10 * v // n}": 1 for k, v in looks.items()}


def features_of(term: str, prefixes: tuple[int, ...]) -> list[str]:
    return [term] if term[0] == "#" else [term, *(f"{term[:n]}*" for n in prefixes if len(term) > n)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Rows:
    """Sparse rows: for each, the features it has."""

    def __init__(self, rows: list[np.ndarray], width: int) -> None:
        self.n, self.width = len(rows), width
        self.at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.of = np.concatenate(rows) if rows else np.zeros(0, np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, w[self.of], self.n)

    def back(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, e[self.at], self.width)


def _logistic(rows: _Rows, extra: np.ndarray, y: np.ndarray, use: np.ndarray, may: np.ndarray, p: ToxicityParams) -> tuple[np.ndarray, np.ndarray, float]:
    """Ridge logistic regression by Adam over the rows of ``use`` and the features of ``may``, both classes weighing the same."""
    width, k = rows.width, extra.shape[1]
    theta, m, v = (np.zeros(width + k + 1) for _ in range(3))
    weight = use / np.where(y > 0, max(1.0, (use * (y > 0)).sum()), max(1.0, (use * (y == 0)).sum()))
    for step in range(1, p.steps + 1):
        z = rows.dot(theta[:width]) + extra @ theta[width : width + k] + theta[-1]
        e = (_sigmoid(z) - y) * weight
        g = np.concatenate([rows.back(e) * may, extra.T @ e, [e.sum()]])
        g[:-1] += p.ridge * theta[:-1]
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        theta -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return theta[:width], theta[width : width + k], float(theta[-1])


def _chosen(terms: DataFrame, n: int, p: ToxicityParams) -> tuple[list[str], np.ndarray]:
    """Features that mark a category, and by fold which of them do in the rows outside it; last, which do in all rows.

    ``terms`` has _fold, c0 .. and _terms. Documents are counted by feature, fold and category in one aggregation; what a fold
    holds is taken from the totals, so that no choice of features has seen the rows that are predicted with it. At most
    ``features`` a fold reach the driver.
    """
    marks = [f"c{j}" for j in range(n)]
    by_word = terms.select("_fold", *marks, F.explode("_terms").alias("_w")).groupBy("_w", "_fold").agg(F.count("*").alias("_n"), *(F.sum(c).alias(c) for c in marks))
    shorter = (F.when((F.length("_w") > k) & ~F.startswith("_w", F.lit("#")), F.concat(F.substring("_w", 1, k), F.lit("*"))) for k in p.prefixes)
    by_feature = by_word.select(F.explode(F.array("_w", *shorter)).alias("_f"), "_fold", "_n", *marks).where("_f is not null")
    within = lambda x, k: F.sum(F.when(F.col("_fold") == k, F.col(x)).otherwise(0)) if k < p.folds else F.lit(0)
    counted = by_feature.groupBy("_f").agg(*((F.sum(x) - within(x, k)).alias(f"{x}_{k}") for x in ("_n", *marks) for k in range(p.folds + 1)))
    sizes = terms.groupBy("_fold").agg(F.count("*").alias("_n"), *(F.sum(c).alias(c) for c in marks)).collect()  # a row a fold
    scores = []
    for k in range(p.folds + 1):
        rows = [r for r in sizes if r["_fold"] != k]
        total = sum(r["_n"] for r in rows)
        z = [F.lit(0.0)]
        for c in marks:
            share = sum(r[c] for r in rows) / max(1, total)
            z.append(F.abs(F.col(f"{c}_{k}") - F.col(f"_n_{k}") * share) / F.sqrt(F.col(f"_n_{k}") * F.lit(max(1e-9, share * (1 - share)))))
        scores.append(F.struct(F.lit(k).alias("k"), F.when(F.col(f"_n_{k}") >= p.min_docs, F.greatest(*z)).otherwise(0.0).alias("z")))
    ranked = counted.select("_f", F.explode(F.array(*scores)).alias("s")).select("_f", "s.k", "s.z").where(F.col("z") >= p.min_z)
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("z"), "_f"))
    best = [(r["_f"], r["k"]) for r in ranked.withColumn("r", place).where(F.col("r") <= p.features).collect()]
    features = sorted({f for f, _ in best})
    at = {f: i for i, f in enumerate(features)}
    may = np.zeros((p.folds + 1, max(1, len(features))))
    for f, k in best:
        may[k, at[f]] = 1
    return features, may


def fit(docs: DataFrame, labelled: DataFrame, categories: tuple[str, ...], params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """A chain over ``categories``, columns of ``labelled`` (doc_id, 0 or 1 in each) in the order of the chain.

    Rows with a null category or text are left out; of a doc_id that repeats, the largest marks and the least text count. A
    category without both classes in the sample gets a constant model. Categories may have any names.
    """
    p, scratch, n = params, Scratch(docs.sparkSession), len(categories)
    marks = [f"c{j}" for j in range(n)]
    named = labelled.select(F.col("doc_id"), *(F.col(f"`{c}`").alias(m) for c, m in zip(categories, marks)))
    labels = named.na.drop().groupBy("doc_id").agg(*(F.max(m).cast("int").alias(m) for m in marks))
    of = lambda mark: bounded_sample(labels.where(F.col(marks[-1]) == mark), "doc_id", p.docs_per_label)
    sample = scratch.keep(of(1).union(of(0)))

    def one(batch):
        made = {m: column_of(batch, m) for m in marks}
        return made | {"_key": column_of(batch, "doc_id").cast("string"), "_terms": [sorted(terms_of(t)) for t in texts_of(batch)]}

    terms = map_texts(sampled_texts(docs, sample), f"{', '.join(f'{m} int' for m in marks)}, _key string, _terms array<string>", one)
    terms = scratch.keep(terms.withColumn("_fold", (F.crc32(F.col("_key").cast("binary")) % p.folds).cast("int")))
    features, may = _chosen(terms, n, p)
    shared = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(features)})

    def encode(batch):
        known = shared.value.get
        out = [[k for w in ws for f in features_of(w, p.prefixes) if (k := known(f, -1)) >= 0] for ws in column_of(batch, "_terms").to_pylist()]
        return {c: column_of(batch, c) for c in (*marks, "_fold", "_key")} | {"_at": out}

    rows = map_texts(terms, f"{', '.join(f'{m} int' for m in marks)}, _fold int, _key string, _at array<int>", encode, text="_key").collect()
    scratch.drop(terms, sample)
    rows.sort(key=lambda r: r["_key"])
    matrix = _Rows([np.array(r["_at"], dtype=np.int64) for r in rows], max(1, len(features)))
    fold = np.array([r["_fold"] for r in rows])
    earlier, weights = np.zeros((len(rows), 0)), []
    for j, m in enumerate(marks):
        y = np.array([r[m] for r in rows], dtype=np.float64)
        if not len(rows) or y.min() == y.max():
            weights.append((np.zeros(matrix.width), np.zeros(j), 10.0 if len(rows) and y[0] else -10.0))
            out_of_fold = np.full(len(rows), weights[-1][2])
        else:
            weights.append(_logistic(matrix, earlier, y, np.ones(len(rows)), may[p.folds], p))
            out_of_fold = np.zeros(len(rows))
            for k in np.unique(fold) if j < n - 1 else ():
                w, u, b = _logistic(matrix, earlier, y, (fold != k) * 1.0, may[k], p)
                out_of_fold = np.where(fold == k, matrix.dot(w) + earlier @ u + b, out_of_fold)
        earlier = np.column_stack([earlier, np.clip(out_of_fold, -8, 8)])
    return ToxicityModel(tuple(categories), {f: i for i, f in enumerate(features)}, tuple(weights), p)


def scorer(model: ToxicityModel) -> WordVectors:
    """Each distinct word adds one vector: the weights of its features in each category's model."""
    table = np.stack([w for w, _, _ in model.weights], axis=1)

    def unseen(words: list[str]) -> np.ndarray:
        known, prefixes = model.features.get, model.params.prefixes
        found = [[k for f in features_of(w, prefixes) if (k := known(f, -1)) >= 0] for w in words]
        at = np.repeat(np.arange(len(words)), [len(x) for x in found])
        of = np.array([k for x in found for k in x], dtype=np.int64)
        return np.stack([np.bincount(at, table[of, k], len(words)) for k in range(table.shape[1])], axis=1)

    return WordVectors({}, np.zeros((0, table.shape[1])), unseen, model.params.cached)


def chain(model: ToxicityModel, totals: np.ndarray) -> np.ndarray:
    """Probabilities by category, each model reading the log odds of those before it."""
    odds = np.zeros((len(totals), 0))
    for k, (_, u, b) in enumerate(model.weights):
        odds = np.column_stack([odds, np.clip(totals[:, k] + odds @ u + b, -8, 8)])
    return _sigmoid(odds)


def predict(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, then p_<category> and is_<category> for each category of every row, in one pass without a shuffle.

    A null text counts as empty, and an empty text gets the chain's intercepts. Repeated rows give repeated results; other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = model.categories

    def one(batch, vectors):
        found = chain(shared.value, vectors.sums([terms_of(t) for t in texts_of(batch)]))
        made = {"doc_id": column_of(batch, "doc_id")}
        for k, c in enumerate(names):
            made |= {f"p_{c}": found[:, k], f"is_{c}": found[:, k] >= threshold}
        return made

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), f"doc_id {kind}, " + ", ".join(f"`p_{c}` double, `is_{c}` boolean" for c in names), one, setup=lambda: scorer(shared.value))
