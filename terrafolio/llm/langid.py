"""Language identification by word-first backoff.

Each word of a text adds one vector of scores by language. A known word's vector is its log frequency in each language; an
unseen word falls back to its character n-grams, the longest order of which any is known, then to shorter ones.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafolio.llm.common import WordVectors, column_of, labelled_sample, map_texts, shared_out, slices, small_batches, texts_of

WORD = re.compile(r"[^\W\d_]+")
#: What a text without letters is predicted as.
UNDETERMINED = "und"


@dataclass(frozen=True)
class LangIdParams:
    #: Documents of each language that the model is fitted on, at most: the bound of the labelled sample.
    docs_per_language: int = 4000
    #: Most frequent words of each language that the model keeps.
    words_per_language: int = 30_000
    #: Documents and words of all languages together, at most: with many languages, each gets fewer.
    most_docs: int = 200_000
    most_words: int = 2_000_000
    min_count: int = 2
    longest_ngram: int = 4
    #: log10 frequency of what a language hasn't been seen with.
    penalty: float = -7.0


@dataclass(frozen=True)
class LangIdModel:
    languages: tuple[str, ...]
    words: dict[str, int]
    word_scores: np.ndarray
    #: By order, from 1: n-gram -> row of ``ngram_scores``.
    ngrams: tuple[dict[str, int], ...]
    ngram_scores: np.ndarray


def _frequencies(counts: list[Counter], penalty: float) -> tuple[dict[str, int], np.ndarray]:
    rows = {x: i for i, x in enumerate(sorted(set().union(*counts)))}
    scores = np.full((len(rows), len(counts)), penalty)
    for k, count in enumerate(counts):
        at = np.fromiter(map(rows.__getitem__, count), dtype=np.int64, count=len(count))
        times = np.fromiter(count.values(), dtype=np.float64, count=len(count))
        scores[at, k] = np.maximum(penalty, np.log10(times / times.sum()))
    return rows, scores


def fit(docs: DataFrame, params: LangIdParams = LangIdParams()) -> LangIdModel:
    """A model from the (doc_id, text, lang) rows with a language. Without such rows it has no language.

    Fitted on a bounded sample of each language (``docs_per_language``); the word counts are summed by Spark and only the
    most frequent words of each language reach the driver.
    """
    docs = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = labelled_sample(docs.select("doc_id", "lang"), "doc_id", "lang", params.docs_per_language, params.most_docs)

    def count(batch):
        found: dict[tuple[str, str], int] = Counter()
        for lang, text in zip(column_of(batch, "lang").to_pylist(), texts_of(batch)):
            for w, n in Counter(WORD.findall(text.lower())).items():
                if w.isalpha():
                    found[lang, w] += n
        return {"lang": [k[0] for k in found], "word": [k[1] for k in found], "n": list(found.values())}

    chosen = docs.join(F.broadcast(sample), ["doc_id", "lang"])
    words = map_texts(chosen, "lang string, word string, n long", count).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words_each = shared_out(params.most_words, params.words_per_language, sample.select("lang").distinct().count())
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    kept = words.where(F.col("n") >= params.min_count).withColumn("r", F.row_number().over(order)).where(F.col("r") <= words_each)
    by_language: dict[str, Counter] = {}
    for row in kept.select("lang", "word", "n").collect():
        by_language.setdefault(row["lang"], Counter())[row["word"]] = row["n"]
    languages = tuple(sorted(by_language))
    counts = [by_language[x] for x in languages]
    rows, scores = _frequencies(counts, params.penalty) if languages else ({}, np.zeros((0, 0)))
    orders, parts, base = [], [], 0
    for n in range(1, params.longest_ngram + 1):
        grams = [Counter() for _ in languages]
        for count_, gram in zip(counts, grams):
            for word, times in count_.items():
                padded = f" {word} "
                for i in range(len(padded) - n + 1):
                    gram[padded[i : i + n]] += times
        known, part = _frequencies(grams, params.penalty) if languages else ({}, np.zeros((0, 0)))
        orders.append({x: i + base for x, i in known.items()})
        parts.append(part)
        base += len(known)
    return LangIdModel(languages, rows, scores, tuple(orders), np.concatenate(parts) if parts else np.zeros((0, 0)))


def unseen_vectors(model: LangIdModel, words: list[str]) -> np.ndarray:
    """Mean scores of each word's known n-grams of the longest order of which any is known; 0 if no character is known."""
    out = np.zeros((len(words), len(model.languages)))
    left = np.arange(len(words))
    for n in range(len(model.ngrams), 0, -1):
        known = model.ngrams[n - 1].get
        if n > 1:
            found = [[k for i in range(len(w) + 3 - n) if (k := known(p[i : i + n], -1)) >= 0] for w in map(words.__getitem__, left) for p in (f" {w} ",)]
        else:
            found = [[k for c in words[i] if (k := known(c, -1)) >= 0] for i in left]
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        full = np.flatnonzero(sizes)
        if len(full):
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            flat = np.array([k for x in found for k in x], dtype=np.int64)
            out[left[full]] = np.add.reduceat(model.ngram_scores[flat], starts) / sizes[full, None]
        left = left[sizes == 0]
        if not len(left):
            break
    return out


def scorer(model: LangIdModel) -> WordVectors:
    return WordVectors(model.words, model.word_scores, lambda words: unseen_vectors(model, words))


def predict(model: LangIdModel, vectors: WordVectors, texts: list[str]) -> tuple[list[str], list[float]]:
    counts = [Counter(WORD.findall(t.lower())) for t in texts]
    if not model.languages:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    totals = vectors.sums(counts) * np.log(10)
    best = totals.argmax(axis=1)
    score = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
    lettered = [any(w.isalpha() for w in c) or any(map(str.isalpha, "".join(c))) for c in counts]
    return [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)], [float(x) if ok else 0.0 for x, ok in zip(score, lettered)]


def identify(docs: DataFrame, model: LangIdModel) -> DataFrame:
    """doc_id, lang_pred, score of every row, in one pass without a shuffle.

    A null or empty text, or one without a letter, gets ``und`` and score 0, as does every text under a model without
    languages. Ties go to the language that sorts first. Repeated rows give repeated results; other columns are ignored.
    The score is the posterior of the predicted language under equal priors.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch, vectors):
        languages, scores = predict(shared.value, vectors, texts_of(batch))
        return {"doc_id": column_of(batch, "doc_id"), "lang_pred": languages, "score": scores}

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), f"doc_id {kind}, lang_pred string, score double", score, setup=lambda: scorer(shared.value))


def keep(docs: DataFrame, model: LangIdModel, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is determined with a score of ``least_score`` or more.

    Null and empty texts, and those without a letter, go, as do all under a model without languages; a tie of languages has half of the
    posterior at most. Repeated rows stay or go together, and an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        vectors = scorer(shared.value)
        for part in slices(batches, "text"):
            languages, scores = predict(shared.value, vectors, texts_of(part))
            yield part.filter(pa.array([x != UNDETERMINED and s >= least_score for x, s in zip(languages, scores)], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
