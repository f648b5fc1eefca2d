"""Callers' columns, small targets, many domains and labels, unsettled messages."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafolio.llm import common, decontam, langid, mixing, ngram_join, pii

CLASHING = ["_u", "_v", "_n", "_of", "_id", "slice", "sums", "n_words", "items", "spans", "score", "lang_pred", "k", "at", "digest", "settled"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{'all' if i % 4 else 'some'} words of document {i} are plain, call +1 555 010 00{i % 10}{i % 10} or not", "en", "s", 50, *(f"{c}-{i}" for c in CLASHING)) for i in range(40)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *(f"{c} string" for c in CLASHING)]))


def unchanged(df):
    for r in df.select("doc_id", *CLASHING).collect():
        assert [r[c] for c in CLASHING] == [f"{c}-{r['doc_id']}" for c in CLASHING]
    return df.count()


def test_callers_columns_keep_their_values(spark, docs):
    items = spark.createDataFrame([(1, "some words of document 8 are plain, call +1 555 010 0088"), (2, "no such words")], "item_id long, text string")
    for block_bytes in (1 << 20, 20):
        left = decontam.decontaminate(docs, items, decontam.DecontamParams(block_bytes=block_bytes))
        assert left.columns == docs.columns and unchanged(left) == 39
    assert unchanged(langid.keep(docs, langid.fit(docs))) == 40
    assert unchanged(pii.redact(docs, pii.fit(docs))) == 40
    assert unchanged(ngram_join.representatives(docs)) > 0
    mixed = mixing.mix(docs, mixing.fit(docs, docs.select("doc_id", F.col("source").alias("domain"))))
    assert unchanged(mixed) == 40


def test_small_targets_are_reached_too(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.4, 0.4, 0.05], 500)
    t = rng.integers(20, 200, 500).astype(float)
    rates = rng.uniform(0.1, 1, 500) * (p[:, 2] < np.quantile(p[:, 2], 0.75))
    targets = (rates * t) @ p
    assert targets[2] < 2e-4 * targets.sum()  # a tolerance of the sum of all targets would not see it
    members = spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(t, p)], "n_tokens long, p array<double>")
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        start, moves, reached = mixing.fit_rates(members, targets, mixing.MixingParams())
    assert reached == pytest.approx((mixing.rates(p, start, moves) * t) @ p)
    assert (np.abs(reached - targets) <= 1e-5 * targets).all()


def test_three_hundred_domains(spark):
    k = 300
    members = spark.range(900).select(F.lit(10).cast("long").alias("n_tokens"), F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == F.col("id") % k, 0.9).otherwise(0.1 / (k - 1))).alias("p"))
    targets = np.full(k, 12.0)
    _, _, reached = mixing.fit_rates(members, targets, mixing.MixingParams())
    assert reached == pytest.approx(targets, rel=1e-5)


def test_many_labels_share_the_bound(spark):
    rows = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.col("id") % 5_000).alias("lang"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    found = common.labelled_sample(rows, "doc_id", "lang", 100, most=6_000).groupBy("lang").count().collect()
    assert len(found) == 5_000 and {r["count"] for r in found} == {1}
    with pytest.raises(ValueError, match="5000 labels"):
        common.labelled_sample(rows, "doc_id", "lang", 100, most=4_999)


def test_unsettled_messages_are_told(spark):
    # a number that lacks its prefix, between repeated words, under a model whose links contradict each other
    text = " ".join(["+1 555 123 4567 x 5551234567 y", "5551234567 x +1 555 123 4567"] * 4)
    docs = spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "doc_id long, text string")
    model = pii.fit(docs)
    assert [r["settled"] for r in pii.find(docs, model).orderBy("doc_id").collect()] == [True] * 3
    from dataclasses import replace

    hasty = replace(model, params=replace(model.params, most_rounds=1, tolerance=1e-12))
    assert [r["settled"] for r in pii.find(docs, hasty).orderBy("doc_id").collect()] == [False, True, True]
