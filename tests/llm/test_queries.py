"""The registered queries and the pipeline: columns, SQL on the smallest tables, and stages on odd input."""

import datetime
import math
import warnings

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrafolio.llm import common, langid, mixing, pii, quality, substring, toxicity
from terrafolio.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op2_quality": {"doc_id", "held_out", "score", "predicted"},
    "op3_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op4_ngram_jaccard": {"doc_id", "n_shingles", "component_id"},
    "op5_mixing": {"doc_id", "rate"},
    "op6_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op7_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op8_chat_format": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op9_nearest_neighbours": {"query_id", "rank", "vec_id", "score"},
    "op10_toxicity": {"doc_id", "toxic"},
    "op11_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op12_filter_audit": {"part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"},
    "op13_prefix_trie": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
}


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return str(x) if isinstance(x, (datetime.date, datetime.datetime)) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    frame = QUERIES[name](spark, SF)
    assert COLUMNS[name] <= set(frame.columns)
    rows = frame.collect()
    if "doc_id" in frame.columns:
        assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in common.table(spark, SF, "documents").select("doc_id").collect())
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "conversations", "pages", "labels"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        result = con.execute(ORACLES[name])
        names = [x[0] for x in result.description]
        assert sorted(names) == sorted(frame.columns)
        assert sorted((tuple(plain(r[c]) for c in names) for r in rows), key=str) == sorted((tuple(map(plain, r)) for r in result.fetchall()), key=str)


def test_held_out_follows_the_contract(spark):
    held = {r["doc_id"]: r["held_out"] for r in QUERIES["op1_language_id"](spark, SF).collect()}
    import zlib

    assert held == {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in held}


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id but words enough here", "en", "s", 5), (4, "é" * 20_000, "fr", "s", 1), (5, "call +1 555 123 4567 now", "en", None, 24), (5, "call +1 555 123 4567 now", "en", None, 24)]
    rows += [(10 + i, f"the same plain words again and again number {i % 3} for the test", "en", "s", 60) for i in range(9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_on_odd_input(spark, odd_docs):
    for docs in (odd_docs, odd_docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert set(docs.columns) <= set(out.columns), name
            assert out.count() <= docs.count()


def test_pipeline_equals_its_stages(spark):
    docs = common.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
    run = corpus_pipeline.run(spark, SF)
    assert run.columns == docs.columns
    assert sorted(r["doc_id"] for r in run.collect()) == sorted(r["doc_id"] for r in docs.collect())
    assert {r["doc_id"]: r["text"] for r in run.collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}


def test_language_scores_equal_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    model = langid.fit(docs)
    texts = [r["text"] or "" for r in docs.limit(40).collect()]
    found, scores = langid.predict(model, langid.scorer(model), texts)
    for text, lang, score in zip(texts, found, scores):
        total = np.zeros(len(model.languages))
        for w in langid.WORD.findall(text.lower()):
            if w in model.words:
                total += model.word_scores[model.words[w]]
                continue
            for n in range(len(model.ngrams), 0, -1):
                padded = f" {w} " if n > 1 else w
                known = [model.ngram_scores[model.ngrams[n - 1][padded[i : i + n]]] for i in range(len(padded) - n + 1) if padded[i : i + n] in model.ngrams[n - 1]]
                if known:
                    total += np.mean(known, axis=0)
                    break
        if any(map(str.isalpha, text)):
            p = 10.0 ** (total - total.max())
            assert lang == model.languages[int(total.argmax())] and score == pytest.approx(1 / p.sum())
        else:
            assert (lang, score) == ("und", 0.0)


def test_quality_votes_equal_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    labels = common.table(spark, SF, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs, labels)
    texts = [r["text"] or "" for r in docs.limit(70).collect()]
    latent = quality._latent(model, texts)
    for text, v, s in zip(texts, latent, quality.vote(model, latent)):
        own = np.zeros(model.projection.shape[1])
        for term, w in quality.term_counts(text).items():
            if term in model.terms:
                own += w * model.idf[model.terms[term]] * model.projection[model.terms[term]]
        own /= max(np.linalg.norm(own), 1e-12)
        assert v == pytest.approx(own)
        cosines = model.vectors @ own
        near = np.argsort(-cosines, kind="stable")[: model.params.neighbours]
        weights = np.maximum(cosines[near], 0) ** model.params.sharpness
        assert s == pytest.approx((weights * model.labels[near]).sum() / weights.sum(), abs=1e-6)


def test_toxicity_held_out(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    labels = common.table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", (1 - F.col("quality")).alias("low"), "toxic")
    seen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    found = toxicity.predict(docs, toxicity.fit(docs, labels.where(seen), ("low", "toxic"))).join(labels.where(~seen), "doc_id").collect()
    assert np.mean([r["is_low"] == bool(r["low"]) for r in found]) > 0.9
    assert np.mean([r["is_toxic"] == bool(r["toxic"]) for r in found]) > 0.88


def test_features_are_picked_without_the_fold(spark):
    # the word marks a category in one fold only: the choice for the others' sake has it, that fold's own hasn't
    rows = [(0, 1, ["here"]) for _ in range(60)] + [(k, 0, ["else"]) for k in range(5) for _ in range(60)] + [(k, 1, ["other"]) for k in range(1, 5) for _ in range(20)]
    terms = spark.createDataFrame(rows, "_fold int, c0 int, _terms array<string>")
    features, may = toxicity._chosen(terms, 1, toxicity.ToxicityParams(min_z=3.0))
    at = features.index("here")
    assert may[0, at] == 0 and may[1, at] == 1 and may[5, at] == 1


def test_toxicity_categories_of_any_name(spark):
    docs = common.table(spark, SF, "documents")
    labels = common.table(spark, SF, "labels").select("doc_id", F.col("quality").alias("fold"), F.col("toxic").alias("w"))
    assert {"p_fold", "is_w"} <= set(toxicity.predict(docs, toxicity.fit(docs, labels, ("fold", "w"))).columns)


def brute_rates(t, p, targets, inverse):
    """Least squared error over all sets of documents held at 0."""
    best, half = None, np.linalg.cholesky(inverse).T
    for held in range(1 << len(t)):
        free = [i for i in range(len(t)) if not held >> i & 1]
        a = (p[free] * t[free, None]).T
        rate = np.linalg.lstsq(half @ a, half @ targets)[0] if free else np.zeros(0)
        if (rate >= -1e-9).all():
            e = targets - a @ rate if free else targets
            best = min(x for x in (best, float(e @ inverse @ e)) if x is not None)
    return best


@pytest.mark.parametrize("targets", [(100.0, 5.0), (10.0, 200.0), (300.0, 1.0)])
def test_rates_equal_brute_force(spark, targets):
    t, p, targets = np.array([100.0, 80.0, 60.0, 120.0, 90.0]), np.array([[0.9, 0.1], [0.2, 0.8], [0.5, 0.5], [0.7, 0.3], [0.35, 0.65]]), np.array(targets)
    members = spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(t, p)], "n_tokens long, p array<double>")
    start, moves, reached = mixing.fit_rates(members, targets, mixing.MixingParams(tolerance=1e-9, stall=1e-9, rounds=2000))
    rates = mixing.rates(p, start, moves)
    assert rates.min() >= 0 and reached == pytest.approx((rates * t) @ p)
    inverse = np.linalg.pinv((p * t[:, None]).T @ p)
    error = targets - reached
    assert float(error @ inverse @ error) == pytest.approx(brute_rates(t, p, targets, inverse), abs=1e-4)


def test_rates_reach_targets_that_hold_most_documents_at_zero(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.5, 0.5, 0.1], 400)
    t = rng.integers(20, 200, 400).astype(float)
    wanted = np.where(p[:, 2] < 0.02, rng.uniform(0.2, 1, 400), 0.0)
    targets = (wanted * t) @ p
    members = spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(t, p)], "n_tokens long, p array<double>")
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        start, moves, reached = mixing.fit_rates(members, targets, mixing.MixingParams())
    rates = mixing.rates(p, start, moves)
    assert (rates == 0).sum() > 50 and rates.min() >= 0
    assert reached == pytest.approx((rates * t) @ p) and np.abs(reached - targets).max() <= 1e-5 * targets.sum()


def test_mixing_tells_what_it_reached(spark):
    rows = QUERIES["op5_mixing"](spark, "/root/testdata/sf0.01").collect()
    assert min(r["rate"] for r in rows) >= 0
    for r in rows:
        assert r["reached"] == pytest.approx(r["target"], rel=0.1)


def test_rates_that_run_out_of_rounds_say_so(spark):
    members = spark.createDataFrame([(100, [0.9, 0.1]), (100, [0.1, 0.9])], "n_tokens long, p array<double>")
    targets = np.array([300.0, 1.0])
    with pytest.warns(UserWarning, match="2 rounds"):
        _, _, reached = mixing.fit_rates(members, targets, mixing.MixingParams(tolerance=1e-12, stall=0.0, rounds=2))
    assert np.abs(reached - targets).max() > 1


def test_frequent_anchors_change_no_result(spark, monkeypatch):
    import test_operators as others

    rng = np.random.default_rng(0)
    monkeypatch.setattr(substring, "frequent_anchors", lambda docs, p: rng.integers(1, 5, 2 << p.counter_bits).astype(np.int32))
    for case in ((1, 6, 3, 30, 1 << 20), (3, 5, 4, 2, 500)):
        others.test_repeats_equal_brute_force(spark, *case)


def test_skip_links_add_recall(spark):
    # numbers that a pattern finds once and that come again without what the pattern needs
    texts = [f"call +1 (988) {i}-{i * 37 % 9000 + 1000} now. much later, again {i}-{i * 37 % 9000 + 1000} please" for i in range(200, 260)]
    model = pii.fit(common.table(spark, SF, "documents"))
    base = [pii.base_spans(t) for t in texts]
    with_links = sum(len(a) for a in pii.added_spans(model, texts, base)[0])
    alone = pii.PiiModel(model.unary, model.chain, np.zeros_like(model.skip), model.params)
    without = sum(len(a) for a in pii.added_spans(alone, texts, base)[0])
    assert with_links >= 50 and without == 0


def test_vectors_of_other_lengths_take_no_part(spark):
    from terrafolio.llm import ann

    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(1, 40)] + [(100, [1.0]), (101, [1.0, 2.0])]
    vectors = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert vectors.count() == 39
    assert ann.search(vectors, vectors.where("vec_id % 10 = 0"), ann.fit(vectors)).count() == 15


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://x"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError):
        common.checkpoint_dir(Session())


def test_extra_columns_of_clashing_names(spark):
    docs = common.table(spark, SF, "documents").limit(30).withColumns({c: F.lit(1) for c in ("uid", "shard", "text2", "items", "n_hit", "p", "score", "rate", "span", "kept")})
    from terrafolio.llm import decontam, ngram_join

    bench = common.table(spark, SF, "benchmark")
    assert decontam.contamination(docs, bench).count() == docs.count() == ngram_join.near_duplicates(docs).count() == substring.repeated_words(docs).count()
    assert decontam.contamination(docs, bench, decontam.DecontamParams(block_bytes=2000)).count() == docs.count()
    assert mixing.mix(docs, mixing.fit(docs, docs.select("doc_id", F.col("lang").alias("domain")))).count() == docs.count()
