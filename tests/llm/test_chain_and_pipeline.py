"""The toxicity chain by brute force and on categories that depend on each other; the pipeline stage by stage against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrafolio.llm import common, mixing, pii, toxicity

SF = "/root/testdata/sf0.001"


def dependent(spark, n=900, seed=2):
    """a: some of many slurs; b: a again, marked by few other words of its own, so that most of what tells b is a."""
    rng = random.Random(seed)
    slurs = [f"slur{i}" for i in range(40)]
    rows = []
    for i in range(n):
        a = rng.random() < 0.4
        words = [f"plain{rng.randrange(200)}" for _ in range(30)] + (rng.sample(slurs, 2) if a else [])
        b = a if rng.random() < 0.97 else not a
        rows.append((i, " ".join(words + (["mark"] if b and rng.random() < 0.1 else [])), int(a), int(b)))
    return spark.createDataFrame(rows, "doc_id long, text string, a int, b int"), rows


def test_chain_equals_brute_force_and_its_link_carries_what_depends(spark):
    docs, rows = dependent(spark)
    model = toxicity.fit(docs.where("doc_id % 3 > 0"), docs.select("doc_id", "a", "b"), ("a", "b"))
    assert model.weights[1][1][0] > 0.2  # b reads a
    found = {r["doc_id"]: r for r in toxicity.predict(docs, model).collect()}
    clip = lambda x: min(8.0, max(-8.0, x))
    for i, text, _, _ in rows[:100]:
        odds = []
        for w, u, bias in model.weights:
            total = bias + sum(u[k] * odds[k] for k in range(len(odds)))
            for word, weight in toxicity.terms_of(text).items():
                total += weight * sum(w[model.features[f]] for f in toxicity.features_of(word, model.params.prefixes) if f in model.features)
            odds.append(clip(total))
        for c, o in zip(("a", "b"), odds):
            assert found[i][f"p_{c}"] == pytest.approx(1 / (1 + np.exp(-o)), abs=1e-9)
            assert found[i][f"is_{c}"] == (found[i][f"p_{c}"] >= 0.5)
    held = [(found[i]["is_b"], b) for i, _, _, b in rows if i % 3 == 0]
    assert np.mean([x == y for x, y in held]) > 0.9


def test_long_and_repeated_texts_of_the_chain(spark):
    docs, _ = dependent(spark, 200)
    odd = docs.select("doc_id", "text").union(spark.createDataFrame([(1000, "slur1 " * 40_000), (1001, None), (1001, None), (None, "é" * 60_000)], "doc_id long, text string"))
    model = toxicity.fit(docs, docs.select("doc_id", "a", "b"), ("a", "b"))
    assert toxicity.predict(odd, model).count() == 204


def plain_words(text, lower=True):
    text = "".join(c.lower() if "A" <= c <= "Z" and lower else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        text = text.replace(space, " ")
    return [w for w in text.split(" ") if w]


def windows_of(text):
    """Runs of letters, digits and everything beyond ASCII, A-Z in lower case."""
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            if word:
                out.append(word)
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def components(sets):
    """Smallest id of what links reach, links being a similarity of 0.8."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = find(i), find(j)
            if a != b and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_pipeline_against_plain_loops(spark):
    docs = common.table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    kept = {}
    for name, stage in stages.items():
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    # a language for every text with a letter, of those that are known
    first = {r["doc_id"]: r for r in common.table(spark, SF, "documents").collect()}
    lettered = {i for i, r in first.items() if any(map(str.isalpha, r["text"] or ""))}
    assert set(kept["language_id"]) <= lettered and len(kept["language_id"]) > 0.95 * len(lettered)
    # one of each group of near duplicates
    sets = {}
    for i, r in kept["language_id"].items():
        words = plain_words(r["text"])
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    of = components(sets)
    assert set(kept["ngram_jaccard_join"]) == {i for i in of if of[i] == i}
    # no window of a benchmark item
    windows = set()
    for r in common.table(spark, SF, "benchmark").collect():
        words = windows_of(r["text"])
        n = min(10, len(words))
        windows |= {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    hit = lambda words: any(tuple(words[k : k + n]) in windows for n in sizes for k in range(len(words) - n + 1))
    assert set(kept["benchmark_decontamination"]) == {i for i, r in kept["ngram_jaccard_join"].items() if not hit(windows_of(r["text"]))}
    # all documents, without a pattern's match, otherwise as they were
    assert set(kept["pii"]) == set(kept["benchmark_decontamination"])
    changed = 0
    for i, r in kept["pii"].items():
        old = kept["benchmark_decontamination"][i]
        assert pii.base_spans(r["text"]) == [] and {c: r[c] for c in ("lang", "source")} == {c: old[c] for c in ("lang", "source")}
        changed += r["text"] != old["text"]
        if r["text"] == old["text"]:
            assert pii.base_spans(old["text"]) == []
    assert changed
    # rates of 0 or more that reach their targets
    assert set(kept["mixing"]) == set(kept["pii"])
    rows = kept["mixing"].values()
    assert min(r["rate"] for r in rows) >= 0
    model = mixing.fit(spark.createDataFrame(list(kept["pii"].values()), "doc_id long, text string, lang string, source string, n_chars long"), mixing.language_quality(common.table(spark, SF, "documents").select("doc_id", "text", "lang"), common.table(spark, SF, "labels")))
    for r in rows:
        assert r["n_tokens"] == len(plain_words(r["text"])) and r["domain"] in model.domains
        assert r["reached"] == pytest.approx(r["target"], rel=0.05, abs=1.0)
    assert docs.where(F.col("copies") < F.floor("rate")).count() == 0
