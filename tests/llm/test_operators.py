"""The training-data operators on small fixtures: brute force, round trips, held-out accuracy, and odd input."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafolio.llm import ann, chat, components, decontam, langid, mixing, ngram_join, pii, quality, shingles, substring, toxicity
from terrafolio.llm.common import Scratch, table

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, label int, toxic int"


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty, white, very long and repeated texts, and columns whose names operators use themselves."""
    rows = [
        (1, None, None, None, None, None, None),
        (2, "", "en", "s", 0, 0, 0),
        (3, " \n\t ", "en", "s", 4, 1, 1),
        (None, "the same words here", "en", None, 1, None, 0),
        (4, "the same words here and there", "en", "s", 1, 1, 0),
        (4, "the same words here and there", "en", "s", 1, 1, 0),
        (5, "é" * 50_000, "fr", "s", 1, 0, 1),
        (6, "word " * 30_000, "en", "s", 1, 0, 0),
        (7, "1234 5678 !!! 90", None, "s", 1, 1, 0),
        (8, "\u0000 a b ퟿", "de", "s", 1, 1, 1),
    ]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


def words_fixture(spark, seed, n, vocabulary=40, most=80, copies=0.5):
    """Documents that copy, cut and edit each other."""
    rng = random.Random(seed)
    docs = [[f"W{rng.randrange(vocabulary)}" for _ in range(rng.randrange(most))] for _ in range(n)]
    for i in range(1, n):
        if rng.random() < copies:
            words = list(docs[rng.randrange(i)])
            for _ in range(rng.randrange(3)):
                if words:
                    words[rng.randrange(len(words))] = f"W{rng.randrange(vocabulary)}"
            docs[i] = words if rng.random() < 0.5 else docs[i][: rng.randrange(9)] + words
    rows = [(i, rng.choice([" ", "  ", "\n"]).join(w).replace("W", rng.choice("wW"))) for i, w in enumerate(docs)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_language_held_out(documents):
    train, held = documents.where("doc_id % 4 <> 2"), documents.where("doc_id % 4 = 2")
    found = langid.identify(held, langid.fit(train)).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_unseen_words_fall_back_to_shorter_ngrams():
    model = langid.LangIdModel(("a", "b"), {}, np.zeros((0, 2)), ({"x": 0, "y": 1}, {"xy": 2}), np.array([[-1.0, -3.0], [-3.0, -1.0], [-2.0, -1.0]]))
    assert langid.unseen_vectors(model, ["xy", "x", "q"]).tolist() == [[-2.0, -1.0], [-1.0, -3.0], [0.0, 0.0]]


def test_language_of_odd_texts(odd, empty):
    model = langid.fit(odd)
    found = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert len(langid.identify(odd, model).collect()) == odd.count()
    assert [found[k]["lang_pred"] for k in (1, 2, 3, 7)] == ["und"] * 4
    assert langid.identify(odd, langid.fit(empty)).select("lang_pred").distinct().collect()[0][0] == "und"
    assert langid.keep(odd, model).columns == odd.columns
    assert langid.identify(empty, model).count() == 0


def test_quality_held_out(spark, documents):
    labels = table(spark, SF, "labels").select("doc_id", F.col("quality").alias("label"))
    found = quality.score(documents, quality.fit(documents, labels.where("doc_id % 3 <> 1"))).join(labels.where("doc_id % 3 = 1"), "doc_id").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["label"] == 1) for r in found]) > 0.85


def test_quality_of_odd_texts(odd, empty):
    labelled = odd.select("doc_id", "label")
    found = quality.score(odd, quality.fit(odd, labelled)).collect()
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
    assert {r["score"] for r in quality.score(odd, quality.fit(empty, labelled.where("false"))).collect()} == {0.5}


def test_vote_weighs_by_cosine():
    model = quality.QualityModel({}, np.zeros(0), np.zeros((0, 2)), np.array([[1.0, 0.0], [0.0, 1.0]]), np.array([1.0, 0.0]), quality.QualityParams(neighbours=2, sharpness=1.0))
    assert quality.vote(model, np.array([[0.8, 0.6], [0.6, 0.8]])) == pytest.approx([0.8 / 1.4, 0.6 / 1.4])


def fold(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))


def brute_contamination(docs, items, window):
    at = {}
    for item, text in items:
        w = fold(text)
        for j in range(max(1, len(w) - window + 1) if w else 0):
            at.setdefault(tuple(w[j : j + window]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, found = fold(text), set(), set()
        for n in {len(k) for k in at}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in at:
                    hit |= set(range(j, j + n))
                    found |= at[tuple(w[j : j + n])]
        out[doc] = (len(w), len(hit), sorted(found), bool(hit))
    return out


@pytest.mark.parametrize(("window", "shard"), [(10, 2 << 20), (3, 200)])
def test_contamination_equals_brute_force(spark, window, shard):
    rows, docs = words_fixture(spark, 5, 120, vocabulary=12)
    items = [(i, t) for i, t in rows[:12]] + [(100, "w1 W2"), (101, None), (102, " . "), (103, rows[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    params = decontam.DecontamParams(window=window, shard_bytes=shard)
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in decontam.contamination(docs, bench, params).collect()}
    expected = brute_contamination(rows, items, window)
    assert found == expected
    clean = {r["doc_id"] for r in decontam.decontaminate(docs, bench, params).collect()}
    assert clean == {k for k, v in expected.items() if not v[3]}


def test_blocks_of_items_give_what_one_block_gives(spark):
    rows, docs = words_fixture(spark, 6, 40, vocabulary=12)
    bench = spark.createDataFrame(rows[:9], "item_id long, text string")
    whole, parts = (sorted(map(tuple, decontam.contamination(docs, bench, decontam.DecontamParams(window=4, block_bytes=b)).collect())) for b in (1 << 20, 300))
    assert whole == parts


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x a b c d e y"), (2, "b c d")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d e f")], "item_id long, text string")
    found = decontam.matches(docs, bench, decontam.DecontamParams(window=3)).collect()
    assert sorted(map(tuple, found)) == [(1, "7", 0, 1, 5), (2, "7", 1, 0, 3)]


def test_contamination_of_odd_texts(spark, odd, empty):
    bench = spark.createDataFrame([(1, "the same words here"), (2, None), (None, "word word")], "item_id long, text string")
    found = decontam.contamination(odd, bench).collect()
    assert len(found) == odd.count()
    assert Counter(r["contaminated"] for r in found) == {True: 3, False: 7}
    assert decontam.decontaminate(empty, bench).count() == 0
    assert decontam.contamination(odd, bench.where("false")).where("contaminated").count() == 0


def brute_components(rows, size, percent):
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        sets[doc] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1) if w else 0)}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("seed", "size", "percent", "vocabulary"), [(1, 2, 60, 30), (2, 4, 85, 400), (3, 1, 50, 12)])
def test_components_equal_brute_force(spark, seed, size, percent, vocabulary):
    rows, docs = words_fixture(spark, seed, 90, vocabulary=vocabulary, copies=0.7)
    found = ngram_join.near_duplicates(docs, ngram_join.JoinParams(size=size, percent=percent)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows, size, percent)


def test_near_duplicates_of_odd_texts(odd, empty):
    found = ngram_join.near_duplicates(odd)
    assert found.count() == odd.count()
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {k: k for k in (1, 2, 3, None, 4, 5, 6, 7, 8)}
    kept = ngram_join.representatives(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert ngram_join.near_duplicates(empty).count() == 0


def test_sketches_bound_what_sets_have_in_common():
    rng = np.random.default_rng(0)
    for _ in range(200):
        every = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = (np.unique(rng.choice(every, rng.integers(1, 400))) for _ in range(2))
        assert ngram_join._most_common(ngram_join._sketch(a), ngram_join._sketch(b)) >= len(np.intersect1d(a, b))


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, {a}), root.setdefault(b, {b})
        if root[a] is not root[b]:
            root[a] |= root[b]
            for x in root[b]:
                root[x] = root[a]
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: min(root[x]) for x in linked}


def brute_repeats(rows, window):
    count = Counter()
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for _, w in split:
        count.update(tuple(w[j : j + window]) for j in range(len(w) - window + 1))
    out = []
    for d, w in split:
        gone = set()
        for j in range(len(w) - window + 1):
            if count[tuple(w[j : j + window])] > 1:
                gone |= set(range(j, j + window))
        out.append((d, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "window", "phrase", "vocabulary", "shard"), [(1, 6, 3, 30, 1 << 20), (2, 9, 2, 3, 2000), (3, 5, 4, 2, 500), (4, 20, 8, 60, 1 << 20)])
def test_repeats_equal_brute_force(spark, seed, window, phrase, vocabulary, shard):
    rows, docs = words_fixture(spark, seed, 80, vocabulary=vocabulary)
    found = substring.repeated_words(docs, substring.SubstringParams(window=window, phrase=phrase, shard_bytes=shard)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in found), key=str) == brute_repeats(rows, window)


def test_repeats_of_odd_texts(odd, empty):
    params = substring.SubstringParams(window=4, phrase=2)
    found = substring.repeated_words(odd, params).collect()
    expected = brute_repeats([(r["doc_id"], r["text"]) for r in odd.collect()], 4)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in found), key=str) == expected
    assert substring.repeated_words(empty, params).count() == 0


def test_word_hashes_follow_words():
    texts = [b"", b" Ab  ab\x0bAB ", "é ab".encode(), b"\x00 x", b"ab"]
    hashes, bounds = shingles.word_hashes(texts, lower=True)
    assert np.diff(bounds).tolist() == [len(t.split()) for t in texts]
    assert len({int(hashes[i]) for i in (0, 1, 2, 4, 7)}) == 1
    exact, _ = shingles.word_hashes(texts, lower=False)
    assert len({int(x) for x in exact[:3]}) == 3


def brute_spans(t):
    spans = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    spans += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            spans.append((2, m.start(), m.end()))
    return spans + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(0)
    for alphabet in ("a1.@2+- 0(é", "12345 -", "1.2@a"):
        for _ in range(8000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
            assert pii.base_spans(t) == brute_spans(t)


def test_linked_tokens_get_one_label(documents):
    model = pii.fit(documents)
    texts = ["call +1 (988) 555-2485 now. much later, again 555-2485 please", "the year 2021 had 365 days"]
    base = [pii.base_spans(t) for t in texts]
    added, _ = pii.added_spans(model, texts, base)
    assert [(pii.KINDS[k], texts[0][a:b]) for k, a, b in added[0]] == [("phone", "555-2485")] and added[1] == []
    assert pii.replaced(texts[0], base[0] + added[0]) == "call <phone> now. much later, again <phone> please"


def test_pii_of_odd_texts(odd, empty):
    model = pii.fit(odd)
    assert pii.find(odd, model).count() == odd.count()
    out = pii.redact(odd, model)
    assert out.schema == odd.schema and out.count() == odd.count()
    assert pii.find(empty, pii.fit(empty)).count() == 0


def test_mixing_reaches_its_targets(spark, documents):
    labels = documents.select("doc_id", F.col("lang").alias("domain"))
    weights = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
    model = mixing.fit(documents, labels, mixing.MixingParams(weights=weights))
    members = mixing.memberships(documents, model)
    out = mixing.mix(documents, model).select("doc_id", "rate", "n_tokens").collect()
    rate = {r["doc_id"]: r["rate"] for r in out}
    total = sum(r["n_tokens"] for r in out)
    reached = sum(rate[r["doc_id"]] * r["n_tokens"] * np.array(r["p"]) for r in members.collect())
    targets = np.array([weights[d] for d in model.domains]) * 0.5 * total
    assert np.abs(reached - targets).max() <= 2e-3 * targets.sum()
    assert min(rate.values()) >= 0


def test_projection_keeps_rates_nonnegative(spark):
    members = spark.createDataFrame([(100, [0.9, 0.1]), (100, [0.1, 0.9]), (100, [0.5, 0.5])], "n_tokens long, p array<double>")
    targets = np.array([100.0, 5.0])
    start, moves, _ = mixing.fit_rates(members, targets, mixing.MixingParams(rounds=200, tolerance=1e-6))
    p = np.array([[0.9, 0.1], [0.1, 0.9], [0.5, 0.5]])
    r = mixing.rates(p, start, moves)
    assert r.min() >= 0 and (r == 0).any()


def test_mixing_of_odd_texts(odd, empty):
    labels = odd.select("doc_id", F.col("lang").alias("domain"))
    out = mixing.mix(odd, mixing.fit(odd, labels))
    assert out.count() == odd.count() and set(odd.columns) < set(out.columns)
    assert mixing.mix(empty, mixing.fit(empty, labels.where("false"))).count() == 0


def test_chat_round_trip(spark):
    quoted = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", quoted, 1), (-7, 1, "assistant", quoted, 1), (None, 0, None, None, 1), (1, None, "a\n<b", "é<turn>\\b\\l", 1), (1, 2, "assistant", "", 1), (1, 2, "assistant", "", 1), (1, 3, "assistant", "ünï", 1)]
    rows += [(2, i, "user" if i % 2 else "assistant", "x" * (i % 5) + "<" * (i % 3), 1) for i in range(400)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    expected = {}
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        expected.setdefault(conv, []).append((role or "", text or ""))
    for r in chat.format_conversations(turns).collect():
        assert chat.parse(r["formatted"]) == expected[r["conv_id"]] and r["n_turns"] == len(expected[r["conv_id"]])
        assert chat.learned_text(r["formatted"], r["loss_spans"]) == "".join(t for role, t in expected[r["conv_id"]] if role == "assistant")
    assert chat.format_conversations(turns.where("false")).count() == 0


def test_nearest_neighbours_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 16))
    x[:300] = x[0]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(5001, None), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [1.0] + [float("inf")] * 15), (5005, [None] * 16), (5006, [])]
    vectors = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert vectors.count() == 1500
    found = ann.search(vectors, vectors.where("vec_id % 50 = 0"), ann.fit(vectors, ann.AnnParams(lists=16, list_rows=200, query_rows=7)))
    by = {}
    for r in found.collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    unit = ann.unit(x)
    hit = 0
    for q in range(0, 1500, 50):
        c = (unit * unit[q]).sum(axis=1)
        c[q] = -2
        best = np.lexsort((np.arange(1500), -c))[:5]
        got = sorted(by[q])
        assert [g[0] for g in got] == [1, 2, 3, 4, 5] and all(g[2] == pytest.approx(c[g[1]], abs=1e-12) for g in got)
        hit += len({g[1] for g in got} & set(best))
    assert hit / 150 >= 0.9
    assert [g[1] for g in sorted(by[0])] == [1, 2, 3, 4, 5]


def test_nearest_neighbours_of_few_or_none(spark):
    few = ann.usable(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>"))
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(few, few.where("vec_id = 0"), ann.fit(few)).collect()] == [(0, 1, 1)]
    none = few.where("false")
    assert ann.search(none, none, ann.fit(none)).count() == 0


def test_toxicity_catches_marked_words(spark, documents):
    labels = table(spark, SF, "labels").select("doc_id", (1 - F.col("quality")).alias("low"), "toxic")
    found = toxicity.predict(documents, toxicity.fit(documents, labels, ("low", "toxic"))).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    assert np.mean([r["is_toxic"] == bool(r["toxic"]) for r in found]) > 0.95


def test_toxicity_chain_reads_earlier_categories():
    none = np.zeros(1)
    model = toxicity.ToxicityModel(("a", "b"), {"x": 0}, ((np.array([2.0]), np.zeros(0), 0.0), (none, np.array([3.0]), -1.0)), toxicity.ToxicityParams())
    p = toxicity.chain(model, np.array([[2.0, 0.0], [-2.0, 0.0]]))
    assert p[:, 1] == pytest.approx([1 / (1 + np.exp(-5.0)), 1 / (1 + np.exp(7.0))])


def test_toxicity_of_odd_texts(odd, empty):
    labels = odd.select("doc_id", F.col("label").alias("low"), "toxic")
    model = toxicity.fit(odd, labels, ("low", "toxic"))
    assert toxicity.predict(odd, model).count() == odd.count()
    assert toxicity.predict(odd, toxicity.fit(empty, labels.where("false"), ("low", "toxic"))).where("is_toxic").count() == 0

