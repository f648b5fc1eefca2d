"""Filter audit: brute force over all orders, the walk itself, and odd input."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from terrafolio.llm import audit

DOCS = "doc_id long, text string, lang string, part string, mask string, n long"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """Every order applied to every document, one filter after the other."""
    good = {d for d, q, t in labels if q == 1 and d is not None}
    toxic = {d for d, q, t in labels if t == 1 and d is not None}
    rows = []
    for d, text, lang in docs:
        x = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", x)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", x)) > 3 * len(x), "D": bool(re.search("[#$%&*|]", x))}
        fails["E"] = d is not None and any(e is not None and e < d and (y or "") == x for e, y, _ in docs)
        rows.append((lang or "", d, fails))
    found = {}
    for part in {p for p, _, _ in rows}:
        own = [(d, f) for p, d, f in rows if p == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [(d, x) for d, x in left if x[f]]
                failing = [x for _, x in own if x[f]]
                left = [(d, x) for d, x in left if not x[f]]
                shapley[f] += len(gone)
                found[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(x.values()) == 1 for x in failing), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (p, order, step), values in found.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return found


def audited(spark, docs, labels):
    d = spark.createDataFrame([(i, t, lang, "x", "y", 7) for i, t, lang in docs], DOCS)
    rows = audit.interactions(audit.document_cells(d, spark.createDataFrame(labels, LABELS)), "ABCDE").collect()
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in rows}
    assert len(found) == len(rows)
    return found


def test_equals_brute_force_on_odd_documents(spark):
    rng = random.Random(3)
    long = " ".join(f"w{i}" for i in range(210))
    texts = [None, "", " \n ", "UPPER", "a#b", long, long + " $", " ".join(["x"] * 300), long.upper(), "é" * 50_000, "  no   break"]
    docs = [(rng.choice([None, *range(20)]), rng.choice(texts), rng.choice([None, "", "en", "fr"])) for _ in range(120)]
    docs += [docs[0]] * 5
    labels = [(rng.choice([None, *range(20)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(25)]
    assert audited(spark, docs, labels) == brute(docs, labels)


def test_a_third_of_all_rows_are_one_text_or_one_id(spark):
    docs = [(i, "copy of one text", "en") for i in range(200)] + [(7, f"text {i}", "en") for i in range(200)] + [(None, f"text {i}", None) for i in range(200)]
    assert audited(spark, docs, [(7, 1, 1)]) == brute(docs, [(7, 1, 1)])


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    assert audited(spark, [(1, "x", "en")], []) == brute([(1, "x", "en")], [])


def test_the_walk_visits_every_order_by_single_swaps():
    for k in range(1, 6):
        orders = list(audit.transpositions(k))
        assert len({tuple(o) for o, _ in orders}) == len(orders) == np.prod(range(1, k + 1))
        for (a, _), (b, i) in itertools.pairwise(orders):
            assert a[:i] == b[:i] and a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1]


def test_other_filters_and_marks(spark):
    cells = spark.createDataFrame([("p", 3, 2, 1), ("p", 3, 1, 0), ("p", 0, 4, 1)], "part string, mask int, n long, n_odd long")
    rows = audit.interactions(cells, "XY", ["odd"]).collect()
    assert {(r["filter_order"], r["step"], r["kept"], r["removed"], r["redundant"], r["odd_lost"], r["shapley"]) for r in rows} == {("XY", 1, 4, 3, 0, 1, 3), ("XY", 2, 4, 0, 3, 0, 3), ("YX", 1, 4, 3, 0, 1, 3), ("YX", 2, 4, 0, 3, 0, 3)}
    with pytest.raises(ValueError):
        audit.interactions(cells, "ABCDEFGHI")
