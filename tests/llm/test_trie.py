"""Prefix trie: brute force over whole prefixes, with blocks of any size, and odd input."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from terrafolio.llm import trie

TURNS = "conv_id long, turn long, role string, text string, depth string, digest long, n string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "own", 1, "own") for r in rows], TURNS).repartition(parts)


def brute(rows, rebuild):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
        convs = {c: convs.get(c - c % 5, [])[: h[c]] + turns[h[c] :] for c, turns in convs.items()}
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1].encode()) if p else 0
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(convs[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children[p], leaves[p], saved[p], ends(p)) for p, own in members.items())


def found(df):
    return sorted(tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect())


def odd_rows():
    rng = random.Random(5)
    rows = []
    for c in [None, *range(60), 1000, 1003]:
        for turn in range(rng.randrange(11)):
            rows.append((c, rng.choice([None, turn, turn, 1]), rng.choice([None, "", "user", "assistant"]), rng.choice([None, "", "é", "a b", "\n"])))
    return rows + rows[5:9] + [(70, t, "user", "é" * 30_000) for t in range(3)]


@pytest.mark.parametrize("rebuild, block", [(True, 256), (True, 3), (False, 2)])
def test_equals_brute_force_on_odd_conversations(spark, rebuild, block):
    rows = odd_rows()
    assert found(trie.prefix_trie(frame(spark, rows), trie.RebuildParams() if rebuild else None, block)) == brute(rows, rebuild)


def test_one_conversation_of_a_third_of_all_rows(spark):
    """It spans partitions and blocks, has a copy, and others share its beginning."""
    rows = [(c, t, "user", f"{t % 7}") for c in (0, 6) for t in range(150)] + [(c, t, "user", f"{t % 7}") for c in range(10, 30) for t in range(c)]
    assert found(trie.prefix_trie(frame(spark, rows), None, 16)) == brute(rows, False)
    assert found(trie.prefix_trie(frame(spark, rows), trie.RebuildParams(), 16)) == brute(rows, True)


def test_many_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_BYTES", 100)
    rows = [(c, t, "user", "same") for c in range(400) for t in range(2)]
    assert found(trie.prefix_trie(frame(spark, rows), None)) == brute(rows, False)


def test_empty_table_and_rows_without_conversation(spark):
    assert found(trie.prefix_trie(frame(spark, []), trie.RebuildParams())) == []
    assert found(trie.prefix_trie(frame(spark, [(None, 1, "user", "x")]), trie.RebuildParams())) == []


def test_turnless_conversations_end_at_the_root(spark):
    rows = [(c, 0, "user", "x") for c in range(1, 5)]  # the family's first is absent, h cuts what they have
    assert found(trie.prefix_trie(frame(spark, rows), trie.RebuildParams())) == brute(rows, True)
