"""Substring dedup by repeated-phrase automata.

A window of words is stood for by its anchor, the phrase in it whose hash is least; equal windows have equal anchors, so a
window whose anchor occurs once is unique. Runs of windows with a recurring anchor are compared as wholes, and window by
window where wholes differ, which confirms the recurring passages. Passages are dealt to the shards of documents that hold
some of their windows; each shard compiles its own Aho-Corasick automaton of them, of bounded size, and streams all its
documents through it to locate every occurrence, verbatim.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafolio.llm.common import Scratch, bytes_of, column_of, map_texts, slices, summed_counters
from terrafolio.llm.shingles import mix, powers, rolling, sliding_min, word_hashes

OTHER_BASE = 0xD6E8FEB86659FD93


@dataclass(frozen=True)
class SubstringParams:
    #: Words of a window that must not recur, and of the phrase in it that serves as its anchor.
    window: int = 50
    phrase: int = 8
    #: Windows that a passage is cut at.
    passage_windows: int = 128
    #: Bytes of document texts in a shard, about: what one automaton is streamed over, and what bounds its size.
    shard_bytes: int = 4 << 20
    batch_bytes: int = 1 << 20
    #: log2 of the counters that find frequent anchors, and how far above the mean a counter must be. Neither changes a result.
    counter_bits: int = 18
    frequent: float = 4.0

    @property
    def block(self) -> int:
        """Words of a pattern. Every window within a passage holds one of the passage's blocks that lie end to end."""
        return (self.window + 1) // 2


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, dtype=np.uint64).view(np.int64))


def _runs(part: pa.RecordBatch, p: SubstringParams) -> tuple[np.ndarray, ...] | None:
    """uid, anchor, start, size, whole (hash of the run's words) of each run of windows.

    A run in which a window occurs twice is listed twice, with another hash, since its anchor recurs within it.
    """
    parts = []
    uids = column_of(part, "uid").to_pylist()
    hashes, bounds = word_hashes(bytes_of(part), lower=False)
    if len(hashes) < p.window:
        return None
    # over all texts of the slice at once; windows that would reach into the next text are left out below
    windows = rolling(hashes, p.window)
    anchors = sliding_min(rolling(hashes, p.phrase), p.window - p.phrase + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes) * powers(OTHER_BASE, len(hashes)))])
    for uid, a, b in zip(uids, bounds[:-1], bounds[1:]):
        n = b - a - p.window + 1
        if n < 1:
            continue
        own = anchors[a : a + n]
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        parts.append((np.full(len(start), uid), own[start], start, np.diff(np.concatenate([start, [n]])), np.full(len(start), a)))
        ordered = np.sort(windows[a : a + n])
        if (ordered[1:] == ordered[:-1]).any():
            order = np.argsort(windows[a : a + n], kind="stable")
            equal = np.flatnonzero(windows[a + order[1:]] == windows[a + order[:-1]])
            again = np.unique(np.searchsorted(start, np.concatenate([order[equal], order[equal + 1]]), "right") - 1)
            parts.append((np.full(len(again), uid), own[start[again]], start[again], parts[-1][3][again], np.full(len(again), -1 - a)))
    if not parts:
        return None
    uid, anchor, start, size, base = (np.concatenate(x) for x in zip(*parts))
    twice = base < 0
    first = np.where(twice, -1 - base, base) + start
    whole = mix((sums[first + size + p.window - 1] - sums[first]) * powers(pow(OTHER_BASE, -1, 1 << 64), len(hashes))[first] + size.astype(np.uint64))
    whole[twice] ^= np.uint64(1)
    return uid, anchor, start, size, whole


def _bucket(x: np.ndarray, p: SubstringParams) -> np.ndarray:
    return (mix(x) >> np.uint64(64 - p.counter_bits)).astype(np.int64)


def frequent_anchors(docs: DataFrame, p: SubstringParams) -> np.ndarray:
    """By hash bucket of anchors, then of whole runs, the number of parts that its runs are dealt to: 1 unless it is far above the mean."""
    n = 1 << p.counter_bits

    def count(part):
        total = np.zeros(2 * n, dtype=np.int64)
        runs = _runs(part, p)
        if runs is not None:
            _, anchor, _, _, whole = runs
            total[:n] = np.bincount(_bucket(anchor, p), minlength=n)
            total[n:] = np.bincount(_bucket(anchor ^ whole, p), minlength=n)
        return total

    counts = summed_counters(docs.select("uid", "text"), 2 * n, count, p.batch_bytes)
    most = p.frequent * counts[:n].mean() + 1024
    return np.maximum(1, np.ceil(counts / most)).astype(np.int32)


def anchor_runs(docs: DataFrame, dealt, p: SubstringParams) -> DataFrame:
    """anchor, salt, parts, whole (hash of the run's words), uid, start, size of each run of windows.

    ``dealt`` is a broadcast of ``frequent_anchors``. Runs of a frequent anchor are dealt to ``parts`` by their words, and those
    of a frequent whole also by document.
    """

    def one(batch):
        done = [r for part in slices(iter([batch]), "text", p.batch_bytes) if (r := _runs(part, p)) is not None]
        if not done:
            return None
        uid, anchor, start, size, whole = (np.concatenate(x) for x in zip(*done))
        n = 1 << p.counter_bits
        parts, more = dealt.value[_bucket(anchor, p)], dealt.value[n + _bucket(anchor ^ whole, p)]
        salt = np.where(parts > 1, mix(whole).view(np.int64) % parts * (1 << 31) + mix(uid.view(np.uint64)).view(np.int64) % more, 0)
        return {"anchor": _signed(anchor), "salt": salt, "parts": parts, "whole": _signed(whole), "uid": uid, "start": pa.array(start, pa.int32()), "size": pa.array(size, pa.int32())}

    return map_texts(docs, "anchor long, salt long, parts int, whole long, uid long, start int, size int", one)


def recurring_runs(runs: DataFrame) -> DataFrame:
    """uid, start, size, again, open, key, parts of the ``runs`` whose anchor recurs, or is in a bucket of frequent ones.

    ``again``: another run is the same as a whole, so every window of it recurs; such runs share a key. ``open``: the run's
    windows must be told apart one by one, which one of those that are the same stands for, in each part that they are dealt to.
    """
    order = Window.partitionBy("anchor", "salt").orderBy("whole", "uid", "start")
    before, after = F.lag("whole").over(order), F.lead("whole").over(order)
    marked = runs.select("*", before.alias("before"), after.alias("after")).where("before is not null or after is not null or parts > 1")
    as_before = F.coalesce(F.col("before") == F.col("whole"), F.lit(False))
    again = as_before | F.coalesce(F.col("after") == F.col("whole"), F.lit(False))
    key = F.when(again, F.xxhash64("anchor", "whole")).otherwise(F.xxhash64("uid", "start", "anchor", "whole"))
    return marked.select("uid", "start", "size", again.alias("again"), (~as_before).alias("open"), key.alias("key"), "parts")


def _with_runs(docs: DataFrame, runs: DataFrame, *columns: str) -> DataFrame:
    """uid, text, runs of the documents that have some."""
    gathered = runs.groupBy("uid").agg(F.collect_list(F.struct(*columns)).alias("runs"))
    return docs.join(gathered.hint("shuffle_hash"), "uid")


def told_apart(docs: DataFrame, shared: DataFrame, p: SubstringParams, scratch: Scratch) -> DataFrame:
    """uid, start, key, first, of: each recurring window of the open runs that aren't recurring as a whole.

    ``of`` is the key of a run that holds an occurrence of the window, and ``first`` whether this one stands for the others, in
    each part that those of a frequent anchor are dealt to. One that is alone in its part recurs if other parts have it too.
    """

    def windows_of(batch):
        rows = []
        for part in slices(iter([batch]), "text", p.batch_bytes):
            hashes, bounds = word_hashes(bytes_of(part), lower=False)
            uids = column_of(part, "uid").to_pylist()
            for d, runs in enumerate(column_of(part, "runs").to_pylist()):
                own = hashes[bounds[d] : bounds[d + 1]]
                at = np.concatenate([np.arange(r["start"], r["start"] + r["size"]) for r in runs])
                sizes = [r["size"] for r in runs]
                once = np.unique(at, return_index=True)[1]  # a run in which a window recurs is listed twice
                key, again, parts = (np.repeat([r[c] for r in runs], sizes)[once] for c in ("key", "again", "parts"))
                at = at[once]
                salt = np.where(parts > 1, 1 + (uids[d] & 0x7FFFFFFF) % parts, 0)
                rows.append((np.full(len(at), uids[d]), at, rolling(own, p.window)[at], rolling(own, p.window, OTHER_BASE)[at], again, key, salt))
        if not rows:
            return None
        uid, start, h1, h2, again, key, salt = (np.concatenate(x) for x in zip(*rows))
        return {"uid": uid, "start": pa.array(start, pa.int32()), "h1": _signed(h1), "h2": _signed(h2), "again": again, "key": key, "salt": pa.array(salt, pa.int32())}

    opened = map_texts(_with_runs(docs, shared.where("open"), "start", "size", "again", "key", "parts"), "uid long, start int, h1 long, h2 long, again boolean, key long, salt int", windows_of)
    order = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc("again"), "uid", "start")
    seen = opened.select("uid", "start", "again", "key", "salt", "h1", "h2", F.lag("start").over(order).isNull().alias("first"), F.lead("start").over(order).isNotNull().alias("more"), F.first("key").over(order).alias("of"))
    stands = F.col("first") & (F.col("salt") > 0)
    hashes = (F.when(stands, F.col(h)).alias(h) for h in ("h1", "h2"))
    columns = ["uid", "start", "key", "first", "of"]
    sure = ~F.col("again") & (~F.col("first") | F.col("more"))
    kept = scratch.keep(seen.where(sure | stands).select(*columns, "again", "more", "salt", *hashes))
    elsewhere = F.count("*").over(Window.partitionBy("h1", "h2")) > 1
    alone = kept.where(stands).withColumn("elsewhere", elsewhere).where(~F.col("again") & ~F.col("more") & F.col("elsewhere"))
    return kept.where(sure).select(*columns).union(scratch.keep(alone.select(*columns)))


def passages(docs: DataFrame, shared: DataFrame, apart: DataFrame, p: SubstringParams) -> DataFrame:
    """keys, shift, words (as text) of passages in which every window recurs, and that hold all windows of their keys.

    Runs that follow each other in a document are one passage, of ``passage_windows`` windows or little more. ``shift`` is where
    the first block begins: blocks lie at multiples of their length in the document that a passage is taken from, so that
    neighbouring passages have the same blocks where they overlap.
    """
    whole = shared.where("open and again").select("uid", "key", "start", "size")
    single = apart.where("first").select("uid", "key", "start", F.lit(1).alias("size"))

    def cut(batch):
        found: list[tuple[list[int], int, bytes]] = []
        for part in slices(iter([batch]), "text", p.batch_bytes):
            for content, runs in zip(bytes_of(part), column_of(part, "runs").to_pylist()):
                words = content.split()
                begin, end, keys = 0, -1, set()
                for start, stop, key in [*sorted((r["start"], r["start"] + r["size"], r["key"]) for r in runs), (1 << 40, 0, 0)]:
                    if start > end or end - begin >= p.passage_windows:
                        if keys:
                            found.append((sorted(keys), -begin % p.block, b" ".join(words[begin : end + p.window - 1])))
                        begin, end, keys = start, stop, set()
                    end = max(end, stop)
                    keys.add(key)
        return {"keys": [f[0] for f in found], "shift": [f[1] for f in found], "words": [f[2] for f in found]} if found else None

    return map_texts(_with_runs(docs, whole.union(single), "key", "start", "size"), "keys array<long>, shift int, words binary", cut)


def located(texts: list[list[bytes]], known: list[tuple[int, list[bytes]]], p: SubstringParams) -> list[np.ndarray]:
    """For each text, a mask of its words that lie in a window's length or more of a passage of ``known`` (shift, words)."""
    import ahocorasick

    masks = [np.zeros(len(t), dtype=bool) for t in texts]
    places: dict[str, list[tuple[int, int]]] = {}
    for n, (shift, words) in enumerate(known):
        for at in range(shift, len(words) - p.block + 1, p.block):
            places.setdefault(b" ".join(words[at : at + min(p.phrase, p.block)]).decode("latin-1"), []).append((n, at))
    if not places:
        return masks
    automaton = ahocorasick.Automaton()
    for phrase, where in places.items():
        automaton.add_word(f" {phrase} ", (len(phrase), where))
    automaton.make_automaton()
    reach = p.window - p.block
    for words, mask in zip(texts, masks):
        if len(words) < p.window:
            continue
        text = f" {b' '.join(words).decode('latin-1')} "
        ends: list[int] | None = None
        for end, (length, where) in automaton.iter(text):
            if ends is None:
                ends = np.cumsum([len(w) + 1 for w in words]).tolist()
            at = bisect_right(ends, end - length - 1)
            # the windows that hold this block lie in this stretch; those beyond hold other blocks, which find them
            low, high = max(0, at - reach), min(len(words), at + p.window)
            for n, offset in where:
                passage = known[n][1]
                a, b = at, offset
                while a > low and b > 0 and words[a - 1] == passage[b - 1]:
                    a, b = a - 1, b - 1
                stop, to, last = at, offset, min(high, at + len(passage) - offset)
                while stop < last and words[stop] == passage[to]:
                    stop, to = stop + 1, to + 1
                if stop - a >= p.window and stop >= at + p.block:
                    mask[a:stop] = True
                    if mask[low:high].all():
                        break
    return masks


def repeated_words(docs: DataFrame, p: SubstringParams = SubstringParams()) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of every row of ``docs``.

    A word is removed if it lies in a window of ``window`` words ``[^\\x20\\x09-\\x0D]+`` whose sequence also starts anywhere
    else, in the same document or another; windows are judged on the input. Null, empty and shorter texts lose nothing.
    Each row counts as a document, whatever its doc_id, so rows that repeat a long enough text lose all of it. Other columns are
    ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    # ids may be null or repeat: inside, a document goes by a hash of its id and text
    docs = docs.select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("uid"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = spark.sparkContext.broadcast(frequent_anchors(docs, p))
    shared = scratch.keep(recurring_runs(anchor_runs(docs, dealt, p)))
    scratch.release()
    apart = told_apart(docs, shared, p, scratch)
    scratch.release()
    found = scratch.keep(passages(docs, shared, apart, p).withColumn("passage", F.xxhash64("words", "shift")))
    scratch.release()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // p.shard_bytes))
    shard = lambda: F.pmod("uid", F.lit(shards)).cast("int")
    wanted = shared.where("again").select(shard().alias("shard"), "key").union(apart.select(shard().alias("shard"), F.col("of").alias("key"))).distinct()
    wanted = wanted.join(found.select("passage", F.explode("keys").alias("key")), "key").select("shard", "passage").distinct()
    dealt = wanted.join(found.select("passage", "shift", "words"), "passage").select("shard", "shift", "words")

    def locate(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        texts = [(t or b"").split() for t in left.column("text").cast(pa.binary()).to_pylist()]
        known = sorted(set(zip(right.column("words").to_pylist(), right.column("shift").to_pylist())))
        masks = located(texts, [(shift, words.split()) for words, shift in known], p)
        kept = [b" ".join(compress(words, (~mask).tolist()) if mask.any() else words) for words, mask in zip(texts, masks)]
        return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array([int(m.sum()) for m in masks], pa.int64()), "kept": pa.array(kept, pa.binary())})

    schema = f"doc_id {kind}, n_words long, n_removed long, kept binary"
    by_shard = docs.select(shard().alias("shard"), "doc_id", "text")
    return by_shard.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(locate, schema)

