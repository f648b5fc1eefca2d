"""Benchmark decontamination by suffix arrays of the training texts.

Documents are dealt with in shards of bounded bytes. A shard's suffix array holds, sorted, every suffix of its texts that
begins with a word of some test; no other suffix shares a word's length with one. Every test suffix from which a whole window
starts is binary-searched in the array, word by word; the range that it gets is its occurrences. Each occurrence that can't
be continued to the left is then followed to the right, which gives the longest verbatim matches and their places. Hit
words, items and contaminated documents all follow from these matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafolio.llm.common import Scratch, bytes_of, column_of, free, map_texts, slices, small_batches

#: A-Z becomes a-z; what isn't 0-9, a-z or beyond ASCII becomes a space.
FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


@dataclass(frozen=True)
class DecontamParams:
    #: Consecutive words of an item that make a window; an item of fewer words is one window.
    window: int = 10
    #: Bytes of item texts in a block. One block at a time is on the driver and in the tasks, for a pass over the documents.
    block_bytes: int = 8 << 20
    #: Bytes of document texts in a shard, that is in one suffix array.
    shard_bytes: int = 2 << 20
    #: Occurrences that are followed at once.
    pairs: int = 1 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of the nonzero numbers of ``ids``, sorted by the ``depth`` numbers from there on; a zero precedes all others.

    By prefix doubling, in which only suffixes that are still tied are sorted again. ``ids`` ends with ``2 * depth`` zeros.
    """
    at = np.flatnonzero(ids)
    tied = order = at[np.argsort(ids[at], kind="stable")]
    order, slots, key = order.copy(), np.arange(len(at)), ids[tied].astype(np.int64)
    rank = np.zeros(len(ids), dtype=np.int64)
    span = 1
    while len(tied):
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[tied] = np.maximum.accumulate(np.where(first, slots, 0)) + 1
        more = ~(first & np.concatenate([first[1:], [True]]))
        tied, slots = tied[more], slots[more]
        if span >= depth:
            break
        key = rank[tied] * (len(at) + 1) + rank[tied + span]
        sort = np.argsort(key, kind="stable")
        tied, key = tied[sort], key[sort]
        order[slots] = tied
        span *= 2
    return order


def _bound(values: np.ndarray, order: np.ndarray, depth: int, want: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
    """In each range [low, high) of the array, by binary search: where the words at ``depth`` reach, or pass, those wanted."""
    low, high = low.copy(), high.copy()
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        found = values[order[middle] + depth]
        before = found <= want[open_] if right else found < want[open_]
        low[open_] = np.where(before, middle + 1, low[open_])
        high[open_] = np.where(before, high[open_], middle)
    return low


class Tests:
    """A block of benchmark items: their words as numbers side by side, and the suffixes that windows start from."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.known: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        number = {x: i for i, x in enumerate(self.names)}
        texts, of = [], []
        for item, text in items:
            words = words_of(text)
            if words:
                texts.append(np.fromiter((self.known.setdefault(w, len(self.known) + 1) for w in words), dtype=np.int32, count=len(words)))
                of.append(number[item])
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.longest = int(sizes.max(initial=0))
        self.begin = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])[:-1].astype(np.int64)  # a zero before and after each text
        self.item = np.array(of, dtype=np.int32)
        self.ids = np.zeros(int((sizes + 1).sum()) + 1 + window, dtype=np.int32)
        for begin, text in zip(self.begin, texts):
            self.ids[begin : begin + len(text)] = text
        starts = np.maximum(1, sizes - window + 1)
        self.at = np.repeat(self.begin - np.cumsum(starts) + starts, starts) + np.arange(starts.sum())
        self.least = np.repeat(np.minimum(window, sizes), starts).astype(np.int32)
        # equal windows are searched for once; ``same`` lists the suffixes of each
        head = self.ids[self.at[:, None] + np.arange(window)]
        head[np.arange(window)[None, :] >= self.least[:, None]] = 0
        keys = np.ascontiguousarray(head).view(f"V{4 * window}").ravel() if len(head) else np.zeros(0, f"V{4 * window}")
        _, self.one, inverse = np.unique(keys, return_index=True, return_inverse=True)
        self.same = np.argsort(inverse, kind="stable")
        self.bounds = np.searchsorted(inverse[self.same], np.arange(len(self.one) + 1))

    def occurrences(self, ids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By distinct window, its range [low, high) of the suffix array ``order`` of ``ids``."""
        start, least = self.at[self.one], self.least[self.one]
        low, high = np.zeros(len(start), dtype=np.int64), np.full(len(start), len(order), dtype=np.int64)
        for depth in range(int(least.max(initial=0))):
            live = np.flatnonzero((low < high) & (least > depth))
            want = self.ids[start[live] + depth]
            a, b = low[live], high[live]
            low[live] = _bound(ids, order, depth, want, a, b, right=False)
            high[live] = _bound(ids, order, depth, want, low[live], b, right=True)
        return low, high

    def matches(self, texts: list[list[bytes]], pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each text starts in the shard, and of each longest match its place in the shard, its place here and its words.

        A match has a window's length at least; the words before it and after it differ, or one of the texts ends there.
        """
        get = self.known.get
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])
        ids = np.zeros(int(starts[-1]) + 2 * self.longest + 2, dtype=np.int32)
        for start, words in zip(starts, texts):
            ids[start : start + len(words)] = [get(w, 0) for w in words]
        none = [np.zeros(0, dtype=np.int64)] * 3
        if not len(self.one):
            return starts, *none
        order = suffix_array(ids, self.longest)
        low, high = self.occurrences(ids, order)
        found = np.flatnonzero(low < high)
        width = (high - low)[found] * np.diff(self.bounds)[found]
        out = [none]
        for part in np.split(found, np.flatnonzero(np.diff(np.cumsum(width) // pairs)) + 1):
            places, suffixes = (high - low)[part], np.diff(self.bounds)[part]
            n = places * suffixes
            window = np.repeat(part, n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            across = np.repeat(suffixes, n)
            place = order[low[window] + k // across].astype(np.int64)
            test = self.at[self.same[self.bounds[window] + k % across]]
            # those that a word more on the left continues belong to the match that begins there
            begins = (self.ids[test - 1] == 0) | (self.ids[test - 1] != ids[place - 1])
            place, test, size = place[begins], test[begins], self.least[self.one[window[begins]]].astype(np.int64)
            live = np.arange(len(place))
            while len(live):
                word = self.ids[test[live] + size[live]]
                live = live[(word != 0) & (word == ids[place[live] + size[live]])]
                size[live] += 1
            out.append([place, test, size])
        return starts, *(np.concatenate(x) for x in zip(*out))

    def items_of(self, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the items that places lie in, and how many words precede them there."""
        text = np.searchsorted(self.begin, test, "right") - 1
        return self.item[text], test - self.begin[text]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")


def _n_blocks(items: DataFrame, params: DecontamParams) -> int:
    return max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // params.block_bytes))


def _block(items: DataFrame, k: int, n: int, params: DecontamParams):
    """Block ``k`` of ``n``, broadcast."""
    part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
    rows = sorted((r["item_id"], r["text"].encode()) for r in part.collect())
    return items.sparkSession.sparkContext.broadcast(Tests(rows, params.window))


def _found(batch: pa.RecordBatch, tests: Tests, params: DecontamParams) -> Iterator[tuple[np.ndarray, list[tuple[int, int]], list[str]]]:
    """By text: its number of words, the stretches of hit words, and the sorted names of the items that have windows in it."""
    for part in slices(iter([batch]), "text", params.shard_bytes):
        texts = [words_of(t) for t in bytes_of(part)]
        starts, place, test, size = tests.matches(texts, params.pairs)
        change = np.zeros(int(starts[-1]) + 1, dtype=np.int64)
        np.add.at(change, place, 1)
        np.add.at(change, place + size, -1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(change) > 0, [0]]).astype(np.int8))).reshape(-1, 2)
        of = np.searchsorted(starts, edges[:, 0], "right") - 1
        cut = np.searchsorted(of, np.arange(len(texts) + 1))
        held = np.unique(np.stack([np.searchsorted(starts, place, "right") - 1, tests.items_of(test)[0]], axis=1), axis=0)
        items = np.searchsorted(held[:, 0], np.arange(len(texts) + 1))
        for d, words in enumerate(texts):
            yield len(words), (edges[cut[d] : cut[d + 1]] - starts[d]).tolist(), sorted(tests.names[i] for i in held[items[d] : items[d + 1], 1])


#: What tells rows apart: equal rows get equal results, so it doesn't matter that they share it.
ROW = ("_u", "_v")


def _row_hashes() -> tuple[Column, Column]:
    return F.xxhash64(F.col("doc_id").cast("string"), "text"), F.xxhash64(F.lit(1), "text", F.col("doc_id").cast("string"))


def _with_row(docs: DataFrame) -> DataFrame:
    return docs.withColumns(dict(zip(ROW, _row_hashes())))


def _hits_by_block(docs: DataFrame, items: DataFrame, n: int, params: DecontamParams) -> DataFrame:
    """One row for each distinct (doc_id, text) with hits: its row hashes, spans of hit words, items; a pass for each block."""
    scratch, parts = Scratch(docs.sparkSession), []
    keyed = _with_row(docs.select("doc_id", "text")).select(*ROW, "text")
    for k in range(n):
        block = _block(items, k, n, params)

        def one(batch, block=block):
            rows = [(i, s, x) for i, (_, s, x) in enumerate(_found(batch, block.value, params)) if s]
            if not rows:
                return None
            at = pa.array([r[0] for r in rows], pa.int64())
            return {ROW[0]: column_of(batch, ROW[0]).take(at), ROW[1]: column_of(batch, ROW[1]).take(at), "spans": [r[1] for r in rows], "items": [r[2] for r in rows]}

        hit = map_texts(keyed, f"{ROW[0]} long, {ROW[1]} long, spans array<array<long>>, items array<string>", one)
        parts.append(scratch.keep(hit.dropDuplicates(list(ROW))))
        block.destroy()
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    merged = every.groupBy(*ROW).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # spans of one block don't touch; those of several may overlap: count each word once
    ordered = F.array_sort("spans")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    add = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s[1] - F.greatest(s[0], acc["end"]))).alias("n"), F.greatest(acc["end"], s[1]).alias("end"))
    return merged.select(*ROW, F.aggregate(ordered, start, add, lambda acc: acc["n"]).alias("n_hit"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, params: DecontamParams = DecontamParams()) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as sorted strings), contaminated for every row of ``docs``.

    A word is hit if it lies in a match of a window's length or more. Null and empty texts have no words and aren't
    contaminated; items with a null id, or without words, have no windows; repeated rows give repeated results; other
    columns are ignored. One pass over the documents without a shuffle; with more than ``block_bytes`` of items, a pass for
    each block, whose hits meet by row.
    """
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    items = _items(benchmark)
    n = _n_blocks(items, params)
    if n == 1:
        block = _block(items, 0, 1, params)

        def one(batch):
            rows = list(_found(batch, block.value, params))
            n_hit = [sum(b - a for a, b in s) for _, s, _ in rows]
            return {"doc_id": column_of(batch, "doc_id"), "n_words": [r[0] for r in rows], "n_hit": n_hit, "items": [r[2] for r in rows], "contaminated": [k > 0 for k in n_hit]}

        return map_texts(docs.select("doc_id", "text"), f"doc_id {kind}, n_words long, n_hit long, items array<string>, contaminated boolean", one)
    hits = _hits_by_block(docs, items, n, params)

    def count(batch):
        return {"doc_id": column_of(batch, "doc_id"), ROW[0]: column_of(batch, ROW[0]), ROW[1]: column_of(batch, ROW[1]), "n_words": [len(words_of(t)) for t in bytes_of(batch)]}

    rows = map_texts(_with_row(docs.select("doc_id", "text")), f"doc_id {kind}, {ROW[0]} long, {ROW[1]} long, n_words long", count)
    n_hit = F.coalesce("n_hit", F.lit(0))
    return rows.join(hits, list(ROW), "left").select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def matches(docs: DataFrame, benchmark: DataFrame, params: DecontamParams = DecontamParams()) -> DataFrame:
    """The longest verbatim matches and their places: doc_id, item_id, item_start, doc_start, n_words, one row each.

    A match is a run of words of an item that a document has, of a window's length at least (all of an item of fewer words),
    which words before or after don't continue. Null and empty texts, null ids of items and items without words have none;
    repeated rows, and items that repeat an id, give rows each; other columns are ignored; empty tables give no rows.
    """
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, item_id string, item_start long, doc_start long, n_words long"
    items = _items(benchmark)
    n = _n_blocks(items, params)
    scratch, out = Scratch(docs.sparkSession) if n > 1 else None, None
    for k in range(n):
        block = _block(items, k, n, params)

        def one(batch, block=block):
            made = []
            for part in slices(iter([batch]), "text", params.shard_bytes):
                starts, place, test, size = block.value.matches([words_of(t) for t in bytes_of(part)], params.pairs)
                doc = np.searchsorted(starts, place, "right") - 1
                item, before = block.value.items_of(test)
                made.append((column_of(part, "doc_id").take(pa.array(doc)), np.array(block.value.names, dtype=object)[item], before, place - starts[doc], size))
            ids, *rest = zip(*made)
            names = ("item_id", "item_start", "doc_start", "n_words")
            return {"doc_id": pa.concat_arrays(ids)} | {name: np.concatenate(x) for name, x in zip(names, rest)}

        found = map_texts(docs.select("doc_id", "text"), schema, one)
        if scratch:
            found = scratch.keep(found)
            block.destroy()
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, params: DecontamParams = DecontamParams()) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no match of a window's length with any item.

    Rows with null or empty texts stay; repeated rows stay or go together; without items every row stays, and an empty table
    stays empty.
    """
    items = _items(benchmark)
    n = _n_blocks(items, params)
    if n > 1:
        hits = _hits_by_block(docs, items, n, params).select(*ROW)
        names = [free(docs, name) for name in ROW]
        keyed = docs.withColumns(dict(zip(names, _row_hashes())))
        return keyed.join(hits.toDF(*names), names, "left_anti").select(*docs.columns)
    block = _block(items, 0, 1, params)

    def keep(batches):
        for part in slices(batches, "text", params.shard_bytes):
            starts, place, _, _ = block.value.matches([words_of(t) for t in bytes_of(part)], params.pairs)
            clean = np.ones(part.num_rows, dtype=bool)
            clean[np.searchsorted(starts, place, "right") - 1] = False
            yield part.filter(pa.array(clean))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)
