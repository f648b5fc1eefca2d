"""Conversation prefix trie by chained prefix digests.

A turn becomes a SHA-256 digest and the length of its text; texts go no further than that. The digests are chained along each
conversation, so that one number stands for each prefix, and the prefixes of all conversations, grouped by depth and digest, are the
nodes of the trie. The smallest conversation of a node names it.

Going down a conversation, the smallest member of its nodes only rises until it is the conversation itself. So the nodes that one
conversation names are the lower end of its path; they are summed along it, and that sum goes to each node above, which are the
rest of the conversation's own prefixes. Thus exploding to ancestors makes no more rows than there are prefixes.

Long conversations are chained in blocks of ``BLOCK`` turns: within blocks first, then over the digests of whole blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafolio.llm.common import Scratch, bucket, slices

#: Turns that are chained, and nodes that are summed, in one go.
BLOCK = 256
#: Bytes of joined ids that one row holds while the ids of a node are hashed.
CHUNK_BYTES = 1 << 20
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class RebuildParams:
    #: Conversations c that share c - c % family begin with turns of the first of them,
    family: int = 5
    #: as many as crc32 of the decimal c, modulo this, says.
    heads: int = 9


def _turn_digest(role: str, text: str) -> bytes:
    role_bytes = role.encode()
    return hashlib.sha256(len(role_bytes).to_bytes(8, "big") + role_bytes + text.encode()).digest()


def digested_turns(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, digest, bytes) of each turn, ``at`` from 0, and (conv_id, n) of each conversation.

    Turns are ordered by turn, null first; equal ones by role, then text, null as empty; repeated rows count each. Rows without a
    conv_id belong to no conversation and go. Rows are sorted over all partitions and numbered in each; where a conversation goes
    on in another partition, its numbers are shifted there, so that no conversation has to fit one task.
    """
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role")]
    # a prefix of the text tells partitions apart; rows of equal prefixes share one, where whole texts are compared
    ranged = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, at = None, 0
        for batch in batches:
            for piece in slices([batch], "text"):
                ids = piece.column(0).to_pylist()
                ats = []
                for c in ids:
                    at = at + 1 if c == last else 0
                    last = c
                    ats.append(at)
                texts = piece.column(3).to_pylist()
                made = [pa.array(ids, pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(ats, pa.int64()), pa.array(map(_turn_digest, piece.column(2).to_pylist(), texts), pa.binary()), pa.array([len(t.encode()) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(made, names=["conv_id", "part", "at", "digest", "bytes"])

    kept = scratch.keep(ranged.mapInArrow(digest, "conv_id long, part int, at long, digest binary, bytes long"))
    counted = kept.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a partition goes on with one conversation at most, so there are no more of these rows than partitions
    shifts = counted.select("conv_id", "part", F.sum("n").over(earlier).alias("shift")).where("shift is not null")
    turns = kept.join(F.broadcast(shifts), ["conv_id", "part"], "left")
    return turns.select("conv_id", (F.col("at") + F.coalesce("shift", F.lit(0))).alias("at"), "digest", "bytes"), counted.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuild(turns: DataFrame, sizes: DataFrame, params: RebuildParams = RebuildParams()) -> tuple[DataFrame, DataFrame]:
    """The turns and sizes of conversations of which each begins with the first turns of its family's first one.

    Conversation c takes the first h turns of c - c % family (all if there are fewer, none if it is absent), then its own turns
    after its first h.
    """
    base = F.col("conv_id") - F.col("conv_id") % params.family
    plans = sizes.select("conv_id", "n", base.alias("base"), bucket("conv_id", params.heads).alias("h"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plans = plans.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    plans = plans.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))
    heads = turns.where((F.col("conv_id") % params.family == 0) & (F.col("at") < params.heads - 1)).withColumnRenamed("conv_id", "base")
    heads = heads.join(plans.where("taken > 0").select("base", "conv_id", "taken"), "base").where("at < taken").select("conv_id", "at", "digest", "bytes")
    own = turns.join(plans.select("conv_id", "h", "taken"), "conv_id").where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "digest", "bytes")
    return heads.unionByName(own), plans.select("conv_id", "n")


def _chain(rows: DataFrame, keys: list[str], value: str, carried: list[str]) -> DataFrame:
    """``keys``, ``carried``, before and chained: each row's digest over the one before it and ``value``, along each key's rows; the
    first is ``value`` itself, so that a block's chain goes on where the one before it ended.

    ``rows`` are sorted within partitions so that a key's rows follow each other; ``before`` is null at its first. Rows stream through.
    """
    columns = [*keys, *carried, "before", "chained"]
    kinds = dict(rows.dtypes) | {"before": "binary", "chained": "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, b""
        for batch in batches:
            at = {name: k for k, name in enumerate(batch.schema.names)}
            befores, chained = [], []
            for key, own in zip(zip(*(batch.column(at[k]).to_pylist() for k in keys)), batch.column(at[value]).to_pylist()):
                if key != last:
                    last, digest = key, b""
                befores.append(digest or None)
                digest = hashlib.sha256(digest + own).digest() if digest else own
                chained.append(digest)
            yield pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in (*keys, *carried)), pa.array(befores, pa.binary()), pa.array(chained, pa.binary())], names=columns)

    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns))


def prefixes(turns: DataFrame, sizes: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, digest, parent, bytes, ends: every prefix of every conversation, from the empty one on.

    ``digest`` and ``parent`` stand for the prefix and the one that is a turn shorter, ``bytes`` is of the last text, ``ends`` is true where
    the whole conversation is meant.
    """
    rows = turns.join(sizes, "conv_id").withColumn("block", F.floor(F.col("at") / block))
    dealt = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at")
    within = scratch.keep(_chain(dealt, ["conv_id", "block"], "digest", ["at", "n", "bytes"]))
    full = within.where((F.col("at") + 1) % block == 0).select("conv_id", "block", F.col("chained").alias("digest"))
    over = _chain(full.repartition("conv_id").sortWithinPartitions("conv_id", "block"), ["conv_id"], "digest", ["block"])
    over = over.select("conv_id", (F.col("block") + 1).alias("block"), F.col("chained").alias("over"))
    hashed = lambda c: F.unhex(F.sha2(F.concat("over", c), 256))
    first = within.where("block = 0").select("conv_id", "at", "n", "bytes", F.col("chained").alias("digest"), F.coalesce("before", F.unhex(F.lit(""))).alias("parent"))
    later = within.where("block > 0").join(over, ["conv_id", "block"]).select("conv_id", "at", "n", "bytes", hashed("chained").alias("digest"), F.coalesce(hashed("before"), "over").alias("parent"))
    below = first.unionByName(later).select("conv_id", (F.col("at") + 1).alias("depth"), "digest", "parent", "bytes", (F.col("at") + 1 == F.col("n")).alias("ends"))
    root = sizes.select("conv_id", F.lit(0).cast("long").alias("depth"), F.unhex(F.lit("")).alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("bytes"), (F.col("n") == 0).alias("ends"))
    return root.unionByName(below)


def _id_digests(ends: DataFrame) -> DataFrame:
    """depth, digest, ends_sha256: SHA-256 of each node's conv_ids, ascending and joined by commas.

    The ids of all nodes are sorted over all partitions and joined there; what one task gets of a node is text of bounded rows, which it
    only streams through the hash.
    """
    ranged = ends.select("depth", "digest", "conv_id").repartitionByRange("depth", "digest", "conv_id").sortWithinPartitions("depth", "digest", "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = []
            for depth, digest, c in zip(*(x.to_pylist() for x in batch.columns)):
                if made and made[-1][:2] == [depth, digest] and made[-1][4] < CHUNK_BYTES:
                    made[-1][3].append(str(c))
                    made[-1][4] += 20
                else:
                    made.append([depth, digest, c, [str(c)], 20])
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary()), pa.array([m[2] for m in made], pa.int64()), pa.array([",".join(m[3]) for m in made], pa.string())], names=["depth", "digest", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, made = None, None, []
        for batch in batches:
            for depth, node, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if (depth, node) != last:
                    if last is not None:
                        made.append((*last, state.hexdigest()))
                    last, state = (depth, node), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield rows(made)
            made = []
        if last is not None:
            yield rows([(*last, state.hexdigest())])

    def rows(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary()), pa.array([m[2] for m in made], pa.string())], names=["depth", "digest", "ends_sha256"])

    chunks = ranged.mapInArrow(join, "depth long, digest binary, first long, ids string")
    return chunks.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "first").mapInArrow(digest, "depth long, digest binary, ends_sha256 string")


def _sums_below(nodes: DataFrame, values: list[str], block: int) -> DataFrame:
    """``nodes`` with each of ``values`` summed over the node and those below it that the same conversation names.

    Sums run within blocks of depths and over whole blocks, so that no task gets all nodes of a conversation.
    """
    nodes = nodes.withColumn("block", F.floor(F.col("depth") / block))
    whole = nodes.groupBy("conv_id", "block").agg(*(F.sum(v).alias(v) for v in values))
    lower = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("conv_id", "block", *(F.coalesce(F.sum(v).over(lower), F.lit(0)).alias(f"{v}_lower") for v in values))
    within = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = nodes.join(whole, ["conv_id", "block"])
    return joined.withColumns({v: F.sum(v).over(within) + F.col(f"{v}_lower") for v in values}).drop("block", *(f"{v}_lower" for v in values))


def nodes_of(paths: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node of ``prefixes``."""
    grouped = paths.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("ends").cast("long")).alias("n_ends"), F.min("parent").alias("parent"), ((F.count("*") - 1) * F.max("bytes")).alias("saved_tokens"))
    # a node all of whose members end there has no children
    nodes = scratch.keep(grouped.withColumn("n_leaves", (F.col("n_ends") == F.col("n_convs")).cast("long")))
    sums = ["n_leaves", "saved_tokens"]
    tops = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), *(F.sum(v).alias(v) for v in sums))
    above = paths.select("conv_id", "depth", "digest").join(tops, "conv_id").where("depth < top").groupBy("depth", "digest").agg(*(F.sum(v).alias(f"{v}_hung") for v in sums))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    own = _sums_below(nodes, sums, block)
    found = own.join(above, ["depth", "digest"], "left").join(children, ["depth", "digest"], "left").join(_id_digests(paths.where("ends")), ["depth", "digest"], "left").join(parents, ["depth", "parent"], "left")
    total = lambda v: (F.col(v) + F.coalesce(f"{v}_hung", F.lit(0))).alias(v)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), total("n_leaves"), total("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, rebuilding: RebuildParams | None = None, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of all conversations, rebuilt first if ``rebuilding`` says how.

    ``conversations`` has conv_id, turn, role, text; other columns are ignored. Null roles and texts count as empty, as do empty ones;
    rows without a conv_id go; order and ties are those of ``digested_turns``, and repeated rows are turns of their own. Conversations
    may be turnless once rebuilt: those are members of the root alone. Without any conversation there is no node, not even a root.
    Columns are those of ``nodes_of``: conv_id and depth tell nodes apart. No conversation, node or group of equal ones has to fit a task.
    """
    scratch = Scratch(conversations.sparkSession)
    turns, sizes = digested_turns(conversations, scratch)
    if rebuilding is not None:
        turns, sizes = rebuild(turns, sizes, rebuilding)
    return nodes_of(scratch.keep(prefixes(turns, sizes, scratch, block)), scratch, block)
