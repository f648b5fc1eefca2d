"""Helpers that the training-data operators share: tables, shared scratch tables, text batches, labelled samples."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a worker handles at once.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(column: str, modulus: int) -> Column:
    """crc32 of a column's text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the driver and the executors share; one of its own only where the session names none and runs on one
    machine. On a cluster without such a folder it raises, since executors couldn't read each other's tables."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def small_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Arrow batches of ``most`` bytes at most from here on in this session, since texts, unlike numbers, can be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) != f"{most}b":
        spark.conf.set(name, f"{most}b")


class Scratch:
    """Tables written to the shared folder, to cut lineage: a lost executor re-reads them instead of recomputing.

    ``drop`` removes those that no later step reads; what a returned DataFrame still reads stays.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0
        small_batches(spark)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.release()

    def release(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of steps that are over, which it does as the driver collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column``, one row at least."""
    for batch in batches:
        start, size = 0, 0
        data = batch.column(batch.schema.get_field_index(column))
        lengths = pc.binary_length(data).to_numpy(zero_copy_only=False) if batch.num_rows else []
        for i, n in enumerate(lengths):
            n = 0 if n is None or n != n else int(n)
            if size and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def free(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_texts(
    df: DataFrame,
    schema: str,
    one_batch: Callable[[pa.RecordBatch], list | dict],
    text: str = "text",
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """``one_batch`` over slices of bounded bytes; it returns the columns of ``schema`` by name, or a list of such."""
    from pyspark.sql.types import StructType, _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for part in slices(batches, text):
            made = one_batch(part, state) if setup else one_batch(part)
            if made is None:
                continue
            columns = [made[f.name] if isinstance(made[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(made[f.name], f.type) for f in arrow]
            columns = [c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, parsed)


def summed_counters(docs: DataFrame, n: int, count: Callable[[pa.RecordBatch], object], most: int) -> object:
    """``n`` counters (a multiple of 4096) summed over all rows; ``count`` gives what a slice of ``most`` bytes of text adds.

    Each task adds up its own; slices of them are shuffled and summed, and a fixed number of bytes reaches the driver.
    """
    import numpy as np

    width = 1 << 12
    schema = "slice int, counts binary"
    rows = lambda ks, counts: pa.RecordBatch.from_arrays([pa.array(list(ks), pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary())], names=["slice", "counts"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, dtype=np.int64)
        for part in slices(batches, "text", most):
            total += count(part)
        if total.any():
            yield rows(range(n // width), total.reshape(-1, width))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(counts, dtype=np.int64)
        if sums:
            yield rows(sums, sums.values())

    total = np.zeros(n, dtype=np.int64)
    for row in docs.mapInArrow(each, schema).repartition("slice").mapInArrow(add, schema).collect():
        total[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["counts"], dtype=np.int64)
    return total


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of the texts, null as empty."""
    return [t or b"" for t in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _chance(key: str) -> Column:
    """A number from 0 to 1 that a key's hash fixes."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 40)) / float(1 << 40)


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """``most`` of the rows at most: those of the smallest hashes of ``key``.

    Rows are first thinned by their hashes to little more than ``most``, so that few meet in the last step.
    """
    n = rows.count()
    share = (most + 6 * most**0.5 + 20) / max(1, n)
    return rows.where(_chance(key) < share).orderBy(_chance(key), key).limit(most)


def shared_out(most: int, each: int, among: int) -> int:
    """``each``, or less where ``among`` of it would be more than ``most``; 1 at least. More than ``most`` to share it among is an error."""
    if among > most:
        raise ValueError(f"{among} labels are more than the {most} rows that a model is fitted on")
    return min(each, max(1, most // max(1, among)))


def labelled_sample(labelled: DataFrame, key: str, label: str, per_label: int, most: int = 200_000) -> DataFrame:
    """(key, label) of ``per_label`` rows of each label at most, chosen by a hash of the key.

    The bound on what a classifier is fitted on: ``most`` rows in all. Every label counts, so labels get fewer rows each where there are
    many, and more labels than ``most`` raise an error. So the sample, and what is kept for each label, may be broadcast.
    """
    rows = labelled.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(key, label)
    labels = rows.groupBy(label).agg(F.count("*").alias("_of"))
    per_label = shared_out(most, per_label, labels.count())
    share = (per_label + 6 * per_label**0.5 + 20) / F.col("_of")
    order = Window.partitionBy(label).orderBy(_chance(key), key)
    thinned = rows.join(F.broadcast(labels), label).where(_chance(key) < share)
    return thinned.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_label).select(key, label)


def sampled_texts(docs: DataFrame, sample: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``sample``, whose keys are distinct and bounded, with their ``text``: of a key that repeats, the least one.

    So what is collected is bounded by the sample, however often a key repeats.
    """
    texts = docs.select(key, "text").where("text is not null").join(F.broadcast(sample.select(key)), key, "left_semi")
    return texts.groupBy(key).agg(F.min("text").alias("text")).join(F.broadcast(sample), key)


class WordVectors:
    """A vector for each word: those of a model, and those of unseen words, which a worker keeps for the texts to come.

    ``unseen`` makes the vectors of a list of words; at most ``cached`` of them are kept, besides one batch's own.
    """

    def __init__(self, known: dict[str, int], vectors, unseen: Callable[[list[str]], object], cached: int = 300_000) -> None:
        self.known, self.vectors, self.unseen, self.cached = known, vectors, unseen, cached
        self.rows, self.parts = dict(known), [vectors]
        self.matrix = vectors

    def sums(self, texts: list[dict[str, int]]):
        """For each text, given as word -> weight, the weighted sum of its words' vectors."""
        import numpy as np

        if len(self.rows) > len(self.known) + self.cached:
            self.rows, self.matrix = dict(self.known), self.vectors
        rows = self.rows
        new = list(dict.fromkeys(w for t in texts for w in t if w not in rows))
        if new:
            for w in new:
                rows[w] = len(rows)
            self.matrix = np.concatenate([self.matrix, self.unseen(new)])
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        total = int(sizes.sum())
        out = np.zeros((len(texts), self.matrix.shape[1]))
        if not total:
            return out
        at = np.fromiter((rows[w] for t in texts for w in t), dtype=np.int64, count=total)
        weights = np.fromiter((n for t in texts for n in t.values()), dtype=np.float64, count=total)
        full = np.flatnonzero(sizes)
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        out[full] = np.add.reduceat(self.matrix[at] * weights[:, None], starts)
        return out
