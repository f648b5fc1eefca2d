"""Dated snapshots with a manifest each, of which the newest sound one is read; and a choice among sources."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrafolio.sources.publish import location


#: What a reader raises on files that it can't read; some of Spark's errors come as those of its gateway.
UNREADABLE = (PySparkException, Py4JJavaError)


def write_snapshot(frame: DataFrame, root: str, run_date: str) -> int:
    """Writes ``frame`` as the snapshot of a day (YYYY-MM-DD) and, once it is whole, its manifest with the number of rows, which is returned."""
    folder = f"{root}/run_date={run_date}"
    frame.write.mode("overwrite").parquet(folder)
    rows = frame.sparkSession.read.schema(frame.schema).parquet(folder).count()
    store, path = location(root)
    store.create_dir(f"{path}/manifests", recursive=True)
    with store.open_output_stream(f"{path}/manifests/{run_date}.json") as out:
        out.write(json.dumps({"run_date": run_date, "rows": rows, "schema": frame.schema.json()}).encode())
    return rows


def manifests(root: str) -> list[dict]:
    """What manifests say, the oldest day first; one that can't be read says nothing."""
    from pyarrow import fs as arrow_fs

    store, path = location(root)
    out = []
    for f in sorted(store.get_file_info(arrow_fs.FileSelector(f"{path}/manifests", allow_not_found=True)), key=lambda f: f.base_name):
        try:
            with store.open_input_stream(f.path) as stream:
                out.append(json.loads(stream.read()))
        except ValueError:
            continue
    return out


def _sound(frame: DataFrame, rows: int | None, least: int) -> bool:
    """Whether all of a frame can be read and it has the rows that it should."""
    try:
        # every column is read, not only what counting takes
        n, _ = frame.agg(F.count("*"), F.sum(F.xxhash64(*frame.columns).cast("decimal(38,0)"))).first()
    except UNREADABLE:
        return False
    return n >= least and rows in (None, n)


def newest_sound(spark: SparkSession, root: str, until: str | None = None, least: int = 1) -> tuple[str, DataFrame]:
    """Day and rows of the newest snapshot, up to the day ``until``, that is whole: it has a manifest, can be read, and has as many rows as that
    says, ``least`` of them. Only that day's folder is read again. Raises LookupError where no snapshot is sound."""
    for m in reversed(manifests(root)):
        if until is not None and m["run_date"] > until:
            continue
        frame = spark.read.schema(StructType.fromJson(json.loads(m["schema"]))).parquet(f"{root}/run_date={m['run_date']}")
        if _sound(frame, m["rows"], least):
            return m["run_date"], frame
    raise LookupError(f"no sound snapshot below {root}")


def first_sound(sources: Sequence[tuple[str, Callable[[], DataFrame]]], least: int = 1) -> tuple[str, DataFrame]:
    """Name and rows of the first of several sources, in the order of preference, that can be read and has ``least`` rows."""
    for name, load in sources:
        try:
            frame = load()
        except (*UNREADABLE, OSError):
            continue
        if _sound(frame, None, least):
            return name, frame
    raise LookupError(f"no source is sound: {[name for name, _ in sources]}")
