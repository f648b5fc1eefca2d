"""Publication of several tables as one version: staged, checked while they are written, moved as one, announced last.

A version is a folder ``versions/<name>`` with a table in each subfolder; ``markers/<name>.json`` says that it is whole. Tables are written
below ``staging/<name>`` first. What row rules need is counted by ``Observation`` in the pass that writes a table, so that checks don't
read it again; checks over several rows or tables run on what was staged. Only then is the folder moved and the marker written, by a
rename. Readers follow the newest marker, so whatever fails before leaves them the version before.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Blocked(RuntimeError):
    """Some check found something; nothing was published."""

    def __init__(self, found: dict[str, int]) -> None:
        super().__init__("publication is blocked: " + ", ".join(f"{name} ({n})" for name, n in sorted(found.items())))
        self.found = found


@dataclass(frozen=True)
class Table:
    """A frame to publish, its format (parquet, json or csv), the columns that its files are in order of, and what each row must fulfil.

    A rule that is null for a row isn't broken by it. ``most_change`` is the largest change of the number of rows against the version
    before, as a share of it; null for any.
    """

    frame: DataFrame
    format: str = "parquet"
    order: Sequence[str] = ()
    rules: dict[str, Column] = field(default_factory=dict)
    most_change: float | None = None


def location(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system and the path in it; paths without a scheme are local."""
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def _write(table: Table, path: str, name: str) -> dict[str, int]:
    """Writes a table and gives its number of rows and how many break each rule."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    broken = [F.count_if(~F.coalesce(rule, F.lit(True))).alias(rule_name) for rule_name, rule in table.rules.items()]
    frame = table.frame
    if table.order:
        frame = frame.repartitionByRange(*table.order).sortWithinPartitions(*table.order)
    writer = frame.observe(seen, F.count(F.lit(1)).alias("rows"), *broken).write.format(table.format)
    (writer.option("header", True) if table.format == "csv" else writer).save(path)
    return {k: int(v or 0) for k, v in seen.get.items()}


def markers(root: str) -> list[dict]:
    """The whole versions, the oldest first."""
    store, path = location(root)
    files = store.get_file_info(arrow_fs.FileSelector(f"{path}/markers", allow_not_found=True))
    out = []
    for f in sorted((f for f in files if f.path.endswith(".json")), key=lambda f: f.base_name):
        with store.open_input_stream(f.path) as stream:
            out.append(json.loads(stream.read()))
    return out


def publish_version(tables: dict[str, Table], root: str, checks: Callable[[dict[str, DataFrame]], DataFrame] | None = None, moment: datetime.datetime | None = None) -> str:
    """Publishes ``tables`` as one version below ``root`` and returns its name; raises ``Blocked`` if a rule or check finds anything.

    ``checks`` gets the staged tables by name and returns check, n (see ``checks.violations``). Names of versions sort by their moment.
    """
    if not tables:
        raise ValueError("no table to publish")
    spark = next(iter(tables.values())).frame.sparkSession
    store, path = location(root)
    moment = moment or datetime.datetime.now(datetime.timezone.utc)
    version = f"{moment:%Y%m%dT%H%M%S.%f}-{uuid.uuid4().hex[:8]}"
    staging = f"staging/{version}"
    before = (markers(root) or [{}])[-1]
    try:
        metrics = {name: _write(table, f"{root}/{staging}/{name}", name) for name, table in tables.items()}
        found = {f"{name}.{rule}": n for name, counts in metrics.items() for rule, n in counts.items() if rule != "rows" and n}
        for name, table in tables.items():
            old = before.get("tables", {}).get(name, {}).get("rows")
            if table.most_change is not None and old is not None and abs(metrics[name]["rows"] - old) > table.most_change * max(1, old):
                found[f"{name}.rows {old} -> {metrics[name]['rows']}"] = 1
        if not found and checks is not None:
            staged = {name: _read(spark, f"{root}/{staging}/{name}", table.format, table.frame.schema) for name, table in tables.items()}
            found = {r["check"]: int(r["n"]) for r in checks(staged).where("n > 0").collect()}
        if found:
            raise Blocked(found)
        store.create_dir(f"{path}/versions", recursive=True)
        store.move(f"{path}/{staging}", f"{path}/versions/{version}")
    except BaseException:
        if store.get_file_info(f"{path}/{staging}").type == arrow_fs.FileType.Directory:
            store.delete_dir(f"{path}/{staging}")
        raise
    said = {"version": version, "tables": {name: {"format": table.format, "schema": table.frame.schema.json(), **metrics[name]} for name, table in tables.items()}}
    store.create_dir(f"{path}/markers", recursive=True)
    with store.open_output_stream(f"{path}/markers/{version}.tmp") as out:
        out.write(json.dumps(said).encode())
    store.move(f"{path}/markers/{version}.tmp", f"{path}/markers/{version}.json")
    return version


def _read(spark: SparkSession, path: str, kind: str, schema) -> DataFrame:
    reader = spark.read.schema(schema).format(kind)
    return (reader.option("header", True) if kind == "csv" else reader).load(path)


def current(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    """A table of the newest whole version, or of the one named."""
    from pyspark.sql.types import StructType

    known = [m for m in markers(root) if version in (None, m["version"])]
    if not known:
        raise FileNotFoundError(f"no whole version below {root}" if version is None else f"no whole version {version} below {root}")
    said = known[-1]["tables"][name]
    return _read(spark, f"{root}/versions/{known[-1]['version']}/{name}", said["format"], StructType.fromJson(json.loads(said["schema"])))


def prune(root: str, keep: int) -> list[str]:
    """Removes all but the ``keep`` newest whole versions (one at least), and what no marker speaks of; returns the names removed.

    A marker goes before its tables, so that readers never follow it into a folder that is half gone. Not to be run while publishing.
    """
    store, path = location(root)
    kept = {m["version"] for m in markers(root)[-max(1, keep) :]}
    gone = []
    for f in store.get_file_info(arrow_fs.FileSelector(f"{path}/markers", allow_not_found=True)):
        if f.base_name.rpartition(".")[0] not in kept:
            store.delete_file(f.path)
    for folder in ("versions", "staging"):
        for f in store.get_file_info(arrow_fs.FileSelector(f"{path}/{folder}", allow_not_found=True)):
            if f.base_name not in kept:
                store.delete_dir(f.path)
                gone.append(f.base_name)
    return sorted(gone)
