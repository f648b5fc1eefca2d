"""Files as DataFrames: spreadsheets, cadastres, dimension tables with overrides, JSON cards and state, dated snapshots."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafolio.sources import xlsx

CELLS = "file string, sheet string, row_num long, cells map<string,string>"
CARD = (
    "address struct<area: string, street: string, number: string, complement: string, zipcode: string, geo: struct<coordinates: array<double>>>, "
    "values struct<sale: double>, areas struct<private: double>, rooms int, parkingLots int, type string, base36Id string, createdAt string"
)


def spreadsheets(spark: SparkSession, path: str, sheets: str = ".*") -> DataFrame:
    """file, sheet, row_num, cells (column letter -> text) of the .xlsx files at ``path``; absent cells are absent, not empty.

    Files are read by Spark (``binaryFile``) from any store that it knows, one row a file, and parsed in tasks row by row; sheets by a
    pattern of their names. ``xlsx.sheets`` reads a sheet a task instead, and doesn't hold whole files.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    shared = xlsx.shared_strings(book)
                    for sheet, path in xlsx.sheets_of(book):
                        rows = ((name, sheet, n, cells) for n, cells in xlsx.sheet_rows(book, path, shared)) if re.fullmatch(sheets, sheet) else iter(())
                        while piece := list(islice(rows, xlsx.ROWS_PER_BATCH)):
                            yield pd.DataFrame(piece, columns=["file", "sheet", "row_num", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, CELLS)


def years(frames: dict[int, DataFrame]) -> DataFrame:
    """The union of yearly tables, each with its ``sheet_year``; columns that some lack are null there."""
    out = None
    for year, frame in sorted(frames.items()):
        one = frame.withColumn("sheet_year", F.lit(year))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no year given")
    return out


def cadastre(spark: SparkSession, path: str, columns: list[str], sep: str = ";") -> DataFrame:
    """Some columns of a delimited cadastre, gzipped or not; a gzip file is one task, so its rows are dealt out after reading."""
    frame = spark.read.csv(path, sep=sep, header=True, mode="DROPMALFORMED")
    return frame.select(*columns).repartition(spark.sparkContext.defaultParallelism)


def dimension(base: DataFrame, extra: DataFrame, key: str, value: str) -> DataFrame:
    """A dimension with overrides: rows of ``extra`` replace those of ``base`` with their key."""
    return base.join(extra.select(key), key, "left_anti").select(key, value).unionByName(extra.select(key, value))


def conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value."""
    return rows.groupBy(key).agg(F.countDistinct(value).alias("n")).where("n > 1")


def cards(texts: DataFrame, column: str = "card") -> DataFrame:
    """Listings from JSON cards: coordinates come as longitude, latitude; areas beyond 2000 m2 are unknown."""
    c = F.from_json(column, CARD)
    return texts.select(c.alias("c")).select(
        F.col("c.base36Id").alias("codigo"),
        F.col("c.address.area").alias("bairro"),
        F.col("c.address.street").alias("rua"),
        F.col("c.address.number").alias("numero"),
        F.col("c.values.sale").alias("valor"),
        F.when(F.col("c.areas.private").between(0, 2000), F.col("c.areas.private")).alias("area"),
        F.get("c.address.geo.coordinates", F.lit(1)).alias("lat"),
        F.get("c.address.geo.coordinates", F.lit(0)).alias("lon"),
        F.col("c.rooms").alias("quartos"),
        F.col("c.parkingLots").alias("vagas"),
        F.try_to_timestamp("c.createdAt").alias("criado"),
    )


def state(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A JSON-lines state table; a line that doesn't parse, or a key that repeats, is an error when the table is read."""
    rows = spark.read.schema(f"{schema}, _bad string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    rows = rows.withColumn("_bad", F.when(F.col("_bad").isNotNull(), F.raise_error(F.concat(F.lit("not a state row: "), "_bad"))).cast("string"))
    counted = rows.groupBy(key).agg(F.count("*").alias("_n")).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("a key repeats"))).otherwise(F.col("_n")))
    return rows.join(counted, key).where("_bad is null and _n >= 1").drop("_bad", "_n")


def snapshot_before(snapshots: DataFrame, day, days: int = 7) -> DataFrame:
    """The rows of the latest ``run_date`` that lies ``days`` or more before ``day``."""
    last = snapshots.where(F.col("run_date") <= F.date_sub(F.lit(day).cast("date"), days)).agg(F.max("run_date")).scalar()
    return snapshots.where(F.col("run_date") == last)


def publish(frame: DataFrame, violations: DataFrame, path: str) -> int:
    """Writes ``frame`` unless some check of ``violations`` (check, n) found any; returns the number of failed checks."""
    failed = violations.where("n > 0").count()
    if not failed:
        frame.write.mode("overwrite").parquet(path)
    return failed


def to_retain(deployments: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` newest deployments (id, created, live) and those that are live."""
    newest = deployments.orderBy(F.desc("created"), "id").limit(keep)
    return newest.union(deployments.where("live")).distinct()
