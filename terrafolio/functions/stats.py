"""Statistics over groups: exact medians and percentiles, trimming, votes, scores and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafolio.functions.expr import half_up
from terrafolio.params import DEFAULT, Params


def quantile(x: str, share: float) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(x, F.lit(share))


def trim_iqr(rows: DataFrame, keys: list[str], x: str, p: Params = DEFAULT) -> DataFrame:
    """Rows within Tukey's fences of their group. Groups of few rows, or without spread, stay whole; null ``x`` go."""
    known = rows.where(F.col(x).isNotNull())
    fences = known.groupBy(*keys).agg(F.count("*").alias("_n"), quantile(x, 0.25).alias("_q1"), quantile(x, 0.75).alias("_q3"))
    iqr = F.col("_q3") - F.col("_q1")
    inside = F.col(x).between(F.col("_q1") - p.trim_k * iqr, F.col("_q3") + p.trim_k * iqr)
    return known.join(fences, keys).where((F.col("_n") < p.trim_least_rows) | (iqr == 0) | inside).drop("_n", "_q1", "_q3")


def majority(rows: DataFrame, keys: list[str], vote: str, order: list[str] | None = None) -> DataFrame:
    """keys, winner, votes, n: the most frequent vote of each group.

    Ties go to the alphabetically first, or, with ``order``, to the one met first in that order.
    """
    tie = F.min(F.struct(*order)).alias("_first") if order else F.min(F.lower(vote)).alias("_first")
    counts = rows.where(F.col(vote).isNotNull()).groupBy(*keys, vote).agg(F.count("*").alias("votes"), tie)
    best = F.min_by(F.struct(F.col(vote).alias("winner"), "votes"), F.struct(-F.col("votes"), "_first", vote))
    return counts.groupBy(*keys).agg(best.alias("_b"), F.sum("votes").alias("n")).select(*keys, F.col("_b.winner").alias("winner"), F.col("_b.votes").alias("votes"), "n")


def smallest_mode(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, mode, n: the most frequent value, the smallest of equals."""
    counts = rows.where(F.col(x).isNotNull()).groupBy(*keys, x).count()
    return counts.groupBy(*keys).agg(F.min_by(F.struct(x, "count"), F.struct(-F.col("count"), x)).alias("_b")).select(*keys, F.col(f"_b.{x}").alias("mode"), F.col("_b.count").alias("n"))


def modal_bucket(rows: DataFrame, keys: list[str], x: str, p: Params = DEFAULT) -> DataFrame:
    """keys, low, high, n: the fullest bucket [low, high) of a fixed width, the lowest of equals."""
    buckets = rows.where(F.col(x).isNotNull()).groupBy(*keys, F.floor(F.col(x) / p.bucket_width).alias("b")).count()
    best = buckets.groupBy(*keys).agg(F.min_by(F.struct("b", "count"), F.struct(-F.col("count"), "b")).alias("m"))
    return best.select(*keys, (F.col("m.b") * p.bucket_width).alias("low"), ((F.col("m.b") + 1) * p.bucket_width).alias("high"), F.col("m.count").alias("n"))


def zscores(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Score of each column by the population's deviation: 0 without spread or below two values, -2 where unknown.

    The totals of all columns are one scalar subquery, so nothing is gathered in one window.
    """
    each = [F.struct(F.avg(x).alias("mean"), F.stddev_pop(x).alias("spread"), F.count(x).alias("n")).alias(out) for x, out in columns.items()]
    rows = rows.withColumn("_totals", rows.agg(F.struct(*each)).scalar())  # a column, so that the subquery is planned once
    for x, out in columns.items():
        mean, spread, n = (F.col(f"_totals.{out}.{k}") for k in ("mean", "spread", "n"))
        z = F.when(n < 2, 0.0).otherwise((F.col(x) - mean) / F.when(spread > 0, spread).otherwise(1.0))
        rows = rows.withColumn(out, F.when(F.col(x).isNull(), -2.0).otherwise(z))
    return rows.drop("_totals")


def rescale(rows: DataFrame, x: str, out: str) -> DataFrame:
    """From 0 to 100 between the least and the largest; a range of 0 counts as 1."""
    ends = rows.agg(F.struct(F.min(x).alias("low"), F.max(x).alias("high"))).scalar()
    low, high = F.col("_ends.low"), F.col("_ends.high")
    scaled = 100 * (F.col(x) - low) / F.when(high > low, high - low).otherwise(1.0)
    return rows.withColumn("_ends", ends).withColumn(out, scaled).drop("_ends")


def tercile_cuts(rows: DataFrame, x: str) -> DataFrame:
    """low, high: the values at a third and two thirds of the sorted ones."""
    ordered = F.array_sort(F.collect_list(x))
    n = F.size("v")
    at = lambda k: F.element_at("v", F.least(n, F.floor(n * k / 3).cast("int") + 1))
    return rows.agg(ordered.alias("v")).select(F.when(n > 0, at(1)).alias("low"), F.when(n > 0, at(2)).alias("high"))


def shares_of_100(counts: DataFrame, keys: list[str], category: str, n: str) -> DataFrame:
    """Percentages with one decimal that add up to 100.0 in each group, by the largest remainders; ties by category."""
    w = Window.partitionBy(*keys)
    exact = F.col(n) * 1000 / F.sum(n).over(w)
    base = counts.withColumn("_floor", F.floor(exact)).withColumn("_rest", half_up(exact - F.floor(exact), 9))
    missing = 1000 - F.sum("_floor").over(w)
    rank = F.row_number().over(w.orderBy(F.desc("_rest"), category))
    return base.withColumn("_r", rank).withColumn("_m", missing).withColumn("pct", (F.col("_floor") + F.when(F.col("_r") <= F.col("_m"), 1).otherwise(0)) / 10).drop("_floor", "_rest", "_r", "_m")


def adaptive_window(rows: DataFrame, keys: list[str], month: str, end: Column, p: Params = DEFAULT) -> DataFrame:
    """keys, months, few: the shortest window up to ``end`` with enough rows, else the longest, flagged."""
    within = lambda w: F.sum(F.when((F.col(month) <= end) & (F.col(month) > end - w), 1).otherwise(0))
    counts = rows.groupBy(*keys).agg(*(within(w).alias(f"n{w}") for w in p.adaptive_windows))
    months = F.when(F.lit(False), 0)
    for w in p.adaptive_windows:
        months = months.when(F.col(f"n{w}") >= p.adaptive_least_rows, w)
    last = p.adaptive_windows[-1]
    return counts.select(*keys, months.otherwise(last).alias("months"), (F.col(f"n{last}") < p.adaptive_least_rows).alias("few"))


def first_rows(rows: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in a total order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
