"""Periods: the last complete month, twelve-month counters, guarded trends, launches and rolling medians."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafolio.operators.order import kept, matched
from terrafolio.params import DEFAULT, Params

#: Bins that values are told apart by before medians are looked for, a power of two.
BINS = 64


def base_month(rows: DataFrame, month: str = "mes", p: Params = DEFAULT) -> DataFrame:
    """base, window_end, window_start, previous_start: the last month that isn't a stub, and the windows that follow from it.

    Ranks are over present months; one of rank 3 or more is a stub below half of the median of the three before.
    """
    counts = rows.where(F.col(month).isNotNull()).groupBy(F.col(month).alias("m")).agg(F.count("*").alias("n"))
    w = Window.orderBy("m")  # one row a month: a few hundred at most
    before = F.array_sort(F.array(*(F.lag("n", k).over(w) for k in (1, 2, 3))))
    ranked = counts.withColumn("k", F.row_number().over(w) - 1).withColumn("before", before)
    stub = (F.col("k") >= 3) & (F.col("n") < p.stub_share * F.element_at("before", 2))
    end = F.col("base") - p.lag_months
    return ranked.where(~stub | (F.col("k") <= 2)).agg(F.max("m").alias("base")).select("base", end.alias("window_end"), (end - p.window_months + 1).alias("window_start"), (end - 2 * p.window_months + 1).alias("previous_start"))


def volume_12m(rows: DataFrame, keys: list[str], flags: dict[str, Column], month: str = "mes", p: Params = DEFAULT) -> DataFrame:
    """keys, and for each flag its count in the window, in the one before and in the months after, in one pass."""
    period = base_month(rows, month, p)
    rows = rows.withColumn("_end", period.select("window_end").scalar())
    end = F.col("_end")
    now = (F.col(month) <= end) & (F.col(month) > end - p.window_months)
    past = (F.col(month) <= end - p.window_months) & (F.col(month) > end - 2 * p.window_months)
    late = F.col(month) > end
    count = lambda when, name: F.sum(F.when(when, 1).otherwise(0)).alias(name)
    return rows.groupBy(*keys).agg(*(count(w & flag, f"{name}_{label}") for name, flag in flags.items() for w, label in ((now, "12m"), (past, "anterior"), (late, "incompleto"))))


def guarded_trend(now: Column, past: Column, p: Params = DEFAULT) -> Column:
    """Growth, null unless both windows have enough sales; within -100 % and 100 %."""
    enough = (now >= p.trend_least_sales) & (past >= p.trend_least_sales)
    return F.when(enough, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (now - past) / past)))


def year_half_trend(rows: DataFrame, keys: list[str], year: int, day: str = "dia") -> DataFrame:
    """keys, trend: the mean of year over year and first half over first half, each within -100 % and 100 %."""
    y, m = F.year(day), F.month(day)
    n = lambda when: F.sum(F.when(when, 1).otherwise(0))
    counts = rows.groupBy(*keys).agg(n(y == year - 1).alias("a"), n(y == year - 2).alias("b"), n((y == year - 1) & (m <= 6)).alias("c"), n((y == year - 2) & (m <= 6)).alias("d"))
    growth = lambda x, base: F.when(F.col(base) > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col(x) - F.col(base)) / F.col(base))))
    one, two = growth("a", "b"), growth("c", "d")
    return counts.select(*keys, F.coalesce((one + two) / 2, one, two).alias("trend"))


def launches(rows: DataFrame, key: str, day: str = "dia", p: Params = DEFAULT) -> DataFrame:
    """Addresses, and whether any five of their sales fall within half a year."""
    later = F.lead(day, p.launch_sales - 1).over(Window.partitionBy(key).orderBy(day))
    return rows.select(key, (F.datediff(later, day) <= p.launch_days).alias("hit")).groupBy(key).agg(F.coalesce(F.max("hit"), F.lit(False)).alias("lancamento"))


def rolling_medians(rows: DataFrame, keys: list[str], x: str, month: str = "mes", p: Params = DEFAULT, ends: tuple[str, str] | None = None) -> DataFrame:
    """keys, i, i1, meses, w, median, n: medians of windows of w months around each month, slid inside the first and last month,
    which are those of the data or the constant columns ``ends``."""
    known = kept(rows.where(F.col(x).isNotNull() & F.col(month).isNotNull()).select(*keys, F.col(month).alias("_month"), F.col(x).cast("double").alias("_x"), *(ends or ())))
    low_end, high_end = (F.min(ends[0]), F.max(ends[1])) if ends else (F.min("_month"), F.max("_month"))
    span = kept(known.agg(low_end.alias("i0"), high_end.alias("i1")).where("i0 is not null"))
    months = span.select("i0", "i1", (F.col("i1") - F.col("i0") + 1).alias("meses"), F.explode(F.sequence("i0", "i1")).alias("i"))
    windows = months.select("*", F.explode(F.array(*map(F.lit, p.index_windows))).alias("w"))
    low = F.greatest(F.col("i0"), F.least(F.col("i") - F.floor(F.col("w") / 2), F.col("i1") - F.col("w") + 1))
    windows = windows.withColumn("lo", low.cast("int")).withColumn("hi", F.least(F.col("i1"), F.col("lo") + F.col("w") - 1).cast("int"))
    members = windows.select("i", "i1", "meses", "w", F.explode(F.sequence("lo", "hi")).alias("_month"))  # some rows for each month
    found = _quantiles(known, keys, [0.5], members)
    return kept(found.select(*keys, "i", "i1", "meses", "w", F.element_at("q", 1).alias("median"), "n"))


def group_quantiles(rows: DataFrame, keys: list[str], x: str, shares: list[float]) -> DataFrame:
    """keys, n, q: the exact quantiles of the known ``x`` of groups that may be few and large, in the order of ``shares``, linear between
    two values. No group meets in one task but for the values of the bins that a quantile lies in."""
    return _quantiles(kept(rows.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"))), keys, shares)


def part_quantiles(rows: DataFrame, key: str, part: str, x: str, shares: list) -> DataFrame:
    """key, part, n, q: the exact quantiles of the known ``x`` of each part of a key, and of all of the key as part ``*``; of few and large
    groups, none of which meets in one task (see ``group_quantiles``). A share may also be a function of ``n`` that gives a place, from 0."""
    known = kept(rows.where(F.col(x).isNotNull()).select(key, F.col(part).alias("_month"), F.col(x).cast("double").alias("_x")))
    members = kept(known.select("_month").distinct().select("_month", F.explode(F.array("_month", F.lit("*"))).alias(part)))
    return _quantiles(known, [key], shares, members)


def _quantiles(known: DataFrame, keys: list[str], shares: list, members: DataFrame | None = None) -> DataFrame:
    """keys, n, q of ``_x`` of each group, or, with ``members`` (the columns of a window, _month), of each group and window.

    Values are counted (by month) in ``BINS`` bins of their keys first, which tells in what bins the quantiles lie; only values of
    these bins meet the windows. Where bins end changes the cost, never the result.
    """
    along = [] if members is None else ["_month"]
    of = [] if members is None else [c for c in members.columns if c != "_month"]
    window, cell = [*keys, *of], [*keys, *along, "_bin"]
    spread = lambda frame, on: frame if members is None else frame.join(F.broadcast(members), on)
    cuts = kept(known.groupBy(*keys).agg(F.percentile_approx("_x", [k / BINS for k in range(1, BINS)], 1000).alias("_cuts")))
    binned = matched(known, cuts, keys).withColumn("_bin", F.lit(0))
    for step in (BINS >> k for k in range(1, BINS.bit_length())):  # one column after the other, for compiled code
        binned = binned.withColumn("_bin", F.col("_bin") + F.when(F.col("_x") >= F.get("_cuts", F.col("_bin") + (step - 1)), step).otherwise(0))
    binned = binned.select(*keys, *along, "_x", "_bin")
    running = lambda by, order: F.sum("_n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    place = lambda s: s(F.col("n")) if callable(s) else F.lit(s) * (F.col("n") - 1)
    places = [(F.floor(at), F.ceil(at)) for at in map(place, shares)]
    holds = lambda at: (F.col("_upto") > at) & (F.col("_upto") - F.col("_n") <= at)
    any_place = F.lit(False)
    for low, high in places:
        any_place = any_place | holds(low) | holds(high)
    by_bin = spread(binned.groupBy(*cell).agg(F.count("*").alias("_n")), "_month").groupBy(*window, "_bin").agg(F.sum("_n").alias("_n"))
    placed = by_bin.withColumns({"_upto": running(window, "_bin"), "n": F.sum("_n").over(Window.partitionBy(*window))})
    middle = kept(placed.where(any_place).select(*window, "_bin", "n", (F.col("_upto") - F.col("_n")).alias("_before")))
    asked = spread(middle, of)
    cells = kept(asked.select(*cell).distinct())
    values = matched(binned, cells, cell).groupBy(*cell, "_x").agg(F.count("*").alias("_n"))
    inside = [*window, "n", "_bin", "_before"]
    met = matched(values, asked, cell).groupBy(*inside, "_x").agg(F.sum("_n").alias("_n")).withColumn("_upto", F.col("_before") + running(inside, "_x"))
    value = lambda at: F.max(F.when(holds(at), F.col("_x")))

    def between(s, low: Column, high: Column) -> Column:
        at, a, b = place(s), value(low), value(high)
        return F.when(a == b, a).otherwise((high - at) * a + (at - low) * b)

    return met.groupBy(*window, "n").agg(F.array(*(between(s, low, high) for s, (low, high) in zip(shares, places))).alias("q"))


def price_index(rows: DataFrame, keys: list[str], x: str, month: str = "mes", p: Params = DEFAULT) -> DataFrame:
    """keys, i, factor: what brings a price of month i to the last month, from each group's shortest window with enough rows.

    Groups without such a window get the series over all rows, in windows of ``index_fallback_window`` months.
    """
    rolled = rolling_medians(rows, keys, x, month, p)
    good = rolled.groupBy(*keys, "w").agg(F.min("n").alias("least"), F.count("*").alias("k"), F.max("meses").alias("meses")).where((F.col("least") >= p.index_least_rows) & (F.col("k") == F.col("meses")))
    chosen = good.groupBy(*keys).agg(F.min("w").alias("w"))
    own = rolled.join(chosen, [*keys, "w"])
    end = own.where("i = i1").select(*keys, F.col("median").alias("final"))
    factor = (F.col("final") / F.col("median")).alias("fator")
    wide = rolling_medians(rows, [], x, month, replace(p, index_windows=(p.index_fallback_window,)))
    wide = wide.crossJoin(F.broadcast(wide.where("i = i1").select(F.col("median").alias("final")))).select("i", "w", factor)  # a row each month
    same = [F.col(f"g.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    rest = rows.where(F.col(x).isNotNull() & F.col(month).isNotNull()).select(*keys).distinct().alias("g").join(chosen.alias("c"), same, "left_anti")
    return own.join(end, keys).select(*keys, "i", "w", factor).union(rest.crossJoin(F.broadcast(wide)).select(*keys, "i", "w", "fator"))
