"""Panels asked again for other ranges of price, from counts by price instead of the sales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafolio.functions.expr import half_up
from terrafolio.operators.period import guarded_trend
from terrafolio.params import DEFAULT, Params


def price_counts(sales: DataFrame, keys: Sequence[str], price: str, flags: dict[str, Column]) -> DataFrame:
    """keys, valor, k and a count for each flag: how many sales there are at each price.

    What any range of prices needs of the sales; to be written once. Sales without a price have a row of their own, and every range has
    them.
    """
    counted = [F.count_if(F.coalesce(flag, F.lit(False))).alias(name) for name, flag in flags.items()]
    return sales.groupBy(*keys, F.col(price).cast("double").alias("valor")).agg(F.count("*").alias("k"), *counted)


def in_ranges(counts: DataFrame, ranges: Sequence[tuple[str, float | None, float | None]], keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """faixa, keys, n, mediana and a sum for each flag, of each range (name, from, to; both ends in, null for open).

    Medians are exact: the values at the middle places of running counts. Places without a sale in a range have no row there.
    """
    asked = counts.sparkSession.createDataFrame([(name, low, high) for name, low, high in ranges], "faixa string, low double, high double")
    inside = F.col("valor").isNull() | ((F.coalesce(F.col("low"), F.col("valor")) <= F.col("valor")) & (F.col("valor") <= F.coalesce(F.col("high"), F.col("valor"))))
    rows = counts.join(F.broadcast(asked), inside)  # the ranges of one request
    priced = F.when(F.col("valor").isNotNull(), F.col("k")).otherwise(0)
    place = Window.partitionBy("faixa", *keys)
    run = place.orderBy("valor").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"upto": F.sum(priced).over(run), "priced": F.sum(priced).over(place)})
    holds = lambda at: (F.col("upto") > at) & (F.col("upto") - priced <= at)
    value = lambda at: F.max(F.when(holds(at), F.col("valor")))
    middle = (value(F.floor((F.col("priced") - 1) / 2)) + value(F.floor(F.col("priced") / 2))) / 2
    return rows.groupBy("faixa", *keys).agg(F.sum("k").alias("n"), middle.alias("mediana"), *(F.sum(f).alias(f) for f in flags))


def scores_in_ranges(facts: DataFrame, scope: Sequence[str] | None = None, p: Params = DEFAULT) -> DataFrame:
    """faixa, bairro, n, mediana, vendas_12m, score of ``in_ranges`` with the flags vendas_12m and vendas_anterior.

    Scores are scaled over all places of a range; ``scope`` only picks what is shown, afterwards.
    """
    rows = facts.withColumn("tendencia", guarded_trend(F.col("vendas_12m"), F.col("vendas_anterior"), p))
    every = Window.partitionBy("faixa")

    def score(x: str) -> Column:
        c, spread = F.col(x), F.stddev_pop(x).over(every)
        z = F.when(F.count(x).over(every) < 2, 0.0).otherwise((c - F.avg(x).over(every)) / F.when(spread > 0, spread).otherwise(1.0))
        return F.when(c.isNull(), -2.0).otherwise(z)

    rows = rows.withColumn("z", (score("vendas_12m") + score("tendencia")) / 2)
    low, high = F.min("z").over(every), F.max("z").over(every)
    rows = rows.withColumn("score", half_up(100 * (F.col("z") - low) / F.when(high > low, high - low).otherwise(1.0), 1))
    shown = rows if scope is None else rows.where(F.col("bairro").isin(*scope))
    return shown.select("faixa", "bairro", "n", half_up(F.col("mediana"), 2).alias("mediana"), "vendas_12m", "score")
