"""Scores of neighbourhoods and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafolio.functions.expr import band_adherence, half_up, price_alignment, weighted
from terrafolio.functions.stats import first_rows, rescale, zscores
from terrafolio.operators.period import guarded_trend, volume_12m
from terrafolio.params import DEFAULT, Params


def neighbourhood_score(sales: DataFrame, flag: Column, p: Params = DEFAULT) -> DataFrame:
    """bairro, vendas_12m, vendas_anterior, tendencia, score (0 to 100): the mean z-score of volume and guarded trend, rescaled."""
    counts = volume_12m(sales, ["bairro"], {"vendas": flag}, p=p)
    trend = counts.withColumn("tendencia", guarded_trend(F.col("vendas_12m"), F.col("vendas_anterior"), p))
    scored = zscores(trend, {"vendas_12m": "zv", "tendencia": "zt"})
    scaled = rescale(scored.withColumn("z", (F.col("zv") + F.col("zt")) / 2), "z", "s")
    return scaled.select("bairro", "vendas_12m", "vendas_anterior", half_up(F.col("tendencia"), 4).alias("tendencia"), half_up(F.col("s"), 1).alias("score"))


def prospect_bonus(n: Column, units: Column | None = None, kind: Column | None = None) -> Column:
    """Points for an address's sales: by turnover in buildings of ten units or more that aren't houses, else by their number.

    0 below two sales; more than 60 points need three.
    """
    by_sales = F.when(n >= 5, 100.0).when(n == 4, 80.0).when(n == 3, 60.0).when(n == 2, 40.0)
    points = by_sales
    if units is not None and kind is not None:
        turnover = n / units
        by_turnover = F.when(turnover < 0.07, 40.0).when(turnover < 0.10, 60.0).when(turnover < 0.15, 80.0).otherwise(100.0)
        points = F.when((units >= 10) & ~F.coalesce(kind == "casa", F.lit(False)), by_turnover).otherwise(by_sales)
    return F.when(F.coalesce(n, F.lit(0)) < 2, 0.0).when(n < 3, F.least(points, F.lit(60.0))).otherwise(points)


def listing_score(listings: DataFrame, scores: DataFrame, segments: DataFrame, bands: DataFrame, addresses: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """codigo, bairro, score: neighbourhood, price alignment, band adherence and prospects (0 for none), weighted over what is known.

    Neighbourhoods without a score drop out; the other sides are left joins on their keys.
    """
    joined = (
        listings.join(scores.select("bairro", "score"), "bairro")
        .join(segments.select("bairro", "tipo", "faixa", F.when(~F.col("pequena"), F.col("pago")).alias("pago")), ["bairro", "tipo", "faixa"], "left")
        .join(bands.where(~F.col("few")).select("bairro", "tipo", "low", "high"), ["bairro", "tipo"], "left")
        .join(addresses.where("situacao = 'prospecto'").select("endereco", F.col("n").alias("vendas")), "endereco", "left")
    )
    ratio = F.when((F.col("area") > 0) & (F.col("pago") > 0), F.col("pedido_valor") / F.col("area") / F.col("pago"))
    parts = [(p.weight_resale, F.col("score")), (p.weight_price, price_alignment(ratio)), (p.weight_band, band_adherence(F.col("pedido_valor"), F.col("low"), F.col("high"))), (p.weight_prospect, prospect_bonus(F.coalesce("vendas", F.lit(0))))]
    return joined.select("codigo", "bairro", half_up(weighted(parts), 1).alias("score"))


def top_mean(scored: DataFrame, key: str, x: str, order: list, top: int = 10) -> DataFrame:
    """key, n, media: the mean of a group's best few, times how many of them there are of ``top``."""
    best = first_rows(scored.where(F.col(x).isNotNull()), [key], order, top)
    return best.groupBy(key).agg(F.count("*").alias("n"), F.avg(x).alias("m")).select(key, "n", (F.col("m") * F.least(F.lit(1.0), F.col("n") / top)).alias("media"))
