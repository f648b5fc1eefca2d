"""Price bands, paid against asked, representative segments, alerts, payments and homogeneous buildings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafolio.functions.expr import area_band, half_up
from terrafolio.functions.stats import adaptive_window, first_rows, quantile, shares_of_100, trim_iqr
from terrafolio.operators.order import kept
from terrafolio.operators.period import group_quantiles
from terrafolio.params import DEFAULT, Params


def adaptive_band(sales: DataFrame, listings: DataFrame, keys: list[str], end: Column, p: Params = DEFAULT) -> DataFrame:
    """keys, months, few, n, low, high, stock: the middle half of prices in the adaptive window, and the listings inside it."""
    sales, end = sales.withColumn("_end", end), F.col("_end")
    windows = kept(adaptive_window(sales, keys, "mes", end, p))
    inside = kept(sales.join(windows, keys).where((F.col("mes") <= end) & (F.col("mes") > end - F.col("months"))).select(*keys, "months", "few", "valor"))
    sizes = inside.groupBy(*keys).agg(F.first("months").alias("months"), F.first("few").alias("few"), F.count("*").alias("n"))
    middle = group_quantiles(inside, keys, "valor", [0.25, 0.75]).select(*keys, F.element_at("q", 1).alias("low"), F.element_at("q", 2).alias("high"))
    bands = kept(sizes.join(middle, keys, "left"))
    stock = listings.join(bands.select(*keys, "low", "high"), keys).where(F.col("pedido_valor").between(F.col("low"), F.col("high"))).groupBy(*keys).agg(F.count("*").alias("stock"))
    return bands.join(stock, keys, "left").withColumn("stock", F.coalesce("stock", F.lit(0)))


def paid_and_asked(sales: DataFrame, listings: DataFrame, today: Column, p: Params = DEFAULT) -> DataFrame:
    """By neighbourhood, type and area band: medians per m2 paid and asked (trimmed), the gap, and recent sales.

    A segment of either side stays where the other has none.
    """
    keys = ["bairro", "tipo", "faixa"]
    paid = sales.withColumn("faixa", area_band(F.col("area"), p)).where("faixa is not null and m2 is not null")
    recent = F.datediff(today, "dia").between(0, p.recent_days)
    paid = paid.groupBy(*keys).agg(F.median("m2").alias("pago"), quantile("m2", 0.25).alias("p25"), quantile("m2", 0.75).alias("p75"), F.sum(F.when(recent, 1).otherwise(0)).alias("recentes"))
    asked = listings.withColumn("faixa", area_band(F.col("area"), p)).where("faixa is not null and area > 0 and pedido_valor is not null").withColumn("pedido_m2", F.col("pedido_valor") / F.col("area"))
    asked = trim_iqr(asked, keys, "pedido_m2", p).groupBy(*keys).agg(F.median("pedido_m2").alias("pedido"), F.count("*").alias("anuncios"))
    both = paid.join(asked, keys, "full_outer")
    gap = F.when(F.col("pago") > 0, half_up((F.col("pedido") - F.col("pago")) / F.col("pago") * 100, 1))
    return both.select(*keys, "pago", "p25", "p75", F.coalesce("recentes", F.lit(0)).alias("recentes"), "pedido", F.coalesce("anuncios", F.lit(0)).alias("anuncios"), gap.alias("gap"), (F.coalesce("recentes", F.lit(0)) < p.small_sample).alias("pequena"))


def suspended(segments: DataFrame, kinds: tuple[str, ...] = ("apartamento",)) -> DataFrame:
    """Segments whose gap is unknown where built and useful areas of a kind of home can't be compared."""
    return segments.withColumn("gap", F.when(~F.coalesce(F.col("tipo").isin(*kinds), F.lit(False)), F.col("gap")))


def representative(segments: DataFrame) -> DataFrame:
    """Each neighbourhood's segment of most recent sales, the first by type and band of equals."""
    return first_rows(segments, ["bairro"], [F.desc("recentes"), "tipo", "faixa"])


def gap_alerts(segments: DataFrame, least_gap: float = 20.0, least_listings: int = 3, top: int = 12) -> DataFrame:
    """The largest gaps of segments that are neither small nor thin."""
    wide = segments.where((F.abs("gap") >= least_gap) & ~F.col("pequena") & (F.col("anuncios") >= least_listings))
    return wide.orderBy(F.desc(F.abs("gap")), "bairro", "tipo", "faixa").limit(top)


def payment_mix(sales: DataFrame) -> DataFrame:
    """Shares of payments that add up to 100.0, by neighbourhood and type, and by neighbourhood (type ``total``)."""
    counts = sales.groupingSets([["bairro", "tipo", "pagamento"], ["bairro", "pagamento"]], "bairro", "tipo", "pagamento").agg(F.grouping("tipo").alias("g"), F.count("*").alias("n"))
    named = counts.where("g = 1 or tipo is not null").select("bairro", F.when(F.col("g") == 1, "total").otherwise(F.col("tipo")).alias("tipo"), "pagamento", "n")
    return shares_of_100(named, ["bairro", "tipo"], "pagamento", "n")


def building_stats(sales: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Quartiles per m2 of buildings with enough sales, and whether they are close together."""
    stats = sales.where("m2 is not null").groupBy("endereco").agg(F.count("*").alias("n"), quantile("m2", 0.25).alias("p25"), F.median("m2").alias("p50"), quantile("m2", 0.75).alias("p75"))
    return stats.where(F.col("n") >= p.building_least_sales).withColumn("homogeneo", F.col("p75") / F.col("p25") <= p.homogeneous_ratio)


def opportunities(listings: DataFrame, stats: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Listings well below their building's median price per m2, dearest discount first by ``ordem``."""
    joined = listings.where("area > 0").join(stats.where("homogeneo"), "endereco")
    discount = half_up((1 - F.col("pedido_valor") / F.col("area") / F.col("p50")) * 100, 1)
    found = joined.withColumn("desconto", discount).where(F.col("desconto") >= p.discount_cut)
    return found.select("codigo", "bairro", "endereco", "pedido_valor", "p50", "n", "desconto", (F.col("desconto") >= p.discount_attention).alias("atencao"))
