"""Valuation by comparable sales, with the error that leaving each sale out measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafolio.functions.expr import half_up
from terrafolio.functions.stats import quantile
from terrafolio.operators import order
from terrafolio.operators.period import part_quantiles
from terrafolio.params import DEFAULT, Params


def _matched(requests: DataFrame, sales: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Comparables of requests, told apart by key, area and own sale, that have their key and nearly their area: an equi-join with a
    range left to check."""
    comparable = sales.select(key, F.col("area").alias("area_c"), F.col("m2").alias("m2_c"), F.col("venda").alias("venda_c"))
    close = F.abs(F.col("area_c") - F.col("area")) <= F.col("area") * tolerance
    asked = requests.select(key, "area", "venda").distinct()
    return asked.join(comparable, key).where(close & ~F.col("venda_c").eqNullSafe(F.col("venda"))).select(key, "area", "venda", "m2_c")


def _by_rank(requests: DataFrame, sales: DataFrame, key: str, tolerance: float, least: int) -> DataFrame:
    """pedido_id, area, n, m2, p25, p75 of requests with ``least`` comparables, without pairing the two (see ``order``)."""
    values = sales.select(F.col(key).alias("key"), F.col("venda").alias("id"), F.lit(None).cast("string").alias("grp"), F.col("area").cast("double").alias("x"), F.col("m2").cast("double").alias("y"))
    own = sales.join(requests.where("venda is not null").select("venda", key).distinct(), ["venda", key], "left_semi").groupBy("venda", key).agg(F.min("area").cast("double").alias("own_x"), F.min("m2").cast("double").alias("own_y"))
    asks = requests.join(own, ["venda", key], "left").select(F.col("pedido_id").alias("ask"), F.col(key).alias("key"), F.col("area").cast("double").alias("a"), F.lit(-tolerance).alias("tol"), F.lit(None).cast("string").alias("grp"), F.when(F.col("own_x").isNotNull(), F.col("venda")).alias("own"), "own_x", "own_y")
    asks = order.kept(order.counts(values, asks).where(F.col("n") >= least))
    found = order.quantiles(values, asks, (0.25, 0.5, 0.75))
    return found.select(F.col("ask").alias("pedido_id"), F.col("a").alias("area"), "n", F.col("q")[1].alias("m2"), F.col("q")[0].alias("p25"), F.col("q")[2].alias("p75"))


def estimate(requests: DataFrame, sales: DataFrame, least: dict[str, int] | None = None, p: Params = DEFAULT) -> DataFrame:
    """pedido_id, nivel, n, m2, estimativa, confianca of each request that has enough comparables at some level.

    Levels are tried from the building to the neighbourhood's type. ``requests`` has pedido_id, endereco, bairro, tipo, area
    and venda (its own sale, which isn't compared, or null); ``sales`` has venda, endereco, bairro, tipo, area, m2.
    Alike requests of a building are compared once; in a neighbourhood, quartiles come by rank, so no request meets all sales of its type.
    """
    least = least or {"predio": 3, "bairro": 8}
    local = F.concat_ws("|", "bairro", "tipo")
    sales, requests = (rows.where("area > 0").withColumn("local", local) for rows in (sales.where("m2 is not null"), requests))
    alike = ["endereco", "area", "venda"]
    of_building = _matched(requests, sales, "endereco", p.tolerance_wide).groupBy(*alike).agg(F.count("*").alias("n"), F.median("m2_c").alias("m2"), quantile("m2_c", 0.25).alias("p25"), quantile("m2_c", 0.75).alias("p75")).where(F.col("n") >= least["predio"])
    first = order.settled(order.matched(requests.select("pedido_id", *alike), of_building, alike).select("pedido_id", "area", "n", "m2", "p25", "p75"))
    rest = requests.join(first.select("pedido_id"), "pedido_id", "left_anti")
    second = _by_rank(rest, sales, "local", p.tolerance_first, least["bairro"])
    level = lambda rows, name: rows.select("pedido_id", F.lit(name).alias("nivel"), "area", "n", "m2", "p25", "p75")
    return _finished(level(first, "predio").union(level(second, "bairro")), p)


def _finished(found: DataFrame, p: Params, *also: str) -> DataFrame:
    sure = (F.col("nivel") == "predio") & (F.col("n") >= 5) & (F.col("p75") / F.col("p25") <= p.homogeneous_ratio)
    confidence = F.when(sure, "alta").when(F.col("nivel") == "predio", "media").otherwise("baixa")
    return found.select("pedido_id", "nivel", "n", half_up(F.col("m2"), 2).alias("m2"), half_up(F.col("m2") * F.col("area"), 0).alias("estimativa"), confidence.alias("confianca"), *also)


def leave_one_out(sales: DataFrame, least: dict[str, int] | None = None, p: Params = DEFAULT, also: Sequence[str] = ()) -> DataFrame:
    """What ``estimate`` says of each sale if it isn't compared with itself; the sale is its pedido_id. Columns ``also`` of the sales are kept.

    Every sale is a request here. Sales of a building are compared with each other in batches of many buildings; in one of many sales, and
    in neighbourhoods, quartiles come by rank (see ``order``): a place never meets all of itself.
    """
    least = least or {"predio": 3, "bairro": 8}
    shares = (0.25, 0.5, 0.75)
    rows = sales.where("area > 0").select("venda", F.col("area").cast("double").alias("x"), F.col("m2").cast("double").alias("y"), F.col("endereco").alias("key"), F.concat("bairro", F.lit("|"), "tipo").alias("local"), *also)
    many = order.kept(rows.where("key is not null").groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > order.FEW).select("key"))
    first = order.of_the_others(rows.where("key is not null"), p.tolerance_wide, shares)
    none = {"n": F.lit(0).cast("long"), "q": F.lit(None).cast("array<double>")}
    first = first.unionByName(rows.where("key is null").withColumns(none))
    if not many.isEmpty():
        large = rows.join(many, "key", "left_semi")
        text = large.withColumn("key", F.col("key").cast("string"))
        found = _ranked(text, text, p.tolerance_wide, shares).withColumn("key", F.col("key").cast(rows.schema["key"].dataType))
        first = first.unionByName(found.select(*first.columns))
    first = order.kept(first)
    near = F.col("n") >= least["predio"]
    level = lambda found, name: found.select(F.col("venda").alias("pedido_id"), F.lit(name).alias("nivel"), F.col("x").alias("area"), "n", F.col("q")[1].alias("m2"), F.col("q")[0].alias("p25"), F.col("q")[2].alias("p75"), *also)
    places = first.where("local is not null").drop("n", "q").withColumn("key", F.col("local"))
    rest = first.where(~near & F.col("local").isNotNull()).drop("n", "q").withColumn("key", F.col("local"))
    second = _ranked(rest, places, p.tolerance_first, shares).where(F.col("n") >= least["bairro"])
    return _finished(level(first.where(near), "predio").union(level(second, "bairro")), p, *also)


def _ranked(rows: DataFrame, sales: DataFrame, tolerance: float, shares: Sequence[float]) -> DataFrame:
    """``rows`` (key, x, y, ..), each one of ``sales``, with ``n`` and ``q`` of ``order.of_the_others``, by rank."""
    values = sales.where("y is not null").select("key", F.lit(None).cast("string").alias("grp"), "x", "y")
    more = {"grp": F.lit(None).cast("string"), "tol": F.lit(tolerance), "a": F.col("x"), "own": F.when(F.col("y").isNotNull(), F.lit(1)), "own_x": F.col("x"), "own_y": F.col("y")}
    asks = order.kept(order.counts(values, rows.withColumns(more)))
    none = asks.where("n = 0").withColumn("q", F.lit(None).cast("array<double>"))
    return order.quantiles(values, asks, shares).unionByName(none).select(*rows.columns, "n", "q")


def calibration(estimates: DataFrame, real: DataFrame | None = None) -> DataFrame:
    """nivel, confianca, n, erro_mediano, erro_p75 (%): by level and confidence, and by level (confidence ``*``).

    ``real`` has pedido_id and valor, where the estimates don't have valor themselves. No level meets in one task.
    """
    both = estimates if real is None else estimates.join(real, "pedido_id")
    both = order.kept(both.select("nivel", "confianca", (F.abs(F.col("estimativa") - F.col("valor")) / F.col("valor") * 100).alias("erro")))
    parts = F.explode(F.array("confianca", F.lit("*"))).alias("confianca")
    counts = both.groupBy("nivel", "confianca").agg(F.count("*").alias("n")).select("nivel", parts, "n").groupBy("nivel", "confianca").agg(F.sum("n").alias("n"))
    cuts = part_quantiles(both, "nivel", "confianca", "erro", [0.5, 0.75]).drop("n")
    return counts.join(cuts, ["nivel", "confianca"], "left").select("nivel", "confianca", "n", half_up(F.col("q")[0], 4).alias("erro_mediano"), half_up(F.col("q")[1], 4).alias("erro_p75"))
