"""Address-level liquidity and the prospects that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafolio.functions.stats import majority
from terrafolio.operators.period import launches
from terrafolio.params import DEFAULT, Params


def liquidity(sales: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """By address: its neighbourhood (that of most of its sales, the first by name of equals), sales, price spread, area range,
    and its status: unico, incoerente, lancamento or prospecto."""
    sales = sales.select("endereco", "bairro", "valor", "area", "dia").repartition("endereco")  # few sales each: nothing to gain from counting before they meet
    places = majority(sales, ["endereco"], "bairro").select("endereco", F.col("winner").alias("bairro"))
    stats = sales.groupBy("endereco").agg(
        F.count("*").alias("n"),
        F.min("valor").alias("menor"),
        F.max("valor").alias("maior"),
        F.percentile("valor", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
        F.min("area").alias("area_min"),
        F.max("area").alias("area_max"),
    )
    rows = stats.join(launches(sales, "endereco", p=p), "endereco").join(places, "endereco", "left")
    odd = (F.col("menor") < p.prospect_least_value) | (F.col("maior") / F.col("menor") > p.prospect_max_ratio)
    status = F.when(F.col("n") == 1, "unico").when(odd, "incoerente").when(F.col("lancamento"), "lancamento").otherwise("prospecto")
    wide = F.col("area_max") / F.col("area_min") > p.area_max_ratio
    keep = lambda c, when: F.when(when, F.col(c)).alias(c)
    rows = rows.withColumns({c: F.element_at("_q", k) for k, c in enumerate(("p25", "mediana", "p75"), 1)})
    return rows.select("endereco", "bairro", "n", "mediana", keep("p25", F.col("n") >= 4), keep("p75", F.col("n") >= 4), keep("area_min", ~wide), keep("area_max", ~wide), status.alias("situacao"))


def top_prospects(addresses: DataFrame, top: int = 30) -> DataFrame:
    """The prospects of most sales."""
    return addresses.where("situacao = 'prospecto'").orderBy(F.desc("n"), F.lower("bairro"), "endereco").limit(top)


def discards(addresses: DataFrame) -> DataFrame:
    return addresses.groupBy("situacao").agg(F.count("*").alias("enderecos"), F.sum("n").alias("vendas"))
