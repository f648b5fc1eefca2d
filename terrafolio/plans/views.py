"""The driver's tables seen as sales, listings and a cadastre, so that every operator runs on them; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafolio.functions.expr import half_up, month_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a sale: neighbourhood, type, building, area, value, day, month, nature, payment, and what orders them."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("bairro"), F.col("p_type").alias("tipo"))
    day = F.to_date("l_shipdate")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        F.col("l_orderkey").alias("pedido"),
        F.col("l_linenumber").alias("linha"),
        "bairro",
        "tipo",
        F.col("l_partkey").alias("endereco"),
        F.col("l_suppkey").alias("cartorio"),
        F.col("l_quantity").alias("area"),
        F.col("l_extendedprice").alias("valor"),
        half_up(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("m2"),
        F.col("l_discount").alias("desconto"),
        F.col("l_tax").alias("taxa"),
        F.col("l_linestatus").alias("natureza"),
        F.col("l_returnflag").alias("pagamento"),
        day.alias("dia"),
        month_index(day).alias("mes"),
    )


SALES = """sales AS (
  SELECT l_orderkey AS pedido, l_linenumber AS linha, p_brand AS bairro, p_type AS tipo, l_partkey AS endereco,
         l_suppkey AS cartorio, l_quantity AS area, l_extendedprice AS valor,
         floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS m2, l_discount AS desconto, l_tax AS taxa,
         l_linestatus AS natureza, l_returnflag AS pagamento, CAST(l_shipdate AS DATE) AS dia,
         CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER) AS mes
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def dear_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales at thirty times their price: the tables' prices are about a thirtieth of those that the limits on addresses'
    values are made for."""
    return sales(spark, sf_dir).withColumn("valor", F.col("valor") * 30)


DEAR = "dear AS (SELECT * REPLACE (valor * 30 AS valor) FROM sales)"


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an advertised unit: code, neighbourhood, type, building, area, asking price."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("codigo"),
        F.col("p_brand").alias("bairro"),
        F.col("p_type").alias("tipo"),
        F.col("p_partkey").alias("endereco"),
        F.col("p_name").alias("nome"),
        F.col("p_size").cast("double").alias("area"),
        half_up(F.col("p_retailprice") * F.col("p_size") * 1.6, 2).alias("pedido_valor"),
    )


LISTINGS = """listings AS (
  SELECT p_partkey AS codigo, p_brand AS bairro, p_type AS tipo, p_partkey AS endereco, p_name AS nome,
         CAST(p_size AS DOUBLE) AS area, floor(p_retailprice * p_size * 1.6 * 100 + 0.5) / 100 AS pedido_valor FROM part)"""


# --- deals and offers: the same tables at prices, areas and dates of a housing market, in words that both engines read alike
DEAL_COLUMNS = (
    "l_orderkey * 10 + l_linenumber AS id, p_brand AS bairro, concat('Z', l_partkey % 5) AS zona, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'apartamento' ELSE 'casa' END AS tipo, "
    "l_partkey * 3 + l_suppkey % 3 AS endereco, l_quantity * 4 AS area, l_extendedprice * 20 AS valor, floor(l_extendedprice * 5 / l_quantity * 100 + 0.5) / 100 AS m2, CAST(l_shipdate AS DATE) AS dia, "
    "CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INT) AS mes, CAST(year(l_shipdate) AS INT) AS ano, l_linestatus = 'F' AND l_discount < 0.09 AS revenda, l_linestatus = 'F' AND l_discount < 0.09 AND l_tax < 0.08 AS limpa, l_discount >= 0.09 AS planta, "
    "CASE l_suppkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '1.SFH' WHEN 2 THEN '2.MCMV' WHEN 3 THEN ' 3.C' WHEN 4 THEN '99.SFI' WHEN 5 THEN '' ELSE 'x' END AS financiamento, l_extendedprice * 20 * l_tax * (l_suppkey % 20) AS financiado, CAST(l_suppkey % 97 * 11 + 5 AS INT) AS unidade"
)
OFFER_COLUMNS = (
    "p_partkey AS codigo, p_brand AS bairro, concat('Z', p_partkey % 5) AS zona, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'apartamento' ELSE 'casa' END AS tipo, p_partkey * 3 + p_partkey % 3 AS endereco, p_name AS nome, "
    "CAST(p_size * 4 AS DOUBLE) AS area, CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN p_partkey % 31 = 0 THEN 0 ELSE floor(p_retailprice * p_size * (20 + p_partkey % 30)) END AS valor, p_size % 5 AS quartos, p_size % 4 AS vagas, "
    "CAST(p_partkey % 6 AS INT) AS situacao, CASE WHEN p_partkey % 23 > 0 THEN CAST(p_partkey * 7 % 900 AS INT) END AS idade, -243e-1 + p_partkey % 14 * 1e-1 AS lat, -4705e-2 + p_partkey % 10 * 1e-1 AS lon"
)
DEALS = f"deals AS (SELECT {DEAL_COLUMNS} FROM lineitem JOIN part ON l_partkey = p_partkey)"
OFFERS = f"offers AS (SELECT {OFFER_COLUMNS} FROM part)"


def _projected(frame: DataFrame, columns: str) -> DataFrame:
    depth, parts, last = 0, [], 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(columns[last:i])
            last = i + 1
    return frame.selectExpr(*(p.strip() for p in [*parts, columns[last:]]))


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deeds with their flags: id, bairro, zona, tipo, endereco, area, valor, m2, dia, mes, ano, revenda, limpa, planta and financing."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return _projected(joined, DEAL_COLUMNS)


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings: codigo, bairro, zona, tipo, endereco, nome, area, valor, quartos, vagas, situacao, idade, lat, lon."""
    return _projected(table(spark, sf_dir, "part"), OFFER_COLUMNS)
