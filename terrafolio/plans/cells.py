"""The driver's sales written as the cells of monthly sheets, with every kind of flaw that sheets have; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafolio.plans.views import table

#: The places that the queries know by name.
PLACES = ("Brooklin", "Jardim América", "Pompéia", "Itaim Bibi", "Moema")
RAW_NAMES = ("Brooklin Novo", "JD AMERICA", "Vila Pompéia", "Itaim Bibi (SP)", "MOEMA", "Sé", "V. Itaquera")
MONTHS = ("JAN", "FEV", "MAR", "ABR", "MAI", "JUN", "JUL", "AGO", "SET", "OUT", "NOV", "DEZ")

#: Column letter -> SQL of the cell, in words that both engines read alike.
CELLS = {
    "A": "CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN 'S/N' WHEN k % 17 = 0 THEN concat(pk, '.5E3') ELSE concat(pk * 1000 + sk, '.0') END",
    "B": "concat(CASE sk % 4 WHEN 0 THEN 'R. ' WHEN 1 THEN 'Av ' WHEN 2 THEN 'Alameda ' ELSE 'prq ' END, nome, CASE WHEN pk % 5 = 0 THEN ' São-João (Norte)' ELSE '' END)",
    "C": "CASE WHEN k % 19 = 0 THEN NULL ELSE concat(CASE WHEN pk % 3 = 0 THEN '00' ELSE '' END, pk % 700, CASE WHEN k % 2 = 0 THEN '.0' ELSE '' END) END",
    "D": "CASE n WHEN 1 THEN concat('AP ', sk * 7 % 300 + 10) WHEN 2 THEN concat('apto. 0', sk % 90 + 100, ' E 2 VG') WHEN 3 THEN concat('TORRE B APT ', sk * 37 % 2000) WHEN 4 THEN ' casa E VG' WHEN 5 THEN NULL WHEN 6 THEN 'fundos' ELSE concat('BLOCO ', sk) END",
    "E": f"CASE WHEN k % 97 = 0 THEN 'Bairro' WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN concat('Torre ', pk % 9) ELSE CASE pk % 7 {' '.join(f'WHEN {i} THEN {chr(39)}{n}{chr(39)}' for i, n in enumerate(RAW_NAMES))} END END",
    "G": "CASE WHEN k % 23 = 0 THEN '' WHEN k % 2 = 0 THEN concat(1000000 + pk % 90000, '.0') ELSE concat('0131', pk % 10, '-0', sk % 90 + 10) END",
    "H": "CASE WHEN n <= 3 THEN '1.Compra e venda' WHEN n = 4 THEN ' 17.Resolução' WHEN n = 5 THEN '4.Arrematação' WHEN n = 6 THEN '2.Permuta' ELSE NULL END",
    "I": "CASE WHEN k % 101 = 0 THEN concat('-', v) WHEN k % 103 = 0 THEN '0' WHEN k % 107 = 0 THEN concat('R$ ', v) WHEN k % 2 = 0 THEN concat(v, '.50') ELSE concat(' ', v, ' ') END",
    "J": "CASE WHEN k % 109 = 0 THEN 'x' ELSE concat(s, '.0') END",
    "L": "CASE WHEN desconto < 0.02 THEN '50' WHEN desconto < 0.03 THEN 'n/d' WHEN desconto < 0.04 THEN NULL WHEN desconto < 0.05 THEN '99.99' ELSE '100.0' END",
    "N": "CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN concat(v * 2) ELSE concat(v) END",
    "O": "CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN ' 1.SFH' WHEN 2 THEN '2.MCMV' WHEN 3 THEN '3.Cons' WHEN 4 THEN '99.SFI' ELSE '' END",
    "P": "CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN '-' ELSE concat(v * (k % 8)) END",
    "W": "CASE WHEN k % 31 = 0 THEN 'x' ELSE concat(q * 20, '.0') END",
    "X": "CASE n WHEN 1 THEN '20' WHEN 2 THEN '20.0' WHEN 3 THEN '10' WHEN 4 THEN '21' WHEN 5 THEN '30' WHEN 6 THEN ' 14.00' ELSE NULL END",
}
SHEET_NAME = f"CASE WHEN k % 53 = 0 THEN 'LEGENDA' ELSE concat(CASE m {' '.join(f'WHEN {i + 1} THEN {chr(39)}{x}{chr(39)}' for i, x in enumerate(MONTHS))} END, '-', y) END"
BASE = "l_orderkey AS k, l_linenumber AS n, l_partkey AS pk, l_suppkey AS sk, CAST(l_quantity AS INT) AS q, CAST(floor(l_extendedprice) AS BIGINT) AS v, l_discount AS desconto, p_name AS nome, month(l_shipdate) AS m, year(l_shipdate) AS y"
CELLS_SQL = f"""raw AS (SELECT {BASE}, date_diff('day', DATE '1899-12-30', CAST(l_shipdate AS DATE)) AS s FROM lineitem JOIN part ON l_partkey = p_partkey),
  cells AS (SELECT {SHEET_NAME} AS sheet, k * 10 + n AS row_num, {", ".join(f'{sql} AS {letter}' for letter, sql in CELLS.items())} FROM raw)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr(*BASE.split(", "), "datediff(l_shipdate, date'1899-12-30') AS s")


def spread(spark: SparkSession, sf_dir: str, letters: str = "".join(CELLS)) -> DataFrame:
    """sheet, row_num, and the cells of some letters as columns; a map would be made whole for every row, whatever is read of it."""
    return _raw(spark, sf_dir).select(F.expr(SHEET_NAME).alias("sheet"), (F.col("k") * 10 + F.col("n")).alias("row_num"), *(F.expr(CELLS[x]).cast("string").alias(x) for x in letters))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sheet, row_num, cells (column letter -> text)."""
    pairs: list[Column] = [x for letter, sql in CELLS.items() for x in (F.lit(letter), F.expr(sql).cast("string"))]
    return _raw(spark, sf_dir).select(F.expr(SHEET_NAME).alias("sheet"), (F.col("k") * 10 + F.col("n")).alias("row_num"), F.create_map(*pairs).alias("cells"))


def places(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PLACES], "nome string")
