"""The audited clean layer: one reason for each row that is left out, and first-wins removal of repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafolio.functions.expr import half_up
from terrafolio.functions.stats import first_rows
from terrafolio.params import DEFAULT, Params


def dirty_value(value: Column, base: Column, p: Params = DEFAULT) -> Column:
    return F.when(value.isNull() | ~value.between(p.value_floor, p.value_ceiling), "irreal").when((base > 0) & (value < p.underdeclared_share * base), "subdeclarado")


def exclusion_reason(kind: Column, is_sale: Column, is_full: Column, value: Column, base: Column, p: Params = DEFAULT) -> Column:
    """The first rule that a row fails; null for clean rows."""
    return F.when(kind.isNull(), "sem_tipo").when(~F.coalesce(is_sale, F.lit(False)), "nao_venda").when(~F.coalesce(is_full, F.lit(False)), "parcial").otherwise(dirty_value(value, base, p))


def clean_layer(sales: DataFrame, kind: Column, is_sale: Column, is_full: Column, value: Column, base: Column, p: Params = DEFAULT) -> DataFrame:
    """``sales`` with ``motivo`` (null if clean) and ``limpa``; ``base`` is the value that the tax was computed on."""
    return sales.withColumn("motivo", exclusion_reason(kind, is_sale, is_full, value, base, p)).withColumn("limpa", F.col("motivo").isNull())


def audit(clean: DataFrame) -> DataFrame:
    """Rows by reason."""
    return clean.groupBy(F.coalesce("motivo", F.lit("limpa")).alias("motivo")).agg(F.count("*").alias("n"))


def dedup_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in a total order."""
    return first_rows(rows, keys, order)


def cap_exact_area(rows: DataFrame, order: list[str], p: Params = DEFAULT) -> DataFrame:
    """At most a few rows for each neighbourhood and exact area, the first in order."""
    keyed = rows.withColumn("_a", half_up(F.col("area"), 2))
    return first_rows(keyed, ["bairro", "_a"], order, p.cap_per_area).drop("_a")


#: Words of a complement that name a unit.
UNIT_WORDS = ("AP", "APTO", "APART", "TORRE", "BLOCO", "CASA", "UNIDADE")


def names_unit(complement: Column) -> Column:
    words = F.split(F.upper(F.trim(complement)), "[^A-Z0-9]+")
    return F.coalesce(F.arrays_overlap(words, F.array(*map(F.lit, UNIT_WORDS))), F.lit(False))


def sale_class(is_sale: Column, is_full: Column, usage: Column, complement: Column, financing: Column) -> Column:
    """revenda, planta, parcial or demais for market sales, null for other deeds: whole transfers of homes are resales; parts of
    a plot that name a unit, or were financed as homes are, are off-plan sales; other parts of homes are partial."""
    home = F.coalesce(usage.isin("10", "20"), F.lit(False))
    off_plan = names_unit(complement) | F.coalesce(financing.rlike(r"^[12]\."), F.lit(False))
    named = F.when(is_full & home, "revenda").when(is_full, "demais").when(home, "parcial").when(off_plan, "planta").otherwise("demais")
    return F.when(is_sale, named)
