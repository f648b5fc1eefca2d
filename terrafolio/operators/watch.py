"""What is watched from week to week: series and their last values, caches with an age, search interest, and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafolio.functions.expr import half_up
from terrafolio.functions.text import months_back


def series(points: DataFrame, today: Column) -> DataFrame:
    """serie, dia, valor, anterior, dia_anterior, var_mes, ano, dia_ano, var_ano of each series' last point that isn't in the future.

    Before: the point before it in monthly series, the last one a month earlier or more in daily ones; a year before: the last one
    at least twelve months earlier. ``points`` has serie, mensal, dia, valor; null values are no points.
    """
    known = points.where(F.col("valor").isNotNull() & (F.col("dia") <= today))
    last = known.groupBy("serie").agg(F.max("dia").alias("ultimo"), F.max_by("valor", "dia").alias("atual"), F.first("mensal").alias("mensal"))
    both = known.join(last.drop("mensal"), "serie")
    upto = lambda x, when: F.max_by(x, F.when(when, F.col("dia")))
    month = F.when(F.col("mensal"), F.col("dia") < F.col("ultimo")).otherwise(F.col("dia") <= months_back(F.col("ultimo"), 1))
    year = F.col("dia") <= months_back(F.col("ultimo"), 12)
    gap = lambda x: half_up(F.col("valor") - F.col(x), 2)
    out = both.groupBy("serie").agg(F.max("ultimo").alias("dia"), F.max("atual").alias("valor"), upto("valor", month).alias("anterior"), F.max(F.when(month, F.col("dia"))).alias("dia_anterior"), upto("valor", year).alias("ano"), F.max(F.when(year, F.col("dia"))).alias("dia_ano"))
    return out.select("serie", "dia", "valor", "anterior", "dia_anterior", gap("anterior").alias("var_mes"), "ano", "dia_ano", gap("ano").alias("var_ano"))


def with_fallback(names: DataFrame, new: DataFrame, old: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, desatualizado: the new value, or the last good one, marked as stale, where a source failed."""
    both = names.select(key).join(new.select(key, F.col(value).alias("_new")), key, "left").join(old.select(key, F.col(value).alias("_old")), key, "left")
    return both.select(key, F.coalesce("_new", "_old").alias(value), F.col("_new").isNull().alias("desatualizado"))


def freshness(sources: DataFrame, today: Column) -> DataFrame:
    """fonte, dias, estado: how old each source (fonte, dia, limite in days) is, and whether it is overdue."""
    days = F.datediff(today, "dia")
    return sources.select("fonte", days.alias("dias"), F.when(days.isNull(), "sem data").when(days > F.col("limite"), "atrasada").otherwise("em dia").alias("estado"))


def to_fetch(keys: DataFrame, cache: DataFrame, now: Column, days: int = 25, key: str = "bairro") -> DataFrame:
    """Keys that the cache (key, buscado) lacks, or has for ``days`` days or more."""
    fresh = cache.where(F.floor((F.unix_timestamp(now) - F.unix_timestamp("buscado")) / 86400) < days).select(key)
    return keys.select(key).join(fresh, key, "left_anti")


def refreshed(keys: DataFrame, cache: DataFrame, fetched: DataFrame, wanted: DataFrame, now: Column, key: str = "bairro") -> DataFrame:
    """key, valor, buscado, falhou: the cache after fetching; what came is new, what was wanted and didn't come keeps its value and day."""
    old = cache.select(key, F.col("valor").alias("_v"), F.col("buscado").alias("_b"))
    new = fetched.join(wanted, key, "left_semi").select(key, F.col("valor").alias("_n"))
    both = keys.select(key).join(old, key, "left").join(new, key, "left").join(wanted.select(key, F.lit(True).alias("_w")), key, "left")
    out = both.select(key, F.coalesce("_n", "_v").alias("valor"), F.when(F.col("_n").isNotNull(), now).otherwise(F.col("_b")).alias("buscado"), (F.col("_n").isNull() & F.coalesce("_w", F.lit(False))).alias("falhou"))
    return out.where("valor is not null")


def keyword_interest(results: DataFrame, keywords: DataFrame) -> DataFrame:
    """bairro, termo (null for all), media, meses: mean over months of the searches of all results that mean a place.

    ``results`` has id, texto, variantes, mes, n; ``keywords`` palavra, bairro, termo. A result counts once for a place, by
    whichever of its spellings, and once for each of its terms.
    """
    words = results.select("id", "mes", "n", F.explode(F.array_distinct(F.concat(F.array(F.lower("texto")), F.coalesce("variantes", F.array().cast("array<string>"))))).alias("palavra"))
    matched = words.join(keywords, "palavra")
    counted = lambda keys: matched.select("id", "mes", "n", *keys).distinct().groupBy(*keys, "mes").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n")).groupBy(*keys).agg(half_up(F.avg("n"), 0).alias("media"), F.count("*").alias("meses"))
    return counted(["bairro"]).select("bairro", F.lit(None).cast("string").alias("termo"), "media", "meses").union(counted(["bairro", "termo"]).select("bairro", "termo", "media", "meses"))


def interest_levels(rows: DataFrame, x: str) -> DataFrame:
    """``rows`` with ``nivel``: baixo below the value at a third of the sorted ones, alto from that at two thirds, medio between."""
    from terrafolio.functions.stats import tercile_cuts

    cuts = tercile_cuts(rows.where(F.col(x).isNotNull()), x).select(F.struct("low", "high")).scalar()
    return rows.withColumn("_c", cuts).withColumn("nivel", F.when(F.col(x) >= F.col("_c.high"), "alto").when(F.col(x) >= F.col("_c.low"), "medio").when(F.col(x).isNotNull(), "baixo")).drop("_c")


def parity(left: DataFrame, right: DataFrame, key: str, fields: list[str], tolerance: float = 0.011) -> DataFrame:
    """key, campo, a, b: fields that two engines disagree on by more than a tolerance, or that only one has."""
    a = left.select(key, *(F.col(f).cast("double").alias(f"a_{f}") for f in fields))
    b = right.select(key, *(F.col(f).cast("double").alias(f"b_{f}") for f in fields))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("campo"), F.col(f"a_{f}").alias("a"), F.col(f"b_{f}").alias("b")) for f in fields))).alias("x")
    rows = a.join(b, key, "full_outer").select(key, each).select(key, "x.*")
    return rows.where(F.col("a").isNull() != F.col("b").isNull()).union(rows.where(F.abs(F.col("a") - F.col("b")) > tolerance))


def weekly_changes(now: DataFrame, before: DataFrame, least: dict[str, float], share: float = 20.0) -> DataFrame:
    """bairro, campo, antes, agora, pct, causa: what changed by more than a share, and by a least amount, since the last snapshot."""
    both = now.alias("n").join(before.alias("o"), "bairro")
    each = F.array(*(F.struct(F.lit(f).alias("campo"), F.col(f"o.{f}").cast("double").alias("antes"), F.col(f"n.{f}").cast("double").alias("agora"), F.lit(float(x)).alias("minimo")) for f, x in least.items()))
    rows = both.select("bairro", F.explode(each).alias("x"), (F.col("n.fim") != F.col("o.fim")).alias("janela"), (F.col("n.revenda_12m") != F.col("o.revenda_12m")).alias("revendas")).select("bairro", "x.*", "janela", "revendas")
    change = (F.col("agora") - F.col("antes")) / F.col("antes") * 100
    cause = F.when(F.col("campo") == "revenda_12m", F.when(F.col("janela"), "a janela avançou").otherwise("guias novas ou atrasadas")).when(F.col("campo") == "stock_total", "anúncios entraram e saíram").otherwise(F.when(F.col("revendas"), "mudaram as revendas").otherwise("demais fatores"))
    kept = rows.where((F.col("antes") != 0) & (F.abs(change) > share) & (F.abs(F.col("agora") - F.col("antes")) >= F.col("minimo")))
    return kept.select("bairro", "campo", "antes", "agora", half_up(change, 1).alias("pct"), cause.alias("causa"))


def code_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """bairro, novos, sairam: listing codes that only one of two snapshots has; codes count once."""
    side = lambda rows: rows.groupBy("bairro").agg(F.collect_set("codigo").alias("c"))
    both = side(now).withColumnRenamed("c", "a").join(side(before).withColumnRenamed("c", "b"), "bairro", "full_outer")
    none = F.array().cast("array<bigint>")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    return both.select("bairro", F.size(F.array_except(a, b)).alias("novos"), F.size(F.array_except(b, a)).alias("sairam"))


def ranking(rows: DataFrame, score: str, name: str, small: str | None = None) -> DataFrame:
    """name, posto: best first, equal scores by name; small samples behind all others. One row a place."""
    order = [*([small] if small else []), F.desc(score), name]
    return rows.select(name, F.row_number().over(Window.orderBy(*order)).alias("posto"))


def prior_with_forbidden(rows: DataFrame, keys: str, forbidden: list[str]) -> DataFrame:
    """Rows whose array ``keys`` holds some that mustn't be there, and which."""
    hit = F.array_sort(F.array_intersect(keys, F.array(*map(F.lit, forbidden))))
    return rows.withColumn("proibidas", hit).where(F.size("proibidas") > 0)
