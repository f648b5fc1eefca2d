"""The publish gate: named checks, each of which counts the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafolio.operators import history


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """check, n: how many rows each check's query finds; the checks pass if all are 0."""
    counted = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, rows in checks.items()]
    return reduce(DataFrame.union, counted)


def reconciliation(read: DataFrame, kept: DataFrame, audit: DataFrame) -> DataFrame:
    """A row if the rows read aren't those kept and those left out by reason."""
    return read.agg(F.count("*").alias("a")).where(F.col("a") != kept.agg(F.count("*")).scalar() + F.coalesce(audit.agg(F.sum("n")).scalar(), F.lit(0)))


def volume_change(now: DataFrame, before: DataFrame, key: str, most: float = 0.30) -> DataFrame:
    """Keys whose counts changed by more than a share."""
    a, b = now.groupBy(key).agg(F.count("*").alias("a")), before.groupBy(key).agg(F.count("*").alias("b"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return both.where(F.abs(F.col("a") - F.col("b")) > most * F.greatest("b", F.lit(1)))


def shares_off_100(mix: DataFrame, keys: list[str]) -> DataFrame:
    return mix.groupBy(*keys).agg(F.sum("pct").alias("s")).where(F.abs(F.col("s") - 100) > 1e-6)


def band_order(rows: DataFrame) -> DataFrame:
    """Rows whose quartiles and median aren't in order."""
    return rows.where("p25 is not null and not (p25 <= mediana and mediana <= p75)")


def index_bounds(index: DataFrame, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Factors out of bounds, and last months whose factor isn't 1."""
    last = index.agg(F.max("i")).scalar()
    return index.where(~F.col("fator").between(low, high) | ((F.col("i") == last) & (F.abs(F.col("fator") - 1) > 1e-9)))


def history_order(state: DataFrame) -> DataFrame:
    """Listings first seen after last seen, or that left before they were last seen."""
    return state.where("visto_primeira > visto_ultima or saida <= visto_ultima")


def header_layout(cells: DataFrame, names: dict[str, str], columns: list[str]) -> DataFrame:
    """sheet, problema: sheets without a header row (``E`` says Bairro), with empty header columns, or with other names than known.

    The header is the first such row of a sheet, wherever it stands.
    """
    header = F.min_by("cells", F.when(F.col("cells")["E"] == "Bairro", F.col("row_num"))).alias("h")
    sheets = cells.groupBy("sheet").agg(header, F.max(F.coalesce(F.col("cells")["E"] == "Bairro", F.lit(False))).alias("has"))
    cell = lambda c: F.coalesce(F.col("h")[c], F.lit(""))
    empty = F.exists(F.array(*(cell(c) for c in columns)), lambda x: x == "")
    found = [F.when(~F.col("has"), "sem cabeçalho"), F.when(F.col("has") & empty, "colunas vazias")]
    found += [F.when(F.col("has") & (cell(c) != name), f"coluna {c}") for c, name in names.items()]
    return sheets.select("sheet", F.explode(F.array_compact(F.array(*found))).alias("problema"))


def missing_or_null(panel: DataFrame, wanted: DataFrame, key: str, required: list[str]) -> DataFrame:
    """chave, problema: wanted keys that the panel lacks, and rows of it without a required value."""
    absent = wanted.select(key).distinct().join(panel.select(key), key, "left_anti").select(F.col(key).alias("chave"), F.lit("sem linha").alias("problema"))
    empty = F.explode(F.array_compact(F.array(*(F.when(F.col(c).isNull(), f"sem {c}") for c in required))))
    return absent.union(panel.select(F.col(key).alias("chave"), empty.alias("problema")))


def parity(panel: DataFrame, derived: DataFrame, keys: list[str], columns: list[str], tolerance: float = 0.011) -> DataFrame:
    """keys, problema: where a panel and a second derivation of it differ: a key of only one of them, or a column by more than ``tolerance``.

    A null equals a null only. Columns that aren't numbers have to be equal.
    """
    mine, other = panel.select(*keys, F.lit(True).alias("here"), F.struct(*columns).alias("a")), derived.select(*keys, F.lit(True).alias("there"), F.struct(*columns).alias("b"))
    kinds = dict(panel.dtypes)

    def differs(c: str) -> Column:
        a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
        number = kinds[c].split("(")[0] in ("int", "bigint", "smallint", "tinyint", "float", "double", "decimal")
        return F.coalesce(F.abs(a - b) > tolerance, a.isNull() != b.isNull()) if number else ~a.eqNullSafe(b)

    both = mine.join(other, keys, "full_outer")
    found = [F.when(F.col("here").isNull(), "só na conferência"), F.when(F.col("there").isNull(), "só no painel")]
    found += [F.when(F.col("here").isNotNull() & F.col("there").isNotNull() & differs(c), c) for c in columns]
    return both.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("problema"))


def medians_by_counts(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, n, mediana: medians from running counts of distinct values in order; a derivation that shares nothing with percentile functions."""
    counted = rows.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("k"))
    run = Window.partitionBy(*keys).orderBy(x)
    placed = counted.withColumns({"upto": F.sum("k").over(run.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("k").over(Window.partitionBy(*keys))})
    holds = lambda place: (F.col("upto") > place) & (F.col("upto") - F.col("k") <= place)
    at = lambda place: F.max(F.when(holds(place), F.col(x)))
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), ((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("mediana"))


def suspended_prices(segments: DataFrame, kind: str, suspended: tuple[str, ...], value: str) -> DataFrame:
    """Segments of a kind whose prices aren't compared, but are."""
    return segments.where(F.col(kind).isin(*suspended) & F.col(value).isNotNull())


def window_mismatch(bands: DataFrame, least: int = 30) -> DataFrame:
    """Bands whose period doesn't fit their sales: 12 or 24 months only with ``least`` or more, few only in 36 months and with fewer.

    ``bands`` has months, few, n (clean sales in the period).
    """
    enough, long = F.col("n") >= least, F.col("months") == 36
    return bands.where(~F.col("months").isin(12, 24, 36) | (~long & (~enough | F.col("few"))) | (long & (F.col("few") == enough)))


def stale_marks(rows: DataFrame, today, fresh_days: int = 30) -> DataFrame:
    """Rows whose age isn't that of their day (by more than one), or that are called fresh wrongly. ``rows`` has dia, idade, fresco, falhou."""
    age = F.datediff(F.lit(today).cast("date"), "dia")
    right = (F.col("idade") < fresh_days) & ~F.col("falhou")
    return rows.where(F.col("dia").isNull() | (F.abs(age - F.col("idade")) > 1) | ~F.col("fresco").eqNullSafe(right))


def mix_mismatch(mix: DataFrame, keys: list[str], few: int = 30, floor: int = 4) -> DataFrame:
    """keys, problema: mixes whose shares don't sum to 100, whose counts don't sum to the sales, with a wrong mark of few sales, or whose
    median of what was financed is over 100 % or given from fewer than ``floor``.

    ``mix`` has keys, vendas, n (array of counts), pct (array of shares), poucas, mediana, n_mediana.
    """
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    found = [
        F.when(F.abs(total("pct") - 100) > 0.05, "soma"),
        F.when(total("n") != F.col("vendas"), "contagem"),
        F.when(F.col("poucas") != (F.col("vendas") < few), "poucas"),
        F.when(F.col("mediana") > 100, "mediana"),
        F.when(F.col("mediana").isNotNull() & (F.col("n_mediana") < floor), "amostra"),
    ]
    return mix.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("problema"))


def history_mismatch(state: DataFrame, today: DataFrame) -> DataFrame:
    """codigo, problema: where the history that is to be kept doesn't fit the listings of today (codigo, preco).

    Codes that repeat, that are on sale but not active in it, that are active but not on sale, other prices, dates out of order, a price
    that has changed without a change being counted, or was counted changed without one.
    """
    per = state.groupBy("codigo").agg(F.count("*").alias("k"), *(F.first(c).alias(c) for c in state.columns if c != "codigo"))
    both = per.join(today.groupBy("codigo").agg(F.min("preco").alias("hoje")), "codigo", "full_outer")
    active, listed = F.col("k").isNotNull() & F.col("saida").isNull(), F.col("hoje").isNotNull()
    found = [
        F.when(F.col("k") > 1, "repetido"),
        F.when(listed & ~active, "não está ativo"),
        F.when(active & ~listed, "não está à venda"),
        F.when(active & listed & (F.col("preco_atual") != F.col("hoje")), "preço"),
        F.when((F.col("visto_primeira") > F.col("visto_ultima")) | (F.col("saida") <= F.col("visto_ultima")), "datas"),
        F.when((F.col("mudancas") == 0) & (F.col("preco_inicial") != F.col("preco_atual")), "mudança"),
    ]
    return both.select("codigo", F.explode(F.array_compact(F.array(*found))).alias("problema"))


def series_mismatch(series: DataFrame, wanted: list[str], today) -> DataFrame:
    """serie, problema: wanted series that are missing, dated later than today, current without a value, or whose change isn't that of their values.

    ``series`` has serie, dia, valor, anterior, variacao, atual.
    """
    listed = series.sparkSession.createDataFrame([(s,) for s in wanted], "serie string")
    absent = listed.join(series.select("serie"), "serie", "left_anti").select("serie", F.lit("falta").alias("problema"))
    change = F.round(F.col("valor") - F.col("anterior"), 2)
    found = [F.when(F.col("dia") > F.lit(today).cast("date"), "futuro"), F.when(F.col("atual") & F.col("valor").isNull(), "sem valor"), F.when(F.abs(change - F.col("variacao")) > 0.005, "variação")]
    return absent.union(series.select("serie", F.explode(F.array_compact(F.array(*found))).alias("problema")))


def not_settled(listings: DataFrame) -> DataFrame:
    """Codes that removing re-advertised units once more would take out of listings that are said to be free of them."""
    return listings.select("codigo").join(history.merge_readvertised(listings).select("codigo"), "codigo", "left_anti")
