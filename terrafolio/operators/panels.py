"""Panels of neighbourhoods: yearly counts, stock, payments, apartments, time correction, profiles, seals and readiness."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafolio.functions.expr import area_band, band_adherence, half_up, payment_category, price_alignment, weighted
from terrafolio.functions.stats import adaptive_window, majority, quantile, trim_iqr
from terrafolio.operators.geo import nearest_places
from terrafolio.operators.market import stock_demand
from terrafolio.operators.order import free, kept, matched, numbered
from terrafolio.operators.period import group_quantiles, rolling_medians
from terrafolio.operators.scoring import prospect_bonus
from terrafolio.operators.sheet import in_city
from terrafolio.params import DEFAULT, Params

# fixed values: categories of payment in their order, and those that banks finance
CATEGORIES = ("a_vista", "sfh", "mcmv", "sfi", "consorcio", "outros")
BANK = ("sfh", "mcmv", "sfi")
HOMES = ("apartamento", "casa")


def count_if(flag: Column) -> Column:
    return F.sum(F.when(flag, 1).otherwise(0))


# --- yearly and stock aggregations
def yearly(sales: DataFrame, places: DataFrame, years: list[int]) -> DataFrame:
    """bairro, ano, n, revendas, limpas, media, mediana of every place and year, also where nothing was sold.

    All sales count for volume; only clean ones for prices.
    """
    clean = F.when(F.col("limpa"), F.col("valor"))
    counts = sales.where(F.col("ano").isin(*years)).groupBy("bairro", "ano").agg(F.count("*").alias("n"), count_if(F.col("revenda")).alias("revendas"), F.count(clean).alias("limpas"), half_up(F.avg(clean), 2).alias("media"), half_up(F.median(clean), 2).alias("mediana"))
    grid = places.select("bairro", F.explode(F.array(*(F.lit(y).cast("int") for y in years))).alias("ano"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return grid.join(counts, ["bairro", "ano"], "left").select("bairro", "ano", zero("n"), zero("revendas"), zero("limpas"), "media", "mediana")


def stock(listings: DataFrame) -> DataFrame:
    """bairro, estoque, mediana (asked, without outliers), lat, lon (mean of the points in the city), antigos, pct_antigos."""
    inside = in_city(F.col("lat"), F.col("lon"))
    totals = listings.groupBy("bairro").agg(
        F.count("*").alias("estoque"),
        half_up(F.avg(F.when(inside, F.col("lat"))), 6).alias("lat"),
        half_up(F.avg(F.when(inside, F.col("lon"))), 6).alias("lon"),
        count_if(F.col("idade") > 365).alias("antigos"),
        half_up(F.try_divide(100.0 * count_if(F.col("idade") > 365), F.count("idade")), 1).alias("pct_antigos"),
    )
    asked = trim_iqr(listings, ["bairro"], "valor").groupBy("bairro").agg(half_up(F.median("valor"), 2).alias("mediana"))
    return totals.join(asked, "bairro", "left")


# --- payments
def payment_profile(sales: DataFrame, end: Column, p: Params = DEFAULT) -> DataFrame:
    """bairro, origem, tipo (or ``total``), janela, poucas, n_vendas, categoria, n, pct: all categories of every group.

    Clean resales and off-plan sales apart, each in its own adaptive window; percentages add up to 100.0, the largest remainders
    rounded up, earlier categories first of equals. Sales without a known type count in the total only.
    """
    keys = ["bairro", "origem", "tipo"]
    some = _financed(sales, end).select("*", F.explode(F.when(F.col("tipo").isin(*HOMES), F.array("tipo", F.lit("total"))).otherwise(F.array(F.lit("total")))).alias("grupo")).drop("tipo").withColumnRenamed("grupo", "tipo")
    windows = adaptive_window(some, keys, "mes", F.col("fim"), p)
    inside = some.join(windows, keys).where((F.col("mes") <= F.col("fim")) & (F.col("mes") > F.col("fim") - F.col("months")))
    counts = inside.groupBy(*keys).agg(F.first("months").alias("janela"), F.first("few").alias("poucas"), F.count("*").alias("n_vendas"), *(count_if(F.col("categoria") == c).alias(c) for c in CATEGORIES))
    exact = [F.col(c) * 1000 / F.col("n_vendas") for c in CATEGORIES]
    long = counts.select(*keys, "janela", "poucas", "n_vendas", F.posexplode(F.array(*(F.struct(F.lit(c).alias("categoria"), F.col(c).alias("n"), F.floor(e).alias("base"), half_up(e - F.floor(e), 9).alias("resto")) for c, e in zip(CATEGORIES, exact)))).alias("k", "c"))
    w = Window.partitionBy(*keys)
    missing = 1000 - F.sum("c.base").over(w)
    up = F.row_number().over(w.orderBy(F.desc("c.resto"), "k")) <= missing
    return long.select(*keys, "janela", "poucas", "n_vendas", "c.categoria", "c.n", ((F.col("c.base") + F.when(up, 1).otherwise(0)) / 10).alias("pct"))


def _financed(sales: DataFrame, end: Column) -> DataFrame:
    origin = F.when(F.col("limpa"), "revenda").when(F.col("planta"), "planta")
    return sales.withColumns({"origem": origin, "categoria": payment_category(F.col("financiamento")), "fim": end}).where("origem is not null and dia is not null")


def financing(sales: DataFrame, end: Column, least: int = 10) -> DataFrame:
    """origem, categoria, n, inconsistentes, financiadas, mediana (% financed, of bank loans with a plausible amount).

    Cash with a financed amount, and a loan without one between 0 and the price, don't fit. Few amounts give no median.
    """
    rows = _financed(sales, end)
    much = F.coalesce("financiado", F.lit(0.0))
    plausible = (much > 0) & (much <= F.col("valor"))
    odd = F.when(F.col("categoria") == "a_vista", much > 0).otherwise(~plausible)
    share = F.when(F.col("categoria").isin(*BANK) & plausible, much / F.col("valor"))
    out = rows.groupBy("origem", "categoria").agg(F.count("*").alias("n"), count_if(odd).alias("inconsistentes"), F.count(share).alias("financiadas"), F.median(share).alias("m"))
    return out.select("origem", "categoria", "n", "inconsistentes", "financiadas", F.when(F.col("financiadas") >= least, half_up(100 * F.col("m"), 1)).alias("mediana"))


def ranked_shares(rows: DataFrame, keys: list[str], x: str, shares: list[float]) -> DataFrame:
    """keys, n and q_<share> columns: the values at nearest ranks ``floor(share * (n - 1))`` of each group, from numbered rows."""
    w = Window.partitionBy(*keys)
    numbered = rows.where(F.col(x).isNotNull()).select(*keys, x, (F.row_number().over(w.orderBy(x)) - 1).alias("k"), F.count("*").over(w).alias("n"))
    at = lambda s: F.max(F.when(F.col("k") == F.floor(F.lit(s) * (F.col("n") - 1)), F.col(x)))
    return numbered.groupBy(*keys).agg(F.max("n").alias("n"), *(at(s).alias(f"q_{int(round(100 * s))}") for s in shares))


# --- apartments by band
def apartment_panel(sales: DataFrame, listings: DataFrame, end: Column, p: Params = DEFAULT) -> DataFrame:
    """bairro, faixa, janela, poucas, n, mediana, p25, p75 (whole prices of clean resales in the adaptive window), anuncios.

    Prices per m2 aren't compared for apartments. Segments without sales have the longest window and few sales.
    """
    keys = ["bairro", "faixa"]
    flats = sales.where("tipo = 'apartamento' and limpa and dia is not null").withColumns({"faixa": area_band(F.col("area"), p), "fim": end}).where("faixa is not null")
    known = flats.where((F.col("mes") <= F.col("fim")) & (F.col("mes") > F.col("fim") - p.adaptive_windows[-1]))
    windows = adaptive_window(known, keys, "mes", F.col("fim"), p)
    inside = known.join(windows, keys).where(F.col("mes") > F.col("fim") - F.col("months"))
    paid = inside.groupBy(*keys).agg(F.first("months").alias("janela"), F.first("few").alias("poucas"), F.count("*").alias("n"), half_up(F.median("valor"), 2).alias("mediana"), half_up(quantile("valor", 0.25), 2).alias("p25"), half_up(quantile("valor", 0.75), 2).alias("p75"))
    asked = listings.where("tipo = 'apartamento' and valor > 0 and area > 0").withColumn("faixa", area_band(F.col("area"), p)).groupBy(*keys).agg(F.count("*").alias("anuncios"))
    both = paid.join(asked, keys, "full_outer")
    return both.select(*keys, F.coalesce("janela", F.lit(p.adaptive_windows[-1])).alias("janela"), F.coalesce("poucas", F.lit(True)).alias("poucas"), F.coalesce("n", F.lit(0)).alias("n"), "mediana", "p25", "p75", F.coalesce("anuncios", F.lit(0)).alias("anuncios"))


# --- correction of prices to the base month
def time_factors(sales: DataFrame, start: Column, end: Column, p: Params = DEFAULT) -> DataFrame:
    """zona, tipo, i, janela, minimo, fator: what brings a price of month i to the month ``end``.

    A place and type has its own index, of the shortest window of which every month has enough clean sales; all others have
    that of their type in the whole city, with janela null. The last month's factor is 1.
    """
    known = sales.where(F.col("tipo").isin(*HOMES) & F.col("limpa") & (F.col("m2") > 0)).withColumns({"i0": start, "i1": end}).where("mes between i0 and i1")
    rolled = rolling_medians(known, ["zona", "tipo"], "m2", "mes", p, ends=("i0", "i1"))
    sound = rolled.groupBy("zona", "tipo", "w").agg(F.min("n").alias("minimo"), F.count("*").alias("k"), (F.max("i") - F.min("i") + 1).alias("span"), F.max("meses").alias("meses")).where((F.col("minimo") >= p.index_least_rows) & (F.col("k") == F.col("meses")))
    chosen = sound.groupBy("zona", "tipo").agg(F.min_by(F.struct("w", "minimo"), "w").alias("c")).select("zona", "tipo", F.col("c.w").alias("w"), F.col("c.minimo").alias("minimo"))
    chosen = kept(chosen)
    own = rolled.join(chosen, ["zona", "tipo", "w"])
    last = lambda rows, keys: rows.withColumn("fator", F.max(F.when(F.col("i") == F.col("i1"), F.col("median"))).over(Window.partitionBy(*keys)) / F.col("median"))
    found = last(own, ["zona", "tipo"]).select("zona", "tipo", "i", F.col("w").alias("janela"), "minimo", "fator")
    rest = kept(rolled.select("zona", "tipo").distinct().join(chosen, ["zona", "tipo"], "left_anti"))
    if not rest.isEmpty():  # the city's index, of the types that need it
        needed = known.join(rest.select("tipo").distinct(), "tipo", "left_semi")
        city = rolling_medians(needed, ["tipo"], "m2", "mes", replace(p, index_windows=(p.index_fallback_window,)), ends=("i0", "i1"))
        found = found.union(rest.join(last(city, ["tipo"]), "tipo").select("zona", "tipo", "i", F.lit(None).cast("int"), F.lit(None).cast("long"), "fator"))
    return kept(found)


def corrected(sales: DataFrame, factors: DataFrame, start: Column, end: Column) -> DataFrame:
    """``sales`` with ``fator``: 1 for unknown days and from the base month on, the first month's before the data begin."""
    at = F.greatest("_i0", F.least("_i1", "mes")).cast("int")
    dated = sales.withColumns({"_i0": start, "_i1": end}).withColumn("i", at)
    joined = dated.join(factors.select("zona", "tipo", "i", "fator"), ["zona", "tipo", "i"], "left")
    return joined.withColumn("fator", F.when(F.col("mes").isNull() | (F.col("mes") >= F.col("_i1")), 1.0).otherwise(F.coalesce("fator", F.lit(1.0)))).drop("_i0", "_i1", "i")


def house_reference(sales: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """zona, faixa, referencia, bruta, n: median per m2 of clean sales of houses, at today's prices and as they were.

    ``sales`` are ``corrected``.
    """
    rows = sales.where("limpa and tipo = 'casa' and m2 > 0").withColumn("faixa", area_band(F.col("area"), p)).where("faixa is not null")
    now, then = (group_quantiles(rows.withColumn("hoje", F.col("m2") * f), ["zona", "faixa"], "hoje", [0.5]) for f in (F.col("fator"), F.lit(1.0)))
    median = lambda name: half_up(F.element_at(name, 1), 2)
    return matched(now.select("zona", "faixa", F.col("q").alias("agora")), then, ["zona", "faixa"]).select("zona", "faixa", median("agora").alias("referencia"), median("q").alias("bruta"), "n")


def raw_segments(sales: DataFrame, least: int = 10, p: Params = DEFAULT) -> DataFrame:
    """zona, tipo, faixa, bruta: median per m2, as it was, of the segments with enough clean sales."""
    keys = ["zona", "tipo", "faixa"]
    rows = sales.where("limpa").withColumn("faixa", area_band(F.col("area"), p))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("k")).where(F.col("k") >= least)
    return matched(group_quantiles(rows, keys, "m2", [0.5]), sizes, keys).select(*keys, F.element_at("q", 1).alias("bruta"))


def building_prices(sales: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """endereco, n, mediana, razao, homogeneo, mediana_bruta, homogeneo_bruto of buildings with enough clean sales of flats."""
    rows = sales.where("limpa and tipo = 'apartamento'").withColumn("hoje", F.col("valor") * F.col("fator"))
    quarters = lambda x: F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = rows.select("endereco", "hoje", "valor").repartition("endereco").groupBy("endereco").agg(F.count("*").alias("n"), quarters("hoje").alias("_h"), quarters("valor").alias("_v"))
    ratio = lambda q: F.element_at(q, 3) / F.element_at(q, 1)
    stats = stats.select("endereco", "n", F.element_at("_h", 2).alias("mediana"), ratio("_h").alias("razao"), F.element_at("_v", 2).alias("mediana_bruta"), ratio("_v").alias("r"))
    return stats.where(F.col("n") >= p.building_least_sales).select("endereco", "n", "mediana", "razao", (F.col("razao") <= p.homogeneous_ratio).alias("homogeneo"), "mediana_bruta", (F.col("r") <= p.homogeneous_ratio).alias("homogeneo_bruto"))


# --- profiles with neighbours
def winning_profile(pairs: DataFrame, listings: DataFrame, places: DataFrame, least: int = 5, p: Params = DEFAULT) -> DataFrame:
    """lugar, nivel, low, high, p25, mediana, p75, n_faixa, nivel_perfil, quartos, vagas: the commonest area band and its prices.

    ``pairs`` (lugar, area, valor) of fewer than ``least`` sales are pooled with those of the nearest places; listings of the own
    place tell rooms and parking, or, with fewer than ``least`` of them in the band, those of the neighbours too.
    """
    own = places.select("lugar").join(pairs.groupBy("lugar").agg(F.count("*").alias("k")), "lugar", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    near = nearest_places(places.select(F.col("lugar").alias("id"), "lat", "lon"), p).select(F.col("id").alias("lugar"), F.col("vizinho").alias("de"))
    small = own.where(F.col("k") < least).select("lugar")
    sources = own.select("lugar", F.col("lugar").alias("de")).union(near.join(small, "lugar", "left_semi"))
    alone = small.join(near, "lugar", "left_anti")
    pooled = sources.join(alone, "lugar", "left_anti").join(pairs.withColumnRenamed("lugar", "de"), "de")
    bucket = pooled.where("area is not null").withColumn("b", F.floor(F.col("area") / p.bucket_width))
    best = bucket.groupBy("lugar", "b").agg(F.count("*").alias("m"), F.median("valor").alias("mediana"), quantile("valor", 0.25).alias("p25"), quantile("valor", 0.75).alias("p75"))
    band = best.groupBy("lugar").agg(F.min_by(F.struct("b", "mediana", "p25", "p75"), F.struct(-F.col("m"), "b")).alias("x")).select("lugar", (F.col("x.b") * p.bucket_width).alias("low"), ((F.col("x.b") + 1) * p.bucket_width).alias("high"), *(half_up(F.col(f"x.{c}"), 2).alias(c) for c in ("p25", "mediana", "p75")))
    level = F.when(F.col("low").isNull(), "insuficiente").when(F.col("k") >= least, "individual").otherwise("regional")
    bands = own.join(band, "lugar", "left").withColumn("nivel", level)
    inside = lambda rows: rows.where((F.col("area") >= F.col("low")) & (F.col("area") < F.col("high")))
    held = inside(bands.join(listings.select(F.col("lugar"), "area", "quartos", "vagas"), "lugar")).select("lugar", "quartos", "vagas")
    n_own = held.groupBy("lugar").agg(F.count("*").alias("n_faixa"))
    counted = bands.join(n_own, "lugar", "left").withColumn("n_faixa", F.coalesce("n_faixa", F.lit(0)))
    thin = counted.where((F.col("n_faixa") < least) & F.col("low").isNotNull()).select("lugar", "low", "high")
    others = inside(thin.join(near, "lugar").join(listings.select(F.col("lugar").alias("de"), "area", "quartos", "vagas"), "de")).select("lugar", "quartos", "vagas")
    pool = held.union(others)
    size = pool.groupBy("lugar").agg(F.count("*").alias("pool"))
    mode = lambda c: pool.where(F.col(c).isNotNull()).groupBy("lugar", c).count().groupBy("lugar").agg(F.min_by(c, F.struct(-F.col("count"), c)).alias(c))
    mine = lambda c: held.where(F.col(c).isNotNull()).groupBy("lugar", c).count().groupBy("lugar").agg(F.min_by(c, F.struct(-F.col("count"), c)).alias(f"{c}_p"))
    out = counted
    for extra in (size, mode("quartos"), mode("vagas"), mine("quartos"), mine("vagas")):
        out = out.join(extra, "lugar", "left")
    regional = (F.col("n_faixa") < least) & (F.coalesce("pool", F.lit(0)) >= 2)
    kind = F.when(F.col("n_faixa") >= least, "individual").when(regional, "regional").otherwise("insuficiente")
    pick = lambda c: F.when(regional, F.col(c)).otherwise(F.col(f"{c}_p")).alias(c)
    return out.select("lugar", "nivel", "low", "high", "p25", "mediana", "p75", "n_faixa", kind.alias("nivel_perfil"), pick("quartos"), pick("vagas"))


# --- seals, priorities, findings, readiness
def seals(places: DataFrame, low_cut: Column, scarce_cut: Column, high_cut: Column, small: int = 100, most: int = 2) -> DataFrame:
    """Flags of each place from revendas (12 months), estoque, no_perfil (listings in the band) and confiavel.

    Scarcity and stock out of profile are for places with enough resales, a reliable band and at most ``most`` listings in it, and
    never both.
    """
    demand = F.col("revendas")
    ratio, total = stock_demand(F.col("no_perfil"), demand), stock_demand(F.col("estoque"), demand)
    may = (demand >= small) & F.col("confiavel") & (F.col("no_perfil") <= most)
    scarce = may & (F.col("total") <= scarce_cut)
    return places.withColumns({"razao": ratio, "total": total}).select(
        "bairro", "razao", "total", (demand < small).alias("pequena"), ((F.col("razao") <= low_cut) & (demand > 0)).alias("oportunidade"), (F.col("total") >= high_cut).alias("saturacao"), scarce.alias("escassez"), (may & ~scarce & (F.col("estoque") > 0)).alias("fora_do_perfil")
    )


def cut_at(rows: DataFrame, x: str, share: float) -> Column:
    """The value at index ``floor(n * share)`` of the sorted ones, the last at most, as a scalar. One row a place."""
    sorted_ = F.array_sort(F.collect_list(x))
    n = F.size("v")
    return rows.agg(sorted_.alias("v")).select(F.element_at("v", F.least(n, F.floor(n * share + 1e-9).cast("int") + 1))).scalar()


def priorities(listings: DataFrame, scores: DataFrame, segments: DataFrame, bands: DataFrame, prospects: DataFrame, units: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """codigo, bairro, tipo, endereco, nome, valor, area, n_vendas, bonus, regua, alinhamento, aderencia, score, resumo.

    Flats have no price component, and bands of few sales no adherence; weights are spread over the others. ``scores`` has bairro,
    score; ``segments`` bairro, tipo, faixa, pago, pequena; ``bands`` bairro, tipo, low, high, few; ``prospects`` endereco, n;
    ``units`` endereco, unidades. Listings without a price, or of an unknown neighbourhood, are left out.
    """
    flat = F.coalesce(F.col("tipo") == "apartamento", F.lit(False))
    joined = (
        listings.where("valor > 0").withColumn("faixa", area_band(F.col("area"), p))
        .join(scores.select("bairro", F.col("score").alias("nota")), "bairro")
        .join(segments.select("bairro", "tipo", "faixa", F.when(~F.col("pequena"), F.col("pago")).alias("pago")), ["bairro", "tipo", "faixa"], "left")
        .join(bands.where(~F.col("few")).select("bairro", "tipo", "low", "high"), ["bairro", "tipo"], "left")
        .join(prospects.select("endereco", F.col("n").alias("vendas")), "endereco", "left")
        .join(units.select("endereco", "unidades"), "endereco", "left")
    )
    ratio = F.when((F.col("area") > 0) & (F.col("pago") > 0), F.col("valor") / F.col("area") / F.col("pago"))
    rows = joined.withColumns({"n_vendas": F.coalesce("vendas", F.lit(0)), "razao": F.when(~flat, ratio), "alinhamento": F.when(~flat, price_alignment(ratio)), "aderencia": band_adherence(F.col("valor"), F.col("low"), F.col("high"))})
    by_units = F.coalesce((F.col("unidades") >= 10) & ~F.coalesce(F.col("tipo") == "casa", F.lit(False)), F.lit(False))
    points = F.when(by_units, prospect_bonus(F.col("n_vendas"), F.col("unidades"), F.col("tipo"))).otherwise(prospect_bonus(F.col("n_vendas")))
    rows = rows.withColumns({"bonus": points, "regua": F.when(F.col("n_vendas") >= 2, F.when(by_units, "giro do prédio").otherwise("nº de vendas"))})
    score = weighted([(p.weight_resale, F.col("nota")), (p.weight_price, F.col("alinhamento")), (p.weight_band, F.col("aderencia")), (p.weight_prospect, F.col("bonus"))])
    return rows.select("codigo", "bairro", "zona", "tipo", "endereco", "nome", "valor", "area", "n_vendas", "bonus", "regua", half_up(F.col("alinhamento"), 1).alias("alinhamento"), half_up(F.col("aderencia"), 1).alias("aderencia"), half_up(score, 2).alias("score"), _summary().alias("resumo"))


def _summary() -> Column:
    """At most two phrases that say why."""
    r = F.col("razao")
    percent = lambda x: F.floor(x * 100 + 0.5).cast("int").cast("string")
    below = F.when((r < 0.7), F.concat(F.lit("R$/m² "), percent(1 - r), F.lit("% abaixo do histórico: checar"))).when((r > 1) & (F.col("alinhamento") < 60), F.concat(F.lit("R$/m² "), percent(r - 1), F.lit("% acima do pago"))).when((r <= 1) & (r < 0.97), F.concat(F.lit("R$/m² "), percent(1 - r), F.lit("% abaixo da mediana")))
    price = F.when(F.coalesce(F.col("tipo") == "apartamento", F.lit(False)), F.lit("sem comparação para apartamentos")).otherwise(below)
    phrases = [price, F.when(F.col("aderencia") >= 80, "na faixa de preço do bairro"), F.when(F.col("nota") >= 70, "bairro de revenda alta"), F.when(F.col("n_vendas") > 0, F.concat(F.lit("prédio com "), F.col("n_vendas").cast("string"), F.lit(" vendas")))]
    return F.array_join(F.slice(F.array_compact(F.array(*phrases)), 1, 2), " · ")


def findings(prioritised: DataFrame, buildings: DataFrame, segments: DataFrame, houses: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Every listing with something to compare it with: codigo, bairro, tipo, comparacao, referencia, desconto (%), achado,
    atencao, desconto_bruto.

    Flats against their building's median, if it is homogeneous; houses per m2 against the corrected reference of their band,
    or the raw one where there is none, if the segment isn't small. ``segments`` has zona, faixa, bruta; ``houses`` zona, faixa,
    referencia.
    """
    flats = prioritised.where("tipo = 'apartamento'").join(buildings, "endereco").select("codigo", "bairro", "nome", "tipo", F.lit("predio").alias("comparacao"), F.when(F.col("homogeneo"), F.col("mediana")).alias("referencia"), F.when(F.col("homogeneo_bruto"), F.col("mediana_bruta")).alias("bruta"), F.col("valor").alias("de"))
    banded = prioritised.where("coalesce(tipo, '') <> 'apartamento' and area > 0").withColumn("faixa", area_band(F.col("area"), p))
    compared = banded.join(segments.select("zona", "faixa", "tipo", "bruta"), ["zona", "faixa", "tipo"]).join(houses.select("zona", "faixa", "referencia"), ["zona", "faixa"], "left")
    rest = compared.where("bruta is not null").select("codigo", "bairro", "nome", "tipo", F.lit("m2").alias("comparacao"), F.coalesce("referencia", "bruta").alias("referencia"), "bruta", (F.col("valor") / F.col("area")).alias("de"))
    both = flats.union(rest)
    discount = lambda ref: half_up((1 - F.col("de") / F.col(ref)) * 100, 1)
    off = 1 - F.col("de") / F.col("referencia")
    return both.where("referencia is not null").select("codigo", "bairro", "nome", "tipo", "comparacao", half_up(F.col("referencia"), 2).alias("referencia"), discount("referencia").alias("desconto"), (off >= p.discount_cut / 100).alias("achado"), (off >= p.discount_attention / 100).alias("atencao"), discount("bruta").alias("desconto_bruto"))


def findings_by_place(found: DataFrame) -> DataFrame:
    """bairro, n_achados, elegiveis, pct of places with findings."""
    counts = found.groupBy("bairro").agg(count_if(F.col("achado")).alias("n_achados"), F.count("*").alias("elegiveis"))
    return counts.where("n_achados > 0").withColumn("pct", half_up(100 * F.col("n_achados") / F.col("elegiveis"), 1))


def readiness(places: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """bairro, pequena, f1, f2, f4, f5, f6, prontidao: factors weighted over those that are known.

    ``places`` has bairro, pequena, score, no_perfil (null without a reliable band), captacao (prospects), media10 (mean of the ten
    best times coverage), eleg, achados (of houses). f2 and f4 are rescaled over all places; without eligible stock f6 is 50.
    """
    ends = places.agg(*(F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in ("no_perfil", "captacao"))).select(F.struct("no_perfil", "captacao")).scalar()
    rows = places.withColumn("_ends", ends)
    scale = lambda c: 100 * (F.col(c) - F.col(f"_ends.{c}.low")) / F.when(F.col(f"_ends.{c}.high") > F.col(f"_ends.{c}.low"), F.col(f"_ends.{c}.high") - F.col(f"_ends.{c}.low")).otherwise(1.0)
    factors = {"f1": F.col("score"), "f2": scale("no_perfil"), "f4": scale("captacao"), "f5": F.coalesce("media10", F.lit(0.0)), "f6": F.when(F.coalesce("eleg", F.lit(0)) == 0, 50.0).otherwise(100 * F.coalesce("achados", F.lit(0)) / F.col("eleg"))}
    rows = rows.withColumns(factors)
    total = weighted([(w, F.col(f)) for f, w in (("f1", 0.25), ("f2", 0.25), ("f4", 0.15), ("f5", 0.25), ("f6", 0.10))])
    return rows.select("bairro", "pequena", *(half_up(F.col(f), 6).alias(f) for f in factors), half_up(total, 1).alias("prontidao"))


# --- prospecting
def live_units(listings: DataFrame) -> DataFrame:
    """endereco, n_hoje, unidades (codigo, valor, idade, antigo; by code) of listings that are neither launches nor being built."""
    live = listings.where(~F.coalesce(F.col("situacao").isin(3, 4), F.lit(False)))
    unit = F.struct("codigo", "valor", "idade", F.coalesce(F.col("idade") > 365, F.lit(False)).alias("antigo"))
    return live.groupBy("endereco").agg(F.count("*").alias("n_hoje"), F.array_sort(F.collect_list(unit)).alias("unidades"))


def prospect_panel(addresses: DataFrame, listings: DataFrame, flags: DataFrame, least_value: float = 800_000.0, least: int = 5) -> DataFrame:
    """bairro, grupo (its place among groups), posto, endereco, n, mediana, unico, tem_hoje.

    Prospects of a dear enough median; where a place has fewer than ``least``, its single-sale addresses join. Groups: scarce
    places first, then those out of profile, then by volume and name; in each, addresses without a live unit first, then
    by sales and name. ``addresses`` has endereco, nome, bairro, n, mediana, situacao; ``flags`` bairro, escassez, fora_do_perfil, volume.
    """
    dear = addresses.where((F.col("mediana") >= least_value) & F.col("situacao").isin("prospecto", "unico"))
    counts = dear.groupBy("bairro").agg(count_if(F.col("situacao") == "prospecto").alias("k"))
    chosen = dear.join(counts, "bairro").where((F.col("situacao") == "prospecto") | (F.col("k") < least))
    seen = chosen.join(live_units(listings).select("endereco", "n_hoje"), "endereco", "left").join(flags, "bairro")
    rows = seen.withColumns({"tem_hoje": F.coalesce(F.col("n_hoje") > 0, F.lit(False)), "unico": F.col("situacao") == "unico", "classe": F.when(F.col("escassez"), 0).when(F.col("fora_do_perfil"), 1).otherwise(2)})
    group = F.dense_rank().over(Window.orderBy("classe", F.desc("volume"), F.lower("bairro")))  # over places, not addresses
    places = rows.select("bairro", "classe", "volume").distinct().select("bairro", group.alias("grupo"))
    place = F.row_number().over(Window.partitionBy("bairro").orderBy("tem_hoje", F.desc("n"), F.lower("nome"), "endereco"))
    return rows.join(places, "bairro").select("bairro", "grupo", place.alias("posto"), "endereco", "nome", "n", "mediana", "unico", "tem_hoje", "escassez")


def prospect_week(panel: DataFrame, top: int = 30) -> DataFrame:
    """The week's addresses: repeated sales, no live unit; scarce places first, then by sales, place and name."""
    rows = panel.where(~F.col("unico") & ~F.col("tem_hoje"))
    return rows.orderBy(~F.col("escassez"), F.desc("n"), F.lower("bairro"), F.lower("nome"), "endereco").limit(top)


def prospect_search(addresses: DataFrame, place: str | None = None, low: float | None = None, high: float | None = None, kind: str | None = None, least_sales: int = 2, free_only: bool = False) -> DataFrame:
    """Prospects by place, value band [low, high), kind, number of sales and whether a unit is for sale today."""
    keep = F.col("n") >= least_sales
    for given, test in ((place, F.col("bairro") == place), (low, F.col("mediana") >= low), (high, F.col("mediana") < high), (kind, F.col("tipo") == kind)):
        keep = keep & test if given is not None else keep
    return addresses.where(keep & ~F.col("tem_hoje") if free_only else keep)


def within_prices(rows: DataFrame, x: str, low: float | None, high: float | None) -> DataFrame:
    """Rows whose price is unknown or within the range; to be applied to sales and listings before anything else."""
    test = F.lit(True)
    test = test & (F.col(x) >= low) if low is not None else test
    test = test & (F.col(x) <= high) if high is not None else test
    return rows.where(F.col(x).isNull() | test)


def displays(sales: DataFrame, listings: DataFrame) -> DataFrame:
    """endereco, nome: the last listing's spelling of an address, or the first sale's where none has one."""
    first = sales.where("nome is not null").groupBy("endereco").agg(F.min_by("nome", "id").alias("a"))
    last = listings.where("nome is not null").groupBy("endereco").agg(F.max_by("nome", "codigo").alias("b"))
    return first.join(last, "endereco", "left").select("endereco", F.coalesce("b", "a").alias("nome"))


def majority_kind(sales: DataFrame) -> DataFrame:
    """endereco, tipo: the commonest kind of home of an address, the first by name of equals; unknown kinds don't vote."""
    return majority(sales.where("tipo is not null").select("endereco", "tipo").repartition("endereco"), ["endereco"], "tipo").select("endereco", F.col("winner").alias("tipo"))


def every_nth(rows: DataFrame, order: list, tests: int) -> DataFrame:
    """About ``tests`` rows, evenly spaced in a total order."""
    at = free(rows, "_at")
    step = F.greatest(F.lit(1), F.floor(rows.agg(F.count("*")).scalar() / tests))
    return numbered(rows, [], order, at).where(F.pmod(at, step) == 0).drop(at)
