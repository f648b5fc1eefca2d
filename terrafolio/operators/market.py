"""Smaller operators: search interest, floor effect, similar listings, rankings, regions and address search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafolio.functions.expr import half_up
from terrafolio.functions.stats import majority
from terrafolio.operators import order
from terrafolio.params import DEFAULT, Params

#: Upper ends of the bands of floors, from 1.
FLOOR_BANDS = (3, 7, 11, 15, 99)


def search_interest(rows: DataFrame) -> DataFrame:
    """bairro, media: monthly sums of all terms, then their mean. ``rows`` has bairro, termo, mes, n; repeats count once."""
    months = rows.dropDuplicates(["bairro", "termo", "mes"]).groupBy("bairro", "mes").agg(F.sum("n").alias("n"))
    return months.groupBy("bairro").agg(half_up(F.avg("n"), 6).alias("media"))


def floor_band(floor: Column) -> Column:
    """Number of the band, from 0; null for unknown floors and those out of all bands."""
    out = F.when(floor < 1, None)
    for k, top in enumerate(FLOOR_BANDS):
        out = out.when(floor <= top, k)
    return out


def floor_effect(sales: DataFrame, least: int = 4, spread: int = 5, rows: int = 200, low: float = 0.9, high: float = 1.1) -> DataFrame:
    """faixa, n, fator: what a band of floors adds, from sales of one building and area far enough apart; 1 if there are few.

    ``sales`` has endereco, area, andar, m2.
    """
    keyed = sales.where("andar is not null and m2 is not null").withColumn("_a", F.round("area"))
    groups = keyed.groupBy("endereco", "_a").agg(F.count("*").alias("_n"), (F.max("andar") - F.min("andar")).alias("_d"), F.median("m2").alias("_m")).where((F.col("_n") >= least) & (F.col("_d") >= spread))
    ratio = keyed.join(groups, ["endereco", "_a"]).select(floor_band(F.col("andar")).alias("faixa"), (F.col("m2") / F.col("_m")).alias("r"))
    out = ratio.groupBy("faixa").agg(F.count("*").alias("n"), F.median("r").alias("r"))
    return out.where("faixa is not null").select("faixa", "n", half_up(F.when(F.col("n") >= rows, F.greatest(F.lit(low), F.least(F.lit(high), F.col("r")))).otherwise(1.0), 6).alias("fator"))


def _band(x: Column, share: float) -> Column:
    """Bands of equal ratio for positive numbers, one band for the rest."""
    return F.when(x > 0, F.floor(F.log(x) / math.log1p(share))).otherwise(-(1 << 40)) if 0 < share < 1 else F.lit(0)


def _bands(x: Column, share: float) -> Column:
    """The bands of all numbers within ``share`` of ``x``, for positive ones with a hair to spare."""
    return F.sequence(_band(x * (1 - share) * (1 - 1e-9), share), _band(x * (1 + share) * (1 + 1e-9), share)) if 0 < share < 1 else F.array(F.lit(0))


def _nearest_in_price(asked: DataFrame, stock: DataFrame, strata: list[str], most: int, within: Column | None = None) -> DataFrame:
    """strata, _v and the ``most`` rows of ``stock`` (strata, price, codigo, ..) whose price is nearest to ``_v``, then the first by code.

    ``asked`` is distinct. Equal prices of a stratum are one, of which only the first codes can be shown.
    """
    first = F.row_number().over(Window.partitionBy(*strata, "price").orderBy("codigo"))
    kept = stock.where(F.col("price").isNotNull()).withColumn("_r", first).where(F.col("_r") <= most).drop("_r")
    gap = F.abs(F.col("price") - F.col("_v"))
    near = order.beside(asked, kept.select(*strata, "price").distinct(), strata, "_v", "price", most)
    rows = (near if within is None else near.where(within)).join(kept.hint("merge"), [*strata, "price"]).withColumn("gap", gap)
    place = F.row_number().over(Window.partitionBy(*strata, "_v").orderBy("gap", "codigo"))
    return rows.withColumn("_r", place).where(F.col("_r") <= most).drop("_r", "price")


def _best(found: DataFrame, alike: list[str], most: int, *columns: str) -> DataFrame:
    """alike, shown: the ``most`` best rows of requests that are alike, over all strata."""
    place = F.row_number().over(Window.partitionBy(*alike).orderBy("gap", "codigo"))
    return found.withColumn("_r", place).where(F.col("_r") <= most).groupBy(*alike).agg(F.collect_list(F.struct("codigo", "gap", *columns)).alias("shown"))


def similar_listings(requests: DataFrame, listings: DataFrame, area: float = 0.1, price: float = 0.1, top: int = 8) -> DataFrame:
    """pedido_id, codigo, mesmo_predio, posto: listings of the same building, or of the neighbourhood and close in area and price.

    Two joins by key, so that neither side is compared with all of the other; of both, the nearest in price. Requests that are alike are
    one, and of each area of the neighbourhood they meet only the nearest prices: as many more than are shown as the request's own
    building can have among them without filling all places by itself.
    """
    most = 2 * top - 1
    r = requests.select("pedido_id", F.col("endereco").alias("e"), F.col("bairro").alias("b"), F.col("area").alias("a"), F.col("valor").alias("v"))
    gap = F.abs(F.col("pedido_valor") - F.col("v"))
    same = r.join(listings, F.col("e") == F.col("endereco")).select("pedido_id", "codigo", F.lit(True).alias("mesmo_predio"), gap.alias("gap"))
    known = r.where("e is not null and b is not null and a is not null and v is not null")
    stock = listings.where("endereco is not null and bairro is not null and area is not null").select(F.col("bairro").alias("b"), F.col("area").alias("_la"), F.col("pedido_valor").alias("price"), "codigo", "endereco")
    areas = stock.select("b", "_la").distinct().withColumn("_band", _band(F.col("_la"), area))
    sized = known.select("b", "a").distinct().withColumn("_band", F.explode(_bands(F.col("a"), area))).join(areas, ["b", "_band"]).where(F.abs(F.col("_la") - F.col("a")) <= area * F.col("a")).select("b", "a", "_la")
    alike = known.select("b", "a", F.col("v").alias("_v")).distinct().join(sized, ["b", "a"])
    found = _nearest_in_price(alike.select("b", "_la", "_v").distinct(), stock, ["b", "_la"], most, F.abs(F.col("price") - F.col("_v")) <= price * F.col("_v"))
    best = _best(alike.join(found, ["b", "_la", "_v"]), ["b", "a", "_v"], most, "endereco").withColumnRenamed("_v", "v")
    near = known.join(best, ["b", "a", "v"]).select("pedido_id", "e", F.inline("shown")).where(F.col("e") != F.col("endereco")).select("pedido_id", "codigo", F.lit(False).alias("mesmo_predio"), "gap")
    rank = F.row_number().over(Window.partitionBy("pedido_id").orderBy(F.desc("mesmo_predio"), "gap", "codigo"))
    return same.union(near).withColumn("posto", rank).where(F.col("posto") <= top).select("pedido_id", "codigo", "mesmo_predio", "posto")


def comparable_listings(requests: DataFrame, listings: DataFrame, area: float = 0.25, price: float = 0.30, top: int = 8) -> DataFrame:
    """pedido_id, codigo, mesmo_predio, posto: what is advertised like a request: in its building, or in its neighbourhood with its rooms.

    ``requests`` has pedido_id, predio, bairro, quartos, util, estimativa, ``listings`` codigo, predio, bairro, quartos, area, valor. Of other
    buildings, rooms that both know must be equal, and the area must lie within ``area`` of the useful one where that is known, else the price
    within ``price`` of the estimate where there is one. The building comes first, then the nearest in price, then by code. Requests that
    are alike are one, and meet of each area and number of rooms only what can be shown (see ``similar_listings``); requests
    with neither area nor estimate see the first codes of their neighbourhood and rooms only.
    """
    most = 2 * top - 1
    rooms_of = lambda c: F.coalesce(F.col(c).cast("double").cast("string"), F.lit("?"))
    r = requests.select("pedido_id", *(F.col(c).alias(f"r_{c}") for c in ("predio", "bairro", "quartos", "util", "estimativa")))
    gap = F.when(F.col("r_estimativa") > 0, F.abs(F.col("valor") - F.col("r_estimativa"))).otherwise(0.0).alias("gap")
    same = r.join(listings, F.col("r_predio") == F.col("predio")).select("pedido_id", "codigo", F.lit(True).alias("mesmo_predio"), gap)
    elsewhere = F.coalesce(F.col("r_predio") != F.col("predio"), F.lit(True))
    rooms = F.coalesce(F.col("r_quartos") == F.col("quartos"), F.lit(True))
    same_rooms = (F.col("rq") == "?") | (F.col("q") == "?") | (F.col("rq") == F.col("q"))
    sized, priced = F.coalesce(F.col("r_util") > 0, F.lit(False)), F.coalesce(F.col("r_estimativa") > 0, F.lit(False))
    known = r.where("r_bairro is not null").select("pedido_id", "r_predio", F.col("r_bairro").alias("b"), rooms_of("r_quartos").alias("rq"), F.col("r_util").alias("u"), F.col("r_estimativa").alias("v"), sized.alias("sized"), priced.alias("priced"))
    stock = listings.where("bairro is not null").select(F.col("bairro").alias("b"), rooms_of("quartos").alias("q"), F.col("area").alias("la"), F.col("valor").alias("price"), "codigo", "predio")
    shown = lambda asked, best, alike: asked.join(best, alike).select("pedido_id", "r_predio", F.inline("shown")).where(elsewhere).select("pedido_id", "codigo", F.lit(False).alias("mesmo_predio"), "gap")
    first = lambda rows, keys, n: rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("codigo"))).where(F.col("k") <= n)

    # by area: strata are a neighbourhood's rooms and area
    strata = ["b", "q", "la"]
    large = stock.where("la > 0")
    cells = large.select(*strata).distinct().withColumn("band", _band(F.col("la"), area))
    by_size = known.where("sized")
    met = by_size.select("b", "rq", "u").distinct().withColumn("band", F.explode(_bands(F.col("u"), area))).join(cells, ["b", "band"])
    met = met.where(same_rooms & (F.abs(F.col("la") - F.col("u")) / F.col("u") <= area)).select("b", "rq", "u", "q", "la")
    with_price, without = by_size.where("priced"), by_size.where("not priced")
    alike = with_price.select("b", "rq", "u", F.col("v").alias("_v")).distinct().join(met, ["b", "rq", "u"])
    nearest = alike.join(_nearest_in_price(alike.select(*strata, "_v").distinct(), large, strata, most), [*strata, "_v"])
    # without a price the gap is unknown, and comes first
    unpriced = alike.join(first(large.where("price is null"), strata, most).select(*strata, "codigo", "predio"), strata).withColumn("gap", F.lit(None).cast("double"))
    columns = ["b", "rq", "u", "_v", "codigo", "predio", "gap"]
    by_area = shown(with_price, _best(nearest.select(*columns).union(unpriced.select(*columns)), ["b", "rq", "u", "_v"], most, "predio").withColumnRenamed("_v", "v"), ["b", "rq", "u", "v"])
    of_size = without.select("b", "rq", "u").distinct().join(met, ["b", "rq", "u"]).join(first(large, strata, most).select(*strata, "codigo", "predio"), strata).withColumn("gap", F.lit(0.0))
    by_code = shown(without, _best(of_size, ["b", "rq", "u"], most, "predio"), ["b", "rq", "u"])

    # by price: strata are a neighbourhood's rooms
    by_value = known.where("not sized and priced")
    met = by_value.select("b", "rq").distinct().join(stock.select("b", "q").distinct(), "b").where(same_rooms)
    alike = by_value.select("b", "rq", F.col("v").alias("_v")).distinct().join(met, ["b", "rq"])
    near = F.abs(F.col("price") - F.col("_v")) / F.col("_v") <= price
    nearest = alike.join(_nearest_in_price(alike.select("b", "q", "_v").distinct(), stock.where("price > 0").drop("la"), ["b", "q"], most, near), ["b", "q", "_v"])
    by_price = shown(by_value, _best(nearest, ["b", "rq", "_v"], most, "predio").withColumnRenamed("_v", "v"), ["b", "rq", "v"])

    # a building of ``top`` listings fills its requests' places; a smaller one can hold some of the first codes, which they don't count here
    open_ = r.where(~sized & ~priced)
    own = listings.groupBy(F.col("predio").alias("r_predio")).agg(F.count("*").alias("own"))
    open_ = open_.join(own, "r_predio", "left").withColumn("need", top + F.coalesce("own", F.lit(0))).where(F.col("need") < 2 * top)
    few = first(listings, ["bairro", "quartos"], 2 * top)
    any_rooms = open_.join(few, F.col("r_bairro") == F.col("bairro")).where((F.col("k") <= F.col("need")) & elsewhere & rooms).select("pedido_id", "codigo", F.lit(False).alias("mesmo_predio"), gap)
    rank = F.row_number().over(Window.partitionBy("pedido_id").orderBy(F.desc("mesmo_predio"), "gap", "codigo"))
    every = same.union(by_area).union(by_code).union(by_price).union(any_rooms)
    return every.withColumn("posto", rank).where(F.col("posto") <= top).select("pedido_id", "codigo", "mesmo_predio", "posto")


def ranking_moves(now: DataFrame, before: DataFrame, key: str, score: str) -> DataFrame:
    """key, posto, anterior, subiu: places in two rankings and how far each rose. One row a neighbourhood."""
    place = lambda rows, name: rows.select(key, F.row_number().over(Window.orderBy(F.desc(score), key)).alias(name))
    both = place(now, "posto").join(place(before, "anterior"), key, "left")
    return both.withColumn("subiu", F.col("anterior") - F.col("posto"))


def stock_demand(stock: Column, demand: Column) -> Column:
    """Listings for each sale; 999 without demand, 0 without either."""
    return F.when(demand > 0, half_up(stock / demand, 3)).when(stock > 0, 999.0).otherwise(0.0)


def regions(rows: DataFrame, area: str, group: str, name: str, order: list[str]) -> DataFrame:
    """area, regiao: the commonest name of each area, told apart by group where a name occurs in several."""
    named = majority(rows, [area], name, order).select(area, "winner").join(rows.groupBy(area).agg(F.min(group).alias("_g")), area)
    spread = named.groupBy("winner").agg(F.countDistinct("_g").alias("_k"))
    return named.join(spread, "winner").select(area, F.when(F.col("_k") > 1, F.concat_ws(" ", "winner", F.col("_g").cast("string"))).otherwise(F.col("winner")).alias("regiao"))


def find_addresses(addresses: DataFrame, text: str, words: list[str], top: int = 8) -> DataFrame:
    """The first few addresses whose text holds every word."""
    hit = F.lit(True)
    for word in words:
        hit = hit & F.contains(F.lower(text), F.lit(word.lower()))
    return addresses.where(hit).orderBy(F.length(text), text, *[c for c in addresses.columns if c != text]).limit(top)


def paid_by_year(sales: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """bairro, tipo, ano, n, mediana, de, ate (months with sales), pequena, variacao (% on the year before).

    The change is null unless the year just before has sales too and neither year has a small sample.
    """
    by = sales.groupBy("bairro", "tipo", F.year("dia").alias("ano")).agg(F.count("*").alias("n"), F.median("valor").alias("mediana"), F.min(F.month("dia")).alias("de"), F.max(F.month("dia")).alias("ate"))
    w = Window.partitionBy("bairro", "tipo").orderBy("ano")
    small = F.col("n") < p.small_sample
    last = F.when((F.lag("ano").over(w) == F.col("ano") - 1) & ~small & (F.lag("n").over(w) >= p.small_sample), F.lag("mediana").over(w))
    return by.select("*", small.alias("pequena"), half_up(100 * (F.col("mediana") - last) / last, 1).alias("variacao"))


def old_stock(listings: DataFrame, key: str, today: Column, days: int = 365) -> DataFrame:
    """key, com_data, antigos, pct: the share of listings older than a year among those with a known date."""
    age = F.datediff(today, "criado")
    counts = listings.groupBy(key).agg(F.count("criado").alias("com_data"), F.sum(F.when(age > days, 1).otherwise(0)).alias("antigos"))
    return counts.withColumn("pct", half_up(F.try_divide(100.0 * F.col("antigos"), F.col("com_data")), 1))


def changed_rules(before: DataFrame, after: DataFrame, key: str, label: str) -> DataFrame:
    """antes, depois, n: how many rows each pair of labels has under two versions of a rule; null where a row is missing."""
    both = before.select(key, F.col(label).alias("antes")).join(after.select(key, F.col(label).alias("depois")), key, "full_outer")
    return both.groupBy("antes", "depois").agg(F.count("*").alias("n"))
