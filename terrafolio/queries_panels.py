"""Queries of the panels over deals and offers, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrafolio.functions import expr
from terrafolio.functions.expr import half_up
from terrafolio.operators import addresses, market, panels, period, prices, ranges, scoring
from terrafolio.operators.order import kept, numbered, settled
from terrafolio.plans.views import DEALS, OFFER_COLUMNS, OFFERS, deals, offers, table
from terrafolio.queries import ORACLES, PERIOD, query

END = PERIOD.replace("FROM sales", "FROM deals") + ", fim AS (SELECT base - 2 AS e FROM base)"
r = lambda x, n=6: f"floor({x} * {10**n} + 0.5) / {10**n}"
BAND = lambda x: f"CASE WHEN {x} < 0 THEN NULL WHEN {x} <= 50 THEN 'ate_50' WHEN {x} <= 80 THEN '50_80' WHEN {x} <= 120 THEN '80_120' ELSE 'mais_120' END"
CATEGORY = "CASE WHEN coalesce(trim(financiamento), '') = '' THEN 'a_vista' WHEN trim(financiamento) LIKE '1.%' THEN 'sfh' WHEN trim(financiamento) LIKE '2.%' THEN 'mcmv' WHEN trim(financiamento) LIKE '3.%' THEN 'consorcio' WHEN trim(financiamento) LIKE '99.%' THEN 'sfi' ELSE 'outros' END"


def end_of(rows):
    return period.base_month(rows).select("window_end").scalar()


YEARS = [1999, 2000, 2001, 2031]


@query(
    "yearly_counts",
    f"""WITH {DEALS}, g AS (SELECT bairro, CAST(unnest({YEARS}) AS INTEGER) AS ano FROM (SELECT DISTINCT bairro FROM deals)), c AS (SELECT bairro, ano, count(*) AS n, count(*) FILTER (revenda) AS revendas, count(*) FILTER (limpa) AS limpas, {r('avg(valor) FILTER (limpa)', 2)} AS media, {r('median(valor) FILTER (limpa)', 2)} AS mediana FROM deals GROUP BY 1, 2)
  SELECT bairro, ano, coalesce(n, 0) AS n, coalesce(revendas, 0) AS revendas, coalesce(limpas, 0) AS limpas, media, mediana FROM g LEFT JOIN c USING (bairro, ano)""",
)
def _(spark, d):
    rows = deals(spark, d)
    return panels.yearly(rows, rows.select("bairro").distinct(), YEARS)


@query(
    "stock_by_place",
    f"""WITH {OFFERS}, q AS (SELECT bairro, quantile_cont(valor, 0.25) AS a, quantile_cont(valor, 0.75) AS b, count(valor) AS k FROM offers GROUP BY 1), m AS (SELECT bairro, {r('median(valor)', 2)} AS mediana FROM offers JOIN q USING (bairro) WHERE valor IS NOT NULL AND (k < 4 OR a = b OR valor BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) GROUP BY 1),
  t AS (SELECT bairro, count(*) AS estoque, {r('avg(lat) FILTER (lat BETWEEN -24.2 AND -23 AND lon BETWEEN -47 AND -46.2)')} AS lat, {r('avg(lon) FILTER (lat BETWEEN -24.2 AND -23 AND lon BETWEEN -47 AND -46.2)')} AS lon, count(*) FILTER (idade > 365) AS antigos, {r('100.0 * count(*) FILTER (idade > 365) / nullif(count(idade), 0)', 1)} AS pct_antigos FROM offers GROUP BY 1)
  SELECT t.*, mediana FROM t LEFT JOIN m USING (bairro)""",
)
def _(spark, d):
    return panels.stock(offers(spark, d))


PAYMENTS = f"""WITH {DEALS}{END}, o AS (SELECT *, CASE WHEN limpa THEN 'revenda' WHEN planta THEN 'planta' END AS origem, {CATEGORY} AS categoria FROM deals)"""


@query(
    "payment_profile",
    f"""{PAYMENTS}, s AS (SELECT bairro, origem, 'total' AS tipo, mes, categoria FROM o WHERE origem IS NOT NULL UNION ALL SELECT bairro, origem, tipo, mes, categoria FROM o WHERE origem IS NOT NULL AND tipo IS NOT NULL),
  w AS (SELECT bairro, origem, tipo, CASE WHEN count(*) FILTER (mes <= e AND mes > e - 12) >= 30 THEN 12 WHEN count(*) FILTER (mes <= e AND mes > e - 24) >= 30 THEN 24 ELSE 36 END AS janela, count(*) FILTER (mes <= e AND mes > e - 36) < 30 AS poucas FROM s, fim GROUP BY 1, 2, 3),
  i AS (SELECT s.*, janela, poucas FROM s JOIN w USING (bairro, origem, tipo), fim WHERE mes <= e AND mes > e - janela), g AS (SELECT bairro, origem, tipo, any_value(janela) AS janela, any_value(poucas) AS poucas, count(*) AS n_vendas FROM i GROUP BY 1, 2, 3),
  c AS (SELECT g.*, k.categoria, k.k, (SELECT count(*) FROM i WHERE i.bairro = g.bairro AND i.origem = g.origem AND i.tipo = g.tipo AND i.categoria = k.categoria) AS n FROM g, (VALUES ('a_vista', 0), ('sfh', 1), ('mcmv', 2), ('sfi', 3), ('consorcio', 4), ('outros', 5)) k(categoria, k)),
  b AS (SELECT *, floor(n * 1000 / n_vendas) AS f, {r('(n * 1000 / n_vendas - floor(n * 1000 / n_vendas))', 9)} AS resto FROM c)
  SELECT bairro, origem, tipo, janela, poucas, n_vendas, categoria, n, (f + CASE WHEN row_number() OVER (PARTITION BY bairro, origem, tipo ORDER BY resto DESC, k) <= 1000 - sum(f) OVER (PARTITION BY bairro, origem, tipo) THEN 1 ELSE 0 END) / 10 AS pct FROM b""",
)
def _(spark, d):
    rows = deals(spark, d)
    return panels.payment_profile(rows, end_of(rows))


@query(
    "financing_diagnostics",
    f"""{PAYMENTS}, x AS (SELECT origem, categoria, CASE WHEN categoria = 'a_vista' THEN financiado > 0 ELSE NOT (financiado > 0 AND financiado <= valor) END AS odd, CASE WHEN categoria IN ('sfh', 'mcmv', 'sfi') AND financiado > 0 AND financiado <= valor THEN financiado / valor END AS s FROM o WHERE origem IS NOT NULL)
  SELECT origem, categoria, count(*) AS n, count(*) FILTER (odd) AS inconsistentes, count(s) AS financiadas, CASE WHEN count(s) >= 10 THEN {r('100 * median(s)', 1)} END AS mediana FROM x GROUP BY 1, 2""",
)
def _(spark, d):
    return panels.financing(deals(spark, d), F.lit(0))


@query("nearest_ranks", f"WITH {DEALS}, v AS (SELECT bairro, list_sort(list(valor)) AS v FROM deals WHERE valor IS NOT NULL GROUP BY 1) SELECT bairro, len(v) AS n, v[CAST(floor(0.05 * (len(v) - 1)) AS INTEGER) + 1] AS q_5, v[CAST(floor(0.5 * (len(v) - 1)) AS INTEGER) + 1] AS q_50, v[CAST(floor(0.95 * (len(v) - 1)) AS INTEGER) + 1] AS q_95 FROM v")
def _(spark, d):
    return panels.ranked_shares(deals(spark, d), ["bairro"], "valor", [0.05, 0.5, 0.95])


@query(
    "apartment_panel",
    f"""WITH {DEALS}{END}, {OFFERS}, s AS (SELECT bairro, {BAND('area')} AS faixa, mes, valor FROM deals, fim WHERE tipo = 'apartamento' AND limpa AND mes <= e AND mes > e - 36),
  w AS (SELECT bairro, faixa, CASE WHEN count(*) FILTER (mes > e - 12) >= 30 THEN 12 WHEN count(*) FILTER (mes > e - 24) >= 30 THEN 24 ELSE 36 END AS janela, count(*) < 30 AS poucas FROM s, fim GROUP BY 1, 2),
  p AS (SELECT bairro, faixa, any_value(janela) AS janela, any_value(poucas) AS poucas, count(*) AS n, {r('median(valor)', 2)} AS mediana, {r('quantile_cont(valor, 0.25)', 2)} AS p25, {r('quantile_cont(valor, 0.75)', 2)} AS p75 FROM s JOIN w USING (bairro, faixa), fim WHERE mes > e - janela GROUP BY 1, 2),
  a AS (SELECT bairro, {BAND('area')} AS faixa, count(*) AS anuncios FROM offers WHERE tipo = 'apartamento' AND valor > 0 AND area > 0 GROUP BY 1, 2)
  SELECT bairro, faixa, coalesce(janela, 36) AS janela, coalesce(poucas, true) AS poucas, coalesce(n, 0) AS n, mediana, p25, p75, coalesce(anuncios, 0) AS anuncios FROM p FULL JOIN a USING (bairro, faixa)""",
)
def _(spark, d):
    rows = deals(spark, d)
    return panels.apartment_panel(rows, offers(spark, d), end_of(rows))


START = 1995 * 12 + 6
FACTORS = f"""WITH {DEALS}{END}, k AS (SELECT zona, tipo, mes, m2, e AS i1 FROM deals, fim WHERE tipo IS NOT NULL AND limpa AND m2 > 0 AND mes BETWEEN {START} AND e),
  g AS (SELECT CAST(unnest(range({START}, e + 1)) AS INTEGER) AS i, CAST(e AS INTEGER) AS i1 FROM fim), w AS (SELECT i, i1, unnest([3, 6, 12]) AS w FROM g), l AS (SELECT i, i1, w, greatest({START}, least(i - w // 2, i1 - w + 1)) AS lo FROM w), h AS (SELECT i, i1, w, lo, least(i1, lo + w - 1) AS hi FROM l),
  o AS (SELECT zona, tipo, i, h.i1, w, median(m2) AS m, count(*) AS n FROM h JOIN k ON mes BETWEEN lo AND hi GROUP BY ALL), s AS (SELECT zona, tipo, w, min(n) AS minimo FROM o GROUP BY 1, 2, 3 HAVING min(n) >= 200 AND count(*) = (SELECT count(*) FROM g)),
  c AS (SELECT zona, tipo, min(w) AS w, arg_min(minimo, w) AS minimo FROM s GROUP BY 1, 2), own AS (SELECT zona, tipo, i, w AS janela, minimo, max(m) FILTER (i = i1) OVER (PARTITION BY zona, tipo) / m AS fator FROM o JOIN c USING (zona, tipo, w)),
  city AS (SELECT tipo, i, max(m) FILTER (i = i1) OVER (PARTITION BY tipo) / m AS fator FROM (SELECT tipo, i, h.i1, median(m2) AS m FROM h JOIN k ON mes BETWEEN lo AND hi WHERE w = 6 GROUP BY ALL)),
  factors AS (SELECT * FROM own UNION ALL SELECT zona, tipo, i, NULL, NULL, fator FROM (SELECT DISTINCT zona, tipo FROM k) ANTI JOIN c USING (zona, tipo) JOIN city USING (tipo)),
  hoje AS (SELECT deals.*, CASE WHEN mes >= e THEN 1 ELSE coalesce(fator, 1) END AS fator FROM deals CROSS JOIN fim LEFT JOIN factors f ON f.zona = deals.zona AND f.tipo = deals.tipo AND f.i = greatest({START}, least(e, mes)))"""


#: What the correction of prices, and what is made of it, read of a deal.
PRICED = ["zona", "tipo", "endereco", "area", "valor", "m2", "mes", "ano", "limpa"]


def _factors(spark, d, rows=None):
    rows = rows or kept(deals(spark, d).select(*PRICED))  # joined once
    end = kept(period.base_month(rows)).select("window_end").scalar()
    return rows, panels.time_factors(rows, F.lit(START), end), end


def _today(spark, d, rows=None):
    rows, factors, end = _factors(spark, d, rows)
    return panels.corrected(rows, factors, F.lit(START), end)


@query("time_factors", f"{FACTORS} SELECT zona, tipo, i, janela, minimo, {r('fator')} AS fator FROM factors")
def _(spark, d):
    return _factors(spark, d)[1].withColumn("fator", half_up(F.col("fator"), 6))


@query("corrected_sales", f"{FACTORS} SELECT tipo, ano, count(*) AS n, {r('avg(fator)')} AS fator FROM hoje GROUP BY 1, 2")
def _(spark, d):
    return _today(spark, d).groupBy("tipo", "ano").agg(F.count("*").alias("n"), half_up(F.avg("fator"), 6).alias("fator"))


HOUSES = f"casas AS (SELECT zona, {BAND('area')} AS faixa, {r('median(m2 * fator)', 2)} AS referencia, {r('median(m2)', 2)} AS bruta, count(*) AS n FROM hoje WHERE limpa AND tipo = 'casa' AND m2 > 0 GROUP BY 1, 2)"
BUILDINGS = "predios AS (SELECT endereco, count(*) AS n, median(valor * fator) AS mediana, quantile_cont(valor * fator, 0.75) / quantile_cont(valor * fator, 0.25) AS razao, median(valor) AS mediana_bruta, quantile_cont(valor, 0.75) / quantile_cont(valor, 0.25) AS razao_bruta FROM hoje WHERE limpa AND tipo = 'apartamento' GROUP BY 1 HAVING count(*) >= 4)"


@query("house_reference", f"{FACTORS}, {HOUSES} SELECT * FROM casas")
def _(spark, d):
    return panels.house_reference(_today(spark, d))


@query("building_prices", f"{FACTORS}, {BUILDINGS} SELECT endereco, n, {r('mediana')} AS mediana, {r('razao')} AS razao, razao <= 1.25 AS homogeneo, {r('mediana_bruta')} AS mediana_bruta, razao_bruta <= 1.25 AS homogeneo_bruto FROM predios")
def _(spark, d):
    found = panels.building_prices(_today(spark, d))
    return found.select("endereco", "n", *(half_up(F.col(c), 6).alias(c) for c in ("mediana", "razao", "mediana_bruta")), "homogeneo", "homogeneo_bruto")


@query("index_audit", f"{FACTORS} SELECT zona, tipo, any_value(janela) AS janela, any_value(minimo) AS minimo, count(*) AS meses, {r('min(fator)', 4)} AS menor, {r('max(fator)', 4)} AS maior, {r('max(fator) FILTER (i = (SELECT e FROM fim))', 4)} AS ultimo FROM factors GROUP BY 1, 2")
def _(spark, d):
    _, factors, end = _factors(spark, d)
    return factors.withColumn("e", end).groupBy("zona", "tipo").agg(F.max("janela").alias("janela"), F.max("minimo").alias("minimo"), F.count("*").alias("meses"), half_up(F.min("fator"), 4).alias("menor"), half_up(F.max("fator"), 4).alias("maior"), half_up(F.max(F.when(F.col("i") == F.col("e"), F.col("fator"))), 4).alias("ultimo"))


PAIRS = "l_linenumber = 7 AND l_quantity > 30"
KM = "6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h))"


@query(
    "winning_profile",
    f"""WITH places AS (SELECT DISTINCT l_partkey % 300 AS lugar, -23.6 + (l_partkey % 300 % 20) * 0.0131 AS lat, -46.7 + (l_partkey % 300 // 20) * 0.0173 AS lon FROM lineitem), pairs AS (SELECT l_partkey % 300 AS lugar, l_quantity * 4 AS area, l_extendedprice * 20 AS valor FROM lineitem WHERE {PAIRS}),
  ofe AS (SELECT p_partkey % 300 AS lugar, CAST(120 + p_size * 2 AS DOUBLE) AS area, p_size % 5 AS quartos, CASE WHEN p_size % 4 > 0 THEN p_size % 4 END AS vagas FROM part), own AS (SELECT lugar, lat, lon, (SELECT count(*) FROM pairs p WHERE p.lugar = places.lugar) AS k FROM places),
  x AS (SELECT a.lugar, b.lugar AS de, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2) AS h FROM places a, places b WHERE a.lugar <> b.lugar),
  near AS (SELECT lugar, de FROM (SELECT lugar, de, {KM} AS km FROM x) WHERE km <= 3 QUALIFY row_number() OVER (PARTITION BY lugar ORDER BY floor(km * 1e9), de) <= 3),
  src AS (SELECT lugar, lugar AS de FROM own WHERE k >= 5 OR lugar IN (SELECT lugar FROM near) UNION ALL SELECT near.lugar, de FROM near JOIN own USING (lugar) WHERE k < 5), pool AS (SELECT src.lugar, area, valor FROM src JOIN pairs ON pairs.lugar = de),
  bk AS (SELECT lugar, floor(area / 20) AS b, count(*) AS m, median(valor) AS mediana, quantile_cont(valor, 0.25) AS p25, quantile_cont(valor, 0.75) AS p75 FROM pool GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lugar ORDER BY count(*) DESC, floor(area / 20)) = 1),
  bands AS (SELECT own.lugar, k, b * 20 AS low, (b + 1) * 20 AS high, p25, mediana, p75 FROM own LEFT JOIN bk USING (lugar)), held AS (SELECT b.lugar, quartos, vagas FROM bands b JOIN ofe USING (lugar) WHERE ofe.area >= low AND ofe.area < high),
  cnt AS (SELECT b.*, (SELECT count(*) FROM held h WHERE h.lugar = b.lugar) AS n_faixa FROM bands b), others AS (SELECT c.lugar, quartos, vagas FROM cnt c JOIN near USING (lugar) JOIN ofe ON ofe.lugar = near.de WHERE n_faixa < 5 AND ofe.area >= low AND ofe.area < high), every AS (SELECT * FROM held UNION ALL SELECT * FROM others),
  z AS (SELECT c.*, (SELECT count(*) FROM every v WHERE v.lugar = c.lugar) AS pool FROM cnt c), mq AS (SELECT lugar, quartos FROM every WHERE quartos IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lugar ORDER BY count(*) DESC, quartos) = 1), mv AS (SELECT lugar, vagas FROM every WHERE vagas IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lugar ORDER BY count(*) DESC, vagas) = 1),
  hq AS (SELECT lugar, quartos AS q FROM held WHERE quartos IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lugar ORDER BY count(*) DESC, quartos) = 1), hv AS (SELECT lugar, vagas AS v FROM held WHERE vagas IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lugar ORDER BY count(*) DESC, vagas) = 1)
  SELECT lugar, CASE WHEN low IS NULL THEN 'insuficiente' WHEN k >= 5 THEN 'individual' ELSE 'regional' END AS nivel, low, high, {r('p25', 2)} AS p25, {r('mediana', 2)} AS mediana, {r('p75', 2)} AS p75, n_faixa, CASE WHEN n_faixa >= 5 THEN 'individual' WHEN pool >= 2 THEN 'regional' ELSE 'insuficiente' END AS nivel_perfil,
    CASE WHEN n_faixa < 5 AND pool >= 2 THEN quartos ELSE q END AS quartos, CASE WHEN n_faixa < 5 AND pool >= 2 THEN vagas ELSE v END AS vagas FROM z LEFT JOIN mq USING (lugar) LEFT JOIN mv USING (lugar) LEFT JOIN hq USING (lugar) LEFT JOIN hv USING (lugar)""",
)
def _(spark, d):
    lines, k = table(spark, d, "lineitem"), F.col("lugar")
    places = lines.select((F.col("l_partkey") % 300).alias("lugar")).distinct().withColumns({"lat": F.lit(-23.6) + (k % 20) * 0.0131, "lon": F.lit(-46.7) + F.floor(k / 20) * 0.0173})
    pairs = lines.where(PAIRS).selectExpr("l_partkey % 300 AS lugar", "l_quantity * 4 AS area", "l_extendedprice * 20 AS valor")
    stock = table(spark, d, "part").selectExpr("p_partkey % 300 AS lugar", "CAST(120 + p_size * 2 AS DOUBLE) AS area", "p_size % 5 AS quartos", "CASE WHEN p_size % 4 > 0 THEN p_size % 4 END AS vagas")
    return panels.winning_profile(pairs, stock, places)


NAMED = "nomes AS (SELECT s.endereco, coalesce(b, a) AS nome FROM (SELECT endereco, arg_min(concat('venda ', bairro), id) AS a FROM deals GROUP BY 1) s LEFT JOIN (SELECT endereco, arg_max(nome, codigo) AS b FROM offers GROUP BY 1) o USING (endereco))"


def _names(spark, d, rows=None):
    return panels.displays((rows or deals(spark, d)).withColumn("nome", F.concat(F.lit("venda "), "bairro")), offers(spark, d))


@query("address_displays", f"WITH {DEALS}, {OFFERS}, {NAMED} SELECT * FROM nomes")
def _(spark, d):
    return _names(spark, d)


ADDRESSES = f"""lk AS (SELECT endereco, date_diff('day', dia, lead(dia, 4) OVER (PARTITION BY endereco ORDER BY dia)) <= 182 AS hit FROM deals WHERE limpa), la AS (SELECT endereco, coalesce(bool_or(hit), false) AS lancamento FROM lk GROUP BY 1),
  ax AS (SELECT endereco, min(bairro) AS bairro, count(*) AS n, min(valor) AS menor, max(valor) AS maior, median(valor) AS mediana FROM deals WHERE limpa GROUP BY 1), tp AS (SELECT endereco, tipo FROM deals WHERE limpa AND tipo IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY endereco ORDER BY count(*) DESC, tipo) = 1), {NAMED},
  adr AS (SELECT endereco, bairro, nome, tipo, n, mediana, CASE WHEN n = 1 THEN 'unico' WHEN menor < 30000 OR maior / menor > 20 THEN 'incoerente' WHEN lancamento THEN 'lancamento' ELSE 'prospecto' END AS situacao FROM ax JOIN la USING (endereco) LEFT JOIN tp USING (endereco) LEFT JOIN nomes USING (endereco))"""


def _addresses(spark, d, rows=None):
    rows = rows or deals(spark, d)
    clean = rows.where("limpa")
    found = addresses.liquidity(clean).select("endereco", "bairro", "n", "mediana", "situacao")
    return found.join(panels.majority_kind(clean), "endereco", "left").join(_names(spark, d, rows), "endereco", "left")


@query("prospects_live", f"WITH {DEALS}, {OFFERS}, {ADDRESSES}, hj AS (SELECT endereco, count(*) AS n_hoje, sum(codigo * 1000 + coalesce(idade, 0) + CASE WHEN idade > 365 THEN 500000000 ELSE 0 END) AS soma FROM offers WHERE situacao NOT IN (3, 4) GROUP BY 1) SELECT adr.endereco, bairro, nome, tipo, n, {r('mediana')} AS mediana, situacao, coalesce(n_hoje, 0) AS n_hoje, CAST(coalesce(soma, 0) AS BIGINT) AS soma FROM adr LEFT JOIN hj USING (endereco)")
def _(spark, d):
    live = panels.live_units(offers(spark, d))
    total = F.aggregate("unidades", F.lit(0).cast("long"), lambda a, u: a + u["codigo"] * 1000 + F.coalesce(u["idade"], F.lit(0)) + F.when(u["antigo"], 500000000).otherwise(0))
    joined = _addresses(spark, d).join(live.select("endereco", "n_hoje", total.alias("soma")), "endereco", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("endereco", "bairro", "nome", "tipo", "n", half_up(F.col("mediana"), 6).alias("mediana"), "situacao", zero("n_hoje"), zero("soma"))


PLACES = f"""vz AS (SELECT bairro, count(*) FILTER (revenda AND mes <= e AND mes > e - 12) AS revendas, count(*) AS volume FROM deals, fim GROUP BY 1), wj AS (SELECT bairro, tipo, CASE WHEN count(*) FILTER (mes <= e AND mes > e - 12) >= 30 THEN 12 WHEN count(*) FILTER (mes <= e AND mes > e - 24) >= 30 THEN 24 ELSE 36 END AS months, count(*) FILTER (mes <= e AND mes > e - 36) < 30 AS few FROM deals, fim WHERE limpa AND tipo IS NOT NULL GROUP BY 1, 2),
  bandas AS (SELECT bairro, tipo, any_value(few) AS few, quantile_cont(valor, 0.25) AS low, quantile_cont(valor, 0.75) AS high FROM deals JOIN wj USING (bairro, tipo), fim WHERE limpa AND mes <= e AND mes > e - months GROUP BY 1, 2),
  nf AS (SELECT o.bairro, count(*) AS no_perfil, count(*) FILTER (NOT few) AS nota FROM offers o JOIN bandas b ON b.bairro = o.bairro AND b.tipo = o.tipo AND o.valor BETWEEN low AND high GROUP BY 1), cf AS (SELECT bairro, bool_or(NOT few) AS confiavel FROM bandas GROUP BY 1), st AS (SELECT bairro, count(*) AS estoque FROM offers GROUP BY 1),
  lugares AS (SELECT bairro, revendas, volume, coalesce(estoque, 0) AS estoque, coalesce(no_perfil, 0) AS no_perfil, coalesce(confiavel, false) AS confiavel, CASE WHEN confiavel THEN coalesce(nota, 0) END AS nota FROM vz LEFT JOIN nf USING (bairro) LEFT JOIN cf USING (bairro) LEFT JOIN st USING (bairro)),
  rz AS (SELECT *, CASE WHEN revendas > 0 THEN {r('no_perfil / revendas', 3)} WHEN no_perfil > 0 THEN 999 ELSE 0 END AS razao, CASE WHEN revendas > 0 THEN {r('estoque / revendas', 3)} WHEN estoque > 0 THEN 999 ELSE 0 END AS total FROM lugares),
  ct AS (SELECT list_sort(list(razao)) AS a, list_sort(list(total)) AS b FROM rz), cu AS (SELECT a[least(len(a), CAST(floor(len(a) / 3 + 1e-9) AS INTEGER) + 1)] AS baixo, b[least(len(b), CAST(floor(len(b) / 3 + 1e-9) AS INTEGER) + 1)] AS pouco, b[least(len(b), CAST(floor(len(b) * 2 / 3 + 1e-9) AS INTEGER) + 1)] AS alto FROM ct),
  sl AS (SELECT bairro, razao, total, revendas < 100 AS pequena, razao <= baixo AND revendas > 0 AS oportunidade, total >= alto AS saturacao, revendas >= 100 AND confiavel AND no_perfil <= 60 AND total <= pouco AS escassez, revendas >= 100 AND confiavel AND no_perfil <= 60 AND NOT total <= pouco AND estoque > 0 AS fora_do_perfil FROM rz, cu)"""


def _bands(spark, d, rows=None):
    every = rows or deals(spark, d)
    rows = every.where("limpa and tipo is not null")
    stock = offers(spark, d).withColumnRenamed("valor", "pedido_valor")
    return prices.adaptive_band(rows, stock, ["bairro", "tipo"], end_of(every))


def _places(spark, d, rows=None, bands=None):
    rows = rows or deals(spark, d)
    stock, bands = offers(spark, d), bands or _bands(spark, d, rows)
    timed = rows.withColumn("e", end_of(rows))
    volume = timed.groupBy("bairro").agg(panels.count_if(F.col("revenda") & (F.col("mes") <= F.col("e")) & (F.col("mes") > F.col("e") - 12)).alias("revendas"), F.count("*").alias("volume"))
    reliable = bands.groupBy("bairro").agg(F.max(~F.col("few")).alias("confiavel"), F.sum("stock").alias("no_perfil"), F.sum(F.when(~F.col("few"), F.col("stock")).otherwise(0)).alias("nota"))
    total = stock.groupBy("bairro").agg(F.count("*").alias("estoque"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    known = F.coalesce("confiavel", F.lit(False))
    return volume.join(reliable, "bairro", "left").join(total, "bairro", "left").select("bairro", "revendas", "volume", zero("estoque"), zero("no_perfil"), known.alias("confiavel"), F.when(known, F.coalesce("nota", F.lit(0))).alias("nota"))


def _seals(spark, d, places=None):
    from terrafolio.operators.market import stock_demand

    places = places or _places(spark, d)
    ratios = places.select(stock_demand(F.col("no_perfil"), F.col("revendas")).alias("a"), stock_demand(F.col("estoque"), F.col("revendas")).alias("b"))
    return panels.seals(places, panels.cut_at(ratios, "a", 1 / 3), panels.cut_at(ratios, "b", 1 / 3), panels.cut_at(ratios, "b", 2 / 3), most=60)


@query("place_seals", f"WITH {DEALS}{END}, {OFFERS}, {PLACES} SELECT * FROM sl")
def _(spark, d):
    return _seals(spark, d)


SCORES = """tr AS (SELECT bairro, count(*) FILTER (limpa AND mes <= e AND mes > e - 12) AS v, count(*) FILTER (limpa AND mes <= e - 12 AND mes > e - 24) AS w FROM deals, fim GROUP BY 1), tf AS (SELECT bairro, v, CASE WHEN v >= 50 AND w >= 50 THEN greatest(-1, least(1, (v - w) / w)) END AS t FROM tr),
  ms AS (SELECT avg(v) AS vm, stddev_pop(v) AS vs, avg(t) AS tm, stddev_pop(t) AS ts, count(v) AS vn, count(t) AS tn FROM tf), zs AS (SELECT tf.*, ((CASE WHEN vn < 2 THEN 0 ELSE (v - vm) / CASE WHEN vs > 0 THEN vs ELSE 1 END END) + (CASE WHEN t IS NULL THEN -2 WHEN tn < 2 THEN 0 ELSE (t - tm) / CASE WHEN ts > 0 THEN ts ELSE 1 END END)) / 2 AS z FROM tf, ms),
  notas AS (SELECT bairro, floor(100 * (z - min(z) OVER ()) / (CASE WHEN max(z) OVER () > min(z) OVER () THEN max(z) OVER () - min(z) OVER () ELSE 1 END) * 10 + 0.5) / 10 AS score FROM zs)"""
PRIORITIES = f"""{SCORES}, hj365 AS (SELECT max(dia) AS h FROM deals), seg AS (SELECT bairro, tipo, {BAND('area')} AS faixa, median(m2) AS pago, count(*) FILTER (date_diff('day', dia, h) BETWEEN 0 AND 365) < 10 AS pequena FROM deals, hj365 WHERE limpa GROUP BY 1, 2, 3),
  un AS (SELECT endereco, count(DISTINCT unidade) AS unidades FROM deals GROUP BY 1), pr AS (SELECT o.*, notas.score AS nota, CASE WHEN seg.pequena THEN NULL ELSE pago END AS pago, low, high, coalesce(CASE WHEN adr.situacao = 'prospecto' THEN adr.n END, 0) AS n_vendas, unidades FROM (SELECT *, {BAND('area')} AS faixa FROM offers WHERE valor > 0) o JOIN notas USING (bairro) LEFT JOIN seg USING (bairro, tipo, faixa) LEFT JOIN (SELECT * FROM bandas WHERE NOT few) b USING (bairro, tipo) LEFT JOIN adr ON adr.endereco = o.endereco LEFT JOIN un ON un.endereco = o.endereco),
  pa AS (SELECT *, CASE WHEN tipo = 'apartamento' THEN NULL ELSE valor / area / pago END AS rz FROM pr), pb AS (SELECT *, CASE WHEN tipo = 'apartamento' THEN NULL WHEN rz IS NULL THEN 50 WHEN rz > 1 THEN greatest(0, 100 - (rz - 1) * 100) WHEN rz >= 0.7 THEN 100 ELSE greatest(30, 100 - (0.7 - rz) * 200) END AS al,
    CASE WHEN low IS NULL THEN NULL WHEN greatest(low - valor, valor - high) <= 0 THEN 100 WHEN high - low <= 0 THEN 50 ELSE greatest(0, 100 - 100 * greatest(low - valor, valor - high) / (high - low)) END AS ad, unidades >= 10 AND tipo IS DISTINCT FROM 'casa' AS giro FROM pa),
  pc AS (SELECT *, CASE WHEN n_vendas < 2 THEN 0 WHEN coalesce(giro, false) THEN least(CASE WHEN n_vendas < 3 THEN 60 ELSE 100 END, CASE WHEN n_vendas / unidades < 0.07 THEN 40 WHEN n_vendas / unidades < 0.1 THEN 60 WHEN n_vendas / unidades < 0.15 THEN 80 ELSE 100 END) ELSE CASE WHEN n_vendas >= 5 THEN 100 WHEN n_vendas = 4 THEN 80 WHEN n_vendas = 3 THEN 60 ELSE 40 END END AS bonus FROM pb),
  pri AS (SELECT codigo, bairro, zona, tipo, endereco, nome, valor, area, n_vendas, bonus, CASE WHEN n_vendas >= 2 THEN CASE WHEN coalesce(giro, false) THEN 'giro do prédio' ELSE 'nº de vendas' END END AS regua, {r('al', 1)} AS alinhamento, {r('ad', 1)} AS aderencia,
    {r('(35e-2 * nota + coalesce(3e-1 * al, 0) + coalesce(25e-2 * ad, 0) + 1e-1 * bonus) / (35e-2 + CASE WHEN al IS NULL THEN 0 ELSE 3e-1 END + CASE WHEN ad IS NULL THEN 0 ELSE 25e-2 END + 1e-1)', 2)} AS score,
    array_to_string(list_filter([CASE WHEN tipo = 'apartamento' THEN 'sem comparação para apartamentos' WHEN rz < 0.7 THEN concat('R$/m² ', CAST(floor((1 - rz) * 100 + 0.5) AS INTEGER), '% abaixo do histórico: checar') WHEN rz > 1 AND al < 60 THEN concat('R$/m² ', CAST(floor((rz - 1) * 100 + 0.5) AS INTEGER), '% acima do pago') WHEN rz <= 1 AND rz < 0.97 THEN concat('R$/m² ', CAST(floor((1 - rz) * 100 + 0.5) AS INTEGER), '% abaixo da mediana') END,
      CASE WHEN ad >= 80 THEN 'na faixa de preço do bairro' END, CASE WHEN nota >= 70 THEN 'bairro de revenda alta' END, CASE WHEN n_vendas > 0 THEN concat('prédio com ', n_vendas, ' vendas') END], lambda x: x IS NOT NULL)[:2], ' · ') AS resumo FROM pc)"""
ALL = f"WITH {DEALS}{END}, {OFFERS}, {PLACES}, {ADDRESSES}, {PRIORITIES}"


def _scores(spark, d, rows=None):
    rows = rows or deals(spark, d)
    return scoring.neighbourhood_score(rows.withColumn("tipo", F.lit("x")), F.col("limpa"))


def _priorities(spark, d, rows=None, found=None, scores=None, bands=None):
    rows = rows or deals(spark, d)
    banded, segment = rows.where("limpa").withColumn("faixa", expr.area_band(F.col("area"))).withColumn("hoje", rows.agg(F.max("dia")).scalar()), ["bairro", "tipo", "faixa"]
    recent = banded.groupBy(*segment).agg((panels.count_if(F.datediff("hoje", "dia").between(0, 365)) < 10).alias("pequena"))
    paid = period.group_quantiles(banded, segment, "m2", [0.5]).select(*segment, F.element_at("q", 1).alias("pago"))
    segments = kept(recent.join(paid, segment))
    prospects = (found or _addresses(spark, d, rows)).where("situacao = 'prospecto'").select("endereco", "n")
    units = rows.select("endereco", "unidade").repartition("endereco").groupBy("endereco").agg(F.countDistinct("unidade").alias("unidades"))
    return panels.priorities(offers(spark, d), scores or _scores(spark, d, rows), segments, bands or _bands(spark, d, rows), prospects, units)


@query("priority_listings", f"{ALL} SELECT * FROM pri")
def _(spark, d):
    return _priorities(spark, d)


@query("priority_ranking", f"{ALL} SELECT codigo, CAST(row_number() OVER (ORDER BY score DESC, lower(nome), codigo) AS INTEGER) AS posto FROM pri ORDER BY score DESC, lower(nome), codigo LIMIT 50")
def _(spark, d):
    from pyspark.sql import Window

    order = [F.desc("score"), F.lower("nome"), "codigo"]
    best = _priorities(spark, d).orderBy(*order).limit(50)
    return best.select("codigo", F.row_number().over(Window.orderBy(*order)).alias("posto"))  # of 50 rows


FOUND = f"""{FACTORS}, {HOUSES}, {BUILDINGS}, {OFFERS}, sg AS (SELECT zona, tipo, {BAND('area')} AS faixa, median(m2) AS bruta FROM deals WHERE limpa GROUP BY 1, 2, 3 HAVING count(*) >= 10),
  ac AS (SELECT codigo, bairro, nome, tipo, 'predio' AS comparacao, CASE WHEN razao <= 1.25 THEN mediana END AS ref, CASE WHEN razao_bruta <= 1.25 THEN mediana_bruta END AS br, o.valor AS de FROM offers o JOIN predios USING (endereco) WHERE o.valor > 0 AND o.tipo = 'apartamento'
    UNION ALL SELECT codigo, bairro, nome, o.tipo, 'm2', coalesce(referencia, sg.bruta), sg.bruta, o.valor / o.area FROM (SELECT *, {BAND('area')} AS faixa FROM offers WHERE valor > 0 AND area > 0 AND tipo IS DISTINCT FROM 'apartamento') o JOIN sg USING (zona, tipo, faixa) LEFT JOIN casas USING (zona, faixa)),
  achados AS (SELECT codigo, bairro, nome, tipo, comparacao, {r('ref', 2)} AS referencia, {r('(1 - de / ref) * 100', 1)} AS desconto, 1 - de / ref >= 0.2 AS achado, 1 - de / ref >= 0.3 AS atencao, {r('(1 - de / br) * 100', 1)} AS desconto_bruto FROM ac WHERE ref IS NOT NULL)"""


def _findings(spark, d, today=None):
    today = today or _today(spark, d)
    return panels.findings(offers(spark, d).where("valor > 0"), panels.building_prices(today), kept(panels.raw_segments(today)), kept(panels.house_reference(today)))


@query("value_findings", f"{FOUND} SELECT * FROM achados")
def _(spark, d):
    return _findings(spark, d)


@query("findings_order", f"{FOUND} SELECT codigo, row_number() OVER (ORDER BY desconto DESC, lower(nome), codigo) AS posto, desconto FROM achados WHERE achado")
def _(spark, d):
    found = _findings(spark, d).where("achado")
    ordered = numbered(found, [], [F.desc("desconto"), F.lower("nome"), F.col("codigo")], "posto")
    return ordered.select("codigo", (F.col("posto") + 1).alias("posto"), "desconto")


@query("findings_by_place", f"{FOUND} SELECT bairro, count(*) FILTER (achado) AS n_achados, count(*) AS elegiveis, {r('100 * count(*) FILTER (achado) / count(*)', 1)} AS pct FROM achados GROUP BY 1 HAVING count(*) FILTER (achado) > 0")
def _(spark, d):
    return panels.findings_by_place(_findings(spark, d))


@query("findings_summary", f"{FOUND} SELECT tipo, count(*) AS elegiveis, count(*) FILTER (achado) AS achados, count(*) FILTER (desconto_bruto >= 20) AS achados_bruto, {r('100 * count(*) FILTER (desconto < 0) / count(*)', 1)} AS pct_acima, (SELECT count(DISTINCT o.endereco) FROM offers o JOIN predios p USING (endereco) WHERE p.razao <= 1.25 AND o.tipo = 'apartamento') AS predios_com_anuncio FROM achados GROUP BY 1")
def _(spark, d):
    today = _today(spark, d)
    homogeneous = panels.building_prices(today).where("homogeneo").select("endereco")
    with_offer = offers(spark, d).where("tipo = 'apartamento'").join(homogeneous, "endereco").agg(F.countDistinct("endereco")).scalar()
    found = _findings(spark, d, today).groupBy("tipo").agg(F.count("*").alias("elegiveis"), panels.count_if(F.col("achado")).alias("achados"), panels.count_if(F.col("desconto_bruto") >= 20).alias("achados_bruto"), half_up(100 * panels.count_if(F.col("desconto") < 0) / F.count("*"), 1).alias("pct_acima"))
    return found.withColumn("predios_com_anuncio", with_offer)



@query(
    "readiness",
    f"""{FOUND}, {PLACES}, {ADDRESSES}, {PRIORITIES}, ca AS (SELECT bairro, count(*) AS captacao FROM adr WHERE situacao = 'prospecto' GROUP BY 1), t10 AS (SELECT bairro, avg(score) * least(1.0, count(*) / 10) AS m FROM (SELECT bairro, score FROM pri QUALIFY row_number() OVER (PARTITION BY bairro ORDER BY score DESC, lower(nome), codigo) <= 10) GROUP BY 1),
  ec AS (SELECT bairro, count(*) AS eleg, count(*) FILTER (achado) AS ach FROM achados WHERE tipo = 'casa' GROUP BY 1),
  jj AS (SELECT lugares.bairro, revendas < 100 AS pequena, score AS f1, 100 * (nota - min(nota) OVER ()) / (CASE WHEN max(nota) OVER () > min(nota) OVER () THEN max(nota) OVER () - min(nota) OVER () ELSE 1 END) AS f2, coalesce(captacao, 0) AS c, coalesce(m, 0) AS f5, CASE WHEN coalesce(eleg, 0) = 0 THEN 50 ELSE 100 * ach / eleg END AS f6
    FROM lugares JOIN notas USING (bairro) LEFT JOIN ca USING (bairro) LEFT JOIN t10 USING (bairro) LEFT JOIN ec USING (bairro)), j4 AS (SELECT *, 100 * (c - min(c) OVER ()) / (CASE WHEN max(c) OVER () > min(c) OVER () THEN max(c) OVER () - min(c) OVER () ELSE 1 END) AS f4 FROM jj)
  SELECT bairro, pequena, {r('f1')} AS f1, {r('f2')} AS f2, {r('f4')} AS f4, {r('f5')} AS f5, {r('f6')} AS f6, {r('(0.25 * f1 + coalesce(0.25 * f2, 0) + 0.15 * f4 + 0.25 * f5 + 0.1 * f6) / (0.75 + CASE WHEN f2 IS NULL THEN 0 ELSE 0.25 END)', 1)} AS prontidao FROM j4""",
)
def _(spark, d):
    return _readiness(spark, d)[0]


#: What readiness and its flags read of a deal.
JUDGED = [*PRICED, "id", "bairro", "dia", "revenda", "unidade"]


def _readiness(spark, d):
    """Readiness, and the places that it starts from."""
    rows = kept(deals(spark, d).select(*JUDGED))  # what all factors start from, joined once
    bands, scores, found = _bands(spark, d, rows), kept(_scores(spark, d, rows)), kept(_addresses(spark, d, rows))
    priority = _priorities(spark, d, rows, found, scores, bands)
    order = [F.desc("score"), F.lower("nome"), "codigo"]
    best = scoring.top_mean(priority, "bairro", "score", order).select("bairro", F.col("media").alias("media10"))
    prospects = found.where("situacao = 'prospecto'").groupBy("bairro").agg(F.count("*").alias("captacao"))
    houses = _findings(spark, d, _today(spark, d, rows)).where("tipo = 'casa'").groupBy("bairro").agg(F.count("*").alias("eleg"), panels.count_if(F.col("achado")).alias("achados"))
    known = kept(_places(spark, d, rows, bands))
    places = known.select("bairro", (F.col("revendas") < 100).alias("pequena"), F.col("nota").alias("no_perfil")).join(scores.select("bairro", "score"), "bairro")
    for extra in (prospects, best, houses):
        places = places.join(extra, "bairro", "left")
    # the ends that factors are scaled by come from the same few rows
    return panels.readiness(kept(places.withColumn("captacao", F.coalesce("captacao", F.lit(0))))), known


COMPARED = "SELECT codigo AS pedido_id, endereco AS e, bairro AS b, CASE WHEN codigo % 4 > 0 THEN quartos END AS q, CASE WHEN codigo % 3 > 0 THEN area END AS u, CASE WHEN codigo % 5 > 0 THEN area * 9000 END AS v FROM offers"


@query(
    "comparable_listings",
    f"""WITH {OFFERS}, r AS ({COMPARED}), u AS (SELECT pedido_id, codigo, true AS mesmo_predio, coalesce(abs(valor - v), 0) AS gap, valor IS NULL AND v IS NOT NULL AS x FROM r JOIN offers ON e = endereco UNION ALL
    SELECT pedido_id, codigo, false, coalesce(abs(valor - v), 0), valor IS NULL AND v IS NOT NULL FROM r JOIN offers ON b = bairro AND e <> endereco AND coalesce(q = quartos, true) WHERE CASE WHEN u > 0 THEN area > 0 AND abs(area - u) / u <= 0.25 WHEN v > 0 THEN valor > 0 AND abs(valor - v) / v <= 0.3 ELSE true END)
  SELECT pedido_id, codigo, mesmo_predio, CAST(row_number() OVER (PARTITION BY pedido_id ORDER BY mesmo_predio DESC, CASE WHEN x THEN NULL ELSE gap END NULLS FIRST, codigo) AS INTEGER) AS posto FROM u QUALIFY posto <= 8""",
)
def _(spark, d):
    stock = offers(spark, d)
    k = F.col("codigo")
    asked = stock.select(k.alias("pedido_id"), F.col("endereco").alias("predio"), "bairro", F.when(k % 4 > 0, F.col("quartos")).alias("quartos"), F.when(k % 3 > 0, F.col("area")).alias("util"), F.when(k % 5 > 0, F.col("area") * 9000).alias("estimativa"))
    return market.comparable_listings(asked, stock.withColumnRenamed("endereco", "predio"))


@query("shortlist", f"WITH pront AS ({ORACLES['readiness']}), selos AS ({ORACLES['place_seals']}), est AS (SELECT bairro, count(*) AS estoque FROM (SELECT {OFFER_COLUMNS} FROM part) GROUP BY 1) SELECT bairro, prontidao, estoque, fora_do_perfil, pontos.pequena, CAST(row_number() OVER (ORDER BY prontidao DESC, bairro) AS INTEGER) AS posto FROM pront pontos JOIN selos USING (bairro) JOIN est USING (bairro)")
def _(spark, d):
    stock = offers(spark, d).groupBy("bairro").agg(F.count("*").alias("estoque"))
    ready, places = _readiness(spark, d)
    joined = ready.join(_seals(spark, d, places).select("bairro", "fora_do_perfil"), "bairro").join(stock, "bairro")
    place = F.row_number().over(Window.orderBy(F.desc("prontidao"), "bairro"))  # a row a neighbourhood
    return joined.select("bairro", "prontidao", "estoque", "fora_do_perfil", "pequena", place.alias("posto"))


GROUPS = f"""WITH {DEALS}{END}, {OFFERS}, {PLACES}, {ADDRESSES}, ku AS (SELECT bairro, count(*) FILTER (situacao = 'prospecto') AS k FROM adr WHERE mediana >= 800000 AND situacao IN ('prospecto', 'unico') GROUP BY 1), hj AS (SELECT endereco, count(*) AS n_hoje FROM offers WHERE situacao NOT IN (3, 4) GROUP BY 1),
  gx AS (SELECT adr.*, situacao = 'unico' AS unico, coalesce(n_hoje, 0) > 0 AS tem_hoje, escassez, volume, CASE WHEN escassez THEN 0 WHEN fora_do_perfil THEN 1 ELSE 2 END AS classe FROM adr JOIN ku USING (bairro) JOIN sl USING (bairro) JOIN (SELECT bairro, volume FROM lugares) USING (bairro) LEFT JOIN hj USING (endereco) WHERE mediana >= 800000 AND (situacao = 'prospecto' OR (situacao = 'unico' AND k < 5))),
  pn AS (SELECT bairro, CAST(dense_rank() OVER (ORDER BY classe, volume DESC, lower(bairro)) AS INTEGER) AS grupo, CAST(row_number() OVER (PARTITION BY bairro ORDER BY tem_hoje, n DESC, lower(nome), endereco) AS INTEGER) AS posto, endereco, nome, n, {r('mediana')} AS mediana, unico, tem_hoje, escassez FROM gx)"""


def _panel(spark, d):
    places = _places(spark, d)
    flags = _seals(spark, d, places).select("bairro", "escassez", "fora_do_perfil").join(places.select("bairro", "volume"), "bairro")
    return panels.prospect_panel(_addresses(spark, d), offers(spark, d), flags)


@query("prospect_groups", f"{GROUPS} SELECT * FROM pn")
def _(spark, d):
    return _panel(spark, d).withColumn("mediana", half_up(F.col("mediana"), 6))


@query("prospect_week", f"{GROUPS} SELECT endereco, bairro, n FROM pn WHERE NOT unico AND NOT tem_hoje ORDER BY NOT escassez, n DESC, lower(bairro), lower(nome), endereco LIMIT 30")
def _(spark, d):
    return panels.prospect_week(_panel(spark, d)).select("endereco", "bairro", "n")


@query("prospect_search", f"{GROUPS} SELECT endereco, n FROM pn WHERE bairro IN ('Brand#3', 'Brand#11') AND mediana >= 850000 AND mediana < 1200000 AND n >= 3 AND NOT tem_hoje")
def _(spark, d):
    rows = _panel(spark, d)
    found = [panels.prospect_search(rows, place, 850_000, 1_200_000, None, 3, free_only=True) for place in ("Brand#3", "Brand#11")]
    return found[0].union(found[1]).select("endereco", "n")


@query("panels_in_price_range", f"WITH {DEALS}, {OFFERS} SELECT bairro, a.n AS vendas, a.m AS mediana, coalesce(b.n, 0) AS anuncios FROM (SELECT bairro, count(*) AS n, {r('median(valor)', 2)} AS m FROM deals WHERE valor IS NULL OR valor BETWEEN 500000 AND 1500000 GROUP BY 1) a LEFT JOIN (SELECT bairro, count(*) AS n FROM offers WHERE valor IS NULL OR valor BETWEEN 500000 AND 1500000 GROUP BY 1) b USING (bairro)")
def _(spark, d):
    sold = panels.within_prices(deals(spark, d), "valor", 500_000, 1_500_000).groupBy("bairro").agg(F.count("*").alias("vendas"), half_up(F.median("valor"), 2).alias("mediana"))
    asked = panels.within_prices(offers(spark, d), "valor", 500_000, 1_500_000).groupBy("bairro").agg(F.count("*").alias("anuncios"))
    return sold.join(asked, "bairro", "left").withColumn("anuncios", F.coalesce("anuncios", F.lit(0)))


@query("scores_in_scope", f"WITH {DEALS}{END}, {SCORES} SELECT bairro, score FROM notas WHERE bairro IN ('Brand#1', 'Brand#2', 'Brand#9')")
def _(spark, d):
    # the scope comes after the normalisation over all places
    return _scores(spark, d).select("bairro", "score").where("bairro in ('Brand#1', 'Brand#2', 'Brand#9')")


RANGES = (("toda", None, None), ("media", 500_000.0, 1_500_000.0), ("alta", 1_500_000.0, None))
RANGED = f"""faixas AS (SELECT faixa, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM (VALUES {", ".join(f"('{n}', {'NULL' if a is None else a}, {'NULL' if b is None else b})" for n, a, b in RANGES)}) t(faixa, lo, hi)),
  tr AS (SELECT faixa, bairro, count(*) AS n, median(valor) AS mediana, count(*) FILTER (limpa AND mes <= e AND mes > e - 12) AS v, count(*) FILTER (limpa AND mes <= e - 12 AND mes > e - 24) AS w FROM deals, fim, faixas WHERE valor IS NULL OR (valor >= coalesce(lo, valor) AND valor <= coalesce(hi, valor)) GROUP BY 1, 2),
  tf AS (SELECT *, CASE WHEN v >= 50 AND w >= 50 THEN greatest(-1, least(1, (v - w) / w)) END AS t FROM tr), ms AS (SELECT faixa, avg(v) AS vm, stddev_pop(v) AS vs, avg(t) AS tm, stddev_pop(t) AS ts, count(v) AS vn, count(t) AS tn FROM tf GROUP BY 1),
  zs AS (SELECT tf.*, ((CASE WHEN vn < 2 THEN 0 ELSE (v - vm) / CASE WHEN vs > 0 THEN vs ELSE 1 END END) + (CASE WHEN t IS NULL THEN -2 WHEN tn < 2 THEN 0 ELSE (t - tm) / CASE WHEN ts > 0 THEN ts ELSE 1 END END)) / 2 AS z FROM tf JOIN ms USING (faixa)),
  nt AS (SELECT *, floor(100 * (z - min(z) OVER (PARTITION BY faixa)) / (CASE WHEN max(z) OVER (PARTITION BY faixa) > min(z) OVER (PARTITION BY faixa) THEN max(z) OVER (PARTITION BY faixa) - min(z) OVER (PARTITION BY faixa) ELSE 1 END) * 10 + 0.5) / 10 AS score FROM zs)"""


@query("scores_in_price_ranges", f"WITH {DEALS}{END}, {RANGED} SELECT faixa, bairro, n, {r('mediana', 2)} AS mediana, v AS vendas_12m, score FROM nt WHERE bairro <> 'Brand#9'")
def _(spark, d):
    rows = deals(spark, d)
    timed = rows.withColumn("e", end_of(rows))
    back = lambda lo, hi: F.col("limpa") & (F.col("mes") <= F.col("e") - lo) & (F.col("mes") > F.col("e") - hi)
    flags = {"vendas_12m": back(0, 12), "vendas_anterior": back(12, 24)}
    # one scan of the sales; each range is answered from the counts
    facts = ranges.in_ranges(settled(ranges.price_counts(timed, ["bairro"], "valor", flags)), RANGES, ["bairro"], list(flags))
    return ranges.scores_in_ranges(facts, [f"Brand#{k}" for k in range(1, 26) if k != 9])


@query("dear_listings", f"WITH {OFFERS} SELECT codigo, {r('valor / area', 2)} AS m2 FROM offers WHERE valor / area > 10000")
def _(spark, d):
    return offers(spark, d).where("valor / area > 10000").select("codigo", half_up(F.col("valor") / F.col("area"), 2).alias("m2"))


@query("nulls_last_both_ways", f"WITH {OFFERS} SELECT codigo, CAST(row_number() OVER (PARTITION BY bairro ORDER BY valor ASC NULLS LAST, codigo) AS INTEGER) AS sobe, CAST(row_number() OVER (PARTITION BY bairro ORDER BY valor DESC NULLS LAST, codigo) AS INTEGER) AS desce FROM offers")
def _(spark, d):
    from pyspark.sql import Window

    place = lambda order: F.row_number().over(Window.partitionBy("bairro").orderBy(order, "codigo"))
    return offers(spark, d).select("codigo", place(F.asc_nulls_last("valor")).alias("sobe"), place(F.desc_nulls_last("valor")).alias("desce"))


@query("every_nth_offer", f"WITH {OFFERS}, k AS (SELECT codigo, row_number() OVER (ORDER BY codigo) - 1 AS k, count(*) OVER () // 60 AS passo FROM offers) SELECT codigo FROM k WHERE k % greatest(1, passo) = 0")
def _(spark, d):
    return panels.every_nth(offers(spark, d), ["codigo"], 60).select("codigo")


