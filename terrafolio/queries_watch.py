"""Queries of place resolution, classifications, series, caches and weekly changes, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafolio.functions import text
from terrafolio.functions.expr import address_key, half_up, street_number
from terrafolio.operators import panels, resolve, watch
from terrafolio.operators.order import settled
from terrafolio.plans.cells import CELLS_SQL, spread
from terrafolio.plans.views import DEALS, OFFERS, deals, offers, table
from terrafolio.queries import query
from terrafolio.queries_sheet import DEEDS, NUMBER_OF_STREET, deeds, street_sql

r = lambda x, n=6: f"floor({x} * {10**n} + 0.5) / {10**n}"
WORDS = (("Brooklin Novo", "Brooklin", "AUTO_CARTEIRA"), ("JD AMERICA", "Jardim América", "NOVO_BAIRRO"), ("Vila Pompéia", "Pompéia", "AUTO_CARTEIRA"), ("V. Itaquera", "Itaquera", "SUGERIDO_FORA"), ("Torre 3", None, "AUTO_IGNORAR"), ("MOEMA", "Ausente", "AUTO_CARTEIRA"))
SPLIT = (("01310", "Brooklin"), ("01311", "FORA"), ("01312", "Pompéia"))
TARGETS = ("Brooklin", "Jardim América", "Pompéia")
# of the place that postcodes split there are rows too
NAME = "CASE WHEN k % 29 = 0 THEN 'Santo Amaro' ELSE E END"
PLACED = f"""{CELLS_SQL}, dic AS (SELECT upper(trim(nome)) AS kk, destino, status FROM (VALUES {", ".join(f"('{a}', {'NULL' if b is None else repr(b)}, '{c}')" for a, b, c in WORDS)}) t(nome, destino, status)), spl AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in SPLIT)}) t(prefixo, parte)),
  pr AS (SELECT row_num, row_num // 10 AS k, {NAME.replace('k %', '(row_num // 10) %')} AS nome, {street_sql('B')} AS rua, {NUMBER_OF_STREET} AS num, regexp_replace(CASE WHEN regexp_full_match(trim(G), '\\d+(\\.0+)?') THEN split_part(trim(G), '.', 1) ELSE G END, '[^0-9]', '', 'g') AS c, regexp_replace(concat('00', A, '-4'), '[^0-9]', '', 'g') AS b, A FROM cells),
  nm AS (SELECT row_num, nome, CASE WHEN row_num // 10 % 31 = 0 THEN '99999' ELSE num END AS numero, CASE WHEN rua <> '' AND num <> '' THEN concat(rua, '|', num) END AS endereco, CASE WHEN c <> '' THEN lpad(c, greatest(8, length(c))::INTEGER, '0') END AS cep, CASE WHEN A IS NOT NULL THEN lpad(b, greatest(11, length(b))::INTEGER, '0')[:4] END AS quadra FROM pr),
  tr AS (SELECT nm.*, CASE WHEN upper(trim(nome)) IN ('SANTO AMARO', 'STO AMARO', 'STO. AMARO') THEN nullif(coalesce(parte, 'FORA'), 'FORA') WHEN status IN ('AUTO_CARTEIRA', 'NOVO_BAIRRO') THEN destino END AS proprio,
    CASE WHEN upper(trim(nome)) IN ('SANTO AMARO', 'STO AMARO', 'STO. AMARO') THEN CASE WHEN coalesce(parte, 'FORA') = 'FORA' THEN 'SUGERIDO_FORA' ELSE 'NOVO_BAIRRO' END ELSE status END AS status FROM nm LEFT JOIN dic ON kk = upper(trim(nome)) LEFT JOIN spl ON prefixo = cep[:5])"""
LIKE_PLACE = "(trim(coalesce(nome, '')) <> '' AND NOT regexp_full_match(coalesce(nome, ''), '(?i)\\s*(\\d+|(TORRE|BLOCO|BL|AP|APTO|APART|VAGA|VG|GARAGEM|SALA|LOJA|LT|UNID|UNIDADE|CASA|COND|CONDOMINIO|ED|RES)\\b.*)?\\s*'))"
VOTE = lambda key, name: f"{name} AS (SELECT {key}, proprio AS v_{name} FROM (SELECT {key}, proprio, count(*) AS k, min(row_num) AS f FROM tr WHERE proprio IS NOT NULL AND {key} IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY k DESC, f) = 1)"
RESOLVED = f"""{PLACED}, {VOTE('endereco', 've')}, {VOTE('cep', 'vc')}, vb AS (SELECT quadra, proprio AS v_vb, {r('100 * k / t', 1)} AS sure FROM (SELECT quadra, proprio, k, f, sum(k) OVER (PARTITION BY quadra) AS t FROM (SELECT quadra, proprio, count(*) AS k, min(row_num) AS f FROM tr WHERE proprio IS NOT NULL AND quadra IS NOT NULL GROUP BY 1, 2)) QUALIFY row_number() OVER (PARTITION BY quadra ORDER BY k DESC, f) = 1),
  qq AS (SELECT DISTINCT quadra FROM tr WHERE quadra IS NOT NULL AND {LIKE_PLACE}), j AS (SELECT tr.*, CASE WHEN v_ve IN {TARGETS} AND numero IS DISTINCT FROM '99999' THEN v_ve END AS e, CASE WHEN v_vc IN {TARGETS} THEN v_vc END AS c, v_vb AS b, sure, qq.quadra IS NOT NULL AS alguma FROM tr LEFT JOIN ve USING (endereco) LEFT JOIN vc USING (cep) LEFT JOIN vb USING (quadra) LEFT JOIN qq USING (quadra)),
  res AS (SELECT row_num, nome, CASE WHEN proprio IS NOT NULL THEN proprio WHEN status IN ('SUGERIDO_FORA', 'PADRAO_FORA') THEN NULL ELSE coalesce(e, CASE WHEN sure >= 80 THEN b END, c, CASE WHEN sure >= 60 THEN b END) END AS destino,
    CASE WHEN proprio IS NOT NULL THEN 'campo_original' WHEN status IN ('SUGERIDO_FORA', 'PADRAO_FORA') THEN 'fora_carteira' WHEN e IS NOT NULL THEN 'voto_endereco' WHEN sure >= 80 THEN 'quadra_alta' WHEN c IS NOT NULL THEN 'cep' WHEN sure >= 60 THEN 'quadra_media' WHEN {LIKE_PLACE} OR alguma THEN 'fora_carteira' ELSE 'incerto' END AS metodo FROM j)"""


def _translated(spark, d):
    c, k = F.col, F.floor(F.col("row_num") / 10)
    rows = spread(spark, d, "ABCEG").select(
        "row_num", F.when(k % 29 == 0, "Santo Amaro").otherwise(c("E")).alias("nome"), F.when(k % 31 == 0, resolve.NO_NUMBER).otherwise(street_number(c("C"))).alias("numero"), address_key(c("B"), c("C")).alias("endereco"),
        text.postcode(c("G")).alias("cep"), F.substring(text.block_key(F.concat(F.lit("00"), c("A"), F.lit("-4"))), 1, 4).alias("quadra"),
    )
    words = spark.createDataFrame(list(WORDS), "nome string, destino string, status string")
    return resolve.translated(rows, words, spark.createDataFrame(list(SPLIT), "prefixo string, destino string"))


def _resolved(spark, d):
    rows = settled(_translated(spark, d))  # they vote three times, and are resolved
    return resolve.resolve_places(rows, rows, rows, spark.createDataFrame([(t,) for t in TARGETS], "destino string"), ["row_num"])


@query("translated_names", f"WITH {PLACED} SELECT row_num, nome, cep, proprio, status FROM tr")
def _(spark, d):
    return _translated(spark, d).select("row_num", "nome", "cep", "proprio", "status")


@query("resolved_places", f"WITH {RESOLVED} SELECT row_num, destino, metodo FROM res")
def _(spark, d):
    return _resolved(spark, d).select("row_num", "destino", "metodo")


@query("universe_resolution", f"WITH {RESOLVED} SELECT metodo, destino, count(*) AS n FROM res GROUP BY 1, 2")
def _(spark, d):
    return _resolved(spark, d).groupBy("metodo", "destino").agg(F.count("*").alias("n"))


@query("portfolio_closing", f"WITH {DEALS}, {OFFERS}, s AS (SELECT bairro, count(*) FILTER (revenda AND ano = 2000) AS revenda_12m, count(*) FILTER (planta AND ano = 2000) AS planta_12m FROM deals WHERE bairro <> 'Brand#7' GROUP BY 1), u AS (SELECT bairro, count(*) AS unidades FROM offers WHERE bairro <> 'Brand#9' GROUP BY 1) SELECT bairro, coalesce(revenda_12m, 0) AS revenda_12m, coalesce(planta_12m, 0) AS planta_12m, coalesce(unidades, 0) AS unidades, {r('100 * coalesce(revenda_12m, 0) / unidades', 2)} AS giro FROM s FULL JOIN u USING (bairro)")
def _(spark, d):
    rows = deals(spark, d).where("bairro <> 'Brand#7'").withColumns({"destino": F.col("bairro"), "revenda": F.col("revenda") & (F.col("ano") == 2000), "planta": F.col("planta") & (F.col("ano") == 2000)})
    return resolve.portfolio(rows, offers(spark, d).where("bairro <> 'Brand#9'"))


@query("prefix_majority", f"WITH {DEEDS}, v AS (SELECT split_part(addr_key, '|', 1) AS rua, coalesce(bairro, '') AS v, count(*) AS k, min(row_num) AS f FROM deeds WHERE addr_key IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, CAST(sum(k) OVER (PARTITION BY rua) AS BIGINT) AS n FROM v QUALIFY row_number() OVER (PARTITION BY rua ORDER BY k DESC, f) = 1) SELECT rua, n, CASE WHEN n >= 3 AND v <> '' AND k >= 0.6 * n THEN v END AS destino FROM t")
def _(spark, d):
    rows = deeds(spark, d).where("addr_key is not null").withColumn("rua", F.substring_index("addr_key", "|", 1))
    return resolve.prefix_majority(rows, "rua", "bairro", ["row_num"])


@query(
    "resale_drops",
    """WITH a AS (SELECT o_orderkey AS id, concat('B', o_custkey % 40) AS destino, CASE WHEN o_orderkey % 10 < 8 THEN 'revenda' ELSE 'demais' END AS classe FROM orders), b AS (SELECT o_orderkey AS id, CASE WHEN o_totalprice > 400000 THEN NULL ELSE concat('B', (o_custkey + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END) % 40) END AS destino, CASE WHEN o_orderkey % 10 < 5 THEN 'revenda' WHEN o_orderkey % 10 = 5 THEN 'planta' WHEN o_orderkey % 10 = 6 THEN 'parcial' ELSE 'demais' END AS classe FROM orders WHERE o_custkey % 3 > 0 OR o_orderkey % 10 < 5),
  j AS (SELECT a.destino AS bairro, b.id AS nid, b.destino AS novo, b.classe AS nova FROM a LEFT JOIN b USING (id) WHERE a.classe = 'revenda'), g AS (SELECT bairro, count(*) AS antes, count(*) FILTER (nova = 'revenda' AND novo IS NOT DISTINCT FROM bairro) AS iguais, count(*) FILTER (nova = 'revenda' AND novo IS DISTINCT FROM bairro) AS mudaram, count(*) FILTER (nova = 'planta') AS saiu_planta, count(*) FILTER (nova = 'parcial') AS saiu_parcial, count(*) FILTER (nova = 'demais') AS saiu_demais, count(*) FILTER (nid IS NULL) AS fora FROM j GROUP BY 1),
  n AS (SELECT destino AS bairro, count(*) AS agora FROM b WHERE classe = 'revenda' AND destino IS NOT NULL GROUP BY 1) SELECT g.*, coalesce(agora, 0) AS agora FROM g LEFT JOIN n USING (bairro) WHERE (antes - coalesce(agora, 0)) / antes >= 0.25""",
)
def _(spark, d):
    rows, k = table(spark, d, "orders").withColumnRenamed("o_orderkey", "id"), F.col("id") % 10
    before = rows.select("id", F.concat(F.lit("B"), F.col("o_custkey") % 40).alias("destino"), F.when(k < 8, "revenda").otherwise("demais").alias("classe"))
    moved = (F.col("o_custkey") + F.when(F.col("id") % 17 == 0, 1).otherwise(0)) % 40
    after = rows.where((F.col("o_custkey") % 3 > 0) | (k < 5)).select("id", F.when(F.col("o_totalprice") <= 400000, F.concat(F.lit("B"), moved)).alias("destino"), F.when(k < 5, "revenda").when(k == 5, "planta").when(k == 6, "parcial").otherwise("demais").alias("classe"))
    return resolve.resale_drops(before, after)


@query("old_rule_classes", f"WITH {DEALS}, l AS (SELECT endereco, date_diff('day', dia, lead(dia, 4) OVER (PARTITION BY endereco ORDER BY dia)) <= 182 AS hit FROM deals WHERE limpa AND tipo IS NOT NULL), h AS (SELECT endereco, bool_or(hit) AS hit FROM l GROUP BY 1) SELECT endereco, CASE WHEN hit THEN 'planta' ELSE 'revenda' END AS classe FROM (SELECT DISTINCT endereco FROM deals) LEFT JOIN h USING (endereco)")
def _(spark, d):
    return resolve.old_rule(deals(spark, d).withColumn("valida", F.col("limpa") & F.col("tipo").isNotNull()))


POINTS = "SELECT CAST(user_id % 20 AS INT) AS serie, user_id % 2 = 0 AS mensal, DATE '2022-06-15' + CAST(event_id % 700 AS INT) AS dia, max(CASE WHEN event_type <> 'error' THEN value END) AS valor FROM events GROUP BY ALL"


@query(
    "series_as_of",
    f"""WITH p AS (SELECT * FROM ({POINTS}) WHERE valor IS NOT NULL AND dia <= DATE '2024-03-20'), l AS (SELECT serie, max(dia) AS u, arg_max(valor, dia) AS v, any_value(mensal) AS m FROM p GROUP BY 1), t AS (SELECT *, make_date(year(u - INTERVAL 1 MONTH)::INT, month(u - INTERVAL 1 MONTH)::INT, least(28, day(u))::INT) AS m1, make_date(year(u)::INT - 1, month(u)::INT, least(28, day(u))::INT) AS m12 FROM l),
  j AS (SELECT t.serie, u, v, max(dia) FILTER (CASE WHEN m THEN dia < u ELSE dia <= m1 END) AS da, arg_max(valor, dia) FILTER (CASE WHEN m THEN dia < u ELSE dia <= m1 END) AS a, max(dia) FILTER (dia <= m12) AS dy, arg_max(valor, dia) FILTER (dia <= m12) AS y FROM p JOIN t USING (serie) GROUP BY ALL)
  SELECT serie, u AS dia, v AS valor, a AS anterior, da AS dia_anterior, {r('v - a', 2).replace('v - a', '(v - a)')} AS var_mes, y AS ano, dy AS dia_ano, {r('(v - y)', 2)} AS var_ano FROM j""",
)
def _(spark, d):
    points = table(spark, d, "events").select((F.col("user_id") % 20).cast("int").alias("serie"), (F.col("user_id") % 2 == 0).alias("mensal"), F.date_add(F.lit("2022-06-15").cast("date"), (F.col("event_id") % 700).cast("int")).alias("dia"), F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return watch.series(points.groupBy("serie", "mensal", "dia").agg(F.max("v").alias("valor")), F.lit("2024-03-20").cast("date"))


@query("values_with_fallback", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey * 2 WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS valor, n_nationkey % 3 = 0 AS desatualizado FROM nation")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    return watch.with_fallback(n, n.where("id % 3 > 0").withColumn("valor", F.col("id") * 2), n.where("id % 2 = 0").withColumn("valor", F.col("id")), "id", "valor")


@query("source_freshness", "WITH f AS (SELECT c_custkey AS fonte, CASE WHEN c_custkey % 9 > 0 THEN DATE '2024-01-01' - CAST(c_custkey % 60 AS INT) END AS dia, c_nationkey + 5 AS limite FROM customer) SELECT fonte, CAST(date_diff('day', dia, DATE '2024-01-02') AS INTEGER) AS dias, CASE WHEN dia IS NULL THEN 'sem data' WHEN date_diff('day', dia, DATE '2024-01-02') > limite THEN 'atrasada' ELSE 'em dia' END AS estado FROM f")
def _(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("fonte"), F.when(k % 9 > 0, F.date_sub(F.lit("2024-01-01").cast("date"), (k % 60).cast("int"))).alias("dia"), (F.col("c_nationkey") + 5).alias("limite"))
    return watch.freshness(rows, F.lit("2024-01-02").cast("date"))


@query(
    "cache_refresh",
    """WITH k AS (SELECT c_custkey AS bairro FROM customer), c AS (SELECT c_custkey AS bairro, c_nationkey AS valor, TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 HOUR * (c_custkey * 5 % 1400) AS buscado FROM customer WHERE c_custkey % 5 > 0), w AS (SELECT bairro FROM k WHERE bairro NOT IN (SELECT bairro FROM c WHERE floor((epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(buscado)) / 86400) < 25)), f AS (SELECT bairro, 1000 + bairro AS valor FROM k WHERE bairro % 3 > 0)
  SELECT k.bairro, coalesce(CASE WHEN w.bairro IS NOT NULL THEN f.valor END, c.valor) AS valor, CASE WHEN w.bairro IS NOT NULL AND f.valor IS NOT NULL THEN TIMESTAMP '2024-01-30 12:00:00' ELSE buscado END AS buscado, w.bairro IS NOT NULL AND f.valor IS NULL AS falhou FROM k LEFT JOIN c USING (bairro) LEFT JOIN w USING (bairro) LEFT JOIN f USING (bairro) WHERE coalesce(CASE WHEN w.bairro IS NOT NULL THEN f.valor END, c.valor) IS NOT NULL""",
)
def _(spark, d):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    rows = table(spark, d, "customer").withColumnRenamed("c_custkey", "bairro")
    cache = rows.where("bairro % 5 > 0").selectExpr("bairro", "CAST(c_nationkey AS bigint) AS valor", "timestamp'2024-01-30 12:00:00' - make_interval(0, 0, 0, 0, CAST(bairro * 5 % 1400 AS int)) AS buscado")
    fetched = rows.where("bairro % 3 > 0").selectExpr("bairro", "1000 + bairro AS valor")
    keys = rows.select("bairro")
    return watch.refreshed(keys, cache, fetched, watch.to_fetch(keys, cache, now), now)


INTEREST = """res AS (SELECT event_id AS id, CASE user_id % 3 WHEN 0 THEN concat('Casa B', user_id % 8) ELSE concat('apto b', user_id % 8) END AS texto, CASE WHEN user_id % 4 = 0 THEN [concat('apto b', user_id % 8), concat('casa b', (user_id + 1) % 8)] END AS variantes, CAST(event_id % 3 AS INT) AS mes, CASE WHEN event_id % 7 > 0 THEN CAST(floor(value) AS INT) END AS n FROM events),
  kw AS (SELECT concat('casa b', i) AS palavra, concat('B', i) AS bairro, 'casa' AS termo FROM range(7) t(i) UNION ALL SELECT concat('apto b', i), concat('B', i), 'apto' FROM range(8) t(i)), wd AS (SELECT id, mes, n, unnest(list_distinct(list_concat([lower(texto)], coalesce(variantes, [])))) AS palavra FROM res), mt AS (SELECT id, mes, n, bairro, termo FROM wd JOIN kw USING (palavra)),
  pb AS (SELECT bairro, NULL AS termo, mes, sum(coalesce(n, 0)) AS n FROM (SELECT DISTINCT id, mes, n, bairro FROM mt) GROUP BY ALL), pt AS (SELECT bairro, termo, mes, sum(coalesce(n, 0)) AS n FROM (SELECT DISTINCT id, mes, n, bairro, termo FROM mt) GROUP BY ALL), it AS (SELECT bairro, termo, floor(avg(n) + 0.5) AS media, count(*) AS meses FROM (SELECT * FROM pb UNION ALL SELECT * FROM pt) GROUP BY 1, 2)"""


def _interest(spark, d):
    e, u = table(spark, d, "events"), F.col("user_id") % 8
    name = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("Casa B"), u)).otherwise(F.concat(F.lit("apto b"), u))
    variants = F.when(F.col("user_id") % 4 == 0, F.array(F.concat(F.lit("apto b"), u), F.concat(F.lit("casa b"), (F.col("user_id") + 1) % 8)))
    rows = e.select(F.col("event_id").alias("id"), name.alias("texto"), variants.alias("variantes"), (F.col("event_id") % 3).cast("int").alias("mes"), F.when(F.col("event_id") % 7 > 0, F.floor("value").cast("int")).alias("n"))
    words = [(f"casa b{i}", f"B{i}", "casa") for i in range(7)] + [(f"apto b{i}", f"B{i}", "apto") for i in range(8)]
    return watch.keyword_interest(rows, spark.createDataFrame(words, "palavra string, bairro string, termo string"))


@query("keyword_interest", f"WITH {INTEREST} SELECT * FROM it")
def _(spark, d):
    return _interest(spark, d)


@query("interest_levels", f"WITH {INTEREST}, b AS (SELECT bairro, media FROM it WHERE termo IS NULL), s AS (SELECT list_sort(list(media)) AS v FROM b) SELECT bairro, media, CASE WHEN media >= v[least(len(v), CAST(floor(len(v) * 2 / 3) AS INTEGER) + 1)] THEN 'alto' WHEN media >= v[least(len(v), CAST(floor(len(v) / 3) AS INTEGER) + 1)] THEN 'medio' ELSE 'baixo' END AS nivel FROM b, s")
def _(spark, d):
    return watch.interest_levels(_interest(spark, d).where("termo is null").select("bairro", "media"), "media")


@query("engine_parity", f"WITH {OFFERS}, a AS (SELECT codigo, valor, area FROM offers WHERE codigo % 11 > 0), b AS (SELECT codigo, valor + CASE WHEN codigo % 5 = 0 THEN 0.01 WHEN codigo % 7 = 0 THEN 0.02 ELSE 0 END AS valor, CASE WHEN codigo % 13 > 0 THEN area END AS area FROM offers WHERE codigo % 17 > 0), j AS (SELECT codigo, a.valor AS v1, b.valor AS v2, a.area AS a1, b.area AS a2 FROM a FULL JOIN b USING (codigo)) SELECT codigo, campo, a, b FROM (SELECT codigo, 'valor' AS campo, v1 AS a, v2 AS b FROM j UNION ALL SELECT codigo, 'area', a1, a2 FROM j) WHERE (a IS NULL) <> (b IS NULL) OR abs(a - b) > 0.011")
def _(spark, d):
    rows, k = offers(spark, d), F.col("codigo")
    other = rows.where(k % 17 > 0).select("codigo", (F.col("valor") + F.when(k % 5 == 0, 0.01).when(k % 7 == 0, 0.02).otherwise(0.0)).alias("valor"), F.when(k % 13 > 0, F.col("area")).alias("area"))
    return watch.parity(rows.where(k % 11 > 0), other, "codigo", ["valor", "area"])


WEEKS = f"""WITH {DEALS}, {OFFERS}, nw AS (SELECT bairro, count(*) FILTER (ano = 2000) AS revenda_12m, (SELECT count(*) FROM offers o WHERE o.bairro = d.bairro AND codigo % 4 > 0) AS stock_total, {r('avg(valor) / 100000', 1)} AS prontidao, CASE WHEN bairro > 'Brand#2' THEN '2001-01' ELSE '2000-12' END AS fim FROM deals d GROUP BY 1),
  od AS (SELECT bairro, count(*) FILTER (ano = 1999 AND id % 3 > 0) AS revenda_12m, (SELECT count(*) FROM offers o WHERE o.bairro = d.bairro AND codigo % 3 > 0) AS stock_total, {r('avg(valor) FILTER (ano = 1997) / 100000', 1)} AS prontidao, '2000-12' AS fim FROM deals d GROUP BY 1)"""


def _weeks(spark, d):
    rows, stock = deals(spark, d), offers(spark, d)
    of = lambda when, price, keep, end: rows.groupBy("bairro").agg(panels.count_if(when).alias("revenda_12m"), half_up(F.avg(price) / 100000, 1).alias("prontidao")).join(stock.where(keep).groupBy("bairro").agg(F.count("*").alias("stock_total")), "bairro", "left").select("bairro", "revenda_12m", F.coalesce("stock_total", F.lit(0)).alias("stock_total"), "prontidao", end.alias("fim"))
    now = of(F.col("ano") == 2000, F.col("valor"), "codigo % 4 > 0", F.when(F.col("bairro") > "Brand#2", "2001-01").otherwise("2000-12"))
    return now, of((F.col("ano") == 1999) & (F.col("id") % 3 > 0), F.when(F.col("ano") == 1997, F.col("valor")), "codigo % 3 > 0", F.lit("2000-12"))


CHANGE = lambda c, least, cause: f"SELECT nw.bairro, '{c}' AS campo, od.{c}::DOUBLE AS antes, nw.{c}::DOUBLE AS agora, {least} AS minimo, {cause} AS causa FROM nw JOIN od USING (bairro)"


@query("weekly_changes", f"""{WEEKS}, x AS ({CHANGE('revenda_12m', 10, "CASE WHEN nw.fim <> od.fim THEN 'a janela avançou' ELSE 'guias novas ou atrasadas' END")} UNION ALL {CHANGE('stock_total', 2, "'anúncios entraram e saíram'")} UNION ALL {CHANGE('prontidao', 0.1, "CASE WHEN nw.revenda_12m <> od.revenda_12m THEN 'mudaram as revendas' ELSE 'demais fatores' END")})
  SELECT bairro, campo, antes, agora, {r('(agora - antes) / antes * 100', 1)} AS pct, causa FROM x WHERE antes <> 0 AND abs((agora - antes) / antes * 100) > 20 AND abs(agora - antes) >= minimo""")
def _(spark, d):
    now, before = _weeks(spark, d)
    return watch.weekly_changes(now, before, {"revenda_12m": 10, "stock_total": 2, "prontidao": 0.1})


@query("code_changes", f"WITH {OFFERS}, a AS (SELECT bairro, codigo FROM offers WHERE codigo % 4 > 0), b AS (SELECT bairro, codigo FROM offers WHERE codigo % 3 > 0) SELECT coalesce(a.bairro, b.bairro) AS bairro, count(*) FILTER (b.codigo IS NULL) AS novos, count(*) FILTER (a.codigo IS NULL) AS sairam FROM a FULL JOIN b ON a.codigo = b.codigo AND a.bairro = b.bairro GROUP BY 1")
def _(spark, d):
    rows = offers(spark, d)
    return watch.code_changes(rows.where("codigo % 4 > 0"), rows.where("codigo % 3 > 0"))


@query("rankings", f"WITH {DEALS}, s AS (SELECT bairro, floor(avg(valor) / 50000) AS score, count(*) FILTER (ano = 1998) < 350 AS pequena FROM deals GROUP BY 1) SELECT bairro, CAST(row_number() OVER (ORDER BY score DESC, bairro) AS INTEGER) AS posto, CAST(row_number() OVER (ORDER BY pequena, score DESC, bairro) AS INTEGER) AS prontidao FROM s")
def _(spark, d):
    rows = deals(spark, d).groupBy("bairro").agg(F.floor(F.avg("valor") / 50000).alias("score"), (panels.count_if(F.col("ano") == 1998) < 350).alias("pequena"))
    return watch.ranking(rows, "score", "bairro").join(watch.ranking(rows, "score", "bairro", small="pequena").withColumnRenamed("posto", "prontidao"), "bairro")


@query("forbidden_keys", f"WITH {OFFERS}, k AS (SELECT codigo, CASE codigo % 4 WHEN 0 THEN ['preco_min', 'n'] WHEN 1 THEN ['n', 'preco_max', 'preco_min'] ELSE ['n'] END AS k FROM offers) SELECT codigo, array_to_string(list_sort(list_intersect(k, ['preco_min', 'preco_max', 'preco_medio'])), ',') AS proibidas FROM k WHERE list_has_any(k, ['preco_min', 'preco_max', 'preco_medio'])")
def _(spark, d):
    lists = F.when(F.col("codigo") % 4 == 0, F.array(F.lit("preco_min"), F.lit("n"))).when(F.col("codigo") % 4 == 1, F.array(F.lit("n"), F.lit("preco_max"), F.lit("preco_min"))).otherwise(F.array(F.lit("n")))
    found = watch.prior_with_forbidden(offers(spark, d).select("codigo", lists.alias("k")), "k", ["preco_min", "preco_max", "preco_medio"])
    return found.select("codigo", F.array_join("proibidas", ",").alias("proibidas"))
