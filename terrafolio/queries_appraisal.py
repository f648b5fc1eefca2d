"""Queries of the appraisal, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafolio.functions.expr import half_up
from terrafolio.operators import appraisal, market, order
from terrafolio.operators.appraisal import LADDER, LEVELS, PERCENTILES
from terrafolio.plans.views import OFFERS, deals, offers, table
from terrafolio.queries import query
from terrafolio.queries_panels import FACTORS as FACTORS_SQL
from terrafolio.queries_panels import PRICED
from terrafolio.queries_panels import _today as today_sales

r = lambda x, n=6: f"floor({x} * {10**n} + 0.5) / {10**n}"
SOLD_COLUMNS = "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000 AS venda, l_partkey % 400 AS predio, l_partkey % 80 AS rua, l_partkey % 16 AS bairro, l_quantity * 4 AS area, l_extendedprice * 20 * (1 + l_tax) AS hoje, CAST(l_suppkey % 97 * 11 + 5 AS INT) AS unidade, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INT) AS mes"
SOLD_ROWS = "l_linestatus = 'F' AND l_discount < 0.05"
FACTORS = ((0, 0.97), (1, 0.99), (2, 1.01), (3, 1.03), (4, 1.08))
FLOOR = "CASE WHEN andar < 1 THEN NULL WHEN andar <= 3 THEN 0 WHEN andar <= 7 THEN 1 WHEN andar <= 11 THEN 2 WHEN andar <= 15 THEN 3 WHEN andar <= 99 THEN 4 END"
SOLD = f"""efeito AS (SELECT faixa, CAST(f AS DOUBLE) AS f FROM (VALUES {', '.join(f'({a}, {b})' for a, b in FACTORS)}) t(faixa, f)), crua AS (SELECT {SOLD_COLUMNS} FROM lineitem WHERE {SOLD_ROWS}),
  cv AS (SELECT predio, CASE WHEN max(unidade) >= 1000 OR (count(*) FILTER (unidade BETWEEN 100 AND 999) > 0 AND count(*) FILTER (unidade BETWEEN 100 AND 999 AND unidade % 100 > 20) = 0) THEN 'c' ELSE 'd' END AS convencao FROM crua GROUP BY 1),
  por AS (SELECT crua.*, convencao, CASE WHEN unidade >= 1000 OR (unidade BETWEEN 100 AND 999 AND convencao = 'c') THEN 100 ELSE 10 END AS por FROM crua JOIN cv USING (predio)),
  sold0 AS (SELECT * EXCLUDE (por), CASE WHEN unidade >= 10 AND unidade // por BETWEEN 1 AND 60 THEN unidade // por END AS andar, CASE WHEN unidade >= 10 AND unidade // por BETWEEN 1 AND 60 THEN unidade % por END AS final FROM por),
  sold AS (SELECT sold0.*, coalesce(f, 1) AS ef FROM sold0 LEFT JOIN efeito ON faixa = {FLOOR})"""
REQUEST_COLUMNS = "p_partkey AS id, CASE WHEN p_size % 3 > 0 THEN p_partkey % 400 END AS predio, CASE WHEN p_size % 4 > 0 THEN p_partkey % 80 END AS rua, p_partkey % 16 AS bairro, CAST(p_size * 4 AS DOUBLE) AS area, CASE WHEN p_size % 5 > 0 THEN CAST(p_partkey % 30 AS INT) END AS andar, CAST(NULL AS BIGINT) AS fora_venda, CAST(NULL AS BIGINT) AS fora_predio"


def appraise_sql(requests: str, modes: bool = False) -> str:
    """CTEs that end in ``est``; with ``modes``, of requests that are for one level each."""
    parts = [f"rq AS (SELECT q.*, coalesce(f, 1) AS fu FROM ({requests}) q LEFT JOIN efeito ON faixa = {FLOOR.replace('andar', 'q.andar')})"]
    for level, ((tight, wide), least) in LEVELS.items():
        few = "n2 >= 1" if level == "predio" else "false"
        of = f" AND modo = '{level}'" if modes else ""
        parts.append(f"p_{level} AS (SELECT rq.id, {'modo, ' if modes else ''}rq.area AS a, abs(s.area - rq.area) / rq.area AS d, hoje / s.area / ef * fu AS m, s.mes, s.venda FROM rq JOIN sold s ON s.{level} = rq.{level} AND abs(s.area - rq.area) / rq.area <= {wide}e0{of} WHERE s.venda IS DISTINCT FROM rq.fora_venda AND s.predio IS DISTINCT FROM rq.fora_predio)")
        parts.append(f"c_{level} AS (SELECT id, count(*) FILTER (d <= {tight}e0) AS n1, count(*) AS n2 FROM p_{level} GROUP BY 1)")
        parts.append(f"s_{level} AS (SELECT id, CASE WHEN n1 >= {least} OR n2 >= {least} THEN '{level}' ELSE 'predio_poucas' END AS nivel, n1 < {least} AS ampliada, CASE WHEN n1 >= {least} THEN {tight}e0 ELSE {wide}e0 END AS tol FROM c_{level} WHERE n1 >= {least} OR n2 >= {least} OR {few})")
    if modes:
        every = " UNION ALL ".join(f"SELECT p.id, nivel, ampliada, a, m, mes FROM p_{x} p JOIN s_{x} s ON s.id = p.id AND d <= tol" for x in LEVELS)
    else:
        skip = {"predio": "", "rua": "WHERE p.id NOT IN (SELECT id FROM s_predio)", "bairro": "WHERE p.id NOT IN (SELECT id FROM s_predio) AND p.id NOT IN (SELECT id FROM s_rua)"}
        every = " UNION ALL ".join(f"SELECT p.id, nivel, ampliada, a, m, mes FROM p_{x} p JOIN s_{x} s ON s.id = p.id AND d <= tol {skip[x]}" for x in LEVELS)
    parts.append(f"ag AS (SELECT id, nivel, ampliada, any_value(a) AS a, count(*) AS n, median(m) AS mid, quantile_cont(m, 0.25) AS q1, quantile_cont(m, 0.75) AS q3, min(m) AS lo, max(m) AS hi, max(mes) AS ultima FROM ({every}) GROUP BY ALL)")
    parts.append(f"""est AS (SELECT id, nivel, ampliada, n, {r('mid', 0)} AS m2, {r('mid * a', 0)} AS estimativa, {r('CASE WHEN n >= 5 THEN q1 ELSE lo END * a', 0)} AS minimo, {r('CASE WHEN n >= 5 THEN q3 ELSE hi END * a', 0)} AS maximo, CASE WHEN n >= 5 THEN 'p25_p75' ELSE 'min_max' END AS faixa, CASE WHEN n >= 2 THEN {r('q3 / q1', 3)} END AS razao,
    CASE WHEN nivel = 'predio' AND n >= 5 AND q3 / q1 <= 1.25 THEN 'alta' WHEN nivel = 'predio' OR (nivel = 'predio_poucas' AND n >= 2) OR (nivel = 'rua' AND n >= 8 AND q3 / q1 <= 1.35) THEN 'media' ELSE 'baixa' END AS confianca, ultima FROM ag)""")
    return ", ".join(parts)


def factors(spark):
    return spark.createDataFrame(list(FACTORS), "faixa int, fator double")


def _columns(text: str) -> list[str]:
    depth, parts, last = 0, [], 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(text[last:i].strip())
            last = i + 1
    return [*parts, text[last:].strip()]


def sold(spark, d):
    return appraisal.with_floors(table(spark, d, "lineitem").where(SOLD_ROWS).selectExpr(*_columns(SOLD_COLUMNS)), ["predio"])


def requests(spark, d):
    return table(spark, d, "part").selectExpr(*_columns(REQUEST_COLUMNS))


@query("appraisal_sales", f"WITH {SOLD} SELECT venda, predio, convencao, andar, final, ef AS efeito FROM sold")
def _(spark, d):
    return appraisal.with_factor(sold(spark, d), factors(spark)).select("venda", "predio", "convencao", "andar", "final", "efeito")


@query(
    "merged_buildings",
    """WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS venda, l_partkey AS endereco, CASE WHEN l_linenumber = 7 THEN CAST(l_suppkey % 25 AS INT) ELSE CAST(l_partkey % 25 AS INT) END AS bairro FROM lineitem), c AS (SELECT CAST(n_nationkey AS INT) AS bairro, -235e-1 + (n_nationkey % 5) * 12e-3 AS lat, -466e-1 + (n_nationkey // 5) * 15e-3 AS lon FROM nation WHERE n_nationkey <> 13),
  k AS (SELECT endereco, bairro, count(*) AS k FROM v GROUP BY 1, 2), m AS (SELECT endereco, bairro AS dom FROM k QUALIFY row_number() OVER (PARTITION BY endereco ORDER BY k DESC, bairro) = 1),
  p AS (SELECT k.endereco, k.bairro, dom, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2) AS h FROM k JOIN m USING (endereco) LEFT JOIN c a ON a.bairro = dom LEFT JOIN c b ON b.bairro = k.bairro)
  SELECT v.venda, CASE WHEN v.bairro = dom OR coalesce(6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h)) <= 3, false) THEN dom ELSE v.bairro END AS lugar FROM v JOIN p USING (endereco, bairro)""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS venda", "l_partkey AS endereco", "CAST(CASE WHEN l_linenumber = 7 THEN l_suppkey % 25 ELSE l_partkey % 25 END AS INT) AS bairro")
    k = F.col("n_nationkey")
    centres = table(spark, d, "nation").where("n_nationkey <> 13").select(k.cast("int").alias("bairro"), (F.lit(-23.5) + (k % 5) * 0.012).alias("lat"), (F.lit(-46.6) + F.floor(k / 5) * 0.015).alias("lon"))
    return appraisal.merged_buildings(rows, centres).select("venda", "lugar")


ASKED = f"SELECT {REQUEST_COLUMNS} FROM part"


@query("appraisals", f"WITH {SOLD}, {appraise_sql(ASKED)} SELECT * FROM est")
def _(spark, d):
    return appraisal.appraise(requests(spark, d), sold(spark, d), factors(spark))


@query("second_opinions", f"WITH {SOLD}, {appraise_sql(ASKED.replace('CASE WHEN p_size % 3 > 0 THEN p_partkey % 400 END AS predio', 'CAST(NULL AS BIGINT) AS predio'))} SELECT id, nivel, n, estimativa FROM est")
def _(spark, d):
    # what the street or the neighbourhood says without the building
    asked = requests(spark, d).withColumn("predio", F.lit(None).cast("long"))
    return appraisal.appraise(asked, sold(spark, d), factors(spark)).select("id", "nivel", "n", "estimativa")


@query("similar_sales", f"WITH {SOLD}, {appraise_sql(ASKED)}, o AS (SELECT p.id, p.venda, d, p.mes, s.predio = rq.predio AS mesmo, coalesce(abs(s.andar - rq.andar), 99) AS longe FROM p_predio p JOIN rq USING (id) JOIN sold s ON s.venda = p.venda) SELECT id, venda, CAST(row_number() OVER (PARTITION BY id ORDER BY coalesce(mesmo, false) DESC, d, longe, mes DESC, venda) AS INTEGER) AS posto FROM o QUALIFY posto <= 15")
def _(spark, d):
    return appraisal.most_similar(requests(spark, d), sold(spark, d), factors(spark), "predio")


UNITS = f"md AS (SELECT predio, final, CAST(round(area) AS INTEGER) AS moda FROM sold WHERE final IS NOT NULL GROUP BY predio, final, CAST(round(area) AS INTEGER) QUALIFY row_number() OVER (PARTITION BY predio, final ORDER BY count(*) DESC, CAST(round(area) AS INTEGER)) = 1)"
LISTED = "SELECT p_partkey AS id, p_partkey % 400 AS predio, CAST(p_size % 30 AS INT) AS final, CAST(p_size * 3 AS DOUBLE) AS util, CASE WHEN p_partkey % 7 = 0 THEN 77e0 END AS manual, CASE WHEN p_partkey % 3 = 0 THEN 60e0 END AS planta FROM part"
PAIRS = f"{UNITS}, pr AS (SELECT predio, moda / util AS r FROM ({LISTED}) JOIN md USING (predio, final) WHERE moda / util BETWEEN 0.8 AND 3.5)"
ESTIMATED = f"""{PAIRS}, rz AS (SELECT {r('r', 3)} AS z, row_number() OVER (ORDER BY r) - 1 AS k FROM pr), tt AS (SELECT count(*) AS n, {r('median(r)', 4)} AS mediana FROM pr HAVING count(*) >= 200), oi AS (SELECT *, row_number() OVER (ORDER BY venda) - 1 AS i FROM sold),
  tested AS (SELECT oi.* EXCLUDE (i) REPLACE (area * mediana / z AS area) FROM oi JOIN tt ON true JOIN rz ON k = i * 7919 % n)"""


def calibration_ctes(tested: str) -> str:
    """CTEs that end in ``er`` (tests) and ``ca`` (their calibration) of the sales of ``tested``."""
    asked = " UNION ALL ".join(
        f"SELECT venda AS id, '{m}' AS modo, {p} AS predio, {u} AS rua, bairro, area, andar, {a} AS fora_venda, {b} AS fora_predio, hoje AS real FROM {tested}"
        for m, p, u, a, b in (("predio", "predio", "rua", "venda", "NULL"), ("rua", "NULL", "rua", "NULL", "predio"), ("bairro", "NULL", "NULL", "NULL", "predio"))
    )
    return f"""{appraise_sql(asked, modes=True)}, er AS (SELECT est.nivel, confianca, estimativa, hoje AS real, abs(estimativa - hoje) / hoje AS e, hoje / estimativa AS r FROM est JOIN sold ON venda = id),
  ca AS (SELECT nivel, coalesce(confianca, '*') AS confianca, count(*) AS n, {r('median(e)', 4)} AS mediano, {r('quantile_cont(e, 0.75)', 4)} AS p75, [{", ".join(r(f'quantile_cont(r, {p / 100})', 4) for p in PERCENTILES)}] AS q FROM er GROUP BY GROUPING SETS ((nivel, confianca), (nivel)))"""


def calibration_sql(before: str, tested: str) -> str:
    return f"WITH {SOLD}{before}, {calibration_ctes(tested)}"


CALIBRATED = f"SELECT nivel, confianca, n, mediano, p75, {', '.join(f'q[{i + 1}] AS q{p}' for i, p in enumerate(PERCENTILES))} FROM ca"


def _tests(spark, d, estimated: bool = False):
    """All sales left out in turn."""
    rows = order.kept(sold(spark, d))
    areas = appraisal.estimated_areas(rows, appraisal.area_pairs(_listed(spark, d).withColumnRenamed("util", "area"), rows)) if estimated else None
    return appraisal.left_out(rows, rows, factors(spark), areas)


def _percentiles(calibration):
    return calibration.select("nivel", "confianca", "n", "mediano", "p75", *(F.col("q")[i].alias(f"q{p}") for i, p in enumerate(PERCENTILES)))


@query("appraisal_calibration", f"{calibration_sql('', 'sold')} {CALIBRATED}")
def _(spark, d):
    return _percentiles(appraisal.calibrate(_tests(spark, d)))


@query("appraisal_calibration_estimated", f"{calibration_sql(', ' + ESTIMATED, 'tested')} {CALIBRATED}")
def _(spark, d):
    return _percentiles(appraisal.calibrate(_tests(spark, d, estimated=True)))


@query(
    "appraisal_backtest",
    f"""{calibration_sql('', 'sold')}, mg AS (SELECT er.*, greatest(0.03, least(0.6, coalesce(o.p75, a.p75, 0.35)))::DOUBLE AS m FROM er LEFT JOIN ca o ON o.nivel = er.nivel AND o.confianca = er.confianca AND o.n >= 100 LEFT JOIN ca a ON a.nivel = er.nivel AND a.confianca = '*'),
  fx AS (SELECT nivel, unnest([confianca, '*']) AS confianca, e, (estimativa - real) / real AS v, real BETWEEN {r('estimativa / (1 + m)', 0)} AND {r('estimativa / (1 - m)', 0)} AS dentro FROM mg)
  SELECT nivel, confianca, count(*) AS n, {r('100 * median(e)', 1)} AS erro_mediano, {r('100 * list_sort(list(e))[3 * count(*) // 4 + 1]', 1)} AS erro_p75, {r('100 * avg(CAST(dentro AS INT))', 1)} AS dentro, {r('100 * median(v)', 1)} AS vies FROM fx GROUP BY 1, 2""",
)
def _(spark, d):
    tests = _tests(spark, d)
    return appraisal.backtest(tests, appraisal.calibrate(tests))


# --- the whole chain: clean sales, their own time factors, the floors' own effect, calibration, and verdicts on what is asked
UNIT = "concat(bairro, '|', endereco % 4) AS predio, concat(bairro, '|', endereco % 2) AS rua, bairro"
NUMBERED = SOLD[SOLD.index("cv AS (") : SOLD.index("sold AS (")]
EFFECT = f"""fe AS (SELECT predio, round(area) AS a, andar, hoje / area AS m2 FROM sold0 WHERE andar IS NOT NULL), fg AS (SELECT predio, a, median(m2) AS m FROM fe GROUP BY 1, 2 HAVING count(*) >= 4 AND max(andar) - min(andar) >= 5),
  efeito AS (SELECT faixa, {r('CASE WHEN count(*) >= 200 THEN greatest(0.9, least(1.1, median(x))) ELSE 1 END')} AS f FROM (SELECT {FLOOR} AS faixa, m2 / m AS x FROM fe JOIN fg USING (predio, a)) WHERE faixa IS NOT NULL GROUP BY 1)"""
CHAIN = f"{FACTORS_SQL}, {OFFERS}, crua AS (SELECT id * 1000000 + endereco AS venda, {UNIT}, area, valor * fator AS hoje, unidade, mes FROM hoje WHERE limpa AND tipo = 'apartamento' AND area > 0), {NUMBERED}{EFFECT}, sold AS (SELECT sold0.*, coalesce(f, 1) AS ef FROM sold0 LEFT JOIN efeito ON faixa = {FLOOR})"
CHAINED_REQUESTS = f"SELECT codigo AS id, {UNIT}, area, CAST(NULL AS INTEGER) AS andar, CAST(NULL AS BIGINT) AS fora_venda, CAST(NULL AS VARCHAR) AS fora_predio FROM offers WHERE tipo = 'apartamento' AND area > 0"


def _share_sql(share: int) -> str:
    return f"q[{PERCENTILES.index(share) + 1}]"


CHAINED = f"""{CHAIN}, cal AS (WITH {calibration_ctes('sold')} SELECT * FROM ca), ap AS (WITH {appraise_sql(CHAINED_REQUESTS)} SELECT * FROM est),
  t AS (SELECT ap.*, coalesce(o.p75, e.p75, 0.35) AS p75, coalesce(o.q, e.q) AS q, CASE WHEN valor > 0 THEN valor END AS pedido FROM ap JOIN offers ON codigo = ap.id LEFT JOIN cal o ON o.nivel = ap.nivel AND o.confianca = ap.confianca AND o.n >= 100 LEFT JOIN cal e ON e.nivel = ap.nivel AND e.confianca = '*'),
  m AS (SELECT *, greatest(0.03, least(0.6, p75))::DOUBLE AS m FROM t)
  SELECT id, nivel, confianca, n, estimativa, {r('m * 100', 1)} AS margem, {r('estimativa / (1 + m)', 0)} AS minimo, {r('estimativa / (1 - m)', 0)} AS maximo, {r(f'estimativa * {_share_sql(70)}', 0)} AS teto_verde,
    CASE WHEN q IS NULL OR pedido IS NULL THEN NULL WHEN pedido <= {r(f'estimativa * {_share_sql(25)}', 0)} THEN 'abaixo' WHEN pedido <= {r(f'estimativa * {_share_sql(70)}', 0)} THEN 'dentro' WHEN pedido <= {r(f'estimativa * {_share_sql(85)}', 0)} THEN 'alto' ELSE 'fora' END AS veredito FROM m"""


@query("appraisal_chain", CHAINED)
def _(spark, d):
    unit = ["concat(bairro, '|', endereco % 4) AS predio", "concat(bairro, '|', endereco % 2) AS rua", "bairro"]
    priced = order.kept(deals(spark, d).select(*PRICED, "id", "bairro", "unidade"))  # joined once
    today = today_sales(spark, d, priced).where("limpa and tipo = 'apartamento' and area > 0")
    rows = appraisal.with_floors(today.selectExpr("id * 1000000 + endereco AS venda", *unit, "area", "valor * fator AS hoje", "unidade", "mes"), ["predio"])
    rows = order.settled(rows)
    effect = market.floor_effect(rows.select(F.col("predio").alias("endereco"), "area", "andar", (F.col("hoje") / F.col("area")).alias("m2"))).select("faixa", "fator")
    effect = order.settled(effect)
    calibration = order.settled(appraisal.calibrate(appraisal.left_out(rows, rows, effect)))
    asked = offers(spark, d).where("tipo = 'apartamento' and area > 0")
    requests = asked.selectExpr("codigo AS id", *unit, "area", "CAST(NULL AS INT) AS andar", "CAST(NULL AS BIGINT) AS fora_venda", "CAST(NULL AS STRING) AS fora_predio")
    found = order.settled(appraisal.appraise(requests, rows, effect))
    judged = found.join(asked.select(F.col("codigo").alias("id"), F.when(F.col("valor") > 0, F.col("valor")).alias("pedido")), "id")
    return found.select("id", "nivel", "confianca", "n", "estimativa").join(appraisal.verdicts(judged, calibration).select("id", "margem", "minimo", "maximo", "teto_verde", "veredito"), "id")


# a given calibration, so that the verdicts are of their own
GIVEN = [("predio", "alta", 500, 0.08, 0.02), ("predio", "media", 40, 0.10, 0.20), ("predio", "*", 900, 0.12, 0.22), ("rua", "*", 300, 0.2, 0.7), ("bairro", "*", 300, 0.2, 0.3)]
SPREAD = [0.5 + p / 100 for p in PERCENTILES]


def _given(spark):
    rows = spark.createDataFrame(GIVEN, "nivel string, confianca string, n long, mediano double, p75 double")
    return rows.withColumn("q", F.array(*(F.lit(x) for x in SPREAD)))


@query(
    "verdicts",
    f"""WITH a AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'predio' WHEN 1 THEN 'predio_poucas' WHEN 2 THEN 'rua' WHEN 3 THEN 'bairro' ELSE 'predio' END AS nivel, CASE p_partkey % 3 WHEN 0 THEN 'alta' WHEN 1 THEN 'media' ELSE 'baixa' END AS confianca, floor(p_retailprice * 1000) AS estimativa, CASE WHEN p_size % 9 > 0 THEN floor(p_retailprice * 1000 * (0.5 + p_size / 50)) END AS pedido FROM part),
  c AS (SELECT nivel, confianca, n, CAST(p75 AS DOUBLE) AS p75 FROM (VALUES {", ".join(f"('{a}', '{b}', {n}, {p})" for a, b, n, _, p in GIVEN)}) t(nivel, confianca, n, p75)), q AS (SELECT {[float(x) for x in SPREAD]}::DOUBLE[] AS q, {[float(p) for p in PERCENTILES]}::DOUBLE[] AS y),
  t AS (SELECT a.*, coalesce(o.p75, e.p75) AS p75, coalesce(o.p75, e.p75) IS NOT NULL AS tem FROM a LEFT JOIN c o ON o.nivel = a.nivel AND o.confianca = a.confianca AND o.n >= 100 LEFT JOIN c e ON e.nivel = a.nivel AND e.confianca = '*'), m AS (SELECT *, greatest(0.03, least(0.6, coalesce(p75, 0.35)))::DOUBLE AS m, pedido / estimativa AS x FROM t),
  s AS (SELECT id, max(y[i] + (y[i + 1] - y[i]) * (least(greatest(x, q[i]), q[i + 1]) - q[i]) / (q[i + 1] - q[i])) AS b FROM m, q, (SELECT unnest(range(1, {len(PERCENTILES)})) AS i) WHERE x >= q[i] OR i = 1 GROUP BY 1)
  SELECT id, {r('m * 100', 1)} AS margem, {r('estimativa / (1 + m)', 0)} AS minimo, {r('estimativa / (1 - m)', 0)} AS maximo, {", ".join(f"CASE WHEN tem THEN {r(f'estimativa * q[{PERCENTILES.index(p) + 1}]', 0)} END AS escada_{p}" for p in LADDER)}, CASE WHEN tem THEN {r(f'estimativa * q[{PERCENTILES.index(70) + 1}]', 0)} END AS teto_verde, CASE WHEN tem THEN {r(f'estimativa * q[{PERCENTILES.index(85) + 1}]', 0)} END AS teto_amarelo,
    CASE WHEN NOT tem OR pedido IS NULL THEN NULL WHEN pedido <= {r(f'estimativa * q[{PERCENTILES.index(25) + 1}]', 0)} THEN 'abaixo' WHEN pedido <= {r(f'estimativa * q[{PERCENTILES.index(70) + 1}]', 0)} THEN 'dentro' WHEN pedido <= {r(f'estimativa * q[{PERCENTILES.index(85) + 1}]', 0)} THEN 'alto' ELSE 'fora' END AS veredito, CASE WHEN tem AND pedido IS NOT NULL THEN {r('100 - b', 0)} END AS chegaram FROM m JOIN s USING (id), q""",
)
def _(spark, d):
    k = F.col("p_partkey")
    level = F.when(k % 5 == 1, "predio_poucas").when(k % 5 == 2, "rua").when(k % 5 == 3, "bairro").otherwise("predio")
    sure = F.when(k % 3 == 0, "alta").when(k % 3 == 1, "media").otherwise("baixa")
    asked = F.when(F.col("p_size") % 9 > 0, F.floor(F.col("p_retailprice") * 1000 * (0.5 + F.col("p_size") / 50)).cast("double"))
    rows = table(spark, d, "part").select(k.alias("id"), level.alias("nivel"), sure.alias("confianca"), F.floor(F.col("p_retailprice") * 1000).cast("double").alias("estimativa"), asked.alias("pedido"))
    return appraisal.verdicts(rows, _given(spark)).select("*", *(F.col("escada")[i].alias(f"escada_{p}") for i, p in enumerate(LADDER))).drop("escada")


@query("unit_areas", f"WITH {SOLD}, {UNITS} SELECT * FROM md")
def _(spark, d):
    return appraisal.unit_areas(sold(spark, d))


def _listed(spark, d):
    return table(spark, d, "part").selectExpr(*_columns(LISTED[len("SELECT ") : LISTED.index(" FROM part")]))


@query("useful_area_ratio", f"WITH {SOLD}, {PAIRS} SELECT count(*) AS n, count(DISTINCT predio) AS predios, CASE WHEN count(*) >= 200 THEN {r('median(r)', 4)} END AS mediana, {', '.join(f'CASE WHEN count(*) >= 200 THEN {r(f'quantile_cont(r, {p / 100})', 3)} END AS q{p}' for p in (10, 25, 75, 90))} FROM pr")
def _(spark, d):
    return appraisal.area_ratio(appraisal.area_pairs(_listed(spark, d).withColumnRenamed("util", "area"), sold(spark, d)))


@query("registered_areas", f"WITH {SOLD}, {UNITS}, pl AS (SELECT predio, min(area) AS a, max(area) AS b, median(area) AS meio FROM sold GROUP BY 1), w AS (SELECT l.id, manual, moda, CASE WHEN b <= 1.03 * a THEN meio END AS unica, planta, CASE WHEN l.id % 5 > 0 THEN util END * 1.66 AS estimada FROM ({LISTED}) l LEFT JOIN md USING (predio, final) LEFT JOIN pl USING (predio)) SELECT id, {r('coalesce(manual, moda, unica, planta, estimada)', 2)} AS area, CASE WHEN manual IS NOT NULL THEN 'manual' WHEN moda IS NOT NULL THEN 'final' WHEN unica IS NOT NULL THEN 'unica' WHEN planta IS NOT NULL THEN 'planta' WHEN estimada IS NOT NULL THEN 'util_estimada' END AS origem FROM w")
def _(spark, d):
    rows = _listed(spark, d).withColumn("util", F.when(F.col("id") % 5 > 0, F.col("util")))
    return appraisal.registered_area(rows, sold(spark, d), F.lit(1.66)).withColumn("area", half_up(F.col("area"), 2))
