"""Queries of the publish gate: each check over tables with planted faults, and SQL that counts the rows that break it."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafolio.functions.expr import half_up
from terrafolio.operators import checks
from terrafolio.plans.views import DEALS, OFFERS, deals, offers, table
from terrafolio.queries import query

r = lambda x, n=6: f"floor({x} * {10**n} + 0.5) / {10**n}"


@query("gate_volume_change", f"WITH {DEALS}, c AS (SELECT endereco % 50 AS lugar, count(*) FILTER (ano = 2000) AS a, count(*) FILTER (ano = 2001) AS b FROM deals GROUP BY 1) SELECT lugar, a AS antes, b AS agora FROM c WHERE a + b > 0 AND abs(b - a) > 0.3 * greatest(a, 1)")
def _(spark, d):
    rows = deals(spark, d).select((F.col("endereco") % 50).alias("lugar"), "ano")
    return checks.volume_change(rows.where("ano = 2001"), rows.where("ano = 2000"), "lugar").select("lugar", F.col("b").alias("antes"), F.col("a").alias("agora"))


HIGH = f"WITH {DEALS}, painel AS (SELECT endereco % 2000 AS lugar, count(*) AS n, median(m2) AS pago, median(CASE WHEN tipo = 'casa' THEN m2 END) AS casa FROM deals WHERE valor > 1900000 AND limpa GROUP BY 1)"


@query("gate_format", f"{HIGH} SELECT lugar AS chave, 'sem linha' AS problema FROM (SELECT DISTINCT endereco % 2000 AS lugar FROM deals) WHERE lugar NOT IN (SELECT lugar FROM painel) UNION ALL SELECT lugar, 'sem pago' FROM painel WHERE pago IS NULL UNION ALL SELECT lugar, 'sem casa' FROM painel WHERE casa IS NULL")
def _(spark, d):
    rows = deals(spark, d).withColumn("lugar", F.col("endereco") % 2000)
    panel = rows.where("valor > 1900000 and limpa").groupBy("lugar").agg(F.count("*").alias("n"), F.median("m2").alias("pago"), F.median(F.when(F.col("tipo") == "casa", F.col("m2"))).alias("casa"))
    return checks.missing_or_null(panel, rows, "lugar", ["pago", "casa"])


@query(
    "gate_recompute",
    f"""WITH {DEALS}, ok AS (SELECT bairro, ano, count(*) AS n, median(valor) AS mediana FROM deals WHERE limpa GROUP BY 1, 2), p AS (SELECT bairro, ano, n + CASE WHEN ano = 1997 THEN 1 ELSE 0 END AS n, mediana * CASE WHEN ano % 3 = 0 THEN 1.001e0 ELSE 1 END AS mediana FROM ok WHERE ano <> 1998)
  SELECT bairro, ano, 'só na conferência' AS problema FROM ok WHERE ano = 1998 UNION ALL SELECT bairro, ano, 'n' FROM p WHERE ano = 1997 UNION ALL SELECT p.bairro, p.ano, 'mediana' FROM p JOIN ok USING (bairro, ano) WHERE abs(p.mediana - ok.mediana) > 0.011""",
)
def _(spark, d):
    clean = deals(spark, d).where("limpa")
    panel = clean.groupBy("bairro", "ano").agg(F.count("*").alias("n"), F.median("valor").alias("mediana")).where("ano <> 1998")
    planted = panel.withColumns({"n": F.col("n") + F.when(F.col("ano") == 1997, 1).otherwise(0), "mediana": F.col("mediana") * F.when(F.col("ano") % 3 == 0, 1.001).otherwise(1.0)})
    return checks.parity(planted, checks.medians_by_counts(clean, ["bairro", "ano"], "valor"), ["bairro", "ano"], ["n", "mediana"])


@query("gate_suspended", f"WITH {DEALS}, {OFFERS}, s AS (SELECT bairro, tipo, median(m2) AS pago FROM deals WHERE limpa GROUP BY 1, 2), o AS (SELECT bairro, tipo, median(valor / area) AS pedido FROM offers GROUP BY 1, 2) SELECT bairro, tipo, {r('100 * (pedido - pago) / pago', 1)} AS diferenca FROM s JOIN o USING (bairro, tipo) WHERE tipo = 'apartamento' AND pago IS NOT NULL AND pedido IS NOT NULL")
def _(spark, d):
    paid = deals(spark, d).where("limpa").groupBy("bairro", "tipo").agg(F.median("m2").alias("pago"))
    asked = offers(spark, d).groupBy("bairro", "tipo").agg(F.median(F.col("valor") / F.col("area")).alias("pedido"))
    both = paid.join(asked, ["bairro", "tipo"]).select("bairro", "tipo", half_up(100 * (F.col("pedido") - F.col("pago")) / F.col("pago"), 1).alias("diferenca"))
    return checks.suspended_prices(both, "tipo", ("apartamento",), "diferenca")


@query(
    "gate_windows",
    f"""WITH {DEALS}, c AS (SELECT endereco % 300 AS lugar, count(*) FILTER (ano = 2001) AS a, count(*) FILTER (ano >= 2000) AS b, count(*) FILTER (ano >= 1999) AS c FROM deals WHERE limpa GROUP BY 1), w AS (SELECT lugar, CASE WHEN a >= 30 THEN 12 WHEN b >= 30 THEN 24 ELSE 36 END AS months, CASE WHEN a >= 30 THEN a WHEN b >= 30 THEN b ELSE c END AS n FROM c),
  p AS (SELECT lugar, CASE WHEN lugar % 11 = 0 THEN 12 WHEN lugar % 13 = 0 THEN 18 ELSE months END AS months, n, (n < 30) <> (lugar % 7 = 0) AS few FROM w)
  SELECT lugar, CAST(months AS INTEGER) AS months, n, few FROM p WHERE months NOT IN (12, 24, 36) OR (months < 36 AND (n < 30 OR few)) OR (months = 36 AND few = (n >= 30))""",
)
def _(spark, d):
    in_years = lambda since, upto=9999: F.sum(F.col("ano").between(since, upto).cast("int"))
    counts = deals(spark, d).where("limpa").groupBy((F.col("endereco") % 300).alias("lugar")).agg(in_years(2001, 2001).alias("a"), in_years(2000).alias("b"), in_years(1999).alias("c"))
    months = F.when(F.col("a") >= 30, 12).when(F.col("b") >= 30, 24).otherwise(36)
    n = F.when(F.col("a") >= 30, F.col("a")).when(F.col("b") >= 30, F.col("b")).otherwise(F.col("c"))
    k = F.col("lugar")
    planted = counts.select("lugar", F.when(k % 11 == 0, 12).when(k % 13 == 0, 18).otherwise(months).alias("months"), n.alias("n")).withColumn("few", (F.col("n") < 30) != (k % 7 == 0))
    return checks.window_mismatch(planted).select("lugar", "months", "n", "few")


@query("gate_searches", "WITH e AS (SELECT event_id, CAST(ts AS DATE) AS dia, CAST(date_diff('day', CAST(ts AS DATE), DATE '2024-02-10') + CASE WHEN event_id % 9 = 0 THEN 2 ELSE event_id % 2 END AS INTEGER) AS idade, event_id % 5 = 0 AS falhou FROM events), f AS (SELECT *, CASE WHEN event_id % 17 > 0 THEN idade < 30 AND NOT falhou END AS fresco FROM e) SELECT event_id, idade, fresco FROM f WHERE abs(date_diff('day', dia, DATE '2024-02-10') - idade) > 1 OR fresco IS DISTINCT FROM (idade < 30 AND NOT falhou)")
def _(spark, d):
    k = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.to_date("ts").alias("dia"), (k % 5 == 0).alias("falhou"))
    aged = rows.withColumn("idade", (F.datediff(F.lit("2024-02-10").cast("date"), "dia") + F.when(k % 9 == 0, 2).otherwise(k % 2)).cast("int"))
    marked = aged.withColumn("fresco", F.when(k % 17 > 0, (F.col("idade") < 30) & ~F.col("falhou")))
    return checks.stale_marks(marked, "2024-02-10").select("event_id", "idade", "fresco")


@query(
    "gate_payments",
    f"""WITH {DEALS}, c AS (SELECT bairro, ano, endereco % 40 AS parte, count(*) AS vendas, count(*) FILTER (financiamento IS NULL) AS a, count(*) FILTER (financiamento IS NOT NULL) AS b, median(100 * financiado / valor) AS mediana, count(*) FILTER (financiado > 0) AS n_mediana FROM deals GROUP BY 1, 2, 3),
  p AS (SELECT bairro, ano, parte, vendas, a, b + CASE WHEN parte = 3 THEN 1 ELSE 0 END AS b, 100 * a / vendas AS x, 100 * b / vendas + CASE WHEN parte = 5 THEN 0.06e0 WHEN parte = 6 THEN 0.04e0 ELSE 0 END AS y, (vendas < 30) <> (parte = 7) AS poucas, mediana, n_mediana FROM c),
  f AS (SELECT bairro, ano, parte, unnest([CASE WHEN abs(x + y - 100) > 0.05 THEN 'soma' END, CASE WHEN a + b <> vendas THEN 'contagem' END, CASE WHEN poucas <> (vendas < 30) THEN 'poucas' END, CASE WHEN mediana > 100 THEN 'mediana' END, CASE WHEN mediana IS NOT NULL AND n_mediana < 4 THEN 'amostra' END]) AS problema FROM p)
  SELECT * FROM f WHERE problema IS NOT NULL""",
)
def _(spark, d):
    rows = deals(spark, d).withColumn("parte", F.col("endereco") % 40)
    count = lambda c: F.sum(c.cast("int"))
    groups = rows.groupBy("bairro", "ano", "parte").agg(F.count("*").alias("vendas"), count(F.col("financiamento").isNull()).alias("a"), count(F.col("financiamento").isNotNull()).alias("b"), F.median(100 * F.col("financiado") / F.col("valor")).alias("mediana"), count(F.col("financiado") > 0).alias("n_mediana"))
    k = F.col("parte")
    more, off = F.when(k == 3, 1).otherwise(0), F.when(k == 5, 0.06).when(k == 6, 0.04).otherwise(0.0)
    mixes = groups.select("bairro", "ano", "parte", "vendas", F.array(F.col("a"), F.col("b") + more).cast("array<double>").alias("n"), F.array(100 * F.col("a") / F.col("vendas"), 100 * F.col("b") / F.col("vendas") + off).alias("pct"), ((F.col("vendas") < 30) != (k == 7)).alias("poucas"), "mediana", "n_mediana")
    return checks.mix_mismatch(mixes, ["bairro", "ano", "parte"])


STATES = """e AS (SELECT user_id AS codigo, min_by(value, event_id) AS preco_inicial, max_by(value, event_id) AS preco_atual, min(CAST(ts AS DATE)) AS visto_primeira, max(CAST(ts AS DATE)) AS visto_ultima, count(*) - 1 AS mudancas FROM events GROUP BY 1),
  s AS (SELECT codigo, preco_inicial, preco_atual, CASE WHEN codigo % 19 = 0 THEN visto_ultima + 5 ELSE visto_primeira END AS visto_primeira, visto_ultima, CASE WHEN codigo % 4 = 0 THEN visto_ultima + 1 WHEN codigo % 23 = 0 THEN visto_ultima END AS saida, CASE WHEN codigo % 5 = 0 THEN 0 ELSE mudancas END AS mudancas FROM e),
  h AS (SELECT codigo, min(preco_atual) + CASE WHEN codigo % 7 = 0 THEN 1 ELSE 0 END AS hoje FROM e WHERE codigo % 4 > 0 OR codigo % 3 = 0 GROUP BY codigo)"""


@query(
    "gate_history",
    f"""WITH {STATES}, f AS (SELECT coalesce(s.codigo, h.codigo) AS codigo, unnest([CASE WHEN s.codigo % 29 = 0 THEN 'repetido' END, CASE WHEN hoje IS NOT NULL AND NOT (s.codigo IS NOT NULL AND saida IS NULL) THEN 'não está ativo' END, CASE WHEN s.codigo IS NOT NULL AND saida IS NULL AND hoje IS NULL THEN 'não está à venda' END, CASE WHEN saida IS NULL AND preco_atual <> hoje THEN 'preço' END,
    CASE WHEN visto_primeira > visto_ultima OR saida <= visto_ultima THEN 'datas' END, CASE WHEN mudancas = 0 AND preco_inicial <> preco_atual THEN 'mudança' END]) AS problema FROM (SELECT * FROM s WHERE codigo % 31 > 0) s FULL JOIN (SELECT * FROM h WHERE codigo % 37 > 0) h ON h.codigo = s.codigo) SELECT * FROM f WHERE problema IS NOT NULL""",
)
def _(spark, d):
    k, day = F.col("codigo"), F.to_date("ts")
    states = table(spark, d, "events").groupBy(F.col("user_id").alias("codigo")).agg(F.min_by("value", "event_id").alias("preco_inicial"), F.max_by("value", "event_id").alias("preco_atual"), F.min(day).alias("visto_primeira"), F.max(day).alias("visto_ultima"), (F.count("*") - 1).alias("mudancas"))
    today = states.where((k % 4 > 0) | (k % 3 == 0)).where(k % 37 > 0).select("codigo", (F.col("preco_atual") + F.when(k % 7 == 0, 1).otherwise(0)).alias("preco"))
    last = F.col("visto_ultima")
    planted = states.withColumns({"visto_primeira": F.when(k % 19 == 0, F.date_add(last, 5)).otherwise(F.col("visto_primeira")), "saida": F.when(k % 4 == 0, F.date_add(last, 1)).when(k % 23 == 0, last), "mudancas": F.when(k % 5 == 0, 0).otherwise(F.col("mudancas"))}).where(k % 31 > 0)
    return checks.history_mismatch(planted.union(planted.where(k % 29 == 0)), today)


@query(
    "gate_series",
    """WITH s AS (SELECT concat('S', c_custkey) AS serie, DATE '2024-01-01' + CAST(c_custkey % 50 AS INTEGER) AS dia, CASE WHEN c_custkey % 6 > 0 THEN c_acctbal END AS valor, c_acctbal - c_nationkey AS anterior, c_nationkey + CASE WHEN c_custkey % 8 = 0 THEN 0.02e0 ELSE 0 END AS variacao, c_custkey % 4 > 0 AS atual FROM customer WHERE c_custkey % 5 > 0),
  f AS (SELECT serie, unnest([CASE WHEN dia > DATE '2024-02-10' THEN 'futuro' END, CASE WHEN atual AND valor IS NULL THEN 'sem valor' END, CASE WHEN abs(floor((valor - anterior) * 100 + 0.5) / 100 - variacao) > 0.005 THEN 'variação' END]) AS problema FROM s)
  SELECT * FROM f WHERE problema IS NOT NULL UNION ALL SELECT x, 'falta' FROM (VALUES ('S5'), ('S10')) t(x) WHERE x NOT IN (SELECT serie FROM s)""",
)
def _(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").where(k % 5 > 0).select(F.concat(F.lit("S"), k).alias("serie"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 50).cast("int")).alias("dia"), F.when(k % 6 > 0, F.col("c_acctbal")).alias("valor"), (F.col("c_acctbal") - F.col("c_nationkey")).alias("anterior"), (F.col("c_nationkey") + F.when(k % 8 == 0, 0.02).otherwise(0.0)).alias("variacao"), (k % 4 > 0).alias("atual"))
    return checks.series_mismatch(rows, ["S1", "S5", "S10"], "2024-02-10")
