"""Named queries of the market operators over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafolio.functions import expr, stats
from terrafolio.functions.expr import half_up
from terrafolio.operators import addresses, checks, clean, geo, history, market, period, prices, resolve, scoring, valuation
from terrafolio.params import DEFAULT
from terrafolio.plans.views import DEAR, LISTINGS, SALES, dear_sales, listings, sales, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "neighbourhood_score"
#: The order that decides which of several equal sales comes first.
ARRIVAL = ["dia", "pedido", "linha", "endereco", "cartorio", "valor", "area"]
ORDER = ", ".join(ARRIVAL)

CLEAN = f"""{SALES}, clean AS (
  SELECT *, CASE WHEN tipo IS NULL THEN 'sem_tipo' WHEN NOT coalesce(natureza = 'F', false) THEN 'nao_venda'
    WHEN NOT coalesce(desconto < 0.1, false) THEN 'parcial'
    WHEN valor IS NULL OR valor NOT BETWEEN 10000 AND 100000000 THEN 'irreal'
    WHEN area * 1500 > 0 AND valor < 0.6 * (area * 1500) THEN 'subdeclarado' END AS motivo FROM sales)"""
PERIOD = """, counts AS (SELECT mes AS m, count(*) AS n FROM sales GROUP BY 1),
  ranked AS (SELECT m, n, row_number() OVER (ORDER BY m) - 1 AS k, lag(n, 1) OVER (ORDER BY m) AS a, lag(n, 2) OVER (ORDER BY m) AS b, lag(n, 3) OVER (ORDER BY m) AS c FROM counts),
  base AS (SELECT max(m) AS base FROM ranked WHERE k <= 2 OR NOT (n < 0.5 * list_sort([a, b, c])[2]))"""


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def also(name: str, known: str) -> None:
    """A second name of a query, with its SQL."""
    QUERIES[name], ORACLES[name] = QUERIES[known], ORACLES[known]


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    s = sales(spark, d)
    return clean.clean_layer(s, F.col("tipo"), F.col("natureza") == "F", F.col("desconto") < 0.1, F.col("valor"), F.col("area") * 1500.0)


@query("clean_layer_audit", f"WITH {CLEAN} SELECT coalesce(motivo, 'limpa') AS motivo, count(*) AS n FROM clean GROUP BY 1")
def _(spark, d):
    return clean.audit(cleaned(spark, d))


@query("clean_layer_reason", f"WITH {CLEAN} SELECT pedido, linha, endereco, valor, motivo FROM clean WHERE motivo IS NOT NULL AND motivo <> 'nao_venda'")
def _(spark, d):
    return cleaned(spark, d).where("motivo is not null and motivo <> 'nao_venda'").select("pedido", "linha", "endereco", "valor", "motivo")


@query("sale_classes", f"WITH {SALES} SELECT bairro, CASE WHEN natureza <> 'F' THEN NULL WHEN desconto < 0.05 AND linha < 4 THEN 'revenda' WHEN desconto < 0.05 THEN 'demais' WHEN linha < 4 THEN 'parcial' WHEN pagamento = 'R' OR cartorio % 3 = 0 THEN 'planta' ELSE 'demais' END AS classe, count(*) AS n FROM sales GROUP BY 1, 2")
def _(spark, d):
    usage = F.when(F.col("linha") == 1, "10").when(F.col("linha") < 4, "20").otherwise("30")
    complement = F.when(F.col("cartorio") % 3 == 0, F.concat(F.lit("fundos, apto"), F.lit(" "), F.col("cartorio").cast("string"))).when(F.col("cartorio") % 3 == 1, "APARTADO 7")
    financing = F.when(F.col("pagamento") == "R", "2.x").otherwise("12.x")
    kind = clean.sale_class(F.col("natureza") == "F", F.col("desconto") < 0.05, usage, complement, financing)
    return sales(spark, d).groupBy("bairro", kind.alias("classe")).agg(F.count("*").alias("n"))


@query("dedup_first_wins", f"WITH {SALES} SELECT pedido, linha, endereco, valor, dia FROM sales QUALIFY row_number() OVER (PARTITION BY pedido, linha ORDER BY {ORDER}) = 1")
def _(spark, d):
    return clean.dedup_first(sales(spark, d), ["pedido", "linha"], ARRIVAL).select("pedido", "linha", "endereco", "valor", "dia")


@query("cap_exact_area", f"WITH {SALES} SELECT bairro, area, pedido, linha, valor FROM sales QUALIFY row_number() OVER (PARTITION BY bairro, floor(area * 100 + 0.5) / 100 ORDER BY {ORDER}) <= 5")
def _(spark, d):
    return clean.cap_exact_area(sales(spark, d), ARRIVAL).select("bairro", "area", "pedido", "linha", "valor")


@query("area_bands", f"WITH {SALES} SELECT tipo, CASE WHEN area < 0 THEN NULL WHEN area <= 50 THEN 'ate_50' WHEN area <= 80 THEN '50_80' WHEN area <= 120 THEN '80_120' ELSE 'mais_120' END AS faixa, count(*) AS n FROM (SELECT tipo, area * 3 AS area FROM sales) GROUP BY 1, 2")
def _(spark, d):
    return sales(spark, d).groupBy("tipo", expr.area_band(F.col("area") * 3).alias("faixa")).agg(F.count("*").alias("n"))


@query("modal_bucket", f"WITH {SALES}, b AS (SELECT bairro, floor(area / 20) AS b, count(*) AS n FROM sales GROUP BY 1, 2) SELECT bairro, CAST(b * 20 AS DOUBLE) AS low, CAST((b + 1) * 20 AS DOUBLE) AS high, n FROM b QUALIFY row_number() OVER (PARTITION BY bairro ORDER BY n DESC, b) = 1")
def _(spark, d):
    return stats.modal_bucket(sales(spark, d), ["bairro"], "area").select("bairro", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), "n")


@query("mode_tie_smallest", f"WITH {SALES}, c AS (SELECT endereco, area, count(*) AS n FROM sales GROUP BY 1, 2) SELECT endereco, area AS mode, n FROM c QUALIFY row_number() OVER (PARTITION BY endereco ORDER BY n DESC, area) = 1")
def _(spark, d):
    return stats.smallest_mode(sales(spark, d), ["endereco"], "area")


@query("majority_first_met", f"WITH {SALES}, c AS (SELECT endereco, pagamento, count(*) AS votes, min(struct_pack(a := dia, b := pedido, c := linha)) AS f FROM sales GROUP BY 1, 2) SELECT endereco, pagamento AS winner, votes, CAST(sum(votes) OVER (PARTITION BY endereco) AS BIGINT) AS n FROM c QUALIFY row_number() OVER (PARTITION BY endereco ORDER BY votes DESC, f, pagamento) = 1")
def _(spark, d):
    return stats.majority(sales(spark, d), ["endereco"], "pagamento", ["dia", "pedido", "linha"])


@query("median_by_segment", f"WITH {SALES} SELECT bairro, tipo, floor(median(m2) * 1000000 + 0.5) / 1000000 AS mediana, floor(quantile_cont(m2, 0.25) * 1000000 + 0.5) / 1000000 AS p25, floor(quantile_cont(m2, 0.75) * 1000000 + 0.5) / 1000000 AS p75, count(*) AS n FROM sales GROUP BY 1, 2")
def _(spark, d):
    return sales(spark, d).groupBy("bairro", "tipo").agg(half_up(F.median("m2"), 6).alias("mediana"), half_up(stats.quantile("m2", 0.25), 6).alias("p25"), half_up(stats.quantile("m2", 0.75), 6).alias("p75"), F.count("*").alias("n"))


@query(
    "iqr_trim_median",
    f"""WITH {SALES}, f AS (SELECT bairro, tipo, count(*) AS n, quantile_cont(valor, 0.25) AS q1, quantile_cont(valor, 0.75) AS q3 FROM sales GROUP BY 1, 2)
  SELECT bairro, tipo, floor(median(valor) * 100 + 0.5) / 100 AS mediana, count(*) AS n FROM sales JOIN f USING (bairro, tipo)
  WHERE f.n < 4 OR q3 = q1 OR valor BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1, 2""",
)
def _(spark, d):
    return stats.trim_iqr(sales(spark, d), ["bairro", "tipo"], "valor").groupBy("bairro", "tipo").agg(half_up(F.median("valor"), 2).alias("mediana"), F.count("*").alias("n"))


@query("period_base_month", f"WITH {SALES}{PERIOD} SELECT base, base - 2 AS window_end, base - 13 AS window_start, base - 25 AS previous_start FROM base")
def _(spark, d):
    return period.base_month(sales(spark, d))


VOLUME = f"""WITH {CLEAN}{PERIOD}, w AS (SELECT base - 2 AS e FROM base),
  v AS (SELECT bairro, count(*) FILTER (motivo IS NULL AND mes <= e AND mes > e - 12) AS limpas_12m, count(*) FILTER (motivo IS NULL AND mes <= e - 12 AND mes > e - 24) AS limpas_anterior,
    count(*) FILTER (motivo IS NULL AND mes > e) AS limpas_incompleto, count(*) FILTER (mes <= e AND mes > e - 12) AS todas_12m, count(*) FILTER (mes <= e - 12 AND mes > e - 24) AS todas_anterior, count(*) FILTER (mes > e) AS todas_incompleto
  FROM clean, w GROUP BY 1)"""


@query("volume_12m_counters", f"{VOLUME} SELECT * FROM v")
def _(spark, d):
    return period.volume_12m(cleaned(spark, d), ["bairro"], {"limpas": F.col("limpa"), "todas": F.lit(True)})


@query("guarded_trend", f"{VOLUME} SELECT bairro, CASE WHEN todas_12m >= 50 AND todas_anterior >= 50 THEN floor(greatest(-1, least(1, (todas_12m - todas_anterior) / todas_anterior)) * 10000 + 0.5) / 10000 END AS tendencia FROM v")
def _(spark, d):
    v = period.volume_12m(sales(spark, d), ["bairro"], {"todas": F.lit(True)})
    return v.select("bairro", half_up(period.guarded_trend(F.col("todas_12m"), F.col("todas_anterior")), 4).alias("tendencia"))


@query(
    "trend_year_h1",
    f"""WITH {SALES}, c AS (SELECT bairro, count(*) FILTER (year(dia) = 2000) AS a, count(*) FILTER (year(dia) = 1999) AS b, count(*) FILTER (year(dia) = 2000 AND month(dia) <= 6) AS c, count(*) FILTER (year(dia) = 1999 AND month(dia) <= 6) AS d FROM sales GROUP BY 1),
  g AS (SELECT bairro, CASE WHEN b > 0 THEN greatest(-1, least(1, (a - b) / b)) END AS x, CASE WHEN d > 0 THEN greatest(-1, least(1, (c - d) / d)) END AS y FROM c)
  SELECT bairro, floor(coalesce((x + y) / 2, x, y) * 10000 + 0.5) / 10000 AS trend FROM g""",
)
def _(spark, d):
    return period.year_half_trend(sales(spark, d), ["bairro"], 2001).select("bairro", half_up(F.col("trend"), 4).alias("trend"))


@query(
    "neighbourhood_score",
    f"""{VOLUME}, t AS (SELECT bairro, limpas_12m AS vendas_12m, limpas_anterior AS vendas_anterior, CASE WHEN limpas_12m >= 50 AND limpas_anterior >= 50 THEN greatest(-1, least(1, (limpas_12m - limpas_anterior) / limpas_anterior)) END AS t FROM v),
  m AS (SELECT avg(vendas_12m) AS vm, stddev_pop(vendas_12m) AS vs, avg(t) AS tm, stddev_pop(t) AS ts, count(vendas_12m) AS vn, count(t) AS tn FROM t),
  z AS (SELECT t.*, ((CASE WHEN vn < 2 THEN 0 ELSE (vendas_12m - vm) / CASE WHEN vs > 0 THEN vs ELSE 1 END END) + (CASE WHEN t IS NULL THEN -2 WHEN tn < 2 THEN 0 ELSE (t - tm) / CASE WHEN ts > 0 THEN ts ELSE 1 END END)) / 2 AS z FROM t, m)
  SELECT bairro, vendas_12m, vendas_anterior, floor(t * 10000 + 0.5) / 10000 AS tendencia,
    floor(100 * (z - min(z) OVER ()) / (CASE WHEN max(z) OVER () > min(z) OVER () THEN max(z) OVER () - min(z) OVER () ELSE 1 END) * 10 + 0.5) / 10 AS score FROM z""",
)
def _(spark, d):
    return scoring.neighbourhood_score(cleaned(spark, d), F.col("limpa"))


@query("tercile_cuts", f"WITH {SALES}, c AS (SELECT bairro, count(*) AS n FROM sales GROUP BY 1), s AS (SELECT list_sort(list(n)) AS v FROM c) SELECT v[least(len(v), CAST(floor(len(v) / 3) AS INTEGER) + 1)] AS low, v[least(len(v), CAST(floor(len(v) * 2 / 3) AS INTEGER) + 1)] AS high FROM s")
def _(spark, d):
    return stats.tercile_cuts(sales(spark, d).groupBy("bairro").agg(F.count("*").alias("n")), "n")


BANDS = f"""WITH {SALES}{PERIOD}, {LISTINGS}, w AS (SELECT base - 2 AS e FROM base),
  c AS (SELECT bairro, tipo, count(*) FILTER (mes <= e AND mes > e - 12) AS a, count(*) FILTER (mes <= e AND mes > e - 24) AS b, count(*) FILTER (mes <= e AND mes > e - 36) AS c FROM sales, w GROUP BY 1, 2),
  k AS (SELECT bairro, tipo, CASE WHEN a >= 30 THEN 12 WHEN b >= 30 THEN 24 ELSE 36 END AS months, c < 30 AS few FROM c),
  bands AS (SELECT bairro, tipo, any_value(months) AS months, any_value(few) AS few, count(*) AS n, quantile_cont(valor, 0.25) AS low, quantile_cont(valor, 0.75) AS high FROM sales JOIN k USING (bairro, tipo), w WHERE mes <= e AND mes > e - months GROUP BY 1, 2)"""


def _bands(spark, d):
    s = sales(spark, d)
    return prices.adaptive_band(s, listings(spark, d), ["bairro", "tipo"], period.base_month(s).select("window_end").scalar())


@query("adaptive_window_band", f"{BANDS} SELECT bairro, tipo, months, few, n, floor(low * 1000000 + 0.5) / 1000000 AS low, floor(high * 1000000 + 0.5) / 1000000 AS high, (SELECT count(*) FROM listings l WHERE l.bairro = b.bairro AND l.tipo = b.tipo AND pedido_valor BETWEEN low AND high) AS stock FROM bands b")
def _(spark, d):
    return _bands(spark, d).select("bairro", "tipo", "months", "few", "n", half_up(F.col("low"), 6).alias("low"), half_up(F.col("high"), 6).alias("high"), "stock")


@query(
    "payment_mix_100",
    f"""WITH {SALES}, c AS (SELECT bairro, tipo, pagamento, count(*) AS n FROM sales GROUP BY 1, 2, 3 UNION ALL SELECT bairro, 'total', pagamento, count(*) FROM sales GROUP BY 1, 3),
  e AS (SELECT *, floor(n * 1000 / sum(n) OVER (PARTITION BY bairro, tipo)) AS f, floor((n * 1000 / sum(n) OVER (PARTITION BY bairro, tipo) - floor(n * 1000 / sum(n) OVER (PARTITION BY bairro, tipo))) * 1e9 + 0.5) / 1e9 AS r FROM c)
  SELECT bairro, tipo, pagamento, n, (f + CASE WHEN row_number() OVER (PARTITION BY bairro, tipo ORDER BY r DESC, pagamento) <= 1000 - sum(f) OVER (PARTITION BY bairro, tipo) THEN 1 ELSE 0 END) / 10 AS pct FROM e""",
)
def _(spark, d):
    return prices.payment_mix(sales(spark, d))


SEGMENTS = f"""WITH {SALES}, {LISTINGS}, hoje AS (SELECT max(dia) AS h FROM sales),
  paid AS (SELECT bairro, tipo, CASE WHEN area <= 50 THEN 'ate_50' WHEN area <= 80 THEN '50_80' ELSE '80_120' END AS faixa, median(m2) AS pago, quantile_cont(m2, 0.25) AS p25, quantile_cont(m2, 0.75) AS p75, count(*) FILTER (date_diff('day', dia, h) BETWEEN 0 AND 365) AS recentes FROM sales, hoje GROUP BY 1, 2, 3),
  raw AS (SELECT bairro, tipo, CASE WHEN area <= 50 THEN 'ate_50' WHEN area <= 80 THEN '50_80' ELSE '80_120' END AS faixa, pedido_valor / area AS x FROM listings WHERE area > 0),
  f AS (SELECT bairro, tipo, faixa, count(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM raw GROUP BY 1, 2, 3),
  asked AS (SELECT bairro, tipo, faixa, median(x) AS pedido, count(*) AS anuncios FROM raw JOIN f USING (bairro, tipo, faixa) WHERE f.n < 4 OR q1 = q3 OR x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1, 2, 3),
  seg AS (SELECT bairro, tipo, faixa, pago, p25, p75, coalesce(recentes, 0) AS recentes, pedido, coalesce(anuncios, 0) AS anuncios, CASE WHEN pago > 0 THEN floor((pedido - pago) / pago * 100 * 10 + 0.5) / 10 END AS gap, coalesce(recentes, 0) < 10 AS pequena FROM paid FULL JOIN asked USING (bairro, tipo, faixa))"""
# quartiles of numbers with two decimals have up to four: more digits leave no ties to round
R2 = lambda *names: ", ".join(f"floor({n} * 1000000 + 0.5) / 1000000 AS {n}" for n in names)


def _segments(spark, d):
    s = sales(spark, d)
    return prices.paid_and_asked(s, listings(spark, d), s.agg(F.max("dia")).scalar())


def _rounded(df, *names):
    return df.select(*(half_up(F.col(c), 6).alias(c) if c in names else c for c in df.columns))


@query("paid_asked_full_outer", f"{SEGMENTS} SELECT bairro, tipo, faixa, {R2('pago', 'p25', 'p75')}, recentes, {R2('pedido')}, anuncios, gap, pequena FROM seg")
def _(spark, d):
    return _rounded(_segments(spark, d), "pago", "p25", "p75", "pedido")


@query("suspended_segments", f"{SEGMENTS} SELECT bairro, tipo, faixa, CASE WHEN tipo NOT IN ('ECONOMY', 'SMALL') THEN gap END AS gap, pequena FROM seg")
def _(spark, d):
    return prices.suspended(_segments(spark, d), ("ECONOMY", "SMALL")).select("bairro", "tipo", "faixa", "gap", "pequena")


@query("representative_segment", f"{SEGMENTS} SELECT bairro, tipo, faixa, recentes, gap FROM seg QUALIFY row_number() OVER (PARTITION BY bairro ORDER BY recentes DESC, tipo, faixa) = 1")
def _(spark, d):
    return prices.representative(_segments(spark, d)).select("bairro", "tipo", "faixa", "recentes", "gap")


@query("gap_alerts_top12", f"{SEGMENTS} SELECT bairro, tipo, faixa, gap, anuncios FROM seg WHERE abs(gap) >= 20 AND NOT pequena AND anuncios >= 3 ORDER BY abs(gap) DESC, bairro, tipo, faixa LIMIT 12")
def _(spark, d):
    return prices.gap_alerts(_segments(spark, d)).select("bairro", "tipo", "faixa", "gap", "anuncios")


LAUNCH = f"""WITH {SALES}, l AS (SELECT endereco, date_diff('day', dia, lead(dia, 4) OVER (PARTITION BY endereco ORDER BY dia)) <= 182 AS hit FROM sales),
  launch AS (SELECT endereco, coalesce(bool_or(hit), false) AS lancamento FROM l GROUP BY 1)"""


@query("launch_detection", f"{LAUNCH} SELECT * FROM launch")
def _(spark, d):
    return period.launches(sales(spark, d), "endereco")


ADDRESSES = f"""{LAUNCH}, {DEAR}, maioria AS (SELECT endereco, bairro FROM (SELECT endereco, bairro, count(*) AS k FROM sales GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY endereco ORDER BY k DESC, lower(bairro), bairro) = 1),
  a AS (SELECT endereco, count(*) AS n, min(valor) AS menor, max(valor) AS maior, median(valor) AS mediana, quantile_cont(valor, 0.25) AS p25, quantile_cont(valor, 0.75) AS p75, min(area) AS area_min, max(area) AS area_max FROM dear GROUP BY 1),
  adr AS (SELECT endereco, bairro, n, mediana, CASE WHEN n >= 4 THEN p25 END AS p25, CASE WHEN n >= 4 THEN p75 END AS p75, CASE WHEN NOT area_max / area_min > 4 THEN area_min END AS area_min, CASE WHEN NOT area_max / area_min > 4 THEN area_max END AS area_max,
    CASE WHEN n = 1 THEN 'unico' WHEN menor < 30000 OR maior / menor > 20 THEN 'incoerente' WHEN lancamento THEN 'lancamento' ELSE 'prospecto' END AS situacao FROM a JOIN launch USING (endereco) LEFT JOIN maioria USING (endereco))"""


@query("address_liquidity", f"{ADDRESSES} SELECT endereco, bairro, n, {R2('mediana', 'p25', 'p75')}, area_min, area_max, situacao FROM adr")
def _(spark, d):
    return _rounded(addresses.liquidity(dear_sales(spark, d)), "mediana", "p25", "p75")


@query("prospect_top30", f"{ADDRESSES} SELECT endereco, bairro, n, {R2('mediana')} FROM adr WHERE situacao = 'prospecto' ORDER BY n DESC, lower(bairro), endereco LIMIT 30")
def _(spark, d):
    return _rounded(addresses.top_prospects(addresses.liquidity(dear_sales(spark, d))).select("endereco", "bairro", "n", "mediana"), "mediana")


@query("address_discards", f"{ADDRESSES} SELECT situacao, count(*) AS enderecos, CAST(sum(n) AS BIGINT) AS vendas FROM adr GROUP BY 1")
def _(spark, d):
    return addresses.discards(addresses.liquidity(dear_sales(spark, d)))


BUILDINGS = f"""WITH {SALES}, {LISTINGS}, st AS (SELECT endereco, count(*) AS n, quantile_cont(m2, 0.25) AS p25, median(m2) AS p50, quantile_cont(m2, 0.75) AS p75 FROM sales GROUP BY 1 HAVING count(*) >= 4)"""


@query("building_homogeneity", f"{BUILDINGS} SELECT endereco, n, {R2('p25', 'p50', 'p75')}, p75 / p25 <= 1.25 AS homogeneo FROM st")
def _(spark, d):
    return _rounded(prices.building_stats(sales(spark, d)), "p25", "p50", "p75")


@query("opportunity_findings", f"{BUILDINGS}, o AS (SELECT codigo, bairro, endereco, pedido_valor, p50, n, floor((1 - pedido_valor / area / p50) * 100 * 10 + 0.5) / 10 AS desconto FROM listings JOIN st USING (endereco) WHERE area > 0 AND p75 / p25 <= 1.25) SELECT codigo, bairro, endereco, pedido_valor, {R2('p50')}, n, desconto, desconto >= 30 AS atencao FROM o WHERE desconto >= 20")
def _(spark, d):
    return _rounded(prices.opportunities(listings(spark, d), prices.building_stats(sales(spark, d))), "p50")


@query(
    "rolling_median_index",
    f"""WITH {SALES}, sp AS (SELECT min(mes) AS i0, max(mes) AS i1 FROM sales), g AS (SELECT CAST(unnest(range(i0, i1 + 1)) AS INTEGER) AS i, i0, i1 FROM sp), w AS (SELECT i, i0, i1, unnest([3, 6, 12]) AS w FROM g),
  l AS (SELECT i, w, i1, CAST(greatest(i0, least(i - w // 2, i1 - w + 1)) AS INTEGER) AS lo FROM w), h AS (SELECT i, w, lo, least(i1, lo + w - 1) AS hi FROM l)
  SELECT tipo, i, w, floor(median(m2) * 1000000 + 0.5) / 1000000 AS median, count(*) AS n FROM h JOIN sales ON mes BETWEEN lo AND hi GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return _rounded(period.rolling_medians(sales(spark, d), ["tipo"], "m2").drop("i1", "meses"), "median")


@query("price_index")
def _(spark, d):
    return period.price_index(sales(spark, d), ["tipo"], "m2").withColumn("fator", half_up(F.col("fator"), 6))


def _resolution(spark, d):
    """Rows, resolved rows and block votes; every named row votes at every level."""
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = people.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("nome"), F.floor(F.col("c_custkey") / 3).alias("endereco"), (F.col("c_nationkey") * 10 + F.col("c_custkey") % 7).alias("quadra"), (F.col("c_custkey") % 700).alias("cep"), F.col("n_name").alias("praca"))
    named = rows.where("nome in ('BUILDING', 'MACHINERY')")
    names = named.select("nome", F.concat(F.lit("B_"), "nome").alias("destino")).distinct()
    voters = named.withColumn("destino", F.concat(F.lit("B_"), "nome"))
    blocks = resolve.block_votes(voters, "quadra", "destino")
    return rows, resolve.cascade(rows, names, stats.majority(voters, ["endereco"], "destino"), blocks, stats.majority(voters, ["cep"], "destino")), blocks


VOTES = """WITH rows AS (SELECT c_custkey AS id, c_mktsegment AS nome, c_custkey // 3 AS endereco, c_nationkey * 10 + c_custkey % 7 AS quadra, c_custkey % 700 AS cep FROM customer JOIN nation ON c_nationkey = n_nationkey),
  v AS (SELECT *, 'B_' || nome AS destino FROM rows WHERE nome IN ('BUILDING', 'MACHINERY')),
  va AS (SELECT endereco, destino AS a FROM (SELECT endereco, destino, count(*) AS n FROM v GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY endereco ORDER BY n DESC, destino) = 1),
  vb AS (SELECT quadra, destino AS winner, 100 * n / sum(n) OVER (PARTITION BY quadra) AS confianca, CAST(sum(n) OVER (PARTITION BY quadra) AS BIGINT) AS n FROM (SELECT quadra, destino, count(*) AS n FROM v GROUP BY 1, 2) t QUALIFY row_number() OVER (PARTITION BY quadra ORDER BY t.n DESC, destino) = 1),
  vc AS (SELECT cep, destino AS p FROM (SELECT cep, destino, count(*) AS n FROM v GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY cep ORDER BY n DESC, destino) = 1),
  r AS (SELECT id, CASE WHEN nome IN ('BUILDING', 'MACHINERY') THEN 'B_' || nome END AS own, a, winner AS b, confianca AS c, p FROM rows LEFT JOIN va USING (endereco) LEFT JOIN vb USING (quadra) LEFT JOIN vc USING (cep)),
  res AS (SELECT id, coalesce(own, a, CASE WHEN c >= 80 THEN b END, p, CASE WHEN c >= 60 THEN b END) AS destino, CASE WHEN own IS NOT NULL THEN 'campo_original' WHEN a IS NOT NULL THEN 'voto_endereco' WHEN c >= 80 THEN 'quadra_alta' WHEN p IS NOT NULL THEN 'cep' WHEN c >= 60 THEN 'quadra_media' ELSE 'incerto' END AS metodo FROM r)"""


@query("block_vote_confidence", f"{VOTES} SELECT quadra, winner, floor(confianca * 1000000 + 0.5) / 1000000 AS confianca, n, CASE WHEN confianca >= 80 THEN 'alta' WHEN confianca >= 60 THEN 'media' ELSE 'baixa' END AS nivel FROM vb")
def _(spark, d):
    return _rounded(_resolution(spark, d)[2], "confianca")


@query("resolution_cascade", f"{VOTES} SELECT id, destino, metodo FROM res")
def _(spark, d):
    return _resolution(spark, d)[1].select("id", "destino", "metodo")


@query("closing_balance", f"{VOTES} SELECT metodo, count(*) AS n, floor(count(*) * 1000 / (SELECT count(*) FROM res) + 0.5) / 10 AS pct FROM res GROUP BY 1")
def _(spark, d):
    return resolve.closing_balance(_resolution(spark, d)[1])


for _name in ("block_vote_confidence", "resolution_cascade", "closing_balance"):
    also(f"{_name}_all", _name)


@query(
    "knn_neighbours",
    """WITH p AS (SELECT n_nationkey AS id, -23.5 + (n_nationkey % 5) * 0.012 AS lat, -46.6 + (n_nationkey // 5) * 0.015 AS lon FROM nation),
  d AS (SELECT a.id, b.id AS vizinho, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2) AS h FROM p a, p b WHERE a.id <> b.id),
  k AS (SELECT id, vizinho, floor(6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h)) * 1e6 + 0.5) / 1e6 AS km FROM d)
  SELECT id, vizinho, floor(km * 1000 + 0.5) / 1000 AS km FROM k WHERE km <= 3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY km, vizinho) <= 3""",
)
def _(spark, d):
    places = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (F.lit(-23.5) + (F.col("n_nationkey") % 5) * 0.012).alias("lat"), (F.lit(-46.6) + F.floor(F.col("n_nationkey") / 5) * 0.015).alias("lon"))
    near = geo.nearest_places(places, replace(DEFAULT, neighbours=25)).withColumn("km", half_up(F.col("km"), 6))
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("km", "vizinho"))).where("r <= 3")
    return ranked.select("id", "vizinho", half_up(F.col("km"), 3).alias("km"))


@query(
    "listing_scores",
    f"""{SEGMENTS}{PERIOD}, {ADDRESSES[ADDRESSES.index("l AS ("):]}, w AS (SELECT base - 2 AS e FROM base), sc AS (SELECT bairro, CAST(row_number() OVER (ORDER BY bairro) AS DOUBLE) AS score FROM (SELECT DISTINCT bairro FROM sales)),
  c AS (SELECT bairro, tipo, count(*) FILTER (mes <= e AND mes > e - 12) AS a, count(*) FILTER (mes <= e AND mes > e - 24) AS b, count(*) FILTER (mes <= e AND mes > e - 36) AS c FROM sales, w GROUP BY 1, 2), k AS (SELECT bairro, tipo, CASE WHEN a >= 30 THEN 12 WHEN b >= 30 THEN 24 ELSE 36 END AS months, c < 30 AS few FROM c),
  bands AS (SELECT bairro, tipo, quantile_cont(valor, 0.25) AS low, quantile_cont(valor, 0.75) AS high FROM sales JOIN k USING (bairro, tipo), w WHERE NOT few AND mes <= e AND mes > e - months GROUP BY 1, 2),
  j AS (SELECT l.*, score, CASE WHEN NOT pequena AND pago > 0 AND l.area > 0 THEN pedido_valor / l.area / pago END AS r, low, high FROM (SELECT *, CASE WHEN area <= 50 THEN 'ate_50' WHEN area <= 80 THEN '50_80' ELSE '80_120' END AS faixa FROM listings) l JOIN sc USING (bairro) LEFT JOIN seg USING (bairro, tipo, faixa) LEFT JOIN bands USING (bairro, tipo)),
  q AS (SELECT codigo, bairro, score, endereco, CASE WHEN r IS NULL THEN 50 WHEN r > 1 THEN greatest(0, 100 - (r - 1) * 100) WHEN r >= 0.7 THEN 100 ELSE greatest(30, 100 - (0.7 - r) * 200) END AS a,
    CASE WHEN low IS NULL THEN NULL WHEN greatest(low - pedido_valor, pedido_valor - high) <= 0 THEN 100 WHEN high - low <= 0 THEN 50 ELSE greatest(0, 100 - 100 * greatest(low - pedido_valor, pedido_valor - high) / (high - low)) END AS b FROM j)
  SELECT codigo, q.bairro, floor((0.35 * score + 0.3 * q.a + CASE WHEN b IS NULL THEN 0 ELSE 0.25 * b END + 0.1 * CASE WHEN adr.n >= 5 THEN 100 WHEN adr.n = 4 THEN 80 WHEN adr.n = 3 THEN 60 WHEN adr.n = 2 THEN 40 ELSE 0 END) / (0.35 + 0.3 + 0.1 + CASE WHEN b IS NULL THEN 0 ELSE 0.25 END) * 10 + 0.5) / 10 AS score FROM q LEFT JOIN adr ON adr.endereco = q.endereco AND adr.situacao = 'prospecto'""",
)
def _(spark, d):
    s, offers = sales(spark, d), listings(spark, d).withColumn("faixa", expr.area_band(F.col("area")))
    scores = s.select("bairro").distinct().withColumn("score", F.row_number().over(Window.orderBy("bairro")).cast("double"))  # a row each neighbourhood
    return scoring.listing_score(offers, scores, _segments(spark, d), _bands(spark, d), addresses.liquidity(dear_sales(spark, d)))


# with the neighbourhoods' own scores, which the SQL of listing_scores leaves out
@query("listing_scores_all")
def _(spark, d):
    s, offers = sales(spark, d), listings(spark, d).withColumn("faixa", expr.area_band(F.col("area")))
    scores = scoring.neighbourhood_score(cleaned(spark, d), F.col("limpa"))
    return scoring.listing_score(offers, scores, _segments(spark, d), _bands(spark, d), addresses.liquidity(dear_sales(spark, d)))


@query("top10_mean_coverage", f"WITH {LISTINGS}, t AS (SELECT nome, pedido_valor FROM listings QUALIFY row_number() OVER (PARTITION BY nome ORDER BY pedido_valor DESC, codigo) <= 10) SELECT nome, count(*) AS n, floor(avg(pedido_valor) * least(1.0, count(*) / 10) * 1000000 + 0.5) / 1000000 AS media FROM t GROUP BY 1")
def _(spark, d):
    return _rounded(scoring.top_mean(listings(spark, d), "nome", "pedido_valor", [F.desc("pedido_valor"), "codigo"]), "media")


def _requests(spark, d):
    s = sales(spark, d).withColumn("venda", F.xxhash64(*ARRIVAL))
    return s, s.select(F.col("venda").alias("pedido_id"), "endereco", "bairro", "tipo", "area", "venda", "valor", "pedido")


@query(
    "loo_calibration",
    f"""WITH {SALES}, s AS (SELECT row_number() OVER () AS v, * FROM sales), a AS (SELECT q.v, q.area, q.valor, c.m2 FROM s q JOIN s c ON c.endereco = q.endereco AND abs(c.area - q.area) / q.area <= 0.2e0 AND c.v <> q.v WHERE c.m2 IS NOT NULL),
  x AS (SELECT v, 'predio' AS nivel, any_value(area) AS area, any_value(valor) AS valor, count(*) AS n, median(m2) AS m2, quantile_cont(m2, 0.25) AS p25, quantile_cont(m2, 0.75) AS p75 FROM a GROUP BY 1 HAVING count(*) >= 3),
  b AS (SELECT q.v, q.area, q.valor, c.m2 FROM (SELECT * FROM s WHERE v NOT IN (SELECT v FROM x)) q JOIN s c ON c.bairro = q.bairro AND c.tipo = q.tipo AND abs(c.area - q.area) / q.area <= 0.1e0 AND c.v <> q.v WHERE c.m2 IS NOT NULL),
  y AS (SELECT v, 'bairro' AS nivel, any_value(area) AS area, any_value(valor) AS valor, count(*) AS n, median(m2) AS m2, quantile_cont(m2, 0.25) AS p25, quantile_cont(m2, 0.75) AS p75 FROM b GROUP BY 1 HAVING count(*) >= 8),
  e AS (SELECT nivel, CASE WHEN nivel = 'predio' AND n >= 5 AND p75 / p25 <= 1.25 THEN 'alta' WHEN nivel = 'predio' THEN 'media' ELSE 'baixa' END AS confianca, abs(floor(m2 * area + 0.5) - valor) / valor * 100 AS erro FROM (SELECT * FROM x UNION ALL SELECT * FROM y))
  SELECT nivel, coalesce(confianca, '*') AS confianca, count(*) AS n, floor(median(erro) * 10000 + 0.5) / 10000 AS erro_mediano, floor(quantile_cont(erro, 0.75) * 10000 + 0.5) / 10000 AS erro_p75 FROM e GROUP BY GROUPING SETS ((nivel, confianca), (nivel))""",
)
def _(spark, d):
    s, _ = _requests(spark, d)
    return valuation.calibration(valuation.leave_one_out(s, also=["valor"]))


@query(
    "comparables_estimate",
    f"""WITH {SALES}, {LISTINGS}, a AS (SELECT l.codigo, l.area, s.m2 FROM listings l JOIN sales s ON s.endereco = l.endereco AND abs(s.area - l.area) <= l.area * 0.2),
  x AS (SELECT codigo, 'predio' AS nivel, any_value(area) AS area, count(*) AS n, median(m2) AS m2, quantile_cont(m2, 0.25) AS p25, quantile_cont(m2, 0.75) AS p75 FROM a GROUP BY 1 HAVING count(*) >= 3),
  b AS (SELECT l.codigo, l.area, s.m2 FROM listings l JOIN sales s ON s.bairro = l.bairro AND s.tipo = l.tipo AND abs(s.area - l.area) <= l.area * 0.1 WHERE l.codigo NOT IN (SELECT codigo FROM x)),
  y AS (SELECT codigo, 'bairro' AS nivel, any_value(area) AS area, count(*) AS n, median(m2) AS m2, quantile_cont(m2, 0.25) AS p25, quantile_cont(m2, 0.75) AS p75 FROM b GROUP BY 1 HAVING count(*) >= 8), u AS (SELECT * FROM x UNION ALL SELECT * FROM y)
  SELECT codigo AS pedido_id, nivel, n, floor(m2 * 100 + 0.5) / 100 AS m2, floor(m2 * area + 0.5) AS estimativa, CASE WHEN nivel = 'predio' AND n >= 5 AND p75 / p25 <= 1.25 THEN 'alta' WHEN nivel = 'predio' THEN 'media' ELSE 'baixa' END AS confianca FROM u""",
)
def _(spark, d):
    s, _ = _requests(spark, d)
    asked = listings(spark, d).select(F.col("codigo").alias("pedido_id"), "endereco", "bairro", "tipo", "area", F.lit(None).cast("long").alias("venda"))
    return valuation.estimate(asked, s)


@query(
    "listing_history_fold",
    """WITH d AS (SELECT user_id AS codigo, CAST(ts AS DATE) AS dia, min(value) AS preco FROM events GROUP BY 1, 2), k AS (SELECT dia, row_number() OVER (ORDER BY dia) AS k FROM (SELECT DISTINCT dia FROM d)),
  r AS (SELECT d.*, k, lag(k) OVER (PARTITION BY codigo ORDER BY k) AS b, lag(preco) OVER (PARTITION BY codigo ORDER BY k) AS o FROM d JOIN k USING (dia)),
  g AS (SELECT codigo, arg_min(preco, k) AS preco_inicial, arg_max(preco, k) AS preco_atual, count(*) FILTER (o <> preco) AS mudancas, min(dia) AS visto_primeira, max(dia) AS visto_ultima, max(k) AS k, count(*) FILTER (k - b > 1) AS voltas FROM r GROUP BY 1)
  SELECT codigo, preco_inicial, preco_atual, mudancas, visto_primeira, visto_ultima, (SELECT dia FROM k WHERE k.k = g.k + 1) AS saida, voltas FROM g""",
)
def _(spark, d):
    return history.history_at_once(table(spark, d, "events").select(F.col("user_id").alias("codigo"), F.to_date("ts").alias("dia"), F.col("value").alias("preco")))


@query("dedup_fixpoint")
def _(spark, d):
    offers = table(spark, d, "orders").select(F.floor(F.col("o_custkey") / 4).alias("endereco"), F.lit(80.0).alias("area"), F.col("o_orderkey").alias("ordem"), F.col("o_orderkey").alias("codigo"), F.col("o_totalprice").alias("preco"), F.col("o_orderdate").alias("criado"))
    return history.merge_readvertised(offers)


@query(
    "snapshot_diff",
    """WITH d AS (SELECT user_id AS codigo, CAST(ts AS DATE) AS dia, max(value) AS preco FROM events GROUP BY 1, 2), a AS (SELECT * FROM d WHERE dia = DATE '2024-01-10'), b AS (SELECT * FROM d WHERE dia = DATE '2024-01-11')
  SELECT codigo, a.preco AS antes, b.preco AS depois, CASE WHEN a.preco IS NULL THEN 'entrou' WHEN b.preco IS NULL THEN 'saiu' WHEN a.preco = b.preco THEN 'igual' ELSE 'mudou' END AS mudanca FROM a FULL JOIN b USING (codigo)""",
)
def _(spark, d):
    days = table(spark, d, "events").groupBy(F.col("user_id").alias("codigo"), F.to_date("ts").alias("dia")).agg(F.max("value").alias("preco"))
    a = days.where("dia = date'2024-01-10'").select("codigo", F.col("preco").alias("antes"))
    b = days.where("dia = date'2024-01-11'").select("codigo", F.col("preco").alias("depois"))
    kind = F.when(F.col("antes").isNull(), "entrou").when(F.col("depois").isNull(), "saiu").when(F.col("antes") == F.col("depois"), "igual").otherwise("mudou")
    return a.join(b, "codigo", "full_outer").withColumn("mudanca", kind)


@query(
    "asof_previous_point",
    "WITH m AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS dia, max(value) AS valor FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT user_id, dia, valor, lag(valor) OVER (PARTITION BY user_id ORDER BY dia) AS anterior, floor((valor - lag(valor) OVER (PARTITION BY user_id ORDER BY dia)) * 100 + 0.5) / 100 AS variacao FROM m",
)
def _(spark, d):
    days = table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id", F.to_date("ts").alias("dia")).agg(F.max("value").alias("valor"))
    before = F.lag("valor").over(Window.partitionBy("user_id").orderBy("dia"))
    return days.withColumn("anterior", before).withColumn("variacao", half_up(F.col("valor") - F.col("anterior"), 2))


@query("place_names", "SELECT page_id, trim(regexp_replace(regexp_replace(translate(upper(regexp_extract(url, '//([^/]+)', 1)), 'ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ', 'AAAAAEEEEIIIIOOOOOUUUUCN'), '[^A-Z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS lugar FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", expr.place_name(F.regexp_extract("url", "//([^/]+)", 1)).alias("lugar"))


@query(
    "paid_by_year",
    f"""WITH {SALES}, y AS (SELECT bairro, tipo, year(dia) AS ano, count(*) AS n, median(valor) AS m, min(month(dia)) AS de, max(month(dia)) AS ate FROM sales GROUP BY 1, 2, 3),
  p AS (SELECT y.*, o.m AS anterior, o.n AS antes FROM y LEFT JOIN y o ON o.bairro = y.bairro AND o.tipo = y.tipo AND o.ano = y.ano - 1)
  SELECT bairro, tipo, CAST(ano AS INTEGER) AS ano, n, floor(m * 1000000 + 0.5) / 1000000 AS mediana, CAST(de AS INTEGER) AS de, CAST(ate AS INTEGER) AS ate, n < 10 AS pequena,
    CASE WHEN n >= 10 AND antes >= 10 THEN floor(100 * (m - anterior) / anterior * 10 + 0.5) / 10 END AS variacao FROM p""",
)
def _(spark, d):
    return _rounded(market.paid_by_year(sales(spark, d)), "mediana")


@query("paid_by_year_since", ORACLES["paid_by_year"].replace("FROM sales GROUP BY 1, 2, 3", "FROM sales WHERE year(dia) >= 1999 GROUP BY 1, 2, 3"))
def _(spark, d):
    # filings that come late, of years before those that are told, are left out by their own date
    return _rounded(market.paid_by_year(sales(spark, d).where("year(dia) >= 1999")), "mediana")


@query("search_interest", "WITH t AS (SELECT DISTINCT event_type AS bairro, user_id AS termo, day(ts) AS mes, user_id % 9 + 1 AS n FROM events), m AS (SELECT bairro, mes, sum(n) AS n FROM t GROUP BY 1, 2) SELECT bairro, floor(avg(n) * 1000000 + 0.5) / 1000000 AS media FROM m GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("bairro"), F.col("user_id").alias("termo"), F.dayofmonth("ts").alias("mes"), (F.col("user_id") % 9 + 1).alias("n"))
    return market.search_interest(rows)


@query(
    "floor_effect",
    f"""WITH {SALES}, s AS (SELECT endereco, floor(area / 10) AS a, linha * 3 AS andar, m2 FROM sales), g AS (SELECT endereco, a, median(m2) AS m FROM s GROUP BY 1, 2 HAVING count(*) >= 4 AND max(andar) - min(andar) >= 5),
  r AS (SELECT CASE WHEN andar < 1 THEN NULL WHEN andar <= 3 THEN 0 WHEN andar <= 7 THEN 1 WHEN andar <= 11 THEN 2 WHEN andar <= 15 THEN 3 WHEN andar <= 99 THEN 4 END AS faixa, m2 / m AS r FROM s JOIN g USING (endereco, a))
  SELECT faixa, count(*) AS n, floor(CASE WHEN count(*) >= 200 THEN greatest(0.9, least(1.1, median(r))) ELSE 1 END * 1000000 + 0.5) / 1000000 AS fator FROM r WHERE faixa IS NOT NULL GROUP BY 1""",
)
def _(spark, d):
    rows = sales(spark, d).select("endereco", F.floor(F.col("area") / 10).cast("double").alias("area"), (F.col("linha") * 3).alias("andar"), "m2")
    return market.floor_effect(rows)


@query(
    "similar_listings",
    f"""WITH {LISTINGS}, r AS (SELECT codigo AS pedido_id, endereco AS e, bairro AS b, area AS a, pedido_valor AS v FROM listings),
  u AS (SELECT pedido_id, codigo, true AS mesmo_predio, abs(pedido_valor - v) AS gap FROM r JOIN listings ON e = endereco UNION ALL
    SELECT pedido_id, codigo, false, abs(pedido_valor - v) FROM r JOIN listings ON b = bairro AND e <> endereco AND abs(area - a) <= 0.1 * a AND abs(pedido_valor - v) <= 0.1 * v)
  SELECT pedido_id, codigo, mesmo_predio, CAST(row_number() OVER (PARTITION BY pedido_id ORDER BY mesmo_predio DESC, gap, codigo) AS INTEGER) AS posto FROM u QUALIFY posto <= 8""",
)
def _(spark, d):
    offers = listings(spark, d)
    asked = offers.select(F.col("codigo").alias("pedido_id"), "endereco", "bairro", "area", F.col("pedido_valor").alias("valor"))
    return market.similar_listings(asked, offers)


also("similar_listings_all", "similar_listings")


@query("ranking_moves", f"WITH {SALES}, n AS (SELECT bairro, row_number() OVER (ORDER BY count(*) FILTER (year(dia) = 2000) DESC, bairro) AS posto, row_number() OVER (ORDER BY count(*) FILTER (year(dia) = 1999) DESC, bairro) AS anterior FROM sales GROUP BY 1) SELECT bairro, posto, anterior, anterior - posto AS subiu FROM n")
def _(spark, d):
    count = lambda year: sales(spark, d).groupBy("bairro").agg(F.sum(F.when(F.year("dia") == year, 1).otherwise(0)).alias("n"))
    return market.ranking_moves(count(2000), count(1999), "bairro", "n")


@query("stock_demand_ratio", f"WITH {SALES}, {LISTINGS}, s AS (SELECT bairro, count(*) AS v FROM sales WHERE year(dia) = 2001 GROUP BY 1), e AS (SELECT bairro, count(*) AS n FROM listings GROUP BY 1) SELECT bairro, n AS estoque, coalesce(v, 0) AS vendas, CASE WHEN v > 0 THEN floor(n / v * 1000 + 0.5) / 1000 WHEN n > 0 THEN 999 ELSE 0 END AS razao FROM e LEFT JOIN s USING (bairro)")
def _(spark, d):
    sold = sales(spark, d).where("year(dia) = 2001").groupBy("bairro").agg(F.count("*").alias("vendas"))
    stock = listings(spark, d).groupBy("bairro").agg(F.count("*").alias("estoque")).join(sold, "bairro", "left").withColumn("vendas", F.coalesce("vendas", F.lit(0)))
    return stock.select("bairro", "estoque", "vendas", market.stock_demand(F.col("estoque"), F.col("vendas")).alias("razao"))


@query(
    "regions_told_apart",
    """WITH r AS (SELECT c_custkey % 40 AS cep, c_custkey % 4 AS cep3, c_mktsegment AS nome, c_custkey AS o FROM customer), c AS (SELECT cep, nome, count(*) AS n, min(o) AS f FROM r GROUP BY 1, 2),
  m AS (SELECT cep, nome AS w, (SELECT min(cep3) FROM r WHERE r.cep = c.cep) AS g FROM c QUALIFY row_number() OVER (PARTITION BY cep ORDER BY n DESC, f) = 1), k AS (SELECT w, count(DISTINCT g) AS k FROM m GROUP BY 1)
  SELECT cep, CASE WHEN k > 1 THEN w || ' ' || CAST(g AS VARCHAR) ELSE w END AS regiao FROM m JOIN k USING (w)""",
)
def _(spark, d):
    rows = table(spark, d, "customer").select((F.col("c_custkey") % 40).alias("cep"), (F.col("c_custkey") % 4).alias("cep3"), F.col("c_mktsegment").alias("nome"), F.col("c_custkey").alias("o"))
    return market.regions(rows, "cep", "cep3", "nome", ["o"])


@query("address_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') AND contains(lower(p_name), 'w') ORDER BY length(p_name), p_name, p_partkey LIMIT 8")
def _(spark, d):
    return market.find_addresses(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", ["red", "W"])


@query("old_stock_share", "WITH o AS (SELECT o_orderpriority AS bairro, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS DATE) END AS criado FROM orders) SELECT bairro, count(criado) AS com_data, count(*) FILTER (date_diff('day', criado, DATE '1999-01-01') > 365) AS antigos, floor(100.0 * count(*) FILTER (date_diff('day', criado, DATE '1999-01-01') > 365) / count(criado) * 10 + 0.5) / 10 AS pct FROM o GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("bairro"), F.when(F.col("o_orderkey") % 7 > 0, F.to_date("o_orderdate")).alias("criado"))
    return market.old_stock(rows, "bairro", F.lit("1999-01-01").cast("date"))


@query("rule_change_decomposition", "WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_totalprice > 200000 THEN 'alto' ELSE 'baixo' END AS c FROM orders WHERE o_orderkey % 5 > 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_totalprice > 250000 THEN 'alto' ELSE 'baixo' END AS c FROM orders WHERE o_orderkey % 3 > 0) SELECT a.c AS antes, b.c AS depois, count(*) AS n FROM a FULL JOIN b USING (k) GROUP BY 1, 2")
def _(spark, d):
    rows = table(spark, d, "orders").withColumnRenamed("o_orderkey", "k")
    label = lambda cut: F.when(F.col("o_totalprice") > cut, "alto").otherwise("baixo")
    return market.changed_rules(rows.where("k % 5 > 0").withColumn("c", label(200000)), rows.where("k % 3 > 0").withColumn("c", label(250000)), "k", "c")


@query("publish_gate", "SELECT * FROM (VALUES ('linhas', 0), ('pagamentos', 0), ('faixas', 0), ('historico', 0)) t(\"check\", n)")
def _(spark, d):
    clean_rows = cleaned(spark, d)
    audit = clean.audit(clean_rows).where("motivo <> 'limpa'")
    days = table(spark, d, "events").select(F.col("user_id").alias("codigo"), F.to_date("ts").alias("dia"), F.col("value").alias("preco"))
    found = checks.violations(
        {
            "linhas": checks.reconciliation(sales(spark, d), clean_rows.where("limpa"), audit),
            "pagamentos": checks.shares_off_100(prices.payment_mix(sales(spark, d)), ["bairro", "tipo"]),
            "faixas": checks.band_order(addresses.liquidity(dear_sales(spark, d))),
            "historico": checks.history_order(history.history_at_once(days)),
        }
    )
    return found.select("check", F.col("n").cast("int").alias("n"))
