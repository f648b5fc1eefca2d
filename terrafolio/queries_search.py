"""The address search over all listings and many requests, and its SQL."""

from __future__ import annotations

from terrafolio.operators import search
from terrafolio.operators.order import kept, settled
from terrafolio.plans.views import table
from terrafolio.queries import query

STREET = "concat(CASE p_partkey % 3 WHEN 0 THEN 'R ' WHEN 1 THEN 'AV ' ELSE 'AL ' END, p_name)"
BUILDING_COLUMNS = [f"concat({STREET}, ' ', p_brand) AS texto", "CAST(p_size AS STRING) AS numero", f"concat({STREET}, ', ', p_size) AS rotulo"]
ROAD_COLUMNS = [f"concat({STREET}, ' ', p_brand) AS texto", f"{STREET} AS nome", "p_brand AS lugar"]
REQUEST = "concat(CASE c_custkey % 5 WHEN 0 THEN 'Rua ' WHEN 1 THEN 'avenida ' WHEN 2 THEN 'de ' ELSE '' END, CASE c_custkey % 7 WHEN 0 THEN 'red' WHEN 1 THEN 'idg' WHEN 2 THEN 'bolt small' WHEN 3 THEN 'zz' WHEN 4 THEN 'b' WHEN 5 THEN 'ring brand' ELSE '' END, CASE WHEN c_custkey % 3 = 0 THEN concat(' 0', c_custkey % 60) ELSE '' END)"
TEXT = lambda x: f"trim(regexp_replace(upper({x}), '[^A-Z0-9]+', ' ', 'g'))"
SQL = f"""WITH b AS (SELECT p_partkey AS id, {TEXT(f"concat({STREET}, ' ', p_brand)")} AS t, CAST(p_size AS VARCHAR) AS numero, concat({STREET}, ', ', p_size) AS rotulo FROM part),
  s AS (SELECT min(p_partkey) AS id, {TEXT(f"concat({STREET}, ' ', p_brand)")} AS t, {STREET} AS nome, p_brand AS lugar FROM part GROUP BY 2, 3, 4),
  w AS (SELECT c_custkey AS req, string_split({TEXT(REQUEST)}, ' ') AS w FROM customer), q AS (SELECT req, list_distinct([x FOR x IN w IF x <> '' AND NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ('DA', 'DAS', 'DE', 'DO', 'DOS', 'E', 'SENHORA')]) AS n, regexp_replace([x FOR x IN w IF regexp_full_match(x, '[0-9]+')][-1], '^0+([0-9])', '\\1') AS z FROM w),
  a AS (SELECT * FROM q WHERE len(n) > 0),
  f AS (SELECT req, z, id, rotulo FROM a JOIN b ON len([x FOR x IN n IF NOT (contains(t, x) OR (x = 'RUA' AND list_contains(string_split(t, ' '), 'R')) OR (x = 'AVENIDA' AND list_contains(string_split(t, ' '), 'AV')))]) = 0 WHERE z IS NULL OR numero = z QUALIFY row_number() OVER (PARTITION BY req ORDER BY id) <= 8),
  g AS (SELECT req, z, s.id, nome, lugar FROM a JOIN s ON len([x FOR x IN n IF NOT (contains(t, x) OR (x = 'RUA' AND list_contains(string_split(t, ' '), 'R')) OR (x = 'AVENIDA' AND list_contains(string_split(t, ' '), 'AV')))]) = 0 WHERE z IS NOT NULL AND req NOT IN (SELECT req FROM f) QUALIFY row_number() OVER (PARTITION BY req ORDER BY s.id) <= 12),
  h AS (SELECT req, concat(nome, ', ', z) AS rotulo, lugar, min(id) AS id FROM g GROUP BY 1, 2, 3)
  SELECT req, CAST(row_number() OVER (PARTITION BY req ORDER BY CASE WHEN z IS NULL THEN rotulo END, id) AS INTEGER) AS posto, 'predio' AS tipo, id, rotulo FROM f UNION ALL
  SELECT req, CAST(row_number() OVER (PARTITION BY req ORDER BY id) AS INTEGER) AS posto, 'rua', id, rotulo FROM h QUALIFY posto <= 8"""


@query("address_suggestions", SQL)
def _(spark, d):
    parts = table(spark, d, "part").repartition("p_partkey")  # a small file, and all texts of it are made
    buildings = parts.selectExpr("p_partkey AS id", *BUILDING_COLUMNS)
    streets = parts.selectExpr("p_partkey", *ROAD_COLUMNS).groupBy("texto", "nome", "lugar").agg({"p_partkey": "min"}).withColumnRenamed("min(p_partkey)", "id")
    buildings, streets = kept(buildings), kept(streets)
    requests = table(spark, d, "customer").selectExpr("c_custkey AS req", f"{REQUEST} AS pedido")
    return search.suggestions(requests, buildings, streets, settled(search.posted(search.texts(buildings))), settled(search.posted(streets)))
