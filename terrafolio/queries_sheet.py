"""Queries of spreadsheet cells, names and codes, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafolio.functions import expr, text
from terrafolio.functions.expr import ACCENTED, PAYMENTS, PLAIN, STREET_WORDS
from terrafolio.operators import checks, sheet
from terrafolio.plans.cells import CELLS_SQL, PLACES, cells, places, spread
from terrafolio.plans.views import table
from terrafolio.queries import query


# --- the same expressions in SQL
def plain_sql(x: str) -> str:
    return f"translate(upper({x}), '{ACCENTED}', '{PLAIN}')"


def bare_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({plain_sql(x)}, '[^A-Z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def place_sql(x: str) -> str:
    return bare_sql(f"regexp_replace(regexp_replace(upper({x}), '\\([^)]*\\)', '', 'g'), '\"[^\"]*\"', '', 'g')")


def case_sql(x: str, words: dict[str, str], other: str) -> str:
    return f"CASE {x} {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in words.items())} ELSE {other} END"


def street_sql(x: str) -> str:
    s = bare_sql(x)
    first = f"split_part({s}, ' ', 1)"
    return f"concat({case_sql(first, STREET_WORDS, first)}, substr({s}, length({first}) + 1))"


def number_sql(x: str) -> str:
    return f"TRY_CAST(trim({x}) AS DOUBLE)"


def key_sql(x: str) -> str:
    return f"nullif({case_sql(place_sql(x), text.PLACE_ALIASES, place_sql(x))}, '')"


def title_sql(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda t: concat(upper(t[1]), lower(t[2:]))), ' ')"


PLACES_SQL = f"places AS (SELECT nome, {place_sql('nome')} AS chave FROM (VALUES {', '.join(f'({p!r})' for p in PLACES)}) t(nome))"
NUMBER_OF_STREET = "regexp_replace(trim(regexp_replace(C, '\\.0+$', '')), '^0+([0-9])', '\\1')"
DEEDS = f"""{CELLS_SQL}, {PLACES_SQL},
  typed AS (SELECT sheet, row_num, {key_sql('E')} AS chave, E AS bairro_raw, CAST(sheet[5:] AS INTEGER) AS sheet_year, CAST(trunc({number_sql('J')}) AS INTEGER) AS day,
    CAST(trim(I) AS DOUBLE) AS valor, CASE WHEN {number_sql('N')} > 0 THEN {number_sql('N')} END AS base_calculo, CASE WHEN {number_sql('W')} > 0 AND {number_sql('W')} <= 600 THEN {number_sql('W')} END AS area,
    CASE WHEN {number_sql('A')} >= 1 THEN CASE WHEN {number_sql('A')} < 1e11 THEN lpad(CAST(CAST(floor({number_sql('A')}) AS BIGINT) AS VARCHAR), 11, '0') ELSE CAST(CAST(floor({number_sql('A')}) AS BIGINT) AS VARCHAR) END END AS sql,
    nullif(split_part(trim(coalesce(X, '')), '.', 1), '') AS uso_code, {street_sql('B')} AS rua, {NUMBER_OF_STREET} AS numero,
    coalesce(trim(H) LIKE '1.%', false) AS is_compra_venda, coalesce({number_sql('L')} >= 99.99, true) AS is_full_transfer, coalesce(regexp_matches(trim(H), '^(17|4)\\.'), false) AS is_retomada,
    trim(coalesce(D, '')) AS complemento, nullif(trim(coalesce(G, '')), '') AS cep, nullif(trim(coalesce(O, '')), '') AS tipo_financiamento, {number_sql('P')} AS valor_financiado, X
    FROM cells WHERE sheet <> 'LEGENDA' AND E IS DISTINCT FROM 'Bairro' AND regexp_full_match(trim(I), '-?\\d+(\\.\\d+)?') AND TRY_CAST(trim(I) AS DOUBLE) > 0),
  deeds AS (SELECT typed.* EXCLUDE (chave, rua, numero, X), CASE WHEN rua <> '' AND numero <> '' THEN concat(rua, '|', numero) END AS addr_key, CASE WHEN rua <> '' AND numero <> '' THEN concat({title_sql('rua')}, ', ', numero) END AS addr_display, nome AS bairro,
    regexp_full_match(trim(coalesce(X, '')), '(10|12|14|20|21|22|25)(\\.0+)?') AS residencial FROM typed LEFT JOIN places USING (chave))"""
KIND_SQL = case_sql("uso_code", sheet.KIND_OF_USAGE, "NULL")
CLASSIFIED = f"""{DEEDS}, classified AS (SELECT *, {KIND_SQL} AS tipo,
    CASE WHEN {KIND_SQL} IS NULL THEN 'sem_tipo' WHEN NOT is_compra_venda THEN 'nao_venda' WHEN NOT is_full_transfer THEN 'parcial' WHEN valor NOT BETWEEN 10000 AND 100000000 THEN 'irreal' WHEN base_calculo > 0 AND valor < 0.6 * base_calculo THEN 'subdeclarado' END AS motivo,
    CASE WHEN NOT is_compra_venda THEN NULL WHEN is_full_transfer AND uso_code IN ('10', '20') THEN 'revenda' WHEN is_full_transfer THEN 'demais' WHEN uso_code IN ('10', '20') THEN 'parcial'
      WHEN list_has_any(regexp_split_to_array(upper(complemento), '[^A-Z0-9]+'), ['AP', 'APTO', 'APART', 'TORRE', 'BLOCO', 'CASA', 'UNIDADE']) OR regexp_matches(tipo_financiamento, '^[12]\\.') THEN 'planta' ELSE 'demais' END AS classe FROM deeds)"""


def deeds(spark, d, residential_only=False):
    return sheet.deeds(spread(spark, d), places(spark), residential_only)


@query("sheet_deeds", f"WITH {DEEDS} SELECT * EXCLUDE (residencial) FROM deeds WHERE residencial")
def _(spark, d):
    return deeds(spark, d, residential_only=True)


@query("sheet_classes", f"WITH {CLASSIFIED} SELECT bairro, tipo, motivo, classe, count(*) AS n FROM classified GROUP BY ALL")
def _(spark, d):
    return sheet.classified(deeds(spark, d)).groupBy("bairro", "tipo", "motivo", "classe").agg(F.count("*").alias("n"))


@query("sheet_dedup", f"WITH {DEEDS} SELECT sql, bairro, addr_key, valor, day, complemento, row_num FROM deeds QUALIFY row_number() OVER (PARTITION BY sql IS NOT NULL, coalesce(sql, bairro), CASE WHEN sql IS NULL THEN addr_key END, floor(valor * 100 + 0.5), day, complemento ORDER BY row_num) = 1")
def _(spark, d):
    return sheet.deduplicated(deeds(spark, d), ["row_num"]).select("sql", "bairro", "addr_key", "valor", "day", "complemento", "row_num")


OFFER_CELLS = {
    "B": "concat('c', p_partkey)",
    "C": "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE concat('Al ', p_name) END",
    "D": "CASE WHEN p_partkey % 19 = 0 THEN '' ELSE concat('0', p_partkey % 300) END",
    "E": "CASE WHEN p_partkey % 2 = 0 THEN concat('AP ', p_size) WHEN p_partkey % 3 = 0 THEN '' END",
    "F": "CASE p_partkey % 8 WHEN 0 THEN 'Brooklin' WHEN 1 THEN 'jardim america' WHEN 2 THEN 'VILA POMPÉIA' WHEN 3 THEN 'Itaim Bibi' WHEN 4 THEN 'moema' WHEN 5 THEN '' WHEN 6 THEN 'Sé' END",
    "I": "CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'lat: -46.6, lng: -23.5' WHEN 2 THEN concat('lat:-46.', p_size, ',lng:-23.', p_size) ELSE '{lat: -50, lng: -10.25}' END",
    "J": "CASE p_partkey % 6 WHEN 0 THEN 'Locação' WHEN 1 THEN 'venda' ELSE 'VENDA E LOCACAO' END",
    "K": "CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN 'a combinar' ELSE concat(p_size * 10000, '.0') END",
    "O": "CASE p_partkey % 9 WHEN 0 THEN 'COMERCIAL' WHEN 1 THEN ' residencial ' ELSE 'RESIDENCIAL' END",
    "Q": "CASE WHEN p_partkey % 11 = 0 THEN '-' ELSE concat(p_size * 60) END",
    "T": "concat(p_size % 4, '.0')",
    "V": "CASE p_partkey % 4 WHEN 0 THEN 'lancamento' WHEN 1 THEN 'CONSTRUCAO ' WHEN 2 THEN 'outro' END",
    "X": "CASE WHEN p_partkey % 13 = 0 THEN 'x' ELSE concat(p_size % 5) END",
}


@query(
    "sheet_offers",
    f"""WITH {PLACES_SQL}, c AS (SELECT p_partkey + 1 AS row_num, {", ".join(f"{v} AS {k}" for k, v in OFFER_CELLS.items())} FROM part),
  t AS (SELECT *, {key_sql('F')} AS chave, {street_sql("coalesce(C, '')")} AS rua, {NUMBER_OF_STREET.replace('(C,', '(D,')} AS numero, CASE WHEN C <> '' AND D <> '' THEN concat(C, ', ', D) ELSE {title_sql(street_sql("coalesce(C, '')"))} END AS visto FROM c)
  SELECT B AS codigo, nome AS bairro, CASE WHEN C IS NOT NULL AND rua <> '' AND numero <> '' THEN concat(rua, '|', numero) END AS addr_key, CASE WHEN E <> '' THEN concat(visto, ' - ', E) ELSE visto END AS addr_display,
    CASE WHEN {number_sql('K')} > 0 THEN {number_sql('K')} END AS valor, CASE WHEN {number_sql('Q')} > 0 AND {number_sql('Q')} <= 2000 THEN {number_sql('Q')} END AS area, CAST(trunc({number_sql('X')}) AS INTEGER) AS quartos, CAST(trunc({number_sql('T')}) AS INTEGER) AS vagas,
    TRY_CAST(regexp_extract(I, 'lat:\\s*(-?\\d+\\.?\\d*),\\s*lng:\\s*(-?\\d+\\.?\\d*)', 2) AS DOUBLE) AS lat, TRY_CAST(regexp_extract(I, 'lat:\\s*(-?\\d+\\.?\\d*),\\s*lng:\\s*(-?\\d+\\.?\\d*)', 1) AS DOUBLE) AS lon,
    CASE upper(trim(V)) WHEN 'LANCAMENTO' THEN 3 WHEN 'CONSTRUCAO' THEN 4 ELSE 0 END AS situacao,
    coalesce(TRY_CAST(regexp_extract(I, 'lat:\\s*(-?\\d+\\.?\\d*),\\s*lng:\\s*(-?\\d+\\.?\\d*)', 2) AS DOUBLE) BETWEEN -24.2 AND -23 AND TRY_CAST(regexp_extract(I, 'lat:\\s*(-?\\d+\\.?\\d*),\\s*lng:\\s*(-?\\d+\\.?\\d*)', 1) AS DOUBLE) BETWEEN -47 AND -46.2, false) AS na_cidade
  FROM t JOIN places USING (chave) WHERE row_num > 1 AND F <> '' AND J ILIKE '%venda%' AND upper(trim(O)) = 'RESIDENCIAL'""",
)
def _(spark, d):
    pairs = [x for k, v in OFFER_CELLS.items() for x in (F.lit(k), F.expr(v).cast("string"))]
    rows = table(spark, d, "part").select((F.col("p_partkey") + 1).alias("row_num"), F.create_map(*pairs).alias("cells"))
    return sheet.offers(rows, places(spark)).withColumn("na_cidade", sheet.in_city(F.col("lat"), F.col("lon")))


NAMES = "concat(CASE l_suppkey % 9 WHEN 0 THEN 'JD. ' WHEN 1 THEN 'Torre ' WHEN 2 THEN 'v ' WHEN 3 THEN ' 12' WHEN 4 THEN 'Chác. STO ' WHEN 5 THEN 'res' WHEN 6 THEN '' WHEN 7 THEN 'VILA dos. ' ELSE 'Pq  da ' END, CASE WHEN l_linenumber < 3 THEN '' WHEN l_linenumber < 5 THEN 'são e-joão' ELSE concat('sp ', l_suppkey % 5) END) AS nome"


@query(
    "place_names_cadastre",
    f"""WITH t AS (SELECT DISTINCT {NAMES} FROM lineitem), w AS (SELECT nome, string_split(trim(regexp_replace({plain_sql('nome')}, '[^A-Z0-9]+', ' ', 'g')), ' ') AS w FROM t)
  SELECT nome, CASE WHEN w[1] <> '' AND w[1] NOT IN ({", ".join(map(repr, text.BUILDING_WORDS))}) THEN array_to_string(list_transform(w, lambda x: {case_sql('x', text.CADASTRE_WORDS, 'x')}), ' ') END AS cadastro,
    trim(nome) <> '' AND NOT regexp_full_match(nome, '(?i)\\s*(\\d+|(TORRE|BLOCO|BL|AP|APTO|APART|VAGA|VG|GARAGEM|SALA|LOJA|LT|UNID|UNIDADE|CASA|COND|CONDOMINIO|ED|RES)\\b.*)?\\s*') AS parece,
    array_to_string(list_transform(string_split(upper(regexp_replace(trim(nome), '\\s+', ' ', 'g')), ' '), lambda x, i: CASE WHEN i > 1 AND trim(x, '.') IN ({", ".join(map(repr, text.PARTICLES))}) THEN lower(trim(x, '.')) ELSE {case_sql("trim(x, '.')", text.DISPLAY_WORDS, "concat(upper(trim(x, '.')[1]), lower(trim(x, '.')[2:]))")} END), ' ') AS bonito FROM w""",
)
def _(spark, d):
    names = table(spark, d, "lineitem").selectExpr(NAMES).distinct()
    c = F.col("nome")
    return names.select("nome", text.cadastre_name(c).alias("cadastro"), text.looks_like_place(c).alias("parece"), text.pretty_name(c).alias("bonito"))


@query(
    "postcodes_and_blocks",
    f"""WITH {CELLS_SQL}, t AS (SELECT DISTINCT G AS g, concat('00', A, '-4') AS a FROM cells WHERE A IS NOT NULL),
  e AS (SELECT *, regexp_replace(g, '[^0-9]', '', 'g') AS x, regexp_replace(a, '[^0-9]', '', 'g') AS y, regexp_replace(CASE WHEN regexp_full_match(trim(g), '\\d+(\\.0+)?') THEN split_part(trim(g), '.', 1) ELSE g END, '[^0-9]', '', 'g') AS z FROM t)
  SELECT g, a, CASE WHEN x <> '' THEN lpad(x, greatest(8, length(x))::INTEGER, '0') END AS cep_bruto, CASE WHEN x <> '' THEN lpad(x, greatest(8, length(x))::INTEGER, '0')[:5] END AS cep5, CASE WHEN z <> '' THEN lpad(z, greatest(8, length(z))::INTEGER, '0') END AS cep8, CASE WHEN y <> '' THEN lpad(y, greatest(11, length(y))::INTEGER, '0')[:6] END AS quadra FROM e""",
)
def _(spark, d):
    c = F.col("cells")
    rows = cells(spark, d).where(c["A"].isNotNull()).select(c["G"].alias("g"), F.concat(F.lit("00"), c["A"], F.lit("-4")).alias("a")).distinct()
    return rows.select("g", "a", text.postcode_raw(F.col("g")).alias("cep_bruto"), text.postcode_prefix(F.col("g")).alias("cep5"), text.postcode(F.col("g")).alias("cep8"), text.block_key(F.col("a")).alias("quadra"))


UNIT_SQL = "TRY_CAST(nullif(regexp_extract(D, '(?i)(?:\\bAP|\\bAPTO|\\bAPT|\\bAPARTAMENTO)\\.?\\s*0*(\\d{1,4})\\b', 1), '') AS INTEGER)"


@query(
    "unit_floors",
    f"""WITH {CELLS_SQL}, u AS (SELECT B AS predio, row_num, {UNIT_SQL} AS n, CASE WHEN regexp_matches(D, '(?i)(\\d)\\s*V\\s?G') THEN TRY_CAST(regexp_extract(D, '(?i)(\\d)\\s*V\\s?G', 1) AS INTEGER) WHEN regexp_matches(D, '(?i)\\bE\\s*V\\s?G|\\bVAGA\\b') THEN 1 END AS vagas FROM cells),
  k AS (SELECT predio, CASE WHEN max(n) >= 1000 OR (count(*) FILTER (n BETWEEN 100 AND 999) > 0 AND count(*) FILTER (n BETWEEN 100 AND 999 AND n % 100 > 20) = 0) THEN 'c' ELSE 'd' END AS convencao FROM u GROUP BY 1),
  a AS (SELECT u.*, convencao, CASE WHEN n >= 1000 OR (n BETWEEN 100 AND 999 AND convencao = 'c') THEN 100 ELSE 10 END AS por FROM u JOIN k USING (predio))
  SELECT predio, row_num, n, vagas, convencao, CASE WHEN n >= 10 AND n // por BETWEEN 1 AND 60 THEN n // por END AS andar, CASE WHEN n >= 10 AND n // por BETWEEN 1 AND 60 THEN n % por END AS final FROM a""",
)
def _(spark, d):
    units = spread(spark, d, "BD").select(F.col("B").alias("predio"), "row_num", expr.unit_number(F.col("D")).alias("n"), expr.parking_spaces(F.col("D")).alias("vagas"))
    kinds = units.groupBy("predio").agg(text.numbering(F.col("n")).alias("convencao"))
    return units.join(kinds, "predio").withColumn("x", text.floor_and_final(F.col("n"), F.col("convencao"))).select("predio", "row_num", "n", "vagas", "convencao", "x.andar", "x.final")


@query("payment_categories", f"WITH {CELLS_SQL} SELECT O AS codigo, CASE WHEN coalesce(trim(O), '') = '' THEN 'a_vista' {' '.join(f'WHEN trim(O) LIKE {(a + chr(37))!r} THEN {b!r}' for a, b in PAYMENTS)} ELSE 'outros' END AS categoria, count(*) AS n FROM cells GROUP BY 1")
def _(spark, d):
    code = F.col("cells")["O"]
    return cells(spark, d).groupBy(code.alias("codigo")).agg(F.count("*").alias("n")).withColumn("categoria", expr.payment_category(F.col("codigo")))


DATED = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ontem' WHEN 1 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS criado, ts, CAST(floor(value) AS INTEGER) AS v FROM events"


@query(
    "ages_and_dates",
    f"""WITH e AS ({DATED}) SELECT event_id, CASE WHEN event_id % 4 > 0 THEN CAST(greatest(0, floor((epoch(TIMESTAMP '2024-01-12 06:30:00') - epoch(CAST(replace(replace(criado, 'T', ' '), 'Z', '') AS TIMESTAMP))) / 86400)) AS INTEGER) END AS idade, CAST(date_trunc('second', ts) - INTERVAL 3 HOUR AS DATE) AS dia_local,
  CASE WHEN length(criado) = 10 THEN concat(criado, 'T23:59:59') ELSE criado END AS fim, make_date(CAST((year(ts) * 12 + month(ts) - 1 - v % 30) // 12 AS INTEGER), CAST((year(ts) * 12 + month(ts) - 1 - v % 30) % 12 + 1 AS INTEGER), CAST(least(28, day(ts)) AS INTEGER)) AS antes, DATE '1899-12-30' + v AS serial FROM e""",
)
def _(spark, d):
    made = F.when(F.col("event_id") % 4 == 0, "ontem").when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    rows = table(spark, d, "events").select("event_id", made.alias("criado"), "ts", F.floor("value").cast("int").alias("v"))
    asked = F.lit("2024-01-12 06:30:00").cast("timestamp")
    months = F.expr("add_months(trunc(ts, 'month'), -(v % 30))")
    back = F.date_add(months, F.least(F.dayofmonth("ts"), F.lit(28)) - 1)
    return rows.select("event_id", text.age_days(F.col("criado"), asked).alias("idade"), text.local_day(F.col("ts")).alias("dia_local"), text.to_datetime(F.col("criado"), end_of_day=True).alias("fim"), back.alias("antes"), text.serial_day(F.col("v")).alias("serial"))


@query(
    "search_tags",
    """WITH t AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'alto' WHEN 1 THEN 'medio' WHEN 2 THEN 'baixo' WHEN 3 THEN 'outro' END AS nivel, CASE WHEN c_custkey % 7 > 0 AND c_custkey % 5 < 4 THEN '2024-01-05T10:00:00' END AS em, c_custkey % 3 > 0 AS fresco FROM customer)
  SELECT id, CASE WHEN nivel IS NULL AND em IS NULL THEN 'sem dado' WHEN NOT fresco THEN concat('sem dado recente (fonte: Keyword Planner, busca de ', coalesce(em[:10], '?'), ')') ELSE concat(CASE nivel WHEN 'alto' THEN 'Alto' WHEN 'medio' THEN 'Médio' WHEN 'baixo' THEN 'Baixo' ELSE nivel END, ' (fonte: Keyword Planner, busca de ', coalesce(em[:10], '?'), ')') END AS tag FROM t""",
)
def _(spark, d):
    k = F.col("c_custkey")
    level = F.when(k % 5 == 0, "alto").when(k % 5 == 1, "medio").when(k % 5 == 2, "baixo").when(k % 5 == 3, "outro")
    fetched = F.when((k % 7 > 0) & (k % 5 < 4), "2024-01-05T10:00:00")
    return table(spark, d, "customer").select(k.alias("id"), text.search_tag(level, fetched, k % 3 > 0, "Keyword Planner").alias("tag"))


@query(
    "year_links",
    """WITH p AS (SELECT page_id, concat('<ul><li>', 2000 + page_id % 30, ' (<a href="', url, '">Excel/xlsx</a>) (<a href="x">ODS</a>)</li><li class="b">', 1990 + page_id % 7, ' (<a href="y">ODS</a>)</li><li>sem ano <a href="z">excel/xlsx</a></li></ul>') AS html FROM pages),
  i AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1)) AS x FROM p), y AS (SELECT page_id, regexp_extract(x, '(\\d{4})\\s*\\(', 1) AS ano, regexp_extract(x, '(?i)href="([^"]+)"[^>]*>\\s*Excel/xlsx', 1) AS link FROM i)
  SELECT page_id, CAST(ano AS INTEGER) AS ano, link FROM y WHERE ano <> '' AND link <> ''""",
)
def _(spark, d):
    p = F.col("page_id")
    html = F.concat(F.lit("<ul><li>"), 2000 + p % 30, F.lit(' (<a href="'), "url", F.lit('">Excel/xlsx</a>) (<a href="x">ODS</a>)</li><li class="b">'), 1990 + p % 7, F.lit(' (<a href="y">ODS</a>)</li><li>sem ano <a href="z">excel/xlsx</a></li></ul>'))
    return table(spark, d, "pages").select("page_id", F.explode(text.year_links(html)).alias("ano", "link")).withColumn("ano", F.col("ano").cast("int"))


LOGS = [
    f"x\n{text.BLOCKED}reconciliação de linhas falhou e mais\n[fim] duplicado(s)",
    f"{text.BLOCKED}outra coisa",
    f"a {text.BLOCKED}anúncio duplicado(s)",
    "Nenhum .xlsx de ITBI em cache",
    "nonStop API 401 em /lista: não",
    "erro: Sem NONSTOP_TOKEN",
    "Traceback (most recent call last)\n x",
    "parou",
]


@query("failure_categories", "SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN 'linhas_itbi' WHEN 1 THEN 'check' WHEN 2 THEN 'duplicatas' WHEN 3 THEN 'itbi_download' WHEN 4 THEN 'nonstop_api' WHEN 5 THEN 'nonstop_token' WHEN 6 THEN 'erro_programa' ELSE 'desconhecido' END AS motivo FROM customer")
def _(spark, d):
    log = F.element_at(F.array(*map(F.lit, LOGS)), (F.col("c_custkey") % 8 + 1).cast("int"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.failure_category(log).alias("motivo"))


HEADER = {"A": "N° do Cadastro (SQL)", "E": "Bairro", "X": "Uso (IPTU)"}


@query(
    "header_layout",
    """WITH s AS (SELECT n_nationkey AS k, concat('JAN-', 2000 + n_nationkey) AS sheet FROM nation) SELECT sheet, 'sem cabeçalho' AS problema FROM s WHERE k % 5 = 0 UNION ALL SELECT sheet, 'colunas vazias' FROM s WHERE k % 5 = 1
  UNION ALL SELECT sheet, 'coluna A' FROM s WHERE k % 5 = 2 UNION ALL SELECT sheet, 'coluna X' FROM s WHERE k % 5 IN (1, 2)""",
)
def _(spark, d):
    k = F.col("n_nationkey")
    names = F.create_map(
        F.lit("A"), F.when(k % 5 == 2, "SQL").otherwise(HEADER["A"]), F.lit("E"), F.when(k % 5 == 0, "Moema").otherwise("Bairro"), F.lit("X"), F.when(k % 5 == 1, F.lit(None).cast("string")).when(k % 5 == 2, "uso").otherwise(HEADER["X"])
    )
    rows = table(spark, d, "nation").select(F.concat(F.lit("JAN-"), 2000 + k).alias("sheet"), F.lit(3).alias("row_num"), names.alias("cells"))
    return checks.header_layout(rows, HEADER, list(HEADER))
