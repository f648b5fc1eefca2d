"""Golden cases of the scalar functions, the fixpoint removal of repeats and the history fold."""

import datetime

import pytest
from pyspark.sql import functions as F

from terrafolio.functions import expr, stats
from terrafolio.operators import history, valuation
from terrafolio.streaming.history import follow


def one(spark, value, kind, column):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


# the rule: four digits at most that end a word, after one of four words and any zeros
UNITS = [("bloco c apto. 0034", 34), ("AP12345", None), ("AP 77B", None), ("APARTAMENTO 9", 9), ("MAPA 5", None), ("loja", None), (None, None)]
# the rule: the digit before the letters, even with spaces between; one where a space is only named
SPACES = [("sala 8, 13 vgs", 3), ("4v g", 4), ("fundos E VG", 1), ("com vaga", 1), ("VAGAS", None), ("", None), (None, None)]


@pytest.mark.parametrize(("text", "number"), UNITS)
def test_unit_number(spark, text, number):
    assert one(spark, text, "string", expr.unit_number) == number


@pytest.mark.parametrize(("text", "spaces"), SPACES)
def test_parking(spark, text, spaces):
    assert one(spark, text, "string", expr.parking_spaces) == spaces


@pytest.mark.parametrize(("text", "key"), [("0", None), ("123.7", "00000000123"), ("1.5e3", "00000001500"), ("123456789012", "123456789012"), ("-4", None), ("1d", None), ("", None), (None, None)])
def test_cadastre_id(spark, text, key):
    assert one(spark, text, "string", expr.cadastre_id) == key


@pytest.mark.parametrize(("text", "kind"), [(" 1.SFH", "sfh"), ("99.x", "sfi"), ("  ", "a_vista"), (None, "a_vista"), ("9.x", "outros")])
def test_payment_category(spark, text, kind):
    assert one(spark, text, "string", expr.payment_category) == kind


@pytest.mark.parametrize(("text", "plain"), [("D'Oeste-Sul", "DOESTESUL"), ("A (b) c", "A C"), ('x "y" z', "X Z")])
def test_marks_are_deleted(spark, text, plain):
    assert one(spark, text, "string", expr.place_name) == plain


@pytest.mark.parametrize(("text", "street"), [("Rod. Dutra (km 4)", "RODOVIA DUTRA KM 4"), ("PRQ X", "PARQUE X"), ("RUA R", "RUA R")])
def test_street_name(spark, text, street):
    assert one(spark, text, "string", expr.street_name) == street


@pytest.mark.parametrize(("text", "plain"), [("Vila São José (norte)", "VILA SAO JOSE"), ('Água "x" Branca', "AGUA BRANCA"), ("", ""), (None, None)])
def test_place_name(spark, text, plain):
    assert one(spark, text, "string", expr.place_name) == plain


def test_address_key(spark):
    rows = spark.createDataFrame([("R. das Flores", "0010.0"), ("Av Brasil", "0"), ("", "3"), (None, "1")], "s string, n string")
    assert [r[0] for r in rows.select(expr.address_key(F.col("s"), F.col("n"))).collect()] == ["RUA DAS FLORES|10", "AVENIDA BRASIL|0", None, None]


@pytest.mark.parametrize(("ratio", "points"), [(None, 50.0), (1.5, 50.0), (0.85, 100.0), (0.5, 60.0), (3.0, 0.0)])
def test_price_alignment(spark, ratio, points):
    assert one(spark, ratio, "double", expr.price_alignment) == pytest.approx(points)


def test_half_up(spark):
    assert [one(spark, x, "double", lambda c: expr.half_up(c, 0)) for x in (0.5, 1.5, 2.4)] == [1.0, 2.0, 2.0]


def test_shares_add_up(spark):
    counts = spark.createDataFrame([("b", k, n) for k, n in (("x", 1), ("y", 1), ("z", 1))], "g string, c string, n long")
    rows = {r["c"]: r["pct"] for r in stats.shares_of_100(counts, ["g"], "c", "n").collect()}
    assert rows == {"x": 33.4, "y": 33.3, "z": 33.3}


def test_readvertised_units_merge_to_a_fixpoint(spark):
    day = lambda n: datetime.date(2024, 1, n)
    rows = [("a", 80.0, 1, 1, 100.0, day(1)), ("a", 80.0, 2, 2, 103.0, day(5)), ("a", 80.0, 3, 3, 106.0, day(3)), ("a", 81.0, 4, 4, 100.0, day(1)), (None, 80.0, 5, 5, 100.0, day(1)), ("b", 80.0, 6, 6, 110.0, day(2))]
    found = history.merge_readvertised(spark.createDataFrame(rows, "endereco string, area double, ordem long, codigo long, preco double, criado date"))
    assert sorted(map(tuple, found.collect())) == [(2, day(1)), (4, day(1)), (5, day(1)), (6, day(2))]


def test_fold(spark):
    state = spark.createDataFrame([], history.STATE)
    batches = [("2024-01-01", [(1, 10.0), (2, 20.0), (None, 1.0)]), ("2024-01-02", [(1, 9.0), (3, 30.0)]), ("2024-01-04", [(1, 9.0), (2, 20.0), (3, 30.0)])]
    for now, rows in batches:
        state = history.fold(state, spark.createDataFrame(rows, "codigo long, preco double"), datetime.datetime.fromisoformat(now))
    found = {r["codigo"]: (r["preco_inicial"], r["preco_atual"], r["mudancas"], r["saida"], r["voltas"]) for r in state.collect()}
    assert found == {1: (10.0, 9.0, 1, None, 0), 2: (20.0, 20.0, 0, None, 1), 3: (30.0, 30.0, 0, None, 0)}


def test_fold_of_a_stream_equals_the_fold_at_once(spark, tmp_path):
    days = [[(1, 10.0), (2, 20.0)], [(1, 9.0), (3, 30.0)], [(1, 9.0), (2, 21.0)]]
    for k, rows in enumerate(days):
        stamp = datetime.datetime(2024, 1, 1 + k)
        spark.createDataFrame([(*r, stamp) for r in rows], "codigo long, preco double, visto timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("codigo long, preco double, visto timestamp").parquet(f"{tmp_path}/in")
        query = follow(stream, f"{tmp_path}/state", f"{tmp_path}/check")
        query.processAllAvailable()
        query.stop()
    state = {r["codigo"]: (r["preco_atual"], r["mudancas"], r["saida"] is not None, r["voltas"]) for r in spark.read.parquet(f"{tmp_path}/state/2").collect()}
    assert state == {1: (9.0, 1, False, 0), 2: (21.0, 1, False, 1), 3: (30.0, 0, True, 0)}


def test_estimate_levels(spark):
    sales = spark.createDataFrame([(i, "p", "b", "t", 100.0, 10_000.0 + 100 * i) for i in range(5)] + [(10 + i, f"q{i}", "b", "t", 100.0, 8_000.0) for i in range(8)], "venda long, endereco string, bairro string, tipo string, area double, m2 double")
    asked = spark.createDataFrame([(1, "p", "b", "t", 100.0, None), (2, "zz", "b", "t", 100.0, None), (3, "zz", "c", "t", 100.0, None)], "pedido_id long, endereco string, bairro string, tipo string, area double, venda long")
    found = {r["pedido_id"]: (r["nivel"], r["n"], r["estimativa"], r["confianca"]) for r in valuation.estimate(asked, sales).collect()}
    assert found == {1: ("predio", 5, 1_020_000.0, "alta"), 2: ("bairro", 13, 800_000.0, "baixa")}


def test_usages_amounts_and_place_names_by_their_rules(spark):
    from terrafolio.functions import text
    from terrafolio.operators import sheet

    usages = {"10": True, "25.0": True, "20.000": True, "20.5": False, "20.": False, "020": False, "30": False, "": False, "20.0.0": False, "2e1": False}
    amounts = {"1200": True, "1200.50": True, "0": False, "0.00": False, "-5": False, "1,200": False, "1e3": False, ".5": False, "5.": False, "": False, "1.2.3": False}
    names = {"Moema": True, "": False, "  \t ": False, "123": False, " 123 ": False, "12 34": True, "Casa 2": False, "casa": False, "Casa-2": False, "CASARÃO": True, "Vila Ed": True, "ED. SOL": False, "LTÁ": True, "AP_1": True, None: False}
    for known, rule in ((usages, sheet.is_residential), (amounts, sheet.is_amount), (names, text.looks_like_place)):
        rows = spark.createDataFrame([(k,) for k in known], "x string")
        assert {r["x"]: r["ok"] for r in rows.select("x", rule(F.col("x")).alias("ok")).collect()} == known


def test_address_search_equals_the_plain_rule(spark):
    import random
    import re

    from terrafolio.operators import search
    from terrafolio.operators.order import settled

    rng = random.Random(6)
    words = ["CD", "DE", "ITU", "AV", "AVIAÇÃO", "S", "JOAQUIM", "STA", "RITA", "R", "DR", "ALVES", "PE", "PEDRO"]
    buildings = [(i, " ".join(rng.choices(words, k=3)), str(rng.randrange(1, 9))) for i in range(120)]
    streets = sorted({(t, i % 3) for i, t, _ in buildings})
    streets = [(k, t, t.title(), p) for k, (t, p) in enumerate(streets)]
    requests = [" ".join(rng.choices(["conde", "de", "itu", "avenida", "aviacao", "são", "santa", "rit", "rua", "doutor", "padre", "pe", "zzz", "a", "e"], k=rng.randrange(0, 4)) + rng.choice([[], [], [f"0{rng.randrange(1, 12)}"]])) for _ in range(80)] + [None, "", "12", "de da"]
    b = spark.createDataFrame([(i, t, n, f"{t}, {n}") for i, t, n in buildings], "id long, texto string, numero string, rotulo string")
    s = spark.createDataFrame(streets, "id long, texto string, nome string, lugar long")
    asked = spark.createDataFrame(list(enumerate(requests)), "req long, pedido string")
    found = search.suggestions(asked, b, s, settled(search.posted(b)), settled(search.posted(s))).collect()

    plain = lambda t: re.sub("[^A-Z0-9]+", " ", t.upper().translate(str.maketrans("ÃÇÕÁÉÍ", "ACOAEI"))).strip()
    want = set()
    for req, text in enumerate(requests):
        tokens = plain(text or "").split()
        numbers = [t for t in tokens if t.isdigit()]
        names = [t for t in tokens if not t.isdigit() and t not in search.NO_WORTH]
        if not names:
            continue
        number = str(int(numbers[-1])) if numbers else None
        fits = lambda t: all(n in t or set(search.ABBREVIATIONS.get(n, ())) & set(t.split()) for n in names)  # noqa: B023, E731
        hits = [(i, f"{t}, {n}") for i, t, n in buildings if fits(plain(t)) and number in (None, n)][:8]
        if number is None:
            hits.sort(key=lambda h: (h[1], h[0]))
        want |= {(req, k, "predio", *h) for k, h in enumerate(hits, 1)}
        if number and not hits:
            roads, seen = [], set()
            for k, t, name, p in [x for x in streets if fits(plain(x[1]))][:12]:
                if (name, p) not in seen:
                    seen.add((name, p))
                    roads.append((k, f"{name}, {number}"))
            want |= {(req, k, "rua", *h) for k, h in enumerate(roads[:8], 1)}
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert {t for _, _, t, _, _ in want} == {"predio", "rua"}
