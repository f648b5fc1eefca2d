"""Queries whose work must not grow with requests times rows: the same rows as plain loops, without pairing the two."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from terrafolio import catalog, queries_panels
from terrafolio.operators import appraisal, market, order, panels, period, search, valuation

SALES = "venda long, predio long, rua long, bairro long, area double, hoje double, andar int, mes int"
REQUESTS = "id long, predio long, rua long, bairro long, area double, andar int, fora_venda long, fora_predio long"


def no_pairs(*_, **__):
    raise AssertionError("requests are paired with all rows of their place")


def made(seed, n=400, m=120):
    rng = random.Random(seed)
    sales = [(i, b := rng.choice([1, 1, 1, 2, None]), b and b % 2, 0, rng.choice([40.0, 44.0, 50.0, 48.0, rng.uniform(35, 60)]), rng.uniform(1e5, 9e5), rng.choice([None, 1, 2, 5, 9]), rng.randrange(4)) for i in range(n)]
    requests = [(i, b := rng.choice([1, 1, 2, 3, None]), b and b % 2, 0, rng.choice([40.0, 44.0, 50.0, 80.0]), rng.choice([None, 2, 6]), rng.choice([None, None, i]), rng.choice([None, None, 2])) for i in range(m)]
    return sales, requests


def test_most_similar_of_a_building(spark, monkeypatch):
    sales, requests = made(1)
    monkeypatch.setattr(appraisal, "comparables", no_pairs)
    factors = spark.createDataFrame([(0, 0.97)], "faixa int, fator double")
    got = {tuple(r) for r in appraisal.most_similar(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(sales, SALES), factors, "predio").collect()}
    want = set()
    for i, b, _, _, a, floor, own, out in requests:
        near = [(abs(x - a) / a, 99 if floor is None or f is None else abs(f - floor), -mes, v) for v, k, _, _, x, _, f, mes in sales if k is not None and k == b and k != out and v != own and abs(x - a) / a <= 0.2]
        want |= {(i, s[-1], k + 1) for k, s in enumerate(sorted(near)[:15])}
    assert got == want and got


def test_beside_takes_the_nearest_of_each_side(spark):
    cells = spark.createDataFrame([(k, float(x)) for k in "ab" for x in range(0, 40, 2)], "k string, x double")
    points = spark.createDataFrame([("a", 11.0), ("a", 10.0), ("b", -5.0), ("b", 99.0), ("c", 3.0)], "k string, at double")
    got = sorted(tuple(r) for r in order.beside(points, cells, ["k"], "at", "x", 2).select("k", "at", "x").collect())
    assert got == [("a", 10.0, 8.0), ("a", 10.0, 10.0), ("a", 10.0, 12.0), ("a", 10.0, 14.0), ("a", 11.0, 8.0), ("a", 11.0, 10.0), ("a", 11.0, 12.0), ("a", 11.0, 14.0), ("b", -5.0, 0.0), ("b", -5.0, 2.0), ("b", 99.0, 36.0), ("b", 99.0, 38.0)]


def joined_rows(spark, frame):
    """The most rows that any operator of a finished query gave out."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan()
        most, stack = 0, [plan]
        while stack:
            node = stack.pop()
            metric = node.metrics().get("numOutputRows")
            most = max(most, metric.get().value() if metric.isDefined() else 0)
            stack += [node.children().apply(i) for i in range(node.children().size())]
        return most
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_alike_listings_are_not_paired(spark):
    # 600 offers of one place, of 2 areas and 3 prices: 360,000 pairs
    rows = [(i, i, "b", "t", 50.0 + i % 2, 1000.0 + i % 3, 2) for i in range(600)]
    stock = spark.createDataFrame(rows, "codigo long, endereco long, bairro string, tipo string, area double, pedido_valor double, quartos int")
    asked = stock.select(F.col("codigo").alias("pedido_id"), "endereco", "bairro", "area", F.col("pedido_valor").alias("valor"))
    similar = market.similar_listings(asked, stock)
    assert joined_rows(spark, similar) < 30_000 and similar.count() == 600 * 8
    asked = stock.select(F.col("codigo").alias("pedido_id"), F.col("endereco").alias("predio"), "bairro", "quartos", F.when(F.col("codigo") % 3 > 0, F.col("area")).alias("util"), F.when(F.col("codigo") % 5 > 0, F.col("pedido_valor")).alias("estimativa"))
    likely = market.comparable_listings(asked, stock.withColumnRenamed("endereco", "predio").withColumnRenamed("pedido_valor", "valor"))
    assert joined_rows(spark, likely) < 30_000 and likely.count() == 600 * 8


def test_comparable_listings_as_plain_loops(spark):
    rng = random.Random(5)
    stock = [(i, rng.choice([1, 2, 3, None]), rng.choice("ab"), rng.choice([1, 2, None]), rng.choice([40.0, 50.0, 55.0, 0.0, None]), rng.choice([100.0, 110.0, 125.0, 0.0, None])) for i in range(160)]
    asked = [(i, rng.choice([1, 2, 9, None]), rng.choice("abc"), rng.choice([1, 2, None]), rng.choice([45.0, 50.0, None, 0.0]), rng.choice([100.0, 120.0, None, 0.0])) for i in range(80)]
    frames = spark.createDataFrame(asked, "pedido_id long, predio long, bairro string, quartos int, util double, estimativa double"), spark.createDataFrame(stock, "codigo long, predio long, bairro string, quartos int, area double, valor double")
    want = set()
    for i, own, place, rooms, size, value in asked:
        found = []
        for code, building, where, has, area, price in stock:
            gap = (None if price is None else abs(price - value)) if value else 0.0
            if own is not None and building == own:
                found.append((False, gap is not None, gap or 0.0, code))
            elif where == place and (rooms is None or has is None or rooms == has):
                if (area and abs(area - size) / size <= 0.25) if size else (price and abs(price - value) / value <= 0.3) if value else True:
                    found.append((True, gap is not None, gap or 0.0, code))
        want |= {(i, code, not far, k + 1) for k, (far, _, _, code) in enumerate(sorted(found)[:8])}
    assert {tuple(r) for r in market.comparable_listings(*frames).collect()} == want


def test_appraisals_leave_sales_and_buildings_out(spark, monkeypatch):
    sales, requests = made(3, 200, 60)
    monkeypatch.setattr(appraisal, "comparables", no_pairs)
    factors = spark.createDataFrame([(0, 1.0)], "faixa int, fator double")
    got = {r["id"]: (r["nivel"], r["n"], r["ultima"]) for r in appraisal.appraise(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(sales, SALES), factors).collect()}
    want = {}
    for i, *places, a, _, own, out in requests:
        for level, ((tight, wide), least) in appraisal.LEVELS.items():
            at = list(appraisal.LEVELS).index(level)
            near = [(abs(s[4] - a) / a, s[7]) for s in sales if places[at] is not None and s[1 + at] == places[at] and s[0] != own and (out is None or s[1] != out)]
            close, all_ = [m for d, m in near if d <= tight], [m for d, m in near if d <= wide]
            if len(close) >= least or len(all_) >= least or (level == "predio" and all_):
                used = close if len(close) >= least else all_
                want[i] = (level if len(used) >= least else "predio_poucas", len(used), max(used))
                break
    assert got == want


def test_alike_requests_are_searched_once(spark, monkeypatch):
    searched = []
    whole = search.matches
    monkeypatch.setattr(search, "matches", lambda asked, *rest: searched.append(asked) or whole(asked, *rest))
    places = spark.createDataFrame([(i, f"R AZUL {i % 3}", str(i % 3), f"R AZUL, {i % 3}") for i in range(30)], "id long, texto string, numero string, rotulo string")
    roads = spark.createDataFrame([(1, "R AZUL", "R AZUL", "b")], "id long, texto string, nome string, lugar string")
    requests = spark.createDataFrame([(i, f"azul {i % 5}" if i % 2 else "azul") for i in range(40)], "req long, pedido string")
    found = search.suggestions(requests, places, roads, search.posted(places), search.posted(roads)).collect()
    assert searched[0].count() == 1
    assert {(r["req"], r["tipo"]) for r in found} == {(i, "rua" if i % 2 and i % 5 > 2 else "predio") for i in range(40)}


def test_estimates_of_neighbourhoods_pair_no_request_with_its_sales(spark, monkeypatch):
    paired = []
    whole = valuation._matched
    monkeypatch.setattr(valuation, "_matched", lambda asked, sales, key, *rest: paired.append(key) or whole(asked, sales, key, *rest))
    rng = random.Random(9)
    sizes = [10.0, 11.0, 12.0, 27.0, 30.0, 33.0, 40.0, 44.0]
    sales = [(i, rng.choice([1, 2, None]) if i % 9 == 0 else 100 + i, "a", rng.choice("xy"), rng.choice(sizes), rng.choice([None, *(float(k) for k in range(50, 70))])) for i in range(400)]
    asked = [(i, rng.choice([1, 2, 7, None]), "a", rng.choice("xyz"), rng.choice(sizes), rng.choice([None, rng.randrange(400)])) for i in range(100)]
    frames = spark.createDataFrame(asked, "pedido_id long, endereco long, bairro string, tipo string, area double, venda long"), spark.createDataFrame(sales, "venda long, endereco long, bairro string, tipo string, area double, m2 double")
    got = {r["pedido_id"]: (r["nivel"], r["n"], r["m2"]) for r in valuation.estimate(*frames).collect()}
    want = {}
    for i, place, _, kind, a, own in asked:
        near = lambda share: [s for s in sales if s[5] is not None and s[0] != own and abs(s[4] - a) <= a * share]  # noqa: B023, E731
        for level, found, least in (("predio", [s[5] for s in near(0.2) if place is not None and s[1] == place], 3), ("bairro", [s[5] for s in near(0.1) if s[3] == kind], 8)):
            if len(found) >= least:
                want[i] = (level, len(found), statistics.median(found))
                break
    assert got == want and {v[0] for v in want.values()} == {"predio", "bairro"}
    assert paired == ["endereco"]


def test_sheet_queries_make_only_the_cells_that_they_read(spark):
    for name in ("translated_names", "unit_floors", "prefix_majority", "sheet_dedup"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "map(A" not in plan and "99.SFI" not in plan, name  # letter O, which none of them reads
    # five branches vote and are resolved: translated once
    plan = catalog.QUERIES["universe_resolution"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan


def test_rolling_medians_meet_only_the_middle_of_each_window(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(rng.choice(["a", None]), rng.choice([1, 2, 4, 9]), rng.choice([5.0, rng.uniform(0, 1e4), rng.uniform(0, 1e4)])) for _ in range(900)]
    frame = spark.createDataFrame(rows, "k string, mes int, y double")
    met = []
    whole = period.matched
    monkeypatch.setattr(period, "matched", lambda left, right, keys: met.append(whole(left, right, keys)) or met[-1])
    got = {(r["k"], r["i"], r["w"]): (r["median"], r["n"]) for r in period.rolling_medians(frame, ["k"], "y").collect()}
    want = {}
    for k in ("a", None):
        for i in range(1, 10):
            for w in (3, 6, 12):
                lo = max(1, min(i - w // 2, 9 - w + 1))
                found = [y for key, m, y in rows if key == k and lo <= m <= min(9, lo + w - 1)]
                if found:
                    want[k, i, w] = (statistics.median(found), len(found))
    assert got == want
    assert met[-1].count() < 900 * 21 / 8


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_quantiles_of_large_groups_as_plain_loops(spark):
    rng = random.Random(13)
    rows = [(rng.choice(["a", "b", None]), rng.choice([7.0, 7.0, None, rng.uniform(0, 1e4), rng.uniform(0, 1e4)])) for _ in range(700)] + [("c", 5.0)]
    got = {r["k"]: (r["n"], r["q"]) for r in period.group_quantiles(spark.createDataFrame(rows, "k string, y double"), ["k"], "y", [0.25, 0.5]).collect()}
    assert set(got) == {"a", "b", "c", None}
    for k, (n, q) in got.items():
        ys = sorted(y for key, y in rows if key == k and y is not None)
        assert n == len(ys) and (len(ys) == 1 or all(abs(a - b) < 1e-9 for a, b in zip(q, statistics.quantiles(ys, n=4, method="inclusive"))))


def test_a_city_index_is_made_only_for_places_without_their_own(spark, monkeypatch):
    made = []
    whole = panels.rolling_medians
    monkeypatch.setattr(panels, "rolling_medians", lambda rows, keys, *rest, **more: made.append(keys) or whole(rows, keys, *rest, **more))
    sales = [("Z0", "casa", True, m, 100.0 + m) for m in range(12) for _ in range(200)]
    frame = lambda more: spark.createDataFrame(sales + more, "zona string, tipo string, limpa boolean, mes int, m2 double")
    own = panels.time_factors(frame([]), F.lit(0), F.lit(11)).collect()
    assert made == [["zona", "tipo"]] and {r["janela"] for r in own} == {3} and len(own) == 12
    both = panels.time_factors(frame([("Z1", "casa", True, 3, 90.0)]), F.lit(0), F.lit(11)).collect()
    assert made[1:] == [["zona", "tipo"], ["tipo"]] and {(r["zona"], r["janela"]) for r in both} == {("Z0", 3), ("Z1", None)} and len(both) == 24


def test_building_prices_count_values_of_a_building_once(spark):
    found = plan(catalog.QUERIES["building_prices"](spark, "/root/testdata/sf0.001"))
    assert found.count("percentile(") == 2 and "l_partkey" not in found


def test_house_reference_gathers_no_group(spark):
    found = plan(catalog.QUERIES["house_reference"](spark, "/root/testdata/sf0.001"))
    assert "percentile(" not in found and "median(" not in found and "l_partkey" not in found


def test_findings_join_the_sales_once(spark):
    for name in ("value_findings", "findings_order", "findings_by_place", "findings_summary"):
        assert "l_partkey" not in plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")), name


def test_readiness_and_shortlist_join_the_sales_once(spark, monkeypatch):
    joined = []
    whole = queries_panels.deals
    monkeypatch.setattr(queries_panels, "deals", lambda *given: joined.append(given) or whole(*given))
    for name in ("readiness", "shortlist"):
        joined.clear()
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(joined) == 1, name


def test_the_chain_has_all_columns_that_it_reads(spark, monkeypatch):
    class Reached(Exception):
        pass

    def reached(*_, **__):
        raise Reached

    monkeypatch.setattr(appraisal, "left_out", reached)
    with pytest.raises(Reached):
        catalog.QUERIES["appraisal_chain"](spark, "/root/testdata/sf0.001")


def test_places_that_share_a_text_are_indexed_once(spark, monkeypatch):
    posted, found = [], []
    whole, matching = search.posted, search.matches
    monkeypatch.setattr(search, "posted", lambda places: posted.append(places) or whole(places))
    monkeypatch.setattr(search, "matches", lambda asked, places, *rest: found.append(matching(asked, places, *rest)) or found[-1])
    got = catalog.QUERIES["address_suggestions"](spark, "/root/testdata/sf0.001")
    assert got.count() and all(rows.count() == rows.select("texto").distinct().count() for rows in posted)
    assert found[0].groupBy("req", "texto").count().where("count > 1").count() == 0


def test_suggestions_as_plain_loops_where_texts_repeat(spark):
    rng = random.Random(17)
    names = ["R AZUL", "AV AZUL CLARO", "R VERDE"]
    places = [(i, (n := rng.choice(names)), str(k := rng.randrange(5)), f"{n}, {k}") for i in range(300)]
    requests = [(i, rng.choice(["azul", "rua azul", "verde", "claro av"]) + rng.choice(["", "", " 1", " 04", " 7"])) for i in range(60)]
    roads = [(i, n, n, "b") for i, n in enumerate(names)]
    frames = spark.createDataFrame(places, "id long, texto string, numero string, rotulo string"), spark.createDataFrame(roads, "id long, texto string, nome string, lugar string")
    got = {(r["req"], r["posto"], r["tipo"], r["id"]) for r in search.suggestions(spark.createDataFrame(requests, "req long, pedido string"), *frames, search.posted(frames[0]), search.posted(frames[1])).collect()}
    want = set()
    for req, text in requests:
        words = [w for w in text.upper().split() if not w.isdigit()]
        number = next((str(int(w)) for w in text.split() if w.isdigit()), None)
        holds = lambda t: all(w in t or (w == "RUA" and "R" in t.split()) for w in words)  # noqa: B023, E731
        fits = [p for p in places if holds(p[1]) and number in (None, p[2])][:8]
        fits = sorted(fits, key=lambda p: (p[3], p[0])) if number is None else fits
        want |= {(req, k + 1, "predio", p[0]) for k, p in enumerate(fits)}
        want |= {(req, k + 1, "rua", i) for k, i in enumerate([i for i, n, *_ in roads if holds(n)][: 0 if fits or number is None else 8])}
    assert got == want and {k[2] for k in want} == {"predio", "rua"}


def graded(seed):
    rng = random.Random(seed)
    return [(i, "m", rng.choice(["predio", "rua"]), rng.choice(["alta", "media"]), rng.choice([1e5, rng.uniform(8e4, 2e5)]), rng.choice([1e5, rng.uniform(8e4, 2e5)])) for i in range(500)]


def test_calibration_gathers_no_level(spark):
    tests = graded(21)
    table = appraisal.calibrate(spark.createDataFrame(tests, "id long, modo string, nivel string, confianca string, estimativa double, real double"))
    assert "percentile(" not in plan(table) and "median(" not in plan(table)
    got = {(r["nivel"], r["confianca"]): r for r in table.collect()}
    assert len(got) == 6
    for (level, sure), row in got.items():
        own = [(abs(e - x) / x, x / e) for _, _, n, c, e, x in tests if n == level and sure in (c, "*")]
        cut = statistics.quantiles([e for e, _ in own], n=4, method="inclusive")
        ratios = statistics.quantiles([x for _, x in own], n=100, method="inclusive")
        assert row["n"] == len(own) and row["mediano"] == pytest.approx(cut[1], abs=6e-5) and row["p75"] == pytest.approx(cut[2], abs=6e-5)
        assert row["q"] == pytest.approx([ratios[p - 1] for p in appraisal.PERCENTILES], abs=6e-5)


def test_backtest_numbers_no_tests(spark, monkeypatch):
    tests = graded(22)
    frame = spark.createDataFrame(tests, "id long, modo string, nivel string, confianca string, estimativa double, real double")
    calibration = appraisal.calibrate(frame)
    monkeypatch.setattr(order, "numbered", no_pairs)
    got = {(r["nivel"], r["confianca"]): r for r in appraisal.backtest(frame, calibration).collect()}
    assert len(got) == 6
    for (level, sure), row in got.items():
        own = sorted((abs(e - x) / x, (e - x) / x) for _, _, n, c, e, x in tests if n == level and sure in (c, "*"))
        assert row["n"] == len(own) and row["erro_p75"] == pytest.approx(100 * own[3 * len(own) // 4][0], abs=0.051)
        assert row["erro_mediano"] == pytest.approx(100 * statistics.median(e for e, _ in own), abs=0.051) and row["vies"] == pytest.approx(100 * statistics.median(v for _, v in own), abs=0.051)


def test_estimated_areas_with_the_same_sales_in_range_are_one_request(spark, monkeypatch):
    asked = []
    whole = appraisal._picked
    monkeypatch.setattr(appraisal, "_picked", lambda asks, values: asked.append(asks) or whole(asks, values))
    rng = random.Random(23)
    sales = [(i, i % 3, 0, 0, rng.choice([40.0, 50.0, 60.0]), rng.uniform(1e5, 9e5), None, 1) for i in range(300)]
    areas = [(i, s[4] * rng.uniform(0.8, 1.25)) for i, s in enumerate(sales)]
    tests = appraisal.left_out(frame := spark.createDataFrame(sales, SALES), frame, spark.createDataFrame([(0, 1.0)], "faixa int, fator double"), spark.createDataFrame(areas, "venda long, area double"))
    assert asked[0].count() < 200 and tests.count() > 600
    got = {(r["id"], r["modo"]): r["estimativa"] for r in tests.collect()}
    for i, a in areas[::10]:
        near = [s for s in sales if s[1] == sales[i][1] and s[0] != i]
        used = next((u for tol in (0.1, 0.2) if len(u := [s[5] / s[4] for s in near if abs(s[4] - a) / a <= tol]) >= 3), None)
        if used:
            assert got[i, "predio"] == pytest.approx(statistics.median(used) * a, abs=0.6)


@pytest.mark.parametrize("few, batch", [(512, 10_000), (6, 7)])
def test_sales_left_out_of_buildings_are_compared_in_batches(spark, monkeypatch, few, batch):
    monkeypatch.setattr(order, "FEW", few)
    ranked = []
    whole = valuation._ranked
    monkeypatch.setattr(valuation, "_ranked", lambda rows, sales, *rest: ranked.append(rows) or whole(rows, sales, *rest))
    rng = random.Random(few)
    sales = [(i, rng.choice([None, *range(40), 7, 7, 7]), rng.choice(["a", None]), "t", rng.choice([10.0, 11.0, 12.0, 30.0]), rng.choice([None, 5.0, *(float(k) for k in range(3, 12))]), i) for i in range(300)]
    frame = spark.createDataFrame(sales, "venda long, endereco long, bairro string, tipo string, area double, m2 double, valor long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r["pedido_id"]: (r["nivel"], r["n"], r["m2"], r["valor"]) for r in valuation.leave_one_out(frame, also=["valor"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for i, place, where, _, a, _, _ in sales:
        near = lambda tol, at, of: [s[5] for s in sales if of is not None and s[at] == of and s[0] != i and s[5] is not None and abs(s[4] - a) / a <= tol]  # noqa: B023, E731
        for level, found, least in (("predio", near(0.2, 1, place), 3), ("bairro", near(0.1, 2, where), 8)):
            if len(found) >= least:
                want[i] = (level, len(found), pytest.approx(statistics.median(found), abs=0.0051), i)
                break
    assert got == want and {v[0] for v in want.values()} == {"predio", "bairro"}
    # only neighbourhoods and large buildings go by rank
    assert len(ranked) == (1 if few == 512 else 2)


def test_errors_of_sales_left_out_are_gathered_nowhere(spark):
    tests = graded(24)
    table = valuation.calibration(spark.createDataFrame([(i, n, c, e, x) for i, _, n, c, e, x in tests], "pedido_id long, nivel string, confianca string, estimativa double, valor double"))
    assert "percentile(" not in plan(table) and "median(" not in plan(table)
    got = {(r["nivel"], r["confianca"]): (r["n"], r["erro_mediano"]) for r in table.collect()}
    assert len(got) == 6
    for (level, sure), (n, median) in got.items():
        own = [100 * abs(e - x) / x for _, _, a, c, e, x in tests if a == level and sure in (c, "*")]
        assert n == len(own) and median == pytest.approx(statistics.median(own), abs=6e-5)
