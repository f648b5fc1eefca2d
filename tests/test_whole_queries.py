"""Queries over all rows, against brute force on small tables."""

import pytest

from terrafolio.operators import addresses, market
from terrafolio.plans.views import dear_sales, listings, sales
from terrafolio.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def similar(offers):
    """(pedido_id, codigo, mesmo_predio, posto) of every listing; offers are (codigo, endereco, bairro, area, price)."""
    out = set()
    for c, e, b, a, v in offers:
        found = []
        for c2, e2, b2, a2, v2 in offers:
            if e == e2:
                found.append((False, abs(v2 - v), c2))
            elif b == b2 and abs(a2 - a) <= 0.1 * a and abs(v2 - v) <= 0.1 * v:
                found.append((True, abs(v2 - v), c2))
        out |= {(c, c2, not other, k + 1) for k, (other, _, c2) in enumerate(sorted(found)[:8])}
    return out


def test_similar_listings_of_all(spark):
    offers = [tuple(r) for r in listings(spark, SF).select("codigo", "endereco", "bairro", "area", "pedido_valor").collect()]
    found = QUERIES["similar_listings_all"](spark, SF).collect()
    assert {r["pedido_id"] for r in found} == {o[0] for o in offers}
    assert {tuple(r) for r in found} == similar(offers) and len(found) == len(similar(offers))


def test_similar_listings_at_the_edges_of_bands(spark):
    # areas and prices at exactly 10 %, powers of the bands' ratio, zero and many alike
    values = [0.0, 90.0, 99.0, 100.0, 100.0 * 1.1, 110.0, 121.0, 1.1**40, 1.1**41, 0.9 * 1.1**41, 1e-3, 1.05e-3]
    offers = [(10 * i + j, (10 * i + j) // 3, "b", a, v) for i, a in enumerate(values) for j, v in enumerate((100.0, 110.0, 90.0, 0.0, 1e6))]
    frame = spark.createDataFrame(offers, "codigo long, endereco long, bairro string, area double, pedido_valor double")
    asked = frame.selectExpr("codigo pedido_id", "endereco", "bairro", "area", "pedido_valor valor")
    assert {tuple(r) for r in market.similar_listings(asked, frame).collect()} == similar(offers)


def test_block_votes_count_all_voters(spark):
    rows = spark.read.parquet(f"{SF}/customer.parquet").selectExpr("c_custkey", "c_nationkey", "c_mktsegment").collect()
    votes = {}
    for k, n, m in rows:
        if m in ("BUILDING", "MACHINERY"):
            votes.setdefault(n * 10 + k % 7, []).append("B_" + m)
    found = {r["quadra"]: r for r in QUERIES["block_vote_confidence_all"](spark, SF).collect()}
    assert found.keys() == votes.keys()
    for q, v in votes.items():
        best = min(set(v), key=lambda x: (-v.count(x), x))
        assert (found[q]["winner"], found[q]["n"]) == (best, len(v)) and found[q]["confianca"] == pytest.approx(100 * v.count(best) / len(v), abs=1e-6)
    assert QUERIES["resolution_cascade_all"](spark, SF).count() == len(rows)
    assert sum(r["n"] for r in QUERIES["closing_balance_all"](spark, SF).collect()) == len(rows)


def test_listing_scores_count_prospects_and_neighbourhoods(spark):
    scores = {r["bairro"]: r["score"] for r in QUERIES["neighbourhood_score"](spark, SF).collect()}
    paid = {(r["bairro"], r["tipo"], r["faixa"]): r["pago"] for r in QUERIES["paid_asked_full_outer"](spark, SF).collect() if not r["pequena"]}
    bands = {(r["bairro"], r["tipo"]): (r["low"], r["high"]) for r in QUERIES["adaptive_window_band"](spark, SF).collect() if not r["few"]}
    sold = {r["endereco"]: r["n"] for r in addresses.liquidity(dear_sales(spark, SF)).where("situacao = 'prospecto'").collect()}
    found = {r["codigo"]: r["score"] for r in QUERIES["listing_scores_all"](spark, SF).collect()}
    offers = [r for r in listings(spark, SF).collect() if r["bairro"] in scores]
    assert found.keys() == {r["codigo"] for r in offers} and any(r["endereco"] in sold for r in offers)
    for r in offers:
        pago = paid.get((r["bairro"], r["tipo"], "ate_50" if r["area"] <= 50 else "50_80"))
        ratio = r["pedido_valor"] / r["area"] / pago if pago else None
        price = 50 if ratio is None else max(0, 100 - (ratio - 1) * 100) if ratio > 1 else 100 if ratio >= 0.7 else max(30, 100 - (0.7 - ratio) * 200)
        parts = [(0.35, scores[r["bairro"]]), (0.3, price)]
        if (r["bairro"], r["tipo"]) in bands:
            low, high = bands[r["bairro"], r["tipo"]]
            away = max(low - r["pedido_valor"], r["pedido_valor"] - high)
            parts.append((0.25, 100 if away <= 0 else 50 if high <= low else max(0, 100 - 100 * away / (high - low))))
        parts.append((0.1, {0: 0, 1: 0, 2: 40, 3: 60, 4: 80}.get(sold.get(r["endereco"], 0), 100)))
        assert found[r["codigo"]] == pytest.approx(sum(w * x for w, x in parts) / sum(w for w, _ in parts), abs=0.051)


def test_calibration_tests_every_sale(spark):
    rows = [tuple(r) for r in sales(spark, SF).select("endereco", "bairro", "tipo", "area", "m2").collect()]
    building = {}
    for e, _, _, a, _ in rows:
        building.setdefault(e, []).append(a)
    first = sum(sum(abs(x - a) <= 0.2 * a for x in building[e]) > 3 for e, _, _, a, _ in rows)
    found = {(r["nivel"], r["confianca"]): r["n"] for r in QUERIES["loo_calibration"](spark, SF).collect()}
    assert found["predio", "*"] == first
