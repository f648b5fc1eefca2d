"""The publish gate finds nothing where nothing is wrong, and each of its checks finds some planted fault."""

import pytest
from pyspark.sql import functions as F

from terrafolio.catalog import QUERIES
from terrafolio.operators import checks
from terrafolio.plans.views import deals

SF = "/root/testdata/sf0.01"
KINDS = {
    "gate_format": {"sem linha", "sem casa"},
    "gate_recompute": {"só na conferência", "n", "mediana"},
    "gate_payments": {"soma", "contagem", "poucas", "mediana", "amostra"},
    "gate_history": {"repetido", "não está ativo", "não está à venda", "preço", "datas", "mudança"},
    "gate_series": {"falta", "futuro", "sem valor", "variação"},
}


@pytest.mark.parametrize("name", sorted(KINDS))
def test_each_kind_of_fault_is_found(spark, name):
    assert {r["problema"] for r in QUERIES[name](spark, SF).select("problema").distinct().collect()} == KINDS[name]


@pytest.mark.parametrize("name", ["gate_volume_change", "gate_suspended", "gate_windows", "gate_searches"])
def test_faults_are_found_and_sound_rows_are_not(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_a_second_derivation_agrees(spark):
    clean = deals(spark, SF).where("limpa")
    panel = clean.groupBy("bairro", "ano").agg(F.count("*").alias("n"), F.median("valor").alias("mediana"))
    assert checks.parity(panel, checks.medians_by_counts(clean, ["bairro", "ano"], "valor"), ["bairro", "ano"], ["n", "mediana"]).count() == 0


def test_parity_of_nulls_texts_and_empty_tables(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, None, "y"), (3, 1.0, None), (4, 2.0, "z")], "k long, v double, t string")
    b = spark.createDataFrame([(1, 1.011, "x"), (2, None, "z"), (3, None, None), (4, 2.02, "z")], "k long, v double, t string")
    assert sorted(map(tuple, checks.parity(a, b, ["k"], ["v", "t"]).collect())) == [(2, "t"), (3, "v"), (4, "v")]
    assert checks.parity(a.where("false"), a.where("false"), ["k"], ["v"]).count() == 0
    assert {r["problema"] for r in checks.parity(a, a.where("false"), ["k"], ["v"]).collect()} == {"só no painel"}
