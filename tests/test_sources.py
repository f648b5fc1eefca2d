"""Spreadsheets, dimensions, cards, state and snapshots from files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from terrafolio.operators import checks
from terrafolio.sources import files


def workbook(path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="r"><sheets><sheet name="JAN-2024" r:id="a"/><sheet name="notes" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/one.xml"/><Relationship Id="b" Target="worksheets/two.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Bairro</t></si><si><r><t>Vila </t></r><r><t>Nova</t></r></si></sst>")
        z.writestr("xl/worksheets/one.xml", f'<worksheet {main}><sheetData><row r="1"><c r="E1" t="s"><v>0</v></c></row><row r="3"><c r="E3" t="s"><v>1</v></c><c r="I3"><v>12.5</v></c><c r="J3"/></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/two.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')


def test_spreadsheet(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    rows = files.spreadsheets(spark, str(tmp_path / "*.xlsx"), r"[A-Z]{3}-\d{4}").select("sheet", "row_num", "cells").collect()
    assert [tuple(r) for r in rows] == [("JAN-2024", 1, {"E": "Bairro"}), ("JAN-2024", 3, {"E": "Vila Nova", "I": "12.5"})]


def test_dimension_with_overrides(spark):
    base = spark.createDataFrame([("a", "x"), ("b", "y")], "nome string, destino string")
    extra = spark.createDataFrame([("b", "z"), ("c", "w")], "nome string, destino string")
    assert sorted(map(tuple, files.dimension(base, extra, "nome", "destino").collect())) == [("a", "x"), ("b", "z"), ("c", "w")]
    assert [r["nome"] for r in files.conflicts(base.union(extra), "nome", "destino").collect()] == ["b"]


def test_cards(spark):
    card = {"address": {"area": "Centro", "geo": {"coordinates": [-46.6, -23.5]}}, "values": {"sale": 5.0}, "areas": {"private": 9999}, "base36Id": "k", "createdAt": "2024-01-02T03:04:05Z"}
    row = files.cards(spark.createDataFrame([(json.dumps(card),), ("{}",)], "card string")).collect()
    assert (row[0]["codigo"], row[0]["lat"], row[0]["lon"], row[0]["area"], row[1]["codigo"]) == ("k", -23.5, -46.6, None, None)


def test_state_refuses_what_it_cannot_read(spark, tmp_path):
    good, bad, twice = (tmp_path / x for x in ("good", "bad", "twice"))
    good.write_text('{"codigo": 1}\n{"codigo": 2}\n')
    bad.write_text('{"codigo": 1}\nnot json\n')
    twice.write_text('{"codigo": 1}\n{"codigo": 1}\n')
    assert files.state(spark, str(good), "codigo long", "codigo").count() == 2
    for path in (bad, twice):
        with pytest.raises(Exception, match="state row|repeats"):
            files.state(spark, str(path), "codigo long", "codigo").collect()


def test_snapshot_and_years(spark):
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-05"), (3, "2024-01-09")], "n int, d string").withColumn("run_date", F.to_date("d"))
    assert [r["n"] for r in files.snapshot_before(rows, "2024-01-12").collect()] == [2]
    both = files.years({2024: rows.select("n"), 2023: rows.select("d")})
    assert both.columns == ["d", "sheet_year", "n"] and both.count() == 6


def test_publish_needs_all_checks(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "n int")
    assert files.publish(rows, checks.violations({"a": rows}), str(tmp_path / "no")) == 1
    assert not (tmp_path / "no").exists()
    assert files.publish(rows, checks.violations({"a": rows.where("n > 1")}), str(tmp_path / "yes")) == 0
    assert spark.read.parquet(str(tmp_path / "yes")).count() == 1


def test_retention(spark):
    rows = spark.createDataFrame([(1, 1, True), (2, 2, False), (3, 3, False), (4, 4, False)], "id int, created int, live boolean")
    assert sorted(r["id"] for r in files.to_retain(rows, 2).collect()) == [1, 3, 4]


def test_gate_finds_what_is_wrong(spark):
    history = spark.createDataFrame([(1, 5, 3, None), (2, 1, 4, 4), (3, 1, 2, 3)], "codigo int, visto_primeira int, visto_ultima int, saida int")
    mix = spark.createDataFrame([("a", 60.0), ("a", 40.0), ("b", 99.0)], "bairro string, pct double")
    index = spark.createDataFrame([(1, 0.4), (2, 1.0)], "i int, fator double")
    found = checks.violations({"h": checks.history_order(history), "m": checks.shares_off_100(mix, ["bairro"]), "i": checks.index_bounds(index)})
    assert {r["check"]: r["n"] for r in found.collect()} == {"h": 2, "m": 1, "i": 1}
