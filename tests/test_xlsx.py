"""The spreadsheet data source: partitions by sheet, predicates, memory."""

import io
import tracemalloc
import zipfile

from terrafolio.sources import files, xlsx

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(path, sheets, shared=()):
    """A workbook of inline and shared texts; ``sheets`` is name -> rows of column -> text, a number for a shared one."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        links = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{links}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="{"/xl/" if i % 2 else ""}worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><r><t>{t[:1]}</t></r><r><t>{t[1:]}</t></r></si>" for t in shared) + "</sst>")
        for i, name in enumerate(names, 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                out.write(f"<worksheet {NS}><sheetData>".encode())
                for r, cells in enumerate(sheets[name], 1):
                    row = "".join(f'<c r="{c}{r}" t="s"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in cells.items())
                    out.write(f'<row r="{r}">{row}</row>'.encode())
                out.write(b"</sheetData></worksheet>")


def test_two_workbooks_a_partition_a_sheet(spark, tmp_path):
    book(tmp_path / "a.xlsx", {"JAN-2026": [{"A": "x", "C": 0}, {}, {"B": 1}], "FEV-2026": [{"A": "y"}], "Notes": []}, ["first", "second"])
    book(tmp_path / "b.xlsx", {"JAN-2026": [{"AA": "z"}]})
    (tmp_path / "c.txt").write_text("no book")
    for path in (str(tmp_path), f"file://{tmp_path}"):
        df = xlsx.sheets(spark, path)
        assert df.rdd.getNumPartitions() == 4
        found = sorted((r["file"][-6:], r["sheet"], r["row_num"], dict(r["cells"])) for r in df.collect())
        assert found == [("a.xlsx", "FEV-2026", 1, {"A": "y"}), ("a.xlsx", "JAN-2026", 1, {"A": "x", "C": "first"}), ("a.xlsx", "JAN-2026", 2, {}), ("a.xlsx", "JAN-2026", 3, {"B": "second"}), ("b.xlsx", "JAN-2026", 1, {"AA": "z"})]
    one = xlsx.sheets(spark, str(tmp_path)).where("sheet = 'FEV-2026'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 1
    assert xlsx.sheets(spark, str(tmp_path), "[A-Z]{3}-2026").where("row_num = 3 and sheet in ('JAN-2026', 'no')").count() == 1
    assert xlsx.sheets(spark, str(tmp_path), "no such").count() == 0
    old = files.spreadsheets(spark, str(tmp_path / "*.xlsx"), "[A-Z]{3}-2026")
    assert sorted((r["sheet"], r["row_num"], tuple(sorted(r["cells"].items()))) for r in old.collect()) == sorted((s, n, tuple(sorted(c.items()))) for _, s, n, c in found)


def test_memory_does_not_grow_with_the_sheet():
    peaks = []
    for n in (2_000, 40_000):
        held = io.BytesIO()
        book(held, {"S": ({"A": "text", "B": "more"} for _ in range(n))})
        with zipfile.ZipFile(held) as z:
            tracemalloc.start()
            assert sum(1 for _ in xlsx.sheet_rows(z, "xl/worksheets/sheet1.xml", [])) == n
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]
