"""Workbooks written by hand, read as cells, and the answers that maps find in them."""

import zipfile

from cairnwork.sources import workbooks as W

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def write_book(path, sheets):
    """``sheets``: (name, hidden, {cell: text or number or bool})."""
    shared, parts = [], {}
    for i, (_, _, cells) in enumerate(sheets):
        xml = ""
        for ref, value in cells.items():
            if isinstance(value, bool):
                xml += f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
            elif isinstance(value, str) and value.startswith("inline:"):
                xml += f'<c r="{ref}" t="inlineStr"><is><t>{value[7:]}</t></is></c>'
            elif isinstance(value, str):
                shared.append(value)
                xml += f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
            elif value is None:
                xml += f'<c r="{ref}"/>'
            else:
                xml += f'<c r="{ref}"><v>{value}</v></c>'
        parts[f"xl/worksheets/sheet{i + 1}.xml"] = f"<worksheet {NS}><sheetData><row>{xml}</row></sheetData></worksheet>"
    names = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i + 1}"{" state=" + chr(34) + "hidden" + chr(34) if h else ""}/>' for i, (n, h, _) in enumerate(sheets))
    parts["xl/workbook.xml"] = f"<workbook {NS}><sheets>{names}</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets))) + "</Relationships>"
    parts["xl/sharedStrings.xml"] = f"<sst {NS}>" + "".join(f"<si><r><t>{t[:1]}</t></r><r><t>{t[1:]}</t></r></si>" for t in shared) + "</sst>"
    with zipfile.ZipFile(path, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)


def test_workbooks(spark, tmp_path):
    write_book(tmp_path / "a.xlsx", [
        ("Answers", False, {"A1": "C.101", "C1": 1200, "A2": "C.102", "C2": " ", "A3": "C.103", "C3": "inline:yes", "D4": True, "E5": None}),
        ("Map", True, {"A1": "field", "B1": "sheet", "C1": "cell", "A2": "X.1", "B2": "Answers", "C2": "$C$1", "A3": "X.2", "B3": "Answers", "C3": "d4", "A4": "X.3", "B4": "Answers", "C4": "Z9"}),
    ])
    write_book(tmp_path / "b.xlsx", [("Vars", False, {"A1": "varName", "B1": "Title", "A2": "ADM", "B2": "Admitted", "A3": "APP"})])
    cells = W.workbook_cells(spark, f"{tmp_path}/*.xlsx")
    assert {(r.sheet, r.cell): r.value for r in cells.where("sheet = 'Answers'").collect()} == {("Answers", "A1"): "C.101", ("Answers", "C1"): "1200", ("Answers", "A2"): "C.102", ("Answers", "C2"): " ", ("Answers", "A3"): "C.103", ("Answers", "C3"): "yes", ("Answers", "D4"): "TRUE"}
    assert {r.sheet for r in cells.where("hidden").collect()} == {"Map"}
    found, counts = W.answers(cells.where("sheet <> 'Vars'"), W.own_cell_map(cells, "Map"))
    assert {(r.field, r.value) for r in found.collect()} == {("X.1", "1200"), ("X.2", "TRUE")}
    assert {(r.asked, r.filled, r.blank) for r in counts.collect()} == {(3, 2, 1)}
    assert {(r.field, r.value) for r in W.column_layout(cells, "Answers").collect()} == {("C.101", "1200"), ("C.103", "yes")}
    table = {(r.row, r.name, r.title) for r in W.sheet_table(cells, "vars", {"name": "VARNAME", "title": "title"}).collect()}
    assert table == {(2, "ADM", "Admitted"), (3, "APP", None)}
    fixed = spark.createDataFrame([("F.1", "Answers", "C3"), ("F.2", "Answers", "C2")], "field string, sheet string, cell string")
    one, count = W.answers(cells.where("sheet = 'Answers'"), fixed)
    assert [(r.field, r.value) for r in one.collect()] == [("F.1", "yes")] and [(r.asked, r.blank) for r in count.collect()] == [(2, 1)]
