import zipfile

import pytest

from tablewarden.operators import checks
from tablewarden.plans import pipeline, remediation, report
from tablewarden.sources import files


def put(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_header_rows():
    rows = lambda widths: [["x"] * w for w in widths]
    assert [files.header_row(rows(w)) for w in ([1, 0, 4, 4, 4, 4], [2, 4, 4, 4], [3, 4, 4, 4], [1, 2, 2], [1, 4, 4])] == [2, 1, 0, 0, 0]
    assert files.mangled(["a", "", "a", None, "a"]) == ["a", "Unnamed: 1", "a.1", "Unnamed: 3", "a.2"]


def test_preamble_and_ragged_rows(spark, tmp_path):
    t = files.load_dataset(spark, put(tmp_path / "a.csv", "Report of June,,\n\nName,GST,City\nA,1,Goa\nB,2,Agra\n"))
    assert t.names == ["Name", "GST", "City"] and t.skipped_rows == 2 and t.df.count() == 2 and t.ragged_rows == 0
    t = files.load_dataset(spark, put(tmp_path / "b.csv", 'a,b,c\n1,2,3\n\n4,5\n"x\ny",N/A,6\n'))
    assert (t.ragged_rows, t.data_records) == (2, 4)
    assert [tuple(r)[1:] for r in t.df.orderBy("_row_id").collect()] == [("1", "2", "3"), ("4", "5", None), ("x\ny", None, "6")]
    from tablewarden.operators.profile import prepare

    assert [i.kind for i in checks.structure(prepare(t)).issues] == ["ragged_rows"]


def test_encodings_and_failures(spark, tmp_path):
    t = files.load_dataset(spark, put(tmp_path / "c.csv", "Name,City\nJosé,Orléans\nZoë,Genève\n".encode("cp1252")))
    assert "UTF-8" in t.encoding_warning and t.df.where("c0 = 'José'").count() == 1
    for data, words in ((b"", "empty"), ("a,b,c\n", "no data"), ("a,b\n1,2\n1,2,3\n", "fields")):
        (_, table, error), = files.load_all_tables(spark, put(tmp_path / "d.csv", data))
        assert table is None and words in error
    with pytest.raises(ValueError):
        files.load_dataset(spark, put(tmp_path / "e.txt", "x"))
    assert files.load_all_tables(spark, put(tmp_path / "f.xlsx", b"no zip"))[0][2].startswith("This table couldn't be read")


def workbook(path, sheets):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {main} {rel}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            body = "".join("<row>" + "".join(f'<c r="{chr(65 + k)}{j + 1}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + k)}{j + 1}"><v>{v}</v></c>' for k, v in enumerate(r) if v is not None) + "</row>" for j, r in enumerate(rows))
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
    return str(path)


def test_workbook_and_batch(spark, tmp_path):
    rows = [["Business_Name", "City", "Annual_Revenue"], ["Alpha Steel", "Pune", 100], ["Beta Foods", "Goa", None], ["Gamma", "Goa", 300]]
    path = workbook(tmp_path / "book.xlsx", {"Vendors": rows, "Draft_Notes": [], "Title": [["Some title"], [None], *rows]})
    got = files.load_all_tables(spark, path)
    assert [(n, t is not None) for n, t, _ in got] == [("book.xlsx -> Vendors", True), ("book.xlsx -> Draft_Notes", False), ("book.xlsx -> Title", True)]
    assert got[2][1].skipped_rows == 2 and got[0][1].df.where("c2 IS NULL").count() == 1
    out = pipeline.score_all(spark, [path, put(tmp_path / "x.csv", "")])
    assert len(out.results) == 2 and len(out.failures) == 2 and sum(out.severities().values()) == len(out.findings) and 0 < out.overall <= 100
    assert "Draft_Notes" in report.html_report(out)


def test_cleaned_csv_reads_back(spark, tmp_path):
    path = put(tmp_path / "k.csv", 'Business_Name,Annual_Revenue,Notes\nKrishna,"12,50,000","say ""hi"", ok"\nKrishna,"12,50,000","say ""hi"", ok"\nAlpha , 600,\n')
    result = pipeline.score_table(files.load_dataset(spark, path))
    cleaned = remediation.remediate(result.table, result.findings, result.duplication)
    report.write_csv(cleaned, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect()), key=str) == [("Alpha", "600", None), ("Krishna", "1250000", 'say "hi", ok')]
    assert report.file_stub("a b -> c!") == "a_b_-_c" and files.directory(spark, 50).count() == 50


def test_days_of_a_workbook(tmp_path, spark):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    path = tmp_path / "days.xlsx"
    styles = f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="164" formatCode="[$-409]d\\ mmm yyyy"/><numFmt numFmtId="165" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'
    row = lambda r, cells: f'<row r="{r}">' + "".join(f'<c r="{c}{r}" s="{s}"{t}><v>{v}</v></c>' for c, s, t, v in cells) + "</row>"
    head = '<row r="1">' + "".join(f'<c r="{c}1" t="inlineStr"><is><t>{n}</t></is></c>' for c, n in zip("ABCD", ("Name", "Start", "End", "Size"))) + "</row>"
    rows = [row(i, [("A", 0, "", i), ("B", 1, "", 43845 + i), ("C", 2, "", 43845.5), ("D", 3, "", 43845)]) for i in (2, 3, 4)]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", styles)
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{head}{"".join(rows)}</sheetData></worksheet>')
    t = files.load_dataset(spark, str(path))
    first = t.df.orderBy("_row_id").first()
    assert (first.c1, first.c2, first.c3) == ("2020-01-17 00:00:00", "2020-01-15 12:00:00", "43845")
    with pytest.raises(ValueError, match="xls"):
        files.load_dataset(spark, put(tmp_path / "old.xls", b"x"))
