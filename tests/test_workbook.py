"""Workbooks: what is written is read back, cells of every kind, partitions by file, and what goes wrong."""

from __future__ import annotations

import datetime
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from antibiogram.operators import validate
from antibiogram.plans import uploads
from antibiogram.sources import io, sheetrows, workbook

TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>'
BOOK = f"""<workbook xmlns="{workbook.MAIN}" xmlns:r="{workbook.LINKS}"><workbookPr{{}}/><sheets><sheet name="notes" sheetId="1" r:id="rId1"/><sheet name="samples" sheetId="2" r:id="rId7"/></sheets></workbook>"""
RELS = """<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">
<Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId7" Target="/xl/worksheets/other.xml"/></Relationships>"""
STYLES = f"""<styleSheet xmlns="{workbook.MAIN}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.0&quot;days&quot;"/><numFmt numFmtId="166" formatCode="[Red]0.00"/></numFmts>
<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="22"/><xf numFmtId="166"/></cellXfs></styleSheet>"""
SHARED = f"""<sst xmlns="{workbook.MAIN}"><si><t>sample_id</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh><t>hint</t></rPh></si><si><t xml:space="preserve"> kept </t></si><si><t/></si></sst>"""


def sheet(rows: str) -> str:
    return f'<worksheet xmlns="{workbook.MAIN}"><cols><col/></cols><sheetData>{rows}</sheetData><pageMargins/></worksheet>'


def book(path, rows: str, epoch: str = ""):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in {
            "[Content_Types].xml": TYPES, "xl/workbook.xml": BOOK.format(epoch), "xl/_rels/workbook.xml.rels": RELS, "xl/styles.xml": STYLES, "xl/sharedStrings.xml": SHARED,
            "xl/worksheets/sheet1.xml": sheet(""), "xl/worksheets/other.xml": sheet(rows),
        }.items():
            z.writestr(name, text)
    return str(path)


CELLS = """<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>b</t></is></c><c r="D1" t="str"><v>d</v></c><c r="E1" t="str"><v>b</v></c><c r="AA1" t="str"><v>far</v></c></row>
<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>15</v></c><c r="D2" t="b"><v>1</v></c><c r="E2" t="e"><v>#N/A</v></c><c r="AA2" s="1"><v>45306</v></c></row>
<row r="5"><c r="A5" t="s"><v>2</v></c><c r="B5"><v>6.6326</v></c><c r="C5" s="3"><v>2.5</v></c><c r="D5" s="4"><v>45306.75</v></c><c r="E5" s="2"><v>1</v></c></row>
<row r="6"><c r="A6" t="s"><v>3</v></c><c r="B6"><v>1.5E-3</v></c><c r="C6"><v>1E+20</v></c><c r="D6" t="b"><v>0</v></c><c r="E6" s="5"><f>1+1</f><v>2</v></c></row>
<row r="7"/><row r="8"><c r="A8"/></row>"""


def test_cells_of_every_kind(spark, tmp_path):
    path = book(tmp_path / "made.xlsx", CELLS)
    assert workbook.sheet_names(path) == ["notes", "samples"]
    df = workbook.read_sheet(spark, path, "samples")
    assert df.columns[:5] == ["sample_id", "b", "Unnamed: 2", "d", "b.1"] and df.columns[-2:] == ["far", "row_no"]
    got = {r.row_no: (r[0], r[1], r[2], r[3], r[4], r["far"]) for r in df.collect()}
    assert got == {
        2: ("two runs", "15", None, "True", None, "2024-01-15"), 3: (None,) * 6, 4: (None,) * 6,
        5: (" kept ", "6.6326", "2.5", "2024-01-15 18:00:00", "1899-12-31", None), 6: (None, "0.0015", "1e+20", "False", "2", None),
    }
    assert workbook.read_sheet(spark, book(tmp_path / "mac.xlsx", CELLS, ' date1904="1"'), "samples").where("row_no = 2").first()["far"] == "2028-01-16"


def test_a_partition_a_file_and_columns_by_header(spark, tmp_path):
    head = lambda *names: '<row r="1">' + "".join(f'<c t="str"><v>{n}</v></c>' for n in names) + "</row>"
    row = lambda *cells: "<row>" + "".join(f'<c t="str"><v>{c}</v></c>' for c in cells) + "</row>"
    book(tmp_path / "a.xlsx", head("x", "y") + row(1, 2))
    book(tmp_path / "b.xlsx", head("y", "z", "x") + row(3, 4, 5) + row(6))
    book(tmp_path / "c.xlsx", head("y"))
    (tmp_path / "~lock.xlsx").write_text("not a workbook")
    df = workbook.read_sheet(spark, str(tmp_path), "samples")
    assert sorted(map(str, map(tuple, df.collect()))) == ["('1', '2', 2)", "('5', '3', 2)", "(None, '6', 3)"] and df.rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="no sheet 'nothing'"):
        workbook.read_sheet(spark, str(tmp_path), "nothing")
    with pytest.raises(Exception, match="no workbook"):
        workbook.read_sheet(spark, str(tmp_path / "a.xlsx").replace("a.xlsx", ""), "samples").sparkSession.read.format("workbook").load(str(tmp_path.parent / tmp_path.name / ".."))
    assert workbook.read_sheet(spark, str(tmp_path / "a.xlsx"), "notes").columns == ["row_no"]


def test_upload_equals_its_csv_sheets(spark, sf_dir, tmp_path):
    """Both sheets of an upload, as workbooks and as CSV, give the same rows and the same findings."""
    sheets = {"samples": uploads.samples(spark, sf_dir), "ast_results": uploads.tests(spark, sf_dir)}
    workbook.write_workbooks(sheets, str(tmp_path / "book"), order="row_no")
    back = io.read_workbook(spark, str(tmp_path / "book"))
    for name, df in sheets.items():
        nth = df.orderBy("row_no").toPandas().drop(columns="row_no")
        nth["row_no"] = range(2, len(nth) + 2)
        csv = str(tmp_path / f"{name}.csv")
        nth.to_csv(csv, index=False)
        same = spark.read.csv(csv, header=True, quote='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue=None).withColumn("row_no", F.col("row_no").cast("long"))
        assert back[name].columns == same.columns
        assert back[name].exceptAll(same).isEmpty() and back[name].count() == same.count() == df.count()
        sheets[name] = same
    found = [sorted(map(str, validate.validate(spark, x["samples"], x["ast_results"]).collect())) for x in (back, sheets)]
    assert found[0] == found[1] and len(found[0]) > 10


def test_written_kinds_and_files(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [("one", "a<&>\"'\n\x01é", 1.5, 7, True, datetime.date(2024, 2, 29)), ("two", " x ", None, None, None, None), ("two", "", float("nan"), -(10**12), False, datetime.date(1999, 1, 1))]
    df = spark.createDataFrame(rows, "f string, text string, d double, n long, b boolean, day date").withColumn("k", F.monotonically_increasing_id())
    other = spark.createDataFrame([("two", "z")], "f string, only string").withColumn("k", F.lit(0))
    for _ in range(2):  # a second write replaces the first
        workbook.write_workbooks({"first": df, "other & <more>": other}, path, "f", "k")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["one.xlsx", "two.xlsx"]
    assert workbook.sheet_names(path) == ["first", "other & <more>"]
    got = sorted(map(str, workbook.read_sheet(spark, path, "first").drop("row_no").collect()))
    assert got == sorted(map(str, spark.createDataFrame([("a<&>\"'\né", "1.5", "7", "True", "2024-02-29"), (" x ", None, None, None, None), (None, "NaN", "-1000000000000", "False", "1999-01-01")], "text string, d string, n string, b string, day string").collect()))
    assert [r.only for r in workbook.read_sheet(spark, path, "other & <more>").collect()] == ["z"]


def test_too_many_rows_are_an_error_and_leave_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "MAX_ROWS", 5)
    with pytest.raises(Exception, match="at most 5 rows"):
        workbook.write_workbooks({"s": spark.range(5)}, str(tmp_path / "big"))
    assert [p for p in (tmp_path / "big").rglob("*.xlsx")] == []
    workbook.write_workbooks({"s": spark.range(4)}, str(tmp_path / "big"))
    assert workbook.read_sheet(spark, str(tmp_path / "big"), "s").count() == 4


def test_template_is_read_back(spark, tmp_path):
    io.write_template(spark, str(tmp_path / "t"))
    back = io.read_workbook(spark, str(tmp_path / "t"))
    for sheet, df in io.template(spark).items():
        want = df.replace("", None)
        assert back[sheet].exceptAll(want).isEmpty() and want.exceptAll(back[sheet]).isEmpty() and back[sheet].columns == df.columns
    assert validate.validate(spark, back["samples"], back["ast_results"]).isEmpty()


def test_a_large_sheet_goes_on_in_further_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "MAX_ROWS", 40)
    monkeypatch.setattr(workbook, "PART_ROWS", 20)
    file = F.when(F.col("id") % 10 == 0, "few").otherwise("many").alias("f")
    big, small = spark.range(200).select(file, (F.col("id") * 3).alias("x"), F.col("id").alias("k")), spark.range(10).select(file, F.col("id").alias("y"), F.col("id").alias("k"))
    for continued in (False, True):
        if not continued:
            with pytest.raises(Exception, match="at most 40 rows"):
                workbook.write_workbooks({"big": big, "small": small}, str(tmp_path / "b"), "f", "k")
            continue
        workbook.write_workbooks({"big": big, "small": small}, str(tmp_path / "b"), "f", "k", continued)
    names = [p.name for p in (tmp_path / "b").iterdir()]
    assert len(names) >= 10 and {"few.xlsx", "many.xlsx"} < set(names) and all(n.startswith("many.after-") for n in names if n not in ("few.xlsx", "many.xlsx"))
    rows = workbook.read_sheet(spark, str(tmp_path / "b"), "big").select(F.col("x").cast("int"), "row_no").collect()
    many = sorted((r.x, r.row_no) for r in rows if r.x % 30)
    assert many == [(3 * i, k) for k, i in enumerate((i for i in range(200) if i % 10), 2)]
    assert sorted((r.x, r.row_no) for r in rows if r.x % 30 == 0) == [(30 * i, i + 2) for i in range(20)]
    assert sorted((int(r.y), r.row_no) for r in workbook.read_sheet(spark, str(tmp_path / "b"), "small").collect()) == [(0, 2), *[(i, i + 1) for i in range(1, 10)]]


def by_parser(path: str, columns: list[str]) -> list[tuple]:
    """What the reader gives, from an XML parser alone and row by row."""
    with workbook.Book(path, path) as b:
        at = {name: k for k, name in enumerate(b.header("samples"))}
        out, last = [], 1
        for nth, cells in b.rows("samples"):
            if nth == 1 or all(c is None for c in cells):
                continue
            out += [(*[None] * len(columns), gap) for gap in range(last + 1, nth)]
            out.append((*[cells[at[c]] if at[c] < len(cells) else None for c in columns], nth))
            last = nth
    return out


def by_reader(path: str, columns: list[str]) -> list[tuple]:
    batches = list(workbook.WorkbookReader(path, "samples", [*columns, "row_no"]).read(workbook.SheetOfFile(path)))
    return [tuple(r.values()) for b in batches for r in b.to_pylist()]


HEAD = '<row r="1">' + "".join(f'<c r="{k}1" t="str"><v>{c}</v></c>' for k, c in zip("ABCDEF", "abcdef", strict=True)) + "</row>"
PLAIN = ['<c t="inlineStr"><is><t>x{}</t></is></c>', '<c t="inlineStr"><is><t xml:space="preserve"> y </t></is></c>', "<c><v>{}.50</v></c>", "<c/>", '<c s="1"><v>4530{}</v></c>', '<c t="s"><v>1</v></c>',
         '<c t="b"><v>1</v></c>', '<c t="str"><v>é&amp;&#65;</v></c>', '<c t="e"><v>#N/A</v></c>', "<c></c>", '<c t="s"><v>3</v></c>', "<c><v></v></c>", '<c t="str"><v>a\nb</v></c>', '<c s="4"><v>45306.75</v></c>']
OTHER = ['<c t="inlineStr"><is><r><t>rich</t></r><r><t> text</t></r><rPh><t>no</t></rPh></is></c>', "<c><f>1+1</f><v>2</v></c>", '<c t="str"><v><![CDATA[<row r="3"></row>]]></v></c>', '<c t="str"><v>a > b</v></c>',
         "<c t='str'><v>q</v></c>", "<c><v>1</v><extLst/></c>", "<c t=\"inlineStr\"><v>z</v></c>", '<c t="str"><v>c\r\nd</v></c>', '<!-- <row r="4"><c><v>4</v></c></row> --><c><v>5</v></c>', "<c><v/></c>"]
BETWEEN = ["", "\n", '<row r="{}"/>', "<!-- </row> -->", "<row r='{}'></row>"]


def random_rows(rng, cells: list[str], between: list[str], referenced: bool, numbered: bool) -> str:
    head = HEAD if referenced else re.sub(' r="[A-F]1"', "", HEAD)
    out, nth = [head if numbered else head.replace(' r="1"', "")], 1
    for k in range(60):
        nth += rng.choice([1, 1, 1, 2, 5]) if numbered else 1
        texts = []
        for c, letter in zip(range(rng.randrange(9)), "ABCDEFGHI", strict=False):
            if not referenced or rng.random() < 0.7:
                cell = rng.choice(cells).replace("{}", str(rng.randrange(10)))
                texts.append(cell.replace("<c", f'<c r="{letter}{nth}"', 1) if referenced and cell.startswith("<c") else cell)
        number = rng.choice([f' r="{nth}"', f' spans="1:6" r="{nth}" ht="1.5"']) if numbered else ""
        out.append(f"<row{number}>{''.join(texts)}</row>")
        filler = rng.choice(between)
        if "row r" not in filler or numbered:
            nth += "{}" in filler
            out.append(filler.replace("{}", str(nth)))
    return "".join(out)


@pytest.mark.parametrize("other", [False, True])
def test_rows_in_pieces_are_those_of_the_parser(tmp_path, monkeypatch, other):
    """Rows taken many at a time from the XML, whatever it holds and wherever it is cut, are those of an XML parser."""
    rng = random.Random(7)
    taken = []
    plain = sheetrows.plain
    monkeypatch.setattr(sheetrows, "plain", lambda *a: taken.append(plain(*a)) or taken[-1])
    for k in range(60):
        monkeypatch.setattr(workbook, "CHUNK", rng.choice([40, 300, 1000, 5000, 1 << 20]))
        rare = [rng.choice(OTHER)] if other else []
        rows = random_rows(rng, PLAIN * 4 + rare, BETWEEN if other else BETWEEN[:3], referenced=k % 2 == 0, numbered=k % 3 > 0)
        path = book(tmp_path / f"{k}.xlsx", rows)
        want = by_parser(path, list("fabcd"))
        assert by_reader(path, list("fabcd")) == want and len(want) > 40
    if not other:
        assert len(taken) > 60 and None not in taken  # all of it was taken as plain rows


def test_broken_sheets_are_errors(tmp_path):
    for k, rows in enumerate(["<row><c><v>1</v></row>", "<row><c><v>1</c></v></row>", "<row><c><v>&none;</v></c></row>", '<row><c t="s"><v>99</v></c></row>', "<row><c><v>x</v></c></row>", "<row><c><v>\x01</v></c></row>", "<row><c></row>", "<row>"]):
        path = book(tmp_path / f"{k}.xlsx", HEAD + rows)
        with pytest.raises((SyntaxError, ValueError, IndexError)):
            by_reader(path, ["a"])


def test_written_rows_are_taken_many_at_a_time(spark, tmp_path, monkeypatch):
    """A written sheet is put into XML and read back in batches; no row but the header passes an XML parser."""
    path = str(tmp_path / "many")
    df = spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit(" a & b "), F.col("id")).alias("x"), F.col("id").cast("double").alias("y"), F.expr("date_add(date'2024-01-01', int(id % 9))").alias("z"))
    workbook.write_workbooks({"samples": df}, path, order="k")
    parsed = []
    cell = workbook.Book.cell
    monkeypatch.setattr(workbook.Book, "cell", lambda *a: parsed.append(a) or cell(*a))
    file = f"{path}/workbook.xlsx"
    batches = list(workbook.WorkbookReader(path, "samples", ["x", "y", "z", "row_no"]).read(workbook.SheetOfFile(file)))
    assert len(batches) < 5 and len(parsed) == 3  # the header's cells
    got = [r for b in batches for r in b.to_pylist()]
    day = datetime.date(2024, 1, 1)
    assert got == [{"x": f" a & b {i}", "y": str(i), "z": str(day + datetime.timedelta(i % 9)), "row_no": i + 2} for i in range(3000)]
    with zipfile.ZipFile(file) as z:
        assert z.read("xl/worksheets/sheet1.xml").count(b"<row>") == 3001


def test_cells_with_the_character_between_them(spark, tmp_path):
    """A cell may hold what rows to be written have between their cells; a sheet may have no column at all."""
    df = spark.createDataFrame([(1, f"a{workbook.BETWEEN}b", None), (2, workbook.BETWEEN, ""), (3, None, "c")], "k int, x string, y string")
    workbook.write_workbooks({"s": df, "none": df.select("k")}, str(tmp_path / "b"), order="k")
    assert sorted(map(tuple, workbook.read_sheet(spark, str(tmp_path / "b"), "s").collect()), key=str) == [("ab", None, 2), (None, "c", 4), (None, None, 3)]
    assert workbook.read_sheet(spark, str(tmp_path / "b"), "none").count() == 0
