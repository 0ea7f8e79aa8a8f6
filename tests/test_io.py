import datetime
import decimal
import json
import math
import pickle
import zipfile

import pytest
from pyspark.sql import functions as F

from quartzite.operators import clean
from quartzite.sources import io, xlsx

ROWS = [(1, "a", 1.5, True), (2, None, float("nan"), False), (3, "ü,\"b\"", None, None)]
SCHEMA = "i int, t string, x double, b boolean"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("fmt", ["json", "orc", "parquet"])
def test_tables_by_extension(spark, df, tmp_path, fmt):
    path = f"{tmp_path}/t.{fmt}"
    given = df.withColumn("x", F.nanvl("x", F.lit(None))) if fmt == "json" else df  # JSON has no NaN
    given.write.option("ignoreNullFields", "false").format(fmt).save(path)
    back = io.read_table(spark, path)
    got = {r.i: (r.t, r.x, r.b) for r in back.collect()}
    assert got == {1: ("a", 1.5, True), 2: (None, None, False), 3: ("ü,\"b\"", None, None)}  # NaN counts as missing
    assert {r.i for r in io.read_table(spark, None, fmt, default=path).collect()} == {1, 2, 3}


def test_csv_round_trip(spark, df, tmp_path):
    io.write_csv(df.select("i", "t"), f"{tmp_path}/out.csv", one_file=True)
    assert len(list((tmp_path / "out.csv").glob("part-*.csv"))) == 1
    back = io.read_table(spark, f"{tmp_path}/out.csv")
    assert dict(back.dtypes) == {"i": "bigint", "t": "string"}
    assert sorted((r.i, r.t) for r in back.filter("t is not null").collect()) == [(1, "a"), (3, "ü,\"b\"")]


def test_csv_by_schema(spark, df, tmp_path):
    df.select("i", "t", "x").write.csv(f"{tmp_path}/s.csv", header=True)
    back = io.read_csv(spark, f"{tmp_path}/s.csv", multi_line=False, schema="x double, i long, t int")
    assert sorted(tuple(r) for r in back.select("i", "t").collect()) == [(1, None), (2, None), (3, None)]
    assert dict(back.dtypes) == {"x": "double", "i": "bigint", "t": "int"}


def test_csv_is_split_where_it_can_be(spark, tmp_path):
    """A scan finds files whose values hold line breaks; all others are read in splits."""
    (tmp_path / "plain.csv").write_text("i,t\n" + "".join(f'{i},"a ""{i}"", b"\n' for i in range(40_000)))
    (tmp_path / "broken.csv").write_text('i,t\n1,"a\nb"\n2,"c ""\n""d"\n3,plain\n')
    assert not io.breaks_lines(spark, f"{tmp_path}/plain.csv") and io.breaks_lines(spark, f"{tmp_path}/broken.csv")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        plain = io.read_csv(spark, f"{tmp_path}/plain.csv")
        assert plain.rdd.getNumPartitions() > 4
        assert plain.agg(F.count("*"), F.sum("i"), F.count_if(F.col("t") == F.concat(F.lit('a "'), F.col("i").cast("string"), F.lit('", b')))).first()[:] == (40_000, sum(range(40_000)), 40_000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in io.read_csv(spark, f"{tmp_path}/broken.csv").orderBy("i").collect()] == [(1, "a\nb"), (2, 'c "\n"d'), (3, "plain")]


def test_no_path(spark):
    with pytest.raises(ValueError, match="no path"):
        io.read_table(spark, None)


def test_sheet_limit(df, tmp_path):
    with pytest.raises(ValueError, match="at most"):
        io.write_excel(df, f"{tmp_path}/a.xlsx", max_rows=2)


def test_sheet_limit_leaves_no_file(df, tmp_path):
    with pytest.raises(ValueError, match="at most"):
        io.write_excel(df, f"{tmp_path}/b.xlsx", max_rows=2)
    assert not list(tmp_path.iterdir())


def test_sheet_round_trip(spark, tmp_path):
    day, moment = datetime.date(2024, 2, 29), datetime.datetime(1999, 12, 31, 23, 59, 58, 250000)
    texts = ["a", "  <b> & 'c' \"d\" ", "_x0041_ é漢\U0001f600", "line\nbreak\ttab", "\x01\r\ufffe", "=1+1", "0012", "x" * 32_767]
    rows = [(i, t, i / 3, i % 2 == 0, day, moment, decimal.Decimal(f"{i}.25"), [i]) for i, t in enumerate(texts)] + [(None,) * 8, (9, "NA", math.nan, None, None, None, None, None)]
    schema = "`i d` long, t string, x double, b boolean, d date, `m<o>` timestamp, n decimal(10,2), a array<int>"
    io.write_excel(spark.createDataFrame(rows, schema).coalesce(1), f"{tmp_path}/a.xlsx", sheet="A&B")
    back = io.read_table(spark, f"{tmp_path}/a.xlsx")
    assert dict(back.dtypes) == {"i d": "bigint", "t": "string", "x": "double", "b": "boolean", "d": "timestamp", "m<o>": "timestamp", "n": "double", "a": "string"}
    for r, (i, t, x, b, d, m, n, a) in zip(back.collect(), rows, strict=True):
        assert (r["i d"], r.t, r.b, r["m<o>"]) == (i, None if t == "NA" else t, b, m)
        assert r.x == (None if x is None or math.isnan(x) else x) and r.n == (None if n is None else float(n)) and r.a == (None if a is None else f"[{i}]")
        assert r.d == (None if d is None else datetime.datetime(2024, 2, 29))
    with pytest.raises(Exception, match="32767"):
        io.write_excel(spark.createDataFrame([("x" * 32_768,)], "t string"), f"{tmp_path}/c.xlsx")
    io.write_excel(spark.createDataFrame([], "a int, b string"), f"{tmp_path}/none.xlsx")
    assert io.read_excel(spark, f"{tmp_path}/none.xlsx").columns == ["a", "b"] and io.read_excel(spark, f"{tmp_path}/none.xlsx").count() == 0


def book(path, sheet, shared=(), formats="", styles=("0",), late=False, second="<sheetData/>"):
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><workbookPr date1904="{int(late)}"/><sheets><sheet name="one" sheetId="4" r:id="x9"/><sheet name="two" sheetId="1" r:id="x1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="x1" Target="worksheets/b.xml"/><Relationship Id="x9" Target="/xl/worksheets/a.xml"/></R>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts>{formats}</numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs>{"".join(f"<xf numFmtId=\"{s}\"/>" for s in styles)}</cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(f"<si>{s}</si>" for s in shared)}</sst>')
        z.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
        z.writestr("xl/worksheets/b.xml", f'<worksheet xmlns="{main}">{second}</worksheet>')


def test_sheets_of_other_writers(spark, tmp_path):
    """Shared and rich strings, gaps in rows and cells, formulas, errors, formats of days, repeated and missing names."""
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>0</v></c><c r="D1" t="s"><v>1</v></c><c r="E1" t="inlineStr"><is><t>f</t></is></c><c r="F1" t="inlineStr"><is><t>g</t></is></c></row>'
    rows = (
        '<row r="2"><c r="A2" s="1"><v>45351</v></c><c r="B2"><v>7</v></c><c r="D2" t="b"><v>1</v></c><c r="E2" t="str"><f>A()</f><v>x</v></c><c r="F2"><v>1</v></c><c r="Z2"><v>5</v></c></row>'
        '<row r="4"><c r="A4" s="2"><v>45351.5</v></c><c r="B4" s="3"><v>2.5</v></c><c r="E4" t="s"><v>2</v></c><c r="F4" t="inlineStr"><is><t>one</t></is></c></row>'
        '<row r="5"><c r="B5" t="e"><v>#N/A</v></c><c r="D5" t="b"><v>0</v></c></row>'
    )
    book(f"{tmp_path}/a.xlsx", head + rows, ("<t>k</t>", "<r><t>o</t></r><r><t>k</t></r><rPh><t>no</t></rPh>", "<t>_x0041_</t>"), '<numFmt numFmtId="170" formatCode="[Red]&quot;day&quot;0.0"/><numFmt numFmtId="171" formatCode="yyyy\\-mm"/>', ("0", "14", "171", "170"))
    got = io.read_table(spark, f"{tmp_path}/a.xlsx")
    noon = datetime.datetime(2024, 2, 29, 12)
    assert dict(got.dtypes) == {"k": "timestamp", "k.1": "double", "Unnamed: 2": "string", "ok": "boolean", "f": "string", "g": "string"}
    assert [tuple(r) for r in got.collect()] == [(noon.replace(hour=0), 7.0, None, True, "x", "1"), (None,) * 6, (noon, 2.5, None, None, "A", "one"), (None, None, None, False, None, None)]
    assert io.read_excel(spark, f"{tmp_path}/a.xlsx", sheet=1).columns == []


def test_sheets_of_a_folder(spark, tmp_path):
    cell = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    for i in range(3):
        book(f"{tmp_path}/{i}.xlsx", f"<row>{cell('n')}{cell('t')}</row><row><c><v>{i if i else 0.5}</v></c><c s='1'><v>10.25</v></c></row>", styles=("0", "22"), late=True)
    got = io.read_excel(spark, f"{tmp_path}/*.xlsx")
    assert sorted(map(tuple, got.collect())) == [(v, datetime.datetime(1904, 1, 11, 6)) for v in (0.5, 1.0, 2.0)]
    book(f"{tmp_path}/3.xlsx", f"<row>{cell('other')}</row>")
    with pytest.raises(ValueError, match="different headers"):
        io.read_excel(spark, f"{tmp_path}/*.xlsx")
    (tmp_path / "old.xls").write_bytes(xlsx.OLD_FORMAT + b"0" * 100)
    with pytest.raises(Exception, match="save it as .xlsx"):
        io.read_table(spark, f"{tmp_path}/old.xls")


@pytest.mark.parametrize(("code", "date"), [("General", False), ("0.00E+00", False), ("yyyy-mm-dd", True), ("[h]:mm", True), ('"days" 0', False), ("[$-409]d/m/yy", True), (r"0\d", False), ("#,##0_s", False), ("[Red]0", False)])
def test_formats_of_days(code, date):
    assert xlsx.is_date_format(code) is date


def test_helper_columns_are_hidden(df):
    marked = clean.issue_matrix(df.select("i", "t"), {})
    assert any(c.startswith("_") for c in marked.columns)
    assert not any(c.startswith("_") for c in io.display_columns(marked).columns)


@pytest.mark.parametrize("fmt", ["json", "pickle"])
def test_results(spark, df, tmp_path, fmt):
    path = tmp_path / f"r.{fmt}"
    io.export_results({"table": df.filter("i = 2"), 5: [1, float("inf")], "set": {"x"}}, str(path), fmt)
    got = json.loads(path.read_text(encoding="utf-8")) if fmt == "json" else pickle.loads(path.read_bytes())
    assert got == {"table": [{"i": 2, "t": None, "x": None, "b": False}], "5": [1, None], "set": ["x"]}
    with pytest.raises(ValueError, match="json or pickle"):
        io.export_results({}, str(path), "xml")
