"""Spreadsheets (.xlsx) without a package for them: a zip of XML parts, read and written as streams.

Reading: files come as bytes from the ``binaryFile`` source, so any store that Spark reads will do and each file is a task's work. A task goes
through the rows of the first sheet one by one. A first pass finds the header and the kinds of values of each column, a second gives the rows.

Writing: rows become XML by column expressions on the executors; the driver copies them into the zip, a partition at a time.
"""

from __future__ import annotations

import datetime
import io
import os
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format: namespaces, built-in numbers of date formats, first day, largest sheet and text.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {*range(14, 23), 27, 30, 36, *range(45, 48), 50, 57}
EPOCH, EPOCH_1904 = datetime.datetime(1899, 12, 30), datetime.datetime(1904, 1, 1)
MAX_ROWS, MAX_TEXT = 1_048_576, 32_767
OLD_FORMAT = b"\xd0\xcf\x11\xe0"

_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")


def _unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def _text(node) -> str:
    """The text of a string item, runs put together, readings left out."""
    parts = [t.text or "" for t in node.findall(f"{MAIN}t")] + [t.text or "" for r in node.findall(f"{MAIN}r") for t in r.findall(f"{MAIN}t")]
    return _unescaped("".join(parts))


def _elements(book: zipfile.ZipFile, part: str, tag: str) -> Iterator:
    """The elements of a name, one by one, each dropped when it is done with."""
    if part not in book.namelist():
        return
    with book.open(part) as f:
        steps = ElementTree.iterparse(f, ("start", "end"))
        _, root = next(steps)
        above = [root]
        for event, node in steps:
            if event == "start":
                above.append(node)
                continue
            above.pop()
            if node.tag == f"{MAIN}{tag}":
                yield node
                above[-1].remove(node)


def is_date_format(code: str) -> bool:
    """Whether a number format shows days or times: letters of dates outside quotes, brackets and escapes."""
    return bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[(?!h+\]|m+\]|s+\])[^\]]*\]|\\.|_.|General', "", code, flags=re.I), re.I))


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles whose format is a date's."""
    custom = {int(n.get("numFmtId")): n.get("formatCode", "") for n in _elements(book, "xl/styles.xml", "numFmt")}
    out = set()
    for group in _elements(book, "xl/styles.xml", "cellXfs"):
        for i, style in enumerate(group.findall(f"{MAIN}xf")):
            number = int(style.get("numFmtId", 0))
            if is_date_format(custom[number]) if number in custom else number in DATE_FORMATS:
                out.add(i)
    return out


def _sheet_part(book: zipfile.ZipFile, sheet: int) -> tuple[str, bool]:
    """The part of a sheet by its place, and whether days are counted from 1904."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    link = root.find(f"{MAIN}sheets").findall(f"{MAIN}sheet")[sheet].get(LINK)
    target = next(r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")) if r.get("Id") == link)
    properties = root.find(f"{MAIN}workbookPr")
    late = properties is not None and properties.get("date1904", "0") in ("1", "true")
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}"), late


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def day_of(serial: float, late: bool = False) -> datetime.datetime:
    """The day and time of a serial number, to the millisecond."""
    return (EPOCH_1904 if late else EPOCH) + datetime.timedelta(milliseconds=round(serial * 86_400_000))


def sheet_rows(content: bytes, sheet: int = 0) -> Iterator[list[tuple[str, str] | None]]:
    """The rows of a sheet: per cell its kind (int, float, bool, date, text) and its value as text, or None if it is empty or an error.

    Rows that the file leaves out are empty lists, but for those after the last.
    """
    if content[:4] == OLD_FORMAT:
        raise ValueError("a binary .xls file; save it as .xlsx")
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = [_text(n) for n in _elements(book, "xl/sharedStrings.xml", "si")]
        dates = _date_styles(book)
        part, late = _sheet_part(book, sheet)

        def cell(node) -> tuple[str, str] | None:
            kind, value = node.get("t", "n"), node.find(f"{MAIN}v")
            if kind == "inlineStr":
                text = node.find(f"{MAIN}is")
                return None if text is None else ("text", _text(text))
            if value is None or value.text is None or kind == "e":
                return None
            if kind == "s":
                return "text", shared[int(value.text)]
            if kind == "str":
                return "text", _unescaped(value.text)
            if kind == "b":
                return "bool", "true" if value.text.strip() in ("1", "true") else "false"
            if kind == "d":
                return "date", value.text.replace("T", " ")
            number = float(value.text)
            if int(node.get("s", 0)) in dates:
                return "date", day_of(number, late).isoformat(" ")
            return ("int", str(int(number))) if number.is_integer() and abs(number) < 2**63 else ("float", repr(number))

        at = 0
        for row in _elements(book, part, "row"):
            place = int(row.get("r", at + 1))
            yield from ([] for _ in range(place - at - 1))
            at, cells = place, []
            for node in row.findall(f"{MAIN}c"):
                i = _column(node.get("r")) if node.get("r") else len(cells)
                cells += [None] * (i - len(cells)) + [cell(node)]
            yield cells


#: The kind of a column whose values are of two kinds; any other two are text.
_BOTH = {frozenset(("int", "float")): "float"}
KINDS = {"int": "bigint", "float": "double", "bool": "boolean", "date": "timestamp", "text": "string"}


def joined_kind(a: str | None, b: str | None) -> str | None:
    return a if a == b or b is None else b if a is None else _BOTH.get(frozenset((a, b)), "text")


def _described(content: bytes, sheet: int, na: frozenset) -> tuple[list[str], list[str | None]]:
    """The header's names and each column's kind."""
    rows = sheet_rows(content, sheet)
    names = [c[1] if c and c[1] != "" else f"Unnamed: {i}" for i, c in enumerate(next(rows, []))]
    kinds: list[str | None] = [None] * len(names)
    for row in rows:
        for i, c in enumerate(row[: len(names)]):
            if c is not None and not (c[0] == "text" and c[1] in na):
                kinds[i] = joined_kind(kinds[i], c[0])
    return names, kinds


def _unique(names: list[str]) -> list[str]:
    """Repeated names get a number, as ``a``, ``a.1``."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, -1) + 1
        out.append(f"{n}.{seen[n]}" if seen[n] else n)
    return out


def read_xlsx(spark: SparkSession, path: str, sheet: int = 0, na: tuple[str, ...] = ()) -> DataFrame:
    """The first sheet of each file of ``path`` (a file, a folder or a pattern): a header row, then rows in any number.

    A column is bigint, double, boolean, timestamp or string by all of its values; whole numbers and others make double, any other mix
    string. Texts of ``na`` and errors are null. Files must have the same header.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    missing = frozenset(na)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_described(c.as_buffer().to_pybytes(), sheet, missing) for c in batch.column(1)]
            names, kinds = [f[0] for f in found], [f[1] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.list_(pa.string())), pa.array(kinds, pa.list_(pa.string()))], names=["path", "names", "kinds"])

    found = files.mapInArrow(describe, "path string, names array<string>, kinds array<string>").groupBy("names", "kinds").agg(F.min("path").alias("path")).collect()  # kinds of sheets, not files
    if not found:
        raise ValueError(f"no file at {path}")
    names = found[0].names
    if other := next((r.path for r in found if r.names != names), None):
        raise ValueError(f"{found[0].path} and {other} have different headers")
    kinds: list[str | None] = [None] * len(names)
    for r in found:
        kinds = [joined_kind(a, b) for a, b in zip(kinds, r.kinds, strict=True)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(names)

        def batch_of(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], names=["values"])

        for batch in batches:
            for content in batch.column(1):
                out = []
                sheet_ = sheet_rows(content.as_buffer().to_pybytes(), sheet)
                next(sheet_, None)
                for row in sheet_:
                    values = [None if c is None or (c[0] == "text" and c[1] in missing) else c[1] for c in row[:width]]
                    out.append(values + [None] * (width - len(values)))
                    if len(out) == 2048:
                        yield batch_of(out)
                        out = []
                if out:
                    yield batch_of(out)

    table = files.mapInArrow(rows, "values array<string>")
    return table.select(*[F.get("values", F.lit(i)).cast(KINDS[k or "text"]).alias(n) for i, (n, k) in enumerate(zip(_unique(names), kinds, strict=True))])


def _escaped(c: Column) -> Column:
    """XML of a text; characters that XML can't hold are written as _xHHHH_, and texts that look like that with their underscore escaped."""
    out = F.regexp_replace(c, "_(?=x[0-9A-Fa-f]{4}_)", "_x005F_")
    for code in (*range(0, 9), 11, 12, *range(14, 32), 13, 0xFFFE, 0xFFFF):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"_x{code:04X}_"))
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def _cell(c: Column, kind: T.DataType) -> Column:
    wrap = lambda before, v, after="</v></c>": F.concat(F.lit(before), v, F.lit(after))
    if isinstance(kind, T.BooleanType):
        xml = wrap('<c t="b"><v>', c.cast("int").cast("string"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        xml = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), wrap("<c><v>", c.cast("string")))
    elif isinstance(kind, T.NumericType):
        xml = wrap("<c><v>", c.cast("string"))
    elif isinstance(kind, T.DateType):
        xml = wrap('<c s="1"><v>', F.datediff(c, F.lit("1899-12-30").cast("date")).cast("string"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        t = c.cast("timestamp_ntz")
        day = F.datediff(t.cast("date"), F.lit("1899-12-30").cast("date"))
        xml = wrap('<c s="2"><v>', (day + (F.hour(t) * 3600 + F.minute(t) * 60 + F.extract(F.lit("SECOND"), t).cast("double")) / 86400).cast("string"))
    else:
        text = c if isinstance(kind, T.StringType) else F.to_json(c) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else c.cast("string")
        fits = F.when(F.length(text) > MAX_TEXT, F.raise_error(F.lit(f"a cell holds {MAX_TEXT} characters at most"))).otherwise(text)
        xml = wrap('<c t="inlineStr"><is><t xml:space="preserve">', _escaped(fits), "</t></is></c>")
    return F.coalesce(xml, F.lit("<c/>"))


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_SHEET_XML = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_SPACE = MAIN.strip("{}")
#: The fixed parts of a file with one sheet; styles 1 and 2 are a day, and a day with its time.
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    f'<Override PartName="/xl/workbook.xml" ContentType="{_SHEET_XML}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_SHEET_XML}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{_SHEET_XML}.styles+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet xmlns="{_SPACE}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    '<cellXfs count="3"><xf xfId="0"/><xf xfId="0" numFmtId="14" applyNumberFormat="1"/><xf xfId="0" numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
}


def write_xlsx(df: DataFrame, path: str, sheet: str = "Cleaned_Data", max_rows: int = MAX_ROWS - 1) -> None:
    """One file with one sheet: a header, then the rows of ``df`` in its order. Null, NaN and infinities are empty cells, nested values JSON.

    Refuses more rows than ``max_rows``, which no sheet holds, and leaves no file then. The driver holds a partition of rows at a time.
    """
    max_rows = min(max_rows, MAX_ROWS - 1)
    fields = df.schema.fields
    quoted = [f"`{f.name.replace('`', '``')}`" for f in fields]
    body = df.select(F.concat(F.lit("<row>"), *[_cell(F.col(q), f.dataType) for q, f in zip(quoted, fields, strict=True)], F.lit("</row>")).alias("xml"))
    names = df.sparkSession.range(1).select(F.concat(F.lit("<row>"), *[_cell(F.lit(f.name), T.StringType()) for f in fields], F.lit("</row>"))).first()[0]
    title = re.sub(r"[\[\]:*?/\\]", "_", sheet)[:31].replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    book = f'<workbook xmlns="{_SPACE}" xmlns:r="{_OFFICE}"><sheets><sheet name="{title}" sheetId="1" r:id="rId1"/></sheets></workbook>'
    partial = f"{path}.part"
    try:
        with zipfile.ZipFile(partial, "w", zipfile.ZIP_DEFLATED) as out:
            for part, xml in {**_PARTS, "xl/workbook.xml": book}.items():
                out.writestr(part, _HEAD + xml)
            with out.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
                f.write(f'{_HEAD}<worksheet xmlns="{_SPACE}"><sheetData>{names}'.encode())
                for n, row in enumerate(body.toLocalIterator()):
                    if n == max_rows:
                        raise ValueError(f"a sheet holds {max_rows} rows at most")
                    f.write(row.xml.encode())
                f.write(b"</sheetData></worksheet>")
        os.replace(partial, path)
    finally:
        if os.path.exists(partial):
            os.remove(partial)
