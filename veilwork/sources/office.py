"""Office packages as text units.

A package is a zip of XML parts. Tasks only unpack it into skinny element rows, once; Spark joins cells
to their shared strings and formats, orders runs and builds the units. Packages that cannot be read are
listed with the reason.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilwork.functions.numeric import numeric_canonical
from veilwork.functions.text import is_blank
from veilwork.operators.cells import LITERAL, list_inner
from veilwork.operators.tokens import number_rows
from veilwork.session import BROADCAST_ROWS, stage

# Word-processing parts that hold text.
DOC_PARTS = r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml$"

# Small packages go out together, about so many rows at a time: a frame has a price of its own.
ELEMENT_ROWS = 10_000


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _unpack(files: DataFrame, part_pattern: str, rows_of, schema: str) -> DataFrame:
    """Run `rows_of(part name, root element)` over matching parts, once: the rows are staged. An unreadable package gives one row, whose
    `error` says why; no row of a package goes out before all of it was read."""
    names = [c.split()[0] for c in schema.split(", ")]
    columns = ["file", "part", *names, "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, rows = re.compile(part_pattern), []
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                out, name = [], None
                try:
                    if content is None:
                        raise ValueError("no content")
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for name in z.namelist():
                            if wanted.search(name):
                                out.extend((path, name, *row, None) for row in rows_of(name, ET.fromstring(z.read(name))))
                except (zipfile.BadZipFile, ET.ParseError, ValueError, RuntimeError, NotImplementedError, EOFError, zlib.error) as reason:
                    out = [(path, name, *[None] * len(names), f"{type(reason).__name__}: {reason}")]
                rows += out
                if len(rows) >= ELEMENT_ROWS:
                    yield pd.DataFrame(rows, columns=columns, dtype=object)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return stage(files.select("path", "content").mapInPandas(run, "file string, part string, " + schema + ", error string"))


def failures(elements: DataFrame) -> DataFrame:
    """(file, part, error): the packages of `docx_runs` or `xlsx_elements` that could not be read, and the part at fault if any."""
    return elements.filter("error is not null").select("file", "part", "error")


def binary_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path))


# ---- word processing --------------------------------------------------------------------

def _text_nodes(_: str, root: ET.Element):
    """(paragraph, run, text): a text node belongs to its nearest paragraph."""
    paragraphs = 0
    stack = [(root, -1)]
    run = 0
    while stack:
        node, owner = stack.pop()
        kind = _local(node.tag)
        if kind == "p":
            owner, paragraphs = paragraphs, paragraphs + 1
        elif kind == "t" and owner >= 0:
            yield owner, run, node.text or ""
            run += 1
        stack.extend((child, owner) for child in reversed(node))


def docx_runs(files: DataFrame) -> DataFrame:
    """(file, part, paragraph, run, text) of body, headers, footers, notes, comments and text boxes."""
    return _unpack(files, DOC_PARTS, _text_nodes, "paragraph int, run int, text string")


def scan_docx(files: DataFrame) -> DataFrame:
    """One unit per paragraph with its runs joined. Unreadable packages have none; see `read_docx`."""
    return read_docx(files)[0]


def read_docx(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, failures) of word-processing packages `files` (path, content), each parsed once."""
    runs = docx_runs(files)
    return docx_units(runs, file_order(files)), failures(runs)


def docx_units(runs: DataFrame, order: DataFrame) -> DataFrame:
    joined = (runs.filter("error is null").groupBy("file", "part", "paragraph")
              .agg(F.array_sort(F.collect_list(F.struct("run", "text"))).alias("r"))
              .select("file", "part", "paragraph", F.array_join(F.transform("r", lambda x: x["text"]), "").alias("text"))
              .filter(~is_blank(F.col("text"))))
    body_first = F.when(F.col("part") == "word/document.xml", 0).otherwise(1)
    return with_order(joined.select("file", "part", F.lit("text").alias("kind"), "text", F.lit(None).cast("string").alias("number_format"),
                                    F.named_struct(F.lit("paragraph"), F.col("paragraph")).alias("loc"),
                                    F.struct(body_first.alias("a"), F.col("part").alias("b"), F.col("paragraph").cast("long").alias("c"),
                                             F.lit(0).alias("d")).alias("_at")), order)


def file_order(files: DataFrame) -> DataFrame:
    """(file, file_ord): the place of each package in the sorted listing, from 0. A listing of any size is numbered by ranges."""
    listed = stage(files.select(F.col("path").alias("file")).distinct().withColumn("_all", F.lit(0)))
    return stage(number_rows(listed, "_all", ["file"], "_n").select("file", (F.col("_n") - 1).cast("long").alias("file_ord")))


def with_order(units: DataFrame, order: DataFrame) -> DataFrame:
    """Number units inside their file; a file was read by one task, so it fits one. Files are in the order of the listing."""
    n = F.row_number().over(W.partitionBy("file").orderBy("_at")) - 1
    numbered = units.withColumn("unit_ord", n.cast("long")).drop("_at")
    return numbered.join(F.broadcast(order) if order.count() <= BROADCAST_ROWS else order, "file")


# ---- spreadsheets -----------------------------------------------------------------------

def _shown(node: ET.Element) -> list[str]:
    """The texts below a node in order, without phonetic runs, which only say how a text is read aloud."""
    if _local(node.tag) == "t":
        return [node.text or ""]
    return [t for child in node if _local(child.tag) != "rPh" for t in _shown(child)]


def _sheet_rows(name: str, root: ET.Element):
    """(what, ord, ref, type, style, value) for everything in a workbook part that can hold text."""
    kind = name.rsplit("/", 1)[-1]
    n = 0
    if kind == "sharedStrings.xml":
        for i, si in enumerate(root):
            blocks = _shown(si)
            yield from (("shared", i, str(j), "", -1, b) for j, b in enumerate(blocks))
        return
    if kind == "styles.xml":
        for el in root.iter():
            if _local(el.tag) == "numFmt":
                yield "format", int(el.get("numFmtId")), "", "", -1, el.get("formatCode") or ""
            elif _local(el.tag) == "cellXfs":
                yield from (("style", i, "", "", int(x.get("numFmtId") or 0), "") for i, x in enumerate(el))
        return
    if kind == "workbook.xml":
        for el in root.iter():
            if _local(el.tag) == "definedName":
                n += 1
                yield "name_value", n, el.get("name") or "", "", -1, el.text or ""
                yield "defined_name", n, el.get("name") or "", "", -1, el.get("name") or ""
                yield "name_value", n, el.get("name") or "", "note", -1, el.get("comment") or ""
            elif _local(el.tag) == "sheet":
                n += 1
                yield "sheet_name", n, "", "", -1, el.get("name") or ""
        return
    for el in root.iter():
        tag = _local(el.tag)
        if tag == "c":
            parts = {_local(x.tag): x for x in el}
            n += 1
            if "f" in parts:
                yield "formula", n, el.get("r") or "", "", -1, parts["f"].text or ""
            elif "is" in parts:
                texts = _shown(parts["is"])
                yield from (("inline", n, el.get("r") or "", str(j), -1, t) for j, t in enumerate(texts))
            elif "v" in parts:
                yield "cell", n, el.get("r") or "", el.get("t") or "n", int(el.get("s") or 0), parts["v"].text or ""
        elif tag in ("oddHeader", "evenHeader", "firstHeader", "oddFooter", "evenFooter", "firstFooter"):
            n += 1
            yield "header_footer", n, tag, "", -1, el.text or ""
        elif tag == "dataValidation" and el.get("type") == "list":
            n += 1
            first = next((x.text for x in el if _local(x.tag) == "formula1"), "") or ""
            yield "list", n, el.get("sqref") or "", "", -1, first
        elif tag == "hyperlink" and el.get("tooltip"):
            n += 1
            yield "tooltip", n, el.get("ref") or "", "", -1, el.get("tooltip")
        elif tag == "comment":
            n += 1
            yield "comment", n, el.get("ref") or "", "", -1, "".join(_shown(el))


SHEET_PARTS = r"xl/(sharedStrings|styles|workbook|worksheets/[^/]+|comments[^/]*|comments/[^/]+)\.xml$"
# Built-in format numbers that show dates or times, and the built-in money formats.
DATE_FORMATS = (*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59))
MONEY_FORMATS = {5: "$#,##0_);($#,##0)", 6: "$#,##0_);[Red]($#,##0)", 7: "$#,##0.00_);($#,##0.00)", 8: "$#,##0.00_);[Red]($#,##0.00)",
                 42: '_($* #,##0_);_($* (#,##0);_($* "-"_);_(@_)', 44: '_($* #,##0.00_);_($* (#,##0.00);_($* "-"??_);_(@_)'}


def _is_date_code(code: Column) -> Column:
    """A format code is a date if d, m, y, h or s stands outside quotes, escapes and brackets."""
    bare = F.regexp_replace(code, r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "")
    return bare.rlike("(?i)[dmyhs]")


def header_sections(text: Column) -> Column:
    """Left, centre and right texts of a header or footer code."""
    at = F.when(text.rlike("^&[LCR]"), text).otherwise(F.concat(F.lit("&C"), text))
    return F.filter(F.regexp_extract_all(at, F.lit(r"(?s)&[LCR](.*?)(?=&[LCR]|\z)"), F.lit(1)), lambda t: F.trim(t) != "")


def xlsx_elements(files: DataFrame) -> DataFrame:
    return _unpack(files, SHEET_PARTS, _sheet_rows, "what string, ord int, ref string, type string, style int, value string")


def scan_xlsx(files: DataFrame) -> DataFrame:
    """Units of every cell and every other text-bearing place of a workbook. Unreadable packages have none; see `read_xlsx`."""
    return read_xlsx(files)[0]


def read_xlsx(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, failures) of workbooks `files` (path, content), each parsed once."""
    elements = xlsx_elements(files)
    return xlsx_units(elements, file_order(files)), failures(elements)


def xlsx_units(elements: DataFrame, order: DataFrame) -> DataFrame:
    raw = elements.filter("error is null")
    blocks = (raw.filter("what = 'shared'").groupBy("file", F.col("ord").alias("idx"))
              .agg(F.array_sort(F.collect_list(F.struct(F.col("ref").cast("int").alias("j"), F.col("value").alias("t")))).alias("b"))
              .select("file", "idx", F.transform("b", lambda x: x["t"]).alias("blocks")))
    codes = raw.filter("what = 'format'").select("file", F.col("ord").alias("fmt"), F.col("value").alias("code"))
    styles = (raw.filter("what = 'style'").select("file", F.col("ord").alias("style"), F.col("style").alias("fmt"))
              .join(codes, ["file", "fmt"], "left"))
    money = F.create_map(*[F.lit(x) for kv in MONEY_FORMATS.items() for x in kv])
    styles = styles.select("file", "style", F.coalesce("code", F.try_element_at(money, F.col("fmt")), F.lit("General")).alias("number_format"),
                           (F.col("fmt").isin(*DATE_FORMATS) | F.coalesce(_is_date_code(F.col("code")), F.lit(False))).alias("_date"))
    at = F.struct(F.lit(0).alias("a"), F.col("part").alias("b"), F.col("ord").cast("long").alias("c"), F.col("k").alias("d")).alias("_at")
    ref = F.named_struct(F.lit("cell_ref"), F.col("ref")).alias("loc")

    cells = raw.filter("what = 'cell'")
    # A rich cell shows each block and then the whole, so entities across blocks are seen too.
    texts = (cells.filter("type = 's'").withColumn("idx", F.expr("try_cast(value as int)")).join(blocks, ["file", "idx"])
             .withColumn("_all", F.when(F.size("blocks") > 1, F.concat("blocks", F.array(F.array_join("blocks", "")))).otherwise(F.col("blocks")))
             .select("file", "part", "ord", "ref", F.posexplode("_all").alias("k", "text"), F.lit("text").alias("kind")))
    inline = (raw.filter("what = 'inline'").groupBy("file", "part", "ord", "ref")
              .agg(F.array_sort(F.collect_list(F.struct(F.col("type").cast("int").alias("j"), F.col("value").alias("t")))).alias("b"))
              .withColumn("blocks", F.transform("b", lambda x: x["t"]))
              .withColumn("_all", F.when(F.size("blocks") > 1, F.concat("blocks", F.array(F.array_join("blocks", "")))).otherwise(F.col("blocks")))
              .select("file", "part", "ord", "ref", F.posexplode("_all").alias("k", "text"), F.lit("text").alias("kind")))
    strings = cells.filter("type = 'str'").select("file", "part", "ord", "ref", F.lit(0).alias("k"), F.col("value").alias("text"), F.lit("text").alias("kind"))
    integer = F.col("value").rlike("^-?[0-9]{1,38}$")
    numbers = (cells.filter("type = 'n'").join(styles, ["file", "style"], "left").filter("coalesce(_date, false) = false")
               .select("file", "part", "ord", "ref", F.lit(0).alias("k"),
                       F.when(integer, F.col("value").cast("decimal(38,0)").cast("string")).otherwise(
                           numeric_canonical(F.expr("try_cast(value as double)"))).alias("text"),
                       F.lit("number").alias("kind"), F.coalesce("number_format", F.lit("General")).alias("number_format")))
    quoted = (raw.filter("what in ('formula', 'name_value') and value like '%\"%'")
              .select("file", "part", "ord", "ref", F.posexplode(F.regexp_extract_all("value", F.lit(LITERAL), F.lit(1))).alias("k", "q"),
                      F.lit("formula").alias("kind"))
              .select("file", "part", "ord", "ref", "k", F.replace("q", F.lit('""'), F.lit('"')).alias("text"), "kind"))
    items = (raw.filter("what = 'list'").select("file", "part", "ord", "ref", F.posexplode(F.split(list_inner(F.col("value")), ",", -1)).alias("k", "text"),
                                                F.lit("list").alias("kind")))
    heads = (raw.filter("what = 'header_footer'")
             .select("file", "part", "ord", "ref", F.posexplode(header_sections(F.col("value"))).alias("k", "text"), F.lit("text").alias("kind")))
    plain = (raw.filter("what in ('comment', 'tooltip')")
             .select("file", "part", "ord", "ref", F.lit(0).alias("k"), F.col("value").alias("text"), F.lit("text").alias("kind")))
    hints = (raw.filter("what in ('sheet_name', 'defined_name')")
             .select("file", F.col("what").alias("part"), "ord", "ref", F.lit(0).alias("k"), F.col("value").alias("text"), F.lit("text").alias("kind")))
    every = numbers
    for more in (texts, inline, strings, quoted, items, heads, plain, hints):
        every = every.unionByName(more, allowMissingColumns=True)
    units = every.filter(~is_blank(F.col("text"))).select("file", "part", "kind", "text", "number_format", ref, at)
    return with_order(units, order)
