"""Packages are parsed once, listed in order, and named if they cannot be read."""

import io
import zipfile

from veilwork.sources.office import failures, read_docx, read_xlsx, xlsx_elements


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def docx(text):
    return package({"word/document.xml": f'<w:document xmlns:w="m"><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:document>'})


SHEET = {"xl/sharedStrings.xml": '<sst xmlns="m"><si><t>東京</t><rPh sb="0" eb="2"><t>トウキョウ</t></rPh></si></sst>',
         "xl/worksheets/sheet1.xml": '<worksheet xmlns="m"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>in</t><rPh><t>no</t></rPh></is></c></row></sheetData></worksheet>'}


def test_broken_packages_are_listed(spark):
    good = docx("hello")
    rows = [("b.docx", docx("second")), ("a.docx", good), ("z.docx", b"no zip"), ("c.docx", good[:40]), ("d.docx", None), ("e.docx", docx("a & b")), ("f.docx", package({"other": "x"}))]
    units, failed = read_docx(spark.createDataFrame(rows, "path string, content binary"))
    assert [(r["file"], r["file_ord"], r["unit_ord"], r["text"]) for r in units.orderBy("file_ord").collect()] == [("a.docx", 0, 0, "hello"), ("b.docx", 1, 0, "second")]
    got = {r["file"]: (r["part"], r["error"].split(":")[0]) for r in failed.collect()}
    assert got == {"z.docx": (None, "BadZipFile"), "c.docx": (None, "BadZipFile"), "d.docx": (None, "ValueError"), "e.docx": ("word/document.xml", "ParseError")}


def test_no_phonetic_text_and_one_parser(spark):
    files = spark.createDataFrame([("x.xlsx", package(SHEET)), ("y.xlsx", b"")], "path string, content binary")
    units, failed = read_xlsx(files)
    assert sorted(r["text"] for r in units.collect()) == ["in", "東京"] and [r["file"] for r in failed.collect()] == ["y.xlsx"]
    assert "MapInPandas" not in units._jdf.queryExecution().toString()  # the parsed rows are staged
    assert failures(xlsx_elements(files.limit(0))).count() == 0


def test_small_packages_share_frames_and_tasks(spark, monkeypatch):
    from veilwork.session import deal
    from veilwork.sources import office
    files = spark.createDataFrame([(f"{i:02d}.docx", docx(f"t{i}") if i % 7 else b"no zip") for i in range(20)], "path string, content binary").coalesce(1)
    frames = []
    monkeypatch.setattr(office, "ELEMENT_ROWS", 6)
    monkeypatch.setattr(office, "stage", lambda df: frames.append(df) or df)
    runs = office.docx_runs(files)
    assert len(frames) == 1
    got = {(r["file"], r["text"], r["error"] is None) for r in runs.collect()}
    assert got == {(f"{i:02d}.docx", f"t{i}" if i % 7 else None, i % 7 > 0) for i in range(20)}
    dealt = deal(spark.range(1000, numPartitions=1), 1000, 50)
    assert dealt.rdd.getNumPartitions() == 20 and max(dealt.rdd.glom().map(len).collect()) <= 60
    assert deal(spark.range(3, numPartitions=1), 3).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_workbooks_of_one_file_are_parsed_side_by_side(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from veilwork.plans import catalog_detect
    pq.write_table(pa.table({"c_custkey": pa.array(range(40), pa.int64()), "c_name": [f"Customer#{i:09d}" for i in range(40)], "c_acctbal": [i + 0.5 for i in range(40)]}),
                   tmp_path / "customer.parquet")
    seen = []
    monkeypatch.setattr(catalog_detect, "PACKAGES", 2)
    monkeypatch.setattr(catalog_detect, "scan_xlsx", lambda files: seen.append(files) or spark.createDataFrame([], "file string, loc struct<cell_ref:string>, kind string, text string, number_format string"))
    catalog_detect.a3_scan_xlsx(spark, str(tmp_path))
    assert seen[0].rdd.getNumPartitions() == 20 and seen[0].count() == 40
