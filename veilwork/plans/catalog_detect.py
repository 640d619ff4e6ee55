"""Registered queries: sources, sinks and detection."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.config import MaskConfig
from veilwork.functions.hosts import is_private_host
from veilwork.functions.numeric import is_currency_format, luhn_ok, numeric_canonical, numeric_rule
from veilwork.functions.rules import regex_hits
from veilwork.functions.text import decode_bytes, markup_plaintext, parse_manual_words
from veilwork.operators import cells as C
from veilwork.operators import detect as D
from veilwork.operators.paths import ancestor_names, detect_paths, quarantine
from veilwork.operators.policy import grade
from veilwork.operators.tagging import tag_rows, type_tags, word_list_tagger
from veilwork.plans import oracle as O
from veilwork.plans.inputs import (WHITELIST, conversation_units, document_units, ledger, lexicon, listing, number_cells, table,
                                   tagged, token_mapping, tokened, whole_cells)
from veilwork.plans.registry import query, scratch
from veilwork.schema import UNIT_KEY
from veilwork.session import deal, settle, spread, stage
from veilwork.sources import files as FS
from veilwork.sources import lexicon as L
from veilwork.sources.office import scan_docx, scan_xlsx

KEY = list(UNIT_KEY)
CFG = MaskConfig(whitelist=WHITELIST)
PACKAGES = 5_000  # packages that one task makes and parses


# ---- A. sources and sinks ---------------------------------------------------------------

@query("a1_units", O.with_(O.DOCS, O.CONVS) + f"SELECT {O.KEY}, 'text' AS kind, text FROM docs UNION ALL SELECT {O.KEY}, 'text', text FROM convs")
def a1_units(spark, sf):
    return (document_units(spark, sf).select(*KEY, "kind", "text")
            .unionByName(conversation_units(spark, sf).select(*KEY, "kind", "text")))


@F.pandas_udf(T.BinaryType())
def _docx(texts: pd.Series) -> pd.Series:
    """A minimal word-processing package: one paragraph per line, each split into two runs."""
    def one(text):
        body = "".join("<w:p>" + "".join(f"<w:r><w:t>{escape(t)}</w:t></w:r>" for t in (line[:5], line[5:])) + "</w:p>"
                       for line in text.split("\n"))
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>')
        return buf.getvalue()
    return texts.map(one)


@query("a2_scan_docx", r"""SELECT CAST(doc_id AS VARCHAR) AS file, CAST(i AS INTEGER) AS paragraph, line AS text FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
  WHERE regexp_matches(line, '[^\s\x{85}\x{a0}\x{3000}]')""")
def a2_scan_docx(spark, sf):
    packages = spread(table(spark, sf, "documents").select("doc_id", "text")).select(F.col("doc_id").cast("string").alias("path"), _docx("text").alias("content"))
    return scan_docx(packages).select("file", "loc.paragraph", "text")


@F.pandas_udf(T.BinaryType())
def _xlsx(names: pd.Series, balances: pd.Series) -> pd.Series:
    """A minimal workbook: a text cell, a money cell, a date cell, a formula, a list and a comment."""
    def one(name, balance):
        n = escape(name)
        parts = {
            "xl/workbook.xml": f'<workbook xmlns="m"><sheets><sheet name="{n}"/></sheets></workbook>',
            "xl/sharedStrings.xml": f'<sst xmlns="m"><si><t>{n}</t></si><si><r><t>{n[:4]}</t></r><r><t>{n[4:]}</t></r></si></sst>',
            "xl/styles.xml": '<styleSheet xmlns="m"><numFmts><numFmt numFmtId="170" formatCode="¥#,##0.00"/></numFmts>'
                             '<cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="14"/></cellXfs></styleSheet>',
            "xl/worksheets/sheet1.xml":
                '<worksheet xmlns="m"><sheetData><row>'
                f'<c r="A1" t="s"><v>0</v></c><c r="B1" s="1"><v>{balance!r}</v></c><c r="C1" s="2"><v>45000</v></c>'
                f'<c r="D1"><f>IF(A1="{n}","say ""hi""",0)</f></c><c r="E1" t="s"><v>1</v></c><c r="F1" t="b"><v>1</v></c>'
                '</row></sheetData><dataValidations><dataValidation type="list" sqref="G1"><formula1>"yes,no"</formula1>'
                '</dataValidation></dataValidations><headerFooter><oddHeader>&amp;Lleft &amp;P&amp;Rright</oddHeader></headerFooter></worksheet>',
            "xl/comments1.xml": f'<comments xmlns="m"><commentList><comment ref="A1"><text><t>see {n}</t></text></comment></commentList></comments>',
        }
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            for part, xml in parts.items():
                z.writestr(part, xml)
        return buf.getvalue()
    return pd.Series([one(n, float(b)) for n, b in zip(names, balances)])


@query("a3_scan_xlsx", """SELECT CAST(c_custkey AS VARCHAR) AS file, x.cell_ref AS cell_ref, x.kind AS kind, x.text AS text, x.fmt AS number_format FROM (
  SELECT c_custkey, unnest([
    struct_pack(cell_ref := 'A1', kind := 'text', text := c_name, fmt := CAST(NULL AS VARCHAR)),
    struct_pack(cell_ref := 'B1', kind := 'number', text := CAST(c_acctbal AS VARCHAR), fmt := '¥#,##0.00'),
    struct_pack(cell_ref := 'D1', kind := 'formula', text := c_name, fmt := NULL), struct_pack(cell_ref := 'D1', kind := 'formula', text := 'say "hi"', fmt := NULL),
    struct_pack(cell_ref := 'E1', kind := 'text', text := left(c_name, 4), fmt := NULL), struct_pack(cell_ref := 'E1', kind := 'text', text := substr(c_name, 5), fmt := NULL),
    struct_pack(cell_ref := 'E1', kind := 'text', text := c_name, fmt := NULL),
    struct_pack(cell_ref := 'G1', kind := 'list', text := 'yes', fmt := NULL), struct_pack(cell_ref := 'G1', kind := 'list', text := 'no', fmt := NULL),
    struct_pack(cell_ref := 'oddHeader', kind := 'text', text := 'left &P', fmt := NULL), struct_pack(cell_ref := 'oddHeader', kind := 'text', text := 'right', fmt := NULL),
    struct_pack(cell_ref := 'A1', kind := 'text', text := 'see ' || c_name, fmt := NULL), struct_pack(cell_ref := '', kind := 'text', text := c_name, fmt := NULL)]) AS x
  FROM customer)""")
def a3_scan_xlsx(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    packages = deal(customers, customers.count(), PACKAGES).select(F.col("c_custkey").cast("string").alias("path"), _xlsx("c_name", "c_acctbal").alias("content"))
    return scan_xlsx(packages).select("file", "loc.cell_ref", "kind", "text", "number_format")


@query("a4_list_files", O.with_(O.LISTING) + """SELECT path, CASE WHEN regexp_matches(lower(path), '[^/]\\.(docx|xlsx|xlsm|pdf|doc|xls)$') THEN 'docs'
  WHEN regexp_matches(lower(path), '[^/]\\.pptx$') THEN 'blocked' ELSE 'other' END AS class FROM listing WHERE NOT starts_with(path, 'ASIA/NATION_2/')""")
def a4_list_files(spark, sf):
    return FS.classify_format(listing(spark, sf).filter(~F.col("path").startswith("ASIA/NATION_2/")))


@query("a5_lexicon", O.with_(O.LEXICON, O.WORDS) + "SELECT word, type, rule FROM words")
def a5_lexicon(spark, sf):
    return D.prepare_lexicon(lexicon(spark, sf), list(WHITELIST))


@query("a6_import_csv", """SELECT p_partkey AS ord, CASE p_partkey % 5 WHEN 0 THEN 'company' WHEN 1 THEN 'person' WHEN 2 THEN 'custom' WHEN 3 THEN 'project' ELSE 'location' END AS category,
  p_name AS word, p_partkey % 5 = 2 AS unknown FROM part WHERE p_size <> 7""")
def a6_import_csv(spark, sf):
    names = F.array(*[F.lit(x) for x in ("Company", " 人名", "未知", "项目", "LOCATION ")])
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int")).alias("c0"),
                                           F.when(F.col("p_size") == 7, " ").otherwise(F.concat(F.lit(" "), "p_name", F.lit("\t"))).alias("c1"))
    header = spark.createDataFrame([(-1, "\ufeff类别", "词条")], "ord long, c0 string, c1 string")
    shifted = rows.unionByName(header).withColumn("ord", F.col("ord") + 1)
    return L.import_lexicon_csv(shifted).withColumn("ord", F.col("ord") - 1)


@query("a7_import_txt", """SELECT p_partkey AS ord, CASE p_partkey % 4 WHEN 0 THEN 'company' ELSE 'custom' END AS category,
  p_name || CASE WHEN p_partkey % 4 = 0 THEN ':' || p_brand ELSE '' END AS word FROM part WHERE p_partkey % 4 IN (0, 1)""")
def a7_import_txt(spark, sf):
    line = F.expr("""case p_partkey % 4 when 0 then concat(' Company : ', p_name, ':', p_brand) when 1 then concat(p_name, ' ')
        when 2 then concat('# ', p_name) else concat('bogus:', p_name) end""")
    return L.import_lexicon_txt(table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), line.alias("line")))


@query("a8_import_yaml", O.with_(O.LEXICON) + "SELECT CASE WHEN category = 'project' THEN 'custom' ELSE category END AS category, word FROM lexicon")
def a8_import_yaml(spark, sf):
    odd = lexicon(spark, sf).withColumn("category", F.when(F.col("category") == "project", "brand").otherwise(F.col("category")))
    return L.import_lexicon_table(odd).select("category", "word")


@query("a9_export_csv", O.with_(O.LEXICON) + "SELECT category, word FROM lexicon")
def a9_export_csv(spark, sf):
    out = scratch(spark, "lexicon-csv")
    L.export_lexicon_csv(lexicon(spark, sf), out)
    return L.read_lexicon_csv(spark, out)


MAPPING_ROWS = O.with_(O.MAPPING) + "SELECT token, original, type, confidence, 'b1' AS batch_id, substr(sha256(original), 1, 8) AS fingerprint, kind FROM mapping"


@query("a10_write_mapping", MAPPING_ROWS)
def a10_write_mapping(spark, sf):
    rows = token_mapping(spark, sf).withColumns({"batch_id": F.lit("b1"), "fingerprint": F.substring(F.sha2("original", 256), 1, 8),
                                                 "created_at": F.lit("2024-01-01 00:00:00").cast("timestamp")})
    out = scratch(spark, "mapping")
    FS.write_mapping(rows, out)
    return FS.read_mapping_table(spark, out, "b1").drop("created_at")


@query("a11_read_mapping", """SELECT c_custkey, printf('[PERSON_%03d]', c_custkey) AS token, c_name AS original,
  CASE WHEN c_custkey % 3 = 0 THEN 'number' ELSE 'text' END AS kind FROM customer""")
def a11_read_mapping(spark, sf):
    token = F.format_string("[PERSON_%03d]", F.col("c_custkey"))
    full = F.to_json(F.struct(F.create_map(token, F.struct(F.col("c_name").alias("original"), F.lit("number").alias("kind"))).alias("tokens")))
    bare = F.to_json(F.create_map(token, F.col("c_name")))
    items = F.to_json(F.array(F.struct(token.alias("token"), F.col("c_name").alias("original"))))
    docs = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, full).when(F.col("c_custkey") % 3 == 1, bare).otherwise(items).alias("json"))
    return FS.read_mapping_json(docs).select("c_custkey", "token", "original", "kind")


LEDGER_DET = (O.LEDGER, O.LEXICON, O.WORDS, O.det("ledger"))


@query("a12_write_report", O.with_(*LEDGER_DET) + f"""SELECT CASE {O.status('smart')} WHEN 'auto_mask' THEN 'auto_masked' WHEN 'suggest_mask' THEN 'suggested' ELSE 'hints' END AS section,
  text, text_type AS type, source, confidence, file FROM det""")
def a12_write_report(spark, sf):
    def graded():
        found = stage(ledger_detected(spark, sf, positions=False))  # a report has no places; the ledger is made once, for its files as well
        rows = grade(D.detections(found), "smart").select("file", "text", "text_type", "source", "confidence", "status")
        return found.select("file"), rows
    files, rows = settle(graded)
    out = scratch(spark, "report")
    FS.write_report(files, rows, out, compression="gzip")
    return spark.read.schema("text string, type string, source string, confidence double, file string, section string").json(f"{out}/entries")


@F.pandas_udf(T.BinaryType())
def _gb18030(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t.encode("gb18030"))


@query("a13_decode", O.with_(O.LEDGER) + "SELECT unit_ord, text FROM ledger")
def a13_decode(spark, sf):
    raw = F.when(F.col("unit_ord") % 2 == 0, F.encode("text", "UTF-8")).otherwise(_gb18030("text"))
    return ledger(spark, sf).select("unit_ord", decode_bytes(raw).alias("text"))


@query("a14_markup", r"""SELECT page_id, replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'),
  '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS plain FROM pages""")
def a14_markup(spark, sf):
    return table(spark, sf, "pages").select("page_id", markup_plaintext(F.col("html")).alias("plain"))


@query("a15_history", """SELECT 'B' || o_orderkey AS batch_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at, CAST(o_custkey AS BIGINT) AS file_count
  FROM orders""")
def a15_history(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("B"), "o_orderkey").alias("batch_id"), F.lit("").alias("batch_name"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.col("o_custkey").alias("file_count"), F.lit(0).cast("long").alias("mask_count"), F.lit("").alias("mapping_path"))
    out = scratch(spark, "history")
    half = F.col("file_count") % 2 == 0
    FS.history_append(rows.filter(half), out)
    FS.history_append(rows.filter(~half), out)
    return FS.history_load(spark, out).select("batch_id", "created_at", "file_count")


@query("a16_quarantine", O.with_(O.TOKENED) + """SELECT file, unit_ord, CASE WHEN file IN (SELECT file FROM tokened WHERE o_orderstatus = 'O') THEN 'masked' ELSE 'skipped_unmasked' END AS disposition FROM tokened""")
def a16_quarantine(spark, sf):
    units = tokened(spark, sf)
    confirmed = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(F.concat(F.lit("f/"), "o_custkey").alias("file"))
    return quarantine(units, confirmed).select("file", "unit_ord", "disposition")


# ---- B. detection -----------------------------------------------------------------------

def ledger_detected(spark, sf, cfg=CFG, **kw):
    return D.detect(ledger(spark, sf), cfg, lexicon(spark, sf), **kw)


def ledger_rows(spark, sf, cfg=CFG, **kw):
    return D.detections(ledger_detected(spark, sf, cfg, **kw))


DICT_SQL = f"SELECT {O.KEY}, word AS text, type AS text_type, rule AS rule_ord FROM ledger u JOIN words w ON contains(u.text, w.word)"


@query("b1_dictionary", O.with_(O.LEDGER, O.LEXICON, O.WORDS) + DICT_SQL)
def b1_dictionary(spark, sf):
    words = D.prepare_lexicon(lexicon(spark, sf), list(WHITELIST))
    hits = D.detect_dictionary(ledger(spark, sf), words)
    return (hits.select(*KEY, F.explode("dict_hits").alias("h"))
            .select(*KEY, "h.text", F.col("h.type").alias("text_type"), F.col("h.rule").alias("rule_ord")))


@query("b1_dictionary_ngram", O.with_(O.LEDGER, O.LEXICON, O.WORDS) + DICT_SQL)
def b1_dictionary_ngram(spark, sf):
    words = D.prepare_lexicon(lexicon(spark, sf), list(WHITELIST))
    return D.ngram_rows(ledger(spark, sf), words).select(*KEY, F.col("word").alias("text"), F.col("type").alias("text_type"), F.col("rule").alias("rule_ord"))


MANUAL = ("甲方", "NATION_3", "合同价")


@query("b2_manual", O.with_(O.LEDGER) + " UNION ALL ".join(
    f"SELECT {O.KEY}, '{w}' AS text, 'custom' AS text_type, 'manual' AS source, CAST(0.95 AS DOUBLE) AS confidence FROM ledger WHERE contains(text, '{w}')" for w in MANUAL))
def b2_manual(spark, sf):
    rows = D.detections(D.detect(ledger(spark, sf), MaskConfig(manual_words=MANUAL, whitelist=WHITELIST, auto_detect=False)))
    return rows.select(*KEY, "text", "text_type", "source", "confidence")


@query("b3_parse_words", """SELECT p_partkey, p_name || CASE WHEN p_type <> p_name THEN '|' || p_type ELSE '' END || '|' || p_brand AS words FROM part""")
def b3_parse_words(spark, sf):
    typed = F.concat(F.lit(" "), "p_name", F.lit(",,"), "p_type", F.lit("，\n "), "p_name", F.lit("\n"), "p_brand", F.lit(","))
    return table(spark, sf, "part").select("p_partkey", F.array_join(parse_manual_words(typed), "|").alias("words"))


def rule_query(units, name):
    def run(spark, sf):
        return (units(spark, sf).select(*KEY, F.explode(regex_hits(F.col("text"), (name,))).alias("h"))
                .select(*KEY, "h.text", F.col("h.type").alias("text_type"), "h.confidence"))
    return run


def rule_sql(cte, units, name):
    return O.with_(cte) + f"SELECT {O.KEY}, text, text_type, confidence FROM ({O.rx(units, (name,))})"


for _id, _name, _cte, _units, _src in (
        ("b4_rmb_amount", "rmb_amount", O.LEDGER, "ledger", ledger), ("b5_generic_amount", "generic_amount", O.LEDGER, "ledger", ledger),
        ("b6_mobile", "mobile", O.LEDGER, "ledger", ledger), ("b7_id_number", "id_number", O.LEDGER, "ledger", ledger),
        ("b8_email", "email", O.DOCS, "docs", document_units), ("b8_email_ledger", "email", O.LEDGER, "ledger", ledger),
        ("b9_cn_date", "cn_date", O.LEDGER, "ledger", ledger), ("b10_card", "card", O.DOCS, "docs", document_units),
        ("b11_separated_card", "separated_card", O.LEDGER, "ledger", ledger)):
    query(_id, rule_sql(_cte, _units, _name))(rule_query(_src, _name))


@query("b12_whitelist", O.with_(O.LEDGER, O.LEXICON, f"lex2 AS (SELECT word, arg_min(category, cat_ord) AS type FROM lexicon GROUP BY word)") +
       f"SELECT {O.KEY}, word AS text, type AS text_type FROM ledger u JOIN lex2 w ON contains(u.text, w.word) WHERE word NOT IN {O.WL}")
def b12_whitelist(spark, sf):
    rows = D.detections(D.detect(ledger(spark, sf), MaskConfig(), lexicon(spark, sf), regex=False))
    listed = spark.createDataFrame([(w,) for w in WHITELIST], "word string")
    return D.apply_whitelist(rows, listed).select(*KEY, "text", "text_type")


DET_COLS = f"SELECT {O.KEY}, text, text_type, source, confidence, channel_ord, rule_ord FROM det"
COLS = [*KEY, "text", "text_type", "source", "confidence", "channel_ord", "rule_ord"]


@query("b13_dedup_channels", O.with_(O.LEDGER, O.LEXICON, O.WORDS, O.det("ledger", manual=("Supplier#000000007",))) + DET_COLS)
def b13_dedup_channels(spark, sf):
    """Row form: channels gathered as tables and folded by a window."""
    units, lex = stage(ledger(spark, sf)), lexicon(spark, sf)  # read by each channel
    parts = [D.detections(D.detect(units, MaskConfig(whitelist=WHITELIST), lex, regex=False)),
             D.detections(D.detect(units, MaskConfig(whitelist=WHITELIST), method="scan")),
             D.detections(D.detect(units, MaskConfig(manual_words=("Supplier#000000007",), auto_detect=False)))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return D.dedup_channels(rows).select(*COLS)


@query("b13_dedup_arrays", O.with_(O.LEDGER, O.LEXICON, O.WORDS, O.det("ledger", manual=("Supplier#000000007",))) + DET_COLS)
def b13_dedup_arrays(spark, sf):
    """Array form of the same dedup, without a shuffle."""
    return ledger_rows(spark, sf, MaskConfig(whitelist=WHITELIST, manual_words=("Supplier#000000007",))).select(*COLS)


@query("b14_context", O.with_(*LEDGER_DET) + f"""SELECT {O.KEY}, text, substr(body, greatest(1, strpos(body, text) - 50),
  strpos(body, text) + length(text) + 50 - greatest(1, strpos(body, text) - 50)) AS context FROM det""")
def b14_context(spark, sf):
    return ledger_rows(spark, sf).select(*KEY, "text", "context")


@query("b15_channel_switch", O.with_(O.LEDGER) + f"SELECT {O.KEY}, '合同价' AS text, 'manual' AS source FROM ledger WHERE contains(text, '合同价')")
def b15_channel_switch(spark, sf):
    cfg = MaskConfig(manual_words=("合同价", "", "合同价"), auto_detect=False)
    return ledger_rows(spark, sf, cfg).select(*KEY, "text", "source")


TAG_WORDS = {"ring": "nz", "widget": "nt", "small": "ns", "red": "nr", "ECONOMY": "x"}


@query("b16_ner_tag", """SELECT 'part' AS file, CAST(0 AS BIGINT) AS file_ord, p_partkey AS unit_ord, CAST(i - 1 AS INTEGER) AS ord, w AS word,
  CASE w WHEN 'ring' THEN 'nz' WHEN 'widget' THEN 'nt' WHEN 'small' THEN 'ns' WHEN 'red' THEN 'nr' ELSE 'x' END AS flag
  FROM (SELECT p_partkey, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
    SELECT p_partkey, regexp_extract_all(p_name || ' ' || p_type, 'ECONOMY|widget|small|ring|red') AS ws FROM part))""")
def b16_ner_tag(spark, sf):
    units = table(spark, sf, "part").select(F.lit("part").alias("file"), F.lit(0).cast("long").alias("file_ord"),
                                            F.col("p_partkey").alias("unit_ord"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return tag_rows(units, word_list_tagger(TAG_WORDS)).select(*KEY, "ord", "word", "flag")


SUFFIX_RE = "(公司|集团|银行|分行|研究院|大学|政府|委员会|部门|局|部|项目|工程|煤矿|矿区)$"
NER_CONF = f"""least(CAST(0.60 AS DOUBLE) + CASE WHEN length(word) >= 4 THEN CAST(0.10 AS DOUBLE) WHEN length(word) >= 3 THEN CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  + CASE WHEN flag IN ('nt','ni','nis') THEN CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN flag = 'nr' THEN CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  + CASE WHEN flag = 'ns' THEN CAST(0.03 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN regexp_matches(word, '{SUFFIX_RE}') THEN CAST(0.08 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, CAST(0.85 AS DOUBLE))"""
NER_TYPE = """CASE WHEN flag IN ('nr','nrfg','nrt') THEN 'person' WHEN flag IN ('ns','nsf') THEN 'location' WHEN flag IN ('nt','ni','nis','nic') THEN 'company' WHEN flag = 'nz' THEN 'custom' END"""
NER_FIRST = f"""SELECT file, unit_ord, word AS text, {NER_TYPE} AS text_type, {NER_CONF} AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY unit_ord, word ORDER BY ord) AS rn FROM tagged WHERE length(word) >= 2 AND flag <> 'x') WHERE rn = 1"""


@query("b17_ner_types", O.with_(O.TAGGED) + f"SELECT file, unit_ord, text, text_type FROM ({NER_FIRST})")
def b17_ner_types(spark, sf):
    return type_tags(tagged(spark, sf)).select("file", "unit_ord", "text", "text_type")


@query("b18_ner_confidence", O.with_(O.TAGGED) + f"SELECT unit_ord, text, confidence FROM ({NER_FIRST})")
def b18_ner_confidence(spark, sf):
    return type_tags(tagged(spark, sf)).select("unit_ord", "text", "confidence")


@query("b19_canonical", O.with_(O.NUMBERS, O.WHOLES) + """SELECT cell, l_partkey AS part, l_quantity AS quantity, CAST(value AS VARCHAR) AS canon FROM cells
  UNION ALL SELECT cell, 0, 0, CAST(value AS VARCHAR) FROM wholes""")
def b19_canonical(spark, sf):
    a = number_cells(spark, sf).select("cell", F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), numeric_canonical(F.col("value")).alias("canon"))
    b = whole_cells(spark, sf).select("cell", F.lit(0).cast("long").alias("part"), F.lit(0.0).alias("quantity"), numeric_canonical(F.col("value")).alias("canon"))
    return a.unionByName(b)


@query("b20_currency", O.with_(O.NUMBERS) + "SELECT cell, l_partkey AS part, l_quantity AS quantity, regexp_matches(number_format, '[¥￥$€£]') AS money FROM cells")
def b20_currency(spark, sf):
    return number_cells(spark, sf).select("cell", F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), is_currency_format(F.col("number_format")).alias("money"))


def luhn(expr: str) -> str:
    """Luhn sum by list arithmetic over the reversed digits."""
    d = f"string_split(reverse({expr}), '')"
    return f"""(list_sum([CASE WHEN i % 2 = 1 THEN CAST({d}[i] AS INTEGER) ELSE CASE WHEN CAST({d}[i] AS INTEGER) > 4
      THEN CAST({d}[i] AS INTEGER) * 2 - 9 ELSE CAST({d}[i] AS INTEGER) * 2 END END FOR i IN range(1, length({expr}) + 1)]) % 10 = 0)"""


def rules_sql(cte: str) -> str:
    digits = "ltrim(canon, '-')"
    fire = f"""CASE WHEN regexp_matches(number_format, '[¥￥$€£]') THEN CASE WHEN abs(CAST(canon AS DOUBLE)) >= 10000 THEN 'amount 0.85' END
      WHEN NOT contains(canon, '.') AND length({digits}) BETWEEN 16 AND 19 THEN CASE WHEN {luhn(digits)} THEN 'custom 0.85' ELSE 'custom 0.65' END
      WHEN NOT contains(canon, '.') AND length({digits}) BETWEEN 9 AND 15 THEN 'amount 0.7'
      WHEN contains(canon, '.') AND length(split_part({digits}, '.', 1)) >= 6 THEN 'amount 0.6' END"""
    return f"SELECT *, {fire} AS rule FROM (SELECT *, CAST(value AS VARCHAR) AS canon FROM {cte})"


RULE_OUT = "split_part(rule, ' ', 1) AS text_type, CAST(split_part(rule, ' ', 2) AS DOUBLE) AS confidence"


@query("b21_numeric_rules", O.with_(O.NUMBERS, O.WHOLES) + f"""SELECT cell, canon AS text, {RULE_OUT} FROM ({rules_sql('cells')}) WHERE rule IS NOT NULL
  UNION ALL SELECT cell, canon, {RULE_OUT} FROM ({rules_sql('wholes')}) WHERE rule IS NOT NULL""")
def b21_numeric_rules(spark, sf):
    cols = ["cell", "text", "text_type", "confidence"]
    return C.numeric_detections(number_cells(spark, sf)).select(*cols).unionByName(C.numeric_detections(whole_cells(spark, sf)).select(*cols))


@query("b22_luhn", O.with_(O.WHOLES) + f"SELECT cell, {luhn('CAST(value AS VARCHAR)')} AS ok FROM wholes")
def b22_luhn(spark, sf):
    return whole_cells(spark, sf).select("cell", luhn_ok(F.col("value").cast("string")).alias("ok"))


@query("b23_merge_numeric", O.with_(O.WHOLES) + f"SELECT cell, canon AS text, {RULE_OUT}, 'xlsx_numeric' AS source FROM ({rules_sql('wholes')}) WHERE rule IS NOT NULL")
def b23_merge_numeric(spark, sf):
    cells = whole_cells(spark, sf)
    synth = C.numeric_detections(cells)
    units = cells.select(F.lit("w").alias("file"), F.lit(0).cast("long").alias("file_ord"), F.col("cell").alias("unit_ord"),
                         numeric_canonical(F.col("value")).alias("text"))
    generic = D.detections(D.detect(units)).withColumnRenamed("unit_ord", "cell")
    return C.merge_numeric(synth, generic, ["cell"])


PATH_NAMES = """names AS (SELECT DISTINCT CASE WHEN i = 3 THEN 'file' ELSE 'dir' END AS kind, string_split(path, '/')[i] AS name FROM listing, range(1, 4) t(i)),
stems AS (SELECT kind || '/' || name AS file, CAST(0 AS BIGINT) AS file_ord, CAST(0 AS BIGINT) AS unit_ord,
  CASE WHEN kind = 'file' THEN regexp_replace(name, '(.)\\.[^.]+$', '\\1') ELSE name END AS text FROM names)"""
PATH_KEEP = "NOT (source = 'regex' AND (text_type = 'amount' OR regexp_full_match(text, '[0-9]{16,19}')))"


@query("b24_path_filter", O.with_(O.LISTING, O.LEXICON, O.WORDS, PATH_NAMES, O.det("stems")) + f"""SELECT file, text, text_type, 'path' AS source, source AS origin_source, confidence
  FROM det WHERE {PATH_KEEP}""")
def b24_path_filter(spark, sf):
    from veilwork.operators.paths import name_units, tree_entries
    names = tree_entries(listing(spark, sf)).select("kind", "name").distinct()
    rows = D.detections(D.detect(name_units(names), CFG, lexicon(spark, sf)))
    return D.path_name_filter(rows, ("file",)).select("file", "text", "text_type", "source", "origin_source", "confidence")


@query("b25_detect_paths", O.with_(O.LISTING, O.LEXICON, O.WORDS, PATH_NAMES, O.det("stems")) + f"SELECT file, text, {O.status('smart')} AS status FROM det WHERE {PATH_KEEP}")
def b25_detect_paths(spark, sf):
    return detect_paths(listing(spark, sf), CFG, lexicon(spark, sf)).select("file", "text", "status")


@query("b25_path_names", O.with_(O.LISTING, PATH_NAMES) + "SELECT DISTINCT split_part(file, '/', 1) AS kind, text FROM stems")
def b25_path_names(spark, sf):
    return ancestor_names(listing(spark, sf))


@query("b26_dedup_files", O.with_(*LEDGER_DET) + """SELECT text, text_type, file_ord, unit_ord FROM (
  SELECT *, row_number() OVER (PARTITION BY text, text_type ORDER BY file_ord, unit_ord, channel_ord, rule_ord) AS n FROM det) WHERE n = 1""")
def b26_dedup_files(spark, sf):
    return D.dedup_across_files(ledger_rows(spark, sf, positions=False)).select("text", "text_type", "file_ord", "unit_ord")


@query("b27_ai_detected", """SELECT o_orderkey, o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 AS ai FROM orders""")
def b27_ai_detected(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    source = F.when(F.col("o_orderkey") % 3 == 0, F.when(F.col("o_orderkey") % 2 == 0, "llm").otherwise("path")).otherwise("regex")
    origin = F.when((F.col("o_orderkey") % 3 == 0) & (F.col("o_orderkey") % 2 == 1), "llm").otherwise("")
    reason = F.when(F.col("o_orderkey") % 5 == 0, "AI 检出：x").otherwise("AI 复核维持：AI 检出")
    return o.select("o_orderkey", D.is_ai_detected(source, origin, reason).alias("ai"))


HOSTS = """CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN 'http://10.' || (page_id % 256) || '.3.4:8000/v1' WHEN 2 THEN '192.168.1.' || (page_id % 256) || ':8000/v1'
  WHEN 3 THEN 'http://172.' || (page_id % 64) || '.0.9/' WHEN 4 THEN 'https://srv' || page_id || '.INTERNAL/x' WHEN 5 THEN 'http://8.8.8.' || (page_id % 256) WHEN 6 THEN '' ELSE 'http://localhost:1/' END"""


@query("b28_private_host", f"""SELECT page_id, CASE page_id % 8 WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN page_id % 64 BETWEEN 16 AND 31 WHEN 4 THEN true WHEN 7 THEN true ELSE false END AS private FROM pages""")
def b28_private_host(spark, sf):
    url = F.expr(HOSTS)
    return table(spark, sf, "pages").select("page_id", is_private_host(url).alias("private"))


FORMULA = "concat('=IF(A1=\"', c_name, '\",\"say \"\"', n_name, '\"\"\",B', c_custkey, ')')"


@query("b29_quoted_literals", f"""SELECT c_custkey, i AS child_ord, CASE i WHEN 0 THEN c_name ELSE 'say "' || n_name || '"' END AS text
  FROM customer JOIN nation ON c_nationkey = n_nationkey, range(0, 2) t(i)""".replace("i AS child_ord", "CAST(i AS INTEGER) AS child_ord"))
def b29_quoted_literals(spark, sf):
    return C.literal_units(formulas(spark, sf), "formula", ["c_custkey"])


def formulas(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "c_name", "n_name", F.expr(FORMULA).alias("formula"))


def lists(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.expr("""'"' || c_name || ',' || n_name || ',' || c_mktsegment || '"'""").alias("items"))


@query("b30_list_items", """SELECT c_custkey, CAST(i AS INTEGER) AS child_ord, [c_name, n_name, c_mktsegment][i + 1] AS text FROM customer JOIN nation ON c_nationkey = n_nationkey, range(0, 3) t(i)""")
def b30_list_items(spark, sf):
    return C.list_item_units(lists(spark, sf), "items", ["c_custkey"])


@query("b31_rich_text", O.with_(O.LEXICON, O.WORDS, """parts AS (SELECT c_custkey, unnest([left(n_name, 7) , substr(n_name, 8) || left(c_name, 9), substr(c_name, 10)]) AS text,
   n_name || c_name AS whole FROM customer JOIN nation ON c_nationkey = n_nationkey)""") + """
  SELECT DISTINCT p.c_custkey AS cell, w.word AS text FROM (SELECT DISTINCT c_custkey, whole FROM parts) p JOIN words w ON contains(p.whole, w.word)
  WHERE NOT EXISTS (SELECT 1 FROM parts q WHERE q.c_custkey = p.c_custkey AND contains(q.text, w.word))""")
def b31_rich_text(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    cut = F.expr("array(left(n_name, 7), concat(substr(n_name, 8), left(c_name, 9)), substr(c_name, 10))")
    blocks = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("cell"), F.posexplode(cut).alias("block_ord", "text"))
    passes = C.rich_text_passes(blocks, ["cell"])
    units = passes.select(F.concat_ws("/", F.lit("rich"), "pass_no").alias("file"), F.col("cell").alias("file_ord"),
                          F.col("block_ord").cast("long").alias("unit_ord"), "text")
    found = D.detections(D.detect(units, CFG, lexicon(spark, sf), regex=False))
    rows = found.select(F.col("file_ord").alias("cell"), F.substring("file", 6, 1).cast("int").alias("pass_no"), "text")
    return C.crossing_hits(rows, ["cell"])


@query("b32_hint_only", O.with_(*LEDGER_DET) + f"""SELECT {O.KEY}, text, CASE WHEN unit_ord % 3 = 0 THEN 'hint_only' ELSE {O.status('smart')} END AS status FROM det""")
def b32_hint_only(spark, sf):
    rows = grade(ledger_rows(spark, sf), "smart").withColumn("part", F.when(F.col("unit_ord") % 3 == 0, "sheet_name").otherwise("cell"))
    return C.hint_only_fields(rows).select(*KEY, "text", "status")
