"""Registered queries: paths, aggregates, review, evaluation and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.config import MaskConfig
from veilwork.functions import names as N
from veilwork.functions.text import nfkc
from veilwork.operators import detect as D
from veilwork.operators import evaluate as EV
from veilwork.operators import paths as PT
from veilwork.operators import reports as RP
from veilwork.operators import review as RV
from veilwork.operators.policy import grade
from veilwork.plans import oracle as O
from veilwork.plans.catalog_detect import CFG, KEY, LEDGER_DET, PATH_KEEP, PATH_NAMES, ledger_rows
from veilwork.plans.catalog_mask import DOC_DET, DOC_MASK, DOCS_LOUD
from veilwork.plans.inputs import WHITELIST, conversation_units, document_units, ledger, lexicon, listing, path_records, table, token_mapping
from veilwork.plans.registry import query, scratch
from veilwork.session import stage
from veilwork.sources import files as FS
from veilwork.sources import lexicon as L
from veilwork.sources.units import units_from_table
from veilwork.streaming.stateful import mask_stream_reversible
from veilwork.streaming.stream import mask_stream_stateless

# ---- F. paths as data -------------------------------------------------------------------

ODD_NAME = """concat(case p_partkey % 6 when 0 then 'con' when 1 then concat('a<b>', p_name) when 2 then concat(p_name, '. .') when 3 then '' when 4 then '...' else p_brand end,
  case p_size % 3 when 0 then '.docx' when 1 then '.tar.gz' else '' end)"""
ODD_SQL = ODD_NAME.replace("concat(case", "((case").replace("concat('a<b>', p_name)", "'a<b>' || p_name").replace("concat(p_name, '. .')", "p_name || '. .'").replace(
    "else p_brand end,", "else p_brand end) ||")


@query("f1_split_ext", f"""SELECT p_partkey, regexp_replace(name, '^(.+)(\\.[^.]+)$', '\\1') AS stem, regexp_extract(name, '^(.+)(\\.[^.]+)$', 2) AS ext FROM (SELECT p_partkey, {ODD_SQL} AS name FROM part)""")
def f1_split_ext(spark, sf):
    name = F.expr(ODD_NAME)
    return table(spark, sf, "part").select("p_partkey", N.stem_of(name).alias("stem"), N.ext_of(name).alias("ext"))


RES = "(" + ", ".join(f"'{r}'" for r in N.RESERVED) + ")"


@query("f2_sanitize", f"""SELECT p_partkey, CASE WHEN t = '' THEN '_masked' WHEN lower(regexp_replace(t, '^(.+)(\\.[^.]+)$', '\\1')) IN {RES}
    THEN regexp_replace(t, '^(.+)(\\.[^.]+)$', '\\1') || '_' || regexp_extract(t, '^(.+)(\\.[^.]+)$', 2) ELSE t END AS clean FROM (
  SELECT p_partkey, rtrim(regexp_replace(c, '^(.+)(\\.[^.]+)$', '\\1'), ' .') || regexp_extract(c, '^(.+)(\\.[^.]+)$', 2) AS t FROM (
    SELECT p_partkey, regexp_replace({ODD_SQL}, '[<>:"/|?*\\\\]', '_', 'g') AS c FROM part))""")
def f2_sanitize(spark, sf):
    return table(spark, sf, "part").select("p_partkey", N.sanitize_name(F.expr(ODD_NAME)).alias("clean"))


NAME_ACT = f"act AS (SELECT * FROM det WHERE {PATH_KEEP} AND {O.status('smart')} = 'auto_mask')"
# Within one example name the kept texts do not nest, except a nation inside a longer number.
NAME_MASK = """long AS (SELECT * FROM act a WHERE NOT EXISTS (SELECT 1 FROM act b WHERE b.file = a.file AND b.text <> a.text AND contains(b.text, a.text))),
fixed AS (SELECT file, body, string_agg(text, chr(1) ORDER BY length(text) DESC, channel_ord, rule_ord) AS t FROM long GROUP BY file, body)"""


@query("f3_mask_names", O.with_(O.LISTING, O.LEXICON, O.WORDS, PATH_NAMES, O.det("stems"), NAME_ACT, NAME_MASK) + """SELECT split_part(f.file, '/', 1) AS kind, substr(f.file, strpos(f.file, '/') + 1) AS name,
  CASE WHEN instr(t, chr(1)) > 0 THEN replace(replace(body, split_part(t, chr(1), 1), '***'), split_part(t, chr(1), 2), '***') ELSE replace(body, t, '***') END AS masked FROM fixed f""")
def f3_mask_names(spark, sf):
    """Irreversible form, shown before the final sanitising turns the stars into underscores."""
    names = PT.tree_entries(listing(spark, sf)).select("kind", "name").distinct()
    found = PT.detect_names(names, CFG, lexicon(spark, sf)).filter("status = 'auto_mask'")
    done = PT.mask_names(names, found, None, irreversible=True)
    stem = F.when(F.col("kind") == "file", N.stem_of(F.col("new_name"))).otherwise(F.col("new_name"))
    return done.select("kind", "name", F.replace(stem, F.lit("___"), F.lit("***")).alias("masked"))


@query("f4_plan_tree")
def f4_plan_tree(spark, sf):
    return PT.plan_tree(listing(spark, sf), CFG, lexicon(spark, sf))


TREE = """tree AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:i], '/') AS rel_old, CASE WHEN i = 3 THEN 'file' ELSE 'dir' END AS kind,
  string_split(path, '/')[i] AS name, CAST(i AS INTEGER) AS depth FROM listing, range(1, 4) t(i))"""


@query("f4_tree_entries", O.with_(O.LISTING, TREE) + "SELECT rel_old, kind, name, depth FROM tree")
def f4_tree_entries(spark, sf):
    return PT.tree_entries(listing(spark, sf)).select("rel_old", "kind", "name", "depth")


WANTED = """wanted AS (SELECT c_custkey, c_nationkey AS parent, c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '.docx' ELSE '' END AS desired FROM customer),
taken AS (SELECT DISTINCT c_nationkey AS parent, lower(c_mktsegment || '_' || (c_custkey % 7) || '.DOCX') AS low FROM customer
  UNION SELECT DISTINCT c_nationkey, lower(c_mktsegment) FROM customer WHERE c_custkey % 3 = 0),
cand AS (SELECT w.parent, w.desired, n, row_number() OVER (PARTITION BY w.parent, w.desired ORDER BY n) AS k FROM (SELECT parent, desired, count(*) AS c FROM wanted GROUP BY ALL) w,
  range(0, 5000) r(n) WHERE n <= w.c + 10 AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.parent = w.parent AND t.low = lower(CASE WHEN n = 0 THEN w.desired
    WHEN w.desired LIKE '%.docx' THEN replace(w.desired, '.docx', '') || '_' || n || '.docx' ELSE w.desired || '_' || n END)))"""


@query("f5_conflicts", O.with_(WANTED) + """SELECT w.c_custkey, CASE WHEN n = 0 THEN desired WHEN desired LIKE '%.docx' THEN replace(desired, '.docx', '') || '_' || n || '.docx' ELSE desired || '_' || n END AS final
  FROM (SELECT *, row_number() OVER (PARTITION BY parent, desired ORDER BY c_custkey) AS k FROM wanted) w JOIN cand USING (parent, desired, k)""")
def f5_conflicts(spark, sf):
    c = table(spark, sf, "customer")
    parent = F.col("c_nationkey").cast("string").alias("parent")
    want = c.select(parent, F.expr("concat(c_mktsegment, case when c_custkey % 2 = 0 then '.docx' else '' end)").alias("desired"), "c_custkey")
    have = (c.select(parent, F.expr("concat(c_mktsegment, '_', c_custkey % 7, '.DOCX')").alias("name"))
            .unionByName(c.filter("c_custkey % 3 = 0").select(parent, F.col("c_mktsegment").alias("name"))))
    return PT.resolve_name_conflicts(want, have, ["c_custkey"]).select("c_custkey", "final")


@query("f6_too_long", """SELECT c_custkey, 4 + c_custkey % 300 + length(c_name) > 259 AS skip FROM customer""")
def f6_too_long(spark, sf):
    c = table(spark, sf, "customer").withColumn("parent", F.when(F.col("c_custkey") % 300 == 0, F.lit("")).otherwise(F.expr("repeat('d', cast(c_custkey % 300 - 1 as int))")))
    return c.select("c_custkey", PT.too_long(F.when(F.col("c_custkey") % 300 == 1, F.lit("")).otherwise(F.col("parent")), F.concat("c_name", F.when(F.col("c_custkey") % 300 == 1, "x").otherwise("")), "abc").alias("skip"))


@query("f7_path_mapping", O.with_(O.PATHS) + """SELECT rel_old, CASE WHEN length(rel_new) > 259 THEN old_name ELSE new_name END AS new_name, depth,
  CASE WHEN kind = 'file' AND depth > 1 THEN 'conflict_suffixed' ELSE 'renamed' END AS status, '' AS note, substr(sha256(rel_old || '|' || new_name), 1, 12) AS fingerprint FROM paths""")
def f7_path_mapping(spark, sf):
    plan = path_records(spark, sf).select(
        "kind", F.col("old_name").alias("name"), F.col("new_name").alias("final"), F.when(F.col("kind") == "dir", F.col("new_name")).otherwise(F.lit("other")).alias("desired"),
        "rel_old", "rel_new", "depth", F.regexp_replace("rel_old", "/?[^/]+$", "").alias("parent"),
        F.array(F.lit("person")).alias("categories"), F.array(F.col("new_name")).alias("tokens_used"))
    return PT.finish_plan(plan).select("rel_old", "new_name", "depth", "status", "note", "fingerprint")


MASKED_TREE = """actual AS (SELECT rel_new AS rel FROM paths WHERE kind = 'dir' UNION SELECT rel_new FROM paths WHERE kind = 'file' AND ord % 4 <> 0
  UNION SELECT split_part(rel_new, '/', 1) || '/readme' || (ord % 3) FROM paths WHERE kind = 'file')"""


def masked_files(spark, sf):
    p = path_records(spark, sf)
    return (p.filter("kind = 'file' and ord % 4 <> 0").select(F.col("rel_new").alias("path"))
            .unionByName(p.filter("kind = 'file'").select(F.concat(F.substring_index("rel_new", "/", 1), F.lit("/readme"), F.col("ord") % 3).alias("path")))).distinct()


@query("f8_unmask_missing", O.with_(O.PATHS, MASKED_TREE) + """SELECT rel_new, rel_old FROM paths WHERE status <> 'skipped' AND rel_new NOT IN (SELECT rel FROM actual WHERE rel IN
  (SELECT rel_new FROM paths WHERE kind = 'file') OR rel IN (SELECT split_part(rel_new, '/', 1) FROM paths WHERE kind = 'file'))""")
def f8_unmask_missing(spark, sf):
    return PT.unmask_paths(masked_files(spark, sf), path_records(spark, sf))[1].select("rel_new", "rel_old")


@query("f8_unmask_paths", O.with_(O.PATHS) + """SELECT rel_new, rel_old, CASE WHEN kind = 'file' AND (rank > 1) THEN replace(old_name, '.docx', '_' || (rank - 1) || '.docx') ELSE old_name END AS restored_name
  FROM (SELECT *, row_number() OVER (PARTITION BY split_part(rel_new, '/', 1), old_name, kind ORDER BY rel_new) AS rank FROM paths WHERE status <> 'skipped')""")
def f8_unmask_paths(spark, sf):
    p = path_records(spark, sf)
    all_files = p.filter("kind = 'file'").select(F.col("rel_new").alias("path")).unionByName(
        p.filter("kind = 'dir'").select(F.concat("rel_new", F.lit("/keep")).alias("path"))).distinct()
    return PT.unmask_paths(all_files, p)[0].select("rel_new", "rel_old", "restored_name")


@query("f9_diff_tree", O.with_(O.PATHS) + """, active AS (SELECT rel_new, min(rel_old) AS rel_old FROM paths WHERE status <> 'skipped' AND kind = 'dir' GROUP BY rel_new),
actual AS (SELECT rel_new AS rel FROM active UNION SELECT split_part(rel_new, '/', 1) || '/readme' || (ord % 3) FROM paths WHERE kind = 'file' UNION SELECT 'NATION_1/stray'),
expected AS (SELECT a.rel, coalesce(p.rel_old || substr(a.rel, length(p.rel_new) + 1), a.rel) AS want FROM actual a LEFT JOIN active p ON p.rel_new = split_part(a.rel, '/', 1))
SELECT 'extra' AS side, rel FROM (SELECT rel FROM actual EXCEPT SELECT want FROM expected) UNION ALL SELECT 'missing', want FROM (SELECT want FROM expected EXCEPT SELECT rel FROM actual)""")
def f9_diff_tree(spark, sf):
    p = path_records(spark, sf)
    actual = (p.filter("kind = 'dir'").select(F.col("rel_new").alias("rel"))
              .unionByName(p.filter("kind = 'file'").select(F.concat(F.substring_index("rel_new", "/", 1), F.lit("/readme"), F.col("ord") % 3).alias("rel")))
              .unionByName(spark.createDataFrame([("NATION_1/stray",)], "rel string")).distinct())
    return PT.diff_tree(actual, p.filter("kind = 'dir'"))


@query("f10_merge_paths", O.with_(O.PATHS) + "SELECT 'b1' AS batch_id, count(*) AS total_path_mappings FROM paths")
def f10_merge_paths(spark, sf):
    return FS.merge_paths(path_records(spark, sf), scratch(spark, "paths"), "b1")


# ---- G. aggregates ----------------------------------------------------------------------

def graded(spark, sf, mode="smart"):
    return grade(ledger_rows(spark, sf), mode)


GRADED = f"graded AS (SELECT *, {O.status('smart')} AS status FROM det)"


@query("g1_summary", O.with_(*LEDGER_DET, GRADED) + """SELECT (SELECT count(DISTINCT file) FROM ledger) AS total_input_files, count(*) FILTER (status = 'auto_mask') AS auto_masked_count,
  count(*) FILTER (status = 'suggest_mask') AS suggested_count, count(*) FILTER (status = 'hint_only') AS hint_count FROM graded""")
def g1_summary(spark, sf):
    return RP.report_summary(ledger(spark, sf).select("file"), graded(spark, sf))


@query("g2_status_overview", O.with_(O.LISTING, O.LEXICON, O.WORDS, PATH_NAMES, O.det("stems")) + f"""SELECT {O.status('smart')} AS status, count(*) AS n, count(*) AS from_paths FROM det WHERE {PATH_KEEP} GROUP BY 1""")
def g2_status_overview(spark, sf):
    return RP.status_overview(PT.detect_paths(listing(spark, sf), CFG, lexicon(spark, sf)))


@query("g3_type_distribution", O.with_(*LEDGER_DET) + "SELECT text_type, n, n * 100 // max(n) OVER () AS percent_of_max FROM (SELECT text_type, count(*) AS n FROM det GROUP BY 1)")
def g3_type_distribution(spark, sf):
    return RP.type_distribution(ledger_rows(spark, sf))


@query("g4_lexicon_stats", O.with_(O.LEXICON) + "SELECT category, count(word) AS words FROM lexicon GROUP BY ROLLUP (category)")
def g4_lexicon_stats(spark, sf):
    return RP.lexicon_stats(lexicon(spark, sf))


RANKED = """ranked AS (SELECT *, file_ord * 10000000000 + unit_ord * 1000 + row_number() OVER (PARTITION BY file, file_ord, unit_ord ORDER BY channel_ord, rule_ord, text) AS idx FROM det)"""


def ranked(spark, sf):
    """Detections with a selection: every third order's rows are selected."""
    from pyspark.sql import Window as W
    n = F.row_number().over(W.partitionBy(*KEY).orderBy("channel_ord", "rule_ord", "text"))
    return (ledger_rows(spark, sf).withColumn("idx", F.col("file_ord") * F.lit(10000000000) + F.col("unit_ord") * 1000 + n)
            .withColumn("selected", F.col("unit_ord") % 3 == 0).withColumn("origin_source", F.lit(""))
            .withColumn("llm_reason", F.when(F.col("unit_ord") % 5 == 0, "AI 检出：x").otherwise("")))


@query("g5_learn", O.with_(*LEDGER_DET, RANKED) + """SELECT text, arg_min(text_type, idx) AS category, max(source) AS sources, count(DISTINCT string_split(file, '/')[-1]) AS file_count, max(confidence) AS confidence,
  bool_or(unit_ord % 3 = 0) AS checked FROM ranked WHERE text NOT IN (SELECT s_name FROM supplier) GROUP BY text""")
def g5_learn(spark, sf):
    known = table(spark, sf, "supplier").select(F.col("s_name").alias("word"))
    return RV.learn_candidates(ranked(spark, sf), known)


EVAL = """expected AS (SELECT file_ord AS case_id, text, CASE WHEN file_ord % 4 = 0 THEN 'person' WHEN file_ord % 4 = 1 THEN NULL ELSE text_type END AS type FROM det WHERE length(text) % 5 <> 0
  UNION SELECT doc_id, 'missed-' || doc_id, 'custom' FROM documents WHERE lang = 'fr'),
p AS (SELECT DISTINCT file_ord AS case_id, text, text_type AS type FROM det),
cmp AS (SELECT coalesce(p.case_id, e.case_id) AS case_id, coalesce(p.text, e.text) AS text, p.type AS pred_type, e.type AS true_type,
  CASE WHEN p.text IS NULL THEN 'fn' WHEN e.text IS NULL THEN 'fp' ELSE 'tp' END AS outcome FROM p FULL JOIN expected e ON p.case_id = e.case_id AND p.text = e.text)"""


def compared(spark, sf):
    rows = D.detections(D.detect(document_units(spark, sf), MaskConfig()))
    preds = rows.select(F.col("file_ord").alias("case_id"), F.col("det_ord").alias("ord"), "text", F.col("text_type").alias("type"))
    kind = F.when(F.col("case_id") % 4 == 0, "person").when(F.col("case_id") % 4 != 1, F.col("type"))
    hit = preds.filter(F.length("text") % 5 != 0).select("case_id", "text", kind.alias("type"))
    miss = table(spark, sf, "documents").filter("lang = 'fr'").select(F.col("doc_id").alias("case_id"), F.concat(F.lit(" missed-"), "doc_id").alias("text"), F.lit("custom").alias("type"))
    return EV.compare(preds, hit.unionByName(miss).distinct())


@query("g6_evaluate", O.with_(*DOC_DET, EVAL) + """SELECT tp, fp, fn, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE CAST(0 AS DOUBLE) END AS f1, type_accuracy FROM (
  SELECT tp, fp, fn, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE CAST(0 AS DOUBLE) END AS precision, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE CAST(0 AS DOUBLE) END AS recall,
    CASE WHEN typed > 0 THEN CAST(ok AS DOUBLE) / typed ELSE CAST(0 AS DOUBLE) END AS type_accuracy FROM (
    SELECT count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn,
      count(*) FILTER (outcome = 'tp' AND true_type IS NOT NULL) AS typed, count(*) FILTER (outcome = 'tp' AND true_type = pred_type) AS ok FROM cmp))""")
def g6_evaluate(spark, sf):
    return EV.overall(compared(spark, sf))


@query("g6_per_case", O.with_(*DOC_DET, EVAL) + "SELECT case_id, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn FROM cmp GROUP BY 1")
def g6_per_case(spark, sf):
    return EV.per_case(compared(spark, sf))


@query("g7_fp_fn", O.with_(*DOC_DET, EVAL) + "SELECT case_id, outcome, CASE WHEN outcome = 'fn' AND text LIKE 'missed-%' THEN ' ' ELSE '' END || text AS text, coalesce(pred_type, true_type) AS type FROM cmp WHERE outcome <> 'tp'")
def g7_fp_fn(spark, sf):
    return EV.fp_fn_detail(compared(spark, sf))


@query("g8_nfkc", "SELECT conv_id, turn, trim(replace(replace(text, ' ', ' '), chr(10), chr(10))) || 'A1公司' AS norm FROM conversations")
def g8_nfkc(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", nfkc(F.concat(F.lit("　"), F.trim("text"), F.lit("Ａ１公司　"))).alias("norm"))


@query("g9_extraction", """SELECT file, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text) - length(replace(text, '�', ''))) AS BIGINT) AS replaced,
  count(*) >= 20 AND sum(length(text)) <= 30 * count(*) AS line_level, sum(length(text)) > 0 AND sum(length(text) - length(replace(text, '�', ''))) * 20 > sum(length(text)) AS undecodable
  FROM (SELECT source AS file, CASE WHEN source = 'src1' THEN replace(line, 'e', '�') ELSE line END AS text FROM (
    SELECT source, unnest(string_split(CASE WHEN source = 'src2' THEN replace(text, ' ', chr(10)) ELSE text END, chr(10))) AS line FROM documents)) WHERE regexp_matches(text, '[^\\s\\x{85}\\x{a0}\\x{3000}]') GROUP BY file""")
def g9_extraction(spark, sf):
    whole = F.when(F.col("source") == "src2", F.replace("text", F.lit(" "), F.lit("\n"))).otherwise(F.col("text"))  # words of src2 are lines
    lines = table(spark, sf, "documents").select("doc_id", "source", F.posexplode(F.split(whole, "\n", -1)).alias("i", "line"))
    text = F.when(F.col("source") == "src1", F.replace("line", F.lit("e"), F.lit("�"))).otherwise(F.col("line"))
    return RP.extraction_quality(units_from_table(lines, F.col("source"), F.col("doc_id"), F.col("i"), text))


@query("g10_metadata", O.with_(O.MAPPING) + "SELECT 'b1' AS batch_id, count(*) AS total_mappings, (SELECT count(DISTINCT o_custkey) FROM orders) AS input_files, '' AS created_at, 'smart' AS mode, 'token' AS style FROM mapping")
def g10_metadata(spark, sf):
    files = table(spark, sf, "orders").select(F.concat(F.lit("f/"), "o_custkey").alias("file"))
    return RP.mapping_metadata(token_mapping(spark, sf).withColumn("batch_id", F.lit("b1")), files, MaskConfig())


# ---- H. review --------------------------------------------------------------------------

REVIEW = f"SELECT {O.KEY}, text, confidence FROM det"


@query("h1_by_confidence", O.with_(*LEDGER_DET) + REVIEW)
def h1_by_confidence(spark, sf):
    return RV.by_confidence(ledger_rows(spark, sf)).select(*KEY, "text", "confidence")


@query("h2_manual_first", O.with_(O.LEDGER, O.LEXICON, O.WORDS, O.det("ledger", manual=("合同价",))) + f"SELECT {O.KEY}, text, source FROM det")
def h2_manual_first(spark, sf):
    rows = ledger_rows(spark, sf, MaskConfig(whitelist=WHITELIST, manual_words=("合同价",)))
    return RV.manual_first(rows).select(*KEY, "text", "source")


@query("h3_newest", "SELECT 'B' || o_orderkey AS batch_id, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders ORDER BY 2 DESC, 1 DESC LIMIT 50")
def h3_newest(spark, sf):
    return RV.newest(table(spark, sf, "orders").select(F.concat(F.lit("B"), "o_orderkey").alias("batch_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at")))


def new_words(spark, sf):
    """Words to merge: customers under `person` (all known), parts under `project` and a new category."""
    c = table(spark, sf, "customer").select(F.lit("person").alias("category"), F.concat(F.lit(" "), "c_name").alias("word"), F.col("c_custkey").alias("word_ord"))
    p = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 2 == 0, "project").otherwise("asset").alias("category"), F.col("p_name").alias("word"), F.col("p_partkey").alias("word_ord"))
    return c.unionByName(p)


NEW_WORDS = """new AS (SELECT 'person' AS category, c_name AS word FROM customer UNION ALL SELECT CASE WHEN p_partkey % 2 = 0 THEN 'project' ELSE 'asset' END, p_name FROM part),
added AS (SELECT DISTINCT category, word FROM new WHERE (category, word) NOT IN (SELECT (category, word) FROM lexicon))"""


@query("h4_merge_lexicon", O.with_(O.LEXICON, NEW_WORDS) + "SELECT category, word FROM lexicon UNION ALL SELECT category, word FROM added")
def h4_merge_lexicon(spark, sf):
    return L.merge_lexicon(lexicon(spark, sf), new_words(spark, sf))[0].select("category", "word")


@query("h4_merge_counts", O.with_(O.LEXICON, NEW_WORDS) + "SELECT (SELECT count(*) FROM added) AS added, (SELECT count(*) FROM new) - (SELECT count(*) FROM added) AS duplicates")
def h4_merge_counts(spark, sf):
    return L.merge_lexicon(lexicon(spark, sf), new_words(spark, sf))[1]


def base_words(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("word"), F.col("n_nationkey").cast("long").alias("ord"))


@query("h5_merge_whitelist", "SELECT n_name AS word FROM nation UNION SELECT p_name FROM part")
def h5_merge_whitelist(spark, sf):
    new = table(spark, sf, "part").select(F.concat("p_name", F.lit(" ")).alias("word"), F.col("p_partkey").alias("ord")).unionByName(base_words(spark, sf))
    return L.merge_whitelist(base_words(spark, sf), new)[0].select("word")


@query("h6_remove_whitelist", "SELECT DISTINCT c_name AS word FROM customer WHERE c_mktsegment <> 'BUILDING'")
def h6_remove_whitelist(spark, sf):
    base = table(spark, sf, "customer")
    return L.remove_whitelist(base.select(F.col("c_name").alias("word")), base.filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit(" "), "c_name").alias("word")))


@query("h7_exclude_unselected", O.with_(*LEDGER_DET) + "SELECT DISTINCT text AS word FROM det WHERE unit_ord % 3 <> 0 AND unit_ord % 5 <> 0")
def h7_exclude_unselected(spark, sf):
    return RV.exclude_unselected(ranked(spark, sf))


@query("h8_learned_words", O.with_(*LEDGER_DET) + "SELECT DISTINCT text_type AS category, text AS word FROM det WHERE unit_ord % 7 = 0")
def h8_learned_words(spark, sf):
    return RV.learned_words(ledger_rows(spark, sf).withColumn("learn", F.col("unit_ord") % 7 == 0))


@query("h9_filter", O.with_(*LEDGER_DET, GRADED) + f"SELECT {O.KEY}, text FROM graded WHERE text_type = 'custom' AND status = 'suggest_mask' AND source = 'regex'")
def h9_filter(spark, sf):
    return RV.filter_results(graded(spark, sf), type="custom", status="suggest_mask", source="regex").select(*KEY, "text")


@query("h10_search", O.with_(*LEDGER_DET) + f"""SELECT {O.KEY}, text FROM det WHERE contains(lower(text), 'customer#0000000') OR contains(lower(substr(body, greatest(1, strpos(body, text) - 50),
  strpos(body, text) + length(text) + 50 - greatest(1, strpos(body, text) - 50))), 'customer#0000000')""")
def h10_search(spark, sf):
    return RV.search_results(ledger_rows(spark, sf), "Customer#0000000").select(*KEY, "text")


@query("h11_default_selection", O.with_(*LEDGER_DET, GRADED) + f"SELECT {O.KEY}, text, CASE status WHEN 'auto_mask' THEN true WHEN 'suggest_mask' THEN unit_ord % 2 = 0 ELSE false END AS selected FROM graded")
def h11_default_selection(spark, sf):
    rows = graded(spark, sf)
    ai = D.is_ai_detected(F.when(F.col("unit_ord") % 2 == 1, "llm").otherwise(F.col("source")), F.lit(""), F.lit(""))
    return rows.select(*KEY, "text", RV.default_selection(F.col("status"), ai).alias("selected"))


@query("h12_bulk_select", O.with_(*LEDGER_DET, GRADED) + f"""SELECT op, {O.KEY}, text, CASE WHEN text_type = 'custom' THEN CASE op WHEN 'all' THEN true WHEN 'none' THEN false WHEN 'invert' THEN unit_ord % 3 <> 0
  WHEN 'auto_only' THEN status = 'auto_mask' ELSE status = 'suggest_mask' END ELSE unit_ord % 3 = 0 END AS selected FROM graded, (SELECT unnest(['all', 'none', 'invert', 'auto_only', 'suggest_only']) AS op)""")
def h12_bulk_select(spark, sf):
    rows = stage(grade(ledger_rows(spark, sf, positions=False), "smart").select(*KEY, "text", "text_type", "status", (F.col("unit_ord") % 3 == 0).alias("selected")))
    parts = [RV.bulk_select(rows, op, F.col("text_type") == "custom").select(F.lit(op).alias("op"), *KEY, "text", "selected")
             for op in ("all", "none", "invert", "auto_only", "suggest_only")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def conv_hits(spark, sf):
    """One detection per turn: its longest plain word, with five characters of context."""
    units = conversation_units(spark, sf)
    word = F.regexp_extract("text", "[A-Za-z]{4,}", 0)
    at = F.instr(F.col("text"), word)
    lo = F.greatest(F.lit(1), at - 5)
    rows = units.filter(F.regexp_extract("text", "[A-Za-z]{4,}", 0) != "").select(
        *KEY, word.alias("text"), F.substring(F.col("text"), lo, at + F.length(word) + 5 - lo).alias("context"))
    return units, rows


CONV_HITS = r"""hits AS (SELECT file, file_ord, unit_ord, w AS text, trim(substr(text, greatest(1, p - 5), p + length(w) + 5 - greatest(1, p - 5)), E' \n\t\r') AS ctx FROM (
  SELECT *, regexp_extract(text, '[A-Za-z]{4,}') AS w, strpos(text, regexp_extract(text, '[A-Za-z]{4,}')) AS p FROM convs) WHERE w <> ''),
located AS (SELECT h.file, h.file_ord, h.unit_ord, h.text, coalesce(CASE WHEN length(ctx) >= 8 THEN (SELECT min(c.unit_ord) FROM convs c WHERE c.file = h.file AND contains(c.text, h.ctx)) END,
  (SELECT min(c.unit_ord) FROM convs c WHERE c.file = h.file AND contains(c.text, h.text))) AS target FROM hits h)"""


@query("h13_kwic_locate", O.with_(O.CONVS, CONV_HITS) + "SELECT * FROM located")
def h13_kwic_locate(spark, sf):
    units, rows = conv_hits(spark, sf)
    return RV.kwic_locate(units, rows).select(*KEY, "text", "target")


@query("h14_neighbours", O.with_(O.CONVS) + """SELECT t.file, t.unit_ord AS target, c.unit_ord, CAST(abs(c.unit_ord - t.unit_ord) AS INTEGER) AS distance, abs(c.unit_ord - t.unit_ord) > 10 AS blurred, c.text
  FROM convs t JOIN convs c ON t.file = c.file AND c.unit_ord BETWEEN t.unit_ord - 13 AND t.unit_ord + 13""")
def h14_neighbours(spark, sf):
    units = conversation_units(spark, sf)
    return RV.kwic_neighbours(units, units.select("file", F.col("unit_ord").alias("target")))


@query("h15_file_key", O.with_(O.LISTING) + "SELECT path, CASE WHEN path LIKE 'ASIA/%' THEN substr(path, 6) ELSE string_split(path, '/')[-1] END AS key, string_split(path, '/')[-1] AS base FROM listing")
def h15_file_key(spark, sf):
    return listing(spark, sf).select("path", N.file_key(F.col("path"), "ASIA").alias("key"), N.file_key(F.col("path")).alias("base"))


# ---- J. streaming -----------------------------------------------------------------------

def document_stream(spark, sf):
    schema = table(spark, sf, "documents").schema
    # A pattern that only this name fits, as a stream does not take the path of one file; the table may be a file or a folder of files.
    d = spark.readStream.schema(schema).parquet(f"{sf}/document[s].parquet")
    return units_from_table(d, F.col("source"), F.col("doc_id"), F.lit(0), F.col("text"))


STARS = (*DOC_DET, O.spans("aggressive", ("auto_mask", "suggest_mask")), O.RESOLVE, O.rebuilt("docs", "'***'", "(SELECT '' AS original)"))


@query("j1_stream_stateless", O.with_(*STARS) + "SELECT file, file_ord, unit_ord, masked_text FROM masked")
def j1_stream_stateless(spark, sf):
    cfg = MaskConfig(mode="aggressive", statuses=("auto_mask", "suggest_mask"), irreversible=True)
    out = mask_stream_stateless(document_stream(spark, sf), cfg).select(*KEY, "masked_text")
    target, state = scratch(spark, "stream"), scratch(spark, "stream-state")
    run = out.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(target)


@query("j2_stream_reversible", O.with_(*DOC_MASK) + "SELECT file, file_ord, unit_ord, masked_text FROM masked")
def j2_stream_reversible(spark, sf):
    target, state, mapping = (scratch(spark, n) for n in ("stream", "stream-state", "stream-mapping"))
    mask_stream_reversible(document_stream(spark, sf), mapping, target, state, DOCS_LOUD).awaitTermination()
    return spark.read.parquet(target).select(*KEY, "masked_text")
