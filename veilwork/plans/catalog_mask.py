"""Registered queries: model-assisted detection, masking, restore and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.config import AssistConfig, MaskConfig
from veilwork.functions.spans import locate
from veilwork.functions.text import fuzzy_amount, normalize_text
from veilwork.operators import aliases as AL
from veilwork.operators import assist as AS
from veilwork.operators import audit as AU
from veilwork.operators import cells as C
from veilwork.operators import detect as D
from veilwork.operators import policy as P
from veilwork.operators import replace as R
from veilwork.operators import restore as RS
from veilwork.plans import structured as ST
from veilwork.operators import tokens as TK
from veilwork.plans import oracle as O
from veilwork.plans.catalog_detect import CFG, KEY, LEDGER_DET, formulas, ledger_detected, ledger_rows, lists
from veilwork.plans.inputs import (WHITELIST, conversation_units, document_units, ledger, lexicon, memo, path_records, table,
                                   token_mapping, tokened, whole_cells)
from veilwork.plans.mask import mask_units
from veilwork.plans.registry import query
from veilwork.session import deal, settle, stage

BOTH = ("auto_mask", "suggest_mask")
LOUD = MaskConfig(mode="aggressive", statuses=BOTH, whitelist=WHITELIST)
DOCS_LOUD = MaskConfig(mode="aggressive", statuses=BOTH)
DOC_DET = (O.DOCS, O.det("docs", dictionary=False, whitelist=False))


# ---- C. model-assisted detection --------------------------------------------------------

CAND = f"""cand AS (SELECT text, source, text_type, arg_min(confidence, (file_ord, unit_ord, channel_ord, rule_ord)) AS confidence, min((file_ord, unit_ord, channel_ord, rule_ord)) AS spot
  FROM det WHERE source NOT IN ('manual', 'llm') GROUP BY text, source, text_type)"""
# Candidates of one unit and rule are told apart by their place, then by text.
NUMBERED = """pos AS (SELECT c.*, d.p FROM cand c JOIN (SELECT file_ord, unit_ord, channel_ord, rule_ord, text, source, text_type, strpos(body, text) AS p FROM det) d
  ON c.text = d.text AND c.source = d.source AND c.text_type = d.text_type AND c.spot = (d.file_ord, d.unit_ord, d.channel_ord, d.rule_ord)),
numbered AS (SELECT *, n // 20 AS batch, CAST(n % 20 AS INTEGER) AS id FROM (
  SELECT *, row_number() OVER (ORDER BY spot, p, text, source, text_type) - 1 AS n FROM pos))"""


@query("c1_candidates", O.with_(*LEDGER_DET, CAND) + "SELECT text, source, text_type, confidence FROM cand")
def c1_candidates(spark, sf):
    return AS.adjudication_candidates(ledger_rows(spark, sf)).select("text", "source", "text_type", "confidence")


@query("c2_batches", O.with_(*LEDGER_DET, CAND, NUMBERED) + "SELECT batch, id, text, source, text_type FROM numbered")
def c2_batches(spark, sf):
    rows = ledger_rows(spark, sf).drop("context")  # no request is made, so no context is shuffled and staged
    return numbered(rows).select("batch", "id", "text", "source", "text_type")


def numbered(rows):
    return AS.number_candidates(AS.adjudication_candidates(rows))


def rule_client():
    """Stands for a model: its verdict follows from the length of the text and the id."""
    import json

    def answer(request: str) -> str:
        items = []
        for c in json.loads(request):
            kind = ("keep", "drop", "adjust", "bogus")[len(c["text"]) % 4]
            item = {"id": c["id"], "action": kind, "reason": f"r{c['id']}"}
            if kind == "adjust":
                item.update(confidence=[0.3, 0.99, 1.5][c["id"] % 3], type=["人名", "公司/企业", "unknown"][c["id"] % 3])
            items.append(item)
        body = json.dumps(items if len(items) % 2 else {"items": items}, ensure_ascii=False)
        return f"<think>hm {{}}</think>Here you are:\n```json\n{body}\n```"
    return answer


VERDICTS = """verdicts AS (SELECT text, source, text_type, CASE length(text) % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'drop' ELSE 'adjust' END AS action,
  CASE WHEN length(text) % 4 = 2 THEN [CAST(0.3 AS DOUBLE), CAST(0.99 AS DOUBLE)][id % 3 + 1] END AS new_confidence,
  CASE WHEN length(text) % 4 = 2 THEN ['person', 'company'][id % 3 + 1] END AS new_type, 'r' || id AS reason
  FROM numbered WHERE length(text) % 4 <> 3 AND NOT (length(text) % 4 = 2 AND id % 3 = 2))"""


def scored(rows):
    nums = settle(lambda: numbered(rows))
    return nums, AS.score_batches(AS.batch_requests(nums), rule_client)


def verdicts(rows):
    nums, answers = scored(rows)
    parsed = answers.select("batch", AS.parse_response("response").alias("json"))
    return AS.validate_verdicts(parsed, nums)


@query("c3_score_batches", O.with_(*LEDGER_DET, CAND, NUMBERED) + "SELECT batch, true AS answered, CAST(NULL AS VARCHAR) AS error FROM numbered GROUP BY batch")
def c3_score_batches(spark, sf):
    return scored(ledger_rows(spark, sf))[1].select("batch", F.col("response").isNotNull().alias("answered"), "error")


@query("c4_parse_response", """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN CAST(NULL AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END AS id FROM orders""")
def c4_parse_response(spark, sf):
    body = F.to_json(F.struct(F.array(F.struct(F.col("o_orderkey").alias("id"), F.lit("keep").alias("action"))).alias("items")))
    bare = F.to_json(F.array(F.struct(F.col("o_orderkey").alias("id"))))
    k = F.col("o_orderkey") % 6
    text = (F.when(k == 0, body).when(k == 1, F.concat(F.lit("<think>{\"items\":[]}</think> ok\n```json\n"), body, F.lit("\n``` bye")))
            .when(k == 2, bare).when(k == 3, F.concat(F.lit("noise {x} then "), body, F.lit(" more")))
            .when(k == 4, F.concat(F.lit("```\n"), bare, F.lit("```"))).otherwise(F.lit("<think>never closed {\"items\":[{\"id\":1}]}")))
    answers = table(spark, sf, "orders").select("o_orderkey", AS.parse_response(text).alias("json"))
    return answers.select("o_orderkey", F.get_json_object("json", "$.items[0].id").alias("id"))


@query("c5_validate", O.with_(*LEDGER_DET, CAND, NUMBERED, VERDICTS) + "SELECT * FROM verdicts")
def c5_validate(spark, sf):
    return verdicts(ledger_rows(spark, sf))


@query("c6_normalize_type", """SELECT p_partkey, ['person', 'company', 'company', NULL, 'custom', 'amount'][p_partkey % 6 + 1] AS type FROM part""")
def c6_normalize_type(spark, sf):
    raw = F.array(*[F.lit(x) for x in (" Person ", "公司/机构", "企业/工厂", "bogus", "EMAIL", "amount")])
    return table(spark, sf, "part").select("p_partkey", AS.normalize_type(F.element_at(raw, (F.col("p_partkey") % 6 + 1).cast("int"))).alias("type"))


APPLY = """applied AS (SELECT d.file, d.file_ord, d.unit_ord, d.text, d.source,
  CASE WHEN v.action = 'adjust' AND v.new_type <> d.text_type THEN v.new_type ELSE d.text_type END AS text_type,
  CASE WHEN v.action = 'drop' THEN CAST(0.40 AS DOUBLE) WHEN v.action = 'adjust' AND abs(least(v.new_confidence, d.confidence + CAST(0.05 AS DOUBLE)) - d.confidence) > 1e-9
    THEN least(v.new_confidence, d.confidence + CAST(0.05 AS DOUBLE)) ELSE d.confidence END AS confidence,
  CASE WHEN v.action = 'drop' THEN 'AI 复核建议剔除（原置信度 ' || printf('%.2f', d.confidence) || '）：' || v.reason
    WHEN v.action = 'keep' THEN 'AI 复核维持：' || v.reason
    WHEN v.action = 'adjust' THEN concat_ws(' ', CASE WHEN abs(least(v.new_confidence, d.confidence + CAST(0.05 AS DOUBLE)) - d.confidence) > 1e-9
        THEN 'AI 复核修正置信度 ' || printf('%.2f', d.confidence) || '→' || printf('%.2f', least(v.new_confidence, d.confidence + CAST(0.05 AS DOUBLE))) || '：' || v.reason END,
      CASE WHEN v.new_type <> d.text_type THEN 'AI 复核修正类别 ' || d.text_type || '→' || v.new_type || '：' || v.reason END)
    ELSE '' END AS llm_reason
  FROM det d LEFT JOIN verdicts v ON d.text = v.text AND d.source = v.source AND d.text_type = v.text_type)"""


@query("c7_apply_verdicts", O.with_(*LEDGER_DET, CAND, NUMBERED, VERDICTS, APPLY) + "SELECT * FROM applied")
def c7_apply_verdicts(spark, sf):
    rows = D.detections(settle(lambda: ledger_detected(spark, sf)))  # read by the review and by what its verdicts change
    out = AS.apply_verdicts(rows, settle(lambda: verdicts(rows)))
    return out.select(*KEY, "text", "source", "text_type", "confidence", "llm_reason")


def last_mark(t: str) -> str:
    """1-based place of the last sentence mark of the first 1500 characters, 0 if none."""
    marks = ["'。'", "'！'", "'？'", "chr(10)", "'；'"]
    return "greatest(" + ", ".join(f"CASE WHEN contains(left({t}, 1500), {m}) THEN 1501 - strpos(reverse(lpad(left({t}, 1500), 1500, ' ')), {m}) ELSE 0 END" for m in marks) + ")"


CHUNKS = f"""cuts AS (SELECT file, file_ord, unit_ord, CAST(-1 AS INTEGER) AS chunk_ord, CAST('' AS VARCHAR) AS chunk, text AS rest FROM docs
  UNION ALL SELECT file, file_ord, unit_ord, chunk_ord + 1, left(rest, n), substr(rest, n + 1) FROM (
    SELECT *, CASE WHEN length(rest) <= 1500 THEN length(rest) WHEN {last_mark('rest')} > 751 THEN {last_mark('rest')} ELSE 1500 END AS n FROM cuts WHERE rest <> '')),
chunks AS (SELECT file, file_ord, unit_ord, chunk_ord, chunk FROM cuts WHERE chunk_ord >= 0)"""


@query("c8_chunks", O.with_(O.DOCS, CHUNKS) + "SELECT * FROM chunks")
def c8_chunks(spark, sf):
    return AS.chunk_rows(document_units(spark, sf))


PROPOSED = """proposed AS (SELECT *, 0 AS p_ord, CASE WHEN file_ord % 7 = 6 THEN 'not in the text' ELSE regexp_extract(chunk, '[A-Za-z]{5,}') END AS text,
    [' 公司', 'person', 'bogus', '邮箱'][file_ord % 4 + 1] AS type, CASE WHEN file_ord % 13 = 12 THEN NULL ELSE CAST(file_ord % 13 AS DOUBLE) / 10 END AS confidence FROM chunks
  UNION ALL SELECT *, 1, regexp_extract(chunk, '[A-Za-z]{5,}'), 'location', CAST(0.7 AS DOUBLE) FROM chunks
  UNION ALL SELECT *, 2, regexp_extract(chunk, '[0-9]{16,19}'), 'custom', CAST(0.7 AS DOUBLE) FROM chunks)"""
ACCEPTED = """accepted AS (SELECT file, file_ord, unit_ord, text, text_type, 'llm' AS source, confidence, llm_reason FROM (
  SELECT *, row_number() OVER (PARTITION BY file, file_ord, unit_ord, text ORDER BY chunk_ord, p_ord) AS n FROM (
    SELECT file, file_ord, unit_ord, chunk_ord, p_ord, text, CASE trim(type) WHEN '公司' THEN 'company' WHEN 'person' THEN 'person' WHEN '邮箱' THEN 'custom' WHEN 'location' THEN 'location'
        WHEN 'custom' THEN 'custom' END AS text_type,
      least(greatest(coalesce(confidence, CAST(0.5 AS DOUBLE)), CAST(0 AS DOUBLE)), CAST(0.8 AS DOUBLE)) AS confidence, 'AI 检出：w' || file_ord AS llm_reason
    FROM proposed p WHERE text <> '' AND contains(chunk, text) AND NOT EXISTS (SELECT 1 FROM det d WHERE d.file_ord = p.file_ord AND d.text = p.text) AND text NOT IN ('ition'))
  WHERE text_type IS NOT NULL) WHERE n = 1)"""


def proposals(chunks):
    """Stands for a model: proposals follow from the chunk and the document number."""
    types = F.array(*[F.lit(x) for x in (" 公司", "person", "bogus", "邮箱")])
    word = F.regexp_extract("chunk", "[A-Za-z]{5,}", 0)
    doc = F.col("file_ord")
    first = F.struct(F.when(doc % 7 == 6, "not in the text").otherwise(word).alias("text"), F.element_at(types, (doc % 4 + 1).cast("int")).alias("type"),
                     F.when(doc % 13 != 12, (doc % 13).cast("double") / 10).alias("confidence"), F.concat(F.lit("w"), doc).alias("reason"))
    second = F.struct(word.alias("text"), F.lit("location").alias("type"), F.lit(0.7).alias("confidence"), F.concat(F.lit("w"), doc).alias("reason"))
    third = F.struct(F.regexp_extract("chunk", "[0-9]{16,19}", 0).alias("text"), F.lit("custom").alias("type"), F.lit(0.7).alias("confidence"), F.concat(F.lit("w"), doc).alias("reason"))
    answer = F.to_json(F.struct(F.array(first, second, third).alias("entities")))
    return AS.parse_proposals(chunks.select(*KEY, "chunk_ord", answer.alias("json")))


def accepted(spark, sf):
    units = document_units(spark, sf)
    chunks = AS.chunk_rows(units)
    listed = spark.createDataFrame([("ition",)], "word string")
    rules = D.detections(D.detect(units, DOCS_LOUD))
    return AS.accept_proposals(chunks, proposals(chunks), rules, listed)


@query("c9_accept_proposals", O.with_(*DOC_DET, CHUNKS, PROPOSED, ACCEPTED) + "SELECT * FROM accepted")
def c9_accept_proposals(spark, sf):
    return accepted(spark, sf).drop("context")


@query("c10_exclusions", O.with_(*LEDGER_DET) + f"SELECT DISTINCT text FROM det UNION SELECT unnest([{', '.join(repr(w) for w in WHITELIST)}])")
def c10_exclusions(spark, sf):
    listed = spark.createDataFrame([(w,) for w in WHITELIST], "word string")
    return AS.exclusion_set(ledger_rows(spark, sf), listed)


ROLE_COLS = f"SELECT {O.KEY}, text, text_type, source, confidence, llm_reason FROM"


@query("c11_roles", O.with_(*DOC_DET, CHUNKS, PROPOSED, ACCEPTED) + f"""SELECT 'detector' AS role, * FROM ({ROLE_COLS} accepted UNION ALL SELECT {O.KEY}, text, text_type, source, confidence, '' FROM det)
  UNION ALL SELECT 'both', {O.KEY}, text, text_type, source, CASE WHEN source = 'llm' THEN confidence ELSE CAST(0.40 AS DOUBLE) END,
    CASE WHEN source = 'llm' THEN llm_reason ELSE 'AI 复核建议剔除（原置信度 ' || printf('%.2f', confidence) || '）：x' END
  FROM ({ROLE_COLS} accepted UNION ALL SELECT {O.KEY}, text, text_type, source, confidence, '' FROM det)
  UNION ALL SELECT 'focused', {O.KEY}, text, text_type, source, confidence, '' FROM det""")
def c11_roles(spark, sf):
    rules = D.detections(D.detect(document_units(spark, sf), DOCS_LOUD))
    new = accepted(spark, sf)

    def drop_all(rows):
        return rows.filter(~F.col("source").isin("manual", "llm")).select("text", "source", "text_type").distinct().withColumns(
            {"action": F.lit("drop"), "new_confidence": F.lit(None).cast("double"), "new_type": F.lit(None).cast("string"), "reason": F.lit("x")})
    cols = [*KEY, "text", "text_type", "source", "confidence", "llm_reason"]
    parts = [AS.compose_roles(rules, AssistConfig(enabled=True, role=role), mode, drop_all, new).select(F.lit(label).alias("role"), *cols)
             for label, role, mode in (("detector", "detector", "smart"), ("both", "both", "smart"), ("focused", "both", "focused"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("c12_stats", O.with_(*LEDGER_DET, CAND, NUMBERED, VERDICTS) + """SELECT (SELECT count(DISTINCT batch) FROM numbered) AS calls, (SELECT count(*) FROM det) AS items_seen,
  (SELECT count(*) FROM verdicts) AS items_adjudicated, (SELECT count(*) FROM det d JOIN verdicts v USING (text, source, text_type) WHERE v.action = 'adjust') AS adjusted,
  (SELECT count(*) FROM det d JOIN verdicts v USING (text, source, text_type) WHERE v.action = 'drop') AS dropped,
  (SELECT count(*) FROM det d JOIN verdicts v USING (text, source, text_type)) - (SELECT count(*) FROM verdicts) AS cache_hits, CAST(0 AS BIGINT) AS detected, CAST(0 AS BIGINT) AS errors, '' AS first_error""")
def c12_stats(spark, sf):
    rows = D.detections(settle(lambda: ledger_detected(spark, sf)))  # read by the review and twice by the counters

    def judged():
        nums, answers = scored(rows)
        answers = stage(answers)  # no batch is asked twice
        return AS.validate_verdicts(answers.select("batch", AS.parse_response("response").alias("json")), nums), answers
    good, answers = settle(judged)
    none = spark.createDataFrame([], "text string")
    return AS.run_stats(rows, good, answers, none)


@query("c13_acceptance", """SELECT count(*) FILTER (o_orderkey % 3 = 0) AS ai_detected, count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0) AS ai_detected_accepted,
  count(*) FILTER (o_orderkey % 3 = 1) AS ai_dropped, count(*) FILTER (o_orderkey % 3 = 1 AND o_orderkey % 2 = 0) AS ai_dropped_overridden FROM orders""")
def c13_acceptance(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    rows = o.select(k.alias("idx"), F.when(k % 3 == 0, "llm").otherwise("regex").alias("source"), F.lit("").alias("origin_source"),
                    F.when(k % 3 == 1, "AI 复核建议剔除（原置信度 0.65）：x").otherwise("").alias("llm_reason"))
    return AS.ai_acceptance(rows, o.select(k.alias("idx"), (k % 2 == 0).alias("selected")))


# ---- D. policy, spans, tokens, replacement ----------------------------------------------

def policy_query(mode):
    def run(spark, sf):
        return P.grade(ledger_rows(spark, sf, positions=False), mode).select(*KEY, "text", "confidence", "status")
    return run


for _mode in ("focused", "strict", "smart", "aggressive"):
    query(f"d1_policy_{_mode}", O.with_(*LEDGER_DET) + f"SELECT {O.KEY}, text, confidence, {O.status(_mode)} AS status FROM det")(policy_query(_mode))

ALLOWED = "allowed AS (SELECT c_name AS text FROM customer WHERE c_mktsegment <> 'BUILDING')"


def allowed(spark, sf):
    return table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_name").alias("text"))


@query("d2_actionable", O.with_(*LEDGER_DET, ALLOWED) + f"SELECT {O.KEY}, text FROM det WHERE {O.status('smart')} = 'auto_mask' AND text IN (SELECT text FROM allowed)")
def d2_actionable(spark, sf):
    return P.filter_actionable(P.grade(ledger_rows(spark, sf, positions=False), "smart"), allowed=allowed(spark, sf)).select(*KEY, "text")


@query("d3_confirm_audit", O.with_(*LEDGER_DET, ALLOWED) + f"SELECT DISTINCT text, source FROM det WHERE {O.status('smart')} = 'auto_mask' AND text NOT IN (SELECT text FROM allowed)")
def d3_confirm_audit(spark, sf):
    return P.confirm_filtered(P.grade(ledger_rows(spark, sf, positions=False), "smart"), allowed(spark, sf))


LOUD_SPANS = (*LEDGER_DET, O.spans("aggressive", BOTH))


@query("d4_locate", O.with_(*LOUD_SPANS) + f"SELECT {O.KEY}, text, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\" FROM spans")
def d4_locate(spark, sf):
    hits = ledger_detected(spark, sf, LOUD).withColumn("hits", R.actionable_hits(F.col("hits"), LOUD))
    return (hits.select(*KEY, F.explode_outer(locate(F.col("text"), F.col("hits"))).alias("s")).filter("s is not null")
            .select(*KEY, "s.text", "s.start", "s.end"))


SPAN_COLS = "CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\", text, text_type AS type, confidence"


def resolved(spark, sf, cfg=LOUD):
    return R.resolved_units(ledger_detected(spark, sf, cfg, positions=False), cfg)


@query("d5_resolve", O.with_(*LOUD_SPANS, O.RESOLVE) + f"SELECT {O.KEY}, {SPAN_COLS} FROM kept")
def d5_resolve(spark, sf):
    return (resolved(spark, sf).select(*KEY, F.explode_outer("kept").alias("s")).filter("s is not null")
            .select(*KEY, "s.start", "s.end", "s.text", "s.type", "s.confidence"))


@query("d6_dropped", O.with_(*LOUD_SPANS, O.RESOLVE) + f"SELECT {O.KEY}, {SPAN_COLS} FROM dropped")
def d6_dropped(spark, sf):
    return R.dropped_overlaps(stage(resolved(spark, sf).select(*KEY, "dropped"))).select(*KEY, "start", "end", "text", "type", "confidence")


MEMO_SPANS = (O.MEMO, O.LEXICON, O.WORDS, O.det("memo"), O.spans("smart"), O.RESOLVE, O.FIRST)
RESERVED = r"""reserved AS (SELECT DISTINCT lower(regexp_extract(tok, '\[([A-Z]+)_', 1)) AS type, CAST(regexp_extract(tok, '_([0-9]+)', 1) AS BIGINT) AS n, tok
  FROM (SELECT unnest(regexp_extract_all(text, '\[(?:COMPANY|GOVERNMENT|PERSON|PROJECT|SUBJECT|LOCATION|AMOUNT|CUSTOM)_[0-9]{3,}\]')) AS tok FROM memo)),
free AS (SELECT type, n, row_number() OVER (PARTITION BY type ORDER BY n) AS k FROM (
  SELECT type, unnest(range(1, 2 * c + 2 + (SELECT count(*) FROM reserved))) AS n FROM (SELECT type, count(*) AS c FROM firsts GROUP BY type)) f
  WHERE NOT EXISTS (SELECT 1 FROM reserved r WHERE r.tok = printf('[%s_%03d]', upper(f.type), f.n))),
alloc AS (SELECT f.original, f.type, f.confidence, f.source, printf('[%s_%03d]', upper(f.type), n) AS token FROM (
  SELECT *, row_number() OVER (PARTITION BY type ORDER BY spot) AS k FROM firsts) f JOIN free USING (type, k))"""


@query("d7_allocate_tokens", O.with_(*LOUD_SPANS, O.RESOLVE, O.FIRST, O.ALLOC) + "SELECT original, type, token FROM alloc")
def d7_allocate_tokens(spark, sf):
    first = stage(TK.first_uses(R.token_spans(resolved(spark, sf), LOUD)))
    return TK.allocate_tokens(first).select("original", "type", "token")


@query("d7_reserved_tokens", O.with_(*MEMO_SPANS, RESERVED) + "SELECT original, type, token FROM alloc")
def d7_reserved_tokens(spark, sf):
    run = mask_units(memo(spark, sf), CFG, lexicon(spark, sf))
    return run.mapping.select("original", "type", "token")


@query("d8_scan_tokens", O.with_(O.MEMO) + r"SELECT DISTINCT unnest(regexp_extract_all(text, '\[(?:COMPANY|LOCATION)_[0-9]{3,}\]')) AS token FROM memo")
def d8_scan_tokens(spark, sf):
    return TK.scan_tokens(memo(spark, sf))


POOLS = "pool AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS type, unnest(range(0, {len(AL.AliasPools().words(t))})) AS ord, unnest([{', '.join(repr(w) for w in AL.AliasPools().words(t))}]) AS alias" for t in AL.ALIAS_TYPES) + ")"


LETTERED = """SELECT CAST(p_partkey AS BIGINT) AS part, chr(CAST(65 + l AS INTEGER)) || p_brand AS alias, CAST(l AS INTEGER) AS ord FROM part, range(0, 26) t(l)"""


@query("d9_alias_pool", LETTERED)
def d9_alias_pool(spark, sf):
    """Letter-before-suffix expansion with brands as suffixes."""
    letters = F.array(*[F.lit(c) for c in AL.LETTERS])
    return table(spark, sf, "part").select(F.col("p_partkey").alias("part"), "p_brand", F.posexplode(letters).alias("ord", "letter")).select(
        "part", F.concat("letter", "p_brand").alias("alias"), "ord")


@query("d10_avoidance", O.with_(O.LEDGER, POOLS) + "SELECT DISTINCT alias FROM pool WHERE EXISTS (SELECT 1 FROM ledger WHERE contains(text, alias))")
def d10_avoidance(spark, sf):
    return AL.words_in_corpus(ledger(spark, sf), AL.pool_table(spark))


ALIASED = """usable AS (SELECT type, alias, row_number() OVER (PARTITION BY type ORDER BY ord) AS k FROM pool WHERE NOT EXISTS (SELECT 1 FROM ledger WHERE contains(text, alias))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY type, type <> 'amount' AND NOT (type = 'custom' AND source = 'regex') ORDER BY spot) AS k FROM firsts),
named AS (SELECT r.original, r.type, r.spot, u.alias FROM ranked r LEFT JOIN usable u ON r.type = u.type AND r.k = u.k AND r.type <> 'amount' AND NOT (r.type = 'custom' AND r.source = 'regex')),
alloc AS (SELECT original, type, coalesce(alias, printf('[%s_%03d]', upper(type), row_number() OVER (PARTITION BY type, alias IS NULL ORDER BY spot))) AS token FROM named)"""


@query("d11_aliases", O.with_(*LEDGER_DET, O.spans("smart"), O.RESOLVE, O.FIRST, POOLS, ALIASED) + "SELECT original, type, token FROM alloc")
def d11_aliases(spark, sf):
    run = mask_units(ledger(spark, sf), MaskConfig(style="alias", whitelist=WHITELIST), lexicon(spark, sf))
    return run.mapping.select("original", "type", "token")


@query("d12_exhausted", O.with_(*LEDGER_DET, O.spans("smart"), O.RESOLVE, O.FIRST, POOLS, ALIASED) + """SELECT type, originals FROM (
  SELECT type, count(*) AS originals FROM firsts WHERE type <> 'amount' AND NOT (type = 'custom' AND source = 'regex') GROUP BY type) f
  WHERE originals > (SELECT count(*) FROM usable u WHERE u.type = f.type)""")
def d12_exhausted(spark, sf):
    units = ledger(spark, sf)
    pool = AL.pool_table(spark)
    seen = AL.words_in_corpus(units, pool)
    usable = pool.join(seen, "alias", "left_anti").groupBy("type").agg(F.count(F.lit(1)).alias("words"))
    first = TK.first_uses(R.token_spans(resolved(spark, sf, CFG), CFG))
    return AL.exhausted_categories(first, usable)


FUZZY = r"""CASE WHEN regexp_matches({t}, '[0-9]亿元|[0-9]\.?[0-9]*亿元') THEN regexp_replace({t}, '([0-9]+)\.?[0-9]*亿元', '\1亿+', 'g')
  WHEN contains({t}, '万元') THEN regexp_replace({t}, '([0-9]+)\.?[0-9]*万元', '\1万+', 'g')
  ELSE regexp_replace({t}, '([0-9][0-9,]*)\.?[0-9]*元', '\1元+', 'g') END"""
FUZZY_CFG = MaskConfig(mode="smart", statuses=BOTH, amount_mode="fuzzy", whitelist=WHITELIST)
SMART_ALL = (*LEDGER_DET, O.spans("smart", BOTH), O.RESOLVE)
# Amounts take no number in this mode.
FIRST_NO_AMOUNT = O.FIRST.replace("FROM kept GROUP", "FROM kept WHERE text_type <> 'amount' GROUP")
FUZZY_NEW = f"CASE WHEN k.text_type = 'amount' THEN {FUZZY.replace('{t}', 'k.text')} ELSE a.token END"


@query("d13_replacements", O.with_(*SMART_ALL, FIRST_NO_AMOUNT, O.ALLOC, O.rebuilt("ledger", FUZZY_NEW)) +
       f"SELECT {O.KEY}, CAST(s AS INTEGER) AS start, text, new_text FROM reps")
def d13_replacements(spark, sf):
    res = stage(resolved(spark, sf, FUZZY_CFG).select(*KEY, "kept"))
    allocated = TK.allocate_tokens(stage(TK.first_uses(R.token_spans(res, FUZZY_CFG))))
    return R.build_replacements(res, allocated, FUZZY_CFG).select(*KEY, "start", "text", "new_text")


@query("d14_fuzzy", f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (c // 100) || '元+' WHEN 1 THEN (1000 + c % 1000) || '元+' WHEN 2 THEN (c // 1000000) || '万+' ELSE (c // 10000000) || '亿+' END AS fuzzy
  FROM (SELECT o_orderkey, {O.CENTS} AS c FROM orders)""")
def d14_fuzzy(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "cast(round(o_totalprice * 100) as bigint) c")
    text = F.expr("""case o_orderkey % 4 when 0 then concat(c div 100, '.', lpad(cast(c % 100 as string), 2, '0'), '元')
        when 1 then concat('1,', lpad(cast(c % 1000 as string), 3, '0'), '.5元') when 2 then concat(c div 1000000, '.2万元') else concat(c div 10000000, '.7亿元') end""")
    return o.select("o_orderkey", fuzzy_amount(text).alias("fuzzy"))


@query("d15_apply", O.with_(*LOUD_SPANS, O.RESOLVE, O.rebuilt("ledger", "'***'", "(SELECT '' AS original)")) + "SELECT file, file_ord, unit_ord, masked_text FROM masked")
def d15_apply(spark, sf):
    cfg = MaskConfig(mode="aggressive", statuses=BOTH, whitelist=WHITELIST, irreversible=True)
    return R.apply_plain(ledger_detected(spark, sf, cfg, positions=False), cfg).select(*KEY, "masked_text")


@query("d16_mapping", O.with_(*LOUD_SPANS, O.RESOLVE, O.FIRST, O.ALLOC) + """SELECT token, original, type, confidence, 'b7' AS batch_id, substr(sha256(original), 1, 8) AS fingerprint, 'text' AS kind FROM alloc""")
def d16_mapping(spark, sf):
    cfg = MaskConfig(mode="aggressive", statuses=BOTH, whitelist=WHITELIST, batch_id="b7")
    return mask_units(ledger(spark, sf), cfg, lexicon(spark, sf)).mapping.drop("created_at")


@query("d17_mask_ledger", O.with_(*LOUD_SPANS, O.RESOLVE, O.FIRST, O.ALLOC, O.rebuilt("ledger")) + "SELECT file, file_ord, unit_ord, text, masked_text FROM masked")
def d17_mask_ledger(spark, sf):
    return mask_units(ledger(spark, sf), LOUD, lexicon(spark, sf)).masked


DOC_MASK = (*DOC_DET, O.spans("aggressive", BOTH), O.RESOLVE, O.FIRST, O.ALLOC, O.rebuilt("docs"))


@query("d17_mask_documents", O.with_(*DOC_MASK) + "SELECT file, file_ord, unit_ord, text, masked_text FROM masked")
def d17_mask_documents(spark, sf):
    return mask_units(document_units(spark, sf), DOCS_LOUD).masked


@query("d17_mask_confirmed", O.with_(*LEDGER_DET, ALLOWED, O.spans("smart").replace("WHERE", "WHERE text IN (SELECT text FROM allowed) AND", 1), O.RESOLVE, O.FIRST, O.ALLOC, O.rebuilt("ledger")) +
       "SELECT file, file_ord, unit_ord, masked_text FROM masked")
def d17_mask_confirmed(spark, sf):
    run = mask_units(ledger(spark, sf), CFG, lexicon(spark, sf), allowed=allowed(spark, sf))
    return run.masked.select(*KEY, "masked_text")


@query("d18_run_rewrite", """SELECT conv_id, turn, CAST(i AS INTEGER) AS run, CASE WHEN i = 0 THEN replace(text, ' ', '_') ELSE '' END AS new_text FROM (
  SELECT conv_id, turn, text, unnest(range(0, len(string_split(text, ' ')))) AS i FROM conversations)""")
def d18_run_rewrite(spark, sf):
    c = table(spark, sf, "conversations")
    runs = c.select("conv_id", "turn", F.posexplode(F.split("text", " ", -1)).alias("run", "piece"))
    done = c.select("conv_id", "turn", F.replace("text", F.lit(" "), F.lit("_")).alias("masked_text"))
    return R.run_rewrite(runs, done, ["conv_id", "turn"], "run").select("conv_id", "turn", "run", "new_text")


def numeric_sql() -> str:
    from veilwork.plans.catalog_detect import RULE_OUT, rules_sql
    return O.with_(O.WHOLES, f"ruled AS (SELECT cell, canon, {RULE_OUT} FROM ({rules_sql('wholes')}))", """act AS (SELECT * FROM ruled WHERE confidence >= CAST(0.85 AS DOUBLE)),
tok AS (SELECT canon, printf('[%s_%03d]', upper(type), row_number() OVER (PARTITION BY type ORDER BY spot)) AS token FROM (SELECT canon, arg_min(text_type, cell) AS type, min(cell) AS spot FROM act GROUP BY canon))""") + """
SELECT r.cell, coalesce(t.token, r.canon) AS masked_value, CASE WHEN t.token IS NOT NULL THEN 'token' WHEN length(r.canon) >= 16 THEN 'text' ELSE 'number' END AS stored_as
FROM ruled r LEFT JOIN tok t ON r.canon = t.canon AND r.confidence >= CAST(0.85 AS DOUBLE)"""


@query("d19_numeric_column", numeric_sql())
def d19_numeric_column(spark, sf):
    cells = whole_cells(spark, sf).select(F.lit("w").alias("file"), F.lit(0).cast("long").alias("file_ord"), F.col("cell").alias("unit_ord"), "value", "number_format")
    return C.mask_numeric_column(cells, CFG)[0].select(F.col("unit_ord").alias("cell"), "masked_value", "stored_as")


@query("d20_literals", "SELECT c_custkey, '=IF(A1=\"***\",\"say \"\"***\"\"\",B' || c_custkey || ')' AS new_formula FROM customer JOIN nation ON c_nationkey = n_nationkey")
def d20_literals(spark, sf):
    cells = formulas(spark, sf).select("c_custkey", "c_name", "n_name", "formula")
    child = C.literal_units(cells, "formula", ["c_custkey"]).join(cells.select("c_custkey", "c_name", "n_name"), "c_custkey")
    done = child.select("c_custkey", "child_ord", F.replace(F.replace("text", F.col("c_name"), F.lit("***")), F.col("n_name"), F.lit("***")).alias("new_text"))
    return C.rebuild_literals(cells, done, "formula", ["c_custkey"]).select("c_custkey", "new_formula")


@query("d20_list_items", """SELECT c_custkey, '"***,' || n_name || ',' || c_mktsegment || '"' AS new_items FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def d20_list_items(spark, sf):
    cells = lists(spark, sf)
    first = C.list_item_units(cells, "items", ["c_custkey"]).filter("child_ord = 0").select("c_custkey", "child_ord", F.lit("***").alias("new_text"))
    return C.rebuild_list(cells, first, "items", ["c_custkey"]).select("c_custkey", "new_items")


@query("d21_clear_identity", "SELECT s_suppkey, '' AS author, '' AS last_modified_by, s_acctbal FROM supplier")
def d21_clear_identity(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("author"), F.col("s_name").alias("last_modified_by"), "s_acctbal")
    return R.clear_identity_columns(s)


@query("d22_normalize", r"""SELECT conv_id, turn, trim(regexp_replace(translate(text || '　ＡＢ０９ｚ', 'ＡＢ０９ｚ', 'AB09z'), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS plain FROM conversations""")
def d22_normalize(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", normalize_text(F.concat("text", F.lit("　ＡＢ０９ｚ"))).alias("plain"))


CELLS20 = """cells20 AS (SELECT c_custkey, 'IF(A1="' || c_name || '","say ""hi"" to ' || c_name || '",0)' AS formula, '"' || c_name || ',yes,' || c_mktsegment || '"' AS list,
  printf('[PERSON_%03d]', row_number() OVER (ORDER BY c_custkey)) AS token FROM customer)"""


def cells20(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit('IF(A1="'), "c_name", F.lit('","say ""hi"" to '), "c_name", F.lit('",0)')).alias("formula"),
        F.concat(F.lit('"'), "c_name", F.lit(",yes,"), "c_mktsegment", F.lit('"')).alias("list"))


def customer_lexicon(spark, sf):
    return table(spark, sf, "customer").select(F.lit("person").alias("category"), F.lit(2).alias("cat_ord"), F.col("c_name").alias("word"), F.col("c_custkey").alias("word_ord"))


@query("d20_mask_formulas", O.with_(CELLS20) + """SELECT c_custkey, 'IF(A1="' || token || '","say ""hi"" to ' || token || '",0)' AS masked, formula AS restored FROM cells20""")
def d20_mask_formulas(spark, sf):
    """Literals of a formula masked in place, and restored."""
    masked, run = ST.mask_quoted_literals(cells20(spark, sf), "formula", ["c_custkey"], "c_custkey", MaskConfig(mode="smart"), lexicon=customer_lexicon(spark, sf))
    masked = masked.select("c_custkey", F.col("new_formula").alias("masked"))
    return ST.restore_parts(masked, "masked", ["c_custkey"], "c_custkey", "literals", run.mapping).select("c_custkey", "masked", F.col("new_masked").alias("restored"))


@query("d20_mask_lists", O.with_(CELLS20) + """SELECT c_custkey, replace(list, c_name, token) AS masked, list AS restored FROM cells20 JOIN customer USING (c_custkey)""")
def d20_mask_lists(spark, sf):
    """Items of a quoted list masked in place, and restored."""
    masked, run = ST.mask_list_items(cells20(spark, sf), "list", ["c_custkey"], "c_custkey", MaskConfig(mode="smart"), lexicon=customer_lexicon(spark, sf))
    masked = masked.select("c_custkey", F.col("new_list").alias("masked"))
    return ST.restore_parts(masked, "masked", ["c_custkey"], "c_custkey", "list", run.mapping).select("c_custkey", "masked", F.col("new_masked").alias("restored"))


# ---- E. restore and audit ---------------------------------------------------------------

RESTORED = """restored AS (SELECT t.*, replace(replace(t.text, p.token, p.original), a.token, a.original) AS back FROM tokened t
  LEFT JOIN mapping p ON p.token = printf('[PERSON_%03d]', t.file_ord + 1) LEFT JOIN mapping a ON a.token = printf('[AMOUNT_%03d]', t.unit_ord + 1))"""


@query("e1_unmask", O.with_(O.TOKENED, O.MAPPING, RESTORED) + f"SELECT {O.KEY}, back AS restored, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 2 END AS n_hits FROM restored")
def e1_unmask(spark, sf):
    return RS.unmask_tokens(tokened(spark, sf), token_mapping(spark, sf)).select(*KEY, "restored", F.size("hits").alias("n_hits"))


SMALL_MAP = "small AS (SELECT n_name AS token, r_name AS original FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query("e1_unmask_inline", O.with_(O.LEDGER, SMALL_MAP) + f"""SELECT {O.KEY}, replace(text, token, original) AS restored FROM (
  SELECT l.*, regexp_extract(text, 'NATION_[0-9]+') AS token FROM ledger l) JOIN small USING (token)""")
def e1_unmask_inline(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    pairs = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("token"), F.col("r_name").alias("original"))
    return RS.unmask(ledger(spark, sf), pairs).select(*KEY, "restored")


NESTED = """keys AS (SELECT c_custkey, printf('[PERSON_%03d]_1', c_custkey) AS k1, c_name || ' of <' || printf('[AMOUNT_%03d]', c_custkey) || '>' AS v1,
    printf('[AMOUNT_%03d]', c_custkey) AS k2, c_mktsegment AS v2, printf('[PERSON_%03d]', c_custkey) AS k3, c_name AS v3 FROM customer),
  nested AS (SELECT o_orderkey, c_custkey, 'see ' || printf('[PERSON_%03d]_1', c_custkey) || ' and [' || printf('[PERSON_%03d]', c_custkey) || ']_' || o_orderkey || ' or ' ||
    printf('[AMOUNT_%03d]', o_orderkey) || CASE WHEN o_orderkey % 3 = 0 THEN printf('[AMOUNT_%03d]', c_custkey) ELSE ' ' END AS text FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query("e1_unmask_nested", f"""WITH {NESTED} SELECT o_orderkey AS unit_ord, replace(replace(replace(replace(text, a.k1, a.v1), a.k2, a.v2), coalesce(b.k2, a.k2), coalesce(b.v2, a.v2)), a.k3, a.v3) AS restored
  FROM nested JOIN keys a USING (c_custkey) LEFT JOIN keys b ON b.c_custkey = o_orderkey""")
def e1_unmask_nested(spark, sf):
    """Keys within keys, and originals that hold a key whose turn is still to come."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    key = lambda form, column: F.format_string(form, column)
    mapping = c.select(F.explode(F.array(
        F.struct(key("[PERSON_%03d]_1", "c_custkey").alias("token"), F.concat("c_name", F.lit(" of <"), key("[AMOUNT_%03d]", "c_custkey"), F.lit(">")).alias("original")),
        F.struct(key("[AMOUNT_%03d]", "c_custkey").alias("token"), F.col("c_mktsegment").alias("original")),
        F.struct(key("[PERSON_%03d]", "c_custkey").alias("token"), F.col("c_name").alias("original")))).alias("m")).select("m.*")
    text = F.concat(F.lit("see "), key("[PERSON_%03d]_1", "c_custkey"), F.lit(" and ["), key("[PERSON_%03d]", "c_custkey"), F.lit("]_"), "o_orderkey", F.lit(" or "),
                    key("[AMOUNT_%03d]", "o_orderkey"), F.when(F.col("o_orderkey") % 3 == 0, key("[AMOUNT_%03d]", "c_custkey")).otherwise(" "))
    orders = deal(o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_custkey"), o.count())
    units = orders.select(F.lit("f").alias("file"), F.lit(0).cast("long").alias("file_ord"), F.col("o_orderkey").alias("unit_ord"), text.alias("text"))
    return RS.unmask(units, mapping).select("unit_ord", "restored")


@query("e2_restore_value", O.with_(O.MAPPING) + f"""SELECT o_orderkey AS cell, CASE o_orderkey % 3 WHEN 0 THEN '' ELSE '共' END || original || CASE o_orderkey % 3 WHEN 2 THEN '元' ELSE '' END AS restored,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(original AS DOUBLE) END AS value_double FROM orders JOIN mapping ON token = printf('[AMOUNT_%03d]', o_orderkey + 1)""")
def e2_restore_value(spark, sf):
    text = F.expr("concat(case o_orderkey % 3 when 0 then '' else '共' end, format_string('[AMOUNT_%03d]', o_orderkey + 1), case o_orderkey % 3 when 2 then '元' else '' end)")
    cells = table(spark, sf, "orders").select(F.lit("c").alias("file"), F.lit(0).cast("long").alias("file_ord"), F.col("o_orderkey").alias("unit_ord"), text.alias("text"))
    return RS.restore_value(cells, token_mapping(spark, sf)).select(F.col("unit_ord").alias("cell"), "restored", "value_double")


@query("e3_bracket_gate", O.with_(O.MAPPING) + "SELECT bool_and(contains(token, '[')) AS gate FROM mapping")
def e3_bracket_gate(spark, sf):
    return RS.bracket_gate(token_mapping(spark, sf))


@query("e4_residual", O.with_(O.TOKENED, O.MAPPING) + "SELECT DISTINCT file, printf('[PERSON_%03d]', file_ord + 1) AS token FROM tokened WHERE o_orderstatus <> 'P' UNION SELECT file, printf('[AMOUNT_%03d]', unit_ord + 1) FROM tokened WHERE o_orderstatus <> 'P'")
def e4_residual(spark, sf):
    """Run on the masked text itself: everything mapped is still there."""
    return AU.residual_tokens(tokened(spark, sf), token_mapping(spark, sf)).select("file", "token")


@query("e5_foreign", O.with_(O.TOKENED) + "SELECT DISTINCT file, '[SUBJECT_007]' AS token FROM tokened")
def e5_foreign(spark, sf):
    return AU.foreign_tokens(tokened(spark, sf), token_mapping(spark, sf)).select("file", "token")


@query("e6_residual_aliases", O.with_(O.LEDGER) + """SELECT DISTINCT file, alias FROM ledger JOIN (SELECT n_name AS alias FROM nation UNION SELECT c_name FROM customer) ON contains(text, alias)""")
def e6_residual_aliases(spark, sf):
    keys = (table(spark, sf, "nation").select(F.col("n_name").alias("token"))
            .unionByName(table(spark, sf, "customer").select(F.col("c_name").alias("token"))).unionByName(token_mapping(spark, sf).select("token")))
    return AU.residual_aliases(ledger(spark, sf), keys)


@query("e7_zero_hit_files", O.with_(O.TOKENED) + "SELECT file FROM tokened GROUP BY file HAVING bool_and(o_orderstatus = 'P')")
def e7_zero_hit_files(spark, sf):
    mapping = token_mapping(spark, sf)
    return AU.zero_hit_files(RS.unmask_tokens(tokened(spark, sf), mapping), mapping)


@query("e8_fingerprints", O.with_(O.MAPPING) + """SELECT token, CASE WHEN length(original) % 3 = 0 THEN 'legacy' WHEN length(original) % 3 = 1 THEN 'mismatch' ELSE 'ok' END AS state FROM mapping""")
def e8_fingerprints(spark, sf):
    k = F.length("original") % 3
    fp = F.when(k == 0, F.lit("")).when(k == 1, F.lit("00000000")).otherwise(F.substring(F.sha2("original", 256), 1, 8))
    return AU.verify_fingerprints(token_mapping(spark, sf).withColumn("fingerprint", fp))


CAND_NAMES = O.PATHS + """,
names AS (SELECT DISTINCT string_split(rel_new, '/')[-1] AS name FROM paths UNION SELECT c_name || '_masked.docx' FROM customer),
latest AS (SELECT new_name, arg_max(old_name, (ord, old_name)) AS old_name FROM paths WHERE new_name <> '' GROUP BY new_name),
hops AS (SELECT name, name AS candidate, 0 AS h FROM names UNION ALL SELECT h.name, l.old_name, h + 1 FROM hops h JOIN latest l ON h.candidate = l.new_name WHERE h < 3),
cands AS (SELECT name, candidate FROM hops UNION SELECT name, regexp_replace(candidate, '_masked(\\.[^.]*)$', '\\1') FROM hops)"""


def input_names(spark, sf):
    paths = path_records(spark, sf)
    names = paths.select(F.element_at(F.split("rel_new", "/"), -1).alias("name")).unionByName(
        table(spark, sf, "customer").select(F.concat("c_name", F.lit("_masked.docx")).alias("name"))).distinct()
    return names, paths


@query("e9_candidates", O.with_(CAND_NAMES) + "SELECT DISTINCT name, candidate FROM cands")
def e9_candidates(spark, sf):
    return AU.source_candidates(*input_names(spark, sf))


CHAINS = """renames AS (SELECT 'n' || c_custkey AS new_name, 'n' || (c_custkey - c_custkey % 12 + (c_custkey + 1) % 12) AS old_name, c_custkey AS ord FROM customer
    WHERE c_custkey % 12 <> 11 OR c_custkey % 24 = 23),
  starts AS (SELECT 'n' || c_custkey AS name FROM customer WHERE c_custkey % 5 < 2),
  back AS (SELECT name, name AS candidate FROM starts UNION SELECT name, old_name FROM back JOIN renames ON candidate = new_name)"""


@query("e9_rename_chains", f"WITH RECURSIVE {CHAINS} SELECT name, candidate FROM back")
def e9_rename_chains(spark, sf):
    """Chains of eleven renames, and cycles of twelve."""
    c = table(spark, sf, "customer")
    name = lambda n: F.concat(F.lit("n"), n)
    k = F.col("c_custkey")
    renames = c.filter((k % 12 != 11) | (k % 24 == 23)).select(name(k).alias("new_name"), name(k - k % 12 + (k + 1) % 12).alias("old_name"), k.alias("ord"))
    return AU.source_candidates(c.filter(k % 5 < 2).select(name(k).alias("name")), renames)


@query("e9_input_mismatch", O.with_(CAND_NAMES) + "SELECT count(DISTINCT name) AS matched, count(DISTINCT name) = 0 AS mismatch FROM cands WHERE candidate IN (SELECT c_name || '.docx' FROM customer WHERE c_mktsegment = 'BUILDING')")
def e9_input_mismatch(spark, sf):
    registered = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat("c_name", F.lit(".docx")).alias("name"))
    return AU.input_mismatch(*input_names(spark, sf), registered)


@query("e10_restored_name", O.with_(O.PATHS) + """, real AS (SELECT * FROM paths WHERE status <> 'skipped'),
names AS (SELECT rel_new AS name FROM paths UNION SELECT string_split(rel_new, '/')[-1] FROM paths)
SELECT name, coalesce(CASE WHEN (SELECT count(*) FROM real r WHERE r.rel_new = name) = 1 THEN (SELECT min(old_name) FROM real r WHERE r.rel_new = name) END,
  CASE WHEN (SELECT count(*) FROM real r WHERE string_split(r.rel_new, '/')[-1] = name) = 1 THEN (SELECT min(old_name) FROM real r WHERE string_split(r.rel_new, '/')[-1] = name) END) AS restored FROM names""")
def e10_restored_name(spark, sf):
    paths = path_records(spark, sf)
    names = paths.select(F.col("rel_new").alias("name")).unionByName(paths.select(F.element_at(F.split("rel_new", "/"), -1).alias("name")))
    return AU.restored_name(names, paths)


@query("e11_roundtrip", O.with_(O.DOCS, O.CONVS) + "SELECT (SELECT count(*) FROM docs) + (SELECT count(*) FROM convs) AS units, CAST(0 AS BIGINT) AS differences")
def e11_roundtrip(spark, sf):
    shifted = conversation_units(spark, sf).withColumn("file_ord", F.col("file_ord") + F.lit(10 ** 12))
    units = document_units(spark, sf).unionByName(shifted)
    run = mask_units(units, DOCS_LOUD)
    back = RS.unmask_tokens(run.masked.select(*KEY, F.col("masked_text").alias("text")), run.mapping)
    return AU.roundtrip_check(units, back)


def flagship(spark, sf):
    """Mask the documents and restore them again, side by side."""
    run = mask_units(document_units(spark, sf), DOCS_LOUD)
    back = RS.unmask_tokens(run.masked.select(*KEY, F.col("masked_text").alias("masked"), F.col("text").alias("original")), run.mapping, "masked")
    return back.select(*KEY, "original", "masked", "restored", (F.col("original") == F.col("restored")).alias("same"))
