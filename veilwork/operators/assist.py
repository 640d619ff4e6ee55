"""Model-assisted detection. The model is an injected client; the tables around it are ours."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.config import AssistConfig
from veilwork.functions.spans import context
from veilwork.functions.text import trim_ws
from veilwork.operators.tokens import number_rows
from veilwork.schema import PROPOSAL_ITEMS, TYPES, UNIT_KEY, VERDICT_ITEMS
from veilwork.session import stage

# Reason prefixes other steps recognise, and the limits put on a model's opinion.
DROP_REASON_PREFIX = "AI 复核建议剔除"
DETECT_REASON_PREFIX = "AI 检出"
DROP_CONFIDENCE = 0.40
RAISE_CAP = 0.05
DETECT_CAP = 0.80
DEFAULT_PROPOSAL_CONFIDENCE = 0.5

# Names a model may use for an entity type.
TYPE_ALIASES = {
    "公司": "company", "公司/机构": "company", "机构": "company", "企业": "company", "公司名": "company", "机构名": "company",
    "政府": "government", "政府机构": "government", "监管部门": "government",
    "人名": "person", "姓名": "person", "人物": "person", "个人": "person",
    "项目": "project", "项目名": "project", "项目名称": "project",
    "标的": "subject", "标的物": "subject", "资产": "subject",
    "地名": "location", "地点": "location", "位置": "location", "地址": "location",
    "金额": "amount", "数额": "amount", "价格": "amount",
    "自定义": "custom", "编号": "custom", "证件号": "custom", "联系方式": "custom", "电话": "custom", "手机号": "custom",
    "手机": "custom", "邮箱": "custom", "email": "custom", "身份证": "custom", "身份证号": "custom", "卡号": "custom",
}
# How a request names the channel a candidate came from.
SOURCE_LABELS = {"dictionary": "词库匹配", "regex": "正则规则", "ner": "NER识别", "path": "文件/目录名"}
SENTENCE_MARKS = "。！？\n；"


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def normalize_type(value: Column) -> Column:
    """A valid type, a known alias, or the alias before a slash; anything else is null."""
    v = F.lower(trim_ws(value))
    alias = _literal_map(TYPE_ALIASES)
    return F.when(v.isin(*TYPES), v).otherwise(
        F.coalesce(F.try_element_at(alias, v), F.try_element_at(alias, trim_ws(F.substring_index(v, "/", 1)))))


# ---- review of rule hits ----------------------------------------------------------------

def adjudication_candidates(rows: DataFrame) -> DataFrame:
    """Distinct (text, source, type) worth a review, with the first context, whole; without one if `rows` carry none."""
    wanted = rows.filter(~F.col("source").isin("manual", "llm"))
    first = F.min(F.struct("file_ord", "unit_ord", "channel_ord", "rule_ord", "pos", "confidence", *[c for c in ("context",) if c in rows.columns])).alias("m")
    return wanted.groupBy("text", "source", "text_type").agg(first).select("text", "source", "text_type", "m.*")


CANDIDATE_ORDER = ("file_ord", "unit_ord", "channel_ord", "rule_ord", "pos")


def number_candidates(candidates: DataFrame, cfg: AssistConfig = AssistConfig()) -> DataFrame:
    """(batch, id) for every candidate, in reading order; a user's budget of `max_calls` batches leaves out those after it.

    A large table is numbered range by range, so no task sees all candidates.
    """
    order = [*CANDIDATE_ORDER, "text", "source", "text_type"]
    if cfg.max_calls is not None:
        candidates = candidates.orderBy(*order).limit(cfg.max_calls * cfg.batch_size)
    ranked = number_rows(stage(candidates.withColumn("_all", F.lit(0))), "_all", order, "_n")
    return (ranked.withColumn("_n", F.col("_n") - 1).withColumn("batch", F.floor(F.col("_n") / cfg.batch_size).cast("long"))
            .withColumn("id", (F.col("_n") % cfg.batch_size).cast("int")).drop("_n", "_all"))


def batch_requests(numbered: DataFrame) -> DataFrame:
    """One JSON request per batch."""
    label = F.coalesce(F.try_element_at(_literal_map(SOURCE_LABELS), F.col("source")), F.col("source"))
    item = F.struct("id", "text", F.col("text_type").alias("type"), label.alias("source"), "confidence", "context")
    return numbered.groupBy("batch").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("request"))


ClientFactory = Callable[[], Callable[[str], str]]


def score_batches(requests: DataFrame, client_factory: ClientFactory, cfg: AssistConfig = AssistConfig()) -> DataFrame:
    """Call the client once per request: (batch, response, error).

    After `max_consecutive_errors` failures in a row a task stops calling; its remaining batches
    stay unscored. The breaker is local to a task, as tasks do not share state.
    """
    limit = cfg.max_consecutive_errors

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        failed = 0
        for frame in frames:
            answers, errors = [], []
            for request in frame["request"]:
                answer = error = None
                if failed < limit:
                    try:
                        answer, failed = client(request), 0
                    except Exception as e:  # any client failure leaves the batch unscored
                        error, failed = str(e), failed + 1
                answers.append(answer)
                errors.append(error)
            yield pd.DataFrame({"batch": frame["batch"], "response": answers, "error": errors})
    return requests.select("batch", "request").mapInPandas(run, "batch long, response string, error string")


def answer_body(content: Column) -> Column:
    """Where a model's answer proper stands: after its thoughts, and inside the first code fence that holds anything."""
    said = F.coalesce(content, F.lit(""))
    ends = F.instr(said, "</think>")
    spoken = F.when(~F.contains(said, F.lit("<think>")), said).when(ends > 0, F.substring(said, ends + F.lit(len("</think>")), F.length(said))).otherwise("")
    fences = F.split(spoken, "```", -1)
    inside = F.regexp_replace(F.get(fences, F.lit(1)), "^[A-Za-z]+", "")  # without the name of a language
    return trim_ws(F.when((F.size(fences) > 2) & (trim_ws(inside) != ""), inside).otherwise(spoken))


_BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.S)  # strings are passed over whole


def balanced(text: str) -> Iterator[str]:
    """Stretches of `text` from an opening brace to the bracket that closes it, by where they open; one from a bracket only at the very start."""
    for opening in re.finditer(r"\A\[|\{", text):
        depth = 0
        for mark in _BRACKETS.finditer(text, opening.start()):
            depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(mark[0], 0)
            if depth == 0:
                yield text[opening.start():mark.end()]
                break


@F.pandas_udf(T.StringType())
def _first_json(bodies: pd.Series) -> pd.Series:
    def valid(text):
        for stretch in balanced(text):
            try:
                value = json.loads(stretch)
            except (ValueError, RecursionError):
                continue
            return json.dumps(value if isinstance(value, dict) else {"items": value, "entities": value}, ensure_ascii=False)
        return None

    return bodies.map(valid)


def parse_response(content: Column | str) -> Column:
    """JSON object in a model's free-form answer; a bare list is wrapped; null if there is none.

    Thoughts and fences are cut off by column functions; what is left is scanned for balanced brackets, and the first stretch that is valid counts.
    """
    return _first_json(answer_body(F.col(content) if isinstance(content, str) else content))


def validate_verdicts(parsed: DataFrame, numbered: DataFrame) -> DataFrame:
    """Usable verdicts per candidate. `parsed` has (batch, json).

    A verdict needs an id of its batch and a known action; an adjustment also needs a confidence
    between 0 and 1. The last usable verdict of an id counts.
    """
    items = (parsed.select("batch", F.from_json("json", VERDICT_ITEMS).alias("j"))
             .select("batch", F.posexplode("j.items").alias("n", "v"))
             .select("batch", "n", "v.id", F.coalesce("v.action", "v.decision").alias("action"),
                     F.col("v.confidence").alias("new_confidence"), F.col("v.type").alias("raw_type"),
                     F.coalesce("v.reason", F.lit("")).alias("reason")))
    good = items.filter(F.col("action").isin("keep", "drop") | (
        (F.col("action") == "adjust") & F.col("new_confidence").between(0.0, 1.0)))
    last = (good.groupBy("batch", "id").agg(F.max(F.struct("n", "action", "new_confidence", "raw_type", "reason")).alias("m"))
            .select("batch", "id", "m.action", "m.reason",
                    F.when(F.col("m.action") == "adjust", F.col("m.new_confidence")).alias("new_confidence"),
                    F.when(F.col("m.action") == "adjust", normalize_type(F.col("m.raw_type"))).alias("new_type")))
    return (numbered.select("batch", "id", "text", "source", "text_type").join(last, ["batch", "id"])
            .select("text", "source", "text_type", "action", "new_confidence", "new_type", "reason"))


def apply_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Change confidence, type and reason as the verdicts say; texts never change."""
    v = verdicts.select("text", "source", "text_type", "action", "new_confidence", "new_type", F.col("reason").alias("_why"))
    reviewed = rows if "llm_reason" in rows.columns else rows.withColumn("llm_reason", F.lit(""))
    joined = reviewed.join(v, ["text", "source", "text_type"], "left")
    # Reviewed channels only: verdicts are never about manual words or model proposals.
    conf, kind, why = F.col("confidence"), F.col("text_type"), F.col("_why")
    capped = F.least(F.col("new_confidence"), conf + F.lit(RAISE_CAP))
    moved = F.abs(capped - conf) > 1e-9
    retyped = F.col("new_type").isNotNull() & (F.col("new_type") != kind)
    conf_note = F.when(moved, F.format_string("AI 复核修正置信度 %.2f→%.2f：%s", conf, capped, why)).otherwise(F.col("llm_reason"))
    type_note = F.format_string("AI 复核修正类别 %s→%s：%s", kind, F.col("new_type"), why)
    adjusted = F.when(retyped, F.when(conf_note != "", F.concat(conf_note, F.lit(" "), type_note)).otherwise(type_note)
                      ).otherwise(conf_note)
    reason = (F.when(F.col("action") == "drop", F.format_string(DROP_REASON_PREFIX + "（原置信度 %.2f）：%s", conf, why))
              .when(F.col("action") == "adjust", adjusted)
              .when((F.col("action") == "keep") & (why != ""), F.concat(F.lit("AI 复核维持："), why))
              .otherwise(F.col("llm_reason")))
    new_conf = (F.when(F.col("action") == "drop", F.lit(DROP_CONFIDENCE))
                .when((F.col("action") == "adjust") & moved, capped).otherwise(conf))
    new_kind = F.when((F.col("action") == "adjust") & retyped, F.col("new_type")).otherwise(kind)
    return (joined.select("*", reason.alias("_r"), new_conf.alias("_c"), new_kind.alias("_k"))
            .withColumn("llm_reason", F.col("_r")).withColumn("confidence", F.col("_c")).withColumn("text_type", F.col("_k"))
            .select(*reviewed.columns))


# ---- proposals for what the rules missed ------------------------------------------------

def split_chunks(text: Column, limit: int = 1500) -> Column:
    """Consecutive pieces of at most `limit` characters, cut after the last sentence mark of the
    second half of a piece where there is one. One left-to-right pattern does it natively."""
    half = limit // 2
    mark = f"[{SENTENCE_MARKS}]"
    pattern = rf"(?s).{{1,{limit}}}\z|.{{{half + 1},{limit - 1}}}{mark}|.{{{limit}}}"
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def chunk_rows(units: DataFrame, limit: int = 1500) -> DataFrame:
    return units.select(*UNIT_KEY, F.posexplode(split_chunks(F.col("text"), limit)).alias("chunk_ord", "chunk"))


def exclusion_set(rows: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Distinct texts the model must not propose again: rule hits of the run and the whitelist."""
    return rows.select("text").unionByName(whitelist.select(F.col("word").alias("text"))).distinct()


def parse_proposals(parsed: DataFrame) -> DataFrame:
    """(chunk key..., p_ord, text, type, confidence, reason) from parsed detection answers."""
    keys = [c for c in parsed.columns if c != "json"]
    return (parsed.select(*keys, F.from_json("json", PROPOSAL_ITEMS).alias("j"))
            .select(*keys, F.posexplode("j.entities").alias("p_ord", "e"))
            .select(*keys, "p_ord", "e.text", "e.type", "e.confidence", "e.reason"))


def accept_proposals(chunks: DataFrame, proposals: DataFrame, rule_hits: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Detections of source llm from proposals that survive every check.

    A proposal must occur verbatim in its chunk, have a known type, not repeat a rule hit of its
    unit or a whitelisted word, and be the first with its text in the unit.
    """
    chunk_key = [*UNIT_KEY, "chunk_ord"]
    typed = (proposals.withColumn("text", trim_ws(F.col("text"))).withColumn("text_type", normalize_type(F.col("type")))
             .filter((F.col("text") != "") & F.col("text_type").isNotNull()))
    present = typed.join(chunks, chunk_key).filter(F.contains("chunk", F.col("text")))
    fresh = (present.join(rule_hits.select(*UNIT_KEY, "text").distinct(), [*UNIT_KEY, "text"], "left_anti")
             .join(whitelist.select(F.col("word").alias("text")).distinct(), "text", "left_anti"))
    conf = F.least(F.greatest(F.coalesce("confidence", F.lit(DEFAULT_PROPOSAL_CONFIDENCE)), F.lit(0.0)), F.lit(DETECT_CAP))
    why = F.coalesce("reason", F.lit(""))
    note = F.when(why != "", F.concat(F.lit(DETECT_REASON_PREFIX + "："), why)).otherwise(F.lit(DETECT_REASON_PREFIX))
    pos = F.instr(F.col("chunk"), F.col("text"))
    around = context(F.col("chunk"), pos, F.length("text"))
    row = F.struct("chunk_ord", "p_ord", "text_type", conf.alias("confidence"), around.alias("context"), note.alias("llm_reason"))
    return (fresh.groupBy(*UNIT_KEY, "text").agg(F.min(row).alias("m"))
            .select(*UNIT_KEY, "text", "m.text_type", F.lit("llm").alias("source"), "m.confidence", "m.context", "m.llm_reason"))


def compose_roles(rules: DataFrame, cfg: AssistConfig, mode: str, verdicts: Callable[[DataFrame], DataFrame] | None = None,
                  proposals: DataFrame | None = None) -> DataFrame:
    """Detections under the configured role. Focused runs and disabled assistance are rules only.

    `verdicts` maps detections to a verdict table; `proposals` are accepted proposals.
    """
    base = rules.withColumn("llm_reason", F.lit("")) if "llm_reason" not in rules.columns else rules
    if not cfg.enabled or mode == "focused":
        return base
    role = cfg.role if cfg.role in ("adjudicator", "detector", "both") else "adjudicator"
    out = base
    if role in ("detector", "both") and proposals is not None:
        out = base.unionByName(proposals, allowMissingColumns=True)
    if role in ("adjudicator", "both") and verdicts is not None:
        out = apply_verdicts(out, verdicts(out))
    return out


def run_stats(rows: DataFrame, verdicts: DataFrame, scored: DataFrame, proposals: DataFrame) -> DataFrame:
    """One row of run counters, each a plain aggregate so that task retries cannot double it."""
    seen = rows.agg(F.count(F.lit(1)).alias("items_seen"))
    judged = verdicts.agg(F.count(F.lit(1)).alias("items_adjudicated"))
    applied = rows.join(verdicts.select("text", "source", "text_type", "action"), ["text", "source", "text_type"]).agg(
        F.count_if(F.col("action") == "drop").alias("dropped"), F.count_if(F.col("action") == "adjust").alias("adjusted"),
        F.count(F.lit(1)).alias("_reviewed"))
    calls = scored.agg(F.count("response").alias("calls"), F.count("error").alias("errors"),
                       F.min_by("error", F.when(F.col("error").isNotNull(), F.col("batch"))).alias("first_error"))
    found = proposals.agg(F.count(F.lit(1)).alias("detected"))
    out = seen.withColumn("_one", F.lit(1))
    for part in (judged, applied, calls, found):  # five one-row tables side by side
        out = out.join(part.withColumn("_one", F.lit(1)), "_one")
    # Every further detection with a verdict was answered by the first one's call.
    cached = (F.col("_reviewed") - F.col("items_adjudicated")).alias("cache_hits")
    return out.select("calls", cached, "items_seen", "items_adjudicated", "adjusted", "dropped", "detected", "errors",
                      F.coalesce("first_error", F.lit("")).alias("first_error"))


def ai_acceptance(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """How the user judged the model's suggestions. Both tables carry `idx`."""
    from veilwork.operators.detect import is_ai_detected
    sel = selected.filter("selected").select("idx", F.lit(True).alias("_sel")).distinct()
    ai = is_ai_detected(F.col("source"), F.col("origin_source"), F.col("llm_reason"))
    dropped = ~ai & F.coalesce("llm_reason", F.lit("")).startswith(DROP_REASON_PREFIX)
    on = F.col("_sel").isNotNull()
    return rows.join(sel, "idx", "left").agg(
        F.count_if(ai).alias("ai_detected"), F.count_if(ai & on).alias("ai_detected_accepted"),
        F.count_if(dropped).alias("ai_dropped"), F.count_if(dropped & on).alias("ai_dropped_overridden"))
