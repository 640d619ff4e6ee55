"""Looking through detections, choosing among them, and learning from the choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions.text import trim_ws
from veilwork.operators.detect import is_ai_detected
from veilwork.operators.phrases import build_index, with_candidates
from veilwork.schema import AUTO, SUGGEST
from veilwork.session import stage

READING_ORDER = ("file_ord", "unit_ord", "det_ord")


def by_confidence(rows: DataFrame) -> DataFrame:
    """Most certain first, reading order among equals."""
    return rows.orderBy(F.desc("confidence"), *READING_ORDER)


def manual_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("source") != "manual", *READING_ORDER)


def newest(history: DataFrame, n: int = 50) -> DataFrame:
    """The latest batches, newest first (a top-k, no full sort)."""
    return history.orderBy(F.desc("created_at"), F.desc("batch_id")).limit(n)


def filter_results(rows: DataFrame, type: str | None = None, status: str | None = None, source: str | None = None,
                   file: str | None = None) -> DataFrame:
    """Up to four equality filters, all of which must hold."""
    for col, value in (("text_type", type), ("status", status), ("source", source), ("file", file)):
        if value is not None:
            rows = rows.filter(F.col(col) == value)
    return rows


def search_results(rows: DataFrame, keyword: str) -> DataFrame:
    """Case-insensitive substring of the text or its context."""
    k = F.lit(keyword.lower())
    return rows.filter(F.contains(F.lower("text"), k) | F.contains(F.lower("context"), k))


def default_selection(status: Column, ai: Column) -> Column:
    """Automatic rows are on, suggestions are on unless a model made them, hints are off."""
    return F.when(status == AUTO, True).when(status == SUGGEST, ~ai).otherwise(False)


def bulk_select(rows: DataFrame, op: str, in_view: Column) -> DataFrame:
    """Set `selected` for the rows in view; the others keep theirs."""
    value = {
        "all": F.lit(True), "none": F.lit(False), "invert": ~F.col("selected"),
        "auto_only": F.col("status") == AUTO, "suggest_only": F.col("status") == SUGGEST,
    }[op]
    return rows.withColumn("selected", F.when(in_view, value).otherwise(F.col("selected")))


# ---- learning ---------------------------------------------------------------------------

def learn_candidates(rows: DataFrame, known_words: DataFrame) -> DataFrame:
    """Words worth adding to the lexicon, from rows with `idx` and `selected`.

    Grouped by text: first category, sources in order of appearance, number of files, best
    confidence. A word is checked if any of its rows is selected; if no row in view is, all are.
    """
    base = F.regexp_extract("file", r"([^/]+)/?$", 1)
    # The detections are read once; all that follows works on this much smaller table.
    seen = stage(rows.groupBy("text", "source", F.when(F.col("file") != "", base).alias("_file")).agg(
        F.min("idx").alias("at"), F.min_by("text_type", "idx").alias("type"), F.max("confidence").alias("confidence"),
        F.bool_or("selected").alias("selected")))
    per_source = seen.groupBy("text", "source").agg(F.min("at").alias("at"))
    sources = per_source.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("at", "source"))).alias("s"))
    grouped = seen.groupBy("text").agg(
        F.min_by("type", "at").alias("category"), F.count_distinct("_file").alias("file_count"),
        F.max("confidence").alias("confidence"), F.bool_or("selected").alias("_any"))
    any_selected = bool(seen.agg(F.bool_or("selected")).first()[0])
    fresh = grouped.join(known_words.select(F.col("word").alias("text")).distinct(), "text", "left_anti").join(sources, "text")
    return fresh.select("text", "category", F.array_join(F.transform("s", lambda x: x["source"]), ",").alias("sources"),
                        "file_count", "confidence", (F.col("_any") | F.lit(not any_selected)).alias("checked"))


def exclude_unselected(rows: DataFrame) -> DataFrame:
    """Texts the user left unselected and no model proposed: candidates for the whitelist."""
    ai = is_ai_detected(F.col("source"), F.col("origin_source"), F.col("llm_reason"))
    return rows.filter(~F.coalesce("selected", F.lit(False)) & ~ai).select(F.col("text").alias("word")).distinct()


def learned_words(rows: DataFrame) -> DataFrame:
    """(category, word) for rows marked `learn`, distinct."""
    return rows.filter("learn").select(F.col("text_type").alias("category"), F.col("text").alias("word")).distinct()


# ---- keyword in context -----------------------------------------------------------------

def kwic_locate(units: DataFrame, rows: DataFrame) -> DataFrame:
    """Per detection, the first unit of its file that holds its context, else the first with the detected text.

    Contexts (of eight characters at least) and texts are phrases that one index looks for in all units, so a context need not hold its text
    and texts may overlap; what the index finds meets what the detections of a file ask for in an equi-join.
    """
    ctx = trim_ws(F.coalesce("context", F.lit("")))
    wanted = rows.withColumn("_ctx", F.when(F.length(ctx) >= 8, ctx))
    asked = stage(wanted.select("file", F.explode(F.array_compact(F.array("_ctx", "text"))).alias("phrase")).distinct())
    index = build_index(asked.select("phrase").distinct())
    if index is None:
        return rows.withColumn("target", F.lit(None).cast(units.schema["unit_ord"].dataType))
    found = with_candidates(units.select("file", "unit_ord", "text"), index, "text", "_found").select("file", "unit_ord", F.explode("_found").alias("phrase"))
    first = stage(found.groupBy("file", "phrase").agg(F.min("unit_ord").alias("at")).join(asked, ["file", "phrase"], "left_semi"))
    return (wanted.join(first.select("file", F.col("phrase").alias("_ctx"), F.col("at").alias("_by_ctx")), ["file", "_ctx"], "left")
            .join(first.select("file", F.col("phrase").alias("text"), F.col("at").alias("_by_text")), ["file", "text"], "left")
            .withColumn("target", F.coalesce("_by_ctx", "_by_text"))
            .select(*rows.columns, "target"))


def kwic_neighbours(units: DataFrame, targets: DataFrame, clear: int = 10, blurred: int = 3) -> DataFrame:
    """Units around each (file, target): `clear` on either side, `blurred` more beyond.

    The range becomes an equi join by listing the unit numbers a target needs.
    """
    reach = clear + blurred
    want = targets.select("file", "target").distinct().select(
        "file", "target", F.explode(F.sequence(F.col("target") - reach, F.col("target") + reach)).alias("unit_ord"))
    distance = F.abs(F.col("unit_ord") - F.col("target"))
    return (want.join(units.select("file", "unit_ord", "text"), ["file", "unit_ord"])
            .select("file", "target", "unit_ord", distance.cast("int").alias("distance"), (distance > clear).alias("blurred"), "text"))
