"""Structured cells: numbers, quoted literals, list items, rich text, report-only fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.config import MaskConfig
from veilwork.functions.numeric import numeric_canonical, numeric_rule
from veilwork.operators.policy import status
from veilwork.operators.replace import register_mapping
from veilwork.operators.tokens import allocate_tokens, first_uses, reserved_numbers
from veilwork.schema import HINT, UNIT_KEY
from veilwork.session import lookup_join, stage

# Fixed value: the text between double quotes, where "" stands for one quote.
LITERAL = r'"((?:[^"]|"")*)"'
NUMERIC_SOURCE = "xlsx_numeric"


def numeric_detections(cells: DataFrame, value: str = "value", fmt: str = "number_format") -> DataFrame:
    """One row per number a rule fires on. `cells` carries a key plus value and format columns."""
    canon = numeric_canonical(F.col(value))
    found = cells.withColumn("text", canon).withColumn("_r", numeric_rule(F.col("text"), F.col(fmt)))
    return (found.filter("_r is not null")
            .withColumns({"text_type": F.col("_r.type"), "confidence": F.col("_r.confidence"), "source": F.lit(NUMERIC_SOURCE)})
            .drop("_r"))


def merge_numeric(synth: DataFrame, generic: DataFrame, key: Sequence[str]) -> DataFrame:
    """Combine number rules with generic hits of the same cells.

    A generic hit survives only where a number rule produced the same text; per text the rule
    wins, then the lexicon, then anything else.
    """
    cols = [*key, "text", "text_type", "source", "confidence"]
    same = generic.select(*cols).join(synth.select(*key, "text").distinct(), [*key, "text"], "left_semi")
    both = synth.select(*cols).unionByName(same)
    rank = F.when(F.col("source") == NUMERIC_SOURCE, 0).when(F.col("source") == "dictionary", 1).otherwise(2)
    best = F.min(F.struct(rank.alias("rank"), F.col("confidence"), F.col("text_type"), F.col("source"))).alias("m")
    return both.groupBy(*key, "text").agg(best).select(*key, "text", "m.text_type", "m.source", "m.confidence")


def mask_numeric_column(cells: DataFrame, cfg: MaskConfig, value: str = "value", fmt: str = "number_format",
                        reserved: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells with `masked_value` string, mapping of kind number).

    A sensitive number becomes one token. An untouched integer of 16 digits or more becomes text
    to keep its digits; everything else keeps its canonical form.
    """
    canon = numeric_canonical(F.col(value))
    graded = (cells.withColumn("canon", canon).withColumn("_r", numeric_rule(F.col("canon"), F.col(fmt)))
              .withColumn("status", F.when(F.col("_r").isNotNull(), status(F.col("_r.confidence"), cfg.mode, cfg.thresholds))))
    act = F.coalesce(F.col("status").isin(*cfg.statuses), F.lit(False))
    spans = graded.filter(act).select(
        *UNIT_KEY, F.lit(0).alias("start"), F.col("canon").alias("text"), F.col("_r.type").alias("type"),
        F.lit(NUMERIC_SOURCE).alias("source"), F.col("_r.confidence").alias("confidence"))
    first = stage(first_uses(spans))
    allocated = allocate_tokens(first, None if reserved is None else reserved_numbers(reserved))
    tokens = lookup_join(graded.filter(act), allocated.select(F.col("original").alias("canon"), "token", "uses"),
                         "canon", "uses", first.count())
    as_text = F.coalesce(F.abs(F.col("canon").cast("decimal(38,0)")) >= F.lit(10 ** 15).cast("decimal(38,0)"), F.lit(False)) & (
        F.col("canon").rlike(r"^-?[0-9]+(\.0+)?$"))
    rest = (graded.filter(~act).withColumn("masked_value", F.when(as_text, F.regexp_replace("canon", r"\.0+$", ""))
                                           .otherwise(F.col("canon")))
            .withColumn("stored_as", F.when(as_text, "text").otherwise("number")))
    done = tokens.withColumn("masked_value", F.col("token")).withColumn("stored_as", F.lit("token"))
    out = [*cells.columns, "canon", "status", "masked_value", "stored_as"]
    mapping = register_mapping(allocated, cfg.batch_id, F.current_timestamp(), kind="number")
    return done.select(*out).unionByName(rest.select(*out)), mapping


# ---- parts of a cell as child units -----------------------------------------------------

def literal_units(cells: DataFrame, col: str, key: Sequence[str]) -> DataFrame:
    """Child units (key, child_ord, text): the content of each quoted literal of a formula."""
    parts = F.regexp_extract_all(F.col(col), F.lit(LITERAL), F.lit(1))
    return (cells.filter(F.contains(F.col(col), F.lit('"')))
            .select(*key, F.posexplode(parts).alias("child_ord", "_raw"))
            .select(*key, "child_ord", F.replace("_raw", F.lit('""'), F.lit('"')).alias("text")))


def list_inner(col: Column) -> Column:
    """Inside of a quoted list; null for anything else."""
    open_ = F.startswith(col, F.lit('"')) & (F.length(col) >= 2)
    closed = F.when(F.endswith(col, F.lit('"')), F.substring(col, F.lit(2), F.length(col) - 2)).otherwise(
        F.substring(col, F.lit(2), F.length(col)))
    return F.when(open_, closed)


def list_item_units(cells: DataFrame, col: str, key: Sequence[str]) -> DataFrame:
    """Child units of a comma-separated quoted list."""
    return (cells.select(*key, F.posexplode(F.split(list_inner(F.col(col)), ",", -1)).alias("child_ord", "text"))
            .filter(F.col("text") != ""))


def rebuild_literals(cells: DataFrame, masked: DataFrame, col: str, key: Sequence[str]) -> DataFrame:
    """Put masked literals back between their quotes, doubling quotes again.

    `masked` has (key, child_ord, new_text); literals it does not mention stay as they were.
    """
    per_cell = masked.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("child_ord", "new_text"))).alias("_m"))
    joined = cells.join(per_cell, list(key), "left")
    found = F.regexp_extract_all(F.col(col), F.lit(LITERAL), F.lit(1))
    gaps = F.split(F.col(col), LITERAL, -1)
    pieces = F.transform(found, lambda raw, i: F.concat(
        gaps[i], F.lit('"'), F.coalesce(F.replace(F.try_element_at(F.col("_m"), i), F.lit('"'), F.lit('""')), raw), F.lit('"')))
    rebuilt = F.concat(F.array_join(pieces, ""), F.element_at(gaps, -1))
    return joined.withColumn("new_" + col, F.when(F.col("_m").isNull(), F.col(col)).otherwise(rebuilt)).drop("_m")


def rebuild_list(cells: DataFrame, masked: DataFrame, col: str, key: Sequence[str]) -> DataFrame:
    """Put masked items back into a quoted list."""
    per_cell = masked.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("child_ord", "new_text"))).alias("_m"))
    joined = cells.join(per_cell, list(key), "left")
    items = F.transform(F.split(list_inner(F.col(col)), ",", -1), lambda x, i: F.coalesce(F.try_element_at(F.col("_m"), i), x))
    rebuilt = F.concat(F.lit('"'), F.array_join(items, ","), F.lit('"'))
    return joined.withColumn("new_" + col, F.when(F.col("_m").isNull(), F.col(col)).otherwise(rebuilt)).drop("_m")


def rich_text_passes(blocks: DataFrame, key: Sequence[str]) -> DataFrame:
    """Units of both passes over a rich-text cell: every block, then the joined whole.

    `pass_no` 1 rows keep the block order, pass 2 has one row per cell with block_ord -1.
    """
    whole = (blocks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("block_ord", "text"))).alias("b"))
             .select(*key, F.lit(-1).alias("block_ord"), F.array_join(F.transform("b", lambda x: x["text"]), "").alias("text"),
                     F.lit(2).alias("pass_no")))
    first = blocks.select(*key, F.col("block_ord").cast("int").alias("block_ord"), "text", F.lit(1).alias("pass_no"))
    return first.unionByName(whole).filter(F.trim("text") != "")


def crossing_hits(detected: DataFrame, key: Sequence[str]) -> DataFrame:
    """Hits only the joined text shows: entities that cross a block border, so the cell is flattened."""
    one = detected.filter("pass_no = 1").select(*key, "text").distinct()
    two = detected.filter("pass_no = 2").select(*key, "text").distinct()
    return two.join(one, [*key, "text"], "left_anti")


# Parts that are checked but never rewritten.
REPORT_ONLY_PARTS = ("sheet_name", "defined_name", "link_target")


def hint_only_fields(rows: DataFrame, part: str = "part") -> DataFrame:
    """Detections in report-only parts are hints, whatever their confidence."""
    return rows.withColumn("status", F.when(F.col(part).isin(*REPORT_ONLY_PARTS), F.lit(HINT)).otherwise(F.col("status")))
