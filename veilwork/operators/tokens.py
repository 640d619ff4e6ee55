"""Numbered placeholders: one token per original, numbered per type in order of first use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilwork.session import stage

# Fixed value: shape of a placeholder.
TOKEN = r"\[(?:COMPANY|GOVERNMENT|PERSON|PROJECT|SUBJECT|LOCATION|AMOUNT|CUSTOM)_\p{Nd}{3,}\]"

# Beyond this many originals numbering runs in two passes over range partitions.
SINGLE_WINDOW_ROWS = 1_000_000
# Places that `monotonically_increasing_id` keeps for the rows of a task.
RANGE_BITS = 33
# Up to this many gaps between reserved numbers are looked up in a literal-sized array.
GAP_ARRAY_ROWS = 10_000


def token_text(type_: Column, number: Column) -> Column:
    return F.format_string("[%s_%03d]", F.upper(type_), number)


def tokens_in(text: Column) -> Column:
    """Distinct placeholder-shaped strings of a text."""
    return F.when(text.contains("["), F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
                  ).otherwise(F.array().cast("array<string>"))


def scan_tokens(units: DataFrame, text_col: str = "text") -> DataFrame:
    """Placeholders already in the corpus."""
    return units.select(F.explode(tokens_in(F.col(text_col))).alias("token")).distinct()


def reserved_numbers(tokens: DataFrame) -> DataFrame:
    return token_numbers(tokens).distinct()


def token_numbers(tokens: DataFrame) -> DataFrame:
    """(type, number) for tokens that equal the canonical form of their number, from 1 on."""
    parts = tokens.select("token", F.regexp_extract("token", r"^\[([A-Z]+)_([0-9]{3,18})\]$", 1).alias("p"),
                          F.regexp_extract("token", r"^\[([A-Z]+)_([0-9]{3,18})\]$", 2).alias("n"))
    numbered = parts.filter("n != ''").select("token", F.lower("p").alias("type"), F.col("n").cast("long").alias("number"))
    return (numbered.filter((F.col("number") >= 1) & (token_text(F.col("type"), F.col("number")) == F.col("token")))
            .select("type", "number"))


def number_rows(df: DataFrame, group: str, order: Sequence[str], out: str = "k",
                limit: int = SINGLE_WINDOW_ROWS) -> DataFrame:
    """row_number() per group in `order`, without putting a whole group into one task.

    `df` should be staged: it is counted. A large table is cut into ranges of (group, order);
    each range numbers its own rows and adds the counts of the ranges before it.
    """
    rows = df.count()
    by = [F.col(c) for c in order]
    if rows <= limit:
        return df.withColumn(out, F.row_number().over(W.partitionBy(group).orderBy(*by)))
    parts = max(2, rows // limit * 4)
    # Each range is sorted and its rows are counted on the way, so they are not shuffled again: the places of a group in a range follow each other.
    ranged = stage(df.repartitionByRange(int(parts), F.col(group), *by).sortWithinPartitions(group, *order)
                   .withColumn("_at", F.monotonically_increasing_id()))
    ranges = (ranged.groupBy(F.col(group).alias("_group"), F.shiftright("_at", RANGE_BITS).alias("_pid"))
              .agg(F.count(F.lit(1)).alias("_count"), F.min("_at").alias("_first"))
              .withColumn("_off", F.sum("_count").over(W.partitionBy("_group").orderBy("_pid")) - F.col("_count"))
              .select("_group", "_pid", (F.col("_off") - F.col("_first") + 1).alias("_add")))
    # A group of a range is one row here: as many as there are ranges and groups.
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.shiftright("_at", RANGE_BITS) == F.col("_pid"))
    return ranged.join(F.broadcast(ranges), same).withColumn(out, F.col("_at") + F.col("_add")).drop("_group", "_pid", "_add", "_at")


def gap_table(reserved: DataFrame) -> DataFrame:
    """(type, t, below): before the k-th free number lie `below` reserved ones once k >= t.

    With the reserved numbers of a type sorted as r_0 < r_1 < ..., the k-th free number is
    k + count(i : r_i - i <= k). Runs of consecutive reserved numbers share one value of r_i - i
    and collapse to one row, so a corpus masked before yields a handful of rows.
    """
    ranked = number_rows(stage(reserved), "type", ["number"], "i")
    return ranked.groupBy("type", (F.col("number") - F.col("i") + 1).alias("t")).agg(F.max("i").cast("long").alias("below"))


def skip_reserved(numbered: DataFrame, reserved: DataFrame | None, k: str = "k", out: str = "number") -> DataFrame:
    """Turn the k-th position of a type into the k-th number that is still free."""
    if reserved is None:
        return numbered.withColumn(out, F.col(k).cast("long"))
    gaps = stage(gap_table(reserved))
    if gaps.count() <= GAP_ARRAY_ROWS:
        per_type = gaps.groupBy("type").agg(F.array_sort(F.collect_list(F.struct("t", "below"))).alias("gaps"))
        joined = numbered.join(F.broadcast(per_type), "type", "left")
        passed = F.filter("gaps", lambda g: g["t"] <= F.col(k))
        skipped = F.when(F.size(passed) > 0, F.element_at(passed, -1)["below"]).otherwise(0)
        return joined.withColumn(out, (F.col(k) + F.coalesce(skipped, F.lit(0))).cast("long")).drop("gaps")
    # Many gaps: sort both sequences into one. A row's place less its own rank k is the number of
    # gaps it has passed, which leads to the gap's row by an equi join.
    indexed = number_rows(gaps, "type", ["t"], "_passed").select("type", "t", "_passed", "below")
    both = (numbered.select("type", F.col(k).cast("long").alias("_at"), F.lit(1).alias("_row"))
            .unionByName(indexed.select("type", F.col("t").cast("long").alias("_at"), F.lit(0).alias("_row"))))
    placed = number_rows(stage(both), "type", ["_at", "_row"], "_p").filter("_row = 1")
    passed = placed.select("type", F.col("_at"), (F.col("_p") - F.col("_at")).alias("_passed"))
    found = passed.join(indexed.select("type", "_passed", "below"), ["type", "_passed"], "left").select("type", "_at", "below")
    return (numbered.withColumn("_at", F.col(k).cast("long")).join(found, ["type", "_at"])
            .withColumn(out, (F.col(k) + F.coalesce("below", F.lit(0))).cast("long")).drop("_at", "below"))


def first_uses(spans: DataFrame) -> DataFrame:
    """One row per original: where, as what type and how sure it was first used, and its row count.

    `spans` has (file_ord, unit_ord, start, text, type, source, confidence). The minimum of a
    struct is combined map-side, so one text that fills a third of the corpus is no hot spot.
    """
    first = F.min(F.struct("file_ord", "unit_ord", "start", "type", "source", "confidence")).alias("m")
    return (spans.groupBy(F.col("text").alias("original")).agg(first, F.count(F.lit(1)).alias("uses"))
            .select("original", "m.*", "uses"))


def allocate_tokens(first: DataFrame, reserved: DataFrame | None = None,
                    order: Sequence[str] = ("file_ord", "unit_ord", "start")) -> DataFrame:
    """Add `token` to staged first uses."""
    numbered = number_rows(first, "type", order)
    return skip_reserved(numbered, reserved).withColumn("token", token_text(F.col("type"), F.col("number")))
