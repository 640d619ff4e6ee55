"""Counts for people: report summary, distributions, lexicon statistics, extraction quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilwork.config import MaskConfig
from veilwork.schema import AUTO, HINT, SUGGEST


def report_summary(inputs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: input files and detections per status."""
    files = inputs.agg(F.count_distinct("file").alias("total_input_files")).withColumn("_one", F.lit(1))
    by = rows.agg(F.count_if(F.col("status") == AUTO).alias("auto_masked_count"),
                  F.count_if(F.col("status") == SUGGEST).alias("suggested_count"),
                  F.count_if(F.col("status") == HINT).alias("hint_count")).withColumn("_one", F.lit(1))
    return files.join(by, "_one").drop("_one")


def status_overview(rows: DataFrame) -> DataFrame:
    """Rows per status and how many of them came from file or folder names."""
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "path").alias("from_paths"))


def type_distribution(rows: DataFrame) -> DataFrame:
    """Rows per type, most frequent first, with the share of the largest in whole per cent."""
    counted = rows.groupBy("text_type").agg(F.count(F.lit(1)).alias("n"))  # at most eight rows
    top = F.max("n").over(W.partitionBy(F.lit(1)))
    return counted.withColumn("percent_of_max", F.floor(F.col("n") * 100 / top).cast("long")).orderBy(F.desc("n"), "text_type")


def lexicon_stats(lexicon: DataFrame) -> DataFrame:
    """Words per category; the row without a category is the total."""
    return lexicon.rollup("category").agg(F.count("word").alias("words"))


def mapping_metadata(mapping: DataFrame, inputs: DataFrame, cfg: MaskConfig, created_at: str = "") -> DataFrame:
    """One metadata row per batch. Input names live in their own table, so the row stays small."""
    n = mapping.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total_mappings"))
    files = inputs.agg(F.count_distinct("file").alias("input_files")).withColumn("_one", F.lit(1))
    return (n.withColumn("_one", F.lit(1)).join(F.broadcast(files), "_one").drop("_one")
            .withColumns({"created_at": F.lit(created_at), "mode": F.lit(cfg.mode), "style": F.lit(cfg.style)}))


def extraction_quality(units: DataFrame) -> DataFrame:
    """Per file: is its text suspiciously line-by-line, and is much of it undecodable?"""
    bad = F.length("text") - F.length(F.replace("text", F.lit("�"), F.lit("")))
    per_file = units.groupBy("file").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text").cast("long")).alias("chars"), F.sum(bad.cast("long")).alias("replaced"))
    return per_file.select(
        "file", "blocks", "chars", "replaced",
        ((F.col("blocks") >= 20) & (F.col("chars") <= 30 * F.col("blocks"))).alias("line_level"),
        ((F.col("chars") > 0) & (F.col("replaced") * 20 > F.col("chars"))).alias("undecodable"))


def report_entries(rows: DataFrame) -> DataFrame:
    """Detections as report entries, with the list each belongs to."""
    section = F.when(F.col("status") == AUTO, "auto_masked").when(F.col("status") == SUGGEST, "suggested").otherwise("hints")
    cols = [section.alias("section"), "text", F.col("text_type").alias("type"), "source", "confidence", "file"]
    if "llm_reason" in rows.columns:
        cols.append(F.when(F.col("llm_reason") != "", F.col("llm_reason")).alias("llm_reason"))
    return rows.select(*cols)
