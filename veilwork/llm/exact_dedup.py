"""Exact deduplication by recipes of content-defined chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import ascii_lower, staged

# A chunk has at least CHUNK_MIN characters and ends after the next white space that follows one of the letters below, so
# that its bounds follow the content; without such a place it ends at CHUNK_MAX characters.
CHUNK_MIN, CHUNK_MAX, CHUNK_END = 512, 8192, r"(?<=[dnt][\x20\n.,])"


def chunk_pattern(least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> str:
    return rf"(?s).{{{least},{most}}}?{CHUNK_END}|.{{{most}}}|.+"


def dedup_exact(docs: DataFrame, least: int = CHUNK_MIN, most: int = CHUNK_MAX, chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest doc_id of a group stays; a
    null doc_id is smaller than any other. Rows that repeat both doc_id and text are copies as well: one is kept.

    Each text is cut into chunks by its content. Distinct chunks, combined before the shuffle, show whether a hash names
    one chunk text only. If all do, as is to be expected of 64 bits, lists of hashes identify texts and only these lists are
    grouped. Texts that hold a chunk whose hash is shared by another chunk are compared as a whole. Documents that
    repeat, even a third of all rows, are counted before the shuffle.
    """
    rows = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"))
    chunks = F.regexp_extract_all("norm", F.lit(chunk_pattern(least, most)), F.lit(0))
    cut = rows.select("doc_id", "norm", chunks.alias("chunks"))
    hashed = lambda c: F.transform(c, lambda x: chunk_hash(x))
    clashes = (cut.select(F.explode("chunks").alias("chunk")).select(chunk_hash(F.col("chunk")).alias("hash"), "chunk")
               .distinct().groupBy("hash").count().filter("count > 1").select("hash"))
    clashes = staged(clashes, "chunk-clashes")
    recipes = cut.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), hashed(F.col("chunks")).alias("recipe"),
                         F.lit(None).cast("string").alias("whole"))
    if not clashes.isEmpty():
        full = cut.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), hashed(F.col("chunks")).alias("recipe"), "norm")
        tainted = (full.select("recipe").distinct().select("recipe", F.explode("recipe").alias("hash")).join(clashes, "hash", "left_semi")
                   .select("recipe").distinct().withColumn("tainted", F.lit(True)))
        recipes = full.join(tainted, "recipe", "left").select("doc_id", "text_sha256", "recipe", F.when(F.col("tainted"), F.col("norm")).alias("whole"))
    counted = staged(recipes.groupBy("recipe", "whole", "text_sha256", "doc_id").agg(F.count("*").alias("rows")), "recipes")
    groups = (counted.groupBy(F.col("recipe").alias("of_recipe"), F.col("whole").alias("of_whole"))
              .agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("group_size")))
    same = F.col("recipe").eqNullSafe(F.col("of_recipe")) & F.col("whole").eqNullSafe(F.col("of_whole"))
    copies = counted.join(groups, same).select("doc_id", "keep_id", "group_size", "text_sha256",
                                               F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"))
    return copies.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose text stays: one row per group of equal texts."""
    verdicts = staged(dedup_exact(docs), "exact-verdicts")
    kept = verdicts.filter("kept").select(F.col("doc_id").alias("_keep_id"), F.col("text_sha256").alias("_keep_sha"), F.lit(False).alias("_again"))
    # Kept rows that have a twin of the same doc_id and text: few, and one of each has to be chosen.
    again = (verdicts.filter("not kept and doc_id <=> keep_id").select(F.col("doc_id").alias("_keep_id"), F.col("text_sha256").alias("_keep_sha"))
             .distinct().withColumn("_again", F.lit(True)))
    kept = kept.unionByName(again).groupBy("_keep_id", "_keep_sha").agg(F.max("_again").alias("_again"))
    sha = F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256)
    found = docs.withColumn("_sha", sha).join(kept, F.col("doc_id").eqNullSafe(F.col("_keep_id")) & (F.col("_sha") == F.col("_keep_sha")))
    once = found.filter("not _again").select(*docs.columns)
    return once.unionByName(found.filter("_again").dropDuplicates(["_keep_id", "_keep_sha"]).select(*docs.columns))
