"""Checks on masked and restored output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions.text import fingerprint
from veilwork.operators.detect import ngram_rows
from veilwork.operators.tokens import tokens_in
from veilwork.schema import UNIT_KEY
from veilwork.session import stage, table_join


def file_tokens(units: DataFrame, text_col: str = "text") -> DataFrame:
    return units.select("file", F.explode(tokens_in(F.col(text_col))).alias("token")).distinct()


def residual_tokens(units: DataFrame, mapping: DataFrame, text_col: str = "text") -> DataFrame:
    """Mapped placeholders still present after a restore: a defect."""
    return table_join(stage(file_tokens(units, text_col)), mapping.select("token").distinct(), "token", "left_semi")


def foreign_tokens(units: DataFrame, mapping: DataFrame, text_col: str = "text") -> DataFrame:
    """Placeholders this mapping does not know: natural text or another batch's file."""
    return table_join(stage(file_tokens(units, text_col)), mapping.select("token").distinct(), "token", "left_anti")


def residual_aliases(units: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mapped words without a bracket still present, found by the index of phrases."""
    keys = (mapping.filter(~F.contains(F.col("token"), F.lit("[")) & (F.col("token") != ""))
            .select(F.col("token").alias("word")).distinct())
    return ngram_rows(units, keys, key=UNIT_KEY).select("file", F.col("word").alias("alias")).distinct()


def zero_hit_files(restored: DataFrame, mapping: DataFrame) -> DataFrame:
    """Files in which no mapped string occurred; none if the mapping is empty."""
    per_file = restored.groupBy("file").agg(F.sum(F.size("hits").cast("long")).alias("hits"))
    return per_file.filter(F.lit(not mapping.isEmpty()) & (F.col("hits") == 0)).select("file")


def fingerprint_state(original: Column, stored: Column) -> Column:
    return (F.when(F.coalesce(stored, F.lit("")) == "", "legacy")
            .when(fingerprint(F.coalesce(original, F.lit(""))) == stored, "ok").otherwise("mismatch"))


def verify_fingerprints(mapping: DataFrame) -> DataFrame:
    return mapping.select("token", fingerprint_state(F.col("original"), F.col("fingerprint")).alias("state"))


def strip_masked(name: Column) -> Column:
    """`x_masked.docx` -> `x.docx`."""
    return F.regexp_replace(name, r"_masked(\.[^.]*)$", "$1")


def source_candidates(names: DataFrame, renames: DataFrame) -> DataFrame:
    """(name, candidate): the name itself and all that renames lead back to, however many there were.

    A name has one earlier name at most, so renames form chains, trees and cycles. Pointers are doubled: pairs (name, ancestor) of
    fewer than 2^r hops join the pointers of 2^r hops, so a chain of n renames takes log2(n) rounds. Going round a cycle adds no
    pair; the round that adds none is the last.
    """
    # A later record of the same new name replaces an earlier one.
    jump = stage(renames.filter("new_name <> '' and old_name is not null").groupBy("new_name")
                 .agg(F.max(F.struct("ord", "old_name")).alias("m")).select(F.col("new_name").alias("at"), F.col("m.old_name").alias("to")))
    found = stage(names.select("name", F.col("name").alias("candidate")).filter("name is not null").distinct())
    known = found.count()
    while True:
        more = table_join(found.withColumnRenamed("candidate", "at"), jump, "at").select("name", F.col("to").alias("candidate"))
        found = stage(found.unionByName(more).distinct())
        now = found.count()
        if now == known:
            break
        known = now
        onward = jump.select(F.col("at").alias("to"), F.col("to").alias("further"))
        jump = stage(table_join(jump, onward, "to").select("at", F.col("further").alias("to")))
    both = found.select("name", F.explode(F.array(F.col("candidate"), strip_masked(F.col("candidate")))).alias("candidate"))
    return both.distinct()


def input_mismatch(names: DataFrame, renames: DataFrame, registered: DataFrame) -> DataFrame:
    """One row: how many input names lead back to a registered one; mismatch if none does."""
    known = registered.select(F.col("name").alias("candidate")).distinct()
    matched = (source_candidates(names, renames).join(known, "candidate", "left_semi")
               .agg(F.countDistinct("name").alias("matched")))
    return matched.select("matched", (F.col("matched") == 0).alias("mismatch"))


def restored_name(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Original file name where exactly one rename record fits: full path first, then base name."""
    real = paths.filter(F.col("status").isin("renamed", "conflict_suffixed"))
    base = F.element_at(F.split("rel_new", "/"), -1)
    exact = (real.groupBy(F.col("rel_new").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.first("old_name").alias("by_path"))
             .filter("n = 1").drop("n"))
    by_name = (real.groupBy(base.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.first("old_name").alias("by_base"))
               .filter("n = 1").drop("n"))
    return (files.select("name").distinct().join(exact, "name", "left").join(by_name, "name", "left")
            .select("name", F.coalesce("by_path", "by_base").alias("restored")))


def roundtrip_check(original: DataFrame, restored: DataFrame) -> DataFrame:
    """One row: compared units and how many differ after mask and restore."""
    a = original.select(*UNIT_KEY, F.col("text").alias("before"))
    b = restored.select(*UNIT_KEY, F.col("restored").alias("after"))
    joined = a.join(b, list(UNIT_KEY), "full_outer")
    same = F.col("before").eqNullSafe(F.col("after"))
    return joined.agg(F.count(F.lit(1)).alias("units"), F.sum(F.when(same, 0).otherwise(1)).alias("differences"))
