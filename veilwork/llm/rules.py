"""Quality rules: figures of each document, and lines that too many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import WORD, ascii_lower, row_keys, staged

MIN_WORDS = 50
# A line is boilerplate of its host if it stands in more than LINE_TEXTS different texts of the host and in more than
# LINE_SHARE of them; the first is only so large that a few chance repeats on a small host do not count. A document is depleted if less than LEFT_SHARE of its words stand in other lines.
LINE_TEXTS, LINE_SHARE, LEFT_SHARE = 5, 0.005, 0.1


def normal_line(line: Column) -> Column:
    """Lower-case A-Z, one space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(ascii_lower(line), r"[\x20\x09-\x0D]+", " "))


def line_hash(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def figures(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, source, text): doc_id, host, key1, key2 (of doc_id, source and text), text1, text2 (of
    the text), the figures, and `lines`: hash and number of words of each line with a word.

    Repeated words are found by sorting the hashes of a text's windows of three words, within the row.
    """
    base = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("text"),
                       *row_keys("doc_id", "source", "text"))
    split = base.select("*", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
                        F.filter(F.split("text", "\n", -1), has_word).alias("parts"))
    windows = split.select("*", F.when(F.size("words") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).alias("hashes"))
    ordered = windows.select("*", F.when(F.size("hashes") > F.size(F.array_distinct("hashes")), F.sort_array(
        F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"))
    twin = lambda x, k: (x["h"] == F.get("sorted", k - 1)["h"]) | (x["h"] == F.get("sorted", k + 1)["h"])
    covered = F.array_distinct(F.flatten(F.transform(F.filter("sorted", twin), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return ordered.select(
        "doc_id", "host", "key1", "key2", F.xxhash64("text").alias("text1"), F.xxhash64(F.lit("second"), "text").alias("text2"),
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("parts") - F.size(F.array_distinct("parts"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.transform("parts", lambda x: F.struct(line_hash(x).alias("line"), F.size(F.regexp_extract_all(x, F.lit(WORD), F.lit(0))).alias("words"))).alias("lines"))


def common_lines(rows: DataFrame, texts: int = LINE_TEXTS, share: float = LINE_SHARE) -> DataFrame:
    """Boilerplate of each host: host, line, line_texts. Counts different texts, so copies of one document make no boilerplate."""
    distinct = rows.select("host", "text1", "text2", F.array_distinct("lines.line").alias("lines")).distinct()
    hosts = rows.select("host", "text1", "text2").distinct().groupBy("host").agg(F.count("*").alias("host_texts"))
    lines = (distinct.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("line_texts"))
             .filter(F.col("line_texts") > texts))
    return lines.join(hosts, "host").filter(F.col("line_texts") > share * F.col("host_texts")).select("host", "line", "line_texts")


def judge(docs: DataFrame, texts: int = LINE_TEXTS, share: float = LINE_SHARE, left: float = LEFT_SHARE) -> DataFrame:
    """One row per row of `docs` (doc_id, source, text): the figures, base_failed, n_removed_words, removed (hashes of the
    removed lines), kept, and key1, key2.

    Null text counts as empty and fails for want of words; a null source is a host of its own. Rows that repeat share
    their verdict. Of an empty table nothing comes out. Hot lines and copies are combined before the shuffle; the join with
    boilerplate lines may be split by the engine, since it feeds a partial aggregate only.
    """
    rows = staged(figures(docs), "figures")
    shared = common_lines(rows, texts, share)
    hits = rows.select("key1", "key2", "host", F.explode("lines").alias("x")).select("key1", "key2", "host", "x.line", "x.words")
    lost = (hits.join(shared, ["host", "line"]).groupBy("key1", "key2", "line").agg(F.max("words").alias("words"), F.count("*").alias("n"))
            .groupBy("key1", "key2").agg(F.sum(F.col("words") * F.col("n")).alias("all_words"), F.collect_set("line").alias("removed")))
    copies = rows.groupBy("key1", "key2").agg(F.count("*").alias("copies"))
    lost = lost.join(copies, ["key1", "key2"]).select("key1", "key2", "removed", (F.col("all_words") / F.col("copies")).cast("long").alias("n_removed_words"))
    out = rows.drop("lines", "text1", "text2", "host").join(lost, ["key1", "key2"], "left")
    removed = F.coalesce("n_removed_words", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (out.withColumn("n_removed_words", removed).withColumn("base_failed", failed)
            .withColumn("kept", ~failed & ((F.col("n_words") - removed) >= left * F.col("n_words"))))


def clean(docs: DataFrame) -> DataFrame:
    """The kept rows of `docs`, all columns, without the boilerplate lines in their texts; n_chars, if there, follows."""
    verdicts = judge(docs)
    news = staged(verdicts.filter("kept").groupBy("key1", "key2").agg(F.first("removed").alias("_removed")), "rule-verdicts")
    one, two = row_keys("doc_id", "source", "text")
    rows = docs.withColumns({"_key1": one, "_key2": two}).join(news.withColumnsRenamed({"key1": "_key1", "key2": "_key2"}), ["_key1", "_key2"])
    lines = F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains("_removed", line_hash(x)))
    rows = rows.withColumn("_text", F.when(F.col("_removed").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n")))
    new = {"text": F.col("_text"), "n_chars": F.when(F.col("_removed").isNull(), F.col("n_chars")).otherwise(F.length("_text").cast("long"))
           if "n_chars" in docs.columns else None}
    return rows.select(*[new[c].alias(c) if new.get(c) is not None else F.col(c) for c in docs.columns])
