"""Plug-in tagger channel: a user function tags words, Spark types and grades them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions.rules import let
from veilwork.schema import CHANNELS, UNIT_KEY

# A tagger factory returns a function text -> [(word, flag), ...]; it is called once per task.
TaggerFactory = Callable[[], Callable[[str], list[tuple[str, str]]]]

# Part-of-speech tags that name an entity.
TAG_TYPES = {
    "nr": "person", "nrfg": "person", "nrt": "person",
    "ns": "location", "nsf": "location",
    "nt": "company", "ni": "company", "nis": "company", "nic": "company",
    "nz": "custom",
}
# Word endings that make an entity more likely.
ENTITY_SUFFIXES = ("公司", "集团", "银行", "分行", "研究院", "大学", "政府", "委员会", "部门", "局", "部",
                   "项目", "工程", "煤矿", "矿区")
MIN_LENGTH = 2


def tag_units(units: DataFrame, factory: TaggerFactory) -> DataFrame:
    """Add `tags`, the tagger's (word, flag) pairs in text order."""
    @F.pandas_udf("array<struct<word:string,flag:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tag = factory()
        for texts in batches:
            yield pd.Series([[{"word": w, "flag": f} for w, f in tag(t)] if t else [] for t in texts])
    return units.withColumn("tags", run("text"))


def word_list_tagger(entries: dict[str, str]) -> TaggerFactory:
    """A simple tagger that flags listed words, longest first at each place."""
    def factory():
        import re
        if not entries:
            return lambda text: []
        pattern = re.compile("|".join(re.escape(w) for w in sorted(entries, key=len, reverse=True)))
        return lambda text: [(m.group(), entries[m.group()]) for m in pattern.finditer(text)]
    return factory


def ner_type(flag: Column) -> Column:
    pairs = [F.lit(x) for kv in TAG_TYPES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), flag)


def ner_confidence(word: Column, flag: Column) -> Column:
    """Base 0.60, raised for length, for trusted tags and for entity-like endings; at most 0.85."""
    def plus(condition, value):
        return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))
    n = F.length(word)
    score = F.lit(0.60) + F.when(n >= 4, F.lit(0.10)).when(n >= 3, F.lit(0.05)).otherwise(F.lit(0.0))
    score = score + plus(flag.isin("nt", "ni", "nis"), 0.05)
    score = score + plus(flag == "nr", 0.05)
    score = score + plus(flag == "ns", 0.03)
    score = score + plus(word.rlike("(?:" + "|".join(ENTITY_SUFFIXES) + ")$"), 0.08)
    return F.least(score, F.lit(0.85))


def ner_hits(text: Column, tags: Column) -> Column:
    """Array form: typed, long enough, first tag of a word wins."""
    typed = F.filter(tags, lambda t: (F.length(t["word"]) >= MIN_LENGTH) & ner_type(t["flag"]).isNotNull()
                     & F.contains(text, t["word"]))
    words = F.transform(typed, lambda t: t["word"])
    first = let(words, lambda ws: F.filter(typed, lambda t, i: F.array_position(ws, t["word"]) == i + 1))
    return F.transform(first, lambda t, i: F.struct(
        t["word"].alias("text"), ner_type(t["flag"]).alias("type"), F.lit("ner").alias("source"),
        ner_confidence(t["word"], t["flag"]).alias("confidence"), F.lit(CHANNELS["ner"]).alias("channel"),
        i.cast("long").alias("rule"), F.instr(text, t["word"]).cast("int").alias("pos")))


def type_tags(tagged: DataFrame) -> DataFrame:
    """Row form over a tagged_token table: the first usable tag of each word in a unit."""
    usable = (tagged.withColumn("text_type", ner_type(F.col("flag")))
              .filter((F.length("word") >= MIN_LENGTH) & F.col("text_type").isNotNull()))
    first = (usable.groupBy(*UNIT_KEY, "word")
             .agg(F.min(F.struct("ord", "flag", "text_type")).alias("m")))
    return first.select(*UNIT_KEY, F.col("word").alias("text"), "m.ord", "m.flag", "m.text_type",
                        ner_confidence(F.col("word"), F.col("m.flag")).alias("confidence"))


def tag_rows(units: DataFrame, factory: TaggerFactory) -> DataFrame:
    """Tagger output as a tagged_token table."""
    return (tag_units(units, factory).select(*UNIT_KEY, F.posexplode("tags").alias("ord", "t"))
            .select(*UNIT_KEY, "ord", "t.word", "t.flag"))
