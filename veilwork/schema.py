"""Table schemas and closed value sets shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Entity categories, in their canonical order.
TYPES = ("company", "government", "person", "project", "subject", "location", "amount", "custom")

# What policy decides about a detection.
AUTO, SUGGEST, HINT = "auto_mask", "suggest_mask", "hint_only"
STATUSES = (AUTO, SUGGEST, HINT)

# Channel ranks: the lower one wins when several channels find the same text in a unit.
CHANNELS = {"manual": 0, "dictionary": 1, "ner": 2, "regex": 3}

UNIT_KEY = ("file", "file_ord", "unit_ord")

LOC = T.StructType([
    T.StructField("page", T.IntegerType()),
    T.StructField("sheet", T.StringType()),
    T.StructField("slide", T.IntegerType()),
    T.StructField("paragraph", T.IntegerType()),
    T.StructField("cell_ref", T.StringType()),
])

TEXT_UNIT = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("file_ord", T.LongType()),
    T.StructField("unit_ord", T.LongType()),
    T.StructField("part", T.StringType()),
    T.StructField("loc", LOC),
    T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("number_format", T.StringType()),
])

HIT = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("channel", T.IntegerType()),
    T.StructField("rule", T.LongType()),
    T.StructField("pos", T.IntegerType()),
])
HITS = T.ArrayType(HIT)
HITS_DDL = ("array<struct<text:string,type:string,source:string,confidence:double,"
            "channel:int,rule:bigint,pos:int>>")

SPAN_DDL = "struct<start:int,end:int,text:string,type:string,source:string,confidence:double>"

MAPPING = T.StructType([
    T.StructField("token", T.StringType()),
    T.StructField("original", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("batch_id", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("kind", T.StringType()),
])

LEXICON = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("cat_ord", T.IntegerType()),
    T.StructField("word", T.StringType()),
    T.StructField("word_ord", T.LongType()),
])

TAGGED = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("file_ord", T.LongType()),
    T.StructField("unit_ord", T.LongType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("word", T.StringType()),
    T.StructField("flag", T.StringType()),
])

VERDICT_ITEMS = ("items array<struct<id:int,action:string,decision:string,"
                 "confidence:double,type:string,reason:string>>")
PROPOSAL_ITEMS = "entities array<struct<text:string,type:string,confidence:double,reason:string>>"

HISTORY = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("batch_name", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("file_count", T.LongType()),
    T.StructField("mask_count", T.LongType()),
    T.StructField("mapping_path", T.StringType()),
])

PATH_ENTRY_DDL = ("kind string, old_name string, new_name string, rel_old string, rel_new string, depth int, "
                  "categories array<string>, tokens_used array<string>, fingerprint string, "
                  "status string, note string")
