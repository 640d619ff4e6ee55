"""Lexicons and whitelists in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.functions.text import trim_ws
from veilwork.schema import LEXICON, TYPES

# Chinese names of the categories in lexicon files.
CATEGORY_NAMES = {"公司/机构": "company", "政府": "government", "人名": "person", "项目": "project",
                  "主题": "subject", "地名": "location", "金额": "amount", "自定义": "custom"}


def lexicon_from_dict(spark: SparkSession, data: dict) -> DataFrame:
    """Only list-valued keys count; order of categories and words is kept."""
    lists = [(k, v) for k, v in data.items() if isinstance(v, list)]
    rows = [(k, i, str(w), j) for i, (k, words) in enumerate(lists) for j, w in enumerate(words)]
    return spark.createDataFrame(rows, LEXICON)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Category -> words file in YAML or JSON, read whole: hand-kept files are small.

    Large lexicons belong into a table with the LEXICON schema.
    """
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith(".json"):
        import json
        data = json.loads(text or "{}")
    else:
        import yaml
        data = yaml.safe_load(text) or {}
    return lexicon_from_dict(spark, data)


def known_category(raw: Column) -> Column:
    """Category key for an English or Chinese name; null if it is neither."""
    name = trim_ws(raw)
    low = F.lower(name)
    names = F.create_map(*[F.lit(x) for kv in CATEGORY_NAMES.items() for x in kv])
    return F.when(low.isin(*TYPES), low).otherwise(F.try_element_at(names, name))


def import_lexicon_csv(rows: DataFrame) -> DataFrame:
    """(category, word, unknown) from two string columns c0, c1 in `ord` order.

    A byte order mark before the first cell and a header row are skipped; an unknown category becomes custom and is flagged; rows without a
    word are dropped.
    """
    first = F.col("ord") == 0
    rows = rows.withColumn("c0", F.regexp_replace("c0", "^\ufeff", ""))
    header = F.concat_ws(",", F.lower(trim_ws(F.col("c0"))), F.lower(trim_ws(F.col("c1")))).isin("category,word", "类别,词条")
    body = rows.filter(~(first & header))
    cat = known_category(F.col("c0"))
    return (body.select("ord", F.coalesce(cat, F.lit("custom")).alias("category"), trim_ws(F.col("c1")).alias("word"),
                        cat.isNull().alias("unknown")).filter("word is not null and word <> ''"))


def import_lexicon_txt(lines: DataFrame) -> DataFrame:
    """(category, word) from `line`: `category:word` or a bare word for custom; # starts a comment."""
    line = trim_ws(F.col("line"))
    kept = lines.withColumn("line", line).filter((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    pair = F.split("line", ":", 2)
    cat = F.lower(trim_ws(pair[0]))
    word = trim_ws(F.try_element_at(pair, F.lit(2)))
    has = F.contains("line", F.lit(":"))
    return (kept.select(*[c for c in lines.columns if c != "line"],
                        F.when(has, F.when(cat.isin(*TYPES), cat)).otherwise("custom").alias("category"),
                        F.when(has, word).otherwise(F.col("line")).alias("word"))
            .filter("category is not null and word <> ''"))


def import_lexicon_table(lexicon: DataFrame) -> DataFrame:
    """YAML-shaped import: known categories stay, any other list goes to custom."""
    cat = F.when(F.col("category").isin(*TYPES), F.col("category")).otherwise("custom")
    return (lexicon.select(cat.alias("category"), trim_ws(F.col("word")).alias("word"), "cat_ord", "word_ord")
            .filter("word <> ''"))


def export_lexicon_csv(lexicon: DataFrame, path: str) -> None:
    """Two columns with a header, which starts with a byte order mark."""
    (lexicon.orderBy("cat_ord", "word_ord").select(F.col("category").alias("\ufeffcategory"), "word")
     .write.mode("overwrite").option("header", True).csv(path))


def read_lexicon_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("category string, word string").csv(path)


# ---- merging ----------------------------------------------------------------------------

def _first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_m")).select(*keys, "_m.*")


def merge_lexicon(base: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, counts). New words follow the existing ones of their category; blanks are ignored.

    `new` has (category, word, word_ord). `counts` is one row: added, duplicates.
    """
    clean = new.select("category", trim_ws(F.col("word")).alias("word"), "word_ord").filter("word <> ''")
    unseen = _first_of(clean, ["category", "word"], ["word_ord"]).join(
        base.select("category", "word").distinct(), ["category", "word"], "left_anti")
    ends = base.groupBy("category").agg(F.max("cat_ord").alias("cat_ord"), F.max("word_ord").alias("_end"))
    last = base.agg(F.coalesce(F.max("cat_ord"), F.lit(-1))).first()[0]
    added = (unseen.join(ends, "category", "left")
             .select("category", F.coalesce("cat_ord", F.lit(last + 1)).cast("int").alias("cat_ord"), "word",
                     (F.coalesce("_end", F.lit(-1)) + 1 + F.col("word_ord")).cast("long").alias("word_ord")))
    counts = clean.agg(F.count(F.lit(1)).alias("total")).withColumn("_one", F.lit(1)).join(
        added.agg(F.count(F.lit(1)).alias("added")).withColumn("_one", F.lit(1)), "_one").select(
        "added", (F.col("total") - F.col("added")).alias("duplicates"))
    return base.select("category", "cat_ord", "word", "word_ord").unionByName(added), counts


def merge_whitelist(base: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, counts) of two (word, ord) tables; existing words come first."""
    clean = new.select(trim_ws(F.col("word")).alias("word"), "ord").filter("word <> ''")
    fresh = _first_of(clean, ["word"], ["ord"]).join(base.select("word").distinct(), "word", "left_anti")
    end = base.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
    added = fresh.select("word", (F.col("ord") + end + 1).alias("ord"))
    counts = clean.agg(F.count(F.lit(1)).alias("total")).withColumn("_one", F.lit(1)).join(
        added.agg(F.count(F.lit(1)).alias("added")).withColumn("_one", F.lit(1)), "_one").select(
        "added", (F.col("total") - F.col("added")).alias("duplicates"))
    return base.select("word", "ord").unionByName(added), counts


def remove_whitelist(base: DataFrame, gone: DataFrame) -> DataFrame:
    """Words that stay; the removed count is the difference of the two counts."""
    targets = gone.select(trim_ws(F.col("word")).alias("_t")).filter("_t <> ''").distinct()
    return base.join(targets, trim_ws(F.col("word")) == F.col("_t"), "left_anti")
