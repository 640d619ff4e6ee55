"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm import bpe, exact_dedup, jaccard, langid, lexical, lm, packing, pii, quality, rules, spelling, token_counts, urls
from veilwork.llm.common import LOWER, UPPER, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
             ("net", "/fr/", "block")]


def byte_bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_exact(table(spark, sf_dir, "documents"))


ORACLE["op4_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")


ORACLE["op6_quality_rules"] = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
g2 AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM g),
g3 AS (SELECT doc_id, i FROM g2 QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g3) GROUP BY doc_id),
l AS (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (SELECT doc_id, host, t, line, trim(regexp_replace(translate(line, '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS norm,
             len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM m GROUP BY doc_id),
h AS (SELECT host, count(DISTINCT t) AS texts FROM d GROUP BY host),
c AS (SELECT host, norm, count(DISTINCT t) AS texts FROM m GROUP BY host, norm),
hot AS (SELECT host, norm FROM c JOIN h USING (host) WHERE c.texts > {rules.LINE_TEXTS} AND c.texts > {rules.LINE_SHARE} * h.texts),
lost AS (SELECT doc_id, sum(n) AS n FROM m JOIN hot USING (host, norm) GROUP BY doc_id),
o AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
             coalesce(r.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed_words
      FROM w LEFT JOIN r USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= {rules.LEFT_SHARE} * n_words AS kept
FROM o
"""


@query
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.filter_pages(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


ORACLE["op9_url_filters"] = f"""
WITH r(rhost, rpath, rverdict) AS (VALUES {", ".join(str(x) for x in URL_RULES)}),
u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT page_id, rhost || rpath AS rule, rverdict FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
      QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(rverdict, '{urls.DEFAULT_VERDICT}') AS verdict FROM u LEFT JOIN m USING (page_id)
"""


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.decode_documents(bpe.encode_documents(table(spark, sf_dir, "documents"), byte_bpe()), byte_bpe())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *map(count, pii.KINDS),
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(3) == 1)


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(remainder(4) != 2))
    return langid.identify(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), remainder(7) == 2)


@query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), byte_bpe(), limit=1024)


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


ORACLE["op13_lexical_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{lexical.TERM}') AS words FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{lexical.TERM}')) AS words FROM benchmark),
n AS (SELECT count(*) AS docs, sum(len(words)) AS terms FROM d WHERE len(words) > 0),
t AS (SELECT r, doc_id, any_value(len(words)) AS n, word, count(*) AS tf FROM (SELECT r, doc_id, words, unnest(words) AS word FROM d) GROUP BY r, doc_id, word),
w AS (SELECT word, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, n GROUP BY word, docs),
s AS (SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * t.n * docs) // CAST(terms AS BIGINT))))) AS BIGINT) AS score
      FROM (SELECT q, item_id, unnest(words) AS word FROM i) JOIN t USING (word) JOIN w USING (word), n GROUP BY q, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""
