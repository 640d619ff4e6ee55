"""Putting originals back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from veilwork.functions.text import trim_ws
from veilwork.operators.phrases import PhraseIndex, build_index, confirm, with_candidates
from veilwork.schema import UNIT_KEY
from veilwork.session import stage

# Fixed value: a restored value with this shape goes back as a number.
NUMBER_FORM = r"^-?\p{Nd}{1,19}(?:\.\p{Nd}{1,6})?$"
PAIRS = "array<struct<token:string,original:string,kind:string>>"


def bracket_gate(mapping: DataFrame, key: str = "token") -> DataFrame:
    """One row, one boolean: may rows without `[` be skipped? Only if every key has one."""
    return mapping.agg(F.coalesce(F.bool_and(F.contains(F.col(key), F.lit("["))), F.lit(False)).alias("gate"))


def unmask_inline(units: DataFrame, pairs: list[tuple[str, str]], text_col: str = "text") -> DataFrame:
    """The rule itself, for a mapping at hand: successive replacement, longest key first, with the set of keys that were present."""
    ordered = sorted((p for p in pairs if p[0]), key=lambda p: (-len(p[0]), p[0]))
    text = F.col(text_col)
    if not ordered:
        return units.withColumn("restored", text).withColumn("hits", F.array().cast("array<string>"))
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in ordered])
    start = F.struct(text.alias("t"), F.array().cast("array<string>").alias("hits"))

    def step(acc, p):
        return F.when(F.contains(acc["t"], p["k"]), F.struct(
            F.replace(acc["t"], p["k"], p["v"]).alias("t"), F.concat(acc["hits"], F.array(p["k"])).alias("hits"))
        ).otherwise(acc)
    out = units.withColumn("_r", F.aggregate(keys, start, step))
    return out.withColumn("restored", F.col("_r.t")).withColumn("hits", F.col("_r.hits")).drop("_r")


def replace_in_turn(text: str, pairs: list[tuple[str, str]]) -> tuple[str, list[str], list[tuple[int, str]]]:
    """The text after successive replacement by `pairs` in their order, the keys that were present, and the surroundings of what was put
    in, each with the length from which a key is too long to be due after it."""
    hits, around = [], []
    for key, original in pairs:
        gaps = text.split(key)
        if len(gaps) == 1:
            continue
        hits.append(key)
        text, at, reach = original.join(gaps), 0, len(key) - 1
        for gap in gaps[:-1]:
            at += len(gap)
            around.append((len(key), text[max(0, at - reach):at + len(original) + reach]))
            at += len(original)
    return text, hits, around


# Characters around replacements that are searched together for keys.
WINDOW_CHARS = 1 << 20


def later_keys(index: PhraseIndex, waiting: list[tuple[list[tuple[int, str]], set[str]]]) -> list[list[str]]:
    """Per text, of which `waiting` has the surroundings of what was put in and the keys it was given, the other strings there that may be keys due later."""
    found = iter(index.candidates([window for around, _ in waiting for _, window in around]))
    return [sorted({c for (limit, _), some in zip(around, found) for c in some if len(c) <= limit} - own) for around, own in waiting]


def _apply(rows: DataFrame, index: PhraseIndex, text_col: str) -> DataFrame:
    """`rows` with `restored`, `hits` and `_more`: strings that may be keys and came up only by a replacement."""
    shared = rows.sparkSession.sparkContext.broadcast((index.bits, index.lengths))

    def run(batches):
        known = PhraseIndex(*shared.value)
        for batch in batches:
            restored, hits, more, waiting, size = [], [], [], [], 0
            for text, pairs in zip(batch.column(text_col).to_pylist(), batch.column("_pairs").to_pylist(), strict=True):
                ordered = sorted(((p["token"], p["original"]) for p in pairs), key=lambda p: (-len(p[0]), p[0]))
                new, found, around = replace_in_turn(text, ordered)
                restored.append(new)
                hits.append(found)
                waiting.append((around, {k for k, _ in ordered}))  # texts are searched together: one by one the search costs far more than what it reads
                size += sum(len(window) for _, window in around)
                if size >= WINDOW_CHARS:
                    more += later_keys(known, waiting)
                    waiting, size = [], 0
            more += later_keys(known, waiting)
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(restored, pa.string()), pa.array(hits, strings), pa.array(more, strings)],
                                             [*batch.schema.names, "restored", "hits", "_more"])

    strings = ArrayType(StringType())
    schema = StructType([*rows.schema.fields]).add("restored", "string").add("hits", strings).add("_more", strings)
    return rows.mapInArrow(run, schema)


def _restored(units: DataFrame, mapping: DataFrame, text_col: str) -> DataFrame:
    """`units` with `restored`, `hits` and `_pairs`, the mapping's rows whose keys came up in the text."""
    kind = F.col("kind") if "kind" in mapping.columns else F.lit(None).cast("string")
    keys = mapping.filter("token <> '' and original is not null").groupBy("token").agg(F.min(F.struct("original", kind.alias("kind"))).alias("m"))
    keys = stage(keys.select("token", "m.original", "m.kind"))
    untouched = {"restored": F.col(text_col), "hits": F.array().cast("array<string>"), "_pairs": F.array().cast(PAIRS)}
    index = build_index(keys, "token")
    if index is None:
        return units.withColumns(untouched)
    marked = with_candidates(units, index, text_col, "_found")
    some = stage(marked.filter(F.size("_found") > 0))
    known = stage(confirm(some.select(*UNIT_KEY, F.explode("_found").alias("token")), keys, "token"))
    some = some.drop("_found")
    while True:
        per_unit = known.groupBy(*UNIT_KEY).agg(F.collect_list(F.struct("token", "original", "kind")).alias("_pairs"))
        # A text keeps at most as many pairs as it has different keys in it.
        paired = some.join(per_unit, list(UNIT_KEY), "left").withColumn("_pairs", F.coalesce("_pairs", untouched["_pairs"]))
        done = stage(_apply(paired, index, text_col))
        more = confirm(done.select(*UNIT_KEY, F.explode("_more").alias("token")), keys, "token")
        if more.isEmpty():
            break
        known = stage(known.unionByName(more.select(*known.columns)))
    rest = marked.filter(F.size("_found") == 0).drop("_found").withColumns(untouched)
    return done.select(*rest.columns).unionByName(rest)


def unmask(units: DataFrame, mapping: DataFrame, text_col: str = "text") -> DataFrame:
    """Add `restored` and `hits` (the keys that were present) to `units`.

    One rule for mappings of any size and keys of any shape: each key of `mapping` (token, original) is replaced everywhere, the longest
    first, equal lengths by code points. So of nested or overlapping keys the longest wins, and a key that an earlier replacement
    brings up is replaced if its turn is still to come. The keys are found by an index of fixed size and an equi-join, never collected;
    only texts that may hold one are shuffled. A key that came up by a replacement leads to another round for the texts.
    Null texts stay null; null and empty keys, and null originals, are left out; of rows with the same key that with the smallest original counts.
    """
    return _restored(units, mapping, text_col).drop("_pairs")


def unmask_tokens(units: DataFrame, mapping: DataFrame, text_col: str = "text") -> DataFrame:
    """As `unmask`; the name for mappings of numbered placeholders."""
    return unmask(units, mapping, text_col)


def restore_value(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Restore cells and keep numbers as numbers.

    A cell that is exactly one `number` token whose original looks like a plain number also gets
    `value_long` or `value_double`; anything mixed, or of unknown kind, stays text.
    """
    restored = _restored(cells, mapping, "text")
    only = F.when((F.size("hits") == 1) & (trim_ws(F.col("text")) == F.col("hits")[0]), F.col("hits")[0])
    numeric: Column = F.coalesce(F.exists("_pairs", lambda p: (p["token"] == only) & (p["kind"] == "number")), F.lit(False)) & F.col("restored").rlike(NUMBER_FORM)
    point = F.contains("restored", F.lit("."))
    return (restored.withColumn("value_long", F.when(numeric & ~point, F.expr("try_cast(restored as decimal(38,0))")))
            .withColumn("value_double", F.when(numeric & point, F.expr("try_cast(restored as double)"))).drop("_pairs"))
