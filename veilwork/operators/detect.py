"""Detection channels over text units.

Each channel adds an array of hits to a unit, so manual words, small lexicons, taggers and rules
run without a shuffle. `detections` turns the arrays into the usual one-row-per-hit table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.config import MaskConfig
from veilwork.functions.rule_scan import char_kinds, left_out, rule_matches
from veilwork.functions.rules import RULES, let, no_hits, regex_hits
from veilwork.functions.spans import context
from veilwork.operators.phrases import PhraseIndex, TextBlock, build_index, confirm, occurring, text_blocks
from veilwork.operators.tagging import ner_hits, tag_units
from veilwork.schema import CHANNELS, HITS, HITS_DDL, TYPES, UNIT_KEY
from veilwork.session import BROADCAST_ROWS, stage, table_join

# Beyond so many bytes of words a lexicon, or a whitelist, is joined and not broadcast.
BROADCAST_BYTES = 16 << 20


def _hit(text: Column, type_: Column, source: str, rule: Column, pos: Column) -> Column:
    return F.struct(text.alias("text"), type_.alias("type"), F.lit(source).alias("source"),
                    F.lit(0.95).alias("confidence"), F.lit(CHANNELS[source]).alias("channel"),
                    rule.cast("long").alias("rule"), pos.cast("int").alias("pos"))


# ---- manual words -----------------------------------------------------------------------

def manual_hits(text: Column, words: Sequence[str]) -> Column:
    """Words the user typed for this run: exact, custom, never held back by the whitelist."""
    ordered = [w for w in dict.fromkeys(words) if w]
    if not ordered:
        return no_hits()
    listed = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(ordered)])
    found = F.filter(listed, lambda x: F.contains(text, x["w"]))
    return F.transform(found, lambda x: _hit(x["w"], F.lit("custom"), "manual", x["i"], F.instr(text, x["w"])))


# ---- lexicon ----------------------------------------------------------------------------

def prepare_lexicon(lexicon: DataFrame, whitelist: Sequence[str] | DataFrame = ()) -> DataFrame:
    """(word, type, rule): one row per word, first category wins, whitelisted words removed."""
    kind = F.when(F.col("category").isin(*TYPES), F.col("category")).otherwise("custom")
    # Category order is the major key, word order the minor one.
    rule = F.col("cat_ord").cast("long") * F.lit(1 << 40) + F.col("word_ord")
    words = (lexicon.filter(F.col("word") != "")
             .groupBy("word").agg(F.min(F.struct(rule.alias("rule"), kind.alias("type"))).alias("m"))
             .select("word", "m.type", "m.rule"))
    if isinstance(whitelist, DataFrame):
        return words.join(whitelist.select("word"), "word", "left_anti")
    return words.filter(~F.col("word").isin(*whitelist)) if whitelist else words


def dictionary_inline(units: DataFrame, words: list) -> DataFrame:
    """Every word tested against every text; the right shape for a handful of words."""
    if not words:
        return units.withColumn("dict_hits", no_hits())
    listed = F.array(*[F.struct(F.lit(r["word"]).alias("w"), F.lit(r["type"]).alias("t"), F.lit(r["rule"]).alias("r"))
                       for r in sorted(words, key=lambda r: r["rule"])])
    text = F.col("text")
    found = F.filter(listed, lambda x: F.contains(text, x["w"]))
    return units.withColumn("dict_hits", F.transform(
        found, lambda x: _hit(x["w"], x["t"], "dictionary", x["r"], F.instr(text, x["w"]))))


class RuleScan(NamedTuple):
    """What tasks need to find the hits of rules beside those of words."""

    kinds: np.ndarray | None  # of each code point
    harmless: tuple[str, ...]
    positions: bool


NO_RULES = RuleScan(None, (), True)


class HitArrays:
    """Hits of words (numbered in their order) and of rules (numbered after them) as arrays, with the fields of HITS_DDL."""

    def __init__(self, words: Sequence[tuple[int, str, str]], kinds: np.ndarray | None, harmless: Sequence[str], positions: bool):
        orders, self.words, types = zip(*words) if words else ((), (), ())
        self.numbers, self.kinds = {w: i for i, w in enumerate(self.words)}, kinds
        self.harmless, self.positions = frozenset(harmless), positions
        self.types = pa.array([*types, *[r.type for r in RULES]], pa.string())
        self.orders = pa.array([*orders, *range(len(RULES))], pa.int64())
        self.sources = pa.array(["dictionary", *["regex"] * len(RULES)])
        self.confidence = pa.array([0.95, *[r.confidence for r in RULES]])
        self.channels = pa.array([CHANNELS["dictionary"], *[CHANNELS["regex"]] * len(RULES)], pa.int32())
        self.found: list[tuple[str, int, int]] = []
        self.ends, self.whole = [0], []

    def add(self, block: TextBlock, strings: Sequence[dict[str, int]]) -> None:
        """The hits of the texts of a block, the first of every text: words among `strings`, then rules, but for the texts left to the patterns."""
        rules, late = [()] * len(block.texts), set()
        if self.kinds is not None:
            text, rule, start, end = rule_matches(block.codes, block.ends, self.kinds)
            first = block.starts[text]
            rows = list(zip((rule + len(self.words)).tolist(), (start - first).tolist(), (end - first).tolist(), strict=True))
            bounds = np.searchsorted(text, np.arange(len(block.texts) + 1)).tolist()
            rules = [rows[a:b] for a, b in zip(bounds, bounds[1:])]
            late = set(left_out(block.codes, block.ends, self.kinds).tolist())
        known = self.numbers
        for i, (text, some) in enumerate(zip(block.texts, strings, strict=True)):
            hits = {}
            for number, place in sorted((known[w], place) for w, place in some.items() if w in known):
                hits[self.words[number]] = (number, place)
            if i not in late:
                for number, a, b in rules[i]:
                    word = text[a:b]
                    if word not in hits and word not in self.harmless:
                        hits[word] = (number, a)
            self.found += [(w, *x) for w, x in hits.items()]
            self.ends.append(len(self.found))
            self.whole.append(i not in late)

    def take_places(self) -> tuple[pa.ListArray, pa.Array]:
        """As `take`, but of each hit only its number, where it stands (from 1) and its length."""
        texts, numbers, places = zip(*self.found) if self.found else ((), (), ())
        rows = pa.StructArray.from_arrays([pa.array(numbers, pa.int32()), pa.array(np.array(places, "int32") + 1), pa.array(list(map(len, texts)), pa.int32())],
                                          ["rule", "pos", "size"])
        out = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), rows), pa.array(self.whole, pa.bool_())
        self.found, self.ends, self.whole = [], [0], []
        return out

    def take(self) -> tuple[pa.ListArray, pa.Array]:
        """The hits of the texts added since the last call, and whether the rules were tried on them."""
        texts, numbers, places = zip(*self.found) if self.found else ((), (), ())
        number, pos = np.array(numbers, "int64"), np.array(places, "int32") + 1
        kind = pa.array(np.maximum(number - len(self.words) + 1, 0))
        number, unplaced = pa.array(number), np.zeros(len(pos), bool) if self.positions else number >= len(self.words)
        rows = pa.StructArray.from_arrays(
            [pa.array(texts, pa.string()), self.types.take(number), self.sources.take(kind), self.confidence.take(kind),
             self.channels.take(kind), self.orders.take(number), pa.array(pos, pa.int32(), mask=unplaced)],
            ["text", "type", "source", "confidence", "channel", "rule", "pos"])
        out = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), rows), pa.array(self.whole, pa.bool_())
        self.found, self.ends, self.whole = [], [0], []
        return out


def dictionary_broadcast(units: DataFrame, words: list, index: PhraseIndex, rules: RuleScan | None = None) -> DataFrame:
    """Strings that the index lets through are looked up in a broadcast table, in the scan task; the rules search the same arrays."""
    table = sorted((r["rule"], r["word"], r["type"]) for r in words)
    shared = units.sparkSession.sparkContext.broadcast((index.bits, index.lengths, table, tuple(rules or NO_RULES)))

    @F.arrow_udf(f"struct<hits:{HITS_DDL},whole:boolean>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bits, lengths, table, rules = shared.value
        known, hits = PhraseIndex(bits, lengths), HitArrays(table, *rules)
        for texts in batches:
            for block in text_blocks(texts.to_pylist()):
                hits.add(block, known.first_places(block))
            yield pa.StructArray.from_arrays(hits.take(), ["hits", "whole"])

    out = units.withColumn("_scan", scan("text")).withColumn("dict_hits", F.col("_scan.hits"))
    return (out if rules is None else out.withColumn("_whole", F.col("_scan.whole"))).drop("_scan")


def rules_scanned(units: DataFrame, rules: RuleScan) -> DataFrame:
    """Add `rule_hits` and `_whole`, which is false where the patterns have to be tried: the rules search texts as arrays."""
    shared = units.sparkSession.sparkContext.broadcast(tuple(rules))

    @F.arrow_udf(f"struct<hits:{HITS_DDL},whole:boolean>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hits = HitArrays((), *shared.value)
        for texts in batches:
            for block in text_blocks(texts.to_pylist()):
                hits.add(block, [{}] * len(block.texts))
            yield pa.StructArray.from_arrays(hits.take(), ["hits", "whole"])

    return units.withColumn("_scan", scan("text")).withColumn("rule_hits", F.col("_scan.hits")).withColumn("_whole", F.col("_scan.whole")).drop("_scan")


def ngram_rows(units: DataFrame, words: DataFrame, key: Sequence[str] = UNIT_KEY) -> DataFrame:
    """(key, word, type, rule) of the words that occur in each unit, by an index of their ends and an equi join."""
    rows = occurring(units, words, tuple(key), column="word")
    return rows.select(*key, "word", *[c for c in words.columns if c != "word"])


def _rule_hits_at(text: Column, places: Column, positions: bool) -> Column:
    """Hits of rules from their numbers, places and lengths in `text`."""
    def hit(p):
        rule = F.element_at(F.array(*[F.struct(F.lit(r.type).alias("type"), F.lit(r.confidence).alias("confidence")) for r in RULES]), p["rule"] + 1)
        return F.struct(F.substring(text, p["pos"], p["size"]).alias("text"), rule["type"].alias("type"), F.lit("regex").alias("source"),
                        rule["confidence"].alias("confidence"), F.lit(CHANNELS["regex"]).alias("channel"), p["rule"].cast("long").alias("rule"),
                        (p["pos"] if positions else F.lit(None)).cast("int").alias("pos"))
    return F.transform(places, hit)


def dictionary_join(units: DataFrame, words: DataFrame, index: PhraseIndex, rules: RuleScan | None = None) -> DataFrame:
    """Units are searched once, by the rules as well, and staged with the strings that the index lets through, each under a number of its own, so
    keys may be null or repeat. Only units with such strings are shuffled, by that number. What the rules find is kept as places in the texts."""
    shared = units.sparkSession.sparkContext.broadcast((index.bits, index.lengths, tuple(rules or NO_RULES)))

    def run(batches):
        bits, lengths, rules = shared.value
        known, hits = PhraseIndex(bits, lengths), HitArrays((), *rules)
        for batch in batches:
            sizes, places, ends = [], [], [0]
            for block in text_blocks(batch.column("text").to_pylist()):
                strings = known.first_places(block)
                for some in strings:
                    sizes += map(len, some)
                    places += some.values()
                    ends.append(len(sizes))
                hits.add(block, strings)
            found = pa.StructArray.from_arrays([pa.array(np.array(places, "int32") + 1), pa.array(sizes, pa.int32())], ["pos", "size"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found), *hits.take_places()],
                                             [*batch.schema.names, "_found", "_rules", "_whole"])

    place = T.StructType().add("pos", "integer").add("size", "integer")
    numbered = T.StructType().add("rule", "integer").add("pos", "integer").add("size", "integer")
    schema = T.StructType([*units.schema.fields]).add("_found", T.ArrayType(place)).add("_rules", T.ArrayType(numbered)).add("_whole", "boolean")
    marked = stage(units.mapInArrow(run, schema).withColumn("_unit", F.monotonically_increasing_id()))
    text = F.col("text")
    by_rules = no_hits() if rules is None else _rule_hits_at(text, F.col("_rules"), rules.positions)  # without rules texts need not be shuffled
    some = marked.filter(F.size("_found") > 0).drop("_found")
    strings = F.transform("_found", lambda f: F.struct(F.substring(text, f["pos"], f["size"]).alias("word"), f["pos"].alias("pos")))
    asked = marked.select("_unit", F.explode(strings).alias("f")).select("_unit", "f.word", "f.pos")
    rows = confirm(asked, words, "word")
    grouped = rows.groupBy("_unit").agg(F.array_sort(F.collect_list(F.struct("rule", "word", "type", "pos"))).alias("found"))
    hits = F.transform("found", lambda x: _hit(x["word"], x["type"], "dictionary", x["rule"], x["pos"]))
    both = let(F.struct(hits.alias("words"), by_rules.alias("rules")), lambda b: F.concat(
        b["words"], F.filter(b["rules"], lambda h: ~F.exists(b["words"], lambda x: x["text"] == h["text"]))))
    joined = some.join(grouped, "_unit", "left").withColumn("dict_hits", F.when(F.col("found").isNull(), by_rules).otherwise(both)).drop("found")
    rest = marked.filter(F.size("_found") == 0).drop("_found").withColumn("dict_hits", by_rules)
    return joined.unionByName(rest).drop("_unit", "_rules", *(["_whole"] if rules is None else []))


def detect_dictionary(units: DataFrame, words: DataFrame, method: str | None = None, rules: RuleScan | None = None) -> DataFrame:
    """Add `dict_hits`. The index finds the strings that may be words; what they are is looked up in a broadcast of the
    prepared lexicon if its counted rows and bytes allow one, else by a join. `method` names one of the forms.

    With `rules` the hits of these stand behind those of the words, and `_whole` is false where they are still to be added. An empty lexicon
    and the form `inline` do not search for rules, and add no `_whole`."""
    if method == "ngram":
        method = "join"
    size = words.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("bytes")).first()
    if method == "inline":
        return dictionary_inline(units, words.collect())
    joined = method == "join" or (method is None and (size["rows"] > BROADCAST_ROWS or size["bytes"] > BROADCAST_BYTES))
    words = stage(words) if joined else words  # prepared once for the index and the join
    index = build_index(words, "word")
    if index is None:
        return units.withColumn("dict_hits", no_hits())
    if joined:
        return dictionary_join(units, words, index, rules)
    return dictionary_broadcast(units, words.collect(), index, rules)


# ---- all channels -----------------------------------------------------------------------

def first_per_text(hits: Column) -> Column:
    """Keep the first hit of every text; the array is ordered by channel, rule and position."""
    return let(F.transform(hits, lambda h: h["text"]),
               lambda texts: F.filter(hits, lambda h, i: F.array_position(texts, h["text"]) == i + 1))


def detect(units: DataFrame, cfg: MaskConfig = MaskConfig(), lexicon: DataFrame | None = None,
           tagger=None, regex: bool = True, method: str | None = None, positions: bool = True,
           whitelist: DataFrame | None = None) -> DataFrame:
    """Units plus `hits`. A manual-only run (`auto_detect=False`) closes the other channels.

    `whitelist` (word) is a table of any size, beside the few words of `cfg.whitelist`. The method `scan` has the rules of a run
    without lexicon and tagger search arrays instead of patterns; the hits are the same.
    """
    listed = list(cfg.whitelist)
    text = F.col("text")
    out = units
    parts = [manual_hits(text, cfg.manual_words)]
    drop = []
    if cfg.auto_detect and lexicon is not None:
        # The tagger's hits come between those of words and rules.
        rules = RuleScan(char_kinds(units.sparkSession), tuple(listed), positions) if regex and tagger is None else None
        out = detect_dictionary(out, prepare_lexicon(lexicon, listed), method, rules)
        parts.append(F.col("dict_hits"))
        drop.append("dict_hits")
    elif cfg.auto_detect and regex and tagger is None and method == "scan":
        out = rules_scanned(out, RuleScan(char_kinds(units.sparkSession), tuple(listed), positions))
        parts.append(F.col("rule_hits"))
        drop.append("rule_hits")
    if cfg.auto_detect and tagger is not None:
        out = tag_units(out, tagger).withColumn("ner_found", ner_hits(text, F.col("tags")))
        parts.append(F.col("ner_found"))
        drop += ["tags", "ner_found"]
    searched = "_whole" in out.columns and "_whole" not in units.columns
    if cfg.auto_detect and regex:
        by_pattern = regex_hits(text, positions=positions)
        parts.append(F.when(F.col("_whole"), no_hits()).otherwise(by_pattern) if searched else by_pattern)
    hits = F.concat(*parts)
    if listed:
        harmless = F.array(*[F.lit(w) for w in listed])
        hits = F.filter(hits, lambda h: (h["source"] == "manual") | ~F.array_contains(harmless, h["text"]))
    # Bound once: every mention of an unbound expression would run all channels again.
    once = let(hits, lambda h: F.when(F.size(h) > 1, first_per_text(h)).otherwise(h))
    if searched:
        drop.append("_whole")
        if not cfg.manual_words:  # the scan left the first hit of every text, and none on harmless words
            once = F.when(F.col("_whole"), parts[1]).otherwise(once)
    out = out.withColumn("hits", once).drop(*drop)
    return out if whitelist is None or not cfg.auto_detect else spare_whitelisted(out, whitelist)


def spare_whitelisted(detected: DataFrame, whitelist: DataFrame) -> DataFrame:
    """`detected` without hits on words of the table `whitelist`, those of the manual channel excepted. A whitelist whose counted rows and
    bytes allow it is looked up in place; else skinny rows of hit texts meet it in a join, and only units with such a hit are shuffled."""
    words = stage(whitelist.select("word").filter("word <> ''").distinct())
    size = words.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("bytes")).first()
    keep = lambda h, harmless: (h["source"] == "manual") | ~harmless
    if size["rows"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES:
        shared = detected.sparkSession.sparkContext.broadcast(frozenset(r["word"] for r in words.collect()))

        def run(batches):
            harmless = shared.value
            for batch in batches:
                at = batch.schema.get_field_index("hits")
                hits, flat = batch.column(at), batch.column(at).flatten()
                stays = np.array([source == "manual" or text not in harmless for text, source in zip(
                    flat.field("text").to_pylist(), flat.field("source").to_pylist(), strict=True)], bool)
                owner = pc.list_parent_indices(hits).to_numpy(zero_copy_only=False)[stays]
                ends = np.cumsum(np.bincount(owner, minlength=len(batch)))
                left = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), flat.filter(pa.array(stays)))
                yield batch.set_column(at, "hits", left)

        return detected.mapInArrow(run, detected.schema)
    some = stage(detected.filter(F.size("hits") > 0))
    texts = stage(some.select(*UNIT_KEY, F.explode(F.array_distinct(F.transform("hits", lambda h: h["text"]))).alias("word")))
    harmless = table_join(texts, words, "word", "left_semi").groupBy(*UNIT_KEY).agg(F.collect_set("word").alias("_harmless"))
    joined = some.join(harmless, list(UNIT_KEY), "left")
    spared = F.when(F.col("_harmless").isNull(), F.col("hits")).otherwise(F.filter("hits", lambda h: keep(h, F.array_contains("_harmless", h["text"]))))
    return joined.withColumn("hits", spared).drop("_harmless").unionByName(detected.filter(F.size("hits") == 0))

def detections(units_with_hits: DataFrame, n_context: int = 50) -> DataFrame:
    """One row per hit, with context around its place."""
    # The outer form, because a plain explode makes the optimizer test the array's size in a
    # filter of its own and so detect twice.
    flat = (units_with_hits.select(*UNIT_KEY, F.col("text").alias("unit_text"), F.posexplode_outer("hits").alias("det_ord", "h"))
            .filter("h is not null"))
    return flat.select(
        *UNIT_KEY, "det_ord", "h.text", F.col("h.type").alias("text_type"), "h.source", "h.confidence",
        context(F.col("unit_text"), F.col("h.pos"), F.length("h.text"), n_context).alias("context"),
        F.col("h.channel").alias("channel_ord"), F.col("h.rule").alias("rule_ord"), "h.pos")


def apply_whitelist(rows: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Whole-match exclusion for every channel but the manual one."""
    words = whitelist.select(F.col("word").alias("text")).distinct()
    manual = F.coalesce(F.col("source") == "manual", F.lit(False))
    return rows.filter(manual).unionByName(table_join(rows.filter(~manual), words, "text", "left_anti").select(*rows.columns))


def dedup_channels(rows: DataFrame) -> DataFrame:
    """Row form of the per-unit dedup, for detections gathered from several tables."""
    w = W.partitionBy(*UNIT_KEY, "text").orderBy("channel_ord", "rule_ord", "pos")
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def dedup_across_files(rows: DataFrame) -> DataFrame:
    """First detection of each (text, type) in reading order over the whole run.

    A minimum over a struct is a partial aggregate, so a text that fills a third of the table
    costs one row per map task in the shuffle.
    """
    order = ("file_ord", "unit_ord", "channel_ord", "rule_ord", "pos")
    rest = [c for c in rows.columns if c not in order and c not in ("text", "text_type")]
    packed = F.struct(*order, *rest)
    return (rows.groupBy("text", "text_type").agg(F.min(packed).alias("m"))
            .select("text", "text_type", "m.*").select(*rows.columns))


# Shapes of regex hits that stay meaningful inside a file or folder name.
LONG_DIGITS = r"^\p{Nd}{16,19}$"


def path_name_filter(rows: DataFrame, name_key: Sequence[str] = UNIT_KEY) -> DataFrame:
    """Keep what makes sense in a name and mark it as found in a path.

    Amounts and bare 16-19 digit runs from the rules are price tags and order numbers there, and
    a tagger hit inside a longer lexicon hit of the same name adds nothing.
    """
    plain = ~((F.col("source") == "regex") & (
        (F.col("text_type") == "amount") | F.col("text").rlike(LONG_DIGITS)))
    # The words of one name are few: compare them inside the name, not across names.
    per_name = W.partitionBy(*name_key)
    words = F.collect_set(F.when(F.col("source") == "dictionary", F.col("text"))).over(per_name)
    nested = (F.col("source") == "ner") & F.exists(
        "_words", lambda d: (d != F.col("text")) & F.contains(d, F.col("text")))
    return (rows.withColumn("_words", words).filter(plain & ~nested).drop("_words")
            .withColumn("origin_source", F.col("source")).withColumn("source", F.lit("path")))


def is_ai_detected(source: Column, origin_source: Column, reason: Column) -> Column:
    from veilwork.operators.assist import DETECT_REASON_PREFIX
    effective = F.when(F.coalesce(origin_source, F.lit("")) != "", origin_source).otherwise(F.coalesce(source, F.lit("")))
    return (effective == "llm") | F.coalesce(reason, F.lit("")).startswith(DETECT_REASON_PREFIX)
