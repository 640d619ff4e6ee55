"""Intervals over one unit's text: find, resolve, rebuild. All offsets are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions.rules import let
from veilwork.functions.text import quote_literal
from veilwork.schema import SPAN_DDL


def occurrences(text: Column, word: Column) -> Column:
    """0-based starts of the non-overlapping left-to-right occurrences of `word`."""
    def starts(p):
        return F.transform(F.slice(p, F.lit(1), F.size(p) - 1),
                           lambda _, i: F.length(F.array_join(F.slice(p, F.lit(1), i + 1), "")) + i * F.length(word))

    def after(first):
        # Most words occur once, which needs no split and no pattern of their own.
        return (F.when((word != "") & (first == 0), F.array().cast("array<int>"))
                .when((word != "") & (first > 0) & (F.position(word, text, first + F.length(word)) == 0), F.array(first - 1))
                .otherwise(let(F.split(text, quote_literal(word), -1), starts)))
    return let(F.instr(text, word), after)


def locate(text: Column, hits: Column) -> Column:
    """Every occurrence of every hit as a span."""
    def of_hit(h):
        return F.transform(occurrences(text, h["text"]), lambda s: F.struct(
            s.cast("int").alias("start"), (s + F.length(h["text"])).cast("int").alias("end"),
            h["text"].alias("text"), h["type"].alias("type"), h["source"].alias("source"),
            h["confidence"].alias("confidence")))
    return F.flatten(F.transform(F.filter(hits, lambda h: h["text"] != ""), of_hit))


def _by_start(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.coalesce(
        F.nullif(a["start"] - b["start"], F.lit(0)), a["end"] - b["end"]))


def _by_rank(spans: Column) -> Column:
    """Longest first, then most confident, then leftmost."""
    def cmp(a, b):
        by_len = (b["end"] - b["start"]) - (a["end"] - a["start"])
        by_conf = F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(0)
        return F.coalesce(F.nullif(by_len, F.lit(0)), F.nullif(by_conf, F.lit(0)), a["start"] - b["start"])
    return F.array_sort(spans, cmp)


def resolve(spans: Column) -> Column:
    """struct(kept, dropped): greedy choice by rank. Units without any overlap skip the greedy walk."""
    empty = F.array().cast(f"array<{SPAN_DDL}>")

    def walk(acc, s):
        clash = F.exists(acc["kept"], lambda c: (s["start"] < c["end"]) & (c["start"] < s["end"]))
        return F.when(clash, F.struct(acc["kept"].alias("kept"), F.concat(acc["dropped"], F.array(s)).alias("dropped"))
                      ).otherwise(F.struct(F.concat(acc["kept"], F.array(s)).alias("kept"), acc["dropped"].alias("dropped")))

    def choose(sorted_spans):
        neighbours = F.sequence(F.lit(1), F.size(sorted_spans) - 1)
        overlap = (F.size(sorted_spans) > 1) & F.exists(
            F.when(F.size(sorted_spans) > 1, neighbours), lambda i: sorted_spans[i]["start"] < sorted_spans[i - 1]["end"])
        greedy = F.aggregate(
            _by_rank(sorted_spans), F.struct(empty.alias("kept"), empty.alias("dropped")), walk,
            lambda a: F.struct(_by_start(a["kept"]).alias("kept"), a["dropped"].alias("dropped")))
        return F.when(overlap, greedy).otherwise(F.struct(sorted_spans.alias("kept"), empty.alias("dropped")))

    return let(_by_start(spans), choose)


def rebuild(text: Column, spans: Column, new_text) -> Column:
    """Text with every span replaced by `new_text(span)`; spans are disjoint and sorted by start."""
    def cut(sp):
        pieces = F.transform(sp, lambda s, i: F.concat(
            F.substring(text, F.when(i > 0, sp[i - 1]["end"]).otherwise(0) + 1,
                        s["start"] - F.when(i > 0, sp[i - 1]["end"]).otherwise(0)),
            new_text(s)))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(sp, -1)["end"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, let(spans, cut)).otherwise(text)


def context(text: Column, pos: Column, length: Column, n: int = 50) -> Column:
    """`n` characters either side of the 1-based position, clipped to the text."""
    lo = F.greatest(F.lit(1), pos - n)
    return F.substring(text, lo, pos + length + n - lo)
