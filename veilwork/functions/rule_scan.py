"""The rules of `functions.rules` over many texts at once, as arrays of code points: what matches, and where.

It finds what the patterns find, in their order, but in texts of `left_out`. What a digit or a word character is comes from the engine that runs the patterns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilwork.functions.rules import DIGIT, RULES, SPACE, WORD

POINTS = 0x110000  # code points; the number of the mark between two texts
IS_DIGIT, IS_WORD, IS_ADDRESS, IS_SPACE, IS_COUNT = 1, 2, 4, 8, 16  # IS_COUNT: digits and commas
PLUS, COMMA, HYPHEN, DOT, AT = map(ord, "+,-.@")
ONE, THREE, SIX, EIGHT, NINE = map(ord, "13689")
WAN, YI, YUAN, YEAR, MONTH, DAY = map(ord, "万亿元年月日")


_KINDS: list[np.ndarray] = []  # found once per process


def char_kinds(spark: SparkSession) -> np.ndarray:
    """The kinds of each code point, by the regular expressions of the session's engine."""
    if _KINDS:
        return _KINDS[0]
    char = F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')")
    points = spark.range(POINTS).filter("id not between 55296 and 57343").select("id", char.alias("c"))
    kinds = {IS_DIGIT: DIGIT, IS_WORD: WORD, IS_SPACE: SPACE}
    kind = sum((F.col("c").rlike(rf"\A{p}\z").cast("int") * F.lit(k) for k, p in kinds.items()), F.lit(0))
    rows = points.select("id", kind.alias("kind")).filter("kind > 0").toPandas()
    table = np.zeros(POINTS + 1, "u1")
    table[rows["id"].to_numpy()] = rows["kind"].to_numpy()
    table[(table & IS_WORD) > 0] |= IS_ADDRESS
    table[[DOT, HYPHEN]] |= IS_ADDRESS
    table[(table & IS_DIGIT) > 0] |= IS_COUNT
    table[COMMA] |= IS_COUNT
    _KINDS.append(table)
    return table


class Runs:
    """Longest runs of places where `mask` holds; it does not at the last place."""

    def __init__(self, mask: np.ndarray):
        edges = np.flatnonzero(np.diff(mask.view("i1"), prepend=np.int8(0)))
        self.starts, self.ends = edges[::2], edges[1::2]

    def end(self, at: np.ndarray) -> np.ndarray:
        """Where the run that holds a place ends; the place itself if none does."""
        if not len(self.starts):
            return at
        i = np.searchsorted(self.starts, at, "right") - 1
        return np.where(i >= 0, np.maximum(self.ends[i], at), at)

    def start(self, at: np.ndarray) -> np.ndarray:
        return self.starts[np.searchsorted(self.starts, at, "right") - 1]


def _is_one_of(codes: np.ndarray, *points: int) -> np.ndarray:
    return np.logical_or.reduce([codes == p for p in points])


def _amounts(c: np.ndarray, kinds: np.ndarray, runs: Runs):
    """(start, end) of rmb_amount and of generic_amount."""
    counts = None

    def number_end(at):
        at = counts.end(at)
        at = at + (c[at] == DOT)
        return runs.end(at)

    none = np.empty(0, "int64")
    rmb = generic = (none, none)
    a = np.flatnonzero(c == ord("人"))
    a = a[a + 2 < len(c)]
    a = a[(c[a + 1] == ord("民")) & (c[a + 2] == ord("币"))]
    units = _is_one_of(c, WAN, YI)
    many = units.any()
    if len(a) or many:
        counts = Runs((kinds & IS_COUNT) > 0)
    if len(a):
        first = Runs((kinds & IS_SPACE) > 0).end(a + 3)
        a, first = a[kinds[first] & IS_COUNT > 0], first[kinds[first] & IS_COUNT > 0]
        end = number_end(first)
        end = end + units[end]
        rmb = (a, end + (c[end] == YUAN))
    if many:
        a = runs.starts[c[runs.starts - 1] != DOT]
        end = number_end(a)
        a, end = a[units[end]], end[units[end]] + 1
        end = end + (c[end] == YUAN)
        first = np.diff(end, prepend=-1) != 0  # starts behind a comma of the same number end where it ends
        generic = (a[first], end[first])
    return rmb, generic


def _addresses(c: np.ndarray, kinds: np.ndarray):
    at = np.flatnonzero(c == AT)
    if len(at):
        at = at[(kinds[at - 1] & IS_ADDRESS > 0) & (kinds[at + 1] & IS_ADDRESS > 0)]
    if not len(at):
        return at, at
    address, word = Runs((kinds & IS_ADDRESS) > 0), Runs((kinds & IS_WORD) > 0)
    dots = np.flatnonzero((c[:-1] == DOT) & (kinds[1:] & IS_WORD > 0))
    last = np.searchsorted(dots, address.end(at + 1)) - 1
    dot = dots[last] if len(dots) else np.full(len(at), -1)
    good = (last >= 0) & (dot >= at + 2)
    at, dot = at[good], dot[good]
    start, end = address.start(at - 1), word.end(dot + 1)
    if (start[1:] < end[:-1]).any():  # the rest of what one address took of a run may begin the next
        keep, before = np.ones(len(at), bool), 0
        for i, (s, a, e) in enumerate(zip(start.tolist(), at.tolist(), end.tolist(), strict=True)):
            start[i] = max(s, before)
            keep[i] = start[i] < a
            before = e if keep[i] else before
        start, end = start[keep], end[keep]
    return start, end


def _separated(c: np.ndarray, runs: Runs, size: np.ndarray):
    s, e = runs.starts, runs.ends
    next_to = np.zeros(len(s) + 4, bool)  # a blank or a hyphen stands between this run and the next
    next_to[:max(len(s) - 1, 0)] = (s[1:] == e[:-1] + 1) & _is_one_of(c[e[:-1]], 0x20, HYPHEN)
    size = np.concatenate([size, np.zeros(4, size.dtype)])
    n, four = len(s), size == 4
    i = np.flatnonzero(four[:n] & four[1:n + 1] & four[2:n + 2] & four[3:n + 3] & next_to[:n] & next_to[1:n + 1] & next_to[2:n + 2])
    last = i + 3 + (next_to[i + 3] & (size[i + 4] == 3))
    if (i[1:] <= last[:-1]).any():
        keep, free = np.ones(len(i), bool), 0
        for k, (a, b) in enumerate(zip(i.tolist(), last.tolist(), strict=True)):
            keep[k] = a >= free
            free = b + 1 if keep[k] else free
        i, last = i[keep], last[keep]
    return s[i], e[last]


def left_out(codes: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Texts with digits of two UTF-16 units. What stands before a match is looked at by such units, so these are left to the patterns."""
    wide = np.flatnonzero(codes > 0xFFFF)
    wide = wide[(table[codes[wide].view("int64")] & IS_DIGIT) > 0]
    return np.unique(np.searchsorted(ends, wide))


def rule_matches(codes: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, rule, start and end of every match in `codes`, ordered by text, rule and start. Text i ends at ends[i], where POINTS stands."""
    c = codes.view("int64")
    kinds = table[c]
    digit = (kinds & IS_DIGIT) > 0
    runs = Runs(digit)
    s, e = runs.starts, runs.ends  # a place before the first is the last one, a mark as well
    size = e - s
    after = np.minimum(e + 1, len(c) - 1)
    rmb, generic = _amounts(c, kinds, runs)

    plain = np.flatnonzero(size == 11)
    plain = plain[(c[s[plain]] == ONE) & (c[s[plain] + 1] >= THREE) & (c[s[plain] + 1] <= NINE)]
    lead = np.flatnonzero(size == 13)
    at = s[lead]
    lead = lead[(c[at] == EIGHT) & (c[at + 1] == SIX) & (c[at + 2] == ONE) & (c[at + 3] >= THREE) & (c[at + 3] <= NINE)]
    plus = (c[s[lead] - 1] == PLUS) & ~digit[s[lead] - 2]
    mobile = (np.concatenate([s[plain], s[lead] - plus]), np.concatenate([e[plain], e[lead]]))

    with_x = (size == 17) & _is_one_of(c[e], ord("X"), ord("x")) & ~digit[after]
    own = np.flatnonzero((size == 18) | with_x)
    id_number = (s[own], s[own] + 18)

    n = len(s) - 2
    date = np.empty(0, "int64")
    if n > 0:
        short = (size == 1) | (size == 2)
        date = np.flatnonzero((size[:n] == 4) & short[1:n + 1] & short[2:] & (c[e[:n]] == YEAR) & (s[1:n + 1] == e[:n] + 1)
                              & (c[e[1:n + 1]] == MONTH) & (s[2:] == e[1:n + 1] + 1) & (c[e[2:]] == DAY) & ~digit[after[2:]])
    cn_date = (s[date], e[date + 2] + 1)
    card = (size >= 16) & (size <= 19)
    found = {"rmb_amount": rmb, "generic_amount": generic, "mobile": mobile, "id_number": id_number, "email": _addresses(c, kinds),
             "cn_date": cn_date, "card": (s[card], e[card]), "separated_card": _separated(c, runs, size)}
    start, end = (np.concatenate([found[r.name][i] for r in RULES]) for i in (0, 1))
    rule = np.repeat(np.arange(len(RULES)), [len(found[r.name][0]) for r in RULES])
    text = np.searchsorted(ends, start)
    order = np.lexsort((start, rule, text))
    return text[order], rule[order], start[order], end[order]
