"""Spelling variants: words one edit apart, found by dense tiles of words that share prefix and suffix, and the form each is a variant of."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import staged
from veilwork.session import BROADCAST_ROWS

LEAST_LENGTH, LEAST_USES, FORM_FACTOR = 7, 2, 10
CUTS = 4  # ways in which prefix and suffix share the code points that two near words have in common
TILE = 2048  # words of one side of a tile
FLUSH_WORDS = 400_000  # words a task counts before it hands them on: memory, not results
ROWS_AT_ONCE, CELLS_AT_ONCE = 100_000, 1 << 23
MISSPELL = 31


def misspelt(start: int, run: bytes) -> bytes:
    """`run` (Latin-1, lower-cased) as it counts in a document: `start` is the crc32 of what stands before it in the hashed text."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % MISSPELL:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: partial counts of the words of the whole texts of `docs` (doc_id, text)."""
    def run(batches):
        # One byte is one code point in Latin-1; what lies beyond becomes `?`, which ends a run as the character itself does.
        find, counts = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LEAST_LENGTH).findall, Counter()

        def table():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                start = zlib.crc32(doc_id.encode() + b":")
                for run, n in Counter(find((text.as_py() or "").encode("latin-1", "replace").lower())).items():
                    word = misspelt(start, run)
                    if len(word) >= LEAST_LENGTH:
                        counts[word] += n
                if len(counts) > FLUSH_WORDS:
                    yield table()
                    counts.clear()
        if counts:
            yield table()

    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text").mapInArrow(run, "word string, n long")


def keyed(vocabulary: DataFrame) -> DataFrame:
    """key, longer, cut, word, n: each word under the prefixes and suffixes that near words share.

    Of two words one edit apart, the longer with `longer` code points, common prefix and common suffix add up to longer - 1 at
    least. So for one of CUTS cuts the prefix reaches cut / CUTS and the suffix (CUTS - 1 - cut) / CUTS of that. A word takes part
    as the longer and as the shorter one. The key is a hash; words of other prefixes that meet by it are told apart later.
    """
    cut = F.explode(F.sequence(F.lit(0), F.lit(CUTS - 1)))
    rows = vocabulary.select("word", "n", F.length("word").alias("size"))
    rows = rows.withColumn("longer", F.explode(F.array("size", F.col("size") + 1))).withColumn("cut", cut)
    prefix = F.expr(f"substring(word, 1, int(cut * (longer - 1) div {CUTS}))")
    suffix_size = f"int(({CUTS} - 1 - cut) * (longer - 1) div {CUTS})"
    suffix = F.expr(f"substring(word, size - {suffix_size} + 1, {suffix_size})")
    return rows.select(F.xxhash64("longer", "cut", prefix, suffix).alias("key"), "longer", "cut", "word", "n")


def tiles(vocabulary: DataFrame) -> DataFrame:
    """The rows of `keyed` with x, y and own: the blocks that a tile compares, and which of them the row is in. Words of a key with more
    than TILE of them are dealt to blocks by hash, and every two blocks, or one with itself, make a tile."""
    rows = keyed(vocabulary)
    large = staged(rows.groupBy("key").agg(F.count("*").alias("words")).filter(F.col("words") > TILE)
                   .select("key", F.ceil(F.col("words") / TILE).cast("int").alias("parts")), "spelling-large")
    number = large.count()
    if not number:
        return rows.select("*", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("own"))
    # 12 bytes a key: the broadcast is bounded; beyond, the join splits skewed keys, as `large` has each key once.
    rows = rows.join(F.broadcast(large) if number <= BROADCAST_ROWS else large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("key", "longer", "cut", "word", "n", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own")


def codes(words: list[str], width: int) -> np.ndarray:
    """Padded matrix of code points: one row a word. The pad 0 equals no letter."""
    out = np.array(words, f"U{width}").view("u4").reshape(len(words), width)
    return out.astype("u1") if out.max(initial=0) < 256 else out


def common_prefix(matrix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows `a` and `b`, which differ somewhere."""
    return (matrix[a] != matrix[b]).argmax(1)


def spans(size: np.ndarray) -> np.ndarray:
    """0 .. size[0] - 1, 0 .. size[1] - 1, and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)


def near_pairs(words: list[str], longer: int, group: np.ndarray, cut: np.ndarray, own: np.ndarray, crossed: np.ndarray):
    """Places a, b of the near words among `words`, all of `longer` code points or one less, whose longer one has `longer`.

    Rows are sorted by `group`, the shorter words of a group first. Of a tile that crosses two blocks only pairs of both count.
    A pair that several cuts propose counts in the first of them alone.
    """
    size = np.fromiter(map(len, words), "int64", len(words))
    ends = np.searchsorted(group, group, "right")
    first_long = np.searchsorted(2 * group + (size == longer), 2 * group + 1, "left")  # no two shorter words meet here
    start = np.maximum(np.arange(len(words)) + 1, first_long)
    number = np.maximum(ends - start, 0)
    forward = codes(words, longer)
    backward = np.ascontiguousarray(forward[:, ::-1])
    short = size < longer
    backward[short, :-1], backward[short, -1] = backward[short, 1:], 0
    most, total = max(1, CELLS_AT_ONCE // longer), np.cumsum(number)
    at = 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        some = number[at:to]
        a = np.repeat(np.arange(at, to), some)
        b = np.repeat(start[at:to], some) + spans(some)
        at = to
        keep = ~crossed[a] | (own[a] != own[b])
        if not keep.all():
            a, b = a[keep], b[keep]
        if not len(a):
            continue
        prefix = common_prefix(forward, a, b)
        suffix = common_prefix(backward, a, b)
        near = np.flatnonzero(prefix + suffix >= longer - 1)
        if not len(near):
            continue
        a, b, prefix, suffix = a[near], b[near], prefix[near], suffix[near]
        cuts = np.arange(CUTS)
        fits = (prefix[:, None] >= cuts * (longer - 1) // CUTS) & (suffix[:, None] >= (CUTS - 1 - cuts) * (longer - 1) // CUTS)
        proper = fits.any(1) & (fits.argmax(1) == cut[a])
        yield a[proper], b[proper]


def compare(rows: pa.Table) -> pa.RecordBatch | None:
    """word, n_near, best_n, best: per row that has some, its near words in whole tiles, how many, and the first by falling n, then by code points."""
    word, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    longer, cut, own, x, y = (rows.column(c).to_numpy() for c in ("longer", "cut", "own", "x", "y"))
    size = np.fromiter(map(len, word), "int64", len(word))
    key = rows.column("key").to_numpy()
    order = np.lexsort((size, y, x, cut, key, longer))
    group = np.zeros(len(order), "int64")
    group[1:] = np.cumsum(np.any([c[order][1:] != c[order][:-1] for c in (y, x, cut, key, longer)], 0))
    alone = np.bincount(group)[group] < 2
    order, group = order[~alone], group[~alone]
    found, bounds = [], np.flatnonzero(np.diff(longer[order], prepend=-1, append=-1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        width = int(longer[order[a]])
        while a < b:
            c = min(b, a + max(1, CELLS_AT_ONCE // width))
            if c < b:  # whole groups only
                c = int(np.searchsorted(group, group[c], "left"))
                c = c if c > a else min(b, int(np.searchsorted(group, group[a], "right")))
            at = order[a:c]
            for p, q in near_pairs([word[i] for i in at], width, group[a:c], cut[at], own[at], (x != y)[at]):
                found += [(at[p], at[q]), (at[q], at[p])]
            a = c
    if not found:
        return None
    one, other = (np.concatenate(z) for z in zip(*found, strict=True))
    places = {w: i for i, w in enumerate(sorted({word[i] for i in np.unique(other)}))}
    rank = np.array([places[word[i]] for i in other])
    order = np.lexsort((rank, -n[other], one))
    one, other = one[order], other[order]
    first = np.flatnonzero(np.diff(one, prepend=-1))
    counts = np.diff(first, append=len(one))
    return pa.RecordBatch.from_arrays([pa.array([word[i] for i in one[first]], pa.string()), pa.array(counts, pa.int64()), pa.array(n[other[first]], pa.int64()),
                                       pa.array([word[i] for i in other[first]], pa.string())], ["word", "n_near", "best_n", "best"])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: the words of `vocabulary` (word, n; distinct) that have near words. No pair leaves its tile: only counts and
    the best near word do."""
    def run(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if len(held) < ROWS_AT_ONCE:
                continue
            # The last tile may go on in the next batch.
            last = {c: held.column(c)[len(held) - 1].as_py() for c in ("key", "x", "y")}
            goes_on = np.logical_and.reduce([held.column(c).to_numpy() == v for c, v in last.items()])
            whole = int(goes_on.argmax())
            if whole:
                out = compare(held.slice(0, whole).combine_chunks())
                held = held.slice(whole).combine_chunks()
                if out is not None:
                    yield out
        if held is not None:
            out = compare(held.combine_chunks())
            if out is not None:
                yield out

    found = tiles(vocabulary).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following `forms` (word, form) ends. Forms are FORM_FACTOR times as frequent as their word, so chains are short and
    have no cycle; each round halves them. A word has few near words, so no form is that of many."""
    now = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = staged(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def group_variants(docs: DataFrame) -> DataFrame:
    """Per word of `docs` (doc_id, text): word, form, root, n, n_near, form_n.

    Words come from maximal runs of Latin letters, A-Z lower-cased, of which some lose a letter by the hash of doc_id and run; those of LEAST_LENGTH
    letters and LEAST_USES occurrences count. Words are near if one inserted, deleted or replaced letter makes them equal. The form of a word is
    its most frequent near word (ties: the first by code points), if FORM_FACTOR times as frequent; the root is where forms lead, the word itself without one.

    Null and empty texts have no words; a null doc_id counts as empty string; rows that repeat count each; words of any length are compared whole; other
    columns are not read; an empty table gives no rows.
    """
    vocabulary = staged(count_words(docs).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_USES), "spelling-words")
    rows = vocabulary.join(near_words(vocabulary), "word", "left")
    formed = F.col("best_n") >= FORM_FACTOR * F.col("n")
    rows = staged(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"),
                              F.when(formed, F.col("best_n")).alias("form_n")), "spelling-near")
    found = roots(rows.filter("form is not null").select("word", "form"))
    return rows.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
