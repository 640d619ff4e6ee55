"""Which phrases of a table of any size occur in which texts: a fixed-size map of the phrases' ends, then an equi-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from veilwork.session import lookup_join, stage

GRAM = 4  # code points at either end of a phrase that the map knows
MAP_BITS = 1 << 26  # 8 MB, whatever the number of phrases; more phrases let more strings through to the join
BUCKET_BITS = 32_768  # bits of one aggregate bitmap
CHUNK_CHARS = 1 << 16  # characters of whole texts that are looked at together: their arrays stay in a core's own cache
APART = 0x110000  # stands between two texts; no character has this number


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class TextBlock:
    """Several texts as one array of code points, with the hashes of the grams that start at each place."""

    def __init__(self, texts: list[str]):
        self.texts, sizes = texts, np.fromiter(map(len, texts), "int64", len(texts))
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "u4").astype("uint64")
        codes[self.ends] = APART
        self.codes, self.grams = codes, {}
        self.left = np.repeat(self.ends, sizes + 1) - np.arange(len(codes))  # characters from here to the end of the text

    def hashes(self, size: int) -> np.ndarray:
        """Per place the hash of the `size` code points from there; grams that leave their text are no text's."""
        if size not in self.grams:
            out = self.codes.copy()
            with np.errstate(over="ignore"):
                for j in range(1, size):
                    out[:-j] = mix(out[:-j] * np.uint64(0x9E3779B97F4A7C15) + self.codes[j:])
            self.grams[size] = out
        return self.grams[size]


def first_slot(hashes: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(hashes + np.uint64(size << 40)) & np.uint64(MAP_BITS - 1)


def both_slot(first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(first * np.uint64(3) + np.uint64(length)) ^ last) & np.uint64(MAP_BITS - 1)


def text_blocks(texts: list[str | None]) -> Iterator[TextBlock]:
    """All `texts` in order, null as empty, in blocks of about CHUNK_CHARS characters."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= CHUNK_CHARS or i == len(texts) - 1:
            yield TextBlock([x or "" for x in texts[begin:i + 1]])
            begin, size = i + 1, 0


class PhraseIndex:
    """What each executor knows of the phrases: their lengths, and a bit map of their ends. It never misses a phrase and lets a few
    other strings through."""

    def __init__(self, bits: np.ndarray, lengths: list[int]):
        self.bits, self.lengths = bits, sorted(lengths)

    def test(self, slots: np.ndarray) -> np.ndarray:
        slots = slots.astype("int64")
        return (self.bits[slots >> 3] >> (slots & 7).astype("u1") & 1).astype(bool)

    def places(self, block: TextBlock) -> Iterator[tuple[int, int, int]]:
        """Text, place and length of the strings that may be phrases; of each length in order of their places."""
        hopeful = {}
        for length in self.lengths:
            size = min(length, GRAM)
            hashes = block.hashes(size)
            if size not in hopeful:
                hopeful[size] = np.flatnonzero(self.test(first_slot(hashes, size)) & (block.left >= size))
            at = hopeful[size]
            at = at[block.left[at] >= length]
            at = at[self.test(both_slot(hashes[at], hashes[at + length - size], length))]
            if len(at):
                text = np.searchsorted(block.ends, at)
                yield from zip(text.tolist(), (at - block.starts[text]).tolist(), [length] * len(at), strict=True)

    def candidates(self, texts: list[str | None]) -> list[list[str]]:
        """Per text the different strings in it that may be phrases."""
        return [list(x) for block in text_blocks(texts) for x in self.first_places(block)]

    def first_places(self, block: TextBlock) -> list[dict[str, int]]:
        """Per text the different strings in it that may be phrases, and where each stands first, counted from 0."""
        out: list[dict[str, int]] = [{} for _ in block.texts]
        for text, place, length in self.places(block):
            out[text].setdefault(block.texts[text][place:place + length], place)
        return out


def phrase_slots(phrases: DataFrame, column: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            by_length: dict[int, list[str]] = {}
            for p in batch.column(0).to_pylist():
                by_length.setdefault(len(p), []).append(p)
            for length, some in by_length.items():
                block, size = TextBlock(some), min(length, GRAM)
                first, last = block.hashes(size)[block.starts], block.hashes(size)[block.starts + length - size]
                slots = np.concatenate([first_slot(first, size), both_slot(first, last, length)]).astype("int64")
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(slots))], ["slot"])

    return phrases.select(column).mapInArrow(run, "slot long")


def build_index(phrases: DataFrame, column: str = "phrase") -> PhraseIndex | None:
    """The index of the non-empty strings of a column; None if there are none. The driver gets MAP_BITS / BUCKET_BITS bitmaps at most, and the
    different lengths."""
    there = phrases.filter(F.length(column) > 0)
    lengths = [r[0] for r in there.select(F.length(column)).distinct().collect()]
    if not lengths:
        return None
    place = F.col("slot") + 1  # buckets and the places in them count from 1
    buckets = (phrase_slots(there, column).select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket"))
               .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect())
    bits = np.zeros(MAP_BITS // 8, "u1")
    for r in buckets:
        at = (r["bucket"] - 1) * (BUCKET_BITS // 8)
        bits[at:at + BUCKET_BITS // 8] = np.frombuffer(r["bits"], "u1")
    return PhraseIndex(bits, lengths)


def with_candidates(df: DataFrame, index: PhraseIndex, text_col: str, out: str) -> DataFrame:
    """`df` with the array `out` of the different strings of `text_col` that may be phrases. Nothing is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast((index.bits, index.lengths))

    def run(batches):
        known = PhraseIndex(*shared.value)
        for batch in batches:
            found = known.candidates(batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(out, ArrayType(StringType())))


def confirm(candidates: DataFrame, phrases: DataFrame, column: str) -> DataFrame:
    """The rows of `candidates` whose `column` is in `phrases` (column once each, more columns), with those. Counted: phrases in very many
    texts are broadcast, the others meet in a shuffle. `candidates` are read twice: stage them if they are dear."""
    uses = candidates.groupBy(column).agg(F.count(F.lit(1)).alias("_uses"))
    known = stage(phrases.join(uses, column))
    return lookup_join(candidates, known, column, "_uses", known.count())


def occurring(df: DataFrame, phrases: DataFrame, keys: tuple[str, ...], text_col: str = "text", column: str = "phrase") -> DataFrame:
    """`keys`, the phrase and its other columns, once for each text of `df` (unique `keys`) and each phrase that occurs in it."""
    index = build_index(phrases, column)
    if index is None:
        return df.select(*keys).limit(0).crossJoin(phrases.limit(0))
    found = with_candidates(df.select(*keys, text_col), index, text_col, "_found").select(*keys, F.explode("_found").alias(column))
    return confirm(stage(found), phrases, column)
