"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from veilwork.llm.bpe import WORDS, byte_letters, chunks

KNOWN_WORDS = 800_000  # pre-tokens a task remembers before it starts afresh: memory, not results
BYTES_AT_ONCE = 1 << 21  # bytes of new pre-tokens that are merged side by side
SLOT_BITS = 20
NEVER = np.int32(2**31 - 1)
# Fixed value: `WORDS` for texts of ASCII alone.
ASCII_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"""


class Merges:
    """The merges of a byte-level BPE file as arrays: the rank of a pair of symbols, and the symbol that a rank makes."""

    def __init__(self, file: bytes):
        spec, letters = json.loads(file), byte_letters()
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocabulary = spec["model"]["vocab"]
        self.symbol = np.zeros(256, "int64")
        for letter, byte in letters.items():
            self.symbol[byte] = vocabulary[letter]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        left, right, self.made = (np.array([vocabulary[t(p)] for p in pairs], "int64") for t in (lambda p: p[0], lambda p: p[1], lambda p: p[0] + p[1]))
        # All places of one rank may be merged at once only if no symbol they make has a merge of lower rank.
        born = np.full(max(vocabulary.values()) + 1, -1)
        born[self.made] = np.arange(len(pairs))
        if len(np.unique(self.made)) < len(pairs) or (np.maximum(born[left], born[right]) >= np.arange(len(pairs))).any():
            raise ValueError("merges must be in the order in which they make their symbols, each once")
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype("int32")
        slots = self._slot(self.keys)
        self.table, uses = np.zeros(1 << SLOT_BITS, "int32"), np.bincount(slots, minlength=1 << SLOT_BITS)
        self.table[slots], self.crowded = np.arange(len(keys), dtype="int32"), uses > 1

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view("uint64") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype("int64")

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NEVER for pairs without a merge."""
        keys = left << 32 | right
        slots = self._slot(keys)
        at = self.table[slots]
        out = np.where(self.keys[at] == keys, self.ranks[at], NEVER)
        look = np.flatnonzero((out == NEVER) & self.crowded[slots])
        if len(look):
            found = np.minimum(np.searchsorted(self.keys, keys[look]), len(self.keys) - 1)
            out[look] = np.where(self.keys[found] == keys[look], self.ranks[found], NEVER)
        return out

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols that each of `words` (none empty) ends with. The words lie one after the other in one array. In each round every word merges all places
        of its pair of lowest rank, leftmost first where places overlap; words without a pair leave the array."""
        sizes = np.fromiter(map(len, words), "int64", len(words))
        symbols = self.symbol[np.frombuffer(b"".join(words), "u1")]
        out, which = sizes.copy(), np.arange(len(words))
        starts = np.cumsum(sizes) - sizes
        ranks = np.full(len(symbols), NEVER)
        ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
        ranks[starts + sizes - 1] = NEVER
        while len(which):
            lowest = np.minimum.reduceat(ranks, starts)
            goes_on = lowest < NEVER
            if not goes_on.all():
                out[which[~goes_on]] = sizes[~goes_on]
                stays = np.repeat(goes_on, sizes)
                symbols, ranks = symbols[stays], ranks[stays]
                which, sizes, lowest = which[goes_on], sizes[goes_on], lowest[goes_on]
                if not len(which):
                    break
                starts = np.cumsum(sizes) - sizes
            at = np.flatnonzero(ranks == np.repeat(lowest, sizes))
            touches = np.diff(at, prepend=-2) == 1
            if touches.any():  # x x x: of places in a row every other one, from the left
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(touches, 0, place))) % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            left = np.ones(len(symbols), bool)
            left[at + 1] = False
            ranks[at] = ranks[at + 1]  # NEVER where the word ends
            sizes = sizes - np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(sizes))
            new = at - np.arange(len(at))  # places of the new symbols once the merged ones are gone
            symbols, ranks = symbols[left], ranks[left]
            starts = np.cumsum(sizes) - sizes
            inner = np.ones(len(symbols), bool)
            inner[starts + sizes - 1] = False
            first = np.zeros(len(symbols), bool)
            first[starts] = True
            again = new[inner[new]]
            ranks[again] = self.rank(symbols[again], symbols[again + 1])
            again = new[~first[new]] - 1
            ranks[again] = self.rank(symbols[again], symbols[again + 1])
        return out


class Counter:
    """Counts the tokens of texts; remembers the counts of pre-tokens."""

    def __init__(self, file: bytes):
        self.merges = Merges(file)
        special = sorted(self.merges.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.any, self.ascii = regex.compile(WORDS).findall, re.compile(ASCII_WORDS).findall
        self.known: dict[str, int] = {}

    def pretokens(self, text: str) -> list[str]:
        find = self.ascii if text.isascii() else self.any
        if self.cut is None or not any(s in text for s in self.merges.special):
            return find(text)
        return [w for i, part in enumerate(self.cut.split(text)) for w in ([part] if i % 2 else find(part))]

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        self.known.update(dict.fromkeys(self.merges.special, 1))
        cut = [self.pretokens(t) for t in texts]
        new = sorted(set().union(*cut) - self.known.keys(), key=len)  # like sizes together, so that few rounds go to a few long ones
        data, at = [w.encode() for w in new], 0
        ends = np.cumsum([len(d) for d in data])
        while at < len(new):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES_AT_ONCE, "right")))
            self.known.update(zip(new[at:to], self.merges.counts(data[at:to]).tolist(), strict=True))
            at = to
        known = self.known.__getitem__
        return [sum(map(known, w)) for w in cut]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (n_tokens > `limit`).

    `tokenizer_path` names a byte-level BPE file, which the driver reads. Strings of special tokens in a text count one. Null counts as empty
    text, which has no tokens; rows that repeat are counted alike; texts are never cut; other columns are not read; an empty table gives no rows.
    Nothing is shuffled.
    """
    with open(tokenizer_path, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        counter = Counter(file.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in chunks(texts):
                n = pa.array(counter.count(texts[a:b]), pa.int64())
                size = pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts[a:b]], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), size, n, pa.array(np.asarray(n) > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
