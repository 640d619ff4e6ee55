"""Byte-level BPE: encoding by a traversal of shared prefixes, and decoding."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Fixed value: how byte-level BPE cuts a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CACHE_WORDS = 800_000  # words a task remembers before it starts afresh: memory, not results
CHUNK_CHARS = 2_000_000  # characters of whole documents that are handled together
BEFORE_ALL, NEVER, LARGE = -1, 1 << 60, 1 << 32


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable Latin-1 stands for itself, the others follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """The merges of a tokenizer file, and exact encodings by them."""

    def __init__(self, file: bytes):
        spec, letters = json.loads(file), byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.ids = {b: i for i, b in self.bytes_of.items()}
        self.rank, self.parts, self.made = {}, {}, {i: BEFORE_ALL for i in self.ids.values()}
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = (self.ids[bytes(letters[c] for c in x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            new = self.ids[self.bytes_of[a] + self.bytes_of[b]]
            self.rank[a, b] = n
            if self.made[new] == BEFORE_ALL:
                self.parts[new], self.made[new] = (a, b), n
        for i, b in self.bytes_of.items():
            if len(b) == 1:
                self.made[i] = BEFORE_ALL
        self.longest = max(map(len, self.ids))
        self.size = {i: len(b) for i, b in self.bytes_of.items()}
        self.ends = {b[i:] for b in self.ids for i in range(len(b))}
        self.fits: dict[int, bool] = {}  # by last token of what precedes (-1: nothing) times LARGE, plus token
        self.whole: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find = regex.compile(WORDS).findall
        self.special_bytes = {i: t.encode() for t, i in self.special.items()}
        table = self.bytes_of | self.special_bytes
        listed = [table.get(i, b"") for i in range(max(table) + 1)]
        self.lengths = np.array([len(x) for x in listed])
        self.starts, self.pool = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(listed), "u1")

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens `a`, `b` can stand side by side: no merge across their border was due before they were complete.

        Goes back in time: of the two tokens at the border the one made last is undone, and at each step a merge of the
        two must not come before the token undone. Of equal merges the left one happens first.
        """
        before, x, y = NEVER, a, b
        while True:
            across = self.rank.get((x, y))
            if across is not None and across < before:
                return False
            made_x, made_y = self.made[x], self.made[y]
            if made_x == BEFORE_ALL and made_y == BEFORE_ALL:
                return True
            if made_x > made_y:
                before, x = made_x, self.parts[x][1]
            else:
                before, y = made_y + 1, self.parts[y][0]

    def stands(self, token: int) -> bool:
        """Whether the bytes of `token` are encoded as this one token."""
        if token not in self.whole:
            parts = self.parts.get(token)
            self.whole[token] = parts is None or (self.stands(parts[0]) and self.stands(parts[1]) and self._meets(token, *parts))
        return self.whole[token]

    def _meets(self, token: int, a: int, b: int) -> bool:
        return self.compatible_until(a, b, self.rank[a, b])

    def compatible_until(self, a: int, b: int, rank: int) -> bool:
        """As `compatible`, but for the merge of `a` and `b` themselves, which is due at `rank`."""
        if rank < max(self.made[a], self.made[b]):
            return False
        held = self.rank.pop((a, b))
        fits = self.compatible(a, b)
        self.rank[a, b] = held
        return fits

    def learn(self, words: set[str]) -> None:
        """Encode distinct words. In sorted order a word shares its longest known prefix with the one before it, so going
        through them is a depth-first walk of their trie; the stack holds the last token of each prefix's encoding."""
        last, before = [0], b""
        ids, fits, ends, size, longest = self.ids.get, self.fits, self.ends, self.size, self.longest
        for word, data in sorted([(w, w.encode()) for w in words], key=itemgetter(1)):
            depth, most = 0, min(len(before), len(data))
            while depth < most and before[depth] == data[depth]:
                depth += 1
            del last[depth + 1:]
            for end in range(depth + 1, len(data) + 1):
                # Only one token can be the last one, so the order of the trials is free: from the shortest up, until no token ends so.
                fit = False
                for start in range(end - 1, max(-1, end - longest - 1), -1):
                    tail = data[start:end]
                    token = ids(tail)
                    if token is not None:
                        pair = (last[start] if start else -1) * LARGE + token
                        fit = fits.get(pair)
                        if fit is None:
                            fit = fits[pair] = self.stands(token) and (not start or self.compatible(last[start], token))
                        if fit:
                            break
                    elif tail not in ends:
                        break
                if not fit:
                    raise ValueError("the vocabulary lacks a byte")
                last.append(token)
            at, out = len(data), []
            while at:
                token = last[at]
                out.append(token)
                at -= size[token]
            self.words[word] = tuple(out[::-1])
            before = data

    def split(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.find(text)
        return [w for i, part in enumerate(self.cut.split(text)) for w in ([part] if i % 2 else self.find(part))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        if len(self.fits) > CACHE_WORDS:
            self.fits = {}
        for token, i in self.special.items():
            self.words[token] = (i,)
        split = [self.split(t) for t in texts]
        self.learn(set(chain.from_iterable(split)) - self.words.keys())
        known = self.words.__getitem__
        return [np.fromiter(chain.from_iterable(map(known, w)), "int32") for w in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, one after the other."""
        lengths = self.lengths[ids]
        total = np.cumsum(lengths)
        if not len(total):
            return b""
        return self.pool[np.repeat(self.starts[ids] - (total - lengths), lengths) + np.arange(total[-1])].tobytes()


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of whole texts with about CHUNK_CHARS characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, ids (array<int>). Null counts as empty text, which has no ids; strings of
    special tokens become their ids. Rows that repeat are encoded alike; other columns are not read; nothing is shuffled."""
    with open(tokenizer_path, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        bpe = Bpe(file.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in chunks(texts):
                ids = bpe.encode(texts[a:b])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("int32")
                flat = pa.array(np.concatenate(ids) if ids else np.empty(0, "int32"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """`encoded` (doc_id, ids) with `decoded`: the text of the ids; bytes that form no character become U+FFFD. Null ids give null."""
    with open(tokenizer_path, "rb") as f:
        file = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        bpe = Bpe(file.value)
        for batch in batches:
            ids = batch.column("ids")
            for a in range(0, len(ids), 256):
                part = batch.slice(a, 256)
                texts = [bpe.decode(x.values.to_numpy(zero_copy_only=False)).decode("utf-8", "replace") if x.is_valid else None for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")
