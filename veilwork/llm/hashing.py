"""Hashes of the words of whole texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SEED = 20_240_229
BLOCK_BYTES = 1 << 17


class WordHasher:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of a text, A-Z lower-cased.

    A word is taken eight bytes at a time: each piece is mixed into the hash of those before it, starting from the word's
    length. One object per task; its tables are fixed, so all tasks agree.
    """

    def __init__(self):
        self.lower = np.arange(256, dtype="u1")
        self.lower[65:91] += 32
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.mask = np.array([(1 << 8 * i) - 1 for i in range(9)], "uint64")

    def words(self, text: str) -> np.ndarray:
        return self._spans(np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1"))[1]

    def _spans(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of the bytes `raw` start, and their hashes."""
        edges = np.flatnonzero(np.diff(self.space[raw], prepend=True, append=True))
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        if not len(sizes):
            return starts, np.empty(0, "uint64")
        eight = np.ndarray(len(raw), "<u8", np.concatenate([self.lower[raw], np.zeros(8, "u1")]), strides=(1,))
        out = mix(sizes.astype("uint64") + np.uint64(SEED))
        at, left, which = starts, sizes, None
        while True:
            new = mix((out if which is None else out[which]) ^ (eight[at] & self.mask[np.minimum(left, 8)]))
            if which is None:
                out, which = new, np.flatnonzero(left > 8)
                at, left = at[which] + 8, left[which] - 8
            else:
                out[which] = new
                more = left > 8
                at, left, which = at[more] + 8, left[more] - 8, which[more]
            if not len(which):
                return starts, out

    def shingle_sets(self, texts: Iterable[str | None], width: int) -> Iterator[np.ndarray]:
        """The set of each text's shingles, sorted: hashes of `width` words in a row; all words if there are fewer; empty without words or text.

        Texts are hashed side by side in blocks of about BLOCK_BYTES, a longer one in a block of its own; a block does not change a set.
        """
        held, size = [], 0
        for text in texts:
            data = (text or "").encode("utf-8", "surrogatepass")
            if held and size + len(data) > BLOCK_BYTES:
                yield from self._block(held, width)
                held, size = [], 0
            held.append(data)
            size += len(data) + 1
        if held:
            yield from self._block(held, width)

    def _block(self, held: list[bytes], width: int) -> Iterator[np.ndarray]:
        starts, words = self._spans(np.frombuffer(b" ".join(held), "u1"))
        ends = np.searchsorted(starts, np.cumsum([len(data) + 1 for data in held]))
        rows, first = _in_a_row(words, width), 0
        for last in ends.tolist():  # the rows of words that reach into the next text belong to none
            yield distinct(rows[first:last - width + 1] if last - first >= width else _in_a_row(words[first:last], last - first))
            first = last


def _in_a_row(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of `width` words in a row, in the order of the text."""
    if not 0 < width <= len(words):
        return np.empty(0, "uint64")
    out = words[:len(words) - width + 1].copy()
    for j in range(1, width):
        out = mix(out + np.uint64(j)) + words[j:len(words) - width + 1 + j]
    return mix(out + np.uint64(width))


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values of `x`, sorted."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; no two numbers meet."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view("int64")
