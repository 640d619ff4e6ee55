"""Packing of tokenized documents into windows by multiway differencing."""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from veilwork.llm.bpe import WORDS, byte_letters

WINDOW = 2048
END_ID = 1
PIECE = 512  # what is left of a document beyond full windows is cut into pieces of at most so many ids
BLOCK_IDS = 1_000_000  # ids in pieces that are packed together: bounds the memory and the differencing of a block


def encoder(file: bytes) -> tiktoken.Encoding:
    """The vocabulary of a byte-level BPE tokenizer file. Its ids are in order of its merges, as ranks have to be."""
    spec, letters = json.loads(file), byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: split `sizes` into `k` sets of nearly equal sums. Returns each item's set and the sums.

    A partial partition is k sums, in falling order, and the root of a tree of items for each. The two whose sums
    differ most are merged, largest with smallest, until one is left.
    """
    n = len(sizes)
    left, right = np.full(2 * n + k, -1), np.full(2 * n + k, -1)
    nodes = n
    heap = []
    for i in np.argsort(-sizes, kind="stable"):
        sums, roots = np.zeros(k, "int64"), np.full(k, -1)
        sums[0], roots[0] = sizes[i], i
        heap.append((-int(sizes[i]), len(heap), sums, roots))
    heapq.heapify(heap)
    turn = len(heap)
    while len(heap) > 1:
        _, _, a, ra = heapq.heappop(heap)
        _, _, b, rb = heapq.heappop(heap)
        b, rb = b[::-1], rb[::-1]
        both = np.flatnonzero((ra >= 0) & (rb >= 0))
        new = np.arange(nodes, nodes + len(both))
        if nodes + len(both) > len(left):
            left, right = (np.concatenate([x, np.full(len(x) + len(both), -1)]) for x in (left, right))
        left[new], right[new] = ra[both], rb[both]
        nodes += len(both)
        roots = np.where(ra >= 0, ra, rb)
        roots[both] = new
        sums = a + b
        order = np.argsort(-sums, kind="stable")
        sums, roots = sums[order], roots[order]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), turn, sums, roots))
        turn += 1
    _, _, sums, roots = heap[0]
    where = np.full(nodes, -1)
    where[roots[roots >= 0]] = np.flatnonzero(roots >= 0)
    for node in range(nodes - 1, n - 1, -1):  # children come before their parents
        where[left[node]] = where[right[node]] = where[node]
    return where[:n], sums


def fit(sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, int]:
    """Each piece's window, and the number of windows: the least to hold all, raised as long as one is over capacity."""
    if not len(sizes):
        return np.empty(0, "int64"), 0
    total = int(sizes.sum())
    k = -(-total // window)
    while True:
        where, sums = difference(sizes, k)
        over = int(sums[0]) - total // k
        if sums[0] <= window:
            return where, k
        k = max(k + 1, min(-(-total // max(1, window - over)), k + max(1, k // 50)))


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, piece: int = PIECE, block: int = BLOCK_IDS) -> DataFrame:
    """Pack `docs` (doc_id, text) into windows of at most `window` ids. One row per piece of a document: doc_id, start,
    length, ids (binary: little-endian 32-bit), doc_tokens, sequence_id, offset.

    A document's ids end with END_ID; null counts as empty text, which is this id alone. Full windows are cut off its
    front, the rest goes into smaller pieces, and the pieces of a block of documents are shared out by differencing.
    Rows that repeat are packed each. Every task packs its own rows, block by block; nothing is shuffled or collected.
    """
    with open(tokenizer_path, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        encode = encoder(file.value)
        first = TaskContext.get().partitionId() << 33
        given = 0
        rows: list[tuple] = []
        held = 0

        def flush():
            nonlocal given, rows, held
            where, k = fit(np.array([r[2] for r in rows], "int64"), window)
            filled, out = np.zeros(k, "int64"), []
            for r, w in zip(rows, where, strict=True):
                out.append((*r, first + given + int(w), int(filled[w])))
                filled[w] += r[2]
            given += k
            rows, held = [], 0
            return out

        def batch_of(out, id_type):
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

        id_type = pa.int64()
        for batch in batches:
            id_type, out = batch.schema.field("doc_id").type, []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array([*encode.encode(text.as_py() or "", allowed_special="all"), END_ID], "<u4")
                n, at = len(ids), 0
                while n - at >= window:
                    out.append((doc_id, at, window, ids[at:at + window].tobytes(), n, first + given, 0))
                    given += 1
                    at += window
                while at < n:
                    size = min(piece, n - at)
                    rows.append((doc_id, at, size, ids[at:at + size].tobytes(), n))
                    held += size
                    at += size
                if held >= block:
                    out += flush()
                if len(out) >= 2000:
                    yield batch_of(out, id_type)
                    out = []
            if out:
                yield batch_of(out, id_type)
        if rows:
            yield batch_of(flush(), id_type)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
