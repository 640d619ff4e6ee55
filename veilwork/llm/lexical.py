"""Ranked lexical search: impact vectors in buckets of like length, pruned by Cauchy-Schwarz and coordinate bounds."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.common import row_keys, staged

BLOCK_TERMS = 1 << 20  # terms of the items that one pass over the documents serves, repeats included; more items take more passes
BUCKET = 4096  # documents of a bucket
LONGEST = 0.95  # the first round takes the vectors above this quantile of length; what it finds prunes the rest
FOCUS = 0.8  # share of an item's squared length that its focus coordinates hold
SLACK = 1 + 1e-9  # rounding of the bounds, which are floating-point numbers; scores are not
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
DOCUMENTS, TOKENS = -1, -2  # in `scan`: what a row counts, if not the documents of a term


def terms_of(find, text: str | None) -> list[bytes]:
    return find((text or "").encode("utf-8", "surrogatepass").lower())  # on bytes, lower() changes A-Z alone


def finder():
    """TERM on UTF-8: maximal runs of ASCII letters and digits and all characters beyond ASCII."""
    return re.compile(rb"[0-9A-Za-z\x80-\xff]+").findall


def weight(n: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1.0))).astype("int64")


def read_items(items: DataFrame) -> DataFrame:
    """key1, key2, item_id, copies, terms: the different rows of `items` (item_id, text), how often each stands there, and its distinct terms."""
    def run(batches):
        find = finder()
        for batch in batches:
            terms = [sorted(set(terms_of(find, t.as_py()))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key1", "key2", "item_id", "copies")), pa.array(terms, pa.list_(pa.binary()))],
                                             ["key1", "key2", "item_id", "copies", "terms"])

    different = items.select("item_id", "text").groupBy("item_id", "text").agg(F.count("*").alias("copies"))
    kind = items.schema["item_id"].dataType.simpleString()
    return different.select("item_id", "text", "copies", *row_keys("item_id", "text")).mapInArrow(
        run, f"key1 long, key2 long, item_id {kind}, copies long, terms array<binary>").filter("size(terms) > 0")


def scan(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n, terms, tfs: the terms of `vocabulary` (by place) in each whole text of `docs` that has any, how often, and the number n of all its
    terms. Other rows have `term` and `uses`: partial counts of the documents that hold a term, of all documents with terms, and of all terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        find, places = finder(), {t: i for i, t in enumerate(shared.value)}
        df, documents, tokens, kind = np.zeros(len(places), "int64"), 0, 0, None
        names = ["doc_id", "n", "terms", "tfs", "term", "uses"]
        lists = pa.list_(pa.int32())
        for batch in batches:
            kind, at, rows, which, often = batch.schema.field("doc_id").type, [], [], [], []
            for i, text in enumerate(batch.column("text")):
                found = terms_of(find, text.as_py())
                if not found:
                    continue
                documents, tokens = documents + 1, tokens + len(found)
                uses = Counter(p for p in map(places.get, found) if p is not None)
                if uses:
                    at.append(i)
                    rows.append((len(found), len(uses)))
                    which += uses.keys()
                    often += uses.values()
            if at:
                n, sizes = (np.array(x) for x in zip(*rows, strict=True))
                which, offsets = np.array(which, "int32"), pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                df += np.bincount(which, minlength=len(df))
                none = pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(which)),
                                                  pa.ListArray.from_arrays(offsets, pa.array(often, pa.int32())), none, none], names)
        if documents:
            seen = np.flatnonzero(df)
            term, uses = np.concatenate([seen, [DOCUMENTS, TOKENS]]), np.concatenate([df[seen], [documents, tokens]])
            rest = pa.nulls(len(term), lists)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(term), kind), pa.nulls(len(term), pa.int64()), rest, rest, pa.array(term, pa.int64()), pa.array(uses, pa.int64())], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, tfs array<int>, term long, uses long")


def vectors(found: DataFrame, documents: int, tokens: int) -> DataFrame:
    """length, doc_id, terms, impacts: the impact vectors of the documents that `found` names, and their Euclidean lengths."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, sizes = batch.column("n").to_numpy(), batch.column("terms").value_lengths().to_numpy()
            whole = n.astype(object) if 90 * documents * int(n.max(initial=0)) >= 1 << 63 else n
            m = (10 + 90 * documents * whole // tokens).astype("int64")
            tf = batch.column("tfs").flatten().to_numpy().astype("int64")
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes))
            ends = np.cumsum(sizes)
            length = np.sqrt(np.add.reduceat(impact.astype("float64") ** 2, ends - sizes)) if len(sizes) else np.empty(0)
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(length), batch.column("doc_id"), pa.ListArray.from_arrays(offsets, batch.column("terms").flatten()),
                                              pa.ListArray.from_arrays(offsets, pa.array(impact, pa.int32()))], ["length", "doc_id", "terms", "impacts"])

    return found.filter("term is null").select("doc_id", "n", "terms", "tfs").mapInArrow(run, f"length double, doc_id {kind}, terms array<int>, impacts array<int>")


class Item:
    """An item as a vector of term weights, the heaviest first, and the best documents found so far."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, least: int):
        order = np.argsort(-weights, kind="stable")
        self.terms, self.weights, self.least = terms[order], weights[order], least
        squares = np.cumsum(self.weights.astype("float64") ** 2)
        self.length = float(np.sqrt(squares[-1])) if len(squares) else 0.0
        self.focus = int(np.searchsorted(squares, FOCUS * squares[-1])) + 1 if len(squares) else 0
        self.rest = float(np.sqrt(max(0.0, squares[-1] - squares[min(self.focus, len(squares)) - 1]))) if len(squares) else 0.0
        self.best: pa.Table | None = None

    def keep(self, doc_ids: pa.Array, scores: np.ndarray, k: int) -> None:
        """Add documents; the k of the highest scores stay, equal ones by doc_id, null last. The k-th score is the bound from now on."""
        new = pa.table({"score": pa.array(scores), "doc_id": doc_ids})
        both = new if self.best is None else pa.concat_tables([self.best, new])
        order = pc.sort_indices(both, sort_keys=[("score", "descending"), ("doc_id", "ascending")], null_placement="at_end")
        self.best = both.take(order[:k])
        if len(self.best) == k:
            self.least = max(self.least, self.best.column("score")[k - 1].as_py())


def search_bucket(items: list[Item], bucket: pa.Table, k: int) -> None:
    """Offer the documents of one bucket, of like length, to all items."""
    length = bucket.column("length").to_numpy()
    terms, impacts, doc_ids = bucket.column("terms").combine_chunks(), bucket.column("impacts").combine_chunks(), bucket.column("doc_id").combine_chunks()
    row = np.repeat(np.arange(len(bucket)), terms.value_lengths().to_numpy())
    term, impact = terms.flatten().to_numpy(), impacts.flatten().to_numpy().astype("int64")
    order = np.argsort(term, kind="stable")
    term, row, impact = term[order], row[order], impact[order]  # lists by term
    longest, squared = float(length.max()), length * length
    for item in items:
        if not len(item.terms) or item.length * longest * SLACK < item.least:  # Cauchy-Schwarz: no document of the bucket can reach the bound
            continue
        first, last = np.searchsorted(term, item.terms, "left"), np.searchsorted(term, item.terms, "right")
        sizes = last - first
        at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        in_focus = int(sizes[:item.focus].sum())
        near, far = at[:in_focus], at[in_focus:]
        # Coordinate bounds: what the focus coordinates give, and at most the product of what is left of both lengths.
        dot = np.bincount(row[near], np.repeat(item.weights[:item.focus], sizes[:item.focus]) * impact[near].astype("float64"), len(bucket))
        covered = np.bincount(row[near], impact[near].astype("float64") ** 2, len(bucket))
        bound = (dot + item.rest * np.sqrt(np.maximum(squared - covered, 0))) * SLACK
        alive = bound >= max(item.least, 1)
        if not alive.any():
            continue
        # Survivors are scored in whole numbers over all their coordinates.
        score = np.zeros(len(bucket), "int64")
        for part, weights in ((near, np.repeat(item.weights[:item.focus], sizes[:item.focus])), (far, np.repeat(item.weights[item.focus:], sizes[item.focus:]))):
            some = alive[row[part]]
            np.add.at(score, row[part][some], weights[some] * impact[part][some])
        good = np.flatnonzero(score >= max(item.least, 1))
        if len(good):
            if len(good) > k:  # of equal scores all stay until doc_id decides
                good = good[score[good] >= np.partition(score[good], len(good) - k)[len(good) - k]]
            item.keep(doc_ids.take(pa.array(good)), score[good], k)


def search_vectors(table: DataFrame, block: dict, weights: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    """item, doc_id, score: the k best documents of each task for each item, without those below the bounds `least`."""
    shared = table.sparkSession.sparkContext.broadcast((block["terms"], weights, least))
    kind = table.schema["doc_id"].dataType.simpleString()

    def run(batches):
        terms, weights, least = shared.value
        items = [Item(t, weights[t], int(x)) for t, x in zip(terms, least, strict=True)]
        held = []
        for batch in batches:
            for a in range(0, len(batch), BUCKET):
                held.append(batch.slice(a, BUCKET))
                if sum(map(len, held)) >= BUCKET:
                    search_bucket(items, pa.Table.from_batches(held), k)
                    held = []
        if held and sum(map(len, held)):
            search_bucket(items, pa.Table.from_batches(held), k)
        for i, item in enumerate(items):
            if item.best is not None:
                best = item.best.combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), i)), best.column("doc_id"), best.column("score")], ["item", "doc_id", "score"])

    return table.select("length", "doc_id", "terms", "impacts").mapInArrow(run, f"item long, doc_id {kind}, score long")


def best_of(found: DataFrame, k: int, *by: str | Column) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_block(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """key1, key2, rank, doc_id, score for the items `rows` (key1, key2, terms), whose size is bounded."""
    spark = docs.sparkSession
    vocabulary = sorted(set().union(*(r["terms"] for r in rows)))
    places = {t: i for i, t in enumerate(vocabulary)}
    block = {"terms": [np.array([places[t] for t in r["terms"]], "int64") for r in rows]}
    found = staged(scan(docs, [bytes(t) for t in vocabulary]), "lexical-scan")
    sums = {r["term"]: r["uses"] for r in found.filter("term is not null").groupBy("term").agg(F.sum("uses").alias("uses")).collect()}  # a row a term
    documents, tokens = sums.pop(DOCUMENTS, 0), sums.pop(TOKENS, 0)
    df = np.zeros(len(vocabulary), "int64")
    df[list(sums)] = list(sums.values())
    weights = weight(documents, df)
    # The global order by length: equal lengths, such as those of copies, are told apart by a hash.
    table = vectors(found, documents, max(1, tokens))
    table = staged(table.repartitionByRange(F.desc("length"), F.xxhash64("doc_id")).sortWithinPartitions(F.desc("length")), "lexical-vectors")
    cut = table.agg(F.percentile_approx("length", LONGEST, 1000)).first()[0] or 0.0
    least = np.zeros(len(rows), "int64")
    first = staged(best_of(search_vectors(table.filter(F.col("length") >= cut), block, weights, least, k), k, "item"), "lexical-first")
    for r in first.filter(F.col("rank") == k).select("item", "score").collect():  # a row an item
        least[r["item"]] = r["score"]
    rest = search_vectors(table.filter(F.col("length") < cut), block, weights, least, k)
    keys = spark.createDataFrame([(i, r["key1"], r["key2"]) for i, r in enumerate(rows)], "item long, key1 long, key2 long")
    return best_of(first.drop("rank").unionByName(rest), k, "item").join(F.broadcast(keys), "item").select("key1", "key2", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of `items` (item_id, text) the k documents of `docs` (doc_id, text) of the highest scores above 0, equal
    scores by ascending doc_id.

    Items are taken in blocks of about BLOCK_TERMS terms. For a block the documents' impact vectors over its terms are ordered by
    length in buckets. A bucket is left out for an item if the product of their lengths is below the item's k-th best score so far;
    within a bucket the item's heaviest coordinates bound each document's score. What is left is scored exactly.

    Null and empty texts have no terms: such documents are no result and count nowhere, such items have no rows. A null doc_id comes last among equal
    scores; rows of `docs` that repeat are ranked each; rows of `items` that repeat have their results each; other columns are not read; empty
    tables give no rows; texts are read whole.
    """
    spark = docs.sparkSession
    read = staged(read_items(items), "lexical-items")
    blocks = -(-(read.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS)
    kinds = f"key1 long, key2 long, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long"
    out = spark.createDataFrame([], kinds)
    for b in range(blocks):
        rows = read.filter(F.pmod("key1", F.lit(blocks)) == b).select("key1", "key2", "terms").collect()
        if rows:
            out = out.unionByName(search_block(docs, rows, k))
    return (out.join(read.select("key1", "key2", "item_id", "copies"), ["key1", "key2"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select("item_id", "rank", "doc_id", "score"))
