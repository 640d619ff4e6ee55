"""Language identification: TF-IDF n-gram vectors against several centroids per language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
DIMENSIONS = 4096  # hashed n-grams of one to three letters
CENTROIDS = 4  # per language
PER_LANGUAGE = 500  # labelled documents per language that are expected in the training sample, drawn by hash of the row
SAMPLE_ROWS = 20_000  # expected in the sample at most, shared by the languages: 160 MB of counts
LEAST_ROWS = 20  # expected of each language whatever their number
REJECT_QUANTILE, REJECT_SLACK = 0.995, 1.25  # a text farther from its centroid than this share of training texts, with slack
ITERATIONS = 12


def letters() -> np.ndarray:
    """Whether each code point is a letter; a task makes this table once."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def counts(text: str, letter: np.ndarray) -> np.ndarray | None:
    """Counts of hashed n-grams of the whole lower-cased text, other characters being one space; None without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    good = letter[points]
    if not good.any():
        return None
    points = np.where(good, points, 32)
    c = points[good | np.concatenate([[True], good[:-1]])].astype("uint64")
    with np.errstate(over="ignore"):
        one = (c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + one[2:]
        grams = [((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(52) for x in (one, two, three)]
    return np.bincount(np.concatenate(grams).astype("int64"), minlength=DIMENSIONS)


def vectors(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(rows).astype("float32") * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; each next start is the vector farthest from the ones before."""
    centers = [x.mean(0)]
    for _ in range(min(k, len(x)) - 1):
        centers.append(x[np.argmin((x @ np.array(centers).T).max(1))])
    c = np.array(centers)
    for _ in range(ITERATIONS):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        near = (x @ c.T).argmax(1)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """About `per_language` rows of each language, chosen by a hash of the row, and all rows of smaller languages. Many languages share
    SAMPLE_ROWS, but each keeps LEAST_ROWS, so none is left out. Rows that repeat are chosen together."""
    sizes = docs.groupBy("lang").count().collect()  # one row per language
    if not sizes:
        return docs
    each = max(LEAST_ROWS, min(per_language, SAMPLE_ROWS // len(sizes)))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], float(each) / r["count"])])
    return docs.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """A model from `labelled` (doc_id, text, lang): idf, centroids, their languages and the reach of each. Rows without
    text, lang or a letter teach nothing; without any row, the model knows no language."""
    def run(batches):
        letter = letters()
        for batch in batches:
            langs, rows = [], []
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                found = counts(text.as_py(), letter)
                if found is not None:
                    langs.append(lang)
                    rows.append(np.minimum(found, 65535).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary())], ["lang", "counts"])

    usable = labelled.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    rows = sample(usable, per_language).select("text", "lang").mapInArrow(run, "lang string, counts binary").collect()
    if not rows:
        return {"langs": [], "idf": np.ones(DIMENSIONS, "float32"), "centers": np.zeros((0, DIMENSIONS), "float32"), "reach": np.zeros(0), "of": []}
    data = np.array([np.frombuffer(r["counts"], "<u2") for r in rows])
    langs = np.array([r["lang"] for r in rows])
    idf = np.log((1 + len(data)) / (1 + (data > 0).sum(0))).astype("float32") + 1
    x = vectors(data, idf)
    centers, of, reach = [], [], []
    for lang in sorted(set(langs.tolist())):
        own = x[langs == lang]
        c = cluster(own, CENTROIDS)
        near = own @ c.T
        for j in range(len(c)):
            mine = 1 - near[near.argmax(1) == j, j]
            centers.append(c[j])
            of.append(lang)
            reach.append(float(np.quantile(mine, REJECT_QUANTILE)) * REJECT_SLACK if len(mine) else 0.0)
    return {"langs": sorted(set(of)), "idf": idf, "centers": np.array(centers, "float32"), "reach": np.array(reach), "of": of}


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, lang_pred, score (cosine to the nearest centroid, 0 to 1), rejected.

    `und` with score 0 if the text is null or has no letter, or the model knows no language. `rejected` marks texts
    that lie beyond the reach of their nearest centroid; their nearest language is still named. Whole texts count.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: CENTROIDS x DIMENSIONS numbers per language
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m, letter = shared.value, letters()
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                found = [counts(t.as_py() or "", letter) for t in part.column("text")]
                pred, score, out = [UNKNOWN] * len(found), np.zeros(len(found)), np.zeros(len(found), bool)
                at = [i for i, f in enumerate(found) if f is not None]
                if at and len(m["of"]):
                    near = vectors(np.array([found[i] for i in at]), m["idf"]) @ m["centers"].T
                    best = near.argmax(1)
                    for i, j, s in zip(at, best, near.max(1), strict=True):
                        pred[i], score[i], out[i] = m["of"][j], min(1.0, max(0.0, float(s))), 1 - s > m["reach"][j]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred), pa.array(score), pa.array(out)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
