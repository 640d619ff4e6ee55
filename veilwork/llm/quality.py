"""Quality classifier: gradient-boosted trees on histograms of document statistics."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import staged

TRAIN_ROWS = 20_000  # labelled documents expected in the training sample, drawn by hash; the most the driver gets is twice this
TREES, DEPTH, BINS, RATE, RIDGE, MIN_LEAF = 60, 4, 64, 0.15, 1.0, 10

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
SYMBOLS, MARKS = (np.frombuffer(x, "u1") for x in (b"#*$%&|<>{}[]\\^~=_", b".,;:!?'\"()-"))
FEATURES = ("log_chars", "log_words", "mean_word", "dev_word", "max_word", "letters", "upper", "digits", "symbols", "marks", "spaces", "distinct",
            "top_word", "repeated_pairs", "repeated_triples", "wordless", "repeated_lines", "mean_line", "short_words", "plain_words", "sentence_ends", "entropy")


def statistics(text: str) -> list[float]:
    """Figures of a whole text, in the order of FEATURES; all zero for an empty one."""
    words = _WORD.findall(text)
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), len(text)
    sizes = np.fromiter(map(len, words), "float64", n)
    codes = np.fromiter(map(hash, words), "int64", n)
    distinct, number, uses = np.unique(codes, return_inverse=True, return_counts=True)

    def repeated(k: int) -> float:
        if n < k:
            return 0.0
        grams = number[:n - k + 1].astype("int64")
        for j in range(1, k):
            grams = np.unique(grams, return_inverse=True)[1] * len(distinct) + number[j:n - k + 1 + j]
        seen = np.unique(grams, return_counts=True)[1]
        return float(seen[seen > 1].sum() / len(grams))

    lines = [x for x in text.split("\n") if x.strip()]
    data = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), "u1"), minlength=256)
    p = data[data > 0] / data.sum()
    share = lambda a, b: float(data[a:b + 1].sum()) / chars
    upper = share(65, 90) if text.isascii() else len(_UPPER.findall(text)) / chars
    letters = share(65, 90) + share(97, 122) + share(0xC3, 0xF4)  # beyond ASCII: one first byte a character
    return [float(np.log1p(chars)), float(np.log1p(n)), float(sizes.mean()), float(sizes.std()), float(np.log1p(sizes.max())), letters, upper, share(48, 57),
            float(data[SYMBOLS].sum()) / chars, float(data[MARKS].sum()) / chars,
            1 - float(sizes.sum()) / chars, len(distinct) / n, float(uses.max()) / n, repeated(2), repeated(3),
            sum(1 for w in words if not w[0].isalpha() and not w[-1].isalpha()) / n, 1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
            float((sizes <= 3).mean()), sum(map(str.isalpha, words)) / n, sum(1 for w in words if w[-1] in ".!?") / n, float(-(p * np.log2(p)).sum())]


def features(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, features. Null counts as empty text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                rows = [statistics(t.as_py() or "") for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, features array<double>")


def grow(binned: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree of full depth over binned features, from sums per node, feature and bin: feature, last bin to the left, value."""
    n, m = binned.shape
    inner = 2 ** DEPTH - 1
    feature, cut = np.zeros(inner, "int32"), np.full(inner, BINS, "int32")
    node = np.zeros(n, "int64")
    for level in range(DEPTH):
        first, width = 2 ** level - 1, 2 ** level
        at = node - first
        best = np.full(width, 1e-6)
        g_all, h_all = np.bincount(at, gradient, width), np.bincount(at, weight, width)
        for f in range(m):
            key = at * BINS + binned[:, f]
            g = np.bincount(key, gradient, width * BINS).reshape(width, BINS).cumsum(1)
            h = np.bincount(key, weight, width * BINS).reshape(width, BINS).cumsum(1)
            c = np.bincount(key, minlength=width * BINS).reshape(width, BINS).cumsum(1)
            gain = g ** 2 / (h + RIDGE) + (g_all[:, None] - g) ** 2 / (h_all[:, None] - h + RIDGE) - (g_all ** 2 / (h_all + RIDGE))[:, None]
            gain[(c < MIN_LEAF) | (c[:, -1:] - c < MIN_LEAF)] = 0
            top = gain.argmax(1)
            won = gain[np.arange(width), top] > best
            best = np.where(won, gain[np.arange(width), top], best)
            feature[first:first + width][won], cut[first:first + width][won] = f, top[won]
        node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut[node])
    leaf = node - inner
    value = -RATE * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, weight, inner + 1) + RIDGE)
    return feature, cut, value


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Boosted trees for labels 0 and 1, as flat arrays: per tree the features and thresholds of its inner nodes and the
    values of its leaves, by level. Without rows of both labels the model is a constant."""
    prior = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(prior / (1 - prior)))
    model = {"start": start, "feature": np.zeros((0, 2 ** DEPTH - 1), "int32"), "threshold": np.zeros((0, 2 ** DEPTH - 1)), "value": np.zeros((0, 2 ** DEPTH))}
    if not 0 < y.sum() < len(y):
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1)
    score, trees = np.full(len(y), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        feature, cut, value = grow(binned, p - y, p * (1 - p))
        threshold = np.array([edges[f][c] if c < len(edges[f]) else np.inf for f, c in zip(feature, cut, strict=True)])
        trees.append((feature, threshold, value))
        score += traverse(x, feature[None], threshold[None], value[None])
    model |= {k: np.stack(v) for k, v in zip(("feature", "threshold", "value"), zip(*trees, strict=True), strict=True)}
    return model


def traverse(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sum of the trees' values for each row: all trees go down one level at a time."""
    trees = np.arange(len(feature))[None]
    node = np.zeros((len(x), len(feature)), "int64")
    for _ in range(DEPTH):
        go = np.take_along_axis(x, feature[trees, node].astype("int64"), 1) > threshold[trees, node]
        node = 2 * node + 1 + go
    return value[trees, node - (2 ** DEPTH - 1)].sum(1)


def train(stats: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """A model from `stats` (doc_id, features) and `labels` (doc_id, quality), on about `rows` rows chosen by hash. Of several
    labels of a document the largest counts; null labels do not."""
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    pairs = stats.join(known, "doc_id")
    share = min(1.0, rows / max(1, pairs.count()))
    chosen = pairs.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < share * (1 << 20)).limit(2 * rows)
    got = chosen.select("features", F.col("quality").cast("double").alias("quality")).toPandas()
    x = np.stack(got["features"].to_numpy()) if len(got) else np.zeros((0, len(FEATURES)))
    order = np.lexsort((*x.T, got["quality"].to_numpy())) if len(got) else []
    return fit(x[order], got["quality"].to_numpy()[order] if len(got) else np.zeros(0))


def score(stats: DataFrame, model: dict) -> DataFrame:
    """`stats` (doc_id, features, ...) with `score`, 0 to 1; an empty text is scored by its zero features. Other columns stay."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(column):
        m = shared.value
        if not len(column):
            return column.astype("float64")
        z = m["start"] + traverse(np.stack(column.to_numpy()), m["feature"], m["threshold"], m["value"])
        return column.__class__(1 / (1 + np.exp(-z)))

    return stats.withColumn("score", probability("features"))


def classify(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, held_out (null doc_ids are held out), score, predicted. Learns from labelled rows that
    are not held out; only the text enters a score."""
    stats = staged(features(docs).withColumn("held_out", F.coalesce(held_out, F.lit(True))), "quality-features")
    model = train(stats.filter("not held_out"), labels)
    return score(stats, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
