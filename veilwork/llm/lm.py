"""Language-model scoring: unigram counts over the corpus and a gated recurrent network over its frequent words."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import row_keys, staged
from veilwork.llm.hashing import WordHasher, as_long

END = 0x0E0D  # the hash that stands for the end of a text
TOP_WORDS = 1 << 18  # at most so many frequent words are broadcast, 4 MB with their counts; the others meet theirs in a join
HIDDEN, CLASSES, MEMBERS = 16, 32, 32  # the network knows CLASSES x MEMBERS words; class CLASSES holds all others
SHORT = CLASSES * MEMBERS
WINDOW, BATCH = 32, 256  # steps of truncated backpropagation, documents side by side
SHARD_IDS = 1 << 22  # ids of whole training documents that one copy of the network learns from: their number sets the shards, not the partitions
ROUNDS, RATE = 1, 0.03
TOGETHER = 16_384  # documents scored side by side, so that few steps go to the last long ones alone
OUTPUT_ROWS = 65_536  # states whose outputs are computed at once
SLOTS = (1 << 20) - 1
GONE, HALF = np.float32(-1e9), np.float32(0.5)


def tokens(hasher: WordHasher, text: str | None) -> np.ndarray:
    return np.append(as_long(hasher.words(text or "")), END)


def gather(training: DataFrame) -> DataFrame:
    """One scan of the whole texts of `training` (text): rows of word (hash) and count for the distinct words of each batch, so what
    is gathered grows with the corpus."""
    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            found = [tokens(hasher, t.as_py()) for t in batch.column("text")]
            if found:
                word, count = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(count)], ["word", "count"])

    return training.select("text").mapInArrow(run, "word long, count long")


def frequent(counts: DataFrame, most: int = TOP_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The words of the highest counts and these counts, by hash: as many whole steps of a logarithmic scale as hold no more than `most`."""
    step = F.floor(F.log2("count") * 8)
    left, least = most, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # at most 8 x 64 rows
        if r["n"] > left:
            break
        left, least = left - r["n"], r["step"]
    got = counts.filter(step >= least).orderBy("word").toPandas() if least is not None else None
    return (got["word"].to_numpy("int64"), got["count"].to_numpy("int64")) if got is not None else (np.empty(0, "int64"), np.empty(0, "int64"))


class Network:
    """A gated recurrent unit over word ids. Ids: 0..SHORT-1 by falling count, SHORT for any other word.

    The output is factored: the class of a word (its id over MEMBERS), then the word within the class.
    """

    def __init__(self, w: dict[str, np.ndarray]):
        self.w = w

    @staticmethod
    def start(counts: np.ndarray, total: int) -> Network:
        """Untrained, it gives the counts' own distribution."""
        rng, h = np.random.default_rng(7), HIDDEN
        short = np.zeros(SHORT)
        short[:len(counts)] = counts
        inner = np.where(np.arange(SHORT) < len(counts), np.log(short + 1), GONE).reshape(CLASSES, MEMBERS)
        inner[inner.max(1) <= GONE / 2] = 0
        mass = np.append(short.reshape(CLASSES, MEMBERS).sum(1), max(0, total - short.sum()))
        known = np.append((np.arange(SHORT) < len(counts)).reshape(CLASSES, MEMBERS).any(1), True)
        draw = lambda *shape: rng.normal(0, 0.1, shape)
        w = {"x": draw(SHORT + 1, 3 * h), "u": draw(h, 3 * h), "c": draw(h, CLASSES + 1), "cb": np.where(known, np.log(mass + 1), GONE),
             "o": draw(CLASSES, h, MEMBERS), "ob": inner}
        return Network({k: v.astype("float32") for k, v in w.items()})

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in sorted(self.w)])

    def filled(self, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for k in sorted(self.w):
            n = self.w[k].size
            out[k], at = flat[at:at + n].reshape(self.w[k].shape).astype("float32"), at + n
        return Network(out)

    def step(self, ids: np.ndarray, h: np.ndarray):
        a, u, n = self.w["x"][ids], h @ self.w["u"], HIDDEN
        g = np.tanh((a[:, :2 * n] + u[:, :2 * n]) * HALF) * HALF + HALF  # the logistic function
        z, r = g[:, :n], g[:, n:]
        new = np.tanh(a[:, 2 * n:] + r * u[:, 2 * n:])
        return new + z * (h - new), (ids, h, z, r, new, u[:, 2 * n:])

    def output(self, h: np.ndarray, ids: np.ndarray, learn: bool = False):
        """Natural log of each word's probability after its state; with `learn`, also gradients of the loss to `h` and weights.

        States stand side by side, in the order of their words' classes, so that sums over classes and members run along memory.
        """
        w, k = self.w, (ids // MEMBERS).astype("int16")
        order = np.argsort(k, kind="stable")
        h, k, m, rows = h[order], k[order], ids[order], np.arange(len(ids))
        e = w["c"].T @ h.T
        e += w["cb"][:, None]
        e -= e.max(0)
        own = e[k, rows]
        np.exp(e, out=e)
        total = e.sum(0)
        out = own - np.log(total)
        if learn:
            e /= total
            e[k, rows] -= 1
            grad = {"c": h.T @ e.T, "cb": e.sum(1), "o": np.zeros_like(w["o"]), "ob": np.zeros_like(w["ob"])}
            dh = e.T @ w["c"].T
        bounds = np.searchsorted(k, np.arange(CLASSES + 1))
        for j in range(CLASSES):
            a, b = bounds[j], bounds[j + 1]
            if a == b:
                continue
            x, member, places = h[a:b], m[a:b] - j * MEMBERS, rows[:b - a]
            e = w["o"][j].T @ x.T
            e += w["ob"][j][:, None]
            e -= e.max(0)
            own = e[member, places]
            np.exp(e, out=e)
            total = e.sum(0)
            out[a:b] += own - np.log(total)
            if learn:
                e /= total
                e[member, places] -= 1
                grad["o"][j], grad["ob"][j] = x.T @ e.T, e.sum(1)
                dh[a:b] += e.T @ w["o"][j].T
        back = np.empty_like(order)
        back[order] = rows
        return (out[back], dh[back], grad) if learn else out[back]

    def gradients(self, ids: np.ndarray, targets: np.ndarray, h: np.ndarray):
        """Truncated backpropagation over one window (documents x steps): weights' gradients and the state after it. Targets below 0 are padding."""
        states, memory = [], []
        for t in range(ids.shape[1]):
            h, m = self.step(ids[:, t], h)
            states.append(h)
            memory.append(m)
        flat, want = np.stack(states, 1).reshape(-1, HIDDEN), targets.ravel()
        real = np.flatnonzero(want >= 0)
        dflat = np.zeros_like(flat)
        loss, dflat[real], grad = self.output(flat[real], want[real], learn=True)
        douts = dflat.reshape(*ids.shape, HIDDEN)
        grad["x"], grad["u"], inner = np.zeros_like(self.w["x"]), np.zeros_like(self.w["u"]), []
        dh = np.zeros_like(h)
        for t in range(ids.shape[1] - 1, -1, -1):
            at, before, z, r, new, u = memory[t]
            dh = dh + douts[:, t]
            da = dh * (1 - z) * (1 - new * new)
            dz, dr = dh * (before - new) * z * (1 - z), da * u * r * (1 - r)
            du = np.concatenate([dz, dr, da * r], 1)
            grad["u"] += before.T @ du
            inner.append(np.concatenate([dz, dr, da], 1))
            dh = dh * z + du @ self.w["u"].T
        words = np.concatenate([m[0] for m in memory[::-1]])
        order = np.argsort(words, kind="stable")
        first = np.flatnonzero(np.diff(words[order], prepend=-1))
        grad["x"][words[order][first]] = np.add.reduceat(np.concatenate(inner)[order], first)
        return grad, h, float(loss.sum()), len(real)

    def score(self, documents: list[np.ndarray]) -> np.ndarray:
        """Log10 of the probability of each whole document's ids. Documents go side by side, window by window; each carries its state on."""
        order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
        sizes = np.array([len(documents[i]) for i in order])
        total, h = np.zeros(len(order)), np.zeros((len(order), HIDDEN), "float32")
        inputs = np.full(len(order), 0)
        for start in range(0, int(sizes[0]) if len(sizes) else 0, WINDOW):
            live = int((sizes > start).sum())
            block = np.full((live, WINDOW), -1)
            for i in range(live):
                part = documents[order[i]][start:start + WINDOW]
                block[i, :len(part)] = part
            h, last = h[:live], inputs[:live]
            states = np.empty((live, WINDOW, HIDDEN), "float32")
            for t in range(min(WINDOW, int(sizes[0]) - start)):
                now = int((sizes > start + t).sum())
                h[:now], _ = self.step(last[:now], h[:now])
                states[:now, t] = h[:now]
                last[:now] = block[:now, t]
            rows, steps = np.nonzero(block >= 0)
            for a in range(0, len(rows), OUTPUT_ROWS):
                r, t = rows[a:a + OUTPUT_ROWS], steps[a:a + OUTPUT_ROWS]
                total[:live] += np.bincount(r, self.output(states[r, t], block[r, t]), live)
            inputs = last
        out = np.empty(len(order))
        out[order] = total / np.log(10)
        return out


def windows(documents: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """All ids of `documents` in windows (lanes x WINDOW): inputs, targets (-1 beyond the end), and which lanes of the window before go on in
    the first lanes. The end's id 0 precedes each document. The longest come first, so that few windows go to the last one alone."""
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    waiting = deque([*order[:BATCH], *(order[BATCH + i] for i in np.random.default_rng(1).permutation(max(0, len(order) - BATCH)))])
    lanes, carried = [], []
    while lanes or waiting:
        while waiting and len(lanes) < BATCH:
            lanes.append((documents[waiting.popleft()], 0))
        inputs, targets = np.zeros((len(lanes), WINDOW), "int64"), np.full((len(lanes), WINDOW), -1)
        for i, (x, at) in enumerate(lanes):
            part = x[at:at + WINDOW]
            targets[i, :len(part)], inputs[i, 1:len(part)], inputs[i, 0] = part, part[:-1], x[at - 1] if at else 0
        yield inputs, targets, carried
        carried = [i for i, (x, at) in enumerate(lanes) if at + WINDOW < len(x)]
        lanes = [(lanes[i][0], lanes[i][1] + WINDOW) for i in carried]


def train_shard(network: Network, documents: list[np.ndarray]) -> tuple[Network, float]:
    """One pass of Adam over all ids of `documents`, each document's state carried from window to window. Returns the network and its weight."""
    w = {k: v.copy() for k, v in network.w.items()}
    first, second, n, seen = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0, 0
    own, h = Network(w), np.zeros((0, HIDDEN), "float32")
    for inputs, targets, carried in windows(documents):
        h = np.concatenate([h[carried], np.zeros((len(inputs) - len(carried), HIDDEN), "float32")])
        grad, h, _, real = own.gradients(inputs, targets, h)
        n, seen = n + 1, seen + real
        rate = np.float32(RATE * real / (WINDOW * BATCH))  # by ids, so that windows of the last few documents do not outweigh full ones
        for k, g in grad.items():
            g = g / np.float32(max(1, real))
            first[k] += np.float32(0.1) * (g - first[k])
            second[k] += np.float32(0.01) * (g * g - second[k])
            w[k] -= rate * (first[k] / np.float32(1 - 0.9 ** n)) / (np.sqrt(second[k] / np.float32(1 - 0.99 ** n)) + np.float32(1e-6))
    return own, float(seen)


class Words:
    """Word ids and counts of the frequent words, looked up by hash."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        by_count = np.lexsort((words, -counts))[:SHORT]
        end = np.flatnonzero(words == END)
        if len(end):  # the end has id 0
            by_count = np.concatenate([end, by_count[by_count != end[0]]])[:SHORT]
        self.words, self.counts = words, counts
        self.ids = np.full(len(words), SHORT)
        self.ids[by_count] = np.arange(len(by_count))
        self.short_counts = counts[by_count]
        # A table of places by the low bits of the hash finds most words at once; `crowded` slots need the search.
        slots = words & SLOTS
        self.table, uses = np.full(SLOTS + 1, -1, "int32"), np.bincount(slots, minlength=SLOTS + 1)
        self.table[slots], self.crowded = np.arange(len(words), dtype="int32"), uses > 1

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's id, and its place among the frequent words or -1."""
        if not len(self.words):
            return np.full(len(hashes), SHORT), np.full(len(hashes), -1)
        slots = hashes & SLOTS
        at = self.table[slots]
        at = np.where((at >= 0) & (self.words[at] == hashes), at, -1)
        look = np.flatnonzero((at < 0) & self.crowded[slots])
        found = np.minimum(np.searchsorted(self.words, hashes[look]), len(self.words) - 1)
        at[look] = np.where(self.words[found] == hashes[look], found, -1)
        return np.where(at >= 0, self.ids[at], SHORT), at


def numbered(rows: DataFrame, words: Words) -> DataFrame:
    """`rows` with `text` replaced by: ids, those of all its tokens; n_tokens; how many of them are frequent words (top_known), with the sums of their
    logarithms of count + 1 for the network's words (short_logs) and the others (top_logs); n_beyond, tokens beyond the network's
    words; and the different words that are not frequent, with their uses."""
    shared = rows.sparkSession.sparkContext.broadcast((words.words, words.counts))
    kept = [c for c in rows.columns if c != "text"]

    def run(batches):
        hasher, known = WordHasher(), Words(*shared.value)
        logs = np.append(np.log10(known.counts + 1.0), 0.0)  # place -1: not frequent
        for batch in batches:
            out = []
            for text in batch.column("text"):
                hashes = tokens(hasher, text.as_py())
                ids, at = known.find(hashes)
                rare, uses = np.unique(hashes[at < 0], return_counts=True)
                beyond = ids == SHORT
                out.append((ids.astype("int16"), len(hashes), int((at >= 0).sum()), float(logs[at[~beyond]].sum()), float(logs[at[beyond]].sum()), int(beyond.sum()), rare, uses))
            if out:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))],
                                                 [*kept, *names])

    names = ["ids", "n_tokens", "top_known", "short_logs", "top_logs", "n_beyond", "rare", "uses"]
    types = [pa.list_(pa.int16()), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    ddl = ["array<short>", "long", "long", "double", "double", "long", "array<long>", "array<long>"]
    before = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept]
    return rows.mapInArrow(run, ", ".join(before + [f"{n} {t}" for n, t in zip(names, ddl, strict=True)]))


def fit_network(training: DataFrame, words: Words, total: int, rounds: int = ROUNDS) -> Network:
    """A network from `training` (ids, key1, key2), the whole documents, `total` ids in all. Shards by hash, of about SHARD_IDS ids, train
    a copy each, in an order that the rows' content sets; the copies are averaged in Spark, by their tokens, and the next
    round goes on from there. So neither the partitions of the table nor those of the cluster matter."""
    network = Network.start(words.short_counts, total)
    shards = max(1, -(-total // SHARD_IDS))
    dealt = training.withColumn("shard", F.pmod(F.xxhash64("key1"), F.lit(shards)).cast("int"))
    dealt = dealt.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "key1", "key2").select("shard", "ids")
    if rounds > 1:
        dealt = staged(dealt, "lm-shards")
    for _ in range(rounds):
        now = training.sparkSession.sparkContext.broadcast(network.w)

        def train(batches, now=now):
            def documents():
                held, shard = [], None
                for batch in batches:
                    for own, x in zip(batch.column("shard").to_pylist(), batch.column("ids"), strict=True):
                        if own != shard and held:
                            yield held
                            held = []
                        shard = own
                        held.append(x.values.to_numpy(zero_copy_only=False).copy())  # a view would keep the whole batch
                if held:
                    yield held

            values, weights = None, 0.0
            for held in documents():
                own, weight = train_shard(Network(now.value), held)
                part = own.flat().astype("float64") * weight
                values, weights = part if values is None else values + part, weights + weight
            if weights:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype="int32")), pa.array(values), pa.array(np.full(len(values), weights))], ["place", "value", "weight"])

        merged = (dealt.mapInArrow(train, "place int, value double, weight double").groupBy("place")
                  .agg((F.sum("value") / F.sum("weight")).alias("value")).orderBy("place").toPandas())  # one row per weight of the network
        if len(merged):
            network = network.filled(merged["value"].to_numpy())
    return network


def score_documents(docs: DataFrame, held_out: Column, rounds: int = ROUNDS) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null counts as empty text, whose only token is the end; a null doc_id is held out; rows that repeat are scored alike, and
    each counts in training. Without training rows every count is 0.

    `base_score` adds up log10((c + 1) / (N + V + 1)). `score` is the network's: class and word for frequent words, and for all
    others their class and (c + 1) / (R + U + 1), R and U being tokens and distinct words of training beyond the network's.
    Frequent words have their counts by broadcast; each document's distinct other words meet theirs in a join. An empty table gives no rows;
    texts of any length are learned from and scored whole; other columns are not read; scores do not depend on partitions.
    """
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(True)).alias("held_out"), *row_keys("doc_id", "text"))
    training = rows.filter("not held_out")
    seen = staged(gather(training), "lm-gathered")
    counts = staged(seen.groupBy("word").agg(F.sum("count").alias("count")), "lm-counts")
    sums = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    words = Words(*frequent(counts))
    scanned = staged(numbered(rows, words), "lm-scan")
    network = fit_network(scanned.filter("not held_out").select("ids", "key1", "key2"), words, sums["n"], rounds)
    shared = docs.sparkSession.sparkContext.broadcast(network.w)

    def run(batches):
        net, held = Network(shared.value), []

        def scored(parts):
            block = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            documents = [x.values.to_numpy(zero_copy_only=False) for x in block.column("ids")]
            return pa.RecordBatch.from_arrays([*(block.column(c) for c in passed), pa.array(net.score(documents))], [*passed, "network"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= TOGETHER:
                yield scored(held)
                held = []
        if held and sum(map(len, held)):
            yield scored(held)

    passed = [c for c in scanned.columns if c not in ("ids", "rare", "uses")]
    ddl = ", ".join(f"{c} {scanned.schema[c].dataType.simpleString()}" for c in passed) + ", network double"
    final = scanned.select("ids", *passed).mapInArrow(run, ddl)
    single = scanned.select("key1", "key2", F.explode(F.arrays_zip("rare", "uses")).alias("x")).select("key1", "key2", F.col("x.rare").alias("word"), F.col("x.uses").alias("n"))
    rest = (single.join(counts, "word").groupBy("key1", "key2")
            .agg(F.sum(F.col("n") * F.log10(F.col("count") + 1)).alias("logs"), F.sum("n").alias("known"), F.count("*").alias("words")))
    # Rows that repeat share their keys, so their words were counted once for each of them.
    again = scanned.groupBy("key1", "key2").agg(F.count("*").alias("again"))
    rest = rest.join(again, ["key1", "key2"]).select("key1", "key2", (F.col("logs") / F.col("again")).alias("logs"), (F.col("known") / F.col("again")).cast("long").alias("known"))
    short = int(words.short_counts.sum())
    spread, beyond = float(np.log10(sums["n"] + sums["v"] + 1)), float(np.log10(sums["n"] - short + sums["v"] - len(words.short_counts) + 1))
    logs = F.coalesce("logs", F.lit(0.0))
    return final.join(rest, ["key1", "key2"], "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("top_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(sums["n"])).cast("long").alias("train_tokens"),
        (F.col("short_logs") + F.col("top_logs") + logs - F.col("n_tokens") * spread).alias("base_score"),
        (F.col("network") + F.col("top_logs") + logs - F.col("n_beyond") * beyond).alias("score"))
