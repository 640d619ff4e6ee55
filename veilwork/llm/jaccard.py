"""N-gram Jaccard join by vertical partitioning, and the groups of near-duplicates that its links make."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.common import marked, passing, row_keys, staged
from veilwork.llm.hashing import WordHasher, as_long, mix

WIDTH = 5  # words of an n-gram
PERCENT = 80  # two documents link when 100 * intersection >= PERCENT * union
FRAGMENTS = 16  # parts of the global n-gram order in which the overlaps of candidate pairs are counted
SMALL = 32  # sets below this size are compared by single n-grams, not by segments
COMMON_LOCAL, COMMON_USES, COMMON_SHARE = 3, 50, 1 << 21
# An n-gram is common if documents that hold it, summed over batches with COMMON_LOCAL of them at least, number COMMON_USES and one
# COMMON_SHARE-th of all n-grams. So at most COMMON_SHARE n-grams are common: 16 MB. Which ones are decides the order, never the result.
SALTS = 64
FEW = 4  # sets of a signature's list that are compared each with each at once: FEW * (FEW - 1) / 2 pairs at most
SKETCH = 2048  # bits of the parity sketch of a set
FOLD = SKETCH // 256  # 64-bit words of a sketch folded to a quarter of its bits
BLOCK = 1000  # sets of a signature's list that one part of the full round holds
HOT_SHARE = 1000  # a row that repeats is hot if more than one HOT_SHARE-th of all rows are it


def _identity(grams: np.ndarray, seed: int) -> tuple[int, int]:
    """128 bits that name a set of n-grams, in two halves: the sum and the parities of its spread n-grams."""
    spread = mix(grams ^ np.uint64(seed + 1))
    a, b = as_long(mix(np.array([spread.sum(), np.bitwise_xor.reduce(spread)], "uint64")))
    return int(a), int(b)


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parity of the number of n-grams that fall on each of SKETCH bits. Sketches of two sets differ in no more bits than the sets do
    in n-grams, since what both hold cancels out."""
    odd = np.bincount((mix(grams ^ np.uint64(0x0DD)) & np.uint64(SKETCH - 1)).astype("int64"), minlength=SKETCH) & 1
    return np.packbits(odd.astype("u1")).view("int64")


def profile(docs: DataFrame, seed: int) -> DataFrame:
    """Rows with key1: doc_id, n_shingles and the identity (id, check) and sketch of the set of each row of `docs`; empty sets have no id. Rows
    with `gram`: n-grams that COMMON_LOCAL different sets of a batch hold, and how many do."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            rows, sets = [], {}
            for grams in hasher.shingle_sets(batch.column("text").to_pylist(), WIDTH):
                a, b = _identity(grams, seed) if len(grams) else (None, None)
                rows.append((len(grams), a, b, sketch(grams) if len(grams) else None))
                if len(grams):
                    sets[a] = grams
            gram, uses = np.unique(np.concatenate(list(sets.values())), return_counts=True) if sets else (np.empty(0, "uint64"), np.empty(0, "int64"))
            gram, uses = as_long(gram)[uses >= COMMON_LOCAL], uses[uses >= COMMON_LOCAL]
            ids = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))]
            none = [pa.nulls(len(rows), pa.int64())] * 2
            names = ["doc_id", "key1", "key2", "n_shingles", "id", "check", "sketch", "gram", "uses"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), *ids, *none], names)
            if len(gram):
                doc_ids = pa.nulls(len(gram), batch.schema.field("doc_id").type)
                yield pa.RecordBatch.from_arrays([doc_ids, *[pa.nulls(len(gram), pa.int64())] * 5, pa.nulls(len(gram), pa.list_(pa.int64())), pa.array(gram), pa.array(uses)], names)

    return docs.select("doc_id", "text", *row_keys("doc_id", "text")).mapInArrow(
        run, f"doc_id {kind}, key1 long, key2 long, n_shingles long, id long, check long, sketch array<long>, gram long, uses long")


def common_grams(found: DataFrame) -> np.ndarray:
    total = found.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    least = max(COMMON_USES, total // COMMON_SHARE)
    rows = found.filter("gram is not null").groupBy("gram").agg(F.sum("uses").alias("uses")).filter(F.col("uses") >= least).select("gram").toPandas()
    return np.sort(rows["gram"].to_numpy("int64").view("uint64"))


def _is_in(grams: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(grams), bool)
    return table[np.minimum(np.searchsorted(table, grams), len(table) - 1)] == grams


def signatures(grams: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set of which any two linking sets share one; and whether each stands for a common n-gram.

    Linking sets x, y differ in at most a quarter of |x| n-grams, and of |y|. The order of all n-grams, rare ones by hash and
    then common ones by hash, is cut into as many fragments as the power of two below the set's size (sets near the next
    power also use twice as many). So few differences leave one equal among the first |x|/4 + 1 fragments that
    are not empty; the hash of a segment is its signature. Sets too small, or with too few rare n-grams, use their first
    |x|/4 + 1 single n-grams as well: if two linking sets both lack fragments, these meet.
    """
    n = len(grams)
    need, usual = n // 4 + 1, _is_in(grams, common)
    rare = grams[~usual]
    out, enough = [], True
    power = n.bit_length() - 1
    if n >= SMALL:
        for bits in (power, power + 1) if 5 * n >= 4 << (power + 1) else (power,):
            part = rare >> np.uint64(64 - bits)
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, "int64")
            enough &= len(starts) >= need
            if len(starts):
                with np.errstate(over="ignore"):
                    sums = np.add.reduceat(mix(rare), starts)
                    out.append(mix(sums[:need] + mix(part[starts[:need]] + np.uint64(bits << 56))))
    flags = [np.zeros(sum(map(len, out)), bool)]
    if not enough or 4 * n < 5 * SMALL:
        single = np.concatenate([rare, grams[usual]])[:need]
        out.append(mix(single ^ np.uint64(0x5EED)))
        flags.append(np.arange(len(single)) >= len(rare))
    return np.concatenate(out), np.concatenate(flags)


def postings(docs: DataFrame, common: np.ndarray, seed: int) -> DataFrame:
    """signature, common, id, n of every different set of a batch."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            seen, held, size = set(), [], 0

            def block(held):
                lengths = [len(s) for _, _, s, _ in held]
                columns = [as_long(np.concatenate([s for _, _, s, _ in held])), np.concatenate([c for _, _, _, c in held]),
                           np.repeat([i for i, _, _, _ in held], lengths), np.repeat([n for _, n, _, _ in held], lengths)]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["signature", "common", "id", "n"])

            for grams in hasher.shingle_sets(batch.column("text").to_pylist(), WIDTH):
                if not len(grams):
                    continue
                own = _identity(grams, seed)[0]
                if own not in seen:
                    seen.add(own)
                    held.append((own, len(grams), *signatures(grams, shared.value)))
                    size += len(held[-1][2])
                    if size > 100_000:
                        yield block(held)
                        held, size = [], 0
            if held:
                yield block(held)

    return docs.select("text").mapInArrow(run, "signature long, common boolean, id long, n long")


def shared_postings(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lists, pairs). `lists` holds signature, id, n: the rows of `found` whose signature another set has that may link with theirs by its
    size. Lists of FEW sets at most are not in it: `pairs` (id, other, n, m) has theirs, each set with the larger ones that its size fits.

    The lists of rare signatures are short, as common n-grams are not among them, and a window in the order of sizes sees them
    whole: if any size fits, that of a neighbour does. Those of common n-grams pass in SALTS parts, then are counted by a join.
    """
    salt = F.when(F.col("common"), F.pmod("id", F.lit(SALTS))).otherwise(F.lit(-1))
    dealt = found.withColumn("salt", salt).repartition("signature", "salt")  # both windows share this one shuffle
    w = Window.partitionBy("signature", "salt").orderBy("n", "id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fits = lambda small, large: F.coalesce(100 * small >= PERCENT * large, F.lit(False))
    # A set that several batches posted stands in a row here; the first stays. One without another set may pass, but goes below as a list of one.
    again = F.coalesce(F.col("id") == F.col("last"), F.lit(False))
    near = ~again & (F.col("common") | fits(F.col("before"), F.col("n")) | fits(F.col("n"), F.col("after")))
    seen = dealt.select("signature", "salt", "common", "id", "n", F.lag("id").over(w).alias("last"), F.lag("n").over(w).alias("before"), F.lead("n").over(w).alias("after")).filter(near)
    # The rest, in the same partitions and order: sets that fit each other all passed the filter.
    seen = seen.select("signature", "common", "id", "n", F.count(F.lit(1)).over(whole).alias("sets"),
                       *[F.lead(F.struct("id", "n"), i).over(w).alias(f"next{i}") for i in range(1, FEW)])
    few = (F.col("sets") <= FEW) & ~F.col("common")
    later = F.filter(F.array(*[f"next{i}" for i in range(1, FEW)]), lambda s: fits(F.col("n"), s["n"]))
    seen = seen.withColumn("later", F.when(few, later)).filter((F.size("later") > 0) | F.col("later").isNull())
    seen = staged(seen.select(F.when(~few, F.col("signature")).alias("signature"), "common", "id", "n", "later"), "jaccard-postings")
    pairs = (seen.filter("later is not null").select("id", "n", F.explode("later").alias("s"))
             .select("id", F.col("s.id").alias("other"), "n", F.col("s.n").alias("m")))
    seen = seen.filter("later is null")
    often = seen.filter("common")
    lists = often.groupBy("signature").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("signature")
    return seen.filter("not common").unionByName(often.join(lists, "signature")).select("signature", "id", "n"), pairs


def segments(docs: DataFrame, pairs: DataFrame, repeated: DataFrame, seed: int, put=staged) -> DataFrame:
    """id, key1, fragment, grams, left, right: the sets of the rows that `pairs` name by key_a (left) and key_b (right), in their parts
    of the global order. Maps of fixed size choose the rows before their texts are hashed, so some others are there too; joins by
    id and key1 leave those out. Nothing is shuffled but sets of rows that repeat (`repeated`: key1), of which one stays."""
    def run(batches):
        hasher = WordHasher()

        def block(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                              ["id", "key1", "fragment", "grams", "left", "right", "again"])

        kinds, rows = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.bool_()] * 3], []
        for batch in batches:
            sets = hasher.shingle_sets(batch.column("text").to_pylist(), WIDTH)
            for grams, *named in zip(sets, *(batch.column(c).to_pylist() for c in ("key1", "left", "right", "again")), strict=True):
                if len(grams):
                    own = _identity(grams, seed)[0]
                    bounds = np.searchsorted(grams >> np.uint64(60), np.arange(1, FRAGMENTS))
                    rows += [(own, named[0], f, as_long(part), *named[1:]) for f, part in enumerate(np.split(grams, bounds)) if len(part)]
                if len(rows) > 2000:
                    yield block(rows)
                    rows = []
        if rows:
            yield block(rows)

    keyed = docs.select("text", row_keys("doc_id", "text")[0])
    for name, keys in (("left", pairs.select("key_a")), ("right", pairs.select("key_b")), ("again", repeated)):
        keyed = marked(keyed, F.col("key1"), keys, name)
    found = keyed.filter("left or right").mapInArrow(run, "id long, key1 long, fragment int, grams array<long>, left boolean, right boolean, again boolean")
    found = put(found, "jaccard-segments")
    again = found.filter("again")
    if again.isEmpty():
        return found
    return found.filter("not again").unionByName(put(again.dropDuplicates(["id", "key1", "fragment"]), "jaccard-again"))


def close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b, n_a, n_b) that may link by their sizes and the sketches of `nodes` (id, key1, sketch), with key_a and key_b: linking
    sets differ in a ninth of the sum of their sizes at most, so pairs whose sketches differ in more bits are out. Only sketches move, 256 bytes a set."""
    fit = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    one = nodes.select(F.col("id").alias("a"), F.col("key1").alias("key_a"), F.col("sketch").alias("of_a"))
    two = nodes.select(F.col("id").alias("b"), F.col("key1").alias("key_b"), F.col("sketch").alias("of_b"))
    odd = F.aggregate(F.zip_with("of_a", "of_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return (pairs.filter(fit).join(one, "a").join(two, "b").filter((100 + PERCENT) * odd <= (100 - PERCENT) * (F.col("n_a") + F.col("n_b")))
            .select("a", "b", "n_a", "n_b", "key_a", "key_b"))


def facing(pairs: DataFrame) -> DataFrame:
    """`pairs` (a, b, n_a, n_b, key_a, key_b) turned so that b is the set of more pairs: few sets wait for the many that are sent to them."""
    uses = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count("*").alias("uses"))
    both = (pairs.join(uses.select(F.col("id").alias("a"), F.col("uses").alias("uses_a")), "a")
            .join(uses.select(F.col("id").alias("b"), F.col("uses").alias("uses_b")), "b"))
    turn = F.col("uses_a") > F.col("uses_b")
    names = [(f"{x}a", f"{x}b") for x in ("", "n_", "key_")]
    return both.select(*[F.when(turn, F.col(y)).otherwise(F.col(x)).alias(z) for p in names for x, y, z in ((*p, p[0]), (*p[::-1], p[1]))])


def links_among(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b, n_a, n_b, key_a, key_b) that link. Each fragment's overlap is counted by itself; the counts are summed per pair."""
    left = parts.filter("left").select(F.col("id").alias("a"), F.col("key1").alias("key_a"), "fragment", F.col("grams").alias("of_a"))
    right = parts.filter("right").select(F.col("id").alias("b"), F.col("key1").alias("key_b"), "fragment", F.col("grams").alias("of_b"))
    counts = (pairs.join(left, ["a", "key_a"]).drop("key_a").join(right, ["b", "key_b", "fragment"])
              .select("a", "b", "n_a", "n_b", F.size(F.array_intersect("of_a", "of_b")).alias("both")))
    same = counts.groupBy("a", "b", "n_a", "n_b").agg(F.sum("both").alias("both"))
    return same.filter(100 * F.col("both") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """id, root: the smallest id that each id of `edges` (a, b) reaches. Alternates large-star and small-star steps, each written,
    until the edges no longer change; then each id points at its root. Only the last edges' result stays."""
    with passing(edges.sparkSession, "cc") as put:
        now, mark = put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges"), None
        while True:
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            now = put(small.filter("u <> v").distinct(), "edges")
            state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if tuple(state) == mark:
                break
            mark = tuple(state)
        roots = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        return staged(roots.unionByName(roots.select("root").distinct().select(F.col("root").alias("id"), "root")), "cc-roots")


def mixed_lists(lists: DataFrame, turn: int) -> DataFrame:
    """The rows of `lists` (signature, id, n, root) whose list is not yet all one component, with `head`, one set of the list. In the first
    turn all lists take it by the same order, so the same sets lead many lists; later every list draws its own, so a set meets many others."""
    order = F.struct(F.xxhash64(*(("id",) if turn == 0 else ("id", "signature")), F.lit(turn)).alias("h"), "root", "id", "n")
    heads = lists.groupBy("signature").agg(F.min(order).alias("head"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y")
    return lists.join(heads.select("signature", "head"), "signature")


def star_pairs(mixed: DataFrame) -> DataFrame:
    """id, other, n, m: each set of `mixed` against the head of its list."""
    return mixed.filter("root <> head.root").select("id", F.col("head.id").alias("other"), "n", F.col("head.n").alias("m"))


def rest_pairs(lists: DataFrame, nodes: DataFrame, put=staged) -> DataFrame:
    """id, other, n, m: the sets of a signature's list (signature, id, n, root) that are in different components and may link by their
    sizes and folded sketches, which the rows carry: pairs that fail are never written.

    The sets outside the largest component of a list meet all of it; those inside it never meet each other. A list comes in
    parts of BLOCK sets, each a unit of the join, so that no list is the work of one task.
    """
    roots = lists.groupBy("signature", "root").agg(F.count("*").alias("sets"))
    mixed = (roots.groupBy("signature").agg(F.max_by("root", F.struct("sets", "root")).alias("main"), F.sum("sets").alias("sets"), F.count("*").alias("roots"))
             .filter("roots > 1").select("signature", "main", F.ceil(F.col("sets") / BLOCK).cast("int").alias("parts")))
    word = lambda i: F.get("sketch", F.lit(i))
    fold = [word(i).bitwiseXOR(word(i + FOLD)).bitwiseXOR(word(i + 2 * FOLD)).bitwiseXOR(word(i + 3 * FOLD)).alias(f"f{i}") for i in range(FOLD)]
    rows = put(lists.join(mixed, "signature").join(nodes.select("id", *fold), "id"), "jaccard-mixed")
    ones = rows.filter("root <> main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    all_ = rows.select("signature", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("other"), F.col("n").alias("m"),
                       F.col("root").alias("other_root"), *[F.col(f"f{i}").alias(f"g{i}") for i in range(FOLD)])
    odd = sum((F.bit_count(F.col(f"f{i}").bitwiseXOR(F.col(f"g{i}"))) for i in range(1, FOLD)), F.bit_count(F.col("f0").bitwiseXOR(F.col("g0"))))
    new = (F.col("root") != F.col("other_root")) & ((F.col("other_root") == F.col("main")) | (F.col("id") < F.col("other")))
    fit = 100 * F.least("n", "m") >= PERCENT * F.greatest("n", "m")
    return (ones.join(all_, ["signature", "part"]).filter(new & fit & ((100 + PERCENT) * odd <= (100 - PERCENT) * (F.col("n") + F.col("m"))))
            .select("id", "other", "n", "m"))


STARS = 3  # at most so many rounds in which each signature proposes pairs with one of its sets only, each time another one


def rooted(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, key1, key2, n_shingles, root: what all rows of a component share and no others,
    whatever their doc_id; null without n-grams.

    A text's set are its distinct n-grams of WIDTH words (A-Z lower-cased), or the whole of fewer words as one. Sets link by
    PERCENT. Null and empty texts have no n-grams and link with nothing, not even each other. Equal sets are one node, however
    many documents have them, so copies and rows that repeat share a component.

    Signatures propose pairs. Those of FEW sets at most propose all theirs at once. Of the others every signature first proposes its sets against one of them, so a group of copies gives a
    star and not all its pairs, round after round until none links; what is linked then is left alone, and only sets of one signature that are still in
    different components are compared with each other, first by folded sketches where the lists are joined. So no link between components is missed.
    """
    seed = 0
    while True:
        found = staged(profile(docs, seed), "jaccard-profile")
        clash = found.filter("id is not null").groupBy("id").agg(F.min("check").alias("x"), F.max("check").alias("y")).filter("x <> y")
        if clash.isEmpty():
            break
        seed += 1
    rows = found.filter("key1 is not null")
    shared, small = shared_postings(postings(docs, common_grams(found), seed))
    held = shared.select("id").union(small.select("id")).union(small.select("other")).distinct()
    first = rows.filter("id is not null").join(held, "id", "left_semi").groupBy("id").agg(F.min("key1").alias("key1"), F.min("sketch").alias("sketch"))
    nodes = staged(first, "jaccard-nodes")
    repeated = staged(rows.filter("id is not null").groupBy("key1").agg(F.count("*").alias("rows")).filter("rows > 1").select("key1"), "jaccard-repeated")
    labels, links, done, star, turn = None, None, None, True, 0
    while True:
        lists = shared if labels is None else shared.join(labels, "id", "left")
        lists = lists.select("signature", "id", "n", (F.col("id") if labels is None else F.coalesce("root", "id")).alias("root"))
        with passing(docs.sparkSession, "jaccard-round") as put:
            if star:
                mixed = mixed_lists(lists, turn)
                if turn > 0:  # components only grow, so the lists left out here stay out
                    mixed = staged(mixed, "jaccard-lists")
                    shared = mixed.select("signature", "id", "n")
                pairs = star_pairs(mixed) if turn > 0 else star_pairs(mixed).unionByName(small)
            else:
                pairs = rest_pairs(lists, nodes, put)
            swap = F.col("id") > F.col("other")
            pairs = pairs.select(*[F.when(swap, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("other", "id", "a"), ("id", "other", "b"), ("m", "n", "n_a"), ("n", "m", "n_b"))]).distinct()
            if done is not None:
                pairs = pairs.join(done, ["a", "b"], "left_anti")
            pairs = staged(pairs, "jaccard-pairs")
            near = put(facing(put(close(pairs, nodes), "jaccard-close")), "jaccard-facing")
            new = staged(links_among(near, segments(docs, near, repeated, seed, put)), "jaccard-links")
        links = new if links is None else links.unionByName(new)
        done = pairs.select("a", "b") if done is None else done.unionByName(pairs.select("a", "b"))
        labels, turn = components(links), turn + 1
        if not star:
            break
        star = turn < STARS and not new.isEmpty()  # once stars find no more, what is left is compared in full
    return rows.join(labels, "id", "left").select("doc_id", "key1", "key2", "n_shingles", F.coalesce("root", "id").alias("root"))


def near_groups(docs: DataFrame) -> DataFrame:
    """The rows of `rooted` with component_id: the smallest doc_id that links reach, the own one included. A null doc_id links too,
    but is never the smallest unless all are null; so component_id names a component only where doc_ids are distinct, and root always."""
    marked = rooted(docs)
    least = marked.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return marked.join(least, "root", "left").select(
        "doc_id", "key1", "key2", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that stay: of each component the one with the smallest doc_id, a null one only if all are null,
    and of rows that share it the one with the smallest keys. Rows without n-grams all stay; of rows that repeat doc_id and text one stays.
    Only rows that may go or repeat are shuffled with their texts, chosen by a map of fixed size; columns of any name pass."""
    rows = rooted(docs).filter("root is not null").groupBy("root", "doc_id", "key1", "key2").agg(F.count("*").alias("copies"))
    rows = staged(rows, "jaccard-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key1", "key2")).alias("first")
    best = rows.groupBy("root").agg(first).select("first.key1", "first.key2", F.lit(True).alias("stays"))
    fate = rows.select("key1", "key2", "copies").join(best, ["key1", "key2"], "left").withColumn("stays", F.coalesce("stays", F.lit(False)))
    fate = staged(fate.filter("copies > 1 or not stays"), "jaccard-fate")  # of all other rows it is known that they stay
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_keys("doc_id", "text"))
    keyed = marked(keyed, F.col("key1"), fate.select("key1"), "open")
    total = rows.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") > max(1, total // HOT_SHARE)  # fewer than HOT_SHARE keys
    judged = keyed.filter("open").join(F.broadcast(fate.filter(hot)), ["key1", "key2"], "left")
    cold = judged.filter("copies is null").select("row", "key1", "key2").join(fate.filter(~hot), ["key1", "key2"], "left")
    left = keyed.filter("not open").select("row").unionByName(cold.filter("copies is null").select("row"))
    again = fate.filter("copies > 1 and stays")
    if not again.isEmpty():
        some = judged.filter("stays").select("row", "key1", "key2").unionByName(cold.filter("stays").select("row", "key1", "key2"))
        left = left.unionByName(some.dropDuplicates(["key1", "key2"]).select("row"))
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
