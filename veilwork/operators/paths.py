"""Masking a file listing. The plan is the output table; nothing is renamed here.

A tree is one row per file or folder: (rel_old, kind, name, parent, depth), parent "" for the root.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilwork.config import MaskConfig
from veilwork.functions.names import MAX_PATH, ext_of, sanitize_name, stem_of
from veilwork.functions.text import fingerprint
from veilwork.operators.detect import detect, detections, path_name_filter
from veilwork.operators.policy import grade
from veilwork.operators.tokens import allocate_tokens, number_rows, reserved_numbers, scan_tokens, skip_reserved
from veilwork.session import lookup_join, stage

# Fixed value: folder of files nobody confirmed; it keeps its names.
SKIPPED_DIR = "skipped_unmasked"


def tree_entries(listing: DataFrame, path: str = "path") -> DataFrame:
    """Every file and every ancestor folder of a listing of relative file paths."""
    parts = F.split(F.col(path), "/")
    rows = (listing.filter(~(F.col(path) == SKIPPED_DIR) & ~F.col(path).startswith(SKIPPED_DIR + "/"))
            .select(parts.alias("p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth")))
    named = rows.select(
        F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/").alias("rel_old"),
        F.when(F.col("depth") == F.size("p"), "file").otherwise("dir").alias("kind"),
        F.element_at("p", F.col("depth")).alias("name"),
        F.array_join(F.slice("p", F.lit(1), F.col("depth") - 1), "/").alias("parent"), "depth")
    # Folders repeat once per file below them; the aggregate folds them map-side.
    return named.distinct()


def ancestor_names(listing: DataFrame, path: str = "path") -> DataFrame:
    """Distinct names to check: the stem of every file and the name of every folder above it."""
    e = tree_entries(listing, path)
    text = F.when(F.col("kind") == "file", stem_of(F.col("name"))).otherwise(F.col("name"))
    return e.select("kind", text.alias("text")).distinct()


def name_units(names: DataFrame) -> DataFrame:
    """Names as text units; (kind, name) is the key, carried in `file`."""
    stem = F.when(F.col("kind") == "file", stem_of(F.col("name"))).otherwise(F.col("name"))
    return names.select(
        F.concat_ws("/", "kind", "name").alias("file"), F.lit(0).cast("long").alias("file_ord"),
        F.lit(0).cast("long").alias("unit_ord"), sanitize_name(stem, reserved_ok=True).alias("text"))


def detect_names(names: DataFrame, cfg: MaskConfig, lexicon: DataFrame | None = None, tagger=None) -> DataFrame:
    """Graded detections (source path) on distinct (kind, name) rows."""
    rows = detections(detect(name_units(names), cfg, lexicon, tagger))
    return grade(path_name_filter(rows, ("file",)), cfg.mode, cfg.thresholds)


def detect_paths(listing: DataFrame, cfg: MaskConfig, lexicon: DataFrame | None = None) -> DataFrame:
    """Detections on file stems and on the names of all folders above them."""
    names = tree_entries(listing).select("kind", "name").distinct()
    return detect_names(names, cfg, lexicon)


def name_tokens(entries: DataFrame, found: DataFrame, known: DataFrame | None = None,
                reserved: DataFrame | None = None) -> DataFrame:
    """(original, token) for texts in names: those of the content mapping first, then new ones
    numbered in tree order (folder by folder, folders before files)."""
    keyed = entries.select(F.concat_ws("/", "kind", "name").alias("file"), "parent",
                           F.when(F.col("kind") == "dir", 0).otherwise(1).alias("kind_rank"), "name")
    place = keyed.groupBy("file").agg(F.min(F.struct("parent", "kind_rank", "name")).alias("p"))
    uses = found.join(place, "file").withColumn("longer", -F.length("text"))
    first = (uses.groupBy(F.col("text").alias("original"))
             .agg(F.min(F.struct("p.parent", "p.kind_rank", "p.name", "longer", "pos", F.col("text_type").alias("type"))).alias("m"))
             .select("original", "m.*"))
    if known is not None:
        first = first.join(known.select("original").distinct(), "original", "left_anti")
    fresh = allocate_tokens(stage(first), reserved, ("parent", "kind_rank", "name", "longer", "pos")).select("original", "token")
    return fresh if known is None else fresh.unionByName(known.select("original", "token"))


def mask_names(names: DataFrame, found: DataFrame, tokens: DataFrame | None, irreversible: bool = False) -> DataFrame:
    """(kind, name, new_name, categories, tokens_used): longest text first, then sanitised.

    `found` holds only the detections to replace. Names without any are left out.
    """
    rows = found.select("file", "text", "text_type", "channel_ord", "rule_ord", "pos")
    rows = rows.withColumn("token", F.lit("***")) if irreversible else rows.join(
        tokens.select(F.col("original").alias("text"), "token"), "text")
    per_name = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(
        (-F.length("text")).alias("longer"), "channel_ord", "rule_ord", "pos", "text", "token", "text_type"))).alias("h"))
    keyed = names.select("kind", "name", F.concat_ws("/", "kind", "name").alias("file"))
    stem = F.when(F.col("kind") == "file", stem_of(F.col("name"))).otherwise(F.col("name"))
    ext = F.when(F.col("kind") == "file", ext_of(F.col("name"))).otherwise(F.lit(""))
    clean = sanitize_name(stem, reserved_ok=True)
    masked = F.aggregate("h", clean, lambda t, h: F.replace(t, h["text"], h["token"]))
    # Detection order, not length order, decides how categories and tokens are listed.
    listed = F.array_sort(F.transform("h", lambda h: F.struct(h["channel_ord"], h["rule_ord"], h["pos"], h["text"], h["token"], h["text_type"])))
    there = F.filter(listed, lambda h: F.contains(F.col("name"), h["text"]))
    used = F.array().cast("array<string>") if irreversible else F.array_distinct(F.transform(there, lambda h: h["token"]))
    return (keyed.join(per_name, "file")
            .select("kind", "name", sanitize_name(F.concat(masked, ext)).alias("new_name"),
                    F.array_distinct(F.transform(listed, lambda h: h["text_type"])).alias("categories"), used.alias("tokens_used")))


# ---- name conflicts ---------------------------------------------------------------------

COUNTED = r"(?s)^(.+)_([1-9][0-9]{0,17})$"


def _queue(parent: Column, low: Column) -> Column:
    """Rows that want the same name in the same folder queue for it."""
    return F.concat_ws("\u0000", parent, low).alias("type")


def _counted(low: Column) -> tuple[Column, Column]:
    """A name `stem_n.ext` read as the n-th counter of `stem.ext`: (that name, n or null)."""
    stem = stem_of(low)
    return F.concat(F.regexp_extract(stem, COUNTED, 1), ext_of(low)), F.expr("try_cast(_n as bigint)")


def _with_counter(df: DataFrame) -> DataFrame:
    base, n = _counted(F.col("_low"))
    return (df.withColumn("_n", F.regexp_extract(stem_of(F.col("_low")), COUNTED, 2)).withColumn("_base", base)
            .withColumn("_n", n))


def _count_before(rows: DataFrame, marks: DataFrame, order: list[str], out: str, limit: int) -> DataFrame:
    """Add to each mark the number of `rows` of its type that sort before it."""
    both = (rows.select("type", *order, F.lit(0).alias("_mark"), F.lit(None).cast("string").alias("_child"))
            .unionByName(marks.select("type", *order, F.lit(1).alias("_mark"), F.col("child").alias("_child"))))
    placed = number_rows(stage(both), "type", [*order, "_mark"], "_p", limit).filter("_mark = 1")
    earlier = F.row_number().over(W.partitionBy("type").orderBy(*order))  # one row per distinct wanted name
    return marks.join(placed.select(F.col("_child").alias("child"), (F.col("_p") - earlier).alias(out)), "child")


def _settle(links: DataFrame, occupied: DataFrame, limit: int) -> DataFrame:
    """Who takes a name that is both a counter of one queue and the plain name of another.

    The owner's j-th row would take counter k, with j = 1 + the counters below k that are still
    free. If j of its rows come before the other queue's first row, the owner has the name;
    else the other queue has it, and the owner skips that counter.
    """
    at = _count_before(occupied, links.withColumn("number", F.col("k") + 1), ["number"], "below", limit)
    known = at.join(occupied.select("type", F.col("number"), F.lit(True).alias("_held")), ["type", "number"], "left")
    per_owner = known.groupBy("type").agg(F.array_sort(F.collect_list(F.struct(
        "k", "below", "ahead", F.coalesce("_held", F.lit(False)).alias("held"), "child"))).alias("c"))

    def walk(acc, x):
        owner_first = x["k"] - x["below"] - F.size(acc) + 1 <= x["ahead"]
        return F.when(x["held"] | owner_first, acc).otherwise(F.concat(acc, F.array(F.struct(x["k"].alias("k"), x["child"].alias("child")))))
    empty = F.array().cast("array<struct<k:bigint,child:string>>")
    decided = per_owner.withColumn("won", F.aggregate("c", empty, walk))
    won = decided.select("type", F.explode("won").alias("w")).select("type", (F.col("w.k") + 1).alias("number"))
    lost = decided.select(F.explode(F.filter("c", lambda x: ~x["held"] & ~F.exists("won", lambda w: w["child"] == x["child"]))).alias("x"))
    return won.unionByName(lost.select(F.col("x.child").alias("type"), F.lit(1).cast("long").alias("number")))


def resolve_name_conflicts(wanted: DataFrame, existing: DataFrame, order: list[str], limit: int = 1_000_000) -> DataFrame:
    """Add `final`: the wanted name, or its first free `_1`, `_2`... in its folder.

    `wanted` has (parent, desired, *order), `existing` has (parent, name); comparison ignores
    case and `order` is unique in a folder. Rows that want one name form a queue: the k-th of
    them gets the k-th free counter, the same closed form as for placeholder numbers, so a
    queue may be of any size. Two queues only meet where one wants a name that is a counter of the
    other (`a_1` beside `a`); those single names are settled first, owner by owner.
    """
    w = stage(wanted.withColumn("_low", F.lower("desired")).withColumn("type", _queue(F.col("parent"), F.col("_low"))))
    queues = stage(_with_counter(w.groupBy("type", "parent", F.col("_low")).agg(F.min(F.struct(*order)).alias("_first"))))
    taken = _with_counter(existing.select("parent", F.lower("name").alias("_low")).distinct())
    names = queues.select("type")
    plain = taken.select(_queue(F.col("parent"), F.col("_low")), F.lit(1).cast("long").alias("number"))
    counted = taken.filter("_n is not null").select(_queue(F.col("parent"), F.col("_base")), (F.col("_n") + 1).alias("number"))
    # Counter 0 is the plain name, so occupied counters are shifted by one.
    occupied = stage(plain.unionByName(counted).join(names, "type", "left_semi").distinct())

    links = (queues.filter("_n is not null").select(_queue(F.col("parent"), F.col("_base")), F.col("type").alias("child"), F.col("_n").alias("k"), "_first.*")
             .join(names, "type", "left_semi"))
    links = stage(_count_before(w, links, order, "ahead", limit))
    while not links.isEmpty():  # one turn per level of nested counters
        inner = links.select(F.col("child").alias("type")).distinct()
        settled = _settle(links.join(inner, "type", "left_anti"), occupied, limit)
        occupied = stage(occupied.unionByName(settled).distinct())
        links = stage(links.join(inner, "type", "left_semi"))

    placed = skip_reserved(number_rows(w, "type", order, limit=limit), occupied)
    stem, suffix = stem_of(F.col("desired")), ext_of(F.col("desired"))
    final = F.when(F.col("number") == 1, F.col("desired")).otherwise(F.concat(stem, F.lit("_"), (F.col("number") - 1).cast("string"), suffix))
    return placed.withColumn("final", final).select(*wanted.columns, "final")


# ---- plans ------------------------------------------------------------------------------

def plan_tree(listing: DataFrame, cfg: MaskConfig, lexicon: DataFrame | None = None, known: DataFrame | None = None,
              root: str = "") -> DataFrame:
    """path_mapping rows for every renamed or skipped entry of a listing. New tokens use no number that a token of `known`
    (original, token) or a name of the listing already has."""
    entries = stage(tree_entries(listing))
    names = entries.select("kind", "name").distinct()
    found = stage(detect_names(names, cfg, lexicon).filter(F.col("status").isin(*cfg.statuses)))
    taken = scan_tokens(entries, "name") if known is None else scan_tokens(entries, "name").union(known.select("token"))
    tokens = None if cfg.irreversible else name_tokens(entries, found, known, reserved_numbers(taken))
    renamed = mask_names(names, found, tokens, cfg.irreversible)
    # A name may recur in very many folders, so its rows are not sent to one task.
    recurring = entries.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("uses"))
    dim = stage(renamed.join(recurring, ["kind", "name"]).select(
        F.concat_ws("/", "kind", "name").alias("file"), "new_name", "categories", "tokens_used", "uses"))
    keyed = entries.withColumn("file", F.concat_ws("/", "kind", "name"))
    changed = (lookup_join(keyed, dim, "file", "uses", dim.count()).drop("file").filter(F.col("new_name") != F.col("name"))
               .withColumn("kind_rank", F.when(F.col("kind") == "dir", 0).otherwise(1)).withColumnRenamed("new_name", "desired"))
    final = stage(resolve_name_conflicts(changed, entries.select("parent", "name"), ["kind_rank", "name"]))

    # New path: the final name of every component, taken from the plan or kept.
    parts = F.split("rel_old", "/")
    steps = final.select("rel_old", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("i"))
    prefix = F.array_join(F.slice(F.split("rel_old", "/"), F.lit(1), F.col("i")), "/")
    steps = steps.withColumn("prefix", prefix)
    uses = steps.groupBy("prefix").agg(F.count(F.lit(1)).alias("uses"))
    dim = (uses.join(final.select(F.col("rel_old").alias("prefix"), "final"), "prefix", "left")
           .select("prefix", F.coalesce("final", F.element_at(F.split("prefix", "/"), -1)).alias("component"), "uses"))
    dim = stage(dim)
    new_path = (lookup_join(steps, dim, "prefix", "uses", dim.count()).groupBy("rel_old")
                .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "component"))), lambda x: x["component"]), "/").alias("rel_new")))
    return finish_plan(final.join(new_path, "rel_old"), root)


def too_long(parent: Column, final: Column, root: str = "") -> Column:
    lead = F.length(F.lit(root)) + (F.lit(1) if root else F.lit(0))
    inner = F.when(parent == "", 0).otherwise(F.length(parent) + 1)
    return lead + inner + F.length(final) > MAX_PATH


def finish_plan(plan: DataFrame, root: str = "") -> DataFrame:
    """path_mapping columns: skipped rows keep their names; every row gets its fingerprint."""
    skip = too_long(F.col("parent"), F.col("final"), root)
    status = F.when(skip, "skipped").when(F.col("final") != F.col("desired"), "conflict_suffixed").otherwise("renamed")
    out = plan.select(
        "kind", F.col("name").alias("old_name"), F.when(skip, F.col("name")).otherwise(F.col("final")).alias("new_name"),
        "rel_old", F.when(skip, F.col("rel_old")).otherwise(F.col("rel_new")).alias("rel_new"), "depth",
        "categories", "tokens_used", status.alias("status"), F.when(skip, "too_long").otherwise("").alias("note"))
    return out.withColumn("fingerprint", fingerprint(F.concat_ws("|", "rel_old", "new_name"), 12))


def unmask_paths(listing: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(restored, missing). Restored rows carry `restored_name`, suffixed if the name was taken."""
    tree = tree_entries(listing)
    active = paths.filter(F.col("status").isin("renamed", "conflict_suffixed"))
    here = tree.select(F.col("rel_old").alias("rel_new")).distinct()
    missing = active.join(here, "rel_new", "left_anti")
    present = active.join(here, "rel_new", "left_semi").withColumn(
        "parent", F.regexp_replace("rel_new", "/?[^/]+$", "")).withColumn("desired", F.col("old_name"))
    named = resolve_name_conflicts(present, tree.select("parent", "name"), ["rel_new"])
    return named.withColumnRenamed("final", "restored_name").drop("desired", "parent"), missing


def expected_paths(actual: DataFrame, paths: DataFrame) -> DataFrame:
    """(rel, expected): the deepest renamed ancestor of each path, mapped back."""
    parts = F.split("rel", "/")
    steps = (actual.select("rel", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("i"))
             .withColumn("rel_new", F.array_join(F.slice(F.split("rel", "/"), F.lit(1), F.col("i")), "/")))
    active = paths.filter(F.col("status").isin("renamed", "conflict_suffixed")).select("rel_new", "rel_old")
    uses = steps.groupBy("rel_new").agg(F.count(F.lit(1)).alias("uses"))
    dim = stage(active.groupBy("rel_new").agg(F.min("rel_old").alias("rel_old")).join(uses, "rel_new"))
    best = (lookup_join(steps, dim, "rel_new", "uses", dim.count()).groupBy("rel").agg(F.max(F.struct("i", "rel_new", "rel_old")).alias("m"))
            .select("rel", F.col("m.rel_new").alias("rel_new"), F.col("m.rel_old").alias("rel_old")))
    tail = F.substring(F.col("rel"), F.length("rel_new") + 1, F.length("rel"))
    return (actual.select("rel").distinct().join(best, "rel", "left")
            .select("rel", F.coalesce(F.concat("rel_old", tail), "rel").alias("expected")))


def diff_tree(actual: DataFrame, paths: DataFrame) -> DataFrame:
    """(side, rel): `extra` paths that should not be there, `missing` ones that should."""
    both = expected_paths(actual, paths)
    have = both.select("rel").distinct()
    want = both.select(F.col("expected").alias("rel")).distinct()
    return (have.join(want, "rel", "left_anti").select(F.lit("extra").alias("side"), "rel")
            .unionByName(want.join(have, "rel", "left_anti").select(F.lit("missing").alias("side"), "rel")))


def quarantine(files: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Add `disposition`: files with nothing confirmed go to the skipped area."""
    hit = confirmed.select("file", F.lit(True).alias("_hit")).distinct()
    return (files.join(hit, "file", "left")
            .withColumn("disposition", F.when(F.col("_hit"), "masked").otherwise(SKIPPED_DIR)).drop("_hit"))
