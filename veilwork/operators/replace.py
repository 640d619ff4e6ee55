"""From graded hits to masked text and the mapping that undoes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilwork.config import MaskConfig
from veilwork.functions.rules import let
from veilwork.functions.spans import locate, rebuild, resolve
from veilwork.functions.text import fingerprint, fuzzy_amount
from veilwork.operators.policy import status
from veilwork.schema import UNIT_KEY
from veilwork.session import lookup_join

FIXED_MASK = "***"


def actionable_hits(hits: Column, cfg: MaskConfig) -> Column:
    """Hits whose status under the run's mode is to be replaced."""
    return F.filter(hits, lambda h: status(h["confidence"], cfg.mode, cfg.thresholds).isin(*cfg.statuses))


def resolution(text: Column, hits: Column, cfg: MaskConfig) -> Column:
    """struct(kept, dropped) of the spans to replace; null if there are none."""
    return let(actionable_hits(hits, cfg), lambda act: F.when(F.size(act) > 0, resolve(locate(text, act))))


def resolved_units(detected: DataFrame, cfg: MaskConfig) -> DataFrame:
    """Units that have something to replace, with `kept` and `dropped` spans.

    An outer explode of zero or one result selects the units: a filter on the hits would be
    pushed below the projection and detect everything a second time.
    """
    some = F.array_compact(F.array(resolution(F.col("text"), F.col("hits"), cfg)))
    return (detected.select(*UNIT_KEY, "text", F.explode_outer(some).alias("r")).filter("r is not null")
            .select(*UNIT_KEY, "text", "r.kept", "r.dropped"))


def dropped_overlaps(resolved: DataFrame) -> DataFrame:
    """Spans lost to a better overlapping one."""
    return resolved.select(*UNIT_KEY, F.explode("dropped").alias("s")).select(*UNIT_KEY, "s.*")


def plain_replacement(span: Column, cfg: MaskConfig) -> Column | None:
    """Replacement that needs no token; null where a token is due. None if no span can do without."""
    if cfg.irreversible:
        return F.lit(FIXED_MASK)
    if cfg.amount_mode == "token":
        return None
    value = fuzzy_amount(span["text"]) if cfg.amount_mode == "fuzzy" else F.lit(FIXED_MASK)
    return F.when(span["type"] == "amount", value)


def needs_token(span: Column, cfg: MaskConfig) -> Column:
    if cfg.irreversible:
        return F.lit(False)
    return F.lit(True) if cfg.amount_mode == "token" else span["type"] != "amount"


def token_spans(resolved: DataFrame, cfg: MaskConfig) -> DataFrame:
    """Kept spans that get a token, one row each, without the unit's text."""
    wanted = F.filter("kept", lambda s: needs_token(s, cfg))
    return resolved.select(*UNIT_KEY, F.explode_outer(wanted).alias("s")).filter("s is not null").select(*UNIT_KEY, "s.*")


def build_replacements(resolved: DataFrame, allocation: DataFrame, cfg: MaskConfig) -> DataFrame:
    """One row per kept span with its new text. `allocation` has (original, token, uses)."""
    cols = [*UNIT_KEY, "start", "end", "text", "type", "source", "confidence", "token", "new_text"]
    rows = (resolved.select(*UNIT_KEY, F.explode_outer("kept").alias("s")).filter("s is not null").select(*UNIT_KEY, "s.*"))
    span = F.struct("text", "type")
    minted = rows.filter(needs_token(span, cfg)).withColumn("original", F.col("text"))
    dim = allocation.select("original", "token", "uses")
    tokens = lookup_join(minted, dim, "original", "uses", dim.count()).withColumn("new_text", F.col("token")).select(*cols)
    plain = plain_replacement(span, cfg)
    if plain is None:
        return tokens
    rest = (rows.filter(~needs_token(span, cfg)).withColumn("token", F.lit(None).cast("string")).withColumn("new_text", plain))
    return tokens.unionByName(rest.select(*cols))


def apply_plain(detected: DataFrame, cfg: MaskConfig) -> DataFrame:
    """Mask without tokens: a pure projection, fit for streams. Needs a config that mints none."""
    hits = actionable_hits(F.col("hits"), cfg)
    kept = resolve(locate(F.col("text"), hits))["kept"]
    masked = rebuild(F.col("text"), F.col("_kept"),
                     lambda s: F.coalesce(plain_replacement(s, cfg), s["text"]))
    # Only units with a hit pay for the span work.
    some = F.when(F.size(hits) > 0, kept)
    return (detected.withColumn("_kept", some)
            .withColumn("masked_text", F.when(F.col("_kept").isNotNull(), masked).otherwise(F.col("text")))
            .drop("_kept"))


def register_mapping(allocated: DataFrame, batch_id: str, created_at: Column, kind: str = "text") -> DataFrame:
    """Mapping rows: what a token stands for, how it was found, and a fingerprint to verify it."""
    return allocated.select(
        "token", "original", "type", "confidence", created_at.cast("timestamp").alias("created_at"),
        F.lit(batch_id).alias("batch_id"), fingerprint(F.col("original")).alias("fingerprint"),
        F.lit(kind).alias("kind"))


def run_rewrite(runs: DataFrame, masked: DataFrame, paragraph: list[str], run_ord: str) -> DataFrame:
    """Put a paragraph's masked text into its first run and empty the others; keep every run."""
    first = F.row_number().over(W.partitionBy(*paragraph).orderBy(run_ord)) == 1
    return (runs.join(masked.select(*paragraph, "masked_text"), paragraph)
            .withColumn("new_text", F.when(first, F.col("masked_text")).otherwise(F.lit("")))
            .drop("masked_text"))


# Identity properties of a document, and the neutral author of a sheet comment.
IDENTITY_COLUMNS = ("author", "last_modified_by", "comments", "subject", "keywords", "category",
                    "content_status", "identifier", "language", "version", "title")
NEUTRAL_AUTHOR = "匿名"


def clear_identity_columns(df: DataFrame, columns=IDENTITY_COLUMNS, value: str = "") -> DataFrame:
    """Blank author-like columns one way; they never enter the mapping."""
    return df.withColumns({c: F.lit(value) for c in columns if c in df.columns})
