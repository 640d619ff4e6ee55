"""Grading of detections and the choice of which ones are replaced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.config import Thresholds
from veilwork.schema import AUTO, HINT, SUGGEST


def status(confidence: Column, mode: str, thresholds: Thresholds = Thresholds()) -> Column:
    """Status of a detection; an unknown mode only hints."""
    # Fixed values: (auto, suggest) cut-offs of each mode; focused never suggests.
    cuts = {
        "focused": (0.95, None),
        "strict": (0.95, 0.85),
        "smart": (thresholds.auto_mask, thresholds.suggest_mask),
        "aggressive": (0.70, 0.45),
    }
    if mode not in cuts:
        return F.lit(HINT)
    auto, suggest = cuts[mode]
    out = F.when(confidence >= auto, F.lit(AUTO))
    if suggest is not None:
        out = out.when(confidence >= suggest, F.lit(SUGGEST))
    return out.otherwise(F.lit(HINT))


def grade(rows: DataFrame, mode: str, thresholds: Thresholds = Thresholds()) -> DataFrame:
    return rows.withColumn("status", status(F.col("confidence"), mode, thresholds))


def filter_actionable(rows: DataFrame, statuses: Sequence[str] = (AUTO,), allowed: DataFrame | None = None) -> DataFrame:
    """Rows to replace: the wanted statuses and, if given, only confirmed originals."""
    kept = rows.filter(F.col("status").isin(*statuses))
    return kept if allowed is None else kept.join(allowed.select("text").distinct(), "text", "left_semi")


def confirm_filtered(rows: DataFrame, allowed: DataFrame, statuses: Sequence[str] = (AUTO,)) -> DataFrame:
    """Automatic detections a confirmed set left out, for the audit log."""
    auto = rows.filter((F.col("status") == AUTO) & F.col("status").isin(*statuses))
    return auto.select("text", "source").distinct().join(allowed.select("text").distinct(), "text", "left_anti")
