"""Tables as text units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions.text import is_blank


def units_from_table(df: DataFrame, file: Column, file_ord: Column, unit_ord: Column, text: Column,
                     part: str = "", kind: str = "text") -> DataFrame:
    """Project any keyed text column into text units; blank text is skipped.

    (file_ord, unit_ord) must be unique: it is the reading order that token numbers follow.
    """
    return df.select(
        file.cast("string").alias("file"), file_ord.cast("long").alias("file_ord"),
        unit_ord.cast("long").alias("unit_ord"), F.lit(part).alias("part"), F.lit(kind).alias("kind"),
        text.alias("text")).filter(~is_blank(F.col("text")))
