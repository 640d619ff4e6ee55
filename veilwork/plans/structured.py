"""Masking and restoring inside formulas and quoted lists: only literals and items change, the structure around them stays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.config import MaskConfig
from veilwork.operators.cells import list_item_units, literal_units, rebuild_list, rebuild_literals
from veilwork.operators.restore import unmask
from veilwork.plans.mask import MaskRun, mask_units
from veilwork.schema import UNIT_KEY
from veilwork.sources.units import units_from_table
from veilwork.session import stage

# What a cell's parts are, and how they are put back.
PARTS = {"literals": (literal_units, rebuild_literals), "list": (list_item_units, rebuild_list)}
CELL = "_cell"


def _children(cells: DataFrame, col: str, key: Sequence[str], order: str, parts: str) -> tuple[DataFrame, DataFrame]:
    """(cells named by CELL, text units of their parts). A unit's `file` is the path back to its cell, `unit_ord` its place in it."""
    named = stage(cells.withColumn(CELL, F.to_json(F.struct(*key))))
    found = PARTS[parts][0](named, col, [CELL, order])
    return named, units_from_table(found, F.col(CELL), F.col(order), F.col("child_ord"), F.col("text"))


def _put_back(named: DataFrame, units: DataFrame, new_text: str, col: str, parts: str) -> DataFrame:
    done = units.select(F.col("file").alias(CELL), F.col("unit_ord").cast("int").alias("child_ord"), F.col(new_text).alias("new_text"))
    return PARTS[parts][1](named, done, col, [CELL]).drop(CELL)


def mask_parts(cells: DataFrame, col: str, key: Sequence[str], order: str, parts: str, cfg: MaskConfig = MaskConfig(), **options) -> tuple[DataFrame, MaskRun]:
    """(`cells` with `new_<col>`, the run): every quoted literal of a formula (`parts` = literals) or item of a quoted list (list) is
    a text unit of one masking run, and goes back to its place, quotes doubled again.

    `key` names a cell, `order` is a whole number that puts cells in reading order. Cells without parts, null ones among them, stay as
    they are. `options` go to `mask_units`.
    """
    named, units = _children(cells, col, key, order, parts)
    run = mask_units(units, cfg, **options)
    changed = run.masked.filter("masked_text <> text").select(*UNIT_KEY, "masked_text")
    return _put_back(named, changed, "masked_text", col, parts), run


def restore_parts(cells: DataFrame, col: str, key: Sequence[str], order: str, parts: str, mapping: DataFrame) -> DataFrame:
    """`cells` with `new_<col>`: the originals back in their literals or items."""
    named, units = _children(cells, col, key, order, parts)
    back = unmask(units, mapping).filter("restored <> text").select(*UNIT_KEY, "restored")
    return _put_back(named, back, "restored", col, parts)


def mask_quoted_literals(cells: DataFrame, col: str, key: Sequence[str], order: str, cfg: MaskConfig = MaskConfig(), **options) -> tuple[DataFrame, MaskRun]:
    return mask_parts(cells, col, key, order, "literals", cfg, **options)


def mask_list_items(cells: DataFrame, col: str, key: Sequence[str], order: str, cfg: MaskConfig = MaskConfig(), **options) -> tuple[DataFrame, MaskRun]:
    return mask_parts(cells, col, key, order, "list", cfg, **options)
