"""File and folder names as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and names a file system refuses, and the longest usable path.
ILLEGAL = r'[<>:"/\\|?*\x00-\x1f]'
RESERVED = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))
MAX_PATH = 259
EXT = r"(?s)^(.+)(\.[^.]+)$"
# Extensions that are processed, and one that is known but refused.
DOC_EXTS = (".docx", ".xlsx", ".xlsm", ".pdf", ".doc", ".xls")
BLOCKED_EXTS = (".pptx",)


def ext_of(name: Column) -> Column:
    """From the last dot on, unless that dot starts or ends the name."""
    return F.regexp_extract(name, EXT, 2)


def stem_of(name: Column) -> Column:
    return F.when(name.rlike(EXT), F.regexp_extract(name, EXT, 1)).otherwise(name)


def sanitize_name(name: Column, reserved_ok: bool = False) -> Column:
    """A name the file system will create exactly as asked."""
    clean = F.regexp_replace(name, ILLEGAL, "_")
    trimmed = F.concat(F.regexp_replace(stem_of(clean), "[ .]+$", ""), ext_of(clean))
    if not reserved_ok:
        stem, ext = stem_of(trimmed), ext_of(trimmed)
        trimmed = F.when(F.lower(stem).isin(*RESERVED), F.concat(stem, F.lit("_"), ext)).otherwise(trimmed)
    return F.when(trimmed == "", F.lit("_masked")).otherwise(trimmed)


def file_class(path: Column) -> Column:
    """docs, blocked or other, by lower-cased extension."""
    ext = F.lower(ext_of(F.element_at(F.split(path, "/"), -1)))
    return F.when(ext.isin(*DOC_EXTS), "docs").when(ext.isin(*BLOCKED_EXTS), "blocked").otherwise("other")


def file_key(path: Column, root: str = "") -> Column:
    """Path below an archive root, else the base name."""
    base = F.element_at(F.split(path, "/"), -1)
    if not root:
        return base
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(base)
