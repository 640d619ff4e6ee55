"""Small text functions."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.functions.rules import DIGIT, SPACE

# Full-width ASCII letters and digits and their half-width forms.
FULL_WIDTH = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
HALF_WIDTH = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def trim_ws(c: Column) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(f"(?s){SPACE.replace('[', '[^', 1)}")


def normalize_text(c: Column) -> Column:
    """Half-width ASCII, single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.translate(c, FULL_WIDTH, HALF_WIDTH), f"{SPACE}+", " "))


def fuzzy_amount(c: Column) -> Column:
    """Truncate an amount that ends in 元: `1.2亿元` -> `1亿+`. Other shapes stay as they are."""
    def whole(digits: str) -> str:
        return rf"0*({digits})"
    yi = F.regexp_replace(c, whole(rf"{DIGIT}+") + rf"\.?{DIGIT}*亿元", "$1亿+")
    wan = F.regexp_replace(yi, whole(rf"{DIGIT}+") + rf"\.?{DIGIT}*万元", "$1万+")
    plain = rf"({DIGIT}[{DIGIT},]*)\.?{DIGIT}*元"
    # A comma-grouped number loses its commas; only the matched number is touched.
    numbers = F.regexp_extract_all(wan, F.lit(plain), F.lit(1))
    gaps = F.split(wan, plain, -1)
    rebuilt = F.concat(
        F.array_join(F.transform(numbers, lambda n, i: F.concat(
            gaps[i], F.regexp_replace(F.regexp_replace(n, ",", ""), r"^0+(?=\p{Nd})", ""), F.lit("元+"))), ""),
        F.element_at(gaps, -1))
    return F.when(wan.rlike(plain), rebuilt).otherwise(wan)


def quote_literal(c: Column) -> Column:
    """Regex that matches the string literally, whatever it contains."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Strip and compatibility-normalise; Spark has no built-in for NFKC."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t.strip()))


@F.pandas_udf(T.StringType())
def unescape_entities(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else html.unescape(t))


def markup_plaintext(c: Column) -> Column:
    """Drop tags first, then decode entities, so words split by tags become visible."""
    return unescape_entities(F.regexp_replace(c, "<[^>]*>", ""))


@F.pandas_udf(T.StringType())
def decode_bytes(s: pd.Series) -> pd.Series:
    """UTF-8 if it is valid, else GB18030 with replacement characters."""
    def one(raw):
        if raw is None:
            return None
        try:
            return bytes(raw).decode("utf-8")
        except UnicodeDecodeError:
            return bytes(raw).decode("gb18030", errors="replace")
    return s.map(one)


def parse_manual_words(c: Column) -> Column:
    """User words separated by line breaks, ASCII or full-width commas; ordered and distinct."""
    words = F.transform(F.split(c, "[\n,，]+"), trim_ws)
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def fingerprint(c: Column, length: int = 8) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)
