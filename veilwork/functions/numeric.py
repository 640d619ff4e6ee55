"""Numbers in cells: canonical text and the rules that call a number sensitive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions.rules import let

# Fixed value: marks that make a number format a currency format.
CURRENCY = "[¥￥$€£]"


def _plain(v: Column) -> Column:
    """Expand a number's shortest text (`1.25E7`) to plain digits."""
    sign = F.when(v.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    mantissa = F.regexp_extract(v, r"([0-9.]+)E", 1)
    exponent = F.regexp_extract(v, r"E(-?[0-9]+)$", 1).cast("int")

    def expand(p):
        d, e = p["digits"], p["exponent"]
        whole = F.substring(F.rpad(d, F.greatest(e + 1, F.lit(1)), "0"), F.lit(1), e + 1)
        rest = F.substring(d, e + 2, F.length(d))
        # From 1e16 on a float's shortest form is an integer; below, one decimal stays.
        tail = F.when(rest != "", F.concat(F.lit("."), rest)).when(e < 16, F.lit(".0")).otherwise(F.lit(""))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)
        return F.concat(p["sign"], F.when(e >= 0, F.concat(whole, tail)).otherwise(small))
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "(?<=[0-9])0+$", "")
    return let(F.struct(sign.alias("sign"), digits.alias("digits"), exponent.alias("exponent")), expand)


def numeric_canonical(c: Column) -> Column:
    """Plain decimal text of a number: shortest round-trip form, no exponent; null for NaN and infinities."""
    return let(c.cast("string"), lambda v: F.when(v.contains("E"), _plain(v)).when(~v.isin("NaN", "Infinity", "-Infinity"), v))


def is_currency_format(fmt: Column) -> Column:
    return F.coalesce(fmt.rlike(CURRENCY), F.lit(False))


def luhn_ok(digits: Column) -> Column:
    return F.when(digits.rlike("^[0-9]+$"), F.call_function("luhn_check", digits)).otherwise(False)


def numeric_rule(canon: Column, fmt: Column) -> Column:
    """struct(type, confidence) of the rule that fires, or null.

    A currency format decides alone; else long integers are cards, middling ones amounts, and
    large non-integers weak amounts.
    """
    def rule(type_, confidence):
        return F.struct(F.lit(type_).alias("type"), F.lit(confidence).alias("confidence"))

    def decide(n):
        c, digits = n["canon"], n["digits"]
        integer = ~F.contains(c, F.lit("."))
        return (F.when(n["money"], F.when(F.abs(c.cast("double")) >= 10000, rule("amount", 0.85)))
                .when(integer & F.length(digits).between(16, 19),
                      F.when(luhn_ok(digits), rule("custom", 0.85)).otherwise(rule("custom", 0.65)))
                .when(integer & F.length(digits).between(9, 15), rule("amount", 0.70))
                .when(~integer & (F.length(F.substring_index(digits, ".", 1)) >= 6), rule("amount", 0.60)))
    parts = F.struct(canon.alias("canon"), F.regexp_replace(canon, "^-+", "").alias("digits"), is_currency_format(fmt).alias("money"))
    return let(parts, decide)
