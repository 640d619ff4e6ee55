"""The regular-expression channel as native Column expressions.

A rule yields one hit per distinct matched text of a unit, placed at the first match of that
text. Boundaries use explicit Unicode classes, so full-width digits and CJK neighbours behave as
they do for Unicode-aware matching.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.schema import CHANNELS, HITS_DDL

# Unicode decimal digit, word character and white space.
DIGIT = r"\p{Nd}"
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@dataclass(frozen=True)
class Rule:
    """One pattern with its entity type, confidence and the gate a text must pass first."""

    name: str
    pattern: str
    type: str
    confidence: float
    gate: str


# Patterns, types and confidences of the eight rules, in priority order.
# The e-mail pattern may only start where a run of address characters starts or where the last
# match ended; that finds the same matches without trying every character of a long word.
# Numbers before a unit are possessive: what they could give back is no unit.
RULES = (
    Rule("rmb_amount", rf"人民币{SPACE}*[{DIGIT},]+\.?{DIGIT}*[万亿]?元?", "amount", 0.90, "rmb"),
    Rule("generic_amount", rf"(?={DIGIT})(?<![{DIGIT}.]){DIGIT}[{DIGIT},]*+\.?+{DIGIT}*+[万亿]元?", "amount", 0.80, "unit"),
    Rule("mobile", rf"(?<!{DIGIT})(?:\+?86)?1[3-9]{DIGIT}{{9}}(?!{DIGIT})", "custom", 0.85, "digits"),
    Rule("id_number", rf"(?<!{DIGIT}){DIGIT}{{17}}[{DIGIT}Xx](?!{DIGIT})", "custom", 0.85, "digits"),
    Rule("email", rf"(?:(?<![\p{{L}}\p{{N}}_.-])|\G)[\p{{L}}\p{{N}}_.-]++@[\p{{L}}\p{{N}}_.-]+\.{WORD}+", "custom", 0.75, "at"),
    Rule("cn_date", rf"(?<!{DIGIT}){DIGIT}{{4}}年{DIGIT}{{1,2}}月{DIGIT}{{1,2}}日(?!{DIGIT})", "custom", 0.70, "year"),
    Rule("card", rf"(?<!{DIGIT}){DIGIT}{{16,19}}(?!{DIGIT})", "custom", 0.65, "digits"),
    Rule("separated_card", rf"(?<!{DIGIT}){DIGIT}{{4}}(?:[ -]{DIGIT}{{4}}){{3}}(?:[ -]{DIGIT}{{3}})?(?!{DIGIT})",
         "custom", 0.65, "groups"),
)
BY_NAME = {r.name: r for r in RULES}
# Whole runs of eleven and more digits with what the digit rules look at around them, and whole runs of address characters
# with the rest of an address, if there is one (only those hold an @).
LONG_RUN = rf"(?:{DIGIT}{{11}}|\+(?<!{DIGIT}\+){DIGIT}{{11}}){DIGIT}*+(?:[Xx](?!{DIGIT}))?"
ADDRESS_RUN = rf"[\p{{L}}\p{{N}}_.-]++(?:@[\p{{L}}\p{{N}}_.-]+\.{WORD}+)?+"


def gates(text: Column) -> dict[str, Column]:
    """The text that the rules of a gate are tried on, null if they cannot match. Most texts fail most of them.

    The digit rules match inside long runs of digits only: these are cut out once, and the rules search what is left.
    """
    runs = F.array_join(F.regexp_extract_all(text, F.lit(LONG_RUN), F.lit(0)), " ")
    return {
        "rmb": F.when(F.contains(text, F.lit("人民币")), text),
        "unit": F.when(F.contains(text, F.lit("万")) | F.contains(text, F.lit("亿")), text),
        "digits": F.nullif(runs, F.lit("")),
        "at": F.when(F.contains(text, F.lit("@")), text),
        "year": F.when(F.contains(text, F.lit("年")), text),
        "groups": text,
    }


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body` as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def _hit(rule: Rule, text: Column, pos: Column) -> Column:
    return F.struct(
        text.alias("text"), F.lit(rule.type).alias("type"), F.lit("regex").alias("source"),
        F.lit(rule.confidence).alias("confidence"), F.lit(CHANNELS["regex"]).alias("channel"),
        F.lit(RULES.index(rule)).cast("long").alias("rule"), pos.cast("int").alias("pos"))


def matches(searched: Column, rule: Rule) -> Column:
    """All matches of a rule, in order."""
    if rule.name == "email":
        runs = F.regexp_extract_all(searched, F.lit(ADDRESS_RUN), F.lit(0))
        return F.filter(runs, lambda r: F.contains(r, F.lit("@")))
    return F.regexp_extract_all(searched, F.lit(rule.pattern), F.lit(0))


def rule_hits(text: Column, rule: Rule, positions: bool = True, searched: Column | None = None) -> Column:
    """Array of hits of one rule, one per distinct text, in order of first match. `searched` is the text as its gate left it.

    Replacement does not need `pos`, so masking leaves it null and saves a pass.
    """
    found = matches(text if searched is None else searched, rule)
    if not positions:
        return F.transform(F.array_distinct(found), lambda t: _hit(rule, t, F.lit(None)))

    def place(m):
        # The pieces between matches give the code-point offset of the k-th match.
        def one(t):
            k = F.array_position(m["found"], t).cast("int")
            before = F.length(F.array_join(F.slice(m["gaps"], 1, k), ""))
            earlier = F.length(F.array_join(F.slice(m["found"], F.lit(1), k - 1), ""))
            return _hit(rule, t, before + earlier + 1)
        return F.transform(F.array_distinct(m["found"]), one)

    def some(f):
        # A match whose text occurs once stands there. If one occurs again, before its match or after it, the text is cut by the pattern.
        gaps = F.split(text, rule.pattern, -1)
        return let(F.transform(f, lambda t: F.struct(t.alias("t"), F.instr(text, t).alias("at"))), lambda first: (
            F.when(F.forall(first, lambda x: F.position(x["t"], text, x["at"] + 1) == 0), F.transform(first, lambda x: _hit(rule, x["t"], x["at"])))
            .otherwise(let(F.struct(f.alias("found"), gaps.alias("gaps")), place))))
    return let(found, some)


def no_hits() -> Column:
    return F.array().cast(HITS_DDL)


def regex_hits(text: Column, names: tuple[str, ...] | None = None, positions: bool = True) -> Column:
    """All rules, in rule order; each gate is evaluated once per text."""
    chosen = RULES if names is None else tuple(BY_NAME[n] for n in names)
    wanted = {r.gate for r in chosen}
    checked = F.struct(*[c.alias(n) for n, c in gates(text).items() if n in wanted])
    return let(checked, lambda g: F.concat(*[
        F.when(g[r.gate].isNotNull(), rule_hits(text, r, positions, g[r.gate])).otherwise(no_hits()) for r in chosen]))
