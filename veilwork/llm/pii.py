"""Personal data: fixed forms, and identifiers found by contexts that the fixed forms teach."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilwork.llm.common import row_keys, staged

KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT = 3  # different accepted instances a pattern needs
SMOOTHING = 1.0
ACCEPT = 0.75  # score from which an unseen identifier counts
STEPS = 10_000  # scores are whole multiples of one part in so many, so that rounds end

_DIGITS_OR_AT = re.compile(r"[0-9@]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
# Looser forms that may be identifiers; only their contexts decide.
_LOOSE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{1,64}(?:(?:\.| ?[(\[](?:dot|DOT)[)\]] ?)[A-Za-z0-9-]{1,64}){1,8}")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])")),
    ("phone", re.compile(r"(?<![0-9+])\(?[0-9]{2,5}\)?(?:[\x20.-][0-9]{2,4}){1,4}(?![0-9])")),
)
_LETTERS = re.compile(r"[(\[](?:at|AT)[)\]]|[A-Fa-f]:[A-Fa-f]")  # stands in each match of them without digit or @
_PLAIN = re.compile(r"[^\s]*[0-9@][^\s]*")  # any other word with a digit: what a pattern should not find
_BEFORE, _AFTER = re.compile(r"\S+\s+\S+\s*\Z"), re.compile(r"\s*(\S+)")
CONTEXT = 80  # characters beside a span in which its neighbour words are looked for


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str):
    """Leftmost matches of the e-mail form, found from each `@` outwards, so that a text without one costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed forms, per kind leftmost and not overlapping; matches that fail their check are dropped."""
    if not _DIGITS_OR_AT.search(text):
        return []
    found = [("email", *x) for x in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans outside `base` and each other that might be identifiers, kind by kind, then other words with digits (kind "")."""
    if not _DIGITS_OR_AT.search(text) and not _LETTERS.search(text):
        return []
    taken, found = sorted((a, b) for _, a, b in base), []
    for kind, form in (*_LOOSE, ("", _PLAIN)):
        fresh, i = [], 0
        for m in form.finditer(text):
            a, b = m.span()
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if i == len(taken) or taken[i][0] >= b:
                fresh.append((a, b))
        found += [(kind, *x) for x in fresh]
        taken = sorted(taken + fresh)
    return found


def context(text: str, start: int, end: int) -> tuple[str, str]:
    """The two words before and the word after a span, lower-cased; empty where there are none."""
    before, after = _BEFORE.search(text[max(0, start - CONTEXT):start]), _AFTER.match(text[end:end + CONTEXT])
    return " ".join(before[0].lower().split()) if before else "", after[1].lower() if after else ""


SPAN = "struct<kind:string,start:int,end:int,base:boolean,value:string,before:string,after:string>"


def scan(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, key1, key2 and `spans`: fixed forms and candidates with their contexts; also what other columns
    `docs` has, under their names."""
    keys = dict(zip(("key1", "key2"), row_keys("doc_id", "text"), strict=True))
    passed = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keys.values(), *passed)
    schema = StructType([f for f in rows.schema.fields if f.name != "text"])

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 512):
                part, rows = batch.slice(a, 512), []
                for text in part.column("text").to_pylist():
                    base = base_spans(text)
                    spans = [(*s, True) for s in base] + [(*s, False) for s in loose_spans(text, base)]
                    rows.append([dict(kind=k, start=i, end=j, base=b, value=re.sub(r"[\s().-]+", "", text[i:j]).lower(),
                                      **dict(zip(("before", "after"), context(text, i, j), strict=True))) for k, i, j, b in spans])
                of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("value", pa.string()),
                                         ("before", pa.string()), ("after", pa.string())]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in schema.names), pa.array(rows, of)], [*schema.names, "spans"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + f", spans array<{SPAN}>")


def discover(scanned: DataFrame) -> DataFrame:
    """Candidates of `scanned` that the contexts of sure identifiers vouch for: kind, value, score.

    A pattern is a kind with the two words before, or the word before and the word after. Instances are values. Sure
    ones score 1; words with digits of no kind count against the patterns around them. A pattern needs MIN_SUPPORT accepted
    instances; its score is the mean score of its instances, smoothed; an instance's is one minus the product of its patterns'
    doubts. Candidates that reach ACCEPT teach patterns in the next round, also such as no sure one has, until a round changes
    nothing: scores only rise, in whole steps. Only contexts and values move, and all counts combine before the shuffle.
    """
    spans = scanned.select(F.explode("spans").alias("s")).select("s.*")
    near = F.array(F.when(F.col("before").contains(" "), F.concat(F.lit("b\n"), "before")),
                   F.when((F.col("before") != "") & (F.col("after") != ""), F.concat(F.lit("s\n"), F.element_at(F.split("before", " "), -1), F.lit("\n"), "after")))
    every = (spans.select("kind", "value", "base", F.explode(F.array_compact(near)).alias("near"))
             .groupBy("kind", "value", "near").agg(F.max("base").alias("base")))
    # A context with fewer values of a kind than MIN_SUPPORT can never vouch for it, whichever of them are accepted.
    could = every.filter("kind <> ''").groupBy("kind", "near").agg(F.count("*").alias("all")).filter(F.col("all") >= MIN_SUPPORT)
    plain = every.filter("kind = ''").groupBy("near").agg(F.count("*").alias("plain"))
    could = could.join(plain, "near", "left").select("kind", "near", (F.col("all") + F.coalesce("plain", F.lit(0))).alias("all"))
    edges = staged(every.filter("kind <> ''").join(could, ["kind", "near"]), "pii-edges")
    sure = staged(edges.filter("base").select("kind", "value").distinct().withColumn("score", F.lit(1.0)), "pii-sure")
    accepted, state = sure, (0, 0)
    while True:
        patterns = (edges.join(accepted, ["kind", "value"]).groupBy("kind", "near")
                    .agg((F.sum("score") / (F.first("all") + F.lit(SMOOTHING))).alias("trust"), F.count("*").alias("support")).filter(F.col("support") >= MIN_SUPPORT))
        doubt = F.exp(F.sum(F.log1p(-F.least("trust", F.lit(0.999)))))
        found = (edges.join(patterns.select("kind", "near", "trust"), ["kind", "near"]).groupBy("kind", "value").agg((F.floor((1 - doubt) * STEPS) / STEPS).alias("score"))
                 .filter(F.col("score") >= ACCEPT).join(sure.select("kind", "value"), ["kind", "value"], "left_anti"))
        found = staged(found, "pii-scores")
        last, state = state, tuple(found.agg(F.count("*"), F.coalesce(F.sum(F.round(F.col("score") * STEPS).cast("long")), F.lit(0))).first())
        if state <= last:
            break
        accepted = sure.unionByName(found)
    return accepted.join(edges.filter("not base").select("kind", "value").distinct(), ["kind", "value"], "left_semi")


def _open(spans: Column) -> Column:
    """Whether candidates stand among the spans, on which the whole corpus decides."""
    return F.exists(spans, lambda s: ~s["base"] & (s["kind"] != ""))


def decided(scanned: DataFrame) -> DataFrame:
    """`scanned`, staged, with its spans settled. Only rows with candidates are shuffled; the others stay where they are."""
    found = discover(scanned).select("kind", "value")
    some = scanned.filter(_open(F.col("spans")))
    loose = (some.select("key1", "key2", F.explode("spans").alias("s")).filter("not s.base and s.kind <> ''")
             .select("key1", "key2", "s.kind", "s.value", "s.start", "s.end").distinct())
    added = (loose.join(found, ["kind", "value"]).groupBy("key1", "key2")
             .agg(F.collect_list(F.struct("kind", "start", "end", F.lit(False).alias("base"))).alias("added")))
    plain = F.transform(F.filter("spans", lambda s: s["base"]), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean>>")
    both = some.join(added, ["key1", "key2"], "left").withColumn("spans", in_order(F.concat(plain, F.coalesce("added", none)))).drop("added")
    rest = scanned.filter(~_open(F.col("spans"))).withColumn("spans", in_order(plain))
    return rest.unionByName(both.select(*rest.columns))


def find_personal(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, key1, key2, `spans` (array of kind, start, end, base; sorted by start,
    kind, end; code points).

    Null counts as empty text and has no spans; rows that repeat have the same spans and count once as evidence; an empty
    table gives an empty result; other columns are not read. Values of the fixed forms always stay; candidates are added if their
    contexts vouch for them.
    """
    return decided(staged(scan(docs.select("doc_id", "text")), "pii-scan")).select("doc_id", "key1", "key2", "spans")


def in_order(spans: Column) -> Column:
    number = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.element_at(number, s["kind"]).alias("n"), s["end"].alias("end"),
                                                  s["kind"].alias("kind"), s["base"].alias("base")))
    return F.transform(F.sort_array(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))


def mask(docs: DataFrame) -> DataFrame:
    """`docs`, all columns, with each span of `text` replaced by its kind in angle brackets; spans that overlap become one,
    named by the first. n_chars, if there, follows. Null text stays null; rows that repeat stay, masked alike; an empty table gives no rows; columns of
    any name pass. Texts without candidates are not shuffled."""
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = decided(staged(scan(whole), "pii-scan")).withColumn("text", F.coalesce("row.text", F.lit("")))
    # Running state: text so far, and where the covered part ends.
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct(
        F.when(s["start"] >= a["end"], F.concat(a["out"], F.substring("text", a["end"] + 1, s["start"] - a["end"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        .otherwise(a["out"]).alias("out"), F.greatest(a["end"], s["end"]).alias("end"))
    some = F.size("spans") > 0
    rows = rows.withColumn("done", F.when(some, F.aggregate("spans", start, step)))
    masked = F.when(some, F.concat("done.out", F.substring("text", F.col("done.end") + 1, F.length("text")))).otherwise(F.col("row")["text"])
    new = {"text": masked}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(some, F.length(masked).cast("long")).otherwise(F.col("row")["n_chars"])
    return rows.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])
