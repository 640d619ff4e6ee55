"""Two ways to the same result, and sequential references on random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from veilwork.config import MaskConfig
from veilwork.functions.spans import resolve
from veilwork.operators import detect as D
from veilwork.operators import restore as RS
from veilwork.operators import tokens as TK
from veilwork.operators.paths import resolve_name_conflicts
from veilwork.operators.replace import resolved_units, token_spans
from veilwork.plans.inputs import document_units, ledger, lexicon
from veilwork.plans.mask import mask_units
from veilwork.schema import UNIT_KEY
from veilwork.session import lookup_join

SF = "/root/testdata/sf0.001"
LOUD = MaskConfig(mode="aggressive", statuses=("auto_mask", "suggest_mask"))


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("method", ["inline", "broadcast", None])
def test_dictionary_methods_agree(spark, method):
    words = D.prepare_lexicon(lexicon(spark, SF), ["NATION_3"])
    units = ledger(spark, SF)
    a = D.detect_dictionary(units, words, method).select(*UNIT_KEY, "dict_hits")
    b = D.detect_dictionary(units, words, "ngram").select(*UNIT_KEY, "dict_hits")
    assert rows(a) == rows(b)


def test_numbering_paths_agree(spark):
    first = TK.first_uses(token_spans(resolved_units(D.detect(ledger(spark, SF), LOUD, lexicon(spark, SF)), LOUD), LOUD)).cache()
    one = TK.number_rows(first, "type", ["file_ord", "unit_ord", "start"]).select("original", "type", "k")
    two = TK.number_rows(first, "type", ["file_ord", "unit_ord", "start"], limit=500).select("original", "type", "k")
    assert rows(one) == rows(two)


def test_partitioning_does_not_change_tokens(spark):
    lex = lexicon(spark, SF)
    got = []
    for n in (1, 4, 64):
        run = mask_units(ledger(spark, SF).repartition(n), LOUD, lex)
        got.append((rows(run.mapping.select("token", "original")), rows(run.masked.select("unit_ord", "masked_text"))))
    assert got[0] == got[1] == got[2]


def test_reserved_numbers_match_counting(spark, monkeypatch):
    rng = random.Random(3)
    taken = {t: sorted(rng.sample(range(1, 60), 25)) for t in ("person", "company", "custom")}
    numbered = spark.createDataFrame([(t, k) for t in (*taken, "amount") for k in range(1, 50)], "type string, k int")
    reserved = spark.createDataFrame([(t, n) for t, ns in taken.items() for n in ns], "type string, number long")
    want = {}
    for t in (*taken, "amount"):
        n = 0
        for k in range(1, 50):
            n += 1
            while n in taken.get(t, ()):
                n += 1
            want[t, k] = n
    for limit in (10_000, 0):
        monkeypatch.setattr(TK, "GAP_ARRAY_ROWS", limit)
        assert {(r["type"], r["k"]): r["number"] for r in TK.skip_reserved(numbered, reserved).collect()} == want


def test_resolve_matches_greedy(spark):
    rng = random.Random(11)
    cases = []
    for i in range(200):
        spans = {(s, s + rng.randint(1, 8)): round(rng.random(), 3) for s in (rng.randint(0, 40) for _ in range(rng.randint(0, 12)))}
        cases.append((i, [(s, e, "t", "custom", "regex", c) for (s, e), c in spans.items()]))
    df = spark.createDataFrame(cases, "i int, spans array<struct<start:int,end:int,text:string,type:string,source:string,confidence:double>>")
    got = {r["i"]: r["r"] for r in df.select("i", resolve(F.col("spans")).alias("r")).collect()}
    for i, spans in cases:
        kept, dropped = [], []
        for s in sorted(spans, key=lambda s: (s[0] - s[1], -s[5], s[0])):
            (dropped if any(s[0] < k[1] and k[0] < s[1] for k in kept) else kept).append(s)
        assert [tuple(k) for k in got[i]["kept"]] == sorted(kept)
        assert [tuple(k) for k in got[i]["dropped"]] == dropped


def test_hot_key_join(spark, monkeypatch):
    import veilwork.session as S
    facts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("original"), "id")
    dim = facts.groupBy("original").agg(F.count(F.lit(1)).alias("uses")).withColumn("token", F.concat(F.lit("t"), "original"))
    want = rows(facts.join(dim.drop("uses"), "original").select("id", "token"))
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    assert rows(lookup_join(facts, dim, "original", "uses", dim.count()).select("id", "token")) == want


def test_round_trip_and_both_restores(spark, monkeypatch):
    units = document_units(spark, SF)
    run = mask_units(units, LOUD)
    back = RS.unmask_tokens(run.masked.select(*UNIT_KEY, F.col("masked_text").alias("text")), run.mapping)
    assert rows(back.select("file_ord", F.col("restored"))) == rows(units.select("file_ord", F.col("text").alias("restored")))
    pairs = [(r["token"], r["original"]) for r in run.mapping.collect()]
    inline = RS.unmask_inline(run.masked.select(*UNIT_KEY, F.col("masked_text").alias("text")), pairs)
    assert rows(inline.select("file_ord", "restored")) == rows(back.select("file_ord", "restored"))
    monkeypatch.setattr("veilwork.session.BROADCAST_ROWS", 0)
    other = RS.unmask_tokens(run.masked.select(*UNIT_KEY, F.col("masked_text").alias("text")), run.mapping)
    assert rows(other.select("file_ord", "restored")) == rows(back.select("file_ord", "restored"))


def test_untouched_units_both_ways(spark, monkeypatch):
    import veilwork.plans.mask as M
    a = rows(mask_units(document_units(spark, SF), LOUD).masked.select("file_ord", "masked_text"))
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    assert rows(mask_units(document_units(spark, SF), LOUD).masked.select("file_ord", "masked_text")) == a


def test_confirmed_sets_both_ways(spark, monkeypatch):
    import veilwork.plans.mask as M
    words = lexicon(spark, SF).filter("category = 'person'").select(F.col("word").alias("text"))
    def run():
        return rows(mask_units(ledger(spark, SF), MaskConfig(), lexicon(spark, SF), allowed=words).masked.select("unit_ord", "masked_text"))
    a = run()
    monkeypatch.setattr(M, "INLINE_CONFIRMED", 0)
    assert run() == a


@pytest.mark.parametrize("limit", [1_000_000, 40])
def test_name_conflicts_match_a_walk(spark, limit):
    rng = random.Random(5)
    pool = ["a", "a_1", "a_2", "a_1_1", "a_3", "b.txt", "b_1.txt", "b_2.txt", "A", "a_10", "b_1_2.txt"]
    wanted, existing, want = [], [], {}
    for folder in range(40):
        names = {n for n in (*pool, "a_4", "b_3.txt", "a_2_1", "c") if rng.random() < 0.25}
        existing += [(str(folder), n) for n in names]
        names = {n.lower() for n in names}
        some = rng.sample(pool, rng.randint(2, len(pool)))
        for _ in range(rng.randint(1, 20)):
            d = rng.choice(some)
            cut = d.rfind(".")
            stem, ext = (d[:cut], d[cut:]) if cut > 0 else (d, "")
            name, n = d, 0
            while name.lower() in names:
                n += 1
                name = f"{stem}_{n}{ext}"
            names.add(name.lower())
            want[len(wanted)] = name
            wanted.append((str(folder), d, len(wanted)))
    w = spark.createDataFrame(wanted, "parent string, desired string, ord long")
    e = spark.createDataFrame(existing, "parent string, name string")
    assert {r["ord"]: r["final"] for r in resolve_name_conflicts(w, e, ["ord"], limit=limit).collect()} == want
