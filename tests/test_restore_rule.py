"""One restore rule for mappings of any size: successive replacement, longest key first."""

import random

import pytest
from pyspark.sql import functions as F

from veilwork.operators import restore
from veilwork.operators.phrases import PhraseIndex, build_index, occurring
from veilwork.operators.restore import replace_in_turn, restore_value, unmask
from veilwork.plans import catalog_mask

SCHEMA = "file string, file_ord long, unit_ord long, text string, token string"


def brute(text, mapping):
    hits = set()
    for key in sorted((k for k in mapping if k), key=lambda k: (-len(k), k)):
        if text is not None and key in text:
            text = text.replace(key, mapping[key])
            hits.add(key)
    return text, hits


def table(spark, texts):
    return spark.createDataFrame([("f", 1, i, t, "clash") for i, t in enumerate(texts)], SCHEMA)


ODD = {"[COMPANY_001]": "c1", "[COMPANY_001]_1": "Beta", "[COMPANY_0012]": "c12", "A市": "广州", "A市场": "武汉", "ab": "B", "bc": "C", "abc": "[ab]", "b": "x",
       "Beta": "no", "[[COMPANY_001]]": "[COMPANY_002]", "[COMPANY_002]": "two", "c1]": "!", "😀": "smile", "x" * 40: "long"}
TEXTS = ["see [COMPANY_001]_1 end", "[[COMPANY_001]] [COMPANY_0012] [COMPANY_001]", "A市场与A市", "abc abcab bcb", None, "", "nothing", "[COMPANY_001]]", "😀" * 3 + "x" * 81,
         "ab" * 200, "[COMPANY_00" + "[COMPANY_001]" + "2]"]


@pytest.mark.parametrize("more", [0, 200, 1_000_000])
def test_nested_and_overlapping_keys_at_any_size(spark, more):
    mapping = spark.createDataFrame([(k, v) for k, v in ODD.items()] + [("", "never"), (None, "never"), ("null", None)], "token string, original string")
    plain = {f"[PERSON_{i:03d}]": f"p{i}" for i in range(1, more + 1)}
    if more:
        numbers = spark.range(1, more + 1)
        mapping = mapping.unionByName(numbers.select(F.format_string("[PERSON_%03d]", "id").alias("token"), F.concat(F.lit("p"), "id").alias("original")))
    texts = [*TEXTS, "[PERSON_001][PERSON_0011] [PERSON_007]_1 [PERSON_150] [PERSON_999999]"]
    got = {r["unit_ord"]: (r["restored"], set(r["hits"])) for r in unmask(table(spark, texts), mapping).collect()}
    assert got == {i: brute(t, plain | ODD) for i, t in enumerate(texts)}


def test_random_keys_against_successive_replacement(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab[") for _ in range(n))
    mapping = {word(rng.randint(1, 7)): word(rng.randint(0, 4)) for _ in range(60)}
    texts = [word(rng.randint(0, 30)) for _ in range(150)]
    have = spark.createDataFrame(list(mapping.items()), "token string, original string")
    got = {r["unit_ord"]: (r["restored"], set(r["hits"])) for r in unmask(table(spark, texts), have).collect()}
    assert got == {i: brute(t, mapping) for i, t in enumerate(texts)}


def test_restore_of_nothing(spark):
    none = spark.createDataFrame([], "token string, original string, kind string")
    assert unmask(table(spark, ["a"]), none).first()["restored"] == "a"
    assert unmask(table(spark, ["a"]).limit(0), none).count() == 0
    some = spark.createDataFrame([("[AMOUNT_001]", "12", "number"), ("[AMOUNT_002]", "13", None)], "token string, original string, kind string")
    got = restore_value(table(spark, [" [AMOUNT_001] ", "[AMOUNT_002]", "x[AMOUNT_001]", None]), some).orderBy("unit_ord").collect()
    assert [r["restored"] for r in got] == [" 12 ", "13", "x12", None] and [r["value_long"] for r in got] == [None] * 4
    number = restore_value(table(spark, ["[AMOUNT_001]"]), some).first()
    assert (number["restored"], int(number["value_long"])) == ("12", 12)


def test_long_text_with_many_keys():
    pairs = sorted(((f"[PERSON_{i:03d}]", f"name {i}") for i in range(5000)), key=lambda p: (-len(p[0]), p[0]))
    text = " some words between ".join(k for k, _ in pairs)
    new, hits, _ = replace_in_turn(text, pairs)
    assert new == " some words between ".join(v for _, v in pairs) and len(hits) == 5000


def test_index_never_misses(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc中😀\x00") for _ in range(rng.randint(1, 9))) for _ in range(300)})
    index = build_index(spark.createDataFrame([(w,) for w in words], "phrase string"))
    assert isinstance(index, PhraseIndex)
    texts = ["".join(rng.choice("abc中😀\x00 ") for _ in range(rng.randint(0, 60))) for _ in range(100)]
    for text, found in zip(texts, index.candidates(texts), strict=True):
        assert {w for w in words if w in text} <= set(found) and all(f in text for f in found)
    assert occurring(table(spark, texts), spark.createDataFrame([], "phrase string"), ("unit_ord",)).count() == 0
    got = occurring(table(spark, texts), spark.createDataFrame([(w, 1) for w in words], "phrase string, n int"), ("unit_ord",)).collect()
    assert sorted((r["unit_ord"], r["phrase"]) for r in got) == sorted((i, w) for i, t in enumerate(texts) for w in words if w in t)


def test_surroundings_of_many_texts_are_searched_together():
    """They were searched text by text, which cost several times what the search of the texts costs."""
    asked = []

    class Index:
        def candidates(self, texts):
            asked.append(len(texts))
            return [[w for w in ("[B]", "[CCCC]", "[A]") if w in t] for t in texts]
    assert restore.later_keys(Index(), [([(4, "x[B]"), (4, "[A]")], {"[A]"}), ([], set()), ([(4, "[CCCC][B]")], set()), ([(2, "[B]")], set())]) == [["[B]"], [], ["[B]"], []]
    assert asked == [4]


def test_nested_units_are_dealt(spark, tmp_path, monkeypatch):
    spark.range(20).selectExpr("id c_custkey", "concat('C', id) c_name", "'X' c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(60).selectExpr("id o_orderkey", "id % 20 o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    dealt, deal = [], catalog_mask.deal
    monkeypatch.setattr(catalog_mask, "deal", lambda df, rows: dealt.append(rows) or deal(df, rows))
    rows = {r["unit_ord"]: r["restored"] for r in catalog_mask.e1_unmask_nested(spark, str(tmp_path)).collect()}
    assert dealt == [60] and len(rows) == 60 and rows[21] == "see C1 of <X> and [C1]_21 or [AMOUNT_021]X"


def test_surroundings_beyond_one_search(spark, units, monkeypatch):
    monkeypatch.setattr(restore, "WINDOW_CHARS", 8)
    mapping = spark.createDataFrame([(f"[K{i}]", f"<[V{i}]>") for i in range(9)] + [(f"[V{i}]", str(i)) for i in range(9)], "token string, original string")
    got = restore.unmask(units([f"a[K{i}]" for i in range(9)] + ["none"]), mapping).select("text", "restored").collect()
    assert {tuple(r) for r in got} == {(f"a[K{i}]", f"a<{i}>") for i in range(9)} | {("none", "none")}
