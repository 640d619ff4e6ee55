"""Detection runs once per job, in evenly dealt tasks, and places are found without cutting texts."""

import datetime
import os
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from veilwork.config import MaskConfig
from veilwork.functions import rules, spans
from veilwork.operators import assist, detect, tokens
from veilwork.plans import catalog_detect, catalog_mask, catalog_review, inputs, mask
from veilwork.session import deal, stage


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Sixty orders of six customers, each table one row group."""
    d = tmp_path_factory.mktemp("ledger")
    def long(x):
        return pa.array(list(x), pa.int64())
    made = {
        "orders": {"o_orderkey": long(range(60)), "o_custkey": long(i % 6 for i in range(60)), "o_totalprice": [100000.25 + i for i in range(60)],
                   "o_orderdate": [datetime.date(2020, 1, 1 + i % 28) for i in range(60)], "o_orderstatus": ["F"] * 60},
        "customer": {"c_custkey": long(range(6)), "c_name": [f"Customer#{i:09d}" for i in range(6)], "c_nationkey": long([0, 1] * 3), "c_mktsegment": ["X"] * 6},
        "nation": {"n_nationkey": long(range(2)), "n_name": ["NATION_0", "NATION_1"], "n_regionkey": long([0, 0])},
        "region": {"r_regionkey": long([0]), "r_name": ["ASIA"]},
        "supplier": {"s_suppkey": long(range(3)), "s_name": [f"Supplier#{i:09d}" for i in range(3)]},
        "part": {"p_partkey": long(range(2)), "p_brand": ["Brand#11", "Brand#12"]}}
    for name, columns in made.items():
        pq.write_table(pa.table(columns), d / f"{name}.parquet")
    return str(d)


@pytest.fixture
def reads(monkeypatch, spark):
    """Counts the sentences of the ledger that go into searches."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    def counted(spark, sf_dir):
        units = inputs.ledger(spark, sf_dir)
        return units.mapInArrow(count, units.schema)
    for module in (catalog_detect, catalog_mask):
        monkeypatch.setattr(module, "ledger", counted)
    return seen


def test_ledger_is_dealt_evenly(spark, tables, monkeypatch):
    monkeypatch.setattr(inputs, "deal", lambda df, rows: deal(df, rows, 3), raising=False)
    for units in (inputs.ledger(spark, tables), inputs.tokened(spark, tables)):
        sizes = units.rdd.glom().map(len).collect()
        assert sum(sizes) == 60 and len(sizes) == 20 and max(sizes) <= 10


@pytest.mark.parametrize("name", ["c7_apply_verdicts", "c12_stats"])
def test_review_detects_once(spark, tables, reads, name):
    assert getattr(catalog_mask, name)(spark, tables).collect() and reads.value == 60


@pytest.mark.parametrize("name", ["d17_mask_ledger", "d17_mask_confirmed"])
def test_masking_detects_once(spark, tables, reads, name, monkeypatch):
    monkeypatch.setattr(mask, "INLINE_CONFIRMED", 1)
    monkeypatch.setattr(mask, "BROADCAST_ROWS", 1)
    assert len(getattr(catalog_mask, name)(spark, tables).collect()) == 60 and reads.value == 60


def test_places_of_only_matches(units):
    texts = ["卡6222020212345678。", "😀😀卡6222020212345678", "62220202123456789012345678 6222020212345678", "6222020212345678,6222020212345679",
             "订2024年1月2日2024年1月2日", "a@b.cn", "x 12万 12万元", "122024年1月2日 2024年1月2日"]
    got = units(texts).select("text", F.explode(rules.regex_hits(F.col("text"))).alias("h")).select("text", "h.text", "h.rule", "h.pos").collect()
    assert {(t, w, p) for t, w, _, p in got} == {
        (texts[0], "6222020212345678", 2), (texts[1], "6222020212345678", 4), (texts[2], "6222020212345678", 28),
        (texts[3], "6222020212345678", 1), (texts[3], "6222020212345679", 18), (texts[4], "2024年1月2日", 11), (texts[5], "a@b.cn", 1),
        (texts[6], "12万", 3), (texts[6], "12万元", 7), (texts[7], "2024年1月2日", 13)}


def test_long_numbers_do_not_backtrack(units):
    """The pattern of amounts took time quadratic in the length of a number without a unit."""
    text = "9" * 150_000 + " 12.5万元"
    began = time.monotonic()
    got = units([text]).select(F.explode(rules.regex_hits(F.col("text"), ("generic_amount",))).alias("h")).select("h.text", "h.pos").collect()
    assert [tuple(r) for r in got] == [("12.5万元", 150_002)] and time.monotonic() - began < 15


def test_long_runs_keep_what_stands_around_them(units):
    texts = ["5+8613800138000", "x+8613800138000", "11010119000101001X", "11010119000101001X2", "11010119000101001x 1", "110101190001010012X", "a@b.cn@c.de-e@f.gh x@"]
    got = units(texts).select("text", F.explode(rules.regex_hits(F.col("text"))).alias("h")).select("text", "h.text", "h.rule", "h.pos").collect()
    assert {tuple(r) for r in got} == {
        (texts[0], "8613800138000", 2, 3), (texts[1], "+8613800138000", 2, 2), (texts[2], "11010119000101001X", 3, 1), (texts[2], "11010119000101001", 6, 1),
        (texts[3], "11010119000101001", 6, 1), (texts[4], "11010119000101001x", 3, 1), (texts[4], "11010119000101001", 6, 1),
        (texts[5], "110101190001010012", 3, 1), (texts[5], "110101190001010012", 6, 1), (texts[6], "a@b.cn", 4, 1), (texts[6], "c.de-e@f.gh", 4, 8)}


def test_words_that_occur_once_need_no_split(units, spark):
    cases = [("aXbXc", "X", [1, 3]), ("aaa", "aa", [0]), ("😀x", "x", [1]), ("abc", "z", []), (None, "a", None), ("abab", "ab", [0, 2])]
    rows = spark.createDataFrame([(t, w) for t, w, _ in cases], "t string, w string").select(spans.occurrences(F.col("t"), F.col("w"))).collect()
    assert [r[0] for r in rows] == [x for *_, x in cases]


def test_batches_move_no_context(spark, tables, monkeypatch):
    seen = []
    number = assist.number_candidates
    monkeypatch.setattr(assist, "number_candidates", lambda c: seen.append(c.columns) or number(c))
    assert catalog_mask.c2_batches(spark, tables).count() > 0 and "context" not in seen[0]
    assert catalog_mask.c3_score_batches(spark, tables).filter("answered").count() > 0 and "context" in seen[1]


def test_joined_lexicon_searches_units_once_whatever_their_keys(spark):
    """Units were made and searched twice, and met their words by keys that repeat or are null."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch
    made = spark.createDataFrame([("a", 1, 1, "x NATION_9"), ("a", 1, 1, "x NATION_8"), (None, None, 2, "NATION_8 y"), ("b", 2, 3, "none")],
                                 "file string, file_ord long, unit_ord long, text string")
    words = spark.createDataFrame([("NATION_8", "location", 1), ("NATION_9", "location", 2)], "word string, type string, rule long")
    got = detect.detect_dictionary(made.mapInArrow(count, made.schema), words, "join").select("text", "dict_hits").collect()
    assert sorted((r["text"], [(h["text"], h["pos"]) for h in r["dict_hits"]]) for r in got) == [
        ("NATION_8 y", [("NATION_8", 1)]), ("none", []), ("x NATION_8", [("NATION_8", 3)]), ("x NATION_9", [("NATION_9", 3)])]
    assert seen.value == 4


@pytest.mark.parametrize("module, name", [(catalog_mask, "d2_actionable"), (catalog_mask, "d3_confirm_audit"), (catalog_detect, "b26_dedup_files"),
                                          (catalog_review, "h12_bulk_select")])
def test_places_are_made_for_those_who_ask(spark, tables, monkeypatch, module, name):
    asked, search = [], detect.detect
    monkeypatch.setattr(detect, "detect", lambda *a, positions=True, **kw: asked.append(positions) or search(*a, positions=positions, **kw))
    getattr(module, name)(spark, tables)
    assert asked == [False]


@pytest.mark.parametrize("name", ["d6_dropped", "d13_replacements"])
def test_resolved_units_are_staged_without_texts(spark, tables, monkeypatch, name):
    staged, write = [], catalog_mask.stage
    monkeypatch.setattr(catalog_mask, "stage", lambda df: staged.append(df.columns) or write(df))
    getattr(catalog_mask, name)(spark, tables)
    assert staged and not any("text" in c for c in staged)


def test_channels_share_one_ledger(spark, tables, reads):
    assert catalog_detect.b13_dedup_channels(spark, tables).count() > 0 and reads.value == 60


@pytest.fixture
def left(spark):
    """Names of the tables that were staged since and are still there."""
    stage(spark.range(1))
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    return lambda: set(os.listdir(folder)) - before


def test_shuffles_of_a_staged_table_go(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {x for i in range(files.size()) if (x := files.apply(i).getName()).startswith("shuffle_")}
    before = shuffles()
    assert len(stage(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count()).collect()) == 100
    for _ in range(50):  # removed in the background
        new = shuffles() - before
        if not new:
            break
        time.sleep(0.2)
    assert not new


def test_masking_leaves_two_tables(spark, tables, left, monkeypatch):
    """The units with their spans and the tokens; texts were staged up to three times."""
    monkeypatch.setattr(detect, "BROADCAST_ROWS", 1)
    made = catalog_mask.d17_mask_ledger(spark, tables)
    assert len(left()) == 2 and made.filter("masked_text like '%[PERSON_%'").count() == 60


def test_masking_tells_units_of_one_key_apart(spark):
    """Tokens came back by the key of the units, which failed where two units shared one."""
    made = spark.createDataFrame([("a", 1, 1, "张三付1.2亿元"), ("a", 1, 1, "张三见李四"), ("a", 1, 2, "无")], "file string, file_ord long, unit_ord long, text string")
    words = spark.createDataFrame([("person", 0, "张三", 1), ("person", 0, "李四", 2)], "category string, cat_ord int, word string, word_ord long")
    run = mask.mask_units(made, MaskConfig(amount_mode="fuzzy"), words)
    got = {r["text"]: r["masked_text"] for r in run.masked.select("text", "masked_text").collect()}
    assert got["张三付1.2亿元"].startswith("[PERSON_001]付") and got["张三见李四"] == "[PERSON_001]见[PERSON_002]"


@pytest.mark.parametrize("name, tables_left", [("c7_apply_verdicts", 2), ("c12_stats", 3)])
def test_reviews_leave_what_they_read(spark, tables, left, monkeypatch, name, tables_left):
    """Candidates were staged with their contexts up to three times, and stayed."""
    monkeypatch.setattr(detect, "BROADCAST_ROWS", 1)
    made = getattr(catalog_mask, name)(spark, tables)
    assert len(left()) == tables_left and made.collect()


def test_ranges_number_rows_without_another_shuffle(spark):
    rows = [(g, i % 7, i) for i in range(300) for g in ("a", "b", None)[:1 + i % 3]]
    df = spark.createDataFrame(rows, "g string, x int, y int")
    made = tokens.number_rows(df, "g", ["x", "y"], limit=50)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("BroadcastExchange")[0] and "SortMergeJoin" not in plan
    for g in ("a", "b", None):  # the numbers of a null group began again in each range
        want = sorted((x, y) for h, x, y in rows if h == g)
        got = sorted((r["k"], r["x"], r["y"]) for r in made.collect() if r["g"] == g)
        assert got == [(i, *w) for i, w in enumerate(want, 1)]


def test_report_detects_once_and_packs_its_entries(spark, tables, reads, left, monkeypatch):
    """The summary, the entries and the list of files each made the ledger again, and entries were written as they are."""
    monkeypatch.setattr(detect, "BROADCAST_ROWS", 1)
    made = catalog_detect.a12_write_report(spark, tables)
    folders = left()
    assert reads.value == 60 and len([f for f in folders if f.startswith("stage-")]) == 2
    assert made.count() > 60 and all(f.endswith(".json.gz") for f in made.inputFiles())


def test_rules_without_a_lexicon_search_arrays(spark, tables, units, monkeypatch):
    """The rule channel of b13 tried eight patterns on every text."""
    texts = ["付人民币 12.5万元，电话+8613800138000", "a@b.cn NATION_3 2024年1月2日", "6222 0202 1234 5678 𝟙𝟚万元", "无", "12万 12万元 12万"]
    found = [{(r["text"], tuple(map(tuple, r["hits"]))) for r in detect.detect(units(texts), MaskConfig(whitelist=("12万",)), method=m).select("text", "hits").collect()}
             for m in (None, "scan")]
    assert found[0] == found[1] and sum(len(h) for _, h in found[0]) > 6
    used, scan = [], detect.rules_scanned
    monkeypatch.setattr(detect, "rules_scanned", lambda u, r: used.append(r.positions) or scan(u, r))
    assert catalog_detect.b13_dedup_channels(spark, tables).count() > 0 and used == [True]
