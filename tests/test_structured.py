"""Literals and list items are masked in place, and come back."""

from veilwork.config import MaskConfig
from veilwork.operators.aliases import words_in_corpus
from veilwork.operators.detect import detect, spare_whitelisted
from veilwork.plans.structured import mask_list_items, mask_quoted_literals, restore_parts
from veilwork.sources.lexicon import lexicon_from_dict

CFG = MaskConfig(mode="smart")


def test_literals_and_lists_round_trip(spark):
    lexicon = lexicon_from_dict(spark, {"company": ['Acme "A"', "Beta"], "person": ["周明远"]})
    formulas = ['IF(A1="Acme ""A""","Beta & 周明远",0)', 'Beta!A1+"none"', "SUM(A1)", None, '""', '"Beta""Beta"', 'X="Beta"&"13812345678"']
    cells = spark.createDataFrame([("s", i, t, "clash") for i, t in enumerate(formulas)], "sheet string, ord long, body string, text string")
    masked, run = mask_quoted_literals(cells, "body", ["sheet", "ord"], "ord", CFG, lexicon=lexicon)
    assert masked.columns == [*cells.columns, "new_body"]
    got = {r["ord"]: r["new_body"] for r in masked.collect()}
    assert got == {0: 'IF(A1="[COMPANY_001]","[COMPANY_002] & [PERSON_001]",0)', 1: formulas[1], 2: formulas[2], 3: None, 4: '""',
                   5: '"[COMPANY_002]""[COMPANY_002]"', 6: 'X="[COMPANY_002]"&"[CUSTOM_001]"'}
    back = restore_parts(masked.drop("body").withColumnRenamed("new_body", "body"), "body", ["sheet", "ord"], "ord", "literals", run.mapping)
    assert {r["ord"]: r["new_body"] for r in back.collect()} == dict(enumerate(formulas))

    lists = ['"Beta,yes,周明远"', "Sheet1!A1:A3", '"no"', None, '"Beta,,Beta"']
    cells = spark.createDataFrame(list(enumerate(lists)), "ord long, body string")
    masked, run = mask_list_items(cells, "body", ["ord"], "ord", CFG, lexicon=lexicon)
    assert {r["ord"]: r["new_body"] for r in masked.collect()} == {0: '"[COMPANY_001],yes,[PERSON_001]"', 1: lists[1], 2: lists[2], 3: None, 4: '"[COMPANY_001],,[COMPANY_001]"'}
    back = restore_parts(masked.drop("body").withColumnRenamed("new_body", "body"), "body", ["ord"], "ord", "list", run.mapping)
    assert {r["ord"]: r["new_body"] for r in back.collect()} == dict(enumerate(lists))


def test_whitelist_tables_small_and_large(spark, units, monkeypatch):
    lexicon = lexicon_from_dict(spark, {"company": ["Acme", "Beta"]})
    table = spark.createDataFrame([("Beta",), ("13812345678",), (None,), ("",)], "word string")
    texts = units(["Acme and Beta 13812345678", "13900000000", "Beta", "none"])
    found = []
    for limit in (200_000, 0):
        monkeypatch.setattr("veilwork.operators.detect.BROADCAST_ROWS", limit)
        monkeypatch.setattr("veilwork.session.BROADCAST_ROWS", limit)
        rows = detect(texts, MaskConfig(manual_words=("Beta",)), lexicon, whitelist=table).collect()
        found.append({r["unit_ord"]: [(h["text"], h["source"]) for h in r["hits"]] for r in rows})
    assert found[0] == found[1] == {0: [("Beta", "manual"), ("Acme", "dictionary")], 1: [("13900000000", "regex")], 2: [("Beta", "manual")], 3: []}
    spared = spare_whitelisted(detect(texts, MaskConfig(), lexicon), table.limit(0)).collect()
    assert sum(len(r["hits"]) for r in spared) == 5


def test_words_of_marked_up_sources(spark, units):
    words = spark.createDataFrame([("汤姆",), ("A&B",), ("杰瑞",)], "alias string")
    source = units(["<b>汤</b>姆 and A&amp;B"])
    assert words_in_corpus(source, words).count() == 0
    assert {r["alias"] for r in words_in_corpus(source, words, markup=True).collect()} == {"汤姆", "A&B"}
