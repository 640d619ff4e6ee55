"""Exact values on small hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from veilwork.config import AssistConfig, MaskConfig
from veilwork.functions.hosts import is_private_host
from veilwork.functions.names import file_class, sanitize_name
from veilwork.functions.numeric import numeric_canonical, numeric_rule
from veilwork.functions.spans import occurrences, resolve
from veilwork.functions.text import decode_bytes, fuzzy_amount, markup_plaintext, normalize_text, parse_manual_words
from veilwork.operators import aliases as AL
from veilwork.operators import assist as AS
from veilwork.operators import cells as C
from veilwork.operators import evaluate as EV
from veilwork.operators import paths as PT
from veilwork.operators import restore as RS
from veilwork.operators import review as RV
from veilwork.operators.detect import detect, detections
from veilwork.operators.policy import status
from veilwork.operators.replace import clear_identity_columns
from veilwork.operators.tokens import reserved_numbers, scan_tokens
from veilwork.plans.mask import mask_units
from veilwork.sources import lexicon as L
from veilwork.sources.files import read_mapping_json

BOTH = ("auto_mask", "suggest_mask")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def hits(units, text, cfg=MaskConfig(), lexicon=None):
    rows = detections(detect(units([text]), cfg, lexicon)).orderBy("det_ord").collect()
    return [(r["text"], r["text_type"], r["source"], r["confidence"]) for r in rows]


@pytest.mark.parametrize("text, expected", [
    ("联系电话：13812345678", [("13812345678", 0.85)]),
    ("电话：+8613812345678", [("+8613812345678", 0.85)]),
    ("号码：1381234567890", []),
    ("卡号：1234567890123456789", [("1234567890123456789", 0.65)]),
    ("身份证：110101199001011234", [("110101199001011234", 0.85)]),
    ("合同约定人民币 1.2亿，分期支付", [("人民币 1.2亿", 0.90), ("1.2亿", 0.80)]),
    ("合同约定人民币　１.2亿元", [("人民币　１.2亿元", 0.90), ("１.2亿元", 0.80)]),
    ("证件11010119900101123X。", [("11010119900101123X", 0.85), ("11010119900101123", 0.65)]),
    ("a@b.com-x@y.com", [("a@b.com", 0.75), ("-x@y.com", 0.75)]),
    ("于2024年3月1日签", [("2024年3月1日", 0.70)]),
    ("12024年3月1日", []),
    ("卡6222 0202 0000 1234 567，", [("6222 0202 0000 1234 567", 0.65)]),
    ("编号3.5.5万", []),
])
def test_rules(units, text, expected):
    assert [(h[0], h[3]) for h in hits(units, text)] == expected


def test_rule_position_is_the_match_not_an_earlier_copy(units):
    text = "x138123456789 " + "y" * 80 + " 13812345678"
    row = detections(detect(units([text]))).first()
    assert row["pos"] == text.rindex("13812345678") + 1


@pytest.mark.parametrize("mode, expected", [
    ("focused", "AHHHHH"), ("strict", "ASHHHH"), ("smart", "AASSHH"), ("aggressive", "AAASSH"), ("other", "HHHHHH")])
def test_policy(spark, mode, expected):
    df = spark.createDataFrame([(i, c) for i, c in enumerate((0.95, 0.85, 0.75, 0.65, 0.50, 0.40))], "i int, c double")
    got = "".join(r["s"][0].upper() for r in df.select("i", status(F.col("c"), mode).alias("s")).orderBy("i").collect())
    assert got == expected


def test_channels_and_priority(spark, units):
    lex = L.lexicon_from_dict(spark, {"company": ["某某公司", "甲方"], "generic": ["某某公司", "合同"], "note": "skip"})
    cfg = MaskConfig(manual_words=("合同", "", "合同"), whitelist=("甲方", "合同"))
    assert hits(units, "甲方某某公司的合同", cfg, lex) == [("合同", "custom", "manual", 0.95), ("某某公司", "company", "dictionary", 0.95)]
    off = MaskConfig(manual_words=("合同",), auto_detect=False)
    assert hits(units, "某某公司的合同13812345678", off, lex) == [("合同", "custom", "manual", 0.95)]


def test_locate(spark):
    text = "甲方是某某公司，乙方也是某某公司，某某公司盖章。"
    assert value(spark, occurrences(F.lit(text), F.lit("某某公司"))) == [3, 12, 17]
    assert value(spark, occurrences(F.lit("a\\Eb a\\Eb"), F.lit("a\\Eb"))) == [0, 5]


def test_resolve(spark):
    span = "array(struct({} as start, {} as end, 'x' as text, 'custom' as type, 'regex' as source, {} as confidence))"
    def run(*spans):
        r = value(spark, resolve(F.expr("concat(" + ", ".join(span.format(s, e, f"{c}D") for s, e, c in spans) + ")")))
        return [(k["start"], k["end"], k["confidence"]) for k in r["kept"]], [(d["start"], d["end"]) for d in r["dropped"]]
    assert run((6, 8, 0.9), (0, 10, 0.5)) == ([(0, 10, 0.5)], [(6, 8)])
    assert run((0, 4, 0.75), (0, 4, 0.95)) == ([(0, 4, 0.95)], [(0, 4)])
    assert run((4, 6, 0.9), (0, 4, 0.9)) == ([(0, 4, 0.9), (4, 6, 0.9)], [])


def masked(run):
    return [r["masked_text"] for r in run.masked.orderBy("unit_ord").collect()]


def test_mask_numbers_reuses_and_skips(units, spark):
    lex = L.lexicon_from_dict(spark, {"person": ["张三", "李四"], "company": ["张三"]})
    run = mask_units(units(["李四和张三见[PERSON_001]、[PERSON_0002]", "张三", "无"]), MaskConfig(), lex)
    assert masked(run) == ["[PERSON_002]和[PERSON_003]见[PERSON_001]、[PERSON_0002]", "[PERSON_003]", "无"]
    assert {(r["token"], r["original"], r["type"]) for r in run.mapping.collect()} == {("[PERSON_002]", "李四", "person"), ("[PERSON_003]", "张三", "person")}


def test_mask_overlap(units):
    run = mask_units(units(["合同约定人民币 1.2亿，分三期支付"]), MaskConfig(statuses=BOTH))
    assert masked(run) == ["合同约定[AMOUNT_001]，分三期支付"]
    assert [d["text"] for d in run.resolved.first()["dropped"]] == ["1.2亿"]


@pytest.mark.parametrize("text, expected", [
    ("1.2亿元", "1亿+"), ("500万元", "500万+"), ("1,234.56元", "1234元+"), ("500万", "500万"), ("1,234.56万元", "1,234万+"), ("007元", "7元+")])
def test_fuzzy(spark, text, expected):
    assert value(spark, fuzzy_amount(F.lit(text))) == expected


@pytest.mark.parametrize("mode, expected", [("fuzzy", "付1亿+给[PERSON_001]"), ("fixed", "付***给[PERSON_001]")])
def test_amount_modes(spark, units, mode, expected):
    lex = L.lexicon_from_dict(spark, {"person": ["张三"]})
    run = mask_units(units(["付1.2亿元给张三"]), MaskConfig(statuses=BOTH, amount_mode=mode), lex)
    assert masked(run) == [expected]
    assert [r["original"] for r in run.mapping.collect()] == ["张三"]


def test_bad_amount_mode():
    with pytest.raises(ValueError):
        MaskConfig(amount_mode="round")


def test_irreversible(units):
    run = mask_units(units(["电话13812345678", "无"]), MaskConfig(irreversible=True))
    assert masked(run) == ["电话***", "无"] and run.mapping is None


def test_scan_and_reserved(units):
    found = scan_tokens(units(["a [COMPANY_001] b [PERSON_012] c [AMOUNT_9999] d not_token", "[PERSON_000] [PERSON_0001]"]))
    assert {r["token"] for r in found.collect()} == {"[COMPANY_001]", "[PERSON_012]", "[AMOUNT_9999]", "[PERSON_000]", "[PERSON_0001]"}
    assert {tuple(r) for r in reserved_numbers(found).collect()} == {("company", 1), ("person", 12), ("amount", 9999)}


def alias_names(spark, units, people, pool, corpus=""):
    lex = L.lexicon_from_dict(spark, {"person": people})
    run = mask_units(units(["，".join(people) + corpus]), MaskConfig(style="alias"), lex, pools=AL.AliasPools(person=pool))
    by = {r["original"]: r["token"] for r in run.mapping.collect()}
    return [by[p] for p in people], run.exhausted


@pytest.mark.parametrize("people, pool, corpus, expected", [
    (["p1", "p2", "p3"], ("汤姆", "杰瑞", "张三", "李四"), "张三", ["汤姆", "杰瑞", "李四"]),
    (["p1", "p2"], ("汤姆猫", "汤姆", "杰克"), "", ["汤姆猫", "杰克"]),
    (["p1", "p2"], ("汤姆", "汤姆猫", "杰克"), "", ["汤姆", "杰克"]),
    (["p1", "p2"], ("甲", "A/B", 'C"D', "[PERSON_009]", "乙"), "", ["甲", "乙"]),
    (["p1", "p2", "p3"], ("汤姆",), "", ["汤姆", "[PERSON_001]", "[PERSON_002]"]),
])
def test_aliases(spark, units, people, pool, corpus, expected):
    names, exhausted = alias_names(spark, units, people, pool, corpus)
    assert names == expected
    assert exhausted == (frozenset({"person"}) if "[PERSON_001]" in expected else frozenset())


def test_alias_letters():
    words = AL.lettered(("市", "省"))
    assert (words[0], words[25], words[26]) == ("A市", "Z市", "A省")


@pytest.mark.parametrize("v, expected", [
    (12345678.5, "12345678.5"), (1e7, "10000000.0"), (1.23e-05, "0.0000123"), (1e16, "10000000000000000"), (1.5e22, "15000000000000000000000"),
    (-2.5e-7, "-0.00000025"), (0.0, "0.0"), (100532.02500000001, "100532.02500000001"), (float("nan"), None), (float("inf"), None)])
def test_canonical(spark, v, expected):
    df = spark.createDataFrame([(v,)], "v double")
    assert df.select(numeric_canonical(F.col("v"))).first()[0] == expected


@pytest.mark.parametrize("canon, fmt, expected", [
    ("12000000", "¥#,##0.00", ("amount", 0.85)), ("5", "¥#,##0.00", None), ("120000000", "", ("amount", 0.70)),
    ("4111111111111111", "", ("custom", 0.85)), ("1234567890123456", "", ("custom", 0.65)), ("4111111111111111", "$0", ("amount", 0.85)),
    ("123456.7", "", ("amount", 0.60)), ("12345.7", "", None), ("-123456789", "", ("amount", 0.70))])
def test_numeric_rule(spark, canon, fmt, expected):
    got = value(spark, numeric_rule(F.lit(canon), F.lit(fmt)))
    assert (tuple(got) if got else None) == expected


def test_numeric_column(spark):
    cells = spark.createDataFrame([("f", 0, 0, 12000000, "¥0"), ("f", 0, 1, 5, "¥0"), ("f", 0, 2, 120000000, ""), ("f", 0, 3, 4111111111111111, ""), ("f", 0, 4, 1234567890123456, "")],
                                  "file string, file_ord long, unit_ord long, value long, number_format string")
    out, mapping = C.mask_numeric_column(cells, MaskConfig())
    assert [(r["masked_value"], r["stored_as"]) for r in out.orderBy("unit_ord").collect()] == [
        ("[AMOUNT_001]", "token"), ("5", "number"), ("120000000", "number"), ("[CUSTOM_001]", "token"), ("1234567890123456", "text")]
    assert {(r["token"], r["original"], r["kind"]) for r in mapping.collect()} == {("[AMOUNT_001]", "12000000", "number"), ("[CUSTOM_001]", "4111111111111111", "number")}


def test_restore_values(spark, units):
    mapping = spark.createDataFrame([("[AMOUNT_001]", "120000000", "number"), ("[AMOUNT_002]", "12000.5", "number"), ("[CUSTOM_001]", "00123", "text"), ("[AMOUNT_003]", "120000000", None)],
                                    "token string, original string, kind string")
    cells = units(["[AMOUNT_001]", "[AMOUNT_002]", "[CUSTOM_001]", "[AMOUNT_003]", "合计[AMOUNT_001]元"])
    rows = RS.restore_value(cells, mapping).orderBy("unit_ord").collect()
    assert [(r["restored"], r["value_long"] and int(r["value_long"]), r["value_double"]) for r in rows] == [
        ("120000000", 120000000, None), ("12000.5", None, 12000.5), ("00123", None, None), ("120000000", None, None), ("合计120000000元", None, None)]


def test_unmask_longest_first(spark, units):
    pairs = [("A市", "广州市"), ("A市场", "武汉广场")]
    assert RS.unmask_inline(units(["A市场与A市"]), pairs).first()["restored"] == "武汉广场与广州市"
    got = RS.unmask_inline(units(["x [PERSON_1] y [PERSON_12]"]), [("[PERSON_1]", "甲"), ("[PERSON_12]", "乙")]).first()
    assert got["restored"] == "x 甲 y 乙" and got["hits"] == ["[PERSON_12]", "[PERSON_1]"]


def test_bracket_gate(spark):
    df = spark.createDataFrame([("[A_001]",), ("A市",)], "token string")
    assert not RS.bracket_gate(df).first()["gate"]
    assert RS.bracket_gate(df.filter("token like '[%'")).first()["gate"]
    assert not RS.bracket_gate(df.limit(0)).first()["gate"]


def test_path_conflict_and_parents(spark):
    lex = L.lexicon_from_dict(spark, {"company": ["某某科技有限公司"], "person": ["张三"]})
    listing = spark.createDataFrame([("张三/普通/某某科技有限公司.docx",), ("张三/普通/[company_001].docx",), ("张三/500万项目.xlsx",), ("skipped_unmasked/张三.docx",)], "path string")
    rows = {r["rel_old"]: r for r in PT.plan_tree(listing, MaskConfig(), lex).collect()}
    assert set(rows) == {"张三", "张三/普通/某某科技有限公司.docx"}
    file = rows["张三/普通/某某科技有限公司.docx"]
    assert (file["new_name"], file["status"], file["rel_new"]) == ("[COMPANY_001]_1.docx", "conflict_suffixed", "[PERSON_001]/普通/[COMPANY_001]_1.docx")
    assert (file["categories"], file["tokens_used"], file["depth"]) == (["company"], ["[COMPANY_001]"], 3)


def test_path_tokens_leave_taken_numbers_out(spark):
    lex = L.lexicon_from_dict(spark, {"company": ["甲乙公司", "丙丁公司", "戊己公司"]})
    listing = spark.createDataFrame([("甲乙公司.docx",), ("丙丁公司.docx",), ("戊己公司.docx",), ("a/[COMPANY_003].docx",)], "path string")
    known = spark.createDataFrame([("甲乙公司", "[COMPANY_001]")], "original string, token string")
    rows = {r["old_name"]: r["new_name"] for r in PT.plan_tree(listing, MaskConfig(), lex, known).collect()}
    assert rows == {"甲乙公司.docx": "[COMPANY_001].docx", "丙丁公司.docx": "[COMPANY_002].docx", "戊己公司.docx": "[COMPANY_004].docx"}


@pytest.mark.parametrize("name, expected", [
    ("CON.docx", "CON_.docx"), ("a<b>.docx", "a_b_.docx"), ("x. .docx", "x.docx"), ("...", "_masked"), ("合同.tar.docx", "合同.tar.docx"), ("", "_masked")])
def test_sanitize(spark, name, expected):
    assert value(spark, sanitize_name(F.lit(name))) == expected


def test_import_csv_with_a_mark(spark):
    rows = spark.createDataFrame([(0, "\ufeffcategory", "word"), (1, "项目", "某某")], "ord long, c0 string, c1 string")
    assert [tuple(r) for r in L.import_lexicon_csv(rows).collect()] == [(1, "project", "某某", False)]


def test_all_candidates_without_a_budget(spark):
    rows = spark.range(5000).selectExpr("id as file_ord", "0 as unit_ord", "0 as channel_ord", "0 as rule_ord", "0 as pos", "string(id) as text", "'s' as source", "'t' as text_type")
    got = AS.number_candidates(rows).orderBy("file_ord").collect()
    assert [(r["batch"], r["id"]) for r in got] == [(i // 20, i % 20) for i in range(5000)]
    assert AS.number_candidates(rows, AssistConfig(max_calls=2)).count() == 40


def test_file_class(spark):
    got = [value(spark, file_class(F.lit(p))) for p in ("a/b.DOCX", "x.pptx", "d/.docx", "n")]
    assert got == ["docs", "blocked", "other", "other"]


@pytest.mark.parametrize("url, expected", [
    ("http://localhost:8000/v1", True), ("192.168.1.10:8000/v1", True), ("http://[::1]/x", True), ("https://a.internal", True), ("http://172.32.0.1", False),
    ("http://0.0.0.0", True), ("https://example.com", False), ("", False), ("http://100.64.0.1", False), ("http://169.254.1.1", True),
    ("http://gpu_box.internal/v1", True), ("http://me@localhost:1", True), (None, False)])
def test_private_host(spark, url, expected):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(is_private_host(F.col("u"))).first()[0] is expected


def test_text_helpers(spark):
    df = spark.createDataFrame([("张<b>三</b> &amp; 李",)], "t string")
    assert df.select(markup_plaintext(F.col("t"))).first()[0] == "张三 & 李"
    raw = spark.createDataFrame([("汉字".encode("gb18030"),), ("汉字".encode(),)], "b binary")
    assert [r[0] for r in raw.select(decode_bytes("b")).collect()] == ["汉字", "汉字"]
    assert value(spark, normalize_text(F.lit("  Ａ１　 b\n"))) == "A1 b"
    assert value(spark, parse_manual_words(F.lit(" a,b，a\n\nc "))) == ["a", "b", "c"]


def test_mapping_json_shapes(spark):
    docs = spark.createDataFrame([(1, '{"tokens":{"[P_001]":{"original":"甲","kind":"number"}},"metadata":{}}'), (2, '{"[P_002]":"乙"}'), (3, '[{"token":"[P_003]","original":"丙"},{"token":"x"}]')], "id int, json string")
    assert {tuple(r) for r in read_mapping_json(docs).select("id", "token", "original", "kind").collect()} == {
        (1, "[P_001]", "甲", "number"), (2, "[P_002]", "乙", "text"), (3, "[P_003]", "丙", "text")}


def test_identity_columns(spark):
    row = clear_identity_columns(spark.createDataFrame([("me", 1)], "author string, n int")).first()
    assert tuple(row) == ("", 1)


# ---- model assistance -------------------------------------------------------------------

@pytest.mark.parametrize("text, expected", [
    ('{"items":[{"id":0}]}', '{"items": [{"id": 0}]}'), ('<think>x {"a":1}</think>```json\n{"items": []}\n```', '{"items": []}'), ("<think>open", None), ("no json", None),
    ('say {"a": {"b": 2}} end', '{"a": {"b": 2}}'), ("", None)])
def test_parse(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(AS.parse_response("t")).first()[0] == expected


def test_breaker(spark):
    def factory():
        def call(_):
            raise RuntimeError("down")
        return call
    reqs = spark.createDataFrame([(i, "[]") for i in range(6)], "batch long, request string").coalesce(1)
    rows = AS.score_batches(reqs, factory, AssistConfig()).orderBy("batch").collect()
    assert [r["error"] for r in rows] == ["down"] * 3 + [None] * 3 and all(r["response"] is None for r in rows)


def test_chunks(spark):
    def run(text, limit):
        return value(spark, AS.split_chunks(F.lit(text), limit))
    assert run("abc", 10) == ["abc"]
    assert run("aaaaaaa。bbbbbbbbbbbb", 10) == ["aaaaaaa。", "bbbbbbbbbb", "bb"]
    assert run("a。aaaaaaaaaaaaaa", 10) == ["a。aaaaaaaa", "aaaaaa"]


def test_evaluation_cases(spark, units):
    """The cases that lexicon and rules decide alone."""
    lex = L.lexicon_from_dict(spark, {"company": ["华东勘测设计研究院", "云岭智造科技"], "person": ["周明远"], "location": ["云岭市"], "generic": ["甲方", "乙方", "监理", "合同"]})
    texts = ["云岭智造科技（云岭市）与华东勘测设计研究院签订合同，联系人为周明远，电话13912345678。", "甲方与乙方按标段提交图纸与附件，监理会同总包完成竣工验收，相关文件编入合同附件。",
             "本次交易金额1234.56万元，履约保证金500万元，均已到账。", "身份证号110101199001011234，银行卡6222 0202 0000 1234 567。"]
    expected = [(0, "云岭智造科技", "company"), (0, "云岭市", "location"), (0, "华东勘测设计研究院", "company"), (0, "周明远", "person"), (0, "13912345678", "custom"),
                (2, "1234.56万元", "amount"), (2, "500万元", "amount"), (3, "110101199001011234", "custom"), (3, " 6222 0202 0000 1234 567", "custom")]
    def score(whitelist):
        rows = detections(detect(units(texts), MaskConfig(whitelist=whitelist), lex))
        preds = rows.select(F.col("unit_ord").alias("case_id"), F.col("det_ord").alias("ord"), "text", F.col("text_type").alias("type"))
        return EV.overall(EV.compare(preds, spark.createDataFrame(expected, "case_id long, text string, type string"))).first()
    good = score(("甲方", "乙方", "监理", "合同"))
    assert (good["tp"], good["fp"], good["fn"], good["f1"], good["type_accuracy"]) == (9, 0, 0, 1.0, 1.0)
    assert score(())["fp"] >= 1


def test_location_by_context(spark):
    units = spark.createDataFrame([("f", 0, 0, "aaa and so on"), ("f", 0, 1, "one aaaa two three"), ("f", 0, 2, "nothing but the context"), ("g", 1, 0, "aaaa")],
                                  "file string, file_ord long, unit_ord long, text string")
    rows = spark.createDataFrame([("f", "aa", "e aaaa two"), ("f", "aa", "nothing but the"), ("f", "aa", None), ("f", "zz", "not to be found"), ("g", "aa", "e aaaa two")],
                                 "file string, text string, context string")
    got = RV.kwic_locate(units, rows).collect()
    assert sorted((r["file"], r["context"] or "", r["target"]) for r in got) == [
        ("f", "", 0), ("f", "e aaaa two", 1), ("f", "not to be found", None), ("f", "nothing but the", 2), ("g", "e aaaa two", 0)]
