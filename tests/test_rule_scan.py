"""The rules as array code find what the patterns find, and a run with a lexicon searches for them by arrays."""

import random

import pytest
from pyspark.sql import functions as F

from veilwork.config import MaskConfig
from veilwork.functions import rule_scan
from veilwork.functions.rules import RULES, regex_hits
from veilwork.operators import detect as D
from veilwork.operators.phrases import text_blocks

PARTS = ["1", "2", "86", "+", "13", "X", "x", "年", "月", "日", "人民币", "万", "亿", "元", ",", ".", " ", "-", "@", "a", "b.c", "_", "１", "٣", "é", "　", "😀", "\n",
         "1234", "12345678901", "+8613812345678", "12345678901234567", "1234 5678", "2020年1月1日"]


def made(n):
    random.seed(5)
    texts = []
    for _ in range(n):
        some = random.sample(PARTS, random.choice((3, 8, len(PARTS))))
        texts.append("".join(random.choice(some) for _ in range(random.choice((0, 1, 4, 12, 30)))))
    return texts


def test_arrays_find_what_the_patterns_find(spark):
    texts = made(4000)
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", regex_hits(F.col("text")).alias("hits")).orderBy("i").collect()
    want = [[(h["text"], h["rule"], h["pos"]) for h in r["hits"]] for r in rows]
    kinds, got = rule_scan.char_kinds(spark), []
    for block in text_blocks(texts):
        found = [{} for _ in block.texts]
        for t, rule, a, b in zip(*(x.tolist() for x in rule_scan.rule_matches(block.codes, block.ends, kinds)), strict=True):
            a, b = a - block.starts[t], b - block.starts[t]
            found[t].setdefault((block.texts[t][a:b], rule), a + 1)
        got += [[(*x, pos) for x, pos in f.items()] for f in found]
    assert got == want
    assert {h[1] for hits in want for h in hits} == set(range(len(RULES)))


@pytest.mark.parametrize("method", [None, "join"])
def test_rules_beside_a_lexicon_need_no_patterns(spark, units, method, monkeypatch):
    texts = ["Bob 13812345678 Bob", "𝟗13812345678 Ann", None, "", "Ann 1万元 bob@x.org 1万元", "1万元 1.5万元"]
    lexicon = spark.createDataFrame([("person", 0, "Bob", 0), ("amount", 1, "1万元", 1)], "category string, cat_ord int, word string, word_ord long")
    cfg = MaskConfig(whitelist=("bob@x.org",))
    by_pattern = D.detect(units(texts), cfg)
    want = {r["unit_ord"]: [(h["text"], h["pos"]) for h in r["hits"]] for r in by_pattern.collect()}
    for unit in (0, 4, 5):
        words = [(w, texts[unit].index(w) + 1) for w in ("Bob", "1万元") if w in texts[unit]]
        want[unit] = words + [h for h in want[unit] if h not in words]
    kept = D.regex_hits
    tried = []
    monkeypatch.setattr(D, "regex_hits", lambda text, **kw: tried.append(1) or F.when(text.startswith("𝟗"), kept(text, **kw)).otherwise(
        F.raise_error(F.lit("searched by patterns")).cast(D.HITS_DDL)))
    got = {r["unit_ord"]: [(h["text"], h["pos"]) for h in r["hits"]] for r in D.detect(units(texts), cfg, lexicon, method=method).collect()}
    assert got == want and tried
