"""Spelling variants, token counts and ranked search against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilwork.llm import lexical, spelling, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, word string, n long, score long, term long, key string, id string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2, 3, "k", "x") for i, t in rows], SCHEMA)


def brute_variants(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))
    beside = {w: [v for v in n if v != w and near(w, v)] for w in n}
    form = {}
    for w, c in n.items():
        best = min(beside[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * c else None
    def root(w):
        return root(form[w]) if form[w] else w
    return sorted((w, form[w] or "", root(w), c, len(beside[w]), n[form[w]] if form[w] else -1) for w, c in n.items())


def variants(rows):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in rows)


WORDS_IN = ["correction", "Größenordnung", "ÀÉÎÕÜßÿ×÷abc", "zzzzzzzzz", "abababab", "l" * 9000]


def word_rows(seed):
    rng, rows = random.Random(seed), [(None, "Correction correction"), (None, None), (5, ""), (5, "same row of repeated wordings"), (5, "same row of repeated wordings")]
    for i in range(400):
        words = []
        for _ in range(60):
            w = rng.choice(WORDS_IN[:-1]) if rng.random() < 0.8 else "".join(rng.choice("ab") for _ in range(rng.randint(6, 9)))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abzé") + w[k:], w[:k] + rng.choice("abzr") + w[k + 1:]])
            words.append(w)
        rows.append((i, rng.choice([" ", "-", "中", "1"]).join(words)))
    return [*rows, (900, WORDS_IN[-1]), (901, WORDS_IN[-1] + "x " + WORDS_IN[-1])]


@pytest.mark.parametrize("tile", [2048, 3])
def test_variants_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE", tile)
    monkeypatch.setattr(spelling, "ROWS_AT_ONCE", 500)
    rows = word_rows(tile)[:(len(word_rows(tile)) if tile > 3 else 60)]
    want = brute_variants(rows)
    assert any(f for _, f, *_ in want) and any(f and r != f for _, f, r, *_ in want) if tile > 3 else want
    assert variants(spelling.group_variants(table(spark, rows)).collect()) == want


def test_variants_of_nothing(spark):
    assert spelling.group_variants(table(spark, [(1, None), (2, "")])).count() == 0
    assert spelling.group_variants(table(spark, []).limit(0)).count() == 0


def test_word_that_is_its_own_form_s_form(spark):
    rows = [(1, "correction " * 200), (2, "corrections " * 20), (3, "correctionsx " * 2)]  # a chain of two forms
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.group_variants(table(spark, rows)).collect()}
    want = {w: (f or None, r) for w, f, r, *_ in brute_variants(rows)}
    assert got == want and got["correctionsx"] == ("corrections", "correction")


def test_token_counts_against_the_library(spark):
    tokenizer, rng = Tokenizer.from_file(PATH), random.Random(3)
    pool = ["a", "b", " ", "\n", "\t", "1", "é", "中", "😀", "'s", "'ll", " ", "　", "\x1c", "\x85", "<|endoftext|>", "xyz" * 20, "aaaa", "--", "ß", "́", "٣", "​", "\x0b"]
    texts = [None, "", " ", "z" * 30000, " " * 5000, "ab" * 3000, "".join(rng.choice("abcdefghij") for _ in range(20000))]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 80))) for _ in range(800)] + ["word " * 1024, "word " * 1025]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(table(spark, list(enumerate(texts))), PATH).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 1024), i
    odd = token_counts.count_tokens(table(spark, [(None, "a b"), (None, "a b")]), PATH).collect()
    assert [r["n_tokens"] for r in odd] == [2, 2]
    assert token_counts.count_tokens(table(spark, []).limit(0), PATH).count() == 0


def test_merges_out_of_order_are_refused():
    spec = '{"added_tokens": [], "model": {"vocab": {%s, "abc": 300, "bc": 301}, "merges": ["a bc", "b c"]}}'
    letters = ", ".join(f"{__import__('json').dumps(c)}: {b}" for c, b in token_counts.byte_letters().items())
    with pytest.raises(ValueError):
        token_counts.Merges((spec % letters).encode())


def brute_search(docs, items, k):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    counted = [(i, Counter(find(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df, out = Counter(t for _, c in counted for t in c), []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(find(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket", [4096, 7])
def test_search_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 4096 if bucket > 7 else 20)
    rng = random.Random(bucket)
    words = ["Alpha", "beta", "gamma", "DELTA", "été", "中文", "x1", "the", "of", "rare\u0001word"] + [f"w{i}" for i in range(60)]
    make = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "_", "\n"]) for _ in range(n))
    docs = [(i, make(rng.randint(1, 60))) for i in range(300)]
    docs += [(400 + i, docs[0][1]) for i in range(30)] + [(7, docs[7][1]), (None, docs[0][1]), (500, None), (501, "--- !"), (502, make(20000))]
    items = [(1, docs[0][1][:80]), (2, "alpha beta"), (2, "alpha beta"), (2, "ALPHA gamma"), (3, None), (4, "none of these xyzzy"), (None, "été 中文"), (5, docs[0][1]), (6, "the the the")]
    have = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, key1 string, rank long")
    got = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.search(table(spark, docs), have).collect()), key=str)
    assert got == brute_search(docs, items, 10)
    assert len(lexical.search(table(spark, docs), have, k=2).collect()) == len(brute_search(docs, items, 2))


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert lexical.search(table(spark, []).limit(0), items).count() == 0
    assert lexical.search(table(spark, [(1, "alpha"), (2, "beta")]), items.limit(0)).count() == 0
    assert lexical.search(table(spark, [(1, None), (2, "beta")]), items.filter(F.col("item_id") == 1)).count() == 0
