"""A cross-section of the registered queries against their SQL twins, on the smallest tables."""

import os
import re
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"
NAMES = ("a2_scan_docx", "a3_scan_xlsx", "a11_read_mapping", "b1_dictionary_ngram", "b8_email", "b10_card", "b13_dedup_channels", "b24_path_filter",
         "b31_rich_text", "c5_validate", "c8_chunks", "c9_accept_proposals", "d6_dropped", "d7_reserved_tokens", "d13_replacements", "d17_mask_documents",
         "e1_unmask", "f5_conflicts", "f9_diff_tree", "g6_evaluate", "h13_kwic_locate", "j1_stream_stateless")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    text, ok = compare(spark, con, name, SF)
    assert ok, text


def test_every_query_has_a_known_check():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    own = {n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)}  # the training-data queries have their own tests
    assert own - set(entry.oracle_sql()) == {"f4_plan_tree"}


def test_flagship(spark):
    import __spark_entry__ as entry
    rows = entry.entry(spark).collect()
    assert len(rows) == 200 and all(r["same"] for r in rows) and any(r["original"] != r["masked"] for r in rows)
