"""Tokens stay the same over micro-batches, also when a batch is replayed."""

import pytest

from veilwork.config import MaskConfig
from veilwork.streaming.stateful import mask_stream_reversible
from veilwork.streaming.stream import ReversibleMasker


def test_batches_share_tokens(spark, units, tmp_path):
    cfg = MaskConfig()
    writer = ReversibleMasker(str(tmp_path / "map"), str(tmp_path / "out"), cfg)
    one = units(["打13812345678", "打13900000000见[CUSTOM_002]"])
    two = units(["先13700000000再13812345678", "无", "[CUSTOM_005] 13600000000 13500000000"], file="g")
    writer(one, 0)
    writer(two, 1)

    def tokens():
        rows = spark.read.parquet(str(tmp_path / "map")).select("original", "token").collect()
        assert len(rows) == len({r["original"] for r in rows}) == len({r["token"] for r in rows})
        return {r["original"]: r["token"] for r in rows}
    first = tokens()
    assert first == {"13812345678": "[CUSTOM_001]", "13900000000": "[CUSTOM_003]", "13700000000": "[CUSTOM_004]",
                     "13600000000": "[CUSTOM_006]", "13500000000": "[CUSTOM_007]"}
    writer(two, 1)
    assert tokens() == first
    out = {(r["epoch"], r["unit_ord"]): r["masked_text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out[1, 0] == "先[CUSTOM_004]再[CUSTOM_001]" and out[1, 1] == "无"


def file_stream(spark, folder):
    return spark.readStream.schema("file string, file_ord long, unit_ord long, text string").option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.mark.parametrize("buckets", [1, 4])
def test_state_keeps_tokens_over_batches_and_restarts(spark, tmp_path, buckets):
    def add(n, texts):
        rows = [(f"f{n}", n, i, t) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "file string, file_ord long, unit_ord long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        mask_stream_reversible(file_stream(spark, tmp_path / "in"), str(tmp_path / "map"), str(tmp_path / "out"), str(tmp_path / "state"), MaskConfig(), buckets=buckets).awaitTermination()

    texts = [["打13812345678", "打13900000000见[CUSTOM_002]"], ["先13700000000再13812345678", "无", "[CUSTOM_005] 13600000000 13500000000"], ["13900000000", "13500000000与13400000000"]]
    add(0, texts[0])
    run()
    add(1, texts[1])
    add(2, texts[2])
    run()  # two micro-batches, with the state of the run before
    rows = spark.read.parquet(str(tmp_path / "map")).select("original", "token", "epoch").collect()
    tokens = {r["original"]: r["token"] for r in rows}
    assert len(rows) == len(tokens) == len(set(tokens.values())) == 6 and {r["epoch"] for r in rows} <= {0, 1, 2}
    assert not {"[CUSTOM_002]", "[CUSTOM_005]"} & set(tokens.values())
    if buckets == 1:  # numbered by first use
        assert [tokens[f"13{x}"] for x in ("812345678", "900000000", "700000000", "600000000", "500000000", "400000000")] == [f"[CUSTOM_{i:03d}]" for i in (1, 3, 4, 6, 7, 8)]
    out = {(r["file_ord"], r["unit_ord"]): r["masked_text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    for n, some in enumerate(texts):
        for i, t in enumerate(some):
            for original, token in tokens.items():
                t = t.replace(original, token)
            assert out[n, i] == t
    assert len(out) == 7


def test_aliases_are_refused(spark, tmp_path):
    spark.createDataFrame([("f", 0, 0, "x")], "file string, file_ord long, unit_ord long, text string").write.parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        mask_stream_reversible(file_stream(spark, tmp_path / "in"), "a", "b", "c", MaskConfig(style="alias"))
    with pytest.raises(ValueError):
        ReversibleMasker("a", "b", MaskConfig(style="alias"))


@pytest.mark.parametrize("files", [0, 3])
def test_documents_stream_from_a_file_and_from_a_folder(spark, tmp_path, files):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from veilwork.plans.catalog_review import document_stream, j1_stream_stateless, j2_stream_reversible
    rows = pa.table({"doc_id": pa.array(range(6), pa.int64()), "text": [f"call 1381234567{i}" for i in range(5)] + [None], "lang": ["en"] * 6,
                     "source": ["s"] * 6, "n_chars": pa.array([16] * 6, pa.int64())})
    target = tmp_path / "documents.parquet"
    if files:
        target.mkdir()
        for i in range(files):
            pq.write_table(rows.slice(2 * i, 2), target / f"part-{i}.parquet")
    else:
        pq.write_table(rows, target)
    pq.write_table(rows, tmp_path / "documents.parquet.old")  # another table
    assert document_stream(spark, str(tmp_path)).isStreaming
    hidden = {r["file_ord"]: r["masked_text"] for r in j1_stream_stateless(spark, str(tmp_path)).collect()}
    assert hidden == {i: "call ***" for i in range(5)}
    tokens = [r["masked_text"] for r in j2_stream_reversible(spark, str(tmp_path)).collect()]
    assert sorted(tokens) == [f"call [CUSTOM_00{i}]" for i in range(1, 6)]
