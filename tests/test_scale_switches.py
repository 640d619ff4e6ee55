"""Results do not depend on the size of a mapping or on ordinals that files share."""

from pyspark.sql import functions as F

from veilwork.config import MaskConfig
from veilwork.operators.restore import unmask
from veilwork.plans.mask import mask_units
from veilwork.sources.units import units_from_table


def test_odd_keys_are_restored_beyond_the_inline_size(spark, units):
    odd = [("[PERSON_1]", "甲"), ("[PERSON_12]", "乙"), ("[TEAM_001]", "丙")]
    text = "x [PERSON_1] y [PERSON_12] z [TEAM_001] [COMPANY_005]"
    for filler in (10, 200):
        rows = odd + [(f"[COMPANY_{i:03d}]", f"c{i}") for i in range(1, filler)]
        mapping = spark.createDataFrame([(*r, "text") for r in rows], "token string, original string, kind string")
        assert unmask(units([text]), mapping).first()["restored"] == "x 甲 y 乙 z 丙 c5"


def test_units_of_other_files_with_the_same_ordinals_stay(spark):
    df = spark.createDataFrame([("a", 0, 0, "电话 13812345678 联系"), ("b", 0, 0, "nothing"), ("c", 0, 1, "nothing too")],
                               "f string, fo long, uo long, text string")
    run = mask_units(units_from_table(df, F.col("f"), F.col("fo"), F.col("uo"), F.col("text")), MaskConfig(mode="smart"))
    got = {r["file"]: r["masked_text"] for r in run.masked.collect()}
    assert got["b"] == "nothing" and got["c"] == "nothing too" and "13812345678" not in got["a"]
