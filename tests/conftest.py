import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    return s


@pytest.fixture(scope="session")
def units(spark):
    """Make text units from a list of texts, all in one file."""
    from pyspark.sql import functions as F

    from veilwork.sources.units import units_from_table

    def make(texts, file="f"):
        df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        return units_from_table(df, F.lit(file), F.lit(0), F.col("id"), F.col("text"))
    return make
