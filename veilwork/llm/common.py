"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below `spark.checkpoint.dir`, which the driver and all executors see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back: later steps never recompute it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A form of `staged` for tables that only steps inside the block read: they share one folder, which goes when the block ends. What
    outlives the block must be written by then; a lost executor reads that again, never what is gone."""
    folder = shared_path(spark, name)

    def put(df: DataFrame, part: str) -> DataFrame:
        path = f"{folder}/{part}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield put
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Text without other letters takes the quick way of `lower`, which is the same there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_keys(*columns: str) -> list[Column]:
    """Two 64-bit hashes of different seeds: 128 bits that name a row by its content. Rows that repeat share them. The hash skips
    nulls, so which columns are null is hashed too."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns])
    return [F.xxhash64(nulls, *columns).alias("key1"), F.xxhash64(F.lit("second"), nulls, *columns).alias("key2")]


MAP_BITS = 1 << 25  # bits of a map of keys: 4 MB, whatever their number


def marked(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """`rows` with the boolean `name`: whether `key` may be in the one column of `keys`. Always true if it is; seldom true if not, as long as
    there are few keys to MAP_BITS. Nothing of `rows` is shuffled: at most MAP_BITS / 32768 bitmaps of 4 kB are broadcast."""
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(MAP_BITS)) + 1
    bits = (keys.select(place(F.col(keys.columns[0])).alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("_bucket"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("_bits")))
    found = rows.withColumn("_place", place(key)).withColumn("_bucket", F.expr("bitmap_bucket_number(_place)")).join(F.broadcast(bits), "_bucket", "left")
    at = F.expr("cast(bitmap_bit_position(_place) as int)")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.expr("cast(1 as int)").bitwiseAND(F.call_function("shiftright", byte, F.pmod(at, F.lit(8)))) == 1
    return found.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_place", "_bucket", "_bits")
