"""Shared-storage staging and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side with at most this many skinny rows (a key, a token and a few scalars, under 200 bytes
# each) may be broadcast: 200,000 rows stay below about 40 MB on every executor.
BROADCAST_ROWS = 200_000

# A key is hot when it owns more than 1/HOT_SHARE of the rows, so there are fewer than HOT_SHARE.
HOT_SHARE = 1_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; make a scratch one only for a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="veilwork-")
    sc.setCheckpointDir(folder)


# Folders staged inside the innermost running `settle`.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _own_shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffles of what runs inside go when it ends. Only for writes: these plan their table anew, so nothing reads their shuffles again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stage(df: DataFrame) -> DataFrame:
    """Write `df` once as Parquet below the checkpoint folder and cut its lineage there.

    Later steps read it several times, each only the columns it needs; a lost executor costs a
    re-read, never a recompute with other partition bounds.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"
    with _own_shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    if (folders := _PASSING.get()) is not None:
        folders.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(make: Callable[[], DataFrame | tuple[DataFrame, ...]]) -> DataFrame | tuple[DataFrame, ...]:
    """Stage what `make` returns, one table or several. Tables that were staged on the way go then, so nothing else may read them; a lost executor
    reads the result again, never what is gone."""
    folders: list[str] = []
    token = _PASSING.set(folders)
    try:
        made = make()
    finally:
        _PASSING.reset(token)
    out = tuple(map(stage, made)) if isinstance(made, tuple) else stage(made)
    spark = SparkSession.active()
    for folder in folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return out


def lookup_join(facts: DataFrame, dim: DataFrame, key: str, weight: str, dim_rows: int) -> DataFrame:
    """Inner join of `facts` to a one-row-per-key `dim` that survives hot keys.

    `dim[weight]` counts the fact rows of a key. A small `dim` (counted, not guessed) is
    broadcast whole. Otherwise only its hot keys are broadcast: fewer than HOT_SHARE of them can
    exist. The remaining facts meet the rest of `dim` in a shuffle join without a dominant key.
    """
    if dim_rows <= BROADCAST_ROWS:
        return facts.join(F.broadcast(dim.drop(weight)), key)
    total = dim.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) > F.lit(total // HOT_SHARE)
    cold = dim.filter(~is_hot).drop(weight)
    hot = dim.filter(is_hot).drop(weight).withColumn("_hot", F.lit(True))
    marked = facts.join(F.broadcast(hot), key, "left")
    done = marked.filter("_hot").drop("_hot")
    rest = marked.filter("_hot is null").select(*facts.columns).join(cold, key)
    return done.unionByName(rest)


def table_join(facts: DataFrame, dim: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """`facts.join(dim, key, how)` for inner, left, left_semi and left_anti that survives hot keys; `dim` has each key once.

    The uses of the keys are counted by a partial aggregate; only what `facts` use of `dim` goes on. See `lookup_join`; facts
    without a partner, null keys among them, never meet in one task. `facts` is read twice: stage it if it is dear.
    """
    uses = facts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_uses"))
    known = stage(dim.join(uses, key).withColumn("_there", F.lit(True)))
    rows = known.count()
    if rows <= BROADCAST_ROWS:
        return facts.join(F.broadcast(known.drop("_uses", "_there")), key, how)
    if how == "inner":
        return lookup_join(facts, known.drop("_there"), key, "_uses", rows)
    total = known.agg(F.sum("_uses")).first()[0]
    hot = known.filter(F.col("_uses") > total // HOT_SHARE).drop("_uses")
    cold = known.filter(F.col("_uses") <= total // HOT_SHARE).drop("_uses")
    marked = facts.join(F.broadcast(hot.withColumnRenamed("_there", "_hot")), key, "left")
    done, rest = marked.filter("_hot"), marked.filter("_hot is null").select(*facts.columns)
    absent = rest.filter(F.col(key).isNull())
    joined = rest.filter(F.col(key).isNotNull()).join(cold, key, "left")
    if how == "left_semi":
        return done.select(*facts.columns).unionByName(joined.filter("_there").select(*facts.columns))
    if how == "left_anti":
        return joined.filter("_there is null").select(*facts.columns).unionByName(absent)
    return done.drop("_hot").unionByName(joined.drop("_there")).unionByName(absent, allowMissingColumns=True)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer partitions than cores at least one per core; else leave it alone.

    Only small files are affected: a table of any size brings its own splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# Rows of a table that get a task of their own where each row costs much more than reading it.
DEAR_ROWS = 20_000


def deal(df: DataFrame, rows: int, per_task: int = DEAR_ROWS) -> DataFrame:
    """Deal `rows` skinny rows evenly, before something dear is made of each: a task per core at least, and one per `per_task` rows.

    The splits of a scan say little: a row group is read by one of them, however many there are, and the others stay empty.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task)))
