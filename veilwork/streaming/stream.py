"""Structured Streaming forms of the masking job."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.config import MaskConfig
from veilwork.operators.detect import detect
from veilwork.operators.replace import apply_plain, register_mapping, resolved_units, token_spans
from veilwork.operators.tokens import first_uses, number_rows, reserved_numbers, scan_tokens, token_text
from veilwork.plans.mask import attach_tokens
from veilwork.schema import MAPPING, UNIT_KEY
from veilwork.session import stage


def mask_stream_stateless(units: DataFrame, cfg: MaskConfig, lexicon: DataFrame | None = None) -> DataFrame:
    """Append-mode masking for a run that keeps no mapping.

    Entities become `***`; with `amount_mode` fuzzy or fixed and `irreversible` off, amounts are
    replaced and other entities stay as they are, because a token would need state.
    """
    return apply_plain(detect(units, cfg, lexicon), cfg)


class ReversibleMasker:
    """foreachBatch writer that needs no state store: one original keeps one token over all micro-batches, at the cost of a join with the
    mapping so far. For long streams see `stateful.mask_stream_reversible`, whose micro-batches do not read it.

    Mapping rows of a micro-batch go to their own folder, written by overwrite, and a batch only
    reads folders of earlier batches. A batch replayed after a failure thus numbers the same
    originals from the same offsets and rewrites its own folder.
    """

    def __init__(self, mapping_path: str, out_path: str, cfg: MaskConfig, lexicon: DataFrame | None = None):
        if cfg.style == "alias":
            raise ValueError("a stream cannot use aliases: later texts may hold the alias; use style='token'")
        self.mapping_path, self.out_path, self.cfg, self.lexicon = mapping_path, out_path, cfg, lexicon

    def known(self, spark: SparkSession, before: int) -> DataFrame:
        schema = T.StructType([*MAPPING.fields, T.StructField("number", T.LongType())])
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.mapping_path)
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(f"{_ddl(schema)}, epoch bigint").parquet(self.mapping_path)
        return rows.filter(F.col("epoch") < before).drop("epoch")

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        cfg = self.cfg
        detected = detect(batch, cfg, self.lexicon)
        resolved = stage(resolved_units(detected, cfg))
        known = self.known(spark, epoch)
        first = first_uses(token_spans(resolved, cfg))
        fresh = stage(first.join(known.select("original"), "original", "left_anti"))
        numbered = number_rows(fresh, "type", ["file_ord", "unit_ord", "start"])
        offset = known.groupBy("type").agg(F.max("number").alias("_last"))  # at most eight rows
        numbered = numbered.join(F.broadcast(offset), "type", "left").withColumn("k", F.col("k") + F.coalesce("_last", F.lit(0)))
        taken = reserved_numbers(scan_tokens(batch)).join(known.select("type", "number"), ["type", "number"], "left_anti")
        numbered = skip_after(numbered, taken)
        minted = numbered.withColumn("token", token_text(F.col("type"), F.col("number")))
        rows = register_mapping(minted, cfg.batch_id or str(epoch), F.lit(datetime.now(timezone.utc)))
        rows = rows.join(minted.select("original", "number"), "original").select(*MAPPING.names, "number")
        rows.write.mode("overwrite").parquet(f"{self.mapping_path}/epoch={epoch}")
        uses = first.select("original", "uses")
        both = known.select("original", "token").unionByName(minted.select("original", "token")).join(uses, "original")
        both = stage(both)
        hit = attach_tokens(resolved, both, both.count(), cfg)
        clean = detected.join(resolved.select(*UNIT_KEY), list(UNIT_KEY), "left_anti").select(
            *UNIT_KEY, "text", F.col("text").alias("masked_text"))
        hit.unionByName(clean).write.mode("overwrite").parquet(f"{self.out_path}/epoch={epoch}")


def skip_after(numbered: DataFrame, taken: DataFrame) -> DataFrame:
    """k-th free number above the offset; numbers at or below it were settled by earlier batches."""
    from veilwork.operators.tokens import skip_reserved
    last = numbered.groupBy("type").agg((F.min("k") - 1).alias("_floor"))
    above = taken.join(F.broadcast(last), "type").filter(F.col("number") > F.col("_floor"))
    shifted = above.select("type", (F.col("number") - F.col("_floor")).alias("number"))
    local = numbered.join(F.broadcast(last), "type").withColumn("k", F.col("k") - F.col("_floor"))
    done = skip_reserved(stage(local), shifted)
    return done.withColumn("number", F.col("number") + F.col("_floor")).drop("_floor")


def _ddl(schema) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
