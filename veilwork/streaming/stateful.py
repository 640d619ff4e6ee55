"""Reversible masking of a stream: tokens live in the state store, so a micro-batch costs what it brings, whatever came before."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from veilwork.config import MaskConfig
from veilwork.operators.detect import detect
from veilwork.operators.replace import register_mapping, resolved_units, token_spans
from veilwork.operators.tokens import token_numbers, token_text, tokens_in
from veilwork.plans.mask import attach_tokens
from veilwork.schema import UNIT_KEY
from veilwork.session import stage

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANSWER = "what string, original string, type string, number long, source string, confidence double, uses long, fresh boolean"


class Numbering(StatefulProcessor):
    """State of one bucket of originals: the type and number of each, the last number per type, and numbers that texts already use.

    Bucket b of n gives the numbers b + 1, b + 1 + n, b + 1 + 2n and so on, so buckets never meet and need not ask each other.
    """

    def __init__(self, buckets: int):
        self.buckets = buckets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "original string", "type string, number long")
        self.last = handle.getMapState("last", "type string", "number long")
        self.reserved = handle.getMapState("reserved", "type string, number long", "there boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        taken = frame[frame["what"] == "reserved"]
        for type_, number in sorted(set(zip(taken["type"], taken["number"].astype("int64")))):
            self.reserved.updateValue((type_, int(number)), (True,))
        spans = frame[frame["what"] == "span"].sort_values(["file_ord", "unit_ord", "start"], kind="stable")
        uses = spans["original"].value_counts()
        answers = []
        for row in spans.drop_duplicates("original").itertuples():
            fresh = not self.known.containsKey((row.original,))
            if fresh:
                self.known.updateValue((row.original,), (row.type, self.next(row.type, int(key[0]))))
            type_, number = self.known.getValue((row.original,))
            answers.append(("token", row.original, type_, number, row.source, row.confidence, int(uses[row.original]), fresh))
        yield pd.DataFrame(answers, columns=[c.split()[0] for c in ANSWER.split(", ")])

    def next(self, type_: str, bucket: int) -> int:
        number = self.last.getValue((type_,))[0] if self.last.containsKey((type_,)) else bucket + 1 - self.buckets
        number += self.buckets
        while self.reserved.containsKey((type_, number)):
            number += self.buckets
        self.last.updateValue((type_,), (number,))
        return number

    def close(self) -> None:
        pass


def numbered_spans(resolved: DataFrame, units: DataFrame, cfg: MaskConfig, buckets: int) -> DataFrame:
    """The distinct originals of each micro-batch with their type and number, from the state of their bucket."""
    spans = token_spans(resolved, cfg).select(
        F.lit("span").alias("what"), F.col("text").alias("original"), "type", F.lit(None).cast("long").alias("number"), "source", "confidence", "file_ord", "unit_ord",
        F.col("start").cast("long").alias("start"), F.pmod(F.xxhash64("text"), F.lit(buckets)).cast("int").alias("bucket"))
    inside = token_numbers(units.select(F.explode(tokens_in(F.col("text"))).alias("token")))
    none = {"original": "string", "source": "string", "confidence": "double", "file_ord": "long", "unit_ord": "long", "start": "long"}
    reserved = inside.withColumns({c: F.lit(None).cast(t) for c, t in none.items()}).withColumn("what", F.lit("reserved")).withColumn(
        "bucket", F.pmod(F.col("number") - 1, F.lit(buckets)).cast("int"))
    return (spans.unionByName(reserved).groupBy("bucket")
            .transformWithStateInPandas(Numbering(buckets), ANSWER, "Append", "None"))


def mask_stream_reversible(units: DataFrame, mapping_path: str, out_path: str, checkpoint: str, cfg: MaskConfig,
                           lexicon: DataFrame | None = None, buckets: int = 1):
    """Start a query that masks each micro-batch with tokens shared by the whole stream.

    `buckets` is fixed for the life of a stream: originals are dealt to so many keys of the state store. One bucket numbers originals in
    order of first use, as the batch job does; more of them spread the work and leave gaps between numbers. Tokens that a text
    brings along are never given to another original from that micro-batch on.

    A micro-batch writes its masked units and its new mapping rows to folders of its own, by overwrite. The state store gives a
    replayed micro-batch the same numbers, so it rewrites the same rows; no micro-batch reads the mapping. Aliases need the whole corpus
    (no alias may occur in it), which a stream never has, so that style is refused.
    """
    if cfg.style == "alias":
        raise ValueError("a stream cannot use aliases: later texts may hold the alias; use style='token'")
    if cfg.irreversible:
        raise ValueError("an irreversible run keeps no mapping; use mask_stream_stateless")
    spark = units.sparkSession
    detected = detect(units, cfg, lexicon, positions=False)
    resolved = resolved_units(detected, cfg)
    tokens = numbered_spans(resolved, units, cfg, buckets)
    texts = resolved.select(F.lit("hit").alias("what"), *UNIT_KEY, "text", "kept").unionByName(
        detected.filter(F.size("hits") == 0).select(F.lit("clean").alias("what"), *UNIT_KEY, "text"), allowMissingColumns=True)
    hits = detected.filter(F.size("hits") > 0).select(F.lit("seen").alias("what"), *UNIT_KEY, "text")  # hits, but perhaps none to replace
    every = texts.unionByName(hits, allowMissingColumns=True).unionByName(tokens, allowMissingColumns=True)

    def write(batch: DataFrame, epoch: int) -> None:
        # Once: every read of a micro-batch would run its stateful part again.
        rows = stage(batch)
        minted = rows.filter("what = 'token'").withColumn("token", token_text(F.col("type"), F.col("number")))
        new = minted.filter("fresh")
        mapping = register_mapping(new, cfg.batch_id or str(epoch), F.lit(datetime.now(timezone.utc)))
        mapping.write.mode("overwrite").parquet(f"{mapping_path}/epoch={epoch}")
        hit = rows.filter("what = 'hit'").select(*UNIT_KEY, "text", "kept")
        masked = attach_tokens(hit, minted.select("original", "token", "uses"), minted.count(), cfg)
        spared = rows.filter("what = 'seen'").join(hit.select(*UNIT_KEY), list(UNIT_KEY), "left_anti")
        clean = rows.filter("what = 'clean'").unionByName(spared).select(*UNIT_KEY, "text", F.col("text").alias("masked_text"))
        masked.unionByName(clean).write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # a query keeps the settings it was started with
    try:
        return (every.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
