"""Precision, recall and F1 of detections against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions.text import nfkc


def compare(preds: DataFrame, expected: DataFrame, normalize=nfkc) -> DataFrame:
    """One row per (case, normalised text) on either side, with outcome tp, fp or fn.

    `preds` has (case_id, ord, text, type), `expected` (case_id, text, type). Of several
    predictions with one normalised text the first counts.
    """
    p = (preds.withColumn("norm", normalize(F.col("text"))).groupBy("case_id", "norm")
         .agg(F.min(F.struct("ord", F.col("text").alias("text"), F.col("type").alias("type"))).alias("p")))
    e = (expected.withColumn("norm", normalize(F.col("text"))).groupBy("case_id", "norm")
         .agg(F.max(F.struct(F.col("text").alias("text"), F.col("type").alias("type"))).alias("e")))
    joined = p.join(e, ["case_id", "norm"], "full_outer")
    outcome = F.when(F.col("p").isNotNull() & F.col("e").isNotNull(), "tp").when(F.col("p").isNotNull(), "fp").otherwise("fn")
    return joined.select("case_id", "norm", outcome.alias("outcome"),
                         F.coalesce("p.text", "e.text").alias("text"), F.col("p.type").alias("pred_type"), F.col("e.type").alias("true_type"))


def _counts() -> list[Column]:
    return [F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")]


def per_case(compared: DataFrame) -> DataFrame:
    return compared.groupBy("case_id").agg(*_counts())


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def overall(compared: DataFrame) -> DataFrame:
    """One row of counts, precision, recall, F1 and type accuracy over typed matches."""
    typed = (F.col("outcome") == "tp") & (F.coalesce("true_type", F.lit("")) != "")
    c = compared.agg(*_counts(), F.count_if(typed).alias("_typed"),
                     F.count_if(typed & (F.col("pred_type") == F.col("true_type"))).alias("_right"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    scored = c.withColumns({"precision": precision, "recall": recall, "type_accuracy": ratio(F.col("_right"), F.col("_typed"))})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.withColumn("f1", f1).select("tp", "fp", "fn", "precision", "recall", "f1", "type_accuracy")


def fp_fn_detail(compared: DataFrame) -> DataFrame:
    return (compared.filter("outcome <> 'tp'")
            .select("case_id", "outcome", "text", F.coalesce("pred_type", "true_type").alias("type")))
