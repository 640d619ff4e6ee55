"""File listings, mapping and report tables, batch history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.functions.names import file_class
from veilwork.operators.reports import report_entries, report_summary
from veilwork.operators.review import newest
from veilwork.schema import HISTORY, MAPPING


def list_files(spark: SparkSession, path: str, out_dir: str | None = None) -> DataFrame:
    """(path, length, class) of every file below `path`; contents are never read."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length"))
    if out_dir:
        found = found.filter(~F.contains("path", F.lit(out_dir.rstrip("/") + "/")))
    return classify_format(found)


def classify_format(listing: DataFrame, path: str = "path") -> DataFrame:
    return listing.withColumn("class", file_class(F.col(path)))


def write_mapping(mapping: DataFrame, path: str) -> None:
    """One folder per batch, so a batch can be read, replaced or dropped alone."""
    (mapping.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def read_mapping_table(spark: SparkSession, path: str, batch_id: str | None = None) -> DataFrame:
    rows = spark.read.schema(MAPPING).parquet(path)
    return rows if batch_id is None else rows.filter(F.col("batch_id") == batch_id)


ENTRY = "struct<original:string,type:string,confidence:double,fingerprint:string,batch_id:string,kind:string>"


def read_mapping_json(docs: DataFrame, col: str = "json") -> DataFrame:
    """(doc columns..., token, original, type, kind, fingerprint) from interchange JSON, one document per row.

    Accepts an object with `tokens`, a bare token -> original object, and a list of objects.
    Missing fields take their defaults.
    """
    keys = [c for c in docs.columns if c != col]
    j = F.col(col)
    inner = F.get_json_object(j, "$.tokens")
    is_list = F.ltrim(F.coalesce(inner, j)).startswith("[")
    body = F.coalesce(inner, j)
    listed = F.transform(F.from_json(F.when(is_list, body), "array<struct<token:string,original:string,kind:string,type:string,fingerprint:string>>"),
                         lambda x: F.struct(x["token"].alias("token"), x["original"].alias("original"), x["kind"].alias("kind"),
                                            x["type"].alias("type"), x["fingerprint"].alias("fingerprint")))
    # Values are read as JSON text: a quoted string is an original, an object holds one.
    raw = F.from_json(F.when(~is_list, body), "map<string,string>")
    mapped = F.transform(F.map_entries(raw), lambda e: F.struct(
        e["key"].alias("token"),
        F.when(F.ltrim(e["value"]).startswith("{"), F.get_json_object(e["value"], "$.original")).otherwise(e["value"]).alias("original"),
        F.get_json_object(e["value"], "$.kind").alias("kind"), F.get_json_object(e["value"], "$.type").alias("type"),
        F.get_json_object(e["value"], "$.fingerprint").alias("fingerprint")))
    rows = docs.select(*keys, F.explode(F.coalesce(listed, mapped)).alias("m"))
    return (rows.select(*keys, "m.token", "m.original", F.coalesce("m.type", F.lit("custom")).alias("type"),
                        F.coalesce("m.kind", F.lit("text")).alias("kind"), F.coalesce("m.fingerprint", F.lit("")).alias("fingerprint"))
            .filter("token is not null and original is not null"))


def write_report(inputs: DataFrame, rows: DataFrame, path: str, stats: DataFrame | None = None, compression: str = "none") -> None:
    """Summary, entries (one folder per list; `compression` is a codec of Spark's JSON files) and, if the model was called, its statistics.

    `inputs` and `rows` are read twice: stage them if they are dear."""
    report_summary(inputs, rows).write.mode("overwrite").json(f"{path}/summary")
    report_entries(rows).write.mode("overwrite").partitionBy("section").json(f"{path}/entries", compression=compression)
    inputs.select("file").distinct().write.mode("overwrite").json(f"{path}/input_files")
    if stats is not None and not stats.filter("calls > 0 or errors > 0").isEmpty():
        stats.write.mode("overwrite").json(f"{path}/llm_stats")


def merge_paths(paths: DataFrame, path: str, batch_id: str) -> DataFrame:
    """Write path_mapping rows beside the batch's tokens; returns their count as metadata."""
    out = f"{path}/batch_id={batch_id}"
    paths.write.mode("overwrite").parquet(out)
    return paths.agg(F.count(F.lit(1)).alias("total_path_mappings")).withColumn("batch_id", F.lit(batch_id))


def history_append(records: DataFrame, path: str) -> None:
    records.select(*HISTORY.fieldNames()).write.mode("append").parquet(path)


def history_load(spark: SparkSession, path: str, keep: int | None = None) -> DataFrame:
    """All batches, or the newest `keep`; fields missing from older files read as null."""
    history = spark.read.schema(HISTORY).parquet(path)
    return history if keep is None else newest(history, keep)


def write_masked(masked: DataFrame, confirmed: DataFrame, path: str) -> None:
    """Masked units, with files nobody confirmed kept apart in their own folder."""
    from veilwork.operators.paths import quarantine
    quarantine(masked, confirmed).write.mode("overwrite").partitionBy("disposition").parquet(path)
