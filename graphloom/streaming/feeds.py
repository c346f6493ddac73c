"""Change feeds and event windows with Structured Streaming (rows S1-S4, S8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """New files of a folder; timestamps without a zone become UTC instants, which watermarks need."""
    out = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return out.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(E: DataFrame, width: str, late: str) -> DataFrame:
    """S8."""
    return E.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sliding(E: DataFrame, width: str, step: str, late: str) -> DataFrame:
    return E.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"))


def debounced(changes: DataFrame, quiet: str, late: str) -> DataFrame:
    """The changes of a path until it has been quiet: one row with the number of changes and the last kind."""
    last = F.max_by("kind", "ts").alias("kind")
    return changes.withWatermark("ts", late).groupBy(F.session_window("ts", quiet), "path").agg(F.count("*").alias("n"), last)


def distinct_within(E: DataFrame, keys: list[str], late: str) -> DataFrame:
    return E.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def upsert_sink(target: str, keys: list[str], version: str | None = None, buckets: int = 64):
    """A foreachBatch function that merges each batch into the keyed table in ``target``, made by the first one.

    Only the buckets of a batch's keys are rewritten. A stream may begin at any
    batch, and one that is delivered again changes nothing. Of rows of one key the largest
    ``version`` stays; without one, the number of the batch counts as version.
    """
    from ..operators.store import KeyedTable

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch if version else batch.withColumn("batch", F.lit(batch_id).cast("long"))
        table = KeyedTable(spark, target)
        if not table.files.names("manifests"):
            table = KeyedTable.create(spark, target, rows.schema, keys, version or "batch", buckets)
        table.upsert(rows, "feed", batch_id)

    return merge


def reindex(E: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """S3: the changed files' elements are deleted, then the fresh ones inserted."""
    return E.join(changed.select("file_path").distinct(), "file_path", "left_anti").unionByName(fresh, allowMissingColumns=True)
