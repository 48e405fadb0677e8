"""Import jobs as streams: deduplicated ingest, job status from events, recovery, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stages of an import job and the progress each reports.
STAGES = {"parsing": 5, "chunking": 35, "indexing": 50, "wiki": 80, "completed": 100}


def latest_status(events: DataFrame, key: str, status: str, at: list[str]) -> DataFrame:
    """``(key, status, events)``: each key's status at its last event."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*at)).alias("status"), F.count("*").alias("events"))


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs after a crash: what was running is queued again."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status")))


def claimable(jobs: DataFrame, limit: int = 1) -> DataFrame:
    """The first queued jobs, oldest first."""
    return jobs.where("status = 'queued'").orderBy("job_id").limit(limit)


def retried(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Failed jobs among ``ids(job_id)`` back in the queue; others stay as they are."""
    asked = ids.select("job_id", F.lit(True).alias("asked")).distinct()
    again = F.coalesce("asked", F.lit(False)) & (F.col("status") == "failed")
    return jobs.join(asked, "job_id", "left").withColumn("status", F.when(again, "queued").otherwise(F.col("status"))).drop("asked")


def with_progress(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("progress", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in STAGES.items() for x in p]), F.col("stage")), F.lit(0)))


def ingest(stream: DataFrame, table: str, checkpoint: str, trigger: dict | None = None):
    """Appends a stream of ``(doc_id, text, ...)`` to a table, one row per content: within a batch the smallest id, across
    batches what the table doesn't hold. A replayed batch finds its own rows and adds none. The table is partitioned by the
    hash's beginning (``bucket``), so a batch reads the hashes of its own buckets alone."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
        first = rows.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))
        new = rows.join(first, ["sha256", "doc_id"], "left_semi").dropDuplicates(["sha256"])
        new = new.withColumn("bucket", F.substring("sha256", 1, 2))
        if _exists(spark, table):
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most 256
            known = spark.read.option("basePath", table).schema("sha256 string, bucket string").parquet(table).where(F.col("bucket").isin(*touched))
            new = new.join(known.select("sha256"), "sha256", "left_anti")
        new.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(table)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event type and tumbling window; late rows are dropped after the watermark in a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
