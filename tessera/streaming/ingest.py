"""Incremental ingest as a stream of files: new and changed texts are merged into the store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx

ARRIVALS = "collection string, path string, body string, ts timestamp"


def arrivals(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """A stream of (collection, path, body, ts) from JSON files that appear in a folder."""
    return spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", per_trigger).json(path)


def latest(batch: DataFrame) -> DataFrame:
    """Of a batch's arrivals of the same file the last."""
    n = F.row_number().over(Window.partitionBy("collection", "path").orderBy(F.desc("ts"), F.desc("body")))
    return batch.withColumn("n", n).where("n = 1").drop("n")


def merge_batch(spark: SparkSession, store: str):
    """A function for foreachBatch that writes a batch's version of the store's log; running a batch again changes nothing."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = latest(batch).select("collection", "path", tx.title(F.col("path"), F.col("body")).alias("title"), F.sha2("body", 256).alias("hash"), "body", "ts", F.lit(batch_id).cast("long").alias("batch_id"))
        rows.write.mode("overwrite").parquet(f"{store}/batch={batch_id:012d}")

    return merge


def current(spark: SparkSession, store: str) -> DataFrame:
    """The newest row of every file over all batches."""
    rows = spark.read.option("basePath", store).parquet(f"{store}/batch=*")
    best = rows.groupBy("collection", "path").agg(F.max_by(F.struct("title", "hash", "body", "ts"), F.struct("batch_id", "ts")).alias("b"))
    return best.select("collection", "path", "b.title", "b.hash", "b.body", "b.ts")


def start(spark: SparkSession, source: str, store: str, checkpoint: str):
    """A query that takes what is there and stops."""
    return arrivals(spark, source).writeStream.foreachBatch(merge_batch(spark, store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals_by_window(stream: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, collection, files, bytes) of arrivals; what comes later than allowed is dropped by the watermark."""
    windowed = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "collection")
    return windowed.agg(F.approx_count_distinct("path").alias("files"), F.sum(F.octet_length("body")).alias("bytes"))


def new_contents(batch: DataFrame, known: DataFrame) -> DataFrame:
    """(hash, body) of a batch that has no vector yet."""
    return batch.groupBy("hash").agg(F.first("body").alias("body")).join(known.select("hash"), "hash", "left_anti")
