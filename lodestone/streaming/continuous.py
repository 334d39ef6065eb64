"""Continuous forms: a pattern scan over a landing folder, and windowed counts of events with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.incremental import upserted
from ..operators.scan import pattern_hits


def landing(spark: SparkSession, path: str, schema: StructType, files_each: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window start, event_type, n, total of events(ts, event_type, value). Works on a stream and, with the same result once the watermark has passed, on a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def first_deliveries(findings: DataFrame, late: str = "1 day") -> DataFrame:
    """The first delivery of each finding id within the watermark on loaded_at."""
    return findings.where("finding_id is not null and loaded_at is not null").withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["finding_id"])


def continuous_scan(files: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Pattern hits of each micro-batch of files(path, content) handed to sink(hits, batch number); runs until all that is there is read."""
    return files.writeStream.foreachBatch(lambda df, n: sink(pattern_hits(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserting(table: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the latest row of each key in versions of a parquet table: version n is made of version n - 1 and the batch,
    so a batch that is run again gives the same version again."""

    def sink(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        current = spark.read.parquet(f"{table}/v{n - 1}") if n else df.limit(0)
        upserted(current, df, keys, order).write.mode("overwrite").parquet(f"{table}/v{n}")

    return sink
