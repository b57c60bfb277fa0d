"""Run scores as a stream: windowed aggregates with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCORES = "trace_id string, name string, number double, at timestamp"


def score_stream(spark: SparkSession, path: str) -> DataFrame:
    """Scores appended as Parquet files under a path."""
    return spark.readStream.schema(SCORES).parquet(path)


def windowed(scores: DataFrame, *, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(from, to, name, n, mean): each score's count and mean by window; rows later than ``late`` are left out."""
    by = scores.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "name").agg(F.count(F.lit(1)).alias("n"), F.avg("number").alias("mean"))
    return by.select(F.col("w.start").alias("from"), F.col("w.end").alias("to"), "name", "n", "mean")


def append(df: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Write a stream as Parquet with exactly-once files; ``once`` takes what is there and stops."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
