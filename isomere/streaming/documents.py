"""Coverage documents as they arrive: the same decoding as in batches, and windowed series of measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isomere.sources.documents import decode


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, body) of the files that come to a folder, one document a file."""
    rows = spark.readStream.format("text").option("wholetext", "true").load(path)
    return rows.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("body"))


def decoded_stream(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return decode(read_stream(spark, path))


def windowed(events: DataFrame, time: str, key: str, value: str, length: str, late: str) -> DataFrame:
    """A PointSeries of each key at window starts: count and mean of the values; rows later than `late` are left out."""
    grouped = events.withWatermark(time, late).groupBy(F.col(key), F.window(time, length).alias("w"))
    return grouped.agg(F.count(value).alias("n"), F.avg(value).alias("mean")).select(key, F.col("w.start").alias("t"), "n", "mean")
