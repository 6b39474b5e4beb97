"""Archives as streams: new files as they come, with rollups by event time.

The engine that this one follows only stamps records with their dates; watermarks and windows over these dates are an addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.warc import register


def stream_warcs(spark: SparkSession, path: str, late: str | None = None, **options) -> DataFrame:
    """Records of files as they appear. With late, records that are so much older than the newest are dropped by windowed rollups."""
    register(spark)
    df = spark.readStream.format("warc").options(**{k: str(v) for k, v in options.items()}).load(path)
    return df.withWatermark("record_date", late) if late else df


def hourly_types(records: DataFrame, every: str = "1 hour") -> DataFrame:
    """(window_start, record_type, n, bytes), for batches and streams."""
    return records.groupBy(F.window("record_date", every).alias("w"), "record_type").agg(F.count("*").alias("n"), F.sum("block_length").alias("bytes")).select(F.col("w.start").alias("window_start"), "record_type", "n", "bytes")
