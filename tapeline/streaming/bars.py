"""Streaming ingestion of ticks into bars, an extension: files that are there are read once, late ones within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_ticks(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """A stream over a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def hourly_bars(ticks: DataFrame, ticker: str, at: str, price: str, order: str, late: str = "1 hour") -> DataFrame:
    """Hourly bars of a stream or a table; a bar is final once the watermark has passed it."""
    t = ticks.select(F.col(ticker).alias("ticker"), F.col(at).cast("timestamp").alias("at"), F.col(price).alias("price"), F.col(order).alias("nth")).withWatermark("at", late)
    out = t.groupBy("ticker", F.window("at", "1 hour").alias("hour")).agg(F.min_by("price", "nth").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "nth").alias("close"), F.count("*").alias("volume"))
    return out.select("ticker", F.col("hour.start").alias("bar_date"), "open", "high", "low", "close", "volume")


def ingest(bars: DataFrame, path: str, checkpoint: str):
    """Append final bars as Parquet and end once what is there is read."""
    return bars.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
