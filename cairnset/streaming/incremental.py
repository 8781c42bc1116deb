"""Incremental counts and histograms over a stream of events (an extension: batch results, kept up to date)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_histogram(events: DataFrame, time_col: str, value_col: str, keys: list[str], window: str, late: str, lo: float, hi: float, bins: int) -> DataFrame:
    """``window_start, keys, bin, n``: as :func:`cairnset.operators.metrics.histogram` within each window; rows later than
    ``late`` behind the newest are left out, and state for closed windows is dropped."""
    v = F.col(value_col).cast("double")
    at = F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    kept = events.where((v >= lo) & (v <= hi)).withWatermark(time_col, late)
    return kept.groupBy(F.window(time_col, window).alias("w"), *keys, at).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "bin", "n")


def start(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed windows as Parquet, each once; all that is there now is taken."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
