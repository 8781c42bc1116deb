"""Queries with learned models, and the windowed histogram as batch. Rows are checked, as no SQL says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnset.operators import learned, metrics
from cairnset.operators.selection import round_robin
from cairnset.plans.tables import rounded, table
from cairnset.storage import materialize
from cairnset.streaming.incremental import windowed_histogram


def kmeans_sizes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return learned.kmeans(e, F.col("embedding"), 16).groupBy("cluster").agg(F.count("*").alias("n"), F.avg("d2").alias("mean_d2"))


def kmeans_picks(spark: SparkSession, sf: str) -> DataFrame:
    """Round robin over k-means clusters, largest first, decoys by distance to their cluster's centre."""
    placed = materialize(learned.kmeans(table(spark, sf, "embeddings"), F.col("embedding"), 16).select(F.col("vec_id").alias("id"), F.col("cluster").cast("long").alias("cluster_id"), "label", "d2"))
    sizes = placed.groupBy("cluster_id").agg(F.count("*").alias("n"))
    decoys = placed.where("label BETWEEN 1 AND 3").join(F.broadcast(sizes), "cluster_id").select("id", "cluster_id", "d2", "n")  # 16 rows
    return round_robin(decoys, [F.desc("n"), F.col("cluster_id")], [F.col("d2"), F.col("id")], 100).select("id", "cluster_id", F.col("pick").cast("long").alias("pick"))


def pca_positions(spark: SparkSession, sf: str) -> DataFrame:
    return learned.project(table(spark, sf, "embeddings"), F.col("embedding"), 2).select("vec_id", "x1", "x2")


def forest_quality(spark: SparkSession, sf: str) -> DataFrame:
    """A forest on composition counts of the train split, judged on all three."""
    u = table(spark, sf, "umap_dataset").where("smiles IS NOT NULL AND label IS NOT NULL")
    count = lambda ch: (F.length("smiles") - F.length(F.replace(F.col("smiles"), F.lit(ch), F.lit("")))).cast("double")
    rows = u.select("mol_id", F.lower(F.trim("split")).alias("split"), F.col("label").cast("double").alias("y_true"), F.length("smiles").cast("double").alias("f0"), *[count(ch).alias(f"f{i + 1}") for i, ch in enumerate("NOSFc=")]).where("split IN ('train', 'val', 'test')")
    scored = learned.forest_scores(rows.where("split = 'train'"), rows, [f"f{i}" for i in range(7)], "y_true", trees=20, depth=6)
    return metrics.ranking_quality(scored.withColumn("y_true", F.col("y_true").cast("int")), ["split"])


def event_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming histogram over the table as a batch; its bins reach to the next hundred above the largest value."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    high = e.agg(F.ceil(F.max("value") / 100) * 100).first()[0] or 100
    h = windowed_histogram(e, "ts", "value", ["event_type"], "1 day", "1 hour", 0.0, float(high), 10)
    return h.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", F.col("bin").cast("long").alias("bin"), "n")


def event_days(spark: SparkSession, sf: str) -> DataFrame:
    h = event_histogram(spark, sf).groupBy("day").agg(F.sum("n").alias("n"))
    return rounded(h.withColumn("log_n", F.log10("n")), "log_n")


QUERIES = {f.__name__: f for f in (kmeans_sizes, kmeans_picks, pca_positions, forest_quality, event_histogram, event_days)}
_H = "h AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, CAST(least(floor(value / hi * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM events, (SELECT ceil(max(value) / 100) * 100 AS hi FROM events) WHERE value >= 0 GROUP BY ALL)"
SQL = {
    "event_histogram": f"WITH {_H} SELECT day, event_type, bin, n FROM h",
    "event_days": f"WITH {_H} SELECT day, CAST(sum(n) AS BIGINT) AS n, round(log10(sum(n)), 6) AS log_n FROM h GROUP BY day",
}
