"""Message passing over an edge table ``src, dst, w`` and a node table ``node, h``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def messages(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with their source's ``h``; edges from unknown nodes are left out."""
    return edges.join(nodes.select(F.col("node").alias("src"), F.col("h").alias("h_src")), "src")


def scatter_extremes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, max_in, max_out, mean_in``: largest message to and from each node, and the mean of the incoming ones;
    0 without any."""
    m = messages(edges, nodes).withColumn("msg", F.col("h_src") * F.col("w"))
    into = m.groupBy(F.col("dst").alias("node")).agg(F.max("msg").alias("max_in"), F.avg("msg").alias("mean_in"))
    out = m.groupBy(F.col("src").alias("node")).agg(F.max("msg").alias("max_out"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return nodes.select("node").join(into, "node", "left").join(out, "node", "left").select("node", zero("max_in"), zero("max_out"), zero("mean_in"))


def edge_softmax(edges: DataFrame, slope: float = 0.2) -> DataFrame:
    """Adds ``att``: softmax of the leaky score ``w`` over the edges into each node; two aggregations, no window, so a
    node of many edges is summed in parts."""
    leaky = edges.withColumn("score", F.when(F.col("w") > 0, F.col("w")).otherwise(slope * F.col("w")))
    top = leaky.groupBy("dst").agg(F.max("score").alias("top"))
    raised = leaky.join(top, "dst").withColumn("e", F.exp(F.col("score") - F.col("top")))
    return raised.join(raised.groupBy("dst").agg(F.sum("e").alias("all_e")), "dst").withColumn("att", F.col("e") / F.col("all_e")).drop("score", "top", "e", "all_e")


def degree_norm(edges: DataFrame) -> DataFrame:
    """Adds ``norm``: inverse square roots of both ends' incoming degrees, 0 for a source without incoming edges."""
    deg = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("deg"))
    a, b = deg.select(F.col("node").alias("src"), F.col("deg").alias("ds")), deg.select(F.col("node").alias("dst"), F.col("deg").alias("dd"))
    return edges.join(a, "src", "left").join(b, "dst").withColumn("norm", F.coalesce(1 / F.sqrt("ds"), F.lit(0.0)) / F.sqrt("dd")).drop("ds", "dd")


def max_pool(nodes: DataFrame, graph_col: str) -> DataFrame:
    """``graph, pooled``: the largest node value of each graph."""
    return nodes.groupBy(F.col(graph_col).alias("graph")).agg(F.max("h").alias("pooled"))
