"""Running totals over a whole table without one task for the whole order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnset.storage import materialize


def running_totals(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds for each ``name: value`` the running total ``name`` (inclusive) and ``name_all`` within ``keys``, in
    ``order``, which must settle every tie.

    Rows are range-partitioned by key and order; each range is summed on its own, and the totals of the ranges before
    it, one row a range and key, are added.
    """
    cols = df.columns
    ranged = df.withColumns({f"_v_{n}": c for n, c in sums.items()}).withColumns({f"_o{i}": c for i, c in enumerate(order)})
    parts = [F.col(k) for k in keys] + [F.col(f"_o{i}") for i in range(len(order))]
    ranged = materialize(ranged.repartitionByRange(*parts).withColumn("_pid", F.spark_partition_id()))
    per = ranged.groupBy(*keys, "_pid").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    prior = over.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(*keys, "_pid", *[F.coalesce(F.sum(f"_s_{n}").over(prior), F.lit(0)).alias(f"_b_{n}") for n in sums], *[F.sum(f"_s_{n}").over(over).alias(f"{n}_all") for n in sums])
    here = Window.partitionBy(*keys, "_pid").orderBy(*[F.col(f"_o{i}") for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, 0)
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_pid"]]
    joined = ranged.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(here) for n in sums}).alias("a").join(before.alias("b"), on)
    return joined.select(*[F.col(f"a.{c}") for c in cols], *[(F.col(f"_r_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums], *[F.col(f"b.{n}_all") for n in sums])


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``keys, value, name``: for each distinct value, the average rank of its rows (ties share it), their number
    ``name_n`` and the number of all rows ``name_all``. Null values have no rank."""
    distinct = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    run = running_totals(distinct, keys, [F.col(value)], {"_upto": F.col("_n")})
    return run.select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name), F.col("_n").alias(f"{name}_n"), F.col("_upto_all").alias(f"{name}_all"))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``keys`` and for each ``name: share`` the exact quantile, linear between neighbours; null values don't count.

    From the counts of distinct values in ordered ranges, so that no task holds a group's values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    run = running_totals(counts, keys, [F.col("_v")], {"_upto": F.col("_n")})
    holds = lambda i: (F.col("_upto") - F.col("_n") <= i) & (i < F.col("_upto"))
    picked = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("_upto_all") - 1)
        low, high = F.max(F.when(holds(F.floor(at)), F.col("_v"))), F.max(F.when(holds(F.ceil(at)), F.col("_v")))
        picked.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return run.groupBy(*keys).agg(*picked)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """``n, rho``: Pearson correlation of average ranks over rows where both are known; null under two rows or
    without variance."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    rx, ry = average_ranks(rows, [], "_x", "rx").select("_x", "rx"), average_ranks(rows, [], "_y", "ry").select("_y", "ry")
    both = rows.join(rx, "_x").join(ry, "_y")
    spread = F.nullif(F.stddev_pop("rx") * F.stddev_pop("ry"), F.lit(0.0))
    return both.agg(F.count("*").alias("n"), (F.covar_pop("rx", "ry") / spread).alias("rho"))
