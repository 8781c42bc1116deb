"""Model quality and distribution summaries as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnset.operators.running import quantiles, running_totals


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, keys: list[str], threshold: float = 0.5, strict: bool = False) -> DataFrame:
    """``tp, fp, fn, tn, precision, recall, f1, accuracy`` of ``y_true, y_prob``; a prediction is positive at the
    threshold, or only above it if ``strict``. Undefined ratios are 0; rows with a null are left out."""
    pos = F.col("y_prob") > threshold if strict else F.col("y_prob") >= threshold
    yes = F.col("y_true") == 1
    known = df.where("y_true IS NOT NULL AND y_prob IS NOT NULL")
    c = known.groupBy(*keys).agg(F.count_if(pos & yes).alias("tp"), F.count_if(pos & ~yes).alias("fp"), F.count_if(~pos & yes).alias("fn"), F.count_if(~pos & ~yes).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(*keys, "tp", "fp", "fn", "tn", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def curve_points(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, y_prob, tp, fp, n_pos, n_neg, own_pos, own_n``: for each distinct score, what is found at or above it."""
    known = df.where("y_true IS NOT NULL AND y_prob IS NOT NULL")
    per = known.groupBy(*keys, "y_prob").agg(F.count_if(F.col("y_true") == 1).alias("own_pos"), F.count("*").alias("own_n"))
    run = running_totals(per, keys, [-F.col("y_prob")], {"tp": F.col("own_pos"), "fp": F.col("own_n") - F.col("own_pos")})
    return run.select(*keys, "y_prob", "tp", "fp", F.col("tp_all").alias("n_pos"), F.col("fp_all").alias("n_neg"), "own_pos", "own_n")


def ranking_quality(df: DataFrame, keys: list[str]) -> DataFrame:
    """``auroc, auprc``: area under the ROC curve (ties count half) and average precision in steps, tied scores taken
    together; null with a single class."""
    p = curve_points(df, keys)
    own_neg = F.col("own_n") - F.col("own_pos")
    area = F.sum(own_neg * (F.col("tp") - F.col("own_pos") / 2))
    steps = F.sum(F.col("own_pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    both = p.groupBy(*keys).agg(F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"), area.alias("area"), steps.alias("steps"))
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return both.select(*keys, "n_pos", "n_neg", F.when(ok, F.col("area") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"), F.when(ok, F.col("steps") / F.col("n_pos")).alias("auprc"))


def regression_errors(df: DataFrame, keys: list[str], target: str, pred: str) -> DataFrame:
    """``n, rmse, mae, rae``; the relative error is null if the target does not vary."""
    w = df.where(F.col(target).isNotNull() & F.col(pred).isNotNull())
    mean = w.groupBy(*keys).agg(F.avg(target).alias("_mean"))
    both = w.join(mean, keys) if keys else w.join(F.broadcast(mean))
    err = F.col(target) - F.col(pred)
    out = both.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"), F.sum(F.abs(err)).alias("_a"), F.sum(F.abs(F.col(target) - F.col("_mean"))).alias("_b"))
    return out.select(*keys, "n", "rmse", "mae", F.when(F.col("_b") > 0, F.col("_a") / F.col("_b")).alias("rae"))


def finite(c: Column) -> Column:
    """A number that is neither NaN nor infinite, else null."""
    v = c.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``n, mean, sd, q05, q25, median, q75, q95, low, high`` with linear quantiles; null, NaN and infinite values are left
    out."""
    w = df.select(*keys, finite(F.col(value)).alias("_x")).where("_x IS NOT NULL")
    out = w.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("sd"), F.min("_x").alias("low"), F.max("_x").alias("high"))
    q = quantiles(w, keys, "_x", {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95})
    both = out.alias("a").join(q.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]) if keys else out.alias("a").join(F.broadcast(q.alias("b")))
    return both.select(*[F.col(f"a.{k}") for k in keys], "n", "mean", "sd", "q05", "q25", "median", "q75", "q95", "low", "high")


def histogram(df: DataFrame, keys: list[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """``bin, n`` over equal bins of ``[lo, hi]``, the last closed on the right; values outside are left out."""
    v = F.col(value).cast("double")
    at = F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    return df.where((v >= lo) & (v <= hi)).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))


def l1_distance(hist: DataFrame, keys: list[str], reference: DataFrame) -> DataFrame:
    """Sum of absolute differences between each group's normalised histogram and the reference's."""
    g = Window.partitionBy(*keys)
    shares = hist.withColumn("p", F.col("n") / F.greatest(F.sum("n").over(g), F.lit(1)))
    total = reference.agg(F.sum("n").alias("all"))
    ref = reference.join(F.broadcast(total)).select("bin", (F.col("n") / F.greatest("all", F.lit(1))).alias("r"))
    # |p - r| over bins of the group, plus the reference's mass in bins that the group lacks
    both = shares.join(ref, "bin", "left")
    return both.groupBy(*keys).agg((F.sum(F.abs(F.col("p") - F.coalesce("r", F.lit(0.0)))) + 1 - F.sum(F.coalesce("r", F.lit(0.0)))).alias("l1"))


def min_max(df: DataFrame, cols: list[str]) -> DataFrame:
    """Adds ``<c>_scaled`` in 0 to 1 over the whole table; a constant column gives 0, an unknown value null."""
    ends = df.agg(*[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols])
    both = df.join(F.broadcast(ends))
    scaled = {f"{c}_scaled": F.when(F.col(c).isNull(), None).when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(0.0) for c in cols}
    return both.withColumns(scaled).drop(*[f"_{e}_{c}" for e in ("lo", "hi") for c in cols])
