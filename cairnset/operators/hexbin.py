"""Two-dimensional hexagonal binning, caps by bin mass and greedy filling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnset.operators.selection import top_in_group
from cairnset.storage import materialize


def limits(points: DataFrame) -> dict[str, float]:
    """Extent of ``x, y``: four numbers."""
    return points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first().asDict()


def with_hexes(points: DataFrame, grids: list[int], box: dict[str, float]) -> DataFrame:
    """Each point once for each grid, with ``nbins, hex_id, cx, cy``: the nearest centre of two lattices of ``nbins`` by
    ``nbins / sqrt 3`` cells, one offset by half a cell, in cell units with y weighed three times. Column arithmetic only."""
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("nbins"), F.lit(float(n)).alias("_nx"), F.lit(float(max(1, int(n / math.sqrt(3))))).alias("_ny")) for n in grids]))
    width, height = (box["x1"] - box["x0"]) or 1.0, (box["y1"] - box["y0"]) or 1.0
    nx, ny = F.col("_nx"), F.col("_ny")
    sx, sy = F.lit(width) / nx, F.lit(height) / ny
    at = points.select("*", each).withColumns({"_u": (F.col("x") - box["x0"]) / sx, "_v": (F.col("y") - box["y0"]) / sy})
    at = at.withColumns({"_i1": F.rint("_u"), "_j1": F.rint("_v"), "_i2": F.floor("_u").cast("double"), "_j2": F.floor("_v").cast("double")})
    d1 = (F.col("_u") - F.col("_i1")) ** 2 + 3 * (F.col("_v") - F.col("_j1")) ** 2
    d2 = (F.col("_u") - F.col("_i2") - 0.5) ** 2 + 3 * (F.col("_v") - F.col("_j2") - 0.5) ** 2
    first = d1 < d2
    hex_id = F.when(first, F.col("_i1") * (ny + 1) + F.col("_j1")).otherwise((nx + 1) * (ny + 1) + F.col("_i2") * ny + F.col("_j2")).cast("long")
    cx = F.when(first, F.col("_i1")).otherwise(F.col("_i2") + 0.5) * sx + box["x0"]
    cy = F.when(first, F.col("_j1")).otherwise(F.col("_j2") + 0.5) * sy + box["y0"]
    return at.withColumns({"hex_id": hex_id, "cx": cx, "cy": cy}).drop("_nx", "_ny", "_u", "_v", "_i1", "_j1", "_i2", "_j2")


def with_hex(points: DataFrame, nbins: int, box: dict[str, float]) -> DataFrame:
    """Adds ``hex_id, cx, cy`` for one grid."""
    return with_hexes(points, [nbins], box).drop("nbins")


def nearest_first(points: DataFrame, from_rows: str, to_rows: str, n: int) -> DataFrame:
    """``id, d2``: the first ``n`` points of ``from_rows`` by squared distance to the nearest point of ``to_rows`` (ties:
    smallest id). Points meet within a square cell and its neighbours, which hold every pair up to a cell's side apart;
    the side is doubled until ``n`` are found within it, or cells hold all points."""
    known = points.where("x IS NOT NULL AND y IS NOT NULL")
    a, to = known.where(from_rows).select("id", "x", "y"), materialize(known.where(to_rows).select(F.col("x").alias("tx"), F.col("y").alias("ty")).distinct())
    box, wanted, n_to = limits(known), a.limit(n).count(), to.count()
    if not wanted or not n_to:
        return a.select("id", F.lit(0.0).alias("d2")).limit(0)
    extent = max(box["x1"] - box["x0"], box["y1"] - box["y0"]) or 1.0
    side = extent / max(1.0, math.sqrt(n_to))
    cell = lambda c, low: F.floor((F.col(c) - box[low]) / F.lit(side))
    around = lambda c: F.sequence(c - 1, c + 1)
    while True:
        rings = a.withColumn("i", F.explode(around(cell("x", "x0")))).withColumn("j", F.explode(around(cell("y", "y0"))))
        met = rings.join(to.select("tx", "ty", cell("tx", "x0").alias("i"), cell("ty", "y0").alias("j")), ["i", "j"])
        near = met.groupBy("id").agg(F.min((F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2).alias("d2"))
        within = near if side > extent else near.where(F.col("d2") <= side**2)
        first = materialize(within.orderBy("d2", "id").limit(n))
        if side > extent or first.count() >= wanted:
            return first.orderBy("d2", "id")
        side *= 2


def hex_table(points: DataFrame) -> DataFrame:
    """``hex_id, n, mass, n_decoys`` of points with ``hex_id, mass, is_decoy``."""
    return points.groupBy("hex_id").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"), F.count_if("is_decoy").alias("n_decoys"))


def with_caps(hexes: DataFrame, per_hex_cap: float, max_cap: int, alpha: float, ref_quantile: float, min_log_mass: float) -> DataFrame:
    """Adds ``keep, cap``: ``rint(per_hex_cap * (mass / ref) ** alpha)`` within 1 and ``max_cap``, half to even, where
    ``ref`` is a quantile of the kept masses, 1 at least; 0 where a bin is too light to keep."""
    marked = hexes.withColumn("keep", (F.col("mass") > 0) & (F.log10("mass") >= min_log_mass))
    ref = marked.where("keep").agg(F.greatest(F.coalesce(F.percentile("mass", F.lit(ref_quantile)), F.lit(1.0)), F.lit(1.0)).alias("ref"))
    cap = F.least(F.greatest(F.rint(per_hex_cap * F.pow(F.col("mass") / F.col("ref"), F.lit(alpha))), F.lit(1.0)), F.lit(float(max_cap)))
    return marked.join(F.broadcast(ref)).withColumn("cap", F.when(F.col("keep"), cap).otherwise(0.0).cast("int")).drop("ref")


def greedy_fill(points: DataFrame, hexes: DataFrame, target: int) -> DataFrame:
    """Decoys by bin mass (ties: smallest id), at most ``cap`` from a bin, until ``target``; a negative or zero target
    takes none."""
    decoys = points.where("is_decoy").select("id", "hex_id", "mass").join(hexes.where("cap > 0").select("hex_id", F.col("mass").alias("hex_mass"), "cap"), "hex_id")
    within = top_in_group(decoys.select("id", "hex_id", "mass", "hex_mass", "cap"), "hex_id", [F.col("id")], F.col("cap"))
    return within.orderBy(F.desc("hex_mass"), "id").limit(max(0, target)).select("id", "hex_id", "hex_mass")


def capped_grids(points: DataFrame, grids: list[int], pairs: DataFrame, alpha: float, ref_quantile: float, min_log_mass: float) -> DataFrame:
    """``max_cap, mid_cap, nbins, hex_id, mass, n_decoys, cap`` of the kept bins of all grids under all pairs of caps, in one
    job; the quantile of a grid is over its bins, whose number the grid bounds."""
    hexes = with_hexes(points, grids, limits(points)).groupBy("nbins", "hex_id").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"), F.count_if("is_decoy").alias("n_decoys"))
    kept = materialize(hexes.where((F.col("mass") > 0) & (F.log10("mass") >= min_log_mass)))
    ref = kept.groupBy("nbins").agg(F.greatest(F.percentile("mass", F.lit(ref_quantile)), F.lit(1.0)).alias("ref"))
    each = kept.join(F.broadcast(ref), "nbins").join(F.broadcast(pairs))
    cap = F.least(F.greatest(F.rint(F.col("mid_cap") * F.pow(F.col("mass") / F.col("ref"), F.lit(alpha))), F.lit(1.0)), F.col("max_cap").cast("double"))
    return each.select("max_cap", "mid_cap", "nbins", "hex_id", "mass", "n_decoys", cap.cast("int").alias("cap"))


def first_feasible(points: DataFrame, target: int, nbins_min: int, nbins_max: int, step: int, per_hex_cap: float, max_cap: int, **caps: float) -> int:
    """The smallest number of bins at which the caps let ``target`` decoys in; raises if there is none. One job for all."""
    pair = points.sparkSession.createDataFrame([(max_cap, float(per_hex_cap))], "max_cap int, mid_cap double")
    capped = capped_grids(points, list(range(nbins_min, nbins_max + 1, step)), pair, **caps)
    room = capped.groupBy("nbins").agg(F.sum(F.least("cap", F.col("n_decoys"))).alias("room"))
    found = room.where(F.col("room") >= target).agg(F.min("nbins").alias("n")).first()["n"]
    if found is None:
        raise ValueError(f"no number of bins holds {target} decoys")
    return found


def cap_sweep(points: DataFrame, target: int, grids: list[int], max_caps: list[int], **caps: float) -> DataFrame:
    """``max_cap, mid_cap, chosen_nbins, n_selected, hex_coverage, mass_coverage, rho`` for each pair of caps with ``mid_cap
    <= max_cap`` that some grid holds ``target`` decoys under: the smallest such grid, filled by bin mass (ties: smallest
    id); shares of kept bins with a selected decoy and of the mass of as many heaviest decoys in kept bins; and the rank
    correlation of bin mass and selected decoys over kept bins.

    Parameter pairs and grids are joined to the bins, so a few jobs serve them all. The decoys that a pair's caps let in
    are bounded by its grid.
    """
    spark, pair = points.sparkSession, ["max_cap", "mid_cap"]
    pairs = spark.createDataFrame([(m, k) for m in max_caps for k in range(1, m + 1)], "max_cap int, mid_cap int")
    capped = materialize(capped_grids(points, grids, pairs, **caps))
    room = capped.groupBy(*pair, "nbins").agg(F.sum(F.least("cap", F.col("n_decoys"))).alias("room"))
    chosen = room.where(F.col("room") >= target).groupBy(*pair).agg(F.min("nbins").alias("nbins"))
    bins = materialize(capped.join(F.broadcast(chosen), [*pair, "nbins"]))
    decoys = with_hexes(points.where("is_decoy").select("id", "x", "y", F.col("mass").alias("own")), grids, limits(points)).select("id", "own", "nbins", "hex_id")
    within = decoys.join(bins.select(*pair, "nbins", "hex_id", "mass", "cap"), ["nbins", "hex_id"])
    few = within.withColumn("rn", F.row_number().over(Window.partitionBy(*pair, "hex_id").orderBy("id"))).where("rn <= cap")
    picked = materialize(few.withColumn("pick", F.row_number().over(Window.partitionBy(*pair).orderBy(F.desc("mass"), "id"))).where(F.col("pick") <= target))
    heaviest = within.withColumn("rn", F.row_number().over(Window.partitionBy(*pair).orderBy(F.desc("own"), "id"))).where(F.col("rn") <= target).groupBy(*pair).agg(F.sum("own").alias("most"))
    hit = bins.join(picked.groupBy(*pair, "hex_id").agg(F.count("*").alias("n_sel")), [*pair, "hex_id"], "left").select(*pair, "mass", F.coalesce("n_sel", F.lit(0)).alias("n_sel"))
    rank = lambda c: F.rank().over(Window.partitionBy(*pair).orderBy(c)) + (F.count("*").over(Window.partitionBy(*pair, c)) - 1) / 2
    shares = hit.withColumns({"ra": rank("mass"), "rb": rank("n_sel")}).groupBy(*pair).agg((F.count_if(F.col("n_sel") > 0) / F.count("*")).alias("hex_coverage"), (F.covar_pop("ra", "rb") / F.nullif(F.stddev_pop("ra") * F.stddev_pop("rb"), F.lit(0.0))).alias("rho"))
    got = picked.groupBy(*pair).agg(F.first("nbins").alias("chosen_nbins"), F.count("*").alias("n_selected"), F.sum("own").alias("sel"))
    return got.join(shares, pair).join(heaviest, pair).select(*pair, "chosen_nbins", "n_selected", "hex_coverage", (F.col("sel") / F.col("most")).alias("mass_coverage"), "rho")


def coverage(selected: DataFrame, hexes: DataFrame) -> DataFrame:
    """``n_hit, n_kept, coverage``: share of kept bins with at least one selected point."""
    hit = selected.select("hex_id").distinct().join(hexes.where("keep").select("hex_id"), "hex_id", "left_semi").agg(F.count("*").alias("n_hit"))
    kept = hexes.where("keep").agg(F.count("*").alias("n_kept"))
    return hit.join(F.broadcast(kept)).select("*", (F.col("n_hit") / F.nullif(F.col("n_kept"), F.lit(0))).alias("coverage"))
