"""Choosing a varied subset (problem 3).

Method: minimum-cost flow quotas. Records are counted by combination of library, structure region and depth, where
depth says how many members of the same similarity group come before a record. Flow goes from the source through
libraries and combinations to regions and the sink. Each further unit through a library or region costs more than the
one before, so that costs are strictly convex: libraries are served alike as far as their stock goes, then
groups before their deeper members, then regions. The flow through a combination is its quota, which its records fill in
order of a fixed rank. The network is as large as the categories. Groups are the clusters of problem 5, regions the
components of its first mixture.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnset.functions.text import letters_digits
from cairnset.operators.running import running_totals
from cairnset.storage import materialize


def quotas(counts: dict[tuple[str, int, int], int], amount: int, steps: int = 8192) -> dict[tuple[str, int, int], int]:
    """Quota of each ``(library, region, level)``; all there is, if the amount exceeds it.

    Minimum-cost flow by successive shortest paths. A unit through a library costs as many times its price as units
    went before, a unit through a region likewise, and each level down a group has its price. A library's price is above
    all that levels can cost, and a level's above all that regions can: libraries differ by one unit at most unless their
    stock ends, no group is gone deeper into while a library has other groups, and regions are then as even as can be.
    Amounts beyond ``steps`` are sent in parcels, and alike to within a parcel.
    """
    if amount >= sum(counts.values()):
        return dict(counts)
    libs, regions = sorted({k[0] for k in counts}), sorted({k[1] for k in counts})
    levels = 1 + max(k[2] for k in counts)
    room = np.zeros((len(libs), len(regions), levels), np.int64)
    for (v, r, level), n in counts.items():
        room[libs.index(v), regions.index(r), level] = n
    used, parcel = np.zeros_like(room), max(1, amount // steps)
    deep = amount // parcel + 1  # above all that regions can cost
    dear = 2 * deep * (levels + 1)
    never, place = np.iinfo(np.int64).max // 4, np.arange(levels)
    sent = 0
    while sent < amount:
        left = room - used
        # the cheapest level with room, and the dearest one in use, of each library and region
        go = np.where((left > 0).any(2), (left > 0).argmax(2), levels)
        back = np.where((used > 0).any(2), levels - 1 - (used[:, :, ::-1] > 0).argmax(2), -1)
        cost, gain = np.where(go < levels, go * deep, never), np.where(back >= 0, back * deep, -never)
        at_lib, at_region = -(-used.sum((1, 2)) // parcel) * dear, np.full(len(regions), never)
        via_lib, via_region = np.full(len(libs), -1), np.zeros(len(regions), np.int64)
        while True:  # Bellman-Ford between the two sides
            reach = at_lib[:, None] + cost
            best = reach.argmin(0)
            nearer = reach.min(0) < at_region
            at_region, via_region = np.where(nearer, reach.min(0), at_region), np.where(nearer, best, via_region)
            undo = np.where(gain > -never, at_region[None, :] - gain, never)
            closer = undo.min(1) < at_lib
            if not closer.any():
                break
            at_lib, via_lib = np.where(closer, undo.min(1), at_lib), np.where(closer, undo.argmin(1), via_lib)
        # among regions at equal cost, the one that fewest units went through for its stock
        through = used.sum((0, 2))
        r = int(np.argmin(at_region + -(-through // parcel)))
        path, first = [], None
        while first is None:
            v = int(via_region[r])
            path.append((v, r, int(go[v, r]), 1))
            if via_lib[v] < 0:
                first = v
            else:
                r = int(via_lib[v])
                path.append((v, r, int(back[v, r]), -1))
        step = min(parcel, amount - sent, *(int(left[v, r, k]) if sign > 0 else int(used[v, r, k]) for v, r, k, sign in path))
        for v, r, k, sign in path:
            used[v, r, k] += sign * step
        sent += step
    return {(libs[v], regions[r], int(k)): int(used[v, r, k]) for v, r, k in zip(*np.nonzero(used))}


def latest_medoids(medoids: DataFrame, libraries: DataFrame) -> DataFrame:
    """One row for each library and index, the one written last; excluded and unknown libraries are left out."""
    known = libraries.where("NOT coalesce(is_excluded, false)").select(letters_digits(F.col("library")).alias("lib"), F.col("library").alias("lib_name"), F.col("lib_kind").alias("kind")).dropDuplicates(["lib"])
    last = F.max(F.struct("written_at", "medoid_id")).alias("r")
    rows = medoids.select(letters_digits(F.col("library")).alias("lib"), "medoid_index", "written_at", F.col("medoid_id").cast("long").alias("medoid_id")).where("medoid_id IS NOT NULL AND medoid_index IS NOT NULL")
    return rows.groupBy("lib", "medoid_index").agg(last).select("lib", "medoid_index", "r.medoid_id").join(F.broadcast(known), "lib").select("medoid_id", F.col("lib_name").alias("library"), "kind", "medoid_index")


def choose_subsets(medoids: DataFrame, labels: DataFrame, libraries: DataFrame, targets: DataFrame, tall: int = 1000) -> DataFrame:
    """``subset_name, medoid_id, library, medoid_index, group_id, depth``.

    ``labels``: ``id, label, region`` of similarity groups; a medoid without one has no structure to show, is a group of
    its own in a region of its own kind, and is chosen last. A target beyond what exists takes all of it; a null or
    non-positive one nothing. Ties are settled by a hash of the id.
    """
    rows = latest_medoids(medoids, libraries)
    lab = labels.select(F.col("id").alias("medoid_id"), "label", F.col("region").alias("r"))
    grouped = materialize(rows.join(lab, "medoid_id", "left").select("medoid_id", "library", "kind", "medoid_index", F.coalesce("label", "medoid_id").alias("group_id"), F.coalesce("r", F.lit(-2)).cast("long").alias("region"), F.col("label").isNull().alias("blank")))
    parts = []
    for kind in [r["lib_kind"] for r in targets.select("lib_kind").distinct().collect()]:  # a parameter table
        wanted = [(r["subset_name"], int(r["n_select"])) for r in targets.where(F.col("lib_kind").eqNullSafe(kind) & (F.col("n_select") > 0)).orderBy("subset_name").collect()]
        pool = grouped if kind is None else grouped.where(F.col("kind") == kind)
        # depth within the group; groups of more than ``tall`` rows are dealt into stacks that are ranked apart
        stacks = pool.groupBy("group_id").agg(F.ceil(F.count("*") / tall).alias("stacks"))
        dealt = pool.join(stacks, "group_id").withColumn("stack", F.pmod(F.xxhash64("medoid_id"), F.col("stacks")))
        rn = F.row_number().over(Window.partitionBy("group_id", "stack").orderBy(F.xxhash64("medoid_id", F.lit(1)), "medoid_id"))
        level = F.when(F.col("blank"), F.lit(24)).otherwise(F.least(F.floor(F.log2(F.col("depth") + 1)), F.lit(23))).cast("int")
        deep = dealt.withColumn("depth", (rn - 1) * F.col("stacks") + F.col("stack")).withColumn("level", level)
        deep = materialize(deep.select("medoid_id", "library", "medoid_index", "group_id", "region", "depth", "level"))
        counts = {(r["library"], r["region"], r["level"]): r["n"] for r in deep.groupBy("library", "region", "level").agg(F.count("*").alias("n")).collect()}  # one row a combination
        plan = [(name, *key, q) for name, amount in wanted for key, q in quotas(counts, amount).items()]
        quota = medoids.sparkSession.createDataFrame(plan, "subset_name string, library string, region long, level int, q long")
        # ranks come from ordered ranges of the whole table: no combination is ranked in one task
        ranked = running_totals(deep, ["library", "region", "level"], [F.col("depth"), F.xxhash64("medoid_id", F.lit(2)), F.col("medoid_id")], {"rank": F.lit(1)})
        asked = ranked.join(F.broadcast(quota), ["library", "region", "level"]).where("rank <= q")
        parts.append(asked.select("subset_name", "medoid_id", "library", "medoid_index", "group_id", "depth"))
    chosen = medoids.sparkSession.createDataFrame([], "subset_name string, medoid_id long, library string, medoid_index long, group_id long, depth long")
    for p in parts:
        chosen = chosen.unionByName(p)
    return chosen


def subset_report(chosen: DataFrame) -> DataFrame:
    """``subset_name, library, n_selected, n_groups, most_of_a_group``."""
    per = chosen.groupBy("subset_name", "library", "group_id").agg(F.count("*").alias("n"))
    return per.groupBy("subset_name", "library").agg(F.sum("n").alias("n_selected"), F.count("*").alias("n_groups"), F.max("n").alias("most_of_a_group"))
