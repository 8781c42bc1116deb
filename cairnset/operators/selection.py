"""Choosing representatives: largest mass first, quotas by largest remainder, round robin, capped and hashed samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnset.operators.running import running_totals


def hash_order(id_col: str, seed: int) -> Column:
    """A seeded order that any engine can repeat: the MD5 of seed and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def top_in_group(df: DataFrame, group: str, order: list[Column], quota: Column) -> DataFrame:
    """Up to ``quota`` (a column, constant within a group) rows of each group in ascending ``order`` (values that settle
    every tie), with their rank ``rn``.

    Ranks come from ordered ranges of the whole table (:func:`running_totals`), so that neither a hot group nor a quota of
    half of it ends in one task.
    """
    ranked = running_totals(df.withColumn("_q", quota), [group], order, {"rn": F.lit(1)})
    return ranked.where("rn <= _q").drop("_q", "rn_all")


def one_per_cluster(members: DataFrame, cluster_mass: DataFrame, k: int) -> DataFrame:
    """The heaviest member of each of the ``k`` heaviest clusters (ties: smallest id). ``members``: ``id, cluster_id,
    mass``; ``cluster_mass``: ``cluster_id, weight``."""
    top = cluster_mass.join(members.select("cluster_id").distinct(), "cluster_id", "left_semi").orderBy(F.desc("weight"), "cluster_id").limit(k)
    return top_in_group(members.join(top.select("cluster_id"), "cluster_id"), "cluster_id", [-F.col("mass"), F.col("id")], F.lit(1)).select("id", "cluster_id", "mass")


def largest_remainder(groups: DataFrame, total: int, strict: bool = True) -> DataFrame:
    """Adds ``allocated`` to ``cluster_id, theory, capacity``: the floor of ``theory`` within ``min(ceil(theory),
    capacity)``, then single units by largest fraction (ties: smallest id) until ``total`` is given out.

    Raises if the capacities cannot hold ``total``; unless ``strict``, as much is given out as they hold.
    """
    capped = groups.withColumn("cap", F.least(F.ceil("theory"), F.col("capacity").cast("long"))).withColumn("base", F.least(F.floor("theory"), F.col("cap")))
    sums = capped.agg(F.coalesce(F.sum("base"), F.lit(0)).alias("b"), F.coalesce(F.sum("cap"), F.lit(0)).alias("c")).first()
    if strict and sums["c"] < total:
        raise ValueError(f"{total} units do not fit in capacities of {sums['c']}")
    need = max(0, total - sums["b"])
    frac = F.col("theory") - F.floor("theory")
    extra = capped.where("base < cap").orderBy(frac.desc(), "cluster_id").limit(need).select("cluster_id", F.lit(1).alias("one"))
    return capped.join(extra, "cluster_id", "left").withColumn("allocated", F.col("base") + F.coalesce("one", F.lit(0))).drop("cap", "base", "one")


def anchored_shares(clusters: DataFrame, total: int, anchor: int, pool: int, power: float) -> DataFrame:
    """``cluster_id, capacity, theory``: one unit for each of the ``anchor`` heaviest clusters, the rest in proportion to
    ``weight ** power`` over the ``pool`` heaviest; in equal parts if those weigh nothing."""
    top = clusters.orderBy(F.desc("weight"), "cluster_id").limit(pool)
    firsts = clusters.orderBy(F.desc("weight"), "cluster_id").limit(anchor).select("cluster_id", F.lit(1).alias("anchored"))
    powered = top.withColumn("p", F.when(F.col("weight") > 0, F.pow(F.col("weight").cast("double"), F.lit(power))).otherwise(0.0))
    whole = powered.agg(F.sum("p").alias("all_p"), F.count("*").alias("n_pool"))
    rest = max(0, total - anchor)
    share = F.when(F.col("all_p") > 0, F.col("p") / F.col("all_p")).otherwise(1 / F.col("n_pool"))
    return powered.join(F.broadcast(whole)).join(firsts, "cluster_id", "left").select("cluster_id", "capacity", (F.coalesce("anchored", F.lit(0)) + share * rest).alias("theory"))


def fill_quotas(members: DataFrame, quotas: DataFrame) -> DataFrame:
    """Members by mass up to each cluster's ``allocated``."""
    return top_in_group(members.join(quotas.where("allocated > 0").select("cluster_id", "allocated"), "cluster_id"), "cluster_id", [-F.col("mass"), F.col("id")], F.col("allocated")).select("id", "cluster_id", "mass")


def top_up(chosen: DataFrame, pool: DataFrame, total: int) -> DataFrame:
    """``chosen`` and, by mass, as many of the other pool members as are missing to ``total``."""
    need = max(0, total - chosen.count())
    more = pool.join(chosen.select("id"), "id", "left_anti").orderBy(F.desc("mass"), "id").limit(need)
    return chosen.select("id", "cluster_id", "mass").unionByName(more.select("id", "cluster_id", "mass"))


def round_robin(members: DataFrame, cluster_rank: list[Column], member_rank: list[Column], target: int) -> DataFrame:
    """One member of each cluster per round, clusters and members in their orders, until ``target``. With ``target``
    picks no cluster gives more than that many, so only those are ranked. Adds ``pick`` from 1."""
    few = top_in_group(members, "cluster_id", member_rank, F.lit(target)).withColumnRenamed("rn", "round")
    picked = few.orderBy("round", *cluster_rank).limit(target)
    return picked.withColumn("pick", F.row_number().over(Window.orderBy("round", *cluster_rank)))  # at most ``target`` rows


def active_cluster_reserve(members: DataFrame, k: int) -> DataFrame:
    """Decoys of clusters that also hold actives, clusters by total, active and decoy mass, members by mass, first ``k``.
    ``members``: ``id, cluster_id, mass, kind``."""
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")))
    stats = members.groupBy("cluster_id").agg(F.sum("mass").alias("all_mass"), of("active").alias("active_mass"), of("decoy").alias("decoy_mass"))
    mixed = stats.where("active_mass IS NOT NULL AND decoy_mass IS NOT NULL")
    decoys = members.where("kind = 'decoy'").join(mixed, "cluster_id")
    return decoys.orderBy(F.desc("all_mass"), F.desc("active_mass"), F.desc("decoy_mass"), "cluster_id", F.desc("mass"), "id").limit(k).select("id", "cluster_id", "mass")


def hashed_sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, the same for the same seed; all, if there are fewer."""
    return df.orderBy(hash_order(id_col, seed), id_col).limit(n)


def hashed_sample_per(df: DataFrame, group: str, id_col: str, n: int, seed: int) -> DataFrame:
    """Up to ``n`` rows of each group."""
    return top_in_group(df.select(id_col, *[c for c in df.columns if c != id_col]), group, [hash_order(id_col, seed), F.col(id_col)], F.lit(n)).drop("rn")


def balanced_draw(df: DataFrame, id_col: str, class_col: str, n: int, seed: int) -> DataFrame:
    """``draw, id_col, class_col``: ``n`` draws with replacement in which each row weighs the inverse of its class's count:
    a class by hash of the draw, then a row of it by rank. Null classes take no part."""
    rows = running_totals(df.where(F.col(class_col).isNotNull()).select(id_col, class_col), [class_col], [F.col(id_col)], {"_rank": F.lit(1)})
    classes = rows.groupBy(class_col).agg(F.max("_rank_all").alias("_n"))
    order = Window.orderBy(class_col)  # one row a class
    named = classes.select(class_col, "_n", (F.row_number().over(order) - 1).alias("_i"), F.count("*").over(Window.partitionBy()).alias("_k"))
    number = lambda salt: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}{salt}"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long")
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw")).withColumns({"_a": number("a"), "_b": number("b")})
    placed = draws.join(F.broadcast(named), F.pmod(F.col("_a"), F.col("_k")) == F.col("_i")).select("draw", class_col, (F.pmod(F.col("_b"), F.col("_n")) + 1).alias("_rank"))
    return placed.join(rows, [class_col, "_rank"]).select("draw", id_col, class_col)


def topk_mass_coverage(chosen: DataFrame, eligible: DataFrame) -> DataFrame:
    """``n_selected, mass_selected, mass_topk, coverage``: mass of the chosen over that of as many heaviest eligible
    ones; null if none is chosen or eligible. Selected rows outside the eligible count nothing."""
    k = chosen.count()
    sel = chosen.join(eligible.select("id", "mass"), "id", "left_semi").agg(F.count("*").alias("n_selected"), F.coalesce(F.sum("mass"), F.lit(0)).alias("mass_selected"))
    top = eligible.orderBy(F.desc("mass"), "id").limit(k).agg(F.sum("mass").alias("mass_topk"))
    return sel.join(F.broadcast(top)).select("*", (F.col("mass_selected") / F.nullif(F.col("mass_topk"), F.lit(0))).alias("coverage"))
