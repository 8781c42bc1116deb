"""Splits that keep related records together (problem 4).

Method: records and the entities they name (series, structure) form a bipartite graph. The smallest record id travels
along it as a label, from records to entities and back, until nothing changes; each round also follows labels to the
label of the record they name, so that long chains take few rounds. Only entities that share a record with another
entity take part in the rounds. Groups of one label are then assigned to splits so that sizes and label shares stay
close to their targets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnset.functions.smiles import longest_component
from cairnset.functions.text import letters_digits
from cairnset.storage import drop, materialize

#: Codes that name no series, as letters and digits in lower case ("", "?" and "-" become empty).
PLACEHOLDERS = ("", "na", "nan", "none", "null", "unknown", "unk", "tbd", "nd", "x", "xx", "xxx", "unassigned", "notavailable", "notassigned", "notapplicable", "noseries", "missing", "undefined", "unspecified", "tba", "nil", "empty", "pending")


def series_key(c: Column) -> Column:
    """Letters and digits of a series code in lower case; null for placeholders."""
    k = letters_digits(c.cast("string"))
    return F.when(~k.isin(*PLACEHOLDERS), k)


def entity_links(df: DataFrame, id_col: str, entities: dict[str, Column]) -> DataFrame:
    """``id, kind, first``: for each entity that two or more records name, a link from each record to the smallest id
    among them, which stands for the entity. Null entities link nothing."""
    named = df.select(F.col(id_col).cast("long").alias("id"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in entities.items()])).alias("e"))
    named = materialize(named.where("id IS NOT NULL AND e.key IS NOT NULL").select("id", "e.kind", "e.key"))
    firsts = named.groupBy("kind", "key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return named.join(firsts, ["kind", "key"]).select("id", "kind", "first")


def propagate_labels(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``id, label`` for every linked record: the smallest id it reaches over shared entities.

    Raises after ``max_rounds`` rounds without rest, rather than return labels that are not final; a chain of 2**30
    entities needs about 40.
    """
    links = materialize(links)
    entity = F.concat_ws(":", "kind", F.col("first"))
    # the records that name two entities are the only ways between entities
    ways = links.groupBy("id").agg(F.collect_set(entity).alias("es")).where(F.size("es") > 1)
    pairs = materialize(ways.select(F.explode("es").alias("a"), F.array_min("es").alias("b")).where("a <> b").distinct())
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(links.groupBy(entity.alias("a")).agg(F.min("id").alias("own")).withColumn("label", F.col("own")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        heard = labels.join(near, "a", "left").select("a", "own", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # a label is the id of a record: what the entities named after it, or labelled with it, heard counts for all
        known = heard.select(F.col("own").alias("x"), "label").unionByName(heard.select(F.col("old").alias("x"), "label")).groupBy("x").agg(F.min("label").alias("best"))
        first = heard.join(known, F.col("old") == F.col("x")).select("a", "own", "old", F.least("label", "best").alias("label"))
        then = known.select(F.col("x").alias("y"), F.col("best").alias("farther"))
        new = materialize(first.join(then, F.col("label") == F.col("y"), "left").select("a", "own", "old", F.least("label", "farther").alias("label")))
        moved = new.where("label <> old").limit(1).count()
        drop(labels)
        labels = new.select("a", "own", "label")
        if not moved:
            break
    else:
        raise RuntimeError(f"labels still change after {max_rounds} rounds")
    reached = links.select("id", entity.alias("a")).join(labels, "a").groupBy("id").agg(F.min("label").alias("label"))
    return reached


def related_groups(df: DataFrame, id_col: str = "mol_id", structure_col: str = "smiles", series_col: str = "series_code") -> DataFrame:
    """``id, label`` of the records that share a series or the longest component of their structure with another one,
    directly or through others; ``label`` is the smallest id of the group.

    Null or blank structures and placeholder series link nothing. A repeated id counts as one record.
    """
    entities = {"series": series_key(F.col(series_col)), "structure": longest_component(F.col(structure_col).cast("string"))}
    return propagate_labels(entity_links(df, id_col, entities))


def related_members(df: DataFrame, **cols: str) -> DataFrame:
    """``first_id, mol_id`` for each member of a group other than its smallest."""
    return related_groups(df, **cols).where("id <> label").select(F.col("label").alias("first_id"), F.col("id").alias("mol_id"))


_STEPS = 8


def _fill(groups: list, targets: np.ndarray, rows: np.ndarray) -> list[int]:
    """Splits for large groups, largest first: each goes where the squared relative miss over size and labels is least."""
    want = targets[:, None] * rows[None, :]
    have, out = np.zeros_like(want), []
    scale = np.maximum(rows, 1.0)
    for g in groups:
        v = np.asarray(g, float)
        miss = [(((have + (np.arange(len(targets)) == s)[:, None] * v - want) / scale) ** 2).sum() + (1e9 if targets[s] <= 0 else 0) for s in range(len(targets))]
        s = int(np.argmin(miss))
        have[s] += v
        out.append(s)
    return out


def _open_shares(strata: dict[int, tuple], left: np.ndarray, t: np.ndarray, rounds: int = 300) -> dict[int, np.ndarray]:
    """For each stratum, its shares of the splits, such that the strata together give each split the rows of each label
    that are ``left``: iterative scaling, a stratum moving with a label by that label's share of its rows."""
    if not strata:
        return {}
    n = np.array([strata[k] for k in strata], float)
    f = n / n.sum(1, keepdims=True)
    goal = left / np.maximum(left.sum(0), 1e-9) * n.sum(0)
    x = np.tile(np.maximum(t, 0) / t.sum(), (len(n), 1))
    for _ in range(rounds):
        now = x.T @ n
        x *= np.exp(f @ np.log(np.clip((goal + 1e-9) / (now + 1e-9), 0.1, 10)).T) * (t > 0)
        x /= x.sum(1, keepdims=True)
    return dict(zip(strata, x))


def assign_splits(df: DataFrame, groups: DataFrame, targets: DataFrame, id_col: str = "mol_id", label_col: str = "label", large_share: float = 0.0005) -> DataFrame:
    """``scheme, mol_id, group_id, label, split`` for every record and scheme of ``targets``.

    Groups of at least ``large_share`` of all rows, ``1 / large_share`` of them at most, are placed one by one on the
    driver, largest first, where the deviation of sizes and label counts is least. The others are so many that they
    can be laid end to end: they are ordered within strata of like label shares by a hash of their id, and each is
    placed by where its middle falls between the shares that the large groups leave open to the stratum's labels;
    running totals come from per-bucket sums, so no task holds a whole stratum. A group is never parted. Null labels
    are a class of their own.
    """
    spark = df.sparkSession
    schemes: dict[str, list[tuple[str, float]]] = {}
    for r in targets.where("scheme IS NOT NULL AND split IS NOT NULL").orderBy("scheme", "split").collect():  # a parameter table
        schemes.setdefault(r["scheme"], []).append((r["split"], float(r["target_share"] or 0)))
    cls = F.when(F.col(label_col) == 1, 1).when(F.col(label_col) == 0, 0).otherwise(2)
    member = df.select(F.col(id_col).cast("long").alias("mol_id"), F.col(label_col).alias("label"), cls.alias("c")).where("mol_id IS NOT NULL")
    member = materialize(member.join(groups.select(F.col("id").alias("mol_id"), F.col("label").alias("g")), "mol_id", "left").withColumn("group_id", F.coalesce("g", "mol_id")).drop("g"))
    sizes = materialize(member.groupBy("group_id").agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in range(3)]).withColumn("n", F.expr("n0 + n1 + n2")))
    total = sizes.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n0", "n1", "n2", "n")]).first()
    large = sizes.where(F.col("n") >= max(2, large_share * total["n"])).orderBy(F.desc("n"), "group_id").collect()  # at most 1 / large_share rows
    rows = np.array([total["n0"], total["n1"], total["n2"], total["n"]], float)
    # strata: shares of label 1 and of null labels in steps; buckets of a hash keep running totals distributed
    step = lambda n: F.floor(F.col(n) / F.col("n") * _STEPS + 0.5)
    stratum = (step("n1") * 100 + F.least(step("n2"), _STEPS - step("n1"))).cast("int")
    big = spark.createDataFrame([(g["group_id"],) for g in large], "group_id long")
    small = sizes.join(F.broadcast(big), "group_id", "left_anti").withColumn("k", stratum)
    strata = {r["k"]: (r["n0"], r["n1"], r["n2"]) for r in small.groupBy("k").agg(*[F.sum(x).alias(x) for x in ("n0", "n1", "n2")]).collect()}  # 45 rows at most
    placed, shares = [], []
    for scheme, parts in schemes.items():
        t = np.array([p for _, p in parts])
        t = t / t.sum() if t.sum() > 0 else np.full(len(parts), 1 / len(parts))
        where = _fill([(g["n0"], g["n1"], g["n2"], g["n"]) for g in large], t, rows)
        placed += [(scheme, g["group_id"], parts[s][0]) for g, s in zip(large, where)]
        have = np.zeros((len(parts), 3))
        for g, s in zip(large, where):
            have[s] += (g["n0"], g["n1"], g["n2"])
        for k, mix in _open_shares(strata, np.maximum(t[:, None] * rows[None, :3] - have, 0), t).items():
            ends = np.cumsum(mix)
            shares += [(scheme, k, parts[s][0], float(ends[s - 1]) if s else 0.0, float(ends[s]) if s + 1 < len(parts) else 1.0 + 1e-9) for s in range(len(parts))]
    large_at = spark.createDataFrame(placed, "scheme string, group_id long, split string")
    bounds = spark.createDataFrame(shares, "scheme string, k int, split string, lo double, hi double").where("hi > lo")
    small = small.select("group_id", "n", "k", F.pmod(F.xxhash64("group_id"), F.lit(512)).alias("bucket"))
    per = small.groupBy("k", "bucket").agg(F.sum("n").alias("m"))
    before = per.select("k", "bucket", (F.sum("m").over(Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy("k")).alias("all"))  # 45 strata x 512 buckets
    inner = F.sum("n").over(Window.partitionBy("k", "bucket").orderBy(F.xxhash64("group_id", F.lit(7)), "group_id").rowsBetween(Window.unboundedPreceding, 0))
    at = small.withColumn("upto", inner).join(F.broadcast(before), ["k", "bucket"]).select("group_id", "k", ((F.col("before") + F.col("upto") - F.col("n") / 2) / F.col("all")).alias("x"))
    small_at = at.join(F.broadcast(bounds), (at["k"] == bounds["k"]) & (at["x"] >= bounds["lo"]) & (at["x"] < bounds["hi"])).select("scheme", "group_id", "split")
    return member.join(small_at.unionByName(large_at), "group_id").select("scheme", "mol_id", "group_id", "label", "split")


def split_report(assigned: DataFrame) -> DataFrame:
    """``scheme, split, n_rows, n_groups, n_active, row_share, active_share``."""
    per_group = assigned.groupBy("scheme", "split", "group_id").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("a"))
    out = per_group.groupBy("scheme", "split").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.sum("a").alias("n_active"))
    w = Window.partitionBy("scheme")
    return out.select("scheme", "split", "n_rows", "n_groups", "n_active", (F.col("n_rows") / F.sum("n_rows").over(w)).alias("row_share"), (F.col("n_active") / F.col("n_rows")).alias("active_share"))
