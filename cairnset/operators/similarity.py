"""Set similarity of fingerprints: nearest neighbours of a query set, n-ary averages and medoids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnset.functions.fingerprints import N_BITS
from cairnset.operators.running import running_totals


def _dense(bits: pd.Series, n_bits: int) -> np.ndarray:
    lens = np.fromiter((len(b) for b in bits), np.int64, len(bits))
    out = np.zeros((len(bits), n_bits), np.float32)
    if lens.sum():
        out[np.repeat(np.arange(len(bits)), lens), np.concatenate(bits.to_numpy()).astype(np.int64)] = 1
    return out


def block_similarities(queries: DataFrame, candidates: DataFrame, reduce_block, schema: str, n_bits: int = N_BITS, query_block: int = 512, candidate_block: int = 4096) -> DataFrame:
    """A stated query set against all candidates, in blocks: each pair of a query block and a candidate block is one
    small matrix product in a task, of which ``reduce_block(queries, candidates, similarities)`` keeps a few rows.

    Both sides have ``id, bits`` (clean), candidates also ``grp``. Sizes of blocks bound a task's memory; the number of
    blocks follows the tables.
    """
    n_q = max(1, -(-queries.count() // query_block))
    n_c = max(1, -(-candidates.count() // candidate_block))
    candidates = candidates.select(*[F.col(c).alias(c) for c in candidates.columns])  # own columns, also where both sides are one table
    q = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_q)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    c = candidates.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(n_c)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def compare(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or cs.empty:
            return reduce_block(qs.iloc[:0], cs.iloc[:0], np.zeros((0, 0)))
        cs = cs.sort_values("id").reset_index(drop=True)
        a, b = _dense(qs["bits"], n_bits), _dense(cs["bits"], n_bits)
        common = (a @ b.T).astype(np.float64)
        union = a.sum(1, dtype=np.float64)[:, None] + b.sum(1, dtype=np.float64)[None, :] - common
        return reduce_block(qs, cs, np.divide(common, union, out=np.zeros_like(common), where=union > 0))

    return q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(compare, schema)


def nearest_by_group(queries: DataFrame, candidates: DataFrame, exclude_self: bool = False, n_bits: int = N_BITS) -> DataFrame:
    """``q_id, grp, best_id, sim``: for each query and candidate group, the most similar candidate; ties go to the
    smallest id, and two empty fingerprints have similarity 0."""

    def best(qs: pd.DataFrame, cs: pd.DataFrame, sim: np.ndarray) -> pd.DataFrame:
        out = []
        if len(qs):
            if exclude_self:
                sim = np.where(qs["id"].to_numpy()[:, None] == cs["id"].to_numpy()[None, :], -1.0, sim)
            for grp, at in cs.groupby("grp", dropna=False).indices.items():
                j = sim[:, at].argmax(1)
                out.append(pd.DataFrame({"q_id": qs["id"].to_numpy(), "grp": grp, "best_id": cs["id"].to_numpy()[at][j], "sim": sim[np.arange(len(qs)), at[j]]}))
        out = pd.concat(out) if out else pd.DataFrame({"q_id": [], "grp": [], "best_id": [], "sim": []})
        return out[out["sim"] >= 0]

    part = block_similarities(queries.select("id", "bits"), candidates.select("id", "bits", F.col("grp").cast("string").alias("grp")), best, "q_id long, grp string, best_id long, sim double", n_bits)
    top = F.max(F.struct("sim", (-F.col("best_id")).alias("neg")))
    return part.groupBy("q_id", "grp").agg(top.alias("t")).select("q_id", "grp", (-F.col("t.neg")).alias("best_id"), F.col("t.sim").alias("sim"))


def counts_over(queries: DataFrame, candidates: DataFrame, levels: tuple[float, ...] = (0.5, 0.6, 0.7), n_bits: int = N_BITS) -> DataFrame:
    """``q_id, n, sum_sim, sum_sq, n_0..``: similarity of each query to all candidates but itself, summed, and how many
    reach each level."""

    def tally(qs: pd.DataFrame, cs: pd.DataFrame, sim: np.ndarray) -> pd.DataFrame:
        cols = ["q_id", "n", "sum_sim", "sum_sq", *[f"n_{i}" for i in range(len(levels))]]
        if not len(qs):
            return pd.DataFrame({c: [] for c in cols})
        other = qs["id"].to_numpy()[:, None] != cs["id"].to_numpy()[None, :]
        s = np.where(other, sim, 0.0)
        return pd.DataFrame(dict(zip(cols, [qs["id"].to_numpy(), other.sum(1), s.sum(1), (s * s).sum(1), *[((s >= x) & other).sum(1) for x in levels]])))

    schema = "q_id long, n long, sum_sim double, sum_sq double, " + ", ".join(f"n_{i} long" for i in range(len(levels)))
    part = block_similarities(queries.select("id", "bits"), candidates.select("id", "bits"), tally, schema, n_bits)
    return part.groupBy("q_id").agg(*[F.sum(c).alias(c) for c in part.columns[1:]])


def column_sums(fps: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, bit, k``: how many fingerprints of a group have each bit."""
    return fps.select(*keys, F.explode("bits").alias("bit")).groupBy(*keys, "bit").agg(F.count("*").alias("k"))


def isim(fps: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, isim``: n-ary Tanimoto average of each group, from its column sums; null under two fingerprints or
    without any bit."""
    n = fps.groupBy(*keys).agg(F.count("*").alias("n"))
    terms = column_sums(fps, keys).groupBy(*keys).agg(F.collect_list("k").alias("ks"))
    both = n.join(terms, keys, "left") if keys else n.crossJoin(terms)
    pairs = F.aggregate("ks", F.lit(0.0), lambda s, k: s + k * (k - 1) / 2)
    mixed = F.aggregate("ks", F.lit(0.0), lambda s, k: s + k * (F.col("n") - k))
    return both.select(*keys, "n", F.when((F.col("n") > 1) & (pairs + mixed > 0), pairs / (pairs + mixed)).alias("isim"))


def complementary_isim(fps: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, id, comp``: the n-ary average of the group without each member, from column sums less its own bits.

    Per bit the sums change only where the member has it, so one pass over the on-bits gives all members.
    """
    sums = column_sums(fps, keys)
    n = fps.groupBy(*keys).agg(F.count("*").alias("n"))
    k, m = F.col("k").cast("double"), (F.col("n") - 1).cast("double")
    base = sums.join(n, keys).groupBy(*keys, "n").agg(F.sum(k * (k - 1) / 2).alias("p"), F.sum(k * (m - k)).alias("x"))
    own = fps.select(*keys, "id", F.explode("bits").alias("bit")).join(sums, [*keys, "bit"])
    change = own.groupBy(*keys, "id").agg(F.sum("k").cast("double").alias("sk"), F.count("*").cast("double").alias("nb"))
    # (k-1)(k-2)/2 - k(k-1)/2 = 1-k ; (k-1)(m-k+1) - k(m-k) = 2k-m-1
    both = change.join(base, keys)
    pairs = F.col("p") + F.col("nb") - F.col("sk")
    mixed = F.col("x") + 2 * F.col("sk") - (F.col("n") * F.col("nb"))
    return both.select(*keys, "id", F.when((F.col("n") > 2) & (pairs + mixed > 0), pairs / (pairs + mixed)).alias("comp"))


def isim_medoid(fps: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, medoid_id``: the member whose leaving lowers the average most (ties: smallest id); in groups of one or
    two, the smallest id."""
    best = F.min(F.struct(F.coalesce("comp", F.lit(0.0)).alias("comp"), "id"))
    return complementary_isim(fps, keys).groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.id").alias("medoid_id"))


def stratified_by_centrality(fps: DataFrame, n: int) -> DataFrame:
    """``id, stratum``: the first member of each of ``n`` strata of complementary similarity, most central first."""
    comp = complementary_isim(fps.withColumn("_all", F.lit(1)), ["_all"]).select("id", F.coalesce("comp", F.lit(0.0)).alias("comp"))
    ranked = running_totals(comp, [], [F.col("comp"), F.col("id")], {"rank": F.lit(1)})
    placed = ranked.withColumn("stratum", F.floor((F.col("rank") - 1) * F.lit(n) / F.col("rank_all")))
    return placed.groupBy("stratum").agg(F.min(F.struct("comp", "id")).alias("b")).select(F.col("b.id").alias("id"), "stratum")

