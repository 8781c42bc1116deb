"""Similarity queries on the medoids: every row whose id is divisible by 100 against all rows, and group averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnset.functions import fingerprints as fp
from cairnset.operators import metrics, similarity
from cairnset.plans.tables import MEDOIDS, medoids, rounded, table
from cairnset.storage import materialize

_SIM = "CASE WHEN len(q.bits) + len(c.bits) - len(list_intersect(q.bits, c.bits)) > 0 THEN len(list_intersect(q.bits, c.bits)) / CAST(len(q.bits) + len(c.bits) - len(list_intersect(q.bits, c.bits)) AS DOUBLE) ELSE 0.0 END"
_PAIRS = f"WITH {MEDOIDS}, q AS (SELECT * FROM m WHERE id % 100 = 0), pairs AS (SELECT q.id AS q_id, q.mass AS q_mass, c.id AS c_id, c.library, c.kind, {_SIM} AS sim FROM q, m c WHERE q.id <> c.id)"
_BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id, library ORDER BY sim DESC, c_id) AS rn FROM pairs) WHERE rn = 1)"
_WIN = "win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, library) AS w FROM best) WHERE w = 1)"


def _nearest(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize(medoids(spark, sf))
    q = rows.where("id % 100 = 0")
    found = similarity.nearest_by_group(q, rows.withColumn("grp", F.col("library")), exclude_self=True)
    return materialize(found.join(q.select(F.col("id").alias("q_id"), F.col("mass").alias("q_mass")), "q_id"))


def nn_by_library(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_nearest(spark, sf).select("q_id", F.col("grp").alias("library"), "best_id", "sim"), "sim")


def _winners(near: DataFrame) -> DataFrame:
    """The library of each query's best score (ties: first by name): a maximum, no window."""
    best = F.min(F.struct((-F.col("sim")).alias("neg"), F.col("grp").alias("library"), "best_id", "q_mass")).alias("b")
    return near.groupBy("q_id").agg(best).select("q_id", "b.library", "b.best_id", (-F.col("b.neg")).alias("sim"), F.col("b.q_mass").alias("q_mass"))


def nn_best_library(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_winners(_nearest(spark, sf)).select("q_id", "library", "best_id", "sim"), "sim")


def nn_win_summary(spark: SparkSession, sf: str) -> DataFrame:
    w = _winners(_nearest(spark, sf))
    s = metrics.summary(w, ["library"], "sim").select("library", F.col("n").alias("wins"), "mean", "median", "q05", "q95")
    heavy = w.groupBy("library").agg(F.sum("q_mass").alias("weighted_wins"), F.when(F.sum("q_mass") > 0, F.sum(F.col("sim") * F.col("q_mass")) / F.sum("q_mass")).alias("weighted_mean"))
    return rounded(s.join(heavy, "library"), "mean", "median", "q05", "q95", "weighted_mean")


def nn_library_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = metrics.summary(_nearest(spark, sf), ["grp"], "sim").select(F.col("grp").alias("library"), "n", "mean", "sd", "q05", "q25", "median", "q75", "q95", "low", "high")
    return rounded(s, "mean", "sd", "q05", "q25", "median", "q75", "q95", "low", "high")


def library_reference(spark: SparkSession, sf: str) -> DataFrame:
    return medoids(spark, sf).groupBy("library").agg(F.count("*").alias("n_medoids"), F.sum("mass").alias("represented_mass"))


def exact_matches(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf).where(F.abs(F.col("sim") - 1) <= 1e-8 + 1e-5).select("q_id", F.col("grp").alias("library"), "best_id")


def similarity_moments(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize(medoids(spark, sf))
    t = similarity.counts_over(rows.where("id % 100 = 0"), rows)
    s = t.agg(F.sum("n").alias("n"), F.sum("sum_sim").alias("a"), F.sum("sum_sq").alias("b"))
    mean = F.col("a") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("b") / F.col("n") - mean * mean, F.lit(0.0)))
    return rounded(s.select(F.col("n").alias("n_pairs"), mean.alias("mean"), sd.alias("sd"), (mean + 3.5 * sd).alias("threshold")), "mean", "sd", "threshold")


def neighbour_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Queries by how near the nearest other medoid is: isolated up to 0.5, ambiguous up to 0.7, else boundary."""
    best = _winners(_nearest(spark, sf))
    bucket = F.when(F.col("sim") <= 0.5, "isolated").when(F.col("sim") <= 0.7, "ambiguous").otherwise("boundary")
    return best.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def neighbour_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize(medoids(spark, sf))
    return similarity.counts_over(rows.where("id % 100 = 0"), rows).select("q_id", F.col("n_0").alias("n_50"), F.col("n_1").alias("n_60"), F.col("n_2").alias("n_70"))


def isim_by_library(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(similarity.isim(medoids(spark, sf), ["library"]), "isim")


def isim_by_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(similarity.isim(medoids(spark, sf), ["cluster_id"]), "isim")


def isim_medoids(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.isim_medoid(medoids(spark, sf).where("size(bits) > 0"), ["library"])


def isim_strata(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.stratified_by_centrality(medoids(spark, sf).where("size(bits) > 0"), 50)


def fingerprint_words(spark: SparkSession, sf: str) -> DataFrame:
    words = medoids(spark, sf).select("id", "bits", fp.pack_words(F.col("bits")).alias("words"))
    return words.select("id", fp.popcount(F.col("words")).alias("n_on"), (fp.unpack_words(F.col("words")) == F.col("bits")).alias("round_trip"))


def bit_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.column_sums(medoids(spark, sf), ["library"]).select("library", F.col("bit").cast("long").alias("bit"), "k")


def medoid_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return medoids(spark, sf).select("id", "library", "kind", "medoid_index", "mass", "cluster_id")


def excluded_libraries(spark: SparkSession, sf: str) -> DataFrame:
    info = table(spark, sf, "library_info").where("is_excluded").select("library")
    key = lambda c: F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]", ""))
    return table(spark, sf, "npy_medoids").join(F.broadcast(info.withColumn("k", key("library")).drop("library")), F.col("k") == key("library"), "left_semi").select("medoid_id")


QUERIES = {f.__name__: f for f in (nn_by_library, nn_best_library, nn_win_summary, nn_library_scores, library_reference, exact_matches, similarity_moments, neighbour_buckets, neighbour_counts, isim_by_library, isim_by_cluster, isim_medoids, isim_strata, fingerprint_words, bit_frequencies, medoid_catalog, excluded_libraries)}

_ISIM = "WITH {m}, k AS (SELECT {g}, bit, count(*) AS k FROM (SELECT {g}, unnest(bits) AS bit FROM m) GROUP BY ALL), n AS (SELECT {g}, count(*) AS n FROM m GROUP BY ALL) SELECT n.{g}, n.n, CASE WHEN n.n > 1 AND sum(k * (k - 1) / 2.0 + k * (n.n - k)) > 0 THEN round(sum(k * (k - 1) / 2.0) / sum(k * (k - 1) / 2.0 + k * (n.n - k)), 6) END AS isim FROM n LEFT JOIN k USING ({g}) GROUP BY n.{g}, n.n"
_STATS = "round(avg(sim), 6) AS mean, round(stddev_pop(sim), 6) AS sd, round(quantile_cont(sim, 0.05), 6) AS q05, round(quantile_cont(sim, 0.25), 6) AS q25, round(median(sim), 6) AS median, round(quantile_cont(sim, 0.75), 6) AS q75, round(quantile_cont(sim, 0.95), 6) AS q95, round(min(sim), 6) AS low, round(max(sim), 6) AS high"
_COMP = """WITH {m}, f AS (SELECT * FROM m WHERE len(bits) > 0), b AS (SELECT id, {g} AS g, unnest(bits) AS bit FROM f), k AS (SELECT g, bit, count(*) AS k FROM b GROUP BY ALL), n AS (SELECT {g} AS g, count(*) AS n FROM f GROUP BY ALL),
base AS (SELECT g, n, sum(k * (k - 1) / 2.0) AS p, sum(k * (n - 1 - k)) AS x FROM k JOIN n USING (g) GROUP BY ALL),
own AS (SELECT g, id, sum(k) AS sk, count(*) AS nb FROM b JOIN k USING (g, bit) GROUP BY ALL),
comp AS (SELECT g, id, CASE WHEN n > 2 AND p + nb - sk + x + 2 * sk - n * nb > 0 THEN (p + nb - sk) / (p + nb - sk + x + 2 * sk - n * nb) ELSE 0.0 END AS comp FROM own JOIN base USING (g))"""
SQL = {
    "nn_by_library": f"{_PAIRS}, {_BEST} SELECT q_id, library, c_id AS best_id, round(sim, 6) AS sim FROM best",
    "nn_best_library": f"{_PAIRS}, {_BEST}, {_WIN} SELECT q_id, library, c_id AS best_id, round(sim, 6) AS sim FROM win",
    "nn_win_summary": f"{_PAIRS}, {_BEST}, {_WIN} SELECT library, count(*) AS wins, round(avg(sim), 6) AS mean, round(median(sim), 6) AS median, round(quantile_cont(sim, 0.05), 6) AS q05, round(quantile_cont(sim, 0.95), 6) AS q95, CAST(sum(q_mass) AS BIGINT) AS weighted_wins, CASE WHEN sum(q_mass) > 0 THEN round(sum(sim * q_mass) / sum(q_mass), 6) END AS weighted_mean FROM win GROUP BY library",
    "nn_library_scores": f"{_PAIRS}, {_BEST} SELECT library, count(*) AS n, {_STATS} FROM best GROUP BY library",
    "library_reference": f"WITH {MEDOIDS} SELECT library, count(*) AS n_medoids, CAST(sum(mass) AS BIGINT) AS represented_mass FROM m GROUP BY library",
    "exact_matches": f"{_PAIRS}, {_BEST} SELECT q_id, library, c_id AS best_id FROM best WHERE abs(sim - 1) <= 1e-8 + 1e-5",
    "similarity_moments": f"{_PAIRS} SELECT count(*) AS n_pairs, round(avg(sim), 6) AS mean, round(stddev_pop(sim), 6) AS sd, round(avg(sim) + 3.5 * stddev_pop(sim), 6) AS threshold FROM pairs",
    "neighbour_buckets": f"{_PAIRS}, {_BEST}, {_WIN} SELECT CASE WHEN sim <= 0.5 THEN 'isolated' WHEN sim <= 0.7 THEN 'ambiguous' ELSE 'boundary' END AS bucket, count(*) AS n FROM win GROUP BY 1",
    "neighbour_counts": f"{_PAIRS} SELECT q_id, count(*) FILTER (WHERE sim >= 0.5) AS n_50, count(*) FILTER (WHERE sim >= 0.6) AS n_60, count(*) FILTER (WHERE sim >= 0.7) AS n_70 FROM pairs GROUP BY q_id",
    "isim_by_library": _ISIM.format(m=MEDOIDS, g="library"),
    "isim_by_cluster": _ISIM.format(m=MEDOIDS, g="cluster_id"),
    "isim_medoids": _COMP.format(m=MEDOIDS, g="library") + " SELECT g AS library, arg_min(id, (comp, id)) AS medoid_id FROM comp GROUP BY g",
    "isim_strata": _COMP.format(m=MEDOIDS, g="1") + ", r AS (SELECT id, comp, row_number() OVER (ORDER BY comp, id) AS rn, count(*) OVER () AS n FROM comp), t AS (SELECT id, rn, (rn - 1) * 50 // n AS stratum FROM r) SELECT arg_min(id, rn) AS id, CAST(stratum AS BIGINT) AS stratum FROM t GROUP BY stratum",
    "fingerprint_words": f"WITH {MEDOIDS} SELECT id, CAST(len(bits) AS BIGINT) AS n_on, true AS round_trip FROM m",
    "bit_frequencies": f"WITH {MEDOIDS} SELECT library, CAST(bit AS BIGINT) AS bit, count(*) AS k FROM (SELECT library, unnest(bits) AS bit FROM m) GROUP BY ALL",
    "medoid_catalog": f"WITH {MEDOIDS} SELECT id, library, kind, medoid_index, mass, cluster_id FROM m",
    "excluded_libraries": "SELECT medoid_id FROM npy_medoids WHERE lower(regexp_replace(library, '[^a-zA-Z0-9]', '', 'g')) IN (SELECT lower(regexp_replace(library, '[^a-zA-Z0-9]', '', 'g')) FROM library_info WHERE is_excluded)",
}
