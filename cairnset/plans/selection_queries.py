"""Cluster roll-ups and selection queries on the medoids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnset.operators import selection as sel
from cairnset.plans.tables import MEDOIDS, medoids, rounded
from cairnset.storage import materialize

K = 200


def _decoys(m: DataFrame) -> DataFrame:
    return m.where("kind = 'decoy'").select("id", "cluster_id", "mass")


def _vendor_weight(m: DataFrame) -> DataFrame:
    """``cluster_id, weight, capacity``: vendor mass and decoys of each cluster that holds a decoy."""
    per = m.groupBy("cluster_id").agg(F.coalesce(F.sum(F.when(F.col("kind") == "vendor", F.col("mass"))), F.lit(0)).alias("weight"), F.count_if(F.col("kind") == "decoy").alias("capacity"))
    return per.where("capacity > 0")


def cluster_counts(spark: SparkSession, sf: str) -> DataFrame:
    return medoids(spark, sf).groupBy("cluster_id").agg(F.count_if(F.col("kind") == "active").alias("n_active"), F.count_if(F.col("kind") == "decoy").alias("n_decoy"), F.max(F.col("kind") == "active").alias("has_active"))


def cluster_composition(spark: SparkSession, sf: str) -> DataFrame:
    c = cluster_counts(spark, sf)
    kind = F.when((F.col("n_active") > 0) & (F.col("n_decoy") > 0), "mixed").when(F.col("n_active") > 0, "active").when(F.col("n_decoy") > 0, "decoy").otherwise("vendor")
    per = c.groupBy(kind.alias("composition")).agg(F.count("*").alias("n_clusters"))
    total = c.agg(F.count("*").alias("all"))
    return rounded(per.join(F.broadcast(total)).select("composition", "n_clusters", (F.col("n_clusters") / F.col("all")).alias("share")), "share")


def cluster_masses(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0)).alias(f"{k}_mass")
    return medoids(spark, sf).groupBy("cluster_id").agg(*map(of, ("active", "decoy", "vendor")), F.sum("mass").alias("all_mass"), F.count("*").alias("n"))


def cluster_library_masses(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each library of a cluster; :func:`cluster_library_maps` has them as a map."""
    return medoids(spark, sf).groupBy("cluster_id", "library").agg(F.sum("mass").alias("mass"))


def cluster_library_maps(spark: SparkSession, sf: str) -> DataFrame:
    per = cluster_library_masses(spark, sf)
    entries = F.array_sort(F.collect_list(F.struct("library", "mass")))
    return per.groupBy("cluster_id").agg(F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["library"], e["mass"])), ";").alias("library_mass"))


def rows_with_cluster_counts(spark: SparkSession, sf: str) -> DataFrame:
    return medoids(spark, sf).select("id", "cluster_id").join(cluster_counts(spark, sf), "cluster_id", "left").select("id", "cluster_id", "n_active", "n_decoy")


def pure_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Medoids of clusters without an active: an anti join."""
    m = materialize(medoids(spark, sf).select("id", "kind", "cluster_id"))
    return m.join(m.where("kind = 'active'").select("cluster_id"), "cluster_id", "left_anti").select("id")


def heaviest_in_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return sel.top_in_group(medoids(spark, sf).select("id", "cluster_id", "mass"), "cluster_id", [-F.col("mass"), F.col("id")], F.lit(3)).select("id", "cluster_id", "mass", F.col("rn").cast("long").alias("rank"))


def one_per_cluster(spark: SparkSession, sf: str) -> DataFrame:
    m = medoids(spark, sf)
    return sel.one_per_cluster(_decoys(m), _vendor_weight(m), 50)


def anchored_allocation(spark: SparkSession, sf: str) -> DataFrame:
    """Within what each cluster holds: if that is less than the total, as much as fits."""
    shares = materialize(sel.anchored_shares(materialize(_vendor_weight(medoids(spark, sf))), K, 20, 60, 0.5))
    return rounded(sel.largest_remainder(shares, K, strict=False).select("cluster_id", "theory", F.col("allocated").cast("long").alias("allocated")), "theory")


def anchored_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Quotas by anchored shares, filled by mass, topped up by mass to the total."""
    quotas = anchored_allocation(spark, sf)
    decoys = materialize(_decoys(medoids(spark, sf)))
    return sel.top_up(sel.fill_quotas(decoys, quotas), decoys, K)


def active_reserve(spark: SparkSession, sf: str) -> DataFrame:
    return sel.active_cluster_reserve(medoids(spark, sf).select("id", "cluster_id", "mass", "kind"), 40)


def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    m = medoids(spark, sf)
    sized = _decoys(m).join(m.groupBy("cluster_id").agg(F.count("*").alias("n")), "cluster_id")
    picked = sel.round_robin(sized.select("id", "cluster_id", "mass", "n"), [F.desc("n"), F.col("cluster_id")], [-F.col("mass"), F.col("id")], K)
    return picked.select("id", "cluster_id", F.col("pick").cast("long").alias("pick"))


def library_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sel.hashed_sample_per(medoids(spark, sf).select("id", "library"), "library", "id", 25, 42).select("id", "library")


def background_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sel.hashed_sample(_decoys(medoids(spark, sf)), "id", 100, 52).select("id")


def mass_coverage(spark: SparkSession, sf: str) -> DataFrame:
    d = _decoys(medoids(spark, sf))
    return rounded(sel.topk_mass_coverage(sel.hashed_sample(d, "id", 100, 52), d), "coverage")


def touched_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Vendor mass of clusters that the one-per-cluster selection touches, over that of clusters with a decoy."""
    m = materialize(medoids(spark, sf).select("id", "kind", "cluster_id", "mass"))
    w = materialize(_vendor_weight(m))
    touched = sel.one_per_cluster(_decoys(m), w, 50).select("cluster_id", F.lit(True).alias("hit"))
    return rounded(w.join(touched, "cluster_id", "left").agg(F.coalesce(F.sum(F.when(F.col("hit"), F.col("weight"))), F.lit(0)).alias("touched_mass"), F.sum("weight").alias("pickable_mass"), (F.coalesce(F.sum(F.when(F.col("hit"), F.col("weight"))), F.lit(0)) / F.nullif(F.sum("weight"), F.lit(0))).alias("coverage")), "coverage")


QUERIES = {f.__name__: f for f in (cluster_counts, cluster_composition, cluster_masses, cluster_library_masses, cluster_library_maps, rows_with_cluster_counts, pure_clusters, heaviest_in_cluster, one_per_cluster, anchored_allocation, anchored_selection, active_reserve, round_robin, library_sample, background_sample, mass_coverage, touched_coverage)}

_W = f"WITH {MEDOIDS}"
_CC = "cc AS (SELECT cluster_id, count(*) FILTER (WHERE kind = 'active') AS n_active, count(*) FILTER (WHERE kind = 'decoy') AS n_decoy FROM m GROUP BY cluster_id)"
_VW = "vw AS (SELECT cluster_id, CAST(coalesce(sum(CASE WHEN kind = 'vendor' THEN mass END), 0) AS BIGINT) AS weight, count(*) FILTER (WHERE kind = 'decoy') AS capacity FROM m GROUP BY cluster_id HAVING count(*) FILTER (WHERE kind = 'decoy') > 0)"
_D = "d AS (SELECT id, cluster_id, mass FROM m WHERE kind = 'decoy')"
_ONE = "top AS (SELECT cluster_id FROM vw ORDER BY weight DESC, cluster_id LIMIT 50), one AS (SELECT id, cluster_id, mass FROM (SELECT d.*, row_number() OVER (PARTITION BY cluster_id ORDER BY mass DESC, id) AS rn FROM d JOIN top USING (cluster_id)) WHERE rn = 1)"
_ALLOC = f"""pool AS (SELECT *, row_number() OVER (ORDER BY weight DESC, cluster_id) AS r FROM vw), p AS (SELECT *, CASE WHEN weight > 0 THEN pow(weight, 0.5) ELSE 0.0 END AS pw FROM pool WHERE r <= 60),
th AS (SELECT cluster_id, capacity, CASE WHEN r <= 20 THEN 1 ELSE 0 END + (CASE WHEN sum(pw) OVER () > 0 THEN pw / sum(pw) OVER () ELSE 1.0 / count(*) OVER () END) * {K - 20} AS theory FROM p),
fl AS (SELECT cluster_id, theory, CAST(least(floor(theory), capacity) AS BIGINT) AS base, theory - floor(theory) AS frac, CAST(least(ceil(theory), capacity) AS BIGINT) AS cap FROM th),
al AS (SELECT cluster_id, theory, base + CASE WHEN base < cap AND row_number() OVER (PARTITION BY base < cap ORDER BY frac DESC, cluster_id) <= least({K}, (SELECT sum(cap) FROM fl)) - (SELECT sum(base) FROM fl) THEN 1 ELSE 0 END AS allocated FROM fl)"""
_HASH = lambda seed, col: f"md5('{seed}:' || CAST({col} AS VARCHAR))"
_BG = f"bg AS (SELECT id, mass FROM d ORDER BY {_HASH(52, 'id')}, id LIMIT 100)"
SQL = {
    "cluster_counts": f"{_W} SELECT cluster_id, count(*) FILTER (WHERE kind = 'active') AS n_active, count(*) FILTER (WHERE kind = 'decoy') AS n_decoy, bool_or(kind = 'active') AS has_active FROM m GROUP BY cluster_id",
    "cluster_composition": f"{_W}, {_CC} SELECT CASE WHEN n_active > 0 AND n_decoy > 0 THEN 'mixed' WHEN n_active > 0 THEN 'active' WHEN n_decoy > 0 THEN 'decoy' ELSE 'vendor' END AS composition, count(*) AS n_clusters, round(count(*) / CAST((SELECT count(*) FROM cc) AS DOUBLE), 6) AS share FROM cc GROUP BY 1",
    "cluster_masses": f"{_W} SELECT cluster_id, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN kind = '{k}' THEN mass END), 0) AS BIGINT) AS {k}_mass" for k in ("active", "decoy", "vendor")) + ", CAST(sum(mass) AS BIGINT) AS all_mass, count(*) AS n FROM m GROUP BY cluster_id",
    "cluster_library_masses": f"{_W} SELECT cluster_id, library, CAST(sum(mass) AS BIGINT) AS mass FROM m GROUP BY ALL",
    "cluster_library_maps": f"{_W}, p AS (SELECT cluster_id, library, CAST(sum(mass) AS BIGINT) AS mass FROM m GROUP BY ALL) SELECT cluster_id, string_agg(library || '=' || CAST(mass AS VARCHAR), ';' ORDER BY library) AS library_mass FROM p GROUP BY cluster_id",
    "rows_with_cluster_counts": f"{_W}, {_CC} SELECT id, cluster_id, n_active, n_decoy FROM m LEFT JOIN cc USING (cluster_id)",
    "pure_clusters": f"{_W} SELECT id FROM m WHERE cluster_id NOT IN (SELECT cluster_id FROM m WHERE kind = 'active')",
    "heaviest_in_cluster": f"{_W} SELECT id, cluster_id, mass, rank FROM (SELECT id, cluster_id, mass, row_number() OVER (PARTITION BY cluster_id ORDER BY mass DESC, id) AS rank FROM m) WHERE rank <= 3",
    "one_per_cluster": f"{_W}, {_VW}, {_D}, {_ONE} SELECT id, cluster_id, mass FROM one",
    "anchored_allocation": f"{_W}, {_VW}, {_ALLOC} SELECT cluster_id, round(theory, 6) AS theory, CAST(allocated AS BIGINT) AS allocated FROM al",
    "anchored_selection": f"{_W}, {_VW}, {_D}, {_ALLOC}, f AS (SELECT id, cluster_id, mass FROM (SELECT d.*, allocated, row_number() OVER (PARTITION BY cluster_id ORDER BY mass DESC, id) AS rn FROM d JOIN al USING (cluster_id)) WHERE rn <= allocated), rest AS (SELECT *, row_number() OVER (ORDER BY mass DESC, id) AS r FROM d WHERE id NOT IN (SELECT id FROM f)) SELECT id, cluster_id, mass FROM f UNION ALL SELECT id, cluster_id, mass FROM rest WHERE r <= greatest(0, {K} - (SELECT count(*) FROM f))",
    "active_reserve": f"{_W}, s AS (SELECT cluster_id, sum(mass) AS am, sum(CASE WHEN kind = 'active' THEN mass END) AS ac, sum(CASE WHEN kind = 'decoy' THEN mass END) AS dm FROM m GROUP BY cluster_id) SELECT id, cluster_id, mass FROM m JOIN s USING (cluster_id) WHERE kind = 'decoy' AND ac IS NOT NULL AND dm IS NOT NULL ORDER BY am DESC, ac DESC, dm DESC, cluster_id, mass DESC, id LIMIT 40",
    "round_robin": f"{_W}, {_D}, n AS (SELECT cluster_id, count(*) AS n FROM m GROUP BY cluster_id), r AS (SELECT d.*, n, row_number() OVER (PARTITION BY cluster_id ORDER BY mass DESC, id) AS rd FROM d JOIN n USING (cluster_id)) SELECT id, cluster_id, row_number() OVER (ORDER BY rd, n DESC, cluster_id) AS pick FROM r ORDER BY pick LIMIT {K}",
    "library_sample": f"{_W} SELECT id, library FROM (SELECT id, library, row_number() OVER (PARTITION BY library ORDER BY {_HASH(42, 'id')}, id) AS rn FROM m) WHERE rn <= 25",
    "background_sample": f"{_W}, {_D}, {_BG} SELECT id FROM bg",
    "mass_coverage": f"{_W}, {_D}, {_BG}, t AS (SELECT sum(mass) AS t FROM (SELECT mass FROM d ORDER BY mass DESC, id LIMIT (SELECT count(*) FROM bg))) SELECT count(*) AS n_selected, CAST(sum(mass) AS BIGINT) AS mass_selected, CAST(any_value(t) AS BIGINT) AS mass_topk, round(sum(mass) / CAST(any_value(t) AS DOUBLE), 6) AS coverage FROM bg, t",
    "touched_coverage": f"{_W}, {_VW}, {_D}, {_ONE} SELECT CAST(coalesce(sum(weight) FILTER (WHERE cluster_id IN (SELECT cluster_id FROM one)), 0) AS BIGINT) AS touched_mass, CAST(sum(weight) AS BIGINT) AS pickable_mass, round(coalesce(sum(weight) FILTER (WHERE cluster_id IN (SELECT cluster_id FROM one)), 0) / CAST(sum(weight) AS DOUBLE), 6) AS coverage FROM vw",
}
