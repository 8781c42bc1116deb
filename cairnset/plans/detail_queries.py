"""Smaller steps of the procedures: representatives, set operations, keys, scaling, bands and densities."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnset.functions.fingerprints import tanimoto
from cairnset.operators import hexbin, similarity
from cairnset.operators.running import quantiles
from cairnset.operators.selection import balanced_draw
from cairnset.plans.selection_queries import _HASH
from cairnset.plans.similarity_queries import _COMP
from cairnset.plans.space_queries import NBINS
from cairnset.plans.tables import MEDOIDS, POINTS, hex_sql, medoids, points, rounded, table
from cairnset.storage import materialize


def members_to_medoid(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of each medoid to the one that stands for its coarse cluster: one pair a row."""
    m = medoids(spark, sf).where("size(bits) > 0")
    rep = similarity.isim_medoid(m, ["cluster_id"])
    reps = rep.join(m.select(F.col("id").alias("medoid_id"), F.col("bits").alias("rep_bits")), "medoid_id")
    return rounded(m.join(reps, "cluster_id").select("id", "medoid_id", tanimoto(F.col("bits"), F.col("rep_bits")).alias("sim")), "sim")


def nearest_centre(spark: SparkSession, sf: str) -> DataFrame:
    """Points at the nearest occupied centre by plain distance; the centres are as few as the grid has cells."""
    p = points(spark, sf)
    at = hexbin.with_hex(p, NBINS, hexbin.limits(p))
    centres = at.groupBy("hex_id").agg(F.first("cx").alias("cx"), F.first("cy").alias("cy"))
    d2 = F.round((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2, 9)
    best = F.min(F.struct(d2.alias("d2"), F.col("hex_id"))).alias("b")
    return p.select("id", "x", "y").join(F.broadcast(centres)).groupBy("id").agg(best).select("id", F.round(F.sqrt("b.d2"), 6).alias("distance"))


def collapsed_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster id of each medoid if it is one of the 25 largest, else -1, with a label."""
    m = medoids(spark, sf)
    top = m.groupBy("cluster_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster_id").limit(25).select("cluster_id", F.lit(True).alias("top"))
    joined = m.select("id", "cluster_id").join(F.broadcast(top), "cluster_id", "left")  # 25 rows
    return joined.select("id", F.when(F.col("top"), F.col("cluster_id")).otherwise(F.lit(-1).cast("long")).alias("cluster_id"), F.when(F.col("top"), F.concat(F.lit("cluster "), F.col("cluster_id").cast("string"))).otherwise("other").alias("label"))


def scaled_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Standard scores by brand: a spread under 0.1 counts as 1, unknown values are masked."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_retailprice").cast("double").alias("v"))
    s = p.groupBy("p_brand").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    sd = F.when(F.col("sd") < 0.1, 1.0).otherwise(F.col("sd"))
    return rounded(p.join(s, "p_brand").select("p_partkey", ((F.col("v") - F.col("mean")) / (sd + 1e-8)).alias("z"), F.col("v").isNotNull().alias("known")), "z")


def vendor_only_bits(spark: SparkSession, sf: str) -> DataFrame:
    """Bits that some vendor medoid has and no active one: a set difference."""
    b = medoids(spark, sf).select("kind", F.explode("bits").alias("bit"))
    return b.where("kind = 'vendor'").select("bit").distinct().join(b.where("kind = 'active'").select("bit"), "bit", "left_anti").select(F.col("bit").cast("long").alias("bit"))


def shared_bits(spark: SparkSession, sf: str) -> DataFrame:
    """Bits of active and decoy medoids: an intersection."""
    b = medoids(spark, sf).select("kind", F.explode("bits").alias("bit"))
    return b.where("kind = 'active'").select("bit").intersect(b.where("kind = 'decoy'").select("bit")).select(F.col("bit").cast("long").alias("bit"))


def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Name and structure as one key, line breaks as blanks."""
    clean = lambda c: F.coalesce(F.regexp_replace(c, "\r\n|\r|\n", " "), F.lit(""))
    return table(spark, sf, "umap_dataset").select("mol_id", F.concat_ws("||", clean("title"), clean("smiles")).alias("cache_key"))


def json_bits(spark: SparkSession, sf: str) -> DataFrame:
    """Bits as JSON text and back."""
    m = medoids(spark, sf).select("id", "bits", F.to_json("bits").alias("as_json"))
    return m.select("id", "as_json", (F.from_json("as_json", "array<int>") == F.col("bits")).alias("same"))


def radial_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Points by thirds of their distance from the mean position."""
    p = points(spark, sf)
    mid = p.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    r = p.join(F.broadcast(mid)).withColumn("r", F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2))
    r = materialize(r)
    q = quantiles(r, [], "r", {"a": 1 / 3, "b": 2 / 3})
    band = F.when(F.col("r") <= F.col("a"), "inner").when(F.col("r") <= F.col("b"), "middle").otherwise("outer")
    return r.join(F.broadcast(q)).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.count_if("is_decoy").alias("n_decoys"))


def price_density(spark: SparkSession, sf: str) -> DataFrame:
    """Gaussian density of part sizes at 26 places, band width 2: each value reaches every place, so the values are
    counted first and meet the places as distinct values."""
    counts = table(spark, sf, "part").groupBy(F.col("p_size").cast("double").alias("v")).agg(F.count("*").alias("n"))
    at = spark.range(0, 26).select((F.col("id") * 2).cast("double").alias("at"))
    k = F.exp(-0.5 * ((F.col("at") - F.col("v")) / 2.0) ** 2) / (2.0 * math.sqrt(2 * math.pi))
    return rounded(counts.join(F.broadcast(at)).groupBy("at").agg((F.sum(k * F.col("n")) / F.sum("n")).alias("density")), "density")


def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Inverse class counts of the labels."""
    return table(spark, sf, "umap_dataset").where("label IS NOT NULL").groupBy("label").agg((1 / F.count("*")).alias("weight"))


def balanced_epoch(spark: SparkSession, sf: str) -> DataFrame:
    """As many draws with replacement as there are labelled rows, both labels alike."""
    u = table(spark, sf, "umap_dataset").where("label IS NOT NULL").select("mol_id", "label")
    return balanced_draw(u, "mol_id", "label", u.count(), 11)


def active_count(spark: SparkSession, sf: str) -> DataFrame:
    return medoids(spark, sf).agg(F.count_if(F.col("kind") == "active").alias("n_active"))


def dataset_mix(spark: SparkSession, sf: str) -> DataFrame:
    """All actives with as many decoys: 40 % of them by mass, the rest a hashed sample; short if the pool is."""
    m = medoids(spark, sf).select("id", "kind", "mass")
    k = m.where("kind = 'active'").count()
    analogs = m.where("kind = 'decoy'").orderBy(F.desc("mass"), "id").limit(round(0.4 * k))
    rest = m.where("kind = 'decoy'").join(analogs.select("id"), "id", "left_anti").orderBy(F.md5(F.concat_ws(":", F.lit("7"), F.col("id").cast("string"))), "id").limit(k - round(0.4 * k))
    tag = lambda d, t: d.select("id", F.lit(t).alias("part"))
    return tag(m.where("kind = 'active'"), "active").unionByName(tag(analogs, "analog")).unionByName(tag(rest, "background"))


QUERIES = {f.__name__: f for f in (members_to_medoid, nearest_centre, collapsed_clusters, scaled_prices, vendor_only_bits, shared_bits, cache_keys, json_bits, radial_bands, price_density, class_weights, balanced_epoch, active_count, dataset_mix)}

_W = f"WITH {MEDOIDS}"
_NY = max(1, int(NBINS / 3**0.5))
_CENTRES = f"""hp2 AS (SELECT DISTINCT CASE WHEN d1 < d2 THEN round_even(u, 0) ELSE floor(u) + 0.5 END * ((x1 - x0) / {NBINS}) + x0 AS cx, CASE WHEN d1 < d2 THEN round_even(v, 0) ELSE floor(v) + 0.5 END * ((y1 - y0) / {_NY}) + y0 AS cy FROM dd, box)"""
SQL = {
    "members_to_medoid": _COMP.format(m=MEDOIDS, g="cluster_id") + ", rep AS (SELECT g, arg_min(id, (comp, id)) AS medoid_id FROM comp GROUP BY g) SELECT f.id, rep.medoid_id, round(len(list_intersect(f.bits, r.bits)) / CAST(len(f.bits) + len(r.bits) - len(list_intersect(f.bits, r.bits)) AS DOUBLE), 6) AS sim FROM f JOIN rep ON rep.g = f.cluster_id JOIN f r ON r.id = rep.medoid_id",
    "nearest_centre": f"WITH {POINTS}, {hex_sql(NBINS)}, {_CENTRES} SELECT pts.id, round(sqrt(min(round(pow(pts.x - cx, 2) + pow(pts.y - cy, 2), 9))), 6) AS distance FROM pts, hp2 GROUP BY pts.id",
    "collapsed_clusters": f"{_W}, t AS (SELECT cluster_id AS c FROM m GROUP BY cluster_id ORDER BY count(*) DESC, cluster_id LIMIT 25) SELECT id, CASE WHEN c IS NOT NULL THEN cluster_id ELSE -1 END AS cluster_id, CASE WHEN c IS NOT NULL THEN 'cluster ' || CAST(cluster_id AS VARCHAR) ELSE 'other' END AS label FROM m LEFT JOIN t ON c = cluster_id",
    "scaled_prices": "WITH s AS (SELECT p_brand, avg(CAST(p_retailprice AS DOUBLE)) AS mean, stddev_pop(CAST(p_retailprice AS DOUBLE)) AS sd FROM part GROUP BY p_brand) SELECT p_partkey, round((p_retailprice - mean) / (CASE WHEN sd < 0.1 THEN 1.0 ELSE sd END + 1e-8), 6) AS z, p_retailprice IS NOT NULL AS known FROM part JOIN s USING (p_brand)",
    "vendor_only_bits": f"{_W}, b AS (SELECT kind, unnest(bits) AS bit FROM m) SELECT DISTINCT CAST(bit AS BIGINT) AS bit FROM b WHERE kind = 'vendor' AND bit NOT IN (SELECT bit FROM b WHERE kind = 'active')",
    "shared_bits": f"{_W}, b AS (SELECT kind, unnest(bits) AS bit FROM m) SELECT CAST(bit AS BIGINT) AS bit FROM (SELECT bit FROM b WHERE kind = 'active' INTERSECT SELECT bit FROM b WHERE kind = 'decoy')",
    "cache_keys": "SELECT mol_id, coalesce(regexp_replace(title, '\\r\\n|\\r|\\n', ' ', 'g'), '') || '||' || coalesce(regexp_replace(smiles, '\\r\\n|\\r|\\n', ' ', 'g'), '') AS cache_key FROM umap_dataset",
    "json_bits": f"{_W} SELECT id, '[' || coalesce(array_to_string(bits, ','), '') || ']' AS as_json, true AS same FROM m",
    "radial_bands": f"WITH {POINTS}, c AS (SELECT avg(x) AS mx, avg(y) AS my FROM pts), r AS (SELECT is_decoy, sqrt(pow(x - mx, 2) + pow(y - my, 2)) AS r FROM pts, c), q AS (SELECT quantile_cont(r, 1.0 / 3) AS a, quantile_cont(r, 2.0 / 3) AS b FROM r) SELECT CASE WHEN r <= a THEN 'inner' WHEN r <= b THEN 'middle' ELSE 'outer' END AS band, count(*) AS n, count(*) FILTER (WHERE is_decoy) AS n_decoys FROM r, q GROUP BY 1",
    "price_density": "SELECT CAST(a * 2 AS DOUBLE) AS at, round(avg(exp(-0.5 * pow((a * 2 - p_size) / 2.0, 2)) / (2.0 * sqrt(2 * pi()))), 6) AS density FROM part, range(26) t(a) GROUP BY 1",
    "class_weights": "SELECT label, 1 / CAST(count(*) AS DOUBLE) AS weight FROM umap_dataset WHERE label IS NOT NULL GROUP BY label",
    "balanced_epoch": "WITH u AS (SELECT mol_id, label, row_number() OVER (PARTITION BY label ORDER BY mol_id) AS r, count(*) OVER (PARTITION BY label) AS n, dense_rank() OVER (ORDER BY label) - 1 AS i FROM umap_dataset WHERE label IS NOT NULL), d AS (SELECT k AS draw, CAST('0x' || substr(md5('11a:' || k), 1, 8) AS BIGINT) AS a, CAST('0x' || substr(md5('11b:' || k), 1, 8) AS BIGINT) AS b FROM range((SELECT count(*) FROM u)) t(k)) SELECT draw, mol_id, label FROM d JOIN u ON a % (SELECT count(DISTINCT label) FROM u) = i AND b % n + 1 = r",
    "active_count": f"{_W} SELECT count(*) FILTER (WHERE kind = 'active') AS n_active FROM m",
    "dataset_mix": f"{_W}, k AS (SELECT count(*) AS k, CAST(round_even(0.4 * count(*), 0) AS BIGINT) AS a FROM m WHERE kind = 'active'), d AS (SELECT id, row_number() OVER (ORDER BY mass DESC, id) AS r FROM m WHERE kind = 'decoy'), rest AS (SELECT id, row_number() OVER (ORDER BY {_HASH(7, 'id')}, id) AS r FROM d, k WHERE r > a) SELECT id, 'active' AS part FROM m WHERE kind = 'active' UNION ALL SELECT id, 'analog' FROM d, k WHERE r <= a UNION ALL SELECT id, 'background' FROM rest, k WHERE r <= k - a",
}
