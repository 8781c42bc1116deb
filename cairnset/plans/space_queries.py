"""Hexagonal binning, capped filling and distribution queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnset.operators import hexbin, metrics
from cairnset.operators.running import quantiles, running_totals, spearman
from cairnset.plans.tables import POINTS, hex_sql, points, rounded, table
from cairnset.storage import materialize

NBINS = 20
CAPS = {"alpha": 0.5, "ref_quantile": 0.9, "min_log_mass": 0.5}
TARGET = 60
GRIDS = list(range(15, 101, 5))


def _binned(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return materialize(hexbin.with_hex(p, NBINS, hexbin.limits(p)))


def _capped(binned: DataFrame) -> DataFrame:
    return hexbin.with_caps(hexbin.hex_table(binned), 3.0, 4, **CAPS)


def hex_masses(spark: SparkSession, sf: str) -> DataFrame:
    return hexbin.hex_table(_binned(spark, sf))


def hex_caps(spark: SparkSession, sf: str) -> DataFrame:
    return _capped(_binned(spark, sf)).select("hex_id", "mass", "keep", "cap")


def hex_fill(spark: SparkSession, sf: str) -> DataFrame:
    b = _binned(spark, sf)
    return hexbin.greedy_fill(b, _capped(b), TARGET)


def hex_coverage(spark: SparkSession, sf: str) -> DataFrame:
    b = _binned(spark, sf)
    hexes = materialize(_capped(b))
    return rounded(hexbin.coverage(hexbin.greedy_fill(b, hexes, TARGET), hexes), "coverage")


def hex_first_feasible(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    nbins = hexbin.first_feasible(p, TARGET, 5, 40, 5, per_hex_cap=3.0, max_cap=4, **CAPS)
    return hexbin.with_hex(p, nbins, hexbin.limits(p)).agg(F.lit(nbins).cast("long").alias("nbins"), F.countDistinct("hex_id").alias("n_hexes"))


def hex_cap_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """All 210 pairs of caps up to 20, each at the smallest of 18 grids that holds the target."""
    return rounded(hexbin.cap_sweep(points(spark, sf), TARGET, GRIDS, list(range(1, 21)), **CAPS), "hex_coverage", "mass_coverage", "rho")


def hex_rank_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Spearman correlation of bin mass and decoys in the bin."""
    return rounded(spearman(hexbin.hex_table(_binned(spark, sf)), "mass", "n_decoys"), "rho")


def descriptor_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = metrics.summary(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return rounded(s, *[c for c in s.columns if c not in ("l_returnflag", "n")])


def descriptor_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.histogram(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", 0.0, 50.0, 20).withColumn("bin", F.col("bin").cast("long"))


def histogram_distance(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    ref = metrics.histogram(li, [], "l_quantity", 0.0, 50.0, 20)
    return rounded(metrics.l1_distance(metrics.histogram(li, ["l_returnflag"], "l_quantity", 0.0, 50.0, 20), ["l_returnflag"], ref), "l1")


def descriptor_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Common axis limits of two sets: quantiles of both together, floored and ceiled, not below 0."""
    both = table(spark, sf, "part").select(F.col("p_size").cast("double").alias("v")).unionByName(table(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("v")))
    q = quantiles(both, [], "v", {"a": 0.01, "b": 0.99})
    return q.select(F.greatest(F.floor("a"), F.lit(0)).cast("long").alias("low"), F.ceil("b").cast("long").alias("high"))


def empirical_cdf(spark: SparkSession, sf: str) -> DataFrame:
    """Share of events of a type up to each value; ties keep steps of their own, by id."""
    e = table(spark, sf, "events").select("event_id", "event_type", "value").where("value IS NOT NULL")
    run = running_totals(e, ["event_type"], [F.col("value"), F.col("event_id")], {"i": F.lit(1)})
    return rounded(run.select("event_id", "event_type", (F.col("i") / F.col("i_all")).alias("cdf")), "cdf")


def nearest_active_in_space(spark: SparkSession, sf: str) -> DataFrame:
    """Decoys by distance to the nearest active, first 30."""
    return hexbin.nearest_first(points(spark, sf), "is_decoy", "label = 0", 30).select("id", F.round(F.sqrt("d2"), 6).alias("distance"))


def unit_mass(spark: SparkSession, sf: str) -> DataFrame:
    """Masses as stored and as units, by library label."""
    return points(spark, sf).groupBy("label").agg(F.sum("mass").alias("mass"), F.sum(F.lit(1.0)).alias("unit_mass"))


def synthetic_actives(spark: SparkSession, sf: str) -> DataFrame:
    """Points with pseudo-actives at the median position, one for each two decoys, ten at most."""
    p = points(spark, sf)
    n = p.agg(F.least(F.floor(F.count_if("is_decoy") / 2), F.lit(10)).alias("n"))
    mid = quantiles(p, [], "x", {"mx": 0.5}).join(quantiles(p, [], "y", {"my": 0.5})).join(n).select(F.col("mx").alias("x"), F.col("my").alias("y"), "n")  # one row
    fake = mid.select(F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(1).cast("long"), F.col("n").cast("long")))).alias("k"), "x", "y").select((-F.col("k")).alias("id"), "x", "y", F.lit(0).alias("label"))
    every = p.select("id", "x", "y", "label").unionByName(fake)
    return rounded(every.groupBy("label").agg(F.count("*").alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y")), "mean_x", "mean_y")


QUERIES = {f.__name__: f for f in (hex_masses, hex_caps, hex_fill, hex_coverage, hex_first_feasible, hex_cap_sweep, hex_rank_correlation, descriptor_summary, descriptor_histogram, histogram_distance, descriptor_limits, empirical_cdf, nearest_active_in_space, unit_mass, synthetic_actives)}

_H = f"WITH {POINTS}, {hex_sql(NBINS)}"
_REF = "ref AS (SELECT greatest(coalesce(quantile_cont(mass, 0.9), 1.0), 1.0) AS ref FROM hexes WHERE mass > 0 AND log10(mass) >= 0.5)"
_CAPS = f"{_REF}, capped AS (SELECT hex_id, n, mass, n_decoys, mass > 0 AND log10(mass) >= 0.5 AS keep, CAST(CASE WHEN mass > 0 AND log10(mass) >= 0.5 THEN least(greatest(round_even(3.0 * pow(mass / ref, 0.5), 0), 1), 4) ELSE 0 END AS INTEGER) AS cap FROM hexes, ref)"
_FILL = f"f0 AS (SELECT hp.id, hp.hex_id, c.mass AS hex_mass, c.cap, row_number() OVER (PARTITION BY hp.hex_id ORDER BY hp.id) AS rn FROM hp JOIN capped c USING (hex_id) WHERE is_decoy AND cap > 0), fill AS (SELECT id, hex_id, hex_mass FROM f0 WHERE rn <= cap ORDER BY hex_mass DESC, id LIMIT {TARGET})"
_GRIDS = "gh AS (" + " UNION ALL ".join(f"(WITH {hex_sql(n)} SELECT {n} AS nbins, id, hex_id, mass, is_decoy FROM hp)" for n in GRIDS) + ")"
_PAIRS = "pr AS (SELECT CAST(a AS INTEGER) AS max_cap, CAST(b AS INTEGER) AS mid_cap FROM range(1, 21) t(a), range(1, 21) s(b) WHERE b <= a)"
_SWEEP = f"""kept AS (SELECT nbins, hex_id, sum(mass) AS mass, count(*) FILTER (WHERE is_decoy) AS n_decoys FROM gh GROUP BY ALL HAVING sum(mass) > 0 AND log10(sum(mass)) >= 0.5),
rf AS (SELECT nbins, greatest(quantile_cont(mass, 0.9), 1.0) AS ref FROM kept GROUP BY nbins),
cp AS (SELECT max_cap, mid_cap, nbins, hex_id, mass, n_decoys, CAST(least(greatest(round_even(mid_cap * pow(mass / ref, 0.5), 0), 1), max_cap) AS INTEGER) AS cap FROM kept JOIN rf USING (nbins), pr),
ch AS (SELECT max_cap, mid_cap, min(nbins) AS nbins FROM (SELECT max_cap, mid_cap, nbins FROM cp GROUP BY ALL HAVING sum(least(cap, n_decoys)) >= {TARGET}) GROUP BY ALL),
bn AS (SELECT cp.* FROM cp JOIN ch USING (max_cap, mid_cap, nbins)),
wi AS (SELECT max_cap, mid_cap, nbins, hex_id, bn.mass AS hex_mass, cap, id, gh.mass AS own FROM bn JOIN gh USING (nbins, hex_id) WHERE is_decoy),
fw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY max_cap, mid_cap, hex_id ORDER BY id) AS rn FROM wi) WHERE rn <= cap),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY max_cap, mid_cap ORDER BY hex_mass DESC, id) AS pick FROM fw) WHERE pick <= {TARGET}),
heaviest AS (SELECT max_cap, mid_cap, sum(own) AS most FROM (SELECT *, row_number() OVER (PARTITION BY max_cap, mid_cap ORDER BY own DESC, id) AS rn FROM wi) WHERE rn <= {TARGET} GROUP BY ALL),
hs AS (SELECT max_cap, mid_cap, bn.mass, (SELECT count(*) FROM pk WHERE pk.max_cap = bn.max_cap AND pk.mid_cap = bn.mid_cap AND pk.hex_id = bn.hex_id) AS n_sel FROM bn),
rk AS (SELECT *, rank() OVER (PARTITION BY max_cap, mid_cap ORDER BY mass) + (count(*) OVER (PARTITION BY max_cap, mid_cap, mass) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY max_cap, mid_cap ORDER BY n_sel) + (count(*) OVER (PARTITION BY max_cap, mid_cap, n_sel) - 1) / 2.0 AS rb FROM hs),
shares AS (SELECT max_cap, mid_cap, count(*) FILTER (WHERE n_sel > 0) / CAST(count(*) AS DOUBLE) AS hex_coverage, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END AS rho FROM rk GROUP BY ALL),
got AS (SELECT max_cap, mid_cap, any_value(nbins) AS nbins, count(*) AS n_selected, sum(own) AS sel FROM pk GROUP BY ALL)"""
_HQ = "least(CAST(floor((l_quantity - 0.0) / 50.0 * 20) AS INTEGER), 19)"
SQL = {
    "hex_masses": f"{_H} SELECT hex_id, n, mass, n_decoys FROM hexes",
    "hex_caps": f"{_H}, {_CAPS} SELECT hex_id, mass, keep, cap FROM capped",
    "hex_fill": f"{_H}, {_CAPS}, {_FILL} SELECT id, hex_id, hex_mass FROM fill",
    "hex_coverage": f"{_H}, {_CAPS}, {_FILL} SELECT (SELECT count(DISTINCT hex_id) FROM fill WHERE hex_id IN (SELECT hex_id FROM capped WHERE keep)) AS n_hit, count(*) FILTER (WHERE keep) AS n_kept, round((SELECT count(DISTINCT hex_id) FROM fill WHERE hex_id IN (SELECT hex_id FROM capped WHERE keep)) / CAST(count(*) FILTER (WHERE keep) AS DOUBLE), 6) AS coverage FROM capped",
    "hex_cap_sweep": f"WITH {POINTS}, {_GRIDS}, {_PAIRS}, {_SWEEP} SELECT max_cap, mid_cap, CAST(nbins AS INTEGER) AS chosen_nbins, n_selected, round(hex_coverage, 6) AS hex_coverage, round(sel / most, 6) AS mass_coverage, round(rho, 6) AS rho FROM got JOIN shares USING (max_cap, mid_cap) JOIN heaviest USING (max_cap, mid_cap)",
    "hex_first_feasible": "SELECT CAST(nbins AS BIGINT) AS nbins, n_hexes FROM (" + " UNION ALL ".join(f"(WITH {POINTS}, {hex_sql(n)}, {_CAPS} SELECT {n} AS nbins, count(*) AS n_hexes, sum(least(cap, n_decoys)) AS room FROM capped)" for n in range(5, 41, 5)) + f") WHERE room >= {TARGET} ORDER BY nbins LIMIT 1",
    "nearest_active_in_space": f"WITH {POINTS} SELECT d.id, round(sqrt(min(pow(d.x - a.x, 2) + pow(d.y - a.y, 2))), 6) AS distance FROM pts d, pts a WHERE d.is_decoy AND a.label = 0 GROUP BY d.id ORDER BY min(pow(d.x - a.x, 2) + pow(d.y - a.y, 2)), d.id LIMIT 30",
    "hex_rank_correlation": f"{_H}, r AS (SELECT rank() OVER (ORDER BY mass) + (count(*) OVER (PARTITION BY mass) - 1) / 2.0 AS a, rank() OVER (ORDER BY n_decoys) + (count(*) OVER (PARTITION BY n_decoys) - 1) / 2.0 AS b FROM hexes) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r",
    "descriptor_summary": "SELECT l_returnflag, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(quantile_cont(v, 0.05), 6) AS q05, round(quantile_cont(v, 0.25), 6) AS q25, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75, round(quantile_cont(v, 0.95), 6) AS q95, round(min(v), 6) AS low, round(max(v), 6) AS high FROM (SELECT l_returnflag, l_extendedprice AS v FROM lineitem WHERE l_extendedprice IS NOT NULL) GROUP BY l_returnflag",
    "descriptor_histogram": f"SELECT l_returnflag, CAST({_HQ} AS BIGINT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY ALL",
    "histogram_distance": f"WITH h AS (SELECT l_returnflag, {_HQ} AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY ALL), g AS (SELECT l_returnflag, sum(n) AS t FROM h GROUP BY ALL), r AS (SELECT bin, sum(n) / CAST((SELECT sum(n) FROM h) AS DOUBLE) AS r FROM h GROUP BY bin) SELECT g.l_returnflag, round(sum(abs(coalesce(h.n, 0) / CAST(g.t AS DOUBLE) - r.r)), 6) AS l1 FROM g CROSS JOIN r LEFT JOIN h ON h.l_returnflag = g.l_returnflag AND h.bin = r.bin GROUP BY g.l_returnflag",
    "descriptor_limits": "SELECT CAST(greatest(floor(quantile_cont(v, 0.01)), 0) AS BIGINT) AS low, CAST(ceil(quantile_cont(v, 0.99)) AS BIGINT) AS high FROM (SELECT CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT CAST(l_quantity AS DOUBLE) FROM lineitem)",
    "empirical_cdf": "SELECT event_id, event_type, round(row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) / CAST(count(*) OVER (PARTITION BY event_type) AS DOUBLE), 6) AS cdf FROM events WHERE value IS NOT NULL",
    "unit_mass": f"WITH {POINTS} SELECT label, sum(mass) AS mass, CAST(count(*) AS DOUBLE) AS unit_mass FROM pts GROUP BY label",
    "synthetic_actives": f"WITH {POINTS}, mid AS (SELECT median(x) AS x, median(y) AS y, least(count(*) FILTER (WHERE is_decoy) // 2, 10) AS n FROM pts), e AS (SELECT x, y, label FROM pts UNION ALL SELECT x, y, 0 FROM mid, range(10) t(k) WHERE k < n) SELECT label, count(*) AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y FROM e GROUP BY label",
}
