"""Views of the given tables that several queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnset.functions.fingerprints import clean_bits
from cairnset.functions.text import letters_digits


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def medoids(spark: SparkSession, sf: str) -> DataFrame:
    """``id, library, kind, medoid_index, mass, bits, cluster_id``: medoids of the libraries that aren't excluded, as last
    written; unknown masses are 0; the smallest on-bit stands for a coarse cluster (-1: no bits)."""
    info = table(spark, sf, "library_info").where("NOT is_excluded").select(letters_digits(F.col("library")).alias("lib"), F.col("library").alias("library"), F.col("lib_kind").alias("kind"))
    rows = table(spark, sf, "npy_medoids").select(letters_digits(F.col("library")).alias("lib"), "medoid_index", "medoid_id", "written_at", "bits", "cluster_size")
    last = rows.groupBy("lib", "medoid_index").agg(F.max_by(F.struct("medoid_id", "bits", "cluster_size"), F.struct("written_at", "medoid_id")).alias("r"))
    bits = F.coalesce(clean_bits(F.col("r.bits")), F.array().cast("array<int>"))
    out = last.join(F.broadcast(info), "lib").select(F.col("r.medoid_id").alias("id"), "library", "kind", "medoid_index", F.greatest(F.coalesce("r.cluster_size", F.lit(0)), F.lit(0)).cast("long").alias("mass"), bits.alias("bits"))
    return out.withColumn("cluster_id", F.coalesce(F.array_min("bits"), F.lit(-1)).cast("long"))


MEDOIDS = """
info AS (SELECT lower(regexp_replace(library, '[^a-zA-Z0-9]', '', 'g')) AS lib, library, lib_kind AS kind FROM library_info WHERE NOT is_excluded),
ranked AS (SELECT lower(regexp_replace(library, '[^a-zA-Z0-9]', '', 'g')) AS lib, medoid_index, medoid_id, cluster_size, bits,
                  row_number() OVER (PARTITION BY lower(regexp_replace(library, '[^a-zA-Z0-9]', '', 'g')), medoid_index ORDER BY written_at DESC, medoid_id DESC) AS rn FROM npy_medoids),
m0 AS (SELECT r.medoid_id AS id, i.library, i.kind, r.medoid_index, CAST(greatest(coalesce(r.cluster_size, 0), 0) AS BIGINT) AS mass,
              list_sort(list_distinct(list_filter(coalesce(r.bits, []), lambda b: b >= 0 AND b < 2048))) AS bits FROM ranked r JOIN info i USING (lib) WHERE rn = 1),
m AS (SELECT *, CAST(coalesce(list_min(bits), -1) AS BIGINT) AS cluster_id FROM m0)
"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    """``id, x, y, label, mass, is_decoy``: embeddings by their first two components; labels 1 to 3 are decoys."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").cast("int").alias("label"), (1 + F.pmod("vec_id", F.lit(17))).cast("double").alias("mass"), F.col("label").between(1, 3).alias("is_decoy"))


POINTS = """
pts AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(label AS INTEGER) AS label, CAST(1 + vec_id % 17 AS DOUBLE) AS mass, label BETWEEN 1 AND 3 AS is_decoy FROM embeddings)
"""


def hex_sql(nbins: int) -> str:
    """``hp``: points with their bin, for ``nbins`` cells across."""
    ny = max(1, int(nbins / 3**0.5))
    return f"""
box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts),
uv AS (SELECT pts.*, (x - x0) / ((x1 - x0) / {nbins}) AS u, (y - y0) / ((y1 - y0) / {ny}) AS v FROM pts, box),
dd AS (SELECT *, pow(u - round_even(u, 0), 2) + 3 * pow(v - round_even(v, 0), 2) AS d1, pow(u - floor(u) - 0.5, 2) + 3 * pow(v - floor(v) - 0.5, 2) AS d2 FROM uv),
hp AS (SELECT id, x, y, label, mass, is_decoy, CAST(CASE WHEN d1 < d2 THEN round_even(u, 0) * {ny + 1} + round_even(v, 0) ELSE {(nbins + 1) * (ny + 1)} + floor(u) * {ny} + floor(v) END AS BIGINT) AS hex_id FROM dd),
hexes AS (SELECT hex_id, count(*) AS n, sum(mass) AS mass, count(*) FILTER (WHERE is_decoy) AS n_decoys FROM hp GROUP BY hex_id)
"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """``id, split, y_true, y_prob``: compounds of the three splits with a score from the composition of their text."""
    u = table(spark, sf, "umap_dataset").where("smiles IS NOT NULL AND label IS NOT NULL")
    split = F.lower(F.trim(F.regexp_replace("split", r"[\t\n\r]", " ")))
    count = lambda ch: F.length("smiles") - F.length(F.replace(F.col("smiles"), F.lit(ch), F.lit("")))
    score = F.pmod(F.length("smiles") * 7 + count("N") * 13 + count("S") * 29 + F.col("label") * 17, F.lit(101)).cast("double") / 100.0
    return u.select(F.col("mol_id").alias("id"), split.alias("split"), F.col("label").cast("int").alias("y_true"), score.alias("y_prob")).where("split IN ('train', 'val', 'test')")


PREDICTIONS = """
pred AS (SELECT * FROM (SELECT mol_id AS id, lower(trim(regexp_replace(split, '[\\t\\n\\r]', ' ', 'g'))) AS split, CAST(label AS INTEGER) AS y_true,
   CAST((length(smiles) * 7 + (length(smiles) - length(replace(smiles, 'N', ''))) * 13 + (length(smiles) - length(replace(smiles, 'S', ''))) * 29 + label * 17) % 101 AS DOUBLE) / 100.0 AS y_prob
   FROM umap_dataset WHERE smiles IS NOT NULL AND label IS NOT NULL) WHERE split IN ('train', 'val', 'test'))
"""


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})
