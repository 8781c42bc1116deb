"""Queries of the training-data operators over the given tables, and SQL where a query has an equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnset.llm import cross_split, format_duplicates, mixture_clusters, packing, reading_level, related_splits, source_mixing, varied_subset


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return format_duplicates.duplicate_members(_table(spark, sf, "test"))


def p1_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return format_duplicates.collapse_duplicates(_table(spark, sf, "test"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = cross_split.split_overlaps(_table(spark, sf, "umap_dataset"))
    return pairs.select(F.least("train_id", "eval_id").alias("mol_id_a"), F.greatest("train_id", "eval_id").alias("mol_id_b"))


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    return cross_split.overlap_report(_table(spark, sf, "umap_dataset"))


def p3_subsets(spark: SparkSession, sf: str) -> DataFrame:
    medoids = _table(spark, sf, "npy_medoids")
    labels = mixture_clusters.cluster_labels(medoids).select("id", "label", "region")
    return varied_subset.choose_subsets(medoids, labels, _table(spark, sf, "library_info"), _table(spark, sf, "subset_targets"))


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    return varied_subset.subset_report(p3_subsets(spark, sf))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return related_splits.related_members(_table(spark, sf, "umap_dataset"))


def p4_splits(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "umap_dataset")
    return related_splits.assign_splits(rows, related_splits.related_groups(rows), _table(spark, sf, "split_targets"))


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return related_splits.split_report(p4_splits(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return mixture_clusters.cluster_members(_table(spark, sf, "npy_medoids"))


def p5_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return mixture_clusters.cluster_report(_table(spark, sf, "npy_medoids"))


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf, "documents"), _table(spark, sf, "pack_sizes"))


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_report(p7_packed(spark, sf))


def p8_mixed(spark: SparkSession, sf: str) -> DataFrame:
    return source_mixing.mix_sources(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets"))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return source_mixing.mix_report(p8_mixed(spark, sf), _table(spark, sf, "mix_targets"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    levels = reading_level.reading_levels(_table(spark, sf, "documents"), _table(spark, sf, "reading_labels"))
    return levels.where("level >= 4").select("doc_id")


def p9_levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading_level.reading_levels(_table(spark, sf, "documents"), _table(spark, sf, "reading_labels"))


def p9_profile(spark: SparkSession, sf: str) -> DataFrame:
    return reading_level.level_profile(_table(spark, sf, "documents"), _table(spark, sf, "reading_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_collapsed, p2_found, p2_report, p3_subsets, p3_report, p4_found, p4_splits, p4_report, p5_found, p5_clusters, p7_packed, p7_report, p8_mixed, p8_report, p9_found, p9_levels, p9_profile)}
_TEXT = r"regexp_replace(smiles, '[\s\p{Z}\p{Cf}\p{Cc}]', '', 'g')"
_SIGNS = "cCNOSFl1234()[]=#@H+-sno"  # an edit distance is at least what one text has of these signs beyond the other
_COUNTS = ", ".join(f"length(t) - length(replace(t, '{x}', '')) AS n{i}" for i, x in enumerate(_SIGNS))
_MOST = "CAST(floor(greatest(x.n, y.n) * 0.15 + 1e-9) AS BIGINT)"
_SIDED = rf"""u AS (SELECT mol_id, {_TEXT} AS t, lower(regexp_replace(split, '[\s\p{{Z}}\p{{Cf}}\p{{Cc}}]', '', 'g')) AS s FROM umap_dataset),
k AS (SELECT mol_id, t, s = 'train' AS train, length(t) AS n, {_COUNTS} FROM u WHERE s IN ('train', 'val', 'test') AND length(t) > 0)"""
_RELATED = rf"""c AS (SELECT mol_id AS id, lower(regexp_replace(series_code, '[^\p{{L}}\p{{N}}]', '', 'g')) AS series, list_sort(list_transform(string_split({_TEXT}, '.'), lambda p: {{'n': -length(p), 'p': p}}))[1].p AS part FROM umap_dataset),
e AS (SELECT id, 's' || series AS k FROM c WHERE series NOT IN ({", ".join(repr(x) for x in related_splits.PLACEHOLDERS)}) UNION SELECT id, 'c' || part FROM c WHERE length(part) > 0),
f AS (SELECT id, min(id) OVER (PARTITION BY k) AS first, count(*) OVER (PARTITION BY k) AS n FROM e),
l AS (SELECT DISTINCT id AS a, first AS b FROM f WHERE n > 1 UNION SELECT DISTINCT first, id FROM f WHERE n > 1)"""
#: Brute force on the same tables: all pairs for problems 2 and 5, and everything that is reached for problem 4.
SQL: dict[str, str] = {
    "p2_found": f"WITH {_SIDED} SELECT least(x.mol_id, y.mol_id) AS mol_id_a, greatest(x.mol_id, y.mol_id) AS mol_id_b FROM k x JOIN k y ON x.train AND NOT y.train AND abs(x.n - y.n) <= {_MOST}" + "".join(" AND " + " + ".join(f"greatest({a}.n{i} - {b}.n{i}, 0)" for i in range(len(_SIGNS))) + f" <= {_MOST}" for a, b in ("xy", "yx")) + f" WHERE levenshtein(x.t, y.t) <= {_MOST}",
    "p4_found": f"WITH RECURSIVE {_RELATED}, r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a) SELECT min(b) AS first_id, a AS mol_id FROM r GROUP BY a HAVING min(b) < a",
    "p5_found": "WITH f AS (SELECT medoid_id AS id, list_distinct(list_filter(bits, lambda b: b >= 0 AND b < 2048)) AS bits FROM npy_medoids), g AS (SELECT id, len(bits) AS n, unnest(bits) AS bit FROM f), m AS (SELECT x.id AS a, y.id AS b, count(*) AS shared, any_value(x.n) + any_value(y.n) AS n FROM g x JOIN g y USING (bit) GROUP BY x.id, y.id) SELECT min(b) AS first_id, a AS medoid_id FROM m WHERE shared >= 0.525 * (n - shared) GROUP BY a HAVING min(b) < a",
}
