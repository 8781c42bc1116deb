"""Compound tables, splits, model quality, score tables and message passing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnset.operators import compounds, graph, metrics
from cairnset.operators.similarity import isim
from cairnset.plans.tables import MEDOIDS, PREDICTIONS, medoids, predictions, rounded, table


def normal_compounds(spark: SparkSession, sf: str) -> DataFrame:
    return compounds.normalised(table(spark, sf, "umap_dataset"), "mol_id")


def unreadable_structures(spark: SparkSession, sf: str) -> DataFrame:
    """By source, how many structures read and how many don't."""
    t = table(spark, sf, "umap_dataset")
    n = compounds.normalised(t, "mol_id").join(t.select(F.col("mol_id").alias("id"), "source"), "id")
    return n.withColumn("ok", compounds.reads(F.col("smiles"))).groupBy("source").agg(F.count_if("ok").alias("n_valid"), F.count_if(~F.col("ok")).alias("n_invalid"))


def first_structures(spark: SparkSession, sf: str) -> DataFrame:
    n = normal_compounds(spark, sf).where("smiles IS NOT NULL")
    return compounds.first_by(n, ["smiles"], "id").select("id", "smiles", "title")


def distinct_structures(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "umap_dataset")
    return t.groupBy("source").agg(F.countDistinct("smiles").alias("n_structures"), F.countDistinct("series_code").alias("n_series"))


def split_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = compounds.split_value(table(spark, sf, "umap_dataset")).where("split_ok IS NOT NULL")
    per = s.groupBy(F.col("split_ok").alias("split")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_active"), F.count_if(F.col("label") == 0).alias("n_decoy"))
    total = s.agg(F.count("*").alias("all"))
    return rounded(per.join(F.broadcast(total)).select("split", "n", "n_active", "n_decoy", (F.col("n") / F.col("all")).alias("share"), (F.col("n_active") / F.col("n")).alias("active_share")), "share", "active_share")


def split_values(spark: SparkSession, sf: str) -> DataFrame:
    return compounds.split_value(table(spark, sf, "umap_dataset")).groupBy(F.coalesce("split_ok", F.lit("none")).alias("split")).agg(F.count("*").alias("n"))


def source_tag(spark: SparkSession, sf: str) -> DataFrame:
    tag = F.when(F.col("label") == 1, "active").otherwise("decoy")
    return table(spark, sf, "umap_dataset").groupBy(tag.alias("tag")).agg(F.count("*").alias("n"))


def folds(spark: SparkSession, sf: str) -> DataFrame:
    return compounds.stratified_folds(predictions(spark, sf), "id", "y_true", 5, 122).select("id", "y_true", "fold")


def holdout(spark: SparkSession, sf: str) -> DataFrame:
    return compounds.stratified_holdout(predictions(spark, sf), "id", "y_true", 0.2, 42).select("id", "held_out")


def confusion_by_split(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.confusion(predictions(spark, sf), ["split"]), "precision", "recall", "f1", "accuracy")


def confusion_strict(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(predictions(spark, sf), ["split"], strict=True).select("split", "tp", "fp", "fn", "tn")


def ranking_by_split(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.ranking_quality(predictions(spark, sf), ["split"]), "auroc", "auprc")


def curve_points(spark: SparkSession, sf: str) -> DataFrame:
    p = metrics.curve_points(predictions(spark, sf), ["split"])
    return rounded(p.select("split", "y_prob", (F.col("fp") / F.col("n_neg")).alias("fpr"), (F.col("tp") / F.col("n_pos")).alias("tpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision")), "fpr", "tpr", "precision")


def prediction_table(spark: SparkSession, sf: str) -> DataFrame:
    return predictions(spark, sf).select("id", "y_true", "y_prob", (F.col("y_prob") >= 0.5).cast("int").alias("y_pred"))


def regression_errors(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.substring("p_brand", 1, 8).alias("g"), F.col("p_retailprice").cast("double").alias("y"), (900.0 + F.col("p_size") * 2.0).alias("p"))
    return rounded(metrics.regression_errors(p, ["g"], "y", "p"), "rmse", "mae", "rae")


def _epochs(spark: SparkSession, sf: str) -> DataFrame:
    """``fold, epoch, loss``: discounts stand for losses, line numbers for folds and quantities for epochs."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("fold"), F.col("l_quantity").cast("int").alias("epoch")).agg(F.avg("l_discount").alias("loss"))


def fold_curves(spark: SparkSession, sf: str) -> DataFrame:
    e = _epochs(spark, sf)
    return rounded(e.groupBy("epoch").agg(F.avg("loss").alias("mean"), F.stddev_samp("loss").alias("sd"), F.when(F.count("loss") > 1, F.stddev_samp("loss") / F.sqrt(F.count("loss"))).otherwise(0.0).alias("se")), "mean", "sd", "se")


def best_epoch(spark: SparkSession, sf: str) -> DataFrame:
    """First epoch of least mean loss, to 9 digits."""
    m = _epochs(spark, sf).groupBy("epoch").agg(F.round(F.avg("loss"), 9).alias("mean"))
    return rounded(m.orderBy("mean", "epoch").limit(1), "mean")


def last_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of each fold's last ten epochs."""
    w = Window.partitionBy("fold").orderBy(F.desc("epoch"))
    last = _epochs(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn <= 10")
    return rounded(last.groupBy("fold").agg(F.avg("loss").alias("mean"), F.count("*").alias("n")), "mean")


def depth_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The fold with the least gap between two halves' losses, then the larger second half."""
    e = _epochs(spark, sf).groupBy("fold").agg(F.round(F.avg(F.when(F.col("epoch") <= 25, F.col("loss"))), 9).alias("a"), F.round(F.avg(F.when(F.col("epoch") > 25, F.col("loss"))), 9).alias("b"))
    return rounded(e.orderBy(F.round(F.abs(F.col("a") - F.col("b")), 9), F.desc("b"), "fold").limit(1), "a", "b")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("max_cap"), F.col("l_returnflag").alias("mid_cap")).agg(F.avg("l_quantity").alias("cov"), F.avg("l_discount").alias("rho"), F.avg("l_tax").alias("scaffolds"))
    s = metrics.min_max(g, ["cov", "rho", "scaffolds"])
    return s.withColumn("score", 0.4 * F.col("cov_scaled") + 0.5 * F.col("rho_scaled") + 0.1 * F.col("scaffolds_scaled"))


def score_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_scored(spark, sf).select("max_cap", "mid_cap", "cov_scaled", "score"), "cov_scaled", "score")


def score_pivot(spark: SparkSession, sf: str) -> DataFrame:
    p = _scored(spark, sf).groupBy("max_cap").pivot("mid_cap", ["A", "N", "R"]).agg(F.max("score"))
    return rounded(p.select("max_cap", F.col("A").alias("score_a"), F.col("N").alias("score_n"), F.col("R").alias("score_r")), "score_a", "score_n", "score_r")


def score_top(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_scored(spark, sf).orderBy(F.desc("score"), "max_cap", "mid_cap").limit(5).select("max_cap", "mid_cap", "score"), "score")


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_discount") - 0.05).alias("w"))


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("h"), "p_brand")


def scatter(spark: SparkSession, sf: str) -> DataFrame:
    s = graph.scatter_extremes(_edges(spark, sf), _nodes(spark, sf))
    return s.select("node", *[F.round(c, 4).alias(c) for c in ("max_in", "max_out", "mean_in")])


def edge_attention(spark: SparkSession, sf: str) -> DataFrame:
    """Attention by source, summed."""
    return rounded(graph.edge_softmax(_edges(spark, sf)).groupBy("src").agg(F.sum("att").alias("att")), "att")


def degree_norms(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.degree_norm(_edges(spark, sf)).groupBy("dst").agg(F.sum("norm").alias("norm"), F.count("*").alias("n")), "norm")


def graph_pool(spark: SparkSession, sf: str) -> DataFrame:
    return graph.max_pool(_nodes(spark, sf), "p_brand")


def name_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Title of each compound to the largest id that bears it: the last duplicate wins, -1 without a title."""
    t = table(spark, sf, "umap_dataset")
    last = t.where("title IS NOT NULL").groupBy("title").agg(F.max("mol_id").alias("last_id"))
    return t.join(last, "title", "left").select("mol_id", F.coalesce("last_id", F.lit(-1)).alias("last_id"))


def isim_of_split(spark: SparkSession, sf: str) -> DataFrame:
    """n-ary similarity of active and decoy libraries' medoids."""
    return rounded(isim(medoids(spark, sf).where("kind <> 'vendor'"), ["kind"]), "isim")


QUERIES = {f.__name__: f for f in (normal_compounds, unreadable_structures, first_structures, distinct_structures, split_summary, split_values, source_tag, folds, holdout, confusion_by_split, confusion_strict, ranking_by_split, curve_points, prediction_table, regression_errors, fold_curves, best_epoch, last_epochs, depth_choice, score_table, score_pivot, score_top, scatter, edge_attention, degree_norms, graph_pool, name_lookup, isim_of_split)}

_INV = "[\\s\\p{Z}\\p{Cf}\\p{Cc}]"
_P = f"WITH {PREDICTIONS}"
_NS = f"CASE WHEN regexp_replace(smiles, '{_INV}', '', 'g') <> '' THEN regexp_replace(smiles, '{_INV}', '', 'g') END"
_NC = f"n AS (SELECT mol_id AS id, CASE WHEN trim(title) <> '' THEN trim(title) ELSE 'row_' || CAST(mol_id AS VARCHAR) END AS title, {_NS} AS smiles, label FROM umap_dataset)"
_SV = f"s AS (SELECT *, CASE WHEN lower(regexp_replace(split, '{_INV}', '', 'g')) IN ('train', 'val', 'test') THEN lower(regexp_replace(split, '{_INV}', '', 'g')) END AS ok FROM umap_dataset)"
_CM = "count(*) FILTER (WHERE {c} AND y_true = 1) AS tp, count(*) FILTER (WHERE {c} AND y_true <> 1) AS fp, count(*) FILTER (WHERE NOT {c} AND y_true = 1) AS fn, count(*) FILTER (WHERE NOT {c} AND y_true <> 1) AS tn"
_CURVE = "c0 AS (SELECT split, y_prob, count(*) FILTER (WHERE y_true = 1) AS op, count(*) AS o FROM pred GROUP BY ALL), c AS (SELECT *, sum(op) OVER w AS tp, sum(o - op) OVER w AS fp, sum(op) OVER (PARTITION BY split) AS np, sum(o - op) OVER (PARTITION BY split) AS nn FROM c0 WINDOW w AS (PARTITION BY split ORDER BY y_prob DESC))"
_EP = "e AS (SELECT CAST(l_linenumber AS INTEGER) AS fold, CAST(l_quantity AS INTEGER) AS epoch, avg(l_discount) AS loss FROM lineitem GROUP BY ALL)"
_MM = "CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0.0 END AS {c}_scaled"
_SC = "g AS (SELECT CAST(l_linenumber AS INTEGER) AS max_cap, l_returnflag AS mid_cap, avg(l_quantity) AS cov, avg(l_discount) AS rho, avg(l_tax) AS scaffolds FROM lineitem GROUP BY ALL), sc0 AS (SELECT *, " + ", ".join(_MM.format(c=c) for c in ("cov", "rho", "scaffolds")) + " FROM g), sc AS (SELECT *, 0.4 * cov_scaled + 0.5 * rho_scaled + 0.1 * scaffolds_scaled AS score FROM sc0)"
_ED = "ed AS (SELECT l_suppkey AS src, l_partkey AS dst, l_discount - 0.05 AS w FROM lineitem)"
SQL = {
    "normal_compounds": f"WITH {_NC} SELECT id, title, smiles, label FROM n",
    "first_structures": f"WITH {_NC} SELECT id, smiles, title FROM (SELECT *, row_number() OVER (PARTITION BY smiles ORDER BY id) AS rn FROM n WHERE smiles IS NOT NULL) WHERE rn = 1",
    "distinct_structures": "SELECT source, count(DISTINCT smiles) AS n_structures, count(DISTINCT series_code) AS n_series FROM umap_dataset GROUP BY source",
    "split_summary": f"WITH {_SV} SELECT ok AS split, count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_active, count(*) FILTER (WHERE label = 0) AS n_decoy, round(count(*) / CAST((SELECT count(*) FROM s WHERE ok IS NOT NULL) AS DOUBLE), 6) AS share, round(count(*) FILTER (WHERE label = 1) / CAST(count(*) AS DOUBLE), 6) AS active_share FROM s WHERE ok IS NOT NULL GROUP BY ok",
    "split_values": f"WITH {_SV} SELECT coalesce(ok, 'none') AS split, count(*) AS n FROM s GROUP BY 1",
    "source_tag": "SELECT CASE WHEN label = 1 THEN 'active' ELSE 'decoy' END AS tag, count(*) AS n FROM umap_dataset GROUP BY 1",
    "folds": f"{_P} SELECT id, y_true, CAST((row_number() OVER (PARTITION BY y_true ORDER BY md5('122:' || CAST(id AS VARCHAR)), id) - 1) % 5 AS INTEGER) AS fold FROM pred",
    "holdout": f"{_P} SELECT id, row_number() OVER (PARTITION BY y_true ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) <= ceil(count(*) OVER (PARTITION BY y_true) * CAST(0.2 AS DOUBLE)) AS held_out FROM pred",
    "confusion_by_split": f"{_P}, k AS (SELECT split, {_CM.format(c='y_prob >= 0.5')} FROM pred GROUP BY split) SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / CAST(tp + fp AS DOUBLE), 6) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / CAST(tp + fn AS DOUBLE), 6) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) ELSE 0.0 END AS f1, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy FROM k",
    "confusion_strict": f"{_P} SELECT split, {_CM.format(c='y_prob > 0.5')} FROM pred GROUP BY split",
    "ranking_by_split": f"{_P}, {_CURVE} SELECT split, CAST(any_value(np) AS BIGINT) AS n_pos, CAST(any_value(nn) AS BIGINT) AS n_neg, round(sum((o - op) * (tp - op / 2.0)) / (any_value(np) * any_value(nn)), 6) AS auroc, round(sum(op * tp / CAST(tp + fp AS DOUBLE)) / any_value(np), 6) AS auprc FROM c GROUP BY split",
    "curve_points": f"{_P}, {_CURVE} SELECT split, y_prob, round(fp / CAST(nn AS DOUBLE), 6) AS fpr, round(tp / CAST(np AS DOUBLE), 6) AS tpr, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision FROM c",
    "prediction_table": f"{_P} SELECT id, y_true, y_prob, CAST(y_prob >= 0.5 AS INTEGER) AS y_pred FROM pred",
    "regression_errors": "WITH p AS (SELECT substr(p_brand, 1, 8) AS g, CAST(p_retailprice AS DOUBLE) AS y, 900.0 + p_size * 2.0 AS p FROM part), m AS (SELECT g, avg(y) AS mean FROM p GROUP BY g) SELECT g, count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, CASE WHEN sum(abs(y - mean)) > 0 THEN round(sum(abs(y - p)) / sum(abs(y - mean)), 6) END AS rae FROM p JOIN m USING (g) GROUP BY g",
    "fold_curves": f"WITH {_EP} SELECT epoch, round(avg(loss), 6) AS mean, round(stddev_samp(loss), 6) AS sd, CASE WHEN count(*) > 1 THEN round(stddev_samp(loss) / sqrt(count(*)), 6) ELSE 0.0 END AS se FROM e GROUP BY epoch",
    "best_epoch": f"WITH {_EP}, m AS (SELECT epoch, round(avg(loss), 9) AS mean FROM e GROUP BY epoch) SELECT epoch, round(mean, 6) AS mean FROM m ORDER BY m.mean, epoch LIMIT 1",
    "last_epochs": f"WITH {_EP} SELECT fold, round(avg(loss), 6) AS mean, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY epoch DESC) AS rn FROM e) WHERE rn <= 10 GROUP BY fold",
    "depth_choice": f"WITH {_EP}, m AS (SELECT fold, round(avg(CASE WHEN epoch <= 25 THEN loss END), 9) AS a, round(avg(CASE WHEN epoch > 25 THEN loss END), 9) AS b FROM e GROUP BY fold) SELECT fold, round(a, 6) AS a, round(b, 6) AS b FROM m ORDER BY round(abs(m.a - m.b), 9), m.b DESC, fold LIMIT 1",
    "score_table": f"WITH {_SC} SELECT max_cap, mid_cap, round(cov_scaled, 6) AS cov_scaled, round(score, 6) AS score FROM sc",
    "score_pivot": f"WITH {_SC} SELECT max_cap, round(max(CASE WHEN mid_cap = 'A' THEN score END), 6) AS score_a, round(max(CASE WHEN mid_cap = 'N' THEN score END), 6) AS score_n, round(max(CASE WHEN mid_cap = 'R' THEN score END), 6) AS score_r FROM sc GROUP BY max_cap",
    "score_top": f"WITH {_SC} SELECT max_cap, mid_cap, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, max_cap, mid_cap LIMIT 5",
    "scatter": f"WITH {_ED}, n AS (SELECT p_partkey AS node, CAST(p_size AS DOUBLE) AS h FROM part), ms AS (SELECT src, dst, h * w AS msg FROM ed JOIN n ON n.node = ed.src), i AS (SELECT dst AS node, max(msg) AS mi, avg(msg) AS me FROM ms GROUP BY dst), o AS (SELECT src AS node, max(msg) AS mo FROM ms GROUP BY src) SELECT node, round(coalesce(mi, 0), 4) AS max_in, round(coalesce(mo, 0), 4) AS max_out, round(coalesce(me, 0), 4) AS mean_in FROM n LEFT JOIN i USING (node) LEFT JOIN o USING (node)",
    "edge_attention": f"WITH {_ED}, s AS (SELECT src, dst, CASE WHEN w > 0 THEN w ELSE 0.2 * w END AS sc FROM ed), t AS (SELECT dst, max(sc) AS top FROM s GROUP BY dst), x AS (SELECT src, s.dst, exp(sc - top) AS e FROM s JOIN t USING (dst)), z AS (SELECT dst, sum(e) AS z FROM x GROUP BY dst) SELECT src, round(sum(e / z), 6) AS att FROM x JOIN z USING (dst) GROUP BY src",
    "degree_norms": f"WITH {_ED}, d AS (SELECT dst AS node, count(*) AS deg FROM ed GROUP BY dst) SELECT ed.dst, round(sum(CASE WHEN a.deg IS NULL THEN 0.0 ELSE 1 / sqrt(a.deg) END / sqrt(b.deg)), 6) AS norm, count(*) AS n FROM ed LEFT JOIN d a ON a.node = ed.src JOIN d b ON b.node = ed.dst GROUP BY ed.dst",
    "graph_pool": "SELECT p_brand AS graph, CAST(max(p_size) AS DOUBLE) AS pooled FROM part GROUP BY p_brand",
    "name_lookup": "WITH l AS (SELECT title, max(mol_id) AS last_id FROM umap_dataset WHERE title IS NOT NULL GROUP BY title) SELECT mol_id, coalesce(last_id, -1) AS last_id FROM umap_dataset LEFT JOIN l USING (title)",
    "isim_of_split": f"WITH {MEDOIDS}, k AS (SELECT kind, bit, count(*) AS k FROM (SELECT kind, unnest(bits) AS bit FROM m WHERE kind <> 'vendor') GROUP BY ALL), n AS (SELECT kind, count(*) AS n FROM m WHERE kind <> 'vendor' GROUP BY kind) SELECT kind, n, round(sum(k * (k - 1) / 2.0) / sum(k * (k - 1) / 2.0 + k * (n - k)), 6) AS isim FROM k JOIN n USING (kind) GROUP BY kind, n",
}
