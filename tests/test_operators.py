import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnset.functions import fingerprints as fp
from cairnset.operators import compounds, graph, hexbin, metrics, running, selection, similarity
from cairnset.plans import space_queries
from cairnset.plans.tables import points


def sets(n, seed=1):
    r = random.Random(seed)
    return [(i, r.choice("abc"), sorted(r.sample(range(64), r.randint(0, 12)))) for i in range(n)]


def tani(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def test_nearest_by_group_equals_brute_force(spark):
    rows = sets(80)
    df = spark.createDataFrame(rows, "id long, grp string, bits array<int>")
    got = {(r["q_id"], r["grp"]): (r["best_id"], round(r["sim"], 9)) for r in similarity.nearest_by_group(df.where("id % 10 = 0"), df, exclude_self=True).collect()}
    want = {}
    for q, _, qb in rows[::10]:
        for g in "abc":
            sim, neg = max((tani(qb, b), -i) for i, gg, b in rows if gg == g and i != q)
            want[q, g] = (-neg, round(sim, 9))
    assert got == want


def test_isim_is_pair_sums(spark):
    rows = sets(40, 3)
    df = spark.createDataFrame(rows, "id long, grp string, bits array<int>")
    got = {r["grp"]: r["isim"] for r in similarity.isim(df, ["grp"]).collect()}
    for g in "abc":
        s = [set(b) for _, gg, b in rows if gg == g]
        pairs = [(a, b) for i, a in enumerate(s) for b in s[:i]]
        assert got[g] == pytest.approx(sum(len(a & b) for a, b in pairs) / sum(len(a | b) for a, b in pairs))


def test_isim_medoid_by_leaving_out(spark):
    rows = [r for r in sets(40, 5) if r[2]]
    df = spark.createDataFrame(rows, "id long, grp string, bits array<int>")
    comp = {(r["grp"], r["id"]): r["comp"] for r in similarity.complementary_isim(df, ["grp"]).collect()}
    for g, i, b in [(r[1], r[0], r[2]) for r in rows][:8]:
        s = [set(x) for j, gg, x in rows if gg == g and j != i]
        pairs = [(a, c) for k, a in enumerate(s) for c in s[:k]]
        assert comp[g, i] == pytest.approx(sum(len(a & c) for a, c in pairs) / sum(len(a | c) for a, c in pairs))


def test_words_round_trip_and_nulls(spark):
    df = spark.createDataFrame([(1, [5, 3, 3, 2047, None, -1, 4000]), (2, []), (3, None)], "id int, bits array<int>")
    clean = df.select("id", fp.clean_bits(F.col("bits")).alias("b"))
    out = {r["id"]: r for r in clean.select("id", "b", fp.unpack_words(fp.pack_words(F.col("b"))).alias("u"), fp.popcount(fp.pack_words(F.col("b"))).alias("n")).collect()}
    assert out[1]["b"] == out[1]["u"] == [3, 5, 2047] and out[1]["n"] == 3
    assert out[2]["u"] == [] and out[3]["b"] is None


def clustered(n, seed):
    r = random.Random(seed)
    return [(i, r.randint(0, 5), r.randint(0, 9)) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_round_robin_equals_loop(spark, seed):
    rows = clustered(40, seed)
    size = Counter(c for _, c, _ in rows)
    df = spark.createDataFrame([(i, c, m, size[c]) for i, c, m in rows], "id long, cluster_id long, mass long, n long")
    got = [(r["pick"], r["id"]) for r in selection.round_robin(df, [F.desc("n"), F.col("cluster_id")], [-F.col("mass"), F.col("id")], 25).collect()]
    queues = {c: sorted((-m, i) for i, cc, m in rows if cc == c) for c in size}
    order, want = sorted(size, key=lambda c: (-size[c], c)), []
    while len(want) < 25:
        for c in order:
            if queues[c] and len(want) < 25:
                want.append(queues[c].pop(0)[1])
    assert [i for _, i in sorted(got)] == want


@pytest.mark.parametrize("seed", range(3))
def test_largest_remainder_equals_loop(spark, seed):
    r = random.Random(seed)
    w = [r.random() for _ in range(12)]
    total = 20
    groups = [(i, total * x / sum(w), r.randint(3, 9)) for i, x in enumerate(w)]
    got = {x["cluster_id"]: x["allocated"] for x in selection.largest_remainder(spark.createDataFrame(groups, "cluster_id long, theory double, capacity long"), total).collect()}
    cap = {i: min(math.ceil(t), c) for i, t, c in groups}
    want = {i: min(math.floor(t), cap[i]) for i, t, c in groups}
    for i, t, _ in sorted(groups, key=lambda g: (-(g[1] - math.floor(g[1])), g[0])):
        if sum(want.values()) < total and want[i] < cap[i]:
            want[i] += 1
    assert got == want and sum(got.values()) <= total


def test_largest_remainder_refuses(spark):
    with pytest.raises(ValueError):
        selection.largest_remainder(spark.createDataFrame([(1, 5.0, 2)], "cluster_id long, theory double, capacity long"), 5)


def test_top_in_group_with_one_hot_group(spark):
    df = spark.range(2000).select("id", F.lit(1).alias("g"), (F.col("id") % 7).alias("m"))
    got = [r["id"] for r in selection.top_in_group(df, "g", [-F.col("m"), F.col("id")], F.lit(5)).orderBy("rn").collect()]
    assert got == [6, 13, 20, 27, 34]


def test_running_totals_equal_loop(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, "x", "y"]), r.randint(0, 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k string, v long")
    got = {x["id"]: (x["s"], x["s_all"]) for x in running.running_totals(df, ["k"], [F.col("v"), F.col("id")], {"s": F.col("v")}).collect()}
    by = defaultdict(list)
    for i, k, v in rows:
        by[k].append((v, i))
    for v in by.values():
        s, all_ = 0, sum(x for x, _ in v)
        for x, i in sorted(v):
            s += x
            assert got[i] == (s, all_)


def test_ranking_quality_by_pairs(spark):
    r = random.Random(4)
    rows = [(r.randint(0, 1), r.randint(0, 9) / 10) for _ in range(60)]
    q = metrics.ranking_quality(spark.createDataFrame(rows, "y_true int, y_prob double"), []).first()
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    assert q["auroc"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    ap, seen, tp = 0.0, 0, 0
    for s in sorted({p for _, p in rows}, reverse=True):
        own = [y for y, p in rows if p == s]
        seen, tp = seen + len(own), tp + sum(own)
        ap += sum(own) / len(pos) * tp / seen
    assert q["auprc"] == pytest.approx(ap)


def test_single_class_and_empty(spark):
    one = spark.createDataFrame([(1, 0.5), (1, 0.7), (None, 0.1)], "y_true int, y_prob double")
    assert metrics.ranking_quality(one, []).first()["auroc"] is None
    assert metrics.curve_points(one.limit(0), []).count() == 0
    assert metrics.min_max(spark.createDataFrame([(3.0,), (3.0,), (None,)], "x double"), ["x"]).where("x_scaled = 0").count() == 2


def test_spearman_with_ties(spark):
    rows = [(1.0, 2.0), (1.0, 3.0), (2.0, 3.0), (5.0, 9.0), (None, 1.0)]
    got = running.spearman(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    assert got["n"] == 4 and got["rho"] == pytest.approx(0.8333333, abs=1e-6)
    assert running.spearman(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double"), "x", "y").first()["rho"] is None


def test_greedy_fill_equals_loop(spark):
    r = random.Random(6)
    pts = [(i, r.randint(0, 4), r.random() < 0.7) for i in range(60)]
    hexes = [(h, float(r.randint(1, 20)), r.randint(0, 4)) for h in range(5)]
    p = spark.createDataFrame([(i, h, 1.0, d) for i, h, d in pts], "id long, hex_id long, mass double, is_decoy boolean")
    got = [x["id"] for x in hexbin.greedy_fill(p, spark.createDataFrame(hexes, "hex_id long, mass double, cap int"), 9).orderBy(F.desc("hex_mass"), "id").collect()]
    mass, cap, used, want = {h: m for h, m, _ in hexes}, {h: c for h, _, c in hexes}, Counter(), []
    for _, i, h in sorted((-mass[h], i, h) for i, h, d in pts if d):
        if used[h] < cap[h] and len(want) < 9:
            used[h] += 1
            want.append(i)
    assert got == want
    assert hexbin.greedy_fill(p, spark.createDataFrame(hexes, "hex_id long, mass double, cap int"), -1).count() == 0


def test_points_lie_nearest_to_their_hex(spark):
    r = random.Random(8)
    p = spark.createDataFrame([(i, r.random(), r.random()) for i in range(200)], "id long, x double, y double")
    out = hexbin.with_hex(p, 12, hexbin.limits(p)).collect()
    centres = {x["hex_id"]: (x["cx"], x["cy"]) for x in out}
    assert len({v: k for k, v in centres.items()}) == len(centres)


def test_graph_operators(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (3, 2, -1.0), (2, 1, 0.5), (9, 1, 1.0)], "src long, dst long, w double")
    n = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 1.0), (4, 0.0)], "node long, h double")
    got = {x["node"]: (x["max_in"], x["max_out"], x["mean_in"]) for x in graph.scatter_extremes(e, n).collect()}
    assert got == {1: (2.0, 2.0, 2.0), 2: (2.0, 2.0, 0.5), 3: (0.0, -1.0, 0.0), 4: (0.0, 0.0, 0.0)}
    att = graph.edge_softmax(e).groupBy("dst").agg(F.sum("att").alias("s")).collect()
    assert all(x["s"] == pytest.approx(1) for x in att)
    norm = {(x["src"], x["dst"]): x["norm"] for x in graph.degree_norm(e).collect()}
    assert norm[1, 2] == pytest.approx(0.5) and norm[3, 2] == 0


def test_compounds(spark):
    df = spark.createDataFrame([(1, " CC O", "", "1"), (2, None, None, "x"), (3, "CCO", "t", "0")], "k long, SMILES string, Title string, Actividad string")
    got = {r["id"]: r for r in compounds.normalised(df, "k").collect()}
    assert got[1]["smiles"] == "CCO" and got[1]["title"] == "row_1" and got[1]["label"] == 1
    assert got[2]["smiles"] is None and got[2]["label"] is None
    assert [r["id"] for r in compounds.first_by(compounds.normalised(df, "k").where("smiles IS NOT NULL"), ["smiles"], "id").collect()] == [1]
    with pytest.raises(ValueError):
        compounds.resolve_column(df, "split")
    with pytest.raises(ValueError):
        compounds.assert_splits(spark.createDataFrame([("train",), ("nowhere",)], "split string"))


def test_folds_partition_and_balance(spark):
    df = spark.range(103).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    out = compounds.stratified_folds(df, "id", "y", 5, 1).groupBy("y", "fold").agg(F.count("*").alias("n")).collect()
    for y in (0, 1):
        n = [r["n"] for r in out if r["y"] == y]
        assert len(n) == 5 and max(n) - min(n) <= 1


@pytest.mark.parametrize("n_far", [5, 300])
def test_nearest_first_equals_all_pairs(spark, n_far):
    r = np.random.default_rng(8)
    xy = np.concatenate([r.normal(0, 1, (300, 2)), r.normal(0, 1, (n_far, 2)) + (0 if n_far > 5 else 50)])
    df = spark.createDataFrame([(i, float(x), float(y), i < 300) for i, (x, y) in enumerate(xy)], "id long, x double, y double, is_decoy boolean")
    d2 = ((xy[:300, None] - xy[None, 300:]) ** 2).sum(2).min(1)
    got = [(x["id"], x["d2"]) for x in hexbin.nearest_first(df, "is_decoy", "NOT is_decoy", 30).collect()]
    want = np.argsort(d2, kind="stable")[:30]
    assert [i for i, _ in got] == want.tolist() and np.allclose([d for _, d in got], d2[want])


def test_nearest_active_query_equals_all_pairs(spark, sf_dir):
    rows = points(spark, sf_dir).collect()
    to = np.array([(r["x"], r["y"]) for r in rows if r["label"] == 0])
    want = sorted((float(np.sqrt(((to - (r["x"], r["y"])) ** 2).sum(1).min())), r["id"]) for r in rows if r["is_decoy"])[:30]
    got = {r["id"]: r["distance"] for r in space_queries.nearest_active_in_space(spark, sf_dir).collect()}
    assert set(got) == {i for _, i in want} and all(abs(got[i] - d) < 1e-6 for d, i in want)


def test_half_of_a_hot_group_is_ranked_in_ranges(spark):
    df = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("m"))
    out = selection.top_in_group(df, "g", [F.col("m"), F.col("id")], F.lit(1800)).collect()
    rows = sorted((r["m"], r["id"]) for r in df.where("g = 'hot'").collect())[:1800]
    assert [(r["m"], r["id"]) for r in sorted((r for r in out if r["g"] == "hot"), key=lambda r: r["rn"])] == rows
    assert sum(r["g"] == "cold" for r in out) == 400


def test_quantiles_are_those_of_numpy(spark):
    r = np.random.default_rng(1)
    rows = [("a" if i % 3 else "b", float(v)) for i, v in enumerate(np.round(r.normal(0, 3, 500), 1))] + [("a", None), (None, 2.0)]
    got = {x["k"]: x for x in running.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p": 0.05, "q": 0.5, "r": 0.99}).collect()}
    for k in ("a", "b", None):
        v = [b for a, b in rows if a == k and b is not None]
        assert np.allclose([got[k]["p"], got[k]["q"], got[k]["r"]], np.quantile(v, [0.05, 0.5, 0.99]))
    assert running.quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", {"p": 0.5}).count() == 0


def test_capacity_binds_in_the_allocation(spark):
    df = spark.createDataFrame([(1, 5.4, 2), (2, 2.6, 10), (3, 2.0, 0)], "cluster_id long, theory double, capacity long")
    with pytest.raises(ValueError):
        selection.largest_remainder(df, 10)
    assert {r["cluster_id"]: r["allocated"] for r in selection.largest_remainder(df, 10, strict=False).collect()} == {1: 2, 2: 3, 3: 0}


def test_balanced_draws(spark):
    df = spark.createDataFrame([(i, 1 if i < 30 else 0) for i in range(300)] + [(999, None)], "id long, label int")
    got = selection.balanced_draw(df, "id", "label", 2000, 3).collect()
    assert len(got) == 2000 and len({r["draw"] for r in got}) == 2000
    assert 900 < sum(r["label"] for r in got) < 1100 and len({r["id"] for r in got if r["label"]}) == 30
    assert selection.balanced_draw(df.limit(0), "id", "label", 5, 3).count() == 0
