import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnset.llm import cross_split as cs
from cairnset.llm import related_splits as rs

SCHEMA = "mol_id long, smiles string, split string, source string, series_code string, label int, id string, tid long"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def compounds(n, seed):
    r = random.Random(seed)
    parts = ["CC(=O)N", "c1ccccc1", "C(F)(F)", "OCC", "N=C", "S(=O)(=O)", "[nH]", "CCCC", "C#C", "c1ccncc1"]
    out = []
    for i in range(n):
        if out and r.random() < 0.4:
            s = list(r.choice(out)[1])
            for _ in range(r.randint(0, 6)):
                s[r.randrange(len(s))] = r.choice("CNOS")
            s = "".join(s)
        else:
            s = "".join(r.choice(parts) for _ in range(9))
        out.append((i, s, r.choice(["train", " Train", "val", "TEST", "holdout", None]), "src", r.choice([None, "n/a", f"S-{r.randint(0, 40)}", f"s{r.randint(0, 40)}"]), r.randint(0, 1), "x", 0))
    return out


def test_overlaps_equal_brute_force(spark):
    rows = [*compounds(220, 1), (900, "", "val", None, None, 1, "x", 0), (901, None, "train", None, None, 1, "x", 0), (902, "C", "train", None, None, 1, "x", 0), (903, " C", "test", None, None, 0, "x", 0)]
    got = {(r["train_id"], r["eval_id"]) for r in cs.split_overlaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    side = {i: (sp or "").strip().lower() for i, _, sp, *_ in rows}
    clean = {i: (s or "").replace(" ", "") for i, s, *_ in rows}
    want = {(a, b) for a in clean for b in clean if side[a] == "train" and side[b] in ("val", "test") and clean[a] and clean[b] and distance(clean[a], clean[b]) <= 0.15 * max(len(clean[a]), len(clean[b]))}
    assert got - want == set()
    assert len(want - got) <= 0.02 * len(want) and len(want) > 20


def test_overlap_report_counts(spark):
    rows = [(1, "CCO", "train", "a", None, 1, "x", 0), (2, "CC O", "val", "b", None, 1, "x", 0), (3, "CCO", "val", "b", None, 1, "x", 0), (4, "c1ccccc1N", "test", None, None, 1, "x", 0)]
    got = {(r["split"], r["source"]): (r["n_records"], r["n_pairs"], r["n_exact_pairs"], r["n_records_hit"]) for r in cs.overlap_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("val", "b"): (2, 2, 2, 2), ("test", None): (1, 0, 0, 0)}


def test_overlaps_of_nothing(spark):
    assert cs.split_overlaps(spark.createDataFrame([], SCHEMA)).count() == 0


def groups_of(rows):
    up = {r[0]: r[0] for r in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    seen = {}
    for i, s, _, _, code, *_ in rows:
        series = "".join(c for c in (code or "").lower() if c.isalnum())
        part = min((s or "").replace(" ", "").split("."), key=lambda p: (-len(p), p))
        for k in ([("s", series)] if series not in ("", "na") else []) + ([("c", part)] if part else []):
            if k in seen:
                a, b = sorted((find(seen[k]), find(i)))
                up[b] = a
            seen.setdefault(k, i)
    return {i: find(i) for i in up}


@pytest.mark.parametrize("seed", [2, 3])
def test_related_members_equal_union_find(spark, seed):
    rows = compounds(150, seed)
    got = {(r["first_id"], r["mol_id"]) for r in rs.related_members(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(g, i) for i, g in groups_of(rows).items() if g != i}


def test_long_chain_and_placeholders(spark):
    chain = [(i, f"C{'C' * (i // 2)}", None, None, f"s{(i + 1) // 2}", 1, "x", 0) for i in range(200)]
    alone = [(500 + i, None, None, None, c, 1, "x", 0) for i, c in enumerate([None, "", "?", "-", "N/A", "unknown", "none", " n.a. "])]
    got = {(r["first_id"], r["mol_id"]) for r in rs.related_members(spark.createDataFrame(chain + alone, SCHEMA)).collect()}
    assert got == {(0, i) for i in range(1, 200)}
    assert rs.related_members(spark.createDataFrame([], SCHEMA)).count() == 0


def test_splits_keep_groups_and_shares(spark):
    rows = compounds(600, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    targets = spark.createDataFrame([("w", "train", 0.7), ("w", "val", 0.15), ("w", "test", 0.15), ("n", "train", 0.8), ("n", "val", 0.0), ("n", "test", 0.2)], "scheme string, split string, target_share double")
    out = rs.assign_splits(df, rs.related_groups(df), targets)
    assert out.groupBy("scheme", "mol_id").agg(F.count("*").alias("n")).where("n <> 1").count() == 0
    assert out.groupBy("scheme", "group_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    share = {(r["scheme"], r["split"]): r["row_share"] for r in rs.split_report(out).collect()}
    assert ("n", "val") not in share
    assert share["w", "train"] == pytest.approx(0.7, abs=0.05) and share["n", "test"] == pytest.approx(0.2, abs=0.05)


def test_splits_of_nothing_and_null_labels(spark):
    targets = spark.createDataFrame([("w", "train", 1.0), ("w", "test", None)], "scheme string, split string, target_share double")
    empty = spark.createDataFrame([], SCHEMA)
    assert rs.assign_splits(empty, rs.related_groups(empty), targets).count() == 0
    rows = [(i, f"C{'C' * i}", None, None, None, None, "x", 0) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = rs.assign_splits(df, rs.related_groups(df), targets).collect()
    assert len(out) == 20 and {r["split"] for r in out} == {"train"}


def test_pairs_at_the_limit_of_edits_are_found(spark):
    r, rows = random.Random(3), []
    for i in range(600):
        text = [r.choice("CCCcccNOSF()=1234") for _ in range(40)]
        edited = list(text)
        for at in r.sample(range(40), 6):
            edited[at] = r.choice("BPIK")
        rows += [(2 * i, "".join(text), "train"), (2 * i + 1, "".join(edited), "val")]
    df = spark.createDataFrame(rows, "mol_id long, smiles string, split string")
    assert cs.split_overlaps(df).count() >= 590


def test_hot_block_keys_are_dealt_to_pieces_without_loss(spark):
    r = random.Random(4)
    core = [r.choice("CCCcccNOSF()=1234") for _ in range(60)]
    rows = []
    for i in range(200):  # a third of the rows are one family of like texts, which share their block keys
        text = list(core)
        for at in r.sample(range(60), 2):
            text[at] = r.choice("BPIK")
        rows.append((i, "".join(text), "train" if i % 4 else "test"))
    family = len(rows)
    rows += [(family + i, "".join(r.choice("CCCcccNOSF()=1234") for _ in range(60)), "train" if i % 4 else "test") for i in range(400)]
    df = spark.createDataFrame(rows, "mol_id long, smiles string, split string")
    plan = cs.Plan(hot_rows=20, hot_share=0.05)
    coded = cs.similarity_codes(df.select("mol_id", F.col("smiles").alias("text"), F.lit(True).alias("on_train")), *plan.blocks(600), plan)
    assert cs._hot_keys(coded, 20).count() > 0
    whole = {(x["train_id"], x["eval_id"]) for x in cs.split_overlaps(df, plan=plan).collect()}
    assert len(whole) >= 0.85 * sum(1 for _, _, a in rows[:family] for _, _, b in rows[:family] if a == "train" and b == "test")
    assert whole == {(x["train_id"], x["eval_id"]) for x in cs.split_overlaps(df).collect()}  # pieces change nothing


def test_report_counts_classes_as_pairs(spark):
    rows = [(1, "CCCCCCCCCC", "train", "a"), (2, "CCCCCCCCCC", "train", "a"), (3, "CCCCCCCCCC", "val", "b"), (4, "CCCCCCCCC N", "val", "b"), (5, "CCCCCCCCCC", "test", None), (6, "OOOOOOOOOO", "test", None)]
    df = spark.createDataFrame(rows, "mol_id long, smiles string, split string, source string")
    got = {(r["split"], r["source"]): tuple(r)[2:] for r in cs.overlap_report(df).collect()}
    assert got == {("val", "b"): (2, 4, 2, 2), ("test", None): (2, 2, 2, 1)}


def test_sketches_never_tell_texts_further_apart_than_edits_do():
    r = random.Random(8)
    texts = np.array(["".join(r.choice("CCCcccNOSF()=1234\U0001f600") for _ in range(r.randint(1, 70))) for _ in range(300)], object)
    edited, edits = [], []
    for text in texts:
        new, k = list(text), r.randint(0, 9)
        for _ in range(k):
            at = r.randrange(len(new) + 1)
            new[at : at + r.randint(0, 1)] = r.choice(["", "C", "N", "("])
        edited.append("".join(new) or "C")
        edits.append(k + 1)
    for q in cs.SKETCH:
        steps = cs._steps(texts, q)
        a, b = (cs._sketch(t, q, steps).view(np.uint64) for t in (texts, np.array(edited, object)))
        beyond, missed = (np.bitwise_count(x & ~y).sum(1) for x, y in ((a, b), (b, a)))
        assert (np.maximum(beyond, missed) <= q * np.array(edits)).all() and beyond.sum() > 0
        assert not cs._sketch(texts, q, []).any()


def test_rounds_change_nothing_and_leave_only_pairs(spark):
    df = spark.createDataFrame(compounds(220, 1), SCHEMA)
    texts = df.select(F.col("mol_id").alias("tid"), F.regexp_replace("smiles", " ", "").alias("text"), (F.col("split") == "train").alias("on_train"), (F.col("split") == "val").alias("on_eval"))
    texts = texts.groupBy("text").agg(F.min("tid").alias("tid"), F.coalesce(F.max("on_train"), F.lit(False)).alias("on_train"), F.coalesce(F.max("on_eval"), F.lit(False)).alias("on_eval"))
    got = {tuple(r) for r in cs.near_text_pairs(texts, plan=cs.Plan(round_rows=1)).collect()}  # four blocks a round
    assert got == {tuple(r) for r in cs.near_text_pairs(texts, plan=cs.Plan(round_rows=10**9)).collect()} and len(got) > 10
