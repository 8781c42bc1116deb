import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnset.llm import court_prose as cp
from cairnset.llm import packing, reading_level, source_mixing, tokens

RULING = """HIGH COURT OF X
Docket HRC 1-00/2001
Between: A, applicant
and B, respondent
Decided: 2001-02-03

HEADNOTE
Costs - The unconditional enforceability of the arbitration agreement.

1. The boy shut the door at night; see [1948] E.L.R. 289. The girl kept the key
HRC HRC 1-00/2001    2
near the mill (A v. B, 7 Harr. Rep. 700, 404).
(a) the man sold the car
2. Mr. A, through counsel: The wo-
man moved the box, because it was late.

Appeal dismissed.
Order: costs follow the event.
"""


def test_prose_of_a_ruling():
    want = ["the boy shut the door at night", "the girl kept the key near the mill", "the woman moved the box because it was late"]
    assert [" ".join(w) for w, _ in cp.sentences(RULING)] == want
    assert [" ".join(w) for w, _ in cp.sentences(RULING.replace("\n", "\r\n\r\n"))] == want
    assert cp.sentences("") == [] and cp.language("") == "" and cp.language(RULING) == "en"


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_uses_every_item_once(seed):
    r = np.random.default_rng(seed)
    capacity = 100
    lengths = np.sort(r.choice(np.arange(1, 101), 15, replace=False))
    counts = r.integers(0, 60, 15)
    used, containers = np.zeros(15, int), 0
    for use, times in packing.plan_containers(lengths, counts, capacity):
        assert sum(lengths[i] * k for i, k in use.items()) <= capacity and times > 0
        for i, k in use.items():
            used[i] += k * times
        containers += times
    assert (used == counts).all()
    # first fit decreasing as the yardstick
    bins = []
    for n in sorted(np.repeat(lengths, counts), reverse=True):
        at = next((j for j, b in enumerate(bins) if b + n <= capacity), None)
        if at is None:
            bins.append(n)
        else:
            bins[at] += n
    assert containers <= 1.08 * len(bins) + 2


def test_nnls_is_least_squares():
    r = np.random.default_rng(3)
    a = r.random((8, 5))
    x = np.array([3.0, 0, 7, 0, 2]) * 100
    assert np.allclose(packing.nnls(a, a @ x, np.ones(8), 5000), x, atol=2)


def test_packed_items(spark):
    r = random.Random(1)
    items = [(i, r.choice([3, 10, 40, 99, 100, 101, 250, 300]), "x") for i in range(400)] + [(900, None, "x"), (901, 0, "x")]
    df = spark.createDataFrame(items, "item_id long, n_tokens long, cls string")
    sizes = spark.createDataFrame([("s", 100), ("l", 1000), ("bad", 0), ("none", None)], "pack_name string, capacity_tokens int")
    out = packing.pack_items(df, sizes)
    assert out.groupBy("pack_name", "container_id", "capacity").agg(F.sum("n_tokens").alias("n")).where("n > capacity").count() == 0
    total = sum(n or 0 for _, n, _ in items)
    assert {r["pack_name"]: r["n"] for r in out.groupBy("pack_name").agg(F.sum("n_tokens").alias("n")).collect()} == {"s": total, "l": total}
    assert out.where("pack_name = 'l' AND piece > 0").count() == 0
    split = out.where("pack_name = 's'").groupBy("item_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).where("n > 1")
    assert split.where("t <= 100").count() == 0
    assert packing.pack_items(df.limit(0), sizes).count() == 0


def test_raking_meets_sources_and_caps():
    cells = [("a", "en", "t1", 100.0), ("a", "de", "t1", 50.0), ("b", "en", "t2", 10.0), ("b", "en", "t1", 10.0), ("c", "en", "t1", 500.0)]
    w, total = source_mixing.rake(cells, [("a", 0.5, np.inf), ("b", 0.4, 3.0), ("gone", 0.1, 2.0)])
    got = {s: sum(x * c[3] for x, c in zip(w, cells) if c[0] == s) for s in "abc"}
    assert total == pytest.approx(20 * 3 / (0.4 / 0.9))
    assert got["a"] / total == pytest.approx(0.5 / 0.9, rel=1e-3) and got["b"] / total == pytest.approx(0.4 / 0.9, rel=1e-3) and got["c"] == 0
    assert (w <= 3.0 + 1e-9)[2:4].all()
    assert source_mixing.rake(cells, [("gone", 1.0, 2.0)])[1] == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long, docket_no string, court_code string, version_no int, decided_on date, published_at timestamp, size int, level int"


def documents(spark, n, seed=1):
    r = random.Random(seed)
    easy, hard = "The boy shut the {} at night.", "The {} authority presupposes, notwithstanding the unambiguous terminology, that the cumulative prerequisites, whose significance derives from it, are met by the {}."
    rows = []
    for i in range(n):
        level = r.choice([1, 5])
        body = " ".join((easy if level == 1 else hard).replace("{}", r.choice(["door", "key", "mill", "court"])) for _ in range(12))
        text = f"COURT\nDocket HRC {i}-00/2001\nDecided: 2001-01-01\n\n1. {body}\n\nAppeal dismissed.\nOrder: none."
        rows.append((i, text, "en", r.choice(["a", "a", "a", "b", None]), 1, f"HRC {i}-00/2001", r.choice(["X", "Y", None]), 1, None, None, 0, level))
    rows += [(n, None, None, "a", None, None, None, None, None, None, 0, 0), (n + 1, " \n", None, "a", None, None, None, None, None, None, 0, 0), (n + 2, "[document withheld]", None, "b", None, None, None, None, None, None, 0, 0)]
    return spark.createDataFrame(rows, DOCS), rows


def test_mix_of_documents(spark):
    df, rows = documents(spark, 300)
    df = df.unionByName(df.where("doc_id < 50").withColumn("doc_id", F.col("doc_id") + 5000))  # the same texts again
    targets = spark.createDataFrame([("m", "a", 0.5, None), ("m", "b", 0.5, 3), ("gap", "zz", 1.0, 2)], "mix_name string, source string, target_share double, max_repeats int")
    out = source_mixing.mix_sources(df, targets)
    assert out.where("doc_id >= 5000").count() == 0 and out.where("source = 'b' AND copies > 3").count() == 0
    report = {(r["mix_name"], r["source"]): r["actual_share"] for r in source_mixing.mix_report(out, targets).collect()}
    assert report["m", "a"] == pytest.approx(0.5, abs=0.02) and report["gap", "zz"] is None
    assert source_mixing.mix_sources(df.limit(0), targets).count() == 0


def test_reading_levels(spark):
    df, rows = documents(spark, 120)
    labels = spark.createDataFrame([(r[0], "r1", r[11]) for r in rows[:60]] + [(0, "r2", None), (99999, "r1", 3)], "doc_id long, rater string, reading_level int")
    got = {r["doc_id"]: r["level"] for r in reading_level.reading_levels(df, labels).collect()}
    assert len(got) == len(rows)
    assert all((got[r[0]] >= 4) == (r[11] >= 4) for r in rows[:120])
    assert all(got[r[0]] is None for r in rows[120:])
    none = reading_level.reading_levels(df, labels.limit(0))
    assert none.where("level IS NOT NULL").count() == 0
    assert reading_level.level_profile(df.limit(0), labels).count() == 0


def test_versions_of_a_ruling_are_found_by_their_prose(spark):
    r, rows = random.Random(4), []
    words = ["door", "key", "mill", "court", "boat", "road", "field", "barn", "cart", "well", "fence", "horse"]
    easy, hard = "The boy shut the {} and the {} of the {} at night.", "The {} authority presupposes, notwithstanding the {}, that the cumulative prerequisites, whose significance derives from it, are met by the {}."

    def text(share):
        body = " ".join((hard if i < 24 * share else easy).format(*r.sample(words, 3)) for i in range(24))
        return f"COURT\nDocket X\nDecided: 2001-01-01\n\n1. {body}\n\nAppeal dismissed.\nOrder: none."

    day = datetime.date(2001, 1, 1)
    for i in range(80):
        rows.append((i, text(i % 2), f"HRC {i}-00/2001", day, "HRC", 1 + 4 * (i % 2)))
    # 40 unrelated rulings of one docket and date, with prose from easy to hard
    rows += [(100 + i, text(i / 39), "MC 1/2014", day, "MC", None) for i in range(40)]
    # versions far apart in score, the docket or the date missing in one; another court; another date
    whole = text(0.5)
    part = whole[: whole.index("The boy", whole.index("The boy") + 1)] + "\n\nAppeal dismissed.\nOrder: none."
    rows += [(200, whole, "LTB 9/2001", day, "LTB", None), (201, part, "ltb 9-2001", day, "LTB", None), (202, part, None, day, "LTB", None), (203, part, "LTB 9/2001", None, "LTB", None), (204, part, None, day, "DCE", None), (205, part, "LTB 9/2001", datetime.date(2002, 1, 1), "DCE", None)]
    df = spark.createDataFrame([x[:5] for x in rows], "doc_id long, text string, docket_no string, decided_on date, court_code string")
    labels = spark.createDataFrame([(x[0], "r", x[5]) for x in rows if x[5]], "doc_id long, rater string, reading_level int")
    model = reading_level.fit(df, labels)
    score = lambda d: {x["doc_id"]: x["score"] for x in reading_level.reading_levels(d, labels, model=model).collect()}
    got, alone = score(df), score(df.withColumn("docket_no", F.concat(F.lit("own "), "doc_id")))
    assert all(got[i] == pytest.approx(alone[i]) for i in [*range(80), *range(100, 140), 204, 205])
    own = [alone[i] for i in range(200, 204)]
    assert abs(alone[200] - alone[201]) > 0.1 and min(own) < got[200] < max(own) and all(got[i] == pytest.approx(got[200]) for i in range(200, 204))


def test_stops_of_abbreviations_do_not_end_a_citation():
    cut = cp.without_citations
    assert cut("He paid, see Varga v. Holt, 12 Harr. Rep. 44, 50. The girl kept it.") == "He paid. The girl kept it."
    assert cut("He paid, see [1948] Vell. S.C. 346. The girl kept it.") == "He paid. The girl kept it."
    assert cut("He paid, see A v. Mr. Holt. The girl kept it.") == "He paid. The girl kept it."


def test_shares_are_within_half_the_longest_text(spark):
    r = random.Random(9)
    words = ["stone", "river", "of", "the", "market", "law"]
    size = lambda: int(2 ** r.uniform(2, 9))
    rows = [(i, " ".join([str(i), *r.choices(words, k=size())]), r.choice("aaaaab"), r.choice(["X", "Y", None, str(i % 40)])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, court_code string")
    want = {"a": 0.55, "b": 0.45}
    targets = spark.createDataFrame([("m", s, share, 2) for s, share in want.items()], "mix_name string, source string, target_share double, max_repeats int")
    sized = source_mixing.sized_by_cell(df).collect()
    cells = {}
    for x in sized:
        key = (x["source"], x["lang"], x["topic"])
        cells[key] = cells.get(key, 0) + x["n_tokens"]
    _, total = source_mixing.rake([(*k, t) for k, t in sorted(cells.items())], [(s, share, 2.0) for s, share in want.items()])
    got = {x["source"]: x["n"] for x in source_mixing.mix_sources(df, targets, max_topics=5).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).collect()}
    for s, share in want.items():
        assert abs(got[s] - share * total) <= 0.51 * max(x["n_tokens"] for x in sized if x["source"] == s)


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "a" * 20_000)], "id int, text string")
    got = {r["id"]: r["n"] for r in df.select("id", tokens.token_count(F.col("text")).alias("n")).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] is None and got[4] > 1000
