from collections import Counter, defaultdict

import pytest

from cairnset.llm import format_duplicates as fd

SCHEMA = "row_id long, smiles string, title string, skey string, id int"  # clashing extra columns


def found(spark, rows):
    df = spark.createDataFrame([(i, s, t, "z", 0) for i, s, t in rows], SCHEMA)
    return {(r["first_id"], r["row_id"]) for r in fd.duplicate_members(df).collect()}, df


def test_formatting_does_not_count(spark):
    rows = [
        (10, "CC.Clc1ccccc1", "AB-12"),
        (3, ' "Clc1ccccc1.CC", ', "ab 12"),
        (7, "a_b/12", "CC.CLc1cc​ccc1"),  # fields exchanged
        (4, "CC.clc1ccccc1", "AB-12"),  # another character
        (5, "CC.Clc1ccccc1", "AB-13"),
        (6, None, "AB-12"),
        (8, "CC.Clc1ccccc1", " \t"),
        (9, "", ""),
        (11, "BrC", "x1"),
        (12, "|BRC|", "X-1"),
    ]
    got, _ = found(spark, rows)
    assert got == {(3, 7), (3, 10), (11, 12)}


@pytest.mark.parametrize("hot", [1, 300])
def test_one_group_over_many_partitions(spark, hot):
    rows = [(i, "CCO" if i % 3 < hot % 3 + 1 else f"C{'C' * (i % 17)}", "t1") for i in range(900)]
    got, df = found(spark, rows)
    groups = defaultdict(list)
    for i, s, _ in rows:
        groups[s].append(i)
    assert got == {(min(v), i) for v in groups.values() for i in v if i != min(v)}
    counts = {r["structure"]: r["n_copies"] for r in fd.collapse_duplicates(df).collect()}
    assert counts == Counter(s for _, s, _ in rows)


def test_empty_and_long(spark):
    assert found(spark, [])[0] == set()
    long = "C" * 50_000
    assert found(spark, [(1, long, "a"), (2, " " + long, "A")])[0] == {(1, 2)}
