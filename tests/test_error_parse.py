import itertools

import pytest

from cairnset.functions.smiles import well_formed
from cairnset.operators import error_parse as ep

SCHEMA = "line_id long, file_name string, line_no int, raw_line string"


def reasons(spark, lines, schema=SCHEMA):
    rows = ep.parsed_lines(spark.createDataFrame(lines, schema)).collect()
    return {r["line_id"]: r["reason"] for r in rows}, {r["line_id"]: r for r in rows}


def test_reasons_and_typed_rows(spark):
    lines = [
        (1, "a", 1, "﻿SMILES,Actividad,Title\r"),
        (2, "a", 2, 'CCO,1,"x, ""y"""\r'),
        (3, "a", 3, 'CCO,1,"open'),
        (4, "a", 4, 'CCO,1,"x" y'),
        (5, "a", 5, 'CCO,1,a"b'),
        (6, "a", 6, "CCO,1"),
        (7, "a", 7, "CCO,2,x"),
        (8, "a", 8, "C(C,1,x"),
        (9, "a", 9, " CCO , 0 ,"),
        (10, "a", 10, None),
        (11, "b", 1, "SMILES,Title,Actividad,IC50"),
        (12, "b", 2, "CCO,t,1,1.5e-3"),
        (13, "b", 3, "CCO,t,1,"),
        (14, "b", 4, "CCO,t,1,.5"),
        (15, "c", 2, "CCO,1,x"),
        (16, "a", 11, 'CCO,"1","2,4-x"'),
    ]
    got, rows = reasons(spark, lines)
    assert got == {2: None, 3: "quoting", 4: "quoting", 5: "quoting", 6: "columns", 7: "value", 8: "value", 9: None, 10: "columns", 12: None, 13: None, 14: "value", 15: "columns", 16: None}
    assert rows[2]["title"] == 'x, "y"' and rows[2]["actividad"] == 1
    assert rows[12]["ic50"] == pytest.approx(0.0015) and rows[13]["ic50"] is None
    assert rows[9]["smiles"] == "CCO" and rows[9]["title"] == ""
    assert rows[16]["title"] == "2,4-x"
    assert (rows[6]["cost"], rows[6]["edits"][:2]) == (1, "+,")


def test_edits_are_least_by_brute_force():
    def ok(line, n):
        f = ep.read_fields(line)
        return f is not None and len(f) == n

    def edits(line):
        for i in range(len(line) + 1):
            for ch in '",':
                yield line[:i] + ch + line[i:]
        for i, ch in enumerate(line):
            if ch in '",':
                yield line[:i] + line[i + 1 :]

    for line in map("".join, itertools.product('a",', repeat=4)):
        for n in (1, 2, 3):
            layer, cost = {line}, 0
            while not any(ok(x, n) for x in layer):
                layer = {y for x in layer for y in edits(x)}
                cost += 1
            assert ep.least_edits(line, n)[0] == cost, (line, n)


def test_edits_of_quotes_alone_agree_with_the_automaton():
    for size in range(6):
        for line in map("".join, itertools.product('a",', repeat=size)):
            cost, edits = ep.least_edits(line, None, '"')
            assert (cost == 0) == (ep.read_fields(line) is not None), line
            assert "," not in edits and len(edits.split()) == cost


def test_long_lines_and_extra_columns(spark):
    long = "C" * 200_000
    lines = [(1, "a", 1, "SMILES,Actividad,Title", 5), (2, "a", 2, f"{long},1,x", 5), (3, "a", 3, "," * 5_000, 5), (4, "a", 4, '"' * 4_001, 5)]
    got, _ = reasons(spark, lines, SCHEMA + ", columns int")
    assert got == {2: None, 3: "columns", 4: "quoting"}


def test_empty_table(spark):
    assert ep.parsed_lines(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("good", ["CCO", "c1ccccc1", "[NH4+].[Cl-]", "F/C=C\\Cl", "C%12CC%12", "[2H]C", "C(=O)O", "N#N", "C=1CC=1", "[C@@H](O)C"])
def test_well_formed(good):
    assert well_formed(good)


@pytest.mark.parametrize("bad", ["", "C(", "C)", "=C", "C=", "C..C", ".C", "C.", "C1CC", "[NH", "Xx", "[Xx]", "C()C", "(C)C", "C==C", "C C", "E", "C(=)O", "nan"])
def test_not_well_formed(bad):
    assert not well_formed(bad)
