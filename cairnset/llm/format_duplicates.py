"""Duplicates hidden by formatting differences (problem 1).

Method: canonical records are range-partitioned by their full key and id, sorted externally within each partition, and
scanned once; adjacent rows with equal full keys are one run. Because the id is part of the range key, a group of any
size is spread over as many partitions as it fills. Only the first and the last run of a partition can go on in a
neighbour; these, two a partition at most, are put together by their full keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnset.functions.smiles import with_orientation
from cairnset.functions.text import is_blank, letters_digits
from cairnset.storage import materialize

_SCAN = "kind string, id long, first_id long, n long, skey string, tkey string"


def canonical_records(df: DataFrame, id_col: str = "row_id", structure_col: str = "smiles", title_col: str = "title") -> DataFrame:
    """``id, skey, tkey`` of the records with a structure and a title; rows with either null or blank are left out."""
    a, b = F.col(structure_col), F.col(title_col)
    whole = df.select(F.col(id_col).cast("long").alias("id"), a.cast("string").alias("a"), b.cast("string").alias("b")).where(~is_blank(F.col("a")) & ~is_blank(F.col("b")))
    both = with_orientation(whole, "a", "b")
    swapped = F.col("swapped")
    return both.select("id", F.when(swapped, F.col("b_key")).otherwise(F.col("a_key")).alias("skey"), letters_digits(F.when(swapped, F.col("a")).otherwise(F.col("b"))).alias("tkey"))


def _scan_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over one sorted partition: a ``member`` for each row, a ``group`` for each run that can't go on elsewhere, and an
    ``edge`` for the first and the last run. Holds one open run (its key, first id and count), never its rows."""
    key, first, count, runs = None, 0, 0, 0

    def closed(kind: str) -> pd.DataFrame:
        return pd.DataFrame({"kind": [kind], "id": [first], "first_id": [first], "n": [count], "skey": [key[0]], "tkey": [key[1]]})

    for pdf in batches:
        if pdf.empty:
            continue
        s, t, ids = pdf["skey"].to_numpy(object), pdf["tkey"].to_numpy(object), pdf["id"].to_numpy()
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
        fresh[0] = key != (s[0], t[0])
        starts = np.flatnonzero(fresh)
        run = np.cumsum(fresh) - 1  # -1: the run open from before
        firsts = np.where(run < 0, first, ids[starts[np.maximum(run, 0)]] if len(starts) else first)
        yield pd.DataFrame({"kind": "member", "id": ids, "first_id": firsts, "n": 1, "skey": None, "tkey": None})
        if not len(starts):
            count += len(ids)
            continue
        if key is not None:
            count += starts[0]
            yield closed("edge" if runs == 1 else "group")
        ends = np.append(starts[1:], len(ids))
        inner, sizes = starts[:-1], ends - starts
        if len(inner):
            kinds = np.full(len(inner), "group", object)
            if runs == 0:
                kinds[0] = "edge"
            yield pd.DataFrame({"kind": kinds, "id": ids[inner], "first_id": ids[inner], "n": sizes[:-1], "skey": s[inner], "tkey": t[inner]})
        runs += len(starts)
        key, first, count = (s[starts[-1]], t[starts[-1]]), int(ids[starts[-1]]), int(sizes[-1])
    if key is not None:
        yield closed("edge")


def scanned_runs(records: DataFrame) -> DataFrame:
    """Members, closed runs and edge runs of ``id, skey, tkey``, written to the shared folder."""
    ordered = records.repartitionByRange("skey", "tkey", "id").sortWithinPartitions("skey", "tkey", "id")
    return materialize(ordered.mapInPandas(_scan_runs, _SCAN))


def _joined_edges(runs: DataFrame) -> DataFrame:
    """``local_id, first_id, n``: edge runs put together. At most two rows a partition go in."""
    edges = runs.where("kind = 'edge'")
    whole = edges.groupBy("skey", "tkey").agg(F.min("id").alias("first_id"), F.sum("n").alias("n"))
    return edges.select(F.col("id").alias("local_id"), "skey", "tkey").join(whole, ["skey", "tkey"]).select("local_id", "first_id", "n", "skey", "tkey")


def duplicate_members(df: DataFrame, id_col: str = "row_id", structure_col: str = "smiles", title_col: str = "title") -> DataFrame:
    """``first_id, row_id`` for each copy other than the first of its group.

    Null or blank structures or titles are in no group; an empty table gives no rows; other columns are ignored.
    """
    runs = scanned_runs(canonical_records(df, id_col, structure_col, title_col))
    edges = _joined_edges(runs).select("local_id", F.col("first_id").alias("whole_first"))
    members = runs.where("kind = 'member'").select("id", F.col("first_id").alias("local_id"))
    # two rows a partition: bounded by the number of partitions
    found = members.join(F.broadcast(edges), "local_id", "left").select(F.coalesce("whole_first", "local_id").alias("first_id"), F.col("id").alias("row_id"))
    return found.where("first_id <> row_id")


def collapse_duplicates(df: DataFrame, id_col: str = "row_id", structure_col: str = "smiles", title_col: str = "title") -> DataFrame:
    """One row for each distinct record: ``first_id, structure, title_key, n_copies`` (1: no copies)."""
    runs = scanned_runs(canonical_records(df, id_col, structure_col, title_col))
    inner = runs.where("kind = 'group'").select("first_id", "skey", "tkey", "n")
    outer = runs.where("kind = 'edge'").groupBy("skey", "tkey").agg(F.min("id").alias("first_id"), F.sum("n").alias("n"))
    return inner.unionByName(outer).select("first_id", F.col("skey").alias("structure"), F.col("tkey").alias("title_key"), F.col("n").alias("n_copies"))
