"""Compound tables: column resolution, normal form, validity, first occurrences and splits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnset.functions.smiles import well_formed
from cairnset.functions.text import squeeze
from cairnset.operators.running import running_totals
from cairnset.operators.selection import hash_order

#: Accepted names of the columns of a compound table, in order of preference.
CANDIDATES = {"smiles": ("smiles", "SMILES", "Smiles", "canonical_smiles"), "title": ("title", "Title", "name", "Name", "id", "ID"), "label": ("label", "Label", "actividad", "Actividad", "activity"), "split": ("split", "Split", "set")}


def resolve_column(df: DataFrame, what: str, explicit: str | None = None, required: bool = True) -> str | None:
    """The explicit column, else the first candidate that the table has; raises or gives None where there is none."""
    if explicit is not None:
        if explicit not in df.columns:
            raise ValueError(f"no column {explicit!r} in {df.columns}")
        return explicit
    found = next((c for c in CANDIDATES[what] if c in df.columns), None)
    if found is None and required:
        raise ValueError(f"none of {CANDIDATES[what]} in {df.columns}")
    return found


def normalised(df: DataFrame, id_col: str, label: int | None = None) -> DataFrame:
    """``id, title, smiles, label``: text columns squeezed of blanks at their ends, a missing title replaced by
    ``row_<id>``, the label constant or coerced to a number (null if it is none)."""
    title, lab = resolve_column(df, "title", required=False), resolve_column(df, "label", required=False)
    t = F.trim(F.col(title).cast("string")) if title else F.lit(None).cast("string")
    value = F.lit(label) if label is not None else F.expr(f"try_cast(`{lab}` AS INT)") if lab else F.lit(None).cast("int")
    s = squeeze(F.col(resolve_column(df, "smiles")).cast("string"))
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.when(t != "", t), F.concat(F.lit("row_"), F.col(id_col).cast("string"))).alias("title"), F.when(s != "", s).alias("smiles"), value.cast("int").alias("label"))


@F.pandas_udf(T.BooleanType())
def reads(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether a structure is well-formed; null counts as not."""
    for s in batches:
        yield s.map(lambda x: x is not None and well_formed(x)).astype(bool)


def valid_structures(df: DataFrame, smiles_col: str = "smiles", strict: bool = False) -> DataFrame:
    """Rows whose structure reads; in ``strict`` mode the first one that doesn't raises when the rows are used."""
    checked = df.withColumn("_ok", reads(F.col(smiles_col)))
    if strict:
        checked = checked.withColumn("_ok", F.when(F.col("_ok"), True).otherwise(F.raise_error(F.concat(F.lit("structure does not read: "), F.coalesce(smiles_col, F.lit("null"))))))
    return checked.where("_ok").drop("_ok")


def first_by(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """The row of smallest id for each key: keep-first, as an aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(id_col)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def split_value(df: DataFrame, col: str = "split") -> DataFrame:
    """Adds ``split_ok`` (train, val or test, else null)."""
    s = F.lower(squeeze(F.col(col)))
    return df.withColumn("split_ok", F.when(s.isin("train", "val", "test"), s))


def assert_splits(df: DataFrame, col: str = "split") -> None:
    """Raises unless every row names a split and each split has rows."""
    n = {r["split_ok"]: r["n"] for r in split_value(df, col).groupBy("split_ok").agg(F.count("*").alias("n")).collect()}  # four rows at most
    if None in n or set(n) != {"train", "val", "test"}:
        raise ValueError(f"splits found: {n}")


def stratified_folds(df: DataFrame, id_col: str, label_col: str, k: int, seed: int) -> DataFrame:
    """Adds ``fold``: rows of each label dealt to ``k`` folds in hashed order."""
    run = running_totals(df, [label_col], [hash_order(id_col, seed), F.col(id_col)], {"_i": F.lit(1)})
    return run.withColumn("fold", F.pmod(F.col("_i") - 1, F.lit(k)).cast("int")).drop("_i", "_i_all")


def stratified_holdout(df: DataFrame, id_col: str, label_col: str, share: float, seed: int) -> DataFrame:
    """Adds ``held_out``: the first ``ceil(share * n)`` rows of each label in hashed order."""
    run = running_totals(df, [label_col], [hash_order(id_col, seed), F.col(id_col)], {"_i": F.lit(1)})
    return run.withColumn("held_out", F.col("_i") <= F.ceil(F.col("_i_all") * F.lit(share))).drop("_i", "_i_all")
