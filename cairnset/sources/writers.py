"""Sinks: CSV (also compressed), one folder for each split, key-value summaries, ordered picks, SD files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, compress: bool = False) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"', compression="gzip" if compress else "none")


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """One folder for each split, its name in lower case without blanks."""
    df.withColumn(split_col, F.lower(F.trim(split_col))).write.mode("overwrite").partitionBy(split_col).csv(path, header=True, escape='"')


def write_summary(one_row: DataFrame, path: str) -> None:
    """A one-row table as tab-separated lines of metric and value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in one_row.columns])
    one_row.select(F.inline(pairs)).coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=False)


def write_in_order(df: DataFrame, path: str, order: list[Column], cols: list[str]) -> None:
    """Picks in their order; part files follow one another by name."""
    df.orderBy(*order).select(*cols).write.mode("overwrite").csv(path, header=True, escape='"')


def write_medoids(df: DataFrame, path: str) -> None:
    """A medoid catalog partitioned by library."""
    df.write.mode("overwrite").partitionBy("library").parquet(path)


def write_sdf(df: DataFrame, path: str) -> None:
    """Records of ``name, molblock, props`` as SD text."""
    fields = F.array_join(F.transform(F.map_entries("props"), lambda e: F.concat(F.lit("> <"), e["key"], F.lit(">\n"), F.coalesce(e["value"], F.lit("")), F.lit("\n\n"))), "")
    record = F.concat(F.regexp_replace("molblock", r"\n?$", "\n"), F.lit("M  END\n"), fields, F.lit("$$$$"))
    df.select(record.alias("value")).write.mode("overwrite").text(path)
