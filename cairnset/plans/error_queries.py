"""Queries of the error parse (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnset.operators import error_parse as ep


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/test_lines.parquet")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return ep.failed_lines(_lines(spark, sf)).select("line_id", "reason")


def p6_edits(spark: SparkSession, sf: str) -> DataFrame:
    return ep.failed_lines(_lines(spark, sf))


def p6_valid(spark: SparkSession, sf: str) -> DataFrame:
    return ep.valid_lines(_lines(spark, sf))


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    parsed = ep.parsed_lines(_lines(spark, sf)).select("file_name", "reason", "cost")
    return parsed.groupBy("file_name", F.coalesce("reason", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("n_lines"), F.sum("cost").alias("sum_cost"))


QUERIES = {"p6_found": p6_found, "p6_edits": p6_edits, "p6_valid": p6_valid, "p6_report": p6_report}
SQL: dict[str, str] = {}
