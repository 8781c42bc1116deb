"""Sources: CSV with a stated schema, globs of CSV files, SMILES and SD files, medoid catalogs, keyed caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPOUNDS = T.StructType([T.StructField("SMILES", T.StringType()), T.StructField("Actividad", T.IntegerType()), T.StructField("Title", T.StringType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV file or folder with a header; fields that don't fit the schema are null."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, quote='"', escape='"')


def read_csv_glob(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All CSV files of several globs in one table; columns that a file lacks are null, the file's name comes along."""
    parts = [spark.read.csv(p, header=True).withColumn("file_name", F.element_at(F.split(F.input_file_name(), "/"), -1)) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_smiles(spark: SparkSession, path: str) -> DataFrame:
    """``smiles, file_name`` from text files: the first word of each line that isn't blank."""
    lines = spark.read.text(path).select(F.trim(F.col("value")).alias("v"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"))
    return lines.where("v <> ''").select(F.split("v", r"\s+")[0].alias("smiles"), "file_name")


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """``name, molblock, props`` of each record of SD files: the properties as a map from name to text.

    Records are split by Spark at their end marks, so large files are read in parts; a record without ``M  END`` keeps
    all its text as the block.
    """
    records = spark.read.option("lineSep", "$$$$\n").text(path).where(r"value RLIKE '\\S'")
    text = F.regexp_replace("value", "\r\n", "\n")
    block = F.substring_index(text, "M  END", 1)
    rest = F.substring(text, F.length(block) + 1, F.length(text))
    pairs = F.regexp_extract_all(rest, F.lit(r"(?s)>[^\n]*?<([^>\n]+)>[^\n]*\n([^\n]*(?:\n(?!\n|>)[^\n]+)*)"), F.lit(0))
    name = lambda p: F.regexp_extract(p, r"<([^>\n]+)>", 1)
    value = lambda p: F.regexp_replace(p, r"^>[^\n]*\n", "")
    props = F.map_from_entries(F.transform(F.array_distinct(pairs), lambda p: F.struct(name(p), value(p))))
    return records.select(F.trim(F.substring_index(text, "\n", 1)).alias("name"), block.alias("molblock"), props.alias("props"))


def read_compounds(spark: SparkSession, path: str) -> DataFrame:
    """A compound file by its ending: CSV (also gzipped), SMILES or text lines, SD files, Parquet; others are an error."""
    name = path.lower().removesuffix(".gz")
    if name.endswith(".csv"):
        return read_csv_glob(spark, [path])
    if name.endswith((".smi", ".smiles", ".txt")):
        return read_smiles(spark, path)
    if name.endswith((".sdf", ".sd")):
        return read_sdf(spark, path)
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path}")


def read_medoids(spark: SparkSession, path: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """A catalog of medoids partitioned by ``library``; excluded libraries are pruned before anything is read."""
    return spark.read.parquet(path).where(~F.col("library").isin(*excluded)) if excluded else spark.read.parquet(path)


def cached_or(spark: SparkSession, path: str, compute: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The table at ``path`` if it is there, else ``compute()``, written there."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    if refresh or not there:
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def with_cache(rows: DataFrame, cache: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cached results for the rows that have one, computed ones for the rest. ``compute`` gives the cache's columns."""
    known = cache.join(rows.select(*keys).distinct(), keys, "left_semi")
    return known.unionByName(compute(rows.join(cache.select(*keys), keys, "left_anti")))
