import pytest
from pyspark.sql import functions as F

from cairnset.operators import learned
from cairnset.sources import readers, writers
from cairnset.streaming import incremental


def test_csv_round_trip_and_glob(spark, tmp_path):
    df = spark.createDataFrame([("CCO", 1, 'a, "b"'), (None, 0, "c")], readers.COMPOUNDS)
    writers.write_csv(df, f"{tmp_path}/a", compress=True)
    assert {tuple(r) for r in readers.read_csv(spark, f"{tmp_path}/a", readers.COMPOUNDS).collect()} == {("CCO", 1, 'a, "b"'), (None, 0, "c")}
    writers.write_csv(df.select("Actividad"), f"{tmp_path}/b")
    both = readers.read_csv_glob(spark, [f"{tmp_path}/a/*.gz", f"{tmp_path}/b/*.csv"])
    assert both.count() == 4 and both.where("Title IS NULL").count() == 2


def test_smiles_lines(spark, tmp_path):
    (tmp_path / "x.smi").write_text("CCO name\n\n  c1ccccc1\t2\n")
    assert sorted(r["smiles"] for r in readers.read_smiles(spark, f"{tmp_path}/*.smi").collect()) == ["CCO", "c1ccccc1"]


def test_sdf_round_trip(spark, tmp_path):
    (tmp_path / "x.sdf").write_text("mol1\n  x\n\n  0  0\nM  END\n> <A>\n1\n\n> <B>\ntwo\nlines\n\n$$$$\nmol2\n\n\n  0  0\nM  END\n$$$$\n")
    df = readers.read_sdf(spark, f"{tmp_path}/x.sdf")
    got = {r["name"]: r["props"] for r in df.collect()}
    assert got == {"mol1": {"A": "1", "B": "two\nlines"}, "mol2": {}}
    writers.write_sdf(df, f"{tmp_path}/out")
    again = {r["name"]: r["props"] for r in readers.read_sdf(spark, f"{tmp_path}/out/*.txt").collect()}
    assert again == got


def test_splits_summary_order_and_catalog(spark, tmp_path):
    df = spark.createDataFrame([(1, " Train"), (2, "val"), (3, "train")], "id int, split string")
    writers.write_splits(df, f"{tmp_path}/s")
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == ["split=train", "split=val"]
    writers.write_summary(df.agg(F.count("*").alias("n"), F.max("id").alias("top")), f"{tmp_path}/t")
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("*.csv"))
    assert text == "n\t3\ntop\t3\n"
    writers.write_in_order(df, f"{tmp_path}/o", [F.desc("id")], ["id"])
    assert [r["id"] for r in spark.read.csv(f"{tmp_path}/o", header=True).collect()] == ["3", "2", "1"]
    writers.write_medoids(df.withColumn("library", F.lit("a")).unionByName(df.withColumn("library", F.lit("b"))), f"{tmp_path}/m")
    assert readers.read_medoids(spark, f"{tmp_path}/m", ("a",)).count() == 3


def test_cache(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert readers.cached_or(spark, f"{tmp_path}/c", compute).count() == 3
    assert len(calls) == 1
    rows, cache = spark.range(4).withColumnRenamed("id", "k"), spark.createDataFrame([(1, "old"), (9, "old")], "k long, v string")
    got = {r["k"]: r["v"] for r in readers.with_cache(rows, cache, ["k"], lambda d: d.withColumn("v", F.lit("new"))).collect()}
    assert got == {0: "new", 1: "old", 2: "new", 3: "new"}


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    args = ("ts", "value", ["event_type"], "1 day", "365 days", 0.0, 500.0, 10)
    q = incremental.start(incremental.windowed_histogram(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"), *args), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    batch = {tuple(r) for r in incremental.windowed_histogram(e, *args).collect()}
    stream = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert stream <= batch


def test_learners(spark):
    df = spark.range(60).select("id", F.array(*[(F.col("id") % 2 * 10 + F.rand(1)).alias("x") for _ in range(3)]).alias("v"), (F.col("id") % 2).cast("double").alias("y"), (F.col("id") % 2 + F.lit(0.0)).alias("f"))
    k = learned.kmeans(df, F.col("v"), 2)
    assert k.groupBy("cluster").agg(F.countDistinct("y").alias("n")).where("n > 1").count() == 0
    assert learned.project(df, F.col("v"), 2).where("x1 IS NULL").count() == 0
    assert learned.forest_scores(df, df, ["f"], "y", trees=5, depth=3).where("(y_prob > 0.5) <> (y = 1)").count() == 0


def test_reader_by_ending(spark, tmp_path):
    (tmp_path / "a.csv").write_text("SMILES,Title\nCCO,x\n")
    (tmp_path / "b.smi").write_text("CCO x\n\nCC y\n")
    (tmp_path / "c.sdf").write_text("m\n\n\nM  END\n> <K>\nv\n\n$$$$\n")
    assert readers.read_compounds(spark, f"{tmp_path}/a.csv").first()["SMILES"] == "CCO"
    assert readers.read_compounds(spark, f"{tmp_path}/b.smi").count() == 2
    assert readers.read_compounds(spark, f"{tmp_path}/c.sdf").first()["props"] == {"K": "v"}
    with pytest.raises(ValueError):
        readers.read_compounds(spark, f"{tmp_path}/d.xyz")
