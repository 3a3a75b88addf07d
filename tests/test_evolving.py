import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rewindle.sources import checkpoints, files
from rewindle.sources.evolving import EvolvingTable
from rewindle.streaming.upsert import append_stream, distinct_stream


def test_every_version_reads_with_its_own_columns(spark, folder, rows):
    table = EvolvingTable(folder, ("k",))
    make = lambda data, kind: spark.createDataFrame(data, kind)
    with pytest.raises(ValueError, match="no version"):
        table.read(spark)
    wanted = []
    for data, kind, renamed in (
        ([(1, "a", 1), (2, "b", 2), (3, None, 3)], "k int, s string, n int", {}),
        ([(1, "a", 1), (2, "c", 2), (4, "d", 4)], "k int, t string, n int", {"t": "s"}),
        ([(1, "a"), (2, "c"), (4, "d")], "k int, t string", {}),
        ([(1, "a", None), (2, "c", 9), (4, "d", None)], "k int, t string, n int", {}),
        ([(1, "a", Decimal("1.5")), (2, "c", None)], "K int, t string, n decimal(5,1)", {}),
        ([(1, "x", "a")], "k int, s string, t string", {}),
    ):
        df = make(data, kind)
        assert table.replace(spark, df, renamed) == len(wanted)
        wanted.append((df.columns, sorted(data, key=repr)))
    for version, (columns, data) in enumerate(wanted):
        read = table.read(spark, version)
        assert read.columns == columns and rows(read) == data
    assert rows(table.read(spark)) == wanted[-1][1]
    with pytest.raises(ValueError, match="lack the keys"):
        table.replace(spark, make([("x",)], "s string"))
    with pytest.raises(ValueError, match="changed its type"):
        table.replace(spark, make([("x",)], "k string"))


def test_a_dropped_column_writes_no_rows_and_a_rename_neither(spark, folder):
    table = EvolvingTable(folder, ("k",))
    df = spark.range(100).select(F.col("id").alias("k"), F.lit("v").alias("a"), F.lit(1).alias("b"))
    table.replace(spark, df)
    table.replace(spark, df.drop("b").withColumnRenamed("a", "c"), {"c": "a"})
    written = spark.read.parquet(f"{folder}/log").groupBy("_commit_version").count().collect()
    assert {r["_commit_version"]: r["count"] for r in written} == {0: 100}
    assert table.read(spark).columns == ["k", "c"] and table.read(spark).where("c = 'v'").count() == 100


def test_a_version_cut_off_before_its_columns_were_recorded_does_not_count(spark, folder, rows):
    table = EvolvingTable(folder, ("k",))
    table.replace(spark, spark.createDataFrame([(1, "a")], "k int, s string"))
    half = table._log(table._columns(spark, 0))
    half.append(spark.createDataFrame([(1, "half"), (9, "half")], "c0 int, c1 string"), 1, "replace", 1)
    assert table.head(spark) == 0 and rows(table.read(spark)) == [(1, "a")]
    table.replace(spark, spark.createDataFrame([(1, "b")], "k int, s string"))
    assert rows(table.read(spark)) == [(1, "b")] and rows(table.read(spark, 0)) == [(1, "a")]


def test_random_schemas(spark, folder, rows):
    rng, table, wanted = random.Random(4), EvolvingTable(folder, ("k",)), []
    for _ in range(5):
        names = rng.sample(["a", "b", "c", "d"], rng.randrange(1, 4))
        data = [(k, *[rng.choice([None, 0, 1]) for _ in names]) for k in rng.sample(range(6), 4)]
        table.replace(spark, spark.createDataFrame(data, ", ".join(["k int", *[f"{n} int" for n in names]])))
        wanted.append((["k", *names], sorted(data, key=repr)))
    for version, (columns, data) in enumerate(wanted):
        read = table.read(spark, version)
        assert read.columns == columns and rows(read) == data


def test_state_of_checkpoints(spark, folder, rows):
    spark.createDataFrame([(1,), (1,), (2,)], "x int").write.parquet(f"{folder}/in")
    source = spark.readStream.schema("x int").parquet(f"{folder}/in")
    append_stream(distinct_stream(source, ["x"]), f"{folder}/a", f"{folder}/cp/a").awaitTermination()
    append_stream(source, f"{folder}/b", f"{folder}/cp/b").awaitTermination()
    found = checkpoints.state_sizes(spark, [f"{folder}/cp/a", f"{folder}/cp/b", f"{folder}/cp/none"])
    assert rows(found, "operator_id", "operator", "keys") == [(0, "dedupe", 2)]


def test_what_the_catalog_says(spark, folder):
    spark.range(3).write.parquet(f"{folder}/t")
    try:
        spark.sql(f"CREATE TABLE said USING parquet LOCATION '{folder}/t' TBLPROPERTIES ('p.pipeline' = 'x')")
        spark.sql("CREATE VIEW seen AS SELECT * FROM said")
        got = {r.table_name: (r.table_type, r.properties.get("p.pipeline")) for r in files.catalog_tables(spark, ["said", "seen"]).collect()}
        assert got == {"said": ("EXTERNAL", "x"), "seen": ("VIEW", None)}
    finally:
        spark.sql("DROP VIEW IF EXISTS seen")
        spark.sql("DROP TABLE IF EXISTS said")
