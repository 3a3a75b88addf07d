import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewindle.operators.versions import TYPE, as_of, drop_system
from rewindle.sources.changelog import ChangeLog
from rewindle.streaming.upsert import append_stream, distinct_stream
from rewindle.streaming.view import GroupedView

ROW = T.StructType().add("k", "integer").add("g", "string").add("n", "integer").add("d", T.DecimalType(10, 2))


def version(rng, alive):
    """Changes of one version: rows come, change their group or sums, and go."""
    rows = []
    for k in rng.sample(range(30), 12):
        kind = rng.choice(["delete", "update_postimage"]) if k in alive else "insert"
        (alive.discard if kind == "delete" else alive.add)(k)
        number = rng.choice([None, 0, 5, -7])
        rows.append((k, rng.choice([None, "a", "b"]), number, None if number is None else Decimal(number) / 4, kind))
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_a_refreshed_view_equals_a_full_count(spark, folder, rows, seed):
    rng, alive = random.Random(seed), set()
    log = ChangeLog(f"{folder}/log", ROW).create(spark)
    view = GroupedView(log, ("k",), ("g",), ("n", "d"), f"{folder}/view").create(spark)
    assert view.refresh(spark) == -1 and rows(view.read(spark)) == []
    for v in range(4):
        log.append(spark.createDataFrame(version(rng, alive), T.StructType([*ROW.fields, T.StructField(TYPE, T.StringType())])), v)
        if v == 2 and seed:
            continue  # two versions in one refresh
        assert view.refresh(spark) == v
        full = as_of(log.read(spark), ["k"]).groupBy("g").agg(F.count("*").alias("rows"), F.sum("n").cast("decimal(38,0)"), F.sum("d").cast("decimal(38,2)"))
        assert rows(view.read(spark)) == rows(full)
    head = view.log(spark).head(spark)
    assert view.refresh(spark) == 3 and view.log(spark).head(spark) == head
    # Only groups that a refresh touches are written.
    log.append(spark.createDataFrame([(100, "new", 1, None)], ROW), 4)
    view.refresh(spark)
    assert rows(view.log(spark).read(spark, head + 1), "g", "_change_type") == [("new", "insert")]


def test_a_view_of_derived_rows(spark, folder, rows):
    log = ChangeLog(f"{folder}/log", ROW).create(spark)
    derive = lambda df: drop_system(df).where("n > 0").select((F.col("n") % 2).alias("odd"), (F.col("n") * 2).alias("twice"))
    view = GroupedView(log, ("k",), ("odd",), ("twice",), f"{folder}/view", rows_of=derive).create(spark)
    log.append(spark.createDataFrame([(1, "a", 3, None), (2, "a", 4, None), (3, "a", -1, None)], ROW), 0)
    view.refresh(spark)
    changed = spark.createDataFrame([(1, "a", 6, None), (3, "a", 5, None)], ROW).withColumn(TYPE, F.lit("update_postimage"))
    log.append(changed, 1)
    view.refresh(spark)
    assert rows(view.read(spark)) == [(0, 2, Decimal(20)), (1, 1, Decimal(10))]


def test_sums_that_are_not_exact_are_refused(spark, folder):
    kind = T.StructType().add("k", "integer").add("x", "double")
    view = GroupedView(ChangeLog(f"{folder}/log", kind), ("k",), (), ("x",), f"{folder}/view")
    with pytest.raises(ValueError, match="not exact"):
        view.create(spark)


def test_distinct_over_runs_of_a_stream(spark, folder, rows):
    for part in ([1, 2, 2, None], [2, 3, None], [1, 4]):
        spark.createDataFrame([(x,) for x in part], "x int").write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema("x int").parquet(f"{folder}/in")
        append_stream(distinct_stream(source, ["x"]), f"{folder}/out", f"{folder}/cp").awaitTermination()
    assert rows(spark.read.parquet(f"{folder}/out"), "x") == sorted([(1,), (2,), (3,), (4,), (None,)], key=repr)


def test_distinct_forgets_what_is_long_past(spark, folder, rows):
    kind = "x int, at timestamp"
    for hour in ("00", "01", "20", "21", "22"):
        at = F.lit(f"2024-01-01 {hour}:00:00").cast("timestamp")
        spark.range(1).select(F.lit(1).alias("x"), at.alias("at")).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(kind).parquet(f"{folder}/in")
        append_stream(distinct_stream(source, ["x"], "at", "2 hours"), f"{folder}/out", f"{folder}/cp").awaitTermination()
    got = [str(r.at)[11:13] for r in spark.read.parquet(f"{folder}/out").orderBy("at").collect()]
    # Forgotten after the batch of 20 h, which moved the stream on; seen again at 21 h, so not sent at 22 h.
    assert got == ["00", "21"]
