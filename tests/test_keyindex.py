import random
from dataclasses import replace

import pytest
from brute import history
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_streams import history_table, random_events

from rewindle.operators.versions import as_of
from rewindle.sources import keyindex
from rewindle.sources.changelog import ChangeLog
from rewindle.sources.keyindex import KeyIndex
from rewindle.streaming.history import HistoryTable
from rewindle.streaming.upsert import upsert_stream

ROW = T.StructType().add("a", "integer").add("b", "string").add("v", "string")


def filled(spark, folder, versions=12):
    log = ChangeLog(f"{folder}/log", ROW).create(spark)
    index = KeyIndex(log, ("a", "b"), f"{folder}/index")
    for v in range(versions):
        rows = [(100 * v + i, "x" if i % 2 else None, f"v{v}") for i in range(40)] + [(7, "hot", f"v{v}")] * (v % 3 == 0)
        log.append(spark.createDataFrame(rows, ROW).coalesce(1), v)
        index.add(spark, v)
    return log, index


def test_a_look_up_reads_few_files_and_misses_no_row(spark, folder, rows):
    log, index = filled(spark, folder)
    keys = spark.createDataFrame([(305, "x"), (804, None), (7, "hot"), (9999, "x")], "a int, b string")
    read = index.read(spark, keys)
    # Versions 3 and 8 hold the first two keys, 0, 3, 6 and 9 the third; a filter lets through one in thousands.
    assert len(read.inputFiles()) <= 6 and len(log.read(spark).inputFiles()) >= 12
    same = lambda df: df.where("(a = 305 AND b = 'x') OR (a = 804 AND b IS NULL) OR (a = 7 AND b = 'hot')")
    assert rows(same(read), *ROW.names, "_commit_version") == rows(same(log.read(spark)), *ROW.names, "_commit_version")
    assert rows(same(index.read(spark, keys, end=5)), "_commit_version") == [(0,), (3,), (3,)]
    assert rows(index.read(spark, keys.where("a = 9999"))) == []


def test_files_the_index_does_not_know_are_read(spark, folder):
    log, index = filled(spark, folder, 3)
    log.append(spark.createDataFrame([(5000, "x", "late")], ROW), 3)
    key = spark.createDataFrame([(5000, "x")], "a int, b string")
    assert [r.v for r in index.read(spark, key).where("a = 5000").collect()] == ["late"]
    # A version written anew has other files.
    log.append(spark.createDataFrame([(6000, "x", "again")], ROW), 1)
    key = spark.createDataFrame([(6000, "x")], "a int, b string")
    assert [r.v for r in index.read(spark, key).where("a = 6000").collect()] == ["again"]


def test_many_keys_read_the_whole_log(spark, folder, monkeypatch):
    log, index = filled(spark, folder, 3)
    monkeypatch.setattr(keyindex, "MOST_KEYS", 2)
    keys = spark.range(3).select(F.col("id").cast("int").alias("a"), F.lit("x").alias("b"))
    assert index.read(spark, keys).count() == log.read(spark).count()


@pytest.mark.parametrize("close", [True, False])
def test_an_indexed_history_equals_the_one_shot_history(spark, folder, rows, close):
    events = random_events(11 + close)
    want = history(events, False, close)
    random.Random(6).shuffle(events)
    table = replace(history_table(spark, folder, False, close), indexed=True)
    for i, part in enumerate((events[:5], events[5:30], events[30:])):
        batch = spark.createDataFrame(part, table.source)
        table.apply(batch, "w", i)
        if i == 1:
            table.apply(batch, "w", i)
    columns = ("key", "value", "__START_AT", "__END_AT")
    assert rows(table.current(spark), *columns) == sorted(want, key=repr)


def test_a_batch_of_few_keys_reads_a_bounded_part_of_a_growing_history(spark, folder):
    kind = T.StructType().add("key", "integer").add("seq", "integer").add("value", "string")
    table = HistoryTable(folder, kind, ("key",), "seq", indexed=True).create(spark)
    files = []
    for n in range(4):
        table.apply(spark.createDataFrame([(10 * n + i, 1, "v") for i in range(5)], kind).coalesce(1), "w", n)
        read = table.key_index.read(spark, spark.createDataFrame([(3,)], "key int"))
        files.append(len(read.inputFiles()))
    assert files[0] == files[-1] <= 2
    assert len(table.history.read(spark).inputFiles()) > files[-1]


def test_upserts_through_an_index(spark, folder, rows):
    kind = T.StructType().add("k", "integer").add("v", "integer")
    target = ChangeLog(f"{folder}/target", kind).create(spark)
    index = KeyIndex(target, ("k",), f"{folder}/index")
    for n, keys in enumerate(([1, 2, 3], [3, 4], [1, 9])):
        spark.createDataFrame([(k,) for k in keys], "k int").write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema("k int").parquet(f"{folder}/in")
        upsert_stream([source], ["k"], lambda found, n=n: found.withColumn("v", F.lit(n)), target, f"{folder}/cp", index=index).awaitTermination()
    assert rows(as_of(target.read(spark), ["k"])) == [(1, 2), (2, 0), (3, 1), (4, 1), (9, 2)]
    kinds = target.read(spark).groupBy("_change_type").count()
    assert rows(kinds) == [("insert", 5), ("update_postimage", 2)]
