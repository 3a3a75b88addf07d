import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewindle.operators.versions import TYPE
from rewindle.sources.changelog import ChangeLog
from rewindle.streaming.feed import Feed
from rewindle.streaming.fenced import Fenced, FencedTable, restart

ROW = T.StructType().add("k", "integer").add("v", "integer")


def rows_of(spark, *rows):
    return spark.createDataFrame(rows, ROW)


def table_at(spark, folder):
    return FencedTable(ChangeLog(f"{folder}/table", ROW), ("k",), folder).create(spark)


def test_an_old_writer_is_refused_and_what_it_still_writes_does_not_count(spark, folder, rows):
    table = table_at(spark, folder)
    first = table.take_over(spark)
    table.write(rows_of(spark, (1, 1), (2, 1)), first, "w", 0)
    table.write(rows_of(spark, (1, 2)), first, "w", 1)
    table.write(rows_of(spark, (1, 2)), first, "w", 1)  # repeated
    assert rows(table.current(spark)) == [(1, 2), (2, 1)] and table.log.head(spark) == 1
    second = table.take_over(spark, restore_to=0)
    assert (first, second) == (1, 2) and table.epochs(spark) == {1: -1, 2: 1}
    assert rows(table.current(spark)) == [(1, 1), (2, 1)]
    with pytest.raises(Fenced):
        table.write(rows_of(spark, (9, 9)), first, "w", 2)
    # It looked before the new epoch began, and writes now: to the very version the new writer takes next.
    table.log.append(rows_of(spark, (9, 9), (2, 0)), 3, "e1-w", 2)
    assert rows(table.current(spark)) == [(1, 1), (2, 1)]
    table.write(rows_of(spark, (3, 3)), second, "w", 0)
    assert rows(table.current(spark)) == [(1, 1), (2, 1), (3, 3)]
    assert rows(table.current(spark, 1)) == [(1, 2), (2, 1)]


def test_an_epoch_whose_owner_was_lost_is_passed_over(spark, folder, rows):
    table = table_at(spark, folder)
    table.write(rows_of(spark, (1, 1)), table.take_over(spark), "w", 0)
    store, epochs = table._files(spark)
    store.createNewFile(spark._jvm.org.apache.hadoop.fs.Path(epochs, "2"))
    assert table.epochs(spark) == {1: -1, 2: None}
    assert rows(table.current(spark)) == [(1, 1)]
    assert table.take_over(spark) == 3 and rows(table.current(spark)) == [(1, 1)]


def test_stop_restore_restart_gives_the_uninterrupted_table(spark, folder, rows):
    source = ChangeLog(f"{folder}/source", ROW).create(spark)
    table = table_at(spark, folder)
    old = Feed(source, ("k",), f"{folder}/old", after=-1)
    epoch = table.take_over(spark)

    def change(version, *rows):
        source.append(spark.createDataFrame(rows, T.StructType([*ROW.fields, T.StructField(TYPE, T.StringType())])), version)

    change(0, (1, 0, "insert"), (2, 0, "insert"))
    old.run(spark, table.follow(old, epoch))
    recorded = table.log.head(spark), old.position(spark)
    change(1, (1, 1, "update_postimage"), (2, 0, "delete"), (3, 1, "insert"))
    old.run(spark, table.follow(old, epoch))
    second, new = restart(spark, table, old, *recorded, folder)
    assert rows(table.current(spark)) == [(1, 0), (2, 0)]
    change(2, (3, 2, "update_postimage"), (4, 2, "insert"))
    with pytest.raises(Exception, match="taken over"):
        old.run(spark, table.follow(old, epoch))
    new.run(spark, table.follow(new, second))
    assert rows(table.current(spark)) == [(1, 1), (3, 2), (4, 2)]
    assert table.read(spark).where(F.col("_writer").startswith("e2-")).groupBy("k").count().where("count > 2").count() == 0
