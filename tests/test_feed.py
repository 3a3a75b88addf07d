import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewindle.operators import hashtree
from rewindle.operators.merge import table_diff
from rewindle.operators.versions import TIME
from rewindle.plans import consistency
from rewindle.sources.changelog import ChangeLog
from rewindle.sources.feed_reader import FeedReader
from rewindle.streaming import feed
from rewindle.streaming.feed import Feed

ROW = (
    T.StructType()
    .add("id", "integer")
    .add("name", "string")
    .add("at", "timestamp")
    .add("plain", "timestamp_ntz")
    .add("price", T.DecimalType(10, 2))
    .add("tags", T.ArrayType(T.StringType()))
)


def changes(spark, rows):
    kind = "id int, name string, _change_type string"
    made = spark.createDataFrame(rows, kind)
    far = F.lit("2999-12-31 00:00:00")
    return made.withColumns(
        {"at": far.cast("timestamp"), "plain": far.cast("timestamp_ntz"), "price": (F.col("id") / 4).cast("decimal(10,2)"), "tags": F.array("name")}
    )


def kept(path, fail_once=None):
    """A sink of one folder a batch, written anew if the batch is repeated."""

    def step(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if fail_once and number in fail_once:
            fail_once.discard(number)
            raise RuntimeError("lost")

    def start(stream, checkpoint):
        return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    return start


def batches(spark, path):
    rows = spark.read.parquet(path).select("batch", "_commit_version", "_change_type", "id", "name").collect()
    return [[tuple(r[1:]) for r in sorted(rows, key=repr) if r.batch == b] for b in sorted({r.batch for r in rows})]


def test_rows_first_then_versions_in_order_through_failures(spark, folder):
    log = ChangeLog(f"{folder}/log", ROW).create(spark)
    log.commit(spark, changes(spark, [(1, "a", "insert"), (2, "b", "insert"), (3, "c", "insert")]), "w", 0)
    log.commit(spark, changes(spark, [(1, "x", "update_postimage"), (3, None, "delete")]), "w", 1)
    own = Feed(log, ("id",), f"{folder}/reader")
    # What a cut-off start left behind is made anew.
    spark.range(3).write.parquet(f"{folder}/reader/snapshot")
    assert own.begin(spark) == 1 == own.position(spark)
    for k in range(2, 6):
        log.commit(spark, changes(spark, [(1, f"v{k}", "update_postimage"), (k + 10, "n", "insert")]), "w", k)
    assert own.begin(spark) == 1
    lost = {0, 2}
    for batch in (0, 2):
        with pytest.raises(Exception, match="lost"):
            own.run(spark, kept(f"{folder}/out", lost), max_versions=2)
        assert own.position(spark) == (1 if batch == 0 else 3)
    own.run(spark, kept(f"{folder}/out", lost), max_versions=2)
    assert own.position(spark) == 5
    pair = lambda k: [(k, "insert", k + 10, "n"), (k, "update_postimage", 1, f"v{k}")]
    assert batches(spark, f"{folder}/out") == [[(1, "insert", 1, "x"), (1, "insert", 2, "b")], pair(2) + pair(3), pair(4) + pair(5)]
    row = spark.read.parquet(f"{folder}/out").where("id = 2").select(*ROW.names).first()
    same = changes(spark, [(2, "b", "insert")]).select(*ROW.names).first()
    assert row == same
    own.run(spark, kept(f"{folder}/out"))  # nothing new
    assert len(batches(spark, f"{folder}/out")) == 3


def test_a_snapshot_is_read_in_slices_and_can_be_left_in_between(spark, folder, monkeypatch):
    monkeypatch.setattr(feed, "FILE_ROWS", 10)
    log = ChangeLog(f"{folder}/log", ROW).create(spark)
    log.append(changes(spark, [(i, "r", "insert") for i in range(50)]).repartition(5), 0)
    reader = Feed(log, ("id",), f"{folder}/reader")
    start = kept(f"{folder}/out")
    reader.run(spark, start, max_files=1, batches=2)
    log.append(changes(spark, [(7, "late", "update_postimage")]), 1)
    reader.run(spark, start, max_files=2)
    got = batches(spark, f"{folder}/out")
    assert len(got) > 3 and got[-1] == [(1, "update_postimage", 7, "late")]
    assert sorted(r[2] for b in got[:-1] for r in b) == list(range(50))


def test_a_version_counts_once_its_write_is_complete(spark, folder):
    log = ChangeLog(f"{folder}/log", ROW).create(spark)
    log.append(changes(spark, [(1, "a", "insert")]), 0)
    spark.range(3).write.parquet(f"{folder}/half")
    own = Feed(log, ("id",), f"{folder}/reader", after=-1)
    reader = FeedReader(own.schema, {"log": f"{folder}/log", "checkpoint": own.checkpoint, "base": "-1"})
    assert reader.latestOffset() == {"snapshot": 0, "version": 0}
    import os
    import shutil

    shutil.copytree(f"{folder}/half", f"{folder}/log/_commit_version=1/_writer=w/_batch_id=1", ignore=shutil.ignore_patterns("_SUCCESS"))
    assert reader.latestOffset()["version"] == 0 and os.path.exists(f"{folder}/log/_commit_version=1")


def test_an_empty_log_begins_with_its_first_version(spark, folder):
    log = ChangeLog(f"{folder}/log", ROW).create(spark)
    own = Feed(log, ("id",), f"{folder}/reader")
    own.run(spark, kept(f"{folder}/out"))
    assert own.position(spark) == -1
    log.append(changes(spark, [(1, "a", "insert")]), 0)
    own.run(spark, kept(f"{folder}/out"))
    assert batches(spark, f"{folder}/out") == [[(0, "insert", 1, "a")]]


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_tree_diff_equals_table_diff(spark, folder, rows, depth):
    pick = random.Random(depth)
    draw = lambda n: [(pick.choice([None, 1, 2]), pick.choice([None, "", "a", "b"]), {"k": pick.randrange(2)}) for _ in range(n)]
    common = draw(200)
    make = lambda own: spark.createDataFrame(common + own, "x int, y string, m map<string, int>")
    sides = [make(draw(6)), make(draw(6))]
    columns = ["x", "y"]
    trees = tuple(hashtree.build(s, columns, f"{folder}/{i}", depth) for i, s in enumerate(sides))
    for strict in (True, False):
        assert rows(hashtree.tree_diff(*sides, columns, trees, strict)) == rows(table_diff(*sides, columns, strict))
    whole = ["x", "y", "m"]  # maps count by their entries
    assert hashtree.build(sides[0], whole, f"{folder}/m", depth).read(spark, 0).first().rows == 206
    assert not hashtree.equal(spark, trees)


def test_equal_tables_have_equal_trees_however_they_lie(spark, folder):
    df = spark.range(5000).select("id", (F.col("id") % 7).cast("string").alias("s")).unionAll(spark.range(3).select("id", F.lit(None).cast("string")))
    trees = tuple(hashtree.build(d, ["id", "s"], f"{folder}/{i}", 2) for i, d in enumerate((df.repartition(7), df.orderBy(F.desc("id")))))
    assert hashtree.equal(spark, trees)
    assert hashtree.unequal(spark, *trees).count() == 0
    assert hashtree.tree_diff(df, df, ["id", "s"], trees).count() == 0


def test_only_unequal_buckets_are_compared(spark, folder):
    left = spark.range(20_000).select("id", F.lit("x").alias("s"))
    right = left.withColumn("s", F.when(F.col("id") == 77, "y").otherwise("x"))
    depth = hashtree.depth_for(20_000)
    assert depth == 2
    trees = tuple(hashtree.build(d, ["id", "s"], f"{folder}/{i}", depth) for i, d in enumerate((left, right)))
    assert hashtree.unequal(spark, *trees).count() == 2
    got = {tuple(r) for r in hashtree.tree_diff(left, right, ["id", "s"], trees).collect()}
    assert got == {(77, "x", "left"), (77, "y", "right")}
    with pytest.raises(ValueError, match="differ in type"):
        hashtree.tree_diff(left, left.withColumn("id", F.col("id").cast("int")), ["id", "s"], trees)
    with pytest.raises(ValueError, match="depths"):
        hashtree.unequal(spark, trees[0], hashtree.HashTree("elsewhere", 1))


def test_a_cloned_branch_goes_on_where_the_original_stood(spark, folder, rows):
    log = ChangeLog(f"{folder}/log", ROW).create(spark)
    main = consistency.Branch(Feed(log, ("id",), f"{folder}/feed"), f"{folder}/target")
    log.append(changes(spark, [(1, "a", "insert"), (2, "b", "insert")]), 0)
    main.update(spark)
    log.append(changes(spark, [(3, "c", "insert")]), 1)
    clone = consistency.clone_branch(spark, main, f"{folder}/clone", main.feed.position(spark))
    log.append(changes(spark, [(4, "d", "insert")]), 2)  # after the clone was taken
    for branch in (main, clone):
        branch.update(spark)
        branch.update(spark)
    assert rows(clone.rows(spark), "id", "name") == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(consistency.compare(spark, main, clone, f"{folder}/cmp"), "id", "name", "side") == [(4, "d", "left")]
    # The first rows bear the time of their snapshot, later ones the time the source recorded.
    assert main.rows(spark).where(F.col(TIME).isNull()).count() == 0
