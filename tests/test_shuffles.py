"""What the chained stages send and keep on disk while they run."""

import random
import re
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewindle.operators.scd2 import scd2
from rewindle.operators.skew import NONE_HEAVY, find_heavy
from rewindle.operators.versions import change_feed_diff
from rewindle.streaming import history as history_module
from rewindle.streaming.history import HistoryTable

ROWS = (
    T.StructType()
    .add("key", "integer")
    .add("seq", "integer")
    .add("value", "string")
    .add("row", "string")
    .add("version", "long")
    .add("_change_type", "string")
)


def table(path):
    return HistoryTable(path, ROWS, ("key",), "seq", (), ("row", "version"), row="row", row_version="version")


def batch(spark, version, values):
    return spark.createDataFrame([(k, s, v, f"{k}-{s}", version, "insert") for k, s, v in values], ROWS)


def test_a_batch_leaves_no_shuffle_files(spark, folder):
    history = table(folder).create(spark)
    spark._jvm.System.gc()
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    context = spark.sparkContext._jsc.sc()
    known = lambda: context.env().mapOutputTracker().shuffleStatuses().size()
    own = []
    for n in range(3):
        rows = batch(spark, n, [(k, n * 10 + s, "ab"[s]) for k in range(50) for s in range(2)])
        start = known()
        history.apply(rows, "batch", n)
        own.append(known() - start)
    assert max(own) <= 0
    assert spark.conf.get(setting) == before
    assert history.current(spark).count() == 300


def test_one_version_needs_no_search_for_the_newest(spark, folder, plan, rows):
    history = table(folder).create(spark)
    first = batch(spark, 4, [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]).unionByName(
        spark.createDataFrame([(3, 1, "gone", "3-1", 4, "delete")], ROWS)
    )
    history.apply(first, "batch", 0)
    assert "Exchange" not in plan(history._first_standing(history.events.read(spark)))
    assert "Exchange" not in plan(history.current(spark))
    want = [(1, 1, "a", 1, 2), (1, 2, "b", 2, None), (2, 1, "c", 1, None)]
    assert rows(history.current(spark)) == sorted(want, key=repr)
    # a row changed by a later version, and one without a version: the newest is looked for
    history.apply(batch(spark, 5, [(1, 2, "changed")]), "batch", 1)
    assert "Exchange" in plan(history._first_standing(history.events.read(spark)))
    assert rows(history.current(spark), "key", "seq", "value") == [(1, 1, "a"), (1, 2, "changed"), (2, 1, "c")]


def sent(text):
    """What stands below the shuffles of a plan."""
    return text[text.index("Exchange") :]


def test_hashes_and_row_copies_are_not_shuffled(spark, folder, plan):
    path = f"{folder}/rows"
    spark.createDataFrame([(1, 1, 1, "a")], "key int, seq int, tie int, value string").write.parquet(path)
    events = spark.read.parquet(path)
    made = plan(scd2(events, ["key"], "seq", ["tie"], [], heavy=NONE_HEAVY))
    assert made.count("Exchange") == 1 and "xxhash64" in made and "xxhash64" not in sent(made)
    diff = plan(change_feed_diff(events, events.withColumn("value", F.lit("b")), ["key", "seq"]))
    assert diff.count("Exchange") == 1 and not re.search(r"struct\(", sent(diff)) and "struct" in diff


def test_a_large_batch_looks_for_heavy_keys_in_the_log_and_gives_the_same_history(spark, folder, plan, rows, monkeypatch):
    pick = random.Random(5)
    feeds = []
    for version in range(4):
        # a row keeps its place; its key, its value and whether it is there change
        own = [(pick.randrange(8), r, pick.choice("abc"), f"row-{r}", version, pick.choice(["insert", "insert", "delete"])) for r in pick.sample(range(60), 25)]
        feeds.append(spark.createDataFrame(own, ROWS).repartition(3))
    small, large = (table(f"{folder}/{n}").create(spark) for n in ("small", "large"))
    for n, feed in enumerate(feeds):
        small.apply(feed, "batch", n)
    searched = []

    def searching(df, keys, **more):
        searched.append(plan(df))
        return find_heavy(df, keys, **more)

    for name, value in (("BROADCAST_ROWS", 0), ("MIN_ROWS", 0), ("find_heavy", searching)):
        monkeypatch.setattr(history_module, name, value)
    for n, feed in enumerate(feeds):
        large.apply(feed, "batch", n)
        assert rows(large.history.read(spark, n, n).drop("_commit_timestamp")) == rows(small.history.read(spark, n, n).drop("_commit_timestamp"))
    assert rows(large.current(spark)) == rows(small.current(spark)) and small.current(spark).count() > 20
    assert len(searched) == 4 and not re.search("Join|Window|Exchange", "".join(searched))
    assert not Path(large.path, "in-work").exists()
