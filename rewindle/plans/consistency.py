"""Is a backup as good as the original? Clone a stream's source and target, go on on the clones, and compare."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewindle.operators import hashtree as H
from rewindle.sources.changelog import ChangeLog
from rewindle.streaming.feed import Feed
from rewindle.streaming.upsert import append_stream


@dataclass(frozen=True)
class Branch:
    """A source log, the stream that follows it, and the table that the stream fills."""

    feed: Feed
    target: str
    #: Rows the target began with, if it is a clone.
    begun: str | None = None

    def update(self, spark: SparkSession) -> None:
        """Take in what the source has got since, to its present end."""
        self.feed.run(spark, lambda stream, checkpoint: append_stream(stream, self.target, checkpoint))

    def rows(self, spark: SparkSession) -> DataFrame:
        rows = None
        for path in (self.begun, self.target):
            if path is not None:
                part = spark.read.schema(self.feed.schema).parquet(path)
                rows = part if rows is None else rows.unionByName(part)
        return rows


def clone_log(spark: SparkSession, log: ChangeLog, path: str) -> ChangeLog:
    """A copy of a log with its versions and times; changes may be added to either."""
    copy = ChangeLog(path, log.business).create(spark)
    copy.load(log.read(spark))
    return copy


def clone_branch(spark: SparkSession, branch: Branch, path: str, version: int) -> Branch:
    """Clones of a branch's source and target, with a stream that goes on after ``version``, the original's recorded position.

    The clone's stream has a checkpoint of its own: it reads the cloned source, and the position, unlike a list of files, means the same there.
    """
    feed = branch.feed
    source = clone_log(spark, feed.log, f"{path}/source")
    branch.rows(spark).where(F.col("_commit_version") <= version).write.mode("overwrite").parquet(f"{path}/target-begun")
    spark.createDataFrame([], feed.schema).coalesce(1).write.mode("append").parquet(f"{path}/target")
    return Branch(Feed(source, feed.keys, f"{path}/feed", feed.tie, after=version), f"{path}/target", f"{path}/target-begun")


def compare(spark: SparkSession, left: Branch, right: Branch, path: str) -> DataFrame:
    """The rows, copies counted, that only one branch's target holds, with ``side``; over the business columns."""
    columns = left.feed.log.business.names
    sides = [b.rows(spark) for b in (left, right)]
    depth = H.depth_for(max(s.count() for s in sides))
    trees = tuple(H.build(s, columns, f"{path}/tree-{i}", depth) for i, s in enumerate(sides))
    return H.tree_diff(*sides, columns, trees)
