"""Restarting a stream after a restore, so that each change counts once and the stream of before writes no more."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rewindle.operators.versions import TIME, VERSION, as_of, latest_per_key, restore_changes
from rewindle.sources.changelog import ChangeLog, stream_writer
from rewindle.streaming.feed import Feed


class Fenced(RuntimeError):
    """Another writer has taken the table over."""


@dataclass(frozen=True)
class FencedTable:
    """A table kept by one stream at a time; whoever takes it over gets the next epoch.

    Taking over makes the epoch's file, which can be made once only, and then records the newest version there was: the fence. A writer
    looks for newer epochs before it writes. One that looked just before and writes after is not held up, but its versions lie beyond the fence
    and count for no reader. So the table is what the fences say, whatever an old stream still does.
    """

    log: ChangeLog
    keys: tuple[str, ...]
    path: str
    tie: tuple[str, ...] = ()

    def create(self, spark: SparkSession) -> FencedTable:
        self.log.create(spark)
        return self

    def _files(self, spark: SparkSession):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/epochs")
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(folder)
        return store, folder

    def epochs(self, spark: SparkSession) -> dict[int, int | None]:
        """Every epoch and its fence; None where its owner was lost before it recorded one."""
        store, folder = self._files(spark)
        names = [f.getPath().getName() for f in store.listStatus(folder)]
        found: dict[int, int | None] = {int(n): None for n in names if n.isdigit()}
        for name in names:
            epoch, _, fence = name.partition(".fence.")
            if fence:
                found[int(epoch)] = int(fence)
        return found

    def take_over(self, spark: SparkSession, restore_to: int | None = None) -> int:
        """Begin a new epoch, after which older writers' changes do not count; returns it.

        ``restore_to`` brings the table back to a version first, as the first change of the epoch.
        """
        store, folder = self._files(spark)
        make = lambda name: store.createNewFile(spark._jvm.org.apache.hadoop.fs.Path(folder, name))
        epoch = max(self.epochs(spark), default=0) + 1
        while not make(str(epoch)):  # someone else was faster
            epoch += 1
        fence = self.log.head(spark)
        make(f"{epoch}.fence.{fence}")
        if restore_to is not None and restore_to < fence:
            self.log.append(restore_changes(self.read(spark), self.keys, restore_to, self.tie), fence + 1, f"e{epoch}-restore", 0)
        return epoch

    def _counts(self, spark: SparkSession) -> Column:
        epoch = F.coalesce(F.regexp_extract("_writer", r"^e([0-9]+)-", 1).try_cast("bigint"), F.lit(0))
        valid = F.lit(True)
        for number, fence in self.epochs(spark).items():
            if fence is not None:
                valid = valid & ((epoch >= number) | (F.col(VERSION) <= fence))
        return valid

    def read(self, spark: SparkSession, end: int | None = None) -> DataFrame:
        """The log without what was written beyond a fence."""
        return self.log.read(spark, end=end).where(self._counts(spark))

    def current(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        return as_of(self.read(spark), self.keys, version, self.tie)

    def write(self, changes: DataFrame, epoch: int, writer: str, batch_id: int) -> int:
        """Write one batch of an epoch and return its version; a batch that is repeated is replaced."""
        spark = changes.sparkSession
        if max(self.epochs(spark), default=0) > epoch:
            raise Fenced(f"epoch {epoch} has been taken over")
        return self.log.commit(spark, changes, f"e{epoch}-{writer}", batch_id)

    def follow(self, feed: Feed, epoch: int, order: Sequence[str] = ()):
        """What runs one stretch of ``feed`` into this table, for ``feed.run``: the newest change of each key of a batch.

        ``order`` puts changes of a key within one source version in order.
        """

        def start(stream: DataFrame, checkpoint: str) -> StreamingQuery:
            def step(batch: DataFrame, number: int) -> None:
                newest = latest_per_key(batch, self.keys, [VERSION, *order])
                self.write(newest.drop(VERSION, TIME), epoch, stream_writer(batch, "follow"), number)

            return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

        return start


def restart(spark: SparkSession, table: FencedTable, source: Feed, version: int, position: int, folder: str) -> tuple[int, Feed]:
    """Act on what a backup recorded: the table at ``version``, its stream at ``position`` of the source.

    The table is taken over and brought back, and the stream goes on after the position with a checkpoint of its own in ``folder``.
    """
    epoch = table.take_over(spark, version)
    return epoch, Feed(source.log, source.keys, f"{folder}/epoch-{epoch}", source.tie, after=position)
