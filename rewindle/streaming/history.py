"""Type-2 history kept by a stream, in any order of arrival."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rewindle.operators.joins import BROADCAST_ROWS, FAIL, broadcast_if_small, null_safe_join
from rewindle.operators.scd2 import END, NULL_SEQ, START, scd2
from rewindle.operators.skew import MIN_ROWS, NONE_HEAVY, HeavyKeys, find_heavy, key_hash
from rewindle.operators.versions import (
    TIME,
    TYPE,
    VERSION,
    WRITER_COLUMNS,
    as_of,
    change_feed_diff,
    drop_system,
    latest_per_key,
)
from rewindle.sources.changelog import CODEC, ChangeLog, stream_writer
from rewindle.sources.keyindex import KeyIndex


#: The folder of what a batch writes for itself.
KEPT = "in-work"
ROW_HASH = "__row_hash"


@dataclass(frozen=True)
class HistoryTable:
    """A history and the event log it is built from; both are change logs.

    Versions are never patched from each other: a late event may part two equal
    versions that were merged, or win a tie against an event no longer visible.
    Each batch rebuilds its keys from the event log, from the batch's earliest
    event of the key on, and appends the differences. So a batch that arrives in
    order reads the end of the event log only.

    A source that is itself a change feed names in ``row`` the upstream row that
    an event shows, and in ``row_version`` the version that wrote it. Of the
    changes of one upstream row the newest counts, and none if that is a delete. A row
    keeps its sequence value; its key may change.

    With ``indexed``, files of the history (and, for upstream rows, of the event log) that hold none
    of a batch's keys are not read, as long as the batch's keys are few.
    """

    path: str
    source: T.StructType
    keys: tuple[str, ...]
    seq: str
    tie: tuple[str, ...] = ()
    except_cols: tuple[str, ...] = ()
    deletes: str = "ignore"
    row: str | None = None
    row_version: str | None = None
    indexed: bool = False

    @cached_property
    def events(self) -> ChangeLog:
        return ChangeLog(f"{self.path}/events", _business(self.source))

    @cached_property
    def history(self) -> ChangeLog:
        dropped = {c.lower() for c in self.except_cols}
        source = _business(self.source).fields
        kind = next(f.dataType for f in source if f.name.lower() == self.seq.lower())
        span = [T.StructField(START, kind), T.StructField(END, kind)]
        kept = [f for f in source if f.name.lower() not in dropped]
        return ChangeLog(f"{self.path}/history", T.StructType([*kept, *span]))

    @cached_property
    def key_index(self) -> KeyIndex:
        return KeyIndex(self.history, self.keys, f"{self.path}/history-index")

    @cached_property
    def row_index(self) -> KeyIndex:
        return KeyIndex(self.events, (self.row,), f"{self.path}/events-index")

    @property
    def row_keys(self) -> list[str]:
        return [*self.keys, START]

    def _build(self, events: DataFrame, heavy=None) -> DataFrame:
        present = {c.lower() for c in events.columns}
        dropped = [c for c in (*self.except_cols, TYPE) if c.lower() in present]
        return scd2(events, self.keys, self.seq, self.tie, dropped, self.deletes, heavy)

    def create(self, spark: SparkSession) -> HistoryTable:
        self.events.create(spark)
        self.history.create(spark)
        return self

    def current(self, spark: SparkSession) -> DataFrame:
        """The history as it stands."""
        log = self.history.read(spark)
        if self.history.read(spark, 1).isEmpty():
            # The first version holds each row once: nothing has replaced any.
            return drop_system(log.where(~F.coalesce(TYPE, F.lit("")).isin("delete", "update_preimage")))
        return as_of(log, self.row_keys)

    def apply(self, batch: DataFrame, writer: str = "batch", batch_id: int = 0) -> None:
        """Take in one batch. Repeating a batch of the same writer and number changes nothing.

        Each step's shuffle files go as soon as its result is written, so that those of
        earlier steps and batches do not fill the disks.
        """
        with _shuffles_removed(batch.sparkSession):
            try:
                self._apply(batch, writer, batch_id)
            finally:
                _deleted(batch.sparkSession, f"{self.path}/{KEPT}")

    def _apply(self, batch: DataFrame, writer: str, batch_id: int) -> None:
        spark = batch.sparkSession
        events, history = self.events, self.history
        has_seq = F.when(F.col(self.seq).isNull(), FAIL(NULL_SEQ)).otherwise(True)
        version, stored = events.version_for(spark, writer, batch_id)
        added = events.append(batch.where(has_seq), version, writer, batch_id)
        if not added:
            return
        if self.indexed and self.row is not None:
            self.row_index.add(spark, version)
        # From here on the batch is read from the log: it need not be kept in memory.
        batch = _without_system(events.read(spark, version, version))
        all_events = _without_system(events.read(spark))
        large = added > BROADCAST_ROWS

        def heavy_of(log: DataFrame) -> HeavyKeys:
            # A log this short has no heavy key; otherwise they are looked for in the log: what is built shows no key more often.
            return NONE_HEAVY if stored + added < MIN_ROWS else find_heavy(log, self.keys)

        others = _without_system(events.read(spark).where(F.col(VERSION) != version))
        version, _ = history.version_for(spark, writer, batch_id)
        if version == 0:
            # No history yet: build it from all events there are.
            changes = self._build(self._first_standing(all_events), heavy_of(all_events))
        else:
            first, lowest = self._first(self._touched(batch, others, large))
            if self.indexed:
                known = self.key_index.read(spark, first.select(*self.keys), version - 1)
            else:
                known = history.read(spark, end=version - 1)
            later = all_events.where(lowest)
            changes = self._changes(later, known, first, heavy_of(later), large)
        if history.append(changes, version, writer, batch_id) and self.indexed:
            self.key_index.add(spark, version)

    def _standing(self, events: DataFrame) -> DataFrame:
        """The events that count: the newest change of each upstream row, without retracted rows."""
        if self.row is None:
            return events
        # A row has a change for each version of the feed at most: no need to look for its newest before the shuffle too.
        events = self._by_row(events).repartition(ROW_HASH)
        newest = latest_per_key(events, [ROW_HASH, self.row], [self.row_version])
        return newest.where(~F.col(TYPE).eqNullSafe("delete")).drop(ROW_HASH)

    def _by_row(self, events: DataFrame) -> DataFrame:
        """With a hash of the upstream row: names of rows are long and start alike, so they are sorted by it first."""
        return events.withColumn(ROW_HASH, key_hash(events, [self.row]))

    def _first_standing(self, events: DataFrame) -> DataFrame:
        """``_standing`` of all events; those of one upstream version show each row once, so none is replaced."""
        if self.row is None:
            return events
        version = F.col(self.row_version)
        seen = events.agg(F.min(version).alias("low"), F.max(version).alias("high"), F.count_if(version.isNull()).alias("unknown")).first()
        if seen.low != seen.high or seen.unknown:
            return self._standing(events)
        return events.where(~F.col(TYPE).eqNullSafe("delete"))

    def _touched(self, batch: DataFrame, others: DataFrame, large: bool) -> DataFrame:
        """Keys and sequence values of the batch, and of what the log's other versions know of its upstream rows."""
        places = [*self.keys, self.seq]
        if self.row is None:
            return batch.select(*places)
        if self.indexed:
            others = _without_system(self.row_index.read(batch.sparkSession, batch.select(self.row).distinct()))
        rows = self._by_row(batch).select(ROW_HASH, self.row)
        rows = rows if large else broadcast_if_small(rows.distinct())
        known = self._by_row(others).join(rows, [ROW_HASH, self.row], "left_semi")
        # An event that names no row is looked at when its key is.
        return batch.where(F.col(self.row).isNotNull()).select(*places).unionByName(known.select(*places))

    def _first(self, batch: DataFrame) -> tuple[DataFrame, Column]:
        """Each key's earliest event in the batch, broadcast if the keys are few.

        Also a condition all rebuilt events meet, in a form that lets the scan
        of the event log skip files and row groups.
        """
        first = batch.groupBy(*self.keys).agg(F.min(self.seq).alias("__first"))
        if self.row is not None:
            first = self._kept(first, "first")
        kind = first.schema["__first"].dataType
        # As a value that goes through the driver unchanged, whatever the time zones.
        as_micros = isinstance(kind, T.TimestampType)
        exact = isinstance(
            kind, (T.TimestampType, T.TimestampNTZType, T.DateType, T.IntegralType, T.StringType)
        )
        low = F.min("__first")
        plain = F.unix_micros(low) if as_micros else low.cast("string")
        row = first.agg(
            F.count(F.lit(1)).alias("keys"), (plain if exact else F.lit(None)).alias("low")
        ).first()
        if row.keys <= BROADCAST_ROWS:
            first = F.broadcast(first)
        if not exact:
            return first, F.lit(True)
        low = F.timestamp_micros(F.lit(row.low)) if as_micros else F.lit(row.low).cast(kind)
        return first, F.col(self.seq) >= low

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` written beside the logs until the batch is done, for results that are used more than once."""
        path = f"{self.path}/{KEPT}/{name}"
        rows.write.mode("overwrite").option("compression", CODEC).parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def _changes(self, events, history, first, heavy, large) -> DataFrame:
        """The differences that the events from ``first`` on make to ``history``.

        With ``large`` the batch has many events: to look for the log's rows near them would cost more than it saves.
        """
        known = null_safe_join(history, first, self.keys, "inner")
        if large:
            # A row of the history has a change for each version at most, as above.
            known = known.repartition(*self.row_keys)
        known = as_of(known, self.row_keys)
        # Versions that end before a key's first new event stay as they are.
        old = known.where(F.col(END).isNull() | (F.col(END) >= F.col("__first")))
        if large:
            old = self._kept(old, "old")
        # The version which that event falls into stands for the events before it.
        reached = self._as_events(old.where(F.col(START) < F.col("__first")), events)
        at_keys = lambda rows: null_safe_join(rows, first, self.keys, "inner").where(
            F.col(self.seq) >= F.col("__first")
        )
        if self.row is not None:
            # A row may since have moved to another key, so all its changes are looked at.
            if not large:
                near = at_keys(events).select(self.row).distinct()
                events = events.join(near, self.row, "left_semi")
            events = self._standing(events)
        again = at_keys(events)
        new = self._build(again.drop("__first").unionByName(reached), heavy)
        return change_feed_diff(old.drop("__first"), new, self.row_keys)

    def _as_events(self, versions: DataFrame, events: DataFrame) -> DataFrame:
        """Versions as the events that started them; dropped columns are null."""
        shown = {c.lower() for c in versions.columns}
        columns = []
        for field in events.schema:
            if field.name.lower() == self.seq.lower():
                value = F.col(START)
            elif field.name == TYPE:
                value = F.lit("insert")
            elif field.name.lower() in shown:
                value = F.col(field.name)
            else:
                value = F.lit(None).cast(field.dataType)
            columns.append(value.alias(field.name))
        return versions.select(*columns)

    def follow(
        self, source: DataFrame, checkpoint: str, writer: str = "stream"
    ) -> StreamingQuery:
        """Apply a stream until its present end; a later call goes on from there.

        A stream that starts over on a new checkpoint counts as another writer, so
        its batches do not replace those of the old one.
        """

        def step(batch: DataFrame, batch_id: int) -> None:
            self.apply(batch, stream_writer(batch, writer), batch_id)

        return (
            source.writeStream.foreachBatch(step)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes the shuffle files of a query when it ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _deleted(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _without_system(events: DataFrame) -> DataFrame:
    """The event with its change type; how it got into the log does not matter."""
    return events.drop(TIME, VERSION, *WRITER_COLUMNS)


def _business(schema: T.StructType) -> T.StructType:
    skip = {TYPE, TIME, VERSION, *WRITER_COLUMNS}
    return T.StructType([f for f in schema.fields if f.name not in skip])


def await_all(queries: Sequence[StreamingQuery]) -> None:
    """Wait for the streams to reach their end; stop them all if one fails."""
    try:
        for q in queries:
            q.awaitTermination()
    finally:
        for q in queries:
            q.stop()
