"""Streams that append, and streams that upsert the rows of changed keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rewindle.operators.joins import FAIL, broadcast_if_small
from rewindle.operators.merge import changed_keys
from rewindle.operators.versions import TYPE, VERSION, as_of
from rewindle.sources.changelog import ChangeLog, stream_writer
from rewindle.session import work_dir
from rewindle.sources.files import with_time
from rewindle.sources.keyindex import KeyIndex

#: State that may outgrow memory.
ROCKSDB = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)


def append_stream(
    source: DataFrame, path: str, checkpoint: str, time_column: str = "processed_time"
) -> StreamingQuery:
    """Append a stream with its processing time to a parquet table, to its present end.

    The checkpoint lets a later call take only what has come since; the file
    sink's own log makes a repeated batch count once.
    """
    return (
        with_time(source, time_column)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .trigger(availableNow=True)
        .start()
    )


def distinct_stream(source: DataFrame, columns: Sequence[str], time: str | None = None, keep: str | None = None) -> DataFrame:
    """The first row of each combination of ``columns`` over the whole stream, whatever its batches and restarts.

    What has been seen is keyed state in RocksDB, on the executors' disks and in the checkpoint. With ``time`` and ``keep``, a
    repeat within ``keep`` of the event time it was seen at is never sent on; after a batch that moves the stream past that, the
    combination is forgotten, which bounds the state. Without, it is kept for good. Null is a value like any other.
    """
    source.sparkSession.conf.set(*ROCKSDB)
    if time is None:
        return source.dropDuplicates(list(columns))
    return source.withWatermark(time, keep).dropDuplicatesWithinWatermark(list(columns))


def upsert_changes(log: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` as inserts and updates of the table behind ``log``.

    A log keeps one change per key and version, so a key that repeats or is
    null fails the job. Only keys of the log that ``rows`` brings are shuffled
    if those are few.
    """
    keys = list(keys)
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    narrow = log.select(*keys, TYPE, VERSION)
    asked = broadcast_if_small(counted.select(*keys))
    known = as_of(narrow.join(asked, keys, "left_semi"), keys).select(
        *keys, F.lit(True).alias("__known")
    )
    some_null = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    checked = counted.join(known, keys, "left").select(
        *keys,
        F.when(F.col("__n") > 1, FAIL("a key repeats in one upsert"))
        .otherwise(F.coalesce("__known", F.lit(False)))
        .alias("__known"),
    )
    kind = (
        F.when(some_null, FAIL("a key of an upsert is null").cast("string"))
        .when(F.col("__known"), "update_postimage")
        .otherwise("insert")
    )
    return rows.join(checked, keys, "left").withColumn(TYPE, kind).drop("__known")


def upsert_stream(
    sources: Sequence[DataFrame],
    keys: Sequence[str],
    current_rows: Callable[[DataFrame], DataFrame],
    target: ChangeLog,
    checkpoint: str,
    writer: str = "upsert",
    index: KeyIndex | None = None,
) -> StreamingQuery:
    """Upsert the target rows of all keys that any source brings, to the sources' present end.

    ``current_rows`` gets the batch's keys, each once, and returns the target's
    rows for them from the current tables. Keys are made distinct per batch: no
    state outlives a batch, so a key that returns is looked up again. With an
    ``index`` of the target, only its files that may hold a key of the batch are read.
    """
    stream = sources[0].select(*keys)
    for s in sources[1:]:
        stream = stream.unionByName(s.select(*keys))

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changed = changed_keys([batch], keys).dropna("any", subset=list(keys)).persist()
        try:
            if changed.isEmpty():
                return
            name = stream_writer(batch, writer)
            version, _ = target.version_for(spark, name, batch_id)
            # Written once: the upsert reads the rows several times.
            path = work_dir(spark, "upsert")
            current_rows(changed).write.parquet(path)
            rows = spark.read.parquet(path)
            if index is None:
                known = target.read(spark, end=version - 1)
            else:
                known = index.read(spark, changed, version - 1)
            written = target.append(upsert_changes(known, rows, keys), version, name, batch_id)
            if index is not None and written:
                index.add(spark, version)
        finally:
            changed.unpersist()

    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
