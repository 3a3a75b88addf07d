"""A change log followed from its beginning: the table as it stands, then all later changes, as one stream."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rewindle.operators.versions import TIME, TYPE, VERSION, as_of
from rewindle.sources import feed_reader
from rewindle.sources.changelog import ChangeLog

#: Rows of a snapshot's file at most, so that a batch of some files is bounded.
FILE_ROWS = 1_000_000


@dataclass(frozen=True)
class Feed:
    """One reader of a change log, with a folder of its own for its snapshot and checkpoint.

    A new reader gets the table's rows as inserts of the version it stood at, then every later version's changes, in order and
    each version whole. With ``after`` it gets the changes after that version only, such as a stream that goes
    on from a position on a clone. Both phases are bounded by batch: ``max_files`` of the snapshot, ``max_versions`` of the log.
    """

    log: ChangeLog
    keys: tuple[str, ...]
    path: str
    tie: tuple[str, ...] = ()
    after: int | None = None

    @property
    def schema(self) -> T.StructType:
        system = [T.StructField(TYPE, T.StringType()), T.StructField(TIME, T.TimestampType()), T.StructField(VERSION, T.LongType())]
        return T.StructType([*self.log.business.fields, *system])

    @property
    def checkpoint(self) -> str:
        return f"{self.path}/checkpoint"

    def begin(self, spark: SparkSession) -> int:
        """Fix the version to begin from and write its rows, once: a later call finds them.

        The small file that says so is put in its place last, so a snapshot that was cut off is made anew, before any stream has read it.
        """
        store, path = feed_reader._store(f"{self.path}/begun.json")
        if store.get_file_info(path).is_file:
            with store.open_input_stream(path) as file:
                return json.loads(file.read())["base"]
        base = self.log.head(spark) if self.after is None else self.after
        if self.after is None:
            rows = as_of(self.log.read(spark, end=base), self.keys, base, self.tie)
            made = rows.select(*self.log.business.names, F.lit("insert").alias(TYPE), F.current_timestamp().alias(TIME))
            made.write.option("maxRecordsPerFile", FILE_ROWS).mode("overwrite").parquet(f"{self.path}/snapshot")
        store.create_dir(path.rsplit("/", 1)[0])
        with store.open_output_stream(f"{path}.new") as file:
            file.write(json.dumps({"base": base}).encode())
        store.move(f"{path}.new", path)
        return base

    def _options(self, base: int, max_files: int | None, max_versions: int | None) -> dict[str, str]:
        options = {"log": self.log.path, "checkpoint": self.checkpoint, "base": str(base), "schema": self.schema.json()}
        options |= {"snapshot": f"{self.path}/snapshot"} if self.after is None else {}
        return options | {k: str(v) for k, v in (("maxFiles", max_files), ("maxVersions", max_versions)) if v}

    def stream(self, spark: SparkSession, max_files: int | None = None, max_versions: int | None = None) -> DataFrame:
        """The stream; a query on it must keep its checkpoint in ``checkpoint`` and read nothing else."""
        register_pickle_by_value(feed_reader)
        spark.dataSource.register(feed_reader.FeedSource)
        options = self._options(self.begin(spark), max_files, max_versions)
        return spark.readStream.format(feed_reader.FORMAT).options(**options).load()

    def run(
        self,
        spark: SparkSession,
        start: Callable[[DataFrame, str], StreamingQuery],
        max_files: int | None = None,
        max_versions: int | None = None,
        batches: int | None = None,
    ) -> None:
        """Run ``start(stream, checkpoint)`` until it has read what the log now holds, or for some ``batches``."""
        reader = self._reader(self.begin(spark), max_files, max_versions)
        while batches is None or batches > 0:
            if reader.latestOffset() == reader.recorded() and reader.recorded() == reader.recorded(committed=True):
                return
            start(self.stream(spark, max_files, max_versions), self.checkpoint).awaitTermination()
            batches = None if batches is None else batches - 1

    def _reader(self, base: int, max_files: int | None = None, max_versions: int | None = None) -> feed_reader.FeedReader:
        return feed_reader.FeedReader(self.schema, self._options(base, max_files, max_versions))

    def position(self, spark: SparkSession) -> int:
        """The last version that the stream has wholly taken in, as its checkpoint says; while it is in the snapshot, the version that shows."""
        return self._reader(self.begin(spark)).recorded(committed=True)["version"]
