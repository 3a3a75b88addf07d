"""A change log on disk: parquet, one folder per version, appended only.

This is a convention on plain ``DataFrame.write``, for one writer at a time. It
holds at most one change per key and version, except an event log that is only
read by sequence. Version, writer and batch are partition columns: they take no
space in the files, and looking them up reads no data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewindle.operators.versions import TIME, TYPE, VERSION, change_feed

_SYSTEM = [
    T.StructField(TYPE, T.StringType()),
    T.StructField(TIME, T.TimestampType()),
    T.StructField(VERSION, T.LongType()),
    T.StructField("_writer", T.StringType()),
    T.StructField("_batch_id", T.LongType()),
]
_FOLDERS = (VERSION, "_writer", "_batch_id")
#: A log is written once and kept; this takes the digits of keys and times well below their bytes.
CODEC = "zstd"


@dataclass(frozen=True)
class ChangeLog:
    path: str
    business: T.StructType

    @property
    def schema(self) -> T.StructType:
        """Given on every read: Spark would infer the version as int."""
        return T.StructType([*self.business.fields, *_SYSTEM])

    def create(self, spark: SparkSession) -> ChangeLog:
        """Make the folder of an empty log; an existing log is left alone."""
        empty = spark.createDataFrame([], self.schema).coalesce(1)
        empty.write.mode("append").partitionBy(*_FOLDERS).parquet(self.path)
        return self

    def read(self, spark: SparkSession, start: int = 0, end: int | None = None) -> DataFrame:
        """The changes of versions ``start`` to ``end``; other partitions are not read."""
        return change_feed(spark.read.schema(self.schema).parquet(self.path), start, end)

    def stream(
        self, spark: SparkSession, start: int = 0, max_files: int | None = None
    ) -> DataFrame:
        """The changes from ``start`` on as a stream, for tables and later versions alike."""
        reader = spark.readStream.schema(self.schema)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return change_feed(reader.parquet(self.path), start)

    def head(self, spark: SparkSession) -> int:
        """The newest version, -1 for an empty log."""
        return self.version_for(spark, "", -1)[0] - 1

    def version_for(self, spark: SparkSession, writer: str, batch_id: int) -> tuple[int, int]:
        """The version a batch writes, and how many changes the log holds.

        The version is the batch's own if it has written before, else the next.
        """
        own = (F.col("_writer") == writer) & (F.col("_batch_id") == batch_id)
        row = (
            self.read(spark)
            .agg(
                F.max(F.when(own, F.col(VERSION))).alias("own"),
                F.coalesce(F.max(VERSION), F.lit(-1)).alias("head"),
                F.count(F.lit(1)).alias("changes"),
            )
            .first()
        )
        return (row.head + 1 if row.own is None else row.own), row.changes

    def append(
        self, changes: DataFrame, version: int, writer: str = "batch", batch_id: int = 0
    ) -> int:
        """Write one version and return its number of changes.

        Writing it again replaces it, so a repeated batch changes nothing. Rows
        without ``_change_type`` are inserts; pre-images are not stored.
        """
        if not writer.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a writer's name has letters, digits, - and _ only")
        if TYPE not in changes.columns:
            changes = changes.withColumn(TYPE, F.lit("insert"))
        rows = changes.where(~F.col(TYPE).eqNullSafe("update_preimage")).select(
            *self._business(), TYPE, F.current_timestamp().alias(TIME)
        )
        written = Observation()
        # One folder, written straight: partitioned writing would sort all rows by it.
        rows = rows.observe(written, F.count(F.lit(1)).alias("rows"))
        rows.write.mode("overwrite").option("compression", CODEC).parquet(
            f"{self.path}/{VERSION}={version}/_writer={writer}/_batch_id={batch_id}"
        )
        return written.get["rows"]

    def commit(
        self, spark: SparkSession, changes: DataFrame, writer: str = "batch", batch_id: int = 0
    ) -> int:
        """Write a batch as its own or the next version, and return the version."""
        version, _ = self.version_for(spark, writer, batch_id)
        self.append(changes, version, writer, batch_id)
        return version

    def load(self, changes: DataFrame) -> None:
        """Write a feed that brings its own versions and times, such as a compacted log.

        Rebalanced by version: few files per version, and a large version is split.
        """
        rows = changes.select(
            *self._business(),
            TYPE,
            TIME,
            VERSION,
            F.lit("load").alias("_writer"),
            F.lit(0).cast("bigint").alias("_batch_id"),
        )
        rows.hint("rebalance", VERSION).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(*_FOLDERS).parquet(self.path)

    def _business(self) -> list[Column]:
        return [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.business]


def stream_writer(batch: DataFrame, name: str) -> str:
    """The writer's name with the id of the running stream.

    The id stays with the checkpoint: it survives restarts, and a stream with a
    new checkpoint, which counts its batches from 0 again, has another.
    """
    stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{name}-{stream}" if stream else name


def clone_table(snapshot: DataFrame, path: str, source_version: int) -> None:
    """A full copy of a table, filed under the version it was taken from."""
    snapshot.write.mode("overwrite").parquet(f"{path}/_source_version={source_version}")


def read_clone(
    spark: SparkSession, path: str, schema: T.StructType, source_version: int
) -> DataFrame:
    """The copy that was taken from ``source_version``."""
    tagged = T.StructType([*schema.fields, T.StructField("_source_version", T.LongType())])
    return (
        spark.read.schema(tagged)
        .parquet(path)
        .where(F.col("_source_version") == source_version)
        .drop("_source_version")
    )


def clone_versions(spark: SparkSession, path: str) -> DataFrame:
    """The versions a backup folder holds."""
    return spark.read.parquet(path).select("_source_version").distinct()
