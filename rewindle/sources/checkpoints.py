"""What streams left in their checkpoint folders, for many checkpoints at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewindle.sources.files import path_exists

_BATCH_FILE = r"^(.*)/(commits|offsets)/(\d+)$"


def list_batches(spark: SparkSession, checkpoints: str) -> DataFrame:
    """``cp_path, kind, batch_id`` of all batch files below the folders ``checkpoints`` matches.

    Only the paths are read, not the files.
    """
    files = (
        spark.read.format("binaryFile")
        .load([f"{checkpoints}/commits", f"{checkpoints}/offsets"])
        .select("path")
    )
    return split_batch_path(files, "path").drop("path")


def split_batch_path(files: DataFrame, column: str) -> DataFrame:
    """Add ``cp_path, kind, batch_id`` and drop paths that are no batch file."""
    part = lambda i: F.regexp_extract(column, _BATCH_FILE, i)
    return files.where(F.col(column).rlike(_BATCH_FILE)).withColumns(
        {"cp_path": part(1), "kind": part(2), "batch_id": part(3).cast("bigint")}
    )


def read_offsets(spark: SparkSession, checkpoints: str) -> DataFrame:
    """``cp_path, batch_id, source_no, offset``: one row per source and batch.

    An offset file holds a format line, a line about the batch, and then one
    JSON line per source, so it is as small as the stream has sources.
    """
    files = (
        spark.read.text(f"{checkpoints}/offsets", wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("path"))
    )
    lines = split_batch_path(files, "path").select(
        "cp_path", "batch_id", F.posexplode(F.split("value", "\n")).alias("line", "offset")
    )
    return lines.where((F.col("line") >= 2) & (F.col("offset") != "")).select(
        "cp_path", "batch_id", (F.col("line") - 2).cast("bigint").alias("source_no"), "offset"
    )


def ingested_files(spark: SparkSession, checkpoints: str) -> DataFrame:
    """``path, timestamp, batchId`` of every file a file stream has taken in."""
    lines = (
        spark.read.text(f"{checkpoints}/sources/*/*")
        .where(F.col("value").startswith("{"))
        .select(F.from_json("value", "path string, timestamp bigint, batchId bigint").alias("f"))
    )
    # A compacted file repeats the entries of those before it.
    return lines.select("f.*").distinct()


def state_sizes(spark: SparkSession, checkpoints: Sequence[str]) -> DataFrame:
    """``cp_path, operator_id, operator, batch_id, keys`` of the state that each checkpoint's stateful operators keep.

    One row an operator, from Spark's own readers of state; a checkpoint without state gives none. ``batch_id`` is the batch after which the state stood so.
    """
    found = spark.createDataFrame([], "cp_path string, operator_id bigint, operator string, batch_id bigint, keys bigint")
    for path in checkpoints:
        if not path_exists(spark, f"{path}/state"):
            continue
        about = spark.read.format("state-metadata").load(path)
        for op in about.select("operatorId", "operatorName", "maxBatchId").distinct().collect():
            state = spark.read.format("statestore").option("operatorId", op.operatorId).load(path)
            said = [F.lit(path).alias("cp_path"), F.lit(op.operatorId).cast("bigint").alias("operator_id"), F.lit(op.operatorName).alias("operator")]
            found = found.unionByName(state.agg(F.count("*").alias("keys")).select(*said, F.lit(op.maxBatchId).cast("bigint").alias("batch_id"), "keys"))
    return found
