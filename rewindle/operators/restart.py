"""Stream progress, and which batches a restore has to take back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewindle.functions.columns import checkpoint_path, list_items
from rewindle.operators.joins import join_unique


def last_committed(batches: DataFrame) -> DataFrame:
    """The newest committed batch of each checkpoint, by number."""
    return (
        batches.where(F.col("kind") == "commits")
        .groupBy("cp_path")
        .agg(F.max("batch_id").alias("batch_id"))
    )


def checkpoint_progress(offsets: DataFrame, batches: DataFrame) -> DataFrame:
    """Each source's position at the last committed batch of each checkpoint.

    ``position`` is a file source's log offset; ``source_id`` and ``version``
    are set for sources that count table versions.
    """
    field = lambda n: F.get_json_object("offset", f"$.{n}")
    last = last_committed(batches)
    return join_unique(offsets, last, ["cp_path", "batch_id"], "inner").select(
        "cp_path",
        "batch_id",
        "source_no",
        field("logOffset").cast("bigint").alias("position"),
        field("reservoirId").alias("source_id"),
        (field("reservoirVersion").cast("bigint") + field("index").cast("bigint")).alias(
            "version"
        ),
    )


def source_progress(offsets: DataFrame) -> DataFrame:
    """The last table version each versioned source has been read to, over all checkpoints."""
    field = lambda n: F.get_json_object("offset", f"$.{n}")
    return (
        offsets.select(
            field("reservoirId").alias("source_id"),
            field("reservoirVersion").cast("bigint").alias("__v"),
        )
        .where("source_id IS NOT NULL")
        .groupBy("source_id")
        .agg((F.max("__v") - 1).alias("version"))
    )


def usable_checkpoints(recorded: DataFrame, batches: DataFrame) -> DataFrame:
    """Per request: may its streams resume, i.e. are all recorded batches still there?

    A batch is there if it is listed under both commits and offsets.
    """
    present = (
        batches.groupBy("cp_path", "batch_id")
        .agg(
            F.bool_or(F.col("kind") == "commits").alias("c"),
            F.bool_or(F.col("kind") == "offsets").alias("o"),
        )
        .where("c AND o")
        .select("cp_path", F.col("batch_id").alias("commit"), F.lit(True).alias("__there"))
    )
    return (
        join_unique(recorded, present, ["cp_path", "commit"])
        .groupBy("request_id")
        .agg(
            F.bool_and(
                F.coalesce(F.col("__there"), F.lit(False))
                & F.coalesce(F.col("use_checkpoints"), F.lit(False))
            ).alias("resume")
        )
    )


def restart_plan(recorded: DataFrame, batches: DataFrame) -> DataFrame:
    """What happens to each batch file of the recorded checkpoints.

    ``recorded`` has ``request_id, cp_path, commit`` (a number) and
    ``use_checkpoints``. A request whose checkpoints are usable keeps batches up
    to the recorded one and drops later ones; any other resets its checkpoints.
    """
    decided = join_unique(recorded, usable_checkpoints(recorded, batches), ["request_id"])
    action = (
        F.when(~F.col("resume"), "reset")
        .when(F.col("batch_id") > F.col("commit"), "drop")
        .otherwise("keep")
    )
    return batches.join(
        decided.select("request_id", "cp_path", "commit", "resume"), "cp_path"
    ).select("request_id", "cp_path", "kind", "batch_id", action.alias("action"))


def checkpoint_paths(config: DataFrame) -> DataFrame:
    """The checkpoint path of each target and source, from the ingest configuration.

    ``config`` has ``target_table, filename, incr_source_table`` and
    ``multi_source_db_tbls``, a bracketed list; a target without a list keeps its row.
    """
    listed = config.withColumn(
        "multi_source_db_tbls", F.explode_outer(list_items(F.col("multi_source_db_tbls")))
    )
    path = checkpoint_path(
        F.col("target_table"),
        F.col("incr_source_table"),
        F.col("filename"),
        F.col("multi_source_db_tbls"),
    )
    return listed.withColumn("checkpoints_path", path).distinct()
