"""Backups and restores of many tables at once, planned from the audit table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewindle.functions.documents import flatten_files, is_batch, restart_document
from rewindle.operators.joins import join_unique
from rewindle.operators.skew import find_heavy
from rewindle.operators.versions import latest_per_key

# The layout of the audit table and its states.
AUDIT = (
    "layer string, table_schema string, table_name string, backup_status string, "
    "exception string, table_version bigint, backup_version bigint, source_info string, "
    "backup_timestamp timestamp, job_id string, table_info string"
)
SUCCESS, FAILED = "success", "failed"
TABLE = ("table_schema", "table_name")
NO_BACKUP = -1
UNAVAILABLE = "unavailable"


def from_writer_form(rows: DataFrame) -> DataFrame:
    """Audit rows in the short form of the backup job, in the layout of the audit table."""
    return rows.select(
        F.lit(None).cast("string").alias("layer"),
        F.col("schema_name").alias("table_schema"),
        "table_name",
        F.when(F.lower("status").isin("success", "sucess"), SUCCESS)
        .otherwise(FAILED)
        .alias("backup_status"),
        F.lit(None).cast("string").alias("exception"),
        F.col("backup_version").cast("bigint").alias("table_version"),
        F.col("backup_version").cast("bigint"),
        "source_info",
        F.col("timestamp").alias("backup_timestamp"),
        F.lit(None).cast("string").alias("job_id"),
        F.lit(None).cast("string").alias("table_info"),
    )


def succeeded(audit: DataFrame) -> DataFrame:
    return audit.where(F.col("backup_status") == SUCCESS)


def latest_backup(audit: DataFrame) -> DataFrame:
    """The newest table version each table has a good backup of."""
    return (
        succeeded(audit).groupBy(*TABLE).agg(F.max("table_version").alias("backed_up_version"))
    )


def backup_due(heads: DataFrame, audit: DataFrame) -> DataFrame:
    """Whether each table of ``heads`` (with ``head_version``) has changed since its backup.

    A table without a version is missing: it is due, and its backup will fail.
    """
    return heads.join(latest_backup(audit), list(TABLE), "left").select(
        *TABLE,
        "head_version",
        F.coalesce("backed_up_version", F.lit(NO_BACKUP)).alias("backed_up_version"),
        F.coalesce(
            F.coalesce("backed_up_version", F.lit(NO_BACKUP)) < F.col("head_version"), F.lit(True)
        ).alias("due"),
    )


def backup_rows(
    due: DataFrame,
    layer: str,
    job_id: str,
    at: Column,
    source_info: Column | None = None,
    table_info: Column | None = None,
    error: Column | None = None,
) -> DataFrame:
    """The audit rows of a run that backs up all tables that are due.

    ``error`` says why a table's copy failed; null where it did not.
    """
    none = F.lit(None).cast("string")
    missing = F.when(F.col("head_version").isNull(), "table not found")
    failure = missing if error is None else F.coalesce(missing, error)
    return due.where("due").select(
        F.lit(layer).alias("layer"),
        *TABLE,
        F.when(failure.isNull(), SUCCESS).otherwise(FAILED).alias("backup_status"),
        failure.alias("exception"),
        F.col("head_version").alias("table_version"),
        F.col("head_version").alias("backup_version"),
        (none if source_info is None else source_info).alias("source_info"),
        at.alias("backup_timestamp"),
        F.lit(job_id).alias("job_id"),
        (none if table_info is None else table_info).alias("table_info"),
    )


def newest_audit_row(audit: DataFrame) -> DataFrame:
    """The newest good audit row of each table version."""
    return latest_per_key(
        succeeded(audit), [*TABLE, "table_version"], ["backup_timestamp", "backup_version"]
    )


def version_available(
    requests: DataFrame, ranges: DataFrame, table: Sequence[str] = TABLE, version: str = "version"
) -> DataFrame:
    """Add ``available``: does the version lie in the table's readable range?"""
    inside = F.col(version).between(F.col("base_version"), F.col("head_version"))
    return join_unique(requests, ranges, table).select(
        *requests.columns, F.coalesce(inside, F.lit(False)).alias("available")
    )


def restore_plan(
    requests: DataFrame, audit: DataFrame, primary: DataFrame, backup: DataFrame
) -> DataFrame:
    """How to restore each requested table version: time travel, backup, or not at all.

    ``primary`` and ``backup`` give ``base_version`` and ``head_version`` per
    table. Source and table documents come from the audit row that is used.
    """
    ranges = primary.select(
        *TABLE, F.struct("base_version", "head_version").alias("__primary")
    ).join(
        backup.select(*TABLE, F.struct("base_version", "head_version").alias("__backup")),
        list(TABLE),
        "full_outer",
    )
    rows = newest_audit_row(audit).select(
        *TABLE,
        F.col("table_version").alias("version"),
        "backup_version",
        "source_info",
        "table_info",
    )
    # Very many requests may name one table; both other sides hold a key once.
    joined = join_unique(requests, rows, [*TABLE, "version"])
    joined = join_unique(joined, ranges, TABLE, heavy=find_heavy(requests, TABLE))

    def readable(version: str, span: str) -> Column:
        inside = F.col(version).between(
            F.col(f"{span}.base_version"), F.col(f"{span}.head_version")
        )
        return F.coalesce(inside, F.lit(False))

    return joined.withColumn(
        "mode",
        F.when(readable("version", "__primary"), "time_travel")
        .when(readable("backup_version", "__backup"), "backup")
        .otherwise(UNAVAILABLE),
    ).drop("__primary", "__backup")


def recorded_checkpoints(plan: DataFrame) -> DataFrame:
    """The checkpoints and batches that the used audit rows recorded, for ``usable_checkpoints``.

    Batch tables have no stream to restart, and a request that cannot be met restarts nothing.
    """
    streams = plan.where((F.col("mode") != UNAVAILABLE) & ~is_batch(F.col("table_info")))
    files = flatten_files(streams.select("request_id", "use_checkpoints", "source_info"), "source_info")
    return files.select("request_id", "cp_path", F.col("commit").cast("bigint"), "use_checkpoints")


def restart_config(plan: DataFrame, table: Column, usable: DataFrame) -> DataFrame:
    """Add ``batch``, ``resume``, ``config`` and ``reason`` to every request of a restore plan.

    ``config`` is the document to restart the table's stream with: it resumes only if ``usable``
    (one row per request) says that all recorded batches are there. Where
    there is no document, ``reason`` says why.
    """
    batch = is_batch(F.col("table_info"))
    reason = F.when(F.col("mode") == UNAVAILABLE, "no readable version").when(
        F.col("source_info").isNull(), "no recorded sources"
    )
    joined = join_unique(plan, usable.select("request_id", "resume"), ["request_id"])
    return joined.withColumns(
        {"batch": batch, "resume": F.coalesce("resume", F.lit(False)), "reason": reason}
    ).withColumn(
        "config",
        F.when(
            F.col("reason").isNull(),
            restart_document(table, F.col("source_info"), F.col("batch"), F.col("resume")),
        ),
    )
