"""Backing up all tables that are due at one moment, and backing up and restoring one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewindle.operators import audit as A
from rewindle.operators.restart import checkpoint_progress
from rewindle.operators.versions import VERSION, as_of, change_feed_diff, restore_changes
from rewindle.sources.changelog import ChangeLog, clone_table, read_clone
from rewindle.sources.checkpoints import list_batches, read_offsets
from rewindle.sources.files import append_table, path_exists


@dataclass(frozen=True)
class ManagedTable:
    """A table behind a change log, and the folder of its clones."""

    schema: str
    name: str
    log: ChangeLog
    keys: tuple[str, ...]
    clones: str
    tie: tuple[str, ...] = ()


def progress_documents(progress: DataFrame) -> DataFrame:
    """The ``source_info`` document of each table's streams, from the progress of all of them.

    A list is as long as one checkpoint has sources, or one table has streams.
    """
    source = F.struct(
        F.col("source_id").alias("table_id"),
        F.coalesce("version", "position").cast("string").alias("version"),
    )
    files = progress.groupBy(*A.TABLE, "cp_path", "batch_id").agg(
        F.sort_array(F.collect_list(F.struct("source_no", source.alias("s")))).alias("sources")
    )
    file = F.struct(F.col("batch_id").cast("string").alias("commit"), "cp_path", F.col("sources.s").alias("sources"))
    return files.groupBy(*A.TABLE).agg(
        F.to_json(
            F.struct(F.lit("stream").alias("source_type"), F.sort_array(F.collect_list(file)).alias("files"))
        ).alias("source_info")
    )


def stream_progress(spark: SparkSession, tables: Sequence[tuple[ManagedTable, str | None]]) -> DataFrame:
    """The progress of the streams that fill each table; ``tables`` brings the pattern of their checkpoints."""
    empty = "table_schema string, table_name string, cp_path string, batch_id bigint, source_no bigint, position bigint, source_id string, version bigint"
    found = spark.createDataFrame([], empty)
    for table, checkpoints in tables:
        if checkpoints:
            own = checkpoint_progress(read_offsets(spark, checkpoints), list_batches(spark, checkpoints))
            named = own.withColumns({"table_schema": F.lit(table.schema), "table_name": F.lit(table.name)})
            found = found.unionByName(named)
    return found


def heads(spark: SparkSession, tables: Sequence[ManagedTable]) -> DataFrame:
    """The newest version of every table, found in one job; null for a table that is missing or empty."""
    seen = spark.createDataFrame([], "n int, version bigint")
    for n, table in enumerate(tables):
        if path_exists(spark, table.log.path):
            seen = seen.unionByName(table.log.read(spark).select(F.lit(n).alias("n"), F.col(VERSION).alias("version")))
    names = [(n, t.schema, t.name) for n, t in enumerate(tables)]
    named = spark.createDataFrame(names, "n int, table_schema string, table_name string")
    newest = seen.groupBy("n").agg(F.max("version").alias("head_version"))
    return named.join(newest, "n", "left").select(*A.TABLE, "head_version")


def run_backup(
    spark: SparkSession,
    tables: Sequence[ManagedTable],
    audit_path: str,
    job_id: str,
    layer: str = "silver",
    checkpoints: Mapping[str, str] | None = None,
    at_once: int = 8,
) -> DataFrame:
    """Clone every table that has changed since its last good backup, and record each; returns the run's audit rows.

    The versions are fixed for all tables before the first is copied, so the clones show one moment, as do the streams'
    positions in ``checkpoints`` (by table name). Copies run side by side; one that fails is recorded with its reason and
    stops no other.
    """
    by_name = {(t.schema, t.name): t for t in tables}
    audit = spark.read.schema(A.AUDIT).parquet(audit_path)
    progress = stream_progress(spark, [(t, (checkpoints or {}).get(t.name)) for t in tables])
    cut = A.backup_due(heads(spark, tables), audit).where("due").join(progress_documents(progress), list(A.TABLE), "left")
    # A row a table, as many as the caller named.
    due = cut.collect()

    def copy(row) -> str | None:
        table = by_name[row.table_schema, row.table_name]
        if row.head_version is None:
            return None
        try:
            log = table.log.read(spark, end=row.head_version)
            clone_table(as_of(log, table.keys, row.head_version, table.tie), table.clones, row.head_version)
        except Exception as error:  # whatever went wrong is what the audit row has to say
            return str(error).split("\n")[0][:500] or type(error).__name__
        return None

    with ThreadPoolExecutor(at_once) as pool:
        errors = list(pool.map(inheritable_thread_target(spark)(copy), due))
    kept = ("table_schema", "table_name", "head_version", "source_info")
    outcome = spark.createDataFrame(
        [(*[row[c] for c in kept], True, e) for row, e in zip(due, errors, strict=True)],
        "table_schema string, table_name string, head_version bigint, source_info string, due boolean, error string",
    )
    rows = A.backup_rows(outcome, layer, job_id, F.current_timestamp(), F.col("source_info"), error=F.col("error"))
    append_table(rows, audit_path)
    return spark.read.schema(A.AUDIT).parquet(audit_path).where(F.col("job_id") == job_id)


def back_up(
    spark: SparkSession,
    table: ManagedTable,
    audit_path: str,
    job_id: str,
    layer: str = "silver",
    checkpoints: str | None = None,
) -> int | None:
    """Clone the table if it has changed since its last good backup, and record it.

    Records the progress of the streams below ``checkpoints`` too. Returns the
    version that was backed up, ``None`` if nothing was due or there is no table.
    """
    head = table.log.head(spark)
    found = head >= 0
    newest = spark.createDataFrame(
        [(table.schema, table.name, head if found else None)],
        "table_schema string, table_name string, head_version bigint",
    )
    audit = spark.read.schema(A.AUDIT).parquet(audit_path)
    due = A.backup_due(newest, audit)
    if due.where("due").isEmpty():
        return None
    if found:
        clone_table(as_of(table.log.read(spark, end=head), table.keys, None, table.tie), table.clones, head)
    documents = progress_documents(stream_progress(spark, [(table, checkpoints if found else None)]))
    # The due table is read off before its row is added to the audit table it came from.
    rows = A.backup_rows(
        newest.withColumn("due", F.lit(True)).join(documents, list(A.TABLE), "left"),
        layer,
        job_id,
        F.current_timestamp(),
        F.col("source_info"),
    )
    append_table(rows, audit_path)
    return head if found else None


def restore(
    spark: SparkSession, table: ManagedTable, mode: str, version: int, backup_version: int | None
) -> int:
    """Carry out one row of a restore plan; returns the new head version."""
    log = table.log.read(spark)
    if mode == "time_travel":
        changes = restore_changes(log, table.keys, version)
    elif mode == "backup":
        clone = read_clone(spark, table.clones, table.log.business, backup_version)
        changes = change_feed_diff(as_of(log, table.keys), clone, table.keys)
    else:
        raise ValueError(f"version {version} of {table.schema}.{table.name} is not available")
    new = table.log.head(spark) + 1
    table.log.append(changes, new, "restore", new)
    return table.log.head(spark)
