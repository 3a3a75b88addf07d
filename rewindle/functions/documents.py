"""JSON documents of the audit table and the restore requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The layout of stored documents.
SOURCE_INFO = (
    "source_type string, files array<struct<commit string, file_name string, cp_path string, "
    "incr_type string, sources array<struct<table string, table_id string, version string>>>>"
)
RESUME_INFO = "source_type string, files array<struct<sources array<struct<table string>>>>"
RESTART_INFO = (
    "source_type string, files array<struct<sources array<struct<table string, version string>>>>"
)
REQUEST = (
    "table_name string, table_schema string, table_catalog string, dr_table_catalog string, "
    "version string, use_checkpoints string"
)
BATCH_NOTE = "NA - run as batch table"


def parse_requests(requests: DataFrame, column: str) -> DataFrame:
    """Restore requests from their JSON: version as number, use_checkpoints as flag."""
    parsed = requests.withColumn("__r", F.from_json(column, REQUEST))
    return parsed.select(
        *[c for c in requests.columns if c != column],
        "__r.table_catalog",
        "__r.dr_table_catalog",
        "__r.table_schema",
        "__r.table_name",
        F.col("__r.version").cast("bigint").alias("version"),
        (F.lower("__r.use_checkpoints") == "true").alias("use_checkpoints"),
    )


def flatten_files(df: DataFrame, source_info: str) -> DataFrame:
    """One row per checkpointed file of a source document."""
    parsed = df.withColumn("__s", F.from_json(source_info, SOURCE_INFO)).drop(source_info)
    return (
        parsed.select("*", "__s.source_type", F.posexplode("__s.files").alias("file_no", "__f"))
        .select("*", "__f.*")
        .drop("__s", "__f")
    )


def flatten_sources(df: DataFrame, source_info: str) -> DataFrame:
    """One row per source table of each file of a source document."""
    return (
        flatten_files(df, source_info)
        .select("*", F.posexplode("sources").alias("source_no", "__t"))
        .select("*", "__t.*")
        .drop("sources", "__t")
    )


def is_batch(table_info: Column) -> Column:
    """Whether a table is rebuilt by batch jobs, so that no stream has to restart."""
    return F.coalesce(F.get_json_object(table_info, "$.batch") == "true", F.lit(False))


def restart_document(
    table: Column, source_info: Column, batch: Column, use_checkpoints: Column
) -> Column:
    """The JSON a scheduler restarts a table with: batch, resume, or from given versions.

    Parsing with a narrow schema drops the keys that the shape does not name.
    """
    narrow = lambda ddl: F.to_json(
        F.struct(table.alias("table"), F.from_json(source_info, ddl).alias("source_info"))
    )
    note = F.to_json(F.struct(table.alias("table"), F.lit(BATCH_NOTE).alias("source_info")))
    return F.when(batch, note).when(use_checkpoints, narrow(RESUME_INFO)).otherwise(
        narrow(RESTART_INFO)
    )
