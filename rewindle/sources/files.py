"""Reading files once as they arrive, and plain table reads and writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INGEST_TIME = "processed_timestamp"
# Microseconds, which Spark's own default would cut to milliseconds.
NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def stream_path(path: str) -> str:
    """The path as a pattern that matches only itself.

    A file stream takes a folder or a pattern; with this, a table can be
    streamed whether it is one file or a folder of files. Not for partitioned
    folders: their partition columns need the plain path.
    """
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def stream_parquet(
    spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None
) -> DataFrame:
    """A parquet table as a stream of its files."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def csv_header_schema(spark: SparkSession, path: str) -> T.StructType:
    """Column names from the header, all as strings."""
    return spark.read.option("header", True).csv(path).schema


def stream_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """CSV files with header, each read once, with the time of reading."""
    reader = (
        spark.readStream.schema(schema or csv_header_schema(spark, path))
        .option("header", True)
        .option("timestampNTZFormat", NTZ_FORMAT)
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return with_time(reader.csv(path))


def with_time(df: DataFrame, column: str = INGEST_TIME) -> DataFrame:
    """Add the processing time."""
    return df.withColumn(column, F.current_timestamp())


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("timestampNTZFormat", NTZ_FORMAT).csv(path)


def append_table(df: DataFrame, path: str) -> None:
    """Append to a parquet table, which is made if it is not there."""
    df.write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a parquet table, its columns included. Never the one ``df`` reads."""
    df.write.mode("overwrite").parquet(path)


def table_type(spark: SparkSession, name: str) -> str | None:
    """Whether a catalog name is a view or which kind of table; ``None`` for a temporary view."""
    row = (
        spark.sql("DESCRIBE EXTENDED IDENTIFIER(:name)", args={"name": name})
        .where(F.col("col_name") == "Type")
        .select("data_type")
        .first()
    )
    return row.data_type if row else None


def catalog_tables(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """``table_name, table_type, properties`` of tables and views in the catalog, one row for each name.

    What the catalog says of a table is a handful of short rows, looked up name by name.
    """
    found = []
    for name in names:
        kind = table_type(spark, name)
        shown = spark.sql("SHOW TBLPROPERTIES IDENTIFIER(:name)", args={"name": name}).collect() if kind not in (None, "VIEW") else []
        found.append((name, kind, {r.key: r.value for r in shown}))
    return spark.createDataFrame(found, "table_name string, table_type string, properties map<string, string>")
