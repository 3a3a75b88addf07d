"""The sample tables in the roles the operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewindle.sources.files import stream_parquet, stream_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a stream of its files."""
    schema = table(spark, folder, name).schema
    return stream_parquet(spark, stream_path(f"{folder}/{name}.parquet"), schema)


def event_log(events: DataFrame) -> DataFrame:
    """Events as a change log of users: the day is the version, an error deletes the user."""
    kind = (
        F.when(F.col("event_type") == "error", "delete")
        .when(F.col("event_type") == "signup", "insert")
        .otherwise("update_postimage")
    )
    return events.withColumns(
        {
            "_change_type": kind,
            "_commit_version": F.dayofmonth("ts").cast("bigint"),
            "_commit_timestamp": F.col("ts"),
        }
    )


def _contract_columns() -> list[Column]:
    status, day = F.col("o_orderstatus"), F.col("o_orderdate").cast("date")
    return [
        F.col("o_orderkey").alias("CONTRACT_ID"),
        F.col("o_orderpriority").alias("CNTRCT_SHRT_NME"),
        F.when(status == "F", "B1").when(status == "O", "B2").alias("CONTRACT_BRAND_CDE"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("CONTRACT_TYPE_CDE"),
        day.alias("OPEN_DTE"),
        F.when(status == "F", F.date_add(day, 30)).alias("CLOSE_DTE"),
        F.col("o_orderdate").alias("EXTRACT_DTTM"),
    ]


def contracts(orders: DataFrame) -> DataFrame:
    """Orders as contract extracts."""
    return orders.select(*_contract_columns())


def contract_loans(orders: DataFrame) -> DataFrame:
    """Orders as staging rows that have both contract and loan columns."""
    price = F.col("o_totalprice")
    return orders.select(
        *_contract_columns(),
        F.substring("o_orderpriority", 1, 1).alias("LOAN_TYPE_CDE"),
        F.when(price > 200000, "O1").otherwise("C1").alias("LOAN_STATUS_CDE"),
        price.cast("decimal(22,6)").alias("VALUE"),
    )


def loans(lineitem: DataFrame) -> DataFrame:
    """Order lines as loan extracts of their contract; the last three columns order ties."""
    return lineitem.select(
        F.col("l_orderkey").alias("LOAN_ID"),
        F.col("l_orderkey").alias("CONTRACT_ID"),
        F.col("l_returnflag").alias("LOAN_TYPE_CDE"),
        F.when(F.col("l_linestatus") == "O", "O1").otherwise("C1").alias("LOAN_STATUS_CDE"),
        F.col("l_extendedprice").cast("decimal(22,6)").alias("VALUE"),
        F.col("l_shipdate").alias("EXTRACT_DTTM"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )


LOAN_TIE = ("l_linenumber", "l_partkey", "l_suppkey")


def _schema_name() -> Column:
    return F.concat(F.lit("s"), F.col("user_id") % 7)


def _table_name() -> Column:
    return F.concat(F.lit("t"), F.col("user_id"))


def _day() -> Column:
    return F.dayofmonth("ts").cast("bigint")


def audit(events: DataFrame) -> DataFrame:
    """Each event as the record of one backup: the user is the table, the day its version."""
    user = F.col("user_id").cast("string")
    day = _day().cast("string")

    def source(name: str) -> Column:
        return F.struct(
            F.concat(_schema_name(), F.lit(f".{name}")).alias("table"),
            F.md5(F.concat(user, F.lit(name))).alias("table_id"),
            day.alias("version"),
        )

    def file(number: int) -> Column:
        return F.struct(
            day.alias("commit"),
            F.lit(f"file_{number}.sql").alias("file_name"),
            F.concat(F.lit("/checkpoints/u"), user, F.lit(f"/{number}")).alias("cp_path"),
            F.lit("multi").alias("incr_type"),
            F.array(source("employee"), source("employee_phone")).alias("sources"),
        )

    good = F.col("event_type").isin("purchase", "view", "click")
    return events.select(
        F.lit("silver").alias("layer"),
        _schema_name().alias("table_schema"),
        _table_name().alias("table_name"),
        F.when(good, "success").otherwise("failed").alias("backup_status"),
        F.when(~good, F.col("event_type")).alias("exception"),
        _day().alias("table_version"),
        F.col("event_id").alias("backup_version"),
        F.to_json(
            F.struct(F.lit("delta").alias("source_type"), F.array(file(1), file(2)).alias("files"))
        ).alias("source_info"),
        F.col("ts").alias("backup_timestamp"),
        F.concat(F.lit("job_"), F.col("event_id")).alias("job_id"),
        F.to_json(
            F.struct(
                F.lit("delta").alias("table_format"),
                (F.col("user_id") % 5 == 0).cast("string").alias("batch"),
            )
        ).alias("table_info"),
    )


def heads(events: DataFrame) -> DataFrame:
    """The newest version of each table; some tables are missing."""
    newest = events.groupBy("user_id").agg(F.max(_day()).alias("day"))
    return newest.select(
        _schema_name().alias("table_schema"),
        _table_name().alias("table_name"),
        F.when(F.col("user_id") % 11 != 0, F.col("day")).alias("head_version"),
    )


def requests(events: DataFrame) -> DataFrame:
    """Each error as the request, in JSON, to restore the user's table to that day."""
    text = lambda c: c.cast("string")
    return events.where(F.col("event_type") == "error").select(
        F.col("event_id").alias("request_id"),
        F.to_json(
            F.struct(
                _table_name().alias("table_name"),
                _schema_name().alias("table_schema"),
                F.lit("main").alias("table_catalog"),
                F.lit("dr").alias("dr_table_catalog"),
                text(_day()).alias("version"),
                F.when(F.col("event_id") % 2 == 0, "True").otherwise("false").alias(
                    "use_checkpoints"
                ),
            )
        ).alias("payload"),
    )


def primary_range(events: DataFrame) -> DataFrame:
    """Tables keep the last ten versions."""
    newest = events.groupBy("user_id").agg(F.max(_day()).alias("head_version"))
    return newest.select(
        _schema_name().alias("table_schema"),
        _table_name().alias("table_name"),
        (F.col("head_version") - 9).alias("base_version"),
        "head_version",
    )


def backup_range(events: DataFrame) -> DataFrame:
    """Backups are kept from the first purchase on."""
    span = events.groupBy("user_id").agg(
        F.min(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("base_version"),
        F.max("event_id").alias("head_version"),
    )
    return span.select(
        _schema_name().alias("table_schema"),
        _table_name().alias("table_name"),
        "base_version",
        "head_version",
    )


def batch_files(events: DataFrame) -> DataFrame:
    """Paths of checkpoint files: each user's days are batches, those with a purchase committed."""
    path = lambda kind: F.concat(
        F.lit("/checkpoints/u"), F.col("user_id"), F.lit(f"/{kind}/"), F.dayofmonth("ts")
    )
    bought = events.where(F.col("event_type") == "purchase")
    return (
        events.select(path("offsets").alias("path"))
        .union(bought.select(path("commits").alias("path")))
        .distinct()
    )


def offset_lines(events: DataFrame) -> DataFrame:
    """Offset lines: each event type of a user's day is one source of that batch."""
    kinds = ["view", "click", "error", "purchase", "signup"]
    per_source = events.groupBy("user_id", F.dayofmonth("ts").alias("day"), "event_type").agg(
        F.max("event_id").alias("n"), F.count(F.lit(1)).alias("m")
    )
    files = F.to_json(F.struct(F.col("n").alias("logOffset")))
    versions = F.to_json(
        F.struct(
            F.col("event_type").alias("reservoirId"),
            F.col("n").alias("reservoirVersion"),
            F.col("m").alias("index"),
        )
    )
    return per_source.select(
        F.concat(F.lit("/checkpoints/u"), F.col("user_id")).alias("cp_path"),
        F.col("day").cast("bigint").alias("batch_id"),
        (F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type")) - 1).alias(
            "source_no"
        ),
        F.when(F.col("event_type").isin("view", "click"), files).otherwise(versions).alias(
            "offset"
        ),
    )


def recorded_commits(events: DataFrame) -> DataFrame:
    """Two users make one restore request; each recorded the day of its last signup."""
    request = F.floor(F.col("user_id") / 2)
    return (
        events.where(F.col("event_type") == "signup")
        .groupBy("user_id")
        .agg(F.max(_day()).alias("commit"))
        .select(
            request.alias("request_id"),
            F.concat(F.lit("/checkpoints/u"), F.col("user_id")).alias("cp_path"),
            "commit",
            (request % 3 != 0).alias("use_checkpoints"),
        )
    )


def ingest_config(part: DataFrame) -> DataFrame:
    """Parts as entries of the ingest configuration."""
    size = F.col("p_size")
    return part.select(
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("target_table"),
        F.when(size % 3 != 0, F.concat("p_type", F.lit(".sql"))).alias("filename"),
        F.when(size % 4 == 0, F.col("p_brand")).alias("incr_source_table"),
        F.when(
            size % 5 != 0, F.concat(F.lit("["), "p_brand", F.lit(", "), "p_type", F.lit(",x]"))
        ).alias("multi_source_db_tbls"),
    )


def table_properties(part: DataFrame) -> DataFrame:
    """Parts as tables with properties; every other one belongs to a pipeline."""
    key = F.when(F.col("p_size") % 2 == 0, "pipelines.pipelineId").otherwise("delta.feature")
    return part.select(
        "p_partkey",
        F.create_map(
            F.lit("owner"), F.col("p_brand"), key, F.concat_ws("-", "p_type", "p_partkey")
        ).alias("properties"),
    )
