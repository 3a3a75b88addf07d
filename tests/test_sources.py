from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewindle.functions import columns as C
from rewindle.operators.restart import checkpoint_paths, checkpoint_progress, last_committed
from rewindle.plans.cleaning import final_rows
from rewindle.session import work_dir
from rewindle.sources import checkpoints as P
from rewindle.sources import files as I
from rewindle.streaming.history import await_all
from rewindle.streaming.upsert import append_stream

SCHEMA = T.StructType().add("id", "long")


def test_progress_of_real_streams(spark, folder, rows):
    """Two streams over one folder, one three batches ahead of the other; past ten batches."""
    for i in range(13):
        I.append_table(spark.range(i, i + 1).coalesce(1), f"{folder}/in")
        if i == 9:
            source = I.stream_parquet(spark, f"{folder}/in", SCHEMA, max_files=1)
            await_all([append_stream(source, f"{folder}/out/a", f"{folder}/cp/a")])
    source = I.stream_parquet(spark, f"{folder}/in", SCHEMA, max_files=1)
    union = source.union(I.stream_parquet(spark, f"{folder}/in", SCHEMA, max_files=1))
    await_all([append_stream(union, f"{folder}/out/b", f"{folder}/cp/b")])
    batches = P.list_batches(spark, f"{folder}/cp/*").withColumn(
        "cp_path", F.regexp_extract("cp_path", r"[^/]+$", 0)
    )
    # By number: 9 and 12, where names would give 9 for both.
    assert rows(last_committed(batches)) == [("a", 9), ("b", 12)]
    offsets = P.read_offsets(spark, f"{folder}/cp/*").withColumn(
        "cp_path", F.regexp_extract("cp_path", r"[^/]+$", 0)
    )
    got = checkpoint_progress(offsets, batches).drop("source_id", "version")
    assert rows(got) == [("a", 9, 0, 9), ("b", 12, 0, 12), ("b", 12, 1, 12)]
    # The log of files is compacted after some batches; each file still counts once.
    files = P.ingested_files(spark, f"{folder}/cp/a")
    assert rows(files, "batchId") == sorted([(i,) for i in range(10)], key=repr)
    assert files.select("path").distinct().count() == 10


def test_csv_keeps_microseconds(spark, folder, rows):
    df = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05.678901' AS t")
    I.write_csv(df, folder)
    out = work_dir(spark, "csv")
    stream = I.stream_csv(spark, folder, df.schema)
    await_all([append_stream(stream, out, f"{out}-cp")])
    assert rows(spark.read.parquet(out), "t") == [(datetime(2024, 1, 2, 3, 4, 5, 678901),)]


def test_replacing_a_table_replaces_its_columns(spark, folder, rows):
    I.append_table(spark.range(2), folder)
    I.append_table(spark.range(2, 3), folder)
    assert spark.read.parquet(folder).count() == 3
    I.replace_table(spark.createDataFrame([("x",)], "name string"), folder)
    assert rows(spark.read.parquet(folder)) == [("x",)]


def test_table_type(spark, folder):
    spark.range(1).createOrReplaceTempView("temporary")
    assert I.table_type(spark, "temporary") is None
    spark.sql(f"CREATE TABLE IF NOT EXISTS typed (id int) USING parquet LOCATION '{folder}'")
    try:
        assert I.table_type(spark, "typed") == "EXTERNAL"
    finally:
        spark.sql("DROP TABLE typed")


def test_surrogate_key_cuts_long_numbers(spark):
    df = spark.createDataFrame([(7,), (1234567890,), (1234567891,)], "id bigint")
    keys = [r[0] for r in df.select(C.surrogate_key(F.col("id"))).collect()]
    want = spark.sql("SELECT md5('AFSAF000000007'), md5('AFSAF123456789')").first()
    assert keys == [want[0], want[1], want[1]]


def test_scalar_rules(spark):
    df = spark.sql(
        "SELECT date'2024-02-01' AS d, CAST(NULL AS date) AS n, '[a, b,c]' AS l, "
        "CAST(NULL AS string) AS s, map('pipelines.pipelineId', 'a-b') AS p, "
        "map('x', 'y') AS q, CAST(NULL AS map<string,string>) AS r"
    )
    c = F.col
    got = df.select(
        C.until_or_open(c("d")),
        C.until_or_open(c("n")),
        C.list_items(c("l")),
        C.code_or_unknown(c("s")),
        C.table_kind(c("p")),
        C.table_kind(c("q")),
        C.table_kind(c("r")),
        C.pipeline_id(c("p")),
        C.pipeline_id(c("q")),
        C.first_match([({"s": "a"}, "x"), ({"l": "[a, b,c]"}, "y")], "z"),
        C.first_match([], "z"),
    ).first()
    assert tuple(got) == (
        datetime(2024, 2, 1), datetime(2999, 12, 31), ["a", "b", "c"], "UNKWN",
        "dlt", "delta", "delta", "a_b", None, "y", "z",
    )


def test_checkpoint_paths(spark, rows):
    df = spark.createDataFrame(
        [("t", "f", "one", "[a, b]"), ("u", "f.sql", None, "[a,b]"), ("v", None, None, None),
         ("w", None, None, "[c]"), ("w", None, None, "[c]")],
        "target_table string, filename string, incr_source_table string, "
        "multi_source_db_tbls string",
    )
    assert rows(checkpoint_paths(df), "target_table", "checkpoints_path") == [
        ("t", "t/one"), ("t", "t/one"), ("u", "u/f.sql/a"), ("u", "u/f.sql/b"),
        ("v", "v/v.sql"), ("w", "w/w.sql/c"),
    ]


def test_final_rows(spark):
    df = spark.sql(
        "SELECT 1 AS CONTRACT_ID, date'2024-01-01' AS OPEN_DTE, CAST(NULL AS date) AS CLOSE_DTE, "
        "'B2' AS CONTRACT_BRAND_CDE, CAST(NULL AS string) AS CONTRACT_TYPE_CDE, 'n' AS "
        "CNTRCT_SHRT_NME, 'T' AS LOAN_TYPE_CDE, 'O1' AS LOAN_STATUS_CDE, "
        "CAST(1.5 AS decimal(22,6)) AS VALUE, timestamp'2024-01-01' AS __START_AT"
    )
    row = final_rows(df, "__START_AT").first()
    assert (row.CATEGORY, row.BRND_CDE, row.CONTRACT_TYPE_CDE) == ("CATEGORY 2", "B2", "UNKWN")
    assert (row.AR_CLOSE_DTE, row.DATA_SRCE_CDE, row.DATA_SGRGTN_CDE) == (
        datetime(2999, 12, 31), "AF", "AFS",
    )


def test_work_folder_is_the_shared_one(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    made = work_dir(spark, "x")
    assert made != work_dir(spark, "x")
    assert base is None or made.startswith(base.rstrip("/") + "/x-")
