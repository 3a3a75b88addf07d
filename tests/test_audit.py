import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rewindle.functions import documents as D
from rewindle.operators import audit as A
from rewindle.operators import restart as R

BATCHES = "cp_path string, kind string, batch_id bigint"
RECORDED = "request_id int, cp_path string, commit bigint, use_checkpoints boolean"


def source_info(commit="4"):
    def source(name):
        return {"table": f"main.shop.{name}", "table_id": name[::-1], "version": "12"}

    def file(n):
        return {
            "commit": commit,
            "file_name": f"load_{n}.sql",
            "cp_path": f"/cp/{n}",
            "incr_type": "multi",
            "sources": [source("person"), source("phone")],
        }

    return json.dumps({"source_type": "parquet", "files": [file(1), file(2)]})


def audit_row(table="goods", version=1, backup=None, status="success", day=1, batch="false"):
    info = json.dumps({"table_format": "parquet", "batch": batch})
    return (
        "silver", "shop", table, status, None, version, backup or version, source_info(),
        datetime(2024, 6, day), "job", info,
    )


def audit(spark, *rows):
    return spark.createDataFrame(list(rows), A.AUDIT)


def test_latest_backup_is_per_table_and_only_good_ones(spark, rows):
    df = audit(
        spark,
        audit_row(version=1),
        audit_row(version=3),
        audit_row(version=4, status="failed"),
        audit_row("other", version=9),
    )
    assert rows(A.latest_backup(df)) == [("shop", "goods", 3), ("shop", "other", 9)]


def test_backup_due(spark, rows):
    heads = spark.createDataFrame(
        [("shop", "goods", 3), ("shop", "other", 9), ("shop", "new", 0), ("shop", "lost", None)],
        "table_schema string, table_name string, head_version bigint",
    )
    df = audit(spark, audit_row(version=3), audit_row("other", version=8))
    due = A.backup_due(heads, df)
    assert rows(due.drop("table_schema")) == [
        ("goods", 3, 3, False), ("lost", None, -1, True), ("new", 0, -1, True),
        ("other", 9, 8, True),
    ]
    made = A.backup_rows(due, "silver", "run", F.lit(datetime(2024, 6, 9)))
    assert rows(made, "table_name", "backup_status", "table_version") == [
        ("lost", "failed", None), ("new", "success", 0), ("other", "success", 9),
    ]
    # After the run nothing that was found is due.
    again = A.backup_due(heads, df.unionByName(made))
    assert rows(again.where("due"), "table_name") == [("lost",)]


def test_writer_form_is_normalised(spark, rows):
    df = spark.createDataFrame(
        [("shop", "goods", "Sucess", 5, "{}", datetime(2024, 6, 1)),
         ("shop", "goods", "error", 6, "{}", datetime(2024, 6, 2))],
        "schema_name string, table_name string, status string, backup_version int, "
        "source_info string, timestamp timestamp",
    )
    got = A.from_writer_form(df)
    assert got.schema.simpleString() == audit(spark).schema.simpleString()
    assert rows(A.latest_backup(got)) == [("shop", "goods", 5)]


REQUEST = {
    "table_name": "goods", "table_schema": "shop", "table_catalog": "main",
    "dr_table_catalog": "dr", "version": "1", "use_checkpoints": "false",
}


def requests(spark, *changes):
    payloads = [(i, json.dumps({**REQUEST, **c})) for i, c in enumerate(changes)]
    df = spark.createDataFrame(payloads, "request_id int, payload string")
    return D.parse_requests(df, "payload")


def ranges(spark, *rows):
    return spark.createDataFrame(
        [("shop", *r) for r in rows],
        "table_schema string, table_name string, base_version bigint, head_version bigint",
    )


def test_request_fields(spark, rows):
    df = requests(spark, {"version": "7", "use_checkpoints": "TRUE"})
    assert rows(df) == [(0, "main", "dr", "shop", "goods", 7, True)]


def test_restore_prefers_time_travel_then_backup(spark, rows):
    df = audit(
        spark,
        *[audit_row(version=v, day=v) for v in (1, 2, 3, 4)],
        audit_row(version=2, backup=20, day=9),
        audit_row(version=2, backup=99, day=10, status="failed"),
    )
    plan = A.restore_plan(
        requests(spark, *[{"version": str(v)} for v in (1, 2, 3, 8)], {"table_name": "none"}),
        df,
        ranges(spark, ("goods", 3, 8)),
        ranges(spark, ("goods", 2, 20)),
    )
    assert rows(plan, "request_id", "mode", "backup_version") == [
        (0, "unavailable", 1),  # its backup is older than the backups kept
        (1, "backup", 20),  # the newest good row counts
        (2, "time_travel", 3),
        (3, "time_travel", None),  # no audit row is needed
        (4, "unavailable", None),
    ]


def test_version_one_of_the_audit_fixture(spark, rows):
    df = audit(spark, *[audit_row(version=v, day=v) for v in (1, 2, 3, 4)])
    plan = A.restore_plan(
        requests(spark, {}), df, ranges(spark, ("goods", 2, 4)), ranges(spark, ("goods", 1, 4))
    )
    assert rows(plan, "mode", "backup_version") == [("backup", 1)]


def test_version_available(spark, rows):
    df = requests(spark, {"version": "1"}, {"version": "5"}, {"table_name": "none"})
    got = A.version_available(df, ranges(spark, ("goods", 2, 5)))
    assert rows(got, "request_id", "available") == [(0, False), (1, True), (2, False)]


def config(spark, batch, use, committed=4):
    df = audit(spark, audit_row(batch=batch))
    plan = A.restore_plan(
        requests(spark, {"use_checkpoints": use}), df, ranges(spark), ranges(spark, ("goods", 1, 1))
    )
    table = F.concat_ws(".", "table_catalog", "table_schema", "table_name")
    there = {"commits": range(committed + 1), "offsets": range(9)}
    listed = listing(spark, {"/cp/1": there, "/cp/2": there})
    usable = R.usable_checkpoints(A.recorded_checkpoints(plan), listed)
    row = A.restart_config(plan, table, usable).first()
    assert row.resume == (batch == "false" and use == "true" and committed >= 4)
    return json.loads(row.config)


def test_restart_documents(spark):
    sources = [{"table": "main.shop.person"}, {"table": "main.shop.phone"}]
    assert config(spark, "true", "true") == {
        "table": "main.shop.goods",
        "source_info": "NA - run as batch table",
    }
    assert config(spark, "false", "true") == {
        "table": "main.shop.goods",
        "source_info": {"source_type": "parquet", "files": [{"sources": sources}] * 2},
    }
    versioned = [{**s, "version": "12"} for s in sources]
    again = {
        "table": "main.shop.goods",
        "source_info": {"source_type": "parquet", "files": [{"sources": versioned}] * 2},
    }
    assert config(spark, "false", "false") == again
    # A recorded batch is missing, so the streams cannot resume.
    assert config(spark, "false", "true", committed=3) == again


def test_requests_without_a_document_keep_their_row(spark, rows):
    plan = A.restore_plan(
        requests(spark, {"version": "1"}, {"version": "2"}, {"version": "9"}),
        audit(spark, audit_row(version=1, day=1)),
        ranges(spark, ("goods", 1, 4)),
        ranges(spark, ("goods", 1, 4)),
    )
    usable = R.usable_checkpoints(A.recorded_checkpoints(plan), listing(spark, {}))
    made = A.restart_config(plan, F.col("table_name"), usable)
    assert rows(made, "request_id", "reason", (F.col("config").isNull()).alias("none")) == [
        (0, None, False), (1, "no recorded sources", True), (2, "no readable version", True),
    ]


def test_source_documents_are_flattened(spark, rows):
    df = audit(spark, audit_row()).select("table_name", "source_info")
    files = D.flatten_files(df, "source_info")
    assert rows(files, "file_no", "commit", "cp_path") == [(0, "4", "/cp/1"), (1, "4", "/cp/2")]
    sources = D.flatten_sources(df, "source_info")
    assert rows(sources, "file_no", "source_no", "table", "version")[1] == (
        0, 1, "main.shop.phone", "12",
    )
    assert sources.count() == 4


def listing(spark, paths):
    return spark.createDataFrame(
        [(p, k, b) for p, kinds in paths.items() for k, ids in kinds.items() for b in ids], BATCHES
    )


@pytest.mark.parametrize("use", [True, False])
def test_restart_plan(spark, rows, use):
    batches = listing(
        spark,
        {
            "/cp/1": {"commits": [8, 9, 10], "offsets": [8, 9, 10, 11]},
            "/cp/2": {"commits": [1, 2], "offsets": [1, 2, 3]},
            "/cp/unused": {"commits": [1], "offsets": [1]},
        },
    )
    recorded = spark.createDataFrame(
        [(1, "/cp/1", 9, use), (2, "/cp/2", 3, use)], RECORDED
    )
    got = rows(R.restart_plan(recorded, batches).where("kind = 'offsets'"))
    if use:
        # Numbers, not names: 10 comes after 9. Batch 3 was never committed.
        assert got == [
            (1, "/cp/1", "offsets", 10, "drop"), (1, "/cp/1", "offsets", 11, "drop"),
            (1, "/cp/1", "offsets", 8, "keep"), (1, "/cp/1", "offsets", 9, "keep"),
            (2, "/cp/2", "offsets", 1, "reset"), (2, "/cp/2", "offsets", 2, "reset"),
            (2, "/cp/2", "offsets", 3, "reset"),
        ]
    else:
        assert {r[4] for r in got} == {"reset"}


def test_one_missing_batch_resets_all_files_of_a_request(spark, rows):
    batches = listing(spark, {"/cp/1": {"commits": [1], "offsets": [1]}})
    recorded = spark.createDataFrame([(1, "/cp/1", 1, True), (1, "/cp/2", 1, True)], RECORDED)
    assert rows(R.usable_checkpoints(recorded, batches)) == [(1, False)]
    assert {r[4] for r in rows(R.restart_plan(recorded, batches))} == {"reset"}


def test_versioned_source_positions(spark, rows):
    offset = json.dumps({"reservoirId": "r1", "reservoirVersion": 7, "index": 2})
    older = json.dumps({"reservoirId": "r1", "reservoirVersion": 9, "index": -1})
    offsets = spark.createDataFrame(
        [("/cp/1", 10, 0, offset), ("/cp/1", 9, 0, older), ("/cp/1", 10, 1, '{"logOffset": 4}')],
        "cp_path string, batch_id bigint, source_no bigint, offset string",
    )
    batches = listing(spark, {"/cp/1": {"commits": [9, 10], "offsets": [9, 10, 11]}})
    assert rows(R.checkpoint_progress(offsets, batches)) == [
        ("/cp/1", 10, 0, None, "r1", 9), ("/cp/1", 10, 1, 4, None, None),
    ]
    assert rows(R.source_progress(offsets)) == [("r1", 8)]
