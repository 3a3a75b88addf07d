import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewindle.operators import audit as A
from rewindle.operators.versions import as_of, compact_log, version_range
from rewindle.plans import recovery
from rewindle.plans.recovery import ManagedTable, back_up, restore
from rewindle.sources.changelog import ChangeLog, clone_versions, read_clone
from rewindle.sources.files import append_table, stream_parquet
from rewindle.streaming.history import await_all
from rewindle.streaming.upsert import append_stream

BUSINESS = T.StructType().add("id", "integer").add("v", "string")
STATES = [[(1, "a")], [(1, "a"), (2, "b")], [(1, "c"), (2, "b")], [(1, "c"), (2, "b"), (3, "d")]]


def managed(path, log_path):
    return ManagedTable("shop", "goods", ChangeLog(log_path, BUSINESS), ("id",), f"{path}/clones")


def ranges(df):
    return df.withColumns({"table_schema": F.lit("shop"), "table_name": F.lit("goods")})


def test_back_up_lose_versions_and_restore(spark, folder, rows):
    append_table(spark.createDataFrame([], A.AUDIT), f"{folder}/audit")
    table = managed(folder, f"{folder}/log")
    table.log.create(spark)
    assert back_up(spark, table, f"{folder}/audit", "job") is None  # there is no version
    append_table(spark.range(2), f"{folder}/in")
    stream = stream_parquet(spark, f"{folder}/in", spark.range(1).schema)
    await_all([append_stream(stream, f"{folder}/out", f"{folder}/cp/one")])
    changes = [[(1, "a")], [(2, "b")], [(1, "c")], [(3, "d")]]
    for version, data in enumerate(changes):
        table.log.append(spark.createDataFrame(data, BUSINESS), version)
        if version < 2:
            done = back_up(spark, table, f"{folder}/audit", "job", checkpoints=f"{folder}/cp/*")
            assert done == version
            assert back_up(spark, table, f"{folder}/audit", "job") is None  # nothing changed
    audit = spark.read.parquet(f"{folder}/audit")
    assert rows(audit, "backup_status", "table_version") == [
        ("failed", None), ("success", 0), ("success", 1),
    ]
    document = json.loads(audit.where("table_version = 1").first().source_info)
    assert [(f["commit"], f["sources"]) for f in document["files"]] == [("0", [{"version": "0"}])]

    # Old versions go: from here on version 1 is only in the backup.
    kept = managed(folder, f"{folder}/kept")
    kept.log.create(spark).load(compact_log(table.log.read(spark), ["id"], 2))
    requests = spark.createDataFrame(
        [("shop", "goods", v) for v in (0, 1, 2, 9)],
        "table_schema string, table_name string, version bigint",
    )
    backups = clone_versions(spark, table.clones).agg(
        F.min("_source_version").alias("base_version"),
        F.max("_source_version").alias("head_version"),
    )
    plan = A.restore_plan(
        requests, audit, ranges(version_range(kept.log.read(spark))), ranges(backups)
    )
    steps = {r.version: (r.mode, r.backup_version) for r in plan.collect()}
    assert steps == {
        0: ("backup", 0), 1: ("backup", 1), 2: ("time_travel", None), 9: ("unavailable", None),
    }
    for version in (1, 2, 0):
        before = kept.log.head(spark)
        assert restore(spark, kept, steps[version][0], version, steps[version][1]) == before + 1
        assert rows(as_of(kept.log.read(spark), ["id"])) == STATES[version]
    with pytest.raises(ValueError, match="not available"):
        restore(spark, kept, *("unavailable", 9, None))


def test_all_due_tables_are_copied_as_of_one_moment_and_failures_recorded(spark, folder, rows, monkeypatch):
    append_table(spark.createDataFrame([], A.AUDIT), f"{folder}/audit")
    tables = []
    for name in ("a", "b", "c", "gone"):
        log = ChangeLog(f"{folder}/{name}", BUSINESS)
        if name != "gone":
            log.create(spark).append(spark.createDataFrame([(1, name)], BUSINESS), 0)
        tables.append(ManagedTable("shop", name, log, ("id",), f"{folder}/clones/{name}"))
    append_table(spark.range(2), f"{folder}/in")
    stream = stream_parquet(spark, f"{folder}/in", spark.range(1).schema)
    await_all([append_stream(stream, f"{folder}/out/{n}", f"{folder}/cp/{n}") for n in "12"])
    copied = recovery.clone_table

    def clone(snapshot, path, version):
        if path.endswith("/b"):
            raise OSError("disk full")
        tables[0].log.append(spark.createDataFrame([(2, "later")], BUSINESS), 1)  # while the copies run
        copied(snapshot, path, version)

    monkeypatch.setattr(recovery, "clone_table", clone)
    run = recovery.run_backup(spark, tables, f"{folder}/audit", "one", checkpoints={"a": f"{folder}/cp/*"})
    assert rows(run, "table_name", "backup_status", "exception", "table_version") == [
        ("a", "success", None, 0), ("b", "failed", "disk full", 0), ("c", "success", None, 0), ("gone", "failed", "table not found", None),
    ]
    assert rows(read_clone(spark, f"{folder}/clones/a", BUSINESS, 0)) == [(1, "a")]
    document = json.loads(run.where("table_name = 'a'").first().source_info)
    assert [(f["cp_path"][-1], f["sources"]) for f in document["files"]] == [("1", [{"version": "0"}]), ("2", [{"version": "0"}])]
    monkeypatch.setattr(recovery, "clone_table", copied)
    again = recovery.run_backup(spark, tables, f"{folder}/audit", "two")
    assert rows(again, "table_name", "backup_status", "table_version") == [("a", "success", 1), ("b", "success", 0), ("gone", "failed", None)]
    assert rows(read_clone(spark, f"{folder}/clones/a", BUSINESS, 1)) == [(1, "a"), (2, "later")]
