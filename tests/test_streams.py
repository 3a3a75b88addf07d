import random
from datetime import datetime

import pytest
from brute import history
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewindle.operators.merge import changed_keys, enrich, table_diff
from rewindle.operators.scd2 import scd2
from rewindle.operators.versions import as_of, change_feed_initial
from rewindle.plans.medallion import Medallion
from rewindle.sources.changelog import ChangeLog, clone_table, read_clone
from rewindle.sources.files import append_table, stream_csv, stream_parquet
from rewindle.streaming.history import HistoryTable, await_all
from rewindle.streaming.upsert import append_stream, upsert_changes, upsert_stream

EVENT = (
    T.StructType()
    .add("key", "integer")
    .add("seq", "integer")
    .add("tie", "integer")
    .add("value", "string")
    .add("_change_type", "string")
)


def ddl(text):
    return T.StructType.fromDDL(text)


def random_events(seed, n=60):
    rng = random.Random(seed)
    rows = {}
    for _ in range(n):
        key = 0 if rng.random() < 0.4 else rng.randrange(1, 4)
        kind = rng.choice(["insert", "update_postimage", "update_postimage", "delete"])
        row = (key, rng.randrange(20), rng.randrange(5), rng.choice("ab"), kind)
        rows[row[:3]] = row
    return list(rows.values())


def history_table(spark, folder, every_seq, close):
    drop = ("tie",) if every_seq else ("tie", "seq")
    return HistoryTable(
        folder, EVENT, ("key",), "seq", ("tie",), drop, "close" if close else "ignore"
    ).create(spark)


@pytest.mark.parametrize("every_seq", [True, False])
@pytest.mark.parametrize("close", [True, False])
def test_any_split_and_order_gives_the_one_shot_history(spark, folder, rows, every_seq, close):
    events = random_events(every_seq + 2 * close)
    want = history(events, every_seq, close)
    random.Random(5).shuffle(events)
    table = history_table(spark, folder, every_seq, close)
    for i, part in enumerate((events[:5], events[5:30], events[30:])):
        table.apply(spark.createDataFrame(part, EVENT), "w", i)
    columns = ("key", "value", "__START_AT", "__END_AT")
    assert rows(table.current(spark), *columns) == want
    # A repeated batch and a repeated delivery change nothing.
    changes = table.history.read(spark).count()
    table.apply(spark.createDataFrame(events[30:], EVENT), "w", 2)
    table.apply(spark.createDataFrame(events[3:9], EVENT), "w", 3)
    assert rows(table.current(spark), *columns) == want
    assert table.history.read(spark).count() == changes


def test_an_append_in_order_touches_only_the_open_version(spark, folder, rows):
    table = history_table(spark, folder, True, False)
    old = [(1, s, 0, "a", "insert") for s in range(50)]
    table.apply(spark.createDataFrame(old, EVENT), "w", 0)
    table.apply(spark.createDataFrame([(1, 60, 0, "b", "insert")], EVENT), "w", 1)
    late = table.history.read(spark, 1).select("__START_AT", "__END_AT", "_change_type")
    assert rows(late) == [(49, 60, "update_postimage"), (60, None, "insert")]


def test_null_keys_have_a_history(spark, folder, rows):
    table = history_table(spark, folder, True, False)
    table.apply(spark.createDataFrame([(None, 1, 0, "a", "insert")], EVENT), "w", 0)
    table.apply(spark.createDataFrame([(None, 2, 0, "b", "insert")], EVENT), "w", 1)
    got = rows(table.current(spark), "key", "value", "__START_AT", "__END_AT")
    assert got == [(None, "a", 1, 2), (None, "b", 2, None)]


def test_backfill_and_live_flow_in_either_order(spark, folder, rows):
    events = random_events(11)
    results = []
    for name, flows in (("a", ("backfill", "live")), ("b", ("live", "backfill"))):
        table = history_table(spark, f"{folder}/{name}", False, False)
        parts = {"backfill": events[:25], "live": events[20:]}
        for flow in flows:
            table.apply(spark.createDataFrame(parts[flow], EVENT), flow, 0)
        results.append(rows(table.current(spark), "key", "value", "__START_AT", "__END_AT"))
    assert results[0] == results[1] == history(events, False, False)


PEOPLE = "id,name,age\n"


def test_csv_files_are_ingested_once_each(spark, folder, tmp_path, rows):
    """Two files, one after the other: five rows, then ten, all open."""
    landing = tmp_path / "landing"
    landing.mkdir()
    names = ["Ada", "Bo", "Cy", "Di", "Ed", "Flo", "Gus", "Hal", "Ida", "Jo"]
    table = None
    for n, batch in enumerate((names[:5], names[5:])):
        lines = [f"{n * 5 + i},{name},{20 + i}" for i, name in enumerate(batch, 1)]
        (landing / f"people_{n}.csv").write_text(PEOPLE + "\n".join(lines))
        source = stream_csv(spark, str(landing))
        if table is None:
            table = HistoryTable(
                folder, source.schema, ("id",), "processed_timestamp"
            ).create(spark)
        await_all([table.follow(source, f"{folder}/checkpoint")])
        current = table.current(spark)
        assert current.count() == 5 * (n + 1)
        assert current.where("__END_AT IS NOT NULL").isEmpty()
    assert rows(current.where("id IN ('1', '10')"), "id", "name", "age") == [
        ("1", "Ada", "21"), ("10", "Jo", "25"),
    ]


EMPLOYEE = "emp_id string, emp_name string, emp_batch_no string, extract_dttm timestamp"
PHONE = "emp_id string, phone string"


def test_changed_key_upsert_in_four_steps(spark, folder, rows):
    """Both sides, both sides, one side only, the other side later."""
    first, later = datetime(2024, 5, 1), datetime(2024, 5, 9)
    steps = [
        ([("E1", "Ann", "b1", first)], [("E1", "0400000001")]),
        ([("E2", "Ben", "b2", first)], [("E2", "0400000002")]),
        ([("E3", "Cat", "b3", later)], []),
        ([], [("E3", "0400000003")]),
    ]
    paths = {"employee": EMPLOYEE, "phone": PHONE}
    for name, schema in paths.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}")

    def current(name):
        return spark.read.schema(paths[name]).parquet(f"{folder}/{name}")

    def current_rows(keys):
        return enrich(keys, [current("employee"), current("phone")], ["emp_id"], True)

    schema = current_rows(spark.createDataFrame([], "emp_id string")).schema
    target = ChangeLog(f"{folder}/target", schema).create(spark)
    seen = []
    for employees, phones in steps:
        for name, data in (("employee", employees), ("phone", phones)):
            if data:
                append_table(spark.createDataFrame(data, paths[name]), f"{folder}/{name}")
        sources = [
            stream_parquet(spark, f"{folder}/{n}", ddl(s))
            for n, s in paths.items()
        ]
        query = upsert_stream(sources, ["emp_id"], current_rows, target, f"{folder}/cp")
        await_all([query])
        seen.append(rows(as_of(target.read(spark), ["emp_id"]), "emp_id", "emp_name", "phone"))
    assert [len(s) for s in seen] == [1, 2, 3, 3]
    assert seen[2][2] == ("E3", "Cat", None)
    assert seen[3] == [
        ("E1", "Ann", "0400000001"), ("E2", "Ben", "0400000002"), ("E3", "Cat", "0400000003"),
    ]
    kinds = target.read(spark).where("emp_id = 'E3'")
    assert rows(kinds, "_commit_version", "_change_type") == [
        (2, "insert"), (3, "update_postimage"),
    ]


def test_upsert_refuses_repeated_and_null_keys(spark):
    log = spark.createDataFrame([], "id int, v string, _change_type string, _commit_version bigint")
    for keys, message in (([1, 1], "repeats"), ([None], "null")):
        rows = spark.createDataFrame([(k, "a") for k in keys], "id int, v string")
        with pytest.raises(PySparkException, match=message):
            upsert_changes(log, rows, ["id"]).collect()


def test_changed_keys_work_on_streams(spark, folder):
    append_table(spark.range(3), f"{folder}/in")
    stream = stream_parquet(spark, f"{folder}/in", spark.range(1).schema)
    assert changed_keys([stream, stream], ["id"]).isStreaming


VALUES = "id int, name string, value double"


def test_backup_and_original_agree(spark, folder, rows):
    """Append in three runs; a clone of source and target continued on its own ends the same."""
    schema = ddl(VALUES)

    def run(side):
        source = stream_parquet(spark, f"{folder}/{side}_in", schema)
        await_all([append_stream(source, f"{folder}/{side}_out", f"{folder}/{side}_cp")])

    for i in range(3):
        data = [(3 * i + j, f"n{3 * i + j}", 1.5 * j) for j in range(3)]
        append_table(spark.createDataFrame(data, schema), f"{folder}/a_in")
        run("a")
    out = spark.read.parquet(f"{folder}/a_out")
    assert out.count() == 9
    append_table(spark.read.schema(schema).parquet(f"{folder}/a_in"), f"{folder}/b_in")
    run("b")
    clone_table(out, f"{folder}/backup", 3)
    columns = ["id", "name", "value"]
    for copy in (
        spark.read.parquet(f"{folder}/b_out"),
        read_clone(spark, f"{folder}/backup", out.schema, 3),
    ):
        assert table_diff(out, copy, columns, strict=True).isEmpty()


def test_chained_stages_take_updates_of_upstream_rows(spark, folder, rows):
    """Ties across batches, a row that moves to another contract, a version that goes."""
    contract = ddl(
        "CONTRACT_ID int, CNTRCT_SHRT_NME string, CONTRACT_BRAND_CDE string, "
        "CONTRACT_TYPE_CDE string, OPEN_DTE date, CLOSE_DTE date, EXTRACT_DTTM timestamp"
    )
    loan = ddl(
        "LOAN_ID int, CONTRACT_ID int, LOAN_TYPE_CDE string, LOAN_STATUS_CDE string, "
        "VALUE decimal(22,6), EXTRACT_DTTM timestamp, N int"
    )
    day = lambda n: datetime(2024, 3, n)
    contracts = [
        [(1, "one", "B1", None, day(1).date(), None, day(5))],
        [(2, "two", "B2", "T", day(1).date(), None, day(3))],
        [],
        [(1, "one", "B1", "T", day(1).date(), None, day(2))],
    ]
    loans = [
        [(12, 2, "L", "C1", None, day(4), 1)],
        [(10, 1, "L", "O1", None, day(5), 1)],  # ties with the contract row of the first part
        [(12, 1, "M", "C1", None, day(4), 2)],  # the loan of that time belongs to another contract
        [(10, 1, "N", "O1", None, day(5), 3)],
    ]

    def final(path, parts):
        bronze = (
            HistoryTable(f"{path}/contract", contract, ("CONTRACT_ID",), "EXTRACT_DTTM"),
            HistoryTable(f"{path}/loan", loan, ("LOAN_ID",), "EXTRACT_DTTM", ("N",), ("N",)),
        )
        chain = Medallion(path, bronze).create(spark)
        for part in parts:
            append_table(spark.createDataFrame([r for k in part for r in contracts[k]], contract), f"{path}/c")
            append_table(spark.createDataFrame([r for k in part for r in loans[k]], loan), f"{path}/l")
            chain.run(
                spark,
                [
                    stream_parquet(spark, f"{path}/c", contract),
                    stream_parquet(spark, f"{path}/l", loan),
                ],
            )
        return rows(chain.final(spark).current(spark))

    want = final(f"{folder}/once", [range(4)])
    assert final(f"{folder}/often", [[k] for k in range(4)]) == want
    assert len(want) == 4


def test_chained_stages_as_streams_equal_one_shot(spark, folder, rows):
    contract = ddl(
        "CONTRACT_ID int, CNTRCT_SHRT_NME string, CONTRACT_BRAND_CDE string, "
        "CONTRACT_TYPE_CDE string, OPEN_DTE date, CLOSE_DTE date, EXTRACT_DTTM timestamp"
    )
    loan = ddl(
        "LOAN_ID int, CONTRACT_ID int, LOAN_TYPE_CDE string, LOAN_STATUS_CDE string, "
        "VALUE decimal(22,6), EXTRACT_DTTM timestamp"
    )
    day = lambda n: datetime(2024, 3, n)
    opened = day(1).date()
    contracts = [
        (1, "one", "B1", None, opened, None, day(1)),
        (2, "two", "B2", "T", opened, None, day(2)),
        (1, "one", "B1", "T", opened, day(20).date(), day(9)),
    ]
    loans = [(10, 1, "L", "O1", None, day(5)), (10, 1, "L", "O1", None, day(7)),
             (11, 2, "L", "C1", None, day(2))]

    def stages(path):
        bronze = (
            HistoryTable(f"{path}/contract", contract, ("CONTRACT_ID",), "EXTRACT_DTTM"),
            HistoryTable(f"{path}/loan", loan, ("LOAN_ID",), "EXTRACT_DTTM"),
        )
        return Medallion(path, bronze).create(spark)

    def feed(path, part):
        append_table(spark.createDataFrame(contracts[part], contract), f"{path}/c")
        append_table(spark.createDataFrame(loans[part], loan), f"{path}/l")

    def run(chain):
        chain.run(
            spark,
            [
                stream_parquet(spark, f"{chain.path}/c", contract),
                stream_parquet(spark, f"{chain.path}/l", loan),
            ],
        )
        return chain.final(spark).current(spark)

    once, often = stages(f"{folder}/once"), stages(f"{folder}/often")
    feed(once.path, slice(None))
    want = rows(run(once))
    for part in (slice(0, 1), slice(1, None)):
        feed(often.path, part)
        got = rows(run(often))
    assert got == want
    # Contract 1: the contract row, two equal loan rows as one version, the closed contract.
    spans = once.final(spark).current(spark).where("CT_VALUE IS NULL").select(
        "AR_ID", "CATEGORY", "STATUS_CDE", "__START_AT", "__END_AT"
    )
    first = spark.range(1).select(F.md5(F.lit("AFSAF000000001"))).first()[0]
    assert rows(spans.where(F.col("AR_ID") == first).drop("AR_ID")) == [
        ("CATEGORY 3", "O1", day(5), day(9)), ("CATEGORY 3", None, day(1), day(5)),
        ("CATEGORY 3", None, day(9), None),
    ]


def test_change_feed_of_a_history_feeds_the_next(spark, folder):
    table = history_table(spark, folder, True, False)
    table.apply(spark.createDataFrame(random_events(3), EVENT))
    feed = change_feed_initial(table.history.read(spark), table.row_keys, 0)
    again = scd2(feed, ["key"], "__START_AT", (), ["__START_AT", "__END_AT", *feed.columns[-5:]])
    assert again.count() <= table.current(spark).count()


def test_null_sequence_is_refused_before_it_is_stored(spark, folder):
    table = history_table(spark, folder, True, False)
    with pytest.raises(PySparkException, match="holds a null"):
        table.apply(spark.createDataFrame([(1, None, 0, "a", "insert")], EVENT))
    assert table.events.head(spark) == -1


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "bigint", "string"])
def test_a_batch_reads_only_later_events(spark, folder, plan, kind):
    """The lowest sequence value of the batch is pushed down to the scan of the log."""
    source = ddl(f"key int, seq {kind}")
    table = HistoryTable(folder, source, ("key",), "seq").create(spark)
    batch = spark.sql("SELECT 1 AS key, '2024-03-31 01:30:00.123456' AS seq")
    if kind == "bigint":
        batch = batch.withColumn("seq", F.lit(7))
    batch = batch.select("key", F.col("seq").cast(kind))
    table.apply(batch)
    first, lowest = table._first(batch)
    events = table.events.read(spark).where(lowest)
    assert events.count() == 1
    assert "GreaterThanOrEqual(seq," in plan(events)


@pytest.mark.parametrize("restart", ["same", "new"])
def test_a_stream_that_starts_over_replaces_nothing(spark, folder, rows, restart):
    """With its checkpoint a stream takes only what is new; without, all again, as new versions."""
    table = history_table(spark, folder, True, False)
    for i in range(2):
        events = [(i, s, 0, "a", "insert") for s in range(3)]
        append_table(spark.createDataFrame(events, EVENT).coalesce(1), f"{folder}/in")
        source = stream_parquet(spark, f"{folder}/in", EVENT)
        checkpoint = f"{folder}/cp{i if restart == 'new' else ''}"
        # A table object of its own, as a new process would have.
        again = HistoryTable(*[getattr(table, f) for f in table.__dataclass_fields__])
        await_all([again.follow(source, checkpoint)])
    assert table.current(spark).count() == 6
    stored = table.events.read(spark).groupBy("_commit_version", "_writer").count()
    sizes = rows(stored, "_commit_version", "count")
    assert sizes == ([(0, 3), (1, 3)] if restart == "same" else [(0, 3), (1, 6)])
    writers = stored.select("_writer").distinct().count()
    assert writers == (1 if restart == "same" else 2)
