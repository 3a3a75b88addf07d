"""Every operator as a query over the sample tables: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewindle.functions import columns as C
from rewindle.functions import documents as D
from rewindle.operators import audit as A
from rewindle.operators import hashtree as H
from rewindle.operators import merge as M
from rewindle.operators import restart as R
from rewindle.operators import versions as V
from rewindle.operators.scd2 import START, scd2
from rewindle.operators.skew import NONE_HEAVY
from rewindle.plans import samples as S
from rewindle.plans import consistency as B
from rewindle.plans import recovery as Y
from rewindle.plans.cleaning import FINAL_KEYS, final_rows
from rewindle.plans.medallion import Medallion
from rewindle.session import work_dir
from rewindle.sources import checkpoints as P
from rewindle.sources import files as I
from rewindle.sources.changelog import ChangeLog, read_clone
from rewindle.sources.changelog import clone_table as _clone
from rewindle.sources.evolving import EvolvingTable
from rewindle.streaming.feed import Feed
from rewindle.streaming.fenced import Fenced, FencedTable, restart
from rewindle.streaming.history import HistoryTable, await_all
from rewindle.streaming.ingest import RESCUED, EvolvingIngest
from rewindle.streaming.upsert import append_stream, distinct_stream, upsert_stream
from rewindle.streaming.view import GroupedView

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

USER, TIE = ["user_id"], ["event_id"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return S.event_log(S.table(spark, sf, "events"))


def _stored_log(spark: SparkSession, sf: str) -> ChangeLog:
    """The event log written out, one partition per version."""
    events = S.table(spark, sf, "events")
    log = ChangeLog(work_dir(spark, "event-log"), events.schema).create(spark)
    log.load(S.event_log(events).withColumn(V.TIME, F.col("ts").cast("timestamp")))
    return log


# Type-2 history


@query
def scd2_bronze(spark, sf):
    feed = S.event_log(S.table(spark, sf, "events")).withColumn(V.TYPE, F.lit("insert"))
    return scd2(feed, USER, "ts", TIE, V.SYSTEM_COLUMNS)


@query
def scd2_deletes(spark, sf):
    return scd2(_log(spark, sf), USER, "ts", TIE, V.SYSTEM_COLUMNS, deletes="close")


def _staging(spark, sf):
    shape = lambda df, n: df.withColumn("shape", F.lit(n))
    flows = M.append_flows(
        [
            shape(S.contracts(S.table(spark, sf, "orders")), 0),
            shape(S.loans(S.table(spark, sf, "lineitem")), 1),
        ]
    )
    tie = ["shape", *S.LOAN_TIE]
    return scd2(flows, ["CONTRACT_ID"], "EXTRACT_DTTM", tie, tie)


@query
def scd2_staging(spark, sf):
    return _staging(spark, sf)


@query
def scd2_final(spark, sf):
    # A stage of its own: it reads the staging history as a table.
    path = work_dir(spark, "staging")
    staging = _staging(spark, sf)
    staging.write.parquet(path)
    rows = final_rows(
        spark.read.schema(staging.schema).parquet(path), START, time_type="timestamp_ntz"
    )
    return scd2(rows, FINAL_KEYS, START, (), [START])


@query
def scd2_decimal(spark, sf):
    rows = S.loans(S.table(spark, sf, "lineitem"))
    return scd2(rows, ["LOAN_ID"], "EXTRACT_DTTM", S.LOAN_TIE, S.LOAN_TIE)


def _user_history(spark, sf, label) -> HistoryTable:
    schema = S.table(spark, sf, "events").schema
    path = work_dir(spark, label)
    return HistoryTable(path, schema, tuple(USER), "ts", tuple(TIE)).create(spark)


@query
def scd2_stream(spark, sf):
    """Events arrive in four out-of-order batches."""
    history = _user_history(spark, sf, "scd2-stream")
    arrivals = f"{history.path}/arrivals"
    events = S.table(spark, sf, "events")
    batch = F.pmod(F.xxhash64("event_id"), F.lit(4))
    events.withColumn("arrival", batch).write.partitionBy("arrival").parquet(arrivals)
    files = len(spark.read.parquet(arrivals).inputFiles())
    source = I.stream_parquet(spark, arrivals, events.schema, max_files=-(-files // 4))
    await_all([history.follow(source.select(*events.columns), f"{history.path}/checkpoint")])
    return history.current(spark)


@query
def scd2_indexed(spark, sf):
    """Events arrive in order in four parts; each reads the files of the history that may hold its users."""
    plain = _user_history(spark, sf, "scd2-indexed")
    history = replace(plain, indexed=True)
    events = S.table(spark, sf, "events")
    for number, (first, last) in enumerate(((1, 8), (9, 16), (17, 24), (25, 31))):
        history.apply(events.where(F.dayofmonth("ts").between(first, last)), "parts", number)
    return history.current(spark)


@query
def scd2_backfill(spark, sf):
    """The backup of the first days is taken in once, the later days as a stream."""
    history = _user_history(spark, sf, "scd2-backfill")
    events = S.table(spark, sf, "events")
    live = f"{history.path}/live"
    old = F.dayofmonth("ts") <= 10
    events.where(~old).write.parquet(live)
    source = I.stream_parquet(spark, live, events.schema)
    await_all([history.follow(source, f"{history.path}/checkpoint", "live")])
    history.apply(events.where(old), "backfill")
    return history.current(spark)


def _stages(spark, sf, label) -> Medallion:
    path = work_dir(spark, label)
    contracts = S.contracts(S.table(spark, sf, "orders"))
    loans = S.loans(S.table(spark, sf, "lineitem"))
    bronze = (
        HistoryTable(f"{path}/contract", contracts.schema, ("CONTRACT_ID",), "EXTRACT_DTTM"),
        HistoryTable(
            f"{path}/loan", loans.schema, ("LOAN_ID",), "EXTRACT_DTTM", S.LOAN_TIE, S.LOAN_TIE
        ),
    )
    return Medallion(path, bronze, "timestamp_ntz").create(spark)


@query
def medallion_chain(spark, sf):
    stages = _stages(spark, sf, "medallion")
    stages.run(
        spark,
        [
            S.contracts(S.stream(spark, sf, "orders")),
            S.loans(S.stream(spark, sf, "lineitem")),
        ],
    )
    return stages.final(spark).current(spark)


@query
def medallion_incremental(spark, sf):
    """The tables arrive in four parts, so ties and late rows cross the batches of every stage."""
    stages = _stages(spark, sf, "medallion-incremental")
    tables = {n: S.table(spark, sf, n) for n in ("orders", "lineitem")}
    for part in range(4):
        for name, table in tables.items():
            own = F.pmod(F.xxhash64(*table.columns), F.lit(4)) == part
            table.where(own).write.mode("append").parquet(f"{stages.path}/arrivals/{name}")
        sources = [
            I.stream_parquet(spark, f"{stages.path}/arrivals/{n}", t.schema)
            for n, t in tables.items()
        ]
        stages.run(spark, [S.contracts(sources[0]), S.loans(sources[1])])
    return stages.final(spark).current(spark)


@query
def file_ingest(spark, sf):
    """Events as CSV files, each read once, into a history."""
    history = _user_history(spark, sf, "file-ingest")
    events = S.table(spark, sf, "events")
    landing = f"{history.path}/landing"
    I.write_csv(events, landing)
    source = I.stream_csv(spark, landing, events.schema).drop(I.INGEST_TIME)
    await_all([history.follow(source, f"{history.path}/checkpoint")])
    return history.current(spark)


@query
def ingest_evolving(spark, sf):
    """Events as CSV whose amount turns from whole numbers to decimals to text, with a column that comes later and ids that do not fit."""
    path = work_dir(spark, "evolving-ingest")
    events, day = S.table(spark, sf, "events"), F.dayofmonth("ts")
    exact = F.col("value").cast("decimal(12,2)")
    signup = F.col("event_type") == "signup"
    ingest = EvolvingIngest(f"{path}/table", f"{path}/landing", {"event_id": "bigint"})
    parts = (
        (day <= 10, ["event_id", "event_type", F.floor(exact).alias("amount")]),
        (day.between(11, 20), ["event_id", "props", exact.alias("amount"), "event_type"]),
        (day > 20, [F.when(signup, F.concat(F.lit("x"), "event_id")).otherwise(F.col("event_id").cast("string")).alias("event_id"),
                    F.when(F.col("event_type") == "error", "none").otherwise(exact.cast("string")).alias("AMOUNT"), "event_type", "ts"]),
    )
    for own, columns in parts:
        events.where(own).select(*columns).write.mode("append").option("header", True).option("timestampNTZFormat", I.NTZ_FORMAT).option("escape", '"').csv(ingest.landing)
        await_all([ingest.follow(spark)])
    rows = ingest.read(spark)
    return rows.select(
        "event_id", "event_type", "amount", "props", "ts", F.col(RESCUED)["event_id"].alias("unfit_id"), F.col(I.INGEST_TIME).isNotNull().alias("stamped")
    )


# Versions and change feeds


@query
def as_of(spark, sf):
    return V.as_of(_log(spark, sf), USER, 10, TIE)


@query
def change_feed_range(spark, sf):
    return V.change_feed(_log(spark, sf), 5, 10)


@query
def change_feed_initial(spark, sf):
    return V.change_feed_initial(_log(spark, sf), USER, 5, TIE)


@query
def change_feed_stream(spark, sf):
    """The change feed of a stored log from version 5 on, read as a stream."""
    log = _stored_log(spark, sf)
    out = f"{log.path}-out"
    stream = V.drop_system(log.stream(spark, 5)).withColumn("version", F.dayofmonth("ts"))
    await_all([append_stream(stream, out, f"{log.path}-checkpoint")])
    return spark.read.parquet(out).drop("processed_time")


@query
def change_feed_diff(spark, sf):
    log = _log(spark, sf)
    return V.change_feed_diff(V.as_of(log, USER, 10, TIE), V.as_of(log, USER, 20, TIE), USER)


@query
def net_changes(spark, sf):
    return V.net_changes(_log(spark, sf), USER, 25, 28, TIE)


@query
def table_history(spark, sf):
    return V.table_history(_log(spark, sf))


@query
def compact_log(spark, sf):
    """A compacted log on disk, read at a version after its base."""
    events = S.table(spark, sf, "events")
    log = ChangeLog(work_dir(spark, "compacted"), events.schema).create(spark)
    timed = S.event_log(events).withColumn(V.TIME, F.col("ts").cast("timestamp"))
    log.load(V.compact_log(timed, USER, 12, TIE))
    return V.as_of(log.read(spark), USER, 20, TIE)


@query
def clone_table(spark, sf):
    path = work_dir(spark, "clone")
    snapshot = V.as_of(_log(spark, sf), USER, None, TIE)
    _clone(snapshot, path, 31)
    return read_clone(spark, path, snapshot.schema, 31)


@query
def clone_as_of(spark, sf):
    path = work_dir(spark, "clone")
    log = _log(spark, sf)
    for version in (10, 20):
        _clone(V.as_of(log, USER, version, TIE), path, version)
    return read_clone(spark, path, S.table(spark, sf, "events").schema, 10)


@query
def restore_version(spark, sf):
    log = _stored_log(spark, sf)
    log.append(V.restore_changes(log.read(spark), USER, 10, TIE), log.head(spark) + 1)
    return V.as_of(log.read(spark), USER, None, TIE)


@query
def overwrite_schema(spark, sf):
    """Users overwritten with a renamed, a dropped, a retyped and a new column, and read as of each version."""
    log = _log(spark, sf)
    table = EvolvingTable(work_dir(spark, "evolving"), tuple(USER))
    first = V.as_of(log, USER, 10, TIE)
    table.replace(spark, first)
    second = V.as_of(log, USER, 20, TIE).select(
        "user_id", "event_id", F.col("event_type").alias("kind"), F.col("value").cast("decimal(12,2)").alias("value"), F.dayofmonth("ts").alias("day")
    )
    table.replace(spark, second, {"kind": "event_type"})
    table.replace(spark, second.drop("day"))
    shown = lambda v: table.read(spark, v).withColumn("version", F.lit(v)).withColumn("value", F.col("value").cast("decimal(12,2)"))
    return shown(0).unionByName(shown(1), True).unionByName(shown(2), True)


@query
def table_diff(spark, sf):
    log = _log(spark, sf)
    return M.table_diff(
        V.as_of(log, USER, 10, TIE), V.as_of(log, USER, 20, TIE), ["user_id", "event_type"]
    )


@query
def table_diff_strict(spark, sf):
    line = S.table(spark, sf, "lineitem")
    orders = S.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return M.table_diff(line, orders, ["l_orderkey"], strict=True)


@query
def change_feed_follow(spark, sf):
    """A new reader of a log at version 5: its rows, then all later changes, with a stop in each phase."""
    path = work_dir(spark, "feed")
    events = S.table(spark, sf, "events")
    timed = S.event_log(events).withColumn(V.TIME, F.col("ts").cast("timestamp"))
    log = ChangeLog(f"{path}/log", events.schema).create(spark)
    log.load(timed.where(F.col(V.VERSION) <= 5))
    feed = Feed(log, tuple(USER), f"{path}/reader", tuple(TIE))
    append = lambda stream, checkpoint: append_stream(stream, f"{path}/out", checkpoint)
    feed.run(spark, append, max_files=2, batches=1)  # stops within the snapshot
    log.load(timed.where(F.col(V.VERSION).between(6, 20)))
    feed.run(spark, append, max_files=4, max_versions=6, batches=2)  # stops within the changes
    log.load(timed.where(F.col(V.VERSION) > 20))
    feed.run(spark, append)
    return spark.read.schema(feed.schema).parquet(f"{path}/out").drop(V.TIME)


@query
def backup_consistency(spark, sf):
    """Source and target cloned, both branches fed alike and then apart; what differs after each."""
    path = work_dir(spark, "consistency")
    events = S.table(spark, sf, "events")
    log = ChangeLog(f"{path}/source", events.schema).create(spark)
    day = F.dayofmonth("ts")
    main = B.Branch(Feed(log, tuple(USER), f"{path}/feed", tuple(TIE), after=-1), f"{path}/target")
    for first, last in ((1, 8), (9, 16)):
        log.commit(spark, events.where(day.between(first, last)), "days", first)
        main.update(spark)
    position = main.feed.position(spark)
    log.commit(spark, events.where(day.between(17, 24)), "days", 17)
    # The clone's source has the days that its target lacks: its stream goes on after the recorded position.
    clone = B.clone_branch(spark, main, f"{path}/clone", position)
    for branch in (main, clone):
        branch.update(spark)
    alike = B.compare(spark, main, clone, f"{path}/first")
    late = events.where(day > 24)
    log.commit(spark, late, "days", 25)
    other = late.where("event_type != 'error'").withColumn("value", F.when(F.col("event_type") == "signup", -F.col("value")).otherwise(F.col("value")))
    clone.feed.log.commit(spark, other, "days", 25)
    for branch in (main, clone):
        branch.update(spark)
    apart = B.compare(spark, main, clone, f"{path}/second")
    return alike.withColumn("stage", F.lit("alike")).unionByName(apart.withColumn("stage", F.lit("apart")))


@query
def table_diff_tree(spark, sf):
    """Two versions of the users compared by their hash trees, row by row only where buckets differ."""
    log, path = _log(spark, sf), work_dir(spark, "trees")
    columns = S.table(spark, sf, "events").columns
    sides = [V.as_of(log, USER, v, TIE) for v in (27, 28)]
    for i, side in enumerate(sides):
        side.write.parquet(f"{path}/side-{i}")
    sides = [spark.read.parquet(f"{path}/side-{i}") for i in range(2)]
    depth = H.depth_for(sides[0].count())
    trees = tuple(H.build(side, columns, f"{path}/tree-{i}", depth) for i, side in enumerate(sides))
    return H.tree_diff(*sides, columns, trees)


# Upsert and append


@query
def merge_upsert(spark, sf):
    orders = S.table(spark, sf, "orders")
    late = F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00"))
    newest = lambda df: V.latest_per_key(
        df, ["o_custkey"], ["o_orderdate", "o_orderkey"]
    )
    return M.merge_upsert(newest(orders.where(~late)), newest(orders.where(late)), ["o_custkey"])


def _changed(spark, sf):
    key = lambda t, c: S.table(spark, sf, t).select(F.col(c).alias("emp_id"))
    return M.changed_keys([key("customer", "c_custkey"), key("orders", "o_custkey")], ["emp_id"])


@query
def changed_keys(spark, sf):
    return _changed(spark, sf)


def _employees(customer):
    return customer.select(
        F.col("c_custkey").alias("emp_id"),
        F.col("c_name").alias("emp_name"),
        F.col("c_mktsegment").alias("emp_batch_no"),
    )


def _phones(orders):
    return orders.select(
        F.col("o_custkey").alias("emp_id"),
        F.concat(F.lit("04"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("phone"),
        F.col("o_orderdate").alias("extract_dttm"),
    )


@query
def changed_key_enrich(spark, sf):
    return M.enrich(
        _changed(spark, sf),
        [_employees(S.table(spark, sf, "customer")), _phones(S.table(spark, sf, "orders"))],
        ["emp_id"],
    )


@query
def stream_upsert(spark, sf):
    """Keys from both streams, each with its current customer row and its latest order."""
    customer, orders = S.table(spark, sf, "customer"), S.table(spark, sf, "orders")
    latest = _phones(V.latest_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]))
    path = work_dir(spark, "upsert")

    def current_rows(keys: DataFrame) -> DataFrame:
        # Both tables hold a key once, so none is heavy.
        return M.enrich(
            keys, [_employees(customer), latest], ["emp_id"], True, [NONE_HEAVY, NONE_HEAVY]
        )

    empty = spark.createDataFrame([], _changed(spark, sf).schema)
    shape = M.enrich(empty, [_employees(customer), latest], ["emp_id"], False, [NONE_HEAVY] * 2)
    target = ChangeLog(f"{path}/target", shape.schema).create(spark)
    sources = [
        _employees(S.stream(spark, sf, "customer")),
        _phones(S.stream(spark, sf, "orders")),
    ]
    await_all(
        [upsert_stream(sources, ["emp_id"], current_rows, target, f"{path}/checkpoint")]
    )
    return V.as_of(target.read(spark), ["emp_id"])


@query
def stream_append(spark, sf):
    path = work_dir(spark, "append")
    source = S.stream(spark, sf, "events")
    await_all([append_stream(source, f"{path}/out", f"{path}/checkpoint")])
    return spark.read.parquet(f"{path}/out").drop("processed_time")


@query
def stream_resume(spark, sf):
    """Two runs on one checkpoint; the second takes only what has come since the first."""
    path = work_dir(spark, "resume")
    events = S.table(spark, sf, "events")
    early = F.dayofmonth("ts") <= 15
    for arrived in (events.where(early), events.where(~early)):
        I.append_table(arrived, f"{path}/in")
        source = I.stream_parquet(spark, f"{path}/in", events.schema)
        await_all([append_stream(source, f"{path}/out", f"{path}/checkpoint")])
    return spark.read.parquet(f"{path}/out").drop("processed_time")


@query
def stream_distinct(spark, sf):
    """Customers with orders, each sent on once, though orders arrive in three runs of a stream."""
    path = work_dir(spark, "distinct")
    orders = S.table(spark, sf, "orders")
    for part in range(3):
        orders.where(F.pmod(F.xxhash64("o_orderkey"), F.lit(3)) == part).write.mode("append").parquet(f"{path}/in")
        source = I.stream_parquet(spark, f"{path}/in", orders.schema).select("o_custkey")
        await_all([append_stream(distinct_stream(source, ["o_custkey"]), f"{path}/out", f"{path}/checkpoint")])
    return spark.read.parquet(f"{path}/out").drop("processed_time")


@query
def append_flows(spark, sf):
    return M.append_flows(
        [
            S.contracts(S.table(spark, sf, "orders")),
            S.loans(S.table(spark, sf, "lineitem")).drop(*S.LOAN_TIE),
        ]
    )


@query
def dedupe_columns(spark, sf):
    columns = ["l_orderkey", "l_linenumber", "l_returnflag"]
    return M.dedupe(S.table(spark, sf, "lineitem").select(*columns))


# Cleaning


@query
def materialized_view(spark, sf):
    view = I.with_time(S.contracts(S.table(spark, sf, "orders")))
    return view.drop(I.INGEST_TIME)


@query
def view_over_stream(spark, sf):
    """Versions of users by kind of event, kept up to date while a stream rewrites the history they come from."""
    history = _user_history(spark, sf, "view")
    events = S.table(spark, sf, "events")
    shown = lambda rows: V.drop_system(rows).select(
        "event_type", F.col("__END_AT").isNull().alias("is_open"), F.col("value").cast("decimal(20,2)").alias("value")
    )
    groups = ("event_type", "is_open")
    view = GroupedView(history.history, tuple(history.row_keys), groups, ("value",), f"{history.path}/view", rows_of=shown)
    view.create(spark)
    early = F.col("event_id") % 3 == 0  # late events part versions that the view has counted
    for arrived in (events.where(early), events.where(~early)):
        arrived.write.mode("append").parquet(f"{history.path}/arrivals")
        source = I.stream_parquet(spark, f"{history.path}/arrivals", events.schema)
        await_all([history.follow(source, f"{history.path}/checkpoint")])
        view.refresh(spark)
    return view.read(spark)


@query
def view_of_changes(spark, sf):
    """Users by kind of event, refreshed four times while users come, change and go."""
    events = S.table(spark, sf, "events").withColumn("value", F.col("value").cast("decimal(20,2)"))
    log = ChangeLog(work_dir(spark, "view-log"), events.schema).create(spark)
    timed = S.event_log(events).withColumn(V.TIME, F.col("ts").cast("timestamp"))
    view = GroupedView(log, tuple(USER), ("event_type",), ("value", "event_id"), f"{log.path}-view", tuple(TIE)).create(spark)
    for first, last in ((0, 8), (9, 16), (17, 24), (25, 31)):
        log.load(timed.where(F.col(V.VERSION).between(first, last)))
        view.refresh(spark)
    return view.read(spark)


@query
def surrogate_key(spark, sf):
    customer = S.table(spark, sf, "customer")
    return customer.select("c_custkey", C.surrogate_key(F.col("c_custkey")).alias("ar_id"))


@query
def silver_transform(spark, sf):
    orders = S.table(spark, sf, "orders")
    return final_rows(S.contract_loans(orders), "CONTRACT_ID", time_type="timestamp_ntz")


@query
def json_field(spark, sf):
    events = S.table(spark, sf, "events")
    return events.select("event_id", C.json_field(F.col("props"), "k").alias("k"))


@query
def checkpoint_paths(spark, sf):
    return R.checkpoint_paths(S.ingest_config(S.table(spark, sf, "part")))


@query
def table_kind(spark, sf):
    tables = S.table_properties(S.table(spark, sf, "part"))
    return tables.select(
        "p_partkey",
        C.table_kind(F.col("properties")).alias("kind"),
        C.pipeline_id(F.col("properties")).alias("pipeline_id"),
    )


@query
def catalog_kind(spark, sf):
    """Tables and a view in the session's catalog: what it says they are, whether a pipeline keeps them, and their rows."""
    path = work_dir(spark, "catalog")
    tag = path.rsplit("-", 1)[1][:12]
    kept = {"plain": "'team' = 'x'", "kept": "'team' = 'x', 'pipelines.pipelineId' = 'a-1'"}
    names = {n: f"{n}_{tag}" for n in (*kept, "seen")}
    try:
        for name, properties in kept.items():
            source = "part" if name == "plain" else "supplier"
            S.table(spark, sf, source).write.parquet(f"{path}/{name}")
            spark.sql(f"CREATE TABLE {names[name]} USING parquet LOCATION '{path}/{name}' TBLPROPERTIES ({properties})")
        spark.sql(f"CREATE VIEW {names['seen']} AS SELECT * FROM {names['plain']} WHERE p_size > 10")
        found = I.catalog_tables(spark, list(names.values()))
        counts = [spark.table(full).agg(F.lit(full).alias("table_name"), F.count("*").alias("rows")) for full in names.values()]
        held = counts[0].unionByName(counts[1]).unionByName(counts[2])
        said = found.join(held, "table_name").select(
            F.regexp_extract("table_name", "^([a-z]+)", 1).alias("name"), "table_type", C.table_kind(F.col("properties")).alias("kind"),
            C.pipeline_id(F.col("properties")).alias("pipeline_id"), "rows",
        )
        said.write.parquet(f"{path}/said")  # read before the tables leave the catalog
    finally:
        spark.sql(f"DROP VIEW IF EXISTS {names['seen']}")
        for name in kept:
            spark.sql(f"DROP TABLE IF EXISTS {names[name]}")
    return spark.read.parquet(f"{path}/said")


# Audit, backup, restore


@query
def latest_backup(spark, sf):
    return A.latest_backup(S.audit(S.table(spark, sf, "events")))


@query
def backup_due(spark, sf):
    events = S.table(spark, sf, "events")
    return A.backup_due(S.heads(events), S.audit(events))


@query
def backup_audit(spark, sf):
    """The audit table after a run that backs up every table that is due."""
    events = S.table(spark, sf, "events")
    path = work_dir(spark, "audit")
    I.append_table(S.audit(events), path)
    audit = spark.read.parquet(path)
    at = F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))
    due = A.backup_due(S.heads(events), audit)
    I.append_table(A.backup_rows(due, "silver", "job_run", at), path)
    return spark.read.parquet(path)


@query
def backup_run(spark, sf):
    """All tables that are due, copied as of one moment: the audit rows with what they record, and what the clones hold."""
    path = work_dir(spark, "backup-run")
    events, orders, customer = (S.table(spark, sf, t) for t in ("events", "orders", "customer"))
    logs = {"users": _stored_log(spark, sf)}
    for name, rows in (("orders", orders), ("customers", customer)):
        logs[name] = ChangeLog(f"{path}/{name}", rows.schema).create(spark)
        logs[name].append(rows, 4)
    logs["missing"] = ChangeLog(f"{path}/nowhere", orders.schema)
    await_all([append_stream(S.stream(spark, sf, "events"), f"{path}/filled", f"{path}/checkpoints/users")])
    keys = {"users": ("user_id",), "orders": ("o_orderkey",), "customers": ("c_custkey",), "missing": ("o_orderkey",)}
    tables = [
        Y.ManagedTable("s", n, log, keys[n], f"{path}/clones/{n}", tuple(TIE) if n == "users" else ()) for n, log in logs.items()
    ]
    # Users were backed up before their last changes, customers since.
    past = [("users", "success", 12), ("customers", "success", 4), ("orders", "failed", 4)]
    before = spark.createDataFrame(past, "table_name string, backup_status string, table_version bigint")
    empty = spark.createDataFrame([], A.AUDIT)
    I.append_table(empty.unionByName(before.withColumn("table_schema", F.lit("s")), allowMissingColumns=True), f"{path}/audit")
    audit = Y.run_backup(spark, tables, f"{path}/audit", "run", checkpoints={"users": f"{path}/checkpoints/users"})
    held = None
    for name, number in (("users", "event_id"), ("orders", "o_orderkey")):
        version = logs[name].head(spark)
        rows = read_clone(spark, f"{path}/clones/{name}", logs[name].business, version)
        total = rows.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"), F.sum(number).alias("total"))
        held = total if held is None else held.unionByName(total)
    sources = D.flatten_sources(audit, "source_info").groupBy("table_name").agg(F.count("*").alias("sources"))
    named = audit.select("table_schema", "table_name", "backup_status", "exception", "table_version")
    return named.join(held, "table_name", "left").join(sources, "table_name", "left")


def _requests(spark, sf):
    return D.parse_requests(S.requests(S.table(spark, sf, "events")), "payload")


def _plan(spark, sf):
    events = S.table(spark, sf, "events")
    return A.restore_plan(
        _requests(spark, sf), S.audit(events), S.primary_range(events), S.backup_range(events)
    )


@query
def restore_plan(spark, sf):
    return _plan(spark, sf)


@query
def version_available(spark, sf):
    ranges = S.primary_range(S.table(spark, sf, "events"))
    return A.version_available(_requests(spark, sf), ranges).select(
        "request_id", "table_name", "version", "available"
    )


@query
def source_info_flat(spark, sf):
    audit = S.audit(S.table(spark, sf, "events")).select("backup_version", "source_info")
    return D.flatten_sources(audit, "source_info").withColumns(
        {"file_no": F.col("file_no").cast("bigint"), "source_no": F.col("source_no").cast("bigint")}
    )


def _file_batches(spark, sf):
    """Listings of the checkpoints that the audit rows name, two per user."""
    number = F.explode(F.array(F.lit("/1"), F.lit("/2"))).alias("n")
    listed = _batches(spark, sf).select("*", number)
    return listed.withColumn("cp_path", F.concat("cp_path", "n")).drop("n")


@query
def restart_config(spark, sf):
    """Every request's document: batch tables, tables that resume or start anew, and why there is none."""
    path = work_dir(spark, "restore-plan")
    _plan(spark, sf).write.parquet(path)
    plan = spark.read.parquet(path)
    usable = R.usable_checkpoints(A.recorded_checkpoints(plan), _file_batches(spark, sf))
    table = F.concat_ws(".", "table_catalog", "table_schema", "table_name")
    return A.restart_config(plan, table, usable).select(
        "request_id", "mode", "batch", "resume", "reason", "config"
    )


# Stream progress


def _batches(spark, sf):
    return P.split_batch_path(S.batch_files(S.table(spark, sf, "events")), "path").drop("path")


@query
def checkpoint_progress(spark, sf):
    return R.checkpoint_progress(
        S.offset_lines(S.table(spark, sf, "events")), _batches(spark, sf)
    )


@query
def stream_checkpoints(spark, sf):
    """What two streams' own checkpoints say after two runs: batches, positions, files taken in, and the keys in state."""
    path = work_dir(spark, "progress")
    rows = {"orders": S.table(spark, sf, "orders").select("o_custkey"), "events": S.table(spark, sf, "events").select("user_id")}
    for part in range(2):
        for name, table in rows.items():
            own = F.pmod(F.xxhash64(*table.columns), F.lit(2)) == part
            table.where(own).coalesce(1).write.mode("append").parquet(f"{path}/in/{name}")
            source = I.stream_parquet(spark, f"{path}/in/{name}", table.schema)
            source = distinct_stream(source, table.columns) if name == "orders" else source
            await_all([append_stream(source, f"{path}/out/{name}", f"{path}/checkpoints/{name}")])
    folders = f"{path}/checkpoints/*"
    name = F.regexp_extract("cp_path", r"([^/]+)$", 1).alias("stream")
    progress = R.checkpoint_progress(P.read_offsets(spark, folders), P.list_batches(spark, folders)).select(name, "source_no", "position")
    state = P.state_sizes(spark, [f"{path}/checkpoints/{n}" for n in rows]).select(name, "operator", "keys")
    files = [
        P.ingested_files(spark, f"{path}/checkpoints/{n}").agg(F.lit(n).alias("stream"), F.count("*").alias("files"), F.countDistinct("batchId").alias("batches"))
        for n in rows
    ]
    return progress.join(files[0].unionByName(files[1]), "stream").join(state, "stream", "left")


@query
def source_progress(spark, sf):
    return R.source_progress(S.offset_lines(S.table(spark, sf, "events")))


@query
def restart_plan(spark, sf):
    return R.restart_plan(S.recorded_commits(S.table(spark, sf, "events")), _batches(spark, sf))


@query
def restart_fenced(spark, sf):
    """Users kept by a stream, brought back to what a backup recorded, and kept by a new stream from there; the old one is fenced off."""
    path = work_dir(spark, "fenced")
    events = S.table(spark, sf, "events")
    log = ChangeLog(f"{path}/source", events.schema).create(spark)
    timed = S.event_log(events).withColumn(V.TIME, F.col("ts").cast("timestamp"))
    table = FencedTable(ChangeLog(f"{path}/users", events.schema), tuple(USER), path).create(spark)
    old, epoch = Feed(log, tuple(USER), f"{path}/old", tuple(TIE), after=-1), table.take_over(spark)
    log.load(timed.where(F.col(V.VERSION) <= 8))
    old.run(spark, table.follow(old, epoch, TIE))
    version, position = table.log.head(spark), old.position(spark)
    log.load(timed.where(F.col(V.VERSION).between(9, 20)))
    old.run(spark, table.follow(old, epoch, TIE))
    second, new = restart(spark, table, old, version, position, path)
    log.load(timed.where(F.col(V.VERSION) > 20))
    # What an old batch still writes after its check counts for nobody; a later batch is refused.
    table.log.commit(spark, events, f"e{epoch}-late", 0)
    try:
        table.write(events, epoch, "late", 1)
        raise AssertionError("the old writer was let through")
    except Fenced:
        pass
    new.run(spark, table.follow(new, second, TIE), max_versions=8)
    return table.current(spark)


@query
def ingested_files(spark, sf):
    """The files two streams over the tables took in, as their checkpoints list them, and their rows."""
    path = work_dir(spark, "ingested")
    rows = []
    for name in ("events", "orders"):
        source = S.stream(spark, sf, name)
        await_all([append_stream(source, f"{path}/out/{name}", f"{path}/checkpoints/{name}")])
        rows.append(S.table(spark, sf, name).select(F.col("_metadata.file_path").alias("path")))
    # One form of a path: some writers put more slashes after the scheme.
    plain = F.regexp_replace("path", "^([A-Za-z0-9]+):/+", "$1:/").alias("path")
    held = rows[0].unionAll(rows[1]).groupBy(plain).agg(F.count(F.lit(1)).alias("rows"))
    files = P.ingested_files(spark, f"{path}/checkpoints/*").select(plain, "batchId")
    files = files.join(held, "path", "left")
    name = F.regexp_extract("path", r"/([^/]+)\.parquet", 1).alias("name")
    return files.groupBy(name, "batchId").agg(F.sum("rows").alias("rows"))
