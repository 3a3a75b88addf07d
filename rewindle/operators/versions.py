"""Reading a change log: point in time, change feeds, history, restore.

A change log is a DataFrame of business columns plus ``_change_type``
(``insert``, ``update_preimage``, ``update_postimage``, ``delete``),
``_commit_version`` and ``_commit_timestamp``. Keys must be non-null to match
MERGE, but a null key is carried along as a key of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rewindle.functions.columns import comparable
from rewindle.operators.joins import FAIL, null_safe_join

TYPE, VERSION, TIME = "_change_type", "_commit_version", "_commit_timestamp"
SYSTEM_COLUMNS = (TYPE, VERSION, TIME)
WRITER_COLUMNS = ("_writer", "_batch_id")


def drop_system(df: DataFrame) -> DataFrame:
    """The business columns only."""
    return df.drop(*SYSTEM_COLUMNS, *WRITER_COLUMNS)


def latest_per_key(df: DataFrame, keys: Sequence[str], newest_by: Sequence[str]) -> DataFrame:
    """The row of each key that is greatest by ``newest_by``.

    Spark plans the filter on row_number as a group limit on both sides of the
    shuffle, so each map task sends one row per key however large a key is.
    """
    order = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in newest_by])
    return (
        df.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")
    )


def _not_deleted() -> Column:
    return ~F.col(TYPE).eqNullSafe("delete")


def _newest_changes(
    log: DataFrame, keys: Sequence[str], version: int | None, tie: Sequence[str]
) -> DataFrame:
    if version is not None:
        log = log.where(F.col(VERSION) <= version)
    return latest_per_key(
        log.where(~F.col(TYPE).eqNullSafe("update_preimage")), keys, [VERSION, *tie]
    )


def as_of(
    log: DataFrame, keys: Sequence[str], version: int | None = None, tie: Sequence[str] = ()
) -> DataFrame:
    """The table as it was at ``version`` (``None``: now).

    ``tie`` orders changes of one key within one version, for logs that hold
    more than one.
    """
    newest = _newest_changes(log, keys, version, tie)
    return drop_system(newest.where(_not_deleted()))


def change_feed(log: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """All changes from version ``start`` to ``end``; prunes the log's partitions."""
    log = log.where(F.col(VERSION) >= start)
    return log if end is None else log.where(F.col(VERSION) <= end)


def change_feed_initial(
    log: DataFrame, keys: Sequence[str], snapshot: int, tie: Sequence[str] = ()
) -> DataFrame:
    """A feed for a new reader: the table at ``snapshot`` as inserts, then all later changes."""
    start = _newest_changes(log, keys, snapshot, tie).where(_not_deleted())
    start = start.withColumn(TYPE, F.lit("insert")).withColumn(
        VERSION, F.lit(snapshot).cast("bigint")
    )
    return start.unionByName(change_feed(log, snapshot + 1))


def change_feed_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The changes that turn ``old`` into ``new``: insert, delete, update pre- and post-image.

    One shuffle of both sides together, none where both are already partitioned
    by the keys (as after ``as_of``). A key that repeats within a side raises.
    """
    columns = new.columns
    both = old.select(*columns, F.lit(0).alias("__side")).unionByName(
        new.select(*columns, F.lit(1).alias("__side"))
    )
    order = W.partitionBy(*keys).orderBy("__side")
    # Columns one by one: a struct of them would be shuffled beside them.
    was = [f"__old_{i}" for i in range(len(columns))]
    seen = both.select(
        *columns,
        "__side",
        *[F.lag(c).over(order).alias(w) for c, w in zip(columns, was, strict=True)],
        F.lag("__side").over(order).alias("__before"),
        F.lead("__side").over(order).alias("__after"),
    )
    kinds = {f.name: f.dataType for f in both.schema}

    def state(names: Sequence[str]) -> Column:
        return F.struct(*[comparable(F.col(n), kinds[c]).alias(c) for n, c in zip(names, columns, strict=True)])

    seen = seen.select(
        F.struct(*columns).alias("__row"),
        F.struct(*[F.col(w).alias(c) for w, c in zip(was, columns, strict=True)]).alias("__old"),
        (~state(columns).eqNullSafe(state(was))).alias("__differs"),
        "__side",
        "__before",
        "__after",
    )
    side = F.col("__side")

    def change(kind: str, image: str):
        return F.struct(F.lit(kind).alias(TYPE), F.col(image).alias("__image"))

    changes = (
        F.when(F.col("__before") == side, FAIL("a key repeats within one side of the comparison"))
        .when(side == 0, F.col("__after").isNull())
        .otherwise(F.col("__before").isNull() | F.col("__differs"))
    )
    emitted = (
        F.when(side == 0, F.array(change("delete", "__row")))
        .when(F.col("__before").isNull(), F.array(change("insert", "__row")))
        .otherwise(
            F.array(change("update_preimage", "__old"), change("update_postimage", "__row"))
        )
    )
    return (
        seen.where(changes)
        .select(F.explode(emitted).alias("__c"))
        .select("__c.__image.*", f"__c.{TYPE}")
    )


def net_changes(
    log: DataFrame,
    keys: Sequence[str],
    start: int,
    end: int | None = None,
    tie: Sequence[str] = (),
    undo: bool = False,
) -> DataFrame:
    """What changed between two versions, one net change per key; ``undo`` gives the way back.

    Only keys that the versions after ``start`` touch are compared, so the work
    beyond one scan of the log grows with the changes, not with the table.
    """
    later = change_feed(log, start + 1, end)
    touched = later.select(*keys).distinct()
    earlier = null_safe_join(log.where(F.col(VERSION) <= start), touched, keys, "left_semi")
    before = as_of(earlier, keys, start, tie)
    after = as_of(later, keys, end, tie)
    return change_feed_diff(after, before, keys) if undo else change_feed_diff(before, after, keys)


def restore_changes(
    log: DataFrame, keys: Sequence[str], version: int, tie: Sequence[str] = ()
) -> DataFrame:
    """The changes to append as a new version so that the table is as it was at ``version``."""
    return net_changes(log, keys, version, None, tie, undo=True)


def table_history(log: DataFrame) -> DataFrame:
    """One row per version: time and number of changes of each kind."""

    def count(kind: str):
        return F.count_if(F.col(TYPE) == kind).alias(f"{kind}s")

    return log.groupBy(VERSION).agg(
        F.max(TIME).alias(TIME),
        count("insert"),
        count("update_postimage"),
        count("delete"),
    )


def compact_log(
    log: DataFrame, keys: Sequence[str], base: int, tie: Sequence[str] = ()
) -> DataFrame:
    """The log with everything up to ``base`` folded into one snapshot version.

    Versions below ``base`` can no longer be read; write the result to a new path.
    """
    return change_feed_initial(log, keys, base, tie)


def version_range(log: DataFrame, table: Sequence[str] = ()) -> DataFrame:
    """First and last readable version, per table if the log holds several."""
    return log.groupBy(*table).agg(
        F.min(VERSION).alias("base_version"), F.max(VERSION).alias("head_version")
    )
