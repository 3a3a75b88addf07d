"""A grouped view over a table that changes, kept up to date from its change log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewindle.operators.joins import null_safe_join
from rewindle.operators.versions import TYPE, WRITER_COLUMNS, as_of, drop_system, net_changes
from rewindle.sources.changelog import ChangeLog

ROWS = "rows"
_WRITER = "view"


@dataclass(frozen=True)
class GroupedView:
    """Rows and sums by group of the table behind ``source``, itself a change log.

    A refresh takes the net changes since the version it last saw: a row that went or was replaced is counted with a minus, one that came
    with a plus, and only the groups these touch are looked up. A group without rows is deleted. So the work grows with the changes. What
    ``rows_of`` does to the table first must treat each row on its own (project, filter, derive). Sums are exact, so they are
    of whole or decimal numbers; the sum of nothing but nulls is null. Null is a group.
    """

    source: ChangeLog
    keys: tuple[str, ...]
    groups: tuple[str, ...]
    sums: tuple[str, ...]
    path: str
    tie: tuple[str, ...] = ()
    rows_of: Callable[[DataFrame], DataFrame] = drop_system

    def _shown(self, spark: SparkSession) -> T.StructType:
        return self.rows_of(spark.createDataFrame([], self.source.business)).schema

    def _fields(self, spark: SparkSession) -> list[T.StructField]:
        shown = self._shown(spark)
        fields = [shown[g] for g in self.groups] + [T.StructField(ROWS, T.LongType())]
        for c in self.sums:
            kind = shown[c].dataType
            if not isinstance(kind, (T.IntegralType, T.DecimalType)):
                raise ValueError(f"sums of {c} are not exact: cast it to a decimal")
            scale = kind.scale if isinstance(kind, T.DecimalType) else 0
            fields += [T.StructField(c, T.DecimalType(38, scale)), T.StructField(f"__n_{c}", T.LongType())]
        return fields

    def log(self, spark: SparkSession) -> ChangeLog:
        return ChangeLog(self.path, T.StructType(self._fields(spark)))

    @cached_property
    def _added(self) -> list[str]:
        return [ROWS, *[n for c in self.sums for n in (c, f"__n_{c}")]]

    def create(self, spark: SparkSession) -> GroupedView:
        self.log(spark).create(spark)
        return self

    def seen(self, spark: SparkSession) -> int:
        """The version of the source that the view shows, -1 before the first refresh."""
        row = self.log(spark).read(spark).where(F.col("_writer") == _WRITER).agg(F.max("_batch_id")).first()
        return -1 if row[0] is None else row[0]

    def refresh(self, spark: SparkSession) -> int:
        """Bring the view up to the source's present version; returns that version. Repeating a refresh changes nothing."""
        log, seen, head = self.log(spark), self.seen(spark), self.source.head(spark)
        if head <= seen:
            return seen
        changed = self._signed(self.source.read(spark, end=head).drop(*WRITER_COLUMNS), seen, head)
        kinds = {f.name: f.dataType for f in log.business}
        sign = F.col("__sign")
        parts = [F.sum(sign).cast("bigint").alias(ROWS)]
        for c in self.sums:
            parts += [F.sum(sign * F.col(c)).cast(kinds[c]).alias(c), F.coalesce(F.sum(F.when(F.col(c).isNotNull(), sign)), F.lit(0)).cast("bigint").alias(f"__n_{c}")]
        delta = changed.groupBy(*self.groups).agg(*parts)
        moved = None
        for c in self._added:
            nonzero = F.coalesce(F.col(c), F.lit(0)) != 0
            moved = nonzero if moved is None else moved | nonzero
        delta = delta.where(moved)
        version, _ = log.version_for(spark, _WRITER, head)
        old = as_of(log.read(spark, end=version - 1), self.groups)
        touched = null_safe_join(old, delta.select(*self.groups), self.groups, "left_semi")
        both = touched.withColumn("__old", F.lit(1)).unionByName(delta.withColumn("__old", F.lit(0)))
        new = both.groupBy(*self.groups).agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in self._added], F.max("__old").alias("__old"))
        kind = F.when(F.col(ROWS) == 0, "delete").when(F.col("__old") == 1, "update_postimage").otherwise("insert")
        log.append(new.withColumn(TYPE, kind).drop("__old"), version, _WRITER, head)
        return head

    def _signed(self, log: DataFrame, seen: int, head: int) -> DataFrame:
        """The rows that came (``__sign`` 1) and went (-1) between two versions of the source."""
        signed = lambda rows, sign: self.rows_of(rows).withColumn("__sign", F.lit(sign))
        if seen < 0:
            return signed(as_of(log, self.keys, head, self.tie), 1)
        changes = net_changes(log, self.keys, seen, head, self.tie)
        gone = F.col(TYPE).isin("delete", "update_preimage")
        return signed(changes.where(~gone).drop(TYPE), 1).unionByName(signed(changes.where(gone).drop(TYPE), -1))

    def read(self, spark: SparkSession) -> DataFrame:
        """The groups, their rows and sums, as of the last refresh."""
        now = as_of(self.log(spark).read(spark), self.groups)
        return now.select(*self.groups, ROWS, *[F.when(F.col(f"__n_{c}") > 0, F.col(c)).alias(c) for c in self.sums])
