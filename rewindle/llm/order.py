"""The place of each row in an order, without one task that sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rewindle.llm.common import fresh, written
from rewindle.operators.joins import broadcast_if_small, null_safe_join


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``df`` with ``pos``, a row's place in its group from 0, and ``n``, the group's rows.

    Rows are dealt into ranges by group and order (nulls first) and numbered within each range; a group's ranges are then
    counted and added up. So a group may hold any share of the rows. Null is a group. Rows that tie get different places.
    Columns called ``pos`` or ``n`` are replaced.
    """
    df = df.drop("pos", "n")
    at, part, first, size = fresh(df, "at", "part", "first", "size")
    keys = [F.asc_nulls_first(F.col(c) if isinstance(c, str) else c) for c in (*group, *order)]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = written(dealt.withColumn(at, F.monotonically_increasing_id()), "ranked").withColumn(part, F.shiftright(at, 33))
    cells = rows.groupBy(*group, part).agg(F.min(at).alias(first), F.count("*").alias(size))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum(size).over(whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = written(cells.select(*group, part, (before - F.col(first)).alias(first), F.sum(size).over(whole).alias("n")), "cells")
    placed = null_safe_join(rows, broadcast_if_small(cells), [*group, part], "inner")
    return placed.withColumn("pos", F.col(at) + F.col(first)).drop(at, part, first)
