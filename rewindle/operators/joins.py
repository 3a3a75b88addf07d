"""Join helpers: null-safe keys, checked broadcasts, outer joins with heavy keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewindle.functions.columns import comparable_columns
from rewindle.operators.skew import NONE_HEAVY, HeavyKeys, find_heavy, fits, split_heavy

# A side of at most this many rows may be broadcast.
BROADCAST_ROWS = 200_000
# Equal rows of a heavy key are counted, and joined in bundles of this many.
COPIES = 1000


def FAIL(message: str) -> Column:
    """A boolean that stops the job when a row needs it."""
    return F.raise_error(F.lit(message)).cast("boolean")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join where null keys match each other; the right side's keys are dropped."""
    names = {k: f"__right_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    cond = None
    for k, r in names.items():
        pair = F.col(k).eqNullSafe(F.col(r))
        cond = pair if cond is None else cond & pair
    return left.join(right, cond, how).drop(*names.values())


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if a count proves it small, else leave the choice to Spark.

    Runs a job on ``df``: persist it first where it is costly.
    """
    return F.broadcast(df) if fits(df, max_rows) else df


def join_unique(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    heavy: HeavyKeys | None = None,
) -> DataFrame:
    """Join to a side that holds each key once, whatever share of ``left`` one key has.

    AQE splits no join whose other side comes straight from an aggregation. So
    rows of heavy keys stay where they are, and the few rows they match are
    broadcast: one per heavy key. ``heavy=None`` looks for them.
    """
    if heavy is None:
        heavy = find_heavy(left, on)
    if not heavy:
        return left.join(right, list(on), how)
    light, large = split_heavy(left, on, heavy)
    _, few = split_heavy(right, on, heavy)
    # One row per heavy key, if keys are unique as they should be: checked, as it may be broadcast.
    return light.join(right, list(on), how).unionByName(
        large.join(broadcast_if_small(few), list(on), how)
    )


def left_join_all(
    keys: DataFrame,
    tables: Sequence[DataFrame],
    on: Sequence[str],
    heavy: Sequence[HeavyKeys] | None = None,
) -> DataFrame:
    """``keys`` left joined to each table in turn, fanning out where a table repeats a key.

    ``keys`` holds each key once. The light keys take the plain chain of joins:
    one shuffle per table, none in between. A key that is heavy in some table
    cannot: an outer join's inner side is never split. Such keys are joined
    apart, the heavy keys broadcast to the tables if a count shows that they are few;
    where several tables are left, the rows are joined on key and salt.

    ``heavy`` gives the heavy keys per table; ``None`` looks for them.
    """
    if heavy is None:
        heavy = [find_heavy(t, on) for t in tables]
    all_heavy = NONE_HEAVY
    for h in heavy:
        all_heavy = all_heavy | h if all_heavy else h
    if not all_heavy:
        return _left_chain(keys, tables, on)
    light_keys, heavy_keys = split_heavy(keys, on, all_heavy)
    parts = [split_heavy(t, on, all_heavy) for t in tables]
    return _left_chain(light_keys, [light for light, _ in parts], on).unionByName(
        _salted_chain(heavy_keys, [rows for _, rows in parts], on, heavy)
    )


def _left_chain(keys: DataFrame, tables: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    for t in tables:
        keys = keys.join(t, list(on), "left")
    return keys


def _cover(keys: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``table`` for the few ``keys``, and one row of nulls for each key it lacks."""
    hits = table.join(broadcast_if_small(keys), list(on), "left_semi")
    lacking = keys.join(hits.select(*on).distinct(), list(on), "left_anti")
    return hits.unionByName(lacking, allowMissingColumns=True).select(
        *on, *[c for c in table.columns if c.lower() not in {k.lower() for k in on}]
    )


def _salted_chain(
    keys: DataFrame, tables: Sequence[DataFrame], on: Sequence[str], heavy: Sequence[HeavyKeys]
) -> DataFrame:
    # Null keys match nothing: they go past the joins.
    null_keys = keys.where(F.coalesce(*[F.when(F.col(k).isNull(), True) for k in on]))
    keys = keys.dropna("any", subset=list(on))
    result, many = None, 1
    for table, h in zip(tables, heavy, strict=True):
        rows = _cover(keys, table, on)
        own = h.salts if h else 1
        if result is None:
            result, many = rows, own
            continue
        # Every row draws a salt for its own side and is copied for each of the other's.
        left = _packed(result, "__left").withColumns(
            {"__a": _draw("__left_salt", many), "__b": _each(own)}
        )
        right = _packed(rows, "__right").withColumns(
            {"__a": _each(many), "__b": _draw("__right_salt", own)}
        )
        joined = left.join(right, [*on, "__a", "__b"])
        result = _unpacked(_unpacked(joined, "__left"), "__right").drop("__a", "__b")
        many = max(many, own)
    return result.unionByName(null_keys, allowMissingColumns=True)


def _packed(rows: DataFrame, name: str) -> DataFrame:
    """Equal rows as one row per ``COPIES`` of them, with a salt that depends on the row alone.

    So a task that runs again draws the same salts, and many copies of one row
    still spread over the salts.
    """
    n, chunk = F.col("__n"), F.col("__chunk")
    return (
        rows.groupBy(*rows.columns)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / COPIES))))
        .select(
            *rows.columns,
            F.least(F.lit(COPIES), n - chunk * COPIES).cast("int").alias(f"{name}_copies"),
            F.xxhash64(*comparable_columns(rows, rows.columns), "__chunk").alias(f"{name}_salt"),
        )
    )


def _unpacked(rows: DataFrame, name: str) -> DataFrame:
    copies = F.explode(F.array_repeat(F.lit(0), F.col(f"{name}_copies")))
    return rows.withColumn("__copy", copies).drop("__copy", f"{name}_copies", f"{name}_salt")


def _draw(salt: str, n: int) -> Column:
    return F.pmod(F.col(salt), F.lit(n)).cast("int") if n > 1 else F.lit(0)


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n > 1 else F.lit(0)
