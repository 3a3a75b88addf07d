"""Finding and splitting keys that hold a large share of a table.

A window or an outer join sends all rows of a key to one task. AQE splits a
skewed partition only below some joins, never below a window, and never where
the split would cost another shuffle. So keys that are too big for one task are
found first, and treated apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key is heavy from this many rows on, whatever the size of the table: more are a burden for a task.
MIN_ROWS = 5_000_000
# Rows of a heavy key that are counted to find it.
COUNTED = 10_000
# Up to so many key hashes are broadcast: 8 bytes each.
BROADCAST_KEYS = 200_000


@dataclass(frozen=True)
class HeavyKeys:
    """The hashes of a table's heavy keys. There are at most rows / ``limit`` of them."""

    hashes: tuple[int, ...] = ()
    rows: int = 0  # rows of all heavy keys together
    limit: int = MIN_ROWS  # rows from which a key counts as heavy
    largest: int = 0  # rows of the heaviest key

    def __bool__(self) -> bool:
        return bool(self.hashes)

    @property
    def slices(self) -> int:
        """How many pieces of at most about ``limit`` rows the rows of all heavy keys make."""
        return max(2, -(-self.rows // self.limit))

    @property
    def salts(self) -> int:
        """How many pieces of at most about ``limit`` rows the heaviest key makes."""
        return max(2, -(-self.largest // self.limit))

    def __or__(self, other: HeavyKeys) -> HeavyKeys:
        return HeavyKeys(
            tuple(sorted({*self.hashes, *other.hashes})),
            self.rows + other.rows,
            min(self.limit, other.limit),
            max(self.largest, other.largest),
        )

    def frame(self, spark: SparkSession) -> DataFrame:
        """The hashes as a table, marked for broadcast while they are few."""
        rows = spark.createDataFrame(pa.table({"__heavy": pa.array(self.hashes, pa.int64())}))
        return F.broadcast(rows) if len(self.hashes) <= BROADCAST_KEYS else rows


NONE_HEAVY = HeavyKeys()


def key_hash(df: DataFrame, keys: Sequence[str]) -> Column:
    """One number per key. A collision only makes a light key travel with a heavy one."""
    parts = []
    for k in keys:
        c = F.col(k)
        if isinstance(df.select(k).schema[0].dataType, (T.FloatType, T.DoubleType)):
            c = c + F.lit(0.0)  # 0.0 and -0.0 are the same key
        parts.append(c)
    return F.xxhash64(*parts)


def find_heavy(df: DataFrame, keys: Sequence[str], min_rows: int = MIN_ROWS) -> HeavyKeys:
    """Find the heavy keys of ``df`` in one pass over its key columns.

    Runs a job. It only steers the plan: results are whole and the same
    whichever keys it names. So it counts a sample where that surely shows a
    heavy key, which then has about ``COUNTED`` rows in it. Counts are combined
    before the shuffle. The bar is the same for a table of any size, so the numbers that
    reach the driver, one per heavy key, are at most a 5 millionth of the rows.
    """
    fraction = min(1.0, COUNTED / min_rows)
    hashes = df.select(key_hash(df, keys).alias("kh"))
    if fraction < 1:
        hashes = hashes.sample(fraction, seed=1)
    counts = hashes.groupBy("kh").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.where(F.col("n") >= min_rows * fraction).toArrow()
    if not rows.num_rows:
        return NONE_HEAVY
    n = rows["n"].to_numpy()
    hashes = tuple(sorted(rows["kh"].to_pylist()))
    return HeavyKeys(hashes, round(n.sum() / fraction), min_rows, round(n.max() / fraction))


def split_heavy(
    df: DataFrame, keys: Sequence[str], heavy: HeavyKeys
) -> tuple[DataFrame, DataFrame]:
    """Rows of light keys, rows of heavy keys."""
    named = heavy.frame(df.sparkSession)
    match = key_hash(df, keys) == F.col("__heavy")
    return df.join(named, match, "left_anti"), df.join(named, match, "left_semi")


def fits(df: DataFrame, max_rows: int) -> bool:
    """Does ``df`` have at most ``max_rows`` rows? Stops counting beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows
