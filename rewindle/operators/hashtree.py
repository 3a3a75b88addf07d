"""Comparing two large tables by a hash tree: only buckets whose digests differ are compared row by row.

Rows fall into buckets by their hash; a bucket's digest is the number of its rows and sums over their hashes, so it depends neither on order
nor on files, and copies count. ``FAN`` neighbouring buckets make a node of the level above. A tree is a small table that can be kept
beside a backup, so two copies are compared without reading their rows until buckets differ.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewindle.functions.columns import comparable_columns
from rewindle.operators.joins import broadcast_if_small
from rewindle.operators.merge import table_diff

FAN = 16
#: Rows a bucket is meant to hold.
ROWS = 1000
#: Levels below the root at most: 16^7 buckets.
DEEPEST = 7
_NODE = "level int, node bigint, rows bigint, a bigint, b bigint, c bigint, d bigint"
_SUMS = ("rows", "a", "b", "c", "d")


def depth_for(rows: int) -> int:
    """Levels below the root so that buckets hold about ``ROWS`` rows. Both tables need the same."""
    depth = 0
    while depth < DEEPEST and rows > ROWS * FAN**depth:
        depth += 1
    return depth


def _hash(df: DataFrame, columns: Sequence[str], seed: int) -> Column:
    # Null and where one value ends are part of what is hashed: xxhash64 skips nulls.
    values = comparable_columns(df, columns)
    return F.xxhash64(F.lit(seed), *[x for v in values for x in (v.isNull(), v)])


def _bucket(df: DataFrame, columns: Sequence[str], depth: int) -> Column:
    return F.pmod(_hash(df, columns, 0), F.lit(FAN**depth))


def _pieces(one: Column, two: Column) -> list[Column]:
    """What is summed of two hashes: 26 bits each, so that 10^11 rows of one bucket stay within 64 bits."""
    cut = lambda h, at: F.shiftrightunsigned(h, at).bitwiseAND((1 << 26) - 1)
    return [cut(h, at).alias(n) for n, (h, at) in zip(_SUMS[1:], ((one, 0), (one, 32), (two, 0), (two, 32)), strict=True)]


@dataclass(frozen=True)
class HashTree:
    """The digests of a table over some columns, as a parquet table by level."""

    path: str
    depth: int

    def read(self, spark: SparkSession, level: int) -> DataFrame:
        return spark.read.schema(_NODE).parquet(self.path).where(F.col("level") == level).drop("level")


def build(df: DataFrame, columns: Sequence[str], path: str, depth: int) -> HashTree:
    """Write the tree of ``df``: one pass and one shuffle of partial sums, then the levels above from the level below."""
    spark = df.sparkSession
    pieces = _pieces(*[_hash(df, columns, s) for s in (1, 2)])
    rows = df.select(_bucket(df, columns, depth).alias("node"), F.lit(1).cast("bigint").alias("rows"), *pieces)
    for level in range(depth, -1, -1):
        nodes = rows.groupBy("node").agg(*[F.sum(c).alias(c) for c in _SUMS])
        nodes.write.mode("overwrite").parquet(f"{path}/level={level}")
        below = spark.read.parquet(f"{path}/level={level}")
        pieces = _pieces(*[F.xxhash64(F.lit(s), "node", *_SUMS) for s in (1, 2)])
        rows = below.select(F.floor(F.col("node") / FAN).alias("node"), "rows", *pieces)
    return HashTree(path, depth)


def unequal(spark: SparkSession, left: HashTree, right: HashTree) -> DataFrame:
    """(``node``) of the buckets that differ. Goes down from the root, to the children of unequal nodes only."""
    if left.depth != right.depth:
        raise ValueError("the trees have different depths")
    among = None
    for level in range(left.depth + 1):
        sides = [t.read(spark, level) for t in (left, right)]
        if among is not None:
            within = among.select(F.col("node").alias("parent"))
            sides = [s.join(within, F.floor(s["node"] / FAN) == F.col("parent"), "left_semi") for s in sides]
        a, b = (s.select("node", F.struct(*_SUMS).alias(n)) for s, n in zip(sides, ("x", "y"), strict=True))
        among = a.join(b, "node", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("node")
        among = broadcast_if_small(among)
        if among.isEmpty():
            return among
    return among


def tree_diff(
    left: DataFrame, right: DataFrame, columns: Sequence[str], trees: tuple[HashTree, HashTree], strict: bool = True
) -> DataFrame:
    """``table_diff`` of the rows in unequal buckets: all that differ, found without shuffling the rest.

    ``trees`` are the tables' own over the same columns. Buckets whose digests agree are taken as equal (by chance: one in 2^104).
    """
    kinds = [dict(t.select(*columns).dtypes) for t in (left, right)]
    if kinds[0] != kinds[1]:
        raise ValueError("the tables' columns differ in type")
    spark = left.sparkSession
    depth = trees[0].depth
    buckets = unequal(spark, *trees)
    within = [t.withColumn("node", _bucket(t, columns, depth)).join(buckets, "node", "left_semi").select(*columns) for t in (left, right)]
    return table_diff(*within, columns, strict)


def equal(spark: SparkSession, trees: tuple[HashTree, HashTree]) -> bool:
    """Whether two tables hold the same rows, copies counted, from their roots alone."""
    roots = [t.read(spark, 0).first() for t in trees]
    return reduce(lambda a, b: a == b, roots)
