"""Merkle manifest of a dataset: a tree a group, a tree over their roots, and proofs by checkpoint and recompute.

A leaf is the digest of a row's fields. Within a group, leaves stand in order; every three neighbours (the last run may be shorter, even one)
become the digest of their digests, level by level, until one is left: the group's subroot (a lone leaf is its own). The subroots,
in the groups' order, make one more tree; its top is the root.

Only every ``STEP``-th level is kept: as rows of at most 81 neighbours, each an aligned subtree whose levels between are made anew where they
are needed. Proofs go from the top down: a subtree takes the path of its top from the subtree above, works out its missing
levels, gives each of its nodes its siblings and the path further up, and drops the levels again. So a group may hold any share of
the rows, no task holds more of a tree than a subtree and a path, and paths of leaves are never shuffled.

Groups stand in byte order, a null group first. Within a group rows stand by the given columns, nulls first, then by digest; rows that tie in all of
them are leaves of their own, next to each other. Null fields count as ``-``; texts are read whole. A table without rows has no root and
no proofs. Columns may have any name: what the trees need is kept apart from the rows' own columns (which must be sortable: no maps).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewindle.llm.common import written
from rewindle.llm.order import ranked
from rewindle.operators.joins import broadcast_if_small

FAN = 3
#: Levels from one kept level to the next.
STEP = 4
SPAN = FAN**STEP
SLICE = 1 << 16
#: A path's step: the siblings before a node and those after it, in its run.
PATH = "array<struct<before: array<string>, after: array<string>>>"


def digest(*texts: Column) -> Column:
    """Lower-case hex SHA-256 of the texts put together."""
    return F.sha2(F.concat(*texts), 256)


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields: each as its length in bytes, a colon and its text, or ``-`` if null."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def folded(start: Column, path: Column) -> Column:
    """The root that a node's digest and its siblings lead to."""
    run = lambda at, step: digest(F.array_join(step["before"], ""), at, F.array_join(step["after"], ""))
    return F.aggregate(path, start, run)


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, left to right."""
    return F.flatten(F.transform(path, lambda step: F.concat(step["before"], step["after"])))


@dataclass(frozen=True)
class Manifest:
    """Kept levels of the groups' trees and of the tree over them, the groups, and the root.

    ``levels`` hold subtrees: (``tree``, ``at``, ``n`` nodes of the tree on that level, ``kids``: their ``pos``, ``digest`` and, for leaves, ``own`` columns).
    ``groups``: (``tree``, ``n`` leaves, ``digest``: subroot, the group's column).
    """

    levels: list[DataFrame]
    above: list[DataFrame]
    groups: DataFrame
    root: str | None


def _subtrees(nodes: DataFrame) -> DataFrame:
    """Aligned subtrees of a level's nodes (``tree``, ``pos``, ``n``, ``digest``, ``own``), at most ``SPAN`` nodes each."""
    kids = F.sort_array(F.collect_list(F.struct("pos", "digest", "own"))).alias("kids")
    return written(nodes.groupBy("tree", F.floor(F.col("pos") / SPAN).alias("at"), "n").agg(kids), "subtrees")


def _next(digests: Column) -> Column:
    """The level above: a digest for each run."""
    runs = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(digests, i * FAN + 1, FAN), "")))


def _with_levels(subtrees: DataFrame) -> DataFrame:
    """Adds ``l0`` to ``l4``, a subtree's digests by level; a tree that ends below repeats its top."""
    out = subtrees.withColumn("l0", F.transform("kids", lambda k: k["digest"]))
    for i in range(STEP):
        out = out.withColumn(f"l{i + 1}", F.when(F.col("n") > FAN**i, _next(F.col(f"l{i}"))).otherwise(F.col(f"l{i}")))
    return out


def _grown(nodes: DataFrame, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """The kept levels from the lowest up, and (``tree``, ``digest``) of the tops."""
    levels, tops = [], None
    while True:
        levels.append(_subtrees(nodes))
        done = _with_levels(levels[-1]).select("tree", "at", "n", F.get(f"l{STEP}", F.lit(0)).alias("digest"))
        ended = done.where(F.col("n") <= SPAN).select("tree", "digest")
        tops = ended if tops is None else tops.unionByName(ended)
        if largest <= SPAN:
            return levels, tops
        largest = -(-largest // SPAN)
        nodes = done.where(F.col("n") > SPAN).select(
            "tree", F.col("at").alias("pos"), F.ceil(F.col("n") / SPAN).alias("n"), "digest", F.lit(None).cast("int").alias("own")
        )


def _paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(``tree``, ``top``, ``pos``, ``digest``, ``own``, ``path``) of the lowest level's nodes.

    ``tops`` has each tree's top and the path from there on; both are handed down with the subtrees, so no join is by tree alone.
    """
    known = None
    for subtrees in reversed(levels):
        ends = subtrees.where(F.col("n") <= SPAN).select("tree", "at").join(tops, "tree").select("tree", "at", "top", F.col("path").alias("above"))
        known = ends if known is None else known.unionByName(ends)
        within = _with_levels(subtrees.join(known, ["tree", "at"]))

        def step(i: int, j: Column) -> Column:
            place = F.floor(j / FAN**i)
            start, at = F.floor(place / FAN) * FAN, place % FAN
            part = lambda first, many: F.slice(f"l{i}", first.cast("int"), many.cast("int"))
            sides = F.struct(part(start + 1, at).alias("before"), part(start + at + 2, FAN - 1 - at).alias("after"))
            return F.when(F.col("n") > FAN**i, sides)

        def with_path(kid: Column, j: Column) -> Column:
            own = F.array_compact(F.array(*[step(i, j) for i in range(STEP)]))
            return F.struct(kid["pos"].alias("pos"), kid["digest"].alias("digest"), kid["own"].alias("own"), F.concat(own, F.col("above")).alias("path"))

        found = within.select("tree", "top", F.inline(F.transform("kids", with_path)))
        if subtrees is levels[0]:
            return found
        known = written(found.select("tree", F.col("pos").alias("at"), "top", F.col("path").alias("above")), "paths")
    raise ValueError("no level")


def manifest(df: DataFrame, group: str, order: Sequence[str], column: str = "leaf") -> Manifest:
    """The manifest of rows that bring their leaf's digest in ``column``; all columns of ``df`` stay with the leaves."""
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own")
    rows = df.select(F.col(f"`{group}`").alias("group"), F.col(f"`{column}`").alias("digest"), own)
    # Written first: finding the ranges reads the rows once more, and that should be digests, not the texts behind them.
    rows = written(rows, "leaves")
    placed = ranked(rows, ["group"], [*[F.col(f"own.`{c}`") for c in order], F.col("digest")])
    first = placed.where("pos = 0").select("group", F.col("n").alias("leaves"))
    trees = written(ranked(first, [], ["group"]).select(F.col("pos").alias("tree"), "n", "leaves", "group"), "trees")
    known = trees.agg(F.max("leaves"), F.max("n")).first()
    if known[0] is None:
        return Manifest([], [], trees.withColumn("digest", F.lit(None).cast("string")), None)
    nodes = _numbered(placed, trees)
    levels, tops = _grown(nodes, known[0])
    groups = written(tops.join(trees, "tree").select("tree", "n", "leaves", "digest", "group"), "groups")
    forest = groups.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "n", "digest", F.struct("tree", "group").alias("own"))
    above, top = _grown(forest, known[1])
    return Manifest(levels, above, groups, top.first()["digest"])


def _numbered(placed: DataFrame, trees: DataFrame) -> DataFrame:
    """Leaves with their tree's number, by group and slice of ``SLICE`` places: a group of any size is spread over its slices."""
    slices = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("leaves") - 1) / SLICE)))
    keys = trees.select("tree", F.col("group").alias("_group"), slices.alias("_cut"))
    rows = placed.withColumn("_at", F.floor(F.col("pos") / SLICE))
    same = F.col("group").eqNullSafe(F.col("_group")) & (F.col("_at") == F.col("_cut"))
    return rows.join(broadcast_if_small(keys), same).select("tree", "pos", "n", "digest", "own")


def proofs(m: Manifest) -> DataFrame:
    """Of each leaf: its row's own columns in ``own``, ``leaf``, ``subroot``, ``root`` and its ``path`` to the root."""
    if m.root is None:
        raise ValueError("a table without rows has no proofs")
    spark = m.groups.sparkSession
    start = spark.range(1).select(F.lit(0).cast("long").alias("tree"), F.lit(m.root).alias("top"), F.array().cast(PATH).alias("path"))
    forest = _paths(m.above, start).select(F.col("own.tree").alias("tree"), F.col("digest").alias("top"), "path")
    found = _paths(m.levels, written(forest, "group-paths"))
    return found.select("own", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), F.lit(m.root).alias("root"), "path")
