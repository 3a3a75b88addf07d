"""Shards by a minimax contiguous partition of ordered groups that stay whole.

Rows with equal texts form a group. Groups are ordered by the SHA-256 of their text, and shards are
consecutive stretches of that order. The capacity of a shard is the smallest for which a greedy
filling needs no more shards than asked; it is found by binary search. Within it shards are kept near
equal: a cut is made near each shard's share of what is left, where the rest still fits. Only where groups are
fewer than shards do shards stay empty.

The driver holds one row for each block of the order (at most 65,536 blocks, set by the leading bits
of the hash). A step of the greedy filling looks only into the block where it ends: a small block's
boundaries come to the driver, a large block is searched by a Spark job that returns one boundary.

Nulls: a null text counts as empty; a null id is kept. Equal rows are placed one by one. A table
without rows gives none. A group larger than a fair share gets a shard that is as large. Texts
are read whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from rewindle.llm.common import dropped, written

#: Blocks aim at this many rows; a block with more groups than ``FETCH`` is searched where it lies.
BLOCK_ROWS, FETCH, HELD = 2_000, 20_000, 2_000_000
#: Capacities tried at once: one job serves a step of all of them.
TRIED = 15
#: Copies of a text are counted in chunks of at most so many (2 to this power) rows.
CHUNK_BITS = 16


class Order:
    """The groups in order: where each block begins, and the last boundary at or before a place."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        found = groups.groupBy("block").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.count("*").alias("n"), F.max("bytes").alias("top")).orderBy("block").collect()
        self.blocks = [r["block"] for r in found]
        self.counts = [r["n"] for r in found]
        self.starts = np.concatenate([[0], np.cumsum([r["bytes"] for r in found], dtype=np.int64)]).tolist()
        self.row_starts = np.concatenate([[0], np.cumsum([r["rows"] for r in found], dtype=np.int64)]).tolist()
        self.total, self.largest = self.starts[-1], max((r["top"] for r in found), default=0)
        self.held: dict[int, tuple[list[int], list[int]]] = {}

    def at_or_before(self, places: list[int]) -> list[tuple[int, int]]:
        """For each place in bytes, the last boundary not beyond it: its bytes and rows from the start."""
        at = [bisect_right(self.starts, p) - 1 for p in places]
        inner = {k for k, p in zip(at, places, strict=True) if k < len(self.blocks) and p > self.starts[k]}
        small = sorted(k for k in inner if self.counts[k] <= FETCH and k not in self.held)
        if small:
            if sum(len(x) for x, _ in self.held.values()) > HELD:
                self.held.clear()
            rows = self.groups.where(F.col("block").isin([self.blocks[k] for k in small])).select("block", "before_bytes", "before_rows").toPandas()
            for block, own in rows.sort_values("before_bytes").groupby("block"):
                self.held[self.blocks.index(block)] = own["before_bytes"].tolist(), own["before_rows"].tolist()
        far = self._searched([(i, k, p - self.starts[k]) for i, (k, p) in enumerate(zip(at, places, strict=True)) if k in inner and k not in self.held])
        out = []
        for i, (k, p) in enumerate(zip(at, places, strict=True)):
            if k not in inner:
                out.append((self.starts[k], self.row_starts[k]))
            else:
                if k in self.held:
                    own_bytes, own_rows = self.held[k]
                    j = bisect_right(own_bytes, p - self.starts[k]) - 1
                    found = own_bytes[j], own_rows[j]
                else:
                    found = far[i]
                out.append((self.starts[k] + found[0], self.row_starts[k] + found[1]))
        return out

    def at_or_after(self, places: list[int]) -> list[tuple[int, int]]:
        """For each place in bytes, the first boundary not before it: the end of the group that holds the byte before."""
        before = self.at_or_before([max(p, 0) for p in places])
        return [b if b[0] >= p else self._end_of(b[0]) for b, p in zip(before, places, strict=True)]

    def _end_of(self, start: int) -> tuple[int, int]:
        """The end of the group that begins at a place."""
        k = bisect_right(self.starts, start) - 1
        begins = start - self.starts[k]
        if k in self.held:
            own_bytes, own_rows = self.held[k]
            j = bisect_right(own_bytes, begins)
            if j < len(own_bytes):
                return self.starts[k] + own_bytes[j], self.row_starts[k] + own_rows[j]
        else:
            there = self.groups.where((F.col("block") == self.blocks[k]) & (F.col("before_bytes") == begins))
            end = there.select(F.max(F.col("before_bytes") + F.col("bytes")), F.max(F.col("before_rows") + F.col("rows"))).first()
            return self.starts[k] + end[0], self.row_starts[k] + end[1]
        return self.starts[k + 1], self.row_starts[k + 1]

    def _searched(self, asked: list[tuple[int, int, int]]) -> dict[int, tuple[int, int]]:
        if not asked:
            return {}
        spark = self.groups.sparkSession
        wanted = spark.createDataFrame([(i, self.blocks[k], p) for i, k, p in asked], "i int, block long, place long")
        near = self.groups.where(F.col("block").isin([self.blocks[k] for _, k, _ in asked])).join(F.broadcast(wanted), "block")
        near = near.where("before_bytes <= place").groupBy("i").agg(F.max(F.struct("before_bytes", "before_rows")).alias("m"))
        return {r["i"]: (r["m"][0], r["m"][1]) for r in near.collect()}

    def filled(self, capacities: list[int], shards: int) -> list[list[tuple[int, int]]]:
        """The ends of the shards that a greedy filling makes at each capacity, at most ``shards``."""
        ends: list[list[tuple[int, int]]] = [[] for _ in capacities]
        for _ in range(shards):
            open_ = [i for i, e in enumerate(ends) if not e or e[-1][0] < self.total]
            got = self.at_or_before([(ends[i][-1][0] if ends[i] else 0) + capacities[i] for i in open_]) if open_ else []
            for i, end in zip(open_, got, strict=True):
                ends[i].append(end)
        return ends

    def aim(self, at: int, shards: int) -> int:
        """Where the next of ``shards`` shards would best end: those that no group fills alone share the rest evenly."""
        ahead = [(start, size) for start, size in self.large if start >= at]
        level, alone = (self.total - at) / shards, []
        while True:
            alone = [(start, size) for start, size in ahead if size > level]
            if len(alone) >= shards:
                break
            rest = (self.total - at - sum(size for _, size in alone)) / (shards - len(alone))
            if rest >= level:
                break
            level = rest
        if not alone:
            return at + ceil(level)
        start, size = alone[0]
        if start == at:
            return at + size
        # The stretch up to the next such group goes to whole shards.
        return at + ceil((start - at) / max(1, round((start - at) / max(level, 1))))

    def cuts(self, shards: int) -> list[tuple[int, int]]:
        """The inner ends of the shards, none of which passes the smallest capacity that suffices.

        Within that capacity shards are kept near equal: each ends at the boundary nearest to its aim, but not
        before the place from where the rest still fits.
        """
        if not self.blocks:
            return []
        share = -(-self.total // shards)
        low, high = max(share, self.largest), share + self.largest
        while low < high:
            tried = sorted({low + (high - low) * k // (TRIED + 1) for k in range(1, TRIED + 1)} | {low})
            enough = [e[-1][0] == self.total for e in self.filled(tried, shards)]
            first = enough.index(True) if True in enough else len(tried)
            low, high = (tried[first - 1] + 1 if first else low), (tried[first] if first < len(tried) else high)
        # Groups of more than a quarter of a fair share: at most four a shard.
        wide = self.groups.where(F.col("bytes") > share // 4).select("block", "before_bytes", "bytes").collect()
        base = dict(zip(self.blocks, self.starts, strict=False))
        self.large = sorted((base[r["block"]] + r["before_bytes"], r["bytes"]) for r in wide)
        # From the end back: where the last shards, filled up, begin.
        latest = [self.total]
        for _ in range(shards - 1):
            latest.append(self.at_or_after([latest[-1] - low])[0][0])
        ends, at = [], 0
        for k in range(1, shards):
            aim = self.aim(at, shards - k + 1)
            (before,), (after,) = self.at_or_before([aim]), self.at_or_after([aim])
            fits = [e for e in (before, after) if at < e[0] <= at + low and e[0] >= latest[shards - k]]
            fits = fits or self.at_or_after([max(min(at + 1, self.total), latest[shards - k])])
            ends.append(min(fits, key=lambda e: abs(e[0] - aim)))
            at = ends[-1][0]
        return ends


def sharded(df: DataFrame, shards: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``df`` as (id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    hexed = F.sha2(whole, 256)
    rows = written(
        df.select(
            F.col(id).alias("id"),
            (F.octet_length(whole) + 1).cast("long").alias("size"),
            F.crc32(whole).alias("crc"),
            F.unhex(hexed).alias("digest"),
            F.conv(F.substring(hexed, 1, 4), 16, 10).cast("long").alias("prefix"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "shard-rows",
    )
    n = rows.count()
    bits = min(16, max(8, (max(n, 1) // BLOCK_ROWS).bit_length()))
    chunk = F.shiftright("rid", CHUNK_BITS).alias("chunk")
    chunks = rows.groupBy("digest", "prefix", chunk).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    chunks = written(chunks, "shard-chunks")
    sums = chunks.groupBy("digest", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    before = W.Window.partitionBy("block").orderBy("digest").rowsBetween(W.Window.unboundedPreceding, -1)
    groups = sums.withColumn("block", F.shiftright("prefix", 16 - bits).cast("long")).select(
        "block", "digest", "bytes", "rows", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in ("bytes", "rows")]
    )
    groups = written(groups, "shard-groups")
    order = Order(groups)
    cuts = order.cuts(shards)
    starts = df.sparkSession.createDataFrame(
        list(zip(order.blocks, order.starts, order.row_starts, strict=False)), T.StructType([T.StructField(c, T.LongType()) for c in ("block", "block_bytes", "block_rows")])
    )
    place = F.col("block_bytes") + F.col("before_bytes")
    shard, first = F.lit(0), F.lit(0).cast("long")
    for k, (cut, cut_rows) in enumerate(cuts, 1):
        shard, first = F.when(place >= cut, k).otherwise(shard), F.when(place >= cut, cut_rows).otherwise(first)
    placed = groups.join(F.broadcast(starts), "block").select("digest", shard.alias("shard"), (F.col("block_rows") + F.col("before_rows") - first).alias("base"))
    earlier = W.Window.partitionBy("digest").orderBy("chunk").rowsBetween(W.Window.unboundedPreceding, -1)
    chunks = chunks.select("digest", "chunk", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("earlier")).join(placed, "digest")
    inside = W.Window.partitionBy("digest", "chunk").orderBy("rid")
    ranked = rows.select("id", "size", "crc", "digest", chunk, "rid").withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.join(chunks, ["digest", "chunk"]).select(
        F.col("id").alias(id),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("base") + F.col("earlier") + F.col("rank")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


__all__ = ["Order", "dropped", "sharded"]
