"""Near-duplicate documents by SimHash: tiles of fingerprints compared exactly.

A text's words, with A to Z in lower case, give shingles; repeated ones count again, a shorter text is
one shingle, and a text without words has fingerprint zero. Each shingle is hashed (XXH64, seed 42), and a bit
of the fingerprint is set if more than half of the hashes have it. Fingerprints within ``radius``
bits are linked, and linked fingerprints form a component.

Only distinct fingerprints are compared. A tile holds at most about ``TILE`` fingerprints whose parts
(halves, or finer parts if there are many) have the same numbers of set bits. Two tiles can only hold
a link if those numbers differ by ``radius`` in all at most; all other pairs of tiles are skipped, and the
rest are compared by exclusive-or and bit counts. A pair of tiles returns a spanning forest of
its links, never all pairs of a dense group.

Nulls: a null text counts as empty. A document without an id takes part, but names no component unless
no member has an id. Equal rows share a component. A table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewindle.llm.common import fresh, ready, small_batches, words, written
from rewindle.llm.components import components

TILE = 8192
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def hashes(shingle: int) -> Column:
    """The signed hashes of the shingles of the words in column ``_w``."""
    n = F.size("_w")
    gram = lambda i: F.xxhash64(F.concat_ws(" ", *[F.get("_w", i + k) for k in range(shingle)]))
    return (
        F.when(n >= shingle, F.transform(F.sequence(F.lit(0), n - shingle), gram))
        .when(n > 0, F.array(F.xxhash64(F.array_join("_w", " "))))
        .otherwise(F.array().cast("array<bigint>"))
    )


def majority(values: np.ndarray) -> int:
    """The bits set in more than half of ``values``, as a signed 64-bit number."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(values), 1 << 16):
        part = values[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * count > len(values)).view(">i8")[0])


def fingerprints(df: DataFrame, shingle: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``id``, ``fp``) for each row."""
    ready(df.sparkSession)
    kind = df.schema[id].dataType.simpleString()

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part.column(1)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            found = [majority(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    lower = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _UPPER.lower())
    cut = df.select(F.col(id).alias("id"), words(lower).alias("_w"))
    return cut.select("id", hashes(shingle).alias("h")).mapInArrow(count, f"id {kind}, fp long")


def _steps(parts: int, radius: int) -> list[int]:
    """Differences between tile keys that a link can bridge, from the lesser key to the greater."""
    near = [d for d in product(range(-radius, radius + 1), repeat=min(parts, 4)) if sum(map(abs, d)) <= radius]
    if parts == 8:
        near = [a + b for a in near for b in near if sum(map(abs, a + b)) <= radius]
    return sorted(s for d in near if (s := sum(x << (7 * i) for i, x in enumerate(d))) >= 0)


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """Links between the tiles ``a`` and ``b`` that join what any link between them joins."""
    label = np.arange(len(a), len(a) + len(b))
    mine = label if same else np.arange(len(a))
    links = []
    # numpy counts the bits of a signed number's absolute value
    left, right = a.view(np.uint64), b.view(np.uint64)
    for i in range(0, len(a), 16):
        hit = np.bitwise_count(left[i : i + 16, None] ^ right[None, :]) <= radius
        for k in np.flatnonzero(hit.any(axis=1)):
            at = np.flatnonzero(hit[k])
            groups, first = np.unique(label[at], return_index=True)
            own = mine[i + k]
            for g, f in zip(groups, first, strict=True):
                if g != own:
                    links.append((int(a[i + k]), int(b[at[f]])))
            if len(groups) > 1 or groups[0] != own:
                label[np.isin(label, groups)] = own
                if not same:
                    mine[np.isin(mine, groups)] = own
    return links


def links(prints: DataFrame, radius: int) -> DataFrame:
    """(``x``, ``y``) between distinct fingerprints ``fp``, enough to join all that are linked."""
    spark = prints.sparkSession
    n = prints.count()
    parts = 2 if n <= 1 << 22 else 4 if n <= 1 << 34 else 8
    bits = 64 // parts
    mask = (1 << bits) - 1
    key = sum((F.bit_count(F.shiftrightunsigned("fp", bits * i).bitwiseAND(mask)).cast("long") * (1 << 7 * i) for i in range(parts)), F.lit(0).cast("long"))
    keyed = prints.select("fp", key.alias("key"))
    sizes = written(keyed.groupBy("key").agg(F.ceil(F.count("*") / TILE).alias("chunks")), "tile-sizes")
    if parts == 2:  # at most 33 * 33 rows
        sizes = F.broadcast(sizes)
    chunked = keyed.join(sizes, "key").select("key", "fp", F.pmod(F.xxhash64("fp"), "chunks").alias("chunk"))
    tiles = written(chunked.groupBy("key", "chunk").agg(F.collect_list("fp").alias("fps")), "tiles")
    spread = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    steps = F.explode(F.array(*[F.lit(s).cast("long") for s in _steps(parts, radius)])).alias("step")
    left = tiles.select("key", F.col("chunk").alias("a_chunk"), F.col("fps").alias("a"), steps)
    left = left.select((F.col("key") + F.col("step")).alias("key"), "step", "a_chunk", "a").repartition(spread, "key")
    right = tiles.select("key", "chunk", F.col("fps").alias("b")).repartition(spread, "key")
    pairs = left.join(right, "key").where("step > 0 OR a_chunk <= chunk")
    pairs = pairs.select("a", "b", F.expr("step = 0 AND a_chunk = chunk").alias("same"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found: list[tuple[int, int]] = []
            for k in range(part.num_rows):
                a, b = (part.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (0, 1))
                found += forest(a, b, radius, part.column(2)[k].as_py())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["x", "y"])

    return pairs.mapInArrow(compare, "x long, y long")


def _grouped(prints: DataFrame, radius: int) -> DataFrame:
    """(``fp``, ``component_id``) from (``fp``, ``first``): fingerprints and their smallest document."""
    with small_batches(prints.sparkSession):
        joined = written(components(links(prints.select("fp"), radius)), "components")
    members = written(joined.join(prints, joined["node"] == prints["fp"]).select("node", "root", "first"), "members")
    least = written(members.groupBy("root").agg(F.min("first").alias("least")), "least")
    named = members.join(least, "root").select(F.col("node").alias("fp"), "least")
    return written(prints.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "named")


def classes(df: DataFrame, shingle: int = 3, radius: int = 3, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ``fingerprint`` in hex, ``component_id``) of each row: the smallest id its links reach."""
    with small_batches(df.sparkSession):
        rows = written(fingerprints(df, shingle, id, text), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("id").alias("first")), "prints")
    named = rows.join(_grouped(prints, radius), "fp")
    return named.select(F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, shingle: int = 3, radius: int = 3, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each component: the smallest id (rows without one come last), any one of equal ids."""
    rid, own = fresh(df, "rid", "own")
    rows = written(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(own), F.monotonically_increasing_id().alias(rid)), "rows")
    prints = fingerprints(rows.select(F.struct(F.col(f"{own}.`{id}`").alias("id"), rid).alias("id"), F.col(f"{own}.`{text}`").alias("text")), shingle, "id", "text")
    with small_batches(df.sparkSession):
        prints = written(prints.select("id.id", F.col(f"id.{rid}").alias("rid"), "fp"), "fingerprints")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "rid")
    first = written(prints.groupBy("fp").agg(F.min(order).alias("first")), "prints")
    named = _grouped(first, radius)
    kept = named.select(F.col("component_id.rid").alias(rid)).distinct()
    return rows.join(kept, rid, "left_semi").select(f"{own}.*")
