"""Best-fit packing of tokenized documents into sequences with several capacities.

A document is tokenized whole and ends with one more id. Only documents longer than a sequence are
cut, into full pieces and a last shorter one. Full pieces are sequences of their own. The others are
dealt by a hash of their row into bins' groups of about ``GROUP`` pieces, so that a task holds a
bounded number of them, and each group is packed from the longest piece down: of the bins whose residual
tokens, documents and attention cost (the sum of squared lengths) all suffice, the piece goes where the
rest has the smallest weighted norm, or where demand and residual have the largest weighted dot product;
if there is none, a new bin opens.

A group ends with bins that its last pieces could not fill. So each group sends its least filled bins on, up to
``GROUP / FAN`` pieces; ``FAN`` groups' bins make a group of the next level and are packed anew, which counts only where
it takes fewer bins; and so on until one group is left. Levels shrink, and no task ever holds more than about ``GROUP`` pieces.

Nulls: a null text counts as empty and gives one piece that holds the final id alone; a null id is kept.
Equal rows are packed one by one. Pieces of equal length go in the order of their rows, and of bins that are equally good the
oldest is taken. A very long text is tokenized whole by one task, and its pieces are packed like any others. Only the named
columns are read, so others may have any name. A table without rows gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewindle.llm.common import ready, written
from rewindle.llm.tokens import tokens

GROUP = 12_000
#: Groups whose open bins make one group of the next level.
FAN = 8
#: Bits of a sequence's number that tell the bins of a group apart, and the groups of a level.
BINS, GROUPS = 22, 36


@dataclass(frozen=True)
class Capacity:
    """What a sequence may hold. ``attention`` None: as much as a single piece of full length costs."""

    tokens: int = 2048
    documents: int = 2048
    attention: int | None = None

    def sizes(self) -> tuple[int, int, int]:
        full = self.tokens * self.tokens
        if self.attention is not None and self.attention < full:
            raise ValueError("a piece of full length must fit: attention must be at least tokens squared")
        if min(self.tokens, self.documents) < 1:
            raise ValueError("a sequence must hold a token and a document")
        return self.tokens, self.documents, full if self.attention is None else self.attention


def best_fit(lengths: np.ndarray, sizes: tuple[int, int, int], weights: tuple[float, float, float], score: str) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece and its place there; pieces are taken from the longest down."""
    order = np.argsort(-lengths, kind="stable")
    shortest = int(lengths.min()) if len(lengths) else 0
    scale = np.array(weights) / np.array(sizes, dtype=float)
    left = np.empty((3, max(16, len(lengths))))
    name = np.empty(left.shape[1], dtype=np.int64)
    live, opened = 0, 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for step, i in enumerate(order):
        need = np.array((lengths[i], 1.0, float(lengths[i]) ** 2))
        if step % 256 == 0 and live:  # bins that no piece can enter any more leave the search
            still = (left[0, :live] >= shortest) & (left[1, :live] >= 1) & (left[2, :live] >= shortest**2)
            n = int(still.sum())
            left[:, :n], name[:n] = left[:, :live][:, still], name[:live][still]
            live = n
        rest = left[:, :live] - need[:, None]
        fits = np.flatnonzero(rest.min(axis=0) >= 0) if live else ()
        if len(fits):
            rest = rest[:, fits] * scale[:, None]
            if score == "norm":
                k = fits[np.argmin(np.einsum("ij,ij->j", rest, rest))]
            else:
                k = fits[np.argmax((need * scale) @ (left[:, fits] * scale[:, None]))]
        else:
            k, live = live, live + 1
            left[:, k], name[k] = sizes, opened
            opened += 1
        bins[i], offsets[i] = name[k], sizes[0] - left[0, k]
        left[:, k] -= need
    return bins, offsets


def unfilled(bins: np.ndarray, lengths: np.ndarray, full: int, most: int) -> np.ndarray:
    """Whether each piece lies in one of the least filled bins, which hold ``most`` pieces at most; bins without room are left out."""
    names, place = np.unique(bins, return_inverse=True)
    used, many = np.bincount(place, lengths, len(names)), np.bincount(place, minlength=len(names))
    order = np.argsort(used, kind="stable")
    chosen = np.zeros(len(names), bool)
    chosen[order] = (np.cumsum(many[order]) <= most) & (used[order] < full)
    return chosen[place]


def pieces(df: DataFrame, path: str, longest: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ``piece``, ``start``, ``length``, ``ids_crc32``) of every document, each text tokenized once."""
    ready(df.sparkSession)
    kind = df.schema[id].dataType.simpleString()

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = tokens(path)
        for part in parts:
            at, rows = [], []
            for k, body in enumerate(part.column(1)):
                ids = read.ids(body.as_py() or "") + b"\0\0\0\0"
                for j, start in enumerate(range(0, len(ids), 4 * longest)):
                    own = ids[start : start + 4 * longest]
                    at.append(k)
                    rows.append((j, start // 4, len(own) // 4, zlib.crc32(own)))
            if at:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *columns], ["id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def packed(
    df: DataFrame,
    path: str,
    capacity: Capacity = Capacity(),  # noqa: B008
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    score: str = "norm",
    id: str = "doc_id",
    text: str = "text",
    group: int = GROUP,
) -> DataFrame:
    """Every piece of every document, with the ``sequence_id`` it goes to and its ``offset`` there."""
    if score not in ("norm", "dot"):
        raise ValueError("score is norm or dot")
    sizes = capacity.sizes()
    cut = written(pieces(df, path, sizes[0], id, text).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-cut.where(F.col("length") < sizes[0]).count() // group))
    kind = cut.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def level(rows: DataFrame, number: int, last: bool) -> DataFrame:
        """``rows`` (with ``rid``, ``bin_group``) packed by group; ``open`` says which go on to the next level."""

        def fill(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("rid", ignore_index=True)
            lengths = rows["length"].to_numpy()
            bins, offsets = best_fit(lengths, sizes, weights, score)
            if number == 0 or bins.max() + 1 < rows["sequence_id"].nunique():
                own = (number << GROUPS) + int(rows["bin_group"].iloc[0])
                rows = rows.assign(sequence_id=(own << BINS) + bins, offset=offsets)
            goes = False if last else unfilled(rows["sequence_id"].to_numpy(), lengths, sizes[0], max(1, group // FAN))
            return rows.assign(open=goes)

        return rows.groupBy("bin_group").applyInPandas(fill, f"{schema}, rid long, bin_group long, open boolean")

    names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    zero = F.lit(0).cast("long")
    full = cut.where(F.col("length") >= sizes[0]).withColumns({"sequence_id": -1 - F.col("rid"), "offset": zero})
    short = cut.where(F.col("length") < sizes[0]).withColumns({"sequence_id": zero, "offset": zero})
    rows = short.withColumn("bin_group", F.pmod(F.xxhash64("rid"), F.lit(groups).cast("long")))
    out, number = full.select(names), 0
    while groups > 1:
        done = written(level(rows, number, last=False), "packed")
        out = out.unionAll(done.where(~F.col("open")).select(names))
        rows = done.where("open").drop("open").withColumn("bin_group", F.floor(F.col("bin_group") / FAN))
        groups, number = -(-groups // FAN), number + 1
    return level(rows, number, last=True).select(names).unionAll(out).withColumnRenamed("id", id)
