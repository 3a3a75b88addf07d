"""Hard negatives of anchor vectors, by bounds along a spanning tree of the anchors.

Components become whole numbers, ``floor(256 * x)``, and a row's score is its inner product with the anchor, a whole number too. An
anchor's positives are its best rows of the same label; a positive's negatives are the best rows of other labels whose score
lies in a window of shares of the positive's score. Higher scores come first, ties by smaller id.

Bounds. Anchors that lie near each other are put in blocks, each with the shortest spanning tree of its anchors. Rows are dealt into
lanes by hash; a task holds one lane and lets the blocks pass by. In a block, rows are scored exactly at the root; at each next
anchor a row's score lies within its score at the parent, plus or minus the length of the edge times the row's norm
(Cauchy-Schwarz), or within the parent's bounds widened so where that was not scored. Only rows whose bounds overlap what the anchor can
still use are scored: for positives, scores from the least of the best so far on; for negatives, the positives' windows, each
raised to the least of its best so far. What is skipped cannot be in the result, so the result is exact.

Anchors are a share of the rows and grow with them: blocks are copied to the lanes, not broadcast, and lanes are large (``LANE`` numbers), so copies stay
few. Ids are hashed, so no label, vector or id is hot; a lane gives at most the wanted number of rows for each anchor and positive, and a
group limit before the last shuffle does the same.

Rows without id, label or vector take no part, nor do vectors with a null or non-finite component or of another length than most. Rows that share an id
count once, with the least label and vector. Equal vectors tie and go by id. An anchor without positives gives no rows, nor
does a positive below zero, whose window is empty; an empty table gives none. Only the named columns are read, so others may have
any name. Scores beyond 53 bits are added up in whole Python numbers, and held at the ends of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rewindle.llm.common import ready, written
from rewindle.llm.order import ranked

SCALE = 256
#: Anchors of a block, whose bounds a task holds for ``CHUNK`` rows at a time.
BLOCK = 512
CHUNK = 4096
FIRST = 128
#: Numbers in a lane's vectors: 64 MB.
LANE = 1 << 23
PLANES = 16


@dataclass(frozen=True)
class Rules:
    """``positives`` of an anchor, ``negatives`` of each, scoring ``low`` to ``high`` percent of the positive."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


def usable(df: DataFrame, id: str, label: str, vector: str) -> DataFrame:
    """(``id``, ``label``, ``ints``) of the rows that take part, each id once."""
    col = lambda c: F.col(f"`{c}`")
    rows = df.select(col(id).cast("long").alias("id"), col(label).cast("long").alias("label"), col(vector).alias("emb"))
    fine = F.forall("emb", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.dropna().where(fine)
    usual = rows.groupBy(F.size("emb").alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = rows.where(F.size("emb") == (usual["size"] if usual else 0))
    ints = F.transform("emb", lambda x: F.floor(x.cast("double") * SCALE))
    least = F.min(F.struct("label", ints.alias("ints"))).alias("least")
    return rows.groupBy("id").agg(least).select("id", "least.label", "least.ints")


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), size)


def _signed(rows: DataFrame) -> DataFrame:
    """Adds ``sign``: on which sides of ``PLANES`` random planes a vector lies, so that near vectors sort together."""

    def signs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            x = _matrix(part.column("ints"), len(part.column("ints")[0])).astype(float)
            planes = np.random.default_rng(7).standard_normal((x.shape[1], PLANES))
            sign = ((x @ planes > 0) * (1 << np.arange(PLANES))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sign, pa.int64())], [*part.schema.names, "sign"])

    return rows.mapInArrow(signs, "id long, label long, ints array<long>, sign long")


_TREE = "block long, seq int, id long, label long, ints array<long>, parent int, edge double"


def spanning(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shortest spanning tree of the rows of ``x``: an order in which parents come first, each one's parent as a place in
    that order (-1 for the root), and the length of the edge to it."""
    n = len(x)
    x = x.astype(float)
    order, parent, edge = np.zeros(n, int), np.full(n, -1), np.zeros(n)
    near, link, left = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    now = 0
    for k in range(n):
        if k:
            now = int(np.argmin(np.where(left, near, np.inf)))
            parent[k], edge[k] = link[now], near[now]
        order[k], left[now] = now, False
        far = np.sqrt(((x - x[now]) ** 2).sum(axis=1))
        closer = far < near
        near[closer], link[closer] = far[closer], k
    return order, parent, edge


def trees(anchors: DataFrame) -> DataFrame:
    """Anchors (``id``, ``label``, ``ints``) in blocks of near ones, each in an order that puts parents first."""
    placed = ranked(_signed(anchors), [], ["sign", "id"])
    blocks = placed.select(F.floor(F.col("pos") / BLOCK).alias("block"), "id", "label", "ints")

    def tree(part: pa.Table) -> pa.Table:
        part = part.combine_chunks().sort_by("id")
        lists = part.column("ints").combine_chunks()
        order, parent, edge = spanning(_matrix(lists, len(lists[0])))
        out = part.take(pa.array(order)).select(["block", "id", "label", "ints"])
        more = {"seq": pa.array(np.arange(len(order)), pa.int32()), "parent": pa.array(parent, pa.int32()), "edge": pa.array(edge)}
        for name, column in more.items():
            out = out.append_column(name, column)
        return out.select(["block", "seq", "id", "label", "ints", "parent", "edge"])

    return written(blocks.groupBy("block").applyInArrow(tree, _TREE), "anchor-trees")


@dataclass
class Best:
    """The best ``most`` scores seen so far within ``low`` and ``high``; ``low`` rises with them."""

    most: int
    low: float
    high: float
    score: list[int] = field(default_factory=list)
    id: list[int] = field(default_factory=list)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = ((scores >= self.low) & (scores <= self.high)).astype(bool)
        if not fit.any():
            return
        score = np.r_[np.array(self.score, scores.dtype), scores[fit]]
        id = np.r_[np.array(self.id, np.int64), ids[fit]]
        keep = np.lexsort((id, -score)) if score.dtype != object else sorted(range(len(id)), key=lambda i: (-score[i], id[i]))
        keep = np.asarray(keep[: self.most])
        self.score, self.id = score[keep].tolist(), id[keep].tolist()
        if len(keep) == self.most:
            self.low = max(self.low, self.score[-1])


@dataclass
class Lane:
    """The rows of a lane that a task holds."""

    id: np.ndarray
    label: np.ndarray
    x: np.ndarray

    def parts(self) -> Iterator[Lane]:
        """Parts that grow up to ``CHUNK`` rows: the first ones soon give bests that spare the others' scores."""
        start, many = 0, FIRST
        while start < len(self.id):
            yield Lane(*(a[start : start + many] for a in (self.id, self.label, self.x)))
            start, many = start + many, min(2 * many, CHUNK)


@dataclass
class Anchor:
    id: int
    label: int
    x: np.ndarray
    parent: int
    edge: float
    wanted: list[Best]


def _exact(x: np.ndarray, anchors: list[Anchor]) -> bool:
    """Whether all scores, and the sums on the way to them, are whole numbers that a double holds."""
    most = lambda a: float(np.abs(a.astype(float)).max()) if a.size else 0.0
    return x.shape[1] * most(x) * max((most(a.x) for a in anchors), default=0.0) < 2.0**53


def search(lane: Lane, anchors: list[Anchor], same: bool) -> int:
    """Let each anchor see the lane's rows of its own label (``same``) or of others; returns how many were scored."""
    scored = 0
    plain = _exact(lane.x, anchors)
    for part in lane.parts():
        x = part.x.astype(float) if plain else part.x.astype(object)
        norm = np.sqrt((part.x.astype(float) ** 2).sum(axis=1)) * (1 + 1e-9)
        low, high = np.empty((2, len(anchors), len(norm)))
        for k, a in enumerate(anchors):
            y = a.x.astype(x.dtype)
            other = (part.label == a.label) != same
            if a.parent < 0:
                may = np.ones(len(norm), bool)
            else:
                reach = norm * a.edge
                low[k], high[k] = low[a.parent] - reach, high[a.parent] + reach
                slack = 1 + 1e-9 * np.maximum(np.abs(low[k]), np.abs(high[k]))
                least, most = min((w.low for w in a.wanted), default=np.inf), max((w.high for w in a.wanted), default=-np.inf)
                may = (high[k] + slack >= least) & (low[k] - slack <= most) & ~other
            hit = np.flatnonzero(may)
            scored += len(hit)
            if not len(hit):
                continue
            # Rows are gathered first unless most are needed.
            score = (x @ y)[hit] if 2 * len(hit) > len(norm) else x[hit] @ y
            low[k, hit] = high[k, hit] = score.astype(float)
            fit = ~other[hit] & (part.id[hit] != a.id)
            score = score[fit].astype(np.int64) if plain else score[fit]
            for w in a.wanted:
                w.add(score, part.id[hit[fit]])
    return scored


_WIDE = (1 << 63) - 1


def _clip(score: int) -> int:
    return max(-_WIDE - 1, min(_WIDE, int(score)))


def _searched(rows: DataFrame, anchors: DataFrame, lanes: int, rules: Rules, same: bool) -> DataFrame:
    """(``anchor``, ``pos_id``, ``pos_score``, ``id``, ``score``): the best of each lane for each anchor and positive."""
    none = lambda kind: F.lit(None).cast(kind)
    lane = F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int").alias("lane")
    held = rows.select(
        lane, F.lit(-1).cast("long").alias("block"), none("int").alias("seq"), "id", "label", "ints",
        none("int").alias("parent"), none("double").alias("edge"), none("array<long>").alias("pos_id"), none("array<long>").alias("pos_score"),
    )
    if same:
        anchors = anchors.withColumns({"pos_id": none("array<long>"), "pos_score": none("array<long>")})
    every = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    both = held.unionByName(anchors.select(every, "block", "seq", "id", "label", "ints", "parent", "edge", "pos_id", "pos_score"))
    # Rows of a lane come first (block -1), then the anchors, block by block in the order of their tree.
    dealt = both.repartition(lanes, "lane").sortWithinPartitions("lane", "block", "seq")

    def results(lane: Lane, block: list[tuple]) -> Iterator[tuple]:
        positives = [[(None, None)] if same else list(zip(b[5], b[6], strict=True)) for b in block]
        window = lambda s: Best(rules.positives, -np.inf, np.inf) if same else Best(rules.negatives, -(-rules.low * s // 100), rules.high * s // 100)
        anchors = [Anchor(*b[:5], [window(s) for _, s in p]) for b, p in zip(block, positives, strict=True)]
        search(lane, anchors, same)
        for a, found in zip(anchors, positives, strict=True):
            for w, (p, s) in zip(a.wanted, found, strict=True):
                yield from ((a.id, p, s, i, _clip(v)) for i, v in zip(w.id, w.score, strict=True))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Lane] = []
        lane, block, at = None, [], (None, None)

        def flushed() -> Iterator[pa.RecordBatch]:
            if block and lane is not None and len(lane.id):
                found = list(results(lane, block))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), pa.int64()) for c in (zip(*found, strict=True) if found else ((),) * 5)],
                    ["anchor", "pos_id", "pos_score", "id", "score"],
                )
            block.clear()

        for part in parts:
            if not part.num_rows:
                continue
            lists = part.column("ints")
            x = _matrix(lists, len(lists[0]))
            get = {n: part.column(n).to_numpy(zero_copy_only=False) for n in ("lane", "block", "id", "label")}
            cells = np.flatnonzero(np.r_[True, (np.diff(get["lane"]) != 0) | (np.diff(get["block"]) != 0)])
            for a, b in zip(cells, np.r_[cells[1:], part.num_rows], strict=True):
                here = (int(get["lane"][a]), int(get["block"][a]))
                if here != at:
                    yield from flushed()
                if here[0] != at[0]:
                    held, lane = [], None
                at = here
                if here[1] < 0:
                    held.append(Lane(get["id"][a:b].copy(), get["label"][a:b].copy(), x[a:b].copy()))
                    continue
                if lane is None and held:
                    lane = Lane(*(np.concatenate([getattr(h, n) for h in held]) for n in ("id", "label", "x")))
                    held = []
                tail = part.slice(a, b - a)
                more = [tail.column(n).to_pylist() for n in ("parent", "edge", "pos_id", "pos_score")]
                block += zip(get["id"][a:b].tolist(), get["label"][a:b].tolist(), x[a:b].copy(), *more, strict=True)
        yield from flushed()

    return dealt.mapInArrow(run, "anchor long, pos_id long, pos_score long, id long, score long")


def _first(df: DataFrame, keys: list[str], most: int, name: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return df.withColumn(name, F.row_number().over(order)).where(F.col(name) <= most)


def mined(df: DataFrame, anchor: Column, rules: Rules = Rules(), id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``).

    ``anchor`` is a condition on ``id`` (as a long of that name) that says which rows are anchors.
    """
    spark = df.sparkSession
    ready(spark)
    rows = written(usable(df, id, label, vector), "vectors")
    n, size = rows.agg(F.count("*"), F.max(F.size("ints"))).first()
    lanes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * (size or 1) // LANE))
    anchors = trees(rows.where(anchor))
    found = _searched(rows, anchors, lanes, rules, same=True)
    positives = _first(found.select("anchor", "id", "score"), ["anchor"], rules.positives, "place")
    lists = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("p"))
    lists = lists.select(F.col("anchor").alias("id"), F.col("p.id").alias("pos_id"), F.col("p.score").alias("pos_score"))
    known = written(anchors.join(lists, "id"), "positives")
    # A block that lost anchors without positives would lose parents: they stay, with nothing wanted.
    none = anchors.join(known.select("id"), "id", "left_anti").withColumns({c: F.array().cast("array<long>") for c in ("pos_id", "pos_score")})
    negatives = _searched(rows, written(known.unionByName(none), "anchors"), lanes, rules, same=False)
    best = _first(negatives, ["anchor", "pos_id"], rules.negatives, "rank")
    return best.select(
        F.col("anchor").alias("anchor_id"), F.col("pos_id").alias("positive_id"), "rank",
        F.col("id").alias("negative_id"), F.col("pos_score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
