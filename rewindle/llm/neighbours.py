"""Approximate nearest neighbours: a graph made by NN-descent, searched greedily.

Nearness is the inner product. Vectors are scaled by the largest norm and get one more component that makes
their length one, so that nearness in the graph orders them as the inner product does. Equal vectors
are one node of the graph, with their smallest ids.

Graph. Random hyperplanes deal the nodes into blocks several times; inside a block each node finds its nearest
ones. Then rounds of NN-descent: a node's neighbours, and a bounded draw of the nodes it is a neighbour
of, meet there and are compared with each other (a join brings their codes together), and each keeps the
``degree`` nearest it has met in any round.

Search. A query starts from its own node and from the nearest to it of a bounded number of nodes of large norm, which
every task holds, so that searches do not all meet in the same few nodes. Each round expands its nearest unexpanded nodes: a join
with the graph, taken both ways, whose rows hold the neighbours' codes and are bucketed by node, so that only queries move. Codes are
vectors in bytes with a scale and the added component apart; the best of the pool are scored anew from the original vectors in double precision.

Rows without id take no part, nor do vectors that are null, zero, of another length than most, or that hold a null or
non-finite component. Rows that share an id count once, with the least of their vectors. Ties go to the
smaller id. A query with fewer candidates than asked gets them all; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rewindle.llm.common import dropped, ready, shared_path, written


#: The most neighbours a search returns.
TOP = 20


@dataclass(frozen=True)
class Settings:
    """``degree`` neighbours a node keeps, ``drawn`` nodes it is a neighbour of that join it in a round,
    ``met`` nodes each one takes from a meeting, ``trees`` first dealings into blocks of about ``block`` nodes, ``rounds``
    of NN-descent; in a search ``width`` nodes expanded in a round, ``steps`` rounds at most, ``pool`` nodes remembered, ``exact`` of them
    scored from the original vectors, and ``entries`` nodes from which a search starts too, the nearest to the query of the ``large`` nodes of largest
    norm: where norms differ much, the nearest by inner product are far from the query's own node."""

    degree: int = 32
    drawn: int = 12
    met: int = 8
    trees: int = 4
    block: int = 800
    rounds: int = 3
    width: int = 48
    steps: int = 8
    pool: int = 400
    exact: int = 64
    entries: int = 40
    large: int = 1024


def _coded(x: np.ndarray) -> list[bytes]:
    """Each row as a scale and its last component in single precision, and the others in signed bytes.

    The last one is near one in a vector of small norm; in bytes by one scale with it, the others would all be zero.
    """
    scale = (np.abs(x[:, :-1]).max(axis=1, keepdims=True) / 127).astype("<f4")
    whole = np.rint(x[:, :-1] / np.maximum(scale, 1e-30)).astype(np.int8)
    return [s.tobytes() + w.tobytes() for s, w in zip(np.c_[scale, x[:, -1:]].astype("<f4"), whole, strict=True)]


def _vectors(codes: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    floats = np.ascontiguousarray(raw[:, :8]).view("<f4")
    return np.c_[raw[:, 8:].view(np.int8).astype(np.float32) * floats[:, :1], floats[:, 1:]]


def _rows(columns: dict[str, tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in types.items()], list(types))


#: Rows that a task of the search turns into vectors at once: with their neighbours' codes, some ten thousand.
AT_ONCE = 512


def _sliced(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``AT_ONCE``; an empty one is left out."""
    for part in parts:
        for at in range(0, part.num_rows, AT_ONCE):
            yield part.slice(at, AT_ONCE)


_EDGE = {"u": pa.int64(), "w": pa.int64(), "sim": pa.float32()}


def _best(u: np.ndarray, w: np.ndarray, sim: np.ndarray, most: int) -> pa.RecordBatch:
    """Of each ``u`` its ``most`` nearest different ``w``."""
    order = np.lexsort((w, u))
    u, w, sim = u[order], w[order], sim[order]
    keep = np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])] if len(u) else np.zeros(0, bool)
    u, w, sim = u[keep], w[keep], sim[keep]
    order = np.lexsort((-sim, u))
    u, w, sim = u[order], w[order], sim[order]
    first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, int)
    place = np.arange(len(u)) - np.repeat(first, np.diff(np.r_[first, len(u)]))
    keep = place < most
    return _rows({"u": u[keep], "w": w[keep], "sim": sim[keep]}, _EDGE)


def usable(df: DataFrame, id: str, vector: str) -> tuple[DataFrame, int]:
    """(``id``, ``emb``) of the rows that take part, each id once, and their vectors' length."""
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("emb")).where("id IS NOT NULL AND emb IS NOT NULL")
    usual = rows.groupBy(F.size("emb").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = usual["size"] if usual else 0
    finite = F.forall("emb", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where((F.size("emb") == size) & finite & F.exists("emb", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("emb").alias("emb")), size


def nodes(df: DataFrame, s: Settings, id: str, vector: str) -> DataFrame:
    """(``node``, ``ids``, ``emb``, ``code``, ``blocks``): different vectors with at most their 21 smallest ids."""
    spark = df.sparkSession
    rows, size = usable(df, id, vector)
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("emb").orderBy("id"))).where(f"n <= {TOP + 1}")
    groups = ranked.groupBy("emb").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    groups = written(groups.select(F.monotonically_increasing_id().alias("node"), "ids", "emb"), "vectors")
    square = F.aggregate(F.transform("emb", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    n, largest = groups.agg(F.count("*"), F.max(F.sqrt(square))).first()
    bits = max(0, int(np.log2(max(1, n) / s.block)))
    rng = np.random.default_rng(11)
    planes = rng.normal(size=(size + 1, s.trees, bits)).astype(np.float32)

    def unit(part: pa.RecordBatch) -> np.ndarray:
        x = part.column("emb").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size) / largest
        last = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
        return np.c_[x, last].astype(np.float32)

    # the planes pass through the middle of a bounded sample
    sample = groups.select("emb").limit(2000).collect() if bits else []
    middle = np.zeros((s.trees, bits), np.float32)
    if sample:
        x = np.array([r[0] for r in sample]) / largest
        x = np.c_[x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))]
        middle = np.median(np.einsum("nd,dtb->ntb", x, planes), axis=0).astype(np.float32)

    def code(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            x = unit(part)
            block = ((np.einsum("nd,dtb->ntb", x, planes) > middle) << np.arange(bits)).sum(axis=2).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * s.trees, pa.int32()), pa.array(block.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_coded(x), pa.binary()), lists], ["node", "ids", "emb", "code", "blocks"])

    kind = groups.schema["emb"].dataType.simpleString()
    out = written(groups.mapInArrow(code, f"node long, ids array<long>, emb {kind}, code binary, blocks array<long>"), "nodes")
    dropped(groups)
    return out if n else spark.createDataFrame([], out.schema)


def _merged(edges: DataFrame, degree: int) -> DataFrame:
    best = Window.partitionBy("u").orderBy(F.desc("sim"), "w")
    once = edges.repartition("u").groupBy("u", "w").agg(F.max("sim").alias("sim"))
    return written(once.withColumn("n", F.row_number().over(best)).where(f"n <= {degree}").drop("n"), "graph")


def _first_graph(table: DataFrame, s: Settings) -> DataFrame:
    """Each node's nearest inside its blocks."""
    dealt = table.select("node", "code", F.posexplode("blocks").alias("tree", "block"))
    sizes = written(dealt.groupBy("tree", "block").agg(F.count("*").alias("n")), "block-sizes")
    alone = sizes.count() <= s.trees
    most = s.degree if alone else max(1, 3 * s.degree // (2 * s.trees))
    dealt = dealt.join(sizes, ["tree", "block"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("n") / (2 * s.block))))

    def near(group: pa.Table) -> pa.Table:
        ids, x = group["node"].to_numpy(), _vectors(group["code"].to_pylist())
        sim = x @ x.T
        np.fill_diagonal(sim, -9)
        k = min(most, len(ids) - 1)
        if k < 1:
            return pa.Table.from_batches([_best(ids[:0], ids[:0], x[:0, 0], most)])
        at = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        return pa.Table.from_batches([_best(np.repeat(ids, k), ids[at].ravel(), np.take_along_axis(sim, at, 1).ravel(), most)])

    found = dealt.groupBy("tree", "block", "part").applyInArrow(near, "u long, w long, sim float")
    return _merged(found, s.degree)


def _met(v: np.ndarray, x: np.ndarray, worst: np.ndarray, vectors: np.ndarray, s: Settings) -> pa.RecordBatch:
    """Compare the members of each meeting ``v`` with each other; nearer ones than they have."""
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    size = np.diff(np.r_[first, len(v)])
    us, ws, sims = [], [], []
    for i in range(0, len(first), 256):
        f, n = first[i : i + 256], size[i : i + 256]
        at = f[:, None] + np.minimum(np.arange(n.max()), n[:, None] - 1)
        there = np.arange(n.max()) < n[:, None]
        own = vectors[at]
        sim = np.where(there[:, None, :] & there[:, :, None], own @ own.transpose(0, 2, 1), -9)
        sim[x[at][:, :, None] == x[at][:, None, :]] = -9
        k = min(s.met, sim.shape[2])
        best = np.argpartition(-sim, k - 1, axis=2)[:, :, :k]
        value = np.take_along_axis(sim, best, 2)
        g, r, c = np.nonzero(value > np.maximum(worst[at], -2)[:, :, None])
        us.append(x[at][g, r])
        ws.append(x[at][g, best[g, r, c]])
        sims.append(value[g, r, c])
    return _best(*(np.concatenate(c) for c in (us, ws, sims)), s.degree)


def _round(graph: DataFrame, table: DataFrame, s: Settings, k: int) -> DataFrame:
    draw = Window.partitionBy("w").orderBy(F.xxhash64("u", "w", F.lit(k)))
    back = graph.withColumn("n", F.row_number().over(draw)).where(f"n <= {s.drawn}").select(F.col("w").alias("v"), F.col("u").alias("x"))
    own = table.select(F.col("node").alias("v"), F.col("node").alias("x"))
    members = graph.select(F.col("u").alias("v"), F.col("w").alias("x")).unionAll(back).unionAll(own)
    held = graph.groupBy("u").agg(F.when(F.count("*") >= s.degree, F.min("sim")).otherwise(F.lit(-2.0).cast("float")).alias("worst"))
    state = table.join(held, table["node"] == held["u"], "left").select("node", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"), "code")
    state = written(state, "state")
    joined = members.join(state, members["x"] == state["node"]).select("v", "x", "worst", "code").repartition("v").sortWithinPartitions("v", "x")

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for part in parts:
            rows = pa.Table.from_batches([part])
            rows = rows if held is None else pa.concat_tables([held, rows])
            v = rows["v"].to_numpy()
            whole = int(np.searchsorted(v, v[-1])) if len(v) else 0  # the last meeting may go on
            held = rows.slice(whole)
            if whole:
                yield step(rows.slice(0, whole))
        if held is not None and held.num_rows:
            yield step(held)

    def step(rows: pa.Table) -> pa.RecordBatch:
        return _met(rows["v"].to_numpy(), rows["x"].to_numpy(), rows["worst"].to_numpy(), _vectors(rows["code"].to_pylist()), s)

    found = joined.mapInArrow(meet, "u long, w long, sim float")
    out = _merged(graph.unionAll(found), s.degree)
    dropped(state)
    dropped(graph)
    return out


def graph_of(table: DataFrame, s: Settings) -> DataFrame:
    """(``u``, ``w``, ``sim``): the neighbours of every node."""
    graph = _first_graph(table, s)
    for k in range(s.rounds):
        graph = _round(graph, table, s, k)
    return graph


_POOL = "q long, qnode long, qcode binary, ids array<long>, sims array<float>, done array<boolean>"


def _asked(ids: DataFrame, table: DataFrame) -> DataFrame:
    """(``q``, ``node``, ``code``, ``own``): queries, coded as unit vectors without the added component.

    So their product with a node's code orders nodes as the inner product does, whatever the norms.
    """
    kind = table.schema["emb"].dataType.simpleString()

    def code(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                x = part.column("emb").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                x = np.c_[x / np.sqrt((x * x).sum(axis=1, keepdims=True)), np.zeros(len(x))].astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("q"), part.column("node"), pa.array(_coded(x), pa.binary()), part.column("emb")], ["q", "node", "code", "own"])

    rows = ids.join(table, "emb").select("q", "node", "emb")
    return rows.mapInArrow(code, f"q long, node long, code binary, own {kind}")


def _started(queries: DataFrame, table: DataFrame, s: Settings) -> DataFrame:
    """The pools that searches start with: the query's own node and its entries."""
    square = F.aggregate(F.transform("emb", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    large = table.orderBy(F.desc(square), "node").select("node", "code").limit(s.large).collect() if s.entries else []
    numbers, codes = [r["node"] for r in large], [bytes(r["code"]) for r in large]

    def start(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = np.array(numbers, np.int64)
        x = _vectors(codes) if codes else None
        for part in _sliced(parts):
            ids, sims = [[n] for n in part.column("node").to_pylist()], [[1.0] for _ in range(part.num_rows)]
            if x is not None:
                near = _vectors(part.column("code").to_pylist()) @ x.T
                best = np.argsort(-near, axis=1, kind="stable")[:, : s.entries]
                for own, value, at, row in zip(ids, sims, best, near, strict=True):
                    at = at[others[at] != own[0]]
                    own += others[at].tolist()
                    value += row[at].tolist()
            done = [[False] * len(i) for i in ids]
            arrays = [part.column("q"), part.column("node"), part.column("code"), pa.array(ids, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float32())), pa.array(done, pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays(arrays, ["q", "qnode", "qcode", "ids", "sims", "done"])

    return queries.select("q", "node", "code").mapInArrow(start, _POOL)


def _searched(table: DataFrame, graph: DataFrame, queries: DataFrame, s: Settings) -> DataFrame:
    """(``q``, ``node``) for the best nodes that each query's search has met."""
    spark = table.sparkSession
    buckets = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name, path = f"graph_{uuid.uuid4().hex}", shared_path(spark, "bucketed-graph")
    # both ways, so that a node few others hold among their nearest can be reached from its own
    nearest = Window.partitionBy("w").orderBy(F.desc("sim"), "u")
    back = graph.withColumn("n", F.row_number().over(nearest)).where(f"n <= {s.drawn}").select(F.col("w").alias("u"), F.col("u").alias("w"))
    graph = graph.select("u", "w").unionAll(back).distinct()
    rich = graph.join(table.select(F.col("node").alias("w"), "code"), "w").groupBy("u").agg(F.collect_list(F.struct("w", "code")).alias("near"))
    rich = rich.select("u", F.col("near.w").alias("ws"), F.col("near.code").alias("codes"))
    rich.repartition(buckets, "u").write.bucketBy(buckets, "u").option("path", path).saveAsTable(name)
    rich = spark.table(name)
    pools = written(_started(queries, table, s), "pools")

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(parts):
            rows = [(r["q"], i, r["qcode"]) for r in part.to_pylist() for i in [i for i, d in zip(r["ids"], r["done"], strict=True) if not d][: s.width]]
            for at in range(0, len(rows), 20_000):
                yield _rows(dict(zip(("q", "u", "qcode"), zip(*rows[at : at + 20_000], strict=True), strict=True)), {"q": pa.int64(), "u": pa.int64(), "qcode": pa.binary()})

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(parts):
            lists, codes = part.column("ws"), part.column("codes")
            size = np.diff(lists.offsets.to_numpy())
            own = np.repeat(_vectors(part.column("qcode").to_pylist()), size, axis=0)
            sims = np.einsum("ij,ij->i", own, _vectors(codes.flatten().to_pylist())).astype(np.float32)
            ends = np.r_[0, np.cumsum(size)]
            arrays = [part.column("q"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists.flatten()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sims))]
            yield pa.RecordBatch.from_arrays(arrays, ["q", "ids", "sims"])

    def gather(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        own = next(r for r in rows if r["qcode"] is not None)
        asked = 0
        known = {}
        for i, sim, d in zip(own["ids"], own["sims"], own["done"], strict=True):
            asked += not d
            known[i] = (sim, d or asked <= s.width)
        for r in rows:
            if r["qcode"] is None:
                for i, sim in zip(r["ids"], r["sims"], strict=True):
                    known.setdefault(i, (sim, False))
        best = sorted(known.items(), key=lambda x: (-x[1][0], x[0]))[: s.pool]
        out = {"q": [own["q"]], "qnode": [own["qnode"]], "qcode": [own["qcode"]], "ids": [[i for i, _ in best]], "sims": [[x[0] for _, x in best]], "done": [[x[1] for _, x in best]]}
        return pa.table(out, schema=pa.schema([("q", pa.int64()), ("qnode", pa.int64()), ("qcode", pa.binary()), ("ids", pa.list_(pa.int64())), ("sims", pa.list_(pa.float32())), ("done", pa.list_(pa.bool_()))]))

    for _ in range(s.steps):
        asked = pools.mapInArrow(ask, "q long, u long, qcode binary")
        hits = asked.join(rich, "u").select("q", "qcode", "ws", "codes").mapInArrow(score, "q long, ids array<long>, sims array<float>")
        none = [F.lit(None).cast(t).alias(c) for c, t in (("qnode", "long"), ("qcode", "binary"))]
        more = hits.select("q", *none, "ids", "sims", F.lit(None).cast("array<boolean>").alias("done"))
        after = written(pools.unionAll(more).groupBy("q").applyInArrow(gather, _POOL), "pools")
        dropped(pools)
        pools = after
        if pools.where(F.exists("done", lambda d: ~d)).isEmpty():
            break
    spark.sql(f"DROP TABLE {name}")
    return pools.select("q", "qnode", F.explode(F.slice("ids", 1, s.exact)).alias("node"))


def searched(df: DataFrame, every: int = 20, top: int = TOP, settings: Settings = Settings(), id: str = "vec_id", vector: str = "embedding") -> DataFrame:  # noqa: B008
    """(``query_id``, ``rank``, ``vec_id``, ``score``): the nearest found for each row whose id is divisible by ``every``."""
    if not 0 < top <= TOP:
        raise ValueError(f"top is 1 to {TOP}")
    ready(df.sparkSession)
    table = nodes(df, settings, id, vector)
    graph = graph_of(table.select("node", "code", "blocks"), settings)
    # an id divisible by ``every`` may be beyond the smallest ids of its vector
    ids = usable(df, id, vector)[0].where(F.col("id") % every == 0).withColumnRenamed("id", "q")
    asked = written(_asked(ids, table), "queries")
    found = _searched(table, graph, asked, settings)
    pairs = found.join(table.select("node", "ids", "emb"), "node").join(asked.select("q", "own"), "q")
    product = F.aggregate(F.zip_with("own", "emb", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    scored = pairs.select("q", product.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> q")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(f"rank <= {top}")
    return ranked.select(F.col("q").alias("query_id"), "rank", "vec_id", "score")
