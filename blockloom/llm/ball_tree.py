"""Exact top-k inner-product search with ball trees.

Vectors become integers, floor(scale * x). Rows are dealt into cells around centres that are fitted on a
bounded sample, and each cell into shards of bounded size; a shard is kept as one packed row with
its ball tree. A ball's upper bound for a query q is q.centre + |q| * radius. Queries travel to
shards, not shards to queries: in a first round each query searches one shard of the cell with
its highest bound, which gives a k-th score; in a second round it goes, with that score, only to
shards of cells whose bound reaches it, and inside a tree only down branches whose bound does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import cut

SCALE = 1024
SHARD_ROWS = 16_384  # rows of a shard, about
QUERY_ROWS = 4096  # queries that meet a shard at once, about
CELLS = 64  # of one dimension, at most
SAMPLE = 4096  # rows that centres are fitted on, at most; all rows are dealt to the cells
LEAF = 128
NO_SCORE = -(2**62)
LARGEST = 2.0**62  # components whose scaled value reaches this are refused


def build(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ball tree over integer vectors: (order of rows, nodes, centres, radii). A node is (from, to,
    left child, right child) with children -1 in a leaf. Splits at the median along the direction
    between two far points; equal vectors share nodes."""
    order = np.arange(len(vectors))
    data = vectors.astype(np.float64)
    nodes, centres, radii = [], [], []

    def add(lo: int, hi: int) -> int:
        part = data[order[lo:hi]]
        centre = part.mean(0)
        nodes.append([lo, hi, -1, -1])
        centres.append(centre)
        radii.append(float(np.sqrt(((part - centre) ** 2).sum(1).max())))
        return len(nodes) - 1

    todo = [add(0, len(vectors))] if len(vectors) else []
    while todo:
        node = todo.pop()
        lo, hi = nodes[node][:2]
        if hi - lo <= LEAF or radii[node] == 0:
            continue
        part = data[order[lo:hi]]
        a = part[((part - centres[node]) ** 2).sum(1).argmax()]
        b = part[((part - a) ** 2).sum(1).argmax()]
        order[lo:hi] = order[lo:hi][np.argsort(part @ (b - a), kind="stable")]
        mid = (lo + hi) // 2
        nodes[node][2:] = add(lo, mid), add(mid, hi)
        todo += nodes[node][2:]
    return order, np.array(nodes, np.int64).reshape(-1, 4), np.array(centres).reshape(len(nodes), -1), np.array(radii)


class Best:
    """The k best of each query: by falling score, then by rising id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.score = np.full((queries, k), NO_SCORE)
        self.vec = np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores (rows x candidates) of the candidates `ids`."""
        if not len(rows) or not len(ids):
            return
        score = np.concatenate([self.score[rows], scores], 1)
        vec = np.concatenate([self.vec[rows], np.broadcast_to(ids, scores.shape)], 1)
        if score.shape[1] > 4 * self.k:  # all that reach the k-th score, ties included
            kth = np.partition(score, score.shape[1] - self.k, 1)[:, score.shape[1] - self.k]
            wide = int((score >= kth[:, None]).sum(1).max())
            top = np.argpartition(-score, wide - 1, 1)[:, :wide] if wide < score.shape[1] else np.broadcast_to(np.arange(score.shape[1]), score.shape)
            score, vec = np.take_along_axis(score, top, 1), np.take_along_axis(vec, top, 1)
        order = np.lexsort((vec, -score), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(score, order, 1)
        self.vec[rows] = np.take_along_axis(vec, order, 1)


def _products(queries: np.ndarray, vectors: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Exact inner products, NO_SCORE where `own` says so. Doubles hold them below 2^52, 64-bit integers below
    2^62; beyond that they are computed with numbers of any size, and one that no bigint holds is an error."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    if most < 2**52:
        out = np.rint(queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    elif most < 2**62:
        out = queries @ vectors.T
    else:
        wide = np.where(own, 0, queries.astype(object) @ vectors.astype(object).T)
        if any(not NO_SCORE < x < 2**63 for x in wide.ravel()):
            raise OverflowError("an inner product does not fit a bigint")
        out = wide.astype(np.int64)
    out[own] = NO_SCORE
    return out


def search(best: Best, floor: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, nodes: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> None:
    """Branch and bound over one tree (vectors in its order), for all queries that still may gain. `floor` is
    a k-th score that each query has elsewhere."""
    if not len(nodes):
        return
    points = queries.astype(np.float64)
    norm = np.sqrt((points**2).sum(1))
    stack = [(0, np.arange(len(queries)), points @ centres[0] + norm * radii[0])]
    while stack:
        node, rows, bound = stack.pop()
        rows = rows[reaches(bound, np.maximum(best.score[rows, -1], floor[rows]))]
        if not len(rows):
            continue
        lo, hi, left, right = nodes[node]
        if left < 0:
            for at in range(lo, hi, 4096):
                some = slice(at, min(hi, at + 4096))
                own = query_ids[rows][:, None] == ids[some][None]
                best.offer(rows, _products(queries[rows], vectors[some], own), ids[some])
            continue
        bounds = [points[rows] @ centres[c] + norm[rows] * radii[c] for c in (left, right)]
        # each query takes its own better half first
        first = bounds[0] >= bounds[1]
        for mine, order in ((first, (1, 0)), (~first, (0, 1))):
            if mine.any():
                for c in order:
                    stack.append(((left, right)[c], rows[mine], bounds[c][mine]))


def reaches(bound: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Whether an upper bound reaches a score, rounding errors allowed for."""
    return bound + 1e-6 * np.abs(bound) + 1e-3 >= score


def _centres(rows: DataFrame, cells: int) -> dict[int, np.ndarray]:
    """Up to `cells` centres for each dimension among at most SAMPLE rows, those of the lowest hash."""
    by_dim: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).select("dim", "v").collect():
        by_dim.setdefault(r.dim, []).append(r.v)
    out = {}
    for dim, found in by_dim.items():
        data = np.unique(np.array(found, np.float64), axis=0)
        centres = data[np.random.default_rng(dim).permutation(len(data))[:cells]]
        for _ in range(5):
            near = _nearest(data, centres)[0]
            centres = np.array([data[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        out[dim] = centres
    return out


def _nearest(data: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and the distance to it."""
    near = ((centres**2).sum(1) - 2 * data @ centres.T).argmin(1)
    return near, np.sqrt(((data - centres[near]) ** 2).sum(1))


def _dealt(model: dict[int, np.ndarray]):
    """Rows with their cell and their distance from its centre; a dimension that the sample missed is one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            v = batch.column("v")
            flat, ends = v.flatten().to_numpy(), np.cumsum(dims)
            cell, dist = np.zeros(len(dims), np.int64), np.full(len(dims), np.inf)
            packed = [b""] * len(dims)
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                data = flat[(ends[mine] - dim)[:, None] + np.arange(dim)]
                if dim in model:
                    cell[mine], dist[mine] = _nearest(data.astype(np.float64), model[dim])
                for i, x in zip(mine.tolist(), data, strict=True):
                    packed[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("dim"), pa.array(cell), pa.array(dist), pa.array(packed, pa.binary())], ["vec_id", "dim", "cell", "dist", "v"])

    return run


def _bounded(model: dict[int, np.ndarray]):
    """Each query and cell with the cell's upper bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cells, radius = (batch.column(c).to_numpy() for c in ("dim", "cell", "radius"))
            bound = np.full(len(dims), np.inf)
            q = batch.column("v")
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero((dims == dim) & np.isfinite(radius))
                if dim in model and len(mine):
                    points = np.frombuffer(b"".join(q[i].as_py() for i in mine.tolist()), np.int64).reshape(-1, dim).astype(np.float64)
                    bound[mine] = (points * model[dim][cells[mine]]).sum(1) + np.sqrt((points**2).sum(1)) * radius[mine]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound)], [*batch.schema.names, "bound"])

    return run


def _pack_shard(table: pa.Table) -> pa.Table:
    ids, dim = table.column("vec_id").to_numpy(), table.column("dim")[0].as_py()
    vectors = np.frombuffer(b"".join(table.column("v").to_pylist()), np.int64).reshape(len(ids), dim)
    by_id = np.argsort(ids, kind="stable")
    ids, vectors = ids[by_id], vectors[by_id]
    order, nodes, centres, radii = build(vectors)
    pack = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
    return pa.table({**{n: table.column(n)[:1] for n in _SHARD}, "ids": pack(ids[order]), "vectors": pack(vectors[order]), "nodes": pack(nodes), "centres": pack(centres), "radii": pack(radii)})


_SHARD = ["dim", "cell", "shard"]
_PACKED = "dim bigint, cell bigint, shard bigint, ids binary, vectors binary, nodes binary, centres binary, radii binary"
_FOUND = "query_id bigint, vec_id bigint, score bigint"


def _search_task(k: int):
    def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
        if not shard.num_rows or not asked.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        dim = shard.column("dim")[0].as_py()
        query_ids = asked.column("vec_id").to_numpy()
        queries = np.frombuffer(b"".join(asked.column("v").to_pylist()), np.int64).reshape(-1, dim)
        floor = asked.column("floor").to_numpy()
        read = lambda name, kind: np.frombuffer(shard.column(name)[0].as_buffer(), kind)
        best = Best(len(queries), k)
        search(best, floor, queries, query_ids, read("vectors", np.int64).reshape(-1, dim), read("ids", np.int64), read("nodes", np.int64).reshape(-1, 4), read("centres", np.float64).reshape(-1, dim), read("radii", np.float64))
        row, col = np.nonzero((best.score > NO_SCORE) & (best.score >= floor[:, None]))
        return pa.table({"query_id": query_ids[row], "vec_id": best.vec[row, col], "score": best.score[row, col]})

    return run


def _searched(asked: DataFrame, packed: DataFrame, k: int, parts: int) -> DataFrame:
    """What queries (vec_id, v, floor, and the shard they go to) find there. A shard meets its queries in
    parts of bounded size."""
    keys = [*_SHARD, "part"]
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
    met = packed.join(asked.select(*keys).distinct().toDF(*keys), _SHARD).toDF(*_SHARD, "ids", "vectors", "nodes", "centres", "radii", "part")
    return met.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search_task(k), _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; Spark keeps k of each before it shuffles."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every row whose id is divisible by `every`: the k
    highest inner products with all other rows, ties to the smaller id, all if there are fewer.

    Components become floor(scale * x). Rows take no part if the id or vector is null or empty, or a
    component is null or not finite; rows of another dimension are compared among themselves. A row
    is no candidate for a query of its own id; rows repeated under one id count once each as
    candidates and once as query, with the least vector. A component whose scaled value reaches 2^62, or a score that no bigint
    holds, is an error. An empty table gives an empty result; other columns are not read.
    """
    v = F.col(vector_col)
    whole = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fits = F.forall(v, lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) < F.lit(LARGEST))
    checked = F.when(fits, scaled).otherwise(F.raise_error(F.lit("a component is too large to be scaled")).cast("array<bigint>"))
    rows = vectors.where(F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("bigint").alias("vec_id"), checked.alias("v"))
    rows = rows.withColumn("dim", F.size("v").cast("bigint"))
    total = rows.count()
    model = _centres(rows, min(CELLS, max(1, total // SHARD_ROWS)))
    dealt = cut(rows.mapInArrow(_dealt(model), "vec_id bigint, dim bigint, cell bigint, dist double, v binary"))
    cells = dealt.groupBy("dim", "cell").agg(F.max("dist").alias("radius"), F.ceil(F.count(F.lit(1)) / F.lit(SHARD_ROWS)).alias("shards"))
    placed = dealt.join(cells.drop("radius"), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), "shards"))
    packed = cut(placed.select("vec_id", "v", *_SHARD).groupBy(*_SHARD).applyInArrow(_pack_shard, _PACKED))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "dim").agg(F.min("v").alias("v")).mapInArrow(_dealt(model), "vec_id bigint, dim bigint, cell bigint, dist double, v binary").drop("cell", "dist")
    bounds = cut(asked.join(cells, "dim").mapInArrow(_bounded(model), "dim bigint, vec_id bigint, v binary, cell bigint, radius double, shards bigint, bound double"))
    parts = max(1, -(-total // every // QUERY_ROWS))
    own = Window.partitionBy("vec_id", "dim").orderBy(F.desc("bound"), "cell")  # at most CELLS rows each
    nearest = bounds.withColumn("nth", F.row_number().over(own)).where("nth = 1").withColumn("shard", F.pmod(F.xxhash64("vec_id"), "shards"))
    first = cut(_searched(nearest.select("vec_id", "v", *_SHARD, F.lit(NO_SCORE).alias("floor")), packed, k, parts))
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    floors = nearest.select("vec_id", "dim", F.col("cell").alias("done_cell"), F.col("shard").alias("done_shard")).join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    floors = floors.withColumn("floor", F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(NO_SCORE)))
    later = bounds.join(floors, ["vec_id", "dim"]).where("bound + 1e-6D * abs(bound) + 1e-3D >= floor").withColumn("shard", F.explode(F.expr("sequence(0L, shards - 1)")))
    later = later.where("not (cell = done_cell and shard = done_shard)").select("vec_id", "v", *_SHARD, "floor")
    found = first.union(_searched(later, packed, k, parts))
    return _top(found, k).select("query_id", "rank", "vec_id", "score")


def op6_ball_tree(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
