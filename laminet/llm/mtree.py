"""Exact top-k search by inner product with M-trees.

Components are quantised to floor(SCALE * x). Adding one component, sqrt(M - |x|^2) with M the greatest squared length,
puts all candidates on a sphere; there the nearest to a query (with 0 added) are those with the highest inner product:
|q - x|^2 = |q|^2 + M - 2 q.x. That distance is a metric, so M-trees can index it.

The first level deals the candidates to the nearest of a bounded number of pivots, and what a pivot has into pages of at
most about PAGE rows each; every page is a subtree with router objects, covering radii and distances to the parents, and leaves of LEAF rows. A query
first searches the page that its nearest pivots point to, and takes the k-th score found as its bound; then it goes to those other pages that
the triangle inequality can't rule out by it. Within a page the search is best first, and stored distances to
the parent spare the computing of distances. Scores are integers and so exact; bounds are widened by a small slack against rounding.

Cases: vectors that are null, empty, of another length than most, or hold null or non-finite components take no part, as
query or candidate; ties go to the smaller id; with fewer than k candidates all are returned; a query leaves out rows of its own id;
rows that repeat an id are candidates each; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminet.llm.common import cut

SCALE = 1024
PIVOTS = 64
PAGE = 2048
LEAF = 64
#: Queries that meet a page in one task, on average.
QUERIES = 1024
SLACK = 1e-6


class Node:
    """A page: of a leaf its rows and their distances to the router, else the children with routers, radii and distances."""

    __slots__ = ("router", "radius", "rows", "children", "routers", "radii", "parent")

    def __init__(self, router: np.ndarray):
        self.router, self.radius, self.rows, self.children = router, 0.0, None, None
        self.routers = self.radii = self.parent = None


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = x - p
    return np.sqrt((d * d).sum(-1))


def build(x: np.ndarray, rows: np.ndarray, router: np.ndarray, rng: np.random.Generator, leaf: int = LEAF) -> Node:
    """x: rows with the added component. Splits by the nearest of a few router objects until a leaf holds what is left."""
    node = Node(router)
    d = distances(x[rows], router)
    node.radius = float(d.max(initial=0.0))
    ways = min(8, -(-len(rows) // leaf))
    if ways > 1:
        picks = x[rng.choice(rows, ways, replace=False)]
        near = np.stack([distances(x[rows], p) for p in picks]).argmin(0)
        parts = [(p, rows[near == k]) for k, p in enumerate(picks) if (near == k).any()]
        if len(parts) > 1:
            node.children = [build(x, part, p, rng, leaf) for p, part in parts]
            node.routers = np.stack([c.router for c in node.children])
            node.radii = np.array([c.radius for c in node.children])
            node.parent = distances(node.routers, router)
            return node
    node.rows, node.parent = rows, d
    return node


class Best:
    """The k best (score, id) so far: higher scores first, then smaller ids."""

    def __init__(self, k: int, floor: float):
        self.k, self.floor, self.heap = k, floor, []

    def worst(self) -> float:
        """A score below this can't get in any more."""
        return max(self.floor, self.heap[0][0]) if len(self.heap) >= self.k else self.floor

    def put(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = np.flatnonzero(scores >= self.worst())
        for s, i in sorted(zip(scores[keep].tolist(), ids[keep].tolist(), strict=True), key=lambda x: (-x[0], x[1])):
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, (s, -i))
            elif (s, -i) > self.heap[0]:
                heapq.heapreplace(self.heap, (s, -i))
            else:
                break


def search(tree: Node, x: np.ndarray, raw: np.ndarray, ids: np.ndarray, q: np.ndarray, q_id: int, top: float, best: Best) -> None:
    """Best-first search of one page. x: rows with the added component (raw without), q: the query without, top: M."""
    at = np.append(q, 0.0).astype(np.float64)
    qq = float(at @ at)
    far = lambda: np.sqrt(max(0.0, qq + top - 2.0 * best.worst())) * (1 + SLACK) + SLACK if best.worst() > -np.inf else np.inf
    d0 = float(distances(tree.router, at))
    heap, count = [(max(0.0, d0 - tree.radius), 0, d0, tree)], 1
    while heap:
        low, _, d, node = heapq.heappop(heap)
        limit = far()
        if low > limit:
            return
        if node.children is not None:
            open_ = np.flatnonzero(np.abs(d - node.parent) - node.radii <= limit)
            for c, dc in zip(open_.tolist(), distances(node.routers[open_], at).tolist(), strict=True):
                low = max(0.0, dc - node.radii[c])
                if low <= limit:
                    heapq.heappush(heap, (low, count, dc, node.children[c]))
                    count += 1
        else:
            rows = node.rows[np.abs(d - node.parent) <= limit]
            rows = rows[ids[rows] != q_id]
            best.put(raw[rows] @ q, ids[rows])


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: int = SCALE) -> DataFrame:
    """(id, v array<long>) of the vectors that take part."""
    v = F.col(embedding)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.where(v.isNotNull() & F.col(vec_id).isNotNull() & fine & (F.size(v) > 0))
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank int, vec_id, score long) for the rows for which is_query, a condition on the column id, holds."""
    spark = vectors.sparkSession
    rows = cut(quantised(vectors, vec_id, embedding), "quantised")
    out = "query_id long, vec_id long, score long"
    top, n = rows.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    picks = min(PIVOTS, max(1, n // PAGE))
    drawn = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id")).select("v").limit(picks).collect()], np.float64)
    pivots = np.column_stack([drawn, np.sqrt(np.maximum(0.0, top - (drawn * drawn).sum(1)))])
    shared = spark.sparkContext.broadcast((pivots, float(top)))  # at most PIVOTS rows

    def lifted(raw: np.ndarray, top: float) -> np.ndarray:
        f = raw.astype(np.float64)
        return np.column_stack([f, np.sqrt(np.maximum(0.0, top - (f * f).sum(1)))])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, m = shared.value
        for g in batches:
            x = lifted(_matrix(g["v"]), m)
            d = np.stack([distances(x, y) for y in p], 1)
            near = d.argmin(1)
            yield g.assign(pivot=near.astype(np.int32), far=d[np.arange(len(g)), near])

    placed = cut(rows.mapInPandas(deal, "id long, v array<long>, pivot int, far double"), "placed")
    counts = placed.groupBy("pivot").agg(F.ceil(F.count("*") / PAGE).alias("pages"))
    paged = placed.join(counts, "pivot").withColumn("page", F.pmod(F.xxhash64("id"), F.col("pages")))
    paged = cut(paged.select("id", "v", "pivot", "page", "far"), "paged")
    covers = cut(paged.groupBy("pivot", "page").agg(F.max("far").alias("radius")), "covers")
    ask = rows.where(is_query)

    def to_pivots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, _ = shared.value
        for g in batches:
            x = np.column_stack([_matrix(g["v"]).astype(np.float64), np.zeros(len(g))])
            d = np.stack([distances(x, y) for y in p], 1)
            order = np.argsort(np.argsort(d, 1, kind="stable"), 1)
            many = g.loc[g.index.repeat(d.shape[1])]
            yield many.assign(pivot=np.tile(np.arange(d.shape[1], dtype=np.int32), len(g)), d=d.ravel(), near=order.ravel().astype(np.int32))

    routes = ask.mapInPandas(to_pivots, "id long, v array<long>, pivot int, d double, near int").join(covers, "pivot")
    first = Window.partitionBy("id").orderBy("near", "page")
    routes = cut(routes.withColumn("turn", F.row_number().over(first)), "routes")
    blocks = max(1, -(-ask.count() // QUERIES))

    def run(key, g):
        _, m = shared.value
        data, asks = g[~g["query"]], g[g["query"]]
        found: list[tuple[int, int, int]] = []
        if len(data) and len(asks):
            data = data.sort_values("id", kind="stable")
            raw, ids = _matrix(data["v"]), data["id"].to_numpy(np.int64)
            x = lifted(raw, m)
            tree = build(x, np.arange(len(x)), x.mean(0), np.random.default_rng(3))
            for q_id, q, floor in zip(asks["id"], _matrix(asks["v"]), asks["floor"], strict=True):
                best = Best(k, -np.inf if np.isnan(floor) else float(floor))
                search(tree, x, raw, ids, q, int(q_id), m, best)
                found += [(int(q_id), -i, s) for s, i in best.heap]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    def searched(asks: DataFrame) -> DataFrame:
        """asks: (id, v, pivot, page, floor)."""
        number = F.sequence(F.lit(0), F.lit(blocks - 1))
        q = asks.select("id", "v", "pivot", "page", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"), F.col("floor").cast("double").alias("floor"), F.lit(True).alias("query"))
        d = paged.select("id", "v", "pivot", "page", F.explode(number).alias("b"), F.lit(None).cast("double").alias("floor"), F.lit(False).alias("query"))
        return q.unionByName(d).groupBy("pivot", "page", "b").applyInPandas(run, out)

    near = cut(searched(routes.where("turn = 1").withColumn("floor", F.lit(None))), "near")
    bound = near.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).select("id", F.col("s").alias("floor"))
    rest = routes.where("turn > 1").join(bound, "id", "left")
    qq = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    reach = F.sqrt(F.greatest(F.lit(0.0), qq + F.lit(float(top)) - 2 * F.col("floor"))) * (1 + SLACK) + SLACK
    rest = rest.where(F.col("floor").isNull() | (F.col("d") - F.col("radius") <= reach))
    both = near.unionByName(searched(rest))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
