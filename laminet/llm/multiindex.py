"""Near-duplicate vectors by an inverted multi-index.

Vectors are scaled to length 1 and cut into halves; each half has a codebook of its own, fitted by k-means on a bounded
sample (SAMPLE vectors at most), and the pairs of codes form the grid of cells. Every vector is indexed in its own cell. As
a query it visits cells in ascending order of how far, squared, it lies beyond the borders between its own codes and theirs
(multi-sequence traversal of the two sorted lists), up to a reach. The reach is set so that RECALL or more would be found both of
pairs at exactly the least cosine, made from the sample by turning vectors in random directions, and of the true pairs of PROBES
sample vectors with all vectors, found by brute force: where vectors vary in few directions, random ones cross borders by less.
What a visit finds is verified by the cosine in double precision.

A pair is found if either visits the other's cell, and counted once for each. Equal vectors are one entry with a
number of copies. A cell's entries and its visitors are dealt into blocks, so that a hot cell is many tasks;
a block returns link counts and a spanning set of its links, never its pairs.

Cases: vectors that are null, of no length, of another length than most, or hold null or non-finite components link with
nothing; repeated ids are counted as separate vectors with the same id; an empty table gives an empty one; labels and any
other columns aren't looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminet.llm.common import cut
from laminet.llm.components import components

COSINE = 0.95
RECALL = 0.998
SAMPLE = 4096
#: Sample vectors whose true pairs the reach is set by, and steps of its logarithm in an octave (it is rounded up).
PROBES, STEPS = 2048, 64
#: Entries of a cell that it should hold on average, and codes that a half may have.
CELL, MOST_CODES = 64, 512
BLOCK = 512


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        code = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        for j in np.unique(code):
            c[j] = x[code == j].mean(0)
    return c


def beyond(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest code of each row, and by code the squared distance to the border between that and the nearest (0 for it)."""
    d = (c * c).sum(1) - 2 * x @ c.T
    code = d.argmin(1)
    apart = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(2), 1e-12))
    h = (d - d[np.arange(len(x)), code][:, None]) / (2 * apart[code])
    return code, h * h


def visits(h1: np.ndarray, h2: np.ndarray, reach: float) -> Iterator[tuple[int, int]]:
    """Pairs of codes in ascending order of h1[i] + h2[j], up to reach."""
    a, b = np.argsort(h1, kind="stable"), np.argsort(h2, kind="stable")
    s, t = h1[a].tolist(), h2[b].tolist()
    heap = [(s[0] + t[0], 0, 0)]
    while heap and heap[0][0] <= reach:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        if j + 1 < len(t):
            heapq.heappush(heap, (s[i] + t[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(s):
            heapq.heappush(heap, (s[i + 1] + t[0], i + 1, 0))


class Index:
    """Two codebooks and the reach."""

    def __init__(self, sample: np.ndarray, entries: int, cosine: float = COSINE, recall: float = RECALL, seed: int = 11):
        self.half = sample.shape[1] // 2
        k = int(np.clip(np.ceil(np.sqrt(entries / CELL)), 1, MOST_CODES))
        self.books = [kmeans(part, k) for part in (sample[:, : self.half], sample[:, self.half :])]
        rng = np.random.default_rng(seed)
        near = sample[rng.integers(0, len(sample), 4000)]
        away = rng.standard_normal(near.shape)
        away -= (away * near).sum(1, keepdims=True) * near
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
        turned = cosine * near + np.sqrt(1 - cosine**2) * away
        self.reach = float(np.quantile(np.minimum(self.cost(near, *self.codes(turned)), self.cost(turned, *self.codes(near))), recall)) + 1e-9

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return beyond(x[:, : self.half], self.books[0])[0], beyond(x[:, self.half :], self.books[1])[0]

    def cost(self, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """By row of x, what it costs to visit cell (i, j)."""
        at = np.arange(len(x))
        return beyond(x[:, : self.half], self.books[0])[1][at, i] + beyond(x[:, self.half :], self.books[1])[1][at, j]

    def cells(self, x: np.ndarray) -> list[list[tuple[int, int]]]:
        """The cells that each row visits, its own first."""
        h1, h2 = beyond(x[:, : self.half], self.books[0])[1], beyond(x[:, self.half :], self.books[1])[1]
        return [list(visits(p, q, self.reach)) for p, q in zip(h1, h2, strict=True)]


def unit(vectors: list[list[float]]) -> np.ndarray:
    x = np.array(vectors, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    v = F.col(embedding)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(v.isNotNull() & fine & F.col(vec_id).isNotNull())
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def block_links(x: np.ndarray, y: np.ndarray, found: np.ndarray, ids_x: np.ndarray, ids_y: np.ndarray) -> list[tuple[int, int]]:
    """Links (a, b) that join what the marked pairs of a block join: at most one for each of its entries."""
    some = np.flatnonzero(found.any(1))
    if not len(some):
        return []
    label_x, label_y = ids_x.copy(), ids_y.copy()
    big = np.iinfo(np.int64).max
    while True:
        new_y = np.minimum(label_y, np.where(found, label_x[:, None], big).min(0))
        new_x = np.minimum(label_x, np.where(found, new_y[None, :], big).min(1))
        if (new_x == label_x).all() and (new_y == label_y).all():
            break
        label_x, label_y = new_x, new_y
    out = {(int(m), int(i)) for i, m in (*zip(ids_x, label_x, strict=True), *zip(ids_y, label_y, strict=True)) if i != m}
    return sorted(out)


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row for each row of vectors: id, n_links long, component_id long, kept boolean."""
    spark = vectors.sparkSession
    good = usable(vectors, vec_id, embedding)
    entries = cut(good.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "entries")
    n = entries.count()
    links = counts = None
    if n > 1:
        rows = entries.select("v", "id").orderBy(F.xxhash64("id")).limit(SAMPLE).collect()
        drawn = unit([r["v"] for r in rows])
        index = Index(drawn, n, cosine)
        index.reach = max(index.reach, true_reach(entries, index, drawn[:PROBES], np.array([r["id"] for r in rows[:PROBES]]), cosine))
        found = cut(search(entries, index, cosine), "found")
        links = found.where("b is not null").select("a", "b")
        counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    keyed = good.select("id", "v").distinct()
    head = entries.select(F.col("v"), F.col("id").alias("head"), "copies")
    if links is not None:
        at = components(links)
        head = head.join(at.withColumnRenamed("id", "head"), "head", "left").join(counts.withColumnRenamed("a", "head"), "head", "left")
    else:
        head = head.withColumns({"component": F.lit(None).cast("long"), "n": F.lit(None).cast("long")})
    head = head.select(F.col("v").alias("hv"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("component", "head").alias("component"))
    per = keyed.join(head, keyed["v"] == head["hv"]).select(F.col("id").alias("i"), F.col("v").alias("kv"), "links", "component")
    out = own.join(per, (F.col("vec_id") == F.col("i")) & (F.col("v") == F.col("kv")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def true_reach(entries: DataFrame, index: Index, probes: np.ndarray, ids: np.ndarray, cosine: float, recall: float = RECALL) -> float:
    """The reach by which that share of the pairs of probes and entries (v, id, copies) is found; 0 if there are none."""
    halves = [beyond(probes[:, : index.half], index.books[0]), beyond(probes[:, index.half :], index.books[1])]
    shared = entries.sparkSession.sparkContext.broadcast((index, probes, ids, halves))  # of bounded size

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, x, ids_x, ((i1, h1), (i2, h2)) = shared.value
        rough = x.astype(np.float32)
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                y = unit(batch.column(0).to_pylist())
                near = rough @ y.astype(np.float32).T >= cosine - 1e-5
                near &= ids_x[:, None] != batch.column(1).to_numpy()[None]
                some = np.flatnonzero(near.any(0))
                if not len(some):
                    continue
                y, near = y[some], near[:, some]
                (j1, g1), (j2, g2) = beyond(y[:, : ix.half], ix.books[0]), beyond(y[:, ix.half :], ix.books[1])
                i, j = np.nonzero(near)
                cost = np.minimum(h1[i, j1[j]] + h2[i, j2[j]], g1[j, i1[i]] + g2[j, i2[i]])
                step, n = np.unique(np.ceil(STEPS * np.log2(np.maximum(cost, 1e-12))).astype(np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(step, pa.int32()), pa.array(n, pa.int64())], ["step", "n"])

    seen = sorted((r["step"], r["n"]) for r in entries.select("v", "id").mapInArrow(costs, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).collect())
    left = recall * sum(n for _, n in seen)
    for step, n in seen:
        left -= n
        if left <= 0:
            return 2 ** (step / STEPS)
    return 0.0


def search(entries: DataFrame, index: Index, cosine: float) -> DataFrame:
    """entries (v, id, copies). Rows (a, b, null): links that join what is linked; rows (a, null, n): n vectors linked with a."""
    shared = entries.sparkSession.sparkContext.broadcast(index)  # two codebooks of bounded size

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                cells = ix.cells(unit(batch.column(0).to_pylist()))
                at = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
                flat = [(i, j, k == 0) for c in cells for k, (i, j) in enumerate(c)]
                take = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*take.columns, pa.array([i * MOST_CODES + j for i, j, _ in flat], pa.int32()), pa.array([o for *_, o in flat], pa.bool_())], ["v", "id", "copies", "cell", "own"])

    seen = cut(entries.select("v", "id", "copies").mapInArrow(visit, "v array<float>, id long, copies long, cell int, own boolean".replace("array<float>", dict(entries.dtypes)["v"])), "visits")
    sizes = seen.groupBy(F.col("cell").alias("c")).agg(F.ceil(F.sum(F.col("own").cast("int")) / BLOCK).alias("nd"), F.ceil(F.count("*") / BLOCK).alias("nq"))
    rows = seen.join(sizes, F.col("cell") == F.col("c")).where("nd > 0")
    # Entries meet every block of the cell's visitors, visitors every block of its entries; own entries are visitors too.
    spread = F.xxhash64("id")
    d = rows.where("own").select("v", "id", "copies", "cell", F.pmod(spread, "nd").alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("q"), F.lit(True).alias("entry"))
    q = rows.select("v", "id", "copies", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nd") - 1)).alias("d"), F.pmod(spread, "nq").alias("q"), F.lit(False).alias("entry"))

    def meet(key, g):
        ix = shared.value
        cell = int(key[0])
        e, w = g[g["entry"]], g[~g["entry"]]
        rows: list[tuple[int, int | None, int | None]] = []
        if len(e) and len(w):
            x, y = unit(list(w["v"])), unit(list(e["v"]))
            ids_x, ids_y, cx, cy = (s.to_numpy(np.int64) for s in (w["id"], e["id"], w["copies"], e["copies"]))
            near = (x @ y.T >= cosine) & (ids_x[:, None] != ids_y[None])
            if near.any():
                i, j = np.nonzero(near)
                own_i, own_j = ix.codes(x)
                # A visitor counts its links; the entry does so elsewhere if it visits back, else here.
                back = ix.cost(y[j], own_i[i], own_j[i]) <= ix.reach
                n_x = np.bincount(i, cy[j], len(x)).astype(np.int64)
                n_y = np.bincount(j[~back], cx[i[~back]], len(y)).astype(np.int64)
                rows += [(int(a), None, int(n)) for a, n in (*zip(ids_x, n_x, strict=True), *zip(ids_y, n_y, strict=True)) if n]
                rows += [(a, b, None) for a, b in block_links(x, y, near, ids_x, ids_y)]
        return pd.DataFrame({k: pd.array([r[t] for r in rows], "Int64") for t, k in enumerate(("a", "b", "n"))})

    return d.unionByName(q).groupBy("cell", "d", "q").applyInPandas(meet, "a long, b long, n long")
