"""Nearest neighbours by a block matrix join (operator 5).

Vectors are dealt into cells around pivots, a bounded sample of them, and cells into blocks of bounded bytes. A block of
queries meets a block of candidates in a task of its own: matrix products of int8 codes give all distances of the tile
with bounds on the quantisation error, so that pairs which can't be among the nearest go; the others are recomputed in
double precision and a heap of each query keeps the nearest.

1. Queries meet the candidates of their own cell. That bounds how far a query's nearest can be.
2. By the triangle inequality a cell whose ball lies beyond a query's bound holds none of its nearest; queries only
   travel to the other cells. Where vectors are clustered these are few; where they aren't, all blocks meet.
3. The tiles' lists are merged by query, nearest first, each tile bringing k rows at most.

The result is exact. Defined results: vectors that are null, all zero, or hold null or non-finite components take no
part, nor do rows without an id; rows with a query's own id are no candidates of it; rows repeated with one vec_id take
part each for itself: as candidates they are found each, and as queries their lists are merged to one; ties go to the
smaller id; vectors of different lengths are compared only with their like; with fewer candidates than asked for all
are given; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

NEAREST, EVERY = 10, 100
#: Bytes of a block of candidates and of queries, about; sides of a matrix product; least candidates of a block.
CANDIDATES, QUERIES = 24 << 20, 6 << 20
STEP, ROWS = 2_048, 512
FEW = 1_024
#: Pivots at most, and their bytes; cells of vectors whose length no pivot has.
PIVOTS, PIVOT_BYTES, OTHERS = 1_024, 16 << 20, 64
#: Relative error that double precision may make in the bounds.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, each vector's scale, and the length of what the codes leave out."""
    with np.errstate(over="ignore", invalid="ignore"):
        scale = np.abs(x).max(axis=1) / 127
        codes = np.rint(x / scale[:, None]).astype(np.int8)
        lost = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, lost


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(place of the query, candidate, distance) of each query's k nearest candidates of this tile."""
    exact = np.float32 if q.shape[1] * 127 * 127 < 2**24 else np.float64  # integers that the product holds exactly
    qc, qs, qe = quantised(q)
    cc, cs, ce = quantised(c)
    qn, cn = ((x.astype(np.float64) ** 2).sum(axis=1) * s**2 for x, s in ((qc, qs), (cc, cs)))
    out = []
    for a in range(0, len(q), ROWS):
        rows = slice(a, a + ROWS)
        heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids[rows]]  # of (-distance, -id): the worst on top
        worst = np.full(len(heaps), np.inf)
        left = qc[rows].astype(exact)
        for i in range(0, len(c), STEP):
            cols = slice(i, i + STEP)
            dots = (left @ cc[cols].astype(exact).T).astype(np.float64)
            near = np.sqrt(np.maximum(0, qn[rows, None] + cn[None, cols] - 2 * dots * qs[rows, None] * cs[None, cols]))
            slack = (qe[rows, None] + ce[None, cols]) + SLACK * (np.sqrt(qn[rows])[:, None] + near + 1e-300)
            own = q_ids[rows, None] == c_ids[None, cols]
            at_most = near + slack
            at_most[own] = np.inf
            limit = worst
            if near.shape[1] >= k:
                limit = np.minimum(worst, np.partition(at_most, k - 1, axis=1)[:, k - 1])
            left_over = ((near - slack <= limit[:, None]) | ~np.isfinite(near)) & ~own
            _recompute(*np.nonzero(left_over), q[rows], c[cols], c_ids[cols], heaps, worst, k)
        out += [(i, -b, -d) for i, h in enumerate(heaps, a) for d, b in sorted(h, reverse=True)]
    return out


def _recompute(rows: np.ndarray, cols: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, heaps: list, worst: np.ndarray, k: int) -> None:
    """Exact distances of the surviving pairs; the nearest go to their query's heap."""
    for a in range(0, len(rows), 65_536):
        r, s = rows[a:a + 65_536], cols[a:a + 65_536]
        d = np.sqrt(((q[r] - x[s]) ** 2).sum(axis=1))
        order = np.lexsort((ids[s], d, r))
        r, s, d = r[order], s[order], d[order]
        pick = np.arange(len(r)) - np.searchsorted(r, r) < k  # more than k of one query and chunk can't be wanted
        for row, col, dist in zip(r[pick].tolist(), s[pick].tolist(), d[pick].tolist(), strict=True):
            h, item = heaps[row], (-dist, -int(ids[col]))
            if len(h) < k:
                heapq.heappush(h, item)
            elif item > h[0]:
                heapq.heapreplace(h, item)
            if len(h) == k:
                worst[row] = -h[0][0]


class Cells:
    """Pivots by the length of vectors; cells are numbered through. Vectors of other lengths have cells below 0."""

    def __init__(self, pivots: list[list[float]]):
        self.pivots: dict[int, tuple[int, np.ndarray]] = {}
        first = 0
        for n in sorted({len(p) for p in pivots}):
            same = np.unique(np.array([p for p in pivots if len(p) == n], dtype=float), axis=0)
            self.pivots[n] = first, same
            first += len(same)

    def other(self, n: int) -> int:
        return -1 - n % OTHERS

    def distances(self, x: np.ndarray) -> np.ndarray:
        """From each of x (rows of one length) to each pivot of that length."""
        _, pivots = self.pivots[x.shape[1]]
        with np.errstate(over="ignore", invalid="ignore"):
            return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)

    def placed(self, vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and how far it is from the pivot."""
        cell, far = np.empty(len(vectors), np.int64), np.full(len(vectors), np.inf)
        sizes = vectors.map(len).to_numpy()
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            if n in self.pivots:
                d = self.distances(np.stack(vectors.iloc[at].to_list()))
                best = np.where(np.isnan(d), np.inf, d).argmin(axis=1)
                cell[at], far[at] = self.pivots[n][0] + best, np.where(np.isnan(m := d[np.arange(len(at)), best]), np.inf, m)
            else:
                cell[at] = self.other(int(n))
        return cell, far

    def reached(self, vectors: pd.Series, own: np.ndarray, bound: np.ndarray, radius: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
        """(place of the query, cell) of all cells besides its own that may hold one of a query's nearest."""
        sizes, rows, cells = vectors.map(len).to_numpy(), [], []
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            if n not in self.pivots:
                continue  # all of that length are in one cell
            first, pivots = self.pivots[n]
            d = self.distances(np.stack(vectors.iloc[at].to_list()))
            r = np.array([radius.get(first + j, -1.0) for j in range(len(pivots))])
            with np.errstate(invalid="ignore"):
                beyond = d - r > bound[at, None] + SLACK * (d + r + bound[at, None])
            go = ~beyond & (r >= 0) & (first + np.arange(len(pivots)) != own[at, None])
            i, j = np.nonzero(go)
            rows.append(at[i])
            cells.append(first + j)
        return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *cells])


def nearest(queries: DataFrame, vectors: DataFrame, k: int = NEAREST, blocks: tuple[int, int] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest vectors; both tables have vec_id and embedding.

    blocks: of the queries that meet in a cell, and cells; by default as many as their bytes ask for, and cells enough
    to use all tasks.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    c = clean(vectors)
    size = c.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("x")), F.lit(1)).alias("d")).first()
    width = 8 * max(1, size["d"])
    wanted = blocks[1] if blocks else max(1, min(PIVOTS, PIVOT_BYTES // width, max(math.ceil(size["n"] * width / CANDIDATES), min(common.partitions(spark), size["n"] // FEW))))
    cells = Cells([r["x"] for r in c.orderBy(F.xxhash64("id"), "id").select("x").limit(wanted).collect()])  # PIVOT_BYTES at most

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            cell, far = cells.placed(rows["x"])
            yield rows.assign(cell=cell, far=far)
        common.release()

    c = common.written(c.mapInPandas(place, "id long, x array<double>, cell long, far double"), "cells")
    q = clean(queries).withColumn("uid", F.monotonically_increasing_id()).select("id", "x", "uid")
    q = common.written(q.mapInPandas(place, "id long, x array<double>, uid long, cell long, far double").drop("far"), "queries")
    balls = {r["cell"]: r for r in c.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}  # as many as cells
    radius = {cell: r["far"] for cell, r in balls.items()}
    parts = {cell: max(1, math.ceil(r["n"] * width / CANDIDATES)) for cell, r in balls.items()}

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            sizes = left["x"].map(len), right["x"].map(len)
            for n in sorted(set(sizes[0]) & set(sizes[1])):
                a, b = left[sizes[0] == n], right[sizes[1] == n]
                ids, uids = a["id"].to_numpy(), a["uid"].to_numpy()
                found = tile(ids, np.stack(a["x"].to_list()), b["id"].to_numpy(), np.stack(b["x"].to_list()), k)
                out += [(int(uids[i]), int(ids[i]), v, score) for i, v, score in found]
        return pd.DataFrame(out, columns=["uid", "query_id", "vec_id", "score"])

    def met(visits: DataFrame, name: str) -> DataFrame:
        """Each query with the candidates of the cell that it visits."""
        counts = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as cells
        plan = [(cell, parts[cell], blocks[0] if blocks else math.ceil(n * width / QUERIES)) for cell, n in counts.items() if cell in parts]
        plan = F.broadcast(spark.createDataFrame(plan, "cell long, cbs int, qbs int"))
        block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = visits.join(plan, "cell").withColumn("qb", block("qbs", 1)).withColumn("cb", every("cbs")).select("cell", "qb", "cb", "id", "uid", "x")
        right = c.join(plan, "cell").withColumn("cb", block("cbs", 2)).withColumn("qb", every("qbs")).select("cell", "qb", "cb", "id", "x")
        key = ["cell", "qb", "cb"]
        return common.written(left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(run, "uid long, query_id long, vec_id long, score double"), name)

    own = met(q, "near")
    bound = own.groupBy("uid").agg(F.try_element_at(F.array_sort(F.collect_list("score")), F.lit(k)).alias("bound"))  # k for each block of a cell

    def travel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            i, cell = cells.reached(rows["x"], rows["cell"].to_numpy(), rows["bound"].fillna(np.inf).to_numpy(float), radius)
            yield rows.iloc[i][["id", "x", "uid"]].assign(cell=cell)
        common.release()

    far = q.join(bound, "uid", "left").select("id", "x", "uid", "cell", "bound")
    visits = common.written(far.mapInPandas(travel, "id long, x array<double>, uid long, cell long"), "visits")
    found = own.unionByName(met(visits, "far"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    rows = common.table(spark, sf_dir, "embeddings")
    found = nearest(rows.where(F.col("vec_id") % EVERY == 0), rows)
    common.restore(spark)
    return found


SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 100 = 0),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
