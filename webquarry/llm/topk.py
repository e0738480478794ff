"""Exact top-k inner products by pivot-table elimination.

Vectors become integers, floor(64 x). Pivots come from a bounded sample of the rows. The
table of distances to the pivots bounds each distance from below by the largest
|d(q, p) - d(c, p)|, hence each inner product (|q|^2 + |c|^2 - d^2) / 2 from above.

Elimination works twice. Rows are dealt into cells by the nearest of some centres, and a
small table has the range of each cell's distances to its centre and to the pivots: a query
goes only to the cells whose best possible score reaches the query's floor, its k-th best
score in the sample. Inside a cell, candidates are evaluated in the order of their bound,
in growing steps (640, then four times as many as before; the whole block once more than a
quarter of it is left), until the k-th best score exceeds the next bound. Results are
exact. Large cells are parted into blocks, and many queries of a cell too: a block meets a
part of the queries in one task and returns at most k rows for a query. Equal vectors are
evaluated once, as only the smallest ids of them can rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PIVOTS, SAMPLE = 32, 1024
#: Cells at most, the first of whose centres are the pivots.
CELLS = 256
#: Rows of a block of candidates and of a block of queries.
BLOCK, QUERY_BLOCK = 8192, 4096
SCALE = 64


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, v) of the rows with an id whose vector is not null and holds finite components only."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("double"))
    return vectors.filter(F.col(id_col).isNotNull() & v.isNotNull()).filter(F.coalesce(finite, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), whole.alias("v")
    )


def _matrix(column, width: int) -> np.ndarray:
    """Rows as doubles, shorter vectors filled up with zeros."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first from the sample's first row."""
    if not len(sample):
        return sample
    chosen, far = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def exact_products(rows: np.ndarray, q: np.ndarray, largest: float) -> np.ndarray:
    """Integer inner products; in Python integers where doubles could round. ``largest``: of the rows' components."""
    top = largest * float(np.abs(q).max(initial=0)) * max(1, len(q))
    if top < 2**24:
        return (rows @ q.astype(rows.dtype)).astype(np.int64)
    if top < 2**52:
        rows = rows.astype(np.float64, copy=False)
        return (rows @ q).astype(np.int64)
    whole = [int(x) for x in q]
    return np.array([sum(int(a) * b for a, b in zip(r, whole)) for r in rows], dtype=object)


class Block:
    """Candidates with their pivot table. Ids are ascending; equal vectors are one row with its smallest ids."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, pivots: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order]
        first = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
        ids, rows = ids[first], rows[first]
        self.rows, at = np.unique(rows, axis=0, return_inverse=True) if len(ids) else (rows, np.zeros(0, int))
        order = np.argsort(at, kind="stable")
        self.ids = [x[: k + 1] for x in np.split(ids[order], np.cumsum(np.bincount(at, minlength=len(self.rows)))[:-1])] if len(ids) else []
        # a column for each pivot: a bound is one pass over some columns
        self.table = np.ascontiguousarray(_distances(self.rows, pivots).T, dtype=np.float32)
        self.far = float((pivots * pivots).sum(1).max(initial=0))
        self.square = (self.rows * self.rows).sum(1)
        self.largest = float(np.abs(self.rows).max(initial=0))
        if self.largest**2 * max(1, self.rows.shape[1]) < 2**24:
            self.rows = self.rows.astype(np.float32)  # products stay exact, and half as much is read
        self.k = k

    def top(self, query: int, q: np.ndarray, to_pivots: np.ndarray, floor: float) -> tuple[list[tuple], int]:
        """The k best (score, id) but the query's own, none below ``floor``; and how many rows were evaluated."""
        k, square = self.k, float((q * q).sum())
        low, apart = np.zeros(len(self.rows), np.float32), np.empty(len(self.rows), np.float32)
        for column, d in zip(self.table, to_pivots.astype(np.float32)):
            np.maximum(low, np.abs(np.subtract(column, d, out=apart), out=apart), out=low)
        # rounding: some units in the last place of the squared distances, in single precision
        bound = (square + self.square - low.astype(np.float64) ** 2) / 2 + 1e-5 * (square + self.square + self.far + 1)
        left = np.flatnonzero(bound >= floor)
        best: list[tuple] = []
        done, step = 0, 32 * k
        while len(left) and not (len(best) >= k and bound[left].max() < best[k - 1][0]):
            if step < len(left) // 2:  # the highest bounds of those left
                order = np.argpartition(-bound[left], step)
                some, left = left[order[:step]], left[order[step:]]
                scores = exact_products(self.rows[some], q, self.largest)
            else:
                some, left = left, left[:0]
                scores = exact_products(self.rows, q, self.largest)[some] if len(some) > len(self.rows) // 4 else exact_products(self.rows[some], q, self.largest)
            done, step = done + len(some), 4 * step
            least = best[k - 1][0] if len(best) >= k else floor
            if len(some) > 4 * k:  # none below the k-th score of these alone can rank
                least = max(least, np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1])
            for i in np.flatnonzero(scores >= least):
                best += [(int(scores[i]), int(x)) for x in self.ids[some[i]] if x != query]
            best.sort(key=lambda b: (-b[0], b[1]))
            del best[k:]
        return best, done


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _cells(points: np.ndarray, cells: int):
    """Adds to rows (id, v) their cell, squared length and distances to the pivots and to the cell's centre; ``points`` are pivots and centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, 2048):
            v = batch.column(1).to_pylist()
            rows = _matrix(v, width := max([points.shape[1], *map(len, v)]))
            d = _distances(rows, _wide(points, width))
            cell = d[:, :cells].argmin(axis=1)
            near = np.column_stack([d[:, :PIVOTS], d[np.arange(len(d)), cell]])
            arrays = [pa.array(cell, pa.int64()), pa.array((rows * rows).sum(1), pa.float64()), pa.array(list(near), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=["id", "v", "cell", "square", "d"])

    return run


class Ranges:
    """What is known of the cells: rows (cell, square, low, high), the largest squared length and the least and largest distances to the pivots and to the centre."""

    def __init__(self, rows: list, points: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int):
        self.cells, self.square = np.array([r.cell for r in rows], int), np.array([r.square for r in rows])
        self.low, self.high = np.array([r.low for r in rows]), np.array([r.high for r in rows])
        self.points, self.sample, self.sample_ids, self.k = points, sample, sample_ids, k
        self.largest = float(np.abs(sample).max(initial=0))

    def floor(self, query: int, q: np.ndarray, sample: np.ndarray) -> float:
        """The k-th best score among the sample's rows but the query's own, as they are candidates too."""
        others = exact_products(sample, q, self.largest)[self.sample_ids != query]
        if len(others) < self.k:
            return -np.inf
        floor = float(np.partition(others.astype(float), len(others) - self.k)[len(others) - self.k])
        return floor - abs(floor) * 1e-12

    def reached(self, q: np.ndarray, to_points: np.ndarray, floor: float) -> list[int]:
        """The cells in which a row could score ``floor`` or more."""
        if not len(self.cells):
            return []
        pivots = to_points[:PIVOTS]
        apart = np.column_stack([np.broadcast_to(pivots, (len(self.cells), len(pivots))), to_points[self.cells]])
        low = np.maximum(np.maximum(apart - self.high, self.low - apart).max(axis=1), 0)
        square = float((q * q).sum())
        # rounding: distances near zero carry the root of the squares' rounding
        bound = (square + self.square - low**2) / 2 + 1e-6 * (square + self.square + float(to_points.max()) ** 2 + 1)
        return self.cells[bound >= floor].tolist()

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries (id, v) with their floor and the cells that they must meet."""
        for batch in C.slices(batches, 1024):
            v = batch.column(1).to_pylist()
            rows = _matrix(v, width := max([self.points.shape[1], *map(len, v)]))
            d, sample = _distances(rows, _wide(self.points, width)), _wide(self.sample, width)
            floors = [self.floor(i, q, sample) for i, q in zip(batch.column(0).to_pylist(), rows)]
            cells = [self.reached(q, x, f) for q, x, f in zip(rows, d, floors)]
            arrays = [pa.array(floors, pa.float64()), pa.array(cells, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=["id", "v", "floor", "cells"])


def _search(pivots: np.ndarray, k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        width = max([len(v) for v in [*queries["v"], *rows["v"]]] + [pivots.shape[1]])
        p = _wide(pivots, width)
        ids, q, out = queries["id"].to_numpy(np.int64), _matrix(queries["v"], width), []
        to_pivots = _distances(q, p)
        block = Block(rows["id"].to_numpy(np.int64), _matrix(rows["v"], width), p, k)
        for i, x in enumerate(ids):
            out += [(int(x), b, s) for s, b in block.top(int(x), q[i], to_pivots[i], float(queries["floor"].iloc[i]))[0]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` highest integer inner products of each query, ties to the smaller id.

    Vectors that are null or hold a null or non-finite component, and rows without id, take
    no part. Of rows that repeat an id one counts (the one with the smallest vector). Shorter
    vectors count as filled up with zeros. Products beyond the range of a long are an error.
    Tables with fewer candidates return all of them; empty ones no rows.
    """
    once = lambda df: quantised(df, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    rows, asked = C.written(once(vectors), "vectors"), once(queries)
    n = rows.count()
    # bounded: SAMPLE rows, whatever the table's size
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    sample = _matrix([r.v for r in some], max((len(r.v) for r in some), default=0))
    sample_ids = np.array([r.id for r in some], np.int64)
    cells = max(1, min(CELLS, 2 * n // BLOCK))
    points = choose_pivots(sample, max(PIVOTS, cells))  # each farthest from those before: the first ones are pivots, and centres
    celled = rows.mapInArrow(_cells(points, cells), "id long, v array<double>, cell long, square double, d array<double>")
    celled = C.written(celled, "cells")
    each = [F.col("d")[j] for j in range(min(PIVOTS, len(points)) + 1)]
    known = celled.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("square").alias("square"), F.array(*map(F.min, each)).alias("low"), F.array(*map(F.max, each)).alias("high")
    ).collect()  # at most CELLS rows
    asked = C.written(asked.mapInArrow(Ranges(known, points, sample, sample_ids, k), "id long, v array<double>, floor double, cells array<long>"), "queries")
    going = dict(asked.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect())
    # cells that no query must meet do not move; others are blocks times parts of their queries
    plan = [(r.cell, -(-r.n // BLOCK), -(-going[r.cell] // QUERY_BLOCK)) for r in known if r.cell in going]
    plan = F.broadcast(vectors.sparkSession.createDataFrame(plan, "cell long, blocks long, parts long"))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    dealt_rows = celled.join(plan, "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), upto("parts").alias("part"))
    dealt_asked = asked.withColumn("cell", F.explode("cells")).join(plan, "cell").select(
        "id", "v", "floor", "cell", upto("blocks").alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).alias("part")
    )
    key = ("cell", "block", "part")
    found = dealt_asked.groupBy(*key).cogroup(dealt_rows.groupBy(*key)).applyInPandas(_search(points[:PIVOTS], k), "query_id long, vec_id long, score long")
    order = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)")
    return found.withColumn("rank", order).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
