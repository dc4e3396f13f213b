"""Exact top-k by inner product over an index of pivot distances.

Vectors are of integers. Inner products become distances by one more
coordinate: with R the greatest norm, |q|^2 + R^2 - 2 q.x is the squared distance
of (q, 0) and (x, sqrt(R^2 - |x|^2)). Every vector is keyed by its nearest pivot and
its distance to it; vectors of a pivot lie in rings of bounded size. A query
first visits the rings that its own distances to the pivots put it nearest to. Its
k-th best distance so far then bounds the rest: by the triangle inequality a ring
[lo, hi] of pivot p holds nothing nearer than max(lo - d(q, p), d(q, p) - hi).
All rings that this does not rule out are visited next, which makes the result exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import written

#: Pivots: this many rows, chosen by a hash of their ids. Every row is indexed by them.
PIVOTS = 24
RING_ROWS = 2048
QUERY_ROWS = 1024
#: Rings of the first visit.
FIRST = 2
_EPS = 1e-6


def as_integers(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``row, vec_id, v``: a number of its own, and floor(scale * x) of every component, x as double.

    Vectors that are null, empty or hold null or non-finite components, and rows without an
    id, are left out. Rows that share an id are all kept.
    """
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("double"))
    finite = ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)
    return good.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _distances(x: np.ndarray, lift: np.ndarray, p: np.ndarray, p_lift: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``x`` to those of ``p``, both with their further coordinate."""
    square = (x**2).sum(1)[:, None] + (lift**2)[:, None] + (p**2).sum(1) + p_lift**2
    square -= 2 * (x @ p.T) + 2 * lift[:, None] * p_lift
    return np.sqrt(np.maximum(square, 0))


class Pivots:
    """The pivots and the greatest squared norm."""

    def __init__(self, rows: np.ndarray, radius2: float):
        self.rows, self.radius2 = rows, radius2

    def _lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.radius2 - (x**2).sum(1), 0))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return _distances(x, self._lift(x), self.rows, self._lift(self.rows))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return _distances(q, np.zeros(len(q)), self.rows, self._lift(self.rows))


def _choose(rows: DataFrame, pivots: int) -> Pivots:
    radius2 = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0
    chosen = rows.select("v", F.xxhash64("row").alias("h"), "row").orderBy("h", "row").limit(pivots).collect()
    return Pivots(np.array([r["v"] for r in chosen], dtype=np.float64), float(radius2))


def _keyed(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """``row, vec_id, v, pivot, d``: the nearest pivot and the distance to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = pivots.of_rows(_matrix(batch["v"]))
                near = d.argmin(1)
                yield batch.assign(pivot=near.astype(np.int32), d=d[np.arange(len(d)), near])

    return rows.mapInPandas(run, "row long, vec_id long, v array<double>, pivot int, d double")


def _rings(keyed: DataFrame, ring_rows: int) -> DataFrame:
    """``pivot, at, cut, row, vec_id, v, d``: rings of equal width, those of too many rows dealt out by a hash."""
    sizes = keyed.groupBy("pivot").agg(
        F.min("d").alias("lo"), ((F.max("d") - F.min("d")) / F.ceil(F.count(F.lit(1)) / F.lit(ring_rows))).alias("width")
    )
    at = F.when(F.col("width") > 0, F.floor((F.col("d") - F.col("lo")) / F.col("width"))).otherwise(0).cast("int")
    # There are as many pivots as PIVOTS says.
    ringed = keyed.join(F.broadcast(sizes), "pivot").select("row", "vec_id", "v", "d", "pivot", at.alias("at"))
    cuts = ringed.groupBy("pivot", "at").agg(F.ceil(F.count(F.lit(1)) / F.lit(ring_rows)).alias("cuts"))
    cut = F.pmod(F.xxhash64("row"), F.col("cuts"))
    # One row for each ring of a pivot; joined without an exchange, so that the cuts of a ring are dealt apart.
    return ringed.join(F.broadcast(cuts), ["pivot", "at"]).select("pivot", "at", cut.alias("cut"), "row", "vec_id", "v", "d")


def _blocks(rows: DataFrame, keys: list[str], dims: int) -> DataFrame:
    """One row for each value of ``keys``: its rows' numbers, ids and vectors as bytes, and the range of ``d``."""

    def block(key: tuple, table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks().flatten().to_numpy().astype(np.float32)
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids)
        d = table.column("d").to_numpy()
        return pa.table(
            {
                **{k: pa.array([x.as_py()], x.type) for k, x in zip(keys, key, strict=True)},
                "names": [table.column("row").to_numpy()[order].tobytes()],
                "ids": [ids[order].tobytes()],
                "rows": [v.reshape(-1, dims)[order].tobytes()],
                "lo": [d.min()],
                "hi": [d.max()],
            }
        )

    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
    return rows.groupBy(*keys).applyInArrow(block, f"{kinds}, names binary, ids binary, rows binary, lo double, hi double")


def _best(score: np.ndarray, ids: np.ndarray, names: np.ndarray, query: np.ndarray, k: int) -> list[np.ndarray]:
    """Of every row of ``score``, the places of the ``k`` greatest, ties to the smaller id, without the query's own row."""
    out = []
    for s, q in zip(score, query, strict=True):
        allowed = np.flatnonzero(names != q)
        if len(allowed) > k:
            least = np.partition(s[allowed], len(allowed) - k)[len(allowed) - k]
            allowed = allowed[s[allowed] >= least]
        out.append(allowed[np.lexsort((ids[allowed], -s[allowed]))][:k])
    return out


def _visited(visits: DataFrame, k: int, dims: int) -> DataFrame:
    """``query, vec_id, score``: at most ``k`` rows of every visit and query, which is the number of its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_names, q_rows, mask, names, ids, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wanted = np.frombuffer(mask, dtype=bool)
                queries = np.frombuffer(q_names, dtype=np.int64)[wanted]
                q = np.frombuffer(q_rows, dtype=np.float32).reshape(-1, dims)[wanted].astype(np.float64)
                x = np.frombuffer(rows, dtype=np.float32).reshape(-1, dims).astype(np.float64)
                ids, score = np.frombuffer(ids, dtype=np.int64), q @ x.T
                found = _best(score, ids, np.frombuffer(names, dtype=np.int64), queries, k)
                size = [len(f) for f in found]
                at = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
                row = np.repeat(np.arange(len(found)), size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(queries[row]), pa.array(ids[at]), pa.array(score[row, at].astype(np.int64))],
                    names=["query", "vec_id", "score"],
                )

    columns = visits.select("q_names", "q_rows", "mask", "names", "ids", "rows")
    return columns.mapInArrow(run, "query long, vec_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _planned(blocks: DataFrame, pivots: Pivots, rings: np.ndarray, dims: int, first: int, second: bool) -> DataFrame:
    """Which rings each block of queries visits, with a mask of the queries that do.

    ``rings`` has pivot, at, cut, lo, hi of every ring. Blocks carry, for the
    second visit, ``far``: the squared distance of the k-th best so far of each query.
    """
    index, lo, hi = rings[:, 0].astype(int), rings[:, 3], rings[:, 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_names, q_rows, far in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q = np.frombuffer(q_rows, dtype=np.float32).reshape(-1, dims).astype(np.float64)
                d = pivots.of_queries(q)[:, index]
                bound = np.maximum(np.maximum(lo - d, d - hi), 0)
                nearest = np.zeros(bound.shape, dtype=bool)
                order = np.lexsort((np.abs(d - (lo + hi) / 2), bound), axis=1)[:, :first]
                np.put_along_axis(nearest, order, True, axis=1)
                if second:
                    limit = np.sqrt(np.maximum(np.frombuffer(far, dtype=np.float64), 0))
                    nearest = ~nearest & (bound <= limit[:, None] * (1 + _EPS) + _EPS)
                use = np.flatnonzero(nearest.any(0))
                if len(use):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(rings[use, 0].astype(np.int32)),
                            pa.array(rings[use, 1].astype(np.int32)),
                            pa.array(rings[use, 2].astype(np.int64)),
                            pa.array([q_names] * len(use), pa.binary()),
                            pa.array([q_rows] * len(use), pa.binary()),
                            pa.array([np.ascontiguousarray(nearest[:, j]).tobytes() for j in use], pa.binary()),
                        ],
                        names=["pivot", "at", "cut", "q_names", "q_rows", "mask"],
                    )

    return blocks.select("names", "rows", "far").mapInArrow(
        run, "pivot int, at int, cut long, q_names binary, q_rows binary, mask binary"
    )


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` greatest integer inner products of every query.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; candidates are all rows but the query's own, of
    vectors of the same length, each length having an index of its own. Ties go to the smaller id. For fewer
    candidates than ``k``, all are given. What takes no part is said at ``as_integers``. Rows that share an id are
    queries and candidates each for itself. An empty table gives no rows; columns other than ``vec_id`` and
    ``embedding`` are not read.
    """
    rows = written(as_integers(vectors, scale), "vectors")
    lengths = sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect())
    out = None
    for dims in lengths:
        found = _top_of_length(rows.where(F.size("v") == dims), dims, k, every)
        out = found if out is None else out.unionByName(found)
    return out or vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _top_of_length(rows: DataFrame, dims: int, k: int, every: int) -> DataFrame:
    pivots = _choose(rows, PIVOTS)
    ring_rows = max(RING_ROWS, rows.count() // 20_000)
    keyed = written(_keyed(rows, pivots), "keyed")
    ring_blocks = written(_blocks(_rings(keyed, ring_rows), ["pivot", "at", "cut"], dims), "rings")
    # Some 20,000 rings at most, besides those that hold less than a full one: one a pivot and width.
    rings = np.array(
        [tuple(r) for r in ring_blocks.select("pivot", "at", "cut", "lo", "hi").collect()], dtype=np.float64
    ).reshape(-1, 5)
    rings = rings[np.lexsort(rings.T[::-1])]
    asked = keyed.where(F.col("vec_id") % every == 0)
    # Queries of neighbouring pivots share a block; pivots with many queries are cut by a hash.
    share = max(1, min(PIVOTS, asked.count() // QUERY_ROWS))
    asked = asked.withColumn("part", F.floor(F.col("pivot") * share / PIVOTS).cast("int"))
    per = asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_ROWS)).alias("cuts"))
    asked = asked.join(F.broadcast(per), "part").withColumn("cut", F.pmod(F.xxhash64("row"), "cuts"))
    queries = written(_blocks(asked.select("part", "cut", "row", "vec_id", "v", "d"), ["part", "cut"], dims), "queries")
    ringed = ring_blocks.select("pivot", "at", "cut", "names", "ids", "rows")
    plain = queries.select("names", "rows", F.lit(b"").alias("far"))
    visit = written(_planned(plain, pivots, rings, dims, FIRST, False), "visits").join(ringed, ["pivot", "at", "cut"])
    found = written(_top(_visited(visit, k, dims), k), "found")
    worst = found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    far = F.when(F.col("n") >= k, square + F.lit(pivots.radius2) - 2 * F.col("least")).otherwise(float("inf"))
    limited = asked.join(worst, F.col("row") == F.col("query"), "left").select("part", "cut", "row", "v", far.alias("d"))

    def block(key: tuple, table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks().flatten().to_numpy().astype(np.float32)
        return pa.table(
            {
                "names": [table.column("row").to_numpy().tobytes()],
                "rows": [v.tobytes()],
                "far": [table.column("d").to_numpy().astype(np.float64).tobytes()],
            }
        )

    # Every step in Python is written, so that no task holds two of them.
    limits = written(limited.groupBy("part", "cut").applyInArrow(block, "names binary, rows binary, far binary"), "limits")
    visit = written(_planned(limits, pivots, rings, dims, FIRST, True), "visits").join(ringed, ["pivot", "at", "cut"])
    more = written(_visited(visit, k, dims), "more")
    top = _top(found.select("query", "vec_id", "score").unionByName(more), k)
    names = asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return top.join(names, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
