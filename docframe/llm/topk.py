"""Exact k nearest neighbours of a set of queries, by branch and bound over columns.

Vectors lie in blocks in vertical layout: all values of dimension 0, then of
dimension 1, and so on. For a block of queries and a block of candidates,
squared distances are accumulated one block of dimensions at a time. What the
dimensions still to come can add is at least (|q'| - |c'|)^2, q' and c' being the
remaining parts, whose masses are known. Candidates that are certainly farther
than a query's k-th best so far are out; the survivors are compacted before the
next dimensions are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import arrow_type, column, numbered, rows_of, written

K = 10
BLOCK_ROWS = 2048
DIMENSIONS = 16
QUERIES = 256
DIGITS = 6
#: Rows that cells are made around; a bound on what is collected and broadcast.
PIVOTS = 64
#: Queries of the registered search: ids divisible by this.
EVERY = 50


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): the smallest vector of each id, of those that can be compared."""
    base = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0))
    base = base.select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v"))
    base = base.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return base.groupBy("id").agg(F.min("v").alias("v"))


def pivots_of(base: DataFrame, most: int) -> list[tuple[int, np.ndarray]]:
    """(width, vector): at most `most` rows, those with the smallest hashes, and for each
    width the zero vector. Only how much is pruned depends on them."""
    rows = base.orderBy(F.xxhash64("v"), "id").limit(most).select("v").collect()
    return [(len(r.v), np.array(r.v, np.float64)) for r in rows]


def blocks(base: DataFrame, pivots: list[tuple[int, np.ndarray]], block_rows: int) -> DataFrame:
    """(block, width, cell, near, far, ids, values): vectors of one width whose nearest pivot
    is number `cell`, at distances from near to far from it; dimension by dimension, as
    float32. Cell -1: no pivot has this width, and distances are from the origin."""
    shared = base.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, width = b.column(1), np.asarray(pa.compute.list_value_length(b.column(1))).astype(np.int32)
            cell, far = np.full(len(width), -1, np.int32), np.zeros(len(width))
            for w in np.unique(width):
                rows = np.flatnonzero(width == w)
                x = np.asarray(v.take(pa.array(rows)).flatten(), np.float32).reshape(len(rows), w).astype(np.float64)
                some = [(k, p) for k, (n, p) in enumerate(shared.value) if n == w]
                each = np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for _, p in some]) if some else np.sqrt((x**2).sum(axis=1))[None]
                at = each.argmin(axis=0)
                far[rows] = each[at, np.arange(len(rows))]
                if some:
                    cell[rows] = np.array([k for k, _ in some])[at]
            yield pa.RecordBatch.from_arrays([b.column(0), v, pa.array(width), pa.array(cell), pa.array(far)], ["id", "v", "width", "cell", "d"])

    placed = base.mapInArrow(place, "id long, v array<float>, width int, cell int, d double")
    ordered = placed.repartitionByRange("width", "cell", "d", "id").sortWithinPartitions("width", "cell", "d", "id")

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, k = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        last = None

        def out() -> pa.RecordBatch:
            nonlocal k
            t = pa.Table.from_batches(held)
            width, d, ids = t.column("width")[0].as_py(), np.asarray(t.column("d")), np.asarray(t.column("id"))
            order = np.argsort(ids)
            v = np.asarray(t.column("v").combine_chunks().flatten(), np.float32).reshape(len(ids), width)[order]
            row = [(pid << 32) + k, width, t.column("cell")[0].as_py(), d.min(), d.max(), ids[order].tobytes(), np.ascontiguousarray(v.T).tobytes()]
            k += 1
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow, strict=True)], schema=arrow)

        for b in batches:
            if not b.num_rows:
                continue
            kind = np.asarray(column(b, "width")).astype(np.int64) << 32 | np.asarray(column(b, "cell")).astype(np.int64) & 0xFFFFFFFF
            lo = 0
            while lo < b.num_rows:
                same = int(np.argmax(np.append(kind[lo:] != kind[lo], True)))
                n = sum(x.num_rows for x in held)
                if held and (n >= block_rows or kind[lo] != last):
                    yield out()
                    held, n = [], 0
                hi = lo + min(same, block_rows - n)
                held.append(b.slice(lo, hi - lo))
                last, lo = kind[lo], hi
        if held:
            yield out()

    schema = "block long, width int, cell int, near double, far double, ids binary, values binary"
    arrow = arrow_type(schema)
    return ordered.mapInArrow(stack, schema)


class Best:
    """The k best of each query so far: distances and ids, in order."""

    def __init__(self, n: int, k: int):
        self.distance = np.full((n, k), np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, row: np.ndarray, distance: np.ndarray, ids: np.ndarray) -> None:
        k = self.distance.shape[1]
        rows = np.unique(row)
        row = np.concatenate([row, np.repeat(rows, k)])
        distance = np.concatenate([distance, self.distance[rows].ravel()])
        ids = np.concatenate([ids, self.id[rows].ravel()])
        order = np.lexsort((ids, distance, row))
        row, distance, ids = row[order], distance[order], ids[order]
        first = np.searchsorted(row, rows)
        at = first[:, None] + np.arange(k)
        self.distance[rows], self.id[rows] = distance[at], ids[at]


def distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of pairs, one column each, rounded: equal vectors tie exactly."""
    d = q.astype(np.float64) - c
    return np.round(np.einsum("ij,ij->j", d, d), DIGITS)


def search(q: np.ndarray, qid: np.ndarray, c: np.ndarray, cid: np.ndarray, best: Best, limit: np.ndarray, step: int = DIMENSIONS, some: int = QUERIES) -> None:
    """Brings best up to date with a block of candidates. q, c: dimension by row;
    limit: no k-th best is farther than that."""
    width = len(q)
    cuts = list(range(0, width, step)) + [width]
    # masses from each cut on
    qm = np.stack([np.sqrt((q[a:].astype(np.float64) ** 2).sum(axis=0)) for a in cuts])
    cm = np.stack([np.sqrt((c[a:].astype(np.float64) ** 2).sum(axis=0)) for a in cuts])
    for lo in range(0, q.shape[1], some):
        at = np.arange(lo, min(lo + some, q.shape[1]))
        live = np.arange(c.shape[1])
        total = np.zeros((len(at), len(live)), np.float32)
        worst = np.minimum(best.distance[at, -1], limit[at])
        scale = (qm[0, at] ** 2).max(initial=0) + (cm[0] ** 2).max(initial=0)
        slack = 1e-5 * (1 + scale)  # more than float32 sums are off
        pairs = None
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if pairs is None:
                x, y = q[a:b, at], c[a:b][:, live]
                total += (x * x).sum(axis=0)[:, None] + (y * y).sum(axis=0)[None, :] - 2 * (x.T @ y)
                bound = total + (qm[n + 1, at][:, None] - cm[n + 1, live][None, :]).astype(np.float32) ** 2
                open_ = bound <= (worst + slack)[:, None]
                open_ &= qid[at][:, None] != cid[live][None, :]
                if open_.mean() < 0.1:
                    i, j = np.nonzero(open_)
                    pairs = (at[i], live[j], total[i, j])
                    continue
                column = open_.any(axis=0)
                live, total = live[column], total[:, column]
                i, j = np.nonzero(open_[:, column])
                last = (at[i], live[j])
            else:
                i, j, part = pairs
                part = part + ((q[a:b, i] - c[a:b, j]) ** 2).sum(axis=0)
                keep = part + (qm[n + 1, i] - cm[n + 1, j]) ** 2 <= np.minimum(best.distance[i, -1], limit[i]) + slack
                pairs = (i[keep], j[keep], part[keep])
        i, j = last if pairs is None else pairs[:2]
        # what survives is computed exactly
        for lo2 in range(0, len(i), 1 << 17):
            r, s = i[lo2 : lo2 + (1 << 17)], j[lo2 : lo2 + (1 << 17)]
            best.add(r, distances(q[:, r], c[:, s]), cid[s])


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, rank, neighbour, distance): the k rows nearest to each row of `queries`
    (rows of the same columns; None for all rows), the row of its own id excepted, by
    squared Euclidean distance rounded to 6 decimals; the smaller id first on a tie.

    Rows with a null id or vector, an empty vector, or a value that is null or not
    finite are neither queries nor candidates. Vectors are compared with those of
    their own width. Of rows that repeat an id the smallest vector counts. Ids of
    other types than integers are compared by their order. With fewer than k
    others, all of them are given. Other columns are ignored. No rows give no rows.

    All rows lie in blocks by their nearest pivot and distance from it. A query first
    meets the blocks of its own cell about its own distance: the k-th best of these
    limits all further search. Then it meets every block, and by the triangle inequality
    skips those that are farther than its limit.
    """
    spark = vectors.sparkSession
    kept, back = numbered(vectors.select(key, vector), key)
    base = written(valid(kept, key, vector), "vectors")
    some = base
    if queries is not None:
        asked = queries.select(F.col(key).alias("query")).distinct()
        some = back(base.withColumn("name", F.col("id")), "name").join(asked, F.col("name") == F.col("query"), "left_semi").select("id", "v")
    at = pivots_of(base, pivots)
    table = written(blocks(base, at, block_rows), "blocks")
    asking = written(blocks(some, at, min(block_rows, QUERIES)), "queries")
    shared = spark.sparkContext.broadcast(at)
    left = asking.select("width", "cell", F.col("block").alias("qb"), F.col("near").alias("qnear"), F.col("far").alias("qfar"), F.col("ids").alias("qi"), F.col("values").alias("qv"))
    right = table.select(F.col("width").alias("w"), F.col("cell").alias("c"), "near", "far", F.col("ids").alias("ci"), F.col("values").alias("cv"))
    first = left.withColumn("limits", F.lit(None).cast("binary")).join(right, (F.col("width") == F.col("w")) & (F.col("cell") == F.col("c")) & (F.col("near") <= F.col("qfar")) & (F.col("far") >= F.col("qnear")))
    columns = ["width", "qb", "qi", "qv", "limits", "ci", "cv", "w", "c", "near", "far"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        for b in batches:
            for width, qb, qi, qv, limits, ci, cv, w, c, near, far in zip(*b.columns, strict=True):
                if width != w:
                    continue
                at = (width.as_py(), qb.as_py())
                if at not in held:
                    ids = np.frombuffer(qi.as_py(), np.int64)
                    limit = np.frombuffer(limits.as_py(), np.float64) if limits.is_valid else np.full(len(ids), np.inf)
                    q = np.frombuffer(qv.as_py(), np.float32).reshape(-1, len(ids))
                    wide = q.astype(np.float64)
                    own = {k: np.sqrt(((wide - p[:, None]) ** 2).sum(axis=0)) for k, (n, p) in enumerate(shared.value) if n == len(q)}
                    held[at] = (ids, q, Best(len(ids), k), limit, own or {-1: np.sqrt((wide**2).sum(axis=0))})
                ids, q, best, limit, own = held[at]
                # what is between a query and the block at least
                gap = np.maximum(0, np.maximum(own[c.as_py()] - far.as_py(), near.as_py() - own[c.as_py()]))
                rows = np.flatnonzero(gap**2 * (1 - 1e-9) <= np.minimum(best.distance[:, -1], limit) + 1e-5)
                if not len(rows):
                    continue
                other = np.frombuffer(ci.as_py(), np.int64)
                part = Best(len(rows), k)
                part.distance, part.id = best.distance[rows], best.id[rows]
                search(np.ascontiguousarray(q[:, rows]), ids[rows], np.frombuffer(cv.as_py(), np.float32).reshape(-1, len(other)), other, part, limit[rows])
                best.distance[rows], best.id[rows] = part.distance, part.id
        for (_, qb), (ids, _, best, _, _) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([qb]), pa.array([ids.tobytes()], pa.binary()), pa.array([best.id.tobytes()], pa.binary()), pa.array([best.distance.tobytes()], pa.binary())], ["qb", "queries", "ids", "distances"])

    found = "qb long, queries binary, ids binary, distances binary"

    def least(key: tuple, t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.float64).reshape(-1, k) for x in t.column("distances")]
        return pa.table({"b": [key[0].as_py()], "limits": pa.array([np.sort(np.concatenate(parts, axis=1), axis=1)[:, k - 1].tobytes()], pa.binary())})

    limits = first.select(*columns).mapInArrow(run, found).groupBy("qb").applyInArrow(least, "b long, limits binary")
    limited = written(left.join(limits, F.col("qb") == F.col("b"), "left").drop("b"), "limits")
    # every block of queries meets every block of candidates. Widths are compared in run: as a
    # join key they would send all blocks to one task
    parts = max(1, min(rows_of(limited), 2 * spark.sparkContext.defaultParallelism))
    partial = limited.repartition(parts, "qb").crossJoin(right).select(*columns).mapInArrow(run, found)

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        q = np.frombuffer(t.column("queries")[0].as_py(), np.int64)
        i, d = (np.concatenate([np.frombuffer(x.as_py(), kind).reshape(-1, k) for x in t.column(c)], axis=1) for c, kind in (("ids", np.int64), ("distances", np.float64)))
        order = np.lexsort((i, d), axis=1)[:, :k]
        i, d = np.take_along_axis(i, order, 1), np.take_along_axis(d, order, 1)
        row, rank = np.nonzero(np.isfinite(d))
        return pa.table({"vec_id": q[row], "rank": rank + 1, "neighbour": i[row, rank], "distance": d[row, rank]})

    out = partial.groupBy("qb").applyInArrow(merge, "vec_id long, rank long, neighbour long, distance double")
    return back(out, "vec_id", "neighbour")


SQL = f"""
WITH v AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), {DIGITS}) AS distance
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM p)
SELECT vec_id, rank, neighbour, distance FROM r WHERE rank <= {K}
"""
