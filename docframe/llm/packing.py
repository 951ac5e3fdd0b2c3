"""Bulk-synchronous best-fit packing of documents into sequences of fixed length.

Pieces of documents are range-sorted, from large to small, once; of each size their
number is all that the rounds need, for among equal sizes rank decides: the smaller
id, then the earlier part, comes first. Each round sorts the sizes that are left and
the gaps of the open sequences together and sweeps over them: a piece takes the
smallest free gap that holds it, the successor of its size; one of higher rank comes
first and so wins a gap that several want. Then gaps shrink, sequences are opened for
pieces larger than every gap, and the next round begins.

Sizes and gaps are rows (size, count), at most `capacity` of each whatever the
corpus, and a round moves whole runs of ranks to whole runs of sequences. After the
last round one pass gives each piece the place of its rank.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.llm.common import column, rows_of, written

CAPACITY = 8192
#: Rows of pieces in one sorted partition.
PARTITION_ROWS = 1_000_000


def pieces(docs: DataFrame, capacity: int, key: str, text: str) -> DataFrame:
    """(doc_id, part, size): documents as UTF-8 bytes and an end mark, cut where longer than capacity."""
    size = (F.octet_length(text) + 1).cast("long")
    base = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), size.alias("whole"))
    out = base.select("doc_id", "whole", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(whole - 1) div {capacity}"))).alias("part"))
    return out.select("doc_id", "part", F.least(F.lit(capacity), F.col("whole") - F.col("part") * capacity).cast("int").alias("size"))


def rounds(number: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """From the number of pieces of each size: runs (size, first rank within the size,
    count, first sequence, offset), each piece of a run in a sequence of its own, and
    the number of sequences."""
    left = dict(number)
    done: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs of sequences (first, count)
    out: list[tuple[int, int, int, int, int]] = []
    bins = 0
    while left:
        shrunk: dict[int, list[tuple[int, int]]] = defaultdict(list)

        def place(size: int, n: int, first: int, gap: int) -> None:
            out.append((size, done[size], n, first, capacity - gap))
            done[size] += n
            left[size] -= n
            shrunk[gap - size].append((first, n))  # noqa: B023

        stack: list[tuple[int, int, int]] = []  # (gap, first, count), the smallest gap on top
        lead, seen = [], False
        for size in sorted(left.keys() | gaps.keys(), reverse=True):
            for first, n in gaps.get(size, ()):
                stack.append((size, first, n))
                seen = True
            if size in left and not seen:
                lead.append(size)
            while left.get(size) and stack:
                gap, first, n = stack.pop()
                k = min(n, left[size])
                place(size, k, first + n - k, gap)
                if n > k:
                    stack.append((gap, first, n - k))
        # pieces larger than any gap lead the order and need new sequences; the others can wait for a gap
        large = sum(left[s] for s in lead if 2 * s > capacity)
        new = max(large, -(-sum(s * left[s] for s in lead) // capacity))
        for size in sorted((s for s in left if left[s]), reverse=True):
            k = min(new, left[size])
            if k:
                place(size, k, bins, capacity)
                bins += k
                new -= k
        left = {s: n for s, n in left.items() if n}
        least = min(left, default=0)
        for gap, first, n in stack:
            shrunk[gap].append((first, n))
        gaps = {}
        for gap, runs in shrunk.items():
            if gap < least or not left:
                continue
            joined: list[tuple[int, int]] = []
            for first, n in sorted(runs):
                if joined and sum(joined[-1]) == first:
                    joined[-1] = (joined[-1][0], joined[-1][1] + n)
                else:
                    joined.append((first, n))
            gaps[gap] = joined
    return out, bins


def pack(docs: DataFrame, capacity: int = CAPACITY, partition_rows: int = PARTITION_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, part, start, n_tokens, sequence, offset): where each piece of each
    document lies.

    A token is a byte of the UTF-8 text; an end mark follows each document. A
    document longer than capacity is cut into pieces of that length and a rest;
    start is the piece's first token in its document, offset its first in its
    sequence. No sequence holds more than capacity tokens, and pieces don't
    overlap. Null texts have no row; an empty text is its end mark. Rows that
    repeat an id are packed one by one. Among equal sizes the smaller id, then
    the earlier part, comes first; null ids come first of all. Other columns are
    ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    items = pieces(docs, capacity, key, text)
    order = [F.desc("size"), "doc_id", "part"]
    # places of a sorted partition: its number above bit 33
    ranked = items.repartitionByRange(max(1, -(-rows_of(items) // partition_rows)), *order).sortWithinPartitions(*order)
    ranked = written(ranked.withColumn("at", F.monotonically_increasing_id()), "pieces")
    # a row for each size and partition: equal sizes are in neighbouring ones, so at most `capacity` rows and one a partition
    rows = sorted(map(tuple, ranked.groupBy(F.shiftright("at", 33), "size").agg(F.count("*"), F.min("at")).collect()))
    number: dict[int, int] = defaultdict(int)
    starts, shifts = [], []
    for _, size, n, first in sorted(rows, key=lambda r: r[3]):
        starts.append(first)
        shifts.append(number[size] - first)
        number[size] += n
    runs, _ = rounds(number, capacity)
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((np.array(starts, np.int64), np.array(shifts, np.int64), table))
    names = ["doc_id", "part", "start", "n_tokens", "sequence", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, shift, table = shared.value
        keys = table[:, 0] << 45 | table[:, 1]
        for b in batches:
            size, at, part = (np.asarray(column(b, c)).astype(np.int64) for c in ("size", "at", "part"))
            rank = at + shift[np.searchsorted(start, at, side="right") - 1] if len(at) else at
            k = np.searchsorted(keys, size << 45 | rank, side="right") - 1
            cols = [part, part * capacity, size, table[k, 3] + rank - table[k, 1], table[k, 4]]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), *(pa.array(c) for c in cols)], names)

    schema = T.StructType([T.StructField("doc_id", ranked.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in names[1:])])
    return ranked.mapInArrow(run, schema)
