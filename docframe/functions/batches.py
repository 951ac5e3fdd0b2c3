"""Arrow batches in pieces: what a worker holds at once is bounded by bytes, not by rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a piece (a row of more is a piece of its own), and rows in a batch of results.
BYTES, ROWS = 1 << 20, 4096


def pieces(batch: pa.RecordBatch, column: int, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, up to `most` bytes of a column at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield batch.slice(i, j - i)
        i = j


def rows_of(batches: Iterable[pa.RecordBatch], made: Callable[[str | None, str | None], Iterable[dict]], schema: pa.Schema, most: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The rows that each (key, text) gives, in batches of up to `most`; a field that a row lacks is null."""
    out: list[dict] = []

    def taken() -> pa.RecordBatch:
        b = pa.RecordBatch.from_pydict({n: [r.get(n) for r in out] for n in schema.names}, schema=schema)
        out.clear()
        return b

    for b in batches:
        for p in pieces(b, 1):
            for key, text in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True):
                for r in made(key, text):
                    out.append(r)
                    if len(out) >= most:
                        yield taken()
            if out:  # a piece's rows go before the next piece comes
                yield taken()
