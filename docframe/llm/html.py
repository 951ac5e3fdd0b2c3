"""Main text of web pages by differencing with the page of the nearest URL.

Pages of one host are put in the order of their URL paths; a page's partner is
the neighbour whose path begins like its own the longest. The text lines of both
are aligned by a longest common subsequence, and the lines that they share
(navigation, notices, footers) are deleted.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.llm.common import rows_of, spans_hash, written

#: Rows of URL keys in one sorted partition.
PARTITION_ROWS = 2_000_000

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|head)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>", re.S | re.I)
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|button|caption|center|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|iframe|legend|li|main|menu|nav|ol|option|p|pre|section|select|summary|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>")
_SPACE = re.compile(r"[^\S\n]+")


def lines(page: str | None) -> list[str]:
    """The text lines of a page: block elements begin and end a line, other tags
    vanish, entities are decoded, blanks are one space, empty lines are dropped."""
    if not page:
        return []
    s = _HIDDEN.sub("", page)
    s = _TAG.sub("", _BLOCK.sub("\n", s.replace("\n", " ")))
    if "&" in s:
        s = html.unescape(s)
    return [x for x in (y.strip() for y in _SPACE.sub(" ", s).split("\n")) if x]


def line_hashes(texts: list[str]) -> np.ndarray:
    raw = [x.encode() for x in texts]
    ends = np.cumsum([len(x) for x in raw]) if raw else np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    return spans_hash(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if raw else np.zeros(0, np.uint64)


#: Bytes of the rows that an alignment is traced back through; beyond it is cut in two first.
TRACE_BYTES = 64 << 20


def _masks(b: list) -> dict:
    """For each different line the bits of the places where it stands."""
    at: dict = defaultdict(list)
    for j, x in enumerate(b):
        at[x].append(j)
    out = {}
    for x, js in at.items():
        bits = np.zeros(len(b) + 7 >> 3, np.uint8)
        np.bitwise_or.at(bits, np.array(js) >> 3, np.left_shift(1, np.array(js) & 7).astype(np.uint8))
        out[x] = int.from_bytes(bits.tobytes(), "little")
    return out


def _rows(a: list, b: list) -> Iterator[int]:
    """After each line of a, the bits of b: a place is 0 where the longest common
    subsequence of what is before and up to it grows. Time is len(a) x len(b) / 64
    whatever repeats."""
    masks, every = _masks(b), (1 << len(b)) - 1
    v = every
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & every
        yield v


def _lengths(a: list, b: list) -> np.ndarray:
    """The length of the longest common subsequence of a and each beginning of b."""
    v = (1 << len(b)) - 1
    for v in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) + 7 >> 3, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _aligned(a: list, b: list, base: int) -> list[int]:
    """Indexes (from base) into a of a longest common subsequence of a and b."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > 8 * TRACE_BYTES:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return _aligned(a[:half], b[:cut], base) + _aligned(a[half:], b[cut:], base + half)
    rows = list(_rows(a, b))
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            out.append(base + i)
            j -= 1
    return out[::-1]


def common(a: list, b: list) -> list[int]:
    """Indexes into a of a longest common subsequence of a and b: bit-parallel, after
    common ends are taken off."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    x, y = len(a), len(b)
    while x > lo and y > lo and a[x - 1] == b[y - 1]:
        x, y = x - 1, y - 1
    return [*range(lo), *_aligned(a[lo:x], b[lo:y], lo), *range(x, len(a))]


def keyed(pages: DataFrame, url: str) -> tuple[F.Column, F.Column]:
    """Host and path of a URL: lower-case host without port and user; path without
    scheme, query, fragment, index pages, .html endings and closing slashes."""
    rest = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@|:\d+$", ""))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(path, r"(?i)(/(index|default)\.[a-z]+|\.(html?|php|aspx?|jsp))$", "")
    return host, F.regexp_replace(path, r"/+$", "")


def neighbours(keys: DataFrame, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """(host, path, near): for each (host, path), the path before or after it, in
    order, of the same host that begins like it the longest; the one before on a
    tie. Keys are range-sorted, so a host of any size is spread; partitions exchange
    only their first and last keys."""
    spark = keys.sparkSession
    parts = max(1, -(-rows_of(keys) // partition_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        last: tuple | None = None  # (host, path, path before it)
        before: tuple | None = None
        n = 0
        out: list[tuple] = []
        for b in batches:
            for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if last is not None:
                    out.append((pid, n, *last, before[1] if before and before[0] == last[0] else None, key[1] if key[0] == last[0] else None, n == 0, False))
                    n += 1
                before, last = last, key
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), schema=kinds)
                out = []
        if last is not None:
            out = [(pid, n, *last, before[1] if before and before[0] == last[0] else None, None, n == 0, True)]
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), schema=kinds)

    names = ["pid", "ord", "host", "path", "prev", "next", "head", "tail"]
    kinds = pa.schema([("pid", pa.int32()), ("ord", pa.int64()), *((c, pa.string()) for c in ("host", "path", "prev", "next")), ("head", pa.bool_()), ("tail", pa.bool_())])
    flat = keys.select("host", "path").repartitionByRange(parts, "host", "path").sortWithinPartitions("host", "path").mapInArrow(run, "pid int, ord long, host string, path string, prev string, next string, head boolean, tail boolean")
    flat = written(flat, "neighbours")
    # two keys of each partition
    ends: dict[int, dict] = defaultdict(dict)
    for r in flat.where("head OR tail").collect():
        if r.head:
            ends[r.pid]["head"] = (r.host, r.path)
        if r.tail:
            ends[r.pid]["tail"] = (r.host, r.path)
    over, order = [], sorted(ends)
    for p, q in zip(order, order[1:]):
        (h, x), (k, y) = ends[p]["tail"], ends[q]["head"]
        if h == k:
            over.append((p, x, q, y))
    if over:
        after = F.broadcast(spark.createDataFrame([(p, y) for p, _, _, y in over], "pid int, after string"))
        prior = F.broadcast(spark.createDataFrame([(q, x) for _, x, q, _ in over], "pid int, prior string"))
        flat = flat.join(after, "pid", "left").join(prior, "pid", "left")
        flat = flat.withColumn("next", F.when(F.col("tail"), F.col("after")).otherwise(F.col("next"))).withColumn("prev", F.when(F.col("head"), F.col("prior")).otherwise(F.col("prev")))

    def shared(other: str) -> F.Column:
        # leading segments that agree, then leading characters
        a, b = F.split("path", "/"), F.split(other, "/")
        same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
        segments = F.coalesce(F.array_position(same, False) - 1, F.size(same).cast("long"))
        chars = F.zip_with(F.split("path", ""), F.split(other, ""), lambda x, y: x.eqNullSafe(y) & x.isNotNull())
        return F.struct(segments, F.coalesce(F.array_position(chars, False) - 1, F.size(chars).cast("long")))

    near = F.when(F.col("prev").isNull(), F.col("next")).when(F.col("next").isNull(), F.col("prev")).when(shared("next") > shared("prev"), F.col("next")).otherwise(F.col("prev"))
    return flat.select("host", "path", near.alias("near")).where(F.col("near").isNotNull())


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [line_hashes(lines(p)).tobytes() for p in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], ["host", "path", "page_id", "hashes"])


def main_text(pages: DataFrame, partition_rows: int = PARTITION_ROWS, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_lines, n_removed) of every row.

    Pages whose URLs have the same host and path stand behind the one with the
    smallest id, and have the same partner. A page without a neighbour in its host
    keeps all its lines; so does one whose lines are all in its partner, for then
    nothing tells its text from what surrounds it. A null or empty page has no line
    and an empty text; a null URL is host and path ''. Rows that repeat an id are
    treated one by one. Pages are used whole; other columns are ignored. No rows
    give no rows.
    """
    host, path = keyed(pages, url)
    base = pages.select(host.alias("host"), path.alias("path"), F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    kinds = base.schema
    hashed = base.select("host", "path", "page_id", "html").mapInArrow(_line_hashes, T.StructType([*kinds.fields[:3], T.StructField("hashes", T.BinaryType())]))
    # each URL's first page; small: 8 bytes a line
    firsts = written(hashed.groupBy("host", "path").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "hashes")).alias("first")).select("host", "path", "first.hashes"), "lines")
    near = neighbours(firsts, partition_rows)
    partners = near.join(firsts.select("host", F.col("path").alias("near"), "hashes"), ["host", "near"]).select("host", "path", "hashes")
    names = ["page_id", "url", "text", "n_lines", "n_removed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, gone = [], [], []
            for p, other in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                own = lines(p)
                drop = common(line_hashes(own).tolist(), np.frombuffer(other, np.uint64).tolist()) if other and own else []
                if len(drop) == len(own):
                    drop = []
                off = set(drop)
                texts.append("\n".join(x for i, x in enumerate(own) if i not in off))
                n.append(len(own))
                gone.append(len(drop))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names)

    schema = T.StructType([T.StructField("page_id", kinds["page_id"].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return base.join(partners, ["host", "path"], "left").select("page_id", "url", "html", "hashes").mapInArrow(run, schema)
