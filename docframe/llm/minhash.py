"""Near-duplicate documents by min-max hashing.

Each of `permutations` hash functions is evaluated once per shingle, and both
its minimum and its maximum over the shingles are kept: two unbiased estimators
of the Jaccard similarity for one evaluation. The signature of 2 x permutations
values is cut into bands; documents that agree on a band are compared by their
whole signatures, and the pairs that pass are joined into groups.

Nothing is capped. Documents with equal signatures stand behind one of them
(exact copies cost one comparison each). In a band's bucket all members are
compared with the smallest; what that leaves in different groups is then compared
pair by pair, so the groups are the connected components over *all* pairs of all
buckets. Minima of buckets and of neighbours are partial aggregates joined back: no
task holds a bucket, and a hot one is split.

A document is an id and a hash of its text: texts that share an id are compared
like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import Tokens, Windows, column, discarded, fresh, mix, numbered, slices, spans_hash, written

PERMUTATIONS = 64
BAND_ROWS = 4
SHINGLE = 3
THRESHOLD = 0.5

#: A document: its id, and a hash of its text.
NODE = "struct<id:long,sub:long>"


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def minmax(text: pa.Array, permutations: int = PERMUTATIONS, shingle: int = SHINGLE) -> list[bytes | None]:
    """The signature of each text: permutations minima, then as many maxima.

    Shingles are runs of `shingle` word tokens; a text with fewer tokens is one
    shingle; one without a token is one shingle of its bytes; one that is null,
    empty or blank has no signature.
    """
    mul, add = _functions(permutations)
    out: list[bytes | None] = []
    for i, j, data, offsets in slices(text):
        tokens = Tokens(data, offsets)
        counts = np.diff(tokens.row)
        number = np.maximum(counts - shingle + 1, (counts > 0).astype(np.int64))
        first = np.concatenate([[0], np.cumsum(number)])
        doc = np.repeat(np.arange(j - i), number)
        at = tokens.row[:-1][doc] + np.arange(first[-1]) - first[:-1][doc]
        x = (Windows(tokens.hash).hash(at, np.minimum(counts[doc], shingle)) >> np.uint64(32)).astype(np.uint32)
        some = np.flatnonzero(number)
        sig = np.zeros((j - i, 2 * permutations), np.uint32)
        if len(some):
            cut = first[:-1][some]
            for k in range(permutations):
                y = x * mul[k] + add[k]
                sig[some, k] = np.minimum.reduceat(y, cut)
                sig[some, permutations + k] = np.maximum.reduceat(y, cut)
        for d in np.flatnonzero(number == 0):
            raw = data[offsets[d] : offsets[d + 1]].tobytes().strip()
            if raw:
                one = np.frombuffer(raw, np.uint8)
                h = spans_hash(one, np.array([0]), np.array([len(one)]))
                y = (h >> np.uint64(32)).astype(np.uint32) * mul + add
                sig[d] = np.concatenate([y, y])
                number[d] = 1
        out += [sig[d].tobytes() if number[d] else None for d in range(j - i)]
    return out


def signatures(docs: DataFrame, permutations: int = PERMUTATIONS, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, sig) of each row with an id and a signature; doc is a NODE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = pa.array(minmax(b.column(1), permutations, shingle), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), sig], ["doc", "sig"]).filter(sig.is_valid())

    source = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    return source.select(F.struct(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("sub")).alias("doc"), F.col(text).alias("text")).mapInArrow(run, f"doc {NODE}, sig binary")


def _bands(sigs: DataFrame, rows: int) -> DataFrame:
    """(band, doc): a key for each band of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(column(b, "sig").to_pylist()), np.uint32).reshape(b.num_rows, -1).astype(np.uint64)
            bands = sig.shape[1] // rows
            value = sig[:, : bands * rows].reshape(-1, bands, rows)
            h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), value.shape[:2])
            for r in range(rows):
                h = mix(h * np.uint64(31) + value[:, :, r])
            doc = column(b, "doc").take(pa.array(np.repeat(np.arange(b.num_rows), bands)))
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), doc], ["band", "doc"])

    return sigs.mapInArrow(run, f"band long, doc {NODE}")


def _similar(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b), those whose signatures agree on at least `threshold` of their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(column(b, c).to_pylist()), np.uint32).reshape(b.num_rows, -1) for c in ("x", "y"))
            keep = pa.array((x == y).mean(axis=1) >= threshold)
            yield b.select(["a", "b"]).filter(keep)

    left = sigs.select(F.col("doc").alias("a"), F.col("sig").alias("x"))
    right = sigs.select(F.col("doc").alias("b"), F.col("sig").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, f"a {NODE}, b {NODE}")


def _with_least(df: DataFrame, by: str, value: str) -> DataFrame:
    """df with m, the least `value` of its rows' `by`: combined before the exchange, and joined back."""
    return df.join(df.groupBy(by).agg(F.min(value).alias("m")), by)


def components(edges: DataFrame) -> DataFrame:
    """(doc, root): the connected components of edges (a, b), a <> b; root is the
    smallest and has no row. Large-star and small-star rounds until nothing
    changes; the number of rounds grows with the logarithm of the largest component."""

    def stamp(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    last = stamp(e)
    while last[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        large = _with_least(both, "u", "v").where("v > u").select(F.least("u", "m").alias("a"), F.col("v").alias("b")).distinct()
        small = _with_least(large, "b", "a")
        small = small.select("m", "b").union(small.where("a <> m").select("m", "a")).toDF("a", "b").distinct()
        before, e = e, written(small, "edges")
        discarded(before)
        now = stamp(e)
        if now == last:
            break
        last = now
    return e.select(F.col("b").alias("doc"), F.col("a").alias("root"))


def _groups(docs: DataFrame, threshold: float, permutations: int, rows: int, shingle: int, key: str, text: str) -> DataFrame:
    """(doc, root) of each NODE that is near another of its group, the least one."""
    # rows that repeat an id and a text are one
    sigs = written(signatures(docs, permutations, shingle, key, text).groupBy("doc").agg(F.first("sig").alias("sig")), "signatures")
    same = _with_least(sigs.select("doc", F.md5("sig").alias("sig")), "sig", "doc").where("doc <> m").select("doc", F.col("m").alias("root"))
    same = written(same, "copies")
    # sigs once for each different signature
    reps = written(sigs.join(same.select("doc"), "doc", "left_anti"), "signatures")
    discarded(sigs)
    bands = written(_bands(reps, rows), "bands")
    low = bands.groupBy("band").agg(F.min("doc").alias("low"), F.count("*").alias("n")).where("n > 1").select("band", "low")
    members = written(bands.join(low, "band"), "buckets")
    discarded(bands)
    stars = _similar(members.where("doc <> low").select(F.col("low").alias("a"), F.col("doc").alias("b")).distinct(), reps, threshold)
    stars = written(stars, "stars")
    first = components(stars)
    # members of one bucket that are in different groups still, and not compared yet
    known = members.join(first, "doc", "left").select("band", "doc", "low", F.coalesce("root", "doc").alias("root"))
    apart = known.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("band")
    open_ = written(known.where("doc <> low").join(apart, "band").select("band", "doc", "root"), "open")
    pairs = open_.alias("p").join(open_.alias("q"), (F.col("p.band") == F.col("q.band")) & (F.col("p.root") < F.col("q.root")))
    rest = _similar(pairs.select(F.col("p.doc").alias("a"), F.col("q.doc").alias("b")).distinct(), reps, threshold)
    out = components(stars.union(rest).union(same.select(F.col("root").alias("a"), F.col("doc").alias("b"))))
    discarded(same, reps, members, stars, open_)
    return out


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, permutations: int = PERMUTATIONS, rows: int = BAND_ROWS, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, duplicate_of): each document that repeats another, and the
    document with the smallest id of its group. Documents without a repeat have
    no row.

    A pair counts as near when the share of equal signature values, an estimate
    of the Jaccard similarity of the sets of `shingle`-token runs, is at least
    `threshold`. Defaults find a pair of similarity 0.6 in some band with
    probability 0.988, one of 0.7 with 0.9998.

    Rows with a null id or a null, empty or blank text are in no group. Rows that
    repeat an id and a text are one document; of texts that share an id each is a
    document, and one that is near another of the same id has a row that names its
    own id. Of groups and ties the smallest id leads; ids of other types than
    integers come in their own order. Texts are used whole, however long. Other columns
    are ignored. No rows give no rows.
    """
    plain, back = numbered(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "doc_id")
    groups = _groups(plain, threshold, permutations, rows, shingle, "doc_id", "text")
    return back(groups.select(F.col("doc.id").alias("doc_id"), F.col("root.id").alias("duplicate_of")).distinct(), "doc_id", "duplicate_of")


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, permutations: int = PERMUTATIONS, rows: int = BAND_ROWS, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group of near_duplicates, the first by (id, hash
    of the text); and of rows that repeat an id and a text any one. Rows with a null id
    or a null, empty or blank text stay, all of them. Texts that share an id are told
    apart. Other columns stay as they are, whatever their names. No rows give no rows."""
    plain, back = numbered(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "doc_id")
    groups = _groups(plain, threshold, permutations, rows, shingle, "doc_id", "text")
    id_, hash_, sub, part = (fresh(docs, x) for x in ("gone_id", "gone_sub", "text_sub", "apart"))
    gone = back(groups.select(F.col("doc.id").alias(id_), F.col("doc.sub").alias(hash_)), id_)
    marked = docs.withColumn(sub, F.xxhash64(F.col(text)))
    left = marked.join(gone, (marked[key] == gone[id_]) & (marked[sub] == gone[hash_]), "left_anti")
    # rows that are in no group are told apart by a number, so that none is dropped
    alone = F.col(key).isNull() | F.col(text).isNull() | (F.trim(F.regexp_replace(F.col(text), r"\s+", " ")) == "")
    return left.withColumn(part, F.when(alone, F.monotonically_increasing_id())).dropDuplicates([key, sub, part]).drop(sub, part)
