"""SentencePiece encoding and decoding as a relational lattice.

The model's file gives a table of pieces. A text, normalised, falls into words:
it is divided wherever no piece has the two characters on either side, so no
piece crosses a division, and words are encoded one by one. Each distinct word is
exploded into its substrings of bounded length; an equi-join with the table
leaves the lattice's edges; these are grouped by word and folded by a Spark
higher-order aggregate. For a unigram model the fold is Viterbi's: the best path
to each position from those before it. A BPE model's scores are ranks of merges,
whose encoding is not the path of the best sum; for it the fold merges, step by
step, the neighbours that make the piece of the best score, over the same edges.

Words are counted over all documents, each distinct one is encoded once, and the
codes are kept in blocks by the words' 128-bit digests. The codes of the CACHE most
frequent words are broadcast; documents lie in groups, and a group asks the blocks
about its other words only, so neither a frequent word nor a text travels twice.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.llm.common import GROUP_BYTES, answered, deflated, fresh, inflated, lightened, mix, packed, powers, rows_of, split_by, unpacked, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words of more characters are folded in Python, by a heap or an array: the
#: fold by a Spark aggregate takes time as their square.
LONG = 200
#: So many of the most frequent words are broadcast with their codes: a bound of some 10 MB.
CACHE = 1 << 18
SPACE = "▁"
#: A state of the fold that no path has reached.
NEVER = -1e30


@dataclass
class Vocabulary:
    """What encoding needs of a model."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
    bpe: bool
    prefix: bool
    unknown: int
    fallback: bool
    table: dict[str, tuple[int, float]] = field(default_factory=dict)
    longest: int = 1
    bigrams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    bytes_: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.table = {p: (i, s) for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds, strict=True)) if k in (1, 4)}
        self.longest = max(map(len, self.table), default=1)
        self.bigrams = np.array(sorted({ord(a) << 21 | ord(b) for p in self.table for a, b in zip(p, p[1:])}), np.int64)
        # characters as small classes, and which two classes stand side by side in some piece
        chars = sorted({ord(c) for p in self.table for c in p})
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[chars] = np.arange(1, len(chars) + 1)
        self.across = len(chars) + 1
        self.apart = np.ones((self.across, self.across), bool)
        self.apart[self.classes[self.bigrams >> 21], self.classes[self.bigrams & 0x1FFFFF]] = False
        self.apart = self.apart.ravel()
        self.single = np.full(0x110000, -1, np.int32)
        for p, (i, _) in self.table.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        of = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 6}
        self.bytes_ = [of.get(x, self.unknown) for x in range(256)]
        self.lowest = min((s for _, s in self.table.values()), default=0.0) - 10.0

    def __reduce__(self):
        """Without what __post_init__ makes: that is much larger than the model."""
        return Vocabulary, (self.pieces, self.scores, self.kinds, self.bpe, self.prefix, self.unknown, self.fallback)


def vocabulary(path: str = MODEL) -> Vocabulary:
    """From a model's file. Normalisation other than the identity isn't supported, and raises."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    n, t = m.normalizer_spec, m.trainer_spec
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or t.treat_whitespace_as_suffix or t.model_type not in (1, 2) or any(p.type == 4 for p in m.pieces):
        raise ValueError("a model of kind unigram or BPE with the identity as its normaliser and no user-defined pieces is needed")
    unknown = next(i for i, p in enumerate(m.pieces) if p.type == 2)
    return Vocabulary([p.piece for p in m.pieces], [p.score for p in m.pieces], [p.type for p in m.pieces], t.model_type == 2, n.add_dummy_prefix, unknown, t.byte_fallback)


# words of texts


def normalised(text: str, v: Vocabulary) -> str:
    """Blanks as the space mark, one before the text."""
    s = text.replace(" ", SPACE)
    return SPACE + s if v.prefix and s else s


class Words:
    """The words of many texts: where each text's begin (first), their number among
    the distinct ones (which), and the distinct ones' digests (one, two), in order."""

    def __init__(self, texts: list[str], v: Vocabulary):
        whole = [normalised(t, v) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(t) for t in whole])]).astype(np.int64)
        self.text = "".join(whole)
        del whole
        marks, ones, twos = [], [], []
        for lo, hi in _spans(starts):
            c = np.frombuffer(self.text[starts[lo] : starts[hi]].encode("utf-32-le", "surrogatepass"), np.uint32)
            cut = np.ones(len(c) + 1, bool)
            k = v.classes[c].astype(np.int32)
            cut[1:-1] = v.apart[k[:-1] * np.int32(v.across) + k[1:]]
            cut[starts[lo : hi + 1] - starts[lo]] = True
            at = np.flatnonzero(cut)
            if len(at) > 1:
                ones.append(code_hash(c, at, SEEDS[0]))
                twos.append(code_hash(c, at, SEEDS[1]))
                marks.append(at[:-1] + starts[lo])
        self.start = np.concatenate([*marks, [len(self.text)]]).astype(np.int64)
        self.first = np.searchsorted(self.start[:-1], starts)
        none = np.zeros(0, np.uint64)
        one, two = np.concatenate([*ones, none]), np.concatenate([*twos, none])
        del marks, ones, twos
        # by a hash table: only the distinct ones are sorted
        met = pa.array(one).dictionary_encode()
        found = met.dictionary.to_numpy()
        order = np.argsort(found)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.one, self.which = found[order], rank[met.indices.to_numpy()]
        del met, found, rank
        self.at = np.empty(len(order), np.int64)
        self.at[self.which] = np.arange(len(one))
        self.two = two[self.at]
        if (two != self.two[self.which]).any():  # half a digest in common
            both, self.at, self.which = np.unique(np.rec.fromarrays([one, two]), return_index=True, return_inverse=True)
            self.one, self.two = np.asarray(both.f0), np.asarray(both.f1)

    def distinct(self) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.start[self.at].tolist(), self.start[self.at + 1].tolist(), strict=True)]


def _spans(starts: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` characters."""
    lo, n = 0, len(starts) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(starts, starts[lo] + most, side="right")) - 1))
        yield lo, hi
        lo = hi


SEEDS = (1, 0x5851F42D4C957F2D)
#: Of each seed, the hashes of the characters of the basic plane.
_PLANE = {seed: mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(seed)) for seed in SEEDS}


def code_hash(c: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of characters at[i]:at[i + 1]; the characters' own
    hashes, and so the results, of two seeds are independent."""
    power, inverse = powers(len(c))
    h = _PLANE[seed][c & np.uint32(0xFFFF)]
    far = np.flatnonzero(c >> np.uint32(16))
    if len(far):
        h[far] = mix(c[far].astype(np.uint64) + np.uint64(seed))
    h *= power[: len(c)]
    sums = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(h, out=sums[1:])
    return mix((sums[at[1:]] - sums[at[:-1]]) * inverse[at[:-1]] + np.diff(at).astype(np.uint64))


def digests(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of each word's digest, as Words has them."""
    c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return code_hash(c, at, SEEDS[0]), code_hash(c, at, SEEDS[1])


def words(text: str, v: Vocabulary) -> list[str]:
    """The words of one text."""
    w = Words([text], v)
    distinct = w.distinct()
    return [distinct[i] for i in w.which]


def encode_long(word: str, v: Vocabulary) -> list[int]:
    """A word's codes: ids, and of characters without a piece -1 - code point."""
    n = len(word)
    if not v.bpe:
        best: list[tuple[float, int, int]] = [(0.0, -1, 0)]
        for e in range(1, n + 1):
            got = (NEVER, -1, 0)
            for s in range(max(0, e - v.longest), e):
                x = v.table.get(word[s:e])
                if x is None and e - s == 1:
                    x = (-1 - ord(word[s]), v.lowest)
                if x and best[s][0] + x[1] > got[0]:
                    got = (best[s][0] + x[1], s, x[0])
            best.append(got)
        out = []
        while n:
            out.append(best[n][2])
            n = best[n][1]
        return out[::-1]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    heap: list[tuple] = []

    def push(i: int) -> None:
        j = after[i]
        if j < n and (x := v.table.get(word[i : end[j]])):
            heapq.heappush(heap, (-x[1], i, end[i], end[j]))

    for i in range(n):
        push(i)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        j = after[i] if i >= 0 else n
        if end[i] != middle or j >= n or end[j] != stop:
            continue
        end[i] = stop
        end[j] = -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i < n:
        x = v.table.get(word[i : end[i]])
        out.append(x[0] if x else -1 - ord(word[i]))
        i = after[i]
    return out


# the lattice


def piece_table(spark: SparkSession, v: Vocabulary) -> DataFrame:
    """(piece, v): as many rows as the model has pieces. v: the id, and for a BPE model
    over it the rank of the score, equal ones of equal rank; for a unigram one the score."""
    ids, scores = np.array([i for i, _ in v.table.values()], np.int64), np.array([s for _, s in v.table.values()])
    if v.bpe:
        _, rank = np.unique(-scores, return_inverse=True)
        return spark.createDataFrame(pa.table({"piece": list(v.table), "v": pa.array(rank.astype(np.int64) << 32 | ids)}))
    return spark.createDataFrame(pa.table({"piece": list(v.table), "score": pa.array(scores), "id": pa.array(ids)})).select("piece", F.struct("score", "id").alias("v"))


def lattice(distinct: DataFrame, v: Vocabulary) -> DataFrame:
    """(word, n, edges): of each word the substrings of two characters or more that are
    pieces, as a map from start x 1024 + end to v of the table; and of single
    characters too for a unigram model. The join is with the piece table, which the
    model's file bounds, so it may be broadcast; grouping by word needs no exchange,
    for words are distributed by themselves already."""
    least = 2 if v.bpe else 1
    starts = distinct.select("word", "n", F.length("word").alias("m")).select("word", "n", "m", F.explode_outer(F.expr(f"IF(m < {least} OR m > {LONG}, NULL, sequence(0, m - {least}))")).alias("s"))
    ends = starts.select("word", "n", "s", F.explode_outer(F.expr(f"IF(s IS NULL, NULL, sequence(s + {least}, least(s + {v.longest}, m)))")).alias("e"))
    edges = ends.select("word", "n", F.expr("s * 1024 + e").alias("at"), F.expr("substring(word, s + 1, e - s)").alias("piece"))
    table = F.broadcast(piece_table(distinct.sparkSession, v))
    # a word without any edge is kept by its first substring, found or not
    met = edges.join(table, "piece", "left").where(F.col("v").isNotNull() | F.col("at").isNull() | (F.col("at") == least))
    return met.groupBy("word", "n").agg(F.map_from_entries(F.filter(F.collect_list(F.struct("at", "v")), lambda x: x["v"].isNotNull())).alias("edges"))


def merged(v: Vocabulary) -> F.Column:
    """The BPE fold: boundaries of the word's parts, of which each step takes one
    out; the best score first, the leftmost on a tie."""
    # no more steps than edges; -1 at the end: nothing is left to merge
    return F.expr("""
        aggregate(sequence(1, greatest(1, least(length(word) - 1, size(edges)))), sequence(0, length(word)),
          (b, k) -> IF(size(b) < 3 OR b[size(b) - 1] < 0, b, aggregate(array(array_min(transform(sequence(1, size(b) - 2), i -> shiftright(edges[b[i - 1] * 1024 + b[i + 1]], 32) * 1024 + i))),
             b, (x, best) -> IF(best IS NULL, array_append(x, -1), filter(x, (y, j) -> j <> best % 1024)))),
          b -> filter(b, y -> y >= 0))""")


def viterbi(v: Vocabulary) -> F.Column:
    """The unigram fold: for each position (score, start of the last piece); then
    the boundaries along the best path, from the end to the start."""
    low = repr(v.lowest)
    return F.expr(f"""
        aggregate(sequence(1, length(word)), array(struct(0D AS score, 0 AS neg)), (best, e) -> array_append(best,
            array_max(transform(sequence(greatest(0, e - {v.longest}), e - 1), s ->
              struct(best[s].score + coalesce(edges[s * 1024 + e].score, IF(e - s = 1, {low}D, {NEVER}D)) AS score, -s AS neg)))),
          best -> aggregate(sequence(1, length(word)), array(length(word)), (b, k) -> IF(b[0] = 0, b, array_prepend(b, -best[b[0]].neg))))""")


def encoded_words(distinct: DataFrame, v: Vocabulary) -> DataFrame:
    """(word, n, codes): ids, and of single characters left over -1 - code point; of
    words of more than LONG characters null. `distinct` is distributed by word."""
    bounds = merged(v) if v.bpe else viterbi(v)
    cut = lattice(distinct, v).select("word", "n", "edges", bounds.alias("b"))
    id_ = "edges[b[i - 1] * 1024 + b[i]] & 4294967295" if v.bpe else "edges[b[i - 1] * 1024 + b[i]].id"
    return cut.select("word", "n", F.expr(f"IF(length(word) > {LONG}, NULL, transform(sequence(1, size(b) - 1), i -> CAST(coalesce({id_}, -1 - ascii(substring(word, b[i - 1] + 1, 1))) AS INT)))").alias("codes"))


def expanded(codes: list[int], v: Vocabulary) -> list[int]:
    """Characters as their pieces' ids, or as the ids of their bytes, or as unknown; runs of
    unknown characters are one."""
    out: list[int] = []
    for x in codes:
        if x < 0 and v.single[-1 - x] >= 0:
            x = int(v.single[-1 - x])
        if x >= 0:
            out.append(x)
        elif v.fallback:
            out += [v.bytes_[y] for y in chr(-1 - x).encode("utf-8", "surrogatepass")]
        elif not out or out[-1] != v.unknown:
            out.append(v.unknown)
    return out


class Codes:
    """A map from digests to ids: sorted first halves, the second ones, and where each one's ids start."""

    def __init__(self, one: np.ndarray, two: np.ndarray, n: np.ndarray, flat: np.ndarray):
        order = np.lexsort((two, one))
        begin = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        self.one, self.two, self.n, self.begin, self.flat = one[order], two[order], n[order].astype(np.int64), begin[:-1][order], flat

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The position of each word, or -1."""
        if not len(self.one):
            return np.full(len(one), -1, np.int64)
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        out = np.where((self.one[at] == one) & (self.two[at] == two), at, -1)
        for i in np.flatnonzero((out < 0) & (self.one[at] == one)):  # another word has the same first half
            j = int(at[i])
            while j < len(self.one) and self.one[j] == one[i]:
                if self.two[j] == two[i]:
                    out[i] = j
                j += 1
        return out

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each position has, and the ids one after another."""
        n = self.n[at]
        ends = np.cumsum(n)
        return n, self.flat[np.repeat(self.begin[at] - ends + n, n) + np.arange(ends[-1] if len(n) else 0)]


def counted(batches: Iterator[pa.RecordBatch], v: Vocabulary) -> Iterator[pa.RecordBatch]:
    """(word, n) of the texts in the first column, which has no nulls: their distinct words
    and how often they occur, run of texts by run. Only one run's texts are Python's strings
    at a time, and what was in use goes back to the system at the end: the worker waits
    while Spark folds, which needs the memory."""

    def one(texts: list[str]) -> pa.RecordBatch:
        w = Words(texts, v)
        return pa.RecordBatch.from_arrays([pa.array(w.distinct(), pa.string()), pa.array(np.bincount(w.which).astype(np.int64))], ["word", "n"])

    for b in batches:
        texts = b.column(0)
        del b
        size = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        for lo, hi in _spans(np.concatenate([[0], size]).astype(np.int64), 4 << 20):
            if size[hi - 1] > (size[lo - 1] if lo else 0):
                yield one(texts.slice(lo, hi - lo).to_pylist())
        del texts
    lightened()


def _words(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """(word, n): the distinct words of all texts and how often they occur."""
    found = docs.where("text IS NOT NULL").select("text").mapInArrow(lambda batches: counted(batches, shared.value), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _ids(words: list[str], codes: list[list[int] | None], v: Vocabulary) -> list[list[int]]:
    return [expanded(encode_long(w, v) if x is None else x, v) for w, x in zip(words, codes, strict=True)]


def _flat_ids(words: list[str], codes: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """What _ids gives, as how many each word has, and all one after another: only words
    with characters that have no piece, and long ones, are taken one by one."""
    n = pc.fill_null(pc.list_value_length(codes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    left = np.flatnonzero(flat < 0)
    flat[left] = np.where(v.single[-1 - flat[left]] >= 0, v.single[-1 - flat[left]], flat[left])
    ends = np.cumsum(n)
    odd = np.union1d(np.searchsorted(ends, left[flat[left] < 0], side="right"), np.flatnonzero(codes.is_null()))
    if not len(odd):
        return n, flat
    lists = _ids([words[i] for i in odd.tolist()], codes.take(pa.array(odd)).to_pylist(), v)
    more = np.array([len(x) for x in lists], np.int64)
    begin = ends - n
    begin[odd] = len(flat) + np.cumsum(more) - more
    n[odd] = more
    flat = np.concatenate([flat, np.array([y for x in lists for y in x], np.int32)])
    ends = np.cumsum(n)
    return n, flat[np.repeat(begin - ends + n, n) + np.arange(ends[-1])]


def _parts(shared: Broadcast, blocks: int):
    """(word, n, codes) to (block, part): words' digests and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            words = b.column(0).to_pylist()
            one, two = digests(words)
            table = Codes(one, two, *_flat_ids(words, b.column(2), shared.value))
            order, edge, block = split_by((table.one % np.uint64(blocks)).astype(np.int64))
            parts = []
            for a, e in zip(edge[:-1], edge[1:], strict=True):
                k, flat = table.take(order[a:e])
                parts.append(_part(table.one[order[a:e]], table.two[order[a:e]], k, flat))
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(parts, pa.binary())], ["block", "part"])

    return run


def _part(one: np.ndarray, two: np.ndarray, n: np.ndarray, flat: np.ndarray) -> bytes:
    head = deflated([one, two, n.astype(np.int32)], 1)
    return np.int64(len(head)).tobytes() + head + deflated([flat.astype(np.int32)])


def _codes(parts: list[bytes]) -> Codes:
    rows = []
    for x in parts:
        size = int(np.frombuffer(x, np.int64, 1)[0])
        rows.append([*inflated(x[8 : 8 + size], [np.uint64, np.uint64, np.int32], 1), inflated(x[8 + size :], [np.int32])[0]])
    return Codes(*(np.concatenate(x) for x in zip(*rows, strict=True))) if rows else Codes(*(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int32, np.int32)))


#: Words of one block: its answers to all groups are made in one memory.
BLOCK_WORDS = 1 << 16


def encode(docs: DataFrame, model: str = MODEL, group_bytes: int = GROUP_BYTES // 2, cache: int = CACHE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row: the same ids as the model's own library gives.

    A null text has null ids, an empty text none. Rows that repeat an id are
    encoded one by one, equal texts alike. Texts are used whole, however long; other
    columns are ignored. No rows give no rows. `cache` changes what travels, not what
    comes out.
    """
    v = vocabulary(model)
    shared = docs.sparkSession.sparkContext.broadcast(v)
    base = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    coded = written(encoded_words(_words(base, shared), v), "words")
    blocks = max(16, rows_of(coded) // BLOCK_WORDS)
    top = coded.orderBy(F.desc("n"), "word").limit(cache).toArrow()  # at most `cache` words
    one, two = digests(top.column("word").to_pylist())
    ids = _flat_ids(top.column("word").to_pylist(), top.column("codes").combine_chunks(), v) if top.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int32))
    known = docs.sparkSession.sparkContext.broadcast(Codes(one, two, *ids))
    del top, ids
    tables = coded.mapInArrow(_parts(shared, blocks), "block long, part binary")

    def questions(blob: bytes) -> tuple[pa.Table, Words, np.ndarray, tuple]:
        """A group, its words, where the cache has them, and the others by block."""
        t = unpacked(blob)
        w = Words(t.column("text").to_pylist(), shared.value)
        at = known.value.find(w.one, w.two)
        rest = np.flatnonzero(at < 0)
        order, edge, block = split_by((w.one[rest] % np.uint64(blocks)).astype(np.int64))
        return t, w, at, (rest[order], edge, block)

    def ask(blob: bytes) -> Iterator[tuple[int, bytes]]:
        _, w, _, (rest, edge, block) = questions(blob)
        for a, e, b in zip(edge[:-1], edge[1:], block.tolist(), strict=True):
            yield b, deflated([w.one[rest[a:e]], w.two[rest[a:e]]], 1)

    def answer(t: pa.Table):
        table = _codes(t.column("part").to_pylist())

        def one(part: bytes) -> bytes:
            n, flat = table.take(table.find(*inflated(part, [np.uint64, np.uint64], 1)))
            head = deflated([n.astype(np.int32)])
            return np.int64(len(head)).tobytes() + head + deflated([flat.astype(np.int32)])

        return one

    def finish(blob: bytes, answers: dict[int, bytes]) -> pa.Table:
        t, w, at, (rest, _, block) = questions(blob)
        have = np.flatnonzero(at >= 0)
        n, flat = known.value.take(at[have])
        counts, flats = [n], [flat]
        for b in block.tolist():
            size = int(np.frombuffer(answers[b], np.int64, 1)[0])
            counts.append(inflated(answers[b][8 : 8 + size], [np.int32])[0])
            flats.append(inflated(answers[b][8 + size :], [np.int32])[0])
        number = np.empty(len(w.one), np.int64)
        number[np.concatenate([have, rest])] = np.arange(len(w.one))
        n, flat = np.concatenate(counts).astype(np.int64), np.concatenate(flats).astype(np.int32)
        first = np.concatenate([[0], np.cumsum(n)])
        which = number[w.which]
        begin = np.concatenate([[0], np.cumsum(n[which])])
        ids = flat[np.repeat(first[which] - begin[:-1], n[which]) + np.arange(begin[-1])]
        return pa.table({"doc_id": t.column("doc_id").combine_chunks(), "ids": pa.ListArray.from_arrays(pa.array(begin[w.first].astype(np.int32)), pa.array(ids))})

    schema = T.StructType([base.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    done = answered(packed(base.where("text IS NOT NULL"), "text", group_bytes), ask, tables, answer, finish, schema)
    return done.union(base.where("text IS NULL").select("doc_id", F.lit(None).cast("array<int>").alias("ids")))


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with the text that `ids` stand for, in place of a column of that name.

    Control pieces are nothing, the unknown piece is ' ⁇ ', and bytes that are
    no UTF-8 are U+FFFD. Null ids give a null text, none an empty one; an id that
    the model doesn't have raises. Other columns stay; no rows give no rows.
    """
    v = vocabulary(model)
    single = [i for i, k in enumerate(v.kinds) if k == 6]
    shown = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else " ⁇ ".encode() if k == 2 else p.replace(SPACE, " ").encode() for p, k in zip(v.pieces, v.kinds, strict=True)]

    sign = next(chr(c) for c in range(0xE000, 0xF900) if not any(chr(c) in p for p in v.pieces))  # that no piece has

    def joined(parts: list[str]) -> F.Column:
        """The entries of the ids in one text."""
        table = F.split(F.lit(sign.join(parts)), sign)
        return F.array_join(F.transform(ids, lambda i: table[i]), "")

    # pieces that are a byte each may be parts of a character: texts that may have some (one test of the
    # least id tells, a test of each id takes as long as decoding) are put together as bytes, which is right for all
    exact = F.make_valid_utf8(F.unhex(joined([x.hex() for x in shown])).cast("string"))
    plain = joined(["" if k == 6 else x.decode() for x, k in zip(shown, v.kinds, strict=True)])
    whole = F.when(F.array_min(ids) <= max(single), exact).otherwise(plain) if single else plain
    name = fresh(rows, "decoded")
    done = rows.withColumn(name, whole)
    cut = F.when(F.lit(v.prefix) & F.startswith(name, F.lit(" ")), F.substring(name, 2, 1 << 30)).otherwise(F.col(name))
    return done.withColumn(text, cut).drop(name)
