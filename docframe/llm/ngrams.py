"""Byte n-grams and backoff models over them, in blocks that no memory bounds.

A token is a byte of the UTF-8 text; a text ends with END, and its first tokens
have START before them. The vocabulary is the 255 values a token can take, so
every text can be scored and every distribution sums to one.

An n-gram is a 64-bit code: the nearest token of its context in the highest byte,
then the farther ones, and in the lowest byte the token that it predicts. So
n-grams in order stand by context, those of a block of nearest contexts have all
that they back off to beside them, and sorted codes compress to about a byte.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import deflated, inflated, lightened, mix, slices, split_by

START, END = 0xFF, 0xFE  # bytes that UTF-8 never has
VOCABULARY = 255  # 254 bytes that may occur, and END
UNKNOWN = "und"
#: n-grams are cut into blocks by so many nearest tokens of their context. Orders up to
#: this are held by the driver: at most 256 ** LOW n-grams, however large the corpus.
LOW = 3
#: Counts of so many tasks are combined at first, then those sums.
FAN = 64
#: n-grams that a task holds besides merged ones, and at most: some 16 bytes each, and as much again while they are merged.
MORE, MOST = 1_500_000, 3_000_000
#: Texts are coded and scored in slices of so many bytes: of each byte some 16 and 40 are held at once.
CODED, SCORED = 2 << 20, 1 << 20


def codes(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The code of the n-gram that ends at each token (END included), and where each text's codes start."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    pad = order - 1
    row = np.repeat(np.arange(n), size)
    out = np.full(len(data) + n * order, START, np.uint8)
    out[np.arange(len(data)) + row * order + pad] = data
    ends = offsets[1:] + np.arange(n) * order + pad
    out[ends] = END
    code = np.zeros(len(out), np.uint64)
    code[pad:] |= out[pad:].astype(np.uint64)
    for k in range(1, order):
        code[pad:] |= out[pad - k : len(out) - k].astype(np.uint64) << np.uint64(8 * (order - k))
    keep = np.ones(len(out), bool)
    for k in range(pad):
        keep[ends - size - 1 - k] = False
    return code[keep], np.concatenate([[0], np.cumsum(size + 1)])


def lower(code: np.ndarray) -> np.ndarray:
    """The n-grams without the farthest token of their contexts."""
    return (code >> np.uint64(16)) << np.uint64(8) | (code & np.uint64(0xFF))


def runs(code: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and their counts."""
    if not len(code):
        return code, np.zeros(0, np.int64)
    if count is None:
        code = np.sort(code)
    else:
        at = np.argsort(code, kind="stable")
        code, count = code[at], count[at]
    edge = np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1])
    if count is None:
        return code[edge], np.diff(np.append(edge, len(code)))
    return code[edge], np.add.reduceat(count, edge)


def language(df: DataFrame, lang: str | None) -> F.Column:
    return F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)) if lang else F.lit(UNKNOWN)


def context_block(code: np.ndarray, order: int, blocks: int) -> np.ndarray:
    """The block of each n-gram: by the LOW nearest tokens of its context."""
    return (mix(code >> np.uint64(8 * (order - LOW))) % np.uint64(blocks)).astype(np.int64)


def text_counts(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of texts in order, and their counts."""
    parts = [runs(codes(data, offsets, order)[0]) for _, _, data, offsets in slices(texts, CODED)]
    return runs(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def counts(docs: DataFrame, order: int, blocks: int, text: str = "text", lang: str | None = None) -> DataFrame:
    """(lang, block, part): all n-grams of the non-null texts with their counts, each
    block's merged, sorted and deflated (uint64, int64). Counts are combined within
    each task, then over FAN tasks, then over all: so no merge has more parts than
    distinct n-grams warrant, however many tasks there are."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)
        size: dict[str, int] = defaultdict(int)
        fan = TaskContext.get().partitionId() // FAN

        def shrink(name: str) -> None:
            c, k = (np.concatenate(x) for x in zip(*held[name], strict=True))
            held[name] = [runs(c, k)]
            size[name] = len(held[name][0][0])

        def out(name: str) -> pa.RecordBatch:
            shrink(name)
            c, k = held[name][0]
            at, edge, ids = split_by(context_block(c, order, blocks))
            c, k = c[at], k[at].astype(np.int64)
            parts = [deflated([c[a:b], k[a:b]], 1) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([name] * len(parts)), pa.array(ids), pa.array([fan] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["lang", "block", "fan", "part"])

        for b in batches:
            names = b.column(0)
            for name in names.unique().to_pylist():
                texts = b.column(1).filter(pc.equal(names, name))
                for _, _, data, offsets in slices(texts, CODED):
                    held[name].append(runs(codes(data, offsets, order)[0]))
                    size[name] += len(held[name][-1][0])
                    if size[name] > len(held[name][0][0]) + MORE:
                        shrink(name)
                    if size[name] > MOST:  # what is held is sent on, to be merged with the rest
                        yield out(name)
                        held[name], size[name] = [], 0
        for name in sorted(held):
            if held[name]:
                yield out(name)
            del held[name]
        lightened()

    def merge(t: pa.Table) -> bytes:
        parts = [inflated(x.as_py(), [np.uint64, np.int64], 1) for x in t.column("part")]
        return deflated(list(runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))), 1)

    def some(key: tuple, t: pa.Table) -> pa.Table:
        return pa.table({"lang": [key[0].as_py()], "block": [key[1].as_py()], "part": pa.array([merge(t)], pa.binary())})

    source = docs.where(F.col(text).isNotNull()).select(language(docs, lang).alias("lang"), F.col(text).alias("text"))
    first = source.mapInArrow(gather, "lang string, block long, fan long, part binary").groupBy("lang", "block", "fan")
    schema = "lang string, block long, part binary"
    return first.applyInArrow(some, schema).groupBy("lang", "block").applyInArrow(some, schema)


# models


class Level(NamedTuple):
    """One order's table: sorted n-grams with log p, sorted contexts with log weight."""

    code: np.ndarray
    p: np.ndarray
    context: np.ndarray
    weight: np.ndarray


def find(keys: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, whether there) of each code in sorted keys."""
    if not len(keys):
        return np.zeros(len(code), np.int64), np.zeros(len(code), bool)
    at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
    return at, keys[at] == code


def score(levels: list[Level], code: np.ndarray, n: int) -> np.ndarray:
    """log p of each n-gram's last token after its others, by recursion on the order."""
    if n == 0:
        return np.full(len(code), -np.log(VOCABULARY))
    level = levels[n - 1]
    at, seen = find(level.code, code)
    out = level.p[at].astype(np.float64) if len(level.p) else np.zeros(len(code))
    rest = np.flatnonzero(~seen)
    if len(rest):
        low = score(levels, lower(code[rest]), n - 1)
        j, there = find(level.context, code[rest] >> np.uint64(8))
        out[rest] = low + np.where(there, level.weight[j], 0.0) if len(level.weight) else low
    return out


def contexts(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted n-gram codes: the distinct contexts, and the first n-gram of each."""
    h = code >> np.uint64(8)
    edge = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1]) if len(h) else np.zeros(0, np.int64)
    return h[edge], edge


class Katz:
    """Katz backoff with Good-Turing's discounts of counts 1..cutoff.

    n-grams of any order are kept however rare they are. A context whose n-grams
    have all the mass gives half a count to the rest."""

    def __init__(self, cutoff: int = 5):
        self.cutoff = cutoff

    def below(self, code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The counts of the next lower order."""
        return runs(lower(code), count)

    def of(self, count: np.ndarray) -> np.ndarray:
        """Counts of counts, which add up over blocks."""
        return np.bincount(np.minimum(count, self.cutoff + 2), minlength=self.cutoff + 3)[: self.cutoff + 2].astype(np.int64)

    def discounts(self, of: np.ndarray) -> np.ndarray:
        """Good-Turing's ratio of counts 0..cutoff; where it isn't in (0, 1], the count is kept."""
        cutoff, out = self.cutoff, np.ones(self.cutoff + 1)
        if of[1]:
            common = (cutoff + 1) * of[cutoff + 1] / of[1]
            for r in range(1, cutoff + 1):
                if of[r] and common < 1 and 0 < (x := ((r + 1) * of[r + 1] / of[r] / r - common) / (1 - common)) <= 1:
                    out[r] = x
        return out

    def level(self, code: np.ndarray, count: np.ndarray, n: int, ratio: np.ndarray, low: list[Level]) -> Level:
        """The table of order n from all its counts that share contexts, with the tables below."""
        h, edge = contexts(code)
        if not len(code):
            return Level(code, np.zeros(0), h, np.zeros(0))
        total = np.add.reduceat(count, edge).astype(float)
        which = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(code))))
        p = np.where(count > self.cutoff, 1.0, ratio[np.minimum(count, self.cutoff)]) * count / total[which]
        mass = np.add.reduceat(p, edge)
        rest = np.add.reduceat(np.exp(score(low, lower(code) if n > 1 else code, n - 1)), edge)
        full = (mass > 1 - 1e-9) & (rest < 1 - 1e-12)
        share = np.where(full, total / (total + 0.5), 1.0)
        p, mass = p * share[which], mass * share
        every = rest >= 1 - 1e-12  # nothing is left below: these take all
        p = np.where(every[which], p / np.maximum(mass[which], 1e-300), p)
        weight = np.where(every, 1.0, (1 - np.where(every, 0, mass)) / np.where(every, 1, 1 - rest))
        return Level(code, np.log(p), h, np.log(np.maximum(weight, 1e-300)))


class KneserNey:
    """Interpolated modified Kneser-Ney: the counts of lower orders are of the distinct
    tokens before an n-gram; three discounts an order. Where counts of counts give no
    usable discount, 0.5, 1 and 1.5 stand for them."""

    def below(self, code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return runs(lower(code))

    def of(self, count: np.ndarray) -> np.ndarray:
        return np.bincount(np.minimum(count, 5), minlength=6)[:5].astype(np.int64)

    def discounts(self, of: np.ndarray) -> np.ndarray:
        out = np.array([0, 0.5, 1.0, 1.5])
        if of[1] and of[2]:
            y = of[1] / (of[1] + 2 * of[2])
            for i in (1, 2, 3):
                if of[i] and 0 < (x := i - (i + 1) * y * of[i + 1] / of[i]) < i:
                    out[i] = x
        return out

    def level(self, code: np.ndarray, count: np.ndarray, n: int, discount: np.ndarray, low: list[Level]) -> Level:
        h, edge = contexts(code)
        if not len(code):
            return Level(code, np.zeros(0), h, np.zeros(0))
        cut = discount[np.minimum(count, 3)]
        total = np.add.reduceat(count, edge).astype(float)
        weight = np.add.reduceat(cut, edge) / total
        which = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(code))))
        p = (count - cut) / total[which] + weight[which] * np.exp(score(low, lower(code) if n > 1 else code, n - 1))
        return Level(code, np.log(p), h, np.log(np.maximum(weight, 1e-300)))


def orders(kind: Katz | KneserNey, code: np.ndarray, count: np.ndarray, top: int, down_to: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The counts of orders top..down_to from sorted counts of order top."""
    out = {top: (code, count)}
    for n in range(top - 1, down_to - 1, -1):
        out[n] = kind.below(*out[n + 1])
    return out


class Bottom(NamedTuple):
    """What every block's model needs of a language: the tables of orders 1..LOW, and
    the discounts of each order above. The alphabet bounds its size."""

    levels: list[Level]
    discounts: list[np.ndarray]


def bottoms(merged: DataFrame, kind: Katz | KneserNey, order: int) -> dict[str, Bottom]:
    """Of each language, from the merged counts."""
    size = len(kind.of(np.zeros(0, np.int64)))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                by = orders(kind, *inflated(x.as_py(), [np.uint64, np.int64], 1), order, LOW)
                of = np.concatenate([kind.of(by[n][1]) for n in range(LOW + 1, order + 1)])
                # low n-grams of a block are cut by their code, so that what is merged at once is small
                at, edge, ids = split_by((mix(by[LOW][0]) % np.uint64(16)).astype(np.int64))
                c, k = by[LOW][0][at], by[LOW][1][at].astype(np.int64)
                parts = [deflated([c[i:j], k[i:j]], 1) for i, j in zip(edge[:-1], edge[1:], strict=True)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (n + 1)), pa.array([-1, *ids.tolist()], pa.int64()), pa.array([of.tobytes(), *parts], pa.binary())], ["lang", "cut", "part"])

    def add(key: tuple, t: pa.Table) -> pa.Table:
        parts = t.column("part").to_pylist()
        if key[1].as_py() < 0:
            out = sum(np.frombuffer(x, np.int64) for x in parts).tobytes()
        else:
            out = deflated(list(runs(*(np.concatenate(x) for x in zip(*(inflated(x, [np.uint64, np.int64], 1) for x in parts), strict=True)))), 1)
        return pa.table({"lang": [key[0].as_py()], "cut": [key[1].as_py()], "part": pa.array([out], pa.binary())})

    schema = "lang string, cut long, part binary"
    # rows: 17 for each language; bytes: at most 256 ** LOW n-grams of each, whatever the corpus
    rows = merged.select("lang", "part").mapInArrow(part, schema).groupBy("lang", "cut").applyInArrow(add, schema).collect()
    by: dict[str, list] = defaultdict(list)
    tops: dict[str, np.ndarray] = {}
    for r in rows:
        if r.cut < 0:
            tops[r.lang] = np.frombuffer(r.part, np.int64).reshape(-1, size)
        else:
            by[r.lang].append(inflated(bytes(r.part), [np.uint64, np.int64], 1))
    out = {}
    for name, parts in by.items():
        small = orders(kind, *runs(*(np.concatenate(x) for x in zip(*parts, strict=True))), LOW, 1)
        levels: list[Level] = []
        for n in range(1, LOW + 1):
            levels.append(kind.level(*small[n], n, kind.discounts(kind.of(small[n][1])), levels))
        out[name] = Bottom(levels, [kind.discounts(x) for x in tops[name]])
    return out


def block_levels(kind: Katz | KneserNey, part: bytes, bottom: Bottom, order: int) -> list[Level]:
    """All levels of a block's model, the low ones included."""
    by = orders(kind, *inflated(part, [np.uint64, np.int64], 1), order, LOW + 1)
    levels = list(bottom.levels)
    for n in range(LOW + 1, order + 1):
        levels.append(kind.level(*by[n], n, bottom.discounts[n - LOW - 1], levels))
    return levels


# scores


def asked(texts: pa.Array, order: int, block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of texts by (block, code), where each block starts, and the blocks."""
    code, _ = text_counts(texts, order)
    at, edge, ids = split_by(block(code))
    return code[at], edge, ids


def sums(texts: pa.Array, code: np.ndarray, p: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of tokens of each text, and the sum of their log p, from the
    distinct n-grams' (in any order)."""
    at = np.argsort(code)
    code, p = code[at], p[at].astype(np.float64)
    n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for i, j, data, offsets in slices(texts, SCORED):
        c, first = codes(data, offsets, order)
        back = np.argsort(c)  # a distinct code is looked up once
        s = c[back]
        edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        v = np.empty(len(c))
        v[back] = np.repeat(p[np.searchsorted(code, s[edge])], np.diff(np.append(edge, len(s))))
        total[i:j] = np.add.reduceat(v, first[:-1])
        n[i:j] = np.diff(first)
    return n, total
