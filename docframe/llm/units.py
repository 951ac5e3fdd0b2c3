"""Repeated lines and sentences by global hashing.

A text is divided into units: lines, and within a line sentences (up to a full
stop, exclamation or question mark before a blank). A unit is normalised to its
word tokens, folded; its digest is 128 bits of them. Digests are grouped over
all documents; the occurrence that ranks first, by (doc_id, position), stays, and
all others are removed, named by their offsets in the original text.

With `whole`, a line is a unit however short it is, and so is a paragraph, as all
of its lines are. Short sentences within a line repeat by chance (of those of one
word at sf 0.1, 86 %), so they are units together with their neighbours: from each
short sentence on, and up to each, the fewest sentences of LEAST words in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.llm.common import Tokens, Windows, char_offsets, column, fresh, mix, slices, written

#: Sentences of fewer words repeat by chance and aren't units of their own.
LEAST = 8

_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True


def divide(data: np.ndarray, offsets: np.ndarray, tokens: Tokens) -> tuple[np.ndarray, ...]:
    """(row, first token, end token, start byte, end byte) of each unit with a token."""
    n = len(data)
    ends = np.zeros(n + 1, bool)  # a unit ends before this byte
    line = np.flatnonzero(data == 10)
    ends[line] = True
    stop = np.flatnonzero(_STOP[data[:-1]] & _BLANK[data[1:]]) + 1 if n > 1 else np.zeros(0, np.int64)
    ends[stop] = True
    ends[offsets[1:]] = True
    at = np.flatnonzero(ends)
    unit = np.searchsorted(at, tokens.start, side="right")
    row = np.searchsorted(offsets, tokens.start, side="right") - 1
    if not len(unit):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    first = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (row[1:] != row[:-1])]))
    last = np.append(first[1:], len(unit))
    return row[first], first, last, tokens.start[first], at[unit[first]]


def joined(data: np.ndarray, offsets: np.ndarray, least: int, row: np.ndarray, first: np.ndarray, last: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the sentences that divide() gives: those of `least` words, the runs of
    sentences of a line around shorter ones, and all whole lines."""
    count = len(row)
    if not count:
        return row, first, last, start, end
    break_ = np.flatnonzero(data == 10)
    line = np.searchsorted(break_, start, side="right")
    edge = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (row[1:] != row[:-1])]))
    stop = np.append(edge[1:], count)  # the lines' sentences are edge..stop - 1
    which = np.repeat(np.arange(len(edge)), stop - edge)
    short = np.flatnonzero(last - first < least)
    # tokens of neighbouring sentences are neighbours
    after = np.searchsorted(last, first[short] + least)
    before = np.searchsorted(first, last[short] - least, side="right") - 1
    on, up = after < stop[which[short]], before >= edge[which[short]]
    own = np.flatnonzero(last - first >= least)
    a = np.concatenate([own, short[on], before[up], edge])
    z = np.concatenate([own, after[on], short[up], stop - 1])
    a, z = np.divmod(np.unique(a * count + z), count)
    limit = np.append(break_, len(data))[line]
    tail = np.where(z == stop[which[z]] - 1, np.minimum(limit[z], offsets[1:][row[z]]), end[z])
    one = (a == z) & (last[z] - first[a] >= least)  # a sentence ends where it ends
    return row[a], first[a], last[z], start[a], np.where((a == edge[which[a]]) & ~one, tail, end[z])


def units(docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """(h1, h2, doc, sub, start, end, n_words) of each unit of `least` words or more;
    with `whole`, those of joined(). sub tells texts that share an id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = b.column(0)
            for i, j, data, offsets in slices(b.column(2)):
                tokens, chars = Tokens(data, offsets), char_offsets(data)
                row, first, last, start, end = divide(data, offsets, tokens)
                if whole:
                    row, first, last, start, end = joined(data, offsets, least, row, first, last, start, end)
                else:
                    some = np.flatnonzero(last - first >= least)
                    row, first, last, start, end = (x[some] for x in (row, first, last, start, end))
                if not len(row):
                    continue
                one = Windows(tokens.hash).hash(first, last - first)
                two = Windows(mix(tokens.hash ^ np.uint64(0xA5A5A5A55A5A5A5A))).hash(first, last - first)
                zero = chars[offsets[:-1]][row]
                cols = [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), doc.take(pa.array(row + i)), b.column(1).take(pa.array(row + i)), pa.array((chars[start] - zero).astype(np.int32)), pa.array((chars[end] - zero).astype(np.int32)), pa.array((last - first).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["h1", "h2", "doc", "sub", "start", "end", "n_words"]
    source = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.hash(text).alias("sub"), F.col(text).alias("text"))
    kinds = [T.LongType(), T.LongType(), docs.schema[key].dataType, *[T.IntegerType()] * 4]
    return source.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def _repeats(docs: DataFrame, least: int, key: str, text: str, whole: bool) -> DataFrame:
    """The units that repeat an earlier one, with first: (doc, sub, start, end) of that."""
    all_ = written(units(docs, least, key, text, whole), "units")
    # map-side combining keeps a digest with very many occurrences small; the join
    # back splits it by adaptive execution
    first = all_.groupBy("h1", "h2").agg(F.min(F.struct("doc", "sub", "start", "end")).alias("first"), F.max(F.struct("doc", "sub", "start")).alias("last")).where("struct(first.doc, first.sub, first.start) <> last").select("h1", "h2", "first")
    out = all_.join(first, ["h1", "h2"]).where("struct(doc, sub, start) <> struct(first.doc, first.sub, first.start)")
    return out.where("doc <> first.doc OR sub <> first.sub OR start >= first.end") if whole else out


def repeated_units(docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """(doc_id, start, end, n_words, kept_doc_id, kept_start): the units that repeat
    one of an earlier rank, as spans of characters of the original text, end
    exclusive, and where that one stands.

    Case, blanks and punctuation don't matter. Units of fewer than `least` words
    are left alone, unless `whole` is set: then lines of any length and runs of
    short sentences are units too, so spans may overlap, and one that overlaps
    the first occurrence of its own words is no later occurrence. Rows with a null id or text, and empty texts, have no unit.
    Rows that repeat an id and a text are one document; texts that share an id are
    told apart by a hash, and come in its order. Texts are used whole, however long;
    other columns are ignored. No rows give no rows.
    """
    out = _repeats(docs, least, key, text, whole)
    return out.select(F.col("doc").alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("n_words").cast("long").alias("n_words"), F.col("first.doc").alias("kept_doc_id"), F.col("first.start").cast("long").alias("kept_start")).distinct()


def without_repeated_units(docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text", chars: str = "n_chars", whole: bool = False) -> DataFrame:
    """docs with the spans of repeated_units cut out of their texts. A document of
    which only blanks are left has no row. The column `chars`, if there is one,
    is counted again where the text changed. Other rows stay as they are: those with a
    null id or text, and empty texts. Of texts that share an id each loses its own
    spans only; rows that repeat an id and a text are cut alike. No rows give no rows."""
    cut, id_, sub, mark = (fresh(docs, x) for x in ("unit_spans", "unit_doc", "unit_sub", "unit_mark"))
    spans = _repeats(docs, least, key, text, whole).groupBy(F.col("doc").alias(id_), F.col("sub").alias(sub))
    spans = spans.agg(F.sort_array(F.collect_set(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias(cut))
    marked = docs.withColumn(mark, F.hash(F.col(text)))
    joined = marked.join(spans, (marked[key] == spans[id_]) & (marked[mark] == spans[sub]), "left")
    kept = F.aggregate(
        cut,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), (F.greatest(s["start"], a["at"]) - a["at"]).cast("int"))).alias("out"), F.greatest(s["end"], a["at"]).alias("at")),
        lambda a: F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), F.length(text))),
    )
    body = F.when(F.col(cut).isNull(), F.col(text)).otherwise(kept)
    name = fresh(joined, "unit_text")
    out = joined.withColumn(name, body).where(F.col(cut).isNull() | (F.trim(F.regexp_replace(name, r"\s+", " ")) != ""))
    cols = [F.col(name).alias(c) if c == text else F.when(F.col(cut).isNotNull(), F.length(name)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == chars else F.col(c) for c in docs.columns]
    return out.select(*cols)
