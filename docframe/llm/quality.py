"""Quality by n-gram perplexity: a modified Kneser-Ney model for each language,
counted over all documents, and a band of perplexity that documents of the
language must lie in.

Text that repeats itself or is full of stock symbols is too predictable and
falls below the band; garbled text lies above it. A document's mean log
perplexity varies more the shorter it is, so the half-width of the band for a
text of n tokens is k x sqrt(s^2 / n + spread^2), around the language's median;
s is a robust deviation of one token's log perplexity, estimated from all
documents of the language.

No task, broadcast or driver holds a language's model. Counts are merged in blocks
of contexts; a block's n-grams with their interpolated probabilities become sorted
arrays, in blocks of (nearest context, predicted token), so that a frequent context
is spread over many; groups of documents ask these blocks about their n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.llm import ngrams
from docframe.llm.common import GROUP_BYTES, answered, blocks_for, deflated, discarded, fresh, inflated, mix, packed, split_by, unpacked, written
from docframe.llm.ngrams import KneserNey, find

ORDER = 6
#: Set against labelled documents, junk and clean ones; README has the rates.
LOWER = 4.0
UPPER = 2.0
SPREAD = 0.02
BLOCK_BYTES = 4 << 20


def _place(code: np.ndarray, order: int, blocks: int) -> np.ndarray:
    """The block that an n-gram is looked up in."""
    near = code >> np.uint64(8 * (order - ngrams.LOW))
    return (mix(near << np.uint64(8) | (code & np.uint64(0xFF))) % np.uint64(blocks)).astype(np.int64)


def scored(docs: DataFrame, order: int = ORDER, text: str = "text", lang: str = "lang", keep: list[str] | None = None, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, str, str]:
    """docs (the columns in keep, or all) with the number of tokens of each text
    and its mean log perplexity under its language's model; the two names. Rows with
    a null text have 0 tokens and no perplexity."""
    kind = KneserNey()
    size, mean = fresh(docs, "n_tokens"), fresh(docs, "log_perplexity")
    tag, body = fresh(docs, "model_lang"), fresh(docs, "model_text")
    names = list(keep if keep is not None else docs.columns)
    blocks = blocks_for(docs, text, BLOCK_BYTES)
    merged = written(ngrams.counts(docs, order, blocks, text, lang), "counts")
    low = ngrams.bottoms(merged, kind, order)
    number = {name: k for k, name in enumerate(sorted(low))}
    bottom = docs.sparkSession.sparkContext.broadcast(low)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                top = ngrams.block_levels(kind, part.as_py(), bottom.value[name], order)[-1]
                at, edge, ids = split_by(_place(top.code, order, blocks))
                code, p = top.code[at], top.p[at].astype(np.float32)
                parts = [deflated([code[i:j], p[i:j]], 1) for i, j in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids + number[name] * blocks), pa.array(parts, pa.binary())], ["block", "grams"])

    tables = written(merged.select("lang", "part").mapInArrow(build, "block long, grams binary"), "kneser-ney")
    discarded(merged)

    def questions(t: pa.Table) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """For each language of a group: its rows, texts, n-grams, and their blocks' starts and numbers."""
        tags, texts = t.column(tag).combine_chunks(), t.column(body).combine_chunks()
        for name in sorted(tags.unique().to_pylist()):
            rows = np.flatnonzero(np.asarray(pc.equal(tags, name)))
            some = texts.take(pa.array(rows))
            code, edge, ids = ngrams.asked(some, order, lambda c: _place(c, order, blocks))
            yield rows, some, code, edge, ids + number[name] * blocks

    def ask(blob: bytes) -> Iterator[tuple[int, bytes]]:
        for _, _, code, edge, ids in questions(unpacked(blob)):
            for a, b, block in zip(edge[:-1], edge[1:], ids.tolist(), strict=True):
                yield block, deflated([code[a:b]], 1)

    def answer(t: pa.Table):
        parts = [inflated(x.as_py(), [np.uint64, np.float32], 1) for x in t.column("grams")]
        code, p = (np.concatenate(x) for x in zip(*parts, strict=True))
        at = np.argsort(code)
        code, p = code[at], p[at]
        return lambda part: deflated([p[find(code, inflated(part, [np.uint64], 1)[0])[0]]])

    def finish(blob: bytes, answers: dict[int, bytes]) -> pa.Table:
        t = unpacked(blob)
        n, far = np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows)
        for rows, texts, code, _, ids in questions(t):
            p = np.concatenate([inflated(answers[i], [np.float32])[0] for i in ids.tolist()])
            n[rows], far[rows] = ngrams.sums(texts, code, p, order)
        return pa.table([*(t.column(f"c{k}") for k in range(len(names))), pa.array(n), pa.array(-far / n)], names=[*out_names, size, mean])

    out_names = names
    source = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(names)], ngrams.language(docs, lang).alias(tag), F.col(text).alias(body))
    fields = [docs.schema[c] for c in names]
    schema = T.StructType([*fields, T.StructField(size, T.LongType()), T.StructField(mean, T.DoubleType())])
    got = answered(packed(source.where(F.col(body).isNotNull()), body, group_bytes), ask, tables, answer, finish, schema)
    none = docs.where(F.col(text).isNull()).select(*names, F.lit(0).cast("long").alias(size), F.lit(None).cast("double").alias(mean))
    return got.union(none), size, mean


def bands(rows: DataFrame, size: str, score: str, lang: F.Column) -> DataFrame:
    """(band_lang, middle, deviation) of each language, over all its scored documents.

    Two exact medians over log perplexities rounded to 1/4096: of the documents,
    then of their distances from it times the root of their lengths."""
    x = F.round(F.col(score) * 4096).cast("long")
    # only counts of rounded values are shuffled, however many documents there are
    first = rows.where(F.col(score).isNotNull()).groupBy(lang.alias("band_lang"), x.alias("x")).agg(F.count("*").alias("n"))
    middle = first.groupBy("band_lang").agg((F.percentile("x", F.lit(0.5), F.col("n")) / 4096).alias("middle"))
    far = F.round(F.abs(F.col(score) - F.col("middle")) * F.sqrt(size) * 256).cast("long")
    second = rows.where(F.col(score).isNotNull()).withColumn("band_lang", lang).join(F.broadcast(middle), "band_lang")
    second = second.groupBy("band_lang", "middle", far.alias("x")).agg(F.count("*").alias("n"))
    return second.groupBy("band_lang", "middle").agg((1.4826 * F.percentile("x", F.lit(0.5), F.col("n")) / 256).alias("deviation"))


def width(deviation: str, size: str, spread: float) -> F.Column:
    return F.sqrt(F.col(deviation) ** 2 / F.nullif(F.col(size), F.lit(0)) + spread**2)


def judged(rows: DataFrame, size: str, score: str, lang: F.Column, lower: float = LOWER, upper: float = UPPER, spread: float = SPREAD) -> DataFrame:
    """rows with band_lang, middle, deviation and in_band."""
    # one row for each language
    out = rows.withColumn("band_lang", lang).join(F.broadcast(bands(rows, size, score, lang)), "band_lang", "left")
    wide = width("deviation", size, spread)
    off = F.col(score) - F.col("middle")
    return out.withColumn("in_band", F.coalesce((off >= -lower * wide) & (off <= upper * wide), F.lit(False)))


def perplexity_bands(docs: DataFrame, order: int = ORDER, lower: float = LOWER, upper: float = UPPER, spread: float = SPREAD, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, n_tokens, perplexity, lower, upper, keep) of every row; those
    kept have a perplexity from lower to upper.

    A null language is the language 'und', with a model of its own. A null text
    has no perplexity and isn't kept; an empty text is its END alone, and is
    judged like any other. Rows that repeat an id are judged one by one, equal texts
    of a language alike. Texts are used whole, however long; other columns are
    ignored, whatever their names. No rows give no rows.
    """
    base = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows, size, score = scored(base, order, keep=["doc_id", "lang"])
    rows = written(rows, "perplexities")
    out = judged(rows, size, score, ngrams.language(rows, "lang"), lower, upper, spread)
    wide = width("deviation", size, spread)
    return out.select("doc_id", "lang", F.col(size).alias("n_tokens"), F.exp(score).alias("perplexity"), F.exp(F.col("middle") - lower * wide).alias("lower"), F.exp(F.col("middle") + upper * wide).alias("upper"), F.col("in_band").alias("keep"))


def in_band(docs: DataFrame, order: int = ORDER, lower: float = LOWER, upper: float = UPPER, spread: float = SPREAD, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without the rows that perplexity_bands rejects, with their columns.

    Null and empty texts, null languages, repeated rows, long texts, clashing names
    and tables without rows are treated as there: a row with a null text goes, rows
    that repeat one another stay or go together."""
    rows, size, score = scored(docs, order, text, lang)
    rows = written(rows, "scored")
    plain = rows.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rows.columns)])
    at = {c: f"c{i}" for i, c in enumerate(rows.columns)}
    out = judged(plain, at[size], at[score], ngrams.language(plain, at[lang]), lower, upper, spread).where("in_band")
    return out.select(*[F.col(at[c]).alias(c) for c in docs.columns])
