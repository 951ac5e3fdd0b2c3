"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
before the next stage is called: a call deletes the tables that the stage before
left in the shared folder.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docframe.llm.common import discarded, forgotten, table, tables_now, written
from docframe.llm.langid import in_declared_language
from docframe.llm.minhash import without_near_duplicates
from docframe.llm.packing import pack
from docframe.llm.quality import in_band
from docframe.llm.suffixes import without_repeated_passages

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: set[str] = set()


def _freeing(stage: Stage) -> Stage:
    """stage, after what the last stage called has left behind is deleted."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forgotten(_left)
        _left.clear()
        before = tables_now()
        out = stage(spark, docs, sf_dir)
        _left.update(tables_now() - before)
        return out

    return run


@_freeing
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their language's band of perplexity. A null text goes; an empty
    one is judged like any other, a null language is a language; rows that repeat one
    another stay or go together. Texts are used whole; columns stay, whatever their
    names; no rows give no rows."""
    return in_band(docs)


@_freeing
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't surely in another language than they say. A null text goes;
    a text without letters and a null or unknown language stay; ties go to the first
    name; rows that repeat one another stay or go together. Texts are used whole;
    columns stay; no rows give no rows."""
    return in_declared_language(docs)


@_freeing
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, and by a
    hash among texts that share it. Rows that repeat an id and a text are one; null
    ids and null, empty and blank texts stay. Texts are used whole; columns stay; no
    rows give no rows."""
    return without_near_duplicates(docs)


@_freeing
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat an earlier one, by (id, position). A
    document of which no word is left goes; null ids and null and empty texts stay.
    Rows that repeat an id and a text are cut alike. Texts are used whole; columns
    stay; no rows give no rows."""
    return without_repeated_passages(docs)


@_freeing
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in sequences of fixed length. Null texts have
    no row, an empty one is its end mark; rows that repeat an id are packed one by one;
    among equal sizes the smaller id comes first. Texts are used whole; other columns
    are ignored; no rows give no rows."""
    return pack(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("passages", passages), ("packing", packing)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        discarded(before)
    return STAGES[-1][1](spark, docs, sf_dir)
