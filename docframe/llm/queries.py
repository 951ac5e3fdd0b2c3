"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docframe.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each text, and the text that they decode to."""
    from docframe.llm.pieces import decode, encode

    return decode(encode(table(spark, sf_dir, "documents")))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents; null, blank and repeated rows as near_duplicates says."""
    from docframe.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents; null, short and repeated rows as repeated_passages says."""
    from docframe.llm.suffixes import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op4_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines and sentences of all documents; null, empty and repeated rows as repeated_units says."""
    from docframe.llm.units import repeated_units

    return repeated_units(table(spark, sf_dir, "documents"), whole=True)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages; null, empty and repeated rows as main_text says."""
    from docframe.llm.html import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and band of all documents; null, empty and repeated rows as perplexity_bands says."""
    from docframe.llm.quality import perplexity_bands

    return perplexity_bands(table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; null, empty and repeated rows as languages says."""
    from docframe.llm.langid import languages

    return languages(table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every row whose id is divisible by 50, among all rows."""
    from docframe.llm.topk import EVERY, nearest

    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(f"vec_id % {EVERY} = 0"))


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of all documents; null, empty and repeated rows as katz_scores says."""
    from docframe.llm.katz import katz_scores

    return katz_scores(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of all documents; null, empty and repeated rows as pack says."""
    from docframe.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {"op1_sentencepiece": op1_sentencepiece, "op2_minhash": op2_minhash, "op3_suffix_array": op3_suffix_array, "op4_units": op4_units, "op5_html": op5_html, "op6_quality": op6_quality, "op7_langid": op7_langid, "op8_topk": op8_topk, "op9_katz": op9_katz, "op10_packing": op10_packing}


def oracle_sql() -> dict[str, str]:
    from docframe.llm import topk

    return {"op8_topk": topk.SQL}
