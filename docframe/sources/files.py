"""Files as tables: sources, their texts and formats, and tables in markup."""

from __future__ import annotations

import csv
import io
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.functions import paths as P
from docframe.operators import toctree as C


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, mtime, size) of all files under a folder, paths relative to it; contents are bytes."""
    base = folder if "://" in folder or folder.startswith("file:") else "file:" + os.path.abspath(folder)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    plain = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    root = re.sub("^[a-z]+:/*", "/", base).rstrip("/") + "/"
    return rows.select(F.substring(plain, len(root) + 1, 1 << 30).alias("path"), "content", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def project(spark: SparkSession, folder: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """A project's sources: what include names (all by default), less what exclude and
    the built-in excludes name, of the known suffixes."""
    return C.discover(scan(spark, folder), include or ["**"], [*(exclude or []), *C.EXCLUDED], C.SUFFIXES)


def texts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docname, path, format, content, mtime) of files that are UTF-8, and diagnostics
    (severity, file, line, message) of those that aren't."""
    kind = F.element_at(F.split("path", r"\."), -1)
    format_ = F.when(kind == "rst", "rst").when(kind == "md", "markdown").otherwise("text")
    good = F.is_valid_utf8(F.col("content").cast("string"))
    rows = files.where(good).select(P.docname(F.col("path")).alias("docname"), "path", format_.alias("format"), F.col("content").cast("string").alias("content"), "mtime")
    bad = files.where(~F.coalesce(good, F.lit(False))).select(F.lit("error").alias("severity"), F.col("path").alias("file"), F.lit(None).cast("long").alias("line"), F.lit("isn't UTF-8").alias("message"))
    return rows, bad


def markdown_paragraphs(docs: DataFrame, key: str = "docname", text: str = "content") -> DataFrame:
    """(docname, ord, text): the runs of plain text of Markdown, each a paragraph;
    front matter, fenced code and marks are left out."""
    body = F.regexp_replace(F.col(text), r"(?s)\A---\n.*?\n---\n", "")
    body = F.regexp_replace(body, r"(?ms)^(```|~~~).*?^\1\s*$", "")
    body = F.regexp_replace(F.regexp_replace(body, r"!?\[([^\]]*)\]\([^)]*\)", "$1"), r"(?m)^\s{0,3}(#{1,6}\s+|>\s?|[-*+]\s+|\d+[.)]\s+)", "")
    body = F.regexp_replace(body, r"[*_`]{1,3}", "")
    rows = docs.select(F.col(key), F.posexplode(F.filter(F.transform(F.split(body, r"\n\s*\n|\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("ord", "text"))
    return rows.select(key, F.col("ord").cast("long").alias("ord"), "text")


def csv_cells(rows: DataFrame, key: str, text: str, delimiter: str = ",", quote: str = '"', escape: str | None = None, skip_space: bool = True) -> DataFrame:
    """(key, row, column, cell) of CSV texts, with quoted line ends; a text that breaks off within quotes gives what it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, r in enumerate(csv.reader(io.StringIO(t or ""), delimiter=delimiter, quotechar=quote, escapechar=escape, doublequote=escape is None, skipinitialspace=skip_space)):
                    for j, c in enumerate(r):
                        for x, y in zip(out, (k, i, j, c), strict=True):
                            x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.column(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], [key, "row", "column", "cell"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, row long, column long, cell string")


def page(content: Column) -> Column:
    """A source as a page: its escaped text in a body."""
    from docframe.functions.text import escape_text

    return F.concat(F.lit("<html><body>"), escape_text(content), F.lit("</body></html>"))


def write_pages(docs: DataFrame, path: str) -> None:
    """(path, html) of each document as Parquet."""
    docs.select(P.target_uri(F.col("docname")).alias("path"), page(F.col("content")).alias("html")).write.mode("overwrite").parquet(path)


def there(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
