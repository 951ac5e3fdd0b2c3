"""Statistics of a project, and the report of all diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions import text as X
from docframe.session import spread

MARKS = [":doc:`", ":ref:`", ":func:`", ":class:`", ":meth:`", ":attr:`", ":mod:`", ":py:", ".. _", "`~"]
ORPHAN = "document isn't included in any toctree"


def MISSING(name: Column) -> Column:  # noqa: N802
    return F.concat(F.lit("toctree contains reference to nonexisting document '"), name, F.lit("'"))


def NO_MATCH(pattern: Column) -> Column:  # noqa: N802
    return F.concat(F.lit("toctree glob pattern '"), pattern, F.lit("' didn't match any documents"))


def BROKEN(target: Column) -> Column:  # noqa: N802
    return F.concat(F.lit("cross-reference target not found: '"), target, F.lit("'"))


def line_count(s: Column) -> Column:
    """Lines, of which the last may lack its end."""
    n = F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    return F.when(s == "", 0).otherwise(n + F.when(s.endswith("\n"), 0).otherwise(1)).cast("long")


def project(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """One row: files, lines, mean and largest size in bytes and in KB of 1024, deepest
    folder (hidden ones and what is in them don't count), and cross-references by the
    marks they begin with, one that has two marks twice. A null text is a file without lines."""
    t = F.col(text)
    marks = reduce(lambda a, b: a + b, [X.occurrences(t, m) for m in MARKS])
    folders = F.split(path, "/")
    hidden = F.exists(F.slice(folders, 1, F.size(folders) - 1), lambda x: x.startswith("."))
    files, depth = spread(files).where(~hidden), F.size(folders) - 1
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum(line_count(t)), F.lit(0)).alias("n_lines"), F.floor(F.avg(F.octet_length(t))).cast("long").alias("mean_bytes"), F.max(F.octet_length(t)).cast("long").alias("max_bytes"), (F.coalesce(F.avg(F.coalesce(F.octet_length(t), F.lit(0))), F.lit(0.0)) / 1024).alias("mean_kb"), (F.coalesce(F.max(F.octet_length(t)), F.lit(0)) / 1024).alias("max_kb"), F.max(depth).cast("long").alias("max_depth"), F.coalesce(F.sum(marks), F.lit(0)).alias("cross_refs"))


def report(*phases: tuple[DataFrame, str]) -> DataFrame:
    """(phase, severity, file, line, message, text) of diagnostics (severity, file, line,
    message) with their phases' names, in the order given; errors in a phase of their own, last."""
    parts = []
    for k, (df, name) in enumerate(phases):
        p = F.when(F.col("severity") == "error", F.lit(len(phases))).otherwise(F.lit(k))
        parts.append(df.select(p.cast("long").alias("phase"), F.lit(name).alias("source"), "severity", "file", F.col("line").cast("long").alias("line"), "message"))
    place = F.concat("file", F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")))
    return reduce(DataFrame.unionByName, parts).withColumn("text", F.format_string("%s: %s: %s", place, F.upper("severity"), F.col("message")))


def write_report(diagnostics: DataFrame, path: str) -> None:
    """The report as text lines, in order."""
    diagnostics.orderBy("phase", "file", "line", "message").select("text").write.mode("overwrite").text(path)


def exit_code(diagnostics: DataFrame | None, strict: bool = False) -> int:
    """1 with an error, or with a warning where strict; 2 where the build itself couldn't run (None); else 0."""
    if diagnostics is None:
        return 2
    r = diagnostics.agg(F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warning")).first()
    return int(bool(r[0] or (strict and r[1])))
