"""Discovery of sources, tables of contents, and orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions import globs as G
from docframe.functions import paths as P

SUFFIXES = ["rst", "md", "txt"]
EXCLUDED = ["_build/**", "__pycache__/**", ".git/**", ".svn/**", ".hg/**", ".*/**", "Thumbs.db", ".DS_Store"]


def discover(files: DataFrame, include: list[str], exclude: list[str], suffixes: list[str] | None = None, path: str = "path") -> DataFrame:
    """Files that an include names and no exclude, neither themselves nor by a folder
    above; with a suffix of the list where one is given. Null paths go."""
    p = P.normal_path(F.col(path))
    keep = G.matches(p, include) & ~G.matches(p, exclude) & ~F.exists(P.folders(p), lambda x: G.matches(x, exclude))
    if suffixes is not None:
        keep &= F.element_at(F.split(p, r"\."), -1).isin(suffixes) & p.contains(".")
    return files.where(keep)


def resolved(entries: DataFrame) -> DataFrame:
    """entries (docname, target, glob) with `resolved`; external targets and 'self' go."""
    own = ~F.col("target").rlike("^https?://") & (F.col("target") != "self")
    return entries.where(own).withColumn("resolved", P.resolve_docname(F.col("target"), F.col("docname")))


def fallback(files: DataFrame, path: str = "path") -> DataFrame:
    """Sources by their suffix alone, outside hidden folders, _build and __pycache__."""
    parts = F.split(P.normal_path(F.col(path)), "/")
    hidden = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda x: x.startswith(".") | x.isin("_build", "__pycache__"))
    return files.where(F.element_at(F.split(path, r"\."), -1).isin(SUFFIXES) & F.col(path).contains(".") & ~hidden)


def missing(entries: DataFrame, docs: DataFrame) -> DataFrame:
    """(docname, target, resolved): entries that name no document."""
    plain = resolved(entries).where(~(F.col("glob") & G.is_glob(F.col("target"))))
    known = docs.select(F.col("docname").alias("resolved")).distinct()
    return plain.join(known, "resolved", "left_anti").select("docname", "target", "resolved")


def glob_hits(entries: DataFrame, docs: DataFrame) -> DataFrame:
    """(docname, target, hit): what each glob entry matches; hit is null where nothing.

    A pattern begins with a literal piece, up to its first mark: documents meet it by
    the folders of that piece, an equi-join, and only those that do are held against its
    regular expression. Patterns stay rows, however many there are."""
    wild = resolved(entries).where(F.col("glob") & G.is_glob(F.col("target")))
    patterns = wild.select("resolved").distinct().withColumn("rule", G.regex_of("resolved"))
    start = F.regexp_extract("resolved", r"^[^*?\[]*", 0)
    patterns = patterns.withColumn("folder", F.regexp_extract(start, "^(.*/)?", 0))
    names = docs.select(F.col("docname").alias("hit")).distinct()
    parts = F.split("hit", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))))
    met = names.select("hit", F.explode(folders).alias("folder")).join(patterns, "folder")
    hits = met.where(F.expr("hit RLIKE rule")).select("resolved", "hit")
    return wild.join(hits, "resolved", "left").select("docname", "target", "hit")


def orphans(entries: DataFrame, docs: DataFrame, root: str = "index") -> DataFrame:
    """(docname): documents in no table of contents; root is none."""
    plain = resolved(entries).where(~(F.col("glob") & G.is_glob(F.col("target")))).select(F.col("resolved").alias("docname"))
    by_glob = glob_hits(entries, docs).where(F.col("hit").isNotNull()).select(F.col("hit").alias("docname"))
    return docs.select("docname").distinct().join(plain.union(by_glob).distinct(), "docname", "left_anti").where(F.col("docname") != root)
