"""Document names and paths as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(p: Column) -> Column:
    return F.replace(p, F.lit("\\"), F.lit("/"))


def docname(path: Column) -> Column:
    """A path without its last extension; a name that begins with a dot keeps it."""
    return F.regexp_replace(normal_path(path), r"(?<=[^/])\.[^./]+$", "")


def resolve_docname(target: Column, referrer: Column) -> Column:
    """The document that target names from referrer: from the root with a leading
    '/', else from the referrer's folder; '.' and empty parts are dropped, '..'
    goes up, but not above the root."""
    folder = F.when(target.startswith("/") | ~referrer.contains("/"), F.lit("")).otherwise(F.regexp_replace(referrer, "[^/]*$", ""))
    parts = F.filter(F.split(F.concat(folder, target), "/"), lambda p: ~p.isin("", "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    return F.array_join(up, "/")


def components(path: Column) -> Column:
    """The key of the order of paths: by component, not by character."""
    return F.split(path, "/")


def folders(path: Column) -> Column:
    """The folders above a path, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def target_uri(name: Column) -> Column:
    return F.concat(name, F.lit(".html"))


def relative_uri(base: Column, to: Column) -> Column:
    """The way from the page of document base to that of document to."""
    a, b = F.split(base, "/"), F.split(target_uri(to), "/")
    same = F.zip_with(F.slice(a, 1, F.size(a) - 1), F.slice(b, 1, F.size(b) - 1), lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    n = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same).cast("long")).cast("int")
    up = F.array_repeat(F.lit(".."), F.size(a) - 1 - n)
    return F.array_join(F.concat(up, F.slice(b, n + 1, F.size(b))), "/")
