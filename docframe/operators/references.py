"""Cross-references: targets, resolution, suggestions, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions import paths as P
from docframe.functions import text as X

ROLES = {"doc": "document", "ref": "reference", "numref": "reference", "func": "function", "meth": "method", "class": "class", "mod": "module", "attr": "attribute", "data": "data", "exc": "exception"}
#: Modules whose names with a dot after them begin an external target.
STANDARD = ["builtins", "typing", "collections", "pathlib", "os", "sys", "json", "re", "datetime", "urllib", "http"]


def kind(role: Column, custom: bool = False) -> Column:
    """The kind of reference of a role, by its last part; null (or the role itself
    where custom kinds count) for others."""
    last = F.element_at(F.split(role, ":"), -1)
    out = F.element_at(F.create_map(*[F.lit(x) for p in ROLES.items() for x in p]), last)
    return F.coalesce(out, last) if custom else out


def is_external(kind_: Column, target: Column) -> Column:
    web = target.rlike("^(https?|file)://")
    python = F.exists(F.array(*map(F.lit, STANDARD)), lambda m: target.startswith(F.concat(m, F.lit("."))))
    return ((kind_ == "document") & web) | (kind_.isin("function", "class", "module") & python)


def targets(labels: DataFrame, sections: DataFrame) -> DataFrame:
    """(name, docname): labels and section anchors by normalised name; sections after
    labels, and later ones after earlier, take the name over."""
    both = labels.select("name", "docname", "ord", F.lit(0).alias("phase")).union(sections.select("name", "docname", "ord", F.lit(1).alias("phase")))
    both = both.withColumn("name", X.normal_name(F.col("name")))
    return both.groupBy("name").agg(F.max_by("docname", F.struct("phase", "ord", "docname")).alias("docname"))


def resolve_documents(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """refs (docname, target) with `found`: the document, or null. All '.rst' at the end of a target go."""
    at = P.resolve_docname(F.regexp_replace(F.col("target"), r"(\.rst)+$", ""), F.col("docname"))
    known = docs.select(F.col("docname").alias("found")).distinct()
    return refs.withColumn("resolved", at).join(known, F.col("resolved") == F.col("found"), "left")


def resolve_labels(refs: DataFrame, names: DataFrame) -> DataFrame:
    """refs (docname, target) with `found`: the document that has the label, or null."""
    return refs.withColumn("name", X.normal_name(F.col("target"))).join(names.withColumnRenamed("docname", "found"), "name", "left").drop("name")


def resolve_objects(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """refs (target) with `found`: the object of that qualified name, else the first
    by qualified name of those with that simple name, else null."""
    exact = objects.groupBy("qualified_name").agg(F.max("id").alias("exact"))
    simple = objects.groupBy("name").agg(F.min_by("id", "qualified_name").alias("simple"))
    out = refs.join(exact, refs.target == exact.qualified_name, "left").drop("qualified_name")
    out = out.join(simple, out.target == simple.name, "left").drop("name")
    return out.withColumn("found", F.coalesce("exact", "simple")).drop("exact", "simple")


def containing(refs: DataFrame, names: DataFrame, grams: int = 3) -> DataFrame:
    """The pairs of rows of refs (target, …) and names (name, …) of which one's text
    contains the other's; a pair may come twice.

    Of two strings one of which contains the other, the shorter one's first `grams`
    characters stand in the longer one: that key joins them without a product of
    rows; shorter strings are keyed by all their runs of their own length."""

    def starts(c: str) -> Column:
        return F.substring(c, 1, grams)

    def runs(c: str) -> Column:
        every = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(grams)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substring(F.col(c), i, n))))
        return F.explode(F.array_distinct(every))

    inside = refs.withColumn("_k", runs("target")).join(names.withColumn("_k", starts("name")), "_k").where(F.col("target").contains(F.col("name")))
    around = refs.withColumn("_k", starts("target")).join(names.withColumn("_k", runs("name")), "_k").where(F.col("name").contains(F.col("target")))
    return inside.unionByName(around).drop("_k")


def suggestions(refs: DataFrame, names: DataFrame, most: int = 5, grams: int = 3) -> DataFrame:
    """(target, suggestions): for each target the first `most` names that it contains
    or that contain it, in order."""
    hits = containing(refs.select("target").distinct(), names.select("name").distinct(), grams)
    return hits.groupBy("target").agg(F.slice(F.array_sort(F.collect_set("name")), 1, most).alias("suggestions"))


def statistics(refs: DataFrame) -> DataFrame:
    """(kind, total, valid, broken, external) of refs (kind, found, external)."""
    e = F.col("external")
    return refs.groupBy("kind").agg(F.count("*").alias("total"), F.count_if(~e & F.col("found").isNotNull()).alias("valid"), F.count_if(~e & F.col("found").isNull()).alias("broken"), F.count_if(e).alias("external"))
