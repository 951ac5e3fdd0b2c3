"""Ordered state as windows: relations, serials, names, levels, eviction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.operators.indexing import checkpointed


def relations(rows: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """rows with the names before and after each in its group."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("prev", F.lag(name).over(w)).withColumn("next", F.lead(name).over(w))


def serials(rows: DataFrame, group: list, order: list, name: str = "serial") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))


def carried(rows: DataFrame, group: str, order: str, value: Column, name: str, default: str = "default") -> DataFrame:
    """rows with the last value set at or before each, or the default."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default)))


def columns_of(rows: DataFrame, group: str, order: str, number: int, name: str = "column") -> DataFrame:
    """rows divided among `number` columns; the first ones get one more where it doesn't come out even."""
    return rows.withColumn(name, F.ntile(number).over(Window.partitionBy(group).orderBy(order)).cast("long"))


def name_conflicts(names: DataFrame) -> DataFrame:
    """names (doc, name, ord, explicit), maybe with refuri, with `status`: 'kept' or
    'duplicate'. A lone name stays; of several explicit ones none does, unless all are
    targets of one URI, of which the first stays; an explicit one takes the name from
    implicit ones; of implicit ones alone none stays."""
    all_ = Window.partitionBy("doc", "name")
    explicit = F.count_if("explicit").over(all_)
    keep = (F.count("*").over(all_) == 1) | ((explicit == 1) & F.col("explicit"))
    if "refuri" in names.columns:
        uri = F.when(F.col("explicit"), F.col("refuri"))
        one = (F.min(uri).over(all_) == F.max(uri).over(all_)) & (F.count(uri).over(all_) == explicit)
        first = F.min(F.when(F.col("explicit"), F.col("ord"))).over(all_) == F.col("ord")
        keep |= (explicit > 1) & one & F.col("explicit") & first
    return names.withColumn("status", F.when(keep, "kept").otherwise("duplicate"))


def leveled(styles: list) -> list[int | None]:
    """The level of each title from their styles in order: an unknown style opens the level
    below the deepest there is, but only right beneath the open one; else it is an error (null)."""
    known: list = []
    out: list[int | None] = []
    now = 0
    for s in styles:
        level = known.index(s) + 1 if s in known else len(known) + 1
        if level > now + 1:
            out.append(None)
            continue
        if s not in known:
            known.append(s)
        now = level
        out.append(level)
    return out


def section_levels(titles: DataFrame) -> DataFrame:
    """titles (doc, line, style) with `level`: a style's rank by its first appearance; null
    for a title that skips a level, which is an error and opens no section."""
    schema = T.StructType([*titles.schema.fields, T.StructField("level", T.LongType())])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("line")
        return t.append_column("level", pa.array(leveled(t.column("style").to_pylist()), pa.int64()))

    return titles.groupBy("doc").applyInArrow(run, schema)


def ids_of(names: DataFrame) -> DataFrame:
    """names (doc, ord, name) with `id`: the first free of the name's identifier, or 'id' and
    a number; free is what no earlier row of the document has."""
    schema = T.StructType([*names.schema.fields, T.StructField("id", T.StringType())])

    def run(t: pa.Table) -> pa.Table:
        from docframe.functions.nodes import Node, Registry

        t = t.sort_by("ord")
        registry = Registry("")
        return t.append_column("id", pa.array([registry.identify(Node("x", names=[n] if n else [])) for n in t.column("name").to_pylist()], pa.string()))

    return names.groupBy("doc").applyInArrow(run, schema)


def first_resources(rows: DataFrame) -> DataFrame:
    """rows (filename, ord, priority) without later ones of a filename, in the order they were added."""
    first = rows.groupBy("filename").agg(F.min("ord").alias("first"))
    return rows.join(first, "filename").where("ord = first").drop("first")


def titles(lines: DataFrame) -> DataFrame:
    """(doc, line, title, style) of lines (doc, n, text): a line whose next is an
    adornment of one character as wide as it, or at least 4; style is that character,
    twice where the same adornment is over the title too."""
    w = Window.partitionBy("doc").orderBy("n")
    under = F.lead("text").over(w)
    rows = lines.withColumn("under", under).withColumn("over", F.lag("text").over(w))
    hit = F.col("under").rlike(r"^([!-/:-@\[-`{-~])\1*$") & ~F.col("text").rlike(r"^([!-/:-@\[-`{-~])\1*$") & F.col("text").rlike(r"^\S") & ((F.length("under") >= F.length(F.rtrim("text"))) | (F.length("under") >= 4))
    return rows.where(hit).select("doc", F.col("n").alias("line"), F.trim("text").alias("title"), F.repeat(F.substring("under", 1, 1), F.when(F.rtrim("over") == F.rtrim("under"), 2).otherwise(1)).alias("style"))


def sequences(items: DataFrame) -> DataFrame:
    """items (doc, ord, value) with `list_no`: a new list begins where a value isn't the one after the last."""
    w = Window.partitionBy("doc").orderBy("ord")
    new = F.when(F.lag("value").over(w).isNull() | (F.col("value") != F.lag("value").over(w) + 1), 1).otherwise(0)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("_new", new).withColumn("list_no", F.sum("_new").over(run).cast("long")).drop("_new")


def parent_chains(parents: DataFrame) -> DataFrame:
    """(name, depth, root, chain) of parents (name, parent): the way from the root,
    joined by '/', however deep. A chain that meets itself ends there.

    Chains grow to twice their length each round: what is above a chain's top is the
    top's own chain. A round is written before the next, so none is computed twice."""
    names = parents.select("name").distinct()
    known = parents.join(names.select(F.col("name").alias("parent")), "parent", "left_semi")
    rows = parents.join(known.select("name", F.col("parent").alias("up")), "name", "left").select("name", "up", F.array("name").alias("chain"))
    rows = checkpointed(rows)
    while rows.where("up IS NOT NULL").limit(1).count():
        above = rows.select(F.col("name").alias("up"), F.col("chain").alias("more"), F.col("up").alias("next"))
        grown = rows.join(above, "up", "left")
        own = F.array_distinct(F.concat(F.reverse("chain"), F.reverse("more")))  # from the name upwards
        met = F.size(own) < F.size("chain") + F.size("more")
        # a chain that meets itself keeps what stands before the first name that comes again
        chain = F.when(F.col("more").isNull(), F.col("chain")).otherwise(F.reverse(own))
        rows = checkpointed(grown.select("name", F.when(F.col("more").isNotNull() & ~met, F.col("next")).alias("up"), chain.alias("chain")))
    return rows.select("name", (F.size("chain") - 1).cast("long").alias("depth"), F.element_at("chain", 1).alias("root"), F.array_join("chain", "/").alias("chain"))
