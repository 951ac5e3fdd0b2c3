"""Domains of references: what they know, how a reference is resolved, and what is said of one that isn't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.operators import references as R

#: The kinds of reference each domain resolves, the first domain that has a kind taking it.
SUPPORTED = {"rst": ["document", "section", "numref"], "python": ["function", "class", "module", "method", "attribute", "data", "exception"]}
RST_OBJECTS = ["document", "section", "figure", "table", "code-block"]
_SCAN = r":([a-zA-Z][a-zA-Z0-9_.-]*(?::[a-zA-Z][a-zA-Z0-9_.-]*)*):(`[^`]+`)"
_KINDS = {"doc": "document", "ref": "section", "func": "function", "meth": "method", "class": "class", "mod": "module", "attr": "attribute", "data": "data", "exc": "exception"}
#: (domain, type, shown name, roles) of the standard kinds of objects.
OBJECT_TYPES = [
    *(("py", t, t, [r, "obj"]) for t, r in (("module", "mod"), ("function", "func"), ("class", "class"), ("method", "meth"), ("attribute", "attr"), ("exception", "exc"), ("data", "data"))),
    *(("cpp", t, t, [r]) for t, r in (("class", "class"), ("function", "func"), ("type", "type"))),
    *(("js", t, t, [r]) for t, r in (("module", "mod"), ("class", "class"), ("function", "func"), ("method", "meth"), ("data", "data"))),
    *(("std", t, n, [r]) for t, n, r in (("doc", "document", "doc"), ("label", "label", "ref"), ("term", "term", "term"), ("cmdoption", "command line option", "option"), ("envvar", "environment variable", "envvar"))),
]


def object_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OBJECT_TYPES, "domain string, type string, shown string, roles array<string>")


def kind_of(role: Column, more: dict[str, str] | None = None) -> Column:
    """The kind of reference of a role by its last part; a role without one is a kind of
    its own. `more` adds roles."""
    last = F.element_at(F.split(role, ":"), -1)
    known = {**_KINDS, **(more or {})}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in known.items() for x in p]), last), last)


def scanned(docs: DataFrame, key: str = "docname", text: str = "content", roles: dict[str, str] | None = None) -> DataFrame:
    """(docname, line, col, role, kind, target, display, external): all references of each
    line, from 1; col is the byte of the line at which one begins, from 0."""
    lines = docs.select(F.col(key).alias("docname"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("n", "s"))
    all_ = F.regexp_extract_all("s", F.lit(_SCAN), 0)
    # where each begins: the bytes of all that stands before it
    found = lines.where(F.col("s").contains(":") & F.col("s").contains("`")).withColumn("hits", all_).where(F.size("hits") > 0)
    at = F.aggregate("hits", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, h: _next(a, h), lambda a: a["out"])
    each = found.select("docname", "n", F.explode(F.arrays_zip(F.col("hits").alias("hit"), at.alias("col"))).alias("x"))
    inner = F.regexp_extract("x.hit", _SCAN, 2)
    shape = r"^`([^<>]+?)(?:\s*<([^<>]+?)>)?`$"
    angle, lead = F.trim(F.regexp_extract(inner, shape, 2)), F.trim(F.regexp_extract(inner, shape, 1))
    whole = inner.rlike(shape)
    target = F.when(whole & (angle != ""), angle).when(whole, lead).otherwise(F.trim(inner))
    role = F.regexp_extract("x.hit", _SCAN, 1)
    out = each.select("docname", (F.col("n") + 1).cast("long").alias("line"), F.col("x.col").cast("long").alias("col"), role.alias("role"), kind_of(role, roles).alias("kind"), target.alias("target"), F.when(whole & (angle != ""), lead).alias("display"))
    return out.withColumn("external", R.is_external(F.col("kind"), F.col("target")))


def _next(a: Column, hit: Column) -> Column:
    rest = F.substr(F.col("s"), a["at"] + 1)
    here = a["at"] + F.call_function("instr", rest, hit) - 1
    return F.struct((here + F.length(hit)).cast("int").alias("at"), F.concat(a["out"], F.array(F.octet_length(F.substr(F.col("s"), F.lit(1), here)).cast("int"))).alias("out"))


# objects

OBJECT = ["id", "name", "object_type", "domain", "qualified_name", "title", "docname", "line"]


def _objects(df: DataFrame, id_: Column, name: Column, kind: Column, domain: str, qualified: Column, title: Column | None = None) -> DataFrame:
    return df.select(id_.alias("id"), name.alias("name"), kind.alias("object_type"), F.lit(domain).alias("domain"), qualified.alias("qualified_name"), (title if title is not None else F.lit(None).cast("string")).alias("title"), "docname", F.col("line").cast("long").alias("line"), F.col("ord").cast("long").alias("ord"))


def documents(df: DataFrame) -> DataFrame:
    """Objects of documents (docname, title, line, ord)."""
    return _objects(df, F.concat(F.lit("doc:"), "docname"), F.col("docname"), F.lit("document"), "rst", F.col("docname"), F.col("title"))


def sections(df: DataFrame) -> DataFrame:
    """Objects of labels (label, title, docname, line, ord)."""
    return _objects(df, F.concat(F.lit("ref:"), "label"), F.col("label"), F.lit("section"), "rst", F.concat("docname", F.lit("#"), "label"), F.col("title"))


def python(df: DataFrame, kind: str) -> DataFrame:
    """Objects of Python functions, classes or modules (name, module, docname, line, ord)."""
    short = {"function": "func", "class": "class", "module": "mod"}[kind]
    qualified = F.when(F.coalesce(F.col("module"), F.lit("")) == "", F.col("name")).otherwise(F.concat("module", F.lit("."), "name"))
    return _objects(df, F.concat(F.lit(f"py:{short}:"), qualified), F.col("name"), F.lit(kind), "python", qualified)


def registered(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, errors): of each domain and key the last by ord; markup's objects are keyed
    by name within documents and the rest, Python's by qualified name. Errors are of
    markup objects of an unknown type."""
    ok = (F.col("domain") != "rst") | F.col("object_type").isin(RST_OBJECTS)
    key = F.when(F.col("domain") == "rst", F.concat(F.when(F.col("object_type") == "document", F.lit("d:")).otherwise(F.lit("s:")), "name")).otherwise(F.col("qualified_name"))
    last = objects.where(ok).withColumn("_key", key).groupBy("domain", "_key").agg(F.max_by(F.struct(*OBJECT), F.col("ord")).alias("o"))
    errors = objects.where(~ok).select("id", F.concat(F.lit("Unknown RST object type: "), "object_type").alias("message"))
    return last.select("o.*"), errors


def containing(objects: DataFrame, pattern: str) -> DataFrame:
    """Objects whose name or qualified name holds a text."""
    return objects.where(F.col("name").contains(pattern) | F.col("qualified_name").contains(pattern))


def grouped(objects: DataFrame) -> DataFrame:
    """(domain, object_type, names): the names of each kind in order."""
    return objects.groupBy("domain", "object_type").agg(F.array_sort(F.collect_set("name")).alias("names"))


def looked_up(inventory: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (type, name) with what an inventory (type, name, uri, display) has of it, or nulls."""
    return wanted.join(inventory, ["type", "name"], "left")


# resolution


def dispatched(refs: DataFrame) -> DataFrame:
    """refs (kind) with the first domain that supports the kind, or null."""
    return Registry().dispatch(refs)


def resolved(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """refs (ref, kind, target, external) with domain and found, the object's id: documents
    without '.rst' at their end, then as they stand; sections by label; other markup
    kinds by label, then document; Python objects by qualified name, then the first by
    qualified name of those of that simple name."""
    refs = dispatched(refs)
    rst, py = objects.where("domain = 'rst'"), objects.where("domain = 'python'")
    docs = rst.where("object_type = 'document'").select(F.col("name").alias("_k"), F.col("id").alias("_id"))
    rest = rst.where("object_type <> 'document'").select(F.col("name").alias("_k"), F.col("id").alias("_id"))
    bare = F.regexp_replace("target", r"(\.rst)+$", "")
    out = refs
    for n, (side, key) in enumerate(((docs, bare), (docs, F.col("target")), (rest, F.col("target")))):
        out = out.withColumn(f"_at{n}", key).join(side.toDF(f"_k{n}", f"_id{n}"), F.col(f"_at{n}") == F.col(f"_k{n}"), "left").drop(f"_at{n}", f"_k{n}")
    out = R.resolve_objects(out, py.select("id", "name", "qualified_name")).withColumnRenamed("found", "_py")
    kind = F.col("kind")
    found = F.when(F.col("domain") == "python", F.col("_py")).when(kind == "document", F.coalesce("_id0", "_id1")).when(kind == "section", F.col("_id2")).when(F.col("domain") == "rst", F.coalesce("_id2", "_id1"))
    return out.withColumn("found", found).drop("_id0", "_id1", "_id2", "_py")


def suggested(refs: DataFrame, objects: DataFrame, most: int = 5) -> DataFrame:
    """(domain, kind, target, suggestions) of references that weren't resolved: names that
    hold the target or are held by it; markup's also by title, whatever the case,
    Python's also by qualified name, which is what is suggested."""
    broken = refs.where("found IS NULL AND domain IS NOT NULL").select("domain", "kind", "target").distinct()

    def near(of: str, mine: DataFrame, name: str, give: str, lower: bool = False, whole: bool = True) -> DataFrame:
        """(domain, kind, target, give) of references and the names that they meet; not `whole`: only names that hold the target."""
        low = F.lower if lower else F.col
        asked = broken.where(of).select("domain", "kind", F.col("target").alias("asked"), low("target").alias("target"))
        hits = R.containing(asked, mine.where(F.col(name).isNotNull()).select(low(name).alias("name"), F.col(give).alias("give")))
        hits = hits if whole else hits.where(F.col("name").contains(F.col("target")))
        return hits.select("domain", "kind", F.col("asked").alias("target"), "give")

    parts = []
    for is_document in (True, False):
        mine = objects.where("domain = 'rst'").where((F.col("object_type") == "document") == is_document)
        of = f"domain = 'rst' AND (kind = 'document') = {is_document}"
        parts += [near(of, mine, "name", "name"), near(of, mine, "title", "name", lower=True, whole=False)]
    mine = objects.where("domain = 'python'")
    parts += [near("domain = 'python'", mine, "name", "qualified_name"), near("domain = 'python'", mine, "qualified_name", "qualified_name", whole=False)]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy("domain", "kind", "target").agg(F.slice(F.array_sort(F.collect_set("give")), 1, most).alias("suggestions"))


def messages(refs: DataFrame, suggestions: DataFrame) -> DataFrame:
    """resolved references with valid, suggestions and message (null for valid ones)."""
    s = suggestions.select(*[F.col(c).alias(f"_{c}") for c in suggestions.columns])
    out = refs.join(s, (F.col("domain") == F.col("_domain")) & (F.col("kind") == F.col("_kind")) & (F.col("target") == F.col("_target")), "left").drop("_domain", "_kind", "_target")
    what = F.when(F.col("domain") == "python", F.lit("Python object")).when(F.col("kind") == "document", F.lit("Document")).when(F.col("kind") == "section", F.lit("Section label")).otherwise(F.lit("Reference target"))
    tail = F.when(F.size(F.coalesce("_suggestions", F.array())) > 0, F.concat(F.lit(". Did you mean: "), F.array_join("_suggestions", ", "), F.lit("?"))).otherwise(F.lit(""))
    text = F.when(F.col("domain").isNull(), F.concat(F.lit("No domain found for reference type: "), "kind")).otherwise(F.concat(what, F.lit(" '"), "target", F.lit("' not found"), tail))
    valid = F.col("found").isNotNull()
    return out.withColumn("valid", valid).withColumn("message", F.when(~valid, text)).withColumn("suggestions", F.coalesce("_suggestions", F.array().cast("array<string>"))).drop("_suggestions")


def broken(validated: DataFrame) -> DataFrame:
    """References that are neither valid nor external."""
    return validated.where(~F.col("valid") & ~F.col("external"))


def histogram(refs: DataFrame) -> DataFrame:
    return refs.groupBy("kind").agg(F.count("*").alias("n"))


class Registry:
    """Domains by name, each with the kinds that it supports; a name can be taken once."""

    def __init__(self, supported: dict[str, list[str]] | None = None):
        self.supported = dict(SUPPORTED if supported is None else supported)

    def add(self, name: str, kinds: list[str]) -> None:
        if name in self.supported:
            raise ValueError(f"domain {name} is registered already")
        self.supported[name] = kinds

    def names(self) -> list[str]:
        return list(self.supported)

    def dispatch(self, refs: DataFrame) -> DataFrame:
        """refs (kind) with the first domain that supports the kind, or null."""
        table = F.create_map(*[F.lit(x) for d, kinds in reversed(self.supported.items()) for k in kinds for x in (k, d)])
        return refs.withColumn("domain", F.element_at(table, F.col("kind")))
