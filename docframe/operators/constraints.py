"""Constraints over loosely typed items: expressions compiled once to columns over
VARIANT, severities, and the actions of failures.

The language: `or`, `and`, `not`, `==`, `!=`, `in [..]`, and a name alone for its
truth; no parentheses. Quotes protect what they hold. Operands are looked at from
left to right; what a decided side skips can't fail. An unknown name is an error,
not false.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.session import spread

_TOKEN = re.compile(r"""\s*("(?:[^"])*"|'(?:[^'])*'|==|!=|\[|\]|,|[^\s,\[\]=!]+|[=!])""")
_NUMBER = re.compile(r"^-?\d+$"), re.compile(r"^-?(\d+\.\d*|\.\d+|\d+([eE][-+]?\d+)|\d+\.\d*[eE][-+]?\d+)$")


def tokens(text: str) -> list[str]:
    out, i = [], 0
    text = text.strip()
    while i < len(text):
        m = _TOKEN.match(text, i)
        if not m:
            raise ValueError(f"can't read {text[i:]!r}")
        out.append(m.group(1))
        i = m.end()
    return out


def literal(token: str) -> tuple[str, object]:
    """(type, value) of a literal; a bare word is a string."""
    if token[:1] in "\"'" and token[:1]:
        return "string", token[1:-1] if len(token) > 1 and token[-1] == token[0] else token
    if token in ("true", "false"):
        return "boolean", token == "true"
    if _NUMBER[0].match(token):
        return "int", int(token)
    if _NUMBER[1].match(token):
        return "float", float(token)
    return "string", token


def split(parts: list[str], word: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for t in parts:
        if t == word:
            out.append([])
        else:
            out[-1].append(t)
    return out


def field(item: Column, name: str) -> Column:
    """What a name of an item is: its type t, and of its value what that type is looked at
    by: text s, number d, truth b, whole number i. Null for a name that isn't there."""
    v = F.try_variant_get(item, f"$['{name}']", "variant")
    return _field(v, _type(F.schema_of_variant(v)))


def _type(kind: Column) -> Column:
    return F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "BIGINT", "int").when(kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT"), "float").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("null")


def _field(v: Column, t: Column) -> Column:
    """field() of a value of a type. Each cast of a VARIANT costs some microseconds."""
    given = (("s", "string", ("string", "array", "object")), ("d", "double", ("int", "float")), ("b", "boolean", ("boolean",)), ("i", "decimal(38,0)", ("int",)))
    return F.when(v.isNotNull(), F.struct(t.alias("t"), *[F.when(t.isin(*types), F.try_variant_get(v, "$", k)).alias(n) for n, k, types in given]))


def equals(v: Column, other: tuple[str, object]) -> Column:
    """Of one type, or both numbers; any other pair is unequal, and so are lists and objects."""
    kind, value = other
    if kind == "int":
        whole = (v["t"] == "int") & (v["i"] == F.lit(value).cast("decimal(38,0)"))
        same = whole | (v["t"] == "float") & (F.abs(v["d"] - F.lit(float(value))) < 1e-9)
    elif kind == "float":
        same = v["t"].isin("int", "float") & (F.abs(v["d"] - F.lit(float(value))) < 1e-9)
    elif kind == "boolean":
        same = (v["t"] == "boolean") & (v["b"] == F.lit(value))
    else:
        same = (v["t"] == "string") & (v["s"] == F.lit(value))
    return F.coalesce(same, F.lit(False))


def truth(v: Column) -> Column:
    """Not empty, not zero, true."""
    t, text = v["t"], v["s"]
    return F.coalesce(F.when(t == "boolean", v["b"]).when(t.isin("int", "float"), v["d"] != 0).when(t == "string", text != "").when(t == "array", text != "[]").when(t == "object", text != "{}"), F.lit(False))


def result(value: Column, error: Column | None = None) -> Column:
    return F.struct(value.alias("value"), (error if error is not None else F.lit(None).cast("string")).alias("error"))


def _named(name: str, v: Column, then: Column) -> Column:
    return F.when(v.isNull(), result(F.lit(False), F.lit(f"unknown name {name}"))).otherwise(result(then))


def _term(parts: list[str], of: Callable[[str], Column]) -> Column:
    if parts and parts[0] == "not":
        inner = _term(parts[1:], of)
        return result(~inner["value"], inner["error"])
    if len(parts) == 3 and parts[1] in ("==", "!="):
        same = equals(of(parts[0]), literal(parts[2]))
        return _named(parts[0], of(parts[0]), same if parts[1] == "==" else ~same)
    if len(parts) >= 4 and parts[1] == "in" and parts[2] == "[" and parts[-1] == "]":
        some = F.lit(False)
        for x in split(parts[3:-1], ","):
            if x:
                some = some | equals(of(parts[0]), literal(" ".join(x) if len(x) > 1 else x[0]))
        return _named(parts[0], of(parts[0]), some)
    if len(parts) == 1:
        return _named(parts[0], of(parts[0]), truth(of(parts[0])))
    raise ValueError(f"can't read {' '.join(parts)!r}")


def names_of(expression: str) -> list[str]:
    """The names that an expression looks at."""
    out = []
    for side in split(tokens(expression), "or"):
        for term in split(side, "and"):
            while term[:1] == ["not"]:
                term = term[1:]
            out += term[:1]
    return out


def _chain(sides: Sequence[Column], stop: bool) -> Column:
    """Left to right: the first error, or the first side that decides."""
    out = sides[-1]
    for side in reversed(sides[:-1]):
        out = F.when(side["error"].isNotNull() | (side["value"] == F.lit(stop)), side).otherwise(out)
    return out


def compiled(expression: str, item: Column, of: Callable[[str], Column] | None = None) -> Column:
    """(value, error) of an expression for an item, a VARIANT object; `of` gives fields that
    were taken from it already."""
    of = of or (lambda name: field(item, name))
    sides = [_chain([_term(t, of) for t in split(side, "and")], False) for side in split(tokens(expression), "or")]
    return _chain(sides, True)


def item(id_: Column, title: Column, content: Column, metadata: Column) -> Column:
    """The names an expression sees: id, title, content, and over them those of metadata, a JSON object."""
    keys = F.coalesce(F.json_object_keys(metadata), F.array().cast("array<string>"))
    own = F.nullif(F.trim(F.regexp_extract(F.coalesce(metadata, F.lit("")), r"(?s)^\s*\{(.*)\}\s*$", 1)), F.lit(""))

    def part(name: str, value: Column) -> Column:
        one = F.to_json(F.struct(value.cast("string").alias(name)))
        return F.when(~F.array_contains(keys, name) & value.isNotNull(), F.regexp_replace(one, r"^\{|\}$", ""))

    return F.try_parse_json(F.concat(F.lit("{"), F.concat_ws(",", part("id", id_), part("title", title), part("content", content), own), F.lit("}")))


def evaluate(items: DataFrame, rules: list[dict], item_column: str = "item", constraints: str = "constraints") -> DataFrame:
    """(id, constraint, check_name, severity, ok, error): each check of each constraint
    of each item; constraints without a rule are left out. The rules are one array of
    expressions, so items are read once whatever their number, and each name is taken from
    an item once, whatever number of rules look at it. Steps are columns of their own: what
    is named twice within one is worked out twice."""
    names = sorted({n for r in rules for n in names_of(r["expression"])})
    at = {n: f"_field{k}" for k, n in enumerate(names)}
    items = spread(items).select("id", F.col(constraints).alias("_constraints"), *[F.try_variant_get(item_column, f"$['{n}']", "variant").alias(c) for n, c in at.items()])
    items = items.select("id", "_constraints", *at.values(), *[F.schema_of_variant(c).alias(f"{c}_kind") for c in at.values()])
    items = items.select("id", "_constraints", *at.values(), *[_type(F.col(f"{c}_kind")).alias(f"{c}_type") for c in at.values()])
    items = items.select("id", "_constraints", *[_field(F.col(c), F.col(f"{c}_type")).alias(c) for c in at.values()])
    constraints = "_constraints"
    results = [F.when(F.array_contains(constraints, r["constraint"]), compiled(r["expression"], None, lambda n: F.col(at[n]))).alias(f"_result{k}") for k, r in enumerate(rules)]
    checks = F.array(*[F.struct(F.lit(r["constraint"]).alias("constraint"), F.lit(r["check_name"]).alias("check_name"), F.lit(r.get("severity", "warning")).alias("severity"), F.col(f"_result{k}").alias("r")) for k, r in enumerate(rules)])
    flat = items.select("id", *results).select("id", F.explode(checks).alias("c")).where("c.r IS NOT NULL")
    return flat.select("id", "c.constraint", "c.check_name", "c.severity", F.col("c.r.value").alias("ok"), F.col("c.r.error").alias("error"))


#: What a failure of each severity does: stop the item, and the style it gives, which replaces others where forced.
SEVERITIES = {"info": (False, None, False), "warning": (False, "constraint-warning", False), "error": (False, "constraint-error", False), "critical": (True, "constraint-critical", True)}


def actions(checks: DataFrame) -> DataFrame:
    """(id, failures, style, stopped): of each item with a failure, how many there are,
    the styles in order of constraint and check (a forced one replaces those before,
    others follow with ', '), and whether one stops it. A check in error has failed."""
    table = F.create_map(*[x for k, (stop, style, force) in SEVERITIES.items() for x in (F.lit(k), F.struct(F.lit(stop).alias("stop"), F.lit(style).cast("string").alias("style"), F.lit(force).alias("force")))])
    bad = checks.where(~F.col("ok") | F.col("error").isNotNull())
    lists = bad.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("constraint", "check_name", "severity"))).alias("f"))

    def fold(style: Column, f: Column) -> Column:
        a = F.coalesce(F.element_at(table, f["severity"]), F.element_at(table, F.lit("info")))
        return F.when(a["style"].isNull(), style).when(a["force"] | (style == ""), a["style"]).otherwise(F.concat(style, F.lit(", "), a["style"]))

    stopped = F.exists("f", lambda f: F.coalesce(F.element_at(table, f["severity"])["stop"], F.lit(False)))
    return lists.select("id", F.size("f").cast("long").alias("failures"), F.aggregate("f", F.lit(""), fold).alias("style"), stopped.alias("stopped"))


def context(id_: Column, title: Column, content: Column, metadata: Column, docname: Column, line: Column, relationships: Column | None = None) -> Column:
    """What a message's template sees, as JSON: the names of item(), rel_… for each
    kind of relationship (a map to arrays), docname, and lineno where there is one."""
    base = F.to_json(item(id_, title, content, metadata))
    more = F.to_json(F.struct(docname.alias("docname"), line.cast("long").alias("lineno")))
    parts = [F.regexp_replace(base, r"\}$", ""), F.regexp_replace(F.regexp_replace(more, r"^\{", ""), r"\}$", "")]
    if relationships is not None:
        named = F.to_json(F.transform_keys(relationships, lambda k, v: F.concat(F.lit("rel_"), k)))
        parts.insert(1, F.nullif(F.regexp_replace(F.regexp_replace(named, r"^\{", ""), r"\}$", ""), F.lit("")))
    return F.concat(F.concat_ws(",", *parts), F.lit("}"))


def messages(failures: DataFrame, rules: list[dict]) -> DataFrame:
    """failures (id, constraint, check_name, context) with the message of each: the rule's
    template filled in, or one that names the check and the item."""
    from docframe.functions.templates import rendered

    given = [x for r in rules if r.get("template") for x in (F.lit(f"{r['constraint']}\0{r['check_name']}"), F.lit(r["template"]))]
    plain = F.concat(F.lit("Constraint '"), "check_name", F.lit("' failed for item '"), "id", F.lit("'"))
    if not given:
        return failures.withColumn("message", plain)
    template = F.element_at(F.create_map(*given), F.concat_ws("\0", "constraint", "check_name"))
    return failures.withColumn("message", F.coalesce(rendered(template, F.col("context")), plain))


@dataclass
class Settings:
    """Of an engine: without `enabled` nothing is checked; with `most` no more failures of an item are listed."""

    enabled: bool = True
    most: int | None = None

    def apply(self, checks: DataFrame) -> DataFrame:
        if not self.enabled:
            return checks.limit(0)
        if self.most is None:
            return checks
        bad = ~F.col("ok") | F.col("error").isNotNull()
        n = F.sum(bad.cast("int")).over(Window.partitionBy("id").orderBy("constraint", "check_name"))
        return checks.withColumn("_n", n).where(~bad | (F.col("_n") <= self.most)).drop("_n")


def failed(checks: DataFrame) -> DataFrame:
    """Checks that didn't hold or couldn't be made."""
    return checks.where(~F.col("ok") | F.col("error").isNotNull())


def halted(checks: DataFrame) -> DataFrame:
    """(id, message): items that a failure stops, and the first such failure in order."""
    stops = [k for k, (stop, _, _) in SEVERITIES.items() if stop]
    return failed(checks).where(F.col("severity").isin(stops)).groupBy("id").agg(F.min(F.struct("constraint", "check_name")).alias("f")).select("id", F.concat(F.lit("Constraint '"), "f.check_name", F.lit("' failed for item '"), "id", F.lit("'")).alias("message"))
