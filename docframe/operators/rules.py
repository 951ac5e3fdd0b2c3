"""Rules for directives and roles. Each rule is one expression over one record, so
a check of any number of records is one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions import text as X
from docframe.session import spread

VALID, WARNING, ERROR, UNKNOWN = "valid", "warning", "error", "unknown"
IMAGES = ["png", "jpg", "jpeg", "gif", "svg", "webp", "bmp"]
ALIGN = ["left", "center", "right", "top", "middle", "bottom"]
DOWNLOADS = ["pdf", "zip", "tar", "gz", "bz2", "xz", "7z", "txt", "md", "rst", "html", "csv", "json", "xml", "yaml", "yml", "py", "c", "cpp", "h", "js", "css", "png", "jpg", "svg"]
FLAGS = ["glob", "hidden", "includehidden", "titlesonly", "reversed", "numbered"]


class Rule:
    """Conditions in order: the first that holds gives the outcome and the message."""

    def __init__(self) -> None:
        self.cases: list[tuple[Column, str, str]] = []

    def error(self, when: Column, message: str) -> Rule:
        self.cases.append((when, ERROR, message))
        return self

    def warn(self, when: Column, message: str) -> Rule:
        self.cases.append((when, WARNING, message))
        return self

    def column(self) -> Column:
        out = None
        for when, outcome, message in self.cases:
            v = F.struct(F.lit(outcome).alias("outcome"), F.lit(message).alias("message"))
            when = F.coalesce(when, F.lit(False))
            out = F.when(when, v) if out is None else out.when(when, v)
        valid = F.struct(F.lit(VALID).alias("outcome"), F.lit(None).cast("string").alias("message"))
        return valid if out is None else out.otherwise(valid)


def empty() -> Column:
    return F.trim(F.coalesce(F.col("content"), F.lit(""))) == ""


def argument() -> Column:
    return F.get("arguments", 0)


def option_names() -> Column:
    return F.map_keys("options")


def option(name: str) -> Column:
    return F.element_at("options", name)


def valued(name: str) -> Column:
    return F.coalesce(option(name), F.lit("")) != ""


def whole(s: Column) -> Column:
    return s.rlike(r"^\+?[0-9]+$") & s.try_cast("bigint").between(0, 4294967295)


def other_than(*names: str) -> Column:
    return F.exists(option_names(), lambda k: ~k.isin(*names))


def bad_number(name: str) -> Column:
    return option(name).isNotNull() & ~F.coalesce(whole(option(name)), F.lit(False))


def bad_length(name: str) -> Column:
    number = F.trim(F.regexp_replace(F.trim(option(name)), "(px|em|ex|in|cm|mm|pt|pc|%)$", ""))
    float_ = r"(?i)^[-+]?(inf|infinity|nan|(\d+\.?\d*|\.\d+)(e[-+]?\d+)?)$"
    return option(name).isNotNull() & ~number.rlike(float_)


def suffix(s: Column) -> Column:
    return F.lower(F.element_at(F.split(s, r"\."), -1))


def code_block() -> Rule:
    r = Rule().warn(empty(), "no content").error(valued("linenos"), "linenos takes no value").error(bad_number("lineno-start"), "lineno-start is no number")
    return r.warn(other_than("linenos", "lineno-start", "emphasize-lines", "caption", "name", "dedent"), "unknown option")


def note() -> Rule:
    return Rule().error(empty(), "no content").warn(other_than("class", "name"), "unknown option")


def image() -> Rule:
    r = Rule().error(argument().isNull(), "no path").error(F.trim(argument()) == "", "empty path").warn(~suffix(argument()).isin(IMAGES), "unknown image format")
    r.warn(bad_length("width"), "bad width").warn(bad_length("height"), "bad height").error(option("scale").isNotNull() & F.rtrim(option("scale")).try_cast("float").isNull(), "scale is no number")
    return r.error(option("align").isNotNull() & ~option("align").isin(ALIGN), "bad align").warn(other_than("width", "height", "scale", "align", "alt", "target", "class", "name"), "unknown option")


def toctree() -> Rule:
    r = Rule().warn(empty(), "no entries").error(bad_number("maxdepth"), "maxdepth is no number").warn(option("maxdepth").try_cast("bigint") > 10, "maxdepth over 10")
    any_flag = F.lit(False)
    for f in FLAGS:
        any_flag = any_flag | valued(f)
    return r.warn(any_flag, "flag takes no value").warn(other_than("maxdepth", "caption", "name", "class", *FLAGS), "unknown option")


def include() -> Rule:
    return Rule().error(argument().isNull(), "no path").error(F.trim(argument()) == "", "empty path").warn(~suffix(argument()).isin("rst", "txt", "md", "inc"), "unusual suffix")


def literal_include() -> Rule:
    r = Rule().error(argument().isNull(), "no path").error(F.trim(argument()) == "", "empty path")
    for n in ("lineno-start", "tab-width", "start-line", "end-line", "dedent"):
        r.error(bad_number(n), f"{n} is no number")
    known = ["language", "encoding", "pyobject", "caption", "name", "class", "diff", "start-after", "end-before", "start-at", "end-at", "prepend", "append"]
    r.warn(valued("linenos") | valued("force"), "flag takes no value")
    return r.warn(other_than("lineno-start", "tab-width", "start-line", "end-line", "dedent", "linenos", "force", *known), "unknown option")


def admonition() -> Rule:
    return Rule().error(argument().isNull(), "no title").warn(empty(), "no content")


def math() -> Rule:
    return Rule().error(empty(), "no content").warn(~X.braces_balance(F.col("content")), "braces don't balance")


DIRECTIVES: dict[str, Callable[[], Rule]] = {"code-block": code_block, "note": note, "warning": note, "image": image, "figure": image, "toctree": toctree, "include": include, "literalinclude": literal_include, "admonition": admonition, "math": math}

def target() -> Column:
    return F.col("target")


def role() -> Rule:
    return Rule().error(F.trim(F.coalesce(target(), F.lit(""))) == "", "empty target")


ROLES: dict[str, Callable[[], Rule]] = {
    "doc": lambda: role().warn(target().endswith(".rst") | target().endswith(".md"), "has a suffix"),
    "ref": role,
    "download": lambda: role().warn(~suffix(target()).isin(DOWNLOADS), "unusual suffix").warn(target().rlike("^https?://"), "is a URL"),
    "math": lambda: role().warn(~X.braces_balance(target()), "braces don't balance"),
    "abbr": lambda: role().warn(~target().rlike(r"\p{Lu}"), "no capital"),
    "command": lambda: role().warn(target().rlike(r"[&|;`$()<>]"), "shell character"),
    "file": lambda: role().error(target().rlike(r'[<>:"|?*]'), "bad character"),
    "kbd": role,
    "menuselection": role,
    "guilabel": lambda: role().warn(target().contains("&") & ~target().contains("&amp;"), "bare ampersand"),
}


def checked(records: DataFrame, rules: dict[str, Callable[[], Rule]], name: str = "name") -> DataFrame:
    """records with outcome and message; names without a rule are 'unknown'."""
    out = None
    for k, rule in rules.items():
        out = F.when(F.col(name) == k, rule().column()) if out is None else out.when(F.col(name) == k, rule().column())
    unknown = F.struct(F.lit(UNKNOWN).alias("outcome"), F.lit(None).cast("string").alias("message"))
    both = spread(records).withColumn("_check", unknown if out is None else out.otherwise(unknown))
    return both.withColumn("outcome", F.col("_check.outcome")).withColumn("message", F.col("_check.message")).drop("_check")


def statistics(checks: DataFrame, name: str = "name") -> DataFrame:
    """(name, outcome, n) for each name and outcome, each name, each outcome and all: null where not told apart."""
    return checks.groupingSets([[F.col(name), F.col("outcome")], [F.col(name)], [F.col("outcome")], []], F.col(name), F.col("outcome")).agg(F.count("*").alias("n"))


def success(checks: DataFrame) -> DataFrame:
    """(success): valid of all, in thousandths; 1000 for none."""
    return checks.agg(F.coalesce(F.floor(F.try_divide(F.count_if(F.col("outcome") == VALID) * 1000, F.count("*"))).cast("long"), F.lit(1000).cast("long")).alias("success"))


def similar(names: list[str], asked: Column, most: int = 5) -> Column:
    """Known names that contain the one asked for, or are contained in it."""
    known = F.array(*map(F.lit, sorted(names)))
    return F.slice(F.filter(known, lambda n: F.contains(n, asked) | F.contains(asked, n)), 1, most)


def rates(checks: DataFrame, kind: str = "kind") -> DataFrame:
    """(scope, success): valid of all in thousandths, of each kind and of all; 1000 for none."""
    good = F.coalesce(F.floor(F.try_divide(F.count_if(F.col("outcome") == VALID) * 1000, F.count("*"))).cast("long"), F.lit(1000).cast("long"))
    return checks.groupBy(F.col(kind).alias("scope")).agg(good.alias("success")).union(checks.agg(F.lit("all").alias("scope"), good.alias("success")).select("scope", "success"))


def report(checks: DataFrame, kind: str = "kind") -> DataFrame:
    """(scope, line_no, text): for each kind its total, and of each outcome the number and share."""
    order = [VALID, "warning", "error", UNKNOWN]
    n = checks.groupBy(F.col(kind).alias("scope")).agg(F.count("*").alias("total"), *[F.count_if(F.col("outcome") == o).alias(o) for o in order])
    line = lambda name, c: F.format_string(f"  {name}: %d (%.1f%%)", c, c * 100.0 / F.col("total"))
    lines = F.array(F.format_string("  Total: %d", "total"), *[line(t, F.col(o)) for t, o in zip(("Valid", "Warnings", "Errors", "Unknown"), order, strict=True)])
    return n.select("scope", F.posexplode(lines).alias("line_no", "text"))


def is_directive(line: Column) -> Column:
    return line.rlike(r"^\s*\.\. [A-Za-z][\w:.-]*::")


def role_count(s: Column) -> Column:
    """How many roles stand in a text."""
    return F.regexp_count(s, F.lit(r":[A-Za-z][\w:.-]*:`[^`]+`")).cast("long")


def similar_to(asked: DataFrame, names: list[str], most: int = 5) -> DataFrame:
    """asked (name) with the known names (directives, roles or options) that hold it or are held by it."""
    return asked.withColumn("similar", similar(names, F.col("name"), most))


class Registry:
    """Rules by name, to which others can be added; a name can be taken once."""

    def __init__(self, rules: dict[str, Callable[[], Rule]] | None = None):
        self.rules = dict(rules or {})

    def add(self, name: str, rule: Callable[[], Rule]) -> None:
        if name in self.rules:
            raise ValueError(f"{name} is registered already")
        self.rules[name] = rule

    def __contains__(self, name: str) -> bool:
        return name in self.rules

    def __len__(self) -> int:
        return len(self.rules)

    def names(self) -> list[str]:
        return sorted(self.rules)


def similar_option(options: Column, known: list[str]) -> Column:
    """For each option that isn't known, the first known one that holds it or is held by it: (option, similar)."""
    names = F.array(*map(F.lit, known))
    unknown = F.filter(F.map_keys(options), lambda o: ~o.isin(known))
    hits = F.transform(unknown, lambda o: F.struct(o.alias("option"), F.get(F.filter(names, lambda n: F.contains(n, o) | F.contains(o, n)), F.lit(0)).alias("similar")))
    return F.filter(hits, lambda x: x["similar"].isNotNull())
