"""Rules and constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.operators import constraints as K
from docframe.operators import rules as R
from docframe.registry import query, table
from docframe.session import spread

_NAMES = ["code-block", "note", "image", "figure", "toctree", "include", "literalinclude", "admonition", "math", "custom", "warning"]
_OPTIONS = [("linenos", ""), ("linenos", "yes"), ("lineno-start", "7"), ("lineno-start", "x"), ("class", "a"), ("width", "50%"), ("width", "wide"), ("scale", "1.5"), ("align", "middle"), ("align", "under"), ("maxdepth", "12"), ("maxdepth", "2"), ("glob", ""), ("hidden", "on"), ("language", "c"), ("odd", "1"), ("force", "x"), ("dedent", "q"), ("name", "n")]
_PATHS = ["a.png", "b.rst", "c.xyz", " ", None]
_CONTENTS = ["text", "", "{x", "{y}"]


def _array(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


_DIRECTIVES = f"""d AS (SELECT p_partkey AS id, {_array(_NAMES)}[p_partkey % {len(_NAMES)} + 1] AS name, {_array([k for k, _ in _OPTIONS])}[p_size % {len(_OPTIONS)} + 1] AS k, {_array([v for _, v in _OPTIONS])}[p_size % {len(_OPTIONS)} + 1] AS v,
{_array(_PATHS)}[p_partkey // 11 % 5 + 1] AS arg, {_array(_CONTENTS)}[p_partkey // 7 % 4 + 1] AS body FROM part),
c AS (SELECT *, trim(body) = '' AS empty, length(replace(body, '{{', '')) <> length(replace(body, '}}', '')) AS odd, regexp_matches(v, '^[0-9]+$') AS whole, v <> '' AS valued, split_part(arg, '.', 2) AS suffix FROM d),
r AS (SELECT id, name, CASE
WHEN name = 'code-block' THEN CASE WHEN empty THEN 'warning' WHEN k = 'linenos' AND valued THEN 'error' WHEN k = 'lineno-start' AND NOT whole THEN 'error' WHEN k NOT IN ('linenos', 'lineno-start', 'emphasize-lines', 'caption', 'name', 'dedent') THEN 'warning' ELSE 'valid' END
WHEN name IN ('note', 'warning') THEN CASE WHEN empty THEN 'error' WHEN k NOT IN ('class', 'name') THEN 'warning' ELSE 'valid' END
WHEN name IN ('image', 'figure') THEN CASE WHEN arg IS NULL OR trim(arg) = '' THEN 'error' WHEN suffix <> 'png' THEN 'warning' WHEN k = 'width' AND v = 'wide' THEN 'warning' WHEN k = 'align' AND v = 'under' THEN 'error' WHEN k NOT IN ('width', 'scale', 'align', 'class', 'name') THEN 'warning' ELSE 'valid' END
WHEN name = 'toctree' THEN CASE WHEN empty THEN 'warning' WHEN k = 'maxdepth' AND v = '12' THEN 'warning' WHEN k = 'hidden' THEN 'warning' WHEN k NOT IN ('maxdepth', 'class', 'name', 'glob', 'hidden') THEN 'warning' ELSE 'valid' END
WHEN name = 'include' THEN CASE WHEN arg IS NULL OR trim(arg) = '' THEN 'error' WHEN suffix <> 'rst' THEN 'warning' ELSE 'valid' END
WHEN name = 'literalinclude' THEN CASE WHEN arg IS NULL OR trim(arg) = '' THEN 'error' WHEN k IN ('lineno-start', 'dedent') AND NOT whole THEN 'error' WHEN k IN ('linenos', 'force') AND valued THEN 'warning' WHEN k NOT IN ('lineno-start', 'dedent', 'linenos', 'force', 'language', 'name', 'class') THEN 'warning' ELSE 'valid' END
WHEN name = 'admonition' THEN CASE WHEN arg IS NULL THEN 'error' WHEN empty THEN 'warning' ELSE 'valid' END
WHEN name = 'math' THEN CASE WHEN empty THEN 'error' WHEN odd THEN 'warning' ELSE 'valid' END
ELSE 'unknown' END AS outcome FROM c)"""


def _pick(values: list, at):
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def directives(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    arg = _pick(_PATHS, F.expr("p_partkey div 11 % 5"))
    args = F.when(arg.isNull(), F.array().cast("array<string>")).otherwise(F.array(arg))
    opts = F.create_map(_pick([k for k, _ in _OPTIONS], size % len(_OPTIONS)), _pick([v for _, v in _OPTIONS], size % len(_OPTIONS)))
    return table(spark, sf_dir, "part").select(key.alias("id"), _pick(_NAMES, key % len(_NAMES)).alias("name"), args.alias("arguments"), opts.alias("options"), _pick(_CONTENTS, F.expr("p_partkey div 7 % 4")).alias("content"))


@query(f"WITH {_DIRECTIVES} SELECT id, name, outcome FROM r")
def rules_directives(spark, sf_dir):
    return R.checked(directives(spark, sf_dir), R.DIRECTIVES).select("id", "name", "outcome")


@query(f"WITH {_DIRECTIVES} SELECT name, outcome, count(*) AS n FROM r GROUP BY GROUPING SETS ((name, outcome), (name), (outcome), ())")
def rule_stats(spark, sf_dir):
    return R.statistics(R.checked(directives(spark, sf_dir), R.DIRECTIVES))


@query(f"WITH {_DIRECTIVES} SELECT count(*) FILTER (outcome = 'valid') * 1000 // count(*) AS success FROM r")
def rule_success(spark, sf_dir):
    return R.success(R.checked(directives(spark, sf_dir), R.DIRECTIVES))


_ROLES = ["doc", "ref", "download", "math", "abbr", "command", "file", "kbd", "menuselection", "guilabel", "other"]
_TARGETS = ["guide.rst", "", "x.zip", "https://a.b/c.pdf", "{a", "CPU", "ls | wc", "a?b", "&File", "&amp;File", "File > Open", "plain"]


@query(f"""WITH t AS (SELECT o_orderkey AS id, {_array(_ROLES)}[o_orderkey % 11 + 1] AS name, {_array(_TARGETS)}[o_custkey % 12 + 1] AS target FROM orders)
SELECT id, name, target, CASE WHEN name = 'other' THEN 'unknown' WHEN target = '' THEN 'error'
WHEN name = 'doc' AND target = 'guide.rst' THEN 'warning'
WHEN name = 'download' AND (target NOT IN ('guide.rst', 'x.zip', 'https://a.b/c.pdf') OR starts_with(target, 'http')) THEN 'warning'
WHEN name = 'math' AND target = '{{a' THEN 'warning'
WHEN name = 'abbr' AND NOT regexp_matches(target, '[A-Z]') THEN 'warning'
WHEN name = 'command' AND regexp_matches(target, '[&|;`$()<>]') THEN 'warning'
WHEN name = 'file' AND regexp_matches(target, '[<>:"|?*]') THEN 'error'
WHEN name = 'guilabel' AND target = '&File' THEN 'warning' ELSE 'valid' END AS outcome FROM t""".replace("{{", "{"))
def rules_roles(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _pick(_ROLES, F.col("o_orderkey") % 11).alias("name"), _pick(_TARGETS, F.col("o_custkey") % 12).alias("target"))
    return R.checked(o, R.ROLES).select("id", "name", "target", "outcome")


@query("""SELECT asked, array_to_string(list_filter(['admonition', 'code-block', 'figure', 'image', 'include', 'literalinclude', 'math', 'note', 'toctree', 'warning'], lambda n: contains(n, asked) OR contains(asked, n))[1:5], ',') AS names FROM (VALUES ('include'), ('notes'), ('i'), ('zzz')) t(asked)""")
def rule_suggestions(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in ("include", "notes", "i", "zzz")], "asked string")
    return rows.select("asked", F.array_join(R.similar(list(R.DIRECTIVES), F.col("asked")), ",").alias("names"))


RULES = [
    {"constraint": "typed", "check_name": "a_known", "severity": "warning", "expression": "title in ['view', 'click'] or title == purchase"},
    {"constraint": "typed", "check_name": "b_k", "severity": "error", "expression": "k != 5 and not title == 'error'"},
    {"constraint": "large", "check_name": "c_content", "severity": "critical", "expression": "content == 'high' or k == 7.0"},
    {"constraint": "large", "check_name": "d_missing", "severity": "info", "expression": "title == 'view' or nothing == 1"},
    {"constraint": "large", "check_name": "e_quoted", "severity": "warning", "expression": "title != 'a or b' and k"},
]
_CHECKS = """e AS (SELECT event_id::VARCHAR AS id, event_type AS title, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS content, json_extract(props, '$.k')::BIGINT AS k FROM events),
checks AS (SELECT id, 'typed' AS "constraint", 'a_known' AS check_name, 'warning' AS severity, title IN ('view', 'click', 'purchase') AS ok, NULL AS error FROM e
UNION ALL SELECT id, 'typed', 'b_k', 'error', CASE WHEN k IS NULL THEN false ELSE k <> 5 AND title <> 'error' END, CASE WHEN k IS NULL THEN 'unknown name k' END FROM e
UNION ALL SELECT id, 'large', 'c_content', 'critical', content = 'high' OR coalesce(k = 7, false), CASE WHEN content <> 'high' AND k IS NULL THEN 'unknown name k' END FROM e WHERE content = 'high' OR title = 'signup'
UNION ALL SELECT id, 'large', 'd_missing', 'info', title = 'view', CASE WHEN title <> 'view' THEN 'unknown name nothing' END FROM e WHERE content = 'high' OR title = 'signup'
UNION ALL SELECT id, 'large', 'e_quoted', 'warning', coalesce(k <> 0, false), CASE WHEN k IS NULL THEN 'unknown name k' END FROM e WHERE content = 'high' OR title = 'signup')"""


def _items(spark, sf_dir):
    content = F.when(F.col("value") > 50, "high").otherwise("low")
    e = spread(table(spark, sf_dir, "events"))  # an item is made where there are cores
    names = F.when((content == "high") | (F.col("event_type") == "signup"), F.array(F.lit("typed"), F.lit("large"), F.lit("unheard"))).otherwise(F.array(F.lit("typed")))
    return e.select(F.col("event_id").cast("string").alias("id"), K.item(F.col("event_id"), F.col("event_type"), content, F.col("props")).alias("item"), names.alias("constraints"))


@query(f"WITH {_CHECKS} SELECT * FROM checks")
def constraints_eval(spark, sf_dir):
    return K.evaluate(_items(spark, sf_dir), RULES)


@query(f"""WITH {_CHECKS}, bad AS (SELECT * FROM checks WHERE NOT ok OR error IS NOT NULL),
f AS (SELECT id, count(*) AS failures, list(severity ORDER BY "constraint", check_name) AS s, bool_or(severity = 'critical') AS stopped FROM bad GROUP BY id)
SELECT id, failures, list_reduce(s, lambda a, b: CASE WHEN b = 'info' THEN a WHEN b = 'critical' OR a = '' THEN 'constraint-' || b ELSE a || ', constraint-' || b END, '') AS style, stopped FROM f""")
def constraints_actions(spark, sf_dir):
    return K.actions(K.evaluate(_items(spark, sf_dir), RULES))
