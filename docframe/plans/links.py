"""Discovery, tables of contents, references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions import paths as P
from docframe.operators import references as R
from docframe.operators import toctree as C
from docframe.operators.indexing import dense_index
from docframe.registry import query, table

_PATH = "regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"
_NAME = f"regexp_replace({_PATH}, '(/|[.]html)$', '')"
_DOCS = f"docs AS (SELECT DISTINCT {_NAME} AS docname FROM pages)"
_RESOLVE = """array_to_string(list_reduce(list_transform(list_filter(string_split(CASE WHEN starts_with(target, '/') OR NOT contains(docname, '/') THEN '' ELSE regexp_replace(docname, '[^/]*$', '') END || target, '/'),
  lambda p: p NOT IN ('', '.')), lambda p: [p]), lambda a, b: CASE WHEN b[1] = '..' THEN a[1:len(a) - 1] ELSE list_concat(a, b) END, []::VARCHAR[]), '/')"""
_ENTRIES = f"""entries AS (
  SELECT {_NAME} AS docname, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target, false AS glob FROM pages
  UNION ALL SELECT docname, unnest(['/' || left(docname, length(docname) - 1), './' || docname || '/../x', '../' || regexp_extract(docname, '[^/]*$'), 'https://example.org/', 'self']), false FROM docs
  UNION ALL SELECT 'index', unnest(['en/1*', '/de/?2?', 'zz*', '**/99*']), true),
found AS (SELECT *, {_RESOLVE} AS resolved FROM entries WHERE NOT regexp_matches(target, '^https?://') AND target <> 'self')"""


def docs(spark, sf_dir) -> DataFrame:
    name = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1), "(/|[.]html)$", "")
    return table(spark, sf_dir, "pages").select(name.alias("docname"), "html")


def entries(spark, sf_dir) -> DataFrame:
    d = docs(spark, sf_dir)
    d_name = F.col("docname")
    links = d.select("docname", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target"), F.lit(False).alias("glob"))
    made = F.array(F.concat(F.lit("/"), F.left(d_name, F.length(d_name) - 1)), F.concat(F.lit("./"), d_name, F.lit("/../x")), F.concat(F.lit("../"), F.regexp_extract(d_name, "[^/]*$", 0)), F.lit("https://example.org/"), F.lit("self"))
    made = d.select("docname").distinct().select("docname", F.explode(made).alias("target"), F.lit(False).alias("glob"))
    wild = spark.createDataFrame([("index", p, True) for p in ("en/1*", "/de/?2?", "zz*", "**/99*")], "docname string, target string, glob boolean")
    return links.union(made).union(wild)


@query(f"""WITH p AS (SELECT DISTINCT {_PATH} AS path FROM pages)
SELECT row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS idx, path FROM p
WHERE regexp_matches(path, '^(.*[.]html|en/.*|de/.*)$') AND NOT regexp_matches(path, '^(en/1[^/]*|.*/2[^/][^/])(/.*)?$')""")
def glob_discovery(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1).alias("path")).distinct()
    found = C.discover(files, ["**.html", "en/**", "de/**"], ["en/1*", "**/2??"])
    return dense_index(found, [P.components(F.col("path"))]).select("idx", "path")


@query(f"WITH {_DOCS}, {_ENTRIES} SELECT docname, target, resolved FROM found WHERE found.glob = false")
def resolve_docname(spark, sf_dir):
    return C.resolved(entries(spark, sf_dir)).where("NOT glob").select("docname", "target", "resolved")


@query(f"WITH {_DOCS}, {_ENTRIES} SELECT docname, target, resolved FROM found WHERE found.glob = false AND resolved NOT IN (SELECT docname FROM docs)")
def toctree_missing(spark, sf_dir):
    return C.missing(entries(spark, sf_dir), docs(spark, sf_dir))


_GLOB = "globs AS (SELECT f.docname, f.target, d.docname AS hit FROM found f LEFT JOIN docs d ON regexp_matches(d.docname, CASE f.resolved WHEN 'en/1*' THEN '^en/1[^/]*$' WHEN 'de/?2?' THEN '^de/[^/]2[^/]$' WHEN 'zz*' THEN '^zz[^/]*$' ELSE '^.*/99[^/]*$' END) WHERE f.glob)"


@query(f"WITH {_DOCS}, {_ENTRIES}, {_GLOB} SELECT * FROM globs")
def toctree_glob(spark, sf_dir):
    return C.glob_hits(entries(spark, sf_dir), docs(spark, sf_dir))


@query(f"WITH {_DOCS}, {_ENTRIES}, {_GLOB} SELECT docname FROM docs WHERE docname <> 'index' AND docname NOT IN (SELECT resolved FROM found WHERE found.glob = false) AND docname NOT IN (SELECT hit FROM globs WHERE hit IS NOT NULL)")
def orphans(spark, sf_dir):
    return C.orphans(entries(spark, sf_dir), docs(spark, sf_dir))


@query("""WITH d AS (SELECT lang || '/' || doc_id AS docname, lang, doc_id FROM documents), r AS (SELECT docname, '../' || lang || '/' || (doc_id + 1) || '.rst.rst' AS target, lang || '/' || (doc_id + 1) AS resolved FROM d)
SELECT r.docname, target, d.docname AS found FROM r LEFT JOIN d ON r.resolved = d.docname""")
def xref_doc(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "doc_id").alias("docname"), "lang", "doc_id")
    refs = d.select("docname", F.format_string("../%s/%d.rst.rst", "lang", F.col("doc_id") + 1).alias("target"))
    return R.resolve_documents(refs, d).select("docname", "target", "found")


_NAMES = r"""n AS (SELECT doc_id, 'doc' || doc_id AS docname, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS a FROM documents),
all_ AS (SELECT lower(array_to_string(a[1:1], ' ')) AS name, docname, doc_id AS ord, 0 AS phase FROM n UNION ALL SELECT lower(array_to_string(a[1:2], ' ')), docname, doc_id, 1 FROM n),
t AS (SELECT name, arg_max(docname, (phase, ord, docname)) AS docname FROM all_ GROUP BY name)"""


def _names(spark, sf_dir):
    from docframe.functions.text import words

    w = words(F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc"), "doc_id").alias("docname"), w.alias("w"))
    one, two = F.array_join(F.slice("w", 1, 1), "  "), F.array_join(F.slice("w", 1, 2), " \n")
    names = R.targets(d.select(one.alias("name"), "docname", F.col("doc_id").alias("ord")), d.select(two.alias("name"), "docname", F.col("doc_id").alias("ord")))
    return d, names


@query(rf"""WITH {_NAMES}, r AS (SELECT docname, array_to_string(list_concat(a[2:2], a[1:1]), '  ') AS target FROM n UNION ALL SELECT docname, array_to_string(a[1:2], ' ') FROM n)
SELECT r.docname, r.target, t.docname AS found FROM r LEFT JOIN t ON t.name = lower(trim(regexp_replace(r.target, '\s+', ' ', 'g')))""")
def xref_ref(spark, sf_dir):
    d, names = _names(spark, sf_dir)
    back = d.select("docname", F.array_join(F.concat(F.slice("w", 2, 1), F.slice("w", 1, 1)), "  ").alias("target"))
    return R.resolve_labels(back.union(d.select("docname", F.array_join(F.slice("w", 1, 2), " "))), names).select("docname", "target", "found")


_OBJECTS = "o AS (SELECT 'py:func:' || p_partkey AS id, p_type AS name, p_brand || '.' || p_partkey || '.' || p_type AS qualified_name FROM part), r AS (SELECT DISTINCT p_type AS target FROM part UNION ALL SELECT p_brand || '.' || p_partkey || '.' || p_type FROM part UNION ALL SELECT 'os.' || s_name FROM supplier UNION ALL SELECT s_name FROM supplier)"


def _objects(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    q = F.concat_ws(".", "p_brand", "p_partkey", "p_type")
    objects = p.select(F.concat(F.lit("py:func:"), "p_partkey").alias("id"), F.col("p_type").alias("name"), q.alias("qualified_name"))
    s = table(spark, sf_dir, "supplier")
    refs = p.select(F.col("p_type").alias("target")).distinct().union(p.select(q)).union(s.select(F.concat(F.lit("os."), "s_name"))).union(s.select("s_name"))
    return objects, refs


@query(f"""WITH {_OBJECTS} SELECT target, coalesce((SELECT max(id) FROM o WHERE qualified_name = target), s.id) AS found FROM r LEFT JOIN (SELECT name, arg_min(id, qualified_name) AS id FROM o GROUP BY name) s ON s.name = target""")
def xref_python(spark, sf_dir):
    objects, refs = _objects(spark, sf_dir)
    return R.resolve_objects(refs, objects).select("target", "found")


@query("""WITH t AS (SELECT DISTINCT lower(substr(n_name, 2, 4)) AS target FROM nation UNION SELECT lower(n_name) || 'land' FROM nation UNION SELECT DISTINCT lower(left(s_name, 9)) FROM supplier),
n AS (SELECT lower(n_name) AS name FROM nation UNION SELECT lower(r_name) FROM region UNION SELECT lower(s_name) FROM supplier),
p AS (SELECT DISTINCT target, name FROM t, n WHERE contains(target, name) OR contains(name, target))
SELECT target, array_to_string(list_sort(list(name))[1:5], ',') AS suggestions FROM p GROUP BY target""")
def xref_suggestions(spark, sf_dir):
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    refs = n.select(F.lower(F.substring("n_name", 2, 4)).alias("target")).union(n.select(F.concat(F.lower("n_name"), F.lit("land")))).union(s.select(F.lower(F.left("s_name", F.lit(9)))))
    names = n.select(F.lower("n_name").alias("name")).union(r.select(F.lower("r_name"))).union(s.select(F.lower("s_name")))
    return R.suggestions(refs, names).withColumn("suggestions", F.array_join("suggestions", ","))


@query(f"""WITH {_OBJECTS}, k AS (SELECT target, CASE WHEN contains(target, '.') THEN 'function' ELSE 'class' END AS kind, starts_with(target, 'os.') AS external, target IN (SELECT name FROM o) OR target IN (SELECT qualified_name FROM o) AS ok FROM r)
SELECT kind, count(*) AS total, count(*) FILTER (NOT external AND ok) AS valid, count(*) FILTER (NOT external AND NOT ok) AS broken, count(*) FILTER (external) AS external FROM k GROUP BY kind""")
def xref_stats(spark, sf_dir):
    objects, refs = _objects(spark, sf_dir)
    found = R.resolve_objects(refs, objects).withColumn("kind", R.kind(F.when(F.col("target").contains("."), "py:func").otherwise("py:class")))
    return R.statistics(found.withColumn("external", R.is_external(F.col("kind"), F.col("target"))))


@query(f"""WITH {_DOCS} SELECT docname, '../' || docname || '.html' AS uri FROM docs WHERE docname <> ''""")
def relative_uris(spark, sf_dir):
    d = docs(spark, sf_dir).select("docname").distinct().where("docname <> ''")
    return d.select("docname", P.relative_uri(F.lit("zzz/page"), F.col("docname")).alias("uri"))
