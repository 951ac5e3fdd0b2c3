"""Domains, pages, dumps, and functions of single values."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.functions import html as H
from docframe.functions import text as X
from docframe.operators import cache as C
from docframe.operators import constraints as K
from docframe.operators import domains as M
from docframe.operators import ordered as O
from docframe.operators import references as R
from docframe.operators import rules as U
from docframe.operators import search as S
from docframe.operators import site
from docframe.operators import statistics as ST
from docframe.operators import toctree as T
from docframe.operators.indexing import checkpointed
from docframe.registry import query, table


@query("""WITH l AS (SELECT doc_id, lang, k AS line, CASE k WHEN 1 THEN 'é :ref:`l' || doc_id || '` and :doc:`T <d' || doc_id || '>`' WHEN 2 THEN NULL ELSE ':py:func:`os.f' || doc_id || '` :odd:`' || lang || '`' END AS s FROM documents, (VALUES (1), (2), (3)) t(k))
SELECT doc_id::VARCHAR AS docname, line::BIGINT AS line, col::BIGINT AS col, kind, target, display, kind = 'function' AS external FROM (
SELECT doc_id, line, 3 AS col, 'section' AS kind, 'l' || doc_id AS target, NULL AS display FROM l WHERE line = 1
UNION ALL SELECT doc_id, line, 16 + length('' || doc_id), 'document', 'd' || doc_id, 'T' FROM l WHERE line = 1
UNION ALL SELECT doc_id, line, 0, 'function', 'os.f' || doc_id, NULL FROM l WHERE line = 3
UNION ALL SELECT doc_id, line, 16 + length('' || doc_id), 'odd', lang, NULL FROM l WHERE line = 3)""")
def xref_scan(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    text = F.concat(F.lit("é :ref:`l"), n, F.lit("` and :doc:`T <d"), n, F.lit(">`\n\n:py:func:`os.f"), n, F.lit("` :odd:`"), "lang", F.lit("`"))
    d = table(spark, sf_dir, "documents").select(n.alias("docname"), text.alias("content"))
    return M.scanned(d).select("docname", "line", "col", "kind", "target", "display", "external")


_OBJECTS = """o AS (SELECT 'doc:' || lower(n_name) AS id, lower(n_name) AS name, 'document' AS type, 'rst' AS domain, lower(n_name) AS whole, n_name AS title FROM nation
UNION ALL SELECT 'ref:' || lower(r_name), lower(r_name), 'section', 'rst', lower(r_name) || '#' || lower(r_name), 'Part of ' || r_name FROM region
UNION ALL SELECT 'py:func:m' || s_nationkey || '.' || lower(s_name), lower(s_name), 'function', 'python', 'm' || s_nationkey || '.' || lower(s_name), NULL FROM supplier),
r AS (SELECT 'document' AS kind, lower(n_name) || '.rst' AS target FROM nation UNION SELECT 'document', lower(substr(n_name, 2, 3)) FROM nation UNION SELECT 'section', lower(r_name) FROM region UNION SELECT 'section', 'T OF ' || left(r_name, 2) FROM region
UNION SELECT 'numref', lower(n_name) FROM nation UNION SELECT 'function', lower(s_name) FROM supplier UNION SELECT 'class', 'm' || s_nationkey || '.' FROM supplier UNION SELECT 'wild', 'x')"""


def _objects(spark, sf_dir):
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    low, one = F.lower, F.lit(1)
    docs = M.documents(n.select(low("n_name").alias("docname"), F.col("n_name").alias("title"), one.alias("line"), F.col("n_nationkey").alias("ord")))
    labels = M.sections(r.select(low("r_name").alias("label"), F.concat(F.lit("Part of "), "r_name").alias("title"), low("r_name").alias("docname"), one.alias("line"), F.col("r_regionkey").alias("ord")))
    py = M.python(s.select(low("s_name").alias("name"), F.concat(F.lit("m"), "s_nationkey").alias("module"), F.lit("api").alias("docname"), one.alias("line"), F.col("s_suppkey").alias("ord")), "function")
    return checkpointed(M.registered(docs.unionByName(labels).unionByName(py))[0])


def _domains(spark, sf_dir):
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    low, objects = F.lower, _objects(spark, sf_dir)
    ask = lambda df, kind, target: df.select(F.lit(kind).alias("kind"), target.alias("target"))
    refs = ask(n, "document", F.concat(low("n_name"), F.lit(".rst"))).union(ask(n, "document", low(F.substring("n_name", 2, 3)))).union(ask(r, "section", low("r_name"))).union(ask(r, "section", F.concat(F.lit("T OF "), F.left("r_name", F.lit(2)))))
    refs = refs.union(ask(n, "numref", low("n_name"))).union(ask(s, "function", low("s_name"))).union(ask(s, "class", F.concat(F.lit("m"), "s_nationkey", F.lit(".")))).union(spark.createDataFrame([("wild", "x")], "kind string, target string"))
    got = checkpointed(M.resolved(refs.distinct().withColumn("external", R.is_external(F.col("kind"), F.col("target"))), objects))
    return objects, M.messages(got, M.suggested(got, objects))


@query(f"""WITH {_OBJECTS}, f AS (SELECT kind, target, CASE WHEN kind IN ('document', 'section', 'numref') THEN 'rst' WHEN kind IN ('function', 'class') THEN 'python' END AS domain,
CASE kind WHEN 'document' THEN (SELECT min(id) FROM o WHERE type = 'document' AND name = regexp_replace(target, '([.]rst)+$', '')) WHEN 'section' THEN (SELECT min(id) FROM o WHERE type = 'section' AND name = target)
WHEN 'numref' THEN coalesce((SELECT min(id) FROM o WHERE type = 'section' AND name = target), (SELECT min(id) FROM o WHERE type = 'document' AND name = target)) WHEN 'wild' THEN NULL ELSE (SELECT arg_min(id, whole) FROM o WHERE domain = 'python' AND (name = target OR whole = target)) END AS found FROM r),
s AS (SELECT kind, target, list_sort(list(DISTINCT give))[1:5] AS names FROM (
SELECT f.kind, f.target, o.name AS give FROM f JOIN o ON f.domain = 'rst' AND o.domain = 'rst' AND (f.kind = 'document') = (o.type = 'document') AND (contains(o.name, target) OR contains(target, o.name) OR contains(lower(o.title), lower(target))) WHERE found IS NULL
UNION ALL SELECT f.kind, f.target, o.whole FROM f JOIN o ON f.domain = 'python' AND o.domain = 'python' AND (contains(o.name, target) OR contains(target, o.name) OR contains(o.whole, target)) WHERE found IS NULL) GROUP BY 1, 2)
SELECT kind, target, found, CASE WHEN found IS NULL THEN CASE WHEN domain IS NULL THEN 'No domain found for reference type: ' || kind ELSE CASE WHEN domain = 'python' THEN 'Python object' WHEN kind = 'document' THEN 'Document' WHEN kind = 'section' THEN 'Section label' ELSE 'Reference target' END
|| ' ''' || target || ''' not found' || CASE WHEN names IS NULL THEN '' ELSE '. Did you mean: ' || array_to_string(names, ', ') || '?' END END END AS message FROM f LEFT JOIN s USING (kind, target)""")
def domain_messages(spark, sf_dir):
    return _domains(spark, sf_dir)[1].select("kind", "target", "found", "message")


@query("""SELECT n, whole FROM (SELECT lower(s_name) AS n, 'm' || s_nationkey || '.' || lower(s_name) AS whole FROM supplier UNION ALL SELECT lower(n_name), lower(n_name) FROM nation UNION ALL SELECT lower(r_name), lower(r_name) || '#' || lower(r_name) FROM region) WHERE contains(n, 'r0') OR contains(whole, 'a#')""")
def object_search(spark, sf_dir):
    o = _objects(spark, sf_dir)
    return M.containing(o, "r0").union(M.containing(o, "a#")).select(F.col("name").alias("n"), F.col("qualified_name").alias("whole"))


@query("""WITH d AS (SELECT p_partkey, ['note', 'admonition', 'code-block', 'literalinclude', 'highlight', 'figure', 'zzz'][p_partkey % 7 + 1] AS name, CASE WHEN p_size > 25 THEN p_brand || '.py' END AS a, CASE WHEN p_size % 2 = 0 THEN p_name END AS caption, p_type || ' <&>' AS c FROM part)
SELECT p_partkey, CASE name WHEN 'note' THEN '<div class="admonition note"><p class="admonition-title">' || coalesce(a, 'Note') || '</p>' || c || '</div>' WHEN 'admonition' THEN '<div class="admonition admonition-generic"><p class="admonition-title">' || coalesce(a, 'Admonition') || '</p>' || c || '</div>'
WHEN 'code-block' THEN coalesce('<div class="code-block-caption">' || caption || '</div>', '') || '<div class="highlight-' || coalesce(a, 'text') || '"><pre><code class="language-' || coalesce(a, 'text') || '">' || replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</code></pre></div>'
WHEN 'literalinclude' THEN '<div class="literal-include"><div class="highlight-python"><pre><code class="language-python"><!-- Content of ' || a || ' would be included here --></code></pre></div></div>' WHEN 'highlight' THEN '<!-- highlight language set to ' || coalesce(a, 'text') || ' -->'
WHEN 'figure' THEN '<!-- figure directive: ' || coalesce(a, '') || ' -->' ELSE '<!-- Unknown directive: zzz -->' END AS html FROM d""")
def directive_html(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    names = F.array(*map(F.lit, ["note", "admonition", "code-block", "literalinclude", "highlight", "figure", "zzz"]))
    argument = F.when(F.col("p_size") > 25, F.array(F.concat("p_brand", F.lit(".py")))).otherwise(F.array().cast("array<string>"))
    options = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("caption"), "p_name")).otherwise(F.create_map().cast("map<string,string>"))
    return p.select("p_partkey", H.directive(F.get(names, (F.col("p_partkey") % 7).cast("int")), argument, options, F.concat("p_type", F.lit(" <&>"))).alias("html"))


@query("""SELECT lang || '/' || doc_id || '.html' AS path, '<!DOCTYPE html>' || chr(10) || '<html lang="en">' || chr(10) || '<head><title>' || replace(replace(replace(regexp_replace(coalesce(source, ''), '<[^>]*>', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || ' &#8212; P</title></head>' || chr(10) || '<body>' || chr(10) || coalesce(text, '') || chr(10) || '<footer></footer>' || chr(10) || '</body>' || chr(10) || '</html>' || chr(10) AS html FROM documents""")
def page_render(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "doc_id").alias("docname"), F.col("source").alias("title"), F.col("text").alias("content"))
    return site.pages(d, {"project": "P"})


@query("""SELECT s, measure, number, kind, below, simple FROM (VALUES ('1.5 em', '1.5em', NULL, NULL, '1.5 em', false), ('-1_000', NULL, -1000, NULL, '-1_000', false), ('iv', NULL, NULL, 'lowerroman', 'iv', true), ('I', NULL, NULL, 'upperroman', 'I', true), ('c', NULL, NULL, 'loweralpha', 'c', true), ('12', '12', 12, 'arabic', '12', true),
('a::', NULL, NULL, NULL, 'a:', false), ('a ::', NULL, NULL, NULL, 'a', false), ('::', NULL, NULL, NULL, NULL, false), ('a.b-c', NULL, NULL, NULL, 'a.b-c', true), ('a..b', NULL, NULL, NULL, 'a..b', false), ('3 %', '3%', NULL, NULL, '3 %', false)) t(s, measure, number, kind, below, simple)""")
def value_functions(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in ("1.5 em", "-1_000", "iv", "I", "c", "12", "a::", "a ::", "::", "a.b-c", "a..b", "3 %")], "s string")
    s = F.col("s")
    return rows.select("s", X.measure(s).alias("measure"), X.whole_number(s).cast("int").alias("number"), X.enumerator_kind(s).alias("kind"), X.without_colons(s).alias("below"), X.simple_name(s).alias("simple"))


@query("""SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS shown, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events""")
def date_texts(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", X.date_text(at, "%Y/%m/%d %H:%M:%S").alias("shown"), X.date_text(at, "iso").alias("iso"))


@query("""SELECT t, external FROM (VALUES ('builtins.len', true), ('typing.List', true), ('collections.abc', true), ('pathlib.Path', true), ('os.path', true), ('sys.argv', true), ('json.load', true), ('re.match', true), ('datetime.date', true), ('urllib.parse', true), ('http.client', true), ('os', false), ('math.pi', false), ('itertools.chain', false), ('osx.y', false)) t(t, external)""")
def external_targets(spark, sf_dir):
    names = "builtins.len typing.List collections.abc pathlib.Path os.path sys.argv json.load re.match datetime.date urllib.parse http.client os math.pi itertools.chain osx.y"
    return spark.createDataFrame([(x,) for x in names.split()], "t string").select("t", R.is_external(F.lit("class"), F.col("t")).alias("external"))


@query("""WITH p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS p FROM pages), f AS (SELECT unnest([p || '.rst', '.venv/' || p || '.md', 'x/.git/' || p || '.txt', '_build/' || p || '.rst', 'x/_build/' || p || '.rst', p || '.py']) AS path FROM p)
SELECT path, NOT (starts_with(path, '.venv/') OR starts_with(path, '_build/')) AS found, NOT regexp_matches(path, '(^|/)([.][^/]*|_build)/') AS fallback FROM f WHERE NOT ends_with(path, '.py')""")
def default_excludes(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1).alias("p")).distinct()
    made = F.array(*[F.concat(F.lit(a), "p", F.lit(b)) for a, b in (("", ".rst"), (".venv/", ".md"), ("x/.git/", ".txt"), ("_build/", ".rst"), ("x/_build/", ".rst"), ("", ".py"))])
    files = p.select(F.explode(made).alias("path"))
    found, plain = T.discover(files, ["**"], T.EXCLUDED, T.SUFFIXES), T.fallback(files)
    both = files.where("path NOT LIKE '%.py'").join(found.withColumn("a", F.lit(True)), "path", "left").join(plain.withColumn("b", F.lit(True)), "path", "left")
    return both.select("path", F.coalesce("a", F.lit(False)).alias("found"), F.coalesce("b", F.lit(False)).alias("fallback"))


@query("""WITH d AS (SELECT row_number() OVER (ORDER BY conv_id) - 1 AS idx, 'c' || conv_id AS docname FROM (SELECT DISTINCT conv_id FROM conversations)), t AS (SELECT 'c' || conv_id AS docname, role AS term, count(*) AS tf FROM conversations WHERE role <> '' GROUP BY 1, 2)
SELECT term, count(*) AS documents, sum(tf)::BIGINT AS uses, max(idx) AS last FROM (SELECT CASE WHEN term LIKE '%ing' AND strlen(term) > 4 THEN left(term, length(term) - 3) WHEN term LIKE '%ed' AND strlen(term) > 3 THEN left(term, length(term) - 2) WHEN term LIKE '%s' AND strlen(term) > 2 THEN left(term, length(term) - 1) ELSE term END AS term, tf, idx FROM t JOIN d USING (docname)) GROUP BY term""")
def search_dump(spark, sf_dir):
    from docframe.operators.indexing import dense_index

    c = table(spark, sf_dir, "conversations")
    name = F.concat(F.lit("c"), "conv_id").alias("docname")
    docs = dense_index(c.select("conv_id", name).distinct(), ["conv_id"]).select("idx", "docname")
    posts = S.postings(c.groupBy("conv_id").agg(F.array_join(F.collect_list("role"), " ").alias("content")).select(name, "content"))
    dump = S.dumped(docs, posts, docs.select("docname", F.lit("t").alias("title"))).where("part = 'term'")
    x = dump.select(F.from_json("json", "term string, documents array<struct<idx:long,tf:long>>").alias("x"))
    return x.select("x.term", F.size("x.documents").cast("long").alias("documents"), F.aggregate("x.documents", F.lit(0).cast("long"), lambda a, d: a + d["tf"]).alias("uses"), F.array_max(F.transform("x.documents", lambda d: d["idx"])).alias("last"))


@query("""SELECT folder, sum(n)::BIGINT AS bytes FROM (SELECT n_chars AS n, unnest(['.', lang, lang || '/' || source]) AS folder FROM documents) GROUP BY folder""")
def folder_sizes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"))
    return site.sizes(d)


@query("""WITH r AS (SELECT event_type AS filename, event_id AS ord, user_id AS priority FROM events) SELECT filename, ord, priority FROM r QUALIFY row_number() OVER (PARTITION BY filename ORDER BY ord) = 1""")
def resource_list(spark, sf_dir):
    return O.first_resources(table(spark, sf_dir, "events").select(F.col("event_type").alias("filename"), F.col("event_id").alias("ord"), F.col("user_id").alias("priority")))


@query("""SELECT p_partkey::VARCHAR AS id, CASE WHEN p_size > 10 THEN 'Part ' || p_name || ' of ' || p_size || ' at d' || p_partkey || ':' || p_size || ' [' || p_brand || ']' ELSE 'Constraint ''small'' failed for item ''' || p_partkey || '''' END AS message FROM part""")
def constraint_messages(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    c = K.context(F.col("p_partkey").cast("string"), F.col("p_name"), F.lit(""), F.to_json(F.struct("p_size")), F.concat(F.lit("d"), "p_partkey"), F.col("p_size"), F.create_map(F.lit("made"), F.array("p_brand")))
    bad = p.select(F.col("p_partkey").cast("string").alias("id"), F.lit("size").alias("constraint"), F.when(F.col("p_size") > 10, "large").otherwise("small").alias("check_name"), c.alias("context"))
    rules = [{"constraint": "size", "check_name": "large", "template": "Part {{ title }} of {{ p_size }} at {{ docname }}:{{ lineno }} {{ rel_made }}"}, {"constraint": "size", "check_name": "small"}]
    return K.messages(bad, rules).select("id", "message")


_CHECKS = "x AS (SELECT CASE WHEN event_type IN ('view', 'click') THEN 'role' ELSE 'directive' END AS kind, ['valid', 'warning', 'error', 'unknown'][user_id % 4 + 1] AS outcome FROM events)"


def _checks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.when(F.col("event_type").isin("view", "click"), "role").otherwise("directive").alias("kind"), F.get(F.array(*map(F.lit, ["valid", "warning", "error", "unknown"])), (F.col("user_id") % 4).cast("int")).alias("outcome"))


@query(f"WITH {_CHECKS} SELECT coalesce(kind, 'all') AS scope, (count(*) FILTER (outcome = 'valid') * 1000 // count(*))::BIGINT AS success FROM x GROUP BY ROLLUP (kind)")
def rule_rates(spark, sf_dir):
    return U.rates(_checks(spark, sf_dir))


@query(f"""WITH {_CHECKS}, n AS (SELECT kind AS scope, count(*) AS total, count(*) FILTER (outcome = 'valid') AS v, count(*) FILTER (outcome = 'warning') AS w, count(*) FILTER (outcome = 'error') AS e, count(*) FILTER (outcome = 'unknown') AS u FROM x GROUP BY 1)
SELECT scope, 0 AS line_no, '  Total: ' || total AS text FROM n UNION ALL SELECT scope, 1, printf('  Valid: %d (%.1f%%)', v, v * 100.0 / total) FROM n UNION ALL SELECT scope, 2, printf('  Warnings: %d (%.1f%%)', w, w * 100.0 / total) FROM n
UNION ALL SELECT scope, 3, printf('  Errors: %d (%.1f%%)', e, e * 100.0 / total) FROM n UNION ALL SELECT scope, 4, printf('  Unknown: %d (%.1f%%)', u, u * 100.0 / total) FROM n""")
def rule_report(spark, sf_dir):
    return U.report(_checks(spark, sf_dir))


@query("""SELECT sum(octet_length(encode(text)) + octet_length(encode(source)) + octet_length(encode('' || doc_id)) + 1024)::BIGINT AS bytes, count(*) AS entries FROM documents WHERE text IS NOT NULL AND source IS NOT NULL""")
def cache_size(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL")
    return C.total(d.select(C.size_of(F.col("text"), F.col("source"), F.col("doc_id").cast("string")).alias("size_bytes")))


@query("""SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' THEN 0 WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END)::BIGINT AS n, 2::BIGINT AS roles FROM documents""")
def line_and_role_counts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", ST.line_count(t).alias("n"), U.role_count(F.concat(F.coalesce(t, F.lit("")), F.lit(" :doc:`a` :py:func:`b`"))).alias("roles"))
