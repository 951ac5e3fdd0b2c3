"""Ordered state: relations, serials, conflicts, levels, chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.functions import text as X
from docframe.operators import ordered as O
from docframe.registry import query, table


@query("""SELECT conv_id, turn, lag(role) OVER w AS prev, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def doc_relations(spark, sf_dir):
    return O.relations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role").select("conv_id", "turn", "prev", "next")


@query("""SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS serial FROM conversations""")
def serials(spark, sf_dir):
    return O.serials(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "role"], ["turn"])


@query("""SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'system' OR length(text) > 200 THEN left(text, 10) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 'default') AS language FROM conversations""")
def carry_forward(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    value = F.when((F.col("role") == "system") | (F.length("text") > 200), F.left("text", F.lit(10)))
    return O.carried(c, "conv_id", "turn", value, "language").select("conv_id", "turn", "language")


@query("""SELECT conv_id, turn, ntile(3) OVER (PARTITION BY conv_id ORDER BY turn) AS "column" FROM conversations""")
def hlist_columns(spark, sf_dir):
    return O.columns_of(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", 3)


_NAMES = r"""n AS (SELECT source AS doc, lower(regexp_extract(text, '^\s*(\S+)', 1)) AS name, doc_id AS ord, lang = 'en' AND n_chars > 500 AS explicit FROM documents)"""


@query(f"""WITH {_NAMES} SELECT doc, name, ord, CASE WHEN count(*) OVER w = 1 OR (explicit AND count(*) FILTER (explicit) OVER w = 1) THEN 'kept' ELSE 'duplicate' END AS status FROM n WINDOW w AS (PARTITION BY doc, name)""")
def label_conflicts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n = d.select(F.col("source").alias("doc"), F.lower(F.regexp_extract("text", r"^\s*(\S+)", 1)).alias("name"), F.col("doc_id").alias("ord"), ((F.col("lang") == "en") & (F.col("n_chars") > 500)).alias("explicit"))
    return O.name_conflicts(n).select("doc", "name", "ord", "status")


@query("""WITH RECURSIVE t AS (SELECT conv_id AS doc, turn AS line, role || length(text) % 3 AS style, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
s AS (SELECT doc, line, style, n, 1::BIGINT AS level, [style] AS known, 1::BIGINT AS now FROM t WHERE n = 1
UNION ALL SELECT doc, line, style, n, level, CASE WHEN level > len(known) THEN list_append(known, style) ELSE known END, coalesce(level, now) FROM (
SELECT *, CASE WHEN want <= now + 1 THEN want END AS level FROM (SELECT t.doc, t.line, t.style, t.n, known, now, coalesce(nullif(list_position(known, t.style), 0), len(known) + 1)::BIGINT AS want FROM s JOIN t ON t.doc = s.doc AND t.n = s.n + 1)))
SELECT doc, line, style, level FROM s""")
def section_levels(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("line"), F.concat("role", (F.length("text") % 3).cast("string")).alias("style"))
    return O.section_levels(d).select("doc", "line", "style", "level")


@query("""SELECT 'p' || p_partkey AS doc, 3 AS line, rtrim(p_name) AS title, ['=', '-', '~'][p_size % 3 + 1] AS style FROM part WHERE length(rtrim(p_name)) <= p_size OR p_size >= 4""")
def title_detection(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_size > 0")
    mark = F.get(F.array(*map(F.lit, "=-~")), (F.col("p_size") % 3).cast("int"))
    text = F.concat(F.lit("intro\n\n"), "p_name", F.lit("\n"), F.repeat(mark, F.col("p_size")), F.lit("\nbody"))
    lines = p.select(F.concat(F.lit("p"), "p_partkey").alias("doc"), F.posexplode(F.split(text, "\n")).alias("k", "text")).select("doc", (F.col("k") + 1).alias("n"), "text")
    return O.titles(lines).select("doc", F.col("line").cast("int").alias("line"), "title", "style")


@query("""WITH i AS (SELECT o_custkey AS doc, o_orderkey AS ord, (o_orderkey % 7) AS value FROM orders), f AS (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY doc ORDER BY ord) + 1 THEN 0 ELSE 1 END AS new FROM i)
SELECT doc, ord, value, sum(new) OVER (PARTITION BY doc ORDER BY ord)::BIGINT AS list_no FROM f""")
def enumerator_check(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 7).alias("value"))
    return O.sequences(o)


@query("""WITH RECURSIVE p AS (SELECT n_name AS name, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'world' FROM region UNION ALL SELECT 'world', NULL),
c AS (SELECT name, parent AS up, name AS chain, 0::BIGINT AS depth FROM p UNION ALL SELECT c.name, p.parent, p.name || '/' || c.chain, c.depth + 1 FROM c JOIN p ON c.up = p.name)
SELECT name, depth, split_part(chain, '/', 1) AS root, chain FROM c WHERE up IS NULL""")
def parent_chain(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    p = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("parent"))
    p = p.union(r.select("r_name", F.lit("world"))).union(spark.createDataFrame([("world", None)], "name string, parent string"))
    return O.parent_chains(p)


@query("""SELECT doc_id, lower(trim(regexp_replace(source || '  ' || lang, '\\s+', ' ', 'g'))) AS name FROM documents""".replace("\\\\", "\\"))
def normal_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normal_name(F.concat("source", F.lit("  "), "lang")).alias("name"))
