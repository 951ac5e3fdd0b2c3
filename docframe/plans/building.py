"""Incremental builds, inventories, the general index."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from docframe.operators import cache as C
from docframe.operators import inventory as V
from docframe.registry import query, table

NOW = datetime.datetime(2024, 1, 31)
TTL = 86_400
_CACHE = f"""f AS (SELECT 'u' || user_id AS path, md5(max(event_id)::VARCHAR) AS hash, max(ts) AS mtime FROM events GROUP BY user_id HAVING count(*) > 1),
c AS (SELECT 'u' || user_id AS path, md5((CASE WHEN user_id % 2 = 0 THEN max(event_id) ELSE min(event_id) END)::VARCHAR) AS hash, max(ts) FILTER (event_type <> 'view') AS cached_at, max(ts) FILTER (event_type <> 'view') AS mtime FROM events WHERE event_type <> 'error' GROUP BY user_id),
p AS (SELECT coalesce(f.path, c.path) AS path, CASE WHEN f.path IS NULL THEN 'removed' WHEN c.path IS NULL THEN 'new' WHEN date_diff('second', c.cached_at, TIMESTAMP '{NOW}') > {20 * TTL} THEN 'expired' WHEN f.hash <> c.hash THEN 'changed' WHEN coalesce(f.mtime > c.mtime, true) THEN 'stale' ELSE 'hit' END AS action FROM f FULL JOIN c ON f.path = c.path)"""


def _plan(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("path", F.concat(F.lit("u"), "user_id"))

    def digest(x):
        return F.md5(x.cast("string").cast("binary"))

    files = e.groupBy("path").agg(digest(F.max("event_id")).alias("hash"), F.max("ts").cast("timestamp").alias("mtime"), F.count("*").alias("n")).where("n > 1").drop("n")
    seen = F.max(F.when(F.col("event_type") != "view", F.col("ts"))).cast("timestamp")
    cache = e.where("event_type <> 'error'").groupBy("path", "user_id").agg(digest(F.when(F.col("user_id") % 2 == 0, F.max("event_id")).otherwise(F.min("event_id"))).alias("hash"), seen.alias("cached_at"), seen.alias("mtime")).drop("user_id")
    return C.plan(files, cache, NOW, 20 * TTL)


@query(f"WITH {_CACHE} SELECT path, action FROM p")
def cache_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query(f"WITH {_CACHE} SELECT count(*) FILTER (action = 'hit') AS hits, count(*) FILTER (action <> 'hit') AS misses, coalesce(count(*) FILTER (action = 'hit') * 1000 // count(*), 0)::BIGINT AS permille FROM p WHERE action <> 'removed'")
def cache_summary(spark, sf_dir):
    return C.summary(_plan(spark, sf_dir))


@query("""WITH c AS (SELECT 'u' || user_id AS path, count(*) AS access_count, sum(event_id % 1000)::BIGINT AS size_bytes FROM events GROUP BY user_id),
r AS (SELECT *, coalesce(sum(size_bytes) OVER (ORDER BY access_count, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM c)
SELECT path, access_count, size_bytes FROM r WHERE freed < 20000""")
def lfu_evict(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cache = e.groupBy("user_id").agg(F.count("*").alias("access_count"), F.sum(F.col("event_id") % 1000).alias("size_bytes"))
    cache = cache.select(F.concat(F.lit("u"), "user_id").alias("path"), "access_count", "size_bytes")
    return C.evicted(cache, 20_000).select("path", "access_count", "size_bytes")


def _objects(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.concat_ws(".", F.replace("p_brand", F.lit("#"), F.lit("_")), "p_partkey")
    anchor = F.when(F.col("p_size") % 3 == 0, F.lit("")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("ns-"), name)).otherwise(F.col("p_partkey").cast("string"))
    return p.select(name.alias("name"), F.lit("py").alias("domain"), F.lit("function").alias("type"), F.lit(1).alias("priority"), F.lit("api.html").alias("uri"), anchor.alias("anchor"), F.when(F.col("p_size") % 2 == 0, name).otherwise(F.col("p_name")).alias("display"))


_OBJECTS = """o AS (SELECT replace(p_brand, '#', '_') || '.' || p_partkey AS name, p_partkey::VARCHAR AS id, p_size, p_name FROM part)"""


@query(f"""WITH {_OBJECTS} SELECT name || ' py:function 1 api.html' || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN '#ns-$' ELSE '#' || id END || ' ' || CASE WHEN p_size % 2 = 0 OR p_name = name THEN '-' ELSE p_name END AS line FROM o""")
def inventory_lines(spark, sf_dir):
    return V.lines(_objects(spark, sf_dir))


@query(f"""WITH {_OBJECTS} SELECT name, 'py:function' AS type, 1::BIGINT AS priority, 'api.html' || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN '#ns-' || name ELSE '#' || id END AS uri, CASE WHEN p_size % 2 = 0 THEN name ELSE p_name END AS display FROM o""")
def inventory_parse(spark, sf_dir):
    return V.parsed(V.lines(_objects(spark, sf_dir)))


@query("""WITH e AS (SELECT p_type AS a, p_brand AS b, p_size % 4 AS k FROM part), x AS (
SELECT a AS entry, b AS subentry FROM e WHERE k = 0 UNION ALL SELECT a, b FROM e WHERE k = 1 UNION ALL SELECT b, a FROM e WHERE k = 1
UNION ALL SELECT a, 'see ' || b FROM e WHERE k = 2 UNION ALL SELECT a, NULL FROM e WHERE k = 3)
SELECT CASE WHEN regexp_matches(upper(left(entry, 1)), '^\\p{L}$') THEN upper(left(entry, 1)) ELSE '_' END AS letter, entry, subentry FROM x""".replace("\\\\", "\\"))
def genindex(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, ("single: %s; %s", "pair: %s; %s", "see: %s; %s", "%s"))), (F.col("p_size") % 4).cast("int"))
    a, b = F.col("p_type"), F.col("p_brand")
    entry = F.replace(F.when(F.col("p_size") % 4 == 3, a).otherwise(F.concat(F.split(kind, "%s")[0], a, F.lit("; "), b)), F.lit("  "), F.lit(" "))
    return V.index_entries(table(spark, sf_dir, "part").select(entry.alias("entry")))
