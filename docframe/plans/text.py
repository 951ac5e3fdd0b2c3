"""Search, and functions of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.functions import text as X
from docframe.operators import search as S
from docframe.operators.indexing import dense_index
from docframe.registry import query, table
from docframe.session import spread

QUERY = "the running of the documents ofed"

_STEM = "CASE WHEN w LIKE '%ing' AND strlen(w) > 4 THEN left(w, length(w) - 3) WHEN w LIKE '%ed' AND strlen(w) > 3 THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND strlen(w) > 2 THEN left(w, length(w) - 1) ELSE w END"
_TOKENS = rf"""
words AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+'), lambda x: x <> '') AS a FROM documents),
each AS (SELECT doc_id, unnest(a) AS raw, unnest(range(len(a))) AS pos FROM words),
clean AS (SELECT doc_id, pos, lower(regexp_replace(raw, '[^\p{{L}}\p{{M}}\p{{N}}_-]', '', 'g')) AS w FROM each),
terms AS (SELECT doc_id, pos, {_STEM} AS term FROM clean)
"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("docname"), F.col("text").alias("content"), "doc_id", "lang", "source")


@query(f"""WITH {_TOKENS}, q(term, weight) AS (VALUES ('the', 2), ('runn', 1), ('of', 2), ('document', 1))
SELECT 'doc' || doc_id AS docname, sum(weight)::BIGINT AS score FROM terms JOIN q USING (term) GROUP BY 1 ORDER BY score DESC, docname LIMIT 50""")
def search_topk(spark, sf_dir):
    return S.search(docs(spark, sf_dir), QUERY)


@query(f"""WITH {_TOKENS} SELECT 'doc' || doc_id AS docname, term, count(*) AS tf, string_agg(pos, ',' ORDER BY pos) AS positions FROM terms WHERE strlen(term) >= 2 GROUP BY 1, 2""")
def search_postings(spark, sf_dir):
    p = S.postings(docs(spark, sf_dir))
    return p.withColumn("positions", F.array_join("positions", ","))


@query("""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, 'doc' || doc_id AS docname FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def search_prune(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.concat(F.lit("doc"), "doc_id").alias("docname"))
    return dense_index(S.prune(docs(spark, sf_dir).select("docname", "doc_id"), good), ["doc_id"]).select("idx", "docname")


_COUNT = r"len(list_filter(regexp_split_to_array({}, '[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+'), lambda x: x <> ''))"


@query(f"""SELECT 'doc' || d.doc_id AS docname, {_COUNT.format("CASE WHEN l.quality = 1 THEN d.lang || ' ' || d.source ELSE d.text END")}::BIGINT AS n_words
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality, 0) = 1 OR coalesce(l.toxic, 0) <> 1""")
def search_upsert(spark, sf_dir):
    d = docs(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select(F.concat(F.lit("doc"), "doc_id").alias("docname"), "quality", "toxic")
    index = d.select("docname", F.size(X.words(F.col("content"))).cast("long").alias("n_words"))
    changed = d.join(labels.where("quality = 1").select("docname"), "docname").select("docname", F.size(X.words(F.concat_ws(" ", "lang", "source"))).cast("long").alias("n_words"))
    return S.upsert(index, changed, labels.where("toxic = 1").select("docname"))


@query("""SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS attribute FROM pages""")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.escape_text(F.col("html")).alias("escaped"), X.escape_attribute(F.col("url")).alias("attribute"))


@query("""SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS stripped FROM pages""")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.strip_tags(F.col("html")).alias("stripped"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_partkey || ' ' || p_name || '. ' || p_type), '[^a-z0-9]+', '-', 'g'), '^[-0-9]+', ''), '-+$', '') AS id FROM part""")
def make_id_ascii(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.make_id_ascii(F.concat(F.col("p_partkey").cast("string"), F.lit(" "), "p_name", F.lit(". "), "p_type")).alias("id"))


@query()
def make_id(spark, sf_dir):
    return spread(docs(spark, sf_dir)).select("docname", X.make_id(F.col("content")).alias("id"))


@query(r"""SELECT doc_id, lower(trim(regexp_replace(text, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))) AS name,
CASE WHEN length(text) > 60 THEN left(text, 60) || '…' ELSE text END AS snippet, replace(replace(text, '\', '\\'), ' ', '\ ') AS serial,
(len(text) - len(replace(text, '{', ''))) = (len(text) - len(replace(text, '}', ''))) AS balanced, ((len(text) - len(replace(text, 'the', ''))) // 3)::BIGINT AS n_the FROM documents""")
def text_functions(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.normal_name(t).alias("name"), X.snippet(t).alias("snippet"), X.escape_serial(t).alias("serial"), X.braces_balance(t).alias("balanced"), X.occurrences(t, "the").alias("n_the"))


@query("""SELECT n_name, size, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', size / 1024) WHEN size < 1073741824 THEN printf('%.1f MB', size / 1048576) ELSE printf('%.1f GB', size / 1073741824) END AS shown FROM (SELECT n_name, n_nationkey::BIGINT * n_nationkey * n_nationkey * 512 * 512 + n_nationkey AS size FROM nation)""")
def byte_sizes(spark, sf_dir):
    n = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select("n_name", (n * n * n * 512 * 512 + n).alias("size")).withColumn("shown", X.byte_size(F.col("size")))


@query("""SELECT spec, total, lines FROM (VALUES ('1,3-5', 10, '1,3,4,5'), ('-4', 10, '1,2,3,4'), ('4-', 6, '4,5,6'), ('5-3', 10, NULL), ('x', 10, NULL), ('8-20', 10, '8,9,10'), ('3,1', 5, '3,1')) t(spec, total, lines)""")
def linenos_spec(spark, sf_dir):
    rows = spark.createDataFrame([(s, n) for s, n in (("1,3-5", 10), ("-4", 10), ("4-", 6), ("5-3", 10), ("x", 10), ("8-20", 10), ("3,1", 5))], "spec string, total int")
    return rows.withColumn("lines", F.array_join(X.line_numbers(F.col("spec"), F.col("total")), ","))


@query("""SELECT marker, kind, value FROM (VALUES ('12', 'arabic', 12), ('c', 'loweralpha', 3), ('C', 'upperalpha', 3), ('xiv', 'lowerroman', 14), ('MCMXCIV', 'upperroman', 1994), ('iiii', 'lowerroman', NULL), ('IX', 'lowerroman', NULL), ('ab', 'loweralpha', NULL)) t(marker, kind, value)""")
def enumerator_values(spark, sf_dir):
    rows = [("12", "arabic"), ("c", "loweralpha"), ("C", "upperalpha"), ("xiv", "lowerroman"), ("MCMXCIV", "upperroman"), ("iiii", "lowerroman"), ("IX", "lowerroman"), ("ab", "loweralpha")]
    return spark.createDataFrame(rows, "marker string, kind string").withColumn("value", X.ordinal(F.col("marker"), F.col("kind")).cast("int"))


@query(r"""SELECT p_partkey, trim(p_type) AS target, p_name AS title FROM part""")
def titled_targets(spark, sf_dir):
    t, target = X.title_and_target(F.format_string("%s <%s>", "p_name", "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", target.alias("target"), t.alias("title"))
