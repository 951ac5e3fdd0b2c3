"""Full-text search: an inverted index and scored look-ups, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.functions import text as X
from docframe.functions.batches import pieces
from docframe.operators.indexing import dense_index
from docframe.session import spread

TITLE_WEIGHT = 5


def _posted(rows: pa.RecordBatch, english: bool, kinds: pa.Schema) -> pa.RecordBatch:
    """The postings of rows (docname, lines of clean words), of which those of one name lie together."""
    names = rows.column(0).to_pylist()
    new = np.array([i == 0 or n != names[i - 1] for i, n in enumerate(names)], dtype=bool)
    of_row, firsts = np.cumsum(new) - 1, np.flatnonzero(new)
    lists = pc.split_pattern(rows.column(1), "\n")
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    each = lists.flatten().dictionary_encode()
    of, pos = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    # a word is stemmed once for all its places
    number: dict[str, int] = {}
    words = [X.stem_of(w) if english else w for w in each.dictionary.to_pylist()]
    term_of = np.array([number.setdefault(t, len(number)) if len(t.encode()) >= 2 else -1 for t in words], dtype=np.int64)
    term = term_of[each.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.int64)
    keep = term >= 0
    key, pos = of_row[of[keep]] * max(1, len(number)) + term[keep], pos[keep]
    order = np.argsort(key, kind="stable") if new.all() else np.lexsort((pos, key))
    key, pos = key[order], pos[order].astype(np.int32)
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    doc, term = np.divmod(key[starts], max(1, len(number)))
    ends = np.append(starts, len(key)).astype(np.int32)
    out = [rows.column(0).take(pa.array(firsts[doc])), pa.array(list(number), pa.string()).take(pa.array(term)), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(pos))]
    return pa.RecordBatch.from_arrays([x.cast(k) for x, k in zip(out, kinds.types, strict=True)], schema=kinds)


def postings(docs: DataFrame, key: str = "docname", text: str = "content", language: str = "en") -> DataFrame:
    """(docname, term, tf, positions): the terms of each text with their places among all
    its words; terms of less than 2 bytes are left out. Rows of one document are taken
    together. Texts are exchanged once, postings never."""
    schema = T.StructType([T.StructField("docname", docs.schema[key].dataType), *T._parse_datatype_string("term string, tf long, positions array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        held: list[pa.RecordBatch] = []  # rows of one name, which may go on

        for p in (p for b in batches for p in pieces(b, 1)):
            names = p.column(0).to_pylist()
            last = next((i for i in range(len(names) - 1, -1, -1) if names[i] != names[-1]), -1) + 1
            if held and (last or held[0].column(0)[0].as_py() != names[0]):
                yield _posted(pa.concat_batches([*held, p.slice(0, last)]), language == "en", kinds)
                held = []
            elif last:
                yield _posted(p.slice(0, last), language == "en", kinds)
            held.append(p.slice(last))
        if held:
            yield _posted(pa.concat_batches(held), language == "en", kinds)

    together = docs.select(F.col(key).alias("docname"), F.col(text).alias("_text")).where(F.col("_text").isNotNull()).repartition("docname").sortWithinPartitions("docname")
    return together.select("docname", X.clean_lines(F.col("_text"))).mapInArrow(run, schema)


def query_terms(spark: SparkSession, query: str) -> DataFrame:
    """(term, weight): a word that the query repeats counts as often."""
    one = spark.createDataFrame([(query,)], "q string").select(F.explode(X.words(F.col("q"))).alias("w"))
    return one.select(X.term(F.col("w")).alias("term")).where(F.octet_length("term") >= 2).groupBy("term").agg(F.count("*").alias("weight"))


def search(docs: DataFrame, query: str, limit: int = 50, key: str = "docname", text: str = "content", title: Column | None = None) -> DataFrame:
    """(docname, score): the `limit` best documents; score is the sum over the
    query's words of their number in the text, and 5 for each in the title where one
    is given. Ties go by name. A query of no terms finds nothing."""
    terms = query_terms(docs.sparkSession, query)
    wanted = {r.term: r.weight for r in terms.collect()}  # as many rows as the query has words
    # all words that have one of the terms
    forms = {f: wanted[t] for t in wanted for f in (t, t + "ing", t + "ed", t + "s") if X.stem_of(f) == t}

    if not forms:
        return docs.select(F.col(key).alias("docname"), F.lit(0).cast("long").alias("score")).limit(0)
    docs = spread(docs)
    weight = F.element_at(F.create_map(*[F.lit(x) for p in forms.items() for x in p]), F.col("w"))

    def found(c: Column, times: int) -> DataFrame:
        """A row for each word that counts. No predicate over the text itself: Spark would
        clean the text once more for each time it is named, before it is spread."""
        each = docs.select(F.col(key).alias("docname"), F.explode(F.split(X.clean_lines(c), "\n")).alias("w"))
        return each.where(F.col("w").isin(list(forms))).select("docname", (weight * times).cast("long").alias("score"))

    hits = found(F.col(text), 1) if title is None else found(F.col(text), 1).union(found(title, TITLE_WEIGHT))
    return hits.groupBy("docname").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "docname").limit(limit)


def prune(index: DataFrame, keep: DataFrame, key: str = "docname") -> DataFrame:
    """The rows of an index whose document is in keep; terms left without a document vanish with them."""
    return index.join(keep.select(key).distinct(), key, "left_semi")


def upsert(index: DataFrame, changed: DataFrame, removed: DataFrame | None = None, key: str = "docname") -> DataFrame:
    """An index with the rows of changed in place of their documents' old ones, and without those of removed."""
    gone = changed.select(key)
    if removed is not None:
        gone = gone.union(removed.select(key))
    return index.join(gone.distinct(), key, "left_anti").unionByName(changed)


def with_objects(index: DataFrame, objects: DataFrame) -> DataFrame:
    """(docname) of an index's documents, and of those that only objects name, each once."""
    return index.select("docname").union(objects.select("docname")).distinct()


def object_rows(documents: DataFrame, objects: DataFrame) -> DataFrame:
    """objects with idx of documents (idx, docname): those whose document is gone go."""
    return objects.join(documents.select("idx", "docname"), "docname").drop("docname")


def dumped(documents: DataFrame, postings_: DataFrame, titles: DataFrame) -> DataFrame:
    """(part, json): the index as JSON: a row for each document and each term, a term's
    with its documents' numbers in order."""
    d = documents.join(titles, "docname", "left").select(F.lit("document").alias("part"), F.to_json(F.struct("idx", "docname", "title")).alias("json"))
    each = postings_.join(documents.select("idx", "docname"), "docname")
    lists = each.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("idx", "tf"))).alias("documents"))
    return d.union(lists.select(F.lit("term").alias("part"), F.to_json(F.struct("term", "documents")).alias("json")))


def pruned(documents: DataFrame, postings_: DataFrame, objects: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An index's documents (idx, docname), postings (term, idx, …) and objects (…, idx) of
    the documents in keep, numbered anew without gaps; terms and objects of others go."""
    left = dense_index(prune(documents, keep).withColumnRenamed("idx", "old"), ["old"])
    number = left.select(F.col("old").alias("idx"), F.col("idx").alias("_new"))
    again = lambda df: df.join(number, "idx").drop("idx").withColumnRenamed("_new", "idx")
    return left.drop("old"), again(postings_), again(objects)
