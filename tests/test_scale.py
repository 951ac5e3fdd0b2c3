"""What must not grow with the tables: work done again for a text, rows exchanged, memory of a worker."""

from pyspark.sql import functions as F

from docframe.operators import search as S


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_search_cleans_each_text_once(spark):
    docs = spark.createDataFrame([("a", "Cats, cat! of the"), ("b", None), ("c", "c.a-t's ..."), ("a", "cat")], "docname string, content string")
    found = S.search(docs, "the running of the documents ofed cats")
    assert plan(found).count("regexp_replace") <= 2 * 2
    assert [tuple(r) for r in found.collect()] == [("a", 7)]
    assert [tuple(r) for r in S.search(docs, "cat cats", title=F.col("docname")).collect()] == [("a", 6)]


def test_postings_exchange_texts_and_nothing_else(spark):
    docs = spark.createDataFrame([("a", "Cats run, x cat"), ("b", None), ("b", " "), ("a", "the cat"), (None, "dogs"), (None, "dog ! dog")], "docname string, content string")
    got = S.postings(docs)
    assert "Aggregate" not in plan(got) and plan(got).count("Repartition") == 1
    want = {("a", "cat"): (3, [0, 1, 3]), ("a", "run"): (1, [1]), ("a", "the"): (1, [0]), (None, "dog"): (3, [0, 0, 2])}
    assert {(r.docname, r.term): (r.tf, r.positions) for r in got.collect()} == want
    assert {r.term for r in S.postings(docs.limit(1), language="de").collect()} == {"cats", "run", "cat"}


def test_postings_of_a_document_that_goes_on_in_other_batches(spark):
    docs = spark.range(25_000).select(F.when(F.col("id") < 24_000, "a").otherwise(F.concat(F.lit("b"), F.col("id") % 500)).alias("docname"), F.lit("one two " + "w " * 50).alias("content"))
    got = S.postings(docs).select("docname", "term", "tf", F.size("positions").alias("n")).collect()
    assert {(r.docname, r.term) for r in got} == {(d, t) for d in ("a", *[f"b{i}" for i in range(500)]) for t in ("one", "two")} and len(got) == 1002
    assert {(r.tf, r.n) for r in got} == {(24_000, 24_000), (2, 2)}


MARKUP = "Title *x*\n=========\n\npart one\n\n* a\n* b :ref:`c`\n\nNext\n----\n\n.. note:: N\n"


def test_trees_are_parsed_once_and_not_exchanged(spark):
    from docframe.functions import doctree as D

    docs = spark.createDataFrame([("a", MARKUP), ("b", None), ("c", ""), (None, "p\n"), ("a", MARKUP)], "docname string, content string").coalesce(1)
    titles, dumps = D.texts_of(docs, "title"), D.dumps_of(docs)
    for df in (titles, dumps):
        assert plan(df).count("MapInArrow") == 1 and "Join" not in plan(df) and "Aggregate" not in plan(df)
    assert sorted(tuple(r) for r in titles.select("doc", "text").collect()) == [("a", "Next"), ("a", "Next"), ("a", "Title x"), ("a", "Title x")]
    got = sorted(((r.doc or "", r.dump) for r in dumps.collect()))
    assert got == [(d or "", D.parse(t, d or "", True, d or "").pformat()) for d, t in ((None, "p\n"), ("a", MARKUP), ("a", MARKUP), ("c", ""))]
    some = docs.where("docname = 'c' OR docname IS NULL").union(docs.where("docname = 'a'").limit(1)).where("docname IS NOT NULL")
    assert sorted(map(tuple, D.texts_of(some, "paragraph").collect())) == sorted(map(tuple, D.texts(D.trees(some), "paragraph").collect()))
    assert sorted(map(tuple, D.dumps_of(some).collect())) == sorted(map(tuple, D.dumps(D.trees(some)).collect()))


def test_a_worker_holds_a_piece_of_a_batch_at_a_time():
    import pyarrow as pa

    from docframe.functions.batches import pieces, rows_of

    texts = ["x" * 600_000, None, "é" * 400_000, "", "y" * 3_000_000, "z"]
    b = pa.RecordBatch.from_pydict({"k": [str(i) for i in range(6)], "t": texts})
    assert [p.column(0).to_pylist() for p in pieces(b, 1)] == [["0", "1"], ["2", "3"], ["4"], ["5"]]
    assert list(pieces(b.slice(0, 0), 1)) == []
    schema = pa.schema([("k", pa.string()), ("n", pa.int64())])
    out = list(rows_of([b], lambda k, t: ({"k": k, "n": i} for i in range(len(t or "") // 100_000)), schema, 4))
    assert max(x.num_rows for x in out) <= 4 and sum(x.num_rows for x in out) == 6 + 4 + 30


def test_constraints_take_each_value_once(spark, sf):
    from docframe.plans import checks

    p = plan(checks.constraints_eval(spark, sf))
    assert p.count("schemaOfVariant(") == 4 and p.count("VariantType, false") == 4  # names that the rules look at
    assert "filter(" not in p and p.index("parseJson") < p.index("Repartition")  # items are made after the exchange


def test_pages_are_filled_in_pieces(spark):
    import json

    import pyarrow as pa

    from docframe.functions import templates as E

    texts = [json.dumps({"x": c * 700_000}) for c in "abc"]
    out = list(E.filled(iter([(pa.array(["{{ x }}"] * 4), pa.array([*texts, None]))])))
    assert [len(x) for x in out] == [1, 1, 2] and [(x or "")[:1] for y in out for x in y.to_pylist()] == ["a", "b", "c", ""]
    df = spark.range(25_000).coalesce(1).select("id", F.to_json(F.struct("id", F.lit("w" * 200).alias("w"))).alias("c"))
    got = df.select("id", E.rendered("{{ id }}", F.col("c")).alias("x"))
    assert got.where("x = id").count() == got.count() == 25_000


def test_records_are_made_in_pieces(spark):
    import pyarrow as pa

    from docframe.functions import markup as M
    from docframe.functions.batches import rows_of

    texts = ["T\n====\n\n" + "x " * 600_000, None, "", ":ref:`a` " * 9000]
    schema = pa.schema([("doc", pa.string()), ("ord", pa.int64()), ("kind", pa.string())])
    out = list(rows_of([pa.RecordBatch.from_pydict({"d": list("abcd"), "t": texts})], M._rows, schema))
    assert [x.num_rows for x in out] == [1, 4096, 4096, 808]
    docs = spark.createDataFrame(list(zip("abcd", texts, strict=True)), "docname string, content string")
    assert {(r.doc, r.kind): r["count"] for r in M.parse(docs).groupBy("doc", "kind").count().collect()} == {("a", "section"): 1, ("d", "role"): 9000}
