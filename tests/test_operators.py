"""Edges of the operators: nulls, empty texts, ties, repeated rows, empty tables."""

import datetime
import zlib

from pyspark.sql import functions as F

from docframe.functions import globs as G
from docframe.functions import markup as M
from docframe.functions import paths as P
from docframe.functions import text as X
from docframe.operators import cache as C
from docframe.operators import constraints as K
from docframe.operators import inventory as V
from docframe.operators import ordered as O
from docframe.operators import references as R
from docframe.operators import search as S
from docframe.operators import statistics as T
from docframe.operators import toctree
from docframe.operators.indexing import dense_index


def values(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column, **given):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]).select(column.alias("x")).first().x


def test_stems(spark):
    words = ["running", "walked", "tests", "sing", "ed", "as", "ing", "bed", "é", "thing's"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select(X.term(F.col("w")).alias("t"))
    assert [r.t for r in df.collect()] == ["runn", "walk", "test", "sing", "ed", "as", "ing", "bed", "é", "thing"]


def test_search_counts_repeated_words_and_breaks_ties_by_name(spark):
    docs = spark.createDataFrame([("b", "cat dog"), ("a", "cat dog"), ("c", "cat cat cat"), ("d", None), ("e", "")], "docname string, content string")
    assert [tuple(r) for r in S.search(docs, "cat cat dog").collect()] == [("c", 6), ("a", 3), ("b", 3)]
    assert S.search(docs, "  ").count() == 0
    assert [tuple(r) for r in S.search(docs, "cat", title=F.col("docname")).collect()] == [("c", 3), ("a", 1), ("b", 1)]


def test_index_updates(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "docname string, n int")
    new = spark.createDataFrame([("a", 9)], "docname string, n int")
    assert values(S.upsert(old, new)) == [("a", 9), ("b", 3)]
    assert values(S.upsert(old, new, spark.createDataFrame([("b",)], "docname string"))) == [("a", 9)]
    assert values(S.prune(old, new)) == [("a", 1), ("a", 2)]


def test_dense_index(spark):
    df = dense_index(spark.range(100).select((99 - F.col("id")).alias("v")), ["v"])
    assert all(r.idx == r.v for r in df.collect())
    assert dense_index(spark.range(0), ["id"]).count() == 0


def test_globs(spark):
    cases = [("foo/**/bar", "foo/bar", False), ("**/bar", "bar", False), ("**/bar", "a/bar", True), ("*", "a/b", False), ("a?c", "a/c", False), ("[!abc].rst", "d.rst", True), ("[!abc].rst", "a.rst", False), ("[^ab]x", "^x", True), (r"[\d]x", "dx", True), (r"[\d]x", "1x", False), ("[ab", "[ab", True), ("***", "a/b", True), ("", "", True), ("a.b", "axb", False), ("a", "a\n", False)]
    for glob, path, hit in cases:
        assert one(spark, G.matches(F.col("p"), [glob]), p=path) is hit, (glob, path)
    assert one(spark, G.matches(F.col("p"), []), p="a") is False


def test_discovery_prunes_folders(spark):
    files = spark.createDataFrame([("a.rst",), ("_build/x.rst",), ("b/_build/x.rst",), ("c.py",), (None,), ("noext",)], "path string")
    got = toctree.discover(files, ["**"], [*toctree.EXCLUDED, "b"], toctree.SUFFIXES)
    assert values(got) == [("a.rst",)]


def test_docnames(spark):
    cases = [("sibling", "sub/page", "sub/sibling"), ("/a/b", "sub/page", "a/b"), ("../x", "sub/page", "x"), ("../../../x", "sub/page", "x"), ("./x//y", "index", "x/y"), ("x", "index", "x")]
    for target, source, want in cases:
        assert one(spark, P.resolve_docname(F.col("t"), F.col("s")), t=target, s=source) == want
    assert one(spark, P.docname(F.col("p")), p="a\\b.c.rst") == "a/b.c"
    assert one(spark, P.docname(F.col("p")), p=".hidden") == ".hidden"
    for a, b, want in [("a/x", "a/y", "y.html"), ("a/x", "b/y", "../b/y.html"), ("x", "b/y", "b/y.html"), ("a/b/c", "a/d", "../d.html")]:
        assert one(spark, P.relative_uri(F.col("a"), F.col("b")), a=a, b=b) == want


def test_ids(spark):
    for s, want in [("Ärger über Straße", "arger-uber-strasze"), ("1. First!", "first"), ("--", ""), ("", ""), ("日本", "")]:
        assert one(spark, X.make_id(F.col("s")), s=s) == want


def test_toctree(spark):
    docs = spark.createDataFrame([("index",), ("a",), ("pages/x",), ("pages/y",), ("lost",)], "docname string")
    e = spark.createDataFrame([("index", "a", False), ("index", "nope", False), ("index", "pages/*", True), ("index", "dead*", True), ("index", "self", False), ("index", "https://x.y/", False), ("pages/x", "nope", False)], "docname string, target string, glob boolean")
    assert values(toctree.missing(e, docs)) == [("index", "nope", "nope"), ("pages/x", "nope", "pages/nope")]
    hits = {tuple(r) for r in toctree.glob_hits(e, docs).collect()}
    assert hits == {("index", "dead*", None), ("index", "pages/*", "pages/x"), ("index", "pages/*", "pages/y")}
    assert values(toctree.orphans(e, docs)) == [("lost",)]
    assert toctree.glob_hits(e.limit(0), docs).count() == 0
    assert toctree.orphans(e.limit(0), docs).count() == 4


def test_references(spark):
    labels = spark.createDataFrame([("Intro  Text", "a", 1), ("x", "a", 2), ("x", "b", 3)], "name string, docname string, ord long")
    sections = spark.createDataFrame([("X", "c", 1)], "name string, docname string, ord long")
    assert values(R.targets(labels, sections)) == [("intro text", "a"), ("x", "c")]
    refs = spark.createDataFrame([("q", "docs"), ("q", "zz"), ("q", "docsmith")], "docname string, target string")
    names = spark.createDataFrame([(n,) for n in ("doc", "docs-a", "docs", "s", "o", "smith", "mith", "ocs")], "name string")
    got = {r.target: r.suggestions for r in R.suggestions(refs, names).collect()}
    assert got == {"docs": ["doc", "docs", "docs-a", "o", "ocs"], "docsmith": ["doc", "docs", "mith", "o", "ocs"]}
    assert R.suggestions(refs.limit(0), names).count() == 0
    assert one(spark, R.kind(F.col("r")), r="py:func") == "function" and one(spark, R.kind(F.col("r")), r="odd") is None
    assert one(spark, R.is_external(F.lit("module"), F.col("t")), t="os.path") is True and one(spark, R.is_external(F.lit("module"), F.col("t")), t="osx") is False


def test_expressions(spark):
    item = '{"status": "open", "n": 3, "f": 3.0, "e": "", "t": true, "l": ["a"], "title": "over"}'
    df = spark.createDataFrame([(1, "T", "c", item)], "i int, t string, c string, m string").select(K.item(F.col("i"), F.col("t"), F.col("c"), F.col("m")).alias("item"))
    cases = {"status == 'open'": (True, None), "status == open and n == 3.0": (True, None), "n == f": (False, None), "n == '3'": (False, None), "n != '3'": (True, None), "title == over": (True, None), "id == '1'": (True, None), "id == 1": (False, None), "content": (True, None), "e": (False, None), "not e": (True, None), "t and l": (True, None), "status in ['shut', \"open\"]": (True, None), "status in []": (False, None), "t or nothing": (True, None), "e and nothing": (False, None), "nothing": (False, "unknown name nothing"), "status == 'a or b'": (False, None), "l == a": (False, None)}
    for text, want in cases.items():
        r = df.select(K.compiled(text, F.col("item")).alias("r")).first().r
        assert (r.value, r.error) == want, text


def test_constraint_actions(spark):
    checks = spark.createDataFrame([(1, "a", "x", "warning", False, None), (1, "a", "y", "error", False, None), (2, "a", "x", "warning", False, None), (2, "b", "x", "critical", False, None), (3, "a", "x", "info", True, None), (4, "a", "x", "info", True, "unknown")], "id int, constraint string, check_name string, severity string, ok boolean, error string")
    assert values(K.actions(checks)) == [(1, 2, "constraint-warning, constraint-error", False), (2, 2, "constraint-critical", True), (4, 1, "", False)]


def test_cache(spark):
    t = datetime.datetime(2024, 1, 1)
    files = spark.createDataFrame([("a", "1", t), ("b", "1", t), ("c", "1", t), ("d", "1", t), ("e", "1", t)], "path string, hash string, mtime timestamp")
    old = t - datetime.timedelta(days=2)
    cache = spark.createDataFrame([("a", "1", t, t), ("b", "2", t, t), ("c", "1", old, t), ("d", "1", t, old), ("z", "1", t, t)], "path string, hash string, cached_at timestamp, mtime timestamp")
    assert values(C.plan(files, cache, t, 86400)) == [("a", "hit"), ("b", "changed"), ("c", "expired"), ("d", "stale"), ("e", "new"), ("z", "removed")]
    assert values(C.summary(C.plan(files, cache, t, 86400))) == [(1, 4, 200)]
    assert values(C.summary(C.plan(files.limit(0), cache.limit(0), t, 1))) == [(0, 0, 0)]
    entries = spark.createDataFrame([("a", 1, 10), ("b", 1, 10), ("c", 0, 5), ("d", 9, 50)], "path string, access_count int, size_bytes long")
    assert values(C.evicted(entries, 6).select("path")) == [("a",), ("c",)]
    assert C.evicted(entries, 0).count() == 0 and C.evicted(entries, 10**9).count() == 4
    assert values(C.invalidated(entries, entries.where("path = 'a'")).select("path")) == [("b",), ("c",), ("d",)]


def test_inventory_round_trip(spark):
    objects = spark.createDataFrame([("mod.f", "py", "function", 1, "api.html", "mod.f", "mod.f"), ("a b", "std", "label", -1, "x.html", "", "Shown text")], "name string, domain string, type string, priority int, uri string, anchor string, display string")
    raw = V.file_of(objects, "Docs", "My  project", "1")
    assert raw.startswith(b"# Docs inventory version 2\n# Project: My project\n")
    assert zlib.decompress(raw.split(b"\n", 4)[4]).decode().splitlines() == ["a b std:label -1 x.html Shown text", "mod.f py:function 1 api.html#$ -"]
    files = spark.createDataFrame([("i", bytearray(raw)), ("bad", bytearray(b"nothing"))], "path string, content binary")
    assert values(V.read_v2(files)) == [("i", "a b", "std:label", -1, "x.html", "Shown text"), ("i", "mod.f", "py:function", 1, "api.html#mod.f", "mod.f")]
    v1 = spark.createDataFrame([("i", "# header\nos mod os.html\nos.getcwd function os.html\nbad line\n")], "path string, content string")
    assert values(V.read_v1(v1)) == [("i", "os", "py:module", "os.html#module-os"), ("i", "os.getcwd", "py:function", "os.html#os.getcwd")]


def test_names_and_chains(spark):
    n = spark.createDataFrame([("d", "a", 1, True), ("d", "a", 2, False), ("d", "b", 1, True), ("d", "b", 2, True), ("d", "c", 1, False), ("d", "e", 1, False), ("d", "e", 2, False)], "doc string, name string, ord int, explicit boolean")
    assert {(r.name, r.ord): r.status for r in O.name_conflicts(n).collect()} == {("a", 1): "kept", ("a", 2): "duplicate", ("b", 1): "duplicate", ("b", 2): "duplicate", ("c", 1): "kept", ("e", 1): "duplicate", ("e", 2): "duplicate"}
    p = spark.createDataFrame([("root", None), ("a", "root"), ("b", "a"), ("x", "y"), ("y", "x")], "name string, parent string")
    got = {r.name: r.chain for r in O.parent_chains(p).collect()}
    assert got["b"] == "root/a/b" and got["root"] == "root" and set(got) == {"root", "a", "b", "x", "y"}


def test_report(spark, tmp_path):
    a = spark.createDataFrame([("warning", "a.rst", 4, "m")], "severity string, file string, line int, message string")
    b = spark.createDataFrame([("error", "b.rst", None, "x")], "severity string, file string, line int, message string")
    r = T.report((b, "two"), (a, "one"))
    assert [tuple(x) for x in r.orderBy("phase").select("phase", "text").collect()] == [(1, "a.rst:4: WARNING: m"), (2, "b.rst: ERROR: x")]
    assert T.exit_code(r) == 1 and T.exit_code(T.report((a, "one"))) == 0 and T.exit_code(T.report((a, "one")), strict=True) == 1
    T.write_report(r, str(tmp_path / "w"))
    assert [x.value for x in spark.read.text(str(tmp_path / "w")).collect()] == ["a.rst:4: WARNING: m", "b.rst: ERROR: x"]


def test_records():
    text = """=====
Title
=====

Part
----

.. _my label:

Text with :py:func:`Shown <os.path>` and ``:ref:`no` ``.

.. figure:: a.png
   :width: 50%

   A caption with :ref:`x`

.. toctree::
   :glob:

   a/*
   Linked <other>
"""
    got = [(r["kind"], r["name"], r["line"]) for r in M.records(text)]
    assert got == [("section", "Title", 2), ("section", "Part", 5), ("label", "my label", 8), ("role", "func", 10), ("directive", "figure", 12), ("role", "ref", 15), ("directive", "toctree", 17), ("toctree", None, 20), ("toctree", None, 21)]
    r = M.records(text)
    assert r[3]["target"] == "os.path" and r[3]["display"] == "Shown" and r[4]["options"] == {"width": "50%"} and r[-1]["target"] == "other"
    assert M.records("") == [] and M.records("::\n\n   :ref:`x`\n") == []


def test_ids_of_whole_texts(spark, sf):
    import re
    import unicodedata

    from docframe.functions.nodes import DIGRAPHS, LETTERS
    from docframe.plans.text import docs, make_id

    def one(s):
        s = "".join((DIGRAPHS | LETTERS).get(ord(c), c) for c in s.lower())
        s = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()
        return re.sub("-+$", "", re.sub("^[-0-9]+", "", re.sub("[^a-z0-9]+", "-", s)))

    texts = {r.docname: r.content for r in docs(spark, sf).collect()}
    got = {r.docname: r.id for r in make_id(spark, sf).collect()}
    assert got == {k: None if t is None else one(t) for k, t in texts.items()} and max(len(x or "") for x in got.values()) > 1000
