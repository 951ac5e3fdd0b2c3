"""Domains, builds with a cache, and what a site has besides pages."""

import datetime
import os

import pytest
from pyspark.sql import functions as F
from test_project import said, write

from docframe import api
from docframe.operators import cache as C
from docframe.operators import constraints as K
from docframe.operators import domains as M
from docframe.operators import ordered as O
from docframe.operators import rules as U
from docframe.operators import search as S
from docframe.operators import site
from docframe.operators import statistics
from docframe.operators import toctree
from docframe.sources import config as G


def test_references_of_texts(spark):
    df = spark.createDataFrame([("d", "é :ref:`a` and :doc:`T <b>` :py:func:`os.path`\n\n:this:that :odd:`x`"), ("n", None)], "docname string, content string")
    got = [(r.line, r.col, r.role, r.kind, r.target, r.display, r.external) for r in M.scanned(df).orderBy("line", "col").collect()]
    assert got == [(1, 3, "ref", "section", "a", None, False), (1, 16, "doc", "document", "b", "T", False), (1, 29, "py:func", "function", "os.path", None, True), (3, 11, "odd", "odd", "x", None, False)]
    assert M.scanned(df, roles={"odd": "section"}).where("kind = 'section'").count() == 2
    assert {r.kind: r.n for r in M.histogram(M.scanned(df)).collect()} == {"section": 1, "document": 1, "function": 1, "odd": 1}
    assert M.object_types(spark).count() == 20


def objects(spark):
    docs = M.documents(spark.createDataFrame([("guide/start", "Getting Started", 1, 1), ("api", "API", 1, 2)], "docname string, title string, line long, ord long"))
    labels = M.sections(spark.createDataFrame([("intro", "Old", "api", 3, 3), ("intro", "Intro", "guide/start", 3, 4)], "label string, title string, docname string, line long, ord long"))
    py = M.python(spark.createDataFrame([("join", "os.path", "api", 1, 5), ("run", "", "api", 2, 6), ("join", "m", "api", 3, 7)], "name string, module string, docname string, line long, ord long"), "function")
    odd = docs.limit(1).withColumn("object_type", F.lit("zoo"))
    return docs.unionByName(labels).unionByName(py).unionByName(odd)


def test_domains(spark):
    known, errors = M.registered(objects(spark))
    assert [r.message for r in errors.collect()] == ["Unknown RST object type: zoo"]
    assert {r.id: r.docname for r in known.where("id = 'ref:intro'").collect()} == {"ref:intro": "guide/start"} and known.count() == 6
    refs = [("document", "api.rst"), ("document", "start"), ("section", "intro"), ("section", "int"), ("numref", "api"), ("function", "os.path.join"), ("function", "join"), ("class", "oin"), ("wild", "x"), ("document", "http://x"), ("section", "old stuff"), ("document", "zz")]
    df = spark.createDataFrame(refs, "kind string, target string").withColumn("external", F.col("target").startswith("http"))
    got = M.resolved(df, known)
    all_ = M.messages(got, M.suggested(got, known))
    by = {(r.kind, r.target): (r.domain, r.found, r.message) for r in all_.collect()}
    assert len(by) == len(refs)
    assert by["document", "api.rst"] == ("rst", "doc:api", None) and by["section", "intro"][1] == "ref:intro" and by["numref", "api"][1] == "doc:api"
    assert by["function", "os.path.join"][1] == "py:func:os.path.join" and by["function", "join"][1] == "py:func:m.join"
    assert by["document", "start"][2] == "Document 'start' not found. Did you mean: guide/start?" and by["section", "int"][2] == "Section label 'int' not found. Did you mean: intro?"
    assert by["class", "oin"][2] == "Python object 'oin' not found. Did you mean: m.join, os.path.join?" and by["wild", "x"] == (None, None, "No domain found for reference type: wild")
    assert by["document", "zz"][2] == "Document 'zz' not found"
    assert {r.target for r in M.broken(all_).collect()} == {"start", "int", "oin", "x", "old stuff", "zz"}
    assert {r.id for r in M.containing(known, "path").collect()} == {"py:func:os.path.join"} and M.grouped(known).count() == 3
    # a title that holds the target, whatever the case
    titled = M.resolved(spark.createDataFrame([("document", "STARTED", False)], "kind string, target string, external boolean"), known)
    assert [r.suggestions for r in M.suggested(titled, known).collect()] == [["guide/start"]]


def test_a_build_with_a_cache(spark, tmp_path):
    src, out, cache = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "cache")
    src.mkdir()
    write(src, {"conf.py": "project = 'p'\n", "index.rst": "H\n=\n\n.. toctree::\n\n   a\n", "a.rst": "A\n=\n"})
    pages = lambda: {r.path: r.html for r in spark.read.parquet(f"{out}/pages").collect()}
    b = api.build(spark, str(src), out, cache=cache)
    assert (b.hits, said(b)) == (0, []) and b.counts() == {"documents": 2, "warnings": 0, "errors": 0, "cache_hits": 0}
    first = pages()
    assert api.build(spark, str(src), out, cache=cache).hits == 2 and pages() == first
    os.utime(src / "a.rst", (10**9 * 2, 10**9 * 2))
    (src / "a.rst").write_text("B\n=\n")
    assert api.build(spark, str(src), out, cache=cache).hits == 1 and "B" in pages()["a.html"]
    assert api.build(spark, str(src), out, ["project=q"], cache=cache).hits == 0
    os.remove(src / "a.rst")
    assert set({r.path for r in api.build(spark, str(src), out, cache=cache) and spark.read.parquet(cache).collect()}) <= {"index.rst", "a.rst"} and set(pages()) == {"index.html"}
    with pytest.raises(ValueError):
        api.build(spark, str(src), str(tmp_path))
    api.clean(str(src), out, cache)
    assert os.listdir(out) == [] and os.listdir(cache) == [] and site.folder_size(str(src)) > 0


def test_commands(tmp_path, capsys):
    assert [site.by_folders(x.split()) for x in ("build a", "src out", "-W src out", "-v build a", "-v src out", "", "--help")] == [False, True, True, False, True, False, False]
    assert api.main(["odd"]) == 2 and api.main(["build", "-D", "=x", "a", "b"]) == 2 and "expected key=value" in capsys.readouterr().out
    assert site.jobs("3") == 3 and site.jobs("auto") >= 1
    with pytest.raises(ValueError):
        site.jobs("-1")
    assert G.pair("a=b=c") == ("a", "b=c")
    c = G.from_python({"extensions": ["x"], "html_theme": "t", "project": 5, "odd": 1, "exclude_patterns": ("a",), "templates_path": ["z"]})
    assert c["extensions"] == ["x"] and c["output"]["html_theme"] == c["theme"]["name"] == "t" and c["project"] == "" and c["exclude_patterns"] == ["a"] and c["template_dirs"] == ["z"] and G.from_python({})["extensions"] == []
    G.save(c, str(tmp_path / "config.json"))
    assert G.load(str(tmp_path))[0] == c
    assert site.extension_settings(["x.ext.todo", "zzz"]) == ({"todo_include_todos": True, "todo_emit_warnings": False}, ["zzz"]) and len(site.EXTENSIONS) == 16
    assert statistics.exit_code(None) == 2


def test_site_parts(spark, tmp_path):
    docs = spark.createDataFrame([("a/b", "T & <i>x</i>", "<p>"), ("c", None, "q")], "docname string, title string, content string")
    got = {r.path: r.html for r in site.pages(docs, {"project": "P", "copyright": "me"}).collect()}
    assert set(got) == {"a/b.html", "c.html"} and "<title>T &amp; x &#8212; P</title>" in got["a/b.html"] and "<footer>me</footer>" in got["c.html"]
    assert {r.path for r in site.sources(docs).collect()} == {"_sources/a/b.rst.txt", "_sources/c.rst.txt"}
    groups = site.general_index(spark.createDataFrame([("single: beta; x",), ("Alpha, beta",), ("double: q; r",)], "entry string"))
    assert {r.letter: [tuple(e) for e in r.entries] for r in groups.collect()} == {"B": [("beta", None), ("beta", "x")], "A": [("Alpha", None)], "Q": [("q", "r")], "R": [("r", "q")]}
    assert site.index_page(groups).startswith("<h1>Index</h1>\n<h2>A</h2><ul><li>Alpha</li></ul>")
    refs = spark.createDataFrame([("d", "x.png", 1), ("d", "y.png", 2)], "docname string, path string, line long")
    assert [r.path for r in site.missing_files(refs, spark.createDataFrame([("x.png",)], "path string")).collect()] == ["y.png"]
    assert {r.folder: r.bytes for r in site.sizes(spark.createDataFrame([("a/b/x", 3), ("a/y", 4), ("z", 5)], "path string, size long")).collect()} == {".": 12, "a": 7, "a/b": 3}
    assert site.copied([str(tmp_path), "/nowhere"], str(tmp_path.parent / "copy")) == ["/nowhere"] and site.empty_search()["terms"] == {} and site.build_info({"project": "p"}, "1")["config"]["project"] == "p"
    idx = spark.createDataFrame([(0, "a"), (1, "b")], "idx long, docname string")
    posts = S.postings(spark.createDataFrame([("a", "cats cats"), ("b", "cat dog")], "docname string, content string"))
    rows = {r.json for r in S.dumped(idx, posts, spark.createDataFrame([("a", "A")], "docname string, title string")).collect()}
    assert '{"term":"cat","documents":[{"idx":0,"tf":2},{"idx":1,"tf":1}]}' in rows and '{"idx":0,"docname":"a","title":"A"}' in rows and len(rows) == 4
    objs = spark.createDataFrame([("o", "a"), ("p", "c")], "name string, docname string")
    assert sorted(r.docname for r in S.with_objects(idx, objs).collect()) == ["a", "b", "c"] and [(r.name, r.idx) for r in S.object_rows(idx, objs).collect()] == [("o", 0)]


def test_cache_that_is_full(spark):
    t = datetime.datetime(2024, 1, 1)
    row = lambda p, n, size: (p, "h", t, t, n, size, "x")
    old = spark.createDataFrame([row("a", 1, 50), row("b", 5, 30), row("c", 2, 20)], C.ENTRY)
    new = spark.createDataFrame([row("b", 0, 40), row("d", 0, 10)], C.ENTRY)
    assert {r.path for r in C.stored_within(old, new, 1000).collect()} == {"a", "b", "c", "d"}
    assert {r.path for r in C.stored_within(old, new, 100).collect()} == {"b", "c", "d"}
    assert C.total(old).first().asDict() == {"bytes": 100, "entries": 3}


def test_ordered_state(spark):
    assert O.leveled(["=", "-", "=", "~", "-", "~"]) == [1, 2, 1, None, 2, 3]
    n = spark.createDataFrame([("d", "a", 1, True, "u"), ("d", "a", 2, True, "u"), ("d", "b", 1, True, "u"), ("d", "b", 2, True, "v")], "doc string, name string, ord long, explicit boolean, refuri string")
    assert {(r.name, r.ord): r.status for r in O.name_conflicts(n).collect()} == {("a", 1): "kept", ("a", 2): "duplicate", ("b", 1): "duplicate", ("b", 2): "duplicate"}
    names = spark.createDataFrame([("d", 1, "A b"), ("d", 2, "a-b"), ("d", 3, "日"), ("e", 1, "a b")], "doc string, ord long, name string")
    assert {(r.doc, r.ord): r.id for r in O.ids_of(names).collect()} == {("d", 1): "a-b", ("d", 2): "id1", ("d", 3): "id2", ("e", 1): "a-b"}
    deep = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(100)] + [("x", "y"), ("y", "z"), ("z", "y"), ("w", "gone")], "name string, parent string")
    got = {r.name: (r.depth, r.root, r.chain) for r in O.parent_chains(deep).collect()}
    assert got["n99"] == (99, "n0", "/".join(f"n{i}" for i in range(100))) and got["x"] == (2, "z", "z/y/x") and got["w"] == (0, "w", "w") and len(got) == 104
    res = spark.createDataFrame([("a.css", 1, 5), ("a.css", 2, 1), ("b.css", 3, 0)], "filename string, ord long, priority int")
    assert sorted((r.filename, r.ord) for r in O.first_resources(res).collect()) == [("a.css", 1), ("b.css", 3)]


def test_pruned_index(spark):
    docs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "idx long, docname string")
    posts = spark.createDataFrame([("x", 0, 1), ("x", 2, 2), ("y", 1, 1)], "term string, idx long, tf long")
    objs = spark.createDataFrame([("o", 2), ("p", 1)], "name string, idx long")
    d, p, o = S.pruned(docs, posts, objs, docs.where("docname <> 'b'"))
    assert {(r.idx, r.docname) for r in d.collect()} == {(0, "a"), (1, "c")} and {(r.term, r.idx, r.tf) for r in p.collect()} == {("x", 0, 1), ("x", 1, 2)} and [(r.name, r.idx) for r in o.collect()] == [("o", 1)]
    done = []
    assert site.finish({"info": lambda: done.append(2), "indices": lambda: done.append(1)}) == ["indices", "info"] and done == [1, 2]


def test_registries(spark):
    r = M.Registry()
    r.add("js", ["wild"])
    with pytest.raises(ValueError):
        r.add("rst", [])
    df = spark.createDataFrame([("wild",), ("document",), ("odd",)], "kind string")
    assert {x.kind: x.domain for x in r.dispatch(df).collect()} == {"wild": "js", "document": "rst", "odd": None} and r.names() == ["rst", "python", "js"]
    u = U.Registry(U.ROLES)
    with pytest.raises(ValueError):
        u.add("doc", U.ROLES["doc"])
    u.add("mine", U.ROLES["ref"])
    assert "mine" in u and len(u) == 11 and u.names() == sorted([*U.ROLES, "mine"])
    o = spark.createDataFrame([({"lineno": "1", "name": "x", "zzz": ""},)], "o map<string,string>")
    assert [tuple(x) for x in o.select(U.similar_option(F.col("o"), ["linenos", "lineno-start", "name"]).alias("x")).first().x] == [("lineno", "linenos")]
    lines = spark.createDataFrame([("d", k + 1, t) for k, t in enumerate(["====", "Top", "====", "", "Sub", "---", "x"])], "doc string, n long, text string")
    assert sorted((r.line, r.title, r.style) for r in O.titles(lines).collect()) == [(2, "Top", "=="), (5, "Sub", "-")]


def test_rules_of_discovery(spark):
    files = spark.createDataFrame([(p,) for p in (".venv/x.rst", ".git/a.rst", "a/.git/b.rst", "_build/c.rst", "d.rst", "e/_build/f.rst", "Thumbs.db", "g.py", "__pycache__/h.rst")], "path string")
    assert {r.path for r in toctree.discover(files, ["**"], toctree.EXCLUDED, toctree.SUFFIXES).collect()} == {"a/.git/b.rst", "d.rst", "e/_build/f.rst"}
    assert {r.path for r in toctree.fallback(files).collect()} == {"d.rst"}
    entries = spark.createDataFrame([("index", "a/*", True), ("index", "**x", True), ("s/i", "[ab]?", True), ("index", "no*", True)], "docname string, target string, glob boolean")
    docs = spark.createDataFrame([(d,) for d in ("a/1", "a/b/2", "s/a1", "zx", "s/c1")], "docname string")
    assert {(r.target, r.hit) for r in toctree.glob_hits(entries, docs).collect()} == {("a/*", "a/1"), ("**x", "zx"), ("[ab]?", "s/a1"), ("no*", None)}


def test_whole_numbers_are_equal_exactly(spark):
    df = spark.createDataFrame([("x", '{"n": 9007199254740993, "f": 1.0, "w": "a b"}')], "id string, metadata string")
    item = K.item(F.col("id"), F.lit("t"), F.lit("c"), F.col("metadata"))
    for text, want in (("n == 9007199254740992", False), ("n == 9007199254740993", True), ("f == 1", True), ("w == 'a b'", True), ("n != 1", True)):
        assert df.select(K.compiled(text, item)["value"].alias("v")).first().v is want, text
