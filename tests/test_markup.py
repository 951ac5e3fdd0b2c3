"""The document tree, directives, templates, and the functions of the markup."""

import random

import pytest
from pyspark.sql import functions as F

from docframe.functions import directives as D
from docframe.functions import doctree as T
from docframe.functions import html as H
from docframe.functions import inlines as I
from docframe.functions import nodes as N
from docframe.functions import templates as E
from docframe.functions import text as X


def tree(text, **how):
    """The dump without its first line, from the left margin."""
    return "\n".join(x[4:] for x in T.parse(text, **how).pformat().split("\n")[1:-1])


def kinds(text, **how):
    return [x.kind for x in T.parse(text, **how).walk() if x.kind != "#text"][1:]


def said(text, **how):
    return [(x.get("level"), x.get("line"), x.children[0].astext()) for x in T.parse(text, **how).walk() if x.kind == "system_message"]


def test_sections():
    assert tree("A\n=\n\nx\n\nB\n-\n\ny\n\nC\n=\n") == '<section ids="a" names="a">\n    <title>\n        A\n    <paragraph>\n        x\n    <section ids="b" names="b">\n        <title>\n            B\n        <paragraph>\n            y\n<section ids="c" names="c">\n    <title>\n        C'
    assert said("A\n=\n\nB\n-\n\nC\n=\n\nD\n~\n") == [(3, 10, "Inconsistent title style: skip from level 1 to 3.")]
    assert said("Wide title\n=====\n") == [(2, 2, "Title underline too short.")] and said("=====\nOver\n-----\n") == [(3, 1, "Title overline & underline mismatch.")]
    assert kinds("====\nTop\n====\n\nx\n\n----\n\ny") == ["section", "title", "paragraph", "transition", "paragraph"]
    assert said("- a\n\n  B\n  =====\n") == [(3, 4, "Unexpected section title.")]
    assert [x.get("ids") for x in T.parse("Same\n====\n\nSame\n====\n").walk() if x.kind == "section"] == [["same"], ["id1"]]
    assert tree("日本\n====\n").startswith('<section ids="id1" names="日本">')


def test_lists():
    assert kinds("- a\n\n  b\n- c\n") == ["bullet_list", "list_item", "paragraph", "paragraph", "list_item", "paragraph"]
    assert said("- a\nb\n") == [(2, 2, "Bullet list ends without a blank line; unexpected unindent.")]
    assert kinds("- a\n\n+ b\n") == ["bullet_list", "list_item", "paragraph"] * 2
    assert [(x.get("enumtype"), x.get("start")) for x in T.parse("iv. a\nv. b\n\n(7) c\n\nB) d\nC) e\n").walk() if x.kind == "enumerated_list"] == [("lowerroman", 4), ("arabic", 7), ("upperalpha", 2)]
    assert kinds("1. a\n2. b\n#. c\n") == ["enumerated_list"] + ["list_item", "paragraph"] * 3 and kinds("3. a\n5. b\n") == ["paragraph"]
    assert tree("term : one : two\n  text\n") == "<definition_list>\n    <definition_list_item>\n        <term>\n            term\n        <classifier>\n            one\n        <classifier>\n            two\n        <definition>\n            <paragraph>\n                text"
    assert tree(":a *b*: c\n:d:\n") == "<field_list>\n    <field>\n        <field_name>\n            a \n            <emphasis>\n                b\n        <field_body>\n            <paragraph>\n                c\n    <field>\n        <field_name>\n            d\n        <field_body>"
    options = [(x.kind, x.astext(), x.get("delimiter")) for x in T.parse("-f FILE, --file=FILE  read\n/V  dos\n").walk() if x.kind.startswith("option_s") or x.kind == "option_argument"]
    assert options == [("option_string", "-f", None), ("option_argument", "FILE", " "), ("option_string", "--file", None), ("option_argument", "FILE", "="), ("option_string", "/V", None)]
    assert tree("| a\n|   b\n| c\n") == "<line_block>\n    <line>\n        a\n    <line_block>\n        <line>\n            b\n    <line>\n        c"


def test_blocks():
    assert tree("a::\n\n  x\n   y\n\nb ::\n\n> q\n") == '<paragraph>\n    a:\n<literal_block xml:space="preserve">\n    x\n     y\n<paragraph>\n    b\n<literal_block xml:space="preserve">\n    > q'
    assert said("a::\n\nb\n") == [(2, 3, "Literal block expected; none found.")]
    assert kinds("x\n\n  q\n\n  -- me\n\n  r\n") == ["paragraph", "block_quote", "paragraph", "attribution", "block_quote", "paragraph"]
    assert tree(">>> 1\n1\n") == '<doctest_block xml:space="preserve">\n    >>> 1\n    1' and tree("..\n\n  q\n").startswith('<comment xml:space="preserve">\n<block_quote>')
    assert tree(".. note to self\n   more\n") == '<comment xml:space="preserve">\n    note to self\n    more'
    assert said("- " * 1 + "a\n  b\n c\n")[0][2].endswith("unexpected unindent.")
    assert said("+---+---+\n| a | b\n+---+---+\n")[0][2] == "Malformed table.\nRight border not aligned or missing."
    spans = "+---+---+\n| a | b |\n+===+===+\n| c     |\n+---+---+\n"
    assert [(x.get("morecols"), x.astext()) for x in T.parse(spans).walk() if x.kind == "entry"] == [(None, "a"), (None, "b"), (1, "c")]
    grid = "+---+---+\n| a | b |\n+===+===+\n| c | d |\n|   +---+\n|   | e |\n+---+---+\n"
    assert [(x.kind, x.get("morerows"), x.astext()) for x in T.parse(grid).walk() if x.kind == "entry"] == [("entry", None, "a"), ("entry", None, "b"), ("entry", 1, "c"), ("entry", None, "d"), ("entry", None, "e")]
    simple = "=== ===\n a   b\n--- ---\n c   d\n     e\n=== ===\n"
    assert [x.astext() for x in T.parse("=== ===\na   b\n=== ===\nc   d\n    e\n=== ===\n").walk() if x.kind == "entry"] == ["a", "b", "c", "d\ne"] and kinds(simple)[0] == "table"
    assert said("=== ===\na   b\n")[0][2] == "Malformed table.\nNo bottom table border found."


def test_explicit_markup():
    assert tree(".. _Here: http://x.org/\n   a\n.. _b: Here_\n__ http://y\n") == '<target ids="here" names="here" refuri="http://x.org/a">\n<target ids="b" names="b" refname="here">\n<target anonymous="1" ids="id1" refuri="http://y">'
    assert tree(".. [1] one\n.. [#n] auto\n.. [*] star\n.. [Cit] c\n").count("<label>") == 2
    assert said(".. _a: http://1\n\n.. _a: http://2\n") == [(2, 3, 'Duplicate explicit target name: "a".')] and said(".. _a: http://1\n\n.. _a: http://1\n") == []
    assert said("A\n=\n\n.. _a:\n\nx\n") == [(1, 4, 'Target name overrides implicit target name "a".')]
    assert tree(".. |s| replace:: *x* y\n.. |u| unicode:: U+41 0x42\n") == '<substitution_definition names="s">\n    <emphasis>\n        x\n     y\n<substitution_definition names="u">\n    AB'
    assert said(".. replace:: x\n")[0][2].startswith('Invalid context: the "replace" directive can only be used')
    assert said(".. odd:: x\n")[-1] == (3, 1, 'Unknown directive type "odd".') and said(".. [1]\n\nx\n")[0][2] == "Footnote content expected."


def test_inline_markup():
    assert tree("*a* **b** ``c\\`` d_ e__ [1]_ [#]_ [C]_ |s| `f g`_ :sub:`h` `i`\n") == "\n".join(["<paragraph>", "    <emphasis>", "        a", "     ", "    <strong>", "        b", "     ", "    <literal>", "        c\\", "     ", '    <reference name="d" refname="d">', "        d", "     ", '    <reference anonymous="1" name="e">', "        e", "     ", '    <footnote_reference ids="id1" refname="1">', "        1", "     ", '    <footnote_reference auto="1" ids="id2">', "     ", '    <citation_reference ids="id3" refname="c">', "        C", "     ", '    <substitution_reference refname="s">', "        s", "     ", '    <reference name="f g" refname="f g">', "        f g", "     ", "    <subscript>", "        h", "     ", "    <title_reference>", "        i"])
    assert said("*a\n") == [(2, 1, "Inline emphasis start-string without end-string.")] and said("'*' (`) a*b* 2 * x\n") == []
    assert tree("`a <http://b c>`_ `d <e_>`__\n") == '<paragraph>\n    <reference name="a" refuri="http://bc">\n        a\n    <target ids="a" names="a" refuri="http://bc">\n     \n    <reference name="d" refname="e">\n        d'
    assert [x.get("refuri") for x in T.parse("see http://a.b/c. or me@x.org, not foo:bar\n").walk() if x.kind == "reference"] == ["http://a.b/c", "mailto:me@x.org"]
    assert I.standalone("ftp://x/y_z) a@b.c") == ["ftp://x/y_z", "mailto:a@b.c"]
    assert [x[2] for x in said(":odd:`x` :raw:`y` :pep:`12345`\n")] == ['No role entry for "odd" in module "docutils.parsers.rst.languages.en".\nTrying "odd" as canonical role name.', 'Unknown interpreted text role "odd".', 'No format (Writer name) is associated with this role: "raw".\nThe "raw" role cannot be used directly.\nInstead, use the "role" directive to create a new role with an associated format.', 'PEP number must be a number from 0 to 9999; "12345" is invalid.']
    x = [n for n in T.parse(":doc:`T <a>` :py:func:`~m.f` :ref:`A  b`\n", wide=True).walk() if n.kind == "pending_xref"]
    assert [(n.get("refdomain"), n.get("reftype"), n.get("reftarget"), n.get("refexplicit"), n.astext()) for n in x] == [("std", "doc", "a", 1, "T"), ("py", "func", "m.f", 0, "f()"), ("std", "ref", "a b", 0, "A  b")]
    assert [n.get("refuri") for n in T.parse(":rfc:`822#s` :cve:`2020-1`\n", wide=True).walk() if n.kind == "reference"] == ["https://datatracker.ietf.org/doc/html/rfc822.html#s", "https://www.cve.org/CVERecord?id=CVE-2020-1"]


def test_directives():
    assert tree(".. note:: a\n   b\n\n   c\n") == "<note>\n    <paragraph>\n        a\n        b\n    <paragraph>\n        c"
    assert tree(".. admonition:: My *t*\n   :class: k\n\n   x\n").startswith('<admonition classes="k">\n    <title>\n        My \n        <emphasis>')
    assert tree(".. image:: a b.png\n   :width: 10 px\n   :target: x_\n   :alt: z\n") == '<reference name="x" refname="x">\n    <image alt="z" uri="ab.png" width="10px">'
    assert kinds(".. figure:: a\n\n   cap\n\n   leg\n") == ["figure", "image", "caption", "legend", "paragraph"]
    assert said(".. image::\n")[0][2] == 'Error in "image" directive:\n1 argument(s) required, 0 supplied.'
    assert said(".. image:: a\n   :odd: 1\n")[0][2] == 'Error in "image" directive:\nunknown option: "odd".'
    assert said(".. note::\n")[0][2] == 'Content block expected for the "note" directive; none found.'
    assert kinds(".. list-table:: T\n   :header-rows: 1\n\n   * - a\n     - b\n   * - c\n     - d\n")[:2] == ["table", "title"]
    cells = [x.astext() for x in T.parse('.. csv-table::\n   :header: h, "i"\n\n   1, "a\n   b"\n').walk() if x.kind == "entry"]
    assert cells == ["h", "i", "1", "a\nb"]
    assert tree(".. code-block:: py\n   :linenos:\n   :caption: C\n\n   x = 1\n", wide=True).startswith('<container classes="literal-block-wrapper" literal_block="1">')
    t = T.parse(".. toctree::\n   :maxdepth: 2\n\n   a\n   T <b>\n   http://x\n", wide=True).find(lambda x: x.kind == "toctree")
    assert t.get("entries") == [(None, "a"), ("T", "b"), (None, "http://x")] and t.get("includefiles") == ["a", "b"] and t.get("maxdepth") == 2
    assert [len(x.children[0].children) for x in T.parse(".. hlist::\n   :columns: 3\n\n" + "".join(f"   - {i}\n" for i in range(7)), wide=True).walk() if x.kind == "hlistcol"] == [3, 2, 2]
    assert D.index_entries("!a, b", "t") == [("single", "a", "t", "main", None), ("single", "b", "t", "", None)] and D.index_entries("double: a; b", "t") == [("pair", "a; b", "t", "", None)]
    assert tree(".. versionadded:: 2.1\n   more\n", wide=True) == '<versionmodified type="versionadded" version="2.1">\n    <paragraph translatable="0">\n        <inline classes="versionmodified added">\n            Added in version 2.1: \n        more'
    g = T.parse(".. glossary::\n\n   a\n   b\n     text\n", wide=True)
    assert [x.get("ids") for x in g.walk() if x.kind == "term"] == [["term-a"], ["term-b"]]
    assert tree(".. class:: k\n\n.. c\n\nx\n", wide=True) == '<comment xml:space="preserve">\n    c\n<paragraph classes="k">\n    x' and kinds(".. class:: k\n\nx\n") == ["pending", "paragraph"]
    assert kinds(".. class:: k\n\n   x\n") == ["paragraph"] and kinds(".. only:: html\n\n   x\n", wide=True) == ["only", "paragraph"] and kinds(".. raw:: html\n\n   <b>\n") == ["raw"]
    assert D.names_of_lines("1,3-5,-2,6-", 7) == [1, 3, 4, 5, 1, 2, 6, 7]
    with pytest.raises(D.Wrong):
        D.names_of_lines("5-3", 9)
    assert D.python_int(" +1_0 ") == 10 and D.measure("1.5 em") == "1.5em" and D.code_point("&#x41;") == "A"


PIECES = ["T\n=\n", "====\nO\n====\n", "- a\n", "  - b\n", "1. x\n", ":f: v\n", "-a  o\n", ">>> x\n", "|   l\n", "+--+--+\n", "|a |b |\n", "=== ===\n", "a   b\n", ".. note:: x\n   y\n", ".. _t: u\n", ".. [#a] f\n", ".. |s| image:: x\n", "*e* `r`_ |s| [1]_\n", "*bad `bad\n", "a::\n\n   l\n", "> q\n", "t\n  d\n", "\n", "\t\tx\n", "---\n", ".. list-table::\n\n   * - a\n", ".. csv-table::\n\n   1,2\n", ".. glossary::\n\n   t\n     d\n", ".. odd:: z\n", "é✓🎉\n"]


def test_any_text_has_a_tree():
    rng = random.Random(1)
    for k in range(1500):
        text = "".join(rng.choice(["", "", "  "]) + rng.choice(PIECES) for _ in range(rng.randint(0, 25)))
        root = T.parse(text, wide=k % 2 == 0)
        ids = [i for x in root.walk() for i in x.get("ids") or []]
        assert root.pformat() and len(ids) == len(set(ids)), text
    deep = T.parse("".join("  " * d + "- x\n" for d in range(400))).pformat()
    assert deep.count("Maximum nesting depth exceeded; deeper content skipped.") == 1


def test_rows_of_trees(spark):
    docs = spark.createDataFrame([("a", "T\n=\n\n*x* y\n\nU\n-\n\nz\n\n.. note:: n\n"), ("b", None), ("c", ""), ("d", "p\n\nq\n")], "docname string, content string")
    rows = T.trees(docs, wide=False)
    assert {r.doc: r.dump for r in T.dumps(rows).collect()} == {d: T.parse(t, d).pformat() for d, t in (("a", docs.first().content), ("c", ""), ("d", "p\n\nq\n"))}
    root = T.parse(docs.first().content)
    assert sorted(r.text for r in T.texts(rows.where("doc = 'a'"), "paragraph").collect()) == sorted(x.astext() for x in root.walk() if x.kind == "paragraph")
    assert [r.text for r in T.texts(rows, "document").where("doc = 'c'").collect()] == [""]


def test_records_of_projects(spark):
    from docframe.functions import markup as M

    docs = spark.createDataFrame([("a", "rst", "T\n=\n\n.. |x| replace:: y\n.. |x| replace:: z\n\n:doc:`b`\n"), ("b", "md", "# M"), ("c", "rst", "no title")], "docname string, format string, content string")
    rows = M.parse(docs)
    assert {r.docname: r.title for r in M.titles(docs, rows).collect()} == {"a": "T", "b": "Untitled", "c": "Untitled"}
    assert {(r.kind, r.name): r.n for r in M.statistics(rows).collect()} == {("role", "doc"): 1}
    assert {(r.doc, r.name): r.n for r in T.substitution_counts(T.trees(docs)).collect()} == {("a", "x"): 2}


def test_ids():
    assert [N.make_id(x) for x in ("ƀx", "þing", "Straße", "Über 2 Œuvres", "123", "a--b", "日本", "ȸ")] == ["bx", "ing", "strasze", "uber-2-oeuvres", "", "a-b", "", "db"]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], [*values]).select(column.alias("x")).first().x


def test_text_functions(spark):
    c = F.col("t")
    assert one(spark, X.words(c), t="a\u00a0b\u2003c  d") == ["a", "b", "c", "d"] and one(spark, X.normal_name(c), t=" A\u00a0 b ") == "a b"
    assert one(spark, X.clean_word(c), t="हिन्दी!") == "हिनदी" and one(spark, X.clean_words(c), t=" A-b *** c_d\u2003É! ") == ["a-b", "", "c_d", "é"] and one(spark, X.clean_words(c), t=" \n") == []
    assert one(spark, X.make_id(c), t="Über Straße") == "uber-strasze" and one(spark, X.escape_marks(c), t="a\\*b\\ c\\") == "a\0*b\0 c\0" and one(spark, X.unescape_marks(c), t="a\0*b\0 c") == "a*bc"
    assert [one(spark, X.without_colons(c), t=t) for t in ("a::", "a ::", "::", "a:")] == ["a:", "a", None, "a:"]
    assert one(spark, X.display_width(c), t="a日e\u0301") == 4 and one(spark, X.quoted(c), t="it's\n") == '"it\'s\\n"' and [one(spark, X.code_point(c), t=t) for t in ("65", "0x41", "U+41", "99999999999")] == ["A", "A", "A", None]
    assert [one(spark, X.whole_number(c), t=t) for t in (" -1_000 ", "1__0", "x", "9" * 30)] == [-1000, None, None, 10**30 - 1] and [one(spark, X.measure(c), t=t) for t in ("1.5 em", "3", "x", "2 furlongs")] == ["1.5em", "3", None, None]
    assert one(spark, X.class_list(c), t="A b-1 Ü") is None and one(spark, X.class_list(c), t="A b-1") == ["a", "b-1"] and one(spark, X.simple_name(c), t="a.b-c") is True and one(spark, X.simple_name(c), t="a..b") is False
    assert [one(spark, X.enumerator_kind(c), t=t) for t in ("i", "I", "v", "ii", "12", "ab")] == ["lowerroman", "upperroman", "loweralpha", "lowerroman", "arabic", None]
    assert one(spark, X.uris(c), t="see http://a.b/c.") == ["http://a.b/c"] and one(spark, X.date_text(F.lit("2024-02-03 04:05:06").cast("timestamp"), "%Y/%m %H%"), t="") == "2024/02 04%"
    assert one(spark, F.struct(*[x.alias(n) for n, x in zip("ab", X.option_target(c))]), t="<x>").asDict() == {"a": None, "b": "<x>"}
    assert [one(spark, X.duration(F.lit(s)), t="") for s in (0.25, 1.5)] == ["250ms", "1.500s"]


def test_html_of_directives(spark):
    rows = [("note", [], {}, "<b>"), ("seealso", ["T"], {}, "x"), ("admonition", [], {}, "x"), ("code-block", ["py"], {"caption": "C"}, "a<b"), ("literalinclude", ["x/y.rs"], {}, ""), ("literalinclude", [], {}, ""), ("highlight", [], {}, ""), ("image", ["a", "b"], {}, ""), ("zzz", [], {}, "")]
    df = spark.createDataFrame(rows, "n string, a array<string>, o map<string,string>, c string")
    got = [r.h for r in df.select(H.directive(F.col("n"), F.col("a"), F.col("o"), F.col("c")).alias("h")).collect()]
    assert got == ['<div class="admonition note"><p class="admonition-title">Note</p><b></div>', '<div class="admonition seealso"><p class="admonition-title">T</p>x</div>', '<div class="admonition admonition-generic"><p class="admonition-title">Admonition</p>x</div>', '<div class="code-block-caption">C</div><div class="highlight-py"><pre><code class="language-py">a&lt;b</code></pre></div>', '<div class="literal-include"><div class="highlight-rust"><pre><code class="language-rust"><!-- Content of x/y.rs would be included here --></code></pre></div></div>', None, "<!-- highlight language set to text -->", "<!-- image directive: a b -->", "<!-- Unknown directive: zzz -->"]
    assert len(H.NAMES) == 42 and one(spark, H.path_to(F.col("t")), t="a/b") == "a/b.html" and one(spark, H.style_tag(F.col("t")), t="x.css") == '<link rel="stylesheet" href="x.css" type="text/css" />'
    assert one(spark, H.parse_line(F.col("t")), t=".. image:: a  b").asDict() == {"name": "image", "arguments": ["a", "b"]} and one(spark, H.parse_line(F.col("t")), t="x") is None


def test_templates(spark):
    t = "{{ a.b | upper }}{% if n and not m %}yes{% elif x == 'y' %}y{% else %}no{% endif %}{% for i in xs %}<{{ i }}>{% endfor %}{{ lost }}{{ d }}"
    assert E.render(E.parsed(t), {"a": {"b": "q"}, "n": 1, "xs": [1, "<"], "d": {"k": [True, 1.5, "s"]}}) == "Qyes<1><<>{k: [true, 1.5, s]}"
    assert E.render(E.parsed("{{ has_tag(tags, 'x') }} {{ s | e }} {{ s | striptags }}{# c #}"), {"tags": ["x"], "s": "<b>&"}) == "true &lt;b&gt;&amp; &"
    for bad in ("{% if x %}", "{{ x | odd }}", "{% endif %}", "{{ odd(x) }}"):
        with pytest.raises(ValueError):
            E.render(E.parsed(bad), {"x": 1})
    df = spark.createDataFrame([('{"x": 1}',), (None,)], "c string")
    assert [r.y for r in df.select(E.rendered("v={{ x }}", F.col("c")).alias("y")).collect()] == ["v=1", None]
    assert len(E.global_context({"project": "p"})) >= 28
