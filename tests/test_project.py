"""Whole projects, files and streams."""

import datetime

from docframe import api
from docframe.sources import config as G
from docframe.sources import files as I
from docframe.streaming import incremental as N


def write(folder, files):
    for name, text in files.items():
        p = folder / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


def said(build):
    return sorted((r.source, r.text) for r in build.diagnostics.collect())


def test_a_project_without_faults(spark, tmp_path):
    write(tmp_path, {"conf.py": "project = 'p'\n", "index.rst": "Home\n====\n\n.. toctree::\n\n   sub/page\n   Title <other>\n", "sub/page.rst": "Page\n====\n\n:doc:`sibling` and :ref:`here`\n\n.. toctree::\n\n   sibling\n", "sub/sibling.rst": "S\n=\n", "other.md": "# Other\n\n.. _x:\n", "_build/old.rst": "x"})
    b = api.build(spark, str(tmp_path), str(tmp_path / "out"))
    assert said(b) == [] and b.exit_code() == 0
    assert sorted(r.path for r in spark.read.parquet(str(tmp_path / "out/pages")).collect()) == ["index.html", "other.html", "sub/page.html", "sub/sibling.html"]
    s = api.stats(spark, str(tmp_path)).first()
    assert s.cross_refs == 3 and s.max_depth == 1


def test_a_project_with_faults(spark, tmp_path):
    write(tmp_path, {"conf.py": "import os\nnitpicky = True\n", "index.rst": "Home\n====\n\n.. toctree::\n   :glob:\n   :odd: 1\n\n   nope\n   dead*\n   a*\n\n.. note::\n\n:ref:`lost` and :ref:`home` and :py:mod:`os`\n", "a1.rst": "x\n", "lost.rst": "y\n", "bad.rst": b"\xff\xfe"})
    b = api.build(spark, str(tmp_path))
    assert said(b) == sorted([
        ("config", "conf.py:1: WARNING: Import"), ("toctree", "index.rst:8: WARNING: toctree contains reference to nonexisting document 'nope'"), ("toctree", "index.rst:9: WARNING: toctree glob pattern 'dead*' didn't match any documents"), ("orphan", "lost.rst: WARNING: document isn't included in any toctree"),
        ("directive", "index.rst:4: WARNING: toctree: unknown option"), ("directive", "index.rst:12: WARNING: note: no content"), ("reference", "index.rst:14: WARNING: cross-reference target not found: 'lost'"), ("read", "bad.rst: ERROR: isn't UTF-8"),
    ])
    assert b.exit_code() == 1


def test_overrides():
    c, w = G.override(G.DEFAULTS, ["nitpicky=1", "parallel_jobs=4", "exclude_patterns=a,b", "language=de", "html_theme=x=y", "output=1", "odd=1", "parallel_jobs=x"])
    assert c["nitpicky"] is True and c["parallel_jobs"] == 4 and c["theme"]["name"] == "x=y" and c["exclude_patterns"] == ["a", "b"] and c["language"] == "de" and c["output"]["html_theme"] == "x=y"
    assert w == ["output is a dictionary", "unknown key odd", "parallel_jobs is a number"] and G.DEFAULTS["output"]["html_theme"] == "default"
    values, dropped = G.python_literals("a = [1,\n  2]\nb = 'x' 'y'\nimport os\nc = os.name\n'doc'\nd = (1)\ne = (1,)\n")
    assert values == {"a": [1, 2], "b": "xy", "d": 1, "e": (1,)} and dropped == [(4, "Import"), (5, "value of c is no literal")]


def test_cells_and_markdown(spark):
    df = spark.createDataFrame([(1, 'a, "b\nc"\n"d""e",'), (2, None), (3, "")], "id int, t string")
    assert sorted(tuple(r) for r in I.csv_cells(df, "id", "t").collect()) == [(1, 0, 0, "a"), (1, 0, 1, "b\nc"), (1, 1, 0, 'd"e'), (1, 1, 1, "")]
    md = spark.createDataFrame([("d", "---\nx: 1\n---\n# Title\n\nSome *bold* [link](u)\n\n```\ncode\n```\n- item\n"), ("n", None)], "docname string, content string")
    assert [r.text for r in I.markdown_paragraphs(md).orderBy("ord").collect()] == ["Title", "Some bold link", "item"]


def test_a_stream_keeps_the_index(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    schema = "docname string, content string, mtime timestamp"
    source, index, check = (str(tmp_path / x) for x in ("in", "index", "check"))
    for rows in ([("a", "cats run", t), ("b", "dogs", t)], [("a", "mice", t), ("b", None, t)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        N.keep_index(N.arrivals(spark, source), index, check).awaitTermination()
    assert sorted((r.docname, r.term) for r in N.current(spark, index).collect()) == [("a", "mice")]
