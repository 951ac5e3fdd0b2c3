"""What a finished build writes besides pages: dumps, indices, copies; and the guards before it."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions import templates as E
from docframe.operators import inventory as V

IMAGES = ["png", "jpg", "jpeg", "gif", "svg", "webp", "bmp"]


def empty_search() -> dict:
    """The search dump of a project without an index."""
    return {"docnames": [], "filenames": [], "titles": [], "terms": {}, "objects": {}, "objnames": {}, "objtypes": {}}


def build_info(config: dict, version: str) -> dict:
    """What a build says of itself."""
    keys = {"version": "", "release": "", "project": "", "copyright": "", "language": "en"}
    inner = {"extensions": [], "templates_path": [], "source_suffix": ".rst", "master_doc": config.get("root_doc") or "index", **{k: config.get(k) or d for k, d in keys.items()}}
    return {"config": inner, "tags": [], "version": version}


def pages(docs: DataFrame, config: dict, template: str | None = None) -> DataFrame:
    """(path, html) of documents (docname, title, content) in the page's template."""
    shared = E.global_context(config)
    own = F.struct(F.col("docname").alias("pagename"), "title", F.col("content").alias("body"))
    context = F.to_json(own)
    both = F.concat(F.lit(json.dumps(shared)[:-1] + ", "), F.substring(context, 2, 1 << 30))
    return docs.select(F.concat("docname", F.lit(".html")).alias("path"), E.rendered(template or E.BUILTIN["page.html"], both).alias("html"))


def sources(docs: DataFrame, suffix: str = ".txt") -> DataFrame:
    """(path, content): copies of sources beside the pages."""
    return docs.select(F.concat(F.lit("_sources/"), "docname", F.lit(".rst"), F.lit(suffix)).alias("path"), "content")


def general_index(entries: DataFrame, text: str = "entry") -> DataFrame:
    """(letter, entries): index entries by first letter, in order."""
    rows = V.index_entries(entries, text)
    return rows.groupBy("letter").agg(F.array_sort(F.collect_set(F.struct("entry", "subentry"))).alias("entries"))


def index_page(groups: DataFrame) -> str:
    """The general index as a page: as many groups as there are letters."""
    rows = [{"letter": r.letter, "entries": [x.asDict() for x in r.entries]} for r in groups.orderBy("letter").toLocalIterator()]
    return E.render(E.parsed(E.BUILTIN["genindex.html"]), {"groups": rows})


def missing_files(references: DataFrame, files: DataFrame) -> DataFrame:
    """references (docname, path, line) to images and downloads that no file (path) answers."""
    return references.join(files.select("path").distinct(), "path", "left_anti")


def copied(folders: list[str], to: str) -> list[str]:
    """Copies what is in folders; the names of folders that aren't there."""
    lost = []
    for folder in folders:
        if os.path.isdir(folder):
            shutil.copytree(folder, to, dirs_exist_ok=True)
        else:
            lost.append(folder)
    return lost


def folder_size(folder: str) -> int:
    """Bytes of all files in a folder on the driver's disk; 0 where there is none."""
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def sizes(files: DataFrame) -> DataFrame:
    """(folder, bytes) of scanned files (path, size), for each folder with all below it."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return files.select(F.explode(folders).alias("folder"), "size").groupBy("folder").agg(F.sum("size").alias("bytes"))


def overlap(source: str, output: str) -> str | None:
    """Why an output folder can't be used with a source folder, or None."""
    a, b = os.path.realpath(source), os.path.realpath(output)
    if not os.path.isdir(a) or not os.path.isdir(b):
        return None
    if a == b:
        return f"'{b}' is same as source directory!"
    return f"'{b}' directory contains source directory!" if os.path.commonpath([a, b]) == b else None


def cleaned(source: str, *folders: str) -> None:
    """Empties output and cache folders, which stay; one that holds the source raises."""
    for folder in folders:
        if why := overlap(source, folder):
            raise ValueError(why)
        for x in os.listdir(folder) if os.path.isdir(folder) else ():
            path = os.path.join(folder, x)
            shutil.rmtree(path) if os.path.isdir(path) and not os.path.islink(path) else os.remove(path)


def jobs(text: str) -> int:
    """The number of parallel jobs of 'auto' or a number."""
    if text == "auto":
        return os.cpu_count() or 1
    if not text.isdecimal():
        raise ValueError(f"expected a number or 'auto', got '{text}'")
    return int(text)


def by_folders(arguments: list[str]) -> bool:
    """Whether a command line gives source and output folders instead of a command."""
    if not arguments or arguments[0] in ("build", "clean", "stats", "help", "-h", "--help", "-V", "--version"):
        return False
    if not arguments[0].startswith("-") or arguments[0] not in ("-v", "--verbose", "-c", "--config"):
        return True
    return not any(x in ("build", "clean", "stats") for x in arguments)


#: Extensions that are known, and the settings that some begin with.
EXTENSIONS: dict[str, dict] = {
    "autodoc": {"autodoc_default_options": {"members": True, "undoc-members": True, "show-inheritance": True}, "autodoc_member_order": "alphabetical", "autodoc_typehints": "description"},
    "autosummary": {"autosummary_generate": True, "autosummary_imported_members": False}, "doctest": {}, "intersphinx": {"intersphinx_mapping": {}, "intersphinx_timeout": 5}, "todo": {"todo_include_todos": True, "todo_emit_warnings": False},
    "coverage": {}, "imgmath": {"imgmath_image_format": "png", "imgmath_use_preview": False, "imgmath_add_tooltips": True, "imgmath_font_size": 12}, "mathjax": {"mathjax_config": {}}, "ifconfig": {}, "viewcode": {"viewcode_import": False, "viewcode_enable_epub": False},
    "githubpages": {}, "napoleon": {"napoleon_google_docstring": True, "napoleon_numpy_docstring": True, "napoleon_use_ivar": False, "napoleon_use_param": True, "napoleon_use_rtype": True, "napoleon_use_keyword": True, "napoleon_custom_sections": []},
    "extlinks": {}, "linkcode": {}, "graphviz": {}, "inheritance_diagram": {},
}


def extension_settings(names: list[str]) -> tuple[dict, list[str]]:
    """The first settings of extensions, by the last part of their names, and those that aren't known."""
    out: dict = {}
    lost = []
    for n in names:
        short = n.rpartition(".")[2]
        if short in EXTENSIONS:
            out |= EXTENSIONS[short]
        else:
            lost.append(n)
    return out, lost

#: What is written when a build is finished, in this order.
FINISH = ("indices", "static", "inventory", "search", "info")


def finish(parts: dict[str, object]) -> list[str]:
    """Calls what is there of FINISH, in order; the names of what was done."""
    done = []
    for name in FINISH:
        if name in parts:
            parts[name]()
            done.append(name)
    return done
