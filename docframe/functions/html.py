"""HTML of single directives, by name, and the small tags that templates use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docframe.functions.text import escape_text

ADMONITIONS = {k: k.capitalize() for k in ("note", "warning", "important", "tip", "caution", "danger", "error", "hint", "attention")} | {"seealso": "See also"}
LANGUAGES = {
    "py": "python", "rs": "rust", "js": "javascript", "ts": "typescript", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "c", "h": "cpp", "hpp": "cpp", "java": "java", "go": "go", "php": "php", "rb": "ruby",
    "sh": "bash", "bash": "bash", "ps1": "powershell", "sql": "sql", "xml": "xml", "html": "html", "css": "css", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "ini": "ini", "md": "markdown", "rst": "rst", "tex": "latex",
}
#: Directives that leave only a comment.
COMMENTED = ["toctree", "index", "only", "ifconfig", "image", "figure", "table", "csv-table", "list-table", "include", "raw", "math", "autodoc", "automodule", "autoclass", "autofunction", "meta", "sidebar", "topic", "rubric", "epigraph", "highlights", "pull-quote", "compound", "container", "versionadded", "versionchanged", "deprecated"]
NAMES = [*ADMONITIONS, "admonition", "code-block", "literalinclude", "highlight", *COMMENTED]


def language_of(filename: Column) -> Column:
    """The language of a file by its suffix; 'text' for an unknown one or none."""
    name = F.element_at(F.split(filename, "/"), -1)
    end = F.when(name.rlike(r"^.+\.[^.]*$"), F.element_at(F.split(name, r"\."), -1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p]), end), F.lit("text"))


def directive(name: Column, arguments: Column, options: Column, content: Column, custom: dict[str, Column] | None = None) -> Column:
    """The HTML of a directive (arguments an array, options a map, content a text); `custom` names
    columns for others, or over these. Null for a directive that lacks the argument it needs."""
    first = F.get(arguments, 0)
    option = lambda k: F.element_at(options, F.lit(k))
    out = None

    def add(test: Column, value: Column) -> None:
        nonlocal out
        out = F.when(test, value) if out is None else out.when(test, value)

    for k, v in (custom or {}).items():
        add(name == k, v)
    titles = F.create_map(*[F.lit(x) for p in ADMONITIONS.items() for x in p])
    add(name.isin(*ADMONITIONS), F.concat(F.lit('<div class="admonition '), name, F.lit('"><p class="admonition-title">'), F.coalesce(first, F.element_at(titles, name)), F.lit("</p>"), content, F.lit("</div>")))
    add(name == "admonition", F.concat(F.lit('<div class="admonition admonition-generic"><p class="admonition-title">'), F.coalesce(first, F.lit("Admonition")), F.lit("</p>"), content, F.lit("</div>")))
    language = F.coalesce(first, F.lit("text"))
    caption = F.coalesce(F.concat(F.lit('<div class="code-block-caption">'), option("caption"), F.lit("</div>")), F.lit(""))
    add(name == "code-block", F.concat(caption, F.lit('<div class="highlight-'), language, F.lit('"><pre><code class="language-'), language, F.lit('">'), escape_text(content), F.lit("</code></pre></div>")))
    kind = F.coalesce(option("language"), language_of(first))
    add(name == "literalinclude", F.concat(F.lit('<div class="literal-include"><div class="highlight-'), kind, F.lit('"><pre><code class="language-'), kind, F.lit('"><!-- Content of '), first, F.lit(" would be included here --></code></pre></div></div>")))
    add(name == "highlight", F.concat(F.lit("<!-- highlight language set to "), language, F.lit(" -->")))
    add(name.isin(COMMENTED), F.concat(F.lit("<!-- "), name, F.lit(" directive: "), F.array_join(arguments, " "), F.lit(" -->")))
    return out.otherwise(F.concat(F.lit("<!-- Unknown directive: "), name, F.lit(" -->")))


def path_to(target: Column, resource: bool = False) -> Column:
    """The address of a page or of a static file, as templates use it."""
    return F.concat(F.lit("_static/"), target) if resource else F.when(target.startswith("http"), target).otherwise(F.concat(target, F.lit(".html")))


def style_tag(href: Column) -> Column:
    return F.concat(F.lit('<link rel="stylesheet" href="'), href, F.lit('" type="text/css" />'))


def script_tag(src: Column) -> Column:
    return F.concat(F.lit('<script src="'), src, F.lit('"></script>'))


def parse_line(line: Column) -> Column:
    """(name, arguments) of a line '.. name:: arguments'; null for other lines."""
    form = r"^\s*\.\. ([A-Za-z][\w:-]*)::\s*(.*)$"
    args = F.filter(F.split(F.regexp_extract(line, form, 2), r"\s+"), lambda x: x != "")
    return F.when(line.rlike(form), F.struct(F.regexp_extract(line, form, 1).alias("name"), args.alias("arguments")))
