"""reStructuredText to flat records, one document at a time: what is sequential in
a document is Python over Arrow batches, and nothing crosses documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.functions.batches import rows_of
from docframe.session import spread

RECORD = "doc string, ord long, kind string, name string, line long, level long, arguments array<string>, options map<string,string>, content string, target string, display string"
_DIRECTIVE = re.compile(r"^(\s*)\.\.\s+([A-Za-z][\w:+.-]*?)\s?::(?:\s+(.*))?$")
_LABEL = re.compile(r"^\.\.\s+_(?:`([^`]+)`|((?:\\:|[^:\\])+)):\s*(.*)$")
_OPTION = re.compile(r"^:([^:\s][^:]*):(?:\s+(.*))?$")
_ROLE = re.compile(r":([A-Za-z][\w.+-]*(?::[A-Za-z][\w.+-]*)*):`((?:\\.|[^`\\])+)`")
_ADORNMENT = re.compile(r"^([!-/:-@\[-`{-~])\1*$")
_TITLED = re.compile(r"^(.*\S)\s*<([^<>]*)>$", re.S)
_ADMONITIONS = {"attention", "caution", "danger", "error", "hint", "important", "note", "tip", "warning", "seealso"}


def _lines(text: str) -> list[str]:
    return [x.expandtabs(8).rstrip() for x in re.sub("[\v\f]", " ", text).splitlines()]


def _split(s: str) -> tuple[str | None, str]:
    m = _TITLED.match(s.strip())
    return (m.group(1).strip(), m.group(2).strip()) if m else (None, s.strip())


def records(text: str) -> list[dict]:
    """Sections, labels, directives, toctree entries and roles of a text, in order of
    line. Any text has an answer."""
    lines = _lines(text)
    out: list[dict] = []
    styles: list[tuple[str, bool]] = []

    def add(kind: str, line: int, name: str | None = None, **more: object) -> None:
        out.append({"kind": kind, "name": name, "line": line + 1, **more})

    def roles(row: int, s: str, at: int | None = None) -> None:
        s = re.sub(r"``.*?``", lambda m: " " * len(m.group()), s)
        for m in _ROLE.finditer(s):
            shown, target = _split(m.group(2))
            add("role", row if at is None else at, m.group(1).split(":")[-1].lower(), target=target, display=shown)

    def block(i: int, indent: int) -> int:
        """The end of the indented block that begins at line i."""
        while i < len(lines) and (not lines[i] or len(lines[i]) - len(lines[i].lstrip()) > indent):
            i += 1
        return i

    i = 0
    while i < len(lines):
        s = lines[i]
        m = _DIRECTIVE.match(s)
        if m:
            indent, name = len(m.group(1)), m.group(2)
            end = block(i + 1, indent)
            body = lines[i + 1 : end]
            marker = (m.group(3) or "").strip()
            options: dict[str, str] = {}
            k = 0
            while k < len(body) and body[k] and (o := _OPTION.match(body[k].strip())):
                options[o.group(1)] = (o.group(2) or "").strip()
                k += 1
            rest = body[k:]
            depth = min((len(x) - len(x.lstrip()) for x in rest if x), default=0)
            content = "\n".join(x[depth:] for x in rest).strip("\n")
            if name in _ADMONITIONS and marker:
                content, marker = f"{marker}\n{content}".strip("\n"), ""
            add("directive", i, name, arguments=marker.split(), options=options, content=content)
            if name == "toctree":
                for j, x in enumerate(rest):
                    if x.strip():
                        shown, target = _split(x)
                        add("toctree", i + 1 + k + j, None, target=target, display=shown, options=options)
                i = end
                continue
            if name in {"code-block", "code", "sourcecode", "math", "raw", "literalinclude", "parsed-literal", "highlight"}:
                i = end
                continue
            roles(i, marker)
            i += 1 + k
            continue
        m = _LABEL.match(s)
        if m:
            add("label", i, (m.group(1) or m.group(2)).replace("\\:", ":").strip(), target=m.group(3) or None)
            i += 1
            continue
        if s.startswith("..") and (len(s) == 2 or s[2] == " "):
            i = block(i + 1, 0)
            continue
        over = _ADORNMENT.match(s) and len(s) >= 4 and i + 2 < len(lines) and lines[i + 1].strip() and lines[i + 2] == s
        under = s and not s[0].isspace() and not _ADORNMENT.match(s) and i + 1 < len(lines) and _ADORNMENT.match(lines[i + 1]) and (len(lines[i + 1]) >= len(s) or len(lines[i + 1]) >= 4) and (i == 0 or not lines[i - 1] or _ADORNMENT.match(lines[i - 1]) or _LABEL.match(lines[i - 1]))
        if over or under:
            style = (s[0], True) if over else (lines[i + 1][0], False)
            title = lines[i + 1].strip() if over else s
            if style not in styles:
                styles.append(style)
            add("section", i + bool(over), title, level=styles.index(style) + 1)
            roles(i + bool(over), title)
            i += 3 if over else 2
            continue
        if s.endswith("::") and not s.startswith(".."):
            roles(i, s)
            j = i + 1
            while j < len(lines) and not lines[j]:
                j += 1
            i = block(j, len(s) - len(s.lstrip())) if j < len(lines) and len(lines[j]) - len(lines[j].lstrip()) > len(s) - len(s.lstrip()) else i + 1
            continue
        if s:
            # a paragraph: a role may go over its lines, and counts at the first
            j = i
            while j < len(lines) and lines[j] and not _DIRECTIVE.match(lines[j]) and not (j > i and j + 1 < len(lines) and _ADORNMENT.match(lines[j + 1]) and len(lines[j + 1]) >= 4):
                j += 1
                if lines[j - 1].endswith("::"):
                    j -= j - 1 > i
                    break
            j = max(j, i + 1)
            roles(i, "\n".join(lines[i:j]))
            i = j
            continue
        i += 1
    return out


def _rows(doc: str | None, source: str | None) -> Iterator[dict]:
    for k, r in enumerate(records(source or "")):
        yield {"doc": doc, "ord": k, **r, "options": list(r["options"].items()) if "options" in r else None}


def parse(docs: DataFrame, key: str = "docname", text: str = "content") -> DataFrame:
    """RECORD rows of each document; kinds are section, label, directive, toctree and
    role. Null and empty texts have none."""
    schema = T._parse_datatype_string(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from rows_of(batches, _rows, to_arrow_schema(schema))

    return spread(docs.select(F.col(key).cast("string"), F.col(text))).mapInArrow(run, schema)


def statistics(rows: DataFrame) -> DataFrame:
    """(kind, name, n) of records: directives, roles and toctree entries by name."""
    return rows.where("kind IN ('directive', 'role', 'toctree')").groupBy("kind", F.coalesce("name", F.lit("-")).alias("name")).agg(F.count("*").alias("n"))


def titles(docs: DataFrame, rows: DataFrame, untitled: str = "Untitled") -> DataFrame:
    """docs (docname, format, …) with title: the first section's of markup; other formats have none of their own."""
    first = rows.where("kind = 'section'").groupBy(F.col("doc").alias("docname")).agg(F.min_by("name", "ord").alias("_title"))
    own = F.when(F.col("format") == "rst", F.col("_title"))
    return docs.join(first, "docname", "left").withColumn("title", F.coalesce(own, F.lit(untitled))).drop("_title")
