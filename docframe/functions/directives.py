"""Directives of the markup: their arguments, options and contents, and the nodes they become."""

from __future__ import annotations

import csv
import datetime
import re
from collections.abc import Callable

from docframe.functions.inlines import escaped, unescaped
from docframe.functions.nodes import ERROR, INFO, WARNING, Node, Text, make_id, normal_name, preserved, whole_name
from docframe.functions.tables import finish

_FIELD = re.compile(r":(?![: ])([^:\\]|\\.|:(?!([ `]|$)))*(?<! ):( +|$)")
UNITS = ("em", "ex", "ch", "rem", "vw", "vh", "vmin", "vmax", "cm", "mm", "Q", "in", "pc", "pt", "px")


class Wrong(ValueError):
    """What is wrong in a directive, for its message."""


# option values


def flag(x: str | None) -> None:
    if x and x.strip():
        raise Wrong(f'no argument is allowed; "{x}" supplied')


def unchanged(x: str | None) -> str:
    return x or ""


def unchanged_required(x: str | None) -> str:
    if x is None:
        raise Wrong("argument required but none supplied")
    return x


def classes(x: str | None) -> list[str]:
    if x is None:
        raise Wrong("argument required but none supplied")
    out = [make_id(n) for n in x.split()]
    if "" in out:
        raise Wrong(f'cannot make "{x.split()[out.index("")]}" into a class name')
    return out


def python_int(x: str) -> int:
    """An integer as Python reads it: sign, underscores between digits, any script's digits."""
    s = x.strip()
    if not re.fullmatch(r"[-+]?\d+(?:_\d+)*", s):
        raise Wrong(f"invalid literal for int() with base 10: {py_repr(x)}")
    return int(s)


def natural(x: str | None) -> int:
    if x is None:
        raise Wrong("argument required but none supplied")
    n = python_int(x)
    if n < 0:
        raise Wrong("negative value; must be positive or zero")
    return n


def positive(x: str | None) -> int:
    n = natural(x)
    if n < 1:
        raise Wrong("negative or zero value; must be positive")
    return n


def percentage(x: str | None) -> int:
    return natural(x.rstrip(" %") if x else x)


def measure(x: str | None, units: tuple[str, ...] = (*UNITS, "%", "")) -> str:
    """A number with a unit, without the blank between."""
    m = re.fullmatch(r"\s*([0-9.]+) *(" + "|".join(u for u in units if u) + r")?\s*", x or "")
    if not m or not re.fullmatch(r"\d+\.?\d*|\.\d+", m.group(1)) or m.group(2) is None and "" not in units:
        raise Wrong("not a positive number or measure of one of the following units:\n" + ", ".join(u for u in units if u))
    return m.group(1) + (m.group(2) or "")


def choice(*values: str) -> Callable:
    def one(x: str | None) -> str:
        s = (x or "").lower().strip()
        if s not in values:
            shown = ", ".join(f'"{v}"' for v in values[:-1]) + f', or "{values[-1]}"'
            raise Wrong(f'"{x}" unknown; choose from {shown}' if x else f"must supply an argument; choose from {shown}")
        return s

    return one


def uri(x: str | None) -> str:
    if x is None:
        raise Wrong("argument required but none supplied")
    return " ".join("".join(unescaped(p).split()) for p in re.split("\0[ \n]", escaped(x)))


def py_repr(x: str) -> str:
    """A string as Python writes it."""
    return repr(x)


def code_point(x: str) -> str:
    """The text of '0x41', 'U+41', '&#x41;', '65'; any other is itself."""
    s = x.strip()
    try:
        if s.isdigit():
            return chr(int(s))
        m = re.fullmatch(r"(?:0x|x|\\x|U\+?|u|\\u)([0-9a-fA-F]+)|&#x([0-9a-fA-F]+);", s)
        return chr(int(m.group(1) or m.group(2), 16)) if m else s
    except (ValueError, OverflowError) as e:
        raise Wrong(f"Invalid character code: {x}\nValueError: {e}") from None


def names_of_lines(spec: str, total: int) -> list[int]:
    """Lines of '1,3-5,-4,4-', from 1; a part that is no range or runs backwards raises."""
    out: list[int] = []
    for part in spec.split(","):
        a, dash, b = part.strip().partition("-")
        if not part.strip() or not re.fullmatch(r"\d*-?\d*", part.strip()) or part.strip() == "-":
            raise Wrong(f"invalid line number spec: {py_repr(spec)}")
        lo, hi = int(a or 1), int(b or total) if dash else int(a)
        if lo > hi:
            raise Wrong(f"invalid line number spec: {py_repr(spec)}")
        out += [x for x in range(lo, hi + 1) if x <= total]
    return out


COMMON = {"class": classes, "name": unchanged}
ALIGN = choice("top", "middle", "bottom", "left", "center", "right")
IMAGE = {**COMMON, "alt": unchanged, "height": lambda x: measure(x, (*UNITS, "")), "width": measure, "scale": percentage, "align": ALIGN, "target": unchanged_required, "loading": choice("embed", "link", "lazy")}
FIGURE = {**IMAGE, "figwidth": lambda x: "image" if (x or "").lower() == "image" else measure(x), "figclass": classes, "figname": unchanged, "align": choice("left", "center", "right")}
CODE = {**COMMON, "number-lines": unchanged}
BLOCK = {**COMMON, "force": flag, "linenos": flag, "dedent": lambda x: natural(x) if x else None, "lineno-start": python_int, "emphasize-lines": unchanged_required, "caption": unchanged_required}
TABLE = {**COMMON, "align": choice("left", "center", "right"), "width": measure, "widths": lambda x: x if (x or "").strip() in ("auto", "grid") else [positive(y) for y in re.split(r"[,\s]+", (x or "").strip()) if y]}
CSV = {**TABLE, "header-rows": natural, "stub-columns": natural, "header": unchanged, "file": unchanged, "url": uri, "encoding": unchanged, "delim": unchanged_required, "keepspace": flag, "quote": unchanged_required, "escape": unchanged_required}
LIST = {**TABLE, "header-rows": natural, "stub-columns": natural}
TOC = {"maxdepth": python_int, "name": unchanged, "class": classes, "caption": unchanged_required, "glob": flag, "hidden": flag, "includehidden": flag, "numbered": lambda x: python_int(x) if x else 999, "titlesonly": flag, "reversed": flag}
ADMONITIONS = ("attention", "caution", "danger", "error", "hint", "important", "note", "tip", "warning")
VERSIONS = {"versionadded": "Added in version", "versionchanged": "Changed in version", "deprecated": "Deprecated since version", "versionremoved": "Removed in version"}

#: name -> (required arguments, optional ones, whether the last holds blanks, options, whether content may follow)
SPECS: dict[str, tuple[int, int, bool, dict, bool]] = {
    **{a: (0, 0, False, COMMON, True) for a in ADMONITIONS},
    "admonition": (1, 0, True, COMMON, True), "image": (1, 0, True, IMAGE, False), "figure": (1, 0, True, FIGURE, True), "topic": (1, 0, True, COMMON, True),
    "sidebar": (0, 1, True, {**COMMON, "subtitle": unchanged_required}, True), "rubric": (1, 0, True, COMMON, False), **{k: (0, 0, False, COMMON, True) for k in ("epigraph", "highlights", "pull-quote")},
    "compound": (0, 0, False, COMMON, True), "container": (0, 1, True, {"name": unchanged}, True), "parsed-literal": (0, 0, False, COMMON, True), "code": (0, 1, False, CODE, True),
    "math": (0, 0, False, COMMON, True), "raw": (1, 0, True, {"file": unchanged, "url": uri, "encoding": unchanged, "class": classes}, True), "line-block": (0, 0, False, COMMON, True), "class": (1, 0, True, {}, True),
    "table": (0, 1, True, TABLE, True), "csv-table": (0, 1, True, CSV, True), "list-table": (0, 1, True, LIST, True), "replace": (0, 0, False, {}, True), "unicode": (1, 0, True, {"trim": flag, "ltrim": flag, "rtrim": flag}, False), "date": (0, 0, False, {}, True),
}
WIDE: dict[str, tuple[int, int, bool, dict, bool]] = {
    "toctree": (0, 0, False, TOC, True), **{k: (1, 1, True, {}, True) for k in VERSIONS}, "seealso": (0, 0, False, COMMON, True), "code-block": (0, 1, False, BLOCK, True), "sourcecode": (0, 1, False, BLOCK, True),
    "highlight": (1, 0, False, {"force": flag, "linenothreshold": natural}, False), "only": (1, 0, True, {}, True), "index": (1, 0, True, {"name": unchanged}, False), "hlist": (0, 0, False, {"columns": natural}, True),
    "glossary": (0, 0, False, {"sorted": flag}, True), "rst-class": (1, 0, True, {}, True), "math": (0, 1, True, {**COMMON, "label": unchanged, "nowrap": flag, "no-wrap": flag}, True),
}


class Call:
    """One directive as it stands: arguments, options, content, and where."""

    def __init__(self, parser, name: str, arguments: list[str], options: dict, content: list[str], base: int, line: int, raw: str, substitution: str | None):
        self.parser, self.name, self.arguments, self.options, self.content, self.base, self.line, self.raw, self.substitution = parser, name, arguments, options, content, base, line, raw, substitution

    def say(self, level: int, text: str) -> Node:
        return self.parser.say(level, text, self.line, preserved("literal_block", self.raw))

    def into(self, node: Node) -> Node:
        return self.parser.nested(self.content, self.base, node) if self.content else node

    def named(self, node: Node) -> list[Node]:
        """The node with the class and name that options give; and messages on the name."""
        if self.options.get("class"):
            node.list("classes").extend(self.options["class"])
        if not self.options.get("name"):
            return []
        node.list("names").append(normal_name(self.options["name"]))
        return self.parser.registry.name(node, True, self.line)

    def needs_content(self) -> None:
        if not self.content:
            raise Wrong(f'Content block expected for the "{self.name}" directive; none found.')


def options_of(block: list[str], spec: dict) -> dict:
    """Option fields as values: unknown ones, repeated ones, then wrong values raise."""
    fields: list[tuple[str, str | None]] = []
    k = 0
    while k < len(block):
        m = _FIELD.match(block[k])
        if not m:
            raise Wrong("invalid option block")
        name = m.group().rstrip()[1:-1]
        lines, k = [block[k][m.end() :]], k + 1
        while k < len(block) and (block[k][:1] == " " or not block[k]):
            lines.append(block[k].strip())
            k += 1
        value = "\n".join(lines).strip()
        if len(name.split()) != 1:
            raise Wrong("invalid option data: extension option field name may not contain multiple words")
        fields.append((name.lower(), value or None))
    out: dict = {}
    for name, value in fields:
        if name not in spec:
            raise Wrong(f'unknown option: "{name}"')
        if name in out:
            raise Wrong(f'invalid option data: duplicate option "{name}"')
        try:
            out[name] = spec[name](value)
        except Wrong as e:
            raise Wrong(f'invalid option value: (option: "{name}"; value: {py_repr(value) if value is not None else None})\n{e}') from None
    return out


def run(parser, given: str, mark: int, lines: list[str], i: int, base: int, substitution: str | None = None) -> tuple[list[Node], int, bool]:
    """(nodes, line after, whether a blank line follows) of the directive at line i."""
    name, line = given.lower(), base + i + 1
    b = parser.indented(lines, i, base, mark)
    first = lines[i][mark:].strip()
    shift = b.base - (base + i)  # blank lines at the start
    raw = "\n".join(lines[i : b.end]).rstrip()
    spec = WIDE.get(name) if parser.wide and name in WIDE else SPECS.get(name)
    if spec is None:
        if parser.wide:
            return [parser.say(ERROR, f'Unknown directive type "{given}".', line, preserved("literal_block", raw))], b.end, b.finished
        return [parser.say(INFO, f'No directive entry for "{given}" in module "docutils.parsers.rst.languages.en".\nTrying "{given}" as canonical directive name.', line), parser.say(ERROR, f'Unknown directive type "{given}".', line, preserved("literal_block", raw))], b.end, b.finished
    required, optional, blanks, options, has_content = spec
    del first
    try:
        head, content, at = [], b.lines, 0
        if b.lines and (options or required or optional):
            at = next((k for k, x in enumerate(b.lines) if not x.strip()), len(b.lines)) if shift == 0 else 0
            head, content = b.lines[:at], b.lines[at + 1 :] if at < len(b.lines) and shift == 0 else b.lines[at:]
            if shift and options and b.lines and _FIELD.match(b.lines[0]) and shift == 1:
                at = next((k for k, x in enumerate(b.lines) if not x.strip()), len(b.lines))
                head, content = b.lines[:at], b.lines[at + 1 :]
        cut = next((k for k, x in enumerate(head) if options and _FIELD.match(x)), len(head))
        values = options_of(head[cut:], options) if cut < len(head) else {}
        head = head[:cut]
        start = at + 1
        if head and not (required or optional):
            start = 0 if cut == at else 0
            content = head + (b.lines[at:] if cut == at else ["", *content])
            head = []
        while content and not content[0].strip():
            content, start = content[1:], start + 1
        text = "\n".join(head)
        arguments = text.split()
        if len(arguments) < required:
            raise Wrong(f"{required} argument(s) required, {len(arguments)} supplied")
        if len(arguments) > required + optional:
            if not blanks:
                raise Wrong(f"maximum {required + optional} argument(s) allowed, {len(arguments)} supplied")
            arguments = text.split(None, required + optional - 1)
        if content and not has_content:
            raise Wrong("no content permitted")
        # where the content's first line is in the document
        where = b.base + next((k for k in range(len(b.lines)) if b.lines[k : k + len(content)] == content), 0) if content else b.base
        call = Call(parser, name, arguments, values, content, where, line, raw, substitution)
        return BUILD.get(name, _unbuilt)(call), b.end, b.finished
    except Wrong as e:
        text = str(e)
        if not text.endswith((".", "found.")) or text.startswith(("unknown", "invalid", "no content", "maximum")) or "required," in text:
            text = f'Error in "{given}" directive:\n{text}.'
        return [parser.say(ERROR, text, line, preserved("literal_block", raw))], b.end, b.finished


# nodes


def _unbuilt(c: Call) -> list[Node]:
    return [c.into(Node(c.name))]


def _admonition(c: Call) -> list[Node]:
    c.needs_content()
    node = Node(c.name)
    said = c.named(node)
    if c.name == "admonition":
        title, more = c.parser.inline(c.arguments[0], c.line)
        node.add(Node("title", *title), *more)
        if "class" not in c.options:
            node.list("classes").append("admonition-" + make_id(c.arguments[0]))
    return [c.into(node), *said]


def _image_node(c: Call) -> tuple[Node, list[Node]]:
    node = Node("image", uri=uri(c.arguments[0]))
    for k in ("alt", "height", "width", "scale", "align", "loading"):
        if k in c.options:
            node.set(k, c.options[k])
    if "align" in c.options and (c.options["align"] in ("top", "middle", "bottom")) != bool(c.substitution) and c.name == "image" and c.substitution:
        raise Wrong(f'Error in "{c.name}" directive: "{c.options["align"]}" is not a valid value for the "align" option within a substitution definition.  Valid values for "align" are: "top", "middle", "bottom".')
    said = c.named(node)
    target = c.options.get("target")
    if not target:
        return node, said
    link = Node("reference")
    if m := re.fullmatch(r"(?:`([^`]+)`|(\S+))_", target.strip()):
        link.set("name", whole_name(m.group(1) or m.group(2)))
        link.set("refname", normal_name(m.group(1) or m.group(2)))
    else:
        link.set("refuri", uri(target))
    return link.add(node), said


def _image(c: Call) -> list[Node]:
    node, said = _image_node(c)
    return [node, *said]


def _figure(c: Call) -> list[Node]:
    own = {k: c.options.pop(k) for k in ("figwidth", "figclass", "figname", "align") if k in c.options}
    image, said = _image_node(c)
    node = Node("figure", image)
    if "figwidth" in own:
        node.set("width", own["figwidth"])
    if "figclass" in own:
        node.list("classes").extend(own["figclass"])
    if "align" in own:
        node.set("align", own["align"])
    if c.content:
        inner = c.into(Node("x"))
        first = inner.children[0] if inner.children else None
        if first is not None and first.kind == "paragraph":
            node.add(Node("caption", *first.children))
        elif first is not None and not (first.kind == "comment" and not first.children):
            return [node, c.say(ERROR, "Figure caption must be a paragraph or empty comment."), *said]
        if len(inner.children) > 1:
            node.add(Node("legend", *inner.children[1:]))
    return [node, *said]


def _topic(c: Call) -> list[Node]:
    if c.name == "topic" or c.arguments:
        c.needs_content()
    node = Node(c.name)
    said = c.named(node)
    for kind, text in (("title", c.arguments[0] if c.arguments else None), ("subtitle", c.options.get("subtitle"))):
        if text:
            nodes, more = c.parser.inline(text, c.line)
            node.add(Node(kind, *nodes), *more)
    return [c.into(node), *said]


def _rubric(c: Call) -> list[Node]:
    nodes, more = c.parser.inline(c.arguments[0], c.line)
    node = Node("rubric", *nodes)
    return [node, *more, *c.named(node)]


def _quote(c: Call) -> list[Node]:
    c.needs_content()
    from docframe.functions.doctree import Block

    out = Node("x")
    c.parser.quote(Block(c.content, c.base, True, 0), out)
    for x in out.children:
        if x.kind == "block_quote":
            x.list("classes").append(c.name)
            x.list("classes").extend(c.options.get("class", []))
    return out.children


def _compound(c: Call) -> list[Node]:
    c.needs_content()
    node = Node(c.name)
    if c.name == "container" and c.arguments:
        c.options["class"] = classes(c.arguments[0])
    said = c.named(node)
    return [c.into(node), *said]


def _parsed_literal(c: Call) -> list[Node]:
    c.needs_content()
    nodes, more = c.parser.inline("\n".join(c.content), c.base + 1)
    node = preserved("literal_block", "")
    said = c.named(node)
    return [node.add(*nodes), *more, *said]


def _code(c: Call) -> list[Node]:
    c.needs_content()
    kinds = ["code", *([c.arguments[0]] if c.arguments else [])]
    text = "\n".join(c.content)
    node = preserved("literal_block", "")
    node.set("classes", kinds)
    if "number-lines" in c.options:
        start = python_int(c.options["number-lines"] or "1")
        size = len(str(start + len(c.content) - 1))
        for k, x in enumerate(c.content):
            node.add(Node("inline", f"{start + k:>{size}} ", classes=["ln"]), Text(x + ("\n" if k < len(c.content) - 1 else "")))
    else:
        node.add(Text(text))
    return [node, *c.named(node)]


def _math(c: Call) -> list[Node]:
    if c.parser.wide:
        text = "\n".join([*c.arguments, *([""] if c.arguments and c.content else []), *c.content])
        node = preserved("math_block", text)
        label = c.options.get("label") or c.options.get("name")
        node.attrs |= {"docname": c.parser.docname, "label": label, "no-wrap": "no-wrap" in c.options or "nowrap" in c.options, "number": None, "nowrap": "no-wrap" in c.options or "nowrap" in c.options}
        node.attrs["classes"] = list(c.options.get("class", []))
        if not label:
            return [node]
        node.set("number", c.parser.registry.serial("equation") + 1)
        return [Node("target", ids=[f"equation-{make_id(label)}"]), node]
    c.needs_content()
    out = []
    for text in re.split(r"\n\s*\n", "\n".join(c.content)):
        if text.strip():
            node = preserved("math_block", text)
            out += [node, *c.named(node)]
    return out


def _raw(c: Call) -> list[Node]:
    if "file" in c.options or "url" in c.options:
        if c.content:
            raise Wrong('"raw" directive may not both specify an external file and have content.')
        return [c.say(WARNING, '"raw" directive with an external source isn\'t read.')]
    c.needs_content()
    node = preserved("raw", "\n".join(c.content), format=" ".join(c.arguments[0].lower().split()))
    return [node, *c.named(node)]


def _lines(c: Call) -> list[Node]:
    c.needs_content()
    out, said = Node("line_block"), []
    said += c.named(out)
    for k, x in enumerate(c.content):
        nodes, more = c.parser.inline(x.strip(), c.base + k + 1)
        line = Node("line", *nodes)
        line.extra["indent"] = len(x) - len(x.lstrip()) if x.strip() else None
        out.add(line)
        said += more
    c.parser.fold_lines(out)
    return [out, *said]


def _class(c: Call) -> list[Node]:
    kinds = classes(c.arguments[0])
    if c.content:
        inner = c.into(Node("x"))
        for x in inner.children:
            if x.kind != "system_message":
                x.list("classes").extend(kinds)
        return inner.children
    if c.parser.wide:  # the next sibling that shows gets them
        c.parser.waiting = kinds
        return []
    shown = ", ".join(map(py_repr, kinds))
    return [Node("pending", f".. internal attributes:\n     .transform: docutils.transforms.misc.ClassAttribute\n     .details:\n       class: [{shown}]\n       directive: {py_repr(c.name)}")]


def _titled(c: Call, table: Node, more: list[Node] = ()) -> list[Node]:
    said = c.named(table)
    for k in ("align", "width"):
        if k in c.options:
            table.set(k, c.options[k])
    if c.arguments:
        nodes, messages = c.parser.inline(c.arguments[0], c.line)
        table.children.insert(0, Node("title", *nodes))
        said = [*messages, *said]
    return [table, *more, *said]


def _widths(c: Call, table: Node, columns: int) -> None:
    w = c.options.get("widths")
    if isinstance(w, list):
        if len(w) != columns:
            raise Wrong(f'"{c.name}" widths do not match the number of columns in table ({columns}).')
        for spec, x in zip((x for x in table.walk() if x.kind == "colspec"), w):
            spec.set("colwidth", x)
        table.list("classes").append("colwidths-given")
    elif w:
        table.list("classes").append(f"colwidths-{w.strip()}")


def _table(c: Call) -> list[Node]:
    c.needs_content()
    inner = c.into(Node("x"))
    if len(inner.children) != 1 or inner.children[0].kind != "table":
        return [c.say(ERROR, f'Error parsing content block for the "{c.name}" directive: exactly one table expected.')]
    table = inner.children[0]
    _widths(c, table, table.find(lambda x: x.kind == "tgroup").get("cols"))
    return _titled(c, table)


def csv_rows(lines: list[str], delimiter: str = ",", quote: str = '"', escape: str | None = None, keep: bool = False) -> list[list[str]]:
    """Cells of delimited lines; a quoted cell may hold the delimiter and line ends."""
    got = csv.reader((x + "\n" for x in lines), delimiter=delimiter, quotechar=quote, escapechar=escape, doublequote=escape is None, skipinitialspace=not keep, strict=True)
    try:
        return [list(r) for r in got]
    except csv.Error as e:
        raise Wrong(f"Error with CSV data in table directive:\n{e}") from None


def shape(rows: list[list]) -> tuple[int, list[int]]:
    """The number of columns, and how many cells each row has."""
    sizes = [len(r) for r in rows]
    return max(sizes, default=0), sizes


def checked(c: Call, rows: list[list], head: int, stub: int) -> int:
    columns, sizes = shape(rows)
    if len(rows) < head:
        raise Wrong(f'{head} header row(s) specified but only {len(rows)} row(s) of data supplied ("{c.name}" directive).')
    if len(rows) == head > 0:
        raise Wrong(f'Insufficient data supplied ({len(rows)} row(s)); no data remaining for table body, required by "{c.name}" directive.')
    for n in sizes:
        if n < stub:
            raise Wrong(f'{stub} stub column(s) specified but only {n} columns(s) of data supplied ("{c.name}" directive).')
        if n == stub > 0:
            raise Wrong(f'Insufficient data supplied ({n} columns(s)); no data remaining for table body, required by "{c.name}" directive.')
    return columns


def _csv(c: Call) -> list[Node]:
    o = c.options
    if "file" in o or "url" in o:
        return [c.say(WARNING, f'"{c.name}" directive with an external source isn\'t read.')]
    if not c.content:
        return [c.parser.say(WARNING, f'The "{c.name}" directive requires content; none supplied.', c.line, preserved("literal_block", c.raw))]
    single = lambda x, d: {"tab": "\t", "space": " "}.get(x, code_point(x)) if x else d
    how = (single(o.get("delim"), ","), single(o.get("quote"), '"'), single(o.get("escape"), None), "keepspace" in o)
    given = csv_rows(o["header"].split("\n"), *how) if o.get("header") else []
    rows = csv_rows([x for x in c.content if x.strip()], *how)
    if not rows:
        raise Wrong("No table data detected in CSV file.")
    head, stub = o.get("header-rows", 0), o.get("stub-columns", 0)
    columns = checked(c, rows, head, stub)
    columns = max(columns, shape(given)[0])
    cells = [[(0, 0, c.base + k, x.split("\n")) for x in [*r, *[""] * (columns - len(r))]] for k, r in enumerate([*given, *rows])]
    cut = len(given) + head
    table = finish([100 // columns] * columns, cells[:cut], cells[cut:], c.parser, stub)
    _widths(c, table, columns)
    return _titled(c, table)


def _list_table(c: Call) -> list[Node]:
    if not c.content:
        return [c.say(ERROR, f'The "{c.name}" directive is empty; content required.')]
    inner = c.into(Node("x"))
    lists = [x for x in inner.children if x.kind != "system_message"]
    if len(lists) != 1 or lists[0].kind != "bullet_list":
        return [*[x for x in inner.children if x.kind == "system_message"], c.say(ERROR, f'Error parsing content block for the "{c.name}" directive: exactly one bullet list expected.')]
    rows = []
    for k, item in enumerate(lists[0].children):
        if len(item.children) != 1 or item.children[0].kind != "bullet_list":
            raise Wrong(f'Error parsing content block for the "{c.name}" directive: two-level bullet list expected, but row {k + 1} does not contain a second-level bullet list.')
        rows.append([x.children for x in item.children[0].children])
    sizes = shape(rows)[1]
    for k, n in enumerate(sizes):
        if n != sizes[0]:
            raise Wrong(f'Error parsing content block for the "{c.name}" directive: uniform two-level bullet list expected, but row {k + 1} does not contain the same number of items as row 1 ({n} vs {sizes[0]}).')
    head, stub = c.options.get("header-rows", 0), c.options.get("stub-columns", 0)
    columns = checked(c, rows, head, stub)
    cells = [[(0, 0, 0, []) for _ in r] for r in rows]
    table = finish([100 // columns] * columns, cells[:head], cells[head:], c.parser, stub)
    for entry, nodes in zip((x for x in table.walk() if x.kind == "entry"), (n for r in rows for n in r)):
        entry.children = nodes
    _widths(c, table, columns)
    return _titled(c, table)


def _in_substitution(c: Call) -> None:
    if c.substitution is None:
        raise Wrong(f'Invalid context: the "{c.name}" directive can only be used within a substitution definition.')


def _replace(c: Call) -> list[Node]:
    _in_substitution(c)
    c.needs_content()
    inner = c.into(Node("x"))
    paragraphs = [x for x in inner.children if x.kind == "paragraph"]
    said = [x for x in inner.children if x.kind == "system_message"]
    if len(paragraphs) != 1 or len(said) + 1 != len(inner.children):
        return [c.say(ERROR, f'Error in "{c.name}" directive: may contain a single paragraph only.')]
    return [*said, *paragraphs[0].children]


def _unicode(c: Call) -> list[Node]:
    _in_substitution(c)
    codes = re.split(r"(?:^| )\.\. ", c.arguments[0])[0].split()
    text = "".join(code_point(x) for x in codes)
    return [Text(text)]


def _date(c: Call) -> list[Node]:
    _in_substitution(c)
    return [Text(datetime.datetime.now(datetime.UTC).strftime("\n".join(c.content) or "%Y-%m-%d"))]


def _toctree(c: Call) -> list[Node]:
    entries, files = [], []
    for x in c.content:
        if not x.strip():
            continue
        m = re.fullmatch(r"(.+?)\s*<([^<]*?)>", x.strip(), re.S)
        shown, target = (m.group(1).strip(), m.group(2)) if m else (None, x.strip())
        entries.append((shown, target))
        if not re.match(r"https?://", target) and target != "self":
            files.append(target)
    o = c.options
    node = Node("toctree", caption=o.get("caption"), entries=entries, glob="glob" in o, hidden="hidden" in o, includefiles=files, includehidden="includehidden" in o, maxdepth=o.get("maxdepth", -1), numbered=o.get("numbered", 0), parent=c.parser.docname, titlesonly="titlesonly" in o)
    wrapper = Node("compound", node, classes=["toctree-wrapper"])
    return [wrapper, *c.named(wrapper)]


def _version(c: Call) -> list[Node]:
    node = Node("versionmodified", type=c.name, version=c.arguments[0])
    label = f"{VERSIONS[c.name]} {c.arguments[0]}"
    said: list[Node] = []
    text: list[Node] = []
    if len(c.arguments) > 1:
        text, said = c.parser.inline(c.arguments[1], c.line)
    if c.content:
        inner = c.into(Node("x")).children
        if not text and inner and inner[0].kind == "paragraph":
            text, inner = inner[0].children, inner[1:]
    else:
        inner = []
    head = Node("inline", label + (": " if text else "."), classes=["versionmodified", {"versionadded": "added", "versionchanged": "changed", "deprecated": "deprecated", "versionremoved": "removed"}[c.name]])
    return [node.add(Node("paragraph", head, *text, translatable=0), *inner), *said]


def _seealso(c: Call) -> list[Node]:
    c.needs_content()
    node = Node("seealso")
    said = c.named(node)
    return [c.into(node), *said]


def _code_block(c: Call) -> list[Node]:
    o, lines = c.options, c.content
    if o.get("dedent"):
        lines = [x[o["dedent"] :] for x in lines]
    language = c.arguments[0] if c.arguments else c.parser.language
    node = preserved("literal_block", "\n".join(lines), force="force" in o, language=language)
    if "linenos" in o or "lineno-start" in o:
        node.set("linenos", 1)
    extra = {}
    if o.get("emphasize-lines"):
        extra["hl_lines"] = names_of_lines(o["emphasize-lines"], len(lines))
    if "lineno-start" in o:
        extra["linenostart"] = o["lineno-start"]
    node.set("highlight_args", extra)
    if "caption" not in o:
        return [node, *c.named(node)]
    nodes, more = c.parser.inline(o["caption"], c.line)
    wrapper = Node("container", Node("caption", *nodes), node, classes=["literal-block-wrapper"], literal_block=1)
    return [wrapper, *more, *c.named(wrapper)]


def _highlight(c: Call) -> list[Node]:
    c.parser.language = c.arguments[0].strip()
    return [Node("highlightlang", force="force" in c.options, lang=c.parser.language, linenothreshold=c.options.get("linenothreshold", 9223372036854775807))]


def _only(c: Call) -> list[Node]:
    return [c.into(Node("only", expr=c.arguments[0]))]


def index_entries(text: str, target: str) -> list[tuple]:
    """(type, value, target, main, key) of each entry of an index directive."""
    out: list[tuple] = []
    text = whole = unescaped(text.strip())
    main = ""
    if text.startswith("!"):
        main, text = "main", text[1:].lstrip()
    for kind in ("single", "pair", "double", "triple", "see", "seealso"):
        if text.startswith(f"{kind}:"):
            value = text[len(kind) + 1 :].strip()
            if value.startswith("!"):
                main, value = "main", value[1:].lstrip()
            return [("pair" if kind == "double" else kind, value, target, main, None)]
    for value in whole.split(","):
        value = value.strip()
        main = ""
        if value.startswith("!"):
            main, value = "main", value[1:].lstrip()
        if value:
            out.append(("single", value, target, main, None))
    return out


def _index(c: Call) -> list[Node]:
    id_ = f"index-{c.parser.registry.serial('index')}"
    entries = [e for x in c.arguments[0].split("\n") for e in index_entries(x, id_)]
    target = Node("target", ids=[id_])
    said = c.named(target)
    return [Node("index", entries=entries, inline=False), target, *said]


def _hlist(c: Call) -> list[Node]:
    n = c.options.get("columns", 2)
    inner = c.into(Node("x"))
    if len(inner.children) != 1 or inner.children[0].kind != "bullet_list" or n < 1:
        return [c.parser.say(WARNING, "hlist content is not a list", c.line)]
    items = inner.children[0].children
    out, at = Node("hlist", ncolumns=n), 0
    each, more = divmod(len(items), n)
    for k in range(n):
        size = each + (k < more)
        out.add(Node("hlistcol", Node("bullet_list", *items[at : at + size])))
        at += size
    return [out]


def _glossary(c: Call) -> list[Node]:
    listing = Node("definition_list", classes=["glossary"])
    out, terms, k = Node("glossary", listing, sorted="sorted" in c.options), [], 0
    while k < len(c.content):
        s = c.content[k]
        if not s.strip():
            k += 1
        elif s[0] != " ":
            if not s.startswith(".. "):
                name, _, _ = s.partition(" : ")
                nodes, _ = c.parser.inline(name, c.base + k + 1)
                term = Node("term", *nodes)
                id_ = f"term-{make_id(term.astext())}"
                if id_ == "term-" or id_ in c.parser.registry.ids:
                    id_ = f"term-{c.parser.registry.serial('term')}"
                c.parser.registry.ids[id_] = term
                term.set("ids", [id_])
                terms.append(term.add(Node("index", entries=[("single", term.astext(), id_, "main", None)])))
            k += 1
        else:
            b = c.parser.indented(c.content, k, c.base)
            listing.add(Node("definition_list_item", *terms, c.parser.nested(b.lines, b.base, Node("definition"))))
            terms, k = [], b.end
    if terms:
        listing.add(Node("definition_list_item", *terms, Node("definition")))
    return [out]


BUILD: dict[str, Callable[[Call], list[Node]]] = {
    **{a: _admonition for a in (*ADMONITIONS, "admonition")}, "image": _image, "figure": _figure, "topic": _topic, "sidebar": _topic, "rubric": _rubric, "epigraph": _quote, "highlights": _quote, "pull-quote": _quote,
    "compound": _compound, "container": _compound, "parsed-literal": _parsed_literal, "code": _code, "math": _math, "raw": _raw, "line-block": _lines, "class": _class, "rst-class": _class, "table": _table, "csv-table": _csv,
    "list-table": _list_table, "replace": _replace, "unicode": _unicode, "date": _date, "toctree": _toctree, **{k: _version for k in VERSIONS}, "seealso": _seealso, "code-block": _code_block, "sourcecode": _code_block,
    "highlight": _highlight, "only": _only, "index": _index, "hlist": _hlist, "glossary": _glossary,
}
