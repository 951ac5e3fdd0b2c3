"""Text templates: '{{ value | filter }}', '{% if %}', '{% for %}'; rendered a row at a time in pieces of Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docframe.functions.batches import pieces

#: Parsed templates that a worker keeps.
KEPT = 1024

_PART = re.compile(r"\{\{(.*?)\}\}|\{%-?\s*(.*?)\s*-?%\}|\{#.*?#\}", re.S)
_WORD = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[A-Za-z_][\w.]*|-?\d+(?:\.\d+)?|==|!=|[()|,\[\]])""")


class Undefined:
    """A name that isn't there: empty, false, and without parts."""

    def __str__(self) -> str:
        return ""

    def __bool__(self) -> bool:
        return False


def shown(x: object) -> str:
    """A value as text: lists as '[a, b]', objects as '{k: v}', without quotes; truths in lower case."""
    if x is None or isinstance(x, Undefined):
        return ""
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, list):
        return "[" + ", ".join(map(shown, x)) + "]"
    if isinstance(x, dict):
        return "{" + ", ".join(f"{k}: {shown(v)}" for k, v in x.items()) + "}"
    return str(x)


def _escape(s: str, quotes: bool = True) -> str:
    s = s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return s.replace('"', "&quot;") if quotes else s


FILTERS: dict[str, Callable] = {
    "e": lambda x: _escape(shown(x), False), "escape": lambda x: _escape(shown(x), False), "striptags": lambda x: re.sub("<[^>]*>", "", shown(x)), "upper": lambda x: shown(x).upper(), "lower": lambda x: shown(x).lower(),
    "length": len, "join": lambda x, by="": by.join(map(shown, x)), "default": lambda x, d="": d if isinstance(x, Undefined) or x is None else x, "safe": lambda x: x, "tojson": lambda x: json.dumps(x), "trim": lambda x: shown(x).strip(), "title": lambda x: shown(x).title(),
}
FUNCTIONS: dict[str, Callable] = {
    "has_tag": lambda tags, tag: tag in (tags or []), "in_list": lambda x, xs: x in (xs or []), "not_empty": lambda x: bool(x), "_": lambda x: x,
    "pathto": lambda target, resource=None: f"_static/{target}" if resource == "true" else target if target.startswith("http") else f"{target}.html",
    "css_tag": lambda x: f'<link rel="stylesheet" href="{x}" type="text/css" />' if isinstance(x, str) else "", "js_tag": lambda x: f'<script src="{x}"></script>' if isinstance(x, str) else "",
}


class Expression:
    """A value: a name with parts, a literal, a call, with filters, 'not', 'and', 'or', '==', '!=', 'in'."""

    def __init__(self, text: str):
        self.tokens, i = [], 0
        text = text.strip()
        while i < len(text):
            m = _WORD.match(text, i)
            if not m:
                raise ValueError(f"can't read {text[i:]!r} in a template")
            self.tokens.append(m.group(1))
            i = m.end()

    def __call__(self, context: dict) -> object:
        self.at, self.context = 0, context
        out = self._or()
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at]!r} in a template")
        return out

    def _peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def _take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def _or(self) -> object:
        x = self._and()
        while self._peek() == "or":
            self._take()
            y = self._and()
            x = x or y
        return x

    def _and(self) -> object:
        x = self._not()
        while self._peek() == "and":
            self._take()
            y = self._not()
            x = x and y
        return x

    def _not(self) -> object:
        if self._peek() == "not":
            self._take()
            return not self._not()
        x = self._value()
        if self._peek() in ("==", "!=", "in"):
            op, y = self._take(), self._value()
            return x == y if op == "==" else x != y if op == "!=" else x in (y or [])
        return x

    def _value(self) -> object:
        x = self._plain()
        while self._peek() == "|":
            self._take()
            name = self._take()
            if name not in FILTERS:
                raise ValueError(f"unknown filter {name!r}")
            x = FILTERS[name](x, *self._arguments()) if self._peek() == "(" else FILTERS[name](x)
        return x

    def _arguments(self) -> list:
        self._take()
        out = []
        while self._peek() != ")":
            out.append(self._or())
            if self._peek() == ",":
                self._take()
        self._take()
        return out

    def _plain(self) -> object:
        t = self._take()
        if t == "(":
            x = self._or()
            self._take()
            return x
        if t[0] in "\"'":
            return re.sub(r"\\(.)", r"\1", t[1:-1])
        if re.fullmatch(r"-?\d+", t):
            return int(t)
        if re.fullmatch(r"-?\d+\.\d+", t):
            return float(t)
        if t in ("true", "false"):
            return t == "true"
        if t == "none":
            return None
        if self._peek() == "(":
            if t not in FUNCTIONS:
                raise ValueError(f"unknown function {t!r}")
            return FUNCTIONS[t](*self._arguments())
        x: object = self.context
        for part in t.split("."):
            x = x.get(part, Undefined()) if isinstance(x, dict) else Undefined()
        return Undefined() if x is None else x


def parsed(text: str) -> list:
    """The parts of a template: texts, expressions, and ('if'|'for', …) with their own parts."""
    stack: list[list] = [[]]
    open_: list[list] = []
    at = 0
    for m in _PART.finditer(text):
        if m.start() > at:
            stack[-1].append(text[at : m.start()])
        at = m.end()
        if m.group(1) is not None:
            stack[-1].append(Expression(m.group(1)))
        elif m.group(2):
            word, _, rest = m.group(2).partition(" ")
            if word == "if":
                open_.append(["if", [(Expression(rest), [])]])
                stack.append(open_[-1][1][-1][1])
            elif word in ("elif", "else") and open_ and open_[-1][0] == "if":
                stack.pop()
                open_[-1][1].append((Expression(rest if word == "elif" else "true"), []))
                stack.append(open_[-1][1][-1][1])
            elif word == "for" and (f := re.fullmatch(r"(\w+)\s+in\s+(.+)", rest, re.S)):
                open_.append(["for", f.group(1), Expression(f.group(2)), []])
                stack.append(open_[-1][3])
            elif word in ("endif", "endfor") and open_ and open_[-1][0] == word[3:]:
                stack.pop()
                stack[-1].append(open_.pop())
            else:
                raise ValueError(f"unexpected {m.group(2)!r} in a template")
    if open_:
        raise ValueError(f"{open_[-1][0]!r} isn't closed in a template")
    return [*stack[0], text[at:]]


def render(parts: list, context: dict) -> str:
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(p)
        elif isinstance(p, Expression):
            out.append(shown(p(context)))
        elif p[0] == "if":
            out.append(next((render(body, context) for test, body in p[1] if test(context)), ""))
        else:
            items = p[2](context)
            out += [render(p[3], {**context, p[1]: x}) for x in (items if isinstance(items, list) else [])]
    return "".join(out)


def filled(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Templates and JSON objects to texts, a piece of a batch at a time."""
    made: dict[str, list] = {}

    def one(text: str | None, x: str | None) -> str | None:
        if text is None or x is None:
            return None
        if text not in made:
            if len(made) >= KEPT:
                made.clear()
            made[text] = parsed(text)
        return render(made[text], json.loads(x))

    for t, c in batches:
        for p in pieces(pa.RecordBatch.from_arrays([t, c], ["t", "c"]), 1):
            yield pa.array([one(text, x) for text, x in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True)], pa.string())


def rendered(template: Column | str, context: Column) -> Column:
    """A template (one for all, or a column) filled from JSON objects; a null context gives a null."""
    return F.arrow_udf(filled, "string")(F.lit(template) if isinstance(template, str) else template, context)


#: Built-in pages; what a folder of templates has goes over them.
BUILTIN = {
    "page.html": '<!DOCTYPE html>\n<html lang="{{ language }}">\n<head><title>{{ title | striptags | e }} &#8212; {{ docstitle | e }}</title>{% for f in css_files %}{{ css_tag(f) }}{% endfor %}{% for f in script_files %}{{ js_tag(f) }}{% endfor %}</head>\n<body>\n{{ body }}\n{% if show_copyright %}<footer>{{ copyright | e }}</footer>\n{% endif %}</body>\n</html>\n',
    "genindex.html": "<h1>Index</h1>\n{% for g in groups %}<h2>{{ g.letter }}</h2><ul>{% for x in g.entries %}<li>{{ x.entry | e }}{% if x.subentry %}, {{ x.subentry | e }}{% endif %}</li>{% endfor %}</ul>\n{% endfor %}",
    "search.html": "<h1>Search</h1>\n",
}


def global_context(config: dict, files: tuple[list[str], list[str]] = ((), ()), version: str = "") -> dict:
    """What every page's template sees."""
    get = lambda k, d: d if config.get(k) is None else config[k]
    return {
        "embedded": False, "project": config["project"], "release": get("release", ""), "version": get("version", ""), "last_updated": get("html_last_updated_fmt", ""), "copyright": get("copyright", ""), "master_doc": get("root_doc", "index"), "root_doc": get("root_doc", "index"),
        "use_opensearch": get("html_use_opensearch", False), "docstitle": get("html_title", config["project"]), "shorttitle": get("html_short_title", config["project"]), "show_copyright": get("html_show_copyright", True), "show_tool": get("html_show_tool", True), "has_source": get("html_copy_source", True),
        "show_source": get("html_show_sourcelink", True), "sourcelink_suffix": get("html_sourcelink_suffix", ".txt"), "file_suffix": ".html", "link_suffix": ".html", "script_files": list(files[1]), "language": get("language", "en"), "css_files": list(files[0]), "tool_version": version,
        "styles": get("html_style", []), "builder": "html", "parents": [], "logo_url": get("html_logo", ""), "favicon_url": get("html_favicon", ""), "html5_doctype": True,
    }
