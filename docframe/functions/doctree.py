"""reStructuredText to a document tree. Any text has a tree: what is wrong becomes
messages in it. Sequential in one document, and independent of all others."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.functions.batches import rows_of
from docframe.functions.inlines import SIMPLE, Inliner, escaped, unescaped
from docframe.functions.nodes import ERROR, INFO, WARNING, Node, Registry, message, normal_name, preserved
from docframe.session import spread

DEEPEST = 200

_BULLET = re.compile(r"[-+*\u2022\u2023\u2043]( +|$)")
_ROMAN = re.compile(r"M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})")
_KINDS = {"arabic": r"[0-9]+", "loweralpha": r"[a-z]", "upperalpha": r"[A-Z]", "lowerroman": r"[ivxlcdm]+", "upperroman": r"[IVXLCDM]+"}
_NUMBER = "|".join([*_KINDS.values(), "#"])
_ENUMERATOR = re.compile(rf"(?:\((?P<parens>{_NUMBER})\)|(?P<rparen>{_NUMBER})\)|(?P<period>{_NUMBER})\.)( +|$)")
_AFFIX = {"parens": ("(", ")"), "rparen": ("", ")"), "period": ("", ".")}
_FIELD = re.compile(r":(?![: ])([^:\\]|\\.|:(?!([ `]|$)))*(?<! ):( +|$)")
_ARG = r"(?:[a-zA-Z][a-zA-Z0-9_-]*|<[^<>]+>)"
_OPT = rf"(?:[-+][a-zA-Z0-9](?: ?{_ARG})?|(?:--|/)[a-zA-Z0-9][a-zA-Z0-9_-]*(?:[ =]{_ARG})?)"
_OPTION = re.compile(rf"{_OPT}(?:, {_OPT})*(?:  +| ?$)")
_DOCTEST = re.compile(r">>>( +|$)")
_LINEBLOCK = re.compile(r"\|( +|$)")
_GRID = re.compile(r"\+-[-+]+-\+ *$")
_SIMPLE = re.compile(r"=+( +=+)+ *$")
_EXPLICIT = re.compile(r"\.\.( +|$)")
_ANONYMOUS = re.compile(r"__( +|$)")
_LINE = re.compile(r"([!-/:-@\[-`{-~])\1* *$")
_DIRECTIVE = re.compile(rf"\.\. +({SIMPLE}) ?::(?: +|$)")
_FOOTNOTE = re.compile(rf"\.\. +\[([0-9]+|#|#{SIMPLE}|\*)\](?: +|$)")
_CITATION = re.compile(rf"\.\. +\[({SIMPLE})\](?: +|$)")
_TARGET = re.compile(r"\.\. +_(?![ ]|$)")
_SUBSTITUTION = re.compile(r"\.\. +\|(?![ ]|$)")
_TARGETNAME = re.compile(r"(?:(?P<anonymous>_)|(?P<quote>`?)(?![ `])(?P<name>.+?)(?<![\s\x00])(?P=quote))(?<!(?<!\x00):\x00)(?: ?(?<!\x00)):(?: +|$)", re.S)
_ATTRIBUTION = re.compile(r"(---?(?!-)|\u2014) *(?=[^ \n])")
_QUOTING = re.compile(r"([!-/:-@\[-`{-~])")
_LITERAL = re.compile(r"(?<!\\)(\\\\)*::$")


def split_lines(text: str) -> list[str]:
    """Lines without blanks at the end; tabs to stops of 8, vertical ones and form feeds as blanks."""
    return [x.expandtabs(8).rstrip() for x in re.sub("[\v\f]", " ", text).splitlines()]


def width(s: str) -> int:
    """Columns that a text takes: wide letters two, marks over others none."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def ordinal(text: str, kind: str) -> int | None:
    if kind == "arabic":
        return int(text)
    if kind.endswith("alpha"):
        return ord(text.lower()) - 96
    s = text.upper()
    if not _ROMAN.fullmatch(s):
        return None
    value = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
    return sum(value[c] * (-1 if any(value[d] > value[c] for d in s[i + 1 : i + 2]) else 1) for i, c in enumerate(s))


def _roman(n: int) -> str:
    out = ""
    for v, s in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out += s * (n // v)
        n %= v
    return out


class Block:
    """An indented block: its lines, the number of its first line in the document,
    whether a blank line (or the end) follows, and the index after it."""

    def __init__(self, lines: list[str], base: int, finished: bool, end: int, indent: int = 0):
        self.lines, self.base, self.finished, self.end, self.indent = lines, base, finished, end, indent

    def stripped(self) -> Block:
        while self.lines and not self.lines[0].strip():
            self.lines = self.lines[1:]
            self.base += 1
        return self


class Parser:
    """Parses one document; `wide` adds the dialect's cross-references and directives."""

    def __init__(self, source: str = "<snippet>", wide: bool = False, docname: str = "index"):
        self.source, self.wide, self.docname = source, wide, docname
        self.registry = Registry(source)
        self.inliner = Inliner(self.registry, source, wide, docname)
        self.styles: list[tuple[str, bool]] = []
        self.substitutions: dict[str, Node] = {}
        self.depth, self.too_deep, self.language = 0, False, "default"
        self.waiting: list[str] | None = None

    def document(self, text: str) -> Node:
        root = Node("document", source=self.source)
        lines = split_lines(text)
        self.sections = [root]
        self.blocks(lines, 0, root, True)
        return root

    # ------------------------------------------------------------ helpers

    def say(self, level: int, text: str, line: int, *more: Node) -> Node:
        return message(level, text, line, self.source, *more)

    def inline(self, text: str, line: int) -> tuple[list[Node], list[Node]]:
        return self.inliner.parse(text, line)

    def unindent(self, what: str, line: int) -> Node:
        return self.say(WARNING, f"{what} ends without a blank line; unexpected unindent.", line)

    def nested(self, lines: list[str], base: int, node: Node) -> Node:
        """Parses a block within another; sections can't begin there."""
        if self.depth >= DEEPEST:
            if not self.too_deep:
                self.too_deep = True
                node.add(self.say(ERROR, "Maximum nesting depth exceeded; deeper content skipped.", base + 1))
            return node
        self.depth += 1
        self.blocks(lines, base, node, False)
        self.depth -= 1
        return node

    def indented(self, lines: list[str], i: int, base: int, first: int | None = None, until_blank: bool = False, known: int | None = None, strip: bool = True) -> Block:
        """The indented block at line i. first: columns of the first line to drop, with any
        indent on the next ones; known: the indent of all lines."""
        end, indent = i, known
        if known is not None and first is None:
            first = known
        if first is not None:
            end += 1
        finished = True
        while end < len(lines):
            s = lines[end]
            if s and (s[0] != " " or known is not None and s[:known].strip()):
                finished = end > i and not lines[end - 1].strip()
                break
            bare = s.lstrip()
            if not bare:
                if until_blank:
                    break
            elif known is None:
                indent = len(s) - len(bare) if indent is None else min(indent, len(s) - len(bare))
            end += 1
        block = lines[i:end]
        if first is not None and block:
            block[0] = block[0][first:]
        if indent and strip:
            block = [x if first is not None and k == 0 else x[indent:] for k, x in enumerate(block)]
        while block and not block[-1].strip():
            block.pop()
        return Block(block, base + i, finished, end, indent or 0).stripped()

    # ------------------------------------------------------------ blocks

    def blocks(self, lines: list[str], base: int, node: Node, titles: bool) -> None:
        """Parses lines, of which the first is number base + 1, into children of node."""
        i, n = 0, len(lines)
        while i < n:
            if titles:
                node = self.sections[-1]
            s = lines[i]
            waiting, self.waiting, first = self.waiting, None, len(node.children)
            if not s:
                i += 1
            elif s[0] == " ":
                b = self.indented(lines, i, base)
                self.quote(b, node)
                i = b.end
                if not b.finished:
                    node.add(self.unindent("Block quote", base + i + 1))
            else:
                i = self.flush(lines, i, base, node, titles)
            if waiting:  # a class directive without content
                seen = next((x for x in node.children[first:] if x.kind not in ("comment", "target", "system_message", "substitution_definition")), None)
                if seen is None:
                    self.waiting = [*waiting, *(self.waiting or [])]
                else:
                    seen.list("classes").extend(waiting)

    def flush(self, lines: list[str], i: int, base: int, node: Node, titles: bool) -> int:
        s = lines[i]
        if m := _BULLET.match(s):
            return self.bullets(lines, i, base, node)
        if (m := _ENUMERATOR.match(s)) and (e := self.enumerator(m, lines, i)):
            return self.enumerated(lines, i, base, node, e)
        if _FIELD.match(s):
            return self.run(lines, i, base, node, Node("field_list"), _FIELD, self.field, "Field list")
        if (m := _OPTION.match(s)) and self.indented(lines, i, base, m.end()).lines:
            return self.run(lines, i, base, node, Node("option_list"), _OPTION, self.option, "Option list")
        if _DOCTEST.match(s):
            end = next((k for k in range(i, len(lines)) if not lines[k]), len(lines))
            node.add(preserved("doctest_block", "\n".join(lines[i:end])))
            return end
        if _LINEBLOCK.match(s):
            return self.line_block(lines, i, base, node)
        if _GRID.match(s):
            from docframe.functions import tables

            return tables.grid(self, lines, i, base, node)
        if _SIMPLE.match(s):
            from docframe.functions import tables

            return tables.simple(self, lines, i, base, node)
        if _EXPLICIT.match(s) or _ANONYMOUS.match(s):
            return self.explicit(lines, i, base, node)
        if _LINE.match(s) and (k := self.adornment(lines, i, base, node, titles)) is not None:
            return k
        return self.text(lines, i, base, node, titles)

    def run(self, lines: list[str], i: int, base: int, node: Node, out: Node, pattern: re.Pattern, item: Callable, what: str) -> int:
        """Items of one kind, with blank lines between or none."""
        node.add(out)
        finished, first = True, True
        while i < len(lines):
            k = i
            while k < len(lines) and not lines[k]:
                k += 1
            m = pattern.match(lines[k]) if k < len(lines) else None
            if not m or not (first or out.children) or (got := item(lines, k, base, m, out)) is None:
                break
            i, finished = got
            first = False
        if not finished and i < len(lines):
            node.add(self.unindent(what, base + i + 1))
        return i

    def item(self, lines: list[str], i: int, base: int, end: int, kind: str) -> tuple[Node, Block]:
        b = self.indented(lines, i, base, known=end) if lines[i][end:] else self.indented(lines, i, base, first=end)
        out = Node(kind)
        if b.lines:
            self.nested(b.lines, b.base, out)
        return out, b

    def bullets(self, lines: list[str], i: int, base: int, node: Node) -> int:
        mark = lines[i][0]

        def one(lines: list[str], k: int, base: int, m: re.Match, out: Node) -> tuple[int, bool] | None:
            if m.string[0] != mark:
                return None
            x, b = self.item(lines, k, base, m.end(), "list_item")
            out.add(x)
            return b.end, b.finished

        return self.run(lines, i, base, node, Node("bullet_list", bullet=mark), _BULLET, one, "Bullet list")

    def enumerator(self, m: re.Match, lines: list[str], i: int, expected: str | None = None) -> tuple[str, str, str, int] | None:
        """(format, sequence, text, ordinal), if a list item can begin here."""
        form = next(k for k in _AFFIX if m.group(k))
        text = m.group(form)
        if text == "#":
            kind = "#"
        elif expected and expected != "#" and re.fullmatch(_KINDS[expected], text):
            kind = expected
        elif text in "iI":
            kind = "lowerroman" if text == "i" else "upperroman"
        else:
            kind = next(k for k, p in _KINDS.items() if re.fullmatch(p, text))
        value = 1 if kind == "#" else ordinal(text, kind)
        if value is None:
            return None
        after = lines[i + 1] if i + 1 < len(lines) else ""
        if after[:1].strip():
            pre, post = _AFFIX[form]
            if kind == "#":
                follows = "#"
            elif kind == "arabic":
                follows = str(value + 1)
            elif kind.endswith("alpha"):
                follows = chr(97 + value) if value < 26 else None
            else:
                follows = _roman(value + 1) if value < 4999 else None
            if follows is None:
                return None
            follows = follows.lower() if kind.startswith("lower") else follows.upper()
            if not after.startswith((f"{pre}{follows}{post} ", f"{pre}#{post} ")):
                return None
        return form, kind, text, value

    def enumerated(self, lines: list[str], i: int, base: int, node: Node, e: tuple) -> int:
        form, kind, text, value = e
        out = Node("enumerated_list", enumtype="arabic" if kind == "#" else kind, prefix=_AFFIX[form][0], suffix=_AFFIX[form][1])
        node.add(out)
        if value != 1:
            out.set("start", value)
            node.add(self.say(INFO, f'Enumerated list start value not ordinal-1: "{text}" (ordinal {value})', base + i + 1))
        last, auto, finished = value - 1, kind == "#", True
        while i < len(lines):
            k = i
            while k < len(lines) and not lines[k]:
                k += 1
            m = _ENUMERATOR.match(lines[k]) if k < len(lines) else None
            got = m and self.enumerator(m, lines, k, out.get("enumtype"))
            if not got or got[0] != form or out.children and got[1] != "#" and (got[1] != out.get("enumtype") or auto or got[3] != last + 1):
                break
            auto = auto or got[1] == "#"
            x, b = self.item(lines, k, base, m.end(), "list_item")
            out.add(x)
            last, i, finished = last + 1, b.end, b.finished
        if not finished and i < len(lines):
            node.add(self.unindent("Enumerated list", base + i + 1))
        return i

    def field(self, lines: list[str], i: int, base: int, m: re.Match, out: Node) -> tuple[int, bool]:
        b = self.indented(lines, i, base, m.end())
        marker = m.group()[1:].rstrip()
        nodes, said = self.inline(marker[: marker.rindex(":")], base + i + 1)
        body = Node("field_body", *said)
        if b.lines:
            self.nested(b.lines, b.base, body)
        out.add(Node("field", Node("field_name", *nodes), body))
        return b.end, b.finished

    def option(self, lines: list[str], i: int, base: int, m: re.Match, out: Node) -> tuple[int, bool] | None:
        b = self.indented(lines, i, base, m.end())
        if not b.lines:
            return None
        group = Node("option_group")
        for s in m.group().rstrip().split(", "):
            tokens, between = s.split(), " "
            first = tokens[0].split("=", 1)
            if len(first) > 1:
                tokens[:1], between = first, "="
            elif len(tokens[0]) > 2 and (tokens[0][0] == "-" and tokens[0][1] != "-" or tokens[0][0] == "+"):
                tokens[:1], between = [tokens[0][:2], tokens[0][2:]], ""
            if len(tokens) > 1 and tokens[1].startswith("<") and tokens[-1].endswith(">"):
                tokens[1:] = [" ".join(tokens[1:])]
            x = Node("option", Node("option_string", tokens[0]))
            if len(tokens) > 1:
                x.add(Node("option_argument", tokens[1], delimiter=between))
            group.add(x)
        out.add(Node("option_list_item", group, self.nested(b.lines, b.base, Node("description"))))
        return b.end, b.finished

    def line_block(self, lines: list[str], i: int, base: int, node: Node) -> int:
        out, finished = Node("line_block"), True
        node.add(out)
        while i < len(lines) and (m := _LINEBLOCK.match(lines[i])):
            b = self.indented(lines, i, base, m.end(), until_blank=True)
            nodes, said = self.inline("\n".join(b.lines), base + i + 1)
            x = Node("line", *nodes)
            x.extra["indent"] = len(m.group(1)) - 1 if lines[i].rstrip() != "|" else None
            out.add(x)
            node.add(*said)
            i, finished = b.end, b.finished
        if not finished and i < len(lines) and lines[i]:
            node.add(self.say(WARNING, "Line block ends without a blank line.", base + i + 1))
        self.fold_lines(out)
        return i

    def fold_lines(self, out: Node) -> None:
        """Lines that stand further in become blocks within."""
        for k, x in enumerate(out.children):
            if x.extra.get("indent") is None:
                x.extra["indent"] = out.children[k - 1].extra["indent"] if k else 0

        def fold(items: list[Node]) -> list[Node]:
            least, made, deep = min(x.extra["indent"] for x in items), [], []
            for x in items:
                if x.extra["indent"] > least:
                    deep.append(x)
                    continue
                if deep:
                    made.append(Node("line_block", *fold(deep)))
                    deep = []
                made.append(x)
            return [*made, Node("line_block", *fold(deep))] if deep else made

        if out.children:
            out.children = fold(out.children)

    def quote(self, b: Block, node: Node) -> None:
        """Block quotes of an indented block: each attribution ends one."""
        lines, base = b.lines, b.base
        while lines:
            cut = self.attribution(lines)
            out = self.nested(lines[: cut[0]] if cut else lines, base, Node("block_quote"))
            node.add(out)
            if not cut:
                return
            start, end, skip, indent = cut
            text = [lines[start][skip:], *(x[indent:] for x in lines[start + 1 : end])]
            nodes, said = self.inline("\n".join(text), base + start + 1)
            out.add(Node("attribution", *nodes))
            node.add(*said)
            lines, base = lines[end:], base + end
            while lines and not lines[0]:
                lines, base = lines[1:], base + 1

    @staticmethod
    def attribution(lines: list[str]) -> tuple[int, int, int, int] | None:
        """(first line, line after, columns of the mark, indent of the others) of an attribution."""
        blank, seen = None, False
        for i, s in enumerate(lines):
            if not s.rstrip():
                blank = i
                continue
            if seen and blank == i - 1 and (m := _ATTRIBUTION.match(s)):
                end = next((k for k in range(i + 1, len(lines)) if not lines[k].rstrip()), len(lines))
                indents = {len(x) - len(x.lstrip()) for x in lines[i + 1 : end]}
                if len(indents) < 2:
                    return i, end, m.end(), next(iter(indents), 0)
            seen = True
        return None

    # ------------------------------------------------------------ text

    def paragraph(self, lines: list[str], line: int) -> tuple[list[Node], bool]:
        """(nodes, whether a literal block follows)."""
        data = "\n".join(lines).rstrip()
        literal = bool(_LITERAL.search(data))
        if literal:
            if len(data) == 2:
                return [], True
            data = data[:-3].rstrip() if data[-3] in " \n" else data[:-1]
        nodes, said = self.inline(data, line)
        return [Node("paragraph", *nodes), *said], literal

    def text(self, lines: list[str], i: int, base: int, node: Node, titles: bool) -> int:
        s, after = lines[i], lines[i + 1] if i + 1 < len(lines) else ""
        if not after:
            nodes, literal = self.paragraph([s], base + i + 1)
            node.add(*nodes)
            return self.literal(lines, i + 1, base, node) if literal else i + 1
        if after[0] == " ":
            return self.definitions(lines, i, base, node)
        if _LINE.match(after) and (k := self.underlined(lines, i, base, node, titles)) is not None:
            return k
        end, odd = i + 1, None
        while end < len(lines) and lines[end]:
            if lines[end][0] == " ":
                odd = self.say(ERROR, "Unexpected indentation.", base + end + 1)
                break
            end += 1
        nodes, literal = self.paragraph(lines[i:end], base + i + 1)
        node.add(*nodes)
        if odd:
            node.add(odd)
        return self.literal(lines, end, base, node) if literal else end

    def literal(self, lines: list[str], i: int, base: int, node: Node) -> int:
        """The literal block after '::': indented, or quoted."""
        while i < len(lines) and not lines[i]:
            i += 1
        if i < len(lines) and lines[i][0] == " ":
            b = self.indented(lines, i, base)
            node.add(preserved("literal_block", "\n".join(b.lines)))
            if not b.finished:
                node.add(self.unindent("Literal block", base + b.end + 1))
            return b.end
        if i == len(lines) or not (m := _QUOTING.match(lines[i])):
            node.add(self.say(WARNING, "Literal block expected; none found.", base + min(i, len(lines)) + (i < len(lines))))
            return i
        end = i
        while end < len(lines) and lines[end] and lines[end][0] == m.group():
            end += 1
        node.add(preserved("literal_block", "\n".join(lines[i:end])))
        if end < len(lines) and lines[end]:
            node.add(self.say(ERROR, "Unexpected indentation." if lines[end][0] == " " else "Inconsistent literal block quoting.", base + end + 1))
        return end

    def definitions(self, lines: list[str], i: int, base: int, node: Node) -> int:
        out, finished = Node("definition_list"), True
        node.add(out)
        while i < len(lines):
            k = i
            while k < len(lines) and not lines[k]:
                k += 1
            if k + 1 >= len(lines) or lines[k][0] == " " or lines[k + 1][:1] != " " or out.children and self.begins(lines, k):
                break
            b = self.indented(lines, k + 1, base)
            nodes, said = self.inline(lines[k], base + k + 1)
            parts, messages = [Node("term")], said
            for x in nodes:
                if x.kind != "#text":
                    parts[-1].add(x)
                    continue
                cut = re.split(" +: +", x.text)
                if cut[0]:
                    parts[-1].add(*Node("x", cut[0].rstrip() if len(cut) > 1 else cut[0]).children)
                parts += [Node("classifier", c) for c in cut[1:]]
            body = Node("definition", *messages)
            if lines[k].endswith("::"):
                body.add(self.say(INFO, 'Blank line missing before literal block (after the "::")? Interpreted as a definition list item.', base + k + 2))
            out.add(Node("definition_list_item", *parts, self.nested(b.lines, b.base, body)))
            i, finished = b.end, b.finished
        if not finished and i < len(lines):
            node.add(self.unindent("Definition list", base + i + 1))
        return i

    def begins(self, lines: list[str], k: int) -> bool:
        """Whether another construct than text begins at a line."""
        s = lines[k]
        return bool(_BULLET.match(s) or (m := _ENUMERATOR.match(s)) and self.enumerator(m, lines, k) or _FIELD.match(s) or _OPTION.match(s) or _DOCTEST.match(s) or _LINEBLOCK.match(s) or _GRID.match(s) or _SIMPLE.match(s) or _EXPLICIT.match(s) or _ANONYMOUS.match(s) or _LINE.match(s))

    # ------------------------------------------------------------ sections

    def adornment(self, lines: list[str], i: int, base: int, node: Node, titles: bool) -> int | None:
        """A line of one mark: a transition, or the line over a title; None: it is text."""
        over, line = lines[i].rstrip(), base + i + 1
        if not titles:
            if over == "::":
                return None
            if len(over) < 4:
                node.add(self.say(INFO, "Unexpected possible title overline or transition.\nTreating it as ordinary text because it's so short.", line))
                return None
            node.add(self.say(ERROR, "Unexpected section title or transition.", line, preserved("literal_block", lines[i])))
            return i + 1
        after = lines[i + 1] if i + 1 < len(lines) else ""
        if not after:
            if len(over) < 4:
                return None
            node.add(Node("transition"))
            return i + 1

        def short() -> None:
            node.add(self.say(INFO, "Possible incomplete section title.\nTreating the overline as ordinary text because it's so short.", line))

        if _LINE.match(after):
            if len(over) < 4:
                short()
                return None
            node.add(self.say(ERROR, "Invalid section title or transition marker.", line, preserved("literal_block", f"{lines[i]}\n{after}")))
            return i + 2
        if i + 2 >= len(lines):
            if len(over) < 4:
                short()
                return None
            node.add(self.say(ERROR, "Incomplete section title.", line, preserved("literal_block", f"{lines[i]}\n{after}")))
            return i + 2
        under, said = lines[i + 2].rstrip(), []
        source = f"{lines[i]}\n{after}\n{lines[i + 2]}"
        wrong = "Missing matching underline for section title overline." if not under or not _LINE.match(under) else "Title overline & underline mismatch." if over != under else ""
        if wrong:
            if len(over) < 4:
                short()
                return None
            node.add(self.say(ERROR, wrong, line, preserved("literal_block", source)))
            return i + 3
        if width(after.rstrip()) > len(over):
            if len(over) < 4:
                short()
                return None
            said.append(self.say(WARNING, "Title overline too short.", line, preserved("literal_block", source)))
        self.section(after.strip(), (over[0], True), source, line + 1, line + 2, said, node)
        return i + 3

    def underlined(self, lines: list[str], i: int, base: int, node: Node, titles: bool) -> int | None:
        title, under, line = lines[i].rstrip(), lines[i + 1].rstrip(), base + i + 2
        source, said = f"{title}\n{under}", []
        if width(title) > len(under):
            if len(under) < 4:
                if titles:
                    node.add(self.say(INFO, "Possible title underline, too short for the title.\nTreating it as ordinary text because it's so short.", line))
                return None
            said.append(self.say(WARNING, "Title underline too short.", line, preserved("literal_block", source)))
        if not titles:
            node.add(*said, self.say(ERROR, "Unexpected section title.", line, preserved("literal_block", source)))
            return i + 2
        self.section(title, (under[0], False), source, line - 1, line, said, node)
        return i + 2

    def section(self, title: str, style: tuple[str, bool], source: str, line: int, last: int, said: list[Node], node: Node) -> None:
        level = self.styles.index(style) + 1 if style in self.styles else len(self.styles) + 1
        now = len(self.sections) - 1
        if level > now + 1:
            known = " ".join(f"{c}/{c}" if both else c for c, both in self.styles)
            node.add(self.say(ERROR, f"Inconsistent title style: skip from level {now} to {level}.", line, preserved("literal_block", source), Node("paragraph", f"Established title styles: {known}")))
            return
        if style not in self.styles:
            self.styles.append(style)
        del self.sections[level:]
        nodes, messages = self.inline(title, line)
        head = Node("title", *nodes)
        out = Node("section", names=[normal_name(head.astext())])
        taken = self.registry.name(out, False, last)
        self.sections[-1].add(out.add(head, *said, *messages, *taken))
        self.sections.append(out)

    # ------------------------------------------------------------ explicit markup

    def explicit(self, lines: list[str], i: int, base: int, node: Node) -> int:
        finished = True
        while i < len(lines):
            k = i
            while k < len(lines) and not lines[k]:
                k += 1
            if k == len(lines) or not (_EXPLICIT.match(lines[k]) or _ANONYMOUS.match(lines[k])):
                break
            nodes, i, finished = self.construct(lines, k, base)
            node.add(*nodes)
        if not finished and i < len(lines):
            node.add(self.unindent("Explicit markup", base + i + 1))
        return i

    def construct(self, lines: list[str], i: int, base: int) -> tuple[list[Node], int, bool]:
        s = lines[i]
        if m := _ANONYMOUS.match(s):
            b = self.indented(lines, i, base, m.end(), until_blank=True)
            return [self.target("", b.lines, base + i + 1)[0]], b.end, b.finished
        if m := _FOOTNOTE.match(s) or _CITATION.match(s):
            return self.footnote(m, lines, i, base)
        if m := _TARGET.match(s):
            got = self.hyperlink(m, lines, i, base)
            if got:
                return got
        if m := _SUBSTITUTION.match(s):
            got = self.substitution(m, lines, i, base)
            if got:
                return got
        if m := _DIRECTIVE.match(s):
            from docframe.functions import directives

            return directives.run(self, m.group(1), m.end(), lines, i, base)
        return self.comment(lines, i, base)

    def comment(self, lines: list[str], i: int, base: int) -> tuple[list[Node], int, bool]:
        m = _EXPLICIT.match(lines[i])
        if not lines[i][m.end() :].strip() and (i + 1 >= len(lines) or not lines[i + 1]):
            return [preserved("comment", "")], i + 1, True
        b = self.indented(lines, i, base, m.end())
        return [preserved("comment", "\n".join(b.lines))], b.end, b.finished

    def footnote(self, m: re.Match, lines: list[str], i: int, base: int) -> tuple[list[Node], int, bool]:
        b = self.indented(lines, i, base, m.end())
        label, line = m.group(1), base + i + 1
        if m.re is _CITATION:
            out = Node("citation", Node("label", label), names=[normal_name(label)])
        elif label[0] == "#":
            out = Node("footnote", auto=1, names=[normal_name(label[1:])] if label[1:] else [])
        elif label == "*":
            out = Node("footnote", auto="*")
        else:
            out = Node("footnote", Node("label", label), names=[label])
        said = self.registry.name(out, True, line)
        out.add(*said)
        if b.lines:
            self.nested(b.lines, b.base, out)
        else:
            out.add(self.say(WARNING, f"{out.kind.capitalize()} content expected.", line))
        return [out], b.end, b.finished

    def hyperlink(self, m: re.Match, lines: list[str], i: int, base: int) -> tuple[list[Node], int, bool] | None:
        b = self.indented(lines, i, base, m.end(), until_blank=True, strip=False)
        parts = [escaped(x) for x in b.lines]
        text, k = parts[0] if parts else "", 0
        while not (t := _TARGETNAME.match(text)):
            k += 1
            if k >= len(parts):
                out, end, finished = self.comment(lines, i, base)
                return [*out, self.say(WARNING, "malformed hyperlink target.", base + i + 1)], end, finished
            text += parts[k]
        rest = [(parts[k] + " ")[len(parts[k]) - (len(text) - t.end()) if len(text) > t.end() else len(parts[k]) :].strip(), *parts[k + 1 :]]
        node, said = self.target("" if t.group("anonymous") else t.group("name"), rest, base + i + 1)
        return [node, *said] if not said else [*said, node], b.end, b.finished

    def target(self, name: str, parts: list[str], line: int) -> tuple[Node, list[Node]]:
        """A target: internal, of another reference, or of a URI."""
        parts = [x if "\0" in x else escaped(x) for x in parts]
        node = Node("target")
        joined = " ".join(x.strip() for x in parts)
        if joined.endswith("_") and (r := re.fullmatch(rf"(?:({SIMPLE})_|`([^`]+)`_)", joined)):
            node.set("refname", normal_name(unescaped(r.group(1) or r.group(2))))
        elif uri := " ".join("".join(unescaped(x).split()) for x in re.split("\0[ \n]", joined)):
            node.set("refuri", f"mailto:{uri}" if re.fullmatch(r"[^\s:/@]+@[^\s:/@]+\.\w+", uri) else uri)
        if not name:
            node.set("anonymous", 1)
            self.registry.identify(node)
            return node, []
        node.set("names", [normal_name(unescaped(name))])
        return node, self.registry.name(node, True, line)

    def substitution(self, m: re.Match, lines: list[str], i: int, base: int) -> tuple[list[Node], int, bool] | None:
        from docframe.functions import directives

        b = self.indented(lines, i, base, m.end(), strip=False)
        joined = "\n".join(x.strip() if k else x for k, x in enumerate(b.lines))
        n = re.match(r"((?![ |])(?:\\.|[^\\|])*?(?<! ))\|(?: +|\n|$)", joined, re.S)
        if not n:
            return None
        name, line = " ".join(n.group(1).split()), base + i + 1
        out, rest = Node("substitution_definition", names=[name]), joined[n.end() :]
        if not rest.strip():
            return [self.say(WARNING, f'Substitution definition "{name}" missing contents.', line, preserved("literal_block", "\n".join(lines[i : b.end]).rstrip()))], b.end, b.finished
        d = re.match(rf"({SIMPLE}) ?::(?: +|\n|$)", rest)
        if d:
            first = len(lines[i]) - len(b.lines[0]) + n.end()
            pad = " " * 3
            body = [f".. {d.group(1)}::" + (" " + rest[d.end() :].split("\n")[0] if rest[d.end() :] else "")]
            low = min((len(x) - len(x.lstrip()) for x in b.lines[1:] if x.strip()), default=0)
            body += [pad + x[low:] for x in b.lines[1:]] if first else []
            nodes, _, _ = directives.run(self, d.group(1), len(d.group(1)) + 6 if body[0].endswith("::") else len(d.group(1)) + 6, body, 0, base + i, name)
            out.add(*nodes)
        else:
            nodes, said = self.inline(rest, line)
            out.add(*nodes)
            if said:
                return [out, *said], b.end, b.finished
        bad = [x for x in out.children if x.kind == "system_message"]
        if bad:
            out.children = [x for x in out.children if x.kind != "system_message"]
        if not out.children:
            return [*bad, self.say(WARNING, f'Substitution definition "{name}" empty or invalid.', line, preserved("literal_block", "\n".join(lines[i : b.end]).rstrip()))], b.end, b.finished
        if name in self.substitutions:
            old = self.substitutions[name]
            Registry._lose(old, name)
            bad.append(self.say(ERROR, f'Duplicate substitution definition name: "{name}".', line))
        self.substitutions[name] = out
        return [*bad, out], b.end, b.finished


def parse(text: str, source: str = "<snippet>", wide: bool = False, docname: str = "index") -> Node:
    """The tree of a text."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEEPEST))  # a level takes some eight calls
    return Parser(source, wide, docname).document(text)


ROWS = "doc string, node long, parent long, path array<long>, depth int, kind string, text string, ids array<string>, names array<string>, dupnames array<string>, classes array<string>, backrefs array<string>, extra map<string,string>, line string"


def rows(root: Node) -> Iterator[dict]:
    """A row for each node in the order of the dump; path: the nodes above it, from the root."""
    stack, n = [(root, ())], 0
    while stack:
        x, path = stack.pop()
        extra = [(k, str(v)) for k, v in x.attrs.items() if k not in ("ids", "names", "dupnames", "classes", "backrefs")]
        yield {"node": n, "parent": path[-1] if path else None, "path": path, "depth": len(path), "kind": x.kind, "text": x.text, **{k: list(x.get(k) or []) for k in ("ids", "names", "dupnames", "classes", "backrefs")}, "extra": extra, "line": x.line() if x.kind != "#text" else None}
        stack.extend((c, (*path, n)) for c in reversed(x.children))
        n += 1


def _parsed(docs: DataFrame, key: str, text: str, wide: bool, schema: str, made: Callable[[Node], Iterable[dict]]) -> DataFrame:
    """The rows that `made` gives of each document's tree, with the document's key as doc."""
    kinds = T._parse_datatype_string(schema)

    def one(doc: str | None, source: str | None) -> Iterator[dict]:
        if source is not None:
            for r in made(parse(source, doc or "", wide, doc or "")):
                yield {"doc": doc, **r}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from rows_of(batches, one, to_arrow_schema(kinds))

    return spread(docs.select(F.col(key).cast("string"), F.col(text))).mapInArrow(run, kinds)


def trees(docs: DataFrame, key: str = "docname", text: str = "content", wide: bool = True) -> DataFrame:
    """ROWS of each document's tree; a null text has none, an empty one its root."""
    return _parsed(docs, key, text, wide, ROWS, rows)


def dumps_of(docs: DataFrame, key: str = "docname", text: str = "content", wide: bool = True) -> DataFrame:
    """(doc, dump) of documents, as dumps(trees(docs)) has them; a tree is dumped where it is parsed."""
    return _parsed(docs, key, text, wide, "doc string, dump string", lambda root: ({"dump": root.pformat()},))


def texts_of(docs: DataFrame, kind: str, key: str = "docname", text: str = "content", wide: bool = True) -> DataFrame:
    """(doc, node, text) of documents, as texts(trees(docs), kind) has them; taken from a
    tree where it is parsed, so that a document is parsed once and no node is exchanged."""

    def made(root: Node) -> Iterator[dict]:
        for n, x in enumerate(root.walk()):
            if x.kind == kind:
                yield {"node": n, "text": "".join(y.text or "" for y in x.walk() if y.kind == "#text")}

    return _parsed(docs, key, text, wide, "doc string, node long, text string", made)


def dumps(tree: DataFrame) -> DataFrame:
    """(doc, dump): the indented text of each document's rows, in their order."""
    pad = F.repeat(F.lit("    "), F.col("depth"))
    texts = F.array_join(F.transform(F.split(F.regexp_replace("text", r"\n$", ""), "\n"), lambda x: F.concat(pad, x)), "\n")
    line = F.when(F.col("kind") == "#text", texts).otherwise(F.concat(pad, "line"))
    each = tree.select("doc", F.struct("node", F.concat(line, F.lit("\n")).alias("line")).alias("x"))
    return each.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "").alias("dump"))


def texts(tree: DataFrame, kind: str) -> DataFrame:
    """(doc, node, text): what is written within each node of a kind: the texts whose path leads through it."""
    heads = tree.where(F.col("kind") == kind).select("doc", "node")
    words = tree.where("kind = '#text'").select("doc", F.explode("path").alias("node"), F.struct(F.col("node").alias("at"), "text").alias("x"))
    got = words.join(heads, ["doc", "node"]).groupBy("doc", "node").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["text"]), "").alias("text"))
    return heads.join(got, ["doc", "node"], "left").select("doc", "node", F.coalesce("text", F.lit("")).alias("text"))


def substitution_counts(tree: DataFrame) -> DataFrame:
    """(doc, name, n): how often each substitution is defined, under a name or one that was lost."""
    rows = tree.where("kind = 'substitution_definition'").select("doc", F.explode(F.concat("names", "dupnames")).alias("name"))
    return rows.groupBy("doc", "name").agg(F.count("*").alias("n"))
