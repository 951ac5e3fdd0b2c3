"""The document tree: nodes, their identifiers and names, and the dump as indented text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

LISTS = ("backrefs", "classes", "dupnames", "ids", "names")
INFO, WARNING, ERROR, SEVERE = 1, 2, 3, 4
LEVELS = {1: "INFO", 2: "WARNING", 3: "ERROR", 4: "SEVERE"}

#: Letters that decomposition alone doesn't turn into ASCII: first those of two letters, then of one.
DIGRAPHS = {0xDF: "sz", 0xE6: "ae", 0x153: "oe", 0x238: "db", 0x239: "qp"}
LETTERS = {
    0xF8: "o", 0x111: "d", 0x127: "h", 0x131: "i", 0x142: "l", 0x167: "t", 0x180: "b", 0x183: "b", 0x188: "c", 0x18C: "d", 0x192: "f", 0x199: "k",
    0x19A: "l", 0x19E: "n", 0x1A5: "p", 0x1AB: "t", 0x1AD: "t", 0x1B4: "y", 0x1B6: "z", 0x1E5: "g", 0x225: "z", 0x234: "l", 0x235: "n", 0x236: "t",
    0x237: "j", 0x23C: "c", 0x23F: "s", 0x240: "z", 0x247: "e", 0x249: "j", 0x24B: "q", 0x24D: "r", 0x24F: "y",
}


def make_id(text: str) -> str:
    """An identifier of a text; empty where no letter has an ASCII form."""
    s = text.lower().translate(LETTERS).translate(DIGRAPHS)
    s = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()
    s = re.sub("[^a-z0-9]+", "-", " ".join(s.split()))
    return re.sub("^[-0-9]+|-+$", "", s)


def whole_name(text: str) -> str:
    return " ".join(text.split())


def normal_name(text: str) -> str:
    return " ".join(text.lower().split())


class Node:
    """An element, or (kind '#text') a piece of text."""

    __slots__ = ("attrs", "children", "extra", "kind", "text")

    def __init__(self, kind: str, *children: Node | str, **attrs: object):
        self.kind, self.text = kind, None
        self.children: list[Node] = [Text(c) if isinstance(c, str) else c for c in children]
        self.attrs: dict = {k.replace("__", ":"): v for k, v in attrs.items()}
        self.extra: dict = {}

    def add(self, *nodes: Node) -> Node:
        self.children += nodes
        return self

    def list(self, name: str) -> list[str]:
        return self.attrs.setdefault(name, [])

    def get(self, name: str, default: object = None) -> object:
        return self.attrs.get(name, default)

    def set(self, name: str, value: object) -> None:
        self.attrs[name] = value

    def astext(self) -> str:
        """The text of all descendants, blocks one blank line apart."""
        if self.kind == "#text":
            return self.text or ""
        between = "" if self.kind in INLINE or all(c.kind == "#text" or c.kind in INLINE for c in self.children) else "\n\n"
        return between.join(c.astext() for c in self.children)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            x = stack.pop()
            yield x
            stack.extend(reversed(x.children))

    def find(self, test: Callable[[Node], bool]) -> Node | None:
        """The first node of the tree that passes the test."""
        return next((x for x in self.walk() if test(x)), None)

    def pairs(self) -> list[tuple[str, str]]:
        """All attributes as text in the order of their names; empty lists aren't there."""
        out = []
        for k, v in self.attrs.items():
            if k in LISTS:
                if v:
                    out.append((k, " ".join(x.replace("\\", "\\\\").replace(" ", "\\ ") for x in v)))
            else:
                out.append((k, str(v)))
        return sorted(out)

    def line(self) -> str:
        return "<" + self.kind + "".join(f' {k}="{v}"' for k, v in self.pairs()) + ">"

    def pformat(self) -> str:
        out: list[str] = []
        stack = [(self, 0)]
        while stack:
            x, depth = stack.pop()
            if x.kind == "#text":
                out += ["    " * depth + y for y in (x.text or "").removesuffix("\n").split("\n")]
            else:
                out.append("    " * depth + x.line())
                stack.extend((c, depth + 1) for c in reversed(x.children))
        return "".join(x + "\n" for x in out)


INLINE = {"emphasis", "strong", "literal", "reference", "target", "footnote_reference", "citation_reference", "substitution_reference", "title_reference", "abbreviation", "acronym", "superscript", "subscript", "math", "inline", "problematic", "generated", "pending_xref", "raw", "image", "index"}


def Text(text: str) -> Node:  # noqa: N802
    x = Node("#text")
    x.text = text
    return x


def preserved(kind: str, text: str, **attrs: object) -> Node:
    """A block whose blanks and lines stay."""
    return Node(kind, *([text] if text else []), **attrs, xml__space="preserve")


def message(level: int, text: str, line: int, source: str, *more: Node) -> Node:
    return Node("system_message", Node("paragraph", text), *more, level=level, line=line, source=source, type=LEVELS[level])


class Registry:
    """Identifiers and names of one document."""

    def __init__(self, source: str):
        self.source, self.ids, self.count = source, {}, 0
        self.names: dict[str, tuple[Node | None, bool]] = {}  # name -> (its node, or None where it is nobody's; explicit)
        self.serials: dict[str, int] = {}

    def serial(self, kind: str) -> int:
        """0, 1, 2, … for each kind."""
        n = self.serials.get(kind, 0)
        self.serials[kind] = n + 1
        return n

    def identify(self, node: Node) -> str:
        """A free id made of the node's names, or 'id' and a number."""
        if node.get("ids"):
            return node.attrs["ids"][0]
        for name in node.get("names") or []:
            if (x := make_id(name)) and x not in self.ids:
                break
        else:
            while True:
                self.count += 1
                x = f"id{self.count}"
                if x not in self.ids:
                    break
        self.ids[x] = node
        node.list("ids").append(x)
        return x

    @staticmethod
    def _lose(node: Node | None, name: str) -> None:
        if node is not None and name in node.get("names", []):
            node.attrs["names"].remove(name)
            node.list("dupnames").append(name)

    def name(self, node: Node, explicit: bool, line: int) -> list[Node]:
        """Registers the node's names. Messages say which were taken: of two equal explicit
        or two equal implicit names nobody keeps it, an explicit one wins over an implicit
        one, and an explicit target of the same URI as before goes without a message."""
        id_ = self.identify(node)
        out = []
        for name in list(node.get("names") or []):
            if name not in self.names:
                self.names[name] = (node, explicit)
                continue
            old, was = self.names[name]
            if was and explicit:
                if node.get("refuri") and old is not None and old.get("refuri") == node.get("refuri"):
                    self._lose(node, name)
                    continue
                self._lose(old, name)
                self._lose(node, name)
                self.names[name] = (None, True)
                out.append(message(WARNING, f'Duplicate explicit target name: "{name}".', line, self.source))
            elif explicit:
                self._lose(old, name)
                self.names[name] = (node, True)
                out.append(message(INFO, f'Target name overrides implicit target name "{name}".', line, self.source))
                continue
            else:
                if not was:
                    self._lose(old, name)
                    self.names[name] = (None, False)
                self._lose(node, name)
                out.append(message(INFO, f'Duplicate implicit target name: "{name}".', line, self.source))
            if not (node.get("refuri") or node.get("refname")):
                out[-1].list("backrefs").append(id_)
        return out
