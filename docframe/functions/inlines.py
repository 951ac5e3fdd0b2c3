"""Inline markup: the text of a block to nodes and messages."""

from __future__ import annotations

import re
import unicodedata

from docframe.functions.nodes import ERROR, INFO, WARNING, Node, Registry, Text, message, normal_name, whole_name

SIMPLE = r"(?:(?!_)\w)+(?:[-._+:](?:(?!_)\w)+)*"
_CLASSES: dict[str, list[str]] = {}
for _c in range(0x80, 0x10000):
    _CLASSES.setdefault(unicodedata.category(chr(_c)), []).append(chr(_c))
_set = lambda *k: "".join(re.escape(x) for y in k for x in _CLASSES.get(y, []))
_OPEN = re.escape("\"'(<[{") + _set("Ps", "Pi", "Pf")
_CLOSE = re.escape("\"')>]}") + _set("Pe", "Pi", "Pf")
_DELIM = re.escape("-/:") + _set("Pd", "Po")
_BEFORE = rf"(?:^|(?<=[\s{_OPEN}{_DELIM}]))"
_AFTER = rf"(?:$|(?=[\s\x00{_CLOSE}{_DELIM}{re.escape('.,;!?')}\\]))"
_PAIRS = {'"': '"', "'": "'", "(": ")", "<": ">", "[": "]", "{": "}", "\u2018": "\u2019", "\u201c": "\u201d\u201c", "\u00ab": "\u00bb", "\u00bb": "\u00ab", "\u201e": "\u201c\u201d"}

_INITIAL = re.compile(
    rf"{_BEFORE}(?:(?P<start>\*\*|\*(?!\*)|``|_`|\|(?!\|))(?=\S)|(?P<whole>(?P<refname>{SIMPLE})(?P<refend>__?)|\[(?P<label>[0-9]+|\#(?:{SIMPLE})?|\*|(?P<citation>{SIMPLE}))\]_){_AFTER}|(?P<role>(?::{SIMPLE}:)?)(?P<tick>`(?!`))(?=\S))",
    re.U,
)
_END = {
    "*": re.compile(rf"(?<![\s\x00])(\*){_AFTER}"),
    "**": re.compile(rf"(?<![\s\x00])(\*\*){_AFTER}"),
    "``": re.compile(rf"(?<!\s)(``){_AFTER}"),
    "_`": re.compile(rf"(?<![\s\x00])(`){_AFTER}"),
    "`": re.compile(rf"(?<![\s\x00])(`(?P<suffix>(?P<role>:{SIMPLE}:)?(?P<refend>__?)?)){_AFTER}"),
    "|": re.compile(rf"(?<![\s\x00])(\|(?P<refend>_{{0,2}})){_AFTER}"),
}
_EMBEDDED = re.compile(r"(?:[ \n]+|^)<((?![\s\x00])(?:[^<>\x00]|\x00.)+(?<!\s)(?<!\x00))>$|(?:[ \n]+|^)<((?![\s\x00])(?:[^<>\x00]|\x00.)*\x00_)>$", re.S)
SCHEMES = frozenset("about acap afp aim bitcoin callto cap cid crid data dav dict dns fax feed file finger ftp geo git go gopher h323 hdl http https iax icap im imap info ipp irc ircs jabber jar ldap lsid magnet mailto mid mms modem news nfs nntp oid opaquelocktoken pop prospero res rsync rtsp service sftp shttp sip sips skype sms smb snews snmp soap ssh stun svn tag tel telnet tftp tip turn tv urn uuid vemmi view-source wais ws wss xmlrpc xmpp z39.50r z39.50s".split())
_URIC = r"[-_.!~*'()\[\];/:@&=+$,%a-zA-Z0-9\x00]"
_URIEND = r"[_~*/=+a-zA-Z0-9]"
_EMAILC = r"[-_!~*'{|}/#?^`&=+$%a-zA-Z0-9\x00]"
_STANDALONE = re.compile(
    rf"{_BEFORE}(?:(?P<absolute>(?P<scheme>[a-zA-Z][a-zA-Z0-9.+-]*):(?:(?://?{_URIC}*{_URIEND}|{_URIC}*{_URIEND})(?:\?{_URIC}*{_URIEND})?(?:\#{_URIC}*{_URIEND})?))|(?P<email>{_EMAILC}+(?:\.{_EMAILC}+)*(?<!\x00)@{_EMAILC}+(?:\.{_EMAILC}*)*[_~*/=+a-zA-Z0-9])){_AFTER}"
)
_EMAIL = re.compile(rf"{_EMAILC}+(?:\.{_EMAILC}+)*(?<!\x00)@{_EMAILC}+(?:\.{_EMAILC}*)*[_~*/=+a-zA-Z0-9]")

_MARK, _SIGN = re.compile(r"[*`_|]"), re.compile("[:@]")  # each match of _INITIAL has one of the first, of _STANDALONE of the second


def _from(sign: re.Pattern, s: str, at: int) -> int:
    """Where the run without blanks begins that has the first sign from `at` on, so that no
    match with a sign begins before; the end of s where there is none."""
    m = sign.search(s, at)
    return max(at, s.rfind(" ", at, m.start()) + 1, s.rfind("\n", at, m.start()) + 1) if m else len(s)


ROLES = {
    "abbreviation": "abbreviation", "ab": "abbreviation", "acronym": "acronym", "ac": "acronym", "code": "code", "emphasis": "emphasis", "literal": "literal", "math": "math",
    "pep-reference": "pep", "pep": "pep", "rfc-reference": "rfc", "rfc": "rfc", "strong": "strong", "subscript": "subscript", "sub": "subscript", "superscript": "superscript", "sup": "superscript",
    "title-reference": "title_reference", "title": "title_reference", "t": "title_reference", "raw": "raw",
}
UNBUILT = {"index", "i", "named-reference", "anonymous-reference", "footnote-reference", "citation-reference", "substitution-reference", "target", "uri-reference", "uri", "url"}
STANDARD = {"doc", "ref", "term", "option", "envvar", "numref", "keyword", "token", "program", "confval", "download", "eq"}
PYTHON = {"func", "class", "meth", "mod", "attr", "data", "exc", "obj", "const", "deco"}
PLAIN = {"abbr": "abbreviation", "command": "strong", "dfn": "emphasis", "kbd": "literal", "mailheader": "emphasis", "makevar": "strong", "manpage": "literal_emphasis", "mimetype": "emphasis", "newsgroup": "emphasis", "regexp": "literal", "samp": "literal", "file": "literal", "guilabel": "inline", "menuselection": "inline"}


def escaped(text: str) -> str:
    """Each backslash and what follows it as NUL and that."""
    return re.sub(r"\\([\s\S]?)", lambda m: "\0" + m.group(1), text)


def unescaped(text: str, restore: bool = False) -> str:
    """Without the NULs, or with the backslashes again; an escaped blank vanishes."""
    return text.replace("\0", "\\") if restore else re.sub("\0[ \n]", "", text).replace("\0", "")


def split_title(text: str) -> tuple[str, str, bool]:
    """(title, target, whether there was a title) of 'Title <target>'."""
    m = re.match(r"^(.+?)\s*(?<!\x00)<([^<]*?)>$", text, re.S)
    return (unescaped(m.group(1)), unescaped(m.group(2)), True) if m else (unescaped(text), unescaped(text), False)


class Inliner:
    """Of one document: what names and ids need."""

    def __init__(self, registry: Registry, source: str, wide: bool, docname: str):
        self.registry, self.source, self.wide, self.docname = registry, source, wide, docname

    def parse(self, text: str, line: int) -> tuple[list[Node], list[Node]]:
        """(nodes, messages) of a block's text that begins at a line."""
        s, out, said = escaped(text), [], []
        at = last = 0
        while m := _INITIAL.search(s, _from(_MARK, s, at)):
            before, nodes, at, messages = self._dispatch(m, s, line)
            said += messages
            if nodes:
                out += self._implicit(s[last:before]) + nodes
                last = at
        return out + self._implicit(s[last:]), said

    def _dispatch(self, m: re.Match, s: str, line: int) -> tuple[int, list[Node], int, list[Node]]:
        if m.group("refname"):
            name = m.group("refname")
            node = Node("reference", unescaped(name), name=whole_name(name))
            node.set(*(("anonymous", 1) if m.group("refend") == "__" else ("refname", normal_name(name))))
            return m.start("whole"), [node], m.end("whole"), []
        if m.group("label"):
            return m.start("whole"), [self._footnote(m)], m.end("whole"), []
        mark = m.group("start") or "`"
        start, open_ = (m.start("start"), m.end("start")) if m.group("start") else (m.start("role"), m.end("tick"))
        if start and open_ < len(s) and s[start - 1] in _PAIRS and s[open_] in _PAIRS[s[start - 1]]:
            return open_, [], open_, []  # quoted
        end = _END[mark].search(s, open_ + (1 if open_ < len(s) else 0)) if mark != "`" else _END["`"].search(s, open_ + 1)
        what = {"*": "emphasis", "**": "strong", "``": "literal", "_`": "internal target", "`": "interpreted text or phrase reference", "|": "substitution_reference"}[mark]
        if not end:
            return self._problem(s, start, open_, WARNING, f"Inline {what} start-string without end-string.", line)
        inner, stop = s[open_ : end.start(1)], end.end(1)
        if mark in ("*", "**"):
            return start, [Node("emphasis" if mark == "*" else "strong", unescaped(inner))], stop, []
        if mark == "``":
            return start, [Node("literal", unescaped(inner, True))], stop, []
        if mark == "_`":
            name = normal_name(unescaped(inner))
            node = Node("target", unescaped(inner), names=[name])
            return start, [node], stop, self.registry.name(node, True, line)
        if mark == "|":
            name = unescaped(inner)
            node = Node("substitution_reference", name, refname=whole_name(name))
            if refend := end.group("refend"):
                outer = Node("reference", node)
                outer.set(*(("anonymous", 1) if refend == "__" else ("refname", normal_name(name))))
                node = outer
            return start, [node], stop, []
        before, after, refend = m.group("role"), end.group("role"), end.group("refend")
        if refend:
            if before or after:
                kind = "prefix" if before else "suffix"
                return self._problem(s, start, stop, WARNING, f"Mismatch: both interpreted text role {kind} and reference suffix.", line)
            return start, *self._phrase(inner, refend, line, stop)
        if before and after:
            return self._problem(s, start, stop, WARNING, "Multiple roles in interpreted text (both prefix and suffix present; only one allowed).", line)
        nodes, said = self._role((before or after or "").strip(":"), inner, unescaped(s[start:stop], True), line)
        return start, nodes, stop, said

    def _problem(self, s: str, start: int, stop: int, level: int, text: str, line: int) -> tuple[int, list[Node], int, list[Node]]:
        node, said = self.problematic(unescaped(s[start:stop], True), level, text, line)
        return start, [node], stop, [said]

    def problematic(self, raw: str, level: int, text: str, line: int) -> tuple[Node, Node]:
        """The piece of markup and its message, which name each other."""
        said = message(level, text, line, self.source)
        node = Node("problematic", raw, refid=self.registry.identify(said))
        said.list("backrefs").append(self.registry.identify(node))
        return node, said

    def _footnote(self, m: re.Match) -> Node:
        label = m.group("label")
        if m.group("citation"):
            node = Node("citation_reference", label, refname=normal_name(label))
        elif label == "*":
            node = Node("footnote_reference", auto="*")
        elif label[0] == "#":
            node = Node("footnote_reference", auto=1)
            if label[1:]:
                node.set("refname", normal_name(label[1:]))
        else:
            node = Node("footnote_reference", label, refname=normal_name(label))
        self.registry.identify(node)
        return node

    def _phrase(self, inner: str, refend: str, line: int, stop: int) -> tuple[list[Node], int, list[Node]]:
        m = _EMBEDDED.search(inner)
        if not m:
            text = unescaped(inner)
            node = Node("reference", text, name=whole_name(text))
            node.set(*(("anonymous", 1) if refend == "__" else ("refname", normal_name(text))))
            return [node], stop, []
        link, text = m.group(1) or m.group(2), inner[: m.start()]
        alias = link.endswith("_") and not link.endswith("\0_") and not re.match(r"[a-zA-Z][a-zA-Z0-9.+-]*:", link)
        if alias:
            key, value = "refname", normal_name(unescaped(link[:-1]))
            shown = text or unescaped(link[:-1])
        else:
            uri = " ".join("".join(x.split()) for x in re.split("\0[ \n]", link))
            uri = unescaped(uri)
            key, value = "refuri", f"mailto:{uri}" if _EMAIL.fullmatch(uri) else uri
            shown = text or unescaped(link)
        shown = unescaped(shown)
        node = Node("reference", shown, name=whole_name(shown))
        node.set(key, value)
        if refend == "__":
            return [node], stop, []
        target = Node("target", names=[normal_name(shown)])
        target.set(key, value)
        return [node, target], stop, self.registry.name(target, False, line)

    def _role(self, given: str, inner: str, raw: str, line: int) -> tuple[list[Node], list[Node]]:
        role = given.lower() or "title-reference"
        if self.wide and (found := self._cross(role, inner)):
            return found, []
        said = []
        if role in UNBUILT:
            node, bad = self.problematic(raw, ERROR, f'Interpreted text role "{given}" not implemented.', line)
            return [node], [bad]
        kind = ROLES.get(role)
        if not kind:
            if role != "restructuredtext-unimplemented-role":
                said.append(message(INFO, f'No role entry for "{given}" in module "docutils.parsers.rst.languages.en".\nTrying "{given}" as canonical role name.', line, self.source))
            node, bad = self.problematic(raw, ERROR, f'Unknown interpreted text role "{given}".', line)
            return [node], [*said, bad]
        if kind == "raw":
            node, bad = self.problematic(raw, ERROR, 'No format (Writer name) is associated with this role: "raw".\nThe "raw" role cannot be used directly.\nInstead, use the "role" directive to create a new role with an associated format.', line)
            return [node], [bad]
        if kind == "math":
            return [Node("math", unescaped(inner, True).strip())], []
        if kind == "code":
            return [Node("literal", unescaped(inner, True), classes=["code"])], []
        if kind in ("pep", "rfc"):
            return self._numbered(kind, unescaped(inner), raw, line)
        return [Node(kind, unescaped(inner))], []

    def _numbered(self, kind: str, text: str, raw: str, line: int) -> tuple[list[Node], list[Node]]:
        number, _, part = text.partition("#")
        ok = re.fullmatch(r"\d+", number) and (int(number) <= 9999 if kind == "pep" else int(number) >= 1)
        if not ok:
            bad = f'PEP number must be a number from 0 to 9999; "{text}" is invalid.' if kind == "pep" else f'RFC number must be a number greater than or equal to 1; "{number}" is invalid.'
            node, said = self.problematic(raw, ERROR, bad, line)
            return [node], [said]
        if kind == "pep":
            return [Node("reference", f"PEP {text}", refuri=f"https://peps.python.org/pep-{int(number):04d}")], []
        return [Node("reference", f"RFC {int(number)}", refuri=f"https://tools.ietf.org/html/rfc{int(number)}.html" + (f"#{part}" if part else ""))], []

    def _cross(self, role: str, inner: str) -> list[Node] | None:
        """The wide dialect's roles: references that later phases resolve, links by number, and plain ones."""
        domain, _, kind = role.rpartition(":")
        shown, target, explicit = split_title(inner)
        if kind in ("pep", "rfc", "cve", "cwe") and not domain:
            return self._extlink(kind, shown, target, explicit)
        if not domain and kind in PLAIN:
            return [Node(PLAIN[kind], unescaped(inner), classes=[kind])]
        if not domain:
            domain = "std" if kind in STANDARD else "py" if kind in PYTHON else ""
        if not domain:
            return None
        python = domain == "py"
        if domain == "std" and kind == "ref":
            target = normal_name(target)
        if python and not explicit and target.startswith("~"):
            target = target[1:]
            shown = target.rpartition(".")[2]
        if python and not explicit and kind in ("func", "meth"):
            shown += "()"
        node = Node("pending_xref", refdoc=self.docname, refdomain=domain, refexplicit=int(explicit), reftarget=target, reftype=kind, refwarn=int(not python))
        if python:
            node.set("py:class", "True")
            node.set("py:module", "True")
        return [node.add(Node("literal" if python else "inline", shown, classes=["xref", domain, f"{domain}-{kind}"]))]

    def _extlink(self, kind: str, shown: str, target: str, explicit: bool) -> list[Node] | None:
        number, _, part = target.partition("#")
        if kind != "cve" and not number.isdigit():
            return None
        n = int(number) if number.isdigit() else 0
        uri = {"pep": f"https://peps.python.org/pep-{n:04d}/", "rfc": f"https://datatracker.ietf.org/doc/html/rfc{n}.html", "cve": f"https://www.cve.org/CVERecord?id=CVE-{number}", "cwe": f"https://cwe.mitre.org/data/definitions/{n}.html"}[kind]
        label = f"{kind.upper()} {target}"
        if kind == "rfc" and part:
            head, _, tail = part.partition("-")
            label = f"RFC {number} {head.capitalize()}" + (f" {tail}" if tail else "") if head in ("appendix", "page", "section") else label
        entry = {"pep": f"Python Enhancement Proposals; {label}", "rfc": f"RFC; {label}", "cve": f"Common Vulnerabilities and Exposures; {label}", "cwe": f"Common Weakness Enumeration; {label}"}[kind]
        id_ = f"index-{self.registry.serial('index')}"
        index = Node("index", entries=f"[('single', {entry!r}, {id_!r}, '', None)]")
        link = Node("reference", Node("strong", shown if explicit else label), classes=[kind], internal=0, refuri=uri + (f"#{part}" if part else ""))
        return [index, Node("target", ids=[id_]), link]

    def _implicit(self, text: str) -> list[Node]:
        """Text with the URIs and e-mail addresses that stand in it."""
        out, at = [], 0
        for m in _STANDALONE.finditer(text, _from(_SIGN, text, 0)):
            if m.group("scheme") and m.group("scheme").lower() not in SCHEMES:
                continue
            if m.start() > at:
                out.append(Text(unescaped(text[at : m.start()])))
            shown = unescaped(m.group())
            out.append(Node("reference", shown, refuri=shown if m.group("scheme") else f"mailto:{shown}"))
            at = m.end()
        if (rest := unescaped(text[at:])) or not out and text:
            out.append(Text(rest))
        return [x for x in out if x.kind != "#text" or x.text]


def standalone(text: str) -> list[str]:
    """The URIs and addresses of a text as a reader would follow them."""
    return [("" if m.group("scheme") else "mailto:") + unescaped(m.group()) for m in _STANDALONE.finditer(escaped(text)) if not m.group("scheme") or m.group("scheme").lower() in SCHEMES]


