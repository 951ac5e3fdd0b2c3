"""Grid and simple tables of the markup, and tables as nodes."""

from __future__ import annotations

import re

from docframe.functions.nodes import ERROR, WARNING, Node, preserved

_HEAD = re.compile(r"\+=[=+]+=\+ *$")
_GRID = re.compile(r"\+-[-+]+-\+ *$")
_BORDER = re.compile(r"=+[ =]*$")
_SPAN = re.compile(r"-[ -]*$")


class Malformed(ValueError):
    pass


def malformed(parser, block: list[str], line: int, detail: str = "") -> Node:
    return parser.say(ERROR, "Malformed table." + (f"\n{detail}" if detail else ""), line, preserved("literal_block", "\n".join(block)))


def finish(widths: list[int], head: list[list], body: list[list], parser, stub: int = 0) -> Node:
    """A table of rows of (morerows, morecols, first line, lines) or None where another cell reaches."""
    group = Node("tgroup", cols=len(widths))
    for k, w in enumerate(widths):
        group.add(Node("colspec", colwidth=w, **({"stub": 1} if k < stub else {})))
    for kind, rows in (("thead", head), ("tbody", body)):
        if not rows:
            continue
        part = Node(kind)
        for cells in rows:
            row = Node("row")
            for cell in cells:
                if cell is None:
                    continue
                more, wide, base, lines = cell
                entry = Node("entry", **{k: v for k, v in (("morecols", wide), ("morerows", more)) if v})
                if any(x.strip() for x in lines):
                    parser.nested([x.rstrip() for x in lines], base, entry)
                row.add(entry)
            part.add(row)
        group.add(part)
    return Node("table", group)


def _dedent(lines: list[str]) -> list[str]:
    low = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
    return [x[low:].rstrip() for x in lines]


def grid_structure(block: list[str]) -> tuple[list[int], list[list], list[list]]:
    """(widths, head rows, body rows) of a grid: cells are traced along their borders."""
    block = list(block)
    head = None
    for k, s in enumerate(block):
        if _HEAD.match(s):
            if head is not None:
                raise Malformed(f"Multiple head/body row separators (table lines {head + 1} and {k + 1}); only one allowed.")
            head, block[k] = k, s.replace("=", "-")
    if head is not None and head in (0, len(block) - 1):
        raise Malformed("The head/body row separator may not be the first or last line of the table.")
    bottom, right = len(block) - 1, len(block[0]) - 1
    done, corners, cells = [-1] * len(block[0]), [(0, 0)], []
    tops, lefts = {0}, {0}

    def trace(top: int, left: int) -> tuple[int, int, set[int], set[int]] | None:
        for r in range(left + 1, right + 1):
            if block[top][r] == "+":
                for b in range(top + 1, bottom + 1):
                    if block[b][r] == "+":
                        if block[b][left] == "+" and set(block[b][left : r + 1]) <= {"+", "-"} and all(block[k][left] in "+|" for k in range(top, b + 1)):
                            ys = {k for k in range(top, b + 1) if block[k][left] == "+" or block[k][r] == "+"}
                            xs = {k for k in range(left, r + 1) if block[top][k] == "+" or block[b][k] == "+"}
                            return b, r, ys, xs
                    elif block[b][r] != "|":
                        break
            elif block[top][r] != "-":
                return None
        return None

    while corners:
        top, left = corners.pop(0)
        if top == bottom or left == right or top <= done[left]:
            continue
        got = trace(top, left)
        if not got:
            continue
        b, r, ys, xs = got
        tops |= ys
        lefts |= xs
        for c in range(left, r):
            if done[c] != top - 1:
                raise Malformed("Malformed table; parse incomplete.")
            done[c] = b - 1
        cells.append((top, left, b, r, _dedent([x[left + 1 : r] for x in block[top + 1 : b]])))
        corners = sorted({*corners, (top, r), (b, left)})
    if any(done[c] != bottom - 1 for c in range(right)):
        raise Malformed("Malformed table; parse incomplete.")
    ys, xs = sorted(tops), sorted(lefts)
    rows: list[list] = [[None] * (len(xs) - 1) for _ in range(len(ys) - 1)]
    for top, left, b, r, lines in cells:
        rows[ys.index(top)][xs.index(left)] = (ys.index(b) - ys.index(top) - 1, xs.index(r) - xs.index(left) - 1, top + 1, lines)
    cut = ys.index(head) if head is not None else 0
    return [b - a - 1 for a, b in zip(xs, xs[1:])], rows[:cut], rows[cut:]


def _rebased(rows: list[list], base: int) -> list[list]:
    return [[c and (c[0], c[1], base + c[2], c[3]) for c in r] for r in rows]


def grid(parser, lines: list[str], i: int, base: int, node: Node) -> int:
    """A grid table at line i; what follows it."""
    end = i
    while end < len(lines) and lines[end][:1] in ("+", "|"):
        end += 1
    block, size = [x.rstrip() for x in lines[i:end]], len(lines[i].rstrip())
    detail = ""
    if any(len(x) != size or x[-1] not in "+|" for x in block):
        detail = "Right border not aligned or missing."
    elif not _GRID.match(block[-1]):
        last = next((k for k in range(len(block) - 2, 1, -1) if _GRID.match(block[k])), None)
        if last is None:
            detail = "Bottom border missing or corrupt."
        else:
            end, block = i + last + 1, block[: last + 1]
    if not detail:
        try:
            widths, head, body = grid_structure(block)
            node.add(finish(widths, _rebased(head, base + i), _rebased(body, base + i), parser))
        except Malformed as e:
            detail = str(e)
    if detail:
        node.add(malformed(parser, block, base + i + 1, detail))
    if end < len(lines) and lines[end]:
        node.add(parser.say(WARNING, "Blank line required after table.", base + end + 1))
    return end


def _columns(line: str, columns: list[tuple[int, int]] | None, at: int) -> list[tuple[int, int | None]]:
    out = [m.span() for m in re.finditer("-+", line)]
    if columns is None:
        return out
    ends = [e for _, e in columns]
    if out[-1][1] < ends[-1]:
        raise Malformed(f"Column span incomplete in table line {at + 1}.")
    out[-1] = (out[-1][0], ends[-1])
    for s, e in out:
        if s not in [x for x, _ in columns] or e not in ends:
            raise Malformed(f"Column span alignment problem in table line {at + 1}.")
    return out


def simple_structure(block: list[str]) -> tuple[list[int], list[list], list[list]]:
    """(widths, head rows, body rows) of a table between lines of '='."""
    block, head = list(block), 0
    for k, s in enumerate(block):
        if _BORDER.match(s):
            block[k] = s.replace("=", "-")
            if 0 < k < len(block) - 1:
                head = k
    columns = _columns(block[0], None, 0)
    rows: list[tuple[int, list]] = []

    def row(start: int, stop: int, spans: str | None, at: int) -> None:
        lines = block[start:stop]
        if not lines and spans is None:
            return
        cols = columns if spans is None else _columns(spans, columns, at)
        if not any(x.strip() for x in lines):
            if not lines:
                return
        cells = []
        for k, (s, e) in enumerate(cols):
            last = k == len(cols) - 1
            if not last:
                for n, x in enumerate(lines):
                    if x[e : cols[k + 1][0]].strip():
                        raise Malformed(f"Text in column margin in table line {start + n + 1}.")
            wide = [c for c in columns if s <= c[0] and c[1] <= e]
            cells.append((0, len(wide) - 1, start, _dedent([x[s:] if last else x[s:e] for x in lines])))
        rows.append((start, cells))

    first, start, found = columns[0], 1, False
    for at in range(1, len(block)):
        s = block[at]
        if _SPAN.match(s):
            row(start, at, s.rstrip(), at)
            start, found = at + 1, False
        elif s[first[0] : first[1]].strip():
            if found and at != start:
                row(start, at, None, at)
            start, found = at, True
        elif not found:
            start = at + 1
    widths = [e - s for s, e in columns]
    return widths, [r for s, r in rows if s < head], [r for s, r in rows if s >= head]


def simple(parser, lines: list[str], i: int, base: int, node: Node) -> int:
    """A simple table at line i; what follows it."""
    top, found, at, end = len(lines[i].strip()), 0, 0, None
    for k in range(i + 1, len(lines)):
        if _BORDER.match(lines[k]):
            if len(lines[k].strip()) != top:
                node.add(malformed(parser, lines[i : k + 1], base + i + 1, "Bottom border or header rule does not match top border."))
                return k + 1
            found, at = found + 1, k
            if found == 2 or k == len(lines) - 1 or not lines[k + 1]:
                end = k
                break
    if end is None:
        stop = at + 1 if found else len(lines)
        extra = " or no blank line after table bottom" if found else ""
        node.add(malformed(parser, lines[i:stop], base + i + 1, f"No bottom table border found{extra}."))
        if extra and stop < len(lines) and lines[stop]:
            node.add(parser.say(WARNING, "Blank line required after table.", base + stop + 1))
        return stop
    try:
        widths, head, body = simple_structure(lines[i : end + 1])
        node.add(finish(widths, _rebased(head, base + i), _rebased(body, base + i), parser))
    except Malformed as e:
        node.add(malformed(parser, lines[i : end + 1], base + i + 1, str(e)))
    if end + 1 < len(lines) and lines[end + 1]:
        node.add(parser.say(WARNING, "Blank line required after table.", base + end + 2))
    return end + 1
