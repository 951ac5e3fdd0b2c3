"""Plain Python versions of what the operators compute."""

import functools
import re

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def fold(b: bytes) -> bytes:
    out = bytearray(b)
    for i, x in enumerate(out):
        if 65 <= x <= 90:
            out[i] = x + 32
        elif i and out[i - 1] == 0xC3 and 0x80 <= x <= 0x9E and x != 0x97:
            out[i] = x + 32
    return bytes(out)


def tokens(text: str) -> list[tuple[int, int, bytes]]:
    """(start, end, folded) of each word token, offsets in characters."""
    b = (text or "").encode()
    return [(len(b[: m.start()].decode()), len(b[: m.end()].decode()), fold(m.group())) for m in WORD.finditer(b)]


def passages(docs: list[tuple], least: int) -> set[tuple]:
    """(doc_id, start, end, n_words) by comparing all windows."""
    toks = {}
    for d, t in docs:
        if d is not None and t is not None:
            toks[d, t] = tokens(t)
    first, later = {}, []
    for (d, t), w in sorted(toks.items(), key=lambda x: (x[0][0])):
        for i in range(len(w) - least + 1):
            k = tuple(x[2] for x in w[i : i + least])
            if k in first:
                d0, t0, i0 = first[k]
                s = max(i, i0 + least) if (d0, t0) == (d, t) else i
                later.append((d, t, s, i + least))
            else:
                first[k] = (d, t, i)
    out = set()
    for (d, t), w in toks.items():
        gone = set()
        for a, b, s, e in later:
            if (a, b) == (d, t):
                gone |= set(range(s, e))
        run = []
        for i in sorted(gone) + [None]:
            if run and (i is None or i != run[-1] + 1):
                out.add((d, w[run[0]][0], w[run[-1]][1], len(run)))
                run = []
            if i is not None:
                run.append(i)
    return out


@functools.cache
def grams(t: str, k: int = 3) -> frozenset:
    w = [x[2] for x in tokens(t)]
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset({t.strip()})


def jaccard(a: str, b: str, k: int = 3) -> float:
    x, y = grams(a, k), grams(b, k)
    return len(x & y) / len(x | y)


def groups(pairs) -> dict[int, int]:
    """The smallest id of each id's component, without the smallest itself."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in list(root) if find(x) != x}
