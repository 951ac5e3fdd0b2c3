"""Repeated passages by blockwise suffix grouping with a difference cover.

A suffix starts at each word token. Two suffixes that agree on `least` tokens
start a repeated passage. Only equal prefixes matter, so tokens and prefixes are
compared by fingerprints, and the order of suffixes is theirs: of the sort, what
equal suffixes are is left, and no suffix travels with its tokens.

1. Cover sample. D = {0,1,3,8,12,18} is a difference cover modulo 31: any two
   positions i, j have an offset d < 31 for which i+d and j+d are both in the
   sample (positions congruent to D). The sample suffixes, 6 of 31, are put in
   order by their first least-30 tokens, block by block; those without an equal
   have no rank.
2. Suffixes. If suffixes i and j agree on `least` tokens, then at their offset d
   both have the same ranked sample suffix. So only suffixes with a ranked sample
   suffix within their first 31 tokens can repeat; all others are decided by the
   ranks. The rest are cut into blocks by 128-bit fingerprint, and one block is
   put in order at a time.
3. Of equal suffixes the earliest, by (doc_id, position), stays; the tokens of the
   others are removed. Where a suffix overlaps the one that stays in its own
   document, what the latter covers stays.

Documents lie in groups of some MB. A group sends each different suffix once, with
its earliest document, however often it has it, and gets back whether the earliest
of all is its own: so a passage that very many documents share takes a row a group
in its block, and texts are exchanged once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.llm.common import GROUP_BYTES, Tokens, Windows, asked_again, blocks_for, char_offsets, concluded, deflated, exchanged, inflated, met, mix, numbered, packed, questions, slices, split_by, unpacked

LEAST = 50
PERIOD = 31
COVER = np.array([0, 1, 3, 8, 12, 18])
BLOCK_BYTES = 4 << 20

_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[COVER] = True
_NONE = np.zeros(0, np.uint64)


def _reach(least: int) -> int:
    """The tokens of a sample suffix that a repeat must have."""
    if least < PERIOD + 5:
        raise ValueError(f"least must be {PERIOD + 5} or more")
    return least - PERIOD + 1


def _flat(row: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All positions 0..size-1 of each text: index of the token, text, position."""
    n = np.maximum(size, 0)
    which = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return row[:-1][which] + at, which, at


def _samples(texts: pa.Array, least: int) -> Iterator[tuple]:
    """For each slice of texts: (first text, end, tokens, sample tokens' indexes, their fingerprints)."""
    reach = _reach(least)
    for i, j, data, offsets in slices(texts):
        tokens = Tokens(data, offsets)
        count = np.diff(tokens.row)
        index, _, at = _flat(tokens.row, np.where(count >= least, count - reach + 1, 0))
        index = index[_IN_COVER[at % PERIOD]]
        yield i, j, tokens, index, Windows(tokens.hash).hash(index, reach)


def _sample_keys(texts: pa.Array, least: int, blocks: int) -> tuple:
    """The group's different sample suffixes by (block, order), whether one occurs twice, the blocks' starts and numbers."""
    h = np.sort(np.concatenate([_NONE, *(x[4] for x in _samples(texts, least))]))
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    twice = np.diff(np.append(first, len(h))) > 1
    h = h[first]
    order, edge, ids = split_by((h % np.uint64(blocks)).astype(np.int64))
    return h[order], twice[order].astype(np.uint8), edge, ids


def _ranked(parts: list[bytes]) -> list[bytes]:
    """Which of each group's sample suffixes have an equal anywhere."""
    asked = [inflated(x, [np.uint64, np.uint8], 1) for x in parts]
    h = np.concatenate([x[0] for x in asked])
    order = np.argsort(h)
    s = h[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= same[1:].copy()
    out = np.empty(len(h), np.uint8)
    out[order] = same
    out |= np.concatenate([x[1] for x in asked])
    cuts = np.cumsum([len(x[0]) for x in asked])[:-1]
    return [deflated([x]) for x in np.split(out, cuts)]


def _windows(texts: pa.Array, least: int) -> Iterator[tuple]:
    """For each slice of texts: (first text, tokens, index, text and position of each suffix, both halves of its fingerprint)."""
    for i, _, data, offsets in slices(texts):
        tokens = Tokens(data, offsets)
        index, which, at = _flat(tokens.row, np.diff(tokens.row) - least + 1)
        one = Windows(tokens.hash).hash(index, least)
        yield i, tokens, index, which + i, at, one, Windows(mix(tokens.hash ^ np.uint64(0xA5A5A5A55A5A5A5A))).hash(index, least)


def _ranks(doc: np.ndarray, sub: np.ndarray) -> np.ndarray:
    """Each text's rank by (id, hash of the text); equal ones share it."""
    order = np.lexsort((sub, doc))
    new = np.concatenate([[0], np.cumsum((doc[order][1:] != doc[order][:-1]) | (sub[order][1:] != sub[order][:-1]))]) if len(doc) else order
    out = np.empty(len(doc), np.int64)
    out[order] = new
    return out


def _candidates(t: pa.Table, body: str, least: int, blocks: int, answers: dict[int, bytes]) -> tuple[np.ndarray, ...]:
    """The suffixes that can repeat: (both halves, text), the first text of each different one."""
    texts = t.column(body).combine_chunks()
    reach = _reach(least)
    h, _, _, ids = _sample_keys(texts, least, blocks)
    good = np.concatenate([np.zeros(0, np.uint8), *(inflated(answers[b], [np.uint8])[0] for b in ids.tolist())]).astype(bool)
    ranked = np.sort(h[good])
    ones, twos, rows = [_NONE], [_NONE], [np.zeros(0, np.int64)]
    for (_, _, tokens, some, print_), (_, _, index, which, _, one, two) in zip(_samples(texts, least), _windows(texts, least), strict=True):
        if not len(ranked):
            break
        mark = np.zeros(len(tokens) + 1, np.int64)
        at = np.minimum(np.searchsorted(ranked, print_), len(ranked) - 1)
        mark[1 + some[ranked[at] == print_]] = 1
        mark = np.cumsum(mark)
        open_ = mark[np.minimum(index + least - reach + 1, len(tokens))] > mark[index]
        ones.append(one[open_])
        twos.append(two[open_])
        rows.append(which[open_])
    return np.concatenate(ones), np.concatenate(twos), np.concatenate(rows)


def _earliest(parts: list[bytes]) -> list[bytes]:
    """Of each group's suffixes those that another group has or the group has twice, and whether
    the earliest is the group's: (first half, 32 bits of the second, mine)."""
    asked = [inflated(x, [np.uint64, np.uint64, np.int64, np.uint32, np.uint8], 1) for x in parts]
    one, two, doc, sub, twice = (np.concatenate(x) for x in zip(*asked, strict=True))
    owner = np.repeat(np.arange(len(asked)), [len(x[0]) for x in asked])
    order = np.lexsort((sub, doc, two, one))
    a, b = one[order], two[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(a)))
    first = np.repeat(order[start], size)
    mine = np.empty(len(one), np.uint8)
    mine[order] = (doc[first] == doc[order]) & (sub[first] == sub[order])
    many = np.empty(len(one), bool)
    many[order] = np.repeat(size > 1, size)
    many |= twice.astype(bool)
    every = np.flatnonzero(many)
    out = np.split(every, np.searchsorted(owner[every], np.arange(1, len(asked))))
    return [deflated([one[x], two[x].astype(np.uint32), mine[x]], 1) for x in out]


def _unions(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The unions of spans of each row, in order; touching ones are one."""
    some = start < end
    row, start, end = row[some], start[some], end[some]
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    wide = np.int64(1) << 40
    top = np.maximum.accumulate(row * wide + end)
    new = np.concatenate([[True], row[1:] * wide + start[1:] > top[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(row) - 1)
    return row[new], start[new], top[last] - row[new] * wide


def _gone(t: pa.Table, body: str, doc: str, sub: str, least: int, answers: dict[int, bytes]) -> tuple[np.ndarray, ...]:
    """(text, first token, end token) of the spans that go."""
    parts = [inflated(x, [np.uint64, np.uint32, np.uint8], 1) for _, x in sorted(answers.items())]
    keys, check, mine = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (_NONE, np.zeros(0, np.uint32), np.zeros(0, np.uint8))
    order = np.lexsort((check, keys))
    keys, check, mine = keys[order], check[order], mine[order].astype(bool)
    rank = _ranks(np.asarray(t.column(doc)), np.asarray(t.column(sub)))
    hit, rows, ats = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, _, _, which, at, one, two in _windows(t.column(body).combine_chunks(), least) if len(keys) else ():
        k = np.minimum(np.searchsorted(keys, one), len(keys) - 1)
        some = keys[k] == one
        wrong = some & (check[k] != two.astype(np.uint32))
        for i in np.flatnonzero(wrong):  # another suffix has the same first half
            j = int(k[i])
            while j < len(keys) and keys[j] == one[i] and check[j] != np.uint32(two[i] & np.uint64(0xFFFFFFFF)):
                j += 1
            k[i] = min(j, len(keys) - 1)
            some[i] = j < len(keys) and keys[j] == one[i]
        hit.append(k[some])
        rows.append(which[some])
        ats.append(at[some])
    hit, rows, ats = np.concatenate(hit), np.concatenate(rows), np.concatenate(ats)
    order = np.lexsort((ats, rank[rows], hit))
    hit, rows, ats = hit[order], rows[order], ats[order]
    start = np.flatnonzero(np.concatenate([[True], hit[1:] != hit[:-1]])) if len(hit) else np.zeros(0, np.int64)
    first = np.repeat(start, np.diff(np.append(start, len(hit))))
    own = mine[hit] & (rank[rows] == rank[rows[first]])  # in the text of the one that stays
    stays = own & (ats == ats[first])
    begin = np.where(own, np.maximum(ats, ats[first] + least), ats)
    return _unions(rows[~stays], begin[~stays], ats[~stays] + least)


def _found(docs: DataFrame, key: str, text: str, columns: list[str], least: int, finish, schema: T.StructType, group_bytes: int) -> tuple[DataFrame, DataFrame]:
    """What finish(table of a group, spans that go) makes of all groups; and the rows that have no id or text."""
    _reach(least)
    names = [f"c{k}" for k in range(len(columns))]
    plain = docs.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], F.col(key).alias("doc"), F.col(text).alias("body"))
    whole = plain.where("doc IS NOT NULL AND body IS NOT NULL").withColumn("sub", F.xxhash64("body").bitwiseAND(F.lit(0xFFFFFFFF)))
    kept, _ = numbered(whole, "doc")
    blocks = blocks_for(kept, "body", BLOCK_BYTES)
    groups = exchanged(packed(kept, "body", group_bytes))

    def ask(blob: bytes) -> Iterator[tuple[int, bytes]]:
        h, twice, edge, ids = _sample_keys(unpacked(blob).column("body").combine_chunks(), least, blocks)
        for a, b, block in zip(edge[:-1], edge[1:], ids.tolist(), strict=True):
            yield block, deflated([h[a:b], twice[a:b]], 1)

    def again(blob: bytes, answers: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        t = unpacked(blob)
        one, two, row = _candidates(t, "body", least, blocks, answers)
        doc, sub = np.asarray(t.column("doc")), np.asarray(t.column("sub"))
        rank = _ranks(doc, sub)
        order = np.lexsort((rank[row], two, one))
        one, two, row = one[order], two[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])) if len(one) else np.zeros(0, np.int64)
        twice = (np.diff(np.append(first, len(one))) > 1).astype(np.uint8)
        one, two, row = one[first], two[first], row[first]
        order, edge, ids = split_by((one % np.uint64(blocks)).astype(np.int64))
        cols = [one[order], two[order], doc[row][order], sub[row][order].astype(np.uint32), twice[order]]
        for a, b, block in zip(edge[:-1], edge[1:], ids.tolist(), strict=True):
            yield block, deflated([c[a:b] for c in cols], 1)

    def end(_: int, blob: bytes, answers: dict[int, bytes]) -> pa.Table:
        t = unpacked(blob)
        return finish(t, *_gone(t, "body", "doc", "sub", least, answers))

    answers = met(asked_again(groups, met(questions(groups, ask), _ranked), again), _earliest)
    none = plain.where("doc IS NULL OR body IS NULL").select(*[F.col(n).alias(c) for c, n in zip(columns, names, strict=True)])
    return concluded(groups, answers, end, schema), none


def repeated_passages(docs: DataFrame, least: int = LEAST, group_bytes: int = GROUP_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, n_words): the spans of characters, end exclusive, that
    repeat a passage of `least` or more word tokens of an earlier place, by
    (doc_id, position); overlapping and touching ones are one span.

    Tokens are as in common.Tokens: case, blanks and punctuation don't matter.
    Rows with a null id or text, and texts of fewer tokens, have no span. Rows
    that repeat an id and a text are one document; texts that share an id come in
    the order of a hash. Ids of other types than integers come in their own order.
    Texts are used whole, however long; other columns are ignored. No rows give no rows.
    """

    def finish(t: pa.Table, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Table:
        starts, ends = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for i, j, data, offsets in slices(t.column("body").combine_chunks()):
            a, b = np.searchsorted(row, [i, j])
            if a == b:
                continue
            tokens, chars = Tokens(data, offsets), char_offsets(data)
            base, zero = tokens.row[row[a:b] - i], chars[offsets[row[a:b] - i]]
            starts[a:b] = chars[tokens.start[base + first[a:b]]] - zero
            ends[a:b] = chars[tokens.end[base + last[a:b] - 1]] - zero
        return pa.table([t.column("c0").combine_chunks().take(pa.array(row)), pa.array(starts), pa.array(ends), pa.array(last - first)], names=["doc_id", "start", "end", "n_words"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "end", "n_words"))])
    return _found(docs, key, text, [key], least, finish, schema, group_bytes)[0].distinct()


def without_repeated_passages(docs: DataFrame, least: int = LEAST, group_bytes: int = GROUP_BYTES, key: str = "doc_id", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """docs with the spans of repeated_passages cut out of their texts. A document
    of which no word token is left has no row. The column `chars`, if there is
    one, is counted again where the text changed. Other rows stay as they are: those
    with a null id or text, empty texts, and all of a table where nothing repeats.
    Rows that repeat an id and a text are cut alike. No rows give no rows."""
    names = docs.columns

    def finish(t: pa.Table, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Table:
        left = np.ones(t.num_rows, bool)
        texts = t.column("body").combine_chunks()
        new: dict[int, str] = {}
        for i, j, data, offsets in slices(texts):
            a, b = np.searchsorted(row, [i, j])
            if a == b:
                continue
            tokens = Tokens(data, offsets)
            for d in np.unique(row[a:b]):
                x, y = np.searchsorted(row, [d, d + 1])
                s, e = first[x:y], last[x:y]
                base, end = tokens.row[d - i], tokens.row[d - i + 1]
                left[d] = (e - s).sum() < end - base
                cut = np.ravel(np.column_stack([tokens.start[base + s], tokens.end[base + e - 1]]))
                cut = np.concatenate([[offsets[d - i]], cut, [offsets[d - i + 1]]])
                new[int(d)] = b"".join(data[p:q].tobytes() for p, q in zip(cut[::2], cut[1::2], strict=True)).decode()
        cols = []
        for k, c in enumerate(names):
            x = t.column(f"c{k}").combine_chunks()
            if new and c in (text, chars):
                body = x.to_pylist()
                for d, y in new.items():
                    body[d] = y if c == text else len(y)
                x = pa.array(body, x.type)
            cols.append(x)
        return pa.table(cols, names=names).filter(pa.array(left))

    got, none = _found(docs, key, text, names, least, finish, docs.schema, group_bytes)
    return got.union(none)
