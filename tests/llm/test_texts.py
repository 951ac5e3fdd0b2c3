import random
import re
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pyarrow as pa
import sentencepiece
from brute import tokens
from sentencepiece import sentencepiece_model_pb2 as pb

from docframe.llm import html as H
from docframe.llm import pieces as P
from docframe.llm.common import table
from docframe.llm.units import LEAST, repeated_units, without_repeated_units

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, ""), (2, None), (3, "a  b   c\n\nd\t"), (4, "日本語 ☃☃ é😀"), (5, "é" * 20_000 + "aaaa" * 500), (None, "hello world"), (6, " "), (7, "   x"), (8, "foo;\r\n  bar"), (8, "foo;\r\n  bar")]


def make(spark, texts):
    return spark.createDataFrame([(d, t, "en", "s", len(t) if t is not None else None) for d, t in texts], SCHEMA)


def test_encoding_is_the_library_s(spark, sf):
    lib = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    docs = table(spark, sf, "documents").unionByName(make(spark, ODD))
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    want = {(str(d), None if t is None else tuple(lib.encode(t))) for d, t in texts}
    for group, cache in ((1 << 24, P.CACHE), (5000, 100), (1 << 20, 0)):
        got = {(str(r.doc_id), None if r.ids is None else tuple(r.ids)) for r in P.encode(docs, group_bytes=group, cache=cache).collect()}
        assert got == want


def test_words_that_share_half_a_digest():
    table = P.Codes(*(P.np.array(x, P.np.uint64) for x in ([5, 5, 9], [2, 1, 3])), P.np.array([1, 2, 0]), P.np.array([7, 8, 9], P.np.int32))
    at = table.find(*(P.np.array(x, P.np.uint64) for x in ([5, 5, 5, 9, 4], [1, 2, 3, 3, 1])))
    assert [None if i < 0 else table.take(P.np.array([i]))[1].tolist() for i in at] == [[8, 9], [7], None, [], None]


class Taken:
    """In a table's place: keeps the function that mapInArrow gets."""

    run = None

    def mapInArrow(self, run, _):  # noqa: N802
        self.run = run
        return self

    def __getattr__(self, _):
        return lambda *_: self


def held_by_words():
    """MB that a worker holds after it has found the words of 16 MB of texts, beyond what it held before;
    and whether the words are right."""

    def held():
        return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    rng = random.Random(1)
    known = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(50_000)]
    texts = [" ".join(rng.choices(known, k=600)) for _ in range(4000)] + ["", "日本語"]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["text"])]
    del texts, known
    v = P.vocabulary()
    taken, P.F = Taken(), Taken()  # there is no Spark in this process
    P._words(taken, SimpleNamespace(value=v))
    before, n, total = held(), 0, 0
    for b in taken.run(iter(batches)):
        n += int(pa.compute.sum(b.column("n")).as_py())
        total += sum(len(w) * k for w, k in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True))
    b = None
    after = held()
    want = sum(len(P.normalised(t, v)) for x in batches for t in x.column(0).to_pylist())
    return after - before, n > 4000 * 600 and total == want


def test_a_worker_that_has_found_words_holds_little():
    code = f"import sys; sys.path[:0] = {sys.path!r}; import test_texts; print(*test_texts.held_by_words())"
    more, right = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert right == "True" and float(more) < 50, more


def test_decoding_is_the_inverse(spark):
    docs = make(spark, ODD)
    got = sorted((str(r.doc_id), str(r.text)) for r in P.decode(P.encode(docs)).collect())
    assert got == sorted((str(d), str(t)) for d, t in ODD)
    ids = spark.createDataFrame([([1, 0, 259 + 13, 2],), ([3 + 0xFF],), ([],), (None,)], "ids array<int>")
    lib = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    assert [r.text for r in P.decode(ids).collect()][1:] == [lib.decode([3 + 0xFF]), "", None]
    assert P.encode(docs.limit(0)).count() == 0
    clash = docs.selectExpr("*", "1 AS g", "2 AS word", "3 AS ids", "4 AS blob")
    assert sorted(map(str, P.encode(clash).collect())) == sorted(map(str, P.encode(docs).collect()))


def test_words_are_sorted_and_expanded_once(monkeypatch):
    """Only distinct words are sorted; codes become ids all at once, as they do one by one."""
    v = P.vocabulary()
    sizes, sort = [], P.np.argsort
    monkeypatch.setattr(P.np, "argsort", lambda x, *a, **k: sizes.append(len(x)) or sort(x, *a, **k))
    monkeypatch.setattr(P.np, "unique", lambda x, *a, **k: sizes.append(len(x)))
    w = P.Words(["one two one two one two"] * 50, v)
    assert sizes == [len(w.one)] and len(w.which) > 10 * len(w.one) and (w.one[1:] > w.one[:-1]).all()
    assert "".join(w.distinct()[i] for i in w.which) == P.normalised("one two one two one two", v) * 50
    monkeypatch.undo()
    rows = [("ab", [5, 300]), ("xyz" * 100, None), ("☃", [-1 - ord("☃")]), ("a☃b", [-1 - ord("a"), -1 - ord("☃"), 9]), ("", []), ("é", [-1 - ord("é")])]
    for codes in ([c for _, c in rows], [[7] for _ in rows], [None for _ in rows]):
        n, flat = P._flat_ids([x for x, _ in rows], P.pa.array(codes, P.pa.list_(P.pa.int32())), v)
        cut = P.np.cumsum(n)
        assert [flat[e - k : e].tolist() for k, e in zip(n, cut, strict=True)] == P._ids([x for x, _ in rows], codes, v)


def test_decoding_takes_ids_once(spark):
    ids = spark.createDataFrame([([5, 300],)], "ids array<int>")
    assert "exists(" not in P.decode(ids)._jdf.queryExecution().optimizedPlan().toString()


def test_viterbi_finds_the_best_path(spark, tmp_path):
    """A unigram model of random scores: the fold against all segmentations."""
    rng = random.Random(3)
    m = pb.ModelProto()
    m.trainer_spec.model_type = 1
    m.normalizer_spec.add_dummy_prefix = True
    m.normalizer_spec.escape_whitespaces = True
    m.normalizer_spec.remove_extra_whitespaces = False
    m.pieces.add(piece="<unk>", score=0, type=2)
    for p in {"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(60)} | {"a", "b", "▁"}:
        m.pieces.add(piece=p, score=-rng.random() * 10, type=1)
    path = str(tmp_path / "m.model")
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    v = P.vocabulary(path)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 9))) for _ in range(40)] + ["ca", "accb"]
    got = {r.doc_id: r.ids for r in P.encode(make(spark, list(enumerate(texts))), path).collect()}

    def best(s):
        if not s:
            return 0.0
        return max((v.table[s[:k]][1] if s[:k] in v.table else v.lowest) + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in v.table or k == 1)

    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    for i, t in enumerate(texts):
        if "c" not in t:
            assert abs(sum(v.scores[x] for x in got[i]) - best(P.normalised(t, v))) < 1e-6, t
            assert abs(sum(v.scores[x] for x in got[i]) - sum(v.scores[x] for x in lib.encode(t))) < 1e-4
        assert P.decode(spark.createDataFrame([(got[i],)], "ids array<int>"), path).first().text == lib.decode(got[i])


def brute_units(docs):
    """Spans that repeat an earlier unit, by plain regular expressions."""
    all_ = []
    for d, t in docs:
        if d is None or t is None:
            continue
        b = t.encode()
        at, ends = 0, [m.start() for m in re.finditer(rb"\n", b)] + [m.end() for m in re.finditer(rb"[.!?](?=[\t\n\r ])", b)] + [len(b)]
        for e in sorted(set(ends)):
            toks = tokens(b[at:e].decode())
            if len(toks) >= LEAST:
                base = len(b[:at].decode())
                all_.append((tuple(x[2] for x in toks), d, base + toks[0][0], len(b[:e].decode()), len(toks)))
            at = e
    first = {}
    for key, d, s, _, _ in sorted(all_, key=lambda x: (x[1], x[2])):
        first.setdefault(key, (d, s))
    return {(d, s, e, n, *first[k]) for k, d, s, e, n in all_ if first[k] != (d, s)}


def test_units_by_brute_force(spark, sf):
    docs = table(spark, sf.replace("sf0.001", "sf0.01"), "documents")
    want = brute_units([(r.doc_id, r.text) for r in docs.collect()])
    assert want and {tuple(r) for r in repeated_units(docs).collect()} == want


def test_units_of_texts_that_share_an_id(spark):
    s = "One two three four five six seven eight nine."
    other = "ABCDEFGHIJ klmnopqrst uvwxyz text under the same id, nothing repeats"
    docs = make(spark, [(1, f"{s} tail"), (2, f"{s} x"), (2, other)])
    for whole in (False, True):
        assert {(r.doc_id, r.text) for r in without_repeated_units(docs, whole=whole).collect()} == {(1, f"{s} tail"), (2, " x"), (2, other)}


def test_units_edges(spark):
    s = "One two three four five six seven eight nine."
    texts = [(1, f"{s} Short one.\n{s.upper()}"), (2, f"Été. {s}  Tail"), (3, None), (None, s), (4, ""), (5, s), (5, s), (6, "word " * 50_000), (7, "short. short. short.")]
    docs = make(spark, texts)
    got = {tuple(r) for r in repeated_units(docs).collect()}
    assert got == brute_units(texts) and {(r[0], r[4], r[5]) for r in got} == {(1, 1, 0), (2, 1, 0), (5, 1, 0)}
    left = without_repeated_units(docs)
    by = {r.doc_id: r for r in left.collect()}
    assert set(by) == {1, 2, 3, None, 4, 6, 7} and by[1].text == f"{s} Short one.\n" and by[2].text == "Été.   Tail" and by[2].n_chars == len(by[2].text) and by[None].text == s
    assert repeated_units(docs.limit(0)).count() == 0
    clash = docs.selectExpr("*", "1 AS h1", "2 AS unit_doc", "3 AS unit_spans", "4 AS first")
    assert without_repeated_units(clash).columns == clash.columns and {tuple(r) for r in repeated_units(clash).collect()} == got


def brute_whole(docs):
    """brute_units with whole lines, and runs of the fewest sentences around short ones."""
    all_ = set()
    for d, t in docs:
        b, at = t.encode(), 0
        for line in b.split(b"\n"):
            ends = [m.end() for m in re.finditer(rb"[.!?](?=[\t\r ]|$)", line)] + [len(line)]
            cuts = [(s, e, tokens(line[s:e].decode())) for s, e in zip([0, *ends], ends)]
            cuts = [(s, e, w) for s, e, w in cuts if w]
            n = [len(w) for *_, w in cuts]
            spans = {(i, i) for i in range(len(n)) if n[i] >= LEAST}
            for i in range(len(n)):
                spans |= set([(i, j) for j in range(i, len(n)) if sum(n[i : j + 1]) >= LEAST][:1])
                spans |= set([(j, i) for j in range(i, -1, -1) if sum(n[j : i + 1]) >= LEAST][:1])
            for i, j in spans | ({(0, len(n) - 1)} if n else set()):
                words = tuple(x[2] for *_, w in cuts[i : j + 1] for x in w)
                base = len(b[: at + cuts[i][0]].decode())
                all_.add((words, d, base + cuts[i][2][0][0], base + len(line[cuts[i][0] : cuts[j][1]].decode()), len(words)))
            at += len(line) + 1
    first = {}
    for k, d, s, e, _ in sorted(all_, key=lambda x: x[1:4]):
        first.setdefault(k, (d, s, e))
    return {(d, s, n, *first[k][:2]) for k, d, s, _, n in all_ if first[k][:2] != (d, s) and (d != first[k][0] or s >= first[k][2])}


def test_whole_units_by_brute_force(spark, sf):
    docs = table(spark, sf.replace("sf0.001", "sf0.01"), "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    want = brute_whole([(r.doc_id, r.text) for r in docs.collect()])
    got = {(r.doc_id, r.start, r.n_words, r.kept_doc_id, r.kept_start) for r in repeated_units(docs, whole=True).collect()}
    assert got == want and {tuple(r) for r in repeated_units(docs).collect()} and min(x[2] for x in got) == 1


def test_whole_units_edges(spark):
    run = " ".join(f"Say w{i} now{i}." for i in range(20))  # 60 words, none of its sentences has 8
    texts = [(1, f"Released under the MIT license\nAlpha beta. {run} Gamma."), (2, "Some text.\nreleased under the mit license!  \n\nMore"), (3, f"Delta. {run} Epsilon zeta."), (4, "more\nno. no. no."), (5, "a b. " * 40), (6, "")]
    docs = make(spark, texts)
    by = {r.doc_id: r.text for r in without_repeated_units(docs, whole=True).collect()}
    assert by == {1: texts[0][1], 2: "Some text.\n\n\nMore", 3: "Delta.  Epsilon zeta.", 4: "\nno. no. no.", 5: by[5], 6: ""}
    assert len(tokens(by[5])) == 8
    assert {(r.doc_id, r.start, r.n_words, r.kept_doc_id, r.kept_start) for r in repeated_units(docs, whole=True).collect()} == brute_whole(texts)


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        got = H.common(a, b)
        assert got == sorted(set(got)) and len(got) == lcs(a, b)
        it = iter(b)
        assert all(a[i] in it for i in got)


def page(*body):
    return "<html><head><title>t</title></head><body>" + "".join(f"<p>{x}</p>" for x in body) + "</body></html>"


def test_pages(spark):
    nav, foot = "Home &amp; more", "© all"
    pages = [
        (1, "http://A.org/x/1", page(nav, "one", foot)), (2, "http://a.org/x/2.html?q=1", page(nav, "two", "two b", foot)), (3, "http://a.org/y", page("other", foot)),
        (4, "http://b.org/x/1", page(nav, "alone", foot)), (5, None, None), (6, "http://c.org/p", page("same")), (7, "http://c.org/q", page("same")), (8, "http://a.org/x/1/#top", page(nav, "again", foot)), (8, "http://a.org/x/1/#top", page(nav, "again", foot)), (9, "", ""),
        (10, "http://d.org/", "<script>x = '<p>no</p>'</script>a<br>b <b>c</b>\nd<!-- no -->" + "<p>z</p>" * 5000),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for rows in (10**6, 2):
        got = sorted((r.page_id, r.text, r.n_removed) for r in H.main_text(df, partition_rows=rows).collect())
        assert got[:4] == [(1, "one", 2), (2, "two\ntwo b", 2), (3, "other", 1), (4, f"Home & more\nalone\n{foot}", 0)]
        assert [g[:2] for g in got[4:10]] == [(5, ""), (6, "same"), (7, "same"), (8, "again"), (8, "again"), (9, "")]
        assert got[10][1].split("\n")[:2] == ["a", "b c d"] and len(got[10][1].split("\n")) == 5002
    assert H.main_text(df.limit(0)).count() == 0
    clash = df.selectExpr("*", "1 AS host", "2 AS path", "3 AS hashes", "4 AS near")
    assert sorted(map(str, H.main_text(clash).collect())) == sorted(map(str, H.main_text(df).collect()))


def test_pairing_by_brute_force(spark):
    """Each page's neighbour is the one beside it, in order, that begins like it the longest."""
    rng = random.Random(5)
    keys = sorted({(rng.choice(["a.org", "b.org", "c.org"]), "".join(rng.choice(["/", "x", "xy", "é", "-1", "2"]) for _ in range(rng.randint(0, 7)))) for _ in range(300)} | {("lone.org", "/p")}, key=lambda k: (k[0].encode(), k[1].encode()))

    def like(a, b):
        n = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        return n(a.split("/"), b.split("/")), n(a, b)

    want = set()
    for k, (h, p) in enumerate(keys):
        prev = keys[k - 1][1] if k and keys[k - 1][0] == h else None
        after = keys[k + 1][1] if k + 1 < len(keys) and keys[k + 1][0] == h else None
        if prev is not None or after is not None:
            want.add((h, p, after if prev is None or after is not None and like(p, after) > like(p, prev) else prev))
    df = spark.createDataFrame(keys, "host string, path string")
    for rows in (10**6, 17):
        assert {tuple(r) for r in H.neighbours(df, rows).collect()} == want


def test_lines_that_repeat_very_often():
    a, b = ["0"] * 20_000 + ["x"] + ["0"] * 20_000, ["y"] + ["0"] * 30_000 + ["x", "0"]
    assert len(H.common(a, b)) == 30_001
