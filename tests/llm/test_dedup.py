import itertools
import random

from brute import groups, jaccard, passages, tokens
from pyspark.sql import functions as F

from docframe.llm.common import table
from docframe.llm.minhash import near_duplicates, without_near_duplicates
from docframe.llm.suffixes import repeated_passages, without_repeated_passages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return {tuple(r) for r in df.collect()}


def make(spark, texts):
    return spark.createDataFrame([(d, t, "en", "s", len(t) if t is not None else None) for d, t in texts], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(n))


def test_near_duplicates_of_the_table(spark, sf):
    docs = table(spark, sf, "documents")
    got = {r.doc_id: r.duplicate_of for r in near_duplicates(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    near = [(a, b) for a, b in itertools.combinations(sorted(texts), 2) if jaccard(texts[a], texts[b]) >= 0.65]
    sure = groups(near)
    far = groups([(a, b) for a, b in itertools.combinations(sorted(texts), 2) if jaccard(texts[a], texts[b]) >= 0.35])
    assert near
    assert sum(x in got for x in sure) >= 0.97 * len(sure)
    assert all(x in far for x in got)
    assert all(jaccard(texts[x], texts[y]) > 0.2 for x, y in got.items())


def test_near_duplicates_edges(spark):
    rng = random.Random(1)
    a, b = prose(rng, 200), prose(rng, 200)
    near = a.replace(a.split()[50], "zzz", 1)
    docs = make(spark, [(1, a), (2, a), (3, near), (4, b), (5, ""), (6, ""), (7, None), (None, a), (8, "  "), (9, "x"), (10, "X."), (11, "&&& !!"), (12, "&&& !!"), (4, b), (13, "é" * 100_000 + " " + prose(rng, 50_000))])
    assert rows(near_duplicates(docs)) == {(2, 1), (3, 1), (10, 9), (12, 11)}
    left = without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [1, 4, 5, 6, 7, 8, 9, 11, 13]
    assert left.where("doc_id IS NULL").count() == 1
    assert near_duplicates(docs.limit(0)).count() == 0
    clash = docs.selectExpr("*", "1 AS doc", "2 AS sig", "3 AS gone_id", "4 AS root")
    assert rows(near_duplicates(clash)) == rows(near_duplicates(docs))
    assert without_near_duplicates(clash).columns == clash.columns


def test_texts_that_share_an_id(spark):
    """No text vanishes for its id; each is compared and cut for itself."""
    rng = random.Random(4)
    a, b, c = prose(rng, 120), prose(rng, 130), "completely different words here now"
    docs = make(spark, [(1, a), (2, a), (2, b), (2, b), (3, b), (3, c), (4, None), (4, None), (5, ""), (5, "")])
    assert rows(near_duplicates(docs)) == {(2, 1), (3, 2)}
    left = [(r.doc_id, r.text) for r in without_near_duplicates(docs).collect()]
    assert sorted(map(str, left)) == sorted(map(str, [(1, a), (2, b), (3, c), (4, None), (4, None), (5, ""), (5, "")]))
    cut = {(r.doc_id, r.text) for r in without_repeated_passages(make(spark, [(1, f"{a} end"), (2, f"{a} x"), (2, c)])).collect()}
    assert cut == {(1, f"{a} end"), (2, " x"), (2, c)}


def test_groups_that_meet_only_off_the_smallest_id(spark):
    """Chains of near copies are one group, however their buckets are led."""
    rng = random.Random(2)
    words = prose(rng, 300).split()
    texts = []
    for i in range(12):
        texts.append((100 - i, " ".join(words)))
        for k in range(8):
            words[(i * 8 + k) * 3 % 300] = f"w{i}x{k}"
    got = {r.doc_id: r.duplicate_of for r in near_duplicates(make(spark, texts)).collect()}
    near = groups([(a, b) for (a, x), (b, y) in itertools.combinations(texts, 2) if jaccard(x, y) > 0.62])
    assert near and set(near) <= set(got) and set(got.values()) == {89}


def test_repeated_passages_by_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = passages(texts, 50)
    assert want
    for group in (1 << 24, 20_000):
        assert rows(repeated_passages(docs, group_bytes=group)) == want


def test_ids_that_are_no_integers(spark, sf):
    """Ids in an order of their own give the same groups and passages."""
    docs = table(spark, sf, "documents").limit(300).cache()
    named = docs.withColumn("doc_id", F.format_string("%08d", "doc_id"))
    assert {(f"{a:08d}", *x) for a, *x in rows(repeated_passages(docs))} == rows(repeated_passages(named))
    assert {(f"{a:08d}", f"{b:08d}") for a, b in rows(near_duplicates(docs))} == rows(near_duplicates(named))
    assert rows(without_repeated_passages(named)) == {(f"{r[0]:08d}", *r[1:]) for r in rows(without_repeated_passages(docs))}


def test_repeated_passages_edges(spark):
    rng = random.Random(3)
    a, b, p = prose(rng, 80), prose(rng, 70), prose(rng, 55)
    texts = [(1, a), (2, f"Início. {p}, {b}"), (3, f"{prose(rng, 30)} {p.upper()}\n{prose(rng, 40)} {p}!"), (4, "x " * 300), (5, None), (None, a), (6, ""), (7, a), (7, a), (8, prose(rng, 100_000))]
    docs = make(spark, texts)
    want = passages(texts, 50)
    assert rows(repeated_passages(docs)) == want
    assert {w[0] for w in want} == {3, 4, 7}
    left = without_repeated_passages(docs).collect()
    by = {r.doc_id: r for r in left}
    assert sorted(str(r.doc_id) for r in left) == sorted(["1", "2", "3", "4", "5", "6", "8", "None"])
    assert by[1].text == a and by[5].text is None and by[None].text == a
    assert p not in by[3].text.lower() and by[3].n_chars == len(by[3].text)
    assert len(tokens(by[4].text)) == 50
    assert repeated_passages(docs.limit(0)).count() == 0
    clash = docs.selectExpr("*", "1 AS suffix_doc", "'a' AS one", "2 AS doc", "3 AS suffix_from")
    assert rows(repeated_passages(clash)) == want
    assert without_repeated_passages(clash).columns == clash.columns


def test_nothing_repeats_after_cutting(spark, sf):
    docs = without_repeated_passages(table(spark, sf, "documents"))
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(kept) > 100
    for r, t in kept:
        assert tokens(t) or not t.strip() or not any(c.isalnum() for c in t)
