import random

import numpy as np
from compare import compare, connect

from docframe.llm import topk
from docframe.llm.common import table
from docframe.llm.packing import pack

SCHEMA = "doc_id long, text string"


def test_nearest_against_sql(spark, sf):
    from docframe.llm import queries

    assert compare(spark, connect(sf), sf, queries.op8_topk, topk.SQL) > 0


def brute(rows, k):
    out = set()
    for i, v in rows:
        far = sorted((round(sum((float(np.float32(a)) - float(np.float32(b))) ** 2 for a, b in zip(v, w)), 6), j) for j, w in rows if j != i and len(w) == len(v))
        out |= {(i, r, j, d) for r, (d, j) in enumerate(far[:k], 1)}
    return out


def test_nearest_by_brute_force(spark):
    rng = random.Random(1)
    centers = [[rng.gauss(0, 5) for _ in range(40)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centers)]) for i in range(300)]
    rows += [(1000 + i, list(rows[7][1])) for i in range(15)] + [(2000 + i, [float(i), 0.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for size in (2048, 50):
        for pivots in (64, 3, 0):
            got = {(r.vec_id, r.rank, r.neighbour, r.distance) for r in topk.nearest(df, k=5, block_rows=size, pivots=pivots).collect()}
            assert got == brute(rows, 5)
    some = df.where("vec_id % 7 = 0")
    assert {tuple(r) for r in topk.nearest(df, some, k=5, block_rows=50).collect()} == {x for x in brute(rows, 5) if x[0] % 7 == 0}
    # ids of another type, in an order of their own
    names = {str(i): i for i, _ in rows}
    named = df.selectExpr("CAST(vec_id AS STRING) AS vec_id", "embedding")
    got = {tuple(r) for r in topk.nearest(named, named.where("vec_id % 7 = 0"), k=300).collect()}
    assert {(names[a], names[b], d) for a, _, b, d in got} == {(a, b, d) for a, _, b, d in brute(rows, 300) if a % 7 == 0}


def test_nearest_edges(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (None, [0.0, 0.0]), (4, []), (5, [float("nan"), 0.0]), (6, [1.0, None]), (7, [float("inf"), 1.0]), (2, [1.0, 0.0]), (8, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = {(1, 1, 2, 1.0), (2, 1, 1, 1.0)}
    assert {tuple(r) for r in topk.nearest(df).collect()} == want
    clash = df.selectExpr("*", "1 AS id", "2 AS block", "3 AS v", "4 AS label")
    assert {tuple(r) for r in topk.nearest(clash).collect()} == want
    assert topk.nearest(df.limit(0)).count() == 0


def check(rows, texts, capacity):
    """Every token of every document once, nothing overlaps, nothing overflows."""
    want, got = [], []
    for d, t in texts:
        if t is not None:
            n = len(t.encode()) + 1
            want += [(str(d), p, p * capacity, min(capacity, n - p * capacity)) for p in range(-(-n // capacity))]
    got = [(str(r.doc_id), r.part, r.start, r.n_tokens) for r in rows]
    assert sorted(got) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence, []).append((r.offset, r.n_tokens))
    for x in by.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= capacity
    return by


def best_fit(sizes, capacity):
    """The number of sequences of sequential best-fit, largest first."""
    gaps = []
    for n in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= n]
        g = min(fit) if fit else capacity
        if fit:
            gaps.remove(g)
        gaps.append(g - n)
    return len(gaps)


def test_packing(spark):
    rng = random.Random(2)
    texts = [(i, "x" * int(rng.paretovariate(1.1) * 5)) for i in range(400)] + [(None, "abc"), (5, "é" * 30), (5, "é" * 30), (6, ""), (7, None), (8, "y" * 99), (9, "z" * 100)]
    df = spark.createDataFrame(texts, SCHEMA)
    one = pack(df, capacity=100).collect()
    by = check(one, texts, 100)
    sizes = [r.n_tokens for r in one]
    assert len(by) <= 1.03 * best_fit(sizes, 100) + 1
    # the same whatever the partitioning
    assert sorted(map(str, pack(df, capacity=100, partition_rows=40).collect())) == sorted(map(str, one))


def test_packing_edges(spark, sf):
    df = spark.createDataFrame([(1, "a")], SCHEMA)
    assert pack(df.limit(0)).count() == 0 and pack(df.limit(0)).columns == pack(df).columns
    docs = table(spark, sf, "documents")
    clash = docs.selectExpr("*", "1 AS size", "2 AS bin", "3 AS kind", "4 AS whole")
    rows = pack(clash).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], 8192)
