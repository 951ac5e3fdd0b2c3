import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from docframe.llm import common, katz, ngrams
from docframe.llm.common import inflated, table
from docframe.llm.langid import features, in_declared_language, languages, predicted, svm, train
from docframe.llm.quality import LOWER, SPREAD, UPPER, in_band, perplexity_bands

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts):
    return spark.createDataFrame([(d, t, l, "s", len(t) if t is not None else None) for d, t, l in texts], SCHEMA)


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(n))


def brute_katz(texts, order, cutoff, least):
    """log p(token | context) by plain dictionaries."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = [ngrams.START] * (order - 1) + list(t.encode()) + [ngrams.END]
        for i in range(order - 1, len(s)):
            for n in range(1, order + 1):
                counts[n][tuple(s[i - n + 1 : i + 1])] += 1
    levels = {}

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / ngrams.VOCABULARY
        probs, weights = levels[n]
        if gram in probs:
            return probs[gram]
        return weights.get(gram[:-1], 1.0) * p(gram[1:])

    for n in range(1, order + 1):
        of = Counter(counts[n].values())
        ratio = [1.0] * (cutoff + 1)
        if of[1]:
            common = (cutoff + 1) * of[cutoff + 1] / of[1]
            for r in range(1, cutoff + 1):
                if of[r] and common < 1:
                    x = ((r + 1) * of[r + 1] / of[r] / r - common) / (1 - common)
                    if 0 < x <= 1:
                        ratio[r] = x
        by = defaultdict(dict)
        for g, c in counts[n].items():
            by[g[:-1]][g] = c
        probs, weights = {}, {}
        for h, grams in by.items():
            total = sum(grams.values())
            own = {g: (1.0 if c > cutoff else ratio[c]) * c / total for g, c in grams.items() if not (n > 2 and c < least)}
            low = sum(p(g[1:]) for g in own)
            mass = sum(own.values())
            if mass > 1 - 1e-9 and low < 1 - 1e-12:
                share = total / (total + 0.5)
                own, mass = {g: x * share for g, x in own.items()}, mass * share
            if low >= 1 - 1e-12:
                own, weights[h] = {g: x / mass for g, x in own.items()}, 1.0
            else:
                weights[h] = (1 - mass) / (1 - low)
            probs |= own
        levels[n] = (probs, weights)
    return p, levels


def test_katz_by_brute_force(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(30)] + ["", "é", "aaaa" * 50]
    docs = make(spark, [(i, t, "en") for i, t in enumerate(texts)])
    p, levels = brute_katz(texts, 5, 5, 1)
    # each distribution sums to one
    for h in list(levels[3][1])[:50]:
        assert abs(sum(p((*h, x)) for x in range(256) if x != ngrams.START) - 1) < 1e-6
    for group in (1 << 24, 200):
        got = {r.doc_id: r for r in katz.katz_scores(docs, order=5, group_bytes=group).collect()}
        for i, t in enumerate(texts):
            s = [ngrams.START] * 4 + list(t.encode()) + [ngrams.END]
            want = sum(math.log(p(tuple(s[k - 4 : k + 1]))) for k in range(4, len(s)))
            assert got[i].n_tokens == len(s) - 4
            assert abs(got[i].log_prob - want) < 1e-4 * max(1, abs(want)), (i, t)
            assert abs(got[i].perplexity - math.exp(-want / (len(s) - 4))) < 1e-3 * got[i].perplexity


def test_katz_edges(spark):
    docs = make(spark, [(1, None, "en"), (2, "", "en"), (None, "ab", None), (3, "x" * 200_000, "en"), (3, "x", "en")])
    got = katz.katz_scores(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 0), ("2", 1), ("3", 2), ("3", 200001), ("None", 3)]
    assert next(r for r in got if r.doc_id == 1).log_prob is None
    assert katz.katz_scores(docs.limit(0)).count() == 0
    clash = docs.selectExpr("*", "1 AS g", "2 AS block", "3 AS blob")
    assert sorted(map(str, katz.katz_scores(clash).collect())) == sorted(map(str, got))
    with pytest.raises(ValueError):
        katz.katz_scores(docs, order=3)


def brute_kneser_ney(texts, order):
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = [ngrams.START] * (order - 1) + list(t.encode()) + [ngrams.END]
        for i in range(order - 1, len(s)):
            counts[order][tuple(s[i - order + 1 : i + 1])] += 1
    for n in range(order - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] += 1
    cut, total, rest = {}, {}, {}
    for n in range(1, order + 1):
        of = Counter(counts[n].values())
        d = [0, 0.5, 1.0, 1.5]
        if of[1] and of[2]:
            y = of[1] / (of[1] + 2 * of[2])
            for i in (1, 2, 3):
                if of[i] and 0 < (x := i - (i + 1) * y * of[i + 1] / of[i]) < i:
                    d[i] = x
        cut[n], total[n], rest[n] = d, Counter(), Counter()
        for g, c in counts[n].items():
            total[n][g[:-1]] += c
            rest[n][g[:-1]] += d[min(c, 3)]

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / ngrams.VOCABULARY
        c, h = counts[n][g], g[:-1]
        return max(0, c - cut[n][min(c, 3)]) / total[n][h] + rest[n][h] / total[n][h] * p(g[1:])

    return p


def median(xs):
    xs = sorted(xs)
    n = len(xs)
    return xs[n // 2] if n % 2 else (xs[n // 2 - 1] + xs[n // 2]) / 2


def test_kneser_ney_and_bands_by_brute_force(spark):
    rng = random.Random(6)
    texts = {l: [prose(rng, rng.randint(1, 50), letters) for _ in range(20)] for l, letters in (("en", "abcde"), ("de", "vwxyz"))}
    docs = make(spark, [(f, t, l) for f, (t, l) in enumerate((t, l) for l in texts for t in texts[l])])
    for order in (4, 6):
        got = {r.doc_id: r for r in perplexity_bands(docs, order).collect()}
        for l, first in (("en", 0), ("de", 20)):
            p = brute_kneser_ney(texts[l], order)
            wants = []
            for i, t in enumerate(texts[l]):
                s = [ngrams.START] * (order - 1) + list(t.encode()) + [ngrams.END]
                wants.append((-sum(math.log(p(tuple(s[k - order + 1 : k + 1]))) for k in range(order - 1, len(s))) / len(t.encode() + b"."), len(t) + 1))
                assert abs(math.log(got[first + i].perplexity) - wants[-1][0]) < 1e-4
            middle = median([x for x, _ in wants])
            deviation = 1.4826 * median([abs(x - middle) * n**0.5 for x, n in wants])
            for i, (x, n) in enumerate(wants):
                half = (deviation**2 / n + SPREAD**2) ** 0.5
                r = got[first + i]
                assert abs(math.log(r.lower) - (middle - LOWER * half)) < 0.02 and abs(math.log(r.upper) - (middle + UPPER * half)) < 0.02
                assert r.keep == (r.lower <= r.perplexity <= r.upper)


def test_counts_of_many_tasks(spark):
    """Counts don't depend on how the rows are divided into tasks."""
    rng = random.Random(9)
    docs = make(spark, [(i, prose(rng, 30), "en") for i in range(200)])
    want = Counter()
    for r in docs.collect():
        s = [ngrams.START] * 4 + list(r.text.encode()) + [ngrams.END]
        want.update(tuple(s[i - 4 : i + 1]) for i in range(4, len(s)))
    for parts in (1, 150):
        got = Counter()
        for r in ngrams.counts(docs.repartition(parts), 5, 16).collect():
            code, count = inflated(bytes(r.part), ["u8", "i8"], 1)
            for c, k in zip(code.tolist(), count.tolist()):
                b = c.to_bytes(8, "big")[3:]
                got[(b[3], b[2], b[1], b[0], b[4])] += k
        assert got == want


def test_quality_keeps_prose_and_rejects_junk(spark, sf):
    docs = table(spark, sf, "documents")
    rows = perplexity_bands(docs).collect()
    assert len(rows) == docs.count() and sum(r.keep for r in rows) > 0.85 * len(rows)
    rng = random.Random(7)
    junk = make(spark, [(10**6, "".join(chr(rng.randint(33, 126)) for _ in range(3000)), "en"), (10**6 + 1, "the " * 900, "en")])
    got = {r.doc_id: r.keep for r in perplexity_bands(docs.unionByName(junk)).collect() if r.doc_id >= 10**6}
    assert got == {10**6: False, 10**6 + 1: False}


def test_quality_rejects_labelled_junk(spark, sf):
    at = sf.replace("sf0.001", "sf0.01")
    labels = table(spark, at, "labels").select("doc_id", "quality")
    rows = perplexity_bands(table(spark, at, "documents")).join(labels, "doc_id").collect()
    junk, clean = ([not r.keep for r in rows if r.quality == k] for k in (0, 1))
    assert sum(junk) > 0.55 * len(junk) and sum(clean) < 0.04 * len(clean), (sum(junk), len(junk), sum(clean), len(clean))


def test_quality_edges(spark):
    rng = random.Random(8)
    docs = make(spark, [(1, None, "en"), (2, "", "en"), (3, prose(rng, 50), None), (3, prose(rng, 50), None), (None, prose(rng, 50_000), "en")])
    rows = perplexity_bands(docs).collect()
    assert len(rows) == 5 and [r.keep for r in rows if r.doc_id == 1] == [False]
    clash = docs.selectExpr("*", "1 AS n_tokens", "2 AS band_lang", "3 AS in_band", "4 AS model_lang")
    assert in_band(clash).columns == clash.columns and in_band(docs.limit(0)).count() == 0


def test_languages_held_out(spark, sf):
    """Declared languages are found again in rows that the model wasn't fitted on."""
    docs = table(spark, sf.replace("sf0.001", "sf0.01"), "documents")
    model = train(docs.where("doc_id % 2 = 0"), sample=60)
    out, (best, _, ok) = predicted(docs.where("doc_id % 2 = 1 AND n_chars >= 200"), model)
    rows = out.collect()
    assert len(rows) > 300 and sum(r.lang == r[best] for r in rows) >= 0.95 * len(rows)
    assert sum(r[ok] for r in rows) >= 0.95 * len(rows)


def test_support_vectors_by_brute_force(spark):
    """The fitted machine minimises the squared hinge loss: no small step from it lowers it, and plain descent ends there."""
    rng = np.random.default_rng(1)
    x = rng.random((60, 8)).astype(np.float32)
    y = np.where(x[:, 0] + 0.2 * rng.standard_normal(60) > 0.5, 1, -1).astype(np.float32)
    w, bias, usual = svm(x, y, rounds=20000)
    scale = 1 / np.sqrt((x.astype(float) ** 2).sum() / len(x))
    each = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())

    def loss(v):
        return (each * np.maximum(0, 1 - y * (x * scale @ v[:-1] + v[-1])) ** 2).sum() + 0.005 * (v @ v)

    v = np.zeros(9)
    for _ in range(20000):
        slack = np.maximum(0, 1 - y * (x * scale @ v[:-1] + v[-1]))
        grad = -2 * (each * y * slack) @ np.column_stack([x * scale, np.ones(60)]) + 0.01 * v
        v -= 0.3 * grad
    got = np.append(w / scale, bias)
    assert loss(got) <= loss(v) + 1e-4 and np.abs(got - v).max() < 0.02
    share = x.mean(axis=0)
    assert abs(usual - (share @ w**2 - (share @ w) ** 2)) < 1e-3


def test_short_texts_are_learnt_and_judged(spark):
    en, fr = "the cat and the dog with the hat", "le chat et la souris avec le chien"
    docs = make(spark, [(i, f"{en} {i}", "en") for i in range(50)] + [(100 + i, f"{fr} {i}", "fr") for i in range(50)] + [(999, f"{en} and the other dog {en} that {en}", "fr")])
    got = {r.doc_id: (r.predicted_lang, r.keep) for r in languages(docs).collect()}
    assert got.pop(999) == ("en", False)
    assert all(v == ("en" if k < 100 else "fr", True) for k, v in got.items())


def test_short_texts_of_a_wrong_tag(spark, sf):
    """Passages of 120 characters tagged with the other language of their family, and with their own."""
    docs = table(spark, sf.replace("sf0.001", "sf0.01"), "documents").where("text IS NOT NULL AND lang IS NOT NULL")
    model = train(docs)
    cut = docs.where("length(text) >= 600").selectExpr("substring(text, 200, 120) AS text", "lang")
    wrong = cut.selectExpr("text", "CASE lang WHEN 'en' THEN 'de' WHEN 'de' THEN 'en' WHEN 'fr' THEN 'es' ELSE 'fr' END AS lang")
    for df, least, most in ((cut, 0, 0.01), (wrong, 0.95, 1)):
        out, (_, _, ok) = predicted(df, model)
        kept = [r[ok] for r in out.collect()]
        assert least <= kept.count(False) / len(kept) <= most


def test_languages_edges(spark, sf):
    docs = table(spark, sf, "documents")
    en = docs.where("lang = 'en' AND n_chars > 2000").first().text
    odd = make(spark, [(-1, None, "en"), (-2, "", "fr"), (-3, "12345 !!", "fr"), (-4, en, "fr"), (-5, en, None), (-6, en, "xx"), (None, en * 20, "en")])
    got = {r.doc_id: (r.predicted_lang, r.keep) for r in languages(docs.unionByName(odd)).collect() if r.doc_id is None or r.doc_id < 0}
    assert got == {-1: (None, False), -2: (None, True), -3: (None, True), -4: ("en", False), -5: ("en", True), -6: ("en", True), None: ("en", True)}
    assert languages(docs.limit(0)).count() == 0
    clash = docs.selectExpr("*", "1 AS lead", "2 AS lang_kept", "3 AS predicted_lang", "4 AS langid_text")
    assert in_declared_language(clash).columns == clash.columns


def test_what_workers_hold():
    """Memory of what workers do again and again: in proportion to the texts' trigrams, to a slice, and kept within bounds."""
    rng = np.random.default_rng(2)
    words = np.array(["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(500)])
    texts = [" ".join(rng.choice(words, 40)) for _ in range(4000)]

    def most(f):
        tracemalloc.start()
        out = f()
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        return out, peak

    x, peak = most(lambda: features(pa.array(texts)))
    assert len(x) == 4000 and peak < 80  # 4,000 rows of all columns take 131 MB
    _, peak = most(lambda: svm(x, np.where(np.arange(4000) % 2, 1, -1).astype(np.float32), rounds=2))
    assert peak < 40
    large = pa.array([" ".join(texts)] * 8)
    code, _ = ngrams.text_counts(large, 6)
    (n, total), peak = most(lambda: ngrams.sums(large, code, np.zeros(len(code), np.float32), 6))
    assert len(set(n.tolist())) == 1 and not total.any() and peak < 150
    common.spans_hash(np.zeros(5 << 20, np.uint8), np.zeros(1, np.int64), np.full(1, 5 << 20))
    assert sum(len(p) for pair in common._powers.values() for p in pair) <= 4 * common.KEPT
