import itertools
import math
import os
import random

import corpus_pipeline
from brute import groups, jaccard, passages, tokens
from test_dedup import rows, table
from test_scores import brute_kneser_ney, median
from test_search_packing import check

from docframe.llm import ngrams
from docframe.llm.common import written
from docframe.llm.langid import languages
from docframe.llm.minhash import near_duplicates
from docframe.llm.packing import pack
from docframe.llm.quality import LOWER, ORDER, SPREAD, UPPER, perplexity_bands
from docframe.llm.suffixes import without_repeated_passages


def test_stages(spark, sf):
    """Each stage's decisions take effect on all that the one before kept."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_duplicates", "passages", "packing"]
    docs = table(spark, sf, "documents")
    columns = docs.columns
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf), name)
        at[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    a, b = at["quality"]
    assert ids(b) == sorted(r.doc_id for r in perplexity_bands(a).collect() if r.keep) and len(ids(b)) > 0.8 * len(ids(a))
    a, b = at["language"]
    assert ids(b) == sorted(r.doc_id for r in languages(a).collect() if r.keep)
    a, b = at["near_duplicates"]
    assert ids(b) == sorted(set(ids(a)) - {r.doc_id for r in near_duplicates(a).collect()})
    a, b = at["passages"]
    assert rows(b) == rows(without_repeated_passages(a))
    a, b = at["packing"]
    assert rows(b) == rows(pack(a))
    assert rows(corpus_pipeline.run(spark, sf)) == rows(b)


def test_stages_on_odd_rows(spark, sf):
    """Nulls, empty, blank and long texts, repeated rows, shared ids and clashing columns, through all stages."""
    docs = table(spark, sf, "documents")
    long_ = " ".join(r.text for r in docs.where("lang = 'en' AND n_chars > 1500").limit(40).collect())
    odd = [(-1, None, "en"), (-2, "", "en"), (-3, " \n", None), (None, long_, "en"), (-4, long_, "en"), (-4, long_, "en"), (-4, "other words of the same id", "en"), (None, None, None), (-5, "12345 !!", "xx")]
    more = spark.createDataFrame([(d, t, l, None, None) for d, t, l in odd], docs.schema)
    names = ["doc", "sub", "g", "blob", "block", "part", "c0", "body", "word", "sig", "root", "size", "kind", "n_tokens", "lead", "in_band"]
    docs = docs.unionByName(more).selectExpr("*", *[f"'x' AS {n}" for n in names])
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "quality":
            assert docs.where("text IS NULL").count() == 0
        if name == "near_duplicates":
            assert docs.groupBy("doc_id", "text").count().where("doc_id IS NOT NULL AND text <> '' AND count > 1").count() == 0
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    none = table(spark, sf, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = written(stage(spark, none, sf), name)
        assert none.count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    q = entry.queries()
    assert [next(k for k in q if k.startswith(f"op{n}_")) for n in range(1, 11)] and "pipeline" in q
    assert set(entry.oracle_sql()) <= set(q)
    assert not os.path.exists("spark-warehouse/x")


def words(rng, letters, n):
    """Words of a language: of few letters each, some much more frequent than others."""
    known = [["".join(random.Random(f"{letters}{k}").choice(letters) for _ in range(2 + k % 4)) for k in range(60)]][0]
    return [known[int(len(known) * rng.random() ** 2)] for _ in range(n)]


def test_stages_by_brute_force(spark):
    """On a small corpus each stage is what plain Python makes of that stage's own input."""
    rng = random.Random(11)
    rows_, d = [], 0
    for lang, letters in (("en", "abcdefgh"), ("de", "stuvwxyz")):
        for _ in range(60):
            d += 1
            rows_.append((d, " ".join(words(rng, letters, rng.randint(90, 160))), lang))
    passage = " ".join(words(rng, "abcdefgh", 55))
    rows_ += [(201, rows_[0][1], "en"), (202, rows_[1][1].replace(" ", "  ", 3) + " new", "en"), (203, f"{' '.join(words(rng, 'abcdefgh', 130))} {passage}", "en"), (204, f"{passage} {' '.join(words(rng, 'abcdefgh', 130))}", "en"), (205, rows_[70][1], "en"), (206, "".join(chr(rng.randint(33, 126)) for _ in range(900)), "en"), (207, "the " * 300, "de")]
    docs = spark.createDataFrame([(i, t, l, "s", len(t)) for i, t, l in rows_], "doc_id long, text string, lang string, source string, n_chars long")
    before = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    # quality: perplexities by dictionaries, bands by medians
    docs = written(stages["quality"](spark, docs, ""), "q")
    want = set()
    for lang in ("en", "de"):
        mine = {i: r.text for i, r in before.items() if r.lang == lang}
        p = brute_kneser_ney(list(mine.values()), ORDER)
        far = {}
        for i, t in mine.items():
            s = [ngrams.START] * (ORDER - 1) + list(t.encode()) + [ngrams.END]
            far[i] = (-sum(math.log(p(tuple(s[k - ORDER + 1 : k + 1]))) for k in range(ORDER - 1, len(s))) / (len(s) - ORDER + 1), len(s) - ORDER + 1)
        middle = median([x for x, _ in far.values()])
        deviation = 1.4826 * median([abs(x - middle) * n**0.5 for x, n in far.values()])
        for i, (x, n) in far.items():
            half = (deviation**2 / n + SPREAD**2) ** 0.5
            off = x - middle
            if -LOWER * half <= off <= UPPER * half:
                want.add(i)
    got = {r.doc_id for r in docs.collect()}
    assert got == want and 60 < len(got) < len(before)
    # language: what is in the other language's letters goes
    docs = written(stages["language"](spark, docs, ""), "l")
    assert {r.doc_id for r in docs.collect()} - {206, 207} == {i for i in got - {206, 207} if (before[i].lang == "en") == (sum(c in "abcdefgh" for c in before[i].text) > len(before[i].text) / 3)}
    # near duplicates: all pairs
    kept = {r.doc_id: r.text for r in docs.collect()}
    gone = groups([(a, b) for a, b in itertools.combinations(sorted(kept), 2) if jaccard(kept[a], kept[b]) >= 0.7])
    assert not [1 for a, b in itertools.combinations(sorted(kept), 2) if 0.3 < jaccard(kept[a], kept[b]) < 0.7]
    docs = written(stages["near_duplicates"](spark, docs, ""), "n")
    assert {r.doc_id for r in docs.collect()} == set(kept) - set(gone) and len(gone) >= 1
    # passages: all windows
    kept = {r.doc_id: r.text for r in docs.collect()}
    spans = passages([*kept.items()], 50)
    docs = written(stages["passages"](spark, docs, ""), "p")
    after = {r.doc_id: r.text for r in docs.collect()}
    for i, t in kept.items():
        for _, a, b, _ in sorted((x for x in spans if x[0] == i), reverse=True):
            t = t[:a] + t[b:]
        assert after.get(i, "") == t or not tokens(t) and i not in after
    assert any(x[0] == 204 for x in spans)
    # packing: every token once, nothing overlaps
    check(stages["packing"](spark, docs, "").collect(), [*after.items()], 8192)
