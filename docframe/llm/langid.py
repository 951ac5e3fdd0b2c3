"""Language identification in two steps: the family, then, within the family,
one-versus-one linear support vector machines between its languages.

Features are the relative frequencies of hashed byte trigrams of the folded
text. All classifiers are linear in them, so a text's score is the mean of its
trigrams' weights, looked up in one table for each classifier. The classifiers
are fitted, each in a task of its own, on a bounded, hash-ordered sample of `sample`
labelled documents of each language (a documented parameter); everything else
covers all rows, of any length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.llm.common import column, folded, fresh, lightened, slices

BITS = 13
SAMPLE = 500
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic",
}
#: A document is rejected when it surely is in a language other than the declared
#: one: its language's lead over the declared one is at least this many standard
#: errors of the score.
SURE = 3.5
#: A tag that fewer rows declare is taken for noise in the labels: no classifier is fitted for it.
LEAST_DOCUMENTS = 10
#: A short text's own variance says little: it counts like so many trigrams of the usual variance.
PRIOR = 30


def family(lang: str, families: dict[str, str] = FAMILIES) -> str:
    """A language without an entry is a family of its own."""
    return families.get(lang, lang)


def grams(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of each text (a blank before and after it; bytes that are
    neither letters nor marks of UTF-8 are blanks), and where each text's start."""
    low = folded(data)
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    out = np.full(len(data) + 2 * n, 32, np.uint32)
    out[np.arange(len(data)) + 2 * row + 1] = np.where(letter, low, 32)
    code = out[:-2] | out[1:-1] << np.uint32(8) | out[2:] << np.uint32(16) if len(out) > 2 else np.zeros(0, np.uint32)
    keep = np.ones(len(code), bool)
    edge = offsets[1:-1] + 2 * np.arange(1, n)
    keep[edge - 1] = keep[edge - 2] = False
    # trigrams with two blanks at the end or in the middle carry nothing
    some = keep & (out[1:-1] != 32)[: len(code)]
    first = np.concatenate([[0], np.cumsum(np.bincount(_owner(offsets, len(code))[some], minlength=n))])
    h = code[some] * np.uint32(2654435761)
    return (h >> np.uint32(32 - bits)).astype(np.int32), first


def _owner(offsets: np.ndarray, n: int) -> np.ndarray:
    """The text of each padded position."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) + 2)
    return row[:n]


class Sparse:
    """Rows of a matrix by their entries other than 0: first (where each row's start, and
    the end), at (columns, ascending in a row) and value. A text has far fewer trigrams
    than there are columns, so no row of all columns is ever made."""

    def __init__(self, first: np.ndarray, at: np.ndarray, value: np.ndarray, width: int):
        self.first, self.at, self.value, self.width = first, at, value, width
        self._some = np.flatnonzero(np.diff(first))
        self._begin = first[:-1][self._some]

    def __len__(self) -> int:
        return len(self.first) - 1

    def times(self, v: np.ndarray) -> np.ndarray:
        """The product of each row and v."""
        out = np.zeros(len(self), np.float32)
        if len(self._some):
            out[self._some] = np.add.reduceat(self.value * v[self.at], self._begin)
        return out

    def transposed(self) -> Sparse:
        order = np.argsort(self.at, kind="stable")
        row = np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.first))[order]
        return Sparse(np.concatenate([[0], np.cumsum(np.bincount(self.at, minlength=self.width))]), row, self.value[order], len(self))


def features(text: pa.Array, bits: int = BITS) -> Sparse:
    """A row of relative trigram frequencies for each text."""
    first, ats, values = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    for i, j, data, offsets in slices(text):
        code, start = grams(data, offsets, bits)
        n = np.diff(start)
        key, count = np.unique(np.repeat(np.arange(j - i) << bits, n) | code, return_counts=True)
        row = key >> bits
        ats.append((key & ((1 << bits) - 1)).astype(np.int32))
        values.append((count / n[row]).astype(np.float32))
        first.append(first[-1][-1] + np.cumsum(np.bincount(row, minlength=j - i)))
    return Sparse(np.concatenate(first), np.concatenate(ats), np.concatenate(values), 1 << bits)


def svm(x: Sparse | np.ndarray, y: np.ndarray, regular: float = 1e-2, rounds: int = 200) -> tuple[np.ndarray, float, float]:
    """Weights, bias, and the variance of a trigram's weight over the rows, of a linear support vector machine with squared hinge
    loss, labels -1 and 1, both classes weighted alike; by accelerated gradients."""
    if not isinstance(x, Sparse):
        row, at = np.nonzero(x)
        x = Sparse(np.searchsorted(row, np.arange(len(x) + 1)), at, x[row, at].astype(np.float32), x.shape[1])
    scale = np.float32(1 / max(1e-12, float(np.sqrt(np.einsum("i,i->", x.value, x.value, dtype=np.float64) / len(x)))))
    by_column = x.transposed()
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)

    def forward(v: np.ndarray) -> np.ndarray:
        return x.times(v[:-1] * scale) + v[-1]  # the last weight is the bias

    def back(r: np.ndarray) -> np.ndarray:
        return np.append(by_column.times(r) * scale, r.sum()).astype(np.float32)

    v = np.random.default_rng(0).standard_normal(x.width + 1).astype(np.float32)
    for _ in range(20):  # the largest curvature
        v = back(each * forward(v))
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-30)
    step = 1 / (2 * top * 1.1 + regular)
    w = z = np.zeros(x.width + 1, np.float32)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * forward(z))
        new = z - step * (back(-2 * each * y * slack) + regular * z)
        z = new + t / (t + 3) * (new - w)
        w = new
    v = w[:-1] * scale
    share = np.bincount(x.at, weights=x.value, minlength=x.width) / len(x)
    return v, float(w[-1]), float(share @ v.astype(np.float64) ** 2 - (share @ v) ** 2)


class Model:
    """between: (name a, name b, weights, bias, variance) of each pair of families, a where
    positive; within: the same of each pair of languages of a family."""

    def __init__(self, languages: list[str], families: dict[str, str], between: list[tuple], within: dict[str, list[tuple]], bits: int):
        self.languages, self.families, self.between, self.within, self.bits = languages, families, between, within, bits

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language of each text, and its number of trigrams."""
        code, first = grams(data, offsets, self.bits)
        n = np.diff(first)
        some = np.flatnonzero(n)
        count = len(n)

        def lead(w: np.ndarray, bias: float, usual: float) -> np.ndarray:
            """Mean weight plus bias, in standard errors of the mean."""
            out = np.zeros(count)
            if len(some):
                v = w[code]
                mean = np.add.reduceat(v, first[:-1][some], dtype=np.float64) / n[some]
                square = np.add.reduceat(v * v, first[:-1][some], dtype=np.float64) / n[some]
                own = (n[some] * np.maximum(square - mean**2, 0) + PRIOR * usual) / (n[some] + PRIOR)
                out[some] = (mean + bias) / np.sqrt(np.maximum(own, 1e-12) / n[some])
            return out

        def vote(names: list[str], pairs: list[tuple]) -> tuple[np.ndarray, dict[tuple[str, str], np.ndarray]]:
            """The winner of each text: most pairs won, then the larger sum of leads, then the name."""
            leads = {(a, b): lead(*fit) for a, b, *fit in pairs}
            wins, sums = np.zeros((count, len(names))), np.zeros((count, len(names)))
            for (a, b), x in leads.items():
                i, j = names.index(a), names.index(b)
                wins[:, i] += x >= 0
                wins[:, j] += x < 0
                sums[:, i] += x
                sums[:, j] -= x
            bounded = sums / (1 + np.abs(sums)) / 2.5
            return np.argmax(wins + bounded, axis=1), leads | {(b, a): -x for (a, b), x in leads.items()}

        fams = sorted({family(x, self.families) for x in self.languages})
        fam, far = vote(fams, self.between)
        best = np.full(count, "", object)
        near: dict = {}
        for k, f in enumerate(fams):
            names = [x for x in self.languages if family(x, self.families) == f]
            at, leads = vote(names, self.within.get(f, []))
            near |= leads
            mine = fam == k
            best[mine] = np.array(names, object)[at[mine]]
        self.far, self.near = far, near
        return best, n

    def over(self, best: np.ndarray, declared: list[str | None]) -> np.ndarray:
        """The lead of each text's language over its declared one, by the
        classifier that separates them; 0 where they agree or there is none."""
        out = np.zeros(len(best))
        tags = np.array(declared, object)
        known = np.isin(tags.astype(str), self.languages) & (tags != best)
        for x, y in {(best[d], tags[d]) for d in np.flatnonzero(known)}:
            a, b = family(x, self.families), family(y, self.families)
            rows = np.flatnonzero((best == x) & (tags == y))
            out[rows] = (self.near[x, y] if a == b else self.far[a, b])[rows]
        return out


def train(docs: DataFrame, sample: int = SAMPLE, bits: int = BITS, text: str = "text", lang: str = "lang", families: dict[str, str] = FAMILIES, least_documents: int = LEAST_DOCUMENTS) -> Model:
    """A model from at most `sample` documents of each declared language: those
    with the smallest hashes of their texts, of any length. Languages are the tags that
    `least_documents` or more rows declare; the others are taken for noise."""
    spark = docs.sparkSession
    base = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text <> '' AND lang IS NOT NULL")
    each = {r[0]: r[1] for r in base.groupBy("lang").count().where(F.col("count") >= least_documents).collect()}
    languages = sorted(each)
    if not each:
        return Model([], families, [], {}, bits)
    # the sample's share of the hashes, with room for chance; then the exact number
    share = F.create_map(*[F.lit(v) for k, n in each.items() for v in (k, min(1.0, (sample + 4 * sample**0.5) / n))])
    some = base.where(F.col("lang").isin(languages)).withColumn("h", F.xxhash64("text")).where((F.pmod("h", F.lit(1 << 32)) / (1 << 32)) < F.element_at(share, F.col("lang")))
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 32)), "h"))).where(F.col("r") <= sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(column(b, "text"), bits)
            rows = [x.at[i:j].tobytes() + x.value[i:j].tobytes() for i, j in zip(x.first[:-1], x.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([column(b, "lang"), pa.array(rows, pa.binary())], ["lang", "x"])

    rows = some.select("lang", "text").mapInArrow(run, "lang string, x binary")
    # which classifiers a language's rows go to: as many as it has rivals
    fams = sorted({family(k, families) for k in languages})
    pairs = [("", a, b) for a, b in combinations(fams, 2)] + [(f, a, b) for f in fams for a, b in combinations([k for k in languages if family(k, families) == f], 2)]
    sides = [(k, n, 1 if name == a else -1) for n, (f, a, b) in enumerate(pairs) for k in languages for name in [k if f else family(k, families)] if name in (a, b)]
    if not sides:
        return Model(languages, families, [], {}, bits)

    def fit(key: tuple, t: pa.Table) -> pa.Table:
        side, xs = np.asarray(t.column("side")), t.column("x").to_pylist()
        order = sorted(range(len(xs)), key=lambda i: (side[i], xs[i]))  # the same fit whatever the partitions
        size = [len(xs[i]) // 8 for i in order]
        at, value = (np.concatenate([np.frombuffer(xs[i], kind, m, skip * m) for i, m in zip(order, size, strict=True)]) for kind, skip in ((np.int32, 0), (np.float32, 4)))
        del xs
        lightened()
        w, bias, usual = svm(Sparse(np.concatenate([[0], np.cumsum(size)]), at, value, 1 << bits), side[order].astype(np.float32))
        return pa.table({"pair": [key[0].as_py()], "w": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "bias": [bias], "usual": [usual]})

    to = F.broadcast(spark.createDataFrame(sides, "name string, pair long, side int"))  # two rows a pair and language
    fitted = rows.join(to, F.col("lang") == F.col("name")).select("pair", "side", "x").groupBy("pair").applyInArrow(fit, "pair long, w binary, bias double, usual double").collect()
    between, within = [], defaultdict(list)
    for r in sorted(fitted, key=lambda r: r.pair):
        f, a, b = pairs[r.pair]
        (within[f] if f else between).append((a, b, np.frombuffer(r.w, np.float32), r.bias, r.usual))
    return Model(languages, families, between, dict(within), bits)


def predicted(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang", sure: float = SURE, keep: list[str] | None = None) -> tuple[DataFrame, tuple[str, str, str]]:
    """docs (the columns in keep, or all) with the predicted language, the lead
    over the declared one in standard errors, and whether the row is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = keep if keep is not None else docs.columns
    added = (fresh(docs, "predicted_lang"), fresh(docs, "lead"), fresh(docs, "lang_kept"))
    body, tag = fresh(docs, "langid_text"), fresh(docs, "langid_lang")
    source = docs.select(*names, F.col(text).alias(body), F.col(lang).cast("string").alias(tag))
    fields = source.drop(body, tag).schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts, tags = column(b, body), column(b, tag).to_pylist()
            best, lead = np.full(b.num_rows, None, object), np.zeros(b.num_rows)
            ok = np.ones(b.num_rows, bool)
            for i, j, data, offsets in slices(texts) if m.languages else ():
                at, n = m(data, offsets)
                best[i:j] = np.where(n > 0, at, None)
                lead[i:j] = np.where(n > 0, m.over(at, tags[i:j]), 0)
                ok[i:j] = lead[i:j] < sure
            ok &= np.asarray(texts.is_valid())
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in names), pa.array(best, pa.string()), pa.array(lead), pa.array(ok)], [*names, *added])

    schema = T.StructType([*fields, T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType()), T.StructField(added[2], T.BooleanType())])
    return source.mapInArrow(run, schema), added


def languages(docs: DataFrame, sample: int = SAMPLE, sure: float = SURE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, predicted_lang, lead, keep) of every row.

    Rejected (keep false): a null text, and a text that is in another language than
    its declared one by at least `sure` standard errors. A text without letters has no predicted language and is kept, as is
    one whose declared language is null or unknown to the model. Ties between
    languages go to the first name. Rows that repeat an id are judged one by one;
    texts are used whole, however long; other columns are ignored. No rows give no rows.
    """
    base = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    out, (best, lead, ok) = predicted(base, train(base, sample), "text", "lang", sure, ["doc_id", "lang"])
    return out.select("doc_id", "lang", F.col(best).alias("predicted_lang"), F.col(lead).alias("lead"), F.col(ok).alias("keep"))


def in_declared_language(docs: DataFrame, sample: int = SAMPLE, sure: float = SURE, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without the rows that languages() rejects, with their columns, whatever
    their names. Null, empty and long texts, null and unknown languages, ties, repeated
    rows and tables without rows are treated as there."""
    out, (_, _, ok) = predicted(docs, train(docs, sample, text=text, lang=lang), text, lang, sure)
    return out.where(F.col(ok)).select(*docs.columns)
