"""Language-model scores by Katz backoff, without a model in any one memory.

A token is a byte of the UTF-8 text; END follows a text, START stands before it.
n-gram counts of all documents are discounted by Good-Turing; what that frees
goes to tokens not seen after a context by the shorter context's model, with a
weight that makes each distribution sum to one exactly. All n-grams count,
those seen once too.

1. n-grams of the highest order are counted, in blocks of the nearest tokens of
   their contexts: so all n-grams of orders 4 and up that share a context, and all
   that they back off to down to order 4, are in one block. Orders 1 to 3, which
   the alphabet bounds, are the only part of the model that is broadcast.
2. Each block's model is made, and written as tables partitioned by order.
3. Documents lie in groups of some MB. A group asks each block about its distinct
   n-grams, which are scored there by recursion from the highest order down, and
   its documents' are added up from the answers. Texts are exchanged once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.llm import ngrams
from docframe.llm.common import GROUP_BYTES, answered, blocks_for, deflated, discarded, inflated, packed, unpacked, written
from docframe.llm.ngrams import Katz, Level

ORDER = 7
CUTOFF = 5
BLOCK_BYTES = 4 << 20


def katz_scores(docs: DataFrame, order: int = ORDER, cutoff: int = CUTOFF, group_bytes: int = GROUP_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity) of every row, under a model counted over all rows.

    A null text isn't counted, has no tokens and null scores; an empty text is its
    END alone. Rows that repeat an id are scored one by one, equal texts alike. Texts
    are used whole, however long; other columns are ignored. No rows give no rows.
    """
    if not ngrams.LOW < order <= 8:
        raise ValueError(f"order must be {ngrams.LOW + 1} to 8")
    kind = Katz(cutoff)
    base = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    blocks = blocks_for(base, "text", BLOCK_BYTES)
    merged = written(ngrams.counts(base, order, blocks), "counts")
    bottom = base.sparkSession.sparkContext.broadcast(ngrams.bottoms(merged, kind, order).get(ngrams.UNKNOWN))
    fields = ["block", "n", "grams", "weights"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                top = ngrams.block_levels(kind, part.as_py(), bottom.value, order)[ngrams.LOW :]
                grams = [deflated([v.code, v.p.astype(np.float32)], 1) for v in top]
                weights = [deflated([v.context, v.weight.astype(np.float32)], 1) for v in top]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(top), pa.int64()), pa.array(range(ngrams.LOW + 1, order + 1), pa.int32()), pa.array(grams, pa.binary()), pa.array(weights, pa.binary())], fields)

    tables = written(merged.select("block", "part").mapInArrow(build, "block long, n int, grams binary, weights binary"), "katz", ["n"]).select(*fields)
    discarded(merged)

    def ask(blob: bytes) -> Iterator[tuple[int, bytes]]:
        code, edge, ids = ngrams.asked(unpacked(blob).column("text").combine_chunks(), order, lambda c: ngrams.context_block(c, order, blocks))
        for a, b, block in zip(edge[:-1], edge[1:], ids.tolist(), strict=True):
            yield block, deflated([code[a:b]], 1)

    def answer(t: pa.Table):
        rows = sorted(t.select(fields[1:]).to_pylist(), key=lambda r: r["n"])
        levels = [*bottom.value.levels, *(Level(*inflated(r["grams"], [np.uint64, np.float32], 1), *inflated(r["weights"], [np.uint64, np.float32], 1)) for r in rows)]
        return lambda part: deflated([ngrams.score(levels, inflated(part, [np.uint64], 1)[0], order).astype(np.float32)])

    def finish(blob: bytes, answers: dict[int, bytes]) -> pa.Table:
        t = unpacked(blob)
        texts = t.column("text").combine_chunks()
        code, _, ids = ngrams.asked(texts, order, lambda c: ngrams.context_block(c, order, blocks))
        n, total = ngrams.sums(texts, code, np.concatenate([inflated(answers[i], [np.float32])[0] for i in ids.tolist()]), order)
        return pa.table([t.column("doc_id").combine_chunks(), pa.array(n), pa.array(total), pa.array(np.exp(-total / n))], names=["doc_id", "n_tokens", "log_prob", "perplexity"])

    schema = T.StructType([base.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("perplexity", T.DoubleType())])
    groups = packed(base.where(F.col("text").isNotNull()), "text", group_bytes)
    scored = answered(groups, ask, tables, answer, finish, schema)
    none = base.where(F.col("text").isNull()).select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("double").alias("log_prob"), F.lit(None).cast("double").alias("perplexity"))
    return scored.union(none)
