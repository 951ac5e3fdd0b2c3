"""A query against its SQL: the same columns and the same rows, as a multiset."""

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(p)[:-8]
        at = os.path.join(p, "*.parquet") if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    cur = con.execute(sql)
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == names, (sorted(theirs), names)
    at = [theirs.index(c) for c in names]
    want = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    more, less = got - want, want - got
    assert not more and not less, f"{sum(got.values())} rows, {sum(want.values())} wanted; not wanted: {list(more)[:3]}; lacking: {list(less)[:3]}"
    return sum(got.values())
