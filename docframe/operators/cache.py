"""Incremental builds: which documents a cache serves, and what it evicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "path string, hash string, mtime timestamp, cached_at timestamp, access_count long, size_bytes long, html string"


def plan(files: DataFrame, cache: DataFrame, now, ttl_seconds: int) -> DataFrame:
    """(path, action) of files (path, hash, mtime) against cache (path, hash,
    cached_at, mtime): 'hit', or why it is built again: 'new', 'expired' (older than
    the time to live, strictly), 'changed', 'stale' (modified since); 'removed' for
    cached paths without a file."""
    f, c = files.alias("f"), cache.alias("c")
    both = f.join(c, F.col("f.path") == F.col("c.path"), "full")
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("c.cached_at")
    action = (
        F.when(F.col("f.path").isNull(), "removed").when(F.col("c.path").isNull(), "new").when(age > ttl_seconds, "expired").when(F.col("f.hash") != F.col("c.hash"), "changed").when(F.coalesce(F.col("f.mtime") > F.col("c.mtime"), F.lit(True)), "stale").otherwise("hit")
    )
    return both.select(F.coalesce("f.path", "c.path").alias("path"), action.alias("action"))


def summary(planned: DataFrame) -> DataFrame:
    """(hits, misses, permille): of files; 0 where there are none."""
    live = planned.where(F.col("action") != "removed")
    hits, all_ = F.count_if(F.col("action") == "hit"), F.count("*")
    return live.agg(hits.alias("hits"), (all_ - hits).alias("misses"), F.coalesce(F.floor(F.try_divide(hits * 1000, all_)).cast("long"), F.lit(0).cast("long")).alias("permille"))


def evicted(cache: DataFrame, needed: int) -> DataFrame:
    """Entries (path, access_count, size_bytes) to remove, least used first, by path
    among equals, until `needed` bytes are free.

    Sums by access count decide all counts but one; only that one's entries are put in order."""
    sizes = cache.groupBy("access_count").agg(F.sum("size_bytes").alias("bytes"))
    w = Window.orderBy("access_count").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("access_count", F.coalesce(F.sum("bytes").over(w), F.lit(0)).alias("before")).where(F.col("before") < needed)
    rows = cache.join(before, "access_count")
    inside = Window.partitionBy("access_count").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    freed = F.col("before") + F.coalesce(F.sum("size_bytes").over(inside), F.lit(0))
    return rows.withColumn("_freed", freed).where(F.col("_freed") < needed).drop("_freed", "before")


def stored(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """A cache with entries in place of their paths' old ones."""
    return cache.join(entries.select("path"), "path", "left_anti").unionByName(entries)


def invalidated(cache: DataFrame, paths: DataFrame) -> DataFrame:
    return cache.join(paths.select("path").distinct(), "path", "left_anti")


def size_of(html, title, path):
    """Bytes that an entry counts for: its texts and 1024 more."""
    return F.octet_length(html) + F.octet_length(title) + F.octet_length(path) + 1024


def total(cache: DataFrame) -> DataFrame:
    """(bytes, entries) of a cache."""
    return cache.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("entries"))


def stored_within(cache: DataFrame, entries: DataFrame, most: int) -> DataFrame:
    """stored(), after the least used entries have gone where both would exceed `most` bytes:
    as many as make room for what is new."""
    new = entries.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    kept = cache.join(entries.select("path"), "path", "left_anti")
    have = kept.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    if have + new > most:
        kept = kept.join(evicted(kept, new).select("path"), "path", "left_anti")
    return kept.unionByName(entries)


def served(planned: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, html) of the hits whose cached page isn't empty, and one more use of each."""
    hits = planned.where("action = 'hit'").join(cache.where("html <> ''"), "path")
    return hits.select("path", "html", (F.col("access_count") + 1).alias("access_count"))


def load(spark: SparkSession, folder: str, files: DataFrame, now, ttl_seconds: int) -> DataFrame:
    """The entries of a persisted cache that are of use: not expired, of a file that is
    there and has the same hash. A folder without one is an empty cache."""
    from docframe.sources.files import there

    if not there(spark, folder):
        return spark.createDataFrame([], ENTRY)
    rows = spark.read.schema(ENTRY).parquet(folder)
    good = plan(files, rows, now, ttl_seconds).where("action IN ('hit', 'stale')").select("path")
    return rows.join(good, "path", "left_semi")


def persist(cache: DataFrame, folder: str) -> None:
    """Writes a cache in place of the one in the folder, which it may have been read from."""
    from docframe.operators.indexing import checkpointed

    checkpointed(cache).write.mode("overwrite").parquet(folder)
