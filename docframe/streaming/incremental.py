"""Streaming form of the incremental build: documents that arrive or change are
parsed as they come, and the index keeps the latest state of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docframe.functions import markup
from docframe.operators.search import postings


def arrivals(spark: SparkSession, folder: str, schema: str = "docname string, content string, mtime timestamp") -> DataFrame:
    """A stream of document rows from the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def latest(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each document's last row by mtime, within the watermark's delay; ties go to the larger text."""
    return stream.withWatermark("mtime", delay).groupBy("docname", F.window("mtime", delay)).agg(F.max_by("content", F.struct("mtime", "content")).alias("content"), F.max("mtime").alias("mtime")).drop("window")


def records(stream: DataFrame) -> DataFrame:
    """The markup records of each document as it arrives."""
    return markup.parse(stream)


def keep_index(stream: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes each batch's postings to folder/batch=<n>. current() reads the last of each document."""

    def batch(df: DataFrame, n: int) -> None:
        rows = df.groupBy("docname").agg(F.max_by("content", F.struct("mtime", "content")).alias("content"))
        # every arrival is marked, also one without terms; a batch that runs again replaces itself
        out = rows.select("docname").distinct().join(postings(rows), "docname", "left")
        out.write.mode("overwrite").parquet(f"{folder}/batch={n}")

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """(docname, term, tf, positions) of each document's last batch."""
    rows = spark.read.parquet(folder)
    last = rows.groupBy("docname").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["docname", "batch"]).where(F.col("term").isNotNull()).drop("batch")
