"""Dense numbering of sorted rows without one task for all."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut off from its lineage, in the folder that spark.checkpoint.dir names;
    only in local mode, and where it is unset, in one of our own."""
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not at:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="docframe-")
        sc.setCheckpointDir(at)
    return df.checkpoint()


def dense_index(df: DataFrame, keys: list, name: str = "idx", start: int = 0) -> DataFrame:
    """df with its rows numbered from `start` in the order of keys: a range sort, a
    number within each partition, and the sum of the partitions before."""
    pid, at, first = "_pid", "_at", "_first"
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    rows = checkpointed(rows.withColumn(pid, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1))))
    # one row for each partition
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(pid).agg(F.count("*").alias("n")).select(pid, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    return rows.join(F.broadcast(sizes), pid).withColumn(name, F.col(first) + F.col(at) + start).drop(pid, at, first)
