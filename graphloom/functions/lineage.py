"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new path in spark.checkpoint.dir. Where that is unset: in the warehouse, or on a single machine (as in tests) in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        alone = master.startswith("local") and not master.startswith("local-cluster")
        base = tempfile.mkdtemp(prefix="spark-graphloom-", dir="/tmp") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/graphloom-scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/graphloom-{uuid.uuid4().hex}"


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: later steps neither recompute it nor depend on any executor. options are the writer's."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merging(df: DataFrame) -> DataFrame:
    """df, to be joined by sorting and merging. Files of repeated words and names are far smaller than their rows in memory, so by their size Spark takes
    tables that grow with the corpus for small ones and sends them whole through the driver. F.broadcast() of what is bounded goes before this."""
    return df.hint("merge")


def settled(df: DataFrame) -> DataFrame:
    """cut() of a table that grows with the corpus: its joins merge, whatever its files weigh."""
    return merging(cut(df))


#: Rows up to which a stored table is sent to the other side of a join.
SENT = 100_000


def sent(df: DataFrame) -> DataFrame:
    """A stored table, to be sent whole to the other side of a join while it has few rows, however much it weighs as a file; else it merges."""
    return F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else merging(df)
