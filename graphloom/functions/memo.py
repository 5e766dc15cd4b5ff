"""Results kept per session and folder of tables, for as long as the folder stays as it is."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, wraps

from pyspark.sql import SparkSession


def stamp(spark: SparkSession, folder: str) -> tuple:
    """(name, length, time of change) of what lies in a folder and in the folders there; any store that Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for table in fs.listStatus(path):
        found += [(table.getPath().getName(), f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in (fs.listStatus(table.getPath()) if table.isDirectory() else [table])]
    return tuple(sorted(found))


def per_folder(most: int) -> Callable[[Callable], Callable]:
    """Keep the results of f(spark, folder, ...) for the last `most` calls; a folder that is rewritten is read anew."""
    def decorate(f: Callable) -> Callable:
        kept = lru_cache(maxsize=most)(lambda _, spark, folder, *more: f(spark, folder, *more))

        @wraps(f)
        def call(spark: SparkSession, folder: str, *more):
            return kept(stamp(spark, folder), spark, folder, *more)

        return call

    return decorate
