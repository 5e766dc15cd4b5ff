"""Steps that have to hold while their tables grow: joins of stored tables, sweeps over many files."""

import random

from pyspark.sql import functions as F

from graphloom.extractors import code, lexer
from graphloom.functions.fixpoint import fixpoint
from graphloom.functions.lineage import settled


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_that_compress_well_are_not_sent_through_the_driver(spark):
    """20,000 rows with one text between them are little as Parquet, below the size up to which Spark broadcasts."""
    wide = settled(spark.range(20_000).select((F.col("id") % 10).alias("k"), F.lit("x" * 200).alias("text")))
    for df in (wide.where("text = '('").join(wide.groupBy("k").count(), "k", "left"), spark.range(9).toDF("k").join(fixpoint(wide.select("k"), lambda new: new.where("k < 0")), "k")):
        assert "SortMergeJoin" in plan_of(df) and "BroadcastHashJoin" not in plan_of(df)


def test_owners_of_many_files_over_small_batches(spark):
    rng = random.Random(3)
    ranges = [(f"f{f}", a, a + rng.randrange(20), f"{f}.{n}") for f in range(30) for n, a in enumerate(rng.sample(range(40), 8))]
    places = [(f"f{f}", at) for f in range(35) for at in range(45)] + [("f1", None)]

    def around(path, at):
        fits = [(e - s, s, n) for p, s, e, n in ranges if p == path and at is not None and s <= at <= e]
        return min(fits)[2] if fits else None

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = code.with_owner(spark.createDataFrame(places, "path string, line int"), spark.createDataFrame(ranges, "path string, line int, end int, n string"))
        got = sorted((r["path"], -1 if r["line"] is None else r["line"], r["owner"] and r["owner"]["n"]) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted((p, -1 if at is None else at, around(p, at)) for p, at in places)
    assert "CoGroup" not in plan_of(found)


def test_scanning_is_spread_by_characters(spark, monkeypatch):
    monkeypatch.setattr(lexer, "TASK_CHARS", 100)
    files = spark.range(40).select(F.concat(F.lit("a"), "id", F.lit(".ts")).alias("path"), F.lit("let a = 1;").alias("content")).coalesce(1)
    found = lexer.tokens(files, "typescript")
    assert found.select(F.spark_partition_id()).distinct().count() > 1 and found.count() == 200


def test_a_long_chain_does_not_move_what_is_known(spark, monkeypatch):
    """Few new rows go to the known ones: no round shuffles the 5,000 rows that the chain of 12 starts from."""
    seen = []
    import graphloom.functions.fixpoint as module

    kept = module.settled
    monkeypatch.setattr(module, "settled", lambda df: (seen.append(plan_of(df)), kept(df))[1])
    seed = spark.range(5000).select(F.col("id").alias("n"))
    got = fixpoint(seed, lambda new: new.where("n >= 4999 and n < 5011").select((F.col("n") + 1).alias("n")))
    assert got.count() == 5012 and got.distinct().count() == 5012
    joins = [p for p in seen if "LeftAnti" in p]
    assert len(joins) == 12 and all("LeftSemi, BuildRight" in p for p in joins)
