"""Distributed connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges shrink to one link from each of its nodes to its least local node."""
    parent: dict = {}

    def root(x):
        while (p := parent[x]) != x:
            parent[x] = parent[p]
            x = p
        return x

    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            if a < b:
                parent[b] = a
            elif b < a:
                parent[a] = b
    links = [(x, r) for x in parent if (r := root(x)) != x]
    if links:
        for i in range(0, len(links), 50_000):
            part = links[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], schema.field(0).type), pa.array([y for _, y in part], schema.field(1).type)], schema=schema)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b), component being the least node it reaches.

    Self-links and nulls are ignored; no edges give no rows. Each round is a handful of joins and
    partially aggregated groupings whose result is written to the shared folder, so a lost executor
    costs at most one round; a hub's edges can be split between tasks, as no step gathers them in one.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")
    e = cut(e.mapInArrow(_contract, e.schema).distinct())
    state = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        e = cut(small.select("u", F.col("m").alias("v")).unionByName(small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.count_distinct("v"), F.count_distinct("u")).first()
        # Stars only: no centre is itself a leaf and every leaf has one centre.
        if now[0] == now[3] and e.select("v").distinct().join(e.select("u"), F.col("v") == F.col("u"), "left_semi").isEmpty():
            break
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
