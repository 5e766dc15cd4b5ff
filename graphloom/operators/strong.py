"""Distributed strongly connected components: trimming from both ends, then forward and backward colouring, until no edge is left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixpoint import fixpoint
from ..functions.lineage import settled


def trimmed(edges: DataFrame, both: bool = True) -> DataFrame:
    """edges(source, target, ...) without those that lead only to nodes without a way on (and, with both, come only from nodes without a way in), to a fixpoint."""
    left = edges.count()
    while left:
        edges = edges.join(edges.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        if both:
            edges = edges.join(edges.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        edges = settled(edges)
        now = edges.count()
        if now == left:
            break
        left = now
    return edges


def least_ancestor(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): the least label of a node and of all that reach it; labels(node, label). Only labels that have become less go on."""
    known = settled(labels)
    new = known
    while True:
        sent = new.select(F.col("node").alias("source"), "label").join(edges.select("source", "target"), "source").groupBy(F.col("target").alias("node")).agg(F.min("label").alias("sent"))
        new = settled(sent.join(known, "node", "left").where("label is null or sent < label").select("node", F.col("sent").alias("label")))
        if new.isEmpty():
            return known
        known = settled(known.join(new.select("node", F.col("label").alias("less")), "node", "full").select("node", F.coalesce("less", "label").alias("label")))


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of components of two nodes or more, component being the least node in it; edges(source, target). Self-loops and nulls play no part.

    A round colours each node with the least node that reaches it; of a colour, those that reach its namesake are that one's component. What remains
    goes on within colours, so a round settles a component of every colour at once."""
    left = edges.select("source", "target").where("source <> target").distinct()
    found: list[DataFrame] = []
    while True:
        left = trimmed(left)
        if left.isEmpty():
            break
        nodes = left.select(F.explode(F.array("source", "target")).alias("node")).distinct()
        colour = least_ancestor(left, nodes.select("node", F.col("node").alias("label")))
        end = lambda e: colour.select(F.col("node").alias(e), F.col("label").alias(f"{e}_colour"))  # noqa: E731, B023
        inside = settled(left.join(end("source"), "source").join(end("target"), "target").where("source_colour = target_colour").select("source", "target", F.col("source_colour").alias("colour")))
        back = inside.select(F.col("target").alias("node"), F.col("source").alias("before"))
        reached = fixpoint(colour.where("node = label").select("node", F.col("label").alias("component")), lambda new: new.join(back, "node").select(F.col("before").alias("node"), "component"), ["node"])  # noqa: B023
        reached = settled(reached)
        found.append(reached)
        done = reached.select("node")
        left = settled(inside.join(done.withColumnRenamed("node", "source"), "source", "left_anti").join(done.withColumnRenamed("node", "target"), "target", "left_anti").select("source", "target"))
    if not found:
        return edges.select(F.col("source").alias("node"), F.col("source").alias("component")).limit(0)
    every = settled(reduce(DataFrame.unionByName, found))
    return every.join(every.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component"), "component", "left_semi").select("node", "component")
