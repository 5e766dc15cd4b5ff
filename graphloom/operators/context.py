"""Ranking of symbols and files for a task's words."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..schema import Graph
from .lookups import clamp
from .scope import is_test_file, scoped_nodes, trusted

#: Where only a pool is ranked: its nodes, the first by degree, before the scope is applied.
POOL = 2000
LEFT_OUT = ("repository", "directory", "file", "unresolved_symbol")


@dataclass(frozen=True)
class Context:
    symbols: DataFrame
    files: DataFrame
    relationships: DataFrame
    related_tests: DataFrame


def task_words(task: str) -> list[str]:
    return list(dict.fromkeys(w for w in re.split(r"[^a-z0-9_]+", task.lower()) if len(w) >= 2))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) over all edges; a self-loop counts once. Counts combine before the shuffle."""
    return edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def ranked_symbols(graph: Graph, task: str, max_symbols: int = 50, scope: str = "code", pool: int | None = None) -> DataFrame:
    """The symbols that say most about a task, of all in scope; with a pool only of the first so many nodes by degree."""
    words = task_words(task)
    candidates = graph.nodes.where(~F.col("kind").isin(*LEFT_OUT)).join(degrees(graph.edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    if pool is not None:
        candidates = candidates.orderBy(F.desc("degree"), "qualified_name", "ord").limit(pool)
    low = scoped_nodes(candidates, scope).withColumns({"_n": F.lower("name"), "_q": F.lower("qualified_name"), "_f": F.lower(F.coalesce("file", F.lit("")))})
    score, matched = F.least("degree", F.lit(20)) / 10.0, []
    for w in words:
        in_name, in_file = F.contains(F.col("_n"), F.lit(w)), F.contains(F.col("_f"), F.lit(w))
        hit = in_name | F.contains(F.col("_q"), F.lit(w)) | in_file
        score = score + F.when(~hit, 0).when(F.col("_n") == w, 20).when(in_name, 10).when(in_file, 6).otherwise(4)
        matched.append(F.when(hit, F.lit(w)))
    terms = F.array_compact(F.array(*matched)) if matched else F.array().cast("array<string>")
    reasons = F.array_compact(F.array(
        F.when(F.size(terms) > 0, F.concat(F.lit("matched task terms: "), F.array_join(terms, ", "))),
        F.when(F.col("degree") > 0, F.concat(F.lit("graph degree "), F.col("degree").cast("string"))),
        F.when(F.col("kind").startswith("framework_"), F.lit("framework binding")),
    ))
    return low.withColumn("score", score).withColumn("reasons", reasons).where("score > 0").drop("_n", "_q", "_f").orderBy(F.desc("score"), "qualified_name", "ord").limit(max_symbols)


def context(graph: Graph, task: str, max_symbols: int = 50, max_files: int = 20, scope: str = "code", probable: bool = False, unresolved: bool = False, pool: int | None = None) -> Context:
    max_symbols, max_files = clamp(max_symbols, 1, 200), clamp(max_files, 1, 100)
    # stored, as all parts below ask for it: the degrees that it needs read every edge
    symbols = cut(ranked_symbols(graph, task, max_symbols, scope, pool)).orderBy(F.desc("score"), "qualified_name", "ord")
    ids = [r["id"] for r in symbols.select("id").collect()]  # at most max_symbols
    # as values the ids filter the rows that edges are made of, before those are grouped
    from_chosen, to_chosen = F.col("source").isin(ids), F.col("target").isin(ids)
    edges = trusted(graph.edges, scope, probable, unresolved).select("ord", "id", "source", "target", "kind", "confidence")
    # symbols are nodes in scope, so only an edge's other end has to be asked
    relationships = edges.where(from_chosen & to_chosen).orderBy("ord").limit(3 * max_symbols)
    files = symbols.where("file is not null").groupBy("file").agg(F.sum("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons")).orderBy(F.desc("score"), "file").limit(max_files)
    other = edges.where(from_chosen | to_chosen).select(F.when(from_chosen, F.col("target")).otherwise(F.col("source")).alias("id")).distinct()
    tests = scoped_nodes(graph.nodes, scope).where(F.col("file").isNotNull() & is_test_file(F.col("file"))).join(other, "id").select("file").distinct().orderBy("file")
    return Context(symbols, files, relationships, tests)
