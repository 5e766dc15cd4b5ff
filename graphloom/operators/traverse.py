"""Bounded traversals and cycles.

A traversal goes level by level. At most 500 nodes are ever accepted, so a frontier is a short list of
ids that filters the edges where they are read; only accepted rows come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import settled
from ..schema import CONFIDENCES, Graph
from .lookups import clamp, file_nodes, search_symbols, symbol
from .scope import end_in_scope, is_test_file, node_in_scope, scoped_edges, scoped_nodes, trusted
from .strong import least_ancestor, strongly_connected, trimmed

AFFECTED_KINDS = ("calls", "imports", "invokes", "renders", "listens", "uses_type")
BOUNDARY_KINDS = ("invokes", "listens", "emits", "registers")
EDGE_SHORT = ("ord", "id", "source", "target", "kind", "confidence")
#: Roots up to which a traversal lists them (as it does the nodes of a frontier) instead of joining them.
MOST_LISTED = 500
CYCLE_KINDS = {True: ("imports", "calls"), False: ("imports", "calls", "mentions", "configures", "tests", "related_to")}


class NotFound(ValueError):
    """No indexed file or symbol has the name."""


def _is_one_of(column: Column, values: Iterable[str]) -> Column:
    values = list(values)
    return column.isin(*values) if values else F.lit(False)


class _Near:
    """The scoped edges of a few nodes. Of a stored graph only these are read, level by level; else all scoped edges are held while the traversal lasts."""

    def __init__(self, graph: Graph, scope: str, probable: bool, unresolved: bool, kinds: Iterable[str] | None):
        self.graph, self.options, self.held = graph, (scope, probable, unresolved, kinds), None
        if graph.incident is None:
            self.held = scoped_edges(graph, *self.options).select(*EDGE_SHORT).persist()

    def __call__(self, ids: list[str], ends: tuple[str, ...] = ("source", "target")) -> DataFrame:
        if self.held is not None:
            hit = _is_one_of(F.col(ends[0]), ids)
            return self.held.where(hit | _is_one_of(F.col(ends[1]), ids) if len(ends) == 2 else hit)
        scope = self.options[0]
        return trusted(self.graph.incident(ids, ends), *self.options).where(end_in_scope("source", scope) & end_in_scope("target", scope)).select(*EDGE_SHORT)

    def close(self) -> None:
        if self.held is not None:
            self.held.unpersist()


@dataclass(frozen=True)
class Neighborhood:
    nodes: DataFrame
    edges: DataFrame
    truncated: bool


def neighborhood(graph: Graph, node_id: str, depth: int = 2, max_nodes: int = 50, max_edges: int | None = None, scope: str = "code", probable: bool = False, unresolved: bool = False, edge_kinds: Iterable[str] = (), node_kinds: Iterable[str] = ()) -> Neighborhood:
    """Undirected breadth-first search; new nodes are accepted in the storage order of the edges that reach them."""
    if symbol(graph, node_id).isEmpty():
        raise NotFound(f"no node has the id {node_id}")
    depth, max_nodes = clamp(depth, 0, 8), clamp(max_nodes, 1, 500)
    max_edges = clamp(4 * max_nodes if max_edges is None else max_edges, 1, 2000)
    near = _Near(graph, scope, probable, unresolved, list(edge_kinds) or None)
    visited, frontier, truncated = [node_id], [node_id], False
    level_of = F.lit(None).cast("int")
    try:
        for level in range(depth):
            touching = near(frontier)
            other = F.when(_is_one_of(F.col("source"), frontier), F.col("target")).otherwise(F.col("source"))
            room = max_nodes - len(visited)
            fresh = touching.select(other.alias("node"), "ord").where(~_is_one_of(F.col("node"), visited)).groupBy("node").agg(F.min("ord").alias("ord")).orderBy("ord").limit(room + 1).collect()
            truncated = truncated or len(fresh) > room
            accepted = [r["node"] for r in fresh[:room]]
            visited += accepted
            hit = (_is_one_of(F.col("source"), frontier) | _is_one_of(F.col("target"), frontier)) & _is_one_of(other, visited)
            level_of = F.coalesce(level_of, F.when(hit, level))
            frontier = accepted
            if not accepted:
                break
        kept = F.lit(True)
        if node_kinds:
            kept = (F.col("id") == node_id) | F.col("kind").isin(*node_kinds)
        nodes = graph.nodes.where(_is_one_of(F.col("id"), visited) & node_in_scope(scope) & kept).orderBy("ord")
        ids = [r["id"] for r in nodes.select("id").collect()]  # at most max_nodes
        found = near(ids, ("source",)).withColumn("level", level_of).where(F.col("level").isNotNull() & _is_one_of(F.col("target"), ids)).orderBy("level", "ord").limit(max_edges + 1).collect()
    finally:
        near.close()
    schema = "ord string, id string, source string, target string, kind string, confidence string, level int"
    return Neighborhood(nodes, graph.spark.createDataFrame(found[:max_edges], schema), truncated or len(found) > max_edges)


@dataclass(frozen=True)
class Affected:
    roots: DataFrame
    relationships: DataFrame  # one edge per affected node, with its level
    nodes: DataFrame  # with level; 1 is direct
    files: DataFrame
    related_tests: DataFrame
    boundaries: DataFrame
    confidence_summary: DataFrame
    truncated: bool


def affected_roots(graph: Graph, name: str, scope: str = "code") -> DataFrame:
    """The symbol with this id, else the symbols of this file, else the first matches of a search."""
    by_id = scoped_nodes(symbol(graph, name), scope) if ":" in name else None
    if by_id is not None and not by_id.isEmpty():
        return by_id
    in_file = file_nodes(graph, name, scope).where("kind not in ('file', 'directory', 'repository', 'unresolved_symbol')")
    if not in_file.isEmpty():
        return in_file
    found = search_symbols(graph, name, 20, scope)
    if found.isEmpty():
        raise NotFound(f"No indexed file or symbol matches: {name}")
    return found


def affected(graph: Graph, name: str, depth: int = 3, max_nodes: int = 100, include_tests: bool = False, scope: str = "code", probable: bool = False, unresolved: bool = False) -> Affected:
    """What depends on a symbol or file: reverse breadth-first search, one edge per node that is reached."""
    spark = graph.spark
    depth, max_nodes = clamp(depth, 1, 8), clamp(max_nodes, 1, 500)
    roots = affected_roots(graph, name, scope)
    root_ids = roots.select(F.col("id").alias("root")).persist()
    kinds = AFFECTED_KINDS if scope == "code" else None
    near = _Near(graph, scope, probable, unresolved, kinds)
    taken: list = []
    frontier: list[str] | None = None
    try:
        n_roots = root_ids.count()
        for level in range(1, depth + 1):
            room = max_nodes - len(taken)
            if not room or frontier == []:
                break
            # the roots of a file may be many, then they join; later frontiers are short lists
            if frontier is None and n_roots <= MOST_LISTED:
                frontier = [r["root"] for r in root_ids.collect()]
            if frontier is None:
                edges = near.held if near.held is not None else scoped_edges(graph, scope, probable, unresolved, kinds).select(*EDGE_SHORT)
                reached = edges.join(root_ids, edges["target"] == F.col("root"), "left_semi")
            else:
                reached = near(frontier, ("target",))
            reached = reached.where(~_is_one_of(F.col("source"), [r["source"] for r in taken])).join(root_ids, F.col("source") == F.col("root"), "left_anti")
            first = reached.groupBy("source").agg(F.min_by(F.struct("ord", "id", "target", "kind", "confidence"), "ord").alias("e")).select("source", "e.*").orderBy("ord").limit(room)
            new = first.withColumn("level", F.lit(level)).collect()
            taken += new
            frontier = [r["source"] for r in new]
    finally:
        near.close()
        root_ids.unpersist()
    schema = "source string, ord string, id string, target string, kind string, confidence string, level int"
    relationships = spark.createDataFrame(taken, schema)
    levels = relationships.select(F.col("source").alias("id"), "level")
    nodes = graph.nodes.join(F.broadcast(levels), "id").select(*graph.nodes.columns, "level")  # at most max_nodes
    files = nodes.where("file is not null").select("file").distinct().orderBy("file")
    tests = files.where(is_test_file(F.col("file")) if include_tests else F.lit(False))
    boundaries = relationships.where(F.col("kind").isin(*BOUNDARY_KINDS)).select("kind").distinct()
    every = spark.createDataFrame([(i, c) for i, c in enumerate(CONFIDENCES)], "rank int, confidence string")
    summary = every.join(relationships.groupBy("confidence").agg(F.count("*").alias("n")), "confidence", "left").select("rank", "confidence", F.coalesce("n", F.lit(0)).alias("n")).orderBy("rank")
    return Affected(roots.limit(max_nodes), relationships, nodes, files, tests, boundaries, summary, len(taken) >= max_nodes or n_roots > max_nodes)


def _nexts(edges: pd.DataFrame) -> dict[str, list[str]]:
    nexts: dict[str, list[str]] = {}
    for s, t in zip(edges["source"], edges["target"], strict=True):
        nexts.setdefault(s, []).append(t)
    return nexts


def _closed_cycles(nexts: dict[str, list[str]], root: str) -> dict[tuple, list[str]]:
    """Cycles closed by back edges of the depth-first search from root; of equal member sets the last is kept."""
    found: dict[tuple, list[str]] = {}
    seen, path, place, todo = {root}, [root], {root: 0}, [iter(nexts.get(root, ()))]
    while todo:
        node = next(todo[-1], None)
        if node is None:
            todo.pop()
            del place[path.pop()]
        elif node not in seen:
            seen.add(node)
            place[node] = len(path)
            path.append(node)
            todo.append(iter(nexts.get(node, ())))
        elif node in place:
            cycle = path[place[node] :]
            found[tuple(sorted(cycle))] = cycle
    return found


def _first_entries(edges: pd.DataFrame) -> pd.DataFrame:
    """The node by which a depth-first search of one root's region comes first to each component."""
    nexts, root = _nexts(edges.sort_values("ord")), edges["root"].iloc[0]
    part = dict(zip(edges["source"], edges["source_part"], strict=True)) | dict(zip(edges["target"], edges["target_part"], strict=True))
    entry: dict[str, str] = {}
    seen, todo = {root}, [root]
    stack = [iter(nexts.get(root, ()))]
    while todo:
        node = todo.pop()
        if isinstance(part.get(node), str):
            entry.setdefault(part[node], node)
        todo = []
        while stack and not todo:
            node = next(stack[-1], None)
            if node is None:
                stack.pop()
            elif node not in seen:
                seen.add(node)
                stack.append(iter(nexts.get(node, ())))
                todo = [node]
    return pd.DataFrame({"component": list(entry), "entry": list(entry.values())})


def cycles(graph: Graph, scope: str = "code", probable: bool = False, unresolved: bool = False, limit: int | None = None) -> DataFrame:
    """(members in path order, length) of the cycles that a depth-first search closes, whose roots and edges are taken in storage order; with a limit the first by their members."""
    found = cycles_of(scoped_edges(graph, scope, probable, unresolved, CYCLE_KINDS[scope == "code"]).select("ord", "source", "target"))
    return found if limit is None else found.orderBy("members").limit(limit)


def cycles_of(edges: DataFrame) -> DataFrame:
    """cycles() of edges(ord, source, target).

    A cycle lies within one strongly connected component, and the search from the component's first node stays in it until all of it is seen. So
    each component is searched by itself, once it is known where the whole search enters it: at the root, if the root is in it; at the only node that edges
    from outside lead to; only where they lead to several is the region of that root (the nodes that no earlier root reaches) walked to see which comes first."""
    c = F.col
    edges = settled(edges.where("source is not null and target is not null"))
    # roots are sources in the order of their first edge, whether or not that edge leads to a cycle; a node's root is the first one that reaches it
    first = settled(edges.groupBy(c("source").alias("node")).agg(F.min(F.struct("ord", c("source").alias("root"))).alias("label")))
    edges = settled(trimmed(edges, both=False))
    loops = edges.where("source = target").select(c("source").alias("node")).distinct()
    strong = strongly_connected(edges)
    part = settled(strong.unionByName(loops.join(strong.select("node"), "node", "left_anti").select("node", c("node").alias("component"))))
    region = settled(least_ancestor(edges, first.join(edges.select(c("source").alias("node")).distinct(), "node", "left_semi")).select("node", "label.root"))
    inner = lambda e: region.join(part, "node", "left").select(c("node").alias(e), c("root").alias(f"{e}_root"), c("component").alias(f"{e}_part"))
    placed = settled(edges.join(inner("source"), "source").join(inner("target"), "target").where("source_root = target_root"))
    inside = placed.where("source_part = target_part")
    at_root = region.where("node = root").join(part, "node").select("component", c("node").alias("entry"))
    others = part.select("component").distinct().join(at_root.select("component"), "component", "left_anti")
    doors = settled(placed.where("target_part is not null and not (source_part <=> target_part)").select(c("target_part").alias("component"), c("target").alias("entry"), c("source_root").alias("root")).distinct().join(others, "component"))
    single = doors.groupBy("component").agg(F.count_distinct("entry").alias("n"), F.min("entry").alias("entry"), F.min("root").alias("root"))
    open_ = single.where("n > 1").select("root").distinct()
    walked = placed.withColumn("root", c("source_root")).join(open_, "root").groupBy("root").applyInPandas(_first_entries, "component string, entry string")
    entries = at_root.unionByName(single.where("n = 1").select("component", "entry")).unionByName(walked.join(single.where("n > 1").select("component"), "component").select("component", "entry"))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        found = list(_closed_cycles(_nexts(rows.sort_values("ord")), rows["entry"].iloc[0]).values())
        return pd.DataFrame({"members": found, "length": [len(x) for x in found]})

    return inside.select("ord", "source", "target", c("source_part").alias("component")).join(entries, "component").groupBy("component").applyInPandas(search, "members array<string>, length long")
