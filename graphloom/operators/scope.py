"""Predicates of scopes and confidences, and the node and edge sets they select."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CONFIDENCES, KNOWLEDGE_EDGE_KINDS, KNOWLEDGE_NODE_KINDS, SCOPES, Graph

#: Categories of knowledge nodes that each scope admits beside code; full admits all, also those without a category.
CATEGORIES = {"code": (), "code+docs": ("docs",), "code+config": ("config", "semantic"), "code+tests": ("tests",)}
# Paths that count as tests in queries.
TEST_PATHS = (r"\.(?:test|spec)\.[^.]+$", r"(?:^|/)__tests__(?:/|$)", r"(?:^|/)tests?/[^/]+$")


def confidences(probable: bool = False, unresolved: bool = False) -> list[str]:
    return [c for c in CONFIDENCES if c in ("exact", "resolved") or (c == "probable" and (probable or unresolved)) or (c == "unresolved" and unresolved)]


def is_knowledge_node() -> Column:
    return (F.coalesce(F.col("graph_domain"), F.lit("")) == "knowledge") | F.col("kind").isin(*KNOWLEDGE_NODE_KINDS)


def is_knowledge_edge() -> Column:
    return (F.coalesce(F.col("graph_domain"), F.lit("")) == "knowledge") | F.col("kind").isin(*KNOWLEDGE_EDGE_KINDS)


def node_in_scope(scope: str = "code") -> Column:
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}; one of {', '.join(SCOPES)}")
    if scope == "full":
        return F.lit(True)
    admitted = CATEGORIES[scope]
    return ~is_knowledge_node() | (F.col("source_category").isin(*admitted) & F.col("source_category").isNotNull() if admitted else F.lit(False))


def category() -> Column:
    """What a node is to the scopes, in one word: code, or its category among knowledge."""
    return F.when(is_knowledge_node(), F.coalesce("source_category", F.lit(""))).otherwise("code")


def end_in_scope(end: str, scope: str = "code") -> Column:
    """node_in_scope() of an edge's end, by the category stored with the edge (null: there is no such node)."""
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}; one of {', '.join(SCOPES)}")
    known = F.col(f"{end}_category")
    return known.isNotNull() if scope == "full" else F.coalesce(known.isin("code", *CATEGORIES[scope]), F.lit(False))


def is_test_file(file: Column) -> Column:
    out = F.lit(False)
    for pattern in TEST_PATHS:
        out = out | file.rlike(pattern)
    return out


def scoped_nodes(nodes: DataFrame, scope: str = "code") -> DataFrame:
    return nodes.where(node_in_scope(scope))


def trusted(edges: DataFrame, scope: str = "code", probable: bool = False, unresolved: bool = False, kinds: Iterable[str] | None = None) -> DataFrame:
    """The filters of an edge set that need no nodes; they reach the scan."""
    out = edges.where(F.col("confidence").isin(*confidences(probable, unresolved)))
    if kinds is not None:
        out = out.where(F.col("kind").isin(*kinds))
    return out.where(~is_knowledge_edge()) if scope == "code" else out


def with_endpoints(edges: DataFrame, nodes: DataFrame, scope: str = "code") -> DataFrame:
    """Edges whose both ends are nodes in scope. Ids are unique, so inner joins keep the rows and let either side be the small one."""
    ids = scoped_nodes(nodes, scope).select("id")
    out = edges.join(ids.select(F.col("id").alias("source")), "source").join(ids.select(F.col("id").alias("target")), "target")
    return out.select(*edges.columns)


def placed_edges(graph: Graph) -> DataFrame:
    """The edges with the categories of both ends."""
    if graph.placed is not None:
        return graph.placed
    ends, edges = graph.nodes.select("id", category().alias("c")), graph.edges
    for end in ("source", "target"):
        edges = edges.join(ends.select(F.col("id").alias(end), F.col("c").alias(f"{end}_category")), end, "left")
    return edges.select(*graph.edges.columns, "source_category", "target_category")


def between_scoped(placed: DataFrame, scope: str = "code", probable: bool = False, unresolved: bool = False, kinds: Iterable[str] | None = None) -> DataFrame:
    """Of edges with the categories of both ends, those of an edge set whose ends are in scope."""
    return trusted(placed, scope, probable, unresolved, kinds).where(end_in_scope("source", scope) & end_in_scope("target", scope))


def scoped_edges(graph: Graph, scope: str = "code", probable: bool = False, unresolved: bool = False, kinds: Iterable[str] | None = None) -> DataFrame:
    if graph.placed is None:
        return with_endpoints(trusted(graph.edges, scope, probable, unresolved, kinds), graph.nodes, scope)
    return between_scoped(graph.placed, scope, probable, unresolved, kinds).select(*graph.edges.columns)
