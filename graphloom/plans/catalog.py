"""The registered queries over the relational graph, each with its equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import architecture as arch
from ..operators import context as ctx
from ..operators import lookups as q
from ..operators import scope as sc
from ..operators import snapshots, traverse
from ..operators.scope import scoped_edges
from ..sources.tables import graph_of, read, trade_graph
from . import text_catalog, text_oracle
from .oracle import SQL

Query = Callable[[SparkSession, str], DataFrame]
PART, PACKAGE, EVENT, TASK = "fn:p5", "pkg:s3", "evt:click", "brand standard click customer doc"
FILE = "standard/Brand1.ts"


def _edges(df: DataFrame) -> DataFrame:
    return df.select("id", "source", "target", "kind", "confidence")


def _nodes(df: DataFrame) -> DataFrame:
    return df.select("id", "kind", "name", "qualified_name", "file")


def _scoped_nodes(scope: str) -> Query:
    return lambda spark, d: _nodes(sc.scoped_nodes(graph_of(spark, d).nodes, scope))


def _scoped_edges(**options) -> Query:
    return lambda spark, d: _edges(scoped_edges(graph_of(spark, d), **options))


def _over(f: Callable) -> Query:
    return lambda spark, d: f(graph_of(spark, d))


def _documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of the documents: as they are, and an older one in which some were missing and some differed."""
    now = read(spark, d, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("content"), "doc_id")
    old = now.where("doc_id % 10 != 0").withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    gone = now.where("doc_id % 50 = 0").select(F.concat(F.lit("old/"), "path").alias("path"), "content", "doc_id")
    return snapshots.fingerprints(old.unionByName(gone)), snapshots.fingerprints(now)


def _diff(state: str) -> Query:
    return lambda spark, d: snapshots.changes(*_documents(spark, d)).where(F.col("change") == state).select("path")


QUERIES: dict[str, Query] = {
    "overview_counts": _over(q.overview_counts),
    "overview_report": _over(lambda g: q.overview(g, "code", {"name": "tables"})),
    "architecture_knowledge_truncated": _over(lambda g: q.architecture_knowledge(g, "code+docs", 80)[2]),
    "overview_nodes_by_kind": _over(q.overview_nodes),
    "overview_edges_by_kind": _over(lambda g: q.overview_edges(g, "full")),
    "scoped_nodes_code": _scoped_nodes("code"),
    "scoped_nodes_docs": _scoped_nodes("code+docs"),
    "scoped_nodes_config": _scoped_nodes("code+config"),
    "scoped_nodes_tests": _scoped_nodes("code+tests"),
    "scoped_nodes_full": _scoped_nodes("full"),
    "scoped_edges_trusted": _scoped_edges(),
    "scoped_edges_probable": _scoped_edges(probable=True),
    "scoped_edges_unresolved": _scoped_edges(unresolved=True, scope="full"),
    "adapters_runs": _over(lambda g: q.adapters(g).select("adapter", "detected", "file_count", "node_count", "edge_count", "diagnostic_count")),
    "diagnostics_ranked": _over(lambda g: q.diagnostics(g).select("code", "severity", "message", q.severity_rank().alias("rank"))),
    "diagnostics_facets": _over(q.diagnostic_facets),
    "files_summary": _over(q.files),
    "file_details_nodes": _over(lambda g: _nodes(q.file_nodes(g, FILE))),
    "file_details_deps": _over(lambda g: _edges(q.file_dependencies(g, FILE))),
    "file_details_reverse": _over(lambda g: _edges(q.file_reverse_dependencies(g, FILE, probable=True))),
    "search_symbols": _over(lambda g: _nodes(q.search_symbols(g, "brand1", 50, "code"))),
    "search_symbols_unresolved": _over(lambda g: _nodes(q.search_symbols(g, "MISSING", 20, unresolved=True))),
    "symbol_lookup": _over(lambda g: _nodes(q.symbol(g, PART))),
    "callers": _over(lambda g: _edges(q.callers(g, PART))),
    "callees": _over(lambda g: _edges(q.callees(g, PART, probable=True))),
    "callers_full_scope": _over(lambda g: _edges(q.callers(g, EVENT, 30, "full", probable=True))),
    "framework_bindings_nodes": _over(lambda g: _nodes(q.framework_bindings(g, "events", probable=True)[0])),
    "framework_bindings_edges": _over(lambda g: _edges(q.framework_bindings(g, "events", probable=True)[1])),
    "architecture_nodes": _over(lambda g: arch.architecture(g, 60)[0].select("id", "kind", "name", "symbol_count", "synthesised", "incoming_count", "outgoing_count")),
    "architecture_edges": _over(lambda g: arch.rolled_up(arch.unit_edges(g)).select("id", "source", "target", "kind", "confidence", "underlying_count")),
    "architecture_knowledge": _over(lambda g: _nodes(q.architecture_knowledge(g, "code+docs", 80)[0])),
    "context_symbols": _over(lambda g: ctx.ranked_symbols(g, TASK, pool=ctx.POOL).select("id", "degree", F.round("score", 6).alias("score"), F.array_join("reasons", "; ").alias("reasons"))),
    "context_files": _over(lambda g: ctx.context(g, TASK, pool=ctx.POOL).files.select("file", F.round("score", 6).alias("score"))),
    "context_relationships": _over(lambda g: _edges(ctx.context(g, TASK).relationships)),
    "context_related_tests": _over(lambda g: ctx.context(g, TASK).related_tests),
    "degrees": _over(lambda g: ctx.degrees(g.edges)),
    "neighborhood_d2": _over(lambda g: _nodes(traverse.neighborhood(g, PART, 2, 50).nodes)),
    "neighborhood_edges": _over(lambda g: traverse.neighborhood(g, PART, 2, 50).edges.select("id", "level")),
    "neighborhood_kinds": _over(lambda g: _nodes(traverse.neighborhood(g, PACKAGE, 1, 20, edge_kinds=["imports"]).nodes)),
    "affected_direct": _over(lambda g: traverse.affected(g, PART, 1, 40).relationships.select("id", "source", "target", "level")),
    "affected_transitive": _over(lambda g: traverse.affected(g, PART, 2, 60).relationships.select("id", "source", "target", "level")),
    "affected_confidence": _over(lambda g: traverse.affected(g, PART, 2, 60).confidence_summary.select("confidence", "n")),
    "affected_files": _over(lambda g: traverse.affected(g, PART, 2, 60).files),
    "cycles_all": lambda spark, d: traverse.cycles(trade_graph(spark, d)).select(F.array_join("members", ",").alias("members"), "length"),
    "cycles_self_loops": lambda spark, d: traverse.cycles(trade_graph(spark, d)).where("length = 1").select(F.col("members")[0].alias("id")),
    "status_added": _diff("added"),
    "status_modified": _diff("modified"),
    "status_deleted": _diff("deleted"),
    "mentions": _over(lambda g: g.edges.where("kind = 'mentions'").select("source", "target")),
    "name_multiplicity": _over(lambda g: g.nodes.where("kind = 'function'").groupBy("name").agg(F.count("*").alias("n"))),
}
QUERIES |= text_catalog.QUERIES
ORACLE_SQL: dict[str, str] = {k: v for k, v in (SQL | text_oracle.SQL).items() if k in QUERIES}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Who uses a symbol: the smallest complete question to the graph."""
    return QUERIES["callers"](spark, d)
