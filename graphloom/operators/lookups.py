"""Read operations that need one or two passes over the graph: overviews, lookups, searches, bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..schema import SEVERITIES, Graph
from .scope import between_scoped, is_knowledge_node, placed_edges, scoped_nodes, trusted, with_endpoints

CALLER_KINDS = ("calls", "invokes", "renders", "listens")
CALLEE_KINDS = ("calls", "invokes", "renders", "emits", "uses_type")
BINDING_KINDS = ("framework_command", "framework_event")


def clamp(value: int, least: int, most: int) -> int:
    return max(least, min(value, most))


def count_by_kind(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def census(graph: Graph) -> DataFrame:
    """How many edges there are of each kind, confidence, domain and categories of both ends: a few rows, stored, so that all counts of edges take one pass over them."""
    return cut(placed_edges(graph).groupBy("kind", "confidence", "graph_domain", "source_category", "target_category").agg(F.count("*").alias("n")))


def overview_counts(graph: Graph, scope: str = "code", edges_by: DataFrame | None = None) -> DataFrame:
    """One row: scoped counts (diagnostics are never scoped) and total counts. edges_by: the census, where it was taken already."""
    edges_by = census(graph) if edges_by is None else edges_by
    total = graph.nodes.agg(F.count("*").alias("total_nodes"), F.count_if((F.col("kind") == "file") & F.col("file").isNotNull()).alias("total_files"))
    scoped = scoped_nodes(graph.nodes, scope).agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "file").alias("files"))
    edges = between_scoped(edges_by, scope).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))
    all_edges = edges_by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_edges"))
    diagnostics = graph.diagnostics.agg(F.count("*").alias("diagnostics"))
    out = total
    for one in (scoped, edges, all_edges, diagnostics):
        out = out.join(one)  # one row each
    return out.select("files", "nodes", "edges", "diagnostics", "total_files", "total_nodes", "total_edges")


def overview_nodes(graph: Graph, scope: str = "code") -> DataFrame:
    return count_by_kind(scoped_nodes(graph.nodes, scope))


def overview_edges(graph: Graph, scope: str = "code", edges_by: DataFrame | None = None) -> DataFrame:
    edges_by = census(graph) if edges_by is None else edges_by
    return between_scoped(edges_by, scope).groupBy("kind").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "kind")


def overview(graph: Graph, scope: str = "code", repository: dict[str, str] | None = None) -> DataFrame:
    """The whole overview as rows (part, name, value): the repository's own facts, scope, scoped and total counts, nodes and edges by kind, and the extractors that ran with what they found."""
    spark, edges_by = graph.spark, census(graph)
    facts = {"scope": scope} | (repository or {})
    told = spark.createDataFrame([("repository" if k != "scope" else "request", k, str(v)) for k, v in facts.items()], "part string, name string, value string")
    names = ("files", "nodes", "edges", "diagnostics", "total_files", "total_nodes", "total_edges")
    counts = overview_counts(graph, scope, edges_by).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("c")).select(F.when(F.col("c.name").startswith("total_"), "total").otherwise("count").alias("part"), F.regexp_replace("c.name", "^total_", "").alias("name"), "c.value")
    kinds = lambda df, part: df.select(F.lit(part).alias("part"), F.col("kind").alias("name"), F.col("n").alias("value"))
    ran = graph.runs.where("detected").groupBy("adapter").agg(F.max("node_count").alias("n")).select(F.lit("adapter").alias("part"), F.col("adapter").alias("name"), F.col("n").alias("value"))
    out = told
    for df in (counts, kinds(overview_nodes(graph, scope), "nodes_by_kind"), kinds(overview_edges(graph, scope, edges_by), "edges_by_kind"), ran):
        out = out.unionByName(df.withColumn("value", F.col("value").cast("string")))
    return out


def adapters(graph: Graph) -> DataFrame:
    return graph.runs.orderBy("adapter")


def severity_rank() -> Column:
    out = F.lit(len(SEVERITIES) - 1)
    for i, s in reversed(list(enumerate(SEVERITIES[:-1]))):
        out = F.when(F.col("severity") == s, i).otherwise(out)
    return out


def diagnostics(graph: Graph) -> DataFrame:
    return graph.diagnostics.orderBy(severity_rank(), "code", "ord")


def diagnostic_facets(graph: Graph) -> DataFrame:
    return graph.diagnostics.groupBy("severity", "code").agg(F.count("*").alias("n"))


def files(graph: Graph, scope: str = "code") -> DataFrame:
    """Per file node: nodes of the file, and trusted edges that start or end in it."""
    inside = scoped_nodes(graph.nodes, scope)
    in_file = inside.where("file is not null").select("id", "file")
    edges = trusted(graph.edges, scope).select("source", "target")
    ids = inside.select("id")
    # each end's file is looked up once; the other end only has to exist in scope
    out_going = edges.join(in_file.withColumnRenamed("id", "source"), "source").join(ids.withColumnRenamed("id", "target"), "target").groupBy("file").agg(F.count("*").alias("outgoing"))
    in_coming = edges.join(in_file.withColumnRenamed("id", "target"), "target").join(ids.withColumnRenamed("id", "source"), "source").groupBy("file").agg(F.count("*").alias("incoming"))
    counts = in_file.groupBy("file").agg(F.count("*").alias("node_count"))
    listed = inside.where("kind = 'file' and file is not null").select("file", "language")
    joined = listed.join(counts, "file", "left").join(out_going, "file", "left").join(in_coming, "file", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(f"{c}_count" if c != "node_count" else c)
    return joined.select(F.col("file").alias("path"), "language", zero("node_count"), zero("outgoing"), zero("incoming")).orderBy("path")


def file_nodes(graph: Graph, file: str, scope: str = "code") -> DataFrame:
    return scoped_nodes(graph.nodes.where(F.col("file") == file), scope).orderBy(F.col("start_line").asc_nulls_first(), "name", "ord")


def _touching(graph: Graph, ids: DataFrame, end: str, **options) -> DataFrame:
    return graph.edges.join(ids.select(F.col("id").alias(end)), end).select(*graph.edges.columns)


def file_dependencies(graph: Graph, file: str, scope: str = "code", probable: bool = False, unresolved: bool = False) -> DataFrame:
    """Edges that start inside the file; those that end inside too are listed here as well as among the reverse ones."""
    edges = _touching(graph, file_nodes(graph, file, scope), "source")
    return with_endpoints(trusted(edges, scope, probable, unresolved), graph.nodes, scope)


def file_reverse_dependencies(graph: Graph, file: str, scope: str = "code", probable: bool = False, unresolved: bool = False) -> DataFrame:
    edges = _touching(graph, file_nodes(graph, file, scope), "target")
    return with_endpoints(trusted(edges, scope, probable, unresolved), graph.nodes, scope)


def like(column: Column, term: str) -> Column:
    """SQL LIKE %term% that ignores the case of A-Z only; % and _ stay wildcards, nothing escapes them."""
    folded = F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wanted = "".join(c.lower() if c.isascii() else c for c in term).replace("\\", "\\\\")
    return folded.like(f"%{wanted}%")


def search_symbols(graph: Graph, query: str, limit: int = 50, scope: str = "code", unresolved: bool = False) -> DataFrame:
    """Ranked matches by name or qualified name. Four times the limit is fetched before the scope filter, so fewer rows than the limit may come."""
    hits = graph.nodes.where(like(F.col("name"), query) | like(F.col("qualified_name"), query))
    if not unresolved:
        hits = hits.where("kind != 'unresolved_symbol'")
    rank = F.when(F.col("name") == query, 0).when(F.col("kind") == "unresolved_symbol", 2).otherwise(1)
    order = ("_rank", "name", "qualified_name", "ord")
    fetched = hits.withColumn("_rank", rank).orderBy(*order).limit(4 * limit)
    return scoped_nodes(fetched, scope).orderBy(*order).limit(limit).drop("_rank")


def symbol(graph: Graph, node_id: str) -> DataFrame:
    return graph.nodes.where(F.col("id") == node_id)


def _at(graph: Graph, end: str, node_id: str, kinds: tuple[str, ...], limit: int, scope: str, probable: bool, unresolved: bool) -> DataFrame:
    edges = trusted(graph.edges.where(F.col(end) == node_id), scope, probable, unresolved, kinds if scope == "code" else None)
    return with_endpoints(edges, graph.nodes, scope).orderBy("ord").limit(limit)


def callers(graph: Graph, node_id: str, limit: int = 50, scope: str = "code", probable: bool = False, unresolved: bool = False) -> DataFrame:
    """The first edges, in storage order, by which others use the symbol."""
    return _at(graph, "target", node_id, CALLER_KINDS, limit, scope, probable, unresolved)


def callees(graph: Graph, node_id: str, limit: int = 50, scope: str = "code", probable: bool = False, unresolved: bool = False) -> DataFrame:
    return _at(graph, "source", node_id, CALLEE_KINDS, limit, scope, probable, unresolved)


def nodes_by_ids(graph: Graph, ids: DataFrame, column: str) -> DataFrame:
    """Nodes whose id occurs in a bounded result."""
    return graph.nodes.join(ids.select(F.col(column).alias("id")).distinct(), "id").select(*graph.nodes.columns)


def framework_bindings(graph: Graph, framework: str | None = None, scope: str = "code", probable: bool = False, unresolved: bool = False) -> tuple[DataFrame, DataFrame]:
    """Command and event nodes (whatever the scope), related nodes, and the scoped edges that touch them."""
    chosen = graph.nodes.where(F.col("kind").isin(*BINDING_KINDS))
    if framework:
        chosen = chosen.where(F.col("framework") == framework)
    some = trusted(graph.edges, scope, probable, unresolved)
    ids = chosen.select("id")
    touching = some.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").unionByName(some.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").join(ids.withColumnRenamed("id", "source"), "source", "left_anti"))
    edges = with_endpoints(touching, graph.nodes, scope)
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    related = graph.nodes.join(ends, "id", "left_semi").join(ids, "id", "left_anti")
    return chosen.unionByName(related), edges


def architecture_knowledge(graph: Graph, scope: str, limit: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first nodes by the rank of their kind, the scoped edges among them, and one row with whether nodes were left out."""
    rank = F.when(is_knowledge_node(), 6).otherwise(5)
    for i, kind in enumerate(("repository", "directory", "framework_command", "framework_event", "file")):
        rank = F.when(F.col("kind") == kind, i).otherwise(rank)
    top = scoped_nodes(graph.nodes, scope).withColumn("rank", rank).orderBy("rank", "qualified_name", "ord").limit(limit)
    ids = top.select("id")
    edges = trusted(graph.edges, scope)
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("id", end), end)
    return top, edges.select(*graph.edges.columns), scoped_nodes(graph.nodes, scope).agg((F.count("*") > limit).alias("truncated"))
