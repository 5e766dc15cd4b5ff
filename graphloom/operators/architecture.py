"""Roll-up of symbol edges to files and external packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import basename
from ..schema import CONFIDENCES, Graph
from .scope import scoped_nodes, trusted

FLOW_KINDS = ("imports", "calls", "renders", "invokes", "registers", "emits", "listens", "tests")
#: The kind that a rolled-up edge shows, first found first.
KIND_PRIORITY = ("invokes", "emits", "listens", "registers", "renders", "calls", "imports", "tests")
EVIDENCE_KEPT, UNDERLYING_KEPT = 12, 24


def file_units(nodes: DataFrame) -> DataFrame:
    """One row per file that has a file node or any symbol; a missing file node is made up from the first symbol."""
    some = nodes.where("file is not null and kind not in ('directory', 'repository')")
    is_file = F.col("kind") == "file"
    grouped = some.groupBy("file").agg(
        F.max_by(F.when(is_file, F.col("id")), F.when(is_file, F.col("ord"))).alias("file_id"),
        F.max_by(F.when(is_file, F.col("language")), F.when(is_file, F.col("ord"))).alias("file_language"),
        F.min_by("language", "ord").alias("first_language"),
        F.count_if(~is_file).alias("symbol_count"),
    )
    made = F.col("file_id").isNull()
    return grouped.select("file", F.coalesce("file_id", F.concat(F.lit("file:"), "file")).alias("unit"), F.when(made, F.col("first_language")).otherwise(F.col("file_language")).alias("language"), "symbol_count", made.alias("synthesised"))


def unit_edges(graph: Graph, scope: str = "code", probable: bool = False, unresolved: bool = False) -> DataFrame:
    """Flow edges with the unit (file or external package) of both ends; pairs within one unit are left out."""
    nodes = scoped_nodes(graph.nodes, scope)
    units = file_units(nodes)
    external = F.col("kind") == "external_package"
    placed = nodes.where(~external & F.col("file").isNotNull()).select("id", "file").join(units.select("file", "unit"), "file").select("id", "unit").unionByName(nodes.where(external).select("id", F.col("id").alias("unit")))
    edges = trusted(graph.edges, scope, probable, unresolved, FLOW_KINDS)
    edges = edges.join(placed.select(F.col("id").alias("source"), F.col("unit").alias("from")), "source").join(placed.select(F.col("id").alias("target"), F.col("unit").alias("to")), "target")
    return edges.where(F.col("from") != F.col("to"))


def _pick(names: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), index + 1)


def rolled_up(edges: DataFrame) -> DataFrame:
    """One row per pair of units: kinds, shown kind, best confidence, number of edges. Counts combine before the shuffle."""
    rank = lambda c, names: F.coalesce(*[F.when(F.col(c) == n, i) for i, n in enumerate(names)])
    grouped = edges.groupBy("from", "to").agg(F.array_sort(F.collect_set("kind")).alias("edge_kinds"), F.min(rank("kind", KIND_PRIORITY)).alias("k"), F.min(rank("confidence", CONFIDENCES)).alias("c"), F.count("*").alias("underlying_count"))
    named = grouped.select(F.col("from").alias("source"), F.col("to").alias("target"), _pick(KIND_PRIORITY, F.col("k")).alias("kind"), _pick(CONFIDENCES, F.col("c")).alias("confidence"), "edge_kinds", "underlying_count")
    return named.withColumn("id", F.concat(F.lit("fileedge:"), "source", F.lit("->"), "target", F.lit(":"), F.array_join("edge_kinds", "+")))


def first_underlying(edges: DataFrame, kept: int = UNDERLYING_KEPT) -> DataFrame:
    """The first edges of each pair in storage order; the rank is limited in each task before the shuffle."""
    top = edges.withColumn("n", F.row_number().over(W.partitionBy("from", "to").orderBy("ord"))).where(F.col("n") <= kept)
    listed = top.groupBy("from", "to").agg(F.array_sort(F.collect_list(F.struct("n", "id", "evidence"))).alias("x"))
    return listed.select(F.col("from").alias("source"), F.col("to").alias("target"), F.transform("x", lambda e: e["id"]).alias("underlying"), F.slice(F.flatten(F.transform("x", lambda e: e["evidence"])), 1, EVIDENCE_KEPT).alias("evidence"))


def architecture(graph: Graph, limit: int = 100, scope: str = "code", probable: bool = False, unresolved: bool = False, flows: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, one row with truncated) of the file-level view.

    Files come first by path, linked external packages fill what is left of the limit. flows: unit_edges() as stored before; edges need them twice."""
    inside = scoped_nodes(graph.nodes, scope)
    units = file_units(inside)
    flows = unit_edges(graph, scope, probable, unresolved) if flows is None else flows
    pairs = rolled_up(flows)
    listed = units.select(F.col("unit").alias("id"), F.lit("file").alias("kind"), basename(F.col("file")).alias("name"), F.col("file").alias("qualified_name"), "file", "language", "symbol_count", "synthesised", F.lit(0).alias("group"))
    linked = pairs.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    packages = inside.where("kind = 'external_package'").join(linked, "id").select("id", "kind", "name", "qualified_name", "file", "language", F.lit(0).cast("long").alias("symbol_count"), F.lit(False).alias("synthesised"), F.lit(1).alias("group"))
    visible = listed.unionByName(packages).orderBy("group", "qualified_name", "id").limit(limit)
    ids = visible.select("id")
    shown = pairs.join(ids.withColumnRenamed("id", "source"), "source").join(ids.withColumnRenamed("id", "target"), "target")
    incoming = shown.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("incoming"))
    outgoing = shown.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("outgoing"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(f"{c}_count")
    nodes = visible.join(incoming, "id", "left").join(outgoing, "id", "left").select("id", "kind", "name", "qualified_name", "file", "language", "symbol_count", "synthesised", zero("incoming"), zero("outgoing"))
    # only what is between units that are shown is ranked
    inner = flows.join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_semi")
    edges = shown.join(first_underlying(inner), ["source", "target"]).orderBy("source", "target", "kind")
    truncated = units.agg((F.count("*") > limit).alias("truncated"))
    return nodes, edges, truncated


def contained_symbols(graph: Graph, files: DataFrame, scope: str = "code") -> DataFrame:
    """The symbols of the files listed, by line (none: 0) and name."""
    symbols = scoped_nodes(graph.nodes, scope).where("file is not null and kind not in ('directory', 'repository', 'file')").join(files.select("file").distinct(), "file")
    record = F.struct(F.coalesce("start_line", F.lit(0)).alias("line"), "name", "ord", "id", "kind")
    return symbols.groupBy("file").agg(F.array_sort(F.collect_list(record)).alias("symbols"))
