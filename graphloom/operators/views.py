"""What a graph view needs: languages, lanes, labels, focus, filters and grid places, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import KNOWLEDGE_EDGE_KINDS
from .lookups import CALLEE_KINDS, CALLER_KINDS

# The order of lanes, the edges of a readable view, cell sizes, and the paths that decide a lane (first match).
LANES = ("frontend", "bridge", "rust", "api", "adapters", "cli", "core", "tests", "external", "knowledge", "other")
READABLE_KINDS = ("imports", "calls", "renders", "invokes", "registers", "emits", "listens")
FRAMEWORK_EDGES = ("invokes", "registers", "emits", "listens")
TEST_PATH = r"(^|/)(__tests__|tests?)/|\.(test|spec)\.[^/]+$"
FRONTEND_PATH = r"\.tsx$|(^|/)(src/ui|src/frontend|src/components|components)/"
BRIDGE_PATH = r"(^|/)(src/bridge|src/runtime|bridge|tauri|invoke|event|window)s?/|(^|/)(commands|events|event-bus|window|invoke)\.[tj]sx?$"
RUST_PATH = r"\.rs$|src-tauri/src/"
API_PATH = r"(^|/)(src/server|src/api|api|routes|controllers|services)/|/server\."
ADAPTER_PATH, CLI_PATH = r"(^|/)src/adapters/", r"(^|/)(src/cli|src/mcp)/"
CORE_PATH = r"(^|/)(src/core|src/lib|src/shared|src/types|src/utils|domain|graph|query|storage|analysis)/"


def node_language() -> Column:
    """The language that a node counts under: its category, its domain, its own language, or what kind and file say."""
    c, file = F.col, F.coalesce("file", F.lit(""))
    return (
        F.when(c("source_category").isin("docs", "config", "tests", "semantic"), c("source_category")).when(c("graph_domain") == "knowledge", "knowledge").when(c("language").isNotNull(), c("language"))
        .when(c("kind") == "react_component", "typescript").when(c("kind").isin("framework_command", "framework_event"), "framework").when(file.endswith(".rs"), "rust").when(file.rlike(r"\.(?:ts|tsx|js|jsx|mts|cts)$"), "typescript")
    )


def lane() -> Column:
    """The part of an architecture that a node belongs to: the first rule that holds."""
    c = F.col
    path = F.lower(F.replace(F.coalesce("file", "qualified_name", F.lit("")), F.lit("\\"), F.lit("/")))
    kind = lambda *k: c("kind").isin(*k)
    return (
        F.when(c("graph_domain") == "knowledge", "knowledge").when(kind("external_package"), "external").when(path.rlike(TEST_PATH) | (F.coalesce("source_category", F.lit("")) == "tests"), "tests")
        .when(kind("react_component") | (F.lower(F.coalesce("framework", F.lit(""))) == "react") | path.rlike(FRONTEND_PATH), "frontend").when(kind("framework_command", "framework_event") | path.rlike(BRIDGE_PATH), "bridge")
        .when((F.coalesce("language", F.lit("")) == "rust") | path.rlike(RUST_PATH), "rust").when(path.rlike(API_PATH), "api").when(path.rlike(ADAPTER_PATH), "adapters").when(path.rlike(CLI_PATH), "cli").when(path.rlike(CORE_PATH), "core")
        .when(kind("repository", "directory"), "core").when(kind("api_surface"), "api").when(kind("cli_command"), "cli").when(kind("test_artifact"), "tests").otherwise("other")
    )


def dominant_kinds(nodes: DataFrame) -> DataFrame:
    """(file, kind): the commonest kind of symbol in each file; of equal counts the one met first in storage order."""
    inside = nodes.where("file is not null and kind not in ('file', 'directory', 'repository')")
    counts = inside.groupBy("file", "kind").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return counts.groupBy("file").agg(F.min_by("kind", F.struct(-F.col("n"), "first")).alias("kind"))


def kind_labels(nodes: DataFrame) -> DataFrame:
    """nodes with label: what a file mainly holds; other nodes are labelled by their kind."""
    c = F.col
    top = F.col("_top")
    joined = nodes.join(dominant_kinds(nodes).select(c("file"), c("kind").alias("_top")), "file", "left")
    label = (
        F.when(c("kind") == "external_package", "Package").when(c("kind") != "file", c("kind")).when(top == "react_component", "Component").when(top == "framework_command", "Command").when(top.isin("function", "method"), "Service")
        .when(top.isin("type_alias", "interface"), "Types").when(lane() == "tests", "Test").when(lane() == "rust", "Module").otherwise("Source File")
    )
    return joined.withColumn("label", label).select(*nodes.columns, "label")


def badge() -> Column:
    c, file = F.col, F.coalesce("file", F.lit(""))
    language = node_language()
    return F.when(c("kind") == "external_package", "PKG").when(language == "rust", "RS").when(file.endswith(".tsx"), "TSX").when(file.endswith(".ts"), "TS").when(language == "typescript", "TS").otherwise(F.upper(F.substring(F.coalesce(language, c("kind")), 1, 4)))


def edge_label(count: Column) -> Column:
    return F.concat(F.lit("edge."), F.col("kind"), F.when(count > 1, F.concat(F.lit(" ×"), count.cast("string"))).otherwise(""))


def focus(nodes: DataFrame, edges: DataFrame, node: str | None = None, edge: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with selected, connected, dimmed; edges with selected, incoming, outgoing, dimmed) around one node or edge."""
    c = F.col
    at = F.lit(node)
    touching = edges.where((c("source") == at) | (c("target") == at))
    near = touching.select(F.when(c("source") == at, c("target")).otherwise(c("source")).alias("id")).where(c("id") != at).distinct().withColumn("_near", F.lit(True))
    linked = node is not None and not near.isEmpty()
    is_node = F.coalesce(c("id") == at, F.lit(False))
    close = F.coalesce("_near", F.lit(False))
    shown = nodes.join(near, "id", "left").select(*nodes.columns, is_node.alias("selected"), (close & ~is_node).alias("connected"), (F.lit(linked) & ~close & ~is_node).alias("dimmed"))
    into, out_of = F.coalesce(c("target") == at, F.lit(False)), F.coalesce(c("source") == at, F.lit(False))
    lines = edges.select(*edges.columns, F.coalesce(c("id") == F.lit(edge), F.lit(False)).alias("selected"), into.alias("incoming"), out_of.alias("outgoing"), (F.lit(linked) & ~into & ~out_of).alias("dimmed"))
    return shown, lines


def visible(nodes: DataFrame, edges: DataFrame, names: list[str], architecture: bool = False, edge_kind: str = "readable", code: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes of the chosen lanes or languages, and the edges between them of one kind, of the readable kinds or of all."""
    c = F.col
    placed = nodes.withColumn("_lane", lane()).withColumn("_language", node_language())
    kept = placed.where(c("_lane").isin(*names) if architecture else (c("_language").isNull() | c("_language").isin(*names) | c("_lane").isin(*names))).select(*nodes.columns)
    ids = kept.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)
    if edge_kind == "all" or (edge_kind == "readable" and not code):
        return kept, inside
    return kept, inside.where(c("kind").isin(*READABLE_KINDS) if edge_kind == "readable" else c("kind") == edge_kind)


def columns_of(lane_name: Column, n: Column) -> Column:
    """How many columns a lane's grid has."""
    fifth = F.ceil(n / 5).cast("int")
    return (
        F.when(n <= 1, 1).when(lane_name.isin("tests", "frontend", "core", "rust"), F.least(F.lit(4), F.greatest(F.lit(2), fifth))).when(lane_name.isin("external", "adapters"), F.least(F.lit(3), F.greatest(F.lit(2), fifth)))
        .when(lane_name.isin("bridge", "api", "cli"), F.least(F.lit(3), n.cast("int"))).otherwise(F.least(F.lit(3), F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))))
    )


def grid(nodes: DataFrame) -> DataFrame:
    """(id, lane, columns, col, row): places in each lane's grid by qualified name.

    A view holds a few hundred nodes; bound nodes (e.g. by architecture()) before asking for places."""
    c = F.col
    placed = nodes.select("id", "qualified_name", lane().alias("lane"))
    sizes = placed.groupBy("lane").agg(F.count("*").alias("n"))  # LANES at most
    nth = F.row_number().over(W.partitionBy("lane").orderBy("qualified_name", "id")) - 1
    rows = placed.join(F.broadcast(sizes), "lane").withColumn("columns", columns_of(c("lane"), c("n"))).withColumn("nth", nth)
    return rows.select("id", "lane", "columns", (c("nth") % c("columns")).alias("col"), F.floor(c("nth") / c("columns")).cast("int").alias("row"))


def lane_audit(places: DataFrame) -> DataFrame:
    """Per lane: children, columns, rows, and the cells that its grid spans."""
    return places.groupBy("lane").agg(F.count("*").alias("children"), F.max("columns").alias("columns"), (F.max("row") + 1).alias("rows"), F.min("col").alias("min_col"), F.max("col").alias("max_col"), F.avg("row").alias("mean_row"))


def diagnostics_view(diagnostics: DataFrame, severity: str = "all", adapter: str = "all", code: str = "all", file: str = "") -> DataFrame:
    out = diagnostics
    for name, value in (("severity", severity), ("adapter", adapter), ("code", code)):
        out = out if value == "all" else out.where(F.col(name) == value)
    return out.where(F.contains(F.lower("file"), F.lit(file.strip().lower()))) if file.strip() else out


def files_like(files: DataFrame, text: str, most: int | None = None) -> DataFrame:
    found = files.where(F.contains(F.lower("path"), F.lit(text.strip().lower()))) if text.strip() else files
    return found if most is None else found.orderBy("path").limit(most)


def relation_counts(edges: DataFrame, node: str) -> DataFrame:
    """One row: how many incoming, outgoing, caller, callee, import, framework and knowledge edges a node has."""
    into, out_of = F.col("target") == node, F.col("source") == node
    kind = lambda *k: F.col("kind").isin(*k)
    return edges.where(into | out_of).agg(
        F.count_if(into).alias("incoming"), F.count_if(out_of).alias("outgoing"), F.count_if(into & kind(*CALLER_KINDS)).alias("callers"), F.count_if(out_of & kind(*CALLEE_KINDS)).alias("callees"), F.count_if(kind("imports")).alias("dependencies"), F.count_if(kind(*FRAMEWORK_EDGES)).alias("framework"), F.count_if(kind(*KNOWLEDGE_EDGE_KINDS)).alias("knowledge")
    )


def affected_graph(nodes: DataFrame, more_nodes: DataFrame, edges: DataFrame, more_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The union of two graphs by id; the first one's rows win."""
    both = lambda a, b: a.unionByName(b.join(a.select("id"), "id", "left_anti").select(*a.columns))
    return both(nodes, more_nodes), both(edges, more_edges)
