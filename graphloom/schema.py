"""Tables and vocabularies of the property graph."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "1.1.0"

# The vocabularies of the data model.
NODE_KINDS = (
    "repository", "directory", "file", "module", "function", "method", "class", "interface", "type_alias", "react_component", "struct", "enum", "trait", "framework_command",
    "framework_event", "external_package", "unresolved_symbol", "doc_section", "configuration", "api_surface", "cli_command", "test_artifact", "external_service", "security_boundary", "concept", "feature", "workflow",
)
EDGE_KINDS = (
    "contains", "imports", "calls", "renders", "uses_type", "passes_callback", "extends", "implements", "registers", "invokes", "emits", "listens", "documents", "explains", "mentions", "configured_by", "configures",
    "exposes_api", "describes_workflow", "tests", "related_to",
)
KNOWLEDGE_NODE_KINDS = ("doc_section", "configuration", "api_surface", "cli_command", "test_artifact", "external_service", "security_boundary", "concept", "feature", "workflow")
KNOWLEDGE_EDGE_KINDS = ("documents", "explains", "mentions", "configured_by", "configures", "exposes_api", "describes_workflow", "tests", "related_to")
CONFIDENCES = ("exact", "resolved", "probable", "unresolved")
SEVERITIES = ("error", "warning", "info")
SCOPES = ("code", "code+docs", "code+config", "code+tests", "full")

EVIDENCE = T.StructType([T.StructField("file", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("line", "column", "end_line", "end_column")], *[T.StructField(n, T.StringType()) for n in ("adapter", "matched_syntax", "binding_name", "resolution_method")]])
NODE = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("ord", "id", "kind", "name", "qualified_name", "language", "file")],
    *[T.StructField(n, T.IntegerType()) for n in ("start_line", "start_column", "end_line", "end_column")],
    *[T.StructField(n, T.StringType()) for n in ("adapter", "graph_domain", "source_category", "framework", "metadata")],
])
EDGE = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("ord", "id", "source", "target", "kind", "confidence", "graph_domain")],
    T.StructField("evidence", T.ArrayType(EVIDENCE)),
    T.StructField("metadata", T.StringType()),
])
#: Edges with what both ends' nodes are to the scopes (see operators.scope.category; null: there is no such node).
PLACED = T.StructType([*EDGE.fields, T.StructField("source_category", T.StringType()), T.StructField("target_category", T.StringType())])
DIAGNOSTIC = T.StructType([*[T.StructField(n, T.StringType()) for n in ("ord", "code", "severity", "message", "file")], T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("adapter", T.StringType()), T.StructField("metadata", T.StringType())])
RUN = T.StructType([T.StructField("adapter", T.StringType()), T.StructField("detected", T.BooleanType()), *[T.StructField(n, T.LongType()) for n in ("duration_ms", "file_count", "node_count", "edge_count", "diagnostic_count")]])


@dataclass(frozen=True)
class Graph:
    """A property graph: four DataFrames. `ord` is the storage order that all bounded results follow.

    It is a sortable string made from each row's natural key, so no global numbering is ever needed."""

    nodes: DataFrame
    edges: DataFrame
    diagnostics: DataFrame
    runs: DataFrame
    #: Of a stored graph: incident(ids, ends) reads the edges that have one of a few ids at one of the ends, with the categories of both ends.
    incident: Callable[[list[str], tuple[str, ...]], DataFrame] | None = None
    #: The edges with the categories of both ends (PLACED), where the source knows these for less than joining all edges with all nodes.
    placed: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession


def shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the schema's columns; those that it lacks are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def evidence(**fields: Column | str | int | None) -> Column:
    """One evidence record; fields not named are null."""
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*[value(fields.get(f.name)).cast(f.dataType).alias(f.name) for f in EVIDENCE.fields])


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def sortable(key: Column, width: int = 14) -> Column:
    """A number as a string that sorts like it."""
    return F.lpad(key.cast("string"), width, "0")
