"""Shapes of results: compact, standard and full nodes and edges, and text for a terminal."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("compact", "standard", "full")
# The metadata that a view may see.
SHOWN_METADATA = ("uiGranularity", "symbolCount", "incomingCount", "outgoingCount", "containedSymbols", "aggregated", "edgeKinds", "underlyingEdgeCount", "underlyingEdges")
EVIDENCE_MOST = 100


def evidence_kept(mode: str, most: int | None = None) -> int:
    return max(0, min((1 if mode == "compact" else 3) if most is None else most, EVIDENCE_MOST))


def shown_metadata(metadata: Column) -> Column:
    """The whitelisted entries of a JSON object as JSON, in the whitelist's order; null where there is none."""
    entries = F.from_json(metadata, "map<string, string>")
    picked = F.filter(F.transform(F.array(*map(F.lit, SHOWN_METADATA)), lambda k: F.struct(k.alias("key"), F.try_element_at(entries, k).alias("value"))), lambda e: F.map_contains_key(entries, e["key"]))
    return F.when(F.size(picked) > 0, F.to_json(F.map_from_entries(picked)))


def shaped_nodes(nodes: DataFrame, mode: str = "compact") -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    if mode == "full":
        return nodes.drop("ord")
    short = ["id", "name", "kind", "file", "start_line"]
    return nodes.select(*short) if mode == "compact" else nodes.select(*short, "qualified_name", "language", "adapter", shown_metadata(F.col("metadata")).alias("metadata"))


def shaped_edges(edges: DataFrame, mode: str = "compact", most: int | None = None) -> DataFrame:
    """Edges with the first pieces of evidence; compact ones keep only where it lies."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    proof = F.slice("evidence", 1, evidence_kept(mode, most))
    if mode == "full":
        return edges.drop("ord").withColumn("evidence", proof)
    if mode == "compact":
        proof = F.transform(proof, lambda e: F.struct(e["file"].alias("file"), e["line"].alias("line"), e["column"].alias("column")))
    more = [shown_metadata(F.col("metadata")).alias("metadata")] if mode == "standard" else []
    return edges.select("id", "source", "target", "kind", "confidence", *more, proof.alias("evidence"))


def format_output(result: object, mode: str = "compact", most: int | None = None) -> object:
    """A result with every table of edges and every table of nodes in it in the shape of a mode, however it nests them; all else stays. Edges are looked for first."""
    again = lambda x: format_output(x, mode, most)
    if isinstance(result, DataFrame):
        have = set(result.columns)
        if {"id", "source", "target", "kind", "confidence", "evidence", "metadata"} <= have:
            return shaped_edges(result, mode, most)
        return shaped_nodes(result, mode) if {"id", "name", "kind", "qualified_name", "metadata"} <= have else result
    if dataclasses.is_dataclass(result) and not isinstance(result, type):
        return {f.name: again(getattr(result, f.name)) for f in dataclasses.fields(result)}
    if isinstance(result, dict):
        return {k: again(v) for k, v in result.items()}
    return type(result)(map(again, result)) if isinstance(result, list | tuple) else result


def as_objects(rows: DataFrame) -> DataFrame:
    """One JSON object per row; null fields stay out and JSON text in metadata becomes an object."""
    if "metadata" in rows.columns:
        rows = rows.withColumn("metadata", F.try_parse_json("metadata"))
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def as_text(value: object, indent: str = "") -> str:
    """A result of plain values as an indented outline."""
    if isinstance(value, list | tuple):
        return "\n".join(f"{indent}{i}. {as_text(v, indent + '   ').lstrip()}" for i, v in enumerate(value, 1)) or f"{indent}(none)"
    if isinstance(value, dict):
        return "\n".join(f"{indent}{k}:\n{as_text(v, indent + '  ')}" if isinstance(v, dict | list | tuple) and v != [] or v == [] else f"{indent}{k}: {v}" for k, v in value.items())
    return str(value)
