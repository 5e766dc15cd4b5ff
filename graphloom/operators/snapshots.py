"""Freshness: fingerprints of a corpus, the changes between two of them, and what an index must do about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixpoint import SENT
from ..functions.identity import content_hash
from ..functions.lineage import cut, merging

#: Added and modified files up to which a sync may be incremental; deleted files do not count.
INCREMENTAL_LIMIT = 10
#: Edges of these kinds in a changed file make a sync a full one.
# Kinds that block, reasons of a full sync, files that are source, and marks of framework bindings.
BLOCKED_KINDS = ("imports", "invokes", "registers", "emits", "listens", "renders", "passes_callback")
REASONS = ("graph schema changed", "adapter version changed", "configuration changed", "changed files have dependency, framework, or unresolved relationships requiring a full adapter rebuild")
SOURCE_FILES = r"\.(?:ts|tsx|js|jsx|mts|cts|rs)$"
FRAMEWORK_MARKS = r"(?:@tauri-apps/api|tauri::|#\s*\[\s*tauri::command|generate_handler!|invoke\s*\(|listen\s*\(|emit\s*\()"


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, sha256) of files(path, content)."""
    return files.select("path", content_hash(F.col("content")).alias("sha256"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added, modified or deleted; one full join on path."""
    joined = before.select("path", F.col("sha256").alias("old")).join(after.select("path", F.col("sha256").alias("new")), "path", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return joined.select("path", change.alias("change")).where("change is not null")


def state(changed: Column, has_index: Column, schema_changed: Column, adapters_changed: Column, config_changed: Column) -> Column:
    """missing, stale or fresh."""
    return F.when(~has_index, "missing").when(changed | schema_changed | adapters_changed | config_changed, "stale").otherwise("fresh")


def fallback_reason(schema_changed: Column, adapters_changed: Column, config_changed: Column) -> Column:
    """Why a sync is a full one; the first that holds."""
    return F.when(schema_changed, REASONS[0]).when(adapters_changed, REASONS[1]).when(config_changed, REASONS[2]).otherwise(REASONS[3])


def crossing_edges(edges: DataFrame, nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges with exactly one end in a changed file."""
    inside = cut(nodes.join(changed.select(F.col("path").alias("file")).distinct(), "file").select("id"))
    # few nodes go to the edges; by the size of all nodes' tables Spark would move every edge twice
    inside = F.broadcast(inside) if inside.count() <= SENT else merging(inside)
    flag = lambda end: inside.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}"))
    flagged = edges.join(flag("source"), "source", "left").join(flag("target"), "target", "left")
    return flagged.where(F.coalesce("_source", F.lit(False)) != F.coalesce("_target", F.lit(False))).select(*edges.columns)


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows added and removed, by id."""
    joined = before.select("id", F.lit(1).alias("b")).join(after.select("id", F.lit(1).alias("a")), "id", "full")
    return joined.agg(F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a").isNull()).alias("removed"))


def framework_relevant(path: Column, content: Column) -> Column:
    """Whether a file may take part in framework bindings, so that a change of it reaches beyond the file."""
    return path.rlike(r"\.(?:tsx|jsx)$") | content.rlike(FRAMEWORK_MARKS)


def incremental(nodes: DataFrame, edges: DataFrame, changed: DataFrame, files: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> DataFrame:
    """One row: whether changes(path, change) may be spliced into a graph, and how often each of the eight guards is broken.

    files(path, content) is the corpus as it is now; new_nodes and new_edges are what the extractors found in the changed files."""
    c = F.col
    zero = lambda df, name: df.agg(F.count("*").alias(name))
    fresh = changed.where("change <> 'deleted'").select("path", "change")
    gone = nodes.join(changed.select(c("path").alias("file")).distinct(), "file", "left_semi").select("id")
    now = fresh.join(files, "path")
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    folders = nodes.where("kind = 'directory'").select(c("qualified_name").alias("folder")).distinct()
    known = nodes.select("id").join(gone, "id", "left_anti").unionByName(new_nodes.select("id")).distinct()
    ends = new_edges.select(F.explode(F.array("source", "target")).alias("id"))
    counts = [
        fresh.agg(F.count("*").alias("changed")),
        zero(changed, "all_changes"),
        zero(now.where(framework_relevant(c("path"), c("content"))), "framework"),
        zero(crossing_edges(edges, nodes, changed), "crossing"),
        zero(fresh.where("change = 'added' and path like '%/%'").withColumn("folder", folder).join(folders, "folder", "left_anti"), "new_folders"),
        zero(fresh.where(~c("path").rlike(SOURCE_FILES)), "not_source"),
        zero(new_nodes.where("kind = 'unresolved_symbol' or kind like 'framework!_%' escape '!'"), "open_nodes"),
        zero(new_edges.where(c("confidence").isin("probable", "unresolved") | c("kind").isin(*BLOCKED_KINDS)), "open_edges"),
        zero(ends.join(known, "id", "left_anti"), "unknown_ends"),
    ]
    one = counts[0]
    for other in counts[1:]:
        one = one.join(other)  # one row each
    broken = F.lit(False)
    for name in ("framework", "crossing", "new_folders", "not_source", "open_nodes", "open_edges", "unknown_ends"):
        broken = broken | (c(name) > 0)
    return one.withColumn("incremental", (c("all_changes") > 0) & (c("changed") <= INCREMENTAL_LIMIT) & ~broken)


def spliced(before: DataFrame, after: DataFrame, affected: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Rows kept from before, and those of after. affected(file): rows of these files leave; with ends (ids that left), edges that touch them leave instead."""
    if ends is None:
        kept = before.join(affected, "file", "left_anti")
    else:
        gone = ends.select("id")
        kept = before.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return kept.select(*before.columns).unionByName(after.select(*before.columns))
