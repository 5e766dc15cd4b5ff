"""Headings, command lines and routes of Markdown files, by running sums and carried values over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import slug, squeeze
from .base import MARKDOWN_FILES, Corpus, Found, edge_rows, file_id, id_of, knowledge_rows, lines_of, matches, node_rows, union

ADAPTER, RANK = "markdown", 30
# Patterns of headings, command lines and routes.
HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
FENCE = r"^\s*```"
COMMAND = r"^(?:[$>]\s+)?((?:npm|npx|cargo|git|pnpm|yarn)\s+.+)$"
ROUTE = r"\b(?:(GET|POST|PUT|PATCH|DELETE)\s+)?(/api/[A-Za-z0-9_./:{}*-]+)"


def sectioned(files: DataFrame) -> DataFrame:
    """Lines of Markdown files outside fence marks: path, line, text, fenced, depth and title of a heading, its slug, and the current section's slug and depth.

    Headings count inside fences too, as the data model has it; the nth heading of a slug in a file gets -n."""
    by_line = W.partitionBy("path").orderBy("line")
    so_far = by_line.rowsBetween(W.unboundedPreceding, W.currentRow)
    mark = F.col("text").rlike(FENCE)
    lines = lines_of(files.where(F.col("path").rlike(MARKDOWN_FILES))).withColumn("fenced", F.sum(mark.cast("int")).over(so_far) % 2 == 1).where(~mark)
    depth = F.length(F.regexp_extract("text", HEADING, 1))
    lines = lines.withColumn("depth", F.when(depth > 0, depth)).withColumn("title", F.when(F.col("depth").isNotNull(), F.trim(F.regexp_extract("text", HEADING, 2))))
    base = lines.withColumn("base", F.when(F.col("title").isNotNull(), slug(F.col("title"))))
    nth = F.row_number().over(W.partitionBy("path", "base").orderBy("line"))
    named = base.withColumn("slug", F.when(F.col("base").isNull(), None).when(nth == 1, F.col("base")).otherwise(F.concat_ws("-", "base", nth.cast("string"))))
    return named.withColumn("section", F.last("slug", ignorenulls=True).over(so_far)).drop("base")


def sections(files: DataFrame) -> DataFrame:
    """path, line, depth, title, slug, and end: the line of the next heading that is not deeper (none: after the last line)."""
    all_lines = lines_of(files.where(F.col("path").rlike(MARKDOWN_FILES))).groupBy("path").agg(F.max("line").alias("last"))
    heads = sectioned(files).where("slug is not null").select("path", "line", "depth", "title", "slug")
    following = heads.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "depth"))).alias("heads"))  # headings of one file
    later = F.filter("heads", lambda h: (h["line"] > F.col("line")) & (h["depth"] <= F.col("depth")))
    return heads.join(following, "path").join(all_lines, "path").select("path", "line", "depth", "title", "slug", F.coalesce(F.try_element_at(later, F.lit(1))["line"], F.col("last") + 1).alias("end"))


def bodies(files: DataFrame) -> DataFrame:
    """sections with the text from the heading to the end, nested sections included."""
    return sections(files).join(files.select("path", F.split("content", "\n", -1).alias("_lines")), "path").select("path", "line", "end", "depth", "title", "slug", F.array_join(F.slice("_lines", F.col("line"), F.col("end") - F.col("line")), "\n").alias("body"))


def commands(lines: DataFrame) -> DataFrame:
    """Command lines: outside fences they do not end like a sentence."""
    command = F.regexp_extract(F.trim("text"), COMMAND, 1)
    found = lines.withColumn("command", command).where((command != "") & (F.col("fenced") | ~command.rlike(r"[.!?]$")))
    return found.select("path", "line", "section", "fenced", F.instr("text", F.col("command")).alias("column"), squeeze(F.col("command")).alias("command"))


def routes(lines: DataFrame) -> DataFrame:
    found = matches(lines.select("path", "line", "section", "text"), "text", ROUTE, "method", "route")
    method = F.when(F.col("method") == "", "ANY").otherwise(F.col("method"))
    return found.select("path", "line", "section", "nth", F.concat_ws(" ", method, "route").alias("route"), F.instr("text", F.col("route")).alias("column"))


class Markdown:
    name, version = ADAPTER, "1"

    def detect(self, corpus: Corpus) -> bool:
        return not corpus.files.where(F.col("path").rlike(MARKDOWN_FILES)).select("path").limit(1).isEmpty()

    def extract(self, corpus: Corpus, graph: Found) -> Found:
        c = F.col
        lines = sectioned(corpus.files)
        heads, said, paths = lines.where("slug is not null"), commands(lines), routes(lines)
        file_nodes = node_rows(lines.select("path").distinct(), corpus, ADAPTER, RANK, "file", F.element_at(F.split("path", "/"), -1), c("path"), file=c("path"), graph_domain="knowledge", source_category="docs")
        key = F.concat(F.lit("docs:"), "path", F.lit("#"), "slug")
        head_nodes = knowledge_rows(heads, corpus, ADAPTER, RANK, "doc_section", c("title"), key, "docs", file=c("path"), start_line=c("line"), start_column=1, depth=c("depth"), method="markdown_heading")
        say_nodes = knowledge_rows(said, corpus, ADAPTER, RANK, "cli_command", c("command"), F.concat(F.lit("cli:"), "command"), "docs", file=c("path"), start_line=c("line"), start_column=c("column"), literal=c("command"), method=F.when(c("fenced"), "fenced_command").otherwise("literal_command_line"))
        api_nodes = knowledge_rows(paths, corpus, ADAPTER, RANK, "api_surface", c("route"), F.concat(F.lit("api:"), "route"), "docs", file=c("path"), start_line=c("line"), start_column=c("column"), literal=c("route"), method="api_route_mention")
        section = F.when(c("section").isNull(), file_id(corpus, c("path"))).otherwise(id_of(corpus, "doc_section", F.concat(F.lit("docs:"), "path", F.lit("#"), "section"), c("path")))
        section_id = id_of(corpus, "doc_section", key, c("path"))
        say_id = id_of(corpus, "cli_command", F.concat(F.lit("cli:"), "command"), c("path"))
        api_id = id_of(corpus, "api_surface", F.concat(F.lit("api:"), "route"), c("path"))
        known = {"domain": "knowledge"}
        edges = union(
            edge_rows(heads, ADAPTER, RANK, "contains", file_id(corpus, c("path")), section_id, "exact", c("path"), c("line"), 1, "markdown heading", c("title"), "literal-heading", **known),
            edge_rows(said, ADAPTER, RANK, "contains", section, say_id, "exact", c("path"), c("line"), c("column"), F.when(c("fenced"), "fenced command").otherwise("command line"), c("command"), "literal-command", **known),
            edge_rows(said, ADAPTER, RANK, "describes_workflow", section, say_id, "exact", c("path"), c("line"), c("column"), "command workflow", c("command"), "literal-command", **known),
            edge_rows(paths, ADAPTER, RANK, "exposes_api", section, api_id, "exact", c("path"), c("line"), c("column"), "api route mention", c("route"), "literal-api-route", **known),
        )
        return Found(union(file_nodes, head_nodes, say_nodes, api_nodes), edges)
