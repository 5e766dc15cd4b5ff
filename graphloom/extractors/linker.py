"""Links between what different extractors found: documents, commands, routes, settings, tests and code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators.contains import containment_join
from .base import TYPESCRIPT_FILES, Corpus, Found, edge_rows, matches, union
from .markdown import bodies

ADAPTER, RANK = "semanticLinker", 36
CODE_KINDS = ("function", "method", "class", "interface", "type_alias", "react_component", "struct", "enum", "trait")


def unique_names(nodes: DataFrame) -> DataFrame:
    """(name, id) of code symbols whose name no other has."""
    return nodes.where(F.col("kind").isin(*CODE_KINDS)).groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("name", "id")


def line_in(body: str, place: Column, first: str) -> Column:
    """The line of a place (from 1) in a text that begins at line `first`."""
    return F.col(first) + F.size(F.split(F.substring(F.col(body), F.lit(1), F.greatest(place - 1, F.lit(0))), "\n", -1)) - 1


class Linker:
    name, version = ADAPTER, "1"

    def detect(self, corpus: Corpus) -> bool:
        return not corpus.files.select("path").limit(1).isEmpty()

    def extract(self, corpus: Corpus, graph: Found) -> Found:
        c = F.col
        n = graph.nodes
        fact = lambda k: F.get_json_object("metadata", f"$.{k}")
        known = {"domain": "knowledge"}
        files = n.where("kind = 'file' and file is not null").select(c("id").alias("file_id"), "file")
        heads = n.where("kind = 'doc_section' and file is not null").select(c("id").alias("section_id"), c("file").alias("path"), c("start_line").alias("line"))
        sections = bodies(corpus.files).join(heads, ["path", "line"])
        # paths in sections, the first place counts
        found = containment_join(sections.select("path", "line", "section_id", "body"), files, "body", "file", place="place").where("file <> path")
        parts = [edge_rows(found, ADAPTER, RANK, "mentions", c("section_id"), c("file_id"), "exact", c("path"), line_in("body", c("place"), "line"), 1, "file path mention", c("file"), "exact_path_mention", **known)]
        # symbols in code spans
        names = unique_names(n)
        spans = matches(sections, "body", "`([A-Za-z_][A-Za-z0-9_]*)`", "name", at="place").where(F.length("name") >= 3).join(names, "name")
        parts.append(edge_rows(spans, ADAPTER, RANK, "mentions", c("section_id"), c("id"), "resolved", c("path"), line_in("body", c("place"), "line"), c("nth") + 1, "code span symbol mention", c("name"), "unique_symbol_mention", **known))
        # command lines under headings: an interval join within a file
        commands = n.where("kind = 'cli_command'").select("id", c("file").alias("path"), c("start_line").alias("at"), "name")
        under = sections.select("path", "line", "end", "section_id").join(commands, "path").where("at >= line and at < end")
        parts.append(edge_rows(under, ADAPTER, RANK, "describes_workflow", c("section_id"), c("id"), "exact", c("path"), c("at"), 1, "markdown command", c("name"), "literal-command-under-heading", **known))
        # npm scripts: the first manifest that has the script
        wanted = n.where("kind = 'cli_command'").select("id", "file", "start_line", F.coalesce(fact("literalValue"), c("name")).alias("said"))
        script = F.when(c("said") == "npm test", "test").otherwise(F.regexp_extract("said", r"^npm\s+run\s+([A-Za-z0-9_.:-]+)$", 1))
        scripts = n.where("kind = 'configuration' and adapter = 'packageJson'").select(F.regexp_extract(fact("stableKey"), r":script:(.+)$", 1).alias("script"), c("id").alias("config_id"), "ord").where("script <> ''").groupBy("script").agg(F.min_by("config_id", "ord").alias("config_id"))
        run = wanted.withColumn("script", script).where("script <> ''").join(scripts, "script")
        parts.append(edge_rows(run, ADAPTER, RANK, "related_to", c("id"), c("config_id"), "exact", c("file"), c("start_line"), 1, "npm script command", c("said"), "npm_script_match", **known))
        # routes in code
        routes = n.where("kind = 'api_surface'").select(c("id").alias("api_id"), F.regexp_replace("name", r"^(?:GET|POST|PUT|PATCH|DELETE|ANY)\s+", "").alias("route"))
        sources = corpus.files.where(c("path").rlike(TYPESCRIPT_FILES)).join(files.withColumnRenamed("file", "path"), "path").withColumn("first", F.lit(1))
        served = containment_join(sources, routes, "content", "route", place="place")
        parts.append(edge_rows(served, ADAPTER, RANK, "mentions", c("api_id"), c("file_id"), "resolved", c("path"), line_in("content", c("place"), "first"), 1, "api route literal", c("route"), "api_route_literal_match", **known))
        # settings that name a file or a command
        settings = n.where("kind in ('configuration', 'security_boundary')").select("id", "file", "start_line", fact("literalValue").alias("said")).where("said is not null")
        paths = settings.withColumn("path", normalize(c("said"))).join(files.select(c("file").alias("path"), "file_id"), "path")
        parts.append(edge_rows(paths, ADAPTER, RANK, "configures", c("id"), c("file_id"), "exact", c("file"), c("start_line"), 1, "config path", c("said"), "config_path_match", **known))
        allowed = containment_join(settings, n.where("kind = 'framework_command'").select(c("id").alias("command_id"), c("name").alias("command")), "said", "command")
        boundaries = graph.edges.select(c("source").alias("boundary_id"), c("target").alias("id")).join(n.where("kind = 'security_boundary'").select(c("id").alias("boundary_id")), "boundary_id").distinct()
        both = allowed.select("file", "start_line", "said", "command_id", c("id").alias("from")).unionByName(allowed.join(boundaries, "id").select("file", "start_line", "said", "command_id", c("boundary_id").alias("from"))).distinct()
        parts.append(edge_rows(both, ADAPTER, RANK, "configures", c("from"), c("command_id"), "resolved", c("file"), c("start_line"), 1, "tauri permission", c("said"), "tauri_permission_match", **known))
        # symbols in test names: one candidate over all words of the name
        words = matches(n.where("kind = 'test_artifact'").select("id", "file", "start_line", "name"), "name", "([A-Za-z_][A-Za-z0-9_]{2,})", "word").select("id", "file", "start_line", "name", "word").distinct()
        symbols = n.where(c("kind").isin(*CODE_KINDS)).select(c("name").alias("word"), c("id").alias("symbol_id"))
        one = words.join(symbols, "word").groupBy("id", "file", "start_line", "name").agg(F.count("*").alias("n"), F.min("symbol_id").alias("symbol_id")).where("n = 1")
        parts.append(edge_rows(one, ADAPTER, RANK, "tests", c("id"), c("symbol_id"), "probable", c("file"), c("start_line"), 1, "test name", c("name"), "unique_symbol_mention", **known))
        return Found(edges=union(*parts))
