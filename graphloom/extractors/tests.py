"""Test artifacts: named tests of test files, and the files they test, by import and by file name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename
from .base import Corpus, Found, edge_rows, file_id, id_of, knowledge_rows, matches, node_rows, placed, union
from .code import resolve_imports

ADAPTER, RANK = "tests", 35
# Which files hold tests, and the syntax of tests and imports.
TEST_FILES = (r"\.(?:test|spec)\.(?:ts|tsx|js|jsx|mts|cts)$", r"(?:^|/)tests?/.*\.(?:ts|tsx|js|jsx|mts|cts)$")
TEST_CALL = r"""\b(?:describe|it|test)\s*\(\s*["'`]([^"'`]+)["'`]"""
RUST_TEST = r"#\s*\[\s*test\s*\][\s\S]*?\bfn\s+([A-Za-z_][A-Za-z0-9_]*)"
IMPORTED = r"""\bfrom\s+["']([^"']+)["']|\brequire\s*\(\s*["']([^"']+)["']\s*\)"""
RUNNERS = (("vitest", r"""\bvitest\b"""), ("jest", r"""\bjest\b"""), ("mocha", r"""\bmocha\b"""), ("playwright", r"""@playwright/test"""))


def test_files(files: DataFrame) -> DataFrame:
    c = F.col
    return files.where(c("path").rlike(TEST_FILES[0]) | c("path").rlike(TEST_FILES[1]) | (c("path").rlike(r"\.rs$") & c("content").rlike(r"#\s*\[\s*test\s*\]")))


def named_tests(files: DataFrame) -> DataFrame:
    """path, nth, name, line, method: the tests of each test file; one that is named after the file where it has none."""
    c = F.col
    held = test_files(files)
    rust = c("path").rlike(r"\.rs$")
    calls = placed(held.where(~rust), "content", TEST_CALL, "name").withColumn("method", F.lit("test_call"))
    marks = placed(held.where(rust), "content", RUST_TEST, "name").withColumn("method", F.lit("rust_test_attribute"))
    rows = calls.unionByName(marks).select("path", "nth", "name", "line", "method")
    none = held.select("path").join(rows.select("path").distinct(), "path", "left_anti").select("path", F.lit(0).alias("nth"), basename(c("path")).alias("name"), F.lit(1).alias("line"), F.lit("test_file").alias("method"))
    return rows.unionByName(none)


def tested_files(files: DataFrame) -> DataFrame:
    """path, target, method: files that a test file imports, and the one that its own name points to unless it is imported already."""
    c = F.col
    held = test_files(files)
    either = matches(held, "content", IMPORTED, "a", "b").select("path", F.when(c("a") != "", c("a")).otherwise(c("b")).alias("specifier")).where(c("specifier").startswith(".")).distinct()
    by_import = resolve_imports(either, files).where("target is not null").select("path", "target").distinct().withColumn("method", F.lit("test_import_match"))
    stripped = F.regexp_replace("path", r"\.(?:test|spec)(?=\.[^.]+$)", "")
    paths = files.select(c("path").alias("target"))
    named = held.select("path", F.explode(F.array_distinct(F.array(stripped, F.concat(F.lit("src/"), basename(stripped))))).alias("target"), stripped.alias("first"))
    hit = named.where("target <> path").join(paths, "target").groupBy("path").agg(F.min_by("target", c("target") != c("first")).alias("target"))
    by_name = hit.join(by_import.select("path", "target"), ["path", "target"], "left_anti").withColumn("method", F.lit("test_file_name_match"))
    return by_import.unionByName(by_name)


class Tests:
    name, version = ADAPTER, "1"

    def detect(self, corpus: Corpus) -> bool:
        return not test_files(corpus.files).select("path").limit(1).isEmpty()

    def extract(self, corpus: Corpus, graph: Found) -> Found:
        c = F.col
        found = named_tests(corpus.files)
        runner = F.lit("unknown")
        for name, pattern in reversed(RUNNERS):
            runner = F.when(c("content").rlike(pattern), name).otherwise(runner)
        runner = F.when(c("path").rlike(r"\.rs$"), "rust").otherwise(runner)
        stable = F.concat(F.lit("test:"), "path", F.lit(":"), "method", F.lit(":"), "name", F.lit(":"), c("nth").cast("string"))
        place = F.concat_ws(":", c("line").cast("string"), c("nth").cast("string"))
        own = id_of(corpus, "test_artifact", stable, c("path"), None, place)
        held = test_files(corpus.files)
        nodes = union(
            node_rows(held.select("path").join(graph.nodes.where("kind = 'file'").select(c("file").alias("path")), "path", "left_anti"), corpus, ADAPTER, RANK, "file", basename(c("path")), c("path"), language=F.when(c("path").rlike(r"\.rs$"), "rust").otherwise("typescript"), file=c("path"), graph_domain="knowledge", source_category="tests"),
            knowledge_rows(found.join(held.select("path", runner.alias("runner")), "path"), corpus, ADAPTER, RANK, "test_artifact", c("name"), stable, "tests", file=c("path"), start_line=c("line"), start_column=1, literal=c("name"), method=c("method"), framework=c("runner"), discriminator=place),
        )
        links = found.select("path", "name", "line", "nth", c("method").alias("how"), own.alias("test_id")).join(tested_files(corpus.files), "path")
        edges = union(
            edge_rows(found, ADAPTER, RANK, "contains", file_id(corpus, c("path")), own, "exact", c("path"), c("line"), 1, c("method"), c("name"), "literal-test-syntax", domain="knowledge"),
            edge_rows(links, ADAPTER, RANK, "tests", c("test_id"), file_id(corpus, c("target")), "resolved", c("path"), c("line"), 1, F.when(c("method") == "test_import_match", "test import").otherwise("test filename"), c("target"), c("method"), domain="knowledge"),
        )
        return Found(nodes, edges)
