"""What all extractors share: ids, node and edge rows, lines, places in a text, and the protocol they follow."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identity import edge_id, node_id
from ..schema import DIAGNOSTIC, EDGE, NODE, empty, evidence, shaped, sortable

# File name patterns of the languages.
TYPESCRIPT_FILES = r"\.(?:ts|tsx|js|jsx|mts|cts)$"
RUST_FILES = r"\.rs$"
MARKDOWN_FILES = r"(?i)\.mdx?$"


@dataclass(frozen=True)
class Corpus:
    """A snapshot of text files, files(path, content), and the identity that ids are made from."""

    files: DataFrame
    repository: str = "repository"
    name: str = "repository"

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession


@dataclass(frozen=True)
class Found:
    """What an extractor found; parts that it does not have are None."""

    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    diagnostics: DataFrame | None = None

    def complete(self, spark: SparkSession) -> Found:
        return Found(*[df if df is not None else empty(spark, schema) for df, schema in ((self.nodes, NODE), (self.edges, EDGE), (self.diagnostics, DIAGNOSTIC))])


class Extractor(Protocol):
    """One table function of the engine. detect() is a cheap test of the corpus; extract() sees the graph found so far."""

    name: str
    version: str

    def detect(self, corpus: Corpus) -> bool: ...

    def extract(self, corpus: Corpus, graph: Found) -> Found: ...


def lit(value: Column | str | int | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def file_language(path: Column) -> Column:
    return F.when(path.rlike(TYPESCRIPT_FILES), "typescript").when(path.rlike(RUST_FILES), "rust")


def id_of(corpus: Corpus, kind: Column | str, qualified_name: Column, file: Column | str | None = None, language: Column | str | None = None, discriminator: Column | str = "") -> Column:
    return node_id(F.lit(corpus.repository), lit(language).cast("string"), lit(file).cast("string"), lit(kind), qualified_name, lit(discriminator))


def file_id(corpus: Corpus, path: Column) -> Column:
    """The id of a file's node: the same for whichever extractor meets the file first."""
    return id_of(corpus, "file", path, path, file_language(path))


def node_rows(df: DataFrame, corpus: Corpus, adapter: str, rank: int, kind: Column | str, name: Column, qualified_name: Column, **more: Column | str | int | None) -> DataFrame:
    """Node rows made of df's columns; ord follows the extractor, the file and the place in it."""
    more = {k: lit(v) for k, v in more.items()}
    discriminator = more.pop("discriminator", F.lit(""))
    file = more.get("file", F.lit(None)).cast("string")
    place = F.concat_ws(":", F.coalesce(file, F.lit("")), sortable(F.coalesce(more.get("start_line", F.lit(0)), F.lit(0)), 9), sortable(F.coalesce(more.get("start_column", F.lit(0)), F.lit(0)), 6))
    columns = {"id": id_of(corpus, kind, qualified_name, file, more.get("language", F.lit(None)), discriminator), "ord": F.concat(F.lit(f"{rank:02d}:"), place, F.lit(":"), qualified_name), "kind": lit(kind), "name": name, "qualified_name": qualified_name, "adapter": F.lit(adapter), "graph_domain": F.lit("code")} | more
    return shaped(df.select(*[v.alias(k) for k, v in columns.items()]), NODE)


def knowledge_rows(df: DataFrame, corpus: Corpus, adapter: str, rank: int, kind: Column | str, name: Column, key: Column, category: str, **more: Column | str | int | None) -> DataFrame:
    """Nodes of documents, settings, commands, routes and tests. metadata holds what further extractors read."""
    facts = {k: lit(more.pop(k)) for k in ("literal", "depth", "method") if k in more}
    metadata = F.to_json(F.struct(key.alias("stableKey"), *[v.alias({"literal": "literalValue", "depth": "headingDepth", "method": "extractionMethod"}[k]) for k, v in facts.items()]))
    return node_rows(df, corpus, adapter, rank, kind, name, key, graph_domain="knowledge", source_category=category, metadata=metadata, **more)


def edge_rows(df: DataFrame, adapter: str, rank: int, kind: Column | str, source: Column, target: Column, confidence: Column | str, file: Column, line: Column | int, column: Column | int = 1, syntax: Column | str | None = None, binding: Column | str | None = None, method: Column | str | None = None, domain: str = "code", metadata: Column | None = None) -> DataFrame:
    proof = F.array(evidence(file=file, line=lit(line), column=lit(column), adapter=adapter, matched_syntax=syntax, binding_name=binding, resolution_method=method))
    rows = df.select(source.alias("source"), target.alias("target"), lit(kind).alias("kind"), lit(confidence).alias("confidence"), proof.alias("evidence"), F.lit(domain).alias("graph_domain"), (metadata if metadata is not None else F.lit(None).cast("string")).alias("metadata"))
    first = F.col("evidence")[0]
    order = F.concat_ws(":", F.lit(f"{rank:02d}"), first["file"], sortable(first["line"], 9), sortable(F.coalesce(first["column"], F.lit(0)), 6), "kind", "source", "target")
    return shaped(rows.withColumn("id", edge_id(F.col("source"), F.col("target"), F.col("kind"), F.col("evidence"), F.lit(""))).withColumn("ord", order), EDGE)


def diagnostic_rows(df: DataFrame, adapter: str, code: Column | str, severity: str, message: Column, file: Column | None = None, line: Column | None = None) -> DataFrame:
    rows = df.select(lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"), (file if file is not None else F.lit(None).cast("string")).alias("file"), (line if line is not None else F.lit(None)).cast("int").alias("line"), F.lit(adapter).alias("adapter"))
    return shaped(rows.withColumn("ord", F.concat_ws(":", F.lit(adapter), F.coalesce("file", F.lit("")), sortable(F.coalesce("line", F.lit(0)), 9), "code", "message")), DIAGNOSTIC)


def union(*parts: DataFrame | None) -> DataFrame | None:
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else out.unionByName(p)
    return out


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line, text) of every line, from 1; carriage returns stay off."""
    return files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("i", "text")).select("path", (F.col("i") + 1).alias("line"), F.regexp_replace("text", "\r$", "").alias("text"))


def with_offsets(lines: DataFrame) -> DataFrame:
    """lines with the characters ahead of each in its file."""
    ahead = W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(F.length("text") + 1).over(ahead), F.lit(0)))


def place_of(content: Column, needle: Column) -> tuple[Column, Column]:
    """Line and column, from 1, of the first place of needle in content; the start where it is not there. It is for manifests, where the first place is what counts."""
    at = F.instr(content, needle)
    ahead = F.when(at > 0, F.substring(content, F.lit(1), at - 1)).otherwise("")
    return F.size(F.split(ahead, "\n", -1)), F.length(F.substring_index(ahead, "\n", -1)) + 1


#: Marks the start of each match while places are counted; it stands for a blank where a text holds it.
MARK = "\u0001"


def matches(df: DataFrame, text: str, pattern: str, *groups: str, whole: bool = False, at: str | None = None) -> DataFrame:
    """A row for each match of pattern in the text column, with nth (from 0) and each named group (1, 2, ...) as a column; with whole the first name is the match's.

    With at, a column of that name has each match's own place in the text, from 1. It is for lines; see placed() for whole files."""
    found = [F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(i + (not whole))).alias(g) for i, g in enumerate(groups)]
    rows = df.select("*", F.posexplode(F.arrays_zip(*found)).alias("nth", "_m"))
    extra = []
    if at is not None:
        ahead = F.slice(F.split(_marked(text, pattern), MARK, -1), F.lit(1), F.col("nth") + 1)
        extra = [(F.aggregate(ahead, F.lit(0), lambda n, x: n + F.length(x)) + 1).alias(at)]
    return rows.select(*df.columns, "nth", *[F.col("_m")[g].alias(g) for g in groups], *extra)


def _marked(text: str, pattern: str) -> Column:
    return F.regexp_replace(F.translate(F.col(text), MARK, " "), pattern, MARK + "$0")


def placed(df: DataFrame, text: str, pattern: str, *groups: str, whole: bool = False) -> DataFrame:
    """matches() over whole files, df(path, ...): path, nth, the groups, and each match's own offset (from 0), line and column (from 1).

    Only the text between two matches goes with a row; running sums over a file's matches give the places."""
    found = [F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(i + (not whole))) for i in range(len(groups))]
    ahead = F.slice(F.split(_marked(text, pattern), MARK, -1), F.lit(1), F.size(found[0]))
    rows = df.select("path", F.posexplode(F.arrays_zip(ahead.alias("ahead"), *[f.alias(g) for f, g in zip(found, groups, strict=True)])).alias("nth", "_m"))
    rows = rows.select("path", "nth", *[F.col("_m")[g].alias(g) for g in groups], F.length(F.col("_m")["ahead"]).alias("_n"), (F.size(F.split(F.col("_m")["ahead"], "\n", -1)) - 1).alias("_lines"), F.length(F.substring_index(F.col("_m")["ahead"], "\n", -1)).alias("_tail"))
    so_far = W.partitionBy("path").orderBy("nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("offset", F.sum("_n").over(so_far).cast("int"))
    start = F.coalesce(F.max(F.when(F.col("_lines") > 0, F.col("offset") - F.col("_tail"))).over(so_far), F.lit(0))
    return rows.select("path", "nth", *groups, "offset", (F.sum("_lines").over(so_far) + 1).cast("int").alias("line"), (F.col("offset") - start + 1).cast("int").alias("column"))
