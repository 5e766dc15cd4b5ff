"""Stored graphs: numbered versions of Parquet tables, each named by one small file that never changes.

A writer puts its version's folder down whole and then claims the next number by a rename that fails where the number is taken; the highest
number is the current version. So a reader finds a whole version at any time, a writer that dies leaves the last one current, and of two
writers one is told. Versions older than the last KEPT are removed; readers of those kept read on.

Nodes lie by kind and id, edges twice, by source and by target, each in ranges over many files of about TASK_EDGES rows, so that a look-up of one end reads
few files and pages by their statistics.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators.scope import placed_edges
from ..schema import DIAGNOSTIC, EDGE, NODE, PLACED, RUN, SCHEMA_VERSION, Graph, shaped

POINTERS, KEPT = "versions", 3
#: Edges that one task sorts and one file holds (several hundred bytes each in memory), and ids of one condition: readers ask the statistics for so many, of longer lists only for least and greatest.
TASK_EDGES, LISTED = 400_000, 10
#: Ids in order begin alike: each is stored as what differs from the one before.
SORTED_TEXT = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#id": "false", "parquet.enable.dictionary#ord": "false", "compression": "zstd"}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def write_text(spark: SparkSession, path: str, text: str) -> bool:
    """A small file in whatever store the path names, that appears as a whole; False where it is there already."""
    fs, target, jvm = _fs(spark, path)
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    # a rename by the file context, unlike the file system's own, fails where the target is taken
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(fs.makeQualified(fresh), fs.makeQualified(target), none)
    except Py4JJavaError as e:
        fs.delete(fresh, False)
        if "FileAlreadyExistsException" not in str(e.java_exception):
            raise
        return False
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p, _ = _fs(spark, path)
    if not fs.exists(p):
        return None
    rows = spark.read.text(path, wholetext=True).collect()  # a manifest or pointer
    return rows[0][0] if rows else ""


def _versions(spark: SparkSession, index: str) -> list[int]:
    fs, folder, _ = _fs(spark, f"{index.rstrip('/')}/{POINTERS}")
    if not fs.exists(folder):
        return []
    return sorted(int(n) for f in fs.listStatus(folder) if (n := f.getPath().getName()).isdigit())


def discover(spark: SparkSession, index: str) -> str:
    """The folder of an index's current version."""
    index = index.rstrip("/")
    for n in reversed(_versions(spark, index)):
        if name := read_text(spark, f"{index}/{POINTERS}/{n:012d}"):
            return f"{index}/{name.strip()}"
    raise FileNotFoundError(f"no index in {index}: analyze the repository first")


def commit(spark: SparkSession, index: str, version: str, kept: int = KEPT) -> int:
    """Make a version's folder the current one under the next free number, and remove versions older than the last ones kept."""
    index = index.rstrip("/")
    while True:
        known = _versions(spark, index)
        n = known[-1] + 1 if known else 1
        if write_text(spark, f"{index}/{POINTERS}/{n:012d}", version):
            break
    for old in known[: max(0, len(known) + 1 - kept)]:
        name = read_text(spark, f"{index}/{POINTERS}/{old:012d}")
        fs, pointer, jvm = _fs(spark, f"{index}/{POINTERS}/{old:012d}")
        fs.delete(pointer, False)  # the name goes first: nobody comes to a folder that is going
        if name:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{index}/{name.strip()}"), True)
    return n


def write(graph: Graph, index: str, manifest: dict, state: DataFrame | None = None, exports: bool = False, counted: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None = None) -> str:
    """Write a graph as a new version and make it the current one; runs are appended to the history, all else is replaced.

    state(path, sha256) are the fingerprints of the files it was made from; exports adds the tables as JSON lines. counted(nodes, edges, diagnostics)
    makes the runs from the tables as written, where graph.runs would derive them once more."""
    spark, version = graph.spark, f"v-{uuid.uuid4().hex}"
    base = f"{index.rstrip('/')}/{version}"
    # ranges are found by a sample, which reads all rows again: they are written once before that
    nodes = cut(graph.nodes)
    # a kind of many nodes is many ranges, and so is an end that many edges share
    nodes.repartitionByRange("kind", "id").sortWithinPartitions("kind", "id").write.parquet(f"{base}/nodes")
    nodes.where("kind = 'file' and file is not null").select("file", "id", "language", "adapter").write.parquet(f"{base}/files")
    edges = cut(placed_edges(replace(graph, nodes=nodes)), compression="zstd")
    tasks = 1 + edges.count() // TASK_EDGES
    for end in ("source", "target"):
        edges.repartitionByRange(tasks, end, "id").sortWithinPartitions(end, "id").write.options(**SORTED_TEXT).parquet(f"{base}/edges_by_{end}")
    graph.diagnostics.write.parquet(f"{base}/diagnostics")
    if state is not None:
        state.write.parquet(f"{base}/state")
    runs = graph.runs if counted is None else counted(nodes, edges, spark.read.parquet(f"{base}/diagnostics"))
    runs.withColumn("version", F.lit(version)).write.mode("append").parquet(f"{index.rstrip('/')}/runs")
    write_text(spark, f"{base}/manifest.json", json.dumps(manifest | {"schemaVersion": SCHEMA_VERSION}, indent=2))
    if exports:
        _export(graph, base)
    fs, folder, _ = _fs(spark, f"{index.rstrip('/')}/{POINTERS}")
    fs.mkdirs(folder)
    commit(spark, index, version)
    return base


def read(spark: SparkSession, index: str, by: str = "source") -> Graph:
    """The current version's graph; by says which end's layout of the edges is read."""
    base = discover(spark, index)
    version = base.rsplit("/", 1)[1]
    runs = spark.read.parquet(f"{index.rstrip('/')}/runs").where(F.col("version") == version)

    def incident(ids: list[str], ends: tuple[str, ...]) -> DataFrame:
        return _touching(spark, base, ids, ends)

    edges = spark.read.parquet(f"{base}/edges_by_{by}")
    return Graph(shaped(spark.read.parquet(f"{base}/nodes"), NODE), shaped(edges, EDGE), shaped(spark.read.parquet(f"{base}/diagnostics"), DIAGNOSTIC), shaped(runs, RUN), incident, shaped(edges, PLACED))


def manifest_of(spark: SparkSession, index: str) -> dict | None:
    try:
        text = read_text(spark, f"{discover(spark, index)}/manifest.json")
    except FileNotFoundError:
        return None
    return json.loads(text) if text else None


def state_of(spark: SparkSession, index: str) -> DataFrame:
    return spark.read.parquet(f"{discover(spark, index)}/state")


def _touching(spark: SparkSession, base: str, ids: list[str], ends: tuple[str, ...]) -> DataFrame:
    """Each layout answers for its own end with a pushed-down filter, which leaves files and row groups out; an edge comes once."""
    # short lists joined by "or" go to the statistics value by value, each file's pages are left out by them
    listed = lambda end: reduce(Column.__or__, [F.col(end).isin(*ids[i : i + LISTED]) for i in range(0, len(ids), LISTED)], F.lit(False))
    parts = [spark.read.parquet(f"{base}/edges_by_{end}").where(listed(end)) for end in ends]
    if len(parts) == 2:
        parts[1] = parts[1].where(~F.coalesce(F.col(ends[0]).isin(*ids), F.lit(False)))
    return reduce(DataFrame.unionByName, parts)


def edges_touching(spark: SparkSession, index: str, ids: list[str]) -> DataFrame:
    """Edges of a few nodes."""
    return _touching(spark, discover(spark, index), ids, ("source", "target"))


def runs_history(spark: SparkSession, index: str) -> DataFrame:
    return spark.read.parquet(f"{index.rstrip('/')}/runs")


def _export(graph: Graph, base: str) -> None:
    for name in ("nodes", "edges", "diagnostics"):
        getattr(graph, name).write.json(f"{base}/exports/{name}")


def export_json(graph: Graph, index: str) -> None:
    """The current graph as JSON lines, one folder a table; null fields stay out."""
    _export(graph, discover(graph.spark, index))
