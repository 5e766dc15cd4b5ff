"""From a repository to a stored graph: analyze, status and sync."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..extractors.base import Corpus, Extractor, Found, diagnostic_rows, union
from ..extractors.files import Files
from ..extractors.frameworks import Bridge, Components
from ..extractors.linker import Linker
from ..extractors.manifests import AppSettings, Capabilities, CargoManifests, PackageManifests
from ..extractors.markdown import Markdown
from ..extractors.rust import Rust
from ..extractors.tests import Tests
from ..extractors.typescript import TypeScript
from ..functions.lineage import cut
from ..operators import snapshots
from ..schema import DIAGNOSTIC, EDGE, NODE, RUN, SCHEMA_VERSION, Graph, empty, shaped
from ..sources import corpus as scans
from ..sources import store

TOOL_VERSION = "0.2.0"
#: In order: each later one sees the graph so far.
EXTRACTORS: tuple[Extractor, ...] = (Files(), TypeScript(), Rust(), Components(), Bridge(), Markdown(), PackageManifests(), CargoManifests(), AppSettings(), Capabilities(), Tests(), Linker())
VERSIONS = {e.name: e.version for e in EXTRACTORS}


def merged(rows: DataFrame) -> DataFrame:
    """One row per id: the last one's values (by ord, which follows the extractors) in the first one's place."""
    last = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("id", "ord")]), "ord").alias("r"), F.min("ord").alias("ord"))
    return last.select("id", "ord", "r.*").select(*rows.columns)


def duplicates(rows: DataFrame, what: str) -> DataFrame:
    """An error for the second and each further row of an id, before they are merged."""
    again = rows.withColumn("nth", F.row_number().over(W.partitionBy("id").orderBy("ord"))).where("nth > 1")
    return diagnostic_rows(again, "core", f"duplicate-{what}-id", "error", F.concat(F.lit(f"Duplicate {what} id: "), "id"))


def run(extractors: Sequence[Extractor], corpus: Corpus, enabled: dict[str, bool] | None = None, base: DataFrame | None = None) -> Graph:
    """Apply the extractors in turn. One that fails leaves a diagnostic and the others go on.

    Each one's rows are written to the shared folder, so that later ones read and do not repeat them. They are counted, and ids that one
    extractor gives twice are told, before anything is merged."""
    spark = corpus.spark
    scanned = corpus.files.count()
    nodes, edges, told = empty(spark, NODE), empty(spark, EDGE), empty(spark, DIAGNOSTIC) if base is None else base
    runs = []
    for e in extractors:
        if enabled is not None and not enabled.get(e.name, True):
            continue
        began = time.time()
        detected, row = False, dict.fromkeys(("file_count", "node_count", "edge_count", "diagnostic_count"), 0)
        try:
            detected = e.detect(corpus)
            if detected:
                found = e.extract(corpus, Found(nodes, edges, told)).complete(spark)
                own = [cut(found.nodes), cut(found.edges), cut(found.diagnostics)]
                row = dict(zip(row, (scanned, *(df.count() for df in own)), strict=True))
                told = cut(union(told, own[2], duplicates(own[0], "node"), duplicates(own[1], "edge")))
                nodes, edges = cut(merged(nodes.unionByName(own[0]))), cut(merged(edges.unionByName(own[1])))
        except Exception as error:  # noqa: BLE001  one extractor's failure is not the others'
            told = told.unionByName(diagnostic_rows(spark.range(1), e.name, "adapter-failure", "error", F.lit(f"{e.name} failed: {str(error)[:500]}")))
            row["diagnostic_count"] = 1
        runs.append((e.name, detected, int(1000 * (time.time() - began)), row["file_count"], row["node_count"], row["edge_count"], row["diagnostic_count"]))
    return Graph(nodes, edges, told, shaped(spark.createDataFrame(runs, RUN), RUN))


def manifest_for(graph: Graph, scan: scans.Scan, root: str, took: float, enabled: list[str] | None = None) -> dict:
    """What an index says of itself. enabled: the extractors that ran, where the graph's own runs do not tell (after a splice)."""
    return {
        "schemaVersion": SCHEMA_VERSION, "toolVersion": TOOL_VERSION, "repositoryRoot": root, "repositoryIdentity": scan.corpus.repository, "gitCommit": scans.commit_of(root), "generatedAt": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()),
        "configHash": scan.config.digest(), "adapterVersions": VERSIONS, "scannedFileCount": scan.corpus.files.count(), "excludedFileCount": scan.excluded, "nodeCount": graph.nodes.count(), "edgeCount": graph.edges.count(), "diagnosticCount": graph.diagnostics.count(),
        "enabledAdapters": [r["adapter"] for r in graph.runs.where("detected").collect()] if enabled is None else enabled, "analysisDuration": round(1000 * took),
    }


def _index(root: str, index: str | None) -> str:
    return index or f"{root}/{scans.INDEX_FOLDER}"


def analyze(spark: SparkSession, path: str, index: str | None = None) -> tuple[Graph, dict]:
    """Scan, extract, check and store; returns the stored graph and its manifest."""
    root, began = scans.resolve_root(path), time.time()
    scan = scans.scan(spark, root)
    scan = scans.Scan(Corpus(cut(scan.corpus.files), scan.corpus.repository, scan.corpus.name), scan.diagnostics, scan.config, scan.excluded)
    graph = run(EXTRACTORS, scan.corpus, scan.config.adapters, scan.diagnostics)
    manifest = manifest_for(graph, scan, root, time.time() - began)
    store.write(graph, _index(root, index), manifest, snapshots.fingerprints(scan.corpus.files), exports=True)
    return store.read(spark, _index(root, index)), manifest


def status(spark: SparkSession, path: str, index: str | None = None) -> dict:
    """What has changed since the index was made: files, settings, extractors, schema; and missing, stale or fresh."""
    root = scans.resolve_root(path)
    scan, manifest = scans.scan(spark, root), store.manifest_of(spark, _index(root, index))
    now = snapshots.fingerprints(scan.corpus.files)
    before = store.state_of(spark, _index(root, index)) if manifest else now.limit(0)
    changed = cut(snapshots.changes(before, now))
    flags = {"schemaChanged": bool(manifest) and manifest["schemaVersion"] != SCHEMA_VERSION, "adapterVersionsChanged": bool(manifest) and manifest["adapterVersions"] != VERSIONS, "configChanged": bool(manifest) and manifest["configHash"] != scan.config.digest()}
    known = spark.range(1).select(snapshots.state(F.lit(not changed.isEmpty()), F.lit(bool(manifest)), *[F.lit(flags[k]) for k in ("schemaChanged", "adapterVersionsChanged", "configChanged")])).first()[0]
    return {"repositoryRoot": root, "indexDirectory": _index(root, index), "state": known, "stale": known != "fresh", "manifest": manifest, "changes": changed, "scan": scan, **flags}


def sync(spark: SparkSession, path: str, index: str | None = None) -> dict:
    """Nothing where the index is fresh; a splice where the changes stand alone; else a new analysis, with the reason."""
    began = time.time()
    before = status(spark, path, index)
    none = dict.fromkeys(("nodesAdded", "nodesRemoved", "edgesAdded", "edgesRemoved", "filesReanalyzed"), 0)
    counts = {r["change"]: r["count"] for r in before["changes"].groupBy("change").count().collect()}
    done = {"filesAdded": counts.get("added", 0), "filesModified": counts.get("modified", 0), "filesDeleted": counts.get("deleted", 0)}
    if not before["stale"]:
        return done | none | {"incremental": True, "fallbackReason": None}
    root, where = before["repositoryRoot"], before["indexDirectory"]
    old = store.read(spark, where) if before["manifest"] else None
    flags = [before[k] for k in ("schemaChanged", "adapterVersionsChanged", "configChanged")]
    if old is not None and not any(flags):
        scan, changed = before["scan"], before["changes"]
        fresh = changed.where("change <> 'deleted'").select("path")
        part = Corpus(cut(scan.corpus.files.join(fresh, "path", "left_semi")), scan.corpus.repository, scan.corpus.name)
        new = run([e for e in EXTRACTORS if e.name in ("typescript", "rust")], part, scan.config.adapters)
        if snapshots.incremental(old.nodes, old.edges, changed, scan.corpus.files, new.nodes, new.edges).first()["incremental"]:
            affected = changed.select(F.col("path").alias("file"))
            gone = cut(old.nodes.join(affected, "file", "left_semi").select("id"))
            graph = Graph(cut(snapshots.spliced(old.nodes, new.nodes, affected)), cut(snapshots.spliced(old.edges, new.edges, affected, gone)), cut(snapshots.spliced(old.diagnostics, new.diagnostics, affected)), new.runs)
            delta = [snapshots.delta(a, b).first() for a, b in ((old.nodes, graph.nodes), (old.edges, graph.edges))]
            store.write(graph, where, manifest_for(graph, scan, root, time.time() - began, before["manifest"].get("enabledAdapters", [])), snapshots.fingerprints(scan.corpus.files))
            return done | {"nodesAdded": delta[0]["added"], "nodesRemoved": delta[0]["removed"], "edgesAdded": delta[1]["added"], "edgesRemoved": delta[1]["removed"], "filesReanalyzed": fresh.count(), "incremental": True, "fallbackReason": None}
    reason = spark.range(1).select(snapshots.fallback_reason(*[F.lit(f) for f in flags])).first()[0]
    graph, _ = analyze(spark, root, where)
    before_nodes, before_edges = (old.nodes, old.edges) if old else (graph.nodes.limit(0), graph.edges.limit(0))
    delta = [snapshots.delta(a, b).first() for a, b in ((before_nodes, graph.nodes), (before_edges, graph.edges))]
    return done | {"nodesAdded": delta[0]["added"], "nodesRemoved": delta[0]["removed"], "edgesAdded": delta[1]["added"], "edgesRemoved": delta[1]["removed"], "filesReanalyzed": sum(counts.values()), "incremental": False, "fallbackReason": reason if old else None}
