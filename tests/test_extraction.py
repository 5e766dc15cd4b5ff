"""Extraction, assembly, storage, sync and watching of a small repository."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.extractors.base import Corpus, Found, diagnostic_rows
from graphloom.operators import lookups, output, snapshots, traverse
from graphloom.plans import analysis
from graphloom.sources import corpus as scans
from graphloom.sources import store
from tests.corpora import APP


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    for path, text in APP.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "src/latin.ts").write_bytes(b"// \xff\xfe not UTF-8\n")
    return root


@pytest.fixture(scope="module")
def analysed(spark, repository):
    return analysis.analyze(spark, str(repository))


@pytest.fixture(scope="module")
def links(analysed):
    graph, _ = analysed
    name = lambda e: graph.nodes.select(F.col("id").alias(e), F.concat_ws(" ", "kind", "name").alias(f"{e}_name"))
    rows = graph.edges.join(name("source"), "source").join(name("target"), "target").collect()
    return {(r["kind"], r["source_name"], r["target_name"], r["confidence"]) for r in rows}


def test_scan_and_manifest(analysed, repository, spark):
    graph, manifest = analysed
    files = {r["file"] for r in graph.nodes.where("kind = 'file'").collect()}
    assert "node_modules/x/index.ts" not in files and {"src/orders.ts", "README.md", "src-tauri/src/main.rs", "tests/orders.test.ts"} <= files
    assert manifest["excludedFileCount"] == 1 and manifest["nodeCount"] == graph.nodes.count() and manifest["edgeCount"] == graph.edges.count()
    assert set(manifest["enabledAdapters"]) == {"core", *scans.ADAPTERS}
    told = {(r["code"], r["file"]) for r in graph.diagnostics.collect()}
    assert {("unreadable-file", "src/latin.ts"), ("invalid-package-json", "broken/package.json"), ("rust-parser-error-node", "src-tauri/src/bad.rs"), ("unresolved-import", "src/orders.ts"), ("unresolved-react-callback", "src/view.tsx")} <= told
    assert graph.nodes.select("id").distinct().count() == graph.nodes.count() and not [c for c, _ in told if c.startswith(("duplicate", "adapter-failure"))]
    assert store.runs_history(spark, str(repository / scans.INDEX_FOLDER)).count() == len(analysis.EXTRACTORS)


@pytest.mark.parametrize(
    "edge",
    [
        ("contains", "repository", "directory src", "exact"),
        ("imports", "file orders.ts", "file money.ts", "resolved"), ("imports", "file orders.ts", "external_package @tauri-apps/api", "resolved"), ("imports", "file orders.ts", "unresolved_symbol ./nowhere", "unresolved"),
        ("calls", "function placeOrder", "function round", "resolved"), ("calls", "function placeOrder", "class Purse", "resolved"), ("calls", "method add", "method check", "resolved"),
        ("calls", "function placeOrder", "unresolved_symbol <common-method>", "unresolved"), ("uses_type", "function helper", "interface Money", "resolved"),
        ("renders", "react_component OrderView", "react_component OrderRow", "probable"), ("renders", "react_component OrderView", "unresolved_symbol Thing", "unresolved"), ("passes_callback", "react_component OrderView", "function placeOrder", "probable"),
        ("calls", "function place_order", "method save", "resolved"), ("calls", "function place_order", "method new", "resolved"), ("calls", "method new", "method blank", "resolved"), ("calls", "method save", "function unique_helper", "probable"),
        ("calls", "function main", "function cancel", "resolved"), ("calls", "function setup", "function cancel", "resolved"), ("calls", "function setup", "unresolved_symbol elsewhere", "unresolved"),
        ("invokes", "framework_command place_order", "function place_order", "exact"), ("invokes", "function placeOrder", "framework_command no_such_command", "exact"), ("registers", "file main.rs", "framework_command ghost", "exact"),
        ("emits", "function place_order", "framework_event order-done", "probable"), ("emits", "function place_order", "unresolved_symbol unknown_name", "unresolved"), ("listens", "framework_event order-done", "function helper", "exact"),
        ("contains", "doc_section Usage", "cli_command npm test", "exact"), ("exposes_api", "doc_section Routes", "api_surface GET /api/orders", "exact"), ("mentions", "api_surface GET /api/orders", "file orders.ts", "resolved"),
        ("configures", "configuration package shop", "configuration script build", "exact"), ("exposes_api", "configuration package shop", "cli_command shop", "exact"), ("exposes_api", "configuration cargo package shop-core", "configuration bin path", "exact"),
        ("contains", "security_boundary capability main", "configuration permissions fs:read", "exact"), ("configures", "security_boundary capability main", "framework_command place_order", "resolved"), ("configures", "configuration tauri bundle", "file orders.ts", "exact"),
        ("tests", "test_artifact orders", "file orders.ts", "resolved"), ("tests", "test_artifact view.test.tsx", "file view.tsx", "resolved"), ("tests", "test_artifact placeOrder works", "function placeOrder", "probable"),
        ("mentions", "doc_section Shop", "function placeOrder", "resolved"), ("mentions", "doc_section Usage", "file view.tsx", "exact"), ("related_to", "cli_command npm run build", "configuration script build", "exact"),
    ],
)
def test_edges(links, repository, edge):
    kind, source, target, confidence = edge
    assert (kind, source if source != "repository" else f"repository {repository.name}", target, confidence) in links


def test_strings_and_comments_are_no_code(links):
    assert not [x for x in links if x[0] == "calls" and x[1] == "function helper" and x[2] == "function placeOrder"]
    assert not [x for x in links if "negative" in x[2]]


def test_binding_diagnostics(analysed):
    told = {(r["code"], r["message"].split()[2]) for r in analysed[0].diagnostics.where("adapter = 'tauri'").collect()}
    assert ("unmatched-tauri-invoke", "invokes") in {(c, "invokes") for c, _ in told}
    assert {c for c, _ in told} == {"unmatched-tauri-invoke", "unregistered-tauri-command", "unused-tauri-command", "registered-tauri-command-missing-definition", "tauri-event-no-consumer"}


def test_queries_over_the_stored_graph(analysed, spark, repository):
    graph, _ = analysed
    place = graph.nodes.where("name = 'placeOrder' and kind = 'function'").first()["id"]
    around = traverse.neighborhood(graph, place, 1, 50, node_kinds=["framework_command"]).nodes.collect()
    assert {r["name"] for r in around} == {"placeOrder", "place_order", "no_such_command"}
    index = str(repository / scans.INDEX_FOLDER)
    touching = store.edges_touching(spark, index, [place])
    assert touching.count() == graph.edges.where((F.col("source") == place) | (F.col("target") == place)).count()
    plan = touching._jdf.queryExecution().toString()
    assert "EqualTo(source" in plan and "EqualTo(target" in plan
    assert lookups.nodes_by_ids(graph, graph.edges.where(F.col("source") == place), "source").count() == 1
    assert spark.read.json(f"{store.discover(spark, index)}/exports/nodes").count() == graph.nodes.count()


def test_output_shapes(analysed):
    graph, _ = analysed
    assert output.shaped_nodes(graph.nodes).columns == ["id", "name", "kind", "file", "start_line"]
    compact = output.shaped_edges(graph.edges, "compact", 0).first()
    assert compact["evidence"] == [] and set(output.shaped_edges(graph.edges, "compact").first()["evidence"][0].asDict()) == {"file", "line", "column"}
    assert output.evidence_kept("standard") == 3 and output.evidence_kept("full", 1000) == 100
    around = output.format_output({"graph": [graph, {"left": 1}], "n": None}, "compact", 0)
    assert around["graph"][0]["nodes"].columns == ["id", "name", "kind", "file", "start_line"] and around["graph"][0]["edges"].first()["evidence"] == [] and around["graph"][1] == {"left": 1}
    told = [json.loads(r["value"]) for r in output.as_objects(graph.nodes.where("kind = 'function'")).collect()]
    assert all(isinstance(t["metadata"], dict) and None not in t.values() for t in told)
    rows = graph.spark.createDataFrame([('{"symbolCount": 3, "other": 1}',), (None,), ('{"other": 1}',)], "metadata string")
    assert [r[0] for r in rows.select(output.shown_metadata(F.col("metadata"))).collect()] == ['{"symbolCount":"3"}', None, None]
    assert output.as_text({"a": [], "b": {"c": 1}, "d": ["x", {"e": 2}]}) == "a:\n(none)\nb:\n  c: 1\nd:\n  1. x\n  2. e: 2".replace("a:\n(none)", "a:\n  (none)")


def test_status_and_sync(analysed, spark, repository):
    root = str(repository)
    assert analysis.status(spark, root)["state"] == "fresh" and analysis.sync(spark, root)["incremental"]
    alone = repository / "src/util/alone.ts"
    alone.write_text("export function alone(): number {\n  return 1;\n}\n")
    before = store.read(spark, str(repository / scans.INDEX_FOLDER)).nodes.count()
    result = analysis.sync(spark, root)
    assert result["incremental"] and (result["filesAdded"], result["nodesAdded"], result["nodesRemoved"]) == (1, 2, 0)
    assert store.read(spark, str(repository / scans.INDEX_FOLDER)).nodes.count() == before + 2
    told = store.manifest_of(spark, str(repository / scans.INDEX_FOLDER))
    assert told["scannedFileCount"] == spark.read.parquet(f"{store.discover(spark, str(repository / scans.INDEX_FOLDER))}/state").count() and told["enabledAdapters"]
    alone.write_text('import { round } from "./money";\nexport function alone() {\n  return round;\n}\n')
    status = analysis.status(spark, root)
    assert status["stale"] and [(r["path"], r["change"]) for r in status["changes"].collect()] == [("src/util/alone.ts", "modified")]


def test_incremental_guards(spark, analysed):
    graph, _ = analysed
    files = spark.createDataFrame([("src/a.ts", "x"), ("src/b.tsx", "x"), ("new/c.ts", "x"), ("d.md", "x"), ("src/e.ts", "invoke ('x')")], "path string, content string")
    none = Found().complete(spark)
    ask = lambda *changes, new=none: snapshots.incremental(graph.nodes, graph.edges, spark.createDataFrame(list(changes), "path string, change string"), files, new.nodes, new.edges).first()
    assert ask(("src/a.ts", "added"))["incremental"]
    for path, guard in (("src/b.tsx", "framework"), ("new/c.ts", "new_folders"), ("d.md", "not_source"), ("src/e.ts", "framework")):
        row = ask((path, "added"))
        assert not row["incremental"] and row[guard] == 1
    assert ask(("src/orders.ts", "modified"))["crossing"] > 0
    reason = lambda *flags: spark.range(1).select(snapshots.fallback_reason(*map(F.lit, flags))).first()[0]
    assert reason(True, True, True) == "graph schema changed" and reason(False, False, True) == "configuration changed"


def test_a_failing_extractor_leaves_a_diagnostic(spark):
    class Broken:
        name, version = "broken", "1"

        def detect(self, corpus):
            return True

        def extract(self, corpus, graph):
            raise ValueError("out of order")

    files = spark.createDataFrame([("a/b.ts", "export function f() {}\n")], "path string, content string")
    graph = analysis.run([analysis.EXTRACTORS[0], Broken()], Corpus(files))
    assert [r["code"] for r in graph.diagnostics.collect()] == ["adapter-failure"] and graph.nodes.count() == 2
    twice = graph.nodes.unionByName(graph.nodes)
    assert analysis.duplicates(twice, "node").count() == 2 and analysis.merged(twice).count() == 2

    class Twice:
        name, version = "twice", "1"

        def detect(self, corpus):
            return True

        def extract(self, corpus, graph):
            one = analysis.EXTRACTORS[0].extract(corpus, graph)
            return Found(one.nodes.unionByName(one.nodes), one.edges)

    graph = analysis.run([Twice()], Corpus(files))
    assert sorted(r["code"] for r in graph.diagnostics.collect()) == ["duplicate-node-id"] * 2 and graph.nodes.count() == 2
    assert [(r["file_count"], r["node_count"]) for r in graph.runs.collect()] == [(1, 4)]


def test_settings(tmp_path):
    (tmp_path / "Cargo.toml").write_text("")
    (tmp_path / "a/b").mkdir(parents=True)
    assert scans.resolve_root(str(tmp_path / "a/b")) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        scans.resolve_root(str(tmp_path / "none"))
    path = scans.write_config(str(tmp_path))
    with pytest.raises(FileExistsError):
        scans.write_config(str(tmp_path))
    assert scans.load_config(str(tmp_path)) == (scans.Config(), None)
    with open(path, "w") as f:
        f.write('{"exclude": ["**/x/**"], "adapters": {"rust": false}}')
    config, trouble = scans.load_config(str(tmp_path))
    assert trouble is None and config.exclude[-1] == "**/x/**" and not config.adapters["rust"] and config.include == scans.INCLUDE
    with open(path, "w") as f:
        f.write("{")
    config, trouble = scans.load_config(str(tmp_path))
    assert config == scans.Config() and scans.CONFIG_FILE in trouble


def test_diagnostics_are_concatenated(spark):
    one = diagnostic_rows(spark.range(2), "a", "c", "info", F.lit("m"))
    assert one.unionByName(one).count() == 4
