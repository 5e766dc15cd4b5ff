"""Steps that read what they need once: imports out of one scan, a context's symbols before its edges."""

from pyspark.sql import functions as F

from graphloom.extractors import code, lexer, typescript
from graphloom.operators import context
from graphloom.operators.scope import is_test_file, scoped_nodes, trusted, with_endpoints
from graphloom.sources.tables import graph_of

SMALL = "/root/testdata/sf0.001"
SOURCE = """import a from "./a"; import { b } /* from "./ghost" */ from '../b'; // from "./gone"
export * from "./c.js";
import "./side";
export const from = "./no";
function f() { import("./late"); g(from, "./no"); }
import d from "pkg/d"
"""


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_imports_scan_the_files_once(spark, monkeypatch):
    """Also where the tokens are not stored; the result is that of tokens with all their neighbours."""
    files = spark.createDataFrame([("src/x/m.ts", SOURCE), ("src/y/m.ts", SOURCE), ("src/x/a.ts", ""), ("src/b/index.ts", ""), ("src/x/c.ts", ""), ("m.ts", SOURCE), ("b.ts", ""), ("n.ts", None)], "path string, content string")
    plans, kept = [], typescript.settled
    monkeypatch.setattr(typescript, "settled", lambda df: (plans.append(plan_of(df)), kept(df))[1])
    found = typescript.imports(lexer.tokens(files, "typescript"), files)
    plans.append(plan_of(found))
    assert sum(p.split("== Initial Plan ==")[0].count("MapInArrow") for p in plans) == 1
    columns = ("path", "line", "column", "word", "specifier", "target")
    got = sorted(tuple(r) for r in found.select(*columns).collect())
    assert got == sorted(tuple(r) for r in typescript.imports(typescript.prepared(lexer.tokens(files, "typescript")), files).select(*columns).collect())
    assert [r[1:] for r in got if r[0] == "src/x/m.ts"] == [(1, 1, "import", "./a", "src/x/a.ts"), (1, 22, "import", "../b", "src/b/index.ts"), (2, 1, "export", "./c.js", "src/x/c.ts"), (3, 1, "import", "./side", None), (6, 1, "import", "pkg/d", None)]
    assert [[r[5] for r in got if r[0] == path] for path in ("m.ts", "src/y/m.ts")] == [[None] * 5, [None, "src/b/index.ts", None, None, None]]


def test_candidates_are_made_once_a_folder(spark):
    """300 files of one folder that import the same module: nine candidates at most, not nine for each file."""
    rows = spark.range(300).select(F.concat(F.lit("src/f"), "id", F.lit(".ts")).alias("path"), F.lit("./a").alias("specifier"))
    found = code.resolve_imports(rows, spark.createDataFrame([("src/a.tsx",), ("src/a/index.ts",)], "path string"))
    assert {r["target"] for r in found.collect()} == {"src/a.tsx"} and found.count() == 300
    grouped = [line for line in plan_of(found).splitlines() if "HashAggregate" in line or "SortAggregate" in line]
    assert grouped and not any("path#" in line for line in grouped)


def test_context_asks_only_for_the_symbols_edges(spark):
    """The symbols' ids are values that filter lineitem's rows before pairs of them are grouped; no edge meets all nodes."""
    graph = graph_of(spark, SMALL)
    for scope in ("code", "full"):
        got = context.context(graph, "brand standard click customer doc", 30, scope=scope, probable=True)
        ids = context.ranked_symbols(graph, "brand standard click customer doc", 30, scope)
        assert [r["id"] for r in got.symbols.collect()] == [r["id"] for r in ids.collect()]
        chosen = {r["id"] for r in got.symbols.collect()}
        near = [r for r in with_endpoints(trusted(graph.edges, scope, True), graph.nodes, scope).select("ord", "id", "source", "target").collect() if r["source"] in chosen or r["target"] in chosen]
        both = sorted((r["ord"], r["id"]) for r in near if r["source"] in chosen and r["target"] in chosen)[:90]
        assert [(r["ord"], r["id"]) for r in got.relationships.collect()] == both and both
        other = {r["target"] if r["source"] in chosen else r["source"] for r in near}
        tests = sorted({r["file"] for r in scoped_nodes(graph.nodes, scope).where(F.col("file").isNotNull() & is_test_file(F.col("file"))).collect() if r["id"] in other})
        assert [r["file"] for r in got.related_tests.collect()] == tests
        plan = plan_of(got.relationships)
        assert "degree" not in plan and "cmp:c" in plan
