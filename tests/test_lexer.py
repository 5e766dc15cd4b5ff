"""The scanner, and what extraction makes of code that earlier patterns misread."""

import pytest
from pyspark.sql import functions as F

from graphloom.extractors import code, lexer, manifests, rust
from graphloom.extractors.base import Corpus, Found, matches, placed
from graphloom.extractors.rust import Rust
from graphloom.extractors.typescript import TypeScript

TS = '''// import a from "b"
/* import x from "y" */
import { round, type Money as M } from "./money";
export async function
  place(a: { x: number }, b?: string): { y: number } {
  const t = `ghost() ${inner(`deep ${a.b?.c()}`)} tail
  import z from "z"`;
  return a ? b : /re\\/x("/.test("foo()") / 2;
}
export const api = {
  run() { go(); },
  total: 3,
};
'''


def kinds(rows, *wanted):
    return [(r["kind"], r["text"]) for r in rows if r["kind"] in wanted]


def test_strings_comments_templates_and_regular_expressions():
    rows = lexer.scan(TS, "typescript")
    assert kinds(rows, "comment") == [("comment", '// import a from "b"'), ("comment", '/* import x from "y" */')]
    assert kinds(rows, "regex") == [("regex", '/re\\/x("/')]
    assert [t for _, t in kinds(rows, "template")] == ["`ghost() ", "`deep ", "`", ' tail\n  import z from "z"`']
    assert [t for _, t in kinds(rows, "string")] == ['"./money"', '"foo()"']
    for r in rows:
        assert TS[r["start"] : r["end"]] == r["text"]
        line = TS[: r["start"]].count("\n") + 1
        assert (r["line"], r["column"]) == (line, r["start"] - (TS.rfind("\n", 0, r["start"]) + 1) + 1)


def test_brackets_statements_and_chains():
    rows = [r for r in lexer.scan(TS, "typescript") if "i" in r]
    assert [r["i"] for r in rows] == list(range(len(rows)))
    for r in rows:
        if r.get("partner") is not None:
            assert rows[r["partner"]]["partner"] == r["i"]
    assert {r["chain"] for r in rows if r.get("opens") is not None} == {"place", "inner", "a.b.c", ".test", "run", "go"}
    place = next(r for r in rows if r["text"] == "function")
    assert rows[place["stmt"]]["text"] == "export" and place["stop_line"] == 9
    run = next(r for r in rows if r["text"] == "run")
    assert rows[run["up"]]["role"] == "object" and rows[run["opens"]]["then"] == "{" and run["stop_line"] == 11


def test_markup_and_broken_texts():
    rows = lexer.scan("const x = a < b;\nconst e = <A b={c} d='e'>text if (x) {f(1)}<B.C /></A>;\nconst g = <T,>(x: T) => x;", "typescript", True)
    assert [t for _, t in kinds(rows, "jsx")] == ["A", "B.C"] and [t for _, t in kinds(rows, "jsx_text")] == ["text if (x) "]
    for text in ("'", '"abc', "`a ${", "/* x", "{ ( [", ") ] }", "`${`${`", "<a", "<", "", None, "\\", "a.b.", "r#\"x", "'a", "😀 = \"漢\""):
        for language in ("typescript", "rust"):
            assert all(r["end"] >= r["start"] for r in lexer.scan(text, language, True))
    assert lexer.scan("x" * 500_000 + " ()", "typescript")[-1]["text"] == ")"


def test_rust_tokens():
    rows = lexer.scan('fn f<\'a>(x: &\'a str) -> char { let r = r#"use a::b; }"#; /* /* use c; */ */ let c = \'{\'; b"\\""; \'\\u{7d}\' }', "rust")
    assert [t for _, t in kinds(rows, "lifetime")] == ["'a", "'a"] and [t for _, t in kinds(rows, "char")] == ["'{'", "'\\u{7d}'"]
    assert [t for _, t in kinds(rows, "string")] == ['r#"use a::b; }"#', 'b"\\""'] and len(kinds(rows, "comment")) == 1
    assert all(r.get("partner") is not None for r in rows if r["text"] in tuple("(){}"))


def files(spark, **texts):
    return spark.createDataFrame([(p.replace("__", "/").replace("_dot_", "."), t) for p, t in texts.items()], "path string, content string")


def test_places_of_repeats(spark):
    df = spark.createDataFrame([("a", "it(1) it(2)\n it(3)\n\nit(4)")], "path string, content string")
    assert [(r["line"], r["column"], r["n"]) for r in placed(df, "content", r"it\((\d)\)", "n").orderBy("nth").collect()] == [(1, 1, "1"), (1, 7, "2"), (2, 2, "3"), (4, 1, "4")]
    assert [(r["at"], r["n"]) for r in matches(df, "content", r"it\((\d)\)", "n", at="at").orderBy("nth").collect()] == [(1, "1"), (7, "2"), (14, "3"), (21, "4")]
    bare = lexer.masked(df.select("path", F.lit("a \"b\" // c\n`d` e").alias("content")), "typescript").first()["bare"]
    assert bare == 'a " "     \n    e'


def calls(spark, extractor, texts):
    found = extractor.extract(Corpus(spark.createDataFrame(list(texts.items()), "path string, content string")), Found()).complete(spark)
    names = {r["id"]: (r["file"] or "", r["name"]) for r in found.nodes.collect()}
    return {(r["kind"], names[r["source"]][1], *names.get(r["target"], ("", "?")), r["confidence"], r["evidence"][0]["line"]) for r in found.edges.where("kind <> 'contains'").collect()}


@pytest.fixture(scope="module")
def typescript_calls(spark):
    chain = {f"src/c{i}.ts": f'export {{ far{"" if i else " as near"} }} from "./c{i + 1}";\n' for i in range(6)}
    return calls(
        spark,
        TypeScript(),
        chain
        | {
            "src/c6.ts": 'export * from "./c7";\nexport * from "./c8";\n',
            "src/c7.ts": 'export * from "./c6";\nexport function other() {}\n',
            "src/c8.ts": "function hidden() {}\nexport { hidden as far };\nexport default hidden;\n",
            "src/x.ts": "export function x() {}\n",
            "src/y.ts": '/*\nimport { x } from "./x";\n*/\nimport { near as go, } from "./c0";\nimport first from "./c8";\nexport function f() {\n  x();\n  go();\n  first();\n  const s = `ghost()\n  x() ${go()}`;\n}\nexport const box = {\n  run() {\n    this_one();\n  },\n};\n',
            "src/k.ts": "export class Base {\n  base() {}\n  over() {}\n}\nexport class Sub<T extends Base> extends Base {\n  private other: Base;\n  over() {}\n  go(p: Base) {\n    this.base();\n    this.over();\n    p.over();\n    this.other.base();\n    const n = new Sub();\n    n.over();\n  }\n}\n",
        },
    )


def test_comments_bind_no_names_and_chains_of_exports_are_followed(typescript_calls):
    got = {x for x in typescript_calls if x[0] == "calls" and x[1] in ("f", "run")}
    assert got == {("calls", "f", "src/y.ts", "x", "unresolved", 7), ("calls", "f", "src/c8.ts", "hidden", "resolved", 8), ("calls", "f", "src/c8.ts", "hidden", "resolved", 9), ("calls", "f", "src/y.ts", "x", "unresolved", 7), ("calls", "f", "src/c8.ts", "hidden", "resolved", 11), ("calls", "run", "src/y.ts", "this_one", "unresolved", 15)}
    assert not [x for x in typescript_calls if x[0] == "imports" and x[3] == "x.ts"]


def test_members_of_types_and_bases(typescript_calls):
    got = [(x[3], x[5]) for x in typescript_calls if x[0] == "calls" and x[1] == "go" and x[4] == "resolved"]
    assert sorted(got) == [("Sub", 13), ("base", 9), ("base", 12), ("over", 10), ("over", 11), ("over", 14)]


def test_a_use_is_where_it_stands(spark):
    deep = "use " + "".join(f"a{i}::{{" for i in range(9)) + "deep" + "}" * 9 + ";\n"
    texts = {"src/main.rs": "// use crate::util::go;\nfn a() {\n    go();\n}\nfn f() {\n    use crate::util::go;\n    go();\n}\nmod util;\nmod other;\n" + deep, "src/util.rs": "pub fn go() {}\n", "src/other.rs": "pub fn go() {}\n"}
    got = {x for x in calls(spark, Rust(), texts) if x[0] == "calls"}
    assert ("calls", "f", "src/util.rs", "go", "resolved", 7) in got and ("calls", "a", "src/main.rs", "go", "unresolved", 3) in got
    toks = lexer.tokens(spark.createDataFrame(list(texts.items()), "path string, content string"), "rust")
    none = spark.createDataFrame([], "path string, i int, to int, id string")
    leaves = {"::".join(r["target"]) for r in rust.use_bindings(toks, none).collect()}
    assert "::".join(f"a{i}" for i in range(9)) + "::deep" in leaves


def test_owners_of_a_long_file(spark):
    places = spark.range(1, 50_001).select(F.lit("p").alias("path"), F.col("id").cast("int").alias("line"))
    ranges = spark.range(5000).select(F.lit("p").alias("path"), (F.col("id") * 10 + 1).cast("int").alias("line"), (F.col("id") * 10 + 8).cast("int").alias("end"), F.col("id").alias("n")).unionByName(spark.range(1).select(F.lit("p").alias("path"), F.lit(1).alias("line"), F.lit(50_000).alias("end"), F.lit(-1).cast("long").alias("n")))
    got = code.with_owner(places, ranges).select("line", "owner.n").toPandas().sort_values("line")["n"].tolist()
    assert got == [(line - 1) // 10 if (line - 1) % 10 < 8 else -1 for line in range(1, 50_001)]
    assert code.with_owner(places.limit(1), ranges.limit(0)).first()["owner"] is None


def test_settings_come_in_page_order_at_any_depth(spark):
    deep = '{"a":' * 20 + '{"csp": "deep"}' + "}" * 20
    texts = [("x/tauri.conf.json", '{"z": {"deep": {"csp": "first"}}, "a": {"csp": "second"}, "build": {"n": -1}, "app": null}'), ("y/tauri.conf.json", deep), ("z/tauri.conf.json", '{"csp": "two", "w": {"windows": [1, {"csp": 3}]}}')]
    got = {(r["path"][0], r["key"]): r["value"] for r in manifests.settings(spark.createDataFrame(texts, "path string, content string")).collect()}
    assert got == {("x", "csp"): "first", ("x", "build"): '{"n":-1}', ("x", "app"): "null", ("y", "csp"): "deep", ("z", "csp"): "two", ("z", "windows"): '[1,{"csp":3}]'}
