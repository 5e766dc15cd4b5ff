"""Queries over code make the parts that they need, and tokens bring along what stands around them."""

import pytest

from graphloom.extractors import lexer, typescript
from graphloom.extractors.base import Corpus
from graphloom.operators import traverse
from graphloom.plans import text_catalog

SMALL = "/root/testdata/sf0.001"
SOURCE = """import { a } from "./a";
export const f = () => <T x={1}>{g<A<B>>(1)}</T>, h = function (p: A) { return `${p}`; };
export default class C extends a.B<K> { private k?: K; async m(x: K, y = new K()): Promise<K> { this.k.n(); } get n() { return 1; } }
const t = { run() { f(); }, n: 1 }; // function no() {}
type U = { id: number } | string
"""


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sources(spark):
    return spark.createDataFrame([("src/x.tsx", SOURCE), ("src/y.ts", "let z = 1\n"), ("src/n.ts", None)], "path string, content string")


def test_what_stands_around_a_token_comes_from_the_scan(spark):
    got = {(r["path"], r["i"]): r for r in lexer.tokens(sources(spark), "typescript").where("i is not null").collect()}
    code = [r for r in lexer.scan(SOURCE, "typescript", True) if "i" in r]
    assert sorted(i for p, i in got if p == "src/x.tsx") == list(range(len(code)))
    text = lambda k, of="text": code[k].get(of) if k is not None and 0 <= k < len(code) else None
    for r in code:
        i, row = r["i"], got["src/x.tsx", r["i"]]
        assert [row[f"p{n}"] for n in (1, 2, 3, 4)] == [text(i - n) for n in (1, 2, 3, 4)]
        assert [(row[f"t{n}"], row[f"k{n}"], row[f"then{n}"]) for n in (1, 2, 3, 4)] == [(text(i + n), text(i + n, "kind"), text(i + n, "then")) for n in (1, 2, 3, 4)]
        assert (row["up_text"], row["up_role"], row["open_then"], row["stmt_text"], row["last_line"]) == (text(r["up"]), text(r["up"], "role"), text(r.get("opens"), "then"), text(r["stmt"]), text(r["stop"], "line"))
        assert row["markup"] == sum(x["kind"] == "jsx" for x in code[: i + 1])
        assert row["angle"] == sum({"<": 1, ">": -1}.get(x["text"], 0) for x in code[: i + 1] if x["stmt"] == r["stmt"])


@pytest.mark.parametrize("wanted", [typescript.declares, typescript.says])
def test_tokens_that_no_part_needs_stay_in_the_worker(spark, wanted, monkeypatch):
    every, few = lexer.tokens(sources(spark), "typescript"), lexer.tokens(sources(spark), "typescript", wanted, typescript.READ)
    rows = lambda df: sorted(map(str, df.collect()))
    plans, kept = [], typescript.settled
    monkeypatch.setattr(typescript, "settled", lambda df: (plans.append(plan_of(df)), kept(df))[1])
    assert few.count() < every.count() and rows(typescript.declarations(few)) == rows(typescript.declarations(every))
    # tokens are scanned once and not joined or sorted
    assert sum(p.split("== Initial Plan ==")[0].count("MapInArrow") for p in plans) == 2
    assert not any(x in p for p in plans if "MapInArrow" in p for x in ("Join", "Sort", "Exchange hash"))
    if wanted is typescript.says:
        for part in (lambda t: typescript.calls_of(t, typescript.declarations(every)), typescript.names_of, typescript.type_references, lambda t: typescript.typed_names(t, typescript.declarations(every).withColumnRenamed("qualified_name", "id"))):
            assert rows(part(few)) == rows(part(every)) != []


def none(*_, **__):
    raise AssertionError("not needed")


@pytest.mark.parametrize("query, unused", [("jsx_callbacks", ("resolved_calls", "imports", "exports")), ("jsx_renders", ("resolved_calls", "imports", "exports")), ("type_uses", ("resolved_calls", "calls_of")), ("member_calls", ("type_references",)), ("call_cycles", ("type_references",))])
def test_queries_make_no_other_parts(spark, monkeypatch, query, unused):
    for name in unused:
        monkeypatch.setattr(typescript, name, none)
    text_catalog.QUERIES[query](spark, SMALL).collect()


def test_names_that_no_other_module_gives_on_take_no_part_in_the_rounds(spark, monkeypatch):
    seeds, kept = [], typescript.fixpoint
    monkeypatch.setattr(typescript, "fixpoint", lambda seed, *more: (seeds.append(seed.count()), kept(seed, *more))[1])
    files = [(f"src/m{k}.ts", f"export function f{k}() {{}}\n") for k in range(40)] + [("src/all.ts", 'export * from "./m1";\nexport { f2 as g } from "./m2";\n')]
    r = typescript.Reading(Corpus(spark.createDataFrame(files, "path string, content string")))
    assert {(x["path"], x["name"]) for x in r.exported.collect()} == {(f"src/m{k}.ts", f"f{k}") for k in range(40)} | {("src/all.ts", "f1"), ("src/all.ts", "g")}
    assert seeds == [2]


def test_edges_are_made_once_for_cycles(spark, monkeypatch):
    plans, kept = [], traverse.settled
    monkeypatch.setattr(traverse, "settled", lambda df: (plans.append(plan_of(df)), kept(df))[1])
    edges = spark.range(30).selectExpr("lpad(id, 3, '0') as ord", "cast(id as string) as source", "cast(cast((id + 1) % 10 + 10 * floor(id / 10) + 0 * cos(id) as int) as string) as target")
    assert sorted(r["length"] for r in traverse.cycles_of(edges).collect()) == [10, 10, 10]
    assert sum("COS" in p.split("== Initial Plan ==")[0] for p in plans) == 1
