"""A corpus of text files written from the relational tables, so that what is extracted from text can be checked against them.

Files hold a bounded number of rows each (blocks of keys), so the corpus grows in files and not in file sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..extractors.base import Corpus
from ..functions.lineage import settled
from ..functions.memo import per_folder
from .tables import read

#: Rows that a file of code, a document and a file of classes hold, and re-exports between a class and those that extend it.
CODE_BLOCK, TEXT_BLOCK, CLASS_BLOCK, CHAIN = 40, 20, 25, 30
SHARED = "src/shared/util.ts"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _files(rows: DataFrame, path: Column, key: str, head: Column, body: Column) -> DataFrame:
    """One file per path: its head and then each row's lines, by key."""
    listed = rows.select(path.alias("path"), head.alias("head"), F.struct(F.col(key).alias("k"), body.alias("t")).alias("r")).groupBy("path").agg(F.min("head").alias("head"), F.array_sort(F.collect_list("r")).alias("r"))
    return listed.select("path", F.concat("head", F.array_join(F.transform("r", lambda x: x["t"]), "")).alias("content"))


def typescript_files(part: DataFrame) -> DataFrame:
    c = F.col
    path = _text("src/", F.replace("p_brand", F.lit("#"), F.lit("")), "/m", F.floor(c("p_partkey") / CODE_BLOCK), ".ts")
    block = F.floor(c("p_partkey") / CODE_BLOCK)
    in_file = W.partitionBy("path").orderBy("p_partkey")
    rows = part.withColumn("path", path)
    following = F.coalesce(F.lead("p_partkey").over(in_file), F.min("p_partkey").over(W.partitionBy("path")))
    rows = rows.withColumn("next", following)
    head = _text('import { helper } from "../shared/util";\nimport missing from "./absent', block % 3, '";\nimport { x } from "@scope', block % 4, '/pkg/sub";\n')
    body = _text("export function p", c("p_partkey"), "() {\n  p", c("next"), "();\n  helper(); lost", c("p_partkey") % 5, "(1);\n}\n")
    return _files(rows, c("path"), "p_partkey", head, body)


def class_files(customer: DataFrame) -> DataFrame:
    """A class per customer, with fields, methods that call each other and its base, an object with a method, a type, comments and templates that look like code."""
    c, k = F.col, F.col("c_custkey")
    block = F.floor(k / CLASS_BLOCK)
    rows = customer.withColumn("path", _text("src/model/c", block, ".ts"))
    body = _text(
        "// import { ghost } from './ghost';\n/* class Gone", k, " {\n  lost() {}\n} */\nexport type Key", k, " = { id: number } | string;\nexport class Model", k, " extends Base {\n  private key?: Key", k, ";\n",
        "  constructor(private owner: Model", k, ") { super(); }\n  async load", k, "(key: Key", k, ",\n    more: string): Promise<Key", k, "> {\n    const text = `ghost(${this.name", k, "()} class Not {`;\n    this.owner.name", k, "();\n    this.base();\n    return key;\n  }\n",
        "  name", k, "() { return \"fake(1)\"; }\n}\nexport const tools", k, " = {\n  run", k, "() { new Model", k, "(); },\n  total: 1,\n};\n",
    )
    return _files(rows, c("path"), "c_custkey", F.lit('import { Base } from "../shared/chain0";\n'), body)


def chain_files(spark: SparkSession) -> DataFrame:
    """A base class behind a chain of CHAIN re-exports, by name and by star in turn."""
    links = spark.range(CHAIN).select(_text("src/shared/chain", F.col("id"), ".ts").alias("path"), F.when(F.col("id") % 2 == 0, _text('export { Base } from "./chain', F.col("id") + 1, '";\n')).otherwise(_text('export * from "./chain', F.col("id") + 1, '";\n')).alias("content"))
    end = spark.range(1).select(F.lit(f"src/shared/chain{CHAIN}.ts").alias("path"), F.lit("export class Base {\n  base() {}\n}\n").alias("content"))
    return links.unionByName(end)


def view_files(nation: DataFrame) -> DataFrame:
    """A component per nation that shows the next one's and one that is nowhere, with text that looks like code."""
    c, k = F.col, F.col("n_nationkey")
    body = _text("export function View", k, "() {\n  return (\n    <section title={call", k, "(1)}>\n      text with View", k, "(2) and import x from 'y'\n      <View", (k + 1) % 25, " onPick={pick", k, "} />\n      <Lost.Panel", k, " />\n    </section>\n  );\n}\nfunction call", k, "(n: number) { return n; }\nexport const pick", k, " = () => null;\n")
    return nation.select(_text("src/view/v", k, ".tsx").alias("path"), body.alias("content"))


def markdown_files(supplier: DataFrame) -> DataFrame:
    c = F.col
    path = _text("docs/n", c("s_nationkey"), "/", F.floor(c("s_suppkey") / TEXT_BLOCK), ".md")
    body = _text("## ", c("s_name"), "\nCalls `p", c("s_suppkey"), f"` in {SHARED}.\n```\n$ npm run s", c("s_suppkey") % 7, "\n```\nGET /api/s/", c("s_suppkey"), "\ncargo test.\n")
    return _files(supplier, path, "s_suppkey", _text("# Nation ", c("s_nationkey"), "\n"), body)


def rust_files(supplier: DataFrame) -> DataFrame:
    c = F.col
    block = F.floor(c("s_suppkey") / TEXT_BLOCK)
    path = _text("crate/src/n", c("s_nationkey"), "_", block, ".rs")
    rows = supplier.withColumn("path", path)
    following = F.coalesce(F.lead("s_suppkey").over(W.partitionBy("path").orderBy("s_suppkey")), F.min("s_suppkey").over(W.partitionBy("path")))
    body = _text("pub fn s", c("s_suppkey"), "() {\n    s", c("next"), "();\n    start();\n    Base::make();\n    gone", c("s_suppkey") % 3, "();\n}\n")
    return _files(rows.withColumn("next", following), c("path"), "s_suppkey", F.lit("use crate::base::{start, Base};\n"), body)


def manifest_files(nation: DataFrame) -> DataFrame:
    """A package manifest and a Cargo manifest per region."""
    c = F.col
    region = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("n"))
    dependency = F.array_join(F.transform("n", lambda k: F.concat(F.lit('"n'), k.cast("string"), F.lit('": "^'), k.cast("string"), F.lit('"'))), ", ")
    scripts = ", ".join(f'"s{i}": "run {i}"' for i in range(7))
    package = region.select(_text("pkg/r", c("n_regionkey"), "/package.json").alias("path"), _text('{"name": "r', c("n_regionkey"), f'", "scripts": {{{scripts}}}, "dependencies": {{', dependency, "}}").alias("content"))
    crates = F.array_join(F.transform("n", lambda k: F.concat(F.lit("n"), k.cast("string"), F.lit(' = "'), k.cast("string"), F.lit('" # pinned\n'))), "")
    cargo = region.select(_text("pkg/r", c("n_regionkey"), "/Cargo.toml").alias("path"), _text('[package]\nname = "c', c("n_regionkey"), '"\n[dependencies]\n', crates, '[features]\nall = ["a#b"]\n[[bin]]\nname = "b', c("n_regionkey"), '"\n').alias("content"))
    return package.unionByName(cargo)


def test_files(nation: DataFrame) -> DataFrame:
    c = F.col
    return nation.select(_text("tests/n", c("n_nationkey"), ".test.ts").alias("path"), _text('import { helper } from "../src/shared/util";\nit("p', c("n_nationkey"), ' works", () => {});\ntest("n ', c("n_nationkey"), '", () => {});\n').alias("content"))


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: read(spark, sf_dir, name)
    fixed = spark.range(1).select(F.explode(F.array(F.struct(F.lit(SHARED).alias("path"), F.lit("export function helper() {}\n").alias("content")), F.struct(F.lit("crate/src/base.rs").alias("path"), F.lit("pub struct Base {}\nimpl Base {\n    pub fn make() {}\n}\npub fn start() {}\n").alias("content")))).alias("f")).select("f.*")
    out = fixed
    for df in (typescript_files(t("part")), markdown_files(t("supplier")), rust_files(t("supplier")), manifest_files(t("nation")), test_files(t("nation"))):
        out = out.unionByName(df)
    return out


@per_folder(4)
def corpus_of(spark: SparkSession, sf_dir: str) -> Corpus:
    """The corpus of a folder of tables, written once per session."""
    return Corpus(settled(files_of(spark, sf_dir)), "generated", "generated")


@per_folder(4)
def rich_corpus_of(spark: SparkSession, sf_dir: str) -> Corpus:
    """Classes, objects, types, markup, re-exports, and text that only looks like code; written once per session."""
    files = class_files(read(spark, sf_dir, "customer")).unionByName(chain_files(spark)).unionByName(view_files(read(spark, sf_dir, "nation")))
    return Corpus(settled(files), "rich", "rich")
