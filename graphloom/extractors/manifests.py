"""Package manifests, TOML manifests, application settings and capability files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lexer import tokens
from .base import Corpus, Found, diagnostic_rows, edge_rows, file_id, id_of, knowledge_rows, lines_of, node_rows, place_of, union

# Which files are which manifest, and the keys that are read.
PACKAGE_FILES, CARGO_FILES = r"(?:^|/)package\.json$", r"(?:^|/)Cargo\.toml$"
SETTINGS_FILES, CAPABILITY_FILES = r"(?:^|/)tauri\.conf(?:\.[^/]+)?\.json$", r"(?:^|/)capabilities/[^/]+\.json$"
SECTIONS = ("dependencies", "devDependencies", "peerDependencies")
SETTING_KEYS = ("productName", "identifier", "build", "app", "windows", "bundle", "security", "csp", "capabilities")
BOUNDARY_KEYS = ("security", "csp", "capabilities")
TOML_SECTIONS = ("dependencies", "dev-dependencies", "features")


def json_files(files: DataFrame, pattern: str) -> DataFrame:
    """(path, content, doc): the files of a pattern as variants; doc is null where the text is no JSON object."""
    doc = F.try_parse_json("content")
    return files.where(F.col("path").rlike(pattern)).select("path", "content", F.when(F.schema_of_variant(doc).startswith("OBJECT"), doc).alias("doc"))


def invalid(rows: DataFrame, adapter: str, code: str) -> DataFrame:
    return diagnostic_rows(rows.where("doc is null"), adapter, code, "warning", F.concat(F.lit("Unable to parse "), "path"), F.col("path"))


def entries(rows: DataFrame, at: str) -> DataFrame:
    """(path, content, key, value) of the object at a path of the document; nested values stay JSON text."""
    table = F.try_variant_get("doc", at, "map<string, variant>")
    opened = rows.where("doc is not null").select("path", "content", F.explode(table).alias("key", "v"))
    text = F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string")).otherwise(F.to_json("v"))
    return opened.select("path", "content", "key", text.alias("value"))


def string_at(at: str) -> Column:
    """The string at a path; null if it is anything else."""
    v = F.try_variant_get("doc", at, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get("doc", at, "string"))


def _file_nodes(rows: DataFrame, corpus: Corpus, adapter: str, rank: int) -> DataFrame:
    c = F.col
    return node_rows(rows.select("path").distinct(), corpus, adapter, rank, "file", F.element_at(F.split("path", "/"), -1), c("path"), file=c("path"), graph_domain="knowledge", source_category="config")


def package_facts(files: DataFrame) -> DataFrame:
    """(path, what, key, value): package, script, dependency sections and bin entries of package manifests."""
    rows = json_files(files, PACKAGE_FILES)
    fine = rows.where("doc is not null")
    name = F.coalesce(string_at("$.name"), F.col("path"))
    head = fine.select("path", "content", F.lit("package").alias("what"), name.alias("key"), name.alias("value"))
    parts = [entries(rows, f"$.{s}").withColumn("what", F.lit(w)) for s, w in [("scripts", "script"), *[(s, s) for s in SECTIONS], ("bin", "bin")]]
    single = fine.where(string_at("$.bin").isNotNull()).select("path", "content", F.lit("bin").alias("what"), name.alias("key"), string_at("$.bin").alias("value"))
    return union(head, *parts, single).select("path", "content", "what", "key", "value")


def script_command(script: Column) -> Column:
    return F.when(script == "test", "npm test").otherwise(F.concat(F.lit("npm run "), script))


class PackageManifests:
    name, version, rank = "packageJson", "1", 31

    def detect(self, corpus: Corpus) -> bool:
        return not corpus.files.where(F.col("path").rlike(PACKAGE_FILES)).select("path").limit(1).isEmpty()

    def extract(self, corpus: Corpus, graph: Found) -> Found:
        c = F.col
        facts = package_facts(corpus.files)
        line, column = place_of(c("content"), F.concat(F.lit('"'), "key", F.lit('"')))
        facts = facts.withColumn("line", F.when(c("what") == "package", 1).otherwise(line)).withColumn("column", F.when(c("what") == "package", 1).otherwise(column)).drop("content")
        stable = F.when(c("what") == "package", F.concat(F.lit("package:"), "path", F.lit(":"), "key")).otherwise(F.concat(F.lit("package:"), "path", F.lit(":"), "what", F.lit(":"), "key"))
        kind = F.when(c("what") == "bin", "cli_command").otherwise("configuration")
        label = F.when(c("what") == "bin", c("key")).otherwise(F.concat_ws(" ", "what", "key"))
        method = F.when(c("what") == "package", "package_manifest").when(c("what") == "script", "package_script").when(c("what") == "bin", "package_bin").otherwise("package_dependency")
        nodes = knowledge_rows(facts, corpus, self.name, self.rank, kind, label, stable, "config", file=c("path"), start_line=c("line"), start_column=c("column"), literal=c("value"), method=method)
        scripts = facts.where("what = 'script'").withColumn("cli", script_command(c("key")))
        cli_key = F.concat(F.lit("cli:"), "cli")
        cli_nodes = knowledge_rows(scripts, corpus, self.name, self.rank, "cli_command", c("cli"), cli_key, "config", file=c("path"), start_line=c("line"), start_column=c("column"), literal=c("cli"), method="package_script_command")
        head = facts.where("what = 'package'").select("path", id_of(corpus, "configuration", stable, c("path")).alias("package_id"))
        rest = facts.where("what <> 'package'").join(head, "path")
        own = id_of(corpus, kind, stable, c("path"))
        edge_kind = F.when(c("what") == "script", "configures").when(c("what") == "bin", "exposes_api").otherwise("related_to")
        known = {"domain": "knowledge"}
        edges = union(
            edge_rows(facts.where("what = 'package'"), self.name, self.rank, "configures", file_id(corpus, c("path")), own, "exact", c("path"), 1, 1, "package.json", c("key"), "literal-manifest", **known),
            edge_rows(rest, self.name, self.rank, edge_kind, c("package_id"), own, "exact", c("path"), c("line"), c("column"), c("what"), c("key"), "literal-manifest-key", **known),
            edge_rows(scripts, self.name, self.rank, "exposes_api", own, id_of(corpus, "cli_command", cli_key, c("path")), "exact", c("path"), c("line"), c("column"), "package script", c("key"), "literal-manifest-key", **known),
        )
        rows = json_files(corpus.files, PACKAGE_FILES)
        return Found(union(_file_nodes(rows.where("doc is not null"), corpus, self.name, self.rank), nodes, cli_nodes), edges, invalid(rows, self.name, "invalid-package-json"))


def toml_entries(files: DataFrame) -> DataFrame:
    """(path, line, column, section, key, value): settings of TOML files by line; the nth [[bin]] is section bin:n.

    A carried value over lines, so a file's lines meet in one sort; comments end where # stands outside quotes."""
    c = F.col
    bare = F.trim(F.regexp_extract("text", r'^((?:[^"#]|"(?:\\.|[^"\\])*")*)', 1))
    lines = lines_of(files).withColumn("bare", bare)
    so_far = W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = F.sum(c("bare").rlike(r"^\[\[\s*bin\s*\]\]$").cast("int")).over(so_far)
    opened = F.when(c("bare").rlike(r"^\[\[\s*bin\s*\]\]$"), F.concat(F.lit("bin:"), (bins - 1).cast("string"))).when(c("bare").rlike(r"^\[+[^\]]+\]+$"), F.trim(F.regexp_extract("bare", r"^\[+([^\]]+)\]+$", 1)))
    placed = lines.withColumn("opened", opened).withColumn("section", F.coalesce(F.last("opened", ignorenulls=True).over(so_far), F.lit("")))
    pair = placed.where(c("opened").isNull() & c("bare").rlike(r"^[^=\s][^=]*="))
    key = F.regexp_replace(F.trim(F.regexp_extract("bare", r"^([^=]+)=", 1)), r'^"|"$', "")
    value = F.regexp_replace(F.trim(F.regexp_extract("bare", r"^[^=]+=(.*)$", 1)), r'^"([^"]*)"$', "$1")
    return pair.select("path", "line", (F.length("text") - F.length(F.ltrim("text")) + 1).alias("column"), "section", key.alias("key"), value.alias("value"))


class CargoManifests:
    name, version, rank = "cargoToml", "1", 32

    def detect(self, corpus: Corpus) -> bool:
        return not corpus.files.where(F.col("path").rlike(CARGO_FILES)).select("path").limit(1).isEmpty()

    def extract(self, corpus: Corpus, graph: Found) -> Found:
        c = F.col
        files = corpus.files.where(c("path").rlike(CARGO_FILES))
        rows = toml_entries(files)
        named = rows.where("section = 'package' and key = 'name'").groupBy("path").agg(F.min(F.struct("line", "column", "value")).alias("p"))
        heads = files.select("path").join(named, "path", "left").select("path", F.coalesce("p.value", "path").alias("package"), F.coalesce("p.line", F.lit(1)).alias("line"), F.coalesce("p.column", F.lit(1)).alias("column"))
        head_key = F.concat(F.lit("cargo:"), "path", F.lit(":package:"), "package")
        base = F.regexp_replace("section", r":\d+$", "")
        rest = rows.withColumn("base", base).where(c("base").isin(*TOML_SECTIONS) | c("section").startswith("bin:")).join(heads.select("path", id_of(corpus, "configuration", head_key, c("path")).alias("package_id")), "path")
        key = F.concat(F.lit("cargo:"), "path", F.lit(":"), "section", F.lit(":"), "key")
        method = F.when(c("base") == "bin", "cargo_bin").when(c("base") == "features", "cargo_feature").otherwise("cargo_dependency")
        nodes = union(
            _file_nodes(files, corpus, self.name, self.rank),
            knowledge_rows(heads, corpus, self.name, self.rank, "configuration", F.concat(F.lit("cargo package "), "package"), head_key, "config", file=c("path"), start_line=c("line"), start_column=c("column"), literal=c("package"), method="cargo_package"),
            knowledge_rows(rest, corpus, self.name, self.rank, "configuration", F.concat_ws(" ", "base", "key"), key, "config", file=c("path"), start_line=c("line"), start_column=c("column"), literal=c("value"), method=method),
        )
        own = id_of(corpus, "configuration", key, c("path"))
        edges = union(
            edge_rows(heads, self.name, self.rank, "configures", file_id(corpus, c("path")), id_of(corpus, "configuration", head_key, c("path")), "exact", c("path"), c("line"), c("column"), "Cargo package", c("package"), "literal-toml", domain="knowledge"),
            edge_rows(rest, self.name, self.rank, F.when(c("base") == "bin", "exposes_api").otherwise("related_to"), c("package_id"), own, "exact", c("path"), c("line"), c("column"), c("base"), c("key"), "literal-toml", domain="knowledge"),
        )
        return Found(nodes, edges)


def settings(files: DataFrame) -> DataFrame:
    """(path, content, key, value): the settings that matter, however deep they are nested.

    An object's own key comes before those inside its values, and earlier values before later ones: so the key wins whose object opens
    first on the page. The scanner's brackets tell which object a key is in."""
    c = F.col
    rows = json_files(files, SETTINGS_FILES).where("doc is not null").select("path", "content")
    code = tokens(rows, "typescript").where("i is not null")
    after = lambda n, *columns: code.select("path", (c("i") - n).alias("i"), *[c(x).alias(f"v_{x}") for x in columns])
    name = F.expr("substring(text, 2, length(text) - 2)")
    keys = code.where("kind = 'string'").withColumn("key", name).where(c("key").isin(*SETTING_KEYS)).select("path", "i", "up", "key").join(after(1, "text").where("v_text = ':'").select("path", "i"), ["path", "i"])
    first = keys.groupBy("path", "key").agg(F.max_by("i", F.struct(-c("up"), "i")).alias("i"))
    # a negative sign is a token of its own
    value = first.join(after(2, "text", "start", "end", "partner"), ["path", "i"]).join(after(3, "end").withColumnRenamed("v_end", "next_end"), ["path", "i"], "left")
    ends = value.join(code.select("path", c("i").alias("v_partner"), c("end").alias("closed")), ["path", "v_partner"], "left")
    until = F.coalesce("closed", F.when(c("v_text") == "-", c("next_end")), c("v_end"))
    raw = ends.join(rows, "path").withColumn("v", F.try_parse_json(F.substring("content", c("v_start") + 1, until - c("v_start"))))
    return raw.select("path", "content", "key", F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string")).otherwise(F.to_json("v")).alias("value"))


class AppSettings:
    name, version, rank = "tauriConfig", "2", 33

    def detect(self, corpus: Corpus) -> bool:
        return not corpus.files.where(F.col("path").rlike(SETTINGS_FILES)).select("path").limit(1).isEmpty()

    def extract(self, corpus: Corpus, graph: Found) -> Found:
        c = F.col
        rows = json_files(corpus.files, SETTINGS_FILES)
        line, column = place_of(c("content"), F.concat(F.lit('"'), "key", F.lit('"')))
        facts = settings(corpus.files).withColumn("line", line).withColumn("column", column)
        kind = F.when(c("key").isin(*BOUNDARY_KEYS), "security_boundary").otherwise("configuration")
        key = F.concat(F.lit("tauri-config:"), "path", F.lit(":"), "key")
        method = F.when(c("key").isin(*BOUNDARY_KEYS), "tauri_security_config").otherwise("tauri_config_key")
        nodes = knowledge_rows(facts, corpus, self.name, self.rank, kind, F.concat(F.lit("tauri "), "key"), key, "config", file=c("path"), start_line=c("line"), start_column=c("column"), literal=c("value"), method=method)
        edges = edge_rows(facts, self.name, self.rank, "configures", file_id(corpus, c("path")), id_of(corpus, kind, key, c("path")), "exact", c("path"), c("line"), c("column"), "tauri config", c("key"), "literal-json-key", domain="knowledge")
        return Found(union(_file_nodes(rows.where("doc is not null"), corpus, self.name, self.rank), nodes), edges, invalid(rows, self.name, "invalid-tauri-config"))


class Capabilities:
    name, version, rank = "tauriCapability", "1", 34

    def detect(self, corpus: Corpus) -> bool:
        return not corpus.files.where(F.col("path").rlike(CAPABILITY_FILES)).select("path").limit(1).isEmpty()

    def extract(self, corpus: Corpus, graph: Found) -> Found:
        c = F.col
        rows = json_files(corpus.files, CAPABILITY_FILES)
        fallback = F.regexp_replace("path", r".*/|\.json$", "")
        fine = rows.where("doc is not null").withColumn("identifier", F.coalesce(string_at("$.identifier"), fallback))
        line, column = place_of(c("content"), F.lit('"identifier"'))
        heads = fine.withColumn("line", line).withColumn("column", column)
        head_key = F.concat(F.lit("tauri-capability:"), "path", F.lit(":"), "identifier")
        item = lambda v: F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.try_variant_get(v, "$.identifier", "string"))
        lists = union(*[fine.select("path", "content", "identifier", F.lit(f).alias("field"), F.explode(F.try_variant_get("doc", f"$.{f}", "array<variant>")).alias("v")) for f in ("permissions", "windows", "webviews")])
        items = lists.select("path", "content", "identifier", "field", item(c("v")).alias("item")).where("item is not null")
        line, column = place_of(c("content"), F.concat(F.lit('"'), "item", F.lit('"')))
        items = items.withColumn("line", line).withColumn("column", column)
        item_key = F.concat_ws(":", head_key, "field", "item")
        boundary = id_of(corpus, "security_boundary", head_key, c("path"))
        nodes = union(
            _file_nodes(fine, corpus, self.name, self.rank),
            knowledge_rows(heads, corpus, self.name, self.rank, "security_boundary", F.concat(F.lit("capability "), "identifier"), head_key, "config", file=c("path"), start_line=c("line"), start_column=c("column"), literal=F.to_json("doc"), method="tauri_capability_identifier"),
            knowledge_rows(items, corpus, self.name, self.rank, "configuration", F.concat_ws(" ", "field", "item"), item_key, "config", file=c("path"), start_line=c("line"), start_column=c("column"), literal=c("item"), method=F.concat(F.lit("tauri_capability_"), "field")),
        )
        edges = union(
            edge_rows(heads, self.name, self.rank, "configures", file_id(corpus, c("path")), boundary, "exact", c("path"), c("line"), c("column"), "capability identifier", c("identifier"), "literal-json-key", domain="knowledge"),
            edge_rows(items, self.name, self.rank, F.when(c("field") == "permissions", "contains").otherwise("related_to"), boundary, id_of(corpus, "configuration", item_key, c("path")), "exact", c("path"), c("line"), c("column"), F.concat(F.lit("capability "), "field"), c("item"), "literal-json-value", domain="knowledge"),
        )
        return Found(nodes, edges, invalid(rows, self.name, "invalid-tauri-capability"))
