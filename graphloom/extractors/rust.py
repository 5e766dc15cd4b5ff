"""Rust: items, use bindings, module paths, and calls resolved by path, import, module, name and receiver type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixpoint import fixpoint
from ..functions.lineage import settled
from .base import RUST_FILES, Corpus, Found, diagnostic_rows, edge_rows, file_id, id_of, matches, node_rows, union
from .code import calls_in, code_lines, in_context, swept, with_owner
from .lexer import tokens

ADAPTER, RANK = "rust", 11
# Methods that say too little to be told apart, and words that are no calls.
LOW_VALUE = ("new", "get", "send", "clone", "insert", "update", "default", "expect", "unwrap", "map", "collect", "into", "from")
KEYWORDS = ("if", "for", "while", "match", "return", "fn", "let", "mut", "in", "loop", "move", "async", "await", "where", "impl", "pub", "use", "as", "unsafe", "else", "dyn", "ref", "Some", "Ok", "Err", "crate(")
NAME = r"[A-Za-z_][A-Za-z0-9_]*"
IMPL = r"^impl\s*(?:<.*?>\s*(?=[A-Za-z_&:(\[*!']))?(?:(.+?)\s+for\s+)?(.+?)\s*(?:\bwhere\b.*)?$"
CALL = rf"(?<![A-Za-z0-9_.:!])((?:(?:{NAME}|\))(?:::<[^<>]*>)?(?:::|\.))*{NAME})\s*(?:::<[^()]*?>)?\("


def module_of(path: Column) -> Column:
    """The module path that a file stands for: below the last src, without lib, main and mod."""
    parts = F.split(F.regexp_replace(path, r"^(?:.*/)?src/", ""), "/")
    last = F.regexp_replace(F.element_at(parts, -1), r"\.rs$", "")
    above = F.slice(parts, 1, F.size(parts) - 1)
    return F.when(last.isin("lib", "main", "mod"), above).otherwise(F.concat(above, F.array(last)))


def plain_type(text: Column) -> Column:
    """A type's last name, without references, generics and brackets."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"&(?:\s*'[A-Za-z_][A-Za-z0-9_]*)?\s*(?:mut\s+)?", ""), r"(?s)<.*>", ""), r"[()\s]", "")
    return F.element_at(F.split(bare, "::"), -1)


def absolute(parts: Column, module: Column) -> Column:
    """A path as seen from a module: crate, self and any number of super are worked out."""
    ups = F.size(parts) - F.size(F.filter(parts, lambda p: p != "super"))
    rest = F.slice(parts, ups + 1, F.greatest(F.size(parts) - ups, F.lit(0)))
    above = F.slice(module, 1, F.greatest(F.size(module) - ups, F.lit(0)))
    return F.when(parts[0] == "crate", F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).when(parts[0] == "self", F.concat(module, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))))).otherwise(F.concat(above, rest))


def key(parts: Column) -> Column:
    return F.array_join(parts, "::")


def modules(toks: DataFrame) -> DataFrame:
    """path, i, to, line, end, name of modules with a body in the file."""
    return in_context(toks).where("text = 'mod' and kind = 'word' and k1 = 'word' and t2 = '{'").select("path", "i", F.col("stop").alias("to"), "line", F.col("stop_line").alias("end"), F.col("t1").alias("name"))


def with_module(places: DataFrame, inline: DataFrame, at: str = "line", to: str = "end", strictly: bool = False) -> DataFrame:
    """places with module: the file's module path and the modules around the place in it, from the outermost.

    A sweep over sorted places: the modules that are open at a place, by their starts, are its path."""
    def around(open_: list[tuple[int, int, int, int]], place: int) -> list[int]:
        open_[:] = [r for r in open_ if r[2] >= place]
        return [r[3] for r in sorted(open_, key=lambda r: (r[1], -r[2]))]

    found = swept(places, inline.select("path", "name", at, to), at, to, "_inner", T.ArrayType(T.StringType()), around, strictly)
    return found.withColumn("module", F.concat(module_of(F.col("path")), "_inner")).drop("_inner")


def attributes(lines: DataFrame) -> DataFrame:
    """(path, line, attributes): for the line that follows a run of attribute lines, those without their brackets and the line of each."""
    marks = lines.where(F.col("text").rlike(r"^\s*#\s*\["))
    run = F.col("line") - F.row_number().over(W.partitionBy("path").orderBy("line"))
    rows = marks.withColumn("run", run)
    inside = F.trim(F.regexp_replace(F.trim("text"), r"^#\s*\[\s*|\s*\].*$", ""))
    listed = rows.groupBy("path", "run").agg(F.max("line").alias("last"), F.array_sort(F.collect_list(F.struct(F.col("line").alias("at"), inside.alias("name")))).alias("attributes"))
    return listed.select("path", (F.col("last") + 1).alias("line"), "attributes")


def items(toks: DataFrame, lines: DataFrame) -> DataFrame:
    """path, i, to, line, end, column, kind, name, owner_type, trait_owner, module, attributes of functions, methods, types, traits and modules."""
    c = F.col
    code = settled(in_context(toks))
    word = c("kind") == "word"
    # the header of an impl block: the texts up to its brace
    blocks = code.where(word & (c("text") == "impl") & ((c("i") == c("stmt")) | F.coalesce(c("p1").isin("unsafe", "]", "default"), F.lit(False)))).select("path", "stmt", "depth", c("i").alias("from"), "stop", "line", "stop_line")
    braces = code.where("text = '{'").join(blocks.select("path", "stmt", "depth"), ["path", "stmt", "depth"]).groupBy("path", "stmt").agg(F.min("i").alias("brace"))
    heads = code.select("path", "stmt", "i", "text").join(blocks.join(braces, ["path", "stmt"]).select("path", "stmt", "from", "brace"), ["path", "stmt"]).where("i >= from and i < brace")
    spelled = heads.groupBy("path", "stmt", "from").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " ").alias("head"))
    of = F.regexp_extract("head", IMPL, 1)
    impls = blocks.join(spelled, ["path", "stmt", "from"]).select("path", c("from").alias("i"), c("stop").alias("to"), F.when(of != "", F.regexp_replace(of, r"\s+", "")).alias("of"), plain_type(F.regexp_extract("head", IMPL, 2)).alias("type"))
    traits = code.where(word & (c("text") == "trait") & (c("k1") == "word")).select("path", "i", c("stop").alias("to"), c("t1").alias("of"), F.lit(None).cast("string").alias("type"))
    owners = impls.unionByName(traits)
    found = code.where(word & c("text").isin("fn", "struct", "enum", "trait", "mod") & (c("k1") == "word") & ~F.coalesce(c("p1").isin(".", "::"), F.lit(False)))
    kind = F.when(c("text") == "fn", "function").when(c("text") == "mod", "module").otherwise(c("text"))
    first = toks.where("i is not null").groupBy("path", "line").agg(F.min("column").alias("column"))
    ranged = found.select("path", "i", c("stop").alias("to"), "line", c("stop_line").alias("end"), kind.alias("kind"), c("t1").alias("name")).join(first, ["path", "line"])
    placed = with_module(with_owner(ranged, owners, "owner", "i", "to"), modules(toks), "i", "to", strictly=True)
    inner = (c("kind") == "function") & c("owner").isNotNull()
    known = placed.join(attributes(lines), ["path", "line"], "left")
    return known.select("path", "i", "to", "line", "end", "column", F.when(inner, "method").otherwise(c("kind")).alias("kind"), "name", F.when(inner, c("owner.type")).alias("owner_type"), F.when(inner, c("owner.of")).alias("trait_owner"), "module", "attributes").withColumn("qualified_name", F.concat("path", F.lit("::"), F.when(c("owner_type").isNotNull(), F.concat("owner_type", F.lit("."))).otherwise(""), "name"))


def module_count(found: DataFrame) -> DataFrame:
    """One row: the different module paths of items()."""
    return found.agg(F.count_distinct(key(F.col("module"))).alias("modules"))


def _leaves(texts: Column) -> Column:
    """The paths that a use tree spells: a fold over its tokens with the prefixes of the lists that are open; no depth is too deep."""
    state = F.struct(F.array().cast("array<string>").alias("open"), F.lit("").alias("path"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        before = F.coalesce(F.try_element_at(s["open"], F.lit(-1)), F.lit(""))
        ended = F.when(s["path"] != before, F.concat(s["out"], F.array(s["path"]))).otherwise(s["out"])
        less = F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0)))
        make = lambda open_, path, out: F.struct(open_.alias("open"), path.alias("path"), out.alias("out"))
        grown = F.concat(s["path"], F.when(t == "as", " as ").otherwise(t))
        return F.when(t == "{", make(F.concat(s["open"], F.array(s["path"])), s["path"], s["out"])).when(t == ",", make(s["open"], before, ended)).when(t == "}", make(less, F.coalesce(F.try_element_at(less, F.lit(-1)), F.lit("")), ended)).otherwise(make(s["open"], grown, s["out"]))

    return F.aggregate(texts, state, step, lambda s: F.when(s["path"] != "", F.concat(s["out"], F.array(s["path"]))).otherwise(s["out"]))


def use_bindings(toks: DataFrame, functions: DataFrame, at: str = "i", to: str = "to") -> DataFrame:
    """module, alias, absolute path (array), wildcard, owner_id (of a use inside a function). functions: path, at, to, id, ..."""
    code = in_context(toks)
    heads = code.where("text = 'use' and kind = 'word' and (i = stmt or p1 in ('pub', ')', ']'))").select("path", "stmt", F.col("i").alias("from"), F.col("stop").alias("last"), "line")
    # the statement's tokens and those of the lists in it follow each other, so a running maximum of heads tells which use a token is part of
    w = W.partitionBy("path").orderBy("i")
    marked = code.join(heads.select("path", F.col("from").alias("i"), F.col("from"), "last", F.col("line").alias("use_line")), ["path", "i"], "left")
    spread = marked.select("path", "i", "text", *[F.last(x, ignorenulls=True).over(w).alias(x) for x in ("from", "last", "use_line")])
    inside = spread.where("i > from and i <= last and text <> ';'")
    rows = inside.groupBy("path", "from", "use_line").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]).alias("t"))
    rows = rows.select("path", F.col("from").alias("i"), F.col("use_line").alias("line"), F.explode(_leaves(F.col("t"))).alias("tree"))
    parts = F.filter(F.split(F.regexp_replace("tree", r"\s+as\s+.*$", ""), "::"), lambda p: p != "")
    named = F.trim(F.regexp_extract("tree", r"\s+as\s+(\S+)\s*$", 1))
    last = F.element_at(parts, -1)
    wild = last == "*"
    own = F.filter(parts, lambda p: p != "*")
    inner = with_owner(with_module(rows, modules(toks), "i", "to"), functions, "owner", at, to)
    # a list's own self is the module that the list is of
    whole = F.when((last == "self") & (F.size(parts) > 1), F.slice(parts, 1, F.size(parts) - 1)).otherwise(own)
    return inner.select("module", F.when(named != "", named).when(wild, "*").otherwise(F.element_at(whole, -1)).alias("alias"), absolute(whole, F.col("module")).alias("target"), wild.alias("wildcard"), F.col("owner.id").alias("owner_id")).distinct()


def followed(bindings: DataFrame, functions: DataFrame) -> DataFrame:
    """(module, alias, owner_id, id): functions that an import means, through re-exports (imports without an owner) of any length."""
    named = bindings.where("not wildcard").select(key(F.col("module")).alias("module"), "alias", "owner_id", "target")
    there = key(F.slice("target", 1, F.greatest(F.size("target") - 1, F.lit(0))))
    seed = named.select("module", "alias", F.coalesce("owner_id", F.lit("")).alias("owner"), key(F.col("target")).alias("at"), there.alias("there"), F.element_at("target", -1).alias("name"))
    passed = named.where("owner_id is null").select(F.col("module").alias("there"), F.col("alias").alias("name"), F.col("target").alias("next")).distinct()
    # what a wildcard brings is given on under its own name
    wild = bindings.where("wildcard and owner_id is null").select(key(F.col("module")).alias("there"), F.col("target").alias("base")).distinct()
    columns = seed.columns

    def step(new: DataFrame) -> DataFrame:
        open_ = new.join(functions.select("at"), "at", "left_anti")
        by_name = open_.join(passed, ["there", "name"]).select("module", "alias", "owner", key(F.col("next")).alias("at"), key(F.slice("next", 1, F.greatest(F.size("next") - 1, F.lit(0)))).alias("there"), F.element_at("next", -1).alias("name"))
        by_wild = open_.join(wild, "there").select("module", "alias", "owner", key(F.concat("base", F.array("name"))).alias("at"), key(F.col("base")).alias("there"), "name")
        return by_name.unionByName(by_wild).select(*columns)

    reached = fixpoint(settled(seed), step, ["module", "alias", "owner", "at"])
    return reached.join(functions.select("at", "id"), "at").select("module", "alias", F.when(F.col("owner") != "", F.col("owner")).alias("owner_id"), "id").distinct()


def receiver_types(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """(id, name, line, type): types that a function's parameters and let statements give to names, by line."""
    c = F.col
    bodies = functions.select("path", "line", "end", "id")
    inside = with_owner(lines, bodies).where("owner is not null").select("path", "line", "bare", c("owner.id").alias("id"), c("owner.line").alias("start"))
    signature = lines.join(functions.select("path", "line", "id"), ["path", "line"]).select("id", "line", F.regexp_extract("bare", r"fn\s+[^(]*\((.*)$", 1).alias("list"))
    parameters = matches(signature, "list", rf"(?:^|,|\()\s*(?:mut\s+)?({NAME})\s*:\s*([^,]+?)\s*(?=,|\)|$)", "name", "type").select("id", "name", "line", "type")
    lets = inside.select("id", "line", F.regexp_extract("bare", rf"\blet\s+(?:mut\s+)?({NAME})", 1).alias("name"), F.regexp_extract("bare", rf"\blet\s+(?:mut\s+)?{NAME}\s*:\s*([^=;]+)", 1).alias("given"), F.regexp_extract("bare", rf"=\s*(?:{NAME}::)*?({NAME})(?:::<[^>]*>)?::{NAME}\s*\(", 1).alias("made")).where("name <> ''")
    typed = lets.select("id", "name", "line", F.when(c("given") != "", c("given")).when(c("made") != "", c("made")).alias("type")).where("type is not null")
    return parameters.unionByName(typed)


class Rust:
    name, version = ADAPTER, "2"

    def detect(self, corpus: Corpus) -> bool:
        return not corpus.files.where(F.col("path").rlike(RUST_FILES)).select("path").limit(1).isEmpty()

    def extract(self, corpus: Corpus, graph: Found) -> Found:
        c = F.col
        files = corpus.files.where(c("path").rlike(RUST_FILES))
        toks = settled(in_context(tokens(files, "rust")))
        lines = settled(code_lines(files, "rust"))
        inline = modules(toks)
        place = F.concat_ws(":", c("line").cast("string"), c("column").cast("string"))
        found = settled(items(toks, lines).withColumn("id", id_of(corpus, c("kind"), c("qualified_name"), c("path"), "rust", place)))
        facts = F.to_json(F.struct(F.transform("attributes", lambda a: a["name"]).alias("attributes"), F.transform("attributes", lambda a: a["at"]).alias("attributeLines"), c("module").alias("modulePath"), c("owner_type").alias("ownerType"), c("trait_owner").alias("traitOwner")))
        macros = matches(lines, "bare", rf"\b({NAME})!\s*[(\[{{]", "macro").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "macro"))).alias("macros"))
        with_macros = files.select("path").join(macros, "path", "left").withColumn("module", module_of(c("path")))
        nodes = [
            node_rows(with_macros, corpus, ADAPTER, RANK, "file", F.element_at(F.split("path", "/"), -1), c("path"), language="rust", file=c("path"), metadata=F.to_json(F.struct(c("module").alias("modulePath"), "macros"))),
            node_rows(found, corpus, ADAPTER, RANK, c("kind"), c("name"), c("qualified_name"), language="rust", file=c("path"), start_line=c("line"), start_column=c("column"), end_line=c("end"), metadata=facts, discriminator=place),
        ]
        contains = edge_rows(found, ADAPTER, RANK, "contains", file_id(corpus, c("path")), c("id"), "exact", c("path"), c("line"), c("column"))
        open_brackets = c("text").isin("(", "[", "{", ")", "]", "}") & (c("kind") == "punct") & c("partner").isNull()
        broken = toks.where(open_brackets).select("path").distinct()
        recovered = diagnostic_rows(broken, ADAPTER, "rust-parser-error-node", "warning", F.concat(F.lit("Brackets do not close in "), "path"), c("path"))
        # what can be called
        functions = found.where("kind = 'function'").select(key(F.concat("module", F.array("name"))).alias("at"), "name", "id")
        methods = found.where("kind = 'method' and owner_type is not null and trait_owner is null").select(key(F.concat("module", F.array("owner_type", "name"))).alias("at"), "id")
        bodies = found.where("kind in ('function', 'method')").select("path", "i", "to", "line", "end", "id", "owner_type", "name", "module")
        bound = settled(use_bindings(toks, bodies))
        visible = bound.select(key(c("module")).alias("from"), "alias", "target", "wildcard", "owner_id")
        # calls
        said = with_owner(calls_in(lines.where(~c("bare").rlike(r"^\s*#!?\s*\[")), CALL, KEYWORDS), bodies.drop("i", "to"))
        said = said.join(found.select("path", "line", c("name").alias("callee")), ["path", "line", "callee"], "left_anti")
        outer = with_module(said, inline).withColumn("module", F.coalesce("owner.module", "module"))
        calls = settled(outer.withColumn("source", F.coalesce("owner.id", file_id(corpus, c("path")))).withColumn("owner_type", c("owner.owner_type")).withColumn("owner_id", c("owner.id")).drop("owner").withColumn("call", F.monotonically_increasing_id()))
        dotted = c("callee").contains(".")
        paths = calls.where(~dotted).withColumn("parts", F.split("callee", "::")).withColumn("from", key(c("module")))
        mine = lambda df: df.where("owner_id_ is null or owner_id_ = owner_id")  # noqa: E731  bindings inside a function are its own
        seen = visible.withColumnRenamed("owner_id", "owner_id_")
        # 0: Self::name; 1: a path; 2: imports and wildcards; 3: the same module; 4: one name in all
        several = paths.where(F.size("parts") > 1)
        own = several.where("parts[0] = 'Self' and owner_type is not null and size(parts) = 2").select("call", F.concat_ws("::", "from", "owner_type", c("parts")[1]).alias("at"), F.lit(0).alias("rank"))
        own = own.withColumn("at", F.regexp_replace("at", "^::", ""))
        prefixed = several.where("parts[0] <> 'Self'").withColumn("first", c("parts")[0])
        imported = mine(prefixed.join(seen.where("not wildcard").select("from", "owner_id_", c("alias").alias("first"), c("target").alias("prefix")), ["from", "first"])).select("call", F.concat("prefix", F.slice("parts", 2, F.size("parts") - 1)).alias("full"))
        plain = prefixed.join(imported.select("call").distinct(), "call", "left_anti").select("call", "parts", "module")
        rooted = c("parts")[0].isin("crate", "self", "super")
        by_path = union(
            imported.select("call", key(c("full")).alias("at")),
            plain.where(rooted).select("call", key(absolute(c("parts"), c("module"))).alias("at")),
            plain.where(~rooted).select("call", F.explode(F.array_distinct(F.array(key(F.concat("module", "parts")), key(c("parts"))))).alias("at")),
        ).withColumn("rank", F.lit(1))
        keyed = own.select("call", "at", "rank").unionByName(by_path).join(functions.select("at", "id").unionByName(methods), "at").select("call", "rank", "id")
        single = paths.where(F.size("parts") == 1)
        chased = followed(bound, functions).select(c("module").alias("from"), c("alias").alias("callee"), c("owner_id").alias("owner_id_"), "id")
        by_import = mine(single.join(chased, ["from", "callee"])).select("call", F.lit(2).alias("rank"), "id")
        wild = mine(single.join(seen.where("wildcard").select("from", "owner_id_", c("target").alias("prefix")), "from")).select("call", key(F.concat("prefix", F.array("callee"))).alias("at"))
        by_wild = wild.join(functions.select("at", "id"), "at").select("call", F.lit(2).alias("rank"), "id")
        by_module = single.select("call", key(F.concat("module", F.array("callee"))).alias("at")).join(functions.select("at", "id"), "at").select("call", F.lit(3).alias("rank"), "id")
        by_name = single.select("call", c("callee").alias("name")).join(functions.select("name", "id"), "name").select("call", F.lit(4).alias("rank"), "id")
        # receivers
        sent = calls.where(dotted).withColumn("receiver", F.regexp_extract("callee", r"^(.*)\.[^.]*$", 1)).withColumn("method", F.element_at(F.split("callee", r"\."), -1))
        typed = receiver_types(lines, bodies).select(c("id").alias("owner_id"), c("name").alias("receiver"), c("line").alias("given_at"), "type")
        latest = sent.join(typed, ["owner_id", "receiver"]).where(c("given_at") <= c("line")).groupBy("call").agg(F.max_by("type", "given_at").alias("type"))
        kinds = sent.join(latest, "call", "left").withColumn("type", F.when((c("receiver") == "self") & c("owner_type").isNotNull(), c("owner_type")).otherwise(plain_type(c("type")))).where("type is not null").withColumn("from", key(c("module")))
        type_imports = mine(kinds.join(seen.where("not wildcard").select("from", "owner_id_", c("alias").alias("type"), c("target").alias("at")), ["from", "type"])).select("call", F.concat(key(c("at")), F.lit("::"), "method").alias("at"))
        local = kinds.join(type_imports.select("call").distinct(), "call", "left_anti").select("call", key(F.concat("module", F.array("type", "method"))).alias("at"))
        by_type = type_imports.unionByName(local).join(methods, "at").select("call", F.lit(1).alias("rank"), "id")
        every = union(keyed, by_import, by_wild, by_module, by_name, by_type)
        best = every.groupBy("call").agg(F.min("rank").alias("rank"))
        hit = every.join(best, ["call", "rank"]).groupBy("call", "rank").agg(F.array_sort(F.collect_set("id")).alias("ids"))
        met = settled(calls.join(hit, "call", "left").withColumn("candidates", F.coalesce(F.size("ids"), F.lit(0))))
        one = met.where("candidates = 1")
        sure = F.when(c("rank") == 4, "probable").otherwise("resolved")
        how = F.when(dotted, "syntactic-receiver-type").when(c("rank") == 4, "unique-repository-name").when(c("callee").contains("::"), "repository-module-path").otherwise("module-or-import-binding")
        call_edges = edge_rows(one, ADAPTER, RANK, "calls", c("source"), c("ids")[0], sure, c("path"), c("line"), c("column"), "call_expression", c("callee"), how)
        last = F.element_at(F.split("callee", r"\."), -1)
        lost = met.where("candidates <> 1").withColumn("scope_name", F.when(dotted & last.isin(*LOW_VALUE), "<common-method>").otherwise(c("callee"))).withColumn("category", F.when(dotted, "method").otherwise("call")).withColumn("key", F.concat(F.lit("call:"), "source", F.lit(":"), "category", F.lit(":"), "scope_name"))
        first = lost.groupBy("path", "key", "scope_name", "source", "category").agg(F.min(F.struct("line", "column")).alias("p"), F.max("candidates").alias("candidates"), F.max(c("scope_name") != c("callee")).alias("aggregated"))
        facts = F.to_json(F.struct(c("category"), c("candidates").alias("candidateCount"), c("source").alias("scopedOwner"), "aggregated"))
        nodes.append(node_rows(first, corpus, ADAPTER, RANK, "unresolved_symbol", c("scope_name"), c("key"), language="rust", file=c("path"), start_line=c("p.line"), start_column=c("p.column"), metadata=facts))
        more = F.when(c("candidates") > 1, F.to_json(F.struct(c("ids").alias("candidateIds"))))
        lost_edges = edge_rows(lost, ADAPTER, RANK, "calls", c("source"), id_of(corpus, "unresolved_symbol", c("key"), c("path"), "rust"), "unresolved", c("path"), c("line"), c("column"), "call_expression", c("callee"), "unresolved-name", metadata=more)
        told = diagnostic_rows(lost, ADAPTER, F.when(dotted, "unresolved-method-call").otherwise("unresolved-function-call"), "info", F.concat(F.lit("No single item for Rust call "), "callee"), c("path"), c("line"))
        return Found(union(*nodes), union(contains, call_edges, lost_edges), union(recovered, told))
