"""Frameworks over code: components and what they render, commands and events between a frontend and a backend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import sent, settled
from .base import RUST_FILES, TYPESCRIPT_FILES, Corpus, Found, diagnostic_rows, edge_rows, file_id, id_of, matches, node_rows, union
from .code import code_lines, in_context, with_owner
from .lexer import MARKUP, tokens
from .rust import absolute, key, module_of, use_bindings

# Callback properties, calls across the bridge, the macro of handler lists, and patterns of event calls.
CALLBACK = "^on[A-Z][A-Za-z0-9_]*$"
LITERAL_CALLS = {"invoke": "invokes", "listen": "listens", "once": "listens", "emit": "emits"}
HANDLERS = "generate_handler"
EVENT_CALLS = [("emits", r"\.emit(?:_filter)?\s*\(\s*([^,\n)]+)"), ("emits", r"\.emit_to\s*\(\s*[^,\n)]+\s*,\s*([^,\n)]+)"), ("listens", r"\.listen(?:_global|_any)?\s*\(\s*([^,\n)]+)")]
MARKUP_FILES = rf"\.(?:{'|'.join(MARKUP)})$"
COMMAND_ATTRIBUTE = r"^tauri\s*::\s*command(?:\s*\(.*\))?$"


def _ranges(nodes: DataFrame, kinds: tuple[str, ...] = ("function", "method", "react_component"), language: str | None = None) -> DataFrame:
    rows = nodes.where(F.col("kind").isin(*kinds) & F.col("file").isNotNull() & F.col("end_line").isNotNull())
    rows = rows.where(F.col("language") == language) if language else rows
    return rows.select(F.col("file").alias("path"), F.col("start_line").alias("line"), F.col("end_line").alias("end"), "id", "name")


class Components:
    """Functions that look like components become components under the same id; markup and callback properties become edges."""

    name, version, rank = "react", "2", 20

    def detect(self, corpus: Corpus) -> bool:
        return not corpus.files.where(F.col("path").rlike(r"\.(?:tsx|jsx)$") | F.col("content").rlike(r"""from\s+["']react["']""")).select("path").limit(1).isEmpty()

    def extract(self, corpus: Corpus, graph: Found) -> Found:
        c = F.col
        lost, renders, passes, told = self.parts(corpus, graph.nodes)
        parts = self.looking_like(graph.nodes)
        refined = parts.withColumn("metadata", F.to_json(F.struct(c("kind").alias("originalKind"), c("adapter").alias("originalAdapter"), F.get_json_object("metadata", "$.jsxCandidate").alias("jsxCandidate")))).withColumn("kind", F.lit("react_component")).withColumn("adapter", F.lit(self.name)).withColumn("ord", F.concat(F.lit(f"{self.rank:02d}:"), "ord"))
        return Found(refined.unionByName(lost), renders.unionByName(passes), told)

    def callables(self, nodes: DataFrame) -> DataFrame:
        return nodes.where("language = 'typescript' and kind in ('function', 'method')")

    def looking_like(self, nodes: DataFrame) -> DataFrame:
        """Functions and methods that look like components."""
        return self.callables(nodes).where(F.col("name").rlike("^[A-Z]") | (F.get_json_object("metadata", "$.jsxCandidate") == "true"))

    def parts(self, corpus: Corpus, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Nodes of components that are nowhere, edges of what is shown and of callbacks, and what is told."""
        c = F.col
        callable_ = self.callables(nodes)
        parts = self.looking_like(nodes)
        # the scanner looks for markup in these files only, so no other has tags, properties or owners of them
        ranges = settled(_ranges(callable_).where(c("path").rlike(MARKUP_FILES)))
        code = settled(in_context(tokens(corpus.files.where(c("path").rlike(MARKUP_FILES)), "typescript")).select("path", "line", "column", "kind", "text", "t1", "t2", "t3", "t4", "k3"))
        # of all functions only those with a name that is asked for are counted
        asked = lambda rows, by: rows.join(sent(settled(by.select("name").distinct())), "name", "left_semi").groupBy("name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("one"))
        shown_tags = code.where((c("kind") == "jsx") & c("text").rlike("^[A-Z]"))
        tags = shown_tags.select("path", "line", "column", F.element_at(F.split("text", r"\."), -1).alias("name"))
        shown = settled(with_owner(tags, ranges).where("owner is not null").join(asked(parts, tags), "name", "left"))
        place = F.concat_ws(":", c("line").cast("string"), c("column").cast("string"))
        unknown = shown.where("coalesce(n, 0) <> 1")
        blank = id_of(corpus, "unresolved_symbol", F.concat(F.lit("jsx:"), "name"), c("path"), "typescript", place)
        lost = node_rows(unknown, corpus, self.name, self.rank, "unresolved_symbol", c("name"), F.concat(F.lit("jsx:"), "name"), language="typescript", file=c("path"), start_line=c("line"), start_column=c("column"), metadata=F.to_json(F.struct(F.lit("jsx-component").alias("category"), F.coalesce("n", F.lit(0)).alias("candidateCount"))), discriminator=place)
        renders = edge_rows(shown, self.name, self.rank, "renders", c("owner.id"), F.when(c("n") == 1, c("one")).otherwise(blank), F.when(c("n").isNull(), "unresolved").otherwise("probable"), c("path"), c("line"), c("column"), "jsx-element", c("name"), "component-name-heuristic")
        handed = code.where((c("kind") == "jsx_attr") & c("text").rlike(CALLBACK) & (c("t1") == "=") & (c("t2") == "{") & (c("k3") == "word") & (c("t4") == "}"))
        handed = handed.select("path", "line", "column", c("text").alias("prop"), c("t3").alias("name"))
        given = with_owner(handed, ranges).join(asked(callable_, handed), "name", "left").withColumnRenamed("name", "callback")
        fine = c("owner").isNotNull() & (F.coalesce("n", F.lit(0)) == 1)
        passes = edge_rows(given.where(fine), self.name, self.rank, "passes_callback", c("owner.id"), c("one"), "probable", c("path"), c("line"), c("column"), "jsx-attribute", c("callback"), "unique-function-name-heuristic", metadata=F.to_json(F.struct("prop")))
        told = diagnostic_rows(given.where(~fine), self.name, "unresolved-react-callback", "info", F.concat(F.lit("No single function for callback property "), "prop", F.lit("={"), "callback", F.lit("}")), c("path"), c("line"))
        return lost, renders, passes, told


def handler_tokens(toks: DataFrame) -> DataFrame:
    """(path, line, column, name): the last path segment of each entry of a handler list; toks are of Rust files."""
    lists = in_context(toks).where(F.col("text") == "[").where((F.col("p1") == "!") & (F.col("p2") == HANDLERS)).select("path", F.col("i").alias("up"))
    entries = toks.where("kind = 'word'").join(lists, ["path", "up"]).groupBy("path", "up", "stmt").agg(F.max_by(F.struct("line", "column", "text"), "i").alias("t"))
    return entries.select("path", "t.line", "t.column", F.col("t.text").alias("name"))


def constants_of(toks: DataFrame) -> DataFrame:
    """(path, line, name, value): constants and the text of what they are, from the tokens of Rust files."""
    c = F.col
    code = in_context(toks)
    heads = code.where("kind = 'word' and text = 'const' and k1 = 'word' and t1 <> 'fn'").select("path", "stmt", "depth", "line", c("t1").alias("name"), c("i").alias("from"))
    rest = toks.where("i is not null").select("path", "stmt", "depth", "i", "text").join(heads, ["path", "stmt", "depth"]).where("i > from")
    equal = rest.where("text = '='").groupBy("path", "stmt", "depth").agg(F.min("i").alias("equal"))
    value = rest.join(equal, ["path", "stmt", "depth"]).where("i > equal and text <> ';'")
    listed = value.groupBy("path", "line", "name", "from").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "").alias("value"))
    return listed.select("path", "line", "name", "value")


def literal(expression: Column) -> Column:
    """The inside of a string literal, else null."""
    text = F.trim(expression)
    raw = F.regexp_extract(text, r'^r#*"([\s\S]*?)"#*$', 1)
    return F.when(text.rlike(r'^"[^"]*"$'), F.substring(text, F.lit(2), F.length(text) - 2)).when(text.rlike(r'^r#*"[\s\S]*"#*$'), raw)


def event_names(said: DataFrame, toks: DataFrame, nodes: DataFrame) -> DataFrame:
    """said (call, path, line, owner_id, expression) with event: a literal, or what constants in scope lead to; else null. toks are of Rust files.

    Of several constants one in the same file and latest before the call wins (an as-of choice by file and name); two in
    other files leave it open. A chain of constants is followed to its end; a constant that a call has met already is none of its candidates, so circles end."""
    c = F.col
    ranges = _ranges(nodes, ("function", "method"), "rust")
    constants = with_owner(constants_of(toks), ranges)
    constants = settled(constants.select(key(F.concat(module_of(c("path")), F.array("name"))).alias("at"), c("path").alias("c_path"), c("line").alias("c_line"), c("owner.id").alias("c_owner"), "value"))
    bound = settled(use_bindings(toks, ranges, "line", "end").where("not wildcard and owner_id is null").select(key(c("module")).alias("from"), "alias", key(c("target")).alias("imported")))
    open_ = said.select("call", "path", "line", "owner_id", F.regexp_replace(F.trim("expression"), "^&", "").alias("expression"))
    done, seen = [], None
    while True:
        open_ = open_.withColumn("event", literal(c("expression")))
        done.append(open_.where("event is not null").select("call", "event"))
        asked = open_.where("event is null").withColumn("parts", F.filter(F.split("expression", "::"), lambda p: p != "")).where(F.size("parts") > 0).withColumn("module", module_of(c("path"))).withColumn("from", key(c("module")))
        single = F.size("parts") == 1
        own = asked.select("*", F.explode(F.array_distinct(F.when(single, F.array(key(F.concat("module", "parts")), key(c("parts")))).otherwise(F.array(key(absolute(c("parts"), c("module"))), key(c("parts")))))).alias("at"))
        brought = asked.where(single).withColumn("alias", c("parts")[0]).join(bound, ["from", "alias"]).withColumn("at", c("imported")).select(own.columns)
        met = own.unionByName(brought).join(constants, "at").where((c("c_path") != c("path")) | (c("c_line") < c("line"))).where("c_owner is null or c_owner = owner_id").dropDuplicates(["call", "c_path", "c_line"])
        met = met if seen is None else met.join(seen, ["call", "c_path", "c_line"], "left_anti")
        here = c("c_path") == c("path")
        best = met.groupBy("call").agg(F.max_by(F.struct("c_path", "c_line", "c_owner", "value"), F.struct(here, c("c_line"))).alias("k"), F.count_if(here).alias("near"), F.count("*").alias("n"))
        chosen = best.where("near > 0 or n = 1")
        open_ = settled(chosen.select("call", c("k.c_path").alias("path"), c("k.c_line").alias("line"), c("k.c_owner").alias("owner_id"), c("k.value").alias("expression")))
        if open_.isEmpty():
            break
        seen = union(seen, open_.select("call", c("path").alias("c_path"), c("line").alias("c_line")))
    return said.join(union(*done).dropDuplicates(["call"]), "call", "left")


class Bridge:
    """Commands and events between a TypeScript frontend and a Rust backend, and what is missing on either side."""

    name, version, rank = "tauri", "2", 21

    def detect(self, corpus: Corpus) -> bool:
        c = F.col
        imports = c("content").rlike(r"""\bfrom\s+["']@tauri-apps/api|\bimport\s*\(\s*["']@tauri-apps/api|\btauri::Builder\b|\buse\s+tauri::""")
        wanted = c("path").rlike(r"tauri\.conf\.(?:json|json5)$") | (c("path").rlike(r"Cargo\.toml$") & c("content").rlike(r"(?m)^\s*tauri(?:-build)?\s*=")) | (c("path").rlike(r"package\.json$") & c("content").rlike(r'"@tauri-apps/')) | imports
        return not corpus.files.where(wanted).select("path").limit(1).isEmpty()

    def extract(self, corpus: Corpus, graph: Found) -> Found:
        c = F.col
        own = lambda kind, name: id_of(corpus, kind, F.concat(F.lit(f"tauri:{kind}:"), name), None, "framework")
        extra = '{"framework":"tauri"}'
        row = lambda **more: F.to_json(F.struct(F.lit("tauri").alias("framework"), *[v.alias(k) for k, v in more.items()]))
        # definitions
        listed = F.from_json("metadata", "attributes array<string>, attributeLines array<int>")
        marked = graph.nodes.where("language = 'rust' and kind in ('function', 'method')").withColumn("m", listed).withColumn("at", F.array_position(F.transform("m.attributes", lambda a: a.rlike(COMMAND_ATTRIBUTE)), True)).where("at > 0")
        defined = marked.select(c("file").alias("path"), F.coalesce(F.try_element_at("m.attributeLines", c("at").cast("int")), c("start_line")).alias("line"), "name", "id")
        parts = [edge_rows(defined, self.name, self.rank, "invokes", own("framework_command", c("name")), c("id"), "exact", c("path"), c("line"), 1, "attribute_item", c("name"), "structured-rust-attribute", metadata=row(role=F.lit("command-definition")))]
        # the frontend's literal names
        code = in_context(tokens(corpus.files.where(c("path").rlike(TYPESCRIPT_FILES)), "typescript"))
        ranges = _ranges(graph.nodes)
        first = code.where("kind in ('string', 'template')").select("path", (c("i") - 1).alias("opens"), F.expr("substring(text, 2, length(text) - 2)").alias("name"), c("column").alias("at"), c("line").alias("at_line"), c("kind").alias("how"), c("t1").alias("after"))
        calls = code.where((c("kind") == "word") & c("text").isin(*LITERAL_CALLS) & c("opens").isNotNull()).select("path", "opens", "line", c("text").alias("word"))
        kind_of = F.create_map(*[F.lit(x) for pair in LITERAL_CALLS.items() for x in pair])
        said = calls.join(first.where("name <> '' and not (how = 'template' and after = '$')"), ["path", "opens"]).select("path", "line", "name", kind_of[c("word")].alias("kind"), F.when(c("at_line") == c("line"), c("at") + 1).otherwise(F.lit(1)).alias("column"))
        placed = with_owner(said, ranges).withColumn("owner_id", F.coalesce("owner.id", file_id(corpus, c("path"))))
        command, event = own("framework_command", c("name")), own("framework_event", c("name"))
        to_event = c("kind") == "emits"
        parts.append(edge_rows(placed.where("kind = 'invokes'"), self.name, self.rank, "invokes", c("owner_id"), command, "exact", c("path"), c("line"), c("column"), "invoke()", c("name"), "literal-command-name", metadata=F.lit(extra)))
        parts.append(edge_rows(placed.where("kind <> 'invokes'"), self.name, self.rank, c("kind"), F.when(to_event, c("owner_id")).otherwise(event), F.when(to_event, event).otherwise(c("owner_id")), "exact", c("path"), c("line"), c("column"), F.concat("kind", F.lit("()")), c("name"), "literal-event-name", metadata=F.lit(extra)))
        # registrations
        rust_files = corpus.files.where(c("path").rlike(RUST_FILES))
        rust_tokens = settled(in_context(tokens(rust_files, "rust")))
        registered = settled(handler_tokens(rust_tokens))
        parts.append(edge_rows(registered, self.name, self.rank, "registers", file_id(corpus, c("path")), command, "exact", c("path"), c("line"), c("column"), "generate_handler! handler", c("name"), "literal-handler-token", metadata=F.lit(extra)))
        # the backend's event expressions
        rust = code_lines(rust_files, "rust")
        raised = union(*[matches(rust, "text", p, "expression", at="at").withColumn("kind", F.lit(k)) for k, p in EVENT_CALLS])
        # a call inside a comment or string is none: there the bare line is blank
        raised = raised.where(F.substring("bare", c("at"), F.lit(2)) == F.substring("text", c("at"), F.lit(2))).withColumn("expression", F.trim("expression")).where("expression <> ''")
        # events belong to the function around them; outside of any there is none to own them
        raised = with_owner(raised, ranges).where("owner is not null").withColumn("owner_id", c("owner.id"))
        inside = F.instr(F.expr("substring(text, at)"), c("expression"))
        raised = settled(raised.select("path", "line", "kind", "expression", "owner_id", (c("at") + inside - 1).alias("column")).withColumn("call", F.monotonically_increasing_id()))
        named = event_names(raised, rust_tokens, graph.nodes)
        fine, open_ = named.where("event is not null").withColumn("name", c("event")), named.where("event is null")
        blank = id_of(corpus, "unresolved_symbol", F.concat(F.lit("tauri:event-expression:"), "path", F.lit(":"), "expression"), c("path"), "framework")
        how = F.when(literal(c("expression")).isNotNull(), "literal-event-name").otherwise("repository-string-constant")
        ends = lambda other: (F.when(to_event, c("owner_id")).otherwise(other), F.when(to_event, other).otherwise(c("owner_id")))
        parts.append(edge_rows(fine, self.name, self.rank, c("kind"), *ends(event), "probable", c("path"), c("line"), c("column"), F.concat(F.lit("Rust "), "kind"), c("expression"), how, metadata=row(eventExpression=c("expression"))))
        parts.append(edge_rows(open_, self.name, self.rank, c("kind"), *ends(blank), "unresolved", c("path"), c("line"), c("column"), F.concat(F.lit("Rust "), "kind"), c("expression"), "unresolved-event-expression", metadata=row(eventExpression=c("expression"))))
        # nodes
        commands = union(defined.select("name"), placed.where("kind = 'invokes'").select("name"), registered.select("name")).distinct()
        events = union(placed.where("kind <> 'invokes'").select("name"), fine.select("name")).distinct()
        make = lambda df, kind: node_rows(df, corpus, self.name, self.rank, kind, c("name"), F.concat(F.lit(f"tauri:{kind}:"), "name"), language="framework", framework="tauri", metadata=extra)
        lost = node_rows(open_.select("path", "expression").distinct(), corpus, self.name, self.rank, "unresolved_symbol", c("expression"), F.concat(F.lit("tauri:event-expression:"), "path", F.lit(":"), "expression"), language="framework", file=c("path"), metadata=row(category=F.lit("event-expression")))
        told = binding_diagnostics(self.name, defined, placed.where("kind = 'invokes'"), registered, union(placed.where("kind = 'emits'").select("name"), fine.where("kind = 'emits'").select("name")), union(placed.where("kind = 'listens'").select("name"), fine.where("kind = 'listens'").select("name")))
        return Found(union(make(commands, "framework_command"), make(events, "framework_event"), lost), union(*parts), told)


def binding_diagnostics(adapter: str, defined: DataFrame, invoked: DataFrame, registered: DataFrame, produced: DataFrame, consumed: DataFrame) -> DataFrame:
    """What one side of a binding has and the other lacks, by name: a group count and six anti-joins."""
    names = lambda df: df.select("name").distinct()
    without = lambda a, b: names(a).join(names(b), "name", "left_anti")
    say = lambda df, code, severity, before, after: diagnostic_rows(df, adapter, code, severity, F.concat(F.lit(before), "name", F.lit(after)))
    return union(
        say(defined.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "duplicate-tauri-command-name", "error", "Several backend commands are named ", ""),
        say(without(invoked, defined), "unmatched-tauri-invoke", "warning", "The frontend invokes ", ", for which no backend command was found"),
        say(without(defined, registered), "unregistered-tauri-command", "warning", "Backend command ", " is in no handler list that was found"),
        say(without(defined, invoked), "unused-tauri-command", "info", "Backend command ", " is invoked by no frontend code that was found"),
        say(without(registered, defined), "registered-tauri-command-missing-definition", "warning", "Handler ", " has no command definition that was found"),
        say(without(consumed, produced), "tauri-event-no-producer", "info", "Event ", " has consumers but no producer that was found"),
        say(without(produced, consumed), "tauri-event-no-consumer", "info", "Event ", " has producers but no consumer that was found"),
    )
