"""TypeScript and JavaScript: declarations, imports, calls and type references, as patterns over tokens."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixpoint import fixpoint
from ..functions.lineage import sent, settled
from ..functions.text import package_of
from .base import TYPESCRIPT_FILES, Corpus, Found, diagnostic_rows, edge_rows, file_id, id_of, node_rows, union
from .code import in_context, resolve_imports, with_owner
from .lexer import tokens

ADAPTER, RANK = "typescript", 10
# Methods that say too little to be told apart, and words that are no calls.
LOW_VALUE = ("new", "get", "send", "clone", "insert", "update", "set", "map", "filter", "reduce", "forEach", "toString")
KEYWORDS = ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "import", "super", "constructor", "with", "of", "in", "else", "do", "case", "throw", "delete", "void", "yield", "async")
#: Words ahead of a declaration, and ahead of a member's name.
MODIFIERS = ("export", "default", "declare", "async", "abstract")
MEMBER_MODIFIERS = ("public", "private", "protected", "static", "readonly", "async", "override", "abstract", "declare", "*")
VARIABLES = ("const", "let", "var")
#: What stands right before a type.
BEFORE_TYPES = ("<", "|", "&", "as", "is", "keyof", "satisfies", "extends", "=>")
#: What stands at the head of a statement that declares, and what declarations read of a token.
STATED = ("function", "class", "interface", "type")
DECLARED = ("path", "i", "kind", "text", "line", "column", "depth", "stmt", "stop", "then", "p1", "p2", "p3", "t1", "t2", "t3", "k1", "then1", "then2", "line_2", "markup_2", "markup", "stmt_text", "stmt_line", "stmt_column", "stmt_markup", "last_line", "last_markup")
#: What all parts read of a token.
READ = (*DECLARED, "role", "up", "chain", "head", "head_line", "head_column", "opens", "angle", "k2", "k3", "p_role", "p_kind", "p_line", "p_column", "up_text", "up_role", "open_then", "stmt_next")


def _leads() -> Column:
    """Whether a statement begins here, or only modifiers stand before it."""
    at = F.col("i") - F.col("stmt")
    before = [F.coalesce(F.col(f"p{n}").isin(*MODIFIERS), F.lit(False)) for n in (1, 2, 3)]
    return (at == 0) | ((at == 1) & before[0]) | ((at == 2) & before[0] & before[1]) | ((at == 3) & before[0] & before[1] & before[2])


def declares(token: dict, code: list[dict]) -> bool:
    """Whether declarations may need a token: they are looked for in variables at the top of a file, at words that head them, and at members."""
    if token["kind"] == "word" and (token["text"] in STATED or "opens" in token and token["up"] >= 0 and code[token["up"]]["role"] in ("class", "object")):
        return True
    if token["depth"]:
        return False
    head = token["stmt"]
    return code[head]["text"] in VARIABLES or code[head]["text"] == "export" and head + 1 < len(code) and code[head + 1]["text"] in VARIABLES


def says(token: dict, code: list[dict]) -> bool:
    """Whether any part may need a token: also those of imports and exports, names that these list, calls, and words at a type."""
    up, i = token["up"], token["i"]
    if token["depth"] == 0 or code[up]["role"] == "names":
        return True
    return token["kind"] == "word" and ("opens" in token or token["text"] in ("extends", *STATED) or code[i - 1]["text"] in ("new", ":", ",", "=", *BEFORE_TYPES) or i + 1 < len(code) and code[i + 1]["text"] in (":", "?", "="))


def declaring(files: DataFrame) -> DataFrame:
    """The tokens that declarations need."""
    return tokens(files, "typescript", declares, (*DECLARED, "opens", "p_kind", "up_role", "open_then", "stmt_next"))


def prepared(toks: DataFrame) -> DataFrame:
    """Code tokens, stored."""
    return settled(in_context(toks))


def _stated() -> Column:
    """Words that declare a function, class, interface or type by a statement."""
    c = F.col
    fits = F.when(c("text") == "function", F.lit(True)).when(c("text") == "type", (c("depth") == 0) & c("t2").isin("=", "<")).otherwise((c("depth") == 0) | (c("text") == "class"))
    named = _named()
    return (c("kind") == "word") & c("text").isin(*STATED) & _leads() & fits & named.rlike(r"^[A-Za-z_$\u0080-￿]") & ~named.isin("extends", "implements")


def _named() -> Column:
    return F.when((F.col("text") == "function") & (F.col("t1") == "*"), F.col("t2")).otherwise(F.col("t1"))


def _among_variables() -> Column:
    """Tokens of a statement at the top of a file that declares variables."""
    c = F.col
    return (c("depth") == 0) & F.when(c("stmt_text") == "export", c("stmt_next")).otherwise(c("stmt_text")).isin(*VARIABLES)


def _member() -> Column:
    """Names of methods of classes and of objects."""
    c = F.col
    ahead = c("i") - c("stmt")
    modified = (ahead == 0) | c("p1").isin(*MEMBER_MODIFIERS) | ((c("p1") == ")") & (c("stmt_text") == "@")) | ((c("p_kind") == "word") & (c("p2") == "@"))
    whole = F.coalesce(c("open_then") == "{", F.lit(False))
    fits = whole | ((c("up_role") == "class") & F.coalesce(c("open_then").isin(";", "}"), F.lit(True)) & (c("text") != "constructor"))
    return (c("kind") == "word") & c("opens").isNotNull() & ~c("text").isin(*KEYWORDS) & c("up_role").isin("class", "object") & modified & fits


def declarations(toks: DataFrame) -> DataFrame:
    """path, i, to (first and last token), line, end, column, kind, name, class, arrow, exported, default, async, jsx, name_i; arrow and function expressions count as functions.

    One pass over the tokens keeps those that declare something; all else is done with these."""
    c = F.col
    yes = lambda condition: F.coalesce(condition, F.lit(False))
    flags = {"_stated": yes(_stated()), "_variables": yes(_among_variables()), "_member": yes(_member())}
    few = toks.where("i is not null").withColumns(flags).where("_stated or _variables or _member")
    code = settled(few.select(*DECLARED, *flags))
    word = c("kind") == "word"
    begin = [c("stmt_line").alias("line"), c("stmt_column").alias("column"), c("stmt_markup").alias("markup"), c("last_line").alias("end"), c("last_markup").alias("markup_end")]
    name_i = c("i") + F.when((c("text") == "function") & (c("t1") == "*"), 2).otherwise(1)
    kinds = F.when(c("text") == "type", "type_alias").otherwise(c("text"))
    plain = code.where("_stated").select("path", c("stmt").alias("i"), c("stop").alias("to"), kinds.alias("kind"), _named().alias("name"), name_i.alias("name_i"), "depth", F.lit(False).alias("arrow"), F.array("p1", "p2", "p3").alias("before"), *begin)
    # variables at the top of a file that hold a function
    top = code.where("_variables").withColumn("exports", c("stmt_text") == "export")
    declares = word & (c("p1").isin(*VARIABLES) | (c("p1") == ","))
    so_far = W.partitionBy("path", "stmt").orderBy("i")
    held = top.withColumn("told", F.last(F.when(declares, F.struct("i", "text", "line", "column", "markup")), ignorenulls=True).over(so_far)).withColumn("at", c("told.i"))
    arrow = (c("then1") == "=>") | ((c("t1") == "async") & (c("then2") == "=>")) | ((c("k1") == "word") & (c("t2") == "=>")) | ((c("t1") == "async") & (c("t3") == "=>")) | ((c("t1") == "<") & c("generic"))
    expression = (c("t1") == "function") | ((c("t1") == "async") & (c("t2") == "function"))
    held = held.withColumn("generic", F.coalesce(F.max((c("text") == "(") & (c("then") == "=>")).over(W.partitionBy("path", "stmt")), F.lit(False)))
    following = held.where(declares).select("path", "stmt", "at", (F.lead("i").over(so_far) - 2).alias("until"), F.lead("line_2").over(so_far).alias("until_line"), F.lead("markup_2").over(so_far).alias("until_markup"))
    given = held.where("text = '=' and at is not null").withColumn("nth", F.row_number().over(W.partitionBy("path", "stmt", "at").orderBy("i"))).where("nth = 1").where(yes(arrow) | yes(expression))
    asynchronous = F.when(c("t1") == "async", "async")
    placed_at = [c("told.line").alias("line"), c("told.column").alias("column"), c("told.markup").alias("markup"), F.coalesce("until_line", "last_line").alias("end"), F.coalesce("until_markup", "last_markup").alias("markup_end")]
    variables = given.join(following, ["path", "stmt", "at"]).select("path", c("at").alias("i"), F.coalesce("until", "stop").alias("to"), F.lit("function").alias("kind"), c("told.text").alias("name"), c("at").alias("name_i"), F.lit(0).alias("depth"), (~yes(expression)).alias("arrow"), F.array(F.when(c("exports"), "export"), asynchronous).alias("before"), *placed_at)
    methods = code.where("_member").select("path", c("stmt").alias("i"), c("stop").alias("to"), F.lit("method").alias("kind"), c("text").alias("name"), c("i").alias("name_i"), "depth", F.lit(False).alias("arrow"), F.array("p1", "p2", "p3").alias("before"), *begin)
    every = settled(union(plain, variables, methods))
    classes = every.where("kind = 'class'").select("path", c("i").alias("name_i"), "to", c("name").alias("class"))
    owned = with_owner(every, classes, "around", "name_i", "to").withColumn("class", F.when(c("kind") != "class", c("around.class"))).drop("around")
    placed = owned.where("kind <> 'class' or depth = 0")
    mark = lambda m: F.array_contains(F.filter("before", lambda x: x.isNotNull()), m)
    full = F.concat("path", F.lit("::"), F.when(c("class").isNotNull() & (c("kind") != "class"), F.concat("class", F.lit("."))).otherwise(""), "name")
    return placed.select("path", "i", "to", "line", "end", "column", "kind", "name", "class", "arrow", mark("export").alias("exported"), mark("default").alias("default"), mark("async").alias("async"), ((c("markup_end") > c("markup")) & c("path").rlike(r"\.(?:tsx|jsx|js)$")).alias("jsx"), "name_i", full.alias("qualified_name"))


def imports(toks: DataFrame, files: DataFrame) -> DataFrame:
    """path, stmt, line, column, word (import or export), specifier, target of every import and re-export that names a module; of several specifiers the first.

    Tokens are read once and few of them move: heads of statements and strings."""
    c = F.col
    head = F.coalesce((c("i") == c("stmt")) & (c("depth") == 0) & c("text").isin("import", "export"), F.lit(False))
    ahead = ("from", "import")
    text = F.coalesce((c("kind") == "string") & (c("depth") == 0), F.lit(False))
    code = toks.where("i is not null").where(head | text)
    opens = F.when(head, F.struct("line", "column", c("text").alias("word")))
    named = F.when(text & c("p1").isin(*ahead), F.expr("substring(text, 2, length(text) - 2)"))
    rows = code.groupBy("path", "stmt").agg(F.max(opens).alias("h"), F.min_by(named, F.when(named.isNotNull(), c("i"))).alias("specifier")).where("h is not null and specifier is not null")
    return resolve_imports(settled(rows.select("path", "stmt", "h.line", "h.column", "h.word", "specifier")), files)


def names_of(toks: DataFrame) -> DataFrame:
    """path, stmt, word, original, alias of every name that an import or export statement lists: default for a default one, * for all."""
    c = F.col
    code = in_context(toks)
    top = code.where("depth = 0 and stmt_text in ('import', 'export')").withColumn("word", c("stmt_text"))
    is_name = c("kind") == "word"
    default = top.where((c("word") == "import") & is_name & c("p1").isin("import", "type") & (c("text") != "type") & c("t1").isin(",", "from")).select("path", "stmt", "word", F.lit("default").alias("original"), c("text").alias("alias"))
    star = top.where("text = '*'").select("path", "stmt", "word", F.lit("*").alias("original"), F.when(c("t1") == "as", c("t2")).otherwise(F.when(c("word") == "export", F.lit("*"))).alias("alias")).where("alias is not null")
    given = top.where("word = 'export' and text = 'default' and k1 = 'word' and t1 not in ('function', 'class', 'async', 'abstract', 'new', 'interface') and (t2 is null or t2 in (';', 'export', 'const', 'function', 'import', 'let', 'class', 'type', 'interface') or i + 1 = stop)").select("path", "stmt", "word", c("t1").alias("original"), F.lit("default").alias("alias"))
    braces = top.where("text = '{' and role = 'names'").select("path", c("i").alias("up"), c("stmt").alias("of"), "word")
    listed = code.where("up_role = 'names'").where(is_name | (c("kind") == "string")).select("path", "up", "stmt", "i", "text").join(braces, ["path", "up"]).groupBy("path", "of", "word", "stmt").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]).alias("w"))
    size = F.size("w")
    typed = (c("w")[0] == "type") & (size > 1) & ((size == 2) | (c("w")[1] != "as"))
    inner = listed.withColumn("w", F.when(typed, F.slice("w", F.lit(2), size - 1)).otherwise(c("w")))
    names = inner.select("path", c("of").alias("stmt"), "word", c("w")[0].alias("original"), F.element_at("w", -1).alias("alias"))
    return union(default, star, given, names)


def bindings(toks: DataFrame, taken: DataFrame) -> DataFrame:
    """path, alias, original, target of every name that an import of a file binds; original is default or * for such imports."""
    rows = names_of(toks).where("word = 'import'").join(taken.where("target is not null").select("path", "stmt", "target"), ["path", "stmt"])
    return rows.select("path", "alias", "original", "target")


def exports(toks: DataFrame, taken: DataFrame, declared: DataFrame, bound: DataFrame) -> DataFrame:
    """path, name, id, kind: what a module gives away, of its own, under other names, and from other modules through any chain of re-exports.

    What a module names itself stands before what a star brings; modules that re-export each other end, as nothing new comes."""
    c = F.col
    outer = declared.where("kind <> 'method'")
    own = union(outer.where("exported and not default").select("path", "name", "id", "kind"), outer.where("exported and default").select("path", F.lit("default").alias("name"), "id", "kind"))
    listed = names_of(toks).where("word = 'export'").join(taken.select("path", "stmt", "target", "specifier"), ["path", "stmt"], "left")
    here = listed.where("specifier is null")
    local = here.join(outer.select("path", c("name").alias("original"), "id", "kind"), ["path", "original"]).select("path", c("alias").alias("name"), "id", "kind")
    # a name that was imported and is given on is a re-export
    passed = here.select("path", "original", c("alias").alias("name")).join(bound.where("original <> '*'").select("path", c("alias").alias("original"), c("original").alias("there"), "target"), ["path", "original"]).select("path", "name", "there", "target")
    links = settled(passed.unionByName(listed.where("target is not null and original <> '*'").select("path", c("alias").alias("name"), c("original").alias("there"), "target")))
    stars = settled(listed.where("target is not null and original = '*' and alias = '*'").select("path", "target").distinct())
    # of interest where a module has a star only
    named = settled(union(own.select("path", "name"), local.select("path", "name"), links.select("path", "name")).join(stars.select("path").distinct(), "path", "left_semi").distinct())

    links, stars, named = sent(links), sent(stars), sent(named)

    def given(new: DataFrame) -> DataFrame:
        there = new.select(c("path").alias("target"), c("name").alias("there"), "id", "kind")
        by_name = links.join(there, ["target", "there"]).select("path", "name", "id", "kind")
        by_star = stars.join(there, "target").where("there <> 'default'").select("path", c("there").alias("name"), "id", "kind").join(named, ["path", "name"], "left_anti")
        return by_name.unionByName(by_star)

    # only modules at either end of a re-export can get or give rows; all others keep their own
    ends = settled(union(links.select("path"), links.select(c("target").alias("path")), stars.select("path"), stars.select(c("target").alias("path"))).distinct())
    seed = union(own, local).distinct()
    if ends.isEmpty():
        return seed
    ends = sent(ends)
    return seed.join(ends, "path", "left_anti").unionByName(fixpoint(seed.join(ends, "path", "left_semi"), given))


def named_in_scope(declared: DataFrame, bound: DataFrame, exported: DataFrame) -> DataFrame:
    """path, name, id, kind: declarations that a file's code can name plainly: its own ones, and those it imports."""
    own = declared.where("kind <> 'method'").select("path", "name", "id", "kind")
    wanted = bound.select("target", "original").distinct()
    there = exported.select(F.col("path").alias("target"), F.col("name").alias("original"), "id", "kind").join(sent(settled(wanted)), ["target", "original"], "left_semi")
    brought = bound.join(sent(settled(there)), ["target", "original"])
    return own.unionByName(brought.select("path", F.col("alias").alias("name"), "id", "kind")).distinct()


def typed_names(toks: DataFrame, declared: DataFrame) -> DataFrame:
    """path, owner_id, class, name, i, type: names whose type stands with them: parameters and variables, `name = new Type()`, and fields of a class (owner_id null)."""
    c = F.col
    code = in_context(toks)
    annotation = (c("kind") == "word") & (c("t1") == ":") & (c("k2") == "word") & F.coalesce(c("t3").isin(",", ")", "=", ";", "}") | (c("k3") == "word"), F.lit(True))
    optional = (c("kind") == "word") & (c("t1") == "?") & (c("t2") == ":") & (c("k3") == "word")
    made = (c("kind") == "word") & (c("t1") == "=") & (c("t2") == "new") & (c("k3") == "word") & ~F.coalesce(c("p1").isin(":", "."), F.lit(False))
    kind = F.when(annotation, c("t2")).when(optional | made, c("t3"))
    rows = code.where(annotation | optional | made).where("coalesce(up_role, 'block') <> 'object'").select("path", "i", "text", kind.alias("type"), "p1", "up_role")
    placed = with_owner(rows, declared.select("path", "i", "to", "id", "class", "kind", "name"), "owner", "i", "to")
    field = (c("up_role") == "class") | c("p1").isin("private", "public", "protected", "readonly")
    inside = F.when(c("owner.kind") == "class", c("owner.name")).otherwise(c("owner.class"))
    return placed.select("path", F.when(~field, c("owner.id")).alias("owner_id"), F.when(field, inside).alias("class"), c("text").alias("name"), "i", "type")


def resolved_calls(calls: DataFrame, declared: DataFrame, bound: DataFrame, exported: DataFrame, scope: DataFrame, typed: DataFrame, parents: DataFrame) -> DataFrame:
    """calls with id and candidates: the one declaration that a call can mean (else null), and how many there are.

    Plain names meet declarations in scope, this.x the methods of the class around and of the classes it extends, X.y the methods of a
    class or the exports of a module in scope, v.y and this.f.y those of the type given to a variable or field. Each way is an equi-join by file and name."""
    c = F.col
    rows = settled(calls.withColumn("call", F.monotonically_increasing_id()).withColumn("parts", F.split("callee", r"\.")))
    plain = rows.where(F.size("parts") == 1).select("call", "path", c("callee").alias("name")).join(scope.where("kind in ('function', 'class')"), ["path", "name"]).select("call", "id")
    # (class_id, name, id, far): methods of a class, its own and inherited ones
    classes = declared.where("kind = 'class'").select("path", c("name").alias("class"), c("id").alias("class_id"))
    own_methods = declared.where("kind = 'method'").join(classes, ["path", "class"]).select("class_id", "name", "id")
    up = fixpoint(classes.select("class_id", c("class_id").alias("over"), F.lit(0).alias("far")), lambda new: new.withColumnRenamed("over", "sub").join(parents.select(c("class_id").alias("sub"), "over"), "sub").select("class_id", "over", (c("far") + 1).alias("far")), ["class_id", "over"])
    inherited = up.join(own_methods.withColumnRenamed("class_id", "over"), "over").groupBy("class_id", "name").agg(F.min(F.struct("far", "id")).alias("m")).select("class_id", "name", c("m.id").alias("id"))
    pair = rows.where((F.size("parts") == 2) & (c("parts")[0] != "")).select("call", "path", "i", c("parts")[0].alias("first"), c("parts")[1].alias("name"), "class", "owner_id")
    own = pair.where("first = 'this'").join(classes, ["path", "class"]).select("call", "class_id", "name")
    known = scope.where("kind = 'class'").select("path", c("name").alias("first"), c("id").alias("class_id"))
    static = pair.join(known, ["path", "first"]).select("call", "class_id", "name")
    # the latest type given to the name before the call, in the function around or at the top of the file
    types = typed.where("class is null").select("path", c("name").alias("first"), c("owner_id").alias("given_in"), c("i").alias("given_at"), "type")
    met = pair.join(types, ["path", "first"]).where("given_at <= i and (given_in is null or given_in = owner_id)")
    latest = met.groupBy("call", "path", "name").agg(F.max_by("type", F.struct(c("given_in").isNotNull(), "given_at")).alias("first"))
    fields = rows.where((F.size("parts") == 3) & (c("parts")[0] == "this")).select("call", "path", "class", c("parts")[1].alias("field"), c("parts")[2].alias("name")).join(typed.where("class is not null").select("path", "class", c("name").alias("field"), c("type").alias("first")), ["path", "class", "field"])
    by_type = latest.select("call", "path", "name", "first").unionByName(fields.select("call", "path", "name", "first")).join(known, ["path", "first"]).select("call", "class_id", "name")
    by_class = union(own, static, by_type).join(inherited, ["class_id", "name"]).select("call", "id")
    modules = bound.where("original = '*'").select("path", c("alias").alias("first"), c("target").alias("at"))
    spaces = pair.join(modules, ["path", "first"]).select("call", "name", c("at").alias("path")).join(exported.where("kind in ('function', 'class')").select("path", "name", "id"), ["path", "name"]).select("call", "id")
    hit = union(plain, by_class, spaces).groupBy("call").agg(F.count_distinct("id").alias("n"), F.min("id").alias("one"))
    return rows.join(hit, "call", "left").withColumn("candidates", F.coalesce("n", F.lit(0))).withColumn("id", F.when(c("n") == 1, c("one"))).drop("n", "one", "call", "parts")


def calls_of(toks: DataFrame, declared: DataFrame) -> DataFrame:
    """path, i, line, column, callee: calls and constructions; names of declarations and of members are none."""
    c = F.col
    code = in_context(toks)
    made = c("p1") == "new"
    said = code.where((c("kind") == "word") & (c("opens").isNotNull() | F.coalesce(made & (c("t1") != "."), F.lit(False))) & ~F.split(F.col("chain"), r"[.(\[]")[0].isin(*KEYWORDS) & ~c("text").isin("function", "class"))
    said = said.where(~F.coalesce(c("p1") == "function", F.lit(False)) & ~F.coalesce((c("p1") == "*") & (c("p2") == "function"), F.lit(False)) & ~F.coalesce(c("chain").contains(".") & c("text").isin("constructor"), F.lit(False)))
    signature = F.coalesce(c("up_role").isin("interface", "type"), F.lit(False)) | (F.coalesce(c("up_role").isin("class", "object"), F.lit(False)) & F.coalesce(c("open_then") == "{", F.lit(False)))
    inside = said.where(~signature).join(declared.where("kind in ('method', 'function')").select("path", c("name_i").alias("i")), ["path", "i"], "left_anti")
    start = F.coalesce(made & (c("head") == c("i")), F.lit(False))
    return inside.select("path", "i", F.when(start, c("p_line")).otherwise(c("head_line")).alias("line"), F.when(start, c("p_column")).otherwise(c("head_column")).alias("column"), c("chain").alias("callee"))


def type_references(toks: DataFrame) -> DataFrame:
    """path, i, line, column, name: words in the place of a type."""
    c = F.col
    code = in_context(toks)
    in_list = (c("p1") == ",") & c("t1").isin(",", ">") & ~c("up_text").eqNullSafe("{")
    inherits = (c("p1") == "extends") & F.coalesce(c("p3").isin("class", "interface"), F.lit(False))
    there = ((c("p1") == ":") & (c("p_role") == "annotation")) | (c("p1").isin(*BEFORE_TYPES) & ~inherits) | in_list | ((c("p1") == "=") & (c("stmt_text") == "type"))
    # the token before tells most words apart without a look at what is around them
    rows = code.where("kind = 'word'").where(c("p1").isin(":", ",", "=", *BEFORE_TYPES))
    return rows.where(F.coalesce(there, F.lit(False))).select("path", "i", "line", "column", c("text").alias("name"))


class Reading:
    """What TypeScript code says, each part made when it is asked for: declarations need no calls, types no imports of packages.

    With partly, only declarations are wanted, so tokens are not stored for the other parts."""

    def __init__(self, corpus: Corpus, partly: bool = False):
        self.corpus, self.files, self.partly = corpus, corpus.files.where(F.col("path").rlike(TYPESCRIPT_FILES)), partly

    @cached_property
    def toks(self) -> DataFrame:
        return declaring(self.files) if self.partly else settled(tokens(self.files, "typescript", says, READ))

    @cached_property
    def declared(self) -> DataFrame:
        c = F.col
        return settled(declarations(self.toks).withColumn("id", id_of(self.corpus, c("kind"), c("qualified_name"), c("path"), "typescript", place())))

    @cached_property
    def taken(self) -> DataFrame:
        return settled(imports(self.toks, self.files))

    @cached_property
    def bound(self) -> DataFrame:
        return settled(bindings(self.toks, self.taken))

    @cached_property
    def exported(self) -> DataFrame:
        return settled(exports(self.toks, self.taken, self.declared, self.bound))

    @cached_property
    def scope(self) -> DataFrame:
        return settled(named_in_scope(self.declared, self.bound, self.exported))

    @cached_property
    def ranges(self) -> DataFrame:
        return self.declared.select("path", "i", "to", "id", "class", "name", "kind")

    @cached_property
    def calls(self) -> DataFrame:
        """Calls with their source and the one declaration that each can mean (id, else null)."""
        c = F.col
        # classes and what they extend
        extends = self.toks.where("text = 'extends' and kind = 'word' and angle = 0 and k1 = 'word'").select("path", c("stmt").alias("i"), c("t1").alias("name"))
        over = self.declared.where("kind = 'class'").select("path", "i", c("id").alias("class_id")).join(extends, ["path", "i"])
        parents = settled(over.join(self.scope.where("kind = 'class'").select("path", "name", c("id").alias("over")), ["path", "name"]).select("class_id", "over").where("class_id <> over").distinct())
        said = with_owner(calls_of(self.toks, self.declared), self.ranges, "owner", "i", "to")
        said = said.withColumn("owner_id", c("owner.id")).withColumn("class", F.when(c("owner.kind") == "class", c("owner.name")).otherwise(c("owner.class")))
        return settled(resolved_calls(said, self.declared, self.bound, self.exported, self.scope, typed_names(self.toks, self.declared), parents).withColumn("source", F.coalesce("owner_id", file_id(self.corpus, c("path")))))

    @cached_property
    def unknown(self) -> DataFrame:
        c = F.col
        member = c("callee").contains(".")
        last = F.element_at(F.split("callee", r"\."), -1)
        scope_name = F.when(member & last.isin(*LOW_VALUE), "<common-method>").otherwise(c("callee"))
        return self.calls.where("id is null").withColumn("scope_name", scope_name).withColumn("category", F.when(member, "method").otherwise("call")).withColumn("key", F.concat(F.lit("call:"), "source", F.lit(":"), "category", F.lit(":"), "scope_name"))

    def file_nodes(self) -> DataFrame:
        c = F.col
        return node_rows(self.files, self.corpus, ADAPTER, RANK, "file", F.element_at(F.split("path", "/"), -1), c("path"), language="typescript", file=c("path"))

    def declared_nodes(self) -> DataFrame:
        c = F.col
        facts = F.to_json(F.struct("async", "exported", "arrow", c("jsx").alias("jsxCandidate")))
        return node_rows(self.declared, self.corpus, ADAPTER, RANK, c("kind"), c("name"), c("qualified_name"), language="typescript", file=c("path"), start_line=c("line"), start_column=c("column"), end_line=c("end"), metadata=facts, discriminator=place())

    def unknown_nodes(self) -> DataFrame:
        c = F.col
        first = self.unknown.groupBy("path", "key", "scope_name", "source", "category").agg(F.min(F.struct("line", "column")).alias("p"), F.max("candidates").alias("candidates"), F.max(c("scope_name") != c("callee")).alias("aggregated"))
        facts = F.to_json(F.struct(c("category"), c("candidates").alias("candidateCount"), c("source").alias("scopedOwner"), "aggregated"))
        return node_rows(first, self.corpus, ADAPTER, RANK, "unresolved_symbol", c("scope_name"), c("key"), language="typescript", file=c("path"), start_line=c("p.line"), start_column=c("p.column"), metadata=facts)

    def contains_edges(self) -> DataFrame:
        c = F.col
        return edge_rows(self.declared, ADAPTER, RANK, "contains", file_id(self.corpus, c("path")), c("id"), "exact", c("path"), c("line"), c("column"))

    def import_parts(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Nodes, edges and diagnostics of imports."""
        c, corpus, taken = F.col, self.corpus, self.taken
        away = (~c("specifier").startswith(".")) & c("target").isNull()
        package = package_of(c("specifier"))
        lost = c("target").isNull() & c("specifier").startswith(".")
        packages = node_rows(taken.where(away).select(package.alias("p")).distinct(), corpus, ADAPTER, RANK, "external_package", c("p"), c("p"), language="typescript")
        missing = node_rows(taken.where(lost).select("path", "specifier").distinct(), corpus, ADAPTER, RANK, "unresolved_symbol", c("specifier"), F.concat(F.lit("import:"), "specifier"), language="typescript", file=c("path"), metadata='{"category":"import"}')
        target = F.when(c("target").isNotNull(), file_id(corpus, c("target"))).when(away, id_of(corpus, "external_package", package, None, "typescript")).otherwise(id_of(corpus, "unresolved_symbol", F.concat(F.lit("import:"), "specifier"), c("path"), "typescript"))
        edges = edge_rows(taken, ADAPTER, RANK, "imports", file_id(corpus, c("path")), target, F.when(lost, "unresolved").otherwise("resolved"), c("path"), c("line"), c("column"), None, c("specifier"), F.when(c("target").isNotNull(), "module-file").otherwise(F.when(lost, "unresolved").otherwise("resolved")))
        misses = diagnostic_rows(taken.where(lost), ADAPTER, "unresolved-import", "warning", F.concat(F.lit("Unable to resolve import "), "specifier"), c("path"), c("line"))
        return union(packages, missing), edges, misses

    def call_edges(self, resolved: bool = True) -> DataFrame:
        c = F.col
        if resolved:
            return edge_rows(self.calls.where("id is not null"), ADAPTER, RANK, "calls", c("source"), c("id"), "resolved", c("path"), c("line"), c("column"), "CallExpression", c("callee"), "name-in-scope")
        return edge_rows(self.unknown, ADAPTER, RANK, "calls", c("source"), id_of(self.corpus, "unresolved_symbol", c("key"), c("path"), "typescript"), "unresolved", c("path"), c("line"), c("column"), "CallExpression", c("callee"), F.when(c("candidates") > 0, "ambiguous-name").otherwise("unresolved-name"))

    def type_edges(self) -> DataFrame:
        c = F.col
        types = self.scope.where("kind in ('interface', 'type_alias', 'class')").select("path", "name", c("id").alias("type_id"))
        used = with_owner(type_references(self.toks).join(types, ["path", "name"]), self.ranges, "owner", "i", "to").withColumn("source", F.coalesce("owner.id", file_id(self.corpus, c("path"))))
        return edge_rows(used.where("source <> type_id"), ADAPTER, RANK, "uses_type", c("source"), c("type_id"), "resolved", c("path"), c("line"), c("column"), "TypeReference", c("name"), "name-in-scope")


def place() -> Column:
    return F.concat_ws(":", F.col("line").cast("string"), F.col("column").cast("string"))


class TypeScript:
    name, version = ADAPTER, "2"

    def detect(self, corpus: Corpus) -> bool:
        return not corpus.files.where(F.col("path").rlike(TYPESCRIPT_FILES)).select("path").limit(1).isEmpty()

    def extract(self, corpus: Corpus, graph: Found) -> Found:
        r = Reading(corpus)
        import_nodes, import_edges, misses = r.import_parts()
        told = diagnostic_rows(r.unknown.where(~F.col("callee").contains(".")), ADAPTER, "unresolved-function-call", "info", F.concat(F.lit("No single declaration for call "), "callee"), F.col("path"), F.col("line"))
        return Found(union(r.file_nodes(), r.declared_nodes(), import_nodes, r.unknown_nodes()), union(r.contains_edges(), import_edges, r.call_edges(), r.call_edges(False), r.type_edges()), union(misses, told))
