"""A scanner of source code: whole files become a table of tokens, with places, brackets and statements.

One pass over a file keeps a stack of modes (code, template, markup tag, markup text) and a stack of open brackets.
What a token means is left to joins and windows over the table; the scanner only tells strings, comments, templates,
regular expressions, markup and code apart, and closes what it opened. A file is one task's work, files spread over tasks.

Columns of tokens(): path; i, the place among the file's code tokens (null for comments and markup text); kind (word, number, string,
template, regex, char, lifetime, punct, jsx, jsx_end, jsx_attr, jsx_text, comment); text; start and end, character offsets from 0; line and
column from 1; depth, the brackets open around it; up, the innermost of them (-1: none); partner of a bracket; role of an opening
brace (block, object, type, class, interface, enum, namespace, names, template, jsx, else null), or of a colon (key, annotation, ternary,
case); stmt and stop, the first and last token of the statement, member or argument that it is part of, and stop_line; chain, of a word, the
expression it ends without what its brackets hold (a.b().c), head the first token of that and its place; opens, of a word, the round bracket after it and its type arguments;
then, of an opening round bracket, what follows its partner and a type after that.

Of code tokens also what stands around them, taken from the scan's own order, so that no pattern has to sort or join tokens again: p1 to p4 and t1 to t4, the texts of
the 4 before and after; k1 to k4 and then1 to then4, kind and then of those after; p_role, p_kind, p_line, p_column of the one before; up_text, up_role of up; open_then,
the then of opens; stmt_text, stmt_next, stmt_line, stmt_column of the statement's first token and the text after it; last_line, where its last token begins; line_2,
where the second token before begins; markup, the markup begun in the file so far, with stmt_markup, last_markup, markup_2 at those places; angle, the type arguments open in the statement.

Defined results: an unclosed string ends with its line, an unclosed comment, template or bracket (partner null) with the file;
a closing bracket without an opening one is punctuation; a null text is an empty one.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, i int, kind string, text string, start int, end int, line int, column int, depth int, up int, partner int, role string, stmt int, stop int, stop_line int, chain string, head int, head_line int, head_column int, opens int, then string"
#: Columns that are another token's: the column that says which one, how many tokens further, and what of it.
_NEIGHBOURS = {f"p{n}": ("i", -n, "text") for n in range(1, 5)} | {f"{a}{n}": ("i", n, c) for n in range(1, 5) for a, c in (("t", "text"), ("k", "kind"), ("then", "then"))} | {f"p_{c}": ("i", -1, c) for c in ("role", "kind", "line", "column")} | {"line_2": ("i", -2, "line"), "markup_2": ("i", -2, "markup")}
_NEIGHBOURS |= {"up_text": ("up", 0, "text"), "up_role": ("up", 0, "role"), "open_then": ("opens", 0, "then"), "stmt_next": ("stmt", 1, "text"), "last_line": ("stop", 0, "line"), "last_markup": ("stop", 0, "markup")} | {f"stmt_{c}": ("stmt", 0, c) for c in ("text", "line", "column", "markup")}
SCHEMA += ", markup int, angle int, " + ", ".join(f"{c} {'int' if of in ('line', 'column', 'markup') else 'string'}" for c, (_, _, of) in _NEIGHBOURS.items())
_FIELDS = [c.split() for c in SCHEMA.split(", ")]

_WORD = r"[#]?[A-Za-z_$\u0080-\U0010ffff][A-Za-z0-9_$\u0080-\U0010ffff]*"
_CODE = {
    "typescript": re.compile(
        rf"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*(?:.*?\*/|.*))|(?P<string>"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z))|(?P<number>\d(?:[eE][+-]|[\w.])*)|(?P<word>{_WORD})
        |(?P<punct>=>|\.\.\.|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|[=!]==?|\*\*=?|\+\+|--|[-+*/%&|^]=|<=|>=|.)""",
        re.DOTALL | re.VERBOSE,
    ),
    "rust": re.compile(
        r"""(?P<space>\s+)|(?P<comment>//[^\n]*)|(?P<string>(?:b|c|br|cr|r)?(?P<hashes>\#*)"(?:(?<=r")|(?<=\#"))?)|(?P<number>\d(?:[\w]|\.(?=\d))*)
        |(?P<char>b?'(?:\\(?:x[0-9A-Fa-f]{2}|u\{[^}]*\}|.)|[^'\\\n])')|(?P<lifetime>'[A-Za-z_][A-Za-z0-9_]*)|(?P<word>(?:r\#)?[A-Za-z_\u0080-\U0010ffff][A-Za-z0-9_\u0080-\U0010ffff]*)
        |(?P<punct>::|->|=>|\.\.=|\.\.\.|\.\.|&&|\|\||[=!]=|<=|[-+*/%&|^]=|.)""",
        re.DOTALL | re.VERBOSE,
    ),
}
_NESTED = re.compile(r"/\*|\*/")
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*", re.DOTALL)
_TAG = re.compile(r"<([A-Za-z_][\w.:-]*)|<(?=>)")
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_]\w*\s*(?:,|extends\b|=)")
_IN_TAG = re.compile(r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*(?:.*?\*/|.*))|(?P<jsx_attr>[A-Za-z_][\w:.-]*)|(?P<string>\"[^\"]*\"?|'[^']*'?)|(?P<punct>/>|.)", re.DOTALL)
_ALIAS = re.compile(r"type\s+[A-Za-z_$][\w$]*\s*[=<]")
_NAMED = re.compile(r"\w+\s+[\"'A-Za-z_$]")
_PAIRS = {")": "(", "]": "[", "}": "{"}
#: Words after which an operand follows, so that / opens a regular expression, < markup and { an object.
_OPERATORS = frozenset("return typeof instanceof in of new delete void throw case do else yield await default extends".split())
#: Words and marks that go on with a statement, and words that cannot end one.
_GO_ON = frozenset("else catch finally in instanceof as satisfies extends implements of from".split())
_NOT_LAST = _OPERATORS - {"return", "yield"} | frozenset("export async const let var import public private protected static readonly abstract declare override get set function class interface enum type".split())
_CONTAINERS = ("class", "interface", "enum", "namespace", "module")
_OPENING = (*_CONTAINERS, "type")
#: What may stand between a word and the bracket of its arguments.
_BEFORE_ARGUMENTS = ("(", "<", "?.", "::", "?", "!")
_WORDS, _LETTERS = re.compile(_WORD), frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_$")


class _Frame:
    """An open bracket (or the file): its token, what it holds, the statement under way, and what that waits for."""

    __slots__ = ("at", "role", "mark", "stmt", "last", "ternaries", "pending", "ended", "listed")

    def __init__(self, at: int, mark: str, role: str | None):
        self.at, self.mark, self.role, self.stmt, self.last, self.ternaries, self.pending, self.ended = at, mark, role, None, None, 0, None, False
        self.listed = mark in ("(", "[")


class _Scan:
    def __init__(self, text: str, language: str, markup: bool):
        self.text, self.language, self.markup = text, language, markup
        self.rows: list[dict] = []  # code tokens
        self.others: list[dict] = []  # comments and markup text
        self.frames = [_Frame(-1, "", "block")]
        self.modes: list[str] = ["code"]
        self.stmts: list[list[int]] = []  # [first, last]
        self.breaks = [*(m.start() for m in re.finditer("\n", text)), sys.maxsize]
        self.line = 0  # breaks ahead of the latest token

    def add(self, kind: str, start: int, end: int, text: str | None = None, role: str | None = None) -> dict:
        breaks, line, frame = self.breaks, self.line, self.frames[-1]
        while breaks[line] < start:  # tokens come in order
            line += 1
        self.line = line
        row = {"kind": kind, "text": self.text[start:end] if text is None else text, "start": start, "end": end, "line": line + 1, "column": start - (breaks[line - 1] if line else -1), "role": role, "depth": len(self.frames) - 1, "up": frame.at}
        if kind == "comment" or kind == "jsx_text":
            self.others.append(row)
            return row
        row["i"] = len(self.rows)
        self.place(row, frame)
        self.rows.append(row)
        return row

    def place(self, row: dict, frame: _Frame) -> None:
        """Put a token into its frame's statement, or let it open the next."""
        last, text = frame.last, row["text"]
        # on the line of the token before only a closed bracket can end a statement
        if frame.stmt is not None and (frame.ended or not frame.listed and ("closes" in last or row["line"] != last["line"]) and self.breaks_before(row, frame)):
            frame.stmt, frame.ended, frame.ternaries, frame.pending = None, False, 0, None
        if frame.stmt is None:
            frame.stmt = len(self.stmts)
            self.stmts.append([row["i"], row["i"]])
        row["stmt"] = frame.stmt
        self.stmts[frame.stmt][1] = row["i"]
        if text in (";", ",") and row["kind"] == "punct" and (text == ";" or (frame.mark in "([" and frame.mark or frame.role in ("object", "type", "enum", "names") or self.language == "rust" and frame.mark == "{")):
            frame.ended = True
        frame.last = row

    def breaks_before(self, row: dict, frame: _Frame) -> bool:
        last = frame.last
        if last is None or frame.mark in ("(", "[") or row["text"] in _GO_ON or row["text"] in _PAIRS:
            return False
        closed = last.get("closes")
        if closed is None and (row["line"] == last["line"] or self.language == "rust"):
            return False
        starts = row["kind"] in ("word", "string", "template", "number") or row["text"] in ("@", "#", "[", "*", "{", "&", "(", "!")
        if closed and closed["text"] == "{" and closed["role"] in ("block", *_CONTAINERS):
            head = self.rows[self.stmts[frame.stmt][0]]["text"]
            if self.language == "rust" or head not in ("const", "let", "var", "return") and self.assigned(frame):
                return starts and not (self.language == "rust" and head == "let")
        if self.language == "rust" or not starts or frame.role in ("object", "names", "enum"):
            return False
        if row["line"] == self.line_of(last) or row["text"] in ("(", "[", "*", "&", "!"):
            return False
        if row["text"] == "{" and (last["text"] == ")" or last["kind"] == "word"):
            return False
        ends = last["kind"] in ("number", "string", "template", "regex", "jsx_end") or last["text"] in (")", "]", "}", "++", "--", "!", ">") or last["kind"] == "word" and last["text"] not in _NOT_LAST
        return ends and not (last["text"] == ">" and row["kind"] != "word")

    def assigned(self, frame: _Frame) -> bool:
        """Whether the statement under way is no assignment, so that a closed block may end it."""
        return not any(self.rows[k]["text"] == "=" and self.rows[k]["up"] == frame.at for k in range(self.stmts[frame.stmt][0], min(self.stmts[frame.stmt][0] + 12, len(self.rows))))

    def line_of(self, row: dict) -> int:
        return bisect_right(self.breaks, row["end"] - 1) + 1

    def operand_before(self) -> bool:
        """Whether what came last is a value, so that an operator follows."""
        if not self.rows:
            return False
        last = self.rows[-1]
        if last["kind"] == "word":
            return last["text"] not in _OPERATORS
        return last["kind"] in ("number", "string", "template", "regex", "jsx_end", "char") or last["text"] in (")", "]", "}")

    def brace_role(self, frame: _Frame) -> str:
        last = self.rows[-1] if self.rows else None
        if frame.pending:
            role, frame.pending = frame.pending, None if frame.pending != "type" else "type"
            return {"module": "namespace"}.get(role, role)
        if self.language == "rust" or last is None:
            return "block"
        text = last["text"]
        if text == ":":
            return {"key": "object", "ternary": "object", "case": "block"}.get(last["role"], "type")
        if text in ("import", "export") or text == "type" and last["kind"] == "word":
            return "names"
        if text == "void" and len(self.rows) > 1 and self.rows[-2]["text"] in (":", "|", "=>"):
            return "block"
        if last["kind"] == "punct" and text in ("|", "&", "<") or text in ("as", "satisfies"):
            return "type"
        if last["kind"] == "punct" and text in ("=", "(", ",", "[", "?", "&&", "||", "??", "...", "!", "+") or text in _OPERATORS - {"do", "else", "extends"} or text in ("const", "let", "var"):
            return "names" if text == "," and self.rows[self.stmts[frame.stmt][0]]["text"] == "import" else "object"
        return "block"

    def colon_role(self, frame: _Frame) -> str:
        if frame.ternaries:
            frame.ternaries -= 1
            return "ternary"
        if frame.role == "object" and self.rows and self.rows[-1]["text"] != ")":
            return "key"
        if frame.stmt is not None and not frame.ended and self.rows[self.stmts[frame.stmt][0]]["text"] in ("case", "default") and frame.role == "block":
            return "case"
        return "annotation"

    def open(self, mark: str, start: int, role: str | None) -> None:
        row = self.add("punct", start, start + 1 if mark != "${" else start + 2, None, role)
        row["opener"] = True
        self.frames.append(_Frame(row["i"], mark[-1], role))

    def close(self, start: int) -> None:
        mark = self.text[start]
        deep = next((k for k in range(len(self.frames) - 1, 0, -1) if self.frames[k].mark == _PAIRS[mark]), 0)
        if not deep or any(f.role in ("template", "jsx") for f in self.frames[deep + 1 :]):
            self.add("punct", start, start + 1)
            return
        opener = self.rows[self.frames[deep].at]
        del self.frames[deep:]
        row = self.add("punct", start, start + 1)
        row["partner"], opener["partner"], row["closes"] = opener["i"], row["i"], opener
        if opener["role"] in ("template", "jsx"):
            self.modes.pop()

    def run(self) -> None:
        at, text, modes, n = 0, self.text, self.modes, len(self.text)
        step = {mode: getattr(self, mode) for mode in ("code", "template", "tag", "children")}
        while at < n:
            mode = modes[-1]
            if mode == "code" and text[at] in " \n":
                at += 1
            else:
                at = step[mode](at)

    def code(self, at: int) -> int:
        text, frame = self.text, self.frames[-1]
        c = text[at]
        if c in _LETTERS and self.language == "typescript":
            return self.word(_WORDS.match(text, at), frame)
        # marks that are always a token of one character
        if c in "([{":
            self.open(c, at, self.brace_role(frame) if c == "{" else None)
            return at + 1
        if c in ")]}":
            self.close(at)
            return at + 1
        if c in ";,":
            self.add("punct", at, at + 1)
            return at + 1
        if self.language == "typescript":
            if c == "`":
                self.modes.append("template")
                return self.template(at + 1, at)
            if c == "/" and text[at + 1 : at + 2] not in ("/", "*") and not self.operand_before() and (m := _REGEX.match(text, at)):
                self.add("regex", at, m.end())
                return m.end()
            if c == "<" and self.markup and not self.operand_before() and (m := _TAG.match(text, at)) and not _GENERIC.match(text, at):
                return self.tag_open(m)
        elif text.startswith("/*", at):
            depth, end = 0, at
            for m in _NESTED.finditer(text, at):
                depth += 1 if m[0] == "/*" else -1
                end = m.end()
                if not depth:
                    break
            end = end if not depth else len(text)
            self.add("comment", at, end)
            return end
        m = _CODE[self.language].match(text, at)
        kind, end = m.lastgroup, m.end()
        if kind == "hashes" or kind == "string" and self.language == "rust":
            end = self.rust_string(m)
            self.add("string", at, end)
            return end
        if kind == "space":
            return end
        if kind == "word":
            return self.word(m, frame)
        if kind != "punct":
            self.add(kind, at, end)
            return end
        if m[0] == ":" and self.language == "typescript":
            self.add("punct", at, end, None, self.colon_role(frame))
        else:
            if m[0] == "?" and not re.match(r"\?\s*[:,);=\]}]", text[at : at + 40]) and not (frame.role in ("class", "interface", "type") and text[at + 1 : at + 2] == "("):
                frame.ternaries += 1
            self.add("punct", at, end)
        return end

    def word(self, m: re.Match, frame: _Frame) -> int:
        word, at, end = m[0], m.start(), m.end()
        before = self.rows[-1]["text"] if self.rows else ""
        row = self.add("word", at, end, word)
        if word in _OPENING and self.language == "typescript" and before not in (".", "?.") and (word in _CONTAINERS and _NAMED.match(self.text, at) or word == "class" or word == "type" and _ALIAS.match(self.text, at)) and not (frame.role in ("object", "class") and word != "class"):
            frame.pending = word
        if before in (".", "?.", "::"):
            self.chain(row)
        else:
            row["chain"], row["head"], row["head_line"], row["head_column"] = word, row["i"], row["line"], row["column"]
        return end

    def rust_string(self, m: re.Match) -> int:
        text, hashes, raw = self.text, m["hashes"], "r" in m["string"].split('"')[0].split("#")[0]
        if raw:
            end = text.find('"' + hashes, m.end())
            return len(text) if end < 0 else end + 1 + len(hashes)
        body = re.compile(r'(?:\\.|[^"\\])*"?', re.DOTALL).match(text, m.end())
        return body.end()

    def chain(self, row: dict) -> None:
        rows, k = self.rows, row["i"]
        name, first = row["text"], row
        sep = rows[k - 1]["text"] if k else ""
        if k > 1 and sep in (".", "?.", "::") and rows[k - 1]["kind"] == "punct":
            j, tail = k - 2, ""
            while j >= 0:
                ahead = rows[j]
                if ahead["text"] == "!" and ahead["kind"] == "punct":
                    j -= 1
                elif "closes" in ahead and ahead["text"] in (")", "]"):
                    tail, first = ("()" if ahead["text"] == ")" else "[]") + tail, ahead["closes"]
                    j = first["i"] - 1
                else:
                    break
            before = rows[j] if j >= 0 and rows[j]["kind"] == "word" and rows[j]["text"] not in _OPERATORS else None
            first = rows[before["head"]] if before else first if tail else rows[k - 2]
            name = f"{before['chain'] if before else ''}{tail}{'::' if sep == '::' else '.'}{name}"
        row |= {"chain": name, "head": first["i"], "head_line": first["line"], "head_column": first["column"]}

    def template(self, at: int, start: int | None = None) -> int:
        end = _TEMPLATE.match(self.text, at).end()
        start = at if start is None else start
        if self.text.startswith("${", end):
            self.add("template", start, end)
            self.open("${", end, "template")
            self.modes.append("code")
            return end + 2
        end = min(end + 1, len(self.text))
        self.add("template", start, end)
        self.modes.pop()
        return end

    def tag_open(self, m: re.Match) -> int:
        self.add("jsx", m.start(), m.end(), m[1] or "")
        self.modes.append("tag" if m[1] else "children")
        return m.end() + (m[1] is None)

    def tag(self, at: int) -> int:
        m = _IN_TAG.match(self.text, at)
        kind, end = m.lastgroup, m.end()
        if kind == "space":
            return end
        if m[0] == "{":
            self.open("{", at, "jsx")
            self.modes.append("code")
        elif m[0] == "/>":
            self.modes.pop()
            self.add("jsx_end", at, end)
        elif m[0] == ">":
            self.modes[-1] = "children"
        else:
            self.add(kind, at, end)
        return end

    def children(self, at: int) -> int:
        text = self.text
        if text[at] == "{":
            self.open("{", at, "jsx")
            self.modes.append("code")
            return at + 1
        if text.startswith("</", at):
            end = text.find(">", at)
            end = len(text) if end < 0 else end + 1
            self.modes.pop()
            self.add("jsx_end", at, end)
            return end
        if text[at] == "<" and (m := _TAG.match(text, at)):
            return self.tag_open(m)
        end = min((k for k in (text.find("<", at + 1), text.find("{", at + 1)) if k >= 0), default=len(text))
        self.add("jsx_text", at, end)
        return end

    def finish(self) -> None:
        rows = self.rows
        stmts = [(first, last, self.line_of(rows[last])) for first, last in self.stmts]
        for row in rows:
            row["stmt"], row["stop"], row["stop_line"] = stmts[row["stmt"]]
        following = [*(r["text"] for r in rows[1:]), ""]
        for k, row in enumerate(rows):
            if row["kind"] == "word":
                if following[k] not in _BEFORE_ARGUMENTS:
                    continue
                j = k + 1
                if j < len(rows) and rows[j]["text"] == "?.":
                    j += 1
                if j < len(rows) and rows[j]["text"] == "::":
                    j += 1
                if j < len(rows) and rows[j]["text"] in ("?", "!") and rows[j]["end"] == row["end"] + 1 and self.language == "typescript":
                    j += 1
                if j < len(rows) and rows[j]["text"] == "<":
                    j = self.arguments(j)
                if 0 <= j < len(rows) and rows[j]["text"] == "(" and "opener" in rows[j]:
                    row["opens"] = j
            elif row.get("opener") and row["text"] == "(" and "partner" in row:
                row["then"] = self.follows(row["partner"])

    def arguments(self, k: int) -> int:
        """The token after a balanced list of type arguments that opens at k; -1 where it is a comparison."""
        depth, rows = 0, self.rows
        while k < len(rows):
            text = rows[k]["text"]
            if text == "<":
                depth += 1
            elif text == ">":
                depth -= 1
                if not depth:
                    return k + 1
            elif rows[k].get("opener"):
                if "partner" not in rows[k]:
                    return -1
                k = rows[k]["partner"]
            elif rows[k]["kind"] == "punct" and text not in (",", ".", "|", "&", "=", "=>", "?", ":", "::", "+", "->"):
                return -1
            k += 1
        return -1

    def follows(self, k: int) -> str | None:
        rows = self.rows
        level = rows[k]["up"]
        k += 1
        if k < len(rows) and rows[k]["text"] == ":" and rows[k]["role"] == "annotation" or k < len(rows) and rows[k]["text"] == "->":
            k += 1
            while k < len(rows) and rows[k]["up"] == level:
                if rows[k].get("opener"):
                    if rows[k]["text"] == "{" and rows[k]["role"] != "type":
                        return "{"
                    if "partner" not in rows[k]:
                        return None
                    k = rows[k]["partner"]
                elif rows[k]["text"] in ("=>", ";", ",", "="):
                    return rows[k]["text"]
                k += 1
            return None
        return rows[k]["text"] if k < len(rows) and rows[k]["up"] == level else None


def scan(text: str | None, language: str, markup: bool = False) -> list[dict]:
    """The tokens of one text as dicts of the table's columns, code first, then comments and markup text."""
    code, others = _scanned(text, language, markup)
    return code + others


def _scanned(text: str | None, language: str, markup: bool) -> tuple[list[dict], list[dict]]:
    s = _Scan(text or "", language, markup)
    s.run()
    s.finish()
    return s.rows, s.others


#: Endings of files that may hold markup.
MARKUP = ("tsx", "jsx", "js")
_MARKUP = tuple(f".{x}" for x in MARKUP)
#: Characters of source that a task scans, and tokens that go out of a worker at a time.
TASK_CHARS, BATCH = 1_000_000, 20_000


def spread(files: DataFrame) -> DataFrame:
    """files(path, content) over as many tasks as their characters are work for. (Source compresses well, so by its stored size it would be a few tasks' work.)"""
    files = files.select("path", F.coalesce("content", F.lit("")).alias("content"))
    chars = files.agg(F.sum(F.length("content"))).first()[0] or 0
    return files.repartition(-(-chars // TASK_CHARS) or 1, "path")


def _sums(code: list[dict]) -> None:
    """Give each token the markup begun so far in its file, and the type arguments open in its statement."""
    markup, angles = 0, {}
    for r in code:
        markup += r["kind"] == "jsx"
        r["markup"] = markup
        if r["text"] in ("<", ">"):
            angles[r["stmt"]] = angles.get(r["stmt"], 0) + (1 if r["text"] == "<" else -1)
        r["angle"] = angles.get(r["stmt"], 0) if angles else 0


def tokens(files: DataFrame, language: str, wanted: Callable[[dict, list[dict]], bool] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The tokens of files(path, content); of these columns only, and only those that are wanted(token, the file's code tokens), which come without comments.

    What a pattern needs is made where the file is scanned, so that few tokens leave the worker and none has to meet its neighbours again."""
    fields = [f for f in _FIELDS if columns is None or f[0] in columns]
    arrow = pa.schema([(n, pa.int32() if t == "int" else pa.string()) for n, t in fields])
    names = [n for n, _ in fields if n != "path"]
    sums = any(n == "angle" or "markup" in n for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[str, list] = {n: [] for n, _ in fields}

        def out(n: int) -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(lists[f.name][:n], f.type) for f in arrow], schema=arrow)
            for values in lists.values():
                del values[:n]
            return made

        for batch in batches:
            for path, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                code, others = _scanned(text, language, path.endswith(_MARKUP))
                if sums:
                    _sums(code)
                rows, size = code + others if wanted is None else [r for r in code if wanted(r, code)], len(code)
                if "path" in lists:
                    lists["path"] += [path] * len(rows)
                for name in names:
                    if name in _NEIGHBOURS:
                        by, further, of = _NEIGHBOURS[name]
                        lists[name] += [code[k].get(of) if (k := r.get(by)) is not None and 0 <= (k := k + further) < size else None for r in rows]
                    else:
                        lists[name] += [r.get(name) for r in rows]
                while len(lists[fields[0][0]]) >= BATCH:
                    yield out(BATCH)
        if lists[fields[0][0]]:
            yield out(BATCH)

    return spread(files).mapInArrow(run, ", ".join(" ".join(f) for f in fields))


#: Kinds whose characters are no code.
BLANK = ("string", "template", "comment", "jsx_text", "regex", "char")


def masked(files: DataFrame, language: str) -> DataFrame:
    """files(path, content) with bare: the same text, of the same length, where all that is no code is blank but for line breaks and the outermost quotes of strings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bare = []
            for path, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                out, at = [], 0
                for r in sorted(scan(text, language, path.endswith(_MARKUP)), key=lambda r: r["start"]):
                    if r["kind"] in BLANK:
                        inner = re.sub(r"[^\n]", " ", text[r["start"] : r["end"]])
                        if r["kind"] == "string" and len(inner) > 1 and "\n" not in inner:
                            inner = f'"{inner[1:-1]}"'
                        out += [text[at : r["start"]], inner]
                        at = r["end"]
                bare.append("".join(out) + text[at:])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bare, pa.string())], ["path", "content", "bare"])

    return spread(files).mapInArrow(run, "path string, content string, bare string")
