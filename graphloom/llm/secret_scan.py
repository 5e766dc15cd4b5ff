"""Secret scans by patterns and by inferred grammars of credentials.

Fixed patterns give base spans of three kinds: assignments of a password or token, access keys, long hexadecimal
runs. The grammar finds more: from the values that the patterns label, and from the other long runs of credential
characters as background, one probabilistic automaton a kind is inferred. Each value is spelled as symbols
(the narrowest class of each segment's characters, once a character, and the marks between segments), the values
become a prefix tree with counts, and states whose endings and successors agree within Hoeffding bounds,
all the way down, are merged, in order of their distance from the root. Every candidate, which is a maximal
run of at least LEAST credential characters that meets no base span, is scored: it is a secret if under the automaton of some kind
its likelihood is MARGIN times that under the background's, and no less than nearly all labelled values of that kind
have. Learned formats so are found without the words that stand before them.

Learning counts each distinct value once. It reads all documents; of each kind it keeps the values with the least digests, about
SAMPLE of them, of at most LONGEST characters (the documented bound of labelled rows). Scanning covers every
whole text, and candidates of any length. Patterns know ASCII only; offsets are code points, ends exclusive.

Defined results: null and empty texts have no span; copies and repeated rows get the same spans; spans are ordered
by start, then kind (assign, access, hex, format), then end; without labelled values there is no format span;
a tie between kinds goes to the first in order; extra columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_slices

# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same as runs of one or more that have 24 or more
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "format")

#: Least length of a candidate; distinct values a kind that learning keeps about, and their greatest length.
LEAST, SAMPLE, LONGEST = 16, 2000, 256
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
SEGMENTS = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")
#: Confidence of the compatibility test, share of labelled values that may be less likely than what is found, times the background's likelihood.
ALPHA, REST, MARGIN = 0.05, 0.01, 1000.0
#: Labelled values of a kind from which on its format is inferred.
FEWEST = 20
#: Probability of a symbol or an ending that a state has not seen.
UNSEEN = 1e-4
BACKGROUND = "background"
#: Symbol -> characters, from the narrowest: digits, hexadecimal of one case, letters, capitals with digits, lower case with digits, any.
CLASSES = (("9", "[0-9]+"), ("a", "[a-z]+"), ("A", "[A-Z]+"), ("c", "[A-Z][a-z]+"), ("h", "[0-9a-f]+"), ("H", "[0-9A-F]+"), ("b", "[A-Z0-9]+"), ("l", "[a-z0-9]+"), ("m", "[A-Za-z0-9]+"))
_CLASS = [(s, re.compile(p)) for s, p in CLASSES]


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) of what the patterns find, in order."""
    found = [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def candidates(text: str, base: list[tuple[str, int, int, int]]) -> Iterator[tuple[int, int]]:
    """Maximal runs of credential characters that meet no base span."""
    ends = sorted((s, e) for _, s, e, _ in base)
    i = reach = 0
    for m in CANDIDATE.finditer(text):
        while i < len(ends) and ends[i][0] < m.end():
            reach = max(reach, ends[i][1])
            i += 1
        if reach <= m.start():
            yield m.span()


def symbols(value: str) -> str:
    return "".join(s if s[0] not in _ALNUM else next(c for c, p in _CLASS if p.fullmatch(s)) * len(s) for s in SEGMENTS.findall(value))


_ALNUM = frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


class Automaton:
    """A deterministic probabilistic automaton: per state the log probability of ending, and of each symbol with its next state."""

    def __init__(self, ends: list[float], steps: list[dict[str, tuple[float, int]]]):
        self.ends, self.steps = ends, steps

    def likelihood(self, word: Iterable[str]) -> float:
        """Log probability; from the first unseen symbol on every symbol is as unlikely."""
        state, total = 0, 0.0
        for s in word:
            step = self.steps[state].get(s) if state >= 0 else None
            if step is None:
                state = -1
                total += math.log(UNSEEN)
            else:
                total += step[0]
                state = step[1]
        return total + (self.ends[state] if state >= 0 else math.log(UNSEEN))


def infer(words: Iterable[str], alpha: float = ALPHA) -> Automaton:
    """Merge the compatible states of the words' prefix tree, nearest the root first."""
    count, end = [0], [0]
    out: list[dict[str, list[int]]] = [{}]  # symbol -> [traffic, next state]
    for w in words:
        at = 0
        count[0] += 1
        for s in w:
            step = out[at].get(s)
            if step is None:
                step = out[at][s] = [0, len(count)]
                count.append(0)
                end.append(0)
                out.append({})
            step[0] += 1
            at = step[1]
            count[at] += 1
        end[at] += 1
    reach = math.sqrt(0.5 * math.log(2 / alpha))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            bound = reach * (1 / math.sqrt(count[a]) + 1 / math.sqrt(count[b]))
            if abs(end[a] / count[a] - end[b] / count[b]) > bound:
                return False
            for s in out[a].keys() | out[b].keys():
                x, y = out[a].get(s), out[b].get(s)
                if abs((x[0] if x else 0) / count[a] - (y[0] if y else 0) / count[b]) > bound:
                    return False
                if x and y:
                    todo.append((x[1], y[1]))
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            count[a] += count[b]
            end[a] += end[b]
            for s, (traffic, y) in out[b].items():
                if s in out[a]:
                    out[a][s][0] += traffic
                    todo.append((out[a][s][1], y))
                else:
                    out[a][s] = [traffic, y]

    kept, known = [0], {0}
    while fringe := sorted((kept.index(a), s) for a in kept for s, (_, x) in out[a].items() if x not in known):
        a, s = kept[fringe[0][0]], fringe[0][1]
        b = out[a][s][1]
        same = next((r for r in kept if count[0] and compatible(r, b)), None)
        if same is None:
            kept.append(b)
            known.add(b)
        else:
            out[a][s][1] = same
            fold(same, b)
    number = {q: i for i, q in enumerate(kept)}
    log = lambda n, q: math.log(max(n / max(count[q], 1), UNSEEN))
    return Automaton([log(end[q], q) for q in kept], [{s: (log(n, q), number[x]) for s, (n, x) in out[q].items()} for q in kept])


class Model:
    """An automaton and the least likelihood of what it accepts by kind of credential, and the background's automaton."""

    def __init__(self, values: dict[str, list[str]]):
        words = {k: [symbols(v) for v in sorted(vs)] for k, vs in values.items()}
        self.background = infer(words.get(BACKGROUND, []))
        self.kinds: dict[str, tuple[Automaton, float]] = {}
        for k in KINDS[:-1]:
            if len(words.get(k, [])) >= FEWEST:
                automaton = infer(words[k])
                reached = sorted(automaton.likelihood(w) for w in words[k])
                self.kinds[k] = automaton, reached[int(REST * len(reached))]

    def score(self, value: str) -> float | None:
        """Log of the likelihood ratio of the best kind's format to the background; None if the value is of no kind's format."""
        word = symbols(value)
        fits = [x for automaton, least in self.kinds.values() if (x := automaton.likelihood(word)) >= least]
        ratio = max(fits) - self.background.likelihood(word) if fits else 0.0
        return ratio if fits and ratio >= math.log(MARGIN) else None


def spans_of(text: str, model: Model | None) -> list[tuple[str, int, int, float | None]]:
    base = base_spans(text)
    found: list[tuple[str, int, int, float | None]] = [(k, s, e, None) for k, s, e, _ in base]
    if model is not None and model.kinds:
        found += [("format", s, e, score) for s, e in candidates(text, base) if (score := model.score(text[s:e])) is not None]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def learn(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """Infer the automata from the values that the patterns label in docs, and from its other candidates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch, "text"):
                found: set[tuple[str, str]] = set()
                for t in texts:
                    base = base_spans(t)
                    found |= {(k, t[v:e]) for k, _, e, v in base if e - v <= LONGEST}
                    found |= {(BACKGROUND, t[s:e]) for s, e in candidates(t, base) if e - s <= LONGEST}
                kinds, values = zip(*sorted(found), strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["kind", "value"])

    values = cut(docs.select(F.col(text).alias("text")).mapInArrow(run, "kind string, value string").groupBy("kind", "value").agg(F.count("*").alias("n")))
    sizes = {r["kind"]: r["n"] for r in values.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    # about `sample` values a kind: those whose digest is in that share of its range
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))]) if sizes else None
    kept = values.where(F.pmod(F.xxhash64("value"), F.lit(1 << 30)) < share[F.col("kind")] * (1 << 30)).select("kind", "value").collect() if sizes else []
    by: dict[str, list[str]] = {}
    for r in kept:
        by.setdefault(r["kind"], []).append(r["value"])
    return Model(by)


def scan(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans of each document: kind, start, end, and for a format its score."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                spans = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in spans_of(t, model)] for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>")
