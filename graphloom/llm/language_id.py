"""Language identification by cross-parsing against suffix automata of labelled text.

Each language's labelled sample becomes a suffix automaton. A text is parsed greedily into the longest
phrases that occur in the sample; the language that needs the fewest phrases, normalised by the bits
that name a place in its sample, wins. Windows of whole texts are parsed in lockstep; then every window is
parsed again from the state in which the one before it ended, until it meets its first parse, so the result is
that of one parse of the whole text.

Learning takes SAMPLE_DOCS excerpts of SAMPLE_SPAN characters per language: those of the distinct texts with
the least hashes, so copies of a text count once and every language with text is learned. Each language has its own
alphabet: transitions by its ALPHABET commonest characters are a dense table, the others a sorted list of edges.
Everything is parsed in full at prediction.

Defined results: null text or a text without a letter gives `und` with score 0; without any labelled
text all are `und`; ties go to the first language by name; repeated rows are scored alike; other
columns pass through, but a column with a result's name is replaced. The score is 1 - best/second cost, so it is 0 when
two languages fit equally. The fit, if asked for, is how many phrases per character end in the best language's parse, the
first SPARED left out: near 1 for a long text that shares no character with it, about 0.2 for its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small_batches, text_slices, tidy, without

SAMPLE_DOCS, SAMPLE_SPAN = 120, 300
#: Characters of a language with dense transitions, and characters of a window.
ALPHABET, WINDOW = 48, 256
#: Ended phrases per character from which on no learned language reads the text; so many of a text do not count, as short texts say little.
UNREADABLE, SPARED = 0.5, 8


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", docs: int = SAMPLE_DOCS, span: int = SAMPLE_SPAN) -> dict[str, str]:
    """A bounded sample of text per language from the rows of `labelled` (null texts and languages are left out)."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    # the least hashes of each language: they lie in the lowest part of the range, of which four times as many are ranked
    distinct = cut(rows.select("lang", "h").distinct())
    share = F.least(F.lit(1.0), 4.0 * docs / F.col("n"))
    low = distinct.join(F.broadcast(distinct.groupBy("lang").agg(F.count("*").alias("n"))), "lang").where(F.col("h").cast("double") <= F.lit(-(2.0**63)) + share * 2.0**64)
    few = low.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("nth") <= docs).select("lang", "h")
    at = F.pmod("h", F.greatest(F.length("text") - span, F.lit(1))) + 1
    chosen = rows.join(F.broadcast(few), ["lang", "h"]).select("lang", "h", F.substring("text", at.cast("int"), F.lit(span)).alias("t"))  # docs rows a language
    out = defaultdict(list)
    for r in chosen.groupBy("lang", "h").agg(F.min("t").alias("t")).orderBy("lang", "h").collect():
        out[r["lang"]].append(r["t"])
    return {k: "\n".join(v).lower() for k, v in sorted(out.items())}


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """The transitions of each state of the automaton of all substrings of codes; state 0 is the start, which no edge leads to."""
    nexts, link, length = [{}], [-1], [0]
    last = 0
    for c in codes:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


class Automaton:
    """One language's transitions for many states at once. Code 0 stands for characters that the sample lacks."""

    def __init__(self, sample: str, alphabet: int = ALPHABET):
        points = np.frombuffer(sample.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars, count = np.unique(points, return_counts=True)
        chars = chars[np.argsort(-count, kind="stable")]
        self.code = np.zeros(0x110000, np.uint16)
        self.code[chars] = np.arange(1, len(chars) + 1)
        nexts = suffix_automaton(self.code[points].tolist())
        self.alphabet = min(alphabet, len(chars) + 1)
        self.table = np.zeros((len(nexts), self.alphabet), np.int32)
        keys, targets = [], []
        for s, edges in enumerate(nexts):
            for c, t in edges.items():
                if c < self.alphabet:
                    self.table[s, c] = t
                else:
                    keys.append(s << 16 | c)
                    targets.append(t)
        self.table = self.table.ravel()
        by = np.argsort(keys, kind="stable")
        self.keys, self.targets = np.array(keys, np.int64)[by], np.array(targets, np.int32)[by]
        self.root = np.zeros(len(chars) + 1, np.int32)
        for c, t in nexts[0].items():
            self.root[c] = t
        self.bits = float(np.log2(len(points) + 1))

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after characters c, and where a phrase ended before them."""
        if len(self.keys):
            out = self.table[state * self.alphabet + np.where(c < self.alphabet, c, 0)]
            rare = np.flatnonzero(c >= self.alphabet)
            if len(rare):
                key = state[rare] << 16 | c[rare]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                out[rare] = np.where(self.keys[at] == key, self.targets[at], 0)
        else:
            out = self.table[state * self.alphabet + c]
        miss = out == 0
        return np.where(miss, self.root[c], out).astype(np.int64), miss


class Parser:
    """Cross-parsing costs of texts for every language."""

    def __init__(self, samples: tuple[tuple[str, str], ...], alphabet: int = ALPHABET):
        self.names = [n for n, _ in samples]
        self.automata = [Automaton(t, alphabet) for _, t in samples]
        self.bits = np.array([a.bits for a in self.automata])

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases that each text (in lower case) needs, one row per text and one column per language."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.cumsum(length) - length
        pieces = -(-length // WINDOW)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = start[owner] + nth * WINDOW
        size = np.minimum(WINDOW, length[owner] - nth * WINDOW)
        by = np.argsort(-size, kind="stable")
        lane = np.empty(len(by), np.int64)
        lane[by] = np.arange(len(by))
        after = np.where(np.append(nth[1:], 0)[: len(by)] > 0, np.append(lane[1:], 0)[: len(by)], -1)[by]  # the lane of a lane's next window
        at, size, owner = at[by], size[by], owner[by]
        left = len(at) - np.searchsorted(size[::-1], np.arange(1, WINDOW + 1), "left")  # windows that reach step t
        return np.stack([np.bincount(owner, self._misses(a, a.code[points].astype(np.int64), at, size, left, after), len(texts)) for a in self.automata], 1) + 1

    @staticmethod
    def _misses(automaton: Automaton, codes: np.ndarray, at: np.ndarray, size: np.ndarray, left: np.ndarray, after: np.ndarray) -> np.ndarray:
        n = len(at)
        states, misses = np.zeros((WINDOW, n), np.int32), np.zeros((WINDOW, n), bool)
        state = np.zeros(n, np.int64)
        for t in range(WINDOW):
            if not left[t]:
                break
            state, miss = automaton.step(state[: left[t]], codes[at[: left[t]] + t])
            states[t, : left[t]], misses[t, : left[t]] = state, miss
        end = states[size - 1, np.arange(n)].astype(np.int64) if n else state
        changed = np.flatnonzero(after >= 0)
        while len(changed):  # windows whose predecessors' end has changed, until each meets its parse so far
            lanes, state = after[changed], end[changed]
            before = end.copy()
            for t in range(WINDOW):
                if not len(lanes):
                    break
                state, miss = automaton.step(state, codes[at[lanes] + t])
                going = (state != states[t, lanes]) & (size[lanes] > t + 1)
                last = size[lanes] == t + 1
                end[lanes[last]] = state[last]
                states[t, lanes], misses[t, lanes] = state, miss
                lanes, state = lanes[going], state[going]
            changed = np.flatnonzero((end != before) & (after >= 0))
        return misses.sum(0)

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character and fit, one row per text and one column per language."""
        lower = [t.lower() for t in texts]
        length = np.maximum(np.fromiter(map(len, lower), np.int64, len(lower)), 1)[:, None]
        phrases = self.phrases(lower)
        return phrases / length * self.bits, np.maximum(phrases - 1 - SPARED, 0) / length


#: A worker's parser; it goes before another is made.
_made: dict[tuple[tuple[str, str], ...], Parser] = {}


def _parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    if samples not in _made:
        _made.clear()
        _made[samples] = Parser(samples)
    return _made[samples]


def predict(df: DataFrame, samples: dict[str, str], text: str = "text", lang_pred: str = "lang_pred", score: str = "score", fit: str | None = None) -> DataFrame:
    """df with the predicted language of its whole texts, a score from 0 to 1 and, where it has a name, the fit."""
    df = without(df, [lang_pred, score, *([fit] if fit else [])], [text])
    schema = T.StructType([*df.schema.fields, T.StructField(lang_pred, T.StringType(), False), T.StructField(score, T.DoubleType(), False), *([T.StructField(fit, T.DoubleType(), False)] if fit else [])])
    shared = df.sparkSession.sparkContext.broadcast(tuple(samples.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shared.value) if shared.value else None
        for batch in batches:
            for part, texts in text_slices(batch, text):
                names, scores, fits = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts))
                if parser:
                    cost, share = parser.costs(texts)
                    order = np.sort(cost, 1)
                    best = np.argmin(cost, 1)
                    fits = share[np.arange(len(texts)), best]
                    margin = 1 - order[:, 0] / np.maximum(order[:, 1], 1e-12) if cost.shape[1] > 1 else 1 / (1 + order[:, 0])
                    for i, t in enumerate(texts):
                        if any(map(str.isalpha, t)):
                            names[i], scores[i] = parser.names[best[i]], float(np.clip(margin[i], 0, 1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores), *([pa.array(fits)] if fit else [])], schema.names)

    return small_batches(df).mapInArrow(tidy(run), schema)
