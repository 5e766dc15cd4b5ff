"""Substring joins without a cross join.

Needles of three words or more meet a text only where it has an inner word of theirs, so each text meets few of them. All other
needles (names, paths, single words) go into multi-pattern automata: tries with failure links, as flat arrays, of AUTOMATON
characters each, past which the texts stream. Rows come out for matches only; no key gathers what merely begins alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of needles that one automaton is built of (its arrays go to every task), characters of text that pass it at a time, and of a window.
AUTOMATON, STREAM, WINDOW = 4_000_000, 1_000_000, 2048


def inner_words(text: Column, pattern: str = r"\s+") -> Column:
    """The words of a text but for the first and the last, which may be parts of longer words where it occurs."""
    words = F.split(text, pattern)
    return F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))


class Automaton:
    """Aho-Corasick over code points: edges as sorted keys (state, character), failure links, and for each state its own needle and the next state on its failure chain that has one."""

    def __init__(self, needles: list[str]):
        needles = sorted(set(needles))
        codes = [np.frombuffer(n.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for n in needles]
        self.needles, depth = needles, max(map(len, codes), default=0)
        at = np.zeros(len(codes), np.int64)
        keys, to, levels, parents, marks = [], [], [], [], []
        own = {}
        states = 1
        # level by level: needles that share a prefix share a state
        for d in range(depth):
            live = np.array([k for k, c in enumerate(codes) if len(c) > d], np.int64)
            step = (at[live] << 21) | np.array([codes[k][d] for k in live], np.int64)
            fresh, which = np.unique(step, return_inverse=True)
            new = states + np.arange(len(fresh))
            keys.append(fresh)
            to.append(new)
            levels.append(new)
            parents.append(fresh >> 21)
            marks.append(fresh & 0x1FFFFF)
            at[live] = new[which]
            states += len(fresh)
        for k, c in enumerate(codes):
            if len(c):
                own[int(at[k])] = k
        key, target = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, to))
        order = np.argsort(key)
        self.keys, self.to = key[order], target[order]
        self.fail = np.zeros(states, np.int64)
        self.own = np.full(states, -1, np.int64)
        for s, k in own.items():
            self.own[s] = k
        for new, parent, mark in zip(levels, parents, marks, strict=True):
            self.fail[new] = np.where(parent == 0, 0, self.step(self.fail[parent], mark))
        # the next state on the failure chain, itself included, that ends a needle
        self.out = np.where(self.own >= 0, np.arange(states), 0)
        for new in levels:
            self.out[new] = np.where(self.own[new] >= 0, new, self.out[self.fail[new]])

    def step(self, state: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The states after one character each."""
        state, open_ = state.copy(), np.arange(len(state))
        while len(open_):
            key = (state[open_] << 21) | mark[open_]
            at = np.searchsorted(self.keys, key)
            hit = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key) if len(self.keys) else np.zeros(len(key), bool)
            root = ~hit & (state[open_] == 0)
            state[open_[hit]] = self.to[at[hit]]
            open_ = open_[~hit & ~root]
            state[open_] = self.fail[state[open_]]
        return state

    def matches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, needle, place of its first character, from 0) of every needle in every text, the first place only. All windows of texts move on by one character together."""
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        # a text passes in windows that overlap by what a needle can reach over
        reach = max(map(len, self.needles), default=1) - 1
        width = max(WINDOW, 4 * reach)
        lanes = [(k, at) for k, c in enumerate(codes) for at in range(0, max(len(c), 1), width)]
        owner, begin = (np.array([x[i] for x in lanes], np.int64) for i in (0, 1))
        starts = np.cumsum([0, *map(len, codes)])
        size = np.minimum(starts[owner + 1] - starts[owner] - begin, width + reach)
        order = np.argsort(-size, kind="stable")
        owner, begin, size = owner[order], begin[order], size[order]
        flat = np.concatenate(codes).astype(np.int64) if codes else np.zeros(0, np.int64)
        here = starts[owner] + begin
        state = np.zeros(len(order), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        live = len(order)
        for d in range(int(size[0]) if len(size) else 0):
            while live and size[live - 1] <= d:
                live -= 1
            state[:live] = self.step(state[:live], flat[here[:live] + d])
            at = self.out[state[:live]]
            rows = np.flatnonzero(at)
            while len(rows):
                found.append((owner[rows], self.own[at[rows]], begin[rows] + d))
                at_next = self.out[self.fail[at[rows]]]
                at = np.zeros(live, np.int64)
                at[rows] = at_next
                rows = rows[at_next > 0]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        text, needle, last = (np.concatenate(x) for x in zip(*found, strict=True))
        pair = text * len(self.needles) + needle
        by = np.lexsort((last, pair))
        first = by[np.concatenate(([True], np.diff(pair[by]) > 0))]
        text, needle, last = text[first], needle[first], last[first]
        length = np.array([len(n) for n in self.needles], np.int64)
        return text, needle, last - length[needle] + 1


def _streamed(texts: DataFrame, needles: list[str], text: str, needle: str, place: str) -> DataFrame:
    """texts, once for each needle that they contain, with the needle and its first place from 1."""
    shared = texts.sparkSession.sparkContext.broadcast(Automaton(needles))
    schema = T.StructType([*texts.schema.fields, T.StructField(needle, T.StringType()), T.StructField(place, T.IntegerType())])
    nth = texts.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            said = batch.column(nth).to_pylist()
            start = 0
            while start < len(said):
                stop, held = start, 0
                while stop < len(said) and (stop == start or held + len(said[stop] or "") <= STREAM):
                    held += len(said[stop] or "")
                    stop += 1
                row, which, at = automaton.matches([t or "" for t in said[start:stop]])
                if len(row):
                    part = batch.take(pa.array(row + start))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([automaton.needles[k] for k in which], pa.string()), pa.array((at + 1).astype(np.int32))], schema.names)
                start = stop

    return texts.mapInArrow(run, schema)


def containment_join(texts: DataFrame, needles: DataFrame, text: str, needle: str, pattern: str = r"\s+", place: str | None = None) -> DataFrame:
    """All rows of texts x needles where the text contains the needle (no null or empty needles); with place, a column of that name has its first place from 1.

    The driver holds the distinct needles of one automaton at a time; needles of one hash part are one automaton."""
    key, spot = "_anchor", place or "_place"
    longest = F.array_max(F.transform(inner_words(F.col(needle), pattern), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    needles = needles.where(F.length(needle) > 0).withColumn(key, longest)
    long = needles.where(F.col(key).isNotNull() & (F.col(key) != ""))
    short = needles.where(F.col(key).isNull() | (F.col(key) == "")).drop(key)
    # only a text's hash goes with its words; the text itself meets what is left once
    keyed = texts.withColumn("_text", F.xxhash64(text))
    words = keyed.select("_text", F.explode(F.array_distinct(F.split(text, pattern))).alias(key))
    found = keyed.join(words.distinct().join(long, key).drop(key), "_text").where(F.contains(F.col(text), F.col(needle))).drop("_text").withColumn(spot, F.instr(F.col(text), F.col(needle)))
    distinct = short.select(needle).distinct()
    total = distinct.agg(F.sum(F.length(needle))).first()[0] or 0
    parts = -(-total // AUTOMATON)
    for part in range(parts):
        mine = distinct if parts == 1 else distinct.where(F.pmod(F.xxhash64(needle), F.lit(parts)) == part)
        hits = _streamed(texts, [r[0] for r in mine.collect()], text, needle, spot)
        found = found.unionByName(hits.join(short, needle).select(*found.columns))
    return found if place else found.drop(spot)
