"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A chunk's distinct words become one flat numpy array of symbols. Each round looks up the rank of
every adjacent pair, takes the minimum rank of each word (a segmented minimum), merges all leftmost
non-overlapping occurrences of it at once and compacts the array, until no word has a pair left.
Merging several occurrences at once equals the library's one-by-one queue as long as a new symbol
cannot start a better or equal pair; for the few symbols where it can, only the leftmost occurrence
of a word merges in that round. Pieces that share the lowest score (runs of spaces) are merged last,
strictly from the left.

Defined results: null or empty text gives the end id alone (and decodes to ""); characters without a
piece become byte pieces; repeated rows are encoded alike; all other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_slices, without

SPACE = "▁"
NO_RANK = np.int64(2**62)
#: Words that a worker keeps encoded between chunks; beyond it the memory is emptied.
CACHE_WORDS = 400_000


class Vocabulary:
    """Pair tables of a SentencePiece BPE model file's content."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != trainer.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("needs a BPE model with byte fallback and the identity normaliser")
        self.dummy_prefix, self.eos_id, self.unk_id = norm.add_dummy_prefix, trainer.eos_id, trainer.unk_id
        self.unk_surface = trainer.unk_surface
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = np.array([p.type for p in proto.pieces])
        if set(self.kinds) - {1, 2, 3, 6}:
            raise ValueError("user-defined and unused pieces are not supported")
        normal = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == 1}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        # Symbols: pieces keep their ids; characters that only occur inside pieces get ids after them.
        self.symbol = {s: i for s, (i, _) in normal.items()}
        for s in list(normal):
            for c in s:
                self.symbol.setdefault(c, len(self.pieces) + len(self.symbol))
        scores = {s: v for s, (_, v) in normal.items() if len(s) > 1}
        self.worst = min(scores.values()) if len(set(scores.values())) < len(scores) else None
        order = {v: r for r, v in enumerate(sorted(set(scores.values()), reverse=True))}
        left, right, made, rank = [], [], [], []
        self.last_pairs: dict[tuple[int, int], int] = {}
        for s, v in scores.items():
            for k in range(1, len(s)):
                a, b = self.symbol.get(s[:k]), self.symbol.get(s[k:])
                if a is None or b is None:
                    continue
                if v == self.worst:
                    self.last_pairs[a, b] = self.symbol[s]
                else:
                    left.append(a), right.append(b), made.append(self.symbol[s]), rank.append(order[v])
        left, right, made, rank = (np.array(x, np.int64) for x in (left, right, made, rank))
        key = left << 32 | right
        by = np.argsort(key)
        self.key, self.made, self.rank = key[by], made[by], rank[by]
        # Symbols whose creation may open a pair that is as good or better than their own rank.
        own = np.full(max(self.symbol.values()) + 2, -1, np.int64)
        own[made] = rank
        self.wary = np.zeros(len(own), bool)
        for side in (left, right):
            self.wary[side[rank <= own[side]]] = True
        self.of_code = np.full(0x110000, -1, np.int32)
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.of_code[ord(c)] = i
        self.inner = np.unique(np.array([ord(x) << 32 | ord(y) for s in scores for x, y in zip(s, s[1:], strict=False)], np.int64))

    def words(self, text: str) -> list[str]:
        """Cut a text where no piece can span: before a space mark that follows another character.

        A key is what follows a single space mark; all other words keep their marks, behind a space."""
        if not text:
            return []
        if self.dummy_prefix and SPACE not in text:
            keys = text.split(" ")
            if "" not in keys:
                return keys
        parts = ((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)).split(SPACE)
        out, marks = [], 0
        if parts[0]:
            out.append(" " + parts[0])
        for p in parts[1:]:
            marks += 1
            if p:
                out.append(p if marks == 1 else " " + SPACE * marks + p)
                marks = 0
        if marks:
            out.append(" " + SPACE * marks)
        return out

    @staticmethod
    def spelled(key: str) -> str:
        return key[1:] if key[0] == " " else SPACE + key

    def _pairs(self, left: np.ndarray, right: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NO_RANK where it isn't a piece or spans two segments."""
        key = np.where(same & (left >= 0) & (right >= 0), left << 32 | right, -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NO_RANK), self.made[at]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, flat, and the number of ids of each."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        length = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), length)
        sym = self.of_code[codes].astype(np.int64)
        unknown = np.flatnonzero(sym < 0)
        sym[unknown] = -1 - codes[unknown]  # a character outside all pieces stands for itself and never merges
        # Segments: a word, cut again where two characters never meet inside a piece.
        if len(codes) > 1:
            pair = codes[:-1] << 32 | codes[1:]
            at = np.minimum(np.searchsorted(self.inner, pair), len(self.inner) - 1)
            cut = (self.inner[at] != pair) | (word[:-1] != word[1:])
            seg = np.concatenate(([0], np.cumsum(cut)))
        else:
            seg = np.zeros(len(codes), np.int64)
        done_at, done_sym = [], []
        pos = np.arange(len(codes))
        rank, made = self._pairs(sym[:-1], sym[1:], seg[:-1] == seg[1:])
        rank, made = np.append(rank, NO_RANK), np.append(made, -1)
        while len(sym) > 1:
            first = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            best = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(sym)))
            live = best < NO_RANK
            if not live.all():  # compaction: finished segments leave
                rest = np.repeat(~live, count)
                done_at.append(pos[rest])
                done_sym.append(sym[rest])
                sym, seg, pos, rank, made = (x[~rest] for x in (sym, seg, pos, rank, made))
                best, count = best[live], count[live]
                if not len(sym):
                    break
            h = np.flatnonzero(rank == np.repeat(best, count))
            # leftmost non-overlapping: in a run of touching hits every second one goes
            nth = np.arange(len(h))
            nth -= np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(h) > 1)), nth, 0))
            h = h[nth % 2 == 0]
            new = made[h]
            wary = self.wary[new]
            if wary.any():
                lead = np.concatenate(([True], seg[h[1:]] != seg[h[:-1]]))
                h, new = h[~wary | lead], new[~wary | lead]
            sym[h] = new
            keep = np.ones(len(sym), bool)
            keep[h + 1] = False
            at = h - np.arange(len(h))  # the merged symbols' places after compaction
            sym, seg, pos, rank, made = (x[keep] for x in (sym, seg, pos, rank, made))
            # only the pairs on both sides of a merged symbol have changed
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            touched[np.maximum(at, 1) - 1] = True
            at = np.flatnonzero(touched)
            tail = at[-1:] == len(sym) - 1
            near = at[:-1] if len(at) and tail[0] else at
            rank[near], made[near] = self._pairs(sym[near], sym[near + 1], seg[near] == seg[near + 1])
            if len(at) and tail[0]:
                rank[-1] = NO_RANK
        done_at.append(pos)
        done_sym.append(sym)
        at, sym = np.concatenate(done_at), np.concatenate(done_sym)
        by = np.argsort(at, kind="stable")
        at, sym = at[by], sym[by]
        owner = word[at]
        if self.last_pairs:
            sym, owner = self._last(sym, owner)
        # characters without a piece become bytes
        odd = np.flatnonzero((sym < 0) | (sym >= len(self.pieces)))
        if len(odd):
            names = {v: k for k, v in self.symbol.items()} if (sym >= len(self.pieces)).any() else {}
            reps = np.ones(len(sym), np.int64)
            extra = {}
            for i in odd:
                s = int(sym[i])
                c = names[s] if s >= 0 else chr(-1 - s)
                extra[i] = [self.byte_id[b] for b in c.encode("utf-8", "replace")]
                reps[i] = len(extra[i])
            start = np.cumsum(reps) - reps
            out = np.repeat(sym, reps)
            for i, ids in extra.items():
                out[start[i] : start[i] + len(ids)] = ids
            sym, owner = out, np.repeat(owner, reps)
        return sym.astype(np.int32), np.bincount(owner, minlength=len(words))

    def _last(self, sym: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges of the shared lowest score, strictly leftmost first, in the words that have one."""
        keys = np.array(sorted(a << 32 | b for a, b in self.last_pairs), np.int64)
        key = np.where((sym[:-1] >= 0) & (sym[1:] >= 0), sym[:-1] << 32 | sym[1:], -1)
        hit = np.isin(key, keys) & (owner[:-1] == owner[1:])
        if not hit.any():
            return sym, owner
        keep = np.ones(len(sym), bool)
        for w in np.unique(owner[:-1][hit]):
            lo, hi = np.searchsorted(owner, [w, w + 1])
            todo, out = sym[lo:hi].tolist()[::-1], []
            while todo:
                x = todo.pop()
                if out and (m := self.last_pairs.get((out[-1], x))) is not None:
                    out.pop()
                    todo.append(m)
                else:
                    out.append(x)
            sym[lo : lo + len(out)] = out
            keep[lo + len(out) : hi] = False
        return sym[keep], owner[keep]

    def decode(self, ids: np.ndarray) -> str:
        """Text of one sequence: control ids vanish, byte runs become characters, invalid bytes U+FFFD."""
        ids = ids[(ids >= 0) & (ids < len(self.pieces))]
        ids = ids[self.kinds[ids] != 3]
        if not len(ids):
            return ""
        kinds = self.kinds[ids]
        if (kinds == 1).all():
            text = "".join(map(self.pieces.__getitem__, ids.tolist()))
        else:
            out, run = [], bytearray()
            for i, k in zip(ids.tolist(), kinds.tolist(), strict=True):
                if k == 6:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    out.append(_utf8(run))
                    run = bytearray()
                out.append(self.pieces[i] if k == 1 else self.unk_surface)
            if run:
                out.append(_utf8(run))
            text = "".join(out)
        if self.dummy_prefix and kinds[0] == 1 and text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ")


def _utf8(raw: bytearray) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode("utf-8"))
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(2)
def _vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


class Encoder:
    """Encodes texts through a bounded memory of words."""

    def __init__(self, vocabulary: Vocabulary, cache_words: int = CACHE_WORDS):
        self.v, self.most = vocabulary, cache_words
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.count, self.start = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, each closed by the end id, and the number of ids of each."""
        if len(self.index) > self.most:
            self._clear()
        words = [self.v.words(t) for t in texts]
        index = self.index
        fresh: dict[str, None] = {}
        for ws in words:
            fresh.update(dict.fromkeys(set(ws).difference(index)))
        if fresh:
            index.update(zip(fresh, range(len(index), len(index) + len(fresh)), strict=True))
            flat, count = self.v.encode_words([self.v.spelled(w) for w in fresh])
            self.flat = np.concatenate((self.flat, flat))
            self.count = np.concatenate((self.count, count))
            self.start = np.cumsum(self.count) - self.count
        # the end id is one more "word" after those of each text
        n = np.fromiter(map(len, words), np.int64, len(words)) + 1
        index[""] = -1  # no key is empty
        which = np.fromiter(map(index.__getitem__, chain.from_iterable(chain(ws, ("",)) for ws in words)), np.int64, int(n.sum()))
        del index[""]
        end = which < 0
        count = np.where(end, 1, self.count[which] if len(self.count) else 1)
        start = np.where(end, 0, self.start[which] if len(self.start) else 0)
        total = np.cumsum(count)
        at = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(start - (total - count), count)
        ids = self.flat[at] if len(self.flat) else np.zeros(len(at), np.int32)
        ids[total[end] - 1] = self.v.eos_id
        per_text = np.add.reduceat(count, np.cumsum(n) - n) if len(n) else np.zeros(0, np.int64)
        return ids, per_text


def encode(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a column of token ids (array of int, end id last) for its whole texts. model: the model file's content.
    A column with the result's name is replaced."""
    df = without(df, [ids], [text])
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_vocabulary(shared.value))
        for batch in batches:
            for part, texts in text_slices(batch, text):
                flat, count = encoder(texts)
                offsets = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))], [*part.schema.names, ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of each row's ids; a null list gives the empty text. A column with the result's name is replaced."""
    df = without(df, [text], [ids])
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType(), False)])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                column = batch.column(batch.schema.get_field_index(ids))
                out = []
                for row in column:
                    out.append(v.decode(row.values.to_numpy(zero_copy_only=False)) if row.is_valid and len(row.values) else "")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, text])

    return df.mapInArrow(run, schema)
