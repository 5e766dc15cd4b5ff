"""Conversation structure repair by deduplicated signatures.

Every row's first fault is found (blank, duplicate or truncated), and the rows of a conversation, in
order of turn, are spelled as a signature: one letter a row for its role and fault. Conversations are cut
into blocks of at most BLOCK rows by a range shuffle over (conversation, turn), so a conversation of any
length is spread over tasks. Each distinct signature of a block is solved once, by a memoised recursion
over its suffixes: for each state before and after the block the cheapest edits, as an audit string. The
tables are joined back to the blocks by signature. Blocks of a long conversation are composed FAN at a
time, level by level, and the chosen states go back down the same tree; so no task holds a conversation.
The edits are then replayed over each block's rows.

States are the role a repaired conversation has reached: nothing yet, system, user, assistant. Edits and
costs: Keep 0, Rerole (to the role that the state wants) 3, Delete 4, Insert (an empty text of the role that
the state wants) 3; a truncated row that stays costs 3 more; a blank or duplicate row must go. Two audits of
equal cost between the same states are never a prefix of each other (a longer one holds more inserts), so the
least string of a composition is composed of least strings.

Defined results: null role and text are empty; a role without one of the initials s, u, a (the empty one
too) can't be kept; rows of one turn (nulls first) are ordered by role, then by the digest of their text;
repeated rows are duplicates of the first; a null conv_id is a conversation of its own; extra columns
play no part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from .common import cut

#: Rows that a block's signature spells at most, characters of text from which on a block is closed, and blocks composed at a time (a power of two).
BLOCK, BLOCK_CHARS, FAN = 64, 4_000_000, 16
#: Parts that each signature's solution is dealt to, so that a frequent signature meets its blocks in several tasks.
SALTS = 16
WHITE = "\x20\x09-\x0d"
NONE, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: What inserts lead to from each state.
INSERTS = {NONE: ((NONE, ""), (USER, "I"), (ASSISTANT, "II")), SYSTEM: ((SYSTEM, ""), (USER, "I"), (ASSISTANT, "II")), USER: ((USER, ""), (ASSISTANT, "I")), ASSISTANT: ((ASSISTANT, ""), (USER, "I"))}
LEGAL = ("su", "ua", "au")
COSTS = "cost array<int>, audit array<string>"
STATS = "first string, last string, illegal long, least_turn long, most_turn long, turns long, blank long, duplicate long, truncated long"


def _moves(letter: str, state: int) -> Iterator[tuple[str, int, int]]:
    """Edits of one row: initial, cost, next state."""
    yield "D", 4, state
    if letter == "d":
        return
    stays, role = 3 * letter.isupper(), letter.lower()
    if role == "s" and state == NONE:
        yield "K", stays, SYSTEM
    if role == ("a" if state == USER else "u"):
        yield "K", stays, ASSISTANT if state == USER else USER
    yield "R", 3 + stays, ASSISTANT if state == USER else USER


@lru_cache(maxsize=20_000)
def solve(signature: str, state: int) -> tuple[tuple[int, str] | None, ...]:
    """For each state after the signature's rows: the least cost from `state`, and the ASCII-least audit of that cost."""
    best: list[tuple[int, str] | None] = [None] * STATES
    for at, inserted in INSERTS[state]:
        paid = 3 * len(inserted)
        if not signature:
            best[at] = min(best[at] or (paid, inserted), (paid, inserted))
            continue
        for initial, cost, to in _moves(signature[0], at):
            for end, tail in enumerate(solve(signature[1:], to)):
                if tail is not None:
                    whole = paid + cost + tail[0], inserted + initial + tail[1]
                    best[end] = min(best[end] or whole, whole)
    return tuple(best)


def replay(audit: str, state: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each row that remains or is inserted."""
    row = 0
    for edit in audit:
        wanted = "assistant" if state == USER else "user"
        if edit == "I":
            yield edit, wanted, ""
        else:
            role, text = roles[row], texts[row]
            row += 1
            if edit == "D":
                continue
            wanted = role if edit == "K" else wanted
            yield edit, wanted, text
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[wanted[0]]


def _key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("c"), conv_id.cast("string")), F.lit("n"))


def _blocks(rows: DataFrame) -> DataFrame:
    """One row per block, in order (part, seq) within its conversation: signature, counts, and the rows' roles and texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, seq = TaskContext.get().partitionId(), None, 0
        out: list[dict] = []
        block: dict | None = None
        for batch in batches:
            for r in batch.to_pylist():
                if block is None or r["ck"] != key or len(block["roles"]) >= BLOCK or block["chars"] >= BLOCK_CHARS:
                    if block is not None:
                        out.append(block)
                    seq, key = (seq + 1 if r["ck"] == key else 0), r["ck"]
                    block = {"ck": key, "conv_id": r["conv_id"], "part": part, "seq": seq, "signature": [], "first": r["role"][:1], "last": None, "illegal": 0, "least_turn": None, "most_turn": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "roles": [], "texts": [], "chars": 0}
                    if len(out) >= 256 or sum(b["chars"] for b in out[-8:]) > BLOCK_CHARS:
                        yield pa.RecordBatch.from_pylist([b | {"signature": "".join(b["signature"])} for b in out], schema)
                        out = []
                initial = r["role"][:1]
                block["illegal"] += block["last"] is not None and block["last"] + initial not in LEGAL
                if r["turn"] is not None and r["turn"] != block["most_turn"]:
                    block["least_turn"] = r["turn"] if block["least_turn"] is None else block["least_turn"]
                    block["most_turn"] = r["turn"]
                    block["turns"] += 1
                if r["fault"]:
                    block[r["fault"]] += 1
                letter = initial if initial in ("s", "u", "a") else "o"
                block["signature"].append("d" if r["fault"] in ("blank", "duplicate") else letter.upper() if r["fault"] else letter)
                block["last"] = initial
                block["roles"].append(r["role"])
                block["texts"].append(r["text"])
                block["chars"] += len(r["text"]) + 64
        if block is not None:
            out.append(block)
        if out:
            yield pa.RecordBatch.from_pylist([b | {"signature": "".join(b["signature"])} for b in out], schema)

    kind = rows.schema["conv_id"].dataType
    ddl = f"ck string, conv_id {kind.simpleString()}, part long, seq long, signature string, {STATS}, roles array<string>, texts array<string>"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    order = ["ck", "turn", "role", "digest", "row"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("digest", "row").mapInArrow(run, ddl)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tables = [[x for state in range(STATES) for x in solve(s, state)] for s in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[x and x[0] for x in t] for t in tables], pa.list_(pa.int32())), pa.array([[x and x[1] for x in t] for t in tables], pa.list_(pa.string()))], ["signature", "cost", "audit"])


def _compose(group: pa.Table) -> pa.Table:
    """The node of up to FAN consecutive nodes; path spells the states between them for each way through."""
    nodes = sorted(group.to_pylist(), key=lambda n: n["idx"])
    out, table = None, []
    for n in nodes:
        step = [None if c is None else (c, a) for c, a in zip(n["cost"], n["audit"], strict=True)]
        if out is None:
            out = n
            table = [None if x is None else (*x, f"{i // STATES}{i % STATES}") for i, x in enumerate(step)]
            continue
        ways = [[(x[0] + y[0], x[1] + y[1], x[2] + str(q)) for m in range(STATES) if (x := table[p * STATES + m]) and (y := step[m * STATES + q])] for p in range(STATES) for q in range(STATES)]
        table = [min(w, default=None) for w in ways]
        touch = out["most_turn"] is not None and out["most_turn"] == n["least_turn"]
        out = out | {k: out[k] + n[k] for k in ("blank", "duplicate", "truncated")} | {"illegal": out["illegal"] + n["illegal"] + (out["last"] + n["first"] not in LEGAL), "last": n["last"], "turns": out["turns"] + n["turns"] - touch}
        out["least_turn"] = n["least_turn"] if out["least_turn"] is None else out["least_turn"]
        out["most_turn"] = out["most_turn"] if n["most_turn"] is None else n["most_turn"]
    out = out | {"idx": nodes[0]["up"], "cost": [x and x[0] for x in table], "audit": [x and x[1] for x in table], "path": [x and x[2] for x in table], "children": [n["idx"] for n in nodes]}
    out.pop("up")
    return pa.Table.from_pylist([out], pa.schema([(f.name, f.type) for f in group.schema if f.name != "up"] + [("path", pa.list_(pa.string())), ("children", pa.list_(pa.int64()))]))


def _end() -> Column:
    """State that a conversation ends in: nothing or assistant, whichever is cheaper, then of the lesser audit."""
    a, b = (F.struct(F.get("cost", F.lit(i)).alias("c"), F.get("audit", F.lit(i)).alias("a")) for i in (NONE, ASSISTANT))
    return F.when(F.get("cost", F.lit(NONE)).isNull() | (F.get("cost", F.lit(ASSISTANT)).isNotNull() & (b < a)), ASSISTANT).otherwise(NONE)


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), and their repaired blocks.

    A block has conv_id, part and seq (its place, in this order) and rows, an array of (edit, role, text).
    """
    said, spoken = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    rows = turns.select(_key(F.col(conv_id)).alias("ck"), F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), spoken.alias("role"), said.alias("text"), F.sha2(said, 256).alias("digest"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    # only what occurs more than once is joined back; counts meet map-side first
    same = ["ck", "role", "digest"]
    seen = rows.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row")).alias("first")).where("n > 1").select(*same, F.col("first.row").alias("first_row"))
    last = F.regexp_extract("text", rf"([^{WHITE}])[{WHITE}]*\z", 1)
    fault = F.when(~F.col("text").rlike(f"[^{WHITE}]"), "blank").when(F.col("row") != F.col("first_row"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    blocks = cut(_blocks(rows.join(seen, same, "left").select("ck", "conv_id", "turn", "role", "text", "digest", "row", fault.alias("fault"))))

    solved = blocks.groupBy("signature").agg(F.count("*").alias("n")).select("signature").mapInArrow(_solved, f"signature string, {COSTS}")
    solved = solved.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    nodes = blocks.drop("roles", "texts").withColumn("salt", F.pmod(F.xxhash64("ck", "part", "seq"), F.lit(SALTS)).cast("int")).join(solved, ["signature", "salt"]).drop("signature", "salt")
    nodes = cut(nodes)
    many = cut(nodes.groupBy("ck").agg(F.count("*").alias("n")).where("n > 1").select("ck"))
    alone = nodes.join(many, "ck", "left_anti")
    top, places = alone, alone.select("ck", "part", "seq", F.lit(NONE).alias("entry"), _end().alias("exit"))

    if not many.isEmpty():
        width = FAN.bit_length() - 1
        most = blocks.agg(F.max("seq")).first()[0]
        bits = -(-max(1, most.bit_length()) // width) * width
        long = nodes.join(many, "ck", "left_semi").withColumn("idx", F.shiftleft("part", bits) + F.col("seq")).drop("part", "seq")
        kind = blocks.schema["conv_id"].dataType.simpleString()
        levels, level = [], long
        while not levels or not levels[-1].groupBy("ck").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            grouped = level.select("ck", "conv_id", *[x.split()[0] for x in STATS.split(", ")], "cost", "audit", "idx", F.shiftright("idx", width).alias("up"))
            level = cut(grouped.groupBy("ck", "up").applyInArrow(_compose, f"ck string, conv_id {kind}, {STATS}, {COSTS}, idx long, path array<string>, children array<long>"))
            levels.append(level)
        top = top.drop("part", "seq").unionByName(level.drop("idx", "path", "children"))
        down = level.select("ck", "idx", F.lit(NONE).alias("entry"), _end().alias("exit"))
        for level in reversed(levels):
            way = F.get("path", F.col("entry") * STATES + F.col("exit"))
            opened = level.select("ck", "idx", "path", "children").join(down, ["ck", "idx"]).select("ck", way.alias("way"), F.posexplode("children").alias("k", "idx"))
            down = opened.select("ck", "idx", *[F.substring("way", F.col("k") + i, F.lit(1)).cast("int").alias(c) for i, c in ((1, "entry"), (2, "exit"))])
        places = places.unionByName(down.select("ck", F.shiftright("idx", bits).alias("part"), F.col("idx").bitwiseAND((1 << bits) - 1).alias("seq"), "entry", "exit"))

    gaps = F.when(F.col("turns") > 0, F.col("most_turn") - F.col("least_turn") + 1 - F.col("turns")).otherwise(0).cast("long")
    conversations = top.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.get("cost", _end()).cast("long").alias("cost"), F.get("audit", _end()).alias("audit"))
    pieces = places.join(nodes.select("ck", "part", "seq", "audit"), ["ck", "part", "seq"]).select("ck", "part", "seq", "entry", F.get("audit", F.col("entry") * STATES + F.col("exit")).alias("audit"))

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
        for whole in batches:
            for batch in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                done = [[dict(zip(("edit", "role", "text"), x, strict=True)) for x in replay(a, e, r, t)] for e, a, r, t in zip(*(batch.column(i).to_pylist() for i in range(3, 7)), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(done, kind)], ["conv_id", "part", "seq", "rows"])

    joined = blocks.select("ck", "part", "seq", "conv_id", "roles", "texts").join(pieces, ["ck", "part", "seq"]).select("conv_id", "part", "seq", "entry", "audit", "roles", "texts")
    return conversations, joined.mapInArrow(mend, f"conv_id {blocks.schema['conv_id'].dataType.simpleString()}, part long, seq long, rows array<struct<edit: string, role: string, text: string>>")


def digests(blocks: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of each conversation's repaired "role:text" lines, joined by newlines.

    A digest must see its text in order, so a conversation's blocks pass one task, one at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = digest = conv_id = None
        fresh = True
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if digest is None or r["ck"] != key:
                    if digest is not None:
                        done.append((conv_id, digest.hexdigest()))
                    key, conv_id, digest, fresh = r["ck"], r["conv_id"], hashlib.sha256(), True
                if r["said"] is not None:
                    digest.update(("" if fresh else "\n").encode() + r["said"].encode("utf-8", "surrogatepass"))
                    fresh = False
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(kinds)], ["conv_id", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((conv_id, digest.hexdigest()), kinds, strict=True)], ["conv_id", "repaired_sha256"])

    said = F.when(F.size("rows") > 0, F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["role"], r["text"])), "\n"))
    lines = blocks.select(_key(F.col("conv_id")).alias("ck"), "conv_id", "part", "seq", said.alias("said")).repartition("ck").sortWithinPartitions("ck", "part", "seq")
    kind = blocks.schema["conv_id"].dataType
    kinds = (to_arrow_type(kind), pa.string())
    return lines.mapInArrow(run, f"conv_id {kind.simpleString()}, repaired_sha256 string")
