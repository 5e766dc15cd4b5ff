"""Ranked search, secret scans and conversation repair against plain versions."""

import hashlib
import heapq
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import conversation_repair, queries, secret_scan, treap_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_ranks(docs, items, k=20):
    words = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    words = [(d, w) for d, w in words if w]
    n, length = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for d, w in words:
            tf, m = Counter(w), 75 + (25 * len(w) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in TERM.findall((text or "").translate(LOWER)) if t in tf)
            if score > 0:
                scores.append((-score, d is not None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(heapq.nsmallest(k, scores))]
    return out


def test_search_equals_plain_ranking(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Äpfel", "naïve", "漢字"]
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=np.arange(63, 0, -1) / 2016))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, "--- !!"), (None, docs[3][1]), (503, "W1,w1;W1-w2"), (3, docs[3][1])] + [(600 + i, docs[7][1]) for i in range(40)]
    items = [(0, text(12)), (1, docs[7][1]), (2, None), (3, "unknown words"), (4, "w0"), (4, "w0 w0 w1"), (None, text(90))]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(plain_ranks(docs, items), key=repr)
    for shard, block, dense in ((2048, 10**6, 8 * 10**6), (37, 20, 0)):
        monkeypatch.setattr(treap_search, "SHARD_DOCS", shard)
        monkeypatch.setattr(treap_search, "BLOCK_TERMS", block)
        monkeypatch.setattr(treap_search, "DENSE", dense)
        got = treap_search.rank(d, q)
        assert sorted(map(tuple, got.collect()), key=repr) == want
    clash = d.select("*", *[d.doc_id.alias(c) for c in ("n", "ids", "score", "query", "rank")])
    assert sorted(map(tuple, treap_search.rank(clash, q).collect()), key=repr) == want


def test_search_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert treap_search.rank(none, items).count() == 0
    assert treap_search.rank(some, items.limit(0)).count() == 0
    assert [tuple(r) for r in treap_search.rank(some, items).collect()] == [(1, 1, 1, 287 * (10**9 // (1000 + 12 * 100)))]


def test_treaps_are_heaps_by_impact_and_prune():
    rng = np.random.default_rng(2)
    term = np.sort(rng.integers(0, 30, 4000))
    pairs = np.unique(term * 500 + rng.integers(0, 500, 4000))
    term, doc = pairs // 500, pairs % 500
    impact = rng.integers(1, 40, len(pairs))
    t = treap_search.Treaps(term, doc, impact, 30, 500)
    reached = 0

    def walk(node, lo, hi):
        nonlocal reached
        if node == len(pairs):
            return
        reached += 1
        assert lo <= t.doc[node] < hi
        for child in (t.left[node], t.right[node]):
            assert child == len(pairs) or t.impact[child] <= t.impact[node]
        walk(t.left[node], lo, t.doc[node])
        walk(t.right[node], t.doc[node] + 1, hi)

    for r in t.root[:30]:
        walk(r, 0, 500)
    assert reached == len(pairs)
    best = treap_search.Best(1, 5)
    scored = treap_search.search(t, np.arange(500), np.array([[0, 1]]), np.array([[7, 3]]), best)
    assert scored < 150  # of 500 documents; the rest is pruned
    weights = Counter()
    for x, d, i in zip(term, doc, impact, strict=True):
        weights[int(d)] += {0: 7, 1: 3}.get(int(x), 0) * int(i)
    assert list(zip(best.score[0], best.doc[0], strict=True)) == [(s, d) for s, d in sorted(((s, d) for d, s in weights.items()), key=lambda x: (-x[0], x[1]))[:5]]


# secrets

HEXES = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(400)]


def plain_base(text):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for kind, (name, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)), 1):
        out += [(m.start(), kind, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return ",".join(x[2] for x in sorted(out))


@pytest.fixture(scope="module")
def secret_rows():
    base32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    key = lambda i: "AKIA" + "".join(base32[b % 32] for b in hashlib.sha256(str(i).encode()).digest()[:16])
    rows = [(i, f"some words of no weight password={HEXES[i][:18]} and more") for i in range(60)]
    rows += [(100 + i, f'einzelne Wörter und token = "{HEXES[i]}" donaudampfschiffahrten') for i in range(60, 120)]
    rows += [(300 + i, f"internationalization {key(i)} of characteristically long words, mail9.example.com, 4349{i:012d}") for i in range(60)]
    rows += [(1000, "a bare " + HEXES[300][:18] + " without its word"), (1001, None), (1002, ""), (1003, "ſecret=abcdefgh TOKEN : 'ab token=token : abcdefgh AKIAAKIA AKIA" + "Q" * 16), (1004, "telecommunications 4349000490986231 mail3.example.com incomprehensibilities"), (1005, "x" * 1_000_000 + " " + HEXES[1]), (1000, "a bare " + HEXES[300][:18] + " without its word"), (None, "API_KEY:" + HEXES[5])]
    return rows


def test_secret_spans_equal_the_patterns_and_grammars_add_formats(spark, secret_rows):
    docs = spark.createDataFrame(secret_rows, "doc_id long, text string").repartition(3)
    model = secret_scan.learn(docs)
    assert set(model.kinds) == {"assign", "access", "hex"}
    got = secret_scan.scan(docs.select("*", docs.doc_id.alias("spans"), docs.doc_id.alias("kind")), model).collect()
    assert len(got) == len(secret_rows)
    texts = dict(secret_rows)
    added = {}
    for r in got:
        text = texts[r["doc_id"]] or ""
        spell = lambda spans: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)
        assert spell([s for s in r["spans"] if s["kind"] != "format"]) == plain_base(text)
        for s in r["spans"]:
            if s["kind"] == "format":
                added.setdefault(r["doc_id"], []).append(text[s["start"] : s["end"]])
    assert added == {1000: [HEXES[300][:18]] * 2}  # the bare value, and no word, number or address


def test_secret_scans_without_labels_and_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = secret_scan.learn(none)
    assert not model.kinds and secret_scan.scan(none, model).count() == 0
    assert secret_scan.spans_of("x " + HEXES[0], model) == [("hex", 2, 42, None)]


def test_grammar_inference_keeps_lengths_and_generalises():
    a = secret_scan.infer(["h" * 18] * 200)
    assert a.likelihood("h" * 18) > -0.1 and a.likelihood("h" * 17) < -8 and a.likelihood("h" * 19) < -8
    rng = np.random.default_rng(1)
    b = secret_scan.infer(["m" * int(n) + "." + "m" * 5 for n in rng.geometric(0.2, 500)])
    assert len(b.ends) < 12  # the loop before the dot is one state or a few
    assert abs(sum(math.exp(b.likelihood("m" * n + "." + "m" * 5)) for n in range(1, 60)) - 1) < 0.1
    assert len(secret_scan.infer([]).ends) == 1


# conversations


def plain_repair(rows):
    """rows in order: (turn, role, text). Shortest path over (row, state), the least (cost, audit) first."""
    codes, faults, seen = [], Counter(), set()
    for _, role, text in rows:
        solid = text.strip(" \t\n\v\f\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        codes.append((role[:1], fault))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return faults, sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(codes)), cost, audit, "\n".join(out)
        if (i, last) in done:
            continue
        done.add((i, last))
        want, name = ("a", "assistant") if last == "u" else ("u", "user")
        heapq.heappush(heap, (cost + 3, audit + "I", i, want, (*out, f"{name}:")))
        if i < len(rows):
            initial, fault = codes[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, out))
            if fault not in ("blank", "duplicate"):
                stays = 3 * (fault == "truncated")
                if initial == want or (initial == "s" and last == ""):
                    heapq.heappush(heap, (cost + stays, audit + "K", i + 1, initial, (*out, f"{rows[i][1]}:{rows[i][2]}")))
                heapq.heappush(heap, (cost + stays + 3, audit + "R", i + 1, want, (*out, f"{name}:{rows[i][2]}")))


def conversations(seed, n, longest):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        turn = 0
        for _ in range(int(rng.integers(1, longest + 1))):
            turn += int(rng.integers(1, 3))
            rows.append((c, turn, str(rng.choice(["system", "user", "assistant", "tool", ""], p=[0.1, 0.4, 0.4, 0.05, 0.05])), str(rng.choice(["Fine.", "Yes!", "cut", "", " \t", "Was? ", "More, ü.", "B.", "C?", "D.", "E."]))))
    return rows


@pytest.mark.parametrize(("block", "longest"), [(64, 9), (4, 9), (2, 150)])
def test_repair_equals_a_shortest_path(spark, monkeypatch, block, longest):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    monkeypatch.setattr(conversation_repair, "FAN", 4)
    rows = conversations(block, 60 if longest < 20 else 8, longest)
    rows += [(900, None, "user", "No turn."), (900, None, "user", "No turn."), (None, 1, "user", "Q?"), (None, 2, "assistant", "A."), (901, 1, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    found, blocks = conversation_repair.repair(turns.select("*", turns.turn.alias("signature"), turns.turn.alias("row"), turns.turn.alias("digest")))
    digests = {r["conv_id"]: r["repaired_sha256"] for r in conversation_repair.digests(blocks).collect()}
    got = {r["conv_id"]: r for r in found.collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own = [(t, role or "", text or "") for c, t, role, text in rows if c == conv]
        faults, illegal, cost, audit, out = plain_repair(own)
        assert (r["cost"], r["audit"], r["illegal"]) == (cost, audit, illegal), own
        assert [r[k] for k in ("blank", "duplicate", "truncated")] == [faults[k] for k in ("blank", "duplicate", "truncated")]
        t = {x for x, _, _ in own if x is not None}
        assert r["gaps"] == (max(t) - min(t) + 1 - len(t) if t else 0)
        assert digests[conv] == hashlib.sha256(out.encode()).hexdigest()


def test_repair_of_nothing(spark):
    found, blocks = conversation_repair.repair(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))
    assert found.count() == 0 and blocks.count() == 0 and conversation_repair.digests(blocks).count() == 0


def test_repair_of_very_long_texts_and_one_frequent_conversation(spark):
    rows = [(c, t, role, text) for c in range(300) for t, role, text in ((0, "user", "Hi?"), (1, "assistant", "Hello."))] + [(1000, 0, "user", "long " * 400_000), (1000, 1, "user", "x" * 5_000_000 + ".")]
    found, blocks = conversation_repair.repair(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {r["conv_id"]: (r["audit"], r["cost"]) for r in found.collect()}
    assert got[1000] == ("DIK", 7) or got[1000][1] == 6 and len(got) == 301
    assert {got[c] for c in range(300)} == {("KK", 0)}
    assert blocks.count() == 301 or blocks.count() == 302


def test_damage_follows_the_digest_of_conversation_and_turn(spark):
    rows = [(c, t, "assistant", "A. B! C?") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = Counter(tuple(r) for r in queries.damaged(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect())
    want = Counter()
    for c, t, role, text in rows:
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", " " if text is None else text
        if how:
            want[c, t, "user" if how == 4 else role, "" if how == 1 else "A B C" if how == 2 and text != " " else text] += 1 + (how == 3)
    assert got == want
