"""Substring joins: automata over arrays, in one part or several, equal plain containment."""

import numpy as np

from graphloom.operators import contains


def test_needles_of_all_kinds_equal_plain_containment(spark, monkeypatch):
    texts = ["xabc de", "ab", " ab c", "a  b", "", None, "zz", "q ab", "über 漢字 😀 ab", "one two three four", "x" * 5000 + "abc"]
    needles = ["ab", "a", "c", " ab", "abc d", " ", "  ", "bc de", "xabc", "zzz", "漢字 😀", "e two three f", None, "", "abcabc", "ab"]
    left = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    right = spark.createDataFrame([(n,) for n in needles], "needle string")
    rows = lambda: sorted((r["i"], r["needle"], r["at"]) for r in contains.containment_join(left, right, "text", "needle", place="at").collect())
    want = sorted((i, n, t.index(n) + 1) for i, t in enumerate(texts) for n in needles if n and t and n in t)
    assert rows() == want
    monkeypatch.setattr(contains, "AUTOMATON", 6)
    monkeypatch.setattr(contains, "STREAM", 10)
    monkeypatch.setattr(contains, "WINDOW", 3)
    assert rows() == want
    assert contains.containment_join(left, right.limit(0), "text", "needle").count() == 0


def test_automaton_of_many_paths_with_one_prefix():
    paths = [f"src/deep/folder/module_{i}.ts" for i in range(100_000)]
    automaton = contains.Automaton(paths)
    text, needle, at = automaton.matches(["see src/deep/folder/module_7.ts and src/deep/folder/module_99999.ts.", "nothing src/deep/folder/ here"])
    assert [(int(t), automaton.needles[n], int(a)) for t, n, a in zip(text, needle, at, strict=True)] == [(0, paths[7], 4), (0, paths[99999], 36)]


def test_random_texts():
    rng = np.random.default_rng(4)
    make = lambda n: "".join(rng.choice(list("abc"), n))
    needles = sorted({make(int(rng.integers(1, 6))) for _ in range(60)})
    texts = [make(int(rng.integers(0, 300))) for _ in range(20)]
    automaton = contains.Automaton(needles)
    got = {(int(t), automaton.needles[n]): int(a) for t, n, a in zip(*automaton.matches(texts), strict=True)}
    assert got == {(i, n): t.index(n) for i, t in enumerate(texts) for n in needles if n in t}
