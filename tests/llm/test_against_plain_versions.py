"""The training-data operators against plain Python versions of the same definitions."""

import math
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest

from graphloom.llm import embedding_dedup, gru_lm, language_id, ngram_join, packing, quality_cnn
from graphloom.llm.common import words_of
from tests.llm.test_operators import TEXTS, brute_components, docs


def components_of(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_ngram_join_of_copies_around_the_threshold_in_several_tiles(spark, monkeypatch):
    """Near copies whose pairs lie on both sides of 0.75, so that pairs stay open until the tiles."""
    monkeypatch.setattr(ngram_join, "TILE", 20)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 900, 120)
    texts = [" ".join(map(str, np.where(rng.random(120) < rng.choice([0.01, 0.02, 0.03]), rng.integers(0, 900, 120), base))) for _ in range(90)]
    texts += [" ".join(map(str, (*base[:60], *rng.integers(0, 900, 22)))) for _ in range(40)]
    assert components_of(ngram_join.classes_of(docs(spark, texts))) == brute_components(texts)


def test_ngram_join_keeps_one_row_of_each_component(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(40)) for p in "abc")
    near = a.replace("a39", "z")
    rows = [(5, a, 1), (5, c, 2), (7, near, 3), (None, b, 4), (None, b + " b", 5), (9, b, 6), (3, "", 7), (3, None, 8), (5, a, 9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, gone_id int").withColumnRenamed("gone_id", "text_key")
    kept = ngram_join.keep_rows(table)
    assert kept.columns == ["doc_id", "text", "text_key"]
    got = sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["text"])
    assert got == [(5, a), (5, c), (9, b)] and kept.where("text is null or text = ''").count() == 2


def test_packing_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(2)
    for _ in range(20):
        pieces = sorted(zip(rng.integers(0, 60, 150).tolist(), rng.integers(0, 4, 150).tolist(), [None if x == 9 else x for x in rng.integers(0, 10, 150).tolist()], strict=True), key=lambda x: -x[0])
        bins, want = [], []
        for n, s, c in pieces:
            fits = [(room - n, k) for k, (room, sources, clusters) in enumerate(bins) if room >= n and sources[s] < 3 and (c is None or c not in clusters)]
            k = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append([100, Counter(), set()])
            bins[k][0] -= n
            bins[k][1][s] += 1
            bins[k][2].add(c)
            want.append(k)
        assert packing.best_fit(*zip(*pieces, strict=True), 100, 3) == want


def test_packing_of_null_clusters(spark):
    rows = spark.createDataFrame([(i, "a b c", None if i < 20 else "x", "s") for i in range(24)], "doc_id long, text string, c string, source string")
    got = packing.pack(rows, cluster="c", source=None, per_source=100).collect()
    assert len({r["bin_id"] for r in got}) == 4  # only those of one cluster part


def cross_parse(sample, text):
    """Phrases of the greedy parse: each the longest that occurs in the sample, or one unknown character."""
    n, at, open_ = 1, 0, ""
    for c in text:
        if open_ + c in sample:
            open_ += c
        else:
            n += 1
            open_ = c if c in sample else ""
    return n


def test_language_id_equals_a_plain_parse(spark):
    rng = np.random.default_rng(1)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    han = "".join(chr(0x4E00 + i) for i in range(300))
    samples = {"aa": draw("abc de", 700), "bb": draw("cdefg h", 700), "zh": draw(han, 900)}
    texts = [draw("abc de", 2000), draw("cdefg h", 900), draw(han, 700), draw("abcdefgh " + han[:9], 1500), "x", "", samples["aa"][50:650], samples["zh"]]
    parser = language_id.Parser(tuple(samples.items()))
    assert parser.phrases(texts).tolist() == [[cross_parse(s, t) for s in samples.values()] for t in texts]
    got = [r["lang_pred"] for r in language_id.predict(docs(spark, texts), samples).orderBy("doc_id").collect()]
    assert got[:3] == ["aa", "bb", "zh"] and got[6:] == ["aa", "zh"]


def test_language_id_learns_every_language_however_many_copies_it_has(spark):
    rows = [(f"the text number {i} of many in this language", "en") for i in range(300)] + [("ein einziger Text", "de")] * 6000
    samples = language_id.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert set(samples) == {"en", "de"} and samples["de"] == "ein einziger text" and samples["en"].count("\n") == language_id.SAMPLE_DOCS - 1
    assert language_id.learn(spark.createDataFrame([], "text string, lang string")) == {}


def test_lm_counts_and_base_scores_equal_a_plain_version(spark):
    texts = [*TEXTS, "The cat The dog", "the cat", "zebra only here"]
    rows = docs(spark, texts)
    got = {r["doc_id"]: r for r in gru_lm.score_documents(rows).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    counts = Counter(w for i, t in enumerate(texts) if not held[i] for w in [*words_of(t or ""), b""])
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        words = [*words_of(t or ""), b""]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)


def test_lm_score_equals_a_word_by_word_version():
    """The lanes, windows and carried states against one document and one word at a time."""
    rng = np.random.default_rng(3)
    model = gru_lm.Model([(b"", 40), *((b"w%d" % i, 400 - i) for i in range(200))], [3] * gru_lm.OTHER_CLASSES)
    for name, w in model.p.items():
        model.p[name] = (w + 0.2 * rng.standard_normal(w.shape)).astype(np.float32)
    texts = [[*rng.integers(0, len(model.cls), n).tolist(), model.ids[b""]] for n in (0, 1, 7, 300, 900)]
    p, k = model.p, model.hidden
    for ids, got in zip(texts, model.score([np.array(t, np.int32) for t in texts]), strict=True):
        h, before, total = np.zeros(k), model.ids[b""], 0.0
        for y in ids:
            a, u = p["X"][before].astype(float) + p["b"], h @ p["U"]
            z, r = (1 / (1 + np.exp(-(a[i : i + k] + u[i : i + k]))) for i in (0, k))
            h = (1 - z) * np.tanh(a[2 * k :] + r * u[2 * k :]) + z * h
            s = h @ p["C"] + p["c"]
            c = model.cls[y]
            lo, hi = model.start[c], model.start[c + 1]
            w = p["W"][lo:hi] @ h + p["w"][lo:hi]
            total += s[c] - np.log(np.exp(s).sum()) + (w[y - lo] - np.log(np.exp(w).sum()) if hi - lo > 1 else 0)
            before = y
        assert got == pytest.approx(total, rel=1e-3, abs=1e-3)


def test_quality_on_rows_it_has_not_seen(spark):
    rng = np.random.default_rng(4)
    good = lambda: " ".join(rng.choice(["meadow", "river", "harvest", "window", "letter", "garden"], 60))
    bad = lambda: " ".join(rng.choice(["buy", "$$$", "click!!", "w1n", "FREE", "0ff"], 60))
    rows = [(i, good() if i % 2 else bad(), i % 2) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    network = quality_cnn.learn(table.where("doc_id < 300"), table.where("doc_id < 300").select("doc_id", "quality"))
    got = {r["doc_id"]: r["score"] for r in quality_cnn.score(table.drop("quality"), network).where("doc_id >= 300").collect()}
    assert all((s >= 0.5) == bool(i % 2) for i, s in got.items())
    # a text is the mean of its chunks by their bytes: a copy twice in a row scores like one
    again = quality_cnn.score(docs(spark, [rows[1][1], None, ""]), network).orderBy("doc_id").collect()
    assert again[0]["score"] == pytest.approx(got.get(1, again[0]["score"])) and again[1]["score"] == again[2]["score"]


def test_embedding_recall_with_several_bits_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 40)
    monkeypatch.setattr(embedding_dedup.plan, "__defaults__", (embedding_dedup.THRESHOLD, embedding_dedup.RECALL, 16))
    assert embedding_dedup.plan(1200)[0] >= 5
    rng = np.random.default_rng(6)
    base = rng.standard_normal((300, 32))
    dense = base[0] + 0.12 * rng.standard_normal((300, 32))  # a third of all in one group
    x = np.concatenate([base, base + 0.3 * rng.standard_normal(base.shape), dense])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    found, there = sum(n for n, _ in got.values()), int(near.sum())
    assert 0.99 * there <= found <= there and all(got[i][0] <= near[i].sum() for i in range(len(x)))


def test_pipeline_equals_its_definition(spark, tmp_path):
    rng = np.random.default_rng(9)
    en = "the of and to in that was his he it with is for as had you not be her on at by which have or from this him but all she they were my are me one their so an said them we who would been will no when there".split()
    de = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder".split()
    say = lambda words, n=60: " ".join(rng.choice(words, n))
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        rows.append((i, ("!!! $$$ 0x7 %% ## " * 12 + say(["zz9", "qq##", "@@", "1f$"], 40)) if bad else say(en if i % 2 else de), "en" if i % 2 else "de", f"s{i % 4}", 0))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(not bad), 0))
    clean = [r for r in rows if r[0] % 3]
    rows += [(1000 + k, r[1], r[2], r[3], 0) for k, r in enumerate(clean[:10])]  # exact copies, later ids stay
    rows += [(2000 + k, r[1] + " x", r[2], r[3], 0) for k, r in enumerate(clean[20:30])]  # near copies, least ids stay
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in got}
    want = {r[0] for r in clean} - {r[0] for r in clean[:10]} | {1000 + k for k in range(10)}
    assert kept == want
    words = {r[0]: len(words_of(r[1])) for r in rows}
    length, used, bins = Counter(), Counter(), defaultdict(Counter)
    source = {r[0]: r[3] for r in rows}
    for r in got:
        length[r["doc_id"]] += r["length"]
        used[r["bin_id"]] += r["length"]
        bins[r["bin_id"]][source[r["doc_id"]]] += 1
    assert length == {i: words[i] for i in want} and max(used.values()) <= packing.CAPACITY
    assert all(max(c.values()) <= packing.PER_SOURCE for c in bins.values())
