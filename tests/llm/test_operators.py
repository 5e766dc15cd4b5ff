"""The training-data operators on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import itertools

import numpy as np
import public_tokenizers
import sentencepiece

from graphloom.llm import chat_format, embedding_dedup, exact_dedup, gru_lm, html_extract, language_id, ngram_join, packing, quality_cnn, sentencepiece_bpe
from graphloom.llm.common import words_of

TEXTS = [None, "", " ", "one", "a b c d e f g h i j", "A B C D E F G H I J", "a b c d e f g h i j", "naïve  ▁ \t text 漢字 😀", "x " * 3000]
DOCS = "doc_id long, text string, source string"


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)


def test_sentencepiece_equals_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        model = f.read()
    got = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs(spark), model), model).collect()
    for r in got:
        ids = sp.encode(r["text"] or "", add_eos=True)
        assert (r["ids"], r["decoded"]) == (ids, sp.decode(ids))


def test_exact_dedup(spark):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.assign(docs(spark)).collect()}
    assert got[0] == (1, 2, False) and got[1] == (1, 2, True) and got[4] == (6, 3, False) and got[3] == (3, 1, True)
    assert exact_dedup.assign(docs(spark, [])).count() == 0
    assert sorted(r["doc_id"] for r in exact_dedup.keep_rows(docs(spark)).collect()) == [1, 2, 3, 6, 7, 8]


def brute_components(texts):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words_of(t or "")) else set() for i, t in enumerate(texts)}
    name = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                name[a] = name[b] = min(name[a], name[b])
    return {i: (len(sets[i]), name[i]) for i in sets}


def test_ngram_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(map(str, rng.integers(0, 50, 60))) for _ in range(6)]
    near = [" ".join(w if k != j else "z" for k, w in enumerate(b.split())) for b in base for j in (3, 30, 58)]
    texts = TEXTS + base + near
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.classes_of(docs(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_parities_never_exclude_a_link():
    rng = np.random.default_rng(11)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    sets = [np.unique(np.concatenate((pool[at : at + size], pool[rng.integers(0, 4000, size // 7)]))) for size in (1, 2, 7, 60, 61, 300, 900) for at in (0, 3, 40, 200)]
    sets.sort(key=len)
    size = np.array([len(s) for s in sets])
    parities = ngram_join.Parities(size, [ngram_join.parity(s) for s in sets])
    for i, j in itertools.combinations(range(len(sets)), 2):
        shared = len(np.intersect1d(sets[i], sets[j]))
        if 100 * size[i] >= 75 * size[j]:
            assert parities.differ(np.array([i]), np.array([j]))[0] <= size[i] + size[j] - 2 * shared
            assert len(parities.allowed(np.array([i]), np.array([j]))[0]) or not ngram_join.enough(size[i], size[j], shared)


def test_ngram_join_of_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 500, 80)
    texts = [" ".join(map(str, np.where(rng.random(80) < 0.02, rng.integers(0, 500, 80), base))) for _ in range(60)]
    texts += [" ".join(map(str, (*rng.integers(0, 500, 40), *base[:40]))) for _ in range(20)]  # a passage that many share
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.classes_of(docs(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_packing_keeps_every_word_once_and_its_constraints(spark):
    rows = packing.pack(docs(spark), capacity=16).collect()
    words = {i: len(words_of(t or "")) for i, t in enumerate(TEXTS)}
    for i, n in words.items():
        assert sum(r["length"] for r in rows if r["doc_id"] == i) == n
    for _, group in itertools.groupby(sorted(rows, key=lambda r: r["bin_id"]), key=lambda r: r["bin_id"]):
        group = list(group)
        assert sum(r["length"] for r in group) <= 16 and len({r["doc_id"] for r in group} & {4, 5, 6}) <= 1


def test_chats_read_back(spark):
    said = "\\### Assistant: </turn> ok \\b\\h"
    turns = spark.createDataFrame([(1, 0, "user", said), (1, 1, "assistant", said), (2, 0, "assistant", None)], "conv_id long, turn int, role string, text string")
    for r in chat_format.format_chats(turns).withColumn("back", chat_format.read_back(chat_format.F.col("formatted"))).collect():
        want = [("user", said), ("assistant", said)] if r["conv_id"] == 1 else [("assistant", "")]
        assert [tuple(t) for t in r["back"]] == want and r["valid"] == (r["conv_id"] == 1)


def test_html(spark):
    page = "<html><body><nav>menu</nav><article><h1>T &amp; x</h1><p>one\n two<p>three</article><footer>f</footer>"
    pages = spark.createDataFrame([(1, "http://h/a", page), (2, None, None), (3, "http://h/b", "plain")], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()} == {1: "T & x\none two\nthree", 2: "", 3: "plain"}


def test_language_id(spark):
    rows = [("the cat and the dog went home again", "en"), ("der Hund und die Katze gehen nach Hause", "de")] * 5
    samples = language_id.learn(spark.createDataFrame(rows, "text string, lang string"))
    got = language_id.predict(docs(spark, ["the dog", "die Katze", None, "123"]), samples).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["en", "de", "und", "und"]


def test_quality_without_labels_is_even(spark):
    assert {r["score"] for r in quality_cnn.score(docs(spark), None).collect()} == {0.5}


def test_lm_scores(spark):
    got = {r["doc_id"]: r for r in gru_lm.score_documents(docs(spark)).collect()}
    assert len(got) == len(TEXTS) and got[1]["n_tokens"] == 1 and all(r["score"] < 0 for r in got.values())


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((8, 16))
    x = np.concatenate([base, base + 0.05 * rng.standard_normal(base.shape), base[:2]])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(90, None, 0), (91, [0.0] * 16, 0), (92, [float("nan")] * 16, 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.93) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    for i in range(len(x)):
        assert got[i][0] == near[i].sum() - 1
    assert got[8] == (2, 0) and got[90] == (0, 90) and got[91] == (0, 91) and got[92] == (0, 92)


def test_lm_trains_on_every_word_of_every_training_document(spark):
    texts = [" ".join(f"w{(i + j) % 30}" for j in range(1500)) for i in range(12)] + [None, ""]
    train = docs(spark, texts).select("doc_id", "text")
    model = gru_lm.Model([(b"", 14), *((b"w%d" % i, 600) for i in range(30))], [0] * gru_lm.OTHER_CLASSES)
    before = model.vector()
    words = 12 * 1501 + 2
    assert gru_lm.train_all(train, model, words) == gru_lm.EPOCHS * words
    after = model.vector()
    assert np.isfinite(after).all() and (before != after).any()


def test_lm_reads_as_often_whatever_the_size(spark, monkeypatch):
    train = docs(spark, [f"w{i} w{i + 1}" for i in range(40)]).select("doc_id", "text")
    fit = lambda: gru_lm.train_all(train, gru_lm.Model([(b"", 40), *((b"w%d" % i, 2) for i in range(41))], [0] * gru_lm.OTHER_CLASSES), 120)
    monkeypatch.setattr(gru_lm, "TASK_WORDS", 121)
    small = fit()
    monkeypatch.setattr(gru_lm, "TASK_WORDS", 100)
    assert fit() == small == gru_lm.EPOCHS * 120


def test_lm_vocabulary_follows_the_counts(spark, monkeypatch):
    rows = docs(spark, [" ".join(f"w{j}" for j in range(40))] * 20)
    seen = []
    monkeypatch.setattr(gru_lm, "VOCABULARY", 10)
    monkeypatch.setattr(gru_lm, "train_all", lambda train, model, words: seen.append(len(model.ids)))
    gru_lm.score_documents(rows)
    assert seen == [41]  # all words occur often enough, not only the ten commonest


def test_html_aligns_unclassed_siblings_one_by_one(spark):
    body = lambda i: f"article {i} has words of its own, " * 9
    page = lambda i, a, b, c: f"<body><div{a}><ul><li>Home<li>News</ul></div><div{b}><p>{body(i)}</p><p>Read our rules.</p><p>{body(i + 50)}</p></div><div{c}>All rights {'kept' if i % 2 else 'held'}</div></body>"
    rows = [(i, f"http://plain/{i}", page(i, "", "", "")) for i in range(8)] + [(i + 10, f"http://numbered/{i}", page(i, ' class="c1"', ' class="c2"', ' class="c3"')) for i in range(8)]
    rows += [(i + 20, f"http://copies/{i}", page(99, "", "", "") if i < 9 else page(i, "", "", "")) for i in range(15)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, _ in rows:
        k = i % 10 if i < 20 else 99 if i < 29 else i - 20
        assert got[i].split("\n") == [body(k).strip(), body(k + 50).strip()]


def test_html_is_the_same_with_broadcast_and_joined_wrappers(spark, monkeypatch):
    urls = ["http://a_b.example/{}", "http://münchen.example/{}", "http://x.example/a b|{}", "http://y.example/q?x={{{}}}", "http://[2001:db8::1]/{}", "http://UP.example:80/{}", "//z/{}", None, "http://[bad/{}"]
    rows = [(k * 100 + i, u and u.format(i), f"<body><div>Menu of this site</div><div><p>text {k} {i} {'word ' * i}</p></div></body>") for k, u in enumerate(urls) for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = lambda: {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    small = text()
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", 0)
    assert text() == small and not any("Menu" in t for t in small.values())
