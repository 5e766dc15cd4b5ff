"""Wrappers decide the main region: pages without any telling element or class, and names that only seem to tell."""

import random

from graphloom.llm import html_extract


def neutral_pages(n, seed=5):
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(400)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    pages, want = [], {}
    for k in range(n):
        section = k % 4
        menu = "".join(f'<div><a href="/{section}/{j}">{words[(section * 37 + j * 11) % 400]} {words[(section * 5 + j) % 400]}</a></div>' for j in range(8))
        parts = [say(5), *[say(rng.randint(8, 60)) for _ in range(rng.randint(2, 9))]]
        body = "".join(f"<div>{p}</div>" for p in parts)
        pages.append((k, f"http://n.example.org/{k}", f"<body><div>{menu}</div><div>{body}</div><div>Imprint of the site, {2000 + k % 7} all rights</div></body>"))
        want[k] = "\n".join(parts)
    return pages, want


def texts(spark, pages):
    return {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}


def test_pages_of_plain_divs_lose_menu_and_imprint(spark):
    pages, want = neutral_pages(40)
    assert texts(spark, pages) == want
    # alone, a page tells nothing of its parts
    assert texts(spark, pages[:1])[0] != want[0]


def test_the_result_does_not_hang_on_word_lists(spark, monkeypatch):
    pages = [(k, f"http://h.example.org/{k}", f'<body><nav><a href="/{k}">m{k} n{k}</a></nav><div class="ad">buy {k}</div><article><h1>Title {k}</h1><p>{"text %d " % k * (20 + k)}</p><p>more {k}</p></article><footer>Imprint {k}</footer></body>') for k in range(24)]
    before = texts(spark, pages)
    assert before[3] == "Title 3\n" + " ".join(["text 3"] * 23) + "\nmore 3"
    keep = frozenset("script style noscript template button select option textarea input label iframe object embed svg canvas math audio video map head".split())

    def plain(pages):
        w = None
        for _, _, t in pages:
            run = html_extract.runs([html_extract.parse(t)])
            w = html_extract.new_wrapper(run) if w is None else (html_extract.add_page(w, run), w)[1]
        w = html_extract.finish(w, len(pages))
        return {k: "\n".join(html_extract.blocks(html_extract.parse(t), w)) for k, _, t in pages}

    for name, value in (("DROPPED", keep), ("UNWANTED", frozenset()), ("UNWANTED_ARTICLES", frozenset())):
        monkeypatch.setattr(html_extract, name, value)
    assert plain(pages) == before


def test_class_words_and_forms_that_only_seem_to_tell(spark):
    pages = [
        (1, "http://a/", '<article><h1 class="header">Title</h1><p class="related-work">We follow others.</p><p>End.</p></article>'),
        (2, "http://b/", '<body><div class="share-price"><p>Article text</p></div></body>'),
        (3, "http://c/", "<body><form action='/'><h1>Page</h1><p>All of it.</p><input><label>mail</label></form></body>"),
        (4, "http://d/", '<body><p>Text.</p><form><p>Subscribe now</p><input></form><div class="comment-list"><p>first!</p></div><div class="site-footer">foot</div></body>'),
    ]
    assert texts(spark, pages) == {1: "Title\nWe follow others.\nEnd.", 2: "Article text", 3: "Page\nAll of it.", 4: "Text."}


def test_a_very_long_page(spark):
    long = "<body><article>" + "<p>paragraph of text</p>" * 40_000 + "</article></body>"
    assert texts(spark, [(1, "http://a/", long)])[1].count("\n") == 39_999
