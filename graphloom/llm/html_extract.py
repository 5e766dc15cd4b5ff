"""Main text of web pages by wrapper induction.

Pages become trees of block elements; siblings are aligned one by one, in order, where equal texts come
before equal classes and those before equal tags (classes are compared whole, then without digits). Only
paragraphs, headings and items of lists and tables of one label are folded into one node; a wrapper counts
the texts of all its nodes' parts, so a part that stays the same among varying ones is template too. The trees of a host's
pages are aligned one after the other by simple tree matching, first within tasks, then the partial
wrappers of a host with each other. A wrapper's node knows in how many pages it occurs, whether its
text ever changes and how much of it is link text. Nodes that stay constant over enough different pages
are the site's template; varying slots in the main region are content. Elements whose kind or class
says menu, header, footer, sidebar, notice, advert, form or reader comment are never content.

The main region is a slot of the wrapper: from the root down, the child that holds REGION_SHARE of the varying text that is not
links, for as long as there is one; an article or main element on that way is taken as it is, with its title. Where a host has too few different pages
to compare, the page's own article or main element is the region, or else the whole page.

Class words count for boxes only, and only where every other word of the class is a neutral one ("site-header", not "related-work"); a
form that holds an article or headings is a frame around the page and no form.

Defined results: null or empty html gives "" ; a page without tags is one block of text; pages without
a host share the empty host; a host with one page (or only copies of it) has no template, and only the
element rules apply; repeated pages get the same text; other columns pass through. Unclosed and
unknown tags are tolerated; elements nested deeper than MOST_DEPTH are blocks of their ancestor, or dropped with it where
their kind or class says so.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, text_slices, without

#: Different pages over which a slot must stay constant to be template, and the share of the host's pages that must have it.
CONSTANT_PAGES, CONSTANT_SHARE = 5, 0.5
#: Share of the varying text that the main region must hold where no element names it.
REGION_SHARE = 0.6
MOST_DEPTH, MOST_NODES, MOST_CELLS = 60, 1500, 40_000
#: Different texts of a node's parts that are counted at a time; beyond them all counts fall alike (frequent ones stay).
MOST_SEEN = 4096
#: Elements whose like siblings are one node.
FOLDED = frozenset("p li dt dd tr td th h1 h2 h3 h4 h5 h6 pre blockquote".split())
#: Wrappers are broadcast up to this size in all, otherwise joined by host.
BROADCAST_BYTES = 32_000_000

# Element names of the HTML standard by role.
DROPPED = frozenset("script style noscript template nav footer aside button select option textarea input label iframe object embed svg canvas math head dialog menu audio video map fieldset".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tbody", "tfoot"), "tbody": ("thead", "tbody"), "tfoot": ("tbody",), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}
# Words of class, id and role names that mark what is not the article.
UNWANTED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar topbar toolbar breadcrumb breadcrumbs sidebar aside rail widget widgets footer foot "
    "header masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog subscribe subscription newsletter signup login search form comment comments commentlist disqus respond reply replies "
    "discussion share sharing social follow related recommended recommendations popular trending pagination pager skip copyright contentinfo complementary hidden".split()
)
#: Words that say nothing beside them.
NEUTRAL = frozenset("a b box block area wrap wrapper container content section list item items inner outer main top bottom left right bar links link buttons button icons site page global primary secondary large small wide fixed sticky mobile desktop col column row group panel module unit slot text the and my post entry article blog news for of in on".split())
#: Blocks of text: what their class says never takes them out.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote article main body html".split())
UNWANTED_ARTICLES = frozenset("ad ads advert sponsored promo comment comments reply replies related recommended teaser".split())

TAG = re.compile(r"<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z))", re.S)
NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Node:
    __slots__ = ("tag", "label", "name", "unwanted", "items", "links", "_whole")

    def __init__(self, tag: str, name: str, unwanted: bool):
        self.tag, self.label, self.name, self.unwanted = tag, re.sub(r"\d+", "", name) if "." in name else name, name, unwanted
        self._whole: int | None = None
        self.items: list = []  # texts and nodes, in page order
        self.links = 0  # characters of link text directly inside

    def whole(self) -> int:
        """A digest of all text below; 0 without text."""
        if self._whole is None:
            parts = [x.strip() if isinstance(x, str) else f"\0{x.tag}{x.whole()}" if x.whole() else "" for x in self.items]
            own = "\n".join(x for x in parts if x)
            self._whole = xxhash.xxh3_64_intdigest(own.encode("utf-8", "replace")) & (2**53 - 1) if own else 0
        return self._whole


def _marks(tag: str, attributes: str) -> tuple[str, bool]:
    """A node's name (its tag and whole class), and whether its names say that it is no content."""
    label, unwanted = tag, tag in DROPPED
    for m in NAMES.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            unwanted = True
        elif name in ("class", "id", "role"):
            kinds = UNWANTED_ARTICLES if tag in ("article", "main") else UNWANTED
            for token in value.split() if tag in ("article", "main") or tag not in TEXTS else ():
                words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", token)]
                if any(w in kinds for w in words) and all(w in UNWANTED or w in NEUTRAL for w in words):
                    unwanted = True
            if name == "class":
                label += "." + value
    return label, unwanted


def parse(page: str) -> Node:
    """The page's tree of block elements; inline elements dissolve into their block unless they are unwanted."""
    root = Node("#page", "#page", False)
    stack, inline = [root], []
    deep: list[tuple[str, bool]] = []  # open elements below MOST_DEPTH, and whether they are unwanted
    at, end = 0, len(page)

    def text(raw: str) -> None:
        if raw and not any(unwanted for _, unwanted in deep):
            raw = entities.unescape(raw) if "&" in raw else raw
            stack[-1].items.append(raw)
            if "a" in inline:
                stack[-1].links += len(raw)

    def leave(k: int) -> None:
        del stack[k:]
        inline.clear()

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE and stack[-1].tag != tag:
                if tag in inline:
                    del inline[len(inline) - 1 - inline[::-1].index(tag) :]
                continue
            if (k := max((k for k, (t, _) in enumerate(deep) if t == tag), default=-1)) >= 0:
                del deep[k:]
                stack[-1].items.append(Node(tag, tag, False))
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    leave(k)
                    deep.clear()
                    break
            continue
        if tag in ("br", "wbr"):
            stack[-1].items.append(" " if tag == "br" else "")
            continue
        if tag in VOID and tag != "hr":
            continue
        label, unwanted = _marks(tag, m[3] or "")
        if tag == "header" and not any(n.tag in ("article", "main") for n in stack):
            unwanted = True  # the page's; an article's own header holds its title
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in INLINE and not unwanted:
            inline.append(tag)
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    leave(k)
                    break
                if stack[k].tag in ("td", "th", "button", "object", "table"):
                    break
        if tag in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SIBLINGS[tag]:
                    leave(k)
                    if tag not in ("tr",):
                        break
                elif stack[k].tag in SCOPE.get(tag, ("table",)):
                    break
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        node = Node(tag, label, unwanted)
        if tag == "hr" or len(stack) > MOST_DEPTH:
            stack[-1].items.append(Node(tag, tag, False))  # a border between blocks
            if tag != "hr":
                deep.append((tag, unwanted))
            continue
        stack[-1].items.append(node)
        stack.append(node)
    _judge_forms(root)
    return root


def _judge_forms(node: Node) -> bool:
    """Mark forms that hold no article and no heading; whether node holds one."""
    todo, order = [node], []
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [x for x in n.items if isinstance(x, Node)]
    holds: set[int] = set()
    for n in reversed(order):
        if n.tag in ("article", "main", "h1", "h2") or any(id(x) in holds for x in n.items if isinstance(x, Node)):
            holds.add(id(n))
        elif n.tag == "form":
            n.unwanted = True
    return id(node) in holds


class Run:
    """Like siblings of a page, as one node of the tree that is aligned."""

    __slots__ = ("label", "name", "unwanted", "nodes", "children", "text", "links")

    def __init__(self, label: str, name: str, unwanted: bool):
        self.label, self.name, self.unwanted, self.nodes, self.children, self.text, self.links = label, name, unwanted, [], [], 0, 0

    def whole(self) -> int:
        return self.nodes[0].whole() if len(self.nodes) == 1 else sum(n.whole() * (2 * i + 1) for i, n in enumerate(self.nodes)) & (2**53 - 1)

    def parts(self) -> set[int]:
        return {x.whole() for n in self.nodes for x in n.items if isinstance(x, Node)} - {0}

    def digest(self) -> int:
        own = "\n".join(x for n in self.nodes for x in n.items if isinstance(x, str) and x.strip())
        return xxhash.xxh3_64_intdigest(own.encode("utf-8", "replace")) & (2**53 - 1) if own else 0


def runs(nodes: list[Node]) -> Run:
    out = Run(nodes[0].label, nodes[0].name, nodes[0].unwanted)
    out.nodes = nodes
    groups: list[list[Node]] = []
    last: dict[str, int] = {}
    for n in nodes:
        out.text += sum(len(x.strip()) for x in n.items if isinstance(x, str))
        out.links += n.links
        place = -1
        for x in n.items:
            if isinstance(x, Node):
                k = last.get(x.label, -1) if x.tag in FOLDED else -1
                if k >= 0 and k >= place:  # later nodes of the run join the groups of the first
                    groups[k].append(x)
                    place = k
                else:
                    last[x.label] = place = len(groups)
                    groups.append([x])
    out.children = [runs(g) for g in groups]
    return out


def new_wrapper(run: Run) -> dict:
    """label, name, unwanted, pages, first digests (own text, all text), whether it varies, text and link characters, pages by part and by all text, children."""
    return {"l": run.label, "f": run.name, "d": run.whole(), "s": {str(x): 1 for x in run.parts()}, "o": {str(run.whole()): 1}, "u": run.unwanted, "n": 1, "h": run.digest(), "v": False, "t": run.text, "a": run.links, "c": [new_wrapper(c) for c in run.children]}


def _seen(counts: dict, more: dict) -> None:
    """Add counts of texts; beyond MOST_SEEN of them the least ones go, the others lose as much."""
    for k, n in more.items():
        counts[k] = counts.get(k, 0) + n
    if len(counts) > MOST_SEEN:
        less = sorted(counts.values(), reverse=True)[MOST_SEEN // 2]
        for k in [k for k, n in counts.items() if n <= less]:
            del counts[k]
        for k in counts:
            counts[k] -= less


def _worth(x, y: dict) -> int:
    """What aligning two nodes of one label is worth: equal texts before equal names before like children."""
    name, whole, below = (x["f"], x["d"], x["c"]) if isinstance(x, dict) else (x.name, x.whole(), x.children)
    return 1 + min(_size(below, y["c"]), 50) + 100 * (name == y["f"]) + 10_000 * (whole == y["d"] != 0)


def match(a: list, b: list, label_a, label_b, below) -> list[tuple[int, int]]:
    """Simple tree matching of two child lists: the order-preserving pairs of like labels with the most matching nodes below."""
    la, lb = [label_a(x) for x in a], [label_b(x) for x in b]
    if la == lb and len(set(la)) == len(la):
        return [(i, i) for i in range(len(la))]
    n, m = len(a), len(b)
    if n * m > MOST_CELLS:  # very long lists of unlike children: each label's next occurrence
        out, j = [], 0
        where: dict[str, list[int]] = {}
        for k, x in enumerate(lb):
            where.setdefault(x, []).append(k)
        for i, x in enumerate(la):
            k = next((k for k in where.get(x, ()) if k >= j), None)
            if k is not None:
                out.append((i, k))
                j = k + 1
        return out
    best = [[0] * (m + 1) for _ in range(n + 1)]
    gain = {}
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            w = 0
            if la[i] == lb[j]:
                w = gain[i, j] = below(a[i], b[j])
            best[i][j] = max(best[i + 1][j], best[i][j + 1], w + best[i + 1][j + 1] if w else 0)
    out, i, j = [], 0, 0
    while i < n and j < m:
        if (i, j) in gain and best[i][j] == gain[i, j] + best[i + 1][j + 1]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def _size(a: list, b: list) -> int:
    """Like labels in two child lists: what a match is worth below one level."""
    rest = [x["l"] if isinstance(x, dict) else x.label for x in b]
    n = 0
    for x in a:
        k = x["l"] if isinstance(x, dict) else x.label
        if k in rest:
            rest.remove(k)
            n += 1
    return n


def _run_pairs(run: Run, w: dict) -> list[tuple[int, int]]:
    return match(run.children, w["c"], lambda x: x.label, lambda x: x["l"], _worth)


def add_page(w: dict, run: Run) -> None:
    """Align a page with the wrapper: matched nodes are counted, new ones inserted after their left neighbour."""
    w["n"] += 1
    w["t"] += run.text
    w["a"] += run.links
    w["v"] = w["v"] or w["h"] != run.digest()
    _seen(w["s"], {str(x): 1 for x in run.parts()})
    _seen(w["o"], {str(run.whole()): 1})
    pairs = _run_pairs(run, w)
    matched = dict(pairs)
    old = list(w["c"])
    for i, j in pairs:
        add_page(old[j], run.children[i])
    if len(matched) < len(run.children):
        out, j = [], 0
        for i, child in enumerate(run.children):
            if i in matched:
                out += old[j : matched[i] + 1]
                j = matched[i] + 1
            else:
                out.append(new_wrapper(child))
        w["c"] = out + old[j:]


def merge(w: dict, o: dict) -> None:
    """Align two wrappers of a host."""
    w["n"] += o["n"]
    w["t"] += o["t"]
    w["a"] += o["a"]
    w["v"] = w["v"] or o["v"] or w["h"] != o["h"]
    _seen(w["s"], o["s"])
    _seen(w["o"], o["o"])
    pairs = match(o["c"], w["c"], lambda x: x["l"], lambda x: x["l"], _worth)
    matched, old, out, j = dict(pairs), list(w["c"]), [], 0
    for a, b in pairs:
        merge(old[b], o["c"][a])
    for i, child in enumerate(o["c"]):
        if i in matched:
            out += old[j : matched[i] + 1]
            j = matched[i] + 1
        else:
            out.append(child)
    w["c"] = out + old[j:]


def prune(w: dict) -> dict:
    """Where a wrapper has grown beyond MOST_NODES, nodes that few pages have leave it (they count as varying then)."""
    def count(x: dict) -> int:
        return 1 + sum(map(count, x["c"]))

    def thin(x: dict, least: int) -> None:
        x["c"] = [c for c in x["c"] if c["n"] > least]
        for c in x["c"]:
            thin(c, least)

    least = 1
    while count(w) > MOST_NODES and least < w["n"]:
        thin(w, least)
        least *= 2
    return w


def finish(w: dict, different: int) -> dict:
    """The wrapper with its template nodes and main region marked."""
    pages = w["n"]

    def mass(x: dict) -> float:
        x["k"] = different >= CONSTANT_PAGES and not x["v"] and bool(x["h"]) and x["n"] >= max(CONSTANT_PAGES, CONSTANT_SHARE * pages)
        # parts that most pages have, whatever the rest of them: copies of the commonest page don't count
        copies = max(x.pop("o").values(), default=0) - 1
        least = max(CONSTANT_PAGES, CONSTANT_SHARE * (pages - copies)) + copies
        x["s"] = [int(k) for k, n in x["s"].items() if different >= CONSTANT_PAGES and n >= least]
        own = 0 if x["u"] or x["k"] else max(0, x["t"] - 2 * x["a"])
        x["m"] = 0 if x["u"] else own + sum(mass(c) for c in x["c"])
        if x["u"]:
            for c in x["c"]:
                mass(c)
        return x["m"]

    total = mass(w)
    if different >= CONSTANT_PAGES and total:
        x = w
        while heavy := [c for c in x["c"] if c["m"] >= REGION_SHARE * total]:
            tag = heavy[0]["l"].split(".")[0]
            if tag in TEXTS - {"article", "main", "body", "html"} or tag in ("ul", "ol", "table"):
                break
            x = heavy[0]
            if tag in ("article", "main"):
                break
        if x["l"].split(".")[0] not in ("#page", "html", "body"):
            x["r"] = True
    return w


def blocks(page: Node, wrapper: dict | None) -> list[str]:
    """The page's content blocks in page order."""
    status: dict[int, int] = {}  # of nodes: 1 template, 2 main region
    dropped: set[int] = set()  # nodes that are template with all below

    def mark(run: Run, w: dict) -> None:
        # a template node goes with its text; its own varying children stay
        code = 1 if w.get("k") else 2 if w.get("r") else 0
        if code:
            for n in run.nodes:
                status[id(n)] = code
        same = set(w["s"])
        dropped.update(id(x) for n in run.nodes for x in n.items if same and isinstance(x, Node) and x.whole() in same)
        for i, j in _run_pairs(run, w):
            mark(run.children[i], w["c"][j])

    if wrapper is not None:
        mark(runs([page]), wrapper)

    def regions(n: Node, named: bool) -> list[Node]:
        if n.unwanted:
            return []
        if (n.tag in ("article", "main")) if named else status.get(id(n)) == 2:
            return [n]
        return [r for x in n.items if isinstance(x, Node) for r in regions(x, named)]

    # the wrapper's slot; on a page that lacks it, or of a host that is too small to compare, the elements' own names
    roots = regions(page, False) or regions(page, True) or [page]
    if len(roots) > 1:
        mains = [r for r in roots if r.tag == "main"]
        roots = mains or roots
    out: list[str] = []

    def walk(n: Node) -> None:
        buffer: list[str] = []

        def flush() -> None:
            line = " ".join("".join(buffer).split())
            buffer.clear()
            if line:
                out.append(line)

        for x in n.items:
            if isinstance(x, str):
                if status.get(id(n)) != 1:
                    buffer.append(x)
            elif x.tag in INLINE:
                continue  # an unwanted inline element
            else:
                flush()
                if not x.unwanted and id(x) not in dropped:
                    walk(x)
        flush()

    for r in roots:
        walk(r)
    return out


def _host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def induce(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """One wrapper per host over all its pages: host, wrapper (JSON), size."""
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        prints: dict[str, set] = {}

        def out() -> pa.RecordBatch:
            rows = [(h, json.dumps(prune(w)), sorted(prints[h])) for h, w in known.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["host", "wrapper", "prints"])

        for batch in batches:
            for part, texts in text_slices(batch, "html"):
                for u, t in zip(part.column(0).to_pylist(), texts, strict=True):
                    if not t:
                        continue
                    host, run = _host(u), runs([parse(t)])
                    if host in known:
                        add_page(known[host], run)
                        if known[host]["n"] % 64 == 0:
                            prune(known[host])
                    else:
                        known[host] = new_wrapper(run)
                    # a few fingerprints tell whether enough different pages back the template
                    seen = prints.setdefault(host, set())
                    if len(seen) < CONSTANT_PAGES:
                        seen.add(xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) >> 1)
                if len(known) > 2000:
                    yield out()
                    known, prints = {}, {}
        if known:
            yield out()

    def join(table: pa.Table) -> pa.Table:
        parts = sorted(table.column("wrapper").to_pylist())
        w = json.loads(parts[0])
        for o in parts[1:]:
            merge(w, json.loads(o))
            if w["n"] > 0:
                prune(w)
        different = len({x for p in table.column("prints").to_pylist() for x in p})
        text = json.dumps(finish(w, different))
        return pa.table({"host": table.column("host").slice(0, 1), "wrapper": pa.array([text], pa.string()), "size": pa.array([len(text)], pa.int64())})

    partial = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(learn, "host string, wrapper string, prints array<long>")
    return cut(partial.groupBy("host").applyInArrow(join, "host string, wrapper string, size long"))


def extract(pages: DataFrame, html: str = "html", url: str = "url", text: str = "text") -> DataFrame:
    """pages with the main text of each page's whole html; a column with the result's name is replaced."""
    pages = without(pages, [text], [html, url])
    wrappers = induce(pages, html, url)
    size = wrappers.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    names = pages.columns
    schema = T.StructType([*pages.schema.fields, T.StructField(text, T.StringType(), False)])
    small = size <= BROADCAST_BYTES
    shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.collect()} if small else {})
    rows, extra = pages, None
    if not small:
        host, extra = free_name(pages, "_host"), free_name(pages, "_wrapper")

        def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [_host(u) for u in batch.column(names.index(url)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*names, host])

        with_host = pages.mapInArrow(hosts, T.StructType([*pages.schema.fields, T.StructField(host, T.StringType(), False)]))
        rows = with_host.join(wrappers.select(F.col("host").alias(host), F.col("wrapper").alias(extra)), host, "left").select(*names, extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {} if small else None
        raw = shared.value
        for batch in batches:
            for part, texts in text_slices(batch, html):
                urls = part.column(names.index(url)).to_pylist()
                given = part.column(len(names)).to_pylist() if extra else [None] * len(texts)
                out = []
                for u, t, g in zip(urls, texts, given, strict=True):
                    if not t:
                        out.append("")
                        continue
                    if small:
                        h = _host(u)
                        if h not in known:
                            if len(known) > 5000:
                                known.clear()
                            known[h] = json.loads(raw[h]) if h in raw else None
                        w = known[h]
                    else:
                        w = json.loads(g) if g else None
                    out.append("\n".join(blocks(parse(t), w)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(out, pa.string())], [*names, text])

    return rows.mapInArrow(run, schema)
