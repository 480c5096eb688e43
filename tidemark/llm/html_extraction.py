"""Main-text extraction: gradient-boosted trees score DOM nodes, one decision decodes the whole tree.

Training. Labelled pages are made, not given: words of a bounded sample of ``SAMPLE_PAGES`` pages,
``SAMPLE_WORDS`` of each chosen by hash from the whole page, are laid into ``TRAIN_PAGES`` random page
plans (menus, headers, sidebars, notices, adverts, forms, comments and footers around an article, and
some inside it). Which text is main text is known by construction. Tags and attribute words are
telling, misleading or new by chance, so that the trees have to weigh them against densities, depth
and siblings; how much an attribute word tells is learnt from the same pages.

Decoding. A node is worth its log-odds. Keeping it allows keeping children, dropping it drops all
below it; the best total over the tree is found from the leaves up, so no block is kept inside a
dropped element and none dropped only for a doubtful parent. An only child goes with its parent. A page has
a main text unless all that it says stands in elements for something else: where the best choice is
nothing, the texts outside such elements are kept.

Defined results: null or empty html gives an empty text; broken markup is read like browsers do in
spirit (see ``dom.parse``); pages of any size are read whole; rows that repeat are each extracted;
extra columns are ignored; an empty table gives an empty result (the model then trains on stock words).
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.llm.dom import Node, features, parse

SAMPLE_PAGES = 200
SAMPLE_WORDS = 300
TRAIN_PAGES = 1200
TREES, DEPTH, RATE, BINS = 70, 5, 0.2, 24
#: An attribute word tells something from so many training elements on.
LEAST_SEEN = 8


@dataclass
class Trees:
    """Complete binary trees in arrays: split feature and value of inner nodes, values of leaves."""

    base: float
    feature: np.ndarray  # (trees, 2**DEPTH - 1)
    split: np.ndarray
    leaf: np.ndarray  # (trees, 2**DEPTH)
    evidence: dict[str, float] | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        every = np.arange(len(x))
        for f, s, v in zip(self.feature, self.split, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[every, f[at]] > s[at])
            out += v[at - (2**DEPTH - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosting of logistic loss with Newton leaves, on features cut at quantiles."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # bin b: x <= cuts[b]
    share = min(max(y.mean(), 0.01), 0.99)
    score = np.full(len(y), np.log(share / (1 - share)))
    inner = 2**DEPTH - 1
    feature, split, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, 2**DEPTH))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p) + 1e-9
        at = np.zeros(len(y), np.int64)
        for d in range(DEPTH):
            first, n = 2**d - 1, 2**d
            place = at - first
            best = np.zeros(n)
            total_g, total_h = np.bincount(place, g, n), np.bincount(place, h, n)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key = place * BINS + binned[:, j]
                lg = np.cumsum(np.bincount(key, g, n * BINS).reshape(n, BINS), 1)[:, : len(c)]
                lh = np.cumsum(np.bincount(key, h, n * BINS).reshape(n, BINS), 1)[:, : len(c)]
                rg, rh = total_g[:, None] - lg, total_h[:, None] - lh
                gain = lg**2 / (lh + 1) + rg**2 / (rh + 1) - (total_g**2 / (total_h + 1))[:, None]
                gain[(lh < 0.5) | (rh < 0.5)] = 0
                k = gain.argmax(1)
                better = gain[np.arange(n), k] > best + 1e-12
                best = np.where(better, gain[np.arange(n), k], best)
                feature[t, first : first + n][better] = j
                split[t, first : first + n][better] = c[k[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[t, at]] > split[t, at])
        place = at - inner
        leaf[t] = RATE * np.bincount(place, g, 2**DEPTH) / (np.bincount(place, h, 2**DEPTH) + 1)
        score += leaf[t, place]
    return Trees(float(np.log(share / (1 - share))), feature, split, leaf)


#: Attribute words that pages like to give to parts, and the elements these parts often are.
PARTS = {
    "menu": (("nav", "div", "div", "ul", "header"), "nav navigation navbar menu topbar breadcrumb breadcrumbs links toolbar pagination"),
    "head": (("header", "header", "div", "div"), "header masthead top banner site branding head"),
    "foot": (("footer", "footer", "div", "div"), "footer foot bottom site copyright legal colophon"),
    "side": (("aside", "aside", "div", "section"), "sidebar side aside widget rail column recent related recommended more popular"),
    "notice": (("div", "div", "section", "dialog"), "cookie cookies consent notice alert popup modal overlay gdpr banner"),
    "advert": (("div", "div", "aside", "section"), "ad ads advert advertisement sponsor sponsored promo promotion banner"),
    "form": (("form", "form", "div"), "form login signup subscribe newsletter search"),
    "comments": (("section", "div", "div", "ol"), "comment comments reply replies respond disqus discussion feedback"),
    "share": (("div", "div", "ul", "p"), "share sharing social follow tags buttons"),
}
MAIN = (("article", "article", "main", "div", "div", "section"), "article content post entry story main body text prose blog news page single")


def training_pages(words: list[str], n: int = TRAIN_PAGES, seed: int = 7, telling: float = 0.5) -> list[str]:
    """Pages whose main elements carry ``data-main="1"`` and whose parts inside them ``data-off="1"``, which no feature looks at.

    ``telling``: how many of the parts have an attribute word of their kind.
    """
    rng = random.Random(seed)
    words = words or "a plain line of words to stand in for text when there are no pages to learn from".split()
    every = [w for _, w in PARTS.values() for w in w.split()] + MAIN[1].split()

    def prose(low: int, high: int, most: int = 16) -> str:
        return " ".join(" ".join(rng.choices(words, k=rng.randint(3, most))).strip(".,").capitalize() + rng.choice((".", ".", ".", "?", "!", ", so it was.")) for _ in range(rng.randint(low, high)))

    def phrase(low: int, high: int) -> str:
        return " ".join(rng.choices(words, k=rng.randint(low, high))).strip(".,")

    def link(low: int = 1, high: int = 3) -> str:
        return f'<a href="/{rng.randrange(999)}">{phrase(low, high)}</a>'

    def attributes(kind: str, mark: str) -> str:
        own = []
        if rng.random() < telling:
            own.append(rng.choice(kind.split()))
        if rng.random() < 0.4:  # a word of any kind of part, or one that nobody has seen
            own.append(rng.choice(every))
        if rng.random() < 0.5:
            own.append("".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(3, 9))))
        rng.shuffle(own)
        name = f' {rng.choice(("class", "class", "class", "id", "role"))}="{rng.choice((" ", "-", "_")).join(own)}"' if own else ""
        return name + mark

    def wrapped(kind: str, inner: str, mark: str = "") -> str:
        tags, tokens = PARTS[kind]
        tag = rng.choice(tags)
        return f"<{tag}{attributes(tokens, mark)}>{inner}</{tag}>"

    def items(make, low: int, high: int) -> str:
        n = rng.randint(low, high)
        return rng.choice((lambda: "<ul>" + "".join(f"<li>{make()}</li>" for _ in range(n)) + "</ul>", lambda: "".join(f"<div>{make()}</div>" for _ in range(n)), lambda: " | ".join(make() for _ in range(n)), lambda: "".join(make() for _ in range(n))))()

    def comment() -> str:
        who = rng.choice((f"<b>{phrase(1, 2)}</b>", link(1, 2), f"<span>{phrase(1, 2)}</span>", f"<h4>{phrase(1, 2)}</h4>"))
        said = rng.choice((f"<p>{prose(1, 3, 10)}</p>", prose(1, 2, 10), f"<div>{prose(1, 2, 10)}</div>"))
        return f"<div>{who} {rng.choice(('', '<time>12:30</time>', phrase(1, 2)))}{said}{rng.choice(('', link(1, 1), '<button>x</button>'))}</div>"

    def part(kind: str) -> str:
        if kind == "menu":
            return items(lambda: link(1, longest), 2, 14) if (longest := rng.choice((3, 3, 8))) else ""
        if kind == "head":
            return rng.choice((link(1, 2), f"<p>{phrase(1, 4)}</p>", f"<div>{phrase(1, 3)}</div>", f"<h1>{link(1, 3)}</h1>", f"<h2>{link(1, 2)}</h2>")) + rng.choice(("", items(link, 2, 6)))
        if kind == "foot":
            return rng.choice(("&copy; ", "&copy; 2024 ", "")) + rng.choice((phrase(1, 6), prose(1, 2, 8), f"<p>{prose(1, 1)}</p>")) + rng.choice(("", items(link, 1, 8)))
        if kind == "side":
            return rng.choice(("", f"<h3>{phrase(1, 3)}</h3>", f"<h2>{phrase(1, 3)}</h2>")) + rng.choice((items(link, 2, 8), items(lambda: link(2, 6) + f"<p>{prose(1, 1, 8)}</p>", 2, 5), f"<p>{prose(1, 2, 9)}</p>", prose(1, 2, 9)))
        if kind == "notice":
            return rng.choice((prose(1, 2), f"<p>{prose(1, 2)}</p>")) + rng.choice(("", "<button>OK</button>", link(1, 2)))
        if kind == "advert":
            return rng.choice((prose(1, 1, 9), prose(1, 2, 8), f"<p>{prose(1, 1, 8)}</p>", link(3, 7), f"<h4>{phrase(2, 4)}</h4>{prose(1, 1, 6)}"))
        if kind == "form":
            return rng.choice((f"<label>{phrase(1, 3)}</label>", f"<p>{prose(1, 1, 8)}</p>", f"<h3>{phrase(1, 4)}</h3>")) + '<input name="q">' + rng.choice(("", "<button>Go</button>", "<select><option>a</option></select>"))
        if kind == "share":
            return items(lambda: link(1, 1), 2, 6)
        return rng.choice(("", f"<h3>{phrase(1, 3)}</h3>", f"<h2>{rng.randint(1, 90)} {phrase(1, 1)}</h2>")) + "".join(comment() for _ in range(rng.randint(1, 7))) + rng.choice(("", "<form><textarea></textarea><button>x</button></form>"))

    def block() -> str:
        return rng.choices(
            (lambda: f"<p>{prose(1, 6)}</p>", lambda: f"<h2>{phrase(1, 6)}</h2>", lambda: items(lambda: prose(1, 2), 2, 5) if rng.random() < 0.5 else f"<ul><li>{phrase(1, 8)}</li><li>{phrase(1, 8)}</li></ul>", lambda: f"<blockquote><p>{prose(1, 2)}</p></blockquote>", lambda: f"<table><tr><td>{phrase(1, 3)}</td><td>{phrase(1, 3)}</td></tr><tr><td>{phrase(1, 3)}</td><td>{phrase(1, 3)}</td></tr></table>",
             lambda: f"<p>{prose(1, 2)} {link(1, 4)} {phrase(2, 6)}.</p>", lambda: f"<p>{prose(1, 1)}</p><ul>" + "".join(f"<li>{link(1, 8)}</li>" for _ in range(rng.randint(3, 14))) + "</ul>", lambda: f"<pre>{phrase(4, 20)}</pre>", lambda: f"<figure><figcaption>{prose(1, 1)}</figcaption></figure>", lambda: f"<p><b>{prose(1, 2)}<br><p>{prose(1, 3)}</p>", lambda: f"<div><p>{prose(1, 4)}</p></div>", lambda: f"<p>{phrase(1, 4)}</p>"),
            (12, 2, 2, 1, 1, 3, 0.4, 1, 1, 1, 1, 1),
        )[0]()

    kinds = list(PARTS)
    pages = []
    for _ in range(n):
        title = f"<h1>{phrase(1, 9)}</h1>"
        head = rng.choice(("", title, title, title, f'<header class="{rng.choice(("header", "entry-header", "top"))}">{title}</header>', f'<h1 class="{rng.choice(every)}">{phrase(2, 8)}</h1>'))
        some = [block() for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 14, 25)))]
        if rng.random() < 0.3:  # something that does not belong to the text stands within it
            kind = rng.choice(("share", "advert", "form", "side", "comments", "notice"))
            some.insert(len(some) if kind in ("comments", "share") and rng.random() < 0.6 else rng.randint(1, len(some)), wrapped(kind, part(kind), ' data-off="1"'))
        body = head + (prose(1, 4) if rng.random() < 0.08 else "".join(some))
        if rng.random() < 0.1:  # next to nothing, among the parts of any page
            body = title + rng.choice((f"<p>{phrase(1, 4)}</p>", f"<p>{prose(1, 1, 5)}</p>", ""))
        tag = rng.choice(MAIN[0])
        inner = f"<{tag}{attributes(MAIN[1], ' data-main="1"')}>{body}</{tag}>"
        before = [wrapped(k, part(k)) for k in rng.sample(("menu", "head", "advert", "notice", "form", "side"), rng.randint(0, 3))]
        after = [wrapped(k, part(k)) for k in rng.sample(("foot", "comments", "side", "advert", "share", "notice", "form", "menu"), rng.randint(0, 3))]
        if rng.random() < 0.25:
            inner = f"<div>{inner}{wrapped(k := rng.choice(kinds), part(k))}</div>"
        page = "".join((*before, inner, *after))
        if rng.random() < 0.07:  # a page that is its text and nothing else
            bare = rng.choice((f"<p>{phrase(1, 6)}</p>", f"<p>{prose(1, 2)}</p>", f"<h1>{phrase(1, 5)}</h1><p>{phrase(1, 9)}</p>", f"<h1>{phrase(1, 3)}</h1><p>{prose(1, 1, 5)}</p>", f"<p>{prose(1, 3)}</p><p>{prose(1, 3)}</p>", prose(1, 2)))
            pages.append(rng.choice(("{}", "<html><body>{}</body></html>")).format(f'<div data-main="1">{bare}</div>'))
            continue
        if rng.random() < 0.3:
            page = f'<div class="{rng.choice(("wrap", "container", "page", "outer", "main", "content"))}">{page}</div>'
        pages.append(f"<html><body>{page}</body></html>")
    return pages


def labels(nodes: list[Node]) -> list[int]:
    """A text of a training page is wanted if its element says so, an element if it holds wanted text."""
    wanted: dict[int, int] = {}
    for x in reversed(nodes):
        wanted[id(x)] = int(x.label if x.tag == "#text" else any(wanted[id(c)] for c in x.children))
    return [wanted[id(x)] for x in nodes]


def learnt_evidence(parsed: list[list[Node]]) -> dict[str, float]:
    """The log-odds of main text that each attribute word adds, of words in ``LEAST_SEEN`` training elements or more."""
    seen: dict[str, list[int]] = {}
    total = [1, 1]
    for nodes in parsed:
        for x, y in zip(nodes, labels(nodes)):
            for t in x.tokens:
                seen.setdefault(t, [0, 0])[y] += 1
                total[y] += 1
    return {t: math.log((b + 1) / (total[1] + 2)) - math.log((a + 1) / (total[0] + 2)) for t, (a, b) in seen.items() if a + b >= LEAST_SEEN}


def sample_words(pages: DataFrame, sample: int = SAMPLE_PAGES, words: int = SAMPLE_WORDS) -> list[str]:
    """Words of ``sample`` pages: ids are chosen first, and each page's words in its own task."""
    ids = [r["page_id"] for r in pages.where(F.length("html") > 0).select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for html in batch.column("html").to_pylist():
                own = {w for x in features(parse(html))[0] for w in x.text.split() if x.tag == "#text"}
                yield pa.RecordBatch.from_pydict({"words": [sorted(own, key=lambda w: zlib.crc32(w.encode()))[:words]]})

    chosen = pages.where(F.col("page_id").isin(ids) & (F.length("html") > 0)).dropDuplicates(["page_id"]).select("html")
    return [w for r in chosen.mapInArrow(run, "words array<string>").collect() for w in r["words"]] if ids else []


def fit(pages: DataFrame | None = None, sample: int = SAMPLE_PAGES) -> Trees:
    """Trees trained on page plans filled with words of ``sample`` pages, chosen by a hash of page_id."""
    made = [parse(page) for page in training_pages(sorted(sample_words(pages, sample)) if pages is not None else [])]
    evidence = learnt_evidence([features(root)[0] for root in (parse(p) for p in training_pages([], TRAIN_PAGES // 2, seed=8))])
    x, y = [], []
    for root in made:
        nodes, rows = features(root, evidence)
        x += rows
        y += labels(nodes)
    trees = fit_trees(np.array(x), np.array(y, float))
    trees.evidence = evidence
    return trees


def decode(nodes: list[Node], scores: np.ndarray) -> str:
    """The text of the best consistent choice of nodes.

    Siblings of the same tag and attribute words mostly have the same part in a page: among n of a
    kind, one counts 1/n for itself, the rest is what its kind is worth on average.
    """
    own = {id(x): float(s) for x, s in zip(nodes, scores)}
    total: dict[int, float] = {}
    worth: dict[int, float] = {}

    def settle(children: list[Node], alone: bool = True) -> float:
        if len(children) == 1 and alone:  # an only child goes with its parent
            worth[id(children[0])] = 1.0
            return total[id(children[0])]
        kinds: dict[tuple, tuple[int, float]] = {}
        for c in children:
            n, t = kinds.get((c.tag, c.tokens), (0, 0.0))
            kinds[c.tag, c.tokens] = n + 1, t + total[id(c)]
        for c in children:
            n, t = kinds[c.tag, c.tokens]
            shared = (total[id(c)] + (n - 1) * t / n) / n
            worth[id(c)] = max(0.0, shared) if c.children or c.tag == "#text" else 0.0
        return sum(worth[id(c)] for c in children)

    for x in reversed(nodes):  # children come first
        total[id(x)] = own[id(x)] + settle(x.children)
    if nodes:
        settle(nodes[0].parent.children, alone=False)
    kept: dict[int, bool] = {}
    out = []
    for x in nodes:  # parents come first
        kept[id(x)] = kept.get(id(x.parent), True) and worth[id(x)] > 0
        if kept[id(x)] and x.tag == "#text":
            out.append(x.text)
    return "\n\n".join(out or [x.text for x in nodes if x.tag == "#text" and _plain(x)])


#: Elements that stand for something else than the text.
_ASIDE = frozenset("nav menu aside footer header form fieldset button select option dialog search".split())
_NOT_TEXT = frozenset(w for kind, (_, ws) in PARTS.items() if kind != "head" for w in ws.split()) - frozenset(MAIN[1].split())


def _plain(x: Node) -> bool:
    """Whether no element above says that this is no text, and it is not mostly links."""
    if 2 * x.links > x.chars:
        return False
    while x.parent:
        x = x.parent
        if x.tag in _ASIDE or x.hidden or _NOT_TEXT & set(x.tokens):
            return False
    return True


def extracted(pages: DataFrame, model: Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    model = model or fit(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            parsed, rows = [], []
            for html in batch.column("html").to_pylist():
                nodes, f = features(parse(html or ""), model.evidence)
                parsed.append(nodes)
                rows += f
            scores = model.score(np.array(rows)) if rows else np.empty(0)
            texts, at = [], 0
            for nodes in parsed:
                texts.append(decode(nodes, scores[at : at + len(nodes)]))
                at += len(nodes)
            yield pa.RecordBatch.from_pydict(
                {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]},
                schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]),
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
