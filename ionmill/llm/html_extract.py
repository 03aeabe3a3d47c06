"""Operator 4: main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed leniently (unclosed paragraphs, stray end tags) into block nodes; inline tags only mark link text. Each node is described by its
tag, its own and its ancestors' attribute tokens, the text and link density of its subtree, depth, and how it stands among its siblings. Boosted
trees give a logit for "article text, or holds some". Decoding works from the leaves up: a node's worth is its logit plus the worth of its children where
that is above zero, and a node of no worth takes its whole subtree along, so no text is chosen below a rejected ancestor. The text runs
of chosen nodes, white space folded, are the blocks.

The trees are fitted when needed on ``training_pages`` pages that a seeded generator lays out (menus, headers, adverts, notices, sidebars, forms,
comments, several article layouts and broken markup), where the right label of every node is known. No page of the table is used for fitting.

Rows: one per input row. Null or empty html, or html without text: empty text, no characters. Text without any markup is one block. Repeated rows are alike; an empty
table gives no rows. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from . import common
from .boosting import BoostedTrees

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_TOKEN = re.compile(r"[A-Za-z]+")
#: Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style head title noscript template iframe svg math object canvas textarea".split())
RAW = frozenset("script style textarea title iframe noscript".split())
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLING = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
GROUPS = ("article main", "nav menu", "header", "footer", "aside", "form fieldset button select input", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "table tbody thead tr td th", "blockquote pre figure figcaption", "div section body html")
GOOD = frozenset("article content entry post story text body main blog read prose page copy".split())
BAD = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion banner nav navigation navbar menu breadcrumb breadcrumbs header masthead footer foot sidebar side rail aside widget cookie cookies consent gdpr notice alert popup modal overlay share social follow comment comments disqus reply respond discussion related recommended more popular trending newsletter subscribe signup login form search tags tag pagination pager copyright legal skip toolbar contentinfo complementary".split())
TALK = frozenset("comment comments disqus reply respond discussion reader readers".split())
_GROUP = {t: k for k, ts in enumerate(GROUPS) for t in ts.split()}


class Node:
    __slots__ = ("attrs", "chars", "depth", "first", "kids", "links", "mine", "parent", "runs", "tag", "total", "total_links", "tags", "words")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.depth = parent.depth + 1 if parent else 0
        self.kids: list[Node] = []
        self.runs: list[list] = []  # [place, text pieces] of own text
        self.chars = self.links = 0


def parse(page: str) -> tuple[Node, list[Node], list[tuple[Node, str]]]:
    """(root, nodes in page order, text runs in page order)."""
    root = Node("html", "", None)
    nodes, stack, order = [root], [root], []
    inline: list[str] = []
    held: list[str] = []
    held_links = 0
    hidden: list[str] = []
    open_at: dict[str, list[int]] = defaultdict(list, html=[0])  # places in the stack by tag, so that deep nests cost no search
    firm = [0]  # places of neither paragraphs nor headings

    def flush() -> None:
        nonlocal held, held_links
        if held:
            text = " ".join("".join(held).split())
            if text:
                top = stack[-1]
                top.chars += len(text)
                top.links += min(held_links, len(text))
                order.append((top, text))
            held, held_links = [], 0

    def drop(k: int) -> None:
        while len(stack) > k:
            open_at[stack.pop().tag].pop()
        while firm[-1] >= k:
            firm.pop()

    def last(tags: list[str] | tuple[str, ...]) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    at = 0
    search, last_end = _MARKUP.search, page.rfind(">") + 1  # beyond the last end of a tag there is only text, or an open comment
    if "<!--" in page[last_end:]:
        last_end = len(page)
    while True:
        m = search(page, at, last_end)
        stop = m.start() if m else len(page)
        if stop > at and hidden == ["head"] and not page[at:stop].isspace():
            hidden.clear()
        if stop > at and not hidden:
            piece = page[at:stop]
            piece = entities.unescape(piece) if "&" in piece else piece
            held.append(piece)
            if "a" in inline:
                held_links += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if hidden:
                if tag == hidden[-1]:
                    hidden.pop()
            elif tag in INLINE:
                if tag in inline:
                    inline.remove(tag)
            else:
                if k := last((tag,)):
                    flush()
                    drop(k)
                    inline.clear()
            continue
        attrs = m[3] or m[6] or ""
        if hidden and (tag == "body" and "head" in hidden or hidden[-1] == "head" and tag not in HEAD):
            hidden.clear()  # what cannot be in the head ends it
        if tag in UNSEEN or hidden:
            if tag in RAW and not (attrs.endswith("/") and ("svg" in hidden or "math" in hidden)):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                held.append(" ")
            elif not attrs.endswith("/") and tag in UNSEEN:
                hidden.append(tag)
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in INLINE:
            inline.append(tag)
            continue
        flush()
        inline.clear()
        if tag in CLOSES_P:
            if (k := last(("p",))) > firm[-1]:
                drop(k)
        if tag in SIBLING:
            same, bounds = SIBLING[tag][0].split(), SIBLING[tag][1]
            if (k := last(same)) > last(bounds):
                drop(k)
        if tag in ("html", "body") and open_at[tag]:
            continue
        node = Node(tag, attrs, stack[-1])
        stack[-1].kids.append(node)
        nodes.append(node)
        open_at[tag].append(len(stack))
        if tag != "p" and _GROUP.get(tag) != 7:
            firm.append(len(stack))
        stack.append(node)
    flush()
    return root, nodes, order


N_FEATURES = len(GROUPS) + 6 + 24


def features(root: Node, nodes: list[Node], order: list[tuple[Node, str]]) -> np.ndarray:
    """One row per node."""
    texts: dict[int, list[str]] = {}
    for node, text in order:
        texts.setdefault(id(node), []).append(text)
    for n in reversed(nodes):
        n.total = n.chars + sum(k.total for k in n.kids)
        n.total_links = n.links + sum(k.total_links for k in n.kids)
        n.tags = 1 + sum(k.tags for k in n.kids)
    whole = max(1, root.total)
    around: dict[int, tuple] = {}  # of a parent's children: greatest, sum and link sum; by tag: number and sum
    for n in nodes:
        if n.kids:
            by_tag: dict[str, list[int]] = {}
            for k in n.kids:
                own = by_tag.setdefault(k.tag, [0, 0])
                own[0] += 1
                own[1] += k.total
            around[id(n)] = (max(k.total for k in n.kids), sum(k.total for k in n.kids), sum(k.total_links for k in n.kids), by_tag)
    out = np.zeros((len(nodes), N_FEATURES))
    state: dict[int, tuple] = {}
    log, g = math.log1p, len(GROUPS)
    for k, n in enumerate(nodes):
        tokens = [t.lower() for m in _ATTRIBUTE.findall(n.attrs) for v in m if v for t in _TOKEN.findall(v)] if "=" in n.attrs else []
        good, bad, talk = sum(t in GOOD for t in tokens), sum(t in BAD for t in tokens), sum(t in TALK for t in tokens)
        up = state[id(n.parent)] if n.parent else (0, 0, 0, 0, 0, 0)
        group = _GROUP.get(n.tag, -1)
        mine = (up[0] or group == 0, up[1] or group in (1, 2, 3, 4), up[2] or group == 5, up[3] or good > 0, up[4] or bad > 0, up[5] or talk > 0)
        state[id(n)] = mine
        row = out[k]
        if group >= 0:
            row[group] = 1
        row[g:g + 6] = mine
        own = " ".join(texts.get(id(n), ()))
        biggest, all_total, all_links, by_tag = around[id(n.parent)] if n.parent else (n.total, n.total, n.total_links, {n.tag: (1, n.total)})
        n_sibs, (n_same, same_total) = len(n.parent.kids) if n.parent else 1, by_tag[n.tag]
        up_total = n.parent.total if n.parent else whole
        words = own.count(" ") + 1 if own else 0
        row[g + 6:] = (
            good, bad, n.depth, k / len(nodes), log(n.chars), n.links / max(1, n.chars), log(n.total), n.total_links / max(1, n.total),
            n.tags / (1 + n.total) * 100, len(n.kids), log(words), n.chars / max(1, words), sum(map(own.count, ".!?")), sum(map(own.count, ",;")), own[:1] == "©",
            n.total / whole, n.total / max(1, up_total), n_sibs, n_same, n.total / max(1, biggest), log(same_total / n_same),
            all_links / max(1, all_total), int(n.tag[1:]) if group == 7 else 0, any("©" in t for t in texts.get(id(n), ())),
        )
    return out


def decode(nodes: list[Node], logits: np.ndarray) -> set[int]:
    """ids of the chosen nodes: the consistent labelling of greatest worth."""
    score = dict(zip(map(id, nodes), logits.tolist(), strict=True))
    worth: dict[int, float] = {}
    for n in reversed(nodes):
        worth[id(n)] = score[id(n)] + sum(max(0.0, worth[id(k)]) for k in n.kids)
    chosen = set()
    for n in nodes:
        if worth[id(n)] > 0 and (n.parent is None or id(n.parent) in chosen):
            chosen.add(id(n))
    return chosen


class Extractor:
    def __init__(self, model: BoostedTrees):
        self.model = model

    def blocks(self, pages: list[str | None]) -> list[list[str]]:
        """Chosen text runs of each page."""
        parsed = [parse(p or "") for p in pages]
        tables = [features(*p) for p in parsed]
        logits = self.model.logits(np.concatenate(tables)) if tables else np.zeros(0)
        out, at = [], 0
        for (_, nodes, order), table in zip(parsed, tables, strict=True):
            mine = logits[at:at + len(table)]
            at += len(table)
            if len(nodes) == 1:
                out.append([t for _, t in order])
                continue
            chosen = decode(nodes, mine)
            out.append([t for n, t in order if id(n) in chosen])
        return out


#: A private-use character that marks article words in generated pages; it is taken out before features are computed.
MARK = "\ue000"


class Layouts:
    """Seeded generator of pages."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.inside = False
        self.syllables = [self.r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "es", "ou", "to", "it", "en", "sch", "ung", "é", "eau", "ción", "ñ", "der", "que", "la", "ich"]) for _ in range(40)]

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.randint(1, 4)))

    def words(self, n: int) -> str:
        end = MARK if self.inside else ""
        deco = self.r.choice(["", "", "", "", "!!", "%%%", "&amp;", " |"])
        return " ".join(self.word() + end + (deco if self.r.random() < 0.7 else "") for _ in range(n))

    def sentences(self, n: int) -> str:
        return " ".join(self.words(self.r.randint(1, 18)).capitalize() + "." for _ in range(n))

    def paragraph(self) -> str:
        r, text = self.r, self.sentences(self.r.choice([1, 1, 2, 3, 5, 8, 12]))
        if r.random() < 0.1:
            text = self.words(1).capitalize() + "."
        if r.random() < 0.15:
            text += f' <a href="/x">{self.words(2)}</a> {self.words(4)}.'
        if r.random() < 0.2:
            text = f"<b>{text}" + r.choice(["</b>", "<br>", ""])
        return f"<p>{text}" + ("</p>" if r.random() < 0.8 else "")

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{self.word()}">{self.words(self.r.randint(1, 4))}</a></li>' for _ in range(n))

    def junk(self, kind: str) -> str:
        r, w = self.r, self.words
        name = lambda *xs: r.choice(['class="%s"', 'id="%s"', 'class="c1 %s"', 'class="%s-x"']) % r.choice(xs)
        if kind == "nav":
            tag = r.choice(["nav", "nav", f"div {name('nav', 'menu', 'navbar')}", "ul"])
            inner = f"<ul>{self.links(r.randint(3, 9))}</ul>" if r.random() < 0.7 else "".join(f'<a href="/a">{w(1)}</a> ' for _ in range(6))
            return f"<{tag}>{inner}</{tag.split()[0]}>"
        if kind == "header":
            return f"<header><h1>{w(2)}</h1><p>{w(5)}</p></header>" if r.random() < 0.6 else f"<div {name('header', 'masthead')}><h2>{w(3)}</h2><p>{w(6)}</p></div>"
        if kind == "footer":
            text = r.choice(["&copy; ", "© 2020 ", "Copyright "]) + f"{w(2)} &middot; {self.sentences(r.randint(1, 3))}"
            return f"<footer>{text}</footer>" if r.random() < 0.7 else f"<div {name('footer', 'copyright')}><p>{text}</p></div>"
        if kind == "ad":
            return f"<div {name('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner')}>{self.sentences(r.randint(1, 4))}</div>"
        if kind == "notice":
            return f"<div {name('cookie', 'consent', 'notice', 'alert', 'popup')}><p>{self.sentences(2)}</p><button>{w(1)}</button></div>"
        if kind == "aside":
            tag = r.choice(["aside", f"div {name('sidebar', 'related', 'widget', 'popular')}"])
            return f"<{tag}><h3>{w(2)}</h3><ul>{self.links(5)}</ul><p>{self.sentences(r.randint(1, 3))}</p></{tag.split()[0]}>"
        if kind == "form":
            return f'<form {name("search", "newsletter", "login")}><label>{w(2)}</label><input name="q"><p>{w(6)}</p><button>{w(1)}</button></form>'
        if kind == "share":
            return f"<div {name('share', 'social', 'tags')}>{self.links(4)}</div>"
        each = "".join(f'<div class="comment"><p>{w(2)}</p><p>{self.sentences(r.randint(1, 4))}</p></div>' for _ in range(r.randint(1, 5)))
        return f"<section {name('comments', 'discussion')}><h3>{w(2)}</h3>{each}</section>"

    def article(self) -> str:
        """Markup of the article, with what may be put inside and is none of it."""
        r, out = self.r, []
        self.inside = True
        if r.random() < 0.85:
            out.append(f"<h1>{self.words(r.randint(2, 9))}</h1>")
        for _ in range(r.choice([1, 1, 2, 4, 8, 15, 25])):
            out.append(self.paragraph())
            x = r.random()
            if x < 0.06:
                out.append(f"<h2>{self.words(3)}</h2>")
            elif x < 0.1:
                out.append(f"<ul>{''.join(f'<li>{self.words(r.randint(3, 12))}</li>' for _ in range(4))}</ul>")
            elif x < 0.13:
                out.append(f"<blockquote><p>{self.sentences(2)}</p></blockquote>")
            elif x < 0.15:
                out.append(f"<table><tr><td>{self.words(2)}</td><td>{self.words(3)}</td></tr></table>")
            elif x < 0.22:
                self.inside = False
                out.append(self.junk(r.choice(["ad", "share", "notice", "form", "aside"])))
                self.inside = True
        self.inside = False
        if r.random() < 0.15:
            out.append(self.junk("comments"))
        return "".join(out)

    def page(self) -> str:
        """A page; words of the article end with MARK."""
        r = self.r
        open_, close = r.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="post-body">', "</div>"), ("<div>", "</div>"), ('<div class="entry"><section>', "</section></div>")])
        body = self.article()
        before = [self.junk(k) for k in ("nav", "header", "notice", "ad", "form") if r.random() < {"nav": 0.85, "ad": 0.5}.get(k, 0.3)]
        after = [self.junk(k) for k in ("aside", "comments", "ad", "share", "footer") if r.random() < {"footer": 0.85}.get(k, 0.25)]
        r.shuffle(before)
        end = r.choice(["</body></html>", ""])
        return f'<!DOCTYPE html><html><head><title>{self.words(3)}</title><style>p{{}}</style></head><body>{"".join(before)}{open_}{body}{close}{"".join(after)}{end}'


def training_set(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Node features and labels of generated pages. A label is 1 where the subtree holds article text."""
    xs, ys = [], []
    for k in range(pages):
        marked = Layouts(seed + k).page()
        _, nodes, order = parse(marked)
        good = {id(n) for n, text in order if MARK in text}
        for n in reversed(nodes):
            if any(id(c) in good for c in n.kids):
                good.add(id(n))
        xs.append(features(*parse(marked.replace(MARK, ""))))
        ys.append(np.array([id(n) in good for n in nodes]))
    return np.concatenate(xs), np.concatenate(ys)


def fit(training_pages: int = 500, seed: int = 20, **settings) -> Extractor:
    """Learn from generated pages only; the same seed gives the same trees."""
    return Extractor(BoostedTrees(**settings).fit(*training_set(training_pages, seed)))


def extract(pages: DataFrame, extractor: Extractor) -> DataFrame:
    """page_id, url, text, n_chars."""
    held = pages.sparkSession.sparkContext.broadcast(extractor)  # some tens of kilobytes

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                texts = ["\n".join(b) for b in held.value.blocks(part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return common.map_arrow(pages.selectExpr("cast(page_id as long) page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
