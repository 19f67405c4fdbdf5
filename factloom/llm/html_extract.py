"""Main text of web pages: boosted trees over DOM-node features, decoded so that no node contradicts its ancestors."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm import boosting

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; their text is never main text.
RAW = frozenset("script style noscript template iframe svg math title textarea object canvas audio video select".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option legend".split()
)
#: A start tag of the key closes an open element of these within the same container.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table body html div section article aside nav footer header main form td th blockquote".split())

_GOOD = "article content main post entry story body text prose".split()
_BAD = (
    "nav menu header footer sidebar side aside ad ads advert advertisement banner promo sponsor sponsored cookie consent notice alert gdpr popup modal newsletter "
    "subscribe signup comment comments reply respond discussion disqus form login search share social related recommended breadcrumb breadcrumbs pager pagination "
    "widget toolbar copyright legal skip tags meta byline author toc masthead navigation topbar bottombar outbrain taboola".split()
)
_GOOD_SET, _BAD_SET = frozenset(_GOOD), frozenset(_BAD)
_TAGS = ["article main section".split(), ["p", "blockquote", "pre"], ["h1", "h2", "h3", "h4", "h5", "h6"], ["li", "ul", "ol", "menu"], ["div"], ["nav"], ["header"], ["footer"], ["aside"], ["form", "button", "fieldset", "label", "input"], ["td", "tr", "table", "tbody"], ["body", "html"]]
_GROUP = {t: k for k, group in enumerate(_TAGS) for t in group}
_HEADINGS = frozenset(_TAGS[2])


class Node:
    __slots__ = ("tag", "parent", "depth", "good", "bad", "texts", "children", "chars", "linked", "tags", "paragraphs", "index_in")

    def __init__(self, tag: str, parent: int, depth: int, attributes: str):
        self.tag, self.parent, self.depth = tag, parent, depth
        self.good = self.bad = 0
        if attributes:
            for name, *values in _ATTRIBUTE.findall(attributes):
                if name.lower() in ("class", "id", "role", "itemprop", "aria-label", "data-component", "data-testid"):
                    for token in _TOKEN.findall("".join(values)):
                        token = token.lower()
                        self.good += token in _GOOD_SET
                        self.bad += token in _BAD_SET
        self.texts: list[int] = []
        self.children: list[int] = []
        self.chars = self.linked = self.paragraphs = self.index_in = 0
        self.tags = 1


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes of the block elements in page order (parents first), and blocks of text with the node each stands in.

    Inline elements are no nodes. Unclosed, crossed and stray tags are taken as a browser would nearly take them.
    """
    nodes = [Node("html", -1, 0, "")]
    blocks: list[tuple[int, str]] = []
    stack, link, at, held = [0], 0, 0, []
    linked_chars = 0

    def flush() -> None:
        nonlocal linked_chars
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                blocks.append((stack[-1], text))
                node = nodes[stack[-1]]
                node.texts.append(len(blocks) - 1)
                node.chars += len(text)
                node.linked += min(linked_chars, len(text))
        linked_chars = 0

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else size]
        if text:
            held.append(text)
            if link:
                linked_chars += len(text)
        if m is None:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        if name in RAW:
            if not closing and not (m[3] or m[6] or "").endswith("/"):
                end = re.compile(f"</{re.escape(name)}\\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else (size if name in ("script", "style") else at)
            continue
        if name == "br":
            held.append(" ")
        elif name == "a":
            link = 0 if closing else 1
        elif name in BLOCK:
            flush()
            link = 0
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag == name:
                        del stack[k:]
                        break
                    if nodes[stack[k]].tag in _SCOPES and name in ("p", "li", "dt", "dd"):
                        break
                continue
            if name in ("html", "head"):
                continue
            if nodes[stack[-1]].tag in ("p", *_HEADINGS) and name not in ("hr",):
                stack.pop()
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag in _CLOSES.get(name, ()):
                    del stack[k:]
                    break
                if nodes[stack[k]].tag in _SCOPES and nodes[stack[k]].tag not in ("td", "th"):
                    break
            if name == "hr":
                continue
            parent = nodes[stack[-1]]
            node = Node(name, stack[-1], parent.depth + 1, m[3] or m[6] or "")
            node.index_in = len(parent.children)
            parent.children.append(len(nodes))
            stack.append(len(nodes))
            nodes.append(node)
        elif name in ("button", "label", "input", "legend"):
            nodes[stack[-1]].bad += 1
    flush()
    return nodes, blocks


WIDTH = len(_TAGS) + 19


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node: tag group, attribute tokens here and above, depth, siblings, sizes and densities of its
    subtree and of its place in the page."""
    n = len(nodes)
    chars, linked = np.array([x.chars for x in nodes], float), np.array([x.linked for x in nodes], float)
    tags, paragraphs = np.ones(n), np.array([x.tag == "p" for x in nodes], float)
    total = chars.copy()
    total_linked = linked.copy()
    for k in range(n - 1, 0, -1):
        p = nodes[k].parent
        total[p] += total[k]
        total_linked[p] += total_linked[k]
        tags[p] += tags[k]
        paragraphs[p] += paragraphs[k]
    out = np.zeros((n, WIDTH))
    page = max(total[0], 1.0)
    g = len(_TAGS)
    seen = 0.0
    above = np.zeros((n, 9))
    for k, x in enumerate(nodes):
        row = out[k]
        group = _GROUP.get(x.tag)
        if group is not None:
            row[group] = 1
        up = above[x.parent] if k else np.zeros(9)
        own = above[k]
        own[:] = up
        own[0] += x.good
        own[1] += x.bad
        for j, tag in enumerate(("article", "main", "nav", "header", "footer", "aside", "form")):
            if x.tag == tag:
                own[2 + j] += 1
        row[g : g + 9] = own
        siblings = len(nodes[x.parent].children) if k else 1
        row[g + 9 :] = (
            x.depth, siblings, x.index_in / max(siblings, 1), np.log1p(total[k]), total[k] / tags[k], total_linked[k] / max(total[k], 1.0), total[k] / page,
            np.log1p(paragraphs[max(x.parent, 0)]), seen / page, x.good - x.bad,
        )
        seen += chars[k]
    return out


#: Log odds of main text below which a node and all that it holds are out.
REJECTED = -4.0


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """Whether the text of each node is main text: the most likely labelling without contradictions.

    Labels are mixed, main and other. Below a mixed node anything may stand, below main text main or other, below
    other only other. A node whose odds are below ``REJECTED`` is other (but for html and body, which hold the whole
    page) with all that it holds, so no text stays under a menu that the trees reject. Text that stands in a mixed
    node itself goes by its own odds.
    """
    n = len(nodes)
    main, other = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    mixed = np.full(n, np.log(0.5))
    weight = np.array([1.0 if x.texts else 0.25 for x in nodes])
    best = np.stack([mixed * weight * np.array([4.0 if x.texts else 1.0 for x in nodes]), main * weight, other * weight], axis=1)
    out = odds < REJECTED
    out &= np.array([x.tag not in ("html", "body") for x in nodes])
    best[out, :2] = -np.inf
    for k in range(n - 1, 0, -1):
        p = nodes[k].parent
        m, c, o = best[k]
        best[p, 0] += max(m, c, o)
        best[p, 1] += max(c, o)
        best[p, 2] += o
    label = [0] * n
    for k in range(n):
        m, c, o = best[k]
        up = label[nodes[k].parent] if k else 0
        if up == 2:
            label[k] = 2
        elif up == 1:
            label[k] = 1 if c >= o else 2
        else:
            label[k] = int(np.argmax(best[k]))
    # text that stands in a mixed node itself goes by its own odds
    return [lab == 1 or (lab == 0 and bool(nodes[k].texts) and odds[k] > 0) for k, lab in enumerate(label)]


def _sample_page(r: random.Random) -> tuple[str, list[str]]:
    """A made-up page and its main blocks, in one of many layouts: the labelled rows that the trees are fitted on."""
    words = ["".join(r.choice("aeioubcdlmnprst") for _ in range(r.randint(2, 9))) for _ in range(60)]
    say = lambda a, b: " ".join(r.choice(words) for _ in range(r.randint(a, b)))
    pick = lambda *x: r.choice(x)
    attr = lambda tokens: f' {pick("class", "id", "class")}="{pick("", "site-", "page-", "c-")}{pick(*tokens)}{pick("", "-inner", " wide", "-1")}"'
    main: list[str] = []

    def block(tag: str, low: int, high: int) -> str:
        text = say(low, high)
        main.append(text)
        return f"<{tag}>{text}" + (f"</{tag}>" if r.random() < 0.9 or tag != "p" else "")

    def links(tag: str = "ul", n: int = 5) -> str:
        return f"<{tag}>" + "".join(f'<li><a href="/x">{say(1, 3)}</a></li>' for _ in range(r.randint(2, n))) + f"</{tag}>"

    def noise(kind: str) -> str:
        long = say(*pick((2, 8), (5, 40), (20, 80)))
        if kind == "nav":
            return pick(f"<nav>{links()}</nav>", f"<div{attr(['nav', 'menu', 'navigation', 'breadcrumbs'])}>{links()}</div>", f'<div role="navigation">{links()}</div>')
        if kind == "header":
            return pick(f"<header><h1>{say(1, 4)}</h1><p>{say(2, 8)}</p></header>", f"<header{attr(['masthead', 'header', 'topbar'])}><p>{say(2, 9)}</p>{links()}</header>", f"<div{attr(['header', 'masthead', 'topbar'])}><p>{say(1, 6)}</p></div>")
        if kind == "footer":
            return pick(f"<footer>{long}</footer>", f"<footer><p>{long}</p>{links()}</footer>", f"<div{attr(['footer', 'copyright', 'legal'])}><p>{long}</p></div>")
        if kind == "aside":
            return pick(f"<aside><h2>{say(1, 3)}</h2><p>{long}</p></aside>", f"<div{attr(['sidebar', 'widget', 'related', 'recommended'])}><h3>{say(1, 3)}</h3>{links()}<p>{long}</p></div>", f"<aside>{links()}</aside>")
        if kind == "ad":
            return pick(f"<div{attr(['ad', 'ads', 'advert', 'banner', 'sponsor', 'promo', 'advertisement'])}>{long}</div>", f"<section{attr(['promo', 'sponsored'])}><p>{long}</p></section>")
        if kind == "notice":
            return f"<{pick('div', 'section')}{attr(['cookie', 'notice', 'consent', 'newsletter', 'alert', 'gdpr', 'popup'])}><p>{long}</p>{pick('', '<button>ok</button>')}</div>"
        if kind == "form":
            return f"<form{pick('', attr(['search', 'login', 'subscribe', 'signup']))}><label>{say(1, 4)}</label><p>{say(1, 12)}</p><input><button>{say(1, 2)}</button></form>"
        if kind == "share":
            return f"<div{attr(['share', 'social', 'tags', 'meta', 'byline'])}>{links()}<p>{say(1, 5)}</p></div>"
        inner = "".join(f"<{pick('li', 'div', 'article')}{attr(['comment', 'reply'])}><p>{say(1, 4)}</p><p>{say(4, 60)}</p></div>" for _ in range(r.randint(1, 6)))
        return f"<{pick('section', 'div', 'div')}{attr(['comments', 'discussion', 'respond', 'comment-list'])}><h3>{say(1, 3)}</h3>{inner}</div>"

    kinds = ["ad", "share", "form", "notice", "aside"]
    parts = [block(pick("h1", "h1", "h2"), 3, 14)] if r.random() < 0.85 else []
    for _ in range(pick(0, 1, 2, 4, 8, 14)):
        x = r.random()
        if x < 0.72:
            parts.append(block("p", *pick((1, 6), (10, 60), (40, 120))))
        elif x < 0.82:
            parts.append(block(pick("h2", "h3"), 1, 8))
        elif x < 0.88:
            parts.append("<ul>" + "".join(block("li", 1, 20) for _ in range(r.randint(1, 5))) + "</ul>")
        elif x < 0.92:
            parts.append("<blockquote>" + block("p", 5, 40) + "</blockquote>")
        else:
            parts.append(noise(pick(*kinds)))
    body = "".join(parts)
    open_, close = pick(("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (f"<div{attr(_GOOD[:7])}>", "</div>"), (f"<article{attr(_GOOD)}>", "</article>"), ("<div>", "</div>"), (f"<div{attr(['content', 'main'])}><div{attr(['post', 'entry', 'article'])}>", "</div></div>"))
    before = [noise(pick("nav", "header", "notice", "ad", "form")) for _ in range(r.randint(0, 3))]
    after = [noise(pick("footer", "aside", "ad", "comments", "comments", "share", "notice")) for _ in range(r.randint(0, 4))]
    whole = "".join(before) + open_ + body + close + "".join(after)
    if r.random() < 0.4:
        whole = f"<div{attr(['wrapper', 'container', 'page', 'layout'])}>{whole}</div>"
    return f"<!DOCTYPE html><html><head><title>{say(2, 6)}</title></head><body>{whole}</body></html>", main


@lru_cache(1)
def model(pages: int = 900, seed: int = 11) -> boosting.Trees:
    """Trees fitted on ``pages`` made-up pages (the bound of the sample); the same on every machine."""
    r = random.Random(seed)
    rows, labels = [], []
    for _ in range(pages):
        page, main = _sample_page(r)
        nodes, blocks = parse(page)
        left = list(main)
        good = set()
        for k, text in blocks:
            if left and text == left[0]:
                left.pop(0)
                good.add(k)
        x = features(nodes)
        held = np.array([bool(n.texts) for n in nodes])
        inside = np.array([k in good for k in range(len(nodes))])
        for k in range(len(nodes) - 1, 0, -1):  # a container is main text if most of its text is
            held[nodes[k].parent] |= held[k]
        share, total = np.zeros(len(nodes)), np.zeros(len(nodes))
        for k in range(len(nodes) - 1, -1, -1):
            share[k] += nodes[k].chars * inside[k]
            total[k] += nodes[k].chars
            if k:
                share[nodes[k].parent] += share[k]
                total[nodes[k].parent] += total[k]
        keep = total > 0
        rows.append(x[keep])
        labels.append((share[keep] > 0.5 * total[keep]).astype(float))
    return boosting.fit(np.concatenate(rows), np.concatenate(labels), trees=60, depth=4)


def extract(pages: list[str | None], trees: boosting.Trees | None = None) -> list[str]:
    """Main text of each page: its blocks in page order, one line each."""
    trees = trees or model()
    parsed = [parse(p or "") for p in pages]
    rows = [features(nodes) for nodes, _ in parsed]
    odds = trees.decision(np.concatenate(rows)) if rows else np.empty(0)
    out, at = [], 0
    for (nodes, blocks), x in zip(parsed, rows, strict=True):
        keep = decode(nodes, odds[at : at + len(x)])
        at += len(x)
        out.append("\n".join(text for k, text in blocks if keep[k]))
    return out


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of ``pages(page_id, url, html)``.

    A null or empty page, and one without main text, has an empty text. Whole pages are read, repeated rows each;
    other columns are ignored. The trees are fitted once, on the driver, on a bounded sample, and sent to the tasks.
    """
    trees = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = extract(part.column("html").to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
