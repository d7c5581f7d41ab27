"""Main text of web pages by a tree-structured graphical model over DOM nodes."""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A quote belongs to a value only after `=`; a stray one is part of the tag.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Element names by their part. Fixed values.
RAW = {"script", "style", "template", "textarea", "iframe", "title", "select"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = {"math", "mi", "mn", "mo", "mrow", "msup", "msub", "mfrac", "msqrt", "mtext", "svg", "text", "tspan", "g", "path", "object", "noscript", "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: A start of one of these ends an open element of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
GROUPS = {"article": "article", "main": "article", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "button": "form", "fieldset": "form", "input": "form", "dialog": "notice", "section": "section", "div": "div", "p": "p", "blockquote": "p", "pre": "p", "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item", "table": "table", "tr": "table", "td": "table", "th": "table", "figure": "figure", "figcaption": "figure", "body": "body", "html": "html", "head": "head"}
CONTAINERS = {"html", "body", "article", "main", "section", "div", "header", "footer", "aside", "nav", "form"}
HINTS = {
    "nav": ("nav", "navbar", "menu", "breadcrumb", "breadcrumbs", "pagination", "toc"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner"),
    "comment": ("comment", "comments", "discussion", "replies", "reply", "respond", "disqus"),
    "side": ("sidebar", "aside", "related", "recommended", "widget", "share", "social", "trending"),
    "notice": ("cookie", "cookies", "consent", "notice", "newsletter", "subscribe", "popup", "modal", "alert", "gdpr"),
    "foot": ("footer", "copyright", "legal"),
    "head": ("header", "masthead", "topbar", "logo"),
    "form": ("form", "search", "login", "signup"),
    "body": ("article", "content", "post", "entry", "story", "main", "text", "body"),
}
HINT_OF = {w: kind for kind, words in HINTS.items() for w in words}


@dataclass
class Node:
    tag: str
    parent: int
    hints: tuple[str, ...] = ()
    chars: int = 0
    linked: int = 0
    children: list[int] = field(default_factory=list)


def _hints(attributes: str) -> set[str]:
    """What the words of a tag's class, id and role hint at; `mainContent` is two words."""
    found = ATTR.findall(attributes) if attributes else ()
    return {HINT_OF[w] for f in found for w in map(str.lower, re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", "".join(f))) if w in HINT_OF}


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(nodes, blocks): block elements as a tree in page order, node 0 the root, and (node, raw text) of each block.

    Inline elements are part of their block, but for those whose attributes hint at anything but content: they are
    nodes of their own. Ends without a start are ignored, open elements end with their
    parent or where HTML says so, and an unfinished comment or tag runs to the end of the page.
    """
    nodes, blocks, stack = [Node("html", -1)], [], [0]
    opened: Counter[str] = Counter()  # open nodes by tag, without the root
    inner: dict[int, int] = {}  # plain elements that are open inside a node of the same inline tag
    text: list[str] = []
    links = at = 0

    def flush() -> None:
        nonlocal text
        if text:
            blocks.append((stack[-1], "".join(text)))
            text = []

    def add(part: str) -> None:
        if part:
            text.append(part)
            size = len(part.strip())
            nodes[stack[-1]].chars += size
            if links:
                nodes[stack[-1]].linked += size

    def close(depth: int) -> None:
        opened.subtract(nodes[i].tag for i in stack[depth:])
        del stack[depth:]

    pos = 0
    while (m := TAG.search(page, pos)) is not None:
        add(page[pos : m.start()])
        pos, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE and nodes[stack[-1]].tag == tag:
                if inner.get(stack[-1], 0):
                    inner[stack[-1]] -= 1
                else:
                    flush()
                    close(len(stack) - 1)
            if tag not in INLINE and tag not in VOID and opened[tag]:
                flush()
                depth = len(stack) - 1
                while nodes[stack[depth]].tag != tag:
                    depth -= 1
                close(depth)
                links = 0
        elif tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, pos)
                pos = end.end() if end else len(page) if tag in ("script", "style") else pos
        elif tag in INLINE and not _hints(m[3]) - {"body"}:
            links += tag == "a"
            if nodes[stack[-1]].tag == tag:
                inner[stack[-1]] = inner.get(stack[-1], 0) + 1
        elif tag in VOID:
            if tag in ("br", "hr"):
                text.append(" ")
        elif tag not in ("html",):
            flush()
            ends = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
            for depth in range(len(stack) - 1, 0, -1) if any(opened[t] for t in ends) else ():
                open_tag = nodes[stack[depth]].tag
                if open_tag in ends:
                    close(depth)
                    break
                if open_tag in ("ul", "ol", "dl", "table", "div", "article", "section", "blockquote"):
                    break
            nodes.append(Node(tag, stack[-1], tuple(sorted(_hints(m[3])))))
            nodes[stack[-1]].children.append(len(nodes) - 1)
            stack.append(len(nodes) - 1)
            opened[tag] += 1
            links = 0
    add(page[pos:])
    flush()
    return nodes, blocks


def observations(nodes: list[Node]) -> list[list[str]]:
    """What is seen of each node: its kind, the hints of its attributes, and its own length and link share."""
    out = []
    for n in nodes:
        seen = ["tag:" + ("heading" if re.fullmatch(r"h[1-6]", n.tag) else GROUPS.get(n.tag, "other"))]
        seen += ["hint:" + h for h in n.hints] or ["hint:none"]
        seen.append("chars:" + ("0" if not n.chars else "s" if n.chars < 25 else "m" if n.chars < 120 else "l"))
        if n.chars:
            seen.append("links:" + ("0" if not n.linked else "some" if n.linked * 2 < n.chars else "most"))
        out.append(seen)
    return out


@dataclass
class Model:
    """Log potentials: of an observation under boilerplate (0) and content (1), of a child's label under its
    parent's (apart for containers and other blocks), of the root."""

    seen: dict[str, tuple[float, float]]
    edge: np.ndarray
    root: np.ndarray

    @classmethod
    def fit(cls, pages: list[tuple[str, list[int]]]) -> "Model":
        """Smoothed counts over pages whose nodes are labelled."""
        counts: dict[str, list[float]] = {}
        edge, root, size = np.ones((2, 2, 2)), np.ones(2), np.ones(2)
        for page, labels in pages:
            nodes, _ = parse(page)
            for i, (n, seen) in enumerate(zip(nodes, observations(nodes))):
                size[labels[i]] += 1
                for s in seen:
                    counts.setdefault(s, [0.5, 0.5])[labels[i]] += 1
                if n.parent >= 0:
                    edge[int(n.tag in CONTAINERS), labels[n.parent], labels[i]] += 1
                else:
                    root[labels[i]] += 1
        seen = {s: (float(np.log(a / size[0])), float(np.log(b / size[1]))) for s, (a, b) in counts.items()}
        return cls(seen, np.log(edge / edge.sum(2, keepdims=True)), np.log(root / root.sum()))

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of every node: messages from the leaves up, then from the root down."""
        edges = np.exp(self.edge).tolist()
        n = len(nodes)
        own0, own1, up0, up1 = [1.0] * n, [1.0] * n, [1.0] * n, [1.0] * n
        for i, seen in enumerate(observations(nodes)):
            a = b = 0.0
            for s in seen:
                x, y = self.seen.get(s, (0.0, 0.0))
                a += x
                b += y
            top = max(a, b)
            own0[i], own1[i] = float(np.exp(a - top)) if a < top else 1.0, float(np.exp(b - top)) if b < top else 1.0
        for i in range(n - 1, -1, -1):  # children come after their parents
            a, b = own0[i], own1[i]
            total = a + b
            own0[i], own1[i] = a, b = a / total, b / total
            (e00, e01), (e10, e11) = edges[nodes[i].tag in CONTAINERS]
            up0[i], up1[i] = e00 * a + e01 * b, e10 * a + e11 * b
            if (p := nodes[i].parent) >= 0:
                own0[p] *= up0[i]
                own1[p] *= up1[i]
                if (s := own0[p] + own1[p]) < 1e-100:
                    own0[p], own1[p] = own0[p] / s, own1[p] / s
        down0, down1, out = [1.0] * n, [1.0] * n, [0.0] * n
        down0[0], down1[0] = np.exp(self.root).tolist()
        for i in range(n):
            a, b = down0[i] * own0[i], down1[i] * own1[i]
            total = a + b
            a, b = a / total, b / total
            out[i] = b
            for c in nodes[i].children:
                (e00, e01), (e10, e11) = edges[nodes[c].tag in CONTAINERS]
                x, y = a / up0[c], b / up1[c]
                down0[c], down1[c] = x * e00 + y * e10, x * e01 + y * e11
                s = down0[c] + down1[c]
                down0[c], down1[c] = down0[c] / s, down1[c] / s
        return out

    def text(self, page: str) -> str:
        nodes, blocks = parse(page)
        content = self.marginals(nodes)
        parts = (" ".join(html.unescape(raw).split()) for i, raw in blocks if content[i] >= 0.5)
        return " ".join(p for p in parts if p)


def labelled_pages(n: int = 400, seed: int = 0) -> list[tuple[str, list[int]]]:
    """Made pages and the label of every node, from the layouts that sites use; `n` bounds the training set."""
    rng = random.Random(seed)
    words = lambda a, b: " ".join("".join(rng.choice(("an", "re", "th", "in", "er", "on", "ti", "es")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))
    out = []
    for _ in range(n):
        parts: list[str] = []
        labels: dict[int, int] = {}
        count = 1

        def node(tag: str, label: int, attrs: str, inner) -> None:
            nonlocal count
            labels[count] = label
            count += 1
            parts.append(f"<{tag}{attrs}>")
            inner()
            parts.append(f"</{tag}>")

        def say(tag: str, label: int, a: int, b: int, attrs: str = "", link: bool = False) -> None:
            node(tag, label, attrs, lambda: parts.append(f'<a href="/x">{words(a, b)}</a>' if link else words(a, b)))

        def links(k: int, label: int = 0) -> None:
            node("ul", label, "", lambda: [say("li", label, 1, 3, link=True) for _ in range(k)])

        def named(kind: str) -> str:
            return f' {rng.choice(("class", "id"))}="{rng.choice(HINTS[kind])}"'

        def content() -> None:
            if rng.random() < 0.15:
                node("header", 1, "", lambda: say("h1", 1, 3, 10))
            else:
                say("h1", 1, 3, 10)
            for _ in range(rng.randint(1, 8)):
                r = rng.random()
                if r < 0.6:
                    say("div" if plain else "p", 1, 1, 80)
                elif r < 0.62:
                    say("div" if plain else "p", 1, 8, 40, link=True)
                elif r < 0.7:  # something of a hinted inline element stands in the paragraph
                    node("p", 1, "", lambda: (parts.append(words(1, 40) + " "), say("span", 0, 1, 8, named(rng.choice(("ad", "side", "notice")))), parts.append(" " + words(1, 40))))
                elif r < 0.78:
                    say(rng.choice(("h2", "h3")), 1, 2, 6)
                elif r < 0.86:
                    node(rng.choice(("ul", "ol")), 1, "", lambda: [say("li", 1, 2, 20) for _ in range(rng.randint(2, 5))])
                elif r < 0.9:
                    node("blockquote", 1, "", lambda: say("p", 1, 5, 40))
                elif r < 0.94:
                    node("table", 1, "", lambda: node("tr", 1, "", lambda: [say("td", 1, 1, 6) for _ in range(3)]))
                elif r < 0.97:
                    node("div", 0, named("ad"), lambda: say("p", 0, 2, 20))
                else:
                    node(rng.choice(("aside", "div")), 0, named("side"), lambda: links(rng.randint(2, 4)))

        def around(kind: str) -> None:
            tag = {"nav": "nav", "foot": "footer", "head": "header", "side": "aside", "form": "form"}.get(kind, "div")
            plain = rng.random() < 0.5 and tag != "div"
            attrs = "" if plain else named(kind)
            tag = tag if plain or rng.random() < 0.5 else rng.choice(("div", "section"))
            body = {
                "nav": lambda: links(rng.randint(3, 8)),
                "foot": lambda: parts.append(words(3, 25)) if rng.random() < 0.5 else say("p", 0, 3, 25),
                "head": lambda: say("h1" if rng.random() < 0.2 else "div", 0, 1, 4, named("head")),
                "side": lambda: (say("h3", 0, 1, 3), links(rng.randint(2, 6)), say("p", 0, 3, 30)),
                "form": lambda: (say("p", 0, 1, 8), say("button", 0, 1, 2)),
                "ad": lambda: parts.append(words(3, 40)) if rng.random() < 0.5 else say("p", 0, 3, 40),
                "comment": lambda: (say("h3", 0, 1, 3), [node("div", 0, named("comment"), lambda: say("p", 0, 3, 60)) for _ in range(rng.randint(1, 4))]),
                "notice": lambda: (say("p", 0, 4, 30), say("button", 0, 1, 2)),
            }[kind]
            node(tag, 0, attrs, body)

        def whole() -> None:
            for kind in rng.sample(("notice", "head", "nav", "ad", "form"), rng.randint(1, 4)):
                around(kind)
            if bare:
                content()
            elif not plain and rng.random() < 0.7:
                node(rng.choice(("article", "main")), 1, "" if rng.random() < 0.7 else named("body"), content)
            else:
                node("div", 1, "" if plain else named("body"), content)
            for kind in rng.sample(("side", "comment", "foot", "ad", "nav"), rng.randint(1, 4)):
                around(kind)

        bare = rng.random() < 0.1  # the content stands in the body itself
        plain = rng.random() < 0.15  # the content is of elements that say nothing of it
        node("body", int(bare), "", whole)
        out.append(("<html>" + "".join(parts) + "</html>", [0, *(labels[i] for i in range(1, count))]))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`id, url, text, n_chars` of every page, each judged whole where it is read, with no shuffle.

    The model is trained once from `labelled_pages` (its number is bounded) and sent to the tasks. A block's
    text is kept when its node's marginal is at least one half. References are decoded, white space inside a
    block becomes one space, blocks are joined in page order by one space. Null and empty pages and pages
    without content give an empty text; repeated rows stay; other columns are unused.
    """
    model = Model.fit(labelled_pages())
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.text(p or "") for p in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return rows.mapInArrow(read, f"id {dict(rows.dtypes)['id']}, url string, text string, n_chars long")
