"""Operator 8: HTML extraction by a tree-structured graphical model.

A page becomes a tree of its block elements, whose leaves are the text
blocks (runs of text with no block border inside). Each node is content or
not. Unary potentials come from the node's tag, the words of its class, id
and role, and for leaves from text length, link share, sentence marks and
place; parent-child potentials tie a node to its parent, one 2 x 2 table for
each kind of edge. Sum-product messages go up and then down the
tree, which is exact on a tree, and give each leaf's content marginal; the
page's text is its leaves with a marginal of at least one half.

The potentials are trained by gradient ascent on the exact likelihood of
labelled pages: ``LABELLED`` below (each block element marked), and at most
``sample_rows`` pages of the table whose leaves all lie inside elements that
name their role (``ROLES``).

Tags are read with a tolerant tokenizer: unclosed and crossing tags,
unquoted attributes, comments, truncated pages. Only scripts, styles,
textareas, titles and iframes hold raw text, which is no text of the page and
ends at their end tag. Selects, objects, noscript and templates are elements of
the tree, of which the model judges; drawings and formulas are part of the block
around them, and so is their text. Any of these six without an end tag of its
own holds nothing, and "/>" closes drawings, formulas and what is in them. Character references are decoded, white space in a block becomes one
space (``<br>`` is white space), blocks are joined by one newline in page
order. Nothing is cut.

Defined cases: null html is empty and gives an empty text; every input row
gives one output row; a page without text has an empty text; other columns
are not looked at.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample

SAMPLE_ROWS = 100

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
    # a quote opens a value only after an equals sign
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>=]+|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|</?[a-zA-Z][^>]*\Z"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())  # their content is no markup
FOREIGN = frozenset("svg math".split())
PAIRED = FOREIGN | frozenset("select object noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | FOREIGN
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: start tag -> open tags that it closes, up to the element that holds them
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "option": ("option",)}
HOLDERS = frozenset("ul ol menu dl table body html article section div nav aside header footer main form".split())

FRAME = frozenset("html body".split())
CONTAINERS = frozenset("article aside body center dialog div dl footer form header main menu nav ol section table ul".split())

# Elements and class words that name a role (True: content).
ROLES = {"article": True, "main": True, "nav": False, "footer": False, "aside": False, "form": False, "header": False, "menu": False, "button": False}
ROLE_WORDS = {w: False for w in "ad ads advert advertisement sponsored promo banner sidebar menu nav navigation navbar breadcrumb breadcrumbs footer header masthead cookie cookies consent notice popup modal newsletter subscribe social share related comment comments disqus replies".split()}


class Node:
    __slots__ = ("tag", "words", "parent", "kids", "text", "linked", "content")

    def __init__(self, tag, words, parent):
        self.tag, self.words, self.parent = tag, words, parent
        self.kids, self.text, self.linked, self.content = [], None, 0, None


def _words_of(attrs: str) -> tuple:
    found = [w for m in _ATTR.finditer(attrs) for w in _WORD.findall((m[2] or m[3] or m[4] or "").lower())]
    return tuple(dict.fromkeys(found))


class _Open(list):
    """Open elements, the root first; how many there are of each name, and what
    holds the text of each, are kept, so that no step looks through all of them."""

    def __init__(self, nodes):
        super().__init__(nodes)
        self._count: dict[str, int] = {}
        self._holders = list(nodes)

    def append(self, node) -> None:
        self._count[node.tag] = self._count.get(node.tag, 0) + 1
        self._holders.append(self._holders[-1] if node.tag in INLINE else node)
        super().append(node)

    def pop(self):
        node = super().pop()
        self._count[node.tag] -= 1
        self._holders.pop()
        return node

    def drop(self, lo: int, hi: int) -> None:
        """Takes out elements: inline ones, or all from ``lo`` on."""
        for x in self[lo:hi]:
            self._count[x.tag] -= 1
        del self[lo:hi], self._holders[lo:hi]

    def has(self, tag: str) -> bool:
        """Whether one of that name is open, besides the root."""
        return self._count.get(tag, 0) > 0

    def holder(self):
        return self._holders[-1]


def parse(page: str) -> tuple[Node, list[Node]]:
    """Root and text blocks (in page order) of a page."""
    root = Node("html", (), None)
    blocks: list[Node] = []
    stack = _Open([root])  # open elements; inline ones too
    pieces: list[str] = []
    linked = 0
    pos, n = 0, len(page)

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join(htmllib.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                up = stack.holder()
                leaf = Node("#text", (), up)
                leaf.text, leaf.linked = text, min(linked, len(text))
                up.kids.append(leaf)
                blocks.append(leaf)
        linked = 0

    edges: dict[str, tuple[list[int], list[bool]]] = {}  # where tags of an element stand, and which are end tags

    def closed(tag: str) -> bool:
        """Whether the next tag of that name is an end tag."""
        if tag not in edges:
            found = list(re.finditer(rf"<(/?){tag}(?=[\s/>])([^>]*)", page, re.I))
            found = [x for x in found if x[1] or tag not in FOREIGN or not x[2].endswith("/")]
            edges[tag] = [x.start() for x in found], [bool(x[1]) for x in found]
        at = bisect_left(edges[tag][0], pos)
        return at < len(edges[tag][0]) and edges[tag][1][at]

    links = 0
    while pos < n:
        m = _TOKEN.match(page, pos)
        pos = m.end()
        if m["text"] is not None:
            pieces.append(m["text"])
            if links:
                linked += len(m["text"].strip())
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        ends, attrs = bool(m["end"] or m["end2"]), m["attrs"] if m["tag"] else m["attrs2"]
        if stack[-1].tag in FOREIGN and tag != stack[-1].tag:
            # what is drawn is no element of the page; blocks end the drawing
            if tag in CLOSES_P or tag in SIBLINGS or tag in PAIRED or tag in HOLDERS:
                if not ends:
                    stack.pop()
            elif ends or tag not in RAW or attrs.endswith("/"):
                pieces.append(" ")
                continue
        if ends:
            if not stack.has(tag):
                continue
            if tag in INLINE and tag not in ("a",) and stack[-1].tag != tag:
                # a crossing inline end tag closes that element alone
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        stack.drop(i, i + 1)
                        break
                    if stack[i].tag not in INLINE:
                        break
                continue
            if tag not in INLINE:
                flush()
            elif tag in FOREIGN:
                pieces.append(" ")
            while len(stack) > 1:
                x = stack.pop()
                links -= x.tag == "a"
                if x.tag == tag:
                    break
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, pos)
            if tag in ("textarea", "iframe"):
                pieces.append(" ")
            pos = close.end() if close else n
            continue
        if tag in ("option", "optgroup") and not stack.has("select"):
            continue  # of a select that never ends
        if tag in PAIRED:
            if tag in FOREIGN:
                pieces.append(" ")
                if attrs.endswith("/"):
                    continue
            if not closed(tag):
                continue
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                if tag == "br":
                    pieces.append(" ")
                continue
            node = Node(tag, (), stack[-1])
            stack.append(node)
            links += tag == "a"
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in CLOSES_P or tag in SIBLINGS:
            ended = (*SIBLINGS.get(tag, ()), *(("p",) if tag in CLOSES_P else ()))
            for i in range(len(stack) - 1, 0, -1) if any(map(stack.has, ended)) else ():
                open_tag = stack[i].tag
                if (open_tag == "p" and tag in CLOSES_P) or open_tag in SIBLINGS.get(tag, ()):
                    flush()
                    for x in stack[i:]:
                        links -= x.tag == "a"
                    stack.drop(i, len(stack))
                    if open_tag == "p":
                        break
                elif open_tag not in INLINE and (open_tag in HOLDERS or tag not in SIBLINGS):
                    break
        flush()
        words = _words_of(attrs) if "=" in attrs else ()
        up = stack.holder()
        if tag in ("html", "body") and (tag == "html" or stack.has(tag)):
            continue
        node = Node(tag, words, up)
        up.kids.append(node)
        stack.append(node)
    flush()
    return root, blocks


def _mean_length(x: Node) -> int:
    return min(int(math.log2(1 + len(x.text))), 10)


def leaf_features(x: Node, place: int, count: int) -> list[str]:
    share = x.linked / max(1, len(x.text))
    marks = sum(x.text.count(c) for c in ".,;:!?")
    return [
        f"len{_mean_length(x)}",
        "link" + ("0" if share < 0.05 else "1" if share < 0.5 else "2"),
        "marks" + str(min(marks, 3)),
        "first" if place == 0 else "last" if place == count - 1 else "mid",
        "in:" + x.parent.tag,
        "copy" if "©" in x.text else "nocopy",
    ]


def features(root: Node, blocks: list[Node]) -> tuple[list[Node], list[list[str]]]:
    """Nodes that lie above a text block (parents first) and their features."""
    wanted = set()
    for b in blocks:
        x = b
        while x is not None and id(x) not in wanted:
            wanted.add(id(x))
            x = x.parent
    place = {id(b): i for i, b in enumerate(blocks)}
    nodes, feats = [], []
    todo = [root]
    while todo:
        x = todo.pop()
        if id(x) not in wanted:
            continue
        nodes.append(x)
        if x.text is not None:
            feats.append(leaf_features(x, place[id(x)], len(blocks)))
        else:
            feats.append(["tag:" + x.tag, *("word:" + w for w in x.words)])
            todo.extend(reversed(x.kids))
    return nodes, feats


def _edge(x: Node) -> str:
    """Which potential table ties a node to its parent: text follows it, parts
    of prose (paragraphs, headings, lists) mostly do, containers may differ,
    and children of the page's frame say little about it."""
    if x.text is not None:
        return "leaf"
    if x.parent is None or x.parent.tag in FRAME:
        return "top"
    return "container" if x.tag in CONTAINERS else "inner"


def _message(x: float, t: list[float]) -> float:
    """Log odds sent over an edge with table (t00, t01, t10, t11), from a
    sender with log odds x in the second place: log(sum_b t1b e^bx / sum_b t0b e^bx)."""
    e = math.exp(min(max(x, -30.0), 30.0))
    return math.log((math.exp(t[2]) + math.exp(t[3]) * e) / (math.exp(t[0]) + math.exp(t[1]) * e))


def marginals(nodes: list[Node], unary: list[float], tables: dict) -> tuple[list[float], list[float], list[float]]:
    """Log odds of content of each node, and the messages: up (to the parent)
    and the parent's log odds without that child."""
    at = {id(x): i for i, x in enumerate(nodes)}
    up = [0.0] * len(nodes)
    own = list(unary)
    for i in range(len(nodes) - 1, 0, -1):
        t = tables[_edge(nodes[i])]
        up[i] = _message(own[i], t)
        own[at[id(nodes[i].parent)]] += up[i]
    full, rest = list(own), [0.0] * len(nodes)
    for i in range(1, len(nodes)):
        t = tables[_edge(nodes[i])]
        rest[i] = full[at[id(nodes[i].parent)]] - up[i]
        full[i] = own[i] + _message(rest[i], [t[0], t[2], t[1], t[3]])
    return full, own, rest


def train(pages: list[tuple[list[Node], list[list[str]]]], epochs: int = 25, rate: float = 0.3, decay: float = 1e-5, seed: int = 1) -> dict:
    """Potentials from pages whose nodes carry ``content`` (None: not known)."""
    weights: dict[str, float] = {"bias:leaf": 0.0, "bias:element": 0.0}
    tables = {"leaf": [1.0, -1.0, -1.0, 1.0], "inner": [1.0, -1.0, -1.0, 1.0], "container": [0.2, -0.2, -0.2, 0.2], "top": [0.0, 0.0, 0.0, 0.0]}
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        step = rate / (1 + 0.2 * epoch)
        for p in rng.permutation(len(pages)):
            nodes, feats = pages[p]
            if not nodes:
                continue
            model = {"weights": weights, "tables": tables}
            unary = unaries(model, nodes, feats)
            full, own, rest = marginals(nodes, unary, tables)
            # nodes whose label is not known take the model's own marginal
            prob = [1 / (1 + math.exp(-min(max(f, -30), 30))) for f in full]
            truth = [q if x.content is None else float(x.content) for x, q in zip(nodes, prob, strict=True)]
            at = {id(x): i for i, x in enumerate(nodes)}
            for i, x in enumerate(nodes):
                err = truth[i] - prob[i]
                kind = "leaf" if x.text is not None else "element"
                if err:
                    for f in [*feats[i], "bias:" + kind]:
                        weights[f] = weights.get(f, 0.0) * (1 - decay) + step * err
                if i and x.content is not None and x.parent.content is not None:
                    t = tables[_edge(x)]
                    y, z = rest[i], own[i]
                    e = [t[0], t[1] + z, t[2] + y, t[3] + y + z]
                    top = max(e)
                    e = [math.exp(v - top) for v in e]
                    total = sum(e)
                    seen = 2 * int(nodes[at[id(x.parent)]].content) + int(x.content)
                    for c in range(4):
                        t[c] += 0.5 * step * ((c == seen) - e[c] / total)
    return {"weights": weights, "tables": tables}


def unaries(model: dict, nodes: list[Node], feats: list[list[str]]) -> list[float]:
    w = model["weights"]
    leaf, element = w.get("bias:leaf", 0.0), w.get("bias:element", 0.0)
    return [(leaf if x.text is not None else element) + sum(w.get(f, 0.0) for f in fs) for x, fs in zip(nodes, feats, strict=True)]


def extract(model: dict, page: str) -> str:
    """Main text of one page."""
    root, blocks = parse(page)
    if not blocks:
        return ""
    nodes, feats = features(root, blocks)
    full, _, _ = marginals(nodes, unaries(model, nodes, feats), model["tables"])
    keep = {id(x) for x, f in zip(nodes, full, strict=True) if x.text is not None and f >= 0}
    return "\n".join(b.text for b in blocks if id(b) in keep)


def _label_by_mark(root: Node, nodes: list[Node]) -> None:
    """Labels of the built-in pages: class word ``keep`` or ``drop`` on the
    nearest marked element above; the frame around them is not content."""
    for x in nodes:
        y = x
        while y is not None and "keep" not in y.words and "drop" not in y.words:
            y = y.parent
        x.content = y is not None and "keep" in y.words
    for x in nodes:
        x.words = tuple(w for w in x.words if w not in ("keep", "drop"))


def _label_by_role(root: Node, nodes: list[Node], blocks: list[Node]) -> bool:
    """Labels from elements that name their role, the innermost rejecting one
    first; whether every text block has one and both kinds occur."""
    for x in nodes:
        verdict, y = (None if x.text is not None else False), x
        while y is not None:
            named = [ROLES[y.tag]] if y.tag in ROLES else []
            named += [ROLE_WORDS[w] for w in y.words if w in ROLE_WORDS]
            if False in named:
                verdict = False
                break
            if True in named:
                verdict = True
            y = y.parent
        x.content = verdict
    return {b.content for b in blocks} == {True, False}


_SENTENCES = [
    "The river rose after three days of rain, and the lower fields stood under water by noon.",
    "Nobody in the village had seen it climb so fast; the old mill lost its wheel, its door and half its roof.",
    "Repairs will take until spring, the council said, because the bridge has to be closed first.",
    "Farmers moved their animals to the hill. Some of them slept in the church.",
]
_PROSE = "".join(f"<p>{a} {b}</p>" for a, b in zip(_SENTENCES, _SENTENCES[1:] + _SENTENCES[:1], strict=True))
_SHORT = "<p>Short note.</p><p>More follows soon, and it is worth the wait.</p>"
_LINKS = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>World news</a></li><li><a href='/c'>Sport</a></li></ul>"
_BODY = "<h1>Flood reaches the old mill</h1>" + _PROSE + "<h2>What comes next</h2>" + _SHORT + "<blockquote>It took the door, she said.</blockquote><ul><li>The mill is shut.</li><li>The bridge is closed, too.</li></ul>"

# Parts of articles of the built-in labelled pages, besides plain prose.
_PARTS = [
    "<p>See <a href='/a'>the whole report of the council on the flood</a></p>",
    "<p><a href='/a'>The report on the flood</a></p>",
    "<table><tr><th>Day</th><th>Metres</th></tr><tr><td>Monday</td><td>3.1</td></tr><tr><td>Tuesday, at noon</td><td>2.9</td></tr></table>",
    "<dl><dt>Mill</dt><dd>A house that grinds corn.</dd><dt>Weir</dt><dd>A low dam</dd></dl>",
    "<ul><li><a href='/m'>The old mill</a></li><li><a href='/b'>The bridge</a> is closed.</li></ul>",
    "<blockquote><p>It took the door, she said.</p></blockquote>",
    "<figure><img src='m.png'><figcaption>The mill before the flood</figcaption></figure>",
    "<div><p>The church was dry.</p><p>It stands on the hill, above the river.</p></div>",
    "<details><summary>How it was measured</summary><p>With a rod, at the bridge.</p></details>",
    "<pre>level 3.1\nlevel 2.9</pre>",
    "<section><h3>The bridge</h3><p>It is a hundred years old.</p></section>",
    "<ol><li>Rain</li><li>Flood, by noon</li></ol>",
    "<h2><a href='/x'>What the council says</a></h2>",
    "<p>So</p>",
    "<div><p>It will rain again.</p></div>",
    "<div class='row'><div><p>Nobody was hurt, the doctor said.</p></div></div>",
    "<div>Two boats were lost; one was found at the weir.</div>",
]

# Boilerplate of the built-in labelled pages (tag, attributes, inner html).
_CHROME = [
    ("nav", "", _LINKS),
    ("nav", "class='main navigation'", "<a href='/'>Start</a> <a href='/x'>Archive</a>"),
    ("div", "class='menu'", _LINKS),
    ("ul", "class='breadcrumbs'", "<li><a href='/'>Home</a></li><li>News</li>"),
    ("header", "", "<h1>The Daily Paper</h1><p>News since 1902</p>"),
    ("header", "class='site header'", "<div><a href='/'>The Daily Paper</a></div>" + _LINKS),
    ("div", "class='ad'", "Cheap tyres, today only. Buy now and save."),
    ("div", "class='ads advert advertisement'", "<p>Win a trip to the sea. Order our catalogue today.</p>"),
    ("section", "class='sponsored promo'", "<p>Sponsored: the best knives of the year, tested for you.</p>"),
    ("aside", "", "<h3>Most read</h3>" + _LINKS),
    ("aside", "class='sidebar'", "<p>About the author: writes on rivers, mills and weather.</p>"),
    ("div", "class='sidebar'", "<h2>Archive</h2>" + _LINKS + "<p>Older stories are kept for a year.</p>"),
    ("div", "class='related'", "<h3>Read more</h3>" + _LINKS),
    ("form", "", "<label>Search</label> <input name='q'> <button>Go</button>"),
    ("form", "class='newsletter subscribe'", "<p>Sign up for our letter, it is free.</p><button>Send</button>"),
    ("div", "class='cookie notice consent'", "<p>We use cookies to make this site work, and to learn how it is used.</p><button>Accept</button>"),
    ("div", "class='banner popup modal'", "<p>You have two free stories left this month.</p>"),
    ("div", "class='notice alert'", "<p>This site will be down on Sunday, from two to four.</p>"),
    ("div", "class='social share'", "<a href='#'>Share</a> <a href='#'>Post</a>"),
    ("section", "class='comments'", "<h2>Comments</h2><p>I was there, and it was much worse than you say!</p><p>Great story, thank you.</p>"),
    ("div", "id='comments' class='comment replies'", "<div class='comment'><p>My uncle worked at that mill for thirty years. Sad to see it go.</p></div>"),
    ("footer", "", "&copy; The Daily Paper &middot; All rights reserved."),
    ("footer", "class='site footer'", "<p>Contact us, imprint and privacy.</p>" + _LINKS),
    ("noscript", "", "<p>Please turn on JavaScript to see all of this site.</p>"),
    ("select", "", "<option>English</option><option>Deutsch</option><option>Other languages</option>"),
    ("div", "class='footer'", "<p>&copy; 2020 The Daily Paper. Printed on the hill.</p>"),
]
_HOLDERS = [("article", ""), ("main", ""), ("div", "class='content'"), ("div", "id='article body'"), ("div", "class='post entry text'"), ("section", "class='story'"), ("div", "")]


def _mark(attrs: str, word: str) -> str:
    return re.sub(r"class='", f"class='{word} ", attrs) if "class='" in attrs else f"{attrs} class='{word}'"


def _mark_chrome(i: int) -> str:
    tag, attrs, inner = _CHROME[i % len(_CHROME)]
    return f"<{tag} {_mark(attrs, 'drop')}>{inner}</{tag}>"


def labelled_pages() -> list[str]:
    """Built-in pages: an article in several holders, or in the body itself,
    among boilerplate of every kind, before, after and inside it, elements
    marked keep or drop; articles of many parts: links, tables, lists of every
    kind, quotes, figures, nested divisions."""
    pages = []
    for i in range(len(_CHROME) * 3):
        picks = [i * 5 + 7 * j for j in range(4)] + [i]
        chrome = [_mark_chrome(j) for j in picks]
        inner = chrome[4] if i >= len(_CHROME) else ""
        body = _BODY if i % 4 else "<h1>Flood reaches the old mill</h1>" + _SHORT
        if i % 9 == 8:
            middle = re.sub(r"<(h1|h2|p|blockquote|ul|li)>", r"<\1 class='keep'>", body) + inner
        else:
            tag, attrs = _HOLDERS[i % len(_HOLDERS)]
            middle = f"<{tag} {_mark(attrs, 'keep')}>{body}{inner}</{tag}>"
        pages.append(f"<html><body>{chrome[0]}{chrome[1]}{middle}{chrome[2]}{chrome[3]}</body></html>")
    for i in range(len(_HOLDERS) * len(_PARTS)):  # articles of many parts
        tag, attrs = _HOLDERS[i % len(_HOLDERS)]
        parts = [_PARTS[(i // len(_HOLDERS) + 5 * j) % len(_PARTS)] for j in range(i % 4 + 1)]
        middle = "<h1>Flood reaches the old mill</h1>" + _PROSE + "".join(parts) + (_PROSE if i % 3 else "")
        pages.append(f"<html><body>{_mark_chrome(i)}<{tag} {_mark(attrs, 'keep')}>{middle}</{tag}>{_mark_chrome(i * 5 + 3)}</body></html>")
    for i, text in enumerate(_SENTENCES):  # pages that are hardly more than a text
        alone = f"<p class='keep'>{text}</p>"
        pages += [alone, f"<h1 class='keep'>Flood</h1>{alone}<p class='keep'>{_SENTENCES[i - 1]}</p>", f"<body><div class='keep'>{text}</div></body>", f"<body>{_mark_chrome(i)}{alone}</body>"]
        pages += [f"<article class='keep'><p>{text}</p><p>So</p></article>", f"<body><main class='keep'><h2>And so on</h2><p>{text[:20]}</p></main></body>"]
    return pages


def fit_pages(pages: list[str]) -> dict:
    """Potentials from the built-in pages and those of ``pages`` whose elements name their roles."""
    material = []
    for page in labelled_pages():
        root, blocks = parse(page)
        nodes, _ = features(root, blocks)
        _label_by_mark(root, nodes)
        material.append(features(root, blocks))
    for page in pages:
        root, blocks = parse(page or "")
        nodes, feats = features(root, blocks)
        if blocks and _label_by_role(root, nodes, blocks):
            material.append((nodes, feats))
    return train(material)


def fit(pages: DataFrame, sample_rows: int = SAMPLE_ROWS, page_id: str = "page_id", html: str = "html") -> dict:
    """``fit_pages`` on at most ``sample_rows`` pages, by the id's hash."""
    ids = hash_sample(pages.filter(F.col(html).isNotNull()).select(F.col(page_id).alias("_id")), "_id", sample_rows).distinct()
    rows = (
        pages.select(F.col(page_id).alias("_id"), F.col(html).alias("h"))
        .join(F.broadcast(ids), "_id")  # at most sample_rows ids
        .orderBy(F.xxhash64("_id", F.lit(17)), "_id", F.xxhash64("h"))
        .limit(sample_rows)
        .collect()
    )
    return fit_pages([r["h"] for r in rows])


def extract_text(pages: DataFrame, model: dict, keys: list, html: str = "html") -> DataFrame:
    """``keys`` plus text and n_chars, a row per input row."""
    src = pages.select(*keys, F.col(html).alias("_html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                text = [extract(model, x or "") for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=[*part.schema.names[:-1], "text", "n_chars"])

    return src.mapInArrow(run, f"{fields}, text string, n_chars bigint")


def op8(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_text(pages, fit(pages), ["page_id", "url"])
