"""Operator 1: main text of pages by a tree-structured graphical model.

The block elements of a page form a tree. Each node is content or not; a
log-linear potential of its own looks at the tag, the words in class, id and
role, whether an article is around it, the amount and link share of its text
and its share of the page, and a potential between parent and child, by kind of child, lets content
and boilerplate spread along the tree. Sum-product messages go up to the root and down again and give each
node's marginal; text of nodes with a content marginal of one half or more is
the main text. The weights maximise the likelihood of labelled pages, with the
expected counts of the gradient from the same messages. The default labelled
pages come from templates of common page layouts; pages labelled by hand can
take their place.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta mprescripts none mspace param source track wbr".split())
RAW = frozenset("script style noscript template iframe canvas textarea title desc metadata select head annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr "
    # a formula, the fallback of an object or the labels of a drawing are text of their block
    "object svg g defs symbol use path rect circle ellipse line polyline polygon text tspan textpath math semantics mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts "
    "mstyle merror mpadded mphantom mfenced menclose maction mtable mtr mtd mlabeledtr".split()
)
#: Raw elements that hold nothing when their end tag is missing.
OPEN_RAW = frozenset("head desc metadata annotation annotation-xml".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LANDMARKS = frozenset("nav header footer aside form article main dialog menu button fieldset".split())
TEXT = frozenset("p li h1 h2 h3 h4 h5 h6 td th dd dt pre blockquote figcaption caption address summary".split())
#: Elements that an opening tag of the key ends when they are open.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
#: The search for an open element to end stops at these.
SCOPES = frozenset("ul ol dl table body html div section article td th".split())

_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)/?>?)""", re.S)
_NAMES = re.compile(r"""\b(class|id|role|aria-label|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")
_SLASH_VALUE = re.compile(r"""=[^\s"'=<>]*/>\Z""")


class Node:
    __slots__ = ("tag", "parent", "names", "inside", "chars", "linked", "kids", "total", "bulk", "score", "up", "p", "p_odds")

    def __init__(self, tag: str, parent: Node | None, names: tuple[str, ...]):
        self.tag, self.parent, self.names = tag, parent, names
        #: Whether an article is around the node.
        self.inside = parent is not None and (parent.inside or parent.tag == "article")
        self.chars = self.linked = self.kids = 0
        #: Characters of the node and all below, and how much of the page they are.
        self.total = self.bulk = 0


class _Open:
    """The open elements: (name, block node) from the root on, inline elements with their block.

    Names are counted in every block and every scope, so that an end tag or an
    implied end that has nothing to end costs no search.
    """

    def __init__(self, root: Node):
        self.stack: list[tuple[str, Node]] = [("html", root)]
        self.all: Counter[str] = Counter()
        self.blocks: list[Counter[str]] = [Counter()]
        self.scopes: list[tuple[str, Counter[str]]] = [("html", Counter())]
        self.links = 0

    def push(self, tag: str, node: Node) -> None:
        self.stack.append((tag, node))
        self.all[tag] += 1
        self.links += tag == "a"
        self.scopes[-1][1][tag] += 1
        if tag in INLINE:
            self.blocks[-1][tag] += 1
        else:
            self.blocks.append(Counter())
        if tag in SCOPES:
            self.scopes.append((tag, Counter()))

    def pop(self) -> tuple[str, Node]:
        tag, node = self.stack.pop()
        self.all[tag] -= 1
        self.links -= tag == "a"
        if tag in SCOPES:
            self.scopes.pop()
        self.scopes[-1][1][tag] -= 1
        if tag in INLINE:
            self.blocks[-1][tag] -= 1
        else:
            self.blocks.pop()
        return tag, node

    def end(self, names) -> tuple[str, Node]:
        """Ends open elements up to the nearest with one of the names, and returns that one."""
        while True:
            found = self.pop()
            if found[0] in names:
                return found

    def before(self, tag: str) -> None:
        """Ends what an opening block ends: a paragraph of the same scope, and its like."""
        like = HEADINGS if tag in HEADINGS else ENDS.get(tag, ())
        while True:
            scope, inside = self.scopes[-1]
            found = [x for x in ("p", *like) if inside[x]] or [x for x in like if x == scope]
            if not found:
                return
            self.end(found)


@cache
def _attribute_words(attributes: str) -> tuple[str, ...]:
    out = set()
    for name, a, b, c in _NAMES.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "aria-label"):
            out.update(w.lower() for w in _WORDS.findall(value) if len(w) > 1)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or "display:none" in value.replace(" ", ""):
            out.add("hidden")
    return tuple(sorted(out))


def parse(page: str | None) -> tuple[list[Node], list[tuple[Node, str]]]:
    """(block nodes in page order, runs of text with their block node).

    An empty run marks a break inside a node. Unclosed and stray tags are
    mended the way browsers do in the common cases.
    """
    page = page or ""
    root = Node("html", None, ())
    nodes, runs = [root], []
    open_ = _Open(root)
    unclosed: set[str] = set()
    at, end = 0, len(page)
    while at < end:
        mark = page.find("<", at)
        if mark < 0:
            mark = end
        if mark > at:
            node = open_.stack[-1][1]
            text = page[at:mark]
            runs.append((node, text))
            n = len(text) - text.count(" ")
            node.chars += n
            if open_.links:
                node.linked += n
        if mark == end:
            break
        m = _TAG.match(page, mark)
        if not m:  # a lone "<" is text
            runs.append((open_.stack[-1][1], "<"))
            at = mark + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        closed = m[0].endswith("/>") and not _SLASH_VALUE.search(m[0])  # the slash of <a href=/> is a value
        if m[1]:
            if tag == "br":
                runs.append((open_.stack[-1][1], ""))
            elif tag in INLINE:
                if open_.blocks[-1][tag]:  # an inline end tag does not reach beyond its block
                    open_.end((tag,))
            else:
                names = HEADINGS if tag in HEADINGS else (tag,)
                if any(open_.all[x] for x in names):
                    runs.append((open_.end(names)[1], ""))
            continue
        if tag in RAW:
            if not closed and tag not in unclosed:
                close = _closing(tag).search(page, at)
                if close:
                    at = close.end()
                elif tag in OPEN_RAW:
                    unclosed.add(tag)
                else:
                    at = end
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                runs.append((open_.stack[-1][1], ""))
            continue
        if tag in INLINE:
            if not closed:
                open_.push(tag, open_.stack[-1][1])
            continue
        if tag in ("html", "body"):
            root.names = tuple(sorted({*root.names, *_attribute_words(m[3])})) if tag == "body" else root.names
            continue
        open_.before(tag)
        parent = open_.stack[-1][1]
        runs.append((parent, ""))
        parent.kids += 1
        node = Node(tag, parent, _attribute_words(m[3]))
        nodes.append(node)
        runs.append((node, ""))
        if not closed:
            open_.push(tag, node)
    for node in reversed(nodes):  # children stand after their parents
        node.total += node.chars
        if node.parent is not None:
            node.parent.total += node.total
    for node in nodes:
        node.bulk = 2 if 2 * node.total > root.total else 1 if 10 * node.total > root.total else 0
    return nodes, runs


@cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def kind(node: Node) -> str:
    return "landmark" if node.tag in LANDMARKS else "text" if node.tag in TEXT else "block"


def _size(chars: int) -> int:
    """Amount of text: none, a label, a line, more."""
    return 0 if not chars else 1 if chars < 16 else 2 if chars < 64 else 3


def features(node: Node) -> list[str]:
    place = "^" if node.inside else ""
    out = ["bias", "tag=" + node.tag + place]
    out += ["name=" + w + place for w in node.names]
    if kind(node) == "block":  # what other elements are for is known by their tag
        out.append(f"bulk={node.bulk}")
    chars = node.chars
    if chars:
        if node.tag not in TEXT:  # short paragraphs and items are common inside and outside
            out.append("size=" + str(_size(chars)))
        share = node.linked / chars
        out.append("links=" + ("most" if share > 0.8 else "some" if share > 0.3 else "few"))
    else:
        out.append("size=0")
    return out


class Model:
    """Weights of both potentials and the message passing over one page."""

    def __init__(self):
        self.own: dict[str, float] = defaultdict(float)
        self.pair: dict[str, list[float]] = {k: [0.0] * 4 for k in ("landmark", "text", "block")}
        self.memory: dict[tuple, float] = {}

    def score(self, node: Node) -> float:
        """Log odds of content from the node's own potential."""
        key = (node.tag, node.names, node.inside, node.bulk, _size(node.chars), node.linked > 0.8 * node.chars if node.chars else None, node.linked > 0.3 * node.chars)
        found = self.memory.get(key)
        if found is None:
            if len(self.memory) > 100_000:
                self.memory.clear()
            found = self.memory[key] = sum(self.own.get(f, 0.0) for f in features(node))
        return found

    def marginals(self, nodes: list[Node]) -> None:
        """Sum-product in both directions; sets ``p`` of every node to its content marginal.

        Messages are log odds. ``pair`` holds the log potentials of (parent,
        child) = (not, not), (not, content), (content, not), (content, content).
        """
        for node in nodes:
            node.score = self.score(node)
        for node in reversed(nodes):  # children stand after their parents
            if node.parent is not None:
                a, b, c, d = self.pair[kind(node)]
                x = node.score
                node.up = _log_sum(c, d + x) - _log_sum(a, b + x)
                node.parent.score += node.up
        for node in nodes:
            if node.parent is not None:
                a, b, c, d = self.pair[kind(node)]
                x = node.parent.p_odds - node.up  # all that the parent knows from elsewhere
                down = _log_sum(b, d + x) - _log_sum(a, c + x)
            else:
                down = 0.0
            node.p_odds = node.score + down
            node.p = 1 / (1 + math.exp(-max(min(node.p_odds, 500), -500)))

    def pair_marginal(self, node: Node) -> list[float]:
        x, y = node.parent.p_odds - node.up, node.score
        a, b, c, d = self.pair[kind(node)]
        logs = [a, b + y, c + x, d + x + y]
        top = max(logs)
        values = [math.exp(v - top) for v in logs]
        total = sum(values)
        return [v / total for v in values]

    def learn(self, pages: list[tuple[list[Node], list[int]]], rounds: int = 25, rate: float = 0.5, decay: float = 1e-3) -> None:
        """Adaptive gradient steps on the log-likelihood of labelled pages, one page at a time."""
        grown: dict = defaultdict(float)
        order = random.Random(5)
        pages = list(pages)
        for _ in range(rounds):
            order.shuffle(pages)
            for nodes, labels in pages:
                self.memory.clear()
                self.marginals(nodes)
                own: dict[str, float] = defaultdict(float)
                pair = {k: [0.0] * 4 for k in self.pair}
                place = {id(n): i for i, n in enumerate(nodes)}
                for node, label in zip(nodes, labels):
                    for f in features(node):
                        own[f] += label - node.p
                    if node.parent is not None:
                        g = pair[kind(node)]
                        for i, v in enumerate(self.pair_marginal(node)):
                            g[i] -= v
                        g[2 * labels[place[id(node.parent)]] + label] += 1
                for f, g in own.items():
                    g -= decay * self.own[f]
                    grown[f] += g * g
                    self.own[f] += rate * g / (1 + math.sqrt(grown[f]))
                for k, values in pair.items():
                    for i, g in enumerate(values):
                        g -= decay * self.pair[k][i]
                        grown[k, i] += g * g
                        self.pair[k][i] += rate * g / (1 + math.sqrt(grown[k, i]))
        self.memory.clear()


def _log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def text_of(page: str | None, model: Model) -> str:
    """Main text of a page: blocks with a content marginal of at least one half."""
    nodes, runs = parse(page)
    model.marginals(nodes)
    out: list[str] = []
    part: list[str] = []

    def flush():
        text = _SPACE.sub(" ", html.unescape("".join(part))).strip()
        if text:
            out.append(text)
        part.clear()

    owner = None
    for node, text in runs:
        if node is not owner or not text:
            flush()
            owner = node
        if text and node.p >= 0.5:
            part.append(text)
    flush()
    return " ".join(out)


# Names that layouts give to their parts.
CONTENT_NAMES = "content article post entry story main text body single page blog news read prose markdown".split()
OUTER_NAMES = "wrapper container layout site outer inner row col column grid page app root".split()
BOILERPLATE_NAMES = {
    "nav": "nav navbar navigation menu topbar breadcrumb breadcrumbs tabs links pagination pager toc".split(),
    "header": "header masthead banner logo branding top hero".split(),
    "footer": "footer bottom copyright legal colophon credits".split(),
    "aside": "sidebar aside widget related recommended trending popular tags archive secondary rail".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion affiliate".split(),
    "notice": "cookie consent notice alert gdpr popup modal overlay newsletter subscribe signup paywall toast".split(),
    "form": "form search login contact register subscribe".split(),
    "comments": "comments comment discussion reply replies respond disqus".split(),
    "share": "share social follow meta byline author toolbar".split(),
}


def labelled_pages(count: int = 500, seed: int = 11) -> list[str]:
    """Pages of many layouts whose content blocks carry the attribute ``data-main``."""
    r = random.Random(seed)
    letters = "etaoinshrdlucmfwyp"

    def words(low: int, high: int) -> str:
        return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high)))

    def names(pool: list[str], share: float = 0.8) -> str:
        if r.random() > share:
            return ""
        name = r.choice(["-", "_", " "]).join([r.choice(pool), *([r.choice(OUTER_NAMES)] if r.random() < 0.3 else [])])
        return f' {r.choice(["class", "id", "class"])}="{name}"'

    def links(n: int) -> str:
        items = "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(n))
        return r.choice([f"<ul>{items}</ul>", items.replace("<li>", "<div>").replace("</li>", "</div>"), re.sub("</?li>", " ", items)])

    def boilerplate(k: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(k, "div")
        tag = tag if r.random() < 0.5 else "div"
        named = names(BOILERPLATE_NAMES[k], 0.35 if tag in LANDMARKS else 1.0)
        if k == "form":
            inner = f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button>"
        elif k == "comments":
            inner = f"<h3>{words(1, 3)}</h3>" + "".join(f'<div class="comment"><p>{words(5, 40)}</p></div>' for _ in range(r.randint(1, 5)))
        elif k == "nav":
            inner = links(r.randint(3, 8))
            if inner.startswith("<ul>") and r.random() < 0.5:  # the list carries the name itself
                return f"<ul{names(BOILERPLATE_NAMES[k], 1.0)}>{inner[4:]}"
        elif k in ("ad", "notice"):
            inner = r.choice([f"<p>{words(5, 25)}</p>", words(5, 20), f"{words(3, 12)} <a href=/x>{words(1, 3)}</a>", f"<div>{words(4, 20)}</div>"])
        elif k == "footer":
            inner = r.choice([words(4, 20), f"<p>&copy; {words(3, 10)}</p>", f"&copy; {words(2, 6)}" + links(4)])
        elif k == "header":
            inner = r.choice([f"<h1><a href=/>{words(1, 3)}</a></h1>", f"<div>{words(1, 4)}</div>" + links(4), f"<p>{words(2, 8)}</p>"])
        elif k == "share":
            inner = links(r.randint(2, 4)) + f"<span>{words(1, 4)}</span>"
        else:
            inner = f"<h3>{words(1, 3)}</h3>" + r.choice([links(r.randint(3, 7)), f"<p>{words(5, 30)}</p>" + links(3), f"<p>{words(8, 30)}</p>"])
        return f"<{tag}{named}>{inner}</{tag}>"

    def block() -> str:
        x = r.random()
        if x < 0.68:
            return f"<p data-main>{words(*r.choice([(1, 5), (3, 20), (10, 60), (40, 140)]))}" + r.choice(["", "", f" <a href=/y>{words(1, 4)}</a> {words(2, 9)}", f"<br>{words(3, 9)}", f"<b>{words(1, 5)}"]) + r.choice(["</p>", "</p>", ""])
        if x < 0.78:
            level = r.randint(2, 4)
            return f"<h{level} data-main>{words(1, 9)}</h{level}>"
        if x < 0.86:
            return "<ul data-main>" + "".join(f"<li data-main>{words(2, 25)}</li>" for _ in range(r.randint(1, 6))) + "</ul>"
        if x < 0.91:
            return f"<blockquote data-main><p data-main>{words(5, 60)}</p></blockquote>"
        if x < 0.95:
            return f"<pre data-main>{words(5, 40)}</pre>"
        return f"<table data-main><tr data-main><td data-main>{words(1, 6)}</td><td data-main>{words(1, 6)}</td></tr></table>"

    def headed(tag: str) -> str:
        """The title, in articles sometimes inside a header of its own."""
        title = f"<h1 data-main>{words(2, 12)}</h1>"
        if tag == "article" and r.random() < 0.35:
            named = r.choice(["", f' class="{r.choice(CONTENT_NAMES)}-{r.choice(["header", "title", "head"])}"'])
            more = r.choice(["", f"<p data-main>{words(4, 30)}</p>", boilerplate("share")])
            return f"<header{named} data-main>{title}{more}</header>"
        return title

    def plain(blocks: list[str]) -> str:
        """Content without a named container: in unnamed elements, or in none."""
        body = "".join(blocks)
        if r.random() < 0.4:
            body = r.choice(["<br>", "<br><br>", "<hr>"]).join(words(5, 90) for _ in range(r.randint(1, 6)))
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            tag = r.choice(["div", "div", "div", "center", "section", "table"])
            body = f"<table data-main><tr data-main><td data-main>{body}</td></tr></table>" if tag == "table" else f"<{tag} data-main>{body}</{tag}>"
        return body

    pages = []
    for _ in range(count):
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        blocks = [block() for _ in range(r.choice([1, 2, 3, 5, 9, 14, 30, 60]))]
        if r.random() < 0.1:  # hardly any content
            blocks = [f"<p data-main>{words(1, 3)}</p>"]
        if r.random() < 0.25:
            body = plain([*([f"<h1 data-main>{words(2, 12)}</h1>"] if r.random() < 0.6 else []), *blocks])
        else:
            if r.random() < 0.3:
                blocks.insert(r.randint(0, len(blocks)), boilerplate(r.choice(["ad", "aside", "share", "notice"])))
            if tag == "article" and r.random() < 0.25:
                blocks.append(boilerplate(r.choice(["footer", "form", "share", "nav", "comments"])))
            body = headed(tag) + "".join(blocks)
            body = f"<{tag}{names(CONTENT_NAMES, 0.4 if tag in LANDMARKS else 1.0)} data-main>{body}</{tag}>"
            for _ in range(r.randint(0, 2)):
                body = f"<{r.choice(['div', 'main', 'section'])}{names(CONTENT_NAMES + OUTER_NAMES, 0.7)} data-main>{body}</div>"
        before = [boilerplate(k) for k in ("header", "nav", "notice", "ad", "form") if r.random() < 0.5]
        after = [boilerplate(k) for k in ("comments", "aside", "share", "ad", "form", "footer") if r.random() < 0.5]
        if r.random() < 0.15:
            before, after = [], []
        r.shuffle(before)
        pages.append(f"<html><head><title>{words(2, 6)}</title></head><body data-main>{''.join(before)}{body}{''.join(after)}</body></html>")
    return pages


def _labels(page: str) -> tuple[list[Node], list[int]]:
    """Nodes and labels of a page marked with data-main."""
    marked = re.sub(r"<(\w+)([^>]*) data-main", r'<\1 id="datamain"\2', page)
    nodes, _ = parse(marked)
    labels = [int("datamain" in n.names or n.tag == "html") for n in nodes]
    plain, _ = parse(page.replace(" data-main", ""))
    return plain, labels


@cache
def default_model() -> Model:
    model = Model()
    model.learn([_labels(p) for p in labelled_pages()])
    return model


def extracted(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    Null and empty pages give an empty text. Pages without any block that looks
    like content give an empty text too. Repeated rows give repeated rows, null
    ids and urls stay, extra columns are ignored and an empty table gives an
    empty result.
    """
    model = model or default_model()
    weights = (dict(model.own), model.pair)

    def run(batches):
        model = Model()
        model.own.update(weights[0])
        model.pair = weights[1]
        for batch in batches:
            texts = [text_of(page, model) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64()),
            })

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
