"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

A page is parsed into a tree of elements.  Containers, and any elements with attribute tokens, are
judged (a paragraph or list item goes with its container) by gradient-boosted trees over their features: text and link density of the subtree, its
punctuation, attribute tokens of the node and its ancestors, tags, depth, and how it compares
with its siblings.  Decoding then picks the best set of nodes in which a node is kept only
with all its ancestors: bottom up, a subtree is worth its own evidence, by the text it owns, plus
what its kept children are worth, and goes whole if that is negative.  So no node can
contradict its ancestors.

There are no labelled pages, so the trees are fitted on a bounded sample (``TRAIN_PAGES``, those with the
smallest url hashes) in two forms: as they are, labelled by their semantic elements, and with their
paragraphs dealt anew to ``LAYOUTS`` made-up layouts with menus, sidebars, notices, adverts, forms and
comments, of which every node's label is known.

Null, empty or text-free pages give an empty text.  Repeated rows and equal ids are judged one by
one.  Scripts, styles, the head, form controls and elements marked as hidden are never text; all else is
judged.  Pages of any length are processed whole; broken markup is read as far as it goes.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewise.llm import boosting
from phasewise.llm.common import column, portions, quoted, tidy

TRAIN_PAGES, LAYOUTS = 200, 500
#: Characters of a page used to fit (the text of a page is always extracted from the whole page).
TRAIN_CHARS = 20_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose contents are never text.
DROPPED = frozenset("script style head title textarea select option".split())
RAW = frozenset("script style textarea title".split())
#: Contents for readers without something else; judged like containers.
INSTEAD = frozenset("noscript template iframe object canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Blocks that stand or fall with what they are part of, unless they have attribute tokens.
PARTS = frozenset("p li dt dd tr tbody thead tfoot h1 h2 h3 h4 h5 h6 blockquote pre caption figcaption legend summary center address hr".split())
CLOSES_P = BLOCKS - frozenset("body caption html tbody td tfoot th thead tr li dd dt legend summary figcaption".split())
#: An opening tag ends an open one of these, up to the nearest of the second set.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tbody": (frozenset({"thead", "tbody", "tr", "td", "th"}), frozenset({"table"})),
}
#: A quote opens only after "="; other values go up to white space or the end of the tag.
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*'|(?!"[^"]*"|'[^']*')[^\s>]*+))*+)>|<[!?/][^>]*>|<[a-zA-Z][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?]")
#: Tags with a number of their own among the features.
TAGS = ("p h1 h2 h3 li ul ol div section article main header footer nav aside form table td a span blockquote pre figure "
        "button label dialog body").split()
TAG_NUMBER = {t: k + 1 for k, t in enumerate(TAGS)}
OUTSIDE = frozenset("nav footer aside form header menu dialog button".split())
INSIDE = frozenset("article main".split())


class Element:
    __slots__ = ("tag", "parent", "children", "tokens", "own", "links", "points", "tags", "paragraphs", "scored", "label", "depth", "hidden", "in_p",
                 "above", "text")

    def __init__(self, tag: str, parent: Element | None, tokens: tuple[str, ...] = (), label: int = -1, hidden: bool = False):
        self.tag, self.parent, self.tokens, self.label, self.hidden = tag, parent, tokens, label, hidden
        self.children: list[Element | str] = []
        self.depth = parent.depth + 1 if parent else 0
        self.scored = tag in BLOCKS and tag not in PARTS or tag in INSTEAD or bool(tokens)
        self.in_p = tag == "p" or parent is not None and parent.in_p
        # the nearest scored ancestor
        self.above = None if parent is None else parent if parent.scored else parent.above


def attributes(text: str) -> tuple[tuple[str, ...], int, bool]:
    """Tokens of class, id, role and the like; the label of a made-up page; whether it is hidden."""
    if not text.strip(" /\n"):
        return (), -1, False
    tokens: list[str] = []
    label, hidden = -1, False
    for name, a, b, c in ATTRIBUTE.findall(text):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            tokens += [t.lower() for t in TOKEN.findall(value)]
        elif name == "data-made-label":
            label = int(value)
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return tuple(dict.fromkeys(tokens)), label, hidden


def parse(page: str) -> Element:
    root = Element("html", None)
    at, here, n = 0, root, len(page)
    is_open: dict[str, int] = {}  # open elements below the root by tag

    def leave(upto: Element) -> Element:
        """``upto``, an open element, with all below it closed."""
        walk = here
        while walk is not upto:
            is_open[walk.tag] -= 1
            walk = walk.parent
        return upto

    def close(node: Element, wanted: frozenset[str], until: frozenset[str]) -> Element:
        """The parent of the outermost open element of ``wanted`` below the nearest of ``until``."""
        walk, found = node, None
        while walk is not root and walk.tag not in until:
            if walk.tag in wanted:
                found = walk
            walk = walk.parent
        return found.parent if found else node

    while at < n:
        m = MARKUP.search(page, at)
        if not m:
            here.children.append(page[at:])
            break
        if m.start() > at:
            here.children.append(page[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if is_open.get(tag):
                walk = here
                while walk.tag != tag:
                    walk = walk.parent
                here = leave(walk.parent)
            continue
        if tag in ("html", "body"):
            if tag == "body" and here is root:
                pass
            else:
                continue
        if tag in RAW:
            end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            here.children.append("\n")
            continue
        if tag in CLOSES_P and here.in_p:
            here = leave(close(here, frozenset({"p"}), frozenset({"td", "th", "button", "table"})))
        if tag in IMPLIED:
            here = leave(close(here, *IMPLIED[tag]))
        if here.tag == "head" and tag not in ("meta", "link", "base", "noscript", "template"):
            here = leave(here.parent)
        tokens, label, hidden = attributes(m[3])
        node = Element(tag, here, tokens, label, hidden)
        here.children.append(node)
        if tag not in VOID and not m[3].endswith("/"):
            here = node
            is_open[tag] = is_open.get(tag, 0) + 1
    return root


def measured(root: Element) -> list[Element]:
    """Scored elements in page order, with the sums of their subtrees filled in."""
    found: list[Element] = []

    def visit(top: Element) -> None:
        todo: list[tuple[Element, bool]] = [(top, False)]
        while todo:
            node, done = todo.pop()
            if not done:
                node.own = node.links = node.points = node.paragraphs = node.text = 0
                node.tags = 1
                if node.tag in DROPPED or node.hidden:
                    node.children = []
                if node.scored:
                    found.append(node)
                todo.append((node, True))
                todo += [(c, False) for c in reversed(node.children) if not isinstance(c, str)]
                continue
            chars = 0
            for c in node.children:
                if isinstance(c, str):
                    text = c.strip()
                    chars += len(text)
                    node.text += len(text)
                    node.points += len(PUNCTUATION.findall(text)) if text else 0
                else:
                    node.links += c.links
                    node.text += c.text
                    node.points += c.points
                    node.tags += c.tags
                    node.paragraphs += c.paragraphs + (c.tag == "p")
                    if not c.scored:
                        chars += c.own
            node.own = chars  # text of this element and of inline elements in it that are not scored
            if node.tag == "a":
                node.links = node.text  # all of it, links in the link as well
    visit(root)
    return found


def features(nodes: list[Element], odds: dict[str, float]) -> np.ndarray:
    """One row per scored element; parents come before their children."""
    chars: dict[int, int] = {}
    for node in reversed(nodes):  # children first
        chars[id(node)] = chars.get(id(node), 0) + node.own
        up = node.above
        if up is not None:
            chars[id(up)] = chars.get(id(up), 0) + chars[id(node)]
    above: dict[int, tuple] = {}
    page = max(1, chars.get(id(nodes[0]), 1)) if nodes else 1
    family: dict[int, list[Element]] = {}
    for node in nodes:
        family.setdefault(id(node.parent), []).append(node)
    stats: dict[int, tuple] = {}
    for key, own in family.items():
        sizes = [chars[id(c)] for c in own]
        tags: dict[str, int] = {}
        for c in own:
            tags[c.tag] = tags.get(c.tag, 0) + 1
        stats[key] = (len(own), sum(sizes) / len(own), max(sizes), tags)
    index: dict[int, int] = {}
    rows = []
    for k, node in enumerate(nodes):
        up = node.above
        low0, high0, out0, in0, tag0 = above[id(up)] if up is not None else (0.0, 0.0, 0, 0, 0)
        values = [odds[t] for t in node.tokens if t in odds]
        low, high = min(values, default=0.0), max(values, default=0.0)
        tag = TAG_NUMBER.get(node.tag, 0)
        outside, inside = node.tag in OUTSIDE, node.tag in INSIDE
        above[id(node)] = (min(low, low0), max(high, high0), out0 + outside, in0 + inside, tag)
        size = chars[id(node)]
        count, mean, most, tags = stats[id(node.parent)]
        place = index.get(id(node.parent), 0)
        index[id(node.parent)] = place + 1
        rows.append((
            tag, tag0, node.depth, low, high, low0, high0, sum(values), outside, inside, out0, in0,
            math.log1p(size), math.log1p(node.own), node.links / max(1, size), size / node.tags, math.log1p(node.tags),
            node.points / max(1, size), math.log1p(node.paragraphs), size / page, k / len(nodes),
            count, tags[node.tag] / count, place / count, size / max(1.0, mean), size / max(1, most),
            tag in (2, 3, 4), node.tag == "p", node.tag == "li", len(node.tokens),
        ))
    return np.array(rows, float).reshape(len(rows), -1)


def decoded(nodes: list[Element], logits: np.ndarray) -> set[int]:
    """Ids of the kept elements: the best set in which all ancestors of a kept one are kept."""
    worth: dict[int, float] = {}
    ups = [node.above for node in nodes]
    for node, up, logit in zip(reversed(nodes), reversed(ups), reversed(logits.tolist())):
        own = worth.get(id(node), 0.0) + logit * (1 + node.own)
        worth[id(node)] = own
        if up is not None and own > 0:
            worth[id(up)] = worth.get(id(up), 0.0) + own
    kept: set[int] = set()
    for node, up in zip(nodes, ups):
        if up is None or id(up) in kept and worth[id(node)] > 0:
            kept.add(id(node))
    return kept


def text_of(root: Element, kept: set[int]) -> str:
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            blocks.append(text)
        run.clear()

    todo: list[tuple[Element | str, bool]] = [(root, False)]
    while todo:
        node, done = todo.pop()
        if isinstance(node, str):
            run.append(node)
            continue
        if done:
            flush()
            continue
        if node.scored and id(node) not in kept:
            if node.tag in BLOCKS:
                flush()
            continue
        if node.tag in BLOCKS:
            flush()
            todo.append((node, True))
        todo += [(c, False) for c in reversed(node.children)]
    flush()
    return "\n\n".join(blocks)


@dataclass
class Model:
    odds: dict[str, float]
    trees: boosting.Trees

    def texts(self, pages: list[str]) -> list[str]:
        roots = [parse(p) for p in pages]
        nodes = [measured(r) for r in roots]
        rows = [features(own, self.odds) for own in nodes]
        logits = self.trees.logits(np.concatenate(rows)) if rows else np.zeros(0)
        found, at = [], 0
        for root, own in zip(roots, nodes):
            found.append(text_of(root, decoded(own, logits[at:at + len(own)])))
            at += len(own)
        return found


# ---- made-up layouts: fixed words that class names are put together from

GOOD_NAMES = "article post content entry story body main text page blog news detail hgroup copy prose single container wrapper".split()
BAD_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav links pagination pager tabs toc skip".split(),
    "header": "header masthead topbar banner branding logo site head".split(),
    "footer": "footer bottom copyright legal colophon foot".split(),
    "side": "sidebar aside widget related recommended trending popular archive tags side rail more also".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner dfp outbrain adsense".split(),
    "notice": "cookie consent notice gdpr popup modal alert banner newsletter overlay disclaimer paywall".split(),
    "form": "form search login signup subscribe newsletter contact register".split(),
    "share": "share social sharing buttons follow toolbar meta byline tools".split(),
    "comments": "comments comment replies reply discussion disqus respond thread".split(),
}
MENU = "Home About News Contact Sports Archive Help Login Register Shop Blog Terms Privacy World Culture Search Next Previous".split()


def named(own: random.Random, names: list[str]) -> str:
    style = own.random()
    picked = own.sample(names, min(len(names), own.choice((1, 1, 2))))
    value = own.choice("-_").join([*picked, *own.choice(([], [], ["box"], ["area"], ["block"], ["section"], ["list"]))])
    return f' {"id" if style < 0.25 else "class"}="{value}"'


def layout(own: random.Random, texts: list[str]) -> str:
    """A made-up page: every element that matters has its label in an attribute."""
    def some(a: int, b: int, most: int = 400) -> list[str]:
        return [t[:own.randint(20, most)] if own.random() < 0.5 else t for t in own.choices(texts, k=own.randint(a, b))]

    def tag(name: str, label: int, inner: str, extra: str = "") -> str:
        return f"<{name}{extra} data-made-label={label}>{inner}</{name}>"

    def menu(kind: str) -> str:
        words = own.choices(MENU, k=own.randint(3, 9)) if own.random() < 0.6 else [w for t in some(1, 2) for w in t.split()[:6]]
        items = "".join(tag("li", 0, f'<a href="/{w}">{w}</a>') for w in words)
        return tag(own.choice(("nav", "div", "ul", "nav")), 0, items if own.random() < 0.3 else tag("ul", 0, items),
                   named(own, BAD_NAMES[kind]) if own.random() < 0.7 else "")

    def paragraphs(label: int, a: int, b: int, most: int = 400) -> str:
        return "".join(tag("p", label, t) if own.random() < 0.9 else tag("div", label, t) for t in some(a, b, most))

    def bad(kind: str) -> str:
        if kind in ("nav", "share"):
            return menu(kind)
        name = {"header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind, "div")
        name = name if own.random() < 0.6 else own.choice(("div", "section"))
        extra = named(own, BAD_NAMES[kind]) if own.random() < 0.9 or name in ("div", "section") else ""
        if kind == "header":
            inner = tag(own.choice(("h1", "h2", "div", "p")), 0, own.choice(texts)[:40]) + (menu("nav") if own.random() < 0.5 else "")
        elif kind == "form":
            inner = tag("label", 0, own.choice(MENU)) + "<input>" + tag("p", 0, own.choice(texts)[:80]) + tag("button", 0, "OK")
        elif kind == "comments":
            inner = tag("h3", 0, "Comments") + "".join(
                tag(own.choice(("div", "li", "article")), 0, paragraphs(0, 1, 3), named(own, BAD_NAMES["comments"])) for _ in range(own.randint(1, 5)))
        elif kind == "footer":
            inner = f"&copy; {own.choice(texts)[:own.choice((60, 160))]}" if own.random() < 0.5 else paragraphs(0, 1, 2, 120) + menu("nav")
        elif kind == "side":
            inner = tag("h3", 0, own.choice(texts)[:30]) + (menu("side") if own.random() < 0.5 else paragraphs(0, 1, 4, 200))
        else:
            inner = own.choice(texts)[:200] if own.random() < 0.5 else paragraphs(0, 1, 3, 250)
        return tag(name, 0, inner, extra)

    def table() -> str:
        cells = own.randint(2, 4)
        rows = ["".join(tag(own.choice(("td", "td", "th")), 1, own.choice(texts)[:own.choice((5, 25))]) for _ in range(cells)) for _ in range(own.randint(2, 5))]
        return tag("table", 1, "".join(tag("tr", 1, r) for r in rows))

    title = own.choice(texts)[:80]
    # an article can be shorter than what stands around it
    short = own.random() < 0.12
    parts = [tag("p", 1, own.choice(texts)[:own.choice((15, 40))]) if short else paragraphs(1, 1, 1)]
    for _ in range(0 if short else own.randint(1, 10)):
        parts.append(own.choices(
            (paragraphs(1, 1, 4), tag(own.choice(("h2", "h3")), 1, own.choice(texts)[:50]),
             tag(own.choice(("ul", "ol")), 1, "".join(tag("li", 1, t[:own.choice((20, 150))]) for t in some(2, 8))),
             table(), tag("blockquote", 1, paragraphs(1, 1, 2)), bad(own.choice(("ad", "share", "notice", "side", "form")))), (8, 2, 2, 1, 1, 1.5))[0])
    if own.random() < 0.3:
        parts.append(bad("comments"))
    head = tag("h1", 1, title)
    head = tag("header", 1, head) if own.random() < 0.15 else head
    good = tag(own.choice(("article", "div", "main", "section", "article")), 1, head + "".join(parts),
               named(own, GOOD_NAMES) if own.random() < 0.7 else "")
    if own.random() < 0.1:
        good = head + "".join(parts)
    elif own.random() < 0.5:
        good = tag(own.choice(("div", "main", "section")), 1, good + (bad("side") if own.random() < 0.3 else ""),
                   named(own, GOOD_NAMES) if own.random() < 0.5 else "")
    before = [bad(k) for k in ("header", "nav", "notice", "ad", "form", "side") if own.random() < 0.45]
    after = [bad(k) for k in ("comments", "side", "share", "ad", "notice", "footer", "form") if own.random() < 0.4]
    own.shuffle(before)
    return f"<html><body>{''.join(before)}{good}{''.join(after)}</body></html>"


def semantic_labels(nodes: list[Element]) -> list[int]:
    """Labels of a page's own elements by the meaning of its tags; -1 where they do not tell."""
    if not any(n.tag in INSIDE for n in nodes):
        return [-1] * len(nodes)
    labels: dict[int, int] = {}
    wraps: set[int] = set()
    for n in nodes:
        if n.tag in INSIDE:
            up = n.parent
            while up is not None:
                wraps.add(id(up))
                up = up.parent
    found = []
    for n in nodes:
        up = n.parent
        while up is not None and id(up) not in labels:
            up = up.parent
        above = labels[id(up)] if up is not None else -1
        if id(n) in wraps:
            own = 2  # goes on to its children undecided
        elif n.tag in INSIDE:
            own = 1
        elif n.tag in OUTSIDE and above != 0:
            own = 0
        else:
            own = {2: 0}.get(above, above)
        labels[id(n)] = own
        found.append(1 if own == 2 else own)
    return found


def fit(pages: list[str], layouts: int = LAYOUTS, seed: int = 5) -> Model:
    own = random.Random(seed)
    texts = [t for p in pages for t in (html.unescape(re.sub(r"<[^>]*>", " ", x)) for x in re.findall(r"<p>([^<]{20,})", p[:TRAIN_CHARS]))]
    texts = [html.escape(" ".join(t.split())) for t in texts] or [html.escape(w * 9) for w in ("lorem ipsum dolor. ", "sit amet, elit. ")]
    made = [parse(layout(own, texts)) for _ in range(layouts)]
    examples = []
    for root in made:
        nodes = measured(root)
        labels = []
        seen: dict[int, int] = {}
        for n in nodes:
            up = n.parent
            while up is not None and id(up) not in seen:
                up = up.parent
            seen[id(n)] = n.label if n.label >= 0 else (seen[id(up)] if up is not None else 1)
            labels.append(seen[id(n)])
        examples.append((nodes, labels))
    for p in pages:
        nodes = measured(parse(p[:TRAIN_CHARS]))
        examples.append((nodes, semantic_labels(nodes)))
    counts: dict[str, list[float]] = {}
    for nodes, labels in examples:
        for n, y in zip(nodes, labels):
            if y >= 0:
                for t in n.tokens:
                    counts.setdefault(t, [0.5, 0.5])[y] += 1
    odds = {t: math.log(c[1] / c[0]) for t, c in counts.items()}
    x, y = [], []
    for nodes, labels in examples:
        use = [k for k, v in enumerate(labels) if v >= 0]
        if use:
            x.append(features(nodes, odds)[use])
            y += [labels[k] for k in use]
    target = np.array(y, float)
    return Model(odds, boosting.fit(np.concatenate(x), target, np.where(target > 0, 0.5 / target.mean(), 0.5 / (1 - target.mean()))))


def extract(pages: DataFrame, model: Model, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Per row: id, url, text and n_chars."""
    kinds = dict(pages.dtypes)
    schema = f"{quoted(id_column)} {kinds[id_column]}, {quoted(url_column)} {kinds[url_column]}, text string, n_chars long"
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for part in portions(batch.column(2)) for t in shared.value.texts(part)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[id_column, url_column, "text", "n_chars"])

    return pages.select(column(id_column), column(url_column), column(html_column).cast("string")).mapInArrow(tidy(run), schema)


def sample(pages: DataFrame, url_column: str = "url", html_column: str = "html", count: int = TRAIN_PAGES) -> list[str]:
    """At most ``count`` pages of different urls, each cut to TRAIN_CHARS, to fit on.

    The smallest hashes of urls are picked first; only pages with these are then read (the
    smallest text, where a url has several).
    """
    key = F.xxhash64(column(url_column))
    some = pages.where(column(html_column).isNotNull())
    keys = [r["k"] for r in some.select(key.alias("k")).distinct().orderBy("k").limit(count).collect()]
    rows = (some.where(key.isin(keys)).groupBy(key.alias("k"))
            .agg(F.min(F.substring(column(html_column).cast("string"), 1, TRAIN_CHARS)).alias("h")).collect())
    return [r["h"] for r in sorted(rows, key=lambda r: r["k"])]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(sample(pages)))
