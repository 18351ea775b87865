"""Main text of HTML pages by a tree-structured graphical model.

Every block element and every block of text is a node with a binary state,
content or not; each node is tied to its parent in the DOM.  Sum-product
messages, upward and then downward, give every node's marginal; blocks of text
with a marginal of at least one half are the page's text.  Potentials are
log-linear and trained on labelled pages by exact maximum likelihood.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navspark.llm.words import slices

# Every quantifier is possessive and every "<" with a letter behind it is a token, up to the page's end if need be: reading is linear, whatever is left open.
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>"'][^\s>]*+))?)?""")
_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?)?)*+"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?=[^a-zA-Z]))[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)", re.S)
_XMP_END = re.compile(r"</xmp(?=[\s/>])[^>]*+(?:>|\Z)", re.I)
_SPACE = re.compile(r"\s+")

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes".split())  # the first end tag ends them, whatever stands before it
NESTED = frozenset("template svg object select datalist canvas audio video annotation annotation-xml".split())  # hold elements, also of their own name
OPAQUE = RAW | NESTED
FOREIGN = frozenset("svg math annotation annotation-xml".split())  # only these can close themselves by a slash
MATH = frozenset("math semantics mrow mi mo mn ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced maction msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mlabeledtr mtd".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul xmp".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"})}

TAGS = ["article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol menu dl", "li dt dd", "nav", "header hgroup", "footer", "aside", "form fieldset button legend dialog option optgroup", "table tbody thead tfoot tr td th caption", "blockquote pre xmp figure figcaption address details summary"]
_TAG_GROUP = {tag: i for i, group in enumerate(TAGS) for tag in group.split()}
#: Words of class, id and role that tell a block's part in the page.
NAMES = [
    r"ad|ads|advert\w*|sponsor\w*|promo\w*|banner\w*|dfp|adsense|commercial",
    r"nav\w*|menu\w*|breadcrumb\w*|pagination|pager|toc|skip|tabs?",
    r"header|masthead|topbar|branding|logo",
    r"footer|foot|copyright|colophon|legal|contentinfo",
    r"side\w*|aside|widgets?|rail|related|recommend\w*|popular|trending|complementary|more",
    r"cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|paywall|dialog",
    r"comments?|replies|reply|respond|discussion|disqus|commentlist",
    r"share|sharing|social|follow|tags?|tagcloud|meta|byline",
    r"content|article|post|entry|story|main|text|prose|page|blog",
    r"search|form|login|input|contact",
]
_NAMES = [re.compile(rf"(?:^|[\s_-])(?:{n})(?=$|[\s_-])") for n in NAMES]
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

N_TAGS, N_NAMES, N_LEAF = len(TAGS) + 1, len(NAMES), 5
#: The last feature marks the blocks of text of a page that has one or two, those in menus and the like not counted.
N_FEATURES = N_TAGS + N_NAMES + 1 + N_LEAF + 1
#: Parent-child potentials differ by the child: a text, a block, a block that is named or tagged as no content.
KINDS = 3
_APART = {_TAG_GROUP[t] for t in ("nav", "header", "footer", "aside", "form")}


#: Elements deeper than this hang on the last element above it, as in browsers.
DEPTH = 512
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)


def _names_of(attributes: str) -> tuple[str, bool]:
    """(class, id and role, hidden) of an element."""
    if not _TELLING.search(attributes):
        return "", False
    names, hidden = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            names.append(_CAMEL.sub("-", value).lower())
        hidden |= key == "hidden" or (key == "style" and "display:none" in value.replace(" ", "").lower())
    return " ".join(names), hidden


def _unseen(attributes: str) -> bool:
    """Whether an element within a line is hidden or an advert."""
    names, hidden = _names_of(attributes)
    return hidden or bool(names and _NAMES[0].search(names))


@lru_cache(maxsize=10_000)
def _describe(tag: str, text: str) -> tuple[tuple[int, ...], int]:
    """(active features, kind) of a block element, by its tag and names."""
    group = _TAG_GROUP.get(tag, len(TAGS))
    found = [i for i, n in enumerate(_NAMES) if n.search(text)] if text else []
    kind = 2 if group in _APART or any(i not in (8,) for i in found) else 1
    return (group, *(N_TAGS + i for i in found), N_TAGS + N_NAMES), kind


#: For the elements that end others: those that they end, and those whose borders stop them.
_SCOPES = [({"p"}, {"table", "td", "th", "button"}), *((set(names), set(stop)) for names, stop in dict.fromkeys((tuple(sorted(n)), tuple(sorted(s))) for n, s in CLOSES.values()))]
_SCOPE_OF = {tag: next(i for i, s in enumerate(_SCOPES) if s == scope) for tag, scope in CLOSES.items()}
_OPENS = {tag: [i for i, (names, _) in enumerate(_SCOPES) if tag in names] for names, _ in _SCOPES for tag in names}
_STOPS = {tag: [i for i, (names, stop) in enumerate(_SCOPES) if tag in stop and tag not in names] for _, stop in _SCOPES for tag in stop}


class _Stack:
    """The open elements; the nearest of a name, or of a scope's names, is found in constant time."""

    def __init__(self, root: int) -> None:
        self.tags, self.nodes = ["#root"], [root]
        self.scopes: list[tuple[int, ...]] = [(0,) * len(_SCOPES)]  # of each scope, the place of the nearest element that it ends, or 0
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, node: int) -> None:
        at, scope = len(self.tags), self.scopes[-1]
        if tag in _OPENS or tag in _STOPS:
            new = list(scope)
            for i in _STOPS.get(tag, ()):
                new[i] = 0
            for i in _OPENS.get(tag, ()):
                new[i] = at
            scope = tuple(new)
        self.tags.append(tag)
        self.nodes.append(node)
        self.scopes.append(scope)
        self.places.setdefault(tag, []).append(at)

    def cut(self, at: int) -> None:
        """Close the element at this place and all within."""
        for tag in self.tags[at:]:
            self.places[tag].pop()
        del self.tags[at:], self.nodes[at:], self.scopes[at:]

    def nearest(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0


def _is_cdata(html: str, at: int) -> bool:
    """Whether a section of plain characters begins here; only foreign elements hold such, elsewhere it is a comment up to the next ">"."""
    return html.startswith("<![CDATA[", at)


class _Ends:
    """Where the opaque elements of one page end; the page is scanned at most once for each kind of element."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.endless: set[str] = set()
        self.nested: dict[int, int] | None = None

    def raw(self, tag: str, at: int) -> int | None:
        """End of a raw element whose start tag ends at ``at``; without an end tag, the page's end for script and style, else None."""
        end = None if tag in self.endless else re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(self.html, at)
        if end:
            return end.end()
        self.endless.add(tag)
        return len(self.html) if tag in ("script", "style") else None

    def xmp(self, at: int) -> re.Match | None:
        """End tag of an xmp element."""
        end = None if "xmp" in self.endless else _XMP_END.search(self.html, at)
        if end is None:
            self.endless.add("xmp")
        return end

    def of(self, tag: str, at: int) -> int | None:
        """End of an opaque element whose start tag ends at ``at``; None if it has no end tag of its own."""
        if tag in RAW:
            return self.raw(tag, at)
        if self.nested is None:
            self.nested, opened, here = {}, {t: [] for t in NESTED}, at
            opened[tag].append(at)
            while m := _TOKEN.search(self.html, here):
                here = m.end()
                name = (m[2] or "").lower()
                if opened["svg"] and _is_cdata(self.html, m.start()):
                    end = self.html.find("]]>", m.start())
                    here = end + 3 if end >= 0 else len(self.html)
                elif m[1]:
                    if opened.get(name):
                        self.nested[opened[name].pop()] = here
                elif m[2] and not (name in FOREIGN and m[3].endswith("/")):
                    if name in RAW:
                        here = self.raw(name, here) or here
                    elif name in NESTED:
                        opened[name].append(here)
        return self.nested.get(at)


class Pages:
    """The trees of many pages, one after another; node 0 of each is its root."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.kind: list[int] = []
        self.active: list[tuple[int, ...]] = []
        self.leaves: list[int] = []
        self.texts: list[str] = []
        self.links: list[int] = []
        self.first: list[int] = []  # of each page, its first leaf
        self.apart: list[bool] = []  # whether a node is, or stands in, a block that is named or tagged as no content

    def _node(self, parent: int, kind: int, active: tuple[int, ...]) -> int:
        if parent >= 0 and self.depth[parent] >= DEPTH:
            parent = self.parent[parent]
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.kind.append(kind)
        self.active.append(active)
        self.apart.append(kind == 2 or parent >= 0 and self.apart[parent])
        return len(self.parent) - 1

    def add(self, html: str | None) -> None:
        """Parse one page; a broken page gives what a reader could still see of it."""
        self.first.append(len(self.leaves))
        stack = _Stack(self._node(-1, 1, (len(TAGS),)))
        run: list[str] = []
        linked = in_link = in_math = 0
        unseen: tuple[str, int] | None = None  # the hidden element within a line, and the elements open around it
        again = 0  # open elements of its name within it
        at, html = 0, html or ""
        ends = _Ends(html)

        def close_run() -> None:
            nonlocal linked
            if run:
                text = _SPACE.sub(" ", unescape("".join(run))).strip()
                if text:
                    self.leaves.append(self._node(stack.nodes[-1], 0, ()))
                    self.texts.append(text)
                    self.links.append(min(linked, len(text)))
                run.clear()
            linked = 0

        def close(place: int) -> bool:
            nonlocal unseen
            if place:
                close_run()
                stack.cut(place)
                if unseen and len(stack.tags) < unseen[1]:
                    unseen = None
            return place > 0

        while True:
            m = _TOKEN.search(html, at)
            text = html[at : m.start() if m else len(html)]
            if text and not unseen:
                run.append(text)
                if in_link:
                    linked += len(text)
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "a":
                    in_link = 0
                elif tag == "math":
                    in_math = 0
                if unseen and tag == unseen[0]:
                    again -= 1
                    unseen = unseen if again else None
                if tag not in INLINE:
                    if tag in ("select", "datalist", "optgroup"):
                        close(stack.nearest("option"))
                    close(stack.nearest("optgroup" if tag in ("select", "datalist") else tag))
                continue
            closed = tag in FOREIGN and m[3].endswith("/")
            if tag in OPAQUE and (in_math or not tag.startswith("annotation")):
                if not closed:
                    at = ends.of(tag, at) or at
                if tag != "svg" and not in_math:
                    close_run()
                continue
            if tag in INLINE:
                in_link = int(tag == "a") or in_link
                in_math = int(tag == "math" and not closed) or in_math
                if unseen:
                    again += tag == unseen[0]
                elif tag not in MATH and m[3] and _unseen(m[3]):
                    unseen, again = (tag, len(stack.tags)), 1
                continue
            if tag in VOID:
                if tag == "hr":
                    close_run()
                else:
                    run.append(" ")
                continue
            close_run()
            while stack.tags[-1] == "option" or (stack.tags[-1] == "optgroup" and tag != "option"):
                close(len(stack.tags) - 1)
            if tag in CLOSES_P:
                close(stack.scopes[-1][0])
            if tag in CLOSES:
                while close(stack.scopes[-1][_SCOPE_OF[tag]]):
                    pass
            if tag in ("html", "head", "body"):  # all stand for the root
                continue
            names, hidden = _names_of(m[3])
            active, kind = _describe(tag, names)
            if hidden:
                active, kind = (*active, N_TAGS + 5), 2
            stack.push(tag, self._node(stack.nodes[-1], kind, active))
            end = ends.xmp(at) if tag == "xmp" else None
            if end:  # its marks are text
                run.append(escape(html[at : end.start()], quote=False))
                at = end.start()
        close_run()
        lone = [leaf for leaf in self.leaves[self.first[-1] :] if not self.apart[leaf]]
        if len(lone) <= 2:
            for leaf in lone:
                self.active[leaf] += (N_FEATURES - 1,)

    def arrays(self) -> Trees:
        n = len(self.parent)
        x = np.zeros((n, N_FEATURES))
        rows = np.repeat(np.arange(n), [len(a) for a in self.active])
        x[rows, np.fromiter((f for a in self.active for f in a), np.int64, len(rows))] = 1
        if self.leaves:
            leaf = np.array(self.leaves)
            size = np.array([len(t) for t in self.texts], float)
            at = N_TAGS + N_NAMES + 1
            x[leaf, at] = 1
            x[leaf, at + 1] = np.minimum(np.log1p(size), 6) / 6
            x[leaf, at + 2] = np.array(self.links) / size
            x[leaf, at + 3] = [t[-1] in ".!?:;\"'…" for t in self.texts]
            x[leaf, at + 4] = size < 25
        return Trees(np.array(self.parent, np.int64), np.array(self.depth, np.int64), np.array(self.kind, np.int64), x)


@dataclass
class Trees:
    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    features: np.ndarray

    @cached_property
    def levels(self) -> list[np.ndarray]:
        """The nodes of each depth."""
        order = np.argsort(self.depth, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1)


@dataclass
class Potentials:
    """``unary`` weighs features for the state content; ``pair[kind, parent state, child state]``."""

    unary: np.ndarray
    pair: np.ndarray

    def marginals(self, trees: Trees) -> tuple[np.ndarray, np.ndarray]:
        """(node, state) and (node, parent state, state) marginals by two passes of messages."""
        n, levels = len(trees.parent), trees.levels
        own = np.zeros((n, 2))
        own[:, 1] = trees.features @ self.unary
        pair, parent = self.pair[trees.kind], trees.parent
        up, inside = np.zeros((n, 2)), own.copy()
        for level in reversed(levels[1:]):  # from the leaves to the roots
            up[level] = np.logaddexp.reduce(pair[level] + inside[level][:, None, :], axis=2)
            np.add.at(inside, parent[level], up[level])
        outside = np.zeros((n, 2))  # what the rest of the page says of the parent, for each state of the child
        joint = np.zeros((n, 2, 2))
        for level in levels[1:]:  # and back
            p = parent[level]
            rest = inside[p] + outside[p] - up[level]
            both = rest[:, :, None] + pair[level]
            outside[level] = np.logaddexp.reduce(both, axis=1)
            joint[level] = both + inside[level][:, None, :]
        total = inside + outside
        total -= np.logaddexp.reduce(total, axis=1, keepdims=True)
        joint -= np.logaddexp.reduce(joint.reshape(n, 4), axis=1)[:, None, None]
        joint = np.exp(joint)
        joint[levels[0]] = 0
        return np.exp(total), joint


def fit(trees: Trees, state: np.ndarray, steps: int = 200, decay: float = 5e-5) -> Potentials:
    """Maximum likelihood of labelled trees, all nodes at once, by Adam."""
    child = np.flatnonzero(trees.parent >= 0)
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (trees.kind[child], state[trees.parent[child]], state[child]), 1.0)
    told = trees.features.T @ state
    size = N_FEATURES + KINDS * 4
    w, m, v, n = np.zeros(size), np.zeros(size), np.zeros(size), len(state)
    for t in range(1, steps + 1):
        model = Potentials(w[:N_FEATURES], w[N_FEATURES:].reshape(KINDS, 2, 2))
        node, joint = model.marginals(trees)
        expected = np.zeros((KINDS, 2, 2))
        np.add.at(expected, trees.kind[child], joint[child])
        g = np.concatenate((trees.features.T @ node[:, 1] - told, (expected - seen).ravel())) / n + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Potentials(w[:N_FEATURES], w[N_FEATURES:].reshape(KINDS, 2, 2))


def extract(pages: list[str | None], model: Potentials) -> list[str]:
    """The main text of each page."""
    trees = Pages()
    for html in pages:
        trees.add(html)
    if not trees.leaves:
        return [""] * len(pages)
    content = model.marginals(trees.arrays())[0][trees.leaves, 1] >= 0.5
    ends = [*trees.first[1:], len(trees.leaves)]
    return ["\n".join(t for t, c in zip(trees.texts[a:b], content[a:b]) if c) for a, b in zip(trees.first, ends)]


def main_text(pages: DataFrame, model: Potentials, columns: list[str], html_col: str = "html") -> DataFrame:
    """``columns`` of ``pages`` with text and n_chars (code points).

    A null, empty or textless page has the empty text.  Repeated rows give
    repeated results; an empty table gives no rows.  Pages of any length are
    read whole, in linear time.  Columns that are not asked for are ignored,
    whatever their names; asked ones may have any name but text and n_chars.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = extract(part.column("html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    source = pages.select(F.struct(*columns).alias("row"), F.col(html_col).alias("html"))
    schema = source.select("row", F.lit("").alias("text")).schema
    found = source.mapInArrow(rows, schema)
    return found.select("row.*", "text", F.length("text").cast("bigint").alias("n_chars"))
