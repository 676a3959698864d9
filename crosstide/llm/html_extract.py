"""Main text of web pages: boosted trees over DOM-node features, decoded along the tree.

A page becomes its tree of block elements; inline elements belong to their
block. Every block gets features of its tag, attribute tokens, depth, siblings,
subtree density, ancestors and announcing lines, and boosted trees give its log odds of being
main content. Decoding keeps the set of blocks of greatest total log odds,
weighted by their own text, in which every kept block has a kept parent: what
stands in a dropped block is dropped, whatever its own score.

The trees are fitted on pages that a generator writes with known labels: its
number of pages is a parameter, its layouts vary tags, attribute tokens, order
and nesting of articles, menus, headers, footers, sidebars, notices, adverts,
forms and reader comments (named by attributes or only announced by a line).
In an article, its own header and lists of links without a name are content.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm import gbt
from crosstide.llm._common import small_batches

TRAINING_PAGES = 1000

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template iframe noembed noframes xmp svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table select menu td th body html".split())

#: Tags by what they say of their content, in the order of the features.
TAG_KINDS = [
    frozenset(["p"]), frozenset("h1 h2 h3 h4 h5 h6 hgroup".split()), frozenset("ul ol dl menu".split()), frozenset("li dt dd".split()),
    frozenset("div section center".split()), frozenset("article main".split()), frozenset(["nav"]), frozenset(["header"]), frozenset(["footer"]),
    frozenset(["aside"]), frozenset("form fieldset button select option label legend input dialog datalist output".split()),
    frozenset("table tbody thead tfoot tr td th caption".split()), frozenset("blockquote pre figure figcaption address details summary".split()),
    frozenset("html body".split()), frozenset("head noscript object audio video canvas".split()),
]
#: Words in class, id and role by what they say of the element, in the order of the features.
TOKEN_KINDS = [
    frozenset("article content post entry story main text body page prose".split()),
    frozenset("nav navigation menu navbar breadcrumb breadcrumbs tabs pagination pager toc skip".split()),
    frozenset("header masthead banner topbar logo branding".split()),
    frozenset("footer copyright legal colophon bottom contentinfo".split()),
    frozenset("sidebar side aside widget related recommended trending popular rail complementary more".split()),
    frozenset("ad ads advert advertisement adsense promo promotion sponsor sponsored banner dfp".split()),
    frozenset("notice cookie cookies consent gdpr newsletter subscribe subscription popup modal overlay alert paywall signup dialog".split()),
    frozenset("comment comments reply replies respond response discussion disqus feedback".split()),
    frozenset("share sharing social tags tag meta byline author rating tools toolbar".split()),
    frozenset("form search login signin contact input button".split()),
    frozenset("hidden invisible sr offscreen screenreader none".split()),
]

#: Words by which short lines announce what readers wrote.
READERS_WORDS = frozenset("comment comments response responses reply replies kommentar kommentare antwort antworten commentaire commentaires réponse réponses comentario comentarios respuesta respuestas".split())
#: Code points at most of a line that announces.
SHORT_LINE = 60

#: A tag or comment in the plain case, where quotes hold no angle brackets; it never passes the next "<".
_PLAIN = re.compile(r"""<(/?)([A-Za-z][^\s/><]*+)((?:[^<>"']|"[^"<>]*+"|'[^'<>]*+')*+)>""")
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_QUOTE_OR_END = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|data-y)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@lru_cache(20_000)
def _attributes(raw: str) -> tuple[int, int]:
    """Kinds of words among the attributes, as bits, and the label of a training page (-1 where there is none)."""
    bits, label = 0, -1
    for name, value in _ATTRIBUTE.findall(raw):
        value = value.strip("\"'")
        name = name.lower()
        if name == "data-y":
            label = int(value)
        elif name == "style":
            if _HIDDEN.search(value):
                bits |= 1 << (len(TOKEN_KINDS) - 1)
        else:
            words = set(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
            for i, kind in enumerate(TOKEN_KINDS):
                if not kind.isdisjoint(words):
                    bits |= 1 << i
    return bits, label


class _Tags:
    """The markup of a source in order, each character passed a bounded number of times."""

    def __init__(self, source: str):
        self.source = source
        self.last = {c: source.rfind(c) for c in "\"'>"}
        self.ends: dict[int, int] = {}  # where a tag ends of which a quote opens here, -1 for nowhere

    def _end(self, at: int) -> int:
        """The ">" that ends a tag whose attributes begin here: outside of quotes, or else the next one; -1 without any."""
        passed, here, end = [], at, -1
        while (m := _QUOTE_OR_END.search(self.source, here)) is not None:
            quote = m.start()
            if m.group() == ">":
                end = quote
                break
            if quote in self.ends:
                end = self.ends[quote]
                break
            passed.append(quote)
            if self.last[m.group()] <= quote:
                break
            here = self.source.find(m.group(), quote + 1) + 1
        for quote in passed:
            self.ends[quote] = end
        return end if end >= 0 else self.source.find(">", at) if self.last[">"] >= at else -1

    def next(self, at: int) -> tuple[int, int, bool, str | None, str]:
        """(start, end, closing, tag or None, attributes) of the next markup from at on; start is the size if there is none."""
        source = self.source
        while (lo := source.find("<", at)) >= 0:
            if m := _PLAIN.match(source, lo):
                return lo, m.end(), m[1] == "/", m[2].lower(), m[3]
            if source.startswith("<!--", lo):
                end = source.find("-->", lo + 4)
                return lo, end + 3 if end >= 0 else len(source), False, None, ""
            if self.last[">"] < lo:
                break
            if m := _NAME.match(source, lo):
                end = self._end(m.end())
                if end >= 0:
                    return lo, end + 1, m[1] == "/", m[2].lower(), source[m.end() : end]
            elif source[lo + 1 : lo + 2] in ("!", "?", "/") and lo + 1 < len(source):
                return lo, source.find(">", lo) + 1, False, None, ""
            at = lo + 1
        return len(source), len(source), False, None, ""


class _Open:
    """The open elements, with the places of each tag, of blocks and of scopes among them."""

    def __init__(self, root: int):
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.scopes: list[int] = []
        self.push("html", root)

    def push(self, tag: str, block: int) -> None:
        at = len(self.stack)
        self.stack.append((tag, block))
        self.places.setdefault(tag, []).append(at)
        if tag not in INLINE:
            self.blocks.append(at)
        if tag in SCOPES:
            self.scopes.append(at)

    def pop(self) -> tuple[str, int]:
        tag, block = self.stack.pop()
        self.places[tag].pop()
        if tag not in INLINE:
            self.blocks.pop()
        if tag in SCOPES:
            self.scopes.pop()
        return tag, block

    def last(self, tag: str) -> int:
        return self.places[tag][-1] if self.places.get(tag) else -1

    def scope(self, among: frozenset | set = frozenset()) -> int:
        """The innermost scope that is none of these tags."""
        if not among:
            return self.scopes[-1]
        return max(self.last(t) for t in SCOPES if t not in among)


class Pages:
    """Blocks of many pages in page order, each with its parent, and the texts in and between them.

    A block stands before what it holds, so the blocks in it are those from the next one up to its end.
    """

    def __init__(self):
        self.parent, self.depth, self.kind, self.tokens, self.label, self.page, self.end = [], [], [], [], [], [], []
        self.above_tokens, self.above_kinds = [], []
        #: Whether a block's own line announces readers' words, one of those in it does, and one before it or its ancestors does.
        self.says, self.holds, self.heard = [], [], []
        self.chars, self.link_chars, self.words, self.marks, self.tags = [], [], [], [], []
        #: Of each page: (block, text) in order; a break between blocks is (block, None).
        self.texts: list[list[tuple[int, str | None]]] = []

    def _block(self, parent: int, tag: str, raw: str) -> int:
        bits, label = _attributes(raw) if raw else (0, -1)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.above_tokens.append(self.above_tokens[parent] | self.tokens[parent] if parent >= 0 else 0)
        self.above_kinds.append(self.above_kinds[parent] | 1 << self.kind[parent] if parent >= 0 else 0)
        self.heard.append(self.heard[parent] or self.holds[parent] if parent >= 0 else False)
        self.says.append(False)
        self.holds.append(False)
        self.kind.append(_tag_kind(tag))
        self.tokens.append(bits)
        self.label.append(label)
        self.page.append(len(self.texts) - 1)
        self.end.append(len(self.parent))
        for column in (self.chars, self.link_chars, self.words, self.marks, self.tags):
            column.append(0)
        return len(self.parent) - 1

    def add(self, source: str) -> None:
        texts: list[tuple[int, str | None]] = []
        self.texts.append(texts)
        root = self._block(-1, "html", "")
        elements, markup = _Open(root), _Tags(source)
        stack, links, at, size = elements.stack, 0, 0, len(source)

        def text(lo: int, hi: int) -> None:
            piece = source[lo:hi]
            if not piece:
                return
            block = stack[-1][1]
            if "&" in piece:
                piece = html.unescape(piece)
            texts.append((block, piece))
            n = len(piece)
            if n and not piece.isspace():
                self.chars[block] += n
                self.link_chars[block] += n * (links > 0)
                self.words[block] += piece.count(" ") + 1
                if n <= SHORT_LINE and not READERS_WORDS.isdisjoint(_LETTERS.findall(piece.lower())):
                    self.says[block] = True
                    self.holds[max(self.parent[block], 0)] = True
                self.marks[block] += piece.count(".") + piece.count(",") + piece.count("!") + piece.count("?")

        def close(down_to: int) -> None:
            nonlocal links
            while len(stack) > down_to:
                tag, block = elements.pop()
                links -= tag == "a"
                if tag not in INLINE:
                    texts.append((block, None))
                    self.end[block] = len(self.parent)

        while at < size:
            lo, hi, closing, tag, raw = markup.next(at)
            text(at, lo)
            at = hi
            if tag is None:
                continue
            if closing:
                place = elements.last(tag)
                if place > 0 and (tag != "p" or place > elements.scope()):
                    close(place)
                continue
            block = stack[-1][1]
            self.tags[block] += 1
            if tag in VOID or raw.endswith("/") and tag in INLINE | RAW:
                if tag in ("br", "hr"):
                    texts.append((block, None))
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^<>]*+>?", re.I).search(source, at)
                at = end.end() if end else size
                continue
            if tag in ("html", "body") and len(stack) == 1:
                bits, label = _attributes(raw) if raw else (0, -1)
                self.tokens[root] |= bits
                self.label[root] = max(self.label[root], label)
                continue
            if tag in CLOSES_P and stack[elements.blocks[-1]][0] == "p":
                close(elements.blocks[-1])
            if tag in SAME_CLOSES:
                alike = SAME_CLOSES[tag]
                while (place := max(map(elements.last, alike))) > elements.scope(alike):
                    close(place)
                    if tag not in ("tr", "tbody"):
                        break
            if tag in INLINE:
                links += tag == "a"
                elements.push(tag, stack[-1][1])
            else:
                texts.append((stack[-1][1], None))
                elements.push(tag, self._block(stack[-1][1], tag, raw))
        close(0)

    def features(self) -> np.ndarray:
        parent = np.array(self.parent)
        n = len(parent)
        up = np.maximum(parent, 0)
        own = np.column_stack([self.chars, self.link_chars, self.words, self.marks, self.tags, np.ones(n)]).astype(float)
        kind, tokens, depth, page, end, above_kinds = (np.array(v) for v in (self.kind, self.tokens, self.depth, self.page, self.end, self.above_kinds))
        paragraph = (kind == 0).astype(float)
        sums = np.vstack([np.zeros(7), np.cumsum(np.column_stack([own, paragraph]), axis=0)])
        below = sums[end] - sums[:-1]
        first = np.concatenate([[0], np.cumsum(np.bincount(page))])[page]
        above_tokens = np.array(self.above_tokens) | np.where(parent >= 0, tokens[first], 0)
        siblings = np.bincount(up, parent >= 0, n)[up]
        same = np.unique(parent * (len(TAG_KINDS) + 1) + kind, return_inverse=True, return_counts=True)
        alike = same[2][same[1]] / np.maximum(siblings, 1)
        place = (np.arange(n) - first) / np.maximum(np.bincount(page)[page], 1)
        whole = np.maximum(below[first, 0], 1)
        share = lambda a, b: a / np.maximum(b, 1)
        columns = [
            np.log1p(below[:, 0]), share(below[:, 1], below[:, 0]), share(below[:, 0], below[:, 4] + 1), share(below[:, 3], below[:, 2]), below[:, 0] / whole, np.log1p(below[:, 5]), np.log1p(below[:, 6]),
            np.log1p(own[:, 0]), share(own[:, 1], own[:, 0]), share(own[:, 3], own[:, 2]), share(own[:, 0], own[:, 2]), depth, siblings, alike, place,
            share(below[up, 1], below[up, 0]), share(below[up, 0], below[up, 4] + 1), share(below[:, 0], below[up, 0]),
        ]
        columns += [kind == i for i in range(len(TAG_KINDS) + 1)]
        columns += [(tokens >> i) & 1 for i in range(len(TOKEN_KINDS))]
        columns += [(above_tokens >> i) & 1 for i in range(len(TOKEN_KINDS))]
        columns += [(above_kinds >> i) & 1 for i in (5, 6, 7, 8, 9, 10)]
        columns += [np.array(v) for v in (self.says, self.holds, self.heard)]
        return np.column_stack(columns).astype(float)

    def decode(self, margin: np.ndarray) -> np.ndarray:
        """The kept blocks: greatest sum of weighted log odds among sets that hold the parents of their members."""
        gain = (margin * (np.sqrt(np.array(self.chars, float)) + 0.25)).tolist()
        for i in range(len(gain) - 1, -1, -1):
            if self.parent[i] >= 0 and gain[i] > 0:
                gain[self.parent[i]] += gain[i]
        keep = [g > 0 for g in gain]
        for i, p in enumerate(self.parent):
            keep[i] = keep[i] and (p < 0 or keep[p])
        return np.array(keep, bool)

    def extract(self, keep: np.ndarray) -> list[str]:
        kept = keep.tolist()
        out = []
        for texts in self.texts:
            pieces = [" " if piece is None else piece for block, piece in texts if piece is None or kept[block]]
            out.append(" ".join("".join(pieces).split()))
        return out


@lru_cache(1000)
def _tag_kind(tag: str) -> int:
    return next((i for i, kind in enumerate(TAG_KINDS) if tag in kind), len(TAG_KINDS))


class _Writer:
    """Writes pages whose block elements carry their label as data-y."""

    def __init__(self, rng: random.Random):
        self.r = rng

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        made = ["".join(r.choice("bcdfglmnprstvz") + r.choice("aeiouéü") for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        for i in range(len(made)):
            if r.random() < 0.1:
                made[i] += r.choice(".,.,.,!?")
            if r.random() < 0.02:
                made[i] += r.choice(["&amp;", "***", "$$$", "###"])
        return (" ".join(made)).capitalize() + r.choice([".", ".", ".", "", "?"])

    def sentence(self, lo: int = 12, hi: int = 140) -> str:
        text = self.words(lo, hi)
        if self.r.random() < 0.15:
            text += f' <a href="/x">{self.words(1, 4)}</a> {self.words(2, 9)}'
        if self.r.random() < 0.15:
            text = f"<{(t := self.r.choice(['b', 'em', 'strong', 'span']))}>{text}</{t}>"
        return text

    def el(self, tag: str, y: int, inner: str, attributes: str = "") -> str:
        return f'<{tag} data-y="{y}"{" " + attributes if attributes else ""}>{inner}</{tag}>'

    def named(self, y: int, inner: str, tags: list[str], names: list[str], bare: float = 0.0) -> str:
        tag = self.r.choice(tags)
        if self.r.random() < bare:
            return self.el(tag, y, inner)
        return self.el(tag, y, inner, f'{self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}"')

    def links(self, y: int = 0) -> str:
        items = [f'<a href="/{i}">{self.words(1, 4).rstrip(".?")}</a>' for i in range(self.r.randint(3, 9))]
        if self.r.random() < 0.7:
            return self.el("ul", y, "".join(self.el("li", y, i) for i in items))
        return " ".join(items)

    def boilerplate(self, which: str) -> str:
        r, el, named = self.r, self.el, self.named
        p = lambda lo=4, hi=30: r.choice([el("p", 0, self.words(lo, hi)), self.words(lo, hi)])
        if which == "menu":
            return r.choice([el("nav", 0, self.links()), named(0, self.links(), ["nav", "div", "div", "ul"], ["nav", "menu", "main-menu", "navbar", "breadcrumb", "site-navigation"])])
        if which == "header":
            inner = r.choice([el("h1", 0, self.words(1, 5)), el("p", 0, self.words(1, 8)), self.words(1, 6)]) + r.choice(["", self.boilerplate("menu"), el("p", 0, self.words(2, 9))])
            return r.choice([el("header", 0, inner), named(0, inner, ["header", "div"], ["header", "site-header", "masthead", "topbar"])])
        if which == "footer":
            inner = r.choice(["&copy; ", "", "Copyright "]) + r.choice([self.words(3, 40), p(3, 40), self.links() + p()])
            return r.choice([el("footer", 0, inner), named(0, inner, ["footer", "div"], ["footer", "site-footer", "copyright", "legal"])])
        if which == "sidebar":
            inner = r.choice([el("h3", 0, self.words(1, 4)), ""]) + r.choice([self.links(), p(5, 60), self.links() + p(5, 40), p(10, 80) + p(10, 80)])
            return r.choice([el("aside", 0, inner), named(0, inner, ["aside", "div", "section"], ["sidebar", "side", "widget", "related", "related-posts", "recommended", "trending"])])
        if which == "advert":
            return named(0, r.choice([self.words(3, 25), p(3, 40), el("p", 0, self.words(8, 60)), f'<a href="/b">{self.words(2, 8)}</a>']), ["div", "div", "section", "aside", "p"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot"])
        if which == "notice":
            inner = r.choice([p(5, 40), p(5, 40) + el("button", 0, self.words(1, 2))])
            return named(0, inner, ["div", "div", "section", "p"], ["notice", "cookie-notice", "cookie-banner", "consent", "newsletter", "subscribe-box", "popup", "alert", "gdpr"])
        if which == "form":
            inner = el("label", 0, self.words(1, 4)) + '<input type="text">' + r.choice([el("p", 0, self.words(3, 25)), ""]) + el("button", 0, self.words(1, 2)) + r.choice(["", el("select", 0, el("option", 0, self.words(1, 3)) * 2)])
            return r.choice([el("form", 0, inner), named(0, inner, ["form"], ["search", "login", "contact", "newsletter-form"])])
        if which == "comments":
            one = lambda: r.choice([named(0, el("p", 0, self.words(4, 70)), ["div", "li", "article"], ["comment", "reply", "comment-body"], 0.2), el("p", 0, self.words(4, 70)), el("li", 0, self.words(4, 60))])
            if r.random() < 0.4:
                return self.announced()
            inner = r.choice([el("h3", 0, self.words(1, 3)), el("h2", 0, self.words(1, 3)), ""]) + "".join(one() for _ in range(r.randint(1, 6)))
            if r.random() < 0.3:
                inner += self.boilerplate("form")
            return named(0, inner, ["div", "section", "ol", "ul", "aside"], ["comments", "comment-list", "responses", "discussion", "reader-comments", "replies"])
        return named(0, r.choice([self.links(), self.words(2, 12)]), ["div", "ul", "p"], ["share", "social", "tags", "post-meta", "byline", "toolbar"])

    def announced(self) -> str:
        """Readers' comments whose attributes say nothing, after a line that announces them."""
        r, el, word = self.r, self.el, self.r.choice(sorted(READERS_WORDS))
        line = r.choice([f"{r.randint(1, 99)} {word}", word.capitalize(), f"{word.capitalize()} ({r.randint(1, 99)})", f"{self.words(1, 2)} {word}"])
        attributes = lambda: r.choice(["", "", f'class="{r.choice(["c1", "x9", "k", "row", "inner", "box"])}"'])
        one = lambda: r.choice([el("div", 0, el("p", 0, self.words(2, 70)), attributes()), el("p", 0, self.words(2, 70), attributes()), el("div", 0, self.words(2, 70), attributes()), el("li", 0, self.words(2, 60))])
        return el(r.choice(["div", "div", "section", "ul"]), 0, el(r.choice(["h2", "h3", "h4", "p", "div"]), 0, line) + "".join(one() for _ in range(r.randint(1, 6))), attributes())

    def content(self) -> str:
        r, el = self.r, self.el
        if r.random() < 0.12:  # a short article
            line = self.words(1, 7)
            return el("h1", 1, line) + el("p", 1, r.choice([line, f"<b>{line}</b><br>", self.words(1, 9)]))
        out = [el(r.choice(["h1", "h1", "h2"]), 1, self.words(2, 14))] if r.random() < 0.85 else []
        if out and r.random() < 0.15:
            out = [el("header", 1, out[0] + r.choice(["", el("p", 1, self.sentence(3, 25))]))]
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            kind = r.random()
            if kind < 0.78:
                out.append(el("p", 1, self.sentence(r.choice([1, 3, 6]), r.choice([6, 30, 140]))))
            elif kind < 0.83:
                out.append(el(r.choice(["h2", "h3"]), 1, self.words(1, 8)))
            elif kind < 0.86:
                out.append(el(r.choice(["ul", "ol"]), 1, "".join(el("li", 1, self.sentence(2, 25)) for _ in range(r.randint(2, 6)))))
            elif kind < 0.88:
                out.append(el(r.choice(["ul", "ol"]), 1, "".join(el("li", 1, f'<a href="/{i}">{self.words(1, 9)}</a>') for i in range(r.randint(2, 6)))))
            elif kind < 0.91:
                out.append(el("blockquote", 1, r.choice([self.sentence(), el("p", 1, self.sentence())])))
            elif kind < 0.93:
                out.append(el("pre", 1, self.words(4, 40)))
            elif kind < 0.95:
                out.append(el("table", 1, "".join(el("tr", 1, "".join(el("td", 1, self.words(1, 6)) for _ in range(3))) for _ in range(r.randint(1, 4)))))
            elif kind < 0.97:
                out.append(el("figure", 1, '<img src="x">' + el("figcaption", 1, self.words(2, 15))))
            else:
                out.append(el("div", 1, r.choice([self.sentence(), el("p", 1, self.sentence())])))
        for which, chance in (("advert", 0.2), ("sidebar", 0.1), ("share", 0.15), ("notice", 0.08), ("form", 0.06), ("comments", 0.12), ("menu", 0.04), ("footer", 0.05), ("header", 0.05)):
            if r.random() < chance:
                last = which in ("comments", "share", "form", "footer")
                out.insert(len(out) if last else 0 if which == "header" else r.randint(1, len(out)), self.boilerplate(which))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        inner = self.content()
        main = r.choice([
            lambda: self.el("article", 1, inner), lambda: self.el("article", 1, inner), lambda: self.el("main", 1, inner), lambda: self.el("main", 1, self.el("article", 1, inner)),
            lambda: self.named(1, inner, ["div", "section", "article", "main", "td"], ["content", "article", "post", "entry-content", "story", "post-body", "main-content"]),
            lambda: self.named(1, inner, ["div"], ["c1", "x", "col-8", "inner"], 0.5), lambda: inner,
        ])()
        before = [self.boilerplate(w) for w, c in (("header", 0.45), ("menu", 0.8), ("notice", 0.25), ("advert", 0.5), ("form", 0.15), ("sidebar", 0.15)) if r.random() < c]
        after = [self.boilerplate(w) for w, c in (("share", 0.15), ("sidebar", 0.35), ("comments", 0.35), ("form", 0.15), ("advert", 0.25), ("notice", 0.15), ("footer", 0.85)) if r.random() < c]
        if r.random() < 0.3:
            r.shuffle(before)
        if r.random() < 0.3:
            main = self.named(1, main, ["div", "div", "section"], ["wrapper", "container", "page", "row", "layout"], 0.3)
        body = "".join(before) + main + "".join(after)
        if r.random() < 0.25:
            body = self.named(1, body, ["div"], ["wrapper", "container", "site", "page", "app"], 0.3)
        return f'<html data-y="1"><body>{body}</body></html>'


@lru_cache(2)
def trained(pages: int = TRAINING_PAGES) -> gbt.Trees:
    """Trees fitted on so many generated pages; the same ones every time."""
    writer, made = _Writer(random.Random(11)), Pages()
    for _ in range(pages):
        made.add(writer.page())
    label = np.array(made.label)
    use = label >= 0
    weight = 0.3 + np.log1p(np.array(made.chars, float))[use] / 5
    return gbt.fit(made.features()[use], label[use].astype(float), weight)


def main_texts(sources: list[str | None], model: gbt.Trees) -> list[str]:
    pages = Pages()
    for s in sources:
        pages.add(s or "")
    return pages.extract(pages.decode(model.margin(pages.features()))) if sources else []


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) for every row, from the whole source.

    A null or empty source, and a page without main content, has an empty text.
    Markup that is broken is read as browsers mostly do; rows that repeat stay;
    other columns are ignored.
    """
    small_batches(pages.sparkSession)
    chosen = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(main_texts(batch.column(2).to_pylist(), model), pa.string())], ["id", "url", "text"])

    return chosen.mapInArrow(run, f"id {dict(chosen.dtypes)['id']}, url string, text string").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
