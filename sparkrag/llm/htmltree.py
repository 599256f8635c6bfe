"""Main text of web pages by a tree-structured graphical model.

The page is read into a tree of its block elements (inline markup joins the text of the block around it). Every node has
a hidden state, content or not. Potentials between parent and child depend on the child's tag; a node's own evidence
comes from its tag, its class/id/role words (of a compound the last word that names a thing counts for itself, those before it as words said of it), the
length and link share of its own text, its place in the page and the share of the page's text that it holds; like siblings share
their evidence, lest a run of short paragraphs outvote the rest of an article. Sum-product messages
go up from the leaves and down from the root, which gives each node's exact marginal; text whose node is content with
probability >= 0.5 is kept in page order.

All potentials are smoothed counts of labelled pages. `labelled_pages` writes such pages from a seeded grammar of page
layouts with invented words (a documented, bounded training set); other labelled trees can be passed to `fit`.

Defined results: null or empty html, or a page with no content, has an empty text and n_chars 0; repeated rows repeat; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkrag.llm.common import blocks

# Element classes of the HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
UNSEEN = frozenset("script style template noscript head title svg math object iframe canvas audio video select option datalist meta link".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table article section div body main aside nav footer header form".split())

# A tag that no > ends before the next < outside quotes is text, so that no part of a page is read over and over.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/><]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTR = re.compile(r"""(class|id|role|itemprop|style|hidden|aria-label)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# End tags of these close whatever is open in them; others stop at cells and parts of the page.
_OUTER = frozenset("div article section main nav footer header aside form".split())
_INNER = ("td", "th", "article", "nav", "aside", "footer", "main")


class Tree:
    """Block elements in page order: parent, tag, attribute words; and text runs (node, text, linked characters)."""

    __slots__ = ("parent", "tag", "words", "runs", "size", "links")

    def __init__(self):
        self.parent, self.tag, self.words = [-1], ["html"], [()]
        self.runs: list[tuple[int, str]] = []
        self.size, self.links = [0], [0]


def attribute_words(attrs: str) -> tuple:
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return ()
    out = []
    for name, *values in _ATTR.findall(attrs):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name == "hidden" or name == "style" and "none" in value and "display" in value:
            out.append("hidden")
        elif name in ("class", "id", "role", "itemprop"):
            for given in value.split():
                # of a compound the last word names the thing, but for words of mere containers, and those before it say more of it: a header-image
                # is an image, post-meta is meta, a sidebar-box is a sidebar
                found = [w.lower() for w in _WORD.findall(given)]
                last = max((i for i, w in enumerate(found) if w not in NEUTRAL), default=0)
                out += ["~" + w for w in found[:last]] + found[last:]
    return tuple(sorted(set(out)))


class _Open:
    """The open elements, with the places of each tag, so that the nearest of some tags is found without walking the stack."""

    def __init__(self, tags: list[str]):
        self.tags, self.nodes, self.where = tags, [0], defaultdict(list)

    def push(self, node: int) -> None:
        self.where[self.tags[node]].append(len(self.nodes))
        self.nodes.append(node)

    def nearest(self, names) -> int:
        return max((w[-1] for n in names if (w := self.where.get(n))), default=0)

    def cut(self, k: int) -> None:
        while len(self.nodes) > k:
            self.where[self.tags[self.nodes.pop()]].pop()


class _Ends:
    """Places of end tags by name, each page position looked at once a name."""

    def __init__(self, page: str):
        self.page, self.found = page, {}

    def after(self, name: str, pos: int) -> tuple[int, int] | None:
        at = self.found.get(name, (-1, -1))
        if at is not None and at[0] < pos:
            m = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^<>]*+>?", re.I).search(self.page, pos)
            at = self.found[name] = m.span() if m else None
        return at


def parse(page: str) -> Tree:
    """The page's tree, in time linear in its length. Elements without visible text (scripts, styles, head data, graphics, choices) are
    passed over up to their end tag and do not part the text around them; one without an end tag hides nothing."""
    t = Tree()
    parent, tags, words, runs, size, links = t.parent, t.tag, t.words, t.runs, t.size, t.links
    stack, ends = _Open(tags), _Ends(page)
    buf: list[str] = []
    linked, in_link = 0, 0

    def flush():
        nonlocal linked
        if buf:
            text = " ".join(_html.unescape("".join(buf)).split())
            buf.clear()
            if text:
                node = stack.nodes[-1]
                runs.append((node, text))
                size[node] += len(text)
                links[node] += min(linked, len(text))
        linked = 0

    def close_to(names, stop):
        k = stack.nearest(names)
        if k and k > stack.nearest(stop):
            flush()
            stack.cut(k)

    pos, end = 0, len(page)
    while pos < end:
        m = _TOKEN.search(page, pos)
        if m is None:
            buf.append(page[pos:])
            break
        if m.start() > pos:
            part = page[pos : m.start()]
            buf.append(part)
            if in_link:
                linked += len(part)
        pos = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        attrs = m.group(3)
        if name in UNSEEN:
            if not m.group(1) and name not in VOID and name != "head" and not attrs.endswith("/"):
                pos = _past(name, ends, page, pos)
            continue
        if m.group(1):
            if name in INLINE:
                if name == "a":
                    in_link = 0
            elif name not in ("html", "body"):
                close_to((name,), () if name in _OUTER else _INNER)
            continue
        if name in INLINE:
            if name == "br" or name == "img":
                buf.append(" ")
            elif name == "a":
                in_link = 1
            continue
        if name in VOID and name != "hr" or name in ("html", "body"):
            continue
        flush()
        in_link = 0
        if name in CLOSES_P:
            close_to(("p",), SCOPE)
        if name in SAME:
            close_to(SAME[name], SCOPE)
        if name == "hr":
            continue
        node = len(parent)
        parent.append(stack.nodes[-1])
        tags.append(name)
        words.append(attribute_words(attrs))
        size.append(0)
        links.append(0)
        if name in RAW:
            stop = ends.after(name, pos) or (end, end)
            raw, pos = page[pos : stop[0]], stop[1]
            if raw.strip():
                text = " ".join(_html.unescape(raw).split())
                runs.append((node, text))
                size[node] += len(text)
            continue
        stack.push(node)
    flush()
    return t


def _past(name: str, ends: _Ends, page: str, pos: int) -> int:
    """The position after an unseen element that begins before pos; nested ones of its name count."""
    opening = None if name in RAW else re.compile(rf"<{re.escape(name)}(?=[\s/>])", re.I)
    depth, start = 1, pos
    while depth:
        stop = ends.after(name, pos)
        if stop is None:
            return len(page) if name in ("script", "style") else start
        if opening is not None:
            depth += sum(1 for _ in opening.finditer(page, pos, stop[0]))
        depth, pos = depth - 1, stop[1]
    return pos


def _level(n: int) -> int:
    return 0 if n == 0 else 1 if n < 25 else 2 if n < 80 else 3 if n < 250 else 4


def alike(tree: Tree, keys: list[tuple]) -> list[float]:
    """Each node's share in the evidence of its like siblings (same parent, tag and kind of text): m of them speak for 1 + log m,
    as what one short paragraph says is not said anew by the next."""
    m = Counter((tree.parent[i], k[0], *k[2:5]) for i, k in enumerate(keys))
    return [(1 + math.log(c)) / c for c in (m[tree.parent[i], k[0], *k[2:5]] for i, k in enumerate(keys))]


def evidence_keys(tree: Tree) -> list[tuple]:
    """(tag, words, level of own text, link share, end of sentence, place in page, share of the page's text in what it holds) of each node."""
    n = len(tree.tag)
    ends = [0] * n
    for node, text in tree.runs:
        if text[-1] in ".!?…:;\"'”»":
            ends[node] = 1
    held = list(tree.size)
    for i in range(n - 1, 0, -1):
        held[tree.parent[i]] += held[i]
    out = []
    for i in range(n):
        s = tree.size[i]
        x = (held[i] - s) / held[0] if held[0] else 0
        share = tree.links[i] / s if s else 0
        out.append((tree.tag[i], tree.words[i], _level(s), 0 if not share else 1 if share < 0.3 else 2 if share < 0.75 else 3, ends[i], min(3, 4 * i // n), 0 if not x else 1 if x < 0.15 else 2 if x < 0.4 else 3))
    return out


class Model:
    """Log-evidence by feature and transition potentials P(child | parent, child's tag)."""

    def __init__(self, evidence: dict, transition: dict, root: float):
        self.evidence, self.transition, self.root = evidence, transition, root
        self._seen: dict[tuple, float] = {}

    def ratio(self, key: tuple) -> float:
        """Log of the likelihood ratio content : other of a node's own evidence."""
        r = self._seen.get(key)
        if r is None:
            tag, words, level, share, ends, place, bulk = key
            e = self.evidence
            total = 0.0
            for f in (("text", tag, level, share, ends), ("place", tag, place), ("bulk", tag, bulk)):
                total += e[f] if f in e else e.get((f[0], "*", *f[2:]), 0.0)
            total += sum(e.get(("word", w), 0.0) for w in words)
            r = max(-30, min(30, total))
            if len(self._seen) > 200_000:
                self._seen.clear()
            self._seen[key] = r
        return r

    def marginals(self, tree: Tree) -> list[float]:
        """P(content) of every node, by messages upward and downward."""
        n = len(tree.tag)
        keys = evidence_keys(tree)
        base = self.transition.get("*")
        trans = [self.transition.get(t, base) for t in tree.tag]
        up0, up1 = [1.0] * n, [math.exp(w * self.ratio(k)) for k, w in zip(keys, alike(tree, keys))]
        to0, to1 = [1.0] * n, [1.0] * n  # each node's message to its parent
        parent = tree.parent
        for i in range(n - 1, 0, -1):
            a, b = up0[i], up1[i]
            s = a + b
            a, b = a / s, b / s
            up0[i], up1[i] = a, b
            p01, p11 = trans[i]
            m0, m1 = (1 - p01) * a + p01 * b, (1 - p11) * a + p11 * b
            to0[i], to1[i] = m0, m1
            p = parent[i]
            x, y = up0[p] * m0, up1[p] * m1
            s = x + y
            up0[p], up1[p] = x / s, y / s
        out = [0.0] * n
        a, b = (1 - self.root) * up0[0], self.root * up1[0]
        out[0] = b / (a + b)
        for i in range(1, n):
            q1 = out[parent[i]]
            q0 = 1 - q1
            # what the parent believes without this child's own message
            x, y = q0 / to0[i], q1 / to1[i]
            s = x + y
            x, y = x / s, y / s
            p01, p11 = trans[i]
            a = (x * (1 - p01) + y * (1 - p11)) * up0[i]
            b = (x * p01 + y * p11) * up1[i]
            out[i] = b / (a + b)
        return out


def fit(pages: list[tuple[Tree, list[int]]], smooth: float = 0.5) -> Model:
    """Counts of labelled trees (state 1: content) as potentials."""
    own: dict = defaultdict(lambda: [0, 0])  # feature: rows by state
    by_tag: dict = defaultdict(lambda: [0, 0])
    pairs: dict = defaultdict(lambda: [[0, 0], [0, 0]])
    for tree, state in pages:
        for i, (key, s) in enumerate(zip(evidence_keys(tree), state)):
            tag, words, level, share, ends, place, bulk = key
            for t in (tag, "*"):
                by_tag[t][s] += 1
                own["text", t, level, share, ends][s] += 1
                own["place", t, place][s] += 1
                own["bulk", t, bulk][s] += 1
            for w in words:
                own["word", w][s] += 1
            if i:
                for t in (tag, "*"):
                    pairs[t][state[tree.parent[i]]][s] += 1

    def rate(f, t, s, back):
        """P(feature | state, tag), leaning on the rate over all tags where the tag is rare."""
        return (own[f][s] + 20 * back) / (by_tag[t][s] + 20) if f in own else back

    evidence = {}
    n = by_tag["*"]
    for f, c in list(own.items()):
        if f[0] == "word":
            evidence[f] = math.log((c[1] + smooth) / (n[1] + 2 * smooth) * (n[0] + 2 * smooth) / (c[0] + smooth))
            continue
        t = f[1]
        g = own[(f[0], "*", *f[2:])]
        back = [(g[s] + smooth) / (by_tag["*"][s] + 40 * smooth) for s in (0, 1)]
        r = [rate(f, t, s, back[s]) if t != "*" else back[s] for s in (0, 1)]
        evidence[f] = (0.7 if f[0] == "text" else 0.15 if f[0] == "place" else 0.2) * math.log(r[1] / r[0])
    transition = {}
    for t, c in pairs.items():
        p01 = (c[0][1] + 0.02) / (sum(c[0]) + 20)
        p11 = (c[1][1] + smooth) / (sum(c[1]) + 2 * smooth)
        transition[t] = (min(p01, 0.01), min(max(p11, 1e-4), 1 - 1e-4))
    return Model(evidence, transition, 0.9999)


# Words of class and id attributes by the part of a page they name, for the layouts of labelled pages.
PARTS = {
    "nav": "nav navbar navigation menu menubar topnav topbar breadcrumb breadcrumbs pagination pager tabs toc skip",
    "header": "header masthead banner branding logo site head hero tagline",
    "footer": "footer foot copyright legal colophon bottom imprint",
    "aside": "sidebar aside side rail widget widgets complementary related recommended trending popular tags categories archive blogroll",
    "ad": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion banner outbrain taboola dfp",
    "notice": "notice cookie cookies consent gdpr alert alertdialog popup modal overlay toast warning paywall message disclaimer",
    "form": "form newsletter subscribe signup login search searchbox contact register",
    "comments": "comment comments commentlist reply replies respond discussion disqus thread reader readers feedback responses",
    "share": "share sharing social follow buttons toolbar meta byline author bio date",
}
CONTENT = "article content post entry main story body text page blog news articlebody maincontent single hentry prose copy".split()
# Last words of compounds that name a piece of an article, whatever stands before them.
PIECES = "image figure photo picture caption gallery video embed quote pullquote note lead intro summary".split()
NEUTRAL = "container wrapper row col inner outer grid box section block left right wide clearfix module group item bar unit panel area list".split()


class _Writer:
    """One labelled page: html and, for each block element in order, its state."""

    def __init__(self, rng: random.Random):
        self.rng, self.out, self.state = rng, [], [1]

    def words(self, lo, hi):
        r = self.rng
        return ["".join(r.choice("aeioulnrstdmcp") for _ in range(r.randint(1, 9))) for _ in range(r.randint(lo, hi))]

    def sentence(self, lo=4, hi=24):
        return " ".join(self.words(lo, hi)).capitalize() + self.rng.choice("....!?")

    def heading(self):
        return self.sentence(2, 12) if self.rng.random() < 0.5 else " ".join(self.words(1, 9))

    def prose(self):
        text = " ".join(self.sentence() for _ in range(self.rng.choice((1, 1, 2, 3, 5, 8))))
        return text[:-1] if self.rng.random() < 0.12 else text

    def attr(self, names, often=0.8):
        r = self.rng
        if r.random() > often:
            return ""
        kind = r.choice(("class", "class", "class", "id"))
        extra = " " + r.choice(NEUTRAL) if r.random() < 0.3 and kind == "class" else ""
        name, x = r.choice(names), r.random()
        if x < 0.2:
            name = self.compound(name, r.choice(NEUTRAL))
        elif x < 0.45:
            name = self.compound(r.choice((*NEUTRAL, *CONTENT, "site", "page")), name)
        return f' {kind}="{name}{extra}"'

    def compound(self, before, last):
        return f"{before}{self.rng.choice('--_')}{last}"

    def piece(self):
        """A piece of the article whose name may begin as that of any part of a page does."""
        r = self.rng
        name = self.compound(r.choice([*CONTENT, *NEUTRAL, *PARTS[r.choice(list(PARTS))].split()]), r.choice(PIECES))
        if r.random() < 0.4:
            self.leaf("p", 1, self.prose(), f' class="{name}"')
            return
        tag = r.choice(("div", "div", "section", "figure"))
        self.open(tag, 1, f' class="{name}"')
        for _ in range(r.choice((1, 1, 2))):
            self.leaf("figcaption" if tag == "figure" else "p", 1, self.prose())
        self.close(tag)

    def open(self, tag, state, attrs=""):
        self.out.append(f"<{tag}{attrs}>")
        self.state.append(state)

    def close(self, tag):
        self.out.append(f"</{tag}>")

    def leaf(self, tag, state, text, attrs=""):
        self.open(tag, state, attrs)
        self.out.append(text)
        self.close(tag)

    def links(self, lo, hi):
        tag = self.rng.choice(("ul", "ul", "div", "ol"))
        self.open(tag, 0)
        for _ in range(self.rng.randint(lo, hi)):
            a = f'<a href="/x">{" ".join(self.words(1, 3))}</a>'
            self.leaf("li", 0, a) if tag != "div" else self.out.append(a + " ")
        self.close(tag)

    def boiler(self, part):
        r = self.rng
        names = PARTS[part].split()
        tag = {"nav": ("nav", "nav", "div", "ul"), "header": ("header", "header", "div"), "footer": ("footer", "footer", "div"), "aside": ("aside", "aside", "div"), "form": ("form", "form", "div"), "comments": ("div", "section", "ol", "div"), "notice": ("div", "div", "dialog", "p", "section")}.get(part, ("div", "div", "p", "section", "aside"))
        tag = r.choice(tag)
        plain = tag in ("nav", "header", "footer", "aside", "form")
        self.open(tag, 0, self.attr(names, 0.5 if plain else 1.0))
        if tag == "p":
            self.out.append(self.sentence())
        elif part in ("nav", "share") or part == "aside" and r.random() < 0.6:
            if r.random() < 0.3 and tag != "ul":
                self.leaf(r.choice(("h2", "h3", "h4")), 0, " ".join(self.words(1, 3)))
            self.links(2, 8)
        elif part == "comments":
            if tag != "ol" and r.random() < 0.6:
                self.leaf(r.choice(("h2", "h3")), 0, " ".join(self.words(1, 2)))
            for _ in range(r.randint(1, 5)):
                inner = "li" if tag == "ol" else r.choice(("div", "div", "article", "p"))
                self.open(inner, 0, self.attr(names, 0.7))
                if inner == "p" or r.random() < 0.3:
                    self.out.append(self.prose())
                else:
                    for _ in range(r.randint(1, 2)):
                        self.leaf("p", 0, self.prose())
                self.close(inner)
        elif part == "form":
            if r.random() < 0.6:
                self.leaf(r.choice(("p", "h3", "label")), 0, self.sentence()) if r.random() < 0.7 else None
                if self.out[-1] == "</label>":
                    self.state.pop()
            self.out.append('<input type="text">')
            self.leaf("button", 0, "ok")
        else:
            for _ in range(r.randint(1, 3)):
                if r.random() < 0.55:
                    self.leaf(r.choice(("p", "div", "h1", "h3", "span", "p")), 0, self.sentence(2, 14))
                    if self.out[-1] == "</span>":
                        self.state.pop()
                else:
                    self.out.append(self.sentence(2, 14))
        self.close(tag)

    def body(self):
        r = self.rng
        if r.random() < 0.8:
            self.leaf("h1", 1, self.heading())
            if r.random() < 0.15:  # who wrote it and when
                name = self.compound(r.choice(CONTENT), r.choice("meta byline author date".split()))
                self.leaf(r.choice(("div", "p")), 0, " ".join(self.words(1, 6)).capitalize() + r.choice(("", ".")), f' class="{name}"')
        if r.random() < 0.12:  # a run of short paragraphs
            for _ in range(r.randint(4, 40)):
                self.leaf("p", 1, " ".join(self.words(1, 6)) + r.choice(("", ".")))
        for _ in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.03:
                self.piece()
            elif x < 0.68:
                self.leaf("p", 1, self.prose() if r.random() < 0.9 else " ".join(self.words(1, 6)))
            elif x < 0.76:
                self.leaf(r.choice(("h2", "h3", "h4")), 1, self.heading())
            elif x < 0.83:
                tag = r.choice(("ul", "ol"))
                self.open(tag, 1)
                for _ in range(r.randint(2, 6)):
                    self.leaf("li", 1, self.sentence(1, 14) if r.random() < 0.7 else " ".join(self.words(1, 5)))
                self.close(tag)
            elif x < 0.87:
                self.open("blockquote", 1)
                self.leaf("p", 1, self.prose()) if r.random() < 0.6 else self.out.append(self.prose())
                self.close("blockquote")
            elif x < 0.90:
                self.open("table", 1)
                for _ in range(r.randint(1, 4)):
                    self.open("tr", 1)
                    for _ in range(2):
                        self.leaf(r.choice(("td", "td", "th")), 1, " ".join(self.words(1, 4)))
                    self.close("tr")
                self.close("table")
            elif x < 0.92:
                self.leaf("pre", 1, self.sentence())
            elif x < 0.94:
                self.open("figure", 1)
                self.leaf("figcaption", 1, self.sentence())
                self.close("figure")
            elif x < 0.97:
                self.leaf("div", 1, self.prose())
            else:
                self.boiler(r.choice(("ad", "share", "aside", "form", "notice")))

    def page(self):
        r = self.rng
        self.out.append("<!DOCTYPE html><html><head><title>t</title></head><body>")
        depth = r.choice((0, 0, 0, 1, 2))
        for _ in range(depth):
            self.open("div", 1, self.attr(NEUTRAL, 0.8))
        for part in ("notice", "header", "nav", "ad", "form", "share"):
            if r.random() < 0.45:
                self.boiler(part)
        if r.random() < 0.3:
            self.boiler("aside")
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section"))
        outer = r.random() < 0.3
        if outer:
            self.open("main", 1, self.attr(CONTENT, 0.3))
        self.open(tag, 1, self.attr(CONTENT, 0.9 if tag in ("div", "section") else 0.4))
        if r.random() < 0.12:
            self.boiler("header")
        self.body()
        if r.random() < 0.2:
            self.boiler(r.choice(("comments", "share", "footer")))
        self.close(tag)
        if r.random() < 0.3:
            self.boiler("comments")
        if outer:
            self.close("main")
        for part in ("comments", "aside", "share", "ad", "form", "nav"):
            if r.random() < 0.35:
                self.boiler(part)
        if r.random() < 0.8:
            self.boiler("footer")
        if r.random() < 0.3:
            self.boiler("notice")
        for _ in range(depth):
            self.close("div")
        self.out.append("</body></html>")
        return "".join(self.out), self.state


def labelled_pages(n: int = 1200, seed: int = 29) -> list[tuple[Tree, list[int]]]:
    """n pages of random layouts with the state of every block element."""
    out = []
    for k in range(n):
        page, state = _Writer(random.Random(seed * 100_003 + k)).page()
        tree = parse(page)
        if len(state) == len(tree.tag):
            out.append((tree, state))
    return out


def extract(page: str | None, model: Model) -> str:
    """The page's main text, one line a block."""
    if not page:
        return ""
    tree = parse(page)
    if not tree.runs:
        return ""
    p = model.marginals(tree)
    return "\n".join(text for node, text in tree.runs if p[node] >= 0.5)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row; one map over the scan. The model (a few KB) travels with the code."""
    model = model or fit(labelled_pages())
    made = (model.evidence, model.transition, model.root)

    def run(batches):
        m = Model(*made)
        for b in blocks(batches, "html", 4 << 20):
            texts = [extract(h, m) for h in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_OUT)

    slim = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
