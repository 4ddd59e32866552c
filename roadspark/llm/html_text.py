"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks at block-level tags.  A block's features are its words and link density, those of
the blocks before and behind it, whether it lies in an article or main element, how many of the elements around it
are page furniture by their kind or by a whole name (class, id, role), how many have a name with a part that only hints
at furniture, which share of the page's plain words the outermost element with such a name holds, and whether it is in one
of several like items with an author or a time, as readers' comments are.  A decision tree, grown on the small labelled
tables LABELLED and MISNAMED, tells main text from the rest: a hint alone counts only for short or link-dense blocks, so
prose in `related-work` or `side-by-side` stays, and a whole name doesn't count where it stands for most of the page's
prose (`container sidebar-right`), as a layout's does.  Names are those of the attributes class, id, role and itemprop
alone, read as attributes; an element with a name of its own for an article (`entry-content`, `article-header`) counts as one, and its header is none of the page's.
Inline elements that are hidden or furniture by a whole name are left out of their block.

The scanner goes through a page once: it never looks for the same missing end twice, so its time is linear in the
page's length, also where quotes, comments or elements are never closed.  A page is held as one string, its blocks
as pieces of it.

Defined cases: null and empty pages, and pages without main text, give the empty text; unclosed and misnested tags
end where an element around them ends; white space (after character references are decoded) becomes one space;
a line break is white space; repeated rows are extracted each; an empty table gives no rows; other columns are
passed through only if named.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
QUOTE = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAMING = frozenset("class id role itemprop".split())
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template svg math iframe object canvas audio video title textarea select option button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr picture input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form menu dialog head fieldset".split())
#: Parts of names (class, id, role) that tell page furniture.
NAMES = frozenset("nav navbar navigation navigator menu menubar breadcrumb breadcrumbs header masthead topbar footer foot sidebar side aside widget ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent notice notices alert gdpr popup modal newsletter subscribe subscription signup login share sharing social related recommended comment comments reply replies responses respond disqus discussion form search pagination pager copyright legal complementary contentinfo toolbar skip tags".split())
#: Parts that say where or how, not what: a name of these and of NAMES alone is a whole name of furniture.
PLACES = frozenset("site page main top bottom left right box bar list lists wrap wrapper container block section area inner outer global primary secondary col column item items link links button buttons btn post posts article articles text title icon icons icn thread panel slot unit zone row group body content js id m s l xs sm md lg xl fixed sticky mobile desktop user users reader readers visitor visitors guest".split())
MAIN = frozenset("article main".split())
#: With one of the first a name of one of the second is the article's own.
OWN, OWN_PARTS = frozenset("article entry post story".split()), frozenset("header head title body text content".split())
#: Parts of names that tell who wrote an item, or when.
BYLINE = frozenset("author byline user username avatar posted date time timestamp says".split())

#: words, link density, words before, link density before, words behind, link density behind, in an article, furniture
#: around, hints around, main text?  The first group is measured on pages of a news shape (menu, advert, article,
#: footer), the others on blog, forum, shop and documentation shapes.
LABELLED = """
1 1.00 0 0.00 1 1.00 0 1 0 0
1 1.00 1 1.00 1 1.00 0 1 0 0
2 1.00 1 1.00 8 0.00 0 1 0 0
8 0.00 1 1.00 11 0.00 0 1 0 0
14 0.00 2 1.00 9 0.00 0 1 0 0
5 0.00 1 1.00 12 0.00 0 1 0 0
6 0.00 8 0.00 42 0.00 1 0 0 1
13 0.00 14 0.00 27 0.00 1 0 0 1
42 0.00 11 0.00 187 0.00 1 0 0 1
187 0.00 42 0.00 96 0.00 1 0 0 1
96 0.00 187 0.00 16 0.00 1 0 0 1
4 0.00 118 0.00 21 0.00 1 0 0 1
7 0.00 63 0.00 17 0.00 1 0 0 1
1 0.00 9 0.00 14 0.00 1 0 0 1
16 0.00 96 0.00 0 0.00 0 1 0 0
21 0.00 4 0.00 0 0.00 0 1 0 0
11 0.00 231 0.00 0 0.00 0 1 0 0
3 0.00 0 0.00 3 0.00 1 0 0 1
3 0.00 3 0.00 2 0.00 1 0 0 1
2 0.00 3 0.00 1 0.00 1 0 0 1
5 0.00 0 0.00 5 0.00 1 0 0 1
5 0.00 5 0.00 0 0.00 1 0 0 1
1 0.00 23 0.00 0 0.00 1 0 0 1
29 0.00 6 0.00 0 0.00 1 0 0 1
4 0.00 0 0.00 0 0.00 1 0 0 1
312 0.00 0 0.00 0 0.00 1 0 0 1
2 0.00 7 0.00 9 0.00 1 0 0 1
9 0.00 2 0.00 2 1.00 1 0 0 1
17 0.00 1 1.00 3 0.00 1 0 0 1
24 0.04 3 1.00 3 1.00 1 0 0 1
7 0.00 2 1.00 1 0.00 1 0 0 1
3 0.00 54 0.00 71 0.00 1 0 0 1
71 0.14 3 0.00 38 0.05 1 0 0 1
38 0.05 71 0.14 12 0.17 1 0 0 1
12 0.17 38 0.05 9 0.89 1 0 0 1
9 0.89 12 0.17 44 0.02 1 0 0 1
44 0.02 9 0.89 5 1.00 1 0 0 1
3 1.00 61 0.03 47 0.00 1 0 0 1
5 1.00 4 1.00 6 1.00 1 1 0 0
4 1.00 44 0.02 5 1.00 1 1 0 0
33 0.09 52 0.00 29 0.00 1 1 0 0
64 0.02 33 0.09 27 0.04 1 2 0 0
2 0.50 64 0.02 19 0.00 1 2 0 0
19 0.00 2 0.50 2 0.50 1 1 0 0
83 0.01 57 0.00 66 0.02 1 0 1 1
57 0.04 83 0.01 41 0.00 1 0 1 1
24 0.00 31 0.00 45 0.00 1 0 1 1
15 0.07 57 0.04 22 0.00 1 0 1 1
22 0.00 15 0.07 36 0.00 1 0 2 1
4 0.00 22 0.00 51 0.00 1 0 1 1
3 1.00 4 1.00 3 1.00 1 0 1 0
6 0.83 3 1.00 7 0.86 1 0 1 0
2 1.00 58 0.00 3 1.00 1 0 1 0
7 0.86 6 0.83 2 1.00 1 0 2 0
112 0.04 6 0.17 74 0.01 0 0 0 1
74 0.01 112 0.04 39 0.03 0 0 0 1
39 0.03 74 0.01 88 0.06 0 0 0 1
88 0.06 39 0.03 5 0.20 0 0 0 1
5 0.00 88 0.06 67 0.00 0 0 0 1
67 0.00 5 0.00 18 0.00 0 0 0 1
18 0.00 67 0.00 43 0.02 0 0 0 1
26 0.00 43 0.02 37 0.00 0 0 0 1
13 0.00 37 0.00 52 0.00 0 0 0 1
8 0.00 4 0.00 59 0.00 0 0 0 1
59 0.19 47 0.11 78 0.00 0 0 0 1
154 0.11 3 0.00 6 1.00 0 0 0 1
41 0.00 1 1.00 28 0.00 0 0 0 1
47 0.00 81 0.00 0 0.00 0 0 0 1
63 0.02 52 0.00 2 1.00 0 0 0 1
29 0.00 0 0.00 0 0.00 0 0 0 1
112 0.00 36 0.00 3 0.00 0 0 0 1
33 0.00 5 0.00 4 0.00 0 0 0 1
6 1.00 59 0.19 4 1.00 0 0 0 0
4 1.00 6 1.00 3 1.00 0 0 0 0
3 1.00 4 1.00 62 0.00 0 0 0 0
1 1.00 2 1.00 1 1.00 0 0 0 0
2 0.00 3 1.00 4 1.00 0 0 0 0
5 0.00 4 1.00 3 0.00 0 0 0 0
3 0.00 5 0.00 2 1.00 0 0 0 0
14 0.79 17 0.65 11 0.91 0 0 0 0
37 0.73 29 0.83 34 0.71 0 0 0 0
6 0.00 4 0.00 3 0.00 0 0 0 0
4 0.00 77 0.00 0 0.00 0 0 0 0
9 0.44 0 0.00 3 1.00 0 0 0 0
46 0.04 38 0.00 53 0.00 0 0 1 1
91 0.00 46 0.04 35 0.03 0 0 1 1
5 0.00 7 0.43 3 1.00 0 0 1 0
11 0.55 5 0.00 6 1.00 0 0 1 0
8 0.00 1 1.00 9 0.00 0 1 0 0
43 0.00 36 0.00 31 0.00 0 1 0 0
92 0.00 61 0.00 23 0.04 0 1 0 0
17 0.12 49 0.00 0 0.00 0 1 0 0
207 0.00 98 0.00 87 0.00 0 2 0 0
28 0.00 31 0.00 3 1.00 0 3 0 0
52 0.02 28 0.00 44 0.00 0 1 1 0
36 0.03 41 0.00 57 0.02 1 1 1 0
74 0.00 68 0.00 81 0.00 1 1 0 0
118 0.00 64 0.00 59 0.00 1 1 0 0
9 0.00 33 0.00 47 0.00 1 1 0 0
3 0.00 26 0.00 52 0.00 1 1 0 0
6 0.00 5 0.00 4 0.00 1 1 0 0
2 0.00 1 0.00 3 0.00 1 2 0 0
45 0.00 3 0.00 0 0.00 1 1 0 0
63 0.00 0 0.00 72 0.00 0 1 0 0
31 0.00 84 0.00 76 0.00 0 1 0 0
142 0.00 47 0.00 55 0.00 0 1 0 0
27 0.00 4 0.00 63 0.00 0 1 0 0
5 0.00 62 0.00 41 0.00 0 2 0 0
12 0.00 58 0.00 39 0.00 0 1 1 0
"""


#: The same, with the share of the page's plain words in the outermost named element and whether the block is in a thread.
MISNAMED = """
86 0.00 4 0.00 91 0.02 0 1 0 1.00 0 1
34 0.03 86 0.00 52 0.00 0 1 0 0.97 0 1
6 0.00 3 1.00 64 0.00 0 1 0 0.91 0 1
58 0.00 61 0.00 0 0.00 0 1 1 0.88 0 1
19 0.00 0 0.00 0 0.00 0 1 0 1.00 0 1
71 0.04 12 0.00 33 0.00 1 1 0 0.82 0 1
27 0.00 44 0.00 61 0.09 1 2 0 0.74 0 1
113 0.01 27 0.00 5 1.00 0 2 1 0.69 0 1
3 1.00 2 1.00 4 1.00 0 1 0 0.93 0 0
5 0.80 4 1.00 38 0.00 0 1 0 0.85 0 0
2 1.00 58 0.00 3 1.00 1 1 0 0.77 0 0
41 0.00 5 0.00 33 0.00 0 1 0 0.34 0 0
66 0.02 41 0.00 9 0.00 0 1 0 0.41 0 0
38 0.00 96 0.00 22 0.00 1 1 0 0.27 0 0
24 0.00 7 0.00 18 0.00 0 1 1 0.18 0 0
49 0.00 8 0.00 31 0.00 1 0 0 0 1 0
12 0.00 2 0.00 27 0.00 1 0 0 0 1 0
31 0.03 4 0.00 2 0.00 0 0 0 0 1 0
77 0.00 3 0.00 5 0.00 0 0 1 0 1 0
4 0.00 49 0.00 31 0.00 0 0 0 0 1 0
2 0.50 31 0.00 44 0.00 1 0 1 0 1 0
"""


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> tuple:
    """A decision tree: (feature, bound, tree if at most the bound, tree otherwise) or (class,)."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return (int(2 * y.sum() > len(y)),)
    impurity = lambda c: len(c) * (1 - np.square(np.bincount(c, minlength=2) / len(c)).sum())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= bound
            score = impurity(y[left]) + impurity(y[~left])
            if best is None or score < best[0] - 1e-9:
                best = (score, f, float(bound), left)
    if best is None or best[0] >= impurity(y) - 1e-9:
        return (int(2 * y.sum() > len(y)),)
    _, f, bound, left = best
    return (f, bound, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1))


@lru_cache(maxsize=1)
def tree() -> tuple:
    rows = [list(map(float, line.split())) for line in LABELLED.strip().splitlines()]
    rows = [[*r[:9], 0.05 * (r[7] > 0), 0.0, r[9]] for r in rows]  # what is named there holds little of its page
    table = np.array(rows + [list(map(float, line.split())) for line in MISNAMED.strip().splitlines()])
    return grow(table[:, :-1], table[:, -1].astype(int))


def is_main(features: tuple, node: tuple) -> bool:
    while len(node) > 1:
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return bool(node[0])


@lru_cache(maxsize=4096)
def attributes_of(text: str) -> tuple[tuple[str, str], ...]:
    """Names and values of a tag's attributes; the first of a name counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return tuple(out.items())


@lru_cache(maxsize=4096)
def named(attributes: str) -> tuple[int, bool, bool]:
    """What an element's attributes make it: 3 hidden, 2 furniture by a whole name, 1 a hint of it, 0 neither; whether
    its names tell of an author or a time, and whether they tell of an article's own part."""
    kind, byline, own = 0, False, False
    for key, value in attributes_of(attributes):
        if key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and UNSEEN.search(value):
            kind = 3
        if key not in NAMING:
            continue
        for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
            parts = [p for p in re.split(r"[^a-z]+", name) if p]
            byline |= not BYLINE.isdisjoint(parts)
            if not OWN.isdisjoint(parts) and set(parts) <= OWN | OWN_PARTS:
                own = True
                continue
            if NAMES.isdisjoint(parts):
                continue
            kind = max(kind, 2 if all(p in NAMES or p in PLACES for p in parts) else 1)
    return kind, byline, own


class Scanner:
    """Tags of a page in order, each looked for once."""

    def __init__(self, html: str) -> None:
        self.html, self.quotes, self.endless = html, True, set()

    def end_of_tag(self, pos: int) -> int:
        """The place of the > that ends a tag, outside quotes as long as quotes are closed; -1 for none."""
        if self.quotes:
            at = pos
            while m := QUOTE.search(self.html, at):
                if m[0] == ">":
                    return m.start()
                at = self.html.find(m[0], m.end()) + 1
                if not at:
                    break
            self.quotes = False  # a quote that never ends: from here on they mean nothing
        return self.html.find(">", pos)

    def behind(self, name: str, pos: int) -> int | None:
        """The place behind an element's end tag; None if there is none."""
        if name in self.endless:
            return None
        close = re.compile(rf"</{name}\s*>", re.I).search(self.html, pos)
        if not close:
            self.endless.add(name)
            return None
        return close.end()

    def __iter__(self) -> Iterator[tuple[str, str, str, bool]]:
        """(text before, name, attributes, closing); the last has no name."""
        html, start, pos = self.html, 0, 0
        while (at := html.find("<", pos)) >= 0:
            if html.startswith(("<!", "<?"), at):
                mark = "-->" if html.startswith("<!--", at) else "]]>" if html.startswith("<![CDATA[", at) else ">"
                end = html.find(mark, at + (4 if mark == "-->" else 2))
                yield html[start:at], "", "", False
                start = pos = len(html) if end < 0 else end + len(mark)
                continue
            m = NAME.match(html, at + 1)
            end = self.end_of_tag(m.end()) if m else -1
            if end < 0:
                pos = at + 1  # no tag, but a sign
                continue
            name = m[1].lower()
            yield html[start:at], name, html[m.end() : end], html[at + 1] == "/"
            start = pos = end + 1
            if name in RAW and html[at + 1] != "/" and html[end - 1] != "/":
                close = self.behind(name, pos)
                if close or name in ("script", "style", "textarea", "title"):
                    start = pos = close or len(html)
        yield html[start:], "", "", False


Block = tuple[str, int, float, bool, int, int, float, bool]


def blocks(html: str) -> list[Block]:
    """A page's flat blocks: text, words, link density, in an article, furniture around, hints around, the share of the
    page's plain words in the outermost element with a name of furniture, in a thread."""
    out: list = []
    parts: list[str] = []
    linked: list[str] = []
    # elements in order of their beginnings: parent, article, furniture by kind, by name, hint, byline, signature
    elements: list[list] = [[0, 0, 0, 0, 0, 0, ""]]
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}
    inside = link = 0
    mute: list = []  # name, how often it is open, elements around

    def at() -> int:
        return stack[-1][1] if stack else 0

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                n = text.count(" ") + 1
                out.append((text, n, min(1.0, len(unescape(" ".join(linked)).split()) / n) if linked else 0.0, at()))
            parts.clear()
            linked.clear()

    def leave() -> str:
        nonlocal inside
        name, k = stack.pop()
        opened[name] -= 1
        inside -= elements[k][1]
        return name

    for text, name, attributes, closing in Scanner(html):
        if text and not mute:
            parts.append(text)
            if link:
                linked.append(text)
        if not name or name in RAW:
            continue
        if mute and name == mute[0]:
            mute[1] += -1 if closing else 1
            if not mute[1]:
                mute = []
        elif name == "br":
            parts.append(" ")
        elif name in INLINE:
            if name == "a":
                link = 0 if closing else 1
            if not closing and not mute and (attributes or name == "time"):
                kind, byline, _ = named(attributes)
                if byline or name == "time":
                    elements[at()][5] = 1
                if kind >= 2 and name not in VOID and not attributes.endswith("/"):
                    mute = [name, 1, len(stack)]
                    link = 0
        else:
            if mute and len(stack) <= mute[2] and (name == "p" or closing):
                mute = []
            flush()
            link = 0
            if closing:
                if opened.get(name):
                    while leave() != name:
                        pass
            elif name not in VOID and name not in ("p", "html"):
                if name in ("li", "tr", "td", "th", "dt", "dd") and stack and stack[-1][0] == name:
                    leave()
                if name == "body":
                    while stack:
                        leave()
                kind, byline, own = named(attributes) if attributes else (0, False, False)
                if name in MAIN or name == "body":
                    kind = 0
                k = int(name in FURNITURE or (name == "header" and not inside and not own) or kind == 3)
                elements.append([at(), int(name in MAIN or own), k, int(kind == 2 and not k), int(kind == 1), int(byline), f"{name} {dict(attributes_of(attributes)).get('class', '') if attributes else ''}"])
                stack.append((name, len(elements) - 1))
                opened[name] = opened.get(name, 0) + 1
                inside += elements[-1][1]
            elif name == "p" and attributes:
                kind, byline, _ = named(attributes)
                if byline:
                    elements[at()][5] = 1
                if kind >= 2:
                    mute = ["p", 1, len(stack)]  # up to its end, or the next block's
    flush()
    return _featured(out, elements)


def _featured(found: list[tuple], elements: list[list]) -> list[Block]:
    """Blocks with what their elements say, each element looked at once."""
    plain = [0] * len(elements)
    for _, n, density, k in found:
        plain[k] += n if density < 0.5 else 0
    for k in range(len(elements) - 1, 0, -1):
        e, parent = elements[k], elements[k][0]
        if not e[2]:  # what furniture by its kind holds is none of the page's prose
            plain[parent] += plain[k]
        if e[5] == 1 and not e[1] and parent:  # an item may hold its byline in an element of its own
            elements[parent][5] = elements[parent][5] or 2
    items: dict[tuple[int, str], int] = {}
    for e in elements[1:]:
        if e[5] and not e[1]:
            items[e[0], e[6]] = items.get((e[0], e[6]), 0) + 1
    # in an article, furniture by kind, by name, hints, outermost named element, in a thread
    sums = [(0, 0, 0, 0, 0, False)] * len(elements)
    for k, (parent, main, kind, name, hint, byline, signature) in enumerate(elements):
        if k:
            a, f, g, h, outer, thread = sums[parent]
            sums[k] = (a + main, f + kind, g + name, h + hint, outer or k * name, thread or bool(byline) and not main and items[parent, signature] > 1 and 2 * plain[k] < plain[0])
    out = []
    for text, n, density, k in found:
        a, f, g, h, outer, thread = sums[k]
        # a name's share of the page excuses no furniture by its kind
        share = 0.05 if f else plain[outer] / max(1, plain[0]) if g else 0.0
        out.append((text, n, density, a > 0, f + g, h, share, thread))
    return out


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    node = tree()
    keep = []
    for i, (text, n, density, inside, around, hints, share, thread) in enumerate(found):
        before = found[i - 1] if i else (0, 0, 0.0)
        behind = found[i + 1] if i + 1 < len(found) else (0, 0, 0.0)
        if is_main((n, density, before[1], before[2], behind[1], behind[2], inside, around, hints, share, thread), node):
            keep.append(text)
    return "\n".join(keep)


def extract(pages: DataFrame, *, columns: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """columns of pages, and text."""
    from pyspark.sql.types import StringType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                text = pa.array([main_text(h) for h in part.column(0).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], text], names=[*(f"c{i}" for i in range(len(columns))), "text"])

    own = pages.select(F.col("html").alias("_html"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)))
    schema = StructType([*(StructField(f"c{i}", pages.schema[c].dataType) for i, c in enumerate(columns)), StructField("text", StringType())])
    return own.mapInArrow(run, schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), "text")
