"""Main text of web pages from flat text blocks.

A page is cut into flat blocks at block-level tags. A block has a word count, a link density, those of its neighbours,
and what the enclosing elements say about it. A decision tree trained on a small labelled table tells article text
from the rest.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm import common

# Element names of HTML and words that page authors use in class, id and role.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
MATH = frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup "
    "msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd mlabeledtr maction semantics".split()
)
INLINE |= MATH
RAW = frozenset("script style textarea title iframe".split())  # hold no elements: read up to the own end tag
DROPPED = frozenset("noscript template select datalist optgroup option object svg annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PLAIN = HEADINGS | frozenset("p li dt dd tr td th".split())  # may end without an end tag
ENDS_P = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup "
    "hr main menu nav ol p pre section summary table ul li dd dt".split()
)
BOUNDS = frozenset(
    "ul ol menu dir dl table caption td th article section main aside nav header footer form fieldset blockquote figure "
    "details dialog body html button".split()
)  # what starts or ends inside them closes nothing outside
TABLE, GROUPS, CELLS = frozenset(["table"]), frozenset("caption colgroup thead tbody tfoot".split()), frozenset(["td", "th"])
IMPLIED = {t: [(frozenset(["p"]), BOUNDS | DROPPED), (frozenset(["option"]), BOUNDS)] for t in ENDS_P}  # ends by a start tag
IMPLIED |= {
    "li": [(frozenset(["li"]), BOUNDS | DROPPED), *IMPLIED["li"]],
    "dt": [(frozenset(["dt", "dd"]), BOUNDS | DROPPED), *IMPLIED["dt"]],
    "dd": [(frozenset(["dt", "dd"]), BOUNDS | DROPPED), *IMPLIED["dd"]],
    "td": [(CELLS, TABLE | {"tr"})],
    "th": [(CELLS, TABLE | {"tr"})],
    "tr": [(frozenset(["tr"]), TABLE), (CELLS, TABLE), (frozenset(["caption", "colgroup"]), TABLE)],
    "option": [(frozenset(["option"]), frozenset("select datalist optgroup".split()))],
    "optgroup": [(frozenset([t]), frozenset("select datalist".split())) for t in ("optgroup", "option")],
    "body": [(frozenset(["head"]), frozenset())],
} | {t: [(GROUPS, TABLE), (frozenset(["tr"]), TABLE), (CELLS, TABLE)] for t in GROUPS}
HTML = ENDS_P | BOUNDS | PLAIN | GROUPS | INLINE - frozenset("a font".split())  # ends an svg without an end tag
BOILERPLATE_TAGS = frozenset("nav header footer aside form dialog menu button fieldset".split())
ARTICLE_TAGS = frozenset("article main".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion popup modal overlay "
    "cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login paywall "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager skip toolbar topbar masthead "
    "header footer copyright legal disclaimer sidebar aside widget widgets rail related recommended recirculation "
    "share sharing social comment comments commentlist respond reply replies discussion disqus form search hidden "
    "complementary contentinfo".split()
)
ARTICLE_WORDS = frozenset("article content main post entry story body articlebody text".split())
LEADING_WORDS = frozenset(
    "ad ads advert adverts advertisement cookie cookies consent gdpr newsletter subscribe subscription signup popup modal "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer copyright sidebar widget widgets related "
    "recommended share sharing social comment comments commentlist respond reply replies disqus sponsor sponsored promo".split()
)  # these say what an element is when they begin its name as well: comment-body, ad-slot
STATES = frozenset("has no not with without is js when if".split())  # what follows them in a name is a state of the page

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.IGNORECASE) for t in RAW}
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    inside: int  # 1 article, -1 boilerplate, 0 unknown
    heading: int

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def parts(name: str) -> list[str]:
    """The words of a class, id or role; none when it tells a state (has-sidebar, no-js)."""
    words = [w.lower() for w in NAME_WORDS.findall(name)]
    return [] if words and words[0] in STATES else words


def said_by(names: list[str]) -> int:
    """What names say: a boilerplate word as whole name or last part comes first, then an article word as whole name,
    then a boilerplate word that begins a name, then any article word."""
    split = [p for p in map(parts, names) if p]
    if any(p[-1] in BOILERPLATE_WORDS for p in split):
        return -1
    if any(len(p) == 1 and p[0] in ARTICLE_WORDS for p in split):
        return 1
    if any(p[0] in LEADING_WORDS for p in split):
        return -1
    return int(any(w in ARTICLE_WORDS for p in split for w in p))


def hint(tag: str, attributes: str, outer: int, begins: str = "") -> int:
    """What an element says of its content, which ``begins`` so: 1 article, -1 boilerplate, 0 nothing.

    html and body hold the article and all the rest, so they say nothing. Headings and terms are often called header,
    and their ids are often made of their text: neither says anything. Names of paragraphs, headings and list items lift
    no text out of boilerplate.
    """
    if tag in ("html", "body"):
        return 0
    named = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes else {}
    style = named.get("style", "").replace(" ", "").lower()
    if "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in style:
        return -1
    if tag == "header" and outer > 0:
        return 0  # the heading of an article
    if tag in BOILERPLATE_TAGS:
        return -1
    if tag in ARTICLE_TAGS:
        return 1
    names = [w for k in ("class", "id", "role") for w in named.get(k, "").split()]
    if tag in HEADINGS or tag in ("th", "dt", "dd"):
        slug = [w.lower() for w in NAME_WORDS.findall(named.get("id", ""))]
        if slug and slug == [w.lower() for w in NAME_WORDS.findall(begins)][: len(slug)]:
            names = [w for k in ("class", "role") for w in named.get(k, "").split()]
        names = [w for w in names if parts(w)[-1:] != ["header"]]
    said = said_by(names)
    return 0 if said > 0 and outer < 0 and tag in PLAIN and tag not in CELLS else said


class Open:
    """Open elements of a page, outermost first, each with a value."""

    def __init__(self):
        self.names, self.values, self.count = [], [], Counter()

    def push(self, tag: str, value) -> None:
        self.names.append(tag)
        self.values.append(value)
        self.count[tag] += 1

    def cut(self, size: int) -> None:
        for tag in self.names[size:]:
            self.count[tag] -= 1
        del self.names[size:], self.values[size:]

    def find(self, wanted: frozenset, bounds: frozenset) -> int:
        """Place of the innermost element of ``wanted`` that is not outside one of ``bounds``, or -1."""
        if any(self.count[t] for t in wanted):
            for i in range(len(self.names) - 1, -1, -1):
                if self.names[i] in wanted:
                    return i
                if self.names[i] in bounds:
                    break
        return -1

    def start(self, tag: str) -> None:
        """Close what a start tag closes."""
        for wanted, bounds in IMPLIED.get(tag, ()):
            if (at := self.find(wanted, bounds)) >= 0:
                self.cut(at)
        if tag in HEADINGS and self.names and self.names[-1] in HEADINGS:
            self.cut(len(self.names) - 1)

    def end(self, tag: str):
        """Close what an end tag closes; the value of its element, or None."""
        bounds = frozenset() if tag not in PLAIN else TABLE if tag in ("td", "th", "tr") else BOUNDS
        at = self.find(HEADINGS if tag in HEADINGS else frozenset([tag]), bounds)
        if at < 0:
            return None
        value = self.values[at]
        self.cut(at)
        return value


def tokens(page: str) -> list[tuple[int, int, bool, str, str]]:
    """Tags and comments in page order: start, end, is end tag, element, attributes. Without element: nothing but a gap."""
    out, at = [], 0
    while m := TAG.search(page, at):
        at = m.end()
        closing, tag, attributes = m[1] or m[4], (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                over = RAW_END[tag].search(page, at)
                at = over.end() if over else len(page)
            tag = ""
        out.append((m.start(), at, bool(closing), tag, attributes))
    return out


def own_ends(found: list[tuple[int, int, bool, str, str]]) -> dict[int, int]:
    """Start tags and their end tags by place; without those that are closed by what follows or by their parent's end."""
    ends: dict[int, int] = {}
    stack = Open()
    for i, (_, _, closing, tag, attributes) in enumerate(found):
        if not tag or tag in INLINE:
            continue
        if closing:
            if (begin := stack.end(tag)) is not None:
                ends[begin] = i
            continue
        stack.start(tag)
        if tag not in VOID and not (tag in DROPPED and attributes.endswith("/")):
            stack.push(tag, i)
    return ends


def blocks(page: str) -> list[Block]:
    """Flat text blocks in page order, white space folded, without empty ones.

    Elements of ``DROPPED`` are left out up to their own end tag; without one, they end with the first block-level tag.
    """
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    found = tokens(page)
    ends = own_ends(found)
    stack = Open()  # values: the hint that holds in the element, whether it has an own end tag
    inside, heading, links, at, i = 0, 0, 0, 0, 0
    left_out = ""  # an element of DROPPED without an own end tag

    def end() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                linked = sum(len(p.split()) for p, link in parts if link)
                words = text.count(" ") + 1
                out.append(Block(text, words, min(linked, words), inside, heading))
            parts = []

    while i < len(found):
        begin, stop, closing, tag, attributes = found[i]
        if begin > at and not left_out:
            parts.append((html.unescape(page[at:begin]), links > 0))
        at = stop
        own = ends.get(i)
        i += 1
        if not tag:
            continue
        if tag in DROPPED:
            if closing:
                left_out = ""
            elif own is not None:
                at, i = found[own][1], own + 1
            elif not attributes.endswith("/"):
                left_out = tag
            continue
        if left_out == "svg":
            if tag in HTML or closing and tag == "a":
                left_out = ""
            else:
                continue
        elif left_out and tag not in INLINE and (tag not in VOID or tag == "hr"):
            left_out = ""
        if tag == "a":
            links = 0 if closing else 1
        if tag == "br" or tag == "img":
            parts.append((" ", links > 0))
        if tag in INLINE:
            continue
        end()
        heading = int(tag in HEADINGS and not closing)
        links = 0
        if closing:
            stack.end(tag)
        else:
            stack.start(tag)
            if tag in ENDS_P and stack.names and stack.names[-1] in HEADINGS and not stack.values[-1][1]:
                stack.cut(len(stack.names) - 1)
            if tag not in VOID:
                outer = stack.values[-1][0] if stack.names else 0
                begins = page[stop : max(page.find("<", stop), stop)] if tag in PLAIN and attributes else ""
                said = hint(tag, attributes, outer, begins)
                stack.push(tag, (said or outer, own is not None))
        inside = stack.values[-1][0] if stack.names else 0
    if at < len(page) and not left_out:
        parts.append((html.unescape(page[at:]), links > 0))
    end()
    return out


def features(found: list[Block]) -> np.ndarray:
    """Per block: words and link density of itself, the one before and the one after; hint; heading."""
    words = np.array([0] + [b.words for b in found] + [0], float)
    density = np.array([0] + [b.density for b in found] + [0], float)
    inside = np.array([b.inside for b in found], float)
    heading = np.array([b.heading for b in found], float)
    columns = [words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], inside, heading]
    return np.column_stack(columns) if found else np.empty((0, len(columns)))


# The labelled table: blocks of twelve kinds of page, in page order: words, linked words, hint, heading, is article.
PAGES = (
    ((6, 6, -1, 0, 0), (7, 0, -1, 0, 0), (9, 0, 1, 1, 1), (60, 0, 1, 0, 1), (3, 0, 1, 0, 1), (1, 0, 1, 0, 1), (9, 0, -1, 0, 0)),
    ((1, 1, -1, 0, 0), (1, 1, -1, 0, 0), (1, 1, -1, 0, 0), (12, 0, 1, 1, 1), (250, 4, 1, 0, 1), (18, 0, 1, 0, 1), (14, 2, -1, 0, 0)),
    ((2, 2, 0, 0, 0), (1, 0, 0, 0, 0), (3, 3, 0, 0, 0), (8, 0, 0, 1, 1), (45, 0, 0, 0, 1), (70, 3, 0, 0, 1), (5, 0, 0, 0, 1), (80, 0, 0, 0, 1), (6, 5, 0, 0, 0)),
    ((5, 5, -1, 0, 0), (30, 3, -1, 0, 0), (10, 0, 1, 1, 1), (2, 0, 1, 0, 1), (120, 0, 1, 0, 1), (25, 0, -1, 0, 0), (90, 2, 1, 0, 1), (8, 8, 1, 0, 1), (40, 0, -1, 0, 0), (35, 0, -1, 0, 0)),
    ((4, 4, 0, 0, 0), (2, 0, 0, 0, 0), (5, 5, 0, 0, 0), (40, 0, -1, 0, 0), (7, 0, 0, 1, 1), (22, 0, 0, 0, 1), (4, 0, 0, 0, 1), (31, 0, 0, 0, 1), (16, 0, -1, 0, 0), (3, 3, 0, 0, 0), (3, 3, 0, 0, 0)),
    ((3, 0, -1, 1, 0), (5, 5, -1, 0, 0), (2, 0, 1, 1, 1), (1, 0, 1, 0, 1), (400, 0, 1, 0, 1), (20, 20, -1, 0, 0), (60, 1, -1, 0, 0), (2, 0, -1, 1, 0)),
    ((12, 0, -1, 0, 0), (15, 1, -1, 0, 0), (6, 0, 1, 1, 1), (28, 2, 1, 0, 1), (5, 0, 1, 1, 1), (33, 0, 1, 0, 1), (9, 3, 1, 0, 1), (4, 4, 1, 0, 1), (110, 0, -1, 0, 0)),
    ((1, 1, 0, 0, 0), (2, 2, 0, 0, 0), (150, 0, 0, 0, 1), (95, 0, 0, 0, 1), (2, 2, 0, 0, 0), (3, 0, 0, 0, 0), (2, 2, 0, 0, 0)),
    ((10, 10, 1, 0, 1), (6, 0, 1, 0, 1), (18, 0, 1, 0, 1), (12, 6, 1, 0, 1), (20, 19, 1, 0, 1), (7, 0, 1, 0, 1)),
    ((2, 2, 0, 0, 0), (3, 3, 0, 0, 0), (3, 0, 0, 1, 1), (48, 0, 0, 0, 1), (2, 0, 0, 1, 1), (66, 1, 0, 0, 1), (2, 0, 0, 1, 0), (4, 4, 0, 0, 0), (5, 5, 0, 0, 0), (4, 0, 0, 0, 0)),
    ((1, 1, 0, 0, 0), (3, 0, 0, 0, 0), (5, 0, 0, 1, 1), (27, 0, 0, 0, 1), (4, 0, 0, 0, 1), (33, 12, 0, 0, 1), (2, 0, 0, 1, 0), (3, 3, 0, 0, 0), (3, 0, 0, 0, 0)),
    ((6, 1, -1, 0, 0), (4, 0, -1, 1, 0), (70, 0, -1, 0, 0), (11, 0, 0, 1, 1), (38, 0, 0, 0, 1), (26, 1, 0, 0, 1), (9, 0, -1, 0, 0)),
)


def training_table() -> tuple[np.ndarray, np.ndarray]:
    rows, labels = [], []
    for page in PAGES:
        rows.append(features([Block("", w, linked, inside, heading) for w, linked, inside, heading, _ in page]))
        labels += [y for *_, y in page]
    return np.vstack(rows), np.array(labels)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6):
    """A decision tree by Gini impurity: a leaf is 0 or 1, a node (feature, threshold, at most, above)."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return int(share >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            n, m = left.sum(), len(y) - left.sum()
            p, q = y[left].mean(), y[~left].mean()
            impurity = n * p * (1 - p) + m * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, float(cut)
    if best is None:
        return int(share >= 0.5)
    _, f, cut = best
    left = x[:, f] <= cut
    return f, cut, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


def decide(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), bool(tree))
    f, cut, low, high = tree
    left = x[:, f] <= cut
    out = np.empty(len(x), bool)
    out[left], out[~left] = decide(low, x[left]), decide(high, x[~left])
    return out


def main_text(page: str | None, tree) -> tuple[str, int, int]:
    """Text of the article blocks joined by line breaks, blocks kept, blocks seen."""
    found = blocks(page or "")
    kept = decide(tree, features(found)) if found else []
    return "\n".join(b.text for b, k in zip(found, kept) if k), int(sum(kept)), len(found)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col``, with text, n_chars (code points), n_blocks and n_kept.

    NULL or empty html and pages without article blocks give an empty text; broken markup never fails. Repeated rows are
    rows of their own. Columns named like the new ones are replaced. An empty table gives no rows.
    """
    tree = grow(*training_table())
    made = ["text", "n_chars", "n_blocks", "n_kept"]
    kept = pages.drop(*(c for c in made if c != html_col))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != html_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [main_text(p, tree) for p in batch.pop(html_col)]
            batch["text"] = [t for t, _, _ in got]
            batch["n_chars"] = [len(t) for t, _, _ in got]
            batch["n_kept"] = [n for _, n, _ in got]
            batch["n_blocks"] = [n for _, _, n in got]
            yield batch

    tail = "text string, n_chars bigint, n_kept bigint, n_blocks bigint"
    return kept.mapInPandas(run, f"{schema}, {tail}" if schema else tail)


def query(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", F.col("html"))
    return extract(pages).select("page_id", "url", "text", "n_chars", "n_kept", "n_blocks")
