"""HTML main-text extraction.

The page streams through the standard library's parser. Its events become *lines*: one per block element, with the
characters of text, those inside links, the number of tags, the innermost container and the element around it that is named like furniture. What
is furniture by its element or role (menus, the page's header and footer, asides, forms, dialogs, scripts, styles, hidden parts) gives no lines.

Class names and ids are evidence, taken as whole names: ``sidebar``, ``site-header`` and ``ad-slot`` mark furniture, ``with-sidebar``, ``no-comments``
and ``search-engine-guide`` do not, and headings are never marked. So are ``form``, ``aside`` and ``menu``. What is marked goes unless it holds the page's text: more than
the lines beside it, and ``BULK`` times as much as the paragraphs beside it; a form must also hold ``PER_INPUT`` characters for each of its inputs. Reader comments stay only when there is nothing beside them. Inside an
``article`` or ``main`` some words (``WEAK``: a section called menu, header or related) mark only what consists of links. Marks inside marks are judged against what is beside them there.

Each line has a text-to-tag ratio (text outside links per tag). The ratios are smoothed along the page by a Gaussian
kernel, so that a short paragraph among long ones stays, and lines are parted into content and rest by a two-means threshold on the smoothed
ratios. The *content region* is the container that holds most of the content lines' text: the ``article`` or ``main`` element with
most of it, where the page has one (if that is an article, all articles beside it with a tenth of its text, not mostly links, belong to it), else the innermost container with at least half of it. All lines in the region are the text; where the page has neither element,
lines outside the content cluster go if at least half of them is links, or if a copyright line follows the last content line. Nothing else is dropped.

Defined cases. Long pages and deep nesting cost time in proportion. Null, empty and text-free pages: empty text, 0 characters. Unclosed and stray tags are read as browsers read them, roughly; ``br`` is
white space. Null page_id or url: kept as they are. Repeated rows are returned each. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import common as C

RESULT = "page_id long, url string, text string, n_chars long"

# Element names of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style noscript template iframe object svg math canvas audio video select textarea button datalist title map".split())
FURNITURE = frozenset("nav footer dialog".split())
MARKED = frozenset("aside form menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INPUTS = frozenset("input select textarea button".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CONTAINERS = frozenset("article body div main section td center blockquote html".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article body div main section html aside nav footer header form blockquote".split())
# Words of class, id and role attributes that name furniture, by themselves or as the last part of a compound (site-header).
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar toc "
    "sidebar widget widgets related recommended recommendations trending "
    "footer header masthead topbar copyright colophon contentinfo complementary "
    "cookie cookies consent gdpr notice notices popup modal overlay paywall "
    "newsletter subscribe subscription signup login search share sharing social "
    "comment comments commentlist disqus replies respond reviews".split()
)
#: Those that inside an article need links to be furniture.
WEAK_MARKS = frozenset("banner footer header masthead menu recommended recommendations related toc trending".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond reviews".split())
# Last parts of compounds whose first part then counts (comment-list, ad-slot), and first parts that say something else (no-comments).
HOLDERS = frozenset("area banner bar block box button buttons column container form holder icons inner item items links list panel posts section slot thread unit widget wrap wrapper".split())
DENIALS = frozenset("no not with without has hide show is enable disable main".split())
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")
_COPYRIGHT = re.compile(r"\s*(©|\(c\)\s|copyright\b)", re.IGNORECASE)
#: How an element is marked: not at all, by a name inside the article, by a name or as an aside, as a form, as reader comments, or as furniture by what it is.
FREE, WEAK, NAMED, FORM, COMMENT, ROLE = range(6)
#: A line of so many characters outside links is a paragraph; what is marked needs so many times the paragraphs beside it; and a form so many characters for each input.
PARAGRAPH, BULK, PER_INPUT = 60, 8, 60


def _name_mark(name: str, inside_main: bool) -> int:
    """What a whole class name, id or role says; ``name`` is one of them, not one of its parts."""
    parts = [p.lower() for p in _PART.findall(name)]
    if not parts or len(parts) > 1 and parts[0] in DENIALS:
        return FREE
    word = parts[-1] if parts[-1] in MARKS else parts[0] if parts[-1] in HOLDERS else ""
    return COMMENT if word in COMMENTS else WEAK if inside_main and word in WEAK_MARKS else NAMED if word in MARKS else FREE


def _mark(tag: str, attrs, inside_main: bool) -> int:
    if tag in FURNITURE or tag in SILENT:
        return ROLE
    if tag == "header":
        return FREE if inside_main else ROLE
    if tag in ("html", "body", "main"):
        return FREE
    out = FORM if tag == "form" else NAMED if tag in MARKED else FREE
    for k, v in attrs:
        if k == "hidden" or k == "aria-hidden" and v == "true" or k == "role" and v in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"):
            return ROLE
        if k in ("class", "id") and v and tag not in HEADINGS:
            out = max([out, *(_name_mark(x, inside_main) for x in v.split())])
    return FREE if tag == "article" and out != COMMENT and not inside_main else out


class _Lines(HTMLParser):
    """Parser events to lines; ``stack`` holds (tag, silent or furniture, container, named element). All steps but the ends of tags cost the same at any depth."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, int]] = []
        self.open: Counter[str] = Counter()
        self.parents: list[int] = [-1]
        self.kinds: list[str] = ["#root"]
        self.marks: list[tuple[int, int]] = []  # of marked elements: how, and the marked element around it or -1
        self.inputs: Counter[int] = Counter()  # by marked element
        self.text: list[str] = []
        self.links = self.tags = 0
        self.lines: list[tuple[str, int, int, int, int]] = []  # text, link characters, tags, container, named element or -1; without what is furniture by its role

    def _off(self) -> bool:
        return bool(self.stack) and self.stack[-1][1]

    def flush(self) -> None:
        if self.text:
            t = _SPACE.sub(" ", "".join(self.text)).strip()
            if t:
                _, _, box, named = self.stack[-1] if self.stack else ("", False, 0, -1)
                self.lines.append((t, self.links, self.tags, box, named))
            self.text = []
            self.links = self.tags = 0

    def handle_starttag(self, tag, attrs) -> None:
        if tag == "br" or tag == "wbr":
            if tag == "br" and not self._off():
                self.text.append(" ")
            return
        if tag in BLOCKS:
            self.flush()
            self._imply(tag)
        self.tags += 1
        if tag in INPUTS and self.stack and dict(attrs).get("type") != "hidden":
            self.inputs[self.stack[-1][3]] += 1
        if tag in VOID:
            return
        _, off, box, named = self.stack[-1] if self.stack else ("", False, 0, -1)
        mark = _mark(tag, attrs, self.open["article"] + self.open["main"] > 0)
        if FREE < mark < ROLE:
            self.marks.append((mark, named))
            named = len(self.marks) - 1
        if tag in CONTAINERS:
            self.parents.append(box)
            role = next((v for k, v in attrs if k == "role"), None)
            self.kinds.append("main" if role == "main" else tag)
            box = len(self.parents) - 1
        self.stack.append((tag, off or mark == ROLE, box, named))
        self.open[tag] += 1

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes void elements only

    def _imply(self, tag: str) -> None:
        """A block ends an open paragraph, a list item the one before it, and so on."""
        closes = (*CLOSES.get(tag, ()), "p")
        if not any(self.open[c] for c in closes):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name in closes:
                self._pop(k)
                return
            if name in SCOPES:
                return

    def _pop(self, k: int) -> None:
        for name, *_ in self.stack[k:]:
            self.open[name] -= 1
        del self.stack[k:]

    def handle_endtag(self, tag) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._pop(k)
                return
            if tag not in BLOCKS and self.stack[k][0] in SCOPES:
                return

    def handle_data(self, data) -> None:
        if not self._off():
            self.text.append(data)
            if self.open["a"]:
                self.links += len(data.strip())


def smoothed(ratios: np.ndarray, radius: int = 2) -> np.ndarray:
    """Convolution with a Gaussian of standard deviation ``radius`` / sqrt(2); its weights are renormalised at the edges."""
    x = np.arange(-radius, radius + 1)
    kernel = np.exp(-(x**2) / max(radius, 1) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel, "same") if len(ratios) >= len(kernel) else None
    if weight is None:  # fewer lines than the kernel is wide
        d = np.subtract.outer(np.arange(len(ratios)), np.arange(len(ratios)))
        k = np.exp(-(d**2) / max(radius, 1) ** 2) * (abs(d) <= radius)
        return k @ ratios / k.sum(axis=1)
    return np.convolve(ratios, kernel, "same") / weight


def content_lines(ratios: np.ndarray) -> np.ndarray:
    """Two-means clustering of the smoothed ratios: true for the cluster with the higher ones (all, if they do not differ)."""
    s = smoothed(ratios)
    low, high = s.min(), s.max()
    for _ in range(20):
        near = s >= (low + high) / 2
        if near.all():
            return near
        low, high = s[~near].mean(), s[near].mean()
    return near


def _plain(line: tuple) -> int:
    """Characters outside links."""
    return max(len(line[0]) - line[1], 0)


def _kept(parser: _Lines) -> dict[int, bool]:
    """Of each marked element, whether it stays; -1 is the page without any. Inner ones have higher numbers."""
    own, total, paragraphs, whole, inputs = Counter(), Counter(), Counter(), Counter(), parser.inputs.copy()
    for x in parser.lines:
        own[x[4]] += _plain(x)
        total[x[4]] += _plain(x)
        whole[x[4]] += len(x[0])
        paragraphs[x[4]] += _plain(x) if _plain(x) >= PARAGRAPH else 0
    for k in range(len(parser.marks) - 1, -1, -1):
        around = parser.marks[k][1]
        total[around] += total[k]
        whole[around] += whole[k]
        inputs[around] += inputs[k]
    kept = {-1: True}
    for k, (mark, around) in enumerate(parser.marks):
        bulk = total[k] > (BULK * paragraphs[around] or own[around])
        if mark == WEAK:
            stays = 2 * total[k] >= whole[k]
        elif mark == COMMENT:
            stays = own[around] == 0
        else:
            stays = bulk and (mark != FORM or total[k] >= PER_INPUT * inputs[k])
        kept[k] = kept[around] and stays
    return kept


def extract(html: str | None) -> str:
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines, parents, kinds = parser.lines, parser.parents, parser.kinds
    kept = _kept(parser)
    lines = [x for x in lines if kept[x[4]]]
    if not lines:
        return ""
    content = content_lines(np.array([_plain(x) / max(x[2], 1) for x in lines]))
    weight, whole = [0] * len(parents), [0] * len(parents)
    for x, good in zip(lines, content):
        weight[x[3]] += _plain(x) if good else 0
        whole[x[3]] += len(x[0])
    for box in range(len(parents) - 1, 0, -1):  # inner containers have higher numbers
        weight[parents[box]] += weight[box]
        whole[parents[box]] += whole[box]
    boxes = [b for b in range(len(parents)) if kinds[b] in ("article", "main") and whole[b]]
    if boxes:
        best = max(boxes, key=lambda b: (weight[b], whole[b], b))
        regions = {best}
        if kinds[best] == "article":
            plain = [0] * len(parents)
            for x in lines:
                plain[x[3]] += _plain(x)
            for box in range(len(parents) - 1, 0, -1):
                plain[parents[box]] += plain[box]
            regions |= {b for b in boxes if kinds[b] == "article" and 10 * plain[b] >= plain[best] and 2 * plain[b] >= whole[b]}
    else:
        regions = {max(b for b in range(len(parents)) if 2 * weight[b] >= weight[0])}
    inside = [False] * len(parents)
    for box in range(min(regions), len(parents)):
        inside[box] = box in regions or inside[parents[box]]
    good = np.flatnonzero(content)
    last = int(good[-1]) if len(good) else len(lines)
    out = []
    for k, (x, is_content) in enumerate(zip(lines, content)):
        if not inside[x[3]]:
            continue
        if not boxes and not is_content and (2 * x[1] >= len(x[0]) or k > last and _COPYRIGHT.match(x[0])):
            continue  # a menu, or the page's footer, in a page that names neither
        out.append(x[0])
    return "\n".join(out)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), 500):
                part = batch.iloc[s : s + 500]
                text = [extract(h) if isinstance(h, str) else "" for h in part["html"]]
                yield pd.DataFrame({"page_id": part["page_id"].astype("Int64").array, "url": part["url"].array, "text": text, "n_chars": [len(t) for t in text]})

    C.small_batches(pages.sparkSession)
    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInPandas(run, RESULT)
