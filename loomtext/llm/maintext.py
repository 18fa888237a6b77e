"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one per block of the page. A line weighs as many characters as it has outside of
links; what stands in menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments is one line without weight, and where a page declares its article, so is what stands outside of it.
Weights are summed over sliding windows of lines. Text surges where the sums leave zero and dives where they
fall back to it; the text between a surge and its dive is kept if it is an article's: in a declared article
always, else if it weighs at least a fifth of the heaviest stretch.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.common import tidy

WINDOW = 3
LEAST_SHARE = 0.2
BATCH_ROWS = 500

# Elements of HTML by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
SPACES = frozenset("br td th option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FRAME = frozenset("html body main".split())
DROPPED = frozenset("aside button canvas dialog footer form head header menu nav noscript object script search select style svg template".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay "
    "newsletter subscribe signup login sidebar navbar nav navigation menu breadcrumb breadcrumbs footer masthead topbar comment comments disqus respond "
    "replies share sharing social related recommended recommendations pagination pager copyright".split()
)
BEFORE_NAME = frozenset("with without no has hide".split())
CONTENT = frozenset("article content entry main post story".split())
#: An open element of the second kind ends where one of the first begins.
ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "option": "option"}

#: A quoted value may hold ">" if its quote closes within 5,000 characters.
TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]{0,5000}+"|'[^']{0,5000}+')*+(?=>)|[^>]*+)>|!--|[!?])""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|href|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(raw)} if "=" in raw or "hidden" in raw.lower() else {}


def _parts(found: dict[str, str]) -> list[list[str]]:
    return [[p.lower() for p in NAME_PARTS.findall(name)] for key in ("class", "id") for name in found.get(key, "").split()]


def _unwanted(tag: str, found: dict[str, str], in_article: bool) -> bool:
    """Whether an element holds no text of the article."""
    if tag in FRAME:
        return False
    if tag in DROPPED and not (tag == "header" and in_article):
        return True
    if not found:
        return False
    if found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    if tag in HEADINGS:
        return False
    for parts in _parts(found):
        if not BEFORE_NAME.isdisjoint(parts[:-1]):
            continue
        if not NAMES.isdisjoint(parts) or parts[-1:] == ["header"] and not in_article and CONTENT.isdisjoint(parts):
            return True
    return False


class _Lines:
    """Lines of a page: text, weight and level (3 in an article, 2 in the main part, 1 in a part named content)."""

    def __init__(self):
        self.lines: list[tuple[str | None, int, int]] = []
        self.now: list[str] = []
        self.linked = 0

    def cut(self, level: int) -> None:
        if self.now:
            text = " ".join(html.unescape("".join(self.now)).split())
            if text:
                weight = max(0, sum(map(len, text.split())) - self.linked)
                self.lines.append((text, 0 if RIGHTS.match(text) and len(text) < 200 else weight, level))
            self.now = []
        self.linked = 0

    def gap(self) -> None:
        self.lines.append((None, 0, 0))


def lines_of(page: str) -> list[tuple[str | None, int, int]]:
    """The lines of a page in order; what is unwanted is a line without text."""
    out, stack, open_tags = _Lines(), [], Counter()
    lower: str | None = None
    closed: dict[str, int] = {}  # where an element's last end tag is
    levels, dropping, link, at = Counter(), 0, False, 0
    last = page.rfind(">") + 1  # no tag ends after it
    if (cut := page.find("<!--", last)) >= 0:
        page = page[:cut]

    def level() -> int:
        return max((k for k in levels if levels[k]), default=0)

    def pop() -> None:
        nonlocal dropping
        tag, drops, kind = stack.pop()
        open_tags[tag] -= 1
        if kind:
            out.cut(level())
            levels[kind] -= 1
        if drops:
            dropping -= 1
            if not dropping:
                out.gap()

    def text(upto: int) -> None:
        if upto > at and not dropping:
            raw = page[at:upto]
            out.now.append(raw)
            if link:
                out.linked += sum(map(len, html.unescape(raw).split()))

    found = TAG.search(page, 0, last)
    while found:
        text(found.start())
        tag, at = (found[2] or "").lower(), found.end()
        if not tag:  # a comment, a declaration or an instruction
            end = page.find("-->", at) if found[0] == "<!--" else page.find(">", at)
            at = len(page) if end < 0 else end + (3 if found[0] == "<!--" else 1)
        elif found[1]:
            if tag in BLOCKS and not dropping:
                out.cut(level())
            elif tag in SPACES and not dropping:
                out.now.append(" ")
            if tag == "a":
                link = False
            if open_tags[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag in RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{tag}", at)
            at = len(page) if end < 0 else end
        else:
            attributes = _attributes(found[3]) if found[3] else {}
            if tag in BLOCKS:
                if not dropping:
                    out.cut(level())
                while open_tags["p"] and stack[-1][0] not in BLOCKS:
                    pop()
                if stack and stack[-1][0] == "p":  # a block ends the paragraph before it
                    pop()
            if (ends := ENDS.get(tag)) and stack and stack[-1][0] in ends.split():
                pop()
            if tag in SPACES and not dropping:
                out.now.append(" ")
            if tag == "a":
                link = "href" in attributes
            if tag in VOID:
                found = TAG.search(page, at, last)
                continue
            drops = _unwanted(tag, attributes, levels[3] > 0)
            if drops:
                if tag not in closed:
                    lower = page.lower() if lower is None else lower
                    closed[tag] = lower.rfind(f"</{tag}")
                drops = closed[tag] >= at or tag in ("p", "li")  # what is never closed drops nothing
            kind = 0
            if not drops and not dropping:
                role = attributes.get("role", "").lower()
                if tag == "article" or role == "article":
                    kind = 3
                elif tag == "main" or role == "main":
                    kind = 2
                elif tag in ("div", "section", "td") and any(not CONTENT.isdisjoint(p) for p in _parts(attributes)):
                    kind = 1
            if drops or tag in BLOCKS:
                if drops and not dropping:
                    out.cut(level())
                dropping += drops
                levels[kind] += bool(kind)
                stack.append((tag, drops, kind))
                open_tags[tag] += 1
        found = TAG.search(page, at, last)
    text(len(page))
    out.cut(level())
    return out.lines


def stretches(weights: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """First and last line of every stretch between a surge and a dive of the window sums."""
    found: list[tuple[int, int]] = []
    total = sum(weights[:window])
    first = 0 if total else None
    for i in range(1, len(weights) + 1):
        before, total = total, total - weights[i - 1] + (weights[i + window - 1] if i + window - 1 < len(weights) else 0)
        if total and not before:
            first = i
        elif before and not total:
            found.append((first, i - 1))
    return [(next(k for k in range(a, b + 1) if weights[k]), b) for a, b in found]


def main_text(page: str | None) -> str:
    """The article's blocks, one a line; null counts as empty."""
    lines = lines_of(page or "")
    mass = Counter()
    for text, weight, level in lines:
        if text is not None:
            mass[level] += weight
    best = max((k for k in mass if mass[k]), default=0)
    if best == 3 and mass[3] < LEAST_SHARE * (mass[3] + mass[2]):
        best = 2
    inside = [text is not None and level >= best for text, _, level in lines]
    declared = best >= 2
    weights = [max(w, 1) if declared and i else w if i else 0 for (_, w, _), i in zip(lines, inside)]
    found = stretches(weights)
    sums = [sum(weights[a : b + 1]) for a, b in found]
    least = 0 if declared else LEAST_SHARE * max(sums, default=0)
    return "\n".join(lines[k][0] for (a, b), s in zip(found, sums) if s >= least for k in range(a, b + 1) if inside[k])


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """Columns ``keep``, text and n_chars (code points) of every page.

    Null and empty pages, and pages without an article, give an empty text. Repeated rows stay repeated; ties do
    not occur. A page of any length is read whole, in one pass. Unclosed markup never swallows an article: an
    unwanted element counts only if it is closed later. An empty table gives an empty one; only the named
    columns are read, so others cannot clash.
    """

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(i, BATCH_ROWS)
                texts = [main_text(x.as_py()) for x in part.column(len(keep))]
                out = [*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=names)

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    schema = T.StructType([*pages.select(*keep).schema.fields, *fields])
    names = schema.fieldNames()
    return pages.select(*keep, F.col(html_col).alias("_html")).mapInArrow(run, schema)
