"""Main-text extraction by tag-path ratios.

A page is read as a sequence of blocks, each with its root-to-leaf tag path.
Per path, text length, punctuation and link text are summed over its blocks and
divided by their number; a path is smoothed with the subtrees around it; the
ratios and what the path's names say about it (article and main among them) are
fused into one score per path, and on every page a threshold on the scores
selects the content paths.

Defined results: a null or empty page, or one without content, gives an empty
text; unclosed elements end where their parent does; markup cut off at the end
of the page is dropped; character references that cannot be decoded stay as
written. The whole page is read; other columns are kept as they are.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import read

# Element kinds of the HTML standard, and names that mark a part of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu
    nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul""".split())
NEVER = frozenset("""head script style noscript template nav footer aside form button select textarea iframe object svg
    canvas dialog menu title xmp noembed noframes search""".split())
PARTS = frozenset("""ad ads adv advert adverts advertisement advertisements advertising banner banners sponsor sponsored
    promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer header
    masthead cookie cookies consent gdpr notice notices alert alerts popup modal overlay comment comments disqus reply
    replies respond share sharing social related recommended newsletter subscribe signup login widget widgets toolbar
    pagination pager skip""".split())
PART_PREFIXES = ("comment", "advert", "sponsor", "cookie", "newsletter", "breadcrumb", "sidebar")
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
CONTENT = frozenset("article main".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
SCOPES = frozenset("ul ol dl table select html body".split())

MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s>/]*+)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
                    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s>/]*+)(?P<attrs2>[^>]*)>"
                    r"|</?[a-zA-Z][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"(?i)(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¿¡]")

THRESHOLD = 0.1
"""Paths with this share of the best score are content."""
MARKED = {"article": 16.0, "main": 6.0}
"""Factors of paths below the elements that mark content; the greatest counts once."""
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption summary address center".split())
PLAIN = 0.2
"""Factor of text that stands in no element for text, such as directly in a div."""


NAMED = 0.02
"""Factor of paths in elements whose class or id names a part of a page."""
MODIFIERS = frozenset("has no with without hide show".split())
MOST = (0.5, 0.8)
"""Share of the page's scored text from which a name does not count: of elements that hold an article or main, of others."""


class Block:
    """A run of text between two block boundaries, the numbers of the named elements around it, and of
    those around its outermost article (or main, where there is none)."""

    __slots__ = ("path", "part", "text", "links", "named", "outer")

    def __init__(self, path: tuple, part: bool, text: str, links: int, named: tuple, outer: tuple):
        self.path, self.part, self.text, self.links, self.named, self.outer = path, part, text, links, named, outer


def _is_part(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element is no content whatever it holds: a menu, footer, form, hidden and the like. inside: of an article."""
    if tag in NEVER or tag == "header" and not inside:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
    return False


def _is_named(tag: str, attrs: str, inside: bool) -> bool:
    """Whether a class or id of an element names a part of a page (no-sidebar and has-sidebar do not)."""
    if not attrs or tag in ("html", "body") or tag in CONTENT:
        return False
    for name, value in ATTRIBUTE.findall(attrs):
        if name.lower() in ("class", "id"):
            before = ""
            for w in map(str.lower, WORDS.findall(value)):
                if (w in PARTS or w.startswith(PART_PREFIXES)) and before not in MODIFIERS and not (inside and w == "header"):
                    return True
                before = w
    return False


def _outer(stack: list[tuple]) -> tuple:
    """The named elements around the outermost article, or main, of a stack of open elements."""
    for tag in ("article", "main"):
        for s in stack:
            if s[0] == tag:
                return s[3]
    return ()


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with their tag paths."""
    out: list[Block] = []
    stack: list[tuple] = []          # (tag, is a part, is content, numbers of the named elements around)
    elements = 0
    run: list[str] = []
    links = 0

    def flush():
        nonlocal links
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            names = tuple(s[0] for s in stack if s[0] in BLOCKS)
            out.append(Block(names, bool(stack) and stack[-1][1], text, links, stack[-1][3] if stack else (), _outer(stack)))
        run.clear()
        links = 0

    def close_to(k: int):
        if any(s[0] in BLOCKS for s in stack[k:]):
            flush()
        del stack[k:]

    at, length = 0, len(page)
    while at < length:
        m = MARKUP.search(page, at)
        text = page[at:m.start() if m else length]
        if text:
            block = next((s for s in reversed(stack) if s[0] in BLOCKS), None)
            if stack and stack[-1][0] not in BLOCKS and (stack[-1][1] or stack[-1][3] != (block[3] if block else ())):
                pass                                   # inline element that is no content, such as a hidden span
            else:
                run.append(text)
                if any(s[0] == "a" for s in stack):
                    links += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if m["end"] or m["end2"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close_to(k)
                    break
                if stack[k][0] in SCOPES and tag not in BLOCKS:
                    break
            else:
                if tag in BLOCKS:
                    flush()
            continue
        if tag in BLOCKS:
            flush()
            for k in range(len(stack) - 1, -1, -1):      # elements whose end tag may be left out
                if stack[k][0] == "p" or stack[k][0] in CLOSED_BY.get(tag, ()):
                    close_to(k)
                elif stack[k][0] in SCOPES or stack[k][0] in BLOCKS and stack[k][0] not in ("p", "td", "th", "tr", "li"):
                    break
        elif tag == "br":
            run.append(" ")
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else length
            continue
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
            continue
        inside = any(s[2] for s in stack)
        part = bool(stack) and stack[-1][1] or _is_part(tag, attrs, inside)
        content = tag in CONTENT or 'role="main"' in attrs
        named = stack[-1][3] if stack else ()
        if not part and _is_named(tag, attrs, inside):
            elements += 1
            named = (*named, elements)
        stack.append((tag, part, content, named))
    flush()
    return out


def name_factor(path: tuple) -> float:
    """What the element names of a path say of its text."""
    marked = max((MARKED[t] for t in path if t in MARKED), default=1.0)
    return marked * (1.0 if path and path[-1] in TEXTUAL else PLAIN)


def path_scores(found: list[Block]) -> dict[tuple, float]:
    """The fused score of each path.

    A path's ratio is its text and punctuation per block (in logarithms), less link
    text. It is smoothed with the mean ratios of the subtrees it lies in, each half
    the weight of the one inside it, and multiplied by what the names say."""
    n, size, marks, links = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for b in found:
        if not b.part:
            n[b.path] += 1
            size[b.path] += len(b.text)
            marks[b.path] += len(PUNCTUATION.findall(b.text))
            links[b.path] += min(b.links, len(b.text))
    ratio = {p: math.log1p(size[p] / n[p]) * (1 + math.log1p(marks[p] / n[p])) * (1 - links[p] / size[p]) ** 2 for p in n}
    total, of = defaultdict(float), defaultdict(int)
    for p in n:
        for k in range(len(p)):
            total[p[:k]] += ratio[p] * size[p]
            of[p[:k]] += size[p]
    scores = {}
    for p in n:
        around, weight = 0.0, 0.0
        for k in range(len(p)):
            w = 0.5 ** (len(p) - k)
            around += w * total[p[:k]] / of[p[:k]]
            weight += w
        scores[p] = (ratio[p] * (around / weight if weight else ratio[p])) ** 0.5 * name_factor(p)
    return scores


def named_parts(found: list[Block], scores: dict[tuple, float]) -> set[int]:
    """The named elements whose name counts: those that do not hold most of the page's scored text."""
    weight, whole, holds = defaultdict(float), 0.0, set()
    for b in found:
        w = scores[b.path] * len(b.text)
        whole += w
        for e in b.named:
            weight[e] += w
        holds.update(b.outer)
    return {e for e in weight if weight[e] < MOST[e not in holds] * whole}


def main_text(page: str | None) -> str:
    """The main text of one page, one block per line."""
    found = [b for b in blocks(page or "") if not b.part]
    scores = path_scores(found)
    counted = named_parts(found, scores) if any(b.named for b in found) else set()
    if counted:
        # text of parts has paths of its own and does not count in the others' ratios
        apart = [any(e in counted for e in b.named) for b in found]
        of = [path_scores([b for b, a in zip(found, apart) if a == side]) for side in (False, True)]
        each = [of[a][b.path] * (NAMED if a else 1.0) for b, a in zip(found, apart)]
    else:
        each = [scores[b.path] for b in found]
    best = max(each, default=0.0)
    return "\n".join(b.text for b, score in zip(found, each) if score >= THRESHOLD * best)


@F.pandas_udf(StringType())
def _main_text(pages: pd.Series) -> pd.Series:
    return pages.map(main_text, na_action=None)


def extracted(html_col: str | Column) -> Column:
    """The main text of a page as a column."""
    return _main_text(F.coalesce((F.col(html_col) if isinstance(html_col, str) else html_col).cast("string"), F.lit("")))


def extract_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text added as (or replacing) ``out_col``."""
    return pages.withColumn(out_col, extracted(html_col))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
