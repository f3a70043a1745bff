"""Main text of web pages by line-block distribution (operator 3).

Markup is stripped into lines, one for each block element. A line's length is
its text outside links, and nothing inside page furniture (menus, headers,
footers, sidebars, notices, adverts, forms, comments). Lengths are summed over
windows of ``WINDOW`` lines: text starts at a surge (a window above ``SURGE``
characters) and ends at the dive (windows of no text).

Where the page marks its main part (article, main), that weighs in: a line in it
counts a third of ``SURGE`` more, and a line outside an ``OUTSIDE``-th. Three
lines of a marked part in a row are a surge, one or two are one if they hold some
text. Furniture inside the marked part doesn't count as lines. Where a page's
densest window is below twice ``SURGE``, half of it is the surge, so that short
articles are found, marked or not; under ``SCANT`` characters there is none.

A class or id makes a block furniture if all words of one of its tokens are
furniture's (sidebar, cookie-banner, but not has-sidebar); html and body never
are. A main part inside such an element still is one, and counts as marked unless
the page marks another outside of furniture.

Defined results: null or empty html gives an empty text; pages without main
text give an empty text; an empty table gives an empty result. Unclosed and
cut-off markup is read as far as it goes: a tag with an unclosed quote ends at its
first ``>``. Very long pages are read whole, in one forward scan. Rows are
independent, so repeated rows give equal results. Extra columns pass through; a
column named as the result is replaced.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
SURGE = 86
BONUS = SURGE // 3
SCANT = 20
OUTSIDE = 8

#: Element names by role in HTML.
RAW = frozenset("script style noscript template svg math iframe object textarea select title canvas video audio".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form head header html main menu nav ol section table tbody td tfoot th thead tr ul".split())
FURNITURE = frozenset("nav header footer aside form menu head dialog button".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside side header masthead footer foot comment comments disqus reply replies respond related recommended share sharing social newsletter subscribe signup login search pagination pager toolbar widget copyright".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][A-Za-z0-9:-]*))")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_SPLIT = re.compile(r"[^A-Za-z]+")
_SPACE = re.compile(r"\s+")


NONE, NAMED, PLAIN = 0, 1, 2  # furniture: no, by a class or id, by its element or role


def _furniture(tag: str, attributes: str, inside_main: bool) -> int:
    if tag in ("html", "body"):
        return NONE
    if tag in FURNITURE and not (tag == "header" and inside_main):
        return PLAIN
    found = NONE
    for name, value in _NAMES.findall(attributes):
        tokens = [[w for w in _SPLIT.split(t) if w] for t in value.lower().strip("\"'").split()]
        if name.lower() == "role":
            if any(FURNITURE_ROLES.intersection(words) for words in tokens):
                return PLAIN
        elif any(words and FURNITURE_NAMES.issuperset(words) and not (tag == "header" and words == ["header"]) for words in tokens):
            found = NAMED
    return found


def _tag_end(page: str, at: int, unclosed: set[int]) -> int:
    """Where the tag ends whose attributes begin at ``at``; ``unclosed`` holds quotes known to leave a tag open, so that no stretch is read again for each tag."""
    p, quotes = at, []
    while True:
        m = _STOP.search(page, p)
        if m is None:
            return len(page)
        if m[0] == ">":
            return m.end()
        q = m.start()
        if q in unclosed:
            break
        quotes.append(q)
        e = page.find(m[0], q + 1)
        if e < 0:
            break
        p = e + 1
    unclosed.update(quotes)
    return page.find(">", at) + 1 or len(page)


def _tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, tag name or "", whether it closes, attributes) from the start to the end, in one forward scan."""
    at, unclosed = 0, set()
    while True:
        m = _OPEN.search(page, at)
        if m is None:
            yield page[at:], "", False, ""
            return
        text, tag = page[at : m.start()], (m[2] or "").lower()
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
        elif not tag:
            at = page.find(">", m.end()) + 1 or len(page)
        else:
            at = _tag_end(page, m.end(), unclosed)
        attributes = page[m.end() : at].removesuffix(">") if tag else ""
        if tag in RAW and not m[1]:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at, tag = len(page) if end is None else end.end(), ""
        elif tag in RAW:
            tag = ""
        yield text, tag, bool(m[1]), attributes


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """The page's block lines as (text, counted length, main).

    ``main`` is 2 in a main part marked in the open, 1 in one inside an element whose name alone makes it furniture, else 0.
    """
    lines: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked = link = 0
    stack: list[tuple[str, int, int]] = []  # name, furniture so far, main so far
    held: Counter[str] = Counter()  # names on the stack
    furniture = main = 0
    named = False  # the line's own block is furniture by its name

    def flush() -> None:
        nonlocal linked, named
        text = _SPACE.sub(" ", _html.unescape("".join(parts))).strip()
        if text:
            lines.append((text, 0 if furniture or named else max(len(text) - linked, 1 if main else 0), main))
        parts.clear()
        linked, named = 0, False

    for text, tag, closes, attributes in _tokens(page):
        if text:
            parts.append(text)
            if link:
                linked += len(text)
        if tag == "a":
            link = 0 if closes else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS or tag == "button":
            flush()
            if tag not in CONTAINERS and tag != "button":
                named = not closes and _furniture(tag, attributes, bool(main)) != NONE
            elif closes:
                if held[tag]:
                    while True:
                        name = stack.pop()[0]
                        held[name] -= 1
                        if name == tag:
                            break
                furniture, main = stack[-1][1:] if stack else (NONE, 0)
            else:
                if tag == "body" and held["head"]:
                    stack = [x for x in stack if x[0] != "head"]
                    held["head"] = 0
                    furniture, main = stack[-1][1:] if stack else (NONE, 0)
                is_main = tag in ("article", "main") or bool(re.search(r"\brole\s*=\s*[\"']?main\b", attributes, re.I))
                if is_main and not main:
                    if furniture != PLAIN:
                        furniture, main = NONE, 1 if furniture else 2
                elif not is_main or tag == "article":
                    furniture = max(furniture, _furniture(tag, attributes, bool(main)))
                if not attributes.rstrip().endswith("/"):
                    stack.append((tag, furniture, main))
                    held[tag] += 1
    flush()
    return lines


def block_sizes(lines: list[tuple[str, int, int]]) -> tuple[list[str], list[int]]:
    """The lines that windows run over and what each counts.

    On a page that marks its main part, a line in it counts ``BONUS`` more and
    one outside an ``OUTSIDE``-th. Furniture within the marked part is left out,
    so that it doesn't stand between two of its lines.
    """
    best = max((main for _, n, main in lines if n), default=0)
    kept = [(text, n, main) for text, n, main in lines if n or not (best and main == best)]
    inside = lambda n, main: best and main == best
    return [x[0] for x in kept], [n + BONUS if inside(n, main) else n // OUTSIDE if best == 2 or best and main else n for _, n, main in kept]


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text between surges and dives.

    A surge is a window of lines above ``surge``, or above half of the page's
    densest window where that is less, so that short articles have one too; a
    densest window under ``SCANT`` characters is too little for an article.
    """
    texts, sizes = block_sizes(lines_of(page or ""))
    sums = [0]
    for n in sizes:
        sums.append(sums[-1] + n)
    ahead = [sums[min(i + window, len(sizes))] - sums[i] for i in range(len(sizes))]
    densest = max(ahead, default=0)
    least = min(surge, densest // 2) if densest >= SCANT else surge
    kept, inside = [], False
    for i, text in enumerate(texts):
        if sizes[i] and ahead[i] > least:
            inside = True  # a surge
        if inside and sizes[i]:
            kept.append(text)
        if inside and not (ahead[i + 1] if i + 1 < len(texts) else 0):
            inside = False  # the dive
    return "\n".join(kept)


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the column ``into`` (replaced if it is there)."""
    pages = pages.drop(into) if into != html else pages
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([main_text(x) for x in b.column(html).to_pylist()], pa.string())
            keep = [i for i, n in enumerate(b.schema.names) if n != into]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], text], names=[*[b.schema.names[i] for i in keep], into])

    return pages.mapInArrow(run, f"{schema}, `{into}` string")


def op3(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
