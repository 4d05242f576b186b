"""Main text of web pages by the distribution of text over blocks of lines.

Markup goes first: block elements start a new line, inline ones leave no trace, and the content of elements that
are never part of an article (menus, forms, adverts, comments and so on, by element, role or class) counts as empty
lines, unless it is wrapped around the text itself. Text lengths are summed over sliding windows of lines. Main text begins where the sums leave nothing and go on
to surge above a threshold; where they dive to nothing, it ends. The lines between are kept, short ones included.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pieces

#: Lines per window; sum of characters outside links that makes a surge, or this share of the page's largest sum if that is less.
WINDOW_LINES = 3
SURGE_CHARS = 86
SURGE_SHARE = 0.25
#: Bytes of pages that a task works on at a time.
CHUNK = 4_000_000

#: Fixed values.
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select math canvas audio video".split())
SKIPPED = frozenset("nav footer aside button head dialog menu".split())
FORMS = frozenset("form fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
REMARKS = frozenset("comment comments commentlist disqus respond replies reply".split())
MARKS = REMARKS | frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead share sharing social related recommended newsletter subscribe subscription signup login search widget popup modal toolbar pagination pager".split())
#: Words that say nothing beside a mark; any other word beside it ("has-sidebar", "related-work") makes it another name.
NEUTRAL = frozenset("area bar block bottom box buttons center container content form global group header inner item items left links list main media outer page panel posts primary right secondary section site slot text thread top unit wrap wrapper".split())
MAIN = frozenset("article main".split())
#: An article or main element is the page's text if it holds this share of what is no boilerplate.
MAIN_SHARE = 0.25

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<([/!?]?)([a-zA-Z][^\s/>]*|)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD = re.compile(r"[A-Za-z0-9]+")


def _marked(names: str) -> set[str]:
    """The marks in a class or id: of names that are made of marks and neutral words only."""
    found = set()
    for name in names.split():
        words = set(_WORD.findall(name))
        if words & MARKS and words <= MARKS | NEUTRAL:
            found |= words & MARKS
    return found


def _boilerplate(name: str, attributes: str, inside_main: bool, holds_main: bool, most: bool) -> bool:
    """Whether an element is no part of an article. Classes, roles and forms decide only for elements that are not wrapped around the text itself."""
    if name in SKIPPED:
        return True
    wraps = (most or holds_main) and not inside_main
    if name in FORMS or name == "header":
        return not wraps and not (inside_main and name == "header")
    if not attributes.strip(" /") or name in ("html", "body"):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            marks = _marked(value)
            if name in MAIN and inside_main:
                marks &= REMARKS | {"advert", "ad"}
            # Readers may have written more than the author did.
            if marks & REMARKS or (marks and not wraps):
                return True
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return True
        elif key == "role" and value in ROLES and not wraps:
            return True
    return False


def _tokens(page: str) -> list[tuple[str, str, str]]:
    """The page as (kind, name, content): "text", "open" (content: attributes), "alone" (an element without content) and "close"."""
    out: list[tuple[str, str, str]] = []
    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if m is None:
            out.append(("text", "", page[at:]))
            break
        kind, name = m[1], (m[2] or "").lower()
        if name == "" and not m[0].startswith("<!") and kind != "?" and not (kind == "/" and m[0] != "</"):
            out.append(("text", "", page[at : m.start() + 1]))  # a lone "<" is text
            at = m.start() + 1
            continue
        if m.start() > at:
            out.append(("text", "", page[at : m.start()]))
        at = m.end()
        if not name or kind in ("!", "?"):
            continue
        if kind == "/":
            out.append(("close", name, ""))
        elif name in RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = close.end() if close else n
        else:
            out.append(("alone" if name in VOID or m[3].endswith("/") else "open", name, m[3]))
    return out


def _extents(tokens: list[tuple[str, str, str]]) -> tuple[dict[int, tuple[int, bool]], int]:
    """For each opening token how many characters of text its element holds and whether it holds an article or main; and the characters of the whole page."""
    size = mains = 0
    out: dict[int, tuple[int, bool]] = {}
    stack: list[tuple[str, int, int, int]] = []
    depth: dict[str, int] = {}

    def pop() -> str:
        name, k, before, others = stack.pop()
        depth[name] -= 1
        out[k] = (size - before, mains > others)
        return name

    for k, (kind, name, content) in enumerate(tokens):
        if kind == "text":
            size += len(content) - content.count(" ") if content.strip() else 0
        elif kind == "open":
            mains += name in MAIN
            stack.append((name, k, size, mains))
            depth[name] = depth.get(name, 0) + 1
        elif kind == "close" and depth.get(name):
            while pop() != name:
                pass
    while stack:
        pop()
    return out, size


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """The page's lines: text with character references decoded and white space single, characters of it inside links, and whether it lies in an article or main element."""
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = link_depth = main_depth = 0
    skip: list[str] = []  # names of open elements from the outermost skipped one on
    tokens = _tokens(page)
    extents, total = _extents(tokens)

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        lines.append((text, min(linked, len(text)), main_depth > 0))
        parts.clear()
        linked = 0

    for k, (kind, name, content) in enumerate(tokens):
        if kind == "text":
            if not skip:
                parts.append(content)
                if link_depth:
                    linked += len(" ".join(content.split()))
            continue
        if name in BLOCK:
            flush()
        if kind == "close":
            if name == "a":
                link_depth = max(link_depth - 1, 0)
            if name in MAIN and not (skip and name in skip):
                main_depth = max(main_depth - 1, 0)
            if skip:
                if name in skip:
                    while skip.pop() != name:
                        pass
                elif name in ("article", "main", "body", "html"):
                    skip.clear()  # what was left open ends with what it stands in
        elif kind == "open":
            if skip:
                if name not in ("p", "li", "option", "dt", "dd", "td", "th", "tr", "b", "i", "span", "a"):
                    skip.append(name)
            elif _boilerplate(name, content, main_depth > 0, extents[k][1], extents[k][0] * 2 > total):
                skip.append(name)
            else:
                main_depth += name in MAIN
                link_depth += name == "a"
    flush()
    return lines


def main_text(page: str | None, window: int = WINDOW_LINES, surge: int = SURGE_CHARS, share: float = SURGE_SHARE) -> str:
    """The text between the surges and dives of a page's line blocks; empty for a null or empty page or one without text."""
    lines = lines_of(page or "")
    within, whole = sum(len(text) for text, _, inside in lines if inside), sum(len(text) for text, *_ in lines)
    if within and within >= MAIN_SHARE * whole:
        lines = [(text, linked, inside) if inside else ("", 0, inside) for text, linked, inside in lines]
    # A run of empty lines within the article (nested tags) weighs as one, so that tag depth makes no gaps; a change of region keeps its gap.
    held: list[tuple[str, int]] = []
    gap = 0
    for text, linked, inside in lines:
        if text:
            held += [("", 0)] * (min(gap, 1) if inside else min(gap // 2, window + 1))
            # Within an article links are text too; elsewhere they are mostly navigation.
            held.append((text, len(text) - (0 if inside else linked)))
            gap = 0
        else:
            gap += 1
    own = [n for _, n in held]
    sums = [sum(own[i : i + window]) for i in range(len(own))]
    least = min(surge, share * max(sums, default=0))
    out: list[str] = []
    i = 0
    while i < len(sums):
        start = i
        while i < len(sums) and sums[i]:
            i += 1
        if i > start and max(sums[start:i]) >= least:
            out += [text for text, _ in held[start:i] if text]
        i += 1
    return " ".join(out)


def extracted(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` without its column ``html``, with ``text`` and ``n_chars`` (replaced if present).

    Each row stands alone, nothing is shuffled: repeated rows give repeated results, null and empty pages the empty
    text, and an empty table an empty one. Pages of any length are read whole; other columns pass through.
    """
    kept = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    given = pages.select(*(f"`{c}`" for c in kept), pages[f"`{column}`"].alias("__html"))

    def work(batches):
        for batch in pieces(batches, "__html", CHUNK):
            texts = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*kept, "text", "n_chars"])

    return given.mapInArrow(work, ", ".join([*(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in kept), "text string, n_chars bigint"]))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


#: DuckDB, for pages with one article element of paragraphs: what stands in it, tags that break lines as spaces. Entities: those that such pages have.
OP4_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS raw FROM a),
d AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM t)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""
