"""HTML extraction by line-block distribution.

Markup is stripped so that each block of a page becomes one line; elements that are
never text (menus, forms, adverts) leave a gap.  Between gaps, sums of unlinked text
over a sliding window of lines say where text is: it dives where a window has none, as
in a list of links, and surges where the windows without text end.  What lies between
is kept, inside an ``article`` or ``main`` element as outside.  On pages without one,
each stretch is also judged by its share of text in links, and loses links at its ends.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines in a window: so many without unlinked text are a menu, fewer are text.
WINDOW = 3
#: Outside an article element: most share of a stretch's text in links.
MAX_LINKS = 0.5

# Element names of the HTML standard by their role, and the words
# in class, id and role attributes that mark boilerplate.
_RAW = "script style textarea title noscript template iframe xmp noembed noframes svg math object canvas".split()
_REMOVED = frozenset("head nav header footer aside button select menu dialog datalist fieldset audio video map".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
_WRAPPERS = frozenset("html body main article".split())
_MARKED = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended comment comments "
    "reply replies disqus pagination pager toolbar widget copyright legal disclaimer skip complementary contentinfo "
    "ad-banner ad-box ad-container ad-slot cookie-notice cookie-banner cookie-consent site-header site-footer page-footer site-nav main-nav main-menu side-bar comment-list comment-section "
    "comments-section comments-area reader-comments newsletter-signup share-buttons social-share related-posts related-articles related-links skip-link".split()
)
_CLOSES_P = frozenset("p div ul ol li dl dt dd table tr td th h1 h2 h3 h4 h5 h6 section article main aside nav header footer form blockquote pre hr body html".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>" + "|".join(_RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?/][^>]*>",
    re.S | re.I,
)
_MARKS = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:\s|^)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_TEXT = re.compile(r"[^\W_]")


def _boilerplate(name: str, attributes: str) -> bool:
    if name in _REMOVED:
        return True
    if name in _WRAPPERS or not attributes:
        return False
    marks = {w for m in _MARKS.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()}
    return bool(marks & _MARKED) or bool(_HIDDEN.search(attributes))


@dataclass
class Line:
    #: empty: a gap, where an element was left out
    text: str
    #: characters outside and inside of links
    plain: int = 0
    linked: int = 0
    article: bool = False
    form: bool = False


def page_lines(page: str) -> list[Line]:
    """The page's blocks in order; each removed element leaves a gap."""
    lines: list[Line] = []
    parts: list[str] = []
    plain = linked = articles = links = forms = 0
    removed, depth = "", 0  # the element that is being left out, and its nesting

    def end_line() -> None:
        nonlocal plain, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            lines.append(Line(text, plain, linked, articles > 0, forms > 0))
        parts.clear()
        plain = linked = 0

    def text_run(text: str) -> None:
        nonlocal plain, linked
        if text and not removed:
            parts.append(text)
            if links:
                linked += len(text)
            elif _TEXT.search(html.unescape(text)):
                plain += len(text)

    at = 0
    for m in _MARKUP.finditer(page):
        text_run(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:  # comments, declarations, and raw elements with all they hold
            continue
        closing = bool(m["close"])
        if removed:
            if name in ("article", "main") or name == "body" or closing and name == "html":
                removed = ""  # an element that is never closed ends here
            elif removed in ("p", "li", "dt", "dd") and not closing and name in _CLOSES_P:
                removed = ""
            elif name == removed and not m[0].endswith("/>"):
                depth += -1 if closing else 1
                if not depth:
                    removed = ""
                continue
            if removed:
                continue
        if not closing and name not in _VOID and _boilerplate(name, m["attributes"]):
            if name not in _INLINE:
                end_line()
                lines.append(Line("", article=articles > 0))
            if not m[0].endswith("/>"):
                removed, depth = name, 1
            continue
        if name == "a":
            links = 0 if closing else 1
        if name not in _INLINE:
            end_line()
            if name in ("article", "main"):
                articles = max(0, articles + (-1 if closing else 1))
            elif name == "form":
                forms = max(0, forms + (-1 if closing else 1))
    text_run(page[at:])
    end_line()
    return lines


def stretches(plain: np.ndarray, gap: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """[surge, dive) pairs of lines: text dives at a gap, and at the first line of a window
    whose sum of ``plain`` is 0; it surges behind a gap, and behind the last such window."""
    n = len(plain)
    total = np.concatenate([[0], np.cumsum(plain)])
    gaps = np.concatenate([[0], np.cumsum(gap)])
    out = gap.copy()
    if n >= window:
        none = (total[window:] == total[:-window]) & (gaps[window:] == gaps[:-window])
        for k in range(window):
            out[k : n - window + 1 + k] |= none
    edge = np.diff(np.concatenate([[1], out.astype(int), [1]]))
    return list(zip(np.flatnonzero(edge == -1).tolist(), np.flatnonzero(edge == 1).tolist(), strict=True))


def main_text(page: str | None, window: int = WINDOW) -> str:
    lines = page_lines(page or "")
    in_article = any(line.article and line.text for line in lines)
    size = lambda form: sum(line.plain for line in lines if line.form == form)
    whole_form = not in_article and size(True) > size(False)  # the form is around the page itself
    gap = np.array([not line.text or line.form and not whole_form or in_article and not line.article for line in lines], bool)
    kept: list[str] = []
    for a, b in stretches(np.array([line.plain for line in lines], np.int64), gap, window):
        part = lines[a:b]
        if not in_article:
            texts = [i for i, line in enumerate(part) if line.plain]
            part = part[texts[0] : texts[-1] + 1] if texts else []
            linked = sum(line.linked for line in part)
            if linked > MAX_LINKS * (linked + sum(line.plain for line in part)):
                continue
        kept += [line.text for line in part]
    return " ".join(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    White space inside a block becomes one space, blocks are joined by one, and
    character references are decoded.  A null or empty page has the empty text;
    so has one of boilerplate only.  Repeated rows give equal rows; an empty
    table stays empty; other columns are ignored.  Pages go through one by one,
    whole.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
