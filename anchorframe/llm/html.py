"""Main text of web pages by the distribution of line blocks.

Markup is stripped to lines, one for each block element. Lines of a menu, header, footer, side bar, notice, advert, form, script or
reader comment (by element, role or names of its class and id) are left out, and lines that are mostly link text, outside of a
marked main part, count as nothing. Lengths are summed over sliding windows of three lines. The text surges where a window first
reaches ``SURGE`` characters, or the page's largest window if that is smaller, and dives where one falls to nothing; lines between
are kept.

A page's marked main part (``article``, ``main``) is a check on that: lines in it weigh ``MARKED`` times their length and those
outside nothing, and short lines ahead of a surge in it are kept, unless the windows find more text outside it than in it, as around a teaser card; then it is not heeded.

Names of class and id count by their first or last part. They never count on ``html``, ``body``, ``main`` and ``article``, nor on an
element that holds most of the page's text where no window of ``SURGE`` characters is left without it.

Null and empty pages give an empty text with 0 characters, null ids and urls are carried through, repeated rows are pages of
their own. Character references are decoded after the markup is gone, white space inside a line becomes one blank, and lines
are joined by an empty line. Unclosed elements end with the page. Other columns are not read.
"""

from __future__ import annotations

import html as references
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SURGE = 86
WINDOW = 3
MARKED = 4
_READINGS = 16

_HIDDEN = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|noscript|template|svg|title|textarea|iframe)\b.*?(?:</(?P=raw)\s*>|\Z)"
_UNCLOSED = re.compile(_HIDDEN, re.I | re.S)
_MARKUP = re.compile(
    _HIDDEN + r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>|<[!?/][^>]*>", re.I | re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\s(hidden)\b", re.I)

# Elements, roles and words of class and id names by their use in pages (fixed values).
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output picture progress "
                    "q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OTHER = frozenset("aside button dialog footer form head menu nav object select".split())
_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
_WORDS = frozenset("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
                   "disqus footer masthead menu modal nav navbar navigation newsletter notice pagination popup promo related replies reply "
                   "respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
_SWITCHES = frozenset("has with without no not is enabled disabled free on off content wrapper layout".split())  # names of a page's state or of what is around
_MAIN = frozenset(("article", "main"))
_WHOLE = _MAIN | {"html", "body"}


def _named_other(value: str) -> bool:
    for name in value.split():
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
        if parts and (parts[0] in _WORDS or parts[-1] in _WORDS) and _SWITCHES.isdisjoint(parts):
            return True
    return False


@lru_cache(maxsize=1 << 14)
def _is_other(name: str, rest: str, in_main: bool) -> str | None:
    """Whether an element holds something else than content: by its "kind", or only by the "name" of its class or id."""
    if name in _OTHER or name == "header" and not in_main:
        return "kind"
    if "=" not in rest and "hidden" not in rest.lower():
        return None
    named = None
    for key, *values, hidden in _ATTRIBUTE.findall(rest):
        value = "".join(values).lower()
        key = key.lower()
        if hidden or key == "style" and re.search(r"display\s*:\s*none", value) or key == "role" and value.strip() in _ROLES:
            return "kind"
        if key in ("class", "id") and name not in _WHOLE and _named_other(value):
            named = "name"
    return named


def _marks(page: str):
    """Matches of markup, one after another. Behind the last ``>`` only what is hidden up to the page's end can begin.

    So a tag is looked for only where one can end, and no unclosed one is read to the page's end again and again.
    """
    last, at = page.rfind(">"), page.find("<")
    while 0 <= at <= last:
        found = _MARKUP.match(page, at)
        if found:
            yield found
        at = page.find("<", found.end() if found else at + 1)
    if at >= 0 and (found := _UNCLOSED.search(page, at)):
        yield found


def lines_of(page: str, heeded: frozenset[int] | None = frozenset(), named: list[tuple[int, int]] | None = None) -> list[tuple[str, bool, bool, float, int | None]]:
    """(text, other, main, share of link text, place of the element that makes it other by its name) of each line.

    Names of the elements at the places in ``heeded`` do not count; with None no name counts, and ``named`` receives (place, number of the
    one around it or -1) of each element whose name would; a line then has the number of the innermost one in place of the place.
    """
    lines: list[tuple[str, bool, bool, float, int | None]] = []
    parts: list[str] = []
    links = 0
    other: list[str] = []  # open elements from the outermost that is not content
    main: list[str] = []
    link, holder, at = 0, None, 0
    inside: list[list] = []  # open elements whose name would count: name, open elements of that name, number

    def close_line():
        nonlocal links
        raw = "".join(parts)
        text = " ".join(references.unescape(raw).split())
        if text:
            within = (inside[-1][2] if inside else None) if heeded is None else holder if other else None
            lines.append((text, bool(other), bool(main), links / max(1, len(raw)), within))
        parts.clear()
        links = 0

    for m in _marks(page):
        if m.start() > at:
            parts.append(page[at:m.start()])
            links += link and m.start() - at
        at = m.end()
        name = m["name"] if m.re is _MARKUP else None
        if name is None:
            if m["raw"] is not None:
                parts.append(" ")
            continue
        name, end = name.lower(), bool(m["end"])
        if name == "a":
            link = not end
        if name == "br":
            parts.append(" ")
            continue
        opens = not end and name not in _VOID and not m["rest"].endswith("/")
        boundary = name not in _INLINE
        why = _is_other(name, m["rest"], bool(main)) if opens and not other else None
        if heeded is None and (why == "name" or inside and inside[-1][0] == name and not (end and name in _VOID)):
            close_line()
            if why == "name":
                named.append((m.start(), inside[-1][2] if inside else -1))
                inside.append([name, 1, len(named) - 1])
            elif opens or end:
                inside[-1][1] += 1 if opens else -1
                if not inside[-1][1]:
                    inside.pop()
        if why == "kind" or why and heeded is not None and m.start() not in heeded:
            close_line()
            other.append(name)
            holder = m.start() if why == "name" else None
            continue
        if boundary:
            close_line()
        if other:
            if opens and name == other[0]:
                other.append(name)
            elif end and name == other[-1]:
                close_line()
                other.pop()
        elif name in _MAIN:
            if opens:
                main.append(name)
            elif end and main:
                main.pop()
    if at < len(page):
        parts.append(page[at:])
    close_line()
    return lines


def _sums(size: list[int]) -> list[int]:
    return [sum(size[n:n + WINDOW]) for n in range(len(size))]


def _between(size: list[int], whole: bool = False) -> list[int]:
    """Lines of some length between surge and dive; with ``whole``, those ahead of a surge too, back to the last dive."""
    sums = _sums(size)
    surge = min(SURGE, max(sums, default=0)) or 1
    kept, ahead, inside = [], [], False
    for n, total in enumerate(sums):
        inside = total > 0 if inside else total >= surge
        if total == 0:
            ahead = []
        elif inside:
            kept += ahead + [n] * (size[n] > 0)
            ahead = []
        elif whole and size[n]:
            ahead.append(n)
    return kept


def _wrappers(page: str) -> list[int]:
    """Places of the elements that only their names make other and that hold most of the page's text, from the outermost."""
    named: list[tuple[int, int]] = []
    lines = lines_of(page, None, named)
    held = [0] * len(named)
    for text, _, _, _, n in lines:
        if n is not None:
            held[n] += len(text)
    for n in range(len(named) - 1, -1, -1):  # inner elements come later
        if named[n][1] >= 0:
            held[named[n][1]] += held[n]
    most = sum(len(line[0]) for line in lines) / 2
    return [place for (place, _), n in zip(named, held) if n > most]


def _content_lines(page: str) -> list[tuple]:
    """Lines that are not something else. A wrapper, whose name leaves out most of the text, is not heeded while no window of ``SURGE`` characters is left.

    Wrappers are taken from the outermost on, one reading of the page for each; of more than ``_READINGS`` the number is found by halving.
    """
    heeded: frozenset[int] = frozenset()
    for _ in range(_READINGS):
        lines = lines_of(page, heeded)
        own = [line for line in lines if not line[1]]
        held: dict[int, int] = {}
        for text, _, _, _, holder in lines:
            if holder is not None:
                held[holder] = held.get(holder, 0) + len(text)
        most = max(held, key=held.get, default=None)
        if most is None or 2 * held[most] <= sum(len(line[0]) for line in lines) or _surges(own):
            return own
        heeded |= {most}
    wrappers = [w for w in _wrappers(page) if w not in heeded]
    low, high = -1, len(wrappers)
    while high - low > 1:
        middle = (low + high) // 2
        if _surges([line for line in lines_of(page, heeded.union(wrappers[:middle])) if not line[1]]):
            high = middle
        else:
            low = middle
    return [line for line in lines_of(page, heeded.union(wrappers[:high])) if not line[1]]


def _surges(lines: list[tuple]) -> bool:
    return max(_sums([0 if line[3] > 0.6 else len(line[0]) for line in lines]), default=0) >= SURGE


def main_text(page: str | None) -> str:
    """The lines between surge and dive."""
    if not page:
        return ""
    lines = _content_lines(page)
    size = [0 if links > 0.6 and not main else len(text) for text, _, main, links, _ in lines]
    trusted = False
    if any(main for _, _, main, _, _ in lines):
        outside = [0 if line[2] else n for n, line in zip(size, lines)]
        inside = [n if line[2] else 0 for n, line in zip(size, lines)]
        if sum(outside[n] for n in _between(outside)) <= sum(inside[n] for n in _between(inside)):
            size, trusted = [MARKED * n for n in inside], True
        else:
            size = [0 if links > 0.6 else len(text) for text, _, _, links, _ in lines]
    return "\n\n".join(lines[n][0] for n in _between(size, trusted))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    def run(batches):
        for got in batches:
            texts = [main_text(page) for page in got.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
