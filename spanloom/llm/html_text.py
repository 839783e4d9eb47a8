"""Main text of HTML pages by tag-path ratios.

A page is cut into blocks: runs of text not interrupted by a block tag or a
line break.  Each block has the path of block tags, with classes, from the root.
Per path, text length and punctuation are summed and divided by the number of
blocks.  Both ratios are smoothed along the page and fused by product, with three
weights: the path's share of the page's text, the share of it outside links, and
``FURNITURE`` for paths through tags, roles, classes or ids of page furniture.  The mean per path is its score;
paths that reach ``SHARE`` of the best are content.  Their common ancestor is the
container: blocks in it are the text, headings and short lines included, but for
paths of furniture, or, outside ``article`` and ``main``, made up of links, that
aren't content paths.

Reading takes time and memory in proportion to the page whatever its markup: paths
are numbers in a tree, open tags are found by their last places, and what never
ends is looked for once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Paths that reach this share of the best fused ratio are content.
SHARE = 0.15
#: Outside an article, paths with more of their text in links are furniture.
LINKS = 0.5
#: So are single blocks beyond this.
LINK_ONLY = 0.9
#: Weight of a path of furniture.
FURNITURE = 1e-4

# Names from the HTML standard and words common in class names.
_RAW = "script style title noscript template textarea iframe svg math object canvas select".split()
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split()
)
_FURNITURE = set("nav footer aside form button menu dialog fieldset".split())
_ROLES = set("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs masthead footer sidebar aside widget widgets related recommended share sharing social "
    "cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login popup modal overlay "
    "comment comments disqus replies reply respond pagination pager toolbar copyright skip".split()
)
_PAGE_WORDS = {"header", "topbar", "site-header", "legal"}
_CLOSES_P = "p div ul ol dl li dt dd table h1 h2 h3 h4 h5 h6 section article aside nav header footer main form pre blockquote hr figure fieldset address details".split()
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

#: Tags that hold a line or a paragraph, not other parts.
_LEAVES = set("p li dt dd td th h1 h2 h3 h4 h5 h6 pre blockquote figcaption caption summary".split())

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_TAG_END = re.compile(r">|=\s*([\"'])")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")
_SPLIT_NAME = re.compile(r"[^a-z0-9]+")


class _Path:
    """A path of block tags: its number, the one above, and what holds for all its elements."""

    __slots__ = ("article", "elements", "furniture", "inner", "number", "tag", "under", "up")

    def __init__(self, tag: str, up: _Path | None, number: int, article: bool, furniture: bool) -> None:
        self.tag, self.up, self.number, self.article, self.furniture = tag, up, number, article, furniture
        self.elements, self.inner = 0, False
        self.under: dict[tuple, _Path] = {}


class _Page:
    """The open elements of a page while it is read, and the tree of their paths."""

    def __init__(self) -> None:
        self.root = _Path("", None, 0, False, False)
        self.paths = [self.root]
        self.open: list[_Path] = []
        self.places: dict[str, list[int]] = defaultdict(list)

    @property
    def at(self) -> _Path:
        return self.open[-1] if self.open else self.root

    def enter(self, tag: str, attrs: str, push: bool) -> None:
        """A new element; only what ``push`` says stays open."""
        up, got = self.at, {}
        if attrs.strip(" /"):
            got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
        kind = " ".join(got.get("class", "").lower().split())
        words = set(_SPLIT_NAME.split(f"{kind} {got.get('id', '').lower()}"))
        whole = tag in ("html", "body", "article", "main")
        furniture = bool(
            up.furniture
            or tag in _FURNITURE
            or got.get("role") in _ROLES
            or "hidden" in got
            or got.get("aria-hidden") == "true"
            or (not whole or "comment" in words) and words & _WORDS
            or (not up.article and (tag == "header" or not whole and words & _PAGE_WORDS))
        )
        article = up.article or tag in ("article", "main") or got.get("role") in ("main", "article")
        key = (tag, kind, article, furniture)
        path = up.under.get(key)
        if path is None:
            path = up.under[key] = _Path(tag, up, len(self.paths), article, furniture)
            self.paths.append(path)
            up.inner = True
        path.elements += 1
        if push:
            self.places[tag].append(len(self.open))
            self.open.append(path)

    def close(self, tags: set[str], stop: set[str]) -> None:
        """Ends the last open element of ``tags``, with all in it, unless one of ``stop`` is in between."""
        last = lambda names: max((self.places[t][-1] for t in names if self.places.get(t)), default=-1)
        at = last(tags)
        if at < 0 or at < last(stop):
            return
        for path in self.open[at:]:
            self.places[path.tag].pop()
        del self.open[at:]


def blocks(html: str) -> tuple[list[tuple[_Path, str, float]], list[_Path]]:
    """Each block's path, text, and share of the text in links; and all paths, parents first."""
    out: list[tuple[_Path, str, float]] = []
    page, parts = _Page(), []
    linked, in_link, at, n = 0, False, 0, len(html)
    missing: set[str] = set()

    def flush() -> None:
        nonlocal linked, in_link
        if parts and (text := " ".join(unescape("".join(parts)).split())):
            out.append((page.at, text, min(1.0, linked / len(text))))
        parts.clear()
        linked, in_link = 0, False

    def after(mark: str, start: int) -> int:
        """The place after ``mark``, or the end; a mark that was missing once isn't looked for again."""
        found = -1 if mark in missing else html.find(mark, start)
        if found < 0:
            missing.add(mark)
            return n
        return found + len(mark)

    def tag_end(start: int) -> int:
        """The place of the tag's ``>``, which isn't in a quoted value; -1 if there is none."""
        while m := _TAG_END.search(html, start):
            if not m[1]:
                return m.start()
            close = after(m[1], m.end())
            start = m.end() if m[1] in missing else close
        return -1

    def raw_end(tag: str) -> int:
        """The place after the end tag of a raw element; -1 if there is none."""
        mark = f"</{tag}"
        if mark in missing:
            return -1
        stop = re.compile(rf"{mark}\b[^>]*>", re.I).search(html, at)
        if not stop:
            missing.add(mark)
            return -1
        return stop.end()

    while at < n:
        end = html.find("<", at)
        end = n if end < 0 else end
        name = _NAME.match(html, end + 1)
        if not name and html[end + 1 : end + 2] not in ("!", "?"):
            end = min(n, end + 1)  # a plain sign
        if end > at:
            parts.append(html[at:end])
            linked += (end - at) * in_link
        at = end
        if not name:
            if html.startswith("<!--", at):
                at = after("-->", at + 4)
            elif html.startswith("<![CDATA[", at):
                at = after("]]>", at)
            elif html.startswith(("<!", "<?"), at):
                at = after(">", at)
            continue
        stop = tag_end(name.end())
        if stop < 0:  # an unfinished tag takes what is left
            break
        tag, closes, attrs = name[1].lower(), html[at + 1] == "/", html[name.end() : stop]
        at = stop + 1
        if tag in _INLINE:
            if tag == "a":
                in_link = not closes
            continue
        if tag in _RAW:
            if not closes and not attrs.endswith("/"):
                stop = raw_end(tag)
                # Without an end tag only what can't show text runs to the end.
                at = stop if stop >= 0 else n if tag in ("script", "style", "title", "textarea") else at
            if tag in ("textarea", "select", "iframe", "object", "canvas"):
                flush()
            continue
        flush()
        if tag in _VOID:
            continue
        if closes:
            page.close({tag}, {"article", "main", "body"} if tag in ("p", "li", "td", "tr", "div", "section") else set())
            continue
        if tag in _CLOSES_P:
            page.close({"p"}, {"div", "td", "th", "article", "section", "li", "body", "main", "button"})
        if tag in _CLOSES:
            page.close(*_CLOSES[tag])
        if tag == "body":
            page.close({"head"}, set())
        page.enter(tag, attrs, not attrs.endswith("/"))
    flush()
    return out, page.paths


def _smooth(x: list[float]) -> list[float]:
    """Each value with its neighbours by weights 1, 4, 1."""
    n = len(x)
    return [(x[max(i - 1, 0)] + 4 * x[i] + x[min(i + 1, n - 1)]) / 6 for i in range(n)]


def path_scores(found: list[tuple[_Path, str, float]]) -> dict[int, float]:
    """Of each path with blocks the mean of its blocks' smoothed and fused ratios, by number."""
    length, marks, count, linked = (defaultdict(float) for _ in range(4))
    for p, text, in_links in found:
        length[p.number] += len(text)
        marks[p.number] += len(_PUNCTUATION.findall(text))
        count[p.number] += 1
        linked[p.number] += len(text) * in_links
    text_ratio = _smooth([length[p.number] / count[p.number] for p, _, _ in found])
    mark_ratio = _smooth([(marks[p.number] + 1) / count[p.number] for p, _, _ in found])
    whole = sum(length.values())
    out: dict[int, float] = defaultdict(float)
    for (p, _, _), a, b in zip(found, text_ratio, mark_ratio, strict=True):
        weight = (FURNITURE if p.furniture else 1) * (1.001 - linked[p.number] / length[p.number]) * length[p.number] / whole
        out[p.number] += a * b * weight / count[p.number]
    return out


def main_text(html: str | None, share: float = SHARE, links: float = LINKS) -> str:
    """The main text of a page; empty for null, empty and textless pages, and those of furniture alone."""
    found, paths = blocks(html or "")
    found = [b for b in found if b[0].article or b[2] <= LINK_ONLY] or found
    if all(p.furniture for p, _, _ in found):
        return ""
    scores = path_scores(found)
    best = max(scores.values())
    content = {k for k, x in scores.items() if x >= share * best}
    # The content paths' common ancestor: the deepest path that has all of them in it.
    within = [int(p.number in content) for p in paths]
    for p in reversed(paths[1:]):
        within[p.up.number] += within[p.number]
    container = max((p for p in paths if within[p.number] == len(content)), key=lambda p: p.number)
    # A line or one of several like parts has no heading in it: what is around it is the container.
    if container.up and not container.inner and (container.tag in _LEAVES or container.elements > 1):
        container = container.up
    inside, own, linked = [False] * len(paths), defaultdict(float), defaultdict(float)
    for p in paths:
        inside[p.number] = p is container or bool(p.up and inside[p.up.number])
    for p, text, in_links in found:
        own[p.number] += len(text)
        linked[p.number] += len(text) * in_links
    plain = lambda p: not p.furniture and (p.article or linked[p.number] <= links * own[p.number])
    return " ".join(t for p, t, _ in found if inside[p.number] and (p.number in content or plain(p)))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """All rows and columns of ``pages`` but ``html``, with ``text`` and ``n_chars`` (code points).

    Null and empty pages, and pages without main text, have an empty text.
    Broken markup is read as far as it goes: an unfinished tag takes the rest.
    Each page is read whole and on its own, in time and memory in proportion to
    its length, however deep it nests; repeated rows stay; an empty table stays
    empty; input columns named as the added ones are replaced.
    """

    @F.pandas_udf("string")
    def text_of(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p if isinstance(p, str) else None) for p in pages], dtype=object)

    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    got = fresh(pages.columns, "got")
    out = pages.withColumn(got, text_of.asNondeterministic()(F.col(f"`{html}`")))
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col(got).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
