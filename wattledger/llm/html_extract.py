"""Main text of web pages by consensus of the pages of a host.

Every page scores its containers by how much of its readable text they hold and how few links. Spark counts, per host,
the votes for generalised tag-class paths. Each page is then extracted again with its host's winning path, or with the
container around it that holds all of the page's readable text.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.staging import stage

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[A-Za-z][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Content that is never text of a page, read up to its end tag.
_RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "math", "canvas", "title", "select", "audio", "video"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "track", "param"}
_BLOCK = {
    "html", "body", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th",
    "caption", "section", "article", "main", "header", "footer", "nav", "aside", "form", "fieldset", "blockquote", "pre", "figure", "figcaption", "address",
    "details", "summary", "center", "head", "menu", "dialog", "button", "hgroup", "search"}
_LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "figcaption", "summary", "ul", "ol", "dl", "table", "thead", "tbody", "tr", "td", "th", "caption"}
_DROP_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head", "search", "fieldset"}
_DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
#: Words in a class or id that mark what is not the article.
_DROP_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "banner", "sponsor", "sponsored", "promo", "promotion",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "sidebar", "side", "aside", "rail", "widget", "widgets",
    "footer", "foot", "copyright", "comment", "comments", "disqus", "replies", "respond", "discussion", "share", "sharing", "social", "related", "recommended",
    "newsletter", "subscribe", "subscription", "signup", "login", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup",
    "modal", "overlay", "toolbar", "skip", "search", "form", "tags", "toc", "disclaimer", "masthead"}
_SITE_HEADER = {"header", "head", "topbar", "masthead", "top"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
_LIST_ENDS = {"ul", "ol", "dl", "table", "menu"}
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in _RAW}
_WORDS = re.compile(r"[a-z]+")


@lru_cache(maxsize=4096)
def _describe(tag: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """(generalised step of a path, whether the element is left out)."""
    names, drop, words = "", tag in _DROP_TAGS or (tag == "header" and not inside), set()
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "role":
                drop |= value in _DROP_ROLES
            elif key == "hidden" or key == "aria-hidden":
                drop |= key == "hidden" or value == "true"
            else:
                words.update(_WORDS.findall(value))
                if key == "class" and value:
                    names = "." + ".".join(sorted({re.sub(r"\d+", "#", v) for v in value.split()}))
    if words and tag not in ("html", "body", "article", "main"):
        drop |= bool(words & _DROP_WORDS) or (not inside and bool(words & _SITE_HEADER))
    return tag + names, drop


def read_blocks(page: str) -> list[tuple[tuple[str, ...], str, int, bool]]:
    """Blocks in page order: (path of its container, text, characters inside links, left out)."""
    blocks: list[tuple[tuple[str, ...], str, int, bool]] = []
    stack: list[tuple] = []  # tag, step, left out, path, inside an article
    buffer: list[str] = []
    links = depth = 0
    at = 0

    def flush():
        nonlocal links
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            if text:
                path, out = (stack[-1][3], stack[-1][2]) if stack else ((), False)
                blocks.append((path, text, min(links, len(text)), out))
            buffer.clear()
        links = 0

    def text(part: str):
        nonlocal links
        buffer.append(part)
        if depth:
            links += len(part)

    while match := _TOKEN.search(page, at):
        if match.start() > at:
            text(page[at:match.start()])
        at = match.end()
        tag = match[2]
        if tag is None:
            continue
        tag = tag.lower()
        if match[1]:
            if tag == "a":
                depth = max(0, depth - 1)
            elif tag in _BLOCK:
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            continue
        if tag in _RAW and not match[3].endswith("/"):
            end = _RAW_END[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style"):
                at = len(page)
            continue
        if tag in ("br", "hr"):
            if tag == "hr":
                flush()
            else:
                text(" ")
            continue
        if tag == "a":
            depth += 1
        if tag in _VOID or tag not in _BLOCK:
            continue
        flush()
        if depth and tag in ("nav", "article", "main", "footer", "section"):  # a link left open ends here
            depth = 0
        closes = _CLOSES.get(tag)
        if closes:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _LIST_ENDS:
                    break
                if stack[k][0] in closes:
                    del stack[k:]
                    break
        else:  # a block ends an open paragraph
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                    break
                del stack[k:]
        inside = bool(stack) and stack[-1][4]
        step, drop = _describe(tag, match[3], inside)
        path = stack[-1][3] if stack else ()
        drop |= bool(stack) and stack[-1][2]
        stack.append((tag, step, drop, path if tag in _LEAF else (*path, step), inside or tag in ("article", "main")))
    if at < len(page):
        text(page[at:])
    flush()
    return blocks


def _readable(blocks) -> dict[tuple[str, ...], list[int]]:
    """(characters that count, characters with those of links) of the blocks directly in each container path. What is left
    out anyway weighs in neither."""
    own: dict[tuple[str, ...], list[int]] = {}
    for path, text, links, out in blocks:
        sums = own.setdefault(path, [0, 0])
        if not out:
            sums[0] += max(0, len(text) - links)
            sums[1] += len(text)
    return own


def score_containers(blocks) -> dict[tuple[str, ...], tuple[float, float]]:
    """(score, share of the readable text held) of every container path of a page that holds some."""
    held: dict[tuple[str, ...], list[float]] = {}
    own = _readable(blocks)
    whole = sum(g for g, _ in own.values())
    for path, (good, size) in own.items():
        for k in range(len(path) + 1):
            sums = held.setdefault(path[:k], [0.0, 0.0])
            sums[0] += good
            sums[1] += size
    return {p: ((g / whole) ** 2 * (g / t), g / whole) for p, (g, t) in held.items() if g} if whole else {}


def _best(scores: dict) -> tuple[str, ...] | None:
    """Of equal containers the innermost."""
    return max(scores, key=lambda p: (scores[p][0], len(p), p)) if scores else None


def extract(page: str, winner: str | None) -> str:
    """Text of the blocks under the host's path, or under the page's own if it holds less than half as much there.

    A path that does not hold all of the page's readable text gives way to the innermost container around it that does;
    from there, blocks outside the path are taken unless they are mostly links.
    """
    blocks = read_blocks(page)
    scores = score_containers(blocks)
    if not scores:
        return ""
    best = _best(scores)
    chosen = tuple(winner.split("/")) if winner else best
    if scores.get(chosen, (0, 0))[1] < 0.5 * scores[best][1]:
        chosen = best
    around = chosen
    while scores[around][1] < 1:
        around = around[:-1]
    return "\n".join(
        t for path, t, links, out in blocks
        if not out and path[:len(around)] == around and (path[:len(chosen)] == chosen or 2 * links <= len(t)))


def _voter(batches):
    for pdf in batches:
        votes: dict[tuple[str, str], float] = {}
        for host, page in zip(pdf["host"], pdf["html"]):
            scores = score_containers(read_blocks(page))
            best = _best(scores)
            if best:
                votes[host, "/".join(best)] = votes.get((host, "/".join(best)), 0) + scores[best][0]
        if votes:
            host, path = (pd.Series([k[i] for k in votes], dtype=object) for i in range(2))
            yield pd.DataFrame({"host": host, "path": path, "votes": list(votes.values())})


def _extractor(batches):
    for pdf in batches:
        texts = [extract(page, winner if isinstance(winner, str) else None) for page, winner in zip(pdf["html"], pdf["path"])]
        kept = {c: pd.Series([v if isinstance(v, str) else None for v in pdf[c]], dtype=object) for c in ("url", "host", "path")}
        yield pd.DataFrame({"page_id": pd.array([None if pd.isna(v) else int(v) for v in pdf["page_id"]], "Int64"), **kept, "text": pd.Series(texts, dtype=object), "n_chars": [len(t) for t in texts]})


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, host, path, text, n_chars``.

    Only ``page_id, url, html`` are read. Null, empty and textless pages give an empty text. Pages without a host (null or
    odd urls) form one host. Repeated rows each give a row; ties in votes go to the greater path; an empty table gives no
    rows. ``path`` is the host's winner, null for a host without readable text.

    Votes are summed within a batch and before the shuffle, so a host with a third of all pages is a handful of rows.
    The winners, a row per host, are a stage: broadcast by the planner while they are small, else joined with skew split.
    """
    url = F.lower(F.col("url").cast("string"))
    host = F.regexp_replace(F.coalesce(F.regexp_extract(url, "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")), "^www\\.", "")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    votes = base.select("host", "html").mapInPandas(_voter, "host string, path string, votes double")
    summed = votes.groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    winners = stage(summed.groupBy(F.col("host").alias("_host")).agg(F.max(F.struct("votes", "path"))["path"].alias("path")), "hosts")
    return base.join(winners, F.col("host") == F.col("_host"), "left").select("page_id", "url", "host", "path", "html").mapInPandas(
        _extractor, "page_id long, url string, host string, path string, text string, n_chars long")
