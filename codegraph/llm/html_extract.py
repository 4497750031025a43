"""Main text of web pages with site templates removed (operator 9).

Pages are parsed tolerantly (unclosed and stray tags, raw text elements,
comments, cut-off ends) into a tree, and every block element of the whole page
gets the hash of its subtree: tags and normalised text.  Spark counts, for each
host, with how many different contents a subtree occurs; one that recurs with
`MIN_PAGES` contents of a host is a template.  Templates are deleted first,
with all they hold, inside and outside of the article: menus, headers, footers,
notices and adverts that a site repeats go whatever they are called.  The
content of a page is its text before templates are removed, so copies of a page
count once however often they come, and can't make a template of what they
hold.  A paragraph, heading, list item or table cell is never a template by
itself, only with an element around it, as articles of a site quote one another.

What a page has for itself is left to names: elements whose tag, class or id
(whole names) says menu, header, footer, sidebar, notice, advert, form or
reader comments are not content, unless they wrap the article of the page; nor
are articles in articles that such a name calls comments or adverts.  If a page
has an article (or main) element, its text is the content and everything
outside is not.  Without such an element all of the body is content.

Equal (host, subtree, content) are merged before the shuffle, and counts by
(host, subtree) before the next one, so a host with a third of all pages is no
task's burden.  Templates are broadcast where their counted bytes are few; else
they are joined to the subtrees of each distinct page, never gathered by host.

Defined cases: null or empty html gives the empty text and 0; a page without
a host in its URL counts under the host ""; repeated page ids each get their
row; an empty table gives an empty result; no column but the three named ones
is read, so others can't clash.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A subtree is a template of a host from so many contents on, however many the host has.
MIN_PAGES = 5
#: Up to so many counted bytes the templates are broadcast.
BROADCAST_BYTES = 16 << 20

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTR = re.compile(r"""([^\s=/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "svg", "iframe", "math", "select", "object"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_NEVER = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "head", "audio", "video", "canvas"} | _RAW
_CONTENT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "td", "th", "dd", "dt", "figcaption"}
_MAIN = {"article", "main"}
#: Whole class names and ids.  Those of _CARDS may hold article elements that are not the page's article.
_CARDS = set("""ad ads advert advertisement adverts ad-slot ad-banner ad-container ad-wrapper promo promotion sponsor sponsored widget
    comment comments comment-list comments-area comments-section post-comments disqus disqus_thread respond replies reply related related-posts related-articles recommended""".split())
_BOILERPLATE = _CARDS | set("""banner nav navbar nav-bar navigation main-nav site-nav top-nav main-navigation site-navigation post-navigation menu main-menu nav-menu breadcrumb breadcrumbs
    sidebar side-bar footer site-footer page-footer header site-header page-header masthead cookie cookies cookie-banner cookie-notice cookie-consent cookie-bar consent notice gdpr popup modal
    newsletter newsletter-signup subscribe subscription signup login share share-buttons sharing social social-share social-links social-media toolbar skip-link pagination pager""".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
#: An opening tag ends these open elements.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Node:
    tag: str
    hidden: bool = False
    holds: bool = False  # has an article or main element inside
    card: bool = False  # may hold articles that are not the page's
    children: list = field(default_factory=list)
    digest: int = 0


def _hidden(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is no content, and whether that holds even if it has an article inside."""
    if tag in _NEVER:
        return True, tag != "form"
    if tag in ("html", "body") or not attributes:
        return False, False
    hidden = False
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            names = value.lower().split()
            if not _CARDS.isdisjoint(names):
                return True, True
            if tag in _MAIN:
                continue
            hidden = hidden or not _BOILERPLATE.isdisjoint(names)
        elif tag in _MAIN:
            continue
        elif name == "role" and value.lower() in _ROLES or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    return hidden or tag not in _MAIN and bool(re.search(r"(?:^|\s)hidden(?:\s|$)", re.sub(_ATTR, " ", attributes))), False


def parse(page: str) -> Node:
    """The tree of a page; texts are strings among the children."""
    root = Node("#root")
    stack, at, n = [root], 0, len(page)
    while at < n:
        low = page.find("<", at)
        if low < 0:
            low = n
        if low > at:
            stack[-1].children.append(page[at:low])
        if low == n:
            break
        m = _TAG.match(page, low)
        if not m:
            stack[-1].children.append("<")
            at = low + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in _INLINE and stack[i].tag not in _INLINE:
                    break  # a stray inline end tag closes no block
            continue
        if tag not in _INLINE and tag not in _VOID:
            # a block ends an open paragraph, and the inline elements in it
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in _INLINE:
                    break
            ends = _CLOSES.get(tag)
            if ends:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ends:
                        del stack[i:]
                        break
                    if stack[i].tag in ("ul", "ol", "dl", "table", "tbody", "thead", "article", "div", "select"):
                        break
        hidden, card = _hidden(tag, m[3])
        node = Node(tag, hidden, card=card)
        stack[-1].children.append(node)
        if tag in _VOID or m[3].endswith("/") and tag not in _INLINE | _CONTENT | _MAIN | {"div", "section", "script", "style"}:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:[^>]*>|$)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.append(node)
    return root


def _digest(root: Node) -> None:
    """Subtree hashes, bottom up, without recursion (trees may be deep)."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        h = xxhash.xxh64(node.tag)
        for c in node.children:
            if isinstance(c, str):
                h.update(b"\0")
                h.update(" ".join(c.split()))
            else:
                h.update(b"\1" + c.digest.to_bytes(8, "little"))
                node.holds = node.holds or c.holds or c.tag in _MAIN
        node.digest = h.intdigest()


def _wraps(node: Node) -> bool:
    """Whether a hidden element may wrap the article of the page."""
    return node.holds and not node.card


def _says(root: Node) -> bool:
    """Whether a tree has text that is not hidden."""
    todo: list = [root]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            if _html.unescape(item).strip():
                return True
        elif not item.hidden:
            todo += item.children
    return False


def _content_roots(root: Node) -> list[Node]:
    """The article (else main) elements to read, or the whole page.

    Those that no hidden element holds go first, then those in wrappers; the
    others only count on a page that has no other text.
    """
    for level in range(3) if root.holds else ():
        if level == 2 and _says(root):
            break
        for wanted in ("article", "main"):
            found, todo = [], [root]
            while todo:
                node = todo.pop()
                if node.tag == wanted and (not node.hidden or level == 2):
                    found.append(node)
                elif not node.hidden or level == 2 or level == 1 and _wraps(node):
                    todo += [c for c in reversed(node.children) if isinstance(c, Node)]
            if found:
                return found
    return [root]


def _eligible(node: Node) -> bool:
    """Whether a subtree may be deleted as a template: any block that is no page, article or paragraph."""
    return not (node.tag in _INLINE or node.tag in _MAIN or node.tag in _CONTENT or node.tag in _VOID or node.tag in _RAW or node.tag in ("#root", "html", "body", "head"))


def _subtrees(root: Node, templates: set[int] | frozenset[int]) -> tuple[set[int], int]:
    """The hashes of the subtrees of a page that could be templates; those that are get hidden, and are counted."""
    keys: set[int] = set()
    found, todo = 0, [root]
    while todo:
        node = todo.pop()
        if _eligible(node):
            keys.add(node.digest)
            if node.digest in templates and not node.holds:
                node.hidden = node.card = True
                found += 1
                continue
        todo += [c for c in node.children if isinstance(c, Node)]
    return keys, found


@dataclass
class Page:
    """Text blocks, hashes of the subtrees that could be templates, and how many templates were deleted."""

    blocks: list[str] = field(default_factory=list)
    keys: set[int] = field(default_factory=set)
    deleted: int = 0


def read(page: str | None, templates: set[int] | frozenset[int] = frozenset()) -> Page:
    if not page:
        return Page()
    root = parse(page)
    _digest(root)
    keys, deleted = _subtrees(root, templates)
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = " ".join("".join(now).split())
        if text:
            out.append(text)
        now.clear()

    for top in _content_roots(root):
        flush()
        todo: list = [top]
        while todo:
            item = todo.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                now.append(_html.unescape(item))
            elif item.tag == "br":
                now.append(" ")
            elif item.hidden and item is not top and (top.tag == "article" or not _wraps(item)):
                continue
            else:
                if item.tag not in _INLINE and item.tag not in _VOID:
                    flush()
                    todo.append(None)
                todo += reversed(item.children)
    flush()
    return Page(out, keys, deleted)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, key, content) of the subtrees of each page."""
    for batch in batches:
        rows = set()
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            found = read(page)
            content = xxhash.xxh64_intdigest(" ".join(found.blocks)) - (1 << 63)
            rows.update((host, k - (1 << 63), content) for k in found.keys)
        hosts, keys, contents = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(contents, pa.int64())], names=["host", "key", "content"])


def _page_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, key) of the subtrees of each page; page is its digest."""
    for batch in batches:
        rows = set()
        for host, digest, page in zip(batch.column("host").to_pylist(), batch.column("page").to_pylist(), batch.column("html").to_pylist()):
            rows.update((host, digest, k - (1 << 63)) for k in read(page).keys)
        hosts, digests, keys = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.string()), pa.array(keys, pa.int64())], names=["host", "page", "key"])


def site_templates(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, key, n): the subtree hashes that recur with many contents of a host, and how many."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    counts = rows.mapInArrow(_keys, "host string, key long, content long").distinct().groupBy("host", "key").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= min_pages)


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars, n_deleted) of every page; n_deleted counts its templates."""
    from .common import small, stored

    templates = stored(site_templates(pages, url, html, min_pages), "templates").select("host", "key")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    by_host: dict[str, set[int]] = {}
    if small(templates, broadcast_bytes):
        for r in templates.toLocalIterator():
            by_host.setdefault(r["host"], set()).add(r["key"] + (1 << 63))
        joined = rows.withColumn("keys", F.lit(None).cast("array<long>"))
    else:
        rows = rows.withColumn("page", F.md5(F.col("html").cast("binary")))
        own = rows.select("host", "page", "html").mapInArrow(_page_keys, "host string, page string, key long").distinct()
        keys = own.join(templates, ["host", "key"]).groupBy("host", "page").agg(F.collect_list("key").alias("keys"))
        joined = rows.join(keys, ["host", "page"], "left")
    joined = joined.select("page_id", "url", "html", "host", "keys")
    known = pages.sparkSession.sparkContext.broadcast(by_host)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, deleted = [], []
            for page, host, keys in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), batch.column("keys").to_pylist()):
                found = read(page, {k + (1 << 63) for k in keys} if keys else known.value.get(host, frozenset()))
                texts.append(" ".join(found.blocks))
                deleted.append(found.deleted)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(deleted, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_deleted"])

    return joined.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long, n_deleted long")
