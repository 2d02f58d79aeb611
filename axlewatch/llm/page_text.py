"""Main text of web pages: what the markup marks as beside the point goes, and so do site templates.

Every element subtree is hashed (tag, classes, text, children). Spark counts, per host, on how many
different pages a subtree occurs; one that recurs on many pages of its host is a template and is
deleted, together with navigation, headers, footers, asides, forms, scripts, adverts, notices and
reader comments, known by tag, role, class or id. Prose inside an article is exempt from the template
rule, so an article that quotes a line of its neighbours keeps it; containers inside it are not.

A host's templates number at most elements-per-page / `share`, so their list per host is bounded by
the size of a page. The list table is broadcast only if a check finds it small.

Defined results: a null or empty page has an empty text; a page without an article or main element is
taken whole, less what is deleted; equal rows give equal rows and count as one page; a null or odd url
belongs to the host ""; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axlewatch.llm.base import arrow_rows
from axlewatch.operators.segments import sized_broadcast
from axlewatch.session import checkpointed

EXTRACTED = "page_id long, url string, text string, n_chars long"
TOKEN = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*))")
TAG_END = re.compile(r"""((?:[^>"']+|"[^"]*"|'[^']*')*+)>""")
TAG_SIGN = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
READ = frozenset("class id role hidden aria-hidden style".split())

# fixed values of the markup
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
PROSE = frozenset("header hgroup p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption caption".split()) | INLINE
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul".split())
SELF_ENDING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
               "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol dl table select".split())
DROPPED = frozenset(
    "nav footer aside form script style noscript template button select textarea iframe svg math object embed canvas "
    "dialog menu head title audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
BESIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adslot|banner|promos?|promotion|sponsor(?:ed)?|sidebar|menu|"
    r"nav|navbar|navigation|breadcrumbs?|footer|masthead|comments?|commentlist|replies|respond|disqus|notices?|cookies?|"
    r"consent|gdpr|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|"
    r"related|recommend(?:ed|ations)?|widgets?|pager|pagination|toolbar|skip|search)(?:$|[\s_-])", re.I)
SITE_HEADER = re.compile(r"(?:^|[\s_-])(?:header|top|topbar)(?:$|[\s_-])", re.I)
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|replies|respond|related|sidebar)(?:$|[\s_-])", re.I)


@dataclass
class Element:
    tag: str
    marks: str = ""             # classes and id
    dropped: bool = False       # by its own tag, role, class or id
    items: list = field(default_factory=list)   # elements and texts, in order
    digest: int = 0


def element(tag: str, attributes: str) -> Element:
    found = {}
    if attributes and not attributes.isspace():
        for name, value in ATTRIBUTE.findall(attributes):
            if name.lower() in READ:
                found.setdefault(name.lower(), value.strip("\"'"))
    marks = " ".join(found[n] for n in ("class", "id") if n in found)
    dropped = (tag in DROPPED or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
               or found.get("role", "").lower() in ROLES
               or "display:none" in found.get("style", "").replace(" ", "").lower()
               or bool(marks and tag not in ("html", "body", "article", "main") and BESIDE.search(marks)))
    return Element(tag, marks, dropped)


class Stack:
    """The open elements. What a tag may close is found without walking over the others."""

    def __init__(self, root: Element) -> None:
        self.open = [root]
        self.count: Counter = Counter()     # of open elements by tag
        self.outer: list[int] = []          # depths of those that are not inline
        self.listed: list[int] = []         # depths of those that end by themselves, and of lists

    def push(self, node: Element) -> None:
        depth = len(self.open)
        self.open.append(node)
        self.count[node.tag] += 1
        if node.tag not in INLINE:
            self.outer.append(depth)
        if node.tag in SELF_ENDING or node.tag in LISTS:
            self.listed.append(depth)

    def cut(self, depth: int) -> None:
        """Ends the elements from this depth on."""
        for node in self.open[depth:]:
            self.count[node.tag] -= 1
        del self.open[depth:]
        for depths in (self.outer, self.listed):
            while depths and depths[-1] >= depth:
                depths.pop()

    def close(self, tag: str) -> None:
        if self.count[tag]:
            depth = len(self.open) - 1
            while self.open[depth].tag != tag:
                depth -= 1
            self.cut(depth)

    def make_room(self, tag: str) -> None:
        """Ends the paragraph, list item or cell that such an element cannot be in."""
        if tag in ENDS_PARAGRAPH:
            if self.outer and self.open[self.outer[-1]].tag == "p":
                self.cut(self.outer[-1])
        elif tag in SELF_ENDING:
            for depth in reversed(self.listed):
                if self.open[depth].tag in SELF_ENDING[tag]:
                    self.cut(depth)
                    break
                if self.open[depth].tag in LISTS:
                    break


class TagEnds:
    """Where a tag's last sign is: the first > outside quotes, else the first > at all; linear in the page."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.places: list[int] | None = None
        self.ends: list[int] = []

    def after(self, at: int) -> int:
        if self.places is None:
            if found := TAG_END.match(self.html, at):
                return found.end() - 1
            # an open quote: no such scan again, all ends are found at once, from the last sign back
            self.places = [m.start() for m in TAG_SIGN.finditer(self.html)]
            self.ends = [-1] * (len(self.places) + 1)
            later: dict[str, int] = {}
            for i in range(len(self.places) - 1, -1, -1):
                sign = self.html[self.places[i]]
                if sign == ">":
                    self.ends[i] = self.places[i]
                else:
                    self.ends[i] = self.ends[later[sign] + 1] if sign in later else -1
                    later[sign] = i
        end = self.ends[bisect_left(self.places, at)]
        return end if end >= 0 else self.html.find(">", at)


def parse(html: str) -> Element:
    """The element tree; unclosed elements end where their parents do. Time is linear in the page, whatever it holds."""
    stack, ends = Stack(Element("")), TagEnds(html)
    root, at, last = stack.open[0], 0, html.rfind(">")
    scripts_end: dict[str, re.Pattern] = {}
    begin = 0       # of the text not yet taken
    while found := TOKEN.search(html, at):
        comment = found[0] == "<!--"
        if found.end() > last and not comment:
            # no tag ends any more, a comment may begin
            at = html.find("<!--", found.start() + 1)
            if at < 0:
                break
            continue
        if found.start() > begin:
            stack.open[-1].items.append(html[begin:found.start()])
        if comment:
            end = html.find("-->", found.end())
            begin = at = end + 3 if end >= 0 else len(html)
            continue
        tag = (found[2] or "").lower()
        end = ends.after(found.end()) if tag else html.find(">", found.end())
        begin = at = end + 1
        if tag == "br":
            stack.open[-1].items.append(" ")
        elif found[1]:
            stack.close(tag)
        elif tag:
            stack.make_room(tag)
            node = element(tag, html[found.end():end])
            stack.open[-1].items.append(node)
            if tag in RAW:
                if tag not in scripts_end:
                    scripts_end[tag] = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I)
                close = scripts_end[tag].search(html, at, last + 1)
                node.items.append(html[at:close.start() if close else len(html)])
                begin = at = close.end() if close else len(html)
            elif tag not in VOID:
                stack.push(node)
    if begin < len(html):
        stack.open[-1].items.append(html[begin:])
    return root


def hash_subtrees(root: Element) -> list[Element]:
    """Sets every element's digest, children first (no recursion, pages may nest deeply); returns all elements."""
    import xxhash
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [i for i in node.items if isinstance(i, Element)]
    for node in reversed(order):
        parts = [f"{node.tag}\x00{node.marks}".encode()]
        for item in node.items:
            if isinstance(item, Element):
                parts.append(item.digest.to_bytes(8, "little"))
            elif words := item.split():
                parts.append(" ".join(words).encode())
        node.digest = xxhash.xxh3_64_intdigest(b"\x01".join(parts))
    return order


def signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def main_parts(root: Element) -> list[Element]:
    """The outermost article elements (else main elements) that are not readers' or asides; else the page."""
    for tag in ("article", "main"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.tag == tag and not READERS.search(node.marks):
                found.append(node)
            elif node.tag != "aside" and not READERS.search(node.marks):
                todo += reversed([i for i in node.items if isinstance(i, Element)])
        if found:
            return found
    return [root]


def blocks(part: Element, templates: frozenset) -> list[str]:
    """Texts of the blocks under an element, less what is dropped and the site's templates."""
    whole = part.tag not in ("article", "main")
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        words = " ".join(unescape("".join(line)).split())
        if words:
            out.append(words)
        line.clear()

    todo: list = [part]
    while todo:
        item = todo.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            line.append(item)
        else:
            if item is not part:
                if item.dropped or whole and (item.tag == "header" or SITE_HEADER.search(item.marks)):
                    if item.tag not in INLINE:
                        end()
                    continue
                if item.digest in templates and (whole or item.tag not in PROSE):
                    end()
                    continue
                if item.tag == "article" and READERS.search(item.marks):
                    continue
            if item.tag in INLINE:
                todo += reversed(item.items)
            else:
                end()
                todo.append(None)
                todo += reversed(item.items)
    end()
    return out


def page_text(html: str, templates: frozenset = frozenset()) -> str:
    root = parse(html)
    if templates:
        hash_subtrees(root)
    return "\n".join(b for part in main_parts(root) for b in blocks(part, templates))


# ---------------------------------------------------------------- the site's templates

def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(found, F.lit(""))


def site_templates(pages: DataFrame, min_pages: int = 5, share: float = 0.2) -> DataFrame:
    """(host, templates): digests of subtrees on at least `min_pages` pages and `share` of the pages of the host."""

    def work(columns):
        rows = []
        for host, html in zip(*columns, strict=True):
            root = parse(html or "")
            order = hash_subtrees(root)
            page = signed(root.digest)
            rows += [(host, page, d) for d in {signed(n.digest) for n in order if n.tag not in INLINE and n.items}]
        return rows

    seen = arrow_rows(pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string")), work,
                      "host string, page long, digest long").distinct()
    # the root's digest counts the different pages of the host
    counts = checkpointed(seen.groupBy("host", "digest").agg(
        F.count("*").alias("pages"), F.max((F.col("page") == F.col("digest")).cast("int")).alias("is_page"))
        .where((F.col("pages") >= min_pages) | (F.col("is_page") == 1)))
    sizes = counts.where("is_page = 1").groupBy("host").agg(F.count("*").alias("host_pages"))
    often = counts.where((F.col("is_page") == 0) & (F.col("pages") >= min_pages)).join(sizes, "host")
    return (often.where(F.col("pages") >= share * F.col("host_pages"))
            .groupBy("host").agg(F.collect_list("digest").alias("templates")))


def extract_text(pages: DataFrame, min_pages: int = 5, share: float = 0.2) -> DataFrame:
    """Main text of every whole page of (page_id, url, html)."""
    templates = checkpointed(site_templates(pages, min_pages, share))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    # a checked broadcast: beyond its limit the pages are shuffled by host
    rows = rows.join(sized_broadcast(templates, F.size("templates")), "host", "left").select("page_id", "url", "html", "templates")

    def work(columns):
        out = []
        for page, url, html, known in zip(*columns, strict=True):
            text = page_text(html or "", frozenset(d % (1 << 64) for d in known or ()))
            out.append((page, url, text, len(text)))
        return out

    return arrow_rows(rows, work, EXTRACTED)
