"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page becomes a token stream of tags and texts, nested by its elements. Repeated siblings are folded into one repeated
group. The pages of a host are aligned one after the other: where streams differ in a text, the text becomes a slot;
where one has tokens that the other lacks, they become an optional group. The result is the host's wrapper, a union-free
expression of tags, constant texts, slots, optional and repeated groups. Aligning is done in every task for the pages it
reads, and the tasks' wrappers are aligned with each other in two steps, first in `PARTS` parts a host, so no task sees
all pages of a large host.

A page is read against its host's wrapper: text that the wrapper holds constant over `SUPPORT` different pages or more is
template text. Of what is left, elements that are no main text by their tag, role or class (menus, headers, footers,
sidebars, notices, adverts, forms, comments) go; the main text is that of all article elements, or of all main elements, or without
one all that is left.

Defined cases: a null, empty or text-less page has an empty text; a page without a host belongs to the empty host; a
host with one page has no template text; text inside an article is never taken for template text, as copies of a page
would lose their article; unclosed elements end with what encloses them; repeated rows get the same result. Pages are read
whole, whatever their length. Which of two equally good alignments is taken depends on the order in which pages meet, so
a wrapper may differ between layouts of a table; what counts as template text needs `SUPPORT` different pages in any of
them. Columns that have a result's name are replaced, no other name can clash; an empty table gives no rows.
"""

from __future__ import annotations

import html
import pickle
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import grouped, ids_of, numbered_columns, own_arrays, own_fields, slices, stored
from driftline.llm.urlfilter import host_of

#: Different pages in which a text must stand at the same place to be template text.
SUPPORT = 3
#: Parts in which a host's wrappers are aligned first.
PARTS = 64
#: Levels of nesting; what is nested deeper counts as standing at this level.
DEEPEST = 100
#: Bytes of wrappers up to which they are broadcast.
BROADCAST_BYTES = 16 << 20

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?([A-Za-z][A-Za-z0-9:\-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.\-]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label"}
DROPPED = {"script", "style", "noscript", "template", "nav", "aside", "footer", "form", "button", "select", "option", "textarea", "input", "iframe", "object", "embed", "svg", "canvas", "audio", "video", "dialog", "menu", "head", "title", "datalist", "map", "math"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "status", "tablist"}
#: Elements that end an open p; elements that end an open one of their own kind.
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", "figure", "menu"}
OWN_KIND = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
#: Whole names that say that an element is no main text; a name that only begins like one (table-responsive, navy, search-algorithms) says nothing.
NAMES = set(
    "ad ads advert adverts advertisement advertisements advertising adsense ad-slot ad-container ad-banner ad-wrapper sponsor sponsors sponsored promo promos promotion banner cookie-banner"
    " nav navbar nav-bar navigation main-nav site-nav menu main-menu site-menu nav-menu breadcrumb breadcrumbs sidebar side-bar widget widgets footer site-footer page-footer masthead site-header siteheader page-header pageheader"
    " topbar top-bar toolbar cookie cookies cookie-notice cookie-consent cookie-bar consent gdpr popup modal newsletter newsletter-signup subscribe signup login share sharing share-buttons social social-share social-links"
    " related related-posts related-articles related-links recommended recommendations trending comment comments comment-list comment-form comments-area disqus disqus_thread respond replies pagination pager search-form search-box searchbox copyright paywall skip-link skip-to-content skip-nav".split()
)
#: Elements outside articles whose id is read too; ids of headings, sections and tables are made from their titles.
NAMED = {"div", "ul", "ol"}


class Node:
    """An element (or slot, key "#") of a page or wrapper. text: its constant, None for a slot; a hash of it if it is long; pages: hashes of different pages (by their text) in which it stands, SUPPORT at most."""

    __slots__ = ("key", "kids", "optional", "pages", "repeated", "text")

    def __init__(self, key: str, text: str | None = None, pages: tuple[int, ...] = ()):
        self.key, self.text, self.kids, self.optional, self.repeated, self.pages = key, text, [], False, False, pages

    def __getstate__(self):
        return (self.key, self.text, self.kids, self.optional, self.repeated, self.pages)

    def __setstate__(self, held):
        self.key, self.text, self.kids, self.optional, self.repeated, self.pages = held


class Element:
    """An element of a parsed page; kids are elements and strings."""

    __slots__ = ("kids", "out", "tag", "key")

    def __init__(self, tag: str, key: str, out: bool):
        self.tag, self.key, self.out, self.kids = tag, key, out, []


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /\n\t") else {}


def parse(page: str) -> Element:
    """The elements of a page."""
    root = Element("", "", False)
    stack, at, low = [root], 0, None
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            stack[-1].kids.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[0].startswith("<![CDATA["):
            stack[-1].kids.append(m[0][9:].removesuffix("]]>"))
            continue
        if m[1] is None:
            continue
        tag = m[1].lower()
        if m[0][1] == "/":
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                del stack[depth:]
            continue
        a = _attributes(m[2])
        inner = any(e.tag in ("article", "main") for e in stack)
        names = a.get("class", "").lower().split() + ([a.get("id", "").lower()] if tag in NAMED and not inner else [])
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        aloof = tag not in ("article", "main", "body", "html") and not NAMES.isdisjoint(names)
        e = Element(tag, f"{tag}.{a.get('class', '')}", tag in DROPPED or hidden or a.get("role", "").lower() in ROLES or aloof or (tag == "header" and not inner))
        if tag in BLOCKS and (i := next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p" or stack[i].tag in BLOCKS and stack[i].tag != "p"), 0)) and stack[i].tag == "p":
            del stack[i:]
        if tag in OWN_KIND:
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag or stack[i].tag in OWN_KIND[tag]), 0)
            if i and stack[i].tag == tag:
                del stack[i:]
        stack[-1].kids.append(e)
        if tag in RAW:
            low = page.lower() if low is None else low
            end = low.find(f"</{tag}", at)
            end = len(page) if end < 0 else end
            e.kids.append(page[at:end])
            at = page.find(">", end) + 1 or len(page)
        elif tag not in VOID and not m[2].endswith("/") and len(stack) < DEEPEST:
            stack.append(e)
    if at < len(page):
        stack[-1].kids.append(html.unescape(page[at:]))
    return root


def constant(text: str) -> str:
    """A text as a wrapper holds it: as it is up to 400 characters, else by a hash."""
    return text if len(text) <= 400 else "\0" + xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


def pattern(e: Element, pages: tuple[int, ...] | None = None) -> Node:
    """The wrapper of one page: its elements with repeated siblings folded."""
    if pages is None:
        pages = (xxhash.xxh3_64_intdigest(" ".join(text_of(e).split()).encode("utf-8", "surrogatepass")),)
    node = Node(e.key, None, pages)
    for k in e.kids:
        if isinstance(k, str):
            if (t := " ".join(k.split())) and not (node.kids and node.kids[-1].key == "#"):
                node.kids.append(Node("#", constant(t), pages))
            elif t:
                node.kids[-1].text = None
        elif k.tag not in INLINE or k.out:
            kid = pattern(k, pages)
            if node.kids and node.kids[-1].key == kid.key:
                align(node.kids[-1], kid)
                node.kids[-1].repeated = True
            else:
                node.kids.append(kid)
        elif not (node.kids and node.kids[-1].key == "#"):  # inline elements are part of a text
            t = " ".join(text_of(k).split())
            node.kids.append(Node("#", constant(t), pages))
        else:
            node.kids[-1].text = None
    return node


def align(a: Node, b: Node) -> Node:
    """a, made to match what b matches too."""
    a.optional |= b.optional
    a.repeated |= b.repeated
    if a.key == "#" and a.text != b.text:
        a.text = None
    if a.pages != b.pages and len(a.pages) < SUPPORT:
        a.pages = tuple(sorted({*a.pages, *b.pages}))[:SUPPORT]
    x, y = [k.key for k in a.kids], [k.key for k in b.kids]
    if x == y:
        for p, q in zip(a.kids, b.kids):
            align(p, q)
        return a
    out = []
    for op, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if op == "equal":
            out += [align(p, q) for p, q in zip(a.kids[i:j], b.kids[k:m])]
        else:
            for n in (*a.kids[i:j], *b.kids[k:m]):
                n.optional = True
                out.append(n)
    # What has come to lie next to its like is a repetition.
    a.kids = []
    for n in out:
        if a.kids and n.key != "#" and a.kids[-1].key == n.key:
            align(a.kids[-1], n)
            a.kids[-1].repeated = True
        else:
            a.kids.append(n)
    return a


def expression(n: Node) -> str:
    """The wrapper as a regular expression over tokens, for reading."""
    if n.key == "#":
        return "#" if n.text is None else f"{n.text!r}"
    inside = " ".join(("(" + expression(k) + ")" + "?" * k.optional + "+" * k.repeated) if k.optional or k.repeated else expression(k) for k in n.kids)
    return f"<{n.key}> {inside} </>" if n.key else inside


def text_of(e: Element | str) -> str:
    """All text of an element that is kept; blocks are set apart by white space."""
    if isinstance(e, str):
        return e
    if e.out:
        return " "
    inside = "".join(text_of(k) for k in e.kids)
    return inside if e.tag in INLINE else f" {inside} "


def template_out(e: Element, n: Node | None) -> None:
    """Takes the template's constant texts out of a page that is read against its wrapper; articles stay whole."""
    if n is None or e.tag in ("article", "main"):
        return
    at, kids = 0, n.kids
    kept = []
    for k in e.kids:
        key = "#" if isinstance(k, str) else k.key
        if isinstance(k, str) and not k.strip():
            kept.append(k)
            continue
        i = next((i for i in range(at, len(kids)) if kids[i].key == key), None)
        if i is None:
            kept.append(k)
            if not isinstance(k, str) and k.tag not in INLINE:
                template_out(k, None)
            continue
        at = i
        if isinstance(k, str):
            if kids[i].text is not None and len(kids[i].pages) >= SUPPORT and constant(" ".join(k.split())) == kids[i].text:
                kept.append(" ")
                continue
        else:
            template_out(k, kids[i])
        kept.append(k)
    e.kids = kept


def _outer(e: Element, tag: str) -> Iterator[Element]:
    """The kept elements of a tag that stand in no other one of it."""
    if e.out:
        return
    if e.tag == tag:
        yield e
        return
    for k in e.kids:
        if not isinstance(k, str):
            yield from _outer(k, tag)


def main_text(page: str | None, wrapper: Node | None = None) -> str:
    """The main text of a page, in view of its host's wrapper."""
    if not page:
        return ""
    root = parse(page)
    if wrapper is not None and len(wrapper.pages) >= SUPPORT:
        template_out(root, wrapper)
    found = list(_outer(root, "article")) or list(_outer(root, "main")) or [root]
    return " ".join(" ".join(text_of(e) for e in found).split())


def merged(blobs: list[bytes]) -> Node:
    first, *rest = map(pickle.loads, blobs)
    for n in rest:
        align(first, n)
    return first


def inferred(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, wrapper): the wrapper of every host, over all its pages."""
    read = pages.select(F.coalesce(host_of(F.col(f"`{url}`")), F.lit("")).alias("host"), F.col(f"`{page}`").alias("__text")).where("__text IS NOT NULL")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Node] = {}
        for b in slices(batches, "__text"):
            for h, t in zip(ids_of(b, "host").to_pylist(), ids_of(b, "__text").to_pylist()):
                n = pattern(parse(t))
                held[h] = align(held[h], n) if h in held else n
        for h, n in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([pickle.dumps(n, 5)], pa.binary())], ["host", "wrapper"])

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (h, *_), t in grouped(batches, ["host"]):
            yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([pickle.dumps(merged(t.column("wrapper").to_pylist()), 5)], pa.binary())], ["host", "wrapper"])

    kind = "host string, wrapper binary"
    parts = read.mapInArrow(one, kind).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    first = parts.repartition("host", "part").sortWithinPartitions("host").select("host", "wrapper").mapInArrow(some, kind)
    return first.repartition("host").sortWithinPartitions("host").mapInArrow(some, kind)


def extracted(pages: DataFrame, url: str = "url", page: str = "html", carry: list[str] | None = None) -> DataFrame:
    """pages (the columns of carry; all) with text, the main text, and n_chars, its code points."""
    own = [c for c in (pages.columns if carry is None else carry) if c not in ("text", "n_chars")]
    known = stored(inferred(pages, url, page), "wrappers")
    read = numbered_columns(pages, own, __host=F.coalesce(host_of(F.col(f"`{url}`")), F.lit("")), __text=F.col(f"`{page}`"))
    schema = T.StructType(own_fields(pages, own) + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    small = (known.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0) <= BROADCAST_BYTES
    if small:
        held = pages.sparkSession.sparkContext.broadcast({r.host: bytes(r.wrapper) for r in known.toLocalIterator()})
        source = read
    else:
        held = None
        source = read.join(known.select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper")), "__host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, Node | None] = {}
        for b in slices(batches, "__text"):
            hosts = ids_of(b, "__host").to_pylist()
            blobs = None if held is not None else ids_of(b, "__wrapper")
            texts = []
            for i, (h, t) in enumerate(zip(hosts, ids_of(b, "__text").to_pylist())):
                if h not in opened:
                    if len(opened) > 1000:
                        opened.clear()
                    raw = held.value.get(h) if held is not None else blobs[i].as_py()
                    opened[h] = pickle.loads(raw) if raw is not None else None
                texts.append(main_text(t, opened[h]))
            yield pa.RecordBatch.from_arrays([*own_arrays(b, len(own)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*own, "text", "n_chars"])

    return source.mapInArrow(run, schema)
