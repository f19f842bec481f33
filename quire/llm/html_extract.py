"""Main text of web pages by removing what their site repeats.

Pass one hashes the element subtrees of every page and Spark counts, for each
host, on how many of its pages a hash occurs. Subtrees that recur on many pages
of their host are its template. Pass two deletes them and writes the blocks of
what is left of every article and main part, in page order.

A subtree is hashed at two grains: as it is, and by its shape, which is its tags,
names and links without the text, where equal children count once. So a menu, a
notice or an advert is found though its words differ from page to page. The shape
counts beside the part that holds most of the page's text, and for blocks of links;
inside articles only equal wrappers count, for a sentence, list or table that many
articles quote is still text. What holds most of its page or article never goes, so
that copies of a page don't delete each other. Tags, roles and class names that say
an element is no article text are a second guard, for hosts of few pages; a class
or id only speaks of wrappers and removes nothing that holds half of the page's text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table

#: A subtree is template from so many pages of its host on, and from this share of them; from MANY_PAGES on whatever the share.
MIN_PAGES, MIN_SHARE, MANY_PAGES = 5, 0.2, 100
#: Up to so many template hashes are broadcast; more are joined by a shuffle with the hosts salted.
BROADCAST_TEMPLATES = 500_000
SALTS = 16

_WORDS = lambda s: frozenset(s.split())
#: Kinds of elements.
VOID = _WORDS("area base br col embed hr img input link meta param source track wbr")
RAW = _WORDS("script style noscript template textarea title iframe")
BLOCK = _WORDS(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul"
)
NO_TEXT = _WORDS("head script style noscript template textarea title iframe nav footer aside form button select input svg canvas object video audio dialog menu fieldset label")
NO_ROLE = _WORDS("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar")
NO_CLASS = _WORDS(
    "ad ads advert adverts advertisement advertising sponsored promo promotion banner cookie cookies consent gdpr newsletter subscribe signup sidebar sidenav "
    "menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus replies widget popup modal overlay footer masthead toolbar pagination pager login paywall"
)
#: Parts of a class or id after one of these say what the page has, or lacks, or is filed under; not what the element is.
ABOUT = _WORDS("has have no not with without tag category cat")
#: Of an article only wrappers can be template: its lists, tables and paragraphs may be quoted by many pages.
WRAPPERS = _WORDS("div section aside header footer details center hgroup address")
#: Elements whose class or id is heeded, and those that are template though they hold no text.
NAMED = WRAPPERS | _WORDS("ul ol dl table article")
EMPTY = _WORDS("nav footer aside form")
#: An open element that ends where one of these begins.
ENDS = {"li": _WORDS("li"), "dt": _WORDS("dt dd"), "dd": _WORDS("dt dd"), "tr": _WORDS("tr tbody tfoot"), "td": _WORDS("td th tr tbody tfoot"), "th": _WORDS("td th tr tbody tfoot"), "option": _WORDS("option")}
#: Where the search for such an element stops.
SCOPE = _WORDS("ul ol dl table select")
CLOSES_P = BLOCK - _WORDS("option caption td th tr tbody thead tfoot title head body html")

#: A block of links: at least so many of them, with this share of its text.
MANY_LINKS, LINK_SHARE = 2, 0.8

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_UNQUOTED = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}


class Node:
    __slots__ = ("article", "attrs", "children", "key", "link", "links", "parent", "plain", "shape", "size", "tag", "text", "within")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.key = self.shape = self.size = self.text = self.plain = self.link = self.links = 0
        #: Inside an article or main part; inside the part that holds most of the page's text.
        self.article = parent is not None and (parent.article or parent.tag in ("article", "main"))
        self.within = False


def markup(source: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of tags, comments and declarations (these two without a name), in linear time.

    The caller may send the place to go on from. A quoted value may hold >; where
    quotes don't close before the end, the first > ends a tag.
    """
    at, size, plain_from = 0, len(source), len(source) + 1
    while (start := source.find("<", at)) >= 0:
        at = start + 1
        m = _NAME.match(source, at)
        if m is None:
            if source.startswith("!--", at):
                end = source.find("-->", at + 3)
                end = size if end < 0 else end + 3
            elif source[at : at + 1] in ("!", "?"):
                end = source.find(">", at) + 1
                if not end:
                    return
            else:
                continue
            at = (yield start, end, "", "") or end
            continue
        place = m.end()
        while start < plain_from:
            place = _UNQUOTED.match(source, place).end()
            if place >= size:
                plain_from = start
            elif source[place] == ">":
                break
            else:
                place = source.find(source[place], place + 1) + 1 or size
        if start >= plain_from:
            place = source.find(">", m.end())
            if place < 0:
                return
        at = (yield start, place + 1, m[0], source[m.end() : place]) or place + 1


def parse(source: str) -> list[Node]:
    """The elements of a page in page order, the root first; end tags may be missing, stray ones are ignored."""
    nodes = [Node("#root")]
    stack, opened, at = nodes[:], Counter(), 0

    def close(k: int) -> None:
        opened.subtract(n.tag for n in stack[k:])
        del stack[k:]

    found, goto = markup(source), None
    while True:
        try:
            start, end, tag, attrs = found.send(goto)
        except StopIteration:
            break
        goto = None
        if start > at:
            stack[-1].children.append(source[at:start])
        at = end
        tag = tag.lower()
        if not tag:
            continue
        if tag[0] == "/":
            if opened[tag[1:]] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag[1:]))
            continue
        if tag in CLOSES_P and opened["p"] > 0:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "p" or stack[k].tag in BLOCK), 0)
            if stack[k].tag == "p":
                close(k)
        if (tag in ENDS or tag in ("tbody", "tfoot")) and any(opened[t] > 0 for t in ENDS):
            k = next((k for k in range(len(stack) - 1, 0, -1) if tag in ENDS.get(stack[k].tag, ()) or stack[k].tag in SCOPE), 0)
            if tag in ENDS.get(stack[k].tag, ()):
                close(k)
        node = Node(tag, attrs, stack[-1])
        nodes.append(node)
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            m = _RAW_END[tag].search(source, at)
            goto = m.start() if m else len(source)
            node.children.append(source[at:goto])
            at = goto
        if not attrs.endswith("/") or tag in BLOCK:
            stack.append(node)
            opened[tag] += 1
    if at < len(source):
        stack[-1].children.append(source[at:])
    return nodes


def _named(attrs: str) -> tuple[set[str], str]:
    """(parts of class and id in lower case, role)."""
    parts, role = set(), ""
    for m in _ATTR.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            role = value.strip().lower()
        else:
            for token in value.split():
                for part in _PART.findall(token):
                    if part.lower() in ABOUT:
                        break
                    parts.add(part.lower())
    return parts, role


def _no_article(node: Node, inside: bool, whole: int) -> bool:
    """Whether the element is something other than text of the article; whole is the text of the page."""
    tag = node.tag
    if tag in NO_TEXT:
        return True
    if tag == "header" and not inside:
        return True
    if tag in ("html", "body", "main", "#root") or not node.attrs:
        return False
    parts, role = _named(node.attrs)
    if role in NO_ROLE or "hidden" in node.attrs.lower().split():
        return True
    if tag not in NAMED or 2 * node.text >= whole:
        return False
    return bool(parts & NO_CLASS) or ("header" in parts and not inside and tag != "article")


def measure(nodes: list[Node]) -> list[Node]:
    """Set hash, shape and sizes of every subtree, whatever its white space, and what lies within the main part.

    A node's text counts the characters outside elements that never hold text of an
    article; plain those that a browser shows, outside links.
    """
    for n in reversed(nodes):
        h, shapes = xxhash.xxh64(f"{n.tag} {' '.join(n.attrs.split())}"), set()
        for c in n.children:
            if isinstance(c, str):
                words = c.split()
                if words:
                    h.update(" ".join(words))
                    size = sum(map(len, words))
                    n.size += size
                    n.text += size
                    n.plain += size
                    shapes.add(0)
            else:
                h.update(c.key.to_bytes(8, "little"))
                n.size += c.size
                n.text += c.text
                n.plain += c.plain
                n.link += c.link
                n.links += c.links
                shapes.add(c.shape if c.tag in BLOCK or c.tag == "a" else 0)
        if n.tag == "a":
            n.link, n.links = n.size, 1
        if n.tag == "a" or n.tag in RAW:
            n.plain = 0
        if n.tag in NO_TEXT:
            n.text = 0
        n.key = h.intdigest()
        names = sorted(part for part in _named(n.attrs)[0] if not part.isdigit()) if n.attrs else []
        n.shape = xxhash.xxh64_intdigest(repr((n.tag, names, sorted(shapes))), 1)
    # The part that holds most of the text beside links, as deep as there is one.
    main, root = nodes[0], nodes[0]
    while deeper := next((c for c in main.children if isinstance(c, Node) and c.plain and 2 * c.plain >= root.plain), None):
        main = deeper
    path = set()
    above = main
    while above is not None:
        path.add(id(above))
        above = above.parent
    for n in nodes[1:]:
        n.within = n.parent.within or n.parent is main
        if id(n) in path:
            n.shape = 0
    return nodes


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def grains(n: Node) -> list[int]:
    """Signed 64-bit hashes by which a subtree may be template, if it may at all."""
    if n.tag not in BLOCK or n.tag in ("html", "body", "article", "main", "head") or not (n.size or n.tag in EMPTY):
        return []
    if n.article:
        return [_signed(n.key)] if n.tag in WRAPPERS else []
    linked = n.links >= MANY_LINKS and n.link >= LINK_SHARE * n.size
    return [_signed(n.key), _signed(n.shape)] if n.shape and (linked or not n.within) else [_signed(n.key)]


def subtree_hashes(source: str) -> set[int]:
    """The hashes of the subtrees of a page that may be template."""
    return {k for n in measure(parse(source)) for k in grains(n)}


_FLUSH = object()


def main_text(source: str, template: frozenset[int] | set[int] = frozenset(), guards: bool = True) -> str:
    """Blocks of the articles and main parts of a page, or of the page if it has none, without template.

    A subtree goes if one of its hashes is in template and it holds no more than half
    of its page, or of the outermost article around it. Without guards that is all
    that goes, besides what a browser never shows.
    """
    nodes = measure(parse(source))
    root = nodes[0]

    def out(n: Node, inside: bool) -> bool:
        return _no_article(n, inside, root.text) if guards else n.tag in RAW or n.tag == "head"

    regions: list[Node] = []
    todo = [root] if guards else []
    while todo:
        n = todo.pop()
        if n is not root and out(n, False):
            continue
        if n.tag in ("article", "main") or n.attrs and _named(n.attrs)[1] == "main":
            regions.append(n)
        else:
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))
    in_article = bool(regions)
    blocks: list[str] = []
    line: list[str] = []
    # Nodes that are left to write, with the size that theirs is held against and whether they are in an article.
    left: list = []
    for region in reversed(regions or [root]):
        left += [_FLUSH, (region, region.size, region.tag == "article", True)]
    while left:
        now = left.pop()
        if now is _FLUSH:
            text = " ".join(entities.unescape("".join(line)).split())
            line.clear()
            if text:
                blocks.append(text)
        elif isinstance(now, str):
            line.append(now)
        else:
            n, whole, within, first = now
            if not first:
                if n.tag in ("br", "wbr"):
                    line.append(" " if n.tag == "br" else "")
                    continue
                if out(n, in_article) or (template and 2 * n.size <= whole and not template.isdisjoint(grains(n))):
                    continue
            # A container is held against the outermost article around it.
            if n.tag == "article" and not within:
                whole, within = n.size, True
            if n.tag in BLOCK:
                left.append(_FLUSH)
            left.extend(c if isinstance(c, str) else (c, whole, within, False) for c in reversed(n.children))
            if n.tag in BLOCK:
                left.append(_FLUSH)
    text = " ".join(entities.unescape("".join(line)).split())
    return "\n\n".join([*blocks, text] if text else blocks)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1))


def find_templates(pages: DataFrame) -> DataFrame:
    """(host, subtrees): for each host the hashes that recur on its pages.

    Counts are over all pages. Each page sends a hash once; Spark adds up before
    the shuffle, so a host with a third of all pages is no hot key. The list of a
    host holds at most (subtrees of a page) / MIN_SHARE hashes on average, or where
    it has more than MANY_PAGES / MIN_SHARE pages, (subtrees of its pages) / MANY_PAGES.
    """

    def hashes(batches):
        for b in batches:
            hosts, keys = [], []
            for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                found = subtree_hashes(source or "")
                keys.extend(found)
                hosts.extend([host] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64())], ["host", "subtree"])

    seen = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(hashes, "host string, subtree long")
    counts = seen.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    hosts = pages.select(host_of(F.col("url")).alias("host")).groupBy("host").agg(F.count("*").alias("pages"))
    often = counts.join(hosts, "host").where((F.col("n") >= MIN_SHARE * F.col("pages")) | (F.col("n") >= MANY_PAGES))
    return often.groupBy("host").agg(F.collect_set("subtree").alias("subtrees"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each of pages.

    A null page, and one without an article's text, has an empty text. Pages
    without a readable URL share the empty host; a null page_id stays null. Repeated
    pages repeat. All articles and main parts are written, in page order, however
    many, deep or long; a page takes time and memory in proportion to its length.
    Other columns of pages are not read. An empty table gives none.
    """
    small_batches(pages.sparkSession)
    templates = stored(find_templates(pages), "templates")
    size = templates.agg(F.coalesce(F.sum(F.size("subtrees")), F.lit(0)).alias("n")).first()["n"]
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    if size <= BROADCAST_TEMPLATES:
        joined = rows.join(F.broadcast(templates), "host", "left")
    else:
        salted = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def texts(batches):
        known: dict[str, frozenset[int]] = {}
        for b in batches:
            out = []
            template_col = b.column("subtrees")
            for i, (host, source) in enumerate(zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True)):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = frozenset(template_col[i].as_py() or ())
                out.append(main_text(source or "", known[host]))
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id").cast(pa.int64()), b.column("url").cast(pa.string()), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return joined.select("page_id", "url", "html", "host", "subtrees").mapInArrow(texts, "page_id long, url string, text string, n_chars long")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
