"""Operator 8, main text of web pages by site template removal.

First pass: each page is parsed to a tree; every block element's subtree is
hashed by its tags and text. Spark counts, for each host, on how many pages
with different content each hash occurs. Subtrees on ``MIN_PAGES`` pages at
least and on ``SHARE`` of the host's pages are the site's template. Second
pass: they are deleted together with what HTML itself marks as not being the
article (navigation, page headers, footers, forms, scripts, and elements with a
class, id or role that says nothing but advert, notice, comment and the like;
a paragraph or heading needs a word that cannot be the article's own). If
article elements hold ``LEAST`` of the text that is left, their text is
returned, else that of main in the same way, else of the body.

Copies of one page count once, so mirrored articles are no template. A host
has at most twice as many template subtrees as its mean page has subtrees,
because each lies on half of its pages; the lists of all hosts are broadcast
only if they are small.

Defined results: null or empty html gives the empty text; a null url gives a
page of no host, whose template is unknown; ids pass through untouched, null
ones too; pages may be nested or long at will (no recursion; each element is
hashed once); repeated rows each get a row and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

MIN_PAGES = 5
SHARE = 0.5
#: Share of the remaining text that article (or main) elements hold if they are the article.
LEAST = 0.25
#: Share of a page's text from which a form is a wrapper of the page, and share of main's text below which article elements are teasers.
WRAPPER, WHOLE = 0.5, 0.5

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "tfoot thead tr ul caption".split()
)
NEVER = frozenset(
    "script style noscript template head title meta link nav footer aside button select input textarea iframe svg "
    "canvas object embed audio video dialog menu map noframes noembed datalist".split()
)
CLOSES_P = BLOCK - {"body", "html", "option", "optgroup", "tbody", "thead", "tfoot", "tr", "caption", "legend"}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial adsense adslot adbox sponsor sponsored sponsors promo promos promotion "
    "promoted banner cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login popup modal overlay "
    "sidebar sidebars aside nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs footer foot masthead topbar comment "
    "comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations pagination "
    "pager widget widgets toolbar skip skiplink paywall alert announcement".split()
)
#: Of these, words that may as well say what a paragraph of an article is about.
WEAK = frozenset("promotion banner notice notices aside foot reply replies respond discussion share sharing social related recommended recommendations alert announcement subscription skip".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption summary details".split())
#: Words that tell where or how something lies, beside which a mark keeps its meaning.
PLACE = frozenset(
    "site page top bottom left right main primary secondary global local mobile desktop sticky fixed first last box block list wrap wrapper container "
    "section inner outer item items area bar row col column panel group holder slot unit form thread posts links link text content body js id".split()
)
ABOUT_PAGE = frozenset("has with without no".split())  # of classes like with-sidebar, which tell of the page
CONTENT = frozenset("article content post entry story main body text".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("attrs", "digest", "full", "kids", "size", "tag")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.kids, self.digest, self.full, self.size = tag, attrs, [], "", False, 0

    def get(self) -> dict[str, str]:
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(self.attrs)} if self.attrs.strip() else {}


def parse(page: str) -> Node:
    """A tree of the page; elements left open end where their parent ends or HTML implies their end.

    Each element gets a digest of its subtree's tags and text, and how much text there is.
    """
    root = Node("html")
    stack, made, body = Stack(root), [root], False
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = name.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if stack.has(tag) else ():
                if stack[k].tag == tag:
                    stack.cut(k)
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK and stack[k].tag != "p":
                    break  # an inline end tag closes nothing beyond its block
            continue
        if tag == "html" or tag == "body" and body:
            if not root.attrs:
                root.attrs = m[3]
            continue
        if tag in CLOSES_P:
            _close(stack, ("p",), ("button", "td", "th", "li", "div", "section", "article", "blockquote"))
        if tag == "li":
            _close(stack, ("li",), ("ul", "ol", "menu", "dir"))
        elif tag in ("dt", "dd"):
            _close(stack, ("dt", "dd"), ("dl",))
        elif tag in ("td", "th"):
            _close(stack, ("td", "th"), ("tr", "table"))
        elif tag == "tr":
            _close(stack, ("tr",), ("table", "tbody", "thead", "tfoot"))
        elif tag in ("tbody", "thead", "tfoot"):
            _close(stack, ("tbody", "thead", "tfoot"), ("table",))
        elif tag == "option":
            _close(stack, ("option",), ("select", "datalist"))
        elif tag == "body":
            _close(stack, ("head",), ())
            body = True
        node = Node(tag, m[3])
        stack[-1].kids.append(node)
        made.append(node)
        if tag in VOID or m[3].rstrip().endswith("/") and tag in ("svg", "path", "use"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue  # raw text is never part of the article
        stack.push(node)
    for node in reversed(made):  # what an element holds was made after it
        h = hashlib.blake2b(digest_size=8)
        h.update(node.tag.encode())
        for kid in node.kids:
            h.update(b"<" + kid.digest.encode() if isinstance(kid, Node) else b"=" + " ".join(kid.split()).encode("utf-8", "replace"))
            node.size += kid.size if isinstance(kid, Node) else len(kid.strip())
        node.full = node.size > 0
        node.digest = h.hexdigest()
    for node in made:
        if node.tag == "form" and node.size >= WRAPPER * root.size:
            node.tag = "div"
    return root


class Stack(list):
    """The open elements, and how many of each name are open, so that an end tag without a beginning costs nothing."""

    def __init__(self, root: Node) -> None:
        super().__init__([root])
        self.names = Counter()

    def push(self, node: Node) -> None:
        self.append(node)
        self.names[node.tag] += 1

    def cut(self, k: int) -> None:
        """The elements from the k-th on end."""
        self.names.subtract(n.tag for n in self[k:])
        del self[k:]

    def has(self, *names: str) -> bool:
        return any(self.names[n] > 0 for n in names)


def _close(stack: Stack, names: tuple[str, ...], walls: tuple[str, ...]) -> None:
    for k in range(len(stack) - 1, 0, -1) if stack.has(*names) else ():
        if stack[k].tag in names:
            stack.cut(k)
            return
        if stack[k].tag in walls:
            return


def marked(node: Node, inside: bool) -> bool:
    """Whether HTML itself says that this element is not the article. ``inside``: it lies in an article."""
    tag = node.tag
    if tag in NEVER or tag == "form" or tag == "header" and not inside:
        return True
    if not node.attrs or tag in ("html", "body"):
        return False
    a = node.get()
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return True
    if a.get("role", "").lower() in ROLES:
        return True
    tokens = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
    if tag in ("article", "main") and not inside:
        return bool({x for t in tokens for x in _PARTS.split(t)} & {"comment", "comments", "reply", "related", "ad", "advert", "sponsored", "promo"})
    said = MARKS - WEAK if tag in TEXTUAL else MARKS
    for token in tokens:
        own = {x for x in _PARTS.split(token) if x and not x.isdigit()}
        if own & said and own <= MARKS | PLACE and not own & ABOUT_PAGE:
            return True
    names = {x for t in tokens for x in _PARTS.split(t)}
    return "header" in names and tag not in TEXTUAL and not inside and not names & CONTENT


def text_of(pieces: list[str]) -> str:
    return " ".join("".join(map(html.unescape, pieces)).split())


def number(node: Node) -> int:
    return int(node.digest, 16) - (1 << 63)


def subtrees(page: str) -> tuple[int, set[int]]:
    """The page's own hash and those of its block elements with text, what is marked anyway left out."""
    out: set[int] = set()
    todo = [(k, False) for k in parse(page).kids if isinstance(k, Node)]
    content: list[str] = []
    while todo:
        node, inside = todo.pop()
        if marked(node, inside):
            continue
        inside = inside or node.tag in ("article", "main")
        if node.tag in BLOCK and node.tag not in ("html", "body") and node.full:
            out.add(number(node))
            content.append(node.digest)
        todo += [(k, inside) for k in node.kids if isinstance(k, Node)]
    own = hashlib.blake2b("".join(sorted(content)).encode(), digest_size=8).hexdigest()
    return int(own, 16) - (1 << 63), out


def _roots(node: Node, names: tuple[str, ...], drop: frozenset[int]) -> list[Node]:
    """The outermost elements of these names that are neither marked nor template, in page order."""
    out, todo = [], [node]
    while todo:
        top = todo.pop()
        if top.tag in names or "main" in names and "role" in top.attrs and top.get().get("role") == "main":
            out.append(top)
            continue
        todo += [k for k in reversed(top.kids) if isinstance(k, Node) and not marked(k, k.tag in names) and not (drop and k.tag in BLOCK and number(k) in drop)]
    return out


def blocks_of(tops: list[Node], inside: bool, drop: frozenset[int]) -> list[str]:
    """The texts of the blocks of these elements, in page order."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line and (text := text_of(line)):
            blocks.append(text)
        line.clear()

    for top in tops:
        todo: list = [iter(top.kids)]
        while todo:
            kid = next(todo[-1], None)
            if kid is None:
                todo.pop()
                continue
            if isinstance(kid, str):
                line.append(kid)
            elif kid is FLUSH:
                flush()
            elif kid.tag == "br":
                line.append(" ")
            elif not marked(kid, inside) and not (drop and kid.tag in BLOCK and number(kid) in drop):
                if kid.tag in BLOCK:
                    flush()
                    todo.append(iter((FLUSH,)))
                elif kid.tag in ("td", "th"):
                    line.append(" ")
                todo.append(iter(kid.kids))
        flush()
    return blocks


def main_text(page: str | None, drop: frozenset[int] = frozenset()) -> str:
    """The article's blocks joined by two line ends; ``drop`` has the template's subtree hashes."""
    if not page:
        return ""
    root = parse(page)
    article, main = (blocks_of(_roots(root, names, drop), True, drop) for names in (("article",), ("main",)))
    if main and sum(map(len, article)) < WHOLE * sum(map(len, main)):
        article, main = main, article
    if not article and not main:
        return "\n\n".join(blocks_of([root], False, drop))
    whole = blocks_of([root], False, drop)
    for blocks in (article, main):
        if blocks and sum(map(len, blocks)) >= LEAST * sum(map(len, whole)):
            return "\n\n".join(blocks)
    return "\n\n".join(whole)


FLUSH = Node("flush")


def _host(url: Column) -> Column:
    """The host of a url, in lower case; null if it has none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def templates(pages: DataFrame) -> DataFrame:
    """host and the array of its template subtrees' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, page in zip(batch.column("host"), batch.column("html"), strict=True):
                if text := page.as_py():
                    own, found = subtrees(text)
                    rows += [(host.as_py(), own, x) for x in found]
                    rows.append((host.as_py(), own, None))  # the page itself
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["host", "page", "subtree"])

    known = pages.select(_host(F.col("url")).alias("host"), "html").where(F.col("host").isNotNull())
    seen = known.mapInArrow(shared.lean(run), "host string, page long, subtree long").distinct()
    counts = shared.written(seen.groupBy("host", "subtree").agg(F.count("*").alias("n")), "html-counts")
    sizes = counts.where("subtree is null").select("host", F.col("n").alias("pages"))
    often = counts.where((F.col("n") >= MIN_PAGES) & F.col("subtree").isNotNull()).join(sizes, "host")
    return often.where(F.col("n") >= SHARE * F.col("pages")).groupBy("host").agg(F.collect_list("subtree").alias("drop"))


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its number of code points, of every row."""
    shared.small_batches(pages.sparkSession, rows=500, size=8 << 20)
    found = shared.written(templates(pages), "html-templates")
    size = found.agg(F.coalesce(F.sum(8 * F.size("drop") + 64), F.lit(0))).first()[0]
    left = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"))
    joined = left.join(F.broadcast(found) if size <= shared.BROADCAST_BYTES else found, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), frozenset(drop.as_py() or ())) for page, drop in zip(batch.column("html"), batch.column("drop"), strict=True)]
            columns = [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "drop").mapInArrow(shared.lean(run), SCHEMA)
