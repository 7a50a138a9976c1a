"""Main text of web pages by composite text density.

Every node of a page's tree gets a density: its characters per tag, lowered
where much of the text lies in links. A node's sum is that of its children's
densities. The node with the largest sum heads the main text, and the lowest
density on its path to the body is the threshold from which other parts count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom.llm.common import text_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# never text of a page
HIDDEN = frozenset("script style noscript template head title iframe object svg math canvas select option button textarea input form dialog".split())
# parts of a page that are not its article
FURNITURE = frozenset("nav footer aside menu".split())
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
# an opening tag of the first kind ends an open one of the second
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS |= dict.fromkeys(("thead", "tbody", "tfoot"), ("td", "th", "tr", "thead", "tbody", "tfoot"))
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SCOPES = frozenset("ul ol dl table body article section div td th aside nav main".split())
# words in class, id or role that name a part outside the article
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer masthead "
    "comment comments reply replies discussion disqus respond share sharing social related recommended pagination pager toolbar search complementary contentinfo".split()
)
# of these the ones that are also topics: as an id inside an article they may have been made from a heading
TOPICS = frozenset("ads advertisement advertisements sponsor promotion banner cookie cookies consent gdpr notice notices alert login navigation menu discussion share sharing social related recommended search".split())
STATES = frozenset("has no not with without is hide show".split())  # "has-sidebar" says something about a part, not what it is
BIG = frozenset("body html main article h1 h2 h3 h4 h5 h6".split())  # names on these remove nothing


class Node:
    __slots__ = ("tag", "kids", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "gone", "named")

    def __init__(self, tag, parent):
        self.tag, self.parent, self.kids = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.best = self
        self.gone = parent is not None and parent.gone  # a removed part or inside one
        self.named = ""  # kind of its name, if that is one of a part outside the article


def _pattern():
    """Comments, declarations and tags. A quoted value may hold anything if it ends soon; else the tag ends at the next bracket."""
    import re

    name, value = r"<(/?)([a-zA-Z][^\s/<>]*)", r"\"[^\"]{0,4096}\"|'[^']{0,4096}'"
    return re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|{name}((?:[^<>\"']|{value})*+)>|{name}([^<>]*)>", re.S)


def _attributes(text: str) -> dict[str, str]:
    import re

    found = re.findall(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", text)
    out: dict[str, str] = {}
    for name, x, y, z in found:
        out.setdefault(name.lower(), x or y or z)  # of equal names the first holds
    return out


def _removed(tag: str, attributes: dict[str, str], open_tags) -> bool:
    """Is this part no text of the page, whatever it holds?"""
    import re

    if tag in HIDDEN or tag in FURNITURE:
        return True
    if tag == "header":
        return not {"article", "main"} & set(open_tags)
    if tag in ("body", "html", "main", "article") or not attributes:
        return False
    if not attributes.get("hidden", "false").lower().startswith(("false", "until")) or attributes.get("aria-hidden", "").lower() == "true":
        return True
    return re.search(r"(?:^|;)\s*display\s*:\s*none\b", attributes.get("style", ""), re.I) is not None


def _named(tag: str, attributes: dict[str, str], open_tags) -> str:
    """Kind of the name of a part outside the article: "part", or "topic" if it is only an id that may come from a heading; else empty."""
    import re

    if tag in BIG:
        return ""
    kind = ""
    for name in ("class", "id", "role"):
        for token in attributes.get(name, "").split():
            words = {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", token)}
            if words & STATES:
                continue
            hits = words & NAMES
            if "header" in words and tag == "div" and not {"article", "main"} & set(open_tags) or hits and (name != "id" or hits - TOPICS):
                return "part"
            kind = "topic" if hits else kind
    return kind


def tree(page: str):
    """Root of the page's tree. Children are nodes and strings; removed parts are left out.

    Removed parts are read by the same rules as the others, so that they end where a browser ends them.
    """
    import html
    import re

    pattern, root = _pattern(), Node("html", None)
    here, at = root, 0

    def add(text):
        if text and not here.gone:
            here.kids.append(html.unescape(text))

    n = len(page)
    while at < n:
        m = pattern.search(page, at)
        if m is None:
            add(re.sub(r"<[/!a-zA-Z][^<>]*\Z", "", page[at:]))  # without a tag that the end cuts off
            break
        add(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            node = here
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                here = node.parent
            continue
        closed = tag in VOID or attributes.endswith("/") and tag not in ENDS_PARAGRAPH and tag not in RAW and tag not in INLINE
        if tag in RAW and not closed:  # its content is no markup
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in ENDS_PARAGRAPH or tag in ENDS:
            ends, node = (*ENDS.get(tag, ()), *(("p",) if tag in ENDS_PARAGRAPH else ())), here
            while node is not None and node.tag not in ends and (node.tag in INLINE or node.tag == "p" or node.tag not in SCOPES):
                node = node.parent
            if node is not None and node.tag in ends and node.parent is not None:
                here = node.parent
                while tag[0] == "t" and tag not in ("td", "th") and here.tag in ENDS.get(tag, ()):  # a row ends the cell and its row
                    here = here.parent
        if tag == "html":
            continue
        node = Node(tag, here)
        if not node.gone:
            values = _attributes(attributes) if attributes else {}
            node.gone = _removed(tag, values, _path(here))
            node.named = _named(tag, values, _path(here)) if values and not node.gone else ""
        if not node.gone:
            here.kids.append(node)
        if not closed:
            here = node
    return root


def _path(node):
    while node is not None:
        yield node.tag
        node = node.parent


def _nodes(root):
    """All nodes, every one before its children."""
    order = [root]
    for node in order:
        order.extend(k for k in node.kids if isinstance(k, Node))
    return order


def _measure(root: Node) -> Node:
    """Densities of all nodes, sums, and the densest node below each; returns the body."""
    from math import e, log

    order = _nodes(root)
    linked = set()
    for node in order:
        if node.tag == "a" or (node.parent is not None and id(node.parent) in linked):
            linked.add(id(node))
    for node in reversed(order):
        own = sum(len("".join(k.split())) for k in node.kids if isinstance(k, str))
        kids = [k for k in node.kids if isinstance(k, Node)]
        node.best = node
        node.chars = own + sum(k.chars for k in kids)
        node.tags = sum(k.tags + 1 for k in kids)
        if id(node) in linked:
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        else:
            node.link_chars, node.link_tags = sum(k.link_chars for k in kids), sum(k.link_tags for k in kids)
    body = next((x for x in order if x.tag == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        if c:
            base = log(c / max(1, c - lc) * lc + share * c + e)
            node.density = c / t * max(0.0, log(max(1.0, c / max(1, lc) * t / lt)) / base if base > 0 else 0.0)
        kids = [k for k in node.kids if isinstance(k, Node)]
        node.total = sum(k.density for k in kids)
        node.best = max([node, *(k.best for k in kids)], key=lambda x: x.total)
    return body


def _prune(root: Node) -> None:
    """Take out the parts whose name says that they are not of the article.

    A name does not outweigh what a part holds: the article or main of the
    page, its only heading, or, where no such element lies outside named parts,
    its densest text. An id that may come from a heading counts inside an
    article only for parts below the density of the rest.
    """
    order = _nodes(root)
    if not any(x.named for x in order):
        return
    body = _measure(root)
    inside, article = set(), set()  # below a name; in an article
    for node in order:
        up = node.parent
        if node.named or up is not None and id(up) in inside:
            inside.add(id(node))
        if node.tag in ("article", "main") or up is not None and id(up) in article:
            article.add(id(node))
    marked = [x for x in order if x.tag in ("article", "main") and x.chars]
    titles = [x for x in order if x.tag == "h1" and x.chars]
    free = [x for x in marked if id(x) not in inside]
    held = [] if free else marked
    if not any(id(x) not in inside for x in titles):
        held = held + titles
    if not marked:
        held = held + [body.best]
    keep = set()
    for node in held:
        while node is not None and id(node) not in keep:
            keep.add(id(node))
            node = node.parent
    gone = set()
    for node in order:
        if node.named and id(node) not in keep:
            if node.named == "topic" and id(node) in article:
                up = next(x for x in _up(node.parent) if x.tag in ("article", "main"))
                if node.density >= up.density or node.best.total >= up.total / 2:
                    continue
            gone.add(id(node))
    for node in order:
        if node.kids:
            node.kids = [k for k in node.kids if id(k) not in gone]


def main_nodes(root: Node) -> list[Node]:
    """Heads of the main text, in no particular order."""
    body = _measure(root)
    top = body.best
    if not top.chars:
        top = body
    path, limit = top, top.density
    while path is not None and path is not body:
        limit = min(limit, path.density)
        path = path.parent
    limit = min(limit, body.density)
    heads, seen = [], set()
    stack = [body]
    while stack:
        node = stack.pop()
        if node.density < limit or id(node) in seen:
            continue
        best = node.best if node.best.chars else node
        if id(best) not in seen:
            best = next((x for x in _up(best) if x.tag in ("article", "main")), best)  # the part that the page itself marks as its article
            heads.append(best)
            seen |= {id(x) for x in _nodes(best)}
        stack += [k for k in node.kids if isinstance(k, Node)]
    return heads


def _up(node):
    while node is not None:
        yield node
        node = node.parent


def text_of(page: str) -> str:
    """Main text: blocks with single spaces inside, in page order, joined by one space."""
    root = tree(page)
    _prune(root)
    heads = {id(x) for x in main_nodes(root)}
    out: list[str] = []
    stack = [(root, False)]
    while stack:
        item, inside = stack.pop()
        if isinstance(item, str):
            if inside:
                out.append(item)
            continue
        inside = inside or id(item) in heads
        edge = [(" ", inside)] if item.tag not in INLINE else []
        stack += edge + [(k, inside) for k in reversed(item.kids)] + edge
    return " ".join("".join(out).split())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) per row. NULL or empty html, or html without text, gives an empty text; repeated rows are extracted each."""

    def task(batches):
        import pyarrow as pa

        for b in text_batches(batches, 64):
            found = [text_of(x) for x in b.column(2).to_pylist()]
            cols = [b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(task, f"id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars bigint")


def query(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")
