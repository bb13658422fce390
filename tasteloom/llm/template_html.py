"""Main text of web pages, with site templates removed.

A page is parsed into an element tree. Two rules delete subtrees:

* templates: every container of the page, inside and outside the article, is hashed with its whole subtree;
  Spark counts on how many distinct articles of a host each hash appears, and subtrees that recur on a share of
  ``TEMPLATE_SHARE`` of these, ``TEMPLATE_PAGES`` at least, are deleted from that host's pages. Pages with one and the same article
  count once, so copies of an article do not make its own text a template.
* structure, the complement for what does not recur: elements that are never article text (menus, headers,
  footers, sidebars, forms, scripts, styles), elements whose role says so, and containers with a class name or id that
  means nothing else than an advert, notice, menu or comment. Headings, paragraphs and inline elements are never
  deleted for a name.

Neither rule deletes the longest article (or ``main``) of a page or an element that holds it.

What is left is read from the article element(s), else ``main``, else the body. Headings, paragraphs, other single
text blocks and inline elements are never deleted for recurring, as an author may repeat them; recurring lists
and tables are. ``n_templates`` counts the different subtrees of the page, nested ones too,
that recur. Blocks are text between block-level tags or line breaks, white space inside a block is one space,
blocks are joined by a line feed.

Null or empty html gives an empty text; broken or unclosed markup is closed where its parent ends; a null
url is a host of its own. Rows that share a ``page_id``, or have none, are pages of their own. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from .words import map_batches

TEMPLATE_SHARE = 0.1  # share of a host's distinct articles that hold a subtree before it is a template
TEMPLATE_PAGES = 3  # and the least number of these

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option "
    "p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = set(
    "script style noscript template head title nav header footer aside form menu button select input textarea "
    "iframe object embed svg canvas audio video dialog link meta xmp noembed noframes option".split()
)
CONTAINERS = set("div section ul ol dl table center details fieldset figure nav header footer aside form menu dialog".split())
# An open element of the key is closed by the start of one of the values.
CLOSED_BY = {
    "p": BLOCK - {"br", "body", "html", "head", "td", "th", "tr", "option"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "option": {"option"},
    "head": {"body"},
}
# A container is unwanted if one of its class names, or its id, is made of such words alone and holds one of the first.
_UNWANTED = set(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos "
    "promotion promotions banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup paywall alert nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header "
    "masthead footer foot sidebar aside widget widgets related recommended share sharing social toolbar login search "
    "comment comments commentlist replies respond disqus discussion".split()
)
_BESIDE = set(
    "site page main top bottom left right side bar box list item items area section block wrapper wrap container "
    "content inner outer unit slot form links button buttons icons thread posts articles global primary secondary".split()
)
_PARTS = re.compile(r"[\s_-]+")
_ACTIVE = set("active current selected open on".split())
_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")


_QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(page: str) -> Node:
    """Tree of the page; children are nodes and (decoded) strings."""
    root = Node("", "")
    stack, at, size = [root], 0, len(page)
    last = page.rfind(">")  # no tag ends after it
    while at < size:
        m = _TAG.search(page, at) if at <= last or page.find("<!--", at) >= 0 else None
        if m is None:
            stack[-1].children.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        while len(stack) > 1 and tag in CLOSED_BY.get(stack[-1].tag, ()):
            stack.pop()
        # inline elements that were left open inside a paragraph do not keep it open
        if tag in BLOCK and tag != "br":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in BLOCK:
                    if tag in CLOSED_BY.get(stack[i].tag, ()):
                        del stack[i:]
                    break
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            at = size if end is None else end.end()
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


def _named(name: str) -> bool:
    parts = [p for p in _PARTS.split(name.lower().rstrip("0123456789")) if p]
    return any(p in _UNWANTED for p in parts) and all(p in _UNWANTED or p in _BESIDE or p.isdigit() for p in parts)


def unwanted(node: Node) -> bool:
    if node.tag in DROPPED:
        return True
    if not node.attrs:
        return False
    for name, *values in _ATTRIBUTE.findall(node.attrs):
        name, value = name.lower(), "".join(values)
        if node.tag in CONTAINERS and (name == "id" and _named(value) or name == "class" and any(map(_named, value.split()))):
            return True
        if name == "role" and value.strip().lower() in _ROLES:
            return True
        if name == "aria-hidden" and value.strip().lower() == "true":
            return True
    names = _QUOTED.sub(" ", node.attrs)  # without the values
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$|=)", names, re.IGNORECASE))


def protected(root: Node) -> set[int]:
    """The ``id`` of the longest article (else ``main``), if there is one, and of the elements that hold it.

    Articles whose own class is unwanted (a comment) come after the others; of equal ones the first counts.
    """
    above: dict[int, Node] = {}
    order, work = [], [root]
    while work:
        here = work.pop()
        order.append(here)
        for child in reversed(here.children):
            if not isinstance(child, str) and child.tag not in ("template", "noscript", "head"):
                above[id(child)] = here
                work.append(child)
    sizes: dict[int, int] = {}
    for here in reversed(order):
        sizes[id(here)] = sum(len(c.strip()) if isinstance(c, str) else sizes.get(id(c), 0) for c in here.children)
    for tag in ("article", "main"):
        found = [n for n in order if n.tag == tag]
        if found:
            best = max(found, key=lambda n: (sizes[id(n)] > 0, not unwanted(n), sizes[id(n)]))
            keep = {id(best)}
            while id(best) in above:
                best = above[id(best)]
                keep.add(id(best))
            return keep
    return set()


def prune(node: Node) -> None:
    """Delete the subtrees that structure alone rules out."""
    keep, work = protected(node), [node]
    while work:
        here = work.pop()
        here.children = [c for c in here.children if isinstance(c, str) or id(c) in keep or not unwanted(c)]
        work += [c for c in here.children if not isinstance(c, str)]


def _look(attrs: str) -> str:
    """The class names without numbers and marks of the current page, in order."""
    if not attrs:
        return ""
    names = {n for k, *v in _ATTRIBUTE.findall(attrs) if k.lower() == "class" for n in "".join(v).lower().split()}
    return " ".join(sorted({re.sub(r"\d+", "", n) for n in names} - _ACTIVE))


def subtree_hashes(root: Node) -> dict[int, int]:
    """Hash of tags, classes and text of the subtree of each node, by the node's ``id``; each node is visited once.

    Links, ids and numbers in attributes and marks of the page one is on do not count, so that a menu is the same on
    all pages of a site.
    """
    order, work = [], [root]
    while work:
        here = work.pop()
        order.append(here)
        work += [c for c in here.children if not isinstance(c, str)]
    found: dict[int, int] = {}
    for here in reversed(order):  # children before parents
        out = xxhash.xxh64(f"<{here.tag} {_look(here.attrs)}>".encode("utf-8", "surrogatepass"))
        for child in here.children:
            if isinstance(child, str):
                out.update(b"t" + " ".join(child.split()).encode("utf-8", "surrogatepass") + b"\0")
            else:
                out.update(b"n" + (found[id(child)] + (1 << 63)).to_bytes(8, "big"))
        found[id(here)] = out.intdigest() - (1 << 63)
    return found


def _find(node: Node, tag: str) -> list[Node]:
    """Outermost elements of that name, in page order."""
    found, work = [], [node]
    while work:
        here = work.pop()
        for_children = [c for c in here.children if not isinstance(c, str)]
        if here.tag == tag:
            found.append(here)
        else:
            work += reversed(for_children)
    return found


def bodies(root: Node) -> list[Node]:
    for tag in ("article", "main", "body"):
        if found := _find(root, tag):
            return found
    return [root]


def containers(root: Node) -> Iterator[tuple[Node, Node]]:
    """``(parent, element)`` of the page that may be a template."""
    keep, work = protected(root), [root]
    while work:
        here = work.pop()
        for child in here.children:
            if isinstance(child, str):
                continue
            if child.tag in CONTAINERS and id(child) not in keep:
                yield here, child
            work.append(child)


def text_of(tops: list[Node]) -> str:
    blocks: list[str] = []
    piece: list[str] = []

    def flush() -> None:
        if piece:
            if line := " ".join("".join(piece).split()):
                blocks.append(line)
            piece.clear()

    for top in tops:
        flush()
        work: list = [top]
        while work:
            here = work.pop()
            if here is None:
                flush()
            elif isinstance(here, str):
                piece.append(here)
            elif here.tag in BLOCK:
                flush()
                work.append(None)
                work += reversed(here.children)
            else:
                work += reversed(here.children)
    flush()
    return "\n".join(blocks)


def candidate_hashes(page: str | None) -> tuple[list[int], int]:
    """Hashes of the subtrees that may be templates, and the hash of the article they stand beside."""
    root = parse(page or "")
    hashes = subtree_hashes(root)
    found = {hashes[id(child)] for _, child in containers(root)}
    prune(root)
    return sorted(found), xxhash.xxh64_intdigest(text_of(bodies(root)).encode("utf-8", "surrogatepass")) - (1 << 63)


def extract(page: str | None, templates: set[int] | frozenset = frozenset()) -> str:
    """Main text of one page without the given template subtrees."""
    root = parse(page or "")
    if templates:
        hashes = subtree_hashes(root)
        doomed = {id(child) for _, child in containers(root) if hashes[id(child)] in templates}
        work = [root]
        while work:
            here = work.pop()
            here.children = [c for c in here.children if id(c) not in doomed]
            work += [c for c in here.children if not isinstance(c, str)]
    prune(root)
    return text_of(bodies(root))


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def identity():
    """Rows with one id, address and html are one page."""
    return F.xxhash64("page_id", "url", "html")


def site_templates(pages: DataFrame, least: int = TEMPLATE_PAGES, share: float = TEMPLATE_SHARE) -> tuple[DataFrame, DataFrame]:
    """``(templates, subtrees)``: recurring ``(host, subtree)``, and ``(page, host, article, subtree)``; ``page`` is
    the identity of a row (``identity``), as ids may be null or stand for several pages."""

    def make():
        def one(cols: dict) -> dict:
            out: dict = {"page": [], "host": [], "article": [], "subtree": []}
            for page, host, html in zip(cols["page"], cols["host"], cols["html"], strict=True):
                hashes, article = candidate_hashes(html)
                for h in [None, *hashes]:  # the row without a subtree counts the host's articles
                    out["page"].append(page)
                    out["host"].append(host)
                    out["article"].append(article)
                    out["subtree"].append(h)
            return out

        return one

    rows = pages.select(identity().alias("page"), host_of(F.col("url")).alias("host"), "html")
    subtrees = store(
        map_batches(rows, ("page", "host", "html"), make, "page long, host string, article long, subtree long")
    )
    # distinct articles first (a hot host is spread by subtree and article), then a small count
    seen = subtrees.select("host", "subtree", "article").distinct()
    counted = seen.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("articles"))
    totals = counted.where("subtree is null").select("host", F.col("articles").alias("all"))
    often = counted.where((F.col("articles") >= least) & F.col("subtree").isNotNull()).join(totals, "host")
    return often.where(F.col("articles") >= F.col("all") * share).select("host", "subtree"), subtrees


def extract_pages(pages: DataFrame, least: int = TEMPLATE_PAGES) -> DataFrame:
    """``(page_id, url, text, n_chars, n_templates)`` for every row of ``pages``."""
    templates, subtrees = site_templates(pages, least)
    # at most the page's own subtrees, so the array is bounded by the page
    doomed = subtrees.join(templates, ["host", "subtree"]).groupBy("page").agg(F.collect_set("subtree").alias("doomed"))
    rows = pages.select("page_id", "url", "html", identity().alias("page")).join(store(doomed), "page", "left")

    def make():
        def one(cols: dict) -> dict:
            texts = [extract(h, frozenset(d or ())) for h, d in zip(cols["html"], cols["doomed"], strict=True)]
            return {
                "page_id": cols["page_id"],
                "url": cols["url"],
                "text": texts,
                "n_chars": [len(t) for t in texts],
                "n_templates": [len(d or ()) for d in cols["doomed"]],
            }

        return one

    return map_batches(
        rows,
        ("page_id", "url", "html", "doomed"),
        make,
        "page_id long, url string, text string, n_chars long, n_templates long",
    )
