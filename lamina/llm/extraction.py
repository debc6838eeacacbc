"""Main-text extraction by composite text density.

Each page is parsed into a tree. Every node gets a link-adjusted density of
characters per tag

    C / T * log_b(C / LC * T / LT),  b = ln(C / nLC * LC + LCb / Cb * C + e)

(C characters, LC those in links, nLC the others, T tags, LT link tags in the node;
Cb and LCb of the body), and the sum of its children's densities. The node with the
largest weighted sum is the core of the article; the least density on its path to the body
is the threshold.

Weights are what tags and names can say: a node is worth less inside an element whose
class or id has a word of page furniture, and, on pages with an article or main element,
outside of those. Nothing is cut by a name. From the core up to the body, a
block beside the path stays unless it is mostly links or is worth less than the core; one
that is worth less stays if its density, times what it is worth, still reaches the
threshold. Inside the core the same holds.

Only elements that are no text by their tag, role or hidden attribute (menus, forms,
scripts, footers, asides) are cut before densities are computed, unless the article itself
is inside. An element marked by a name that holds most of the page's text is not marked.

A page is worked on alone, so memory is bounded by the largest page. Defined
results: null or empty html, and pages without main text, give an empty text;
unclosed and stray tags are repaired in the manner of browsers; undecodable
references stay as they are; equal pages get equal texts.
"""

from __future__ import annotations

import html as _html
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"br", "body", "html", "head", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "title", "legend"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl select body html article section div main td th blockquote".split())

# Page furniture by tag, role, and word of a class or id.
DROP_TAGS = frozenset("nav footer aside form script style noscript iframe template button select input textarea svg canvas object embed dialog menu title head".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr "
    "notice popup modal overlay newsletter subscribe subscription signup promo promotion sponsor sponsored comment comments commentlist disqus respond replies reply "
    "share sharing social related recommended recommendations widget pagination pager toolbar masthead login search skip".split()
)
TOP_WORDS = frozenset({"header"})
#: Of these, words of elements that are hardly ever around the main text.
APART_WORDS = frozenset(
    "advert adverts advertisement advertising cookie cookies consent gdpr popup modal newsletter subscribe subscription signup promo promotion sponsor sponsored "
    "comment comments commentlist disqus respond replies reply".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: How an element is furniture: by a word, by one of APART_WORDS, or by tag, role or attribute.
AREA, APART, FIXED = 1, 2, 3
#: What text is worth inside an element marked by a word, and outside the articles of a page that has some.
WEIGHTS = {AREA: 0.02, APART: 0.01}
OUTSIDE = 0.1

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>",
    re.DOTALL,
)
#: One attribute: its whole name, then a quoted or bare value.
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]*+)))?""")
#: A class that says what else the page has or lacks, not what the element is.
_STATE = re.compile(r"(?<!\S)(?:no|not|non|with|without|has|hide|show)[-_]\S*|\S+[-_](?:open|opened|closed|enabled|disabled|visible)(?!\S)", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "parent", "drop", "article", "parts", "chars", "links", "tags", "link_tags", "density", "total", "weight", "in_core")

    def __init__(self, tag: str, parent: int, drop: int, article: bool):
        self.tag, self.parent, self.drop, self.article = tag, parent, drop, article
        self.parts: list = []  # texts, and numbers of child nodes, in page order
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.total = 0.0
        self.weight, self.in_core = 1.0, False


def _furniture(tag: str, attrs: str, in_article: bool) -> int:
    """0, or AREA, APART or FIXED."""
    if tag in DROP_TAGS:
        return FIXED
    if tag == "header" and not in_article:
        return FIXED
    if not attrs or tag in ("html", "body", "main"):
        return 0
    given: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        given.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")  # of a repeated attribute the first counts
    out = 0
    for name, value in given.items():
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in DROP_ROLES:
            return FIXED
        # the id of a heading or of a section of the article comes from its words
        if name == "class" or name == "id" and not (tag in HEADINGS or tag == "section" and in_article):
            words = {w.lower() for w in _WORD.findall(_STATE.sub(" ", value))}
            if words & DROP_WORDS or not in_article and words & TOP_WORDS:
                out = max(out, APART if words & APART_WORDS else AREA)
    return out


def parse(page: str) -> list[Node]:
    """The page's nodes in document order; parents come before their children."""
    nodes = [Node("", -1, 0, False)]
    open_, at, n = [0], 0, len(page)

    def text(s: str) -> None:
        if s:
            nodes[open_[-1]].parts.append(_html.unescape(s) if "&" in s else s)

    def close(tags: set | frozenset, scope: frozenset) -> None:
        for k in range(len(open_) - 1, 0, -1):
            t = nodes[open_[k]].tag
            if t in tags:
                del open_[k:]
                return
            if t in scope:
                return

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            text(_html.escape(m[0][9:].removesuffix("]]>")))
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for k in range(len(open_) - 1, 0, -1):
                if nodes[open_[k]].tag == tag:
                    del open_[k:]
                    break
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPE)
        if tag in SAME:
            close(SAME[tag], SCOPE - SAME[tag])
        attrs = m[3] or m[6] or ""
        parent = nodes[open_[-1]]
        inside = parent.article or tag in ("article", "main")
        nodes.append(Node(tag, open_[-1], _furniture(tag, attrs, inside), inside))
        parent.parts.append(len(nodes) - 1)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
            if not end:
                break
            close_at = page.find(">", end.end())
            at = n if close_at < 0 else close_at + 1
        elif tag not in VOID:
            open_.append(len(nodes) - 1)
    return nodes


def _spare(nodes: list[Node]) -> None:
    """Unmark the element that is marked by its words alone but holds most of the
    text that is left, and those around it. Where there is an article, only text inside
    counts. Elements of APART_WORDS are spared only where no other text is left."""
    articles = any(x.tag in ("article", "main") and not x.drop for x in nodes)
    mark = [0] * len(nodes)  # the innermost marked element around, -1 in fixed furniture
    own: dict[int, int] = {0: 0}
    for i, x in enumerate(nodes):
        up = mark[x.parent] if i else 0
        mark[i] = -1 if up < 0 or x.drop == FIXED else i if x.drop else up
        if mark[i] >= 0 and (x.article or not articles):
            own[mark[i]] = own.get(mark[i], 0) + sum(len(p.strip()) for p in x.parts if isinstance(p, str))
    plain = own.pop(0)
    for kind in (AREA, APART):
        best = max((k for k in own if nodes[k].drop == kind), key=lambda k: (own[k], -k), default=0)
        if best and own[best] > plain and (kind == AREA or not plain):
            while best > 0:
                nodes[best].drop = 0
                best = nodes[best].parent
            return


def _cut(nodes: list[Node]) -> None:
    """Cut what is no text by its kind, and give the rest their weights. Furniture that
    holds the article stays; what is inside the rest goes."""
    holds = [False] * len(nodes)
    articles = False
    for i in range(len(nodes) - 1, 0, -1):
        x = nodes[i]
        if holds[i] or x.tag in ("article", "main") and not x.drop:
            articles = holds[i] = holds[x.parent] = True
    for i, x in enumerate(nodes):
        if holds[i] and x.tag not in ("article", "main"):
            x.drop = 0
    if any(x.drop in (AREA, APART) for x in nodes):
        _spare(nodes)
    for i, x in enumerate(nodes):
        up = nodes[x.parent] if i else None
        x.weight = (up.weight if up else 1.0) * WEIGHTS.get(x.drop, 1.0)
        if articles and x.tag in ("article", "main") and not (up and up.article):
            x.weight /= OUTSIDE
        elif articles and not up:
            x.weight *= OUTSIDE
        x.drop = bool(x.drop == FIXED or up and up.drop)


def _measure(nodes: list[Node]) -> None:
    for x in nodes:
        x.chars = sum(len(p.strip()) for p in x.parts if isinstance(p, str)) if not x.drop else 0
    for x in reversed(nodes):
        if x.drop:
            continue
        if x.tag == "a":
            x.links, x.link_tags = x.chars, x.link_tags + 1
        if x.parent >= 0:
            up = nodes[x.parent]
            up.chars += x.chars
            up.links += x.links
            up.tags += x.tags + 1
            up.link_tags += x.link_tags
    body = nodes[0]
    share = body.links / max(1, body.chars)
    for x in nodes:
        if x.drop or not x.chars:
            continue
        base = math.log(x.chars / max(1, x.chars - x.links) * x.links + share * x.chars + math.e)
        log_base = max(math.log(base), 0.1)
        ratio = x.chars / max(1, x.links) * max(1, x.tags) / max(1, x.link_tags)
        x.density = x.chars / max(1, x.tags) * math.log(max(ratio, 1.0 if x.links else 2.0)) / log_base
        if x.parent >= 0:
            nodes[x.parent].total += x.density
    for x in nodes:
        if x.tags == 0:  # a leaf is its own only block
            x.total = x.density


def _link_heavy(x: Node) -> bool:
    return x.links * 3 > x.chars * 2


def _select(nodes: list[Node]) -> None:
    """Drop what is not main text. Blocks on the core's path to the body stay; others
    stay by the rule of the module's docstring."""
    live = [i for i, x in enumerate(nodes) if not x.drop and x.chars]
    if not live:
        return
    core = max(live, key=lambda i: (nodes[i].total * nodes[i].weight, nodes[i].chars * nodes[i].weight, -i))
    path, i = set(), core
    while i >= 0:
        path.add(i)
        i = nodes[i].parent
    threshold = min(nodes[i].density for i in path)
    worth = nodes[core].weight
    for i in live:
        x = nodes[i]
        if i in path:
            continue
        inside = x.parent >= 0 and (x.parent == core or nodes[x.parent].in_core)
        x.in_core = inside
        less = x.weight < worth and x.density * x.weight < threshold * worth
        links = x.tag in BLOCK and _link_heavy(x) and (not inside or x.density < threshold)
        x.drop = less or links


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    nodes = parse(page)
    _cut(nodes)
    _measure(nodes)
    _select(nodes)
    out: list[str] = []
    todo: list = [0]
    while todo:
        i = todo.pop()
        if isinstance(i, str):
            out.append(i)
            continue
        x = nodes[i]
        if x.drop:
            out.append(" ")
            continue
        block = x.tag in BLOCK
        todo += [" "] * block + x.parts[::-1] + [" "] * block
    return " ".join("".join(out).split())


def extract_pages(pages: DataFrame, name: str = "text") -> DataFrame:
    """pages with the main text of column html in column ``name``; a column of that name
    that pages have is replaced."""
    ship_package(pages.sparkSession)

    @F.pandas_udf("string")
    def main_text(htmls: pd.Series) -> pd.Series:
        return htmls.map(extract, na_action=None)

    return pages.withColumn(name, main_text(F.coalesce(F.col("html").cast("string"), F.lit(""))))


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_pages(pages).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
