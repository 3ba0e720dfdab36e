"""Main-text extraction with a site style tree.

Each page is parsed into blocks of text, each under a path of block elements with their class, id and role (its style
path; digits in names count as alike). The pages of a host are merged into a tree: a node is a style path; it knows how
many pages have it, in which child sequences (its presentation) and with which contents of the whole branch. Presentation
and content importance are the entropies of these over the host's pages that have the node (0: all alike, 1: all
different); a node's importance is their mean, presentation weighing the more the more child sequences there are. Few
pages tell little: the importance is drawn towards 1 as if UNSEEN_PAGES more pages had been all different.

What elements and names stand for adds to the importance: an article or main element and what is under it gains, branches
that stand for menus, headers, footers, side bars, notices, adverts, forms or reader comments lose (a name of a block counts
if all its words are such names or plain ones like "list"), what lies beside a page's main element loses a little. A branch
whose sum is below the threshold is removed from each page; an element around an article or main element is not (menus
and the like are). So repeated branches go by entropy, inside an article too, but single repeated paragraphs of an
article stay; a footer or advert of ever new words, which entropy can't tell from an article, goes by what it stands for.

Defined results: null or blank html gives the empty text. Tags that are left open close where HTML closes them; text
outside any element counts. Character references are decoded (as HTML 5 does, also without semicolon), white space
inside a block becomes one space, a line break is white space, blocks are joined by a newline. A null URL is a host of
its own. Repeated rows give repeated rows; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.bpe import slices
from vectorloom.llm.shared import materialize, maybe_broadcast, small_batches
from vectorloom.llm.url_filter import host

THRESHOLD = 0.3
UNSEEN_PAGES = 2
#: The share of content importance for a node with n child sequences is this to the n.
CONTENT_DECAY = 0.9
#: What is added to a node's importance.
NOISE, BESIDE, NEUTRAL, BRANCH_OF_MAIN, MAIN = -0.8, -0.3, 0.0, 0.2, 0.5

# Elements by how HTML lays them out, and names that stand for what is not main text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = frozenset("head script style noscript template iframe object embed svg math canvas audio video textarea select option button input title map datalist noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog header search fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus sidebar sidebars aside header masthead footer foot colophon breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist disqus respond replies reply widget widgets toolbar pager pagination skip copyright".split()
)
PLAIN_NAMES = frozenset("site page main top bottom left right bar box block list item items area section container wrapper wrap inner outer post posts entry entries article articles content link links icon icons button buttons primary secondary global".split())
HEADING_NAMES = frozenset("header head".split())
MAIN_TAGS = frozenset(["article", "main"])
#: These go even if an article lies in them.
APART = frozenset("nav footer aside menu dialog".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption summary legend address center".split())
CLOSED_BY_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSED_BY_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table html body article section div main aside nav header footer form td th blockquote".split())

_ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
_TOKEN = re.compile(
    rf"(?P<text>[^<]+)|<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|textarea|title|noscript|iframe|template|svg|math|noframes)\b{_ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/)?(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>{_ATTRIBUTES})>|<[!?][^>]*>|(?P<stray><)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")


def noise_name(name: str, in_main: bool) -> bool:
    """Whether a class or id stands for what is not main text: all its words do, or are plain ones, and one does at least."""
    words = set(_WORD.findall(name))
    noise = words & NOISE_NAMES
    if in_main:  # an article's own heading
        noise -= HEADING_NAMES
        words -= HEADING_NAMES
    return bool(noise) and words <= noise | PLAIN_NAMES


class Node:
    """An open block element: its step in the style path, what it stands for, its children's names and its branch's texts."""

    __slots__ = ("tag", "path", "parent", "noise", "hidden", "main", "holds_main", "children", "texts")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        in_main = parent is not None and parent.main
        step, noise, main = tag, tag in NOISE_TAGS and not (in_main and tag == "header"), tag in MAIN_TAGS
        self.hidden = False
        if attributes and attributes.strip(" /"):
            for name, *values in _ATTRIBUTE.findall(attributes):
                value, name = " ".join(filter(None, values)).lower(), name.lower()
                if name in ("class", "id"):
                    step += "".join("." + _DIGITS.sub("#", v) for v in sorted(value.split()))
                    noise = noise or any(noise_name(v, in_main) for v in value.split())
                elif name == "role":
                    step += "@" + value
                    noise, main = noise or value in NOISE_ROLES, main or value == "main"
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                    self.hidden = True
                    step += "!"
        if tag in ("html", "body"):  # a class of the whole page is no noise
            noise = False
        self.tag, self.parent = tag, parent
        self.path = f"{parent.path}>{step}" if parent else step
        self.noise = noise
        self.main = in_main or (main and not noise)
        self.holds_main = False
        self.children: list[str] = []
        self.texts: list[str] = []
        if self.main and not in_main:
            while parent is not None and not parent.holds_main:
                parent.holds_main = True
                parent = parent.parent

    def prior(self, beside: bool) -> float:
        """What is added to the node's importance; beside: the page has a main element."""
        if self.hidden or (self.noise and (self.tag in APART or not self.holds_main)):
            return NOISE
        if self.main:
            return MAIN if self.tag in TEXT_BLOCKS or self.tag in MAIN_TAGS or not self.parent.main else BRANCH_OF_MAIN
        return BESIDE if beside and not self.holds_main else NEUTRAL


def blocks(page: str | None) -> tuple[list[tuple[Node, str]], list[Node]]:
    """(blocks of text with their nodes, all nodes) of a page, in page order."""
    root = Node("html", "", None)
    stack, nodes, found, text = [root], [root], [], []

    def flush():
        if text:
            clean = " ".join(html_lib.unescape("".join(text)).split())
            if clean:
                found.append((stack[-1], clean))
                for node in stack:
                    node.texts.append(clean)
            text.clear()

    def close(tags, scopes=SCOPES):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in scopes:
                return

    skipping = None  # a hidden element that is not raw text
    depth = 0
    for m in _TOKEN.finditer(page or ""):
        if m["text"] or m["stray"]:
            if skipping is None:
                text.append(m[0])
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if skipping is not None:
            if tag == skipping:
                depth += -1 if m["end"] else 1
                skipping = None if depth == 0 else skipping
            elif tag in ("body", "article", "main", "p") and skipping == "head":  # a head that was left open
                skipping = None
            else:
                continue
            if skipping is None and (m["end"] or tag == "head"):
                continue
        if tag in HIDDEN and tag not in VOID:
            if not m["end"] and not (m["attributes"] or "").endswith("/"):
                skipping, depth = tag, 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in BLOCKS:
            continue
        flush()
        if m["end"]:
            if tag not in ("html", "body"):
                close({tag}, frozenset() if tag in SCOPES else SCOPES)
            continue
        if tag in ("html", "body"):
            stack[0].tag = "html"
            continue
        if tag in CLOSED_BY_P:
            close({"p"})
        if tag in CLOSED_BY_LIKE:
            like = CLOSED_BY_LIKE[tag]
            close(like, SCOPES - like)
        node = Node(tag, m["attributes"] or "", stack[-1])
        stack[-1].children.append(node.path.rpartition(">")[2])
        nodes.append(node)
        if tag not in VOID:
            stack.append(node)
    flush()
    return found, nodes


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


PRESENTATION, CONTENT = 0, 1


def _observed(page: str | None) -> list[tuple[int, int, int, float]]:
    """(style path, kind, value, prior) of a page, hashed: its nodes' child sequences and their branches' contents, each once."""
    _, nodes = blocks(page)
    beside = nodes[0].holds_main
    own: dict[str, list[Node]] = {}
    for node in nodes:
        own.setdefault(node.path, []).append(node)
    seen = []
    for path, alike in own.items():
        at, prior = _hash(path), max(n.prior(beside) for n in alike)
        seen.append((at, PRESENTATION, _hash("|".join(">".join(n.children) for n in alike)), prior))
        seen.append((at, CONTENT, _hash("\n".join(t for n in alike for t in n.texts)), prior))
    return seen


def site_style_tree(pages: DataFrame) -> DataFrame:
    """host, node, pages, presentation, content (entropies to the base of the pages), styles (child sequences), importance
    and prior (the mean of its pages') of every style path, from columns host and html."""

    def run(batches):
        for batch in batches:
            held: Counter = Counter()
            for site, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.update((site, *x) for x in _observed(page))
            if held:
                columns = list(zip(*held, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:4]), pa.array(columns[4], pa.float64()), pa.array(held.values(), pa.int64())], names=["host", "node", "kind", "value", "prior", "n"]
                )

    small_batches(pages)
    seen = pages.select("host", "html").mapInArrow(run, "host string, node long, kind long, value long, prior double, n long")
    values = seen.groupBy("host", "node", "kind", "value").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("prior")).alias("prior"))
    # Sum of n log n in whole steps of a value, so that tasks combine it before the shuffle.
    of = lambda kind, column: F.sum(F.when(F.col("kind") == kind, column))
    n_log_n = F.col("n") * F.log("n")
    nodes = values.groupBy("host", "node").agg(
        of(CONTENT, F.col("n")).alias("pages"), of(CONTENT, F.col("prior")).alias("prior"), of(PRESENTATION, F.lit(1)).alias("styles"), of(CONTENT, n_log_n).alias("content"), of(PRESENTATION, n_log_n).alias("presentation")
    )
    log_pages = F.log("pages")
    entropy = lambda c: F.when(F.col("pages") > 1, (log_pages - F.col(c) / F.col("pages")) / log_pages).otherwise(1.0)
    nodes = nodes.select("host", "node", "pages", "styles", (F.col("prior") / F.col("pages")).alias("prior"), entropy("presentation").alias("presentation"), entropy("content").alias("content"))
    share = F.pow(F.lit(CONTENT_DECAY), F.col("styles"))
    mean = (1 - share) * F.col("presentation") + share * F.col("content")
    seen_more = F.col("pages") - 1
    return nodes.withColumn("importance", (seen_more * mean + UNSEEN_PAGES) / (seen_more + UNSEEN_PAGES))


def low_importance(tree: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """host, nodes: the style paths that the host's entropies put below the threshold. Those that no entropy could lift over
    it (a page sees it from the path alone) are left out, so that the list stays short."""
    low = tree.where((F.col("importance") + F.col("prior") < threshold) & (1 + F.col("prior") >= threshold))
    return low.groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("nodes"))


def main_text(page: str | None, low: frozenset[int] = frozenset(), threshold: float = THRESHOLD) -> str:
    """The page's text without the branches of low importance; low: their style paths by the tree of its host."""
    found, nodes = blocks(page)
    beside = nodes[0].holds_main
    goes: dict[int, bool] = {}
    for node in nodes:  # parents come first
        gone = node.parent is not None and goes[id(node.parent)]
        if not gone and node.parent is not None:
            prior = node.prior(beside)
            gone = 1 + prior < threshold or (bool(low) and not (node.holds_main and node.tag not in APART) and _hash(node.path) in low)
        goes[id(node)] = gone
    return "\n".join(text for node, text in found if not goes[id(node)])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """id, url, text of every page."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    low = materialize(low_importance(site_style_tree(rows), threshold), "style-tree")

    def run(batches):
        kept: tuple[str | None, frozenset[int]] = None, frozenset()
        for batch in batches:
            for part in slices(batch):
                texts = []
                for at, (site, page) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    if site != kept[0]:
                        kept = site, frozenset(part.column(4)[at].as_py() or ())
                    texts.append(main_text(page, kept[1], threshold))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(texts, pa.string())], names=["id", "url", "text"])

    joined = rows.join(maybe_broadcast(low), "host", "left").select("id", "url", "host", "html", "nodes")
    kind = pages.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, url string, text string").withColumnsRenamed({"id": id_col, "url": url_col})
