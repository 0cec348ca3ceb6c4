"""Main text of web pages by site style trees.

The pages of a host are merged into one style tree: a node is a path of tags and classes, its style
nodes are the child sequences that it was seen with, its features are the texts of its blocks. Two
entropies say how important a node is. A node that looks and reads the same on most pages of its host
scores near 0 (menus, notices), one whose content differs from page to page near 1. Branches below a
threshold are cut from each page, inside an article as outside.

The tree can't see what differs from page to page and is no article all the same. So what tags and classes
declare (``nav``, ``footer``, ``class="ad"``, comments, forms, scripts) is cut before pages are merged. A class or
a form is a prior only: a branch that holds an article or half of the text stays. A page that marks its
main content (``article`` or ``main``) is merged like any other, and keeps nothing else.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import checkpoint, join_hot
from windrose.llm.url_filter import url_host
from windrose.shipping import ship

#: A branch of less importance than this is cut, if its host has shown it on MIN_PAGES different pages.
THRESHOLD, MIN_PAGES, GAMMA = 0.3, 8, 0.9
#: Cut lists of so many nodes in all are broadcast; more are joined by host and salt.
BROADCAST_NODES = 1_000_000
#: Elements are nested so deep at most, as in browsers; deeper ones become siblings. Style trees have so many levels.
DEPTH, LEVELS = 512, 64

_VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
_DROP = _RAW | frozenset("head nav header footer aside button select option menu dialog object canvas audio video label datalist".split())
_FORM = frozenset(("form", "fieldset"))
_BLOCK = frozenset(
    "html body address article aside blockquote center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br caption legend".split()
)
_MAIN = frozenset(("article", "main"))
#: An open p ends where one of these begins.
_ENDS_P = _BLOCK - {"br", "html", "body", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "legend"}
_SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
#: Reader comments can be longer than what they comment on.
_TALK = frozenset("comment comments commentlist disqus discussion respond reply replies".split())
#: Words of class, id and role that mark a branch as no part of the article.
_NOISE = _TALK | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promoted promotion banner banners "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pager pagination toc masthead topbar toolbar header footer foot colophon copyright "
    "sidebar sidebars aside complementary widget widgets related recommended recommendations trending popular teaser "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social form search contentinfo".split()
)
#: Words that may stand beside them in a name; with any other word a name says something else (has-sidebar, form-and-function).
_NEUTRAL = frozenset(
    "box wrap wrapper container inner outer list item items block area section bar left right top bottom link links row col column group panel buttons button "
    "main site page primary secondary global post entry article the my first last text inline fixed sticky mobile desktop".split()
)
_TITLE = frozenset(("header", "masthead"))
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=\d)")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_GAP = re.compile(r"\s+")
_FREE, _PRIOR, _ALWAYS, _TALKS = range(4)


def _named(name: str, in_main: bool) -> int:
    """What one name of a class list, an id or a role marks."""
    words = [w for w in _SPLIT.split(_CAMEL.sub("-", name).lower()) if w and not w.isdigit()]
    if "".join(words) in _NOISE:
        words = ["".join(words)]
    found = {w for w in words if w in _NOISE}
    if in_main:
        found -= _TITLE
    if not found or any(w not in _NOISE and w not in _NEUTRAL for w in words):
        return _FREE
    return _TALKS if found & _TALK else _PRIOR


def _marks(attrs: str, in_main: bool) -> tuple[str, int, bool]:
    """Class list, what the attributes mark, whether they mark the main content."""
    cls, mark, main = "", _FREE, False
    for m in _ATTR.finditer(attrs):
        k, v = m[1].lower(), (m[2] or "").strip("\"'")
        if k == "hidden" or k == "aria-hidden" and v.lower() == "true" or k == "style" and re.search(r"display\s*:\s*none", v, re.I):
            mark = _ALWAYS
        elif k in ("class", "id", "role"):
            names = v.split()
            if k == "class":
                cls = ".".join(names)
            if mark != _ALWAYS:
                mark = max([mark, *(_named(n, in_main) for n in names)], key=(_FREE, _PRIOR, _TALKS).index)
            main = main or k == "role" and v.lower() == "main"
    return cls, mark, main


class Node:
    """An element that makes blocks; ``up`` is the next one above. size: characters of text at or below it."""

    __slots__ = ("tag", "id", "up", "level", "mark", "main", "keep", "cut", "low", "size", "kids", "inline", "own")

    def __init__(self, tag: str, up: Node | None, inline: bool = False):
        self.tag, self.up, self.inline = tag, up, inline
        self.id, self.level, self.mark, self.main, self.keep, self.cut, self.low, self.size, self.kids = 0, 0, _FREE, False, False, False, False, 0, []
        self.own = up.own if inline else self  # the innermost that is no inline element


def parse(page: str | None, seed: int = 0) -> tuple[list[tuple[Node, str]], list[Node]]:
    """Blocks in page order, and the nodes that aren't cut, parents first.

    Unclosed and crossed tags are closed as browsers do in the common cases; cut-off pages end where they end.
    """
    from xxhash import xxh64_intdigest

    blocks: list[tuple[Node, str]] = []
    root = Node("", None)
    root.id = seed
    stack, parts, at, nodes = [root], [], 0, [root]
    page = page or ""
    owner = root

    def flush() -> None:
        if parts:
            text = _GAP.sub(" ", _html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                blocks.append((owner, text))
                owner.size += len(text)

    def close(k: int) -> None:
        if not all(n.inline for n in stack[k:]):
            flush()
        del stack[k:]

    while True:
        m = _TOKEN.search(page, at)
        if at < (m.start() if m else len(page)):
            if not parts:
                owner = stack[-1].own
            parts.append(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br" or tag == "p" and not any(n.tag == "p" for n in stack):
                flush()
                continue
            inline = tag not in _BLOCK and tag not in _DROP
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if inline and not stack[k].inline:  # </b> doesn't reach past a block
                    break
            continue
        if tag in _VOID:
            if tag in _BLOCK:
                flush()
            continue
        if tag in _ENDS_P and stack[-1].own.tag == "p":
            close(next(k for k in range(len(stack) - 1, 0, -1) if not stack[k].inline))
        if tag in _SIBLING:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _SCOPE[tag]:
                    break
                if stack[k].tag in _SIBLING[tag]:
                    close(k)
                    break
        block = tag in _BLOCK or tag in _DROP
        if block and stack[-1].inline:  # an inline tag left open reaches no further than its block
            close(next(k for k in range(len(stack) - 1, -1, -1) if not stack[k].inline) + 1)
        if len(stack) >= DEPTH:
            close(len(stack) - 1)
        up = stack[-1].own
        cls, mark, role = _marks(m[3], up.main) if m[3] and not m[3].isspace() else ("", _FREE, False)
        main = tag in _MAIN or role
        if tag in ("html", "body") or main and not up.main:
            mark = _FREE
        elif tag in _DROP:
            mark = mark if tag in ("header", "hgroup") and up.main else _ALWAYS  # an article's own header holds its title
        elif tag in _FORM and mark == _FREE:
            mark = _PRIOR
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
        if not block and mark == _FREE and not main:
            stack.append(Node(tag, stack[-1], inline=True))
            continue
        flush()
        node = Node(tag, up)
        node.level, node.mark, node.main = up.level + 1, mark, up.main or main
        node.id = xxh64_intdigest(f"{tag}.{cls}" if cls else tag, up.id) if node.level <= LEVELS else up.id
        n = node if main and not up.main else None
        while n is not None and not n.keep:  # it and all around it stay
            n.keep, n = True, n.up
        node.keep = node.keep or tag == "h1" and node.main  # alike titles are titles
        up.kids.append(node)
        nodes.append(node)
        stack.append(node)
    flush()
    return _prune(blocks, nodes)


def _prune(blocks: list[tuple[Node, str]], nodes: list[Node]) -> tuple[list[tuple[Node, str]], list[Node]]:
    """Without what tags and classes cut; of a page that marks its main content, only blocks in it."""
    for n in nodes[1:]:
        n.cut = n.up.cut or n.mark == _ALWAYS and not n.keep
        n.size *= not n.cut
    for n in reversed(nodes[1:]):
        n.up.size += n.size
    marked = sum(n.size for n in nodes[1:] if n.main and not n.up.main)
    for n in nodes[1:]:
        half = 2 * n.size >= (marked if n.main else nodes[0].size)
        n.cut = n.cut or n.up.cut or n.mark == _TALKS and not n.keep or n.mark == _PRIOR and not n.keep and not half
    blocks = [b for b in blocks if not b[0].cut]
    inside = [b for b in blocks if b[0].main]
    return inside or blocks, [n for n in nodes if not n.cut]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_FEATURES = pa.schema([("kind", pa.int8()), ("node", pa.int64()), ("feature", pa.int64()), ("page", pa.int64())])


def features(page: str | None, host: int) -> set[tuple[int, int, int, int]]:
    """(kind, node, feature, page) of one page: child sequences (kind 0) and block texts (kind 1) of its nodes, and the
    blocks at or below each node (kind 2; feature: the block's node, page: the host).

    page is the hash of its texts, so copies of a page count once. A host's name is in its nodes' ids.
    """
    from xxhash import xxh64_intdigest

    key = lambda text: _signed(xxh64_intdigest(text))
    blocks, nodes = parse(page, host & (1 << 64) - 1)
    if not blocks:
        return set()
    sign = key("\n".join(t for _, t in blocks))
    out = {(0, _signed(n.id), key(",".join(k.tag for k in n.kids if not k.cut)), sign) for n in nodes[1:]}
    done = set()
    for n, t in blocks:
        out.add((1, _signed(n.id), key(t), sign))
        if n.id not in done:
            done.add(n.id)
            a = n
            while a.up is not None:
                out.add((2, _signed(a.id), _signed(n.id), host))
                a = a.up
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: set[tuple] = set()  # what a task has said of nodes
    for b in batches:
        rows: list[tuple] = []
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = features(page, host)
            new = {x for x in found if x[0] == 2} - known
            rows += [x for x in found if x[0] < 2] + list(new)
            known = new if len(known) > 200_000 else known | new
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _FEATURES)], schema=_FEATURES)


def importance(pages: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """host, node, pages, score, reads: the composite importance of each node of each host's style tree.

    pages: host (64-bit hash), html. Presentation: the entropy, to the base of the number of pages, of the child
    sequences that a node has. Content (reads): 1 less the mean entropy of the texts of the blocks at or below it over
    pages (log of the number of pages that have the text, to the same base). A node's score is (1 - gamma^l) x
    presentation + gamma^l x content, l being the number of its child sequences; over one page both are 1. All counts
    are sums, combined before any shuffle, so a host with most of the pages is no hot task.
    """
    once = pages.select("host", "html").mapInArrow(_features, "kind byte, node long, feature long, page long").distinct()
    per = once.groupBy("kind", "node", "feature").agg(F.count("*").alias("n"), F.max("page").alias("host"))
    leaf = F.when(F.col("kind") == 2, F.col("feature")).otherwise(F.lit(0)).alias("leaf")
    logn = F.log(F.col("n").cast("double"))
    nodes = checkpoint(per.groupBy("kind", "node", leaf).agg(F.sum("n").alias("m"), F.sum(F.col("n") * logn).alias("nlogn"), F.sum(logn).alias("logs"), F.count("*").alias("l"), F.max("host").alias("host")))
    log_m = F.log(F.col("m").cast("double"))
    style = nodes.filter("kind = 0").select("node", "m", "l", F.when(F.col("m") <= 1, F.lit(1.0)).otherwise((log_m - F.col("nlogn") / F.col("m")) / log_m).alias("look"))
    texts = nodes.filter("kind = 1").select(F.col("node").alias("leaf"), "logs", F.col("l").alias("texts"))
    below = nodes.filter("kind = 2").select("node", "leaf", "host").join(texts, "leaf").groupBy("node", "host").agg(F.sum("logs").alias("logs"), F.sum("texts").alias("texts"))
    both = style.join(below, "node").withColumn("reads", F.when(F.col("m") <= 1, F.lit(1.0)).otherwise(1 - F.least(F.lit(1.0), F.col("logs") / F.col("texts") / log_m)))
    weight = F.pow(F.lit(gamma), F.col("l").cast("double"))
    return both.select("host", "node", F.col("m").alias("pages"), ((1 - weight) * F.col("look") + weight * F.col("reads")).alias("score"), "reads")


def main_text(page: str | None, host: int = 0, low: set[int] | None = None) -> str:
    """The blocks of a page without its low nodes, but for those that hold its marked content; never none of them."""
    blocks, nodes = parse(page, host & (1 << 64) - 1)
    if low:
        for n in nodes[1:]:
            n.low = n.up.low or not n.keep and _signed(n.id) in low
        blocks = [b for b in blocks if not b[0].low] or blocks
    return "\n".join(t for _, t in blocks)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, url, html, host, low nodes) to (id, url, text)."""
    for b in batches:
        texts = [main_text(page, host, set(low or ())) for page, host, low in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])


def extract(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """id, url, text, n_chars: the main text of every page.

    A branch goes if its score and its content's share of that are below the threshold, so that what differs from page
    to page stays, however alike it looks. Character references are decoded, white space inside a block becomes one
    space, blocks are joined by one line feed. Null and empty pages give "", plain text is one block. Elements nested
    deeper than DEPTH become siblings, so deep pages take time in proportion to their length. A null url has the empty
    host. Copies of a page count once in the style tree, and repeated rows each give their row. Other columns are
    ignored, whatever their names; an empty table gives an empty result. Pages are parsed where they are and only
    hashes are shuffled; the join brings each page its host's cut list (paths of one host's design, not of its pages).
    """
    ship(df.sparkSession)
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"), F.xxhash64(url_host(F.col(url_col))).alias("host"))
    kind = df.schema[id_col].dataType.simpleString()
    scores = importance(pages.select("host", "html"))
    low = scores.filter((F.col("pages") >= min_pages) & (F.col("score") < threshold) & (F.col("reads") < threshold)).groupBy("host").agg(F.collect_set("node").alias("low"))
    low = checkpoint(low)
    nodes = low.agg(F.sum(F.size("low"))).first()[0] or 0
    joined = join_hot(pages, low, "host", nodes, BROADCAST_NODES, ["id", "url"]).select("id", "url", "html", "host", "low")
    out = joined.mapInArrow(_extract, f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
