"""Main text by a site style tree.

Each page is read into a tree of elements. Pages of a host are merged into one style tree: an element node is its path
of tags, classes and ids, a presentation style of it the sequence of its child nodes (those with text), and its contents
the text blocks that are its own. With m pages that have the node:

- a block that n of them show has entropy log(n) / log(m); contents matter by 1 less the mean entropy of their blocks;
- a node's presentation matters by the entropy, to base m, of how its elements share out among its l styles;
- its composite importance is (1 - GAMMA**l) times that of its presentation and GAMMA**l times the mean, over its
  elements, of that of their children, own contents being one of these; where m is 1 it is 1, without children that of
  its contents.

A branch is noise if its node and all nodes below it are less important than a bound. Noise is removed from each page,
and the text of what is left is joined block by block.

Pages are merged by counting: rows of a page's nodes, blocks and styles go into one sum by host and node, so a host with a
third of all pages is no single task; importance is then composed from a host's distinct nodes. Nodes that fewer than LEAST_PAGES pages of a host show are
judged by all hosts' nodes of that presentation. What an element says of itself (navigation, footer, form, a class like
"ad") is a prior importance of 0; if a page has an article or main element, branches outside of it go, and those inside
only if nearly all their blocks recur. If counts alone speak against every branch of a page, its branches stay.

Defined cases: a null or empty html gives an empty text; a url without '://' has the empty host; broken markup (open
elements, stray ends, unclosed comments or scripts) is read as far as it goes, and elements nested deeper than DEPTH
count as part of the one above; repeated rows each count and give a row; an empty table gives no rows; other columns
don't matter.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm.common import read, table, text_of

#: Pages that must show a node before its counts decide: of one host, else of all hosts together.
LEAST_PAGES = 20
#: Importance below which a branch goes, outside and inside of an article or main element.
LEAST_IMPORTANCE = 0.5
LEAST_IN_MAIN = 0.05
#: How much of a node's importance comes from below, by the number of its styles.
GAMMA = 0.9
DEPTH = 512

DROPPED = frozenset("head title script style noscript template svg math canvas iframe object embed audio video map button select option textarea input dialog menu".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
MAIN = frozenset("article main".split())
NOISE_TAGS = frozenset("nav footer aside form".split())
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer toolbar cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist disqus respond reply replies pagination pager".split())
#: These say so only outside of an article or main element.
OUTER_WORDS = frozenset("banner header masthead topbar top side widget notice notices alert skip search tags".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: What an open element is closed by: its start tag's name -> open tags that end before it.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div section article aside nav main header footer form body html td th blockquote".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_LOOSE = re.compile(r"</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
_NAMED = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[A-Za-z]+|[0-9]+")


class Node:
    """An element: its parent, the hash of its presentation, its prior importance, whether it is in the main content."""

    __slots__ = ("key", "main", "parent", "prior", "tag")

    def __init__(self, tag: str, names: str, parent: Node | None, prior: float, main: bool):
        self.tag, self.parent, self.main = tag, parent, main
        self.prior = min(prior, parent.prior) if parent else prior
        self.key = xxhash.xxh64_intdigest(f"{parent.key if parent else 0}/{tag}{names}", 7) - (1 << 63)


def _prior(tag: str, attributes: str, parent: Node) -> tuple[float, str]:
    """Importance from what the element says, and its names as a part of its presentation."""
    prior = 0.0 if tag in NOISE_TAGS or tag in DROPPED or tag == "header" and not parent.main else 1.0
    names = ""
    if "=" in attributes or "hidden" in attributes:
        for name, a, b, c in _NAMED.findall(attributes):
            value, name = a or b or c, name.lower()
            if name == "role":
                prior = 0.0 if value.lower() in NOISE_ROLES else prior
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                prior = 0.0
            elif name in ("class", "id"):
                words = {w.lower() for part in value.split() for w in _WORDS.findall(part)}
                names += "." + " ".join(sorted(w for w in words if not w.isdigit()))
                if tag not in MAIN and (words & NOISE_WORDS or not parent.main and words & OUTER_WORDS):
                    prior = 0.0
    return prior, names


def blocks(page: str) -> list[tuple[Node, str]]:
    """The text blocks of a page, in its order: the nearest block element and the text, white space made single."""
    root = Node("html", "", None, 1.0, False)
    stack, at, out, held = [root], 0, [], []
    owner = root

    def flush() -> None:
        nonlocal held
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((owner, text))
            held = []

    def block_of(node: Node) -> Node:
        while node.parent and node.tag not in BLOCKS:
            node = node.parent
        return node

    def pop_to(k: int) -> None:
        """Closes the elements from the k-th of the stack on."""
        nonlocal owner
        if any(n.tag in BLOCKS for n in stack[k:]):
            flush()
        del stack[k:]
        owner = block_of(stack[-1])

    size = len(page)
    while at < size:
        tag_at = page.find("<", at)
        if tag_at < 0:
            tag_at = size
        if tag_at > at and (stack[-1].prior > 0 or owner.prior <= 0):
            held.append(page[at:tag_at])
        if tag_at == size:
            break
        m = _TOKEN.match(page, tag_at) or _LOOSE.match(page, tag_at)
        if not m:  # a '<' that begins no tag is text
            held.append("<")
            at = tag_at + 1
            continue
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    pop_to(k)
                    break
                if stack[k].tag in SCOPES and tag not in SCOPES:
                    break
            else:
                if tag in BLOCKS:
                    flush()
            if tag == "br":
                held.append(" ")
        elif m[2]:
            tag, attributes = m[2].lower(), m[3] or ""
            if tag in BLOCKS and len(stack) > 1 and stack[1].tag == "head":
                pop_to(1)
            if tag in ("html", "body"):
                continue
            if tag == "br":
                held.append(" ")
                continue
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else size
                continue
            if tag in BLOCKS:
                # a block ends an open paragraph, with what is open in it
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        pop_to(k)
                        break
                    if stack[k].tag in SCOPES:
                        break
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in CLOSED_BY.get(tag, ()):
                        pop_to(k)
                        break
                    if stack[k].tag in SCOPES:
                        break
                flush()
            if tag in VOID:
                continue
            parent = stack[-1]
            prior, names = _prior(tag, attributes, parent)
            if attributes.endswith("/") and tag not in BLOCKS or len(stack) >= DEPTH:
                continue
            stack.append(Node(tag, names if tag in BLOCKS else "", parent, prior, parent.main or tag in MAIN))
            if tag in BLOCKS:
                owner = stack[-1]
    flush()
    return out


def chain(node: Node) -> Iterator[Node]:
    """The block elements from node up, without the root."""
    while node.parent:
        if node.tag in BLOCKS:
            yield node
        node = node.parent


def elements(page: str) -> tuple[dict[int, list], dict[tuple[int, int], int], set[tuple[int, int]]]:
    """A page's nodes (parent, depth, elements, their shares in their parents, own contents' share), elements by (node,
    style), and (node, block)."""
    at: dict[Node, list] = {}
    texts = set()
    for owner, text in blocks(page):
        below = None
        for node in chain(owner):
            new = node not in at
            element = at.setdefault(node, [[], False])
            if below is None:
                element[1] = True
                texts.add((node.key, xxhash.xxh64_intdigest(text, 11) - (1 << 63)))
            else:
                element[0].append(below)
            below = node
            if not new:
                break
    nodes: dict[int, list] = {}
    styles: dict[tuple[int, int], int] = {}
    share = {}
    for node, (children, own) in at.items():
        part = 1.0 / (len(children) + own)
        share.update((c, part) for c in children)
        up = [n.key for n in chain(node)]
        sums = nodes.setdefault(node.key, [up[1] if len(up) > 1 else None, len(up), 0, 0.0, 0.0])
        sums[2] += 1
        sums[4] += part * own
        if children:
            style = xxhash.xxh64_intdigest(" ".join(str(c.key) for c in children), 13) - (1 << 63)
            styles[node.key, style] = styles.get((node.key, style), 0) + 1
    for node in at:
        nodes[node.key][3] += share.get(node, 0.0)
    return nodes, styles, texts


_COUNTS = "host string, node bigint, kind int, value bigint, n bigint, parent bigint, depth int, share double, own double"
PAGE, BLOCK, STYLE = range(3)


def features(pages: DataFrame) -> DataFrame:
    """pages (host, html) -> (host, node, kind, value, pages, n, parent, depth, share, own): how many of a host's pages have
    a node, show a block as its own contents, or an element of it in a style; n counts elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["host", "node", "kind", "value", "n", "parent", "depth", "share", "own"], [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64()]
        for batch in batches:
            rows: list[tuple] = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                nodes, styles, texts = elements(page.as_py() or "")
                rows += [(host, k, PAGE, None, n, parent, depth, share, own) for k, (parent, depth, n, share, own) in nodes.items()]
                rows += [(host, k, STYLE, style, n, None, None, None, None) for (k, style), n in styles.items()]
                rows += [(host, k, BLOCK, block, 1, None, None, None, None) for k, block in texts]
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    found = pages.select("host", "html").mapInArrow(run, _COUNTS).withColumn("pages", F.lit(1).cast("bigint"))
    return merged(found, "host", "node")


def merged(counts: DataFrame, *by: str) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("pages", "n")] + [F.max(c).alias(c) for c in ("parent", "depth")] + [F.sum(c).alias(c) for c in ("share", "own")]
    return counts.groupBy(*by, "kind", "value").agg(*sums)


def composed(nodes: list[tuple]) -> dict[int, float]:
    """Nodes (node, parent, depth, elements, share, own, contents, presentation, styles) that more than one page has, of one
    tree -> of each branch, the greatest composite importance in it."""
    below: dict[int, list[tuple[float, float, float]]] = {}
    out = {}
    for node, parent, _, n, share, own, contents, presentation, styles in sorted(nodes, key=lambda x: -x[2]):
        children = below.pop(node, [])
        if own > 0:
            children.append((own, contents, contents))
        rest = n - sum(w for w, _, _ in children)  # children that one page has, as important as can be
        if rest > 1e-6 * n:
            children.append((rest, 1.0, 1.0))
        mean = sum(w * x for w, x, _ in children) / n
        value = (1.0 - GAMMA**styles) * presentation + GAMMA**styles * mean
        out[node] = max([value, *(top for _, _, top in children)])
        if parent is not None:
            below.setdefault(parent, []).append((share, value, out[node]))
    return out


def importance(counts: DataFrame, *by: str) -> DataFrame:
    """(by..., pages, importance) of nodes that more than one page has: of a branch, the greatest composite importance of
    its nodes. by ends in node; what stands before it tells the trees apart."""
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    one = [F.max(of(PAGE, F.col(c))).alias(c) for c in ("pages", "parent", "depth", "n", "share", "own")]
    n = F.col("n").cast("double")
    logs = [F.avg(of(BLOCK, F.log(n))).alias("logs"), F.sum(of(STYLE, n)).alias("all"), F.sum(of(STYLE, n * F.log(n))).alias("nlogn"), F.count(of(STYLE, n)).alias("styles")]
    sums = counts.groupBy(*by).agg(*one, *logs).where("pages > 1")
    contents = F.lit(1.0) - F.least(F.coalesce("logs", F.lit(0.0)) / F.log("pages"), F.lit(1.0))
    shown = F.greatest(F.least(F.coalesce((F.log("all") - F.col("nlogn") / F.col("all")) / F.log("pages"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    tree = [*by[:-1]] or ["tree"]
    rows = sums.withColumns({"contents": contents, "shown": shown} | ({} if by[:-1] else {"tree": F.lit("")}))
    rows = rows.select(*tree, "node", "parent", "depth", "n", "share", "own", "contents", "shown", "styles", "pages")

    def run(found: pa.Table) -> pa.Table:
        nodes = list(zip(*(c.to_pylist() for c in found.columns[len(tree) : -1]), strict=True))
        value = composed(nodes)
        return pa.table([*found.columns[: len(tree)], found["node"], found["pages"], pa.array([value[x[0]] for x in nodes], pa.float64())], [*tree, "node", "pages", "importance"])

    schema = T.StructType([rows.schema[c] for c in (*tree, "node", "pages")] + [T.StructField("importance", T.DoubleType())])
    return rows.groupBy(*tree).applyInArrow(run, schema).select(*by, "pages", "importance")


def unimportant(counts: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, low): a host's branches below LEAST_IMPORTANCE and the importance of each, by its own counts or all hosts'."""
    own = importance(counts, "host", "node")
    common = importance(merged(counts, "node"), "node").where((F.col("pages") >= least_pages) & (F.col("importance") < LEAST_IMPORTANCE)).select("node", F.col("importance").alias("common"))
    nodes = counts.where(F.col("kind") == PAGE).select("host", "node")
    sure = own.where(F.col("pages") >= least_pages)
    judged = nodes.join(sure, ["host", "node"], "left").join(common, "node", "left").select("host", "node", F.coalesce("importance", "common").alias("importance"))
    return judged.where(F.col("importance") < LEAST_IMPORTANCE).groupBy("host").agg(F.collect_list(F.struct("node", "importance")).alias("low"))


def kept(page: str, low: dict[int, float]) -> str:
    """The text of the branches that stay."""
    found = [(n, t) for n, t in blocks(page) if n.prior > 0]
    if any(n.main for n, _ in found):
        found = [(n, t) for n, t in found if n.main]
    stay = [t for owner, t in found if all(low.get(n.key, 1.0) >= (LEAST_IN_MAIN if n.main else LEAST_IMPORTANCE) for n in chain(owner) if n.main or not owner.main)]
    return "\n".join(stay or [t for _, t in found])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of each page."""
    spark = pages.sparkSession
    host = F.translate(F.regexp_extract(text_of(F.col("url").cast("string")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    counts = table(spark, features(rows), "blocks")
    low = table(spark, unimportant(counts).select(F.col("host").alias("_host"), "low"), "unimportant")
    joined = rows.join(low, rows["host"] == low["_host"], "left").select("page_id", "url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, out = batch.column(3).to_pylist(), []
            for page, low in zip(batch.column(2), hosts, strict=True):
                out.append(kept(page.as_py() or "", {x["node"]: x["importance"] for x in low or ()}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    schema = T.StructType([joined.schema["page_id"], joined.schema["url"], T.StructField("text", T.StringType())])
    return joined.mapInArrow(run, schema)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's main text."""
    return extracted(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))
