"""Main text of pages by site style trees.

Spark merges the element trees of a host's pages: a node is a host and a path of tags and classes, and for each node that holds
text of its own the tree counts the host's different pages (copies of a page count once) by style (the tags of the children there)
and by content (the text there), combined before the shuffle. A node's importance is the larger of the entropies of its
styles and of its contents, each divided by the entropy of as many different pages: a notice or an advert repeats over the host, an article
doesn't. Few pages are little evidence: PRIOR_PAGES pages more count with what the page itself says, importance 1, or 0 for text beside an article.
A branch is removed where no node in it comes to LEAST_IMPORTANCE, that is a block goes where its own node doesn't. What tags, roles and classes
name as menus, headers, footers, sidebars, notices, adverts, forms, scripts or comments of readers goes on any page: the contract excludes it however it
varies, and adverts that rotate look as important to the tree as an article does.

Blocks are the texts between block-level tags; character references are decoded, white space in a block becomes
one space, and blocks join by two line ends, all in page order.

Each page is parsed once; its blocks and the hashes of its nodes are staged and serve the tree and the texts. What pages need of the tree are the nodes it judges unlike the pages themselves: numbers of 8 bytes, that are broadcast
up to BROADCAST_NODES of them. Beyond that the staged blocks meet the tree by a join on the node, which AQE can split, and come together again by row.

Defined results: null html is empty and gives an empty text; null url: a host of its own; tags that don't close end
with their parent, and a tag without an end at the end of the page is text that is dropped; long pages are read whole; nodes of equal importance are judged alike, and one of just
LEAST_IMPORTANCE stays; repeated rows give their row each; an empty table gives an empty result; other columns of the input don't matter.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_or_not, staged
from .url_filter import host_of

PRIOR_PAGES = 6
LEAST_IMPORTANCE = 0.5
#: Numbers of nodes that may be broadcast, 8 bytes each.
BROADCAST_NODES = 500_000
#: Rows of (page, copies) that may be broadcast, 16 bytes each.
BROADCAST_COPIES = 500_000

#: Tag names and words of classes and ids, by what they mean. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
NOISE_TAGS = frozenset("head nav header footer aside form script style noscript template iframe button select textarea svg menu dialog object canvas audio video math".split())
MAIN_TAGS = frozenset("article main".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup form login search share sharing social comment comments disqus reply replies respond related recommended pagination pager toolbar skip copyright legal disclaimer".split()
)
CONTENT_WORDS = frozenset("article content entry post story main body text".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: What an open element of the key is closed by, besides its own end.
CLOSES = {
    "p": BLOCK - {"option", "optgroup"},
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
#: Elements beyond which an end or a closing tag doesn't reach.
SCOPE = frozenset("html table td th article main section div aside".split())
RAW = "script|style|textarea|title|noscript|iframe|template|svg|math"

ATTRIBUTES = r"""(?:=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)|[^>=]+|=)*"""
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<({RAW})(?=[\s/>]){ATTRIBUTES}(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    rf"|<(/?)([a-z][a-z0-9:-]*)({ATTRIBUTES})(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("tag", "path", "noise", "main", "children")

    def __init__(self, tag: str, path: str, noise: bool, main: bool):
        self.tag, self.path, self.noise, self.main, self.children = tag, path, noise, main, []


def _named(attributes: str) -> tuple[str, bool]:
    """The classes for the path, and whether class, id or role name the element as noise."""
    classes, noise = "", False
    for name, a, b, c in NAMES.findall(attributes) if attributes else ():
        name, value = name.lower(), (a or b or c).lower()
        if name == "class":
            classes = ".".join(sorted(value.split())).replace("/", "|")
        if name == "role":
            noise |= value in NOISE_ROLES
        elif name == "hidden" or name == "aria-hidden":
            noise |= name == "hidden" or value == "true"
        else:
            for token in value.split():
                found = NOISE_WORDS.intersection(WORD.findall(token))
                noise |= bool(found) and not (found == {"header"} and not CONTENT_WORDS.isdisjoint(WORD.findall(token)))
    return classes, noise


def parse(page: str) -> Element:
    """The page's tree: children are elements and texts; scripts, styles and comments of the markup are left out."""
    root = Element("", "", False, False)
    stack, at = [root], 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        raw, end, tag, attributes = m.group(1, 2, 3, 4)
        if tag is None or raw is not None:
            continue
        tag = tag.lower()
        if end:
            if tag in VOID:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE and tag not in SCOPE and tag not in ("body", "html"):
                    break
            continue
        for k in range(len(stack) - 1, 0, -1):
            if tag in CLOSES.get(stack[k].tag, ()):
                del stack[k:]
                break
            if stack[k].tag in BLOCK and stack[k].tag not in ("p", "li"):
                break
        over = stack[-1]
        classes, noise = _named(attributes)
        noise = tag in NOISE_TAGS or (noise and tag not in ("html", "body", "main") and (tag != "article" or "comment" in attributes.lower()))
        new = Element(tag, f"{over.path}/{tag}" + (f".{classes}" if classes else ""), noise, tag in MAIN_TAGS)
        over.children.append(new)
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(new)
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


def blocks(page: str | None) -> list[tuple[str, str, bool, str]]:
    """(path, style, beside, text) of each block outside noise: where its innermost block-level element is, the tags in that, whether it stands beside an article's text."""
    out: list[tuple[str, str, bool, str]] = []
    held: list[str] = []
    at: list[tuple[Element, bool]] = []

    def flush() -> None:
        if held:
            if text := SPACE.sub(" ", entities.unescape("".join(held))).strip():
                over, inside = at[-1]
                out.append((over.path, ",".join(c.tag for c in over.children if not isinstance(c, str)), inside, text))
            held.clear()

    todo: list = [parse(page or "")]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
            at.pop()
        elif isinstance(x, str):
            held.append(x)
        elif x.tag == "br":
            held.append(" ")
        elif not at or x.tag in BLOCK:
            flush()
            if not x.noise:
                at.append((x, bool(at and at[-1][1]) or x.main))
                todo.append(None)
                todo += reversed(x.children)
        elif not x.noise:
            todo += reversed(x.children)
    articles = any(inside for _, _, inside, _ in out)
    return [(path, style, articles and not inside, text) for path, style, inside, text in out]


def node(host: str, path: str) -> int:
    """The number of a node, a signed 64-bit one."""
    return xxhash.xxh64_intdigest(f"{host}\0{path}") - (1 << 63)


def kept(numbers: list[int], beside: list[bool], tree: tuple[np.ndarray, np.ndarray] | None) -> list[bool]:
    """Which blocks stay: those beside no article, but for the nodes that go or stay by the tree (two sorted arrays)."""
    keep = ~np.array(beside, bool)
    if numbers and tree is not None:
        at = np.array(numbers, np.int64)
        for stays, some in enumerate(tree):
            if len(some):
                keep[some[np.minimum(np.searchsorted(some, at), len(some) - 1)] == at] = bool(stays)
    return keep.tolist()


def main_text(page: str | None, host: str = "", tree: tuple[np.ndarray, np.ndarray] | None = None) -> str:
    """The page's blocks outside noise: those of its articles if it has any, else all, but for the nodes that the tree judges otherwise."""
    found = blocks(page)
    stay = kept([node(host, path) for path, *_ in found], [beside for *_, beside, _ in found], tree)
    return "\n\n".join(text for (*_, text), k in zip(found, stay, strict=True) if k)


def nodes_of(host: str, found: list[tuple[str, str, bool, str]]) -> list[tuple[int, int, int, bool]]:
    """(node, style, content, beside an article) of each node with text of its own among a page's blocks: hashes over all its elements there."""
    here: dict[str, tuple[list[str], list[str], bool]] = {}
    for path, style, beside, text in found:
        styles, texts, _ = here.setdefault(path, ([], [], beside))
        styles.append(style)
        texts.append(text)
    hashed = lambda x: xxhash.xxh64_intdigest("\n".join(x)) - (1 << 63)
    return [(node(host, path), hashed(styles), hashed(texts), beside) for path, (styles, texts, beside) in here.items()]


def _lists(rows: list[list], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for row in rows for x in row], kind))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, copy (equal for equal pages of a host), the page's blocks (at: nodes, beside, block) and its nodes (node, style, content, near: beside an article), for pages (page_id, url, host, html)."""
    kinds = {"at": pa.int64(), "beside": pa.bool_(), "block": pa.string(), "node": pa.int64(), "style": pa.int64(), "content": pa.int64(), "near": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                out: list[list[list]] = [[] for _ in kinds]
                for host, page in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    found = blocks(page)
                    number = {path: node(host, path) for path in {b[0] for b in found}}
                    own = nodes_of(host, found)
                    columns = ([number[b[0]] for b in found], [b[2] for b in found], [b[3] for b in found], *([x[k] for x in own] for k in range(4)))
                    for held, column in zip(out, columns, strict=True):
                        held.append(column)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(_lists(x, k) for x, k in zip(out, kinds.values(), strict=True))], names=["page_id", "url", "copy", *kinds])

    copy = F.xxhash64("host", F.coalesce("html", F.lit(""))).alias("copy")
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", copy, "host", "html").mapInArrow(run, f"page_id {kind}, url string, copy long, at array<long>, beside array<boolean>, block array<string>, node array<long>, style array<long>, content array<long>, near array<boolean>")


def site_tree(rows: DataFrame) -> DataFrame:
    """node, pages, importance and beside (the share of its pages where it is beside an article) of each node of staged parsed pages."""
    copies = staged(rows.groupBy(F.col("copy").alias("same")).agg(F.count("*").alias("n")).where("n > 1"), "page-copies")
    seen = rows.join(small_or_not(copies, BROADCAST_COPIES), F.col("copy") == F.col("same"), "left")
    seen = seen.select((1 / F.coalesce("n", F.lit(1))).alias("weight"), F.inline(F.arrays_zip("node", "style", "content", "near")))
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in enumerate(("style", "content"))]))
    seen = seen.select("node", (F.col("weight") * F.col("near").cast("int")).alias("b"), "weight", each)
    # The weights of a page's copies sum to 1, so that these sums are whole numbers but for the last bits.
    counts = seen.groupBy("node", "kind", "value").agg(F.greatest(F.round(F.sum("weight")), F.lit(1.0)).alias("c"), F.sum("b").alias("b"))
    both = counts.groupBy("node", "kind").agg(F.sum("c").alias("pages"), F.sum(F.col("c") * F.log("c")).alias("clogc"), F.sum("b").alias("b"))
    entropy = F.when(F.col("pages") > 1, 1 - F.col("clogc") / (F.col("pages") * F.log("pages"))).otherwise(F.lit(1.0))
    return both.groupBy("node").agg(F.max("pages").alias("pages"), F.max(entropy).alias("importance"), F.least(F.max(F.col("b") / F.col("pages")), F.lit(1.0)).alias("beside"))


def judged(tree: DataFrame) -> DataFrame:
    """node and stays of the tree's nodes: whether a node's blocks stay, by its importance and PRIOR_PAGES pages of what the pages say."""
    seen = F.col("pages") - 1
    blend = (seen * F.col("importance") + PRIOR_PAGES * (1 - F.col("beside"))) / (seen + PRIOR_PAGES)
    return tree.select("node", (F.round(blend, 9) >= LEAST_IMPORTANCE).alias("stays"), "beside")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row."""
    rows = staged(parsed(pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))), "parsed-pages")
    verdicts = judged(staged(site_tree(rows), "site-tree"))
    # Nodes that some pages would judge otherwise.
    unlike = staged(verdicts.where((F.col("stays") & (F.col("beside") > 0)) | (~F.col("stays") & (F.col("beside") < 1))).select("node", "stays"), "unlike-nodes")
    if unlike.limit(BROADCAST_NODES + 1).count() > BROADCAST_NODES:
        return _by_join(rows, unlike)
    found = unlike.toPandas()  # at most BROADCAST_NODES numbers
    shared = pages.sparkSession.sparkContext.broadcast(tuple(np.sort(found["node"].to_numpy(np.int64)[found["stays"].to_numpy(bool) == stays]) for stays in (False, True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(begin, 256) for batch in batches for begin in range(0, batch.num_rows, 256)):
            texts = []
            for at, beside, block in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                texts.append("\n\n".join(text for text, k in zip(block, kept(at, beside, shared.value), strict=True) if k))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "at", "beside", "block").mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def _by_join(rows: DataFrame, unlike: DataFrame) -> DataFrame:
    """The texts of staged parsed pages for more nodes than may be broadcast: blocks meet the tree by node, and each row's blocks come together again."""
    numbered = staged(rows.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "at", "beside", "block"), "numbered-pages")
    each = numbered.select("row", F.posexplode(F.arrays_zip("at", "beside", "block")).alias("pos", "b")).select("row", "pos", "b.at", "b.beside", "b.block")
    stays = each.join(unlike, F.col("at") == F.col("node"), "left").where(F.coalesce("stays", ~F.col("beside")))
    parts = F.sort_array(F.collect_list(F.struct("pos", "block")))  # of one page
    texts = stays.groupBy("row").agg(F.array_join(F.transform(parts, lambda p: p["block"]), "\n\n").alias("text"))
    joined = numbered.select("row", "page_id", "url").join(texts, "row", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return joined.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
