"""Operator 2: main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is a path of tags and classes.  Its presentation is the sequence of
its children's tags on a page, its content the text right below it.  The importance of a node is the entropy of its
presentations and contents over the pages that have it, between 0 (the same on each) and 1 (another on each); that of a
branch also takes in the branches below.  A block of text is a feature of its node: one that is on over half of the node's
pages tells nothing of a page.

Every node is in the tree, and what the tree calls unimportant goes from each page of the host: branches of low importance,
and blocks that most pages have.  What HTML or a class name says of an element sets the importance that it needs.  Elements
that are no part of an article by their kind (menus, footers, sidebars, adverts, forms, comments) can't reach it whatever
their text, for a link list or an advert may well change from page to page; those of a doubtful name (a banner, a box for
search) need much, and on a host with too few pages to judge they go by their name; all others need little, and stay on such
a host.

The tree is counted in aggregates over (host, path, signature), so a host with any share of the pages is many tasks' work.
Pages alike in all their text count once, so copies of an article don't look like a template.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, col, materialise, prepare, texts

#: A branch is judged from so many different pages of its host on, and goes below this importance, or below the other if its
#: name is doubtful.  A block goes that is on more than half of them.
MIN_PAGES, THRESHOLD, DOUBTFUL = 8, 0.25, 0.75
#: How much the branches below count against a node's own presentations, as a power of how many of these there are.
GAMMA = 0.9
#: Nodes below this depth belong to the node there.
DEPTH = 24

#: Hashes of paths, with eight more for each host, up to which the lists of the hosts are broadcast; beyond it, parts that
#: the pages of a host are dealt to.
BROADCAST, SALTS = 1_000_000, 32

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*>|</?[a-zA-Z][^>]*>?", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", re.I)
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")

#: What HTML says of its elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe xmp noframes noembed template".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag (value) ends an open element (key).
ENDS = {
    "p": set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt td th tr".split()),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "option": {"option", "optgroup"}, "head": {"body", "article", "main", "div", "p", "h1", "nav", "section", "header", "footer", "ul", "table"},
}
#: Elements, roles and words in class names or ids that are no part of an article.
NOISE_TAGS = set("head nav header footer aside form button select option datalist fieldset input dialog menu object embed svg canvas audio video map".split()) | RAW
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
NOISE_WORDS = set(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored nav navbar navigation menu submenu breadcrumb "
    "breadcrumbs sidebar footer cookie cookies consent gdpr notice notices notification popup newsletter subscribe subscription "
    "share sharing related recommended recommendations comment comments disqus respond reply replies login signin signup "
    "pagination pager copyright alert skip form".split()
)
#: Words that may name a part of an article as well, and words beside which they do.
DOUBTFUL_WORDS = set("promo promotion banner header masthead modal overlay social discussion register search widget toolbar legal disclaimer".split())
ARTICLE_WORDS = set("article entry post story content main body text title".split())
TEXT_TAGS = {"article", "main", "body", "html"}
PLAIN, UNSURE, NOISE = 0, 1, 2


@dataclass(slots=True)
class Node:
    tag: str
    path: str
    kind: int
    article: bool
    children: list[str] = field(default_factory=list)
    hashes: tuple[int, ...] = ()


@dataclass(slots=True)
class Block:
    text: str
    paths: tuple[int, ...]
    article: bool

    @property
    def feature(self) -> int:
        """Names the text at its node."""
        return _hash(f"{self.paths[-1] if self.paths else 0} {self.text}")


def _attributes(tag: str) -> tuple[str, int]:
    """The class and id words of a tag, and what it is by them, its role or being hidden."""
    a = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(tag)}
    words = {w.lower() for k in ("class", "id") for w in SPLIT.split(a.get(k, "")) if w}
    style = a.get("style", "").replace(" ", "").lower()
    hidden = a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
    role = a.get("role", "").strip().lower()
    kind = PLAIN
    if hidden or role in NOISE_ROLES or not NOISE_WORDS.isdisjoint(words):
        kind = NOISE
    elif not DOUBTFUL_WORDS.isdisjoint(words) and ARTICLE_WORDS.isdisjoint(words):
        kind = UNSURE
    return ".".join(sorted(w for w in words if not any(c.isdigit() for c in w))) + ("#" + role if role else ""), kind


def _hash(s: str) -> int:
    h = xxhash.xxh64_intdigest(s)
    return h - (1 << 64) if h >= 1 << 63 else h


def parse(page: str) -> tuple[list[Block], list[Node]]:
    """The blocks of a page in its order, and its nodes.  Any text parses; unclosed elements end with what holds them.  Inline
    elements are no nodes: what they hold belongs to the block, or to none if by its name it is noise."""
    root = Node("", "", PLAIN, False, hashes=())
    stack, nodes, blocks, buf = [root], [root], [], []
    at = 0

    def flush() -> None:
        if buf:
            text = " ".join("".join(buf).split())
            buf.clear()
            if text:
                top = next(x for x in reversed(stack) if x.tag not in INLINE)
                blocks.append(Block(text, top.hashes, top.article))

    def said(text: str) -> None:
        if not (stack[-1].tag in INLINE and stack[-1].kind == NOISE):
            buf.append(html.unescape(text))

    for m in TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            said(page[at : m.start()])
        at, tag = m.end(), m[0]
        name = NAME.match(tag)
        if not name:
            continue
        t = name[1].lower()
        if tag[1] == "/":
            if t not in INLINE:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == t:
                    if any(x.tag not in INLINE for x in stack[k:]):
                        flush()
                    del stack[k:]
                    break
            if t == "br":
                buf.append(" ")
            continue
        if t == "br" or t == "wbr":
            buf.append(" " if t == "br" else "")
            continue
        if t not in INLINE:
            flush()
            while True:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in ENDS or stack[k].tag not in INLINE), 0)
                if k and t in ENDS.get(stack[k].tag, ()):
                    del stack[k:]
                else:
                    break
        if t in VOID:
            continue
        words, kind = _attributes(tag) if "=" in tag else ("", PLAIN)
        if re.search(r"\shidden(?=[\s/>=])", tag) or t in NOISE_TAGS:
            kind = NOISE
        elif kind and t in ("main", "body", "html"):
            kind = PLAIN
        up = stack[-1]
        if t in RAW:  # its content is no markup
            end = re.compile(f"</{t}", re.I).search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else len(page)
            continue
        own = f"{t}.{words}" if words else t
        if t in INLINE:
            stack.append(Node(t, up.path, max(kind, up.kind if up.tag in INLINE else PLAIN), up.article, hashes=up.hashes))
            continue
        up.children.append(own)
        # A kind of its own is a node of its own, even below the depth.
        path = up.path if len(stack) > DEPTH and not kind else f"{up.path}/{own}"
        hashes = up.hashes if path == up.path else (*up.hashes, _hash(f"{path}{kind or ''}"))
        node = Node(t, path, kind, up.article or t in ("article", "main") or "#main" in words or "#article" in words, hashes=hashes)
        stack.append(node)
        nodes.append(node)
    if at < len(page):
        said(page[at:])
    flush()
    return blocks, nodes


def main_text(page: str, low: frozenset[int] = frozenset()) -> str:
    """The text of the article: blocks in no branch of ``low``, by the hashes of the paths, and no features of it; only
    those within article or main elements where these hold at least half of the text."""
    blocks = [b for b in parse(page)[0] if low.isdisjoint(b.paths) and b.feature not in low]
    inside = [b for b in blocks if b.article]
    most = 2 * sum(len(b.text) for b in inside) >= sum(len(b.text) for b in blocks)
    return " ".join(b.text for b in (inside if most else blocks))


def host_of(url: str | None) -> str:
    m = HOST.match((url or "").strip())
    return m[1].lower() if m else ""


def signatures(pages: DataFrame) -> DataFrame:
    """(host, page, node, above, kind, landmark, look, words, features): for each page and path, the hashes of its presentation,
    its content and its blocks."""
    prepare(pages.sparkSession)
    schema = "host string, page long, node long, above array<long>, kind int, landmark boolean, look long, words long, features array<long>"
    types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, page in zip(batch.column("url").to_pylist(), texts(batch, "html"), strict=True):
                blocks, nodes = parse(page)
                said: dict[int, list[Block]] = {}
                for b in blocks:
                    if b.paths:
                        said.setdefault(b.paths[-1], []).append(b)
                looks: dict[int, list[str]] = {}
                at: dict[int, Node] = {}
                for n in nodes[1:]:
                    if n.hashes:
                        looks.setdefault(n.hashes[-1], []).append(",".join(n.children))
                        at.setdefault(n.hashes[-1], n)
                whole = _hash("\n".join(b.text for b in blocks))
                host = host_of(url)
                for k, look in looks.items():
                    own = said.get(k, [])
                    content = _hash("\n".join(b.text for b in own)) if own else None
                    landmark = at[k].tag in TEXT_TAGS or "#main" in at[k].path.rpartition("/")[2]
                    rows.append((host, whole, k, at[k].hashes, at[k].kind, landmark, _hash(";".join(look)), content, sorted({b.feature for b in own})))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["host", "page", "node", "above", "kind", "landmark", "look", "words", "features"])

    return pages.select(col("url").cast("string").alias("url"), col("html").alias("html")).mapInArrow(run, schema)


def _entropy(rows: DataFrame, kind: str) -> DataFrame:
    """(host, node, pages, kinds, imp): the entropy of the signatures of a node to the base of its pages."""
    one = rows.where(F.col(kind).isNotNull()).select("host", "node", "page", kind).distinct().groupBy("host", "node", kind).agg(F.count(F.lit(1)).alias("n"))
    m, s = F.sum("n"), F.sum(F.col("n") * F.log("n"))
    return one.groupBy("host", "node").agg(
        m.alias("pages"), F.count(F.lit(1)).alias("kinds"), F.when(m > 1, (F.log(m) - s / m) / F.log(m)).otherwise(F.lit(1.0)).alias("imp")
    )


def importances(sig: DataFrame) -> DataFrame:
    """(host, node, kind, landmark, pages, importance) of ``signatures``."""
    looks, words = _entropy(sig, "look"), _entropy(sig, "words").select("host", "node", F.col("imp").alias("said"))
    tree = sig.groupBy("host", "node").agg(F.first("above").alias("above"), F.max("kind").alias("kind"), F.max("landmark").alias("landmark"))
    own = tree.join(looks, ["host", "node"]).join(words, ["host", "node"], "left")
    # A node with text is as important as its content; what lies above takes the mean of those below it.
    leaves = own.where("said is not null").select("host", F.explode("above").alias("node"), "said", "pages")
    below = leaves.groupBy("host", "node").agg((F.sum(F.col("said") * F.col("pages")) / F.sum("pages")).alias("below"))
    weight = F.pow(F.lit(GAMMA), F.col("kinds"))
    shown = (1 - weight) * F.col("imp") + weight * F.coalesce("below", F.lit(1.0))
    # Text weighs more than looks: a branch whose text is the same on each page is a template however it is dressed.
    importance = F.when(F.col("below").isNotNull(), F.least(shown, F.col("below") + (1 - F.col("below")) * (1 - weight) * F.col("imp") / 2)).otherwise(shown)
    return own.join(below, ["host", "node"], "left").select("host", "node", "kind", "landmark", "pages", importance.alias("importance"))


def repeated_blocks(sig: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, node): features, blocks of text at a node, that are on more than half of the different pages that have the node."""
    pages = sig.select("host", "node", "page").distinct().groupBy("host", "node").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    with_it = sig.select("host", "node", "page", F.explode("features").alias("feature")).distinct().groupBy("host", "node", "feature").agg(F.count(F.lit(1)).alias("n"))
    return with_it.where("n > 1").join(pages, ["host", "node"]).where("2 * n > pages").select("host", F.col("feature").alias("node"))


def unimportant(pages: DataFrame, min_pages: int = MIN_PAGES, threshold: float = THRESHOLD) -> DataFrame:
    """(host, low): the nodes of low importance of each host that has any, as hashes of paths, and its repeated blocks."""
    sig = materialise(signatures(pages), "style-tree")
    known = F.col("pages") >= min_pages
    by_name = F.when(F.col("kind") == NOISE, F.lit(True)).when(F.col("kind") == UNSURE, ~known | (F.col("importance") < DOUBTFUL))
    low = by_name.otherwise(known & (F.col("importance") < threshold) & ~F.col("landmark"))
    nodes = importances(sig).where(low).select("host", "node")
    return nodes.unionByName(repeated_blocks(sig, min_pages)).groupBy("host").agg(F.collect_list("node").alias("low"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, threshold: float = THRESHOLD, broadcast: int = BROADCAST) -> DataFrame:
    """Add text and n_chars to ``pages`` (url, html); they replace columns of those names.

    A null html is empty and gives the empty text; a null or odd url belongs to the host ''.  Repeated rows get equal
    results; an empty table gives no rows.  Blocks end at block elements and are joined by one space.  Very long pages are read
    whole; below a depth of ``DEPTH`` elements belong to the node there.  Other columns stay as they are.
    """
    low = unimportant(pages, min_pages, threshold).select(F.col("host").alias("__host"), F.col("low").alias("__low"))
    host = F.lower(F.regexp_extract(F.trim(F.coalesce(col("url").cast("string"), F.lit(""))), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    low = materialise(low, "unimportant")
    size = low.agg(F.coalesce(F.sum(F.size("__low") + 8), F.lit(0)).alias("n")).first()["n"]
    rows = pages.withColumn("__h", host)
    if size <= broadcast:
        rows = rows.join(F.broadcast(low), F.col("__h") == F.col("__host"), "left")
    else:  # a host's pages go to several tasks, each with the host's list
        salted = low.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__p", F.pmod(F.xxhash64(col("url"), F.length(col("html"))), F.lit(SALTS)).cast("int"))
        rows = rows.join(salted, (F.col("__h") == F.col("__host")) & (F.col("__p") == F.col("__s")), "left").drop("__p", "__s")
    rows = rows.drop("__h", "__host")

    def make():
        def f(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            lows = batch.column("__low").to_pylist()
            out = [main_text(page, frozenset(x or ())) for page, x in zip(texts(batch, "html"), lows, strict=True)]
            return {"text": pa.array(out, pa.string()), "n_chars": pa.array([len(x) for x in out], pa.int64())}

        return f

    return append_columns(rows, make, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]).drop("__low")
