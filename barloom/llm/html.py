"""Main text of web pages by a site style tree.

The pages of a host are merged into one style tree. An element node has one style node for each *presentation*, the
sequence of its children as pages show it; its children are told apart by that presentation, their place and their
step (tag and class), so the tree forks wherever pages differ. Two entropies give the importance of an element node
on ``m`` pages with ``l`` presentations:

* presentation: the entropy of its presentations over ``log l``; none if there is only one;
* content: 1 less the mean of ``log n / log m`` over the texts that it holds itself, each on ``n`` pages.

They are combined from the leaves up, ``(1 - G**l) * presentation + G**l * sum(p * mean importance below)``; what fewer
than ``MIN_PAGES`` pages share, or less than a hundredth of the host's, is not judged and counts as important. A branch is removed from every page

* if its importance is below ``LOW``: what all pages say alike;
* if it is a slot of the template: of constant form beside a *region*, a container of varying form that has most of
  the siblings' informative text (characters weighted by content importance), and with little such text itself.
  Menus, adverts and footers whose words change on every page go by this. Paragraphs and headings don't.

What markup declares to be no article (navigation, footers, adverts, forms, notices, comments) is removed as well, and
declared articles and main elements are preferred; hosts with few pages have nothing else.

Statistics are sums by (host, node, feature), so a host with a third of all pages is aggregated like any other. Pages of
one host with equal html count once.
"""

from __future__ import annotations

import marshal
import re
import struct
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stash

G = 0.9  # weight of what lies below against presentation
MIN_PAGES, SHARE = 3, 0.01  # a node is judged on at least so many pages, and on this share of the host's
LOW = 0.25  # below this importance a node goes
REGION, SLOT = 0.5, 0.2  # share of the siblings' text that makes a region; a slot has less than this part of its text
DEPTH = 64  # style nodes are told apart down to here; what is deeper is judged with its ancestor
BROADCAST_NODES = 500_000  # nodes that are sent to every task; more are joined by host

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: a start tag closes these open elements, looked for no further than the boundary tags
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
# what markup declares to be no article
NOISE_TAGS = frozenset(
    "nav aside footer form script style noscript template button select textarea title head iframe dialog menu svg math object canvas audio video map fieldset noembed noframes xmp datalist".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup nav navbar navigation navi menu menus topnav breadcrumb breadcrumbs sidebar sidebars aside rail footer "
    "comment comments commentlist respond reply replies disqus discussion share sharing social related recommended recommendations widget widgets pagination pager toolbar login "
    "search searchbox skip copyright disclaimer masthead topbar form feedback".split()
)
HEADER_WORDS = frozenset(("header", "head", "topbar", "masthead"))
ARTICLE_WORDS = frozenset("article entry post story content".split())
NOT_REALLY = frozenset("no with without has non".split())

# a "<" outside quotes ends the first form of a tag, so that hostile markup can't make it look ahead again and again
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>?", re.S
)
KEEP = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        found.setdefault(name.lower(), value)
    return found


def _noise(tag: str, text: str, in_article: bool) -> bool:
    """Whether the element itself says that it is no article."""
    if tag in NOISE_TAGS:
        return True
    if tag == "header":
        return not in_article
    if not text or not text.strip(" /"):
        return False
    at = _attributes(unescape(text) if "&" in text else text)
    if "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", "").lower():
        return True
    if at.get("role", "").lower() in NOISE_ROLES:
        return True
    if tag in ("html", "body", "main"):
        return False
    for name in f"{at.get('class', '')} {at.get('id', '')}".split():
        words = [w.lower() for w in WORD.findall(name)]
        if not words or words[0] in NOT_REALLY:
            continue
        if NOISE_WORDS.intersection(words):
            return True
        if not in_article and HEADER_WORDS.intersection(words) and not ARTICLE_WORDS.intersection(words):
            return True
    return False


class Node:
    """An open element; ``at`` is the number of its style node, or of the nearest one above it."""

    __slots__ = ("tag", "noise", "article", "at", "inline")

    def __init__(self, tag: str, noise: bool, article: int, at: int, inline: bool):
        self.tag, self.noise, self.article, self.at, self.inline = tag, noise, article, at, inline


def _hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) - (1 << 63)


class Page:
    """Blocks of a page in order, each with its element; parsing is forgiving and linear in the page.

    ``blocks``: (text, number of its style node, noise, article, tag); article is 2 inside an article, 1 inside a main
    element, else 0. ``nodes``: (number of the parent, depth, step, children's steps) of the block elements, parents first.
    """

    def __init__(self, html: str | None):
        self.blocks: list[tuple[str, int, bool, int, str]] = []
        self.nodes: list[tuple[int, int, str, list[str]]] = [(-1, 0, "", [])]
        self.stack = [Node("", False, 0, 0, False)]
        self.places: dict[str, list[int]] = {}  # where the stack has a tag
        self.solid = [0]  # where it has block elements
        self.text: list[str] = []
        self.owner = self.stack[0]
        html = html or ""
        at, last = 0, html.rfind(">")
        search = TOKEN.search
        while True:
            m = search(html, at) if at <= last else None
            if m is None:
                rest = html[at:]
                cut = rest.find("<!--")
                self._characters(rest if cut < 0 else rest[:cut])
                break
            if m.start() > at:
                self._characters(html[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                self._end(tag)
                continue
            text = m[3] or m[6] or ""
            self._start(tag, text)
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(html, at)
                at = close.end()
                self._end(tag)
        self._flush()

    def _characters(self, text: str) -> None:
        if not self.text and text.isspace():
            return
        if not self.text:
            self.owner = self.stack[-1]
        self.text.append(text)

    def _flush(self) -> None:
        if self.text:
            text = " ".join(unescape("".join(self.text)).split())
            self.text = []
            if text:
                o = self.owner
                seen = self.nodes[o.at][3]
                if not seen or seen[-1] != "#":
                    seen.append("#")
                self.blocks.append((text, o.at, o.noise, o.article, self.nodes[o.at][2].partition(".")[0]))

    def _push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if not node.inline:
            self.solid.append(len(self.stack))
        self.stack.append(node)

    def _cut(self, k: int) -> None:
        for node in self.stack[k:]:
            self.places[node.tag].pop()
        del self.stack[k:]
        while self.solid[-1] >= k:
            self.solid.pop()

    def _where(self, tags: Iterable[str]) -> int:
        """The furthest place in the stack that has one of these tags, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _start(self, tag: str, text: str) -> None:
        if tag in ("html", "body") and self.places.get(tag):
            return
        inline = tag in INLINE
        if tag == "br":
            if self.text:
                self.text.append(" ")
            return
        if not inline:
            if tag not in ("td", "th"):
                self._flush()
            elif self.text:
                self.text.append(" ")
            if tag in CLOSES_P:
                self._close(("p",), ("button", "table", "td", "th", "article", "section", "div", "li"))
            elif tag in IMPLIED:
                self._close(*IMPLIED[tag])
        if tag in VOID:
            return
        top = self.stack[-1]
        noise = top.noise or _noise(tag, text, top.article == 2)
        article = top.article
        if not noise:
            if tag == "article" or "articleBody" in text:
                article = 2
            elif article == 0 and (tag == "main" or 'role="main"' in text):
                article = 1
        at = top.at
        depth = self.nodes[at][1] + 1
        if not inline and depth <= DEPTH and tag not in RAW:
            names = " ".join(sorted(_attributes(text).get("class", "").split())) if text and "class" in text else ""
            step = f"{tag}.{names}" if names else tag
            self.nodes[at][3].append(step)
            self.nodes.append((at, depth, step, []))
            at = len(self.nodes) - 1
        if inline and noise and not top.noise:  # an inline advert or hidden part is a branch of its own
            self._flush()
        self._push(Node(tag, noise, article, at, inline))

    def _close(self, tags: Iterable[str], stop: Iterable[str]) -> None:
        k = self._where(tags)
        if k > self._where(stop):
            self._cut(k)

    def _end(self, tag: str) -> None:
        if tag == "br":
            return
        if tag not in INLINE:
            if tag in ("td", "th"):
                if self.text:
                    self.text.append(" ")
            else:
                self._flush()
        if not self.places.get(tag):
            return
        k = self.places[tag][-1]
        if tag in INLINE:
            if k < self.solid[-1]:
                return
            if self.stack[k].noise and not self.stack[k - 1].noise:
                self._flush()
        self._cut(k)

    def tree(self) -> tuple[list[tuple], list[tuple[str, int, bool, int, str]]]:
        """Style nodes as (parent's number, depth, id, presentation, leaf, kept tag) and the blocks."""
        out: list[tuple] = []
        places = [0] * len(self.nodes)
        for parent, depth, step, children in self.nodes:
            shape = _hash("\x1f".join(children).encode())
            if parent < 0:
                node = 0
            else:
                above = out[parent]
                node = _hash(struct.pack("<qqi", above[2], above[3], places[parent]) + step.encode())
                places[parent] += 1
            leaf = not any(c != "#" for c in children)
            out.append((parent, depth, node, shape, leaf, step.partition(".")[0] in KEEP))
        return out, self.blocks


def main_text(nodes: list[tuple], blocks: list[tuple], low: frozenset[int] = frozenset(), markup: bool = True) -> str:
    """The article's blocks without branches of low importance and, with ``markup``, without what is declared to be no article.

    The region is the page's articles, else its main element, else all of it. Inside a declared article only
    containers can be of low importance, not paragraphs or headings. If nothing is left, the style tree's
    verdict is dropped for this page.
    """
    if markup:
        blocks = [b for b in blocks if not b[2]]
        best = max((b[3] for b in blocks), default=0)
        blocks = [b for b in blocks if b[3] == best] if best == 2 else [b for b in blocks if b[3] >= best]
    if low:
        gone = [False] * len(nodes)
        for k, node in enumerate(nodes):  # parents first
            gone[k] = node[2] in low or (node[0] >= 0 and gone[node[0]])
        spared = lambda b: markup and b[3] == 2 and nodes[b[1]][5]
        left = [b for b in blocks if not gone[nodes[b[1]][0] if spared(b) else b[1]]]
        blocks = left or blocks
    return "\n".join(b[0] for b in blocks)


HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _with_host(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    return pages.select("page_id", url.alias("url"), F.coalesce(F.regexp_extract(F.lower(url), HOST, 1), F.lit("")).alias("host"), F.col("html").cast("string").alias("html"))


PARSED = "url string, host string, mark binary, tree binary, row long"


def parse(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, mark, tree, row``: every page's style nodes and blocks (serialized), a hash of its html, and a number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, trees = [], []
            for html in batch.column(3):
                html = html.as_py() or ""
                marks.append(xxhash.xxh3_128_digest(html.encode()))
                trees.append(marshal.dumps(Page(html).tree()))
            columns = [*batch.columns[:3], pa.array(marks, pa.binary()), pa.array(trees, pa.binary()), batch.column(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "mark", "tree", "row"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return _with_host(pages).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, f"page_id {kind}, {PARSED}")


def _counted(schema: str, batches: Iterable[pa.RecordBatch], emit) -> Iterator[pa.RecordBatch]:
    """Rows ``(*key, n)`` of the keys and numbers that ``emit(batch row)`` yields, summed as far as 100,000 keys go."""
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        columns = list(zip(*counts, strict=True)) or [()] * (len(fields) - 1)
        out = [pa.array(c, kinds[k]) for c, (_, k) in zip([*columns, tuple(counts.values())], fields, strict=True)]
        counts.clear()
        return pa.RecordBatch.from_arrays(out, names=[n for n, _ in fields])

    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            for key, n in emit(*row):
                counts[key] += n
            if len(counts) > 100_000:
                yield flush()
    if counts:
        yield flush()


NODES = "host string, node long, shape long, parent long, parent_shape long, depth int, leaf boolean, kept boolean, n long"
TEXTS = "host string, node long, feature long, chars long, n long"


def structure(parsed: DataFrame) -> DataFrame:
    """``NODES``: on how many pages each style node, an element node in one presentation, is."""

    def emit(host, tree):
        nodes, _ = marshal.loads(tree.as_py())
        host = host.as_py()
        for parent, depth, node, shape, leaf, kept in nodes:
            above = nodes[parent] if parent >= 0 else (0, 0, 0, 0)
            yield (host, node, shape, above[2], above[3], depth, leaf, kept), 1

    rows = parsed.select("host", "tree").mapInArrow(lambda b: _counted(NODES, b, emit), NODES)
    return rows.groupBy(*[x.split()[0] for x in NODES.split(", ")][:-1]).agg(F.sum("n").alias("n"))


class _Nodes:
    """A set of nodes for each host. A bounded number of nodes goes to every task; more are joined by host, where large hosts can be split."""

    def __init__(self, nodes: DataFrame):
        spark = nodes.sparkSession
        self.name = uuid.uuid4().hex
        self.table = stash(nodes.groupBy("host").agg(F.collect_list("node").alias("ids")), "hosts")
        self.shared = None
        if self.table.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0] <= BROADCAST_NODES:
            self.shared = spark.sparkContext.broadcast({r["host"]: np.array(r["ids"], np.int64) for r in self.table.collect()})

    def attach(self, rows: DataFrame) -> DataFrame:
        if self.shared is not None:
            return rows.withColumn("ids", F.lit(None).cast("array<bigint>"))
        return rows.join(self.table, "host", "left")

    def reader(self):
        """A function of a host and its ``ids`` (an Arrow scalar) that gives the host's set; for use in tasks."""
        shared, name = self.shared, self.name

        def of(host: str, ids) -> frozenset[int]:
            known = _SETS.setdefault(name, {})
            if len(_SETS) > 1:  # sets of an earlier step
                for other in [k for k in _SETS if k != name]:
                    del _SETS[other]
            found = known.get(host)
            if found is None:
                if len(known) > 10_000:
                    known.clear()
                found = known[host] = frozenset(shared.value.get(host, _NONE).tolist() if shared is not None else ids.as_py() or ())
            return found

        return of


_SETS: dict[str, dict[str, frozenset[int]]] = {}  # one a Python worker
_NONE = np.empty(0, np.int64)


def contents(parsed: DataFrame, shared: _Nodes) -> DataFrame:
    """``TEXTS``: on how many pages each text of a judged node is (``feature``), and the characters of unjudged nodes below it (feature null).

    ``shared`` holds the judged nodes.
    """
    judged_of = shared.reader()

    def emit(host, tree, ids):
        nodes, blocks = marshal.loads(tree.as_py())
        host = host.as_py()
        judged = judged_of(host, ids)
        home = []  # the nearest judged node above, by number
        for parent, _, node, *_ in nodes:
            home.append(node if node in judged else (home[parent] if parent >= 0 else 0))
        seen = set()
        for text, at, *_ in blocks:
            if nodes[at][2] == home[at]:
                seen.add((host, home[at], _hash(text.encode()), len(text)))
            else:
                yield (host, home[at], None, 0), len(text)
        for key in seen:
            yield key, 1

    rows = shared.attach(parsed.select("host", "tree")).select("host", "tree", "ids").mapInArrow(lambda b: _counted(TEXTS, b, emit), TEXTS)
    return rows.groupBy("host", "node", "feature", "chars").agg(F.sum("n").alias("n"))


def importance(nodes: DataFrame, shapes: DataFrame, texts: DataFrame) -> DataFrame:
    """``host, node, parent, parent_shape, presentation, importance, mass, leaf, kept`` of the judged ``nodes``, from the leaves up.

    ``mass`` is the informative text of a page below the node, in characters times content importance.
    """
    same = F.when(F.col("m") > 1, F.log("n") / F.log("m")).otherwise(0.0)
    own = texts.join(nodes.select("host", "node", "m"), ["host", "node"]).withColumn("same", F.when(F.col("feature").isNotNull(), F.least(same, F.lit(1.0))))
    own = own.groupBy("host", "node").agg(
        (1 - F.avg("same")).alias("content"),
        F.sum(F.when(F.col("feature").isNull(), F.col("n")).otherwise(F.col("n") * F.col("chars") * (1 - F.col("same")))).alias("own_mass"),
    )
    nodes = stash(nodes.join(own, ["host", "node"], "left").withColumn("own_mass", F.coalesce("own_mass", F.lit(0.0))), "nodes")
    deepest = nodes.agg(F.coalesce(F.max("depth"), F.lit(-1))).first()[0]
    weight = F.pow(F.lit(G), F.col("l"))
    done, below = None, None
    for depth in range(deepest, -1, -1):
        here = nodes.where(F.col("depth") == depth).join(shapes, ["host", "node"])
        if below is None:
            here = here.withColumn("kids", F.lit(0).cast("long")).withColumn("kid_sum", F.lit(0.0)).withColumn("kid_mass", F.lit(0.0))
        else:
            kids = below.groupBy(F.col("host"), F.col("parent").alias("node"), F.col("parent_shape").alias("shape"))
            kids = kids.agg(F.count("*").alias("kids"), F.sum("importance").alias("kid_sum"), F.sum("mass").alias("kid_mass"))
            here = here.join(kids, ["host", "node", "shape"], "left").fillna({"kids": 0, "kid_sum": 0.0, "kid_mass": 0.0})
        # a presentation's importance: the mean over its judged children and the node's own text
        parts = F.col("kids") + F.when(F.col("content").isNotNull(), 1).otherwise(0)
        style = F.when(parts > 0, (F.col("kid_sum") + F.coalesce("content", F.lit(0.0))) / parts).otherwise(1.0)
        keys = ["host", "node", "parent", "parent_shape", "m", "l", "presentation", "leaf", "kept", "own_mass"]
        level = here.groupBy(*keys).agg(F.sum(F.col("n") * style).alias("styles"), F.sum("kid_mass").alias("kid_mass"))
        level = level.withColumn("importance", (1 - weight) * F.col("presentation") + weight * F.col("styles") / F.col("m"))
        below = stash(level.withColumn("mass", F.col("own_mass") + F.col("kid_mass")).drop("own_mass", "kid_mass", "styles", "l"), "level")
        done = below if done is None else done.unionByName(below)
    return done


def low_nodes(judged: DataFrame, low: float = LOW) -> DataFrame:
    """``host, node`` of the branches to remove; ``judged`` are the rows of :func:`importance`."""
    few = judged.where(F.col("importance") < low).select("host", "node")
    child = F.struct("mass", "node", "presentation", "leaf", "kept")
    # the children of one style node: as many as an element of a page has
    siblings = judged.where("parent <> node").groupBy("host", "parent", "parent_shape").agg(F.sum("mass").alias("all"), F.max(child).alias("top"), F.collect_list(child).alias("children"))
    region = siblings.where(f"not top.leaf and top.presentation > 0 and top.mass >= {REGION} * all")
    slot = f"c -> c.node <> top.node and not c.kept and c.mass < {SLOT} * top.mass and c.presentation < 0.5 * top.presentation"
    slots = region.select("host", F.explode(F.expr(f"transform(filter(children, {slot}), c -> c.node)")).alias("node"))
    return few.unionByName(slots).distinct()


def _once(parsed: DataFrame) -> DataFrame:
    """One row of those with equal host and html: the copies' keys are joined to the rows, trees aren't moved."""
    copies = parsed.groupBy("host", "mark").agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1").select("host", "mark", "first")
    copies = stash(copies, "copies")
    marked = parsed.join(F.broadcast(copies) if copies.count() <= BROADCAST_NODES else copies, ["host", "mark"], "left")
    return marked.where(F.col("first").isNull() | (F.col("first") == F.col("row"))).drop("first")


def style_verdicts(parsed: DataFrame, min_pages: int = MIN_PAGES, low: float = LOW) -> _Nodes:
    """The nodes to remove from each host's pages; ``parsed`` as :func:`parse` gives it, stashed."""
    once = _once(parsed)
    styles = stash(structure(once), "structure")
    entropy = F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")
    shape = F.when(F.count("*") > 1, entropy / F.log(F.count("*"))).otherwise(0.0)
    keys = ["host", "node", "parent", "parent_shape", "depth", "kept"]
    nodes = styles.groupBy(*keys).agg(F.sum("n").alias("m"), F.count("*").alias("l"), shape.alias("presentation"), F.min("leaf").alias("leaf"))
    sizes = styles.where("depth = 0").groupBy("host").agg(F.sum("n").alias("pages"))  # every page has one root
    nodes = nodes.where(F.col("m") >= min_pages).join(sizes, "host").where(F.col("m") >= F.col("pages") * SHARE).drop("pages")
    nodes = stash(nodes, "judged")
    shapes = stash(styles.join(nodes.select("host", "node"), ["host", "node"], "left_semi").select("host", "node", "shape", "n"), "shapes")
    texts = stash(contents(once, _Nodes(nodes)), "texts")
    judged = importance(nodes, shapes, texts)
    return _Nodes(nodes.where("false") if judged is None else stash(low_nodes(judged, low), "low"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, low: float = LOW, markup: bool = True) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; ``markup=False`` leaves the decision to the style tree alone.

    Null or empty html gives an empty text; null urls and urls without a host share one style tree; repeated
    rows stay repeated; other columns are ignored.
    """
    parsed = stash(parse(pages), "parsed", "zstd")
    gone = style_verdicts(parsed, min_pages, low)
    low_of = gone.reader()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(*marshal.loads(t.as_py()), low_of(h.as_py(), g), markup) for h, t, g in zip(*batch.columns[2:5], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    joined = gone.attach(parsed.select("page_id", "url", "host", "tree")).select("page_id", "url", "host", "tree", "ids")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
