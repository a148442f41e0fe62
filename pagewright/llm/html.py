"""Main-text extraction with a site style tree.

Pages of a host are merged into one tree.  An element node is the path of tags
and classes from the root; under it stand the presentation styles that pages
show there (the sequence of children) and the contents (the node's own texts;
those of its children are theirs).  A node's importance is an entropy in units
of the largest that its pages could give: near 1 where every page shows
something else, near 0 where a site repeats itself.  Pages of which the tree
would hold the same count once (for their host, and in the tree of all hosts).
A node that few pages of its host have is judged with the tree of all hosts.

From each page the texts of low-importance nodes go, inside and outside of what
a page marks as its article, and so do the branches that are noise by their own
markup (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
reader comments; a class word does not count on what the page's article is in).  A node's verdict is about its own texts alone, so a node that
a site repeats takes nothing of its children away.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_join, map_batches, materialize

#: Distinct pages of a host from which its own tree decides; with fewer, the tree of all hosts does.
MIN_PAGES = 8
LEAST_IMPORTANCE = 0.5
#: How much of a node's importance is its presentation's.
GAMMA = 0.1

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
NOISE_TAGS = frozenset("nav header footer aside form script style noscript template head iframe object svg canvas button select textarea input menu dialog title xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul".split())
#: Without a class, these are part of the text around them and no nodes of their own.
PHRASES = frozenset("abbr b bdi bdo cite code dfn em i kbd mark q s samp small span strong sub sup u var".split())
#: A class or id is noise if each part of it between - and _ is one of these words or a word of place.
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer header masthead menu nav navbar navigation newsletter notice popup promo promoted related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
PLACE_WORDS = frozenset("area bar block bottom box button buttons container inner left links list main outer page posts right section site sticky top wrap wrapper".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Elements that close an open <p>, and what an element of a list or table closes.
CLOSES_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr li dd dt legend summary figcaption".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"})}

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?]|/(?![A-Za-z]))[^>]*(?:>|\Z)", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_GAP, _NAME, _EQUALS, _BARE = (re.compile(x) for x in (r"[\s/]*", r"=?[^\s=>/]*", r"\s*=\s*", r"[^\s>]*"))
_PARTS = re.compile(r"[-_]+")
_SPACE = re.compile(r"\s+")


class Node:
    """An element: path hash, noise verdict by markup, and the node (itself, but for phrases) that its children and texts belong to.

    ``hidden`` is noise by tag, role or the hidden attribute, ``marked`` noise by a class or id, which does not hold for what
    the page's article is in (``holds``)."""

    __slots__ = ("tag", "path", "parent", "hidden", "marked", "holds", "noise", "owner", "children", "texts")

    def __init__(self, tag: str, path: int, parent: Node | None, hidden: bool = False, marked: bool = False, phrase: bool = False):
        self.tag, self.path, self.parent, self.hidden, self.marked, self.holds, self.noise = tag, path, parent, hidden, marked, False, False
        self.owner: Node = parent.owner if phrase else self
        self.children: list[str] = []
        self.texts: list[str] = []


class Scanner:
    """Tags of a page; every character is looked at a bounded number of times, whatever is left open."""

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'"}

    def tag(self, at: int) -> tuple[int, list[tuple[str, str]], bool] | None:
        """The end of a tag whose name ends at ``at``, its attributes, and whether it closes itself; None if it never ends."""
        page, attributes, slash = self.page, [], False
        while True:
            gap = _GAP.match(page, at)
            at, slash = gap.end(), "/" in gap.group()
            if at >= len(page):
                return None
            if page[at] == ">":
                return at + 1, attributes, slash
            name = _NAME.match(page, at)
            at, value = name.end(), ""
            equals = _EQUALS.match(page, at)
            if equals:
                at = equals.end()
                quote = page[at : at + 1]
                if quote in self.last and at < self.last[quote]:
                    end = page.index(quote, at + 1)
                    value, at = page[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(page, at)
                    value, at = bare.group(), bare.end()
            attributes.append((name.group().lower(), value))


def _judged(attributes: list[tuple[str, str]]) -> tuple[str, bool, bool]:
    """The class names that are part of a path, and whether the attributes hide the element or mark it as noise."""
    classes, hidden, marked = "", False, False
    for name, value in attributes:
        if name == "class":
            classes = " ".join(sorted(value.lower().split()))
        if name in ("class", "id"):
            for token in value.lower().split():
                words = _PARTS.split(token)
                if any(w in NOISE_WORDS for w in words) and all(w in NOISE_WORDS or w in PLACE_WORDS for w in words):
                    marked = True
        elif name == "hidden" or (name == "role" and value.lower() in NOISE_ROLES):
            hidden = True
    return classes, hidden, marked


def parse(page: str) -> list[tuple[str, object]]:
    """Events of a page in order: ("open", node), ("close", node), ("text", string) and ("break", tag).

    Wrong markup is repaired as browsers do in the common cases: unclosed <p>,
    <li> and table cells end where a sibling starts, stray end tags are skipped,
    what is open at the end is closed there.  The page's article is its first
    <main>, else the outermost <article> with most text; an element that it is in, and
    itself, is no noise by a class word."""
    events: list[tuple[str, object]] = []
    stack = [Node("", 0, None)]
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of each tag, so that nothing is searched for
    blocks = [0]
    nodes: list[Node] = []
    scanner = Scanner(page)
    main, article, longest, began, length = None, None, 0, None, 0
    at, raw, size = 0, None, len(page)

    def close_to(depth: int) -> None:
        nonlocal article, longest, began
        while len(stack) > depth:
            node = stack.pop()
            places[node.tag].pop()
            if node.tag in BLOCKS:
                blocks.pop()
            events.append(("close", node))
            if began and node is began[0]:
                if length - began[1] > longest:
                    article, longest = node, length - began[1]
                began = None

    while at < size:
        if raw:
            end = re.compile(rf"</{re.escape(raw)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            stop = end.start() if end else size
            if stop > at:
                events.append(("text", page[at:stop]))
            at, raw = (end.end() if end else size), None
            close_to(len(stack) - 1)
            continue
        start = page.find("<", at)
        if start < 0:
            start = size
        if start > at:
            events.append(("text", page[at:start]))
            length += start - at
        if start == size:
            break
        m = _TAG.match(page, start)
        if not m:
            skipped = _COMMENT.match(page, start)
            at = skipped.end() if skipped else start + 1
            if not skipped:
                events.append(("text", "<"))
            continue
        tag, got = m.group(2).lower(), scanner.tag(m.end())
        if got is None:  # the page ends inside the tag
            events.append(("text", page[start:]))
            break
        at, attributes, slash = got
        if m.group(1):
            if places[tag]:
                close_to(places[tag][-1])
            continue
        if tag in CLOSES_P and stack[blocks[-1]].tag == "p":
            close_to(blocks[-1])
        if tag in CLOSES:
            shut, scope = CLOSES[tag]
            within = max(places[x][-1] if places[x] else 0 for x in scope)
            inside = [places[x][bisect(places[x], within)] for x in shut if places[x] and places[x][-1] > within]
            if inside:
                close_to(min(inside))
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                events.append(("break", tag))
            continue
        classes, hidden, marked = _judged(attributes) if attributes else ("", False, False)
        parent = stack[-1]
        if tag in PHRASES and not (classes or hidden or marked):
            node = Node(tag, parent.path, parent, phrase=True)
        else:
            parent.owner.children.append(f"{tag}.{classes}")
            node = Node(tag, xxhash.xxh3_64_intdigest(f"{parent.path}/{tag}.{classes}".encode("utf-8", "replace")) >> 1, parent, hidden or tag in NOISE_TAGS, marked)
        nodes.append(node)
        events.append(("open", node))
        if slash and tag in ("svg", "iframe", "script", "template"):
            events.append(("close", node))
            continue
        if tag in BLOCKS:
            blocks.append(len(stack))
        places[tag].append(len(stack))
        stack.append(node)
        if tag == "main":
            main = main or node
        elif tag == "article" and not began:
            began = (node, length)
        if tag in RAW:
            raw = tag
    close_to(1)
    holder = main or article
    while holder:
        holder.holds, holder = True, holder.parent
    for node in nodes:  # parents come first
        node.noise = node.parent.noise or node.hidden or (node.marked and not node.holds)
    return events


def tree_rows(page: str) -> list[tuple[int, int, int]]:
    """(path, presentation, content) of each path of a page that has texts of its own: hashes of the children that it shows there and of those texts."""
    shown: dict[int, tuple[list[str], list[str]]] = {}
    stack: list[Node] = []
    for kind, x in parse(page):
        if kind == "open":
            stack.append(x)
        elif kind == "close":
            stack.pop()
            if x.owner is x and not x.noise:
                styles, texts = shown.setdefault(x.path, ([], []))
                styles.append(",".join(x.children))
                texts.extend(x.texts)
        elif kind == "text" and stack and not stack[-1].noise and not x.isspace():
            stack[-1].owner.texts.append(x)
    digest = lambda x: xxhash.xxh3_64_intdigest("\x00".join(x).encode("utf-8", "replace")) >> 1
    return [(path, digest(a), digest(b)) for path, (a, b) in shown.items() if b]


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def tree_nodes(pages: DataFrame) -> DataFrame:
    """host, page (a hash of its html), same (a hash of what the tree would hold of it), path, style and content of each page's nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, key, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shown = sorted(tree_rows(page or ""))
                same = xxhash.xxh3_64_intdigest(repr(shown).encode()) >> 1
                rows += [(host, key, same, *x) for x in shown]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["host", "page", "same", "path", "style", "content"])

    nodes = map_batches(pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html"), run, "host string, page long, same long, path long, style long, content long")
    return materialize(nodes.distinct(), "style-nodes")


def importance(nodes: DataFrame) -> DataFrame:
    """host ('' for the tree of all hosts), path, pages and importance of each node of the merged trees.

    Counts are of distinct pages (of the same host, or in the tree of all hosts of any) and
    summed in two steps, by style and by node, so a large host is no single group."""
    nodes = nodes.drop("page").distinct()
    every = nodes.drop("host").distinct().withColumn("host", F.lit(""))
    nodes = materialize(nodes.filter("host <> ''").unionByName(every), "style-distinct")

    def entropies(column: str) -> DataFrame:
        one = nodes.groupBy("host", "path", F.col(column).alias("x")).agg(F.count(F.lit(1)).alias("c"))
        sums = one.groupBy("host", "path").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))
        # Entropy of the shares c / m, by log m.
        return sums.select("host", "path", "m", F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0).alias(column))

    joined = entropies("style").join(entropies("content").drop("m"), ["host", "path"])
    return joined.select("host", "path", F.col("m").alias("pages"), (GAMMA * F.col("style") + (1 - GAMMA) * F.col("content")).alias("importance"))


def extract(page: str, dull: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's text without noise by markup and without the own texts of the nodes whose path is in ``dull``."""
    blocks: list[str] = []
    parts: list[str] = []

    def cut() -> None:
        text = _SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            blocks.append(text)

    stack = [True]
    for kind, x in parse(page):
        if kind == "open":
            if x.tag in BLOCKS:
                cut()
            stack.append(not x.noise and x.path not in dull)
        elif kind == "close":
            if x.tag in BLOCKS:
                cut()
            stack.pop()
        elif kind == "text":
            if stack[-1]:
                parts.append(entities.unescape(x) if "&" in x else x)
        elif stack[-1]:
            if x == "hr":
                cut()
            elif x == "br":
                parts.append(" ")
    cut()
    return "\n".join(blocks)


def dull_paths(tree: DataFrame, least: float, min_pages: int) -> DataFrame:
    """host and path of the nodes whose texts go: judged by the host's own tree where enough of its pages show them, else by that of all hosts."""
    every = materialize(tree.filter((F.col("host") == "") & (F.col("pages") >= min_pages) & (F.col("importance") < least)).select("path"), "style-every")
    of_host = tree.filter(F.col("host") != "")
    own = of_host.filter((F.col("pages") >= min_pages) & (F.col("importance") < least)).select("host", "path")
    rest = bounded_join(of_host.filter(F.col("pages") < min_pages).select("host", "path"), every, ["path"], "left_semi").select("host", "path")
    return materialize(own.unionByName(rest).unionByName(every.select(F.lit("").alias("host"), "path")), "style-dull")


def main_text(pages: DataFrame, least: float = LEAST_IMPORTANCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html; other columns are ignored).

    Null or empty html gives an empty text.  A page whose url has no host, or
    whose host has few distinct pages, is judged with the tree of all hosts.  Repeated rows
    give repeated results; an empty table gives an empty one.  Up to BROADCAST_ROWS
    low-importance paths go to every task; more are joined with the pages' own paths.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    pages = pages.withColumn("host", host_of(F.col("url"))).withColumn("dull", F.lit(None).cast("array<long>"))
    nodes = tree_nodes(pages)
    dull = dull_paths(materialize(importance(nodes), "style-tree"), least, min_pages)
    few = dull.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    by_host: dict[str, set[int]] = {}
    if few:
        for r in dull.toLocalIterator():
            by_host.setdefault(r["host"], set()).add(r["path"])
    else:  # too many to replicate: each page gets those of its own paths
        found = nodes.select("host", "page", "path").distinct().hint("merge").join(dull, ["host", "path"]).groupBy("host", "page").agg(F.collect_list("path").alias("dull"))
        pages = bounded_join(pages.drop("dull").withColumn("page", F.xxhash64("html")), materialize(found, "style-pages"), ["host", "page"], "left")
    shared = pages.sparkSession.sparkContext.broadcast(by_host)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page or "", shared.value.get(host, frozenset()) if own is None else set(own)) for page, host, own in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select("page_id", "url", "html", "host", "dull"), run, "page_id long, url string, text string, n_chars long")
