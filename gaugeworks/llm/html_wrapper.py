"""Main text of web pages by wrapper induction.

Pages of one host are written by one program. One page of each host, chosen by hash, is the pivot;
every page's DOM tree is aligned with its host's pivot by simple tree matching. A text leaf that is
equal in the pivot's aligned leaf at most pages of the host is template; all other leaves fill slots.
Slots inside navigation, adverts, forms, comments and the like, told by tag or by a whole word of class,
id or role, are no content, but an article or main element that only words of its ancestors, or a form around it, make so
counts where it holds more text than all that is free without. Slots outside the articles, or else
outside the main element, are no content where those inside hold most of the free text. What the
remaining slots hold is the text.

Evidence for a template leaf comes from pages of the same host that differ from the pivot in at least
half of their text, each different text once; so a host that is full of copies or near copies of one
page does not lose that page's text. A host with fewer than `evidence` such pages has no template.

Pivots and templates go to all tasks while they are together below BROADCAST_BYTES, and are joined
beyond that. The counts are sums that Spark pre-aggregates, so a host with very many pages is no
single group anywhere.

Defined results: null or empty html gives empty text; a null url, or one without a host, counts as the
host ''; repeated rows come back as often as they came; an element still open at the end of the page
ends there; elements nested deeper than DEPTH belong to their ancestor at that depth; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.workspace import Workspace

BROADCAST_BYTES = 32 * 2**20
DEPTH = 100
#: Cells of one alignment table; longer child lists are split in two first.
CELLS = 1_000_000

SKIPPED = frozenset("script style template noscript iframe svg object canvas title".split())
CHROME_TAGS = frozenset("nav footer aside form menu dialog button select textarea fieldset header".split())
CHROME_WORDS = frozenset(
    """ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs
    sidebar aside footer masthead toolbar pagination pager cookie cookies consent gdpr notice alert popup modal overlay
    newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist
    disqus reply replies respond complementary contentinfo search form""".split()
)
BLOCK_TAGS = CHROME_TAGS | frozenset(
    """html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article main
    figure figcaption blockquote pre address details summary hr center hgroup""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of the same kind, and the elements that the search for it stops at.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
}
FENCES = frozenset("ul ol dl table article section main aside nav div body".split())
#: Elements that take no blocks: a block's start tag ends them.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6".split())


class Node:
    """chrome: 1 by word, 2 by tag; marked: 1 in main, 2 in an article; saved: in one that chrome by word surrounds."""

    __slots__ = ("label", "children", "text", "chrome", "marked", "saved", "shape")

    def __init__(self, label: str, chrome: int = 0, marked: int = 0, saved: bool = False, text: str = ""):
        self.label, self.chrome, self.marked, self.saved, self.text = label, chrome, marked, saved, text
        self.children: list[Node] = []
        self.shape = 0


class _Builder(HTMLParser):
    """A tree of block elements and text leaves; inline elements dissolve into the text around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("body")
        self.open: list[tuple[str, Node]] = [("body", self.root)]
        self.text: list[str] = []
        self.skip: list[str] = []

    def _break(self):
        if self.text:
            text = " ".join("".join(self.text).split())
            self.text = []
            if text:
                top = self.open[-1][1]
                top.children.append(Node("#", top.chrome, top.marked, top.saved, text))

    def _close(self, tag: str, stop: frozenset = frozenset()) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k][0]
            if name == tag:
                self._break()
                del self.open[k:]
                return
            if name in stop:
                return

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.append(tag)
            return
        if tag in SKIPPED:
            self.skip.append(tag)
            return
        if tag == "br" or tag == "hr":
            self._break()
        if tag in VOID or tag in ("html", "head", "body"):
            return
        words = {w for k, v in attrs if k in ("class", "id", "role") and v for w in v.lower().split()}
        landmark = 2 if tag == "article" else 1 if tag == "main" or "main" in words and ("role", "main") in attrs else 0
        chrome = 0 if words.isdisjoint(CHROME_WORDS) and tag != "form" else 1  # a form may be around the whole page
        chrome = 0 if landmark == 1 else 2 if tag in CHROME_TAGS and tag != "form" else chrome
        if tag not in BLOCK_TAGS and not chrome:
            return
        self._break()
        if self.open[-1][0] in PARAGRAPHS and tag in BLOCK_TAGS:
            del self.open[-1:]
        for ended in ENDS.get(tag, ()):
            self._close(ended, FENCES)
        top = self.open[-1][1]
        if tag == "header" and top.marked:  # an article's own heading is part of it
            chrome = 0
        saves = landmark > top.marked and top.chrome == 1 and not chrome
        if not saves:
            chrome = max(chrome, top.chrome)
        kind = next((v or "" for k, v in attrs if k == "class"), "")
        node = Node(f"{tag} {kind}", chrome, max(top.marked, landmark), top.saved or saves)
        if len(self.open) <= DEPTH:
            top.children.append(node)
            self.open.append((tag, node))
        else:
            self.open.append((tag, top))

    def handle_startendtag(self, tag, attrs):
        if tag not in SKIPPED:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if tag in BLOCK_TAGS or any(name == tag for name, _ in self.open):
            self._break()
            self._close(tag)

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def dom(html: str) -> Node:
    """The page's tree; a tail that the parser holds back as an unfinished tag is not text."""
    builder = _Builder()
    builder.feed(html)
    if builder.rawdata and "<" not in builder.rawdata:
        builder.close()
    builder._break()
    return builder.root


class Matcher:
    """Simple tree matching: the largest order-preserving mapping of two trees with equal labels.

    Weights depend on the shapes of subtrees only, so they are kept by pair of shapes. Equal shapes at
    both ends of two child lists map to each other without a table.
    """

    def __init__(self):
        self.shapes: dict[tuple, int] = {}
        self.parts: list[tuple[str, tuple, int]] = []
        self.known: dict[tuple[int, int], int] = {}

    def shape(self, node: Node) -> int:
        key = (node.label, tuple(self.shape(c) for c in node.children))
        got = self.shapes.get(key)
        if got is None:
            got = self.shapes[key] = len(self.parts)
            self.parts.append((node.label, key[1], 1 + sum(self.parts[c][2] for c in key[1])))
        node.shape = got
        return got

    def weight(self, a: int, b: int) -> int:
        if a == b:
            return self.parts[a][2]
        if self.parts[a][0] != self.parts[b][0]:
            return 0
        got = self.known.get((a, b))
        if got is None:
            xs, ys = self.parts[a][1], self.parts[b][1]
            got = self.known[a, b] = 1 + sum(self.weight(xs[i], ys[j]) for i, j in self.pairs(xs, ys))
        return got

    def pairs(self, xs, ys) -> list[tuple[int, int]]:
        """Positions of the children that map to each other."""
        lo, m, n = 0, len(xs), len(ys)
        while lo < m and lo < n and xs[lo] == ys[lo]:
            lo += 1
        out = [(k, k) for k in range(lo)]
        while m > lo and n > lo and xs[m - 1] == ys[n - 1]:
            m, n = m - 1, n - 1
        if m > lo and n > lo:
            out += [(lo + i, lo + j) for i, j in self._table(xs[lo:m], ys[lo:n])]
        return out + [(m + k, n + k) for k in range(len(xs) - m)]

    def _weights(self, xs, ys) -> tuple[np.ndarray, np.ndarray]:
        ux, ix = np.unique(np.asarray(xs), return_inverse=True)
        uy, iy = np.unique(np.asarray(ys), return_inverse=True)
        return np.array([[self.weight(int(a), int(b)) for b in uy] for a in ux], np.int64)[:, iy], ix

    def _table(self, xs, ys) -> list[tuple[int, int]]:
        m, n = len(xs), len(ys)
        w, ix = self._weights(xs, ys)
        if m * n > CELLS and m > 1:
            half = m // 2
            back, bx = self._weights(xs[half:][::-1], ys[::-1])
            cut = int(np.argmax(_last(w, ix[:half], n) + _last(back, bx, n)[::-1]))
            left = self._table(xs[:half], ys[:cut]) if cut else []
            right = self._table(xs[half:], ys[cut:]) if cut < n else []
            return left + [(i + half, j + cut) for i, j in right]
        t = np.zeros((m + 1, n + 1), np.int64)
        for i in range(m):
            t[i + 1] = _step(t[i], w[ix[i]])
        out, i, j = [], m, n
        while i and j:
            if t[i, j] == t[i - 1, j]:
                i -= 1
            elif t[i, j] == t[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out[::-1]


def _step(row: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = row.copy()
    out[1:] = np.maximum(out[1:], row[:-1] + w)
    return np.maximum.accumulate(out)


def _last(w: np.ndarray, ix: np.ndarray, n: int) -> np.ndarray:
    row = np.zeros(n + 1, np.int64)
    for i in ix:
        row = _step(row, w[i])
    return row


def leaves(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if x.label == "#":
            out.append(x)
        todo.extend(reversed(x.children))
    return out


def slots(page: Node) -> list[Node]:
    """The text leaves that may be content: outside chrome, inside articles or main where those hold most of the text."""

    def size(some: list[Node]) -> int:
        return sum(len(x.text) for x in some)

    free = [x for x in leaves(page) if not x.chrome]
    plain = [x for x in free if not x.saved]
    if 2 * size(plain) >= size(free):
        free = plain
    for level in (2, 1):
        inside = [x for x in free if x.marked >= level]
        if 2 * size(inside) > size(free):
            return inside
    return free


def equal_leaves(page: Node, pivot: Node, place: dict[int, int]) -> dict[int, int]:
    """Page leaves (by object id) whose aligned pivot leaf has the same text, to that leaf's place."""
    match = Matcher()
    match.shape(page)
    match.shape(pivot)
    out, todo = {}, [(page, pivot)]
    while todo:
        a, b = todo.pop()
        if a.label == "#":
            if a.text == b.text:
                out[id(a)] = place[id(b)]
            continue
        xs, ys = [c.shape for c in a.children], [c.shape for c in b.children]
        todo.extend((a.children[i], b.children[j]) for i, j in match.pairs(xs, ys) if xs[i] == ys[j] or match.weight(xs[i], ys[j]))
    return out


_ALIGNED = "page_id long, url string, host string, differs boolean, slots array<int>, texts array<string>"


def _aligned_rows(batches):
    """(page_id, url, host, html, pivot) to content slots; slots: place of an equal pivot leaf, or -1."""
    kept: dict[str, tuple[Node, dict]] = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            differs, place, texts = [], [], []
            for html, pivot in zip(part.column(3).to_pylist(), part.column(4).to_pylist()):
                page = dom(html or "")
                if pivot not in kept:
                    if len(kept) > 64:
                        kept.clear()
                    tree = dom(pivot or "")
                    kept[pivot] = tree, {id(x): k for k, x in enumerate(leaves(tree))}
                tree, at = kept[pivot]
                own = slots(page)
                same = equal_leaves(page, tree, at)
                total = sum(len(x.text) for x in own)
                differs.append(2 * sum(len(x.text) for x in own if id(x) in same) < total)
                place.append([same.get(id(x), -1) for x in own])
                texts.append([x.text for x in own])
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(k) for k in range(3)),
                    pa.array(differs, pa.bool_()),
                    pa.array(place, pa.list_(pa.int32())),
                    pa.array(texts, pa.list_(pa.string())),
                ],
                names=["page_id", "url", "host", "differs", "slots", "texts"],
            )


def _beside(rows: DataFrame, facts: DataFrame, size: str) -> DataFrame:
    """rows left-joined with one fact row per host; sent to all tasks if the sum of `size` is small enough."""
    total = facts.agg(F.sum(F.expr(size))).first()[0] or 0
    return rows.join(F.broadcast(facts) if total <= BROADCAST_BYTES else facts.hint("merge"), "host", "left")


def main_text(spark: SparkSession, pages: DataFrame, share: float = 0.8, evidence: int = 5) -> DataFrame:
    """(page_id, url, text, blocks): the content slots of every page, joined and one by one."""
    work = Workspace(spark, "html-wrapper")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.regexp_extract(F.lower(F.col("url").cast("string")), r"^[a-z]+://([^/?#]*)", 1), F.lit("")).alias("host"),
        F.col("html").cast("string").alias("html"),
    )
    pivots = rows.where("html is not null").groupBy("host").agg(F.min_by("html", F.xxhash64("html")).alias("pivot"))
    pivots = work.cut(pivots, "pivots")
    both = _beside(rows, pivots, "octet_length(pivot)").select("page_id", "url", "host", "html", "pivot")
    aligned = work.cut(both.mapInArrow(_aligned_rows, _ALIGNED).withColumn("sig", F.xxhash64("texts")), "aligned")
    shown = aligned.where("differs").selectExpr("host", "sig", "filter(array_distinct(slots), s -> s >= 0) as slots").distinct()
    seen = shown.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= evidence)
    equal = shown.select("host", F.explode("slots").alias("slot")).groupBy("host", "slot").agg(F.count(F.lit(1)).alias("m"))
    fixed = equal.join(seen, "host").where(F.col("m") >= share * F.col("n"))
    template = work.cut(fixed.groupBy("host").agg(F.collect_set("slot").alias("template")), "template")
    out = _beside(aligned, template, "4 * size(template)")
    held = "filter(zip_with(slots, texts, (s, t) -> if(array_contains(template, s), null, t)), t -> t is not null)"
    out = out.withColumn("blocks", F.expr(f"case when template is null then texts else {held} end"))
    return out.select("page_id", "url", F.array_join("blocks", " ").alias("text"), "blocks")
