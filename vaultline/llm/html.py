"""Main text of web pages by wrapper induction (operator 4).

Pages of a host are grouped by layout, the tags of the page's first levels. The page of a layout with the fewest nodes is its
reference; every page's DOM tree is aligned with it by simple tree matching: roots match if their tags agree, and their
children in order, so that the number of matched nodes is the largest. A reference node whose text is the same on nearly all
pages is constant and becomes template; one whose text is mostly links on most pages is a menu; all others are slots, and a
page's text is that of its slots and of nodes without a partner.

Elements that HTML defines as something else than the article (nav, footer, aside, forms, scripts) never count. Names in class
and id, and being outside of article or main, are priors: advert slots and reader comments vary from page to page as content
does. What the aligned pages of a layout say overrules them: names that would take all of the text that varies, and a main
element that holds next to none of it, are not believed.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import discard, map_arrow, table, written
from .urls import host_and_path

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>?)", re.S
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_set = lambda s: frozenset(s.split())
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style textarea title xmp iframe noembed noframes")
BLOCKS = _set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
)
#: Elements and roles that never hold article text.
OTHER = _set("aside button datalist dialog footer form head input label link meta nav noscript object option select svg template textarea")
ROLES = _set("navigation menu menubar banner contentinfo complementary search dialog alertdialog form")
#: Names that say so of any element if all words of a class or id are among them or neutral: `comment-list`, but not `related-work`.
NAMED = _set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs "
    "pagination pager notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login "
    "sidebar aside related recommended share sharing social comment comments disqus replies respond footer copyright"
)
NEUTRAL = _set("site page main top bottom left right box container wrapper wrap list item items block section area bar global primary secondary inner outer panel group zone slot widget module")
#: Their ids name places in the text.
TEXTUAL = _set("h1 h2 h3 h4 h5 h6 p blockquote figure li pre dt dd")
#: Tags that a start tag closes when they are open and no element of the second set is in between.
CLOSED_BY = {
    **dict.fromkeys(_set("li"), (_set("li"), _set("ul ol menu"))),
    **dict.fromkeys(_set("dt dd"), (_set("dt dd"), _set("dl"))),
    **dict.fromkeys(_set("td th"), (_set("td th"), _set("table tr"))),
    **dict.fromkeys(_set("tr"), (_set("tr"), _set("table"))),
    **dict.fromkeys(BLOCKS - _set("li dt dd td th tr html body"), (_set("p"), _set("table td th button"))),
}


class Page:
    """Block elements of a page in document order (parent, tag), and its blocks of text: (node, text, other, named, main, linked).

    Other: in an element that is no article by definition; named: by a class or id; main: inside article or main; linked: mostly links.
    """

    def __init__(self, source: str) -> None:
        self.parents, self.tags, self.blocks = [], [], []
        self._read(source)
        own: dict[int, list[str]] = {}
        for node, text, *_ in self.blocks:
            own.setdefault(node, []).append(text)
        self.hashes = [xxhash.xxh64_intdigest("\n".join(own[i])) >> 1 if i in own else 0 for i in range(len(self.tags))]

    def _read(self, source: str) -> None:
        # the stack of open elements: tag, node of the block around, other, named, main, in a link; and how many of each tag are open
        stack: list[tuple[str, int, bool, bool, bool, bool]] = [("", -1, False, False, False, False)]
        opened: defaultdict[str, int] = defaultdict(int)
        pieces: list[str] = []
        linked = 0

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join(entities.unescape("".join(pieces)).split())
                if text:
                    self.blocks.append((around[1], text, *around[2:5], 2 * linked > len(text)))
            pieces.clear()
            linked = 0

        def leave(k: int) -> None:
            for x in stack[k:]:
                opened[x[0]] -= 1
            del stack[k:]

        around, at, size = stack[0], 0, len(source)
        while at < size:
            m = TOKEN.search(source, at)
            if not m:
                pieces.append(source[at:])
                break
            if m.start() > at:
                pieces.append(source[at : m.start()])
                if stack[-1][5]:
                    linked += m.start() - at
            at = m.end()
            close, tag, attributes, end = m.groups()
            if not tag:
                continue
            if not end:  # an open quote: the tag ends at the next >
                at = source.find(">", at) + 1 or size
            tag = tag.lower()
            if close:
                if not opened[tag]:
                    continue
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                if any(x[0] in BLOCKS for x in stack[k:]) or stack[k][2:4] != stack[k - 1][2:4]:
                    around = (*around[:2], *stack[-1][2:5], False)
                    flush()
                leave(k)
                around = stack[-1]
                continue
            if tag == "br":
                pieces.append(" ")
                continue
            _, node, other, named, main, link = stack[-1]
            block = tag in BLOCKS
            if block and tag in CLOSED_BY:
                tags, limit = CLOSED_BY[tag]
                if any(opened[t] for t in tags):
                    k = len(stack) - 1
                    while k > 0 and stack[k][0] not in tags and stack[k][0] not in limit:
                        k -= 1
                    if k > 0 and stack[k][0] in tags:
                        around = (*around[:2], *stack[-1][2:5], False)
                        flush()
                        leave(k)
                        around = stack[-1]
                        _, node, other, named, main, link = stack[-1]
            called, role, hidden = self._names(tag, attributes, main) if attributes else (False, "", False)
            never = other or hidden or tag in OTHER or role in ROLES or (tag == "header" and not main)
            called |= named
            if block or never != other or called != named:
                around = (*around[:2], *stack[-1][2:5], False)
                flush()
            if tag in RAW:
                found = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(source, at)
                at = (source.find(">", found.end()) + 1 or size) if found else size
                continue
            if tag in VOID or attributes.endswith("/") and tag in ("svg", "path"):
                continue
            if block:
                self.parents.append(node)
                self.tags.append(tag)
                node = len(self.tags) - 1
            stack.append((tag, node, never, called, main or tag in ("article", "main") or role == "main", link or tag == "a"))
            opened[tag] += 1
            around = stack[-1]
        around = stack[-1]
        flush()

    @staticmethod
    def _names(tag: str, attributes: str, main: bool) -> tuple[bool, str, bool]:
        """Whether class or id name something else than the article; the role; whether the element is hidden."""
        called, role, hidden = False, "", False
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name == "role":
                role = value.strip()
            elif name == "class" or (name == "id" and tag not in TEXTUAL):
                for token in value.split():
                    words = [w for w in re.split(r"[^a-z]+", token) if w]
                    if tag == "article":
                        called |= token in ("comment", "comments")
                    elif tag not in ("html", "body", "main"):
                        called |= any(w in NAMED for w in words) and all(w in NAMED or w in NEUTRAL for w in words) or (token == "header" and not main)
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "")
            elif name != "class" and name != "id":
                hidden |= name == "hidden" or value == "true"
        return called, role, hidden

    def layout(self, depth: int = 2) -> int:
        """A hash of the tags of the first levels (html and the children of body), equal neighbours as one."""
        level, seen = [], []
        for p, t in zip(self.parents, self.tags, strict=True):
            level.append(level[p] + 1 if p >= 0 else 1)
            if level[-1] <= depth + 1 and t not in ("head", "html", "body") and (not seen or seen[-1] != (level[-1], t)):
                seen.append((level[-1], t))
        return xxhash.xxh64_intdigest(repr(seen)) >> 1


class Forest:
    """Simple tree matching of trees whose equal subtrees are one shape, so that no pair of shapes is weighed twice."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.tag, self.kids, self.size = [], [], []
        self.memo: dict[tuple[int, int], int] = {}

    def add(self, parents: list[int], tags: list[str]) -> tuple[list[list[int]], list[int]]:
        """Children and shape of each node under a root of our own, 0, so that any two pages have one; node i becomes i + 1."""
        kids: list[list[int]] = [[] for _ in range(len(tags) + 1)]
        for i, p in enumerate(parents):
            kids[p + 1].append(i + 1)
        shapes = [0] * len(kids)
        for i in range(len(kids) - 1, -1, -1):  # children come after their parents
            key = (tags[i - 1] if i else "", *[shapes[k] for k in kids[i]])
            if key not in self.known:
                self.known[key] = len(self.tag)
                self.tag.append(key[0])
                self.kids.append(key[1:])
                self.size.append(1 + sum(self.size[k] for k in key[1:]))
            shapes[i] = self.known[key]
        return kids, shapes

    def _simple(self, x: int, y: int) -> int | None:
        """The weight of two shapes, if it shows at once."""
        if x == y:
            return self.size[x]
        if self.tag[x] != self.tag[y]:
            return 0
        return 1 if not self.kids[x] or not self.kids[y] else self.memo.get((x, y))

    def weight(self, x: int, y: int) -> int:
        """The most nodes that a matching of two shapes has."""
        if (w := self._simple(x, y)) is not None:
            return w
        stack = [(x, y)]
        while stack:
            i, j = stack[-1]
            if (i, j) in self.memo:
                stack.pop()
                continue
            a, b, same = self.trimmed(self.kids[i], self.kids[j])
            if open_ := [(p, q) for p in set(a) for q in set(b) if self._simple(p, q) is None]:
                stack += open_
                continue
            rest = 0
            for row in self._rows(a, b):
                rest = int(row[-1])
            self.memo[i, j] = 1 + sum(self.size[k] for k in same) + rest
            stack.pop()
        return self.memo[x, y]

    @staticmethod
    def trimmed(a, b) -> tuple:
        """Two lists of shapes without what they have in common at the start and at the end: some best matching joins it."""
        n, head, tail = min(len(a), len(b)), 0, 0
        while head < n and a[head] == b[head]:
            head += 1
        while tail < n - head and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
            tail += 1
        return a[head : len(a) - tail], b[head : len(b) - tail], (*a[:head], *a[len(a) - tail :])

    def _rows(self, a, b, row: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """Rows of the table of best weights of a's first shapes with b's first shapes."""
        if not len(a) or not len(b):
            return
        names, at = np.unique(np.array(b), return_inverse=True)
        row = np.zeros(len(b) + 1, np.int64) if row is None else row
        last = None
        for x in a:
            if x != last:
                last, w = x, np.array([self.weight(x, y) for y in names.tolist()], np.int64)[at]
            new = np.zeros_like(row)
            np.maximum.accumulate(np.maximum(np.where(w > 0, row[:-1] + w, 0), row[1:]), out=new[1:])
            yield new
            row = new

    def _matched(self, a, b) -> Iterator[tuple[int, int]]:
        """Places in a and b that a best matching joins. Every so many rows are kept and those between are made again, which
        takes memory in proportion to the root of a table's size."""
        if not len(a) or not len(b):
            return
        step = isqrt(len(a)) + 1
        kept = [np.zeros(len(b) + 1, np.int64)]
        for i, row in enumerate(self._rows(a, b), 1):
            if i % step == 0:
                kept.append(row)
        x, y = len(a), len(b)
        while x and y:
            base = (x - 1) // step
            block = [kept[base], *self._rows(a[base * step : x], b, kept[base])]
            while y and x > base * step:
                k = x - base * step
                if block[k][y] == block[k - 1][y]:
                    x -= 1
                elif block[k][y] == block[k][y - 1]:
                    y -= 1
                else:
                    x, y = x - 1, y - 1
                    yield x, y

    def align(self, a: tuple[list[list[int]], list[int]], b: tuple[list[list[int]], list[int]]) -> dict[int, int]:
        """Matched nodes of tree a and their partners in tree b, as add() gives both."""
        (ka, sa), (kb, sb) = a, b
        pairs: dict[int, int] = {}
        todo = [(0, 0)]
        while todo:
            i, j = todo.pop()
            pairs[i] = j
            x, y = ka[i], kb[j]
            if not x or not y:
                continue
            p, q = [sa[k] for k in x], [sb[k] for k in y]
            rest, other, same = self.trimmed(p, q)
            head = next((k for k in range(min(len(p), len(q))) if p[k] != q[k]), min(len(p), len(q)))
            todo += zip(x[:head], y[:head], strict=True)
            if tail := len(same) - head:
                todo += zip(x[-tail:], y[-tail:], strict=True)
            todo += [(x[head + u], y[head + v]) for u, v in self._matched(rest, other)]
        return pairs


#: What is known of a block, as bits: other, named, main, linked.
OTHER_, NAMED_, MAIN_, LINKED_ = 1, 2, 4, 8
TREE = "tree long, parents array<int>, tags array<string>, nodes array<int>, hashes array<long>"
INTS, LONGS, STRINGS = pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, layout, digest, the tree and the blocks of text of every row of pages.

    Blocks: nodes (where they stand), hashes (of all of their node's text), flags, sizes, texts. tree is a hash of parents and tags.
    """
    host, _ = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long"), "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "html"):
                sources = b.column("html").to_pylist()
                found = [Page(t) for t in sources]
                whole_tree = lambda p: xxhash.xxh64_intdigest(np.array(p.parents, np.int32).tobytes() + " ".join(p.tags).encode()) >> 1
                flags = lambda x: OTHER_ * x[2] + NAMED_ * x[3] + MAIN_ * x[4] + LINKED_ * x[5]
                arrays = [
                    *b.columns[:3], pa.array([p.layout() for p in found], pa.int64()), pa.array([xxhash.xxh64_intdigest(t) >> 1 for t in sources], pa.int64()),
                    pa.array([whole_tree(p) for p in found], pa.int64()), pa.array([p.parents for p in found], INTS), pa.array([p.tags for p in found], STRINGS),
                    pa.array([[x[0] for x in p.blocks] for p in found], INTS), pa.array([[p.hashes[x[0]] if x[0] >= 0 else 0 for x in p.blocks] for p in found], LONGS),
                    pa.array([[flags(x) for x in p.blocks] for p in found], INTS), pa.array([[len(x[1]) for x in p.blocks] for p in found], INTS),
                    pa.array([[x[1] for x in p.blocks] for p in found], STRINGS),
                ]
                names = ["page_id", "url", "host", "layout", "digest", "tree", "parents", "tags", "nodes", "hashes", "flags", "sizes", "texts"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return map_arrow(rows, run, f"page_id long, url string, host string, layout long, digest long, {TREE}, flags array<int>, sizes array<int>, texts array<string>")


REFERENCE = ["tree", "parents", "tags", "nodes", "hashes"]


def references(found: DataFrame) -> DataFrame:
    """host, layout and the tree of the reference page: that with the fewest nodes, so that no page meets a larger tree than its own."""
    rows = found.where("host <> '' and size(nodes) > 0").withColumn("n", F.size("tags"))
    pick = rows.groupBy("host", "layout").agg(F.min(F.struct("n", "digest")).alias("p")).select("host", "layout", "p.*")
    own = rows.join(pick, ["host", "layout", "n", "digest"], "left_semi")
    best = own.groupBy("host", "layout").agg(F.min(F.struct(*REFERENCE)).alias("p"))
    return best.select("host", "layout", *[F.col(f"p.{c}").alias(f"r_{c}") for c in REFERENCE])


class Aligner:
    """Partners of blocks in their references. Trees of one structure meet trees of another in one way, which is remembered."""

    def __init__(self, most: int = 2_000_000) -> None:
        self.most, self.size, self.pairs = most, 0, {}

    def _pairs(self, b: pa.RecordBatch, i: int, key: tuple[int, int]) -> list[int]:
        """The partner of each node of row i's tree, -1 if it has none."""
        if key not in self.pairs:
            parents, tags, r_parents, r_tags = (b.column(c)[i].as_py() for c in ("parents", "tags", "r_parents", "r_tags"))
            forest = Forest()
            found = forest.align(forest.add(parents, tags), forest.add(r_parents, r_tags))
            if self.size > self.most:
                self.pairs, self.size = {}, 0
            self.pairs[key] = [found.get(n + 1, 0) - 1 for n in range(len(tags))]
            self.size += len(tags)
        return self.pairs[key]

    def partners(self, b: pa.RecordBatch) -> list[tuple[list[int], list[bool]]]:
        """For each row the partner of each block's node (-1 if none), and whether both have the same text."""
        told: dict[tuple, dict[int, int]] = {}
        out = []
        columns = [b.column(c).to_pylist() for c in ("host", "layout", "tree", "r_tree", "nodes", "hashes")]
        for i, (host, layout, tree, r_tree, nodes, hashes) in enumerate(zip(*columns, strict=True)):
            if r_tree is None:
                out.append(([-1] * len(nodes), [False] * len(nodes)))
                continue
            if (host, layout) not in told:
                told[host, layout] = dict(zip(b.column("r_nodes")[i].as_py(), b.column("r_hashes")[i].as_py(), strict=True))
            pairs, texts = self._pairs(b, i, (tree, r_tree)), told[host, layout]
            to = [pairs[n] if n >= 0 else -1 for n in nodes]
            out.append((to, [k >= 0 and texts.get(k) == h for k, h in zip(to, hashes, strict=True)]))
        return out


def slots(found: DataFrame, trees: DataFrame) -> DataFrame:
    """host, layout, digest, slots (4 node + 2 same + linked) of each page's blocks that may be content, and its letters that vary: in
    all, without names, and in main without names."""
    rows = found.where("host <> '' and size(nodes) > 0").join(trees, ["host", "layout"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner()
        for whole in batches:
            for i in range(0, len(whole), 500):
                b = whole.slice(i, 500)
                out, sums = [], []
                for flags, sizes, (to, same) in zip(b.column("flags").to_pylist(), b.column("sizes").to_pylist(), aligner.partners(b), strict=True):
                    codes, free, plain, inside = [], 0, 0, 0
                    for f, n, k, s in zip(flags, sizes, to, same, strict=True):
                        if f & OTHER_:
                            continue
                        if k >= 0:
                            codes.append(4 * k + 2 * s + (f & LINKED_ > 0))
                        if not s and not f & LINKED_:
                            free += n
                            plain += 0 if f & NAMED_ else n
                            inside += n if f & MAIN_ and not f & NAMED_ else 0
                    out.append(codes)
                    sums.append((free, plain, inside))
                own = [b.column(c) for c in ("host", "layout", "digest")]
                counts = [pa.array([s[k] for s in sums], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(out, INTS), *counts], ["host", "layout", "digest", "slots", "free", "plain", "inside"])

    columns = ["host", "layout", "digest", "tree", "parents", "tags", "nodes", "hashes", "flags", "sizes", *[f"r_{c}" for c in REFERENCE]]
    schema = "host string, layout long, digest long, slots array<int>, free long, plain long, inside long"
    return map_arrow(rows.select(*columns), run, schema)


def wrappers(found: DataFrame, share: float, least: int, few: int) -> DataFrame:
    """host, layout, the reference's tree, its template and menu nodes, and whether names and main are to be believed."""
    trees = written(references(found), "references")
    pages = written(slots(found, trees).dropDuplicates(["host", "layout", "digest"]), "slots")
    code = pages.select("host", "layout", F.explode("slots").alias("c"))
    nodes = code.select("host", "layout", F.shiftright("c", 2).alias("node"), F.shiftright("c", 1).bitwiseAND(F.lit(1)).alias("same"), F.col("c").bitwiseAND(F.lit(1)).alias("linked"))
    counts = nodes.groupBy("host", "layout", "node").agg(F.count("*").alias("n"), F.sum("same").alias("k"), F.sum("linked").alias("l"))
    constant = ((F.col("n") >= least) & (F.col("k") >= share * F.col("n"))) | ((F.col("n") >= few) & (F.col("k") == F.col("n")))
    menu = (F.col("n") >= few) & (2 * F.col("l") > F.col("n"))
    listed = counts.groupBy("host", "layout").agg(
        F.collect_list(F.when(constant, F.col("node"))).alias("template"), F.collect_list(F.when(menu, F.col("node"))).alias("menus"),
        F.collect_list(F.when((F.col("n") >= few) & ~menu, F.col("node"))).alias("prose"))
    sums = pages.groupBy("host", "layout").agg(*[F.sum(c).alias(c) for c in ("free", "plain", "inside")])
    believed = sums.select("host", "layout", (50 * F.col("plain") >= F.col("free")).alias("names"), (10 * F.col("inside") >= F.col("plain")).alias("main"))
    out = written(trees.join(listed, ["host", "layout"], "left").join(believed, ["host", "layout"], "left"), "wrappers")
    discard(trees, pages)
    return out


def _content(flags: list[int], texts: list[str], partners: tuple[list[int], list[bool]], wrapper: tuple) -> str:
    """The page's text, given what its layout's pages say (template, menus, prose: reference nodes; names, main: believed or not)."""
    template, menus, prose, names, main = wrapper
    rest = [r for r in zip(flags, texts, *partners, strict=True) if not r[0] & OTHER_]
    plain = [r for r in rest if not r[0] & NAMED_]
    rest = plain if names or any(r[0] & MAIN_ for r in plain) else rest
    inside = [r for r in rest if r[0] & MAIN_]
    if inside and main:
        rest = inside
    else:
        rest = [r for r in rest if (r[2] not in menus if r[2] in menus or r[2] in prose else not r[0] & LINKED_)]
    return "\n".join([r[1] for r in rest if not (r[3] and r[2] in template)])


def extract(pages: DataFrame, share: float = 0.9, least: int = 8, few: int = 3, alignment: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    A reference node is template if its text is the same on at least `share` of the distinct pages of the layout that have it, of
    which there are `least` or more, or on all of `few` or more; copies of one page count once. Inside article or main as well:
    what stands on all pages is no page's own. Null and empty html, and pages without any content, give an empty text. Pages
    whose layout has fewer pages, or no host (null urls), are judged by markup alone, as all are without `alignment`. Very long
    and very deep pages are aligned as others are: in time proportional to the product of what differs between two lists of children, without
    recursion. Repeated rows and null ids stay; other columns aren't read; an empty table gives an empty result.
    """
    found = written(parsed(pages), "parsed")
    wrapper = wrappers(found if alignment else found.where("false"), share, least, few)
    rows = found.join(wrapper, ["host", "layout"], "left")
    lists = ("template", "menus", "prose")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner()
        for whole in batches:
            for i in range(0, len(whole), 500):
                b = whole.slice(i, 500)
                told: dict[tuple, tuple] = {}
                texts = []
                keys = zip(b.column("host").to_pylist(), b.column("layout").to_pylist(), strict=True)
                for row, (key, flags, own, partners) in enumerate(zip(keys, b.column("flags").to_pylist(), b.column("texts").to_pylist(), aligner.partners(b), strict=True)):
                    if key not in told:
                        believed = [b.column(c)[row].as_py() for c in ("names", "main")]
                        told[key] = (*[set(b.column(c)[row].as_py() or ()) for c in lists], *[x is None or x for x in believed])
                    texts.append(_content(flags, own, partners, told[key]))
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    columns = ["page_id", "url", "host", "layout", "tree", "parents", "tags", "nodes", "hashes", "flags", "texts", *[f"r_{c}" for c in REFERENCE], *lists, "names", "main"]
    text = map_arrow(rows.select(*columns), run, "page_id long, url string, text string")
    return text.withColumn("n_chars", F.length("text").cast("long"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


#: For pages as the given ones: one article of headings and paragraphs, whose texts have two kinds of references.
OP4_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(x, '</?(?:p|h1)>'), lambda t: trim(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda t: t <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c
"""
