"""Main text of web pages by wrapper induction.

Pages of one host are aligned as DOM trees by simple tree matching with a
reference page of middle size. A node of the reference whose text is the same on nearly all distinct pages is
template; nodes whose text varies, and nodes that the reference lacks, are slots
that may hold content. The wrapper's content region is the reference node under which most of the
varying text stands, links and constants not counted; where it lies in an <article> or <main>, that element is
the region as a whole. A page's article is the slots of its nodes that match the region. Names of elements, roles and classes
only tell menus, headers, footers, sidebars, notices, adverts, forms and reader comments among the slots. A host of
under LEAST distinct pages has no template: there, and on a page that does not match the region, the article is the
<article>, the <main> or the whole page.

Hosts are dealt to groups of about GROUP pages and GROUP_BYTES by a hash of the page, so a host with a
third of all pages is many groups, each of which induces its own wrapper from
bounded pages; no page is left out.

Trees of any depth and width are read and aligned without recursion: equal subtrees share a shape, pairs of shapes
are matched once, and long child lists are aligned row by row. Where children make more than CELLS pairs of different
shapes, one child is matched with all those of the other list at a time, which gives the same sizes and keeps none.

Character references are decoded, white space inside a block becomes one space, and
blocks join in page order by one space. Null and empty html give an empty text; broken or cut
markup is read as far as it goes, an unknown or null url is the host ''. Repeated rows are
extracted each. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantaloom.runtime import ship

#: Pages of a host, and their bytes, that induce one wrapper; hosts of more are split.
GROUP, GROUP_BYTES = 256, 8 << 20
#: Distinct pages that a template needs, and the share of them that must agree on a constant.
LEAST, SAME = 4, 0.9
#: More split hosts than this are joined by a shuffle and not by a broadcast.
BROADCAST_HOSTS = 50_000
#: Pairs of different shapes below two nodes whose matches are kept one by one; cells of an alignment that are kept at once.
CELLS, KEPT = 250_000, 4_000_000
#: Alignment tables up to so many cells are filled without NumPy.
SMALL = 400

# Fixed names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object select".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("body caption dd dt head html legend li summary tbody td tfoot th thead tr".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
WALLS = frozenset("ul ol dl table article section div body main aside nav footer header form".split())

# What is no article, by element, role or word of a class or id.
NO_ARTICLE = frozenset("aside button dialog footer form head input menu nav".split()) | RAW
NO_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
NO_WORD = frozenset(
    "ad ads adsense advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion related replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']|"[^"]*+"|'[^']*+')*+|[^<>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[a-zA-Z]+")


class Node:
    __slots__ = ("dropped", "key", "kids", "parent", "shape", "tag")

    def __init__(self, tag: str, key: str, dropped: bool) -> None:
        self.tag, self.key, self.dropped = tag, key, dropped
        self.kids: list[Node | str] = []
        self.parent: Node | None = None
        self.shape = 0

    def elements(self) -> list[Node]:
        return [k for k in self.kids if k.__class__ is Node]


def _node(tag: str, attributes: str) -> Node:
    if not attributes.strip(" /"):
        return Node(tag, tag, tag in NO_ARTICLE or tag == "header")
    found = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    names = f"{found.get('class', '')} {found.get('id', '')}"
    words = {w.lower() for w in _WORDS.findall(names)}
    gone = tag in NO_ARTICLE or tag == "header" or bool(words & NO_WORD and tag not in ("html", "body", "article", "main")) or found.get("role", "").lower() in NO_ROLE
    gone = gone or "hidden" in found or found.get("aria-hidden") == "true" or bool(_HIDDEN.search(found.get("style", "")))
    return Node(tag, f"{tag}.{'.'.join(sorted(words))}" if words else tag, gone)


def parse(page: str) -> list[Node]:
    """The DOM tree of a page, however broken: its elements in page order, the root first."""
    root = Node("#", "#", False)
    nodes, stack = [root], [root]
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in WALLS and tag not in WALLS:
                    break
            continue
        if tag in ENDS_P:
            _close(stack, {"p"})
        elif tag in SAME_LEVEL:
            _close(stack, SAME_LEVEL[tag])
        node = _node(tag, m[3])
        node.parent = stack[-1]
        stack[-1].kids.append(node)
        nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return nodes


def _close(stack: list[Node], tags: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in WALLS:
            return


def own_text(node: Node) -> str:
    return " ".join(html.unescape("".join(k for k in node.kids if k.__class__ is str)).split())


def _trimmed(left: tuple[int, ...], right: tuple[int, ...]) -> tuple[tuple[int, ...], ...]:
    """Equal shapes at both ends, which some largest match pairs up, and what is between: head, left, right, tail."""
    least, a = min(len(left), len(right)), 0
    while a < least and left[a] == right[a]:
        a += 1
    b = 0
    while b < least - a and left[-1 - b] == right[-1 - b]:
        b += 1
    return left[:a], left[a : len(left) - b], right[a : len(right) - b], left[len(left) - b :]


class Matcher:
    """Simple tree matching: the largest match of two trees that keeps parents and the order of children."""

    def __init__(self) -> None:
        self.shapes: dict[tuple, int] = {}
        self.keys: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def shape(self, nodes: list[Node]) -> None:
        """Numbers the subtrees of a page; equal ones share a number."""
        for node in reversed(nodes):
            kids = tuple(k.shape for k in node.elements())
            number = self.shapes.setdefault((node.key, kids), len(self.keys))
            if number == len(self.keys):
                self.keys.append(node.key)
                self.kids.append(kids)
                self.sizes.append(1 + sum(self.sizes[k] for k in kids))
            node.shape = number

    def _pairs(self, a: int, b: int) -> list[tuple[int, int]] | None:
        """The pairs of different shapes of equal keys below a and b; None if they are too many."""
        left, right = set(self.kids[a]), set(self.kids[b])
        if len(left) * len(right) > CELLS:
            return None
        return [(x, y) for x in left for y in right if x != y and self.keys[x] == self.keys[y]]

    def size(self, a: int, b: int) -> int:
        """Matched elements of two subtrees whose roots have one key."""
        open_ = [(a, b)]
        while open_:
            x, y = open_[-1]
            if (x, y) in self.known:
                open_.pop()
            elif x == y:
                self.known[x, y] = self.sizes[x]
            else:
                missing = [p for p in self._pairs(x, y) or [] if p not in self.known]
                if missing:
                    open_ += missing
                else:
                    head, left, right, tail = _trimmed(self.kids[x], self.kids[y])
                    last = None
                    for last in self._rows(left, right):
                        pass
                    same = sum(self.sizes[k] for k in (*head, *tail))
                    self.known[x, y] = 1 + same + (int(last[-1]) if last is not None else 0)
        return self.known[a, b]

    def _kept(self, x: int, y: int) -> int | None:
        """The size of a match as far as it is known; 0 for two keys."""
        return 0 if self.keys[x] != self.keys[y] else self.sizes[x] if x == y else self.known.get((x, y))

    def _weights(self, left: tuple[int, ...], right: tuple[int, ...]) -> Callable[[int], np.ndarray | list[int]]:
        """What gives for a shape on the left the weight of its pair with every element on the right."""
        some, few = sorted(set(left)), sorted(set(right))
        small = len(left) * len(right) <= SMALL
        place = None if small else np.searchsorted(few, right)
        out = {}
        for x in some if len(some) * len(few) <= CELLS else ():
            own = [self._kept(x, y) for y in few]
            if None in own:
                break
            if small:
                of = dict(zip(few, own, strict=True))
                out[x] = [of[y] for y in right]
            else:
                out[x] = np.array(own, np.int32)[place]
        else:
            if out:
                return out.__getitem__
        row = self._matches(some, few)
        place = np.searchsorted(few, right)
        return lru_cache(max(1, KEPT // len(right)))(lambda x: row(x)[place].tolist() if small else row(x)[place])

    def _matches(self, left: list[int], right: list[int]) -> Callable[[int], np.ndarray]:
        """What gives for a shape on the left the sizes of its matches with all shapes on the right."""
        levels = [(left, right)]
        while len(levels[-1][0]) * len(levels[-1][1]) > CELLS or len(levels) == 1:
            levels.append(tuple(sorted({k for x in own for k in self.kids[x]}) for own in levels[-1]))
        # from the lowest level, whose pairs are few, upward
        left, right = levels.pop()
        table = np.array([[0 if self.keys[x] != self.keys[y] else self.size(x, y) for y in right] for x in left], np.int32).reshape(len(left), len(right))
        while True:
            row = self._level(table, left, *levels[-1], right)
            if len(levels) == 1:
                return row
            left, right = levels.pop()
            table = np.array([row(x) for x in left], np.int32).reshape(len(left), len(right))

    def _level(self, table: np.ndarray, inner: list[int], left: list[int], right: list[int], other: list[int]) -> Callable[[int], np.ndarray]:
        """The same from a table of the matches of all their children (inner of those on the left, other of those on the right)."""
        at = {x: i for i, x in enumerate(inner)}
        table = np.pad(table, ((0, 0), (0, 1)))
        parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        alike = defaultdict(list)
        for j, y in enumerate(right):
            alike[self.keys[y], len(self.kids[y]).bit_length()].append(j)
        for (key, _), own in alike.items():
            width = max(len(self.kids[right[j]]) for j in own)
            step = max(1, (1 << 18) // max(1, width))
            for k in range(0, len(own), step):
                some = own[k : k + step]
                kids = np.full((len(some), width), len(other), np.int64)
                for n, j in enumerate(some):
                    kids[n, : len(self.kids[right[j]])] = np.searchsorted(other, self.kids[right[j]])
                parts[key].append((np.array(some), kids))

        def row(x: int) -> np.ndarray:
            out = np.zeros(len(right), np.int32)
            for places, kids in parts.get(self.keys[x], ()):
                line = np.zeros((kids.shape[0], kids.shape[1] + 1), np.int32)
                for k in self.kids[x] if kids.shape[1] else ():
                    own = table[at[k]][kids]
                    after = line.copy()
                    np.maximum(after[:, 1:], np.where(own > 0, line[:, :-1] + own, 0), out=after[:, 1:])
                    line = np.maximum.accumulate(after, axis=1)
                out[places] = 1 + line[:, -1]
            return out

        return row

    def _rows(self, left: tuple[int, ...], right: tuple[int, ...]) -> Iterator[np.ndarray | list[int]]:
        """The rows of the alignment table after each element on the left, one number longer than right."""
        if not left or not right:
            return
        weights = self._weights(left, right)
        if len(left) * len(right) <= SMALL:
            line = [0] * (len(right) + 1)
            for x in left:
                after = [0]
                for j, own in enumerate(weights(x)):
                    after.append(max(after[j], line[j + 1], line[j] + own if own else 0))
                line = after
                yield line
            return
        row = np.zeros(len(right) + 1, np.int32)
        for x in left:
            after = row.copy()
            own = weights(x)
            np.maximum(after[1:], np.where(own > 0, row[:-1] + own, 0), out=after[1:])
            row = np.maximum.accumulate(after)
            yield row

    def _matched(self, left: tuple[int, ...], right: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places of matched children, in order. Long lists are halved, so that no whole table is kept."""
        head, inner, other, tail = _trimmed(left, right)
        out = [(i, i) for i in range(len(head))]
        out += [(len(head) + i, len(head) + j) for i, j in self._inner(inner, other)]
        return out + [(len(left) - i, len(right) - i) for i in range(len(tail), 0, -1)]

    def _inner(self, left: tuple[int, ...], right: tuple[int, ...]) -> list[tuple[int, int]]:
        if not left or not right:
            return []
        if len(left) > 1 and len(left) * len(right) > KEPT:
            half = len(left) // 2
            before = after = None
            for before in self._rows(left[:half], right):
                pass
            for after in self._rows(left[half:][::-1], right[::-1]):
                pass
            cut = int(np.argmax(np.asarray(before) + np.asarray(after)[::-1]))
            return self._matched(left[:half], right[:cut]) + [(half + i, cut + j) for i, j in self._matched(left[half:], right[cut:])]
        table = [[0] * (len(right) + 1), *self._rows(left, right)]
        i, j, out = len(left), len(right), []
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out[::-1]

    def align(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """The pairs of the largest match of two shaped trees of equal roots."""
        out, open_ = [], [(a, b)]
        while open_:
            a, b = open_.pop()
            out.append((a, b))
            left, right = a.elements(), b.elements()
            if not left or not right:
                continue
            if a.shape != b.shape:
                for x, y in self._pairs(a.shape, b.shape) or []:
                    self.size(x, y)
            open_ += [(left[i], right[j]) for i, j in self._matched(self.kids[a.shape], self.kids[b.shape])]
        return out


class Wrapper:
    """The template of a group of same-host pages."""

    def __init__(self, pages: list[list[Node]]) -> None:
        self.reference = None
        self.constant: dict[int, str] = {}
        self.main: int | None = None
        self.known: dict[int, dict[Node, int]] = {}
        if len(pages) < LEAST:
            return
        self.matcher = Matcher()
        for page in pages:
            self.matcher.shape(page)
        order = sorted(range(len(pages)), key=lambda i: (len(pages[i]), i))
        self.reference = pages[order[len(order) // 2]]
        values: dict[int, Counter] = defaultdict(Counter)
        weight: Counter = Counter()
        for page in pages:
            matched = self.known[id(page)] = self.matched(page)
            for b, a in matched.items():
                values[a][own_text(b)] += 1
            self._weigh(page, matched, weight)
        for a, seen in values.items():
            text, n = seen.most_common(1)[0]
            if n >= SAME * len(pages):
                self.constant[a] = text
        self._choose(weight)

    def matched(self, page: list[Node]) -> dict[Node, int]:
        return {b: id(a) for a, b in self.matcher.align(self.reference[0], page[0])}

    def _weigh(self, page: list[Node], matched: dict[Node, int], weight: Counter) -> None:
        """Adds the letters outside links and boilerplate to the nearest node of the reference."""
        nearest: dict[Node, int | None] = {}
        for node in page:
            above = nearest.get(node.parent)
            if node.parent is not None and (above is None or node.dropped or node.tag == "a"):
                nearest[node] = None
                continue
            nearest[node] = matched.get(node, above)
            for kid in node.kids:
                if kid.__class__ is str:
                    weight[nearest[node]] += len(kid.strip())

    def _choose(self, weight: Counter) -> None:
        """The deepest node that holds most of the varying text below it, or the <article> or <main> around it."""
        below: Counter = Counter()
        for node in reversed(self.reference):
            below[node] += 0 if self.constant.get(id(node)) else weight[id(node)]
            if node.parent is not None and not node.dropped:
                below[node.parent] += below[node]
        node = self.reference[0]
        whole = below[node]
        while whole:
            inner = [k for k in node.elements() if not k.dropped and k.tag in BLOCK and k.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li") and below[k] >= 0.8 * whole]
            if not inner:
                break
            node = inner[0]
        around, region = node, node
        while around is not None:
            if around.tag in ("article", "main"):
                region = around
                if around.tag == "article":
                    break
            around = around.parent
        self.main = id(region)

    def text(self, page: list[Node]) -> str:
        matched = {}
        if self.reference is not None:
            if id(page) not in self.known:
                self.matcher.shape(page)
            matched = self.known.get(id(page)) or self.matched(page)
        roots = [b for b, a in matched.items() if a == self.main] if self.main is not None and self.main != id(self.reference[0]) else []
        roots = roots or _outermost(page, "article") or _outermost(page, "main") or page[:1]
        blocks: list[str] = []
        for root in roots:
            self._blocks(root, matched, root.tag in ("article", "main"), blocks)
        return " ".join(blocks)

    def _blocks(self, root: Node, matched: dict[Node, int], inside: bool, blocks: list[str]) -> None:
        held: list[str] = []

        def end() -> None:
            if held:
                if text := " ".join(html.unescape("".join(held)).split()):
                    blocks.append(text)
                held.clear()

        def opened(node: Node) -> tuple[Node, Iterator[Node | str], bool]:
            place = matched.get(node)
            return node, iter(node.kids), place is not None and bool(self.constant.get(place)) and self.constant[place] == own_text(node)

        stack = [opened(root)]
        while stack:
            node, kids, template = stack[-1]
            kid = next(kids, None)
            if kid is None:
                stack.pop()
                if stack and node.tag in BLOCK:
                    end()
            elif kid.__class__ is str:
                if not template:
                    held.append(kid)
            elif kid.dropped and not (inside and kid.tag == "header" and kid.key == "header"):
                if kid.tag in BLOCK:
                    end()
            elif kid.tag == "br":
                held.append(" ")
            else:
                if kid.tag in BLOCK:
                    end()
                stack.append(opened(kid))
        end()


def _outermost(page: list[Node], tag: str) -> list[Node]:
    found, closed = [], set()
    for node in page:
        if node.parent in closed or node.dropped:
            closed.add(node)
        elif node.tag == tag:
            found.append(node)
            closed.add(node)
    return found


def extract_group(pages: list[str]) -> list[str]:
    """The main texts of some pages of one host."""
    trees = [parse(page) for page in pages]
    distinct = {}
    for page, tree in zip(pages, trees, strict=True):
        distinct.setdefault(page, tree)
    wrapper = Wrapper([tree for page, tree in distinct.items() if page])
    return [wrapper.text(tree) for tree in trees]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    ship(pages.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.record_batch([part.column(0), part.column(1), part.column(2), pa.array([squeeze(x.as_buffer()) for x in part.column(3)], pa.binary())], ["page_id", "url", "host", "html"])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    large = rows.groupBy("host").agg(F.greatest(F.count(F.lit(1)) / GROUP, F.sum(F.octet_length("html")) / GROUP_BYTES).alias("n")).where(F.col("n") > 1).select("host", F.ceil("n").alias("groups"))
    few = large.limit(BROADCAST_HOSTS + 1).collect()
    if len(few) <= BROADCAST_HOSTS:
        large = F.broadcast(pages.sparkSession.createDataFrame(few, "host string, groups long"))
    packed = rows.mapInArrow(pack, "page_id long, url string, host string, html binary").join(large, "host", "left")
    salt = F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("groups")), F.lit(0).cast("long"))
    dealt = packed.select("host", salt.alias("salt"), "page_id", "url", "html").repartition("host", "salt").sortWithinPartitions("host", "salt", "page_id", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, urls, texts = None, [], [], []

        def done() -> pa.RecordBatch:
            found = extract_group(texts)
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

        for batch in batches:
            for own_host, own_salt, page_id, url, raw in zip(*(batch.column(i) for i in range(5)), strict=True):
                if (own_host.as_py(), own_salt.as_py()) != key:
                    if texts:
                        yield done()
                    key, ids, urls, texts = (own_host.as_py(), own_salt.as_py()), [], [], []
                ids.append(page_id.as_py())
                urls.append(url.as_py())
                texts.append(zstandard.decompress(raw.as_py()).decode())
        if texts:
            yield done()

    return dealt.mapInArrow(run, "page_id long, url string, text string, n_chars long")
