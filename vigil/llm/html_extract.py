"""Main text of web pages by wrapper induction over same-host pages.

For each host one page of median length is the reference. Every page's DOM tree is aligned with it by simple tree
matching (the largest order-preserving mapping of nodes with equal tags, level by level; sizes are kept by shapes of subtrees, so
long lists of like siblings cost a vector operation each and two bits a pair). Leaves of the
reference whose text is equal in nearly all aligned pages are the host's template; where texts vary, the leaf is a
slot. The votes are summed over all pages of the host (pre-summed in the tasks, so a hot host costs a row per leaf
and task), and the content root of a host without article markup is the deepest node that holds nearly all varying text.
A page votes on the leaves below elements it shares with the reference, so a second layout does not outvote the first.
Extraction aligns every page with its host's wrapper again and returns the blocks of the content region that are neither
template nor inside boilerplate elements (menus, headers, footers, sidebars, notices, adverts, forms, reader comments).
Menus and adverts vary from page to page too, so slots are kept only outside such elements. An element that is named like
boilerplate, or is a form, but holds the page itself (see ``wrapping``) is no boilerplate.

References are one bounded page a host. They are broadcast only while their measured total is under BROADCAST_BYTES;
beyond that the same join is a shuffle on the host, whose hot keys the adaptive join splits.

Defined cases: a null html or url gives no wrapper votes, null html gives the empty text; a host with too few differing pages
is read by its markup alone; broken markup is read as browsers do (implied ends, unmatched ends ignored); elements may be
nested to any depth; copies of a page vote only once with the reference they differ from;
repeated rows are all returned; empty tables work; extra columns pass unchanged.
"""

from __future__ import annotations

import html as entities
import re
import sys
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import cut_lineage

BROADCAST_BYTES = 32 << 20
MIN_VOTES = 5            # differing pages needed before a leaf can be template
CONSTANT = 0.9           # share of them in which it is equal
ROOT_SHARE = 0.8         # share of the varying text that the content root holds
NEAR_COPY = 0.5          # a page that shares this much of its text with the reference does not vote
FLUSH = 50_000
MEMO = 10_000            # pairs of shapes whose sizes a host's wrapper keeps from page to page

TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"""|</?[a-zA-Z][^>]*>|(?P<text>[^<]++|<)""", re.S)
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
# HTML white space; a no-break space is text that reads as a blank, and counts as one
SPACE = re.compile(r"\s+")

RAW = {"script", "style", "title", "noscript", "template", "iframe", "textarea", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
          "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
          "math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "msub", "msup", "msubsup", "munder",
          "mover", "munderover", "mmultiscripts", "mpadded", "mphantom", "menclose", "mtable", "mtr", "mtd", "semantics", "annotation"}
# an opening tag ends these open elements, up to the nearest element of the stop set
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}
BOILER_TAGS = {"nav", "footer", "aside", "form", "button", "select", "fieldset", "dialog", "menu", "head"}
BOILER_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "footer", "cookie", "cookies", "consent", "notice",
    "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "comment", "comments",
    "reply", "replies", "respond", "disqus", "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "pagination",
    "pager", "copyright", "disclaimer", "gdpr", "search", "complementary", "contentinfo"}
# one-word names of the same things (commentlist, sitefooter, topnav, advertbox)
BOILER_NAME = re.compile(
    r"comments?(?:list|form|box|area|section|wrap|wrapper)|advert\w+|sponsor\w+|sidebar\w+|cookie\w+|newsletter\w+|breadcrumb\w+"
    r"|\w+(?:navbar|menu|footer|sidebar)|(?:top|side|main|site|sub|foot)nav")
# words that say where a thing stands, not what it is: a name of these and the words above names boilerplate, while
# "related-work" or "notice-of-meeting" names content
PLACE_WORDS = {"box", "wrap", "wrapper", "container", "block", "blocks", "list", "items", "item", "section", "area", "bar", "panel", "inner",
               "outer", "top", "bottom", "left", "right", "side", "main", "site", "page", "post", "article", "global", "link", "links", "js",
               "module", "unit", "slot", "row", "col", "column", "content", "text", "title", "form", "button", "buttons", "user", "reader", "header",
               "toggle", "primary", "secondary", "message", "messages", "thread", "feed", "posts", "articles", "holder", "region", "up", "sub"}
# these are never the page itself; reader comments are only where they hold the main element
STRONG_TAGS = BOILER_TAGS - {"form", "fieldset"}
DISCUSSION = {"comment", "comments", "reply", "replies", "respond", "disqus"}
HEADER_WORDS = {"header", "masthead", "topbar"}
REGION = {"article", "main"}


class Node:
    """``words`` are all words of its class, id and role, ``telling`` those of names that hold only BOILER_WORDS and PLACE_WORDS;
    ``shape`` and ``content`` are hashes of the tree below, without and with texts, ``size`` its nodes (see ``seal``)."""

    __slots__ = ("tag", "words", "telling", "children", "text", "shape", "content", "size")

    def __init__(self, tag: str, names: list[str] = (), text: str | None = None):
        self.tag, self.children, self.text = tag, [], text
        self.words = self.telling = frozenset()
        if not names:
            return
        split = [{w.lower() for w in WORD.findall(n)} for n in names]
        self.words = frozenset().union(*split)
        self.telling = frozenset().union(*[ws for ws in split if all(w in BOILER_WORDS or w in PLACE_WORDS or BOILER_NAME.fullmatch(w) for w in ws)])


def parse(html: str) -> Node:
    """Tree of block elements with runs of text as leaves; inline elements are part of the text."""
    root = Node("#root")
    stack, run = [root], []
    opened: Counter = Counter()
    depth = 1

    def end_run() -> None:
        if run:
            text = SPACE.sub(" ", entities.unescape("".join(run))).strip()
            run.clear()
            if text:
                stack[-1].children.append(Node("#text", text=text))

    at, size = 0, len(html)
    while at < size:
        m = TOKEN.match(html, at)
        if m is None:
            run.append(html[at])
            at += 1
            continue
        at = m.end()
        if (text := m["text"]) is not None:
            run.append(text)
            continue
        if m["tag"] is None:
            if m[0].startswith("<![CDATA["):
                run.append(m[0][9:-3].replace("&", "&amp;"))
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag in INLINE or tag in VOID:
                if tag == "br":
                    run.append(" ")
                continue
            if opened[tag]:
                end_run()
                while (last := stack.pop().tag) != tag:
                    opened[last] -= 1
                opened[tag] -= 1
            continue
        if tag == "xmp":  # shown as it stands
            end_run()
            close = re.compile(r"</xmp(?=[\s/>])", re.I).search(html, at)
            run.append(html[at:close.start() if close else size].replace("&", "&amp;"))
            at = html.find(">", close.end()) + 1 or size if close else size
            end_run()
            continue
        if tag in RAW:
            if not m["attrs"].rstrip().endswith("/"):
                close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, at)
                at = html.find(">", close.end()) + 1 or size if close else size
            continue
        if tag in INLINE:
            continue
        if tag in VOID:
            run.append(" ")
            if tag == "hr":
                end_run()
            continue
        end_run()
        if stack[-1].tag == "p":
            stack.pop()
            opened["p"] -= 1
        elif tag in CLOSES:
            ends, stop = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stop:
                    break
                if stack[i].tag in ends:
                    opened.subtract(n.tag for n in stack[i:])
                    del stack[i:]
                    break
        node = Node(tag, [n for a in ATTR.finditer(m["attrs"]) for n in (a[2] or a[3] or a[4] or "").split()])
        stack[-1].children.append(node)
        stack.append(node)
        opened[tag] += 1
        depth = max(depth, len(stack))
    end_run()
    if 5 * depth + 1000 > sys.getrecursionlimit():  # matched_size goes down by levels; such calls take no C stack
        sys.setrecursionlimit(5 * depth + 1000)
    return seal(root)


def seal(root: Node) -> Node:
    """Hashes and sizes of all nodes, children before parents."""
    nodes = [root]
    for node in nodes:
        nodes += node.children
    for node in reversed(nodes):
        below = node.children
        node.size = 1 + sum(c.size for c in below)
        node.shape = hash((node.tag, *[c.shape for c in below]))
        node.content = hash((node.tag, node.text, *[c.content for c in below]))
    return root


def is_boiler(node: Node, inside: bool) -> bool:
    if node.tag in REGION:
        return bool(node.words & {"comment", "comments", "ad", "ads", "advert", "sponsored", "related", "widget"})
    named = node.telling - {"search"} if inside else node.words
    if node.tag in BOILER_TAGS or named & BOILER_WORDS or any(map(BOILER_NAME.fullmatch, named)):
        return node.tag not in ("body", "html")
    return not inside and (node.tag == "header" or (bool(node.words & HEADER_WORDS) and node.tag not in ("body", "html")))


def sibling_weights(p: list[Node], q: list[Node], memo: dict) -> Iterator[np.ndarray]:
    """For each of ``p`` its weights against all of ``q``: twice the size of the mapping, and one more for equal content."""
    kinds: dict[int, tuple[int, Node]] = {}
    codes = np.array([kinds.setdefault(y.shape, (len(kinds), y))[0] for y in q])
    equal: dict[int, list[int]] = defaultdict(list)
    for j, y in enumerate(q):
        equal[y.content].append(j)
    sizes: dict[int, np.ndarray] = {}
    for x in p:
        if x.shape not in sizes:
            sizes[x.shape] = np.array([2 * matched_size(x, y, memo) for _, y in kinds.values()], np.int32)
        weights = sizes[x.shape][codes]
        if x.content in equal:
            weights[equal[x.content]] += 1
        yield weights


def matched_size(a: Node, b: Node, memo: dict) -> int:
    """Nodes of the largest order-preserving mapping of two trees that pairs equal tags alone; it depends on their shapes only."""
    if a.tag != b.tag:
        return 0
    if a.shape == b.shape:
        return a.size
    key = a.shape, b.shape
    if key not in memo:
        best = np.zeros(len(b.children) + 1, np.int32)
        if len(best) > 1:
            for w in sibling_weights(a.children, b.children, memo):
                best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + (w >> 1)))
        memo[key] = 1 + int(best[-1])
    return memo[key]


def equal_ends(p: list[Node], q: list[Node], of: Callable[[Node], int]) -> tuple[int, int]:
    """How many siblings are equal from the start on, and of the rest from the end."""
    shorter = min(len(p), len(q))
    head = 0
    while head < shorter and of(p[head]) == of(q[head]):
        head += 1
    tail = 0
    while tail < shorter - head and of(p[-1 - tail]) == of(q[-1 - tail]):
        tail += 1
    return head, tail


def sibling_pairs(p: list[Node], q: list[Node], memo: dict) -> list[tuple[Node, Node]]:
    """The best order-preserving pairing of two lists of siblings. Equal ones at both ends belong to a best pairing (equal in
    shape, where no content occurs on both sides), so only what lies between is aligned, row by row; two bits a cell are
    kept for the way back."""
    pairs = []
    for of in (attrgetter("content"), attrgetter("shape")):
        head, tail = equal_ends(p, q, of)
        pairs += [*zip(p[:head], q[:head]), *zip(p[len(p) - tail:], q[len(q) - tail:])]
        p, q = p[head:len(p) - tail], q[head:len(q) - tail]
        if not p or not q:
            return pairs
        if not {x.content for x in p}.isdisjoint([y.content for y in q]):
            break
    paired, passed = [], []
    best = np.zeros(len(q) + 1, np.int32)
    for w in sibling_weights(p, q, memo):
        both = best[:-1] + w
        row = np.maximum.accumulate(np.maximum(best[1:], both))
        paired.append(np.packbits((row == both) & (w > 0)))
        passed.append(np.packbits(row == best[1:]))
        best[1:] = row
    i, j = len(p), len(q)
    while i and j:
        at, bit = (j - 1) >> 3, 0x80 >> ((j - 1) & 7)
        if paired[i - 1][at] & bit:
            i, j = i - 1, j - 1
            pairs.append((p[i], q[j]))
        elif passed[i - 1][at] & bit:
            i -= 1
        else:
            j -= 1
    return pairs


def match_trees(a: Node, b: Node, memo: dict | None = None) -> list[tuple[Node, Node]]:
    """Simple tree matching of two pages: the pairs of a largest order-preserving mapping, level by level; among equal ones
    pairs of equal content are preferred. ``memo`` keeps the sizes of pairs of shapes for the next page."""
    memo = {} if memo is None else memo
    if len(memo) > MEMO:
        memo.clear()
    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        found = sibling_pairs(x.children, y.children, memo)
        pairs += found
        todo += [(c, d) for c, d in found if c.children and d.children]
    return pairs


def wrapping(root: Node) -> set[int]:
    """Elements that are no boilerplate whatever their name, as they hold the page itself: a main element, or an article
    and half of the text that is in no boilerplate without articles, or ROOT_SHARE of all text. Reader comments
    are spared only for a main element; text below STRONG_TAGS does not count."""
    nodes, above, named = [root], [-1], [False]
    todo = [(c, 0, False) for c in reversed(root.children)]
    while todo:
        node, up, inside = todo.pop()
        if node.tag in STRONG_TAGS:
            continue
        boiler = node.text is None and is_boiler(node, inside)
        inside = inside or (node.tag in REGION and not boiler)
        k = len(nodes)
        nodes.append(node)
        above.append(up)
        named.append(boiler)
        todo += [(c, k, inside) for c in reversed(node.children)]
    if not any(named):
        return set()
    n = len(nodes)
    size, net, article, main = [0] * n, [0] * n, [False] * n, [False] * n
    for k in range(n - 1, -1, -1):
        node, up = nodes[k], above[k]
        if node.text is not None:
            size[k] = net[k] = len(node.text)
        elif node.tag in REGION and not named[k] and size[k]:
            article[k], main[k] = True, node.tag == "main"
        if named[k] and not article[k]:
            net[k] = 0
        if k:
            size[up] += size[k]
            net[up] += net[k]
            article[up] |= article[k]
            main[up] |= main[k]
    return {id(nodes[k]) for k in range(1, n) if named[k] and nodes[k].tag not in REGION and (
        main[k] or not nodes[k].words & DISCUSSION
        and (article[k] and 2 * net[k] >= net[0] or 0 < size[0] and size[k] >= ROOT_SHARE * size[0]))}


def walk(top: Node, depth_first: list, parents: dict, spared: set[int] | frozenset = frozenset()) -> list:
    """(node, inside a region, boilerplate) of all nodes in page order; ``spared`` nodes are no boilerplate."""
    todo = [(c, top, False, False) for c in reversed(top.children)]
    while todo:
        node, up, inside, boiler = todo.pop()
        b = boiler or (node.text is None and id(node) not in spared and is_boiler(node, inside))
        i = inside or (node.tag in REGION and not b)
        parents[id(node)] = up
        depth_first.append((node, i, b))
        todo += [(c, node, i, b) for c in reversed(node.children)]
    return depth_first


class Reference:
    """A host's reference page: its nodes in page order, and the wrapper once votes are in."""

    def __init__(self, html: str):
        self.root = parse(html)
        self.parents: dict[int, Node] = {}
        self.nodes = walk(self.root, [], self.parents, wrapping(self.root))
        self.index = {id(n): k for k, (n, _, _) in enumerate(self.nodes)}
        self.sizes: dict[tuple[int, int], int] = {}
        self.template: set[int] = set()
        self.content_root: int | None = None

    def vote(self, html: str) -> dict[int, tuple[int, int, int]]:
        """Leaf -> (1, equal text, characters that vary there), from a page that is not a copy of the reference."""
        page = parse(html)
        pairs = match_trees(page, self.root, self.sizes)
        parents: dict[int, Node] = {}
        nodes = walk(page, [], parents, wrapping(page))
        kinds = {id(n): b for n, _, b in nodes}
        same = sum(len(x.text) for x, y in pairs if x.text and x.text == y.text and not kinds[id(x)])
        whole = sum(len(n.text) for n, _, b in nodes if n.text and not b)
        if same > NEAR_COPY * whole:
            return {}
        # a page has a say on the leaves below the elements it shares, so a host's other layouts don't count against this one
        shared = {id(y) for _, y in pairs} | {id(self.root)}
        out = {k: [1, 0, 0] for k, (n, _, _) in enumerate(self.nodes) if n.text is not None and id(self.parents[id(n)]) in shared}
        to = {id(x): y for x, y in pairs}
        for x, y in pairs:
            if x.text is not None:
                k = self.index[id(y)]
                out[k][1] += x.text == y.text
                out[k][2] += 0 if x.text == y.text or kinds[id(x)] else len(x.text)
        # text without a partner varies under the partner of its nearest matched ancestor
        near: dict[int, Node | None] = {id(page): None}
        for n, _, b in nodes:
            up = near[id(parents[id(n)])]
            near[id(n)] = n if id(n) in to else up
            if n.text is not None and not b and id(n) not in to and up is not None:
                out.setdefault(self.index[id(to[id(up)])], [0, 0, 0])[2] += len(n.text)
        return {k: tuple(v) for k, v in out.items()}

    def induce(self, votes: list[tuple[int, int, int, int]]) -> None:
        """``votes``: (node, pages, equal, varying characters). Constant leaves become template; the content root is the
        deepest node outside boilerplate that holds nearly all varying text."""
        varying: dict[int, int] = defaultdict(int)
        for k, pages, equal, chars in votes:
            if pages >= MIN_VOTES and equal >= CONSTANT * pages:
                self.template.add(k)
            if chars and not self.nodes[k][2]:
                varying[k] += chars
        for k in range(len(self.nodes) - 1, -1, -1):
            up = self.parents[id(self.nodes[k][0])]
            if k in varying and up is not self.root:
                varying[self.index[id(up)]] += varying[k]
        # paragraphs and headings hold only text; a root is an element that holds such blocks
        holds = {k: v for k, v in sorted(varying.items()) if self.nodes[k][0].text is None and any(c.text is None for c in self.nodes[k][0].children)}
        if top := max(holds.values(), default=0):
            self.content_root = max(k for k, v in holds.items() if v >= ROOT_SHARE * top)

    def extract(self, html: str) -> str:
        page = parse(html)
        parents: dict[int, Node] = {}
        spared = wrapping(page)
        nodes = walk(page, [], parents, spared)
        region = any(i and not b for _, i, b in nodes)
        asked = self.template or (not region and self.content_root is not None)  # the host's wrapper has a say on this page
        pairs = match_trees(page, self.root, self.sizes) if asked else []
        dropped = {id(x) for x, y in pairs if x.text is not None and x.text == y.text and self.index[id(y)] in self.template}
        keep = None
        if not region and self.content_root is not None:
            root = next((x for x, y in pairs if y is self.nodes[self.content_root][0]), None)
            if root is not None:
                up = root
                while up is not page:  # the host's content root is no boilerplate either, nor is what holds it
                    spared.add(id(up))
                    up = parents[id(up)]
                nodes = walk(page, [], {}, spared)
                keep = {id(n) for n, _, _ in walk(root, [], {})}
        return "\n\n".join(
            n.text for n, i, b in nodes
            if n.text is not None and not b and id(n) not in dropped and (i if region else keep is None or id(n) in keep))


# ---------------------------------------------------------------- Spark

def with_host(pages: DataFrame) -> DataFrame:
    """``__host`` of the url, lower-cased, without user and port."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.withColumn("__host", F.when(host != "", host))


def joined_by_host(pages: DataFrame, small: DataFrame, n_bytes: int, how: str) -> DataFrame:
    return pages.join(F.broadcast(small) if n_bytes <= BROADCAST_BYTES else small, "__host", how)


def references(pages: DataFrame) -> tuple[DataFrame, int]:
    """(__host, __ref) with the html of each host's reference page, and their total bytes."""
    narrow = pages.where("__host is not null and html is not null").select("__host", F.length("html").alias("len"), "page_id")
    middle = narrow.groupBy("__host").agg(F.percentile_approx("len", 0.5, 1000).alias("len"))
    chosen = cut_lineage(narrow.join(middle, ["__host", "len"]).groupBy("__host").agg(F.min("page_id").alias("page_id")))
    id_bytes = chosen.select(F.coalesce(F.sum(F.length("__host") + 16), F.lit(0))).head()[0]
    ids = F.broadcast(chosen) if id_bytes <= BROADCAST_BYTES else chosen
    refs = cut_lineage(pages.select("__host", "page_id", "html").where("html is not null").join(ids, ["__host", "page_id"])
                       .groupBy("__host").agg(F.min("html").alias("__ref")))
    return refs, refs.select(F.coalesce(F.sum(F.octet_length("__ref")), F.lit(0))).head()[0]


VOTES = "__host string, node int, pages long, equal long, chars long"


def votes(pages: DataFrame, refs: DataFrame, n_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, Reference] = {}
        sums: dict[tuple[str, int], list[int]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(h, k, *v) for (h, k), v in sums.items()]
            sums.clear()
            cols = list(zip(*rows)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                names=["__host", "node", "pages", "equal", "chars"])

        for b in batches:
            for host, html, ref in zip(*(b.column(c) for c in ("__host", "html", "__ref"))):
                host, html, ref = host.as_py(), html.as_py(), ref.as_py()
                if html == ref:
                    continue
                if host not in cache:
                    if len(cache) >= 256:
                        cache.clear()
                    cache[host] = Reference(ref)
                for k, v in cache[host].vote(html).items():
                    own = sums.setdefault((host, k), [0, 0, 0])
                    for i in range(3):
                        own[i] += v[i]
            if len(sums) >= FLUSH:
                yield flush()
        yield flush()

    both = joined_by_host(pages.where("html is not null").select("__host", "html"), refs, n_bytes, "inner")
    return both.select("__host", "html", "__ref").mapInArrow(run, VOTES).groupBy("__host", "node").agg(
        *[F.sum(c).alias(c) for c in ("pages", "equal", "chars")])


def wrappers(pages: DataFrame) -> tuple[DataFrame, int]:
    """(__host, __ref, __votes) of every host, and the bytes of the references."""
    refs, n_bytes = references(pages)
    by_host = votes(pages, refs, n_bytes).groupBy("__host").agg(  # at most one entry a node of the reference
        F.collect_list(F.struct("node", "pages", "equal", "chars")).alias("__votes"))
    return cut_lineage(refs.join(by_host, "__host", "left")), n_bytes


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html, ...) with ``text``, the main text."""
    columns = [c for c in pages.columns if c != "text"]
    hosted = with_host(pages.select(*columns))
    found, n_bytes = wrappers(hosted)
    keep = [c for c in columns if c != "html"]
    schema = hosted.select(*keep, F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str | None, Reference] = {}
        for b in batches:
            out = []
            for at, (host, html) in enumerate(zip(b.column("__host"), b.column("html"))):
                host = host.as_py()
                if host not in cache:
                    if len(cache) >= 256:
                        cache.clear()
                    cache[host] = Reference(b.column("__ref")[at].as_py() or "")
                    cache[host].induce([(v["node"], v["pages"], v["equal"], v["chars"]) for v in b.column("__votes")[at].as_py() or ()])
                out.append(cache[host].extract(html.as_py() or ""))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(out, pa.string())], names=[*keep, "text"])

    return joined_by_host(hosted, found, 2 * n_bytes, "left").select(*keep, "html", "__host", "__ref", "__votes").mapInArrow(run, schema)


def op2(pages: DataFrame) -> DataFrame:
    """The contract's rows."""
    return extract(pages.select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
