"""Main text of web pages by wrapper induction.

Pages of one host share templates. For each host and outline (the names of its sectioning elements) one page,
that of smallest content hash, serves as the wrapper's skeleton; a host has up to ``SKELETONS`` of them, so a
listing or an error page doesn't stand for its articles. Every page's tree of block elements is aligned to the
skeleton of its outline by simple tree matching, the ordered matching of greatest size found by dynamic
programming over the child lists of matched nodes (equal subtrees are compared once; long lists by divide and
conquer in linear memory).

Over all pages it is then counted for each skeleton node how much of the pages' text it holds, how much of that is link text, and how much of it *recurs*: stands in pieces (sentences, parts between bars and
dots; inside an article whole blocks) that are met on another page too. Pages are told apart by the longest block
outside the piece's own element, so copies of a page are no evidence. A text without a matched element of its own
counts for the innermost matched one around it. ``template`` decides from these counts:

* a node that holds most of the text, or an article or main element, is never template as a whole;
* a node whose text mostly recurs is constant, hence template (inside the article more evidence is asked for);
* a node that is nearly all link text is a menu, hence template (not inside the article);
* a node that is named as page furniture by tag, role or class is template, for slots that vary without being content
  (reader comments, rotating adverts). Inside the article a class or id names only where a whole token of it is such a
  word, or begins with one for adverts or comments, and only where the slot is met on other pages of the host too; without any
  other page the name decides. Text that the skeleton has no slot for needs a name of adverts or comments.

A second pass aligns each page again and returns the text of all that is not template. Nodes that the skeleton
doesn't have take the verdict of the node that they lie in, or of like-named siblings; else name and links decide.

Bounds: skeletons are broadcast only where all of them together take at most ``BROADCAST_BYTES``; beyond that they
are joined by host. Evidence is summed by node before it is shuffled.

Defined cases: null or empty html gives empty text; a null url belongs to the host ""; broken, unclosed or deep
markup is read as far as it goes; repeated rows each give a row; other columns of the input are ignored; an empty
table gives an empty result. Two subtrees that differ only beyond their matched parts count as equally good, the
earlier one in page order is taken.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import slices
from .store import written

BROADCAST_BYTES = 16 << 20
SKELETONS = 4  #: skeleton pages of a host
CONSTANT, INNER_PIECES, INNER_CONSTANT = 0.5, 20, 0.95  #: share of recurring text that makes a node template; inside the article, where most text is content, the least evidence and its share
MOST = 0.5  #: share of the page's text that makes a node the main slot
MENU = 0.8  #: share of link text that makes a node a menu
CELLS = 1 << 20  #: size of a matching table beyond which it is split

# HTML element names and the words that name page furniture.
SECTIONS = ("article", "main", "nav", "aside", "header", "footer", "section", "table", "form")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("title script style noscript template iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead tr ul button label caption video audio".split())
CHROME_TAGS = frozenset("head nav footer aside form menu dialog button label select option textarea fieldset search".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CHROME_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin search form share sharing social comment comments commentlist respond reply replies disqus related recommended recommendations widget pagination pager skip copyright legal disclaimer".split())
HEADER_WORDS = frozenset("header masthead".split())  #: page furniture unless within an article
SLOT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments commentlist respond replies disqus".split())  #: adverts and reader comments
ABOUT = frozenset("has with no without".split())  #: before a name they say what the page is like, not what the element is
CLOSED_BY = {"p": BLOCK, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"}), "head": frozenset({"body"})}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """The block elements of a page in order, and the text of each that has some of its own.

    ``symbol``, ``parent``, ``kids``, ``named`` (as page furniture), ``strict`` (named so that it counts inside an article; 2 for adverts
    and comments): by node, 0 being the root, parents first.
    ``blocks``: (node, text, characters of it in links).
    """

    def __init__(self, source: str):
        self.symbol, self.parent, self.kids, self.named, self.strict = ["#"], [-1], [[]], [False], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self.shapes: tuple[list[int], dict] | None = None  # kept for a skeleton
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#", 0)]  # open elements, inline ones with the node they are in
        opened: Counter[str] = Counter()
        block_at: list[int] = []  # places of block elements in the stack
        within = [False]  # by node: inside an article or main element
        buffer: list[str] = []
        linked = at = 0

        def flush() -> None:
            nonlocal linked
            if buffer:
                text = " ".join("".join(buffer).split())
                buffer.clear()
                if text:
                    self.blocks.append((stack[-1][1], text, min(linked, len(text))))
            linked = 0

        def add(raw: str) -> None:
            nonlocal linked
            text = entities.unescape(raw) if "&" in raw else raw
            buffer.append(text)
            if opened["a"]:
                linked += len(text.strip())

        def close(k: int) -> None:
            if any(stack[i][1] != stack[i - 1][1] for i in range(k, len(stack))):
                flush()
            for name, _ in stack[k:]:
                opened[name] -= 1
            del stack[k:]
            while block_at and block_at[-1] >= k:
                block_at.pop()

        end = len(source)
        while at < end:
            m = _TAG.search(source, at)
            if m is None:
                add(source[at:])
                break
            if m.start() > at:
                add(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    add(m[0][9:-3])
                continue
            name = m[2].lower()
            if m[1]:
                if opened[name]:
                    k = len(stack) - 1
                    low = 0 if name in BLOCK or not block_at else block_at[-1]  # an inline end tag doesn't close a block
                    while k > low and stack[k][0] != name:
                        k -= 1
                    if k and stack[k][0] == name:
                        close(k)
                continue
            if name in RAW:
                if m[3].endswith("/") and name in ("svg", "math"):
                    continue
                stop = _END[name].search(source, at)
                at = stop.end() if stop else end
                continue
            if name == "br" or name == "wbr":
                buffer.append(" " if name == "br" else "")
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            for k in block_at[:-3:-1]:  # the innermost block, or that around an open paragraph
                if name in CLOSED_BY.get(stack[k][0], ()):
                    close(k)
                    break
                if stack[k][0] != "p":
                    break
            here = stack[-1][1]
            words, out, head, strict = _names(m[3]) if m[3] else ("", False, False, 0)
            head = (head or name == "header") and not within[here]
            out = (out or head) and name not in ("html", "body", "main", "article")
            if name in BLOCK or out:
                flush()
                node = len(self.symbol)
                self.symbol.append(f"{name}.{words}" if words else name)
                self.parent.append(here)
                self.kids.append([])
                self.kids[here].append(node)
                self.named.append(out or name in CHROME_TAGS)
                self.strict.append(strict if name not in CHROME_TAGS else max(1, strict))
                within.append(within[here] or name in ("article", "main"))
                here = node
                block_at.append(len(stack))
            stack.append((name, here))
            opened[name] += 1
        flush()

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters of text in each node's subtree, and how many of them are link text."""
        chars, links = np.zeros(len(self.symbol), np.int64), np.zeros(len(self.symbol), np.int64)
        for node, text, linked in self.blocks:
            chars[node] += len(text)
            links[node] += linked
        for node in range(len(self.symbol) - 1, 0, -1):
            chars[self.parent[node]] += chars[node]
            links[self.parent[node]] += links[node]
        return chars, links

    def holders(self) -> list[bool]:
        """Which nodes are, or hold, an article or main element."""
        out = [s.split(".")[0] in ("article", "main") for s in self.symbol]
        for node in range(len(out) - 1, 0, -1):
            out[self.parent[node]] |= out[node]
        return out

    def inside(self, chars: np.ndarray | None = None) -> list[bool]:
        """Which nodes lie in the article: in an article or main element, or without these in the innermost node with most of the text."""
        core = [s.split(".")[0] in ("article", "main") for s in self.symbol]
        if not any(core) and chars is not None:
            x = 0
            while (k := next((k for k in self.kids[x] if self.kids[k] and chars[k] >= MOST * max(1, chars[0])), None)) is not None:
                x = k
            if x and self.symbol[x] not in ("html", "body"):
                core[x] = True
        out = [False] * len(core)
        for node in range(1, len(core)):
            above = self.parent[node]
            out[node] = out[above] or core[above]
        return out


_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


@lru_cache(4096)
def _names(attributes: str) -> tuple[str, bool, bool, int]:
    """Class and id words of an element, whether they name page furniture or a header, and whether a whole token does (2: adverts or comments)."""
    words, out, head, strict = [], False, False, 0
    for m in _NAMES.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "role":
            if value.lower() in CHROME_ROLES:
                out, strict = True, max(strict, 1)
            continue
        own = [w.lower() for w in _WORD.findall(value)]
        out |= any(w in CHROME_WORDS and (not i or own[i - 1] not in ABOUT) for i, w in enumerate(own))
        head |= not HEADER_WORDS.isdisjoint(own)
        words += own
        for token in value.split():
            parts = [w.lower() for w in _WORD.findall(token)]
            if parts and parts[0] in SLOT_WORDS:
                strict = 2
            elif len(parts) == 1 and parts[0] in CHROME_WORDS:
                strict = max(strict, 1)
    return " ".join(words), out, head, strict


def _shapes(page: Page, known: dict) -> list[int]:
    """A number for each node's subtree, the same for equal ones; ``known``: (symbol, numbers of the children) → number."""
    out = [0] * len(page.symbol)
    for x in range(len(out) - 1, -1, -1):
        out[x] = known.setdefault((page.symbol[x], tuple(out[k] for k in page.kids[x])), len(known))
    return out


class _Matching:
    """Sizes of the greatest ordered matchings of subtrees, by their shapes."""

    def __init__(self) -> None:
        self.known: dict = {}
        self.memo: dict[tuple[int, int], int] = {}
        self.small: dict[tuple[tuple, tuple], list[list[int]]] = {}  # tables of short child lists
        self.forms: list[tuple] = []

    def size(self, p: int, q: int) -> int:
        """Matched nodes of the subtrees of shapes p and q, without recursion: pairs of children first."""
        todo = [(p, q)]
        while todo:
            x, y = todo[-1]
            if (x, y) in self.memo:
                todo.pop()
                continue
            (s, a), (t, b) = self.forms[x], self.forms[y]
            if s != t:
                self.memo[x, y] = 0
            elif not a or not b:
                self.memo[x, y] = 1
            elif x == y:
                self.memo[x, y] = self.nodes(x)
            else:
                ask = {(u, v) for u in set(a) for v in set(b) if (u, v) not in self.memo}
                if ask:
                    todo += ask
                    continue
                self.memo[x, y] = 1 + self.last_row(a, b)[-1]
            todo.pop()
        return self.memo[p, q]

    def nodes(self, x: int) -> int:
        todo, n = [x], 0
        while todo:
            n += 1
            todo += self.forms[todo.pop()][1]
        return n

    def rows(self, a: tuple, b: tuple) -> Iterator[np.ndarray]:
        """The matching table of two child lists, row by row."""
        row = np.zeros(len(b) + 1, np.int64)
        yield row
        kinds, at = np.unique(np.array(b, np.int64), return_inverse=True)
        for u in a:
            w = np.array([self.memo[u, int(v)] for v in kinds])[at]
            row = np.concatenate([[0], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w))])
            yield row

    def last_row(self, a: tuple, b: tuple) -> list[int]:
        if len(a) * len(b) > 400:
            for row in self.rows(a, b):
                pass
            return row.tolist()
        memo, last = self.memo, [0] * (len(b) + 1)
        table = [last]
        for u in a:
            row, best = [0], 0
            for j, v in enumerate(b):
                w = last[j] + memo[u, v]
                best = max(best, last[j + 1], w)
                row.append(best)
            table.append(row)
            last = row
        self.small[a, b] = table
        return last

    def pairs(self, a: tuple, b: tuple) -> list[tuple[int, int]]:
        """Places of matched children in a greatest matching; tables beyond ``CELLS`` are split in two."""
        out, todo = [], [(0, len(a), 0, len(b))]
        while todo:
            lo, hi, l, r = todo.pop()
            if hi - lo > 1 and (hi - lo) * (r - l) > CELLS:
                mid = (lo + hi) >> 1
                left = np.array(self.last_row(a[lo:mid], b[l:r]))
                right = np.array(self.last_row(a[lo:hi][mid - lo :][::-1], b[l:r][::-1]))[::-1]
                cut = l + int(np.argmax(left + right))
                todo += [(lo, mid, l, cut), (mid, hi, cut, r)]
                continue
            table = self.small.get((a[lo:hi], b[l:r])) or [row.tolist() for row in self.rows(a[lo:hi], b[l:r])]
            i, j = hi - lo, r - l
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((lo + i, l + j))
        return out


def align(a: Page, b: Page) -> dict[int, int]:
    """Simple tree matching: the node of ``a`` for each matched node of ``b``."""
    m = _Matching()
    if a.shapes is None:
        known: dict = {}
        a.shapes = _shapes(a, known), known
    sa, m.known = a.shapes[0], dict(a.shapes[1])
    sb = _shapes(b, m.known)
    m.forms = list(m.known)
    found: dict[int, int] = {}
    ways: dict[tuple[int, int], list[tuple[int, int]]] = {}
    todo = [(0, 0)]
    m.size(sa[0], sb[0])
    while todo:
        x, y = todo.pop()
        found[y] = x
        p, q = a.kids[x], b.kids[y]
        if not p or not q:
            continue
        if sa[x] == sb[y]:
            todo += zip(p, q, strict=True)
            continue
        key = sa[x], sb[y]
        if key not in ways:
            ways[key] = m.pairs(m.forms[key[0]][1], m.forms[key[1]][1])
            for i, j in ways[key]:
                m.size(sa[p[i]], sb[q[j]])
        todo += [(p[i], q[j]) for i, j in ways[key]]
    return found


@lru_cache(64)
def _page(source: str) -> Page:
    return Page(source)


def evidence(skeleton: Page, page: Page) -> Iterator[tuple[int, int, int, int, int]]:
    """(skeleton node, hash of a piece of its text, the rest of the page, characters, those in links) of every piece of the page.

    The rest of the page is told by a hash of its longest block outside the piece's element, the first of several; 0 where there is none.
    """
    n = len(page.blocks)
    first, last = [n] * len(page.symbol), [0] * len(page.symbol)  # a subtree's blocks follow one another
    for i, (node, _, _) in enumerate(page.blocks):
        first[node], last[node] = min(first[node], i), max(last[node], i + 1)
    for node in range(len(first) - 1, 0, -1):
        above = page.parent[node]
        first[above], last[above] = min(first[above], first[node]), max(last[above], last[node])
    before, after = [-1] * (n + 1), [-1] * (n + 1)  # the longest block before and from each place on
    longer = lambda i, j: j if i < 0 or j >= 0 and len(page.blocks[j][1]) > len(page.blocks[i][1]) else i
    for i in range(n):
        before[i + 1] = longer(before[i], i)
    for i in range(n - 1, -1, -1):
        after[i] = i if after[i + 1] < 0 or len(page.blocks[i][1]) >= len(page.blocks[after[i + 1]][1]) else after[i + 1]
    name = [_hash(t) for _, t, _ in page.blocks] + [0]
    at = align(skeleton, page)
    for y in range(1, len(page.symbol)):
        at.setdefault(y, at[page.parent[y]])
    inside = page.inside()
    for node, text, linked in page.blocks:
        rest = name[longer(before[first[node]], after[last[node]])]
        for piece in [text] if inside[node] else filter(None, _PIECE.split(text)):
            yield at[node], _hash(piece), rest, len(piece), linked * len(piece) // len(text)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


_PIECE = re.compile(r"(?<=[.!?])\s+|\s*[·•|»›—–]\s*")


def template(skeleton: Page, counts: list[tuple[int, int, int, int, int]]) -> frozenset[int]:
    """The skeleton's template nodes by induced counts: (node, pieces of text of its own, their characters, recurring ones, those in links).

    A node below a template node is template. Nodes without text on any page are left to their names.
    """
    alone = all(c[1] < 2 for c in counts)  # no other page of the host speaks
    n, chars, again, links = (np.zeros(len(skeleton.symbol), np.int64) for _ in range(4))
    for node, *c in counts:
        n[node], chars[node], again[node], links[node] = c
    for node in range(len(n) - 1, 0, -1):
        above = skeleton.parent[node]
        n[above] = max(n[above], n[node])
        for column in (chars, again, links):
            column[above] += column[node]
    holds, inside = skeleton.holders(), skeleton.inside(chars)
    out: set[int] = set()
    for x in range(1, len(n)):
        if skeleton.parent[x] in out:
            out.add(x)
        elif not holds[x] and chars[x] < MOST * max(1, chars[0]):
            if inside[x]:
                constant, menu = n[x] >= INNER_PIECES and again[x] >= INNER_CONSTANT * chars[x], False
                named = skeleton.strict[x] and (alone or n[x] >= 2 or not chars[x])
            else:
                named = skeleton.named[x]
                constant, menu = chars[x] > 0 and again[x] >= CONSTANT * chars[x], chars[x] > 0 and links[x] >= MENU * chars[x]
            if constant or menu or named:
                out.add(x)
    return frozenset(out)


def content(skeleton: Page, page: Page, fixed: frozenset[int]) -> str:
    """Text of the page's slots: all blocks outside template nodes."""
    at = align(skeleton, page)
    chars, links = page.sizes()
    holds = page.holders()
    named = {(skeleton.parent[x], skeleton.symbol[x]): True for x in range(1, len(skeleton.symbol))}
    for x in range(1, len(skeleton.symbol)):
        if x not in fixed:
            named[skeleton.parent[x], skeleton.symbol[x]] = False
    inside = page.inside(chars)
    gone = [False] * len(page.symbol)
    for y in range(1, len(page.symbol)):
        above = page.parent[y]
        if gone[above]:
            gone[y] = True
        elif y in at:
            gone[y] = at[y] in fixed
        elif not holds[y] and chars[y] < MOST * chars[0]:
            like = named.get((at[above], page.symbol[y]), False) if above in at else False
            own = page.strict[y] > (0 if page.symbol[y].split(".")[0] in CHROME_TAGS else 1) if inside[y] else page.named[y]
            gone[y] = like or own or (not inside[y] and chars[y] > 0 and links[y] >= MENU * chars[y])
    return " ".join(text for node, text, _ in page.blocks if not gone[node])


def with_host(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host, and outline: a bit for each sectioning element that the page has, written in lower case."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    bits = [F.when(F.col("html").contains(f"<{name}"), 1 << i).otherwise(0) for i, name in enumerate(SECTIONS)]
    return rows.withColumn("outline", sum(bits[1:], bits[0]))


def skeletons(pages: DataFrame) -> DataFrame:
    """(host, outline, rank, skeleton): pages of the host's ``SKELETONS`` most frequent outlines, rank 1 the most frequent.

    Each task keeps one page of an outline at most before the shuffle.
    """
    rows = with_host(pages).where("html <> ''")
    one = rows.groupBy("host", "outline").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("html").alias("h"), "html")).alias("s"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "outline"))
    return one.withColumn("rank", rank).where(F.col("rank") <= SKELETONS).select("host", "outline", "rank", F.col("s.html").alias("skeleton"))


def _joined(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Pages with the wrapper of their host and outline, or that of the host's most frequent outline."""
    size = wrappers.agg(F.coalesce(F.sum(F.length("skeleton") + 64), F.lit(0))).first()[0]
    few = F.broadcast if size <= BROADCAST_BYTES else (lambda x: x)
    ranks = wrappers.select("host", "outline", "rank")
    rows = with_host(pages).join(few(ranks), ["host", "outline"], "left").withColumn("rank", F.coalesce("rank", F.lit(1))).drop("outline")
    return rows.join(few(wrappers.drop("outline")), ["host", "rank"], "left")


def induce(pages: DataFrame) -> DataFrame:
    """(host, outline, rank, skeleton, counts): the wrappers of each host with the evidence of all pages, see ``template``."""
    base = written(skeletons(pages), "skeletons")
    names = ["host", "rank", "node", "piece", "page", "last", "n", "chars", "links"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            tally: dict[tuple, list[int]] = {}
            for host, rank, source, skeleton in zip(*(b.column(k).to_pylist() for k in ("host", "rank", "html", "skeleton")), strict=True):
                if source and skeleton:
                    for node, piece, rest, chars, links in evidence(_page(skeleton), Page(source)):
                        t = tally.setdefault((host, rank, node, piece), [rest, rest, 0, 0, 0])
                        t[:] = min(t[0], rest), max(t[1], rest), t[2] + 1, t[3] + chars, t[4] + links
            kinds = [pa.string(), pa.int32(), pa.int32()] + [pa.int64()] * 6
            columns = [[k[i] for k in tally] for i in range(4)] + [[t[i] for t in tally.values()] for i in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    met = _joined(pages, base).select("host", "rank", "html", "skeleton").mapInArrow(count, "host string, rank int, node int, piece long, page long, last long, n long, chars long, links long")
    met = written(met, "evidence")
    again = met.groupBy("piece").agg(F.min("page").alias("page"), F.max("last").alias("last")).where("page <> last").select("piece", F.lit(1).alias("again"))
    again = written(again, "recurring")
    recurring = F.sum(F.when(F.col("again") == 1, F.col("chars")).otherwise(0)).alias("again")
    nodes = met.join(again, "piece", "left").groupBy("host", "rank", "node").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), recurring, F.sum("links").alias("links"))
    counts = nodes.groupBy("host", "rank").agg(F.sort_array(F.collect_list(F.struct("node", "n", "chars", "again", "links"))).alias("counts"))
    return written(base.join(counts, ["host", "rank"], "left").select("host", "outline", "rank", "skeleton", "counts"), "wrappers")


def extract(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """One row for each page: page_id, url, main text, its number of code points."""
    wrappers = induce(pages) if wrappers is None else wrappers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decided: dict[tuple, frozenset[int]] = {}
        for b in slices(batches, "html"):
            text = []
            for host, rank, source, skeleton, counts in zip(*(b.column(k).to_pylist() for k in ("host", "rank", "html", "skeleton", "counts")), strict=True):
                if not source:
                    text.append("")
                    continue
                base = _page(skeleton)
                if (host, rank) not in decided:
                    if len(decided) >= 1000:
                        decided.clear()
                    decided[host, rank] = template(base, [tuple(c.values()) for c in counts or ()])
                text.append(content(base, Page(source), decided[host, rank]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return _joined(pages, wrappers).select("page_id", "url", "html", "host", "rank", "skeleton", "counts").mapInArrow(run, "page_id long, url string, text string, n_chars long")
