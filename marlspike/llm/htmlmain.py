"""HTML extraction by wrapper induction over the pages of a host.

A page becomes a tree of its block elements (inline markup flows into the text of its
block; scripts, styles and comments never enter).  For matching, neighbouring siblings
of one shape are one node, a *group*, so a page with five paragraphs and one with fifty
align; the texts of a group's members still count one by one.

Induction, over all pages of a host:

1. the distinct trees of groups (tags and classes, no text) are aligned by simple tree
   matching (the largest order-preserving match of nodes of equal tag and class, top
   down) and merged into one tree, the wrapper, of which every page's tree is a part;
2. each page is aligned with the wrapper, and for every node the pages that have it,
   their running text and the pages that share a text are counted;
3. a text that ``TEMPLATE_SHARE`` of the pages with a node share (``TEMPLATE_PAGES`` of
   them at least) is template (rows of a list or table only all together); a node's
   other text is a slot, and its mean length over those pages is the node's weight.

Extraction: a page is aligned with its host's wrapper.  From the body down, the block
that has most of the weight of slots is followed until the weight parts or the article
element is met; a headline in a slot before that block is kept.  All blocks in there
are the article, in page order, without template texts (unless they are nearly all of
it, as on a host that repeats one page) and without what tag, role or class call a
menu, header, footer, sidebar, notice, advert, form or comment.  A form around the page's
content is a container, not a form.

Blocks are joined by one newline; white space inside a block becomes one space.

Defined results: null and empty pages have an empty text; a page without url belongs
to the host without a name; the wrapper of a host with one page is that page; equal
pages of a host have equal texts; unclosed and misplaced tags are mended; digits in
class names do not count; repeated rows are pages of their own; extra columns are
ignored.  Nothing depends on the order or partitioning of the rows.

Scale: trees without text are few for each host and are merged ``FAN`` at a time in an
order given by the trees, so a host with a third of all pages costs no task more than
that many trees.  Counts are summed in each task before they are shuffled, by host,
node and text.  Wrappers are broadcast when their measured size is at most
``BROADCAST_BYTES``; beyond it they are joined by host.  A host whose pages have classes
of their own has a wrapper in proportion to them.
"""

from __future__ import annotations

import functools
import json
import math
import re
import sys
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import output, written

BROADCAST_BYTES = 32 << 20
FAN = 500
HELD = 200_000
TEMPLATE_PAGES = 4
TEMPLATE_SHARE = 0.8
COPY_SHARE = 0.8
MAIN_SHARE = 0.5
PASSAGE = 80
CELLS = 100_000

# HTML element names by their role, ARIA roles, and words in class and id that name what is not the article.
BLOCKS = frozenset("html head title body nav ul ol li div article section main aside header footer form p h1 h2 h3 h4 h5 h6 table tr blockquote pre figure figcaption dl dt dd hr fieldset address details summary dialog menu center caption legend option".split())
RAW = frozenset("script style textarea noscript template iframe svg select button object canvas audio video".split())
OUTSIDE = frozenset("head nav footer aside form menu dialog fieldset option legend".split())
HEADINGS = frozenset("h1 h2 h3".split())
TITLES = frozenset("h1 h2".split())
CONTAINERS = frozenset("html body div section article main center table tr form fieldset".split())
WRAPS = frozenset("form fieldset".split())
FRAMED = frozenset("article main h1".split())
ROWS = frozenset("li dt dd tr".split())
SPACES = frozenset("br td th wbr img input hr".split())
CLOSES = {"p": frozenset("p".split()), "li": frozenset("p li".split()), "dt": frozenset("p dt dd".split()), "dd": frozenset("p dt dd".split()), "tr": frozenset("p tr".split()), "option": frozenset("option".split())}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
MARKED = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs pagination pager sidebar aside foot footer masthead cookie cookies consent gdpr notice alert popup modal comment comments disqus reply replies newsletter subscribe signup login".split())
BOXES = frozenset("box container wrapper wrap block list item items bar area section top bottom left right inner outer unit slot widget links link form content panel".split())
UNLESS = frozenset("no not has with without".split())

_TAG = re.compile(r"""<(?:!--(?:.*?-->|.*)|/?[a-zA-Z](?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>?)|[!?][^>]*+>?)""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")


class Node:
    """A block element: its parts are texts (text, characters in links) and nodes, in order."""

    __slots__ = ("tag", "key", "marks", "parts", "kids", "sign", "groups", "weight", "template", "headed", "titled", "full", "framed", "passage", "holds")

    def __init__(self, tag: str, key: str = "", marks: tuple[str, ...] = ()):
        self.tag, self.key, self.marks = tag, key or tag, marks
        self.parts: list = []
        self.kids: list[Node] = []
        self.weight = 0.0
        self.template = self.headed = self.titled = self.framed = self.passage = self.holds = False
        self.full = 0

    def own(self) -> str:
        return " ".join(x[0] for x in self.parts if not isinstance(x, Node))

    def running(self) -> int:
        """Characters of its own text that are not in links."""
        return sum(len(x[0]) - x[1] for x in self.parts if not isinstance(x, Node))


def _marked(tag: str) -> tuple[str, tuple[str, ...]]:
    """(classes without digits for matching, class, id and role tokens) of a tag's source."""
    classes: set[str] = set()
    marks: set[str] = set()
    for name, *values in _MARKS.findall(tag):
        found = "".join(values).split()
        marks.update(found if name.lower() != "role" else ("role=" + x.lower() for x in found))
        if name.lower() == "class":
            classes.update(_DIGITS.sub("#", x) for x in found)
    return ".".join(sorted(classes)), tuple(sorted(marks))


def parse(html: str) -> list[Node]:
    """The page's blocks, the root first and parents before children; tags that are never closed or never opened are mended."""
    root = Node("#")
    nodes, stack, open_ = [root], [root], {"#": 1}
    text: list[str] = []
    link = linked = at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            flow = " ".join(unescape("".join(text)).split())
            if flow:
                stack[-1].parts.append((flow, min(linked, len(flow))))
            text.clear()
        linked = 0

    def close(k: int) -> None:
        for node in stack[k:]:
            open_[node.tag] -= 1
        del stack[k:]

    size = len(html)
    while at < size:
        found = _TAG.search(html, at)
        if not found:
            text.append(html[at:])
            break
        if found.start() > at:
            piece = html[at : found.start()]
            text.append(piece)
            if link:
                linked += len(piece.strip())
        at = found.end()
        tag = found.group()
        name = _NAME.match(tag)
        if not name:
            continue
        name = name.group(1).lower()
        if tag[1] == "/":
            if name in BLOCKS and open_.get(name):
                flush()
                k = len(stack) - 1
                while stack[k].tag != name:
                    k -= 1
                close(k)
            elif name == "a":
                link = max(0, link - 1)
            continue
        if name in RAW:
            if not tag.endswith("/>"):
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
                at = end.end() if end else size
            text.append(" ")
        elif name in BLOCKS:
            flush()
            link = 0
            closes = CLOSES.get(name, CLOSES["p"])
            k = len(stack)
            while k > 1 and stack[k - 1].tag in closes:
                k -= 1
            close(k)
            classes, marks = _marked(tag) if "=" in tag else ("", ())
            node = Node(name, f"{name}.{classes}" if classes else name, marks)
            stack[-1].parts.append(node)
            stack[-1].kids.append(node)
            nodes.append(node)
            if name != "hr":
                stack.append(node)
                open_[name] = open_.get(name, 0) + 1
        elif name == "a":
            link += 1
        elif name in SPACES:
            text.append(" ")
    flush()
    return nodes


def blocks(root: Node, leave: Callable[[Node], bool]) -> Iterator[tuple[Node, str]]:
    """(node, text) of every block below ``root`` in page order, without the nodes to leave out."""
    stack: list = [root]
    while stack:
        node, at = stack.pop() if isinstance(stack[-1], tuple) else (stack.pop(), 0)
        for k in range(at, len(node.parts)):
            part = node.parts[k]
            if not isinstance(part, Node):
                yield node, part[0]
            elif not leave(part):
                stack += [(node, k + 1), part]
                break


class Tree:
    """A node for matching: a group of a page, or a node of a wrapper."""

    __slots__ = ("key", "kids", "members")

    def __init__(self, key: str, members: list[Node] | None = None):
        self.key, self.members = key, members or []
        self.kids: list[Tree] = []


def groups(nodes: list[Node]) -> Tree:
    """A page's tree of groups; siblings of one group have equal shapes down to the leaves."""
    signs: dict[tuple, int] = {}
    for node in reversed(nodes):
        found: list[list[Node]] = []
        for k in node.kids:
            if found and found[-1][0].sign == k.sign:
                found[-1].append(k)
            else:
                found.append([k])
        node.groups = found
        node.sign = signs.setdefault((node.key, *(g[0].sign for g in found)), len(signs))
    top = Tree(nodes[0].key, [nodes[0]])
    open_ = [top]
    while open_:
        t = open_.pop()
        for alike in zip(*(m.groups for m in t.members)):
            members = [n for group in alike for n in group]
            t.kids.append(Tree(members[0].key, members))
        open_ += t.kids
    return top


def preorder(top: Tree) -> list[tuple[Tree, int]]:
    """The nodes with their depths, parents before children, children in order."""
    out, open_ = [], [(top, 0)]
    while open_:
        t, depth = open_.pop()
        out.append((t, depth))
        open_ += [(k, depth + 1) for k in reversed(t.kids)]
    return out


def dumped(top: Tree) -> str:
    """The tree as text, one node a line; equal trees have equal texts."""
    return "\n".join(f"{depth} {t.key}" for t, depth in preorder(top))


def loaded(text: str) -> Tree:
    path: list[Tree] = []
    for line in text.split("\n"):
        depth, _, key = line.partition(" ")
        t = Tree(key)
        del path[int(depth) :]
        if path:
            path[-1].kids.append(t)
        path.append(t)
    return path[0]


def _deep(*trees: Tree) -> None:
    """Room for recursion down the trees (calls among Python functions take heap, not stack)."""
    need = 1000 + 4 * max(depth for t in trees for _, depth in preorder(t))
    if need > sys.getrecursionlimit():
        sys.setrecursionlimit(need)


def match(a: Tree, b: Tree, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: size of the largest match of two trees, and the matched children."""
    if a.key != b.key:
        return 0, []
    if (found := memo.get((id(a), id(b)))) is not None:
        return found
    x, y = a.kids, b.kids
    if len(x) * len(y) > CELLS:
        memo[id(a), id(b)] = out = _long(x, y, memo)
        return out
    best = [[0] * (len(y) + 1)]
    for p in x:
        above, row = best[-1], [0]
        for j, q in enumerate(y):
            got = above[j + 1] if above[j + 1] > row[j] else row[j]
            if p.key == q.key and (both := above[j] + match(p, q, memo)[0]) > got:
                got = both
            row.append(got)
        best.append(row)
    i, j, pairs = len(x), len(y), []
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    memo[id(a), id(b)] = out = (1 + best[len(x)][len(y)], pairs[::-1])
    return out


def _forms(nodes: list[Tree], forms: dict) -> list[int]:
    """A number for each node's keys and order, which are all that matching sees."""
    known: dict[int, int] = {}
    for top in nodes:
        for t, _ in reversed(preorder(top)):
            if id(t) not in known:
                known[id(t)] = forms.setdefault((t.key, *(known[id(k)] for k in t.kids)), len(forms))
    return [known[id(t)] for t in nodes]


def _long(x: list[Tree], y: list[Tree], memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """The same match of very long child lists, a row at a time; only some rows are kept, the others made again."""
    forms: dict = {}
    fx, fy = _forms(x, forms), np.array(_forms(y, forms))
    kinds, first, kind = np.unique(fy, return_index=True, return_inverse=True)
    by_key: dict[str, list[int]] = {}
    for c, j in enumerate(first):
        by_key.setdefault(y[j].key, []).append(c)
    pair: dict[int, np.ndarray] = {}
    for p, f in zip(x, fx):
        if f not in pair:
            pair[f] = np.zeros(len(kinds), np.int64)
            for c in by_key.get(p.key, ()):
                pair[f][c] = match(p, y[first[c]], memo)[0]

    def after(row: np.ndarray, i: int) -> np.ndarray:
        new = row.copy()
        np.maximum(row[1:], row[:-1] + pair[fx[i]][kind], out=new[1:])
        return np.maximum.accumulate(new)

    step = math.isqrt(len(x)) + 1
    row, kept = np.zeros(len(y) + 1, np.int64), []
    for i in range(len(x)):
        if i % step == 0:
            kept.append(row)
        row = after(row, i)
    total, j, pairs = int(row[-1]), len(y), []
    for block in range(len(kept) - 1, -1, -1):
        start = block * step
        rows = [kept[block]]
        for i in range(start, min(start + step, len(x))):
            rows.append(after(rows[-1], i))
        i = len(rows) - 1
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((start + i, j))
    return 1 + total, pairs[::-1]


def merged(a: Tree, b: Tree) -> Tree:
    """The tree of which both are parts: matched nodes once, the others in their places."""
    _deep(a, b)
    memo: dict = {}
    top = Tree(a.key)
    open_ = [(top, a, b)]
    while open_:
        t, p, q = open_.pop()
        i = j = 0
        for x, y in [*match(p, q, memo)[1], (len(p.kids), len(q.kids))]:
            t.kids += p.kids[i:x] + q.kids[j:y]
            if x < len(p.kids) and y < len(q.kids):
                t.kids.append(Tree(p.kids[x].key))
                open_.append((t.kids[-1], p.kids[x], q.kids[y]))
            i, j = x + 1, y + 1
    return top


def wrapped(trees: list[tuple[int, str]]) -> str:
    """The wrapper of (pages, tree) rows, merged in an order given by the rows alone."""
    first, *rest = [t for _, t in sorted(trees, key=lambda x: (-x[0], len(x[1]), x[1]))]
    whole = loaded(first)
    for text in rest:
        whole = merged(whole, loaded(text))
    return dumped(whole)


def aligned(wrapper: Tree, page: Tree) -> list[int]:
    """For each node of a page's tree in preorder, its number in the wrapper's preorder (-1: none)."""
    _deep(wrapper, page)
    number = {id(t): k for k, (t, _) in enumerate(preorder(wrapper))}
    memo: dict = {}
    found = {id(page): wrapper}
    out = []
    for t, _ in preorder(page):
        w = found.get(id(t))
        out.append(-1 if w is None else number[id(w)])
        if w is not None:
            for i, j in match(w, t, memo)[1]:
                found[id(t.kids[j])] = w.kids[i]
    return out


def _mark(text: str) -> int:
    """A 64-bit name of a text."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Host:
    """What is known of a host: its wrapper, and for each node the weight and the template texts."""

    def __init__(self, wrapper: str, nodes: str | None = None, template: str | None = None):
        self.tree = loaded(wrapper)
        self.weight = {w: chars / pages for w, pages, chars in json.loads(nodes or "[]")}
        self.template = {(w, mark) for w, mark in json.loads(template or "[]")}
        self.known: dict[str, list[int]] = {}

    def places(self, page: Tree) -> list[tuple[Tree, int]]:
        """The page's groups with their numbers in the wrapper."""
        text = dumped(page)
        at = self.known.get(text)
        if at is None:
            if len(self.known) > 1000:
                self.known.clear()
            at = self.known[text] = aligned(self.tree, page)
        return [(t, k) for (t, _), k in zip(preorder(page), at)]

    def tell(self, nodes: list[Node]) -> None:
        """Give a page's nodes their weight (with all below them) and say which are template."""
        for t, k in self.places(groups(nodes)):
            share = self.weight.get(k, 0.0) / len(t.members)
            for m in t.members:
                m.weight = share
                m.template = bool(self.template) and bool(m.own()) and (k, _mark(m.own())) in self.template
            if t.members[0].tag in ROWS and not all(m.template for m in t.members if m.own()):
                for m in t.members:
                    m.template = False


def counted(host: Host, nodes: list[Node]) -> Iterator[tuple[int, int | None, int]]:
    """(node, text, running characters) of a page: once for each node (text None), and for each text in a node."""
    for t, k in host.places(groups(nodes)):
        total = 0
        for m in t.members:
            if any(not isinstance(x, Node) for x in m.parts):
                total += (run := m.running())
                yield k, _mark(m.own()), run
        yield k, None, total


@functools.lru_cache(10_000)
def _role(mark: str) -> bool:
    """Whether a class, id or role names what is not the article."""
    if mark.startswith("role="):
        return mark[5:] in ROLES
    parts = [w.lower() for w in _PART.findall(mark)]
    if not parts or parts[0] in UNLESS:
        return False
    return parts[-1] in MARKED or (parts[0] in MARKED and parts[-1] in BOXES)


def outside(node: Node, in_article: bool) -> bool:
    """Whether tag, role or class say that it is no part of an article.  A header with a heading in the article belongs to it, and so does a form around the article."""
    if node.holds:
        return False
    if node.tag in OUTSIDE:
        return True
    if node.tag in ("html", "body", "main"):
        return False
    if node.tag == "header" or any(_PART.findall(m)[-1:] in (["header"], ["Header"]) for m in node.marks):
        return not (in_article and node.headed)
    return any(_role(m) for m in node.marks)


def around(nodes: list[Node]) -> None:
    """Mark forms that are wrapped around a page's content, as some frameworks do, instead of being a control in it.

    Such a form has an article, a main part or a first-rank heading in it, or half of the page's running text with a passage in it.
    """
    total = sum(node.running() for node in nodes)
    for node in reversed(nodes):
        node.full = node.running() + sum(k.full for k in node.kids)
        node.framed = node.tag in FRAMED or any(k.framed for k in node.kids)
        node.passage = (node.tag == "p" and node.running() >= PASSAGE) or any(k.passage for k in node.kids)
        node.holds = node.tag in WRAPS and (node.framed or (node.passage and node.full >= MAIN_SHARE * total))


def main_part(nodes: list[Node]) -> list[Node]:
    """The nodes that hold the article: the heaviest block, and before it a headline of its own."""
    around(nodes)
    for node in reversed(nodes):  # from the leaves up: headings, and weights without what is outside
        node.headed = node.tag in HEADINGS or any(k.headed for k in node.kids)
        node.titled = (node.tag in TITLES and not node.template) or any(k.titled for k in node.kids)
        node.weight = (0.0 if node.template else node.weight) + sum(k.weight for k in node.kids if not outside(k, False))
    node, heads = nodes[0], []
    while node.tag != "article":
        best = max((k for k in node.kids if not outside(k, False)), key=lambda k: k.weight, default=None)
        if best is None or best.tag not in CONTAINERS or not best.weight or best.weight < MAIN_SHARE * node.weight:
            break
        if not best.titled:
            heads += [k for k in node.kids[: node.kids.index(best)] if k.titled and not outside(k, True)]
        node = best
    return [*heads, node]


def main_text(html: str | None, host: Host | None = None) -> str:
    """The article's text."""
    if not html:
        return ""
    nodes = parse(html)
    if host is None:
        host = alone(nodes)
    host.tell(nodes)
    own: list[str] = []
    every: list[str] = []
    for top in main_part(nodes):
        for node, text in blocks(top, lambda k: outside(k, True)):
            every.append(text)
            if not node.template:
                own.append(text)
    few = sum(map(len, own)) < (1 - COPY_SHARE) * sum(map(len, every))
    return "\n".join(every if few else own)


def alone(nodes: list[Node]) -> Host:
    """A host that has one page."""
    host = Host(dumped(groups(nodes)))
    for k, mark, chars in counted(host, nodes):
        if mark is None:
            host.weight[k] = float(chars)
    return host


def host_of(url):
    """The host of a url column, in lower case; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", 1), F.lit(""))


def trees(pages: DataFrame, fan: int = FAN) -> DataFrame:
    """(host, wrapper) for every host of ``pages`` (columns host, html)."""

    def read(batches):
        held: dict[tuple[str, str], int] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array([h for h, _ in held], pa.string()), pa.array([t for _, t in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["host", "wrapper", "pages"])

        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = host, dumped(groups(parse(html or "")))
                held[key] = held.get(key, 0) + 1
            if len(held) > HELD // 50:
                yield out()
                held.clear()
        yield out()

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "wrapper": [wrapped(list(zip(pdf["pages"].tolist(), pdf["wrapper"])))], "pages": [int(pdf["pages"].sum())]})

    rows = pages.select("host", "html").mapInArrow(read, "host string, wrapper string, pages bigint")
    while True:
        rows = written(rows.groupBy("host", "wrapper").agg(F.sum("pages").alias("pages")), "trees")
        most = rows.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        part = F.pmod(F.xxhash64("wrapper"), F.lit(max(1, -(-most // fan))))
        rows = rows.groupBy("host", part.alias("part")).applyInPandas(join, "host string, wrapper string, pages bigint")
        if most <= fan:
            return rows.select("host", "wrapper")


def _hosts() -> Callable[..., Host]:
    """Hosts by wrapper, nodes and template, loaded once while they stay among the last."""
    last: dict[tuple, Host] = {}

    def get(*key) -> Host:
        if key not in last:
            if len(last) > 2000:
                last.clear()
            last[key] = Host(*key)
        return last[key]

    return get


def counts(pages: DataFrame) -> DataFrame:
    """(host, node, mark, pages, chars) of ``pages`` (columns host, html, wrapper), summed; mark is null for the node as such."""

    def read(batches):
        held: dict[tuple, list[int]] = {}
        get = _hosts()

        def out():
            keys, values = list(held), list(held.values())
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int64()), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["host", "node", "mark", "pages", "chars"])

        for batch in batches:
            for host, html, wrapper in zip(*(batch.column(k).to_pylist() for k in range(3))):
                seen = set()
                for node, mark, chars in counted(get(wrapper), parse(html or "")):
                    entry = held.setdefault((host, node, mark), [0, 0])
                    entry[0] += (node, mark) not in seen
                    entry[1] += chars
                    seen.add((node, mark))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    found = pages.select("host", "html", "wrapper").mapInArrow(read, "host string, node int, mark bigint, pages bigint, chars bigint")
    return found.groupBy("host", "node", "mark").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, nodes, template) for every host of ``pages`` (columns host, html); nodes and template as JSON."""
    known = written(trees(pages), "wrappers")
    found = counts(_with(pages, known)).where(F.col("mark").isNull() | (F.col("pages") >= TEMPLATE_PAGES))
    found = written(found, "page-counts")
    node = found.where("mark is null").select("host", "node", F.col("pages").alias("all"), F.col("chars").alias("total"))
    texts = found.where("mark is not null")
    small = node.count() <= BROADCAST_BYTES // 100
    constant = texts.join(F.broadcast(node) if small else node, ["host", "node"]).where(F.col("pages") >= TEMPLATE_SHARE * F.col("all"))
    constant = written(constant.select("host", "node", "mark", "chars"), "template")
    gone = constant.groupBy("host", "node").agg(F.sum("chars").alias("gone"))
    left = node.join(gone, ["host", "node"], "left").select("host", "node", "all", F.greatest(F.lit(0), F.col("total") - F.coalesce("gone", F.lit(0))).alias("chars"))

    def listed(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
        one = F.concat(F.lit("["), F.concat_ws(",", *[F.col(c).cast("string") for c in columns]), F.lit("]"))
        return rows.groupBy("host").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(one)), ","), F.lit("]")).alias(name))

    return known.join(listed(left, ["node", "all", "chars"], "nodes"), "host", "left").join(listed(constant, ["node", "mark"], "template"), "host", "left")


def _with(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Pages with what is known of their host."""
    size = known.select(F.sum(sum(F.coalesce(F.length(c), F.lit(0)) for c in known.columns))).first()[0] or 0
    return pages.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "host")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) for every page."""
    read = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col).cast("string")).alias("host"))
    known = written(wrappers(read), "hosts")

    def pull(batches):
        get = _hosts()
        for batch in batches:
            texts = [main_text(html, get(*key)) for html, *key in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    return _with(read, known).select("_id", "_url", "html", "wrapper", "nodes", "template").mapInArrow(pull, output(pages, {id_col: id_col}, f"`{url_col}` string, text string"))


def op4(spark, sf_dir: str) -> DataFrame:
    """``op4_extract_html`` over all of ``pages``."""
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
