"""Main text of web pages by wrapper induction.

Pages become trees of blocks (inline markup is part of its block's text). Simple tree matching aligns the
trees of a host's pages: the pairs of nodes with equal labels, in order, that maximise the number of nodes
matched. All pages of a host, copies once, are folded into one template tree that holds the parts of all:
by buckets first, then the buckets' templates. Each slot counts the texts that stand there. A text
slot of the template that says the same on most of the pages that have it is part of the template;
varying slots are content. A page is aligned with its host's template, loses what the
template says, and of the rest keeps the article: page parts that by tag, class, id or role are menus,
headers, footers, sidebars, notices, adverts, forms or comments go. A main element is the article, whole,
with an article element beside it that has more text; without one the article elements are it if they hold
most of the varying text. Otherwise all the rest of the page is; there, blocks of links go that stand
outside the subtree in which the varying text concentrates.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections import Counter
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, append, column, fresh

BUCKETS = 64
#: Levels of the tree (blocks nested deeper stand in the block of the last level), and pairs from which on an alignment's
#: table is filled by rows (for speed only).
DEPTH, CELLS = 150, 20_000
#: Texts counted at a slot of a template, and nodes of a template, beyond which the rarest go.
TEXTS, NODES = 64, 8000
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^<]*)\Z", re.S)
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "title", "canvas", "audio", "video", "select")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
BREAKS = frozenset(("br", "hr", "wbr"))
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
SKIP_TAGS = frozenset("nav footer aside form button dialog menu head".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Parts of names (between hyphens, underscores and spaces) of what isn't the article, anywhere, and only outside of it.
ANYWHERE = (
    r"ad|ads|adv|advert\w*|adbox|sponsor\w*|promo\w*|navbar|navigation|menu|breadcrumbs?|sidebar\w*|widget\w*|cookies?|consent|gdpr|popup|modal|newsletter|"
    r"subscribe|subscription|signup|login|comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommend\w*|pagination|pager|hidden"
)
OUTSIDE = (
    r"banner\w*|nav|menu\w*|footer|foot|masthead|topbar|toolbar|side|rail|notices?|alert|overlay|reactions?|skip|legal|copyright|disclaimer"
)
SKIP_INSIDE = re.compile(rf"(?:^|\s)(?:[a-z0-9]+[-_])?(?:{ANYWHERE}|notices?|banner)(?:[-_][a-z0-9]+)?(?:$|\s)", re.I)
SKIP_NAME = re.compile(rf"(?:^|[-_\s])(?:{ANYWHERE}|{OUTSIDE}|site-header|page-header)(?:$|[-_\s])", re.I)
SKIP_ARTICLE = re.compile(r"(?:^|[-_\s])(?:comments?|reply|replies)(?:$|[-_\s])", re.I)


class Node:
    __slots__ = ("tag", "label", "skip", "kids", "text", "links", "key", "seen", "texts")

    def __init__(self, tag, label, skip=False):
        self.tag, self.label, self.skip = tag, label, skip
        self.kids: list = []
        self.text, self.links, self.key = "", 0, 0
        self.seen = 1
        self.texts: dict | None = None


def hashed(text: str) -> int:
    """64 bits, the same in every process; not 0."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) or 1


def parse(page: str) -> Node:
    """The page's block tree; text leaves have the tag #text. Parts that are skipped in any case are empty."""
    root = Node("#root", "#root")
    stack, pos, hold, depth_a, link_chars = [root], 0, [], 0, 0

    def flush():
        nonlocal link_chars
        if hold:
            t = " ".join(html.unescape("".join(hold)).split())
            hold.clear()
            if t:
                leaf = Node("#text", "#text")
                leaf.text, leaf.links, leaf.key = t, link_chars, hashed(t)
                leaf.texts = {leaf.key: 1}
                if not any(x.skip for x in stack):
                    stack[-1].kids.append(leaf)
        link_chars = 0

    def say(s):
        nonlocal link_chars
        hold.append(s)
        if depth_a:
            link_chars += len(s)

    def pop_to(names, barrier=()):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return
            if stack[i].tag in barrier:
                return

    n = len(page)
    while pos < n:
        m = TOKEN.search(page, pos)
        if not m:
            say(page[pos:])
            break
        if m.start() > pos:
            say(page[pos : m.start()])
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue  # comment, declaration, or a tag cut off at the end
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                depth_a = max(0, depth_a - 1)
            if tag in INLINE:
                continue
            if tag == "br":
                say(" ")
                continue
            flush()
            pop_to({tag}, BARRIER.get(tag, ()))
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
                pos = end.end() if end else n
            say(" ")
            continue
        if tag == "a":
            depth_a += 1
        if tag in BREAKS:
            say("" if tag == "wbr" else " ")
            continue
        if tag in VOID:
            continue
        name, hidden = "", False
        if m[3]:
            names = []
            for a in ATTR.finditer(m[3]):
                k, v = a[1].lower(), a[2] or a[3] or a[4] or ""
                if k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v):
                    hidden = True
                elif k == "role":
                    hidden |= v.lower() in SKIP_ROLES
                elif k in ("class", "id"):
                    names.append(v)
            name = " ".join(names)
        inside = any(x.tag in ("article", "main") for x in stack)
        named = bool(name and (SKIP_INSIDE if inside else SKIP_NAME).search(name))
        if tag in INLINE and not hidden and not named:
            continue
        flush()
        if tag in ENDS_P:
            pop_to({"p"}, {"td", "th", "li", "div", "article", "section", "main", "aside", "body"} if tag != "p" else {"td", "th", "div", "article", "section", "main", "body"})
        if tag in CLOSES:
            pop_to(CLOSES[tag], BARRIER.get(tag, {"div", "article", "section", "main", "td", "body"}))
        inside = any(x.tag in ("article", "main") for x in stack)
        named = bool(name and (SKIP_INSIDE if inside else SKIP_NAME).search(name))
        skip = hidden or tag in SKIP_TAGS or (tag == "header" and not inside) or named and tag not in ("body", "html", "article", "main")
        skip |= tag == "article" and bool(SKIP_ARTICLE.search(name))
        node = Node(tag, f"{tag}.{re.sub(r'[0-9]+', '', name)}" if name else tag, skip)
        if len(stack) > DEPTH:
            node.kids = stack[-1].kids
        else:
            stack[-1].kids.append(node)
        if tag in INLINE:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            node.skip = True
            pos = end.end() if end else n
            continue
        stack.append(node)
    flush()

    return root


def match(a: Node, b: Node) -> tuple[int, list]:
    """Simple tree matching: the greatest number of matched nodes, and the children in order.

    Each is (child of a or None, child of b or None, the same below); a text that a template's slot has
    counted adds a half.
    """
    if a.label != b.label:
        return 0, []
    x, y = a.kids, b.kids
    if not x or not y:
        return 1, [*((k, None, ()) for k in x), *((None, k, ()) for k in y)]
    # children that say the same at both ends are matched as they stand
    lo, hi = 0, 0
    while lo < min(len(x), len(y)) and alike(x[lo], y[lo]):
        lo += 1
    while hi < min(len(x), len(y)) - lo and alike(x[-1 - hi], y[-1 - hi]):
        hi += 1
    ends = [*zip(x[:lo], y[:lo], strict=True)], [*zip(x[len(x) - hi :], y[len(y) - hi :], strict=True)]
    best, middle = align(x[lo : len(x) - hi], y[lo : len(y) - hi])
    pairs = [[(p, q, [(p.kids[0], q.kids[0], ())] if p.kids else ()) for p, q in end] for end in ends]
    return 1 + best + sum(2.5 if p.kids else 1.5 for end in ends for p, q in end), pairs[0] + middle + pairs[1]


def alike(a: Node, b: Node) -> bool:
    """Whether a and b are texts, or blocks of one text, and a has counted what b says."""
    if a.label != b.label:
        return False
    if a.texts is not None:
        return b.key in a.texts
    return len(a.kids) == len(b.kids) == 1 and a.kids[0].texts is not None and b.kids[0].texts is not None and b.kids[0].key in a.kids[0].texts


def align(x: list, y: list) -> tuple[float, list]:
    """The children in order, matched as in match(). Beyond CELLS pairs the same table is filled by whole rows."""
    m, n = len(x), len(y)
    if not m or not n:
        return 0, [*((k, None, ()) for k in x), *((None, k, ()) for k in y)]
    if m * n > CELLS:
        return align_by_rows(x, y)
    w = [[0] * (n + 1) for _ in range(m + 1)]
    sub = {}
    for i in range(m):
        row, above, xi = w[i + 1], w[i], x[i]
        label, texts = xi.label, xi.texts
        only = xi.kids[0].texts if len(xi.kids) == 1 else None
        last = 0
        for j in range(n):
            yj = y[j]
            best = above[j + 1]
            if last > best:
                best = last
            if label == yj.label:
                if texts is not None:
                    s = above[j] + (1.5 if yj.key in texts else 1)
                elif only is not None and len(yj.kids) == 1 and yj.kids[0].texts is not None:
                    # a block of one text against another: nothing to align
                    s = above[j] + (2.5 if yj.kids[0].key in only else 2)
                else:
                    got = sub[i, j] = match(xi, yj)
                    s = above[j] + got[0]
                if s > best:
                    best = s
            row[j + 1] = last = best
    pairs, i, j = [], m, n
    while i and j:
        v = w[i][j]
        if v == w[i - 1][j]:
            i -= 1
            pairs.append((x[i], None, ()))
        elif v == w[i][j - 1]:
            j -= 1
            pairs.append((None, y[j], ()))
        else:
            i, j = i - 1, j - 1
            p, q = x[i], y[j]
            pairs.append((p, q, sub[i, j][1] if (i, j) in sub else [(p.kids[0], q.kids[0], ())] if p.kids else ()))
    pairs += [(k, None, ()) for k in reversed(x[:i])]
    pairs += [(None, k, ()) for k in reversed(y[:j])]
    return w[m][n], pairs[::-1]


def shape(node: Node):
    """Equal for nodes that differ in what they say only."""
    return node.label if node.texts is not None else (node.label, *map(shape, node.kids))


def against(a: Node, b: Node, where: dict, n: int):
    """The greatest numbers of match(a, q) for the n nodes q of b's shape: an array, or a number if they all are alike.

    where has for each text of b, by its id, the nodes (from 0 on) by what they say there.
    """
    if a.label != b.label:
        return 0.0
    if a.texts is not None:
        hit = [where[id(b)][k] for k in a.texts if k in where[id(b)]]
        if not hit:
            return 1.0
        out = np.ones(n)
        out[np.concatenate(hit)] = 1.5
        return out
    more = lambda v, u: max(v, u) if type(v) is type(u) is float else np.maximum(v, u)
    above = [0.0] * (len(b.kids) + 1)
    for p in a.kids:
        row = [0.0]
        for j, q in enumerate(b.kids):
            best = more(above[j + 1], row[j])
            row.append(more(best, above[j] + against(p, q, where, n)) if p.label == q.label else best)
        above = row
    return 1.0 + above[-1]


def align_by_rows(x: list, y: list) -> tuple[float, list]:
    """align() for long lists, with the same result: a child is held against all children of one shape at once.

    Only some rows of the table are kept; the others are made again on the way back.
    """
    m, n = len(x), len(y)
    shapes: dict = {}
    for j, q in enumerate(y):
        shapes.setdefault(shape(q), []).append(j)
    kinds: dict = {}
    for js in shapes.values():
        rep, where = y[js[0]], {}
        for leaf, *keys in zip(leaves(rep), *([v.key for v in leaves(y[j])] for j in js), strict=True):
            at = where[id(leaf)] = {}
            for i, k in enumerate(keys):
                at.setdefault(k, []).append(i)
        kinds.setdefault(rep.label, []).append((rep, js, where))

    def below(above, p):
        s = above[:-1].copy()
        for rep, js, where in kinds.get(p.label, ()):
            s[js] += match(p, rep)[0] if len(js) == 1 else against(p, rep, where, len(js))
        return np.maximum.accumulate(np.append(0.0, np.maximum(above[1:], s)))

    step = math.isqrt(m) + 1
    row, kept = np.zeros(n + 1), []
    for i, p in enumerate(x):
        if i % step == 0:
            kept.append(row)
        row = below(row, p)
    best, pairs, i, j, w = float(row[n]), [], m, n, {}
    while i and j:
        if i - 1 not in w:
            lo = (i - 1) // step
            w = {lo * step: kept[lo]}
            for r in range(lo * step, i):
                w[r + 1] = below(w[r], x[r])
        v = w[i][j]
        if v == w[i - 1][j]:
            i -= 1
            pairs.append((x[i], None, ()))
        elif v == w[i][j - 1]:
            j -= 1
            pairs.append((None, y[j], ()))
        else:
            i, j = i - 1, j - 1
            pairs.append((x[i], y[j], match(x[i], y[j])[1]))
    pairs += [(k, None, ()) for k in reversed(x[:i])]
    pairs += [(None, k, ()) for k in reversed(y[:j])]
    return best, pairs[::-1]


def fold(template: Node, page: Node) -> None:
    """Counts into the template what an aligned tree (a page, or another template) says at its slots.

    What the template lacks is put in at its place, so that it holds the parts of all trees.
    """

    def walk(t, p, pairs):
        t.seen += p.seen
        if t.texts is not None:
            count(t.texts, p.texts)
        if pairs:
            t.kids = [a or b for a, b, _ in pairs]
            for a, b, below in pairs:
                if a and b:
                    walk(a, b, below)

    walk(template, page, match(template, page)[1])
    trim(template)


def count(texts: dict, more: dict) -> None:
    """Adds counts. Beyond TEXTS texts the counts lose what the next one has: at most 1/(TEXTS + 1) of all pages."""
    for k, c in more.items():
        texts[k] = texts.get(k, 0) + c
    if len(texts) > TEXTS:
        less = sorted(texts.values(), reverse=True)[TEXTS]
        kept = {k: c - less for k, c in texts.items() if c > less}
        texts.clear()
        texts.update(kept)


def size(node: Node) -> int:
    return 1 + sum(map(size, node.kids))


def prune(node: Node, least: int) -> None:
    """Without the nodes that fewer than least pages have."""
    node.kids = [k for k in node.kids if k.seen >= least]
    for k in node.kids:
        prune(k, least)


def trim(template: Node) -> None:
    """Drops the rarest nodes of a template that has become too large: their texts stay in the pages."""
    least = 2
    while size(template) > NODES:
        prune(template, least)
        least *= 2


def settle(template: Node, share: float, least: int) -> None:
    """Leaves of the template what its pages say alike: the slots with such a text, and the way to them.

    A text is alike if ``share`` of the pages say it that have the slot. A slot with a sibling of its label
    draws the pages that repeat its text, and others go to the sibling; so all pages that have the parent
    count for it, and for what is below it.
    """

    def walk(node, base, drawn):
        if node.texts is not None:
            node.texts = {k: c for k, c in node.texts.items() if node.seen >= least and c >= share * base}
            return bool(node.texts)
        n = Counter(k.label for k in node.kids)
        node.kids = [k for k in node.kids if (lambda d: walk(k, base if d else k.seen, d))(drawn or n[k.label] > 1)]
        return bool(node.kids)

    walk(template, template.seen, False)


def constant(template: Node | None, page: Node) -> set:
    """Ids of the page's text leaves that the settled template says."""
    out: set = set()

    def walk(pairs):
        for t, p, below in pairs:
            if t and p and p.texts is not None and p.key in t.texts:
                out.add(id(p))
            walk(below)

    if template is not None:
        walk(match(template, page)[1])
    return out


def extract(page: Node, fixed: set) -> str:
    """The article's text: blocks in page order, joined by one space."""

    def find(node, tags):
        if node.skip:
            return []
        if node.tag in tags:
            return [node]
        return [r for k in node.kids for r in find(k, tags)]

    def mass(node):
        """Varying characters outside links."""
        if node.skip:
            return 0
        if node.tag == "#text":
            return 0 if id(node) in fixed else max(0, len(node.text) - 2 * node.links)
        return sum(map(mass, node.kids))

    def gather(node, out, links):
        links = links or node is heavy
        if node.tag == "#text":
            if id(node) not in fixed and (links or len(node.text) > 2 * node.links):
                out.append(node.text)
        elif not node.skip:
            for k in node.kids:
                gather(k, out, links)

    mains = [r for r in find(page, ("main",)) if mass(r)]
    articles = [r for r in find(page, ("article", "main")) if r.tag == "article" and mass(r)]
    heavy, total = page, mass(page)
    if mains and max(map(mass, articles), default=0) > sum(map(mass, mains)):
        regions = [r for r in find(page, ("article", "main")) if mass(r)]
    elif mains:
        regions = mains
    elif 2 * sum(map(mass, articles)) > total:
        regions = articles
    else:
        regions = [page]
        while total:
            most = max((k for k in heavy.kids if k.tag != "#text"), key=mass, default=None)
            if most is None or mass(most) < 0.7 * total:
                break
            heavy = most
    out: list[str] = []
    for r in regions:
        gather(r, out, r is not page)
    return " ".join(out)


def dump(node: Node):
    return [node.label, node.seen, [dump(k) for k in node.kids]] if node.texts is None else [node.seen, *(v for kc in node.texts.items() for v in kc)]


def load(data) -> Node:
    if not isinstance(data[0], str):
        node = Node("#text", "#text")
        node.seen, node.texts = data[0], dict(zip(data[1::2], data[2::2], strict=True))
        node.key = min(node.texts, key=lambda k: (-node.texts[k], k), default=0)
        return node
    node = Node(data[0].partition(".")[0], data[0])
    node.seen, node.kids = data[1], [load(k) for k in data[2]]
    return node


def leaves(node: Node) -> list:
    return [node] if node.texts is not None else [leaf for k in node.kids for leaf in leaves(k)]


def signature(page: Node) -> int:
    """Equal for pages that say the same outside the parts that are skipped in any case."""
    return hashed(" ".join(str(leaf.key) for leaf in leaves(page)))


def host_of(col: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(col).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _trees(batches):
    """A row per host and signature in a batch: of copies, the tree that is first as a string."""
    for b in batches:
        made: dict[tuple[str, int], str] = {}
        for host, page in zip(column(b, "host").to_pylist(), column(b, "html").to_pylist(), strict=True):
            if page:
                tree = parse(page)
                at, flat = (host, signature(tree)), json.dumps(dump(tree))
                made[at] = min(flat, made.get(at, flat))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in made]), pa.array([s % BUCKETS for _, s in made], pa.int32()), pa.array([s for _, s in made], pa.int64()), pa.array(list(made.values()))], names=["host", "bucket", "sig", "tree"])


def _induce(batches):
    """Folds the trees of each host and bucket, copies of a page once; rows come ordered by host, bucket, signature and tree."""
    at, last, tree = None, None, None
    for b in batches:
        out = []
        for h, k, s, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (h, k) != at:
                if at is not None:
                    out.append((*at, json.dumps(dump(tree))))
                at, tree = (h, k), load(json.loads(t))
            elif s != last:
                fold(tree, load(json.loads(t)))
            last = s
        if out:
            yield _partial(out)
    if at is not None:
        yield _partial([(*at, json.dumps(dump(tree)))])


def _partial(rows):
    host, bucket, tree = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(host), pa.array(bucket, pa.int32()), pa.array(tree)], names=["host", "bucket", "tree"])


def _merge(batches, share, least):
    """Folds the partial templates of each host; rows come ordered by host and bucket."""
    host, tree = None, None

    def done(tree):
        settle(tree, share, least)
        return json.dumps(dump(tree))

    for b in batches:
        out = []
        for h, t in zip(column(b, "host").to_pylist(), column(b, "tree").to_pylist(), strict=True):
            if h == host:
                fold(tree, load(json.loads(t)))
            else:
                if host is not None:
                    out.append((host, done(tree)))
                host, tree = h, load(json.loads(t))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], names=["host", "tree"])
    if host is not None:
        yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([done(tree)])], names=["host", "tree"])


def extract_main_text(pages: DataFrame, share: float = 0.6, least: int = 5) -> DataFrame:
    """pages with ``text``, the main text of the whole html ("" if none or if html is null).

    All pages of a host make its template; pages that say the same outside the parts skipped by tag, class,
    id or role are copies and count once, so that a much copied article isn't taken for the template. A
    host's pages are folded in up to BUCKETS parts, by the hash of what they say, before these meet, always
    in the same order: the result doesn't depend on the order or batches of rows. Hosts
    with under ``least`` different pages have no template. A null or odd url is the host "". Blocks nested
    more than DEPTH deep count as parts of the block at that level; lists of blocks of any length are aligned
    so that most nodes match. No pages, no rows; repeated rows have the same text each. Extra columns pass through;
    new ones give way to existing names.
    """
    ws = Workspace(pages.sparkSession, "wrappers")
    host, tree, text, h = fresh(pages, "host", "tree", "text", "html_text")
    base = pages.select(host_of().alias("host"), F.col("html").cast("string").alias("html"))
    trees = base.mapInArrow(_trees, "host string, bucket int, sig long, tree string").repartition("host", "bucket").sortWithinPartitions("host", "bucket", "sig", "tree")
    parts = trees.mapInArrow(_induce, "host string, bucket int, tree string").repartition("host").sortWithinPartitions("host", "bucket")
    templates = ws.save(parts.mapInArrow(lambda it: _merge(it, share, least), "host string, tree string"), "templates").withColumnRenamed("host", host).withColumnRenamed("tree", tree)
    full = pages.withColumns({host: host_of(), h: F.col("html").cast("string")}).join(templates, host, "left")
    loaded: dict = {}

    def run(b):
        out = []
        for key, t, page in zip(column(b, host).to_pylist(), column(b, tree).to_pylist(), column(b, h).to_pylist(), strict=True):
            if not page:
                out.append("")
                continue
            if key not in loaded:
                if len(loaded) > 500:
                    loaded.clear()
                loaded[key] = load(json.loads(t)) if t else None
            p = parse(page)
            out.append(extract(p, constant(loaded[key], p)))
        return [pa.array(out, pa.string())]

    return append(full, run, [T.StructField(text, T.StringType())]).drop(host, tree, h)

