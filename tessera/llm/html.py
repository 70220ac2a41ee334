"""Main text of web pages by union-free regular expressions of each host's pages.

A page is a tree of blocks, in which texts that recur on many of its host's pages
are symbols of their own, as tags are. Runs of like siblings fold into repeated
groups. The trees of a host are aligned one after another into a wrapper: what is
missing on one side becomes optional, what repeats on either is repeated, and text
that differs is a slot. The wrapper counts what its slots hold, and its own shape
decides which of them are main text: not those of links, not constant text, and not
what lies outside the subtree that holds most of the varying text. Each page is then
matched to its host's wrapper, and the texts in main slots are its main text.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, keep, lookup, slices
from .urls import host_of as spark_host

# Fixed values of HTML: elements without content, with raw text, embedded, and inline ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
EMBEDDED = frozenset("noscript template svg math object audio video canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: An opening tag of the key closes an open one of these, up to the nearest of the barriers.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIERS = frozenset("ul ol dl table tbody thead tfoot select menu".split())
#: Opening one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("article main section div td th body li blockquote aside nav header footer form figure".split())
#: Elements, and words in class, id or role, whose text is not the article's.
OUTSIDE = frozenset("nav aside footer form button select dialog menu fieldset legend datalist output".split()) | EMBEDDED
OUTSIDE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising alert alerts banner banners breadcrumb breadcrumbs byline
    carousel comment comments consent contentinfo cookie cookies copyright dialog disclaimer disqus feedback
    footer form gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices
    pager pagination popup popups privacy promo promoted promotion recommended related replies reply reviews
    search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription
    tagcloud tags toolbar widget widgets""".split()
)
MAIN = frozenset(["article", "main"])

# A quote counts only after `=`, and only if it is closed; else it is a sign like any other.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=)*+)(?:>|\Z)|(<?[^<]+|<)", re.S)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACES = re.compile(r"\s+")
#: Words of a name in class, id or role: all of them must be known ones.
WORD = re.compile(r"[a-z]+")
#: Depth of a tree. A block nested deeper is a child of the one at this depth, and its
#: signature holds each different signature of the blocks in between.
DEEPEST = 150
#: A text is constant if it is on this share of a host's pages, and on so many of them.
CONSTANT, SEEN = 0.3, 3
#: Share of the varying text under a block, over which the block alone may hold the article.
MOST = 0.75
#: Bits of an alignment's table, over which it is cut in two.
TABLE = 1 << 28


@lru_cache(maxsize=50_000)
def signature(name: str, attrs: str) -> str:
    """Element name with the words of class, id and role that tell its purpose. Names
    count as a whole: of `cookie-notice` both words are known, of `no-sidebar` one."""
    if not attrs or "=" not in attrs:
        return name
    words: set[str] = set()
    for m in NAMES.finditer(attrs):
        for token in (m[2] or m[3] or m[4] or "").lower().split():
            if token in MAIN:
                words.add(token)
            elif OUTSIDE_WORDS.issuperset(parts := WORD.findall(token)):
                words.update(parts)
    return ".".join([name, *sorted(words & OUTSIDE_WORDS), *sorted(words & MAIN)])


def blocks(html: str | None) -> tuple[list, list[tuple[str, int]]]:
    """The block tree as nested [signature, children], where a text is its number, and in
    page order each text with its characters in links. Inline elements belong to their
    block. Unclosed elements close as browsers do it; an embedded one that is never
    closed is passed over, so that it hides nothing."""
    tree: list = ["", []]
    stack: list[tuple[str, list]] = [("", tree)]
    deep: list[str] = []  # signatures over the open block, from DEEPEST on
    out: list[tuple[str, int]] = []
    run: list[str] = []
    links, in_link = 0, False
    source, at = html or "", 0
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal links
        if run:
            text = SPACES.sub(" ", "".join(run)).strip(" ")
            if text:
                stack[-1][1][1].append(len(out))
                out.append((text, links))
            run.clear()
        links = 0

    def close(names: set[str] | frozenset[str], barriers: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                flush()
                del stack[k:]
                del deep[max(0, len(stack) - DEEPEST - 1) :]
                return
            if stack[k][0] in barriers:
                return

    def end_of(name: str) -> re.Match | None:
        if name in unclosed:
            return None
        found = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
        if not found:
            unclosed.add(name)
        return found

    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            break
        at = m.end()
        if m[4] is not None:
            text = entities.unescape(m[4]) if "&" in m[4] else m[4]
            run.append(text)
            if in_link:
                links += len(text.strip())
            continue
        if m[2] is None:
            continue
        name = m[2].lower()
        shut = m[0].endswith("/>")
        if m[1]:
            if name == "a":
                in_link = False
            elif name == "p" and not any(s[0] == "p" for s in stack):
                flush()
            elif name not in INLINE and name not in VOID:
                close({name}, frozenset())
            continue
        if name == "a":
            in_link = True
        elif name == "br" or name == "wbr":
            run.append(" " if name == "br" else "")
        elif name in RAW:
            if not shut or name in ("script", "style"):
                if end := end_of(name):
                    at = end.end()
                elif name in ("script", "style"):
                    at = len(source)
        elif name in VOID:
            if name == "hr":
                flush()
        elif name not in INLINE and not (name in EMBEDDED and (shut or not end_of(name))):
            flush()
            if name in ENDS_P:
                close({"p"}, SECTIONS - {"li"} | BARRIERS)
            if name in CLOSES:
                close(CLOSES[name], BARRIERS)
            if not shut:
                sig = signature(name, m[3])
                node: list = [sig, []]
                if len(stack) > DEEPEST:
                    deep.append(sig)
                    node[0] = "/".join(dict.fromkeys(deep))
                    stack[DEEPEST][1][1].append(node)
                else:
                    stack[-1][1][1].append(node)
                stack.append((name, node))
                in_link = False
    flush()
    return tree, out


# -- wrappers: [symbol, children, optional, repeated, characters, characters in links] -----
#
# The symbol of a text is "#", or "#=" and its digest if it is constant; that of a block
# is its signature, and for a block of one text only also the text's symbol.


def digest(text: str) -> int:
    """What tells texts of a host apart."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def symbols(node: list, text_symbols: list[str]) -> list:
    """The tree as nested (symbol, children, text number or -1), from the bottom up."""
    kids = [("#" if not text_symbols else text_symbols[c], (), c) if isinstance(c, int) else symbols(c, text_symbols) for c in node[1]]
    only = kids[0][0] if len(kids) == 1 and kids[0][2] >= 0 else "#" if kids and all(k[2] >= 0 for k in kids) else ""
    return (node[0] + only, kids, -1)


def folded(tree: list, texts: list[tuple[str, int]] = (), text_symbols: list[str] = ()) -> list:
    """A page's tree as an expression, runs of like siblings (or of like groups of
    siblings) folded. The root's symbol is empty."""

    def expr(node: tuple) -> list:
        symbol, kids, text = node
        if text >= 0:
            return [symbol, [], False, False, len(texts[text][0]) if texts else 0, texts[text][1] if texts else 0]
        return [symbol, fold([expr(k) for k in kids]), False, False, 0, 0]

    symbol, kids, _ = symbols(tree, list(text_symbols))
    return ["", fold([expr(k) for k in kids]), False, False, 0, 0]


def alike(a: list, b: list) -> bool:
    """Whether two siblings may be one repeated item: same symbol, and at least half of
    their children's symbols in common."""
    if a[0] != b[0]:
        return False
    x, y = {c[0] for c in a[1]}, {c[0] for c in b[1]}
    return 2 * len(x & y) >= len(x | y)


def fold(items: list[list], widest: int = 4) -> list[list]:
    """Adjacent like stretches of 1 to `widest` siblings become one, its members repeated."""
    out: list[list] = []
    for x in items:
        out.append(x)
        for w in range(1, widest + 1):
            if len(out) >= 2 * w and all(alike(a, b) for a, b in zip(out[-2 * w : -w], out[-w:])):
                out[-2 * w :] = [merged(a, b, True) for a, b in zip(out[-2 * w : -w], out[-w:])]
                break
    return out


def merged(a: list, b: list, repeated: bool = False) -> list:
    return [a[0], aligned(a[1], b[1]), a[2] or b[2], a[3] or b[3] or repeated, a[4] + b[4], a[5] + b[5]]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence. Rows of the table of lengths are the bits
    of whole numbers; a table that would be too large is cut in two, exactly."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    if lead:
        return [(i, i) for i in range(lead)] + [(i + lead, j + lead) for i, j in common(a[lead:], b[lead:])]
    n, m = len(a), len(b)
    if not n or not m:
        return []
    if n > 1 and n * m > TABLE:
        half = n // 2
        before, after = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])[::-1]
        cut = max(range(m + 1), key=lambda j: before[j] + after[j])
        return common(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in common(a[half:], b[cut:])]
    rows = list(_rows(a, b))
    out, i, j = [], n, m
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """After each item of `a`: bit j is 0 where one more item of `b` lengthens the match."""
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    yield row
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(a: list[str], b: list[str]) -> list[int]:
    """Length of the longest common subsequence of `a` with each beginning of `b`."""
    row, out = 0, [0]
    for row in _rows(a, b):
        pass
    for j in range(len(b)):
        out.append(out[-1] + (not row >> j & 1))
    return out


def aligned(a: list[list], b: list[list]) -> list[list]:
    """Two lists of siblings aligned by longest common subsequence of symbols; what has
    no partner becomes optional, or repeats its neighbour of the same kind."""
    if len(a) == len(b) and all(x[0] == y[0] for x, y in zip(a, b)):
        return [merged(x, y) for x, y in zip(a, b)]
    out: list[list] = []

    def alone(x: list) -> None:
        if out and alike(out[-1], x):
            out[-1] = merged(out[-1], x, True)
        else:
            out.append([x[0], x[1], True, *x[3:]])

    i = j = 0
    for p, q in [*common([x[0] for x in a], [y[0] for y in b]), (len(a), len(b))]:
        for x in [*a[i:p], *b[j:q]]:
            alone(x)
        if p < len(a):
            out.append(merged(a[p], b[q]))
        i, j = p + 1, q + 1
    return fold(out)


def expression(node: list) -> str:
    """A wrapper in writing: `(...)` groups, `?` optional, `+` repeated, `#` a text slot,
    `=` constant text."""
    if node[0].startswith("#"):
        inner = node[0][1:2] or "#"
    else:
        inner = node[0].partition("#")[0] + "(" + " ".join(map(expression, node[1])) + ")"
    return inner + "?" * node[2] + "+" * node[3]


# -- which slots are main text ---------------------------------------------------------------


def outside(path: str, spared: frozenset[str] = frozenset()) -> str:
    """The block, as the start of `path`, that is not the article by its element or
    names; empty if there is none. Blocks in `spared` do not count. A `header` inside
    the article is the article's own."""
    main = False
    steps = path.split("/")
    for k, step in enumerate(steps):
        name, *words = step.split(".")
        out = name in OUTSIDE or name == "header" and not main
        out = out or name not in ("html", "body") and any(w in OUTSIDE_WORDS and w not in MAIN for w in words)
        if out and (at := "/".join(steps[: k + 1])) not in spared:
            return at
        main = main or name in MAIN or bool(MAIN & set(words))
    return ""


def inside(path: str) -> bool:
    return any(MAIN & set(step.split(".")) for step in path.split("/"))


#: What a slot is: of main text, with constant text, in the block that holds the article.
IS_MAIN, IS_FIXED, IS_HELD = 1, 2, 4


def judged(wrapper: list) -> list:
    """The wrapper as nested [symbol, children] for matching, a text as [symbol, verdict].

    A slot is main unless it is mostly links that no article or main element holds.
    The block that holds the article is found by going down from the root while one
    child, not repeated and with blocks of its own, has over `MOST` of the varying text;
    headings passed on the way belong to it.
    """

    def measure(node: list, path: str) -> tuple:
        kids = []
        total = 0
        for c in node[1]:
            if c[0].startswith("#"):
                held = inside(path)
                main = held or c[5] * 2 <= c[4]
                fixed = c[0] != "#"
                kids.append((c, IS_MAIN * main + IS_FIXED * fixed, None))
                total += 0 if fixed or not main or held or outside(path) else c[4] - c[5]
            else:
                sub = measure(c, f"{path}/{c[0].partition('#')[0]}")
                kids.append(sub)
                total += sub[1]
        return node, total, kids

    def shown(of: tuple, held: bool) -> list:
        node, value, kids = of
        if kids is None:
            return [node[0], value | IS_HELD * held]
        over = any(of is x for x in passed)
        return [node[0], [shown(k, held or k is best or over and k[0][0].partition("#")[0].partition(".")[0] in HEADINGS) for k in kids]]

    root = measure(wrapper, "")
    best, passed = root, []
    while True:
        boxes = [k for k in best[2] if k[2] is not None]
        heavy = max(boxes, key=lambda k: k[1], default=None)
        if heavy is None or heavy[1] <= MOST * best[1] or heavy[0][3] or not any(k[2] is not None for k in heavy[2]):
            break
        passed.append(best)
        best = heavy
    return shown(root, best is root)


def match(wrapper: list, tree: tuple, seen: dict) -> list[tuple[str, int]]:
    """For each text of a page, in order, its path and the verdict of its slot. `tree` is
    of `symbols`; `seen` remembers alignments of lists of siblings."""
    out: list[tuple[str, int]] = []

    def go(node: list | None, page: tuple, path: str) -> None:
        kids = page[1]
        if node is None:
            places: list = [-1] * len(kids)
        else:
            key = (id(node), tuple(k[0] for k in kids))
            if (places := seen.get(key)) is None:
                seen[key] = places = matched([k[0] for k in kids], [c[0] for c in node[1]])
        for kid, k in zip(kids, places):
            if kid[2] >= 0:
                out.append((path, node[1][k][1] if k >= 0 else IS_MAIN))
            else:
                go(node[1][k] if k >= 0 else None, kid, f"{path}/{kid[0].partition('#')[0]}")

    go(wrapper, tree, "")
    return out


def matched(page: list[str], wrapper: list[str]) -> list[int]:
    """For each of a page's siblings the place in the wrapper: by longest common
    subsequence, the others to the nearest of their symbol, -1 if there is none."""
    if page == wrapper:
        return list(range(len(page)))
    out = [-1] * len(page)
    for i, j in common(page, wrapper):
        out[i] = j
    where: dict[str, list[int]] = {}
    for j, y in enumerate(wrapper):
        where.setdefault(y, []).append(j)
    near = 0
    for i, x in enumerate(page):
        if out[i] < 0 and x in where:
            out[i] = min(where[x], key=lambda j: abs(j - near))
        near = max(near, out[i])
    return out


Text = tuple[str, str, int, int]  # path, text, characters in links, verdict


def spared(texts: list[Text]) -> frozenset[str]:
    """Blocks of a page that are outside by name and yet hold its article. While no
    article or main element lies elsewhere: such a block if it has one that is longer
    than the text elsewhere, or if it has most of the page's text. Links and constant
    text do not count."""
    out: frozenset[str] = frozenset()
    total = sum(len(text) - links for _, text, links, _ in texts)
    while True:
        held: dict[str, list[int]] = {}
        plain = 0
        for path, text, links, verdict in texts:
            if not verdict & IS_MAIN:
                continue
            if at := outside(path, out):
                if not verdict & IS_FIXED:
                    sums = held.setdefault(at, [0, 0])
                    sums[0] += len(text) - links
                    sums[1] += (len(text) - links) * inside(path[len(at) - len(at.rsplit("/", 1)[1]) :])
            elif inside(path):
                return out
            else:
                plain += len(text) - links
        found = [(most, at) for at, (all_, article) in held.items() if (most := max(article * (article > plain), all_ * (2 * all_ > total)))]
        if not found:
            return out
        out |= {max(found)[1]}


def chosen(texts: list[Text]) -> list[str]:
    """A page's main texts, without those outside: those in an article or main element if
    it has any; else those that vary between pages, in the block that holds the article.
    Constant text that is longer than the page's other text is an article that copies
    repeat; and a block with less than half of a page's text does not hold its article."""
    out = spared(texts)
    own = [t for t in texts if t[3] & IS_MAIN and not outside(t[0], out)]
    if any(inside(t[0]) for t in own):
        return [t[1] for t in own if inside(t[0])]
    size = lambda of: sum(len(t[1]) for t in of)
    for which in (lambda t: not t[3] & IS_FIXED, lambda t: t[3] & IS_HELD):
        part = [t for t in own if which(t)]
        if 2 * size(part) >= size(own):
            own = part
    return [t[1] for t in own]


# -- in Spark ----------------------------------------------------------------

#: Distinct trees or bytes of them that a task holds before it hands them on.
HELD, HELD_BYTES = 20_000, 64 << 20
#: Hosts whose wrappers a task keeps ready, and alignments it remembers.
READY, REMEMBERED = 256, 200_000


def parsed(pages: DataFrame, ident: str, url: str, html: str) -> DataFrame:
    """(ident, url, host, tree, texts, links, digests, page) of every row: the tree as JSON,
    texts in order with their characters in links and digests, and a digest of all."""
    kind = pages.schema[ident].dataType.simpleString()
    rows = pages.select(F.col(ident).alias("ident"), F.col(url).alias("url"), spark_host(F.col(url)).alias("host"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols: list[list] = [[] for _ in range(5)]
            for h in b.column(3).to_pylist():
                tree, texts = blocks(h)
                digests = [digest(t) for t, _ in texts]
                for col, v in zip(cols, (json.dumps(tree, separators=(",", ":")), [t for t, _ in texts], [n for _, n in texts], digests, digest(json.dumps(digests)))):
                    col.append(v)
            kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["ident", "url", "host", "tree", "texts", "links", "digests", "page"])

    return rows.mapInArrow(run, f"ident {kind}, url string, host string, tree string, texts array<string>, links array<int>, digests array<long>, page long")


def constants(pages: DataFrame) -> DataFrame:
    """(host, constants): digests of the texts that are on `SEEN` different pages of a host
    and on `CONSTANT` of all of them. A host has no more than its pages' mean number of
    texts over that share. Counts are summed by text before they meet by host."""
    different = pages.select("host", "page", "digests").groupBy("host", "page").agg(F.first("digests").alias("digests"))
    counts = different.select("host", F.explode(F.array_distinct("digests")).alias("text")).groupBy("host", "text").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN)
    totals = different.groupBy("host").agg(F.count("*").alias("pages"))
    often = counts.join(totals, "host").where(F.col("n") >= CONSTANT * F.col("pages"))
    return often.groupBy("host").agg(F.sort_array(F.collect_list("text")).alias("constants"))


def _symbols_of(digests: list[int], known: set[int]) -> list[str]:
    return [f"#={d & 0xFFFFFFFFFFFFFFFF:x}" if d in known else "#" for d in digests]


def shapes(pages: DataFrame) -> DataFrame:
    """(host, shape, wrapper): folded trees as JSON, those of one shape summed within
    each task. `pages` has the columns of `parsed` and constants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            keys = list(zip(*held)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(list(keys[0]), pa.string()), pa.array(list(keys[1]), pa.int64()), pa.array([json.dumps(t, separators=(",", ":")) for t in held.values()], pa.string())], names=["host", "shape", "wrapper"])

        for b in batches:
            for host, tree, texts, links, digests, known in zip(*(b.column(c).to_pylist() for c in ("host", "tree", "texts", "links", "digests", "constants"))):
                node = folded(json.loads(tree), list(zip(texts, links)), _symbols_of(digests, set(known or ())))
                key = (host, digest(expression_of(node)))
                if key in held:
                    held[key] = merged(held[key], node)
                else:
                    held[key] = node
                    size += len(tree)
                if len(held) > HELD or size > HELD_BYTES:
                    yield out()
                    held.clear()
                    size = 0
        yield out()

    return pages.select("host", "tree", "texts", "links", "digests", "constants").mapInArrow(run, "host string, shape long, wrapper string")


def expression_of(node: list) -> str:
    """What tells shapes apart: the expression with its symbols, without sums."""
    return node[0] + "(" + " ".join(map(expression_of, node[1])) + ")" + "?" * node[2] + "+" * node[3]


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees sorted by host and salt: one wrapper for each, aligned as they come."""
    now, wrapper = None, None

    def out() -> pa.RecordBatch:
        text = json.dumps(wrapper, separators=(",", ":"))
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([digest(text)], pa.int64()), pa.array([text], pa.string())], names=["host", "shape", "wrapper"])

    for b in batches:
        for host, salt, item in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            tree = json.loads(item)
            if (host, salt) != now:
                if wrapper is not None:
                    yield out()
                now, wrapper = (host, salt), tree
            else:
                wrapper = merged(wrapper, tree)
    if wrapper is not None:
        yield out()


def wrappers(trees: DataFrame, share: int = 256) -> DataFrame:
    """(host, wrapper): each host's expression as JSON, of rows (host, shape, wrapper).

    Trees are aligned as a stream that keeps only the wrapper. A host with over
    `share` distinct trees is cut into shares of about that many, whose wrappers are
    aligned in the same way, until one is left: no task holds a large host alone.
    """
    # Tasks that saw trees of one shape gave it once each: these are one first, with their
    # sums added, so that shares don't depend on how pages are dealt over tasks.
    same = trees.repartition("host", "shape").sortWithinPartitions("host", "shape", "wrapper")
    whole = keep(same.select("host", F.col("shape").alias("salt"), "wrapper").mapInArrow(_align, "host string, shape long, wrapper string"), "shapes")
    while True:
        counts = whole.groupBy("host").agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n").alias("n")).first()["n"] or 0
        large = counts.where(F.col("n") > share).select("host", F.ceil(F.col("n") / share).alias("shares"))
        salted = whole.join(large, "host", "left") if most > share else whole.withColumn("shares", F.lit(1))
        salted = salted.withColumn("salt", F.pmod(F.xxhash64("shape"), F.coalesce("shares", F.lit(1))))
        dealt = salted.repartition("host", "salt").sortWithinPartitions("host", "salt", "shape", "wrapper")
        joined = dealt.select("host", "salt", "wrapper").mapInArrow(_align, "host string, shape long, wrapper string")
        if most <= share:
            return joined.select("host", "wrapper")
        before, whole = whole, keep(joined, "shares")
        drop(before)


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [json.dumps(judged(json.loads(w)), separators=(",", ":")) for w in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["host", "wrapper"])


def matcher(ready: dict, seen: dict) -> Callable[[str, str, list, list, list, list], str]:
    """A function from a parsed page, its host's wrapper and constants to its main text."""

    def main_text(host: str, wrapper: str, tree: str, texts: list[str], links: list[int], digests: list[int], known: list[int] | None) -> str:
        if len(seen) > REMEMBERED or host not in ready and len(ready) >= READY:
            ready.clear()
            seen.clear()
        if host not in ready:
            ready[host] = json.loads(wrapper)
        slots = match(ready[host], symbols(json.loads(tree), _symbols_of(digests, set(known or ()))), seen)
        return " ".join(chosen([(path, text, n, verdict) for (path, verdict), text, n in zip(slots, texts, links)]))

    return main_text


def extract(pages: DataFrame, ident: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(ident, url, text, n_chars) of every row; n_chars counts code points.

    Blocks' texts are joined by one space, with references decoded and each run of
    white space one space. Null or empty html, and pages without main text, give an
    empty text. Pages with a null url, or without `://`, share the empty host.
    Unclosed, deeply nested and very wide pages are read like any other; what follows
    an unclosed script or style belongs to it, as in browsers.
    Repeated rows each give a row; an empty table gives none; further columns are
    ignored.
    """
    rows = keep(parsed(pages, ident, url, html), "parsed")
    known = keep(constants(rows), "constants")
    marked = lookup(rows, known, "host")
    final = wrappers(shapes(marked)).mapInArrow(_verdicts, "host string, wrapper string")
    final = keep(final.join(known, "host", "left"), "wrappers")
    kind = pages.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        main_text = matcher({}, {})
        for b in slices(batches):
            texts = [main_text(*page) for page in zip(*(b.column(c).to_pylist() for c in ("host", "wrapper", "tree", "texts", "links", "digests", "constants")))]
            yield pa.RecordBatch.from_arrays([b.column("ident"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["ident", "url", "text", "n_chars"])

    both = lookup(rows, final, "host").select("ident", "url", "host", "tree", "texts", "links", "digests", "wrapper", "constants")
    return both.mapInArrow(run, f"ident {kind}, url string, text string, n_chars long").withColumnsRenamed({"ident": ident, "url": url})
