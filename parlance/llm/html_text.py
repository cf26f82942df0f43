"""Main text of web pages, by differencing each page with the pages of the nearest URLs.

Pages are sorted by host and path over all partitions (a range shuffle: a host of any size spans
as many tasks as it needs). A page is paired with whichever of its neighbours shares the longer URL
path, copies of it passed over; the text lines of both are aligned by their longest common
subsequence, and a shared line is template. Templates also rotate (other menu entries, another
notice on every page), so shared lines are not all of them. What is left is therefore weighed by
the place where it stands, the chain of containers around it: over the page and the two different
pages on either side, the place with the most text that is not shared is the content, and lines
elsewhere are template.

The markup is a prior on that choice: text inside ``article`` or ``main`` weighs more, text inside
menus, headers, footers, sidebars, notices, adverts, forms and comment sections less, and the
difference overrules it where the place it favours has next to nothing that differs. Inside an
``article`` that won, shared lines stay, as the neighbour may carry the same article.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import groupby

import numpy as np

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import small_batches

# HTML's element names by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
SKIPPED = frozenset("aside button canvas dialog footer form head header iframe input menu nav noscript object select svg template textarea title".split())
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title")
CLOSES_P = BLOCK - {"body", "head", "html", "option", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "legend"}
SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
NOISE_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer header masthead menu modal nav navbar navigation"
    " newsletter notice notices pager pagination popup promo promotion related replies reply respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
NOT_ITSELF = frozenset("has is js no show with without".split())  # "has-sidebar" is no sidebar
_TOKEN = re.compile(r"<!--|<([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|</([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>")
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}

CONTAINERS = frozenset("article aside body center details dialog div dl fieldset footer form header main menu nav ol section table td th ul".split())
HEADINGS = frozenset("h1 h2 h3 hgroup".split())

NEUTRAL, ARTICLE, NOISE, BODY = 0, 1, 2, 3
#: How much a character that differs counts, by what the markup says of it.
PRIOR = {NEUTRAL: 1.0, ARTICLE: 64.0, NOISE: 1 / 64, BODY: 8.0}
COPY = 0.95  # of the characters of the longer of two pages in lines that both have: copies
WINDOW = 2  # different pages on either side whose places are weighed with the page's own
REACH = WINDOW + 1  # their partners are one further
DEEPEST = 64  # containers that a place tells apart
FAN = 64  # partitions whose ends one task of the second step sees
TRACED = 1 << 27  # bits that an alignment holds at once

Line = tuple[int, str, str]  # what the markup says, place, text


def is_noise(said: str) -> bool:
    """Whether a class, id or role names something that is no content."""
    parts = (re.split(r"[-_]+", token) for token in said.lower().split())
    return any(p[0] not in NOT_ITSELF and not NOISE_WORDS.isdisjoint(p) for p in parts)


def lines(page: str) -> list[Line]:
    """The text blocks of a page in order, with what the markup says of each and the place of each.

    Tolerates unclosed and stray tags. Scripts, styles and comments are no lines; character
    references are decoded; white space becomes single spaces; blocks without text are left out,
    but for one empty line where an ``article`` or ``main`` begins.
    """
    out: list[Line] = []
    buffer: list[str] = []
    stack: list[tuple[str, int, str]] = []  # name, and the class and place that hold inside

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append((*(stack[-1][1:] if stack else (NEUTRAL, "")), text))

    def pop_to(depth: int) -> None:
        flush()
        del stack[depth:]

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        if m.group(0) == "<!--":
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
        elif m.group(1):
            name, attrs = m.group(1).lower(), m.group(2)
            if name in ("script", "style"):
                end = _ENDS[name].search(page, at)
                at = end.end() if end else n
                continue
            if name == "br":
                buffer.append(" ")
                continue
            if name in BLOCK:
                flush()
            if name in VOID:
                continue
            if name in CLOSES_P:
                for d in range(len(stack) - 1, -1, -1):
                    if stack[d][0] == "p":
                        pop_to(d)
                        break
                    if stack[d][0] in BLOCK:
                        break
            if name in SAME:
                for d in range(len(stack) - 1, -1, -1):
                    if stack[d][0] == name:
                        pop_to(d)
                        break
                    if stack[d][0] in SAME[name]:
                        break
            kind, place = stack[-1][1:] if stack else (NEUTRAL, "")
            begins = False
            said = " ".join(a or b or c for a, b, c in _ATTR.findall(attrs)) if attrs else ""
            if name in CONTAINERS:
                if place.count("/") < DEEPEST:
                    place += f"/{name}.{said[:64]}" if said else f"/{name}"
            elif name in HEADINGS:
                place += ":h"
            if kind != NOISE and name not in ("html", "body"):
                if name in SKIPPED or is_noise(said) or (attrs and _HIDDEN.search(attrs)):
                    kind = NOISE
                elif name == "article":
                    kind, begins = ARTICLE, True
                elif kind != ARTICLE and (name == "main" or "main" in said.lower().split()):
                    kind, begins = BODY, True
            if name in RAW:
                end = _ENDS[name].search(page, at)
                at = end.end() if end else at
                continue
            if not attrs.endswith("/") or name in BLOCK:
                if kind != (stack[-1][1] if stack else NEUTRAL):
                    flush()
                stack.append((name, kind, place))
                if begins:
                    out.append((kind, place, ""))
        elif m.group(3):
            name = m.group(3).lower()
            if name in BLOCK:
                flush()
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == name:
                    if name in BLOCK or stack[d][1] != (stack[d - 1][1] if d else NEUTRAL):
                        pop_to(d)
                    else:
                        del stack[d:]
                    break
                if stack[d][0] in BLOCK and name not in BLOCK:
                    break
    flush()
    return out


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    """The length of the longest common subsequence of x[:i] and y, for every i."""
    v = full = (1 << len(x)) - 1
    for u in _masks(x, y):
        u &= v
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(x) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(x)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _masks(x: list[int], y: list[int]) -> Iterator[int]:
    """For each of ``y`` the bits of its places in ``x``; frequent ones are kept, the others made when they come."""
    places: dict[int, list[int]] = {}
    for i, line in enumerate(x):
        places.setdefault(line, []).append(i)
    held: dict[int, int] = {}
    for line in y:
        at = places.get(line, ())
        if len(at) < 64:
            yield sum(1 << i for i in at)
            continue
        if line not in held:
            bits = np.zeros(len(x), np.uint8)
            bits[at] = 1
            held[line] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        yield held[line]


def _common(x: list[int], y: list[int]) -> Iterator[tuple[int, int]]:
    """One longest common subsequence as pairs of places; bit-parallel, in halves where it would hold over ``TRACED`` bits."""
    if not x or not y:
        return
    if len(x) * len(y) > TRACED and len(y) > 1:
        mid = len(y) // 2
        i = int((_lengths(x, y[:mid]) + _lengths(x[::-1], y[mid:][::-1])[::-1]).argmax())
        yield from _common(x[:i], y[:mid])
        yield from ((i + p, mid + q) for p, q in _common(x[i:], y[mid:]))
        return
    v = full = (1 << len(x)) - 1
    rows = [full]
    for u in _masks(x, y):
        u &= v
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    found, i, j = [], len(x), len(y)
    length = lambda i, j: i - (rows[j] & ((1 << i) - 1)).bit_count()
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            found.append((i, j))
        elif length(i - 1, j) >= length(i, j - 1):
            i -= 1
        else:
            j -= 1
    yield from reversed(found)


def aligned(a: list[str], b: list[str]) -> tuple[list[int], list[int]]:
    """The places in ``a`` and in ``b`` of one longest common subsequence of lines, in order.

    Lines that only one side has are left out first. Memory is bounded whatever the number of lines.
    """
    head, least = 0, min(len(a), len(b))
    while head < least and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < least - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    number = {line: k for k, line in enumerate(set(a[head : len(a) - tail]) & set(b[head : len(b) - tail]))}
    at, bt = ([i for i in range(head, len(s) - tail) if s[i] in number] for s in (a, b))
    pairs = [(at[i], bt[j]) for i, j in _common([number[a[i]] for i in at], [number[b[j]] for j in bt])]
    ends = [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    both = [*((k, k) for k in range(head)), *pairs, *ends]
    return [i for i, _ in both], [j for _, j in both]


def alike(a: str, b: str) -> int:
    """The length of the common prefix of two paths."""
    n = 0
    for p, q in zip(a, b, strict=False):
        if p != q:
            break
        n += 1
    return n


def copies(a: list[Line], b: list[Line]) -> bool:
    """Whether two pages have the same lines, but for a few characters."""
    if a == b:
        return True
    x, y = Counter(t for _, _, t in a), Counter(t for _, _, t in b)
    size = max(sum(len(t) * n for t, n in c.items()) for c in (x, y))
    return sum(len(t) * n for t, n in (x & y).items()) >= COPY * size


@dataclass
class Page:
    id: object
    url: str | None
    host: str
    path: str
    lines: list[Line]
    asked: bool = True
    seq: int = 0


def shared_by(page: Page, other: Page | None) -> tuple[set[int], set[int]]:
    """The numbers of the lines that two pages share, in either."""
    if other is None:
        return set(), set()
    x, y = ([k for k, line in enumerate(p.lines) if line[2]] for p in (page, other))
    i, j = aligned([page.lines[k][2] for k in x], [other.lines[k][2] for k in y])
    return {x[k] for k in i}, {y[k] for k in j}


def masses(own: list[Line], shared: set[int]) -> Counter:
    """The characters that are not shared, by what the markup says and place."""
    out: Counter = Counter()
    for k, (kind, place, text) in enumerate(own):
        out[kind, place] += 0 if k in shared else len(text)
    return out


def content(own: list[Line], shared: set[int], around: Iterable[Counter] = ()) -> str:
    """The text of a page, given the lines that it shares with its partner and the masses of the pages around."""
    mine = masses(own, shared)
    mass = Counter(mine)
    for other in around:
        mass.update({key: n for key, n in other.items() if key in mine})
    sides = [key for key in mine if key[0] != NOISE and not key[1].endswith(":h")] or [key for key in mine if key[0] != NOISE]
    if not sides:
        return ""
    places = [key for key in mine if not key[1].endswith(":h")]
    kind, root = max([*places, *sides], key=lambda key: (mass[key] * PRIOR[key[0]], PRIOR[key[0]], key))
    inside = [k for k, line in enumerate(own) if line[0] == kind and line[2]]
    if kind in (ARTICLE, BODY):
        differ = [k for k in inside if k not in shared]
        # most of it shared: a text that both pages carry, not their template
        whole = kind == ARTICLE or 2 * sum(len(own[k][2]) for k in differ) < sum(len(own[k][2]) for k in inside)
        kept = inside if whole else differ
    else:
        under = lambda place: place == root or place.startswith((f"{root}/", f"{root}:")) or place.endswith(":h")
        kept = [k for k in inside if k not in shared and under(own[k][1])]
    return "\n\n".join(own[k][2] for k in kept)


@dataclass
class Run:
    """Copies in a row, and what their first page shares with the different pages before and after."""

    pages: list[Page]
    before: Run | None = None
    after: Run | None = None
    with_before: set[int] = field(default_factory=set)
    with_after: set[int] = field(default_factory=set)

    def partner(self, page: Page) -> Run | None:
        sides = [r for r in (self.before, self.after) if r]
        return max(sides, key=lambda r: alike(page.path, r.pages[0].path), default=None)

    def shared(self, page: Page) -> tuple[Run | None, set[int]]:
        other = self.partner(page)
        if other and page.lines != self.pages[0].lines:
            return other, shared_by(page, other.pages[0])[0]
        return other, self.with_before if other is self.before else self.with_after

    def mass(self) -> Counter:
        if not hasattr(self, "_mass"):
            self._mass = masses(self.pages[0].lines, self.shared(self.pages[0])[1])
        return self._mass


def runs(pages: Iterable[Page]) -> Iterator[Run]:
    """Pages in order as runs of copies, linked inside their host."""
    last: Run | None = None
    for p in pages:
        if last and p.host == last.pages[0].host and copies(last.pages[0].lines, p.lines):
            if p.lines == last.pages[0].lines:
                p.lines = last.pages[0].lines  # once in memory
            last.pages.append(p)
            continue
        if last:
            yield last
        last = Run([p])
    if last:
        yield last


def linked(found: Iterable[Run]) -> Iterator[Run]:
    """The runs of one host, with what neighbours share."""
    last: Run | None = None
    for run in found:
        if last:
            last.after, run.before = run, last
            last.with_after, run.with_before = shared_by(last.pages[0], run.pages[0])
        yield run
        last = run


def judged(run: Run, around: list[Run]) -> Iterator[tuple]:
    """(page_id, url, text, n_chars, partner_id, n_lines, n_shared) of each page asked for, from the masses of the runs around."""
    votes = [r.mass() for r in around]
    for p in run.pages:
        if p.asked:
            other, shared = run.shared(p)
            text = content(p.lines, shared, votes)
            yield p.id, p.url, text, len(text), other.pages[0].id if other else None, sum(1 for line in p.lines if line[2]), len(shared)


class _Ending:
    """Pages as they come, and whether they have ended."""

    def __init__(self, pages: Iterable[Page]) -> None:
        self.pages, self.ended = pages, False

    def __iter__(self) -> Iterator[Page]:
        yield from self.pages
        self.ended = True


def decided(pages: Iterable[Page], open_left: bool, open_right: bool, edges: bool) -> Iterator[tuple | Page]:
    """The rows of the pages whose neighbours are all here; or, if ``edges``, the other pages.

    ``open_left`` and ``open_right`` say whether more pages may stand before and after these. Pages
    that wait for them come with the different pages that the next step has to see beside them.
    Runs out of reach are dropped, so memory does not grow with the host.
    """
    source = _Ending(pages)
    for number, (_, found) in enumerate(groupby(runs(source), key=lambda r: r.pages[0].host)):
        left, near, n = open_left and number == 0, {}, 0

        def told(k: int, waits: bool) -> Iterator[tuple | Page]:
            waits = waits or (left and k < REACH)  # noqa: B023
            if edges and waits:
                yield from near[k].pages  # noqa: B023
            elif edges and left and k < 2 * REACH:  # noqa: B023
                yield replace(near[k].pages[0], asked=False)  # noqa: B023
            elif not edges and not waits:
                yield from judged(near[k], [near[j] for j in range(k - WINDOW, k + WINDOW + 1) if j != k and j in near])  # noqa: B023

        for run in linked(found):
            near[n] = run
            n += 1
            if n > REACH:
                yield from told(n - 1 - REACH, False)
            if gone := near.pop(n - 1 - 3 * REACH, None):
                gone.after.before = None
        right = open_right and source.ended
        if edges and right:
            yield from (replace(near[k].pages[0], asked=False) for k in range(max(2 * REACH if left else 0, n - 2 * REACH), n - REACH))
        for k in range(max(0, n - REACH), n):
            yield from told(k, right)


_OUT = {"page_id": None, "url": pa.string(), "text": pa.string(), "n_chars": pa.int64(), "partner_id": None, "n_lines": pa.int32(), "n_shared": pa.int32()}
_EDGE = {"page_id": None, "url": pa.string(), "part": pa.int32(), "seq": pa.int64(), "asked": pa.bool_(), "host": pa.string(), "path": pa.string(), "kinds": pa.list_(pa.int32()), "places": pa.list_(pa.string()), "lines": pa.list_(pa.string())}


def _batches(rows: Iterator[tuple], like: Callable[[], pa.DataType], names: dict[str, pa.DataType | None]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most 500 rows and about four million characters; a larger row stands alone."""
    some: list[tuple] = []
    size = 0
    for row in rows:
        own = sum(len(x) if isinstance(x, str) else sum(map(len, x)) if x and isinstance(x, list) and isinstance(x[0], str) else 8 for x in row)
        if some and (len(some) == 500 or size + own > 4_000_000):
            yield _batch(some, like(), names)
            some, size = [], 0
        some.append(row)
        size += own
    if some:
        yield _batch(some, like(), names)


def _batch(some: list[tuple], like: pa.DataType, names: dict[str, pa.DataType | None]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t or like) for c, t in zip(zip(*some, strict=True), names.values(), strict=True)], names=list(names))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, partner_id, n_lines, n_shared.

    A null or empty page has an empty text; a null URL counts as a host of its own, the empty one;
    repeated rows and URLs are pages of their own; copies are not partners of each other, but of the
    nearest different page of the host, the one before where both are as near; a page without one
    has no partner and is judged by its own places; an empty table gives an empty table; other
    columns are not read. Whole pages are processed, however many lines they have.

    Pages at the ends of a partition wait for a second step, which sees those of many partitions in
    order, so the result does not depend on where the partitions end.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    address = F.coalesce(F.col("url"), F.lit(""))
    rows = rows.withColumn("host", F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = rows.withColumn("path", F.regexp_replace(address, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|[?#].*$", ""))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "path", "page_id", "h"]  # equal rows only are in any order
    rows = rows.withColumn("h", F.xxhash64("url", "html")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    kind = dict(rows.dtypes)["page_id"]
    result = f"page_id {kind}, url string, text string, n_chars long, partner_id {kind}, n_lines int, n_shared int"
    waiting = f"page_id {kind}, url string, part int, seq long, asked boolean, host string, path string, kinds array<int>, places array<string>, lines array<string>"

    def step(parsed: Callable[[pa.RecordBatch], Iterator[tuple[int, Page]]], edges: bool, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """One pass over pages in order, as runs of (group, page); ``last``: nothing stands around them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            like = pa.int64()

            def read() -> Iterator[tuple[int, Page]]:
                nonlocal like
                for b in batches:
                    like = b.schema.field("page_id").type
                    for seq, (group, p) in zip(count, parsed(b)):  # noqa: B905
                        p.seq = seq
                        yield group, p

            count = itertools.count()

            def rows() -> Iterator[tuple]:
                for group, found in groupby(read(), key=lambda x: x[0]):
                    for x in decided((p for _, p in found), not last and group > 0, not last, edges):
                        yield (x.id, x.url, group, x.seq, x.asked, x.host, x.path, *map(list, zip(*x.lines, strict=True))) if isinstance(x, Page) and x.lines else (x.id, x.url, group, x.seq, x.asked, x.host, x.path, [], [], []) if isinstance(x, Page) else x

            yield from _batches(rows(), lambda: like, _EDGE if edges else _OUT)

        return run

    def fresh(b: pa.RecordBatch) -> Iterator[tuple[int, Page]]:
        part = TaskContext.get().partitionId()
        cols = [b.column(i) for i in range(5)]
        for i in range(b.num_rows):
            row = [c[i].as_py() for c in cols]
            yield part, Page(row[0], row[1], row[3], row[4], lines(row[2] or ""))

    def held(b: pa.RecordBatch) -> Iterator[tuple[int, Page]]:
        cols = {name: b.column(i) for i, name in enumerate(b.schema.names)}
        for i in range(b.num_rows):
            r = {name: c[i].as_py() for name, c in cols.items()}
            yield r["group"], Page(r["page_id"], r["url"], r["host"], r["path"], list(zip(r["kinds"], r["places"], r["lines"], strict=True)), r["asked"])

    out = rows.mapInArrow(step(fresh, False, False), result)
    edges = rows.mapInArrow(step(fresh, True, False), waiting)
    while True:  # each round leaves the pages at the ends of groups of FAN partitions
        last = n <= FAN
        n = -(-n // FAN)
        group = F.lit(0) if last else F.floor(F.col("part") / FAN).cast("int")
        edges = edges.withColumn("group", group)
        edges = (edges.repartition(1) if last else edges.repartition(n, "group")).sortWithinPartitions("group", "part", "seq")
        out = out.unionByName(edges.mapInArrow(step(held, False, last), result))
        if last:
            return out
        edges = edges.mapInArrow(step(held, True, False), waiting)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
