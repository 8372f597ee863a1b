"""Main text of web pages by nearest-URL page differencing.

Pages are range-sorted by host and URL path, so a page's nearest URL is next to
it; a host of any size spreads over many tasks, and a range gets the pages just
beyond its ends as well, so that results do not depend on the ranges.  Each
page's text lines are aligned with those of its nearest neighbour of the same
host by longest common subsequence, and shared lines outside article and main
go: those are the site's own furniture.  Markup that names its role
(navigation, header, footer, sidebar, advert, form, script, comment section)
goes as well.  A neighbour one of whose bodies is nearly all in the other is a
copy and says nothing about furniture; the next nearest counts then, of the
four different pages on either side.

A page without such a neighbour is judged by markup alone.

Defined results: null html has the empty text; a null url sorts as an empty
one; repeated rows are copies of each other; other columns are ignored, their
names may clash with any used here; a page of any length is read whole; an
empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

_BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table
    tbody td tfoot th thead title tr ul""".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe title textarea select".split())
_FURNITURE = frozenset("nav footer aside form menu button dialog header".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|copyright|disclaimer|disqus|footer|header|login|masthead|"
    r"menu|nav\w*|newsletter|notices?|pagination|popup|promo\w*|related|replies|responses|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
# An article's own heading block is often named after headers.
_OF_ARTICLE = re.compile(r"(?:^|[\s_-])(?:header|masthead|banner)(?:$|[\s_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_SPACE = re.compile(r"\s+")
_SLASH_OF_VALUE = re.compile(r"=\s*[^\s\"'>]+\Z")  # an unquoted value that ends in the tag's last slash
_PAIRS = 1 << 22  # equal lines of two pages that are looked at one by one
_LOOK = 4  # different pages to look at on either side


class Line(NamedTuple):
    text: str
    furniture: bool
    article: bool


def _is_furniture(tag: str, attrs: str, inside: bool) -> bool:
    if tag in _FURNITURE:
        return not (tag == "header" and inside)
    if not attrs or tag in ("article", "main", "body", "html"):
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            if _NAMES.search(_OF_ARTICLE.sub(" ", value) if inside else value):
                return True
        if key == "role" and value.strip().lower() in _ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
    return False


def lines_of(page: str) -> list[Line]:
    """Text blocks in page order, each with what the markup says about it."""
    out: list[Line] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, furniture, article
    parts: list[str] = []
    furniture = article = False

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Line(text, furniture, article))
            parts.clear()

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if any(x[0] == tag for x in stack):
                if tag in _BLOCK:
                    flush()
                while stack.pop()[0] != tag:
                    pass
                _, furniture, article = stack[-1] if stack else ("", False, False)
            elif tag in _BLOCK:
                flush()
            continue
        if tag in _RAW:
            flush()
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)  # a slash does not close these
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            parts.append("\n")
            continue
        if tag in _BLOCK:
            flush()
            if stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "u", "span", "a", "font") and any(x[0] == "p" for x in stack):
                keep = next(k for k, x in enumerate(stack) if x[0] == "p")
                if all(x[0] not in _BLOCK for x in stack[keep + 1 :]):  # an open paragraph ends where a block begins
                    del stack[keep:]
                    _, furniture, article = stack[-1] if stack else ("", False, False)
        if tag in _VOID or m[3].endswith("/") and not _SLASH_OF_VALUE.search(m[3]):
            continue
        begins = _is_furniture(tag, m[3], article)
        if begins and not furniture:
            flush()
        furniture = furniture or begins
        article = article or tag in ("article", "main")
        stack.append((tag, furniture, article))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def _prefix_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of a with the first 0, 1, ... lines of b, a machine word of them at a time."""
    where: dict[str, int] = {}
    for k, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        if met := where.get(x, 0) & v:
            v = (v + met | v - met) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of a longest common subsequence with b.

    By pairs of equal lines (Hunt and Szymanski); where lines repeat so often that
    those are very many, a is halved, b cut where both halves share most (Hirschberg).
    """
    in_b = Counter(b)
    if len(a) > 1 and sum(in_b[x] for x in a) > _PAIRS:
        half = len(a) // 2
        cut = int(np.argmax(_prefix_lengths(a[:half], b) + _prefix_lengths(a[half:][::-1], b[::-1])[::-1]))
        return shared_lines(a[:half], b[:cut]) | {half + k for k in shared_lines(a[half:], b[cut:])}
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    found = {*range(lo), *range(len(a) - hi, len(a))}
    places: dict[str, list[int]] = {}
    for k in range(len(b) - hi - 1, lo - 1, -1):
        places.setdefault(b[k], []).append(k)
    ends: list[int] = []  # ends[k]: smallest end in b of a common subsequence of k + 1 lines
    links: list[tuple | None] = []
    for k in range(lo, len(a) - hi):
        for j in places.get(a[k], ()):  # from the back, so a line is used once
            at = bisect_left(ends, j)
            link = (k, links[at - 1] if at else None)
            if at == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[at]:
                ends[at], links[at] = j, link
    link = links[-1] if links else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def body_shared(lines: list[Line], neighbour: list[Line]) -> set[int] | None:
    """Positions of the lines shared with the neighbour; None if one page holds nearly all the other's body, as copies do."""
    a, b = [x.text for x in lines], [x.text for x in neighbour]
    shared = shared_lines(a, b)
    taken = Counter(a[k] for k in shared)
    other = set()
    for k, x in enumerate(b):
        if taken[x] > 0:
            taken[x] -= 1
            other.add(k)
    for page, same in ((lines, shared), (neighbour, other)):
        body = [(len(x.text), k in same) for k, x in enumerate(page) if not x.furniture]
        if 50 * sum(n for n, known in body if not known) <= sum(n for n, _ in body):
            return None
    return shared


def main_text(lines: list[Line], shared: set[int] | None) -> str:
    """The page's lines without furniture, by markup and, unless shared is None, by difference from the neighbour.

    What article markup holds stays; of the rest of a page that has such markup, what the neighbour does not share.
    """
    if shared is None:
        marked = any(x.article and not x.furniture for x in lines)
        return " ".join(x.text for x in lines if not x.furniture and (x.article or not marked))
    return " ".join(x.text for k, x in enumerate(lines) if not x.furniture and (x.article or k not in shared))


def url_key(url: str = "url"):
    """Host and path columns to sort by."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""), r"[?#].*$", "")
    return F.lower(host).alias("__host"), path.alias("__path")


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Run:
    """Successive pages of one host with the same html."""

    def __init__(self, digest: int, raw: str):
        self.digest, self.lines, self.rows, self.said = digest, lines_of(raw), [], {}

    def text(self, others: list[Run]) -> str:
        """By the first of the others that is no copy."""
        for other in others:
            if other.digest not in self.said:
                shared = body_shared(self.lines, other.lines)
                self.said[other.digest] = None if shared is None else main_text(self.lines, shared)
            if self.said[other.digest] is not None:
                return self.said[other.digest]
        if None not in self.said:
            self.said[None] = main_text(self.lines, None)
        return self.said[None]


def _judged(runs: list[Run], k: int) -> Iterator[tuple]:
    """(id, url, text) of the own rows of run k, whose neighbours are the runs around it."""
    here = runs[k]
    around = [(d, runs[j], runs[j].rows[at][0]) for d in range(1, _LOOK + 1) for j, at in ((k - d, -1), (k + d, 0)) if 0 <= j < len(runs)]
    for path, ident, url, own in here.rows:
        if own:
            near = sorted(((-_common(p, path), d, n) for n, (d, _, p) in enumerate(around)))
            yield ident, url, here.text([around[n][1] for *_, n in near])


def _rank(host: str, path: str, ident) -> tuple:
    return host, path, ident is not None, 0 if ident is None else ident


def _edges(keys: DataFrame, parts: int, kind: str) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """Bounds of the ranges, and the pages next to a range that it needs as neighbours: their key, with the ranges."""
    sample = sorted(_rank(*r) for r in keys.select("__host", "__path", "__id").orderBy(F.xxhash64("__host", "__path", "__id")).limit(32 * parts).collect())
    bounds = sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []
    shared = keys.sparkSession.sparkContext.broadcast(bounds)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = [bisect_right(shared.value, _rank(*r)) for r in zip(*(batch.column(k).to_pylist() for k in range(3)))]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], ["__host", "__path", "__id", "__digest", "__part"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First and last runs of each range, of a run its outer rows."""
        first: list[tuple] = []
        last: deque[list[tuple]] = deque(maxlen=_LOOK + 1)
        part = None

        def out() -> pa.RecordBatch:
            rows = [(*r, False) for r in first] + [(*r[-1], True) for r in last]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (*types, pa.bool_()))], ["__host", "__path", "__id", "__digest", "__part", "tail"])

        for batch in batches:
            types = batch.schema.types
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[4] != part:
                    if last:
                        yield out()
                    first, part = [], row[4]
                    last.clear()
                if last and (last[-1][-1][0], last[-1][-1][3]) == (row[0], row[3]):
                    last[-1][-1] = row
                else:
                    last.append([row])
                    if len(first) <= _LOOK:
                        first.append(row)
        if last:
            yield out()

    schema = f"__host string, __path string, __id {kind}, __digest long, __part int"
    placed = map_arrow(keys, place, schema).repartition("__part").sortWithinPartitions("__part", "__host", "__path", "__id")
    ends_of = placed.mapInArrow(ends, f"{schema}, tail boolean").collect()
    wanted: dict[tuple, list[int]] = {}
    for tail in (True, False):
        rows = sorted((r for r in ends_of if r.tail == tail), key=lambda r: _rank(*r[:3]), reverse=tail)
        edge = {}  # the outermost page of each range on the side that looks there
        for r in sorted((r for r in ends_of if r.tail != tail), key=lambda r: _rank(*r[:3]), reverse=not tail):
            edge.setdefault(r["__part"], r)
        beyond = {p: k for k, r in reversed(list(enumerate(rows))) for p in (r["__part"],)}
        order = sorted(beyond, reverse=tail)
        for p, q in zip(order, order[1:]):
            seen, digest = 0, None
            for r in rows[beyond[q] :]:
                if r["__host"] != edge[p]["__host"] or (seen := seen + (r["__digest"] != digest)) > _LOOK + 1:
                    break
                if r["__digest"] != digest:
                    wanted.setdefault(_rank(*r[:3]), []).append(p)
                digest = r["__digest"]
    return bounds, wanted


def extract(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: id, url, main text and its code points."""
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    keyed = pages.select(*url_key(url), F.col(id_col).alias("__id"), F.col(url).cast("string").alias("__url"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("__html"))
    keyed = keyed.withColumn("__digest", F.xxhash64("__html"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = spark.sparkContext.broadcast(_edges(keyed.select("__host", "__path", "__id", "__digest"), parts, kind))

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        bounds, wanted = edges.value
        take, at, own = [], [], []
        for k, key in enumerate(_rank(*r) for r in zip(*(batch.column(c).to_pylist() for c in range(3)))):
            mine = [bisect_right(bounds, key), *wanted.get(key, ())]
            take += [k] * len(mine)
            at += mine
            own += [True] + [False] * (len(mine) - 1)
        out = batch.take(pa.array(take, pa.int64()))
        return pa.RecordBatch.from_arrays([*out.columns, pa.array(at, pa.int32()), pa.array(own)], [*batch.schema.names, "__part", "__own"])

    dealt = map_arrow(keyed, deal, f"__host string, __path string, __id {kind}, __url string, __html string, __digest long, __part int, __own boolean")
    ordered = dealt.repartitionById(parts, F.col("__part")).sortWithinPartitions("__part", "__host", "__path", "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[Run] = []  # of one host, and the first that is not judged yet
        at, place, rows = 0, None, []

        def batch_of():
            ids, urls, out = zip(*rows)
            made = pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(urls, pa.string()), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], [id_col, "url", "text", "n_chars"])
            rows.clear()
            return made

        def judge(until: int) -> Iterator[pa.RecordBatch]:
            for k in range(at, until):
                for row in _judged(runs, k):
                    rows.append(row)
                    if len(rows) >= 512:
                        yield batch_of()

        for batch in batches:
            id_type = batch.schema.field(2).type
            for host, path, ident, url, raw, digest, part, own in zip(*(c.to_pylist() for c in batch.columns)):
                if place != (part, host):
                    yield from judge(len(runs))
                    runs, at, place = [], 0, (part, host)
                if not runs or runs[-1].digest != digest:
                    runs.append(Run(digest, raw))
                    done = len(runs) - 1 - _LOOK  # runs before it have all their neighbours, whole
                    if done > at:
                        yield from judge(done)
                        at = done
                        drop = max(at - _LOOK, 0)
                        del runs[:drop]
                        at -= drop
                runs[-1].rows.append((path, ident, url, own))
        yield from judge(len(runs))
        if rows:
            yield batch_of()

    return ordered.mapInArrow(run, f"`{id_col}` {kind}, url string, text string, n_chars long")
