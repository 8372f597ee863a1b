"""Benchmark decontamination with one Aho-Corasick automaton.

Every window of `window` consecutive words of a benchmark item becomes a
pattern over normalised bytes (ASCII lower case, any other ASCII but letters
and digits a separator).  One automaton holds all patterns; a document is
normalised and scanned once, and match ends map back to word positions and from
there to offsets of the original text.

The automaton is broadcast, so the benchmark's size is checked first
(`max_benchmark_bytes`): a test set is fixed, it does not grow with the corpus.
Documents are never shuffled.

Defined results: null or empty text has no words and is clean; null or empty
items have no window; repeated item ids count once per document; an empty
benchmark leaves every document clean; other columns are kept by `keep`.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts

# Bytes outside words become spaces; bytes above 0x7F belong to words.
_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(utf8: bytes) -> list[bytes]:
    return utf8.lower().translate(_TABLE).split()


class Windows:
    """Benchmark windows; the automaton is built once per Python worker."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        self.items = sorted({i for i, _ in items})
        at = {x: k for k, x in enumerate(self.items)}
        self.patterns: dict[str, set[int]] = {}
        self.lengths: dict[str, int] = {}
        for item, utf8 in items:
            w = words(utf8)
            size = min(window, len(w))
            for k in range(len(w) - size + 1 if w else 0):
                key = (b" " + b" ".join(w[k : k + size]) + b" ").decode("latin-1")
                self.patterns.setdefault(key, set()).add(at[item])
                self.lengths[key] = size

    def automaton(self):
        a = ahocorasick.Automaton()
        for key, items in self.patterns.items():
            a.add_word(key, (self.lengths[key], tuple(sorted(items))))
        if self.patterns:
            a.make_automaton()
        return a


_built: dict[int, tuple] = {}


def _automaton(shared):
    if shared.value is not _built.get("of"):
        _built.clear()
        _built.update(of=shared.value, made=shared.value.automaton())
    return _built["made"]


def scan(utf8: bytes, automaton, keys: list[str]) -> tuple[int, np.ndarray | None, dict[int, int]]:
    """Number of words, mask of words inside a benchmark window (None: no hit), items found with their longest window."""
    w = words(utf8)
    if not w or not len(automaton):
        return len(w), None, {}
    line = b" " + b" ".join(w) + b" "
    edges, found = None, {}
    hit = np.zeros(len(w) + 1, np.int64)
    for end, (size, items) in automaton.iter(line.decode("latin-1")):
        if edges is None:
            edges = np.cumsum(np.frombuffer(line, np.uint8) == 0x20)
        last = int(edges[end]) - 1  # the space at `end` closes this word, counted from 1
        hit[last - size] += 1
        hit[last] -= 1
        for item in items:
            found[item] = max(size, found.get(item, 0))
    return len(w), (np.cumsum(hit)[:-1] > 0 if found else None), found


def spans(utf8: bytes, mask: np.ndarray) -> list[tuple[int, int]]:
    """Code-point offsets in the original text of maximal runs of hit words."""
    flat = utf8.lower().translate(_TABLE)
    starts, ends, at = [], [], 0
    for w in flat.split():
        at = flat.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    out = []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    points = np.cumsum((np.frombuffer(utf8, np.uint8) & 0xC0) != 0x80) if utf8 else np.zeros(0, int)
    for a, b in zip(edge[::2], edge[1::2]):
        first, last = starts[a], ends[b - 1]
        out.append((int(points[first]) - 1, int(points[last - 1])))
    return out


def build(benchmark: DataFrame, *, item_id: str = "item_id", text: str = "text", window: int = 8, max_benchmark_bytes: int = 64 << 20) -> Windows:
    """Collect the test set after checking that it is as small as one is meant to be."""
    utf8 = texts(benchmark, text)
    size = benchmark.select(utf8).agg(F.sum(F.octet_length("__utf8"))).first()[0] or 0
    if size > max_benchmark_bytes:
        raise ValueError(f"the benchmark has {size} bytes of text, above max_benchmark_bytes={max_benchmark_bytes}; scan for parts of it one after another")
    rows = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("i"), utf8).collect()
    return Windows([(r[0], bytes(r[1])) for r in rows], window)


def scan_documents(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text: str = "text", window: int = 8, min_items: int = 2, **bounds) -> DataFrame:
    """One row per document: word counts, items found, verdict and the hit spans."""
    shared = docs.sparkSession.sparkContext.broadcast(build(benchmark, window=window, **bounds))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        auto, names = _automaton(shared), shared.value.items
        n, hits, items, digest, where = [], [], [], [], []
        for utf8 in batch.column(1).to_pylist():
            count, mask, found = scan(utf8, auto, names)
            n.append(count)
            hits.append(0 if mask is None else int(mask.sum()))
            items.append(len(found))
            digest.append(hashlib.sha256(",".join(names[k] for k in sorted(found)).encode()).hexdigest())
            where.append([] if mask is None else [{"start": a, "end": b} for a, b in spans(utf8, mask)])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.int64()), pa.array(digest, pa.string()),
             pa.array([x >= min_items for x in items], pa.bool_()),
             pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<struct<start:long,end:long>>"
    return map_arrow(docs.select(F.col(id_col), texts(docs, text)), run, schema)


def keep(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = 8, min_items: int = 2, min_short_items: int | None = None, **bounds) -> DataFrame:
    """The rows of docs that hold fewer than min_items benchmark items, with their own columns.

    min_short_items: items of fewer words than a window may stand in any text; those do not
    count then, but that many different ones in a row remove it as well.
    """
    shared = docs.sparkSession.sparkContext.broadcast(build(benchmark, window=window, **bounds))
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        auto, names = _automaton(shared), shared.value.items
        clean = []
        for x in batch.column(at).to_pylist():
            sizes = scan((x or "").encode("utf-8", "surrogatepass"), auto, names)[2].values()
            short = 0 if min_short_items is None else sum(n < window for n in sizes)
            clean.append(len(sizes) - short < min_items and (min_short_items is None or short < min_short_items))
        return batch.filter(pa.array(clean, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
