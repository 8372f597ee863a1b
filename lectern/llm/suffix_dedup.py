"""Removal of repeated byte strings by column-wise order construction.

A byte goes if a string of `length` bytes around it also starts earlier in the
corpus.  Building one suffix order over the whole corpus column by column takes
a round per byte of the longest document, each over all symbols so far.  The
rounds are therefore run on aligned contexts:

1. Every string of `length` bytes holds an anchor, the `gram` bytes of smallest
   hash in it; equal strings hold it at the same place.  Anchors travel as
   hashes together with a hash of their context, all bytes that a string around
   the anchor can reach.
2. Of anchors with equal contexts all but the first are repeats outright.
   Where an anchor's contexts differ, one of each kind goes on.
3. Those contexts, aligned at the anchor, are built up column-wise: each round
   inserts one symbol per context and updates the collection's order and the
   extent of its common prefixes, first outward to the right, where each
   column's state is appended to a sequential external file, then outward to
   the left, reading that file backwards.  Left and right state together say
   which strings are equal, the earliest of each stays.
4. Documents meet the findings and lose the bytes.

Hot groups: a copied text's anchors meet in the block of documents that is read
together, and only the first of each kind is shuffled.  An anchor with many
contexts in one block is crowded (the edge of a passage that many documents
share).  Crowded anchors are dealt by context in step 2, and in step 3 by salts
that hold `crowd_rows` contexts on average; the strings that stay in one salt
meet those of the others by 128-bit hashes.

Rounds are bounded by `length`, whatever the documents' sizes.  Hashes only
choose candidates for step 3, which compares bytes; step 2 trusts 64 bits of
anchor and 64 of context, crowded anchors 128 bits of a string.

Defined results: ids are integers, null the largest; null text is empty;
repeated rows with equal ids are one document (equal ids with unequal texts
are not told apart); other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, runs, texts
from .hashing import Sums, mix

_NULL = (1 << 63) - 1  # stands for a null id, so that it orders last
_PIECE = 1 << 20
_BLOCK = 1 << 20  # anchors that are looked at together before the shuffle
_CELLS = 1 << 22  # cells that crowded anchors are marked in


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(x)
    y = np.concatenate([x, np.full(-n % w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(utf8: bytes, length: int = 100, gram: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, gram hashes and context hashes of a document's anchors."""
    out = []
    reach = length - gram
    for core in range(0, max(len(utf8) - length + 1, 0), _PIECE):
        lo, hi = max(0, core - reach), min(len(utf8), core + _PIECE + length + reach)
        a = np.frombuffer(utf8, np.uint8, hi - lo, lo)
        n = len(a)
        sums = Sums(a)
        h = mix((sums.sums[gram:] - sums.sums[:-gram]) * sums.down[: n - gram + 1])
        m = len(h)
        # Ties fall to the rightmost place, which equal strings share.
        keyed = (h & np.uint64(0xFFFFFFFFFF000000)) | (np.uint64(0xFFFFFF) - np.arange(m, dtype=np.uint64))
        first = core - lo
        last = min(core + _PIECE, len(utf8) - length + 1) - lo
        least = _window_min(keyed[first : last + reach], reach + 1)
        chosen = np.zeros(m, bool)
        chosen[(np.uint64(0xFFFFFF) - (least & np.uint64(0xFFFFFF))).astype(np.int64)] = True
        at = np.flatnonzero(chosen)
        left, right = np.maximum(at - reach, 0), np.minimum(at + length, n)
        ctx = sums.of(left, right)
        ctx ^= ((at - left) * 1009 + (right - at)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        out.append((at + lo, h[at].view(np.int64), mix(ctx).view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    pos, h, ctx = (np.concatenate(x) for x in zip(*out))
    if len(out) > 1:
        pos, kept = np.unique(pos, return_index=True)
        h, ctx = h[kept], ctx[kept]
    return pos, h, ctx


def _blocks(docs: DataFrame, length: int, gram: int, crowd: int, firsts: bool, schema: str) -> DataFrame:
    """Anchors of blocks of documents, either the first of each (h, ctx) in its block, or what a block settles by itself:
    later ones (id, pos) and the cells of crowded anchors (cell)."""

    def settle(parts: list) -> pa.RecordBatch:
        h, ctx, ident, pos = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((pos, ident, ctx, h))
        h, ctx, ident, pos = h[order], ctx[order], ident[order], pos[order]
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new_ctx = new_h.copy()
        new_ctx[1:] |= ctx[1:] != ctx[:-1]
        if firsts:
            return pa.RecordBatch.from_arrays([pa.array(c[new_ctx]) for c in (h, ctx, ident, pos)], ["h", "ctx", "id", "pos"])
        later = ~new_ctx
        later[1:] &= (ident[1:] != ident[:-1]) | (pos[1:] != pos[:-1])  # a row that repeats is the same document
        kinds = np.add.reduceat(new_ctx.astype(np.int64), np.flatnonzero(new_h))
        cells = np.unique(_cell(h[new_h][kinds >= crowd]))
        none = lambda n, kind: pa.nulls(n, kind)
        n, m = int(later.sum()), len(cells)
        return pa.RecordBatch.from_arrays(
            [pa.array([*ident[later].tolist(), *[None] * m], pa.int64()), pa.array([*pos[later].tolist(), *[None] * m], pa.int32()), pa.concat_arrays([none(n, pa.int64()), pa.array(cells, pa.int64())])],
            ["id", "pos", "cell"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for whole in batches:
            for ident, utf8 in zip(whole.column(0).to_pylist(), whole.column(1)):
                pos, h, ctx = anchors(utf8.as_py(), length, gram)
                if len(pos):
                    parts.append((h, ctx, np.full(len(pos), ident, np.int64), pos.astype(np.int32)))
                    held += len(pos)
                if held >= _BLOCK:
                    yield settle(parts)
                    parts, held = [], 0
        if parts:
            yield settle(parts)

    return docs.mapInArrow(run, schema)


def _cell(h: np.ndarray) -> np.ndarray:
    return h & (_CELLS - 1)


def _found(docs: DataFrame, length: int, gram: int, crowd: int) -> DataFrame:
    """Anchors that repeat (id, pos, need, crowded): need where contexts differ and bytes must be compared."""
    spark = docs.sparkSession
    local = materialize(_blocks(docs, length, gram, crowd, False, "id long, pos int, cell long"), "block-repeats")
    marks = np.zeros(_CELLS, bool)
    for (cell,) in local.where("cell is not null").select("cell").distinct().collect():  # at most _CELLS
        marks[cell] = True
    shared = spark.sparkContext.broadcast(np.packbits(marks))

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, ctx = (np.asarray(batch.column(k)) for k in (0, 1))
        cell = _cell(h)
        crowded = ((shared.value[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).astype(bool)
        key = np.where(crowded, mix(h.view(np.uint64) ^ (ctx.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))).view(np.int64), h)
        return pa.RecordBatch.from_arrays([pa.array(key), *batch.columns, pa.array(crowded)], ["deal", *batch.schema.names, "crowded"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, *cols, crowded in runs(batches, 6):
            fresh = np.ones(len(crowded), bool)
            fresh[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            (h, ctx, ident, pos), crowded = (c[fresh] for c in cols), crowded[fresh].astype(bool)
            starts = np.concatenate([[True], h[1:] != h[:-1]])
            kinds = starts.copy()
            kinds[1:] |= ctx[1:] != ctx[:-1]
            group = np.cumsum(starts) - 1
            many = (np.bincount(group, weights=kinds)[group] > 1) | crowded
            say = ~kinds | many
            if say.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[say]) for c in (ident, pos, kinds, kinds & crowded)], ["id", "pos", "need", "crowded"])

    kinds = "h long, ctx long, id long, pos int"
    sent = map_arrow(_blocks(docs, length, gram, crowd, True, kinds), deal, f"deal long, {kinds}, crowded boolean")
    met = sent.repartition("deal").sortWithinPartitions("deal", "h", "ctx", "id", "pos").mapInArrow(scan, "id long, pos int, need boolean, crowded boolean")
    return met.unionByName(local.where("cell is null").select("id", "pos", F.lit(False).alias("need"), F.lit(False).alias("crowded")))


def _contexts(docs: DataFrame, need: DataFrame, length: int, gram: int) -> DataFrame:
    """Bytes around the anchors to compare: (g, ctx, left, right, id, pos, crowded)."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                part = whole.slice(at, 64)
                cols = ([], [], [], [], [], [], [])
                for ident, utf8, places in zip(*(c.to_pylist() for c in part.columns)):
                    n = len(utf8)
                    for place in places:
                        p = place["pos"]
                        left, right = min(p, reach), min(n - p, length)
                        if right < gram:
                            continue
                        for c, v in zip(cols, (xxhash.xxh3_64_intdigest(utf8[p : p + gram]) - (1 << 63), utf8[p - left : p].rjust(reach, b"\0") + utf8[p : p + right].ljust(length, b"\0"), left, right, ident, p, place["crowded"])):
                            c.append(v)
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["g", "ctx", "left", "right", "id", "pos", "crowded"])

    lists = need.groupBy("id").agg(F.collect_list(F.struct("pos", "crowded")).alias("places"))
    return docs.join(lists, "id").mapInArrow(run, "g long, ctx binary, left int, right int, id long, pos int, crowded boolean")


def _insert(state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """One round: each context's class after one more symbol, numbered in sorted order."""
    keyed = state.astype(np.int64) << 9 | symbols
    order = np.argsort(keyed, kind="stable")
    new = np.zeros(len(keyed), np.int32)
    ranked = keyed[order]
    new[order[1:]] = np.cumsum(ranked[1:] != ranked[:-1])
    return new


def repeats(group: np.ndarray, ctx: np.ndarray, left: np.ndarray, right: np.ndarray, age: np.ndarray, length: int = 100, gram: int = 32) -> np.ndarray:
    """repeat[i, x]: the string of context i that starts at its byte x has an earlier equal.

    group: contexts of one anchor; ctx: bytes, reach + length wide, the anchor at
    byte reach; left, right: how many of them exist before and from the anchor
    on; age: position in the corpus.
    """
    reach, n = length - gram, len(group)
    # A byte beyond the document's edge is a symbol of its own.
    column = lambda k: np.where(reach - k <= left if k < reach else k - reach < right, ctx[:, k].astype(np.int64), 256)
    out = np.zeros((n, reach + 1), bool)
    with tempfile.TemporaryFile() as states:
        state = _insert(np.zeros(n, np.int32), np.zeros(n, np.int64)) + np.unique(group, return_inverse=True)[1].astype(np.int32)
        base = state
        for x in range(reach + 1):
            if x:
                state = _insert(state, column(length + x - 1))
            states.write(state.tobytes())
        state = base
        for taken in range(reach + 1):
            x = reach - taken
            if taken:
                state = _insert(state, column(x))
            states.seek(4 * n * x)
            other = np.frombuffer(states.read(4 * n), np.int32)
            whole = (reach - x <= left) & (x + length - reach <= right)
            here = np.flatnonzero(whole)
            keyed = (state[here].astype(np.int64) << 32) | other[here]
            order = np.lexsort((age[here], keyed))
            same = np.zeros(len(here), bool)
            same[1:] = keyed[order][1:] == keyed[order][:-1]
            out[here[order[same]], x] = True
    return out


def _string_hashes(rows: np.ndarray, x: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each string with its place x around the anchor; at another place it may be the very same bytes."""
    raw = [x.tobytes() for x in rows]
    signed = lambda seed: np.fromiter((xxhash.xxh3_64_intdigest(x, seed) for x in raw), np.uint64, len(raw)).view(np.int64)
    return signed(2 * x), signed(2 * x + 1)


def _compare(contexts: DataFrame, crowd: int, length: int, gram: int, crowd_rows: int, most: int = 100_000) -> DataFrame:
    """(id, pos, bits): which strings around each anchor have an earlier equal.

    Contexts of crowded anchors, `crowd` altogether, are spread over salts; of the strings that a
    salt leaves, the first in each, (a, b, id, pos, x) are compared among salts.
    """
    width, reach = 2 * length - gram, length - gram
    salts = max(2, -(-crowd // crowd_rows))
    deal = F.when(F.col("crowded"), F.xxhash64("g", F.pmod(F.xxhash64("id", "pos"), F.lit(salts)))).otherwise(F.col("g"))

    def packed(bits: np.ndarray) -> pa.Array:
        x = np.packbits(bits, axis=1)
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1]), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())

    def judge(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        g, ident, pos = (np.concatenate([x[k] for x in parts]) for k in (0, 4, 5))
        order = np.lexsort((g, pos, ident))
        fresh = np.ones(len(order), bool)  # a row that repeats is the same document; its contexts meet in one g
        fresh[1:] = np.any([c[order][1:] != c[order][:-1] for c in (g, ident, pos)], axis=0)
        order = order[fresh]
        g, ctx, left, right, ident, pos, crowded = (np.concatenate(x)[order] for x in zip(*parts))
        age = np.arange(len(g))
        bits = repeats(g, ctx, left, right, age, length, gram)
        hit = np.flatnonzero(bits.any(axis=1))
        n = len(hit)
        none = lambda k, kind: pa.nulls(k, kind)
        yield pa.RecordBatch.from_arrays([pa.array(ident[hit]), pa.array(pos[hit]), packed(bits[hit]), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.int32())], ["id", "pos", "bits", "a", "b", "x"])
        apart = np.flatnonzero(crowded)
        for x in range(reach + 1) if len(apart) else ():
            at = apart[(reach - x <= left[apart]) & (x + length - reach <= right[apart]) & ~bits[apart, x]]
            a, b = _string_hashes(ctx[at, x : x + length], x)
            yield pa.RecordBatch.from_arrays([pa.array(ident[at]), pa.array(pos[at]), none(len(at), pa.binary()), pa.array(a), pa.array(b), pa.array(np.full(len(at), x, np.int32))], ["id", "pos", "bits", "a", "b", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for cols in runs(batches, 7, {1: width}):
            parts.append(cols)
            held += len(cols[0])
            if held >= most:
                yield from judge(parts)
                parts, held = [], 0
        if parts:
            yield from judge(parts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, ident, pos, x in runs(batches, 5):
            later = np.zeros(len(a), bool)
            later[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            bits = np.zeros((int(later.sum()), reach + 1), bool)
            bits[np.arange(len(bits)), x[later]] = True
            if len(bits):
                yield pa.RecordBatch.from_arrays([pa.array(ident[later]), pa.array(pos[later]), packed(bits)], ["id", "pos", "bits"])

    dealt = contexts.select(deal.alias("g"), "ctx", "left", "right", "id", "pos", "crowded")
    judged = dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, "id long, pos int, bits binary, a long, b long, x int")
    judged = materialize(judged, "judged")
    strings = judged.where("bits is null").select("a", "b", "id", "pos", "x")
    met = strings.repartition("a").sortWithinPartitions("a", "b", "id", "pos").mapInArrow(meet, "id long, pos int, bits binary")
    return judged.where("bits is not null").select("id", "pos", "bits").unionByName(met)


def _cover(n: int, places: list, length: int, gram: int) -> np.ndarray:
    """Mask of bytes to remove."""
    reach = length - gram
    edge = np.zeros(n + 1, np.int64)
    if n >= length and places:
        whole = np.array([x["pos"] for x in places if x["bits"] is None], np.int64)
        lo, hi = np.maximum(whole - reach, 0), np.minimum(whole + length, n)
        full = hi - lo >= length
        np.add.at(edge, lo[full], 1)
        np.add.at(edge, hi[full], -1)
        some = [x for x in places if x["bits"] is not None]
        if some:
            bits = np.unpackbits(np.frombuffer(b"".join(x["bits"] for x in some), np.uint8).reshape(len(some), -1), axis=1)[:, : reach + 1]
            row, x = np.nonzero(bits)
            start = np.array([p["pos"] for p in some], np.int64)[row] - reach + x
            start = start[(start >= 0) & (start + length <= n)]
            np.add.at(edge, start, 1)
            np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", length: int = 100, gram: int = 32, keep_bytes: bool = True, crowd: int = 256, crowd_rows: int = 50_000) -> DataFrame:
    """One row per document: sizes, removed spans, digest, and with keep_bytes the bytes that stay.

    crowd: contexts of one anchor in a block of about a million anchors from which it counts as crowded.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is {kind}; document ids order by number")
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("id"), texts(docs, text))
    found = materialize(_found(source, length, gram, crowd), "anchors")
    contexts = _contexts(source, found.where("need").select("id", "pos", "crowded"), length, gram)
    bits = materialize(_compare(contexts, found.where("crowded").count(), length, gram, crowd_rows), "repeats")
    all_places = found.where("not need").select("id", "pos", F.lit(None).cast("binary").alias("bits")).unionByName(bits)
    lists = all_places.groupBy("id").agg(F.collect_list(F.struct("pos", "bits")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                rows = []
                for ident, utf8, places in zip(*(c.to_pylist() for c in whole.slice(at, 256).columns)):
                    gone = _cover(len(utf8), places or [], length, gram)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    left = np.frombuffer(utf8, np.uint8)[~gone].tobytes() if len(edge) else utf8
                    spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]
                    rows.append((None if ident == _NULL else ident, len(utf8), int(gone.sum()), len(spans), hashlib.sha256(left).hexdigest(), spans, left if keep_bytes else None))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"])

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>, kept binary"
    out = source.join(lists, "id", "left").mapInArrow(run, schema)
    return out.select(F.col("id").cast(kind).alias(id_col), *(c for c in out.columns if c != "id" and (keep_bytes or c != "kept")))
