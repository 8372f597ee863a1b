"""Exact Jaccard self-join of documents' word-shingle sets, with set-relation skipping.

Sets that are equal count once (a class).  Tokens get one global order, rare
ones first: a fixed-size counting sketch over all documents finds the frequent
ones.  Two sets of similarity t share `shared` tokens (or all they have in
common) among the first n - ceil(t * n) + shared of each, so only these go to
the index lists, with size and position.

Index-level skipping: a list is sorted by size, then position; its sets of one
size are a block.  A set's partners lie in the blocks of some sizes, and in each
before some position: other blocks, and the ends of these, are skipped whole.
Long lists are dealt over shards that meet two and two, each pair in a task.
Answer-level skipping: each list first meets its leader, the set whose own
prefix is shared most, and each set is checked against the leader it meets
most often.  The answers found there, who is already joined to whom, are what
the second round derives the rest from: only pairs whose components still
differ are candidates then.  All of those are checked, so no link between
components is lost; pairs that would only repeat what is known are never
formed.  That is enough for `classes`.  `join` and `link_counts` give every
link.  There each set's difference from its leader is kept, and a pair of one
leader is decided from the two differences, mostly by their sizes alone; only
pairs of different leaders compare whole sets.

Sets travel for the check only if they share enough index lists for a link.
Tokens are 64-bit hashes, classes are told apart by 128 bits.

Defined results: null, empty and blank texts have no shingle and link with
nothing; fewer than `width` words form one shingle; repeated rows are copies;
a row with a null id takes no part in linking and gets a null component; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, parts, runs, texts
from .components import connected
from .hashing import Sums, mix

_CELLS = 1 << 20
_PART = 1 << 16
_PIECE = 1 << 20
_BITS = 1 << 10
_MIX = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def _word_hashes(utf8: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word."""
    a = np.frombuffer(utf8, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[a], [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    h = Sums(_LOWER[a]).of(starts, ends)
    return mix(h ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def shingle_sets(texts_: list[bytes], width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles.

    Texts are hashed about a megabyte at a time; of a longer one, pieces that
    end at white space.
    """
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts_):
        last, size = at + 1, len(texts_[at])
        while last < len(texts_) and size + len(texts_[last]) < _PIECE:
            size += len(texts_[last])
            last += 1
        part = texts_[at:last]
        if last == at + 1 and size > _PIECE:
            hashes, cuts = [], [0]
            while cuts[-1] < size:
                end = min(cuts[-1] + _PIECE, size)
                while end < size and not _SPACE[part[0][end]]:
                    end += 1
                hashes.append(_word_hashes(part[0][cuts[-1] : end])[0])
                cuts.append(end)
            h = np.concatenate(hashes)
            bounds = np.array([0, len(h)])
        else:
            h, starts = _word_hashes(b"\n".join(part))
            bounds = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in part)]))
        whole = _combine(h, width)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo >= width:
                s = np.sort(whole[lo : hi - width + 1])
                fresh = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=fresh[1:])
                out.append(s[fresh])
            else:
                out.append(_combine(h[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64))
        at = last
    return out


def _combine(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of `size` word hashes."""
    n = len(h) - size + 1
    s = np.full(max(n, 0), np.uint64(size), np.uint64)
    if n > 0:
        for k in range(size):
            s += h[k : k + n] * _MIX[k % len(_MIX)]
            s ^= s >> np.uint64(31)
            s *= _MIX[(k + 2) % len(_MIX)]
        s ^= s >> np.uint64(29)
    return s


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@dataclass(frozen=True)
class Keys:
    """Names of classes: 64 bits of a 128-bit hash of the set, or another name where two classes share these.

    bits: how many of the 64 are used (fewer only make clashes common, for tests).
    renamed: (first, second half of the hash) -> name.
    """

    bits: int = 64
    renamed: dict[tuple[int, int], int] = field(default_factory=dict)

    def halves(self, tokens: np.ndarray) -> tuple[int, int]:
        h = xxhash.xxh3_128_intdigest(tokens.tobytes(), seed=len(tokens))
        return _signed(h & ((1 << self.bits) - 1)), _signed(h >> 64)

    def of(self, tokens: np.ndarray) -> int:
        pair = self.halves(tokens)
        return self.renamed.get(pair, pair[0])


def in_order(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Tokens by frequency level, then value."""
    level = levels[(tokens >> np.uint64(44)).astype(np.int64)]
    return tokens[np.argsort(level, kind="stable")] if level.any() else tokens


def prefix_size(n: int, percent: int, shared: int) -> int:
    """Tokens to index so that two sets similar enough share `shared` of them, or all they share."""
    return min(n, n - (percent * n + 99) // 100 + shared)


def _need(n1, n2, percent: int):
    """Common tokens that two sets of these sizes need."""
    return (percent * (n1 + n2) + 99 + percent) // (100 + percent)


def _unclash(members: DataFrame, bits: int, most: int = 1_000_000) -> tuple[DataFrame, Keys]:
    """members (id, n, key, second) with a key of its own for every class, and how to form these.

    Of n classes about n * n / 2 ** 65 share their 64 bits, ten of 2e10; more than
    `most` such keys are an error.
    """
    spark = members.sparkSession
    twins = members.where("key is not null").groupBy("key").agg(F.min("second").alias("lo"), F.max("second").alias("hi")).where("lo <> hi").select("key", "lo")
    twins = twins.limit(most + 1).collect()
    if len(twins) > most:
        raise ValueError(f"more than {most} keys of classes clash")
    if not twins:
        return members.drop("second"), Keys(bits)
    others = members.join(F.broadcast(spark.createDataFrame(twins, "key long, lo long")), "key").where("second <> lo").select("key", "second").distinct().collect()
    renamed = {(r.key, r.second): _signed(xxhash.xxh3_64_intdigest(f"{r.key}:{r.second}")) for r in others}
    names = spark.createDataFrame([(*k, v) for k, v in renamed.items()], "key long, second long, name long")
    named = members.join(F.broadcast(names), ["key", "second"], "left").select("id", "n", F.coalesce("name", "key").alias("key"))
    return named, Keys(bits, renamed)


def _sets(docs: DataFrame, id_col: str, text: str, width: int, key_bits: int) -> tuple[DataFrame, Keys, np.ndarray]:
    """Rows (id, n, key) of all documents, the classes' keys, and the level of each sketch cell."""
    plain = Keys(key_bits)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, held = np.zeros(_CELLS, np.int64), [], 0
        for batch in (p for whole in batches for p in parts(whole)):
            sizes, keys, seconds = [], [], []
            for t in shingle_sets(batch.column(1).to_pylist(), width):
                sizes.append(len(t))
                key, second = plain.halves(t) if len(t) else (None, None)
                keys.append(key)
                seconds.append(second)
                waiting.append((t >> np.uint64(44)).astype(np.int64))
                held += len(t)
                if held > 1_000_000:
                    counts += np.bincount(np.concatenate(waiting), minlength=_CELLS)
                    waiting, held = [], 0
            m = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(seconds, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        if waiting:
            counts += np.bincount(np.concatenate(waiting), minlength=_CELLS)
        filled = [k for k in range(_CELLS // _PART) if counts[k * _PART : (k + 1) * _PART].any()]
        if filled:
            blobs = [zlib.compress(counts[k * _PART : (k + 1) * _PART].tobytes(), 1) for k in filled]
            m = len(filled)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, id_type), *[pa.nulls(m, pa.int64())] * 3, pa.array(filled, pa.int32()), pa.array(blobs, pa.binary())], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(zlib.decompress(blob), np.int64)
                sums[part] = sums[part] + x if part in sums else x
        for part, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["part", "counts"])

    names = ["id", "n", "key", "second", "part", "counts"]
    id_type = {"int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())
    both = materialize(docs.select(F.col(id_col).alias("id"), texts(docs, text)).mapInArrow(run, f"id {kind}, n long, key long, second long, part int, counts binary"), "sets")
    total = np.zeros(_CELLS, np.int64)
    for part, x in both.where("part is not null").select("part", "counts").repartition("part").mapInArrow(add, "part int, counts binary").collect():
        total[part * _PART : (part + 1) * _PART] = np.frombuffer(x, np.int64)
    usual = 2 * total.sum() / _CELLS + 8
    levels = np.floor(np.log2(np.maximum(total / usual, 1))).astype(np.uint8)
    return *_unclash(both.where("part is null").select("id", "n", "key", "second"), key_bits), levels


def _lists(docs: DataFrame, known, text: str, width: int, percent: int, shared: int) -> DataFrame:
    """Index lists that hold two sets at least: token, key, n, pos.

    known: broadcast (levels, Keys).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        levels, keys = known.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                tok, key, size, pos = [], [], [], []
                for t in shingle_sets(whole.column(0).slice(at, 512).to_pylist(), width):
                    k = keys.of(t) if len(t) else None
                    if k is None or k in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(k)
                    p = prefix_size(len(t), percent, shared)
                    tok.append(in_order(t, levels)[:p].view(np.int64))
                    key.append(np.full(p, k, np.int64))
                    size.append(np.full(p, len(t), np.int32))
                    pos.append(np.arange(p, dtype=np.int32))
                if tok:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tok, key, size, pos)], ["token", "key", "n", "pos"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of tokens with two keys at least, a row a key; only the last row waits for the next batch."""
        last: list[np.ndarray] | None = None
        wanted = False  # whether the waiting row's token had another key before it
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if last is not None:
                cols = [np.concatenate(x) for x in zip(last, cols)]
            if not len(cols[0]):
                continue
            fresh = np.ones(len(cols[0]), bool)
            fresh[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            cols = [c[fresh] for c in cols]
            more = np.zeros(len(cols[0]), bool)
            more[0] = wanted
            same = cols[0][1:] == cols[0][:-1]
            more[1:] |= same
            more[:-1] |= same
            last, wanted = [c[-1:] for c in cols], bool(more[-1])
            more[-1] = False
            if more.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[more]) for c in cols], ["token", "key", "n", "pos"])
        if wanted:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in last], ["token", "key", "n", "pos"])

    schema = "token long, key long, n int, pos int"
    out = docs.select(texts(docs, text)).mapInArrow(run, schema)
    return out.repartition("token").sortWithinPartitions("token", "key").mapInArrow(keep, schema)


def _possible(n1, p1, n2, p2, percent: int, shared: int):
    """Whether sets that share these tokens, one of their first `shared` common ones, can be similar enough."""
    return (np.minimum(n1, n2) * 100 >= percent * np.maximum(n1, n2)) & (np.minimum(n1 - p1, n2 - p2) + shared - 1 >= _need(n1, n2, percent))


def _starts(token: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))


def _counted(a: list, b: list, least: list) -> pa.RecordBatch:
    """Distinct pairs with their number of lists and the number they need."""
    pairs = np.stack([np.concatenate(a), np.concatenate(b)], 1)
    pairs, first, count = np.unique(pairs, axis=0, return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(count.astype(np.int64)), pa.array(np.concatenate(least)[first].astype(np.int64))], ["a", "b", "lists", "least"])


_PAIRS = "a long, b long, lists long, least long"


def _leader_pairs(lists: DataFrame, percent: int, shared: int) -> DataFrame:
    """Each set with the leader it meets in most lists: one pair a set, linear in the lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None  # token, key, n, pos of the list that the last batch ended in
        for batch in batches:
            tok, _, key, n, pos = (c.to_numpy() for c in batch.columns)
            if not len(tok):
                continue
            a, b, least = [], [], []
            edge = _starts(tok)
            for lo, hi in zip(edge[:-1], edge[1:]):
                first = lo
                if lead is None or lead[0] != tok[lo]:
                    lead, first = (tok[lo], key[lo], n[lo], pos[lo]), lo + 1
                ok = np.flatnonzero(_possible(lead[2], lead[3], n[first:hi], pos[first:hi], percent, shared)) + first
                if len(ok):
                    a.append(key[ok])
                    b.append(np.full(len(ok), lead[1]))
                    least.append(np.minimum(shared, _need(lead[2], n[ok], percent)))
            if a:
                yield _counted(a, b, least)

    ranked = lists.select("token", (-F.col("c") / F.col("n")).alias("lead"), "key", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"))
    pairs = ranked.repartition("token").sortWithinPartitions("token", "lead", "key").mapInArrow(run, _PAIRS)
    return pairs.groupBy("a", "b").agg(F.sum("lists").alias("lists")).groupBy("a").agg(F.max_by("b", F.struct("lists", "b")).alias("b"))


def parity(tokens: np.ndarray) -> bytes:
    """Bitmap of _BITS cells, each the parity of the tokens that fall there.

    Two sets differ in at least as many tokens as their bitmaps differ in cells.
    """
    cells = np.bincount(((tokens >> np.uint64(20)) & np.uint64(_BITS - 1)).astype(np.int64), minlength=_BITS)
    return np.packbits((cells & 1).astype(bool)).tobytes()


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for size[0] steps, then the same for the others."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def _chunks(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices whose sizes add up to about `most` at a time."""
    at, total = 0, np.cumsum(sizes)
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield slice(at, end)
        at = end


def candidates(part: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int, shared: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (k, x), k < x, of one list whose sizes and positions allow a link.

    Rows are sorted by list (`part`), size and position.  A list's sets of one
    size are a block; set k meets the blocks of sizes from its own to the
    largest that its own position allows, and of each only the front, up to the
    last position that allows a link.  The rest of a block is never touched.
    """
    rows = np.arange(len(n))
    fresh = np.ones(len(n), bool)
    fresh[1:] = (part[1:] != part[:-1]) | (n[1:] != n[:-1])
    begin = np.flatnonzero(fresh)
    block = np.cumsum(fresh) - 1
    sizes, of_list = n[begin], np.cumsum(np.concatenate([[0], part[1:] != part[:-1]]))
    largest = np.minimum(n * 100 // percent, (n - pos + shared - 1) * (100 + percent) // percent - n)
    by_size = (of_list[begin] << 32) | sizes
    last = np.searchsorted(by_size, (of_list << 32) | np.maximum(largest, 0), "right")
    count = np.where(largest >= n, last - block, 0)
    by_position = (block << 32) | pos
    for some in _chunks(count, 500_000):
        k = np.repeat(rows[some], count[some])
        b = _ranges(block[some], count[some])
        reach = sizes[b] - _need(n[k], sizes[b], percent) + shared - 1
        end = np.searchsorted(by_position, (b << 32) | np.maximum(reach, 0), "right")
        start = np.maximum(begin[b], k + 1)
        width = np.where(reach >= 0, np.maximum(end - start, 0), 0)
        for few in _chunks(width, 500_000):
            if width[few].any():
                yield np.repeat(k[few], width[few]), _ranges(start[few], width[few])


def _open_pairs(lists: DataFrame, comps: DataFrame, sets: DataFrame, percent: int, shared: int, most: int = 1024) -> DataFrame:
    """All pairs that share enough lists to be similar and are not yet in one component.

    The sets of a list longer than `most` are dealt by hash over shards of about
    that size, and each two shards (and each with itself) meet in a task of
    their own, so no list is one task, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tok, i, j, side, n, pos, key, comp, bits in runs(batches, 10, {9: _BITS // 8}):
            cells = bits.view(np.uint64)
            part = np.zeros(len(tok), np.int64)
            part[1:] = np.cumsum((tok[1:] != tok[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
            a, b, least, held = [], [], [], 0
            for k, x in candidates(part, n, pos, percent, shared):
                ok = (comp[k] != comp[x]) & ((i[k] == j[k]) | (side[k] != side[x]))
                k, x = k[ok], x[ok]
                need = _need(n[k], n[x], percent)
                # Set relation: what differs between the bitmaps differs between the sets.
                ok = np.zeros(len(k), bool)
                for at in range(0, len(k), 50_000):
                    few = slice(at, at + 50_000)
                    apart = np.bitwise_count(cells[k[few]] ^ cells[x[few]]).sum(axis=1, dtype=np.int64)
                    ok[few] = n[k[few]] + n[x[few]] - apart >= 2 * need[few]
                k, x, need = k[ok], x[ok], need[ok]
                if len(k):
                    a.append(np.minimum(key[k], key[x]))
                    b.append(np.maximum(key[k], key[x]))
                    least.append(np.minimum(shared, need))
                    held += len(k)
                    if held > 250_000:
                        yield _counted(a, b, least)
                        a, b, least, held = [], [], [], 0
            if a:
                yield _counted(a, b, least)

    known = lists.join(comps.select(F.col("node").alias("key"), "comp"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    still = known.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count("*") / most).cast("int").alias("shards")).where("lo < hi").select("token", "shards")
    rows = known.join(still, "token").join(sets.select("key", "bits"), "key").withColumn("side", F.pmod(F.xxhash64("key"), "shards").cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda o: F.struct(F.least("side", o).alias("i"), F.greatest("side", o).alias("j")))
    rows = rows.withColumn("meet", F.explode(meets)).select("token", "meet.i", "meet.j", "side", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), "key", "comp", "bits")
    rows = rows.select(F.xxhash64("token", "i", "j").alias("task"), "*")
    pairs = rows.repartition("task").sortWithinPartitions("task", "token", "i", "j", "n", "pos", "key").mapInArrow(run, _PAIRS)
    return pairs.groupBy("a", "b").agg(F.sum("lists").alias("lists"), F.max("least").alias("least")).where("lists >= least").select("a", "b")


def _check(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= percent * (len(both) - common))
        return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("key").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("tokens").alias("y"))
    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), run, "a long, b long")


def _differences(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a: set, b: its leader) that are similar enough, as rows key, lead, n_lead, n_gone, n_new, gone, new.

    gone: the leader's tokens that the set lacks; new: the set's that the leader lacks.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, size, gone, new = [], [], [], []
        for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            less, more = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
            if 100 * (len(y) - len(less)) >= percent * (len(y) + len(more)):
                keep.append(k)
                size.append(len(y))
                gone.append(less)
                new.append(more)
        few = batch.select([0, 1]).take(pa.array(keep, pa.int64()))
        counts = [pa.array(c, pa.int64()) for c in (size, map(len, gone), map(len, new))]
        tokens = [pa.array([t.tobytes() for t in c], pa.binary()) for c in (gone, new)]
        return pa.RecordBatch.from_arrays([*few.columns, *counts, *tokens], ["key", "lead", "n_lead", "n_gone", "n_new", "gone", "new"])

    left = sets.select(F.col("key").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("tokens").alias("y"))
    # Rows that repeat an id repeat its set.
    wide = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return map_arrow(wide, run, "key long, lead long, n_lead long, n_gone long, n_new long, gone binary, new binary").dropDuplicates(["key"])


def _derived(pairs: DataFrame, told: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, told by their leaders' answers as far as these reach.

    A set and its leader are an answer already.  Two sets of one leader differ
    from it in known tokens: how many these are decides most pairs, the tokens
    themselves the others.  Only pairs without a common leader compare whole sets.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for n, least, *tokens in zip(*(batch.column(k).to_pylist() for k in range(2, 8))):
            gone_a, new_a, gone_b, new_b = (np.frombuffer(t, np.uint64) for t in tokens)
            either = len(np.union1d(gone_a, gone_b))
            keep.append(n - either + len(np.intersect1d(new_a, new_b, assume_unique=True)) >= least)
        return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    sizes = told.select("key", "lead", "n_lead", "n_gone", "n_new")
    side = lambda k: sizes.select(F.col("key").alias(k), F.col("lead").alias(f"lead_{k}"), F.col("n_lead").alias(f"n_lead_{k}"), F.col("n_gone").alias(f"gone_{k}"), F.col("n_new").alias(f"new_{k}"))
    wide = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    both = F.expr("2 * n_lead_a - gone_a + new_a - gone_b + new_b")
    least = F.floor((both * percent + 99 + percent) / (100 + percent))
    low = F.expr("n_lead_a - gone_a - gone_b")
    high = F.expr("n_lead_a - greatest(gone_a, gone_b) + least(new_a, new_b)")
    verdict = (
        F.when(F.col("lead_a").eqNullSafe(F.col("b")) | F.col("lead_b").eqNullSafe(F.col("a")), "yes")
        .when(F.coalesce(F.col("lead_a") != F.col("lead_b"), F.lit(True)), "whole")
        .when(low >= least, "yes")
        .when(high < least, "no")
        .otherwise("tokens")
    )
    judged = materialize(wide.select("a", "b", F.col("n_lead_a").alias("n"), least.alias("least"), verdict.alias("verdict")).where("verdict <> 'no'"), "judged")
    tokens = lambda k: told.select(F.col("key").alias(k), F.col("gone").alias(f"gone_{k}"), F.col("new").alias(f"new_{k}"))
    close = judged.where("verdict = 'tokens'").join(tokens("a"), "a").join(tokens("b"), "b").select("a", "b", "n", "least", "gone_a", "new_a", "gone_b", "new_b")
    yes = judged.where("verdict = 'yes'").select("a", "b")
    return yes.unionByName(map_arrow(close, run, "a long, b long")).unionByName(_check(judged.where("verdict = 'whole'").select("a", "b"), sets, percent))


def link(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, shared: int = 3, every: bool = False, most: int = 1024, key_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(members, links): rows (id, n, key) of all documents; verified pairs (a, b) of class keys.

    every: all pairs that are similar enough, else those that join the components.
    most: length from which an index list is dealt over tasks.
    key_bits: hash bits in a class's key before clashes are settled.
    """
    spark = docs.sparkSession
    members, keys, levels = _sets(docs, id_col, text, width, key_bits)
    known = spark.sparkContext.broadcast((levels, keys))
    with_id = docs.where(F.col(id_col).isNotNull())
    raw = materialize(_lists(with_id, known, text, width, percent, shared), "lists")

    # A set that shares fewer tokens than a link needs has no link.
    often = raw.groupBy("key", "n").agg(F.count("*").alias("c")).where(F.col("c") >= F.least(F.lit(shared), F.ceil(F.col("n") * percent / 100))).select("key", "c")
    often = materialize(often, "candidates")
    lists = materialize(raw.join(often, "key"), "candidate-lists")
    discard(raw)

    first = members.where("id is not null and key is not null").groupBy("key").agg(F.min("id").alias("id"))
    needed = first.join(often, "key", "left_semi").select(F.col("id").alias("__id"))

    def tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        name = known.value[1].of
        found = [t for t in shingle_sets(batch.column(0).to_pylist(), width) if len(t)]
        return pa.RecordBatch.from_arrays([pa.array(map(name, found), pa.int64()), pa.array([t.tobytes() for t in found], pa.binary()), pa.array(map(parity, found), pa.binary())], ["key", "tokens", "bits"])

    chosen = with_id.select(F.col(id_col).alias("__id"), texts(docs, text)).join(needed, "__id", "left_semi").select("__utf8")
    sets = materialize(map_arrow(chosen, tokens, "key long, tokens binary, bits binary"), "tokens")

    if every:
        told = materialize(_differences(_leader_pairs(lists, percent, shared), sets, percent), "differences")
        comps = spark.createDataFrame([], "node long, comp long")  # each set by itself, so every pair is open
    else:
        links = materialize(_check(_leader_pairs(lists, percent, shared), sets, percent), "links")
        comps = connected(links)
    rest = materialize(_open_pairs(lists, comps, sets, percent, shared, most), "open-pairs")
    discard(lists)
    links = materialize(_derived(rest, told, sets, percent) if every else links.unionByName(_check(rest, sets, percent)), "links")
    discard(sets)
    return members, links


def classes(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, shared: int = 3, **options) -> DataFrame:
    """One row per document: id, shingles, and the smallest id its links reach."""
    members, links = link(docs, id_col=id_col, text=text, width=width, percent=percent, shared=shared, **options)
    comps = connected(links).select(F.col("node").alias("key"), "comp")
    rep = members.where("id is not null and key is not null").groupBy("key").agg(F.min("id").alias("rep"))
    placed = rep.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    least = placed.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_key = placed.join(least, "comp").select("key", "component_id")
    out = members.join(by_key, "key", "left")
    mine = F.when(F.col("key").isNull() | F.col("id").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), mine.alias("component_id"))


def join(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(members, links): rows (id, n, key) of all documents, and once each pair (a, b), a < b, of different classes that is similar enough.

    Documents link if their classes are equal or linked.
    """
    members, links = link(docs, every=True, **options)
    return members, links.distinct()  # a repeated row's set is there twice


def link_counts(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, shingles, and how many other documents it links with."""
    members, links = join(docs, id_col=id_col, **options)
    sizes = members.where("id is not null and key is not null").groupBy("key").agg(F.countDistinct("id").alias("size"))
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = ways.join(sizes.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.sum("size").alias("near"))
    counts = sizes.join(around, "key", "left").select("key", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    mine = F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0))).cast("long")
    return members.join(counts, "key", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), mine.alias("n_links"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one document of each group, the one with the smallest id; all columns stay.

    A document is an id: rows that repeat a kept id stay together.
    """
    kept = classes(docs, id_col=id_col, text=text, **options).where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__id"]), "left_semi")
