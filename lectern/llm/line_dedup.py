"""Line dedup behind two Bloom filters.

Pass 1 hashes every line's key into a filter of once-seen keys and one of
twice-seen keys.  A cell of the second is set where two tasks, or two documents
of one task, set the same cell of the first, so it never misses a key held by
two documents.  Both have about eight cells a line of the corpus, up to
`max_bits`, as one of them is broadcast; where a corpus fills them, more lines
are suspected and shuffled, and the result is the same.
Pass 2 shuffles only suspected keys (128-bit digests with document ids) for the
exact confirmation and the choice of the first document.
Pass 3 rewrites the texts of documents that lose lines.

Defined results: null or empty text is one empty line; a key's first document
is the smallest id, null the largest of all; rows with equal ids are one
document; all other columns are kept by `rewrite`; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, texts

_CELLS = 1 << 19  # bits of a filter that are merged as one row
_SALTS = 16


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The stripped, lower-cased line, or None where it is too short to judge."""
    key = line.strip().lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def keys(utf8: bytes, min_chars: int) -> set[bytes]:
    out = {line_key(x, min_chars) for x in utf8.split(b"\n")}
    out.discard(None)
    return out


def _places(found: set[bytes], bits: int, hashes: int) -> np.ndarray:
    """Row per key, column per hash: cells of the filter."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in found), np.uint64, len(found))
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + np.arange(hashes, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(bits)).astype(np.int64)


def _has(cells: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which keys have all their cells set in a packed filter."""
    return ((cells[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


def _set(cells: np.ndarray, at: np.ndarray) -> None:
    flat = at.ravel()
    np.bitwise_or.at(cells, flat >> 3, (128 >> (flat & 7)).astype(np.uint8))


def filter_bits(docs: DataFrame, text: str, max_bits: int) -> int:
    """Cells of a filter for all lines of the corpus: a power of two, eight a line at least, max_bits at most."""
    lines = docs.agg(F.sum(F.expr(f"length(`{text}`) - length(replace(`{text}`, '\\n', '')) + 1"))).first()[0] or 0
    return max(_CELLS, min(max_bits, 1 << (8 * lines).bit_length()))


def twice_seen(docs: DataFrame, bits: int, *, text: str = "text", min_chars: int = 10, hashes: int = 4) -> np.ndarray:
    """The filter of keys that two documents may hold: `bits` cells, packed."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for utf8 in batch.column(0).to_pylist():
                if found := keys(utf8, min_chars):
                    at = _places(found, bits, hashes)
                    again = _has(once, at)
                    if again.any():
                        _set(twice, at[again])
                    _set(once, at)
        for k in range(bits // _CELLS):
            part = slice(k * _CELLS // 8, (k + 1) * _CELLS // 8)
            if once[part].any():
                pack = lambda x: zlib.compress(x[part].tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(once)], pa.binary()), pa.array([pack(twice)], pa.binary())], ["cell", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, once, twice = None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([twice.tobytes()], pa.binary())], ["cell", "twice"])

        for batch in batches:
            for k, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                if k != cell:
                    if cell is not None:
                        yield done()
                    cell, once, twice = k, a.copy(), b.copy()
                else:
                    twice |= b | (once & a)
                    once |= a
        if cell is not None:
            yield done()

    filled = docs.select(texts(docs, text)).mapInArrow(fill, "cell int, once binary, twice binary")
    merged = filled.repartition("cell").sortWithinPartitions("cell").mapInArrow(merge, "cell int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for k, twice in merged.collect():  # bits / 8 bytes altogether
        out[k * _CELLS // 8 : (k + 1) * _CELLS // 8] = np.frombuffer(twice, np.uint8)
    return out


def drops(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", min_chars: int = 10, bits: int | None = None, max_bits: int = 1 << 30, hashes: int = 4) -> DataFrame:
    """One row per document that loses lines: id and the digests of their keys.

    bits: cells of a filter, by default enough for the corpus's lines, max_bits (a broadcast of an eighth in bytes) at most.
    """
    bits = filter_bits(docs, text, max_bits) if bits is None else max(_CELLS, bits // _CELLS * _CELLS)
    shared = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, bits, text=text, min_chars=min_chars, hashes=hashes))

    def suspects(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen, rows, out = shared.value, [], []
        for k, utf8 in enumerate(batch.column(1).to_pylist()):
            if found := keys(utf8, min_chars):
                at = _places(found, bits, hashes)
                for key, yes in zip(found, _has(seen, at)):
                    if yes:
                        rows.append(k)
                        out.append(digest(key))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(out, pa.binary())], ["id", "key"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = materialize(map_arrow(docs.select(F.col(id_col).alias("id"), texts(docs, text)), suspects, f"id {kind}, key binary"), "suspects")
    # A null id orders after all others.
    order = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("v"))
    repeated = found.groupBy("key").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first < last").select("key", F.col("first.v").alias("first_id"))
    # A line that very many documents share meets its first document in _SALTS tasks.
    salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return (
        found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int"))
        .join(salted, ["key", "salt"])
        .where(~F.col("id").eqNullSafe(F.col("first_id")))
        .groupBy("id")
        .agg(F.collect_set("key").alias("drop_keys"))
    )


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def cut(utf8: bytes, drop: set[bytes], min_chars: int) -> tuple[bytes, int, int]:
    """Remaining text, lines before, lines dropped."""
    lines = utf8.split(b"\n")
    if not drop:
        return utf8, len(lines), 0
    left = [x for x in lines if (key := line_key(x, min_chars)) is None or digest(key) not in drop]
    return b"\n".join(left), len(lines), len(lines) - len(left)


def _joined(docs: DataFrame, lost: DataFrame, id_col: str, columns: list) -> DataFrame:
    lost = lost.select(F.col("id").alias("__id"), F.col("drop_keys").alias("__drop"))
    return docs.join(lost, docs[id_col].eqNullSafe(lost["__id"]), "left").select(*columns, lost["__drop"])


def digests(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", min_chars: int = 10, **filters) -> DataFrame:
    """One row per document: lines, dropped lines, digest of what is left."""
    lost = drops(docs, id_col=id_col, text=text, min_chars=min_chars, **filters)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, sha = [], [], []
        for utf8, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            left, a, b = cut(utf8, set(drop or ()), min_chars)
            n.append(a)
            gone.append(b)
            sha.append(hashlib.sha256(left).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], [id_col, "n_lines", "n_dropped", "kept_sha256"])

    return map_arrow(_joined(docs, lost, id_col, [docs[id_col], texts(docs, text)]), run, f"`{id_col}` {kind}, n_lines long, n_dropped long, kept_sha256 string")


def rewrite(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", min_chars: int = 10, **filters) -> DataFrame:
    """docs with the repeated lines gone; null texts stay null, other columns as they are."""
    lost = drops(docs, id_col=id_col, text=text, min_chars=min_chars, **filters)
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for value, drop in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            out.append(value if not drop or value is None else cut(value.encode(), set(drop), min_chars)[0].decode())
        cols = list(batch.columns)[:-1]
        cols[at] = pa.array(out, cols[at].type)
        return pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])

    return map_arrow(_joined(docs, lost, id_col, [docs[c] for c in docs.columns]), run, docs.schema)
