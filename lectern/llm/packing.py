"""Best-fit packing of tokenised documents into sequences of bounded length.

1. One pass over the texts tokenises, cuts what is longer than a sequence, and
   numbers the pieces of each length inside its partition.  The pieces (no
   texts) are written once.
2. Lengths are small integers, so documents and gaps range-sorted by length
   form at most `limit` classes each.  A bulk round takes a whole length class:
   its documents sweep the gaps' successors upward, the conflict over a gap is
   settled by rank inside the class, gaps are updated, and the next class
   follows.  The state is bounded by `limit`, not by the corpus, and the result
   equals best-fit decreasing document by document.
3. A piece finds its place from (length, rank): rank is its number inside the
   partition plus the count of that length in earlier partitions, so no length
   class meets in one task.

Defined results: null or empty text is the end token alone; repeated rows are
packed as separate documents; null ids are carried; an empty table packs into
nothing; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize

_tokenizers: dict[str, _Encoder] = {}


# The split pattern and the printable bytes of byte-level BPE.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


class _Encoder:
    """Token ids of a text as little-endian bytes.

    A byte-level BPE tokenizer whose ids follow its merges is run by tiktoken
    from the same vocabulary, which gives the same ids several times faster.
    Texts that name one of its added tokens, and any other kind of tokenizer,
    go through tokenizers itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.fast = _same_in_tiktoken(spec)

    def encode(self, text: str) -> bytes:
        if self.fast is not None and not any(x in text for x in self.added):
            try:
                return np.asarray(self.fast.encode_ordinary(text), "<u4").tobytes()
            except (KeyboardInterrupt, SystemExit):
                raise
            except BaseException:  # its regex engine gives up on very long runs of white space
                pass
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _same_in_tiktoken(spec: dict):
    """The tokenizer as a tiktoken encoding, or None where that would not be the same."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    if model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
        return None
    import tiktoken

    byte_of = {chr(b): b for b in _PRINTABLE}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
    added = {x["content"] for x in spec["added_tokens"]}
    vocab = {k: v for k, v in model["vocab"].items() if k not in added}
    merges = ["".join(x) if isinstance(x, list) else x.replace(" ", "") for x in model["merges"]]
    ids = [vocab[x] for x in merges]
    if sorted(vocab.values()) != list(range(len(vocab))) or ids != sorted(ids) or len(ids) + 256 != len(vocab):
        return None
    ranks = {bytes(byte_of[c] for c in k): v for k, v in vocab.items()}
    return tiktoken.Encoding("byte-level", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


def encoder(path: str) -> _Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = _Encoder(path)
    return _tokenizers[path]


def tokenize(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text: str = "text", limit: int = 1024, end_id: int = 2, chunk: int = 256) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, part, local_rank."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        ranks = np.zeros(limit + 1, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, chunk):
                batch = whole.slice(at, chunk)
                rows, cols = [], ([], [], [], [], [])
                for k, ids in enumerate(map(enc.encode, (x or "" for x in batch.column(1).to_pylist()))):
                    ids += end
                    n = len(ids) // 4
                    first = n % limit or limit
                    start, size = 0, first if n > limit else n
                    piece = 0
                    while start < n:
                        rows.append(k)
                        for c, v in zip(cols, (piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), ranks[size])):
                            c.append(v)
                        ranks[size] += 1
                        start, size, piece = start + size, limit, piece + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4]),
                     pa.array([part] * len(rows), pa.int64()), pa.array(cols[4], pa.int64())],
                    [id_col, "piece", "start", "length", "ids_crc32", "part", "local_rank"],
                )

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, part long, local_rank long"
    return docs.select(id_col, F.col(text).alias("text")).mapInArrow(run, schema)


def match(counts: dict[int, int], limit: int = 1024) -> tuple[dict[int, np.ndarray], int]:
    """Bulk rounds over the length classes, longest first.

    counts: documents by length.  Returns for each length an array of runs
    (first rank, first sequence, documents a sequence, offset), and the number
    of sequences.  Document r of a run is in sequence first + (r - rank) // k
    at offset + (r - rank) % k * length.
    """
    gaps: list[list[list[int]]] = [[] for _ in range(limit + 1)]  # by gap: runs of sequences [first, how many]
    runs: dict[int, np.ndarray] = {}
    opened = 0
    for size in sorted(counts, reverse=True):
        todo, rank, placed, updated = counts[size], 0, [], []
        for gap in range(size, limit + 1):  # successors upward
            if not todo:
                break
            fit, keep = gap // size, []
            for first, many in gaps[gap]:
                if not todo:
                    keep.append([first, many])
                    continue
                full = min(many, todo // fit)
                if full:
                    placed.append((rank, first, fit, limit - gap))
                    rank, todo = rank + full * fit, todo - full * fit
                    updated.append((gap - fit * size, first, full))
                if full < many:
                    if 0 < todo < fit:
                        placed.append((rank, first + full, todo, limit - gap))
                        updated.append((gap - todo * size, first + full, 1))
                        rank, todo, full = rank + todo, 0, full + 1
                    if full < many:
                        keep.append([first + full, many - full])
            gaps[gap] = keep
        if todo:
            fit = limit // size
            full, rest = divmod(todo, fit)
            if full:
                placed.append((rank, opened, fit, 0))
                updated.append((limit - fit * size, opened, full))
            if rest:
                placed.append((rank + full * fit, opened + full, rest, 0))
                updated.append((limit - rest * size, opened + full, 1))
            opened += full + (rest > 0)
        for gap, first, many in updated:
            if gap:
                gaps[gap].append([first, many])
        runs[size] = np.asarray(placed, np.int64)
    return runs, opened


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text: str = "text", limit: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece with its sequence and place there."""
    spark = docs.sparkSession
    pieces = materialize(tokenize(docs, tokenizer, id_col=id_col, text=text, limit=limit, end_id=end_id), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("n")).collect()}  # at most `limit` rows
    shared = spark.sparkContext.broadcast(match(counts, limit)[0])
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "part"]).select(*(c for c in pieces.columns if c not in ("part", "local_rank")), (F.col("base") + F.col("local_rank")).alias("rank"))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
        seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for s in np.unique(size):
            runs, here = shared.value[int(s)], np.flatnonzero(size == s)
            at = np.searchsorted(runs[:, 0], rank[here], "right") - 1
            k = rank[here] - runs[at, 0]
            seq[here] = runs[at, 1] + k // runs[at, 2]
            off[here] = runs[at, 3] + k % runs[at, 2] * s
        cols = batch.schema.names[:-1]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(seq), pa.array(off)], [*cols, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return map_arrow(ranked, place, f"{fields}, sequence_id long, `offset` long")
