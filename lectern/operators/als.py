"""Implicit alternating least squares with signed signals.

A row's factor solves (F'F + sum (c - 1) f f' + lambda I) x = sum c p f, with
confidence c = |signal| and preference p = 1 for positive signals.  Lambda is
not scaled by the row's length, so this is not pyspark.ml's ALS.

A row of any length is cut into chunks of bounded size whose partial sums are
added, so a hot item does not meet in one task.  The fixed side's factors are
broadcast while they are small enough, and joined to the entries beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.arrow import lists, slices
from ..sources.meet import extent, meet
from ..sources.scratch import written

CHUNK = 4096  # entries of a row that are summed together
BLOCK = 2048  # vectors that are multiplied together
ASKERS = 4096  # users a copy of the catalogue is sent to
SLICE = 256  # queries of a block that are ranked together


def matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def vectors(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def _few(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)


def gram(factors: DataFrame, column: str = "factor") -> np.ndarray:
    """F'F of a factor table; only k x k sums leave the tasks, added in two steps."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in slices(batches):
            if batch.num_rows:
                m = matrix(batch.column(0))
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([hash(total.tobytes()) % 16], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in (y.as_py() for y in batch.column(1)):
                total = np.frombuffer(x) if total is None else total + np.frombuffer(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "m"])

    rows = factors.select(column).mapInArrow(part, "slot int, m binary").repartition(16, "slot").mapInArrow(add, "slot int, m binary").collect()
    if not rows:
        return np.zeros((0, 0))
    flat = np.sum([np.frombuffer(r["m"]) for r in rows], axis=0)
    k = int(round(len(flat) ** 0.5))
    return flat.reshape(k, k)


def solve(base: np.ndarray, f: np.ndarray, confidence: np.ndarray, preference: np.ndarray) -> np.ndarray:
    """One row's factor; base is F'F + lambda I, f the factors of its entries."""
    return np.linalg.solve(*_sums(base, f, confidence, preference))


def _sums(base, f, confidence, preference):
    return base + (f * (confidence - 1)[:, None]).T @ f, f.T @ (confidence * preference)


def chunked(entries: DataFrame) -> DataFrame:
    """entries (row, col, signal) with the chunk of its row that each belongs to, and how many the row has."""
    lengths = entries.groupBy("row").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    return entries.join(lengths, "row").select("row", "col", "signal", F.pmod(F.xxhash64("col"), F.col("chunks")).cast("int").alias("chunk"), "chunks")


def grouped(entries: DataFrame) -> DataFrame:
    """entries (row, col, signal) as chunks (row, chunk, chunks, e), e their columns and signals."""
    return chunked(entries).groupBy("row", "chunk", "chunks").agg(F.collect_list(F.struct("col", "signal")).alias("e"))


def half_step(entries: DataFrame, fixed: DataFrame, reg: float, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Solve all rows of entries (row, col, signal), or of chunks of them as `grouped` gives, against fixed (id, factor) -> (id, factor).

    A row of one chunk is solved where it is; only longer ones send their k x k
    sums.  Chunks are read as flat columns, a few megabytes at a time.
    """
    spark = entries.sparkSession
    first = fixed.first()
    k = len(first["factor"]) if first else 0
    split = entries if "e" in entries.columns else grouped(entries if "chunk" in entries.columns else written(entries, "entries"))
    small = fixed.count() * k * 8 <= broadcast_bytes
    if small:
        table = fixed.select("id", "factor").toArrow().combine_chunks()
        order = np.argsort(np.asarray(table["id"]))
        rows = matrix(table["factor"].combine_chunks())[order] if len(table) else np.zeros((0, k))
        g = rows.T @ rows
        shared = spark.sparkContext.broadcast((np.asarray(table["id"])[order], rows))
        chunks = split
    else:
        g = gram(fixed)
        single = split.select("row", "chunk", "chunks", F.explode("e").alias("x")).select("row", "chunk", "chunks", "x.col", "x.signal")
        chunks = single.join(fixed.select(F.col("id").alias("col"), "factor"), "col").groupBy("row", "chunk", "chunks").agg(F.collect_list(F.struct("factor", "signal")).alias("e"))

    base = g + reg * np.eye(k)

    def sums(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        e = batch.column(1)
        ends = np.cumsum(np.asarray(e.value_lengths()))
        at, signals = (e.flatten().field(x) for x in (0, 1))
        signal = signals.to_numpy(zero_copy_only=False).astype(float)
        if small:
            ids, known = shared.value
            place = np.searchsorted(ids, at.to_numpy(zero_copy_only=False))
        else:
            known, place = matrix(at), np.arange(len(at))
        for first, end in zip([0, *ends], ends):
            s = signal[first:end]
            yield _sums(np.zeros((k, k)), known[place[first:end]], np.abs(s), (s > 0).astype(float))

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            a, b = map(np.array, zip(*sums(batch)))
            x = np.linalg.solve(base + a, b[:, :, None])[:, :, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors(x)], ["id", "factor"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            out = [np.concatenate([a.ravel(), b]).tobytes() for a, b in sums(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["row", "sums"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, total = None, None

        def done():
            x = np.linalg.solve(base + total[: k * k].reshape(k, k), total[k * k :])
            return pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([x.tolist()], pa.list_(pa.float64()))], ["id", "factor"])

        for batch in batches:
            for r, s in ((x.as_py(), y.as_py()) for x, y in zip(*batch.columns)):
                if r != row:
                    if row is not None:
                        yield done()
                    row, total = r, np.frombuffer(s).copy()
                else:
                    total += np.frombuffer(s)
        if row is not None:
            yield done()

    parts = lambda some: chunks.where(some).select(F.col("row").cast("long").alias("row"), "e")
    whole = parts("chunks = 1").mapInArrow(direct, "id long, factor array<double>")
    partial = parts("chunks > 1").mapInArrow(run, "row long, sums binary")
    return whole.unionByName(partial.repartition("row").sortWithinPartitions("row").mapInArrow(finish, "id long, factor array<double>"))


def initial(items: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """N(0, 0.01) factors that depend on the seed and the id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            f = [np.random.default_rng([seed, i]).normal(0, 0.01, k).tolist() for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.list_(pa.float64()))], ["id", "factor"])

    return items.select(F.col("id").cast("long").alias("id")).mapInArrow(run, "id long, factor array<double>")


def train(matrix: DataFrame, k: int = 64, reg: float = 0.1, iterations: int = 15, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(user factors, item factors) of a COO matrix (user_idx, item_idx, signal).

    The matrix is written once for each side, its rows as chunks; a half step
    reads them as they are and shuffles none while the fixed side is broadcast.
    """
    by_user = written(grouped(matrix.select(F.col("user_idx").alias("row"), F.col("item_idx").alias("col"), "signal")), "by-user")
    by_item = written(grouped(by_user.select("row", F.explode("e").alias("x")).select(F.col("x.col").alias("row"), F.col("row").alias("col"), "x.signal")), "by-item")
    items = written(initial(by_item.select(F.col("row").alias("id")).distinct(), k, seed), "items")
    users = None
    for _ in range(iterations):
        users = written(half_step(by_user, items, reg), "users")  # in the shared folder, so a lost executor costs one half step
        items = written(half_step(by_item, users, reg), "items")
    return users, items


def loss(matrix: DataFrame, users: DataFrame, items: DataFrame, reg: float) -> float:
    """Weighted squared error over all cells plus the penalty."""
    dot = F.aggregate(F.zip_with("uf", "vf", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    cells = matrix.join(users.select(F.col("id").alias("user_idx"), F.col("factor").alias("uf")), "user_idx").join(items.select(F.col("id").alias("item_idx"), F.col("factor").alias("vf")), "item_idx").withColumn("s", dot)
    c, p = F.abs("signal"), (F.col("signal") > 0).cast("double")
    seen = cells.agg(F.sum(c * (p - F.col("s")) ** 2 - F.col("s") ** 2)).first()[0] or 0.0
    gu, gi = gram(users), gram(items)
    return float(seen + np.sum(gu * gi) + reg * (np.trace(gu) + np.trace(gi)))


def dot(a: str, b: str):
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _best_of_blocks(queries: DataFrame, items: DataFrame, n: int, unit: bool = False) -> DataFrame:
    """(query, book_id, score): of every block of items the best n + extra for each query, ties at the end included.

    queries (query, extra, factor), items (book_id, factor); unit: factors are
    scaled to norm 1, 0 stays 0.  Groups of queries meet shards of the catalogue:
    a task holds its queries and reads its shard a block at a time, each block one
    matrix product.  Items of one vector have one score, so a vector is multiplied
    once however many items share it.  A task remembers for each query the score
    that enough items have reached, and gives only what reaches it in later blocks.
    """
    asked = written(queries.select(F.array(F.col("query").cast("long"), F.col("extra").cast("long")).alias("ids"), "factor"), "queries")
    shelf = written(items.groupBy("factor").agg(F.sort_array(F.collect_list(F.col("book_id").cast("long"))).alias("ids")).select("ids", "factor"), "catalogue")
    groups = max(1, -(-asked.count() // BLOCK))
    shards = max(1, min(-(-shelf.count() // BLOCK), -(-2 * asked.sparkSession.sparkContext.defaultParallelism // groups)))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt_to = lambda k: F.pmod(F.xxhash64("ids"), F.lit(k)).cast("int")
    theirs = asked.select(dealt_to(groups).alias("group"), every(shards).alias("shard"), F.lit(0).alias("kind"), "ids", F.col("factor").cast("array<double>").alias("factor"))
    ours = shelf.select(every(groups).alias("group"), dealt_to(shards).alias("shard"), F.lit(1).alias("kind"), "ids", F.col("factor").cast("array<double>").alias("factor"))
    met = theirs.unionByName(ours).withColumn("at", F.col("group") * shards + F.col("shard"))
    pairs = met.repartitionById(groups * shards, "at").sortWithinPartitions("kind").select("kind", "ids", "factor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, floor = [], None
        for batch in batches:
            asked = int((np.asarray(batch.column(0)) == 0).sum())  # queries come first
            if asked:
                waiting.append(batch.slice(0, asked))
            if not waiting:
                return
            for at in range(asked, batch.num_rows, BLOCK):
                if floor is None:
                    ids, extra = (np.concatenate([x.column(1).flatten().to_numpy(zero_copy_only=False) for x in waiting]).reshape(-1, 2)).T
                    m = np.concatenate([matrix(x.column(2)) for x in waiting])
                    m, floor = _unit(m) if unit else m, np.full(len(ids), -np.inf)
                part = batch.slice(at, BLOCK)
                item_m = matrix(part.column(2))
                item_m = _unit(item_m) if unit else item_m
                counts = np.asarray(part.column(1).value_lengths()).astype(np.int64)
                item_ids, starts = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(counts) - counts
                for a in range(0, len(ids), SLICE):
                    some = slice(a, a + SLICE)
                    scores, need = m[some] @ item_m.T, n + extra[some]
                    least = _reached(scores, counts, need)
                    floor[some] = np.maximum(floor[some], least)
                    row, col = np.nonzero(scores >= floor[some][:, None] - 2e-9)  # equal at 9 places
                    size = np.minimum(counts[col], need[row])  # of one vector the smallest ids come first
                    ends = np.cumsum(size)
                    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[some][row], size)), pa.array(item_ids[np.repeat(starts[col], size) + place]), pa.array(np.repeat(scores[row, col], size))], ["query", "book_id", "score"])

    found = pairs.mapInArrow(run, "query long, book_id long, score double")
    return found.withColumn("score", F.round("score", 9) + 0.0)


def _reached(scores: np.ndarray, counts: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For each row the score that its best `need` items reach, -inf where there are fewer; column k stands for counts[k] items."""
    rows = np.arange(len(scores))
    if counts.max(initial=1) == 1:
        least = np.full(len(scores), -np.inf)
        for k in np.unique(need[need <= len(counts)]):
            of = need == k
            least[of] = np.partition(scores[of], len(counts) - k, axis=1)[:, len(counts) - k]
        return least
    order = np.argsort(-scores, axis=1)
    short = (np.cumsum(counts[order], axis=1) < need[:, None]).sum(axis=1)
    return np.where(short < len(counts), scores[rows, order[rows, np.minimum(short, len(counts) - 1)]], -np.inf)


def top_items(users: DataFrame, items: DataFrame, stored: DataFrame, n: int = 50, allowed: DataFrame | None = None) -> DataFrame:
    """Best n items per user by dot product, without any stored item, whatever its sign.

    users (user_id, factor), items (book_id, factor), stored (user_id, book_id).
    Users of one vector share one list, as long as n and the most any of them has
    stored; each takes its first n and as many more as it has stored, and only
    those meet the stored ones.
    """
    if allowed is not None:
        items = items.join(allowed.select("book_id"), "book_id", "left_semi")
    mine = stored.select("user_id", "book_id").distinct()
    held = users.join(mine.groupBy("user_id").agg(F.count("*").alias("extra")), "user_id", "left").withColumn("extra", F.coalesce("extra", F.lit(0)))
    lists = written(held.groupBy("factor").agg(F.min("user_id").alias("query"), F.max("extra").alias("extra"), F.collect_list(F.struct("user_id", "extra")).alias("members")), "lists")
    best = _best_of_blocks(lists.select("query", "extra", "factor"), items, n)
    listed = best.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "book_id")))
    members = lists.select("query", F.explode("members").alias("u")).select("query", "u.user_id", (F.col("u.extra") + n).alias("most"))
    reach = listed.join(members, "query").where("place <= most").select("user_id", "book_id", "score")
    fresh = reach.join(mine, ["user_id", "book_id"], "left_anti")
    order = Window.partitionBy("user_id").orderBy(F.col("score").desc(), "book_id")
    return fresh.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hidden_ranks(users: DataFrame, items: DataFrame, stored: DataFrame, hidden: DataFrame, n: int = 50) -> DataFrame:
    """(user_id, book_id, rank): the place of hidden items in their users' top_items, null where it is beyond n or unknown.

    Better items are counted a block of the catalogue at a time, and a user who
    has met more of them than n and all stored ones make is done; no list is formed.
    """
    asked = hidden.select("user_id", F.col("book_id").cast("long").alias("book_id"))
    target = items.select(F.col("book_id").cast("long").alias("book_id"), F.col("factor").cast("array<double>").alias("target"))
    mine = stored.select("user_id", F.col("book_id").cast("long").alias("book_id")).distinct()
    known = mine.groupBy("user_id").agg(F.collect_list("book_id").alias("gone"))
    asking = asked.join(users.select("user_id", F.col("factor").cast("array<double>").alias("factor")), "user_id").join(target, "book_id").join(mine, ["user_id", "book_id"], "left_anti").join(known, "user_id", "left")
    asking = written(asking.select("user_id", "book_id", "factor", "target", "gone"), "asking")
    groups, _ = extent(asking, ASKERS)

    def best(a: dict, s: dict) -> Iterator[tuple]:
        ids, order = np.unique(np.asarray(s["id"]), return_index=True)
        m = matrix(s["item"])[order]
        users, own = np.asarray(a["user_id"]), np.asarray(a["book_id"])
        f, gone, starts, sizes = matrix(a["factor"]), *lists(a["gone"])
        score = np.einsum("ij,ij->i", f, matrix(a["target"]))
        nine, seen, taken = np.round(score, 9), np.zeros(len(users), np.int64), np.repeat(np.arange(len(users)), sizes)

        def better(scores, which, books):
            above = scores > score[which] + 2e-9
            near = np.nonzero(np.abs(scores - score[which]) <= 2e-9)  # compared at 9 places, ties by id
            own_at = np.broadcast_to(which, scores.shape)[near]
            points = np.round(scores[near], 9)
            above[near] = (points > nine[own_at]) | ((points == nine[own_at]) & (np.broadcast_to(books, scores.shape)[near] < own[own_at]))
            return above

        open_, at = np.arange(len(users)), 0
        while at < len(ids) and len(open_):
            end = at + BLOCK
            for k in range(0, len(open_), SLICE):
                some = open_[k : k + SLICE]
                seen[some] += better(f[some] @ m[at:end].T, some[:, None], ids[None, at:end]).sum(axis=1)
            open_, at = open_[seen[open_] < n + sizes[open_]], end
        place = np.minimum(np.searchsorted(ids, gone), max(len(ids) - 1, 0))
        there = ids[place] == gone
        for k in range(0, len(gone), 1 << 16):  # stored items are no rivals
            part = slice(k, k + (1 << 16))
            off = better(np.einsum("ij,ij->i", f[taken[part]], m[place[part]]), taken[part], gone[part]) & there[part]
            seen -= np.bincount(taken[part][off], minlength=len(users))
        good = seen < n
        yield users[good], own[good], (seen[good] + 1).astype(np.int32)

    kind = asking.schema["user_id"].dataType.simpleString()
    shelves = items.select(F.col("book_id").cast("long").alias("id"), F.col("factor").cast("array<double>").alias("item"))
    ranks = meet(asking, shelves, groups, best, f"user_id {kind}, book_id bigint, rank int", "user_id")
    return hidden.select("user_id", "book_id").join(ranks, ["user_id", "book_id"], "left")


def similar_items(items: DataFrame, queries: DataFrame, n: int = 10) -> DataFrame:
    """Best n items by cosine for each query item; 0 where a norm is 0, itself excluded."""
    q = queries.select("book_id").join(items, "book_id").select(F.col("book_id").alias("query"), F.lit(1).alias("extra"), "factor")
    scored = _best_of_blocks(q, items, n, unit=True).withColumnRenamed("query", "source_id").where("source_id <> book_id")
    order = Window.partitionBy("source_id").orderBy(F.col("score").desc(), "book_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def fold_in(rows: DataFrame, items: DataFrame, reg: float) -> DataFrame:
    """Factors of new or changed user rows (user_id, book_id, signal) with the items (book_id, factor) fixed."""
    entries = rows.select(F.col("user_id").alias("row"), F.col("book_id").alias("col"), "signal")
    fixed = written(items.select(F.col("book_id").alias("id"), "factor"), "fixed")
    return half_step(entries, fixed, reg).select(F.col("id").alias("user_id"), "factor")


def als_mllib(matrix: DataFrame, k: int = 64, reg: float = 0.1, iterations: int = 15, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """pyspark.ml's implicit ALS, a different model (lambda scaled by row length), for comparison only."""
    from pyspark.ml.recommendation import ALS

    r = F.when(F.abs("signal") <= 1, F.signum("signal") * 1e-6).otherwise(F.signum("signal") * (F.abs("signal") - 1))
    fitted = ALS(rank=k, regParam=reg, maxIter=iterations, implicitPrefs=True, alpha=1.0, seed=seed, userCol="user_idx", itemCol="item_idx", ratingCol="r").fit(matrix.withColumn("r", r))
    return fitted.userFactors.select("id", F.col("features").alias("factor")), fitted.itemFactors.select("id", F.col("features").alias("factor"))
