"""Ranking metrics.

MRR@k and the untruncated MRR are two functions with two column names: the
first is 0 beyond rank k, the second never.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

KS = (5, 10, 20, 50)


def hidden_ranks(ranked: DataFrame, hidden: DataFrame) -> DataFrame:
    """Rank of each user's hidden item in their list, null where it is not there."""
    mine = ranked.select("user_id", "book_id", "rank")
    return hidden.select("user_id", "book_id").join(mine, ["user_id", "book_id"], "left")


def hit_rates(ranks: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """users_evaluated and hit_k: share of users whose hidden item is among the first k."""
    return ranks.agg(F.count("*").alias("users_evaluated"), *(F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_{k}") for k in ks))


def mrr_at(ranks: DataFrame, k: int = 50) -> DataFrame:
    """Mean reciprocal rank, 0 beyond k."""
    return ranks.agg(F.round(F.avg(F.when(F.col("rank") <= k, 1.0 / F.col("rank")).otherwise(0.0)), 6).alias(f"mrr_at_{k}"))


def mrr_full(ranks: DataFrame) -> DataFrame:
    """Mean reciprocal rank over all candidates; every hidden item has a rank."""
    return ranks.agg(F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr_full"))


def rank_among(scores: DataFrame, hidden: DataFrame) -> DataFrame:
    """1 + candidates that score higher, or equal with a smaller id, by counting instead of sorting.

    scores: (user_id, book_id, score) of all candidates, the hidden one included.
    """
    mine = scores.join(hidden.select("user_id", "book_id"), ["user_id", "book_id"], "left_semi").select("user_id", F.col("book_id").alias("hidden_id"), F.col("score").alias("hidden_score"))
    better = (F.col("score") > F.col("hidden_score")) | ((F.col("score") == F.col("hidden_score")) & (F.col("book_id") < F.col("hidden_id")))
    return scores.join(mine, "user_id").groupBy("user_id", F.col("hidden_id").alias("book_id")).agg((F.count_if(better) + 1).alias("rank"))


def rank_in_catalog(hidden: DataFrame, items: DataFrame, seen: DataFrame, scored: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(user_id, book_id, rank) of each user's hidden item among all items but those the user has seen.

    The better ones are counted over all items, then the seen among them are
    taken off, so a user and an item never leave the task that joins them.
    scored: a function of pairs (user_id, book_id), to which it adds score.
    """
    # A number of partitions, as the books are little data and much work.
    catalogue = written(items.select("book_id").distinct(), "catalogue").repartition(max(64, 8 * items.sparkSession.sparkContext.defaultParallelism), "book_id")
    pairs = hidden.select("user_id", "book_id").join(catalogue, "book_id", "left_semi").select("user_id", "book_id")
    mine = written(scored(pairs).select("user_id", F.col("book_id").alias("hidden_id"), F.col("score").alias("hidden_score")), "hidden-scores")
    better = F.count_if((F.col("score") > F.col("hidden_score")) | ((F.col("score") == F.col("hidden_score")) & (F.col("book_id") < F.col("hidden_id"))))
    grid = scored(catalogue.crossJoin(F.broadcast(mine.select("user_id")))).join(F.broadcast(mine), "user_id")
    known = seen.select("user_id", "book_id").distinct().join(pairs, ["user_id", "book_id"], "left_anti").join(catalogue, "book_id", "left_semi")
    off = scored(known.select("user_id", "book_id")).join(mine, "user_id").groupBy("user_id").agg(better.alias("off"))
    counted = grid.groupBy("user_id", "hidden_id").agg(better.alias("all"))
    return counted.join(off, "user_id", "left").select("user_id", F.col("hidden_id").alias("book_id"), (F.col("all") - F.coalesce("off", F.lit(0)) + 1).alias("rank"))


def metrics(ranks: DataFrame, ks: tuple[int, ...] = KS, k: int = 50) -> DataFrame:
    """Hit rates and MRR@k in one row."""
    return ranks.agg(
        F.count("*").alias("users_evaluated"),
        *(F.round(F.avg(F.when(F.col("rank") <= x, 1.0).otherwise(0.0)), 6).alias(f"hit_{x}") for x in ks),
        F.round(F.avg(F.when(F.col("rank") <= k, 1.0 / F.col("rank")).otherwise(0.0)), 6).alias(f"mrr_at_{k}"),
    )


def pool_recall(pool: DataFrame, hidden: DataFrame) -> DataFrame:
    """Share of hidden items that are in their user's candidate pool."""
    there = pool.select("user_id", "book_id").distinct().withColumn("found", F.lit(1))
    return hidden.join(there, ["user_id", "book_id"], "left").agg(F.round(F.avg(F.coalesce("found", F.lit(0)).cast("double")), 6).alias("pool_recall"))


def changed_rate(before: DataFrame, after: DataFrame) -> DataFrame:
    """Share of users whose hidden rank differs between two rankings; null equals null."""
    a = before.select("user_id", F.col("rank").alias("before_rank"))
    b = after.select("user_id", F.col("rank").alias("after_rank"))
    return a.join(b, "user_id").agg(F.round(F.avg((~F.col("before_rank").eqNullSafe(F.col("after_rank"))).cast("double")), 6).alias("changed_rate"))


def examples(ranked: DataFrame, users: int = 10, top: int = 10) -> DataFrame:
    """The first users by id with the first items of their lists."""
    first = ranked.select("user_id").distinct().orderBy("user_id").limit(users)
    some = ranked.where(F.col("rank") <= top).join(first, "user_id", "left_semi")
    listed = some.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "book_id"))).alias("items"))
    return listed.select("user_id", F.array_join(F.transform("items", lambda x: x["book_id"].cast("string")), ",").alias("top_items"))


def coverage(meta: DataFrame, wanted: DataFrame, least: float | None = None) -> DataFrame:
    """Shares of wanted books with metadata, genres, authors, rating and pages; raises below `least`."""
    known = wanted.select("book_id").distinct().join(meta, "book_id", "left")
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    out = known.agg(
        F.count("*").alias("books"),
        share(F.col("genres").isNotNull()).alias("with_metadata"),
        share(F.size("genres") > 0).alias("with_genre"),
        share(F.size("authors") > 0).alias("with_author"),
        share(F.col("average_rating") > 0).alias("with_rating"),
        share(F.col("page_count") > 0).alias("with_pages"),
    )
    if least is not None and (found := out.first()["with_metadata"] or 0.0) < least:
        raise ValueError(f"metadata covers {found:.1%} of the books, less than {least:.0%}")
    return out
