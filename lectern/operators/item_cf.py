"""Item-to-item collaborative filtering.

Pairs are formed inside each user's capped basket, an array, so counting them
takes one shuffle for the baskets and one, after map-side combination, for the
pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prep import liked


def like_counts(df: DataFrame, threshold: int = 4) -> DataFrame:
    """Liked rows (not readers) of each book."""
    return liked(df, threshold).groupBy("book_id").agg(F.count("*").alias("likes"))


def candidate_books(counts: DataFrame, top: int = 5000) -> DataFrame:
    return counts.orderBy(F.col("likes").desc(), "book_id").limit(top)


def baskets(df: DataFrame, candidates: DataFrame | None = None, threshold: int = 4, cap: int = 200) -> DataFrame:
    """user_id, books: distinct liked candidate ids in order, the first `cap` of them."""
    mine = liked(df, threshold, candidates)
    return mine.groupBy("user_id").agg(F.slice(F.sort_array(F.collect_set("book_id")), 1, cap).alias("books"))


def pair_counts(of_users: DataFrame) -> DataFrame:
    """left_id < right_id, co_likes over all baskets."""
    pairs = F.flatten(F.transform("books", lambda x, i: F.transform(F.slice("books", i + 2, F.size("books")), lambda y: F.struct(x.alias("left_id"), y.alias("right_id")))))
    return of_users.select(F.explode(pairs).alias("p")).groupBy("p.left_id", "p.right_id").agg(F.count("*").alias("co_likes"))


def damped_cosine(pairs: DataFrame, counts: DataFrame, min_co_likes: int = 5, damping: int = 50) -> DataFrame:
    """co / sqrt(l * r) * min(co / damping, 1) of pairs seen often enough."""
    left = counts.select(F.col("book_id").alias("left_id"), F.col("likes").alias("left_likes"))
    right = counts.select(F.col("book_id").alias("right_id"), F.col("likes").alias("right_likes"))
    co = F.col("co_likes")
    score = co / F.sqrt(F.col("left_likes") * F.col("right_likes")) * F.least(co / F.lit(float(damping)), F.lit(1.0))
    return pairs.where(co >= min_co_likes).join(left, "left_id").join(right, "right_id").select("left_id", "right_id", score.alias("score"), "co_likes", "left_likes", "right_likes")


def symmetric(scored: DataFrame) -> DataFrame:
    """Both directions of every pair: book_id, similar_id, ..."""
    ahead = scored.select(F.col("left_id").alias("book_id"), F.col("right_id").alias("similar_id"), "score", "co_likes", F.col("left_likes").alias("book_likes"), F.col("right_likes").alias("similar_likes"))
    back = scored.select(F.col("right_id").alias("book_id"), F.col("left_id").alias("similar_id"), "score", "co_likes", F.col("right_likes").alias("book_likes"), F.col("left_likes").alias("similar_likes"))
    return ahead.unionByName(back)


def top_neighbors(edges: DataFrame, n: int = 25) -> DataFrame:
    order = Window.partitionBy("book_id").orderBy(F.col("score").desc(), F.col("co_likes").desc(), "similar_id")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def neighbors(df: DataFrame, threshold: int = 4, top_books: int = 5000, cap: int = 200, min_co_likes: int = 5, damping: int = 50, n: int = 25) -> DataFrame:
    """The item graph end to end."""
    counts = like_counts(df, threshold)
    chosen = candidate_books(counts, top_books)
    scored = damped_cosine(pair_counts(baskets(df, chosen, threshold, cap)), counts, min_co_likes, damping)
    return top_neighbors(symmetric(scored), n)


def similar(edges: DataFrame, book_id: int, limit: int = 20, required: bool = True) -> DataFrame:
    """The strongest neighbours of one book; where it has none it raises if they are required."""
    found = edges.where(F.col("book_id") == book_id).orderBy(F.col("score").desc(), F.col("co_likes").desc(), "similar_id").limit(limit)
    if required and not found.take(1):
        raise LookupError(f"no neighbours for book {book_id}")
    return found


def histories(df: DataFrame, threshold: int = 4) -> tuple[DataFrame, DataFrame]:
    """(read, liked): every book a user has a row for; the highest rating of the liked ones."""
    read = df.select("user_id", "book_id").distinct()
    return read, liked(df, threshold).groupBy("user_id", "book_id").agg(F.max("rating").alias("rating"))


def parse_liked(items: str, spark, user_id: int = 0) -> DataFrame:
    """"id:rating,id" as liked rows; a missing rating is 5."""
    one = spark.range(1).select(F.explode(F.split(F.lit(items), ",")).alias("x"))
    part = F.split(F.trim("x"), ":")
    return one.select(F.lit(user_id).cast("long").alias("user_id"), F.get(part, F.lit(0)).cast("long").alias("book_id"), F.coalesce(F.get(part, F.lit(1)).cast("int"), F.lit(5)).alias("rating"))


def recommend(edges: DataFrame, likes: DataFrame, read: DataFrame, weighted: bool = True, n: int = 50) -> DataFrame:
    """Top n books per user from the neighbours of what they liked, without what they read.

    weighted: a source counts max(rating - 3, 0.5); otherwise every source 1.
    """
    weight = F.greatest(F.col("rating") - 3, F.lit(0.5)) if weighted else F.lit(1.0)
    votes = likes.select("user_id", F.col("book_id").alias("source_id"), weight.alias("weight"))
    reach = votes.join(edges.select(F.col("book_id").alias("source_id"), F.col("similar_id").alias("book_id"), "score", "co_likes"), "source_id")
    summed = reach.groupBy("user_id", "book_id").agg(F.sum(F.col("score") * F.col("weight")).alias("score"), F.count("*").alias("evidence"), F.max("co_likes").alias("max_co_likes"))
    seen = read.select("user_id", "book_id").unionByName(likes.select("user_id", "book_id")).distinct()
    fresh = summed.join(seen, ["user_id", "book_id"], "left_anti")
    # Scores are compared at 9 places: summation order must not decide ties.
    rounded = F.round("score", 9)
    order = [rounded.desc(), F.col("evidence").desc(), *([F.col("max_co_likes").desc()] if weighted else []), F.col("book_id")]
    return fresh.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).where(F.col("rank") <= n)


def universe(edges: DataFrame) -> DataFrame:
    """Books that are source or target of the graph."""
    return edges.select("book_id").unionByName(edges.select(F.col("similar_id").alias("book_id"))).distinct()
