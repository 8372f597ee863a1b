"""Splits and seeded samples.

Seeded choice orders by md5(seed:...), so it does not depend on partitioning,
file order or the engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .signals import dense_index


def seeded(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def eligible_users(df: DataFrame, min_likes: int = 5, like: int = 5) -> DataFrame:
    """Users with enough liked rows."""
    return df.where(F.col("rating") >= like).groupBy("user_id").agg(F.count("*").alias("likes")).where(F.col("likes") >= min_likes)


def sample_users(users: DataFrame, n: int = 10_000, seed: int = 42) -> DataFrame:
    """n users in seeded random order."""
    return users.orderBy(seeded(seed, "user_id"), "user_id").limit(n)


def pick_one(df: DataFrame, seed: int = 42) -> DataFrame:
    """One random (user_id, book_id) per user."""
    return df.groupBy("user_id").agg(F.min_by("book_id", F.struct(seeded(seed, "user_id", "book_id"), F.col("book_id"))).alias("book_id"))


def leave_one_liked_out(df: DataFrame, min_likes: int = 5, like: int = 5, max_users: int = 10_000, seed: int = 42, users: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, held): held has one liked (user, book) per user, train none of these rows.

    users: the users to take, if eligible; else max_users are sampled.
    """
    some = eligible_users(df, min_likes, like)
    users = sample_users(some, max_users, seed) if users is None else some.join(users.select("user_id").distinct(), "user_id", "left_semi")
    mine = df.where(F.col("rating") >= like).join(users.select("user_id"), "user_id", "left_semi")
    held = pick_one(mine, seed)
    return df.join(held, ["user_id", "book_id"], "left_anti"), held


def held_rows(df: DataFrame, held: DataFrame) -> DataFrame:
    """The held-out rows with all columns, one per (user, book), highest rating first."""
    order = Window.partitionBy("user_id", "book_id").orderBy(F.col("rating").desc(), F.col("is_read").desc(), F.col("is_reviewed").desc())
    return df.join(held, ["user_id", "book_id"], "left_semi").withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def first_eligible(df: DataFrame, candidates: DataFrame | None, min_likes: int = 5, like: int = 4, max_users: int = 500) -> DataFrame:
    """The first users by id with enough distinct liked books."""
    mine = df.where(F.col("rating") >= like)
    if candidates is not None:
        mine = mine.join(candidates.select("book_id"), "book_id", "left_semi")
    return mine.groupBy("user_id").agg(F.countDistinct("book_id").alias("books")).where(F.col("books") >= min_likes).orderBy("user_id").limit(max_users)


def most_active(df: DataFrame, n: int) -> DataFrame:
    """The n users with most rows, ties by id."""
    return df.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "user_id").limit(n)


def leave_one_out(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """One random hidden item for each user with two or more."""
    many = pairs.groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 2").select("user_id")
    return pick_one(pairs.join(many, "user_id", "left_semi"), seed)


def prime_from(n: int) -> int:
    """The smallest prime that is at least n."""
    p = max(n, 2)
    while any(p % d == 0 for d in range(2, math.isqrt(p) + 1)):
        p += 1
    return p


def _number(text: Column) -> Column:
    """The first 60 bits of text's md5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def negatives(users: DataFrame, items: DataFrame, exclude: DataFrame, per_user: Column | int, seed: int = 42) -> DataFrame:
    """Random items outside `exclude` for each user, without replacement; all there are where fewer than wanted.

    users: (user_id[, want]).  Items take places in seeded order.  Each user
    walks them from a seeded start by a seeded step, modulo the next prime, which
    meets every place once, and takes the first that are not excluded.  The
    walk is no longer than what is wanted, excluded and missing to the prime, so
    the work grows with what is drawn, not with users x items.
    """
    want = F.col("want") if "want" in users.columns else F.lit(per_user)
    places = dense_index(items.select(F.struct(seeded(seed, "book_id").alias("order"), "book_id").alias("item")), "item", "place").select("place", "item.book_id")
    n = places.count()
    prime = prime_from(n)
    mine = users.select("user_id", want.cast("long").alias("want")).where("want > 0")
    known = exclude.groupBy("user_id").agg(F.count("*").alias("known"))
    length = F.least(F.lit(prime), F.col("want") + F.coalesce("known", F.lit(0)) + (prime - n))
    walk = mine.join(known, "user_id", "left").select(
        "user_id", "want",
        (_number(F.concat(F.lit(f"{seed}:start:"), "user_id")) % prime).alias("start"),
        (1 + _number(F.concat(F.lit(f"{seed}:step:"), "user_id")) % (prime - 1)).alias("stride"),
        F.explode(F.sequence(F.lit(0).cast("long"), length - 1)).alias("at"),
    )
    met = walk.withColumn("place", (F.col("start") + F.col("at") * F.col("stride")) % prime).join(places, "place").join(exclude, ["user_id", "book_id"], "left_anti")
    order = Window.partitionBy("user_id").orderBy("at")
    return met.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= F.col("want")).select("user_id", "book_id", "rn")


def unseen_users(pairs: DataFrame, known: DataFrame, least: int = 5, n: int = 1000) -> DataFrame:
    """The first users outside `known` with enough items, re-indexed from 0."""
    outside = pairs.join(known.select("user_id"), "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("n_items")).where(F.col("n_items") >= least)
    first = outside.orderBy("user_id").limit(n)  # bounded, so one ranking task is enough
    return first.withColumn("user_idx", F.row_number().over(Window.orderBy("user_id")) - 1)
