"""Edition canonicalisation: one book stands for all editions of a work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def work_map(books: DataFrame) -> DataFrame:
    """Trimmed ids and lower-cased language; rows without a book or work go."""
    out = books.select(F.trim(F.col("book_id").cast("string")).alias("book_id"), F.trim("work_id").alias("work_id"), F.lower(F.trim("language")).alias("language"))
    return out.where((F.col("book_id") != "") & (F.col("work_id") != ""))


def last_work(rows: DataFrame, *order: str) -> DataFrame:
    """One work per book, the last by `order`; blank entries do not count."""
    valid = rows.where(F.col("book_id").isNotNull() & (F.trim("work_id") != ""))
    return valid.groupBy("book_id").agg(F.max_by("work_id", F.struct(*order)).alias("work_id"))


def canonical_map(interactions: DataFrame, works: DataFrame) -> DataFrame:
    """Every observed book with its work's most observed edition; ties go to the smallest id.

    A book without a work stands for itself.
    """
    counts = interactions.groupBy("book_id").agg(F.count("*").alias("observed"))
    keyed = counts.join(works.select("book_id", "work_id"), "book_id", "left")
    keyed = keyed.withColumn("work_key", F.coalesce("work_id", F.concat(F.lit("book:"), F.col("book_id").cast("string"))))
    best = keyed.groupBy("work_key").agg(F.max_by("book_id", F.struct("observed", -F.col("book_id"))).alias("canonical_id"))
    return keyed.join(best, "work_key").select("book_id", "canonical_id", F.coalesce("work_id", F.lit("")).alias("work_id"), "observed")


def rewrite(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace book ids by canonical ones; unmapped ids stay."""
    to = mapping.select("book_id", "canonical_id")
    return df.join(to, "book_id", "left").withColumn("book_id", F.coalesce("canonical_id", "book_id")).drop("canonical_id")


def canonical_validation(validation: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rewritten, one row per user and book, rated rows before unrated ones."""
    order = Window.partitionBy("user_id", "book_id").orderBy(F.col("rating").desc(), F.col("is_read").desc(), F.col("is_reviewed").desc())
    return rewrite(validation, mapping).withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def canonical_train(train: DataFrame, validation: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rewritten training rows without any edition of a held-out (user, book)."""
    held = canonical_validation(validation, mapping).select("user_id", "book_id")
    return rewrite(train, mapping).join(held, ["user_id", "book_id"], "left_anti")


def summary(train: DataFrame, validation: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row of counts about what canonicalisation changed."""
    books = mapping.agg(F.count("*").alias("source_books"), F.countDistinct("canonical_id").alias("canonical_books"), F.count_if(F.col("book_id") != F.col("canonical_id")).alias("changed_books"))
    changed = train.join(mapping.select("book_id", "canonical_id"), "book_id").agg(F.count_if(F.col("book_id") != F.col("canonical_id")).alias("rows_changed"))
    before = train.agg(F.count("*").alias("rows_before"))
    after = canonical_train(train, validation, mapping).agg(F.count("*").alias("rows_after"))
    one = books.crossJoin(changed).crossJoin(before).crossJoin(after)  # one row each
    return one.select("source_books", "canonical_books", "changed_books", "rows_changed", (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"))
