"""Interaction preparation: observed rows, frequency filter, id mapping, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df itself; raises where a column is missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def _is_observed(read_aware: bool) -> Column:
    rated = F.col("rating") > 0
    return rated | ((F.col("rating") == 0) & (F.col("is_read") == 1)) if read_aware else rated


def observed(df: DataFrame, read_aware: bool = False) -> DataFrame:
    """Rated rows; read-aware also books read without a rating."""
    return require_columns(df, "user_id", "book_id", "rating", "is_read").where(_is_observed(read_aware))


def counters(df: DataFrame, read_aware: bool = False) -> DataFrame:
    """One row: rows scanned, rated, read without rating (0 unless read-aware), observed."""
    unrated = F.count_if((F.col("rating") == 0) & (F.col("is_read") == 1)) if read_aware else F.lit(0).cast("long")
    return df.agg(
        F.count("*").alias("rows_scanned"),
        F.count_if(F.col("rating") > 0).alias("explicit_rows"),
        unrated.alias("read_unrated_rows"),
        F.count_if(_is_observed(read_aware)).alias("observed_rows"),
    )


def kept_ids(df: DataFrame, column: str, least: int) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(column)


def frequency_filter(df: DataFrame, min_user: int = 5, min_book: int = 10) -> DataFrame:
    """Users and books frequent enough, both counted before either is filtered (one pass)."""
    return df.join(kept_ids(df, "user_id", min_user), "user_id", "left_semi").join(kept_ids(df, "book_id", min_book), "book_id", "left_semi")


def map_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Attach public ids; unmapped books go."""
    require_columns(ids, "book_id", "public_id")
    return df.join(ids.select("book_id", "public_id"), "book_id").select("user_id", "book_id", "public_id", "is_read", "rating", "is_reviewed")


def prep_summary(df: DataFrame, ids: DataFrame, min_user: int = 5, min_book: int = 10) -> DataFrame:
    """Rows written, and sizes of the kept id sets (not of the output)."""
    rows = map_ids(frequency_filter(df, min_user, min_book), ids).agg(F.count("*").alias("rows_written"))
    users = kept_ids(df, "user_id", min_user).agg(F.count("*").alias("users_after_filter"))
    books = kept_ids(df, "book_id", min_book).agg(F.count("*").alias("books_after_filter"))
    return rows.crossJoin(users).crossJoin(books)  # one row each


def liked(df: DataFrame, threshold: int, candidates: DataFrame | None = None) -> DataFrame:
    """Rows rated at least threshold, of candidate books if given."""
    out = df.where(F.col("rating") >= threshold)
    return out if candidates is None else out.join(candidates.select("book_id"), "book_id", "left_semi")
