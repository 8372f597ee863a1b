"""Catalogue building: normalisers, validity, selection under quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Language aliases and markers of placeholder covers.
LANGUAGES = {
    "eng": ["eng", "en", "en-us", "en-gb", "en-ca", "english"],
    "spa": ["spa", "es", "es-mx", "spanish", "español"],
    "ara": ["ara", "ar", "arabic"],
    "por": ["por", "pt", "portuguese", "português"],
    "rus": ["rus", "ru", "russian", "русский"],
    "kaz": ["kaz", "kk", "kazakh", "қазақша"],
}
PLACEHOLDERS = ["s.gr-assets.com/assets/nophoto", "nophoto/book"]


def clean(value: Column, most: int | None = None) -> Column:
    """Without NUL, trimmed, cut."""
    text = F.trim(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("\0"), F.lit("")))
    return text if most is None else F.left(text, F.lit(most))


def language(value: Column, aliases: dict[str, list[str]] | None = None) -> Column:
    """Canonical code of an alias, else null."""
    low = F.lower(clean(value))
    out = F.lit(None).cast("string")
    for code, names in (aliases or LANGUAGES).items():
        out = F.when(low.isin(names), code).otherwise(out)
    return out


def real_cover(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    bad = F.lit(False)
    for mark in PLACEHOLDERS:
        bad = bad | F.contains(low, F.lit(mark))
    return (low != "") & ~bad


def strict_int(value: Column) -> Column:
    """Whole numbers as written; anything else, "12.0" included, is 0."""
    return F.coalesce(F.when(F.trim(value).rlike(r"\A[+-]?[0-9]+\z"), F.trim(value).try_cast("bigint")), F.lit(0)).cast("long")


def lenient_int(value: Column) -> Column:
    """Any number, cut to whole; anything else is 0."""
    return F.coalesce(F.trim(value).try_cast("double").cast("bigint"), F.lit(0)).cast("long")


def genres_sorted(counts: Column) -> Column:
    """Lower-cased names with a count, in alphabetical order."""
    names = F.map_keys(F.map_filter(counts, lambda k, v: v != 0))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(names, lambda x: F.lower(F.trim(x))))), ";")


def _by_count(counts: Column) -> Column:
    """Names with a positive count, most frequent first, ties by name."""
    entries = F.transform(F.map_entries(F.map_filter(counts, lambda k, v: v > 0)), lambda e: F.struct((-e["value"]).alias("c"), e["key"].alias("k")))
    return F.transform(F.array_sort(entries), lambda e: F.trim(e["k"]))


def genres_by_count(counts: Column) -> Column:
    return F.array_join(F.array_distinct(_by_count(counts)), ";")


def genres_with(counts: Column, first: str = "Poetry") -> Column:
    """Names with a count as the map lists them, `first` put in front where it is missing."""
    names = F.transform(F.map_keys(F.map_filter(counts, lambda k, v: v != 0)), F.trim)
    there = F.exists(names, lambda x: F.lower(x) == first.lower())
    return F.array_join(F.array_distinct(F.when(there, names).otherwise(F.concat(F.array(F.lit(first)), names))), ";")


def author_names(authors: Column) -> Column:
    """Joined display names of array<struct<name, author_id>>: the name, else the id."""
    shown = F.transform(authors, lambda a: F.coalesce(F.nullif(F.trim(a["name"]), F.lit("")), a["author_id"]))
    return F.array_join(F.array_distinct(F.filter(shown, lambda x: x.isNotNull() & (x != ""))), ", ")


def model_rank(books: DataFrame) -> DataFrame:
    """Position of each book in the model's id list, which is sorted by id."""
    from .signals import dense_index

    return dense_index(books, "book_id", "model_rank")


def valid(books: DataFrame) -> DataFrame:
    """Rows with a known language, an id, a title and a real cover."""
    named = books.withColumn("language", language(F.col("language")))
    return named.where(F.col("language").isNotNull() & (clean(F.col("book_id")) != "") & (clean(F.col("title")) != "") & real_cover(F.col("cover_url")))


def _selection_order() -> list[Column]:
    return [F.col("model_rank").asc_nulls_last(), F.col("ratings_count").desc(), F.col("average_rating").desc(), F.col("book_id")]


def quota(books: DataFrame, per_language: int, most: int) -> DataFrame:
    """The first per_language of each language, then the best of the rest up to `most`.

    Modelled books (model_rank not null) come first, by rank.
    """
    ranked = books.withColumn("lang_rank", F.row_number().over(Window.partitionBy("language").orderBy(*_selection_order())))
    sure = F.col("lang_rank") <= per_language
    # Fill behind the quota: a bounded top-n, no task ranks the whole catalogue.
    return ranked.orderBy(F.when(sure, 0).otherwise(1), *_selection_order()).limit(most).drop("lang_rank")


def top_per_language(books: DataFrame, n: int = 120) -> DataFrame:
    """Unique by id and by title (the first in file_order stays), then the n most rated per language."""
    once = books.withColumn("r1", F.row_number().over(Window.partitionBy("book_id").orderBy("file_order"))).where("r1 = 1")
    title = once.withColumn("r2", F.row_number().over(Window.partitionBy(F.lower("title")).orderBy("file_order"))).where("r2 = 1")
    order = Window.partitionBy("language").orderBy(F.col("ratings_count").desc(), F.col("average_rating").desc(), "book_id")
    return title.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("r1", "r2")


def linked_expansion(books: DataFrame, works: DataFrame, model_works: DataFrame, least: int = 10, most: int = 3000) -> DataFrame:
    """Books whose work is modelled, or with enough ratings; linked ones first."""
    known = model_works.select("work_id").distinct().withColumn("linked", F.lit(True))
    wide = books.join(works.select("book_id", "work_id"), "book_id", "left").join(known, "work_id", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    kept = wide.where(F.col("linked") | (F.col("ratings_count") >= least))
    return kept.orderBy(F.col("linked").desc(), F.col("ratings_count").desc(), F.col("average_rating").desc(), "title", "book_id").limit(most)


def counts_by(books: DataFrame, *columns: str) -> DataFrame:
    return books.groupBy(*columns).agg(F.count("*").alias("books"))
