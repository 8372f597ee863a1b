"""Relational maintenance as joins: upserts, child replacement, idempotent seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(table: DataFrame, rows: DataFrame, key: str, overwrite: list[str]) -> DataFrame:
    """Listed columns from rows where a key is known, other columns kept; new keys added."""
    new = rows.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in rows.columns if c != key), F.lit(True).alias("__new"))
    both = table.withColumn("__old", F.lit(True)).join(new, key, "full_outer")

    def pick(c: str):
        if c == key or f"__{c}" not in both.columns:
            return F.col(c)
        fresh = F.col("__new") if c in overwrite else F.col("__old").isNull()
        return F.when(fresh, F.col(f"__{c}")).otherwise(F.col(c)).alias(c)

    return both.select(*(pick(c) for c in table.columns))


def replace_children(children: DataFrame, rows: DataFrame, parent: str) -> DataFrame:
    """rows replace all children of the parents they name; titles are cut to 255."""
    fresh = rows.withColumn("title", F.left("title", F.lit(255))) if "title" in rows.columns else rows
    return children.join(rows.select(parent).distinct(), parent, "left_anti").unionByName(fresh)


def insert_missing(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """table and those rows whose key it does not hold."""
    return table.unionByName(rows.join(table.select(*key), list(key), "left_anti"))


def resolve_parent(rows: DataFrame, parents: DataFrame, *, id_col: str, title: str) -> DataFrame:
    """Parent id of each row: by id, else by exact title."""
    by_id = parents.select(F.col(id_col).alias("__id"))
    by_title = parents.groupBy(F.col(title).alias("__title")).agg(F.min(id_col).alias("__by_title"))
    return rows.join(by_id, rows[id_col] == F.col("__id"), "left").join(by_title, rows[title] == F.col("__title"), "left").withColumn("parent_id", F.coalesce("__id", "__by_title")).drop("__id", "__title", "__by_title")


def fill_blank(table: DataFrame, rows: DataFrame, key: str, column: str) -> DataFrame:
    """Set a column only where it is null or blank."""
    new = rows.select(key, F.col(column).alias("__v"))
    return table.join(new, key, "left").withColumn(column, F.coalesce(F.nullif(F.trim(column), F.lit("")), "__v")).drop("__v")


def availability(books: DataFrame, chapters: DataFrame, audio: DataFrame, key: str = "book_id") -> DataFrame:
    """SYNCED with audio, TEXT with chapters, METADATA_ONLY otherwise."""
    flag = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    wide = books.join(flag(chapters, "__text"), key, "left").join(flag(audio, "__audio"), key, "left")
    return wide.withColumn("availability", F.when(F.col("__audio"), "SYNCED").when(F.col("__text"), "TEXT").otherwise("METADATA_ONLY")).drop("__text", "__audio")


def get_or_create(dimension: DataFrame, names: DataFrame, name: str = "name", key: str = "id") -> DataFrame:
    """The dimension with new names under ids that follow its largest, in name order."""
    from .signals import dense_index

    fresh = dense_index(names.select(name).distinct().join(dimension.select(name), name, "left_anti"), name, "__n")
    base = dimension.agg(F.coalesce(F.max(key), F.lit(0)).alias("__base"))
    return dimension.select(key, name).unionByName(fresh.crossJoin(F.broadcast(base)).select((F.col("__base") + F.col("__n") + 1).alias(key), name))


def assert_unique(df: DataFrame, *key: str) -> DataFrame:
    """df itself; raises where a key repeats."""
    if twice := df.groupBy(*key).count().where("count > 1").take(1):
        raise ValueError(f"key {', '.join(key)} repeats: {twice[0]}")
    return df
