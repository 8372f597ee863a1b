"""Domain views over the warehouse tables: interactions, works, book metadata, text.

Every view is lazy and selects only the columns it needs, so pruning and
filters reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _interactions(spark: SparkSession, sf_dir: str, book: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col(book).alias("book_id"), "l_quantity", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return rows.join(orders, rows.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        "book_id",
        (F.col("l_quantity").cast("int") % 6).alias("rating"),
        (F.col("l_returnflag") != "N").cast("int").alias("is_read"),
        (F.col("l_linestatus") == "O").cast("int").alias("is_reviewed"),
    )


def interactions_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few books, many readers each."""
    return _interactions(spark, sf_dir, "l_suppkey")


def interactions_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many books, few readers each."""
    return _interactions(spark, sf_dir, "l_partkey")


def interactions_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions with a time, the book inside a JSON document."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("book_id"),
        (F.floor("value").cast("int") % 6).alias("rating"),
        (F.col("event_type") != "error").cast("int").alias("is_read"),
        F.lit(0).alias("is_reviewed"),
    )


def book_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions and the work they belong to; every seventh book has none."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("book_id"),
        F.when(F.col("p_partkey") % 7 != 0, F.concat_ws("/", "p_brand", "p_type")).alias("work_id"),
        F.element_at(F.array(*map(F.lit, ("EN", "ru", "De", "fr"))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("language"),
    )


def book_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of books: authors, genres, ratings, pages, language, popularity."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("book_id")).agg(F.count("*").alias("ratings_count"))
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("book_id"),
        F.col("p_name").alias("title"),
        F.array(F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]+", " ")).alias("authors"),
        F.array_sort(F.array_distinct(F.concat(F.split(F.lower("p_name"), " "), F.array(F.lower("p_type"))))).alias("genres"),
        (1 + (F.col("p_partkey") % 41) / 10.0).alias("average_rating"),
        (F.col("p_size") * 20).cast("int").alias("page_count"),
        F.element_at(F.array(*map(F.lit, ("en", "ru", "de", ""))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("language"),
    )
    return part.join(counts, "book_id", "left").withColumn("ratings_count", F.coalesce("ratings_count", F.lit(0)).cast("long"))


# The same views as common table expressions for the oracle.
def _sql_interactions(name: str, book: str) -> str:
    return (
        f"{name} AS (SELECT o_custkey AS user_id, {book} AS book_id, CAST(l_quantity AS INT) % 6 AS rating,"
        " CAST(l_returnflag <> 'N' AS INT) AS is_read, CAST(l_linestatus = 'O' AS INT) AS is_reviewed"
        " FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
    )


SQL_DENSE = _sql_interactions("dense", "l_suppkey")
SQL_SPARSE = _sql_interactions("sparse", "l_partkey")
SQL_EVENTS = (
    "ev AS (SELECT event_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS book_id,"
    " CAST(floor(value) AS INT) % 6 AS rating, CAST(event_type <> 'error' AS INT) AS is_read, 0 AS is_reviewed FROM events)"
)
SQL_WORKS = (
    "works AS (SELECT p_partkey AS book_id, CASE WHEN p_partkey % 7 <> 0 THEN p_brand || '/' || p_type END AS work_id,"
    " CASE p_partkey % 4 WHEN 0 THEN 'EN' WHEN 1 THEN 'ru' WHEN 2 THEN 'De' ELSE 'fr' END AS language FROM part)"
)
SQL_META = (
    "meta AS (SELECT p_partkey AS book_id, p_name AS title, [regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')] AS authors,"
    " list_sort(list_distinct(list_concat(string_split(lower(p_name), ' '), [lower(p_type)]))) AS genres,"
    " 1 + (p_partkey % 41) / 10.0::DOUBLE AS average_rating, CAST(p_size * 20 AS INT) AS page_count,"
    " CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'ru' WHEN 2 THEN 'de' ELSE '' END AS language,"
    " coalesce(n, 0)::BIGINT AS ratings_count FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey)"
)
