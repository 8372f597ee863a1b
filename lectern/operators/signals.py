"""From ratings to signed implicit signals, and from signals to a sparse matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def book_population(df: DataFrame) -> DataFrame:
    """Observed, rated and read-unrated rows per book."""
    return df.groupBy("book_id").agg(F.count("*").alias("rows"), F.count_if(F.col("rating") > 0).alias("explicit"), F.count_if((F.col("rating") == 0) & (F.col("is_read") == 1)).alias("read_unrated"))


def global_mean(df: DataFrame) -> DataFrame:
    """One row: mean of the explicit ratings."""
    return df.where("rating > 0").agg((F.sum("rating") / F.count("*")).alias("global_mean"))


def user_means(df: DataFrame, shrinkage: float = 5.0) -> DataFrame:
    """(sum + m * global) / (n + m) over each user's explicit ratings."""
    stats = df.where("rating > 0").groupBy("user_id").agg(F.sum("rating").alias("rating_sum"), F.count("*").alias("n_ratings"))
    mean = (F.col("rating_sum") + F.lit(float(shrinkage)) * F.col("global_mean")) / (F.col("n_ratings") + F.lit(float(shrinkage)))
    return stats.crossJoin(F.broadcast(global_mean(df))).select("user_id", "rating_sum", "n_ratings", mean.alias("user_mean"))


def positive_signals(df: DataFrame, threshold: int = 4, alpha: float = 40.0) -> DataFrame:
    """1 + alpha * rating / 5 for liked rows."""
    return df.where(F.col("rating") >= threshold).select("user_id", "book_id", (1.0 + F.lit(alpha) * F.col("rating") / 5.0).alias("signal"))


def centered_signals(df: DataFrame, means: DataFrame, overall: DataFrame, alpha: float = 40.0, scale: float = 4.0, least: float = 0.0, weak: bool = True) -> DataFrame:
    """Signed signals of rated rows, and weak ones (1.0) of books read without a rating.

    kind: "explicit" or "weak".  A user without a mean is centred on the overall mean.
    """
    rated = df.where("rating > 0").join(means.select("user_id", "user_mean"), "user_id", "left").crossJoin(F.broadcast(overall))
    c = F.col("rating") - F.coalesce("user_mean", "global_mean")
    explicit = rated.select("user_id", "book_id", c.alias("c")).where(F.abs("c") > least)
    explicit = explicit.select("user_id", "book_id", (F.signum("c") * (1.0 + F.lit(alpha) * F.abs("c") / F.lit(scale))).alias("signal"), F.lit("explicit").alias("kind"))
    if not weak:
        return explicit
    return explicit.unionByName(df.where("rating = 0 AND is_read = 1").select("user_id", "book_id", F.lit(1.0).alias("signal"), F.lit("weak").alias("kind")))


def dedup_signals(signals: DataFrame) -> DataFrame:
    """One signal per (user, book): explicit before weak, then the larger magnitude, then the larger value."""
    order = F.struct((F.col("kind") == "explicit").cast("int"), F.abs("signal"), F.col("signal"))
    return signals.groupBy("user_id", "book_id").agg(F.max_by(F.struct("signal", "kind"), order).alias("s")).select("user_id", "book_id", "s.signal", "s.kind")


def active_users(signals: DataFrame, least: int = 5) -> DataFrame:
    """Rows of users with enough positive signals; their negative rows stay."""
    keep = signals.where("signal > 0").groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return signals.join(keep, "user_id", "left_semi")


def dense_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """column -> name: position in the sorted distinct values.

    Counts per range give each range its base, so no task ranks all values.
    """
    spans = written(df.select(column).distinct().repartitionByRange(column).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = spans.groupBy("__part").agg(F.count("*").alias("__n"))  # a row per range
    base = sizes.withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = spans.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(column)) - 1)
    return ranked.join(F.broadcast(base), "__part").select(column, (F.col("__base") + F.col("__at")).alias(name))


def coo(signals: DataFrame) -> DataFrame:
    """(user_idx, item_idx, signal), repeated entries summed."""
    users, items = dense_index(signals, "user_id", "user_idx"), dense_index(signals, "book_id", "item_idx")
    return signals.join(users, "user_id").join(items, "book_id").groupBy("user_idx", "item_idx").agg(F.sum("signal").alias("signal"))


def matrix_stats(matrix: DataFrame) -> DataFrame:
    return matrix.agg(
        F.countDistinct("user_idx").alias("users"), F.countDistinct("item_idx").alias("items"), F.count("*").alias("nnz"),
        F.count_if(F.col("signal") > 0).alias("positive"), F.count_if(F.col("signal") < 0).alias("negative"),
    ).withColumn("density", F.col("nnz") / (F.col("users") * F.col("items")))


def plain_signals(df: DataFrame, alpha: float = 40.0, scale: float = 4.0) -> DataFrame:
    """The variant without shrinkage: means over all rows, rating 0 included, no de-duplication.

    Returns confidence and preference instead of a signed signal.
    """
    means = df.groupBy("user_id").agg((F.sum("rating") / F.count("*")).alias("mean"))
    c = F.col("rating") - F.col("mean")
    return df.join(means, "user_id").where((c != 0) & (F.col("rating") > 0)).select("user_id", "book_id", (1.0 + F.lit(alpha) * F.abs(c) / F.lit(scale)).alias("confidence"), (c > 0).cast("int").alias("preference"))


def compressed_rows(matrix: DataFrame, row: str = "user_idx", col: str = "item_idx") -> DataFrame:
    """row, entries: its (column, confidence, preference) sorted by column."""
    entry = F.struct(F.col(col).alias("col"), F.abs("signal").alias("confidence"), (F.col("signal") > 0).cast("int").alias("preference"))
    return matrix.groupBy(F.col(row).alias("row")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def eligible_rows(matrix: DataFrame, least: int = 5, max_users: int | None = None) -> DataFrame:
    """Users with enough positive entries, in index order."""
    out = matrix.where("signal > 0").groupBy("user_idx").agg(F.count("*").alias("positives")).where(F.col("positives") >= least)
    return out if max_users is None else out.orderBy("user_idx").limit(max_users)


def signal_of(rating: Column, mean: Column, alpha: float = 40.0, scale: float = 4.0) -> Column:
    """Signed signal of one rating against a mean; 0 at the mean."""
    c = rating - mean
    return F.when(c == 0, 0.0).otherwise(F.signum(c) * (1.0 + F.lit(alpha) * F.abs(c) / F.lit(scale)))
