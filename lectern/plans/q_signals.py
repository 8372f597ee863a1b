"""Queries: signals, the matrix, ALS and its evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import als, evaluate, prep, signals, split
from ..sources import views
from ..sources.scratch import written
from ..sources.views import SQL_DENSE
from .base import query, r6, with_

_MEANS = """g AS (SELECT sum(rating)::DOUBLE / count(*) AS global_mean FROM dense WHERE rating > 0),
means AS (SELECT user_id, sum(rating)::BIGINT AS rating_sum, count(*) AS n_ratings, (sum(rating) + 5.0::DOUBLE * max(global_mean)) / (count(*) + 5.0::DOUBLE) AS user_mean FROM dense, g WHERE rating > 0 GROUP BY 1)"""
_SIG = """cen AS (SELECT user_id, book_id, rating - user_mean AS c FROM dense JOIN means USING (user_id) WHERE rating > 0),
sig0 AS (SELECT user_id, book_id, sign(c) * (1.0 + 40.0::DOUBLE * abs(c) / 4.0::DOUBLE) AS signal, 'explicit' AS kind FROM cen WHERE abs(c) > 0
  UNION ALL SELECT user_id, book_id, 1.0, 'weak' FROM dense WHERE rating = 0 AND is_read = 1),
sig AS (SELECT user_id, book_id, signal, kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id, book_id ORDER BY kind, abs(signal) DESC, signal DESC) AS rn FROM sig0) WHERE rn = 1),
act AS (SELECT * FROM sig WHERE user_id IN (SELECT user_id FROM sig WHERE signal > 0 GROUP BY 1 HAVING count(*) >= 5))"""
_COO = """coo AS (SELECT dense_rank() OVER (ORDER BY user_id) - 1 AS user_idx, dense_rank() OVER (ORDER BY book_id) - 1 AS item_idx, signal FROM act)"""
_ALL = (SQL_DENSE, _MEANS, _SIG, _COO)


def _signals(spark, sf):
    """The signals, written, as are the interactions they are made of: each is read several times."""
    df = written(views.interactions_dense(spark, sf).select("user_id", "book_id", "rating", "is_read"), "interactions")
    return written(signals.dedup_signals(signals.centered_signals(df, signals.user_means(df), signals.global_mean(df))), "signals")


def _matrix(spark, sf):
    return signals.coo(signals.active_users(_signals(spark, sf)))


@query("al_01_population", with_(SQL_DENSE, select="SELECT book_id, count(*) AS rows, count(*) FILTER (rating > 0) AS explicit, count(*) FILTER (rating = 0 AND is_read = 1) AS read_unrated FROM dense GROUP BY 1"))
def al_01(spark, sf):
    return signals.book_population(views.interactions_dense(spark, sf))


@query("al_01_global_mean", with_(SQL_DENSE, _MEANS, select="SELECT round(global_mean, 6) AS global_mean FROM g"))
def al_01_mean(spark, sf):
    return signals.global_mean(views.interactions_dense(spark, sf)).select(r6("global_mean").alias("global_mean"))


@query("al_02_shrunk_means", with_(SQL_DENSE, _MEANS, select="SELECT user_id, rating_sum, n_ratings, round(user_mean, 6) AS user_mean FROM means"))
def al_02(spark, sf):
    return signals.user_means(views.interactions_dense(spark, sf)).withColumn("user_mean", r6("user_mean"))


@query("al_03_positive_signals", with_(SQL_DENSE, select="SELECT user_id, book_id, round(1.0 + 40.0::DOUBLE * rating / 5.0, 6) AS signal FROM dense WHERE rating >= 4"))
def al_03(spark, sf):
    return signals.positive_signals(views.interactions_dense(spark, sf)).withColumn("signal", r6("signal"))


@query("al_04_centered_signals", with_(SQL_DENSE, _MEANS, _SIG, select="SELECT user_id, book_id, round(signal, 6) AS signal, kind FROM sig0 WHERE kind = 'explicit'"))
def al_04(spark, sf):
    df = views.interactions_dense(spark, sf)
    return signals.centered_signals(df, signals.user_means(df), signals.global_mean(df), weak=False).withColumn("signal", r6("signal"))


@query("al_05_weak_signals", with_(SQL_DENSE, select="SELECT user_id, book_id, 1.0::DOUBLE AS signal, 'weak' AS kind FROM dense WHERE rating = 0 AND is_read = 1"))
def al_05(spark, sf):
    df = views.interactions_dense(spark, sf)
    return signals.centered_signals(df, signals.user_means(df), signals.global_mean(df)).where("kind = 'weak'")


@query("al_06_dedup_signals", with_(SQL_DENSE, _MEANS, _SIG, select="SELECT user_id, book_id, round(signal, 6) AS signal, kind FROM sig"))
def al_06(spark, sf):
    return _signals(spark, sf).withColumn("signal", r6("signal"))


@query("al_07_active_users", with_(SQL_DENSE, _MEANS, _SIG, select="SELECT user_id, book_id, round(signal, 6) AS signal, kind FROM act"))
def al_07(spark, sf):
    return signals.active_users(_signals(spark, sf)).withColumn("signal", r6("signal"))


@query("al_08_dense_index", with_(SQL_DENSE, select="SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_idx FROM (SELECT DISTINCT user_id FROM dense)"))
def al_08(spark, sf):
    return signals.dense_index(views.interactions_dense(spark, sf), "user_id", "user_idx")


@query("al_09_coo", with_(*_ALL, select="SELECT user_idx, item_idx, round(signal, 6) AS signal FROM coo"))
def al_09(spark, sf):
    return _matrix(spark, sf).withColumn("signal", r6("signal"))


@query("al_09_matrix_stats", with_(*_ALL, select="""SELECT count(DISTINCT user_idx) AS users, count(DISTINCT item_idx) AS items, count(*) AS nnz, count(*) FILTER (signal > 0) AS positive, count(*) FILTER (signal < 0) AS negative,
  round(count(*)::DOUBLE / (count(DISTINCT user_idx) * count(DISTINCT item_idx)), 6) AS density FROM coo"""))
def al_09_stats(spark, sf):
    return signals.matrix_stats(_matrix(spark, sf)).withColumn("density", r6("density"))


@query("al_10_plain_signals", with_(SQL_DENSE, select="""SELECT user_id, book_id, round(1.0 + 40.0::DOUBLE * abs(rating - mean) / 4.0, 6) AS confidence, CAST(rating > mean AS INT) AS preference
  FROM dense JOIN (SELECT user_id, sum(rating)::DOUBLE / count(*) AS mean FROM dense GROUP BY 1) USING (user_id) WHERE rating <> mean AND rating > 0"""))
def al_10(spark, sf):
    return signals.plain_signals(views.interactions_dense(spark, sf)).withColumn("confidence", r6("confidence"))


@query("al_11_compressed_rows", with_(*_ALL, select="""SELECT user_idx AS row, count(*) AS entries, string_agg(item_idx || ':' || CAST(signal > 0 AS INT), ',' ORDER BY item_idx) AS columns, round(sum(abs(signal)), 4) AS confidence FROM coo GROUP BY 1"""))
def al_11(spark, sf):
    rows = signals.compressed_rows(_matrix(spark, sf))
    text = F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["col"].cast("string"), e["preference"].cast("string"))), ",")
    total = F.aggregate("entries", F.lit(0.0), lambda s, e: s + e["confidence"])
    return rows.select("row", F.size("entries").cast("long").alias("entries"), text.alias("columns"), F.round(total, 4).alias("confidence"))


@query("al_12_gram", """SELECT i - 1 AS i, j - 1 AS j, round(sum(embedding[i]::DOUBLE * embedding[j]::DOUBLE), 4) AS value
  FROM embeddings, range(1, 65) a(i), range(1, 65) b(j) GROUP BY 1, 2""")
def al_12(spark, sf):
    g = als.gram(views.table(spark, sf, "embeddings"), "embedding")
    return spark.createDataFrame([(i, j, float(g[i, j])) for i in range(len(g)) for j in range(len(g))], "i long, j long, value double").withColumn("value", F.round("value", 4))


def _model(spark, sf, matrix=None, k=8, iterations=3):
    return als.train(matrix if matrix is not None else _matrix(spark, sf), k=k, reg=1.0, iterations=iterations)


@query("al_13_row_solve")
def al_13(spark, sf):
    """User factors against the embedding table as fixed items; |Ax - b| is tested."""
    fixed = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("factor"))
    m = _matrix(spark, sf).join(fixed.select(F.col("id").alias("item_idx")), "item_idx", "left_semi")
    return als.half_step(m.select(F.col("user_idx").alias("row"), F.col("item_idx").alias("col"), "signal"), fixed, 1.0)


@query("al_14_als_train")
def al_14(spark, sf):
    users, items = _model(spark, sf)
    return users.withColumn("side", F.lit("user")).unionByName(items.withColumn("side", F.lit("item")))


@query("al_15_mllib_comparison")
def al_15(spark, sf):
    m = _matrix(spark, sf).select(F.col("user_idx").cast("int"), F.col("item_idx").cast("int"), "signal")
    users, items = als.als_mllib(m, k=8, reg=1.0, iterations=3)
    return users.withColumn("side", F.lit("user")).unionByName(items.withColumn("side", F.lit("item")))


@query("al_16_retrain")
def al_16(spark, sf):
    """Other hyper-parameters over a stored matrix."""
    return als.train(_matrix(spark, sf), k=4, reg=0.5, iterations=2)[1]


def _vectors(spark, sf):
    """User and item factors from the embeddings table: ids divisible by 20 are the users asked for."""
    e = views.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("factor"))
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("user_id"), "factor"), e.select(F.col("vec_id").alias("book_id"), "factor")


_VEC = """vu AS (SELECT vec_id AS user_id, embedding::DOUBLE[] AS f FROM embeddings WHERE vec_id % 20 = 0),
vi AS (SELECT vec_id AS book_id, embedding::DOUBLE[] AS f FROM embeddings),
vs AS (SELECT vu.user_id, vi.book_id, round(list_inner_product(vu.f, vi.f), 9) AS score FROM vu CROSS JOIN vi {allowed}),
vt AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, book_id) AS rank FROM vs ANTI JOIN (SELECT vec_id - vec_id % 20 AS user_id, vec_id AS book_id FROM embeddings WHERE vec_id % 3 = 0) USING (user_id, book_id))"""


def _stored(spark, sf):
    return views.table(spark, sf, "embeddings").where("vec_id % 3 = 0").select((F.col("vec_id") - F.col("vec_id") % 20).alias("user_id"), F.col("vec_id").alias("book_id"))


@query("al_17_top_items", with_(_VEC.format(allowed=""), select="SELECT user_id, book_id, round(score, 6) AS score, rank FROM vt WHERE rank <= 10"))
def al_17(spark, sf):
    users, items = _vectors(spark, sf)
    return als.top_items(users, items, _stored(spark, sf), 10).select("user_id", "book_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("al_18_similar_items", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS f FROM embeddings),
s AS (SELECT q.vec_id AS source_id, v.vec_id AS book_id, round(list_inner_product(q.f, v.f) / (sqrt(list_inner_product(q.f, q.f)) * sqrt(list_inner_product(v.f, v.f))), 9) AS score FROM v q, v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT source_id, book_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, book_id) AS rank FROM s) WHERE rank <= 10""")
def al_18(spark, sf):
    items = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("book_id"), F.col("embedding").cast("array<double>").alias("factor"))
    return als.similar_items(items, items.where("book_id % 20 = 0")).select("source_id", "book_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


def _embedded_items(spark, sf):
    return views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("book_id"), F.col("embedding").cast("array<double>").alias("factor"))


@query("al_19_fold_in")
def al_19(spark, sf):
    items = _embedded_items(spark, sf)
    rows = _signals(spark, sf).join(items, "book_id", "left_semi").where("user_id % 20 = 0")
    return als.fold_in(rows, items, 1.0)


@query("al_20_allowed_items", with_(_VEC.format(allowed="WHERE vi.book_id % 4 = 0"), select="SELECT user_id, book_id, round(score, 6) AS score, rank FROM vt WHERE rank <= 10"))
def al_20(spark, sf):
    users, items = _vectors(spark, sf)
    out = als.top_items(users, items, _stored(spark, sf), 10, allowed=items.where("book_id % 4 = 0"))
    return out.select("user_id", "book_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("al_21_eligible_rows", with_(*_ALL, select="SELECT user_idx, count(*) AS positives FROM coo WHERE signal > 0 GROUP BY 1 HAVING count(*) >= 5"))
def al_21(spark, sf):
    return signals.eligible_rows(_matrix(spark, sf))


# ---- evaluations ----------------------------------------------------------------------------


def _evaluated(rows, hidden, items, leaky):
    """Fold the remaining rows in, rank the hidden items, and measure."""
    factors = als.fold_in(rows.join(hidden, ["user_id", "book_id"], "left_anti"), items, 1.0)
    stored = rows.join(hidden, ["user_id", "book_id"], "left_anti")
    return evaluate.metrics(als.hidden_ranks(factors, items, stored, hidden, 50)).withColumn("leaky", F.lit(leaky))


def _trained_items(spark, sf, rows):
    """Item factors over book ids, trained on the given signals."""
    m = rows.select(F.col("user_id").alias("user_idx"), F.col("book_id").alias("item_idx"), "signal")
    return als.train(m, k=8, reg=1.0, iterations=2)[1].select(F.col("id").alias("book_id"), "factor")


@query("ev_04_in_matrix_leave_one_out_leaky")
def ev_04(spark, sf):
    rows = signals.active_users(_signals(spark, sf)).select("user_id", "book_id", "signal")
    some = rows.where("user_id % 20 = 0")
    return _evaluated(some, split.pick_one(some.where("signal > 0")), _trained_items(spark, sf, rows), True)


@query("ev_05_interaction_holdout_leaky")
def ev_05(spark, sf):
    df = views.interactions_dense(spark, sf)
    rows = _signals(spark, sf).select("user_id", "book_id", "signal")
    users = split.first_eligible(df, None, like=5)
    hidden = split.pick_one(prep.liked(df, 5).join(users, "user_id", "left_semi"))
    return _evaluated(rows.join(users, "user_id", "left_semi"), hidden, _trained_items(spark, sf, rows), True)


@query("ev_06_true_validation")
def ev_06(spark, sf):
    """The hold-out is made before training, so nothing leaks; unknown users and books are counted."""
    df = views.interactions_dense(spark, sf)
    train, held = split.leave_one_liked_out(df)
    rows = signals.dedup_signals(signals.centered_signals(train, signals.user_means(train), signals.global_mean(train))).select("user_id", "book_id", "signal")
    items = _trained_items(spark, sf, rows)
    users, books = rows.select("user_id").distinct(), items.select("book_id")
    known = held.join(users, "user_id", "left_semi").join(books, "book_id", "left_semi").select("user_id", "book_id")
    out = _evaluated(rows.join(known.select("user_id"), "user_id", "left_semi"), known, items, False)
    unknown = held.join(users, "user_id", "left_anti").agg(F.count("*").alias("skipped_unknown_user")).crossJoin(held.join(books, "book_id", "left_anti").agg(F.count("*").alias("skipped_unknown_book")))
    return out.crossJoin(unknown)
