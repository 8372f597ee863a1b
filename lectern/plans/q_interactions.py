"""Queries: interaction preparation, canonicalisation, splits, item CF and its metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import canonical, evaluate, item_cf, prep, split
from ..sources import views
from ..sources.scratch import written
from ..sources.views import SQL_DENSE, SQL_EVENTS, SQL_SPARSE, SQL_WORKS
from .base import query, r6, with_

# ---- preparation ----------------------------------------------------------------------------


def _ids(spark, sf):
    part = views.table(spark, sf, "part")
    return part.where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("book_id"), (F.col("p_partkey") + 1_000_000).alias("public_id"))


_SQL_IDS = "ids AS (SELECT p_partkey AS book_id, p_partkey + 1000000 AS public_id FROM part WHERE p_partkey % 10 <> 0)"
_FREQ = """freq AS (SELECT * FROM sparse WHERE user_id IN (SELECT user_id FROM sparse GROUP BY 1 HAVING count(*) >= 5)
  AND book_id IN (SELECT book_id FROM sparse GROUP BY 1 HAVING count(*) >= 10))"""


@query("in_01_observed", with_(SQL_SPARSE, select="SELECT * FROM sparse WHERE rating > 0 OR (rating = 0 AND is_read = 1)"))
def in_01(spark, sf):
    return prep.observed(views.interactions_sparse(spark, sf), read_aware=True)


@query("in_01_observed_explicit", with_(SQL_SPARSE, select="SELECT * FROM sparse WHERE rating > 0"))
def in_01_explicit(spark, sf):
    return prep.observed(views.interactions_sparse(spark, sf))


@query("in_02_counters", with_(SQL_SPARSE, select="""SELECT count(*) AS rows_scanned, count(*) FILTER (rating > 0) AS explicit_rows,
  count(*) FILTER (rating = 0 AND is_read = 1) AS read_unrated_rows, count(*) FILTER (rating > 0 OR (rating = 0 AND is_read = 1)) AS observed_rows FROM sparse"""))
def in_02(spark, sf):
    return prep.counters(views.interactions_sparse(spark, sf), read_aware=True)


@query("in_03_frequency_filter", with_(SQL_SPARSE, _FREQ, select="SELECT * FROM freq"))
def in_03(spark, sf):
    return prep.frequency_filter(views.interactions_sparse(spark, sf)).select("user_id", "book_id", "rating", "is_read", "is_reviewed")


@query("in_04_map_ids", with_(SQL_SPARSE, _SQL_IDS, select="SELECT user_id, book_id, public_id, is_read, rating, is_reviewed FROM sparse JOIN ids USING (book_id)"))
def in_04(spark, sf):
    return prep.map_ids(views.interactions_sparse(spark, sf), _ids(spark, sf))


@query("in_05_prep_summary", with_(SQL_SPARSE, _SQL_IDS, _FREQ, select="""SELECT (SELECT count(*) FROM freq JOIN ids USING (book_id)) AS rows_written,
  (SELECT count(*) FROM (SELECT user_id FROM sparse GROUP BY 1 HAVING count(*) >= 5)) AS users_after_filter,
  (SELECT count(*) FROM (SELECT book_id FROM sparse GROUP BY 1 HAVING count(*) >= 10)) AS books_after_filter"""))
def in_05(spark, sf):
    return prep.prep_summary(views.interactions_sparse(spark, sf), _ids(spark, sf))


@query("in_06_work_map", with_(SQL_WORKS, select="SELECT trim(book_id::VARCHAR) AS book_id, trim(work_id) AS work_id, lower(trim(language)) AS language FROM works WHERE work_id IS NOT NULL AND trim(work_id) <> ''"))
def in_06(spark, sf):
    return canonical.work_map(views.book_works(spark, sf))


@query("in_07_last_work", """SELECT l_partkey AS book_id, arg_max(w, (l_orderkey, l_linenumber, w)) AS work_id FROM
  (SELECT l_partkey, l_orderkey, l_linenumber, CASE WHEN l_suppkey % 11 = 0 THEN ' ' ELSE l_suppkey::VARCHAR END AS w FROM lineitem) WHERE trim(w) <> '' GROUP BY 1""")
def in_07(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("book_id"), "l_orderkey", "l_linenumber", F.when(F.col("l_suppkey") % 11 == 0, " ").otherwise(F.col("l_suppkey").cast("string")).alias("work_id"))
    return canonical.last_work(rows, "l_orderkey", "l_linenumber", "work_id")


_CANON = """cnt AS (SELECT book_id, count(*) AS observed FROM sparse GROUP BY 1),
keyed AS (SELECT cnt.*, work_id, coalesce(work_id, 'book:' || book_id) AS work_key FROM cnt LEFT JOIN works USING (book_id)),
canon AS (SELECT book_id, first_value(book_id) OVER (PARTITION BY work_key ORDER BY observed DESC, book_id) AS canonical_id, coalesce(work_id, '') AS work_id, observed FROM keyed)"""


def _canon(spark, sf):
    return canonical.canonical_map(views.interactions_sparse(spark, sf), views.book_works(spark, sf))


@query("in_08_canonical_choice", with_(SQL_SPARSE, SQL_WORKS, _CANON, select="SELECT DISTINCT work_id, canonical_id FROM canon WHERE work_id <> ''"))
def in_08(spark, sf):
    return _canon(spark, sf).where("work_id <> ''").select("work_id", "canonical_id").distinct()


@query("in_09_canonical_map", with_(SQL_SPARSE, SQL_WORKS, _CANON, select="SELECT * FROM canon"))
def in_09(spark, sf):
    return _canon(spark, sf)


@query("in_10_rewrite", with_(SQL_SPARSE, SQL_WORKS, _CANON, select="""SELECT user_id, coalesce(canonical_id, s.book_id) AS book_id, rating, is_read, is_reviewed
  FROM sparse s LEFT JOIN (SELECT book_id, canonical_id FROM canon WHERE book_id % 3 <> 0) c USING (book_id)"""))
def in_10(spark, sf):
    return canonical.rewrite(views.interactions_sparse(spark, sf), _canon(spark, sf).where("book_id % 3 <> 0")).select("user_id", "book_id", "rating", "is_read", "is_reviewed")


_HELD = """likes AS (SELECT user_id FROM {v} WHERE rating >= 5 GROUP BY 1 HAVING count(*) >= {m}),
sampled AS (SELECT user_id FROM likes ORDER BY md5('42:' || user_id), user_id LIMIT {n}),
held AS (SELECT user_id, arg_min(book_id, (md5('42:' || user_id || ':' || book_id), book_id)) AS book_id FROM {v} WHERE rating >= 5 AND user_id IN (FROM sampled) GROUP BY 1)"""
_HELD_SPARSE = _HELD.format(v="sparse", m=5, n=10000)
_HELD_DENSE = _HELD.format(v="dense", m=5, n=10000)
_HELD_ROWS = """hrows AS (SELECT user_id, book_id, rating, is_read, is_reviewed FROM (SELECT d.*, row_number() OVER (PARTITION BY user_id, book_id ORDER BY rating DESC, is_read DESC, is_reviewed DESC) AS rn
  FROM {v} d SEMI JOIN held USING (user_id, book_id)) WHERE rn = 1)"""
_CVAL = """cval AS (SELECT user_id, book_id, rating, is_read, is_reviewed FROM (SELECT *, row_number() OVER (PARTITION BY user_id, book_id ORDER BY rating DESC, is_read DESC, is_reviewed DESC) AS rn FROM
  (SELECT user_id, coalesce(canonical_id, h.book_id) AS book_id, rating, is_read, is_reviewed FROM hrows h LEFT JOIN canon USING (book_id))) WHERE rn = 1),
ctrain AS (SELECT * FROM (SELECT user_id, coalesce(canonical_id, s.book_id) AS book_id, rating, is_read, is_reviewed FROM (SELECT * FROM sparse ANTI JOIN held USING (user_id, book_id)) s LEFT JOIN canon USING (book_id)) ANTI JOIN cval USING (user_id, book_id))"""
_CANON_SPLIT = (SQL_SPARSE, SQL_WORKS, _CANON, _HELD_SPARSE, _HELD_ROWS.format(v="sparse"), _CVAL)


def _sparse_split(spark, sf):
    df = views.interactions_sparse(spark, sf)
    train, held = split.leave_one_liked_out(df)
    return train, split.held_rows(df, held), _canon(spark, sf)


@query("in_11_canonical_validation", with_(*_CANON_SPLIT, select="SELECT * FROM cval"))
def in_11(spark, sf):
    _, held, canon = _sparse_split(spark, sf)
    return canonical.canonical_validation(held, canon).select("user_id", "book_id", "rating", "is_read", "is_reviewed")


@query("in_12_canonical_train", with_(*_CANON_SPLIT, select="SELECT * FROM ctrain"))
def in_12(spark, sf):
    train, held, canon = _sparse_split(spark, sf)
    return canonical.canonical_train(train, held, canon).select("user_id", "book_id", "rating", "is_read", "is_reviewed")


@query("in_13_canonical_summary", with_(*_CANON_SPLIT, select="""SELECT count(*) AS source_books, count(DISTINCT canonical_id) AS canonical_books, count(*) FILTER (book_id <> canonical_id) AS changed_books,
  (SELECT count(*) FROM sparse ANTI JOIN held USING (user_id, book_id) JOIN canon USING (book_id) WHERE canonical_id <> book_id) AS rows_changed,
  (SELECT count(*) FROM sparse ANTI JOIN held USING (user_id, book_id)) - (SELECT count(*) FROM ctrain) AS rows_removed FROM canon"""))
def in_13(spark, sf):
    train, held, canon = _sparse_split(spark, sf)
    return canonical.summary(train, held, canon)


_LIKES = "likecnt AS (SELECT book_id, count(*) AS likes FROM dense WHERE rating >= 4 GROUP BY 1)"


@query("in_14_liked", with_(SQL_DENSE, _LIKES, select="SELECT * FROM dense WHERE rating >= 5 AND book_id IN (SELECT book_id FROM likecnt ORDER BY likes DESC, book_id LIMIT 20)"))
def in_14(spark, sf):
    df = views.interactions_dense(spark, sf)
    return prep.liked(df, 5, item_cf.candidate_books(item_cf.like_counts(df), 20)).select("user_id", "book_id", "rating", "is_read", "is_reviewed")


@query("in_15_required_columns", "SELECT count(*) AS rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def in_15(spark, sf):
    return prep.require_columns(views.interactions_dense(spark, sf), "user_id", "book_id", "rating", "is_read", "is_reviewed").agg(F.count("*").alias("rows"))


# ---- splits ---------------------------------------------------------------------------------


@query("sp_01_eligible_users", with_(SQL_DENSE, select="SELECT user_id, count(*) AS likes FROM dense WHERE rating >= 5 GROUP BY 1 HAVING count(*) >= 5"))
def sp_01(spark, sf):
    return split.eligible_users(views.interactions_dense(spark, sf))


@query("sp_02_sample_users", with_(SQL_DENSE, _HELD_DENSE, select="SELECT * FROM sampled"))
def sp_02(spark, sf):
    return split.sample_users(split.eligible_users(views.interactions_dense(spark, sf))).select("user_id")


@query("sp_03_pick_one", with_(SQL_DENSE, select="SELECT user_id, arg_min(book_id, (md5('42:' || user_id || ':' || book_id), book_id)) AS book_id FROM dense WHERE rating >= 5 GROUP BY 1"))
def sp_03(spark, sf):
    return split.pick_one(prep.liked(views.interactions_dense(spark, sf), 5))


@query("sp_04_train", with_(SQL_DENSE, _HELD_DENSE, select="SELECT * FROM dense ANTI JOIN held USING (user_id, book_id)"))
def sp_04(spark, sf):
    return split.leave_one_liked_out(views.interactions_dense(spark, sf))[0].select("user_id", "book_id", "rating", "is_read", "is_reviewed")


@query("sp_04_validation", with_(SQL_DENSE, _HELD_DENSE, _HELD_ROWS.format(v="dense"), select="SELECT * FROM hrows"))
def sp_04_validation(spark, sf):
    df = views.interactions_dense(spark, sf)
    return split.held_rows(df, split.leave_one_liked_out(df)[1]).select("user_id", "book_id", "rating", "is_read", "is_reviewed")


@query("sp_05_first_eligible", with_(SQL_DENSE, select="SELECT user_id, count(DISTINCT book_id) AS books FROM dense WHERE rating >= 4 GROUP BY 1 HAVING count(DISTINCT book_id) >= 5 ORDER BY user_id LIMIT 500"))
def sp_05(spark, sf):
    return split.first_eligible(views.interactions_dense(spark, sf), None)


@query("sp_06_hidden_item", with_(SQL_DENSE, select="""SELECT user_id, arg_min(book_id, (md5('7:' || user_id || ':' || book_id), book_id)) AS book_id FROM dense
  WHERE rating >= 4 AND user_id IN (SELECT user_id FROM dense WHERE rating >= 4 GROUP BY 1 HAVING count(DISTINCT book_id) >= 5 ORDER BY 1 LIMIT 500) GROUP BY 1"""))
def sp_06(spark, sf):
    df = views.interactions_dense(spark, sf)
    users = split.first_eligible(df, None)
    return split.pick_one(prep.liked(df, 4).join(users, "user_id", "left_semi"), seed=7)


_ACTIVE = "active AS (SELECT user_id, count(*) AS n FROM dense GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {n})"


@query("sp_07_most_active", with_(SQL_DENSE, _ACTIVE.format(n=100), select="SELECT * FROM active"))
def sp_07(spark, sf):
    return split.most_active(views.interactions_dense(spark, sf), 100)


_PAIRS = "pairs AS (SELECT DISTINCT user_id, book_id FROM dense WHERE rating >= 4)"


def _pairs(spark, sf):
    return prep.liked(views.interactions_dense(spark, sf), 4).select("user_id", "book_id").distinct()


_LOO = "loo AS (SELECT user_id, arg_min(book_id, (md5('42:' || user_id || ':' || book_id), book_id)) AS book_id FROM pairs WHERE user_id IN (SELECT user_id FROM pairs GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1)"


@query("sp_08_leave_one_out", with_(SQL_DENSE, _PAIRS, _LOO, select="SELECT * FROM loo"))
def sp_08(spark, sf):
    return split.leave_one_out(_pairs(spark, sf))


_PRIME = """places AS (SELECT book_id, row_number() OVER (ORDER BY md5('{seed}:' || book_id), book_id) - 1 AS place FROM (SELECT DISTINCT book_id FROM dense)),
prime AS (SELECT min(p) AS p FROM (SELECT unnest(range(greatest(n, 2), 2 * n + 3)) AS p FROM (SELECT count(*) AS n FROM places)) WHERE len(list_filter(range(2, floor(sqrt(p))::BIGINT + 1), lambda d: p % d = 0)) = 0)"""


def _walk(wanted: str, seed: int) -> str:
    """Every user's whole walk over the places, with the items met outside `pairs` numbered."""
    number = "('0x' || substr(md5('{seed}:{what}:' || user_id), 1, 15))::BIGINT".format
    return f"""SELECT user_id, book_id, row_number() OVER (PARTITION BY user_id ORDER BY k) AS rn, want
  FROM (SELECT user_id, want, k, ({number(seed=seed, what="start")} % p + k * (1 + {number(seed=seed, what="step")} % (p - 1))) % p AS place
    FROM (SELECT user_id, want, p, unnest(range(p)) AS k FROM ({wanted}), prime)) JOIN places USING (place) ANTI JOIN pairs USING (user_id, book_id)"""


_NEG = f"""{_PRIME.format(seed=42)},
want AS (SELECT p.user_id, 4 * count(*) AS want FROM pairs p SEMI JOIN active a USING (user_id) ANTI JOIN loo USING (user_id, book_id) GROUP BY 1),
neg AS (SELECT user_id, book_id FROM ({_walk("FROM want", 42)}) WHERE rn <= want)"""


def _training(spark, sf, users=5000):
    """Items, and the most active users' pairs, hidden items and training positives.

    A user's hidden item depends on their own pairs alone, so those of others are left out before it is chosen.
    """
    df = views.interactions_dense(spark, sf)
    active = written(split.most_active(df, users), "active")
    pairs = written(_pairs(spark, sf).join(F.broadcast(active), "user_id", "left_semi"), "pairs")
    hidden = written(split.leave_one_out(pairs), "hidden")
    positives = pairs.join(hidden, ["user_id", "book_id"], "left_anti")
    return df.select("book_id").distinct(), pairs, hidden, positives


@query("sp_09_train_negatives", with_(SQL_DENSE, _PAIRS, _LOO, _ACTIVE.format(n=5000), _NEG, select="SELECT * FROM neg"))
def sp_09(spark, sf):
    items, pairs, _, positives = _training(spark, sf)
    want = positives.groupBy("user_id").agg((4 * F.count("*")).alias("want"))
    return split.negatives(want, items, pairs, 0).select("user_id", "book_id")


_CANDIDATES = f"""{_PRIME.format(seed=11)},
cand AS (SELECT user_id, book_id, rn FROM ({_walk("SELECT user_id, 499 AS want FROM loo SEMI JOIN active USING (user_id)", 11)}) WHERE rn <= want
  UNION ALL SELECT user_id, book_id, 0 FROM loo SEMI JOIN active USING (user_id))"""


def _eval_candidates(spark, sf, users=5000, n=499):
    items, pairs, chosen, _ = _training(spark, sf, users)
    drawn = split.negatives(chosen.select("user_id"), items, pairs, n, seed=11)
    return drawn.unionByName(chosen.withColumn("rn", F.lit(0))), chosen


@query("sp_10_eval_candidates", with_(SQL_DENSE, _PAIRS, _LOO, _ACTIVE.format(n=5000), _CANDIDATES, select="SELECT user_id, book_id FROM cand"))
def sp_10(spark, sf):
    return _eval_candidates(spark, sf)[0].select("user_id", "book_id")


@query("sp_11_unseen_users", with_(SQL_DENSE, _PAIRS, _ACTIVE.format(n=100), select="""SELECT user_id, count(*) AS n_items, row_number() OVER (ORDER BY user_id) - 1 AS user_idx FROM pairs ANTI JOIN active USING (user_id)
  GROUP BY 1 HAVING count(*) >= 5 ORDER BY user_id LIMIT 1000"""))
def sp_11(spark, sf):
    out = split.unseen_users(_pairs(spark, sf), split.most_active(views.interactions_dense(spark, sf), 100))
    return out.select("user_id", "n_items", F.col("user_idx").cast("long").alias("user_idx"))


# ---- item CF --------------------------------------------------------------------------------

_TOP = "top AS (SELECT * FROM likecnt ORDER BY likes DESC, book_id LIMIT {top})"
_GRAPH = """basket AS (SELECT user_id, book_id FROM (SELECT user_id, book_id, row_number() OVER (PARTITION BY user_id ORDER BY book_id) AS rn
  FROM (SELECT DISTINCT user_id, book_id FROM dense WHERE rating >= 4 AND book_id IN (SELECT book_id FROM top))) WHERE rn <= {cap}),
co AS (SELECT a.book_id AS left_id, b.book_id AS right_id, count(*) AS co_likes FROM basket a JOIN basket b ON a.user_id = b.user_id AND a.book_id < b.book_id GROUP BY 1, 2),
scored AS (SELECT left_id, right_id, co_likes / sqrt(l.likes * r.likes) * least(co_likes / 50.0::DOUBLE, 1.0::DOUBLE) AS score, co_likes, l.likes AS left_likes, r.likes AS right_likes
  FROM co JOIN likecnt l ON left_id = l.book_id JOIN likecnt r ON right_id = r.book_id WHERE co_likes >= 5),
sym AS (SELECT left_id AS book_id, right_id AS similar_id, score, co_likes, left_likes AS book_likes, right_likes AS similar_likes FROM scored
  UNION ALL SELECT right_id, left_id, score, co_likes, right_likes, left_likes FROM scored),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY score DESC, co_likes DESC, similar_id) AS rank FROM sym) WHERE rank <= 25)"""
_CF = (SQL_DENSE, _LIKES, _TOP.format(top=5000), _GRAPH.format(cap=200))
_CF_SMALL = (SQL_DENSE, _LIKES, _TOP.format(top=20), _GRAPH.format(cap=10))


def _dense(spark, sf):
    return views.interactions_dense(spark, sf)


def _scored(spark, sf, top=5000, cap=200):
    df = _dense(spark, sf)
    counts = item_cf.like_counts(df)
    return item_cf.damped_cosine(item_cf.pair_counts(item_cf.baskets(df, item_cf.candidate_books(counts, top), cap=cap)), counts)


@query("cf_01_like_counts", with_(SQL_DENSE, _LIKES, select="SELECT * FROM likecnt"))
def cf_01(spark, sf):
    return item_cf.like_counts(_dense(spark, sf))


@query("cf_02_candidates", with_(SQL_DENSE, _LIKES, _TOP.format(top=20), select="SELECT * FROM top"))
def cf_02(spark, sf):
    return item_cf.candidate_books(item_cf.like_counts(_dense(spark, sf)), 20)


@query("cf_03_baskets", with_(*_CF_SMALL, select="SELECT * FROM basket"))
def cf_03(spark, sf):
    df = _dense(spark, sf)
    return item_cf.baskets(df, item_cf.candidate_books(item_cf.like_counts(df), 20), cap=10).select("user_id", F.explode("books").alias("book_id"))


@query("cf_04_pair_counts", with_(*_CF, select="SELECT * FROM co"))
def cf_04(spark, sf):
    df = _dense(spark, sf)
    return item_cf.pair_counts(item_cf.baskets(df, item_cf.candidate_books(item_cf.like_counts(df))))


@query("cf_04_pair_counts_capped", with_(*_CF_SMALL, select="SELECT * FROM co"))
def cf_04_capped(spark, sf):
    df = _dense(spark, sf)
    return item_cf.pair_counts(item_cf.baskets(df, item_cf.candidate_books(item_cf.like_counts(df), 20), cap=10))


@query("cf_05_damped_cosine", with_(*_CF, select="SELECT left_id, right_id, round(score, 6) AS score, co_likes, left_likes, right_likes FROM scored"))
def cf_05(spark, sf):
    return _scored(spark, sf).withColumn("score", r6("score"))


@query("cf_06_symmetric", with_(*_CF, select="SELECT book_id, similar_id, round(score, 6) AS score, co_likes, book_likes, similar_likes FROM sym"))
def cf_06(spark, sf):
    return item_cf.symmetric(_scored(spark, sf)).withColumn("score", r6("score"))


@query("cf_07_neighbors", with_(*_CF, select="SELECT book_id, similar_id, round(score, 6) AS score, co_likes, book_likes, similar_likes, rank FROM nb"))
def cf_07(spark, sf):
    return item_cf.neighbors(_dense(spark, sf)).withColumn("score", r6("score")).withColumn("rank", F.col("rank").cast("long"))


@query("cf_08_similar", with_(*_CF, select="SELECT book_id, similar_id, round(score, 6) AS score, co_likes FROM nb WHERE book_id = 7 ORDER BY nb.score DESC, co_likes DESC, similar_id LIMIT 10"))
def cf_08(spark, sf):
    return item_cf.similar(item_cf.neighbors(_dense(spark, sf)), 7, 10, required=False).select("book_id", "similar_id", r6("score").alias("score"), "co_likes")


@query("cf_09_history", with_(SQL_DENSE, select="""SELECT user_id, book_id, max(rating) FILTER (rating >= 4) AS liked_rating FROM dense GROUP BY 1, 2"""))
def cf_09(spark, sf):
    read, likes = item_cf.histories(_dense(spark, sf))
    return read.join(likes.withColumnRenamed("rating", "liked_rating"), ["user_id", "book_id"], "left")


@query("cf_10_adhoc_list", "SELECT * FROM (VALUES (0::BIGINT, 3::BIGINT, 5), (0, 8, 4), (0, 5, 5)) t(user_id, book_id, rating)")
def cf_10(spark, sf):
    return item_cf.parse_liked("3:5, 8:4,5", spark)


_RECW = """reach AS (SELECT l.user_id, nb.similar_id AS book_id, sum(score * greatest(rating - 3, 0.5::DOUBLE)) AS score, count(*) AS evidence, max(co_likes) AS max_co_likes
  FROM (SELECT user_id, book_id, max(rating) AS rating FROM dense WHERE rating >= 4 GROUP BY 1, 2) l JOIN nb USING (book_id) GROUP BY 1, 2),
rec AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, evidence DESC, {more} book_id) AS rank FROM reach ANTI JOIN (SELECT DISTINCT user_id, book_id FROM dense) USING (user_id, book_id))"""


@query("cf_11_recommend_weighted", with_(*_CF, _RECW.format(more="max_co_likes DESC,"), select="SELECT user_id, book_id, round(score, 6) AS score, evidence, max_co_likes, rank FROM rec WHERE rank <= 20"))
def cf_11(spark, sf):
    df = _dense(spark, sf)
    read, likes = item_cf.histories(df)
    out = item_cf.recommend(item_cf.neighbors(df), likes, read, n=20)
    return out.withColumn("score", r6("score")).withColumn("rank", F.col("rank").cast("long"))


@query("cf_12_recommend_unweighted", with_(*_CF, _RECW.format(more="").replace("greatest(rating - 3, 0.5::DOUBLE)", "1.0::DOUBLE"), select="SELECT user_id, book_id, round(score, 6) AS score, evidence, rank FROM rec WHERE rank <= 20"))
def cf_12(spark, sf):
    df = _dense(spark, sf)
    read, likes = item_cf.histories(df)
    out = item_cf.recommend(item_cf.neighbors(df), likes, read, weighted=False, n=20)
    return out.select("user_id", "book_id", r6("score").alias("score"), "evidence", F.col("rank").cast("long").alias("rank"))


@query("cf_13_universe", with_(*_CF, select="SELECT book_id FROM nb UNION SELECT similar_id FROM nb"))
def cf_13(spark, sf):
    return item_cf.universe(item_cf.neighbors(_dense(spark, sf)))


_CFEVAL = """eusers AS (SELECT user_id FROM dense WHERE rating >= 4 AND book_id IN (SELECT book_id FROM nb UNION SELECT similar_id FROM nb) GROUP BY 1 HAVING count(DISTINCT book_id) >= 5 ORDER BY 1 LIMIT 500),
hid AS (SELECT user_id, arg_min(book_id, (md5('42:' || user_id || ':' || book_id), book_id)) AS book_id FROM dense
  WHERE rating >= 4 AND user_id IN (FROM eusers) AND book_id IN (SELECT book_id FROM nb UNION SELECT similar_id FROM nb) GROUP BY 1),
rest AS (SELECT DISTINCT user_id, book_id FROM dense d SEMI JOIN eusers USING (user_id) WHERE rating >= 4 AND (user_id, book_id) NOT IN (SELECT (user_id, book_id) FROM hid)),
escore AS (SELECT r.user_id, similar_id AS book_id, sum(score) AS score, count(*) AS evidence FROM rest r JOIN nb USING (book_id) GROUP BY 1, 2),
erec AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, evidence DESC, book_id) AS rank FROM escore ANTI JOIN rest USING (user_id, book_id)),
ranks AS (SELECT hid.user_id, hid.book_id, CASE WHEN rank <= 50 THEN rank END AS rank FROM hid LEFT JOIN erec USING (user_id, book_id))"""


def _cf_eval(spark, sf):
    """Leave one liked book out for 500 users; the graph was built with it, as the plan's name says."""
    df = _dense(spark, sf)
    edges = written(item_cf.neighbors(df), "edges")
    books = item_cf.universe(edges)
    users = split.first_eligible(df, books)
    mine = prep.liked(df, 4).join(users, "user_id", "left_semi").select("user_id", "book_id").distinct()
    hidden = written(split.pick_one(mine.join(books, "book_id", "left_semi")), "hidden")
    rest = mine.join(hidden, ["user_id", "book_id"], "left_anti")
    ranked = item_cf.recommend(edges, rest.withColumn("rating", F.lit(5)), rest, weighted=False)
    return ranked, hidden


@query("cf_14_evaluation_leaky", with_(*_CF, _CFEVAL, select="""SELECT count(*) AS users_evaluated, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit_10,
  round(avg(CASE WHEN rank <= 20 THEN 1.0 ELSE 0.0 END), 6) AS hit_20, round(avg(CASE WHEN rank <= 50 THEN 1.0 ELSE 0.0 END), 6) AS hit_50, round(avg(CASE WHEN rank <= 50 THEN 1.0::DOUBLE / rank ELSE 0.0::DOUBLE END), 6) AS mrr_at_50 FROM ranks"""))
def cf_14(spark, sf):
    ranked, hidden = _cf_eval(spark, sf)
    return evaluate.metrics(evaluate.hidden_ranks(ranked, hidden))


# ---- metrics over the item-CF evaluation ----------------------------------------------------


def _ranks(spark, sf):
    return evaluate.hidden_ranks(*_cf_eval(spark, sf))


@query("ev_01_hit_rates", with_(*_CF, _CFEVAL, select="""SELECT count(*) AS users_evaluated, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit_10,
  round(avg(CASE WHEN rank <= 20 THEN 1.0 ELSE 0.0 END), 6) AS hit_20, round(avg(CASE WHEN rank <= 50 THEN 1.0 ELSE 0.0 END), 6) AS hit_50 FROM ranks"""))
def ev_01(spark, sf):
    return evaluate.hit_rates(_ranks(spark, sf))


@query("ev_02_mrr_at_50", with_(*_CF, _CFEVAL, select="SELECT round(avg(CASE WHEN rank <= 50 THEN 1.0::DOUBLE / rank ELSE 0.0::DOUBLE END), 6) AS mrr_at_50 FROM ranks"))
def ev_02(spark, sf):
    return evaluate.mrr_at(_ranks(spark, sf))


@query("ev_09_pool_recall", with_(*_CF, _CFEVAL, select="SELECT round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS pool_recall FROM ranks"))
def ev_09(spark, sf):
    return evaluate.pool_recall(*_cf_eval(spark, sf))


@query("ev_11_examples", with_(*_CF, _CFEVAL, select="""SELECT user_id, string_agg(book_id::VARCHAR, ',' ORDER BY rank) AS top_items FROM erec
  WHERE rank <= 10 AND user_id IN (SELECT DISTINCT user_id FROM erec ORDER BY 1 LIMIT 10) GROUP BY 1"""))
def ev_11(spark, sf):
    return evaluate.examples(_cf_eval(spark, sf)[0])


@query("src_04_events_json", with_(SQL_EVENTS, select="SELECT user_id, book_id, count(*) AS n, count(*) FILTER (rating >= 4) AS liked FROM ev GROUP BY 1, 2"))
def src_04_events(spark, sf):
    return views.interactions_events(spark, sf).groupBy("user_id", "book_id").agg(F.count("*").alias("n"), F.count_if(F.col("rating") >= 4).alias("liked"))
