"""Queries: metadata similarity, hybrid reranking, candidate strategies, batch serving.

ALS scores come from dot products of the embeddings table, so SQL can check
everything that follows from them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import als, evaluate, hybrid, serve, signals, split
from ..sources import views
from ..sources.scratch import written
from ..sources.views import SQL_META, SQL_SPARSE, SQL_WORKS
from .base import query, r6, with_

_POOL = 500

_USERS = """likes AS (SELECT user_id FROM sparse WHERE rating >= 5 GROUP BY 1 HAVING count(*) >= 5),
sampled AS (SELECT user_id FROM likes WHERE user_id % 20 = 0),
held AS (SELECT user_id, arg_min(book_id, (md5('42:' || user_id || ':' || book_id), book_id)) AS book_id FROM sparse WHERE rating >= 5 AND user_id IN (FROM sampled) GROUP BY 1),
train AS (SELECT * FROM sparse ANTI JOIN held USING (user_id, book_id)),
g AS (SELECT sum(rating)::DOUBLE / count(*) AS gm FROM train WHERE rating > 0),
mu AS (SELECT user_id, (sum(rating) + 5e0 * max(gm)) / (count(*) + 5e0) AS m FROM train, g WHERE rating > 0 GROUP BY 1),
sig0 AS (SELECT user_id, book_id, sign(rating - m) * (1e0 + 4e1 * abs(rating - m) / 4e0) AS signal, 'explicit' AS kind FROM train JOIN mu USING (user_id) WHERE rating > 0 AND rating <> m
  UNION ALL SELECT user_id, book_id, 1e0, 'weak' FROM train WHERE rating = 0 AND is_read = 1),
sig AS (SELECT user_id, book_id, signal FROM (SELECT *, row_number() OVER (PARTITION BY user_id, book_id ORDER BY kind, abs(signal) DESC, signal DESC) AS rn FROM sig0 SEMI JOIN held USING (user_id)) WHERE rn = 1)"""
_POP = """ends AS (SELECT min(ln(1e0 + ratings_count)) AS lo, max(ln(1e0 + ratings_count)) AS hi FROM meta),
metap AS (SELECT meta.*, CASE WHEN hi > lo THEN (ln(1e0 + ratings_count) - lo) / (hi - lo) ELSE 0e0 END AS popularity_norm FROM meta, ends)"""
_ALS = f"""ne AS (SELECT count(*) AS n FROM embeddings),
iv AS MATERIALIZED (SELECT p_partkey AS book_id, embedding::DOUBLE[] AS f FROM (SELECT p_partkey, p_partkey % n AS v FROM part, ne) JOIN embeddings ON vec_id = v),
uv AS MATERIALIZED (SELECT user_id, embedding::DOUBLE[] AS f FROM (SELECT user_id, user_id % n AS v FROM held, ne) JOIN embeddings ON vec_id = v),
als AS MATERIALIZED (SELECT * FROM (SELECT user_id, book_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, book_id) AS als_rank FROM
  (SELECT user_id, book_id, round(list_inner_product(uv.f, iv.f), 9) AS score FROM uv CROSS JOIN iv) ANTI JOIN sig USING (user_id, book_id)) WHERE als_rank <= {_POOL})"""
_PROF = """prof AS (SELECT user_id, book_id AS source_id, signal AS weight, rn AS source_rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY signal DESC, book_id) AS rn FROM sig
  WHERE signal > 0 AND book_id IN (SELECT book_id FROM metap)) WHERE rn <= 50),
psize AS (SELECT user_id, count(*) AS n_sources FROM prof GROUP BY 1)"""
_SIMS = {
    "author": "CASE WHEN list_has_any(c.authors, s.authors) THEN 1e0 ELSE 0e0 END",
    "genre": "CASE WHEN len(c.genres) = 0 OR len(s.genres) = 0 THEN 0e0 ELSE len(list_intersect(c.genres, s.genres))::DOUBLE / len(list_distinct(list_concat(c.genres, s.genres))) END",
    "rating": "CASE WHEN c.average_rating > 0 AND s.average_rating > 0 THEN greatest(0e0, 1e0 - abs(c.average_rating - s.average_rating) / 4e0) ELSE 0e0 END",
    "page": "CASE WHEN c.page_count > 0 AND s.page_count > 0 THEN greatest(0e0, 1e0 - abs(c.page_count - s.page_count) / 1e3) ELSE 0e0 END",
    "popularity": "c.popularity_norm",
    "language": "CASE WHEN c.language <> '' AND c.language = s.language THEN 1e0 ELSE 0e0 END",
}


def _comp(pool: str, name: str = "comp") -> str:
    sums = ", ".join(f"max({v}) AS {k}" if k == "popularity" else f"sum(weight * {v}) / sum(weight) AS {k}" for k, v in _SIMS.items())
    return f"{name} AS (SELECT p.user_id, p.book_id, {sums} FROM {pool} p JOIN prof USING (user_id) JOIN metap c ON c.book_id = p.book_id JOIN metap s ON s.book_id = source_id GROUP BY 1, 2)"


def _grid(*names: str) -> str:
    rows = ", ".join(f"('{n}', '{'dynamic' if hybrid.CONFIGS[n][0] is None else 'fixed'}', {'NULL' if hybrid.CONFIGS[n][0] is None else hybrid.CONFIGS[n][0]}::DOUBLE, {', '.join(f'{w}::DOUBLE' for w in hybrid.CONFIGS[n][1].values())})" for n in names or hybrid.CONFIGS)
    return f"cfg AS (SELECT * FROM (VALUES {rows}) t(config, policy, alpha, {', '.join('w_' + c for c in hybrid.COMPONENTS)}))"


_CONTENT = " + ".join(f"w_{c} * {c}" for c in hybrid.COMPONENTS)
_ALPHA = "CASE WHEN policy = 'dynamic' THEN least(0.9::DOUBLE, greatest(0.55::DOUBLE, 0.55::DOUBLE + 0.35::DOUBLE * coalesce(n_sources, 0) / 5e1)) ELSE alpha END"


def _mm(c: str) -> str:
    w = "OVER (PARTITION BY user_id, config)"
    return f"CASE WHEN max({c}) {w} - min({c}) {w} <= 1e-12 THEN 0e0 ELSE ({c} - min({c}) {w}) / (max({c}) {w} - min({c}) {w}) END"


def _blend(pool: str, name: str = "ranked") -> str:
    return f"""{name}_n AS (SELECT *, {_mm("als")} AS als_norm, {_mm("content")} AS content_norm FROM {pool} LEFT JOIN psize USING (user_id)),
{name}_f AS (SELECT *, round({_ALPHA} * als_norm + (1 - {_ALPHA}) * content_norm, 9) AS final FROM {name}_n),
{name} AS (SELECT *, row_number() OVER (PARTITION BY user_id, config ORDER BY final DESC, als_rank, book_id) AS rank FROM {name}_f)"""


_BASE = (SQL_SPARSE, SQL_META, _USERS, _POP, _ALS, _PROF)
_SCORED = f"pool AS (SELECT comp.*, cfg.*, {_CONTENT} AS content, als.score AS als, als.als_rank FROM comp CROSS JOIN cfg JOIN als USING (user_id, book_id))"
_RANKS = "ranks AS (SELECT config, held.user_id, rank, a.als_rank, rank IS NOT NULL AS in_pool FROM held CROSS JOIN (SELECT config FROM cfg) LEFT JOIN (SELECT config, user_id, book_id, rank FROM ranked) USING (config, user_id, book_id) LEFT JOIN (SELECT user_id, book_id, als_rank FROM als) a USING (user_id, book_id))"


class Setup:
    """The inputs of one evaluation: metadata, signals, profile, ALS candidates, hidden items.

    Every eligible user whose id is divisible by 20 asks, against all books.
    """

    def __init__(self, spark, sf):
        self.spark = spark
        df = views.interactions_sparse(spark, sf)
        self.meta = written(hybrid.with_popularity(views.book_meta(spark, sf)), "meta")
        train, hidden = split.leave_one_liked_out(df, users=df.where("user_id % 20 = 0"))
        self.hidden = written(hidden, "hidden")
        train = df.join(self.hidden, ["user_id", "book_id"], "left_anti")
        mine = train.join(self.hidden.select("user_id"), "user_id", "left_semi")
        self.signals = written(signals.dedup_signals(signals.centered_signals(mine, signals.user_means(train).join(self.hidden.select("user_id"), "user_id", "left_semi"), signals.global_mean(train))).select("user_id", "book_id", "signal"), "signals")
        self._als = None
        self.sources = hybrid.profile(self.signals, self.meta)
        e = views.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("factor"))
        n = e.agg(F.count("*").alias("n"))
        self.items = views.table(spark, sf, "part").select(F.col("p_partkey").alias("book_id")).crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("book_id") % F.col("n")).join(e, "vec_id").select("book_id", "factor")
        self.users = self.hidden.select("user_id").crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("user_id") % F.col("n")).join(e, "vec_id").select("user_id", "factor")

    @property
    def als(self):
        if self._als is None:
            self._als = written(als.top_items(self.users, self.items, self.signals, _POOL), "candidates")
        return self._als

    def components(self):
        return hybrid.components(self.als, self.sources, self.meta)

    def rerank(self, *names):
        return hybrid.rerank(self.als, self.sources, self.meta, hybrid.configs(self.spark, *names))


# ---- metadata -------------------------------------------------------------------------------


@query("hy_01_extract", """WITH f AS (SELECT l_partkey AS book_id, l_orderkey, [lower(l_returnflag), lower(l_linestatus)] AS genres FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag, l_linestatus) AS rn
  FROM lineitem WHERE l_partkey % 3 = 0) WHERE rn = 1)
SELECT book_id, l_orderkey, array_to_string(CASE WHEN book_id % 6 = 0 THEN string_split(lower(p_name), ' ') ELSE genres END, ';') AS genres FROM f JOIN part ON p_partkey = book_id""")
def hy_01(spark, sf):
    part = views.table(spark, sf, "part")
    order = ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    records = views.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("book_id"), *order, F.array(F.lower("l_returnflag"), F.lower("l_linestatus")).alias("genres"))
    override = part.where("p_partkey % 6 = 0").select(F.col("p_partkey").alias("book_id"), F.split(F.lower("p_name"), " ").alias("genres"))
    targets = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("book_id"))
    return hybrid.extract(records, targets, override, *order).select("book_id", "l_orderkey", F.array_join("genres", ";").alias("genres"))


@query("hy_02_author_key", """SELECT p_partkey AS book_id, array_to_string(list_sort(list_distinct(list_filter(list_transform([p_name, p_brand, '!!', p_brand], lambda x: trim(regexp_replace(lower(trim(x)), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> ''))), '|') AS author_key FROM part""")
def hy_02(spark, sf):
    part = views.table(spark, sf, "part")
    return part.select(F.col("p_partkey").alias("book_id"), hybrid.author_key(F.array("p_name", "p_brand", F.lit("!!"), F.col("p_brand"))).alias("author_key"))


@query("hy_03_popularity", with_(SQL_META, _POP, select="SELECT book_id, ratings_count, round(popularity_norm, 6) AS popularity_norm FROM metap"))
def hy_03(spark, sf):
    return hybrid.with_popularity(views.book_meta(spark, sf)).select("book_id", "ratings_count", r6("popularity_norm").alias("popularity_norm"))


@query("hy_04_minmax", with_(*_BASE, select="""SELECT user_id, book_id, round(CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-12 THEN 0e0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS scaled FROM als WINDOW w AS (PARTITION BY user_id)"""))
def hy_04(spark, sf):
    return Setup(spark, sf).als.select("user_id", "book_id", r6(hybrid.minmax("score", "user_id")).alias("scaled"))


_PAIRS = "pairs AS (SELECT p_partkey AS book_id, 1 + (p_partkey * 7) % 200 AS source_id FROM part)"


def _pairs(spark, sf):
    return views.table(spark, sf, "part").select(F.col("p_partkey").alias("book_id"), (1 + F.col("p_partkey") * 7 % 200).alias("source_id"))


def _pair_query(name: str, component: str) -> None:
    @query(name, with_(SQL_META, _POP, _PAIRS, select=f"SELECT pairs.book_id, source_id, round({_SIMS[component]}, 6) AS similarity FROM pairs JOIN metap c USING (book_id) JOIN metap s ON s.book_id = source_id"))
    def run(spark, sf):
        meta = hybrid.with_popularity(views.book_meta(spark, sf))
        both = _pairs(spark, sf).join(hybrid._meta(meta, "c_", "book_id"), "book_id").join(hybrid._meta(meta, "s_", "source_id"), "source_id")
        return both.select("book_id", "source_id", r6(hybrid.pair_components()[component]).alias("similarity"))


for _name, _component in (("hy_05_genre_jaccard", "genre"), ("hy_06_rating_similarity", "rating"), ("hy_07_page_similarity", "page"), ("hy_08_language_similarity", "language"), ("hy_09_author_overlap", "author")):
    _pair_query(_name, _component)


@query("hy_10_pair_similarity", with_(SQL_META, _POP, _PAIRS, select="SELECT pairs.book_id, source_id, round(" + " + ".join(f"{w} * ({_SIMS[k]})" for k, w in hybrid.CONFIGS["balanced_metadata"][1].items()) + ", 6) AS similarity FROM pairs JOIN metap c USING (book_id) JOIN metap s ON s.book_id = source_id"))
def hy_10(spark, sf):
    meta = hybrid.with_popularity(views.book_meta(spark, sf))
    return hybrid.pair_similarity(_pairs(spark, sf), meta).withColumn("similarity", r6("similarity"))


@query("hy_11_dynamic_alpha", with_(*_BASE, select="SELECT user_id, n_sources, round(least(0.9::DOUBLE, greatest(0.55::DOUBLE, 0.55::DOUBLE + 0.35::DOUBLE * n_sources / 5e1)), 6) AS alpha FROM psize"))
def hy_11(spark, sf):
    return hybrid.sizes(Setup(spark, sf).sources).withColumn("alpha", r6(hybrid.dynamic_alpha(F.col("n_sources"))))


@query("hy_12_profile", with_(*_BASE, select="SELECT user_id, source_id, round(weight, 6) AS weight, source_rank FROM prof WHERE source_rank <= 5"))
def hy_12(spark, sf):
    s = Setup(spark, sf)
    return hybrid.profile(s.signals, s.meta, 5).select("user_id", "source_id", r6("weight").alias("weight"), F.col("source_rank").cast("long").alias("source_rank"))


@query("hy_13_content_score", with_(*_BASE, _comp("als"), _grid(hybrid.CHAMPION), select=f"SELECT user_id, book_id, round({_CONTENT}, 6) AS content FROM comp CROSS JOIN cfg"))
def hy_13(spark, sf):
    return hybrid.weighted(Setup(spark, sf).components(), hybrid.configs(spark, hybrid.CHAMPION)).select("user_id", "book_id", r6("content").alias("content"))


@query("hy_14_components", with_(*_BASE, _comp("als"), select="SELECT user_id, book_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in hybrid.COMPONENTS) + " FROM comp"))
def hy_14(spark, sf):
    return Setup(spark, sf).components().select("user_id", "book_id", *(r6(c).alias(c) for c in hybrid.COMPONENTS))


@query("hy_15_weighted_grid", with_(*_BASE, _comp("als"), _grid(), select=f"SELECT user_id, config, round(avg({_CONTENT}), 6) AS mean_content, round(max({_CONTENT}), 6) AS best_content FROM comp CROSS JOIN cfg GROUP BY 1, 2"))
def hy_15(spark, sf):
    return hybrid.weighted(Setup(spark, sf).components(), hybrid.configs(spark)).groupBy("user_id", "config").agg(r6(F.avg("content")).alias("mean_content"), r6(F.max("content")).alias("best_content"))


@query("hy_16_rerank", with_(*_BASE, _comp("als"), _grid(hybrid.CHAMPION), _SCORED, _blend("pool"), select="SELECT user_id, book_id, round(final, 6) AS final, rank, als_rank FROM ranked WHERE rank <= 20"))
def hy_16(spark, sf):
    out = Setup(spark, sf).rerank(hybrid.CHAMPION).where("rank <= 20")
    return out.select("user_id", "book_id", r6("final").alias("final"), F.col("rank").cast("long").alias("rank"), F.col("als_rank").cast("long").alias("als_rank"))


@query("hy_17_author_index", with_(SQL_META, select="SELECT author, count(*) AS books, min(book_id) AS first_book FROM (SELECT unnest(authors) AS author, book_id FROM meta) GROUP BY 1"))
def hy_17(spark, sf):
    return hybrid.author_index(views.book_meta(spark, sf)).groupBy("author").agg(F.count("*").alias("books"), F.min("book_id").alias("first_book"))


@query("hy_17_genre_index", with_(SQL_META, select="SELECT genre, count(*) AS books, min(book_id) AS first_book FROM (SELECT unnest(genres) AS genre, book_id FROM meta) GROUP BY 1"))
def hy_17_genre(spark, sf):
    return hybrid.genre_index(views.book_meta(spark, sf)).groupBy("genre").agg(F.count("*").alias("books"), F.min("book_id").alias("first_book"))


@query("hy_17_popularity_order", with_(SQL_META, _POP, select="SELECT book_id, row_number() OVER (ORDER BY popularity_norm DESC, book_id DESC) - 1 AS pop_rank FROM metap ORDER BY popularity_norm DESC, book_id DESC LIMIT 1000"))
def hy_17_popular(spark, sf):
    return hybrid.popularity_order(hybrid.with_popularity(views.book_meta(spark, sf))).select("book_id", F.col("pop_rank").cast("long").alias("pop_rank"))


_ROUGH = """rough0 AS (SELECT user_id, i.book_id, 3 * weight AS s FROM prof JOIN metap s ON s.book_id = source_id JOIN metap i ON list_has_any(i.authors, s.authors)
  UNION ALL SELECT user_id, i.book_id, weight / greatest(len(s.genres), 1) * len(list_intersect(i.genres, s.genres)) FROM prof JOIN metap s ON s.book_id = source_id JOIN metap i ON list_has_any(i.genres, s.genres)
  UNION ALL SELECT user_id, book_id, 0.01::DOUBLE * (1000 - pop_rank) / 1000 FROM (SELECT DISTINCT user_id FROM prof) CROSS JOIN (SELECT book_id, row_number() OVER (ORDER BY popularity_norm DESC, book_id DESC) - 1 AS pop_rank FROM metap QUALIFY pop_rank < 1000)),
rough AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rough DESC, book_id) AS rough_rank FROM (SELECT user_id, book_id, round(sum(s), 9) AS rough FROM rough0 GROUP BY 1, 2) ANTI JOIN sig USING (user_id, book_id) QUALIFY rough_rank <= 3000)"""


def _rough(s):
    return hybrid.rough_candidates(s.sources, s.meta, s.signals)


@query("hy_18_rough_candidates", with_(*_BASE, _ROUGH, select="SELECT user_id, book_id, rough, rough_rank FROM rough"))
def hy_18(spark, sf):
    return _rough(Setup(spark, sf)).select("user_id", "book_id", "rough", F.col("rough_rank").cast("long").alias("rough_rank"))


_EXTRA = f"""escored AS (SELECT c.user_id, c.book_id, config, round({_CONTENT}, 9) AS content FROM ecomp c CROSS JOIN cfg),
eabove AS (SELECT * FROM escored WHERE content > 0 AND content >= 0.3),
extra AS (SELECT *, row_number() OVER (PARTITION BY user_id, config ORDER BY content DESC, book_id) AS extra_rank FROM eabove ANTI JOIN als USING (user_id, book_id) QUALIFY extra_rank <= 20),
low AS (SELECT user_id, config, min(als) AS low, max(als_rank) AS deep FROM pool GROUP BY 1, 2),
upool AS (SELECT user_id, config, policy, alpha, book_id, als, als_rank, content FROM pool
  UNION ALL SELECT e.user_id, e.config, cfg.policy, cfg.alpha, e.book_id, coalesce(low, 0e0), coalesce(deep, 0) + extra_rank, content FROM extra e JOIN cfg USING (config) LEFT JOIN low USING (user_id, config))"""
_UNION = (*_BASE, _ROUGH, _comp("als"), _comp("rough", "ecomp"), _grid("author_50_baseline", "dynamic_alpha_balanced"), _SCORED, _EXTRA)


def _union(s, names=("author_50_baseline", "dynamic_alpha_balanced"), extra=None, least=0.3):
    """Pool of ALS candidates and up to 20 content extras per user and config."""
    from pyspark.sql import Window

    grid = hybrid.configs(s.spark, *names)
    first = s.als
    pool = hybrid.weighted(hybrid.components(first, s.sources, s.meta), grid).join(first.select("user_id", "book_id", F.col("score").alias("als"), F.col("rank").alias("als_rank")), ["user_id", "book_id"])
    if extra is None:
        scored = hybrid.above(hybrid.weighted(hybrid.components(_rough(s), s.sources, s.meta), grid).withColumn("content", F.round("content", 9)), least)
        fresh = scored.join(first.select("user_id", "book_id"), ["user_id", "book_id"], "left_anti")
        order = Window.partitionBy("user_id", "config").orderBy(F.col("content").desc(), "book_id")
        chosen = fresh.withColumn("extra_rank", F.row_number().over(order)).where("extra_rank <= 20")
    else:
        scored = hybrid.weighted(hybrid.components(extra, s.sources, s.meta), grid)
        chosen = scored.join(extra.select("user_id", "book_id", F.col("rank").alias("extra_rank")), ["user_id", "book_id"])
    return hybrid.union_pool(pool, chosen).join(F.broadcast(grid.select("config", "policy", "alpha")), "config")


@query("hy_19_candidate_union", with_(*_UNION, select="SELECT user_id, config, book_id, round(als, 6) AS als, als_rank, round(content, 6) AS content FROM upool"))
def hy_19(spark, sf):
    return _union(Setup(spark, sf)).select("user_id", "config", "book_id", r6("als").alias("als"), F.col("als_rank").cast("long").alias("als_rank"), r6("content").alias("content"))


@query("hy_20_content_threshold", with_(*_UNION, select="SELECT user_id, book_id, config, round(content, 6) AS content FROM eabove"))
def hy_20(spark, sf):
    s = Setup(spark, sf)
    scored = hybrid.weighted(hybrid.components(_rough(s), s.sources, s.meta), hybrid.configs(spark, "author_50_baseline", "dynamic_alpha_balanced"))
    return hybrid.above(scored.withColumn("content", F.round("content", 9)), 0.3).select("user_id", "book_id", "config", r6("content").alias("content"))


_EXACT = """exact AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, book_id) AS rank FROM (SELECT user_id, i.book_id, round(sum(weight + 0.05::DOUBLE * i.popularity_norm), 9) AS score
  FROM prof JOIN metap s ON s.book_id = source_id JOIN metap i ON list_has_any(i.authors, s.authors) ANTI JOIN sig ON sig.user_id = prof.user_id AND sig.book_id = i.book_id GROUP BY 1, 2) QUALIFY rank <= 100)"""


@query("hy_21_exact_author", with_(*_BASE, _EXACT, select="SELECT user_id, book_id, round(score, 6) AS score, rank FROM exact"))
def hy_21(spark, sf):
    s = Setup(spark, sf)
    return hybrid.exact_author_candidates(s.sources, s.meta, s.signals).select("user_id", "book_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("hy_22_confident_genre", with_(*_BASE, f"""reach AS (SELECT DISTINCT user_id, i.book_id FROM prof JOIN metap s ON s.book_id = source_id JOIN metap i ON list_has_any(i.genres, s.genres) ANTI JOIN sig ON sig.user_id = prof.user_id AND sig.book_id = i.book_id),
gs AS (SELECT p.user_id, p.book_id, sum(weight * {_SIMS["genre"]}) / sum(weight) AS genre, max(c.popularity_norm) AS pop FROM reach p JOIN prof USING (user_id) JOIN metap c ON c.book_id = p.book_id JOIN metap s ON s.book_id = source_id GROUP BY 1, 2)""",
    select="SELECT user_id, book_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, book_id) AS rank FROM (SELECT user_id, book_id, round(genre + 0.02::DOUBLE * pop, 9) AS score FROM gs WHERE round(genre, 9) >= 0.12)) WHERE rank <= 100"))
def hy_22(spark, sf):
    s = Setup(spark, sf)
    return hybrid.confident_genre_candidates(s.sources, s.meta, s.signals, least=0.12).select("user_id", "book_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("hy_23_source_neighbors", with_(*_BASE, f"""nreach AS (SELECT DISTINCT user_id, source_id, weight, i.book_id FROM prof JOIN metap s ON s.book_id = source_id JOIN metap i ON list_has_any(i.authors, s.authors) OR list_has_any(i.genres, s.genres)
  ANTI JOIN sig ON sig.user_id = prof.user_id AND sig.book_id = i.book_id WHERE source_rank <= 10),
nsim AS (SELECT user_id, source_id, p.book_id, round(weight * ({" + ".join(f"{w} * ({_SIMS[k]})" for k, w in hybrid.CONFIGS["balanced_metadata"][1].items())}), 9) AS score FROM nreach p JOIN metap c ON c.book_id = p.book_id JOIN metap s ON s.book_id = source_id),
nnear AS (SELECT *, row_number() OVER (PARTITION BY user_id, source_id ORDER BY score DESC, book_id) AS rn FROM nsim WHERE score > 0 QUALIFY rn <= 50)""",
    select="SELECT user_id, book_id, round(score, 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, book_id) AS rank FROM (SELECT user_id, book_id, max(score) AS score FROM nnear GROUP BY 1, 2)"))
def hy_23(spark, sf):
    s = Setup(spark, sf)
    return hybrid.source_neighbor_candidates(s.sources, s.meta, s.signals).select("user_id", "book_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


_STRATEGY = f"""sscored AS (SELECT c.user_id, c.book_id, config, {_CONTENT} AS content FROM scomp c CROSS JOIN cfg),
slow AS (SELECT user_id, config, min(als) AS low, max(als_rank) AS deep FROM pool GROUP BY 1, 2),
spool AS (SELECT user_id, config, policy, alpha, book_id, als, als_rank, content FROM pool
  UNION ALL SELECT e.user_id, e.config, cfg.policy, cfg.alpha, e.book_id, coalesce(low, 0e0), coalesce(deep, 0) + x.rank, content FROM sscored e JOIN exact x USING (user_id, book_id) JOIN cfg USING (config) LEFT JOIN slow USING (user_id, config) ANTI JOIN als USING (user_id, book_id))"""


@query("hy_24_strategy_recommendation", with_(*_BASE, _EXACT, _comp("als"), _comp("exact", "scomp"), _grid("author_50_baseline"), _SCORED, _STRATEGY, _blend("spool"), select="SELECT user_id, book_id, final, rank FROM ranked WHERE rank <= 20"))
def hy_24(spark, sf):
    s = Setup(spark, sf)
    extra = hybrid.exact_author_candidates(s.sources, s.meta, s.signals)
    out = hybrid.blend(_union(s, ("author_50_baseline",), extra), hybrid.sizes(s.sources)).where("rank <= 20")
    return out.select("user_id", "book_id", "final", F.col("rank").cast("long").alias("rank"))


@query("hy_25_configs", with_(_grid(), select="SELECT * FROM cfg"))
def hy_25(spark, sf):
    return hybrid.configs(spark)


_GRID_METRICS = """SELECT config, count(*) AS users_evaluated, round(avg(CASE WHEN rank <= 5 THEN 1e0 ELSE 0e0 END), 6) AS hit_5, round(avg(CASE WHEN rank <= 20 THEN 1e0 ELSE 0e0 END), 6) AS hit_20, round(avg(CASE WHEN rank <= 50 THEN 1e0 ELSE 0e0 END), 6) AS hit_50,
  round(avg(CASE WHEN rank <= 50 THEN 1e0 / rank ELSE 0e0 END), 6) AS mrr_at_50, round(avg(CASE WHEN in_pool THEN 1e0 ELSE 0e0 END), 6) AS pool_recall,
  round(avg(CASE WHEN CASE WHEN rank <= 50 THEN rank END IS DISTINCT FROM CASE WHEN als_rank <= 50 THEN als_rank END THEN 1e0 ELSE 0e0 END), 6) AS changed_rate FROM ranks GROUP BY 1"""


def grid_metrics(ranked, hidden, als_ranked, grid):
    """Metrics of every config at once; a hidden item outside the list has no rank."""
    mine = ranked.select("config", "user_id", "book_id", "rank")
    all_of = hidden.select("user_id", "book_id").crossJoin(F.broadcast(grid.select("config")))
    before = als_ranked.select("user_id", "book_id", F.col("rank").alias("als_rank"))
    found = all_of.join(mine, ["config", "user_id", "book_id"], "left").join(before, ["user_id", "book_id"], "left")
    top = lambda c: F.when(F.col(c) <= 50, F.col(c))
    return found.groupBy("config").agg(
        F.count("*").alias("users_evaluated"),
        *(r6(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))).alias(f"hit_{k}") for k in (5, 20, 50)),
        r6(F.avg(F.when(F.col("rank") <= 50, 1.0 / F.col("rank")).otherwise(0.0))).alias("mrr_at_50"),
        r6(F.avg(F.col("rank").isNotNull().cast("double"))).alias("pool_recall"),
        r6(F.avg((~top("rank").eqNullSafe(top("als_rank"))).cast("double"))).alias("changed_rate"),
    )


@query("hy_26_single_config", with_(*_BASE, _comp("als"), _grid(hybrid.CHAMPION), _SCORED, _blend("pool"), _RANKS, select=_GRID_METRICS))
def hy_26(spark, sf):
    s = Setup(spark, sf)
    return grid_metrics(s.rerank(hybrid.CHAMPION), s.hidden, s.als, hybrid.configs(spark, hybrid.CHAMPION))


@query("hy_27_config_grid", with_(*_BASE, _comp("als"), _grid(), _SCORED, _blend("pool"), _RANKS, select=_GRID_METRICS))
def hy_27(spark, sf):
    s = Setup(spark, sf)
    return grid_metrics(s.rerank(), s.hidden, s.als, hybrid.configs(spark))


@query("ev_10_changed_rate", with_(*_BASE, _comp("als"), _grid(hybrid.CHAMPION), _SCORED, _blend("pool"), _RANKS, select="SELECT round(avg(CASE WHEN rank IS DISTINCT FROM als_rank THEN 1e0 ELSE 0e0 END), 6) AS changed_rate FROM ranks"))
def ev_10(spark, sf):
    s = Setup(spark, sf)
    return evaluate.changed_rate(evaluate.hidden_ranks(s.als, s.hidden), evaluate.hidden_ranks(s.rerank(hybrid.CHAMPION), s.hidden))


@query("ev_12_coverage", with_(SQL_META, select="""SELECT count(*) AS books, round(avg((genres IS NOT NULL)::INT), 6) AS with_metadata, round(avg(coalesce(len(genres) > 0, false)::INT), 6) AS with_genre, round(avg(coalesce(len(authors) > 0, false)::INT), 6) AS with_author,
  round(avg(coalesce(average_rating > 0, false)::INT), 6) AS with_rating, round(avg(coalesce(page_count > 0, false)::INT), 6) AS with_pages FROM (SELECT DISTINCT l_partkey AS book_id FROM lineitem) LEFT JOIN (SELECT * FROM meta WHERE book_id % 50 <> 0) USING (book_id)"""))
def ev_12(spark, sf):
    wanted = views.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("book_id"))
    return evaluate.coverage(views.book_meta(spark, sf).where("book_id % 50 <> 0"), wanted, 0.95)


# ---- serving --------------------------------------------------------------------------------

_REQ = """req AS (SELECT user_id, l.book_id, rating, CASE is_read WHEN 1 THEN 'finished' ELSE 'reading' END AS status, is_reviewed = 1 AS bookmarked FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id, book_id ORDER BY rating DESC, is_read DESC, is_reviewed DESC) AS rn FROM sparse WHERE user_id % 20 = 0) l WHERE rn = 1),
mrc AS (SELECT book_id AS m_id, work_id, coalesce(ratings_count, 0) AS rc FROM works JOIN meta USING (book_id) WHERE book_id % 2 = 0),
wbest AS (SELECT work_id, m_id AS wm FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY rc DESC, m_id) AS rn FROM mrc WHERE work_id IS NOT NULL) WHERE rn = 1),
res AS (SELECT req.*, work_id, CASE WHEN book_id % 2 = 0 THEN book_id ELSE wm END AS model_id FROM req LEFT JOIN works USING (book_id) LEFT JOIN wbest USING (work_id))"""
_SRC = """rm AS (SELECT user_id, avg(rating::DOUBLE) AS m FROM res WHERE rating > 0 GROUP BY 1),
srcs AS (SELECT user_id, model_id AS book_id, max(CASE WHEN rating > 0 THEN CASE WHEN rating >= 4 THEN greatest(CASE WHEN rating > m THEN 1e0 + 4e1 * (rating - m) / 4e0 ELSE 0e0 END, 1e0 + rating - 3e0) ELSE CASE WHEN rating > m THEN 1e0 + 4e1 * (rating - m) / 4e0 ELSE 0e0 END END
  WHEN upper(status) = 'FINISHED' THEN 1e0 WHEN upper(status) = 'READING' THEN 0.7::DOUBLE WHEN bookmarked THEN 0.4::DOUBLE ELSE 0e0 END) AS signal FROM res LEFT JOIN rm USING (user_id) WHERE model_id IS NOT NULL GROUP BY 1, 2),
src AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY signal DESC, book_id) AS source_rank FROM srcs WHERE signal > 0 QUALIFY source_rank <= 50)"""
_SV = (SQL_SPARSE, SQL_META, SQL_WORKS, _REQ, _SRC)


class Serving:
    """Requests of the users whose id is divisible by 20, resolved against a model that knows every even book."""

    def __init__(self, spark, sf):
        from pyspark.sql import Window

        rows = views.interactions_sparse(spark, sf).where("user_id % 20 = 0")
        order = Window.partitionBy("user_id", "book_id").orderBy(F.col("rating").desc(), F.col("is_read").desc(), F.col("is_reviewed").desc())
        self.requests = rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("user_id", "book_id", "rating", F.when(F.col("is_read") == 1, "finished").otherwise("reading").alias("status"), (F.col("is_reviewed") == 1).alias("bookmarked"))
        self.meta = written(hybrid.with_popularity(views.book_meta(spark, sf)), "meta")
        self.works = views.book_works(spark, sf)
        self.model_books = self.meta.where("book_id % 2 = 0").select("book_id")
        self.resolved = written(serve.resolve_editions(self.requests, self.model_books, self.works, self.meta), "requests")
        e = views.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("factor"))
        n = e.agg(F.count("*").alias("n"))
        self.items = self.model_books.crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("book_id") % F.col("n")).join(e, "vec_id").select("book_id", "factor")


@query("sv_01_work_map", with_(SQL_WORKS, select="SELECT work_id, count(*) AS editions, min(book_id) AS first_book, max(book_id) AS last_book FROM works WHERE work_id IS NOT NULL GROUP BY 1"))
def sv_01(spark, sf):
    return views.book_works(spark, sf).where("work_id IS NOT NULL").groupBy("work_id").agg(F.count("*").alias("editions"), F.min("book_id").alias("first_book"), F.max("book_id").alias("last_book"))


@query("sv_02_edition_resolution", with_(*_SV, select="SELECT user_id, book_id, work_id, model_id FROM res"))
def sv_02(spark, sf):
    return Serving(spark, sf).resolved.select("user_id", "book_id", "work_id", "model_id")


@query("sv_03_request_signal", with_(*_SV, select="SELECT user_id, book_id, round(CASE WHEN rating > m THEN 1e0 + 4e1 * (rating - m) / 4e0 ELSE 0e0 END, 6) AS signal FROM res JOIN rm USING (user_id) WHERE rating > 0"))
def sv_03(spark, sf):
    requests = Serving(spark, sf).requests.where("rating > 0")
    means = requests.groupBy("user_id").agg(F.avg(F.col("rating").cast("double")).alias("m"))
    return requests.join(means, "user_id").select("user_id", "book_id", r6(serve.explicit_signal(F.col("rating").cast("double"), F.col("m"))).alias("signal"))


@query("sv_04_one_seed_signal", "SELECT round(1e0 + 4e1 * (5e0 - (5e0 + 5e0 * 3.94::DOUBLE) / 6e0) / 4e0, 6) AS signal")
def sv_04(spark, sf):
    return spark.range(1).select(r6(F.lit(serve.one_seed_signal())).alias("signal"))


@query("sv_05_normalize", with_(*_SV, select="SELECT user_id, book_id, round(signal, 6) AS signal, source_rank FROM src"))
def sv_05(spark, sf):
    return serve.normalize(Serving(spark, sf).resolved)[0].select("user_id", "book_id", r6("signal").alias("signal"), F.col("source_rank").cast("long").alias("source_rank"))


@query("sv_06_hybrid_recommend")
def sv_06(spark, sf):
    s = Serving(spark, sf)
    sources, blocked, works = serve.normalize(s.resolved)
    return serve.recommend(sources, blocked, works, s.items, s.works, s.meta)


@query("sv_07_popular_fallback", with_(*_SV, """blk AS (SELECT DISTINCT user_id, model_id AS book_id FROM res WHERE model_id IS NOT NULL)""", select="""SELECT user_id, book_id, rank FROM (SELECT u.user_id, book_id, row_number() OVER (PARTITION BY u.user_id ORDER BY ratings_count DESC, average_rating DESC, book_id) AS rank
  FROM (SELECT DISTINCT user_id FROM req) u CROSS JOIN meta ANTI JOIN blk USING (user_id, book_id)) WHERE rank <= 20"""))
def sv_07(spark, sf):
    s = Serving(spark, sf)
    return serve.popular(s.meta, s.requests, serve.normalize(s.resolved)[1]).withColumn("rank", F.col("rank").cast("long"))


@query("sv_08_similar_to_book")
def sv_08(spark, sf):
    s = Serving(spark, sf)
    seeds = views.table(spark, sf, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("user_id"), F.col("p_partkey").alias("book_id"))
    return serve.similar_to(seeds, s.model_books, s.items, s.works, s.meta, 10)


@query("sv_09_reasons", with_(*_SV, """cand AS (SELECT u.user_id, book_id FROM (SELECT DISTINCT user_id FROM src) u CROSS JOIN meta)""", select="""SELECT c.user_id, c.book_id, CASE WHEN EXISTS (SELECT 1 FROM src s JOIN meta ms ON ms.book_id = s.book_id WHERE s.user_id = c.user_id AND s.source_rank <= 3 AND list_has_any(ms.authors, m.authors)) THEN 'author'
  WHEN len(m.genres) > 0 THEN 'genre' ELSE 'collaborative' END AS reason FROM cand c JOIN meta m USING (book_id)"""))
def sv_09(spark, sf):
    s = Serving(spark, sf)
    sources = serve.normalize(s.resolved)[0]
    candidates = sources.select("user_id").distinct().crossJoin(s.meta.select("book_id"))
    return serve.reasons(candidates, sources, s.meta, 3)
