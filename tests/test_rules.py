"""Hand-computed cases and invariants."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.operators import als, canonical, catalog, evaluate, hybrid, item_cf, ncf, prep, serve, signals, split, store, text
from lectern.plans import experiments, q_interactions, q_signals
from lectern.sources import files, views
from lectern.sources.arrow import slices
from lectern.sources.scratch import written
from lectern.streaming import likes

SF = "/root/testdata/sf0.001"


def inter(spark, rows):
    return spark.createDataFrame([(*r, *(1, 0)[len(r) - 3 :]) for r in rows], "user_id long, book_id long, rating int, is_read int, is_reviewed int")


def test_observed(spark):
    df = inter(spark, [(1, 1, 4, 1), (1, 2, 0, 1), (1, 3, 0, 0)])
    assert [r.book_id for r in prep.observed(df).collect()] == [1]
    assert sorted(r.book_id for r in prep.observed(df, True).collect()) == [1, 2]
    with pytest.raises(ValueError):
        prep.observed(df.drop("rating"))


def test_frequency_filter_is_one_pass(spark):
    df = inter(spark, [(1, 1, 5), (1, 2, 5), (2, 1, 5), (3, 1, 5)])
    assert [(r.user_id, r.book_id) for r in prep.frequency_filter(df, 2, 2).collect()] == [(1, 1)]


def test_canonical_choice_and_train(spark):
    df = inter(spark, [(u, b, 4) for b, n in ((10, 3), (7, 3), (9, 1), (5, 1)) for u in range(1, n + 1)])
    works = spark.createDataFrame([(10, "w"), (7, "w"), (9, "w")], "book_id long, work_id string")
    mapping = canonical.canonical_map(df, works)
    assert {r.book_id: r.canonical_id for r in mapping.collect()} == {10: 7, 7: 7, 9: 7, 5: 5}
    train = inter(spark, [(1, 9, 4), (2, 9, 4)])
    left = canonical.canonical_train(train, inter(spark, [(1, 7, 5)]), mapping).collect()
    assert [(r.user_id, r.book_id) for r in left] == [(2, 7)]


def test_item_cf(spark):
    pairs = spark.createDataFrame([(1, 2, 20)], "left_id long, right_id long, co_likes long")
    counts = spark.createDataFrame([(1, 100), (2, 64)], "book_id long, likes long")
    assert abs(item_cf.damped_cosine(pairs, counts).first().score - 0.1) < 1e-12
    df = inter(spark, [(1, 9, 5), (1, 4, 5), (1, 7, 5), (1, 4, 5)])
    basket = item_cf.baskets(df, cap=2)
    assert basket.first().books == [4, 7]
    assert [tuple(r) for r in item_cf.pair_counts(basket).collect()] == [(4, 7, 1)]
    edges = spark.createDataFrame([(1, 3, 0.1, 5), (2, 3, 0.3, 6)], "book_id long, similar_id long, score double, co_likes long")
    mine = spark.createDataFrame([(1, 1, 5), (1, 2, 3)], "user_id long, book_id long, rating int")
    r = item_cf.recommend(edges, mine, mine).first()
    assert (round(r.score, 9), r.evidence, r.max_co_likes) == (0.35, 2, 6)
    with pytest.raises(LookupError):
        item_cf.similar(edges, 99)


def test_a_book_without_neighbours_gives_no_rows(spark):
    """Where neighbours are not required, as in cf_08_similar, a book outside the graph has an empty list, as in SQL."""
    edges = spark.createDataFrame([(1, 3, 0.1, 5)], "book_id long, similar_id long, score double, co_likes long")
    assert item_cf.similar(edges, 99, required=False).count() == 0
    assert item_cf.similar(edges, 1, required=False).count() == 1


def test_neighbours_are_symmetric(spark):
    edges = item_cf.symmetric(item_cf.damped_cosine(item_cf.pair_counts(item_cf.baskets(views.interactions_dense(spark, SF))), item_cf.like_counts(views.interactions_dense(spark, SF)), 1))
    back = edges.select(F.col("similar_id").alias("book_id"), F.col("book_id").alias("similar_id"), "score")
    assert edges.join(back, ["book_id", "similar_id", "score"], "left_anti").count() == 0


def test_signals(spark):
    means = signals.user_means(inter(spark, [(1, 1, 5), (1, 2, 3), (2, 1, 4)]))
    assert abs({r.user_id: r.user_mean for r in means.collect()}[1] - 4.0) < 1e-12
    assert signals.positive_signals(inter(spark, [(1, 1, 5)])).first().signal == 41
    fixed = spark.createDataFrame([(1, 4.0)], "user_id long, user_mean double")
    overall = spark.createDataFrame([(4.0,)], "global_mean double")
    out = signals.centered_signals(inter(spark, [(1, 1, 5), (1, 2, 3), (1, 3, 4), (1, 4, 0)]), fixed, overall)
    assert sorted((r.book_id, r.signal, r.kind) for r in out.collect()) == [(1, 11.0, "explicit"), (2, -11.0, "explicit"), (4, 1.0, "weak")]
    twice = spark.createDataFrame([(1, 1, 1.0, "weak"), (1, 1, -11.0, "explicit")], "user_id long, book_id long, signal double, kind string")
    assert signals.dedup_signals(twice).first().signal == -11


def test_als_row_solve_and_chunks(spark, monkeypatch):
    assert abs(als.solve(np.array([[6.0]]), np.array([[1.0], [2.0]]), np.array([3.0, 3.0]), np.ones(2))[0] - 0.5625) < 1e-12
    rng = np.random.default_rng(0)
    f = rng.normal(size=(30, 4))
    fixed = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(f)], "id long, factor array<double>")
    entries = [(r, c, float(s)) for r in range(5) for c, s in enumerate(rng.choice([-4.0, 1.0, 9.0], 30)) if rng.random() < 0.7]
    df = spark.createDataFrame(entries, "row long, col long, signal double")
    for chunk, limit in ((4096, 1 << 20), (3, 1 << 20), (3, 0)):  # whole rows, cut rows, joined factors
        monkeypatch.setattr(als, "CHUNK", chunk)
        for r in als.half_step(df, fixed, 0.5, limit).collect():
            s = np.array([x[2] for x in entries if x[0] == r.id])
            g = f[[x[1] for x in entries if x[0] == r.id]]
            a = f.T @ f + (g * (np.abs(s) - 1)[:, None]).T @ g + 0.5 * np.eye(4)
            assert np.abs(a @ np.array(r.factor) - g.T @ (np.abs(s) * (s > 0))).max() < 1e-8


def test_als_loss_falls(spark):
    rng = np.random.default_rng(1)
    m = spark.createDataFrame([(u, i, float(rng.choice([-3.0, 1.0, 11.0]))) for u in range(20) for i in range(15) if rng.random() < 0.4], "user_idx long, item_idx long, signal double")
    first = als.loss(m, *als.train(m, 4, 0.5, 1), 0.5)
    later = als.loss(m, *als.train(m, 4, 0.5, 3), 0.5)
    assert later <= first + 1e-6


def test_dense_index_over_partitions(spark):
    df = spark.range(0, 1000, 7).select(F.col("id").alias("book_id")).repartition(6)
    assert [tuple(r) for r in signals.dense_index(df, "book_id", "k").orderBy("k").collect()] == [(7 * k, k) for k in range(143)]


def test_similarities(spark):
    row = spark.range(1).select(
        hybrid.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("j"),
        hybrid.jaccard(F.expr("cast(array() as array<string>)"), F.array(F.lit("b"))).alias("j0"),
        hybrid.rating_similarity(F.lit(4.0), F.lit(3.0)).alias("r"),
        hybrid.page_similarity(F.lit(300), F.lit(800)).alias("p"),
        F.array(*(hybrid.dynamic_alpha(F.lit(n)) for n in (0, 25, 50, 80))).alias("a"),
    ).first()
    assert (round(row.j, 6), row.j0, row.r, row.p) == (0.333333, 0, 0.75, 0.5)
    assert [round(x, 3) for x in row.a] == [0.55, 0.725, 0.9, 0.9]
    lists = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 6.0), (2, 3.0), (2, 3.0)], "user_id long, v double")
    assert sorted(tuple(r) for r in lists.select("user_id", hybrid.minmax("v", "user_id")).collect()) == [(1, 0.0), (1, 0.5), (1, 1.0), (2, 0.0), (2, 0.0)]


def test_serving_signals(spark):
    assert round(serve.one_seed_signal(), 6) == 9.833333
    req = spark.createDataFrame([(1, 1, "w", 1, 5, "", False), (1, 2, "v", 2, 3, "FINISHED", False), (1, 3, None, 3, 0, "finished", False)], "user_id long, book_id long, work_id string, model_id long, rating int, status string, bookmarked boolean")
    sources, blocked, works = serve.normalize(req)
    assert {r.book_id: r.signal for r in sources.collect()} == {1: 11.0, 3: 1.0}
    assert sorted(r.book_id for r in blocked.collect()) == [1, 2, 3] and works.count() == 2


def test_metrics(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 3), (3, 60), (4, 200)], "user_id long, rank long")
    assert evaluate.hit_rates(ranks).first().hit_5 == 0.5
    assert evaluate.mrr_at(ranks).first()[0] == 0.333333
    assert evaluate.mrr_full(ranks).first()[0] == 0.337917 or abs(evaluate.mrr_full(ranks).first()[0] - (1 + 1 / 3 + 1 / 60 + 1 / 200) / 4) < 1e-6
    m = evaluate.metrics(ranks).first()
    assert m.hit_5 <= m.hit_10 <= m.hit_20 <= m.hit_50 and m.mrr_at_50 <= m.hit_50


def test_catalogue(spark):
    row = spark.range(1).select(
        F.array(*(catalog.strict_int(F.lit(x)) for x in ("12.0", "", "x"))).alias("strict"), F.array(*(catalog.lenient_int(F.lit(x)) for x in ("12.0", "", "x"))).alias("lenient"),
        F.create_map(F.lit("b"), F.lit(1), F.lit("A"), F.lit(3), F.lit("c"), F.lit(0)).alias("g"),
    )
    r = row.select("strict", "lenient", catalog.genres_sorted(F.col("g")).alias("a"), catalog.genres_by_count(F.col("g")).alias("b"), catalog.genres_with(F.col("g")).alias("c")).first()
    assert (r.strict, r.lenient) == ([0, 0, 0], [12, 0, 0])
    assert (r.a, r.b, r.c) == ("a;b", "A;b", "Poetry;b;A")


def test_match_confidence(spark):
    df = spark.createDataFrame([("Dracula!", "bram stoker"), ("Dracula's Guest", "Bram Stoker"), ("Dracula", "Other"), ("Emma", "X"), ("", "Bram Stoker")], "t string, a string")
    got = df.select(text.match_confidence(F.lit("Dracula"), F.lit("Bram Stoker"), F.col("t"), F.col("a"))).collect()
    assert [r[0] for r in got] == ["high", "medium", "low", "reject", "reject"]


def test_splitters():
    book = "x" * 600 + "\nCHAPTER I\n" + "a" * 600 + "\nCHAPTER II\n" + "b" * 600
    assert [t for t, _ in text.by_heading(book, text.ENGLISH_HEADING, after=500, front="Front Matter")] == ["Front Matter", "CHAPTER I", "CHAPTER II"]
    assert [len(b) for _, b in text.by_size("a" * 70 + "\n\n" + "b" * 60, 100)] == [70, 60]
    assert "".join(b for _, b in text.by_size("c" * 250, 100)) == "c" * 250
    assert text.at_ratios("ab\ncd\nef", (0.5,)) == ["ab", "cd\nef"]
    assert [t for t, _ in text.wiki_sections("== A ==\n" + "x" * 90 + "\n== References ==\n" + "y" * 90, "W")] == ["A"]
    assert text.paragraphs('<div class="k entry-content"><div><p>in</p></div><p>too</p></div><p>out</p>', "entry-content") == [("Paragraph 1", "in"), ("Paragraph 2", "too")]
    assert text.fixed_sections("A one B two", ["a", "b"]) == [("a", "A one"), ("b", "B two")]


def test_stores(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id long, title string, rating int")
    new = spark.createDataFrame([(2, "B", 0), (3, "C", 0)], "id long, title string, rating int")
    assert sorted(tuple(r) for r in store.upsert(t, new, "id", ["title"]).collect()) == [(1, "a", 5), (2, "B", 6), (3, "C", 0)]
    cut = store.replace_children(t, new.withColumn("title", F.repeat(F.lit("x"), 300)).where("id = 2"), "id")
    assert {r.id: len(r.title) for r in cut.collect()} == {1: 1, 2: 255}
    with pytest.raises(ValueError):
        store.assert_unique(t.union(t), "id")
    r = store.resolve_parent(spark.createDataFrame([(9, "a"), (2, "zz")], "id long, title string"), t, id_col="id", title="title").collect()
    assert sorted(x.parent_id for x in r) == [1, 2]


def test_seeded_order_and_splits(spark):
    one = spark.range(1).select(F.lit(7).alias("user_id"), F.lit(9).alias("book_id")).select(split.seeded(42, "user_id", "book_id")).first()[0]
    assert one == "fd45b60e767b4e2c64d1c5dfd97c23e7"
    train, held = split.leave_one_liked_out(views.interactions_dense(spark, SF), max_users=20)
    assert held.count() == 20 and train.join(held, ["user_id", "book_id"]).count() == 0


def test_network_gradients_and_training(spark):
    net = ncf.Network(4, 5, dim=3, layers=(4,))
    for p in net.parameters:
        p += np.random.default_rng(0).normal(0, 0.3, p.shape)
    u, i, y = np.array([0, 1, 2, 3]), np.array([0, 1, 4, 4]), np.array([1.0, 0, 1, 0])
    _, grads = net.gradients(u, i, y)
    for p, g in zip(net.parameters, grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        p[at] += 1e-6
        up = net.gradients(u, i, y)[0]
        p[at] -= 2e-6
        down = net.gradients(u, i, y)[0]
        p[at] += 1e-6
        assert abs((up - down) / 2e-6 - g[at]) < 1e-5
    pairs = spark.createDataFrame([(a, b, int(b < 3)) for a in range(10) for b in range(6)], "user_idx long, item_idx long, label int")
    net, history = ncf.train(pairs, 10, 6, epochs=40, batch=16, lr=0.01)
    assert history[-1]["loss"] < 0.2 < history[0]["loss"]
    with pytest.raises(ValueError):
        ncf.train(pairs, 10, 6, max_pairs=5)


def test_grid_is_resumed(spark, tmp_path):
    calls = []
    run = lambda c: calls.append(c["name"]) or spark.createDataFrame([(c["reg"],)], "mrr_at_50 double")
    grid = experiments.als_grid(regs=(0.5, 1.0))
    for _ in range(2):
        out = experiments.run_grid(spark, str(tmp_path), grid, run)
    assert calls == ["reg_0.5", "reg_1"] and experiments.best(out) == "reg_1"


def test_stream_equals_batch(spark, tmp_path):
    events = views.interactions_events(spark, SF).select("ts", "book_id", "rating")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = likes.windowed_likes(stream, late="400 days").writeStream.outputMode("complete").format("memory").queryName("likes").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(map(tuple, spark.table("likes").collect())) == sorted(map(tuple, likes.windowed_likes(events).collect()))


def test_json_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n[{"id": 1}, {"id": 2}]')
    (tmp_path / "b.json").write_text('{"id": 1}\n\n{"id": 2}\n')
    for name in "ab":
        assert sorted(r.id for r in files.read_json(spark, str(tmp_path / f"{name}.json"), "id long").collect()) == [1, 2]


def test_negatives_are_drawn_without_replacement(spark):
    """Wanted numbers of distinct items outside the user's own; all there are where fewer; a different set for each user."""
    items = spark.range(100, 340).select(F.col("id").alias("book_id"))
    own = [(u, 100 + (7 * u + k) % 240) for u in range(1, 31) for k in range(u)] + [(40, b) for b in range(100, 335)]
    exclude = spark.createDataFrame(own, "user_id long, book_id long")
    users = spark.createDataFrame([(u, 20) for u in range(1, 31)] + [(40, 20), (41, 0), (42, 1000)], "user_id long, want int")
    got = split.negatives(users, items, exclude, 0).collect()
    by = {}
    for r in got:
        by.setdefault(r.user_id, []).append(r.book_id)
    assert {u: len(b) for u, b in by.items()} == {u: 20 for u in range(1, 31)} | {40: 5, 42: 240}
    assert all(len(set(b)) == len(b) and not {(u, x) for x in b} & set(own) for u, b in by.items())
    assert len({tuple(sorted(by[u])) for u in range(1, 31)}) == 30
    assert len({x for u in range(1, 31) for x in by[u]}) > 200  # 600 draws over 240 items
    assert split.negatives(users, items.limit(0), exclude, 3).count() == 0
    assert [split.prime_from(n) for n in (0, 2, 8, 9, 23, 24, 240)] == [2, 2, 11, 11, 23, 29, 241]


def test_a_hot_genre_is_dealt_over_tasks(spark):
    """Where one genre holds every book, the join by genre is split by size on its hot side; results stay."""
    books = [(k, [f"a{k % 997}"], ["hot", f"g{k % 40}"], (k % 100) / 100) for k in range(20_000)]
    meta = spark.createDataFrame(books, "book_id long, authors array<string>, genres array<string>, popularity_norm double").repartition(8)
    sources = spark.createDataFrame([(u, u * 31 + s, 1.0 + s) for u in range(10) for s in range(3)], "user_id long, source_id long, weight double").repartition(4)
    blocked = spark.createDataFrame([(0, 5), (1, 7)], "user_id long, book_id long")
    plain = sorted(map(tuple, hybrid.rough_candidates(sources, meta, blocked, n=20, popular=10).collect()))
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        out = hybrid.rough_candidates(sources, meta, blocked, n=20, popular=10)
        got = sorted(map(tuple, out.collect()))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == plain and len(got) == 200
    assert "skew=true" in plan


def test_equal_vectors_are_multiplied_once(spark, monkeypatch):
    """Items of one vector are one row of a block: a query gets its few best, not the best of every seven items."""
    monkeypatch.setattr(als, "BLOCK", 7)
    items = spark.createDataFrame([(k, [float(k % 3), 1.0]) for k in range(300)], "book_id long, factor array<double>")
    queries = spark.createDataFrame([(1, 0, [1.0, 0.0])], "query long, extra long, factor array<double>")
    got = sorted((-r.score, r.book_id) for r in als._best_of_blocks(queries, items, 5).collect())
    assert got == [(-2.0, k) for k in (2, 5, 8, 11, 14)]


def test_candidates_meet_profiles_without_a_row_a_pair(spark):
    """A pair of candidate and source is no row, so what is shuffled grows with candidates and sources alone."""
    meta = spark.createDataFrame([(k, ["x"], ["a", f"g{k % 3}"], 3.0, 100, "en", 0.5) for k in range(9)], "book_id long, authors array<string>, genres array<string>, average_rating double, page_count int, language string, popularity_norm double")
    candidates = spark.createDataFrame([(1, k) for k in range(9)] + [(2, 3), (1, 77)], "user_id long, book_id long")
    sources = spark.createDataFrame([(1, 0, 1.0, 1), (1, 1, 3.0, 2)], "user_id long, source_id long, weight double, source_rank int")
    out = hybrid.components(candidates, sources, meta)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.user_id, r.book_id): (r.author, round(r.genre, 9), r.popularity) for r in out.collect()}
    assert len(got) == 11 and got[2, 3] == got[1, 77] == (0.0, 0.0, 0.0)
    assert got[1, 0] == (1.0, 0.5, 0.5) and got[1, 1] == (1.0, round((1 / 3 + 3) / 4, 9), 0.5)


def test_rough_candidates_form_no_row_a_user_and_genre_hit(spark, monkeypatch):
    """Hits are summed in the task that holds the catalogue; results equal sums written out, with users in several groups."""
    monkeypatch.setattr(hybrid, "USERS", 2)
    books = {k: ([f"a{k % 4}"], [f"g{k % 3}", f"h{k % 2}"] if k % 5 else [], k % 7 / 7) for k in range(40)}
    meta = spark.createDataFrame([(k, *v) for k, v in books.items()], "book_id long, authors array<string>, genres array<string>, popularity_norm double")
    mine = {u: {(u * 7 + s * 3) % 40: 1.0 + s for s in range(3)} for u in range(6)}
    gone = {0: {1, 5}, 3: {2}}
    sources = spark.createDataFrame([(u, b, w) for u, x in mine.items() for b, w in x.items()], "user_id long, source_id long, weight double")
    blocked = spark.createDataFrame([(u, b) for u, x in gone.items() for b in x], "user_id long, book_id long")
    out = hybrid.rough_candidates(sources, meta, blocked, n=9, popular=5)
    assert not re.search(r"HashAggregate\(keys=\[user_id#\d+L?, book_id#", out._jdf.queryExecution().executedPlan().toString())
    top = sorted(books, key=lambda k: (-books[k][2], -k))[:5]
    for u, x in mine.items():
        points = {b: 0.01 * (5 - r) / 5 for r, b in enumerate(top)}
        for b, w in x.items():
            for k, (authors, genres, _) in books.items():
                if authors == books[b][0]:
                    points[k] = points.get(k, 0) + 3 * w
                for g in set(genres) & set(books[b][1]):
                    points[k] = points.get(k, 0) + w / len(books[b][1])
        expected = sorted((-round(p, 9), k) for k, p in points.items() if k not in gone.get(u, ()))[:9]
        assert [(-r.rough, r.book_id) for r in sorted(out.where(F.col("user_id") == u).collect(), key=lambda r: r.rough_rank)] == expected


def _small_shelf(spark):
    """Forty books with copies and ties, six users, some of their books blocked."""
    books = {k: ([f"a{k % 4}"], ["", f"g{k % 3}", f"h{k % 2}"] if k % 5 else [], 1 + k % 5, 100 * (k % 4), k % 7 / 7) for k in range(40)}
    meta = spark.createDataFrame([(k, *v, "en") for k, v in books.items()], "book_id long, authors array<string>, genres array<string>, average_rating long, page_count int, popularity_norm double, language string")
    mine = {u: {(u * 7 + s * 3) % 40: 1.0 + s for s in range(3)} for u in range(6)}
    gone = {0: {1, 5}, 3: {2}}
    sources = spark.createDataFrame([(u, b, w, k + 1) for u, x in mine.items() for k, (b, w) in enumerate(x.items())], "user_id long, source_id long, weight double, source_rank int")
    blocked = spark.createDataFrame([(u, b) for u, x in gone.items() for b in x], "user_id long, book_id long")
    return books, mine, gone, sources, meta, blocked


def _lists_of(out):
    got = {}
    for r in out.orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append((-round(r.score, 9), r.book_id))
    return got


def _jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0


def test_exact_authors_form_no_row_a_user_and_book(spark):
    books, mine, gone, sources, meta, blocked = _small_shelf(spark)
    out = hybrid.exact_author_candidates(sources, meta, blocked, n=7)
    assert not re.search(r"HashAggregate\(keys=\[user_id#\d+L?, book_id#", out._jdf.queryExecution().executedPlan().toString())
    expected = {}
    for u, x in mine.items():
        points = {}
        for b, w in x.items():
            for k, v in books.items():
                if v[0] == books[b][0] and k not in gone.get(u, ()):
                    points[k] = points.get(k, 0) + w + 0.05 * v[4]
        expected[u] = sorted((-round(p, 9), k) for k, p in points.items())[:7]
    assert _lists_of(out) == expected


def test_confident_genres_compare_sets_not_books(spark):
    """Users and books meet as sets of genres; a user and a book of theirs is no row."""
    books, mine, gone, sources, meta, blocked = _small_shelf(spark)
    out = hybrid.confident_genre_candidates(sources, meta, blocked, n=7, least=0.2)
    assert not re.search(r"HashAggregate\(keys=\[user_id#\d+L?, book_id#", out._jdf.queryExecution().executedPlan().toString())
    expected = {}
    for u, x in mine.items():
        near = {k: sum(w * _jaccard(v[1], books[b][1]) for b, w in x.items()) / sum(x.values()) for k, v in books.items()}
        expected[u] = sorted((-round(p + 0.02 * books[k][4], 9), k) for k, p in near.items() if p > 0 and round(p, 9) >= 0.2 and k not in gone.get(u, ()))[:7]
    assert _lists_of(out) == {u: x for u, x in expected.items() if x}


@pytest.mark.parametrize("wide", (1, 1000))
def test_source_neighbours_form_no_row_a_source_and_book(spark, monkeypatch, wide):
    """Only the best books of a source leave its task, found by bounds over books of equal names; with sources in one group or several."""
    monkeypatch.setattr(hybrid, "SOURCES", wide)
    books, mine, gone, sources, meta, blocked = _small_shelf(spark)
    out = hybrid.source_neighbor_candidates(sources, meta, blocked, top_sources=2, per_source=4)
    assert not re.search(r"HashAggregate\(keys=\[user_id#\d+L?, source_id#", out._jdf.queryExecution().executedPlan().toString())
    expected = {}
    for u, x in mine.items():
        best = {}
        for b, w in list(x.items())[:2]:
            s, near = books[b], []
            for k, v in books.items():
                alike = _jaccard(v[1], s[1])
                if k not in gone.get(u, ()) and (v[0] == s[0] or alike):
                    page = max(0.0, 1 - abs(v[3] - s[3]) / 1000) if v[3] and s[3] else 0.0
                    near.append((-round(w * (0.25 * (v[0] == s[0]) + 0.5 * alike + 0.1 * (1 - abs(v[2] - s[2]) / 4) + 0.05 * page + 0.1 * v[4]), 9), k))
            for p, k in sorted(near)[:4]:
                best[k] = min(best.get(k, 0), p)
        expected[u] = sorted((p, k) for k, p in best.items())
    assert _lists_of(out) == expected


def test_full_catalogue_ranks_form_no_row_a_user_and_item(spark):
    """Ranks counted where users meet items equal those of the written grid; only counts of users are shuffled."""
    rng = np.random.default_rng(3)
    users = spark.createDataFrame([(u + 50, u) for u in range(12)], "user_id long, user_idx long")
    items = spark.createDataFrame([(2 * b, b) for b in range(30)], "book_id long, item_idx long")
    seen = spark.createDataFrame([(u + 50, 2 * b) for u in range(12) for b in range(30) if rng.random() < 0.3], "user_id long, book_id long")
    hidden = spark.createDataFrame([(u + 50, 2 * int(rng.integers(30))) for u in range(11)], "user_id long, book_id long")
    scored = lambda df: df.select("user_id", "book_id", ((F.col("user_id") * 31 + F.col("book_id") * 17) % 7).cast("double").alias("score"))
    out = evaluate.rank_in_catalog(hidden, items, seen, scored)
    expected = evaluate.rank_among(scored(ncf.full_catalog(users.join(hidden, "user_id", "left_semi"), items, seen, hidden)), hidden)
    assert sorted(tuple(r) for r in out.select("user_id", "book_id", "rank").collect()) == sorted(tuple(r) for r in expected.select("user_id", "book_id", "rank").collect())
    net = ncf.Network(12, 30, dim=3, layers=(4, 3))
    for p in net.parameters:
        p += rng.normal(0, 0.3, p.shape)
    net.item[5:9] = net.item[5]  # ties
    asking = hidden.join(users, "user_id").join(items, "book_id")
    got = ncf.full_catalog_ranks(asking, seen.join(items, "book_id").select("user_id", "item_idx"), net, chunk=8)
    grid = ncf.full_catalog(users.join(hidden, "user_id", "left_semi"), items, seen, hidden).join(users, "user_id").join(items, "book_id")
    expected = evaluate.rank_among(ncf.score(grid, net).withColumn("score", F.round("score", 9)), hidden)
    assert sorted(tuple(r) for r in got.collect()) == sorted((r.user_id, r["rank"]) for r in expected.collect())


def test_training_reads_the_pairs_of_its_users_alone(spark):
    """Evaluations of the most active users do not carry everybody's pairs along."""
    _, pairs, hidden, positives = q_interactions._training(spark, SF, 5)
    assert pairs.select("user_id").distinct().count() == 5 and hidden.count() <= 5
    assert positives.count() == pairs.count() - hidden.count()


def test_a_catalogue_reaches_python_by_rows_not_by_pairs_of_blocks(spark, monkeypatch):
    """Queries and vectors are dealt to groups and shards; no row carries a block, so a batch's bytes do not grow with the catalogue."""
    monkeypatch.setattr(als, "BLOCK", 16)
    rng = np.random.default_rng(5)
    items = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rng.normal(size=(200, 3)))], "book_id long, factor array<double>")
    queries = items.where("book_id % 5 = 0").selectExpr("book_id AS query", "2 AS extra", "factor")
    out = als._best_of_blocks(queries, items, 4)
    assert "Cartesian" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    m = np.array([r.factor for r in items.orderBy("book_id").collect()])
    got = {}
    for r in out.collect():
        got.setdefault(r["query"], []).append((-r.score, r.book_id))
    for k in range(0, 200, 5):
        assert [b for _, b in sorted(got[k])[:6]] == np.argsort(-(m @ m[k]), kind="stable")[:6].tolist()


def test_hidden_items_are_ranked_without_lists(spark, monkeypatch):
    """Counted ranks equal the places in top_items, with ties, stored items, unknown users and books; no window ranks candidates."""
    monkeypatch.setattr(als, "BLOCK", 8)
    rng = np.random.default_rng(6)
    vectors = rng.integers(-1, 2, (60, 2)).astype(float)  # many equal ones
    items = spark.createDataFrame([(3 * k, x.tolist()) for k, x in enumerate(vectors)], "book_id long, factor array<double>")
    users = spark.createDataFrame([(u, x.tolist()) for u, x in enumerate(rng.integers(-1, 2, (20, 2)).astype(float))], "user_id long, factor array<double>")
    hidden = [(u, 3 * int(rng.integers(60))) for u in range(20)] + [(77, 3)]
    hidden[4] = (4, 1000)
    stored = spark.createDataFrame([(u, 3 * int(b)) for u, h in hidden[:20] for b in rng.choice(60, 6) if 3 * b != h] + [(2, 2000)], "user_id long, book_id long")
    hidden = spark.createDataFrame(hidden, "user_id long, book_id long")
    out = als.hidden_ranks(users, items, stored, hidden, 9)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    expected = evaluate.hidden_ranks(als.top_items(users, items, stored, 9), hidden)
    got = sorted((r.user_id, r.book_id, r["rank"] or 0) for r in out.collect())
    assert got == sorted((r.user_id, r.book_id, r["rank"] or 0) for r in expected.collect()) and any(r for _, _, r in got) and not all(r for _, _, r in got)


def test_signals_are_computed_once(spark):
    """What is built on the signals reads them as written rows; the joins behind them are not run again for every use."""
    plan = q_signals._signals(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_slices_bound_what_python_holds():
    """A batch of large texts is handed on a few megabytes at a time, whole and in order; an empty one gives nothing."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["x" * (1 << 20)] * 40)], ["id", "text"])
    parts = list(slices([batch, batch.slice(0, 0)]))
    assert max(p.num_rows for p in parts) <= 8 and [k for p in parts for k in p.column(0).to_pylist()] == list(range(40))


def test_a_half_step_reads_written_chunks_without_a_shuffle(spark):
    """Rows grouped once are solved where they are read; only cut rows' sums are dealt."""
    entries = spark.createDataFrame([(r, c, 2.0 if (r + c) % 3 else -1.5) for r in range(5) for c in range(4)], "row long, col long, signal double")
    fixed = spark.createDataFrame([(c, [1.0 + c, 0.5 * c]) for c in range(4)], "id long, factor array<double>")
    out = als.half_step(written(als.grouped(entries), "chunks"), fixed, 1.0)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    direct = {r.id: r.factor for r in als.half_step(entries, fixed, 1.0).collect()}
    got = {r.id: r.factor for r in out.collect()}
    assert set(got) == set(range(5)) and all(np.allclose(got[k], direct[k]) for k in got)
