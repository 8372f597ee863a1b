"""Operators that SQL cannot express, against small independent versions in NumPy and plain Python."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import als, evaluate, hybrid, ncf, serve, text
from lectern.plans import q_signals


def solved(entries, factors, reg):
    """One row's factor from {id: signal}, by the normal equations written out."""
    f = np.array(list(factors.values()))
    a, b = f.T @ f + reg * np.eye(f.shape[1]), np.zeros(f.shape[1])
    for i, s in entries.items():
        a += (abs(s) - 1) * np.outer(factors[i], factors[i])
        b += abs(s) * (s > 0) * factors[i]
    return np.linalg.solve(a, b)


def ranked(x, factors, skip):
    order = sorted((-round(float(x @ f), 9), i) for i, f in factors.items() if i not in skip)
    return [(i, -s) for s, i in order]


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(8)
    factors = {k: rng.normal(0, 1, 6) for k in range(1, 41)}
    rows = {u: {int(i): float(rng.choice([-3.5, 1.0, 7.0, 12.5])) for i in rng.choice(np.arange(1, 41), 6 + u % 5, replace=False)} for u in range(1, 13)}
    return factors, rows


def frames(spark, factors, rows):
    items = spark.createDataFrame([(k, f.tolist()) for k, f in factors.items()], "book_id long, factor array<double>")
    return items, spark.createDataFrame([(u, i, s) for u, r in rows.items() for i, s in r.items()], "user_id long, book_id long, signal double")


def test_fold_in(spark, model):
    factors, rows = model
    items, entries = frames(spark, factors, rows)
    got = {r.user_id: r.factor for r in als.fold_in(entries, items, 0.7).collect()}
    assert set(got) == set(rows)
    for u, r in rows.items():
        assert np.allclose(got[u], solved(r, factors, 0.7), atol=1e-9)


@pytest.mark.parametrize("block", [2048, 7])
def test_top_and_similar_items(spark, model, monkeypatch, block):
    """Blocks of any size give the same lists; equal scores go by id; what is stored is left out, however much it is."""
    monkeypatch.setattr(als, "BLOCK", block)
    factors, rows = model
    factors = factors | {50: factors[3], 51: factors[3], 52: np.zeros(6)}
    items, entries = frames(spark, factors, rows | {1: {i: 1.0 for i in range(1, 38)}})
    stored = {u: set(r) for u, r in rows.items()} | {1: set(range(1, 38))}
    users = {u: factors[u] for u in rows}
    df = spark.createDataFrame([(u, f.tolist()) for u, f in users.items()], "user_id long, factor array<double>")
    got = als.top_items(df, items.repartition(3), entries, 9).collect()
    for u, f in users.items():
        mine = sorted((r["rank"], r.book_id, r.score) for r in got if r.user_id == u)
        expected = ranked(f, factors, stored[u])[:9]
        assert [m[1] for m in mine] == [i for i, _ in expected] and np.allclose([m[2] for m in mine], [s for _, s in expected], atol=1e-8)
    unit = {k: f / n if (n := np.linalg.norm(f)) else f for k, f in factors.items()}
    similar = als.similar_items(items.repartition(3), items.where("book_id IN (3, 9, 52)"), 5).collect()
    for q in (3, 9, 52):
        assert [r.book_id for r in sorted(similar, key=lambda r: r["rank"]) if r.source_id == q] == [i for i, _ in ranked(unit[q], unit, {q})[:5]]


def test_hold_out_evaluation(spark, model):
    """EV-04 to EV-06: fold the rest in, rank without it, measure the hidden item's place."""
    factors, rows = model
    items, entries = frames(spark, factors, rows)
    hidden = {u: next(i for i, s in r.items() if s > 0) for u, r in rows.items() if any(s > 0 for s in r.values())}
    held = spark.createDataFrame(list(hidden.items()), "user_id long, book_id long")
    got = q_signals._evaluated(entries.join(held.select("user_id"), "user_id", "left_semi"), held, items, True).first()
    places = []
    for u, h in hidden.items():
        rest = {i: s for i, s in rows[u].items() if i != h}
        places.append([i for i, _ in ranked(solved(rest, factors, 1.0), factors, rest)].index(h) + 1)
    assert got.users_evaluated == len(hidden) and got.leaky
    for k in (5, 10, 20, 50):
        assert abs(got[f"hit_{k}"] - np.mean([p <= k for p in places])) < 1e-6
    assert abs(got.mrr_at_50 - np.mean([1 / p if p <= 50 else 0 for p in places])) < 1e-6


@pytest.fixture(scope="module")
def books():
    rng = np.random.default_rng(4)
    genres, authors = ["a", "b", "c", "d", "e"], ["x", "y", "z"]
    return {k: dict(authors=[str(rng.choice(authors))], genres=sorted(set(map(str, rng.choice(genres, 3)))) if k % 5 else [], average_rating=float(1 + k % 9 / 2), page_count=int(20 * (k % 30)), language=["en", "ru", ""][k % 3], popularity_norm=float(rng.random()), work_id=f"w{k // 2}" if k % 7 else None) for k in range(1, 41)}


def similar(c, s):
    both = set(c["genres"]) & set(s["genres"])
    return {
        "author": float(bool(set(c["authors"]) & set(s["authors"]))),
        "genre": len(both) / len(set(c["genres"]) | set(s["genres"])) if c["genres"] and s["genres"] else 0.0,
        "rating": max(0.0, 1 - abs(c["average_rating"] - s["average_rating"]) / 4),
        "page": max(0.0, 1 - abs(c["page_count"] - s["page_count"]) / 1000) if c["page_count"] > 0 and s["page_count"] > 0 else 0.0,
        "language": float(c["language"] != "" and c["language"] == s["language"]),
    }


def recommended(sources, blocked, works, factors, books, limit):
    """[(book, final, reason)] of one request: sources [(book, signal)] strongest first."""
    alpha, weights = hybrid.CONFIGS[hybrid.CHAMPION]
    pool = ranked(solved(dict(sources), factors, 1.0), factors, {b for b, _ in sources})
    total = sum(s for _, s in sources)
    content = []
    for b, _ in pool:
        mean = {k: sum(s * similar(books[b], books[x])[k] for x, s in sources) / total for k in ("author", "genre", "rating", "page", "language")}
        content.append(sum(weights[k] * v for k, v in (mean | {"popularity": books[b]["popularity_norm"]}).items()))
    scale = lambda v: np.zeros(len(v)) if np.ptp(v) <= 1e-12 else (np.array(v) - min(v)) / np.ptp(v)
    final = alpha * scale([s for _, s in pool]) + (1 - alpha) * scale(content)
    order = sorted(range(len(pool)), key=lambda k: (-round(float(final[k]), 9), k))
    strong = {a for b, _ in sources[:10] for a in books[b]["authors"]}
    reason = lambda b: "author" if strong & set(books[b]["authors"]) else "genre" if books[b]["genres"] else "collaborative"
    free = [k for k in order if pool[k][0] not in blocked and books[pool[k][0]]["work_id"] not in works]
    return [(pool[k][0], float(final[k]), reason(pool[k][0])) for k in free[:limit]]


def _served(spark, factors, books):
    items = spark.createDataFrame([(k, f.tolist()) for k, f in factors.items()], "book_id long, factor array<double>")
    rows = [(k, b["authors"], b["genres"], b["average_rating"], b["page_count"], b["language"], b["popularity_norm"], k * 3 % 17) for k, b in books.items()]
    meta = spark.createDataFrame(rows, "book_id long, authors array<string>, genres array<string>, average_rating double, page_count int, language string, popularity_norm double, ratings_count long")
    works = spark.createDataFrame([(k, b["work_id"]) for k, b in books.items()], "book_id long, work_id string")
    return items, meta, works


def test_hybrid_recommend(spark, model, books):
    factors, rows = model
    items, meta, works = _served(spark, factors, books)
    requests = {u: sorted(((i, abs(s)) for i, s in r.items() if s > 1), key=lambda x: (-x[1], x[0])) for u, r in rows.items()}
    requests = {u: s for u, s in requests.items() if s}
    blocked = {u: {i for i in rows[u]} for u in requests}
    gone = {u: {books[i]["work_id"] for i in list(rows[u])[:2]} - {None} for u in requests}
    src = spark.createDataFrame([(u, b, s, k + 1) for u, x in requests.items() for k, (b, s) in enumerate(x)], "user_id long, book_id long, signal double, source_rank int")
    blk = spark.createDataFrame([(u, b) for u, x in blocked.items() for b in x], "user_id long, book_id long")
    wrk = spark.createDataFrame([(u, w) for u, x in gone.items() for w in x], "user_id long, work_id string")
    got = serve.recommend(src, blk, wrk, items, works, meta, limit=8).collect()
    for u, s in requests.items():
        mine = sorted((r.place, r.book_id, r.score, r.reason) for r in got if r.user_id == u)
        expected = recommended(s, blocked[u], gone[u], factors, books, 8)
        assert [(m[1], m[3]) for m in mine] == [(b, why) for b, _, why in expected]
        assert np.allclose([m[2] for m in mine], [x for _, x, _ in expected], atol=1e-8)


def test_similar_to_one_book(spark, model, books):
    """The seed itself or the edition of its work with most ratings; a book unknown to the model gives nothing."""
    factors, _ = model
    known = {k: f for k, f in factors.items() if k % 2 == 0}
    items, meta, works = _served(spark, known, books)
    seeds = {1: 4, 2: 11, 3: 7, 4: 999}
    df = spark.createDataFrame(list(seeds.items()), "user_id long, book_id long")
    got = serve.similar_to(df, items.select("book_id"), items, works, meta, 6).collect()
    signal = 1 + 40 * (5 - (5 + 5 * 3.94) / 6) / 4
    for u, b in seeds.items():
        own = b if b in known else None
        if own is None and b in books and books[b]["work_id"]:
            editions = [k for k in known if books[k]["work_id"] == books[b]["work_id"]]
            own = max(editions, key=lambda k: (k * 3 % 17, -k)) if editions else None
        mine = [r.book_id for r in sorted(got, key=lambda r: r.place) if r.user_id == u]
        expected = [] if own is None else [x for x, _, _ in recommended([(own, signal)], {own}, {books[b]["work_id"]} - {None}, known, books, 6)]
        assert mine == expected, u


def test_network_extension_and_checkpoint(spark, tmp_path):
    net = ncf.Network(6, 5, dim=4, layers=(8, 3), seed=2)
    wider = net.extended(9)
    assert wider.user.shape == (9, 4) and (wider.user[:6] == net.user).all() and len({tuple(r) for r in wider.user}) == 9
    u, i = np.arange(6).repeat(5), np.tile(np.arange(5), 6)
    assert (wider.score(u, i) == net.score(u, i)).all()
    path = f"file://{tmp_path}/net"
    ncf.save(spark, path, wider)
    ncf.save(spark, path, net)
    again = ncf.load(spark, path)
    assert len(again.parameters) == len(net.parameters) and (again.score(u, i) == net.score(u, i)).all()
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in zip(u, i)], "user_idx int, item_idx int")
    by_hand = lambda a, b: float(1 / (1 + np.exp(-(np.maximum(np.maximum(np.r_[net.user[a], net.item[b]] @ net.w[0] + net.b[0], 0) @ net.w[1] + net.b[1], 0) @ net.w[2] + net.b[2])))[0])
    assert all(abs(r.score - by_hand(r.user_idx, r.item_idx)) < 1e-12 for r in ncf.score(pairs, net).collect())


def test_epub_chapters(spark):
    """Chapters in the order of the spine, not of the archive; empty ones go."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="OEBPS/book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        for name, body in (("z", "<h1>First one</h1><p>Fish &amp; chips</p>"), ("a", "<h1>Second one</h1><p>More</p>"), ("m", "  ")):
            z.writestr(f"OEBPS/{name}.xhtml", f"<html><head><style>p{{}}</style></head><body>{body}</body></html>")
        manifest = "".join(f'<item id="{n}" href="{n}.xhtml" media-type="application/xhtml+xml"/>' for n in "azm")
        z.writestr("OEBPS/book.opf", f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="2.0"><metadata/><manifest>{manifest}</manifest><spine><itemref idref="z"/><itemref idref="m"/><itemref idref="a"/></spine></package>')
    files = spark.createDataFrame([("x.epub", out.getvalue())], "path string, content binary")
    got = sorted((r.chapter_order, r.href.rsplit("/", 1)[-1], r.title, r.content) for r in text.read_epubs(files).collect())
    assert [g[1:3] for g in got] == [("z.xhtml", "First one"), ("a.xhtml", "Second one")]
    assert "Fish & chips" in got[0][3] and "More" in got[1][3] and got[0][0] < got[1][0]


def test_strip_page(spark):
    cases = {
        "<p>Head</p><p>MENU</p><p>One &amp; two</p>\n\n<p>three</p><p>Notes 1</p><p>after</p>": "MENU\nOne & two\nthree",
        "<p>no start</p><p>text</p>": "no start\ntext",
        "<p>Menu</p><p>a</p><p>© b</p>": "Menu\na",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "html string").withColumn("t", text.strip_page(F.col("html"), "menu", ["©", "Notes"]))
    assert {r.html: r.t for r in df.collect()} == cases


def test_metrics_written_out(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 3), (3, 60), (4, None)], "user_id long, rank int")
    got = evaluate.metrics(ranks).first()
    assert (got.users_evaluated, got.hit_5, got.hit_50) == (4, 0.5, 0.5) and abs(got.mrr_at_50 - (1 + 1 / 3) / 4) < 1e-6
