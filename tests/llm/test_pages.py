"""WARC round trips and main-text extraction."""

import gzip
import io
import zlib

import duckdb
from pyspark.sql import functions as F

from lectern.llm import html_extract, queries, warc
from lectern.llm.common import materialize, scratch_path, shared_dir


def _pages(spark):
    body = "<html>" + "x" * 200 + "</html>"
    rows = [(3, "http://a.org/1", body), (1, "http://a.org/2", body), (2, None, body), (4, "u", "tiny"), (5, "u", "tiny"), (6, "u", None), (7, "u", ""), (8, "bad\r\nurl", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nb" * 30), (9, "u", "é日本" * 100), (10, "u", "é日本" * 100)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_round_trip_matches_sql(spark):
    pages = _pages(spark)
    got = sorted(tuple(r) for r in warc.round_trip(pages).drop("url").collect())
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    assert got == sorted(con.execute(queries.oracle_sql()["op4_warc"]).fetchall())


def test_members_and_index(spark):
    folder, index = warc.archive_pages(_pages(spark))
    assert folder.startswith(shared_dir(spark))
    for r in index.collect():
        fs, path = warc._filesystem(r.archive)
        with fs.open_input_file(path) as f:
            f.seek(r.offset)
            one = zlib.decompress(f.read(r.length), 31)
            f.seek(0)
            whole = gzip.decompress(f.read())
        assert one in whole and one.startswith(b"WARC/1.1\r\n")


def test_records_of_reads_one_or_many_members():
    records = [warc.record({"WARC-Type": "response", "N": str(k)}, b"z" * k * 1000) for k in range(40)]
    for data in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        got = list(warc.records_of(io.BytesIO(data)))
        assert [(f["N"], len(b)) for f, b in got] == [(str(k), k * 1000) for k in range(40)]


def test_a_task_for_each_archive(spark):
    pages = spark.range(60).selectExpr("id AS page_id", "concat('http://h.org/', id) AS url", "repeat(concat('<p>', id % 7, '</p>'), 30) AS html").repartition(9)
    written = materialize(warc.write_monolithic(pages, scratch_path(spark, "raw")), "written")
    done = warc.normalise(written, warc.revisits(written), scratch_path(spark, "warc"))
    tasks = done.withColumn("task", F.spark_partition_id()).collect()
    assert len(tasks) == len({t.archive for t in tasks}) == len({t.task for t in tasks}) == written.select("archive").distinct().count() > 1
    assert sum(t.records for t in tasks) == 60


def test_narrow_and_text_ids(spark):
    body = "z" * 120
    for kind, ids in (("smallint", [3, 1, 2]), ("tinyint", [3, 1, 2]), ("int", [3, 1, 2]), ("string", ["c", "a", "b"])):
        pages = spark.createDataFrame([(i, "u", body) for i in ids], f"page_id {kind}, url string, html string")
        got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
        assert got == {ids[0]: ("revisit", ids[1]), ids[1]: ("response", None), ids[2]: ("revisit", ids[1])}


def test_null_ids_repeats_and_empty(spark):
    body = "y" * 150
    pages = spark.createDataFrame([(None, "u", body, 1), (5, "u", body, 1), (5, "u", body, 1), (None, None, None, None)], "page_id long, url string, html string, digest long")
    got = sorted(((r.page_id or 0), r.record_type, r.refers_to or 0) for r in warc.round_trip(pages).collect())
    assert got == [(0, "response", 0), (0, "revisit", 5), (5, "response", 0), (5, "response", 0)]
    assert warc.round_trip(pages.limit(0)).count() == 0


def _page(k, article, nav="Home About Contact", extra=""):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var x='</p>';</script></head><body><nav><ul><li><a href=/>{nav}</a></li></ul></nav>{extra}{article}<footer>&copy; site {k}</footer></body></html>"


def test_markup_decides_where_it_speaks(spark):
    article = "<article><h1>Title &amp; more</h1><p><b>First <i>par</i>agraph.<br><p>Second\n  one &lt;x&gt;</p><div class='comments'>great post</div><aside>related</aside></article>"
    extra = "<div class=ad>Buy now</div><form><input><label>mail</label></form><div id='cookie-notice'>We use cookies</div>"
    df = spark.createDataFrame([(1, "http://h.org/a", _page(1, article, extra=extra)), (2, "http://h.org/b", None), (3, None, ""), (4, None, None)], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(df).collect()}
    assert got[1] == ("Title & more First paragraph. Second one <x>", 44)
    assert got[2] == got[3] == got[4] == ("", 0)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_an_articles_own_header_stays(spark):
    page = "<body><div class='site-header'>Site</div><article><div class='entry-header'><h1>Name</h1></div><p>Text</p><div class='share-header'>Share</div></article></body>"
    df = spark.createDataFrame([(1, "http://h.org/a", page)], "page_id long, url string, html string")
    assert html_extract.extract(df).first().text == "Name Text"


def test_neighbours_shared_lines_go(spark):
    """Pages without a telling markup: lines shared with the nearest URL are furniture."""
    plain = lambda k: f"<body><div>Our great site</div><div>Menu one two three</div><p>Body {k} says {'something new ' * (k + 3)}</p><p>More of {k}</p><div>All rights reserved</div></body>"
    df = spark.createDataFrame([(k, f"http://h.org/x/{k}", plain(k)) for k in range(6)], "page_id long, url string, html string")
    for r in html_extract.extract(df).collect():
        assert r.text == f"Body {r.page_id} says {('something new ' * (r.page_id + 3)).strip()} More of {r.page_id}"


def test_copies_keep_their_text(spark):
    text = "<body><p>One page of text that is served under two addresses.</p><p>It stays whole.</p></body>"
    df = spark.createDataFrame([(k, f"http://h.org/{k}", text) for k in range(4)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract(df).collect()} == {"One page of text that is served under two addresses. It stays whole."}


def test_unshared_text_outside_the_article_stays(spark):
    page = lambda k: f"<body><div>Our site</div><article>Teaser {k}</article><div>Long story {k} {'and more ' * (k + 5)}</div><div>All rights reserved</div></body>"
    df = spark.createDataFrame([(k, f"http://h.org/{k}", page(k)) for k in range(6)], "page_id long, url string, html string")
    for r in html_extract.extract(df).collect():
        assert r.text == f"Teaser {r.page_id} Long story {r.page_id} {('and more ' * (r.page_id + 5)).strip()}"


def test_short_texts_lose_long_furniture_in_any_ranges(spark):
    """Long furniture around a short text, copies next to it, and as many ranges as pages."""
    page = lambda k: f"<body><div>{'A long menu of the site ' * 6}</div><p>Short text number {k}</p><div>{'Terms and notices ' * 8}</div></body>"
    df = spark.createDataFrame([(k, f"http://h.org/x/{k:02}", page(k // 3)) for k in range(24)], "page_id long, url string, html string")
    expected = {k: f"Short text number {k // 3}" for k in range(24)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 5, 24, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = [(r.page_id, r.text) for r in html_extract.extract(df).collect()]
            assert len(got) == 24 and dict(got) == expected, n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_markup_that_misleads(spark):
    """A slash at the end of an unquoted value closes nothing, and drawings and formulas belong to the article."""
    pages = [
        ("<body><p>Text</p><script src=/a/b/>var code = 1;</script><p>More</p></body>", "Text More"),
        ("<body><script/>code</script><style />p{}</style><p>Text</p></body>", "Text"),
        ("<body><article><p>Area <math><mi>x</mi><mo>=</mo><mn>2</mn></math> of <svg><text>a circle</text></svg></p><p><canvas>Chart of it</canvas></p><p><object data=/x/>A film</object></p></article></body>", "Area x=2 of a circle Chart of it A film"),
        ("<body><nav data-to=/a/>Menu</nav><p>Text<br/>on<hr/></p></body>", "Text on"),
    ]
    df = spark.createDataFrame([(k, f"http://h{k}.org/", p) for k, (p, _) in enumerate(pages)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == {k: text for k, (_, text) in enumerate(pages)}


def test_long_pages_repeated_rows_and_other_columns(spark):
    """Tens of thousands of equal lines, rows that repeat, null ids and columns named like the ones used inside."""
    line = "<div>The same line again</div>"
    page = lambda k: f"<body><div>Site</div>{line * 30_000}<p>Own {k}</p>{line * (9_000 + k)}<p>{'long text ' * 20_000}{k}</p></body>"
    rows = [(k, f"http://h.org/{k}", page(k), "x", 1) for k in (1, 2, 2)] + [(None, "http://h.org/2", page(2), None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, __host int")
    got = html_extract.extract(df).collect()
    assert len(got) == 5 and sorted(r.page_id or 0 for r in got) == [0, 0, 1, 2, 2]
    for r in got:
        if r.url and r.page_id:
            own = f"{'long text ' * 20_000}{r.page_id}"
            assert r.text.replace("The same line again ", "") == f"Own {r.page_id} {own}" and r.n_chars == len(r.text)


def test_partitions_do_not_matter(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("html", F.regexp_replace("html", "<(/?)article>", "<$1div>"))
    before, results = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 4, 211):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted((r.page_id, r.text) for r in html_extract.extract(df.repartition(1 + n % 7)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]


def test_differencing_changes_pages_without_an_article(spark):
    """On the given pages with the article's own markup gone, the neighbour decides on lines that no markup names."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    template = "<div>All of our pages begin so</div><div>And have this line too</div>"
    rows = [(r.page_id, f"http://one.org/{r.page_id:04}", r.html.replace("<article>", template).replace("</article>", "<div>And end so</div>")) for r in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html_extract.extract(df).collect():
        alone = html_extract.main_text(html_extract.lines_of(dict((k, h) for k, _, h in rows)[r.page_id]), None)
        assert "And have this line too" in alone and "And have this line too" not in r.text and "And end so" not in r.text


def test_longest_common_subsequence_of_many_equal_lines():
    from random import Random

    rng, before = Random(5), html_extract._PAIRS
    cases = [([rng.choice("abc") for _ in range(rng.randrange(90))], [rng.choice("abc") for _ in range(rng.randrange(90))]) for _ in range(100)]
    plain = [len(html_extract.shared_lines(a, b)) for a, b in cases]
    try:
        html_extract._PAIRS = 20
        for (a, b), n in zip(cases, plain):
            got, it = html_extract.shared_lines(a, b), iter(b)
            assert len(got) == n and all(a[k] in it for k in sorted(got))
    finally:
        html_extract._PAIRS = before
    assert len(html_extract.shared_lines(["x"] * 20_000 + ["y"] + ["x"] * 10_000, ["z"] + ["x"] * 25_000)) == 25_000


def test_longest_common_subsequence():
    from difflib import SequenceMatcher
    from random import Random

    rng = Random(4)
    for _ in range(200):
        a, b = (["".join(rng.choice("abcd")) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = html_extract.shared_lines(a, b)
        assert len(got) == table[-1][-1]
        it = iter(b)
        assert all(a[k] in it for k in sorted(got))
    assert SequenceMatcher


def test_main_text_of_given_pages(spark):
    """The article's text, whole, on pages that mark it."""
    import re
    from html import unescape

    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    for r in df.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        expected = " ".join(unescape(re.sub(r"<(?:/?(?:p|h1|br))[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert got[r.page_id] == expected
