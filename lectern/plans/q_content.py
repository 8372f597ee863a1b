"""Queries: NCF, catalogue, text, files and relational maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import als, catalog, evaluate, hybrid, item_cf, ncf, prep, signals, split, store, text
from ..sources import files, views
from ..sources.scratch import scratch, written
from ..sources.views import SQL_DENSE, SQL_WORKS
from ..streaming import likes
from .base import query, r6, with_
from .q_interactions import _ACTIVE, _CANDIDATES, _LOO, _NEG, _PAIRS, _eval_candidates, _training

# ---- NCF ------------------------------------------------------------------------------------


def _training_pairs(spark, sf):
    items, pairs, hidden, positives = _training(spark, sf)
    want = positives.groupBy("user_id").agg((4 * F.count("*")).alias("want"))
    return ncf.training_pairs(positives, split.negatives(want, items, pairs, 0)), hidden


@query("nc_05_training_pairs", with_(SQL_DENSE, _PAIRS, _LOO, _ACTIVE.format(n=5000), _NEG, select="SELECT user_id, book_id, 0 AS label FROM neg UNION ALL SELECT user_id, book_id, 1 FROM pairs p SEMI JOIN active USING (user_id) ANTI JOIN loo USING (user_id, book_id)"))
def nc_05(spark, sf):
    return _training_pairs(spark, sf)[0]


def _indexed(spark, sf):
    """Indexed training pairs, the index tables and the hidden items."""
    rows, hidden = _training_pairs(spark, sf)
    rows = written(rows, "training")
    users = signals.dense_index(rows, "user_id", "user_idx")
    items = signals.dense_index(views.interactions_dense(spark, sf), "book_id", "item_idx")
    users, items = written(users, "users"), written(items, "items")
    return written(rows.join(users, "user_id").join(items, "book_id"), "indexed"), users, items, hidden


@query("nc_01_forward_score")
def nc_01(spark, sf):
    rows, users, items, _ = _indexed(spark, sf)
    return ncf.score(rows.select("user_id", "book_id", "user_idx", "item_idx"), ncf.Network(users.count(), items.count()))


@query("nc_02_train")
def nc_02(spark, sf):
    rows, users, items, _ = _indexed(spark, sf)
    _, history = ncf.train(rows.select("user_idx", "item_idx", "label"), users.count(), items.count(), epochs=3)
    return spark.createDataFrame([(h["epoch"], h["loss"]) for h in history], "epoch int, loss double")


@query("nc_03_best_epoch")
def nc_03(spark, sf):
    """Train with periodic evaluation, then rank the hidden items in the full catalogue."""
    rows, users, items, hidden = _indexed(spark, sf)
    net, history = ncf.train(rows.select("user_idx", "item_idx", "label"), users.count(), items.count(), epochs=2)
    mine = hidden.join(users.select("user_id"), "user_id", "left_semi")
    asking = mine.join(users, "user_id").join(items, "book_id").select("user_id", "user_idx", "item_idx")
    ranks = ncf.full_catalog_ranks(asking, rows.where("label = 1").select("user_id", "item_idx"), net)
    return evaluate.mrr_full(ranks).withColumn("last_loss", F.lit(history[-1]["loss"]))


@query("nc_04_extended_embeddings")
def nc_04(spark, sf):
    """A trained network, with rows for the users it has not seen."""
    rows, users, items, _ = _indexed(spark, sf)
    known = users.count()
    net, _ = ncf.train(rows.select("user_idx", "item_idx", "label"), known, items.count(), epochs=1)
    new = split.unseen_users(prep.liked(views.interactions_dense(spark, sf), 1).select("user_id", "book_id").distinct(), users, least=1).count()
    wider = net.extended(known + new)
    return spark.createDataFrame([(k, bool(k >= known), x.tolist()) for k, x in enumerate(wider.user)], "user_idx int, is_new boolean, factor array<double>")


@query("snk_06_best_checkpoint")
def snk_06(spark, sf):
    """Weights are written whenever the evaluation improves, and read back: per epoch its MRR, if it was saved, if the file holds the best."""
    rows, users, items, hidden = _indexed(spark, sf)
    candidates = written(_eval_candidates(spark, sf)[0].join(users, "user_id").join(items, "book_id"), "candidates")  # every epoch reads them
    held = hidden.join(users.select("user_id"), "user_id", "left_semi")
    path, best, saved = scratch(spark, "checkpoint"), 0.0, []

    def evaluated(net):
        nonlocal best
        scored = ncf.score(candidates.select("user_id", "book_id", "user_idx", "item_idx"), net).select("user_id", "book_id", F.round("score", 9).alias("score"))
        mrr = evaluate.mrr_full(evaluate.rank_among(scored, held)).first()[0] or 0.0
        if mrr > best or not saved:
            best = mrr
            ncf.save(spark, path, net)
            saved.append(mrr)
        return mrr

    net, history = ncf.train(rows.select("user_idx", "item_idx", "label"), users.count(), items.count(), epochs=2, evaluate=evaluated)
    again = ncf.load(spark, path)
    same = all((p == q).all() for p, q in zip(net.parameters, again.parameters))
    return spark.createDataFrame([(h["epoch"], h["mrr"], h["mrr"] in saved, same) for h in history], "epoch int, mrr double, saved boolean, best_restored boolean")


def _SCORE(cand: str) -> str:
    return f"sc AS (SELECT user_id, book_id, ((user_id * 31 + book_id * 17) % 97)::DOUBLE AS score FROM {cand})"


_RANK = """rk AS (SELECT s.user_id, 1 + count(*) FILTER (s.score > m.score OR (s.score = m.score AND s.book_id < m.book_id)) AS rank FROM sc s JOIN (SELECT sc.* FROM sc SEMI JOIN loo USING (user_id, book_id)) m USING (user_id) GROUP BY 1)"""


def _scored(df):
    return df.select("user_id", "book_id", ((F.col("user_id") * 31 + F.col("book_id") * 17) % 97).cast("double").alias("score"))


@query("ev_03_mrr_full", with_(SQL_DENSE, _PAIRS, _LOO, _ACTIVE.format(n=5000), _CANDIDATES, _SCORE("cand"), _RANK, select="SELECT round(avg(1e0 / rank), 6) AS mrr_full FROM rk"))
def ev_03(spark, sf):
    candidates, hidden = _eval_candidates(spark, sf)
    return evaluate.mrr_full(evaluate.rank_among(_scored(candidates), hidden))


@query("ev_07_sampled_candidates", with_(SQL_DENSE, _PAIRS, _LOO, _ACTIVE.format(n=5000), _CANDIDATES, _SCORE("cand"), _RANK, select="SELECT user_id, rank FROM rk"))
def ev_07(spark, sf):
    candidates, hidden = _eval_candidates(spark, sf)
    return evaluate.rank_among(_scored(candidates), hidden).select("user_id", "rank")


@query("ev_08_full_catalog", with_(SQL_DENSE, _PAIRS, _LOO, _ACTIVE.format(n=5000), """fc AS (SELECT a.user_id, i.book_id FROM active a CROSS JOIN (SELECT DISTINCT book_id FROM dense) i ANTI JOIN (SELECT * FROM pairs ANTI JOIN loo USING (user_id, book_id)) USING (user_id, book_id))""", _SCORE("fc"), _RANK, select="SELECT user_id, rank FROM rk"))
def ev_08(spark, sf):
    items, pairs, hidden, _ = _training(spark, sf)
    return evaluate.rank_in_catalog(hidden, items, pairs, _scored).select("user_id", "rank")


# ---- catalogue ------------------------------------------------------------------------------

_SQL_RAW = """raw AS (SELECT p_partkey AS book_id, CASE p_partkey % 5 WHEN 0 THEN ' EN ' WHEN 1 THEN 'english' WHEN 2 THEN 'ru' WHEN 3 THEN 'xx' ELSE 'es' END AS language, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE '  ' || p_name || '  ' END AS title,
  CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'https://S.gr-assets.com/assets/NoPhoto/x.png' ELSE 'https://img.example.org/' || p_partkey END AS cover_url, coalesce(n, 0)::BIGINT AS ratings_count, 1 + (p_partkey % 41) / 1e1 AS average_rating,
  CASE WHEN p_partkey % 3 = 0 THEN p_partkey // 3 END AS model_rank FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey),
lang AS (SELECT *, CASE lower(trim(language)) WHEN 'en' THEN 'eng' WHEN 'english' THEN 'eng' WHEN 'ru' THEN 'rus' WHEN 'es' THEN 'spa' END AS code FROM raw),
ok AS (SELECT book_id, code AS language, title, cover_url, ratings_count, average_rating, model_rank FROM lang WHERE code IS NOT NULL AND trim(title) <> '' AND cover_url <> '' AND NOT contains(lower(cover_url), 'nophoto/'))"""


def _raw(spark, sf):
    part = views.book_meta(spark, sf).select("book_id", "title", "ratings_count", "average_rating")
    k = F.col("book_id")
    return part.select(
        "book_id",
        F.when(k % 5 == 0, " EN ").when(k % 5 == 1, "english").when(k % 5 == 2, "ru").when(k % 5 == 3, "xx").otherwise("es").alias("language"),
        F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("  "), "title", F.lit("  "))).alias("title"),
        F.when(k % 7 == 0, "").when(k % 7 == 1, "https://S.gr-assets.com/assets/NoPhoto/x.png").otherwise(F.concat(F.lit("https://img.example.org/"), k.cast("string"))).alias("cover_url"),
        "ratings_count", "average_rating", F.when(k % 3 == 0, F.floor(k / 3)).cast("long").alias("model_rank"),
    )


@query("cb_01_language", with_(_SQL_RAW, select="SELECT book_id, code AS language FROM lang"))
def cb_01(spark, sf):
    return _raw(spark, sf).select("book_id", catalog.language(F.col("language")).alias("language"))


@query("cb_02_real_cover", with_(_SQL_RAW, select="SELECT book_id, cover_url <> '' AND NOT contains(lower(cover_url), 'nophoto/') AS real FROM raw"))
def cb_02(spark, sf):
    return _raw(spark, sf).select("book_id", catalog.real_cover(F.col("cover_url")).alias("real"))


_NUMBERS = "(VALUES ('12'), ('12.0'), ('12.7'), (''), ('x'), (' 7 '), ('-3'), ('\\N'), (NULL)) t(v)"


@query("cb_03_numbers", f"SELECT v, coalesce(CASE WHEN regexp_matches(trim(v), '^[+-]?[0-9]+$') THEN trim(v)::BIGINT END, 0) AS strict, coalesce(trunc(try_cast(trim(v) AS DOUBLE))::BIGINT, 0) AS lenient FROM {_NUMBERS}")
def cb_03(spark, sf):
    rows = spark.createDataFrame([(x,) for x in ("12", "12.0", "12.7", "", "x", " 7 ", "-3", "\\N", None)], "v string")
    return rows.select("v", catalog.strict_int(F.col("v")).alias("strict"), catalog.lenient_int(F.col("v")).alias("lenient"))


@query("cb_04_clean_text", "SELECT p_partkey AS book_id, left(trim('  ' || p_name || ' '), 7) AS title FROM part")
def cb_04(spark, sf):
    return views.table(spark, sf, "part").select(F.col("p_partkey").alias("book_id"), catalog.clean(F.concat(F.lit(" \0 "), "p_name", F.lit(" ")), 7).alias("title"))


def _genre_counts(spark, sf):
    rows = views.table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count_if(F.col("l_quantity") > 25).alias("n"))
    names = F.create_map(F.lit("R"), F.lit("Drama"), F.lit("A"), F.lit("art"), F.lit("N"), F.lit("Noir"))
    return rows.groupBy(F.col("l_suppkey").alias("book_id")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(names[F.col("l_returnflag")], "n")))).alias("counts"))


_GENRES = "gc AS (SELECT l_suppkey AS book_id, CASE l_returnflag WHEN 'R' THEN 'Drama' WHEN 'A' THEN 'art' ELSE 'Noir' END AS g, count(*) FILTER (l_quantity > 25) AS n FROM lineitem GROUP BY 1, 2)"


@query("cb_05_genres", with_(_GENRES, select="""SELECT book_id, coalesce(string_agg(lower(g), ';' ORDER BY lower(g)) FILTER (n <> 0), '') AS sorted, coalesce(string_agg(g, ';' ORDER BY n DESC, g) FILTER (n > 0), '') AS by_count,
  'Poetry' || coalesce(';' || string_agg(g, ';' ORDER BY g) FILTER (n <> 0), '') AS with_poetry FROM gc GROUP BY 1"""))
def cb_05(spark, sf):
    c = F.col("counts")
    return _genre_counts(spark, sf).select("book_id", catalog.genres_sorted(c).alias("sorted"), catalog.genres_by_count(c).alias("by_count"), catalog.genres_with(c).alias("with_poetry"))


@query("cb_06_author_names", "SELECT s_suppkey AS book_id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey::VARCHAR ELSE s_name END || ', Anon' AS authors FROM supplier")
def cb_06(spark, sf):
    s = views.table(spark, sf, "supplier")
    author = lambda n, i: F.struct(n.alias("name"), i.alias("author_id"))
    authors = F.array(author(F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise(F.col("s_name")), F.col("s_suppkey").cast("string")), author(F.lit("Anon"), F.lit("0")), author(F.lit("Anon"), F.lit("1")))
    return s.select(F.col("s_suppkey").alias("book_id"), catalog.author_names(authors).alias("authors"))


@query("cb_07_model_rank", "SELECT p_partkey AS book_id, row_number() OVER (ORDER BY p_partkey) - 1 AS model_rank FROM part WHERE p_partkey % 3 = 0")
def cb_07(spark, sf):
    return catalog.model_rank(views.table(spark, sf, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("book_id")))


@query("cb_08_valid", with_(_SQL_RAW, select="SELECT book_id, language FROM ok"))
def cb_08(spark, sf):
    return catalog.valid(_raw(spark, sf)).select("book_id", "language")


_ORDER = "model_rank NULLS LAST, ratings_count DESC, average_rating DESC, book_id"


@query("cb_09_quota", with_(_SQL_RAW, f"q AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY {_ORDER}) AS lr FROM ok)", select=f"SELECT book_id, language FROM q ORDER BY CASE WHEN lr <= 20 THEN 0 ELSE 1 END, {_ORDER} LIMIT 100"))
def cb_09(spark, sf):
    return catalog.quota(catalog.valid(_raw(spark, sf)), 20, 100).select("book_id", "language")


@query("cb_10_top_per_language", with_(_SQL_RAW, """t1 AS (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY book_id) AS r2 FROM ok),
t2 AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY ratings_count DESC, average_rating DESC, book_id) AS place FROM t1 WHERE r2 = 1)""", select="SELECT book_id, language, place FROM t2 WHERE place <= 15"))
def cb_10(spark, sf):
    out = catalog.top_per_language(catalog.valid(_raw(spark, sf)).withColumn("file_order", F.col("book_id")), 15)
    return out.select("book_id", "language", F.col("place").cast("long").alias("place"))


_LINK = "mw AS (SELECT DISTINCT work_id FROM works WHERE book_id % 97 = 0 AND work_id IS NOT NULL), lk AS (SELECT ok.*, mw.work_id IS NOT NULL AS linked FROM ok LEFT JOIN works USING (book_id) LEFT JOIN mw ON mw.work_id = works.work_id)"


def _linked(spark, sf):
    works = views.book_works(spark, sf)
    return catalog.linked_expansion(catalog.valid(_raw(spark, sf)), works, works.where("book_id % 97 = 0"), 30, 300)


@query("cb_11_linked_expansion", with_(SQL_WORKS, _SQL_RAW, _LINK, select="SELECT book_id, linked FROM lk WHERE linked OR ratings_count >= 30 ORDER BY linked DESC, ratings_count DESC, average_rating DESC, title, book_id LIMIT 300"))
def cb_11(spark, sf):
    return _linked(spark, sf).select("book_id", "linked")


@query("cb_12_counts", with_(SQL_WORKS, _SQL_RAW, _LINK, select="SELECT language, linked, count(*) AS books FROM (SELECT * FROM lk WHERE linked OR ratings_count >= 30 ORDER BY linked DESC, ratings_count DESC, average_rating DESC, title, book_id LIMIT 300) GROUP BY 1, 2"))
def cb_12(spark, sf):
    return catalog.counts_by(_linked(spark, sf), "language", "linked")


# ---- text -----------------------------------------------------------------------------------


def _tidy_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[ \\t\\r\\f\\x0B]+', ' ', 'g'), ' *\\n *', '\\n', 'g'), '\\n{{3,}}', '\\n\\n', 'g'), '^\\s+|\\s+$', '', 'g')".replace("'\\n'", "chr(10)").replace("'\\n\\n'", "chr(10) || chr(10)")


def _squeeze_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(replace({x}, chr(160), ' '), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


_H = "regexp_replace(regexp_replace(regexp_replace(html, '<script.*?>.*?</script>|<style.*?>.*?</style>', '', 'gis'), '</(?:p|div|section|article|h[1-6]|li|br)>', chr(10), 'gi'), '<[^>]+>', '', 'g')"


def _pages(spark, sf):
    return views.table(spark, sf, "pages")


def _docs(spark, sf):
    return views.table(spark, sf, "documents")


@query("tx_01_html_to_text", f"SELECT page_id, md5({_tidy_sql(_H)}) AS text_md5 FROM pages")
def tx_01(spark, sf):
    return _pages(spark, sf).select("page_id", F.md5(text.html_to_text(F.col("html"), entities=False)).alias("text_md5"))


def _epub_files(spark, sf):
    """A book per page, as the binary files an EPUB reader would see."""
    import pyarrow as pa

    from ..sources.arrow import slices

    def run(batches):
        import io
        import zipfile

        for b in slices(batches):
            out = []
            for page in b.column(1).to_pylist():
                buf = io.BytesIO()
                with zipfile.ZipFile(buf, "w") as z:
                    z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
                    z.writestr("OPS/book.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="c" href="c.xhtml" media-type="application/xhtml+xml"/><item id="i" href="i.png" media-type="image/png"/></manifest><spine><itemref idref="i"/><itemref idref="c"/></spine></package>')
                    z.writestr("OPS/c.xhtml", page or "")
                out.append(buf.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["path", "content"])

    return _pages(spark, sf).select(F.col("page_id").cast("string").alias("path"), "html").mapInArrow(run, "path string, content binary")


@query("tx_02_epub_chapters")
def tx_02(spark, sf):
    """SRC-09 and TX-02: EPUB containers read back in spine order."""
    return text.read_epubs(_epub_files(spark, sf))


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 0 AND length(x) <= {n})"


@query("tx_03_first_title", f"SELECT doc_id, coalesce(({_LINES.format(n=120)})[1], 'Chapter ' || doc_id) AS title FROM documents")
def tx_03(spark, sf):
    return _docs(spark, sf).select("doc_id", text.first_title(F.col("text"), F.col("doc_id")).alias("title"))


_FRAMED = "'head' || chr(10) || '*** START OF THE PROJECT GUTENBERG EBOOK X ***' || chr(10) || text || chr(10) || '*** END OF THIS PROJECT GUTENBERG EBOOK X ***' || chr(10) || 'tail'"


def _framed(spark, sf):
    return _docs(spark, sf).select("doc_id", F.concat(F.lit("head\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n"), "text", F.lit("\n*** END OF THIS PROJECT GUTENBERG EBOOK X ***\ntail")).alias("text"))


@query("tx_04_strip_frame", f"SELECT doc_id, md5({_tidy_sql('text')}) AS text_md5 FROM documents")
def tx_04(spark, sf):
    return _framed(spark, sf).select("doc_id", F.md5(text.strip_frame(F.col("text"))).alias("text_md5"))


@query("tx_05_strip_frame_lines", f"SELECT doc_id, md5({_squeeze_sql('text')}) AS text_md5 FROM documents")
def tx_05(spark, sf):
    return _framed(spark, sf).select("doc_id", F.md5(text.strip_frame_lines(F.col("text"))).alias("text_md5"))


def _split(name, split_one):
    @query(name)
    def run(spark, sf):
        books = _docs(spark, sf).select("doc_id", F.concat_ws("\n\n", F.lit("CHAPTER I"), "text", F.lit("CHAPTER II"), "text", F.lit("Глава 2"), "text").alias("text"))
        return text.split_texts(books, split_one, id_col="doc_id", text="text")


_split("tx_06_english_headings", lambda t: text.by_heading(t, text.ENGLISH_HEADING, after=500, front="Front Matter"))
_split("tx_07_russian_headings", lambda t: text.by_heading(t, text.RUSSIAN_HEADING, after=200, chars=24_000, name="Часть {}", title_most=255))
_split("tx_08_any_headings", lambda t: text.by_heading(t, r"(?im)^chapter\s+\w+$", least=200, chars=18_000, name="Часть {}", title_most=255))
_split("tx_09_size_split", lambda t: text.by_size(t, 2_000))
_split("tx_12_ratio_split", lambda t: [(str(k), x) for k, x in enumerate(text.at_ratios(t, (0.44, 0.61)))])
_split("tx_13_fixed_sections", lambda t: text.fixed_sections(t, ["CHAPTER I\n", "CHAPTER II\n", "Глава 2"], {"CHAPTER II\n": (0.44, 0.61)}))


@query("tx_10_chapter_title", f"SELECT doc_id, coalesce(({_LINES.format(n=180)})[1], 'Chapter ' || doc_id) AS title FROM documents")
def tx_10(spark, sf):
    return _docs(spark, sf).select("doc_id", text.first_title(F.col("text"), F.col("doc_id"), 180).alias("title"))


@query("tx_11_between", "WITH d AS (SELECT doc_id, text, instr(lower(text), 'the ') AS a FROM documents), e AS (SELECT *, instr(substr(lower(text), a + 4), 'and ') AS b FROM d) SELECT doc_id, md5(CASE WHEN a = 0 THEN '' ELSE regexp_replace(CASE WHEN b > 0 THEN substr(text, a, b + 3) ELSE substr(text, a) END, '^\\s+|\\s+$', '', 'g') END) AS text_md5 FROM e")
def tx_11(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(text.between(F.col("text"), "The ", "And ")).alias("text_md5"))


@query("tx_14_strip_page")
def tx_14(spark, sf):
    return _pages(spark, sf).select("page_id", text.strip_page(F.col("html"), "menu", ["©", "Notes"]).alias("text"))


_WIKI = "'{{box|' || lang || '}} [[' || source || '|' || lang || ']] ''''''' || text || '''''''<ref>x</ref> [https://example.org/a link] <b>end</b>'"


def _wiki(spark, sf):
    return _docs(spark, sf).select("doc_id", F.concat(F.lit("{{box|"), "lang", F.lit("}} [["), "source", F.lit("|"), "lang", F.lit("]] '''"), "text", F.lit("'''<ref>x</ref> [https://example.org/a link] <b>end</b>")).alias("text"))


def _wiki_sql() -> str:
    x = f"regexp_replace(regexp_replace({_WIKI}, '<ref.*?</ref>|<[^>]+>', '', 'gs'), '\\{{\\{{.*?\\}}\\}}', '', 'gs')"
    x = f"regexp_replace(regexp_replace({x}, '\\[\\[(?:[^|\\]]*\\|)?([^\\]]+)\\]\\]', '\\1', 'g'), '\\[https?://[^\\s\\]]+\\s*([^\\]]*)\\]', '\\1', 'g')"
    return _squeeze_sql(f"replace(replace({x}, '''''''', ''), '''''', '')")


@query("tx_15_clean_wikitext", f"SELECT doc_id, md5({_wiki_sql()}) AS text_md5 FROM documents")
def tx_15(spark, sf):
    return _wiki(spark, sf).select("doc_id", F.md5(text.clean_wikitext(F.col("text"))).alias("text_md5"))


@query("tx_16_wiki_sections")
def tx_16(spark, sf):
    pages = _docs(spark, sf).select("doc_id", F.concat_ws("\n", F.lit("== One =="), "text", F.lit("== References =="), "text", F.lit("=== Two ==="), "text").alias("text"))
    return text.split_texts(pages, lambda t: text.wiki_sections(t, "Whole"), id_col="doc_id", text="text")


_N = "trim(regexp_replace(lower({}), '[^a-zа-яё0-9]+', ' ', 'g'))"
_MATCH = f"""m AS (SELECT p_partkey AS book_id, {_N.format("p_name")} AS wt, {_N.format("p_brand")} AS wa, {_N.format("CASE p_partkey % 4 WHEN 0 THEN p_name || '!' WHEN 1 THEN 'The ' || p_name WHEN 2 THEN p_type ELSE '' END")} AS ft, {_N.format("CASE WHEN p_partkey % 3 = 0 THEN 'X' ELSE 'by ' || p_brand END")} AS fa FROM part)"""


@query("tx_17_match_confidence", with_(_MATCH, select="""SELECT book_id, CASE WHEN wt <> '' AND wt = ft AND wa <> '' AND contains(fa, wa) THEN 'high' WHEN wt <> '' AND ft <> '' AND (contains(ft, wt) OR contains(wt, ft)) AND wa <> '' AND contains(fa, wa) THEN 'medium'
  WHEN wt <> '' AND ft <> '' AND (contains(ft, wt) OR contains(wt, ft)) THEN 'low' ELSE 'reject' END AS confidence FROM m"""))
def tx_17(spark, sf):
    p, k = views.table(spark, sf, "part"), F.col("p_partkey")
    title = F.when(k % 4 == 0, F.concat("p_name", F.lit("!"))).when(k % 4 == 1, F.concat(F.lit("The "), "p_name")).when(k % 4 == 2, F.col("p_type")).otherwise("")
    author = F.when(k % 3 == 0, "X").otherwise(F.concat(F.lit("by "), "p_brand"))
    return p.select(k.alias("book_id"), text.match_confidence(F.col("p_name"), F.col("p_brand"), title, author).alias("confidence"))


@query("tx_18_formats", "SELECT p_partkey AS book_id, CASE p_partkey % 3 WHEN 0 THEN 'EPUB,TXT' WHEN 1 THEN 'EPUB' END AS formats FROM part")
def tx_18(spark, sf):
    k = F.col("p_partkey")
    mimes = F.when(k % 3 == 0, F.array(F.lit("text/plain; charset=utf-8"), F.lit("application/epub+zip"), F.lit("text/plain"))).when(k % 3 == 1, F.array(F.lit("application/epub+zip"))).otherwise(F.array(F.lit("image/png")))
    return views.table(spark, sf, "part").select(k.alias("book_id"), F.array_join(text.formats(mimes), ",").alias("formats"))


@query("tx_19_squeeze", f"SELECT doc_id, md5({_squeeze_sql('chr(160) || text || chr(10) || chr(10) || chr(10) || lang')}) AS text_md5 FROM documents")
def tx_19(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(text.squeeze(F.concat(F.lit(" "), "text", F.lit("\n\n\n"), "lang"))).alias("text_md5"))


_CH = "ch AS (SELECT l_orderkey AS book_id, l_linenumber AS chapter_order, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"


def _chapters(spark, sf):
    return views.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("chapter_order")).agg(F.max("l_quantity").alias("q"))


@query("tx_20_insert_missing", with_(_CH, select="SELECT * FROM ch WHERE chapter_order <= 2 UNION ALL SELECT * FROM ch WHERE chapter_order > 2"))
def tx_20(spark, sf):
    ch = _chapters(spark, sf)
    return store.insert_missing(ch.where("chapter_order <= 2"), ch, "book_id", "chapter_order")


@query("tx_21_paragraphs")
def tx_21(spark, sf):
    pages = _pages(spark, sf).select("page_id", F.concat(F.lit('<div class="entry-content">'), "html", F.lit("</div>")).alias("html"))
    return text.split_texts(pages, lambda t: text.paragraphs(t, "entry-content"), id_col="page_id", text="html")


_REPL = "SELECT book_id, chapter_order, CASE WHEN book_id % 5 = 0 THEN left('new ' || repeat('x', 300), 255) ELSE 'old' END AS title FROM ch WHERE book_id % 5 <> 0 OR chapter_order = 1"


@query("tx_22_replace_chapters", with_(_CH, select=_REPL))
def tx_22(spark, sf):
    ch = _chapters(spark, sf).select("book_id", "chapter_order", F.lit("old").alias("title"))
    new = ch.where("book_id % 5 = 0 AND chapter_order = 1").withColumn("title", F.concat(F.lit("new "), F.repeat(F.lit("x"), 300)))
    keep = ch.where("book_id % 5 <> 0").unionByName(ch.where("book_id % 5 = 0").join(new.select("book_id"), "book_id", "left_semi"))
    return store.replace_children(keep, new, "book_id")


@query("tx_23_availability", "SELECT o_orderkey AS book_id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'SYNCED' WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'TEXT' ELSE 'METADATA_ONLY' END AS availability FROM orders")
def tx_23(spark, sf):
    li = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book_id"), "l_returnflag")
    return store.availability(views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("book_id")), li, li.where("l_returnflag = 'R'"))


@query("tx_24_fill_blank", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'filled' ELSE c_name END AS name FROM customer")
def tx_24(spark, sf):
    c = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name")).alias("name"))
    return store.fill_blank(c, c.select("id", F.lit("filled").alias("name")), "id", "name")


@query("tx_25_insert_chain", "SELECT p_partkey AS bundle_id, p_name AS title, count(s_suppkey) AS tracks FROM part LEFT JOIN supplier ON s_suppkey = p_partkey GROUP BY 1, 2")
def tx_25(spark, sf):
    """A parent row feeds the child insert: bundles first, then their tracks."""
    all_of = views.table(spark, sf, "part").select(F.col("p_partkey").alias("bundle_id"), F.col("p_name").alias("title"))
    bundles = store.insert_missing(all_of.where("bundle_id % 2 = 1"), all_of, "bundle_id")
    tracks = views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("bundle_id"), F.lit(1).alias("track"))
    return bundles.join(tracks, "bundle_id", "left").groupBy("bundle_id", "title").agg(F.count("track").alias("tracks"))


@query("tx_26_get_or_create", "WITH d AS (SELECT DISTINCT p_type AS name FROM part WHERE p_partkey % 2 = 0 AND p_type < 'M'), o AS (SELECT row_number() OVER (ORDER BY name) AS id, name FROM d) SELECT id, name FROM o UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM o) + row_number() OVER (ORDER BY name), name FROM (SELECT DISTINCT p_type AS name FROM part WHERE p_type NOT IN (SELECT name FROM d))")
def tx_26(spark, sf):
    p = views.table(spark, sf, "part")
    old = p.where("p_partkey % 2 = 0 AND p_type < 'M'").select(F.col("p_type").alias("name"))
    dim = signals.dense_index(old, "name", "id").select((F.col("id") + 1).alias("id"), "name")
    return store.get_or_create(dim, p.select(F.col("p_type").alias("name")))


@query("tx_27_page_assembly", "SELECT conv_id, count(*) AS pages, md5(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, role, text)) AS text_md5 FROM conversations GROUP BY 1 HAVING count(*) >= 2")
def tx_27(spark, sf):
    """Ordered pages of a book as one text; books of too few pages go."""
    rows = views.table(spark, sf, "conversations").select("conv_id", F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")).alias("p"))
    book = rows.groupBy("conv_id").agg(F.count("*").alias("pages"), F.sort_array(F.collect_list("p")).alias("p")).where("pages >= 2")
    return book.select("conv_id", "pages", F.md5(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")).alias("text_md5"))


# ---- files and stores -----------------------------------------------------------------------


@query("src_01_typed_csv", with_(SQL_DENSE, select="SELECT user_id, count(*) AS n, sum(rating)::BIGINT AS ratings FROM dense GROUP BY 1"))
def src_01(spark, sf):
    """SRC-01 and SNK-01: rows written as CSV and scanned back typed, three columns of five."""
    path = scratch(spark, "csv")
    files.write_csv(views.interactions_dense(spark, sf).select("user_id", "book_id", "is_read", "rating", "is_reviewed"), path)
    return files.read_csv(spark, path, files.INTERACTIONS, ["user_id", "rating"]).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("rating").alias("ratings"))


@query("src_02_first_rows", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity LIMIT 100")
def src_02(spark, sf):
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return files.first_rows(views.table(spark, sf, "lineitem").select(*order), 100, *order)


@query("src_03_json_lines", "SELECT p_partkey AS book_id, p_name AS title FROM part")
def src_03(spark, sf):
    path = scratch(spark, "json")
    views.table(spark, sf, "part").select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title")).write.option("compression", "gzip").json(path)
    return files.read_json(spark, path, "book_id long, title string")


@query("src_04_json_array", "SELECT r_regionkey::BIGINT AS id, r_name AS name FROM region")
def src_04(spark, sf):
    path = scratch(spark, "array")
    rows = views.table(spark, sf, "region").select(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")).alias("r"))
    rows.agg(F.to_json(F.collect_list("r")).alias("value")).coalesce(1).write.text(path)
    return files.read_json(spark, path, "id long, name string")


@query("src_05_rows_as_strings", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def src_05(spark, sf):
    path = scratch(spark, "rows")
    files.write_csv(views.table(spark, sf, "nation").select("n_nationkey", "n_name"), path, "n_nationkey")
    return files.read_csv(spark, path)


@query("src_06_model_round_trip", "SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def src_06(spark, sf):
    """SRC-06, SRC-07 and SNK-05: factor tables saved and loaded."""
    path = scratch(spark, "model")
    e = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("factor"))
    files.save_model(path, e.limit(1), e, {"k": 64})
    _, items, meta = files.load_model(spark, path)
    return items.where(F.lit(meta["k"]) == 64).select("id", F.round(F.aggregate("factor", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("src_12_point_lookup", "SELECT p_partkey AS book_id, p_name AS title FROM part WHERE p_partkey IN (3, 5, 8)")
def src_12(spark, sf):
    wanted = spark.createDataFrame([(3,), (5,), (8,), (10**9,)], "book_id long")
    return views.table(spark, sf, "part").select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title")).join(wanted, "book_id", "left_semi")


@query("src_13_sparse_matrix", with_(SQL_DENSE, select="SELECT count(DISTINCT user_id) AS users, count(DISTINCT book_id) AS items, count(*) AS nnz FROM (SELECT DISTINCT user_id, book_id FROM dense WHERE rating >= 4)"))
def src_13(spark, sf):
    path = scratch(spark, "coo")
    files.write_parquet(prep.liked(views.interactions_dense(spark, sf), 4).select("user_id", "book_id").distinct(), path)
    return spark.read.parquet(path).agg(F.countDistinct("user_id").alias("users"), F.countDistinct("book_id").alias("items"), F.count("*").alias("nnz"))


@query("snk_03_summary", "SELECT count(*) AS rows FROM lineitem")
def snk_03(spark, sf):
    path = scratch(spark, "summary")
    files.write_summary(views.table(spark, sf, "lineitem").agg(F.count("*").alias("rows")), path)
    return spark.read.json(path)


@query("snk_04_insert_statements", "SELECT 'INSERT INTO nation (n_nationkey, n_name) VALUES (' || n_nationkey || ', ' || chr(39) || replace(n_name, chr(39), chr(39) || chr(39)) || chr(39) || ');' AS statement FROM nation")
def snk_04(spark, sf):
    return files.insert_statements(views.table(spark, sf, "nation").select("n_nationkey", "n_name"), "nation").select(F.col("statement"))


@query("snk_07_run_log", "SELECT * FROM (VALUES ('a', 1), ('b', 2), ('c', 3)) t(name, step)")
def snk_07(spark, sf):
    path = scratch(spark, "log")
    files.append_log(spark, path, [{"name": "a", "step": 1}, {"name": "b", "step": 2}], "name string, step int")
    files.append_log(spark, path, [{"name": "c", "step": 3}], "name string, step int")
    return spark.read.schema("name string, step int").json(path)


@query("snk_08_upsert", "SELECT p_partkey AS book_id, CASE WHEN p_partkey % 2 = 0 THEN 'new' ELSE p_name END AS title, CASE WHEN p_partkey % 3 <> 0 THEN p_size ELSE 0 END AS rating FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0")
def snk_08(spark, sf):
    p = views.table(spark, sf, "part").select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title"), F.col("p_size").alias("rating"))
    return store.upsert(p.where("book_id % 3 <> 0"), p.where("book_id % 2 = 0").withColumn("title", F.lit("new")).withColumn("rating", F.lit(0)), "book_id", ["title"])


@query("snk_09_replace_children", with_(_CH, select="SELECT book_id, chapter_order, CASE WHEN book_id % 4 = 0 THEN 0.0::DOUBLE ELSE q END AS q FROM ch WHERE book_id % 4 <> 0 OR chapter_order <= 2"))
def snk_09(spark, sf):
    ch = _chapters(spark, sf)
    new = ch.where("book_id % 4 = 0 AND chapter_order <= 2").withColumn("q", F.lit(0.0))
    return store.replace_children(ch.where("book_id % 4 <> 0").unionByName(ch.where("book_id % 4 = 0").join(new.select("book_id"), "book_id", "left_semi")), new, "book_id")


@query("snk_10_unique_key", "SELECT count(*) AS books FROM part")
def snk_10(spark, sf):
    return store.assert_unique(views.table(spark, sf, "part"), "p_partkey").agg(F.count("*").alias("books"))


@query("xp_01_item_cf_grid")
def xp_01(spark, sf):
    """A grid with finished configs skipped; the second pass runs nothing."""
    from . import experiments

    out = scratch(spark, "grid")
    df = views.interactions_dense(spark, sf)
    run = lambda c: item_cf.neighbors(df, threshold=c["threshold"]).agg(F.count("*").alias("edges"), r6(F.avg("score")).alias("mrr_at_50"))
    experiments.run_grid(spark, out, experiments.ITEM_CF_GRID, run)
    return experiments.run_grid(spark, out, experiments.ITEM_CF_GRID, lambda c: (_ for _ in ()).throw(RuntimeError("already finished")))


def _als_metrics(spark, sf):
    """A function of a config: the leave-one-out metrics of ALS trained with it, users divisible by 20 asking."""
    from . import q_signals as q

    rows = written(signals.active_users(q._signals(spark, sf)).select("user_id", "book_id", "signal"), "signals")
    some = rows.where("user_id % 20 = 0")
    hidden = written(split.pick_one(some.where("signal > 0")), "hidden")
    matrix = rows.select(F.col("user_id").alias("user_idx"), F.col("book_id").alias("item_idx"), "signal")

    def run(c):
        items = als.train(matrix, k=c["k"], reg=c["reg"], iterations=c["iterations"])[1].select(F.col("id").alias("book_id"), "factor")
        return q._evaluated(some, hidden, items, True)

    return run


def _never(_):
    raise RuntimeError("already finished")


@query("xp_02_als_grid")
def xp_02(spark, sf):
    """Sweeps of iterations, factors and lambda around a base; the first pass stops at a failure, the second resumes after what is finished."""
    from . import experiments

    out, run, configs = scratch(spark, "als-grid"), _als_metrics(spark, sf), experiments.als_grid({"k": 4, "iterations": 1}, iterations=(1, 2), features=(8,), regs=(1.0,))
    try:
        experiments.run_grid(spark, out, configs, lambda c: run(c) if c["name"] != configs[2]["name"] else _never(c))
    except RuntimeError:
        pass
    return experiments.run_grid(spark, out, configs, run)


@query("xp_03_promoted")
def xp_03(spark, sf):
    """The config that is best by MRR, trained again with more factors, next to its own result."""
    from . import experiments

    out, run, configs = scratch(spark, "als-high"), _als_metrics(spark, sf), experiments.als_grid({"iterations": 1}, features=(4, 8))
    name = experiments.best(experiments.run_grid(spark, out, configs, run))
    first = next(c for c in configs if c["name"] == name)
    return experiments.run_grid(spark, out, [first, first | {"k": 2 * first["k"], "name": f"{name}_promoted"}], run)


@query("xp_04_lambda_ladder")
def xp_04(spark, sf):
    from . import experiments

    return experiments.run_grid(spark, scratch(spark, "ladder"), experiments.als_grid({"k": 8, "iterations": 1}, regs=(0.01, 0.5, 0.8, 1.0)), _als_metrics(spark, sf))


@query("xp_05_hybrid_grid")
def xp_05(spark, sf):
    """Hybrid configs one after another, finished ones skipped."""
    from . import experiments
    from . import q_hybrid as q

    setup = q.Setup(spark, sf)
    run = lambda c: q.grid_metrics(setup.rerank(c["name"]), setup.hidden, setup.als, hybrid.configs(spark, c["name"])).drop("config")
    return experiments.run_grid(spark, scratch(spark, "hybrid-grid"), [{"name": n} for n in ("als_baseline", "balanced_metadata", hybrid.CHAMPION)], run)


@query("st_01_windowed_likes", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, CAST(json_extract_string(props, '$.k') AS BIGINT) AS book_id, count(*) AS likes FROM events WHERE CAST(floor(value) AS INT) % 6 >= 4 GROUP BY 1, 2")
def st_01(spark, sf):
    return likes.windowed_likes(views.interactions_events(spark, sf)).select(F.col("window_start").cast("date").alias("day"), "book_id", "likes")
