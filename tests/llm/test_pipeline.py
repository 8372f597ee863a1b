"""The pipeline's stages against a brute-force version."""

import re

import corpus_pipeline
from lectern.llm import decontaminate, ngram_join, quality_rules

SF = "/root/testdata/sf0.001"


def windows_of(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 8]) for k in range(len(w) - 7)}


def passages(benchmark):
    return {r.item_id: windows_of(r.text) for r in benchmark.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "decontamination", "best_fit_packing"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = quality_rules.fit(docs)
    good = {k for k, t in texts.items() if quality_rules._judge((t or "").encode(), {}, model, 0.5, 50, 50)[4]}
    seen, cut = {}, {}
    for k in sorted(good):
        for line in set((texts[k] or "").split("\n")):
            key = line.strip(" \t\n\x0b\x0c\r").encode().lower()
            if len(key.decode()) >= 10:
                seen.setdefault(key, []).append(k)
    for k in good:
        lines = (texts[k] or "").split("\n")
        cut[k] = "\n".join(x for x in lines if seen.get(key := x.strip(" \t\n\x0b\x0c\r").encode().lower(), [k])[0] == k or len(key.decode()) < 10)
    from tests.llm.test_documents import brute_components

    single = {k for k, (_, c) in brute_components(cut).items() if c == k}
    windows = passages(spark.read.parquet(f"{SF}/benchmark.parquet"))
    clean = {k for k in single if not any(windows_of(cut[k]) & w for w in windows.values())}
    expected = [good, good, single, clean]
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], expected):
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        got = {r.doc_id: r.text for r in docs.collect()}
        assert set(got) == ids, name
        if name != "quality_rules":
            assert all((got[k] or "") == cut[k] for k in got)
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == clean
    assert 0 < len(clean) <= before
    assert ngram_join.__doc__


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_documents_with_a_benchmark_passage_go(spark):
    """One passage of one item is enough; those without one stay, as they are."""
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    windows = passages(benchmark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted, k = [], 10_000
    for r in benchmark.collect():
        words = r.text.split()
        for at, size in ((0, 8), (len(words) - 11, 11), (0, len(words))):
            planted.append((k, f"Some words of its own, {k}. " + re.sub("[a-z]", lambda m: m[0].upper(), " ".join(words[at : at + size])) + " and so on.", "en", "planted", 0))
            k += 1
        planted.append((k, "Seven words are too few: " + " ".join(words[:7]), "en", "planted", 0))
        k += 1
    planted += [(k, None, None, None, None), (k + 1, "", "en", "planted", 0), (k + 1, "", "en", "planted", 0)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema)).repartition(4)
    got = corpus_pipeline.decontaminated(spark, docs, SF)
    assert got.schema == docs.schema
    clean = [tuple(r) for r in docs.collect() if not any(windows_of(r.text) & w for w in windows.values())]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, clean))
    left = {r.doc_id for r in got.collect()}
    assert left >= {k, k + 1} and not {p[0] for p in planted if (p[0] - 10_000) % 4 != 3 and p[0] < k} & left


def test_short_items_are_judged_apart(spark):
    benchmark = spark.createDataFrame([(1, "yes indeed"), (2, "no sir"), (3, " ".join(f"w{k}" for k in range(9))), (4, None)], "item_id long, text string")
    texts = ["Yes, indeed it is", "yes indeed and no sir", " ".join(f"W{k}" for k in range(8)), "w0 w1", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.keep(docs, benchmark, min_items=1, min_short_items=2)
    assert sorted(r.doc_id for r in got.collect()) == [0, 3, 4, 5]
    assert sorted(r.doc_id for r in decontaminate.keep(docs, benchmark, min_items=1).collect()) == [3, 4, 5]
