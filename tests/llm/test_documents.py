"""Document operators against brute force, and over odd and empty tables."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from lectern.llm import decontaminate, line_dedup, ngram_join, packing, pii, quality_rules, secrets, suffix_dedup
from lectern.llm.components import connected
from lectern.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def rows(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, r[key] or 0))


# ---- quality rules --------------------------------------------------------------------------


def brute_features(text):
    words = [w for w in re.split("[ \t-\r]+", text or "") if w]
    windows = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            hit |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if re.search("[^ \t-\r]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(small, odd_documents):
    for docs in (small, odd_documents):
        texts = collections.Counter(r.text for r in docs.select("text").collect())
        expected = collections.Counter()
        for t, n in texts.items():
            expected[brute_features(t)] += n
        got = collections.Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.score(docs).collect())
        assert got == expected


def test_quality_keeps_clean_and_drops_junk(spark, small):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality_rules.score(docs).join(labels, "doc_id").where("n_words >= 50 AND NOT base_failed").groupBy("quality").agg({"kept": "max", "p_good": "avg"}).collect()
    share = {r.quality: r["avg(p_good)"] for r in got}
    assert share[1] > 0.95 and share[0] < 0.3


def test_quality_keep_returns_the_same_rows(odd_documents):
    kept = quality_rules.keep(odd_documents)
    assert kept.schema == odd_documents.schema
    scored = quality_rules.score(odd_documents)
    assert kept.count() == scored.where("kept").count()


def test_em_recovers_planted_accuracies():
    rng = np.random.default_rng(1)
    n, m = 20_000, len(quality_rules.RULES)
    good = rng.random(n) < 0.8
    bad_rate = np.where(good[:, None], 0.01, 0.4)
    votes = np.where(rng.random((n, m)) < 0.3, 0, np.where(rng.random((n, m)) < bad_rate, -1, 1))
    codes = ((votes + 1) * 3 ** np.arange(m - 1, -1, -1)).sum(axis=1)
    model = quality_rules.em(dict(collections.Counter(codes.tolist())))
    assert abs(model.prior - 0.8) < 0.05
    assert np.all(model.table[0, :, 0] > 0.3) and np.all(model.table[1, :, 0] < 0.03)
    guess = np.array([model.posterior(c) >= 0.5 for c in codes.tolist()])
    assert (guess == good).mean() > 0.9


# ---- suffix dedup ---------------------------------------------------------------------------


def brute_removed(docs, length):
    seen, out = set(), {}
    for ident, data in sorted(docs.items()):
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        out[ident] = gone
    return out


@pytest.mark.parametrize("alphabet, length, gram", [(b"ab", 12, 4), (b"abc", 20, 8), (b"a", 10, 4), (bytes(range(256)), 16, 8)])
@pytest.mark.parametrize("crowding", [{}, {"crowd": 2, "crowd_rows": 5}])
def test_suffix_dedup_random(spark, alphabet, length, gram, crowding):
    rng = np.random.default_rng(len(alphabet))
    pool = [bytes(rng.choice(list(alphabet), 40)).decode("latin-1") for _ in range(4)]
    docs = {}
    for k in range(14):
        parts = [pool[rng.integers(4)][rng.integers(20) :] if rng.random() < 0.6 else bytes(rng.choice(list(alphabet), rng.integers(0, 50))).decode("latin-1") for _ in range(rng.integers(0, 5))]
        docs[k] = "".join(parts)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in suffix_dedup.dedup(df, length=length, gram=gram, **crowding).collect()}
    for k, gone in brute_removed({k: v.encode() for k, v in docs.items()}, length).items():
        data = docs[k].encode()
        left = np.frombuffer(data, np.uint8)[~gone].tobytes()
        assert (got[k].n_bytes, got[k].n_removed, bytes(got[k].kept)) == (len(data), int(gone.sum()), left)
        assert got[k].kept_sha256 == hashlib.sha256(left).hexdigest()


def test_suffix_dedup_small(small):
    expected = brute_removed({r.doc_id: (r.text or "").encode() for r in small.collect()}, 100)
    for r in suffix_dedup.dedup(small, keep_bytes=False).collect():
        gone = expected[r.doc_id]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (r.n_removed, r.n_spans) == (int(gone.sum()), spans)


def test_suffix_dedup_odd(odd_documents, empty_documents):
    got = rows(suffix_dedup.dedup(odd_documents))
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 14 and by[4]["n_bytes"] == 0 and by[1]["n_removed"] == 0
    assert by[2]["n_removed"] == by[2]["n_bytes"]  # repeated rows are one document, a copy of an earlier one
    assert by[9]["n_removed"] == 200_000 - 1 and by[9]["n_spans"] == 1  # all but the first byte lie in a string seen a byte before
    assert rows(suffix_dedup.dedup(odd_documents, crowd=1, crowd_rows=3)) == got
    assert suffix_dedup.dedup(empty_documents).count() == 0


def test_suffix_dedup_passage_in_many_documents(spark):
    """A passage with other text around it in every document: its edges are crowded anchors."""
    rng = np.random.default_rng(1)
    passage = bytes(rng.integers(97, 123, 300, np.uint8))
    docs = {k: bytes(rng.integers(97, 123, 40 + k % 60, np.uint8)) + passage[k % 7 :] + bytes(rng.integers(97, 123, k % 90, np.uint8)) for k in range(60)}
    df = spark.createDataFrame([(k, v.decode()) for k, v in docs.items()], "doc_id long, text string").repartition(4)
    expected = brute_removed(docs, 100)
    for r in suffix_dedup.dedup(df, crowd=4, crowd_rows=40).collect():
        assert r.n_removed == expected[r.doc_id].sum()


@pytest.mark.parametrize("crowding", [{}, {"crowd": 1, "crowd_rows": 2}])
def test_suffix_dedup_repeated_rows_with_a_shared_passage(spark, crowding):
    """A row that repeats is no earlier document: the first one keeps the passage it shares with a later one."""
    rng = np.random.default_rng(7)
    a, p, b, c, d = (bytes(rng.integers(97, 123, n, np.uint8)) for n in (150, 300, 170, 190, 130))
    docs = {1: a + p + b, 2: c + p + d}
    df = spark.createDataFrame([(k, docs[k].decode()) for k in (1, 1, 2, 2)], "doc_id long, text string").repartition(2)
    expected = brute_removed(docs, 100)
    got = suffix_dedup.dedup(df, **crowding).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == sorted((k, int(expected[k].sum())) for k in (1, 1, 2, 2)) == [(1, 0), (1, 0), (2, 300), (2, 300)]


# ---- packing --------------------------------------------------------------------------------


def test_packing(small, odd_documents, empty_documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    for docs in (small, odd_documents):
        out = [r.asDict() for r in packing.pack(docs, tokenizer_path()).collect()]
        expected = collections.Counter()
        for r in docs.select("doc_id", "text").collect():
            ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
            start, piece = 0, 0
            size = len(ids) % 1024 or 1024
            while start < len(ids):
                expected[(r.doc_id, piece, start, size, zlib.crc32(ids[start : start + size].tobytes()))] += 1
                start, size, piece = start + size, 1024, piece + 1
        assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == expected
        places = collections.defaultdict(list)
        for r in out:
            places[r["sequence_id"]].append((r["offset"], r["length"]))
        for seq in places.values():
            at = 0
            for offset, length in sorted(seq):
                assert offset == at
                at += length
            assert at <= 1024
    assert packing.pack(empty_documents, tokenizer_path()).count() == 0


def test_match_equals_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for limit in (10, 64, 1024):
        sizes = sorted(rng.integers(1, limit + 1, 700).tolist(), reverse=True)
        gaps = []
        for s in sizes:  # document by document
            fit = [k for k, g in enumerate(gaps) if g >= s]
            if fit:
                gaps[min(fit, key=lambda k: gaps[k])] -= s
            else:
                gaps.append(limit - s)
        runs, n = packing.match(dict(collections.Counter(sizes)), limit)
        assert n == len(gaps)


@pytest.mark.parametrize("text", ["", "a  b   c\n\n d\t\te   x\x85y", "<|endoftext|> hi", "½ ² Ⅷ 日本語 🙂🙂", "it's we'll I'D", "   ", "x" * 5000, " " * 3000 + "a", "　　a"])
def test_encoder_agrees_with_the_tokenizer(text):
    enc = packing.encoder(tokenizer_path())
    assert enc.fast is not None
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


# ---- personal data and secrets --------------------------------------------------------------


def luhn(s):
    t = 0
    for k, c in enumerate(reversed(s)):
        x = int(c) * (1 + k % 2)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def brute_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(s := re.sub("[ -]", "", m[0])) <= 19 and luhn(s)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


TRICKY = [
    "a@b.c@d.e x@y@b.com a@b.com_x@c.de .a@b.co %@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 12.34.56", "4111 1111 1111 1111 and 4111-1111-1111-1112 1  2345",
    "+1 (743) 555-3824 +12 +1----------2345678 ++49 30 901820", "🙂é a.b@ex-ample.org 日本 10.0.0.1", "9" * 500, "a" * 3000 + "@", "1." * 400, "+" * 50 + "1" * 20,
    "GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765433", "call me: 415-555-2671 or order 415-555-2672", "SSN 078-05-1120, part 078-05-1121",
    "password = hunter2hunter2 TOKEN:'abc' api_key==abcdefgh secret : \"x=yyyyyyyyy\" token=secret=abcdefgh12", "AKIA" + "Z" * 12 + " AKIAAKIA12 AKIAAKIAAKIAAKIA", "ab" * 16 + " " + "ab" * 15 + "g" + "0" * 40,
]


def test_pii_base(spark, small):
    texts = [r.text for r in small.collect()] + TRICKY + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        spans = brute_pii(texts[r.doc_id] or "")
        assert r.base_sha256 == digest(spans), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.BASE]


def test_pii_checksums_and_context(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TRICKY)], "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.value) for s in r.found if s.kind in pii.ADDED] for r in pii.find_pii(df).collect()}
    assert found[9] == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert found[10] == [("local_phone", "415-555-2671")]
    assert found[11] == [("national", "078-05-1120")]


def test_pii_ibans_before_capitals_and_digits(spark):
    de, gb, no = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"
    cases = {
        "DE89370400440532013000 Please": ["DE89370400440532013000"], f"{de} BIC COBADEFFXXX": [de], f"{de} 12 A": [de], f"{gb} {de}": [gb, de], f"{no} {no}, {gb}": [no, no, gb],
        f"🙂 {gb} IBAN {no.replace(' ', '')} X1": [gb, no.replace(" ", "")], f"{de}.": [de], f"{de}x": [], "DE88370400440532013000 Please": [], f"X{de}": [], "AB12" * 2000: [],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        text = list(cases)[r.doc_id]
        found = [s for s in r.found if s.kind == "iban"]
        assert [s.value for s in found] == cases[text] and all(text[s.start : s.end] == s.value for s in found), text


def brute_secrets(t):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_secrets_base(spark, small):
    texts = [r.text for r in small.collect()] + TRICKY + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.find_secrets(df).collect():
        assert r.base_sha256 == digest(brute_secrets(texts[r.doc_id] or "")), texts[r.doc_id]


def test_markov_models_tell_random_from_identifiers(spark, small):
    from pyspark.sql import functions as F

    samples = secrets.labelled_samples(small).cache()
    part = F.pmod(F.xxhash64("value"), F.lit(5))
    table = secrets.train(samples.where(part > 0))
    held = samples.where((part == 0) & (F.length("value") >= 20)).select("label", (secrets.ratio(F.col("value"), table) >= 0.4).alias("guess"))
    right = {(r.label, r.guess): r["count"] for r in held.groupBy("label", "guess").count().collect()}
    assert right.get((1, True), 0) > 0.9 * (right.get((1, True), 0) + right.get((1, False), 0))
    assert right.get((0, False), 0) > 0.97 * (right.get((0, True), 0) + right.get((0, False), 0))
    texts = [("key zQ8vK1xP9LmT4rB7nW2cY6dH3fJ5 end",), ("the_quick_brown_fox_jumps_over",)]
    got = secrets.find_secrets(spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "doc_id long, text string"), table).collect()
    assert {r.doc_id: r.spans for r in got} == {0: "random:4:32", 1: ""}


def test_scans_of_a_text_with_very_many_spans(spark):
    """Work grows with the number of spans, not with its square."""
    n = 100_000
    texts = [" ".join(f"a{k}@b.com" for k in range(n)), " ".join(["call 415-555-2671 or"] * n), " ".join(["10.0.0.1 GB82 WEST 1234 5698 7654 32"] * (n // 4))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in pii.find_pii(df).selectExpr("doc_id", "n_email", "size(found) AS n", "base_sha256", "element_at(found, -1) AS last").collect()}
    assert [got[k].n for k in range(3)] == [n, n, n // 2] and got[0].n_email == n
    assert got[0].base_sha256 == digest(brute_pii(texts[0]))
    assert all(texts[k][got[k].last.start : got[k].last.end] == got[k].last.value for k in range(3))
    hexes = [(0, " ".join(f"{k:040x} token=abcdefgh{k}" for k in range(n // 2)))]
    found = secrets.find_secrets(spark.createDataFrame(hexes, "doc_id long, text string"), [0.0] * 69 * 69).first()
    assert found.base_sha256 == digest(brute_secrets(hexes[0][1]))


def test_added_spans_never_touch_base_spans(spark):
    """Many base spans, so that they are searched by halves."""
    parts, expected = [], 0
    for k in range(60):
        parts += [f"u{k}@h.org", "+1 415-555-2671 tel"] + (["tel 415-555-2671;"] if k % 3 == 0 else [])
        expected += k % 3 == 0
    df = spark.createDataFrame([(1, " and ".join(parts))], "doc_id long, text string")
    r = pii.find_pii(df).first()
    spans = sorted((s.start, s.end) for s in r.found)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and (r.n_email, r.n_phone) == (60, 60)
    assert sum(s.kind == "local_phone" for s in r.found) == expected


def test_added_spans_planted_in_documents(spark, small):
    """Share of planted values that are found, and of documents without one that stay without a new span."""
    rng = np.random.default_rng(11)

    def iban(country, body):
        rest = "".join(str(int(c, 36)) for c in body + country + "00")
        plain = f"{country}{98 - int(rest) % 97:02}{body}"
        return plain if rng.random() < 0.5 else " ".join(plain[k : k + 4] for k in range(0, len(plain), 4))

    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    makers = {
        "iban": lambda: iban("DE", digits(18)) if rng.random() < 0.5 else iban("GB", "WEST" + digits(14)),
        "national": lambda: f"SSN {digits(3)}-{digits(2)}-{digits(4)}",
        "local_phone": lambda: f"please call ({digits(3)}) {digits(3)}-{digits(4)}",
        "random": lambda: "".join(rng.choice(list(letters), 32)),
    }
    texts = [(r.doc_id, r.text or "") for r in small.orderBy("doc_id").collect()][:120]
    planted = []
    for n, (k, text) in enumerate(texts):
        words, kind = text.split(" "), list(makers)[n % 4]
        words.insert(int(rng.integers(0, len(words) + 1)), makers[kind]())
        planted.append((k, " ".join(words), kind))
    df = spark.createDataFrame(planted, "doc_id long, text string, kind string")
    table = secrets.train(secrets.labelled_samples(small))
    kinds = {r.doc_id: r.kind for r in df.collect()}
    before, after = ({r.doc_id: [s.kind for s in r.found] for r in pii.find_pii(d).collect()} for d in (small, df))
    secret_before, secret_after = ({r.doc_id: [s.kind for s in r.found] for r in secrets.find_secrets(d, table).collect()} for d in (small, df))
    share = {}
    for kind in makers:
        old, new = (secret_before, secret_after) if kind == "random" else (before, after)
        mine = [k for k, x in kinds.items() if x == kind]
        share[kind] = sum(new[k].count(kind) > old[k].count(kind) for k in mine) / len(mine)
        # An account number is a string of random characters as well.
        assert all(new[k].count(kind) <= old[k].count(kind) for k, x in kinds.items() if x != kind and (kind, x) != ("random", "iban"))
    print(share)
    assert min(share.values()) >= 0.9, share


def test_native_scans_over_odd_tables(odd_documents, empty_documents):
    for find in (pii.find_pii, secrets.find_secrets):
        assert find(odd_documents).count() == 14
        assert find(empty_documents).count() == 0
        plan = find(odd_documents)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


# ---- decontamination and line dedup, against the oracle -------------------------------------


def oracle(name, **tables):
    from lectern.llm import queries

    con = duckdb.connect()
    for k, df in tables.items():
        con.register(k, df)
    got = con.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in got.description]
    return sorted((dict(zip(cols, r)) for r in got.fetchall()), key=lambda r: r[cols[0]])


def test_decontamination(spark, odd_documents, empty_documents):
    words = [f"w{k}" for k in range(60)]
    bench = [(1, " ".join(words[:12])), (2, " ".join(words[10:30])), (3, "just three words"), (4, None), (5, ""), (6, "Ünï cödé, eins zwei drei vier fünf sechs sieben"), (2, "again " + " ".join(words[40:50]))]
    docs = [(1, "X, " + "; ".join(words).upper() + "!"), (2, "nothing here"), (3, "(just) THREE--words just three words"), (4, None), (5, ""), (6, "cödé eins zwei drei vier fünf sechs sieben ünï"), (7, " ".join(words[:8])), (8, "ÜNï cödé EINS zwei drei vier fünf sechs sieben")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = rows(decontaminate.scan_documents(d, b).drop("hit_spans"))
    assert got == oracle("op6_decontamination", documents=d.toArrow(), benchmark=b.toArrow())
    spans = {r.doc_id: r.hit_spans for r in decontaminate.scan_documents(d, b).collect()}
    assert [docs[2][1][s.start : s.end] for s in spans[3]] == ["just) THREE--words just three words"]
    kept = decontaminate.keep(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r["doc_id"] for r in got if not r["contaminated"]}
    none = b.limit(0)
    assert decontaminate.scan_documents(odd_documents, none).where("n_items > 0").count() == 0
    assert decontaminate.scan_documents(empty_documents, b).count() == 0
    with pytest.raises(ValueError):
        decontaminate.build(b, max_benchmark_bytes=10)


def test_line_dedup(spark, small, odd_documents, empty_documents):
    lines = [(1, "A shared line here\nonly in one\nA SHARED line here \n"), (2, "\ta shared LINE here\nshort\nÉtwas anderes"), (3, "étwas anderes\nÉtwas anderes\nshort"), (4, None), (5, ""), (6, "\n\n")]
    for docs in (small.select("doc_id", "text"), spark.createDataFrame(lines, "doc_id long, text string")):
        assert rows(line_dedup.digests(docs, bits=1 << 20)) == oracle("op9_line_dedup", documents=docs.toArrow())
        assert rows(line_dedup.digests(docs, bits=1)) == rows(line_dedup.digests(docs))  # a full filter only suspects more
    out = line_dedup.rewrite(odd_documents)
    assert line_dedup.filter_bits(odd_documents, "text", 1 << 30) == line_dedup.filter_bits(empty_documents, "text", 1 << 30) == 1 << 19
    many = spark.range(1000).selectExpr("id AS doc_id", "repeat('a line\\n', 99) AS text")
    assert line_dedup.filter_bits(many, "text", 1 << 30) == 1 << 20 and line_dedup.filter_bits(many, "text", 1 << 19) == 1 << 19
    assert out.schema == odd_documents.schema and out.count() == 14
    by = {(r.doc_id, r.key): r.text for r in out.collect()}
    assert by[(4, "c")] is None and by[(1, "a")].startswith("The same") and by[(2, None)] == "" and by[(None, "k")] == ""
    assert line_dedup.digests(empty_documents).count() == 0


# ---- near duplicates ------------------------------------------------------------------------


def brute_components(docs, percent=80):
    sets = {}
    for k, t in docs.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {k: k for k in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            x = len(sets[a] & sets[b])
            if x and 100 * x >= percent * (len(sets[a]) + len(sets[b]) - x):
                p, q = root(a), root(b)
                comp[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), root(k)) for k in sets}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_jaccard_join_random(spark, seed):
    """Groups of near copies around the threshold, a passage that many share, chains, tiny sets."""
    rng = np.random.default_rng(seed)
    passage = [f"p{k}" for k in range(40)]
    docs, k = {}, 0
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 400, rng.integers(3, 160))]
        if rng.random() < 0.5:
            base = base + passage
        chain = base
        for _ in range(rng.integers(1, 8)):
            source = chain if rng.random() < 0.5 else base
            copy = list(source)
            for at in rng.integers(0, len(copy), max(1, int(len(copy) * rng.choice([0, 0.01, 0.03, 0.06])))):
                copy[at] = f"e{rng.integers(1000)}"
            docs[k] = " ".join(copy)
            chain, k = copy, k + 1
    docs |= {k: "one", k + 1: "ONE", k + 2: "two words", k + 3: "", k + 4: None, k + 5: "a b c d e f", k + 6: "a b c d e f"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(df).collect()}
    assert got == brute_components(docs)


def test_classes_whose_keys_clash_stay_apart(spark):
    """With keys of three bits nearly all classes clash; results are those of whole keys."""
    docs = {k: " ".join(f"{k % 20}w{x}" for x in range(30 + k % 2)) for k in range(60)}
    df = spark.createDataFrame([*docs.items(), (60, None), (None, docs[3])], "doc_id long, text string").repartition(3)
    whole = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(df).collect()}
    assert {r.doc_id: r.component_id for r in ngram_join.classes(df, key_bits=3).collect()} == {k: k % 20 for k in docs} | {60: 60, None: None}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(df, key_bits=3).collect()} == whole


def test_jaccard_join_odd(odd_documents, empty_documents):
    got = rows(ngram_join.classes(odd_documents))
    assert len(got) == 14
    by = {r["doc_id"]: r for r in got}
    assert [by[k]["component_id"] for k in (1, 2, 3, 4, 5, 6, 7, 8, None)] == [1, 1, 1, 4, 5, 6, 7, 7, None]
    kept = ngram_join.keep_one(odd_documents)
    assert kept.schema == odd_documents.schema
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 4, 5, 6, 7, 9, 10, 11]
    assert ngram_join.classes(empty_documents).count() == 0


def test_components_of_long_chains(spark):
    rng = np.random.default_rng(3)
    n = 800
    label = rng.permutation(n) - n // 2
    pairs = [(int(label[k]), int(label[k + h])) for h in (1, 2) for k in range(n - h) if k + h < 500 or k >= 500]
    got = {r.node: r.comp for r in connected(spark.createDataFrame(pairs, "a long, b long").coalesce(1)).collect()}
    assert got == {int(x): int(min(part)) for part in (label[:500], label[500:]) for x in part}


def test_jaccard_join_gives_every_link(spark):
    """In a group of near copies all pairs are links, not only those that join the group."""
    words = [f"w{k}" for k in range(200)]
    docs = {k: " ".join([*words[:k * 5], f"x{k}", *words[k * 5 + 1 :]]) for k in range(1, 30)}
    docs |= {40: docs[3], 41: docs[3].upper(), 42: "one", 43: "one", 44: None, 45: "other words that link with none of these", 46: " ".join(words[:190])}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for k, t in docs.items()}
    linked = {(a, b) for a in docs for b in docs if a < b and sets[a] and 100 * (x := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - x)}
    df = spark.createDataFrame([*docs.items(), (3, docs[3]), (None, docs[3])], "doc_id long, text string").repartition(3)
    members, links = ngram_join.join(df)
    key = {r.id: r.key for r in members.where("id is not null").collect()}
    got = [(r.a, r.b) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == {(min(key[a], key[b]), max(key[a], key[b])) for a, b in linked if key[a] != key[b]}
    counts = collections.Counter(x for pair in linked for x in pair)
    assert {r.doc_id: r.n_links for r in ngram_join.link_counts(df).collect()} == {k: counts[k] for k in docs} | {None: 0}


@pytest.mark.parametrize("seed", [3, 4])
def test_links_derived_from_leaders_are_those_of_brute_force(spark, seed):
    """Groups whose members differ from each other by about the threshold, and drifting chains."""
    rng = np.random.default_rng(seed)
    docs = {}
    for g in range(6):
        base = [f"g{g}w{x}" for x in range(int(rng.integers(40, 200)))]
        for _ in range(12):
            copy = list(base)
            for at in rng.integers(0, len(copy), rng.integers(0, max(2, len(copy) // 45) + 1)):
                copy[at] = f"n{rng.integers(0, 3)}" if rng.random() < 0.5 else f"u{len(docs)}"
            docs[len(docs)] = " ".join(copy)
            if rng.random() < 0.3:
                base = copy
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in docs.items() if (w := t.split())}
    linked = {(a, b) for a in docs for b in docs if a < b and 100 * (x := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - x)}
    df = spark.createDataFrame([*docs.items(), (0, docs[0])], "doc_id long, text string").repartition(3)
    members, links = ngram_join.join(df)
    of = collections.defaultdict(set)
    for r in members.collect():
        of[r.key].add(r.id)
    got = {(min(x, y), max(x, y)) for r in links.collect() for x in of[r.a] for y in of[r.b]}
    same = {(x, y) for ids in of.values() for x in ids for y in ids if x < y}
    assert len(linked) > 50 and got | same == linked
    assert len(linked) < sum(1 for a in docs for b in docs if a < b and a // 12 == b // 12)


def test_pairs_of_one_leader_are_told_by_differences(spark):
    """Sets are needed only where no common leader tells: without any set, pairs of one leader come out right."""
    rng = np.random.default_rng(9)
    lead = np.unique(rng.integers(0, 1 << 62, 200).astype(np.uint64))
    sets = {0: lead}
    for k in range(1, 40):
        gone = rng.random(len(lead)) < rng.uniform(0, 0.12)
        pool = np.arange(1, 30, dtype=np.uint64)
        sets[k] = np.union1d(lead[~gone], pool[rng.random(len(pool)) < rng.uniform(0, 0.5)])
    jaccard = lambda a, b: (x := len(np.intersect1d(a, b)), len(a) + len(b) - x)
    table = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in sets.items()], "key long, tokens binary")
    told = ngram_join._differences(spark.createDataFrame([(k, 0) for k in sets if k], "a long, b long"), table, 80).cache()
    followers = sorted(r.key for r in told.collect())
    assert followers == [k for k in sets if k and 100 * jaccard(sets[k], lead)[0] >= 80 * jaccard(sets[k], lead)[1]]
    pairs = [(a, b) for a in [0, *followers] for b in followers if a < b]
    got = {(r.a, r.b) for r in ngram_join._derived(spark.createDataFrame(pairs, "a long, b long"), told, table.limit(0), 80).collect()}
    want = {(a, b) for a, b in pairs if 100 * jaccard(sets[a], sets[b])[0] >= 80 * jaccard(sets[a], sets[b])[1]}
    assert got == want and 0 < len(want) < len(pairs)


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 1 << 63, 50).astype(np.uint64)]))
        x, y = (np.frombuffer(ngram_join.parity(s), np.uint8) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_candidates_of_lists_are_those_of_all_pairs():
    """What size and position blocks leave out is what the bounds rule out, no more."""
    rng = np.random.default_rng(11)
    for percent, shared in [(80, 3), (80, 1), (50, 2)]:
        part = np.sort(rng.integers(0, 4, 400))
        n = rng.integers(1, 60, 400)
        pos = (rng.random(400) * n).astype(np.int64)
        order = np.lexsort([pos, n, part])
        part, n, pos = part[order], n[order], pos[order]
        got = [(int(k), int(x)) for ks, xs in ngram_join.candidates(part, n, pos, percent, shared) for k, x in zip(ks, xs)]
        want = {(k, x) for k in range(400) for x in range(k + 1, 400) if part[k] == part[x] and ngram_join._possible(n[k], pos[k], n[x], pos[x], percent, shared)}
        assert len(got) == len(set(got)) and set(got) == want
    assert not list(ngram_join.candidates(*(np.zeros(0, np.int64),) * 3, 80, 3))


def test_long_lists_are_dealt_without_loss(spark):
    """Lists cut into shards of a few sets give the links of whole lists."""
    words = [f"w{k}" for k in range(200)]
    docs = [(k, " ".join([*words[: k * 2], f"x{k}", *words[k * 2 + 1 :]])) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    links = {(r.a, r.b) for r in ngram_join.join(df)[1].collect()}
    assert len(links) == 60 * 59 // 2
    dealt = [(r.a, r.b) for r in ngram_join.join(df, most=7)[1].collect()]
    assert len(dealt) == len(set(dealt)) and set(dealt) == links
