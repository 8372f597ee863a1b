"""Secrets: patterns, and character Markov models of random strings against identifiers.

Two first-order character models are trained on labelled samples: random
strings (hexadecimal, base-36 and base-64 renderings of digests) and ordinary
identifiers (words of a bounded sample of the documents, joined the ways
programmers join them).  A token of the texts is a secret where the mean
log-likelihood ratio of its character pairs passes a threshold.

Training reads at most `sample_docs` documents; scanning is one map over all
texts in native expressions, with the ratio table (one value per pair of the
fixed alphabet) as a literal.

Defined results: null text is empty and has no spans; null ids are carried;
repeated rows get equal results; an empty table trains on the random strings
alone and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import drop_overlaps, find, joined, quoted

BASE = ["assign", "access", "hex"]
ADDED = ["random"]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_TOKEN = "A-Za-z0-9+/_=-"
_ASSIGNED = r"""(?i)(?:password|passwd|secret|token|key)["']?\x20*+[:=]"""
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]{12,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
    "random": rf"(?<![{_TOKEN}])[{_TOKEN}]{{20,}}+",
}


def labelled_samples(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", n_random: int = 6000, sample_docs: int = 2000) -> DataFrame:
    """Rows (label, value): 1 random, 0 identifier.

    Identifiers come from the whole texts of the `sample_docs` documents of
    smallest hash; id and text are hashed, so copies are drawn like any others.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(digest))
    kinds = F.array(F.substring(digest, 1, 40), F.substring(F.translate(b64, "+/=", "xQ7"), 1, 32), F.substring(b64, 1, 40), F.upper(F.substring(F.translate(b64, "+/=", "K3Z"), 1, 20)))
    random = spark.range(n_random).select(F.lit(1).alias("label"), F.element_at(kinds, (F.col("id") % 4 + 1).cast("int")).alias("value"))
    drawn = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), F.xxhash64(F.col(id_col), F.col(text)).alias("h"))
    last = drawn.select("h").distinct().orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    sample = drawn.where(F.col("h") <= F.lit(last).cast("long")).dropDuplicates(["h"])
    words = F.filter(F.regexp_extract_all(F.col("t"), F.lit("[A-Za-z]{3,}"), F.lit(0)), lambda w: F.length(w) < 20)
    three = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1)), F.lit(7)),
        lambda k: F.slice(F.col("w"), k, F.lit(3)),
    )
    joins = [
        lambda x: F.lower(F.array_join(x, "_")),
        lambda x: F.array_join(F.transform(x, F.initcap), ""),
        lambda x: F.lower(F.array_join(x, "-")),
        lambda x: F.lower(F.array_join(x, "/")),
        lambda x: F.upper(F.array_join(x, "_")),
        lambda x: F.concat(F.lower(F.array_join(x, "")), F.lit("2024")),
    ]
    plain = sample.select(words.alias("w")).where(F.size("w") >= 3).select(F.explode(F.flatten(F.transform(three, lambda x: F.array(*(j(x) for j in joins))))).alias("value"))
    return random.unionByName(plain.select(F.lit(0).alias("label"), "value"))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each character pair, row-major over the alphabet.

    At most two rows per pair reach the driver; pair counts get add-one smoothing.
    """
    k = len(ALPHABET)
    pairs = samples.where(F.length("value") > 1).select("label", F.explode(F.expr(f"transform(sequence(1, length(value) - 1), i -> struct(locate(substring(value, i, 1), '{ALPHABET}') as a, locate(substring(value, i + 1, 1), '{ALPHABET}') as b))")).alias("p"))
    rows = pairs.where("p.a > 0 and p.b > 0").groupBy("label", "p.a", "p.b").count().collect()
    counts = [[[1.0] * k for _ in range(k)] for _ in (0, 1)]
    for r in rows:
        counts[r["label"]][r["a"] - 1][r["b"] - 1] += r["count"]
    logs = [[[math.log(x / sum(row)) for x in row] for row in m] for m in counts]
    return [logs[1][a][b] - logs[0][a][b] for a in range(k) for b in range(k)]


def ratio(value: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's character pairs."""
    k = len(ALPHABET)
    lookup = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    codes = F.transform(F.split(value, ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)))

    def step(acc: Column, c: Column) -> Column:
        pair = F.when((acc["last"] > 0) & (c > 0), F.get(lookup, (acc["last"] - 1) * k + c - 1)).otherwise(0.0)
        return F.struct(c.alias("last"), (acc["sum"] + pair).alias("sum"))

    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
    return F.aggregate(codes, start, step, lambda acc: acc["sum"]) / F.greatest(F.length(value) - 1, F.lit(1))


def find_secrets(docs: DataFrame, table: list[float] | None = None, *, id_col: str = "doc_id", text: str = "text", threshold: float = 0.4) -> DataFrame:
    """One row per document: counts, digest of the base spans, all spans."""
    table = table or train(labelled_samples(docs, id_col=id_col, text=text))
    cheap = {
        "assign": f"rlike(__text, {quoted(_ASSIGNED)})",
        "access": "contains(__text, 'AKIA')",
        "hex": "rlike(__text, '[0-9a-f]{32}')",
        "random": f"rlike(__text, {quoted(f'[{_TOKEN}]{{20}}')})",
    }
    found = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    raw = {k: find("__text", PATTERNS[k], k, cheap[k]) for k in PATTERNS}
    raw["assign"] = F.filter(raw["assign"], lambda x: F.length(F.regexp_extract(x["value"], r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)\z", 1)) >= 8)
    found = found.select("__id", *(raw[k].alias(f"__{k}") for k in PATTERNS))
    found = found.select("*", F.concat(*(F.col(f"__{k}") for k in BASE)).alias("__base"))
    random = F.filter(drop_overlaps("__random", [f"__{k}" for k in BASE]), lambda x: ratio(x["value"], table) >= threshold)
    found = found.select("*", F.concat("__base", random).alias("__all"))
    return found.select(
        F.col("__id").alias(id_col),
        *(F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(F.col("__base"), BASE, "start"), 256).alias("base_sha256"),
        joined(F.col("__all"), [*BASE, *ADDED], "start").alias("spans"),
        F.col("__all").alias("found"),
    )
