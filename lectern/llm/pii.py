"""Personal data by proposal, checksum and context, in native Spark expressions.

Regular expressions propose spans.  Validators confirm them: Luhn for card
numbers, mod-97 for IBANs, digit counts and ranges elsewhere.  Kinds without a
checksum of their own get a score that words nearby raise or lower, and stay
where it reaches the threshold.  The base kinds (email, ip, card, phone) hold
by their validators alone; the added kinds (iban, national, local_phone) never
overlap them.

One map over the texts, no shuffle and no Python.  Patterns begin at the edge
of a run, so a long run is tried once.

Defined results: null text is empty and has no spans; null ids are carried;
repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import after, at, before, chunks, drop_overlaps, find, joined, leftmost, let, quoted

BASE = ["email", "ip", "card", "phone"]
ADDED = ["iban", "national", "local_phone"]

_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})",  # where one may start; _ibans finds its end
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9(+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
_IBAN_RUN = r"\A[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}"
_IBAN_SIZES = dict(
    x.split(":")
    for x in """NO:15 BE:16 DK:18 FI:18 FK:18 FO:18 GL:18 NL:18 SD:18 MK:19 SI:19 AT:20 BA:20 EE:20 KZ:20 LT:20 LU:20 MN:20 XK:20 CH:21 HR:21 LI:21 LV:21
    BG:22 BH:22 CR:22 DE:22 GB:22 GE:22 IE:22 ME:22 RS:22 VA:22 AE:23 GI:23 IL:23 IQ:23 OM:23 SO:23 TL:23 AD:24 CZ:24 ES:24 MD:24 PK:24 RO:24 SA:24 SE:24
    SK:24 TN:24 VG:24 LY:25 PT:25 ST:25 IS:26 TR:26 BI:27 DJ:27 FR:27 GR:27 IT:27 MC:27 MR:27 SM:27 AL:28 AZ:28 BY:28 CY:28 DO:28 GT:28 HU:28 LB:28 NI:28
    PL:28 SV:28 BR:29 EG:29 PS:29 QA:29 UA:29 JO:30 KW:30 MU:30 YE:30 MT:31 SC:31 LC:32 RU:33""".split()
)
# Score before context, and what a word nearby adds or takes.
PRIOR = {"national": 0.3, "local_phone": 0.35}
HELPS = {
    "national": r"\b(?:ssn|social security|national id|identity|tax id|passport|born)\b",
    "local_phone": r"\b(?:tel|phone|call|mobile|cell|fax|contact|dial|whatsapp)\b",
}
HURTS = r"\b(?:order|invoice|version|isbn|item|serial|part|model|page|ref|tracking)\b"
RAISE, LOWER, THRESHOLD = 0.4, 0.3, 0.6


# Without which a text holds no span of the kind.
_CHEAP = {"email": "contains(__text, '@')", "phone": "contains(__text, '+')"} | {
    kind: f"rlike(__text, {quoted(p)})"
    for kind, p in {"ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "national": "[0-9]-[0-9]{2}-[0-9]", "local_phone": "[0-9]{3}[.-][0-9]{4}"}.items()
}


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """True where the digits pass Luhn's checksum."""
    doubled = "int(substring(d, k, 1)) * if(k % 2 = 0, 2, 1)"
    return let("d", f"reverse({digits})", f"aggregate(sequence(1, length(d)), 0, (acc, k) -> acc + {doubled} - if({doubled} > 9, 9, 0)) % 10 = 0")


def mod97(value: str) -> str:
    """True where an IBAN's characters, country and check digits last, leave 1 modulo 97."""
    c = "substring(t, k, 1)"
    step = f"(acc * if({c} BETWEEN '0' AND '9', 10, 100) + ascii({c}) - if({c} BETWEEN '0' AND '9', 48, 55)) % 97"
    plain = f"replace({value}, ' ', '')"
    return let("t", f"concat(substring({plain}, 5), substring({plain}, 1, 4))", f"aggregate(sequence(1, length(t)), 0, (acc, k) -> {step}) = 1")


def _ibans(starts: str, pieces: str) -> str:
    """Spans of the IBANs that begin at the starts, leftmost first and without overlap.

    Of the word ends that pass mod-97 the one of the country's length counts, else the last.
    """
    sizes = "map(" + ", ".join(f"'{k}', {n}" for k, n in _IBAN_SIZES.items()) + ")"
    value = "substring(w, 1, e)"
    ends = f"filter(sequence(15, length(regexp_extract(w, {quoted(_IBAN_RUN)}, 0))), e -> rlike(substring(w, e, 2), {quoted('^[A-Z0-9](?![A-Za-z0-9])')}))"
    known = f"coalesce(length(replace({value}, ' ', '')) = try_element_at({sizes}, substring(w, 1, 2)), false)"
    best = f"array_max(transform(filter({ends}, e -> {mod97(value)}), e -> named_struct('known', {known}, 'size', e))).size"
    span = let("n", best, "named_struct('kind', s.kind, 'start', s.start, 'end', s.start + n, 'value', substring(w, 1, n))")
    return leftmost(f"filter(transform({starts}, s -> {let('w', at(pieces, 's.start', '65'), span)}), v -> v.`end` IS NOT NULL)")


def _confirmed(kind: str, spans: str, pieces: str) -> Column:
    if kind == "iban":
        return F.expr(_ibans(spans, pieces))
    digits = f"length({_digits('x.value')})"
    tests = {
        "email": "true",
        "ip": f"rlike(x.value, {quoted(r'^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:[.]|$)){4}$')})",
        "card": f"length(x.value) >= 13 AND if({digits} BETWEEN 13 AND 19, {luhn(_digits('x.value'))}, false)",
        "phone": f"{digits} BETWEEN 9 AND 15",
    }
    return F.expr(f"filter({spans}, x -> {tests[kind] if kind in tests else f'{context_score(kind, pieces)} >= {THRESHOLD}'})")


def context_score(kind: str, pieces: str) -> str:
    """Prior of the kind, more with a telling word on either side, less with a contrary one before."""
    sides = f"concat_ws(' ', {before(pieces, 'x', 40)}, {after(pieces, 'x', 20)})"
    return f"{PRIOR[kind]}D + if(rlike({sides}, {quoted(HELPS[kind])}), {RAISE}D, 0D) - if(rlike({before(pieces, 'x', 40)}, {quoted(HURTS)}), {LOWER}D, 0D)"


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, digest of the base spans, all spans and the text without them."""
    found = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    # Each stands for two scans of the text, so it is computed once and referred to below.
    found = found.select("__id", "__text", *(find("__text", PATTERNS[k], k, _CHEAP[k]).alias(f"__{k}") for k in (*BASE, *ADDED)))
    found = found.withColumn("__chunks", F.expr(f"if({' OR '.join(f'size(__{k}) > 0' for k in ADDED)}, {chunks('__text')}, null)"))
    found = found.select("__id", *(_confirmed(k, f"__{k}", "__chunks").alias(f"__{k}") for k in (*BASE, *ADDED)))
    base = [f"__{k}" for k in BASE]
    found = found.select("*", F.concat(*base).alias("__base"))
    found = found.select("*", F.concat("__base", *(drop_overlaps(f"__{k}", base) for k in ADDED)).alias("__all"))
    return found.select(
        F.col("__id").alias(id_col),
        *(F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(F.col("__base"), BASE, "kind"), 256).alias("base_sha256"),
        joined(F.col("__all"), [*BASE, *ADDED], "kind").alias("spans"),
        F.col("__all").alias("found"),
    )
