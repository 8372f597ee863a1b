"""Weak supervision for document quality.

Rules vote good (+1), bad (-1) or abstain (0).  A latent-class model with one
vote distribution per rule and class is fitted by expectation-maximisation on
the counts of vote patterns over all documents; a document's posterior
probability of being good replaces the usual "passes every rule".

Two map-only passes over the texts: the first counts vote patterns (at most
3 ** len(RULES) rows reach the driver, whatever the corpus holds), the second
applies the fitted model.  Nothing else is shuffled.

Defined results: null text has no words; a null doc_id is carried along like
any other value; repeated rows are judged alike; an empty table gives an empty
result; other columns are ignored by `score` and kept as they are by `keep`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """the of and to in is that it for was on are as with be by this an at from or have not but which
    der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es an er hat aus
    de la le les et en un une du des est que dans pour au par sur qui avec pas plus
    el los se del las con su para al lo como no sus y o""".encode().split()
)
SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Features:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int
    n_upper: int
    n_stop: int
    n_marks: int
    n_odd: int
    n_stutter: int


def features(utf8: bytes) -> Features:
    """Counts over one whole text; words are runs of anything but ASCII white space."""
    words = utf8.split()
    n = len(words)
    text = utf8.decode("utf-8", "replace")
    chars = len(text) - sum(text.count(c) for c in SPACES)
    lines = [x for x in utf8.split(b"\n") if x.strip()]
    repeated = stutter = 0
    if n > 3:
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
        v = len(seen)
        stutter = int((ids[1:] == ids[:-1]).sum())
        pair = ids[:-1] * v + ids[1:]
        if v > 2_000_000:  # keeps the triple below 2 ** 63
            pair = np.unique(pair, return_inverse=True)[1]
        order = np.argsort(triple := pair[:-1] * v + ids[2:], kind="stable")
        same = triple[order][1:] == triple[order][:-1]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeated = int(covered.sum())
    low = utf8.lower()
    return Features(
        n,
        chars,
        len(utf8) - len(utf8.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(utf8) - len(utf8.translate(None, UPPER)),
        sum(map(STOP_WORDS.__contains__, low.translate(None, b".,;:!?").split())),
        utf8.count(b"!"),
        sum(utf8.count(c) for c in (b"{", b"}", b"=", b"\\", b"~", b"^", b"http")) + text.count("�"),
        stutter,
    )


def _band(x: float, good: float, bad: float) -> int:
    """+1 on the good side of `good`, -1 beyond `bad`, else no vote."""
    if good < bad:
        return 1 if x <= good else -1 if x > bad else 0
    return 1 if x >= good else -1 if x < bad else 0


# Each rule sees the counts and votes; documents of under 20 words give most rules too little to judge by.
RULES = {
    "symbols": lambda f: _band(f.n_symbols / max(f.word_chars, 1), 0.02, 0.08),
    "capitals": lambda f: 0 if f.word_chars < 20 else _band(f.n_upper / max(f.word_chars, 1), 0.15, 0.4),
    "repeats": lambda f: 0 if f.n_words < 20 else _band(f.n_repeat_words / f.n_words, 0.2, 0.5),
    "stutter": lambda f: 0 if f.n_words < 20 else _band(f.n_stutter / f.n_words, 0.03, 0.2),
    "dup_lines": lambda f: 0 if f.n_lines < 3 else _band(f.n_dup_lines / f.n_lines, 0.1, 0.4),
    "stop_words": lambda f: 0 if f.n_words < 20 else _band(f.n_stop / f.n_words, 0.12, 0.04),
    "word_length": lambda f: 0 if f.n_words < 20 else (1 if 3.0 <= f.word_chars / f.n_words <= 8.0 else -1 if not 2.0 <= f.word_chars / f.n_words <= 12.0 else 0),
    "shouting": lambda f: 0 if f.n_words < 5 else _band(f.n_marks / f.n_words, 0.05, 0.3),
    "markup": lambda f: 0 if f.n_words < 20 else _band(f.n_odd / f.n_words, 0.02, 0.15),
}


def pattern(f: Features) -> int:
    """The votes as one base-3 number."""
    code = 0
    for rule in RULES.values():
        code = code * 3 + rule(f) + 1
    return code


def votes(code: int) -> list[int]:
    out = []
    for _ in RULES:
        code, v = divmod(code, 3)
        out.append(v - 1)
    return out[::-1]


@dataclass(frozen=True)
class Model:
    """prior: share of good documents; table[c, j, v]: P(rule j votes v - 1 | class c, it votes), class 1 good.

    An abstention says nothing about the class.
    """

    prior: float
    table: np.ndarray

    def posterior(self, code: int) -> float:
        v = np.asarray(votes(code)) + 1
        j = np.flatnonzero(v != 1)
        v = v[j]
        bad = math.log1p(-self.prior) + np.log(self.table[0, j, v]).sum()
        good = math.log(self.prior) + np.log(self.table[1, j, v]).sum()
        return float(1 / (1 + math.exp(min(700.0, max(-700.0, bad - good)))))


def em(counts: dict[int, int], rounds: int = 200, tolerance: float = 1e-9) -> Model:
    """Expectation-maximisation over weighted vote patterns.

    It starts from the belief that a rule seldom votes bad without reason, so a
    document is the more doubtful the more rules do; the same belief, as
    pseudo-counts, fixes which class is called good and keeps empty tables
    defined.  A document on which all rules abstain keeps the prior.
    """
    m = len(RULES)
    belief = np.array([[[2.0, 0.0, 3.0]] * m, [[1.0, 0.0, 50.0]] * m])
    if not counts:
        return Model(0.9, belief / belief.sum(axis=2, keepdims=True))
    codes = sorted(counts)
    w = np.array([counts[c] for c in codes], float)
    V = np.array([votes(c) for c in codes])
    p = 0.95 * 0.3 ** (V < 0).sum(axis=1)
    hot = np.eye(3)[V + 1]
    hot[:, :, 1] = 0
    last = -np.inf
    for _ in range(rounds):
        prior = float((w @ p + 9.0) / (w.sum() + 10.0))
        table = belief + np.stack([np.einsum("i,ijv->jv", w * (1 - p), hot), np.einsum("i,ijv->jv", w * p, hot)])
        table /= table.sum(axis=2, keepdims=True)
        logs = np.einsum("ijv,cjv->ic", hot, np.log(np.maximum(table, 1e-300))) + np.log([1 - prior, prior])
        top = logs.max(axis=1, keepdims=True)
        z = np.exp(logs - top)
        p = z[:, 1] / z.sum(axis=1)
        like = float(w @ (top[:, 0] + np.log(z.sum(axis=1))))
        if like - last < tolerance * abs(like):
            break
        last = like
    return Model(prior, table)


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Fit the model on every document."""
    counted = map_arrow(
        docs.select(texts(docs, text)),
        lambda b: _counts([pattern(features(x)) for x in b.column(0).to_pylist()]),
        "pattern long, n long",
    )
    return em({r[0]: r[1] for r in counted.groupBy("pattern").agg(F.sum("n")).collect()})


def _counts(codes: list[int]) -> pa.RecordBatch:
    k, n = np.unique(np.asarray(codes, np.int64), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], ["pattern", "n"])


def _judge(utf8: bytes, known: dict[int, float], model: Model, threshold: float, min_words: int, max_repeat: float):
    f = features(utf8)
    code = pattern(f)
    p = known.get(code)
    if p is None:
        p = known[code] = model.posterior(code)
    failed = f.n_words < min_words or 100 * f.n_repeat_words > max_repeat * f.n_words
    return f, code, p, failed, not failed and p >= threshold


def score(
    docs: DataFrame,
    model: Model | None = None,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    threshold: float = 0.5,
    min_words: int = 50,
    max_repeat: float = 50,
) -> DataFrame:
    """One row per document: counts, votes, posterior and verdict."""
    model = model or fit(docs, text)
    known: dict[int, float] = {}
    names = list(RULES)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [_judge(x, known, model, threshold, min_words, max_repeat) for x in batch.column(1).to_pylist()]
        col = lambda get, kind: pa.array([get(*r) for r in rows], kind)
        count = lambda name: col(lambda f, *_: getattr(f, name), pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *map(count, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                col(lambda f, c, p, failed, kept: failed, pa.bool_()),
                col(lambda f, c, p, failed, kept: kept, pa.bool_()),
                col(lambda f, c, p, failed, kept: p, pa.float64()),
                col(lambda f, c, p, failed, kept: ",".join(f"{k}{v:+d}" for k, v in zip(names, votes(c)) if v), pa.string()),
            ],
            ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good", "rule_votes"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_good double, rule_votes string"
    return map_arrow(docs.select(F.col(id_col), texts(docs, text)), lambda b: _named(run(b), id_col), schema)


def _named(batch: pa.RecordBatch, id_col: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(batch.columns, [id_col, *batch.schema.names[1:]])


def keep(docs: DataFrame, model: Model | None = None, *, text: str = "text", threshold: float = 0.5, min_words: int = 50, max_repeat: float = 50) -> DataFrame:
    """The rows of docs that the rules keep, with their own columns."""
    model = model or fit(docs, text)
    known: dict[int, float] = {}
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        mask = [_judge((x or "").encode("utf-8", "surrogatepass"), known, model, threshold, min_words, max_repeat)[4] for x in batch.column(at).to_pylist()]
        return batch.filter(pa.array(mask, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
