"""Regular-expression spans as native Spark expressions.

Spark has no function for all match positions, but the pieces between matches
(`split`) and the matches (`regexp_extract_all`) fix them: a match starts after
all earlier pieces and matches.  Positions are code points, ends exclusive.

The functions take column names and write SQL, which reaches the planner in one
call.  Work grows with a text's length and its number of matches: no array is
grown inside an accumulator, which would be copied whole at every step, and no
place is counted from the text's start.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "cast(array() as array<struct<kind:string,start:int,end:int,value:string>>)"
_RUN = 64  # numbers that are added one by one
_CHUNK = 1024  # code points


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """body, in which name stands for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _total(part: str) -> str:
    return f"aggregate({part}, 0, (s, y) -> s + y)"


def running(sizes: str) -> str:
    """Sums of the first 1, 2, ... of an array of integers: each place adds its own run's beginning to the runs before it."""
    runs = f"transform(sequence(0, int((size(x) - 1) div {_RUN})), j -> {_total(f'slice(x, j * {_RUN} + 1, {_RUN})')})"
    before = let("r", runs, f"transform(r, (u, j) -> {_total('slice(r, 1, j)')})")
    inside = _total(f"slice(x, int(k div {_RUN}) * {_RUN} + 1, k % {_RUN} + 1)")
    return let("x", sizes, let("b", before, f"transform(x, (u, k) -> get(b, int(k div {_RUN})) + {inside})"))


def find(text: str, pattern: str, kind: str, cheap: str | None = None) -> Column:
    """array<struct<kind, start, end, value>> of leftmost non-overlapping matches.

    cheap: a condition without which there is no match; spares the scan.
    """
    p = quoted(pattern)
    sizes = f"zip_with(transform(slice(split({text}, {p}, -1), 1, size(m)), g -> length(g)), m, (g, v) -> g + length(v))"
    placed = let("e", running(sizes), f"transform(m, (v, k) -> named_struct('kind', '{kind}', 'start', get(e, k) - length(v), 'end', get(e, k), 'value', v))")
    spans = let("m", f"regexp_extract_all({text}, {p}, 0)", f"if(size(m) = 0, {NONE}, {placed})")
    return F.expr(spans if cheap is None else f"if({cheap}, {spans}, {NONE})")


def leftmost(spans: str) -> str:
    """Sorted spans without those that begin inside an earlier one that stays."""
    step = "named_struct('end', if(v.start >= acc.`end`, v.`end`, acc.`end`), 'kept', concat(acc.kept, if(v.start >= acc.`end`, '1', '0')))"
    kept = f"split(aggregate(x, named_struct('end', 0, 'kept', ''), (acc, v) -> {step}).kept, '')"
    return let("x", spans, f"if(size(x) < 2, x, {let('b', kept, 'filter(x, (v, k) -> get(b, k) = ' + quoted('1') + ')')})")


def _touches(base: str) -> str:
    """Whether the span a touches one of base, sorted spans free of overlaps: of those that begin before its end, only the last can."""
    ahead = "p + shiftleft(1, h - 1)"
    step = f"if({ahead} <= size({base}) AND get({base}, {ahead} - 1).start < a.`end`, {ahead}, p)"
    search = let("p", f"aggregate(sequence(int(ceil(log2(size({base}) + 1))) + 1, 1, -1), 0, (p, h) -> {step})", f"p > 0 AND get({base}, p - 1).`end` > a.start")
    return f"if(size({base}) <= 16, exists({base}, x -> a.start < x.`end` AND x.start < a.`end`), {search})"


def drop_overlaps(added: str, base: list[str]) -> Column:
    """The added spans that touch no span of the base columns."""
    return F.expr(f"filter({added}, a -> NOT ({' OR '.join(map(_touches, base))}))")


def joined(spans: Column, by: list[str], first: str) -> Column:
    """kind:start:end of all spans, comma-joined; first: "kind" or "start" is the leading sort key."""
    keyed = F.transform(
        spans,
        lambda x: F.struct(
            *((F.array_position(F.array(*map(F.lit, by)), x["kind"]), x["start"]) if first == "kind" else (x["start"], F.array_position(F.array(*map(F.lit, by)), x["kind"]))),
            x["end"],
            F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")).alias("label"),
        ),
    )
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["label"]), ",")


def chunks(text: str) -> str:
    """The text in pieces of _CHUNK code points, so that a place far into it is reached without counting from its start."""
    return f"regexp_extract_all({text}, {quoted(f'(?s).{{1,{_CHUNK}}}')}, 0)"


def at(pieces: str, start: str, length: str) -> str:
    """Up to length (at most _CHUNK) code points from start, of a text given as chunks."""
    k = f"int(({start}) div {_CHUNK})"
    return f"substring(concat(coalesce(get({pieces}, {k}), ''), coalesce(get({pieces}, {k} + 1), '')), ({start}) % {_CHUNK} + 1, {length})"


def before(pieces: str, span: str, n: int) -> str:
    """Lower-cased text before a span, of a text given as chunks."""
    left = f"greatest({span}.start - {n}, 0)"
    return f"lower({at(pieces, left, f'{span}.start - {left}')})"


def after(pieces: str, span: str, n: int) -> str:
    """Lower-cased text after a span, of a text given as chunks."""
    return f"lower({at(pieces, f'{span}.`end`', str(n))})"
