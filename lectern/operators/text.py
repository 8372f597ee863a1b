"""Text content: cleaning, chapter splitting, matching.

Cleaning and matching are column expressions.  Splitters carry state along a
text, so they run as Arrow maps over whole texts, one output row per section.
"""

from __future__ import annotations

import html
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.arrow import slices

# Formats of headings and of the public-domain frame.
ENGLISH_HEADING = r"(?im)^(?:chapter\s+(?:[ivxlcdm]+|\d+|[a-z]+)\b[^\n]{0,100}|(?:book|part)\s+(?:[ivxlcdm]+|\d+|one|two|three|four|five|six|seven|eight|nine|ten)\b[^\n]{0,100}|[IVXLCDM]{1,8}\.?)\s*$"
RUSSIAN_HEADING = r"(?im)^(?:(?:глава|часть)\s+[ivxlcdm\dа-яё]+.*|[IVXLCDM]{1,8}\.?)\s*$"
FRAME_START = r"\*\*\*\s*START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK .*?\*\*\*"
FRAME_END = r"\*\*\*\s*END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK .*?\*\*\*"


# ---- cleaning, as expressions ---------------------------------------------------------------


def tidy(text: Column) -> Column:
    """Blanks collapsed, lines trimmed, at most one blank line, ends trimmed."""
    text = F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")
    text = F.regexp_replace(text, r" *\n *", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""))


def _unescape(text: Column) -> Column:
    """Character references decoded (an Arrow UDF, made where a session is there to register it)."""

    def decoded(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], ["x"])
        parts = [pa.array([None if x is None else html.unescape(x) for x in part.column(0).to_pylist()], pa.string()) for part in slices([batch])]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return F.arrow_udf(decoded, "string")(text)


def html_to_text(raw: Column, entities: bool = True) -> Column:
    """Scripts and styles gone, closing blocks as line ends, tags stripped."""
    text = F.regexp_replace(raw, r"(?is)<script.*?>.*?</script>|<style.*?>.*?</style>", "")
    text = F.regexp_replace(text, r"(?i)</(?:p|div|section|article|h[1-6]|li|br)>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    return tidy(_unescape(text) if entities else text)


def first_title(text: Column, order: Column, most: int = 120) -> Column:
    """First non-empty line of at most `most` characters, else "Chapter n"."""
    lines = F.filter(F.split(text, "\n"), lambda x: (F.length(F.trim(x)) > 0) & (F.length(F.trim(x)) <= most))
    return F.coalesce(F.trim(F.get(lines, F.lit(0))), F.concat(F.lit("Chapter "), order.cast("string")))


def strip_frame(text: Column) -> Column:
    """What stands between the START and END markers of a public-domain e-book."""
    text = F.regexp_replace(F.regexp_replace(text, "﻿", ""), r"\r\n?", "\n")
    text = F.regexp_replace(text, rf"(?is)\A.*?{FRAME_START}", "")
    return tidy(F.regexp_replace(text, rf"(?is){FRAME_END}.*\z", ""))


def strip_frame_lines(text: Column) -> Column:
    """The lines after the first START line and before the first END line."""
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    at = lambda mark: F.array_position(F.transform(lines, lambda x: x.rlike(rf"\*\*\* ?{mark}")), F.lit(True))
    end = F.when(at("END") > 0, at("END") - 1).otherwise(F.size(lines))
    return squeeze(F.array_join(F.slice(lines, at("START").cast("int") + 1, F.greatest(end - at("START"), F.lit(0)).cast("int")), "\n"))


def squeeze(text: Column) -> Column:
    """No-break spaces and runs of blanks as one blank, at most one blank line, ends trimmed."""
    text = F.regexp_replace(F.regexp_replace(text, " ", " "), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def between(text: Column, start: str, end: str | None) -> Column:
    """From one heading to the next, both found in any case; empty without the first."""
    low = F.lower(text)
    a = F.locate(start.lower(), low) if isinstance(start, str) else start
    b = F.lit(0) if end is None else F.call_function("locate", F.lit(end.lower()), low, a + F.lit(len(start)))
    cut = F.when(b > 0, F.substring(text, a, b - a)).otherwise(F.substring(text, a, F.length(text)))
    return F.when(a == 0, "").otherwise(F.regexp_replace(cut, r"^\s+|\s+$", ""))


def strip_page(raw: Column, first: str, last: list[str]) -> Column:
    """Tags as line ends, then from the line `first` to a line that begins with one of `last`."""
    text = tidy(_unescape(F.regexp_replace(raw, "<[^>]+>", "\n")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    start = F.greatest(F.array_position(F.transform(lines, F.lower), first.lower()), F.lit(1)).cast("int")
    rest = F.slice(lines, start, F.greatest(F.size(lines), F.lit(1)))
    stops = F.transform(rest, lambda x: F.array_contains(F.array(*(x.startswith(y) for y in last)), True))
    stop = F.array_position(stops, F.lit(True)).cast("int")
    return F.array_join(F.when(stop > 0, F.slice(rest, F.lit(1), stop - 1)).otherwise(rest), "\n")


def clean_wikitext(text: Column) -> Column:
    """References, tags, flat templates, link syntax and quote marks removed."""
    text = F.regexp_replace(text, r"(?s)<ref.*?</ref>|<[^>]+>", "")
    text = F.regexp_replace(text, r"(?s)\{\{.*?\}\}", "")
    text = F.regexp_replace(text, r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1")
    text = F.regexp_replace(text, r"\[https?://[^\s\]]+\s*([^\]]*)\]", "$1")
    return squeeze(F.regexp_replace(text, "'''|''", ""))


def normal(value: Column) -> Column:
    """Lower-cased letters and digits, anything else one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-zа-яё0-9]+", " "))


def match_confidence(wanted_title: Column, wanted_author: Column, title: Column, author: Column) -> Column:
    """high, medium, low or reject; an empty found title matches nothing."""
    wt, wa, ft, fa = map(normal, (wanted_title, wanted_author, title, author))
    by = (wa != "") & F.contains(fa, wa)
    near = (wt != "") & (ft != "") & (F.contains(ft, wt) | F.contains(wt, ft))
    return F.when((wt != "") & (wt == ft) & by, "high").when(near & by, "medium").when(near, "low").otherwise("reject")


def formats(mimes: Column) -> Column:
    """Distinct sorted TXT / EPUB of an array of MIME types; null where there is none."""
    kinds = F.transform(mimes, lambda m: F.when(F.contains(m, F.lit("text/plain")), "TXT").when(F.contains(m, F.lit("epub")), "EPUB"))
    found = F.array_sort(F.array_distinct(F.filter(kinds, lambda k: k.isNotNull())))
    return F.when(F.size(found) > 0, found)


# ---- splitters ------------------------------------------------------------------------------

Section = tuple[str, str]


def by_size(text: str, chars: int, name: str = "Part {}") -> list[Section]:
    """Pieces of at most `chars`, cut at a blank line where one lies in their second half."""
    out: list[Section] = []
    at = 0
    while at < len(text):
        end = at + chars
        if end < len(text) and (blank := text.rfind("\n\n", at, end)) > at + chars // 2:
            end = blank
        if body := text[at:end].strip():
            out.append((name.format(len(out) + 1), body))
        at = min(end, len(text))
    return out


def by_heading(text: str, pattern: str, *, after: int = -1, least: int = 500, chars: int = 30_000, name: str = "Part {}", front: str | None = None, title_most: int = 180) -> list[Section]:
    """Sections from heading to heading.

    after: headings up to this offset do not count; least: shorter sections go;
    front: name of the leading text if it is long enough to stay.  Without two
    headings, or without a section that is long enough, the text is cut by size.
    """
    starts = [m.start() for m in re.finditer(pattern, text) if m.start() > after]
    if len(starts) < 2:
        return by_size(text, chars, name)
    bodies = [text[a:b].strip() for a, b in zip(starts, [*starts[1:], len(text)])]
    out: list[Section] = []
    if front and len(lead := text[: starts[0]].strip()) >= least:
        out.append((front, lead))
    for body in bodies:
        if len(body) >= least:
            title = next((x.strip() for x in body.split("\n") if 0 < len(x.strip()) <= title_most), f"Chapter {len(out) + 1}")
            out.append((title, body))
    return out or by_size(text, chars, name)


def at_ratios(text: str, ratios: tuple[float, ...]) -> list[str]:
    """Parts cut at the last line end before each share of the text."""
    goals = [int(len(text) * r) for r in ratios]
    cuts = [cut if (cut := text.rfind("\n", 0, goal)) > 0 else goal for goal in goals]
    return [text[a:b].strip() for a, b in zip([0, *cuts], [*cuts, len(text)])]


def fixed_sections(text: str, headings: list[str], divide: dict[str, tuple[float, ...]] | None = None) -> list[Section]:
    """Text between consecutive headings; sections named in `divide` are cut at ratios as well."""
    low, out = text.lower(), []
    for head, following in zip(headings, [*headings[1:], None]):
        a = low.find(head.lower())
        b = -1 if following is None or a < 0 else low.find(following.lower(), a + len(head))
        body = "" if a < 0 else text[a : b if b >= 0 else len(text)].strip()
        ratios = (divide or {}).get(head)
        out += [(f"{head} {k}", part) for k, part in enumerate(at_ratios(body, ratios), 1)] if ratios else [(head, body)]
    return out


def wiki_sections(text: str, title: str, least: int = 80, skip: tuple[str, ...] = ("references", "дерек")) -> list[Section]:
    """Sections under == headings ==; reference sections and short ones go."""
    heads = list(re.finditer(r"(?m)^==+\s*(.+?)\s*==+\s*$", text))
    if len(heads) < 2:
        return [(title, text.strip())] if text.strip() else []
    ends = [h.start() for h in heads[1:]] + [len(text)]
    found = [(h[1][:255], text[h.end() : e].strip()) for h, e in zip(heads, ends)]
    return [(t, b) for t, b in found if len(b) >= least and not t.lower().startswith(skip)]


class _Paragraphs(HTMLParser):
    """Paragraphs inside a div whose class contains a marker, however divs nest."""

    def __init__(self, marker: str):
        super().__init__()
        self.marker, self.depth, self.open, self.found = marker, 0, None, []

    def handle_starttag(self, tag, attrs):
        if tag == "div" and (self.depth or self.marker in (dict(attrs).get("class") or "")):
            self.depth += 1
        elif tag == "p" and self.depth:
            self.open = []

    def handle_endtag(self, tag):
        if tag == "p" and self.open is not None:
            if text := " ".join("".join(self.open).split()):
                self.found.append(text)
            self.open = None
        elif tag == "div" and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if self.open is not None:
            self.open.append(data)


def paragraphs(page: str, marker: str) -> list[Section]:
    parser = _Paragraphs(marker)
    parser.feed(page)
    return [(f"Paragraph {k}", x) for k, x in enumerate(parser.found, 1)]


def split_texts(df: DataFrame, split: Callable[[str], list[Section]], *, id_col: str, text: str) -> DataFrame:
    """(id, section_order, title, content): split applied to every whole text; null texts have no section."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(k, n, *s) for k, t in enumerate(batch.column(1).to_pylist()) for n, s in enumerate(split(t or ""), 1)]
            at, order, title, content = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(order, pa.int32()), pa.array(title, pa.string()), pa.array(content, pa.string())], [id_col, "section_order", "title", "content"])

    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, section_order int, title string, content string")


# ---- EPUB -----------------------------------------------------------------------------------


def epub_chapters(data: bytes) -> list[tuple[int, str, str]]:
    """(spine order, href, markup) of the HTML items of an EPUB; gaps in the order stay."""
    local = lambda tree, name: [x for x in tree.iter() if x.tag.rpartition("}")[2] == name]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = local(ElementTree.fromstring(z.read("META-INF/container.xml")), "rootfile")
        if not root:
            raise ValueError("the container names no root file")
        package = root[0].get("full-path")
        tree = ElementTree.fromstring(z.read(package))
        items = {x.get("id"): x for x in local(tree, "item") if x.get("href")}
        out = []
        for order, ref in enumerate(local(tree, "itemref"), 1):
            item = items.get(ref.get("idref"))
            if item is not None and "html" in item.get("media-type", ""):
                href = posixpath.normpath(posixpath.join(posixpath.dirname(package), item.get("href")))
                out.append((order, href, z.read(href).decode("utf-8", "replace")))
        return out


def read_epubs(files: DataFrame) -> DataFrame:
    """(path, chapter_order, href, title, content) of binary files (path, content); empty chapters go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for at in range(batch.num_rows):
                path, data = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                rows = epub_chapters(data)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["path", "chapter_order", "href", "raw"])

    raw = files.select("path", "content").mapInArrow(run, "path string, chapter_order int, href string, raw string")
    text = raw.withColumn("content", html_to_text(F.col("raw"))).where("content <> ''")
    return text.select("path", "chapter_order", "href", first_title(F.col("content"), F.col("chapter_order")).alias("title"), "content")
