"""Notes to chunks: front matter withheld, sections by headings outside fences, windows of 1200 characters.

Most notes of a large corpus have no headings, front matter, blank lines or carriage returns; their windows are
plain column expressions. The others need a scan by line whose next cut depends on the last; they go to
an Arrow function, 1 row in and n rows out, without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions import text as tx
from inkspan.functions.policy import MAX_BYTES

#: Characters of a window and of the overlap after a hard cut.
POINTS, OVERLAP = 1200, 120
STEP = POINTS - OVERLAP

# What counts as a line, front matter, a fenced block, a heading and a paragraph break.
_BEGIN, _END, _REST = r"(?:\A|(?<=\n)|(?<=\r)(?!\n))", r"(?=[\r\n]|\Z)", r"[^\r\n\u2028\u2029]"
_LINE_END = re.compile("\n|\r(?!\n)")
_FRONT = re.compile("\ufeff?---[ \t]*" + _END)
_FRONT_BLOCK = re.compile(_FRONT.pattern + rf"(?s:.*?){_BEGIN}(?:---|\.\.\.)[ \t]*{_END}(?:\r\n|\r|\n)?")
_FENCED = r"(?P<{0}>{1}{{3,}}+)(?:(?!{2}){3})*{4}(?s:.*?)(?:{5} {{0,3}}(?P={0}){1}*[ \t]*{4}|\Z)"
_MARK = re.compile(
    rf"{_BEGIN} {{0,3}}(?:{_FENCED.format('ticks', '`', '`', _REST, _END, _BEGIN)}|{_FENCED.format('waves', '~', '(?!)', _REST, _END, _BEGIN)}|(?P<heading>#{{1,6}}(?:[ \t]+(?P<title>{_REST}*)|[ \t]*){_END}))"
)
_CLOSING = re.compile("[ \t]+#+[ \t]*$")
_PARAGRAPH = re.compile("(?:\r?\n|\r(?!\n))[ \t]*(?:\r?\n|\r(?!\n))")


def is_plain(text: Column) -> Column:
    """Whether fixed windows are all there is to chunking."""
    return ~(text.rlike("\r") | text.rlike(r"(?m)^ {0,3}#{1,6}([ \t]|$)") | text.rlike("^\ufeff?---") | text.rlike("\n[ \t]*\n"))


def fixed_windows(text: Column) -> Column:
    """Windows of plain text as an array of (text, start_line), blank ones dropped."""
    size = F.length(text)
    last = F.when(size <= POINTS, F.lit(0)).otherwise(F.ceil((size - POINTS) / F.lit(float(STEP)))).cast("int")

    def window(k: Column) -> Column:
        before = F.substring(text, F.lit(1), k * STEP)
        line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
        return F.struct(F.substring(text, k * STEP + 1, F.lit(POINTS)).alias("text"), line.cast("int").alias("start_line"))

    return F.filter(F.transform(F.sequence(F.lit(0), last), window), lambda w: ~tx.is_blank(w["text"]))


def headings(text: str) -> list[tuple[int, str]]:
    """(place, title) where sections begin: what is left after front matter, then every heading outside fenced blocks; none if front matter is not closed."""
    front = _FRONT_BLOCK.match(text)
    if front is None and _FRONT.match(text):
        return []
    first = front.end() if front else 0
    # a fenced block is one match, so the headings in it are not found
    return [(first, "")] + [(m.start(), _CLOSING.sub("", m["title"] or "").strip(tx.SPACES)) for m in _MARK.finditer(text, first) if m["heading"]]


def spans(section: str) -> list[tuple[int, int]]:
    """(begin, end) of the windows of a section: cut behind the last blank line that fits, else hard, and then the next one overlaps."""
    out: list[tuple[int, int]] = []
    begin = 0
    while begin < len(section):
        behind = [m.end() for m in _PARAGRAPH.finditer(section, begin, begin + POINTS)][-1:] if begin + POINTS < len(section) else [len(section)]
        out.append((begin, *behind) if behind else (begin, begin + POINTS))
        begin = behind[0] if behind else begin + STEP
    return out


def fragments(text: str) -> list[tuple[str, str, int]]:
    """(heading, text, start line) of every chunk of a note."""
    marks = headings(text)
    ends = [at for at, _ in marks[1:]] + [len(text)]
    line_ends = [m.start() for m in _LINE_END.finditer(text)]
    pieces = [(title, at + b, at + e) for (at, title), end in zip(marks, ends, strict=False) for b, e in spans(text[at:end])]
    return [(title, text[b:e], 1 + bisect_left(line_ends, b)) for title, b, e in pieces if text[b:e].strip(tx.SPACES)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(p, t, h, b, n, k) for p, t, x in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, (h, b, n) in enumerate(fragments(x))]
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
        names = ["path", "title", "heading", "text", "start_line", "ordinal"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def chunk(notes: DataFrame, plain_only: bool = False) -> DataFrame:
    """(path, title, heading, text, start_line, ordinal) of all notes up to 1 MiB.

    ``plain_only`` says that no note needs the scan by line, which leaves a plan without Python.
    """
    given = notes.select("path", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= MAX_BYTES)
    plain = given if plain_only else given.where(is_plain(F.col("text")))
    out = plain.select("path", "title", F.posexplode(fixed_windows(F.col("text"))).alias("ordinal", "_w")).select("path", "title", F.lit("").alias("heading"), "_w.text", "_w.start_line", "ordinal")
    if plain_only:
        return out
    scanned = given.where(~is_plain(F.col("text"))).mapInArrow(_scan, "path string, title string, heading string, text string, start_line int, ordinal int")
    return out.unionByName(scanned)


def with_ids(chunks: DataFrame) -> DataFrame:
    """Adds ``id``: path, start line, ordinal and content hash."""
    return chunks.withColumn("id", tx.chunk_id("path", "start_line", "ordinal", tx.content_hash("text")))
