"""Files to chunks: fixed line windows, Markdown sections, blank-line blocks, declarations.

Sizes are in characters (four a token). What follows lines with a carried state runs as one Arrow function over the
files' batches; Markdown sections also exist as a plan of built-in functions (`markdown_sections`).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.code_nodes import EXTRACTORS, LANGUAGES

CHARS_PER_TOKEN, MAX_TOKENS, OVERLAP = 4, 1000, 100
MARKDOWN = (".md", ".mdx", ".markdown")
#: Extension to language for files that are cut at blank lines.
BLOCK_LANGUAGES = {".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby", ".php": "php", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".swift": "swift", ".kt": "kotlin"}
HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
FIELDS = ("content", "source_type", "start_line", "end_line", "start_offset", "end_offset", "header_path", "header_level", "language", "fqn", "fragment_type", "fragment_subtype", "receiver_type")
SCHEMA = "content string, source_type string, start_line int, end_line int, start_offset int, end_offset int, header_path string, header_level int, language string, fqn string, fragment_type string, fragment_subtype string, receiver_type string"


def windows(lines: list[str], most: int, overlap: int) -> list[tuple[int, int]]:
    """Windows [first, after the last) of lines: greedy up to `most` characters, each beginning with lines of the last.

    A line counts its line break, but for the last line. The carried lines are as many from the end as fit into
    `overlap`, one at least.
    """
    out, first, size = [], 0, 0
    for i, line in enumerate(lines):
        n = len(line) + (i < len(lines) - 1)
        if size + n > most and i > first:
            out.append((first, i))
            first, size = i - 1, len(lines[i - 1]) + 1
            while first > out[-1][0] and size + len(lines[first - 1]) + 1 <= overlap:
                first -= 1
                size += len(lines[first]) + 1
        size += n
    if lines:
        out.append((first, len(lines)))
    return out


class Chunker(Protocol):
    """What chunks a file: supports(path) and chunks(path, text) as dicts of FIELDS."""

    def supports(self, path: str) -> bool: ...

    def chunks(self, path: str, text: str) -> list[dict]: ...


class _Sized:
    def __init__(self, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP):
        self.most, self.overlap = max_tokens * CHARS_PER_TOKEN, overlap * CHARS_PER_TOKEN

    def windowed(self, lines: list[str], first_line: int, **fields) -> list[dict]:
        """Line windows of a part that is too long, with its fields."""
        return [dict(content="\n".join(lines[a:b]), start_line=first_line + a, end_line=first_line + b - 1, **fields) for a, b in windows(lines, self.most, self.overlap)]


class FixedChunker(_Sized):
    """Line windows with offsets; every file."""

    def supports(self, path: str) -> bool:
        return True

    def chunks(self, path: str, text: str) -> list[dict]:
        if not text:
            return []
        if len(text) <= self.most:
            return [dict(content=text, source_type="text", start_offset=0, end_offset=len(text))]
        lines, out = text.split("\n"), []
        offsets = [0]
        for line in lines:
            offsets.append(offsets[-1] + len(line) + 1)
        for a, b in windows(lines, self.most, self.overlap):
            content = "\n".join(lines[a:b])
            out.append(dict(content=content, source_type="text", start_offset=offsets[a], end_offset=offsets[a] + len(content)))
        return out


class MarkdownChunker(_Sized):
    """A section a heading, with the path of headings above it."""

    def supports(self, path: str) -> bool:
        return path.lower().endswith(MARKDOWN)

    def chunks(self, path: str, text: str) -> list[dict]:
        lines, out = text.replace("\r\n", "\n").split("\n"), []
        heads = [(i, m) for i, line in enumerate(lines) if (m := HEADING.match(line))]
        above: list[tuple[int, str]] = []
        cuts = [(0, None)] * (not heads or heads[0][0] > 0) + heads
        for k, (i, m) in enumerate(cuts):
            level = len(m[1]) if m else 0
            if m:
                above = [x for x in above if x[0] < level] + [(level, f"{m[1]} {m[2].strip()}")]
            part = lines[i : cuts[k + 1][0] if k + 1 < len(cuts) else len(lines)]
            content = "\n".join(part)
            fields = dict(source_type="markdown", header_path=" > ".join(x[1] for x in above) or None, header_level=level or None)
            if not content.strip():
                continue
            out += self.windowed(part, i + 1, **fields) if len(content) > self.most else [dict(content=content, start_line=i + 1, end_line=i + len(part), **fields)]
        return out


class BlockChunker(_Sized):
    """Blocks between two or more blank lines, joined while they fit."""

    def supports(self, path: str) -> bool:
        return os.path.splitext(path)[1].lower() in BLOCK_LANGUAGES

    def blocks(self, text: str) -> list[tuple[int, int, list[str]]]:
        """(first line, last line, lines that aren't blank) of each block."""
        out, held, blank = [], [], 0
        for number, line in enumerate(text.split("\n"), 1):
            if line.strip():
                if blank >= 2 and held:
                    out.append(held)
                    held = []
                held.append((number, line))
                blank = 0
            else:
                blank += 1
        if held:
            out.append(held)
        return [(b[0][0], b[-1][0], [x for _, x in b]) for b in out]

    def chunks(self, path: str, text: str) -> list[dict]:
        language = BLOCK_LANGUAGES[os.path.splitext(path)[1].lower()]
        out, group, size = [], [], 0

        def flush() -> None:
            nonlocal group, size
            if group:
                out.append(dict(content="\n\n".join("\n".join(x[2]) for x in group), source_type="code", start_line=group[0][0], end_line=group[-1][1], language=language))
            group, size = [], 0

        for block in self.blocks(text):
            n = len("\n".join(block[2]))
            if n > self.most:
                flush()
                out += self.windowed(block[2], block[0], source_type="code", language=language)
                continue
            if group and size + n > self.most:
                flush()
            size += n + bool(group)
            group.append(block)
        flush()
        return out


class DeclarationChunker(_Sized):
    """A chunk a declaration; a file without declarations is one chunk."""

    def supports(self, path: str) -> bool:
        return os.path.splitext(path)[1].lower() in LANGUAGES

    def chunks(self, path: str, text: str) -> list[dict]:
        if not text:
            return []
        language = LANGUAGES[os.path.splitext(path)[1].lower()]
        lines, out = text.split("\n"), []
        for node in EXTRACTORS[language](text):
            part = lines[node.start_line - 1 : node.end_line]
            content = "\n".join(part)
            fields = dict(source_type="code", language=language, fqn=node.fqn, fragment_type=node.fragment_type, fragment_subtype=node.subtype, receiver_type=node.receiver)
            out += self.windowed(part, node.start_line, **fields) if len(content) > self.most else [dict(content=content, start_line=node.start_line, end_line=node.end_line, **fields)]
        return out or [dict(content=text, source_type="code", start_line=1, end_line=len(lines), language=language)]


def default_chunkers(max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[Chunker]:
    """In the order in which they are asked; the last takes every file."""
    return [c(max_tokens, overlap) for c in (DeclarationChunker, BlockChunker, MarkdownChunker, FixedChunker)]


def chunked(files: DataFrame, path_col: str = "path", text_col: str = "content", carry: tuple[str, ...] = (), chunkers: list[Chunker] | None = None, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """The carried columns, path, ordinal (from 0 in each file) and FIELDS, a row a chunk. Null texts have no chunk."""
    asked = chunkers or default_chunkers(max_tokens, overlap)
    key = F.struct(*[F.col(c) for c in (*carry, path_col)])
    rows = files.select(key.alias("file"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    types = [pa.string() if " string" in f else pa.int32() for f in SCHEMA.split(", ")]
    names = ["file", "ordinal", *FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ordinal, made = [], [], []
            for i, (path, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found = next(c for c in asked if c.supports(path or "")).chunks(path or "", text) if text else []
                at += [i] * len(found)
                ordinal += range(len(found))
                made += found
            columns = [pa.array([m.get(f) for m in made], t) for f, t in zip(FIELDS, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ordinal, pa.int32()), *columns], names)

    out = rows.mapInArrow(run, f"file {rows.schema['file'].dataType.simpleString()}, ordinal int, {SCHEMA}")
    return out.select(*[F.col("file").getField(c).alias(c) for c in (*carry, path_col)], "ordinal", *FIELDS)


def chunker_of(path_col: str = "path") -> F.Column:
    """Which chunker takes a path, as a column."""
    ext = F.lower(F.regexp_extract(path_col, r"(\.[^./]+)$", 1))
    return F.when(ext.isin(*LANGUAGES), "declarations").when(ext.isin(*BLOCK_LANGUAGES), "blocks").when(ext.isin(*MARKDOWN), "markdown").otherwise("fixed")


def language_of(path_col: str = "path") -> F.Column:
    """The language whose declarations are read in files of a path, as a column; null for others."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return known[F.lower(F.regexp_extract(path_col, r"(\.[^./]+)$", 1))]


def markdown_sections(files: DataFrame, key: str = "path", text_col: str = "content") -> DataFrame:
    """(key, ordinal, header_path, header_level, start_line, end_line, content) by built-in functions alone.

    Lines are numbered; a section is a running count of headings; the heading of level L is on the path if it is
    later than the last heading of every lower level. Sections aren't cut to a size here.
    """
    lines = files.select(F.col(key), F.posexplode(F.split(F.regexp_replace(text_col, "\r\n", "\n"), "\n")).alias("i", "line"))
    hashes = F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 1)
    lines = lines.withColumns({"level": F.length(hashes), "title": F.concat(hashes, F.lit(" "), F.trim(F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 2)))})
    lines = lines.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(Window.partitionBy(key).orderBy("i")))
    sections = lines.groupBy(key, "section").agg(
        F.min("i").alias("first"), F.max("i").alias("last"), F.max(F.when(F.col("level") > 0, F.col("level"))).alias("header_level"), F.max(F.when(F.col("level") > 0, F.col("title"))).alias("title"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("content"),
    )
    before = Window.partitionBy(key).orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    last = {n: F.last(F.when(F.col("header_level") == n, F.struct("section", "title")), ignorenulls=True).over(before) for n in range(1, 7)}
    sections = sections.withColumns({f"h{n}": c for n, c in last.items()})
    parts = []
    for n in range(1, 7):
        on = F.col(f"h{n}").isNotNull()
        for low in range(1, n):
            on = on & (F.col(f"h{n}.section") > F.coalesce(F.col(f"h{low}.section"), F.lit(-1)))
        parts.append(F.when(on, F.col(f"h{n}.title")))
    kept = sections.where(F.regexp_replace("content", r"\s", "") != "").withColumn("header_path", F.concat_ws(" > ", *parts))
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy("section")) - 1
    return kept.select(key, ordinal.alias("ordinal"), F.when(F.col("header_path") != "", F.col("header_path")).alias("header_path"), "header_level", (F.col("first") + 1).alias("start_line"), (F.col("last") + 1).alias("end_line"), "content")
