"""Chunks of source files by language: declarations, statements, sections and blocks, with symbols, sizes and overlap.

A file's lines are read once from the top; brace depth is a running sum, and where a body closes is looked up in minima of
it, so an unclosed body costs a logarithm and not the rest of the file. Files are independent rows, a map over Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sizes of chunks in lines and characters.
MIN_LINES, MAX_LINES, MIN_CHARS, MAX_CHARS, OVERLAP = 5, 120, 100, 2000, 3
SECTION_CHARS, KEYED_LINES, CONFIG_LINES, CONFIG_STEP, PHP_HEADER = 3200, 100, 150, 101, 6

LANGUAGES = (
    ("typescript", r"\.(?:tsx?|jsx?|mjs|cjs)$"), ("php", r"\.php$"), ("sql", r"\.sql$"), ("go", r"\.go$"), ("markdown", r"\.mdx?$"),
    ("json", r"\.json$"), ("yaml", r"\.ya?ml$"), ("config", r"(?:^|/)(?:\.env[^/]*|[^/]*rc|dockerfile|makefile)$"),
)


class Segment(NamedTuple):
    """Lines first to last (0-based, inclusive), what they are, and whose."""

    first: int
    last: int
    kind: str
    symbol: str | None = None
    parent: str | None = None


def language(path: str) -> str:
    low = path.lower()
    return next((name for name, pattern in LANGUAGES if re.search(pattern, low)), "text")


class Minima:
    """Finds the next place of a list with a value of at most a bound, by minima over blocks of blocks."""

    WIDTH = 16

    def __init__(self, values: list[int]) -> None:
        self.levels = [values]
        while len(self.levels[-1]) > self.WIDTH:
            below = self.levels[-1]
            self.levels.append([min(below[k : k + self.WIDTH]) for k in range(0, len(below), self.WIDTH)])

    def next(self, first: int, bound: int) -> int | None:
        """The first place from `first` on with a value of at most `bound`."""
        level, at = 0, first
        while True:
            row = self.levels[level]
            if at >= len(row):
                if level + 1 == len(self.levels):
                    return None
                level, at = level + 1, -(-at // self.WIDTH)
            elif row[at] <= bound:
                if level == 0:
                    return at
                level, at = level - 1, at * self.WIDTH
            elif (at + 1) % self.WIDTH == 0 and level + 1 < len(self.levels):
                level, at = level + 1, (at + 1) // self.WIDTH
            else:
                at += 1


class Braces:
    """Where the braces that open at or after a line close."""

    def __init__(self, lines: list[str]) -> None:
        self.after, depth = [], 0
        for line in lines:
            depth += line.count("{") - line.count("}")
            self.after.append(depth)
        self.minima = Minima(self.after)
        self.opens = [len(lines)] * (len(lines) + 1)  # the first line from here on that opens one
        for k in range(len(lines) - 1, -1, -1):
            self.opens[k] = k if "{" in lines[k] else self.opens[k + 1]
        self.lines = lines

    def close(self, first: int, limit: int | None = None) -> int:
        """The line that closes what opens from `first` on; MAX_LINES lines if nothing does."""
        last = len(self.lines) - 1 if limit is None else limit
        found = self.minima.next(self.opens[first], self.after[first - 1] if first else 0)
        return found if found is not None and found <= last else min(first + MAX_LINES - 1, last)


METHOD = re.compile(r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+|get\s+|set\s+)*([A-Za-z_$][\w$]*)\s*\([^)]*\)?[^;]*\{\s*$")
NOT_METHODS = {"if", "for", "while", "switch", "catch", "return", "function", "else", "do", "try"}


def typescript(lines: list[str]) -> Iterator[Segment]:
    braces, at = Braces(lines), 0
    while at < len(lines):
        line = lines[at]
        if m := re.match(r"\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)", line):
            end = braces.close(at)
            inner = [k for k in range(at + 1, end) if (x := METHOD.match(lines[k])) and x[1] not in NOT_METHODS and braces.after[k - 1] == (braces.after[at - 1] if at else 0) + 1]
            yield Segment(at, (inner[0] if inner else end + 1) - 1, "class", m[1])
            for k in inner:
                yield Segment(k, braces.close(k, end), "method", METHOD.match(lines[k])[1], m[1])
            at = end + 1
        elif m := re.match(r"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)", line):
            end = braces.close(at)
            yield Segment(at, end, "function", m[1])
            at = end + 1
        elif m := re.match(r"\s*export\s+(?:const|let|var)\s+([A-Za-z_$][\w$]*)", line):
            end = braces.close(at) if "{" in line else at
            if "[" in line and "]" not in line:
                end = next((k for k in range(at, len(lines)) if lines[k].startswith("]")), end)
            yield Segment(at, end, "const", m[1])
            at = end + 1
        else:
            at += 1


def php(lines: list[str]) -> Iterator[Segment]:
    braces, current = Braces(lines), None
    for k, line in enumerate(lines):
        if m := re.match(r"\s*(?:abstract\s+|final\s+)?(?:class|interface|trait)\s+(\w+)", line):
            current = m[1]
            yield Segment(k, min(k + PHP_HEADER - 1, len(lines) - 1), "class", current)
        elif m := re.match(r"\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+(\w+)", line):
            yield Segment(k, braces.close(k), "method" if current else "function", m[1], current)


def go(lines: list[str]) -> Iterator[Segment]:
    braces = Braces(lines)
    for k, line in enumerate(lines):
        if m := re.match(r"func\s+(?:\(\s*\w+\s+\*?(\w+)\s*\)\s*)?(\w+)", line):
            yield Segment(k, braces.close(k), "method" if m[1] else "function", m[2], m[1])
        elif m := re.match(r"type\s+(\w+)\s+struct\b", line):
            yield Segment(k, braces.close(k), "struct", m[1])


def sql(lines: list[str]) -> Iterator[Segment]:
    """Statements up to a line that ends in a semicolon, with the comment lines before them."""
    first = None
    for k, line in enumerate(lines):
        if first is None and line.strip():
            first = k
        if first is not None and line.rstrip().endswith(";"):
            yield Segment(first, k, "statement")
            first = None
    if first is not None:
        yield Segment(first, len(lines) - 1, "statement")


def cut_at(bounds: list[int], last: int, kind: str, names: Callable[[int], str | None] = lambda _: None) -> list[Segment]:
    """Segments that begin at the bounds, and what stands before the first."""
    edges = ([0] if not bounds or bounds[0] > 0 else []) + bounds
    return [Segment(a, b - 1, kind, names(a)) for a, b in zip(edges, [*edges[1:], last + 1])]


def markdown(lines: list[str]) -> Iterator[Segment]:
    def heads(level: int, first: int, last: int) -> list[int]:
        return [k for k in range(first, last + 1) if re.match("#" * level + r"\s", lines[k])]

    name = lambda k: (m := re.match(r"#+\s+(.*)", lines[k])) and m[1].strip()
    end = len(lines) - 1
    two = heads(2, 0, end)
    for part in cut_at(two or heads(3, 0, end), end, "section", name):
        three = [k for k in heads(3, part.first + 1, part.last)] if two else []
        if three and sum(len(x) + 1 for x in lines[part.first : part.last + 1]) > SECTION_CHARS:
            yield from (Segment(a, b - 1, "section", name(a)) for a, b in zip([part.first, *three], [*three, part.last + 1]))
        else:
            yield part


def keyed(pattern: str):
    def split(lines: list[str]) -> Iterator[Segment]:
        if len(lines) <= KEYED_LINES:
            yield Segment(0, len(lines) - 1, "config")
        else:
            yield from cut_at([k for k, x in enumerate(lines) if re.match(pattern, x)], len(lines) - 1, "config")

    return split


def config(lines: list[str]) -> Iterator[Segment]:
    at = 0
    while at < len(lines):
        last = len(lines) - 1
        if len(lines) > CONFIG_LINES and at + CONFIG_STEP <= last:
            last = next((k for k in range(at + CONFIG_STEP - 1, at, -1) if not lines[k].strip()), at + CONFIG_STEP - 1)
        yield Segment(at, last, "config")
        at = last + 1


def blocks(lines: list[str]) -> Iterator[Segment]:
    for at in range(0, len(lines), MAX_LINES):
        yield Segment(at, min(at + MAX_LINES, len(lines)) - 1, "block")


SPLITTERS = {
    "typescript": typescript, "php": php, "go": go, "sql": sql, "markdown": markdown, "json": keyed(r'  "[^"]+"\s*:'), "yaml": keyed(r"[A-Za-z_][\w-]*\s*:"), "config": config,
}


def _small(lines: list[str], s: Segment) -> bool:
    return s.last - s.first + 1 < MIN_LINES and sum(len(x) + 1 for x in lines[s.first : s.last + 1]) - 1 < MIN_CHARS


def _bounded(lines: list[str], s: Segment) -> Iterator[Segment]:
    """A segment of more than MAX_LINES lines or MAX_CHARS characters in windows of at most MAX_LINES lines, each cut after its last blank line."""
    if s.last - s.first < MAX_LINES and sum(len(x) + 1 for x in lines[s.first : s.last + 1]) - 1 <= MAX_CHARS:
        yield s
        return
    at = s.first
    while at <= s.last:
        end = min(at + MAX_LINES - 1, s.last)
        end = next((k for k in range(end, at, -1) if not lines[k].strip()), end)
        yield s._replace(first=at, last=end)
        at = end + 1


def chunks_of(path: str, content: str) -> list[tuple[int, int, str, str | None, str | None, bool, str]]:
    """(start_line, end_line, chunk_type, symbol, parent, has_overlap, content) of a file, lines from 1.

    Segments too small join the one before; what no declaration covers, in languages with declarations, is left out, but
    a file without any is taken in blocks. A chunk begins up to OVERLAP lines earlier, not before the segment ahead of it.
    """
    lines = re.split(r"\r?\n", content)
    found = list(SPLITTERS.get(language(path), blocks)(lines)) or list(blocks(lines))
    merged: list[Segment] = []
    for s in found:
        if merged and _small(lines, s) and s.first > merged[-1].first:
            merged[-1] = merged[-1]._replace(last=max(merged[-1].last, s.last))
        else:
            merged.append(s)
    out, before = [], None
    for s in (part for m in merged for part in _bounded(lines, m)):
        first = s.first if before is None else max(before.first, s.first - OVERLAP)
        text = "\n".join(lines[first : s.last + 1]).strip()
        if text and not (s.last - first + 1 < MIN_LINES and len(text) < MIN_CHARS):
            out.append((first + 1, s.last + 1, s.kind, s.symbol, s.parent, first < s.first, text))
        before = s
    return out


COLUMNS = "start_line int, end_line int, chunk_type string, symbol string, parent string, has_overlap boolean, content string"
_TYPES = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string())


def chunk_files(files: DataFrame, keys: list[str], path: str = "path", content: str = "content") -> DataFrame:
    """(keys, COLUMNS): the chunks of files; a null content has none."""
    read = files.select(*keys, F.col(path).alias("_path"), F.col(content).alias("_content"))
    n = len(keys)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(i, c) for i, (p, t) in enumerate(zip(part.column(n).to_pylist(), part.column(n + 1).to_pylist())) if t is not None for c in chunks_of(p or "", t)]
                take = pa.array([i for i, _ in rows], pa.int64())
                made = [pa.array([c[k] for _, c in rows], t) for k, t in enumerate(_TYPES)]
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(take) for k in range(n)), *made], names=[*keys, *(x.split()[0] for x in COLUMNS.split(", "))])

    schema = ", ".join([*(f"`{k}` {read.schema[k].dataType.simpleString()}" for k in keys), COLUMNS])
    return read.mapInArrow(split, schema)
