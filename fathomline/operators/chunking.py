"""Splitting documents and source files into line-ranged chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MIN_LINES, MAX_LINES, MIN_CHARS, MAX_CHARS, OVERLAP = 5, 120, 100, 2000, 3
VERSION = "chunks-v1"


def lines(docs: DataFrame, content: str = "content") -> DataFrame:
    """docs without `content`, one row a line: line (1-based) and text."""
    rest = [c for c in docs.columns if c != content]
    return docs.select(*rest, F.posexplode(F.split(content, "\n")).alias("_p", "text")).select(*rest, (F.col("_p") + 1).alias("line"), "text")


def _assemble(numbered: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Chunks of numbered lines by a group number: start_line, end_line, content."""
    packed = numbered.groupBy(*keys, group).agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("x"))
    return packed.select(*keys, F.col("x")[0]["line"].alias("start_line"), F.element_at("x", -1)["line"].alias("end_line"), F.array_join("x.text", "\n").alias("content"))


def blocks(docs: DataFrame, size: int = MAX_LINES, content: str = "content") -> DataFrame:
    """Fixed blocks of lines, cut inside each row: no shuffle."""
    rest = [c for c in docs.columns if c != content]
    ls = F.split(content, "\n")
    cut = F.transform(F.sequence(F.lit(1), F.size("_l"), F.lit(size)), lambda i: F.struct(i.alias("s"), F.slice("_l", i, size).alias("t")))
    return (
        docs.select(*rest, ls.alias("_l"))
        .select(*rest, F.explode(cut).alias("b"))
        .select(*rest, F.col("b.s").alias("start_line"), (F.col("b.s") + F.size("b.t") - 1).alias("end_line"), F.array_join("b.t", "\n").alias("content"))
    )


def at_boundaries(numbered: DataFrame, keys: list[str], starts: Column) -> DataFrame:
    """Chunks that begin at lines where `starts` holds; lines before the first are a chunk of their own."""
    w = Window.partitionBy(*keys).orderBy("line")
    return _assemble(numbered.withColumn("_g", F.sum(F.when(starts, 1).otherwise(0)).over(w)), keys, "_g")


def sql_statements(numbered: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks that end at a line with a closing semicolon."""
    w = Window.partitionBy(*keys).orderBy("line")
    ends = F.coalesce(F.lag(F.when(F.col("text").rlike(r";\s*$"), 1).otherwise(0)).over(w), F.lit(0))
    return _assemble(numbered.withColumn("_e", ends).withColumn("_g", F.sum("_e").over(w)), keys, "_g")


def tiny(content: Column, start: Column, end: Column) -> Column:
    return (end - start + 1 < MIN_LINES) & (F.length(content) < MIN_CHARS)


def merge_tiny(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Tiny chunks join the chunk before them; size is judged before joining."""
    w = Window.partitionBy(*keys).orderBy("start_line")
    big = F.when(tiny(F.col("content"), F.col("start_line"), F.col("end_line")), 0).otherwise(1)
    grouped = chunks.withColumn("_g", F.sum(big).over(w)).groupBy(*keys, "_g")
    packed = grouped.agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.sort_array(F.collect_list(F.struct("start_line", "content"))).alias("x"))
    return packed.select(*keys, "start_line", "end_line", F.array_join("x.content", "\n").alias("content"))


def with_overlap(chunks: DataFrame, keys: list[str], overlap: int = OVERLAP) -> DataFrame:
    """Each chunk begins with up to `overlap` last lines of the one before it."""
    w = Window.partitionBy(*keys).orderBy("start_line")
    before = F.split(F.lag("content").over(w), "\n")
    n = F.coalesce(F.least(F.size("_b"), F.lit(overlap)), F.lit(0))
    return (
        chunks.withColumn("_b", before)
        .withColumn("content", F.when(F.col("_b").isNull(), F.col("content")).otherwise(F.concat(F.array_join(F.slice("_b", -n, n), "\n"), F.lit("\n"), "content")))
        .withColumn("has_overlap", F.col("_b").isNotNull())
        .withColumn("start_line", F.when(F.col("_b").isNull(), F.col("start_line")).otherwise(F.col("start_line") - n))
        .drop("_b")
    )


def content_hash(*parts: Column) -> Column:
    """The version and all parts, joined by colons, as SHA-256."""
    return F.sha2(F.concat_ws(":", F.lit(VERSION), *(p.cast("string") for p in parts)), 256)


def with_ids(chunks: DataFrame, *columns: str) -> DataFrame:
    """content_hash over the columns and the chunk_id derived from it."""
    out = chunks.withColumn("content_hash", content_hash(*(F.col(c) for c in columns)))
    return out.withColumn("chunk_id", T.uuid_of(F.col("content_hash")))


def is_noise(content: Column) -> Column:
    """A lone colour, CSS property or HTML tag, a generated-file notice, or hardly a letter."""
    x = T.strip(content)
    return (
        x.rlike(r"^#[0-9a-fA-F]{3,8};?$")
        | x.rlike(r"^[a-z-]+:\s*[^;\n]+;?$")
        | x.rlike(r"^</?[a-zA-Z][^>\n]*>$")
        | x.rlike(r"(?i)^[^\n]*(auto-generated|do not edit)")
        | (F.length(F.regexp_replace(x, r"\s+", "")) < 5)
    )


#: Where a declaration begins, by language.
DECLARATIONS = {
    "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|interface|enum|const\s+\w+\s*=\s*(?:async\s*)?\()",
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|const\s+\w+\s*=\s*(?:async\s*)?\()",
    "php": r"^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait|(?:public|private|protected)\s+(?:static\s+)?function|function)\s",
    "go": r"^(?:func|type\s+\w+\s+struct)",
}


def _declared(numbered: list[str], pattern: pd.Series) -> list[tuple[int, int]]:
    """(first, last) 0-based lines of the parts of a file: declarations to their closing brace, and what lies between."""
    out, at, n = [], 0, len(numbered)
    while at < n:
        if not pattern.iloc[at]:
            end = at
            while end + 1 < n and not pattern.iloc[end + 1]:
                end += 1
            out.append((at, end))
            at = end + 1
            continue
        depth, opened, end = 0, False, min(at + MAX_LINES - 1, n - 1)
        for k in range(at, n):
            depth += numbered[k].count("{") - numbered[k].count("}")
            opened |= "{" in numbered[k]
            if opened and depth <= 0:
                end = k
                break
        out.append((at, end))
        at = end + 1
    return out


def _capped(numbered: list[str], first: int, last: int) -> Iterator[tuple[int, int]]:
    """Parts of at most MAX_LINES lines and about MAX_CHARS characters, cut after a blank line where there is one."""
    while last - first + 1 > MAX_LINES or (sum(map(len, numbered[first : last + 1])) > MAX_CHARS and last > first):
        stop, n = first, len(numbered[first])
        while stop < last and stop - first + 1 < MAX_LINES and n + len(numbered[stop + 1]) <= MAX_CHARS:
            stop += 1
            n += len(numbered[stop])
        blank = next((k for k in range(stop, first, -1) if not numbered[k].strip()), stop)
        yield first, blank
        first = blank + 1
        if first > last:
            return
    yield first, last


def declarations(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """Chunks along declarations; a brace depth runs through the lines, so this part is a pandas map over whole files.

    Null content gives no chunk; files of other languages are cut by size only.
    """
    rest = [c for c in files.columns if c != content]
    read = files.withColumn("_lang", T.language_of(F.col(path)))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != content)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                values = dict(zip(pdf.columns, row, strict=True))
                whole, lang = values.pop(content), values.pop("_lang")
                if whole is None:
                    continue
                numbered = whole.split("\n")
                series = pd.Series(numbered, dtype=str)
                marks = series.str.contains(DECLARATIONS[lang]) if lang in DECLARATIONS else pd.Series([False] * len(numbered))
                for first, last in _declared(numbered, marks):
                    for a, b in _capped(numbered, first, last):
                        rows.append((*(values[c] for c in rest), a + 1, b + 1, "\n".join(numbered[a : b + 1])))
            yield pd.DataFrame(rows, columns=[*rest, "start_line", "end_line", "content"])

    return read.mapInPandas(split, f"{types}, start_line int, end_line int, content string")


def pack(docs: DataFrame, size: int = 1500, content: str = "content") -> DataFrame:
    """Lines packed greedily into pieces of at most `size` characters: a fold over each row's lines.

    A longer line is a piece of its own. Columns piece (1-based) and text.
    """
    rest = [c for c in docs.columns if c != content]
    step = lambda acc, x: F.when(
        acc["begun"] & (F.length(acc["open"]) + 1 + F.length(x) <= size),
        F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit("\n"), x).alias("open"), F.lit(True).alias("begun")),
    ).otherwise(
        F.struct(F.when(acc["begun"], F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), x.alias("open"), F.lit(True).alias("begun"))
    )
    zero = F.expr("named_struct('done', cast(array() as array<string>), 'open', '', 'begun', false)")
    folded = F.aggregate(F.split(content, "\n"), zero, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    return docs.select(*rest, F.posexplode(folded).alias("_p", "text")).select(*rest, (F.col("_p") + 1).alias("piece"), "text")
