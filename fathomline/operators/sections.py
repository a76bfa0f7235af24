"""Bracketed sections of source text and the objects in them, aware of strings and comments.

One pass over a text pairs its brackets, and its braces; what stands in strings, templates
and comments counts for nothing, and a bracket that is never closed pairs with none. Sections,
objects and lines are then looked up, so the cost is in proportion to the text and what is found.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKENS = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|(['\"`])(?:\\.|(?!\1)[^\\])*(?:\1|\Z)|[\[\]{}]", re.DOTALL)
_PROPERTY = re.compile(
    r"""(?:(["'])([^"'\n]+)\1|(?<![\w$.])([A-Za-z_$][\w$]*))\s*:\s*(?:"((?:\\.|[^"\\])*)"|'((?:\\.|[^'\\])*)'|`((?:\\.|[^`\\])*)`|([^\s,{}\[\]][^,\n\r{}\[\]]*))|(['"`])(?:\\.|(?!\8)[^\\])*\8""",
    re.DOTALL,
)
CLOSES = {"]": "[", "}": "{"}


class Text:
    """A text with its pairs of brackets and braces."""

    def __init__(self, text: str) -> None:
        self.text, self.close = text, {}
        quiet, held = list(text), {"[": [], "{": []}  # the text without comments, and what is open
        for m in _TOKENS.finditer(text):
            c = m[0]
            if c in held:
                held[c].append(m.start())
            elif c in CLOSES:
                if held[CLOSES[c]]:
                    self.close[held[CLOSES[c]].pop()] = m.start()
            elif c.startswith(("//", "/*")):
                quiet[m.start() : m.end()] = re.sub(r"[^\n]", " ", c)
        self.code = "".join(quiet)
        closed = {c: [k for k in self.close if text[k] == c] for c in held}
        self.opens = {c: sorted(closed[c] + held[c]) for c in held}
        self.lines = [m.start() for m in re.finditer("\n", text)]

    def line(self, at: int) -> int:
        return bisect_left(self.lines, at) + 1

    def sections(self, names: list[str]) -> Iterator[tuple[str, int, int]]:
        """(name, first, last) of the bracketed part that follows each mention of a name outside comments; mentions inside a section are part of it."""
        for name in names:
            done = 0
            for m in re.finditer(rf"(?<![\w$]){re.escape(name)}(?![\w$])", self.code):
                k = bisect_left(self.opens["["], max(m.end(), done))
                if m.start() >= done and k < len(self.opens["["]):
                    first = self.opens["["][k]
                    if first in self.close:
                        yield name, first + 1, self.close[first]
                        done = self.close[first]

    def objects(self, first: int, last: int) -> Iterator[tuple[int, int]]:
        """The outermost braced parts between two places."""
        opens, at = self.opens["{"], first
        while (k := bisect_left(opens, at)) < len(opens) and opens[k] < last:
            end = self.close.get(opens[k], opens[k])
            if opens[k] < end <= last:
                yield opens[k], end
            at = end + 1

    def properties(self, first: int, last: int) -> dict[str, str]:
        """Values by name, without the quotes of strings; the first of a name counts."""
        found: dict[str, str] = {}
        for m in _PROPERTY.finditer(self.code, first, last):
            name = m[2] or m[3]
            if name:
                value = next((v for v in (m[4], m[5], m[6]) if v is not None), None)
                found.setdefault(name, (m[7] or "").strip() if value is None else value)
        return found


def _found(names: list[str], n_keys: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string()))
    for batch in batches:
        rows, out = [], []
        for i, text in enumerate(batch.column(n_keys).to_pylist()):
            if text and any(n in text for n in names):
                t = Text(text)
                for section, (name, first, last) in enumerate(t.sections(names), 1):
                    for place, (a, b) in enumerate(t.objects(first, last), 1):
                        rows.append(i)
                        out.append((name, section, place, t.line(a), t.line(b), list(t.properties(a, b).items())))
        if rows:
            made = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(rows)) for k in range(n_keys)), *made], names=[*batch.schema.names[:n_keys], *COLUMNS])


COLUMNS = ("name", "section", "place", "start_line", "end_line", "properties")


def named_objects(files: DataFrame, keys: list[str], names: list[str], content: str = "content") -> DataFrame:
    """(keys, name, section, place, start_line, end_line, properties): the objects of the bracketed sections that follow the names in files."""
    read = files.select(*keys, F.col(content).alias("_content"))
    schema = ", ".join([*(f"`{k}` {read.schema[k].dataType.simpleString()}" for k in keys), "name string, section int, place int, start_line int, end_line int, properties map<string,string>"])
    return read.mapInArrow(partial(_found, names, len(keys)), schema)
