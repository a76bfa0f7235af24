"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(x: Column) -> Column:
    """Without white space at both ends, of whatever kind."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def unique(values: Column, most: int) -> Column:
    """Trimmed, non-empty values in order of first appearance, at most so many."""
    return F.slice(F.array_distinct(F.filter(F.transform(values, strip), lambda x: x != "")), 1, most)


def normalize(x: Column) -> Column:
    """One line of lower-case text with single spaces."""
    return F.lower(strip(F.regexp_replace(x, r"\s+", " ")))


def fingerprint(x: Column, edge: int = 180) -> Column:
    """A normalised text, or its two ends if it is long."""
    n = normalize(x)
    return F.when(F.length(n) > 2 * edge, F.concat(F.left(n, F.lit(edge)), F.lit("…"), F.right(n, F.lit(edge)))).otherwise(n)


def uuid_of(digest: Column) -> Column:
    """A version 5 shaped UUID from a hexadecimal digest."""
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        F.lower(F.hex(nibble)), F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def normalize_path(x: Column) -> Column:
    """Forward slashes, no leading `./`, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(x, r"\\+", "/"), r"^(\./)+", ""))


def normalize_route(x: Column) -> Column:
    """Lower case without slashes at the end; the root for nothing."""
    out = F.lower(F.regexp_replace(strip(x), "/+$", ""))
    return F.when(out == "", F.lit("/")).otherwise(out)


def tokens(x: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text."""
    return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda t: t != "")


def slug(x: Column, words: int = 5) -> Column:
    """The first words, lower case, joined by hyphens."""
    return F.array_join(F.slice(tokens(x), 1, words), "-")


def head_tail(x: Column, head: int, tail: int) -> Column:
    """A long text's two ends."""
    return F.when(F.length(x) > head + tail, F.concat(F.left(x, F.lit(head)), F.lit("\n...\n"), F.right(x, F.lit(tail)))).otherwise(x)


def common_prefix(a: Column, b: Column) -> Column:
    """The number of leading path segments that two paths share."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same).cast("long"))


def language_of(path: Column) -> Column:
    """The language that a file name tells."""
    known = {
        "typescript": r"\.tsx?$", "javascript": r"\.[cm]?jsx?$", "php": r"\.php$", "sql": r"\.sql$", "go": r"\.go$",
        "markdown": r"\.mdx?$", "json": r"\.json$", "yaml": r"\.ya?ml$", "config": r"(\.env|\.ini|\.toml|\.conf)(\.example)?$",
    }
    low, out = F.lower(path), None
    for name, pattern in known.items():
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise("text")


def front_matter(x: Column) -> Column:
    """The map of `key: value` lines between two `---` lines at the top; a list loses its brackets."""
    block = F.regexp_extract(x, r"^---\n((?:.*\n)*?)---", 1)
    lines = F.filter(F.split(block, "\n"), lambda s: s.contains(":"))
    pairs = F.transform(lines, lambda s: F.struct(strip(F.split(s, ":", 2)[0]).alias("key"), F.regexp_replace(strip(F.split(s, ":", 2)[1]), r"^\[|\]$", "").alias("value")))
    # a repeated key keeps its last value
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)
