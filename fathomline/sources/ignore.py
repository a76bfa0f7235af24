"""Ignore files: the last rule that matches a path, or a folder above it, decides.

Rules belong to the folder of their ignore file and hold below it; those of deeper
folders come later, and within a file later lines. `!` takes a path back, but
nothing below an ignored folder comes back. A path is judged by itself and by each folder
above it, and each of these, distinct, once: folders are shared by many files. It
meets the rules of its own ancestors by an equi-join on the folder, so rules of other
folders are never looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns that hold in every repository, before its own (fixed values).
DEFAULTS = (
    "node_modules", "vendor", "third_party", "3rdparty", "dist", "build", "coverage", "out", ".next", ".nuxt", ".turbo", ".vercel", ".cache", ".codex", ".opencode", ".git", "logs",
    ".env", ".env.*", "*.pem", "*.key", "id_rsa", "*.dump", "*.sql.gz", "*.sqlite", "*.sqlite3", "*.db", "*.zip", "*.tar", "*.tgz", "*.gz", "*.7z", "*.rar",
    "*.png", "*.jpg", "*.jpeg", "*.gif", "*.webp", "*.ico", "*.pdf", "*.woff", "*.woff2", "*.ttf", "*.eot", "*.class", "*.jar", "*.o", "*.obj", "*.so", "*.dll", "*.exe",
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "go.sum",
)


def glob_regex(body: str) -> str:
    """The regular expression of a glob: `**` over folders, `*` and `?` within a name, `[...]`, a backslash before what is meant as it is."""
    out, at = [], 0
    while at < len(body):
        if body.startswith("**/", at) and (at == 0 or body[at - 1] == "/"):
            out.append("(?:[^/]+/)*")
            at += 3
        elif body.startswith("/**", at) and at + 3 == len(body):
            out.append("/.+")
            at += 3
        elif body[at] == "*":
            while body.startswith("*", at):
                at += 1
            out.append("[^/]*")
        elif body[at] == "[" and (end := body.find("]", at + 2)) > 0:
            inner = body[at + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + inner[1:] if inner[0] in '!^' else inner}]")
            at = end + 1
        else:
            at += body[at] == "\\" and at + 1 < len(body)
            out.append("[^/]" if body[at] == "?" and (at == 0 or body[at - 1] != "\\") else re.escape(body[at]))
            at += 1
    return "".join(out)


@lru_cache(65_536)
def rule_of(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern of a path below the rule's folder, taken back, only for folders) of a line; None for blank lines and comments."""
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    body = line[1:] if back else line
    folder = body.endswith("/")
    body = body.rstrip("/")
    if not body:
        return None
    rooted = "/" in body
    return re.compile(f"{'' if rooted else '(?:.*/)?'}{glob_regex(body.lstrip('/'))}", re.DOTALL), back, folder


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(repo, node, is_folder, depth, verdict): what the last matching rule of a folder says of a node, if any matches."""
    for batch in batches:
        out = []
        for repo, node, is_folder, folder, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            below = node[len(folder) + 1 :] if folder else node
            for line in reversed(lines):
                rule = rule_of(line)
                if rule and (is_folder or not rule[2]) and rule[0].fullmatch(below):
                    out.append((repo, node, is_folder, len(folder), not rule[1]))
                    break
        if out:
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["repo", "node", "is_folder", "depth", "verdict"])


def ignored(files: DataFrame, ignore_files: DataFrame, defaults: tuple[str, ...] = DEFAULTS) -> DataFrame:
    """(repo, path) of the files (repo, path) that are ignored.

    ignore_files: (repo, folder, content), one row an ignore file, folder empty at the root. Paths have forward slashes and no
    leading one. The defaults come before the lines of the root's file. Null and empty paths are never ignored.
    """
    parts = F.split("path", "/")
    cut = lambda n: F.array_join(F.slice(parts, 1, n), "/")
    paths = files.select("repo", "path").filter("path <> ''").distinct()
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(cut(n).alias("node"), (n < F.size(parts)).alias("is_folder")))
    placed = paths.select("repo", "path", F.explode(levels).alias("l")).select("repo", "path", "l.*")
    nodes = placed.select("repo", "node", "is_folder").distinct()

    # every repository has rules at its root
    lines = lambda c: F.split(F.coalesce(c, F.lit("")), "\n")
    own = ignore_files.select("repo", F.coalesce("folder", F.lit("")).alias("folder"), lines(F.col("content")).alias("lines"))
    first = F.array(*map(F.lit, defaults)) if defaults else F.array().cast("array<string>")
    # two files of a folder count one after the other by their text
    merged = own.groupBy("repo", "folder").agg(F.flatten(F.sort_array(F.collect_list("lines"))).alias("lines"))
    roots = nodes.select("repo").distinct().select("repo", F.lit("").alias("folder"))
    rules = merged.join(roots, ["repo", "folder"], "full_outer").select("repo", "folder", F.concat(F.when(F.col("folder") == "", first).otherwise(F.array()), F.coalesce("lines", F.array())).alias("lines"))

    above = F.split("node", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(above) - 1), lambda n: F.array_join(F.slice(above, 1, n), "/"))
    met = nodes.select("repo", "node", "is_folder", F.explode(folders).alias("folder")).join(rules, ["repo", "folder"]).select("repo", "node", "is_folder", "folder", "lines")
    found = met.mapInArrow(_verdicts, "repo string, node string, is_folder boolean, depth int, verdict boolean")
    last = found.groupBy("repo", "node", "is_folder").agg(F.max_by("verdict", "depth").alias("verdict")).filter("verdict")
    return placed.join(last, ["repo", "node", "is_folder"], "left_semi").select("repo", "path").distinct()
