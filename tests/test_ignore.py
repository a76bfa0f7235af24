"""Ignore rules worked out by hand: order, folders, what is taken back, globs."""

from __future__ import annotations

import pytest

from fathomline.sources import ignore


def _ignored(spark, files, rules, defaults=()):
    found = ignore.ignored(spark.createDataFrame([("r", f) for f in files], "repo string, path string"), spark.createDataFrame([("r", d, c) for d, c in rules], "repo string, folder string, content string"), defaults)
    return sorted(r.path for r in found.collect())


def test_last_match_wins_and_folders_hold(spark):
    files = ["a.log", "keep.log", "src/a.log", "src/keep.log", "src/deep/x.log", "src/deep/y.txt", "build/keep.log", "docs/build", "docs/b/build/z.md", "src/deep/own.txt", "top.txt", "src/top.txt"]
    rules = [("", "*.log\n!keep.log\nbuild/\n/top.txt\n# no rule\n\n"), ("src/deep", "*.txt\n!own.txt\n!x.log"), ("src", "keep.log")]
    assert _ignored(spark, files, rules) == ["a.log", "build/keep.log", "docs/b/build/z.md", "src/a.log", "src/deep/y.txt", "src/keep.log", "top.txt"]


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("a/b", ["a/b", "a/b/c"], ["x/a/b"]),
        ("**/b", ["b", "a/b", "a/c/b/d"], ["ab"]),
        ("a/**", ["a/b", "a/b/c"], ["a", "b/a/c"]),
        ("a/**/z", ["a/z", "a/b/z", "a/b/c/z"], ["a/bz"]),
        ("?x", ["ax", "d/bx"], ["x", "abx"]),
        ("[ab]c", ["ac", "bc/d"], ["cc"]),
        ("[!ab]c", ["cc"], ["ac"]),
        ("\\!odd", ["!odd"], ["odd"]),
        ("\\#odd", ["#odd"], ["odd"]),
        ("f(1).md", ["f(1).md"], ["f1.md"]),
        ("dir/", ["dir/a", "x/dir/b"], ["dir", "x/dir"]),
        ("trail  ", ["trail"], ["trail  "]),
        ("*.m?", ["a.md", "b/c.mx"], ["a.mdx"]),
    ],
)
def test_patterns(pattern, yes, no):
    rule = ignore.rule_of(pattern)

    def hits(path):
        parts = path.split("/")
        return any(rule[0].fullmatch("/".join(parts[:n])) and (n < len(parts) or not rule[2]) for n in range(1, len(parts) + 1))

    assert all(map(hits, yes)) and not any(map(hits, no))


def test_defaults_and_odd_rows(spark):
    files = ["node_modules/a.js", "src/node_modules/b.js", ".env", ".env.local", "x.png", "go.sum", "main.go", "", None]
    assert _ignored(spark, files, [("", "!x.png"), (None, None)], ignore.DEFAULTS) == [".env", ".env.local", "go.sum", "node_modules/a.js", "src/node_modules/b.js"]
    assert _ignored(spark, files, []) == [] and _ignored(spark, [], [("", "*")]) == []


def test_repository_reads_ignore_files_and_globs(spark, tmp_path):
    from fathomline.sources import files

    tree = {
        "a.ts": b"a", "a.gen.ts": b"a", "tmp/b.ts": b"b", "src/keep.gen.ts": b"k", "src/tmp/c.ts": b"c",
        "late.ts": b"x" * 9000 + b"\0", "src/Dockerfile": b"FROM x", "src/x.html": b"no", "src/skip.ts": b"s",
    }
    for name, content in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rules = spark.createDataFrame([("", "*.gen.ts\n/tmp/\n"), ("src", "!keep.gen.ts\n")], "folder string, content string")
    assert sorted(r.path for r in files.repository(spark, str(tmp_path), ignore_files=rules).collect()) == ["a.ts", "src/Dockerfile", "src/keep.gen.ts", "src/skip.ts", "src/tmp/c.ts"]
    assert sorted(r.path for r in files.repository(spark, str(tmp_path), include=["src/**"], exclude=["**/skip.*", "src/*/c.ts"], ignore_files=rules).collect()) == ["src/Dockerfile", "src/keep.gen.ts"]
