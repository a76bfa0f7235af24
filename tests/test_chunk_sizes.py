"""Chunks of large segments, exported variables, configuration names and unclosed bodies, worked out by hand."""

from __future__ import annotations

import random
import time

import pytest

from fathomline.operators import file_chunks as C


def _lines(found):
    return [(a, b, kind, symbol) for a, b, kind, symbol, *_ in found]


def test_a_segment_of_many_characters_is_cut_after_its_last_blank_line():
    body = ["function big() {", *["  call('" + "x" * 60 + "');"] * 20, "", *["  call('" + "y" * 60 + "');"] * 20, "}"]
    # 41 lines of about 70 characters: over 2,000, so cut after line 22, the blank one; the second part begins three lines earlier
    assert _lines(C.chunks_of("a.ts", "\n".join(body))) == [(1, 22, "function", "big"), (20, 43, "function", "big")]
    short = [line.replace("x" * 60, "x").replace("y" * 60, "y") for line in body]
    assert _lines(C.chunks_of("a.ts", "\n".join(short))) == [(1, 43, "function", "big")]
    whole = [line for line in body if line]  # no blank line to cut at
    assert _lines(C.chunks_of("a.ts", "\n".join(whole))) == [(1, 42, "function", "big")]


def test_a_segment_of_many_lines_is_cut_at_blank_lines_or_the_limit():
    body = ["function long() {", *(["  step();"] * 149 + [""] + ["  step();"] * 100), "}"]
    assert _lines(C.chunks_of("a.ts", "\n".join(body))) == [(1, 120, "function", "long"), (118, 151, "function", "long"), (149, 252, "function", "long")]


def test_exported_variables():
    text = "\n".join(f"export {kind} {kind}Value = [\n  '{'x' * 50}',\n  '{'y' * 50}',\n];" for kind in ("const", "let", "var"))
    assert [(kind, symbol) for _, _, kind, symbol, *_ in C.chunks_of("a.ts", text)] == [("const", "constValue"), ("const", "letValue"), ("const", "varValue")]


@pytest.mark.parametrize(
    ("path", "language"),
    [("a/.env.production", "config"), (".eslintrc", "config"), ("x/Dockerfile", "config"), ("Makefile", "config"), ("a.ini", "text"), ("x.config.js", "typescript"), ("arc/a.md", "markdown"), ("myDockerfile", "text")],
)
def test_languages_of_names(path, language):
    assert C.language(path) == language


def test_minima_find_the_next_place():
    rnd = random.Random(1)
    for n in (0, 1, 15, 16, 17, 300, 5000):
        values = [rnd.randrange(60) for _ in range(n)]
        minima = C.Minima(values)
        for _ in range(80):
            first, bound = rnd.randrange(n + 1), rnd.randrange(-1, 20)
            assert minima.next(first, bound) == next((k for k in range(first, n) if values[k] <= bound), None)


def test_unclosed_bodies_take_time_in_proportion():
    def seconds(n):
        text = "\n".join(f"func f{k}() {{" for k in range(n))
        began = time.process_time()
        list(C.go(text.split("\n")))
        return time.process_time() - began

    seconds(1000)
    assert seconds(16_000) < 12 * max(seconds(4_000), 0.01)
