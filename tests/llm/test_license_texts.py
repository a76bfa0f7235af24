from __future__ import annotations

import random

import pytest

from fathomline.llm import licenses

FILLER = "The quick report describes how rivers change over many years and what farmers do about it each spring."
TEXTS = {name: text for name, _, text in licenses.long_templates()}  # the complete text comes after a header


def scan(texts, spark):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.matches for r in licenses.scan_licenses(frame).orderBy("doc_id").collect()]


def test_complete_license_files(spark):
    names = sorted(licenses.COMPLETE)
    files = [f"Copyright (c) 2020 Somebody\n\n{TEXTS[n]}" for n in names]
    for name, text, found in zip(names, files, scan(files, spark), strict=True):
        best = max(found, key=lambda m: m.score)
        assert name in {m.license for m in found if m.score > 0.95}, (name, found)
        assert best.score <= 1 and best.line <= text.count("\n") + 1


def test_wrapped_notices_inside_longer_documents(spark):
    grant = TEXTS["MIT"].split("\n\n")[1].replace("\n", " ")
    header = next(t for n, _, t in licenses.HEADERS if n == "GPL-3.0").split()
    wrapped = "\n".join(" * " + " ".join(header[i : i + 9]) for i in range(0, len(header), 9))
    long_line = f"{FILLER} Licensed under the Apache License, Version 2.0. {FILLER}"
    in_text = f"{FILLER}\n" * 30 + "\n".join("# " + x for x in TEXTS["MIT"].split("\n")) + f"\n{FILLER}" * 30
    got = scan([grant, f"{FILLER}\n{wrapped}\nint main;\n{FILLER}", long_line, in_text, f"{FILLER}\n" * 50], spark)
    assert [[(m.license, m.line) for m in x] for x in got] == [[("MIT", 1)], [("GPL-3.0", 2)], [("Apache-2.0", 1)], [("MIT", 31)], []]
    assert got[1][0].score == pytest.approx(1)


def test_window_counts_match_brute_force():
    rng = random.Random(5)
    table = licenses.Templates((("t", "f", "a b a c b a"), ("u", "f", "c c b")), 0.8)
    for _ in range(300):
        words = [rng.choice("abc") for _ in range(rng.randint(1, 14))]
        want = {}
        for name, _, n, template in table.runs:
            for i in range(max(1, len(words) - n + 1)):
                units = set(zip(words[i : i + n], words[i + 1 : i + n]))
                if units and 2 * len(units & template) / (len(units) + len(template)) >= 0.8:
                    want[i, name] = 2 * len(units & template) / (len(units) + len(template))
        got = table.windows(words, [])
        assert bool(got) == bool(want) and all(want[i, name] == pytest.approx(score) for i, name, _, score in got)
