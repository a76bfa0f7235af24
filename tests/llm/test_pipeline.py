from __future__ import annotations

import re

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from fathomline.llm import quality
from fathomline.llm.common import table

from .test_native import brute_hits, brute_quality
from .test_near_dup import brute

SF = "/root/testdata/sf0.001"
PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def brute_cut(text, items):
    """The text without benchmark windows, cut again until none is left; None if it goes."""
    for _ in range(corpus_pipeline.CUTS + 1):
        n, hit, _ = brute_hits(text, items)
        if not hit:
            return text
        if len(hit) / n > corpus_pipeline.DROP_SHARE:
            return None
        words = list(re.finditer(PIECE, text))
        inside = set(hit)
        out, at = "", 0
        for k, w in enumerate(words, 1):
            if k in inside:
                if k - 1 not in inside:
                    out += text[at : w.start()]
                at = w.end()
        text = out + text[at:]
    return None


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables with odd rows: nulls, repeats, wrong and missing labels, passages that meet only after a cut."""
    place = tmp_path_factory.mktemp("tables")
    docs = table(spark, SF, "documents")
    good = docs.join(table(spark, SF, "labels").filter("quality = 1"), "doc_id", "left_semi").orderBy("doc_id")
    good = quality.quality_rules(docs).filter("quality.kept").select(docs.columns).orderBy("doc_id").limit(6).collect()
    passage = table(spark, SF, "benchmark").filter(F.size(F.split("text", " ")) >= 10).orderBy("item_id").head().text
    words = passage.split(" ")
    nested = " ".join([*words[:5], passage, *words[5:]])  # a cut brings the passage together again
    body = lambda r: r.text if len(r.text.split()) > 200 else r.text + " " + r.text[::-1]
    odd = [
        (10_001, None, "en", "s", 0), (10_002, "", "en", "s", 0), (None, body(good[0]) + " none", good[0].lang, "s", 1), (10_003, None, None, None, None),
        (10_004, body(good[1]) + " wrong label", "de" if good[1].lang != "de" else "fr", "s", 1), (10_005, good[2].text + " no label", None, "s", 1),
        (10_006, " ".join(good[3].text.split()[::-1]) + " " + nested, good[3].lang, "s", 1), (10_007, passage * 9, "en", "s", 1), tuple(good[4]), tuple(good[4]),
    ]
    docs.union(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{place}/documents.parquet")
    table(spark, SF, "benchmark").write.parquet(f"{place}/benchmark.parquet")
    return str(place)


def test_stages_match_brute_force(spark, folder):
    items = [(r.item_id, r.text) for r in table(spark, folder, "benchmark").collect()]
    docs = table(spark, folder, "documents")
    columns, library = docs.columns, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.PIECE_MODEL))
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, folder).cache()
        after = docs.collect()
        if "quality" in name:
            kept = {r.doc_id for r in after}
            for r in before:
                n, *_, repeated = brute_quality(r.text)
                if n < 50 or 2 * repeated > n:
                    assert r.doc_id not in kept
            assert {10_004, 10_005, 10_006} <= kept and not {10_001, 10_002, 10_003} & kept
        elif "language" in name:
            assert len(after) >= 0.98 * len(before)
            truth = {r.doc_id: r.lang for r in before}
            assert sum(truth[r.doc_id] == r.lang for r in after) >= 0.98 * (len(after) - 2)
            found = {r.doc_id: r.lang for r in after}
            assert found[10_005] is not None and found[10_004] != truth[10_004]
        elif "near-dedup" in name:
            want = brute([(r.doc_id, r.text) for r in before if r.doc_id is not None], 5, 80)
            assert {r.doc_id for r in after} == {i for i, (_, c) in want.items() if i == c} | {r.doc_id for r in before if r.doc_id is None}
        elif "decontamination" in name:
            want = {r.doc_id: brute_cut(r.text, items) for r in before}
            assert {r.doc_id: r.text for r in after} == {i: t for i, t in want.items() if t is not None}
            assert not any(brute_hits(r.text, items)[1] for r in after)
            assert any(want[r.doc_id] != r.text for r in before if r.doc_id == 10_006)
            untouched = {r.doc_id for r in before if want[r.doc_id] == r.text}
            assert all(r.n_chars == len(r.text) for r in after if r.doc_id not in untouched)
        else:
            texts = {r.doc_id: r.text for r in before}
            assert len(after) == len(before)
            assert all(r.ids == library.encode(texts[r.doc_id]) and r.decoded == texts[r.doc_id] for r in after)
            continue
        assert docs.columns == columns


def test_run_equals_the_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    docs = table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
    key = lambda r: (r.doc_id is None, r.doc_id, r.decoded)
    assert sorted(map(key, rows)) == sorted(map(key, docs.collect()))


def test_stages_on_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []
