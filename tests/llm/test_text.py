from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fathomline.llm import html_text, language, licenses, pieces, queries, token_files
from fathomline.llm.common import new_folder, table

SF = "/root/testdata/sf0.01"
BPE = public_tokenizers.path(queries.BPE_VOCABULARY)
MODEL = public_tokenizers.path(queries.PIECE_MODEL)
MIXED = st.text(alphabet=st.sampled_from(list("abcdeinorst  ▁\n\t.,!'\"()012é漢😀\x00\x1c\u00a0<s>%")), max_size=60)


# HTML

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site no</h1></header><nav><ul><li><a href="/a">no menu</a></li></ul></nav><!-- no --><div class="ad">Buy no.</div>
<article><h1>Head&amp;line</h1><p>First <b>bo</b>ld&nbsp;text<br>line.<p>Short.</p><aside>no aside</aside>
<div class="newsletter">no letter</div><form>no form<input></form><p>Last &lt;one&gt; &eacute;&#33;</p>
<section id="comments"><p>no comment, although it is a rather long one and looks like text.</p></section></article>
<div class="sidebar">no side</div><footer>&copy; no</footer>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE) == "Head&line First bold text line. Short. Last <one> é!"


def test_main_text_without_article_element():
    body = "<div id=menu><a href=x>Home</a> | <a href=y>News</a></div><div class='content has-sidebar'><h2>Title</h2>" + "".join(
        f"<p>Paragraph number {i} goes on for a while, so that it weighs more than a menu does.</p>" for i in range(4)
    ) + "<p>Tiny.</p></div><div class=footer>About us</div>"
    text = html_text.main_text(f"<html><body>{body}</body></html>")
    assert text.startswith("Title Paragraph number 0") and text.endswith("does. Tiny.") and "Home" not in text and "About" not in text


def test_a_block_ends_an_open_paragraph():
    page = "<article><h1>Top</h1><p class=ad>no<p>One<p class='notice'><span class=x>no<div>Two</div><ul><li class=ad>no<li>Three</ul></article>"
    assert html_text.main_text(page) == "Top One Two Three"


@pytest.mark.parametrize("html", [None, "", "<", "<p", "<a b='", "</p></div>", "<script>x", "<!-- x", "&#xD800; &bogus; &#0;", "<div class=ad>x", "a<b" * 5000, "<div>" * 20000 + "deep"])
def test_main_text_never_fails(html):
    assert isinstance(html_text.main_text(html), str)


def test_extraction_on_tables(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (2, None, None, "y")], "page_id int, url string, html string, text string")
    out = html_text.extract_text(pages)
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert sorted((r.page_id, r.n_chars) for r in out.collect()) == [(1, 52), (2, 0), (2, 0)]
    assert html_text.extract_text(pages.limit(0)).collect() == []


# token files


@settings(max_examples=150, deadline=None)
@given(st.lists(MIXED, max_size=4))
@example(["a  b", " x", "x ", "a \n b", "\n", "a\n\nb", "it's, l'eau\n't", "x<|endoftext|> y"])
def test_chunk_encoder_equals_the_library(texts):
    codec = token_files.encoder(BPE)
    want = [np.array(e.ids, codec.kind).tobytes() for e in codec.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert codec.encode(texts) == want


def test_token_files_round_trip(spark):
    docs = [(i, t) for i, t in enumerate(["one two", None, "", "x" * 30_000, "a b " * 20_000, "same", "same"])] + [(6, "same")]
    random.Random(0).shuffle(docs)
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, shard int")
    folder = new_folder(spark, "tokens")
    manifest = token_files.write_tokens(frame, folder, BPE, length=64, shards=3)
    got = sorted(token_files.read_tokens(manifest, folder).collect(), key=lambda r: r.start)
    plain, at = Tokenizer.from_file(BPE), 0
    for (doc, text), row in zip(sorted(docs, key=lambda x: (x[0], x[1] or "")), got, strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        assert tuple(row) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    for m in manifest.collect():
        reader = token_files.ShardReader(folder, m.shard, m.attempt)
        masks = [reader.mask(n) for n in range(m.n_rows)]
        assert all(not x.flags.owndata and not x.flags.writeable for n in range(m.n_rows) for x in reader.sequence(n))
        assert sum(x.sum() for x in masks) == m.n_ids and all(x.all() for x in masks[:-1]) and all(len(x) == 64 for x in masks)


def test_repeated_and_missing_ids_are_spread_over_shards(spark):
    docs = [(7, f"text {i % 50}") for i in range(300)] + [(None, f"none {i}") for i in range(60)] + [(8, "last")]
    folder = new_folder(spark, "tokens")
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    manifest = token_files.write_tokens(frame, folder, BPE, length=64, shards=4)
    assert manifest.count() == 4 and manifest.agg({"n_docs": "max"}).head()[0] < 250
    got = sorted(token_files.read_tokens(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 60 + [7] * 300 + [8]
    assert [r.start for r in got] == list(np.cumsum([0, *(r.n_tokens for r in got)])[:-1])
    plain = Tokenizer.from_file(BPE)
    sums = sorted(zlib.crc32(np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for _, t in docs)
    assert sorted(r.ids_crc32 for r in got) == sums


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id bigint, text string")
    manifest = token_files.write_tokens(docs, folder, BPE, length=8, shards=1)
    (tmp_path / "ids-0-999.arrow").write_bytes(b"half")
    (tmp_path / "docs-0-999.arrow").write_bytes(b"half")
    assert token_files.read_tokens(manifest, folder).count() == 2


def test_token_files_of_an_empty_table(spark):
    folder = new_folder(spark, "tokens")
    manifest = token_files.write_tokens(spark.createDataFrame([], "doc_id bigint, text string"), folder, BPE)
    assert token_files.read_tokens(manifest, folder).collect() == []


# SentencePiece

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=300, deadline=None)
@given(MIXED)
@example(" " * 9)
@example("a" * 300)
@example("naïve  café\n\nthe end ")
def test_transducer_equals_the_library(text):
    machine = pieces.machine(MODEL)
    ids = np.frombuffer(machine.encode(text), "<i4").tolist()
    assert ids == LIBRARY.encode(text)
    assert machine.decode(ids) == LIBRARY.decode(ids)


def test_unigram_path_is_the_cheapest():
    machine = object.__new__(pieces.Transducer)
    machine.bpe, machine.scores = False, [-1.0, -1.0, -1.5, -4.0]
    machine.lexicon = {"a": 0, "b": 1, "ab": 2, "aba": 3}
    machine.trie = {"a": {"": "a", "b": {"": "ab", "a": {"": "aba"}}}, "b": {"": "b"}}
    assert machine.path("aba") == ["ab", "a"] and machine.path("bx") == ["b", "x"]


def test_pieces_on_tables(spark):
    docs = spark.createDataFrame([(1, "Hello  world\n", 5), (2, None, 6), (3, "", 7), (3, "", 7), (4, "long " * 40_000, 8)], "doc_id int, text string, ids int")
    out = pieces.decode(pieces.encode(docs, MODEL), MODEL)
    assert out.columns == ["doc_id", "text", "ids", "n_ids", "decoded"]
    for r in out.collect():
        assert r.decoded == (r.text or "") and r.ids == LIBRARY.encode(r.text or "") and r.n_ids == len(r.ids)
    assert pieces.encode(docs.limit(0), MODEL).collect() == []


# language


def test_held_out_accuracy(spark):
    out = queries.op6_language_id(spark, SF)
    truth = table(spark, SF, "documents").select("doc_id", "lang")
    rows = out.join(truth, "doc_id").filter("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixtures_and_odd_texts(spark):
    docs = table(spark, SF, "documents")
    model = language.train(docs)
    text = {lang: " ".join(r.text for r in docs.filter(f"lang = '{lang}'").orderBy("doc_id").limit(20).collect())[:4000] for lang in ("en", "de")}
    rows = [("mixed", text["en"] + " " + text["de"], 1), ("en", text["en"], 1), ("null", None, 1), ("empty", "", 1), ("digits", "12 34 !?", 1), ("other", "漢字 かな", 1), ("long", "İß" * 100_000, 1)]
    out = {r.k: r for r in language.predict(spark.createDataFrame(rows, "k string, text string, score int"), model).collect()}
    assert 0.3 < out["mixed"].score < 0.7 and sum(s > 0.2 for s in out["mixed"].shares) == 2
    assert out["en"].lang_pred == "en" and out["en"].score > 0.9
    assert [out[k].lang_pred for k in ("null", "empty", "digits")] == ["und"] * 3
    assert out["other"].lang_pred in model[0] and out["long"].lang_pred in model[0]


def test_language_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id int, text string, lang string")
    model = language.train(empty)
    assert language.predict(empty, model).collect() == []
    (row,) = language.predict(spark.createDataFrame([(1, "text")], "doc_id int, text string"), model).collect()
    assert (row.lang_pred, row.score) == ("und", 0.0)


# licences


def brute_licenses(text):
    units = lambda t: (lambda w: set(zip(w, w[1:])) if len(w) > 1 else set(w))(licenses.WORD.findall(t.lower()))
    lines = (text or "").split("\n")
    found = []
    for k, part in [*enumerate(lines, 1), *([(0, text)] if len(lines) > 1 else [])]:
        a = units(part)
        scores = [(-2 * len(a & units(t)) / (len(a) + len(units(t))), name) for name, _, t in licenses.TEMPLATES] if a else []
        if scores and -min(scores)[0] >= licenses.THRESHOLD:
            found.append((min(scores)[1], -min(scores)[0], k))
    return found


def test_licenses_match_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "\n", "x", "All rights reserved.", "text\nLicensed under the apache license, version 2.0!\nmore", "mit\n" * 3000]
    for _ in range(150):
        _, _, t = rng.choice(licenses.TEMPLATES)
        words = t.split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["x", "License", ""])
        texts.append("\n".join(rng.sample(["some other line", " ".join(words), "All rights reserved."], rng.randint(1, 3))))
    frame = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id int, text string, matches int")
    for r in licenses.scan_licenses(frame).collect():
        assert [(m.license, pytest.approx(m.score), m.line) for m in r.matches] == brute_licenses(texts[r.doc_id])
    assert licenses.scan_licenses(frame.limit(0)).collect() == []
