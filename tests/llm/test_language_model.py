"""Language ID against a plain expectation maximisation, long texts, many scripts."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from fathomline.llm import language

#: Invented words, many languages and scripts.
SOUNDS = {
    "aa": ["ka", "to", "mi", "ra"],
    "bb": ["sch", "ung", "ei", "ver"],
    "el": ["και", "το", "νο", "λα"],
    "ru": ["ко", "ли", "ня", "ста"],
    "uk": ["їв", "ко", "ґа", "сті"],
    "he": ["של", "הא", "מי", "נו"],
    "zh": ["的一", "是不", "了人", "我在"],
    "ja": ["のは", "をた", "がで", "てと"],
}


def say(rng, lang, words):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(i, lang, say(rng, lang, 60)) for i, lang in enumerate(SOUNDS) for _ in range(1)]
    rows = [(k * 100 + i, lang, say(rng, lang, 60)) for k in range(20) for i, lang, _ in rows]
    return language.train(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"))


def plain_logs(model, word):
    """log-likelihood of a word by language, from the counts."""
    k = len(model.langs)
    table = []
    for grams, counts in zip(model.grams, model.counts):
        rows = np.frombuffer(counts, np.float32).reshape(-1, k)
        table.append({int(g): rows[i].astype(float) for i, g in enumerate(np.frombuffer(grams, np.int64))})
    zero = np.zeros(k)
    total = sum(table[0].values()) + 0.5 * (len(table[0]) + 1)
    letters, out = [0, 0, *map(ord, word), 0], zero.copy()
    for i in range(2, len(letters)):
        p2, p1, c = (letters[i - 2] if i > 2 else 0), letters[i - 1], letters[i]
        one = (table[0].get(c, zero) + 0.5) / total
        first = table[0].get(p1, zero)
        two = (table[1].get(p1 << 21 | c, zero) + language.SMOOTHING * one) / (first + language.SMOOTHING)
        pair = table[1].get(p2 << 21 | p1, zero) if p1 else first
        three = table[2].get(p2 << 42 | p1 << 21 | c, zero)
        out += np.log(np.minimum((three + language.SMOOTHING * two) / (np.maximum(pair, three) + language.SMOOTHING), 1))
    return out


def plain(model, text):
    """Shares by the definition, one word after the other."""
    words = [plain_logs(model, w) for w in "".join(c if c.isalpha() else " " for c in text.lower()).split()]
    k = len(model.langs)
    if not words:
        return [0.0] * k
    words = [w - w.max() for w in words]
    like = [np.exp(w) for w in words]

    def mix(shares):
        for _ in range(language.ROUNDS):
            joint = [x * shares for x in like]
            shares = sum(j / max(j.sum(), language.LEAST) for j in joint) / len(like)
        return shares, sum(math.log(max((x * shares).sum(), language.LEAST)) for x in like)

    single = sum(np.maximum(w, math.log(language.LEAST)) for w in words)
    shares, fit = mix(np.full(k, 1 / k))
    chosen, reached, price = np.eye(k)[single.argmax()], single.max(), language.PENALTY + math.log(len(words))
    if fit - reached > price:
        for n in range(2, k + 1):
            start = np.zeros(k)
            start[np.argsort(-shares, kind="stable")[:n]] = 1 / n
            sub, fit = mix(start)
            if fit - reached <= price:
                break
            chosen, reached = sub, fit
    return list(chosen)


def texts():
    rng = random.Random(5)
    out = [say(rng, lang, n) for lang in SOUNDS for n in (1, 3, 40)]
    out += [say(rng, "aa", 40) + "\n" + say(rng, "ru", 60), say(rng, "zh", 30) + "! " + say(rng, "he", 10) + " " + say(rng, "el", 50)]
    return out + ["", "123 !?", "unseen wörds öf nö language", "ⲁⲃⲅ ⲇⲉ", "x" * 500, "İstanbul áb"]


def test_shares_equal_plain_expectation_maximisation(model):
    for text, (_, _, shares) in zip(texts(), language.identify(model, texts())):
        assert np.allclose(shares, plain(model, text), atol=2e-3), text


@pytest.mark.parametrize("piece,held", [(40, 1 << 20), (40, 240), (1 << 18, 1 << 22)])
def test_blocks_of_a_long_text_change_nothing(model, piece, held):
    for text in texts():
        if " " in text and len(text) > 100:
            a, b = language.identify(model, [text])[0], language.identify_long(model, text, piece, held)
            assert a[0] == b[0] and np.allclose(a[2], b[2], atol=2e-3)


def test_every_script_and_mixture_is_found(spark, model):
    rng = random.Random(9)
    rows = [(lang, say(rng, lang, 30)) for lang in SOUNDS for _ in range(10)]
    out = language.predict(spark.createDataFrame(rows, "lang string, text string"), model).collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.95 * len(rows)
    mixed = say(rng, "el", 30) + " " + say(rng, "bb", 70)
    (found,) = language.identify(model, [mixed])
    assert found[0] == "bb" and abs(found[1] - 0.7) < 0.1


def test_a_very_long_text_is_read_whole(spark, model):
    rng = random.Random(4)
    text = say(rng, "aa", 1000) + " " + say(rng, "ru", 150_000)
    (row,) = language.predict(spark.createDataFrame([(1, text)], "doc_id int, text string"), model).collect()
    assert row.lang_pred == "ru" and row.score > 0.95


def test_training_reads_whole_texts(spark):
    rng = random.Random(6)
    late = " " * 30_000 + say(rng, "he", 50)
    model = language.train(spark.createDataFrame([(1, "he", late), (2, "aa", say(rng, "aa", 50))], "doc_id int, lang string, text string"))
    assert language.identify(model, [say(rng, "he", 20)])[0][0] == "he"


def test_hash_table_of_places():
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 1 << 62, 5000))
    places = language.Places(values)
    assert (places.of(values) == np.arange(len(values))).all()
    assert (places.of(values + 1)[~np.isin(values + 1, values)] == -1).all()
    assert (language.Places(np.zeros(0, np.int64)).of(np.arange(3)) == -1).all()
