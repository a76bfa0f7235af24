"""Language identification as multilingual mixture inference.

Training: letter n-grams (one to three letters, with word borders) are counted
with Spark over a bounded sample of labelled documents, `SAMPLE_DOCS` a language by
expectation, chosen by a hash of their id against a threshold from the
language's count; their texts are read whole. Any letter of any script counts.
The model keeps each language's most frequent n-grams of every order, as many
as `CELLS` numbers over all languages allow and `GRAMS` at most, so its size is
bounded; other trigrams are estimated from bigrams and those from letters.

Inference: every word of a text has a likelihood under each language. The
document is a mixture of languages; expectation maximisation estimates their
proportions over all its words. Languages are added in order of proportion as
long as each gains more log-likelihood than the penalty `PENALTY + ln(words)`.
The prediction is the language with the largest share of the chosen set, the
score that share.

Inference is a map over whole texts in pieces of bounded size: no shuffle. A
text longer than a piece is worked on block by block, and if its words'
likelihoods are too many to keep, each round computes them again.

Defined cases: null text or text without a letter is `und` with score 0; ties
go to the language first in sorted order; if nothing could be learned every
text is `und`; more than `MAX_LANGUAGES` labels are refused; repeated rows are
treated alike; an empty table gives an empty table. Result columns replace
columns of the same name, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import FORGET, slices

#: Labelled documents of one language that are read for training (expected number).
SAMPLE_DOCS = 400
#: More labels than this are refused; the model goes to every task.
MAX_LANGUAGES = 256
#: N-grams of one order and language in the model, and numbers in a table of the model.
GRAMS = 20_000
CELLS = 16 << 20
SMOOTHING = 2.0
PENALTY = 6.0
ROUNDS = 12
LEAST = 1e-30
#: Code points worked on at once, and likelihoods (code points or words by languages) held at once.
PIECE = 1 << 18
HELD = 1 << 22


class Model(NamedTuple):
    """Languages, and for orders 1 to 3 the n-grams (int64) and their counts by language (float32) as bytes."""

    langs: tuple[str, ...]
    grams: tuple[bytes, ...] = ()
    counts: tuple[bytes, ...] = ()


NOTHING = Model(())


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, 0 where it isn't a letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(letters()[code], code, 0)


def _grams(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(two before, one before, letter) for each letter and each word end, and the positions of these in the code."""
    padded = np.concatenate((np.zeros(2, np.int64), code, np.zeros(1, np.int64)))
    c, p1, p2 = padded[2:], padded[1:-1], padded[:-2]
    at = np.flatnonzero((c != 0) | (p1 != 0))
    c, p1 = c[at], p1[at]
    return np.where(p1 != 0, p2[at], 0), p1, c, at


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, size, gram, n) of (lang, text) batches."""
    for batch in slices(batches, 1):
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            p2, p1, c, _ = _grams(_codes("\n".join(texts)))
            for size, gram in enumerate((c, p1 << 21 | c, p2 << 42 | p1 << 21 | c), 1):
                values, n = np.unique(gram, return_counts=True)
                if len(values):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(values)), pa.array(np.full(len(values), size, np.int32)), pa.array(values), pa.array(n.astype(np.int64))],
                        names=["lang", "size", "gram", "n"],
                    )


def train(docs: DataFrame, lang: str = "lang", text: str = "text", id_col: str = "doc_id") -> Model:
    """The model of the labelled documents given; null labels and texts are skipped."""
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(id_col).isNotNull() & F.col(text).isNotNull())
    sizes = labelled.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n"))
    k = sizes.limit(MAX_LANGUAGES + 1).count()
    if k > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    if k == 0:
        return NOTHING
    place = F.xxhash64(id_col) / F.lit(2.0**64) + 0.5  # even over 0 to 1
    sample = (
        labelled.select(place.alias("place"), F.col(lang).alias("lang"), F.col(text).alias("text"))
        .join(F.broadcast(sizes), "lang")
        .filter(F.col("place") < SAMPLE_DOCS / F.col("n"))
        .select("lang", "text")
    )
    counted = sample.mapInArrow(count_grams, "lang string, size int, gram bigint, n bigint").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "gram")
    limit = max(1, min(GRAMS, CELLS // k**2))
    rows = counted.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= limit).drop("rank").toPandas()
    if not len(rows):
        return NOTHING
    langs = tuple(sorted(set(rows["lang"])))
    grams, counts = [], []
    for size in (1, 2, 3):
        some = rows[rows["size"] == size]
        values = np.unique(some["gram"].to_numpy(np.int64))
        table = np.zeros((len(values), len(langs)), np.float32)
        table[np.searchsorted(values, some["gram"].to_numpy(np.int64)), np.searchsorted(langs, some["lang"].to_numpy(str))] = some["n"].to_numpy()
        grams.append(values.tobytes())
        counts.append(table.tobytes())
    return Model(langs, tuple(grams), tuple(counts))


class Places:
    """Rows of n-grams by a hash table of two tries; the few that collide twice are searched."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.shift = np.uint64(64 - max(4, int(len(values) * 4).bit_length()))
        self.tables = []
        rest = np.arange(len(values), dtype=np.int32)
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            slots = self._slot(values[rest], factor)
            table = np.full(1 << int(64 - self.shift), -1, np.int32)
            table[slots] = rest
            self.tables.append((factor, table))
            rest = rest[table[slots] != rest]
        self.rest = rest
        self.rest_values = values[rest]

    def _slot(self, values: np.ndarray, factor: int) -> np.ndarray:
        return (values.astype(np.uint64) * np.uint64(factor)) >> self.shift

    def of(self, values: np.ndarray) -> np.ndarray:
        """The row of each value, -1 if it has none."""
        if not len(self.values):
            return np.full(len(values), -1, np.int32)
        out = self.tables[0][1][self._slot(values, self.tables[0][0])]
        miss = np.flatnonzero((out < 0) | (self.values[out] != values))
        again = self.tables[1][1][self._slot(values[miss], self.tables[1][0])]
        again = np.where((again >= 0) & (self.values[again] == values[miss]), again, -1)
        if len(self.rest):
            k = np.minimum(np.searchsorted(self.rest_values, values[miss]), len(self.rest) - 1)
            again = np.where(self.rest_values[k] == values[miss], self.rest[k], again)
        out[miss] = again
        return out


class Tables:
    """log P(letter | two before) of a model by language."""

    def __init__(self, model: Model) -> None:
        k = len(model.langs)
        grams = [np.frombuffer(g, np.int64) for g in model.grams]
        counts = [np.frombuffer(c, np.float32).reshape(-1, k) for c in model.counts]
        self.places = [Places(g) for g in grams]
        self.one_counts, self.two_counts = counts[0], counts[1]
        self.total = counts[0].sum(axis=0) + 0.5 * (len(grams[0]) + 1)
        tri = grams[2]
        self.seen = self._three(tri >> 42, tri >> 21 & 0x1FFFFF, tri & 0x1FFFFF, counts[2])

    def _counts(self, table: np.ndarray, size: int, values: np.ndarray) -> np.ndarray:
        row = self.places[size - 1].of(values)
        return np.where((row >= 0)[:, None], table[row], np.float32(0)) if len(table) else np.zeros((len(values), len(self.total)), np.float32)

    def _three(self, p2: np.ndarray, p1: np.ndarray, c: np.ndarray, three: np.ndarray | float) -> np.ndarray:
        """log P of the trigrams with the given counts."""
        one = (self._counts(self.one_counts, 1, c) + 0.5) / self.total
        first = self._counts(self.one_counts, 1, p1)  # of the border: words
        two = (self._counts(self.two_counts, 2, p1 << 21 | c) + SMOOTHING * one) / (first + SMOOTHING)
        pair = np.where((p1 != 0)[:, None], self._counts(self.two_counts, 2, p2 << 21 | p1), first)
        # truncated counts may not add up
        return np.log(np.minimum((three + SMOOTHING * two) / (np.maximum(pair, three) + SMOOTHING), 1.0)).astype(np.float32)

    def logs(self, p2: np.ndarray, p1: np.ndarray, c: np.ndarray) -> np.ndarray:
        row = self.places[2].of(p2 << 42 | p1 << 21 | c)
        out = self.seen[row] if len(self.seen) else np.zeros((len(c), len(self.total)), np.float32)
        new = np.flatnonzero(row < 0)
        if len(new):
            out[new] = self._three(p2[new], p1[new], c[new], 0.0)
        return out


@lru_cache(maxsize=2)
def tables(model: Model) -> Tables:
    return Tables(model)


FORGET.append(tables.cache_clear)


def _mix(likelihood: np.ndarray, starts: np.ndarray, sizes: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares after expectation maximisation and the log-likelihood of each document."""
    for _ in range(ROUNDS):
        joint = likelihood * np.repeat(shares, sizes, axis=0)
        joint /= np.maximum(joint.sum(axis=1, keepdims=True), LEAST)
        shares = np.add.reduceat(joint, starts, axis=0) / sizes[:, None]
    fit = np.log(np.maximum((likelihood * np.repeat(shares, sizes, axis=0)).sum(axis=1), LEAST))
    return shares, np.add.reduceat(fit, starts)


def _words(model: Model, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods of all words by language, the best language's being 0, and the number of words of each text."""
    bounds = np.concatenate(([0], np.cumsum([len(c) for c in codes])))
    p2, p1, c, at = _grams(np.concatenate(codes) if codes else np.zeros(0, np.int64))
    begins = np.flatnonzero(p1 == 0)
    if not len(begins):
        return np.zeros((0, len(model.langs)), np.float32), np.zeros(len(codes), np.int64)
    words = np.add.reduceat(tables(model).logs(p2, p1, c), begins, axis=0)
    words -= words.max(axis=1, keepdims=True)
    return words, np.diff(np.searchsorted(at[begins], bounds))


Found = tuple[str, float, list[float]]  # language, score, shares


def _named(model: Model, shares: np.ndarray) -> Found:
    top = int(shares.argmax())
    return model.langs[top], float(min(1.0, shares[top])), shares.tolist()


def _nothing(model: Model) -> Found:
    return "und", 0.0, [0.0] * len(model.langs)


def identify(model: Model, texts: list[str]) -> list[Found]:
    """(language, score, shares) of each text; all likelihoods are held at once."""
    k = len(model.langs)
    out = [_nothing(model)] * len(texts)
    words, counts = _words(model, [_codes(t + " ") for t in texts]) if k else (np.zeros((0, 0)), np.zeros(0, np.int64))
    docs = np.flatnonzero(counts)
    if not len(docs):
        return out
    sizes = counts[docs]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    likelihood = np.exp(words)
    single = np.add.reduceat(np.maximum(words, np.float32(np.log(LEAST))), starts, axis=0)
    best = single.argmax(axis=1)
    shares, fit = _mix(likelihood, starts, sizes, np.full((len(docs), k), 1 / k, np.float32))
    chosen = np.zeros((len(docs), k), np.float32)
    chosen[np.arange(len(docs)), best] = 1
    price = PENALTY + np.log(sizes)
    open_ = np.flatnonzero(fit - single.max(axis=1) > price)
    reached = single.max(axis=1)
    order = np.argsort(-shares, axis=1, kind="stable")
    for n in range(2, k + 1):  # sets of n languages, for documents where n - 1 gained enough
        if not len(open_):
            break
        mask = np.zeros((len(open_), k), np.float32)
        np.put_along_axis(mask, order[open_, :n], 1, axis=1)
        pick = np.concatenate([np.arange(starts[d], starts[d] + sizes[d]) for d in open_])
        sub_starts = np.concatenate(([0], np.cumsum(sizes[open_])[:-1]))
        sub, sub_fit = _mix(likelihood[pick], sub_starts, sizes[open_], mask / n)
        better = sub_fit - reached[open_] > price[open_]
        chosen[open_[better]], reached[open_[better]] = sub[better], sub_fit[better]
        open_ = open_[better]
    for row, d in enumerate(docs):
        out[d] = _named(model, chosen[row])
    return out


def identify_long(model: Model, text: str, piece: int = PIECE, held: int = HELD) -> Found:
    """As identify, for one text in blocks of at most `piece` code points; a word longer than a block is cut."""
    k = len(model.langs)
    if not k:
        return _nothing(model)
    piece = max(1, min(piece, held // k))
    blocks, at = [], 0
    while at < len(text):
        end = min(at + piece, len(text))
        cut = end
        while cut > at and end < len(text) and text[cut - 1].isalpha():
            cut -= 1
        blocks.append((at, cut if cut > at else end))
        at = blocks[-1][1]
    kept: list[np.ndarray] | None = []

    def words() -> Iterator[np.ndarray]:
        for i, (a, b) in enumerate(blocks):
            yield kept[i] if kept is not None and i < len(kept) else _words(model, [_codes(text[a:b] + " ")])[0]

    single, n = np.zeros(k), 0
    for w in words():
        single += np.maximum(w, np.log(LEAST)).sum(axis=0)
        n += len(w)
        if kept is not None:
            kept.append(w)
            if n * k > held:
                kept = None
    if not n:
        return _nothing(model)

    def mix(shares: np.ndarray) -> tuple[np.ndarray, float]:
        for _ in range(ROUNDS):
            total = np.zeros(k)
            for w in words():
                joint = np.exp(w) * shares
                total += (joint / np.maximum(joint.sum(axis=1, keepdims=True), LEAST)).sum(axis=0)
            shares = total / n
        return shares, sum(float(np.log(np.maximum((np.exp(w) * shares).sum(axis=1), LEAST)).sum()) for w in words())

    shares, fit = mix(np.full(k, 1 / k))
    reached, price = single.max(), PENALTY + np.log(n)
    chosen = np.zeros(k)
    chosen[single.argmax()] = 1
    order = np.argsort(-shares, kind="stable")
    if fit - reached > price:
        for size in range(2, k + 1):
            mask = np.zeros(k)
            mask[order[:size]] = 1
            sub, fit = mix(mask / size)
            if fit - reached <= price:
                break
            chosen, reached = sub, fit
    return _named(model, chosen)


def _predict(model: Model, place: int, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, place):
        texts = [t or "" for t in batch.column(place).to_pylist()]
        found: list[Found] = []
        piece = min(PIECE, HELD // max(1, len(model.langs)))
        at = 0
        while at < len(texts):
            upto, n = at, 0
            while upto < len(texts) and (upto == at or n + len(texts[upto]) <= piece):
                n += len(texts[upto])
                upto += 1
            found.extend(identify(model, texts[at:upto]) if n <= piece else [identify_long(model, texts[at])])
            at = upto
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(n) for n in names),
                pa.array([x[0] for x in found], pa.string()),
                pa.array([x[1] for x in found], pa.float64()),
                pa.array([[float(s) for s in x[2]] for x in found], pa.list_(pa.float64())),
            ],
            names=[*names, "lang_pred", "score", "shares"],
        )


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with lang_pred, score and shares (by sorted language)."""
    names = [c for c in keep or docs.columns if c not in ("lang_pred", "score", "shares")]
    read = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(names)), F.col(text).alias("_text"))
    inner = [f"c{k}" for k in range(len(names))]
    fields = [f"{n} {read.schema[n].dataType.simpleString()}" for n in inner]
    out = read.mapInArrow(
        partial(_predict, model, len(names), inner), ", ".join([*fields, "lang_pred string", "score double", "shares array<double>"])
    )
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)), "lang_pred", "score", "shares")
