"""Lexical retrieval, reranking and selection."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import checkpointed, spread
from . import lexical as L


def bm25(docs: DataFrame, questions: DataFrame, id_col: str, fields: dict[str, tuple[Column, float]], k: int) -> DataFrame:
    """The k best documents of each question (question_id, text): BM25+ over weighted fields, ties by document.

    For documents that are searched once; `lexical.build` keeps what this counts. Tokens are counted where a document is
    read, and those that no question has are dropped before anything is shuffled.
    """
    columns = {name: x for name, (x, _) in fields.items()}
    asked = L.asked_terms(questions)
    pairs = asked.select("asked", F.col("asked").alias("term"), F.lit(1.0).alias("weight")).distinct()
    found = L.counted(spread(docs.select(id_col, *columns.values())), id_col, columns, totals=True)
    wanted = L.small(pairs.select("term", F.lit(True).alias("wanted")))
    kept = checkpointed(found.join(wanted, "term", "left").filter("wanted OR term IS NULL").select("doc", "field", "term", "tf", "len"))  # texts are read once
    totals, long = kept.filter("term IS NULL"), F.col("len") > 0
    stats = totals.agg(F.count_if(F.col("field") == next(iter(columns))).alias("n"), *(F.avg(F.when((F.col("field") == name) & long, F.col("len"))).alias(f"avg_{name}") for name in columns))
    return L.scored(kept.filter("term IS NOT NULL"), stats, {name: w for name, (_, w) in fields.items()}, asked, pairs, k)


#: Points for a term that equals a symbol or message name, stands as a word, in quotes, before a colon, inside a word; for two and
#: three neighbouring terms of PHRASE_TERM characters or more that follow one another; for a glossary entry and each term it defines (fixed values).
EQUAL, WHOLE, QUOTED, KEYED, PART, PAIR, TRIPLE, PHRASE_TERM, GLOSSARY, DEFINED = 5, 4, 5, 4, 1, 12, 20, 3, 25, 5
#: Questions that score one copy of a document's text.
QUESTIONS_AT_ONCE = 500

_WORDS, _IN_QUOTES, _KEYS = re.compile("[a-z0-9_]+"), re.compile("(?<=[\"'])[^\"'\\s]+(?=[\"'])"), re.compile(r"(?<![a-z0-9_])([a-z0-9_]+)\s*:")


class ExactText:
    """What the exact-term rules look up in one document, gathered once for all its questions."""

    def __init__(self, text: str, path: str, names: list[str]) -> None:
        self.low = text.lower()
        self.words, self.quoted, self.keys = set(_WORDS.findall(self.low)), set(_IN_QUOTES.findall(self.low)), set(_KEYS.findall(self.low))
        self.names = {n.lower() for n in names}
        self.glossary = path.lower().startswith("vocabulary://")

    def score(self, terms: list[str]) -> int:
        points, here = 0, []
        for t in filter(None, terms):
            inside = t in self.words or t in self.low
            here.append(inside)
            if t in self.names:
                points += EQUAL
            elif t in self.words:
                points += WHOLE + QUOTED * (t in self.quoted) + KEYED * (t in self.keys)
            elif inside:
                points += PART
        # a phrase needs all of its terms, so most need no search
        long = [(t, ok) for t, ok in zip(filter(None, terms), here, strict=True) if len(t) >= PHRASE_TERM]
        for n, worth in ((2, PAIR), (3, TRIPLE)):
            for k in range(len(long) - n + 1):
                some = long[k : k + n]
                if all(ok for _, ok in some) and " ".join(t for t, _ in some) in self.low:
                    points += worth
        if self.glossary and (defined := sum(t in self.names for t in terms)):
            points += GLOSSARY + DEFINED * defined
        return points


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc, text, path, names, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            known = ExactText(text or "", path or "", [n for n in names or () if n])
            out += [(q["question_id"], doc, float(score)) for q in asked if (score := known.score(q["terms"])) > 0]
        if out:
            q, doc, score = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.float64())], names=["question_id", "doc", "score"])


def exact_scores(candidates: DataFrame, docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(question_id, doc, score > 0) of candidates (question_id, doc) by the exact terms of their questions.

    docs: (doc, text, path, names); terms: (question_id, terms in their order). A document's text meets all its
    questions at once, QUESTIONS_AT_ONCE of them, and is searched for words once. Candidates are read more than once.
    """
    asked = candidates.select("question_id", "doc").join(terms, "question_id")
    place = F.row_number().over(Window.partitionBy("doc").orderBy("question_id"))
    docs = docs.join(L.small(candidates.select("doc").distinct()), "doc", "left_semi")  # texts of no candidate move nowhere
    grouped = asked.withColumn("part", F.floor((place - 1) / QUESTIONS_AT_ONCE)).groupBy("doc", "part").agg(F.collect_list(F.struct("question_id", "terms")).alias("asked"))
    return grouped.join(docs, "doc").select("doc", "text", "path", "names", "asked").mapInArrow(_exact, "question_id bigint, doc bigint, score double")


def diversity(scored: DataFrame, keys: list[str], group: str, score: str = "score", step: float = 30, most: float = 90) -> DataFrame:
    """The n-th row of a group (n >= 3, by score) loses min(step * (n - 2), most)."""
    w = Window.partitionBy(*keys, group).orderBy(F.desc(score), "rank")
    n = F.row_number().over(w)
    return scored.withColumn("_n", n).withColumn(score, F.col(score) - F.when(F.col("_n") >= 3, F.least((F.col("_n") - 2) * step, F.lit(most))).otherwise(0)).drop("_n")


def union_by_priority(lists: list[DataFrame], keys: list[str], item: str, most: int) -> DataFrame:
    """The lists one after the other (each with pos), an item once at its first place, the first `most` of each key."""
    tagged = [d.select(*keys, item, "pos", F.lit(k).alias("prio")) for k, d in enumerate(lists)]
    both = tagged[0]
    for d in tagged[1:]:
        both = both.unionByName(d)
    first = both.groupBy(*keys, item).agg(F.min(F.struct("prio", "pos")).alias("at"))
    w = Window.partitionBy(*keys).orderBy("at.prio", "at.pos", item)
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select(*keys, item, F.col("at.prio").alias("prio"), "rank")


def drop_mirrors(rows: DataFrame, keys: list[str], text: Column, order: list[str]) -> DataFrame:
    """Of rows with the same normalised text the first stays."""
    w = Window.partitionBy(*keys, F.sha2(T.normalize(text), 256)).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def one_per_role(rows: DataFrame, keys: list[str], role: Column, order: list[str]) -> DataFrame:
    """The first row of each role."""
    w = Window.partitionBy(*keys, "role").orderBy(*order)
    return rows.withColumn("role", role).filter("role IS NOT NULL").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def compact(ranked: DataFrame, keys: list[str], item: str, text: Column, most: int, contained: int = 160) -> DataFrame:
    """Items in order of rank, each unless it equals an item chosen before it or one holds the other (both of `contained`
    characters or more, normalised); the first `most`. A fold over the ranked list of a key, which the search has bounded.
    """
    rows = ranked.select(*keys, F.struct("rank", F.col(item).alias("item"), T.normalize(text).alias("text")).alias("x"))
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("x")).alias("xs"))

    def near(a: Column, b: Column) -> Column:
        long = (F.length(a) >= contained) & (F.length(b) >= contained)
        return (a == b) | (long & (a.contains(b) | b.contains(a)))

    chosen = F.aggregate(
        "xs",
        F.slice("xs", 1, 0),
        lambda acc, x: F.when((F.size(acc) < most) & ~F.exists(acc, lambda a: near(a["text"], x["text"])), F.concat(acc, F.array(x))).otherwise(acc),
    )
    return listed.select(*keys, F.posexplode(chosen).alias("_p", "c")).select(*keys, F.col("c.item").alias(item), (F.col("_p") + 1).alias("place"))
