"""The corpus pipeline: quality rules, language ID, near-dedup, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next stage's docs. All stages but the last return
the columns of documents (doc_id, text, lang, source, n_chars); n_chars follows
the text where a stage changes it, lang the language that stage finds.

Defined cases: null texts and texts without words go in the first stage; rows
without a doc_id are judged like others and never deduplicated; rows that repeat
a doc_id are one document to the near-dedup stage; an empty table, or benchmark, gives an empty
result, or no change; very long texts are read whole in every stage.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import decontaminate, language, near_dup, pieces, quality
from fathomline.llm.common import discard, new_folder, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if no language holds this share of it.
LEAST_SHARE = 0.5
#: Beyond this share of words in benchmark windows the whole document goes; below, only the spans.
DROP_SHARE = 0.5
#: How often spans are cut out of a document; one that holds a window after that goes.
CUTS = 4
PIECE_MODEL = "piece_bpe_32k.model"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the quality rules."""
    return quality.quality_rules(docs, out="_quality").filter("_quality.kept").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mainly in one of the learned languages, with that language as their lang.

    The model that judges a document is learned from the other half of the stage's input (by a hash of doc_id); from
    all of it where the other half has no labels. Labels that the text contradicts are thus corrected and missing ones filled in.
    """
    half = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)), F.lit(0))
    judged = None
    for k in (0, 1):
        model = language.train(docs.filter(half != k))
        if not model.langs:
            model = language.train(docs)
        found = language.predict(docs.filter(half == k), model, keep=COLUMNS)
        judged = found if judged is None else judged.union(found)
    kept = judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8) and those without an id.

    Rows that share a doc_id count as one document and stay or go together.
    """
    found = near_dup.near_duplicates(docs, size=5, percent=80)
    return found.filter(F.col("kept") | F.col("doc_id").isNull()).select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes benchmark spans; a document that mostly consists of them, or is left without a word, goes.

    A cut brings words together, so what was cut is looked up again, and no document that is kept holds a window.
    """
    items = table(spark, sf_dir, "benchmark")
    clean, rest = [], docs
    for _ in range(CUTS + 1):
        found = decontaminate.decontaminate(rest, items)
        clean.append(found.filter(~F.col("contaminated")).select(*COLUMNS))
        share = F.try_divide(F.col("n_hit"), F.col("n_words"))
        cut = found.filter(F.col("contaminated") & (share <= DROP_SHARE)).withColumn("text", decontaminate.remove_spans(F.col("text"), F.col("hit_spans")))
        rest = written(cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS), "cut")
        if not rest.limit(1).count():
            break
    return reduce(DataFrame.union, clean)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids and the text decoded from the ids."""
    return pieces.encode_decode(docs, public_tokenizers.path(PIECE_MODEL), keep=["doc_id"])


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("MinHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("SentencePiece encoding and decoding", sentencepiece_stage),
]

#: The language, near-dedup and SentencePiece stages are beyond SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written to the shared folder and reread."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = new_folder(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # the stage before is read no more
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
