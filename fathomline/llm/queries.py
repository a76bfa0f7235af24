"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html_text, language, licenses, near_dup, packing, pieces, prefix_trie, quality, repair, token_files, url_filter
from .common import new_folder, table

#: (host, path, verdict) of the URL rules (fixed values of the contract).
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


#: Vocabulary files of the tokenizer queries.
PIECE_MODEL = "piece_bpe_32k.model"
BPE_VOCABULARY = "byte_bpe_50k.json"


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_dup.near_duplicates(docs, size=4, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(h, p, h + p, v) for h, p, v in URL_RULES], "host string, path string, rule string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_filter(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_decode(docs, public_tokenizers.path(PIECE_MODEL), keep=["doc_id"])


def op5_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.withColumn("mask", spans)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = language.train(docs.filter(~F.col("held_out")))
    return language.predict(docs, model, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.quality_rules(docs).select(
        "doc_id",
        *(F.col(f"quality.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")),
        F.array_join("quality.failed", ",").alias("failed_rules"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = licenses.scan_licenses(docs, keep=["doc_id"])
    return out.select("doc_id", "n_matches", F.array_join("licenses", ",").alias("licenses"), F.round("best_score", 6).alias("best_score"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = new_folder(spark, "tokens")
    manifest = token_files.write_tokens(docs, folder, public_tokenizers.path(BPE_VOCABULARY))
    return token_files.read_tokens(manifest, folder)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path(BPE_VOCABULARY))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_url_filter": op3_url_filter,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_chat_rotation": op5_chat_rotation,
    "op6_language_id": op6_language_id,
    "op7_quality_rules": op7_quality_rules,
    "op8_license_scan": op8_license_scan,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_files": op10_token_files,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_prefix_trie": op13_prefix_trie,
}
