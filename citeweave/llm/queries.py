"""The registered queries of this subpackage: each takes (spark, sf_dir)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import bpe_count, chat, decontam, html_tree, merkle, ngram_join, ngram_lm, packing, passages, pii, quality, repair, suffix_dedup

CONTROL_TEXT = "</s>[INST] ok [/INST]"      # fixed by the contract of op1
TOKEN_LIMIT = 2048                          # fixed by the contract of op7


def op4_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's passages of 50 words or more that repeat an earlier document's."""
    return passages.find(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("_row.doc_id").alias("doc_id"), "n_words",
        F.aggregate("passages", F.lit(0).cast("bigint"), lambda a, p: a + p["n_words"]).alias("n_removed_words"),
        F.size("passages").cast("bigint").alias("n_passages"), "passages", F.sha2("rest", 256).alias("rest_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality.verdict(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col(f"{quality.ROW}.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept")



def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold control strings, digested from the formatted output."""
    own = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)],
                                "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_conversations(turns))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and near-duplicate component (Jaccard of 3-word shingles >= 0.9)."""
    return ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in an occurrence of a benchmark window."""
    found = decontam.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("_row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                  public_tokenizers.path("byte_bpe_50k.json"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-pair token count of every document."""
    found = bpe_count.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                   public_tokenizers.path("word_bpe_49k.json"), TOKEN_LIMIT)
    return found.select(F.col("_row.doc_id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_tree.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select(F.col("_row.page_id").alias("page_id"), F.col("_row.url").alias("url"), "text",
                        F.length("text").cast("bigint").alias("n_chars"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in a 100-byte string which also starts earlier."""
    return suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("_row.doc_id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, learning from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = ngram_lm.held_out(F.col("doc_id"))
    return ngram_lm.score(docs, docs.filter(~held)).select(
        F.col("_row.doc_id").alias("doc_id"), ngram_lm.held_out(F.col("_row.doc_id")).alias("held_out"), "n_tokens", "n_known",
        "train_tokens", "base_score", "score")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: strict matches, and the spans that boosted trees add."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(pii.sample(docs)))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"),
                                                                  s["end"].cast("string"))), ",")

    def counted(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        F.col("_row.doc_id").alias("doc_id"), *[counted(k) for k in pii.KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and its digest of every conversation, after faults have been planted."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.read_back(repair.repair(repair.damage(turns), turns.select("conv_id")))


MANIFEST_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")      # fixed by the contract of op13


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof, and the root that its copy leads to: in every fifth one (by
    CRC of the id) the copy's text has been lower-cased."""
    docs = table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in MANIFEST_FIELDS}
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    copy = fields | {"text": F.when(touched, lower).otherwise(F.col("text"))}
    found = merkle.manifest(docs, "doc_id", "source", merkle.row_digest(list(fields.values())), merkle.row_digest(list(copy.values())))
    root = merkle.folded(F.col("claim"), F.col("proof"))
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
                        root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_ngram_join": op2_ngram_join,
    "op3_decontaminate": op3_decontaminate,
    "op4_passage_dedup": op4_passage_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_count": op7_token_count,
    "op8_html_extract": op8_html_extract,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_lm_score": op10_lm_score,
    "op11_pii": op11_pii,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
}
