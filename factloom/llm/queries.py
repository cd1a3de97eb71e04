"""The registered queries over the training-data tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import attention, decontaminate, edit_counts, joined_bpe, lexical_scan, merkle, mixing, ngram_join, quality_rules, substrings, templates, token_files, warc
from factloom.llm.oracles import ORACLES

TOKENIZER = "byte_bpe_50k.json"
MAX_REPEATS = 1.25


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after personal data are cut out."""
    trees = edit_counts.with_trees(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    asked = trees.withColumn("edits", edit_counts.redactions("text"))
    done = edit_counts.edited(asked, tokenizer_path(), with_text=False)
    return done.select("doc_id", "n_tokens", "n_tokens_after", "n_edits", "chars_encoded", F.size("leaf_chars").alias("n_leaves"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all sources with as much text as there is, no source read more than 1.25 times."""
    return mixing.blocks(table(spark, sf_dir, "documents"), max_repeats=MAX_REPEATS)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokenized(table(spark, sf_dir, "documents"), tokenizer_path())


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def op4_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = attention.fit(docs, labels.where(~held_out()))
    scored = attention.score(docs.select("doc_id", "text"), model, threshold=0.3)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"), n=5, threshold=0.8).select("doc_id", "class_id", "n_links")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.parsed(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.judged(table(spark, sf_dir, "documents")).select(*columns)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extracted(table(spark, sf_dir, "pages"))


def op11_joined_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = joined_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_lexical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_scan.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and proofs of all documents, and what a row without its line ends folds to where the id's CRC is even."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.replace("text", F.lit("\n")) if c == "text" else F.col(c) for c in merkle.FIELDS]
    other = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, merkle.row_digest(*fields))
    rows = merkle.manifest(docs, other)
    root = merkle.folded(F.coalesce("other", "leaf"), F.col("proof"))
    proofs = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), root.alias("folded_root"))
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_edit_counts, op2_mixing, op3_token_files, op4_quality_attention, op5_ngram_join, op6_substring_dedup, op7_quality_rules, op8_warc, op9_decontamination, op10_main_text, op11_joined_bpe, op12_lexical_scan, op13_merkle_manifest, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
