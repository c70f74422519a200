"""The operators as queries over the driver's tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bm25, bpe, langid, license_scan, line_dedup, mixing, near_dedup, order_minhash, paragraph_dedup, wordpiece


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    return order_minhash.edits(_documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece lengths of all documents, by the pieces of the public 32k vocabulary."""
    vocabulary = wordpiece.sentencepiece_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    return wordpiece.count_tokens(_documents(spark, sf_dir).select("doc_id", "text"), vocabulary).drop("text")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    documents = _documents(spark, sf_dir)
    model = langid.fit_documents(documents)
    return langid.identify(documents.select("doc_id", "text", langid.held_out().alias("held_out")), model).drop("text")


def op4_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every document whose id is divisible by 100."""
    documents = _documents(spark, sf_dir)
    return bm25.search(documents, documents.where("doc_id % 100 = 0"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses that documents state."""
    return license_scan.scan(_documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests."""
    coded = bpe.encode(_documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
    return coded.drop("text")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources takes of every document."""
    mixed = mixing.mix(_documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with words that stay in every document."""
    documents = _documents(spark, sf_dir)
    kept = line_dedup.kept_lines(documents)
    lines = F.coalesce(F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)).cast("bigint")
    rows = documents.select("doc_id", lines.alias("n_lines")).join(kept, "doc_id", "left")
    kept_lines = F.coalesce("kept", F.expr("cast(array() as array<int>)"))
    return rows.select("doc_id", "n_lines", F.size(kept_lines).cast("bigint").alias("n_kept"), kept_lines.alias("kept_lines"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_dedup.classes(_documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph that documents share, with its component."""
    return paragraph_dedup.repeats(_documents(spark, sf_dir))


QUERIES = {
    "op1_order_minhash": op1_order_minhash,
    "op2_token_counts": op2_token_counts,
    "op3_language_id": op3_language_id,
    "op4_top_k_search": op4_top_k_search,
    "op5_license_scan": op5_license_scan,
    "op6_bpe": op6_bpe,
    "op7_mixing": op7_mixing,
    "op8_line_dedup": op8_line_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op10_substring_dedup": op10_substring_dedup,
}
SQL = {
    "op4_top_k_search": bm25.SQL,
    "op5_license_scan": license_scan.SQL,
    "op7_mixing": mixing.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op9_near_dedup": near_dedup.SQL,
}
