"""A corpus pipeline of the training-data operators: from documents to token ids of the mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, langid, line_dedup, mixing, near_dedup
from corvane.llm.common import WORD, Scratch
from corvane.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if no language knows this share of its n-grams.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of their labels; those without letters or in none of them go."""
    found = langid.identify(docs.select(*COLUMNS), langid.fit_documents(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier ones have; a document of which no word is left goes."""
    cut = line_dedup.dedup_lines(docs.select(*COLUMNS)).where(F.regexp_like("text", F.lit(WORD)))
    return cut.withColumn("n_chars", F.char_length("text").cast("bigint"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return near_dedup.keep_one(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.emit(mixing.mix(docs.select(*COLUMNS)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their digest, and that of the text they decode to."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path("byte_bpe_50k.json"), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))
    return coded.drop("text")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither language ID nor BPE; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs
