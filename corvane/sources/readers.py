"""Readers of text collections: CSV, trees of files, probes; nothing is inferred and nothing executed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as X

CORPUS = "id bigint, category string, body string"


def csv_corpus(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    """A CSV with a header; quoted fields may hold line ends."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def text_tree(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(path, text)`` of every file below ``path`` whose name matches."""
    df = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return df.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def _sections(df: DataFrame, cut) -> DataFrame:
    return df.select("path", F.posexplode(X.udf_of(cut, X.SECTIONS)("text")).alias("place", "s")).select("path", "place", "s.section", "s.body")


def manual_pages(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(path, place, section, body)`` of rendered manual pages; redirects are passed over, overstrikes removed."""
    pages = text_tree(spark, path, glob).where(~F.regexp_like(F.substring("text", 1, 200), F.lit(r"^\s*\.so ")))
    return _sections(pages.withColumn("text", F.regexp_replace("text", r".\x08", "")), X.man_sections)


def rst_tree(spark: SparkSession, path: str) -> DataFrame:
    return _sections(text_tree(spark, path, "*.rst"), X.rst_sections)


def short_pages(spark: SparkSession, preferred: str, fallback: str) -> DataFrame:
    """``(name, text)`` of Markdown pages: from the first folder, and those that only the second has."""
    named = lambda p: text_tree(spark, p, "*.md").select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("name"), "text")
    first = named(preferred)
    return first.unionByName(named(fallback).join(first.select("name"), "name", "left_anti"))


def captured_help(spark: SparkSession, path: str) -> DataFrame:
    """``(name, text)`` of help outputs that were captured to files; this library runs no programs."""
    return text_tree(spark, path, "*.txt").select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("name"), "text")


def json_probes(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Files of one JSON array each; ``lines``: of one object a line."""
    return spark.read.json(path, schema=schema, multiLine=not lines)


def json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
