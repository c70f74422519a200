"""Faults for tests of the healer: each changes a table of vectors in a known, repeatable way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import vectors as V
from corvane.operators import sampling


def _struck(docs: DataFrame, percent: float, seed: str) -> DataFrame:
    chosen = sampling.exact_share(docs.select("id"), "id", percent, seed).withColumn("__hit", F.lit(True))
    return docs.join(chosen, "id", "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))


def strike(docs: DataFrame, percent: float, seed: str, vector: Column, label: str | None = None) -> DataFrame:
    """The chosen rows get ``vector`` and, if told, another model's ``label``."""
    met = _struck(docs, percent, seed)
    met = met.withColumn("embedding", F.when(F.col("__hit"), vector).otherwise(V.doubles(F.col("embedding"))))
    if label is not None:
        met = met.withColumn("model_version", F.when(F.col("__hit"), F.lit(label)).otherwise(F.col("model_version")))
    return met.select(*docs.columns)


def permutation(docs: DataFrame, percent: float, seed: str, label: str | None = None) -> DataFrame:
    return strike(docs, percent, seed, V.permuted("embedding"), label)


def cross_model(docs: DataFrame, percent: float, seed: str, embed, label: str | None = None) -> DataFrame:
    return strike(docs, percent, seed, embed(F.col("body")), label)


def noise(docs: DataFrame, percent: float, seed: str, sigma: float) -> DataFrame:
    """Gaussian noise, from a hash of id and dimension by the Box-Muller rule, then unit length again."""
    u = lambda i, s: (F.pmod(F.xxhash64(F.col("id"), i, F.lit(f"{seed}{s}")), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    noisy = F.transform("embedding", lambda x, i: x.cast("double") + sigma * F.sqrt(-2 * F.log(u(i, "a"))) * F.cos(6.283185307179586 * u(i, "b")))
    met = _struck(docs, percent, seed).withColumn("__noisy", noisy)
    return met.withColumn("embedding", F.when(F.col("__hit"), V.normalise(F.col("__noisy"))).otherwise(V.doubles(F.col("embedding")))).select(*docs.columns)


def relabel(docs: DataFrame, n: int, label: str) -> DataFrame:
    return docs.withColumn("model_version", F.when(F.col("id") % n == 0, F.lit(label)).otherwise(F.col("model_version")))


def restore(docs: DataFrame, backup: DataFrame, expected: int, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """The backed-up vectors and labels; raises ValueError if not every backup row is there. ``keys`` tell rows apart, also where ids repeat."""
    if backup.join(docs.select(*keys), [*keys], "left_semi").count() != expected:
        raise ValueError("rows are missing")
    b = backup.groupBy(*keys).agg(F.min(F.struct(V.doubles(F.col("embedding")).alias("e"), F.col("model_version").alias("m"))).alias("__b"))
    met = docs.join(b, [*keys], "left")
    hit = F.col("__b").isNotNull()
    met = met.withColumn("embedding", F.when(hit, F.col("__b.e")).otherwise(V.doubles(F.col("embedding"))))
    return met.withColumn("model_version", F.when(hit, F.col("__b.m")).otherwise(F.col("model_version"))).select(*docs.columns)
