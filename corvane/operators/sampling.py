"""Deterministic samples and orders of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_order(key: str, seed: str = "") -> Column:
    """A pseudo-random order that other engines can reproduce: the MD5 of key and seed."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))


def hashed_sample(df: DataFrame, key: str, n: int, seed: str = "") -> DataFrame:
    """``n`` rows in seeded order."""
    return df.orderBy(seeded_order(key, seed), key).limit(n)


def exact_share(df: DataFrame, key: str, percent: float, seed: str = "") -> DataFrame:
    """max(1, round(n * percent / 100)) rows (halves to even), in seeded order."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    n = df.count()
    return hashed_sample(df, key, max(1, round(n * percent / 100)), seed)


def round_robin(df: DataFrame, category: str, key: str, n: int, most: int = 600) -> DataFrame:
    """The next row of each category in turn, until ``n`` (1 to ``most``) are taken."""
    turn = F.row_number().over(Window.partitionBy(category).orderBy(key))
    return df.withColumn("turn", turn.cast("bigint")).orderBy("turn", category).limit(max(1, min(n, most)))


def stride_sample(df: DataFrame, is_bulk: Column, key: str, most: int, least: int = 1000) -> DataFrame:
    """All rows but the bulk ones, and of those each stride-th by key, so that about ``most`` rows remain."""
    got = df.agg(F.count("*").alias("n"), F.count_if(is_bulk).alias("bulk")).first()
    room = max(most - (got["n"] - got["bulk"]), least)
    stride = max(1, -(-got["bulk"] // room))
    return df.where(~is_bulk | (F.col(key) % stride == 0))


def page(df: DataFrame, key: str, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of rows in key order."""
    return df.orderBy(key).offset((number - 1) * size).limit(size)


def after(df: DataFrame, key: str, last: int, n: int) -> DataFrame:
    """The next ``n`` rows beyond key ``last``."""
    return df.where(F.col(key) > last).orderBy(key).limit(n)


def capped(df: DataFrame, group: str, key: str, most: int, seed: str = "") -> DataFrame:
    """At most ``most`` rows of each group, in seeded order."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(seeded_order(key, seed), key))
    return df.withColumn("place", place.cast("bigint")).where(F.col("place") <= most)
