"""Procedures on related tables: merging entities, the audit trail, access rules, statistics views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Roles by rising rank.
ROLES = ("viewer", "editor", "admin")


def merge_entities(entities: DataFrame, chunks: DataFrame, links: DataFrame, src: int, dst: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entity ``src`` becomes part of ``dst``; the new (entities, chunks, links).

    Chunks and links point to ``dst``; links that then repeat another or point to itself go; the aliases are united with those
    of ``src`` and its lower-cased name, sorted. Raises ValueError for equal or unknown ids.
    """
    if src == dst or entities.where(F.col("id").isin(src, dst)).select("id").distinct().count() != 2:
        raise ValueError("two different entities that exist are needed")
    moved = lambda c: F.when(F.col(c) == src, F.lit(dst)).otherwise(F.col(c)).cast("bigint").alias(c)
    aliases, name = entities.where(F.col("id") == src).select("aliases", "name").first()
    added = F.array(*[F.lit(x) for x in (aliases or [])], F.lower(F.lit(name)))
    united = F.when(F.col("id") == dst, F.array_sort(F.array_union(F.coalesce("aliases", F.expr("cast(array() as array<string>)")), added))).otherwise(F.col("aliases"))
    new_links = links.select(*[moved(c) if c in ("src", "dst") else F.col(c) for c in links.columns])
    # Of links that become equal one stays: an unmoved one before a moved one.
    own = links.where((F.col("src") != src) & (F.col("dst") != src))
    repointed = new_links.join(own.select("src", "dst", "rel"), ["src", "dst", "rel"], "left_anti").where("src <> dst").dropDuplicates(["src", "dst", "rel"])
    return (
        entities.where(F.col("id") != src).withColumn("aliases", united),
        chunks.withColumn("entity_id", F.when(F.col("entity_id") == src, F.lit(dst)).otherwise(F.col("entity_id")).cast("bigint")),
        own.unionByName(repointed.select(*links.columns)),
    )


def audit_rows(before: DataFrame, after: DataFrame, key: str, table: str, actor: str, hidden: tuple[str, ...] = ("password_hash",)) -> DataFrame:
    """``(table_name, row_id, action, actor, old_row, new_row)`` of what changed, rows as JSON without hidden columns."""
    cols = [c for c in before.columns if c not in hidden]
    a = before.select(F.col(key).alias("k"), F.struct(*cols).alias("a"), F.struct(*before.columns).alias("wa"))
    b = after.select(F.col(key).alias("k"), F.struct(*cols).alias("b"), F.struct(*before.columns).alias("wb"))
    met = a.join(b, "k", "full_outer").where(~F.col("wa").eqNullSafe(F.col("wb")))
    action = F.when(F.col("a").isNull(), "INSERT").when(F.col("b").isNull(), "DELETE").otherwise("UPDATE")
    return met.select(F.lit(table).alias("table_name"), F.col("k").alias("row_id"), action.alias("action"), F.lit(actor).alias("actor"), F.to_json("a").alias("old_row"), F.to_json("b").alias("new_row"))


def changed_keys(old: Column, new: Column) -> Column:
    """The keys whose values differ between two JSON objects, sorted."""
    a, b = (F.coalesce(F.from_json(x, "map<string,string>"), F.expr("cast(map() as map<string,string>)")) for x in (old, new))
    return F.array_sort(F.filter(F.array_union(F.map_keys(a), F.map_keys(b)), lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k))))


def allowed(role: Column, least: str) -> Column:
    """Whether a role ranks at least as ``least``."""
    return F.array_position(F.array(*map(F.lit, ROLES)), role) >= ROLES.index(least) + 1


def source_stats(chunks: DataFrame, bodies: DataFrame) -> DataFrame:
    met = chunks.join(bodies.select(F.col("id").alias("body_id"), "body"), "body_id")
    return met.groupBy("source").agg(F.count("*").alias("passages"), F.countDistinct("body_id").alias("texts"), F.countDistinct("entity_id").alias("entities"), F.round(F.avg(F.length("body"))).alias("avg_chars"))


def user_activity(users: DataFrame, searches: DataFrame, bookmarks: DataFrame) -> DataFrame:
    s = searches.groupBy("user_id").agg(F.count("*").alias("searches"), F.max("at").alias("last_search"))
    b = bookmarks.groupBy("user_id").agg(F.count("*").alias("bookmarks"))
    met = users.join(s, "user_id", "left").join(b, "user_id", "left")
    return met.withColumn("searches", F.coalesce("searches", F.lit(0))).withColumn("bookmarks", F.coalesce("bookmarks", F.lit(0)))
