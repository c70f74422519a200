"""Changes to keyed tables, as functions from tables to tables.

Parquet has no updates in place: each operator returns the whole new table, and ``store`` makes it the current version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


def upsert(current: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``current`` with the same keys; the others of both stay."""
    return current.join(new.select(*keys), list(keys), "left_anti").select(*current.columns).unionByName(new.select(*current.columns))


def upsert_keeping(current: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """As ``upsert``, but a null of ``new`` in the columns ``keep`` leaves the current value; the other columns stay as they are."""
    a, b = current.alias("a"), new.alias("b")
    met = a.join(b, list(keys), "full_outer")
    cols = []
    for c in current.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in keep:
            cols.append(F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c))
        else:
            cols.append(F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c))
    return met.select(*cols)


def insert_ignore(current: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``current`` and the first row, by ``order``, of each key that it hasn't."""
    first = new.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__r = 1").drop("__r")
    return current.unionByName(first.join(current.select(*keys), list(keys), "left_anti").select(*current.columns))


def merge_bodies(current: DataFrame, new: DataFrame) -> DataFrame:
    """Texts by content: ``(id, hash, body, flags, trust)``. Flags are united and sorted, trust is the least; the text and id stay.

    ``changed`` tells the rows that had to be written: new texts, and those with flags or a trust that weren't there.
    """
    n = new.groupBy("hash").agg(F.min_by("body", "id").alias("nb"), F.min("id").alias("ni"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("nf"), F.min("trust").alias("nt"))
    met = current.join(n, "hash", "full_outer")
    fresh = F.col("id").isNull()
    grows = F.col("nf").isNotNull() & ((F.size(F.array_except("nf", "flags")) > 0) | (F.col("nt") < F.col("trust")))
    flags = F.when(fresh, F.col("nf")).when(grows, F.array_sort(F.array_union("flags", "nf"))).otherwise(F.col("flags"))
    trust = F.when(fresh, F.col("nt")).when(grows, F.least("trust", "nt")).otherwise(F.col("trust"))
    return met.select(F.coalesce("id", "ni").alias("id"), "hash", F.coalesce("body", "nb").alias("body"), flags.alias("flags"), trust.alias("trust"), (fresh | grows).alias("changed"))


def update_from(current: DataFrame, values: DataFrame, key: str, where: Column | None = None) -> DataFrame:
    """``current`` with the columns of ``values`` for its keys; ``where`` may compare ``current.<c>`` and ``values.<c>``."""
    change = [c for c in values.columns if c in current.columns and c != key]
    hit = F.col("values.__hit").isNotNull() if where is None else F.col("values.__hit").isNotNull() & where
    met = current.alias("current").join(values.withColumn("__hit", F.lit(1)).alias("values"), F.col(f"current.{key}") == F.col(f"values.{key}"), "left")
    return met.select(*[F.when(hit, F.col(f"values.{c}")).otherwise(F.col(f"current.{c}")).alias(c) if c in change else F.col(f"current.{c}") for c in current.columns])


def checked_update(current: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``update_from`` for values whose every key must be there, once."""
    n, hits = values.count(), values.select(key).distinct().join(current.select(key), key, "left_semi").count()
    if n != hits:
        raise ValueError(f"{n} rows to update, {hits} found")
    return update_from(current, values, key)


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, children: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """Without the keys ``gone(id)``; ``children``: table -> (column, ``delete`` or ``null``)."""
    out = dict(tables)
    for name, (column, action) in children.items():
        t, g = tables[name], gone.select(F.col("id").alias(column))
        if action == "delete":
            out[name] = t.join(g, column, "left_anti").select(*t.columns)
        else:
            met = t.join(g.withColumn("__gone", F.lit(True)), column, "left")
            out[name] = met.withColumn(column, F.when(F.col("__gone").isNull(), F.col(column))).select(*t.columns)
    return out


def relabel(df: DataFrame, key: str, n: int, column: str, value: str) -> DataFrame:
    """Every n-th row's ``column`` set to ``value``."""
    return df.withColumn(column, F.when(F.col(key) % n == 0, F.lit(value)).otherwise(F.col(column)))


def borrow_next(df: DataFrame, key: str, n: int, column: str) -> DataFrame:
    """Every n-th row gets ``column`` of the row with the next key, if there is one."""
    after = df.select((F.col(key) - 1).alias(key), F.col(column).alias("__next"))
    take = F.when((F.col(key) % n == 0) & F.col("__next").isNotNull(), F.col("__next")).otherwise(F.col(column))
    return df.join(after, key, "left").withColumn(column, take).select(*df.columns)


def diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``(key, change)`` of what differs: ``missing``, ``extra`` or ``changed``."""
    cols = [c for c in before.columns if c != key]
    a = before.select(key, F.struct(*cols).alias("a"))
    b = after.select(key, F.struct(*cols).alias("b"))
    met = a.join(b, key, "full_outer")
    change = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return met.select(key, change.alias("change")).where("change is not null")


def reset_to(current: DataFrame, snapshot: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The snapshot's rows, and what had to change for it (``diff``)."""
    return snapshot.select(*current.columns), diff(current, snapshot.select(*current.columns), key)


def with_ids(new: DataFrame, last: int, order: str, key: str = "id") -> DataFrame:
    """New rows numbered from ``last`` + 1 by ``order``."""
    return new.withColumn(key, F.row_number().over(Window.orderBy(order)).cast("bigint") + last)


def subset(tables: dict[str, DataFrame], sources: Sequence[str]) -> dict[str, DataFrame]:
    """What the chunks of the kept sources reach: chunks, their texts, vectors and entities, and links between kept entities."""
    refs = tables["chunk_refs"].where(F.col("source").isin(*sources))
    keep = lambda t, on, ids: t.join(refs.select(F.col(ids).alias(on)).distinct(), on, "left_semi")
    entities = keep(tables["entities"], "id", "entity_id")
    out = {"chunk_refs": refs, "entities": entities, "bodies": keep(tables["bodies"], "id", "body_id")}
    if "body_vec" in tables:
        out["body_vec"] = keep(tables["body_vec"], "id", "body_id")
    if "entity_links" in tables:
        ids = entities.select("id")
        links = tables["entity_links"]
        for end in ("src", "dst"):
            links = links.join(ids.select(F.col("id").alias(end)), end, "left_semi")
        out["entity_links"] = links.select(*tables["entity_links"].columns)
    return out
