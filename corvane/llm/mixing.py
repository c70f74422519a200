"""Mixing sources to target weights, with DataFrame operations only.

Sizes are summed by source; the sources' targets follow from their weights by filling: each takes its
share by weight, but none more than ``most`` times its size, and what those at that bound can't take is
shared among the others by weight. The rate of a source is target / size; each document is taken
floor(rate) times, and once more if a number in [0, 1) from a hash of its id is below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import WORD, Scratch, without

#: Weights of the sources in their order, repeating; the share of all sizes to take; the most of a source.
WEIGHTS, TOTAL, MOST = (5, 2, 1), 1.5, 2.0
#: Sources up to which their table is broadcast; with more of them the documents are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """``sizes(source, source_size)``, a row for each source, with its ``target`` and ``rate``.

    Sorted by how soon a source reaches its bound, source i does so if filling all to its level
    needs no more than there is: one pass of running sums replaces the rounds of resharing.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight.cast("double")).withColumn("bound", most * F.col("source_size"))
    every = Window.partitionBy()
    soonest = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    w = (
        w.withColumn("share", total * F.sum("source_size").over(every))
        .withColumn("weights", F.sum("weight").over(every))
        .withColumn("level", F.col("bound") / F.col("weight"))
        .withColumn("taken_before", F.coalesce(F.sum("bound").over(soonest), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(soonest), F.lit(0.0)))
        .withColumn("full", F.expr("taken_before + level * (weights - weight_before) <= share"))
        .withColumn("rest", F.col("share") - F.coalesce(F.sum(F.when(F.col("full"), F.col("bound"))).over(every), F.lit(0.0)))
        .withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight"))).over(every))
        .withColumn("target", F.when(F.col("full"), F.col("bound")).otherwise(F.col("rest") * F.col("weight") / F.col("open")))
    )
    return w.select("source", "source_size", "target", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("rate"))


def draw(key: Column) -> Column:
    """A number in [0, 1) from the key's MD5, the same on every run and engine: its first 13 hex digits."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(df: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", seed: str = "mix") -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target`` and ``copies`` (how often the mix takes the document).

    ``size`` is the number of words of the whole text (null: 0). A null source is one source, the last.
    Documents with the same key are drawn alike; a null key is a key of its own. Columns of ``df`` with
    these names are replaced; no row is dropped. An empty table gives an empty one; where all texts are
    empty nothing is taken. Only sums by source are shuffled: their table is broadcast if it has no more
    than BROADCAST_SOURCES rows, and else joined in pieces that adaptive execution splits where a source is hot.
    """
    scratch = Scratch(df.sparkSession)
    own = ("size", "source_size", "target", "copies")
    sized = without(df, *own).withColumn("size", size_of(text))
    by = scratch.save(targets(sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))))
    by = by.select(F.col("source").alias("__source"), "source_size", "target", F.col("rate").alias("__rate"))
    joined = sized.join(F.broadcast(by) if by.count() <= BROADCAST_SOURCES else by, sized[source].eqNullSafe(by["__source"]))
    frac = F.col("__rate") - F.floor("__rate")
    copies = F.floor("__rate") + (draw(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null")))) < frac).cast("bigint")
    return joined.withColumn("copies", copies.cast("bigint")).drop("__source", "__rate")


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it, without the columns that ``mix`` added."""
    rows = mixed.where("copies > 0").withColumn("__copy", F.explode(F.expr("sequence(1L, copies)")))
    return rows.drop("__copy", "size", "source_size", "target", "copies")


SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), src as (
  select source, sum(size)::bigint as source_size from sized group by source
), ranked as (
  select *, [5, 2, 1][((row_number() over (order by (source is null), source) - 1) % 3 + 1)::int]::double as weight, 2.0::double * source_size as bound from src
), cum as (
  select *, 1.5::double * (sum(source_size) over ())::double as share, sum(weight) over () as weights, bound / weight as level,
    coalesce(sum(bound) over w, 0) as taken_before, coalesce(sum(weight) over w, 0) as weight_before
  from ranked window w as (order by bound / weight, (source is null), source rows between unbounded preceding and 1 preceding)
), filled as (
  select *, taken_before + level * (weights - weight_before) <= share as filled from cum
), rest as (
  select *, share - coalesce(sum(case when filled then bound end) over (), 0) as rest, sum(case when not filled then weight end) over () as open from filled
), target as (
  select source, source_size, case when filled then bound else rest * weight / open end as target from rest
)
select d.doc_id, d.size, t.source_size, t.target,
  d.size * (floor(coalesce(t.target / nullif(t.source_size, 0), 0))::bigint
    + (('0x' || substr(md5('mix|' || coalesce(d.doc_id::varchar, 'null')), 1, 13))::bigint::double / 4503599627370496.0::double
       < coalesce(t.target / nullif(t.source_size, 0), 0) - floor(coalesce(t.target / nullif(t.source_size, 0), 0)))::bigint) as taken
from sized d join target t on d.source is not distinct from t.source
"""
