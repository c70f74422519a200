"""MinHash near-dedup by fast similarity sketching.

A document's sketch has BANDS * ROWS coordinates. In round after round every shingle is hashed to one
coordinate with a value that begins with the round; each coordinate keeps its least value, and the
rounds end as soon as none is empty. After as many rounds as there are coordinates, round by round one
coordinate gets all shingles, so that all are filled in the end. The share of equal coordinates is
concentrated about the Jaccard similarity, as with independent MinHashes, for a fraction of the work.
Documents that agree in all rows of a band collide; what collides is verified on the full sets, by the least
document of each bucket first (see ``sets.link_colliding``). At a similarity of 0.75, 40 bands of 5 rows miss a pair
with probability (1 - 0.75**5)**40 = 2e-5.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import WORD, Scratch, bounded_batches, free_name, tidy
from corvane.llm.sets import BROADCAST_ROWS, link_colliding, mixed, shingle_hashes
from corvane.llm.words import hashed, pieces

BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
_ROUND = mixed(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ROW = mixed(np.arange(101, 101 + ROWS, dtype=np.uint64)) | np.uint64(1)
_BAND = mixed(np.arange(1001, 1001 + BANDS, dtype=np.uint64))


def sketch(elements: np.ndarray) -> np.ndarray:
    """BINS coordinates of a set that isn't empty."""
    out = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    low = np.uint64((1 << 54) - 1)
    for i in range(2 * BINS):
        x = mixed(elements ^ _ROUND[i])
        value = (x & low) | np.uint64(i << 54)
        if i < BINS:
            np.minimum.at(out, ((x >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64), value)
        else:
            out[i - BINS] = min(out[i - BINS], value.min())
        if (out >> np.uint64(54)).max() <= i:
            break
    return out


def band_keys(elements: np.ndarray) -> np.ndarray:
    return mixed((sketch(elements).reshape(BANDS, ROWS) * _ROW).sum(axis=1, dtype=np.uint64) ^ _BAND)


def _shingle_sets(batches):
    """Of some rows ``(id, body, ...)`` at a time: the rows without their bodies, and the sorted distinct shingles of each."""
    for b in batches:
        body = b.column(1).fill_null("")
        for rows, at, text in pieces([pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), body], names=["row", "body"])]):
            begins, h = hashed(at, text)
            edge = np.searchsorted(begins, at)
            yield b.select([0, *range(2, b.num_columns)]).take(pa.array(rows)), [np.unique(shingle_hashes(h[s:e])) for s, e in zip(edge[:-1], edge[1:], strict=True)]


def _arrays(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *[x.view(np.int64) for x in values]])))


def _sketched(batches):
    for rows, sets in _shingle_sets(batches):
        digest = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]).reshape(-1, 2)
        keys = _arrays([band_keys(s) if len(s) else s for s in sets])
        n = pa.array([len(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), n, pa.array(digest[:, 0]), pa.array(digest[:, 1]), keys], names=["id", "t", "n", "s1", "s2", "bands"])


def _sets(batches):
    for rows, sets in _shingle_sets(batches):
        yield pa.RecordBatch.from_arrays([rows.column(0), _arrays(sets)], names=["id", "s"])


def classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``df``.

    Shingles are of five ASCII-lower-cased words; a text of fewer words is one shingle, one without words
    or null has none and is linked with nothing. Documents are linked at a Jaccard similarity of 0.75 or
    more; ``component_id`` is the least id reachable, ``kept`` whether it is the row's own. Equal sets
    are one node, so thousands of copies cost one comparison. Where one id stands on rows of different
    texts, each row has the component of its own text; sets that have the same least id are one node of the links. A null id has a null component and is kept. An empty
    table gives an empty one.
    """
    return _classes(df, key, text).drop("t")


def _classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``classes`` with ``t``, a hash of the row's text."""
    bounded_batches(df.sparkSession)
    scratch = Scratch(df.sparkSession)
    texts = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("body"))
    hashed_too = texts.withColumn("t", F.xxhash64("body"))
    made = scratch.save(hashed_too.mapInArrow(tidy(_sketched), "id bigint, t bigint, n bigint, s1 bigint, s2 bigint, bands array<bigint>"))
    # A set's row of the least id stands for all; where that id has several rows, their sets are told apart by a row each.
    nodes = made.where("id is not null and n > 0")
    reps = scratch.save(nodes.groupBy("s1", "s2").agg(F.min("id").alias("rep")))
    first = nodes.join(reps.select(F.col("rep").alias("id"), F.col("s1").alias("r1"), F.col("s2").alias("r2")), "id").where("s1 = r1 and s2 = r2")
    keys = scratch.save(first.select("id", "bands")).select(F.explode("bands").alias("key"), "id")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = scratch.save(ids)
        few = wanted.count() <= BROADCAST_ROWS
        sets = texts.join(F.broadcast(wanted) if few else wanted, "id", "left_semi").mapInArrow(tidy(_sets), "id bigint, s array<bigint>")
        return sets.where("size(s) > 0")

    found, _ = link_colliding(keys, sets_of, scratch)
    by_set = reps.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    rows = made.select("id", "t", "n", "s1", "s2").join(by_set, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return rows.select(F.col("id").alias("doc_id"), "t", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one document of each component, the one of the least id; columns and other rows as they are.

    Rows are told apart by id and text: of rows that have both in common one stays, and of rows of one id only those go
    whose own text isn't kept. Rows with a null id stay, as do those without words.
    """
    scratch = Scratch(df.sparkSession)
    rows = scratch.save(_classes(df, key, text).where("doc_id is not null").groupBy("doc_id", "t").agg(F.max("kept").alias("kept"), F.count("*").alias("n"), F.max("n_shingles").alias("size")))
    if not rows.where("n > 1 and kept and size > 0").isEmpty():
        named = F.col(f"`{key}`").isNotNull() & F.regexp_like(F.col(f"`{text}`"), F.lit(WORD))
        df = df.where(named).dropDuplicates([key, text]).unionByName(df.where(F.coalesce(~named, F.lit(True))))
    gone = scratch.save(rows.where(~F.col("kept")).select("doc_id", "t"))
    few = gone.count() <= BROADCAST_ROWS
    g = (F.broadcast(gone) if few else gone).toDF(*[free_name(df, x) for x in ("gone_id", "gone_text")])
    same = (F.col(f"`{key}`") == g[g.columns[0]]) & (F.xxhash64(F.col(f"`{text}`")) == g[g.columns[1]])
    return df.join(g, same, "left_anti")


SQL = r"""
with recursive ws as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents
), sh as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from ws)
), n as (
  select doc_id, count(*) as n from sh group by doc_id
), pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), e as (
  select x, y from pairs join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 75 * (nx.n + ny.n - c)
), both_ways as (
  select x, y from e union all select y, x from e
), reach as (
  select doc_id as s, doc_id as r from ws
  union
  select reach.s, b.y from reach join both_ways b on b.x = reach.r
)
select ws.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(reach.r) as component_id, ws.doc_id = min(reach.r) as kept
from ws left join n on n.doc_id = ws.doc_id join reach on reach.s = ws.doc_id group by ws.doc_id
"""
