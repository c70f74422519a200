"""Exact top-k search: inverted indexes by shard, BM25 over global statistics, thresholds by block maxima.

Each input partition becomes one or more shards of bounded size, written to the shared folder: the shard's terms, their
postings and the lengths of its documents. Document frequencies and the mean length are summed over all shards, so a
score doesn't depend on how the documents are dealt. Queries run in blocks of bounded size against every
shard; the shards' best are merged exactly, since none of a shard's k best is left out that may be among all shards'.

In a shard, all terms are summed in single precision: the frequent ones, which have most of the postings, for many
queries at once by a matrix product, the others over their postings. The k-th best of the blocks' maxima, or the k-th best
score of the task's shards before, is the threshold; what reaches it, less a bound of the sums' error, is scored again in
double precision. Nothing that belongs to the k best is left out. A task merges its shards and returns k rows a query.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, bounded_batches, tidy

TERM = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75
#: A shard's bounds; a block of queries' bound, in terms; how many queries are evaluated together.
SHARD_DOCS, SHARD_POSTINGS, QUERY_TERMS, TOGETHER = 1 << 14, 1 << 22, 2_000_000, 256
#: Texts of a shard are counted this many bytes at a time.
COUNT_BYTES = 1 << 22
#: Terms in one of OFTEN documents of a shard, MOST_OFTEN at most, are its frequent ones. BLOCK documents share a maximum.
OFTEN, MOST_OFTEN, BLOCK = 20, 768, 64
#: Scores are compared as rounded to this many digits, ties by document id.
DIGITS, MARGIN, TINY = 6, 1e-5, 1e-37

_SHARD = {"n_docs": "bigint", "total": "bigint", "doc_ids": "binary", "lengths": "binary", "terms": "binary", "starts": "binary", "docs": "binary", "tfs": "binary"}


def terms(text: str | None) -> list[str]:
    return TERM.findall(text.lower()) if text else []


#: What isn't part of a term becomes a blank: characters beyond ASCII, and bytes below 128.
_WIDE, _BLANKED = re.compile(r"[^\w\x00-\x7f]"), bytes(c if c > 127 or TERM.match(chr(c)) else 32 for c in range(256))


def _blanked(text: str) -> bytes:
    """Lower-cased UTF-8 of ``text`` with blanks for all but its terms."""
    low = text.lower()
    return (low if low.isascii() else _WIDE.sub(" ", low)).encode().translate(_BLANKED)


def _build(batches):
    ids: list[int] = []
    lengths: list[np.ndarray] = []
    names: list[pa.Array] = []
    keys: list[np.ndarray] = []
    tfs: list[np.ndarray] = []
    pending: list[bytes] = []
    size, n_bytes = 0, 0

    def count():
        """Count the pending texts' terms: their names, keys of a name's number and a document, and frequencies."""
        words = pc.split_pattern(pa.array(pending, pa.large_binary()).cast(pa.large_string()), " ")
        doc = np.repeat(np.arange(len(pending)), words.value_lengths().to_numpy())
        words = words.flatten()
        some = pc.not_equal(words, "")
        words, doc = words.filter(some).dictionary_encode(), doc[some.to_numpy(zero_copy_only=False)]
        lengths.append(np.bincount(doc, minlength=len(pending)).astype(np.int32))
        names.append(words.dictionary)
        key = np.sort(words.indices.to_numpy().astype(np.int64) << 32 | (doc + len(ids) - len(pending)))
        first = np.flatnonzero(np.diff(key, prepend=-1))
        keys.append(key[first])
        tfs.append(np.diff(first, append=len(key)).astype(np.int32))
        pending.clear()
        return len(first)

    def shard():
        known, length = pa.concat_arrays(names).dictionary_encode(), np.concatenate(lengths)
        tids = np.split(known.indices.to_numpy().astype(np.int64), np.cumsum([len(x) for x in names])[:-1])
        key = np.concatenate([tid[k >> 32] << 32 | k & 0xFFFFFFFF for tid, k in zip(tids, keys, strict=True)])
        order = np.argsort(key)
        key = key[order]
        starts = np.searchsorted(key, np.arange(len(known.dictionary) + 1, dtype=np.int64) << 32)
        values = (len(ids), int(length.sum()), np.array(ids, np.int64), length, "\n".join(known.dictionary.to_pylist()).encode(), starts.astype(np.int64), (key & 0xFFFFFFFF).astype(np.int32), np.concatenate(tfs)[order])
        cols = [pa.array([v if isinstance(v, int | bytes) else v.tobytes()], pa.int64() if isinstance(v, int) else pa.binary()) for v in values]
        for x in (ids, lengths, names, keys, tfs):
            x.clear()
        return pa.RecordBatch.from_arrays(cols, names=list(_SHARD))

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids.append(i)
            pending.append(_blanked(t.as_py() or ""))
            n_bytes += len(pending[-1])
            if len(ids) >= SHARD_DOCS or n_bytes >= COUNT_BYTES:
                size, n_bytes = size + count(), 0
            if len(ids) >= SHARD_DOCS or size >= SHARD_POSTINGS:
                yield shard()
                size = 0
    if pending:
        count()
    if ids:
        yield shard()


class Shard:
    """A shard's postings that ``queries`` ask for: by term with impacts in single precision, the most frequent terms' as a table, and by document."""

    def __init__(self, row: dict, mean: float, queries: Queries):
        read = lambda k, kind: np.frombuffer(row[k], kind)
        self.ids, starts, docs, tf = read("doc_ids", np.int64), read("starts", np.int64), read("docs", np.int32), read("tfs", np.int32)
        self.norm = K1 * (1 - B + B * read("lengths", np.int32) / mean)
        term = pc.index_in(_names(row["terms"]), queries.names).fill_null(-1).to_numpy()
        n, size, asked = len(self.ids), np.diff(starts), term >= 0
        if not asked.all():
            wanted = np.repeat(asked, size)
            docs, tf, size, term = docs[wanted], tf[wanted], size[asked], term[asked]
        self.starts = np.concatenate([[0], np.cumsum(size)])
        self.known = np.full(len(queries.names), -1)
        self.known[term] = np.arange(len(term))
        # A posting's document and impact are one element, so that both are gathered at once.
        pairs = np.empty((len(docs), 2), np.int32)
        pairs[:, 0] = docs
        pairs[:, 1] = _impact(tf, self.norm[docs]).astype(np.float32).view(np.int32)
        self.postings = pairs.view(np.float64).ravel()
        self.found = np.empty(len(docs))
        often = np.flatnonzero(size * OFTEN >= n)
        often = np.sort(often[np.argsort(-size[often], kind="stable")[:MOST_OFTEN]])
        self.column = np.full(len(term), -1)
        self.column[often] = np.arange(len(often))
        self.table = np.zeros((n, len(often)), np.float32)
        for c, t in enumerate(often):
            s, e = self.starts[t], self.starts[t + 1]
            self.table[docs[s:e], c] = pairs[s:e, 1].view(np.float32)
        order = np.argsort(docs.astype(np.uint16) if n <= 1 << 16 else docs, kind="stable")
        self.doc_starts = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=n))])
        self.doc_terms, self.doc_tfs = np.repeat(term, size)[order], tf[order]

    def sums(self, queries: Queries, group: range) -> np.ndarray:
        """Scores in single precision, a row for each query of ``group``."""
        often, rare = np.zeros((len(group), self.table.shape[1]), np.float32), []
        for g, q in enumerate(group):
            tid, w = self.known[queries.terms_of(q)], queries.weights_of(q).astype(np.float32)
            here = tid >= 0
            tid, w = tid[here], w[here]
            column = self.column[tid]
            often[g, column[column >= 0]] = w[column >= 0]
            rare.append((tid[column < 0], w[column < 0]))
        score = often @ self.table.T
        for g, (tid, w) in enumerate(rare):
            if len(tid):
                at, size = _ranges(self.starts, tid)
                found = self.postings.take(at, mode="clip", out=self.found[: len(at)])  # the faster mode, all are within
                added = np.repeat(w, size)
                added *= found.view(np.float32)[1::2]
                at[:] = found.view(np.int32)[::2]
                np.add.at(score[g], at, added)
        return score

    def exact(self, docs: np.ndarray, weight: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Scores of ``docs`` in double precision; the query's ``weight`` and whether it's ``asked``, by its block's terms."""
        s, e = self.doc_starts[docs], self.doc_starts[docs + 1]
        ends = np.cumsum(e - s)
        term = np.concatenate([self.doc_terms[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)])
        hit = np.flatnonzero(asked.take(term, mode="clip"))
        doc = np.searchsorted(ends, hit, side="right")
        tf = self.doc_tfs[hit + (e - ends)[doc]]
        return np.bincount(doc, weights=weight[term[hit]] * _impact(tf, self.norm[docs[doc]]), minlength=len(docs))

    def best(self, queries: Queries, k: int, least: np.ndarray):
        """``(query, ids, rounded scores)`` with, for each query, the shard's k best documents of those that hold any of its terms, and maybe others.

        Documents below ``least``, by query, may lack: rounded scores that the query's k best reach anyway.
        """
        n, weight, asked = len(self.ids), np.zeros(len(queries.names)), np.zeros(len(queries.names), bool)
        edges = np.arange(0, n, BLOCK)
        for at in range(0, len(queries.ids), TOGETHER):
            group = range(at, min(at + TOGETHER, len(queries.ids)))
            score, floor = self.sums(queries, group), least[at : group.stop]
            if len(edges) > k:
                # k blocks have a document each that reaches the k-th best block's maximum.
                top = np.maximum.reduceat(score, edges, axis=1)
                floor = np.maximum(floor, np.partition(top, len(edges) - k, axis=1)[:, len(edges) - k])
            # Nothing in a sum is negative, so single precision is wrong by 2**-24 of it for each term and step at most.
            error = np.diff(queries.starts)[at : group.stop] * 2.0**-24 + 2.0**-20
            floor = np.maximum(floor * (1 - 2 * error) - MARGIN, TINY).astype(np.float32)
            row, doc = np.divmod(np.flatnonzero(score >= floor[:, None]), n)
            ends = np.searchsorted(row, np.arange(len(group) + 1))
            for g, q in enumerate(group):
                docs = doc[ends[g] : ends[g + 1]]
                if len(docs):
                    its = queries.terms_of(q)
                    weight[its], asked[its] = queries.weights_of(q), True
                    rounded = np.round(self.exact(docs, weight, asked), DIGITS)
                    asked[its] = False
                    yield q, self.ids[docs], rounded


def _names(joined: bytes | pa.Buffer) -> pa.Array:
    return pc.split_pattern(pa.array([str(joined, "utf-8")] if len(joined) else [], pa.string()), "\n").flatten()


def _impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return tf * (K1 + 1) / (tf + norm)


def _ranges(starts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges ``of``, one after the other, and the ranges' sizes."""
    size = starts[of + 1] - starts[of]
    ends = np.cumsum(size)
    at = np.repeat(starts[of] - (ends - size), size)
    at += np.arange(len(at))
    return at, size


class Queries:
    """A block of weighted queries, each term once: a table of ``id`` and ``v``, lists of ``term`` and ``w``."""

    def __init__(self, rows: pa.Table):
        v = rows.column("v").combine_chunks()
        term = v.flatten().field("term").dictionary_encode()
        self.ids = rows.column("id").to_numpy()
        self.terms, self.weights = term.indices.to_numpy(), v.flatten().field("w").to_numpy()
        self.starts = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy())])
        self.names = term.dictionary

    def terms_of(self, q: int) -> np.ndarray:
        return self.terms[self.starts[q] : self.starts[q + 1]]

    def weights_of(self, q: int) -> np.ndarray:
        return self.weights[self.starts[q] : self.starts[q + 1]]


def search(documents: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ``k`` best of ``documents`` for each of ``queries``: ``(query_id, rank, doc_id, score)``.

    Both have ``key`` and ``text``; a query is its whole text, a term counts as often as it stands there. Scores are BM25,
    rounded to DIGITS; ties go by id. A document that shares no term isn't a result, so an empty or null query has none.
    Null ids are passed over; rows with the same id are documents of their own. An empty table gives an empty one.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    of = lambda df: df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("t"))
    index = scratch.save(of(documents).mapInArrow(tidy(_build), ", ".join(f"{k} {v}" for k, v in _SHARD.items())))
    total = index.agg(F.sum("n_docs"), F.sum("total")).first()
    n, mean = total[0] or 0, (total[1] or 0) / max(total[0] or 0, 1) or 1.0

    def frequencies(batches):
        for b in batches:
            for t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                names = t.decode().split("\n") if t else []
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.diff(np.frombuffer(s, np.int64)))], names=["term", "df"])

    def asked(batches):
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                names, count = np.unique(np.array(terms(t.as_py()), object), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), i), pa.int64()), pa.array(list(names), pa.string()), pa.array(count, pa.int64())], names=["id", "term", "n"])

    df = index.select("terms", "starts").mapInArrow(frequencies, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.col("n") * F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    vectors = of(queries).mapInArrow(asked, "id bigint, term string, n bigint").join(df, "term").select("id", "term", weight.alias("w"))
    vectors = scratch.save(vectors.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("v")))
    blocks = max(1, -(-(vectors.agg(F.sum(F.size("v"))).first()[0] or 0) // QUERY_TERMS))
    found = []
    for i in range(blocks):
        block = vectors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i)
        shared = spark.sparkContext.broadcast(Queries(block.toArrow()))  # about QUERY_TERMS terms
        found.append(scratch.save(index.mapInArrow(_searcher(shared, mean, k), "query_id bigint, doc_id bigint, score double")))
        shared.unpersist()
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return rows.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _searcher(shared, mean: float, k: int):
    def run(batches):
        queries: Queries = shared.value
        ids, scores = ([np.empty(0, kind)] * len(queries.ids) for kind in (np.int64, np.float64))
        least = np.zeros(len(queries.ids))  # the k-th best score of the task's shards so far
        for b in batches:
            for i in range(b.num_rows):
                row = {name: c[i].as_buffer() for name, c in zip(b.schema.names, b.columns, strict=True) if c.type == pa.binary()}
                for q, more, rounded in Shard(row, mean, queries).best(queries, k, least):
                    more, rounded = np.concatenate([ids[q], more]), np.concatenate([scores[q], rounded])
                    top = np.lexsort((more, -rounded))[:k]
                    ids[q], scores[q] = more[top], rounded[top]
                    if len(top) == k:
                        least[q] = rounded[top[-1]]
        cols = [np.repeat(queries.ids, [len(x) for x in ids])] + [np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((ids, np.int64), (scores, np.float64))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "doc_id", "score"])

    return tidy(run)


SQL = r"""
with d as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from documents),
tf as (select doc_id, term, count(*)::double as tf from d group by doc_id, term),
len as (select documents.doc_id, coalesce(sum(tf), 0)::double as len from documents left join tf on tf.doc_id = documents.doc_id group by documents.doc_id),
stat as (select count(*)::double as n, avg(len) as mean from len),
df as (select term, ln(1 + ((select n from stat) - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf group by term),
hit as (
  select q.doc_id as query_id, tf.doc_id, round(sum(q.tf * df.idf * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * len.len / (select mean from stat)))), 6) as score
  from tf q join df on df.term = q.term join tf on tf.term = q.term join len on len.doc_id = tf.doc_id
  where q.doc_id % 100 = 0 group by q.doc_id, tf.doc_id
)
select query_id, rank, doc_id, score from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from hit) where rank <= 10
"""
