"""Nearest neighbours: exact, by quantised codes in two stages, and measures of them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import vectors as V

#: Query vectors in one broadcast block.
BLOCK = 2000
#: Queries of the code lanes in one broadcast block, cells of one matrix of their distances, intervals of a dimension in ``scale``.
CODE_BLOCK, TILE, BINS = 30_000, 1_000_000, 1024


def _matrix(col: pa.Array, n: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.empty((0, 0))


def exact_knn(corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", digits: int = 6, ties: bool = False) -> DataFrame:
    """The ``k`` nearest by cosine distance: ``(query_id, rank, <key>, distance)``.

    Distances are rounded to ``digits``, ties go by key; ``ties``: rows at the k-th distance all stay. The queries go out in
    blocks of BLOCK vectors; each task multiplies its rows with a block and keeps its best k, so that what is
    shuffled is k rows a query and task, and never a pair of every query and row.
    """
    rows = corpus.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), V.doubles(F.col(vector)).alias("v"))
    ids = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), V.doubles(F.col(vector)).alias("v"))
    spark = corpus.sparkSession
    blocks, block = [], []
    for r in ids.toLocalIterator():
        block.append((r["id"], r["v"]))
        if len(block) == BLOCK:
            blocks.append(block)
            block = []
    blocks += [block] if block or not blocks else []
    out = None
    for block in blocks:
        shared = spark.sparkContext.broadcast((np.array([b[0] for b in block], np.int64), np.array([b[1] for b in block], np.float64)))  # BLOCK vectors at most
        part = rows.mapInArrow(_nearest(shared, k, digits), "query_id bigint, id bigint, distance double")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    place = F.rank().over(Window.partitionBy("query_id").orderBy("distance")) if ties else F.row_number().over(order)
    return out.withColumn("rank", place.cast("bigint")).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "distance")


def _nearest(shared, k: int, digits: int):
    def run(batches):
        qid, q = shared.value
        if not len(qid):
            return
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), V.TINY)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v = _matrix(b.column(1), n)
            ids = b.column(0).to_numpy()
            d = np.round(1 - (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), V.TINY)) @ q.T, digits) + 0.0
            kth = np.partition(d, min(k, n) - 1, axis=0)[min(k, n) - 1]
            row, col = np.nonzero(d <= kth)
            yield pa.RecordBatch.from_arrays([pa.array(qid[col]), pa.array(ids[row]), pa.array(d[row, col])], names=["query_id", "id", "distance"])

    return run


def scale(corpus: DataFrame, vector: str = "embedding", low: float = 0.005, high: float = 0.995, least: float = 1e-4) -> DataFrame:
    """``(dim, lo, hi)``: the codes' range in each dimension, from interpolated percentiles; hi is above lo by ``least``.

    The percentiles are exact: counts by BINS intervals of each dimension show which intervals hold the values on both sides of
    a percentile, and only the values of those intervals are shuffled, equal ones of a batch as one row.
    """
    spark = corpus.sparkSession
    rows = corpus.where(F.col(vector).isNotNull()).select(V.doubles(F.col(vector)).alias("v"))
    ends = rows.mapInArrow(_ends, "dim bigint, lo double, hi double").groupBy("dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    dims = max((r["dim"] for r in ends), default=-1) + 1
    span = np.zeros((2, dims))
    for r in ends:
        span[:, r["dim"]] = r["lo"] or 0.0, r["hi"] or 0.0
    shared = spark.sparkContext.broadcast(span)  # two numbers a dimension
    counts = np.zeros((dims, BINS + 1), np.int64)
    for r in rows.mapInArrow(_histogram(shared), "dim bigint, bin bigint, n bigint").groupBy("dim", "bin").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["dim"], r["bin"]] = r["n"]
    upto = counts.cumsum(axis=1)
    wanted, places = np.zeros((dims, BINS + 1), bool), {}
    for d in range(dims):
        for name, share in (("lo", low), ("hi", high)):
            at = (int(upto[d, -1]) - 1) * share
            places[d, name] = at
            wanted[d, np.searchsorted(upto[d], [math.floor(at), math.ceil(at)], "right")] = True if upto[d, -1] else False
    chosen = spark.sparkContext.broadcast((span, wanted))  # a bit for each interval of each dimension
    found: dict[int, list[tuple[float, int, int]]] = {d: [] for d in range(dims)}
    for r in rows.mapInArrow(_of_bins(chosen), "dim bigint, bin bigint, x double, n bigint").groupBy("dim", "bin", "x").agg(F.sum("n").alias("n")).orderBy("dim", "bin", "x").toLocalIterator():
        found[r["dim"]].append((r["x"], r["bin"], r["n"]))

    def value(d: int, place: int) -> float:
        last, within = None, 0
        for x, b, n in found[d]:
            within = n if b != last else within + n
            last = b
            if (upto[d, b - 1] if b else 0) + within > place:
                return x
        raise ValueError("the table changed meanwhile")

    def percentile(d: int, name: str) -> float:
        at = places[d, name]
        a, b = math.floor(at), math.ceil(at)
        return value(d, a) if a == b else (b - at) * value(d, a) + (at - a) * value(d, b)

    out = [(d, percentile(d, "lo"), percentile(d, "hi")) for d in range(dims) if upto[d, -1]]
    return spark.createDataFrame(out, "dim bigint, lo double, hi double").select("dim", "lo", F.greatest("hi", F.col("lo") + least).alias("hi"))


def _values(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and value of each component that isn't null."""
    size = col.value_lengths().to_numpy(zero_copy_only=False)
    flat = col.flatten()
    dim = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    there = flat.is_valid().to_numpy(zero_copy_only=False)
    return dim[there], flat.drop_null().to_numpy(zero_copy_only=False)


def _ends(batches):
    for b in batches:
        dim, x = _values(b.column(0))
        if not len(dim):
            continue
        n, sure = int(dim.max()) + 1, np.isfinite(x)
        lo, hi = np.full(n, np.inf), np.full(n, -np.inf)
        np.minimum.at(lo, dim[sure], x[sure])
        np.maximum.at(hi, dim[sure], x[sure])
        lo, hi = (pa.array(y, mask=~np.isfinite(y)) for y in (lo, hi))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), lo, hi], names=["dim", "lo", "hi"])


def _bins(span: np.ndarray, dim: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The interval of each value, in the values' order; NaN, the largest, has the last for itself."""
    lo, width = span[0][dim], np.maximum((span[1] - span[0])[dim], V.TINY)
    with np.errstate(invalid="ignore", over="ignore"):
        at = np.clip((x - lo) / width * BINS, 0, BINS - 1)
    return np.where(np.isnan(x), BINS, np.nan_to_num(at)).astype(np.int64)


def _histogram(shared):
    def run(batches):
        span = shared.value
        counts = np.zeros(span.shape[1] * (BINS + 1), np.int64)
        for b in batches:
            dim, x = _values(b.column(0))
            counts += np.bincount(dim * (BINS + 1) + _bins(span, dim, x), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at // (BINS + 1)), pa.array(at % (BINS + 1)), pa.array(counts[at])], names=["dim", "bin", "n"])

    return run


def _of_bins(chosen):
    def run(batches):
        span, wanted = chosen.value
        for b in batches:
            dim, x = _values(b.column(0))
            at = _bins(span, dim, x)
            hit = wanted[dim, at]
            got = pa.table({"dim": dim[hit], "bin": at[hit], "x": x[hit] + 0.0}).group_by(["dim", "bin", "x"]).aggregate([([], "count_all")])
            yield from got.rename_columns(["dim", "bin", "x", "n"]).to_batches()

    return run


def with_codes(corpus: DataFrame, ranges: DataFrame, vector: str = "embedding") -> DataFrame:
    """``corpus`` with ``sign_bits`` (array of words) and ``codes`` (array of 0..15). The ranges are one row a dimension."""
    r = ranges.orderBy("dim").collect()
    lo, hi = F.array(*[F.lit(x["lo"]) for x in r]), F.array(*[F.lit(x["hi"]) for x in r])
    return corpus.withColumn("sign_bits", V.sign_words(vector)).withColumn("codes", V.encode(F.col(vector), lo, hi)).withColumn("decoded", V.decode(F.col("codes"), lo, hi))


def two_stage(coded: DataFrame, queries: DataFrame, k: int, candidates: int = 800, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Candidates by sign bits (all ties at the cut), sorted again by the product of query and decoded vector.

    ``(query_id, rank, <key>, hamming, score)``. Queries go out in blocks of CODE_BLOCK. A first pass counts each query's rows by
    distance, which gives the distance of its last candidate; a second one scores the rows up to that distance and keeps a batch's best
    k of a query. So what is shuffled are a few counts and at most k rows of a query and batch, never its candidates.
    """
    spark = coded.sparkSession
    there = coded.where(F.col(vector).isNotNull())
    bits = there.select("sign_bits")
    rows = there.select(F.col(key).cast("bigint").alias("id"), "sign_bits", "decoded")
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), "sign_bits", V.doubles(F.col(vector)).alias("v"))
    out = None
    for ids, signs, vectors in _blocks(asked):
        shared = spark.sparkContext.broadcast(signs)  # CODE_BLOCK queries at most
        counts = bits.mapInArrow(_by_distance(shared, candidates), "q bigint, hamming bigint, n bigint").groupBy("q", "hamming").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("q").orderBy("hamming"))
        last = counts.withColumn("upto", upto).where(F.col("upto") >= candidates).groupBy("q").agg(F.min("hamming").alias("hamming"))
        cut = np.full(len(ids), signs.shape[1] * 64, np.int64)
        for r in last.toLocalIterator():
            cut[r["q"]] = r["hamming"]
        block = spark.sparkContext.broadcast((ids, signs, vectors, cut))  # CODE_BLOCK queries at most
        part = rows.mapInArrow(_scored(block, k), "query_id bigint, id bigint, hamming bigint, score double")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "hamming", "score")


def _blocks(asked: DataFrame):
    """``(ids, sign words, vectors)`` of up to CODE_BLOCK queries at a time; one block without rows if there are none."""
    ids, signs, vectors, any_ = [], [], [], False
    pack = lambda: (np.array(ids, np.int64), np.array(signs, np.int64).reshape(len(ids), -1 if ids else 1), np.array(vectors, np.float64).reshape(len(ids), -1 if ids else 1))
    for r in asked.toLocalIterator(prefetchPartitions=True):
        ids.append(r["id"])
        signs.append(np.array(r["sign_bits"], np.int64))
        vectors.append(np.array(r["v"], np.float64))
        if len(ids) == CODE_BLOCK:
            yield pack()
            ids, signs, vectors, any_ = [], [], [], True
    if ids or not any_:
        yield pack()


def _words(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _distances(words: np.ndarray, signs: np.ndarray):
    """Hamming distances of a few rows at a time to all queries: ``(first row, matrix)``. A matrix stays within TILE cells."""
    step = max(1, TILE // len(signs))
    kind = np.uint8 if signs.shape[1] < 4 else np.uint16
    for i in range(0, len(words), step):
        some = words[i : i + step]
        d = np.bitwise_count(some[:, :1] ^ signs[:, 0]).astype(kind, copy=False)
        for w in range(1, signs.shape[1]):
            d = d + np.bitwise_count(some[:, w : w + 1] ^ signs[:, w])
        yield i, d


def _by_distance(shared, candidates: int):
    def run(batches):
        # As words without a sign: the count of a negative number's bits is that of its absolute value.
        signs = shared.value.view(np.uint64)
        n, top = len(signs), signs.shape[1] * 64 + 1
        if not n:
            return
        counts, cut = np.zeros((n, top), np.int64), np.full(n, top, np.int64)
        tiles, due = 0, 1
        for b in batches:
            for _, d in _distances(_words(b.column(0)).view(np.uint64), signs) if b.num_rows else ():
                # Beyond the distance of the last candidate of the rows so far, none of these rows counts.
                at, q = np.divmod(np.flatnonzero(d <= cut.astype(d.dtype)), d.shape[1])
                if len(q) * 4 > n * top:
                    counts += np.bincount(q * top + d[at, q], minlength=n * top).reshape(n, top)
                else:
                    np.add.at(counts, (q, d[at, q]), 1)
                tiles += 1
                if tiles == due:
                    due *= 2
                    cut = _cut(counts, candidates)
        cut = _cut(counts, candidates)
        q, h = np.nonzero((counts > 0) & (np.arange(top) <= cut[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(h), pa.array(counts[q, h])], names=["q", "hamming", "n"])

    return run


def _cut(counts: np.ndarray, candidates: int) -> np.ndarray:
    """The distance of each query's last candidate, above all if there are fewer."""
    enough = counts.cumsum(axis=1) >= candidates
    return np.where(enough.any(axis=1), enough.argmax(axis=1), counts.shape[1])


def _scored(shared, k: int):
    def run(batches):
        qid, signs, vectors, cut = shared.value
        signs = signs.view(np.uint64)
        for b in batches if len(qid) else ():
            if not b.num_rows:
                continue
            ids, decoded = b.column(0).to_numpy(), _matrix(b.column(2), b.num_rows)
            kept = []
            for i, d in _distances(_words(b.column(1)).view(np.uint64), signs):
                at, q = np.divmod(np.flatnonzero(d <= cut.astype(d.dtype)), d.shape[1])
                if len(q):
                    kept.append(_best(qid, ids, q, at + i, d[at, q].astype(np.int64), _rounded(_products(vectors, decoded, q, at + i)), k))
            if kept:
                q, row, h, score = _best(qid, ids, *(np.concatenate(x) for x in zip(*kept, strict=True)), k)
                yield pa.RecordBatch.from_arrays([pa.array(qid[q]), pa.array(ids[row]), pa.array(h), pa.array(score)], names=["query_id", "id", "hamming", "score"])

    return run


def _products(vectors: np.ndarray, decoded: np.ndarray, q: np.ndarray, row: np.ndarray) -> np.ndarray:
    out = np.empty(len(q))
    for i in range(0, len(q), BLOCK):
        out[i : i + BLOCK] = np.einsum("ij,ij->i", vectors[q[i : i + BLOCK]], decoded[row[i : i + BLOCK]])
    return out


def _rounded(x: np.ndarray) -> np.ndarray:
    """Six decimals, halves away from zero as in SQL."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x)


def _best(qid, ids, q, row, h, score, k: int):
    """The best ``k`` rows of each query: by score, then id."""
    order = np.lexsort((ids[row], -score, qid[q]))
    q, row, h, score = q[order], row[order], h[order], score[order]
    new = np.r_[True, qid[q][1:] != qid[q][:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
    keep = np.arange(len(q)) - first < k
    return q[keep], row[keep], h[keep], score[keep]


def recall(exact: DataFrame, found: DataFrame, key: str = "vec_id") -> DataFrame:
    """``(query_id, recall)``: the share of each query's exact answers that are found; queries without any are left out."""
    e = exact.groupBy("query_id").agg(F.collect_set(key).alias("e"))
    f = found.groupBy("query_id").agg(F.collect_set(key).alias("f"))
    both = e.join(f, "query_id", "left").where(F.size("e") > 0)
    return both.select("query_id", (F.size(F.array_intersect("e", F.coalesce("f", F.expr("cast(array() as array<bigint>)")))) / F.size("e")).alias("recall"))


def distance_recall(exact: DataFrame, found: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """``(query_id, recall)``: found rows no farther than the last exact one, over the number of exact ones."""
    e = exact.groupBy("query_id").agg(F.max("distance").alias("kth"), F.count("*").alias("n"))
    f = found.join(e, "query_id").groupBy("query_id").agg(F.count_if(F.col("distance") <= F.col("kth") + epsilon).alias("hits"))
    return e.join(f, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"))
