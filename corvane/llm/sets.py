"""Sets of word shingles and the exact linking of sets that may be alike."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, components, tidy

K = 5
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: A unit of exact linking holds two blocks of about this many set elements.
BLOCK = 400_000
#: Rows (of three longs) up to which a table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 400_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(h: np.ndarray, k: int = K) -> np.ndarray:
    """The shingles of a word sequence in text order; a shorter sequence is one shingle as a whole, an empty one has none."""
    n = min(k, len(h))
    if not n:
        return h
    s = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        s += h[i : i + len(s)] * _PLACE[i]
    return mixed(s)


def signed(x) -> int:
    """A 64-bit value as a Spark bigint."""
    x = int(x)
    return x - (1 << 64) if x >= 1 << 63 else x


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def links(sets: list[np.ndarray], ids: list[int], label: list[int], asked: list[bool], alone: list[bool], rank: list[int]) -> Iterator[tuple[int, int]]:
    """Pairs of ids of ``sets`` that are alike, of which one is ``asked`` or ``alone``: a forest of those whose labels aren't connected yet,
    and for each that is ``alone`` its partner of the least rank, if that is less than its own.

    Intersections are counted exactly, by an index from the elements to the sets.
    """
    n = len(sets)
    of = {x: i for i, x in enumerate(dict.fromkeys(label))}
    forest, group = Forest(len(of)), [of[x] for x in label]
    size = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    _, element, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(element, kind="stable")
    posting, start = owner[order], np.concatenate([[0], np.cumsum(uses)])
    first = np.concatenate([[0], np.cumsum(size)])
    for x in np.flatnonzero(np.array(asked) | np.array(alone)):
        mine = element[first[x] : first[x + 1]]
        mine = mine[uses[mine] > 1]
        if not len(mine):
            continue
        shared = np.bincount(np.concatenate([posting[start[e] : start[e + 1]] for e in mine]), minlength=n)
        shared[x] = 0
        near = np.flatnonzero(100 * shared >= 75 * (size[x] + size - shared))
        if alone[x]:
            least = min((y for y in near if rank[y] < rank[x]), key=rank.__getitem__, default=None)
            if least is not None:
                yield min(ids[x], ids[least]), max(ids[x], ids[least])
        for y in near:
            if forest.join(group[x], group[y]):
                yield min(ids[x], ids[y]), max(ids[x], ids[y])


ALIKE = "100 * shared >= 75 * (size(sa) + size(sb) - shared)"
#: Bits of one sketch that the other hasn't are elements that the other hasn't: what is alike always passes.
MAY_BE = "7 * (na - bit_count(xa & ~xb) - bit_count(ya & ~yb)) >= 3 * (na + nb) and 7 * (nb - bit_count(xb & ~xa) - bit_count(yb & ~ya)) >= 3 * (na + nb)"
#: Rows of units, and pairs of them, whose sketches are compared at once.
UNIT_ROWS, UNIT_PAIRS = 50_000, 1_000_000
#: Rows of a block of sketches; how many pairs a row, by sketches, are joined with their elements one by one.
SKETCH_ROWS, PAIRS_A_ROW = 8_000, 16
#: The more, the smaller are the parts of pairs whose elements are on disk at once: about k * k of them, k * k being SLICED pairs a set.
SLICED = 3


def sketched(elements: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many different elements each row of 32-bit hashes has, and which of 128 places they take: 64 bits and 64 more."""
    ordered = np.sort(elements, axis=1)
    n = 1 + (ordered[:, 1:] != ordered[:, :-1]).sum(axis=1)
    bit, half = np.uint64(1) << (elements & np.uint32(63)).astype(np.uint64), elements & np.uint32(64) > 0
    x, y = (np.bitwise_or.reduce(np.where(at, bit, np.uint64(0)), axis=1) for at in (~half, half))
    return n, x, y


def link_colliding(
    keys: DataFrame | list[DataFrame],
    sets_of: Callable[[DataFrame | None], DataFrame],
    scratch: Scratch,
    sketches: DataFrame | None = None,
    unlinked: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    done: tuple[DataFrame, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """The sets that are alike (Jaccard 0.75 or more) among those that collide in a key.

    ``keys(key, id)`` has a row for each band of each set and is read twice; of a ``place`` with it the least names a bucket's hub in place of the least id.
    Several tables of keys are gone through one after the other, so that shuffle files of one at a time take disk; tables of ``done`` are dropped then.
    ``sets_of(ids)`` adds the distinct elements ``s`` of each set to ``ids(id)``. Returns ``(components, links)``: ``components(id, component)`` of the sets with a link, ``component`` being the least id
    reachable; ``links(a, b)``, ``a < b``, which connect them. ``sketches(id, rank, n, x, y, doc, start, stop)`` may give the size, the 128 bits (``sketched``) and the place
    of each set: only pairs that these don't rule out are then joined with their elements, which are those of ``sets_of(None)``, of all sets.
    ``unlinked(components, links)`` may add to the components which sets are ``alone``: in the buckets that are compared in full, a partner of lesser
    rank that they don't overlap is given for them too, if there is one. Sets that it says ``opens`` of have theirs compared in any case; those without a link yet are alone.

    Every set of a bucket is compared with the bucket's hub: a bucket of n sets takes n - 1 comparisons, and copies in any
    number are done. The rest is exact too: where sets of a bucket aren't connected by then (or open it), these are
    compared with all others of the bucket, in tasks of two blocks of bounded size: by their sketches first, and by their elements
    pair for pair where a unit has up to PAIRS_A_ROW pairs a row left, as a whole where it has more.
    """
    about = sketches
    end = lambda z: about.select(F.col("id").alias(z), *[F.col(c).alias(f"{c}{z}") for c in "nxy"])
    mets, found_pairs = [], []
    for part in keys if isinstance(keys, list) else [keys]:
        hub = F.min_by("id", "place") if "place" in part.columns else F.min("id")
        hubs = part.groupBy("key").agg(hub.alias("hub"), F.count("*").alias("members")).where("members > 1")
        met = scratch.save(part.select("key", "id").join(hubs, "key"))
        scratch.drop()
        mets.append(met)
        pairs = met.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
        if sketches is not None:
            pairs = pairs.join(end("b"), "b").join(end("a"), "a").where(MAY_BE).select("a", "b")
        found_pairs.append(scratch.save(pairs))
        scratch.drop()
    pairs = found_pairs[0] if len(found_pairs) == 1 else scratch.save(reduce(DataFrame.unionByName, found_pairs).distinct())
    scratch.drop(*done, *(found_pairs if len(found_pairs) > 1 else []))
    if sketches is None:
        sets = scratch.save(sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()))
        about = sets.select("id", F.col("id").alias("rank"), F.size("s").alias("n"))
    else:
        sets = sets_of(None)
    side = lambda x: sets.select(F.col("id").alias(x), F.col("s").alias(f"s{x}"))

    def alike(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` that are; by slices of both their ends, since elements go to disk with them: of the sets as well as of the pairs a part at a time."""
        k = 1 if sketches is None else max(1, math.ceil(math.sqrt(SLICED * pairs.count() / max(1, about.count()))))
        cut = lambda df, x, i: df if k == 1 else df.where(F.pmod(F.xxhash64(x), F.lit(k)) == i)
        out = []
        for i, j in product(range(k), range(k)):
            part = cut(cut(pairs, "a", i), "b", j).join(cut(side("b"), "b", j), "b").join(cut(side("a"), "a", i), "a")
            out.append(scratch.save(part.withColumn("shared", F.size(F.array_intersect("sa", "sb"))).where(ALIKE).select("a", "b")))
            scratch.drop()
        scratch.drop(pairs)
        return reduce(DataFrame.unionByName, out)

    edges = alike(pairs)
    found = scratch.save(components(edges, scratch))
    # Buckets of three or more sets, some of which are still apart.
    labels = found.withColumn("alone", F.lit(False)).withColumn("opens", F.lit(False)) if unlinked is None else scratch.save(unlinked(found, edges))
    hub_labels = found.select(F.col("id").alias("hub"), F.col("component").alias("hub_label"))

    def judged(met: DataFrame) -> DataFrame:
        rows = met.where("members > 2").join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component").join(hub_labels, "hub", "left")
        rows = rows.withColumn("alone", F.coalesce("alone", F.lit(unlinked is not None)))
        rows = rows.withColumn("asked", ((F.col("id") != F.col("hub")) & (F.col("label") != F.coalesce("hub_label", "hub"))) | F.coalesce("opens", F.lit(False)))
        return rows.select("key", "id", "label", "asked", "alone")

    # Table by table again: a key is in one of them only.
    judged_rows = []
    for met in mets:
        judged_rows.append(scratch.save(judged(met)))
        scratch.drop(met)
    # Of buckets with the same members one is enough.
    kinds = reduce(DataFrame.unionByName, judged_rows).groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h"), F.max("asked").alias("open")).where("open")
    kinds = kinds.groupBy("n", "h").agg(F.min("key").alias("key")).select("key", F.col("n").alias("members"))
    if len(mets) > 1:
        kinds = scratch.save(kinds)
        scratch.drop()
    opened = []
    for rows in judged_rows:
        opened.append(scratch.save(rows.join(kinds, "key")))
        scratch.drop(rows)
    left = reduce(DataFrame.unionByName, opened)
    other = F.expr("explode(transform(sequence(0, blocks - 1), x -> struct(least(x, block) as i, greatest(x, block) as j)))")
    dealt = lambda sized: sized.withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))

    def units(dealt: DataFrame, *columns: str) -> DataFrame:
        out = dealt.withColumn("u", other).select("key", "u.i", "u.j", "id", "label", "asked", "alone", "rank", *columns)
        return out.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    more = []
    if sketches is not None:
        sized = dealt(left.withColumn("blocks", F.ceil(F.col("members") / SKETCH_ROWS).cast("int")))
        hits = []
        for i in range(2):  # halves, again for the shuffle files
            half = sized.where(F.pmod(F.xxhash64("key"), F.lit(2)) == i).join(about, "id")
            hits.append(scratch.save(units(half, "n", "x", "y", "doc", "start", "stop").mapInArrow(tidy(_hit), "key bigint, a bigint, b bigint").distinct()))
            scratch.drop()
        hit = scratch.save(reduce(DataFrame.unionByName, hits).distinct())
        scratch.drop(*hits)
        more.append(alike(scratch.save(hit.where("key is null").select("a", "b"))))
        crowded = scratch.save(left.join(hit.where("key is not null").select("key", F.col("a").alias("id")), ["key", "id"], "left_semi"))
        scratch.drop(*opened, hit)
        left, opened = crowded, [crowded]
    if not left.isEmpty():
        sized = left.join(about.select("id", "rank", "n"), "id")
        blocks = sized.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / BLOCK)).cast("int").alias("blocks"))
        split = scratch.save(dealt(sized.join(blocks, "key")))
        more.append(scratch.save(units(split.join(sets, "id"), "s").mapInArrow(tidy(_linked), "a bigint, b bigint")))
        scratch.drop(split)
    scratch.drop(sets, *opened)
    if not more:
        return found, edges
    more = reduce(DataFrame.unionByName, more)
    # The components of what was connected before, by the new links.
    of = lambda x: found.select(F.col("id").alias(x), F.col("component").alias(f"{x}_label"))
    between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    joined = scratch.save(components(between, scratch)).withColumnRenamed("component", "least")
    known = found.unionByName(joined.select("id", F.col("id").alias("component")).join(found.select("id"), "id", "left_anti"))
    known = known.join(joined.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("least", "component").alias("component"))
    return known, edges.unionByName(more)


def _hit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What may be a link to find, by the sketches of units, which come one after the other."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= UNIT_ROWS:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            last = int(_unit_begins(rows)[-1])
            yield _hits(rows.slice(0, last))
            held = [rows.slice(last)]
    if sum(x.num_rows for x in held):
        yield _hits(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _unit_begins(rows: pa.RecordBatch) -> np.ndarray:
    unit = np.stack([rows.column(k).to_numpy().astype(np.int64) for k in range(3)])
    return np.flatnonzero(np.concatenate([[True], (unit[:, 1:] != unit[:, :-1]).any(axis=0)])[: rows.num_rows])


def _hits(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Pairs ``(null, a, b)`` of the units' rows, and rows ``(key, id, null)`` of units that have more than PAIRS_A_ROW pairs a row."""
    total = rows.num_rows
    begins = _unit_begins(rows) if total else np.empty(0, np.int64)
    sizes = np.diff(np.append(begins, total))
    unit = np.repeat(np.arange(len(begins)), sizes)
    begin, size = begins[unit], sizes[unit]
    ids, label, rank, n = (rows.column(k).to_numpy().astype(np.int64) for k in (3, 4, 7, 8))
    asked, alone = (rows.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (5, 6))
    x, y = (rows.column(k).to_numpy().view(np.uint64) for k in (9, 10))
    doc, start, stop = (rows.column(k).to_numpy() for k in (11, 12, 13))
    lacks = lambda a, b: np.bitwise_count(x[a] & ~x[b]).astype(np.int64) + np.bitwise_count(y[a] & ~y[b])
    hit = np.zeros(total, bool)
    count, most = np.zeros(len(begins), np.int64), PAIRS_A_ROW * sizes
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def mark(who: np.ndarray) -> None:
        done = np.concatenate([[0], np.cumsum(size[who])])
        i = 0
        while i < len(who):
            j = max(i + 1, int(np.searchsorted(done, done[i] + UNIT_PAIRS, "right")) - 1)
            w, m = who[i:j], size[who[i:j]]
            a = np.repeat(w, m)
            b = np.repeat(begin[w] - (done[i:j] - done[i]), m) + np.arange(len(a))
            some = (asked[a] & (label[a] != label[b])) | (alone[a] & (rank[b] < rank[a]) & ((doc[b] != doc[a]) | (stop[b] <= start[a])))
            a, b = a[some], b[some]
            least = 3 * (n[a] + n[b])
            near = (7 * (n[a] - lacks(a, b)) >= least) & (7 * (n[b] - lacks(b, a)) >= least)
            a, b = a[near], b[near]
            hit[a] = hit[b] = True
            np.add.at(count, unit[a], 1)
            few = (count <= most)[unit[a]]
            held.append((a[few], b[few]))
            i = j

    mark(np.flatnonzero(asked))
    if total:  # A set that isn't asked finds its partner where the unit has a new link at all.
        mark(np.flatnonzero(alone & ~asked & np.logical_or.reduceat(hit, begins)[unit]))
    a, b = (np.concatenate([np.empty(0, np.int64), *[h[k] for h in held]]) for k in (0, 1))
    few = (count <= most)[unit[a]]
    a, b = ids[a[few]], ids[b[few]]
    a, b = np.minimum(a, b), np.maximum(a, b)
    crowded = np.flatnonzero(hit & (count > most)[unit]) if total else np.empty(0, np.int64)
    columns = [
        pa.concat_arrays([pa.nulls(len(a), pa.int64()), rows.column(0).take(pa.array(crowded)).cast(pa.int64())]),
        pa.array(np.concatenate([a, ids[crowded]])),
        pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(crowded), pa.int64())]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["key", "a", "b"])


def _linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unit, rows = None, []
    out: list[tuple[int, int]] = []

    def flush():
        if len(rows) > 1 and any(r[2] for r in rows):
            ids, label, asked, alone, rank, sets = map(list, zip(*rows, strict=True))
            out.extend(links(sets, ids, label, asked, alone, rank))
        rows.clear()

    for b in batches:
        head = [b.column(k).to_pylist() for k in range(8)]
        for k, (c, i, j, *row) in enumerate(zip(*head, strict=True)):
            if (c, i, j) != unit:
                flush()
                unit = c, i, j
            rows.append((*row, b.column(8)[k].values.to_numpy(zero_copy_only=False)))
        if out:
            yield _pairs(out)
            out.clear()
    flush()
    yield _pairs(out)


class Bits:
    """A Bloom filter of 64-bit hashes, two bits each. It never misses one; when full, it affirms more that it doesn't hold."""

    MOST, CHUNK = 1 << 28, 1 << 16

    def __init__(self, n: int):
        self.bits = self.CHUNK
        while self.bits < min(self.MOST, 16 * n):
            self.bits <<= 1
        self.table = np.zeros(self.bits // 8, np.uint8)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = np.uint64(self.bits - 1)
        return (h & m).astype(np.int64), ((h >> np.uint64(32)) & m).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        x, y = self.places(h)
        bit = lambda p: self.table[p >> 3] >> (7 - (p & 7)).astype(np.uint8)
        return (bit(x) & bit(y) & 1) == 1

    @classmethod
    def of(cls, hashes: DataFrame, scratch: Scratch) -> Bits:
        """The filter of a column of bigints: filled by chunks on the executors; the driver gets MOST bits at most."""
        hashes = scratch.save(hashes)
        out = cls(hashes.count())
        size, empty = cls.CHUNK, cls(0)
        empty.bits, empty.table = out.bits, None

        def cut(batches):
            for b in batches:
                if b.num_rows:
                    bit = np.unique(np.concatenate(empty.places(b.column(0).to_numpy().view(np.uint64))))
                    chunks, at = np.unique(bit // size, return_index=True)
                    bits = [x.tobytes() for x in np.split((bit % size).astype(np.uint16), at[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(chunks), pa.array(bits, pa.binary())], names=["chunk", "bits"])

        def fill(table: pa.Table) -> pa.Table:
            on = np.zeros(size, np.uint8)
            for x in table["bits"].to_pylist():
                on[np.frombuffer(x, np.uint16)] = 1
            return pa.table({"chunk": table["chunk"][:1], "bits": pa.array([np.packbits(on).tobytes()], pa.binary())})

        got = hashes.mapInArrow(cut, "chunk bigint, bits binary").groupBy("chunk").applyInArrow(fill, "chunk bigint, bits binary").toArrow()
        for c, bits in zip(got["chunk"].to_pylist(), got["bits"].to_pylist(), strict=True):
            out.table[c * size // 8 : (c + 1) * size // 8] = np.frombuffer(bits, np.uint8)
        scratch.drop(hashes)
        return out


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])
