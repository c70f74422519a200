"""Line dedup by an exact set-similarity join.

A line's set is its distinct words. Equal sets are one class, represented by its first line. The words of each
class are ordered by rarity, counted over all lines in a table of RARITY hashed counters (any fixed order
is exact, a rare-first one is fast), and its prefix is written out: two sets with Jaccard 0.8 or more must share a
word of their prefixes. Within the rows of one word, sorted by size, the length filter bounds the
partners, the positional filter bounds the overlap that is still possible, and a 128-bit parity of the sets bounds their
difference from below. What passes is verified on the full sets. A line is removed if an earlier one, by
(doc_id, line number), matches it.

One match is enough to remove a line, so of each word's partners only BEST are verified at first; lines with more
partners and none verified are compared again for more of them, until none is left, so no match is lost. The rows
of a frequent word are dealt out by their line into units of about UNIT rows, which are compared each in itself at first; lines that
found no match there are then sent to all units of the word. So many lines of one template, most of which have a match in
their own unit, cost work in proportion to their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, bounded_batches, tidy
from corvane.llm.sets import BROADCAST_ROWS, Bits, mixed
from corvane.llm.words import hashed, pieces

#: Jaccard, as a fraction of integers.
NUM, DEN = 4, 5
RARITY = 1 << 19
BEST, MORE, UNIT = 4, 16, 8192
_PART = 1 << 12
#: Classes of rarity: steps of the logarithm to the base 2 of a word's count.
CLASSES, STEPS = 64, 1.5
#: A row of a prefix is one value: 32 bits of the word, 16 of the set's size, 10 of the place, 6 of the class. Larger sets count
#: as of MOST_WORDS; the positional filter passes over places from LAST_PLACE on.
MOST_WORDS, LAST_PLACE = (1 << 16) - 1, (1 << 10) - 1
#: Words of a line are ordered by their class and this many bits of their hash.
BITS = 42
#: Rows that are compared at once, at least; neighbours of a row, by size, that are compared with it before the others.
AT_ONCE, NEIGHBOURS = 20_000, 64


def _pieces(batches):
    """Of some documents at a time: hash and line of each word, the lines' documents and numbers. Lines without words are left out."""
    for ids, at, text in pieces(batches):
        begins, h = hashed(at, text)
        starts = np.unique(np.concatenate([at[:-1], np.flatnonzero(text == 10) + 1]))
        starts = starts[starts < len(text)]
        used, line = np.unique(np.searchsorted(starts, begins, "right") - 1, return_inverse=True)
        doc = np.searchsorted(at, starts[used], "right") - 1
        yield h, line, ids[doc], used - np.searchsorted(starts, at[doc])


def _rarity(texts: DataFrame) -> np.ndarray:
    """Classes of rarity by hash: RARITY counters of the words of all texts, on a logarithmic scale."""

    def count(batches):
        total = np.zeros(RARITY, np.int64)
        for h, _, _, _ in _pieces(batches):
            np.add.at(total, (h & np.uint64(RARITY - 1)).astype(np.int64), 1)
        parts = total.reshape(-1, _PART)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.int64) for x in table["n"].to_pylist()], axis=0)
        return pa.table({"part": table["part"][:1], "n": pa.array([total.tobytes()], pa.binary())})

    got = texts.mapInArrow(tidy(count), "part bigint, n binary").groupBy("part").applyInArrow(add, "part bigint, n binary").toArrow()
    out = np.zeros(RARITY, np.int64)
    for p, n in zip(got["part"].to_pylist(), got["n"].to_pylist(), strict=True):
        out[p * _PART : (p + 1) * _PART] = np.frombuffer(n, np.int64)
    return np.minimum(STEPS * np.log2(out + 1), CLASSES - 1).astype(np.uint8)


def prefix_length(n):
    """How many of its rarest words a set of n must show; sets of up to three words match no other set."""
    return np.where(n > 3, n - (NUM * n + DEN - 1) // DEN + 1, 0)


def _lines(piece, rarity: np.ndarray) -> pa.RecordBatch:
    h, line, doc, number = piece
    kind = rarity[(h & np.uint64(RARITY - 1)).astype(np.int64)].astype(np.uint64)
    word = (kind << np.uint64(BITS)) | (h >> np.uint64(64 - BITS))
    if len(doc) <= 1 << 16:  # line, class and hash in one value
        order = np.argsort((line.astype(np.uint64) << np.uint64(48)) | word)
    else:
        order = np.lexsort((word, line))
    line, word, h, kind = line[order], word[order], h[order], kind[order]
    new = np.concatenate([[True], (word[1:] != word[:-1]) | (line[1:] != line[:-1])]) if len(line) else np.empty(0, bool)
    line, word, h, kind = line[new], word[new], h[new], kind[new]
    n = np.bincount(line, minlength=len(doc))
    start = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    one, two = mixed(h ^ np.uint64(0x8CB92BA72F3D8DD7)), mixed(h ^ np.uint64(0xD1B54A32D192ED03))
    bit = one & np.uint64(127)
    power = np.uint64(1) << (bit & np.uint64(63))
    low, high = np.where(bit < 64, power, np.uint64(0)), np.where(bit < 64, np.uint64(0), power)
    shown = prefix_length(n)
    place = np.arange(len(line)) - start[line]
    in_prefix = place < shown[line]
    size = np.minimum(n, MOST_WORDS).astype(np.uint64)[line[in_prefix]]
    packed = (word[in_prefix] << np.uint64(32)) | (size << np.uint64(16)) | (np.minimum(place[in_prefix], LAST_PLACE).astype(np.uint64) << np.uint64(6)) | kind[in_prefix]
    prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(shown)]).astype(np.int32)), pa.array(packed.view(np.int64)))
    by_line = lambda f, x: pa.array((f.reduceat(x, start) if len(start) else x).view(np.int64))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc, pa.int64()), pa.array(number.astype(np.int32)), by_line(np.add, one), by_line(np.add, two), pa.array(n.astype(np.int32)),
            by_line(np.bitwise_xor, low), by_line(np.bitwise_xor, high), prefix,
        ],
        names=["doc", "line", "s1", "s2", "n", "p0", "p1", "prefix"],
    )


#: Of a packed row: its word, and about how often that occurs in all lines.
TOKEN = "shiftright(key, 32)"
OCCURS = f"pow(2, (key & {CLASSES - 1}) / {STEPS})"


def _size(key):
    return (key >> 16) & MOST_WORDS


def _place_of(key):
    return (key >> 6) & LAST_PLACE


def _gathered(batches, columns: int):
    """The columns of as many batches as have AT_ONCE rows together."""
    got: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            got.append(b)
        if sum(x.num_rows for x in got) >= AT_ONCE:
            yield [np.concatenate([x.column(k).to_numpy() for x in got]) for k in range(columns)]
            got = []
    if got:
        yield [np.concatenate([x.column(k).to_numpy() for x in got]) for k in range(columns)]


def _whole_units(batches, columns: int):
    """Sorted rows ``(unit, key, ...)``: no unit of a word is in two of what is returned."""
    held: list[np.ndarray] | None = None
    for rows in _gathered(batches, columns):
        if held is not None:
            rows = [np.concatenate([x, y]) for x, y in zip(held, rows, strict=True)]
        last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] >> 32 != rows[1][-1] >> 32))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield [x[:cut] for x in rows]
        held = [x[cut:] for x in rows]
    if held is not None:
        yield held


class _Found:
    """Up to ``best`` partners of each row, and how many it has, up to one more."""

    def __init__(self, n: int, best: int):
        self.best, self.n = best, np.zeros(n, np.int64)
        self.of = np.full((n, best), -1, np.int64)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Rows ``x``, each once, with a partner each."""
        n = self.n[x]
        fits = n < self.best
        self.of[x[fits], n[fits]] = y[fits]
        self.n[x] = np.minimum(n + 1, self.best + 1)

    def open(self, x: np.ndarray) -> np.ndarray:
        return self.n[x] <= self.best


def _passes(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Whether rows ``(size, place, p0, p1)`` pass the length, parity and positional filters with their counterparts."""
    both = x[0] + y[0]
    need = (NUM * both + NUM + DEN - 1) // (NUM + DEN)  # the least overlap at this Jaccard
    large = np.maximum(x[0], y[0]) == MOST_WORDS
    fits = DEN * np.minimum(x[0], y[0]) >= NUM * np.maximum(x[0], y[0])
    differ = np.bitwise_count(x[2] ^ y[2]).astype(np.int64) + np.bitwise_count(x[3] ^ y[3])
    far = np.maximum(x[1], y[1]) == LAST_PLACE
    return fits & (large | (differ <= both - 2 * need)) & (far | large | (np.minimum(x[0] - x[1], y[0] - y[1]) + np.minimum(x[1], y[1]) >= need))


def _within(best: int):
    """Of the rows of each unit, sorted by (word, unit, size): partners of each later line that pass the filters."""

    def run(batches):
        for rows in _whole_units(batches, 7):
            edges = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1], [True]]))
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                yield _partners([x[s:e] for x in rows[1:]], best)

    return tidy(run)


def _partners(rows: list[np.ndarray], best: int) -> pa.RecordBatch:
    key, units, p0, p1, doc, line = rows
    n, fields = _size(key), [_size(key), _place_of(key), p0.view(np.uint64), p1.view(np.uint64)]
    take = lambda i: [f[i] for f in fields]
    order = np.lexsort((line, doc))
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[True], (doc[order][1:] != doc[order][:-1]) | (line[order][1:] != line[order][:-1])]))
    found = _Found(len(key), best)
    least = (NUM * n + DEN - 1) // DEN
    first = np.maximum.accumulate(np.searchsorted(key, ((key >> 32) << 32) | (least << 16)))
    at = np.arange(len(key))
    i = at[at > first]
    for d in range(1, NEIGHBOURS + 1):
        if not len(i):
            break
        j = i - d
        later = rank[i] > rank[j]
        x, y = np.where(later, i, j), np.where(later, j, i)
        some = np.flatnonzero(found.open(x) & (rank[x] != rank[y]))
        some = some[_passes(take(x[some]), take(y[some]))]
        for role in (later[some], ~later[some]):
            found.add(x[some[role]], y[some[role]])
        i = i[i - first[i] > d]
    last = np.searchsorted(first, at, "right") - 1
    rest = np.flatnonzero(found.open(at) & ((at - first > NEIGHBOURS) | (last - at > NEIGHBOURS)))
    for x in rest:
        y = np.concatenate([np.arange(first[x], max(first[x], x - NEIGHBOURS)), np.arange(x + NEIGHBOURS + 1, last[x] + 1)])
        y = y[rank[y] < rank[x]]
        for z in y[_passes([f[x] for f in fields], take(y))][: best + 1]:
            found.add(np.array([x]), np.array([z]))
    x, c = np.nonzero(found.of >= 0)
    y = found.of[x, c]
    split = units > 1
    # A line of which the word's other units may hold a match is named along with itself.
    alone = np.flatnonzero(split & (found.n == 0))
    x, y = np.concatenate([x, alone]), np.concatenate([y, alone])
    more = (found.n[x] > best) | split[x]
    return pa.RecordBatch.from_arrays([pa.array(key[x] >> 32), pa.array(doc[x]), pa.array(line[x]), pa.array(doc[y]), pa.array(line[y]), pa.array(more)], names=["token", "xd", "xl", "yd", "yl", "more"])


def _across(best: int):
    """Of the rows of each unit, sorted by (word, unit, side): partners in side 0, all of a unit of a word, of each row of side 1."""

    def run(batches):
        held: list[np.ndarray] | None = None
        for rows in _gathered(batches, 7):
            edges = np.flatnonzero(np.concatenate([[True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] >> 32 != rows[1][:-1] >> 32), [True]]))
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                part = [x[s:e] for x in rows]
                cut = int(np.searchsorted(part[2], 1))
                own = [x[:cut] for x in part]
                if held is not None and held[0][0] == part[0][0] and held[1][0] >> 32 == part[1][0] >> 32:
                    held = [np.concatenate([x, y]) for x, y in zip(held, own, strict=True)]
                else:
                    held = own if cut else None
                if held is not None and cut < e - s:
                    yield _earlier([x[cut:] for x in part], held, best)

    return tidy(run)


def _earlier(xs: list[np.ndarray], ys: list[np.ndarray], best: int) -> pa.RecordBatch:
    split = lambda r: [_size(r[1]), _place_of(r[1]), r[3].view(np.uint64), r[4].view(np.uint64)]
    fx, fy = split(xs), split(ys)
    at, to, more = [], [], []
    for i in range(len(xs[0])):
        earlier = (ys[5] < xs[5][i]) | ((ys[5] == xs[5][i]) & (ys[6] < xs[6][i]))
        y = np.flatnonzero(earlier & _passes([f[i] for f in fx], fy))
        at += [i] * len(y[:best])
        to += y[:best].tolist()
        more += [len(y) > best] * len(y[:best])
    at, to = np.array(at, np.int64), np.array(to, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(xs[1][at] >> 32), pa.array(xs[5][at]), pa.array(xs[6][at]), pa.array(ys[5][to]), pa.array(ys[6][to]), pa.array(more, pa.bool_())], names=["token", "xd", "xl", "yd", "yl", "more"])


#: Stands for a document as such, in the place of a line number.
WHOLE = -1


def _place(doc, line):
    return mixed(mixed(np.asarray(doc).astype(np.int64).view(np.uint64)) + np.asarray(line).astype(np.int64).view(np.uint64))


def _sets(batches, wanted):
    """The sets of the lines of a piece that ``wanted(documents, line numbers)`` holds for."""

    def of(piece):
        h, line, doc, number = piece
        hit = wanted(doc, number)
        if not hit.any():
            return None
        mine = hit[line]
        h, line = h[mine], line[mine]
        order = np.lexsort((h, line))
        h, line = h[order], line[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (line[1:] != line[:-1])])
        h, line = h[new], line[new]
        ends = np.cumsum(np.concatenate([[0], np.bincount(line, minlength=len(doc))[hit]]))
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[hit], pa.int64()), pa.array(number[hit].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int64)))],
            names=["d", "l", "w"],
        )

    return (x for x in map(of, _pieces(batches)) if x is not None)


#: Lines up to which the ones to verify are told apart by a filter; more of them are told by a join.
MOST_FILTERED = Bits.MOST // 16


def _verified(pairs: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``(xd, xl)`` of those of ``pairs(xd, xl, yd, yl, ...)`` whose lines match, by the full sets."""
    ends = scratch.save(pairs.select(F.col("xd").alias("d"), F.col("xl").alias("l")).union(pairs.select("yd", "yl")).distinct())

    def placed(batches):
        for b in batches:
            docs, lines = b.column(0).to_numpy(), b.column(1).to_numpy()
            for h in (_place(docs, lines), np.unique(_place(docs, np.full(len(docs), WHOLE)))):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    kind = "d bigint, l int, w array<bigint>"
    if ends.count() <= MOST_FILTERED:
        filter_ = Bits.of(ends.mapInArrow(placed, "h bigint"), scratch)
        wanted = texts.sparkSession.sparkContext.broadcast(filter_)  # of bounded size

        def some(batches):
            for b in batches:  # documents without any of the lines aren't even cut
                ids = b.column(0).to_numpy(zero_copy_only=False)
                yield b.filter(pa.array(wanted.value.has(_place(ids, np.full(len(ids), WHOLE)))))

        sets = lambda batches: _sets(some(batches), lambda doc, number: wanted.value.has(_place(doc, number)))
        full = texts.mapInArrow(tidy(sets), kind)
    else:
        sets = lambda batches: _sets(batches, lambda doc, number: np.ones(len(doc), bool))
        full = texts.join(ends.select(F.col("d").alias("id")).distinct(), "id", "left_semi").mapInArrow(tidy(sets), kind)
        full = full.join(ends, ["d", "l"], "left_semi")
    full = scratch.save(full)
    x = full.select(F.col("d").alias("xd"), F.col("l").alias("xl"), F.col("w").alias("xw"))
    y = full.select(F.col("d").alias("yd"), F.col("l").alias("yl"), F.col("w").alias("yw"))
    both = pairs.join(x, ["xd", "xl"]).join(y, ["yd", "yl"]).withColumn("shared", F.size(F.array_intersect("xw", "yw")))
    matched = scratch.save(both.where(f"{DEN} * shared >= {NUM} * (size(xw) + size(yw) - shared)").select("xd", "xl").distinct())
    scratch.drop(ends, full)
    return matched


def kept_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, kept)``: the numbers (from 0) of the lines with words that stay, for documents that have any.

    Lines are cut at line feeds; words are ASCII-lower-cased runs of anything but ASCII white space. Null texts and null
    ids have no lines here. Rows with the same id are one document, in which lines of one number are one place. An empty
    table gives an empty one. Words are known by 64 bits of their hash, sets of words by 128.
    """
    bounded_batches(df.sparkSession)
    scratch = Scratch(df.sparkSession)
    texts = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("body")).where("id is not null and body is not null")
    rarity = df.sparkSession.sparkContext.broadcast(_rarity(texts))  # RARITY bytes

    def cut(batches):
        for piece in _pieces(batches):
            yield _lines(piece, rarity.value)

    lines = texts.mapInArrow(tidy(cut), "doc bigint, line int, s1 bigint, s2 bigint, n int, p0 bigint, p1 bigint, prefix array<bigint>")
    first = lines.groupBy("s1", "s2").agg(F.min(F.struct("doc", "line", "n", "p0", "p1", "prefix")).alias("f"))
    classes = scratch.save(first.select("f.*"))
    shown = classes.where("size(prefix) > 0").select(F.explode("prefix").alias("key"), "p0", "p1", "doc", "line").withColumn("token", F.expr(TOKEN))
    # Words with many rows, none of which can be rare: their rows are dealt out to units.
    hot = scratch.save(shown.where(F.expr(OCCURS) * 2 > UNIT).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > UNIT))
    n_hot = hot.count()
    if n_hot:
        shown = shown.join(F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, "token", "left").withColumn("units", F.coalesce(F.ceil(F.col("n") / UNIT), F.lit(1)).cast("int")).drop("n")
    else:
        shown = shown.withColumn("units", F.lit(1))
    own = F.expr("cast(pmod(xxhash64(doc, line), units) as int)")
    pair = "token bigint, xd bigint, xl int, yd bigint, yl int, more boolean"
    columns = ["key", "p0", "p1", "doc", "line"]
    if n_hot:
        near = shown.repartition(F.col("token"), own).withColumn("unit", own).sortWithinPartitions("token", "unit", "key")
    else:
        near = shown.select(*columns).repartition(F.expr(TOKEN)).sortWithinPartitions("key").withColumn("unit", F.lit(0)).withColumn("units", F.lit(1))
    near = near.select("unit", "key", "units", *columns[1:]).mapInArrow(_within(BEST), pair)
    near = scratch.save(near)
    gone, best = None, BEST
    while True:
        pairs = near.where("xd <> yd or xl <> yl").select("xd", "xl", "yd", "yl").distinct()
        matched = _verified(pairs, texts, scratch)
        left = near.where("more").select("token", "xd", "xl").distinct().join(matched, ["xd", "xl"], "left_anti")
        left = scratch.save(left.select("token", F.col("xd").alias("doc"), F.col("xl").alias("line")))
        gone = matched if gone is None else gone.unionByName(matched)
        scratch.drop(near)
        if left.isEmpty():
            break
        # The partners in all units of the lines whose first ones didn't match, more of them each time.
        best *= MORE
        few = left.count() <= BROADCAST_ROWS
        mine = scratch.save(shown.join(F.broadcast(left) if few else left, ["token", "doc", "line"], "left_semi"))
        tokens = scratch.save(mine.select("token").distinct())
        theirs = shown.join(F.broadcast(tokens) if tokens.count() <= BROADCAST_ROWS else tokens, "token", "left_semi")
        both = theirs.select(own.alias("unit"), "key", F.lit(0).alias("side"), "p0", "p1", "doc", "line")
        both = both.unionByName(mine.withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1))).select("unit", "key", F.lit(1).alias("side"), "p0", "p1", "doc", "line"))
        both = both.repartition(F.expr(TOKEN), F.col("unit")).sortWithinPartitions(F.expr(TOKEN), F.col("unit"), F.col("side"))
        near = scratch.save(both.mapInArrow(_across(best), pair))
        scratch.drop(mine, tokens, left)
    gone = gone.select(F.col("xd").alias("doc"), F.col("xl").alias("line"))
    kept = classes.select("doc", "line").join(gone, ["doc", "line"], "left_anti")
    return kept.groupBy(F.col("doc").alias("doc_id")).agg(F.array_sort(F.collect_list("line")).alias("kept"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the removed lines cut out of ``text``, along with their line feeds.

    Lines without words stay. A row with a null key or text stays as it is; no row is dropped, though a text may
    become empty. Other columns don't change.
    """
    kept = kept_lines(df, key, text).select(F.col("doc_id").alias("__id"), F.col("kept").alias("__kept"))

    @F.arrow_udf("string")
    def clean(text: pa.Array, kept: pa.Array) -> pa.Array:
        out = []
        for t, k in zip(text, kept, strict=True):
            stay = set(k.as_py() or ())
            out.append("\n".join(x for i, x in enumerate(t.as_py().split("\n")) if i in stay or not x.encode("utf-8", "replace").split()) if t.is_valid else None)
        return pa.array(out, pa.string())

    joined = df.join(kept, F.col(f"`{key}`") == F.col("__id"), "left")
    return joined.withColumn(text, F.when(F.col(f"`{key}`").isNull(), F.col(f"`{text}`")).otherwise(clean.asNondeterministic()(F.col(f"`{text}`"), F.col("__kept")))).drop("__id", "__kept")


#: For ids from 0 and texts of fewer than a million lines.
SQL = r"""
with ls as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
ln as (select doc_id, unnest(range(0, len(ls))) as line, unnest(ls) as t from ls),
ws as (select doc_id * 1000000 + line as spot, list_sort(list_distinct(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) as w from ln),
cls as (select w, min(spot) as f, len(w) as n from ws where len(w) > 0 group by w),
tok as (select f, n, unnest(w) as t from cls),
df as (select t, count(*) as d from tok group by t),
pre as (select f, n, t from (select f, n, t, row_number() over (partition by f order by d, t) as r from tok join df using (t)) where r <= n - (4 * n + 4) // 5 + 1),
cand as (select distinct a.f as x, b.f as y from pre a join pre b on a.t = b.t and b.f < a.f and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
gone as (select distinct x from (select x, len(list_intersect(a.w, b.w)) as c, a.n + b.n as n from cand join cls a on a.f = x join cls b on b.f = y) where 5 * c >= 4 * (n - c)),
kept as (select f // 1000000 as doc_id, list((f % 1000000)::int order by f) as kept_lines from cls where f not in (select x from gone) group by 1)
select d.doc_id, coalesce(length(text) - length(replace(text, chr(10), '')) + 1, 0)::bigint as n_lines, coalesce(len(kept_lines), 0)::bigint as n_kept, coalesce(kept_lines, []) as kept_lines
from documents d left join kept k on k.doc_id = d.doc_id
"""
