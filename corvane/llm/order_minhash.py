"""Document fingerprints by Order MinHash, with DataFrame functions only.

The k-mers are pairs of neighbouring words (or characters, in runs of more than LONG without a blank), numbered by occurrence so that repeated ones stay apart. Each gets one
random hash. A coordinate j of SKETCHES selects the TUPLE k-mers least by (hash xor j in the top bits), puts them
back into text order and hashes the tuple. The xor is a permutation of the hashes for each j, whose least elements lie
next to each other in the one sorted array of hashes, so that no k-mer is hashed or sorted anew for each coordinate; where
few hashes share j's top bits, the order by xor falls back on their next of kin. Two texts agree in a coordinate
only if the selected k-mers are in both and in the same order, so the share of equal coordinates falls with the edit
distance, and also with moved blocks that leave the set of words as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, without

SKETCHES, TUPLE = 64, 2
#: Words of more code points than this are cut into single ones: texts without blanks.
LONG = 32
#: Ids that share a group of neighbours, and quantiles between which groups have one width.
GROUP, QUANTILES = 512, 1000
#: Groups up to which their table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_GROUPS = 500_000

# A k-mer is one long: 32 bits of hash, 32 bits of position (an array has no more elements).
_HASH, _POS = "-4294967296L", "4294967295L"
_SKETCH_BITS = SKETCHES.bit_length() - 1
_TOP = f"shiftleft(cast(j as bigint), {64 - _SKETCH_BITS})"
_FLIP = f"({_TOP} ^ shiftleft(1L, 63))"


def fingerprint(df: DataFrame, text: str, to: str) -> DataFrame:
    """``df`` with ``to``, the SKETCHES coordinates (array<int>) of the whole of ``text``.

    Null is as the empty text; one or no word, and texts of few k-mers, have coordinates of fewer k-mers than
    TUPLE. Equal texts have equal coordinates. White space only separates words.
    """
    w, h, g, b, s = (f"__{x}_{to}" for x in ("w", "h", "g", "b", "s"))
    blank = r"' \t\n\u000B\f\r'"
    split = rf"split({w}, '[ \\t-\\r]+')"
    cut = f"flatten(transform({split}, x -> if(char_length(x) > {LONG}, regexp_extract_all(x, '(?s)(.)', 1), array(x))))"
    steps = {
        w: f"trim(both {blank} from coalesce(`{text}`, ''))",
        h: rf"transform(if({w} = '', cast(array() as array<string>), if({w} rlike '[^ \\t-\\r]{{{LONG + 1}}}', {cut}, {split})), x -> xxhash64(x))",
        # sorted by hash, then by position
        g: f"sort_array(transform(if(size({h}) < 2, {h}, zip_with(slice({h}, 1, size({h}) - 1), slice({h}, 2, size({h}) - 1), (x, y) -> xxhash64(x, y))),"
        f" (x, i) -> (x & {_HASH}) | cast(i as bigint)))",
        # where runs of equal k-mers begin
        b: f"if(size({g}) = 0, cast(array() as array<int>), filter(sequence(0, size({g}) - 1), i -> i = 0 or shiftright({g}[i], 32) <> shiftright({g}[greatest(i - 1, 0)], 32)))",
    }
    for name, sql in steps.items():
        df = df.withColumn(name, F.expr(sql))
    number = f"if(size({b}) = 0, cast(array() as array<int>), flatten(zip_with({b}, concat(slice({b}, 2, size({b})), array(size({g}))), (x, y) -> sequence(0, y - x - 1))))"
    df = df.withColumn(s, F.expr(f"sort_array(zip_with({g}, {number}, (x, o) -> (xxhash64(x & {_HASH}, o) & {_HASH}) | (x & {_POS})))"))
    df = df.withColumn(b, F.expr(f"transform({s}, x -> cast(shiftrightunsigned(x, {64 - _SKETCH_BITS}) as int))"))
    least = f"transform(slice(sort_array(transform({s}, x -> x ^ {_FLIP})), 1, {TUPLE}), x -> x ^ {_FLIP})"
    near = f"if(p > 0 and p < size({s}) and {b}[cast(least(p, size({b}) - 1) as int)] = j, slice({s}, cast(p as int), {TUPLE}), {least})"
    pick = f"transform(array(array_position({b}, j)), p -> {near})[0]"
    ordered = f"if(size(q) < 2 or (q[0] & {_POS}) <= (q[1] & {_POS}), q, reverse(q))"
    hashed = f"cast(shiftright(xxhash64(transform({ordered}, x -> x & {_HASH})), 32) as int)"
    picked = f"if(size({s}) = 0, array_repeat(0, {SKETCHES}), transform(transform(sequence(0, {SKETCHES - 1}), j -> {pick}), q -> {hashed}))"
    return df.withColumn(to, F.expr(picked)).drop(w, h, g, b, s)


def likeness(a: str, b: str) -> Column:
    """The share of equal coordinates."""
    return F.expr(f"size(filter(zip_with({a}, {b}, (x, y) -> x = y), z -> z)) / cast({SKETCHES} as double)")


def as_text(a: str) -> Column:
    return F.expr(f"array_join(transform({a}, x -> lpad(lower(hex(x & 4294967295L)), 8, '0')), '')")


def with_next(df: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """``df`` with ``next_<c>`` for each of ``columns``: c of the next row by descending key; after the last, of the first.

    Null keys come last; rows with one key are in descending order of ``columns[0]``. The rows are dealt into groups of
    about GROUP neighbouring keys, of equal width between two of QUANTILES quantiles of all keys, so that outlying keys
    don't put the others into one group. A copy of each group's first row also goes to the group before it, so
    that one shuffle serves all and no task sees more than its groups.
    """
    scratch = Scratch(df.sparkSession)
    n = max(df.count(), 1)
    q = max(1, min(QUANTILES, n // GROUP))
    found = df.agg(F.percentile_approx(key, [i / q for i in range(q)], 10 * QUANTILES), F.max(key)).first()
    bounds = sorted(set(found[0] or [0]))
    parts = -(-n // (q * GROUP))  # groups between two bounds, of equal width
    ends = F.lit([*bounds, (found[1] or 0) + 1])
    at = F.size(F.filter(F.lit(bounds), lambda x: x <= F.col(key)))
    low, high = (F.element_at(ends, at + i).cast("decimal(20,0)") for i in (0, 1))
    within = F.floor((F.col(key).cast("decimal(20,0)") - low) / F.greatest(F.lit(1), F.ceil((high - low) / parts))).cast("bigint")
    group = F.when(F.col(key).isNull(), F.lit(-1).cast("bigint")).otherwise(at * F.lit(parts + 1) + within)
    down = Window.orderBy(F.col("group").desc())
    firsts = df.groupBy(group.alias("group")).agg(F.max(key).alias("first"))
    before = F.coalesce(F.lag("group").over(down), F.min("group").over(Window.partitionBy()))
    firsts = scratch.save(firsts.select(F.col("first").alias("__first"), F.col("group").alias("__own"), before.alias("__before")))
    hint = F.broadcast if firsts.count() <= BROADCAST_GROUPS else (lambda x: x)
    dealt = df.withColumn("__group", group).join(hint(firsts), (F.col("__group") == F.col("__own")) & F.col(key).eqNullSafe(F.col("__first")), "left")
    place = F.array(F.struct(F.col("__group").alias("g"), F.lit(0).alias("copy")))
    also = F.array(F.struct(F.col("__before").alias("g"), F.lit(1).alias("copy")))
    dealt = dealt.withColumn("__at", F.explode(F.when(F.col("__before").isNull(), place).otherwise(F.concat(place, also)))).drop("__own", "__first", "__before", "__group")
    w = Window.partitionBy("__at.g").orderBy("__at.copy", F.col(key).desc_nulls_last(), F.col(columns[0]).desc_nulls_last())
    return dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).where("__at.copy = 0").drop("__at")


def edits(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, as the contract has them.

    The edited text ends, in place of its last floor(n_chars / 3) code points, with the first as many of the next
    document by descending doc_id. Null texts are empty; an empty table gives an empty one.
    """
    d = fingerprint(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "fp")
    d = with_next(d, ["text", "fp"])
    n = F.char_length("text").cast("bigint")
    third = F.floor(F.col("n_chars") / 3).cast("int")
    d = d.withColumn("n_chars", n).withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring("next_text", F.lit(1), third)))
    d = d.drop("text", "next_text").withColumn("edited_sha256", F.sha2("edited", 256))
    d = fingerprint(d, "edited", "edited_fp")
    return d.select(
        "doc_id", "n_chars", "edited_sha256", as_text("fp").alias("fingerprint"), as_text("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
    )
