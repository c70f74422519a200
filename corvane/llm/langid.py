"""Language ID by n-gram filters that answer for all languages at once.

One Bloom filter per language, kept bit-sliced: slot i of the table holds a word whose bit l is bit i
of language l's filter; for each further 64 languages there is one more table. Looking an n-gram up at its k slots and taking the AND of the words gives the
set of all languages that contain it. Over a text, a population count for each language gives the
share of its n-grams that the language knows; it is corrected for the share that the filter, as full
as it is, would affirm by chance. The largest corrected share decides and is the score.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import bounded_batches, without

N = 4
SLOTS = 1 << 20
#: Bound of the training sample: labelled rows of one language, about as many by a hash of the text.
SAMPLE = 4000
#: An n-gram belongs to a language if it is seen there as often as this, and this share of its most frequent use.
LEAST, SHARE = 3, 0.05
#: Languages that are bits of one word. The model takes SLOTS words for each started WORD_BITS languages.
WORD_BITS = 64


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _grams(text: str) -> np.ndarray:
    """A hash of each n-gram of the lower-cased letters; a run of anything else is one blank. Empty without letters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.empty(0, np.uint64)
    c = np.where(letter, c, 32)
    before = np.concatenate([[False], letter[:-1]])
    c = np.concatenate([[32], c[letter | before], [32] * (N - 1)]).astype(np.uint64)
    h = np.zeros(len(c) - N + 1, np.uint64)
    for i in range(N):
        h = h * np.uint64(0x100000001B3) + c[i : i + len(h)]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    return h


def _slots(h: np.ndarray) -> tuple[np.ndarray, ...]:
    low, mask = h & np.uint64(0xFFFFFFFF), np.uint64(SLOTS - 1)
    return tuple(((low + np.uint64(i) * (h >> np.uint64(32))) & mask).astype(np.int64) for i in range(3))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # rows of SLOTS words; bit l of a word of row r: language WORD_BITS * r + l
    chance: np.ndarray  # by language: the probability that its filter affirms an n-gram it doesn't contain

    def predict(self, text: str | None) -> tuple[str, float]:
        h = _grams(text) if text else np.empty(0, np.uint64)
        return self.predict_grams(h) if len(h) and self.languages else ("und", 0.0)

    def predict_grams(self, h: np.ndarray) -> tuple[str, float]:
        a, b, c = _slots(h)
        seen = []
        for words in self.table:
            found = words[a] & words[b] & words[c]
            seen += [np.count_nonzero(found & words.dtype.type(1 << i)) for i in range(min(WORD_BITS, len(self.languages) - len(seen)))]
        known = np.clip((np.array(seen) / len(h) - self.chance) / (1 - self.chance), 0, 1)
        best = int(known.argmax())  # of ties the first in the order of the names
        return self.languages[best], round(float(known[best]), 6)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn filters from ``labelled``: rows with null text or language are passed over, other columns unread.

    Of each language a share of rows is taken that is expected to give ``sample`` of them, by a hash
    of the text, so equal rows are in or out together and the choice doesn't depend on partitions.
    That bounds the sample in expectation; a text that very many rows have is in with all of them or none.
    The n-gram counts and the filters' slots are made by aggregations; the driver gets the table at most, SLOTS
    words for each started WORD_BITS languages. No labelled row gives a model that says ``und``.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.where(f"`{text}` is not null and `{lang}` is not null").select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l"))
    sizes = rows.groupBy("l").count().orderBy("l").collect()  # a row a language
    if not sizes:
        return Model([], np.zeros((1, SLOTS), np.uint64), np.zeros(0))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["l"], sample / r["count"])])
    taken = rows.where(F.xxhash64(F.col("t"), F.lit("sample")) / 2.0**64 + 0.5 < F.element_at(share, F.col("l")))

    def count(batches):
        for b in batches:
            langs, texts = b.column("l").to_pylist(), b.column("t").to_pylist()
            for one in sorted(set(langs)):
                h, n = np.unique(np.concatenate([_grams(t) for x, t in zip(langs, texts, strict=True) if x == one]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["l", "h", "n"])

    counts = taken.mapInArrow(count, "l string, h bigint, n bigint").groupBy("l", "h").agg(F.sum("n").alias("n"))
    total = F.create_map(*[F.lit(x) for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect() for x in (r["l"], float(r["n"]))])
    bit = F.create_map(*[F.lit(x) for i, r in enumerate(sizes) for x in (r["l"], i)])
    rated = counts.withColumn("rate", F.col("n") / F.element_at(total, F.col("l")))
    most = rated.groupBy("h").agg(F.max("rate").alias("most"))
    kept = rated.join(most, "h").where(f"n >= {LEAST} and rate >= {SHARE} * most").withColumn("i", F.element_at(bit, F.col("l")))
    kept = kept.select("h", F.expr(f"i div {WORD_BITS}").alias("row"), F.expr(f"shiftleft(1L, i % {WORD_BITS})").alias("bit"))
    bits = kept.groupBy("h", "row").agg(F.bit_or("bit").alias("bits"))

    def slots(batches):
        for b in batches:
            h = b.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            for s in _slots(h):
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(s), b.column("bits")], names=["row", "slot", "bits"])

    got = bits.mapInArrow(slots, "row bigint, slot bigint, bits bigint").groupBy("row", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    kind = next((k for k, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(sizes) <= n), np.uint64)
    table = np.zeros((-(-len(sizes) // WORD_BITS), SLOTS), kind)
    table[got["row"].to_numpy(), got["slot"].to_numpy()] = got["bits"].to_numpy().view(np.uint64).astype(kind)
    full = np.array([np.count_nonzero(table[i // WORD_BITS] & kind(1 << i % WORD_BITS)) / SLOTS for i in range(len(sizes))])
    return Model([r["l"] for r in sizes], table, full**3)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` (string) and ``score`` (double, 0 to 1) for the whole of each ``text``.

    ``und`` and 0 where the text is null or has no letter. Columns with these names are replaced,
    the others stay as they are; no row is dropped.
    """
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # SLOTS words: its size doesn't depend on the data

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(text: pa.Array) -> pa.Array:
        got = [shared.value.predict(t.as_py()) for t in text]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["lang_pred", "score"])

    kept = without(df, "lang_pred", "score")
    got = df.select(*[kept[c] for c in kept.columns], predict.asNondeterministic()(F.col(f"`{text}`")).alias("__got"))
    return got.select(*[F.col(f"`{c}`") for c in kept.columns], F.col("__got.lang_pred").alias("lang_pred"), F.col("__got.score").alias("score"))


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves no remainder at 5; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit_documents(documents: DataFrame) -> Model:
    """The model of the contract: learnt from documents that aren't held out (a null id is neither)."""
    return fit(documents.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
