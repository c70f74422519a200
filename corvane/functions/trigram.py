"""Trigram similarity of short texts, as sets of padded three-letter sequences."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the lower-cased words, each padded by two blanks before and one behind."""
    ws = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(ws, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; two texts without any have 0."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(F.array_union(x, y)).cast("double")), F.lit(0.0))


def _grams(text: str) -> list[str]:
    return [p[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for p in [f"  {w} "] for i in range(len(p) - 2)]


def word_similarity_of(needle: str | None, hay: str | None) -> float:
    """The best similarity of the needle's trigrams with those of any run of trigrams in the other text."""
    want = set(_grams(needle or ""))
    grams = _grams(hay or "")
    if not want:
        return 0.0
    # Runs that begin and end with a wanted trigram are enough: any other run only adds unwanted ones.
    at = [i for i, g in enumerate(grams) if g in want]
    best = 0.0
    for k, i in enumerate(at):
        seen: set[str] = set()
        hits = 0
        end = i
        for j in at[k:]:
            for g in grams[end : j + 1]:
                if g not in seen:
                    seen.add(g)
                    hits += g in want
            end = j + 1
            best = max(best, hits / (len(want) + len(seen) - hits))
            if len(seen) - hits > len(want) / max(best, 1e-9):  # no longer run can be better
                break
    return best


@F.arrow_udf(DoubleType())
def word_similarity(needle: pa.Array, hay: pa.Array) -> pa.Array:
    return pa.array([word_similarity_of(a.as_py(), b.as_py()) for a, b in zip(needle, hay, strict=True)], pa.float64())
