"""Words of many texts at once: found and hashed with array operations, whole documents a piece."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute

from corvane.llm.sets import mixed

#: Bytes of text that are cut at once, whole documents each; bytes whose running sums are held at once.
PIECE = 1 << 18
SEGMENT = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.isin(np.arange(256), (32, *range(9, 14)))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(1)
def _short() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, SEGMENT), _powers(_INVERSE, SEGMENT)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64; only SEGMENT of them are kept from call to call."""
    if n <= SEGMENT:
        up, down = _short()
        return up[:n], down[:n]
    return _powers(_BASE, n), _powers(_INVERSE, n)


def pieces(batches):
    """``(ids, where each text begins and ends, the lower-cased bytes of all)`` of batches ``(id, text)``; rows with a null are left out.

    Texts are taken together up to PIECE bytes; one that is longer comes alone, as a whole.
    """
    for b in batches:
        keep = pa.compute.and_(b.column(0).is_valid(), b.column(1).is_valid())
        ids, texts = b.column(0).filter(keep).to_numpy(zero_copy_only=False), b.column(1).filter(keep).cast(pa.large_string())
        if not len(ids):
            continue
        offset = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(ids) + 1]
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        i = 0
        while i < len(ids):
            j = max(i + 1, int(np.searchsorted(offset, offset[i] + PIECE, "right")) - 1)
            yield ids[i:j], offset[i : j + 1] - offset[i], _LOWER[data[offset[i] : offset[j]]]
            i = j


def hashed(at: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a piece begin, and their hashes.

    A word's hash is a difference of running sums of its bytes times powers of a base, shifted back to the first power. The sums
    start anew in each segment of about SEGMENT bytes, cut between words, so that a long text takes no more for them than a short one.
    """
    n = len(text)
    filled = ~_BLANK[text]
    edge = np.zeros(n + 1, bool)  # where a document begins
    edge[at] = True
    begins, ends = filled.copy(), filled.copy()
    begins[1:] &= ~filled[:-1] | edge[1:n]
    ends[:-1] &= ~filled[1:] | edge[1:n]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = np.empty(len(begins), np.uint64)
    i = 0
    while i < len(begins):
        low = begins[i]
        j = max(i + 1, int(np.searchsorted(ends, low + SEGMENT - 1, "right")))
        high = ends[j - 1]
        up, down = powers(int(high - low) + 1)
        total = np.empty(high - low + 1, np.uint64)
        total[0] = 0
        np.cumsum((text[low:high] + np.uint64(1)) * up[:-1], dtype=np.uint64, out=total[1:])
        first = begins[i:j] - low
        h[i:j] = mixed((total[ends[i:j] - low] - total[first]) * down[first])
        i = j
    return begins, h
