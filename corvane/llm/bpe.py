"""BPE encoding and decoding.

Encoding backtracks over longest matches. One pass of an Aho-Corasick automaton gives the longest
token that starts at every byte of a piece; a token is put behind its predecessor only if the pair is
compatible, that is, if BPE on the two tokens' bytes alone ends with exactly these two tokens. On a
conflict the token gives way to its longest prefix that is a token, and then to its predecessor.
Each byte position is given up at most once, so the work is linear in the piece, and the one tiling in
which all neighbours are compatible is what merging in rank order yields. Decoding gathers the tokens'
bytes from one buffer by an offset table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bounded_batches, release, without

# How byte-level BPE vocabularies cut text into pieces. Letter runs come first, as the most frequent.
PIECE = r" ?\p{L}++| ?\p{N}++|'(?:s|t|re|ve|m|ll|d)| ?[^\p{White_Space}\p{L}\p{N}]++|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}++"

#: Pieces of up to 64 characters remembered by a worker, in two generations: the older is dropped when the younger is full. The bound
#: is about 20 MB each. As many pairs are remembered.
REMEMBERED = 100_000


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others as the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pieces(dict):
    """The ids of pieces, as decimals joined by commas: one object a piece."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe, self.older = bpe, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = ",".join(map(str, self.bpe.piece(piece.encode()))).encode()
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Bpe:
    """A byte-level BPE vocabulary, built from the text of a tokenizer file."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        as_byte = _byte_of_char()
        raw = lambda s: bytes(as_byte[c] for c in s)
        self.bytes_of = {i: raw(t) for t, i in model["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.merged: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            a, b = model["vocab"][x], model["vocab"][y]
            whole = model["vocab"][x + y]
            self.merged[a << 32 | b] = rank
            self.parts.setdefault(whole, (a, b, rank))
        self.trie = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            self.trie.add_word(b.decode("latin-1"), (i, len(b) - 1))
        self.trie.make_automaton()
        self.shorter = {i: self._longest_prefix(b) for i, b in self.bytes_of.items()}
        self.compatible: dict[int, bool] = {}
        self.pieces = _Pieces(self)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.cut = regex.compile(PIECE).findall
        table = [self.bytes_of.get(i, b"") for i in range(max([*self.bytes_of, *self.added.values()]) + 1)]
        for t, i in self.added.items():
            table[i] = t.encode()
        self.buffer = np.frombuffer(b"".join(table), np.uint8)
        self.sizes = [len(t) for t in table]
        self.length = np.array(self.sizes, np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)[:-1]])

    def _longest_prefix(self, b: bytes) -> int | None:
        return next((i for n in range(len(b) - 1, 0, -1) if (i := self.id_of.get(b[:n])) is not None), None)

    def fits(self, left: int, right: int) -> bool:
        """Whether merging in rank order keeps these two tokens apart."""
        pair = left << 32 | right
        known = self.compatible.get(pair)
        if known is None:
            if len(self.compatible) >= REMEMBERED // 2:
                self.compatible.clear()
            known = self.compatible[pair] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        # Undo merges from the last to the first. At each point the neighbours at the seam must not be
        # a pair that BPE merges before the next of the merges inside the two tokens takes place.
        bound = 1 << 60
        while True:
            seam = self.merged.get(left << 32 | right)
            if seam is not None and seam < bound:
                return False
            l, r = self.parts.get(left), self.parts.get(right)
            if l is None and r is None:
                return True
            if r is None or (l is not None and l[2] > r[2]):
                left, bound = l[1], l[2]
            else:
                # The right token's merge comes at the same rank or later: a seam merge of that very
                # rank lies further left, and so comes first.
                right, bound = r[0], r[2] + 1

    def piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece."""
        whole = self.id_of.get(piece)
        if whole is not None:  # it is the longest match at the first byte and leaves nothing
            return (whole,)
        n = len(piece)
        longest = [-1] * n
        for end, (token, before) in self.trie.iter(piece.decode("latin-1")):
            longest[end - before] = token  # of the matches from one byte on, the longest ends last
        sizes, fits = self.sizes, self.fits
        alive = bytearray(b"\x01" * (n + 1))
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + sizes[token]
            if alive[end] and (not out or fits(out[-1], token)):
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
                continue
            shorter = self.shorter[token]
            if shorter is not None:
                token = shorter
                continue
            alive[at] = 0  # so that the predecessor, taken up again, gives way to a shorter one
            token = out.pop()
            at -= sizes[token]
        return tuple(out)

    def decimals(self, text: str) -> bytes:
        """The ids of a text, as decimals joined by commas."""
        known, parts, at = self.pieces, [], 0
        for start, stop, token in self._added(text):
            parts += [known[p] for p in self.cut(text[at:start] if at or start < len(text) else text)]
            if token is not None:
                parts.append(b"%d" % token)
            at = stop
        return b",".join(parts)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text (int32)."""
        return _numbers(self.decimals(text))

    def _added(self, text: str):
        if self.split is not None and any(t in text for t in self.added):
            for m in self.split.finditer(text):
                yield m.start(), m.end(), self.added[m[0]]
        yield len(text), len(text), None

    def forget(self) -> None:
        """Drop what was remembered."""
        self.pieces.clear()
        self.pieces.older = {}
        self.compatible = {}

    def decode(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        length = self.length[ids]
        ends = np.cumsum(length)
        if not len(ids) or not ends[-1]:
            return b""
        at = np.repeat(self.offset[ids] - (ends - length), length)
        at += np.arange(ends[-1])
        return self.buffer[at].tobytes()


@lru_cache(1)
def _model(spec: str) -> Bpe:
    return Bpe(spec)


KINDS = {
    "ids": (pa.list_(pa.int32()), "array<int>"),
    "n_tokens": (pa.int64(), "bigint"),
    "ids_sha256": (pa.string(), "string"),
    "decoded": (pa.string(), "string"),
    "decoded_sha256": (pa.string(), "string"),
}


def _numbers(decimals: bytes) -> np.ndarray:
    return np.fromstring(decimals, np.int32, sep=",") if decimals else np.empty(0, np.int32)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))


def _coder(df: DataFrame, tokenizer: str, outputs: tuple[str, ...]):
    bounded_batches(df.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size doesn't depend on the data

    @F.arrow_udf("struct<" + ", ".join(f"{k}: {KINDS[k][1]}" for k in outputs) + ">")
    def code(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = _model(spec.value)
        try:
            for text in texts:
                yield columns(bpe, text)
        finally:  # the worker may go on to other work, with little memory to spare
            bpe.forget()
            release()

    def columns(bpe: Bpe, text: pa.Array) -> pa.Array:
        cols: dict[str, list] = {k: [] for k in outputs}
        for t in text:
            decimals = bpe.decimals(t.as_py() or "")
            ids = _numbers(decimals)
            for k, col in cols.items():
                if k == "ids":
                    col.append(ids)
                elif k == "n_tokens":
                    col.append(len(ids))
                elif k == "ids_sha256":
                    col.append(hashlib.sha256(decimals).hexdigest())
                elif k == "decoded":
                    col.append(bpe.decode(ids).decode("utf-8", "replace"))
                else:
                    col.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return pa.StructArray.from_arrays([_lists(v) if k == "ids" else pa.array(v, KINDS[k][0]) for k, v in cols.items()], names=list(cols))

    return code.asNondeterministic()  # so that a filter on what it returns doesn't run it once more


def encode(df: DataFrame, tokenizer: str, text: str = "text", outputs: tuple[str, ...] = ("ids", "n_tokens")) -> DataFrame:
    """``df`` with the columns ``outputs`` (any of KINDS) for the whole of each ``text``.

    Same ids as the tokenizers library gives for ``tokenizer`` without special tokens added, truncation
    or padding; the added tokens' own strings in a text become those tokens. ``decoded`` is what the ids
    decode to. A null or empty text has no ids and decodes to the empty string. Columns of ``df`` with
    the same names are replaced; all others stay, rows are neither dropped nor merged.
    """
    code = _coder(df, tokenizer, outputs)
    kept = without(df, *outputs)
    coded = df.select(*[kept[c] for c in kept.columns], code(F.col(f"`{text}`")).alias("__coded"))
    return coded.select(*[F.col(f"`{c}`") for c in kept.columns], *[F.col(f"__coded.{k}").alias(k) for k in outputs])


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the text of each array of ``ids``; null ids give null, no ids the empty string."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("string")
    def back(ids: pa.Array) -> pa.Array:
        bpe = _model(spec.value)
        return pa.array([None if not x.is_valid else bpe.decode(x.as_py()).decode("utf-8", "replace") for x in ids], pa.string())

    return df.withColumn(to, back(F.col(f"`{ids}`")))
