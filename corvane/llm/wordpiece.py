"""Token counts: greedy word-piece lengths by a linear longest-match automaton.

A trie over the vocabulary (pieces that start a word, and pieces that continue one below their own
root) gets failure links: where no piece goes on, the automaton pops the pieces that greedy
longest-match would have cut off the text read so far, and goes on from what is left over. As only
lengths are asked for, a link holds the number of popped pieces in their place, and no piece is built.
Each character is read once and each pop answers for a character, so a word costs linear time.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bounded_batches, without

#: Words are runs of letters, digits and marks, or single other characters that aren't white space.
TOKEN = re.compile(r"\w+|[^\w\s]")
REMEMBERED = 500_000


class Automaton:
    """``first``: pieces that start a word; ``rest``: pieces that continue one."""

    def __init__(self, first, rest):
        # Nodes 0 and 1 are the roots for the start of a word and for its continuation.
        self.to: list[dict[str, int]] = [{}, {}]
        whole = [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                at = root
                for c in piece:
                    at = self.to[at].setdefault(c, len(self.to))
                    if at == len(self.to):
                        self.to.append({})
                        whole.append(False)
                whole[at] = at > 1
        n = len(self.to)
        self.fail: list[int] = [-1] * n
        self.pops: list[int] = [0] * n
        # Breadth first; the links of shorter strings come before those of longer ones.
        queue = [0, 1]
        for u in queue:
            for c, v in self.to[u].items():
                queue.append(v)
                if whole[v]:
                    self.fail[v], self.pops[v] = 1, 1
                    continue
                z, popped = self.fail[u], self.pops[u]
                while z >= 0 and c not in self.to[z]:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.to[z][c], popped

    def count(self, word: str) -> int:
        """The number of pieces of ``word``; -1 if greedy longest-match gets stuck, 0 for the empty word."""
        u, n = 0, 0
        to, fail, pops = self.to, self.fail, self.pops
        for c in word:
            while (v := to[u].get(c)) is None:
                if fail[u] < 0:
                    return -1
                n += pops[u]
                u = fail[u]
            u = v
        while u > 1:
            if fail[u] < 0:
                return -1
            n += pops[u]
            u = fail[u]
        return n


def sentencepiece_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """The pieces of a sentencepiece model as (word starts, continuations); control and byte pieces have no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    pieces = [model.id_to_piece(i) for i in ids]
    return [p[1:] for p in pieces if p[0] == "▁" and len(p) > 1], [p for p in pieces if p[0] != "▁"]


@lru_cache(2)
def _automaton(first: tuple[str, ...], rest: tuple[str, ...]) -> tuple[Automaton, dict[str, int]]:
    return Automaton(first, rest), {}


def count_tokens(df: DataFrame, vocabulary: tuple[list[str], list[str]], text: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``n_tokens`` and ``n_unknown`` (all bigint) of the whole of each ``text``.

    A word that greedy longest-match can't cut wholly into pieces is one unknown token. Null and empty
    texts have zero of each. Columns of ``df`` with these names are replaced; rows and other columns stay.
    """
    bounded_batches(df.sparkSession)
    pieces = df.sparkSession.sparkContext.broadcast(tuple(tuple(sorted(set(p) - {""})) for p in vocabulary))  # a vocabulary: of fixed size

    @F.arrow_udf("struct<n_words: bigint, n_tokens: bigint, n_unknown: bigint>")
    def counts(text: pa.Array) -> pa.Array:
        automaton, known = _automaton(*pieces.value)
        rows: tuple[list[int], ...] = ([], [], [])
        for t in text:
            found = TOKEN.findall(t.as_py() or "")
            n = unknown = 0
            for w in found:
                k = known.get(w)
                if k is None:
                    k = automaton.count(w)
                    if len(w) <= 64:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[w] = k
                if k < 0:
                    unknown += 1
                    k = 1
                n += k
            for col, x in zip(rows, (len(found), n, unknown), strict=True):
                col.append(x)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["n_words", "n_tokens", "n_unknown"])

    own = ("n_words", "n_tokens", "n_unknown")
    kept = without(df, *own)
    counted = df.select(*[kept[c] for c in kept.columns], counts.asNondeterministic()(F.col(f"`{text}`")).alias("__counted"))
    return counted.select(*[F.col(f"`{c}`") for c in kept.columns], *[F.col(f"__counted.{c}").alias(c) for c in own])
