"""Embedders: functions from a text column to unit vectors. Anything with this form can take their place."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: Words of a vocabulary up to which a matrix of all pairs is made in each task.
GRAM = 1000


def hashed(dim: int = 64, salt: str = "", never_zero: bool = False) -> Callable[[Column], Column]:
    """Signed feature hashing of words: deterministic, without a model file.

    A text without words, or whose words cancel out, gives a zero vector; with ``never_zero``, as for texts that are stored, it counts as one word.
    """

    @F.arrow_udf("array<double>")
    def embed(text: pa.Array) -> pa.Array:
        known: dict[str, tuple[int, float]] = {}
        out = []
        for t in text:
            v = np.zeros(dim)
            body = t.as_buffer().to_pybytes().decode(errors="replace") if t.is_valid else ""  # as_py() fails on bytes that aren't UTF-8
            for w in WORD.findall(body.lower()):
                if w not in known:
                    h = int.from_bytes(hashlib.blake2b((salt + w).encode(), digest_size=8).digest(), "little")
                    known[w] = (h % dim, 1.0 if h >> 63 else -1.0)
                i, s = known[w]
                v[i] += s
            if never_zero and not v.any():
                h = int.from_bytes(hashlib.blake2b((salt + body).encode(), digest_size=8).digest(), "little")
                v[h % dim] = 1.0 if h >> 63 else -1.0
            out.append(v / max(float(np.linalg.norm(v)), 1e-12))
        return pa.array([x.tolist() for x in out], pa.list_(pa.float64()))

    return embed


def chunk_text(name: Column, section: Column, body: Column) -> Column:
    """What is embedded of a chunk: name, section and text."""
    return F.concat(name, F.lit(" "), section, F.lit(": "), body)


class TfidfSvd:
    """TF-IDF of the most frequent words, reduced by truncated SVD, unit length. Fit once on a corpus, then transform."""

    def __init__(self, dim: int = 64, vocabulary: int = 5000):
        self.dim, self.vocabulary = dim, vocabulary

    def _counts(self, df: DataFrame, text: str) -> DataFrame:
        from pyspark.ml.feature import RegexTokenizer, StopWordsRemover

        words = RegexTokenizer(inputCol=text, outputCol="__w", pattern=r"\W+").transform(df.na.fill({text: ""}))
        return StopWordsRemover(inputCol="__w", outputCol="__s").transform(words)

    def fit(self, df: DataFrame, text: str = "text") -> TfidfSvd:
        from pyspark.ml.feature import IDF, CountVectorizer
        from pyspark.mllib.linalg import Vectors
        from pyspark.mllib.linalg.distributed import RowMatrix

        words = self._counts(df, text)
        self.counter = CountVectorizer(inputCol="__s", outputCol="__c", vocabSize=self.vocabulary).fit(words)
        counted = self.counter.transform(words)
        self.idf = IDF(inputCol="__c", outputCol="__t").fit(counted)
        rows = self.idf.transform(counted).select("__t").rdd.map(lambda r: Vectors.fromML(r[0]))
        n = len(self.counter.vocabulary)
        if n <= GRAM:
            # One pass over the texts; the iterations of computeSVD would each count all words again.
            values, vectors = np.linalg.eigh(RowMatrix(rows, numCols=n).computeGramianMatrix().toArray())
            size = np.sqrt(np.maximum(values[::-1], 0))
            self.basis = vectors[:, ::-1][:, : self.dim][:, size[: self.dim] > 1e-9 * size[0]]
        else:
            self.basis = RowMatrix(rows).computeSVD(min(self.dim, n), computeU=False).V.toArray()
        return self

    def transform(self, df: DataFrame, text: str = "text", to: str = "embedding") -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        t = self.idf.transform(self.counter.transform(self._counts(df, text))).withColumn("__a", vector_to_array("__t"))
        basis = df.sparkSession.sparkContext.broadcast(self.basis)  # vocabulary x dim

        @F.arrow_udf("array<double>")
        def reduce(a: pa.Array) -> pa.Array:
            x = np.array(a.to_pylist(), float) @ basis.value
            return pa.array((x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).tolist(), pa.list_(pa.float64()))

        return t.withColumn(to, reduce("__a")).drop("__w", "__s", "__c", "__t", "__a")
