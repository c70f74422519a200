"""What the training-data operators share: durable tables, word rules, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words. ``bytes.split`` cuts at exactly the bytes that WORD leaves out."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only where both are unset and the master is local, as in tests, one is made; on a cluster that's an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
        known = spark.sparkContext.getCheckpointDir()
    return known


#: Rows of an Arrow batch between executors and Python: texts may be long, and both sides hold whole batches.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to BATCH_ROWS, if they are more; results don't depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def release() -> None:
    """Give memory that a Python worker has freed back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc(), "malloc_trim", None)
    if trim:
        trim(0)


@lru_cache(1)
def _libc():
    return ctypes.CDLL(None)


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``f`` for mapInArrow, with ``release`` at the end of each task."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor costs no recomputation of them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/corvane-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back."""
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._corvane_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables of ``save`` that nothing reads any more, and let shuffle files of finished plans go."""
        for df in tables:
            path = getattr(df, "_corvane_path", None)
            if path:
                target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        # Spark deletes shuffle files once the driver's collector finds them unused. Listeners hold the last plan until they have seen another.
        self.spark.range(0, 1, 1, 1).collect()
        with contextlib.suppress(Exception):  # it may take longer than they wait
            self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        self.spark._jvm.System.gc()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of undirected ``edges(a long, b long)``.

    Returns ``(id, component)`` for every end of an edge that isn't a loop; ``component`` is the
    smallest id reachable. Alternates the large-star and small-star steps until the edges are a
    forest of stars: the groups are reduced by ``min`` before the shuffle, so a hub of any degree
    is one row a task, and nothing is gathered on the driver but a count and a checksum.
    Null ends are ignored; no edges give no rows.
    """
    e = scratch.save(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        new = scratch.save(small)
        scratch.drop(e)
        e = new
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    stars = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return stars.unionByName(roots)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names, whatever their case: an operator's own columns replace them."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in taken])


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
