"""A maintained collection of embeddings: versioned tables, a graph index, checks, and a healer that works on them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import vectors as V
from corvane.operators import health, hnsw, knn, sampling
from corvane.operators.store import Conflict, Store

SNAPSHOT = (
    "id bigint, recall double, mean_distance double, p95_distance double, skew double, dead double, shift double, ann double, mismatch double, "
    "index_exists boolean, index_used boolean, status string, issues array<string>, note string"
)
LOG = "query_id bigint, result_ids array<bigint>, distances array<double>, latency_ms double, source string"


class Collection:
    """``documents(id, category, body, embedding, model_version)`` and what is kept about them, in one store.

    ``embed`` makes a vector column of a text column; ``model`` is the label of its vectors. The index is the graphs'
    adjacency with the version of the documents that it was built from, and the parameters.
    """

    def __init__(self, spark: SparkSession, root: str, embed: Callable, model: str, m: int = 16, width: int = 64):
        self.spark, self.store, self.embed, self.model = spark, Store(spark, root), embed, model
        self.m, self.width = m, width
        self.backups: dict[int, list[DataFrame]] = {}
        self.events: list[dict] = []  # of all healers, so that a plan that failed is remembered

    # -- contents --
    def documents(self) -> DataFrame:
        return self.store.read("documents")

    def load(self, rows: DataFrame) -> None:
        """Truncate, and load ``rows(id, category, body)`` with fresh vectors; index and canaries are made anew by the caller."""
        made = rows.withColumn("embedding", self.embed(F.col("body"))).withColumn("model_version", F.lit(self.model))
        self.store.reload("documents", made)

    def change(self, rows: DataFrame, touched: int) -> None:
        """A new version of the documents, in which ``touched`` rows were written."""
        self.store.write("documents", rows, superseded=touched)

    def build_index(self, m: int | None = None, width: int | None = None) -> int:
        made = hnsw.adjacency(self.documents(), key="id", m=m or self.m, width=width or self.width)
        at = self.store.fingerprint("documents")
        self.store.write("index", made.withColumn("built_from", F.lit(at)).withColumn("m", F.lit(m or self.m)).withColumn("width", F.lit(width or self.width)), superseded=0)
        return 0

    def drop_index(self) -> None:
        self.store.write("index", self.spark.createDataFrame([], "shard bigint, id bigint, layer int, neighbours array<bigint>, built_from int, m int, width int"), superseded=0)

    def index(self) -> dict | None:
        """The index' parameters; None if there is none."""
        if not self.store.manifest("index")["live"]:
            return None
        r = self.store.read("index").agg(F.max("m").alias("m"), F.max("width").alias("width"), F.max("built_from").alias("built_from")).first()
        return r.asDict()

    # -- search --
    def search(self, queries: DataFrame, k: int = 10, exact: bool = False, log: str | None = None) -> DataFrame:
        """``(query_id, rank, id, distance)``; by the index if there is one and ``exact`` isn't asked for. ``log``: also keep it, under this source."""
        if queries.where(V.is_zero(F.col("embedding"))).limit(1).count():
            raise ValueError("a query has no word that is known: its vector is zero")
        began = time.perf_counter()
        made = self.index()
        if exact or made is None:
            found = knn.exact_knn(self.documents(), queries, k, key="id")
        else:
            found = hnsw.ann_knn(self.documents(), queries, k, key="id", m=made["m"], width=made["width"]).drop("steps", "path")
        if log is None:
            return found
        rows = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "distance"))).alias("r"))
        rows = rows.select("query_id", F.transform("r", lambda x: x["id"]).alias("result_ids"), F.transform("r", lambda x: x["distance"]).alias("distances"))
        self.store.append("query_log", rows.withColumn("latency_ms", F.lit((time.perf_counter() - began) * 1000)).withColumn("source", F.lit(log)))
        return found

    # -- checks --
    def set_canaries(self, probes: DataFrame, k: int = 10) -> None:
        """Freeze the exact answers of ``probes(id, text)``."""
        self.store.reload("canaries", health.build_canaries(self.documents(), probes.withColumn("embedding", self.embed(F.col("text"))), k))

    def snapshots(self) -> DataFrame:
        return self.store.read("health_snapshots") if self.store.manifest("health_snapshots")["dir"] else self.spark.createDataFrame([], SNAPSHOT)

    def check(self, note: str = "") -> dict:
        """Measure everything once, classify it, and keep it as a snapshot."""
        docs, canaries = self.documents(), self.store.read("canaries")
        now = health.canary_recall(docs, canaries).agg(F.avg("recall").alias("recall"), F.avg("nearest").alias("mean"), F.expr("percentile_disc(0.95) within group (order by nearest)").alias("p95")).first()
        first = self.snapshots().agg(F.min_by("mean_distance", "id").alias("mean"), F.min_by("ann", "id").alias("ann"), F.max("id").alias("last")).first()
        made = self.index()
        ann = 1.0
        if made is not None:
            probes = sampling.hashed_sample(docs.select("id", "embedding"), "id", health.PROBES, "probe")
            exact = knn.exact_knn(docs, probes, 10, key="id")
            ann = health_mean(knn.distance_recall(exact, self.search(probes)))
        m = {
            "recall": now["recall"], "skew": health.version_skew(docs, self.model), "dead": self.store.dead_pct("documents"),
            "shift": health.shift_pct(first["mean"], now["mean"]), "index_exists": made is not None, "index_used": made is not None, "ann": ann,
            "mismatch": health.sentinel_mismatch(docs, self.embed, self.model), "baseline": first["ann"] if first["ann"] is not None else 1.0,
        }
        status, issues = health.classify(**m)
        row = {"id": (first["last"] or 0) + 1, "mean_distance": now["mean"], "p95_distance": now["p95"], "status": status, "issues": issues, "note": note} | {k: v for k, v in m.items() if k != "baseline"}
        self.store.append("health_snapshots", self.spark.createDataFrame([row], SNAPSHOT))
        return row

    # -- repairs --
    def act(self, action: str, event: int) -> int:
        """Run one action of a plan; the number of rows that it repaired."""
        if action == "REBUILD_INDEX":
            return self.build_index()
        if action == "VACUUM":
            self.store.compact("documents")
            return 0
        version = self.store.fingerprint("documents")
        repair = health.reembed_stale if action == "REEMBED_STALE" else health.repair_vectors
        fixed, backup = repair(self.documents(), self.embed, self.model)
        name = f"backup_{event}_{len(self.backups.get(event, []))}"
        self.store.write(name, backup)
        kept = self.store.read(name)
        n = kept.count()
        if n:
            try:
                self.store.write("documents", fixed, superseded=n, expect=version)
            except Conflict as e:
                raise health.Transient(str(e)) from e
            self.backups.setdefault(event, []).append(kept)
        return n

    def undo(self, event: int) -> None:
        for backup in reversed(self.backups.pop(event, [])):
            self.change(health.rollback(self.documents(), backup), backup.count())

    def healer(self, **more) -> health.Healer:
        return health.Healer(health.Hooks(check=self.check, act=self.act, undo=self.undo, compact=lambda: self.store.compact("documents"), now=time.time), events=self.events, **more)


def health_mean(recalls: DataFrame) -> float:
    got = recalls.agg(F.avg("recall")).first()[0]
    return 1.0 if got is None else got
