"""Health of stored embeddings: measures, issues, plans, repair, verification and rollback."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import vectors as V
from corvane.operators import knn, sampling

# The thresholds of issues, and the healer's limits.
MIN_RECALL, MAX_SKEW, MAX_DEAD, MAX_SHIFT = 0.95, 0.0, 20.0, 20.0
MIN_ANN, ANN_MARGIN, TOLERANCE = 0.90, 0.03, 1e-3
PROBES, SENTINELS, COOLDOWN_S, MOST_CYCLES = 40, 64, 3600, 6

# Issue codes and what answers them: (issue, action, explains symptoms, note).
SYMPTOMS = ("LOW_RECALL", "DISTANCE_DRIFT")
RULES = (
    ("VERSION_SKEW", "REEMBED_STALE", True, "rows carry another model's label: embed them again from their text"),
    ("VECTOR_MISMATCH", "REPAIR_VECTORS", True, "stored vectors disagree with fresh ones: scan all and repair"),
    ("INDEX_MISSING", "REBUILD_INDEX", False, "no valid index: build it"),
    ("INDEX_DEGRADED", "REBUILD_INDEX", True, "the index finds less than exact search: build it again"),
    ("TABLE_BLOAT", "VACUUM", False, "many superseded rows: compact"),
)
ACTIONS = ("REEMBED_STALE", "REPAIR_VECTORS", "SCAN_VECTORS", "REBUILD_INDEX", "VACUUM")
WRITERS = frozenset(ACTIONS[:3])
BLOCKING = ("FAILED", "ROLLED_BACK", "ESCALATED", "PARTIAL")


# -- measures -------------------------------------------------------------------------------------------

def recall_at_k(expected: Iterable, actual: Iterable) -> float | None:
    """The share of the expected that was found; None if nothing is expected."""
    want = set(expected)
    return len(want & set(actual)) / len(want) if want else None


def nearest_rank(values: Iterable[float], fraction: float) -> float:
    v = sorted(values)
    return v[max(0, math.ceil(fraction * len(v)) - 1)]


def classify(recall: float, skew: float, dead: float, shift: float, index_exists: bool, index_used: bool, ann: float = 1.0, mismatch: float = 0.0, baseline: float = 1.0) -> tuple[str, list[str]]:
    """``(status, issues)`` of one set of measures."""
    floor = max(MIN_ANN, baseline - ANN_MARGIN)
    index = "INDEX_MISSING" if not index_exists else "INDEX_DEGRADED" if ann < floor else "INDEX_NOT_USED" if not index_used else None
    tests = {"LOW_RECALL": recall < MIN_RECALL, "VERSION_SKEW": skew > MAX_SKEW, "TABLE_BLOAT": dead > MAX_DEAD, "DISTANCE_DRIFT": shift > MAX_SHIFT, "VECTOR_MISMATCH": mismatch > 0}
    issues = [name for name, found in tests.items() if found] + ([index] if index else [])
    return _status(issues), issues


def _status(issues: list[str]) -> str:
    if not issues:
        return "HEALTHY"
    if {"LOW_RECALL", "INDEX_MISSING"} & set(issues):
        return "CRITICAL"
    return "WARNING" if issues == ["INDEX_NOT_USED"] else "DEGRADED"


def with_health(rows: DataFrame) -> DataFrame:
    """``issues`` and ``status`` for a table of measures (columns as ``classify``'s parameters)."""
    c = F.col
    floor = F.greatest(F.lit(MIN_ANN), c("baseline") - ANN_MARGIN)
    issues = F.array_compact(
        F.array(
            F.when(c("recall") < MIN_RECALL, "LOW_RECALL"), F.when(c("skew") > MAX_SKEW, "VERSION_SKEW"), F.when(c("dead") > MAX_DEAD, "TABLE_BLOAT"),
            F.when(c("shift") > MAX_SHIFT, "DISTANCE_DRIFT"), F.when(c("mismatch") > 0, "VECTOR_MISMATCH"),
            F.when(~c("index_exists"), "INDEX_MISSING").when(c("ann") < floor, "INDEX_DEGRADED").when(~c("index_used"), "INDEX_NOT_USED"),
        )
    )
    bad = F.array_contains("issues", "LOW_RECALL") | F.array_contains("issues", "INDEX_MISSING")
    status = F.when(F.size("issues") == 0, "HEALTHY").when(bad, "CRITICAL").when((F.size("issues") == 1) & F.array_contains("issues", "INDEX_NOT_USED"), "WARNING").otherwise("DEGRADED")
    return rows.withColumn("issues", issues).withColumn("status", status)


def version_skew(docs: DataFrame, current: str) -> float:
    got = docs.agg(F.count("*").alias("n"), F.count_if(~F.col("model_version").eqNullSafe(F.lit(current))).alias("stale")).first()
    return 100.0 * got["stale"] / got["n"] if got["n"] else 0.0


def shift_pct(baseline: float | None, now: float) -> float:
    """How far a mean distance moved from its first value, in percent."""
    return 100.0 * (now - baseline) / baseline if baseline else 0.0


Embedder = Callable[[Column], Column]


def off_by(docs: DataFrame, embed: Embedder) -> DataFrame:
    """``docs`` with ``fresh``, the body's embedding, and ``off``, its cosine distance to the stored one: 0 if both are zero, 1 if one is."""
    stored, fresh = V.doubles(F.col("embedding")), F.col("fresh")
    off = F.when(V.is_zero(stored) & V.is_zero(fresh), 0.0).when(V.is_zero(stored) | V.is_zero(fresh), 1.0).otherwise(V.cosine_distance(stored, fresh))
    return docs.withColumn("fresh", embed(F.col("body"))).withColumn("off", off)


def sentinel_mismatch(docs: DataFrame, embed: Embedder, current: str, n: int = SENTINELS, seed: str = "") -> float:
    """Percent of a seeded sample of current rows whose stored vector isn't what their text gives."""
    rows = sampling.hashed_sample(docs.where(F.col("model_version") == current), "id", n, seed)
    got = off_by(rows, embed).agg(F.count("*").alias("n"), F.count_if(F.col("off") > TOLERANCE).alias("bad")).first()
    return 100.0 * got["bad"] / got["n"] if got["n"] else 0.0


def build_canaries(docs: DataFrame, probes: DataFrame, k: int = 10) -> DataFrame:
    """``(id, embedding, expected, corpus_max_id)`` of ``probes(id, embedding)``: their exact neighbours now, and the corpus' horizon."""
    last = docs.agg(F.max("id")).first()[0]
    near = knn.exact_knn(docs, probes, k, key="id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("r"))
    near = near.select(F.col("query_id").alias("id"), F.transform("r", lambda x: x["id"]).alias("expected"))
    return probes.join(near, "id").withColumn("corpus_max_id", F.lit(last))


def canary_recall(docs: DataFrame, canaries: DataFrame, k: int = 10, horizon: bool = True) -> DataFrame:
    """``(id, recall, nearest)`` of each canary; ``horizon``: only rows that were there when it was made."""
    last = canaries.agg(F.max("corpus_max_id")).first()[0] if horizon else None
    near = knn.exact_knn(docs.where(F.col("id") <= last) if horizon and last is not None else docs, canaries.select("id", "embedding"), k, key="id")
    near = near.groupBy("query_id").agg(F.collect_set("id").alias("found"), F.min("distance").alias("nearest"))
    met = canaries.join(near, F.col("query_id") == canaries["id"], "left").where(F.size("expected") > 0)
    return met.select(canaries["id"], (F.size(F.array_intersect("expected", F.coalesce("found", F.expr("cast(array() as array<bigint>)")))) / F.size("expected")).alias("recall"), "nearest")


# -- plans ----------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Plan:
    actions: tuple[str, ...]
    explained: frozenset[str]
    investigating: frozenset[str]
    notes: tuple[str, ...] = ()

    @property
    def signature(self) -> str:
        return f"{','.join(self.actions)}|{','.join(sorted(self.investigating))}"


def plan(issues: Iterable[str]) -> Plan:
    """What to do about issues: data first, then the index, then compaction. Symptoms that no cause explains ask for a scan."""
    seen = set(issues)
    hit = [r for r in RULES if r[0] in seen]
    todo = {r[1] for r in hit}
    open_ = set() if any(r[2] for r in hit) else seen & set(SYMPTOMS)
    notes = [r[3] for r in hit]
    if open_:
        todo.add("SCAN_VECTORS")
        notes.append(f"{', '.join(sorted(open_))} without a known cause: compare every vector with its text")
    if todo & WRITERS and "VACUUM" not in todo:
        todo.add("VACUUM")
        notes.append("repairs supersede rows: compact afterwards")
    return Plan(tuple(a for a in ACTIONS if a in todo), frozenset(r[0] for r in hit), frozenset(open_), tuple(notes))


def signature(issues: Column) -> Column:
    """The signature of ``plan(issues)`` for a column of arrays of issue codes."""
    has = lambda *codes: F.arrays_overlap(issues, F.array(*map(F.lit, codes)))
    explained = has(*[r[0] for r in RULES if r[2]])
    open_ = F.when(explained, F.expr("cast(array() as array<string>)")).otherwise(F.array_sort(F.array_intersect(issues, F.array(*map(F.lit, SYMPTOMS)))))
    asked = {a: has(*[r[0] for r in RULES if r[1] == a]) if a != "SCAN_VECTORS" else F.size(open_) > 0 for a in ACTIONS}
    written = asked["REEMBED_STALE"] | asked["REPAIR_VECTORS"] | asked["SCAN_VECTORS"]
    asked["VACUUM"] = asked["VACUUM"] | written
    actions = F.array_compact(F.array(*[F.when(asked[a], a) for a in ACTIONS]))
    return F.concat(F.array_join(actions, ","), F.lit("|"), F.array_join(open_, ","))


def blocked(events: DataFrame, now: Column, cooldown: int = COOLDOWN_S) -> DataFrame:
    """``(signature, blocked)``: whether the latest finished, not transient event of each plan within the cooldown ended badly."""
    recent = events.where((F.col("status") != "RUNNING") & ~F.coalesce("transient", F.lit(False)) & (F.col("started_at") > now - F.make_dt_interval(secs=F.lit(cooldown))))
    return recent.groupBy("signature").agg(F.max_by("status", "id").isin(*BLOCKING).alias("blocked"))


# -- repairs --------------------------------------------------------------------------------------------

def _repaired(docs: DataFrame, embed: Embedder, wrong: Column, current: str) -> tuple[DataFrame, DataFrame]:
    """(all rows with the wrong ones embedded again, backup of those as ``(id, embedding, model_version, healed)``)."""
    made = off_by(docs, embed).withColumn("__wrong", wrong)
    backup = made.where("__wrong").select("id", "embedding", "model_version", F.col("fresh").alias("healed"))
    fixed = made.withColumn("embedding", F.when(F.col("__wrong"), F.col("fresh")).otherwise(V.doubles(F.col("embedding"))))
    fixed = fixed.withColumn("model_version", F.when(F.col("__wrong"), F.lit(current)).otherwise(F.col("model_version")))
    return fixed.select(*docs.columns), backup


def reembed_stale(docs: DataFrame, embed: Embedder, current: str) -> tuple[DataFrame, DataFrame]:
    return _repaired(docs, embed, ~F.col("model_version").eqNullSafe(F.lit(current)), current)


def repair_vectors(docs: DataFrame, embed: Embedder, current: str) -> tuple[DataFrame, DataFrame]:
    return _repaired(docs, embed, (F.col("model_version") == current) & (F.coalesce("off", F.lit(2.0)) > TOLERANCE), current)


def rollback(docs: DataFrame, backup: DataFrame) -> DataFrame:
    """The backed-up vectors again, where the row still has the healed one; rows that changed since then stay, and each row stays one if ids repeat."""
    b = backup.groupBy(F.col("id").alias("__id"), V.doubles(F.col("healed")).alias("__healed"))
    b = b.agg(F.min(F.struct(V.doubles(F.col("embedding")).alias("old"), F.col("model_version").alias("label"))).alias("__b"))
    met = docs.withColumn("embedding", V.doubles(F.col("embedding"))).join(b, (F.col("id") == F.col("__id")) & (F.col("embedding") == F.col("__healed")), "left")
    back = F.col("__b").isNotNull()
    met = met.withColumn("embedding", F.when(back, F.col("__b.old")).otherwise(F.col("embedding")))
    return met.withColumn("model_version", F.when(back, F.col("__b.label")).otherwise(F.col("model_version"))).select(*docs.columns)


def unchanged(read: DataFrame, now: DataFrame) -> DataFrame:
    """Ids whose text and vector are still those that were read: only these may be written after a long embedding job."""
    mark = lambda df, c: df.select("id", F.md5(F.concat_ws("|", F.md5("body"), F.md5(F.to_json("embedding")))).alias(c))
    return mark(read, "a").join(mark(now, "b"), "id").where("a = b").select("id")


# -- the healer -----------------------------------------------------------------------------------------

class Transient(RuntimeError):
    """A repair that another writer held up; it may be tried again at once."""


class Lost(RuntimeError):
    """The store was lost in the middle of a repair; the next cycle undoes it."""


@dataclass
class Hooks:
    """What a healer works on: each is a function of the caller's store."""

    check: Callable[[], dict]
    act: Callable[[str, int], int]
    undo: Callable[[int], None]
    compact: Callable[[], None]
    now: Callable[[], float]
    crash: Callable[[str], None] = lambda _: None


@dataclass
class Healer:
    """Check, plan, repair, verify; roll back if verification fails. One at a time: ``running`` is the lock."""

    hooks: Hooks
    events: list[dict] = field(default_factory=list)
    running: bool = False
    cooldown: float = COOLDOWN_S

    def _is_blocked(self, signature: str) -> bool:
        since = self.hooks.now() - self.cooldown
        known = [e for e in self.events if e["signature"] == signature and e["status"] != "RUNNING" and not e.get("transient") and e["started_at"] > since]
        return bool(known) and known[-1]["status"] in BLOCKING

    def recover(self) -> list[int]:
        """Undo what a healer that died left running."""
        orphans = [e for e in self.events if e["status"] == "RUNNING"]
        for e in orphans:
            self.hooks.undo(e["id"])
            e |= {"status": "ROLLED_BACK", "transient": True}
        return [e["id"] for e in orphans]

    def cycle(self) -> dict:
        if self.running:
            return {"outcome": "SKIPPED", "actions": ()}
        self.running = True
        try:
            return self._cycle()
        finally:
            self.running = False

    def _cycle(self) -> dict:
        recovered = self.recover()
        before = self.hooks.check()
        todo = plan(before["issues"])
        out = {"outcome": "NO_ACTION", "actions": todo.actions, "before": before, "recovered": recovered, "event": None}
        if not todo.actions:
            return out
        if self._is_blocked(todo.signature):
            return out | {"outcome": "ESCALATED"}
        event = {"id": len(self.events) + 1, "signature": todo.signature, "status": "RUNNING", "started_at": self.hooks.now(), "affected": 0}
        self.events.append(event)
        self.hooks.crash("after_open")
        try:
            for action in todo.actions:
                rows = self.hooks.act(action, event["id"])
                event["affected"] += rows if action in WRITERS else 0
        except Lost:
            return out | {"outcome": "INTERRUPTED", "event": event}
        except Exception as e:  # noqa: BLE001 - every failure of a repair is undone and recorded
            if event["affected"]:
                self.hooks.undo(event["id"])
            event |= {"status": "FAILED", "error": str(e), "transient": isinstance(e, Transient)}
            return out | {"outcome": "FAILED", "event": event}
        self.hooks.crash("after_repair")
        after = self.hooks.check()
        left = set(after["issues"])
        if todo.explained & left:
            status = "ROLLED_BACK"
            if event["affected"]:
                self.hooks.undo(event["id"])
                self.hooks.compact()
        elif set(before["issues"]) & set(SYMPTOMS) & left:
            status = "PARTIAL" if todo.explained or event["affected"] else "ESCALATED"
        else:
            status = "SUCCEEDED"
        event["status"] = status
        return out | {"outcome": status, "after": after, "event": event}

    def until_stable(self, most: int = MOST_CYCLES) -> list[dict]:
        out = []
        for _ in range(most):
            out.append(self.cycle())
            if out[-1]["outcome"] not in ("SUCCEEDED", "PARTIAL"):
                break
        return out
