"""Rules of health, plans and the healer."""

import pytest

from corvane.operators import health
from corvane.operators.health import Healer, Hooks, classify, plan


def test_recall():
    assert health.recall_at_k([1, 2, 3, 4], [2, 4, 8, 9]) == 0.5
    assert health.recall_at_k([], [1]) is None


def test_nearest_rank():
    assert health.nearest_rank(range(1, 13), 0.95) == 12
    assert health.nearest_rank([5.0], 0.5) == 5.0


@pytest.mark.parametrize(
    ("measures", "status", "issues"),
    [
        ((1.0, 0, 0, 0, True, True), "HEALTHY", []),
        ((1.0, 0, 0, 0, False, False), "CRITICAL", ["INDEX_MISSING"]),
        ((1.0, 0, 0, 0, True, False), "WARNING", ["INDEX_NOT_USED"]),
        ((1.0, 33, 30, 25, True, True), "DEGRADED", ["VERSION_SKEW", "TABLE_BLOAT", "DISTANCE_DRIFT"]),
        ((0.5, 0, 0, 0, True, True), "CRITICAL", ["LOW_RECALL"]),
        ((1.0, 0, 0, -40, True, True), "HEALTHY", []),
        ((1.0, 0, 0, 0, True, True, 0.6), "DEGRADED", ["INDEX_DEGRADED"]),
        ((1.0, 0, 0, 0, True, True, 1.0, 3.0), "DEGRADED", ["VECTOR_MISMATCH"]),
        ((1.0, 0, 0, 0, False, False, 0.2), "CRITICAL", ["INDEX_MISSING"]),
        ((1.0, 0, 0, 0, True, True, 0.96, 0.0, 0.97), "HEALTHY", []),
        ((1.0, 0, 0, 0, True, True, 0.96, 0.0, 1.0), "DEGRADED", ["INDEX_DEGRADED"]),
        ((1.0, 0, 0, 0, True, True, 0.85, 0.0, 0.88), "DEGRADED", ["INDEX_DEGRADED"]),
    ],
)
def test_classify(measures, status, issues):
    assert classify(*measures) == (status, issues)


@pytest.mark.parametrize(
    ("issues", "actions", "open_"),
    [
        ([], (), ()),
        (["INDEX_NOT_USED"], (), ()),
        (["VERSION_SKEW"], ("REEMBED_STALE", "VACUUM"), ()),
        (["LOW_RECALL", "VERSION_SKEW", "DISTANCE_DRIFT", "TABLE_BLOAT"], ("REEMBED_STALE", "VACUUM"), ()),
        (["LOW_RECALL", "VECTOR_MISMATCH"], ("REPAIR_VECTORS", "VACUUM"), ()),
        (["INDEX_MISSING", "INDEX_NOT_USED"], ("REBUILD_INDEX",), ()),
        (["INDEX_DEGRADED", "LOW_RECALL"], ("REBUILD_INDEX",), ()),
        (["TABLE_BLOAT", "INDEX_MISSING", "VERSION_SKEW", "VECTOR_MISMATCH"], ("REEMBED_STALE", "REPAIR_VECTORS", "REBUILD_INDEX", "VACUUM"), ()),
        (["TABLE_BLOAT"], ("VACUUM",), ()),
        (["LOW_RECALL", "DISTANCE_DRIFT"], ("SCAN_VECTORS", "VACUUM"), ("DISTANCE_DRIFT", "LOW_RECALL")),
        (["INDEX_MISSING", "LOW_RECALL"], ("SCAN_VECTORS", "REBUILD_INDEX", "VACUUM"), ("LOW_RECALL",)),
    ],
)
def test_plan(issues, actions, open_):
    made = plan(issues)
    assert made.actions == actions
    assert tuple(sorted(made.investigating)) == open_


def test_signature():
    assert plan(["VERSION_SKEW"]).signature == plan(["VERSION_SKEW", "LOW_RECALL"]).signature
    assert plan(["VERSION_SKEW"]).signature != plan(["TABLE_BLOAT"]).signature


class World:
    """A store of issues that actions clear."""

    def __init__(self, checks, rows=3, error=None):
        self.checks, self.rows, self.error, self.undone, self.clock, self.done = list(checks), rows, error, [], 1000.0, []

    def healer(self):
        def act(action, event):
            self.done.append(action)
            if self.error and action in self.error:
                raise self.error[action]
            return self.rows

        return Healer(Hooks(lambda: {"issues": self.checks.pop(0)}, act, self.undone.append, lambda: self.done.append("COMPACT"), lambda: self.clock))


def test_healthy_does_nothing():
    w = World([[]])
    assert w.healer().cycle()["outcome"] == "NO_ACTION" and not w.done


def test_success():
    w = World([["VERSION_SKEW"], []])
    h = w.healer()
    assert h.cycle()["outcome"] == "SUCCEEDED" and w.done == ["REEMBED_STALE", "VACUUM"] and not w.undone


def test_failed_verification_is_rolled_back_and_blocks_the_plan():
    w = World([["VECTOR_MISMATCH"], ["VECTOR_MISMATCH"], ["VECTOR_MISMATCH"], ["VECTOR_MISMATCH"], []])
    h = w.healer()
    assert h.cycle()["outcome"] == "ROLLED_BACK" and w.undone == [1]
    assert h.cycle()["outcome"] == "ESCALATED"
    w.clock += 4000
    assert h.cycle()["outcome"] == "SUCCEEDED"


def test_residual_symptom():
    assert World([["VERSION_SKEW", "LOW_RECALL"], ["LOW_RECALL"]]).healer().cycle()["outcome"] == "PARTIAL"
    assert World([["LOW_RECALL"], ["LOW_RECALL"]], rows=0).healer().cycle()["outcome"] == "ESCALATED"
    assert World([["LOW_RECALL"], []]).healer().cycle()["outcome"] == "SUCCEEDED"


def test_failures():
    w = World([["VERSION_SKEW"], ["VERSION_SKEW"]], error={"VACUUM": RuntimeError("disk")})
    h = w.healer()
    out = h.cycle()
    assert out["outcome"] == "FAILED" and w.undone == [1] and not out["event"]["transient"]
    assert h.cycle()["outcome"] == "ESCALATED"
    w = World([["VERSION_SKEW"], ["VERSION_SKEW"], []], error={"REEMBED_STALE": health.Transient("locked")})
    h = w.healer()
    assert h.cycle()["event"]["transient"]
    w.error = None
    assert h.cycle()["outcome"] == "SUCCEEDED"


def test_lost_store_is_recovered():
    w = World([["VERSION_SKEW"], ["VERSION_SKEW"], []], error={"VACUUM": health.Lost("away")})
    h = w.healer()
    assert h.cycle()["outcome"] == "INTERRUPTED" and h.events[0]["status"] == "RUNNING"
    w.error = None
    out = h.cycle()
    assert out["recovered"] == [1] and w.undone == [1] and out["outcome"] == "SUCCEEDED"


def test_crash_after_open_is_recovered():
    w = World([["VERSION_SKEW"], ["VERSION_SKEW"], []])
    h = w.healer()
    h.hooks.crash = lambda point: (_ for _ in ()).throw(KeyboardInterrupt(point))
    with pytest.raises(KeyboardInterrupt):
        h.cycle()
    h.hooks.crash = lambda _: None
    assert h.cycle()["recovered"] == [1]


def test_one_at_a_time():
    h = World([]).healer()
    h.running = True
    assert h.cycle()["outcome"] == "SKIPPED"


def test_until_stable():
    w = World([["VERSION_SKEW", "LOW_RECALL"], ["LOW_RECALL"], ["LOW_RECALL"], [], []])
    assert [x["outcome"] for x in w.healer().until_stable()] == ["PARTIAL", "SUCCEEDED", "NO_ACTION"]
