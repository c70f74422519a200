"""Faults in a small collection are found, repaired and verified."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import embedders
from corvane.functions import vectors as V
from corvane.operators import faults
from corvane.operators.healing import Collection


@pytest.fixture(scope="module")
def collection(spark, tmp_path_factory):
    c = Collection(spark, str(tmp_path_factory.mktemp("healing")), embedders.hashed(), "hash-1")
    rows = [(i, f"topic{i % 6}", f"topic{i % 6} word{i} word{i % 11} and more{i * 7 % 13}") for i in range(120)]
    c.load(spark.createDataFrame(rows, "id bigint, category string, body string"))
    c.set_canaries(spark.createDataFrame([(i, f"topic{i} word{i}") for i in range(6)], "id bigint, text string"))
    c.build_index()
    assert c.check("first")["status"] == "HEALTHY"
    return c


def test_healthy_is_left_alone(collection):
    assert collection.healer().cycle()["outcome"] == "NO_ACTION"


def test_labelled_drift_is_embedded_again(collection):
    collection.change(faults.permutation(collection.documents(), 25, "a", "other"), 30)
    out = collection.healer().cycle()
    assert "VERSION_SKEW" in out["before"]["issues"] and out["outcome"] == "SUCCEEDED" and out["event"]["affected"] == 30
    assert out["actions"] == ("REEMBED_STALE", "VACUUM") and out["after"]["recall"] == 1.0


def test_silent_corruption_is_scanned_for(collection):
    collection.change(faults.noise(collection.documents(), 50, "b", 0.3), 60)
    out = collection.healer().cycle()
    assert "VECTOR_MISMATCH" in out["before"]["issues"] and out["outcome"] == "SUCCEEDED" and out["event"]["affected"] == 60


def test_missing_index_is_built(collection):
    collection.drop_index()
    out = collection.healer().cycle()
    assert out["before"]["status"] == "CRITICAL" and out["outcome"] == "SUCCEEDED" and collection.index()["m"] == 16


def test_bloat_is_compacted(collection):
    for _ in range(2):
        collection.change(collection.documents(), 120)
    out = collection.healer().cycle()
    assert out["before"]["issues"] == ["TABLE_BLOAT"] and out["outcome"] == "SUCCEEDED" and collection.store.dead_pct("documents") == 0


def test_failed_verification_rolls_back_to_the_broken_rows(collection):
    broken = faults.permutation(collection.documents(), 25, "c", "other")
    collection.change(broken, 30)
    before = {r["id"]: r["model_version"] for r in collection.documents().collect()}
    h = collection.healer()
    check = h.hooks.check
    h.hooks.check = lambda: {**check(), "issues": ["VERSION_SKEW"]}  # as if the repair didn't help
    assert h.cycle()["outcome"] == "ROLLED_BACK"
    assert {r["id"]: r["model_version"] for r in collection.documents().collect()} == before
    h.hooks.check = check
    assert h.cycle()["outcome"] == "ESCALATED"
    assert collection.healer(cooldown=0).cycle()["outcome"] == "SUCCEEDED"


def test_logged_search_and_zero_query(collection, spark):
    q = spark.createDataFrame([(1, "topic3 word3")], "id bigint, text string").withColumn("embedding", embedders.hashed()(F.col("text")))
    exact = [r["id"] for r in collection.search(q, 5, exact=True).orderBy("rank").collect()]
    found = [r["id"] for r in collection.search(q, 5, log="test").orderBy("rank").collect()]
    assert len(set(exact) & set(found)) >= 4 and collection.store.read("query_log").first()["result_ids"] == found
    zero = q.withColumn("embedding", F.transform(V.doubles(F.col("embedding")), lambda x: x * 0))
    with pytest.raises(ValueError):
        collection.search(zero)
