"""Every query outside llm runs, and gives what its SQL gives."""

import hashlib
from pathlib import Path

import duckdb
import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import SF, assert_same

from corvane import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, SF)
    if name in SQL:
        assert_same(df, SQL[name])
    else:
        assert df.columns and df.count() >= 0


def test_names_are_known():
    assert set(SQL) <= set(catalog.queries())


@pytest.mark.parametrize("name", ["t10_dates", "t11_math", "h18_boosts", "p4_changed_keys"])
def test_whole_tables_are_processed(spark, name):
    rows = spark.read.parquet(f"{SF}/{'lineitem' if name == 't11_math' else 'events'}.parquet")
    assert catalog.queries()[name](spark, SF).count() == rows.count()


def test_whole_tables_are_joined(spark, tmp_path):
    spark.createDataFrame([(3, "blue steel"), (20, "Steel, steel rod")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, "steel rod", "LARGE")], "p_partkey bigint, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.queries()["h26_lexical_baseline"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {(3, 7, 1), (20, 7, 2)}
    assert {r[0] % 10 for r in catalog.queries()["j17_bookmarks"](spark, SF).select("user_id").distinct().collect()} == set(range(10))


@pytest.fixture(scope="module")
def wordless(tmp_path_factory):
    """Documents without text or words, and with words of which the hashes cancel out."""
    known, pair = {}, None
    for i in range(1000):
        h = int.from_bytes(hashlib.blake2b(f"w{i}".encode(), digest_size=8).digest(), "little")
        pair = pair or ((known[h % 64, 1 - (h >> 63)], f"w{i}") if (h % 64, 1 - (h >> 63)) in known else None)
        known.setdefault((h % 64, h >> 63), f"w{i}")
    d = str(tmp_path_factory.mktemp("wordless"))
    rows = [(i, [None, "", "?!", " ".join(pair), "some words"][i // 12]) for i in range(60)]
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]}), f"{d}/documents.parquet")
    return d


def same_on(spark, monkeypatch, name, d):
    monkeypatch.setattr(oracle, "SF", d)
    monkeypatch.setattr(oracle, "TABLES", [p.name.removesuffix(".parquet") for p in Path(d).iterdir() if p.suffix == ".parquet"])
    assert_same(catalog.queries()[name](spark, d), SQL[name])


@pytest.mark.parametrize("name", ["a27_inconsistent_rows", "g14_repair_vectors", "g15_rollback", "g25_checked_restore"])
def test_texts_without_a_direction(spark, monkeypatch, wordless, name):
    same_on(spark, monkeypatch, name, wordless)


@pytest.fixture(scope="module")
def odd_texts(tmp_path_factory):
    """Documents of bytes that aren't UTF-8, and such that a permuted vector is the same again."""
    words, pattern, i, sign = {}, [0] * 64, 0, 1
    for k in range(2000):
        h = int.from_bytes(hashlib.blake2b(f"w{k}".encode(), digest_size=8).digest(), "little")
        words.setdefault((h % 64, 1 if h >> 63 else -1), f"w{k}")
    for _ in range(64):
        pattern[i], i = sign, (i + 17) % 64
        sign = -sign if i % 2 == 0 else sign
    same = " ".join(words[i, s] for i, s in enumerate(pattern)).encode()
    d = str(tmp_path_factory.mktemp("odd_texts"))
    text = pa.array([[b"caf\xe9 \xed\xa0\x80 words", b"\xff", same, b"some words"][i // 15] for i in range(60)], pa.binary())
    text = pa.StringArray.from_buffers(len(text), text.buffers()[1], text.buffers()[2])
    pq.write_table(pa.table({"doc_id": pa.array(range(60), pa.int64()), "text": text}), f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["g14_repair_vectors", "g15_rollback", "g25_checked_restore"])
def test_texts_of_any_bytes(spark, monkeypatch, odd_texts, name):
    same_on(spark, monkeypatch, name, odd_texts)


@pytest.fixture(scope="module")
def odd_ids(tmp_path_factory):
    """Documents of which ids are missing, below zero or repeated, with the same and with other texts."""
    d = str(tmp_path_factory.mktemp("odd_ids"))
    ids = [*range(-20, 20), *[None] * 5, *[30] * 8, *[15] * 4]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": [[None, "some words", f"word{i}", ""][i % 4] for i in range(len(ids))]}), f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["g15_rollback", "g25_checked_restore"])
def test_ids_that_repeat_or_are_missing(spark, monkeypatch, odd_ids, name):
    same_on(spark, monkeypatch, name, odd_ids)


@pytest.mark.parametrize("name", ["g22_permuted_vectors", "v2_normalised"])
def test_odd_vectors_keep_signs_and_gaps(spark, tmp_path, name):
    rows = [[0.0] * 64, [1e-7, -1e-7] * 32, [0.5, -0.0] * 32, None, [], [0.125] * 5 + [None] + [0.125] * 58, [None] * 64, [float("nan")] * 64]
    if name == "g22_permuted_vectors":
        rows.append([0.25] * 7)
    pq.write_table(pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32()))}), f"{tmp_path}/embeddings.parquet")
    mine = catalog.queries()[name](spark, str(tmp_path)).toArrow().to_pylist()
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    theirs = con.execute(SQL[name]).to_arrow_table().to_pylist()
    assert sorted(map(str, mine)) == sorted(map(str, theirs))  # as text: minus zero counts


def test_any_word_lane_keeps_frequent_words(spark, monkeypatch, tmp_path):
    pq.write_table(pa.table({"item_id": [1], "text": ["a b alpha beetle"]}), f"{tmp_path}/benchmark.parquet")
    text = ["alpha" if i % 2 else "beetle beetle" for i in range(21_000)]
    pq.write_table(pa.table({"doc_id": range(len(text)), "text": text, "source": text, "lang": text}), f"{tmp_path}/documents.parquet")
    same_on(spark, monkeypatch, "h8_any_word_lane", str(tmp_path))
    assert {r["id"] % 2 for r in catalog.queries()["h8_any_word_lane"](spark, str(tmp_path)).collect()} == {0}


def test_any_word_lane_passes_over_the_words_of_its_sql(spark, monkeypatch, tmp_path):
    pq.write_table(pa.table({"item_id": [1, 2], "text": ["a b have beetle", "a b from when"]}), f"{tmp_path}/benchmark.parquet")
    text = ["have", "beetle", "from", "when", "have beetle when"]
    pq.write_table(pa.table({"doc_id": range(5), "text": text, "source": text, "lang": text}), f"{tmp_path}/documents.parquet")
    same_on(spark, monkeypatch, "h8_any_word_lane", str(tmp_path))
