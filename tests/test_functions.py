"""Text, trigram and vector functions on small inputs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane import catalog
from corvane.functions import embedders, text, trigram, vectors
from corvane.operators import dml, faults, hnsw, knn, procedures, retrieval, sampling
from corvane.operators.store import Conflict, Store
from corvane.sources import readers


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_flags(spark):
    assert one(spark, "use -sU or --script=x, not a-b; see cve-2021-44228 and T1055.012 -", text.extract_flags) == ["--script", "-sU", "CVE-2021-44228", "T1055.012"]
    assert one(spark, None, text.extract_flags) == []


def test_clean(spark):
    assert one(spark, "A (Citation: X) [name](https://x.y) <code>z</code>  \nend ", text.clean) == "A  name `z`\nend"


def test_blocks():
    assert text.split_blocks("a\n\nb\n \nc", 4) == ["a\n\nb", "c"]
    assert text.split_blocks("-a one\n\nmore\n\n--b two", 100, by_option=True) == ["-a one\n\nmore", "--b two"]
    long = text.split_blocks("x" * 50 + "\n" + "y" * 50, 30)
    assert "".join(long) == "x" * 50 + "\n" + "y" * 50 and len(long) == 2
    assert text.split_blocks("z" * 100, 20) == ["z" * 40, "z" * 40, "z" * 20]
    assert text.split_blocks(None) == text.split_blocks("") == []


def test_sections():
    assert text.man_sections("X(1)\nNAME\n  x - does\nSEE ALSO\n  y(1)") == [("name", "  x - does"), ("see also", "  y(1)")]
    assert text.rst_sections("Top\n===\nbody\n\nNext one\n--------\nmore") == [("top", "\nbody\n\n"), ("next one", "\nmore")]
    assert text.rst_sections("plain") == [("overview", "plain")]
    assert text.without_overstrike("N\x08NA\x08A") == "NA"
    assert text.is_redirect(" .so man1/x.1")


def test_display_blocks():
    got = text.display_blocks("Some text that is num-\nber one.\n\n* first\n* second\n  goes on\n\n  $ ls -l\n\nnmap -sS host\n\nTERM\n    its meaning\n\nUsage::")
    assert got[0] == ("p", "Some text that is number one.", "")
    assert [x[0] for x in got] == ["p", "li", "li", "code", "code", "term", "p", "p"] and got[2][1] == "second goes on" and got[-1][1] == "Usage:"
    assert text.display_blocks("T1055 Injection\nPlatforms: Linux\n- one", "attack") == [("term", "T1055 Injection", ""), ("kv", "Linux", "Platforms"), ("li", "one", "")]
    assert text.display_blocks("") == text.display_blocks(None) == []
    assert text.display_blocks("to re-\nmain and well-\nknown things") == [("p", "to remain and well-known things", "")]
    assert text.display_blocks("1. one\n   more\n2. two\n\nNAME\n\n    what it is.") == [("li", "one more", ""), ("li", "two", ""), ("term", "NAME", ""), ("p", "what it is.", "")]
    assert text.display_blocks("  int main(void) {\n    return 0;\n  }") == [("code", "int main(void) {\n  return 0;\n}", "")]


def test_white_space_is_trimmed(spark):
    rows = spark.createDataFrame([(1, "\n\t" + "x" * 20 + "\u00a0 \n"), (2, "\n" + "x" * 21 + "\r\n"), (3, None)], "id int, t string")
    assert [r["id"] for r in rows.where(text.long_enough(F.col("t"))).collect()] == [2]
    assert rows.limit(1).select(text.extract_flags(F.lit("é-x and -y"))).first()[0] == ["-y"]


def test_trigrams(spark):
    row = spark.createDataFrame([("namspaces", "namespaces")], "a string, b string").select(trigram.similarity(F.col("a"), F.col("b")).alias("s"), trigram.word_similarity("a", "b").alias("w")).first()
    assert row["s"] == pytest.approx(8 / 13) and 0.5 < row["w"] < 1
    assert trigram.word_similarity_of("word", "two words here") == pytest.approx(0.8)
    assert trigram.word_similarity_of("heap use", "a heap use after free") == 1.0
    assert trigram.word_similarity_of("", "x") == 0.0


def test_codes(spark):
    df = spark.createDataFrame([([0.0, 0.5, 1.0, 0.0333333],)], "v array<double>")
    lo, hi = F.array(*[F.lit(0.0)] * 4), F.array(*[F.lit(1.0)] * 4)
    row = df.select(vectors.encode(F.col("v"), lo, hi).alias("c"), vectors.sign_words("v").alias("b")).first()
    assert row["c"] == [0, 8, 15, 0] and row["b"] == [0b0111]  # 7.5 goes to the even level
    row = df.select(vectors.unpack(F.lit("08f0")).alias("u"), vectors.parse(F.lit("[1.5,-2]")).alias("p"), vectors.permuted("v", 1).alias("m")).first()
    assert row["u"] == [0, 8, 15, 0] and row["p"] == [1.5, -2.0] and row["m"] == pytest.approx([-0.0333333, 0.0, -0.5, 1.0])


def test_knn_ties_and_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], "vec_id bigint, embedding array<float>")
    monkeypatch.setattr(knn, "BLOCK", 4)
    got = knn.exact_knn(rows, rows.where("vec_id < 9"), 5).collect()
    assert len(got) == 45 and all(r["vec_id"] % 3 == r["query_id"] % 3 for r in got)
    assert knn.exact_knn(rows, rows.where("vec_id < 0"), 5).count() == 0
    assert knn.exact_knn(rows, rows.where("vec_id = 0"), 3, ties=True).count() == 10


def test_graph_recall_and_growth():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(800, 16))
    g = hnsw.Graph(range(700), v[:700])
    change = g.add(range(700, 800), v[700:])
    assert len(change) == 100 and all(c["links"] and set(c["touched"]) <= set(range(800)) for c in change)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(50):
        exact = set(np.argsort(-(u @ u[q]))[:10].tolist())
        found, walk = g.search(v[q], 10)
        hits += len(exact & {i for i, _ in found})
        assert all(p[-1] == i for i, p in walk["path"].items()) and len(walk["near_miss"]) == 3
    assert hits >= 0.95 * 500
    assert hnsw.Graph([], np.empty((0, 4))).search([1, 0, 0, 0])[0] == []


def test_fusion(spark):
    lanes = spark.createDataFrame([(1, "flag", 10, 1), (1, "vec", 10, 2), (1, "vec", 11, 1), (1, "fts_any", 12, 1), (1, "other", 13, 1)], "query_id int, lane string, id int, rank int")
    got = {r["id"]: r["score"] for r in retrieval.fuse(lanes).collect()}
    assert got == {10: round(3 / 61 + 2 / 62, 9), 11: round(2 / 61, 9), 12: 0.0, 13: round(1 / 61, 9)}


def test_cover_density():
    assert retrieval._cover([[1], [2]]) == 1.0
    assert retrieval._cover([[1, 10], [4]]) == pytest.approx(1 / 3 + 1 / 6)
    assert retrieval._cover([[1], []]) == 0.0


def test_merge_entities(spark):
    e = spark.createDataFrame([(1, "Net Map", ["nm"]), (2, "nmap", ["map"]), (3, "dig", [])], "id bigint, name string, aliases array<string>")
    chunks = spark.createDataFrame([(1, 1), (2, 2)], "ref bigint, entity_id bigint")
    links = spark.createDataFrame([(1, 3, "uses"), (2, 3, "uses"), (1, 2, "is"), (3, 1, "by")], "src bigint, dst bigint, rel string")
    e2, c2, l2 = procedures.merge_entities(e, chunks, links, 1, 2)
    assert {r["id"]: r["aliases"] for r in e2.collect()} == {2: ["map", "net map", "nm"], 3: []}
    assert {tuple(r) for r in l2.collect()} == {(2, 3, "uses"), (3, 2, "by")} and {r["entity_id"] for r in c2.collect()} == {2}
    for bad in ((1, 1), (1, 9)):
        with pytest.raises(ValueError):
            procedures.merge_entities(e, chunks, links, *bad)


def test_audit(spark):
    a = spark.createDataFrame([(1, "x", "h"), (2, "y", "h"), (3, "z", "h")], "id int, name string, password_hash string")
    b = spark.createDataFrame([(1, "x", "h"), (2, "Y", "h"), (4, "n", "h")], "id int, name string, password_hash string")
    got = {r["row_id"]: r for r in procedures.audit_rows(a, b, "id", "users", "me").collect()}
    assert {k: r["action"] for k, r in got.items()} == {2: "UPDATE", 3: "DELETE", 4: "INSERT"} and "password" not in got[2]["old_row"]


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "a"))
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert s.seed("t", t) and not s.seed("t", t)
    s.write("t", dml.relabel(s.read("t"), "id", 2, "v", "z"), superseded=1)
    assert s.dead_pct("t") == pytest.approx(100 / 3) and s.fingerprint("t") == 2
    with pytest.raises(Conflict):
        s.write("t", t, expect=1)
    with s.lock("heal"):
        with pytest.raises(Conflict):
            s.lock("heal")
    s.lock("heal").__exit__()

    def crash():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        s.write("t", t.limit(0), before_swap=crash)
    assert s.read("t").count() == 2  # a crash before the swap leaves the old version
    s.compact("t")
    assert s.dead_pct("t") == 0 and s.read("t").count() == 2
    other = Store(spark, str(tmp_path / "b"))
    s.clone("t", other)
    assert other.read("t").count() == 2
    with pytest.raises(KeyError):
        s.read("none")


def test_checked_update_and_restore(spark):
    t = spark.createDataFrame([(1, "a")], "id int, v string")
    with pytest.raises(ValueError):
        dml.checked_update(t, spark.createDataFrame([(2, "x")], "id int, v string"), "id")
    docs = spark.createDataFrame([(1, [1.0, 0.0], "m")], "id bigint, embedding array<double>, model_version string")
    assert faults.restore(docs, docs, 1).count() == 1
    with pytest.raises(ValueError):
        faults.restore(docs.limit(0), docs, 1)


def test_noise_and_cross_model(spark):
    docs = spark.createDataFrame([(i, f"text {i}", [1.0] + [0.0] * 63, "m") for i in range(20)], "id bigint, body string, embedding array<double>, model_version string")
    same = [tuple(r) for r in faults.noise(docs, 25, "s", 0.1).orderBy("id").collect()]
    assert same == [tuple(r) for r in faults.noise(docs, 25, "s", 0.1).orderBy("id").collect()]
    assert sum(r[2] != [1.0] + [0.0] * 63 for r in same) == 5
    other = faults.cross_model(docs, 50, "s", embedders.hashed(salt="other"), "other")
    assert other.where("model_version = 'other'").count() == 10


def test_samples(spark):
    t = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "id bigint, c string")
    assert [r["id"] for r in sampling.round_robin(t, "c", "id", 4).collect()] == [0, 1, 2, 3]
    assert sampling.exact_share(t, "id", 1).count() == 1
    for bad in (0, 101):
        with pytest.raises(ValueError):
            sampling.exact_share(t, "id", bad)


def test_readers(spark, tmp_path):
    (tmp_path / "man").mkdir()
    (tmp_path / "man" / "x.1").write_text("X(1)\nN\x08NA\x08AM\x08ME\x08E\n  x\n")
    (tmp_path / "man" / "y.1").write_text(".so man1/x.1\n")
    assert [(r["section"], r["body"]) for r in readers.manual_pages(spark, str(tmp_path / "man")).orderBy("place").collect()] == [("name", "  x")]
    for d, names in (("common", "ab"), ("linux", "bc")):
        (tmp_path / d).mkdir()
        for n in names:
            (tmp_path / d / f"{n}.md").write_text(d)
    assert {tuple(r) for r in readers.short_pages(spark, str(tmp_path / "common"), str(tmp_path / "linux")).collect()} == {("a", "common"), ("b", "common"), ("c", "linux")}
    (tmp_path / "p.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert readers.json_probes(spark, str(tmp_path / "p.json"), "a int").count() == 2
    (tmp_path / "t.rst").write_text("T\n=\nx")
    assert readers.rst_tree(spark, str(tmp_path)).count() == 1


def test_boost_for_definitions(spark):
    rows = spark.createDataFrame([("-x", "options", "-x does", 0.0, False), ("-x", "options", "a\n -x does", 0.0, False), ("-x", "see also", "none", 0.0, False)], "query string, section string, text string, score double, name_query boolean")
    assert [r["score"] for r in retrieval.boosts(rows).collect()] == [0.2, 0.1, -1.0]


def test_representative_counts_uses_in_the_whole_text(spark, tmp_path):
    text = "ls lists\nvdir is like dir and vdir\ndir: see vdir, not vdir-x\n"
    rows = [(i, text if i % 400 else "dir one\nvdir two dir\n", "en", "s") for i in (0, 1, 299, 300, 5000)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["id"]: (r["name"], r["uses"]) for r in catalog.queries()["h17_representative"](spark, str(tmp_path)).collect()}
    assert got == {0: ("dir", 2), 1: ("vdir", 3), 299: ("vdir", 3), 300: ("vdir", 3), 5000: ("vdir", 3)}


def test_code_scale_and_two_stages_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(300, 70)), 1)  # many equal values, two words of signs
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>").repartition(5)
    ranges = knn.scale(rows)
    got = [(r["lo"], r["hi"]) for r in ranges.orderBy("dim").collect()]
    assert np.allclose(got, np.quantile(v, [0.005, 0.995], axis=0).T, atol=1e-12)
    monkeypatch.setattr(knn, "CODE_BLOCK", 4)
    monkeypatch.setattr(knn, "TILE", 50)
    coded = knn.with_codes(rows, ranges)
    near = knn.two_stage(coded, coded.where("vec_id % 30 = 1"), 5, 20)
    decoded = {r["vec_id"]: np.array(r["decoded"]) for r in coded.collect()}
    want = set()
    for q in range(1, 300, 30):
        far = ((v > 0) != (v[q] > 0)).sum(axis=1)
        pool = np.flatnonzero(far <= np.sort(far)[19])
        best = sorted(pool, key=lambda i: (-round(float(v[q] @ decoded[i]), 6), i))[:5]
        want |= {(q, n + 1, int(i), int(far[i])) for n, i in enumerate(best)}
    assert {tuple(r)[:4] for r in near.collect()} == want
    assert "NestedLoopJoin" not in near._jdf.queryExecution().toString()
    assert knn.two_stage(coded, coded.where("vec_id < 0"), 5, 20).count() == 0


def test_name_lane_by_few_trigrams_finds_all_similar_names(spark):
    names = [f"{a} {b} number {i}" for i, (a, b) in enumerate((a, b) for a in ("blue", "steel", "misty", "") for b in ("rose", "iron", "ab cd")) for _ in range(3)]
    e = [(i, n, [f"alias {n[::-1]}"]) for i, n in enumerate(names)]
    q = [(i, f"please describe {n}") for i, n in enumerate(names[::5])] + [(90, "misty iron"), (91, "misty  IRON number 07 x"), (92, "short")]
    entities = spark.createDataFrame(e, "entity_id bigint, name string, aliases array<string>")
    got = retrieval.name_lane(entities, entities.select("entity_id", F.col("entity_id").alias("id")), spark.createDataFrame(q, "query_id bigint, text string"), most=1000)
    want = set()
    for i, text in q:
        for j, name, aliases in e:
            for n in (name, *aliases):
                g, t = set(trigram._grams(n)), set(trigram._grams(text))
                if len(text) >= 8 and " " in n and len(n) >= 6 and len(g & t) >= 0.9 * len(g) and trigram.word_similarity_of(n.lower(), text.lower()) >= 0.9:
                    want.add((i, j))
    assert want and {(r["query_id"], r["id"]) for r in got.collect()} == want
    # Three or four of a name's trigrams are joined, not all.
    few = retrieval._rarest(type("Uses", (), {"value": {g: 1 for n in names for g in trigram._grams(n)}}))
    batch = pa.RecordBatch.from_pydict({"grams": [sorted(set(trigram._grams("steel iron number 7")))]})
    assert sum(b.num_rows for b in few([batch])) <= 4


def test_svd_by_one_pass_is_that_of_the_iterations(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 30) if x < 40)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    once = embedders.TfidfSvd(4, 100).fit(docs)
    monkeypatch.setattr(embedders, "GRAM", 0)
    often = embedders.TfidfSvd(4, 100).fit(docs)
    place = [often.counter.vocabulary.index(w) for w in once.counter.vocabulary]
    a, b = once.basis, often.basis[place]
    assert np.allclose(a @ a.T, b @ b.T, atol=1e-6)  # the same space; signs are free
