"""The training-data operators against brute force, libraries and SQL, on small and on awkward inputs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from oracle import SF, assert_same
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import bm25, bpe, langid, license_scan, line_dedup, mixing, near_dedup, order_minhash, paragraph_dedup, sets, wordpiece
from corvane.llm.common import Scratch, components
from corvane.llm.queries import QUERIES, SQL, tokenizer_path

BYTE_BPE = tokenizer_path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(30, 90))) for _ in range(25)]
    out = []
    for b in base:
        out.append(b)
        for _ in range(rng.randint(0, 5)):
            w = b.split(" ")
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    out += [None, "", " \n\t", "one", "One", "two words", "one two three four", "a b c d e", "a " * 60, "b " * 60, base[0].upper(), "é" * 30, "x" * 5000]
    rng.shuffle(out)
    return out


# -- 1 --------------------------------------------------------------------------------------------------

def brute_fingerprint_kmers(text):
    ws = [w for w in re.split(r"[ \t-\r]+", (text or "").strip(" \t\n\x0b\f\r")) if w]
    return Counter(zip(ws, ws[1:], strict=False)) if len(ws) > 1 else Counter(ws)


def test_order_minhash_query(spark, prose):
    d = docs(spark, prose)
    got = {r["doc_id"]: r for r in order_minhash.edits(d).collect()}
    assert len(got) == len(prose)
    ids = sorted(got, reverse=True)
    for i, k in enumerate(ids):
        t, n = prose[k] or "", prose[ids[(i + 1) % len(ids)]] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + n[:cut]
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[k]["near_edited"] <= 1 and 0 <= got[k]["near_next"] <= 1
        if edited == t:
            assert got[k]["near_edited"] == 1 and got[k]["fingerprint"] == got[k]["edited_fingerprint"]
    by_text = defaultdict(set)
    for k, r in got.items():
        by_text[prose[k] or ""].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_order_minhash_tells_order_and_estimates(spark):
    rng = random.Random(3)
    w = [f"w{i}" for i in range(400)]
    moved = w[200:] + w[:200]
    half = w[:300] + [f"v{i}" for i in range(100)]
    other = [f"u{i}" for i in range(400)]
    rows = [("same", " ".join(w)), ("moved", " ".join(moved)), ("half", " ".join(half)), ("other", " ".join(other)), ("words", " ".join(w))]
    df = order_minhash.fingerprint(spark.createDataFrame(rows, "name string, text string"), "text", "fp")
    fp = {r["name"]: r["fp"] for r in df.collect()}
    like = lambda a, b: sum(x == y for x, y in zip(fp[a], fp[b], strict=True)) / len(fp[a])
    assert like("same", "words") == 1 and like("same", "other") == 0
    # All k-mers but one are common to both, but half of the pairs stand in the other order.
    assert 0.25 < like("same", "moved") < 0.75
    assert 0.15 < like("same", "half") < 0.65
    assert rng and "__" not in "".join(df.columns)


def test_order_minhash_matches_definition(spark):
    """Each coordinate is the hash of the two least k-mers by (hash xor j), in text order."""
    texts = ["a b a b a b c", "x", "", "p q r s t u v w " * 9]
    d = docs(spark, texts)
    df = order_minhash.fingerprint(d, "text", "fp")
    # The same by a plain path: rows of k-mers, their number of occurrence, and a sort for each coordinate.
    kmers = spark.createDataFrame(
        [(i, p, a, b) for i, t in enumerate(texts) for p, (a, b) in enumerate(zip(t.split(), t.split()[1:], strict=False) if len(t.split()) > 1 else [(w, None) for w in t.split()])],
        "doc_id bigint, p bigint, a string, b string",
    )
    h = F.expr("if(b is null, xxhash64(a), xxhash64(xxhash64(a), xxhash64(b))) & -4294967296L")
    k = [tuple(r) for r in kmers.withColumn("h", h).select("doc_id", "p", "h").collect()]
    seen, rows = Counter(), []
    for i, p, x in sorted(k):
        rows.append((i, p, x, seen[i, x]))
        seen[i, x] += 1
    numbered = spark.createDataFrame(rows, "doc_id bigint, p bigint, h bigint, o int").select("doc_id", F.expr("xxhash64(h, o) & -4294967296L | p").alias("g")).collect()
    by = defaultdict(list)
    for r in numbered:
        by[r["doc_id"]].append(r["g"])
    want = []
    for i, g in by.items():
        for j in range(order_minhash.SKETCHES):
            flip = (j << 58) ^ (1 << 63)
            least = sorted(g, key=lambda x: sets.signed((x ^ flip) & ((1 << 64) - 1)))[: order_minhash.TUPLE]  # noqa: B023
            want.append((i, j, [x & -4294967296 for x in sorted(least, key=lambda x: x & 4294967295)]))
    hashed = {(r["i"], r["j"]): r["c"] for r in spark.createDataFrame(want, "i bigint, j int, t array<bigint>").select("i", "j", F.expr("cast(shiftright(xxhash64(t), 32) as int)").alias("c")).collect()}
    for r in df.collect():
        for j, c in enumerate(r["fp"]):
            assert c == hashed.get((r["doc_id"], j), 0)


def test_order_minhash_of_texts_without_blanks(spark):
    rng = random.Random(9)
    a, b = ("".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(900)) for _ in range(2))
    got = {r["doc_id"]: r for r in order_minhash.edits(docs(spark, [a, b])).collect()}
    assert all(0.2 < r["near_edited"] < 0.8 and r["near_next"] < 0.1 for r in got.values())


def test_next_wraps_and_takes_gaps(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "GROUP", 2)
    ids = [5, 6, 7, 100, 101, 10**12, -4, None]
    df = spark.createDataFrame([(i, f"t{i}", 0) for i in ids], "doc_id bigint, text string, first int")
    got = {r["doc_id"]: r["next_text"] for r in order_minhash.with_next(df, ["text"]).collect()}
    order = [10**12, 101, 100, 7, 6, 5, -4, None]
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_next_stands_an_outlying_key(spark, monkeypatch):
    ids = [*range(3000), 10**15]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id bigint, text string").repartition(5)
    monkeypatch.setattr(order_minhash, "GROUP", 16)
    out = order_minhash.with_next(df, ["text"])
    assert {r["doc_id"]: r["next_text"] for r in out.collect()} == {a: f"t{b}" for a, b in zip(ids, [ids[-1], *ids], strict=False)}
    sizes = []
    real = order_minhash.Scratch.save
    monkeypatch.setattr(order_minhash.Scratch, "save", lambda self, x: sizes.append(x.count()) or real(self, x))
    order_minhash.with_next(df, ["text"])
    assert sizes[0] >= len(ids) / 64  # as many groups


# -- 2 --------------------------------------------------------------------------------------------------

def greedy(word, first, rest):
    n, at = 0, 0
    while at < len(word):
        pieces = rest if at else first
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 0)
        if not size:
            return -1
        n, at = n + 1, at + size
    return n


def test_wordpiece_counts():
    rng = random.Random(1)
    for _ in range(200):
        make = lambda k: {"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(k)}  # noqa: B023, E731
        first, rest = make(rng.randint(0, 12)), make(rng.randint(0, 12))
        automaton = wordpiece.Automaton(sorted(first), sorted(rest))
        for _ in range(60):
            w = "".join(rng.choices("abcd", weights=(5, 5, 5, 1), k=rng.randint(0, 14)))
            assert automaton.count(w) == greedy(w, first, rest), (w, first, rest)


def test_wordpiece_on_texts(spark, prose):
    vocabulary = wordpiece.sentencepiece_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    first, rest = map(set, vocabulary)
    got = {r["doc_id"]: r for r in wordpiece.count_tokens(docs(spark, prose).withColumn("N_TOKENS", F.lit("old")), vocabulary).collect()}
    for i, t in enumerate(prose):
        ws = re.findall(r"\w+|[^\w\s]", t or "")
        n = [greedy(w, first, rest) for w in ws]
        assert (got[i]["n_words"], got[i]["n_tokens"], got[i]["n_unknown"]) == (len(ws), sum(x if x > 0 else 1 for x in n), sum(x < 0 for x in n))


# -- 3 --------------------------------------------------------------------------------------------------

def test_language_id(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op3_language_id"](spark, SF).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == d.count() and held and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_edges(spark):
    model = langid.fit(spark.createDataFrame([("alpha beta gamma delta " * 20, "x"), ("uno dos tres cuatro " * 20, "y"), (None, "x"), ("zzz", None)], "text string, lang string"))
    assert model.languages == ["x", "y"]
    rows = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "12 +- 34", "q"), (4, "BETA gamma", "q"), (5, "cuatro tres", "q")], "doc_id int, text string, score string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(rows, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "x" and got[5][0] == "y"
    empty = langid.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in langid.identify(rows, empty).collect()} == {"und"}
    assert langid.identify(rows.limit(0), model).count() == 0


def test_language_id_is_brute_force(spark, monkeypatch):
    """The languages of each n-gram by sets; the filters only add what they affirm by chance, which is corrected for."""
    rng = random.Random(8)
    speak = {f"l{i:02}": ["".join(rng.choices("abcdefghijklmnop"[i % 8 : i % 8 + 8], k=rng.randint(2, 7))) for _ in range(40)] for i in range(70)}
    rows = [(" ".join(rng.choices(speak[name], k=120)), name) for name in speak for _ in range(4)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == sorted(speak) and model.table.shape[0] == 2

    grams, total = defaultdict(Counter), Counter()
    for t, name in rows:
        c = Counter(langid._grams(t).tolist())
        grams[name] += c
        total[name] += sum(c.values())
    most = defaultdict(float)
    for name, c in grams.items():
        for g, n in c.items():
            most[g] = max(most[g], n / total[name])
    known = {name: {g for g, n in c.items() if n >= langid.LEAST and n / total[name] >= langid.SHARE * most[g]} for name, c in grams.items()}
    for _ in range(100):
        name = rng.choice(sorted(speak))
        g = langid._grams(" ".join(rng.choices(speak[name], k=30))).tolist()
        share = {x: sum(y in known[x] for y in g) / len(g) for x in sorted(known)}
        got, score = model.predict_grams(langid.np.array(g, langid.np.uint64))
        assert abs(score - max(share.values())) < 0.01 and abs(share[got] - max(share.values())) < 0.01


# -- 4 --------------------------------------------------------------------------------------------------

def brute_bm25(texts, queries, k):
    tf = {i: Counter(bm25.terms(t)) for i, t in texts.items()}
    n, mean = len(tf), sum(sum(c.values()) for c in tf.values()) / len(tf)
    df = Counter(t for c in tf.values() for t in c)
    out = {}
    for q in queries:
        score = defaultdict(float)
        for t, m in tf[q].items():
            idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
            for i, c in tf.items():
                if c[t]:
                    score[i] += m * idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
        out[q] = sorted(((-round(s, 6), i) for i, s in score.items()))[:k]
    return out


def test_search(spark, prose, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD_DOCS", 9)
    monkeypatch.setattr(bm25, "BLOCK", 4)
    monkeypatch.setattr(bm25, "QUERY_TERMS", 100)
    d = docs(spark, prose).unionByName(spark.createDataFrame([(None, "one two", "en", "s", 7)], SCHEMA))
    for k in (1, 5, 1000):
        got = defaultdict(list)
        for r in bm25.search(d, d.where("doc_id % 5 = 0"), k).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((-r["score"], r["doc_id"]))
        want = brute_bm25(dict(enumerate(prose)), range(0, len(prose), 5), k)
        assert dict(got) == {q: v for q, v in want.items() if v}
    assert bm25.search(d.limit(0), d.limit(0)).count() == 0


def test_search_rows_grow_with_tasks_not_shards(spark, monkeypatch):
    """A task's shards are merged before anything is written, and sums in single precision decide nothing."""
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(pool, k=rng.choice((1, 30, 1000, 1003)))) for _ in range(60)] + ["rare " * 900, "Rare_rare", "", None]
    saved = []

    class Seen(bm25.Scratch):
        def save(self, df):
            saved.append(super().save(df))
            return saved[-1]

    monkeypatch.setattr(bm25, "Scratch", Seen)
    one_task = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for name, value in one_task.items():
        spark.conf.set(name, value)
    try:
        d = docs(spark, texts).repartition(11)
        got = defaultdict(list)
        for r in bm25.search(d, d, 3).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((-r["score"], r["doc_id"]))
    finally:
        for name in one_task:
            spark.conf.unset(name)
    want = {q: v for q, v in brute_bm25(dict(enumerate(texts)), range(len(texts)), 3).items() if v}
    assert dict(got) == want
    assert saved[0].count() == 11 and saved[-1].count() == sum(map(len, want.values()))


# -- 5 --------------------------------------------------------------------------------------------------

def test_license_edges(spark):
    mit = dict(license_scan.TEMPLATES)["MIT-permission"]
    broken = mit.replace("free of charge", "at no charge")
    texts = [None, "", "nothing to see here at all", "x " * 50 + mit + " y" * 50, "words before " + broken, "RELEASED under the mit-license!", "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", "license " * 3000]
    got = {(r["doc_id"], r["license"]): r for r in license_scan.scan(docs(spark, texts)).collect()}
    assert set(got) == {(3, "MIT-permission"), (4, "MIT-permission"), (5, "MIT"), (6, "CC-BY-NC-4.0")}
    assert got[3, "MIT-permission"]["containment"] == 1 and 0.75 <= got[4, "MIT-permission"]["containment"] < 1
    assert license_scan.scan(docs(spark, texts), []).count() == 0 and license_scan.scan(docs(spark, []).limit(0)).count() == 0
    for share in (0.4, 0.75, 0.9):
        assert 1 - (1 - share * 0.5 / (2 + 0.5 * (1 - share))) ** license_scan.bands_at(share) >= license_scan.COLLIDE
    half = " ".join(mit.split()[: len(mit.split()) // 2])
    assert {r["license"] for r in license_scan.scan(docs(spark, [half]), contained=0.4).collect()} == {"MIT-permission"}
    for name, text in license_scan.TEMPLATES:
        assert len(text) > 20 and name
    each = docs(spark, ["z " * 40 + t + " z" * 40 for _, t in license_scan.TEMPLATES])
    found = {(r["doc_id"], r["license"]) for r in license_scan.scan(each).collect()}
    assert all((i, name) in found for i, (name, _) in enumerate(license_scan.TEMPLATES))


# -- 6 --------------------------------------------------------------------------------------------------

def test_bpe_remembers_little():
    """A remembered piece takes one object besides itself: workers of a stage live on into the next, and share an executor's memory."""
    import tracemalloc

    with open(BYTE_BPE, encoding="utf-8") as f:
        model = bpe.Bpe(f.read())
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefgh", k=8)) for _ in range(20_000))
    tracemalloc.start()
    try:
        model.encode(text)
        model.compatible = {}
        assert tracemalloc.get_traced_memory()[0] / len(model.pieces) < 170
    finally:
        tracemalloc.stop()
    assert len(model.encode("")) == 0


def test_bpe_is_the_library(spark, prose):
    from tokenizers import Tokenizer

    library, mine = Tokenizer.from_file(BYTE_BPE), bpe.Bpe(open(BYTE_BPE, encoding="utf-8").read())
    rng = random.Random(5)
    alphabet = [chr(c) for c in [*range(0x500), *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x1F600, 0x4E00, 0x661, 0xBD, 0x2160]] + ["<|endoftext|>", "  ", "\n\n", "'s", "'ll", "aaaa", "abab", "the "]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)] + ["a" * 3000, "ab" * 2000, " " * 3000] + [t for t in prose if t]
    for t, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = mine.encode(t).tolist()
        assert ids == want.ids and mine.decode(ids).decode() == library.decode(ids, skip_special_tokens=False) == t
    d = docs(spark, prose).withColumn("ids", F.lit(1))
    got = bpe.encode(d, BYTE_BPE, outputs=("ids", "n_tokens", "decoded")).collect()
    assert all(r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(r["ids"]) for r in got)
    back = bpe.decode(spark.createDataFrame([([464, 50256],), ([],), (None,)], "ids array<int>"), BYTE_BPE).collect()
    assert [r["decoded"] for r in back] == ["The<|endoftext|>", "", None]
    assert bpe.encode(d.limit(0), BYTE_BPE).count() == 0


# -- 7 --------------------------------------------------------------------------------------------------

def filled(sizes, weights, total, most):
    """Reshare by rounds, as the contract tells it."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), total * sum(sizes.values())
    while open_ and left > 1e-9:
        share = {n: left * w[n] / sum(w[x] for x in open_) for n in open_}
        full = {n for n in open_ if target[n] + share[n] >= most * sizes[n]}
        for n in full or open_:
            target[n] = most * sizes[n] if n in full else target[n] + share[n]
        left = total * sum(sizes.values()) - sum(target.values())
        if not full:
            break
        for n in open_ - full:
            target[n] = 0.0
        left = total * sum(sizes.values()) - sum(target.values())
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 1000, None: 50}, {"a": 0, "b": 0}, {"é": 7, "z": 7, "Z": 7}, {None: 9}, {f"s{i}": (i * 37) % 101 for i in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = filled(sizes, mixing.WEIGHTS, mixing.TOTAL, mixing.MOST)
    assert got == pytest.approx(want)


def test_mix(spark, prose):
    d = docs(spark, prose).withColumn("size", F.lit("clash")).withColumn("rate", F.lit("clash"))
    a = {r["doc_id"]: r for r in mixing.mix(d).collect()}
    assert {i: r["copies"] for i, r in a.items()} == {r["doc_id"]: r["copies"] for r in mixing.mix(d.repartition(7)).collect()}
    for i, r in a.items():
        assert r["size"] == len(words(prose[i])) and r["copies"] in (math.floor(r["target"] / r["source_size"]), math.ceil(r["target"] / r["source_size"]))
    assert mixing.emit(mixing.mix(docs(spark, prose))).count() == sum(r["copies"] for r in a.values())
    assert mixing.emit(mixing.mix(docs(spark, prose))).columns == d.columns[:5]
    assert mixing.mix(d.limit(0)).count() == 0
    assert {r["copies"] for r in mixing.mix(docs(spark, [None, ""])).collect()} == {0}


# -- 8 --------------------------------------------------------------------------------------------------

def brute_lines(texts):
    earlier, kept = [], defaultdict(list)
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(words(line))
            if s:
                if not any(5 * len(s & o) >= 4 * len(s | o) for o in earlier):
                    kept[i].append(k)
                earlier.append(s)
    return kept


def test_line_dedup(spark, prose, monkeypatch):
    rng = random.Random(2)
    lines = [t for t in prose if t]
    texts = ["\n".join(rng.choices([*lines, "", "a b", "b a", "a b c d e", "a b c d f", "The the THE"], k=rng.randint(1, 6))) for _ in range(40)] + [None, "", "\n\n", "ab\ncd"]
    want = brute_lines(texts)
    for best, unit in ((4, 2048), (1, 3)):  # one partner at first and many units: the later rounds find the rest
        monkeypatch.setattr(line_dedup, "BEST", best)
        monkeypatch.setattr(line_dedup, "UNIT", unit)
        got = {r["doc_id"]: r["kept"] for r in line_dedup.kept_lines(docs(spark, texts)).collect()}
        assert got == dict(want)
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, texts).withColumn("kept", F.lit(1))).collect()}
    for i, t in enumerate(texts):
        assert out[i] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k in want[i] or not words(x)))
    assert line_dedup.kept_lines(docs(spark, []).limit(0)).count() == 0


def test_lines_of_a_long_text_are_cut_alike(spark):
    """A document beyond the size of a piece, and words at its ends."""
    text = "\n".join(f"w{i} w{i + 1} w{i + 2} w{i + 3}" for i in range(30_000))
    got = line_dedup.kept_lines(docs(spark, [text, "w0 w1 w2 w3", text[:-1]])).collect()
    assert [(r["doc_id"], len(r["kept"])) for r in got if r["doc_id"] == 0] == [(0, 30_000)] and {r["doc_id"] for r in got} <= {0, 2}


# -- 9 --------------------------------------------------------------------------------------------------

def brute_components(texts):
    sh = []
    for t in texts:
        w = words(t)
        sh.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def find(x):
        return x if up[x] == x else find(up[x])

    for x in range(len(texts)):
        for y in range(x):
            if sh[x] and sh[y] and 100 * len(sh[x] & sh[y]) >= 75 * len(sh[x] | sh[y]):
                a, b = find(x), find(y)
                up[max(a, b)] = min(a, b)
    return {i: (len(sh[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize("block", [400_000, 100])
def test_near_dedup(spark, prose, monkeypatch, block):
    monkeypatch.setattr(sets, "BLOCK", block)  # small: clusters are dealt out in many blocks
    texts = prose + prose[:20]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.classes(docs(spark, texts)).collect()}
    assert got == brute_components(texts)
    kept = {r["doc_id"] for r in near_dedup.keep_one(docs(spark, texts)).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_near_dedup_edges(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (2, "g h i j k l"), (1, "g h i j k l"), (9, None)], "doc_id bigint, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_dedup.classes(d).collect())
    assert got == [("1", "1", True), ("2", "1", False), ("2", "2", True), ("3", "2", False), ("9", "9", True), ("None", "None", True)]
    assert near_dedup.classes(d.limit(0)).count() == 0


def test_sketch_is_concentrated():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 400, 4000):
        x = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        a, b = np.unique(x[: n + n // 2]), np.unique(x[n // 2 :])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((near_dedup.sketch(a) == near_dedup.sketch(b)).mean() - j) < 0.12
        assert (near_dedup.sketch(a) < np.iinfo(np.uint64).max).all()


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame([*pairs, (None, 3)], "a bigint, b bigint"), Scratch(spark)).collect()}
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for s in sorted(near):
        todo = [s] if s not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = s
                todo += near[x]
    assert got == want


# -- 10 -------------------------------------------------------------------------------------------------

def brute_repeats(texts, width, gap):
    """``{(doc, start of window): removed}`` of the paragraphs with a partner at 0.75 or more that they don't overlap."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "body"])
    units, cover = [], [0] * len(texts)
    for ids, start, _, size, _ in paragraph_dedup.paragraphs([batch], width, gap):
        for i, s, n in zip(ids.tolist(), start.tolist(), size.tolist(), strict=True):
            own = words(texts[i])[s : s + n]
            assert len(own) == n and s <= cover[i] and n == min(width, len(words(texts[i])))
            cover[i] = s + n
            units.append((i, s, s + n, {tuple(own[k : k + 5]) for k in range(n - 4)}))
    assert all(cover[i] == len(words(t)) or len(words(t)) < 5 for i, t in enumerate(texts))
    by = defaultdict(set)
    for x, u in enumerate(units):
        for g in u[3]:
            by[g].add(x)
    out = {}
    for x, (i, s, _, a) in enumerate(units):
        for y, n in Counter(y for g in a for y in by[g] if y < x).items():
            j, _, end, b = units[y]
            if 100 * n >= 75 * (len(a) + len(b) - n) and (i != j or end <= s):
                out[i, s] = True
                out.setdefault(units[y][:2], False)
    return out


def found_repeats(spark, texts, width, gap):
    got = {}
    for r in paragraph_dedup.repeats(docs(spark, texts), width=width, gap=gap).collect():
        got.setdefault(r["doc_id"], []).append(r)
    return got


def fresh(rng, n):
    return [f"w{rng.randrange(10**7)}" for _ in range(n)]


@pytest.mark.parametrize("width,gap", [(55, 11), (20, 2)])
def test_substring_dedup_is_brute_force(spark, prose, width, gap):
    rng = random.Random(6)
    passages = [fresh(rng, rng.randint(width - 4, 2 * width)) for _ in range(12)]
    texts = []
    for i in range(90):
        t = fresh(rng, rng.randint(0, 200))
        for _ in range(rng.randint(0, 3)):
            p, at = list(rng.choice(passages)), rng.randint(0, len(t))
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = "edited"
            t[at:at] = p
        texts.append(" ".join(t))
    texts += [None, "", "short text", "one two three four five six", "one two three four five six", "word " * 80, "word " * 90, " ".join(fresh(rng, 30) * 9)]
    texts += [t for t in prose if t] + texts[:5]
    want = brute_repeats(texts, width, gap)
    got = paragraph_dedup.repeats(docs(spark, texts), width=width, gap=gap).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in want}
    removed, kept = Counter(), Counter()
    for r in got:
        (removed if r["removed"] else kept)[r["doc_id"]] += 1
    wanted = Counter(i for (i, _), x in want.items() if x)
    own = {95, 96, 97}  # repeats within one text, in which not every match of an edited copy is looked for
    assert {i: n for i, n in removed.items() if i not in own} == {i: n for i, n in wanted.items() if i not in own}
    assert all(0.9 * wanted[i] <= removed[i] <= wanted[i] for i in own)
    first = defaultdict(list)
    for r in got:
        first[r["component"]].append((r["doc_id"], r["start"], r["removed"], r["first_doc_id"]))
    for rows in first.values():
        assert min(rows)[0] == rows[0][3] and not min(rows)[2] and any(x[2] for x in rows)
    cleaned = {r["doc_id"]: r["text"] for r in paragraph_dedup.cut_repeats(docs(spark, texts).withColumn("cut_id", F.lit(1)), width=width, gap=gap).collect()}
    assert len(cleaned) == len(texts) and all((len(words(cleaned[i])) < len(words(t))) == bool(removed[i]) for i, t in enumerate(texts) if t)


def test_substring_dedup_recall(spark):
    """Passages of over 50 words in other context, unchanged and with a word changed; shorter ones by narrower paragraphs."""
    rng = random.Random(16)
    for size, edits, width, gap in ((51, 0, 55, 11), (120, 1, 55, 11), (25, 0, 20, 2), (20, 0, 15, 1), (30, 1, 15, 1)):
        texts = []
        for _ in range(100):
            passage = fresh(rng, size)
            edited = list(passage)
            for k in range(edits):
                edited[k * 25 + 12] = "edited"
            texts += [" ".join(fresh(rng, rng.randint(0, 80)) + x + fresh(rng, rng.randint(0, 80))) for x in (passage, edited)]
        texts += [" ".join(fresh(rng, 150)) for _ in range(100)]
        got = found_repeats(spark, texts, width, gap)
        assert set(got) == set(range(200)), (size, edits, width)
        assert all(any(r["removed"] for r in got[i]) == (i % 2 == 1) for i in got)


def test_open_buckets_give_pairs(monkeypatch):
    """Of an open bucket only the pairs that sketches don't rule out are joined with their elements; a crowded one is handed on as a whole."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 32, 40, np.uint32)
    elements = np.stack([np.concatenate([base[:k], rng.integers(0, 1 << 32, 40 - k, np.uint32)]) for k in (40, 39, 5, 38, 0, 37, 3, 36)])
    n, x, y = sets.sketched(elements)
    total = len(elements)
    key, label, asked, alone = [7] * 6 + [8] * 2, [1, 2, 3, 1, 5, 6, 7, 8], [False, True, True, False, True, True, False, True], [False] * 5 + [True] * 3
    columns = [key, [0] * total, [0] * total, range(total), label, asked, alone, range(total), n, x.view(np.int64), y.view(np.int64), [0, 1, 2, 3, 4, 1, 6, 7], [0] * total, [44] * total]
    names = ["key", "i", "j", "id", "label", "asked", "alone", "rank", "n", "x", "y", "doc", "start", "stop"]
    rows = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in columns], names=names)
    got = {(r["a"], r["b"]) for r in sets._hits(rows).to_pylist() if r["key"] is None}
    of = [set(e.tolist()) for e in elements]
    alike = {(a, b) for b in range(total) for a in range(b) if key[a] == key[b] and 100 * len(of[a] & of[b]) >= 75 * len(of[a] | of[b])}
    assert alike - {(0, 3)} <= got <= {(a, b) for a in (0, 1, 3, 5) for b in (0, 1, 3, 5) if a < b} - {(0, 3)}  # that pair has one label
    monkeypatch.setattr(sets, "PAIRS_A_ROW", 0)
    assert {(r["key"], r["a"], r["b"]) for r in sets._hits(rows).to_pylist()} == {(7, i, None) for i in (0, 1, 3, 5)}
    assert sets._hits(rows.slice(0, 0)).num_rows == 0


def test_linking_frees_tables(spark, monkeypatch):
    """Tables of buckets go one by one as these are judged, and elements are joined by slices of both ends; the result is the same."""
    rng = random.Random(17)
    common = [fresh(rng, 60) for _ in range(12)]
    texts = [" ".join(fresh(rng, 20) + [w if rng.random() < 0.98 else "edited" for w in rng.choice(common)] + fresh(rng, 20)) for _ in range(60)]
    found = lambda: sorted(map(tuple, paragraph_dedup.repeats(docs(spark, texts)).collect()))
    live, seen, pairs = {}, [], []
    save, drop = Scratch.save, Scratch.drop

    def saving(self, df):
        columns = set(df.columns)
        if columns == {"key", "id", "label", "asked", "alone"}:
            seen.append(sum("hub" in c for c in live.values()))
        pairs.append(columns == {"a", "b"})
        out = save(self, df)
        live[out._corvane_path] = columns
        return out

    def dropping(self, *tables):
        for t in tables:
            live.pop(getattr(t, "_corvane_path", None), None)
        drop(self, *tables)

    monkeypatch.setattr(Scratch, "save", saving)
    monkeypatch.setattr(Scratch, "drop", dropping)
    monkeypatch.setattr(sets, "SLICED", 1e-9)
    want = found()
    n = -(-paragraph_dedup.BANDS // paragraph_dedup.AT_ONCE)
    assert want and seen == list(range(n, 0, -1))
    whole, pairs[:] = sum(pairs), []
    monkeypatch.setattr(sets, "SLICED", 3)
    assert found() == want
    assert sum(pairs) > whole


def test_substring_dedup_edges(spark):
    assert paragraph_dedup.repeats(docs(spark, []).limit(0)).count() == 0
    same = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "x " * 9)], "doc_id bigint, text string")
    assert paragraph_dedup.repeats(same).count() == 0 and paragraph_dedup.cut_repeats(same).count() == 4
    assert 1 - (1 - 0.75**paragraph_dedup.ROWS) ** paragraph_dedup.BANDS >= paragraph_dedup.RECALL


def test_cut_spans():
    assert paragraph_dedup._without_spans(" ".join(map(str, range(30))), [5], [20]) == "0 1 2 3 4 25 26 27 28 29"
    assert paragraph_dedup._without_spans(" ".join(map(str, range(30))), [5, 9], [20, 20]) == "0 1 2 3 4 29"
    assert paragraph_dedup._without_spans(None, [1], [1]) is None


# -- queries and the pipeline ---------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert_same(df, SQL[name])
    else:
        assert df.count() > 0


def test_pipeline_stages(spark, prose):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "bpe"]
    now = spark.read.parquet(f"{SF}/documents.parquet")
    scratch = Scratch(spark)
    rows = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, now = now, scratch.save(stage(spark, now, SF))
        rows[name] = now.count()
        if i < 4:
            assert tuple(now.columns) == corpus_pipeline.COLUMNS and now.dtypes == before.dtypes
        if name == "language_id":
            assert rows[name] >= 0.99 * before.count()
        if name == "line_dedup":
            texts = [r["text"] for r in before.orderBy("doc_id").collect()]
            want = brute_lines(texts)
            ids = [r["doc_id"] for r in before.orderBy("doc_id").collect()]
            assert {r["doc_id"] for r in now.collect()} == {ids[i] for i in want if want[i]}
        if name == "near_dedup":
            ids = [r["doc_id"] for r in before.orderBy("doc_id").collect()]
            got = brute_components([r["text"] for r in before.orderBy("doc_id").collect()])
            assert {r["doc_id"] for r in now.collect()} == {ids[i] for i, (_, c) in got.items() if i == c}
        if name == "mixing":
            taken = {r["doc_id"]: r["count"] for r in now.groupBy("doc_id").count().collect()}
            assert taken == {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect() if r["copies"]}
    out = now.collect()
    assert all(hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() == r["ids_sha256"] for r in out)


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
