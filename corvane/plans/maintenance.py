"""Queries over changing tables: DML, audit, health, repair, graph index, sources and streams."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions import embedders
from corvane.functions import vectors as V
from corvane.operators import dml, faults, health, hnsw, knn, procedures, sampling
from corvane.operators.store import Store
from corvane.plans.common import table as T
from corvane.sources import readers
from corvane.streaming import monitor


def scratch(spark) -> str:
    """A new folder in the shared checkpoint directory; a local one only where none is set and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
    return f"{root.rstrip('/')}/corvane-{uuid.uuid4().hex}"


# -- sources and sinks ----------------------------------------------------------------------------------

@query("s1_csv_corpus", "select source as category, count(*) as n, sum(length(text)) as chars, sum(doc_id) as ids from documents group by source")
def s1(spark, d):
    path = scratch(spark)
    T(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("category"), F.col("text").alias("body")).write.csv(path, header=True, escape='"')
    return readers.csv_corpus(spark, path).groupBy("category").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"), F.sum("id").alias("ids"))


@query("s12_json_probes", "select item_id, md5(text) as body_hash from benchmark")
def s12(spark, d):
    path = scratch(spark)
    T(spark, d, "benchmark").write.json(path)
    return readers.json_probes(spark, path, "item_id bigint, text string", lines=True).select("item_id", F.md5("text").alias("body_hash"))


@query("s13_catalog_stats", "select 1500::bigint * 0 + (select count(*) from customer) as live, (select count(*) from customer where c_custkey % 4 = 0) as dead, 2::bigint as writes, 2::bigint as version")
def s13(spark, d):
    store = Store(spark, scratch(spark))
    c = T(spark, d, "customer")
    store.write("customer", c)
    store.write("customer", dml.relabel(store.read("customer"), "c_custkey", 4, "c_mktsegment", "NEW"), superseded=c.where("c_custkey % 4 = 0").count())
    m = store.manifest("customer")
    return spark.createDataFrame([(m["live"], m["dead"], m["writes"], m["version"])], "live bigint, dead bigint, writes bigint, version bigint")


@query("w1_append", "select count(*) as n, sum(s_suppkey) as keys from (select * from supplier where s_suppkey % 2 = 0 union all select * from supplier where s_suppkey % 2 = 1)")
def w1(spark, d):
    store, s = Store(spark, scratch(spark)), T(spark, d, "supplier")
    store.append("supplier", s.where("s_suppkey % 2 = 0"))
    store.append("supplier", s.where("s_suppkey % 2 = 1"))
    return store.read("supplier").agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("keys"))


@query("w2_reload", "select n_nationkey, n_name from nation where n_regionkey = 2")
def w2(spark, d):
    store, n = Store(spark, scratch(spark)), T(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    store.write("nation", n)
    store.reload("nation", n.where("n_regionkey = 2"))
    return store.read("nation").select("n_nationkey", "n_name")


@query("w3_numbered_insert", "select row_number() over (order by o_orderkey) + 1000 as id, o_orderkey from orders where o_custkey % 50 = 1")
def w3(spark, d):
    new = T(spark, d, "orders").where("o_custkey % 50 = 1").select("o_orderkey")
    return dml.with_ids(new, 1000, "o_orderkey").select("id", "o_orderkey")


_NEW = "new as (select c_custkey + 20 as c_custkey, c_name || '-new' as c_name, case when c_custkey % 2 = 0 then null else c_mktsegment end as c_mktsegment from customer where c_custkey % 10 = 0)"


def _customers(spark, d):
    c = T(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    segment = F.when(F.col("c_custkey") % 2 != 0, F.col("c_mktsegment"))
    return c, c.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 20).alias("c_custkey"), F.concat("c_name", F.lit("-new")).alias("c_name"), segment.alias("c_mktsegment"))


@query("w4_upsert", f"with {_NEW} select c_custkey, c_name, c_mktsegment from new union all select c_custkey, c_name, c_mktsegment from customer where c_custkey not in (select c_custkey from new)")
def w4(spark, d):
    c, new = _customers(spark, d)
    return dml.upsert(c, new, ["c_custkey"])


@query("w5_upsert_coalesce", f"with {_NEW} select coalesce(c.c_custkey, n.c_custkey) as c_custkey, coalesce(c.c_name, n.c_name) as c_name, coalesce(n.c_mktsegment, c.c_mktsegment) as c_mktsegment from customer c full join new n on c.c_custkey = n.c_custkey")
def w5(spark, d):
    c, new = _customers(spark, d)
    return dml.upsert_keeping(c, new, ["c_custkey"], ["c_mktsegment"])


_BODIES = """old as (select md5(text) as hash, min(doc_id) as id, arg_min(text, doc_id) as body, list_sort(list(distinct lang)) as flags, (min(doc_id) % 3)::int as trust from documents where doc_id % 2 = 0 group by md5(text)),
n as (select md5(text) as hash, min(doc_id) as id, list_sort(list(distinct source)) as flags, min((doc_id % 2)::int) as trust from documents where doc_id % 3 = 0 group by md5(text))"""


@query("w6_merge_bodies", f"""with {_BODIES} select coalesce(old.id, n.id) as id, hash, case when old.id is null then n.flags when n.flags is null then old.flags else list_sort(list_distinct(old.flags || n.flags)) end as flags,
case when old.id is null then n.trust when n.trust is null then old.trust else least(old.trust, n.trust) end as trust, (old.id is null or (n.id is not null and (not list_has_all(old.flags, n.flags) or n.trust < old.trust))) as changed from old full join n using (hash)""")
def w6(spark, d):
    t = T(spark, d, "documents").withColumn("hash", F.md5("text"))
    old = t.where("doc_id % 2 = 0").groupBy("hash").agg(F.min("doc_id").alias("id"), F.min_by("text", "doc_id").alias("body"), F.array_sort(F.collect_set("lang")).alias("flags"))
    new = t.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), "hash", F.col("text").alias("body"), F.array("source").alias("flags"), (F.col("doc_id") % 2).cast("int").alias("trust"))
    return dml.merge_bodies(old.withColumn("trust", (F.col("id") % 3).cast("int")), new).drop("body")


@query("w7_insert_ignore", """select hash, doc_id from (select md5(text) as hash, min(doc_id) as doc_id from documents where doc_id < 300 group by 1) union all
select hash, doc_id from (select md5(text) as hash, min(doc_id) as doc_id from documents where doc_id >= 300 group by 1) where hash not in (select md5(text) from documents where doc_id < 300)""")
def w7(spark, d):
    t = T(spark, d, "documents").select(F.md5("text").alias("hash"), "doc_id")
    first = t.where("doc_id < 300").groupBy("hash").agg(F.min("doc_id").alias("doc_id"))
    return dml.insert_ignore(first, t.where("doc_id >= 300"), ["hash"], "doc_id")


@query("w9_checked_update", "select o_orderkey, case when o_orderkey % 100 = 1 then 'X' else o_orderstatus end as o_orderstatus from orders")
def w9(spark, d):
    o = T(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return dml.checked_update(o, o.where("o_orderkey % 100 = 1").withColumn("o_orderstatus", F.lit("X")), "o_orderkey")


@query("w10_guarded_restore", "select o_orderkey, case when o_orderkey % 100 = 1 and o_orderstatus <> 'F' then 'B' else o_orderstatus end as o_orderstatus from orders")
def w10(spark, d):
    o = T(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return dml.update_from(o, o.where("o_orderkey % 100 = 1").withColumn("o_orderstatus", F.lit("B")), "o_orderkey", F.col("current.o_orderstatus") != "F")


@query("w11_backup_rows", "select o_orderkey, o_totalprice from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 49)")
def w11(spark, d):
    wanted = T(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return T(spark, d, "orders").join(wanted, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("w12_cascade_delete", """select 'orders' as name, count(*) as n, count(o_custkey) as linked from orders where o_custkey % 7 <> 0 union all select 'lineitem', count(*), count(*) filter (where l_suppkey % 7 <> 0) from lineitem""")
def w12(spark, d):
    tables = {"orders": T(spark, d, "orders").select("o_orderkey", "o_custkey"), "lineitem": T(spark, d, "lineitem").select("l_orderkey", "l_suppkey")}
    gone = T(spark, d, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("id"))
    out = dml.cascade_delete(tables, gone, {"orders": ("o_custkey", "delete"), "lineitem": ("l_suppkey", "null")})
    counts = [out[t].agg(F.lit(t).alias("name"), F.count("*").alias("n"), F.count(c).alias("linked")) for t, c in (("orders", "o_custkey"), ("lineitem", "l_suppkey"))]
    return counts[0].unionByName(counts[1])


@query("w13_rebuild_swap", "select lang, count(*) as n from documents group by lang")
def w13(spark, d):
    store = Store(spark, scratch(spark))
    make = lambda: T(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    store.swap_in("stats", make)
    store.swap_in("stats", make)
    return store.read("stats")


@query("w14_subset_export", """select 'bodies' as name, count(distinct md5(text)) as n from documents where source in ('src1', 'src2') union all select 'chunk_refs', count(*) from documents where source in ('src1', 'src2')
union all select 'entities', count(distinct lang) from documents where source in ('src1', 'src2')""")
def w14(spark, d):
    t = T(spark, d, "documents").withColumn("body_id", F.md5("text"))
    tables = {"chunk_refs": t.select("doc_id", "source", "body_id", F.col("lang").alias("entity_id")), "bodies": t.select(F.col("body_id").alias("id")).distinct(), "entities": t.select(F.col("lang").alias("id")).distinct()}
    out = dml.subset(tables, ["src1", "src2"])
    counts = [df.agg(F.count("*").alias("n")).withColumn("name", F.lit(n)) for n, df in out.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("w16_sandbox_clone", "select sum(s_acctbal) > 0 as positive, count(*) as n from supplier")
def w16(spark, d):
    a, b = Store(spark, scratch(spark)), Store(spark, scratch(spark))
    a.write("supplier", T(spark, d, "supplier"))
    a.clone("supplier", b)
    return b.read("supplier").agg((F.sum("s_acctbal") > 0).alias("positive"), F.count("*").alias("n"))


@query("w17_json_rows", """select doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}' as row_json from documents""")
def w17(spark, d):
    return T(spark, d, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", "source")).alias("row_json"))


@query("w18_point_updates", "select c_custkey, case when c_custkey % 3 = 0 then 'tfidf-v0' else c_mktsegment end as c_mktsegment from customer")
def w18(spark, d):
    return dml.relabel(T(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 3, "c_mktsegment", "tfidf-v0")


@query("w19_reset_to_snapshot", """select doc_id, 'changed' as change from documents where doc_id % 3 = 0 and doc_id % 10 <> 0 and lang <> 'xx' and doc_id >= 50 union all select doc_id, 'extra' from documents where doc_id % 10 = 0 and doc_id >= 50 union all select doc_id, 'missing' from documents where doc_id < 50 and doc_id % 10 <> 0""")
def w19(spark, d):
    t = T(spark, d, "documents").select("doc_id", "lang")
    now = dml.relabel(t, "doc_id", 3, "lang", "xx").where("doc_id % 10 <> 0")
    return dml.reset_to(now, t.where("doc_id >= 50"), "doc_id")[1]


@query("j15_snapshot_diff", """select o_orderkey, 'changed' as change from orders where o_orderkey % 100 = 3 and o_orderstatus <> 'X' and o_orderkey % 7 <> 0 union all select o_orderkey, 'missing' from orders where o_orderkey % 7 = 0""")
def j15(spark, d):
    o = T(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    after = o.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 100 == 3, "X").otherwise(F.col("o_orderstatus")))
    return dml.diff(o, after, "o_orderkey")


@query("j10_borrowed_text", "select a.doc_id, md5(case when a.doc_id % 7 = 0 and b.text is not null then b.text else a.text end) as body_hash from documents a left join documents b on b.doc_id = a.doc_id + 1")
def j10b(spark, d):
    return dml.borrow_next(T(spark, d, "documents").select("doc_id", "text"), "doc_id", 7, "text").select("doc_id", F.md5("text").alias("body_hash"))


# -- procedures -----------------------------------------------------------------------------------------

@query("p1_merge_entities", """with e as (select n_nationkey as id, n_name as name, [lower(n_name)] as aliases from nation), l as (select distinct s_nationkey as src, c_nationkey as dst, 'trades' as rel from supplier, customer),
m as (select distinct case when src = 3 then 4 else src end as src, case when dst = 3 then 4 else dst end as dst, rel from l where (src = 3 or dst = 3)), k as (select * from l where src <> 3 and dst <> 3 union select * from m where src <> dst)
select 'entities' as name, count(*) as n, max(case when id = 4 then array_to_string(list_sort(list_distinct(aliases || (select aliases || [lower(name)] from e where id = 3))), ',') end) as detail from e where id <> 3
union all select 'links', count(*), (sum(src * 100 + dst))::bigint::varchar from k""")
def p1(spark, d):
    n = T(spark, d, "nation")
    e = n.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.array(F.lower("n_name")).alias("aliases"))
    s = T(spark, d, "supplier").select(F.col("s_nationkey").cast("bigint").alias("src"), F.lit(1).alias("j")).distinct()
    c = T(spark, d, "customer").select(F.col("c_nationkey").cast("bigint").alias("dst"), F.lit(1).alias("j")).distinct()
    links = s.join(F.broadcast(c), "j").select("src", "dst", F.lit("trades").alias("rel")).distinct()
    chunks = T(spark, d, "customer").select(F.col("c_nationkey").cast("bigint").alias("entity_id"))
    e2, _, l2 = procedures.merge_entities(e, chunks, links, 3, 4)
    a = e2.agg(F.lit("entities").alias("name"), F.count("*").alias("n"), F.max(F.when(F.col("id") == 4, F.array_join("aliases", ","))).alias("detail"))
    return a.unionByName(l2.agg(F.lit("links").alias("name"), F.count("*").alias("n"), F.sum(F.col("src") * 100 + F.col("dst")).cast("string").alias("detail")))


@query("p2_audit_rows", """select 'supplier' as table_name, s_suppkey as row_id, 'UPDATE' as action, 'ann' as actor from supplier where s_suppkey % 9 = 0 and s_suppkey % 10 <> 0 union all select 'supplier', s_suppkey, 'DELETE', 'ann' from supplier where s_suppkey % 10 = 0""")
def p2(spark, d):
    s = T(spark, d, "supplier").select("s_suppkey", "s_name")
    after = dml.relabel(s.where("s_suppkey % 10 <> 0"), "s_suppkey", 9, "s_name", "renamed")
    return procedures.audit_rows(s, after, "s_suppkey", "supplier", "ann").select("table_name", "row_id", "action", "actor")


@query("p3_user_activity", """select u.user_id, coalesce(s.n, 0) as searches, s.last as last_search, coalesce(b.n, 0) as bookmarks from (select distinct user_id from events) u
left join (select user_id, count(*) as n, max(ts) as last from events where event_type = 'view' group by user_id) s using (user_id) left join (select user_id, count(*) as n from events where event_type = 'click' group by user_id) b using (user_id)""")
def p3(spark, d):
    e = T(spark, d, "events")
    return procedures.user_activity(e.select("user_id").distinct(), e.where("event_type = 'view'").select("user_id", F.col("ts").alias("at")), e.where("event_type = 'click'").select("user_id"))


@query("p4_changed_keys", "select event_id, case when event_id % 3 = 0 then ['v'] when event_id % 3 = 1 then ['k', 'v'] else [] end as keys from events")
def p4(spark, d):
    i = F.col("event_id")
    old = F.to_json(F.struct(F.lit(1).alias("k"), i.alias("v")))
    new = F.to_json(F.struct(F.when(i % 3 == 1, 2).otherwise(1).alias("k"), F.when(i % 3 == 2, i).otherwise(i + 1).alias("v")))
    return T(spark, d, "events").select("event_id", procedures.changed_keys(old, new).alias("keys"))


@query("p5_roles", "select c_custkey, case c_custkey % 4 when 0 then 'viewer' when 1 then 'editor' when 2 then 'admin' else 'guest' end as role, c_custkey % 4 in (1, 2) as may_edit, c_custkey % 4 = 2 as may_admin from customer")
def p5(spark, d):
    role = F.element_at(F.array(*map(F.lit, ("viewer", "editor", "admin", "guest"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    t = T(spark, d, "customer").select("c_custkey", role.alias("role"))
    return t.withColumn("may_edit", procedures.allowed(F.col("role"), "editor")).withColumn("may_admin", procedures.allowed(F.col("role"), "admin"))


# -- health and repair ----------------------------------------------------------------------------------

@query("g4_version_skew", "select 100.0::double * count(*) filter (where vec_id % 9 = 0) / count(*) as skew_pct from embeddings")
def g4(spark, d):
    docs = T(spark, d, "embeddings").withColumn("model_version", F.when(F.col("vec_id") % 9 == 0, "old").otherwise("now"))
    return spark.createDataFrame([(health.version_skew(docs, "now"),)], "skew_pct double")


@query("g10_classify", """with m as (select event_id, value, case when event_id % 5 = 0 then 0.9::double else 1.0 end as recall, case when event_id % 7 = 0 then 12.0::double else 0.0 end as skew, case when event_id % 4 = 0 then 25.0::double else 3.0 end as dead, case when event_id % 6 = 0 then 22.0::double else -30.0 end as shift,
case when event_id % 11 = 0 then 3.0::double else 0.0 end as mismatch, event_id % 13 <> 0 as index_exists, event_id % 3 <> 0 as index_used, case when event_id % 8 = 0 then 0.94::double else 0.99 end as ann, 1.0::double as baseline from events),
i as (select event_id, list_filter([case when recall < 0.95 then 'LOW_RECALL' end, case when skew > 0 then 'VERSION_SKEW' end, case when dead > 20 then 'TABLE_BLOAT' end, case when shift > 20 then 'DISTANCE_DRIFT' end, case when mismatch > 0 then 'VECTOR_MISMATCH' end,
case when not index_exists then 'INDEX_MISSING' when ann < greatest(0.90, baseline - 0.03) then 'INDEX_DEGRADED' when not index_used then 'INDEX_NOT_USED' end], lambda x: x is not null) as issues from m)
select event_id, issues, case when len(issues) = 0 then 'HEALTHY' when list_has_any(issues, ['LOW_RECALL', 'INDEX_MISSING']) then 'CRITICAL' when issues = ['INDEX_NOT_USED'] then 'WARNING' else 'DEGRADED' end as status from i""")
def g10(spark, d):
    i = F.col("event_id")
    every = lambda n, a, b: F.when(i % n == 0, a).otherwise(b)
    rows = T(spark, d, "events").select(
        "event_id", every(5, 0.9, 1.0).alias("recall"), every(7, 12.0, 0.0).alias("skew"), every(4, 25.0, 3.0).alias("dead"), every(6, 22.0, -30.0).alias("shift"), every(11, 3.0, 0.0).alias("mismatch"),
        (i % 13 != 0).alias("index_exists"), (i % 3 != 0).alias("index_used"), every(8, 0.94, 0.99).alias("ann"), F.lit(1.0).alias("baseline"))
    return health.with_health(rows).select("event_id", "issues", "status")


@query("g1_canaries", """with q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 40 = 0), d as (select query_id, vec_id, round(list_cosine_distance(embedding::double[], q), 6) as distance from embeddings, q),
r as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from d) select query_id as id, list(vec_id order by rank) as expected, (select max(vec_id) from embeddings) as corpus_max_id from r where rank <= 10 group by query_id""")
def g1(spark, d):
    docs = T(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return health.build_canaries(docs, docs.where("id % 40 = 0")).select("id", "expected", "corpus_max_id")


_CANARY = """with q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 40 = 0 and vec_id <= 300), d as (select query_id, vec_id, round(list_cosine_distance(embedding::double[], q), 6) as distance from embeddings, q where vec_id <= 300),
e as (select * from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from d) where rank <= 10),
b as (select vec_id, list_transform(range(0, 64), lambda i: case when vec_id % 4 <> 0 then embedding[i + 1]::double else case when i % 2 = 0 then -1 else 1 end * embedding[(i - 17 + 64) % 64 + 1]::double end) as v from embeddings {0}),
d2 as (select query_id, vec_id, round(list_cosine_distance(v, q), 6) as distance from b, q), a as (select * from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from d2) where rank <= 10)
select e.query_id as id, count(a.vec_id) / count(*)::double as recall, min(n.nearest) as nearest from e left join a using (query_id, vec_id) join (select query_id, min(distance) as nearest from a group by query_id) n using (query_id) group by e.query_id"""


def _canary(spark, d, horizon):
    docs = T(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    canaries = health.build_canaries(docs.where("id <= 300"), docs.where("id % 40 = 0 and id <= 300"))
    broken = docs.withColumn("embedding", F.when(F.col("id") % 4 == 0, V.permuted("embedding")).otherwise(V.doubles(F.col("embedding"))))
    return health.canary_recall(broken, canaries, horizon=horizon)


@query("g3_canary_recall", _CANARY.format("where vec_id <= 300"))
def g3(spark, d):
    return _canary(spark, d, True)


@query("g27_naive_recall", _CANARY.format(""))
def g27(spark, d):
    return _canary(spark, d, False)


@query("g6_distance_shift", "with b as (select event_type, arg_min(value, event_id) as base, avg(value) as now from events group by event_type) select event_type, round(100 * (now - base) / base, 6) as shift_pct, 100 * (now - base) / base > 20 as alarm from b")
def g6(spark, d):
    b = T(spark, d, "events").groupBy("event_type").agg(F.min_by("value", "event_id").alias("base"), F.avg("value").alias("now"))
    pct = 100 * (F.col("now") - F.col("base")) / F.col("base")
    return b.select("event_type", F.round(pct, 6).alias("shift_pct"), (pct > health.MAX_SHIFT).alias("alarm"))


@query("g19_failure_memory", """with e as (select event_id as id, event_type as signature, ts as started_at, case user_id % 5 when 0 then 'FAILED' when 1 then 'SUCCEEDED' when 2 then 'RUNNING' when 3 then 'PARTIAL' else 'ROLLED_BACK' end as status, user_id % 7 = 0 as transient from events)
select signature, arg_max(status, id) in ('FAILED', 'ROLLED_BACK', 'ESCALATED', 'PARTIAL') as blocked from e where status <> 'RUNNING' and not transient and started_at > timestamp '2024-01-30 12:00:00' - interval 36000 seconds group by signature""")
def g19(spark, d):
    status = F.element_at(F.array(*map(F.lit, ("FAILED", "SUCCEEDED", "RUNNING", "PARTIAL", "ROLLED_BACK"))), (F.col("user_id") % 5 + 1).cast("int"))
    e = T(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("signature"), F.col("ts").alias("started_at"), status.alias("status"), (F.col("user_id") % 7 == 0).alias("transient"))
    return health.blocked(e, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"), 36000)


def embedder():
    """The embedder of stored documents: never a zero vector, whose faults couldn't be seen."""
    return embedders.hashed(never_zero=True)


def stored(spark, d):
    """Documents with the embedding of their text."""
    t = T(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return t.withColumn("embedding", embedder()(F.col("body"))).withColumn("model_version", F.lit("now"))


def struck(vector: str):
    """The vector permuted, or negated where permuting gives the same vector again."""
    moved = V.permuted(vector)
    return F.when(V.cosine_distance(moved, V.doubles(F.col(vector))) > health.TOLERANCE, moved).otherwise(F.transform(vector, lambda x: -x.cast("double")))


@query("a27_inconsistent_rows", "select (count(*) filter (where doc_id % 5 = 0) + count(*) filter (where doc_id % 4 = 0))::bigint as n from documents")
def a27(spark, d):
    rows = stored(spark, d)
    broken = rows.withColumn("embedding", F.when(F.col("id") % 5 == 0, V.permuted("embedding")).otherwise(F.col("embedding")))
    broken = faults.relabel(broken, 4, "old")
    off = health.off_by(broken, embedder())
    bad = F.count_if(F.coalesce(F.col("off"), F.lit(2.0)) > health.TOLERANCE) + F.count_if(F.col("model_version") != "now")
    return off.agg(bad.cast("bigint").alias("n"))


@query("g13_reembed_stale", "select count(*) as n, 0::bigint as stale, count(*) filter (where doc_id % 4 = 0) as backed_up from documents")
def g13(spark, d):
    fixed, backup = health.reembed_stale(faults.relabel(stored(spark, d), 4, "old"), embedder(), "now")
    return fixed.agg(F.count("*").alias("n"), F.count_if(F.col("model_version") != "now").alias("stale")).join(backup.agg(F.count("*").alias("backed_up")), F.lit(True))


@query("g14_repair_vectors", "select count(*) as n, 0::bigint as bad, count(*) filter (where doc_id % 5 = 0) as repaired from documents")
def g14(spark, d):
    rows = stored(spark, d)
    broken = rows.withColumn("embedding", F.when(F.col("id") % 5 == 0, struck("embedding")).otherwise(F.col("embedding")))
    fixed, backup = health.repair_vectors(broken, embedder(), "now")
    left = health.off_by(fixed, embedder()).agg(F.count("*").alias("n"), F.count_if(F.col("off") > health.TOLERANCE).alias("bad"))
    return left.join(backup.agg(F.count("*").alias("repaired")), F.lit(True))


@query("g15_rollback", "select doc_id as id, doc_id % 5 = 0 and doc_id % 2 = 0 as broken from documents")
def g15(spark, d):
    rows = stored(spark, d)
    broken = rows.withColumn("embedding", F.when(F.col("id") % 5 == 0, struck("embedding")).otherwise(F.col("embedding")))
    fixed, backup = health.repair_vectors(broken, embedder(), "now")
    touched = fixed.withColumn("embedding", F.when(F.col("id") % 2 != 0, V.normalise(F.transform("embedding", lambda x: x + 1e-9))).otherwise(F.col("embedding")))
    back = health.rollback(touched, backup)
    return health.off_by(back, embedder()).select("id", F.when(F.col("id").isNotNull(), F.coalesce("off", F.lit(0.0)) > health.TOLERANCE).alias("broken"))


@query("g23_exact_share", "select doc_id as id from documents order by md5(doc_id || 'seed'), doc_id limit (select greatest(1, round_even(count(*) * 25 / 100.0, 0))::bigint from documents)")
def g23(spark, d):
    return sampling.exact_share(T(spark, d, "documents").select(F.col("doc_id").alias("id")), "id", 25, "seed")


@query("v4_graph_neighbours")
def v4(spark, d):
    e = T(spark, d, "embeddings")
    return hnsw.ann_knn(e, e.where("vec_id % 10 = 0"))


@query("v5_graph_adjacency")
def v5(spark, d):
    return hnsw.adjacency(T(spark, d, "embeddings"))


@query("a23_graph_recall")
def a23(spark, d):
    e = T(spark, d, "embeddings")
    q = e.where("vec_id % 10 = 0")
    return knn.recall(knn.exact_knn(e, q, 10), hnsw.ann_knn(e, q)).agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"))


@query("v10_tfidf_svd")
def v10(spark, d):
    t = T(spark, d, "documents").select("doc_id", "text")
    return embedders.TfidfSvd(16, 500).fit(t).transform(t).select("doc_id", "embedding")


@query("v14_principal_axes")
def v14(spark, d):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = T(spark, d, "embeddings").withColumn("v", array_to_vector(V.doubles(F.col("embedding"))))
    return PCA(k=3, inputCol="v", outputCol="p").fit(e).transform(e).select("vec_id", vector_to_array("p").alias("at"))


# -- streams --------------------------------------------------------------------------------------------

@query("g21_daily_stream", "select * from (select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2) where start + interval 1 day <= (select max(ts) from events) - interval 2 days")
def g21(spark, d):
    root = scratch(spark)
    T(spark, d, "events").write.parquet(f"{root}/in")
    monitor.run_available(monitor.daily_counts(monitor.events(spark, f"{root}/in")), f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema("start timestamp, event_type string, n bigint, total double").parquet(f"{root}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
