"""More queries of maintenance: logs, snapshots, plans, sentinels, backfills, caches and forced search paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions import vectors
from corvane.operators import dml, health, hnsw, knn
from corvane.operators.store import Store
from corvane.plans.common import table as T
from corvane.plans.maintenance import embedder, scratch, stored

_NEAR = """with q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 100 = 5), d as (select query_id, vec_id, round(list_cosine_distance(embedding::double[], q), 6) as distance from embeddings, q),
r as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from d)"""


@query("g2_logged_search", f"{_NEAR} select query_id, list(vec_id order by rank) as result_ids, list(distance order by rank) as distances from r where rank <= 10 group by query_id")
def g2(spark, d):
    e = T(spark, d, "embeddings")
    store = Store(spark, scratch(spark))
    near = knn.exact_knn(e, e.where("vec_id % 100 = 5"), 10).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "distance"))).alias("r"))
    store.append("query_log", near.select("query_id", F.transform("r", lambda x: x["vec_id"]).alias("result_ids"), F.transform("r", lambda x: x["distance"]).alias("distances")))
    return store.read("query_log")


@query("g5_dead_pct", "select 100.0::double * count(*) filter (where vec_id % 5 = 0) / (count(*) + count(*) filter (where vec_id % 5 = 0)) as dead_pct from embeddings")
def g5(spark, d):
    e, store = T(spark, d, "embeddings"), Store(spark, scratch(spark))
    store.write("e", e)
    store.write("e", dml.relabel(e, "vec_id", 5, "label", "0").withColumn("label", F.col("label").cast("int")), superseded=e.where("vec_id % 5 = 0").count())
    return spark.createDataFrame([(store.dead_pct("e"),)], "dead_pct double")


@query("g8_index_recall")
def g8(spark, d):
    e = T(spark, d, "embeddings")
    probes = e.where("vec_id % 20 = 3")
    return knn.distance_recall(knn.exact_knn(e, probes, 10), hnsw.ann_knn(e, probes)).agg(F.avg("recall").alias("ann_recall"), F.count("*").alias("probes"))


@query("g9_sentinel", "select 100.0::double * count(*) filter (where doc_id % 4 = 0) / count(*) as mismatch_pct from (select doc_id from documents order by md5(doc_id || 's'), doc_id limit 64)")
def g9(spark, d):
    rows = stored(spark, d)
    broken = rows.withColumn("embedding", F.when(F.col("id") % 4 == 0, vectors.permuted("embedding")).otherwise(F.col("embedding")))
    return spark.createDataFrame([(health.sentinel_mismatch(broken, embedder(), "now", seed="s"),)], "mismatch_pct double")


@query("g11_snapshots", """select row_number() over (order by ts::date) as id, ts::date as day, round(avg(value), 6) as mean_distance, round(100 * (avg(value) - first(avg(value)) over (order by ts::date)) / first(avg(value)) over (order by ts::date), 4) as shift from events group by ts::date""")
def g11(spark, d):
    days = T(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("m"))
    w = Window.orderBy("day")  # a row a day
    first = F.first("m").over(w)
    return days.select(F.row_number().over(w).cast("bigint").alias("id"), "day", F.round("m", 6).alias("mean_distance"), F.round(100 * (F.col("m") - first) / first, 4).alias("shift"))


@query("g12_plans", """with i as (select event_id, list_filter([case when event_id % 2 = 0 then 'VERSION_SKEW' end, case when event_id % 3 = 0 then 'VECTOR_MISMATCH' end, case when event_id % 5 = 0 then 'INDEX_MISSING' when event_id % 7 = 0 then 'INDEX_DEGRADED' end,
case when event_id % 11 = 0 then 'TABLE_BLOAT' end, case when event_id % 13 = 0 then 'LOW_RECALL' end, case when event_id % 17 = 0 then 'DISTANCE_DRIFT' end], lambda x: x is not null) as s from events),
o as (select event_id, s, case when list_has_any(s, ['VERSION_SKEW', 'VECTOR_MISMATCH', 'INDEX_DEGRADED']) then [] else list_sort(list_intersect(s, ['LOW_RECALL', 'DISTANCE_DRIFT'])) end as open from i),
a as (select event_id, open, list_filter([case when list_contains(s, 'VERSION_SKEW') then 'REEMBED_STALE' end, case when list_contains(s, 'VECTOR_MISMATCH') then 'REPAIR_VECTORS' end, case when len(open) > 0 then 'SCAN_VECTORS' end,
case when list_has_any(s, ['INDEX_MISSING', 'INDEX_DEGRADED']) then 'REBUILD_INDEX' end, case when list_has_any(s, ['TABLE_BLOAT', 'VERSION_SKEW', 'VECTOR_MISMATCH']) or len(open) > 0 then 'VACUUM' end], lambda x: x is not null) as actions from o)
select event_id, array_to_string(actions, ',') || '|' || array_to_string(open, ',') as signature from a""")
def g12(spark, d):
    i = F.col("event_id")
    codes = F.array_compact(F.array(
        F.when(i % 2 == 0, "VERSION_SKEW"), F.when(i % 3 == 0, "VECTOR_MISMATCH"), F.when(i % 5 == 0, "INDEX_MISSING").when(i % 7 == 0, "INDEX_DEGRADED"),
        F.when(i % 11 == 0, "TABLE_BLOAT"), F.when(i % 13 == 0, "LOW_RECALL"), F.when(i % 17 == 0, "DISTANCE_DRIFT")))
    return T(spark, d, "events").select("event_id", health.signature(codes).alias("signature"))


@query("g25_checked_restore", "select doc_id as id, false as broken from documents")
def g25(spark, d):
    from corvane.operators import faults

    rows = stored(spark, d).withColumn("mark", F.md5(F.coalesce("body", F.lit(""))))  # rows of one id and text have one vector
    backup = rows.where("id % 3 = 0").select("id", "mark", "embedding", "model_version")
    broken = rows.withColumn("embedding", F.when(F.col("id") % 3 == 0, vectors.permuted("embedding")).otherwise(F.col("embedding")))
    back = faults.restore(broken, backup, backup.count(), ("id", "mark"))
    return health.off_by(back, embedder()).select("id", (F.coalesce("off", F.lit(0.0)) > health.TOLERANCE).alias("broken"))


@query("v15_backfill_codes", "select count(*) as n, count(*) filter (where vec_id % 3 = 0) as added from embeddings")
def v15(spark, d):
    e = T(spark, d, "embeddings")
    ranges = knn.scale(e)
    have = knn.with_codes(e.where("vec_id % 3 <> 0"), ranges).select("vec_id", "codes")
    missing = e.join(have.select("vec_id"), "vec_id", "left_anti")
    made = have.unionByName(knn.with_codes(missing, ranges).select("vec_id", "codes"))
    return made.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % 3 == 0).alias("added"))


@query("v16_paths_agree")
def v16(spark, d):
    e = T(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0")
    return knn.recall(knn.exact_knn(e, q, 10), hnsw.ann_knn(e, q))


@query("k2_forced_exact", f"{_NEAR} select query_id, rank, vec_id, distance from r where rank <= 5")
def k2(spark, d):
    e = T(spark, d, "embeddings")
    return knn.exact_knn(e, e.where("vec_id % 100 = 5"), 5)


@query("k4_stable_order", "select l_orderkey, l_linenumber, l_quantity from lineitem order by l_quantity desc, l_orderkey, l_linenumber limit 500")
def k4(spark, d):
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber").limit(500)


@query("k5_top_by_group", "select * from (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders) where place <= 3")
def k5(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return T(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).cast("bigint").alias("place")).where("place <= 3")


@query("w15_backup_restore", "select count(*) as n, sum(p_partkey) as keys, round(sum(p_retailprice), 2) as price from part")
def w15(spark, d):
    live, backup, again = (Store(spark, scratch(spark)) for _ in range(3))
    live.write("part", T(spark, d, "part"))
    live.clone("part", backup)
    live.reload("part", T(spark, d, "part").limit(0))
    backup.clone("part", again)
    return again.read("part").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"), F.round(F.sum("p_retailprice"), 2).alias("price"))


@query("w8_bulk_codes", "select count(*) as n, sum(len(embedding))::bigint as codes from embeddings")
def w8(spark, d):
    e, store = T(spark, d, "embeddings"), Store(spark, scratch(spark))
    store.write("codes", knn.with_codes(e, knn.scale(e)).select("vec_id", vectors.pack("codes").alias("packed")))
    return store.read("codes").agg(F.count("*").alias("n"), F.sum(F.length("packed")).alias("codes"))


@query("w20_close_fault", "select 'HEALED' as status, 1::bigint as n union all select 'RESTORED', 2")
def w20(spark, d):
    store = Store(spark, scratch(spark))
    store.write("faults", spark.createDataFrame([(1, "RESTORED"), (2, "ACTIVE"), (3, "RESTORED")], "id bigint, status string"))
    faults = store.read("faults")
    closed = faults.where("status = 'ACTIVE'").withColumn("status", F.lit("HEALED"))
    store.write("faults", dml.upsert(faults, closed, ["id"]), superseded=closed.count(), expect=1)
    return store.read("faults").groupBy("status").agg(F.count("*").alias("n"))


@query("s11_seed_once", "select count(*) as n, true as first, false as second from region")
def s11(spark, d):
    store, r = Store(spark, scratch(spark)), T(spark, d, "region")
    first, second = store.seed("region", r), store.seed("region", r.limit(0))
    return store.read("region").agg(F.count("*").alias("n")).select("n", F.lit(first).alias("first"), F.lit(second).alias("second"))


@query("s14_saved_map", "select vec_id, round(embedding[1], 6) as x, round(embedding[2], 6) as y, round(embedding[3], 6) as z from embeddings")
def s14(spark, d):
    store = Store(spark, scratch(spark))
    at = lambda i: F.round(F.col("embedding")[i], 6)
    store.write("map", T(spark, d, "embeddings").select("vec_id", at(0).alias("x"), at(1).alias("y"), at(2).alias("z")))
    return store.read("map")


@query("dashboard", """select (select count(*) from documents) as passages, (select count(distinct md5(text)) from documents) as texts, (select count(distinct source) from documents) as sources, (select count(distinct user_id) from events) as users,
(select count(*) from events where ts > timestamp '2024-01-30' - interval 7 days) as recent""")
def dashboard(spark, d):
    a = T(spark, d, "documents").agg(F.count("*").alias("passages"), F.countDistinct(F.md5("text")).alias("texts"), F.countDistinct("source").alias("sources"))
    b = T(spark, d, "events").agg(F.countDistinct("user_id").alias("users"), F.count_if(F.col("ts") > F.lit("2024-01-30").cast("timestamp_ntz") - F.expr("interval 7 days")).alias("recent"))
    return a.join(b, F.lit(True))
