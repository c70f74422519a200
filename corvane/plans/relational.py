"""Relational queries: scans, filters, joins, aggregates, windows, orders and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.operators import sampling
from corvane.plans.common import table as T

A = "alias"


@query("s2_round_robin", """with r as (select doc_id, source, row_number() over (partition by source order by doc_id) as turn from documents)
select doc_id, source, turn from r order by turn, source limit 90""")
def s2(spark, d):
    return sampling.round_robin(T(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 90)


@query("s3_ordered_scan", "select doc_id, source as category, md5(text) as body_hash from documents order by doc_id")
def s3(spark, d):
    return T(spark, d, "documents").select("doc_id", F.col("source").alias("category"), F.md5("text").alias("body_hash")).orderBy("doc_id")


@query("s4_stride_sample", """with c as (select count(*) as n, count(*) filter (where l_returnflag = 'N') as bulk from lineitem),
s as (select greatest(1, ceil(bulk / greatest(20000 - (n - bulk), 1000)::double))::bigint as stride from c)
select l_orderkey, l_linenumber, l_returnflag from lineitem where l_returnflag <> 'N' or l_orderkey % (select stride from s) = 0""")
def s4(spark, d):
    rows = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return sampling.stride_sample(rows, F.col("l_returnflag") == "N", "l_orderkey", 20000)


@query("s5_seeded_sample", "select doc_id, lang from documents order by md5(doc_id::varchar || 'probe'), doc_id limit 64")
def s5(spark, d):
    return sampling.hashed_sample(T(spark, d, "documents").select("doc_id", "lang"), "doc_id", 64, "probe")


@query("f1_membership", "select c_custkey, c_name from customer where c_nationkey in (1, 5, 9) and c_mktsegment in ('BUILDING', 'MACHINERY')")
def f1(spark, d):
    return T(spark, d, "customer").where(F.col("c_nationkey").isin(1, 5, 9) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_name")


@query("f2_exclusion", "select doc_id, source from documents where source not in ('src0', 'src1', 'src2')")
def f2(spark, d):
    return T(spark, d, "documents").where(~F.col("source").isin("src0", "src1", "src2")).select("doc_id", "source")


@query("f3_case_folded", "select p_partkey, upper(p_brand) as brand from part where lower(p_brand) = 'brand#11' or upper(p_type) like 'PROMO%'")
def f3(spark, d):
    return T(spark, d, "part").where((F.lower("p_brand") == "brand#11") | F.upper("p_type").like("PROMO%")).select("p_partkey", F.upper("p_brand").alias("brand"))


@query("f4_array_overlap", """select doc_id, list_sort(list_distinct(regexp_extract_all(text, '[A-Z0-9]{16,}'))) as literals from documents
where len(regexp_extract_all(text, '[A-Z0-9]{16,}')) > 0""")
def f4(spark, d):
    rows = T(spark, d, "documents").select("doc_id", F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z0-9]{16,}"), 0))).alias("literals"))
    return rows.where(F.arrays_overlap("literals", "literals"))


@query("f5_array_containment", """with e as (select user_id, list_sort(list(distinct event_type)) as kinds from events group by user_id)
select user_id, kinds from e where list_has_all(['click', 'view', 'purchase', 'signup'], kinds)""")
def f5(spark, d):
    kinds = T(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    return kinds.where(F.size(F.array_except("kinds", F.array(*map(F.lit, ("click", "view", "purchase", "signup"))))) == 0)


@query("f6_regex", r"""select doc_id, regexp_matches(text, '\d{3}-\d{4}') as has_number, regexp_matches(text, '(^|\n)\s*License') as opens_line from documents
where regexp_matches(text, '[Ll]icen[cs]e') or regexp_matches(text, '\w+@\w+\.\w+')""")
def f6(spark, d):
    t = T(spark, d, "documents").where(F.col("text").rlike("[Ll]icen[cs]e") | F.col("text").rlike(r"\w+@\w+\.\w+"))
    return t.select("doc_id", F.col("text").rlike(r"\d{3}-\d{4}").alias("has_number"), F.col("text").rlike(r"(^|\n)\s*License").alias("opens_line"))


@query("f7_substring", "select c_custkey, c_name from customer where contains(lower(c_name), lower('R#0000000'))")
def f7(spark, d):
    return T(spark, d, "customer").where(F.contains(F.lower("c_name"), F.lower(F.lit("R#0000000")))).select("c_custkey", "c_name")


@query("f9_modulo", "select o_orderkey, o_orderkey % 7 as remainder from orders where o_orderkey % 7 in (0, 3)")
def f9(spark, d):
    return T(spark, d, "orders").where((F.col("o_orderkey") % 7).isin(0, 3)).select("o_orderkey", (F.col("o_orderkey") % 7).alias("remainder"))


@query("f10_case_coalesce", """select event_id, case when value < 10 then 'low' when value < 100 then 'mid' else 'high' end as band, coalesce(nullif(event_type, 'view'), 'seen') as kind,
least(value, 50.0) as at_most, greatest(value, 5.0) as at_least from events""")
def f10(spark, d):
    v = F.col("value")
    return T(spark, d, "events").select(
        "event_id", F.when(v < 10, "low").when(v < 100, "mid").otherwise("high").alias("band"), F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("seen")).alias("kind"),
        F.least(v, F.lit(50.0)).alias("at_most"), F.greatest(v, F.lit(5.0)).alias("at_least"))


@query("f11_time_window", "select event_id, ts from events where ts > timestamp '2024-01-30 00:00:00' - interval 7 days and ts <= timestamp '2024-01-30 00:00:00'")
def f11(spark, d):
    now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return T(spark, d, "events").where((F.col("ts") > now - F.expr("interval 7 days")) & (F.col("ts") <= now)).select("event_id", "ts")


@query("f12_json_predicate", "select event_id, (props ->> '$.k')::bigint as k from events where (props ->> '$.k')::bigint % 10 = 3")
def f12(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return T(spark, d, "events").select("event_id", k.alias("k")).where(F.col("k") % 10 == 3)


@query("f14_pattern_checks", r"""select c_custkey, regexp_matches(lower(replace(c_name, '#', '_')), '^[a-z0-9_]{3,32}$') as valid_name, c_mktsegment in ('BUILDING', 'AUTOMOBILE', 'MACHINERY') as valid_role,
c_acctbal >= 0 as valid_amount from customer""")
def f14(spark, d):
    return T(spark, d, "customer").select(
        "c_custkey", F.lower(F.replace("c_name", F.lit("#"), F.lit("_"))).rlike("^[a-z0-9_]{3,32}$").alias("valid_name"),
        F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE", "MACHINERY").alias("valid_role"), (F.col("c_acctbal") >= 0).alias("valid_amount"))


@query("f15_visibility", """select d.doc_id, d.source from documents d where not exists (select 1 from (select source from documents group by source having count(*) filter (where lang = 'de') > avg(doc_id) * 0 + 5) h where h.source = d.source)
and d.doc_id % 3 = 1""")
def f15(spark, d):
    docs = T(spark, d, "documents").select("doc_id", "source", "lang")
    hidden = docs.groupBy("source").agg(F.count_if(F.col("lang") == "de").alias("n")).where("n > 5").select("source")
    return docs.where("doc_id % 3 = 1").join(hidden, "source", "left_anti").select("doc_id", "source")


# -- joins ----------------------------------------------------------------------------------------------

@query("j1_three_way", """select l_orderkey, l_linenumber, o_orderdate, c_name from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
where c_mktsegment = 'BUILDING' and o_orderdate < timestamp '1995-03-15' order by l_orderkey, l_linenumber""")
def j1(spark, d):
    c = T(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    o = T(spark, d, "orders").where("o_orderdate < timestamp '1995-03-15'").select("o_orderkey", "o_custkey", "o_orderdate")
    rows = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("l_orderkey", "l_linenumber", "o_orderdate", "c_name").orderBy("l_orderkey", "l_linenumber")


@query("j2_view_join", "select d.doc_id, d.source, l.quality, l.toxic, length(d.text) as size from documents d join labels l on l.doc_id = d.doc_id")
def j2(spark, d):
    T(spark, d, "documents").join(T(spark, d, "labels"), "doc_id").createOrReplaceTempView("corvane_chunks")
    return spark.sql("select doc_id, source, quality, toxic, length(text) as size from corvane_chunks")


@query("j3_lateral_first", """select md5(text) as body_hash, min(doc_id) as first_doc, arg_min(source, doc_id) as first_source from documents group by md5(text)""")
def j3(spark, d):
    return T(spark, d, "documents").groupBy(F.md5("text").alias("body_hash")).agg(F.min("doc_id").alias("first_doc"), F.min_by("source", "doc_id").alias("first_source"))


@query("j4_daily_zero_filled", """with days as (select unnest(generate_series(date '2024-01-20', date '2024-02-02', interval 1 day))::date as day)
select day, count(event_id) as n from days left join events on ts >= day and ts < day + interval 1 day and event_type = 'purchase' group by day order by day""")
def j4(spark, d):
    days = spark.sql("select explode(sequence(date '2024-01-20', date '2024-02-02', interval 1 day)) as day")
    seen = T(spark, d, "events").where("event_type = 'purchase'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.join(seen, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n")).orderBy("day")


@query("j5_unnest", """select p_partkey, unnest([p_name] || string_split(p_type, ' ')) as name from part""")
def j5(spark, d):
    return T(spark, d, "part").select("p_partkey", F.explode(F.concat(F.array("p_name"), F.split("p_type", " "))).alias("name"))


@query("j6_top_then_join", """with top as (select o_custkey, sum(o_totalprice) as total from orders group by o_custkey order by round(total, 2) desc, o_custkey limit 5)
select o_custkey, o_orderkey, o_orderpriority from top join orders using (o_custkey) where o_orderpriority = '1-URGENT'""")
def j6(spark, d):
    orders = T(spark, d, "orders")
    top = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")).orderBy(F.round("total", 2).desc(), "o_custkey").limit(5).select("o_custkey")
    return orders.where("o_orderpriority = '1-URGENT'").join(F.broadcast(top), "o_custkey").select("o_custkey", "o_orderkey", "o_orderpriority")


@query("j7_anti_join", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def j7(spark, d):
    return T(spark, d, "customer").select("c_custkey").join(T(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("j8_not_in", "select p_partkey, p_name from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def j8(spark, d):
    used = T(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return T(spark, d, "part").select("p_partkey", "p_name").join(used, "p_partkey", "left_anti")


@query("j9_semi_join", "select s_suppkey, s_name from supplier where s_suppkey in (select l_suppkey from lineitem where l_returnflag = 'R' and l_discount > 0.09)")
def j9(spark, d):
    used = T(spark, d, "lineitem").where("l_returnflag = 'R' and l_discount > 0.09").select(F.col("l_suppkey").alias("s_suppkey"))
    return T(spark, d, "supplier").select("s_suppkey", "s_name").join(used, "s_suppkey", "left_semi")


@query("j10_offset_self_join", "select a.doc_id, b.doc_id as next_id, md5(b.text) as next_hash from documents a join documents b on b.doc_id = a.doc_id + 1 where a.doc_id % 7 = 0")
def j10(spark, d):
    docs = T(spark, d, "documents").select("doc_id", "text")
    b = docs.select(F.col("doc_id").alias("next_id"), F.md5("text").alias("next_hash"))
    return docs.where("doc_id % 7 = 0").select("doc_id").join(b, F.col("next_id") == F.col("doc_id") + 1)


@query("j11_join_values", "select o_orderkey, label from orders join (values ('F', 'finished'), ('O', 'open'), ('P', 'partial')) v(code, label) on o_orderstatus = code")
def j11(spark, d):
    v = spark.createDataFrame([("F", "finished"), ("O", "open"), ("P", "partial")], "code string, label string")
    return T(spark, d, "orders").join(F.broadcast(v), F.col("o_orderstatus") == F.col("code")).select("o_orderkey", "label")


@query("j13_both_directions", """with e as (select distinct o_custkey as src, l_suppkey as dst from orders join lineitem on l_orderkey = o_orderkey where o_orderkey < 400)
select src as node, dst as other, 'out' as way, s_name as name from e join supplier on s_suppkey = dst union all select dst, src, 'in', c_name from e join customer on c_custkey = src""")
def j13(spark, d):
    o = T(spark, d, "orders").where("o_orderkey < 400").select("o_orderkey", F.col("o_custkey").alias("src"))
    e = o.join(T(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("dst")), F.col("l_orderkey") == F.col("o_orderkey")).select("src", "dst").distinct()
    out = e.join(T(spark, d, "supplier"), F.col("s_suppkey") == F.col("dst")).select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("out").alias("way"), F.col("s_name").alias("name"))
    back = e.join(T(spark, d, "customer"), F.col("c_custkey") == F.col("src")).select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("in").alias("way"), F.col("c_name").alias("name"))
    return out.unionByName(back)


@query("j14_scalar_subqueries", """select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as n_orders, (select max(o_orderdate) from orders where o_custkey = c_custkey) as last_order,
coalesce((select round(sum(o_totalprice), 2) from orders where o_custkey = c_custkey), 0) as total from customer""")
def j14(spark, d):
    o = T(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_order"), F.round(F.sum("o_totalprice"), 2).alias("t"))
    return T(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "last_order", F.coalesce("t", F.lit(0.0)).alias("total"))


@query("j16_dictionary_join", """with d as (select r_regionkey, r_name from region) select n_nationkey, n_name, r_name, count(c_custkey) as customers from nation join d on n_regionkey = r_regionkey
left join customer on c_nationkey = n_nationkey group by all""")
def j16(spark, d):
    n = T(spark, d, "nation").join(F.broadcast(T(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = T(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("c_custkey").alias("c"))
    return n.join(c, "n_nationkey", "left").select("n_nationkey", "n_name", "r_name", F.coalesce("c", F.lit(0)).alias("customers"))


@query("j17_bookmarks", """with b as (select distinct user_id, event_id % 500 as doc_id from events where event_type = 'click')
select user_id, doc_id, source, md5(text) as body_hash from b join documents using (doc_id)""")
def j17(spark, d):
    b = T(spark, d, "events").where("event_type = 'click'").select("user_id", (F.col("event_id") % 500).alias("doc_id")).distinct()
    return b.join(T(spark, d, "documents"), "doc_id").select("user_id", "doc_id", "source", F.md5("text").alias("body_hash"))


# -- aggregates -----------------------------------------------------------------------------------------

@query("a1_count_by_key", "select source, lang, count(*) as n from documents group by source, lang order by n desc, source, lang")
def a1(spark, d):
    return T(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source", "lang")


@query("a2_filtered_counts", "select count(*) as total, count(*) filter (where vec_id % 9 = 0) as stale, 100.0 * count(*) filter (where vec_id % 9 = 0) / count(*) as stale_pct from embeddings")
def a2(spark, d):
    stale = F.count_if(F.col("vec_id") % 9 == 0)
    return T(spark, d, "embeddings").agg(F.count("*").alias("total"), stale.alias("stale"), (F.lit(100.0) * stale / F.count("*")).alias("stale_pct"))


@query("a3_source_stats", "select source, count(*) as passages, count(distinct md5(text)) as texts, count(distinct lang) as langs, round(avg(length(text))) as avg_chars from documents group by source")
def a3(spark, d):
    return T(spark, d, "documents").groupBy("source").agg(
        F.count("*").alias("passages"), F.countDistinct(F.md5("text")).alias("texts"), F.countDistinct("lang").alias("langs"), F.round(F.avg(F.length("text"))).alias("avg_chars"))


@query("a4_top_queries", """select event_type || '-' || (user_id % 40) as query, count(*) as n, round(avg(value), 3) as avg_latency from events where ts > timestamp '2024-01-30 00:00:00' - interval 7 days
group by 1 order by n desc, query limit 8""")
def a4(spark, d):
    e = T(spark, d, "events").where(F.col("ts") > F.lit("2024-01-30 00:00:00").cast("timestamp_ntz") - F.expr("interval 7 days"))
    e = e.groupBy(F.concat_ws("-", "event_type", (F.col("user_id") % 40).cast("string")).alias("query"))
    return e.agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("avg_latency")).orderBy(F.desc("n"), "query").limit(8)


@query("a5_max_score", "select p_brand, max(p_size * least(length(p_name), 30) - length(p_type) / 1000.0) as score from part group by p_brand order by score desc, p_brand limit 5")
def a5(spark, d):
    score = F.max(F.col("p_size") * F.least(F.length("p_name"), F.lit(30)) - F.length("p_type") / 1000.0)
    return T(spark, d, "part").groupBy("p_brand").agg(score.alias("score")).orderBy(F.desc("score"), "p_brand").limit(5)


@query("a6_array_agg_distinct", "select l_orderkey, list_sort(list(distinct l_suppkey)) as suppliers from lineitem group by l_orderkey")
def a6(spark, d):
    return T(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("suppliers"))


@query("a7_min_count_keys", "select min(c_acctbal) as least, count(*) as n from customer where c_custkey in (3, 5, 8, 13, 21, 34, 55, 89)")
def a7(spark, d):
    return T(spark, d, "customer").where(F.col("c_custkey").isin(3, 5, 8, 13, 21, 34, 55, 89)).agg(F.min("c_acctbal").alias("least"), F.count("*").alias("n"))


@query("a8_bool_and", "select o_custkey, coalesce(bool_and(o_orderstatus = 'F'), false) as all_done, coalesce(bool_or(o_totalprice > 400000), false) as any_large from orders group by o_custkey")
def a8(spark, d):
    return T(spark, d, "orders").groupBy("o_custkey").agg(F.coalesce(F.bool_and(F.col("o_orderstatus") == "F"), F.lit(False)).alias("all_done"), F.coalesce(F.bool_or(F.col("o_totalprice") > 400000), F.lit(False)).alias("any_large"))


@query("a9_global_having", "select count(*) as n from customer where c_custkey in (7, 11) having count(*) = 2")
def a9(spark, d):
    return T(spark, d, "customer").where(F.col("c_custkey").isin(7, 11)).agg(F.count("*").alias("n")).where("n = 2")


@query("a11_nearest_rank", "select event_type, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.5) as p50 from events group by event_type")
def a11(spark, d):
    return T(spark, d, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.expr("percentile_disc(0.5) within group (order by value)").alias("p50"))


@query("a14_latency_stats", """select event_type, avg(value) as mean, median(value) as med, max(value) as most, list_sort(list(value))[(0.99 * (count(*) - 1))::bigint - ((0.99 * (count(*) - 1))::bigint > 0.99 * (count(*) - 1))::int + 1] as p99,
count(*) filter (where value < 1) as errors from events group by event_type""")
def a14(spark, d):
    at = (F.floor(F.lit(0.99) * (F.count("*") - 1)) + 1).cast("int")
    return T(spark, d, "events").groupBy("event_type").agg(
        F.avg("value").alias("mean"), F.median("value").alias("med"), F.max("value").alias("most"),
        F.element_at(F.array_sort(F.collect_list("value")), at).alias("p99"), F.count_if(F.col("value") < 1).alias("errors"))


@query("a17_majority", """with t as (select doc_id // 8 as query, source || lang as name from documents), c as (select query, name, count(*) as n, sum(count(*)) over (partition by query) as total from t group by query, name)
select query, arg_max(name, n * 1000 - length(name)) as name, max(n) as n from (select * from (select query, lang as name, count(*) as n, sum(count(*)) over (partition by query) as total from (select doc_id // 8 as query, lang from documents) group by query, lang) where n >= greatest(3, total // 2 + 1)) group by query""")
def a17(spark, d):
    n = T(spark, d, "documents").groupBy(F.expr("doc_id div 8").alias("query"), F.col("lang").alias("name")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("query"))
    return n.withColumn("total", total).where("n >= greatest(3, total div 2 + 1)").select("query", "name", "n")


@query("a18_detection_matrix", """with m as (select event_type as fault, (event_id % 5) * 10 as pct, user_id % 3 as seed, case when value > 50 then 'LOW_RECALL' when value > 20 then 'DRIFT' else '' end as issue from events)
select fault, pct, count(*) as runs, count(*) filter (where issue <> '') / count(*)::double as rate, list_sort(list(distinct issue)) as signatures, count(*) filter (where issue = '') as missed from m group by fault, pct""")
def a18(spark, d):
    v = F.col("value")
    m = T(spark, d, "events").select(F.col("event_type").alias("fault"), (F.col("event_id") % 5 * 10).alias("pct"), F.when(v > 50, "LOW_RECALL").when(v > 20, "DRIFT").otherwise("").alias("issue"))
    return m.groupBy("fault", "pct").agg(F.count("*").alias("runs"), (F.count_if(F.col("issue") != "") / F.count("*")).alias("rate"), F.array_sort(F.collect_set("issue")).alias("signatures"), F.count_if(F.col("issue") == "").alias("missed"))


@query("a19_issue_histogram", """with s as (select event_id, ts, value, list_filter([case when value > 80 then 'LOW_RECALL' end, case when event_type = 'signup' then 'VERSION_SKEW' end, case when user_id % 4 = 0 then 'TABLE_BLOAT' end], lambda x: x is not null) as issues from events)
select issue, count(*) as n, min(value) as least from (select unnest(issues) as issue, value from s) group by issue""")
def a19(spark, d):
    issues = F.array_compact(F.array(F.when(F.col("value") > 80, "LOW_RECALL"), F.when(F.col("event_type") == "signup", "VERSION_SKEW"), F.when(F.col("user_id") % 4 == 0, "TABLE_BLOAT")))
    return T(spark, d, "events").select(F.explode(issues).alias("issue"), "value").groupBy("issue").agg(F.count("*").alias("n"), F.min("value").alias("least"))


@query("a24_storage_report", "select lang, count(*) as n, sum(strlen(text)) as bytes, avg(strlen(text)) as avg_bytes, max(strlen(text)) as max_bytes from documents group by lang")
def a24(spark, d):
    b = F.octet_length("text").cast("bigint")
    return T(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(b).alias("bytes"), F.avg(b).alias("avg_bytes"), F.max(b).alias("max_bytes"))


@query("a25_passages_by_source", "select source, count(*) as passages, count(distinct lang) as entities from documents group by source")
def a25(spark, d):
    return T(spark, d, "documents").groupBy("source").agg(F.count("*").alias("passages"), F.countDistinct("lang").alias("entities"))


@query("a26_dedup_ratio", "select count(*) as passages, count(distinct md5(text)) as texts, round(count(*) / count(distinct md5(text))::double, 6) as ratio from documents")
def a26(spark, d):
    n = F.countDistinct(F.md5("text"))
    return T(spark, d, "documents").agg(F.count("*").alias("passages"), n.alias("texts"), F.round(F.count("*") / n, 6).alias("ratio"))


# -- windows, orders, sets ------------------------------------------------------------------------------

@query("n3_first_per_group", "select o_custkey, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders) where rn = 1")
def n3(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return T(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("o_custkey", "o_orderkey", "o_orderdate")


@query("n4_first_baseline", "select event_type, arg_min(value, event_id) as baseline, arg_max(value, event_id) as latest, round(100 * (arg_max(value, event_id) - arg_min(value, event_id)) / arg_min(value, event_id), 6) as shift_pct from events where value is not null group by event_type")
def n4(spark, d):
    e = T(spark, d, "events").where("value is not null").groupBy("event_type").agg(F.min_by("value", "event_id").alias("baseline"), F.max_by("value", "event_id").alias("latest"))
    return e.withColumn("shift_pct", F.round(100 * (F.col("latest") - F.col("baseline")) / F.col("baseline"), 6))


@query("n5_latest_per_key", "select conv_id, max(turn) as turn, arg_max(role, turn) as role, md5(arg_max(text, turn)) as body_hash from conversations group by conv_id")
def n5(spark, d):
    return T(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"), F.md5(F.max_by("text", "turn")).alias("body_hash"))


@query("n6_capped_per_group", """select event_id, event_type, place from (select event_id, event_type, row_number() over (partition by event_type order by md5(event_id::varchar || 'cap'), event_id) as place from events) where place <= 2""")
def n6(spark, d):
    return sampling.capped(T(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 2, "cap")


@query("k3_multi_key_order", "select doc_id, starts_with(text, 'The') as opens, length(text) as size from documents order by opens desc, size, doc_id limit 40")
def k3(spark, d):
    t = T(spark, d, "documents").select("doc_id", F.startswith("text", F.lit("The")).alias("opens"), F.length("text").alias("size"))
    return t.orderBy(F.desc("opens"), "size", "doc_id").limit(40)


@query("k6_keyset_page", "select o_orderkey, o_totalprice from orders where o_orderkey > 1000 order by o_orderkey limit 250")
def k6(spark, d):
    return sampling.after(T(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000, 250)


@query("k7_offset_page", "select c_custkey, c_name from customer order by c_custkey limit 25 offset 50")
def k7(spark, d):
    return sampling.page(T(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 3, 25)


@query("k8_most_recent", "select event_id, ts, event_type from events order by ts desc, event_id desc limit 20")
def k8(spark, d):
    return T(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "ts", "event_type")


@query("u1_union_distinct", """select o_custkey as id from orders where o_totalprice > 450000 union select c_custkey from customer where c_acctbal > 9900 union select c_custkey from customer where c_mktsegment = 'BUILDING' and c_nationkey = 3""")
def u1(spark, d):
    c = T(spark, d, "customer")
    a = T(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("id"))
    return a.union(c.where("c_acctbal > 9900").select("c_custkey")).union(c.where("c_mktsegment = 'BUILDING' and c_nationkey = 3").select("c_custkey")).distinct()


@query("u2_union_all", "select 'customer' as kind, c_nationkey as nation, count(*) as n from customer group by c_nationkey union all select 'supplier', s_nationkey, count(*) from supplier group by s_nationkey")
def u2(spark, d):
    c = T(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("customer"))
    s = T(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("supplier"))
    return c.unionByName(s)


@query("u3_intersect_except", """select 'both' as part, x as id from (select distinct l_partkey as x from lineitem where l_returnflag = 'R' intersect select distinct l_partkey from lineitem where l_returnflag = 'A')
union all select 'only', x from (select distinct l_partkey as x from lineitem where l_returnflag = 'R' except select distinct l_partkey from lineitem where l_returnflag = 'A')""")
def u3(spark, d):
    of = lambda f: T(spark, d, "lineitem").where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("id"))
    return of("R").intersect(of("A")).withColumn("part", F.lit("both")).unionByName(of("R").subtract(of("A")).withColumn("part", F.lit("only")))


@query("u4_sorted_array_union", "select p_partkey, list_sort(list_distinct(string_split(lower(p_name), ' ') || string_split(lower(p_type), ' '))) as words from part")
def u4(spark, d):
    return T(spark, d, "part").select("p_partkey", F.array_sort(F.array_union(F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " "))).alias("words"))


@query("u5_distinct", "select distinct c_mktsegment, c_nationkey % 5 as zone from customer")
def u5(spark, d):
    return T(spark, d, "customer").select("c_mktsegment", (F.col("c_nationkey") % 5).alias("zone")).distinct()
