"""Queries over texts: literal tokens, keys, the keyword index, lanes, fusion and retrieval measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions import text as X
from corvane.functions import trigram
from corvane.operators import retrieval as R
from corvane.plans.common import table as T

_MANUAL = """manual as (select p_partkey as id, 'use -' || substr(p_type, 1, 2) || ' or --' || lower(replace(p_brand, '#', '-')) || ' for ' || p_name || case when p_partkey % 3 = 0 then ', see cve-2021-' || lpad(p_partkey::varchar, 5, '0') || ' and CWE-' || p_size else '' end
|| case when p_partkey % 5 = 0 then chr(10) || '  --' || lower(replace(p_brand, '#', '-')) || ' selects' else '' end as text, p_size % 3 as trust from part)"""


def manual(spark, d):
    """Manual-like texts with flags and identifiers, made from the parts."""
    p = T(spark, d, "part")
    flag = F.concat(F.lit("--"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))))
    see = F.concat(F.lit(", see cve-2021-"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit(" and CWE-"), F.col("p_size").cast("string"))
    text = F.concat(F.lit("use -"), F.substring("p_type", 1, 2), F.lit(" or "), flag, F.lit(" for "), "p_name", F.when(F.col("p_partkey") % 3 == 0, see).otherwise(""),
                    F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("\n  "), flag, F.lit(" selects"))).otherwise(""))
    return p.select(F.col("p_partkey").alias("id"), text.alias("text"), (F.col("p_size") % 3).alias("trust"))


_FLAGS = r"""list_sort(list_distinct(list_filter(regexp_extract_all(text, '(^|[^\w-])(--?[A-Za-z0-9][\w-]*)', 2)
|| list_transform(regexp_extract_all(text, '(?i)\b(T\d{4}(?:\.\d{3})?|CVE-\d{4}-\d{4,}|CWE-\d+|CAPEC-\d+)\b', 1), lambda x: upper(x)), lambda x: length(x) >= 2)))"""


@query("h1_extract_flags", f"with {_MANUAL} select id, {_FLAGS} as flags from manual")
def h1(spark, d):
    return manual(spark, d).select("id", X.extract_flags(F.col("text")).alias("flags"))


@query("h5_flag_lane", f"""with {_MANUAL}, b as (select id, text, trust, {_FLAGS} as flags from manual), q(query_id, f) as (values (1, ['--brand-11']), (2, ['-PR']), (3, ['CWE-7'])),
m as (select query_id, b.*, len(list_filter(f, lambda x: regexp_matches(text, '(^|\\n)\\s*' || x || '([^\\w-]|$)'))) > 0 as defines from b join q on list_has_any(flags, f)),
r as (select *, row_number() over (partition by query_id order by defines desc, len(flags), trust, id) as rank from m) select query_id, 'flag' as lane, id, rank from r where rank <= 40""")
def h5(spark, d):
    b = manual(spark, d).withColumn("flags", X.extract_flags(F.col("text")))
    q = spark.createDataFrame([(1, "what is --brand-11"), (2, "-PR"), (3, "explain cwe-7")], "query_id int, text string")
    return R.flag_lane(b, q)


@query("t4_clean", r"""select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\(Citation: [^)]*\)', '', 'g'), '\[([^\]]+)\]\((?:https?://|/)[^)]*\)', '\1', 'g'), '</?code>', '`', 'g'), '[ \t]+\n', chr(10), 'g'), '^\s+|\s+$', '', 'g') as cleaned from pages""")
def t4(spark, d):
    return T(spark, d, "pages").select("page_id", X.clean(F.col("html")).alias("cleaned"))


@query("t5_long_enough", r"select doc_id from documents where length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 200")
def t5(spark, d):
    return T(spark, d, "documents").where(X.long_enough(F.col("text"), 200)).select("doc_id")


@query("t6_content_keys", "select doc_id, md5(text) as body_key, sha256(doc_id || '|' || source || '|' || text) as content_key from documents")
def t6(spark, d):
    return T(spark, d, "documents").select("doc_id", X.body_key(F.col("text")).alias("body_key"), X.content_key(F.col("doc_id"), F.col("source"), F.col("text")).alias("content_key"))


@query("t7_text_functions", r"""select p_partkey, upper(p_name) as up, left(p_type, 5) as head, length(p_name) as size, strpos(p_type, 'A')::int as at_a, regexp_replace(p_type, '[AEIOU]', '*', 'g') as masked, p_name || '/' || p_brand as joined, p_type like '%BRASS' as brass from part""")
def t7(spark, d):
    return T(spark, d, "part").select(
        "p_partkey", F.upper("p_name").alias("up"), F.left("p_type", F.lit(5)).alias("head"), F.length("p_name").cast("bigint").alias("size"), F.instr("p_type", "A").alias("at_a"),
        F.regexp_replace("p_type", "[AEIOU]", "*").alias("masked"), F.concat("p_name", F.lit("/"), "p_brand").alias("joined"), F.col("p_type").like("%BRASS").alias("brass"))


@query("t8_array_functions", "select user_id, list_sort(list_distinct(list(event_type) || ['x'])) as kinds, len(list(event_type)) as n, list_append(list_sort(list_distinct(list(event_id % 7))), -1) as rest from events group by user_id")
def t8(spark, d):
    return T(spark, d, "events").groupBy("user_id").agg(
        F.array_sort(F.array_distinct(F.concat(F.collect_list("event_type"), F.array(F.lit("x"))))).alias("kinds"), F.size(F.collect_list("event_type")).cast("bigint").alias("n"),
        F.array_append(F.array_sort(F.collect_set(F.col("event_id") % 7)), F.lit(-1).cast("bigint")).alias("rest"))


@query("t9_json_functions", """select event_id, (props ->> '$.k')::bigint as k, json_extract_string(to_json({'type': event_type, 'k': (props ->> '$.k')::bigint}), '$.type') as type, (props ->> '$.none') is null as missing from events""")
def t9(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    made = F.to_json(F.struct(F.col("event_type").alias("type"), k.alias("k")))
    return T(spark, d, "events").select("event_id", k.alias("k"), F.get_json_object(made, "$.type").alias("type"), F.get_json_object("props", "$.none").isNull().alias("missing"))


@query("t10_dates", """select event_id, ts::date as day, ts + interval 36 hours as later, date_trunc('hour', ts) as hour, date_diff('day', date '2024-01-01', ts::date) as age from events""")
def t10(spark, d):
    e = T(spark, d, "events")
    return e.select("event_id", F.to_date("ts").alias("day"), (F.col("ts") + F.expr("interval 36 hours")).alias("later"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("age"))


@query("t11_math", "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net, l_orderkey % 13 as rest, least(l_quantity, 20.0) as capped, ceil(l_quantity / 7)::bigint as packs, round_even(l_quantity / 2, 0) as half from lineitem")
def t11(spark, d):
    q = F.col("l_quantity")
    return T(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"), (F.col("l_orderkey") % 13).alias("rest"),
        F.least(q, F.lit(20.0)).alias("capped"), F.ceil(q / 7).cast("bigint").alias("packs"), F.rint(q / 2).alias("half"))


@query("t13_split_by_hash", "select p_partkey, case when ('0x' || right(md5(p_name || p_partkey), 1))::int % 2 = 0 then 'dev' else 'test' end as part from part")
def t13(spark, d):
    digit = F.conv(F.right(F.md5(F.concat("p_name", F.col("p_partkey").cast("string"))), F.lit(1)), 16, 10).cast("int")
    return T(spark, d, "part").select("p_partkey", F.when(digit % 2 == 0, "dev").otherwise("test").alias("part"))


@query("t15_normal_list", "select p_partkey, list_sort(list_distinct(list_filter(list_transform(string_split(p_type || ', ' || p_name || ',,', ','), lambda x: lower(trim(x))), lambda x: x <> ''))) as items from part")
def t15(spark, d):
    return T(spark, d, "part").select("p_partkey", X.normal_list(F.concat("p_type", F.lit(", "), "p_name", F.lit(",,"))).alias("items"))


@query("t16_short_title", r"select doc_id, left(array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:8], ' '), 90) as title from documents")
def t16(spark, d):
    return T(spark, d, "documents").select("doc_id", X.short_title(F.col("text")).alias("title"))


@query("t1_split_blocks")
def t1(spark, d):
    split = X.udf_of(X.split_blocks, "array<string>")
    return T(spark, d, "documents").select("doc_id", F.posexplode(split("text")).alias("block", "body"))


@query("t2_man_sections")
def t2(spark, d):
    page = F.concat(F.lit("TOOL(1)\nNAME\n       "), "p_name", F.lit("\nSYNOPSIS\n       "), "p_type", F.lit("\nSEE ALSO\n       "), "p_brand")
    return T(spark, d, "part").select("p_partkey", F.explode(X.udf_of(X.man_sections, X.SECTIONS)(page)).alias("s")).select("p_partkey", "s.*")


@query("t3_rst_sections")
def t3(spark, d):
    page = F.concat(F.lit("Intro\n=====\n"), "p_name", F.lit("\n\nUse\n---\n"), "p_type")
    return T(spark, d, "part").select("p_partkey", F.explode(X.udf_of(X.rst_sections, X.SECTIONS)(page)).alias("s")).select("p_partkey", "s.*")


@query("h24_display_blocks")
def h24(spark, d):
    kind = "array<struct<type: string, text: string, key: string>>"
    return T(spark, d, "documents").select("doc_id", F.posexplode(X.udf_of(X.display_blocks, kind)("text")).alias("place", "b")).select("doc_id", "place", "b.*")


# -- keyword index and lanes ----------------------------------------------------------------------------

_INDEX = r"w as (select doc_id as id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as word from documents), tf as (select word, id, count(*) as n from w group by word, id)"
_ASK = r"q as (select item_id as query_id, array_to_string(regexp_extract_all(text, '[\p{L}\p{N}_]+')[3:4], ' ') as text from benchmark), qt as (select query_id, word, count(*) over (partition by query_id) as n_terms from (select distinct query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as word from q))"


def asked(spark, d):
    """Two-word queries from the benchmark passages."""
    ws = F.regexp_extract_all("text", F.lit(X.INDEX_WORD), 0)
    return T(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(ws, 3, 2), " ").alias("text"))


def docs(spark, d):
    return T(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")


@query("a10_term_df", f"with {_INDEX} select word, count(*) as ndoc from tf group by word")
def a10(spark, d):
    return R.term_df(docs(spark, d))


@query("h6_keyword_lane", f"""with {_INDEX}, {_ASK}, m as (select query_id, id, round(sum(n / (n + 1.0)), 6) as score from qt join tf using (word) group by query_id, id, n_terms having count(*) = n_terms),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from m) select query_id, 'fts' as lane, id, rank from r where rank <= 40""")
def h6(spark, d):
    q = asked(spark, d)
    return R.keyword_lane(R.postings(docs(spark, d), only=R.query_terms(q)), q, by_cover=False)


@query("h16_cover_density")
def h16(spark, d):
    q = asked(spark, d)
    return R.keyword_lane(R.postings(docs(spark, d), only=R.query_terms(q)), q)


@query("h7_skip_rule", f"""with {_INDEX}, {_ASK}, df as (select word, count(*) as ndoc from tf group by word), k as (select query_id, min(ndoc) as least, count(ndoc) as known, count(*) as terms from qt left join df using (word) group by query_id)
select q.query_id, coalesce(known = terms and least > 0.01 * (select count(*) from documents), false) as skip from q left join k using (query_id)""")
def h7(spark, d):
    b = docs(spark, d)
    return R.skipped(asked(spark, d), R.term_df(b), b.count())


@query("h8_any_word_lane", f"""with {_INDEX}, {_ASK},
t as (select query_id, word from qt where length(word) >= 4 and word not in ('that', 'this', 'with', 'from')),
m as (select query_id, id, round(sum(n / (n + 1.0)), 6) as score from t join tf using (word) group by query_id, id),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from m) select query_id, 'fts_any' as lane, id, rank from r where rank <= 40""")
def h8(spark, d):
    q = asked(spark, d)
    return R.any_word_lane(R.postings(docs(spark, d), only=R.query_terms(q)), q, stop=frozenset(("that", "this", "with", "from")))  # those of the SQL


_ENTITIES = "e as (select p_partkey as entity_id, p_name as name, [lower(split_part(p_type, ' ', 3)), lower(p_brand)] as aliases, case when p_partkey % 2 = 0 then 'tool' else 'concept' end as type, case when p_partkey % 4 = 0 then 'T' || (1000 + p_partkey) else '' end as ext_id from part)"


def entities(spark, d):
    p, key = T(spark, d, "part"), F.col("p_partkey")
    return p.select(
        key.alias("entity_id"), F.col("p_name").alias("name"), F.array(F.lower(F.split_part("p_type", F.lit(" "), F.lit(3))), F.lower("p_brand")).alias("aliases"),
        F.when(key % 2 == 0, "tool").otherwise("concept").alias("type"), F.when(key % 4 == 0, F.concat(F.lit("T"), (key + 1000).cast("string"))).otherwise("").alias("ext_id"))


_ENTITY_QUERIES = [(1, "tell me about brass things now"), (2, "steel"), (3, "what is T1004"), (4, "nothing here at all")]


@query("h2_entity_resolution", f"""with {_ENTITIES}, q(query_id, text) as (values (1, 'tell me about brass things now'), (2, 'steel'), (3, 'what is T1004'), (4, 'nothing here at all')),
t as (select query_id, len(list_distinct(ws)) as n, unnest(list_distinct(ws)) as token from (select query_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9][\\w.+-]*'), lambda x: lower(x)) as ws from q))
select query_id, entity_id from t join e on lower(name) = token where type = 'tool' or n <= 3 union select query_id, entity_id from t join e on list_contains(aliases, token) where type = 'tool' or n <= 3
union select query_id, entity_id from t join e on ext_id <> '' and lower(ext_id) = token""")
def h2(spark, d):
    return R.resolve_entities(entities(spark, d), spark.createDataFrame(_ENTITY_QUERIES, "query_id int, text string"))


@query("h4_entity_scope", f"""with {_ENTITIES}, s as (select distinct entity_id from e where list_contains(aliases, 'steel') and type = 'tool') select doc_id as id from documents where doc_id in (select entity_id from s)""")
def h4(spark, d):
    q = spark.createDataFrame([(1, "steel of any kind please")], "query_id int, text string")
    scope = R.resolve_entities(entities(spark, d), q).select(F.col("entity_id").alias("id")).distinct()
    return docs(spark, d).select("id").join(F.broadcast(scope), "id", "left_semi")


_GRAMS = r"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("h15_similarity", f"""with p as (select p_partkey, p_name, {_GRAMS.format("p_name")} as a, {_GRAMS.format("p_type")} as b from part)
select p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(a || b))::double, 6) as similarity from p""")
def h15(spark, d):
    return T(spark, d, "part").select("p_partkey", F.round(trigram.similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query("h9_word_similarity")
def h9(spark, d):
    return T(spark, d, "part").select("p_partkey", trigram.word_similarity(F.col("p_brand"), F.concat("p_name", F.lit(" "), "p_type")).alias("similarity"))


@query("h3_typo_rescue", f"""with n as (select s_suppkey as entity_id, {_GRAMS.format("s_name")} as b from supplier), q as (select c_custkey as query_id, {_GRAMS.format("replace(c_name, 'Customer', 'Suplier')")} as a from customer where c_custkey < 40),
m as (select query_id, entity_id, round(len(list_intersect(a, b)) / len(list_distinct(a || b))::double, 6) as similarity from q, n), r as (select *, row_number() over (partition by query_id order by similarity desc, entity_id) as r from m where similarity >= 0.45)
select query_id, entity_id, similarity from r where r = 1""")
def h3(spark, d):
    q = T(spark, d, "customer").where("c_custkey < 40").select(F.col("c_custkey").alias("query_id"), F.replace("c_name", F.lit("Customer"), F.lit("Suplier")).alias("text"))
    return R.typo_rescue(T(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name")), q)


@query("h10_name_lane")
def h10(spark, d):
    e = entities(spark, d).withColumn("name", F.concat("name", F.lit(" number "), F.col("entity_id").cast("string")))
    q = e.where("entity_id % 100 = 7").select(F.col("entity_id").alias("query_id"), F.concat(F.lit("please describe "), "name").alias("text"))
    return R.name_lane(e, e.select("entity_id", F.col("entity_id").alias("id")), q)


_LANES = """lanes as (select query_id, lane, id, rank from (select s.lane, source as query_id, doc_id as id, row_number() over (partition by s.lane, source order by md5(doc_id || s.lane), doc_id) as rank from documents,
(values ('vec'), ('fts'), ('flag')) s(lane)) where rank <= 30)"""


def lanes(spark, d):
    """Three rankings of the documents of each source."""
    b = T(spark, d, "documents").select("doc_id", F.col("source").alias("query_id"))
    b = b.withColumn("lane", F.explode(F.array(*map(F.lit, ("vec", "fts", "flag")))))
    w = Window.partitionBy("lane", "query_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), "lane")), "doc_id")
    return b.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 30").select("query_id", "lane", F.col("doc_id").alias("id"), "rank")


_FUSED = """fused as (select query_id, id, round(sum(case lane when 'flag' then 3.0::double when 'vec' then 2.0 else 1.0 end / (60 + rank)), 9) as score, list_sort(list(distinct lane)) as lanes from lanes group by query_id, id),
placed as (select *, row_number() over (partition by query_id order by score desc, id) as place from fused)"""


@query("h14_fusion", f"with {_LANES}, {_FUSED} select query_id, place, id, score, lanes from placed where place <= 30")
def h14(spark, d):
    return R.fuse(lanes(spark, d))


@query("n2_lane_ranks", f"with {_LANES} select query_id, lane, id, rank from lanes")
def n2(spark, d):
    return lanes(spark, d)


@query("h21_result_rows", f"with {_LANES}, {_FUSED} select query_id, place, id, lang, md5(text) as body_hash, lanes from placed join documents on doc_id = id where place <= 5")
def h21(spark, d):
    return R.fuse(lanes(spark, d)).where("place <= 5").join(docs(spark, d), "id").select("query_id", "place", "id", "lang", F.md5("text").alias("body_hash"), "lanes")


@query("h22_hidden_sources", f"with {_LANES}, {_FUSED} select query_id, place, id from placed where place <= 30 and query_id not in ('src1', 'src2')")
def h22(spark, d):
    return R.fuse(lanes(spark, d)).where(~F.col("query_id").isin("src1", "src2")).select("query_id", "place", "id")


@query("h20_source_slot", f"""with {_LANES}, {_FUSED}, p as (select query_id, place as p, id, score, lang = 'es' as fav, max(score) over (partition by query_id) as top from placed join documents on doc_id = id where place <= 30),
f as (select *, min(case when fav then p end) over (partition by query_id) as first from p), k as (select *, case when p = first and p > 3 and score >= 0.5 * top then 2.5 else p end as key from f)
select query_id, id, score, row_number() over (partition by query_id order by key) as place from k""")
def h20(spark, d):
    rows = R.fuse(lanes(spark, d)).join(docs(spark, d).select("id", "lang"), "id").select("query_id", "id", "score", "lang")
    return R.source_slot(rows, F.col("lang") == "es").drop("lang")


@query("h19_rerank", f"""with {_LANES}, {_FUSED}, o as (select query_id, id, place, row_number() over (partition by query_id, place <= 20 order by length(text) desc, place) as o from placed join documents on doc_id = id where place <= 30),
m as (select *, case when place <= 20 then -(2.0::double / (60 + o) + 1.0::double / (60 + place)) else place end as mix from o) select query_id, id, row_number() over (partition by query_id order by mix, m.place) as place from m""")
def h19(spark, d):
    rows = R.fuse(lanes(spark, d)).join(docs(spark, d).select("id", F.length("text").cast("double").alias("other_score")), "id").select("query_id", "id", "place", "other_score")
    return R.rerank(rows).select("query_id", "id", "place")


@query("h17_representative", r"""with w as (select source as query_id, doc_id as id, lower(text) as low, string_split(text, chr(10)) as ls from documents), l as (select query_id, id, low, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as ref_id from w),
r as (select query_id, id, ref_id, split_part(line, ' ', 1) as name, ref_id % 10 = 0 as named, low from l where regexp_matches(split_part(line, ' ', 1), '^[A-Za-z]+$')),
u as (select *, len(list_filter(regexp_extract_all(low, '[A-Za-z0-9_-]+'), lambda x: x = lower(name))) as uses from r), o as (select *, row_number() over (partition by query_id, id order by named desc, uses desc, length(name), ref_id) as x from u)
select query_id, id, ref_id, name, named, uses from o where x = 1""")
def h17(spark, d):
    """Of the first words of a text's lines, the one that names it best; uses are counted in the whole text, of all documents."""
    lines = F.posexplode(F.split("text", "\n", -1)).alias("at", "line")
    rows = T(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), "text", lines)
    ref = (F.col("at") + 1).cast("bigint")
    rows = rows.select("query_id", "id", ref.alias("ref_id"), F.split_part("line", F.lit(" "), F.lit(1)).alias("name"), (ref % 10 == 0).alias("named"), "text")
    counted = rows.where(F.col("name").rlike("^[A-Za-z]+$")).withColumn("uses", R.uses().cast("bigint")).drop("text")
    return R.representative(counted).select("query_id", "id", "ref_id", "name", "named", "uses")


@query("h18_boosts", r"""with s as (select event_id, event_type, value, case event_id % 6 when 0 then 'overview' when 1 then 'nmap(1): description' when 2 then 'detection' when 3 then 'tool: see also' when 4 then 'examples' else 'options' end as section,
case event_id % 4 when 0 then 'nmap' when 1 then 'how to detect it' when 2 then 'CVE-2021-44228' else 'option -x' end as query, case when event_id % 3 = 0 then '-x does it' when event_id % 3 = 1 then 'see' || chr(10) || '  -x does it' else 'none -x' end as text from events)
select event_id, round(round(value / 1000, 9) + case when query = 'nmap' and section = 'overview' then 0.3 when query = 'nmap' and section like '%: description' then 0.1 else 0 end
+ case when query = 'option -x' and event_id % 3 < 2 then 0.1 else 0 end + case when query = 'option -x' and event_id % 3 = 0 then 0.1 else 0 end + case when query like 'CVE%' and section = 'overview' then 0.15 else 0 end
+ case when query = 'how to detect it' and section = 'detection' then 0.15 else 0 end - case when section like '%see also' then 1.0 else 0 end, 9) as score from s""")
def h18(spark, d):
    i = F.col("event_id")
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (i % n + 1).cast("int"))
    rows = T(spark, d, "events").select(
        "event_id", F.round(F.col("value") / 1000, 9).alias("score"), pick(6, "overview", "nmap(1): description", "detection", "tool: see also", "examples", "options").alias("section"),
        pick(4, "nmap", "how to detect it", "CVE-2021-44228", "option -x").alias("query"), pick(3, "-x does it", "see\n  -x does it", "none -x").alias("text"))
    return R.boosts(rows.withColumn("name_query", F.col("query") == "nmap")).select("event_id", "score")


@query("a15_hits_mrr", f"""with {_LANES}, {_FUSED}, rel as (select source as query_id, doc_id as id from documents where doc_id % 13 = 0), f as (select query_id, min(place) as first from placed join rel using (query_id, id) where place <= 30 group by query_id),
e as (select distinct query_id from rel) select count(*) as queries, round(avg((coalesce(first, 99) <= 1)::int), 6) as hit1, round(avg((coalesce(first, 99) <= 5)::int), 6) as hit5, round(avg((coalesce(first, 99) <= 10)::int), 6) as hit10,
round(avg(case when first <= 10 then 1.0::double / first else 0 end), 6) as mrr from e left join f using (query_id)""")
def a15(spark, d):
    rel = T(spark, d, "documents").where("doc_id % 13 = 0").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"))
    return R.hits_and_mrr(R.fuse(lanes(spark, d)), rel)


@query("a16_collapse", f"""with {_LANES}, {_FUSED}, f as (select query_id, lang as name, min(place) as first from placed join documents on doc_id = id where place <= 30 group by query_id, lang)
select query_id, name, row_number() over (partition by query_id order by first, name) as place from f""")
def a16(spark, d):
    return R.collapse(R.fuse(lanes(spark, d)), docs(spark, d).select("id", F.col("lang").alias("name")))


@query("h25_fusion_lab", f"""with {_LANES}, cfg(config, flag, vec, fts) as (values ('even', 1.0::double, 1.0::double, 1.0::double), ('tuned', 3.0, 2.0, 1.0), ('vec_only', 0.0, 1.0, 0.0)),
fused as (select config, query_id, id, round(sum(case lane when 'flag' then flag when 'vec' then vec else fts end / (60 + rank)), 9) as score from lanes, cfg group by config, query_id, id),
placed as (select * from (select *, row_number() over (partition by config, query_id order by score desc, id) as place from fused) where place <= 30), rel as (select source as query_id, doc_id as id from documents where doc_id % 13 = 0),
f as (select config, query_id, min(place) as first from placed join rel using (query_id, id) group by config, query_id), e as (select config, query_id from cfg, (select distinct query_id from rel))
select config, count(*) as queries, round(avg((coalesce(first, 99) <= 1)::int), 6) as hit1, round(avg((coalesce(first, 99) <= 5)::int), 6) as hit5, round(avg((coalesce(first, 99) <= 10)::int), 6) as hit10,
round(avg(case when first <= 10 then 1.0::double / first else 0 end), 6) as mrr from e left join f using (config, query_id) group by config""")
def h25(spark, d):
    runs = {"even": {"flag": 1.0, "vec": 1.0, "fts": 1.0}, "tuned": {"flag": 3.0, "vec": 2.0, "fts": 1.0}, "vec_only": {"flag": 0.0, "vec": 1.0, "fts": 0.0}}
    made = lanes(spark, d)
    found = None
    for name, weights in runs.items():
        one = R.fuse(made, weights).withColumn("config", F.lit(name))
        found = one if found is None else found.unionByName(one)
    rel = T(spark, d, "documents").where("doc_id % 13 = 0").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"))
    return R.hits_and_mrr(found, rel, by=("config",))


@query("h26_lexical_baseline", r"""with q as (select item_id as query_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as ws from benchmark), w as (select query_id, unnest(ws) as word from q),
p as (select p_partkey as id, unnest(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[\p{L}\p{N}_]+'))) as word from part) select query_id, id, count(*) as n from w join p using (word) group by query_id, id""")
def h26(spark, d):
    q = T(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    p = T(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(F.array_distinct(X.words(F.concat("p_name", F.lit(" "), "p_type")))).alias("word"))
    return R.query_terms(q).join(p, "word").groupBy("query_id", "id").agg(F.count("*").alias("n"))


@query("h23_topic_page", """select source as name, lang as section, count(*) as chunks, list(doc_id order by doc_id) as ids from (select *, row_number() over (partition by source order by doc_id) as place from documents) where place <= 600 group by source, lang""")
def h23(spark, d):
    """The page of each topic, of its first 600 passages."""
    rows = T(spark, d, "documents").select("doc_id", "source", "lang").withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("place <= 600")
    return rows.groupBy(F.col("source").alias("name"), F.col("lang").alias("section")).agg(F.count("*").alias("chunks"), F.array_sort(F.collect_list("doc_id")).alias("ids"))


@query("a22_canary_category", """with d as (select q.vec_id as query_id, q.label, b.label as other, row_number() over (partition by q.vec_id order by round(list_cosine_distance(q.embedding::double[], b.embedding::double[]), 6), b.vec_id) as r from embeddings q, embeddings b where q.vec_id % 40 = 0)
select query_id, count(*) filter (where label = other) as same from d where r <= 10 group by query_id""")
def a22(spark, d):
    from corvane.operators import knn

    e = T(spark, d, "embeddings")
    near = knn.exact_knn(e, e.where("vec_id % 40 = 0"), 10).join(e.select("vec_id", F.col("label").alias("other")), "vec_id")
    return near.join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id").groupBy("query_id").agg(F.count_if(F.col("label") == F.col("other")).alias("same"))
