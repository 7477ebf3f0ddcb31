"""Queries of the document catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..sources.tables import events, missing_only, table
from .catalogue import query
from .relations import DOCS, MEMBERS, TEMPLATES, docs, members, templates, with_

USER = 42


@query(with_(MEMBERS, DOCS) + ", found as (select * from docs where workspace_id in (select workspace_id from members where user_id = 42) and title ilike '%f\\_%' escape '\\') select id, title, updated_at, (select count(*) from found) as total from found order by updated_at desc, id limit 20 offset 20")
def p1_document_page(spark, d):
    return C.list_documents(docs(spark, d), members(spark, d), USER, query="f_", sort="updated", limit=20, offset=20).select("id", "title", "updated_at", "total")


@query(with_(MEMBERS, DOCS) + "select id, title from docs where workspace_id in (select workspace_id from members where user_id = 42) order by lower(title), id limit 50")
def o1_documents_by_title(spark, d):
    return C.list_documents(docs(spark, d), members(spark, d), USER, sort="title", limit=50).select("id", "title")


@query(with_(MEMBERS, DOCS) + "select id, created_at from docs where workspace_id in (select workspace_id from members where user_id = 42) order by created_at desc, id limit 30")
def o4_newest_documents(spark, d):
    return C.list_documents(docs(spark, d), members(spark, d), USER, sort="created", limit=30).select("id", "created_at")


@query(with_(MEMBERS, DOCS) + "select id, title, workspace_id from docs where id in (select max(id) from docs where created_by = 42) and workspace_id in (select workspace_id from members where user_id = 42)")
def p2_one_document(spark, d):
    own = docs(spark, d)
    wanted = own.where(F.col("created_by") == USER).agg(F.max("id")).first()[0]
    return C.get_document(own, members(spark, d), USER, wanted).select("id", "title", "workspace_id")


@query(with_(MEMBERS, DOCS) + "select count(*) as found from docs where id in (select min(id) from docs where workspace_id not in (select workspace_id from members where user_id = 42)) and workspace_id in (select workspace_id from members where user_id = 42)")
def p2_forbidden_document(spark, d):
    """A document of another workspace looks like none."""
    own = docs(spark, d)
    wanted = own.join(members(spark, d).where(F.col("user_id") == USER), "workspace_id", "left_anti").agg(F.min("id")).first()[0]
    return C.get_document(own, members(spark, d), USER, wanted).agg(F.count("*").alias("found"))


@query(with_(DOCS) + "select id, title from docs where workspace_id = 3")
def p3_workspace_documents(spark, d):
    return C.of_workspace(docs(spark, d), 3).select("id", "title")


@query(with_(MEMBERS, TEMPLATES) + "select distinct id, name, visibility from templates t join members m on t.workspace_id = m.workspace_id and m.user_id = 42 where visibility = 'workspace' or created_by = 42")
def p4_visible_templates(spark, d):
    return C.visible_templates(templates(spark, d), members(spark, d), USER).select("id", "name", "visibility")


@query("select event_id as id, event_type as kind from events where user_id = 3 and event_type = 'view' order by ts desc, event_id limit 10")
def p5_recent_jobs(spark, d):
    jobs = events(spark, d).select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("kind"), F.col("ts").alias("created_at"), F.lit("running").alias("status"))
    return C.recent_jobs(jobs, 3, kind="view", limit=10).select("id", "kind")


@query("select event_id as id, case when s in ('pending', 'running') then 'failed' else s end as status from (select event_id, case event_id % 4 when 0 then 'pending' when 1 then 'running' when 2 then 'succeeded' else 'failed' end as s from events)")
def p6_interrupted_jobs(spark, d):
    k = F.col("event_id") % 4
    return C.fail_interrupted(events(spark, d).select(F.col("event_id").alias("id"), F.when(k == 0, "pending").when(k == 1, "running").when(k == 2, "succeeded").otherwise("failed").alias("status")))


@query("select event_id as id, row_number() over (order by ts - case when event_type = 'purchase' then interval 10 minute else interval 0 minute end, event_id) as nth from events")
def e10_queue_order(spark, d):
    jobs = events(spark, d).select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), (F.col("event_type") == "purchase").alias("priority"))
    return C.queue_places(jobs).select("id", "nth")


@query("select least(max_mb, 50) as mb, p_partkey from (select p_partkey, p_size * 2 as max_mb from part)")
def p8_upload_cap(spark, d):
    from ..operators.metering import capped_upload_mb

    return table(spark, d, "part").select("p_partkey", capped_upload_mb(F.col("p_size") * 2, 50).alias("mb"))


@query(with_(DOCS, TEMPLATES) + "select d.id, case when formatted_at is not null then 'formatted' else 'draft' end as status, coalesce(source, 'paste') as source, t.name as template_name from docs d left join templates t on d.template_id = t.id")
def p9_summaries(spark, d):
    return C.summaries(docs(spark, d), templates(spark, d)).select("id", "status", "source", "template_name")


@query(with_(MEMBERS, DOCS) + "select count(*) as documents, count(distinct created_by) as authors from docs where workspace_id in (select workspace_id from members where role = 'owner')")
def j1_owned_semi_join(spark, d):
    m = members(spark, d).where("role = 'owner'")
    return docs(spark, d).join(m, "workspace_id", "left_semi").agg(F.count("*").alias("documents"), F.count_distinct("created_by").alias("authors"))


@query(with_(MEMBERS) + "select count(*) as n, max(s_suppkey) as last from supplier join members on s_nationkey = workspace_id and user_id = 42")
def j3_accessible_assets(spark, d):
    assets = table(spark, d, "supplier").withColumn("workspace_id", F.col("s_nationkey"))
    return C.owned(assets, members(spark, d), USER).agg(F.count("*").alias("n"), F.max("s_suppkey").alias("last"))


@query(with_(DOCS) + "select workspace_id, count(*) as versions, count(distinct l_orderkey) as documents from lineitem join docs on l_orderkey = id group by 1")
def j6_versions_of_documents(spark, d):
    from ..operators.history import of_documents

    return of_documents(table(spark, d, "lineitem").select("l_orderkey"), docs(spark, d), doc="l_orderkey", keep=["workspace_id"]).groupBy("workspace_id").agg(F.count("*").alias("versions"), F.count_distinct("l_orderkey").alias("documents"))


@query("select event_id, c_name from events join customer on user_id = c_custkey where ts + interval 14 day > timestamp '2024-01-20' and event_type <> 'error'")
def j7_live_sessions(spark, d):
    e = events(spark, d).select("event_id", "user_id", (F.col("ts") + F.make_dt_interval(F.lit(14))).alias("expires_at"), F.when(F.col("event_type") == "error", F.col("ts")).alias("revoked_at"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return C.live_sessions(e, users, F.lit("2024-01-20").cast("timestamp")).select("event_id", "c_name")


@query(with_(DOCS, TEMPLATES) + "select id, name as template_name from (select id, case when template_id > 0 then template_id end as template_id from docs) d left join (select id as tid, name from templates) t on template_id = tid")
def j17_template_or_error(spark, d):
    """Template 0 means none; every other one is there."""
    own = docs(spark, d).withColumn("template_id", F.when(F.col("template_id") > 0, F.col("template_id")))
    return C.template_of(own, templates(spark, d)).select("id", "template_name")


@query("with subs as (select s_suppkey as id, case when s_suppkey % 3 = 0 then s_nationkey end as workspace_id, case when s_suppkey % 3 = 1 then s_nationkey end as external_id, case when s_suppkey % 3 = 2 then s_nationkey end as customer_id from supplier) select n_nationkey as k, coalesce((select min(id) from subs where workspace_id = n_nationkey), (select min(id) from subs where external_id = n_nationkey), (select min(id) from subs where customer_id = n_nationkey)) as subscription from nation")
def j18_subscription_lookup(spark, d):
    m, n = F.col("s_suppkey") % 3, F.col("s_nationkey")
    subs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(m == 0, n).alias("workspace_id"), F.when(m == 1, n).alias("external_id"), F.when(m == 2, n).alias("customer_id"))
    k = F.col("n_nationkey")
    return C.subscription_row(subs, table(spark, d, "nation").select(k.alias("k"), k.alias("workspace_id"), k.alias("external_id"), k.alias("customer_id"))).select("k", "subscription")


@query("select o_custkey as owner, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as workspace_id from orders group by 1")
def o3_default_workspace(spark, d):
    return C.default_workspace(table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("workspace_id"), F.col("o_orderdate").alias("created_at")))


@query("select row_number() over (order by rank, seq, lower(name), id) as place, id, name from (select r_regionkey::bigint as id, r_name as name, 0 as rank, r_regionkey as seq from region union all select n_nationkey::bigint + 100, n_name, 1, 0 from nation)")
def m21_built_in_first(spark, d):
    from pyspark.sql import Window as W

    a = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("seq"))
    b = table(spark, d, "nation").select((F.col("n_nationkey").cast("long") + 100).alias("id"), F.col("n_name").alias("name"))
    return C.built_in_first(a, b).select(F.row_number().over(W.orderBy("rank", "seq", F.lower("name"), "id")).cast("long").alias("place"), "id", "name")


@query(with_(TEMPLATES) + "select n_nationkey as workspace_id, t.id as default_template from nation left join templates t on t.id = n_nationkey and t.workspace_id = n_nationkey and visibility = 'workspace'")
def m22_workspace_default(spark, d):
    w = table(spark, d, "nation").select(F.col("n_nationkey").alias("workspace_id"), F.col("n_nationkey").cast("long").alias("default_template"))
    return C.workspace_default(w, templates(spark, d)).select("workspace_id", "default_template")


@query("select doc_id, source, lang from documents where doc_id not in (select doc_id from labels)")
def s16_backfill_missing(spark, d):
    return missing_only(table(spark, d, "documents").select("doc_id", "source", "lang"), table(spark, d, "labels"), "doc_id")


@query("select user_id, trim(id) as id, count(*) as n from (select user_id, unnest(string_split(props_list, ',')) as id from (select user_id, event_type || ', ' || (event_id % 7) as props_list from events)) where trim(id) <> '' group by all")
def o16_comma_lists(spark, d):
    rows = events(spark, d).select("user_id", F.concat("event_type", F.lit(", "), (F.col("event_id") % 7).cast("string")).alias("ids"))
    return C.of_list(rows, "ids", "id").groupBy("user_id", "id").agg(F.count("*").alias("n"))


@query("select event_type as category, count(*) filter (where value < 10) as low, count(*) filter (where value >= 10 and value < 50) as mid, count(*) filter (where value >= 50) as high, round(100.0 * count(*) filter (where value >= 50) / count(*), 2)::double as done from events group by 1")
def a26_category_counts(spark, d):
    v = F.col("value")
    return events(spark, d).groupBy(F.col("event_type").alias("category")).agg(F.count_if(v < 10).alias("low"), F.count_if((v >= 10) & (v < 50)).alias("mid"), F.count_if(v >= 50).alias("high"), F.round(100.0 * F.count_if(v >= 50) / F.count("*"), 2).alias("done"))
