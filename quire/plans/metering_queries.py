"""Queries of metering, limits and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import history as H
from ..operators import metering as M
from ..sources.tables import events, table
from .catalogue import query
from .relations import DOCS, docs, with_

AS_OF = "2024-01-15 00:00:00"
FIELDS = {"view": "views", "click": "clicks", "purchase": "purchases", "signup": "signups"}
USED = "used as (select user_id, count(*) as n from events where ts >= timestamp '2024-01-01' and ts < timestamp '2024-02-01' group by 1)"
SUBS = "subs as (select user_id, case user_id % 5 when 0 then 'pro' when 1 then 'business' when 2 then 'gold' else 'pro' end as plan, case user_id % 4 when 0 then 'active' when 1 then 'trialing' when 2 then 'canceled' else 'past_due' end as status from (select distinct user_id from events))"
PLANS = "plans as (select * from (values ('free', 25, 100, 5, 250, 10, true, true, false), ('pro', 500, 2000, 100, 5120, 50, true, true, false), ('business', null, 10000, null, 51200, 100, true, true, true)) t(plan, max_documents, max_ai_operations, max_templates, max_storage_mb, max_document_size_mb, can_export_docx, can_export_pdf, priority))"
PLAN = "planned as (select user_id, case when status in ('active','trialing','past_due') and plan in ('free','pro','business') then plan else 'free' end as plan from subs)"


def at(text: str = AS_OF):
    return F.lit(text).cast("timestamp")


def subscriptions(spark: SparkSession, d: str) -> DataFrame:
    u = events(spark, d).select("user_id").distinct()
    k, s = F.col("user_id") % 5, F.col("user_id") % 4
    return u.withColumns({"plan": F.when(k == 0, "pro").when(k == 1, "business").when(k == 2, "gold").otherwise("pro"), "status": F.when(s == 0, "active").when(s == 1, "trialing").when(s == 2, "canceled").otherwise("past_due")})


def used(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return e.where((F.col("ts") >= M.month_start(at())) & (F.col("ts") < M.month_end(at()))).groupBy("user_id").agg(F.count("*").alias("n"))


@query("select user_id, sum(case when event_type='view' then 1 else 0 end)::bigint as views, sum(case when event_type='click' then 1 else 0 end)::bigint as clicks, sum(case when event_type='purchase' then 1 else 0 end)::bigint as purchases, sum(case when event_type='signup' then 1 else 0 end)::bigint as signups from events where ts >= timestamp '2024-01-01' and ts < timestamp '2024-02-01' group by 1")
def a1_usage_summary(spark, d):
    return M.usage_summary(events(spark, d).withColumn("one", F.lit(1)), workspace="user_id", metric="event_type", quantity="one", at=at(), fields=FIELDS)


@query("select date_trunc('month', ts)::timestamp as month, event_type, count(*) as n, round(sum(value), 2) as total from events group by all")
def a1_usage_by_month_and_type(spark, d):
    return M.usage_rows(events(spark, d)).groupBy(F.col("period_start").cast("timestamp_ntz").alias("month"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("with a as (select source, sum(length(text)) as chars from documents group by 1), b as (select 'src' || page_id % 25 as source, sum(strlen(html)) as bytes from pages group by 1) select coalesce(a.source, b.source) as source, (coalesce(chars, 0) + coalesce(bytes, 0))::bigint as storage from a full join b on a.source = b.source")
def a2_storage_bytes(spark, d):
    assets = table(spark, d, "pages").select(F.concat(F.lit("src"), (F.col("page_id") % 25).cast("string")).alias("source"), F.octet_length("html").alias("size"))
    return M.storage_bytes(table(spark, d, "documents").select("source", "text"), assets, workspace="source", text="text", size="size")


@query("select source as workspace, count(*) as documents from documents group by 1")
def a3_documents_per_workspace(spark, d):
    return M.document_counts(table(spark, d, "documents").withColumnRenamed("source", "workspace"), workspace="workspace")


@query(with_(USED, SUBS, PLAN, PLANS) + "select user_id, plan, n as used, case when max_ai_operations is not null then greatest(0, max_ai_operations - n) end::bigint as remaining_operations, case when max_documents is not null then greatest(0, max_documents - n) end::bigint as remaining_documents from planned join plans using(plan) join used using(user_id)")
def a4_remaining(spark, d):
    rows = M.effective_plan(subscriptions(spark, d)).join(F.broadcast(M.plans(spark)), "plan").join(used(spark, d), "user_id")  # three plans
    return rows.select("user_id", "plan", F.col("n").alias("used"), M.remaining(F.col("max_ai_operations"), F.col("n")).alias("remaining_operations"), M.remaining(F.col("max_documents"), F.col("n")).alias("remaining_documents"))


@query(with_(USED, SUBS, PLAN, PLANS) + "select user_id, n as used, coalesce(n >= max_documents, false) as refused, coalesce(n >= max_templates, false) as template_refused from planned join plans using(plan) join used using(user_id)")
def a5_document_limit(spark, d):
    rows = M.effective_plan(subscriptions(spark, d)).join(F.broadcast(M.plans(spark)), "plan").join(used(spark, d), "user_id")
    return rows.select("user_id", F.col("n").alias("used"), M.refused_count(F.col("max_documents"), F.col("n")).alias("refused"), M.refused_count(F.col("max_templates"), F.col("n")).alias("template_refused"))


@query("with s as (select source, sum(strlen(text)) * 2000 as used from documents group by 1) select source, used::bigint as used, ceil(used / 1048576)::bigint as used_mb, coalesce(used + 5000000 > 250::bigint * 1048576, false) as refused from s")
def a6_storage_limit(spark, d):
    s = table(spark, d, "documents").groupBy("source").agg((F.sum(F.octet_length("text")) * 2000).alias("used"))
    return s.select("source", "used", M.used_mb(F.col("used")).alias("used_mb"), M.refused_storage(F.lit(250), F.col("used"), F.lit(5_000_000)).alias("refused"))


@query(with_(SUBS, PLAN, PLANS) + "select user_id, can_export_docx, can_export_pdf, priority, least(max_document_size_mb, 60) as upload_mb from planned join plans using(plan)")
def a7_export_gates(spark, d):
    rows = M.effective_plan(subscriptions(spark, d)).join(F.broadcast(M.plans(spark)), "plan")
    return rows.select("user_id", "can_export_docx", "can_export_pdf", "priority", M.capped_upload_mb(F.col("max_document_size_mb"), 60).alias("upload_mb"))


@query(with_(USED, SUBS, PLAN, PLANS) + "select plan, count(*) as workspaces, sum(n)::bigint as used, sum(case when n >= max_documents then 1 else 0 end)::bigint as at_limit from planned join plans using(plan) left join used using(user_id) group by 1")
def a8_billing_summary(spark, d):
    rows = M.effective_plan(subscriptions(spark, d)).join(F.broadcast(M.plans(spark)), "plan").join(used(spark, d), "user_id", "left")
    return rows.groupBy("plan").agg(F.count("*").alias("workspaces"), F.sum("n").alias("used"), F.count_if(M.refused_count(F.col("max_documents"), F.col("n"))).alias("at_limit"))


@query("select coalesce(sum(strlen(html)), 0)::bigint as total from pages where page_id in (select doc_id from labels)")
def a9_total_size(spark, d):
    from ..operators.catalog import total_size

    return total_size(table(spark, d, "pages").select("page_id", F.octet_length("html").alias("size")), table(spark, d, "labels").select(F.col("doc_id").alias("page_id")), key="page_id", size="size")


@query("select user_id, case when status in ('active','trialing','past_due') and plan in ('free','pro','business') then plan else 'free' end as plan from (" + with_(SUBS) + "select * from subs)")
def p7_effective_plan(spark, d):
    return M.effective_plan(subscriptions(spark, d)).select("user_id", "plan")


@query("with h as (select *, floor(epoch_us(ts) / 1000000 / 86400)::bigint as w from events), r as (select event_id, user_id, w as window_id, row_number() over (partition by user_id, w order by ts, event_id) as nth, ts from h) select event_id, user_id, window_id, nth, greatest(1, ceil((window_id + 1) * 86400 - epoch_us(ts) / 1000000))::integer as retry_after from r where nth > 3")
def e1_rate_limit_refusals(spark, d):
    out = M.rate_limit(events(spark, d), key=["user_id"], order=["event_id"], limit=F.lit(3), seconds=F.lit(86400))
    return out.where("refused").select("event_id", "user_id", F.col("window").alias("window_id"), F.col("nth").cast("long").alias("nth"), "retry_after")


@query("select floor(epoch_us(ts) / 1000000 / 60)::bigint as window_id, event_type, count(*) as hits from events group by all")
def e1_fixed_window_counts(spark, d):
    return events(spark, d).groupBy(M.fixed_window(F.col("ts"), F.lit(60)).alias("window_id"), "event_type").agg(F.count("*").alias("hits"))


RATES_SQL = "rates as (select * from (values " + ", ".join(f"('{s}', '{r}')" for s, r in M.RATES.items()) + ") t(scope, rate))"


@query(with_(RATES_SQL) + "select event_id, scope, split_part(rate, '/', 1)::integer as \"limit\", case split_part(rate, '/', 2) when 'second' then 1 when 'minute' then 60 when 'hour' then 3600 else 86400 end as seconds from (select event_id, " + str(list(M.RATES)) + "[event_id % " + str(len(M.RATES)) + " + 1] as scope from events) join rates using (scope)")
def e3_scope_rates(spark, d):
    """The limit and window that hold for each event's scope."""
    scope = F.get(F.array(*map(F.lit, M.RATES)), F.col("event_id") % len(M.RATES))
    rates = M.scope_rates(spark).select("scope", "limit", "seconds")
    return events(spark, d).select("event_id", scope.alias("scope")).join(F.broadcast(rates), "scope")  # a fixed table of a row a scope


@query("select l_orderkey, l_linenumber, case when n > 0 and s is not null then n end as \"limit\", case when n > 0 then s end as seconds from (select l_orderkey, l_linenumber, case when l_partkey % 9 = 0 then null else (l_partkey % 50)::integer end as n, case l_linenumber % 6 when 0 then 1 when 1 then 60 when 2 then 3600 when 3 then 86400 when 4 then 60 end as s from lineitem)")
def d29_parse_rate(spark, d):
    """Rates of all units, in both numbers, some of nothing, some not numbers, some of weeks."""
    unit = F.get(F.array(*map(F.lit, ("second", "minute", "hours", " day ", " minutes", "week"))), F.col("l_linenumber") % 6)
    text = F.concat(F.when(F.col("l_partkey") % 9 == 0, "x").otherwise((F.col("l_partkey") % 50).cast("string")), F.lit("/"), unit)
    return table(spark, d, "lineitem").withColumn("r", M.rate_of(text)).select("l_orderkey", "l_linenumber", F.col("r.limit").alias("limit"), F.col("r.seconds").alias("seconds"))


@query("select event_id, date_trunc('month', ts)::timestamp as month_start, (date_trunc('month', ts) + interval 1 month)::timestamp as month_end from events")
def d30_month_of(spark, d):
    return events(spark, d).select("event_id", M.month_start(F.col("ts")).cast("timestamp_ntz").alias("month_start"), M.month_end(F.col("ts")).cast("timestamp_ntz").alias("month_end"))


@query("select event_id, user_id, date_trunc('month', ts)::timestamp as period_start from events where event_type <> 'error'")
def e4_usage_rows(spark, d):
    return M.usage_rows(events(spark, d), ok=F.col("event_type") != "error").select("event_id", "user_id", F.col("period_start").cast("timestamp_ntz").alias("period_start"))


@query("with r as (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as nth, epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id) as late from events) select event_id, user_id, (nth <= 20 and late / 1000000 <= 1000000) as allowed from r")
def e15_call_budget(spark, d):
    return M.within_budget(events(spark, d), job="user_id", order=["ts", "event_id"], most=20, seconds=1_000_000).select("event_id", "user_id", "allowed")


SAVES = "saves as (select user_id, event_id, ts, case when event_type in ('view', 'click') then 'content' else 'format' end as kind, row_number() over (partition by user_id order by ts, event_id) as rn from events)"
BURST = """with recursive """ + SAVES + """, steps as (
  select user_id, rn, ts, kind, ts as started, 1::bigint as step from saves where rn = 1
  union all select s.user_id, s.rn, s.ts, s.kind,
    case when s.kind = 'content' and p.kind = 'content' and s.ts - p.started < interval 1 hour then p.started else s.ts end,
    case when s.kind = 'content' and p.kind = 'content' and s.ts - p.started < interval 1 hour then p.step else p.step + 1 end
  from saves s join steps p on s.user_id = p.user_id and s.rn = p.rn + 1),
folded as (select user_id, step, any_value(kind) as kind, min(ts) as started, max(ts) as ended, count(*) as saves from steps group by 1, 2) """


def saves(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("user_id", "ts", "event_id", F.when(F.col("event_type").isin("view", "click"), "content").otherwise("format").alias("kind"), F.col("event_id").cast("string").alias("payload"))


def steps(spark: SparkSession, d: str) -> DataFrame:
    return H.burst_steps(saves(spark, d), doc="user_id", order=["event_id"], seconds=3600)


@query(BURST + "select user_id, step, kind, started, ended, saves from folded")
def w13_burst_steps(spark, d):
    return steps(spark, d).select("user_id", "step", "kind", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "saves")


@query(BURST + "select user_id, step from (select *, max(step) over (partition by user_id) as last from folded) where last - step < 5 or step = 1")
def w13_trimmed_history(spark, d):
    return H.trimmed(steps(spark, d), doc="user_id", number="step", depth=5).select("user_id", "step")


@query("select conv_id, turn, coalesce(lag(turn) over w = turn - 1, false) as can_undo, coalesce(lead(turn) over w = turn + 1, false) as can_redo from conversations window w as (partition by conv_id order by turn)")
def w14_undo_redo(spark, d):
    return H.neighbours(table(spark, d, "conversations").select("conv_id", "turn"), doc="conv_id", number="turn").select("conv_id", "turn", "can_undo", "can_redo")


@query("select conv_id, turn, role, text from conversations where turn = conv_id % 3")
def m15_state_at_version(spark, d):
    v = table(spark, d, "conversations")
    wanted = v.select("conv_id").distinct().withColumn("turn", F.col("conv_id") % 3)
    return H.at_version(v, wanted, doc="conv_id", number="turn").select("conv_id", "turn", "role", "text")


@query("select conv_id, 1::bigint as pointer from conversations group by 1 having max(turn) > 1")
def j9_newer_version_exists(spark, d):
    v = table(spark, d, "conversations")
    return H.has_newer(v, v.select("conv_id").distinct().withColumn("pointer", F.lit(1).cast("long")), doc="conv_id", number="turn", pointer="pointer")


@query("select conv_id, turn from conversations where turn <= 2 - conv_id % 2")
def w13_redo_tail_dropped(spark, d):
    v = table(spark, d, "conversations").select("conv_id", "turn")
    return H.without_redo_tail(v, v.select("conv_id").distinct().withColumn("pointer", 2 - F.col("conv_id") % 2), doc="conv_id", number="turn", pointer="pointer").select("conv_id", "turn")


@query("select o_orderkey, case when c_custkey % 3 = 0 then c_name else 'user' || c_custkey || '@example.org' end as author_name from orders left join customer on o_custkey = c_custkey and c_custkey % 5 <> 0")
def j4_version_authors(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 5 <> 0")
    users = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("full_name"), F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.org")).alias("email"))
    return H.listing(table(spark, d, "orders").select("o_orderkey", "o_custkey"), users, author="o_custkey", user="c_custkey", name="full_name", email="email").select("o_orderkey", "author_name")


@query("with used as (select distinct regexp_extract(unnest(regexp_extract_all(lower(html), '/[0-9]+')), '[0-9]+') as id from pages) select event_id from events where ts < timestamp '2024-01-15' - interval 1 day and event_id::varchar not in (select id from used)")
def j10_unused_assets(spark, d):
    texts = table(spark, d, "pages").select(F.regexp_replace(F.lower("html"), "/([0-9]+)", " @$1@ ").alias("html"))
    return H.unused_assets(events(spark, d).select(F.col("event_id"), "ts"), texts, asset="event_id", created="ts", text="html", pattern="(?<=@)[0-9]+(?=@)", as_of=at()).select("event_id")


@query("select event_id from events where ts < timestamp '2024-01-15' - interval 24 hour")
def e12_expired_files(spark, d):
    return H.expired(events(spark, d), finished="ts", as_of=at(), hours=24).select("event_id")


@query("select user_id, arg_max(event_type, (ts, event_id)) as state, max(ts) as since from events group by 1")
def e8_job_state(spark, d):
    out = H.latest_state(events(spark, d).select("user_id", "ts", "event_id", F.col("event_type").alias("state")), key=["user_id"], order=["ts", "event_id"])
    return out.select("user_id", "state", F.col("ts").cast("timestamp_ntz").alias("since"))


@query("select doc_id, case when quality = 1 then n_chars + 1 else n_chars end as revision, coalesce(quality <> 1, false) as refused from documents left join labels using(doc_id)")
def e6_optimistic_revision(spark, d):
    stored = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("revision"), F.lit("old").alias("payload"))
    writes = table(spark, d, "labels").join(stored.select("doc_id", "revision"), "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("revision")).otherwise(-1).alias("expected"), F.lit("new").alias("payload"))
    return H.merge_revision(stored, writes, key="doc_id").select("doc_id", "revision", "refused")


@query(with_(DOCS) + ", tokens as (select id, workspace_id as user_id, id % 3 as purpose, created_at, case when id % 5 = 0 then created_at end as used_at, created_at + interval 2000 day as expires_at from docs) select id, user_id, purpose from (select *, row_number() over (partition by user_id, purpose order by created_at desc, id desc) as nth from tokens) where nth = 1 and used_at is null and expires_at > timestamp '1998-01-01'")
def e17_valid_tokens(spark, d):
    from ..operators.catalog import valid_tokens

    t = docs(spark, d).select("id", F.col("workspace_id").alias("user_id"), (F.col("id") % 3).alias("purpose"), "created_at", F.when(F.col("id") % 5 == 0, F.col("created_at")).alias("used_at"), (F.col("created_at") + F.make_dt_interval(F.lit(2000))).alias("expires_at"))
    return valid_tokens(t, F.lit("1998-01-01").cast("timestamp_ntz")).select("id", "user_id", "purpose")
