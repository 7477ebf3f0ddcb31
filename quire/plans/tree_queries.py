"""Queries of the document tree."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..functions import units as U
from ..operators import tree as T_
from ..sources.tables import table
from .catalogue import query
from .relations import ELEMENTS, elements, with_


@query("select conv_id, string_agg(text, '' order by turn) as content from conversations group by 1")
def d1_plain_text(spark, d):
    runs = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("runs"))
    return runs.select("conv_id", T_.plain_text(F.col("runs")).alias("content"))


MARKED = (["link", "bold", "bold"], ["textStyle", "italic", "code"], [], ["glow", "underline"])


@query("select l_orderkey, l_linenumber, list_concat([['bold', 'link'], ['italic', 'code', 'textStyle'], [], ['underline']][l_partkey % 4 + 1], case when l_linenumber % 2 = 1 then ['hidden'] else [] end, case when l_partkey % 4 = 3 then ['glow'] else [] end, ['x' || l_linenumber]) as marks from lineitem")
def o7_ordered_marks(spark, d):
    """Marks in any order, some twice, some hidden, some unknown: those come last by name."""
    held = F.get(F.array(*(F.array(*map(F.lit, m)).cast("array<string>") for m in MARKED)), F.col("l_partkey") % 4)
    more = F.array_compact(F.array(F.concat(F.lit("x"), F.col("l_linenumber").cast("string")), F.when(F.col("l_linenumber") % 2 == 1, "hidden")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T_.ordered_marks(F.concat(more, held)).alias("marks"))


@query("select conv_id, turn, (row_number() over (partition by conv_id order by turn // 3, turn % 3) - 1)::integer as place, case when turn % 3 = 0 then 0 else 1 end as depth from conversations")
def w16_depth_first(spark, d):
    t = F.col("turn").cast("int")
    path = F.when(t % 3 == 0, F.array(F.floor(t / 3).cast("int"))).otherwise(F.array(F.floor(t / 3).cast("int"), (t % 3).cast("int")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", path.alias("path"))
    return T_.depth_first(rows, doc="conv_id").select("conv_id", "turn", F.col("place").cast("int").alias("place"), T_.depth(F.col("path")).alias("depth"))


@query(with_(ELEMENTS) + "select doc_id, ord, case when type = 'paragraph' and ord % 6 not in (1, 3) and (coalesce(lag(type) over w, '') in ('image', 'table') or coalesce(lead(type) over w, '') in ('image', 'table')) then 'caption' else type end as type from elements window w as (partition by doc_id order by ord)")
def w11_marked_captions(spark, d):
    """A label and number without a separator is no caption."""
    texts = F.array(*map(F.lit, ("Figure 3: view", "Figure 2", "Схема 1.", "plain", "ТАБЛИЦА 2.3 – data", "Image 4) x")))
    e = elements(spark, d).withColumn("content", F.get(texts, F.col("ord") % 6))
    return T_.captioned(e).select("doc_id", "ord", "type")


ISLANDS = """with p as (select o_custkey as doc_id, o_orderkey as ord, case when o_orderkey % 4 <> 0 then o_orderkey % 8 // 4 end as num_id, o_orderkey % 3 as level, o_orderkey % 5 <> 0 as boxed from orders),
 i as (select *, sum((num_id is distinct from prev)::int) over (partition by doc_id order by ord) as island from (select *, lag(num_id) over (partition by doc_id order by ord) as prev from p)),
 l as (select doc_id, num_id, island, min(ord) as first, count(*) as items, max(level) - min(level) as deepest, bool_and(boxed) as checklist from i where num_id is not null group by 1, 2, 3) """


def list_paragraphs(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("ord"), F.when(k % 4 != 0, F.floor(k % 8 / 4)).alias("num_id"), (k % 3).alias("level"), (k % 5 != 0).alias("boxed"))


@query(ISLANDS + "select doc_id, first, num_id, items, deepest, checklist from l")
def w12_lists(spark, d):
    return T_.lists_of(list_paragraphs(spark, d)).select("doc_id", "first", "num_id", "items", "deepest", "checklist")


@query(ISLANDS + "select doc_id, first, (1 + coalesce(sum(items) over (partition by doc_id, num_id order by first rows between unbounded preceding and 1 preceding), 0))::bigint as start from l")
def g10_continued_lists(spark, d):
    return T_.continued_starts(T_.lists_of(list_paragraphs(spark, d))).select("doc_id", "first", "start")


@query("with e as (select conv_id as doc_id, conv_id || '-' || turn as element_id, turn::double as pos, 0 as s from conversations), n as (select doc_id, element_id || '+' as element_id, pos, 2 as s from e where pos = 1 union all select doc_id, element_id || '+2', pos, 1 from e where pos = 1 union all select doc_id, element_id || '+2a', pos, 1.5 from e where pos = 1 union all select distinct doc_id, doc_id || '-end', null::double, 1 from e union all select distinct doc_id, doc_id || '-lost', null::double, 2 from e) select doc_id, element_id, row_number() over (partition by doc_id order by pos nulls last, s, element_id) - 1 as ord from (select * from e union all select * from n)")
def m5_inserted_elements(spark, d):
    c = table(spark, d, "conversations")
    name = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    e = c.select(F.col("conv_id").alias("doc_id"), name.alias("element_id"), F.col("turn").alias("ord"))
    own, doc = F.col("element_id"), F.col("doc_id").cast("string")

    def new(rows, seq, name, after):
        return rows.select("doc_id", F.lit(seq).alias("seq"), name.alias("element_id"), after.cast("string").alias("after_id"))

    one, each = e.where("ord = 1"), e.select("doc_id").distinct()
    steps = new(one, 1, F.concat(own, F.lit("+")), own).unionByName(new(one, 2, F.concat(own, F.lit("+2")), own)).unionByName(new(one, 3, F.concat(own, F.lit("+2a")), F.concat(own, F.lit("+2"))))
    steps = steps.unionByName(new(each, 4, F.concat(doc, F.lit("-end")), F.lit(None))).unionByName(new(each, 5, F.concat(doc, F.lit("-lost")), F.lit("nowhere")))
    return T_.inserted(e, steps).select("doc_id", "element_id", F.col("ord").cast("long").alias("ord"))


OPS = "select doc_id, element_id, ord, case ord % 4 when 0 then 'delete' when 1 then 'insert' when 2 then 'set_style' else 'move' end as op from elements where ord % 2 = 0 or ord % 9 = 1"


def operations(spark, d):
    e = elements(spark, d).where("ord % 2 = 0 or ord % 9 = 1")
    k = F.col("ord") % 4
    return e.select(
        "doc_id", F.col("ord").alias("seq"), F.when(k == 0, "delete").when(k == 1, "insert").when(k == 2, "set_style").otherwise("move").alias("op"), F.when(F.col("ord") % 10 == 0, F.concat("element_id", F.lit("?"))).otherwise(F.col("element_id")).alias("target"),
        F.lit(None).cast("string").alias("after_id"), F.when(F.col("ord") % 3 == 0, F.lit("x")).alias("content"), F.lit("bold").alias("property"), F.when(F.col("ord") % 6 == 0, F.lit("true")).alias("value"),
    )


@query(with_(ELEMENTS) + f"select doc_id, ord as seq from ({OPS}) where ord % 10 = 0 or (op = 'insert' and ord % 3 <> 0) or (op = 'set_style' and ord % 6 <> 0)")
def m6_invalid_operations(spark, d):
    return T_.invalid_operations(operations(spark, d), elements(spark, d)).select("doc_id", "seq")


@query(with_(ELEMENTS) + f"select op = 'set_style' as applied, count(*) as n from ({OPS}) group by 1")
def m8_split_operations(spark, d):
    a, b = T_.split_operations(operations(spark, d))
    return a.withColumn("applied", F.lit(True)).unionByName(b.withColumn("applied", F.lit(False))).groupBy("applied").agg(F.count("*").alias("n"))


STEPS = """rows as (select conv_id as doc_id, turn, 0 as s, turn::varchar as element_id, turn = 0 as last from conversations where turn % 4 <> 3
 union all select conv_id, turn, 1, turn || '-new', false from conversations where turn % 4 = 1 union all select conv_id, turn, 2, turn || '-break', false from conversations where turn % 5 = 1)"""


@query(with_(STEPS) + "select doc_id, row_number() over (partition by doc_id order by last, turn, s) - 1 as ord, element_id from rows")
def m7_applied_operations(spark, d):
    """Breaks, insertions, looks, deletions and a move to the end, in this order; odd documents also have a look with no value, which nothing follows here."""
    t = F.col("ord")
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.col("turn").cast("string").alias("element_id"))
    none = F.lit(None).cast("string")

    def step(rows, k, op, target, after=none, content=none, prop=none, value=none):
        return rows.select("doc_id", (t + k * 1_000_000).alias("seq"), F.lit(op).alias("op"), target.alias("target"), after.alias("after_id"), content.alias("content"), prop.alias("property"), value.alias("value"))

    own = F.col("element_id")
    steps = step(c.where(t % 5 == 1), 0, "page_break", F.concat(own, F.lit("-break")), own)
    steps = steps.unionByName(step(c.where(t % 4 == 1), 1, "insert", F.concat(own, F.lit("-new")), own, F.lit("new")))
    steps = steps.unionByName(step(c.where(t % 4 == 2), 2, "set_style", own, none, none, F.lit("bold"), F.lit("true")))
    steps = steps.unionByName(step(c.where(t % 4 == 3), 3, "delete", own)).unionByName(step(c.where(t == 0), 4, "move", own))
    return T_.applied(c, steps)


@query(with_(ELEMENTS) + f", o as ({OPS}), bad as (select distinct doc_id from o where ord % 10 = 0 or (op = 'insert' and ord % 3 <> 0) or (op = 'set_style' and ord % 6 <> 0)) select doc_id, count(*) as kept from elements where doc_id in (select doc_id from bad) group by 1")
def m6_refused_batches(spark, d):
    """Documents with an operation that cannot be applied keep all their elements."""
    e, ops = elements(spark, d), operations(spark, d)
    bad = T_.invalid_operations(ops, e).select("doc_id").distinct()
    return T_.applied(e, ops).join(bad, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("with o as (select conv_id as doc_id, turn from conversations where turn % 3 <> 1), k as (select doc_id, turn::varchar as target, 'color' as property, 'red' as value, 1 as priority from o where turn % 2 = 1 union all select conv_id, turn::varchar, 'bold', 'true', 2 from conversations where turn % 4 = 2) select doc_id, target, property, value, priority from k")
def m7_styled_rules(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.col("turn").cast("string").alias("target"))
    t = F.col("turn")
    held = c.where(t % 3 != 1).select("doc_id", "target", F.when(t % 2 == 1, "color").otherwise("bold").alias("property"), F.when(t % 2 == 1, "red").otherwise("false").alias("value"), F.lit(1).alias("priority"), F.lit("live_override").alias("source"), t.alias("seq"))
    held = held.where("property = 'color' or seq % 4 = 2")
    ops = c.where(t % 4 == 2).select("doc_id", t.alias("seq"), F.lit("set_style").alias("op"), "target", F.lit("bold").alias("property"), F.lit("false").alias("value"))
    last = ops.withColumns({"seq": F.col("seq") + 1_000_000, "value": F.lit("true")})
    return T_.styled(held, ops.unionByName(last)).select("doc_id", "target", "property", "value", "priority")


@query("with o as (select user_id, event_type, min(event_id) as event_id from events where event_id % 2 = 0 group by 1, 2) select user_id, event_type, event_id from o where not exists (select 1 from events w where w.event_id % 7 = 1 and w.user_id = o.user_id and w.event_type = o.event_type)")
def o15_new_proposals(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return T_.new_proposals(e.where("event_id % 7 = 1"), e.where("event_id % 2 = 0"), ["user_id", "event_type"], order="event_id").select("user_id", "event_type", "event_id")


@query(with_(ELEMENTS) + "select doc_id, ord from elements where ord % 3 <> 1 and ord % 10 <> 0")
def o11_live_proposals(spark, d):
    e = elements(spark, d)
    p = e.where("ord % 3 != 1").select("doc_id", "ord", F.when(F.col("ord") % 10 == 0, F.lit("gone")).otherwise(F.col("element_id")).alias("target"), F.lit(None).cast("string").alias("after_id"))
    return T_.live_proposals(p, e).select("doc_id", "ord")


@query(with_(ELEMENTS) + "select doc_id, element_id, n, case when n = 0 then font end as font from elements, (values (0), (1)) t(n)")
def j19_kept_fields(spark, d):
    e = elements(spark, d).select("doc_id", "element_id", "ord", "font")
    twice = e.select("doc_id", "element_id", (F.col("ord") * 2).alias("ord"), F.lit("client").alias("font"), F.lit(0).alias("n")).unionByName(e.select("doc_id", "element_id", (F.col("ord") * 2 + 1).alias("ord"), F.lit("client").alias("font"), F.lit(1).alias("n")))
    return T_.keep_fields(e, twice, ["font"]).select("doc_id", "element_id", "n", "font")


@query("select b.doc_id, b.block::integer as block, count(c.turn) as uses from (select doc_id, unnest(range(0, n)) as block from (select conv_id as doc_id, max(turn) + 1 as n from conversations group by 1)) b left join conversations c on c.conv_id = b.doc_id and c.turn // 2 = b.block group by 1, 2")
def a23_block_use(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 2).cast("int").alias("block"), "turn")
    n = c.groupBy("doc_id").agg((F.max("turn") + 1).cast("int").alias("n"))
    return T_.block_use(c, n)


@query(with_(ELEMENTS) + "select doc_id, ord, level, substr(content, 1, 120) as content from (select *, row_number() over (partition by doc_id order by ord desc) as b from elements where type = 'heading') where b <= 2")
def o9_last_headings(spark, d):
    return T_.last_headings(elements(spark, d), most=2)


@query("select page_id, 0 as nth, regexp_replace(url, '[.,;:!?)\\]]+$', '') as href from pages")
def g13_autolinks(spark, d):
    return T_.autolinks(table(spark, d, "pages").select("page_id", F.concat(F.lit("see "), "url", F.lit(" and so on.")).alias("text")), key="page_id", text="text")


@query("with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as k from events), t as (select *, min(event_id) over (partition by user_id, k // 40) as thread from r) select user_id as doc_id, event_id as id, thread, thread % 8 = 0 as resolved from t")
def g19_comment_threads(spark, d):
    """Each event answers its user's one before it, in chains of forty."""
    w = W.partitionBy("user_id").orderBy("event_id")
    own = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("id"), F.when((F.row_number().over(w) - 1) % 40 != 0, F.lag("event_id").over(w)).alias("parent_id"), (F.col("event_id") % 8 == 0).alias("resolved"))
    return T_.threads(own).select("doc_id", "id", "thread", "resolved")


@query("select l_orderkey, l_linenumber, case l_linenumber % 3 when 0 then l_extendedprice::double when 1 then l_extendedprice::double * 0.75 end as pt from lineitem")
def d16_points(spark, d):
    """Points and pixels are told in points; centimetres are not."""
    unit = F.get(F.array(F.lit("pt"), F.lit("px"), F.lit("cm")), F.col("l_linenumber") % 3)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", U.to_pt(F.col("l_extendedprice").cast("string"), unit).alias("pt"))
