"""Queries of copied blocks: which groups of lines can be written as they were, and what others lose."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import copies
from ..sources.tables import table
from .catalogue import query
from .relations import with_

#: Lines of documents as elements; some hold two blocks, a block of the line before, none, or one that is not there; some were moved.
PARTS = """l as (select doc_id, cast(ord as bigint) as ord, count(*) over (partition by doc_id) as n from (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ord from documents where text is not null)),
e as (select doc_id, n, case when ord % 41 = 17 and ord + 1 < n then ord + 1 when ord % 41 = 18 then ord - 1 else ord end as pos, (doc_id + ord) % 10 <> 1 as unchanged, ord % 19 = 7 as is_break,
 case when ord % 29 = 28 then [] when ord % 31 = 30 then [ord, n + 5] when ord % 7 = 5 then [ord - 1, ord] when ord % 11 = 3 and ord + 1 < n then [ord, ord + 1] else [ord] end as sources from l),
b as (select doc_id, ord as child, (doc_id * 7 + ord) % 23 <> 0 as contained, (doc_id + ord) % 31 <> 5 as safe, ord % 3 = 1 as drawings, 1 + (ord % 37 = 36)::int as uses from l),
h as (select distinct e.doc_id, e.pos, s.child from e, unnest(sources) s(child) where s.child < e.n),
r as (select doc_id, ord as first, ord + 3 as last from l where ord % 53 = 20 and ord + 3 < n)"""
#: Groups by following links both ways, and their conditions.
PLAN = """, s as (select doc_id, pos from e where len(sources) > 0),
k as (select a.doc_id, a.pos as u, b.pos as v from h a join h b on a.doc_id = b.doc_id and a.child = b.child union select r.doc_id, r.first, s.pos from r join s on s.doc_id = r.doc_id and s.pos between r.first and r.last where exists (select 1 from s x where x.doc_id = r.doc_id and x.pos = r.first)
 union select r.doc_id, s.pos, r.first from r join s on s.doc_id = r.doc_id and s.pos between r.first and r.last where exists (select 1 from s x where x.doc_id = r.doc_id and x.pos = r.first)),
reach as (with recursive w as (select doc_id, pos as u, pos as v from s union select w.doc_id, w.u, k.v from w join k on k.doc_id = w.doc_id and k.u = w.v) select doc_id, u as pos, min(v) as grp from w group by 1, 2),
own as (select doc_id, child, count(*) as held, min(pos) as pos from h group by 1, 2),
st as (select b.*, held, reach.grp, uses > coalesce(held, 0) as deleted, uses > coalesce(held, 0) and held is null as gone from b left join own using (doc_id, child) left join reach on reach.doc_id = b.doc_id and reach.pos = own.pos),
tk as (select * exclude (grp), coalesce(last_value(grp ignore nulls) over (partition by doc_id order by child rows between unbounded preceding and current row), first_value(grp ignore nulls) over (partition by doc_id order by child rows between current row and unbounded following)) as grp,
 child - sum(gone::int) over (partition by doc_id order by child) as place from st),
bg as (select doc_id, grp, list(child order by child) as children, max(place) - min(place) + 1 = count(*) as whole, bool_or(deleted) as lost, bool_and(contained) as contained, bool_and(safe) as safe, list(child order by child) filter (where held is null and drawings) as alone from tk where not gone and grp is not null group by 1, 2),
ee as (select e.*, reach.grp, list_min(sources) < lag(list_min(sources)) over (partition by e.doc_id, reach.grp order by e.pos) as back, exists (select 1 from unnest(sources) x(c) where c >= n) as invalid from e join reach using (doc_id, pos)),
eg as (select doc_id, grp, bool_and(unchanged) as unchanged, max(pos) - min(pos) + 1 = count(*) as together, bool_or(coalesce(back, false)) as disordered, bool_or(invalid) as invalid, max(pos) as last from ee group by 1, 2),
g as (select doc_id, grp, coalesce(unchanged and together and not disordered and not invalid and whole and not lost and contained and safe, false) as copied, coalesce(children, []) as children, alone, last from eg left join bg using (doc_id, grp))"""


def parts(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("o", "_")).select("doc_id", F.col("o").cast("long").alias("ord"))
    rows = lines.withColumn("n", F.count("*").over(W.partitionBy("doc_id")))
    o, n, doc = F.col("ord"), F.col("n"), F.col("doc_id")
    pos = F.when((o % 41 == 17) & (o + 1 < n), o + 1).when(o % 41 == 18, o - 1).otherwise(o)
    sources = F.when(o % 29 == 28, F.array().cast("array<long>")).when(o % 31 == 30, F.array(o, n + 5)).when(o % 7 == 5, F.array(o - 1, o)).when((o % 11 == 3) & (o + 1 < n), F.array(o, o + 1)).otherwise(F.array(o))
    elements = rows.select("doc_id", pos.alias("pos"), F.concat_ws("-", doc, pos).alias("element_id"), sources.alias("sources"), ((doc + o) % 10 != 1).alias("unchanged"), (o % 19 == 7).alias("is_break"))
    blocks = rows.select("doc_id", o.alias("child"), ((doc * 7 + o) % 23 != 0).alias("contained"), ((doc + o) % 31 != 5).alias("safe"), (o % 3 == 1).alias("drawings"), (1 + (o % 37 == 36).cast("int")).alias("uses"))
    regions = rows.where((o % 53 == 20) & (o + 3 < n)).select("doc_id", o.alias("first"), (o + 3).alias("last"))
    return elements, blocks, regions


def told(column):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), " ")


@query(with_(PARTS) + PLAN.lstrip() + " select doc_id, grp as \"group\", copied, array_to_string(children, ' ') as children, case when not copied and len(alone) > 0 then array_to_string(alone, ' ') end as after, case when not copied and len(alone) > 0 then doc_id || '-' || last end as last_id from g")
def k2_copied_groups(spark, d):
    """Groups of lines and source blocks: which are copied, and which drawings are put behind those written anew."""
    elements, blocks, regions = parts(spark, d)
    groups, _ = copies.copy_plan(elements, blocks, regions, blocks)
    return groups.select("doc_id", "group", "copied", told("children").alias("children"), told("after").alias("after"), "last_id")


@query(with_(PARTS) + PLAN.lstrip() + " select e.doc_id, e.pos, coalesce(copied, false) as copied, case when copied then case when e.pos = reach.grp then array_to_string(children, ' ') else '' end end as write from e left join reach using (doc_id, pos) left join g on g.doc_id = e.doc_id and g.grp = reach.grp")
def k2_copied_elements(spark, d):
    elements, blocks, regions = parts(spark, d)
    _, out = copies.copy_plan(elements, blocks, regions, blocks)
    return out.select("doc_id", "pos", "copied", told("write").alias("write"))


HELD = "case (doc_id + child) % 9 when 0 then 'tracked changes' when 1 then 'text effects' when 2 then 'content controls' when 3 then 'page borders' when 4 then 'empty spacing paragraphs' end"


@query(with_(PARTS) + PLAN.lstrip() + f", x as (select g.doc_id, g.grp, {HELD} as kind from (select doc_id, grp, unnest(children) as child from g where not copied) g where not ((doc_id + child) % 9 in (1, 2) and child % 4 < 2)), y as (select doc_id, grp, kind from x where kind is not null and (kind <> 'tracked changes' or doc_id % 2 = 0)) " + "select doc_id, count(distinct grp) as blocks, array_to_string(list_transform(list_sort(list(distinct case kind when 'tracked changes' then '0' when 'content controls' then '1' when 'empty spacing paragraphs' then '2' when 'text effects' then '3' else '4' end || kind)), lambda k: k[2:]), ', ') as kinds from y group by 1")
def k3_rewritten_losses(spark, d):
    """Half of the effects and controls went back: of two, both or one."""
    elements, blocks, regions = parts(spark, d)
    groups, _ = copies.copy_plan(elements, blocks, regions, blocks)
    k, c = (F.col("doc_id") + F.col("child")) % 9, F.col("child")
    kind = F.when(k == 0, "tracked changes").when(k == 1, "text effects").when(k == 2, "content controls").when(k == 3, "page borders").when(k == 4, "empty spacing paragraphs")
    held = blocks.select("doc_id", "child", kind.alias("kind"), F.lit(2).alias("n")).where("kind is not null")
    back = held.where(kind.isin("text effects", "content controls")).select("doc_id", "child", "kind", F.when(c % 4 < 2, 2).otherwise(1).alias("n"))
    out = copies.rewritten_losses(groups, held, back, F.col("doc_id") % 2 == 0)
    return out.select("doc_id", "blocks", F.array_join("kinds", ", ").alias("kinds"))
