"""Queries of document health, on elements made from the lines of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import health as H
from .catalogue import query
from .relations import ELEMENTS, RUNS, elements, runs, with_

WEIGHTED = "case {0} when 'hierarchy' then 3 when 'fonts' then 3 when 'heading_sizes' then 3 when 'spacing' then 2 when 'direct_formatting' then 2 when 'numbering' then 2 else 1 end"
FILLED = "trim(content, ' ' || chr(9) || chr(10) || chr(13)) <> ''"
BODY = "type in ('paragraph', 'list', 'quote', 'table', 'caption', 'footnote')"
DOC = "all_docs as (select distinct doc_id from elements)"

CHECKS = {
    "hierarchy": """h as (select doc_id, level > lag(level) over (partition by doc_id order by ord) + 1 as gap from elements where type = 'heading'),
        a as (select doc_id, count(*) as heads, count(*) filter (where gap) as gaps from h group by 1),
        b as (select doc_id, sum(case when {BODY} then len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) else 0 end) as words from elements group by 1)
        select doc_id, case when heads > 0 then case when gaps > 0 then 'warn' else 'pass' end when words > 600 then 'fail' when words > 0 then 'pass' else 'skip' end as status, coalesce(gaps, 0) as issues from b left join a using (doc_id)""",
    "fonts": """body as (select * from elements where {BODY} and {FILLED}), f as (select doc_id, element_id, font from body union select r.doc_id, r.element_id, r.font_family from runs r join body b on b.doc_id = r.doc_id and b.element_id = r.element_id where mark = 'textStyle' and font_family is not null and trim(text) <> ''),
        s as (select doc_id, font, count(distinct element_id) as n from f group by 1, 2), p as (select doc_id, count(*) as fonts, sum(n) - max(n) as odd from s group by 1)
        select doc_id, case when fonts is null then 'skip' when fonts = 1 then 'pass' when fonts = 2 then 'warn' else 'fail' end as status, coalesce(odd, 0) as issues from all_docs left join p using (doc_id)""",
    "heading_sizes": """s as (select doc_id, level, size, count(*) as n, min(ord) as first from elements where type = 'heading' and {FILLED} group by 1, 2, 3),
        m as (select doc_id, level, arg_min(size, (-n, first)) as main, count(*) as kinds, sum(n) as heads from s group by 1, 2),
        l as (select *, replace(main, 'pt', '')::double > lag(replace(main, 'pt', '')::double) over (partition by doc_id order by level) as larger from m),
        p as (select doc_id, sum(heads) as heads, count(*) filter (where kinds > 1) as mixed, count(*) filter (where larger) as larger from l group by 1)
        select doc_id, case when coalesce(heads, 0) < 2 then 'skip' when mixed > 0 then 'fail' when larger > 0 then 'warn' else 'pass' end as status, case when heads >= 2 then mixed + larger else 0 end as issues from all_docs left join p using (doc_id)""",
    "spacing": """e as (select doc_id, lh, count(*) as n from elements where type = 'paragraph' and {FILLED} group by 1, 2), p as (select doc_id, sum(n) as total, sum(n) - max(n) as odd from e group by 1),
        g as (select *, sum(case when type = 'paragraph' and not ({FILLED}) then 0 else 1 end) over (partition by doc_id order by ord) as island from elements),
        r as (select doc_id, count(*) as runs from (select doc_id, island from g where type = 'paragraph' and not ({FILLED}) group by 1, 2 having count(*) >= 2) group by 1)
        select doc_id, case when coalesce(total, 0) < 2 then 'skip' when odd = 0 and coalesce(runs, 0) = 0 then 'pass' when odd > total / 4 then 'fail' else 'warn' end as status, case when total >= 2 then odd + coalesce(runs, 0) else 0 end as issues from all_docs left join p using (doc_id) left join r using (doc_id)""",
    "direct_formatting": """m as (select distinct doc_id, element_id from runs where mark = 'textStyle' and trim(text) <> '' and font_family is not null),
        p as (select e.doc_id, count(*) as n, count(*) filter (where own or m.element_id is not null) as hit from elements e left join m on m.doc_id = e.doc_id and m.element_id = e.element_id where {BODY} and {FILLED} group by 1)
        select doc_id, case when n is null then 'skip' when hit > 0.2 * n then 'warn' else 'pass' end as status, coalesce(hit, 0) as issues from all_docs left join p using (doc_id)""",
    "numbering": r"""h as (select doc_id, ord, string_split(regexp_extract(content, '^\s*([0-9]+(?:\.[0-9]+)*)[.)]?\s+\S', 1), '.') as parts from elements where type = 'heading'),
        n as (select doc_id, ord, parts[-1]::bigint as own, array_to_string(list_transform(parts[:-2], lambda x: x::bigint), '.') as parent from h where parts[1] <> ''),
        o as (select *, own <> coalesce(lag(own) over (partition by doc_id, parent order by ord), 0) + 1 as odd from n),
        a as (select doc_id, count(*) as numbered, count(*) filter (where odd) as odds from o group by 1),
        l as (select doc_id, count(*) as lists, count(*) filter (where regexp_matches(content, '^\s*[0-9]+[.)]\s')) as typed from elements where type = 'list' and ordered group by 1)
        select doc_id, case when numbered is null and lists is null then 'skip' when odds > 0 then 'fail' when typed > 0 then 'warn' else 'pass' end as status, coalesce(odds, 0) + coalesce((typed > 0)::int, 0) as issues from all_docs left join a using (doc_id) left join l using (doc_id)""",
    "alignment": """p as (select doc_id, sum(c) as n, sum(c) - max(c) as odd from (select doc_id, coalesce(align, 'left') as side, count(*) as c from elements where type = 'paragraph' and length(trim(content)) > 80 group by 1, 2) group by 1)
        select doc_id, case when coalesce(n, 0) < 2 then 'skip' when odd > 0 then 'warn' else 'pass' end as status, case when n >= 2 then odd else 0 end as issues from all_docs left join p using (doc_id)""",
    "tables": """p as (select doc_id, count(*) as n, count(*) filter (where has_header) as heads, count(*) filter (where own) as own from elements where type = 'table' group by 1)
        select doc_id, case when n is null then 'skip' when (heads > 0 and heads < n) or (own > 0 and n > 1) then 'warn' else 'pass' end as status, coalesce((heads > 0 and heads < n)::int + (own > 0 and n > 1)::int, 0) as issues from all_docs left join p using (doc_id)""",
    "captions": """s as (select *, coalesce(lag(type) over w, '') = 'caption' or coalesce(lead(type) over w, '') = 'caption' as near from elements window w as (partition by doc_id order by ord)),
        p as (select doc_id, count(*) filter (where type in ('image', 'table')) as figures, count(*) filter (where type in ('image', 'table') and not near) as missing, count(*) filter (where type = 'caption') as captions from s group by 1)
        select doc_id, case when figures = 0 then 'skip' when missing = 0 or (captions = 0 and figures = 1) then 'pass' else 'warn' end as status, case when captions = 0 and figures = 1 then 0 else missing end as issues from p""",
    "page_breaks": """s as (select *, count(*) filter (where type <> 'page_break' and ({FILLED} or type in ('image', 'table'))) over (partition by doc_id order by ord) as before, count(*) filter (where type <> 'page_break' and ({FILLED} or type in ('image', 'table'))) over (partition by doc_id) as total from elements),
        b as (select *, before = lag(before) over (partition by doc_id order by ord) as empty from s where type = 'page_break'),
        p as (select doc_id, (count(*) filter (where before = 0 or before = total) > 0)::int + (count(*) filter (where empty) > 0)::int as issues from b group by 1)
        select doc_id, case when issues is null then 'skip' when issues > 0 then 'warn' else 'pass' end as status, coalesce(issues, 0) as issues from all_docs left join p using (doc_id)""",
    "links": """p as (select doc_id, count(*) as n, count(*) filter (where href like 'javascript%') as broken from runs where mark = 'link' group by 1)
        select doc_id, case when n is null then 'skip' when broken > 0 then 'fail' else 'pass' end as status, coalesce(broken, 0) as issues from all_docs left join p using (doc_id)""",
}


def sql_of(name: str) -> str:
    body = CHECKS[name].replace("{BODY}", BODY).replace("{FILLED}", FILLED)
    parts, _, select = body.rpartition(")\n        select ")
    return with_(ELEMENTS, RUNS, DOC, parts + ")") + "select " + select.replace(" as issues", "::bigint as issues").replace("case when heads >= 2 then mixed + larger else 0 end::", "(case when heads >= 2 then mixed + larger else 0 end)::").replace("case when total >= 2 then odd + coalesce(runs, 0) else 0 end::", "(case when total >= 2 then odd + coalesce(runs, 0) else 0 end)::").replace("case when n >= 2 then odd else 0 end::", "(case when n >= 2 then odd else 0 end)::").replace("case when captions = 0 and figures = 1 then 0 else missing end::", "(case when captions = 0 and figures = 1 then 0 else missing end)::")


def plain(df):
    return df.select("doc_id", "status", "issues")


def no_items(spark):
    return spark.createDataFrame([], "doc_id long, element_id string, text string")


def docs_of(e):
    return e.select("doc_id").distinct()


@query(sql_of("hierarchy"))
def h1_structure(spark, d):
    e = elements(spark, d)
    return plain(H.hierarchy(e, docs_of(e)))


@query(sql_of("fonts"))
def h2_fonts(spark, d):
    e = elements(spark, d)
    return plain(H.fonts(e, runs(spark, d), docs_of(e)))


@query(sql_of("heading_sizes"))
def h3_heading_sizes(spark, d):
    e = elements(spark, d)
    return plain(H.heading_sizes(e, docs_of(e)))


@query(sql_of("spacing"))
def h4_spacing(spark, d):
    e = elements(spark, d)
    return plain(H.spacing(e, docs_of(e)))


@query(sql_of("direct_formatting"))
def h5_direct_formatting(spark, d):
    e = elements(spark, d)
    return plain(H.direct_formatting(e, runs(spark, d), docs_of(e)))


NUMBERED = """with n as (select o_custkey as doc_id, o_orderkey as ord, o_orderkey % 4 as own, o_orderkey % 3 as parent from orders),
 l as (select *, own <> coalesce(lag(own) over (partition by doc_id, parent order by ord), 0) + 1 as odd from n)
 select doc_id, case when count(*) filter (where odd) > 0 then 'fail' else 'pass' end as status, count(*) filter (where odd) as issues from l group by 1"""


@query(sql_of("numbering"))
def h6_numbering(spark, d):
    e = elements(spark, d)
    items = e.where("type = 'list'").select("doc_id", "element_id", F.col("content").alias("text"))
    return plain(H.numbering(e, items, docs_of(e)))


@query(NUMBERED)
def h6_typed_numbers(spark, d):
    from ..sources.tables import table

    k = F.col("o_orderkey")
    text = F.concat((k % 3).cast("string"), F.lit("."), (k % 4).cast("string"), F.lit(" Title"))
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), k.cast("string").alias("element_id"), k.alias("ord"), F.lit("heading").alias("type"), F.lit(1).alias("level"), text.alias("content"), F.lit(False).alias("ordered"))
    return plain(H.numbering(e, no_items(spark), docs_of(e)))


@query(sql_of("alignment"))
def h7_alignment(spark, d):
    e = elements(spark, d)
    return plain(H.alignment(e, docs_of(e)))


@query(sql_of("tables"))
def h8_tables(spark, d):
    e = elements(spark, d)
    return plain(H.tables(e, docs_of(e)))


@query(sql_of("captions"))
def h9_captions(spark, d):
    e = elements(spark, d)
    return plain(H.captions(e, docs_of(e)))


@query(sql_of("page_breaks"))
def h10_page_breaks(spark, d):
    e = elements(spark, d)
    return plain(H.page_breaks(e, docs_of(e)))


@query(sql_of("links"))
def h11_links(spark, d):
    e = elements(spark, d)
    return plain(H.links(runs(spark, d), docs_of(e)))


def score_sql() -> str:
    parts = " union all ".join(f"select doc_id, '{n}' as check_, status from ({sql_of(n)})" for n in CHECKS)
    w = WEIGHTED.format("check_")
    return f"with c as ({parts}), s as (select doc_id, round_even(100 * sum(case when status <> 'skip' then {w} * case status when 'pass' then 1.0::double when 'warn' then 0.5::double else 0.0::double end end) / nullif(sum(case when status <> 'skip' then {w} end), 0), 0) as p from c group by 1) select doc_id, coalesce(p, 100)::integer as score, case when coalesce(p, 100) >= 85 then 'good' when coalesce(p, 100) >= 60 then 'fair' else 'poor' end as rating from s"


@query(score_sql())
def a13_health_score(spark, d):
    """All eleven checks; a list element of the corpus is one line, its only item."""
    e = elements(spark, d)
    items = e.where("type = 'list'").select("doc_id", "element_id", F.col("content").alias("text"))
    return H.scores(e, runs(spark, d), items)


@query(score_sql())
def a13_score_of_checks(spark, d):
    """The same from the eleven checks' own rows."""
    e = elements(spark, d)
    items = e.where("type = 'list'").select("doc_id", "element_id", F.col("content").alias("text"))
    return H.score(H.all_checks(e, runs(spark, d), items))
