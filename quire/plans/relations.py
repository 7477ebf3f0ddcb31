"""The relations of the document store, made from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

#: Customers as users, their nations as workspaces, orders as documents.
MEMBERS = "members as (select c_custkey as user_id, c_nationkey as workspace_id, case when c_custkey % 7 = 0 then 'owner' else 'member' end as role from customer)"
DOCS = """docs as (select o_orderkey as id, c_nationkey as workspace_id, o_custkey as created_by, 'Order ' || o_orderstatus || '_' || o_orderpriority as title,
    o_orderdate as created_at, o_orderdate + to_days(cast(o_orderkey % 30 as integer)) as updated_at,
    case when o_orderkey % 3 = 0 then o_orderdate end as formatted_at, case when o_orderkey % 4 <> 0 then 'upload' end as source, cast(o_orderkey % 60 as bigint) as template_id
    from orders join customer on o_custkey = c_custkey)"""
TEMPLATES = """templates as (select cast(p_partkey as bigint) as id, p_partkey % 25 as workspace_id, p_partkey % 100 as created_by, p_name as name,
    case when p_size % 2 = 0 then 'workspace' else 'private' end as visibility, p_size as created_at from part)"""
#: Elements are lines of documents; their kinds go by position.
ELEMENTS = """lines as (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ord from documents where text is not null),
elements as (select doc_id, doc_id || '-' || ord as element_id, cast(ord as integer) as ord,
    case when ord % 19 = 7 then 'page_break' when ord % 11 = 3 then 'heading' when ord % 13 = 5 then 'table' when ord % 13 = 6 then 'caption' when ord % 17 = 9 then 'image' when ord % 7 = 5 then 'list' else 'paragraph' end as type,
    cast(case when ord % 19 <> 7 and ord % 11 = 3 then 1 + (ord // 11) % 4 end as integer) as level,
    case when ord % 19 = 7 or ord % 23 in (10, 11) then '' else content end as content,
    case when (doc_id + ord) % 29 = 4 then 'Georgia' else 'Arial' end as font, case when ord % 11 = 3 then cast(20 - 2 * ((ord // 11) % 5) as varchar) || 'pt' else '11pt' end as size,
    case when (doc_id + ord) % 31 = 5 then '2' else '1.15' end as lh, case when ord % 37 = 20 then 'right' when doc_id % 3 = 0 then 'justify' end as align,
    (doc_id + ord) % 10 = 1 as own, ord % 2 = 1 as ordered, ord % 26 = 5 as has_header from lines)"""
RUNS = """runs as (select doc_id, element_id, content as text, case when ord % 4 = 1 then 'link' else 'textStyle' end as mark,
    case when ord % 4 = 1 then case when ord % 8 = 1 then 'https://example.org/' || ord when doc_id % 5 = 0 then 'javascript:void(0)' else 'www.example.com' end end as href,
    case when ord % 4 = 3 then 'Verdana' end as font_family from elements where ord % 2 = 1)"""

#: Requests in order, each decided by what those before it of its workspace have used.
ADMITTED = "with recursive r as (select {own}, row_number() over (partition by workspace order by {order}) as k from asked), s as (select *, case when lim is null or held + n <= lim then held + n else held end as used, lim is null or held + n <= lim as ok from r where k = 1 union all select r.*, case when r.lim is null or s.used + r.n <= r.lim then s.used + r.n else s.used end, r.lim is null or s.used + r.n <= r.lim from r join s on r.workspace = s.workspace and r.k = s.k + 1) select id, ok from s"


def with_(*parts: str) -> str:
    return "with " + ", ".join(parts) + " "


def members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("workspace_id"), F.when(F.col("c_custkey") % 7 == 0, "owner").otherwise("member").alias("role"))


def docs(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    key = F.col("o_orderkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("id"), F.col("c_nationkey").alias("workspace_id"), F.col("o_custkey").alias("created_by"),
        F.concat(F.lit("Order "), "o_orderstatus", F.lit("_"), "o_orderpriority").alias("title"), F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.make_dt_interval((key % 30).cast("int"))).alias("updated_at"), F.when(key % 3 == 0, F.col("o_orderdate")).alias("formatted_at"),
        F.when(key % 4 != 0, "upload").alias("source"), (key % 60).alias("template_id"),
    )


def templates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), (k % 25).alias("workspace_id"), (k % 100).alias("created_by"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "workspace").otherwise("private").alias("visibility"), F.col("p_size").alias("created_at"))


def elements(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "content"))
    o, both = F.col("ord"), F.col("doc_id") + F.col("ord")
    kind = F.when(o % 19 == 7, "page_break").when(o % 11 == 3, "heading").when(o % 13 == 5, "table").when(o % 13 == 6, "caption").when(o % 17 == 9, "image").when(o % 7 == 5, "list").otherwise("paragraph")
    nth = F.floor(o / 11)
    made = rows.select(
        "doc_id", F.concat_ws("-", F.col("doc_id").cast("string"), o.cast("string")).alias("element_id"), o.alias("ord"), kind.alias("type"),
        F.when((o % 19 != 7) & (o % 11 == 3), 1 + nth % 4).cast("int").alias("level"), F.when((o % 19 == 7) | (o % 23).isin(10, 11), "").otherwise(F.col("content")).alias("content"),
        F.when(both % 29 == 4, "Georgia").otherwise("Arial").alias("font"), F.when(o % 11 == 3, F.concat((20 - 2 * (nth % 5)).cast("int").cast("string"), F.lit("pt"))).otherwise("11pt").alias("size"),
        F.when(both % 31 == 5, "2").otherwise("1.15").alias("lh"), F.when(o % 37 == 20, "right").when(F.col("doc_id") % 3 == 0, "justify").alias("align"),
        (both % 10 == 1).alias("own"), (o % 2 == 1).alias("ordered"), (o % 26 == 5).alias("has_header"),
    )
    css = F.map_filter(F.create_map(F.lit("font-family"), "font", F.lit("font-size"), "size", F.lit("line-height"), "lh", F.lit("margin-bottom"), F.lit("8pt"), F.lit("text-align"), "align"), lambda k, v: v.isNotNull())
    return made.withColumns({"css": css, "style_ref": F.when(F.col("own"), F.col("element_id")).otherwise("Paragraph")})


def runs(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("ord")
    href = F.when(o % 8 == 1, F.concat(F.lit("https://example.org/"), o.cast("string"))).when(F.col("doc_id") % 5 == 0, "javascript:void(0)").otherwise("www.example.com")
    return elements(spark, d).where(o % 2 == 1).select(
        "doc_id", "element_id", F.col("content").alias("text"), F.when(o % 4 == 1, "link").otherwise("textStyle").alias("mark"), F.when(o % 4 == 1, href).alias("href"),
        F.when(o % 4 == 3, "Verdana").alias("font_family"), F.lit(None).cast("double").alias("font_size_pt"), F.lit(None).cast("string").alias("color"),
    )
