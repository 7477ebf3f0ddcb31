"""Queries of comparison, numbering, layout, Markdown, Word packages and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import compare as C
from ..operators import layout as L
from ..operators import numbered
from ..sources import docx, markdown
from ..sources.tables import shared_dir, table
from ..streaming import metering as SM
from .catalogue import query
from .metering_queries import BURST
from .relations import ADMITTED, ELEMENTS, elements

BEFORE = "before as (select conv_id as doc_id, conv_id || '-' || turn as element_id, turn as ord, case when role = 'system' then 'heading' else 'paragraph' end as type, case when role = 'system' then 1 end as level, text as content from conversations where (conv_id + turn) % 7 <> 0)"
AFTER = "after as (select conv_id as doc_id, conv_id || '-' || turn as element_id, case when turn % 5 = 1 then turn + 2.5 else turn end as ord, case when role = 'system' or turn % 11 = 3 then 'heading' else 'paragraph' end as type, case when role = 'system' then 1 + turn % 2 when turn % 11 = 3 then 2 end as level, case when turn % 3 = 2 then text || ' more' else text end as content from conversations where (conv_id + turn) % 9 <> 0)"


def versions(spark, d):
    c = table(spark, d, "conversations")
    t = F.col("turn")
    key = F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string")).alias("element_id")
    before = c.where((F.col("conv_id") + t) % 7 != 0).select(F.col("conv_id").alias("doc_id"), key, t.cast("double").alias("ord"), F.when(F.col("role") == "system", "heading").otherwise("paragraph").alias("type"), F.when(F.col("role") == "system", 1).alias("level"), F.col("text").alias("content"))
    after = c.where((F.col("conv_id") + t) % 9 != 0).select(
        F.col("conv_id").alias("doc_id"), key, F.when(t % 5 == 1, t + 2.5).otherwise(t.cast("double")).alias("ord"), F.when((F.col("role") == "system") | (t % 11 == 3), "heading").otherwise("paragraph").alias("type"),
        F.when(F.col("role") == "system", (1 + t % 2).cast("int")).when(t % 11 == 3, 2).alias("level"), F.when(t % 3 == 2, F.concat("text", F.lit(" more"))).otherwise(F.col("text")).alias("content"),
    )
    return before, after


@query("with " + BEFORE + ", " + AFTER + " select coalesce(b.doc_id, a.doc_id) as doc_id, coalesce(b.element_id, a.element_id) as element_id, case when b.doc_id is null then 'added' when a.doc_id is null then 'removed' when b.type <> a.type or (a.type = 'heading' and b.level is distinct from a.level) then 'retyped' else 'edited' end as change, b.type as before_type, a.type as after_type from before b full join after a on a.doc_id = b.doc_id and a.element_id = b.element_id where b.doc_id is null or a.doc_id is null or b.type <> a.type or (a.type = 'heading' and b.level is distinct from a.level) or b.content <> a.content")
def j13_version_diff(spark, d):
    return C.element_changes(*versions(spark, d)).select("doc_id", "element_id", "change", "before_type", "after_type")


@query()
def w15_moved_elements(spark, d):
    return C.moved_elements(*versions(spark, d))


@query()
def v10_document_comparison(spark, d):
    before, after = versions(spark, d)
    return C.element_changes(before, after, C.moved_elements(before, after)).groupBy("doc_id", "change").agg(F.count("*").alias("n"))


@query("with " + BEFORE + ", " + AFTER + " select coalesce(b.doc_id, a.doc_id) as doc_id, coalesce(b.element_id, a.element_id) as element_id, case when b.doc_id is null then 'added' when a.doc_id is null then 'removed' else 'changed' end as change from before b full join after a on a.doc_id = b.doc_id and a.element_id = b.element_id where b.doc_id is null or a.doc_id is null or (b.type, coalesce(b.level, -1), b.content) <> (a.type, coalesce(a.level, -1), a.content)")
def m11_content_delta(spark, d):
    before, after = versions(spark, d)
    return C.content_delta(before, after)


@query("with s as (select conv_id as doc_id, turn, text from conversations), k as (select doc_id, [turn * 10] as place, doc_id || '-' || turn as element_id, case when turn % 4 = 2 then 'changed' else text end as content from s where turn % 5 <> 3 union all select doc_id, [turn * 10, 1], doc_id || '-' || turn || 'n', 'new' from s where turn % 5 = 1 union all select doc_id, [turn * 10, 2], doc_id || '-' || turn || 'nn', 'newer' from s where turn % 5 = 1 union all select distinct doc_id, [-1], doc_id || '-first', 'first' from s) select doc_id, element_id, row_number() over (partition by doc_id order by place) - 1 as ord, content from k")
def m10_patched_document(spark, d):
    c = table(spark, d, "conversations")
    t, doc = F.col("turn"), F.col("conv_id").alias("doc_id")
    name = F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    stored = c.select(doc, name.alias("element_id"), t.alias("ord"), F.col("text").alias("content"))
    changed = c.where((t % 4 == 2) & (t % 5 != 3)).select(doc, name.alias("element_id"), F.lit("changed").alias("content"))
    a = c.where(t % 5 == 1)
    added = a.select(doc, F.concat(name, F.lit("n")).alias("element_id"), name.alias("after_id"), F.lit("new").alias("content"))
    added = added.unionByName(a.select(doc, F.concat(name, F.lit("nn")).alias("element_id"), F.concat(name, F.lit("n")).alias("after_id"), F.lit("newer").alias("content")))
    added = added.unionByName(c.select(doc, F.concat(F.col("conv_id").cast("string"), F.lit("-first")).alias("element_id"), F.lit(None).cast("string").alias("after_id"), F.lit("first").alias("content")).distinct())
    return C.patched(stored, changed, added, c.where(t % 5 == 3).select(doc, name.alias("element_id"))).select("doc_id", "element_id", F.col("ord").cast("long").alias("ord"), "content")


@query("select l_orderkey as doc_id, css, max(b) as before, max(a) as after from (select l_orderkey, 'font-size' as css, min(l_quantity)::integer || 'pt' as b, max(l_quantity)::integer || 'pt' as a from lineitem group by 1 union all select l_orderkey, 'line-height', null, '2' from lineitem where l_orderkey % 3 = 0 group by 1) group by 1, 2 having max(b) is distinct from max(a)")
def j14_style_changes(spark, d):
    q = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.min("l_quantity").cast("int").alias("lo"), F.max("l_quantity").cast("int").alias("hi"))
    size = lambda c: q.select("doc_id", F.lit("font-size").alias("css"), F.concat(F.col(c).cast("string"), F.lit("pt")).alias("value"))
    spaced = q.where("doc_id % 3 = 1")
    line = lambda rows, v: rows.select("doc_id", F.lit("line-height").alias("css"), F.lit(v).alias("value"))
    ls = spaced.select("doc_id", F.lit("--line-spacing").alias("css"), F.lit("1").alias("value"))
    before = size("lo").unionByName(line(spaced, "1.15")).unionByName(ls)
    after = size("hi").unionByName(line(spaced, "9.99")).unionByName(ls).unionByName(line(q.where("doc_id % 3 = 0"), "2"))
    return C.style_changes(before, after, keys=["doc_id"])


@query("select c_custkey as doc_id, p as property, b as before, a as after from (select c_custkey, 'orientation' as p, case when c_custkey % 2 = 0 then 'portrait' else 'landscape' end as b, 'portrait' as a from customer union all select c_custkey, 'header', null, case when c_custkey % 3 = 0 then c_mktsegment end from customer) where a is distinct from b")
def d23_setting_changes(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "doc_id")
    before = c.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "portrait").otherwise("landscape").alias("orientation"), F.lit(None).cast("string").alias("header"))
    after = c.select("doc_id", F.lit("portrait").alias("orientation"), F.when(F.col("doc_id") % 3 == 0, F.col("c_mktsegment")).alias("header"))
    return C.setting_changes(before, after, key="doc_id", fields=["orientation", "header"])


def pairs(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("source"), F.when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" and 17 more"))).when(F.col("turn") % 3 == 2, F.regexp_replace("text", r"^\w+ ", "")).otherwise(F.col("text")).alias("result"))


PAIRS = "pairs as (select conv_id, turn, text as source, case turn % 3 when 1 then text || ' and 17 more' when 2 then regexp_replace(text, '^\\w+ ', '') else text end as result from conversations)"
WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\p{{Nl}}\p{{No}}]+')"


@query("with " + PAIRS + f", w as (select conv_id, turn, {WORDS.format('source')} as a, {WORDS.format('result')} as b from pairs) select conv_id, turn, len(a)::bigint as source_words, len(b)::bigint as result_words, a = b as verified from w")
def v1_verified_pairs(spark, d):
    out = C.compare_words(pairs(spark, d), keys=["conv_id", "turn"], source="source", result="result")
    return out.select("conv_id", "turn", "source_words", "result_words", "verified")


NUMBERS = r"list_filter(regexp_extract_all({0}, '[-+]?\p{{Nd}}+(?:[.,:/-]\p{{Nd}}+)*%?|[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+'), lambda t: regexp_matches(t, '\p{{Nd}}'))"
FACTS = f"""n as (select conv_id, turn, {NUMBERS.format('source')} as a, {NUMBERS.format('result')} as b from pairs),
a as (select conv_id, turn, x, row_number() over (partition by conv_id, turn, x) as k from (select conv_id, turn, unnest(a) as x from n)), b as (select conv_id, turn, x, row_number() over (partition by conv_id, turn, x) as k from (select conv_id, turn, unnest(b) as x from n)),
lost as (select conv_id, turn, list(x order by x) as missing from a anti join b using (conv_id, turn, x, k) group by 1, 2), come as (select conv_id, turn, list(x order by x) as added from b anti join a using (conv_id, turn, x, k) group by 1, 2)"""


@query("with " + PAIRS + ", " + FACTS + " select conv_id, turn, coalesce(missing, []) as missing, coalesce(added, []) as added from n left join lost using (conv_id, turn) left join come using (conv_id, turn)")
def o12_changed_numbers(spark, d):
    return C.changed_numbers(pairs(spark, d), keys=["conv_id", "turn"], source="source", result="result")


@query("select conv_id, turn::integer as ord, row_number() over (partition by conv_id order by turn)::integer as number from conversations")
def w10_list_numbers(spark, d):
    items = table(spark, d, "conversations").select("conv_id", F.col("turn").cast("int").alias("ord"), F.lit(0).alias("level"))
    return numbered.counted(items, key="conv_id").select("conv_id", "ord", F.get("values", F.lit(0)).alias("number"))


HEADS = "h as (select c.*, turn % 2 as level from conversations c), n as (select conv_id, turn, level, count(*) filter (where level = 0) over (partition by conv_id order by turn) as a from h)"


@query("with " + HEADS + " select conv_id, turn::integer as ord, case when level = 0 then a::varchar || '.' else a::varchar || '.' || chr((96 + sum(level) over (partition by conv_id, a order by turn))::integer) || ')' end as label from n")
def w9_heading_labels(spark, d):
    items = table(spark, d, "conversations").select("conv_id", F.col("turn").cast("int").alias("ord"), (F.col("turn") % 2).cast("int").alias("level"))
    return numbered.labelled(items, key="conv_id", pattern="%1.|%2)", formats=["decimal", "lowerLetter"]).select("conv_id", "ord", "label")


#: Units one after another: each is placed by where the one before it has ended.
PAGED = """, u as (select doc_id, ord, item, height, brk, row_number() over (partition by doc_id order by ord, item nulls first) as k from (
 select doc_id, ord, null::int as item, length(content) / 8.0::double as height, case when type = 'page_break' and ord % 2 = 1 then 'odd' when type = 'page_break' then 'any' end as brk from elements where type <> 'list'
 union all select doc_id, ord, item, length(content) / 16.0::double, null from elements, range(2) t(item) where type = 'list')),
p as (select doc_id, ord, item, k, 1 as page, 5.0::double as y, height, brk from u where k = 1
 union all select doc_id, ord, item, k, case when pending is not null then at_page + 1 + case when pending = 'odd' and (at_page + 1) % 2 = 0 then 1 else 0 end when yy < 5 then at_page when yy >= 65 or (yy > 5 and yy + height > 65 and height <= 60) then at_page + 1 else at_page end,
 case when pending is not null or yy < 5 or yy >= 65 or (yy > 5 and yy + height > 65 and height <= 60) then 5.0::double else yy end, height, brk
 from (select u.*, p.brk as pending, p.page + case when p.y + p.height > 75 then ceil((p.y + p.height) / 75)::int - 1 else 0 end as at_page, p.y + p.height - 75 * case when p.y + p.height > 75 then ceil((p.y + p.height) / 75)::int - 1 else 0 end as yy from p join u on u.doc_id = p.doc_id and u.k = p.k + 1) s)"""


@query("with recursive " + ELEMENTS + PAGED + " select doc_id, ord, item, page, y - 5 as top from p")
def l1_pages(spark, d):
    """Lines as blocks, list items in halves; page breaks, every other one to an odd page; margins of 5 above and 10 below."""
    e = elements(spark, d)
    high = F.length("content") / 8.0
    start = F.when((F.col("type") == "page_break") & (F.col("ord") % 2 == 1), "oddPage").otherwise("nextPage")
    blocks = e.select("doc_id", "ord", F.when(F.col("type") == "page_break", "section_break").otherwise(F.col("type")).alias("type"), high.alias("height"), start.alias("start"))
    items = e.select("doc_id", "ord", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("item"), (high / 2).alias("height"))
    return L.paginate(L.layout_units(blocks, items), key="doc_id", height=60.0, top=5.0, bottom=10.0, order=("ord", "item"))


@query()
def l4_row_heights(spark, d):
    """Tables of an order's lines: exact, least and free rows, and cells over two or three of them."""
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    i = table(spark, d, "lineitem").select("l_orderkey", (F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) - 1).alias("row"), n, p, "l_quantity")
    rows = i.select("l_orderkey", "row", F.when(p % 3 > 0, p % 40 + 0.5).alias("height"), F.when(p % 3 == 1, "exact").otherwise("atLeast").alias("rule"))
    cells = i.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(1)))).select("l_orderkey", "row", "col", F.when(F.col("col") == 1, 1 + p % 3).otherwise(1).alias("rowspan"), (F.col("l_quantity") * (1 + F.col("col"))).alias("need"))
    return L.row_heights(rows, cells, key="l_orderkey").withColumn("height", F.round("height", 6))


@query("""with s as (select o_custkey as doc_id, o_orderkey as page, case when o_orderkey % 5 = 0 then 1 end as start, o_orderkey % 3 = 0 as is_start from orders),
 m as (select *, sum(is_start::int) over w as n, last_value(case when is_start and start is not null then page end ignore nulls) over w as first from s window w as (partition by doc_id order by page rows between unbounded preceding and current row))
 select doc_id, page, case when n > 0 then n end::bigint as section, coalesce(1 + page - first, page)::integer as number from m""")
def j20_page_sections(spark, d):
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"))
    s = p.where("page % 3 = 0").select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("page")).cast("long").alias("section"), F.col("page").alias("first_page"), F.when(F.col("page") % 5 == 0, 1).alias("start"), F.lit("decimal").alias("format"))
    return L.page_numbers(p, s).select("doc_id", "page", "section", "number")


@query("select o_custkey as doc_id, o_orderkey as section, last_value(case when o_orderkey % 4 = 0 then o_orderpriority end ignore nulls) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and current row) as header from orders")
def w18_inherited_headers(spark, d):
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("section"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).alias("header"))
    return L.inherited(s, ["header"])


@query("select o_orderkey as page, case when o_custkey % 2 = 0 and o_orderkey = 1 then 'first' when o_custkey % 3 = 0 and o_orderkey % 2 = 0 then 'even' else 'main' end as header from orders")
def w20_running_headers(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("page"), L.running_key(F.col("o_orderkey"), F.lit(1), F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 3 == 0).alias("header"))


@query("select o_custkey as doc_id, o_orderkey as ord, lead(case when o_orderkey % 2 = 0 then 'evenPage' else 'nextPage' end) over (partition by o_custkey order by o_orderkey) as next_start from orders")
def w17_next_section_start(spark, d):
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.lit("section_break").alias("type"), F.when(F.col("o_orderkey") % 2 == 0, "evenPage").otherwise("nextPage").alias("start"))
    return L.section_starts(e).select("doc_id", "ord", "next_start")


GRID = """with recursive c as (select l_orderkey, row_number() over w - 1 as k, (1 + l_partkey % 2)::integer as wide, (1 + l_suppkey % 3)::integer as high from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)),
n as (select l_orderkey, (k // 2)::integer as row, (k % 2)::integer as col, wide, high from c), rows as (select l_orderkey, row, max(case when col = 0 then wide end) as w0, max(case when col = 0 then high end) as h0, max(case when col = 1 then wide end) as w1, max(case when col = 1 then high end) as h1 from n group by 1, 2),
f as (select l_orderkey, -1 as row, [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0] as until, null::integer as a, null::integer as b from (select distinct l_orderkey from n)
 union all select l_orderkey, row, case when w1 is null then u0 else list_transform(range(0, 16), lambda i: case when i >= b and i < b + w1 then greatest(u0[i + 1], row + h1) else u0[i + 1] end) end, a, b from (
  select *, case when w1 is not null then list_min(list_filter(range(0, 16), lambda i: i >= a + w0 and until[i + 1] <= row))::integer end as b, list_transform(range(0, 16), lambda i: case when i >= a and i < a + w0 then greatest(until[i + 1], row + h0) else until[i + 1] end) as u0 from (
   select f.l_orderkey, rows.row, f.until, w0, h0, w1, h1, list_min(list_filter(range(0, 16), lambda i: f.until[i + 1] <= rows.row))::integer as a from f join rows on rows.l_orderkey = f.l_orderkey and rows.row = f.row + 1)))"""


@query(GRID + " select l_orderkey, row, 0 as col, a as grid_col from f where row >= 0 union all select l_orderkey, row, 1, b from f where row >= 0 and b is not null")
def l3_table_grid(spark, d):
    """Tables of two cells a row, one or two columns wide and up to three rows high."""
    k = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    cells = table(spark, d, "lineitem").select("l_orderkey", k.alias("k"), (1 + F.col("l_partkey") % 2).cast("int").alias("colspan"), (1 + F.col("l_suppkey") % 3).cast("int").alias("rowspan"))
    cells = cells.select("l_orderkey", F.floor(F.col("k") / 2).cast("int").alias("row"), (F.col("k") % 2).cast("int").alias("col"), "colspan", "rowspan")
    return L.grid(cells, key=["l_orderkey"]).select("l_orderkey", "row", "col", "grid_col")


@query("select l_orderkey, l_linenumber, l_partkey, round(l_quantity * least(100, 450) / sum(l_quantity) over (partition by l_orderkey), 6) as width from lineitem")
def l4_column_widths(spark, d):
    c = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("width"))
    return L.column_widths(c, key="l_orderkey", room=F.lit(450.0), target=F.lit(100.0)).withColumn("width", F.round("width", 6))


@query("select o_custkey as doc_id, o_orderkey as ord, case when c and coalesce(lag(c) over w, false) then 0.0 else 6.0 end::double as space_before, case when c and coalesce(lead(c) over w, false) then 0.0 else 8.0 end::double as space_after from (select *, o_orderkey % 3 <> 0 as c from orders) window w as (partition by o_custkey order by o_orderkey)")
def l5_contextual_spacing(spark, d):
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 3 != 0).alias("contextual"), F.lit(6.0).alias("space_before"), F.lit(8.0).alias("space_after"))
    return L.closed_up(p).drop("contextual")


@query(r"select doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))) as lines, true as has_title, coalesce(list_sum(list_transform(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '\s', '', 'g')))), 0)::bigint as chars from documents where text is not null")
def s10_markdown_plain(spark, d):
    """Every text with its marks behind backslashes: each line comes back as a paragraph with all its characters."""
    escaped = F.regexp_replace("text", r"([!-/:-@\[-`{-~])", r"\\$1")
    docs = table(spark, d, "documents").where("text is not null")
    md = docs.select("doc_id", F.concat(F.lit("# Title\n\n"), F.replace(escaped, F.lit("\n"), F.lit("\n\n"))).alias("md"))
    out = markdown.elements(md, doc="doc_id", text="md")
    chars = F.sum(F.when(F.col("ord") > 0, F.length(F.regexp_replace("content", r"\s", ""))).otherwise(0))
    return out.groupBy("doc_id").agg((F.count("*") - 1).alias("lines"), (F.min_by("type", "ord") == "heading").alias("has_title"), chars.alias("chars"))


@query()
def s10_markdown_elements(spark, d):
    out = markdown.elements(table(spark, d, "documents").select("doc_id", "text"), doc="doc_id", text="text")
    return out.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("items"), F.sum(F.size("cells")).alias("cells"))


@query("select conv_id, count(*) as elements, true as same from conversations where trim(text) <> '' group by 1")
def k1_word_round_trip(spark, d):
    """Every fifth turn is a table of four cells: contents and cells come back as they were."""
    t = F.col("turn").cast("int")
    kind = F.when(t % 5 == 4, "table").when(F.col("role") == "system", "heading").otherwise("paragraph")

    def cell(row, col, wide, high, text):
        return F.struct(*(F.lit(x).alias(n) for x, n in ((row, "row"), (col, "col"), (wide, "colspan"), (high, "rowspan"))), text.alias("text"))

    cells = F.when(kind == "table", F.array(cell(0, 0, 1, 1, F.col("text")), cell(0, 1, 1, 2, F.lit("x")), cell(1, 0, 1, 1, F.lit("low")), cell(2, 0, 2, 1, F.lit("wide")))).otherwise(F.array().cast(docx.CELLS))
    content = F.when(kind == "table", F.concat("text", F.lit("\tx\nlow\nwide"))).otherwise(F.col("text"))
    rows = table(spark, d, "conversations").where("trim(text) != ''").select("conv_id", t.alias("ord"), kind.alias("type"), F.lit(1).alias("level"), content.alias("content"), cells.alias("cells"))
    back = docx.elements(docx.packages(rows, key="conv_id").select(F.col("conv_id").cast("string").alias("key"), "content"))
    told = F.struct("ord", F.struct("type", "content", "cells").alias("e"))
    own = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(told)).alias("a"))
    read = back.groupBy(F.col("key").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(told)).alias("b"))
    both = own.join(read, "conv_id")
    return both.select("conv_id", F.size("b").cast("long").alias("elements"), (F.transform("a", lambda x: x["e"]) == F.transform("b", lambda x: x["e"])).alias("same"))


def streamed(spark, d, make, mode, *, batches=3):
    """Runs a stream over the events in the session's shared folder, a batch for each stretch of time as it comes in, and reads what it wrote.

    A stretch is a range of `ts`, so of the table's files those outside it are not read; it is written by as many tasks as
    it takes, and the stream goes on from its checkpoint once it is there.
    """
    base = f"{shared_dir(spark)}/quire/stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    low, high = events.select(F.min("ts"), F.max("ts")).first()
    edges = [low + (high - low) * k / batches for k in range(1, batches)] if low is not None else []
    for k in range(batches):
        ts = F.col("ts")
        own = (ts >= edges[k - 1] if 0 < k <= len(edges) else F.lit(True)) & (ts < edges[k] if k < len(edges) else F.lit(True))
        events.where(own).write.mode("append").parquet(f"{base}/events")
        out = make(SM.event_stream(spark, f"{base}/events", schema=events.schema, per_trigger=1_000_000))
        SM.drained(out, f"{base}/out", mode=mode, checkpoint=f"{base}/state")
    return spark.read.schema(out.schema).option("recursiveFileLookup", True).parquet(f"{base}/out")


@query("select date_trunc('month', ts)::timestamp as month, user_id, event_type, count(*) as quantity from events group by all")
def e4_streamed_monthly_usage(spark, d):
    got = streamed(spark, d, lambda e: SM.monthly_usage(e, workspace="user_id", metric="event_type"), "update")
    return got.groupBy(F.col("month").cast("timestamp_ntz").alias("month"), "user_id", "event_type").agg(F.max("quantity").alias("quantity"))


@query("with r as (select event_id, user_id, floor(epoch_us(ts) / 1000000 / 86400)::bigint as w, row_number() over (partition by user_id, floor(epoch_us(ts) / 1000000 / 86400) order by ts, event_id) as nth from events) select user_id, event_id, w as window_id, nth from r where nth > 3")
def e1_streamed_refusals(spark, d):
    return streamed(spark, d, lambda e: SM.refusals(e, key="user_id", limit=3, seconds=86400), "append").select("user_id", "event_id", F.col("window").alias("window_id"), "nth")


@query(ADMITTED.format(own="*", order="ts, id").replace("recursive ", "recursive asked as (select user_id as workspace, event_id as id, ts, 1 + event_id % 3 as n, user_id % 3 as held, case when user_id % 9 <> 0 then 6 end as lim from events), "))
def e7_streamed_admissions(spark, d):
    """Requests as they come, decided by keyed state that begins with what customers' workspaces hold."""
    SM.keyed_state(spark)
    held = table(spark, d, "events").select("user_id").distinct().withColumn("n", F.col("user_id") % 3)

    def make(e):
        u, i = F.col("user_id"), F.col("event_id")
        return SM.admissions(e.select("user_id", "ts", "event_id", (1 + i % 3).alias("n"), F.when(u % 9 != 0, 6).alias("most")), held, workspace="user_id", order=["ts", "event_id"])

    return streamed(spark, d, make, "append").select(F.col("event_id").alias("id"), "ok")


@query(BURST + "select user_id, step, kind, started, saves from folded")
def e5_streamed_history(spark, d):
    def make(e):
        kind = F.when(F.col("event_type").isin("view", "click"), "content").otherwise("format")
        return SM.burst_history(e.withColumn("kind", kind), doc="user_id", seconds=3600)

    got = streamed(spark, d, make, "update")
    return got.groupBy("user_id", "step").agg(F.max_by("kind", "saves").alias("kind"), F.min(F.col("started").cast("timestamp_ntz")).alias("started"), F.max("saves").alias("saves"))
