"""Queries of changes offered, patched and admitted, and of style systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog as C_
from ..operators import edits as E
from ..operators import history as Y
from ..operators import layout as L
from ..operators import metering as M
from ..operators import rules as R
from ..operators import styles as S
from ..operators import tree as T_
from ..sources.tables import table
from .catalogue import query
from .document_queries import AFTER, BEFORE, versions
from .relations import ADMITTED, ELEMENTS, elements, with_
from .rule_queries import CLEAN, RULES, TARGET_SQL, rules
from .text_queries import MARKDOWN_SQL
from .text_queries import WORDS as WORDS_SQL

STYLES = """styles as (select p_partkey as style, s as section, f as field, v as value from (
    select p_partkey, 'paragraph' as s, 'fontSizePt' as f, p_size || '.50' as v from part union all select p_partkey, 'document', 'fontFamily', 'Georgia' from part where p_partkey % 2 = 0
    union all select p_partkey, 'document', 'color', '#111' from part where p_partkey % 3 = 0 union all select p_partkey, 'code', 'fontFamily', 'Courier' from part where p_partkey % 4 = 0
    union all select p_partkey, 'lists', 'color', 'red' from part where p_partkey % 5 = 0 union all select p_partkey, 'page', 'marginTopCm', '2.50' from part union all select p_partkey, 'nowhere', 'x', '1' from part))"""
TARGETS = "targets as (select unnest(['Paragraph', 'Heading 1', 'Heading 2', 'Heading 3', 'Heading 4', 'Heading 5', 'Heading 6', 'List', 'Table', 'Caption', 'Quote', 'Footnote', 'CodeBlock']) as target)"


def style_rows(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")

    def row(rows, section, field, value):
        return rows.select(k.alias("style"), F.lit(section).alias("section"), F.lit(field).alias("field"), value.alias("value"))

    out = row(p, "paragraph", "fontSizePt", F.concat(F.col("p_size").cast("string"), F.lit(".50")))
    for rows, section, field, value in ((p.where(k % 2 == 0), "document", "fontFamily", "Georgia"), (p.where(k % 3 == 0), "document", "color", "#111"), (p.where(k % 4 == 0), "code", "fontFamily", "Courier"), (p.where(k % 5 == 0), "lists", "color", "red"), (p, "page", "marginTopCm", "2.50"), (p, "nowhere", "x", "1")):
        out = out.unionByName(row(rows, section, field, F.lit(value)))
    return out


@query(with_(STYLES, TARGETS) + """select style, 'Paragraph' as target, 'fontSize' as property, rtrim(rtrim(value, '0'), '.') as value, 'pt' as unit from styles where field = 'fontSizePt' union all select style, 'Document', 'marginTop', '2.5', 'cm' from styles where field = 'marginTopCm'
 union all select style, target, 'fontFamily', value, null from styles, targets where section = 'document' and field = 'fontFamily' and target <> 'CodeBlock' union all select style, 'CodeBlock', 'fontFamily', value, null from styles where section = 'code'
 union all select s.style, target, 'color', case when target = 'List' and l.style is not null then 'red' else value end, null from styles s join targets on s.section = 'document' and s.field = 'color' left join (select style from styles where section = 'lists') l on l.style = s.style
 union all select style, 'List', 'color', 'red', null from styles l where section = 'lists' and not exists (select 1 from styles s where s.style = l.style and s.section = 'document' and s.field = 'color')""")
def d22_compiled_rules(spark, d):
    out = S.compiled(style_rows(spark, d), ["style"], priority=R.CUSTOM_TEMPLATE, source="template")
    return out.select("style", "target", "property", "value", "unit")


@query(with_(STYLES) + """select style, max(case when target = 'Paragraph' and css = 'font-size' then value end) as size, max(case when target = 'CodeBlock' and css = 'font-family' then value end) as code from (
 select style, 'Paragraph' as target, 'font-size' as css, rtrim(rtrim(value, '0'), '.') || 'pt' as value from styles where field = 'fontSizePt' union all select style, 'CodeBlock', 'font-family', case when style % 4 = 0 then 'Courier' else 'Courier New' end from styles where field = 'fontSizePt') group by 1""")
def m23_template_previews(spark, d):
    look = S.preview(style_rows(spark, d), ["style"])
    pick = lambda t, c: F.max(F.when((F.col("target") == t) & (F.col("css") == c), F.col("value")))
    return look.groupBy("style").agg(pick("Paragraph", "font-size").alias("size"), pick("CodeBlock", "font-family").alias("code"))


RAW_BEST = "best as (select * from (select *, row_number() over (partition by doc_id, target, property order by priority, seq) as n from rules) where n = 1)"


@query(with_(RULES, RAW_BEST) + """select doc_id, target, property, case property when 'fontSize' then 'fontSizePt' when 'indentLeft' then 'indentLeftCm' else property end as field,
 case when property = 'color' and value = 'plaid' then null when property = 'indentLeft' and value::double > 20 then null when property = 'bold' then case value when 'true' then 'true' else 'false' end else value end as value,
 case when (property = 'color' and value = 'plaid') or (property = 'indentLeft' and value::double > 20) then target || ': ''' || property || ''' = ''' || value || '''' || coalesce(' ' || unit, '') || ' skipped' end as note from best""")
def m23_template_fields(spark, d):
    return S.from_rules(rules(spark, d), ["doc_id"]).select("doc_id", "target", "property", "field", "value", "note")


REFERENCE = f"""e as (select *, {TARGET_SQL} as target, greatest(1, length(trim(content))) as w from elements),
vals as (select doc_id, element_id, 'fontSize' as property, replace(size, 'pt', '') as value, 'pt' as unit from elements where ord % 5 > 0 union all select doc_id, element_id, 'alignment', align, null from elements where align is not null),
props as (select distinct doc_id, property from vals),
votes as (select e.doc_id, target, p.property, v.value, v.unit, sum(w) as w, min(ord) as first from e join props p on p.doc_id = e.doc_id left join vals v on v.doc_id = e.doc_id and v.element_id = e.element_id and v.property = p.property group by 1, 2, 3, 4, 5),
best as (select doc_id, target, property, arg_min({{'value': value, 'unit': unit}}, (-w, first)) as v from votes group by 1, 2, 3),
own as (select doc_id, target, property, v.value as value, v.unit as unit from best where v.value is not null),
used as (select distinct doc_id, target from e), levels as (select doc_id, substr(target, 9)::integer as u from used where target like 'Heading%'),
wanted as (select distinct doc_id, lv from levels, (select unnest(range(1, 7)) as lv) where not exists (select 1 from levels l where l.doc_id = levels.doc_id and l.u = lv)),
likes as (select w.doc_id, w.lv, arg_min(u, (abs(u - w.lv), -u)) as u from wanted w join levels l on l.doc_id = w.doc_id group by 1, 2),
styled as (select doc_id, target, 'italic' as property, 'true' as value, null as unit from (select distinct doc_id from e), (values ('Quote'), ('Heading 6'), ('List')) t(target))"""


@query(with_(ELEMENTS, *REFERENCE.split(",\n")) + """select * from own union all select o.doc_id, 'Heading ' || lv, property, value, unit from own o join likes k on k.doc_id = o.doc_id and o.target = 'Heading ' || k.u
 union all select s.* from styled s where not exists (select 1 from used u where u.doc_id = s.doc_id and u.target = s.target) and not exists (select 1 from likes k where k.doc_id = s.doc_id and s.target = 'Heading ' || k.lv)""")
def m19_reference_rules(spark, d):
    e = elements(spark, d).withColumn("target", R.target_of(F.col("type"), F.col("level")))
    none = F.lit(None).cast("string")
    sizes = e.where("ord % 5 > 0").select("doc_id", "element_id", F.lit("fontSize").alias("property"), F.replace("size", F.lit("pt"), F.lit("")).alias("value"), F.lit("pt").alias("unit"))
    sides = e.where("align is not null").select("doc_id", "element_id", F.lit("alignment").alias("property"), F.col("align").alias("value"), none.alias("unit"))
    kinds = F.explode(F.array(*(F.lit(t) for t in ("Quote", "Heading 6", "List"))))
    by_type = e.select("doc_id").distinct().select("doc_id", kinds.alias("target"), F.lit("italic").alias("property"), F.lit("true").alias("value"), none.alias("unit"))
    return S.reference_rules(e, sizes.unionByName(sides), by_type).select("doc_id", "target", "property", "value", "unit")


@query(with_(ELEMENTS) + f"select doc_id, count(*) filter (where target = 'Paragraph') as paragraphs, count(*) filter (where target = 'List') as lists, count(*) filter (where target = 'Table') as tables, count(*) filter (where target = 'Image') as images, count(*) filter (where target = 'Caption') as captions, " + " || ',' || ".join(f"count(*) filter (where target = 'Heading {k}')" for k in range(1, 7)) + f" as headings from (select doc_id, {TARGET_SQL} as target from elements) group by 1")
def m19_reference_counts(spark, d):
    e = elements(spark, d).select("doc_id", R.target_of(F.col("type"), F.col("level")).alias("target"))
    return S.reference_counts(e).withColumn("headings", F.array_join("headings", ","))


TEMPLATE_CHANGES = """t as (select p_partkey as id, 1 + p_size % 5 as version, p_name as name, 'c' || p_size % 3 as category from part),
c as (select id, case when id % 6 = 0 then 99 when id % 4 = 0 then version end as expected, case when id % 10 = 0 then ' ' || name || ' ' when id % 3 > 0 then 'new ' || id end as name, case when id % 5 = 0 then 'c1' end as category from t where id % 2 = 0),
j as (select t.*, c.expected is not null and c.expected <> t.version as clash, trim(c.name) as new_name, c.category as new_category from t left join c on c.id = t.id),
k as (select *, not clash and ((new_name is not null and new_name <> name) or (new_category is not null and new_category <> category)) as goes from j)"""


@query(with_(TEMPLATE_CHANGES) + "select id, version + goes::integer as version, case when goes then coalesce(new_name, name) else name end as name, case when goes then coalesce(new_category, category) else category end as category from k")
def m20_updated_templates(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (1 + F.col("p_size") % 5).alias("version"), F.col("p_name").alias("name"), F.concat(F.lit("c"), (F.col("p_size") % 3).cast("string")).alias("category"))
    k = F.col("id")
    changes = t.where(k % 2 == 0).select("id", F.when(k % 6 == 0, 99).when(k % 4 == 0, F.col("version")).alias("expected_version"), F.when(k % 10 == 0, F.concat(F.lit(" "), "name", F.lit(" "))).when(k % 3 > 0, F.concat(F.lit("new "), k.cast("string"))).alias("name"), F.when(k % 5 == 0, "c1").alias("category"))
    return S.updated(t, changes, ["name", "category"])[0]


def talks(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.col("turn").cast("string").alias("element_id"), F.col("text").alias("content"))


def offered(spark, d):
    """Deletions of every third turn, insertions behind those and deletions of what is not there; some are accepted, some rejected, some wait."""
    c, t = talks(spark, d), F.col("ord")
    target = F.when(t % 3 == 0, F.col("element_id")).when(t % 3 == 2, F.concat("element_id", F.lit("?")))
    new = t % 3 == 1
    proposals = c.select("doc_id", t.alias("id"), t.alias("seq"), F.when(new, "insert").otherwise("delete").alias("op"), target.alias("target"), F.when(new, (t - 1).cast("string")).alias("after_id"), F.when(new, F.lit("new text")).alias("content"))
    return c, proposals, c.where(t % 5 != 4).select("doc_id", t.alias("id"), (t % 5 != 3).alias("accept"))


DECIDED = "with c as (select conv_id as doc_id, turn, turn % 5 < 3 as accepted, turn % 3 = 1 and exists (select 1 from conversations x where x.conv_id = c.conv_id and x.turn = c.turn - 1) and (turn - 1) % 5 >= 3 as fits from conversations c) "


@query(DECIDED + ", r as (select doc_id, turn, 0 as s, turn::varchar as element_id from c where not (turn % 3 = 0 and accepted) union all select doc_id, turn - 1, 1, 'new-' || turn from c where accepted and fits) select doc_id, row_number() over (partition by doc_id order by turn, s) - 1 as ord, element_id from r")
def m9_decided_elements(spark, d):
    return E.decided(*offered(spark, d))[0]


@query(DECIDED + "select doc_id, turn as id from c where accepted and (turn % 3 = 2 or (turn % 3 = 1 and not fits))")
def m9_stale_proposals(spark, d):
    """Accepted too late: behind a turn that an earlier decision of the batch has deleted, or about what never was."""
    return E.decided(*offered(spark, d))[2]


@query("select conv_id as doc_id, turn as id, turn % 3 = 2 as about_nothing from conversations c where turn % 5 = 4 and turn % 3 <> 2 and (turn % 3 = 0 or exists (select 1 from conversations x where x.conv_id = c.conv_id and x.turn = c.turn - 1))")
def m9_waiting_proposals(spark, d):
    """What is neither decided nor about what is gone."""
    return E.decided(*offered(spark, d))[1].select("doc_id", "id", (F.col("id") % 3 == 2).alias("about_nothing"))


@query("with c as (select conv_id as doc_id, turn from conversations) select distinct doc_id, 'changes' as problem from c where doc_id % 5 = 1 or (doc_id % 5 = 2 and turn % 5 = 3) union all select distinct doc_id, 'adds again' from c where doc_id % 5 = 3 and turn % 5 = 1 union all select distinct doc_id, 'adds nowhere' from c where doc_id % 5 = 4 and turn % 5 = 1")
def m10_refused_patches(spark, d):
    c = talks(spark, d)
    t, k, own = F.col("ord"), F.col("doc_id") % 5, F.col("element_id")
    changed = c.where(t % 4 == 2).where(t % 5 != 3).select("doc_id", "element_id").unionByName(c.where((k == 1) & (t == 0)).select("doc_id", F.lit("nowhere").alias("element_id"))).unionByName(c.where((k == 2) & (t % 5 == 3)).select("doc_id", "element_id"))
    changed = changed.unionByName(c.where(k == 1).select("doc_id", F.lit("not there").alias("element_id")).distinct()).distinct().withColumn("content", F.lit("x"))
    added = c.where(t % 5 == 1).select("doc_id", F.when(k == 3, own).otherwise(F.concat(own, F.lit("n"))).alias("element_id"), F.when(k == 4, F.concat(F.lit("nowhere"), own)).otherwise(own).alias("after_id"), F.lit("new").alias("content"))
    return E.patch_problems(c, changed, added, c.where(t % 5 == 3).select("doc_id", "element_id"))


@query("with " + BEFORE + ", " + AFTER + ", a as (select doc_id, list(element_id order by ord, element_id) as ids from after group by 1), b as (select doc_id, list(element_id order by ord, element_id) as ids from before group by 1) select a.doc_id, array_to_string(a.ids, ' ') as ids from a left join b on b.doc_id = a.doc_id where a.ids is distinct from b.ids")
def m11_order_delta(spark, d):
    before, after = versions(spark, d)
    return E.order_delta(before, after).select("doc_id", F.array_join("order", " ").alias("ids"))


@query("with " + BEFORE + ", " + AFTER + """, j as (select coalesce(b.doc_id, a.doc_id) as doc_id, b.ord as was, a.ord as now, b.doc_id is not null and a.doc_id is not null as stays, b.doc_id is null as added, a.doc_id is null as removed, (b.type, coalesce(b.level, -1), b.content) <> (a.type, coalesce(a.level, -1), a.content) as differs, coalesce(b.element_id, a.element_id) as element_id from before b full join after a on a.doc_id = b.doc_id and a.element_id = b.element_id),
m as (select *, stays and was < max(case when stays then was end) over (partition by doc_id order by now nulls first rows between unbounded preceding and 1 preceding) as back from j),
g as (select doc_id, count(*) filter (where stays and differs) as changed, count(*) filter (where added) as added, count(*) filter (where removed) as removed, coalesce(bool_or(back), false) as moved, count(now) as n from m group by 1)
select doc_id, changed, added, removed, moved, not moved and changed + added + removed <= greatest(20, n / 2) as patch from g""")
def m12_patch_or_whole(spark, d):
    return E.patch_or_whole(*versions(spark, d))


@query("with h as (select conv_id as doc_id, turn, text, length(text) * (1 + turn % 4) // 5 as n from conversations) select doc_id, (2 * turn + k)::bigint as ord, case when k = 0 then n >= length(text) - n else n < length(text) - n end as owner from h, (values (0), (1)) t(k)")
def m16_reidentified_blocks(spark, d):
    """Every turn is split in two; the longer half keeps its id."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "text", F.floor(F.length("text") * (1 + F.col("turn") % 4) / 5).cast("int").alias("n"))
    stored = c.select("doc_id", F.col("turn").cast("string").alias("element_id"), F.col("text").alias("content"))
    first = c.select("doc_id", (F.col("turn") * 2).alias("ord"), F.col("turn").cast("string").alias("element_id"), F.expr("substr(text, 1, n)").alias("content"))
    rest = c.select("doc_id", (F.col("turn") * 2 + 1).alias("ord"), F.col("turn").cast("string").alias("element_id"), F.expr("substr(text, n + 1)").alias("content"))
    return E.reidentified(first.unionByName(rest), stored).select("doc_id", F.col("ord").cast("long").alias("ord"), "owner")


@query(with_(RULES, CLEAN) + "select doc_id, target, property, value, unit, 2 as priority from clean where seq % 3 > 0")
def m17_valid_rules(spark, d):
    answers = rules(spark, d).withColumn("target", F.when(F.col("seq") % 3 == 0, "Sidebar").otherwise(F.col("target")))
    return E.valid_rules(answers).select("doc_id", "target", "property", "value", "unit", "priority")


@query(with_(ELEMENTS) + "select doc_id, ord, op, value from (select doc_id, ord, case ord % 5 when 0 then 'insert' when 1 then 'delete' when 2 then 'set_style' when 3 then 'move' else 'dance' end as op, type, case when ord % 2 = 0 then 'red' else 'plaid' end as value from elements) where op <> 'dance' and (op <> 'insert' or type in ('paragraph', 'heading', 'caption')) and (op <> 'set_style' or value = 'red')")
def m17_valid_operations(spark, d):
    o = F.col("ord")
    op = F.when(o % 5 == 0, "insert").when(o % 5 == 1, "delete").when(o % 5 == 2, "set_style").when(o % 5 == 3, "move").otherwise("dance")
    answers = elements(spark, d).select("doc_id", "ord", op.alias("op"), F.col("type").alias("kind"), F.lit("color").alias("property"), F.when(o % 2 == 0, "red").otherwise("plaid").alias("value"), F.lit(None).cast("string").alias("unit"))
    return E.valid_operations(answers).select("doc_id", "ord", "op", "value")


@query("select conv_id, turn, case when turn % 3 = 0 then role || '_kind' else 'general' end as kind from conversations")
def g5_document_types(spark, d):
    c = table(spark, d, "conversations")
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  "), F.initcap("role"), F.lit("-Kind "))).when(F.col("turn") % 3 == 1, F.concat("role", F.lit(" 7")))
    return c.select("conv_id", "turn", E.document_type(said).alias("kind"))


@query("select conv_id as doc_id, row_number() over (partition by conv_id order by turn) - 1 as ord, case when turn < 20 and turn % 3 < 2 then 'heading' else 'paragraph' end as type, turn < 20 and turn % 3 < 2 as from_model from conversations")
def g4_structured_pieces(spark, d):
    """The model's answer holds the text of two pieces in three; of the third it has lost a mark and won a word."""
    c, t = table(spark, d, "conversations"), F.col("turn")
    pieces = c.select(F.col("conv_id").alias("doc_id"), t.alias("piece"), "text")
    said = F.when(t % 3 == 0, F.col("text")).when(t % 3 == 1, F.concat(F.lit("- "), F.replace("text", F.lit(" "), F.lit("  ")))).otherwise(F.concat("text", F.lit(" more")))
    answers = c.select(F.col("conv_id").alias("doc_id"), t.alias("piece"), F.lit(0).alias("ord"), F.lit("heading").alias("type"), F.lit(1).alias("level"), said.alias("content"))
    segments = c.select(F.col("conv_id").alias("doc_id"), t.alias("piece"), F.lit(0).alias("ord"), F.lit("paragraph").alias("type"), F.lit(None).cast("int").alias("level"), F.col("text").alias("content"))
    return E.structured(pieces, answers, segments).select("doc_id", "ord", "type", "from_model")


@query("""with r as (select conv_id as doc_id, turn // 2 as top, case when turn % 2 = 0 then [turn // 2] else [turn // 2, 0] end as path, 0 as k, 'a' || turn as text from conversations union all select conv_id, turn // 2, case when turn % 2 = 0 then [turn // 2] else [turn // 2, 0] end, 1, 'b' from conversations
 union all select conv_id, turn // 2, case when turn % 2 = 0 then [turn // 2, 9] else [turn // 2, 0, 9] end, 0, 'cell' from conversations where turn % 3 = 0 and turn % 6 <> 0) select doc_id, top::integer as top, row_number() over (partition by doc_id, top order by path, k) - 1 as nth, text from r""")
def d2_all_runs(spark, d):
    c, t = table(spark, d, "conversations"), F.col("turn").cast("int")
    half = F.floor(t / 2).cast("int")
    path = F.when(t % 2 == 0, F.array(half)).otherwise(F.array(half, F.lit(0)))
    run = lambda text: F.struct(text.alias("text"), F.array(F.lit("bold")).alias("marks"))
    cell = F.struct(F.concat(path, F.array(F.lit(9))).alias("path"), F.array(run(F.lit("cell"))).alias("runs"), (t % 6 == 0).alias("blocks"))
    kind = "array<struct<path:array<int>,runs:array<struct<text:string,marks:array<string>>>,blocks:boolean>>"
    rows = c.select(F.col("conv_id").alias("doc_id"), path.alias("path"), F.array(run(F.concat(F.lit("a"), t.cast("string"))), run(F.lit("b"))).alias("runs"), F.when(t % 3 == 0, F.array(cell)).otherwise(F.array().cast(kind)).alias("cells"))
    return E.all_runs(rows).select("doc_id", "top", "nth", "text")


@query("with e as (select conv_id, turn, json_object('content', 't' || turn, 'type', role) as j, case when turn % 2 = 0 then '{\"color\":\"red\",\"font-size\":\"11pt\"}' else '{}' end as look from conversations) select conv_id, turn, sha256('{\"element\":' || j || ',\"look\":' || look || '}') as fingerprint from e")
def d24_element_fingerprints(spark, d):
    """Ids, places, nulls and empty parts do not count, nor does the order of a look's keys."""
    t = F.col("turn")
    look = F.when(t % 4 == 0, F.create_map(F.lit("font-size"), F.lit("11pt"), F.lit("color"), F.lit("red"))).when(t % 2 == 0, F.create_map(F.lit("color"), F.lit("red"), F.lit("font-size"), F.lit("11pt"))).otherwise(F.create_map().cast("map<string,string>"))
    e = table(spark, d, "conversations").select("conv_id", "turn", t.alias("ord"), F.lit("x").alias("id"), F.col("role").alias("type"), F.concat(F.lit("t"), t.cast("string")).alias("content"), F.lit("").alias("caption"), F.lit(None).cast("int").alias("level"), F.array().cast("array<string>").alias("items"), look.alias("look"))
    return e.select("conv_id", "turn", E.fingerprint(e, ["id", "ord", "type", "content", "caption", "level", "items"], look="look").alias("fingerprint"))


@query(ADMITTED.format(own="*", order="id").replace("recursive ", "recursive asked as (select o_custkey as workspace, o_orderkey as id, 1 + o_orderkey % 3 as n, coalesce(c_custkey % 4, 0) as held, case when o_custkey % 9 <> 0 then 5 end as lim from orders left join customer on c_custkey = o_custkey), "))
def e7_admitted_requests(spark, d):
    """Requests of one to three; a refused one leaves room for a smaller one behind it."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("workspace"), F.col("o_orderkey").alias("id"), (1 + F.col("o_orderkey") % 3).alias("n"))
    held = table(spark, d, "customer").select(F.col("c_custkey").alias("workspace"), (F.col("c_custkey") % 4).alias("n"))
    return E.admitted(o, held, workspace="workspace", order=["id"], limit=F.when(F.col("workspace") % 9 != 0, 5)).select("id", "ok")


@query("select event_id, case when event_id % 3 = 0 then 'format,instructionsText,text' else 'format' end as keys from events")
def e9_cleared_payloads(spark, d):
    payload = F.create_map(*(F.lit(x) for x in ("text", "t", "instructionsText", "i", "format", "pdf")))
    jobs = table(spark, d, "events").select("event_id", payload.alias("payload"), F.when(F.col("event_id") % 3 == 0, "running").when(F.col("event_id") % 3 == 1, "failed").otherwise("succeeded").alias("status"))
    return E.cleared(jobs).select("event_id", F.array_join(F.array_sort(F.map_keys("payload")), ",").alias("keys"))


@query("with t as (select distinct ts from events) select ts, row_number() over (partition by date_trunc('hour', ts) order by ts) = 1 as files, row_number() over (partition by date_trunc('day', ts) order by ts) = 1 as assets from t")
def e14_due_sweeps(spark, d):
    ticks = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at")).distinct()
    return E.sweeps(ticks, at="at").select(F.col("at").cast("timestamp_ntz").alias("ts"), "files", "assets")


@query("select event_id, event_type as event, 'email=' || sha256('u' || user_id || '@x.org') || case when user_id % 2 = 0 then ',target=' || user_id else '' end || ',user=' || user_id as fields from events")
def e20_audit_rows(spark, d):
    u = F.col("user_id").cast("string")
    e = table(spark, d, "events").select(F.col("event_id").alias("at"), F.col("event_type").alias("event"), u.alias("user"), F.when(F.col("user_id") % 2 == 0, u).alias("target"), F.concat(F.lit(" U"), u, F.lit("@X.org")).alias("email"), F.lit("secret words").alias("content"))
    fields = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return E.audit_rows(e).select(F.col("at").alias("event_id"), "event", fields.alias("fields"))


@query("select doc_id, case doc_id % 4 when 0 then case when " + MARKDOWN_SQL + " then 'markdown' else 'text' end end as kind, case doc_id % 4 when 0 then null when 3 then 'unsupported type' else 'not what its name says' end as problem from documents")
def s1_routed_files(spark, d):
    k = F.col("doc_id") % 4
    name = F.concat(F.lit("Some file.v2"), F.when(k == 0, ".TXT").when(k == 1, ".docx").when(k == 2, ".Pdf").otherwise(".odt"))
    files = table(spark, d, "documents").select("doc_id", name.alias("name"), F.col("text").cast("binary").alias("content"))
    return E.routed(files).select("doc_id", "kind", "problem")


@query("""with p as (select l_orderkey, l_linenumber, case l_linenumber % 4 when 3 then null else l_partkey end as width, case l_linenumber % 4 when 0 then l_suppkey * 997 when 3 then null else l_suppkey * 61 end as height from lineitem)
select *, case when width is null then 'unreadable' when width * height > 50000000 or greatest(width, height) > 20000 then 'too_large' end as problem from p""")
def p18_picture_headers(spark, d):
    """PNG files; JPEG files with a thumbnail in a header, some of over 130 KB; progressive ones; JPEG files whose data comes before any frame.

    A JPEG's sides are two bytes each, so a larger picture is a PNG file.
    """
    k, large = F.col("l_linenumber") % 4, F.col("l_orderkey") % 1024 == 1
    w, h = F.col("l_partkey"), F.when(k == 0, F.col("l_suppkey") * 997).otherwise(F.col("l_suppkey") * 61)
    as_png = (k == 0) | ((k != 3) & (F.greatest(w, h) > 0xFFFF))

    def hexed(n, digits):
        return F.lpad(F.hex(n), digits, "0")

    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hexed(w, 8), hexed(h, 8), F.lit("0806000000"))
    inner = "FFD8FFC0001108007800A003012200021101031101"
    thumbnail = F.lit(f"FFE1{len(inner) // 2 + 2:04X}{inner}")
    filler = F.when(large, F.repeat(F.concat(F.lit("FFE2FFFF"), F.repeat(F.lit("FFC0"), 32766), F.lit("00")), 2)).otherwise(F.lit("FFFE0004FFC0"))
    frame = F.concat(F.when(k == 1, "FFC0").otherwise("FFC2"), F.lit("001108"), hexed(h, 4), hexed(w, 4), F.lit("03"))
    jpeg = F.concat(F.lit("FFD8"), thumbnail, filler, F.when(k == 3, F.lit("FFDA0008")).otherwise(F.lit("FFFF")), frame)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.unhex(F.when(as_png, png).otherwise(jpeg)).alias("c"))
    size = X.picture_size(F.col("c"))
    return rows.select("l_orderkey", "l_linenumber", size["width"].alias("width"), size["height"].alias("height"), X.picture_problem(F.col("c")).alias("problem"))


@query("select page_id, k, case k when 0 then regexp_matches(lower(url), '^(https?|ftps?|mailto|tel|callto|sms|xmpp):') when 1 then true when 2 then false when 3 then true else false end as allowed from pages, (select unnest(range(0, 5)) as k)")
def p19_word_fields(spark, d):
    url = F.col("url")
    kinds = F.array(F.concat(F.lit(' hyperlink "'), url, F.lit('" \\o "tip"')), F.concat(F.lit("PAGEREF "), url), F.concat(F.lit('INCLUDETEXT "'), url, F.lit('"')), F.lit(' HYPERLINK \\l "here"'), F.lit('HYPERLINK "javascript:x"'))
    rows = table(spark, d, "pages").select("page_id", F.posexplode(kinds).alias("k", "field"))
    return rows.select("page_id", F.col("k").cast("long").alias("k"), X.field_allowed(F.col("field")).alias("allowed"))


@query("select doc_id, case doc_id % 4 when 0 then sha256(unhex('89504E470D0A1A0A' || printf('%04X', doc_id % 50))) end as asset_id, case when doc_id % 4 in (1, 2) then 'a picture that can''t be read was removed' end as note, case when doc_id % 4 = 3 then 'https://example.org/' || doc_id else '' end as src from documents")
def m18_externalised_images(spark, d):
    k = F.col("doc_id")
    png = F.base64(F.unhex(F.concat(F.lit("89504E470D0A1A0A"), F.lpad(F.hex(k % 50), 4, "0"))))
    src = F.when(k % 4 == 0, F.concat(F.lit("data:image/png;base64,"), png)).when(k % 4 == 1, F.concat(F.lit("data:image/jpeg;base64,"), png)).when(k % 4 == 2, "data:image/png;base64,@@@").otherwise(F.concat(F.lit("https://example.org/"), k.cast("string")))
    return E.externalised(table(spark, d, "documents").select("doc_id", src.alias("src")))[0].select("doc_id", "asset_id", "note", "src")


TREE = "t as (select p_partkey as id, case when p_partkey % 17 = 3 then p_partkey + 1 when p_partkey % 17 = 4 then p_partkey - 1 when p_partkey // 2 > 0 then p_partkey // 2 end as parent from part), up as (select id, parent as ancestor, 1 as depth, [id, parent] as path from t where parent is not null and parent <> id union all select up.id, t.parent, depth + 1, list_append(path, t.parent) from up join t on t.id = up.ancestor where t.parent is not null and not list_contains(path, t.parent))"


def style_tree(spark, d):
    k = F.col("p_partkey")
    half = F.floor(k / 2).cast("long")
    return table(spark, d, "part").select(k.cast("long").alias("id"), F.when(k % 17 == 3, k + 1).when(k % 17 == 4, k - 1).when(half > 0, half).cast("long").alias("parent"))


@query("with recursive " + TREE + " select id, ancestor, depth from up")
def o16_ancestors(spark, d):
    """Parts as a tree of halves, with some rings of two."""
    return C_.ancestors(style_tree(spark, d), key="id", parent="parent").select("id", "ancestor", "depth")


@query("with recursive " + TREE + ", v as (select id, 'size' as property, 's' || id as value from t where id % 3 = 0 union all select id, 'font', 'f' || id from t where id % 5 = 0), a as (select id, property, value, 0 as depth from v union all select up.id, property, value, depth from up join v on v.id = up.ancestor) select id, property, arg_min(value, depth) as value from a group by 1, 2")
def g15_effective_values(spark, d):
    rows = style_tree(spark, d)
    own = lambda name, k, letter: rows.where(F.col("id") % k == 0).select("id", F.lit(name).alias("property"), F.concat(F.lit(letter), F.col("id").cast("string")).alias("value"))
    return C_.effective_values(rows, own("size", 3, "s").unionByName(own("font", 5, "f")), key="id", parent="parent")


NEWS = "e as (select user_id, user_id * 10 + event_id % 3 as sub, case event_id % 5 when 0 then 'active' when 1 then 'trialing' when 2 then 'canceled' when 3 then 'past_due' else 'incomplete' end as status, ts, event_id from events)"


@query("with " + NEWS + ", l as (select user_id, sub, arg_max(status, (ts, event_id)) as status, max(ts) as ts, arg_max(event_id, (ts, event_id)) as event_id from e group by 1, 2) select user_id, arg_max(sub, (status in {0}, ts, event_id)) as sub, arg_max(status, (status in {0}, ts, event_id)) as status from l group by 1".format(str(tuple(M.ENTITLED))))
def e16_current_subscriptions(spark, d):
    k = F.col("event_id") % 5
    status = F.when(k == 0, "active").when(k == 1, "trialing").when(k == 2, "canceled").when(k == 3, "past_due").otherwise("incomplete")
    e = table(spark, d, "events").select("user_id", (F.col("user_id") * 10 + F.col("event_id") % 3).alias("sub"), status.alias("status"), "ts", "event_id")
    return M.current_subscriptions(e.unionByName(e.where("event_id % 7 = 0")), workspace="user_id", subscription="sub", status="status", order=["ts", "event_id"])


@query("with e as (select user_id as job, case event_id % 11 when 0 then 'succeeded' when 1 then 'failed' when 2 then 'pending' else 'running' end as status, ts, event_id, event_id % 100 as progress from events), f as (select job, min((ts, event_id)) as over_, arg_min(status, (ts, event_id)) as last from e where status in ('succeeded', 'failed') group by 1), s as (select e.*, last from e left join f on f.job = e.job where over_ is null or (ts, event_id) <= over_) select job, coalesce(max(last), case when count(*) filter (where status = 'running') > 0 then 'running' else 'pending' end) as state, count(*) filter (where status = 'running') as attempts, max(progress) as progress from s group by 1")
def e8_job_states(spark, d):
    k = F.col("event_id") % 11
    e = table(spark, d, "events").select(F.col("user_id").alias("job"), F.when(k == 0, "succeeded").when(k == 1, "failed").when(k == 2, "pending").otherwise("running").alias("status"), "ts", "event_id", (F.col("event_id") % 100).alias("progress"))
    return Y.job_states(e, job="job", status="status", order=["ts", "event_id"], progress="progress")


@query("with r as (select conv_id, string_agg(case when turn % 4 = 1 then replace(upper(text), 'ẞ', 'SS') else text end, '' order by turn) filter (where turn % 3 > 0) as seen from conversations group by 1) select conv_id, array_to_string(" + WORDS_SQL.format("coalesce(seen, '')") + ", ' ') as words from r")
def d4_visible_words(spark, d):
    t = F.col("turn")
    runs = F.array_sort(F.collect_list(F.struct("turn", "text", (t % 3 == 0).alias("hidden"), (t % 4 == 1).alias("caps"))))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(runs.alias("runs"))
    return rows.select("conv_id", F.array_join(X.visible_words(F.col("runs")), " ").alias("words"))


@query("select conv_id as doc_id, (turn // 12)::integer as top, least(8, max(turn % 12))::integer as depth from conversations group by 1, 2")
def a24_block_depths(spark, d):
    t = F.col("turn").cast("int")
    path = F.concat(F.array(F.floor(t / 12).cast("int")), F.array_repeat(F.lit(0), (t % 12).cast("int")))
    return T_.block_depths(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), path.alias("path")))


@query("select doc_id % 100 as doc_id, sum(case when doc_id % 4 < 2 then (length(base64(encode(coalesce(text, '')))) * 3) // 4 else 0 end)::bigint as bytes from documents group by 1")
def a25_inline_bytes(spark, d):
    data = F.regexp_replace(F.base64(F.coalesce("text", F.lit("")).cast("binary")), r"\s", "")
    rows = table(spark, d, "documents").select((F.col("doc_id") % 100).alias("doc_id"), F.when(F.col("doc_id") % 4 < 2, F.concat(F.lit("data:image/png;base64,"), data)).otherwise(F.lit("https://x/y")).alias("src"))
    return E.inline_bytes(rows)


@query("""with s as (select o_custkey as doc_id, o_orderkey as section, case when o_orderkey % 4 = 0 then 'Letter' when o_orderkey % 4 = 1 then 'A4' end as size, case when o_orderkey % 3 = 0 then 'landscape' end as orientation, case when o_orderkey % 5 = 0 then 1.5::double end as top from orders),
i as (select doc_id, section, coalesce(last_value(size ignore nulls) over w, 'Legal') as size, coalesce(last_value(orientation ignore nulls) over w, 'portrait') as orientation, coalesce(last_value(top ignore nulls) over w, 2.54) as top from s window w as (partition by doc_id order by section rows between unbounded preceding and current row)),
p as (select *, case size when 'A4' then 210.0::double else 215.9::double end as w, case size when 'A4' then 297.0::double when 'Letter' then 279.4::double else 355.6::double end as h from i)
select doc_id, section, round(case when orientation = 'landscape' then h else w end * 96 / 25.4, 4) as width, round(case when orientation = 'landscape' then w else h end * 96 / 25.4, 4) as height, round(top * 96 / 2.54, 4) as top, round(2.0::double * 96 / 2.54, 4) as "left" from p""")
def w21_section_boxes(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    none = F.lit(None).cast("double")
    sections = o.select(F.col("o_custkey").alias("doc_id"), k.alias("section"), F.when(k % 4 == 0, "Letter").when(k % 4 == 1, "A4").alias("size"), F.when(k % 3 == 0, "landscape").alias("orientation"), F.when(k % 5 == 0, 1.5).alias("top"), *(none.alias(m) for m in ("bottom", "left", "right")))
    settings = o.select(F.col("o_custkey").alias("doc_id")).distinct().select("doc_id", F.lit("Legal").alias("size"), F.lit("portrait").alias("orientation"), F.lit(2.54).alias("top"), *(F.lit(2.0).alias(m) for m in ("bottom", "left", "right")))
    return L.section_boxes(sections, settings).select("doc_id", "section", *(F.round(c, 4).alias(c) for c in ("width", "height", "top", "left")))
