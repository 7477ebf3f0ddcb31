"""Queries of the rule cascade, on rules made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import units as U
from ..operators import rules as R
from ..sources.tables import table
from .catalogue import query
from .relations import ELEMENTS, elements, with_

#: Orders as documents, their lines as rules.
RULES = """rules as (select l_orderkey as doc_id, case l_linenumber % 3 when 0 then 'Paragraph' when 1 then 'Heading ' || (1 + l_suppkey % 6) else 'Quote' end as target,
    case l_partkey % 5 when 0 then 'fontSize' when 1 then 'bold' when 2 then 'color' when 3 then 'alignment' else 'indentLeft' end as property,
    case l_partkey % 5 when 0 then (8 + l_suppkey % 10)::varchar when 1 then case when l_suppkey % 2 = 0 then 'true' else 'no' end when 2 then case when l_suppkey % 3 = 0 then '#ff0000' when l_suppkey % 3 = 1 then 'plaid' else 'blue' end when 3 then case when l_suppkey % 2 = 0 then 'center' else 'justify' end else (l_suppkey % 40)::varchar end as value,
    case l_partkey % 5 when 0 then 'pt' when 4 then 'cm' end as unit, (1 + l_suppkey % 7)::integer as priority, (l_linenumber * 100000000000 + l_partkey * 10000 + l_suppkey)::bigint as seq from lineitem)"""
CLEAN = """clean as (select doc_id, target, property, case property when 'bold' then case when value in ('true') then 'true' else 'false' end else value end as value, unit, priority, seq from rules
    where case property when 'color' then value <> 'plaid' when 'indentLeft' then value::double <= 20 else true end)"""
BEST = "best as (select * from (select *, row_number() over (partition by doc_id, target, property order by priority, seq) as n from clean) where n = 1)"


def rules(spark, d):
    s, p = F.col("l_suppkey"), F.col("l_partkey") % 5
    n = F.col("l_linenumber") % 3
    value = (
        F.when(p == 0, (8 + s % 10).cast("string")).when(p == 1, F.when(s % 2 == 0, "true").otherwise("no")).when(p == 2, F.when(s % 3 == 0, "#ff0000").when(s % 3 == 1, "plaid").otherwise("blue"))
        .when(p == 3, F.when(s % 2 == 0, "center").otherwise("justify")).otherwise((s % 40).cast("string"))
    )
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.when(n == 0, "Paragraph").when(n == 1, F.concat(F.lit("Heading "), (1 + s % 6).cast("string"))).otherwise("Quote").alias("target"),
        F.when(p == 0, "fontSize").when(p == 1, "bold").when(p == 2, "color").when(p == 3, "alignment").otherwise("indentLeft").alias("property"), value.alias("value"),
        F.when(p == 0, "pt").when(p == 4, "cm").alias("unit"), (1 + s % 7).cast("int").alias("priority"), F.lit("instruction").alias("source"), (F.col("l_linenumber").cast("long") * 100000000000 + F.col("l_partkey") * 10000 + s).alias("seq"),
    )


@query(with_(RULES, CLEAN) + "select doc_id, target, property, value, unit, priority, seq from clean")
def p22_usable_rules(spark, d):
    return R.usable(rules(spark, d)).drop("source")


@query(with_(RULES, CLEAN, BEST) + "select doc_id, target, property, value, unit, priority from best")
def w1_winning_rules(spark, d):
    return R.winners(R.usable(rules(spark, d)), ["doc_id", "target"]).select("doc_id", "target", "property", "value", "unit", "priority")


@query(with_(RULES, CLEAN, BEST) + "select doc_id, target, case property when 'fontSize' then 'font-size' when 'bold' then 'font-weight' when 'color' then 'color' when 'alignment' then 'text-align' else 'margin-left' end as css, case property when 'bold' then case value when 'true' then 'bold' else 'normal' end else value || coalesce(unit, '') end as value from best")
def d21_rule_css(spark, d):
    return R.css_rows(R.winners(R.usable(rules(spark, d)), ["doc_id", "target"]), ["doc_id", "target"])


def default_values() -> str:
    rows = ", ".join(f"('{t}', '{p}', '{v}', {'null' if u is None else repr(u)}, {k})" for k, (t, p, v, u) in enumerate(R.default_rows()))
    return f"defaults as (select * from (values {rows}) t(target, property, value, unit, seq))"


@query(with_(default_values()) + "select target, property, value, unit, 8 as priority from defaults")
def d20_default_rules(spark, d):
    return R.default_rules(spark).select("target", "property", "value", "unit", "priority")


FROM_BODY = "takes as (select * from (values " + ", ".join(f"('{t}', '{c}')" for t, own in R.FROM_BODY.items() for c in own) + ") t(target, css))"
RESOLVED = with_(RULES, CLEAN, default_values()) + """, every as (select doc_id, target, property, value, unit, priority, seq from clean union all select d.doc_id, target, property, value, unit, 8, seq + 10000000000000000 from defaults, (select distinct doc_id from rules) d where target <> 'Document'),
best as (select * from (select *, row_number() over (partition by doc_id, target, property order by priority, seq) as n from every) where n = 1), """ + FROM_BODY + """,
css as (select doc_id, target, case property when 'fontSize' then 'font-size' when 'bold' then 'font-weight' when 'italic' then 'font-style' when 'color' then 'color' when 'alignment' then 'text-align' when 'indentLeft' then 'margin-left' when 'fontFamily' then 'font-family' when 'spaceBefore' then 'margin-top' when 'paragraphSpacing' then 'margin-bottom' when 'lineSpacing' then 'line-height' end as css,
  case property when 'bold' then case value when 'true' then 'bold' else 'normal' end when 'italic' then 'italic' when 'lineSpacing' then '1.15' else value || coalesce(unit, '') end as value from best
  union all select doc_id, target, '--line-spacing', value from best where property = 'lineSpacing'),
looks as (select * from css union all select t.doc_id, t.target, b.css, b.value from (select distinct doc_id, target from css) t join takes using (target) join css b on b.doc_id = t.doc_id and b.target = 'Paragraph' and b.css = takes.css where not exists (select 1 from css c where c.doc_id = t.doc_id and c.target = t.target and c.css = takes.css))
"""


@query(RESOLVED + "select doc_id, target, css, value from looks")
def w2_resolved_styles(spark, d):
    return R.resolve(rules(spark, d), ["doc_id"]).select("doc_id", "target", "css", "value")


SETTING_RULES = """srules as (select o_custkey as doc_id, case o_orderkey % 4 when 0 then 'pageSize' when 1 then 'orientation' when 2 then 'marginTop' else 'showPageNumbers' end as property,
   case o_orderkey % 4 when 0 then case when o_totalprice > 100000 then 'letter' else 'A5' end when 1 then 'Landscape' when 2 then (o_orderkey % 120)::varchar else 'yes' end as value, case when o_orderkey % 4 = 2 then 'mm' end as unit, (1 + o_orderkey % 6)::integer as priority, o_orderkey as seq from orders)"""


@query(with_(SETTING_RULES) + """, clean as (select *, case property when 'pageSize' then 'Letter' when 'orientation' then 'landscape' when 'showPageNumbers' then 'true' else value end as v from srules where case property when 'pageSize' then value = 'letter' when 'marginTop' then value::double <= 100 else true end),
best as (select * from (select *, row_number() over (partition by doc_id, property order by priority, seq) as n from clean) where n = 1)
select doc_id, max(case when property = 'pageSize' then v end) as "pageSize", max(case when property = 'orientation' then v end) as orientation, max(case when property = 'marginTop' then round(v::double * 0.1, 6) end) as "marginTopCm", max(case when property = 'showPageNumbers' then v end) as "showPageNumbers" from best group by 1""")
def w3_page_settings(spark, d):
    k = F.col("o_orderkey") % 4
    r = table(spark, d, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.lit("Document").alias("target"), F.when(k == 0, "pageSize").when(k == 1, "orientation").when(k == 2, "marginTop").otherwise("showPageNumbers").alias("property"),
        F.when(k == 0, F.when(F.col("o_totalprice") > 100000, "letter").otherwise("A5")).when(k == 1, "Landscape").when(k == 2, (F.col("o_orderkey") % 120).cast("string")).otherwise("yes").alias("value"),
        F.when(k == 2, "mm").alias("unit"), (1 + F.col("o_orderkey") % 6).cast("int").alias("priority"), F.lit("x").alias("source"), F.col("o_orderkey").alias("seq"),
    )
    return R.settings(r, ["doc_id"]).select("doc_id", "pageSize", "orientation", F.round("marginTopCm", 6).alias("marginTopCm"), "showPageNumbers")


TARGET_SQL = "case when type = 'heading' then 'Heading ' || coalesce(level, 1) when type = 'list' then 'List' when type = 'table' then 'Table' when type = 'image' then 'Image' when type = 'caption' then 'Caption' when type = 'page_break' then 'PageBreak' else 'Paragraph' end"
OWN = "ownrules as (select doc_id, element_id as target, case ord % 3 when 0 then 'bold' when 1 then 'color' else 'alignment' end as property, case ord % 3 when 0 then 'true' when 1 then '#00ff00' else 'right' end as value, ord::bigint as seq from elements where own)"


def own_rules(spark, d):
    o = F.col("ord") % 3
    return elements(spark, d).where("own").select("doc_id", F.col("element_id").alias("target"), F.when(o == 0, "bold").when(o == 1, "color").otherwise("alignment").alias("property"), F.when(o == 0, "true").when(o == 1, "#00ff00").otherwise("right").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(R.LIVE_OVERRIDE).alias("priority"), F.lit("live_override").alias("source"), F.col("ord").cast("long").alias("seq"))


@query(with_(ELEMENTS) + f"select {TARGET_SQL} as target, count(*) as n from elements group by 1")
def d3_style_targets(spark, d):
    return elements(spark, d).groupBy(R.target_of(F.col("type"), F.col("level")).alias("target")).agg(F.count("*").alias("n"))


@query(with_(ELEMENTS, OWN) + f"select e.doc_id, e.element_id, case when r.target is not null then e.element_id else {TARGET_SQL} end as style_ref from elements e left join (select distinct doc_id, target from ownrules) r on r.doc_id = e.doc_id and r.target = e.element_id")
def j11_style_refs(spark, d):
    return R.style_ref(elements(spark, d).drop("style_ref"), own_rules(spark, d)).select("doc_id", "element_id", F.col("styleRef").alias("style_ref"))


@query(with_(ELEMENTS, OWN) + "select r.doc_id, r.target as element_id, r.property, r.value as current, case when property = 'bold' then 'false' when property = 'color' then '#00ff00' else 'left' end as required from ownrules r join elements e on e.doc_id = r.doc_id and e.element_id = r.target where e.type = 'paragraph' and property <> 'color'")
def j12_override_conflicts(spark, d):
    incoming = spark.createDataFrame([("Paragraph", "bold", "true", None, 5, "t", 0), ("Paragraph", "bold", "false", None, 2, "i", 1), ("Paragraph", "color", "#00ff00", None, 2, "i", 2), ("Paragraph", "alignment", "left", None, 2, "i", 3), ("Paragraph", "alignment", "right", None, 2, "i", 4)], R.RULES)
    return R.conflicts(elements(spark, d), own_rules(spark, d), incoming).select("doc_id", "element_id", "property", F.col("currentValue").alias("current"), F.col("requiredValue").alias("required"))


@query(with_(ELEMENTS, OWN) + "select r.doc_id, r.target, r.property from ownrules r where r.target in (select element_id from elements where type <> 'image')")
def o10_pruned_rules(spark, d):
    return R.prune(own_rules(spark, d), elements(spark, d).where("type != 'image'")).select("doc_id", "target", "property")


@query(with_(ELEMENTS, OWN, default_values()) + ", w as (select distinct doc_id from ownrules) select doc_id, count(*) as rules, sum(priority)::bigint as tiers from (select w.doc_id, 8 as priority from w, defaults union all select w.doc_id, 5 from w, (values (1), (2)) t(x) union all select doc_id, 1 from ownrules where property <> 'color') group by 1")
def m1_reformatted_rules(spark, d):
    own = own_rules(spark, d)
    template = spark.createDataFrame([("Paragraph", "fontSize", "12", "pt", 5, "template", 0), ("Quote", "italic", "false", None, 5, "template", 1)], R.RULES)
    none = template.limit(0)
    out = R.reformat(own, template, none, own.where("property = 'color'").select("doc_id", "target", "property"), ["doc_id"])
    return out.groupBy("doc_id").agg(F.count("*").alias("rules"), F.sum("priority").alias("tiers"))


@query(with_(ELEMENTS, OWN) + "select doc_id, target, property, value from ownrules where not (property = 'color' and seq % 2 = 0) union all select doc_id, target, property, 'red' from ownrules where property = 'color' and seq % 2 = 0")
def m2_override_upsert(spark, d):
    own = own_rules(spark, d)
    wanted = own.where("property = 'color' and seq % 2 = 0").select("doc_id", "target", "property", F.lit(" red ").alias("value"), "unit", "seq")
    lost = wanted.withColumn("target", F.lit("no such element"))
    return R.set_overrides(own, wanted.unionByName(lost), elements(spark, d)).select("doc_id", "target", "property", "value")


@query(with_(RULES) + "select target, property, arg_min(value, (priority, seq, doc_id)) as value from rules group by 1, 2")
def a18_first_by_priority(spark, d):
    return rules(spark, d).groupBy("target", "property").agg(F.min_by("value", F.struct("priority", "seq", "doc_id")).alias("value"))


VALUES = (("alignment", " Center ", None), ("alignment", "middle", None), ("bold", "YES", None), ("bold", "maybe", None), ("fontSize", "12.50", "pt"), ("fontSize", "0", "pt"), ("fontSize", "12", "em"), ("lineSpacing", "1.5", None), ("lineSpacing", "11", None), ("marginTop", "2.5", "cm"), ("marginTop", "12", "cm"), ("color", "#FFF", None), ("color", "plaid", None), ("fontFamily", "Times New Roman", None), ("fontFamily", "a;b", None), ("pageSize", "LETTER", None), ("imageWidth", "50", "%"), ("imageWidth", "101", "%"), ("borderTop", "solid  1.50pt red", None), ("borderTop", "wavy 1pt red", None), ("tabStops", "left 2.50cm ; right 5cm dot", None), ("tabStops", "up 2cm", None), ("header", "Page", None))
CLEANED = (("center", None), None, ("true", None), None, ("12.5", "pt"), None, None, ("1.5", None), None, ("2.5", "cm"), None, ("#FFF", None), None, ("Times New Roman", None), None, ("Letter", None), ("50", "%"), None, ("solid 1.5pt red", None), None, ("left 2.5cm; right 5cm dot", None), None, ("Page", None))


def literal(x) -> str:
    return "null" if x is None else "'" + x + "'"


@query("with v as (select * from (values " + ", ".join(f"({k}, {literal(p)}, {literal(v)}, {literal(c[0] if c else None)}, {literal(c[1] if c else None)})" for k, ((p, v, _), c) in enumerate(zip(VALUES, CLEANED))) + f") t(k, property, given, value, unit)) select l_orderkey, l_linenumber, case when l_linenumber = 1 then 'fontSize' else property end as property, case when l_linenumber = 1 then (l_partkey / 8)::double::varchar else given end as given, case when l_linenumber = 1 then case when l_partkey > 0 and l_partkey / 8 <= 400 then rtrim(rtrim(printf('%.4f', l_partkey / 8), '0'), '.') end else value end as value, case when l_linenumber = 1 then case when l_partkey > 0 and l_partkey / 8 <= 400 then 'pt' end else unit end as unit from lineitem join v on k = (l_orderkey + l_linenumber) % {len(VALUES)}")
def p13_clean_values(spark, d):
    """Values of all kinds, good and bad, and of each order's first line its part as a size in eighths of a point."""
    pick, first = (F.col("l_orderkey") + F.col("l_linenumber")) % len(VALUES), F.col("l_linenumber") == 1
    chosen = F.get(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(v).alias("v"), F.lit(u).cast("string").alias("u")) for p, v, u in VALUES)), pick)
    size = F.struct(F.lit("fontSize").alias("p"), (F.col("l_partkey") / 8).cast("string").alias("v"), F.lit("pt").alias("u"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(first, size).otherwise(chosen).alias("s")).select("l_orderkey", "l_linenumber", F.col("s.p").alias("property"), F.col("s.v").alias("given"), F.col("s.u").alias("u"))
    return rows.withColumn("c", U.clean_value(F.col("property"), F.col("given"), F.col("u"))).select("l_orderkey", "l_linenumber", "property", "given", "c.value", "c.unit")


@query("with u as (select distinct l_orderkey, 1 + l_partkey % 6 as level from lineitem) select l_orderkey, w.level, arg_min(u.level, (abs(u.level - w.level), -u.level)) as \"like\" from u, range(1, 7) w(level) group by all")
def o6_nearest_level(spark, d):
    """For each of six levels the nearest of those that an order's parts stand for."""
    from ..operators.segment import nearest_level

    used = table(spark, d, "lineitem").select("l_orderkey", (1 + F.col("l_partkey") % 6).alias("level"))
    return nearest_level(None, used, key="l_orderkey")



INFERRED = r"""unmarked as (select * replace (case when type = 'heading' and doc_id % 2 = 1 then 'paragraph' else type end as type) from elements),
looks as (select * exclude (size), length(content) % 4 + 10.0 as size, length(content) % 7 = 0 as bold from unmarked),
votes as (select doc_id, size, bold, sum(greatest(1, length(trim(content)))) as w, min(ord) as s, count(*) as n from looks where type = 'paragraph' and content <> '' group by 1, 2, 3),
body as (select doc_id, arg_min(size, (-w, s)) as body_size, arg_min(bold, (-w, s)) as body_bold, sum(n) as paragraphs from votes group by 1),
flat as (select *, trim(regexp_replace(content, '\s+', ' ', 'g')) as line from looks l where type = 'paragraph' and not exists (select 1 from unmarked h where h.doc_id = l.doc_id and h.type = 'heading')),
out as (select f.*, paragraphs, count(*) over (partition by f.doc_id) as n from flat f join body b on b.doc_id = f.doc_id
    where length(line) between 1 and 120 and len(string_split(line, ' ')) <= 15 and not regexp_matches(line, '[.,;]$') and (size >= body_size + 1 or (bold and not body_bold)))"""


@query(with_(ELEMENTS, INFERRED) + "select doc_id, element_id, least(6, dense_rank() over (partition by doc_id order by size desc, bold desc))::integer as level from out where n * 2 <= paragraphs")
def o5_inferred_levels(spark, d):
    """Heading levels inferred in documents that have no headings of their own; the headings of odd documents count as paragraphs that nobody has marked."""
    from ..operators import segment as S

    e = elements(spark, d).withColumn("type", F.when((F.col("type") == "heading") & (F.col("doc_id") % 2 == 1), "paragraph").otherwise(F.col("type")))
    e = e.withColumns({"size": (F.length("content") % 4 + 10.0), "bold": F.length("content") % 7 == 0, "italic": F.lit(False)})
    return S.inferred_levels(S.heading_candidates(e), e.where("type = 'paragraph' and content != ''"))
