"""Queries of what an import, an export or a rewording kept."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..operators import compare as C
from ..operators import fidelity as V
from ..sources.tables import table
from .catalogue import query
from .document_queries import PAIRS, pairs, versions
from .relations import ELEMENTS, elements, with_
from .text_queries import TOKENS, WORDS

#: Orders as reports, their lines as findings.
ITEMS = """items as (select l_orderkey as report, 'docx.f' || l_suppkey % 5 as feature, l_returnflag as reason, case l_partkey % 4 when 0 then 'lossy' when 1 then 'unsupported' when 2 then 'detected_preserved' else 'detected_not_editable' end as policy,
    case when l_partkey % 3 > 0 then 'e' || l_partkey % 7 end as element_id, 's' || l_partkey % 2 as source, l_partkey % 2 = 0 as changed, 1 + l_partkey % 3 as n, l_linenumber * 100000000000 + l_partkey * 10000 + l_suppkey as seq from lineitem)"""
GROUPED = """seen as (select report, feature, reason, element_id, min(seq) as first from items where element_id is not null group by 1, 2, 3, 4),
named as (select report, feature, reason, list(element_id order by first) as element_ids from seen group by 1, 2, 3),
grouped as (select g.*, coalesce(element_ids, []) as element_ids from (select report, feature, reason, arg_min(policy, seq) as policy, arg_min(source, seq) as source, arg_min(changed, seq) as changed, sum(n)::bigint as n from items group by 1, 2, 3) g left join named using (report, feature, reason))"""
REPORTS = "reports as (select o_orderkey as report, case o_orderkey % 3 when 1 then true when 2 then false end as verified from orders)"
CONTENT = "case when verified is null then 'unverified' when verified then 'verified' else 'changed' end"


def items(spark, d):
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    policy = F.when(p % 4 == 0, "lossy").when(p % 4 == 1, "unsupported").when(p % 4 == 2, "detected_preserved").otherwise("detected_not_editable")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("report"), F.concat(F.lit("docx.f"), (s % 5).cast("string")).alias("feature"), F.col("l_returnflag").alias("reason"), policy.alias("policy"),
        F.when(p % 3 > 0, F.concat(F.lit("e"), (p % 7).cast("string"))).alias("element_id"), F.concat(F.lit("s"), (p % 2).cast("string")).alias("source"), (p % 2 == 0).alias("changed"), (1 + p % 3).alias("n"),
        (F.col("l_linenumber").cast("long") * 100000000000 + p * 10000 + s).alias("seq"),
    )


def reports(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("report"), F.when(k % 3 == 1, True).when(k % 3 == 2, False).alias("verified"))


@query(with_(ITEMS, GROUPED) + "select report, feature, reason, policy, source, changed, n, array_to_string(element_ids, ',') as elements from grouped")
def a10_grouped_findings(spark, d):
    out = V.grouped(items(spark, d), ["report"])
    return out.select("report", "feature", "reason", "policy", "source", "changed", "n", F.array_join("element_ids", ",").alias("elements"))


@query(with_(ITEMS, GROUPED, REPORTS) + f"select r.report, {CONTENT} as content, count(*) filter (where policy in ('lossy', 'unsupported', 'blocked')) as review, count(*) filter (where policy in ('lossy', 'unsupported', 'blocked') and changed) as loss from reports r left join grouped g on g.report = r.report group by 1, 2")
def a11_report_status(spark, d):
    return V.status(reports(spark, d), V.grouped(items(spark, d), ["report"]), ["report"])


@query(with_(ITEMS, GROUPED, REPORTS) + f"select report, {CONTENT} as content, (row_number() over (partition by report order by feature, policy, n, changed) - 1)::integer as place, feature, policy, n, changed from grouped join reports using (report)")
def a12_claims(spark, d):
    out = V.claims(reports(spark, d), V.grouped(items(spark, d), ["report"]), ["report"])
    return out.select("report", "content", F.posexplode("items").alias("place", "i")).select("report", "content", "place", "i.feature", "i.policy", "i.n", "i.changed")


KEPT = (("docx.f0", "detected_not_editable", "kept in the original", None), ("docx.f1", "detected_not_editable", None, " (kept while unchanged)"), ("docx.f2", None, None, None))


@query(with_(ITEMS) + """, moved as (select * replace (case when feature in ('docx.f0', 'docx.f1') then 'detected_not_editable' else policy end as policy, case feature when 'docx.f0' then 'kept in the original' when 'docx.f1' then reason || ' (kept while unchanged)' else reason end as reason, case when feature = 'docx.f0' then false else changed end as changed) from items)
select report, feature, reason, arg_min(policy, seq) as policy, arg_min(changed, seq) as changed, sum(n)::bigint as n from moved group by 1, 2, 3""")
def v5_reclassified(spark, d):
    kept = spark.createDataFrame(list(KEPT), "feature string, policy string, reason string, suffix string")
    return V.reclassified(items(spark, d), kept, ["report"]).select("report", "feature", "reason", "policy", "changed", "n")


@query(with_(ELEMENTS) + r"""select doc_id, type as feature, count(*) as n, 'e.g. “' || arg_min(case when length(t) > 60 then substr(t, 1, 60) || '…' else t end, ord) filter (where t <> '') || '”' as example from (select *, trim(regexp_replace(content, '\s+', ' ', 'g')) as t from elements) group by 1, 2""")
def a20_counted_findings(spark, d):
    rows = elements(spark, d).select("doc_id", F.col("type").alias("feature"), F.lit(1).alias("n"), F.col("content").alias("text"), F.col("ord").alias("seq"))
    return V.findings(rows, ["doc_id"])


SECTIONS = """s as (select o_custkey as doc_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as section, row_number() over (partition by o_custkey order by o_orderkey desc) = 1 as last, o_orderpriority as setup, case o_orderkey % 4 when 0 then 'evenPage' when 1 then 'nextPage' end as break_type,
    case when o_orderkey % 5 = 0 then o_orderkey % 2 end as start, case when o_orderkey % 7 = 0 then 'lowerRoman' when o_orderkey % 7 = 1 then 'decimal' end as format, o_orderkey % 9 = 0 as borders, o_orderkey % 11 = 0 as line_numbers, case when o_orderkey % 6 = 0 then 'center' when o_orderkey % 6 = 1 then 'top' end as valign from orders),
m as (select s.*, l.setup as main from s join s l on l.doc_id = s.doc_id and l.last),
c as (select doc_id, count(*) filter (where not last and setup <> main) as section_setup, count(*) filter (where {0} and section > 0 and break_type = 'evenPage') as section_break, count(*) filter (where {0} and ((start is not null and (section > 0 or start <> 1)) or coalesce(format, 'decimal') <> 'decimal')) as page_numbering,
    count(*) filter (where {0} and borders) as page_borders, count(*) filter (where {0} and line_numbers) as line_numbers, count(*) filter (where {0} and coalesce(valign, 'top') <> 'top') as vertical_alignment from m group by 1)"""


def sections(spark, d):
    k, w = F.col("o_orderkey"), W.partitionBy("o_custkey")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("doc_id"), (F.row_number().over(w.orderBy("o_orderkey")) - 1).alias("section"), (F.row_number().over(w.orderBy(F.desc("o_orderkey"))) == 1).alias("last"), F.col("o_orderpriority").alias("setup"),
        F.when(k % 4 == 0, "evenPage").when(k % 4 == 1, "nextPage").alias("break_type"), F.when(k % 5 == 0, k % 2).alias("start"), F.when(k % 7 == 0, "lowerRoman").when(k % 7 == 1, "decimal").alias("format"),
        (k % 9 == 0).alias("borders"), (k % 11 == 0).alias("line_numbers"), F.when(k % 6 == 0, "center").when(k % 6 == 1, "top").alias("valign"),
    )


@query(with_(SECTIONS.format("true")) + "select doc_id, feature, n from (unpivot c on section_setup, section_break, page_numbering, page_borders, line_numbers, vertical_alignment into name feature value n) where n > 0")
def a21_section_findings(spark, d):
    return V.section_findings(sections(spark, d), key="doc_id")


@query(with_(SECTIONS.format("not last")) + "select doc_id, feature, n from (unpivot c on section_setup, section_break, page_numbering, page_borders, line_numbers, vertical_alignment into name feature value n) where n > 0")
def a21_earlier_sections(spark, d):
    return V.section_findings(sections(spark, d), key="doc_id", last_too=False)


MARKS = "m as (select conv_id as doc_id, turn, unnest(case turn % 3 when 0 then ['bold', 'italic'] when 1 then ['bold'] else [] end) as mark from conversations)"


def marked_runs(spark, d):
    t = F.col("turn") % 3
    marks = F.when(t == 0, F.array(F.lit("bold"), F.lit("italic"))).when(t == 1, F.array(F.lit("bold"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", marks.alias("marks"))


@query(with_(MARKS) + "select doc_id, mark, count(*) as n from m group by 1, 2")
def a22_mark_counts(spark, d):
    return V.mark_counts(marked_runs(spark, d))


@query(with_(MARKS) + ", a as (select doc_id, mark, count(*) as n from m group by 1, 2), b as (select doc_id, mark, count(*) as n from m where turn % 7 <> 3 group by 1, 2) select doc_id, mark, coalesce(a.n, 0) as before, coalesce(b.n, 0) as after from a full join b using (doc_id, mark) where coalesce(a.n, 0) <> coalesce(b.n, 0)")
def v8_mark_changes(spark, d):
    runs = marked_runs(spark, d)
    return V.count_changes(V.mark_counts(runs), V.mark_counts(runs.where("turn % 7 != 3")), ["doc_id", "mark"])


@query("""with w as (select l_orderkey as doc_id, l_returnflag as target, l_linestatus as css, max(l_quantity) as q from lineitem group by 1, 2, 3), used as (select distinct doc_id, target from w where (doc_id + ascii(target)) % 5 > 0)
select doc_id, target, css, q::integer || '.0pt' as want, case when doc_id % 4 <> 1 then case when doc_id % 3 = 0 then '99pt' else q::integer || 'PT' end end as got from w join used using (doc_id, target) where doc_id % 4 = 1 or (doc_id % 3 = 0 and q <> 99)""")
def v8_look_changes(spark, d):
    w = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("target"), F.col("l_linestatus").alias("css")).agg(F.max("l_quantity").cast("int").cast("string").alias("q"))
    want = w.select("doc_id", "target", "css", F.concat("q", F.lit(".0pt")).alias("value"))
    got = w.where("doc_id % 4 != 1").select("doc_id", "target", "css", F.when(F.col("doc_id") % 3 == 0, "99pt").otherwise(F.concat("q", F.lit("PT"))).alias("value"))
    return V.look_changes(want, got, w.where((F.col("doc_id") + F.ascii("target")) % 5 > 0), ["doc_id", "target"])


@query("select o_orderkey as doc_id, p as property, b as before, a as after from (select o_orderkey, 'title' as p, o_orderpriority as b, case when o_orderkey % 4 > 0 then o_orderpriority end as a from orders union all select o_orderkey, 'author', case when o_orderkey % 3 = 0 then o_clerk end, 'x' from (select *, o_orderstatus as o_clerk from orders)) where a is distinct from b")
def v8_property_changes(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")

    def rows(df, name, value):
        return df.select(k.alias("doc_id"), F.lit(name).alias("property"), value.alias("value"))

    before = rows(o, "title", F.col("o_orderpriority")).unionByName(rows(o.where(k % 3 == 0), "author", F.col("o_orderstatus")))
    after = rows(o.where(k % 4 > 0), "title", F.col("o_orderpriority")).unionByName(rows(o, "author", F.lit("x")))
    return V.property_changes(before, after, ["doc_id", "property"])


@query()
def v8_structure_changes(spark, d):
    """Blocks of two versions, lined up; tests/test_fidelity.py has the plain model."""
    none = F.lit(None).cast("array<int>")

    def lines(df):
        return df.select("doc_id", "ord", V.block_line(F.col("type"), F.col("level"), F.lit(False), none, none).alias("line"))

    before, after = versions(spark, d)
    return V.structure_changes(lines(before), lines(after)).select("doc_id", "nth", "tag", F.array_join("before", " | ").alias("before"), F.array_join("after", " | ").alias("after"))


CHECKED = PAIRS + f", t as (select conv_id, turn, {TOKENS.format(t='source')} as a, {TOKENS.format(t='result')} as b from pairs)"


@query(f"with {CHECKED} select conv_id, turn, len(a)::bigint as source_tokens, len(b)::bigint as result_tokens, a = b as verified, (a <> b)::bigint as differences, a <> b and (turn % 3 = 1 or regexp_matches(a[1], '\\p{{Nd}}')) as protected from t")
def v2_text_checks(spark, d):
    """One run of tokens comes in or goes in each pair that differs, so SQL can tell what the differences are."""
    return V.check_text(pairs(spark, d), keys=["conv_id", "turn"], source="source", result="result").drop("summary")


NEGATIONS = ", ".join("'" + n + "'" for n in X.NEGATIONS)


@query(f"""with {CHECKED}, x as (select turn, a, b, case when turn % 3 = 1 then 'number' when regexp_matches(a[1], '\\p{{Nd}}') then 'number' when lower(a[1]) in ({NEGATIONS}) or ends_with(lower(a[1]), 'n''t') then 'negation' else 'words' end as category, case when turn % 3 = 1 then 'added' else 'missing' end as kind from t where a <> b)
select kind, category, count(*) as n from x group by 1, 2""")
def v3_difference_categories(spark, d):
    found = V.token_edits(pairs(spark, d), keys=["conv_id", "turn"], source="source", result="result")
    return found.groupBy("kind", "category").agg(F.count("*").alias("n"))


def header_words(name: str, k: int) -> str:
    return f"{name} as (select conv_id, turn * 1000000 + i as pos, ws[i] as word from (select *, unnest(range(1, len(ws) + 1)) as i from (select conv_id, turn, {WORDS.format('text')} as ws from conversations where turn % 2 = {k})))"


@query("with " + header_words("a", 0) + ", " + header_words("b", 1) + r""", x as (select *, row_number() over (partition by conv_id, word order by pos) as n from a), y as (select *, row_number() over (partition by conv_id, word order by pos) as n from b),
l as (select x.*, row_number() over (partition by conv_id order by pos) as nth from x anti join y using (conv_id, word, n) where not regexp_full_match(word, '\p{Nd}+'))
select conv_id, count(*) as n, string_agg(word, ' ' order by pos) filter (where nth <= 40) as source from l group by 1""")
def v4_lost_header_words(spark, d):
    c = table(spark, d, "conversations")

    def rows(k):
        own = c.where(F.col("turn") % 2 == k).select("conv_id", "turn", F.posexplode(X.words(F.col("text"))).alias("p", "word"))
        return own.select("conv_id", (F.col("turn") * 1000000 + F.col("p") + 1).alias("at"), "word")

    return V.lost_words(rows(0), rows(1), key="conv_id")


SCRIPT_SQL = "concat_ws(', ', " + ", ".join(f"case when bool_or(regexp_matches(content, '{p}')) then '{n}' end" for n, p in V.UNSHAPED) + ")"


@query(with_(ELEMENTS) + f""", e as (select *, case when ord % 5 = 1 then content || chr(1513) when ord % 9 = 2 then content || chr(20013) else content end as text_ from elements),
f as (select doc_id, {SCRIPT_SQL.replace('content', 'text_')} as scripts, bool_or(ord % 13 = 4) as tabs, bool_or(ord % 8 = 3) as sides, bool_or(ord % 6 = 5) as alts, coalesce(sum(case when ord % 10 = 7 then len({WORDS.format('text_')}) end), 0) as hidden, bool_or(ord % 12 = 6) as spaced, bool_or(ord % 15 = 8) as waved from e group by 1)
select doc_id, 'export.pdf.' || feature as feature, policy, detail from (select doc_id, 'script' as feature, 'lossy' as policy, scripts as detail from f where scripts <> '' union all select doc_id, 'hidden_text', 'detected_preserved', hidden::bigint::varchar from f where hidden > 0
 union all select doc_id, 'tab_stops', 'lossy', null from f where tabs union all select doc_id, 'paragraph_borders', 'lossy', null from f where sides union all select doc_id, 'alt_text', 'lossy', null from f where alts union all select doc_id, 'character_spacing', 'lossy', null from f where spaced union all select doc_id, 'underline_style', 'lossy', null from f where waved)""")
def v6_export_notes(spark, d):
    o = F.col("ord")
    text = F.when(o % 5 == 1, F.concat("content", F.lit(chr(1513)))).when(o % 9 == 2, F.concat("content", F.lit(chr(20013)))).otherwise(F.col("content"))
    e = elements(spark, d).withColumn("content", text)
    css = F.map_from_entries(F.array_compact(F.array(F.when(o % 13 == 4, F.struct(F.lit("--tab-stops"), F.lit("left 2cm"))), F.when(o % 8 == 3, F.struct(F.lit("border-left"), F.lit("solid 1pt red"))), F.when(o % 8 == 4, F.struct(F.lit("border-left"), F.lit("none"))))))
    own = e.select("doc_id", "type", "content", css.alias("css"), F.when(o % 6 == 5, "a view").alias("alt"), F.lit(False).alias("note"))
    runs = e.select("doc_id", F.col("content").alias("text"), (o % 10 == 7).alias("hidden"), F.when(o % 12 == 6, 1.5).alias("letter_spacing"), F.when(o % 15 == 8, "wavy").when(o % 15 == 9, "single").alias("line_style"))
    return V.export_notes(own, runs)


@query("with " + PAIRS + f", w as (select conv_id, turn, {WORDS.format('source')} as a, {WORDS.format('result')} as b from pairs) select conv_id, turn, len(a)::bigint as source_words, len(b)::bigint as result_words, a = b as verified, case when a <> b and turn % 3 = 2 then 1 else 0 end::bigint as missing, case when turn % 3 = 1 then 3 else 0 end::bigint as added, 0::bigint as moved, case when turn % 3 = 1 then 'and 17 more' when a <> b then a[1] end as said from w")
def v1_word_check(spark, d):
    """One run of words comes in or goes in each pair that differs, so SQL can tell what the differences are."""
    out = C.compare_words(pairs(spark, d), keys=["conv_id", "turn"], source="source", result="result")
    first = F.get("samples", F.lit(0))
    return out.withColumn("said", F.concat(first["source"], first["result"])).drop("samples")
