"""Queries of editor values, reports and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import edits as E
from ..operators import fidelity as V
from ..operators import history as H
from ..operators import rules as R
from ..sources.tables import table
from .catalogue import query
from .relations import ELEMENTS, elements, with_

EDITED = """v as (select l_orderkey, l_linenumber, case l_linenumber % 5 when 0 then 'RGB( ' || (l_partkey % 300) || ', ' || (l_suppkey % 256) || ',7)' when 1 then ' #' || lpad(lower(hex(l_partkey)), 6, '0') || ' ' when 2 then 'rgba(1,2,3,' || case when l_partkey % 2 = 0 then '0.0' else '.5' end || ')' when 3 then 'Blue' else 'blurple' end as color,
case l_linenumber % 3 when 0 then '"' || l_returnflag || ' Serif", Georgia' when 1 then ' ''Part ' || l_partkey || '''' else '<b>,Arial' end as font, (l_partkey / 4)::double || case l_linenumber % 4 when 0 then 'px' when 1 then ' PT' when 2 then '' else 'em' end as size, l_partkey, l_suppkey, l_returnflag from lineitem)"""


@query(with_(EDITED) + """select l_orderkey, l_linenumber, case l_linenumber % 5 when 0 then '#' || lpad(hex(least(255, l_partkey % 300)), 2, '0') || lpad(hex(l_suppkey % 256), 2, '0') || '07' when 1 then '#' || lpad(hex(l_partkey), 6, '0') when 2 then case when l_partkey % 2 = 1 then '#010203' end when 3 then 'blue' end as color,
case l_linenumber % 3 when 0 then l_returnflag || ' Serif' when 1 then 'Part ' || l_partkey end as font, case when l_linenumber % 4 < 3 then case when s > 0 and s <= 400 then floor(s * 100 + 0.5) / 100 end end as size from (select *, l_partkey / 4 * case when l_linenumber % 4 = 0 then 0.75 else 1.0 end::double as s from v)""")
def d32_editor_values(spark, d):
    """Colours, font stacks and sizes as a browser gives them."""
    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    text = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    color = F.when(n % 5 == 0, text("RGB( ", p % 300, ", ", s % 256, ",7)")).when(n % 5 == 1, text(" #", F.lower(F.lpad(F.hex(p), 6, "0")), " ")).when(n % 5 == 2, text("rgba(1,2,3,", F.when(p % 2 == 0, "0.0").otherwise(".5"), ")")).when(n % 5 == 3, "Blue").otherwise("blurple")
    font = F.when(n % 3 == 0, text('"', F.col("l_returnflag"), ' Serif", Georgia')).when(n % 3 == 1, text(" 'Part ", p, "'")).otherwise("<b>,Arial")
    size = F.concat((p / 4).cast("string"), F.when(n % 4 == 0, "px").when(n % 4 == 1, " PT").when(n % 4 == 2, "").otherwise("em"))
    return table(spark, d, "lineitem").select("l_orderkey", n, X.editor_color(color).alias("color"), X.editor_font(font).alias("font"), X.editor_size(size).alias("size"))


FOUND = "f as (select l_orderkey, ['punctuation', 'words', 'number', 'duplicate', 'other', 'unit'][l_partkey % 6 + 1] as category from lineitem)"
RANKS = "case category " + " ".join(f"when '{c}' then {k}" for k, c in enumerate(V.CATEGORIES)) + f" else {len(V.CATEGORIES)} end"


@query(with_(FOUND) + f"select l_orderkey, string_agg(category || ' x' || n, ', ' order by r, category) as counts from (select l_orderkey, category, {RANKS} as r, count(*) as n from f group by all) group by 1")
def a19_ordered_counts(spark, d):
    """Differences of lines, counted in the order in which categories are told."""
    kinds = F.array(*map(F.lit, ("punctuation", "words", "number", "duplicate", "other", "unit")))
    found = table(spark, d, "lineitem").select("l_orderkey", F.get(kinds, F.col("l_partkey") % 6).alias("category"))
    told = F.transform("counts", lambda s: F.concat(s["category"], F.lit(" x"), s["n"].cast("string")))
    return V.category_counts(found, ["l_orderkey"]).select("l_orderkey", F.array_join(told, ", ").alias("counts"))


@query("select l_partkey as template_id, l_orderkey * 10 + l_linenumber as number, case when c_custkey is not null then case when c_custkey % 3 = 0 then c_custkey || '@example.org' else c_name end end as author_name from lineitem left join customer on c_custkey = l_suppkey * 7")
def j5_template_versions(spark, d):
    """Lines as versions of their parts' templates; some authors have only an address, some are gone."""
    k = F.col("c_custkey")
    users = table(spark, d, "customer").select(k, F.when(k % 3 != 0, F.col("c_name")).alias("name"), F.concat(k.cast("string"), F.lit("@example.org")).alias("email"))
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("template_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("number"), (F.col("l_suppkey") * 7).alias("by"))
    return H.listing(rows, users, author="by", user="c_custkey", name="name", email="email").select("template_id", "number", "author_name")


@query(with_(ELEMENTS) + "select doc_id, element_id, row_number() over (partition by doc_id order by ord desc) - 1 as ord, own, content from (select doc_id, element_id, ord, own, content from elements where ord % 5 <> 2 union all select doc_id, element_id || '+', ord - 1000000, null, 'new' from elements where ord % 7 = 3)")
def m13_saved_elements(spark, d):
    """An editor sends the lines in reverse, without every fifth, with new ones at the end and a mark of its own that does not count."""
    stored = elements(spark, d)
    kept = stored.where("ord % 5 != 2").select("doc_id", "element_id", (-F.col("ord")).alias("ord"), F.lit(None).cast("boolean").alias("own"), "content")
    new = stored.where("ord % 7 = 3").select("doc_id", F.concat("element_id", F.lit("+")).alias("element_id"), (1_000_000 - F.col("ord")).alias("ord"), F.lit(True).alias("own"), F.lit("new").alias("content"))
    rules = stored.select("doc_id", F.concat(F.lit("#"), "element_id").alias("target"), F.lit("bold").alias("property"), F.lit("true").alias("value"))
    out, _ = E.saved(stored, kept.unionByName(new), rules, ["own"])
    return out.select("doc_id", "element_id", "ord", "own", "content")


@query("""with c as (select conv_id, turn, text, conv_id * 1000 + turn as key, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') as w from conversations),
r as (select key, 'docx' as format, turn % 4 as k, w from c union all select key, 'pdf', turn % 4, w from c)
select key, format, case when k < 3 then format || '-export' end as method, case k when 0 then true when 1 then format = 'pdf' or false when 2 then len(w) = 0 end as verified from r""")
def v6_read_back(spark, d):
    """Exports as they were, with a word more, without their first word, and unreadable; a pdf may have more words, a docx not."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "turn", "text")
    k = F.col("turn") % 4
    read = F.when(k == 0, F.col("text")).when(k == 1, F.concat("text", F.lit(" surplus"))).when(k == 2, F.regexp_replace("text", r"(?U)^\W*\w+", ""))
    results = c.select("key", F.explode(F.array(F.lit("docx"), F.lit("pdf"))).alias("format"), read.alias("text"))
    documents = c.select("key", "text", F.col("text").alias("visible"))
    return V.read_back(documents, results, key="key").select("key", "format", "method", "verified")


@query("""with c as (select conv_id, turn, conv_id % 6 = 3 and exists (select 1 from conversations x where x.conv_id = c.conv_id and x.turn = 1) as clash, conv_id % 5 = 4 and exists (select 1 from conversations x where x.conv_id = c.conv_id and x.turn = 0) as bad from conversations c)
select conv_id as doc_id, case when bool_or(clash) then 'conflict' when bool_or(bad) then 'invalid' else 'done' end as outcome, count(*) filter (where turn % 4 = 0 and not clash and not bad) as proposals, count(*) + count(*) filter (where turn % 4 = 1 and not clash and not bad) as elements from c group by 1""")
def m14_instructed_documents(spark, d):
    """One instruction to all conversations: some have an override that it would change, some an operation that does not fit; in the others breaks are put in and deletions are proposed."""
    t, doc = F.col("turn"), F.col("conv_id")
    c = table(spark, d, "conversations").select(doc.alias("doc_id"), t.alias("ord"), t.cast("string").alias("element_id"), F.lit("paragraph").alias("type"), F.lit(None).cast("int").alias("level"), F.col("text").alias("content"))
    k = F.col("doc_id")
    rules = c.where((k % 3 == 0) & (F.col("ord") == 1)).select("doc_id", F.col("element_id").alias("target"), F.lit("bold").alias("property"), F.when(k % 6 == 0, "true").otherwise("false").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(R.LIVE_OVERRIDE).alias("priority"), F.lit("override").alias("source"), F.lit(0).cast("long").alias("seq"))
    given = spark.createDataFrame([("Paragraph", "bold", "true", None, R.INSTRUCTION, "instruction", 0)], "target string, property string, value string, unit string, priority int, source string, seq long")  # the one instruction
    none = F.lit(None).cast("string")
    op = F.when(F.col("ord") % 4 == 0, "delete").when(F.col("ord") % 4 == 1, "page_break")
    operations = c.select("doc_id", F.col("ord").alias("seq"), op.alias("op"), F.when(op == "delete", F.col("element_id")).alias("target"), F.when(op == "page_break", F.col("element_id")).alias("after_id"), none.alias("content"), none.alias("property"), none.alias("value")).where("op is not null")
    bad = c.where((k % 5 == 4) & (F.col("ord") == 0)).select("doc_id", F.lit(1_000_000).alias("seq"), F.lit("delete").alias("op"), F.lit("nowhere").alias("target"), none.alias("after_id"), none.alias("content"), none.alias("property"), none.alias("value"))
    waiting = operations.where("false").select("doc_id", "seq", "op", "target", "after_id", "content")
    out = E.instructed(c, rules, given, operations.unionByName(bad), waiting)
    told = c.select("doc_id").distinct()
    for name, column in (("conflicts", "conflict"), ("invalid", "invalid")):
        told = told.join(out[name].select("doc_id", F.lit(True).alias(column)).distinct(), "doc_id", "left")
    counts = [out[name].groupBy("doc_id").agg(F.count("*").alias(name)) for name in ("proposals", "elements")]
    told = told.join(counts[0], "doc_id", "left").join(counts[1], "doc_id", "left")
    outcome = F.when(F.col("conflict"), "conflict").when(F.col("invalid"), "invalid").otherwise("done")
    return told.select("doc_id", outcome.alias("outcome"), F.coalesce("proposals", F.lit(0)).cast("long").alias("proposals"), F.col("elements").cast("long").alias("elements"))
