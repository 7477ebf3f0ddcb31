"""Queries on texts: segmentation, words, numbers, links, packing, sources."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbering as N
from ..functions import text as X
from ..functions import units as U
from ..operators import segment as S
from ..operators.compare import bag_missing_after, subsequences, windows_in
from ..sources.tables import table
from .catalogue import query

#: DuckDB forms of what the scalar functions do.
WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\p{{Nl}}\p{{No}}]+')"
SQUEEZED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
BLOCKS = r"list_filter(list_transform(string_split_regex(trim(replace({0}, chr(13), chr(10)), ' ' || chr(9) || chr(10)), '\n\s*\n'), lambda b: trim(b, ' ' || chr(9) || chr(10))), lambda b: b <> '')"
SEGMENTS = "segments as (select doc_id, ord, case when ord = 0 and not contains(block, chr(10)) and length(flat) <= 80 and not regexp_matches(flat, '[.!?]$') then 'heading' else 'paragraph' end as type, flat as content from (select doc_id, ord, block, " + SQUEEZED.format("block") + " as flat from (select doc_id, unnest(b) as block, generate_subscripts(b, 1) - 1 as ord from (select doc_id, " + BLOCKS.format("replace(text, chr(10), chr(10) || chr(10))") + " as b from documents))))"


def segments(spark, d):
    """The corpus has no blank lines, so its line ends are doubled first."""
    return S.segment(table(spark, d, "documents").select("doc_id", "text"), doc="doc_id", text=F.replace("text", F.lit("\n"), F.lit("\n\n")))


@query("with " + SEGMENTS + " select doc_id, count(*) as elements, count(*) filter (where type = 'heading') as headings, sum(length(content))::bigint as chars from segments group by 1")
def s11_segment_counts(spark, d):
    return segments(spark, d).groupBy("doc_id").agg(F.count("*").alias("elements"), F.count_if(F.col("type") == "heading").alias("headings"), F.sum(F.length("content")).cast("long").alias("chars"))


@query("with " + SEGMENTS + " select doc_id, ord::integer as ord, type, content from segments")
def s11_segment_elements(spark, d):
    return segments(spark, d).select("doc_id", "ord", "type", "content")


@query("with " + SEGMENTS + " select doc_id, ord::integer as ord, case when doc_id % 2 = 0 then type else 'paragraph' end as type from segments")
def g3_first_chunk_heading(spark, d):
    out = S.segment(table(spark, d, "documents").select("doc_id", "text"), doc="doc_id", text=F.replace("text", F.lit("\n"), F.lit("\n\n")), first=F.col("doc_id") % 2 == 0)
    return out.select("doc_id", "ord", "type")


def packed_sql(block: str, limit: int, marks: tuple[str, ...]) -> str:
    """Chunks of at most `limit` characters: blocks that are longer are cut at the last of the first marks that is there, else between any two."""
    head = f"substr(rest, 1, {limit + 1})"
    last = [f"length({head}) - instr(reverse({head}), {m})" for m in marks]
    place = "case " + " ".join(f"when instr({head}, {m}) > 0 then {at}" for m, at in zip(marks, last)) + f" else {limit} end"
    skip = "case when " + " or ".join(f"instr({head}, {m}) > 0" for m in marks) + " then 2 else 1 end"
    return f"""with recursive texts as (select doc_id, trim({block}, ' ' || chr(9) || chr(10)) as whole from documents),
blocks as (select doc_id, unnest(b) as rest, generate_subscripts(b, 1) as rn from (select doc_id, {BLOCKS.format('whole')} as b from texts where length(whole) > {limit})),
cut as (select doc_id, rn, 0 as k, case when length(rest) > {limit} then substr(rest, 1, {place}) else rest end as piece, case when length(rest) > {limit} then substr(rest, {place} + {skip}) else '' end as rest from blocks
 union all select doc_id, rn, k + 1, case when length(rest) > {limit} then substr(rest, 1, {place}) else rest end, case when length(rest) > {limit} then substr(rest, {place} + {skip}) else '' end from cut where rest <> ''),
pieces as (select doc_id, length(piece) as size, row_number() over (partition by doc_id order by rn, k) as nth from cut),
fold as (select doc_id, nth, size, 0 as chunk from pieces where nth = 1
 union all select p.doc_id, p.nth, case when f.size + 2 + p.size > {limit} then p.size else f.size + 2 + p.size end, case when f.size + 2 + p.size > {limit} then f.chunk + 1 else f.chunk end from pieces p join fold f on p.doc_id = f.doc_id and p.nth = f.nth + 1),
chunks as (select doc_id, chunk::integer as chunk_no, max(size)::bigint as chars from fold group by 1, 2 union all select doc_id, 0, length(whole) from texts where length(whole) between 1 and {limit}) """


@query(packed_sql("replace(text, chr(10), chr(10) || chr(10))", 9000, ("' '",)) + "select doc_id, chunk_no, chars from chunks")
def g1_packed_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return S.chunks(docs, doc="doc_id", text="text", limit=9000).select("doc_id", "chunk_no", F.length("chunk").cast("long").alias("chars"))


@query(packed_sql("text", 500, ("chr(10)", "' '")) + "select doc_id, count(*) as chunks, max(chars)::integer as longest from chunks group by 1")
def g2_cut_chunks(spark, d):
    out = S.chunks(table(spark, d, "documents").select("doc_id", "text"), doc="doc_id", text="text", limit=500)
    return out.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("chunk")).alias("longest"))


@query("select doc_id, len(" + WORDS.format("text") + ")::bigint as words from documents")
def d4_word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.words(F.col("text"))).cast("long").alias("words"))


@query("select lower(w) as word, count(*) as n, count(distinct doc_id) as docs from (select doc_id, unnest(" + WORDS.format("text") + ") as w from documents) group by 1")
def d4_word_frequencies(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(X.words(F.col("text"))).alias("w"))
    return w.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


NUMBERS = r"regexp_extract_all(text, '[-+]?\p{Nd}+(?:[.,:/-]\p{Nd}+)*%?')"


@query("select doc_id, len(list_filter(" + NUMBERS + ", lambda x: true)) > 0 as has_numbers from documents")
def d7_documents_with_numbers(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.size(X.number_facts(F.col("text"))) > 0).alias("has_numbers"))


W_ = r"[\p{L}\p{M}\p{Nd}\p{Pc}\p{Nl}\p{No}]"
PLAIN = "{t}"
for _variants, _plain in X.VARIANTS:
    PLAIN = f"translate({PLAIN}, '" + _variants.replace("'", "''") + "', '" + _plain.replace("'", "''") * len(_variants) + "')"
PLAIN = f"regexp_replace(replace({PLAIN}, '…', '...'), '" + X.LINE_MARKS.replace("(?mU)", "(?m)").replace("{", "{{").replace("}", "}}") + "', '', 'g')"
NUMBER_SQL = r"[-+]?\p{Nd}+(?:[.,:/-]\p{Nd}+)*%?"
TOKENS = f"regexp_extract_all({PLAIN}, '" + f"{NUMBER_SQL}|{W_}+(?:[\\x27-]{W_}+)*|[^{W_[1:-1]}\\s]".replace("{", "{{").replace("}", "}}") + "')"
KIND_OF = f"case when regexp_full_match(t, '{NUMBER_SQL}') then 'number' when regexp_matches(t, '^{W_}') then 'word' else 'mark' end"
KINDS = f"select {KIND_OF} as kind, count(*) as n from (select unnest({TOKENS.format(t='text')}) as t from documents) group by 1"


@query(KINDS)
def d7_token_kinds(spark, d):
    t = table(spark, d, "documents").select(F.explode(X.tokens(F.col("text"))).alias("t"))
    return t.groupBy(X.token_kind(F.col("t")).alias("kind")).agg(F.count("*").alias("n"))


@query("select lower(w) as word, count(*) as n from (select unnest(" + WORDS.format("text") + ") as w from documents) where lower(w) in ('not','no','never','none','nothing','nobody','nowhere','neither','nor','without','cannot','не','няма','никога','нито','никой','никоя','никое','никои','нищо','никъде','без') group by 1")
def d8_negations(spark, d):
    w = table(spark, d, "documents").select(F.explode(X.words(F.col("text"))).alias("w")).where(X.is_negation(F.col("w")))
    return w.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"))


def previews(n: int, q: bool) -> str:
    flat = SQUEEZED.format("text")
    cut = f"case when length({flat}) > {n} then substr({flat}, 1, {n}) || '…' else {flat} end"
    return "select doc_id, " + (f"'“' || {cut} || '”'" if q else cut) + " as preview from documents"


@query(previews(60, True))
def d9_health_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query(previews(80, False))
def d10_compare_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", X.preview(F.col("text"), 80, quoted=False).alias("preview"))


@query("select l_orderkey, l_linenumber, size, case l_linenumber % 4 when 3 then 0 else case when l_linenumber % 4 in (1, 2) then 0.75 else 1.0 end * l_partkey / 4 end::double as points from (select *, case l_linenumber % 4 when 0 then (l_partkey / 4)::double || 'pt' when 1 then (l_partkey / 4)::double || 'px' when 2 then (l_partkey / 4)::double || ' px' else 'large ' || l_partkey end as size from lineitem)")
def d11_points(spark, d):
    n, k = (F.col("l_partkey") / 4).cast("string"), F.col("l_linenumber") % 4
    size = F.when(k == 0, F.concat(n, F.lit("pt"))).when(k == 1, F.concat(n, F.lit("px"))).when(k == 2, F.concat(n, F.lit(" px"))).otherwise(F.concat(F.lit("large "), F.col("l_partkey").cast("string")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", size.alias("size"), X.points(size).alias("points"))


HREFS = ("", "www.example.org", "javascript:alert(1)", "mailto:nobody", "http://localhost/x", "http://intranet/x", "tel:+359", "/relative", "data:text/html,x")


@query("select page_id, k, regexp_extract(lower(full_), '^([a-z][a-z0-9+.-]*):', 1) in ('http','https','ftp','ftps','mailto','tel','callto','sms','xmpp') and length(full_) > 0 as safe, case when scheme in ('http','https','ftp','ftps') then contains(host, '.') or host = 'localhost' when scheme = 'mailto' then contains(full_, '@') when scheme = 'tel' then true else false end as usable from (select *, regexp_extract(lower(full_), '^([a-z][a-z0-9+.-]*):', 1) as scheme, regexp_extract(lower(full_), '^[a-z]+://([^/?#:]*)', 1) as host from (select page_id, k, case when lower(trim(href)) like 'www.%' then 'https://' || trim(href) else coalesce(trim(href), '') end as full_ from (select page_id, k, case k when 0 then url when 1 then ' ' || upper(url) || ' ' when 2 then 'mailto:p' || page_id || '@example.org' else " + str(list(HREFS)) + "[page_id % 9 + 1] end as href from pages, range(4) t(k))))")
def p10_link_policy(spark, d):
    """Addresses of pages, the same in capitals, mail addresses, and one of a few that are odd."""
    url, page = F.col("url"), F.col("page_id")
    hrefs = F.array(url, F.concat(F.lit(" "), F.upper(url), F.lit(" ")), F.concat(F.lit("mailto:p"), page.cast("string"), F.lit("@example.org")), F.get(F.array(*map(F.lit, HREFS)), page % 9))
    rows = table(spark, d, "pages").select("page_id", F.posexplode(hrefs).alias("k", "href"))
    return rows.select("page_id", "k", X.safe_href(F.col("href")).isNotNull().alias("safe"), X.usable_link(F.col("href")).alias("usable"))


@query("select page_id, regexp_extract(url, '^([a-z]+):', 1) as scheme, regexp_extract(url, '^([a-z]+):', 1) in ('http','https') as safe from pages")
def p11_url_schemes(spark, d):
    safe = X.safe_href(F.col("url"))
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+):", 1).alias("scheme"), safe.isNotNull().alias("safe"))


COLORS = ("#12345G", "red", "Blue ", "rgb(1,2,3)", "", "grey", "a;b")


@query("select l_orderkey, l_linenumber, regexp_full_match(trim(v), '#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})') or lower(trim(v)) in ('red','blue','green','black','white','gray','grey','yellow','orange','purple') as ok, regexp_full_match(trim(v), '[\\p{L}\\p{Nd}_][\\p{L}\\p{Nd}_ .\\-]*') as font from (select *, case l_linenumber % 3 when 0 then '#' || hex(l_partkey) when 1 then l_returnflag || ' ' || l_partkey else " + str(list(COLORS)) + "[l_partkey % 7 + 1] end as v from lineitem)")
def p12_colors_and_fonts(spark, d):
    """Numbers as hexadecimal colours of as many digits as they have, flags and numbers as fonts, and a few that are odd."""
    k, p = F.col("l_linenumber") % 3, F.col("l_partkey")
    v = F.when(k == 0, F.concat(F.lit("#"), F.hex(p))).when(k == 1, F.concat_ws(" ", "l_returnflag", p.cast("string"))).otherwise(F.get(F.array(*map(F.lit, COLORS)), p % 7))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.is_color(v).alias("ok"), X.is_font_name(v).alias("font"))


MARKDOWN_SQL = "(regexp_matches(text, '(?m)^ {0,3}#{1,6}(?:\\s+\\S|\\s*$)') or regexp_matches(text, '(?m)^ {0,3}(`{3,}|~{3,})') or regexp_matches(text, '(?m)^\\s*\\|?\\s*:?-+:?\\s*(\\|\\s*:?-+:?\\s*)+\\|?\\s*$') or (regexp_matches(text, '(\\*\\*[^*\\n]+\\*\\*|\\*[^*\\n]+\\*)')::int + regexp_matches(text, '(?m)^ {0,3}>')::int + regexp_matches(text, '\\[[^\\]\\n]+\\]\\([^)\\n]+\\)')::int) >= 2)"


@query("select doc_id, " + MARKDOWN_SQL + " as is_markdown from documents")
def p20_looks_like_markdown(spark, d):
    return table(spark, d, "documents").select("doc_id", X.looks_like_markdown(F.col("text")).alias("is_markdown"))


@query("select page_id, regexp_extract(url, '\\.([^.]*)$', 1) as extension, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '[\\\\/:*?\"<>|]', '_', 'g')), ''), 'document') as file_name from pages")
def k10_file_names(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"\.([^.]*)$", 1).alias("extension"), X.safe_filename(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("file_name"))


@query("select page_id, lower(regexp_extract(url, '\\.([^.]*)$', 1)) as extension from pages")
def d28_extension(spark, d):
    return table(spark, d, "pages").select("page_id", X.extension(F.col("url")).alias("extension"))


@query("select page_id, regexp_extract(h, '<h1[^>]*>(.*?)</h1>', 1) as raw, 1 as level from (select page_id, unnest(regexp_extract_all(html, '(?s)<h1[^>]*>.*?</h1>')) as h from pages)")
def s10_html_headings(spark, d):
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1\s*>"), F.lit(2))
    a = S.html_headings(table(spark, d, "pages"), key="page_id", html="html")
    b = table(spark, d, "pages").select("page_id", F.posexplode(tags).alias("ord", "raw"))
    return a.join(b, ["page_id", "ord"]).select("page_id", "raw", "level")


@query("select page_id, count(*) as links, count(*) filter (where regexp_matches(lower(href), '^(https?|ftps?|mailto|tel|callto|sms|xmpp):')) as safe from (select page_id, unnest(regexp_extract_all(html, '<a\\b[^>]*?\\bhref\\s*=\\s*\"([^\"]*)\"', 1)) as href from pages) group by 1")
def d12_page_links(spark, d):
    links = S.html_links(table(spark, d, "pages"), key="page_id", html="html")
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(X.safe_href(F.col("href")).isNotNull()).alias("safe"))


@query("select doc_id, sha256(text) as fingerprint from documents")
def d24_fingerprints(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("fingerprint"))


@query("select sha256(text) as fingerprint, count(*) as copies, min(doc_id) as first from documents group by 1 having count(*) > 1")
def d24_exact_duplicates(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("fingerprint")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


@query("select doc_id, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') = text as clean from documents")
def d26_xml_text(spark, d):
    return table(spark, d, "documents").select("doc_id", (X.xml_text(F.col("text")) == F.col("text")).alias("clean"))


ROMAN_SQL = "array_to_string([" + ", ".join("[" + ", ".join(f"'{x}'" for x in digits) + f"][((n // {10 ** k}) % 10) + 1]" for k, digits in reversed(list(enumerate(N.ROMAN)))) + "], '')"


@query("select p_partkey, n, " + ROMAN_SQL + " as roman, upper(" + ROMAN_SQL + ") as upper_roman, repeat(chr((97 + (n - 1) % 26)::integer), ((n - 1) // 26 + 1)::integer) as letters, case when n < 10 then '0' || n else n::varchar end as zeroed, repeat(substr('абвгдежзиклмнопрстуфхцчшщэюя', ((n - 1) % 28 + 1)::integer, 1), ((n - 1) // 28 + 1)::integer) as cyrillic from (select p_partkey, 1 + p_partkey % 3999 as n from part)")
def d13_number_formats(spark, d):
    n = table(spark, d, "part").select("p_partkey", (1 + F.col("p_partkey") % 3999).alias("n"))

    def shown(fmt: str):
        return N.format_number(F.col("n"), F.lit(fmt))

    return n.select("p_partkey", "n", shown("lowerRoman").alias("roman"), shown("upperRoman").alias("upper_roman"), shown("lowerLetter").alias("letters"), shown("decimalZero").alias("zeroed"), shown("russianLower").alias("cyrillic"))


@query("select l_orderkey, l_linenumber, n || '.' || chr((97 + l_linenumber - 1)::integer) || ')' as label, n || '.' || l_linenumber || ')' as legal from (select *, l_partkey as n from lineitem)")
def d14_level_labels(spark, d):
    n = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_partkey", "l_linenumber").alias("v"))
    values, formats = F.col("v").cast("array<int>"), F.array(F.lit("decimal"), F.lit("lowerLetter"))
    return n.select("l_orderkey", "l_linenumber", N.level_label(F.lit("%1.%2)"), values, formats, F.lit(False)).alias("label"), N.level_label(F.lit("%1.%2)"), values, formats, F.lit(True)).alias("legal"))


@query("select c_custkey, k as kind, i::integer as level, case k when 'bullet' then 'bullet' when 'none' then 'none' else ['decimal','lowerLetter','lowerRoman'][i % 3 + 1] end as format, case k when 'bullet' then ['•','◦','▪'][i % 3 + 1] when 'none' then '' else '%' || (i + 1) || '.' end as text, (357 * (i + 1))::integer as \"left\" from (select c_custkey, ['number', 'bullet', 'none'][c_custkey % 3 + 1] as k from customer), (select unnest(range(0, 9)) as i)")
def d15_list_levels(spark, d):
    kind = F.get(F.array(*map(F.lit, ("number", "bullet", "none"))), F.col("c_custkey") % 3)
    kinds = table(spark, d, "customer").select("c_custkey", kind.alias("kind"))
    return kinds.select("c_custkey", "kind", F.inline(N.default_levels(F.col("kind"), F.lit(None).cast("string")))).select("c_custkey", "kind", "level", "format", "text", "left")


UNIT = "case l_linenumber % 7 when 0 then 'cm' when 1 then 'mm' when 2 then 'in' when 3 then 'pt' when 4 then 'px' when 5 then 'em' end"


@query("select l_orderkey, l_linenumber, round(q * case coalesce(unit, 'cm') when 'cm' then 1.0 when 'mm' then 0.1 when 'in' then 2.54 when 'pt' then 2.54 / 72 when 'px' then 2.54 / 96 end, 6)::double as cm, q * case coalesce(unit, 'pt') when 'pt' then 1.0::double when 'px' then 0.75::double end as pt from (select *, l_quantity::double as q, " + UNIT + " as unit from lineitem)")
def d16_unit_conversion(spark, d):
    """Without a unit a number is centimetres, or points; em is neither."""
    unit = F.get(F.array(*map(F.lit, ("cm", "mm", "in", "pt", "px", "em"))), F.col("l_linenumber") % 7)
    value = F.col("l_quantity").cast("string")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(U.to_cm(value, unit), 6).alias("cm"), U.to_pt(value, unit).alias("pt"))


@query("select l_orderkey, l_linenumber, rtrim(rtrim(printf('%.4f', l_quantity / 20 * 1.15), '0'), '.') as height from lineitem")
def d17_line_heights(spark, d):
    q = F.col("l_quantity") / 20
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", U.line_height(q.cast("string"), F.lit(None).cast("string")).alias("height"))


@query("select c_custkey, size, orientation, case when orientation = 'landscape' then h else w end as width, case when orientation = 'landscape' then w else h end as height from (select c_custkey, size, orientation, (case size when 'Letter' then 215.9 when 'Legal' then 215.9 else 210.0 end)::double as w, (case size when 'Letter' then 279.4 when 'Legal' then 355.6 else 297.0 end)::double as h from (select c_custkey, ['A4', 'Letter', 'Legal', 'A5'][c_custkey % 4 + 1] as size, case when c_nationkey % 2 = 0 then 'landscape' else 'portrait' end as orientation from customer))")
def d18_page_sizes(spark, d):
    size = F.get(F.array(*map(F.lit, ("A4", "Letter", "Legal", "A5"))), F.col("c_custkey") % 4)
    a = table(spark, d, "customer").select("c_custkey", size.alias("size"), F.when(F.col("c_nationkey") % 2 == 0, "landscape").otherwise("portrait").alias("orientation"))
    return a.withColumn("p", U.page_mm(F.col("size"), F.col("orientation"))).select("c_custkey", "size", "orientation", "p.width", "p.height")


BAGS = "with p as (select doc_id, lag(doc_id) over (order by doc_id) as before, " + WORDS.format("text") + """ as ws from documents),
a as (select doc_id, word, pos, before, row_number() over (partition by doc_id, word order by pos) as n from (select doc_id, before, unnest(ws) as word, generate_subscripts(ws, 1) as pos from p)),
b as (select doc_id, word, count(*) as n from (select doc_id, unnest(ws) as word from p) group by 1, 2)
select a.doc_id, a.pos::integer as pos, a.word from a left join b on b.doc_id = a.before and b.word = a.word where b.n is null or a.n > b.n"""


@query(BAGS)
def j16_bag_missing(spark, d):
    """Each document against the one with the next smaller doc_id; the first, which has none, lacks all its words."""
    return bag_missing_after(table(spark, d, "documents"), key="doc_id", text="text").withColumnRenamed("at", "pos")


def worded(spark, d):
    w = X.words(F.col("text")).alias("w")
    return table(spark, d, "documents").select("doc_id", w), table(spark, d, "benchmark").select("item_id", w)


WORDED = "with d as (select doc_id, " + WORDS.format("text") + " as w from documents), b as (select item_id, " + WORDS.format("text") + " as w from benchmark where len(" + WORDS.format("text") + ") > 0)"
RUNS_OF_FIVE = WORDED + """, runs as (select item_id, least(5, len(w)) as n, k, array_to_string(w[k:k + 4], ' ') as run from (select *, unnest(range(1, greatest(1, len(w) - 4) + 1)) as k from b)),
found as (select distinct doc_id, n, array_to_string(w[i:i + n - 1], ' ') as run from (select *, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from runs)))
select distinct doc_id, item_id, k::integer as "at" from runs join found using (n, run)"""


@query(RUNS_OF_FIVE)
def o14_contiguous_words(spark, d):
    """All runs of five words of all items, in all documents: a row for each run that is there."""
    return windows_in(*worded(spark, d), size=5)


@query(WORDED + " select doc_id, item_id from (select doc_id, item_id, d.w as found, b.w as needed from d, b where list_has_all(d.w, b.w)) where list_reduce(found, lambda n, x: case when needed[n::integer + 1] = x then (n::integer + 1)::varchar else n end, '0')::integer = len(needed)")
def o13_subsequence(spark, d):
    """Whole items in all documents: a row for each pair whose item is there."""
    return subsequences(*worded(spark, d))


#: First bytes, and what they tell: kind, whether it is a PDF file, whether it can be text.
FIRSTS = (("", None, False, True), ("EFBBBF", None, False, True), ("255044462D312E37", "pdf", True, True), ("00000000255044462D312E34", None, True, False), ("504B0304", "zip", False, True), ("89504E470D0A1A0A", "png", False, True), ("FFD8FFE0", "jpeg", False, True), ("6100", None, False, False), ("FFFE6100", None, False, True))


@query("select doc_id, kind, is_pdf, is_text from (select doc_id, doc_id % " + str(len(FIRSTS)) + " as k from documents) join (values " + ", ".join(f"({k}, {'null' if kind is None else repr(kind)}, {p}, {t})" for k, (_, kind, p, t) in enumerate(FIRSTS)) + ") v(k, kind, is_pdf, is_text) using (k)")
def p15_sniffed_files(spark, d):
    """Texts of documents behind the first bytes of several kinds of files; null texts are empty."""
    head = F.get(F.array(*(F.lit(h) for h, *_ in FIRSTS)), F.col("doc_id") % len(FIRSTS))
    c = F.unhex(F.concat(head, F.hex(F.coalesce("text", F.lit("")).cast("binary"))))
    return table(spark, d, "documents").select("doc_id", X.sniffed(c).alias("kind"), X.is_pdf(c).alias("is_pdf"), X.is_plain_text(c).alias("is_text"))


@query("select source, lang, count(*) as n from documents group by all")
def a19_category_counts(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("select source, arg_min(lang, (-n, first)) as lang from (select source, lang, count(*) as n, min(doc_id) as first from documents group by all) group by 1")
def a14_majority_language(spark, d):
    from ..operators.rules import majority_rules

    rows = table(spark, d, "documents").select("source", "lang", "doc_id", F.lit(1).alias("one"))
    return majority_rules(rows, ["source"], value="lang", weight="one", seq="doc_id").select("source", "lang")


@query("select source, arg_min(lang, (-w, first)) as lang, max(w)::bigint as weight from (select source, lang, sum(greatest(1, length(trim(text)))) as w, min(doc_id) as first from documents group by all) group by 1")
def a15_weighted_majority(spark, d):
    from ..operators.rules import majority_rules

    rows = table(spark, d, "documents").select("source", "lang", "doc_id", F.greatest(F.lit(1), F.length(F.trim("text"))).alias("w"))
    return majority_rules(rows, ["source"], value="lang", weight="w", seq="doc_id").select("source", "lang", "weight")
