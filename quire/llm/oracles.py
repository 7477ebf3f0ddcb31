"""DuckDB SQL for the queries that SQL can express.

Not expressed: 4 and 8 (trained models), 5 (a table of every 50-byte window), 6 (a search over capacities), 9 and 10
(hashes that DuckDB lacks) and the pipeline; the tests hold these against plain versions and held-out labels.
"""

from __future__ import annotations

from . import codes, importance, lines, phrases, secrets, urls

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op1() -> str:
    parts = []
    for k, r in enumerate(secrets.RULES):
        p = quoted(r.pattern)
        parts.append(f"select doc_id, {k} as rank, '{r.kind}' as kind, {r.least} as least, string_split_regex(t, {p}) as pieces, regexp_extract_all(t, {p}, 0) as hits, regexp_extract_all(t, {p}, {r.group}) as own from d")
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE)
    length = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)"
    start = length.format("pieces[1:i]") + " + " + length.format("hits[1:i-1]")
    counts = ", ".join(f"count(*) filter (where kind = '{r.kind}') as n_{r.kind}" for r in secrets.BASE)
    told = "string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank)"
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents), every as ({' union all '.join(parts)}),
each as (select *, unnest(range(1, len(hits) + 1)) as i from every where len(hits) > 0),
placed as (select doc_id, rank, kind, ({start})::bigint as start, ({start} + length(hits[i]))::bigint as stop from each where length(own[i]) >= least),
folded as (select doc_id, {counts}, {told} filter (where kind in ({base})) as base, {told} as spans from placed group by 1)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join folded using (doc_id)"""


def op2() -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""with d as (select doc_id, {words} as w from documents), b as (select item_id::varchar as item, {words} as w from benchmark),
wins as (select distinct item, least(13, len(w)) as size, array_to_string(w[i:i + 12], ' ') as win from (select *, unnest(range(1, greatest(1, len(w) - 12) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct size from wins),
dw as (select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as win from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d, sizes where len(w) >= size)),
hits as (select dw.doc_id, dw.size, dw.i, wins.item from dw join wins on dw.size = wins.size and dw.win = wins.win),
covered as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + size)) as pos from hits) group by 1),
named as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hits group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
 coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join covered using (doc_id) left join named using (doc_id)"""


def op3() -> str:
    word, filled = r"'[^\x20\x09-\x0D]+'", r"'[^\x20\x09-\x0D]'"
    normal = r"trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))"
    return f"""with d as (select doc_id, source, coalesce(text, '') as t from documents),
a as (select doc_id, t, regexp_extract_all(t, {word}) as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {filled})) as ls from d),
win as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as win from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from a where len(w) >= 5)),
rep as (select doc_id, count(distinct pos) as n from (select doc_id, unnest(range(i, i + 5)) as pos from (select *, count(*) over (partition by doc_id, win) as c from win) where c > 1) group by 1),
ln as (select doc_id, source, t, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {filled}))) as line from d),
nl as (select doc_id, source, t, {normal} as line, len(regexp_extract_all(line, {word})) as words from ln),
hosts as (select source, count(distinct t) as docs from d group by 1),
freq as (select source, line from (select source, line, count(distinct t) as n from nl group by 1, 2) c where n > {lines.FLOOR} and n > {lines.SHARE}::double * (select docs from hosts h where h.source is not distinct from c.source)),
lost as (select doc_id, sum(words) as n from nl where exists (select 1 from freq f where f.line = nl.line and f.source is not distinct from nl.source) group by 1),
r as (select a.doc_id, len(w)::bigint as n_words, list_sum(list_transform(w, lambda x: length(x))) as chars, length(t) - length(translate(t, {quoted(lines.SYMBOLS)}, '')) as symbols, len(ls) - len(list_distinct(ls)) as dup, coalesce(rep.n, 0) as rep, coalesce(lost.n, 0) as lost from a left join rep using (doc_id) left join lost using (doc_id)),
f as (select *, n_words < 10 or 100 * rep > 20 * n_words as failed from r)
select doc_id, n_words, coalesce(chars, 0)::bigint as word_chars, symbols::bigint as n_symbols, dup::bigint as n_dup_lines, rep::bigint as n_repeat_words, failed as base_failed,
 not failed and not (lost > 0 and (n_words - lost < {lines.LEAST_WORDS} or n_words - lost < {lines.LEAST_SHARE} * n_words)) as kept, lost::bigint as n_removed_words from f"""


def gram_row(url: str) -> list[int]:
    """Bucket numbers of a URL's n-grams, as `urls.grams` makes them."""
    head, mark, rest = url.partition("://")
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host = rest[: min(ends)] if ends else rest
    path = rest[len(host) :]
    stops = [path.find(c) for c in "?#" if c in path]
    path = path[: min(stops)] if stops else path
    host = host.translate(str.maketrans(UPPER, LOWER)) if mark else ""
    text = f"^{host}|{path if mark else ''}$"
    found = set()
    for n in urls.GRAMS:
        for i in range(len(text) - n + 1):
            h = n
            for c in text[i : i + n]:
                h = (h * 257 + ord(c)) % urls.BUCKETS
            found.add(h)
    return sorted(found)


def op7() -> str:
    w = urls.fitted([(gram_row(u), y) for u, y in sorted(urls.LABELLED)])
    weights = "[" + ", ".join(map(str, w[:-1])) + "]::bigint[]"
    host = r"translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), " + f"'{UPPER}', '{LOWER}')"
    path = r"regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"

    def fold(n: int) -> str:
        out = str(n)
        for k in range(n):
            out = f"(({out} * 257 + c[i + {k}]) % {urls.BUCKETS})"
        return f"list_transform(range(1, len(c) - {n} + 2), lambda i: {out})"

    ruled = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"ends_with('.' || host, '.{h}') and starts_with(path, '{p}')" for _, h, p in ruled]
    rule = "case " + " ".join(f"when {f} then '{h}{p}'" for f, (_, h, p) in zip(fits, ruled)) + " end"
    said = "case " + " ".join(f"when {f} then '{v}'" for f, (v, _, _) in zip(fits, ruled)) + " end"
    return f"""with p as (select page_id, {host} as host, {path} as path from pages),
c as (select *, list_transform(string_split('^' || host || '|' || path || '$', ''), lambda x: unicode(x)) as c from p),
g as (select *, list_distinct(list_concat({', '.join(fold(n) for n in urls.GRAMS)})) as g from c)
select page_id, host, path, {rule} as rule, coalesce({said}, case when {w[-1]}::double + coalesce(list_sum(list_transform(g, lambda x: ({weights})[x + 1])), 0)::double / sqrt(greatest(1, len(g))::double) > 0 then 'block' else 'allow' end) as verdict from g"""


def op11() -> str:
    n = phrases.LENGTH
    return rf"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') as win from (select doc_id, w, unnest(range(1, len(w) - {n - 2})) as i from d where len(w) >= {n})),
late as (select doc_id, i from (select doc_id, i, row_number() over (partition by win order by doc_id, i) as k from win) where k > 1),
gone as (select distinct doc_id, unnest(range(i, i + {n})) as i from late),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
kept as (select words.doc_id, string_agg(word, ' ' order by words.i) as kept from words anti join gone on words.doc_id = gone.doc_id and words.i = gone.i group by 1),
lost as (select doc_id, count(*) as n from gone group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(lost.n, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join lost using (doc_id) left join kept using (doc_id)"""


def op12() -> str:
    """The rounds written out one after another, every part against every entry."""
    steps = [
        "kept as (select vec_id, label, list_transform(embedding, lambda x: floor(x::double * {scale})::bigint) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding))",
        "width as (select max(len(v)) // {parts} as w from kept)",
        "part as (select vec_id, p, v[p * w + 1:p * w + w] as x from kept, width, range({parts}) t(p))",
        "book0 as (select p, row_number() over (partition by p order by vec_id) - 1 as k, x as e from part where vec_id in (select vec_id from kept order by vec_id limit {entries}))",
    ]
    far = "list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    for r in range(codes.ROUNDS + 1):
        steps.append(f"near{r} as (select vec_id, p, any_value(x) as x, min(k) as k, any_value(d) as d from (select *, min(d) over (partition by vec_id, p) as m from (select vec_id, p, x, k, {far} as d from part join book{r} using (p))) where d = m group by 1, 2)")
        if r < codes.ROUNDS:
            steps.append(f"sums{r} as (select p, k, j, sum(y)::bigint as s, count(*) as n from (select p, k, unnest(x) as y, unnest(range(1, len(x) + 1)) as j from near{r}) group by 1, 2, 3)")
            steps.append(f"mean{r} as (select p, k, list((s - ((s % n) + n) % n) // n order by j) as e from sums{r} group by 1, 2)")
            steps.append(f"book{r + 1} as (select b.p, b.k, coalesce(m.e, b.e) as e from book{r} b left join mean{r} m on b.p = m.p and b.k = m.k)")
    last = codes.ROUNDS
    steps.append(f"coded as (select vec_id, string_agg(lower(lpad(to_hex(k), 2, '0')), '' order by p) as code, sum(d)::bigint as error from near{last} group by 1)")
    steps.append("told as (select c.*, label from coded c join kept using (vec_id))")
    steps.append(f"digest as (select sha256(string_agg(array_to_string(e, ','), ',' order by p, k)) as codebooks_sha256 from book{last})")
    body = ",\n".join(steps).format(scale=codes.SCALE, parts=codes.PARTS, entries=codes.ENTRIES)
    return f"with {body}\nselect vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from told, digest"


def crc_table() -> list[int]:
    """The 256 remainders of CRC-32, from its polynomial."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def op13() -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    table, n = f"{crc_table()}::bigint[]", importance.BUCKETS
    fold = f"list_reduce(list_concat([4294967295::bigint], bytes), lambda a, b: xor(a >> 8, ({table})[(xor(a, b) & 255) + 1]))"
    return f"""with d as (select doc_id, {words} as w from documents), b as (select {words} as w from benchmark),
f as (select doc_id, word, count(*) as n from (select doc_id, unnest(w) as word from d) group by 1, 2),
g as (select word, count(*) as n from (select unnest(w) as word from b) group by 1),
dictionary as (select word, list_transform(range(0, octet_length(encode(word))), lambda i: ('0x' || substring(hex(encode(word)), 2 * i::int + 1, 2))::bigint) as bytes from (select word from f union select word from g)),
hashed as (select word, xor({fold}, 4294967295) % {n} as bucket from dictionary),
counts as (select bucket, sum(s) as s, sum(t) as t from (select bucket, n as s, 0 as t from f join hashed using (word) union all select bucket, 0, n from g join hashed using (word)) group by 1),
gains as (select bucket, floor(1000 * ln((t + 1)::double * (select sum(s) + {n} from counts)::double / ((s + 1)::double * (select sum(t) + {n} from counts)::double)))::bigint as gain from counts),
weights as (select doc_id, sum(f.n * gain)::bigint as weight from f join hashed using (word) join gains using (bucket) group by 1),
scored as (select d.doc_id, len(w)::bigint as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substring(sha256('{importance.SEED}:' || d.doc_id::varchar), 1, 8))::bigint::double + 0.5) / 4294967296)))::bigint as score from d left join weights using (doc_id)),
ranks as (select doc_id, row_number() over (order by score desc, doc_id) as rank from scored where n_features >= {importance.LEAST_WORDS})
select scored.doc_id, n_features, weight, score, case when rank <= {importance.SHARE} * (select count(*) from ranks) // 100 then rank end as rank from scored left join ranks using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": op1(), "op2_decontaminate": op2(), "op3_quality_rules": op3(), "op7_url_filter": op7(), "op11_phrase_dedup": op11(), "op12_vector_codes": op12(), "op13_importance_resampling": op13()}
