"""Quality rules by cross-document line frequency.

Lines are normalised (lower case, digits to 0, blanks squeezed) and hashed. For each host the number of distinct documents
with a line is counted; lines above the host's limit are removed, and a document is rejected if too little of it is left.
The limit is a share of the host's distinct documents, and FLOOR at least. Documents are told apart by their content, so
that exact copies count once and do not condemn each other. The counts are partial before they are shuffled; the frequent
lines are broadcast if there are few, else joined by salted keys. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import fresh, quoted, written

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: A line may be in this share of a host's distinct documents, and in FLOOR of them in any case.
SHARE, FLOOR = 0.01, 5
#: A document is depleted if fewer words, or a smaller share of its words, are left.
LEAST_WORDS, LEAST_SHARE = 10, 0.2
#: Frequent lines that are broadcast at most (24 bytes each).
BROADCAST_ROWS = 100_000
SALT = 32


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), BLANK, " "))


def base_rules(docs: DataFrame, text_col: str = "text", window: int = 5) -> tuple[DataFrame, str]:
    """docs with a struct column (its name is returned too): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Windows are first compared by hash, which only tells windows without a repetition for certain; those whose hash comes
    twice are spelled out and sorted, so the counts are exact. A null or empty text has no words and fails.
    """
    temp = [fresh(x, docs) for x in ("_body", "_words", "_codes", "_hashes", "_sorted", "_twice", "_lines", "_pairs")]
    body, words, codes, hashes, ordered, twice, lines, pairs = map(F.col, temp)
    name = fresh("rules", docs)
    starts = F.sequence(F.lit(0), F.size(words) - window)
    out = docs.withColumn(temp[0], F.coalesce(quoted(text_col), F.lit("")))
    out = out.withColumns({temp[1]: words_of(body), temp[6]: lines_of(body)})
    out = out.withColumn(temp[2], F.transform(words, lambda x: F.xxhash64(x)))
    coded = F.transform(starts, lambda i: F.xxhash64(*(F.get(codes, i + k) for k in range(window))))
    out = out.withColumn(temp[3], F.when(F.size(words) >= window, coded))
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    out = out.withColumn(temp[7], F.when(repeats, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    alike = F.filter(pairs, lambda x, k: (F.get(pairs, k - 1)["h"] == x["h"]) | (F.get(pairs, k + 1)["h"] == x["h"]))
    spelled = F.transform(alike, lambda x: F.struct(F.array_join(F.slice(words, x["i"] + 1, window), " ").alias("w"), x["i"].alias("i")))
    out = out.withColumn(temp[4], F.sort_array(spelled))
    again = F.transform(ordered, lambda x, k: F.when((F.get(ordered, k - 1)["w"] == x["w"]) | (F.get(ordered, k + 1)["w"] == x["w"]), x["i"]))
    out = out.withColumn(temp[5], F.sort_array(F.filter(again, lambda i: i.isNotNull())))
    covered = F.transform(twice, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(twice, k + 1) - x, F.lit(window))))
    n_words = F.size(words).cast("long")
    n_repeat = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")
    chars = (F.length(body) - F.regexp_count(body, F.lit(r"[\x20\x09-\x0D]"))).cast("long")
    symbols = F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long")
    dup = (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")
    out = out.withColumn(name, F.struct(n_words.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), dup.alias("n_dup_lines"), n_repeat.alias("n_repeat_words")))
    return out.drop(*temp), name


def base_failed(rules: Column) -> Column:
    return (rules["n_words"] < 10) | (rules["n_repeat_words"] * 100 > rules["n_words"] * 20)


def measured_lines(lines: Column) -> Column:
    """Array of (hash of the normalised line, words) of an array of lines with a word; words are what single blanks part in a normalised line."""
    plain = F.transform(lines, normal)
    return F.transform(plain, lambda x: F.struct(F.xxhash64(x).alias("line"), (F.regexp_count(x, F.lit(" ")) + 1).alias("words")))


def read_once(docs: DataFrame, *, id_col: str, host_col: str, text_col: str) -> DataFrame:
    """(id, host, doc, r, lines, _row), written: all that is taken from the texts, in one pass over them.

    doc tells documents apart by their content, r has the base counts, lines the measured lines; _row is a number of its own
    for every row. Documents and lines are told apart by 64-bit hashes: among 10^9 distinct lines of a host some pair is
    taken for one line with a chance of one in forty.
    """
    rows = docs.select(quoted(id_col).alias("id"), quoted(host_col).cast("string").alias("host"), quoted(text_col).alias("text"))
    base, name = base_rules(rows, "text")
    body = F.coalesce(F.col("text"), F.lit(""))
    told = base.select("id", "host", F.xxhash64(body).alias("doc"), F.col(name).alias("r"), measured_lines(lines_of(body)).alias("lines"))
    return written(told.withColumn("_row", F.monotonically_increasing_id()), "rules")


def frequent_lines(rows: DataFrame, *, share: float = SHARE, floor: int = FLOOR) -> DataFrame:
    """(host, line) of the lines found in more distinct documents of a host than its limit; null is a host of its own. rows are those of `read_once`.

    Each document also sends its host a null line, so that one count gives the hosts' sizes too.
    """
    own = F.concat(F.array(F.lit(None).cast("long")), F.array_distinct(F.col("lines.line")))
    each = rows.select("host", "doc", F.explode(own).alias("line"))
    # a copy of a document adds nothing: distinct (host, line, document) are merged before and after the shuffle
    counts = written(each.distinct().groupBy("host", "line").count().where((F.col("count") > floor) | F.col("line").isNull()), "counts")
    sizes = counts.where("line is null").select(F.col("host").alias("_host"), F.col("count").alias("_docs"))
    lines = counts.where("line is not null")
    return lines.join(sizes, lines.host.eqNullSafe(F.col("_host"))).where(F.col("count") > F.lit(share) * F.col("_docs")).select("host", "line")


def removed_words(rows: DataFrame, frequent: DataFrame, n: int) -> DataFrame:
    """(_row, removed): words of each row's frequent lines. `frequent` has n rows: up to BROADCAST_ROWS they are broadcast."""
    each = rows.select("_row", "host", F.inline("lines"))
    if n <= BROADCAST_ROWS:
        right, on = F.broadcast(frequent), []
    else:
        each = each.withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(SALT)))
        right, on = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["salt"]
    same = (each.line == right.line) & each.host.eqNullSafe(right.host)
    for c in on:
        same = same & (each[c] == right[c])
    return each.join(right, same, "left_semi").groupBy("_row").agg(F.sum("words").alias("removed"))


def judge(docs: DataFrame, *, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", share: float = SHARE, floor: int = FLOOR, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(id, the base counts, base_failed, n_removed_words, kept) for every row of docs.

    Null texts have no lines or words and fail the base rules; the null host is a host; repeated rows are judged alike
    (copies of a document count once per host); an empty table gives no rows. Texts of any length are read whole. Only the
    three named columns are read, so others may have any names.
    """
    rows = read_once(docs, id_col=id_col, host_col=host_col, text_col=text_col)
    frequent = written(frequent_lines(rows, share=share, floor=floor), "lines")
    lost = removed_words(rows, frequent, frequent.count())
    out = rows.select("id", "r", "_row").join(lost, "_row", "left").withColumn("removed", F.coalesce("removed", F.lit(0)).cast("long"))
    left = F.col("r")["n_words"] - F.col("removed")
    depleted = (F.col("removed") > 0) & ((left < least_words) | (left < F.lit(least_share) * F.col("r")["n_words"]))
    failed = base_failed(F.col("r"))
    return out.select("id", "r.*", failed.alias("base_failed"), F.col("removed").alias("n_removed_words"), (~failed & ~depleted).alias("kept"))
