"""Secret scans with an incremental blob ledger.

Every version of a file is a blob, addressed by the SHA-256 of its content. The ledger is a table of (blob, rule, rule
version) that have been scanned, with the spans found. A scan addresses all versions, leaves out the pairs of blob and
rule version that the ledger has, scans each unseen blob once, adds it to the ledger and joins the ledger's findings back
to every path that carries the blob. All of it is DataFrame expressions: matches are taken by regular expression and
their places computed from the lengths of the pieces between them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import fresh, new_path, quoted


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and do not overlap; those whose `group` is shorter than `least` are dropped afterwards."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1
    #: A pattern that occurs in every text with a match: a cheap test that spares the rest.
    hint: str = ""


def either(word: str) -> str:
    """Pattern of a word in ASCII letters of either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api")).removesuffix(either("api")) + either("api") + "_?" + either("key")
ASSIGN = f"({NAMES})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The base kinds, in their order. Runs of AKIA and hex are matched at their least length at once: a shorter run has no longer one in it.
BASE = (
    Rule("assign", ASSIGN, group=2, least=8, hint=f"({NAMES})" + r"""["']?\x20*[:=]"""),
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
)
#: What the method adds.
ADDED = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + ADDED
SPAN = "array<struct<start:int,end:int>>"
STEPS = "array<struct<gap:int,hit:int,own:int>>"
#: Matches whose places are summed up at once.
RUN = 256
LEDGER = f"blob binary, rule string, version int, spans {SPAN}"


def matched(text: Column, rule: Rule) -> Column:
    """A rule's matches as (gap before it, its length, length of the group that counts), in code points."""
    pieces, found = F.split(text, rule.pattern), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("gap"), found.alias("hit"), kept.alias("own"))
    steps = F.transform(zipped, lambda s: F.struct(F.length(s["gap"]).alias("gap"), F.length(s["hit"]).alias("hit"), F.length(s["own"]).alias("own")))
    return F.when(text.rlike(rule.hint or rule.pattern), steps).otherwise(F.array().cast(STEPS))


def spans(steps: Column, least: int) -> Column:
    """Places (code points, end exclusive) of the matches that are long enough.

    The matches are taken in runs of RUN: first each run's length, then the run's own places, so the work is in
    proportion to their number. `steps` should be a column, since it is read several times.
    """
    first = F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps), F.lit(RUN))).otherwise(F.array().cast("array<int>"))
    length = F.transform(first, lambda b: F.aggregate(F.slice(steps, b, RUN), F.lit(0), lambda n, s: n + s["gap"] + s["hit"]))

    def add(acc: Column, n: Column) -> Column:
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    begin = F.aggregate(length, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), add)["out"]

    def one(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        end = start + s["hit"]
        here = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(s["own"] >= least, F.concat(acc["out"], F.array(here))).otherwise(acc["out"]).alias("out"))

    def run(z: Column) -> Column:
        return F.aggregate(F.slice(steps, z["first"], RUN), F.struct(z["begin"].alias("at"), F.array().cast(SPAN).alias("out")), one)["out"]

    return F.flatten(F.transform(F.arrays_zip(first.alias("first"), begin.alias("begin")), run))


def address(content: Column) -> Column:
    """Content address: SHA-256 of the UTF-8 bytes; null content is empty."""
    return F.unhex(F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan_new(versions: DataFrame, ledger: DataFrame, *, content_col: str = "content", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of the blobs and rule versions that the ledger lacks; a blob is scanned once, however many versions have it.

    Copies are merged before and after the shuffle, so that a blob of a third of all versions is one row a task.
    """
    text = F.coalesce(quoted(content_col), F.lit(""))
    blobs = versions.select(address(quoted(content_col)).alias("blob"), text.alias("text")).groupBy("blob").agg(F.any_value("text").alias("text"))
    known = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("known"))  # bounded by the rules' versions
    todo = blobs.join(known, "blob", "left")
    ask = [~F.coalesce(F.array_contains("known", f"{r.kind}@{r.version}"), F.lit(False)) for r in rules]
    todo = todo.where(F.greatest(*(a.cast("int") for a in ask)) == 1) if len(ask) > 1 else todo.where(ask[0])
    todo = todo.select("blob", *(F.when(a, matched(F.col("text"), r)).alias(f"s{k}") for k, (r, a) in enumerate(zip(rules, ask))))
    entries = F.array(*(F.when(F.col(f"s{k}").isNotNull(), F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), spans(F.col(f"s{k}"), r.least).alias("spans"))) for k, r in enumerate(rules)))
    found = todo.select("blob", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e"))
    return found.select("blob", "e.rule", "e.version", "e.spans")


def findings(versions: DataFrame, ledger: DataFrame, *, content_col: str = "content", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """versions and, as the last column, the array of (kind, start, end) of the given rule versions, by start and the rules' order.

    The column is named by `fresh` from "findings", so that columns of versions stay as they are, whatever their names.
    """
    rank = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (f"{r.kind}@{r.version}", k)))
    hits = ledger.where(F.size("spans") > 0).withColumn("rank", F.element_at(rank, F.concat_ws("@", "rule", "version"))).where("rank is not null")
    each = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank").alias("rank"), s["end"].alias("end"), F.col("rule").alias("kind")))
    own, key, told, name = (fresh(x, versions) for x in ("_own", "_blob", "_told", "findings"))
    # a ledger may have a row twice, if a scan was repeated: distinct spans of at most len(rules) rows a blob
    by_blob = hits.groupBy(F.col("blob").alias(key)).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(each)))).alias(told))
    out = versions.withColumn(own, address(quoted(content_col)))
    out = out.join(by_blob, F.col(own) == F.col(key), "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    tidy = F.transform(F.coalesce(F.col(told), none), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return out.select(*(quoted(c) for c in versions.columns), tidy.alias(name))


def scan(versions: DataFrame, *, content_col: str = "content", path: str | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, str]:
    """Scans what the ledger at `path` has not seen, adds it there, and returns all versions with their findings, and the path.

    A null content is the empty blob; empty versions, blobs of any length and repeated rows are scanned like others; an
    empty table adds nothing and returns nothing. The findings are the last column, named by `fresh`; columns of versions
    may have any names. A ledger that does not exist yet is begun.
    """
    spark = versions.sparkSession
    base = path or new_path(spark, "ledger")
    seen = spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(base) if path and exists(spark, path) else empty_ledger(spark)
    scan_new(versions, seen, content_col=content_col, rules=rules).write.mode("append").parquet(base)
    return findings(versions, spark.read.schema(LEDGER).parquet(base), content_col=content_col, rules=rules), base


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def joined(found: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the findings, comma-joined."""
    own = F.filter(found, lambda s: s["kind"].isin(*kinds)) if kinds else found
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
