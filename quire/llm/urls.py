"""URL filter: longest-match rules, and logistic regression on hashed character n-grams of host and path.

The classifier is trained from a small labelled URL table (at most `most` rows are taken to the driver); scoring is a
DataFrame expression: n-grams are hashed by arithmetic on code points and their weights looked up in an array literal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import fresh, quoted

#: The rules of the filter, as verdict, host and path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: The labelled URLs; 1 is block.
LABELLED = (
    ("http://news.example.org/en/article-12", 0), ("https://www.town-library.example.org/fr/catalogue/8", 0), ("https://docs.project.example.org/es/guide/intro", 0),
    ("http://museum.example.org/de/ausstellung/41.html", 0), ("https://blog.garden.example.org/en/2021/roses", 0), ("https://shop.books.example.net/en/novel/77", 0),
    ("http://weather.example.net/de/bericht/9", 0), ("https://school.example.edu/en/courses/maths", 0), ("https://wiki.example.org/en/history_of_rail", 0),
    ("http://recipes.example.net/en/soup/13?page=2", 0), ("https://m.travel.example.org/fr/guide/lyon", 0), ("https://www.health.example.org/es/consejos/22", 0),
    ("http://archive.example.org/en/letters/1890.html", 0), ("https://forum.example.net/de/thema/301#top", 0), ("https://science.example.edu/en/paper/55", 0),
    ("https://radio.example.org/fr/programme", 0), ("http://maps.example.net/en/city/4", 0), ("https://law.example.org/en/statute/18", 0),
    ("http://casino-bonus.example.biz/win/free-spins", 1), ("https://ads.track-click.example.info/banner/ad?id=1", 1), ("http://cheap-pills.example.biz/buy/now", 1),
    ("https://xxx-videos.example.info/hot/free", 1), ("http://free-download-crack.example.biz/keygen/serial", 1), ("https://login-verify-account.example.info/secure/update", 1),
    ("http://bet-poker-win.example.biz/bonus/jackpot", 1), ("https://click.adserver.example.info/ad/popup", 1), ("http://replica-watches.example.biz/buy/cheap", 1),
    ("https://adult-cam.example.info/live/xxx", 1), ("http://torrent-crack.example.biz/download/free", 1), ("https://prize-winner.example.info/claim/gift-card", 1),
    ("http://payday-loan.example.biz/apply/fast-cash", 1), ("https://seo-links.example.info/buy/backlinks", 1), ("http://spam-mailer.example.biz/bulk/email", 1),
    ("https://track.pixel-ads.example.info/click/redirect", 1), ("http://warez.example.biz/serial/keygen", 1), ("https://hot-dating.example.info/free/signup", 1),
)

BUCKETS = 1021
GRAMS = (3, 4)
#: Weights are kept as whole millionths, so that sums do not depend on their order.
SCALE = 1_000_000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. Length is that of host and path together; the earlier rule wins a tie."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = (F.concat(F.lit("."), host).endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(own + start)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def marked(host: Column, path: Column) -> Column:
    """Host and path as one text with marked ends."""
    return F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))


def grams(text: Column) -> Column:
    """Bucket numbers of all character 3- and 4-grams, each bucket once: polynomial hash of code points."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))

    def of(n: int) -> Column:
        def one(i: Column) -> Column:
            h = F.lit(n)
            for k in range(n):
                h = (h * 257 + F.get(codes, i + k)) % BUCKETS
            return h

        return F.when(F.size(codes) >= n, F.transform(F.sequence(F.lit(0), F.size(codes) - n), one)).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.concat(*(of(n) for n in GRAMS)))


def fitted(rows: list[tuple[list[int], int]], *, rounds: int = 60, rate: float = 0.5, ridge: float = 1e-3) -> list[int]:
    """Logistic regression by plain gradient steps over the labelled rows in their order; weights in millionths, the bias last."""
    w = [0.0] * (BUCKETS + 1)
    for _ in range(rounds):
        for feet, y in rows:
            length = math.sqrt(max(1, len(feet)))
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, w[-1] + sum(w[i] for i in feet) / length))))
            step = rate * (y - p)
            for i in feet:
                w[i] += step / length - rate * ridge * w[i]
            w[-1] += step * 0.1
    return [round(x * SCALE) for x in w]


def train(labelled: DataFrame, *, url_col: str = "url", label_col: str = "label", most: int = 10_000) -> list[int]:
    """Weights from a table of labelled URLs (label 1: block); refuses more than `most` rows, which are what the driver holds."""
    url = quoted(url_col)
    rows = labelled.where(url.isNotNull() & quoted(label_col).isNotNull()).select(url.alias("url"), quoted(label_col).cast("int").alias("y"), grams(marked(host_of(url), path_of(url))).alias("feet")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the labelled table has more than {most} rows")
    return fitted([(sorted(r.feet), r.y) for r in sorted(rows, key=lambda r: (r.url, r.y))])


def judge(pages: DataFrame, labelled: DataFrame | None = None, *, url_col: str = "url", rules=RULES) -> DataFrame:
    """pages with _host, _path, _rule, _verdict and _score (names by `fresh`); score is the classifier's log-odds of block times a scale.

    A null url, or one without "://", has an empty host and path and is left to the classifier, as is every url that no
    rule fits; ties at zero allow. Repeated rows are judged alike; an empty table gives an empty table; a url of any length is judged
    whole.
    """
    spark = pages.sparkSession
    w = train(labelled if labelled is not None else spark.createDataFrame(list(LABELLED), "url string, label int"))
    url = quoted(url_col)
    names = [fresh(x, pages) for x in ("_host", "_path", "_grams", "_rule", "_verdict", "_score")]
    host, path, feet, rule, verdict, score = names
    out = pages.withColumns({host: host_of(url), path: path_of(url)})
    out = out.withColumn(feet, grams(marked(F.col(host), F.col(path))))
    weights = F.array(*(F.lit(x).cast("long") for x in w[:-1]))
    total = F.aggregate(F.col(feet), F.lit(0).cast("long"), lambda a, i: a + F.get(weights, i))
    out = out.withColumn(score, F.lit(w[-1]).cast("double") + total.cast("double") / F.sqrt(F.greatest(F.lit(1), F.size(feet)).cast("double")))
    named, said = rule_of(F.col(host), F.col(path), rules)
    return out.withColumns({rule: named, verdict: F.coalesce(said, F.when(F.col(score) > 0, "block").otherwise("allow"))}).drop(feet)
