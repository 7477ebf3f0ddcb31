"""Document health: eleven checks over elements and their looks, and the score they give.

elements: doc_id, element_id, ord, type, level, content, style_ref, ordered, has_header, plus `css` map of the resolved
look; runs: doc_id, element_id, text, mark, href, font_family, font_size_pt, color (a row for each mark of a run);
items: doc_id, element_id, text of list items. Every check gives (doc_id, check, weight, status, issues).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from ..functions import text as X

BODY = ("paragraph", "list", "quote", "table", "caption", "footnote")
#: Checks in their order, with their weights.
WEIGHTS = {"hierarchy": 3, "fonts": 3, "heading_sizes": 3, "spacing": 2, "direct_formatting": 2, "numbering": 2, "alignment": 1, "tables": 1, "captions": 1, "page_breaks": 1, "links": 1}


def in_doc() -> WindowSpec:
    return W.partitionBy("doc_id")


def in_order() -> WindowSpec:
    return in_doc().orderBy("ord")


def filled(content: Column) -> Column:
    return content.rlike(r"(?U)\S")


def n_words(content: Column) -> Column:
    return F.regexp_count(content, F.lit(r"(?U)\S+"))


def css(name: str) -> Column:
    return F.coalesce(F.element_at("css", name), F.lit(""))


def check(docs: DataFrame, found: DataFrame, name: str, status: Column, issues: Column) -> DataFrame:
    """One row for every document; `found` has at most one a document."""
    out = docs.select("doc_id").join(found, "doc_id", "left")
    return out.select("doc_id", F.lit(name).alias("check"), F.lit(WEIGHTS[name]).alias("weight"), F.coalesce(status, F.lit("skip")).alias("status"), F.coalesce(issues, F.lit(0)).cast("long").alias("issues"))


def hierarchy(elements: DataFrame, docs: DataFrame) -> DataFrame:
    """Headings go down one level at a time; more than 600 words need some."""
    heads = elements.where("type = 'heading'").withColumn("lv", F.coalesce("level", F.lit(1)))
    heads = heads.withColumn("gap", F.col("lv") > F.lag("lv").over(in_order()) + 1)
    a = heads.groupBy("doc_id").agg(F.count("*").alias("heads"), F.count_if("gap").alias("gaps"))
    n = F.when(F.col("type").isin(*BODY), n_words(F.col("content"))).otherwise(0)
    b = elements.groupBy("doc_id").agg(F.sum(n).alias("words"))
    heads_, words = F.coalesce("heads", F.lit(0)), F.col("words")
    status = F.when(heads_ > 0, F.when(F.col("gaps") > 0, "warn").otherwise("pass")).when(words > 600, "fail").when(words > 0, "pass")
    return check(docs, b.join(a, "doc_id", "left"), "hierarchy", status, F.col("gaps"))


def fonts(elements: DataFrame, runs: DataFrame, docs: DataFrame) -> DataFrame:
    """Body text in one font; two warn, more fail; issues are the elements in the others."""
    body = elements.where(F.col("type").isin(*BODY) & filled(F.col("content")))
    base = F.trim(F.regexp_replace(F.trim(F.split_part(css("font-family"), F.lit(","), F.lit(1))), "^['\"]+|['\"]+$", ""))
    own = body.select("doc_id", "element_id", base.alias("font")).where("font != ''")
    set_ = runs.where("mark = 'textStyle' and font_family is not null").where(filled(F.col("text"))).join(body.select("doc_id", "element_id"), ["doc_id", "element_id"], "left_semi")
    both = own.unionByName(set_.select("doc_id", "element_id", F.trim("font_family").alias("font")))
    sizes = both.groupBy("doc_id", "font").agg(F.count_distinct("element_id").alias("n"))
    per = sizes.groupBy("doc_id").agg(F.count("*").alias("fonts"), (F.sum("n") - F.max("n")).alias("odd"))
    found = body.select("doc_id").distinct().join(per, "doc_id", "left")
    n = F.coalesce("fonts", F.lit(0))
    return check(docs, found.withColumn("any", F.lit(1)), "fonts", F.when(F.col("any") == 1, F.when(n <= 1, "pass").when(n == 2, "warn").otherwise("fail")), F.col("odd"))


def heading_sizes(elements: DataFrame, docs: DataFrame) -> DataFrame:
    """One size for each level (else fail), none larger than that of the level above (else warn)."""
    heads = elements.where(F.col("type") == "heading").where(filled(F.col("content")))
    sizes = heads.groupBy("doc_id", F.coalesce("level", F.lit(1)).alias("lv"), css("font-size").alias("size")).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    main = sizes.groupBy("doc_id", "lv").agg(F.min_by("size", F.struct(-F.col("n"), F.col("first"))).alias("main"), F.count("*").alias("kinds"), F.sum("n").alias("heads"))
    above = F.lag(X.points(F.col("main"))).over(W.partitionBy("doc_id").orderBy("lv"))
    main = main.withColumn("larger", X.points(F.col("main")) > above)
    per = main.groupBy("doc_id").agg(F.sum("heads").alias("heads"), F.count_if(F.col("kinds") > 1).alias("mixed"), F.count_if("larger").alias("larger"))
    status = F.when(F.col("heads") >= 2, F.when(F.col("mixed") > 0, "fail").when(F.col("larger") > 0, "warn").otherwise("pass"))
    return check(docs, per, "heading_sizes", status, F.when(F.col("heads") >= 2, F.col("mixed") + F.col("larger")))


def spacing(elements: DataFrame, docs: DataFrame) -> DataFrame:
    """Paragraphs spaced alike and no runs of empty ones."""
    look = F.struct(css("line-height").alias("l"), css("margin-bottom").alias("m"))
    full = elements.where(F.col("type") == "paragraph").where(filled(F.col("content"))).withColumn("look", look)
    each = full.groupBy("doc_id", "look").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    per = each.groupBy("doc_id").agg(F.sum("n").alias("total"), (F.sum("n") - F.max("n")).alias("odd"))
    empty = elements.withColumn("empty", (F.col("type") == "paragraph") & ~filled(F.col("content")))
    empty = empty.withColumn("island", F.sum(F.when(F.col("empty"), 0).otherwise(1)).over(in_order())).where("empty")
    runs = empty.groupBy("doc_id", "island").count().where("count >= 2").groupBy("doc_id").agg(F.count("*").alias("runs"))
    found = per.join(runs, "doc_id", "left")
    gaps = F.coalesce("runs", F.lit(0))
    status = F.when(F.col("total") >= 2, F.when((F.col("odd") == 0) & (gaps == 0), "pass").when(F.col("odd") > F.col("total") / 4, "fail").otherwise("warn"))
    return check(docs, found, "spacing", status, F.when(F.col("total") >= 2, F.col("odd") + gaps))


def direct_formatting(elements: DataFrame, runs: DataFrame, docs: DataFrame) -> DataFrame:
    """Blocks with a look or marks of their own; more than a fifth of them warn."""
    body = elements.where(F.col("type").isin(*BODY) & filled(F.col("content")))
    own = runs.where((F.col("mark") == "textStyle") & filled(F.col("text")) & (F.col("font_family").isNotNull() | F.col("font_size_pt").isNotNull() | F.col("color").isNotNull()))
    marked = body.join(own.select("doc_id", "element_id").distinct().withColumn("marked", F.lit(1)), ["doc_id", "element_id"], "left")
    hit = (F.col("style_ref") == F.col("element_id")) | (F.col("marked") == 1)
    per = marked.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(hit).alias("hit"))
    return check(docs, per, "direct_formatting", F.when(F.col("hit") > 0.2 * F.col("n"), "warn").otherwise(F.when(F.col("n") > 0, "pass")), F.col("hit"))


def numbering(elements: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    """Numbers typed into headings count up by one under each parent; numbered lists have none typed."""
    text = F.regexp_extract("content", r"^\s*([0-9]+(?:\.[0-9]+)*)[.)]?\s+\S", 1)
    heads = elements.where("type = 'heading'").withColumn("number", text).where("number != ''")
    parts = F.transform(F.split("number", r"\."), lambda x: x.cast("long"))
    heads = heads.withColumns({"own": F.element_at(parts, -1), "parent": F.slice(parts, 1, F.size(parts) - 1).cast("array<string>")}).withColumn("parent", F.array_join("parent", "."))
    before = F.coalesce(F.lag("own").over(W.partitionBy("doc_id", "parent").orderBy("ord")), F.lit(0))
    a = heads.withColumn("odd", F.col("own") != before + 1).groupBy("doc_id").agg(F.count("*").alias("numbered"), F.count_if("odd").alias("odd"))
    lists = elements.where("type = 'list' and ordered").select("doc_id", "element_id")
    typed = items.where(F.col("text").rlike(r"^\s*[0-9]+[.)]\s")).join(lists, ["doc_id", "element_id"], "left_semi").select("doc_id", "element_id").distinct()
    b = lists.groupBy("doc_id").agg(F.count("*").alias("lists")).join(typed.groupBy("doc_id").agg(F.count("*").alias("typed")), "doc_id", "left")
    found = a.join(b, "doc_id", "full")
    odd, doubled = F.coalesce("odd", F.lit(0)), F.coalesce("typed", F.lit(0)) > 0
    some = F.coalesce("numbered", F.lit(0)) + F.coalesce("lists", F.lit(0)) > 0
    return check(docs, found, "numbering", F.when(some, F.when(odd > 0, "fail").when(doubled, "warn").otherwise("pass")), odd + doubled.cast("int"))


def alignment(elements: DataFrame, docs: DataFrame) -> DataFrame:
    """Paragraphs of more than 80 characters aligned alike."""
    long_ = elements.where((F.col("type") == "paragraph") & (F.length(F.trim("content")) > 80))
    side = F.coalesce(F.element_at("css", "text-align"), F.lit("left"))
    per = long_.groupBy("doc_id", side.alias("side")).count().groupBy("doc_id").agg(F.sum("count").alias("n"), (F.sum("count") - F.max("count")).alias("odd"))
    return check(docs, per, "alignment", F.when(F.col("n") >= 2, F.when(F.col("odd") > 0, "warn").otherwise("pass")), F.when(F.col("n") >= 2, F.col("odd")))


def tables(elements: DataFrame, docs: DataFrame) -> DataFrame:
    """Header rows in all tables or none; none with a look of its own beside others."""
    per = elements.where("type = 'table'").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("has_header").alias("heads"), F.count_if(F.col("style_ref") == F.col("element_id")).alias("own"))
    mixed = (F.col("heads") > 0) & (F.col("heads") < F.col("n"))
    apart = (F.col("own") > 0) & (F.col("n") > 1)
    return check(docs, per, "tables", F.when(mixed | apart, "warn").when(F.col("n") > 0, "pass"), mixed.cast("int") + apart.cast("int"))


def captions(elements: DataFrame, docs: DataFrame) -> DataFrame:
    """Once some figures or tables have a caption beside them, all should."""
    near = (F.coalesce(F.lag("type").over(in_order()), F.lit("")) == "caption") | (F.coalesce(F.lead("type").over(in_order()), F.lit("")) == "caption")
    seen = elements.withColumn("near", near)
    figure = F.col("type").isin("image", "table")
    per = seen.groupBy("doc_id").agg(F.count_if(figure).alias("figures"), F.count_if(figure & ~F.col("near")).alias("missing"), F.count_if(F.col("type") == "caption").alias("captions"))
    alone = (F.col("captions") == 0) & (F.col("figures") == 1)
    return check(docs, per, "captions", F.when(F.col("figures") > 0, F.when((F.col("missing") == 0) | alone, "pass").otherwise("warn")), F.when(alone, 0).otherwise(F.col("missing")))


def page_breaks(elements: DataFrame, docs: DataFrame) -> DataFrame:
    """Breaks stand between content: none before the first or after the last, none right after another."""
    is_break = F.col("type") == "page_break"
    content = ~is_break & (filled(F.col("content")) | F.col("type").isin("image", "table"))
    seen = elements.withColumns({"before": F.count_if(content).over(in_order()), "total": F.count_if(content).over(in_doc())}).where(is_break)
    seen = seen.withColumn("empty", F.col("before") == F.lag("before").over(in_order()))
    per = seen.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if((F.col("before") == 0) | (F.col("before") == F.col("total"))).alias("edges"), F.count_if("empty").alias("doubled"))
    issues = (F.col("edges") > 0).cast("int") + (F.col("doubled") > 0).cast("int")
    return check(docs, per, "page_breaks", F.when(issues > 0, "warn").when(F.col("n") > 0, "pass"), issues)


def links(runs: DataFrame, docs: DataFrame) -> DataFrame:
    """Every link has a usable address."""
    per = runs.where("mark = 'link'").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(~X.usable_link(F.col("href"))).alias("broken"))
    return check(docs, per, "links", F.when(F.col("broken") > 0, "fail").when(F.col("n") > 0, "pass"), F.col("broken"))


def all_checks(elements: DataFrame, runs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of all eleven checks, in one pass over the elements (see `judged`)."""
    docs = judged(elements, runs, items)
    told = (F.struct(F.lit(n).alias("check"), F.lit(w).alias("weight"), F.coalesce(F.col(n)["status"], F.lit("skip")).alias("status"), F.col(n)["issues"].alias("issues")) for n, w in WEIGHTS.items())
    return docs.select("doc_id", F.inline(F.array(*told)))


def score(checks: DataFrame) -> DataFrame:
    """(doc_id, score, rating): a pass counts its weight, a warning half, a skipped check not at all; half-even rounding."""
    earned = F.sum(F.when(F.col("status") != "skip", F.col("weight") * worth(F.col("status"))))
    total = F.sum(F.when(F.col("status") != "skip", F.col("weight")))
    return rated(checks.groupBy("doc_id").agg(earned.alias("earned"), total.alias("total")))


def worth(status: Column) -> Column:
    return F.when(status == "pass", 1.0).when(status == "warn", 0.5).otherwise(0.0)


def rated(sums: DataFrame) -> DataFrame:
    points = F.coalesce(F.bround(100 * F.col("earned") / F.col("total"), 0), F.lit(100.0)).cast("int")
    return sums.select("doc_id", points.alias("score"), F.when(points >= 85, "good").when(points >= 60, "fair").otherwise("poor").alias("rating"))


def scores(elements: DataFrame, runs: DataFrame, items: DataFrame) -> DataFrame:
    """What `score` gives for `all_checks`, without their rows."""
    status = {n: F.col(n)["status"] for n in WEIGHTS}
    earned = sum((F.when(status[n].isNotNull(), worth(status[n]) * w).otherwise(0.0) for n, w in WEIGHTS.items()), F.lit(0.0))
    total = sum((F.when(status[n].isNotNull(), w).otherwise(0) for n, w in WEIGHTS.items()), F.lit(0))
    return rated(judged(elements, runs, items).select("doc_id", earned.alias("earned"), F.when(total > 0, total).alias("total")))


def read(elements: DataFrame) -> DataFrame:
    """What the checks need of an element: its text is read here, once, and goes no further."""
    type_, content = F.col("type"), F.col("content")
    number = F.regexp_extract("content", r"^\s*([0-9]+(?:\.[0-9]+)*)[.)]?\s+\S", 1)
    parts = F.transform(F.split(number, r"\."), lambda x: x.cast("long"))
    typed = (type_ == "heading") & (number != "")
    base = F.trim(F.regexp_replace(F.trim(F.split_part(css("font-family"), F.lit(","), F.lit(1))), "^['\"]+|['\"]+$", ""))
    return elements.select(
        "doc_id", "element_id", "ord", "type", F.coalesce("level", F.lit(1)).alias("level"), filled(content).alias("text"), F.when(type_.isin(*BODY), n_words(content)).otherwise(0).alias("words"),
        ((type_ == "paragraph") & (F.length(F.trim(content)) > 80)).alias("long"), F.when(typed, F.element_at(parts, -1)).alias("number"),
        F.when(typed, F.array_join(F.slice(parts, 1, F.size(parts) - 1).cast("array<string>"), ".")).alias("parent"), (F.col("style_ref") == F.col("element_id")).alias("own"), F.col("ordered").cast("boolean").alias("ordered"), F.col("has_header").cast("boolean").alias("has_header"),
        F.when(type_.isin(*BODY), base).alias("font"), F.when(type_ == "heading", css("font-size")).alias("size"), F.when(type_ == "paragraph", css("line-height")).alias("line"), F.when(type_ == "paragraph", css("margin-bottom")).alias("below"),
        F.when(type_ == "paragraph", F.coalesce(F.element_at("css", "text-align"), F.lit("left"))).alias("side"),
    )


def said(runs: DataFrame, items: DataFrame) -> DataFrame:
    """What runs and list items say of their element; those that say nothing are left out."""
    style, link = (F.col("mark") == "textStyle") & filled(F.col("text")), F.col("mark") == "link"
    looks = style & (F.col("font_family").isNotNull() | F.col("font_size_pt").isNotNull() | F.col("color").isNotNull())
    of_runs = runs.select("doc_id", "element_id", F.when(style, F.trim("font_family")).alias("_set"), looks.alias("_marked"), link.alias("_links"), (link & ~X.usable_link(F.col("href"))).alias("_broken")).where("_marked or _links")
    typed = items.where(F.col("text").rlike(r"^\s*[0-9]+[.)]\s")).select("doc_id", "element_id", F.lit(True).alias("_typed"))
    return of_runs.unionByName(typed, allowMissingColumns=True)


def judged(elements: DataFrame, runs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, and by each check's name its status, null where it is skipped, and issues), in one pass over the elements.

    Elements and what runs and items say of them are dealt by document once, without their texts; all else is done where they meet.
    Each element sends what it counts in its document and facts (check, key): a body font, a heading's size, a paragraph's
    look or side, a number typed into a heading. Facts are counted by document, check and key, then folded by document.
    Runs and items are those of the elements: what belongs to none is not counted.
    """
    parts = int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number: tasks must not be coalesced until each holds much
    dealt = read(elements).withColumn("_element", F.lit(True)).unionByName(said(runs, items), allowMissingColumns=True).repartition(parts, "doc_id")
    of_element = {"_set": F.collect_set("_set"), "_marked": F.bool_or("_marked"), "_links": F.count_if("_links"), "_broken": F.count_if("_broken"), "_typed": F.bool_or("_typed")}
    e = dealt.withColumns({n: f.over(W.partitionBy("doc_id", "element_id")) for n, f in of_element.items()}).where("_element")
    past = in_order().rowsBetween(W.unboundedPreceding, -1)
    type_, text, level = F.col("type"), F.col("text"), F.col("level")
    heading, paragraph, table, body = type_ == "heading", type_ == "paragraph", type_ == "table", type_.isin(*BODY) & text
    empty = paragraph & ~text
    is_break, figure, caption = type_ == "page_break", type_.isin("image", "table"), type_ == "caption"
    content = ~is_break & (text | figure)

    def before(c: Column, k: int = 1) -> Column:
        return F.coalesce(F.lag(c, k).over(in_order()), F.lit(False))

    near = before(caption) | F.coalesce(F.lead(caption).over(in_order()), F.lit(False))
    e = e.withColumns({
        "_gap": heading & (level > F.last(F.when(heading, level), ignorenulls=True).over(past) + 1), "_run": empty & before(empty) & ~before(empty, 2), "_near": near, "_before": F.count_if(content).over(in_order()),
    })
    e = e.withColumn("_double", is_break & (F.col("_before") == F.last(F.when(is_break, F.col("_before")), ignorenulls=True).over(past)))
    listed = F.coalesce((type_ == "list") & F.col("ordered"), F.lit(False))
    flags = {
        "words": F.col("words"), "heads": heading, "gaps": F.col("_gap"), "runs": F.col("_run"), "body": body, "own": body & (F.col("own") | F.coalesce("_marked", F.lit(False))),
        "lists": listed, "typed": listed & F.coalesce("_typed", F.lit(False)), "tables": table, "headers": table & F.col("has_header"), "apart": table & F.col("own"),
        "figures": figure, "bare": figure & ~F.col("_near"), "captions": caption, "shown": content, "breaks": is_break, "edges": is_break & (F.col("_before") == 0), "doubled": F.col("_double"),
        "links": F.col("_links"), "broken": F.col("_broken"),
    }
    none = F.array().cast("array<struct<check:string,key:string,also:string,at:long>>")

    def a_fact(check: str, key: Column, also: Column | None = None, at: Column | None = None) -> Column:
        also, at = F.lit("") if also is None else also.cast("string"), F.lit(None) if at is None else at
        return F.struct(F.lit(check).alias("check"), key.alias("key"), also.alias("also"), at.cast("long").alias("at"))

    def fact(when: Column, *what) -> Column:
        return F.when(when, F.array(a_fact(*what))).otherwise(none)

    base = F.when(F.col("font") != "", F.array("font")).otherwise(F.array().cast("array<string>"))
    fonts_ = F.array_distinct(F.concat(base, "_set"))
    facts = F.concat(
        F.when(body, F.transform(fonts_, lambda f: a_fact("font", f))).otherwise(none), fact(heading & text, "size", F.col("size"), level), fact(paragraph & text, "look", F.col("line"), F.col("below")),
        fact(F.col("long"), "side", F.col("side")), fact(F.col("number").isNotNull(), "number", F.col("parent"), F.col("number"), F.col("ord")),
    )
    each = e.select("doc_id", "ord", *(f.cast("long").alias(n) for n, f in flags.items()), F.when(is_break, F.col("_before")).alias("last"), F.posexplode_outer(facts).alias("k", "f"))
    whole = F.coalesce("k", F.lit(0)) == 0  # an element's counts go with its first fact
    counts = each.groupBy("doc_id", *(F.col(f"f.{n}").alias(n) for n in ("check", "key", "also", "at"))).agg(
        F.count("*").alias("n"), F.min("ord").alias("first"), F.max(F.when(whole, F.col("last"))).alias("last"), *(F.sum(F.when(whole, F.col(n))).alias(n) for n in flags)
    )
    sized = F.when(F.col("check") == "size", F.struct(F.col("also").cast("int").alias("lv"), (-F.col("n")).alias("n"), "first", F.col("key").alias("size")))
    number = F.when(F.col("check") == "number", F.struct(F.col("key").alias("parent"), "at", F.col("also").cast("long").alias("own")))

    def of(check: str, f) -> Column:
        return F.coalesce(f(F.when(F.col("check") == check, F.col("n"))), F.lit(0))

    docs = counts.groupBy("doc_id").agg(
        *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in flags), F.max("last").alias("last"), F.collect_list(sized).alias("sizes"), F.array_sort(F.collect_list(number)).alias("numbers"), of("font", F.count).alias("fonts"),
        *(of(k, f).alias(n) for k, one, all_ in (("font", "font", "used"), ("look", "look", "looks"), ("side", "side", "sides")) for n, f in ((one, F.max), (all_, F.sum))),
    )
    numbers, levels = F.col("numbers"), F.array_sort(F.array_distinct(F.transform("sizes", lambda s: s["lv"])))

    def odd_one(x: Column, k: Column) -> Column:
        above = F.get(numbers, k - 1)
        return x["own"] != F.when((k > 0) & (above["parent"] == x["parent"]), above["own"]).otherwise(0) + 1

    def of_level(lv: Column) -> Column:
        own = F.filter("sizes", lambda s: s["lv"] == lv)
        return F.struct(F.size(own).alias("kinds"), X.points(F.array_min(F.transform(own, lambda s: F.struct(s["n"], s["first"], s["size"].alias("size"))))["size"]).alias("points"))

    docs = docs.withColumns({"odd": F.size(F.filter(F.transform(numbers, odd_one), lambda b: b)), "mains": F.transform(levels, of_level), "sized": F.aggregate("sizes", F.lit(0).cast("long"), lambda a, s: a - s["n"])})
    c = {n: F.col(n) for n in (*flags, "last", "fonts", "font", "used", "look", "looks", "side", "sides", "odd", "sized")}
    mixed = F.size(F.filter("mains", lambda m: m["kinds"] > 1))
    larger = F.size(F.filter(F.transform("mains", lambda m, k: (k > 0) & (m["points"] > F.get("mains", k - 1)["points"])), lambda b: b))
    split, apart = (c["headers"] > 0) & (c["headers"] < c["tables"]), (c["apart"] > 0) & (c["tables"] > 1)
    spaced, alone = c["looks"] - c["look"], (c["captions"] == 0) & (c["figures"] == 1)
    edge, doubled = (c["edges"] > 0) | F.coalesce(c["last"] == c["shown"], F.lit(False)), c["doubled"] > 0
    found = {
        "hierarchy": (F.when(c["heads"] > 0, F.when(c["gaps"] > 0, "warn").otherwise("pass")).when(c["words"] > 600, "fail").when(c["words"] > 0, "pass"), c["gaps"]),
        "fonts": (F.when(c["body"] > 0, F.when(c["fonts"] <= 1, "pass").when(c["fonts"] == 2, "warn").otherwise("fail")), c["used"] - c["font"]),
        "heading_sizes": (F.when(c["sized"] >= 2, F.when(mixed > 0, "fail").when(larger > 0, "warn").otherwise("pass")), F.when(c["sized"] >= 2, mixed + larger)),
        "spacing": (F.when(c["looks"] >= 2, F.when((spaced == 0) & (c["runs"] == 0), "pass").when(spaced > c["looks"] / 4, "fail").otherwise("warn")), F.when(c["looks"] >= 2, spaced + c["runs"])),
        "direct_formatting": (F.when(c["own"] > 0.2 * c["body"], "warn").when(c["body"] > 0, "pass"), c["own"]),
        "numbering": (F.when(F.size(numbers) + c["lists"] > 0, F.when(c["odd"] > 0, "fail").when(c["typed"] > 0, "warn").otherwise("pass")), c["odd"] + (c["typed"] > 0).cast("int")),
        "alignment": (F.when(c["sides"] >= 2, F.when(c["sides"] > c["side"], "warn").otherwise("pass")), F.when(c["sides"] >= 2, c["sides"] - c["side"])),
        "tables": (F.when(split | apart, "warn").when(c["tables"] > 0, "pass"), split.cast("int") + apart.cast("int")),
        "captions": (F.when(c["figures"] > 0, F.when((c["bare"] == 0) | alone, "pass").otherwise("warn")), F.when(alone, 0).otherwise(c["bare"])),
        "page_breaks": (F.when(edge | doubled, "warn").when(c["breaks"] > 0, "pass"), edge.cast("int") + doubled.cast("int")),
        "links": (F.when(c["broken"] > 0, "fail").when(c["links"] > 0, "pass"), c["broken"]),
    }
    return docs.select("doc_id", *(F.struct(status.alias("status"), F.coalesce(issues, F.lit(0)).cast("long").alias("issues")).alias(n) for n, (status, issues) in found.items()))
