"""The rule cascade: which formatting rule wins, what it looks like, what overrides it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import units

#: Tiers of priority (the lower wins), page properties, block kinds and their targets, the base look.
LIVE_OVERRIDE, INSTRUCTION, CUSTOM_TEMPLATE, BUILT_IN_TEMPLATE, SOURCE_DOCUMENT, DEFAULT = 1, 2, 4, 5, 6, 8
PAGE_PROPERTIES = ("pageSize", "orientation", "marginTop", "marginBottom", "marginLeft", "marginRight", "header", "footer", "showPageNumbers")
TARGETS = {"list": "List", "table": "Table", "image": "Image", "quote": "Quote", "caption": "Caption", "footnote": "Footnote", "code_block": "CodeBlock", "page_break": "PageBreak", "section_break": "SectionBreak", "horizontal_rule": "HorizontalRule"}
COARSE = ("Document", "Paragraph", *TARGETS.values(), *(f"Heading {k}" for k in range(1, 7)))
HEADINGS = ((1, "20", "18", "6"), (2, "16", "14", "6"), (3, "14", "12", "4"), (4, "12", "10", "4"), (5, "11", "10", "4"), (6, "11", "10", "4"))
BODY_TEXT = ("font-family", "font-size", "color", "line-height", "--line-spacing", "text-align")
FROM_BODY = {
    **{f"Heading {k}": ("font-family", "color") for k in range(1, 7)}, "List": BODY_TEXT, "Quote": BODY_TEXT, "Table": BODY_TEXT[:5],
    "Caption": ("font-family", "color", "text-align", "line-height", "--line-spacing"), "Footnote": ("font-family", "color", "line-height", "--line-spacing"), "CodeBlock": ("color",),
}
#: Rules that one request may bring; they become literals of the plan.
MOST_RULES = 10_000
RULES = T.StructType([T.StructField("target", T.StringType()), T.StructField("property", T.StringType()), T.StructField("value", T.StringType()), T.StructField("unit", T.StringType()), T.StructField("priority", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("seq", T.LongType())])


def default_rows() -> list[tuple]:
    """The base look and page as (target, property, value, unit)."""
    rows = [("Paragraph", "fontFamily", "Arial", None), ("Paragraph", "fontSize", "11", "pt"), ("Paragraph", "alignment", "left", None), ("Paragraph", "lineSpacing", "1", None), ("Paragraph", "paragraphSpacing", "8", "pt")]
    for level, size, before, after in HEADINGS:
        own = f"Heading {level}"
        rows += [(own, "fontSize", size, "pt"), (own, "bold", "true", None), (own, "lineSpacing", "1", None), (own, "spaceBefore", before, "pt"), (own, "paragraphSpacing", after, "pt")]
        rows += [(own, "italic", "true", None)] if level == 6 else []
    rows += [("List", "paragraphSpacing", "8", "pt"), ("Table", "paragraphSpacing", "8", "pt"), ("Quote", "italic", "true", None), ("Quote", "indentLeft", "1", "cm"), ("Quote", "paragraphSpacing", "8", "pt")]
    rows += [("Caption", "fontSize", "9", "pt"), ("Caption", "italic", "true", None), ("Caption", "paragraphSpacing", "8", "pt"), ("Footnote", "fontSize", "9", "pt")]
    rows += [("CodeBlock", "fontFamily", "Courier New", None), ("CodeBlock", "fontSize", "10", "pt"), ("CodeBlock", "lineSpacing", "1", None), ("CodeBlock", "paragraphSpacing", "8", "pt")]
    return rows + [("Document", "pageSize", "A4", None), ("Document", "orientation", "portrait", None)]


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, DEFAULT, "default", k) for k, r in enumerate(default_rows())], RULES)


def default_looks(spark: SparkSession, base: list[tuple]) -> list[tuple]:
    """(target, property, pairs of css and value) of the default rules: a fixed table of about 60 rows, which the optimizer works out without a job."""
    def quoted(x) -> str:
        return "null" if x is None else "'" + x + "'"

    values = ", ".join(f"({k}, {quoted(v)}, {quoted(p)}, {quoted(u)})" for k, (_, p, v, u) in enumerate(base))
    rows = spark.sql(f"select * from values {values} as t(k, value, property, unit)")
    shown = rows.select("k", units.css_of(F.col("property"), F.col("value"), F.col("unit").cast("string")).alias("pairs")).collect()
    return [(base[r.k][0], base[r.k][1], [tuple(p) for p in r.pairs]) for r in sorted(shown)]


def target_of(kind: Column, level: Column) -> Column:
    """Style target of an element: the key between elements and styles."""
    return F.when(kind == "heading", F.concat(F.lit("Heading "), F.coalesce(level, F.lit(1)).cast("string"))).otherwise(F.coalesce(units.mapped(TARGETS, kind), F.lit("Paragraph")))


def stacked(*relations: DataFrame) -> DataFrame:
    """Rule relations one after another; seq is dealt anew in that order, so that ties still go to the first."""
    out = None
    for k, r in enumerate(relations):
        own = r.withColumn("seq", F.lit(k).cast("long") * (1 << 40) + F.col("seq"))
        out = own if out is None else out.unionByName(own)
    return out


def usable(rules: DataFrame) -> DataFrame:
    """Rules that can be drawn, with their values as they are drawn."""
    made = units.clean_value(F.col("property"), F.col("value"), F.col("unit"))
    rest = [c for c in rules.columns if c not in ("value", "unit")]
    return rules.select(*rest, F.inline(F.array_compact(F.array(made)))).select(rules.columns)  # a generator: the value is cleaned once


def winners(rules: DataFrame, keys: list[str], *, specific: Column | None = None) -> DataFrame:
    """The rule that wins each property of each key: lowest priority, then the more specific target, then the first.

    A least struct, so each task sends one candidate of a key and property at most.
    """
    order = F.struct(F.col("priority"), *([F.when(specific, 0).otherwise(1).alias("s")] if specific is not None else []), F.col("seq"))
    rest = [c for c in rules.columns if c not in (*keys, "property")]
    return rules.groupBy(*keys, "property").agg(F.min_by(F.struct(*rest), order).alias("_w")).select(*keys, "property", *(F.col(f"_w.{c}").alias(c) for c in rest)).select(rules.columns)


def css_rows(rules: DataFrame, keys: list[str]) -> DataFrame:
    return rules.select(*keys, F.inline(units.css_of(F.col("property"), F.col("value"), F.col("unit"))))


def resolve(rules: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, target, css, value): the look of each target of each key.

    The rules of a key meet in one shuffle, its winning ones in one row; the fixed table of what the defaults give and of
    what each kind of text takes from Paragraph is laid out beside them, and each of its rows asks the few own ones whether
    it holds, so nothing is joined. A key needs memory for its own winning rules. Keys without a usable rule have the defaults.
    """
    parts = int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but each key becomes about 85 rows: not to be coalesced
    met = rules.repartition(parts, *keys) if keys else rules
    marked = met.withColumn("_c", units.clean_value(F.col("property"), F.col("value"), F.col("unit")))
    counts = F.col("_c").isNotNull() & ~F.col("property").isin(*PAGE_PROPERTIES) & (F.col("target") != "Document")
    order = F.struct((~counts).cast("int").alias("n"), F.col("priority"), F.col("seq"))
    best = marked.groupBy(*keys, "target", "property").agg(F.min_by(F.when(counts, F.struct("_c.value", "_c.unit", "priority")), order).alias("w"))
    base = [(t, p, v, u) for t, p, v, u in default_rows() if t != "Document"]
    given = F.concat_ws("/", "target", "property")
    loses = (F.col("w.priority") > DEFAULT) & given.isin(*(f"{t}/{p}" for t, p, _, _ in base))
    look = F.struct("target", given.alias("rule"), units.css_of(F.col("property"), F.col("w.value"), F.col("w.unit")).alias("pairs"))
    own = best.groupBy(*keys).agg(F.collect_list(F.when(F.col("w").isNotNull() & ~loses, look)).alias("own"))
    kind = "array<struct<how:int,target:string,css:string,value:string,rule:string>>"
    flat = F.flatten(F.transform("own", lambda r: F.transform(r["pairs"], lambda x: F.struct(F.lit(OWN).alias("how"), r["target"].alias("target"), x["css"].alias("css"), x["value"].alias("value"), r["rule"].alias("rule")))))
    own = own.select(*keys, F.transform("own", lambda r: r["rule"]).alias("set"), flat.cast(kind).alias("rows"))
    own = own.withColumns({
        "here": F.transform("rows", lambda r: F.concat_ws("/", r["target"], r["css"])),
        "body": F.map_from_entries(F.transform(F.filter("rows", lambda r: r["target"] == "Paragraph"), lambda r: F.struct(r["css"], r["value"]))),
    })
    slots = F.array(*(F.struct(*map(F.lit, s)) for s in slots_of(default_looks(rules.sparkSession, base)))).cast(kind)
    each = own.select(*keys, "set", "here", "body", F.inline(F.concat("rows", slots)))
    how, css = F.col("how"), F.col("css")
    held = F.map_contains_key("body", css)
    taken = (how == TAKEN) & ~F.array_contains("here", F.col("rule")) & (held | F.col("value").isNotNull())
    shown = (how == OWN) | ((how == GIVEN) & ~F.array_contains("set", F.col("rule"))) | taken
    return each.where(shown).select(*keys, "target", "css", F.when((how == TAKEN) & held, F.element_at("body", css)).otherwise(F.col("value")).alias("value"))


#: Where a row of a look is from: the key's own rule, a default rule, or Paragraph.
OWN, GIVEN, TAKEN = range(3)


def slots_of(looks: list[tuple]) -> list[tuple]:
    """(how, target, css, value, rule) of what a key without rules has: a fixed table of about 100 rows.

    A rule gives the same css whatever its value, and every target that takes from Paragraph has defaults, so what a
    default rule sets is set in any case, and only what none sets can be taken: there `rule` is the target and css, and
    value what Paragraph has by default, null if nothing.
    """
    given = [(GIVEN, t, css, v, f"{t}/{p}") for t, p, pairs in looks for css, v in pairs]
    set_, body = {(t, css) for _, t, css, _, _ in given}, {css: v for _, t, css, v, _ in given if t == "Paragraph"}
    return given + [(TAKEN, t, css, body.get(css), f"{t}/{css}") for t, own in FROM_BODY.items() for css in own if (t, css) not in set_]


def settings(rules: DataFrame, keys: list[str]) -> DataFrame:
    """Page settings of each key from the winning Document rules."""
    own = winners(usable(rules).where(F.col("property").isin(*PAGE_PROPERTIES) & (F.col("target") == "Document")), keys)
    is_, cm = (lambda p: F.col("property") == p), units.to_cm(F.col("value"), F.col("unit"))
    wide = [F.max(F.when(is_(p), F.col("value"))).alias(p) for p in ("pageSize", "orientation", "header", "footer")]
    wide += [F.max(F.when(is_(p), cm)).alias(f"{p}Cm") for p in PAGE_PROPERTIES if p.startswith("margin")]
    wide += [F.max(F.when(is_("showPageNumbers"), F.col("value"))).alias("showPageNumbers")]
    return own.groupBy(*keys).agg(*wide)


def element_styles(elements: DataFrame, rules: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, element_id, css, value) of elements with rules of their own, which beat those of their kind within a tier."""
    spark = rules.sparkSession
    named = elements.withColumn("coarse", target_of(F.col("type"), F.col("level")))
    held = named.join(rules.select(doc, F.col("target").alias("element_id")).distinct(), [doc, "element_id"], "left_semi").select(doc, "element_id", "coarse")
    own = usable(rules).where(~F.col("property").isin(*PAGE_PROPERTIES))
    base = usable(default_rules(spark)).withColumn("seq", F.col("seq") + (1 << 50))
    mine = held.join(own, [doc]).where((F.col("target") == F.col("coarse")) | (F.col("target") == F.col("element_id")))
    theirs = held.join(F.broadcast(base), F.col("target") == F.col("coarse"))
    every = mine.unionByName(theirs)
    best = winners(every, [doc, "element_id"], specific=F.col("target") == F.col("element_id"))
    return css_rows(best, [doc, "element_id"])


def style_ref(elements: DataFrame, rules: DataFrame, doc: str = "doc_id") -> DataFrame:
    """elements with styleRef: the element's own id where a rule names it, else its kind's target."""
    own = rules.select(doc, F.col("target").alias("element_id"), F.lit(True).alias("_own")).distinct()
    out = elements.join(own, [doc, "element_id"], "left")
    return out.withColumn("styleRef", F.when(F.col("_own"), F.col("element_id")).otherwise(target_of(F.col("type"), F.col("level")))).drop("_own")


def conflicts(elements: DataFrame, rules: DataFrame, incoming: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Live overrides that incoming rules would change: those whose winner for the element's kind differs in value or unit."""
    live = rules.where(F.col("priority") == LIVE_OVERRIDE).select(doc, F.col("target").alias("element_id"), "property", F.col("value").alias("currentValue"), F.col("unit").alias("currentUnit"))
    kind = elements.select(doc, "element_id", target_of(F.col("type"), F.col("level")).alias("target"))
    best = incoming.groupBy("target", "property").agg(F.min_by(F.struct(F.col("value").alias("requiredValue"), F.col("unit").alias("requiredUnit")), F.struct("priority", "seq")).alias("w"))
    met = live.join(kind, [doc, "element_id"]).join(best, ["target", "property"])
    same = F.col("currentValue").eqNullSafe(F.col("w.requiredValue")) & F.col("currentUnit").eqNullSafe(F.col("w.requiredUnit"))
    return met.where(~same).select(doc, "element_id", "property", "currentValue", "currentUnit", "w.requiredValue", "w.requiredUnit")


def prune(rules: DataFrame, elements: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rules whose target still exists: a coarse one, or an element of the document."""
    coarse = rules.where(F.col("target").isin(*COARSE))
    own = rules.where(~F.col("target").isin(*COARSE)).join(elements.select(doc, F.col("element_id").alias("target")), [doc, "target"], "left_semi")
    return coarse.unionByName(own.select(coarse.columns))


def given_to(everyone: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules of one request, MOST_RULES at most, for each row of everyone."""
    rows = rules.limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules in a request")
    kind = f"array<{rules.schema.simpleString()}>"
    literal = F.array(*(F.struct(*(F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in rules.schema)) for r in rows)).cast(kind)
    return everyone.select("*", F.inline(literal))


def reformat(rules: DataFrame, template: DataFrame, instructions: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """The rules after formatting anew: defaults, the source's own, template, instructions, and the overrides that are not dropped."""
    everyone = rules.select(*keys).distinct() if keys else rules.sparkSession.range(1).select()
    kept = rules.where(F.col("priority") == LIVE_OVERRIDE).join(dropped, [*keys, "target", "property"], "left_anti")
    own = rules.where("source = 'source_document'").select(*keys, *RULES.names)
    base, made, asked = (given_to(everyone, r) for r in (default_rules(rules.sparkSession), template, instructions))
    return stacked(base, own, made, asked, kept.select(*keys, *RULES.names))


def set_overrides(rules: DataFrame, wanted: DataFrame, elements: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Batch upsert of overrides: one (target, property) each, a null value clears it, the last wanted of several counts.

    A target is an element of the document, or Document with a page property. Unknown elements and values that cannot be
    drawn are skipped, and an override that says the same already stays as it is.
    """
    keys = [doc, "target", "property"]
    page = (F.col("target") == "Document") & F.col("property").isin(*PAGE_PROPERTIES)
    known = elements.select(doc, F.col("element_id").alias("target")).distinct()
    asked = wanted.where(page).unionByName(wanted.where(F.col("target") != "Document").join(known, [doc, "target"], "left_semi").select(wanted.columns))
    asked = asked.withColumn("_c", units.clean_value(F.col("property"), F.col("value"), F.col("unit"))).where("value is null or _c is not null")
    asked = asked.groupBy(*keys).agg(F.max_by(F.struct(F.col("_c.value").alias("value"), F.col("_c.unit").alias("unit"), "seq"), "seq").alias("_w"))
    live = (F.col("priority") == LIVE_OVERRIDE)
    both = rules.where(live).join(asked, keys, "left")
    same = F.col("_w.value").eqNullSafe(F.col("value")) & F.col("_w.unit").eqNullSafe(F.col("unit"))
    stays = both.where(F.col("_w").isNull() | same).select(rules.columns)
    new = asked.where("_w.value is not null").select(*keys, "_w.value", "_w.unit", F.lit(LIVE_OVERRIDE).alias("priority"), F.lit("live_override").alias("source"), "_w.seq")
    new = new.join(stays.select(*keys), keys, "left_anti")
    return rules.where(~live).unionByName(stays).unionByName(new.select(rules.columns))


def majority_rules(values: DataFrame, keys: list[str], *, value: str, weight: str, seq: str) -> DataFrame:
    """The value with the greatest total weight of each key, null among the candidates; the first seen wins a tie."""
    each = values.groupBy(*keys, value).agg(F.sum(weight).alias("w"), F.min(seq).alias("s"))
    return each.groupBy(*keys).agg(F.min_by(F.struct(F.col(value).alias(value), F.col("w").alias("weight")), F.struct(-F.col("w"), F.col("s"))).alias("b")).select(*keys, f"b.{value}", "b.weight")
