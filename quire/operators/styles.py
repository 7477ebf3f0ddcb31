"""Style systems as relations: compiled to rules, read back from rules or from a reference document, and versioned.

A style system is long: keys, section (paragraph, headings.h1 to h6, lists, page, ...), field, value as text. A field that
is not set has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import units
from . import rules as R

#: Targets of text and their sections; fields with their properties and the unit in which a value is written.
TEXT_TARGETS = {
    "Paragraph": "paragraph", **{f"Heading {k}": f"headings.h{k}" for k in range(1, 7)}, "List": "lists", "Table": "tables", "Caption": "captions", "Quote": "quotes",
    "Footnote": "footnotes", "CodeBlock": "code",
}
TEXT_FIELDS = (
    ("fontFamily", "fontFamily", None), ("fontSizePt", "fontSize", "pt"), ("bold", "bold", None), ("italic", "italic", None), ("underline", "underline", None), ("color", "color", None),
    ("alignment", "alignment", None), ("lineSpacing", "lineSpacing", None), ("spaceBeforePt", "spaceBefore", "pt"), ("spaceAfterPt", "paragraphSpacing", "pt"), ("indentLeftCm", "indentLeft", "cm"),
    ("firstLineIndentCm", "firstLineIndent", "cm"), ("indentRightCm", "indentRight", "cm"), ("shading", "shading", None), ("keepWithNext", "keepWithNext", None), ("keepLinesTogether", "keepLinesTogether", None),
    ("widowControl", "widowControl", None), ("contextualSpacing", "contextualSpacing", None), ("direction", "direction", None), ("borderTop", "borderTop", None), ("borderBottom", "borderBottom", None),
    ("borderLeft", "borderLeft", None), ("borderRight", "borderRight", None), ("tabStops", "tabStops", None),
)
IMAGE_FIELDS = (("widthPercent", "imageWidth", "%"), ("alignment", "imageAlignment", None))
DOCUMENT_FIELDS = {
    "page": (("size", "pageSize", None), ("orientation", "orientation", None), ("marginTopCm", "marginTop", "cm"), ("marginBottomCm", "marginBottom", "cm"), ("marginLeftCm", "marginLeft", "cm"), ("marginRightCm", "marginRight", "cm")),
    "header": (("text", "header", None),), "footer": (("text", "footer", None), ("pageNumbers", "showPageNumbers", None)),
}
#: What each kind of text takes from the document where it sets nothing.
INHERITED = ("fontFamily", "color")
INHERITED_BY_CODE = ("color",)


def places(spark: SparkSession) -> DataFrame:
    """(target, section, field, property, written, inherited, place): the fixed table of about 320 places that a style system has, in compile order."""
    rows = [(t, s, f, p, u, f in (INHERITED_BY_CODE if t == "CodeBlock" else INHERITED)) for t, s in TEXT_TARGETS.items() for f, p, u in TEXT_FIELDS]
    rows += [("Image", "images", f, p, u, False) for f, p, u in IMAGE_FIELDS]
    rows += [("Document", s, f, p, u, False) for s, own in DOCUMENT_FIELDS.items() for f, p, u in own]
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "target string, section string, field string, property string, written string, inherited boolean, place int")


def compiled(styles: DataFrame, keys: list[str], *, priority: int, source: str) -> DataFrame:
    """The rules of each style system (keys, section, field, value), at one tier: what is not set gives none, but the document's font and colour hold for its kinds of text.

    Style systems are dealt first: a task that reads very many of their few bytes would lay out all their rules.
    """
    table = places(styles.sparkSession)
    styles = styles.repartition(int(styles.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys) if keys else styles
    own = styles.where("section != 'document'").join(F.broadcast(table), ["section", "field"])
    base = styles.where("section = 'document'").select(*keys, "field", F.col("value").alias("_v"))
    taken = base.join(F.broadcast(table.where("inherited")), "field")
    both = own.select(*keys, "target", "property", "written", "place", F.col("value").alias("_own"), F.lit(None).cast("string").alias("_v")).unionByName(taken.select(*keys, "target", "property", "written", "place", F.lit(None).cast("string").alias("_own"), "_v"))
    one = both.groupBy(*keys, "target", "property", "written", "place").agg(F.coalesce(F.max("_own"), F.max("_v")).alias("value"))
    return one.select(*keys, "target", "property", shown(F.col("value")).alias("value"), F.col("written").alias("unit"), F.lit(priority).alias("priority"), F.lit(source).alias("source"), F.col("place").cast("long").alias("seq"))


def shown(value: Column) -> Column:
    """A field's value as a rule has it: numbers with four decimals at most."""
    return F.when(value.rlike(units.NUMBER), units.number_text(value.try_cast("double"))).otherwise(value)


def from_rules(rules: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, target, property, section, field, value, note) of type-level rules: the winner of each target and property as its field holds it, or a note why it has no place.

    Rules of single elements describe those and are left out.
    """
    coarse = rules.where(F.col("target").isin(*R.COARSE))
    best = R.winners(coarse, [*keys, "target"]).join(F.broadcast(places(rules.sparkSession)), ["target", "property"], "left")
    value, unit, written = F.col("value"), F.col("unit"), F.col("written")
    good = units.clean_value(F.col("property"), value, unit)
    cm, pt = (units.number_text(F.round(f(good["value"], good["unit"]), 4)) for f in (units.to_cm, units.to_pt))
    held = F.when(written == "cm", cm).when(written == "pt", pt).when((written == "%") & (F.coalesce(units.unit_of(unit), F.lit("%")) != "%"), F.lit(None)).otherwise(good["value"])
    said = F.concat(F.col("target"), F.lit(": '"), F.col("property"), F.lit("'"))
    note = F.when(F.col("field").isNull(), F.concat(said, F.lit(" has no place in a style system"))).when(held.isNull(), F.concat(said, F.lit(" = '"), value, F.lit("'"), F.coalesce(F.concat(F.lit(" "), unit), F.lit("")), F.lit(" skipped")))
    return best.select(*keys, "target", "property", "section", "field", F.when(F.col("field").isNotNull(), held).alias("value"), note.alias("note"))


def template_of(rules: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(style systems, notes) of documents' type-level rules."""
    read = from_rules(rules, keys)
    return read.where("value is not null").select(*keys, "section", "field", "value"), read.where("note is not null").select(*keys, "note")


def preview(styles: DataFrame, keys: list[str]) -> DataFrame:
    """How each style system looks over the defaults: (keys, target, css, value)."""
    return R.resolve(compiled(styles, keys, priority=R.CUSTOM_TEMPLATE, source="template"), keys)


def reference_rules(elements: DataFrame, values: DataFrame, by_type: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """(doc, target, property, value, unit): the look of a reference document's kinds of text.

    elements: doc, element_id, ord, target, content. values: doc, element_id, property, value, unit, the rule that holds
    for an element. Each kind has the value that most of its text has, by length, the first seen on a tie; where most sets
    nothing it has none. A kind that the document does not use has what its style (by_type: doc, target, property, value,
    unit) defines, a heading level that it does not use where others are used the look of the nearest that is, the deeper
    on a tie.
    """
    weight = F.greatest(F.lit(1), F.length(F.trim("content")))
    own = elements.select(doc, "element_id", "target", "ord", weight.alias("w"))
    props = values.select(doc, "property").distinct()
    votes = own.join(props, doc).join(values.select(doc, "element_id", "property", F.struct("value", "unit").alias("v")), [doc, "element_id", "property"], "left")
    best = R.majority_rules(votes, [doc, "target", "property"], value="v", weight="w", seq="ord").where("v is not null").select(doc, "target", "property", "v.value", "v.unit")
    used = elements.select(doc, "target").distinct()
    defined = by_type.join(used, [doc, "target"], "left_anti").select(doc, "target", "property", "value", "unit")
    level = F.regexp_extract("target", r"^Heading ([1-6])$", 1)
    heads = used.where(level != "").select(doc, level.cast("int").alias("u"))
    wanted = heads.groupBy(doc).agg(F.collect_set("u").alias("us")).withColumn("lv", F.explode(F.array_except(F.sequence(F.lit(1), F.lit(6)), "us")))
    nearest = F.array_min(F.transform("us", lambda u: F.struct(F.abs(u - F.col("lv")).alias("d"), (-u).alias("u"))))["u"]
    copies = wanted.select(doc, F.concat(F.lit("Heading "), F.col("lv").cast("string")).alias("to"), F.concat(F.lit("Heading "), (-nearest).cast("string")).alias("target"))
    copied = best.join(copies, [doc, "target"]).select(doc, F.col("to").alias("target"), "property", "value", "unit")
    kept = defined.join(copies.select(doc, F.col("to").alias("target")), [doc, "target"], "left_anti")
    return best.unionByName(kept).unionByName(copied)


def reference_counts(elements: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """(doc, paragraphs, lists, tables, images, captions, headings): elements of each kind in a reference document, headings by level."""
    kinds = {"paragraphs": "Paragraph", "lists": "List", "tables": "Table", "images": "Image", "captions": "Caption"}
    counts = [F.count_if(F.col("target") == t).alias(n) for n, t in kinds.items()]
    levels = F.array(*(F.count_if(F.col("target") == f"Heading {k}") for k in range(1, 7)))
    return elements.groupBy(doc).agg(*counts, levels.alias("headings"))


def updated(templates: DataFrame, changes: DataFrame, fields: list[str], *, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(templates, refused) after a change of each: one new version, if anything differs and the expected version (null: any) is the current one.

    A null field of a change leaves it; texts are trimmed. refused has (key, version): the current one.
    """
    new = changes.select(key, "expected_version", *(F.trim(f).alias(f"_{f}") for f in fields))
    both = templates.join(new, key, "left")
    clash = F.coalesce(F.col("expected_version") != F.col("version"), F.lit(False))
    differs = F.lit(False)
    for f in fields:
        differs = differs | F.coalesce(~F.col(f"_{f}").eqNullSafe(F.col(f)) & F.col(f"_{f}").isNotNull(), F.lit(False))
    goes = differs & ~clash
    out = both.select(*(F.when(goes, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in fields else (F.col("version") + goes.cast("int")).alias(c) if c == "version" else F.col(c) for c in templates.columns))
    return out, both.where(clash).select(key, "version")


def restored(templates: DataFrame, versions: DataFrame, wanted: DataFrame, fields: list[str], *, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(templates, refused) after earlier versions (key, number, fields) are made current again, as new ones on top."""
    old = wanted.join(versions, [key, "number"]).select(key, "expected_version", *fields)
    return updated(templates, old, fields, key=key)
