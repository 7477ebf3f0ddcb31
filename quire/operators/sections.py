"""Sections and named styles of Word markup: page set-ups, and what each kind of block is to look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import units as U
from ..sources.markup import PART
from . import looks as L

#: Twips by the millimetre, centimetre and point, how far a page may be from a known size; how sections start, formats of page numbers.
PER_MM, PER_CM, PER_PT, TOLERANCE = 56.6929, 566.929, 20, 120
STARTS = ("nextPage", "continuous", "evenPage", "oddPage")
NUMBER_FORMATS = ("decimal", "lowerLetter", "upperLetter", "lowerRoman", "upperRoman")
#: Alignments as they are written; kinds of blocks by the name of the style that says what they look like.
ALIGNMENTS = {"left": "left", "start": "left", "center": "center", "right": "right", "end": "right", "both": "justify"}
NAMED = {**{f"Heading {n}": f"heading {n}" for n in range(1, 7)}, "Quote": "quote", "Caption": "caption", "List": "list paragraph", "Footnote": "footnote text"}
WITHOUT_INDENT, INDENTS = ("List", "Footnote"), ("indentLeftCm", "firstLineIndentCm", "indentRightCm")
TABLE_TEXT = ("fontFamily", "fontSizePt", "color")


def page_setups(rows: DataFrame, *, bounded: bool = True) -> DataFrame:
    """(key, section, last, start, size, orientation, width_mm, height_mm, the margins and distances in cm, columns, column_spacing, number_start, number_format).

    A row for each section in order, from `markup.tree` rows; last is the document's own. start is how the section behind it
    starts, which that one's properties say. Pages of no known size have none; values outside what a page can have are null,
    unless lengths are not `bounded`, but as they are written.
    """
    body = rows.where("part = 'word/document.xml'")
    parents = body.where("tag = 'body'").select(*PART, F.col("pre").alias("_body"))
    own = body.where("up_tag = 'sectPr'").groupBy(*PART, F.col("up").alias("pre")).agg(
        *(F.min_by(F.when(F.col("tag") == t, F.col("attrs")), F.when(F.col("tag") == t, F.col("pre"))).alias(t) for t in ("pgSz", "pgMar", "cols", "pgNumType", "type")))
    placed = body.where("tag = 'sectPr'").select(*PART, "pre", "up").join(own, [*PART, "pre"], "left").join(parents, PART, "left")
    at = lambda part, name: F.element_at(part, name)
    whole = lambda part, name: at(part, name).try_cast("int")

    def length(part: str, name: str, per: float, least: float, most: float) -> Column:
        x = F.bround(F.abs(whole(part, name)) / per, 2)
        return F.when((x >= least) & (x <= most), x) if bounded else x

    w, h = whole("pgSz", "w"), whole("pgSz", "h")
    short, long = F.least(w, h), F.greatest(w, h)
    size = F.lit(None).cast("string")
    for name, (wide, high) in U.PAGES.items():
        size = F.when((F.abs(short - round(wide * 56.7)) <= TOLERANCE) & (F.abs(long - round(high * 56.7)) <= TOLERANCE), name).otherwise(size)
    turned = F.when(w.isNotNull() & h.isNotNull() & (w != 0) & (h != 0), F.when((F.coalesce(at("pgSz", "orient"), F.lit("")) == "landscape") | (w > h), "landscape").otherwise("portrait"))
    wide_mm, high_mm = length("pgSz", "w", PER_MM, 50, 1600), length("pgSz", "h", PER_MM, 50, 1600)
    both = wide_mm.isNotNull() & high_mm.isNotNull()
    count = F.coalesce(at("cols", "num"), F.lit("1")).try_cast("int")
    columns = F.when((count > 1) & (count <= 10), count)
    start_at = whole("pgNumType", "start")
    order = W.partitionBy("key").orderBy("pre")
    behind = F.lead(F.coalesce(at("type", "val"), F.lit("nextPage"))).over(order)
    return placed.select(
        "key", (F.row_number().over(order) - 1).alias("section"), F.coalesce(F.col("up") == F.col("_body"), F.lit(False)).alias("last"), F.when(behind.isin(*STARTS), behind).when(behind.isNotNull(), "nextPage").alias("start"),
        F.when(turned.isNotNull(), size).alias("size"), F.coalesce(turned, F.lit("portrait")).alias("orientation"), F.when(both, wide_mm).alias("width_mm"), F.when(both, high_mm).alias("height_mm"),
        *(length("pgMar", n, PER_CM, 0, 20).alias(n) for n in ("top", "bottom", "left", "right", "header", "footer")), columns.alias("columns"), F.when(columns.isNotNull(), length("cols", "space", PER_CM, 0, 20)).alias("column_spacing"),
        F.when(start_at.between(0, 99_999), start_at).alias("number_start"), F.when(at("pgNumType", "fmt").isin(*NUMBER_FORMATS), at("pgNumType", "fmt")).alias("number_format"),
    )


def own_values(rows: DataFrame) -> DataFrame:
    """(key, part, owner, values): what paragraph and run properties say, as a map by property; owner is the number of what holds them."""
    said = rows.where("up_tag in ('pPr', 'rPr')").withColumn("owner", F.col("over"))
    tag, val = F.col("tag"), L.attr("val")
    switch = F.when(L.on(L.attr("val", "true")), "true").otherwise("false")
    number = lambda name, per: U.number_text(F.bround(L.attr(name).try_cast("int") / per, 2))
    first = F.coalesce(U.number_text(F.bround(-L.attr("hanging").try_cast("int") / PER_CM, 2)), number("firstLine", PER_CM))
    alignments = F.create_map(*(F.lit(x) for kv in ALIGNMENTS.items() for x in kv))
    given = (
        ("fontFamily", tag == "rFonts", F.coalesce(L.attr("ascii"), L.attr("hAnsi"))), ("fontSizePt", tag == "sz", number("val", 2)), ("bold", tag == "b", switch), ("italic", tag == "i", switch), ("underline", tag == "u", F.when(val == "none", "false").otherwise("true")),
        ("color", (tag == "color") & val.rlike("^[0-9A-Fa-f]{6}$"), F.concat(F.lit("#"), F.upper(val))), ("alignment", tag == "jc", alignments[val]), ("spaceBeforePt", tag == "spacing", number("before", PER_PT)), ("spaceAfterPt", tag == "spacing", number("after", PER_PT)),
        ("lineSpacing", (tag == "spacing") & (L.attr("lineRule", "auto") == "auto"), number("line", 240)), ("indentLeftCm", tag == "ind", F.coalesce(number("left", PER_CM), number("start", PER_CM))), ("firstLineIndentCm", tag == "ind", first),
        ("indentRightCm", tag == "ind", F.coalesce(number("right", PER_CM), number("end", PER_CM))), ("keepWithNext", tag == "keepNext", switch), ("keepLinesTogether", tag == "keepLines", switch), ("widowControl", tag == "widowControl", switch), ("contextualSpacing", tag == "contextualSpacing", switch),
    )
    each = said.select(*PART, "owner", "pre", F.explode(F.array_compact(F.array(*(F.when(cond & v.isNotNull(), F.struct(F.lit(n).alias("p"), v.alias("v"))) for n, cond, v in given)))).alias("s"))
    best = each.groupBy(*PART, "owner", F.col("s.p").alias("p")).agg(F.min_by("s.v", "pre").alias("v"))
    return best.groupBy(*PART, "owner").agg(F.map_from_entries(F.collect_list(F.struct("p", "v"))).alias("values"))


def beneath(own: str, base: str) -> Column:
    """A map of values with another one beneath it."""
    none = F.create_map().cast("map<string,string>")
    held = F.coalesce(F.col(own), none)
    return F.map_concat(held, F.map_filter(F.coalesce(F.col(base), none), lambda k, v: ~F.array_contains(F.map_keys(held), k)))


def style_systems(rows: DataFrame) -> DataFrame:
    """(key, target, property, value): what a package's named styles, resolved through what they are based on and the defaults, make of each kind of block.

    Headings are told only where their style is there; quotes, captions, lists and footnotes without a style of their own
    look like the default paragraph; lists and footnotes take no indents, which their numbering draws; tables take the
    default paragraph's text and no space behind.
    """
    sheet = rows.where("part = 'word/styles.xml'")
    of = own_values(sheet)
    named = lambda tag, name: sheet.where(F.col("tag") == tag).groupBy(*PART, F.col("up").alias("pre")).agg(F.min_by(L.attr("val"), "pre").alias(name))
    styles = sheet.where("tag = 'style'").select(*PART, "pre", L.attr("styleId", "").alias("style"), (L.attr("type", "") == "paragraph").alias("_p"), F.lower(L.attr("default", "")).isin("1", "true", "on").alias("_d"))
    styles = styles.join(named("basedOn", "base"), [*PART, "pre"], "left").join(named("name", "name"), [*PART, "pre"], "left").join(of.withColumnRenamed("owner", "pre"), [*PART, "pre"], "left")
    one = styles.groupBy("key", "style").agg(F.max_by(F.struct("base", F.col("values").alias("look")), "pre").alias("s")).select("key", "style", "s.base", "s.look")
    known = L.resolved_styles(one, beneath)
    holders = sheet.where("tag in ('pPrDefault', 'rPrDefault')").select(*PART, F.col("pre").alias("owner"), "tag")
    defaults = of.join(holders, [*PART, "owner"]).groupBy("key").agg(F.map_from_entries(F.flatten(F.collect_list(F.map_entries("values")))).alias("_base"))
    usual = styles.where("_p and _d").groupBy("key").agg(F.max_by("style", "pre").alias("_usual"))
    keys = rows.select("key").distinct().join(usual, "key", "left")
    by_name = styles.where("_p").groupBy("key", F.lower("name").alias("_name")).agg(F.max_by("style", "pre").alias("_named"))
    wanted = keys.select("key", "_usual", F.explode(F.array(F.struct(F.lit("Paragraph").alias("target"), F.lit("").alias("_name")), F.struct(F.lit("Table").alias("target"), F.lit("").alias("_name")), *(F.struct(F.lit(t).alias("target"), F.lit(n).alias("_name")) for t, n in NAMED.items()))).alias("w")).select("key", "_usual", "w.*")
    found = wanted.join(by_name, ["key", "_name"], "left").where(~F.col("target").startswith("Heading") | F.col("_named").isNotNull())
    found = found.select("key", "target", F.coalesce("_named", "_usual").alias("style")).join(known, ["key", "style"], "left").join(defaults, "key", "left")
    told = found.select("key", "target", F.explode(beneath("look", "_base")).alias("property", "value"))
    table, bare = F.col("target") == "Table", F.col("target").isin(*WITHOUT_INDENT)
    told = told.where((~table | F.col("property").isin(*TABLE_TEXT)) & (~bare | ~F.col("property").isin(*INDENTS[:2])))
    return told.unionByName(keys.select("key", F.lit("Table").alias("target"), F.lit("spaceAfterPt").alias("property"), F.lit("0").alias("value")))
