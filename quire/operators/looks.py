"""Looks of Word markup resolved over interval-numbered elements: runs through their styles, cells through a table style's regions, pictures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import markup, packages
from ..sources.markup import PART
from ..sources.packages import UNDERLINES
from ..sources.tables import written

OFF = ("0", "false", "off", "none")
#: What a run's look is resolved for; effects that are switched, effects by value, effects that only have to be there.
LOOK = ("hidden", "underline", "scale", "effects")
SWITCHED, VALUED, PRESENT = ("outline", "shadow", "emboss", "imprint"), ("effect", "bdr", "em"), ("fitText", "eastAsianLayout")
WORD_2010 = "http://schemas.microsoft.com/office/word/2010/wordml"
#: The regions of a table style, later ones over earlier ones; the bits of an old table look.
REGIONS = ("wholeTable", "band1Vert", "band2Vert", "band1Horz", "band2Horz", "firstCol", "lastCol", "firstRow", "lastRow", "neCell", "nwCell", "seCell", "swCell")
LOOK_BITS = {"firstRow": 0x0020, "lastRow": 0x0040, "firstColumn": 0x0080, "lastColumn": 0x0100, "noHBand": 0x0200, "noVBand": 0x0400}
#: Fixed values of pictures: lengths by the centimetre, turns by the degree, shares by one; how text wraps; what a place may be counted from and aligned to.
EMU_PER_CM, TURN_PER_DEGREE, SHARE_OF_ONE = 360_000, 60_000, 100_000
WRAPS = {"wrapSquare": "square", "wrapTight": "tight", "wrapThrough": "through", "wrapTopAndBottom": "topAndBottom"}
FROM = {"positionH": ("character", "column", "margin", "page", "leftMargin", "rightMargin", "insideMargin", "outsideMargin"), "positionV": ("line", "paragraph", "margin", "page", "topMargin", "bottomMargin", "insideMargin", "outsideMargin")}
DRAWN = ("docPr", "extent", "srcRect", "xfrm", "anchor", *WRAPS, *FROM, "align", "posOffset")
ALIGN = {"positionH": ("left", "center", "right", "inside", "outside"), "positionV": ("top", "center", "bottom", "inside", "outside")}


def attr(name: str, default: str | None = None) -> Column:
    value = F.element_at("attrs", name)
    return value if default is None else F.coalesce(value, F.lit(default))


def on(value: Column) -> Column:
    return ~F.lower(value).isin(*OFF)


def effect(tag: Column, space: Column, value: Column) -> Column:
    """Whether a run property gives a run an effect."""
    valued = F.when(tag == "bdr", ~F.coalesce(value, F.lit("")).isin("nil", "none")).otherwise(F.coalesce(value, F.lit("")) != "none")
    return (tag.isin(*SWITCHED) & on(F.coalesce(value, F.lit("true")))) | (tag.isin(*VALUED) & valued) | tag.isin(*PRESENT) | (space == WORD_2010)


#: The run property that says each part of a look, and what it says by its value.
SAYS = {
    "hidden": ("vanish", lambda v: on(F.coalesce(v, F.lit("true")))), "underline": ("u", lambda v: F.coalesce(v, F.lit("single"))),
    "scale": ("w", lambda v: F.when(v.rlike(r"^\d+$"), v.cast("int"))), "rtl": ("rtl", lambda v: on(F.coalesce(v, F.lit("true")))),
}


def own_looks(rows: DataFrame) -> DataFrame:
    """(key, part, owner, hidden, underline, scale, effects, rtl): what run properties say themselves; owner is the number of what holds them."""
    said = rows.where("up_tag = 'rPr'").withColumn("owner", F.col("over"))
    tag, value = F.col("tag"), attr("val")
    first = {p: F.min_by(F.when(tag == of, says(value)), F.when(tag == of, F.col("pre"))) for p, (of, says) in SAYS.items()}
    first["effects"] = F.max(F.when(effect(tag, F.col("space"), value), F.lit(True)))
    return said.groupBy(*PART, "owner").agg(*(first[p].alias(p) for p in (*LOOK, "rtl")))


def said_first(said: Column, tag: str, says: Callable[[Column], Column] = lambda v: v) -> Column:
    """What the first property of a tag says, of those of a run as an array (see `markup.runs`); null without one."""
    at = F.array_position(said["tag"], tag)
    return F.when(at > 0, says(F.get(said["value"], (at - 1).cast("int"))))


def said_looks(said: Column) -> dict[str, Column]:
    """What `own_looks` tells by name, of a run's properties as an array."""
    effects = F.when(F.exists(said, lambda x: F.coalesce(effect(x["tag"], x["space"], x["value"]), F.lit(False))), F.lit(True))
    return {"effects": effects, **{p: said_first(said, *of) for p, of in SAYS.items()}}


def over(own: str, base: str) -> Column:
    """A look with another one beneath it, property by property."""
    return F.struct(*(F.coalesce(F.col(f"{own}.{p}"), F.col(f"{base}.{p}")).alias(p) for p in LOOK))


def resolved_styles(styles: DataFrame, merged: Callable[[str, str], Column] = over) -> DataFrame:
    """(key, style, look) of (key, style, base, look): a style's own look over that of the style it is based on, and so on.

    `merged` says what one look over another is, of the names of their columns.

    Each round takes a style as far again up as all before; there are as many rounds as the number of a package's styles
    has bits, so chains of any length are followed; in a ring every style is beneath itself, which changes nothing.
    """
    now = written(styles.select("key", "style", "base", "look"), "styles")
    most = now.groupBy("key").count().agg(F.max("count")).first()[0] or 1
    for _ in range(most.bit_length()):
        above = now.select("key", F.col("style").alias("base"), F.col("base").alias("_base"), F.col("look").alias("_look"))
        now = written(now.join(above, ["key", "base"], "left").select("key", "style", F.col("_base").alias("base"), merged("look", "_look").alias("look")), "styles")
    return now.select("key", "style", "look")


def sheet_looks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, style, look) of all styles, followed, and (key, usual, base): the default paragraph style's name and the look of the document's defaults."""
    sheet = rows.where(F.col("part") == markup.SHEET)
    of = own_looks(sheet).select(*PART, F.col("owner").alias("pre"), F.struct(*LOOK).alias("look"))
    based = sheet.where("tag = 'basedOn'").groupBy(*PART, F.col("up").alias("pre")).agg(F.min_by(attr("val"), "pre").alias("base"))
    styles = sheet.where("tag = 'style'").select(*PART, "pre", attr("styleId", "").alias("style"), (attr("type", "") == "paragraph").alias("paragraph"), F.lower(attr("default", "")).isin("1", "true", "on").alias("default"))
    styles = styles.join(based, [*PART, "pre"], "left").join(of, [*PART, "pre"], "left")
    known = resolved_styles(styles.groupBy("key", "style").agg(F.max_by(F.struct("base", "look"), "pre").alias("s")).select("key", "style", "s.base", "s.look"))
    usual = styles.where("paragraph and `default`").groupBy("key").agg(F.max_by("style", "pre").alias("usual"))
    base = sheet.where("tag = 'rPrDefault'").select(*PART, "pre").join(of, [*PART, "pre"]).groupBy("key").agg(F.min_by("look", "pre").alias("base"))
    return written(known, "looks"), written(usual.join(base, "key", "full"), "looks")


def shown(runs: DataFrame, sheets: tuple[DataFrame, DataFrame], key: str) -> DataFrame:
    """What `run_looks` tells, of runs (key, seq, text, _own, rtl, _character, _named); `key` has the name of their sheet."""
    known, whole = sheets
    runs = runs.join(whole.withColumnRenamed("key", key), key, "left").withColumn("_style", F.coalesce("_named", "usual"))
    for name, by in (("_c", "_character"), ("_s", "_style")):
        runs = runs.join(known.select(F.col("key").alias(key), F.col("style").alias(by), F.col("look").alias(name)), [key, by], "left")
    told = {p: F.coalesce(*(F.col(f"{x}.{p}") for x in ("_own", "_c", "_s", "base"))) for p in LOOK}
    return runs.select("key", "seq", "text", *(c.alias(p) for p, c in told.items()), F.coalesce("rtl", F.lit(False)).alias("rtl"))


def run_looks(rows: DataFrame) -> DataFrame:
    """(key, seq, text, hidden, underline, scale, effects, rtl) of the body's runs that have text and are not deleted or moved away.

    A run's own properties come first, then its character style, its paragraph's style (the default one, if it names none)
    and the document's defaults. `rows` are `markup.tree` of all parts; they are read several times, so write them first.
    """
    body = rows.where(F.col("part") == markup.BODY)
    said = own_looks(body).select(*PART, F.col("owner").alias("pre"), F.struct(*LOOK).alias("_own"), "rtl")
    styled = lambda tag, holder, name: body.where((F.col("tag") == tag) & (F.col("up_tag") == holder)).groupBy(*PART, F.col("over").alias("pre")).agg(F.min_by(attr("val"), "pre").alias(name))
    texts = body.where("tag = 't'").groupBy(*PART, F.col("up").alias("pre")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("pre").alias("n"), F.coalesce("text", F.lit("")).alias("t")))), lambda s: s["t"]), "").alias("text"))
    runs = body.where("tag = 'r' and in_away is null").select(*PART, "pre", F.col("in_p").alias("_p")).join(texts, [*PART, "pre"]).where(F.trim("text") != "")
    runs = runs.join(said, [*PART, "pre"], "left").join(styled("rStyle", "rPr", "_character"), [*PART, "pre"], "left")
    runs = runs.join(styled("pStyle", "pPr", "_named").withColumnRenamed("pre", "_p"), [*PART, "_p"], "left")
    return shown(runs.withColumnRenamed("pre", "seq"), sheet_looks(rows), "key")


def run_looks_of(texts: DataFrame) -> DataFrame:
    """The same of (key, document, styles), the texts of packages' bodies and style sheets.

    A sheet that many packages have is read and followed once. Runs come with what is around them and take from their sheet
    what their styles give: elements are neither written nor shuffled.
    """
    sheet = F.unhex(F.sha2("styles", 256))
    sheets = texts.where("styles is not null").select("styles").distinct().select(sheet.alias("key"), F.lit(markup.SHEET).alias("part"), F.col("styles").alias("xml"))
    followed = sheet_looks(written(markup.tree(sheets), "markup"))
    runs = markup.runs(texts.select("key", sheet.alias("_sheet"), F.col("document").alias("xml"))).where(F.trim("text") != "")
    said = said_looks(F.col("said"))
    runs = runs.select("key", "_sheet", "seq", "text", F.struct(*(said[p].alias(p) for p in LOOK)).alias("_own"), said["rtl"].alias("rtl"), said_first(F.col("said"), "rStyle").alias("_character"), F.col("style").alias("_named"))
    return shown(runs, followed, "_sheet")


def not_shown() -> dict[str, Column]:
    """By feature, whether a run's look is one that is not shown as it is."""
    return {"hidden": F.col("hidden"), "underline": F.col("underline").isin(*UNDERLINES), "scale": F.col("scale") != 100, "effects": F.col("effects"), "rtl": F.col("rtl")}


def look_features(rows: DataFrame) -> DataFrame:
    """(key, feature, n, text, seq) of the looks of runs that are not shown as they are, for `fidelity.findings`; styles are followed."""
    return told(run_looks(rows))


def told(runs: DataFrame) -> DataFrame:
    """What `look_features` tells of the looks of runs."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in not_shown().items())))
    return runs.select("key", F.explode(found).alias("feature"), F.lit(1).alias("n"), "text", "seq")


def counted(runs: DataFrame) -> DataFrame:
    """(key, feature, n): how many of a package's runs have looks that are not shown as they are."""
    n = runs.groupBy("key").agg(*(F.count_if(c).alias(f) for f, c in not_shown().items()))
    return n.select("key", F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("n")) for f in not_shown())))).where("n > 0")


def features(files: DataFrame) -> DataFrame:
    """(key, feature, n, text, seq) of packages (key, content): what they have that is not shown, looks that come from styles among it."""
    others = packages.features(packages.nodes(files)).where(~F.col("feature").isin("hidden", "underline", "scale", "effects", "rtl"))
    return others.unionByName(told(run_looks_of(markup.bodies(files))))


def look_flags(value: Column, own: Column) -> Column:
    """struct of which parts of its style a table shows: what the attribute says (`own`, a map), else the bit of the old hexadecimal field."""
    bits = F.coalesce(F.conv(F.when(value.rlike("^[0-9A-Fa-f]+$"), value), 16, 10).cast("long"), F.lit(0))

    def flag(name: str) -> Column:
        said = F.element_at(own, name)
        return F.when(said.isNotNull(), F.lower(said).isin("1", "true", "on")).otherwise(bits.bitwiseAND(F.lit(LOOK_BITS[name])) != 0)

    return F.struct(*(flag(n).alias(n) for n in ("firstRow", "lastRow", "firstColumn", "lastColumn")), (~flag("noHBand")).alias("bandedRows"), (~flag("noVBand")).alias("bandedColumns"))


def cell_regions(row: Column, col: Column, rows: Column, cols: Column, look: Column) -> Column:
    """The regions of a table style that a cell is in, weakest first. Bands count from the first row and column that are not set apart."""
    top, bottom, left, right = look["firstRow"] & (row == 0), look["lastRow"] & (row == rows - 1), look["firstColumn"] & (col == 0), look["lastColumn"] & (col == cols - 1)
    down, across = row - look["firstRow"].cast("int"), col - look["firstColumn"].cast("int")
    free_row, free_col = ~(top | bottom), ~(left | right)
    holds = {
        "wholeTable": F.lit(True), "band1Vert": look["bandedColumns"] & free_col & (across % 2 == 0), "band2Vert": look["bandedColumns"] & free_col & (across % 2 == 1),
        "band1Horz": look["bandedRows"] & free_row & (down % 2 == 0), "band2Horz": look["bandedRows"] & free_row & (down % 2 == 1), "firstCol": left, "lastCol": right, "firstRow": top, "lastRow": bottom,
        "neCell": top & right, "nwCell": top & left, "seCell": bottom & right, "swCell": bottom & left,
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(holds[r], F.lit(False)), F.struct(F.lit(k).alias("rank"), F.lit(r).alias("region"))) for k, r in enumerate(REGIONS))))


def cell_looks(cells: DataFrame, tables: DataFrame, styles: DataFrame, *, table: str = "table_id") -> DataFrame:
    """(table, row, col, property, value, region): what a table's style gives each cell, the strongest region's value of each property.

    cells: table, row, col, and own (a map, which is above all regions), a row for each cell; tables: table, style, rows, cols, look;
    styles: style, region, property, value (resolved through what they are based on, see `catalog.effective_values`).
    A table brings its style's few settings with it, by region, and each cell takes from them where it is: cells meet their
    table in one shuffle, and what regions give is neither joined nor sorted.
    """
    kind = "array<struct<property:string,value:string,region:string>>"
    told = F.struct("property", "value", "region")
    given = styles.groupBy("style").agg(F.array(*(F.collect_list(F.when(F.col("region") == r, told)) for r in REGIONS)).cast(f"array<{kind}>").alias("_given"))
    placed = cells.join(tables.join(given, "style", "left"), table, "left")
    none = F.array().cast(kind)
    regions = F.reverse(cell_regions(F.col("row"), F.col("col"), F.col("rows"), F.col("cols"), F.col("look")))
    styled = F.flatten(F.transform(regions, lambda r: F.get("_given", r["rank"])))
    own = F.transform(F.map_entries("own"), lambda e: F.struct(e["key"].alias("property"), e["value"].alias("value"), F.lit("own").alias("region"))).cast(kind)
    # an array of one, so that what follows does not work the settings out for each of them again
    strongest = F.transform(F.array(F.concat(F.coalesce(own, none), F.coalesce(styled, none))), lambda s: F.filter(s, lambda x, k: F.array_position(s["property"], x["property"]) == k + 1))
    return placed.select(table, "row", "col", F.inline(F.get(strongest, F.lit(0))))


def emu_cm(value: Column, low: float, high: float) -> Column:
    cm = F.bround(value.try_cast("long") / EMU_PER_CM, 2)
    return F.when((cm >= low) & (cm <= high), cm)


def pictures(rows: DataFrame) -> DataFrame:
    """(key, part, seq, name, alt, title, width_cm, height_cm, crop, rotation, flip_h, flip_v, placement) of the drawings in `markup.tree` rows.

    Of several extents, crops or turns inside a drawing the first counts; the anchor is the drawing's own child.
    """
    inside = rows.where(F.col("in_drawing").isNotNull() & F.col("tag").isin(*DRAWN))
    each = F.array_sort(F.collect_list(F.struct("pre", "up", "tag", "attrs", "text")), lambda x, y: x["pre"] - y["pre"])
    inside = inside.groupBy(*PART, F.col("in_drawing").alias("_d")).agg(each.alias("e"))
    return drawn(rows.where("tag = 'drawing'").select(*PART, F.col("pre").alias("_d")).join(inside, [*PART, "_d"], "left"))


def pictures_of(nodes: DataFrame) -> DataFrame:
    """The same of `markup.nodes`, whose parts have their elements at hand: nothing is shuffled or written."""

    def inside(d: Column) -> Column:
        own = F.filter(F.slice("nodes", d["pre"] + 2, d["last"] - d["pre"]), lambda x: (x["in_drawing"] == d["pre"]) & x["tag"].isin(*DRAWN))
        return F.struct(d["pre"].alias("_d"), F.transform(own, lambda x: F.struct(*(x[c].alias(c) for c in ("pre", "up", "tag", "attrs", "text")))).alias("e"))

    return drawn(nodes.select(*PART, F.inline(F.transform(F.filter("nodes", lambda x: x["tag"] == "drawing"), inside))))


def drawn(drawings: DataFrame) -> DataFrame:
    """What `pictures` tells of drawings (key, part, _d, e): a drawing's number and the elements inside it that count, in order."""
    first = lambda of, cond: F.get(F.filter(of, cond), F.lit(0))
    tagged = lambda name: first("e", lambda x: x["tag"] == name)["attrs"]
    below = lambda name: first("_below", lambda x: x["tag"] == name)
    got = drawings.select(
        *PART, "_d", "e", tagged("docPr").alias("doc"), tagged("extent").alias("extent"), tagged("srcRect").alias("rect"), tagged("xfrm").alias("turn"),
        first("e", lambda x: (x["tag"] == "anchor") & (x["up"] == F.col("_d"))).alias("anchor"),
    )
    got = got.withColumn("_below", F.filter("e", lambda x: x["up"] == F.col("anchor.pre")))
    got = got.withColumns({"wrap": first("_below", lambda x: x["tag"].isin(*WRAPS))["tag"], **{f"_{k}": below(k) for k in FROM}})
    for k in FROM:
        leaf = lambda name, k=k: F.trim(first("e", lambda x: (x["tag"] == name) & (x["up"] == F.col(f"_{k}.pre")) & x["text"].isNotNull())["text"])
        got = got.withColumns({k: F.struct(F.element_at(F.col(f"_{k}.attrs"), "relativeFrom").alias("from")), f"{k}_align": leaf("align"), f"{k}_offset": leaf("posOffset")})
    share = lambda side: F.least(F.greatest(F.coalesce(F.element_at("rect", side).try_cast("long") / SHARE_OF_ONE, F.lit(0.0)), F.lit(0.0)), F.lit(0.99))
    sides = {n: share(k) for n, k in (("left", "l"), ("top", "t"), ("right", "r"), ("bottom", "b"))}
    crop = F.struct(*(v.alias(n) for n, v in sides.items()))
    cropped = (F.greatest(*sides.values()) > 0) & (sides["left"] + sides["right"] < 1) & (sides["top"] + sides["bottom"] < 1)
    degrees = F.bround(F.pmod(F.coalesce(F.element_at("turn", "rot"), F.lit("0")).try_cast("long") / TURN_PER_DEGREE, F.lit(360.0)), 2)
    a = lambda k: F.element_at("anchor.attrs", k)
    truth = lambda c: c.isin("1", "true")
    wraps = F.create_map(*(F.lit(x) for kv in WRAPS.items() for x in kv))
    fields = {"wrap": F.coalesce(wraps[F.col("wrap")], F.when(truth(F.coalesce(a("behindDoc"), F.lit("0"))), "behind").otherwise("inFront"))}
    for k, axis in (("positionH", "horizontal"), ("positionV", "vertical")):
        fields[f"{axis}_from"] = F.when(F.col(f"{k}.from").isin(*FROM[k]), F.col(f"{k}.from"))
        aligned = F.coalesce(F.col(f"{k}_align").isin(*ALIGN[k]), F.lit(False))
        fields[f"{axis}_align"] = F.when(aligned, F.col(f"{k}_align"))
        fields[f"{axis}_cm"] = F.when(~aligned, emu_cm(F.col(f"{k}_offset"), -100, 100))
    for side, k in (("top", "distT"), ("bottom", "distB"), ("left", "distL"), ("right", "distR")):
        fields[f"distance_{side}_cm"] = emu_cm(a(k), 0, 50)
    fields |= {"allow_overlap": truth(F.coalesce(a("allowOverlap"), F.lit("1"))), "layout_in_cell": truth(F.coalesce(a("layoutInCell"), F.lit("1")))}
    placement = F.when(F.col("anchor").isNotNull(), F.struct(*(c.alias(n) for n, c in fields.items())))
    text = lambda k: F.when(F.element_at("doc", k) != "", F.element_at("doc", k))
    return got.select(
        *PART, F.col("_d").alias("seq"), F.substring(text("name"), 1, 255).alias("name"), text("descr").alias("alt"), text("title").alias("title"),
        emu_cm(F.element_at("extent", "cx"), 0.01, 200).alias("width_cm"), emu_cm(F.element_at("extent", "cy"), 0.01, 200).alias("height_cm"), F.when(cropped, crop).alias("crop"),
        F.when(degrees != 0, degrees).alias("rotation"), F.when(F.col("turn").isNotNull(), F.coalesce(truth(F.element_at("turn", "flipH")), F.lit(False))).alias("flip_h"), F.when(F.col("turn").isNotNull(), F.coalesce(truth(F.element_at("turn", "flipV")), F.lit(False))).alias("flip_v"),
        placement.alias("placement"),
    )
