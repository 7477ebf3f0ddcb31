"""Layout: pages, page numbers, table grids, column widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import numbering as N
from ..functions import units
from .folds import ordered_fold


class Pages:
    """Units down the pages: one that starts below the content, or would cross its end and fits on one page, moves on.

    What is taller than a page flows on through margins; a unit that would then start in a top margin is pushed to the
    content. A break ends the page, even and odd ones may leave a blank one.
    """

    def __init__(self, key: tuple, height: float, top: float = 0.0, bottom: float = 0.0, names: tuple[str, ...] = ("ord",)):
        self.key, self.names, self.low, self.high, self.whole = key, names, top, top + height, top + height + bottom
        self.page, self.at, self.pending = 1, top, None

    def step(self, row: dict) -> list[tuple]:
        h = row["height"]
        if self.pending:
            self.page, self.at = self.page + 1, self.low
            if self.pending in ("even", "odd") and (self.page % 2 == 0) != (self.pending == "even"):
                self.page += 1
            self.pending = None
        elif self.at < self.low:
            self.at = self.low
        elif self.at >= self.high or (self.at > self.low and self.at + h > self.high and h <= self.high - self.low):
            self.page, self.at = self.page + 1, self.low
        out = (*self.key, *(row[c] for c in self.names), self.page, self.at - self.low)
        self.at += h
        while self.at > self.whole:
            self.page, self.at = self.page + 1, self.at - self.whole
        self.pending = row["break_after"]
        return [out]

    def end(self) -> list[tuple]:
        return []


def paginate(unit_rows: DataFrame, *, key: str, height: float, top: float = 0.0, bottom: float = 0.0, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """(key, order columns, page, top) of units (key, order columns, height, break_after: null, any, even, odd); top counts from the content's."""
    names = list(order)
    kinds = ", ".join(f"{c} {unit_rows.schema[c].dataType.simpleString()}" for c in [key, *names])
    return ordered_fold(unit_rows.select(key, *names, "height", "break_after"), [key], names, f"{kinds}, page int, top double", lambda k: Pages(k, height, top, bottom, order))


def layout_units(elements: DataFrame, items: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """(doc, ord, item, height, break_after): what is laid out: top-level blocks (item null), and of a list each of its items instead.

    elements: doc, ord, type, height, start (of the section behind a break); items: doc, ord, item, height.
    """
    blocks = elements.where("type != 'list'").select(doc, "ord", F.lit(None).cast(items.schema["item"].dataType).alias("item"), "height", break_after(F.col("type"), F.col("start")).alias("break_after"))
    lists = elements.where("type = 'list'").select(doc, "ord")
    return blocks.unionByName(items.join(lists, [doc, "ord"], "left_semi").select(doc, "ord", "item", "height", F.lit(None).cast("string").alias("break_after")))


class Heights:
    """The heights of a table's rows, and what its spanning cells still need of them."""

    def __init__(self, key: tuple):
        self.key, self.rows, self.fixed, self.spans = key, [], [], []

    def step(self, row: dict) -> list[tuple]:
        if row["col"] is None:  # the row itself, before its cells
            self.rows.append(row["height"] or 0.0)
            self.fixed.append(row["rule"] == "exact" and row["height"] is not None)
        elif row["rowspan"] == 1:
            if not self.fixed[-1]:
                self.rows[-1] = max(self.rows[-1], row["need"])
        else:
            self.spans.append((len(self.rows) - 1, row["rowspan"], row["need"]))
        return []

    def end(self) -> list[tuple]:
        for first, span, need in self.spans:
            own = range(first, min(first + span, len(self.rows)))
            free = [r for r in own if not self.fixed[r]]
            more = need - sum(self.rows[r] for r in own)
            if free and more > 0:
                for r in free:
                    self.rows[r] += more / len(free)
        return [(*self.key, r, h) for r, h in enumerate(self.rows)]


def row_heights(rows: DataFrame, cells: DataFrame, *, key: str) -> DataFrame:
    """(key, row, height) of tables: an exact height as it is, a least one, or none, as tall as what the row's cells need.

    rows: key, row (from 0, all of them), height (null: none), rule (exact or not); cells: key, row, col, rowspan, need. What a cell
    over several rows needs beyond them is shared by those of its rows that are not exact, alike; cells take their turn by
    row and column and count what those before them added. A span that goes past the table ends with it. A task holds one
    table's heights and spanning cells.
    """
    kind = rows.schema[key].dataType.simpleString()
    lines = rows.select(key, F.col("row").cast("int").alias("row"), F.lit(None).cast("int").alias("col"), F.lit(None).cast("int").alias("rowspan"), F.lit(None).cast("double").alias("need"), F.col("height").cast("double").alias("height"), "rule")
    own = cells.select(key, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("rowspan").cast("int").alias("rowspan"), F.col("need").cast("double").alias("need"), F.lit(None).cast("double").alias("height"), F.lit(None).cast("string").alias("rule"))
    return ordered_fold(lines.unionByName(own), [key], ["row", "col"], f"{key} {kind}, row int, height double", Heights)


def break_after(kind: Column, start: Column) -> Column:
    s = F.coalesce(start, F.lit("nextPage"))
    section = F.when(s == "evenPage", "even").when(s == "oddPage", "odd").when(s != "continuous", "any")
    return F.when(kind == "page_break", "any").when(kind == "section_break", section)


def section_starts(elements: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """Section breaks with the start type of the section behind them, which the next break's properties hold."""
    w = W.partitionBy(doc).orderBy("ord")
    return elements.where("type = 'section_break'").withColumn("next_start", F.lead("start").over(w))


def inherited(sections: DataFrame, columns: list[str], *, doc: str = "doc_id", order: str = "section") -> DataFrame:
    """Sections with each null filled from the last section before that has a value."""
    w = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return sections.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def page_numbers(pages: DataFrame, sections: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """As-of lookup: each page with the latest section that starts at or before it: section, number and label.

    sections: doc, section, first_page, start (null goes on counting), format. The two are one sorted stream, so no range join.
    """
    a = sections.select(doc, F.col("first_page").alias("page"), F.lit(0).alias("_r"), F.struct("section", "first_page", "start", "format").alias("s"))
    b = pages.select(doc, "page", F.lit(1).alias("_r"), F.lit(None).cast(a.schema["s"].dataType).alias("s"))
    w = W.partitionBy(doc).orderBy("page", "_r").rowsBetween(W.unboundedPreceding, 0)
    numbered = F.when(F.col("s.start").isNotNull(), F.struct(F.col("s.start").alias("start"), F.col("s.first_page").alias("first")))
    both = a.unionByName(b).withColumns({"now": F.last("s", ignorenulls=True).over(w), "from": F.last(numbered, ignorenulls=True).over(w)}).where("_r = 1")
    number = F.coalesce(F.col("from.start") + F.col("page") - F.col("from.first"), F.col("page")).cast("int")
    return both.select(doc, "page", F.col("now.section").alias("section"), number.alias("number"), N.format_number(number, F.coalesce("now.format", F.lit("decimal"))).alias("label"))


def running_key(index: Column, first: Column, different_first: Column, different_even: Column) -> Column:
    """Which header a page shows: first, even or main."""
    return F.when(different_first & (index == first), "first").when(different_even & (index % 2 == 0), "even").otherwise("main")


class Grid:
    """Cells row by row: each goes to the first place that no span covers."""

    def __init__(self, key: tuple):
        self.key, self.row, self.at, self.open = key, None, 0, {}

    def step(self, row: dict) -> list[tuple]:
        if row["row"] != self.row:
            passed = 1 if self.row is None else row["row"] - self.row
            self.open = {c: n - passed for c, n in self.open.items() if n > passed} if self.row is not None else {}
            self.row, self.at = row["row"], 0
            self.covered = dict(self.open)
        while self.at in self.covered:
            self.at += 1
        place = self.at
        for c in range(place, place + row["colspan"]):
            self.open[c] = max(self.open.get(c, 0), row["rowspan"])
        self.at += row["colspan"]
        return [(*self.key, row["row"], row["col"], place)]

    def end(self) -> list[tuple]:
        return []


def grid(cells: DataFrame, *, key: list[str]) -> DataFrame:
    """(key, row, col, grid_col): where each cell (key, row, col, colspan, rowspan) stands once spans are counted."""
    kinds = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in key)
    return ordered_fold(cells.select(*key, "row", "col", "colspan", "rowspan"), key, ["row", "col"], f"{kinds}, row int, col int, grid_col int", Grid)


def column_widths(columns: DataFrame, *, key: str, room: Column, target: Column) -> DataFrame:
    """columns (key, col, width) scaled so that together they are as wide as the table asks, never wider than the room; equal where none is given."""
    w = W.partitionBy(key)
    total = F.sum("width").over(w)
    wide = F.least(F.coalesce(target, F.when(total > 0, total), room), room)
    return columns.withColumn("width", F.when(total > 0, F.col("width") * wide / total).otherwise(wide / F.count("*").over(w)))


def closed_up(paragraphs: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """paragraphs with space_before and space_after set to 0 between neighbours that both ask for contextual spacing."""
    w = W.partitionBy(doc).orderBy("ord")
    up, down = (F.coalesce(f("contextual").over(w), F.lit(False)) & F.col("contextual") for f in (F.lag, F.lead))
    return paragraphs.withColumns({"space_before": F.when(up, 0.0).otherwise(F.col("space_before")), "space_after": F.when(down, 0.0).otherwise(F.col("space_after"))})


def section_boxes(sections: DataFrame, settings: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """(doc, section, width, height, top, bottom, left, right) in pixels: each section's page set-up (size, orientation, four margins in cm) over its document's.

    Unset fields come from the section before and then from the document; 96 pixels are an inch.
    """
    fields = ["size", "orientation", "top", "bottom", "left", "right"]
    own = inherited(sections, fields, doc=doc).join(settings.select(doc, *(F.col(f).alias(f"_{f}") for f in fields)), doc, "left")
    both = own.select(doc, "section", *(F.coalesce(f, f"_{f}").alias(f) for f in fields))
    page = units.page_mm(F.col("size"), F.col("orientation"))
    return both.select(doc, "section", (page["width"] * 96 / 25.4).alias("width"), (page["height"] * 96 / 25.4).alias("height"), *((F.col(m) * 96 / 2.54).alias(m) for m in fields[2:]))
