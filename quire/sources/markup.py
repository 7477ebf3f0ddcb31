"""XML as a relation with interval numbers: a row for each element, those inside it are the rows whose number lies within its interval."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from .docx import DAMAGED, package_problem

NODES = T.ArrayType(T.StructType([
    T.StructField("pre", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("up", T.IntegerType()), T.StructField("space", T.StringType()), T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType()),
    T.StructField("over", T.IntegerType()), T.StructField("up_tag", T.StringType()), *(T.StructField(f"in_{k}", T.IntegerType()) for k in ("p", "drawing", "away")),
]))
PART = ["key", "part"]
#: Tags whose nearest element around each is numbered along with the rest, and the column (in_...) that has it.
HOLDS = {"p": "p", "drawing": "drawing", "del": "away", "moveFrom": "away"}
BODY, SHEET = "word/document.xml", "word/styles.xml"
#: What elements are to a run, by their tag; and a run's own properties, a paragraph's own, a text that a run shows.
KINDS = {"p": 1, "r": 2, "t": 3, "rPr": 4, "pPr": 5, "pStyle": 6, "del": 7, "moveFrom": 7}
P, R, TEXT, RPR, PPR, PSTYLE, AWAY, SAYS, NAMES, SHOWN = range(1, 11)
SAID = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("tag", "space", "value")]))
RUN = [T.StructField("seq", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("style", T.StringType()), T.StructField("said", SAID)]
#: Texts that are taken out of a batch at a time, and about how many runs are handed on together.
TEXTS, RUNS = 64, 8192


def xml_parts(data: bytes | None) -> list[tuple[str, str]]:
    """The XML parts of a zip package; a damaged one has none."""
    try:
        if package_problem(data or b""):
            return []
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [(n, z.read(n).decode()) for n in z.namelist() if n.endswith(".xml")]
    except DAMAGED:
        return []


def parts(files: DataFrame, *, key: str = "key", content: str = "content") -> DataFrame:
    """(key, part, xml) of the XML parts of zip packages; a damaged one has none (see `packages.nodes` for its problem)."""
    kind = files.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if found := xml_parts(data):
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(found), batch.column(0).type), pa.array([n for n, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], names=["key", "part", "xml"])

    return files.select(key, content).mapInArrow(run, T.StructType([T.StructField("key", kind), T.StructField("part", T.StringType()), T.StructField("xml", T.StringType())]))


def bodies(files: DataFrame, *, key: str = "key", content: str = "content") -> DataFrame:
    """(key, document, styles) of zip packages: the texts of their body and style sheet, null without; a damaged one has no row."""
    kind = files.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if found := dict(xml_parts(data)):
                    yield pa.RecordBatch.from_arrays([pa.array([i], batch.column(0).type), *(pa.array([found.get(n)], pa.string()) for n in (BODY, SHEET))], names=["key", "document", "styles"])

    return files.select(key, content).mapInArrow(run, T.StructType([T.StructField("key", kind), T.StructField("document", T.StringType()), T.StructField("styles", T.StringType())]))


def forbidden(*_) -> None:
    raise expat.ExpatError("a document type is not allowed")


class Shredder:
    """Elements of many texts as columns, in document order."""

    def __init__(self):
        self.pre, self.last, self.up, self.space, self.tag, self.text = ([] for _ in range(6))
        self.over, self.up_tag = [], []
        self.near: dict[str, list] = {k: [] for k in HOLDS.values()}
        self.names, self.values, self.ends, self.sizes = [], [], [0], []

    def add(self, xml: str) -> None:
        """Numbers the elements of a text; one that is not XML, or declares a document type, has none."""
        begin, named = len(self.pre), len(self.names)
        around: list[int] = []
        held: dict[str, list[int]] = {k: [] for k in self.near}

        def open_(name: str, attrs: list[str]) -> None:
            n = len(self.pre)
            space, _, tag = name.rpartition(" ")
            self.pre.append(n - begin)
            self.last.append(0)
            self.up.append(around[-1] - begin if around else None)
            self.space.append(space)
            self.tag.append(tag)
            self.text.append(None)
            self.over.append(around[-2] - begin if len(around) > 1 else None)
            self.up_tag.append(self.tag[around[-1]] if around else None)
            for k, numbers in self.near.items():
                numbers.append(held[k][-1] - begin if held[k] else None)
            if tag in HOLDS:
                held[HOLDS[tag]].append(n)
            self.names.extend(a.rpartition(" ")[2] for a in attrs[::2])
            self.values.extend(attrs[1::2])
            self.ends.append(len(self.names))
            around.append(n)

        def close(_: str) -> None:
            n = around.pop()
            self.last[n] = len(self.pre) - 1 - begin
            if self.tag[n] in HOLDS:
                held[HOLDS[self.tag[n]]].pop()

        def data(text: str) -> None:
            n = around[-1]
            if n == len(self.pre) - 1:  # before any child
                self.text[n] = text if self.text[n] is None else self.text[n] + text

        parser = expat.ParserCreate(namespace_separator=" ")
        parser.ordered_attributes, parser.buffer_text = True, True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = open_, close, data, forbidden
        try:
            parser.Parse(xml, True)
        except expat.ExpatError:
            for column in (self.pre, self.last, self.up, self.space, self.tag, self.text, self.over, self.up_tag, *self.near.values()):
                del column[begin:]
            del self.names[named:], self.values[named:], self.ends[begin + 1 :]
        self.sizes.append(len(self.pre) - begin)

    def arrays(self) -> pa.ListArray:
        attrs = pa.MapArray.from_arrays(pa.array(self.ends, pa.int32()), pa.array(self.names, pa.string()), pa.array(self.values, pa.string()))
        columns = [pa.array(self.pre, pa.int32()), pa.array(self.last, pa.int32()), pa.array(self.up, pa.int32()), pa.array(self.space, pa.string()), pa.array(self.tag, pa.string()), attrs, pa.array(self.text, pa.string()), pa.array(self.over, pa.int32()), pa.array(self.up_tag, pa.string()), *(pa.array(x, pa.int32()) for x in self.near.values())]
        ends = [0]
        for n in self.sizes:
            ends.append(ends[-1] + n)
        kind = to_arrow_type(NODES).value_type
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, kind)], fields=list(kind)))


def nodes(texts: DataFrame) -> DataFrame:
    """(key, part, nodes) of (key, part, xml): a part's elements in order as one array, so that what a part's own elements say of each other needs no shuffle.

    An element's fields are the columns of `tree`; the place of number n is n + 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch, made = whole.slice(k, 256), Shredder()
                for x in batch.column(2).to_pylist():
                    made.add(x or "")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made.arrays()], names=["key", "part", "nodes"])

    schema = T.StructType([texts.schema["key"], T.StructField("part", T.StringType()), T.StructField("nodes", NODES)])
    return texts.select("key", "part", "xml").mapInArrow(run, schema)


class Kinds(dict):
    """What an element of a name is to a run, 0 for most."""

    def __missing__(self, name: str) -> int:
        self[name] = kind = KINDS.get(name.rpartition(" ")[2], 0)
        return kind


def value_of(attrs: list[str]) -> str | None:
    for k in range(0, len(attrs), 2):
        if attrs[k].rpartition(" ")[2] == "val":
            return attrs[k + 1]
    return None


class Runs:
    """Runs of many texts as columns, in document order; numbers are those of `Shredder`."""

    def __init__(self):
        self.row, self.seq, self.text, self.style = ([] for _ in range(4))
        self.tags, self.spaces, self.values, self.ends = [], [], [], [0]
        self.kinds, self.names = Kinds(), {}

    def add(self, row: int, xml: str) -> None:
        """Takes the runs of a text that are not deleted or moved away; one that is not XML, or declares a document type, has none."""
        kinds, seq, away, here = self.kinds, -1, 0, None
        around, paragraphs, runs, found = [0], [-1], [], []
        styles: dict[int, str | None] = {}

        def open_(name: str, attrs: list[str]) -> None:
            nonlocal seq, away, here
            seq += 1
            kind, up = kinds[name], around[-1]
            if up == SAYS:
                runs[-1][3].append((name, value_of(attrs)))
            elif up == SHOWN:  # text counts before any child
                here = None
            if kind:
                if kind == TEXT:
                    if up == R:
                        here, kind = runs[-1], SHOWN
                elif kind == RPR:
                    if up == R:
                        kind = SAYS
                elif kind == R:
                    run = [seq, paragraphs[-1], [], []]
                    runs.append(run)
                    if not away:
                        found.append(run)
                elif kind == P:
                    paragraphs.append(seq)
                elif kind == PPR:
                    if up == P:
                        kind = NAMES
                elif kind == PSTYLE:
                    if up == NAMES:
                        styles.setdefault(paragraphs[-1], value_of(attrs))
                else:
                    away += 1
            around.append(kind)

        def close(_: str) -> None:
            nonlocal away, here
            kind = around.pop()
            if kind:
                if kind == R:
                    runs.pop()
                elif kind == P:
                    paragraphs.pop()
                elif kind == SHOWN:
                    here = None
                elif kind == AWAY:
                    away -= 1

        def data(text: str) -> None:
            if here is not None:
                here[2].append(text)

        parser = expat.ParserCreate(None, " ", self.names)
        parser.ordered_attributes, parser.buffer_text = True, True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = open_, close, data, forbidden
        try:
            parser.Parse(xml, True)
        except expat.ExpatError:
            return
        for n, p, text, said in found:
            self.row.append(row)
            self.seq.append(n)
            self.text.append("".join(text))
            self.style.append(styles.get(p))
            for name, value in said:
                space, _, tag = name.rpartition(" ")
                self.tags.append(tag)
                self.spaces.append(space)
                self.values.append(value)
            self.ends.append(len(self.tags))

    def arrays(self) -> list[pa.Array]:
        said = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in (self.tags, self.spaces, self.values)], names=["tag", "space", "value"])
        return [pa.array(self.seq, pa.int32()), pa.array(self.text, pa.string()), pa.array(self.style, pa.string()), pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), said)]


def runs(texts: DataFrame, xml: str = "xml") -> DataFrame:
    """texts without `xml`, a row for each of its runs that is not deleted or moved away: with (seq, text, style, said).

    The run's number, its texts joined, what its paragraph names as its style, and what its own properties say, in order. A run comes
    with all of that, so nothing is shuffled or written to know what is around it.
    """
    kept = [c for c in texts.columns if c != xml]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = Runs()

            def handed(made: Runs, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                rows = pa.array(made.row, pa.int32())
                out = pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(len(kept))), *made.arrays()], names=[*kept, *(f.name for f in RUN)])
                for k in range(0, out.num_rows, RUNS):
                    yield out.slice(k, RUNS)

            for k in range(0, batch.num_rows, TEXTS):
                for i, x in enumerate(batch.column(len(kept)).slice(k, TEXTS).to_pylist(), k):
                    made.add(i, x or "")
                    if len(made.row) >= RUNS:
                        yield from handed(made, batch)
                        made = Runs()
            yield from handed(made, batch)

    return texts.select(*kept, xml).mapInArrow(run, T.StructType([*(texts.schema[c] for c in kept), *RUN]))


def tree(texts: DataFrame) -> DataFrame:
    """(key, part, pre, last, up, space, tag, attrs, text, over, up_tag, in_p, in_drawing, in_away) of (key, part, xml).

    Number, last number inside, parent's number, local names, the text before any child; the number of the parent's parent,
    the parent's tag, and the numbers of the nearest paragraph, drawing and deletion (or move) around. Of attributes with one
    local name the last counts. A text that is not XML gives no rows.
    """
    return nodes(texts).select("key", "part", F.inline("nodes"))


def within(rows: DataFrame, outer: Column, name: str, told: Column) -> DataFrame:
    """rows with a column `name`: `told` of the nearest element around each for which `outer` holds, null without one.

    A stack as sums: outer elements open at their number and close behind their last one, so the running sum is how many
    are open; the one that is nearest is the last that opened at that height. Both windows run over a part's own rows.
    """
    here, at = W.partitionBy(*PART), F.struct("pre", F.col("_turn"))
    marked = rows.withColumns({"_outer": F.coalesce(outer, F.lit(False)), "_told": told})
    event = F.array(
        F.struct(F.lit(0).alias("_turn"), F.lit(0).alias("_step"), F.col("pre").alias("_at")),
        *(F.when(F.col("_outer"), F.struct(F.lit(turn).alias("_turn"), F.lit(step).alias("_step"), where.alias("_at"))) for turn, step, where in ((1, 1, F.col("pre")), (2, -1, F.col("last")))),
    )
    events = marked.withColumn("_e", F.explode(F.array_compact(event))).select("*", "_e.*").drop("_e")
    order = [F.col("_at"), F.col("_turn")]
    opened = events.withColumn("_height", F.sum("_step").over(here.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))).where("_turn < 2")
    nearest = W.partitionBy(*PART, "_height").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = opened.withColumn(name, F.when(F.col("_height") > 0, F.last(F.when(F.col("_turn") == 1, F.struct(F.col("_told").alias("t"))), ignorenulls=True).over(nearest)["t"]))
    return found.where("_turn = 0").select(*rows.columns, name)
