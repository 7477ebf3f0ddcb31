"""The document tree as relations: runs and marks, captions and lists, insertion and renumbering, operations, proposals, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BooleanType, StructField, StructType

from ..sources.tables import written
from .folds import ordered_fold

#: Marks in the order in which a run holds them; operations that only change the look.
MARKS = ("bold", "italic", "underline", "strike", "code", "link", "superscript", "subscript", "textStyle", "hidden")
#: Comments of a document whose roots its reader holds (about 100 bytes each); those beyond are joined.
HELD = 1 << 19
#: Fixed value: a caption is a label, a number and a separator.
CAPTION = r"^\s*(фигура|фиг\.|figure|fig\.|таблица|табл\.|table|схема|диаграма|графика|снимка|chart|image|изображение)\s*\d+(?:[.\-]\d+)*\s*[:.\-–—)]"
URL = r"(?i)\b(?:https?://|www\.)[^\s<>\"]*[^\s<>\".,;:!?)\]]|\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+"


def plain_text(runs: Column) -> Column:
    """Texts of an array of runs, one after another."""
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def ordered_marks(marks: Column) -> Column:
    """Mark types in their fixed order, unknown ones last by name, each once."""
    rank = F.create_map(*(F.lit(x) for k, m in enumerate(MARKS) for x in (m, k)))
    ranked = F.transform(F.array_distinct(marks), lambda m: F.struct(F.coalesce(F.element_at(rank, m), F.lit(len(MARKS))).alias("r"), m.alias("m")))
    return F.transform(F.array_sort(ranked), lambda s: s["m"])


def depth(path: Column) -> Column:
    """Nesting depth of a path of positions: 0 at the top."""
    return F.size(path) - 1


def block_depths(elements: DataFrame, *, most: int = 8, doc: str = "doc_id") -> DataFrame:
    """(doc, top, depth): how deep each top-level element is nested, `most` at most."""
    return elements.groupBy(doc, F.col("path")[0].alias("top")).agg(F.least(F.lit(most), F.max(depth(F.col("path")))).alias("depth"))


def depth_first(elements: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """elements with `place`, their number in a depth-first walk: the order of their paths."""
    return elements.withColumn("place", F.row_number().over(W.partitionBy(doc).orderBy("path")) - 1)


def captioned(elements: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """elements whose paragraphs that read like a caption, beside an image or table, have become captions."""
    w = W.partitionBy(doc).orderBy("ord")
    beside = F.coalesce(F.lag("type").over(w).isin("image", "table"), F.lit(False)) | F.coalesce(F.lead("type").over(w).isin("image", "table"), F.lit(False))
    out = elements.withColumn("_c", (F.col("type") == "paragraph") & F.col("content").rlike("(?iuU)" + CAPTION) & beside)
    return out.withColumn("type", F.when(F.col("_c"), "caption").otherwise(F.col("type"))).drop("_c")


def lists_of(paragraphs: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """Lists from neighbouring list paragraphs of one numbering: (doc, list_no, num_id, first, items, checklist); levels count from the least.

    A list is a checklist only if all its items have boxes.
    """
    w = W.partitionBy(doc).orderBy("ord")
    new = F.coalesce(~F.col("num_id").eqNullSafe(F.lag("num_id").over(w)), F.lit(True))
    marked = paragraphs.withColumn("island", F.sum(new.cast("int")).over(w)).where("num_id is not null")
    lists = marked.groupBy(doc, "island").agg(
        F.first("num_id").alias("num_id"), F.min("ord").alias("first"), F.min("level").alias("least"), F.max("level").alias("most"), F.count("*").alias("items"), F.bool_and(F.col("boxed")).alias("checklist"))
    nth = F.row_number().over(W.partitionBy(doc).orderBy("first"))
    return lists.select(doc, nth.alias("list_no"), "num_id", "first", "items", (F.col("most") - F.col("least")).alias("deepest"), "checklist")


def continued_starts(lists: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """lists with the number at which each begins: an interrupted list goes on after the items counted before under its definition."""
    w = W.partitionBy(doc, "num_id").orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    return lists.withColumn("start", 1 + F.coalesce(F.sum("items").over(w), F.lit(0)))


def inserted(elements: DataFrame, new: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """elements (doc, element_id, ord) with new ones behind the element each names, renumbered from 0.

    A null or unknown anchor means the end. New elements are put in one after another by their column seq, or where there
    is none by their id, so of those behind one anchor the last stands nearest; an anchor may be new itself.
    """
    seq = F.col("seq") if "seq" in new.columns else F.row_number().over(W.partitionBy(doc).orderBy(F.desc("element_id")))
    steps = new.select(doc, seq.cast("long").alias("seq"), F.lit("insert").alias("op"), F.col("element_id").alias("target"), "after_id")
    return replayed(elements, steps, doc=doc)


def invalid_operations(operations: DataFrame, elements: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """Operations that name an element or an anchor which the document lacks, or lack what they need; a document's batch is applied only if it has none."""
    def known(c: str) -> DataFrame:
        return elements.select(doc, F.col("element_id").alias(c), F.lit(True).alias(f"_{c}")).distinct()

    seen = operations.join(known("target"), [doc, "target"], "left").join(known("after_id"), [doc, "after_id"], "left")
    names = F.col("op").isin("delete", "move", "set_style")
    short = F.when(F.col("op") == "insert", F.col("content").isNull()).when(F.col("op") == "set_style", F.col("property").isNull() | F.col("value").isNull()).otherwise(F.lit(False))
    lost = (names & F.col("_target").isNull()) | (F.col("after_id").isNotNull() & F.col("_after_id").isNull())
    return seen.where(lost | short).select(operations.columns)


def split_operations(operations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(those that only change the look and may be applied, those that change content and become proposals)."""
    look = F.col("op").isin("set_style", "page_break")
    return operations.where(look), operations.where(~look)


class Chain:
    """A document's ids as links in both directions, so that every operation takes the same time: None stands before the first and behind the last."""

    def __init__(self, key: tuple):
        self.key, self.next, self.last = key, {None: None}, {None: None}

    def put(self, target: str, after: str | None) -> None:
        before = after if after in self.next and after is not None else self.last[None]
        behind = self.next[before]
        self.next[before], self.next[target] = target, behind
        self.last[behind], self.last[target] = target, before

    def take(self, target: str) -> None:
        before, behind = self.last.pop(target), self.next.pop(target)
        self.next[before], self.last[behind] = behind, before

    def step(self, row: dict) -> list[tuple]:
        op, target = row["op"], row["target"]
        if op in ("delete", "move") and target is not None and target in self.next:
            self.take(target)
            if op == "move":
                self.put(target, row["after_id"])
        elif op in ("insert", "page_break"):
            self.put(target if target is not None else f"{op}-{row['seq']}", row["after_id"])
        return []

    def end(self) -> list[tuple]:
        out, at = [], self.next[None]
        while at is not None:
            out.append((*self.key, len(out), at))
            at = self.next[at]
        return out


def links(elements: DataFrame, *, doc: str) -> DataFrame:
    """A document's elements as insertions in their order, before all operations."""
    return elements.select(doc, (F.col("ord").cast("long") - (1 << 40)).alias("seq"), F.lit("insert").alias("op"), F.col("element_id").alias("target"), F.lit(None).cast("string").alias("after_id"))


def replayed(elements: DataFrame, operations: DataFrame, *, doc: str) -> DataFrame:
    """(doc, ord, element_id) after each document's operations in the order of seq; a task holds the ids of one document."""
    kind = elements.schema[doc].dataType.simpleString()
    stream = links(elements, doc=doc).unionByName(operations.select(doc, F.col("seq").cast("long").alias("seq"), "op", "target", "after_id"))
    return ordered_fold(stream, [doc], ["seq"], f"{doc} {kind}, ord long, element_id string", Chain)


def applied(elements: DataFrame, operations: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """(doc, ord, element_id) after each document's operations (doc, seq, op, target, after_id, content, property, value).

    delete and move name their target; insert and page_break bring a new element, named by target or, where that is null,
    by their seq; set_style leaves the order alone (see `styled`). An anchor that an earlier operation has deleted means
    the end, as null does. A document with an invalid operation is left as it is.
    """
    refused = invalid_operations(operations, elements, doc=doc).select(doc).distinct()
    return replayed(elements, operations.join(refused, doc, "left_anti"), doc=doc)


def styled(rules: DataFrame, operations: DataFrame, *, doc: str = "doc_id", priority: int = 2) -> DataFrame:
    """rules (doc, target, property, value, priority, source, ...) with those of the set_style operations in the place of all of one target and property; the last counts."""
    keys = [doc, "target", "property"]
    new = operations.where("op = 'set_style'").groupBy(*keys).agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    new = new.withColumns({"priority": F.lit(priority), "source": F.lit("instruction")})
    kept = rules.join(new.select(*keys), keys, "left_anti").select(rules.columns)
    return kept.unionByName(new.select(*(c for c in rules.columns if c in new.columns)), allowMissingColumns=True)


def new_proposals(waiting: DataFrame, offered: DataFrame, keys: list[str], *, order: str) -> DataFrame:
    """Offered proposals that no waiting one equals in the keys; of equal ones offered together the first."""
    fresh = offered.join(waiting.select(keys).distinct(), [offered[k].eqNullSafe(waiting[k]) for k in keys], "left_anti")
    return fresh.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def live_proposals(proposals: DataFrame, elements: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """Proposals whose target and anchor still exist; null ones pass."""
    out = proposals
    for c in ("target", "after_id"):
        known = elements.select(doc, F.col("element_id").alias(c), F.lit(True).alias("_k"))
        out = out.join(known, [doc, c], "left").where(F.col(c).isNull() | F.col("_k")).drop("_k")
    return out


def keep_fields(stored: DataFrame, incoming: DataFrame, fields: list[str], *, doc: str = "doc_id") -> DataFrame:
    """incoming with the server's fields by id; a second element of an id gets none, and what a client sends is ignored."""
    nth = F.row_number().over(W.partitionBy(doc, "element_id").orderBy("ord"))
    rows = incoming.drop(*fields).withColumn("_n", nth)
    held = stored.select(doc, "element_id", *fields, F.lit(1).alias("_n"))
    return rows.join(held, [doc, "element_id", "_n"], "left").drop("_n")


def block_use(elements: DataFrame, blocks: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """(doc, block, uses): into how many elements each source block was read; blocks has (doc, n)."""
    dense = blocks.select(doc, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
    used = elements.groupBy(doc, "block").agg(F.count("*").alias("uses"))
    return dense.join(used, [doc, "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


def last_headings(elements: DataFrame, *, doc: str = "doc_id", most: int = 12, chars: int = 120) -> DataFrame:
    """The last headings of each document, in order, cut."""
    back = F.row_number().over(W.partitionBy(doc).orderBy(F.desc("ord")))
    return elements.where("type = 'heading'").withColumn("_b", back).where(F.col("_b") <= most).select(doc, "ord", "level", F.substring("content", 1, chars).alias("content"))


def autolinks(texts: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, nth, href) of plain URLs and addresses in texts; an address gets mailto:, a bare www. https://."""
    found = texts.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(URL), F.lit(0))).alias("nth", "raw"))
    low = F.lower("raw")
    href = F.when(low.rlike("^https?://"), F.col("raw")).when(low.rlike(r"^[\w.+-]+@"), F.concat(F.lit("mailto:"), "raw")).otherwise(F.concat(F.lit("https://"), "raw"))
    return found.select(key, "nth", href.alias("href"))


class Roots:
    """The first HELD comments of a document and the roots of their threads; a row out for each in: doc, id, thread or parent, whether that is the root."""

    def __init__(self, key: tuple):
        self.doc, self.roots = key[0], {}

    def step(self, row: dict) -> list[tuple]:
        own, parent = row["id"], row["parent_id"]
        root = own if parent is None or parent == own else self.roots.get(parent)
        if root is None:
            return [(self.doc, own, parent, False)]
        if len(self.roots) < HELD:
            self.roots[own] = root
        return [(self.doc, own, root, True)]

    def end(self) -> list[tuple]:
        return []


def followed(open_: DataFrame, ended: DataFrame, known: DataFrame, doc: str) -> DataFrame:
    """(doc, id, thread) of comments whose thread so far is their parent: of those that have ended it is the root."""
    first = open_.join(known.withColumn("_k", F.lit(True)), [doc, "thread"], "left")
    step = written(first.select(doc, "id", F.when(F.col("_k"), F.col("thread")).otherwise(F.col("id")).alias("thread"), F.col("thread").alias("least"), F.col("_k").isNull().alias("_end")), "threads")
    out = step.where("_end").select(doc, "id", "thread")
    open_ = step.where("not _end")
    most = open_.groupBy(doc).count().agg(F.max("count")).first()[0] or 0
    for _ in range(most.bit_length()):
        roots = ended.unionByName(out).select(doc, F.col("id").alias("thread"), F.col("thread").alias("_up"), F.col("thread").alias("_least"), F.lit(True).alias("_end"))
        above = roots.unionByName(open_.select(doc, F.col("id").alias("thread"), F.col("thread").alias("_up"), F.col("least").alias("_least"), "_end"))
        step = written(open_.drop("_end").join(above, [doc, "thread"]).select(doc, "id", F.col("_up").alias("thread"), F.least("least", "_least").alias("least"), "_end"), "threads")
        out, open_ = out.unionByName(step.where("_end").select(doc, "id", "thread")), step.where("not _end")
        if open_.isEmpty():
            return out
    ring = open_.select(doc, F.col("id").alias("thread"), F.col("least").alias("_ring"))
    return out.unionByName(open_.join(ring, [doc, "thread"]).select(doc, "id", F.col("_ring").alias("thread")))


def threads(comments: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """comments (doc, id, parent_id, resolved) with their thread, the id of its first comment, and whether that one is resolved.

    A parent that the document lacks begins no thread. A document's comments are read in the order of their ids, where an
    answer comes behind what it answers; what that leaves open (a parent with a larger id, or one beyond the HELD first
    of a document) is followed to the root, each round twice as far, until no reply could be farther away. Comments that
    answer one another in a ring, and those below them, are in the thread of the ring's least id.
    """
    kind = comments.select(doc, "id").schema
    read = StructType([*kind, StructField("thread", kind["id"].dataType), StructField("_end", BooleanType())])
    own = comments.select(doc, "id", F.col("parent_id").cast(kind["id"].dataType).alias("parent_id"))
    up = written(ordered_fold(own, [doc], ["id"], read, Roots), "threads")
    out, open_ = up.where("_end").drop("_end"), up.where("not _end").drop("_end")
    if not open_.isEmpty():
        out = out.unionByName(followed(open_, out, comments.select(doc, F.col("id").alias("thread")).distinct(), doc))
    up = out
    root = comments.select(doc, F.col("id").alias("thread"), F.col("resolved").alias("_r"))
    return comments.drop("resolved").join(up, [doc, "id"]).join(root, [doc, "thread"]).select(*(c for c in comments.columns if c != "resolved"), "thread", F.col("_r").alias("resolved"))
