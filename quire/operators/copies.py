"""What of a document's source can be copied as it was: groups of elements and source blocks, and what groups written anew lose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import written
from .components import components

#: What a block written anew leaves behind, in the order in which it is told.
LOSSES = (
    "tracked changes", "content controls", "text boxes", "charts, shapes and SmartArt", "embedded objects", "drop caps", "empty spacing paragraphs", "underline styles",
    "stretched text", "text effects", "right-to-left runs", "proofing exclusions", "pictures in sections' headers and footers", "page borders", "line numbering", "vertical alignment on the page",
)


def owned(elements: DataFrame, blocks: DataFrame, *, doc: str) -> tuple[DataFrame, DataFrame]:
    """((doc, pos, child) of elements and the source blocks they came from, (doc, pos) of those that name one which is not there)."""
    named = elements.select(doc, "pos", F.explode("sources").alias("child")).distinct()
    there = blocks.select(doc, "child", F.lit(True).alias("_there"))
    seen = named.join(there, [doc, "child"], "left")
    return seen.where("_there").select(doc, "pos", "child"), seen.where("_there is null").select(doc, "pos").distinct()


def grouped(elements: DataFrame, holds: DataFrame, regions: DataFrame, *, doc: str) -> DataFrame:
    """(doc, pos, group) of the elements that have source blocks: those that share one, or stand in one region, are together.

    regions: doc, first, last (positions). A region counts only if its first element has source blocks. A group is named
    by its first element's position.
    """
    first = holds.groupBy(doc, "child").agg(F.min("pos").alias("v"))
    shared = holds.join(first, [doc, "child"]).select(doc, F.col("pos").alias("u"), "v")
    sourced = elements.where(F.size("sources") > 0).select(doc, "pos")
    begins = regions.join(sourced.withColumnRenamed("pos", "first"), [doc, "first"], "left_semi")
    inside = begins.select(doc, F.col("first").alias("v"), F.explode(F.sequence("first", "last")).alias("u")).where("u > v")
    inside = inside.join(sourced.withColumnRenamed("pos", "u"), [doc, "u"], "left_semi").select(doc, "u", "v")
    longs = [F.col(c).cast("long").alias(c) for c in ("u", "v")]
    found = components(shared.unionByName(inside).select(doc, *longs), doc)
    return sourced.join(found.select(doc, F.col("node").alias("pos"), "least"), [doc, "pos"], "left").select(doc, "pos", F.coalesce("least", "pos").alias("group"))


def copy_plan(elements: DataFrame, blocks: DataFrame, regions: DataFrame, used: DataFrame | None = None, *, breaks: bool = True, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(groups, elements): which groups of elements are written as their original blocks.

    elements: doc, pos, element_id, sources (array), unchanged, is_break; blocks: doc, child (from 0), contained, safe,
    drawings; used: doc, child, uses at import. A group is copied if all its elements are unchanged, stand together and in
    their original order, its blocks stand together, contain what they refer to, have safe links, nothing of them was
    deleted, and `breaks` allows its breaks. Blocks that no element came from go with the group of the nearest one before
    them that has an owner, or with the first. A block that was read into more elements than hold it now lost one: it is
    never copied, and is left out altogether if none holds it.

    groups: doc, group, copied, children, and for those written anew the blocks with nothing but drawings (`after`), to be
    put behind the element `last_id`. elements: doc, pos, element_id, group, copied, write: the blocks to write in place of
    a copied element, all at the group's first one.
    """
    holds, invalid = (written(x, "copies") for x in owned(elements, blocks, doc=doc))
    members = written(grouped(elements, holds, regions, doc=doc), "groups")
    held = holds.groupBy(doc, "child").agg(F.count("*").alias("_held"), F.min("pos").alias("pos")).join(members, [doc, "pos"]).drop("pos")
    state = blocks.select(doc, "child", "contained", "safe", "drawings").join(held, [doc, "child"], "left")
    if used is not None:
        state = state.join(used.select(doc, "child", "uses"), [doc, "child"], "left")
        state = state.withColumn("_deleted", F.coalesce("uses", F.lit(0)) > F.coalesce("_held", F.lit(0)))
    else:
        state = state.withColumn("_deleted", F.lit(False))
    state = state.withColumn("_gone", F.col("_deleted") & F.col("_held").isNull())
    # the group of the nearest owned block before, else of the first one
    before = W.partitionBy(doc).orderBy("child").rowsBetween(W.unboundedPreceding, W.currentRow)
    behind = W.partitionBy(doc).orderBy("child").rowsBetween(W.currentRow, W.unboundedFollowing)
    state = state.withColumn("group", F.coalesce(F.last("group", ignorenulls=True).over(before), F.first("group", ignorenulls=True).over(behind)))
    gaps = F.sum(F.col("_gone").cast("long")).over(before)
    taken = state.withColumn("_place", F.col("child") - gaps).where(~F.col("_gone") & F.col("group").isNotNull())
    of_blocks = taken.groupBy(doc, "group").agg(
        F.sort_array(F.collect_list("child")).alias("children"), (F.max("_place") - F.min("_place") + 1 == F.count("*")).alias("_whole"), F.bool_or("_deleted").alias("_lost"),
        F.bool_and("contained").alias("_contained"), F.bool_and("safe").alias("_safe"), F.sort_array(F.collect_list(F.when(F.col("_held").isNull() & F.col("drawings"), F.col("child")))).alias("_drawings"),
    )
    own = elements.join(members, [doc, "pos"]).join(invalid.withColumn("_invalid", F.lit(True)), [doc, "pos"], "left")
    nth = W.partitionBy(doc, "group").orderBy("pos")
    first = F.array_min("sources")
    own = own.withColumn("_back", first < F.lag(first).over(nth))
    of_elements = own.groupBy(doc, "group").agg(
        F.bool_and("unchanged").alias("_unchanged"), (F.max("pos") - F.min("pos") + 1 == F.count("*")).alias("_together"), F.bool_or(F.coalesce("_back", F.lit(False))).alias("_disordered"),
        F.bool_or("is_break").alias("_breaks"), F.count("_invalid").alias("_invalid"), F.max_by("element_id", "pos").alias("_last"),
    )
    c = F.col
    good = c("_unchanged") & c("_together") & ~c("_disordered") & (c("_invalid") == 0) & c("_whole") & ~c("_lost") & c("_contained") & c("_safe") & (F.lit(breaks) | ~c("_breaks"))
    told = of_elements.join(of_blocks, [doc, "group"], "left").withColumn("copied", F.coalesce(good, F.lit(False)))
    children = F.coalesce("children", F.array().cast("array<long>"))
    drawings = F.when(~c("copied") & (F.size("_drawings") > 0), c("_drawings"))
    groups = written(told.select(doc, "group", "copied", children.cast("array<long>").alias("children"), drawings.alias("after"), F.when(drawings.isNotNull(), c("_last")).alias("last_id")), "plan")
    out = elements.select(doc, "pos", "element_id").join(members, [doc, "pos"], "left").join(groups.select(doc, "group", "copied", "children"), [doc, "group"], "left")
    write = F.when(c("copied"), F.when(c("pos") == c("group"), c("children")).otherwise(F.array().cast("array<long>")))
    return groups, out.select(doc, "pos", "element_id", "group", F.coalesce("copied", F.lit(False)).alias("copied"), write.alias("write"))


def rewritten_losses(groups: DataFrame, held: DataFrame, put_back: DataFrame, tracked_kept: Column | None = None, *, doc: str = "doc_id") -> DataFrame:
    """(doc, blocks, kinds): how many groups written anew lost something, and what, in the fixed order.

    held, put_back: doc, child, kind, n: what a source block holds that elements do not, and what went back when it was
    written anew; what is lost is the difference of the two as bags. Tracked changes count where the document keeps them
    (`tracked_kept`, a condition on the columns of groups; never without it). Documents that lost nothing have no row.
    """
    anew = groups.where("not copied").select(doc, "group", F.coalesce(tracked_kept if tracked_kept is not None else F.lit(False), F.lit(False)).alias("_kept"), F.explode("children").alias("child"))
    bags = held.select(doc, "child", "kind", "n").unionByName(put_back.select(doc, "child", "kind", (-F.col("n")).alias("n")))
    lost = bags.groupBy(doc, "child", "kind").agg(F.sum("n").alias("n")).where("n > 0")
    rank = F.create_map(*(F.lit(x) for k, kind in enumerate(LOSSES) for x in (kind, k)))
    own = anew.join(lost, [doc, "child"]).where((F.col("kind") != LOSSES[0]) | F.col("_kept"))
    own = own.groupBy(doc, "group").agg(F.collect_set(F.struct(rank[F.col("kind")].alias("r"), "kind")).alias("_kinds"))
    kinds = F.transform(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_kinds")))), lambda s: s["kind"])
    return own.groupBy(doc).agg(F.count("*").alias("blocks"), kinds.alias("kinds"))
