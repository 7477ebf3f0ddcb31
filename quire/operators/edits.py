"""Changes offered, patched and admitted: proposals decided, patches refused or sent, model answers checked, payloads cleared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import text as X
from ..functions import units
from ..sources.tables import written
from . import compare as C
from . import rules as R
from . import tree
from .folds import ordered_fold

#: Blocks that a patch may change in any case, pieces that a model is asked about, inputs that a finished job forgets.
PATCH_BLOCKS, MODEL_PIECES = 20, 20
TEXT_INPUTS = ("text", "instructionsText")
#: Operations and kinds of new elements that a model may ask for.
OPERATIONS = ("insert", "delete", "move", "set_style", "page_break")
NEW_KINDS = ("paragraph", "heading", "quote", "caption", "footnote", "code_block")
UPLOADS = ("docx", "pdf", "txt")


def decided(elements: DataFrame, proposals: DataFrame, decisions: DataFrame, *, doc: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(elements, proposals, stale) after each document's accepted proposals (decisions: doc, id, accept) are applied, in the order of their seq.

    Each accepted one is judged by the document as those before it have left it: one that names what is no longer there is
    stale, and nothing is done. One that was accepted but waits no more (an earlier batch took it away) is stale as well.
    A rejected proposal goes, and in the end so do those about elements that are gone. proposals: doc, id, seq, op,
    target, after_id, content. A task holds the ids of one document.
    """
    asked = decisions.where("accept").join(proposals, [doc, "id"], "left")
    gone = asked.where("op is null").select(doc, "id")
    steps = asked.where("op is not null").withColumn("target", F.when(F.col("op") == "insert", F.concat(F.lit("new-"), F.col("id").cast("string"))).otherwise(F.col("target")))
    kinds = {c: proposals.schema[c].dataType.simpleString() for c in (doc, "id")}
    fields = [doc, "seq", "op", "target", "after_id", "content", "id"]
    base = tree.links(elements, doc=doc).withColumns({"content": F.lit(None).cast("string"), "id": F.lit(None).cast(kinds["id"])})
    stream = base.select(fields).unionByName(steps.select(doc, F.col("seq").cast("long").alias("seq"), *fields[2:]))
    told = written(ordered_fold(stream, [doc], ["seq"], f"{doc} {kinds[doc]}, ord long, element_id string, stale {kinds['id']}", Decisions), "decided")
    out = told.where("stale is null").drop("stale")
    stale = told.where("stale is not null").select(doc, F.col("stale").alias("id"))
    left = proposals.join(decisions.join(stale, [doc, "id"], "left_anti"), [doc, "id"], "left_anti")
    return out, tree.live_proposals(left, out, doc=doc).select(proposals.columns), stale.unionByName(gone)


class Decisions(tree.Chain):
    """Accepted proposals, each judged by the chain that those before it have made."""

    def fits(self, row: dict) -> bool:
        op, target, after = row["op"], row["target"], row["after_id"]
        if after is not None and after not in self.next:
            return False
        return row["content"] is not None if op == "insert" else target is not None and target in self.next

    def step(self, row: dict) -> list[tuple]:
        if row["id"] is not None and not self.fits(row):
            return [(*self.key, None, None, row["id"])]
        return super().step(row)

    def end(self) -> list[tuple]:
        return [(*row, None) for row in super().end()]


def patch_problems(stored: DataFrame, changed: DataFrame, added: DataFrame, removed: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """(doc, problem): why a document's patch does not fit what is stored; such a patch is refused as a whole.

    It may not remove or change what is not there or twice, change what it removes, add what is there, behind what is not
    or is removed, or two blocks in one place.
    """
    ids = stored.select(doc, "element_id", F.lit(True).alias("_in"))
    gone = removed.select(doc, "element_id", F.lit(True).alias("_gone")).distinct()

    def twice(df: DataFrame, column: str, why: str) -> DataFrame:
        return df.groupBy(doc, column).count().where("count > 1").select(doc, F.lit(why).alias("problem"))

    def lost(df: DataFrame, why: str) -> DataFrame:
        return df.join(ids, [doc, "element_id"], "left_anti").select(doc, F.lit(why).alias("problem"))

    new = added.select(doc, F.col("element_id").alias("after_id"))
    known = ids.join(gone, [doc, "element_id"], "left_anti").select(doc, F.col("element_id").alias("after_id")).unionByName(new).distinct()
    out = lost(removed, "removes").unionByName(twice(removed, "element_id", "removes")).unionByName(lost(changed, "changes")).unionByName(twice(changed, "element_id", "changes"))
    out = out.unionByName(changed.join(gone, [doc, "element_id"], "left_semi").select(doc, F.lit("changes").alias("problem")))
    out = out.unionByName(added.join(ids, [doc, "element_id"], "left_semi").select(doc, F.lit("adds again").alias("problem"))).unionByName(twice(added, "element_id", "adds again"))
    out = out.unionByName(added.where("after_id is not null").join(known, [doc, "after_id"], "left_anti").select(doc, F.lit("adds nowhere").alias("problem")))
    return out.unionByName(twice(added, "after_id", "adds twice in a place")).distinct()


def checked_patch(stored: DataFrame, changed: DataFrame, added: DataFrame, removed: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """stored after the patches that fit; a document with a problem stays as it is."""
    bad = patch_problems(stored, changed, added, removed, doc=doc).select(doc).distinct()
    good = [d.join(bad, doc, "left_anti") for d in (changed, added, removed)]
    return C.patched(stored, *good, doc=doc)


def order_delta(asked: DataFrame, stored: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """(doc, order): the ids in their stored order where that is not the one the patch made."""
    def ids(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "element_id"))), lambda s: s["element_id"]).alias(name))

    both = ids(stored, "order").join(ids(asked, "_asked"), doc, "left")
    return both.where(~F.col("order").eqNullSafe(F.col("_asked"))).select(doc, "order")


def field_delta(before: DataFrame, after: DataFrame, fields: list[str], *, doc: str = "doc_id") -> DataFrame:
    """(doc, field, value): parts of documents besides their elements that changed, whole."""
    return C.setting_changes(before, after, key=doc, fields=fields).select(doc, F.col("property").alias("field"), F.col("after").alias("value"))


def patch_or_whole(before: DataFrame, after: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """(doc, changed, added, removed, moved, patch): whether an editor sends a patch: not if a block moved among those that stay, or too many changed.

    More than PATCH_BLOCKS and more than half of the blocks are too many.
    """
    a = before.select(doc, "element_id", F.col("ord").alias("_a"), F.struct("type", "level", "content").alias("was"))
    b = after.select(doc, "element_id", F.col("ord").alias("_b"), F.struct("type", "level", "content").alias("now"))
    both = a.join(b, [doc, "element_id"], "full")
    stays = F.col("was").isNotNull() & F.col("now").isNotNull()
    back = F.col("_a") < F.max(F.when(stays, F.col("_a"))).over(W.partitionBy(doc).orderBy(F.asc_nulls_first("_b")).rowsBetween(W.unboundedPreceding, -1))
    seen = both.withColumn("_back", F.coalesce(stays & back, F.lit(False)))
    out = seen.groupBy(doc).agg(F.count_if(stays & ~F.col("was").eqNullSafe(F.col("now"))).alias("changed"), F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("now").isNull()).alias("removed"), F.bool_or("_back").alias("moved"), F.count("now").alias("_n"))
    most = F.greatest(F.lit(PATCH_BLOCKS), F.col("_n") / 2)
    return out.withColumn("patch", ~F.col("moved") & (F.col("changed") + F.col("added") + F.col("removed") <= most)).drop("_n")


def shared_ends(text: Column, original: Column) -> Column:
    """Characters of the longer of the start and the end that two texts share."""
    def common(a: Column, b: Column) -> Column:
        same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
        first = F.array_position(F.concat(same, F.array(F.lit(True))), True)
        return F.least(first - 1, F.length(a).cast("long"), F.length(b).cast("long"))

    return F.greatest(common(text, original), common(F.reverse(text), F.reverse(original)))


def reidentified(edited: DataFrame, stored: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """edited (doc, ord, element_id, content) with `owner`: whether the block keeps its id. Of blocks with one id the one that shares more of the stored text's start or end keeps it, the first on a tie; the others, and ids that are not stored, are new elements."""
    known = stored.select(doc, "element_id", F.col("content").alias("_was"))
    both = edited.join(known, [doc, "element_id"], "left").withColumn("_s", F.when(F.col("_was").isNotNull(), shared_ends(F.col("content"), F.col("_was"))))
    nth = F.row_number().over(W.partitionBy(doc, "element_id").orderBy(F.desc_nulls_last("_s"), "ord"))
    return both.withColumn("owner", F.col("_s").isNotNull() & (nth == 1)).drop("_was", "_s")


def valid_rules(answers: DataFrame) -> DataFrame:
    """Rules of model answers (target, property, value, unit, ...) that name a kind of block and can be drawn, as instruction rules; others are dropped."""
    return R.usable(answers.where(F.col("target").isin(*R.COARSE))).withColumns({"priority": F.lit(R.INSTRUCTION), "source": F.lit("instruction")})


def valid_operations(answers: DataFrame) -> DataFrame:
    """Operations of model answers that are known and complete: new elements of a plain kind, looks that can be drawn, with their values as they are drawn."""
    cleaned = units.clean_value(F.col("property"), F.coalesce("value", F.lit("")), F.col("unit"))
    good = F.col("op").isin(*OPERATIONS) & ((F.col("op") != "insert") | F.col("kind").isin(*NEW_KINDS)) & ((F.col("op") != "set_style") | cleaned.isNotNull())
    style = F.col("op") == "set_style"
    return answers.where(F.coalesce(good, F.lit(False))).withColumns({"value": F.when(style, cleaned["value"]).otherwise(F.col("value")), "unit": F.when(style, cleaned["unit"]).otherwise(F.col("unit"))})


def document_type(value: Column) -> Column:
    """A model's document type as it is kept: lower-case words joined by underscores, 40 characters; general where it is none."""
    name = F.array_join(F.filter(F.split(F.replace(F.lower(F.coalesce(value, F.lit(""))), F.lit("-"), F.lit(" ")), r"(?U)\s+"), lambda w: w != ""), "_")
    return F.when(F.replace(name, F.lit("_"), F.lit("")).rlike(r"^\p{L}+$"), F.substring(name, 1, 40)).otherwise("general")


def structured(pieces: DataFrame, answers: DataFrame, segments: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """(doc, ord, type, level, content, from_model): each piece's blocks from the model's answer if that holds the piece's text exactly, else from the segments.

    pieces: doc, piece, text; answers and segments: doc, piece, ord, type, level, content. Pieces from MODEL_PIECES on are not
    asked about. Equality is that of tokens: only structure may change. What belongs to a piece meets in one shuffle, by the
    document, and its tokens are compared there once: as a condition of a join they would be the join's key.
    """
    cols = ["type", "level", "content"]
    block = ["ord", "content", "type", "level"]
    kind = T.StructType([answers.schema[c] for c in block]).simpleString()

    def rows(df: DataFrame, **own: Column) -> DataFrame:
        none = {"_text": F.lit(None).cast("string"), "_said": F.lit(None).cast(kind), "_own": F.lit(None).cast(kind)}
        return df.select(doc, "piece", *((own.get(n, c)).alias(n) for n, c in none.items()))

    every = rows(pieces.where(F.col("piece") < MODEL_PIECES), _text=F.col("text")).unionByName(rows(answers, _said=F.struct(*block).cast(kind))).unionByName(rows(segments, _own=F.struct(*block).cast(kind)))
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = every.repartition(parts, doc).groupBy(doc, "piece").agg(F.collect_list("_text").alias("_texts"), F.array_sort(F.collect_list("_said")).alias("_said"), F.collect_list("_own").alias("_own"))
    said = F.array_join(F.transform("_said", lambda s: s["content"]), "\n")
    met = met.withColumn("_good", F.col(doc).isNotNull() & (F.size("_said") > 0) & F.exists("_texts", lambda text: X.tokens(text) == X.tokens(said)))
    out = met.select(doc, "piece", F.col("_good").alias("from_model"), F.inline(F.when(F.col("_good"), F.col("_said")).otherwise(F.col("_own"))))
    nth = F.row_number().over(W.partitionBy(doc).orderBy("piece", "ord")) - 1
    return out.select(doc, nth.alias("ord"), *cols, "from_model")


def all_runs(elements: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """(doc, top, text, marks) of all runs of top-level elements, nested ones too, in the order of their places.

    elements: doc, path, runs, and cells (path, runs, blocks) whose own runs count only where the cell has no blocks, since
    those are elements below it.
    """
    own = elements.select(doc, "path", F.posexplode("runs").alias("k", "r"))
    cells = elements.select(doc, F.explode("cells").alias("c")).where(~F.col("c.blocks")).select(doc, F.col("c.path").alias("path"), F.posexplode("c.runs").alias("k", "r"))
    both = own.unionByName(cells)
    nth = F.row_number().over(W.partitionBy(doc, F.col("path")[0]).orderBy("path", "k")) - 1
    return both.select(doc, F.col("path")[0].alias("top"), nth.alias("nth"), "r.text", "r.marks")


def merged_runs(runs: Column) -> Column:
    """An array of runs (text, marks) in which neighbours of the same marks are one and empty ones are left out."""
    kind = "array<struct<text:string,marks:array<string>>>"

    def add(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.concat(last["text"], r["text"]).alias("text"), last["marks"].alias("marks"))))
        return F.when(r["text"] == "", acc).when((F.size(acc) > 0) & last["marks"].eqNullSafe(r["marks"]), joined).otherwise(F.concat(acc, F.array(r)))

    plain = F.transform(runs, lambda r: F.struct(F.coalesce(r["text"], F.lit("")).alias("text"), r["marks"].alias("marks")))
    return F.aggregate(plain.cast(kind), F.array().cast(kind), add)


def canonical(row: DataFrame, columns: list[str], *, volatile: tuple[str, ...] = ("id", "element_id", "ord", "order")) -> Column:
    """A row's columns as one JSON text that does not depend on how they are held: names in order, volatile ones, nulls, empty texts and empty lists left out."""
    kept = []
    for c in sorted(set(columns) - set(volatile)):
        kind, col = row.schema[c].dataType, F.col(c)
        if isinstance(kind, T.StringType):
            col = F.when(col != "", col)
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            col = F.when(F.size(col) > 0, col)
        kept.append(col.alias(c))
    return F.to_json(F.struct(*kept))


def fingerprint(elements: DataFrame, columns: list[str], *, look: str | None = None) -> Column:
    """SHA-256 of an element's canonical JSON and that of its look (a map)."""
    seen = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(look)))) if look else F.lit("{}")
    return F.sha2(F.concat(F.lit('{"element":'), canonical(elements, columns), F.lit(',"look":'), seen, F.lit("}")).cast("binary"), 256)


def admitted(requests: DataFrame, held: DataFrame, *, workspace: str, order: list[str], limit: Column) -> DataFrame:
    """requests with `ok`: whether each still fits its workspace's limit (null: none) when those before it have been served, one after another.

    held: workspace, n; requests have a quantity n (null: 0). One that is refused takes nothing, so a smaller one behind it
    may still fit: each is decided by what those before it were given, in one pass over a workspace's sorted requests.
    """
    own = requests.withColumn("_limit", limit.cast("long")).join(held.select(workspace, F.col("n").cast("long").alias("_held")), workspace, "left")
    names = requests.columns
    schema = T.StructType([*requests.schema.fields, T.StructField("ok", T.BooleanType())])
    return ordered_fold(own, [workspace], order, schema, lambda key: Budget(names))


class Budget:
    """What a workspace has left: requests in, requests and whether they were admitted out."""

    def __init__(self, names: list[str]):
        self.names, self.used = names, None

    def step(self, row: dict) -> list[tuple]:
        self.used = (row["_held"] or 0) if self.used is None else self.used
        asked = row["n"] or 0
        ok = row["_limit"] is None or self.used + asked <= row["_limit"]
        self.used += asked if ok else 0
        return [(*(row[c] for c in self.names), ok)]

    def end(self) -> list[tuple]:
        return []


def cleared(jobs: DataFrame) -> DataFrame:
    """jobs whose payload (a map) has lost its text inputs where they are finished."""
    kept = F.map_filter("payload", lambda k, v: ~k.isin(*TEXT_INPUTS))
    return jobs.withColumn("payload", F.when(F.col("status").isin("succeeded", "failed"), kept).otherwise(F.col("payload")))


def audit_rows(events: DataFrame, *, secret: tuple[str, ...] = ("content", "text", "password"), hashed: tuple[str, ...] = ("email",)) -> DataFrame:
    """(at, event, fields): an append-only log of who did what: nulls left out, contents never in it, addresses as hashes."""
    cols = [c for c in events.columns if c not in ("at", "event", *secret)]
    value = {c: F.sha2(F.lower(F.trim(F.col(c).cast("string"))).cast("binary"), 256) if c in hashed else F.col(c).cast("string") for c in cols}
    fields = F.create_map(*(x for c in sorted(cols) for x in (F.lit(c), value[c])))
    return events.select("at", "event", F.map_filter(fields, lambda k, v: v.isNotNull()).alias("fields"))


def sweeps(ticks: DataFrame, *, at: str, hourly: int = 3600, daily: int = 86400) -> DataFrame:
    """ticks with `files` and `assets`: whether the sweep of job files (the first tick of an hour) and of unused assets (of a day) is due."""
    def first(seconds: int) -> Column:
        turn = F.floor(F.unix_seconds(F.col(at)) / seconds)
        return F.row_number().over(W.partitionBy(turn).orderBy(at)) == 1

    return ticks.withColumns({"files": first(hourly), "assets": first(daily)})


def routed(files: DataFrame) -> DataFrame:
    """files (name, content) with kind and problem: the parser that an upload goes to by its extension, once its bytes are what that says.

    Text that looks like Markdown goes to the Markdown parser, other text to segmentation.
    """
    ext, data = X.extension(F.col("name")), F.col("content")
    text = X.decoded(data)
    good = F.when(ext == "docx", X.starts_with_bytes(data, "504B0304")).when(ext == "pdf", X.is_pdf(data)).when(ext == "txt", X.is_plain_text(data))
    problem = F.when(~ext.isin(*UPLOADS), "unsupported type").when(~F.coalesce(good, F.lit(False)), "not what its name says")
    kind = F.when(ext == "txt", F.when(X.looks_like_markdown(X.xml_text(text)), "markdown").otherwise("text")).otherwise(ext)
    return files.withColumns({"kind": F.when(problem.isNull(), kind), "problem": problem})


def externalised(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, assets): inline pictures (data: addresses) moved out: src becomes empty and asset_id the content's SHA-256; those that cannot be read get a note.

    assets has each distinct content once.
    """
    mime, body = (F.regexp_extract("src", r"^data:(image/(?:png|jpeg|gif|webp));base64,([A-Za-z0-9+/=\s]+)$", k) for k in (1, 2))
    inline = F.lower("src").startswith("data:")
    content = F.when(inline & (mime != ""), F.try_to_binary(F.regexp_replace(body, r"\s", ""), F.lit("base64")))
    seen = images.withColumns({"_c": content, "_m": mime})
    fits = F.col("_c").isNotNull() & F.coalesce(X.sniffed(F.col("_c")) == F.regexp_extract("_m", "/(.*)$", 1), F.lit(False))
    seen = seen.withColumn("_ok", fits)
    out = seen.withColumns({"asset_id": F.when(F.col("_ok"), F.sha2("_c", 256)), "note": F.when(inline & ~F.col("_ok"), "a picture that can't be read was removed"), "src": F.when(~inline, F.col("src")).otherwise("")}).drop("_c", "_m", "_ok")
    assets = seen.where("_ok").groupBy(F.sha2("_c", 256).alias("asset_id")).agg(F.any_value("_c").alias("content"), F.any_value("_m").alias("type"))
    return out, assets


def inline_bytes(images: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """(doc, bytes): about how many bytes a document's inline pictures have once they are decoded."""
    body = F.substring_index("src", ",", -1)
    size = F.when(F.lower("src").startswith("data:"), F.floor(F.length(body) * 3 / 4)).otherwise(0)
    return images.groupBy(doc).agg(F.sum(size).cast("long").alias("bytes"))


def instructed(elements: DataFrame, rules: DataFrame, given: DataFrame, operations: DataFrame, waiting: DataFrame, *, doc: str = "doc_id") -> dict[str, DataFrame]:
    """One instruction to all documents: `given` rules by target, operations by document, proposals already waiting.

    A document with an override that the rules would change is stopped (`conflicts`), one with an operation that does not
    fit is refused (`invalid`); both stay as they are. In the others looks and page breaks are applied (`elements`,
    `rules`), and operations that change content become proposals (`proposals`, new ones only).
    """
    clash = R.conflicts(elements, rules, given, doc)
    bad = tree.invalid_operations(operations, elements, doc=doc)
    stopped = clash.select(doc).unionByName(bad.select(doc)).distinct()
    good = operations.join(stopped, doc, "left_anti")
    now, later = tree.split_operations(good)
    free = rules.join(stopped, doc, "left_anti")
    told = R.given_to(free.select(doc).distinct(), given)
    out = tree.styled(R.stacked(free, told.select(free.columns)), now, doc=doc).unionByName(rules.join(stopped, doc, "left_semi"))
    offered = tree.new_proposals(waiting, later, [doc, "op", "target", "after_id", "content"], order="seq")
    return {"conflicts": clash, "invalid": bad, "elements": tree.replayed(elements, now, doc=doc), "rules": out, "proposals": offered}


def saved(stored: DataFrame, incoming: DataFrame, rules: DataFrame, fields: list[str], *, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(elements, rules) of a save: the client's elements renumbered, the server's fields kept by id, rules of elements that are gone dropped."""
    nth = F.row_number().over(W.partitionBy(doc).orderBy("ord", "element_id")) - 1
    own = tree.keep_fields(stored, incoming, fields, doc=doc).withColumn("ord", nth)
    return own, R.prune(rules, own, doc)
