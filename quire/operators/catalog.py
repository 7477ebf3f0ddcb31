"""Catalogue queries: membership, search, sorting, paging, visibility, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import written

SORTS = ("updated", "created", "title")


def escaped(text: str) -> str:
    """A search text as a LIKE pattern that contains it literally."""
    return "%" + "".join("\\" + c if c in "%_\\" else c for c in text) + "%"


def owned(documents: DataFrame, members: DataFrame, user) -> DataFrame:
    """Rows of workspaces of which the user is a member; missing and forbidden look alike."""
    return documents.join(members.where(F.col("user_id") == user), "workspace_id", "left_semi")


def list_documents(documents: DataFrame, members: DataFrame, user, *, query: str | None = None, sort: str = "updated", limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of a user's documents with the total of all that match; ties are in the order of ids."""
    found = owned(documents, members, user)
    if query:
        found = found.where(F.col("title").ilike(escaped(query)))
    total = found.agg(F.count("*").alias("total"))
    order = {"updated": F.desc("updated_at"), "created": F.desc("created_at"), "title": F.lower("title")}[sort]
    page = found.orderBy(order, "id").offset(offset).limit(limit)
    return page.join(F.broadcast(total))  # one row


def get_document(documents: DataFrame, members: DataFrame, user, doc_id) -> DataFrame:
    return owned(documents.where(F.col("id") == doc_id), members, user)


def of_workspace(documents: DataFrame, workspace) -> DataFrame:
    return documents.where(F.col("workspace_id") == workspace)


def visible_templates(templates: DataFrame, members: DataFrame, user) -> DataFrame:
    """Templates of the user's workspaces that are shared or their own, by name."""
    mine = members.where(F.col("user_id") == user).select("workspace_id").distinct()
    seen = templates.join(mine, "workspace_id").where((F.col("visibility") == "workspace") | (F.col("created_by") == user))
    return seen.orderBy(F.lower("name"), "created_at", "id")


def recent_jobs(jobs: DataFrame, user, *, kind: str | None = None, status: str | None = None, limit: int = 20) -> DataFrame:
    own = jobs.where(F.col("user_id") == user)
    for column, value in (("kind", kind), ("status", status)):
        own = own if value is None else own.where(F.col(column) == value)
    return own.orderBy(F.desc("created_at"), "id").limit(limit)


def fail_interrupted(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: those that waited or ran have failed."""
    return jobs.withColumn("status", F.when(F.col("status").isin("pending", "running"), "failed").otherwise(F.col("status")))


def placed(jobs: DataFrame, head_start_minutes: int = 10) -> DataFrame:
    place = F.col("created_at") - F.when(F.col("priority"), F.make_dt_interval(F.lit(0), F.lit(0), F.lit(head_start_minutes))).otherwise(F.make_dt_interval(F.lit(0)))
    return jobs.withColumn("place", place)


def queue_order(jobs: DataFrame, *, head_start_minutes: int = 10) -> DataFrame:
    """Jobs by enqueue time, a priority job counted as enqueued head_start_minutes earlier."""
    return placed(jobs, head_start_minutes).orderBy("place", "id")


def queue_places(jobs: DataFrame, *, head_start_minutes: int = 10) -> DataFrame:
    """jobs with nth, each one's number in queue_order from 1: jobs are counted by hour, only the hours' counts meet in one task."""
    hourly = placed(jobs, head_start_minutes).withColumn("_h", F.date_trunc("hour", "place"))
    before = F.sum("_n").over(W.orderBy("_h").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")
    hours = hourly.groupBy("_h").agg(F.count("*").alias("_n")).select("_h", before.alias("_before"))
    within = hourly.withColumn("_k", F.row_number().over(W.partitionBy("_h").orderBy("place", "id")))
    return within.join(hours, "_h").withColumn("nth", F.col("_before") + F.col("_k")).drop("_h", "_k", "_before")


def summaries(documents: DataFrame, templates: DataFrame) -> DataFrame:
    """Status, source with its default, and the template's name where that is visible."""
    names = templates.select(F.col("id").alias("template_id"), F.col("name").alias("template_name"))
    out = documents.join(names, "template_id", "left")
    return out.withColumns({"status": F.when(F.col("formatted_at").isNotNull(), "formatted").otherwise("draft"), "source": F.coalesce("source", F.lit("paste"))})


def template_of(documents: DataFrame, templates: DataFrame, key: str = "template_id") -> DataFrame:
    """Documents with their template; an unknown id fails loudly when the row is read."""
    known = templates.select(F.col("id").alias(key), F.col("name").alias("template_name"))
    out = documents.join(known, key, "left")
    bad = F.col(key).isNotNull() & F.col("template_name").isNull()
    return out.withColumn("template_name", F.when(bad, F.raise_error(F.concat(F.lit("unknown template "), F.col(key).cast("string")))).otherwise(F.col("template_name")))


def live_sessions(sessions: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    return sessions.where((F.col("expires_at") > as_of) & F.col("revoked_at").isNull()).join(users, "user_id")


def default_workspace(workspaces: DataFrame) -> DataFrame:
    """(owner, workspace): the first that each owner made; the smaller id wins a tie."""
    return workspaces.groupBy("owner").agg(F.min_by("workspace_id", F.struct("created_at", "workspace_id")).alias("workspace_id"))


def subscription_row(subscriptions: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each event the subscription of its workspace, else that of its subscription id, else that of its customer id."""
    out = wanted
    for column in ("workspace_id", "external_id", "customer_id"):
        own = subscriptions.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_k")).agg(F.min("id").alias(f"_by_{column}"))
        out = out.join(own, F.col(column) == F.col("_k"), "left").drop("_k")
    by = [f"_by_{c}" for c in ("workspace_id", "external_id", "customer_id")]
    return out.withColumn("subscription", F.coalesce(*by)).drop(*by)


def total_size(assets: DataFrame, ids: DataFrame, *, key: str, size: str) -> DataFrame:
    return assets.join(ids, key, "left_semi").agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total"))


def valid_tokens(tokens: DataFrame, as_of: Column) -> DataFrame:
    """Tokens that can be redeemed: the newest of its user and purpose, unused and not expired."""
    nth = F.row_number().over(W.partitionBy("user_id", "purpose").orderBy(F.desc("created_at"), F.desc("id")))
    return tokens.withColumn("_nth", nth).where((F.col("_nth") == 1) & F.col("used_at").isNull() & (F.col("expires_at") > as_of)).drop("_nth")


def built_in_first(built_in: DataFrame, own: DataFrame) -> DataFrame:
    """Built-in templates in file order, then the workspace's by name."""
    a = built_in.select("id", "name", F.lit(0).alias("rank"), F.col("seq").cast("long").alias("seq"))
    b = own.select("id", "name", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("seq"))
    return a.unionByName(b).orderBy("rank", "seq", F.lower("name"), "id")


def workspace_default(workspaces: DataFrame, templates: DataFrame) -> DataFrame:
    """workspaces with their default template, void once it is gone or private."""
    usable = templates.where(F.col("visibility") == "workspace").select(F.col("id").alias("_t"), F.col("workspace_id").alias("_w"))
    out = workspaces.join(usable, (F.col("default_template") == F.col("_t")) & (F.col("workspace_id") == F.col("_w")), "left")
    return out.withColumn("default_template", F.col("_t")).drop("_t", "_w")


def of_list(rows: DataFrame, ids: str, key: str) -> DataFrame:
    """One row for each id of a comma list."""
    return rows.withColumn(key, F.explode(F.filter(F.transform(F.split(ids, ","), lambda x: F.trim(x)), lambda x: x != "")))


def ancestors(rows: DataFrame, *, key: str, parent: str) -> DataFrame:
    """(key, ancestor, depth): every row with those above it, the parent at depth 1; a ring ends where it comes back to one already met.

    A row's list of those above it is lengthened by the list of its last one, twice as far each round; lists are written and
    meet by shuffles only. Rows that come with several parents have several ways up and are followed a level at a time.
    """
    up = rows.where(F.col(parent).isNotNull()).select(key, F.col(parent).alias("ancestor"))
    if not up.groupBy(key).count().where("count > 1").isEmpty():
        return ways(up, key)
    return listed(up, key).select(key, F.posexplode("_up").alias("depth", "ancestor")).select(key, "ancestor", (F.col("depth") + 1).alias("depth"))


def listed(up: DataFrame, key: str) -> DataFrame:
    """(key, _up): for each row (key, ancestor) all those above it, nearest first. A list is done where it is shorter than the round's, or met one again."""
    step = written(up.select(key, F.array(F.when(F.col(key) != F.col("ancestor"), F.col("ancestor"))).alias("_up")).select(key, F.array_compact("_up").alias("_up"), (F.size(F.array_compact("_up")) == 0).alias("_done")), "ancestors")
    out, open_ = step.where("_done"), step.where("not _done")
    while not open_.isEmpty():
        far = out.unionByName(open_).select(F.col(key).alias("_last"), F.col("_up").alias("_more"), F.col("_done").alias("_ends"))
        met = open_.withColumn("_last", F.element_at("_up", -1)).join(far.hint("merge"), "_last", "left")
        walk = met.select(key, F.concat("_up", F.coalesce("_more", F.slice("_up", 1, 0))).alias("_walk"), F.coalesce("_ends", F.lit(True)).alias("_ends"))
        once = F.array_remove(F.array_distinct("_walk"), F.col(key))
        step = written(walk.select(key, once.alias("_up"), (F.col("_ends") | (F.size(once) < F.size("_walk"))).alias("_done")), "ancestors")
        out, open_ = out.unionByName(step.where("_done")), step.where("not _done")
    return out.select(key, "_up")


def ways(up: DataFrame, key: str) -> DataFrame:
    """(key, ancestor, depth) of rows (key, ancestor) with several ways up: one round of joins for each level, each of them written."""
    step = up.withColumns({"depth": F.lit(1), "_path": F.array(key, "ancestor")}).where(F.col(key) != F.col("ancestor"))
    above = up.select(F.col(key).alias("ancestor"), F.col("ancestor").alias("_next"))
    out = step = written(step, "ancestors")
    while not step.isEmpty():
        met = step.join(above, "ancestor").where(~F.array_contains("_path", F.col("_next")))
        step = written(met.select(key, F.col("_next").alias("ancestor"), (F.col("depth") + 1).alias("depth"), F.concat("_path", F.array("_next")).alias("_path")), "ancestors")
        out = out.unionByName(step)
    return out.select(key, "ancestor", "depth")


def effective_values(rows: DataFrame, values: DataFrame, *, key: str, parent: str) -> DataFrame:
    """(key, property, value): each style's own value, else that of the nearest style it is based on; rings are cut."""
    own = values.select(key, "property", "value", F.lit(0).alias("depth"))
    taken = ancestors(rows, key=key, parent=parent).join(values.select(F.col(key).alias("ancestor"), "property", "value"), "ancestor")
    return own.unionByName(taken.select(key, "property", "value", "depth")).groupBy(key, "property").agg(F.min_by("value", "depth").alias("value"))
