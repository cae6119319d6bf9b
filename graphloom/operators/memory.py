"""Memories, sessions and their decay (R6, R10-R16, T12, T13, A-17, A-20-A-22, F38)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import decay_factor, half_life_factor, topic_slug

# Days without use that lead to each state, and the transitions that are allowed.
STATES = ((455, "purge_candidate"), (365, "gist_only"), (180, "shadow"), (90, "dimmed"), (30, "cooling"))
TRANSITIONS = {"active": ("needs_review", "archived"), "needs_review": ("active", "archived"), "archived": ()}


def filtered(rows: DataFrame, category=None, tags=None, after=None, before=None, status=None, limit=None, key: str = "id") -> DataFrame:
    """Conjunctive filters; newest first where there is a limit."""
    if category:
        rows = rows.where(F.col("category") == category)
    if tags:
        rows = rows.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if after:
        rows = rows.where(F.col("created_at") >= F.lit(after).cast("timestamp"))
    if before:
        rows = rows.where(F.col("created_at") < F.lit(before).cast("timestamp"))
    rows = rows.where(F.col("status") == status) if status else rows.where("status is null or status <> 'archived'") if "status" in rows.columns else rows
    return rows if limit is None else rows.orderBy(F.desc("created_at"), key).limit(limit)


def unused_days(used, as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), F.col(used).cast("date"))


def decay_state(rows: DataFrame, as_of: str, used: str = "last_used", evergreen: str = "evergreen") -> DataFrame:
    """unused_days and state by the days since the last use; evergreen rows stay active."""
    days, state = unused_days(used, as_of), None
    for limit, name in STATES:
        state = F.when(days >= limit, name) if state is None else state.when(days >= limit, name)
    return rows.withColumn("unused_days", days).withColumn("state", F.when(F.col(evergreen), "active").otherwise(state.otherwise("active")))


def transitions_log(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """One row for each state that changed."""
    return after.join(before.select(key, F.col("state").alias("from_state")), key).where(~F.col("state").eqNullSafe(F.col("from_state"))).select(key, "from_state", F.col("state").alias("to_state"))


def strength(rows: DataFrame, as_of: str, half_life: float = 30.0) -> DataFrame:
    """strength = activation times decay by days since the update; null half-life factors (evergreen) don't decay."""
    factor = half_life_factor("tags", "category")
    age = unused_days("updated_at", as_of).cast("double")
    value = F.coalesce("activation_score", F.lit(1.0)) * F.when(factor.isNull(), F.lit(1.0)).otherwise(decay_factor(age, F.lit(half_life) * factor))
    return rows.withColumn("strength", value)


def prune_candidates(rows: DataFrame, as_of: str, least: float = 0.05, dormant: int = 90) -> DataFrame:
    """Weak and long unused rows; evergreen ones are kept. A list only: nothing is deleted."""
    return strength(rows, as_of).where((F.col("strength") < least) & (unused_days("last_used", as_of) > dormant) & half_life_factor("tags", "category").isNotNull())


def transition(rows: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """Key, status and accepted for each wanted (key, to) that the table of transitions allows or not."""
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, own in TRANSITIONS.items() for b in own])
    ok = F.array_contains(pairs, F.concat_ws(">", "status", "to"))
    return rows.join(wanted, key).select(key, F.when(ok, F.col("to")).otherwise(F.col("status")).alias("status"), ok.alias("accepted"))


def revive(rows: DataFrame, least: float = 0.7) -> DataFrame:
    """Decision for supplied confidences."""
    return rows.withColumn("decision", F.when(F.coalesce("confidence", F.lit(0.0)) < least, "defer").otherwise("revive"))


def promotions(errors: DataFrame) -> DataFrame:
    """A-22: content_hash and reason of errors in two projects, twice in one if critical, or revived three times."""
    per = errors.groupBy("content_hash").agg(F.count_distinct("project_id").alias("projects"), F.max("critical").alias("critical"), F.count("*").alias("seen"), F.sum("revivals").alias("revivals"))
    reason = F.when(F.col("projects") >= 2, "projects").when(F.col("critical") & (F.col("seen") >= 2), "critical").when(F.col("revivals") >= 3, "revivals")
    return per.select("content_hash", reason.alias("reason")).where("reason is not null")


def statistics(rows: DataFrame) -> DataFrame:
    """A-20: per category: memories, oldest, newest, accesses."""
    return rows.groupBy("category").agg(F.count("*").alias("memories"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"), F.sum("access_count").alias("accesses"))


def sessions(turns: DataFrame, session: str = "session_id", time: str = "ts") -> DataFrame:
    """A-21."""
    return turns.groupBy(session).agg(F.count_if(F.col("role") == "user").alias("prompts"), F.max(time).alias("last_activity"))


def session_view(turns: DataFrame, session_id, session: str = "session_id", time: str = "ts") -> DataFrame:
    """The rows of one session in order, without forgotten ones."""
    rows = turns.where(F.col(session) == session_id)
    return (rows.where("not coalesce(forgotten, false)") if "forgotten" in turns.columns else rows).orderBy(time)


def scoped(rows: DataFrame, project: str, include_legacy: bool = False) -> DataFrame:
    """Rows of a project; those without one only if asked for."""
    return rows.where((F.col("project_id") == project) | (F.col("project_id").isNull() if include_legacy else F.lit(False)))


def unique_slugs(rows: DataFrame, title: str, key: str) -> DataFrame:
    """Slug of each row; the second and later rows of a slug get ``-2``, ``-3`` by key."""
    slug = topic_slug(title)
    n = F.row_number().over(Window.partitionBy(slug).orderBy(key))
    return rows.withColumn("slug", F.when(n == 1, slug).otherwise(F.concat(slug, F.lit("-"), n.cast("string"))))


def linked_memories(symbols: DataFrame, memories: DataFrame, limit: int = 10) -> DataFrame:
    """Up to ``limit`` newest memories of each symbol; a symbol without any keeps a row."""
    w = Window.partitionBy("symbol_key").orderBy(F.desc("updated_at"), "id")
    own = memories.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")
    return symbols.join(own.withColumnRenamed("id", "memory_id"), "symbol_key", "left")


def created_within(rows: DataFrame, minutes: int, as_of: str) -> DataFrame:
    """A-17: one row with the number of rows of the last minutes."""
    return rows.where(F.col("created_at") > F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))).agg(F.count("*").alias("n"))


def forgotten(turns: DataFrame, sessions_: DataFrame, session: str = "session_id") -> DataFrame:
    """The turns with those of ``sessions_`` forgotten: they stay but no view shows them."""
    gone = sessions_.select(session).distinct().withColumn("_gone", F.lit(True))
    old = F.coalesce("forgotten", F.lit(False)) if "forgotten" in turns.columns else F.lit(False)
    return turns.join(gone, session, "left").withColumn("forgotten", old | F.coalesce("_gone", F.lit(False))).drop("_gone")


def purged(turns: DataFrame, embeddings: DataFrame, session: str = "session_id", key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(turns, embeddings) without forgotten turns and without their embeddings."""
    gone = turns.where("forgotten").select(key)
    return turns.where("not coalesce(forgotten, false)"), embeddings.join(gone, key, "left_anti")


def resolved_topics(asked: DataFrame, aliases: DataFrame) -> DataFrame:
    """Alias, slug and topic: an alias's topic by its slug, the last one given; without one the slug stands for itself."""
    known = aliases.withColumn("slug", topic_slug("alias")).groupBy("slug").agg(F.max_by("topic", "seq").alias("topic"))
    return asked.select("alias", topic_slug("alias").alias("slug")).join(known, "slug", "left").select("alias", "slug", F.coalesce("topic", "slug").alias("topic"))


def suggested_topics(asked: DataFrame, topics: DataFrame, most: int = 3) -> DataFrame:
    """For each slug up to ``most`` topics that share most of its words; ties by name."""
    words = lambda c: F.explode(F.array_distinct(F.split(c, "-"))).alias("_w")
    hits = asked.select("slug", words("slug")).join(topics.select("topic", words("topic")), "_w").where("_w <> ''").groupBy("slug", "topic").agg(F.count("*").alias("shared"))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("shared"), "topic"))).where(F.col("rank") <= most)


def maintained(rows: DataFrame, as_of: str, least: float = 0.05, dormant: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their new state, log of changed states, prune candidates) of one maintenance run; ``rows`` has the last run's state."""
    after = decay_state(rows.drop("state"), as_of)
    return after, transitions_log(rows, after), prune_candidates(rows, as_of, least, dormant)
