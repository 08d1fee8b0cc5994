"""Timelines, due items and links of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import slug, wiki_targets
from larkspur.operators.activation import instant
from larkspur.session import once

EPISODE = ["id", "ts", "actor", "kind", "summary", "body", "scope", "source_path"]


def each_once(rows: DataFrame, *columns: str) -> DataFrame:
    """The named columns of a table with deliveries of one record counted once."""
    return rows.select(*columns).distinct()


def timeline(episodes: DataFrame, start: str | None = None, end: str | None = None, limit: int | None = 100, at: Column | None = None) -> DataFrame:
    """Episodes from day ``start`` up to the end of day ``end`` (UTC, either open), newest first.

    The range is half open on the instant, so no fraction of the last second is lost; rows whose
    time is null or not readable are in no bounded range and come last in an open one. Ties go by id.
    """
    rows = episodes.select(*EPISODE, (instant(F.col("ts")) if at is None else at).alias("at"))
    if start is not None:
        rows = rows.where(F.col("at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col("at") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    order = [F.desc_nulls_last("at"), F.col("id")]
    if limit is None:
        return once(rows).orderBy(*order).drop("at")
    # the ids first, then the texts of those only
    best = rows.select("id", "at").distinct().orderBy(*order).limit(limit).select(F.col("id").alias("_best"))
    few = rows.join(F.broadcast(best) if limit <= 10_000 else best, F.col("id").eqNullSafe(F.col("_best")), "left_semi").distinct()
    return few.orderBy(*order).limit(limit).drop("at")


def upcoming(future: DataFrame, today: str, days: int | None = None) -> DataFrame:
    """Open items due by ``today + days`` (all without ``days``); overdue ones and those whose due
    day is not readable always count. In order of the due text, then id."""
    rows = future.where("status = 'open'")
    if days is not None:
        rows = rows.where(F.coalesce(F.try_to_date("due", "yyyy-MM-dd") <= F.date_add(F.lit(today).cast("date"), days), F.lit(True)))
    return rows.select("id", "body", "due", "created_by", "status", "created_at").orderBy("due", "id")


def related_to(links: DataFrame, memories: DataFrame, episodes: DataFrame) -> DataFrame:
    """Every memory's links with what they point at: ``from_id, to_kind, to_id, link_kind, title, body, source_path``.

    A target that does not exist, or is of another kind than memory and episode, gives empty texts.
    """
    edges = each_once(links, "from_kind", "from_id", "to_kind", "to_id", "kind").where("from_kind = 'memory'")

    def what(rows: DataFrame, kind: str, title: str) -> DataFrame:
        """The targets of one kind, each once: only rows that a link names are compared."""
        named = edges.where(F.col("to_kind") == kind).select(F.col("to_id").alias("_named")).distinct()
        few = rows.join(named, F.col("id") == F.col("_named"), "left_semi").dropDuplicates(["id"])
        return few.select(F.lit(kind).alias("t_kind"), F.col("id").alias("t_id"), F.col(title).alias("title"), F.substring("body", 1, 240).alias("body"), "source_path")

    targets = what(memories, "memory", "title").unionByName(what(episodes, "episode", "summary"))
    j = edges.join(targets, (F.col("to_kind") == F.col("t_kind")) & (F.col("to_id") == F.col("t_id")), "left")
    none = F.lit("")
    return j.select("from_id", "to_kind", "to_id", F.col("kind").alias("link_kind"), *[F.coalesce(c, none).alias(c) for c in ("title", "body", "source_path")])


def related(links: DataFrame, memories: DataFrame, episodes: DataFrame, name: str) -> DataFrame:
    """The links of the memory of one name, by kind and target."""
    one = memories.where(F.col("name") == slug(name)).select(F.col("id").alias("own_id"))
    walk = related_to(links.join(one, F.col("from_id") == F.col("own_id"), "left_semi"), memories, episodes)
    return walk.drop("from_id").orderBy("link_kind", "to_kind", "to_id")


def wiki_links(memories: DataFrame) -> DataFrame:
    """The link rows that ``[[target]]`` in memory bodies stand for, resolved by name."""
    said = memories.select(F.col("id").alias("from_id"), F.explode(wiki_targets(F.col("body"))).alias("target"))
    names = memories.select(F.col("name").alias("target"), F.col("id").alias("to_id"))
    found = said.join(names, "target").select("from_id", "to_id").distinct()
    return found.select(F.lit("memory").alias("from_kind"), "from_id", F.lit("memory").alias("to_kind"), "to_id", F.lit("wiki").alias("kind"))
