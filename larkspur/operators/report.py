"""Counts, and the reports on what to promote to a broader scope or let cool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.config import EngineConfig
from larkspur.operators.activation import clean_recalls, decayed, is_hot
from larkspur.operators.episodes import each_once


def stats_scalars(memories: DataFrame, episodes: DataFrame, recalls: DataFrame, locks: DataFrame) -> DataFrame:
    """One row: memories, episodes, recalls, misses, active_locks, superseded_locks."""
    e = each_once(episodes, "id", "kind")
    l = each_once(locks, "id", "status")
    parts = [
        memories.agg(F.count("*").alias("memories")),
        e.agg(F.count("*").alias("episodes"), F.count_if(F.col("kind") == "miss").alias("misses")),
        clean_recalls(recalls).agg(F.count("*").alias("recalls")),
        l.agg(F.count_if(F.col("status") == "active").alias("active_locks"), F.count_if(F.col("status") == "superseded").alias("superseded_locks")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out.select("memories", "episodes", "recalls", "misses", "active_locks", "superseded_locks")


def grouped_counts(rows: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """``column, n``: records per value, each record (by ``keys``) once; null is a value of its own."""
    rows = each_once(rows, *keys, column) if keys else rows
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def counts_map(rows: DataFrame, column: str) -> DataFrame:
    """The same counts as one sorted map, for the one-row form of the statistics."""
    each = grouped_counts(rows.where(F.col(column).isNotNull()), column)
    return each.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(f"by_{column}"))


def scope_level(scope: Column) -> Column:
    return F.when(scope == "os", 2).when(scope == "company", 1).otherwise(0)


def recall_scopes(memories: DataFrame, recalls: DataFrame) -> DataFrame:
    """``id, higher, suggested_scope, recalls_by_scope, last_recall``: what recalls say of each memory.

    ``higher`` counts recalls from broader scopes; ``suggested_scope`` is the one with most of them
    (then the broader, then the later name), as company or os. Recalls are added up per memory and
    scope before they meet the memories.
    """
    seen = clean_recalls(recalls, "query_scope").where("memory_id is not null and query_scope is not null")
    each = seen.groupBy("memory_id", "query_scope").agg(F.count("*").alias("n"))
    higher, best = _broader()
    counts = each.join(memories.select("id", "scope"), F.col("memory_id") == F.col("id")).groupBy("id").agg(
        higher.alias("higher"), best.alias("best"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("query_scope", "n")))).alias("recalls_by_scope")
    )
    return counts.select("id", "higher", _suggested(F.col("best")).alias("suggested_scope"), "recalls_by_scope")


def _broader() -> tuple[Column, Column]:
    """Over rows (scope, query_scope, n): the recalls from broader scopes, and the scope with most."""
    broader = scope_level(F.col("query_scope")) > scope_level(F.col("scope"))
    best = F.max_by(F.when(broader, F.col("query_scope")), F.when(broader, F.struct("n", scope_level(F.col("query_scope")).alias("level"), "query_scope")))
    return F.sum(F.when(broader, F.col("n")).otherwise(0)), best


def _suggested(best: Column) -> Column:
    return F.when(best == "os", "os").when(best.isNotNull(), "company")


def last_recalls(recalls: DataFrame) -> DataFrame:
    """``memory_id, last_recall``: the latest recall by its text."""
    return recalls.where("memory_id is not null and ts is not null").groupBy("memory_id").agg(F.max("ts").alias("last_recall"))


def required_tier(scope: Column, to: Column, lock: Column) -> Column:
    """Who may promote: operator for locks and anything from or to os, else curator for known scopes."""
    high = lock | (scope == "os") | F.coalesce(to == "os", F.lit(False))
    return F.when(high, "operator").when(scope.startswith("product:") | (scope == "company"), "curator").otherwise("operator")


def tier_allows(scope: Column, to: Column, by: Column) -> Column:
    swap = ((scope == "company") & to.startswith("product:")) | (scope.startswith("product:") & (to == "company"))
    return (by == "operator") | ((by == "curator") & swap)


def consolidation(memories: DataFrame, recalls: DataFrame, now: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Up to two rows per memory: recalled from broader scopes often enough to be promoted (whatever
    its status), and kept as a lock or cooling (unless archived)."""
    base = memories.select("id", "name", "title", "owner", "scope", "is_lock", "status", "source_path")
    # one pass over the recalls: sums per memory and scope first, whatever share of them one memory has
    seen = clean_recalls(recalls, "query_scope").where("memory_id is not null").withColumn("part", decayed(F.col("ts"), now, config.decay))
    each = seen.groupBy("memory_id", "query_scope").agg(F.count("*").alias("n"), F.sum("part").alias("part"), F.max("ts").alias("last"))
    higher, best = _broader()
    scopes = memories.select(F.col("id").alias("_id"), F.col("scope"))
    said = each.where("query_scope is not null or part is not null or last is not null").join(scopes, F.col("memory_id") == F.col("_id")).groupBy("_id").agg(
        higher.alias("higher"), best.alias("best"), F.round(F.ln(F.sum("part")), 6).alias("activation"), F.max("last").alias("last_recall")
    )
    j = base.join(said, F.col("id") == F.col("_id"), "left").withColumns({"higher": F.coalesce("higher", F.lit(0)).cast("bigint"), "suggested_scope": _suggested(F.col("best"))})
    lock = F.col("is_lock") == 1
    none = F.lit(None).cast("string")

    def row(kind: str, order: int, suggested: Column, tier: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("kind_order"), suggested.alias("suggested"), tier.alias("tier"))

    promote = F.when(F.col("higher") >= config.promotion_recalls, row("promotion-candidate", 0, F.col("suggested_scope"), required_tier(F.col("scope"), F.col("suggested_scope"), lock)))
    live = F.col("status") != "archived"
    keep = F.when(live & lock, row("lock-exempt", 2, none, F.lit("operator"))).when(
        live & ~is_hot(F.lit(False), F.col("activation"), config.hot_threshold), row("cooling-candidate", 1, none, F.lit("archivist-report"))
    )
    return j.withColumn("c", F.explode(F.array_compact(F.array(promote, keep)))).select(
        F.col("c.kind").alias("kind"), "id", "title", "name", "owner", F.col("scope").alias("current_scope"), F.col("c.suggested").alias("suggested_scope"), F.col("c.tier").alias("required_tier"),
        "higher", "activation", "last_recall", F.coalesce("source_path", F.lit("")).alias("source_path"),
    )


def report_order() -> list[Column]:
    """Promotions, then what cools, then locks; most recalls first."""
    kind = F.expr("CASE kind WHEN 'promotion-candidate' THEN 0 WHEN 'cooling-candidate' THEN 1 ELSE 2 END")
    return [kind, F.desc("higher"), F.col("title"), F.col("id")]
