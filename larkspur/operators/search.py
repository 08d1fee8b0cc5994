"""Ranked search over memories, episodes and locks, as one plan per query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.config import EngineConfig
from larkspur.functions.text import ascii_tokens, count_of, search_terms
from larkspur.operators.bm25 import TextIndex
from larkspur.session import once

MEMORY, EPISODE, LOCK = {"title": 5, "body": 1}, {"summary": 3, "body": 1}, {"slug": 5, "title": 1, "body": 1}


def scope_order(scope: str) -> list[tuple[str, int]]:
    """Scope patterns to look in, narrow to broad, with their rank."""
    if scope.startswith("product:"):
        found = [scope, "company", "os"]
    elif scope == "company":
        found = ["company", "product:%", "os"]
    else:
        found = ["os", "company"]
    return [(s, k) for k, s in enumerate(found)]


def scope_index(column: Column, scope: str) -> Column:
    """Rank of the first pattern a scope fits, null for none. Patterns exclude each other."""
    out = F.lit(None).cast("int")
    for pattern, k in reversed(scope_order(scope)):
        fits = column.startswith(pattern[:-1]) if pattern.endswith("%") else column == pattern
        out = F.when(fits, F.lit(k)).otherwise(out)
    return out


def readable(rows: DataFrame, acl: DataFrame, reader: str, owner: str = "owner") -> DataFrame:
    """Rows whose owner lets ``reader`` read: shared, the reader's own, else what the list says
    for the reader, else what it says for everyone (``*``), else open.

    The list is reduced to the two readers in question; it is a table of grants per owner and
    joined on the owner, so Spark picks the join by its size.
    """
    grants = acl.where(F.col("reader").isin(reader, "*")).groupBy(F.col("owner_node").alias("_owner"))
    said = grants.agg(F.max(F.when(F.col("reader") == reader, F.col("granted"))).alias("_own"), F.max(F.when(F.col("reader") == "*", F.col("granted"))).alias("_any"))
    j = rows.join(said, F.col(owner) == F.col("_owner"), "left")
    ok = F.col(owner).isin("shared", reader) | (F.coalesce("_own", "_any", F.lit(1)) != 0)
    return j.where(ok).drop("_owner", "_own", "_any")


def match_ratio(text: Column, terms: list[str]) -> tuple[Column, Column]:
    """``(matched, ratio)``: how many terms begin an ASCII token of the text, and their share."""
    tokens = ascii_tokens(text)
    matched = count_of(terms, lambda t: F.exists(tokens, lambda w: w.startswith(t)))
    return matched, matched / F.lit(float(max(1, len(terms))))


def passes_floor(text: Column, terms: list[str], floor: float) -> Column:
    matched, ratio = match_ratio(text, terms)
    return (ratio >= floor) if len(terms) <= 1 else (matched >= 2) & (ratio >= floor)


def _text(*columns: str) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])


def best_of(hits: DataFrame, n: int) -> DataFrame:
    """The best n of each scope among rows with all terms (``strict``) and among all rows, before any
    later filter. Each is a plain limit per scope, so every task keeps n rows of a scope at most."""
    rank = F.row_number().over(Window.partitionBy("scope_index").orderBy("bm25", "id"))
    top = lambda rows, strict: rows.withColumn("rn", rank).where(F.col("rn") <= n).select("id", "bm25", "scope_index", F.lit(strict).alias("strict"))
    return top(hits, False).unionByName(top(hits.where("all_terms"), True))


def _with_rows(best: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """The few best hits with their records' columns."""
    return (F.broadcast(best) if n <= 10_000 else best).join(rows, "id").dropDuplicates(["strict", "id"])


HIT = ["kind", "id", "scope", "title", "source_path", "owner", "scope_index", "bm25", "strict"]


def memory_hits(memories: DataFrame, acl: DataFrame, terms: list[str], scope: str, reader: str, n: int, floor: float, owner: str | None = None, archived: bool = False, index: TextIndex | None = None) -> DataFrame:
    """Memory candidates (HIT): limited per scope first, then access and match floor."""
    index = index or TextIndex.over(memories, MEMORY, None)
    hits = index.hits(terms).join(memories.select("id", "owner", "scope", "status"), "id").withColumn("scope_index", scope_index(F.col("scope"), scope)).where("scope_index is not null")
    if owner is not None:
        hits = hits.where(F.col("owner").isin(owner, "shared"))
    if not archived:
        hits = hits.where("status <> 'archived'")
    rows = memories.select("id", "name", "title", "body", "owner", "scope", F.coalesce("source_path", F.lit("")).alias("source_path"))
    kept = readable(_with_rows(best_of(hits, n), rows, n), acl, reader).where(passes_floor(_text("name", "title", "body"), terms, floor))
    return kept.withColumn("kind", F.lit("memory")).select(*HIT)


def episode_hits(episodes: DataFrame, terms: list[str], scope: str, n: int, floor: float, index: TextIndex | None = None) -> DataFrame:
    """Episode candidates (HIT); episodes have no owner's access rule and no archive."""
    index = index or TextIndex.over(once(episodes.select("id", "summary", "body")), EPISODE, None)
    scopes = episodes.select("id", "scope").distinct()
    hits = index.hits(terms).join(scopes, "id").withColumn("scope_index", scope_index(F.col("scope"), scope)).where("scope_index is not null")
    rows = episodes.select("id", "summary", "body", "actor", "scope", F.coalesce("source_path", F.lit("")).alias("source_path"))
    kept = _with_rows(best_of(hits, n), rows, n).where(passes_floor(_text("summary", "body"), terms, floor))
    return kept.select(F.lit("episode").alias("kind"), "id", "scope", F.col("summary").alias("title"), "source_path", F.col("actor").alias("owner"), "scope_index", "bm25", "strict")


def lock_hits(locks: DataFrame, terms: list[str], scope: str, n: int, floor: float, index: TextIndex | None = None) -> DataFrame:
    """Active locks (HIT), as memories with the negated id."""
    index = index or TextIndex.over(once(locks.select("id", "slug", "title", "body")), LOCK, None)
    live = locks.where("status = 'active'").select("id", "scope").distinct()
    hits = index.hits(terms).join(live, "id").withColumn("scope_index", scope_index(F.col("scope"), scope)).where("scope_index is not null")
    kept = _with_rows(best_of(hits, n), locks.select("id", "slug", "title", "body", "scope"), n).where(passes_floor(_text("slug", "title", "body"), terms, floor))
    return kept.select(F.lit("memory").alias("kind"), (-F.col("id")).alias("id"), "scope", "title", F.lit("").alias("source_path"), F.lit("shared").alias("owner"), "scope_index", "bm25", "strict")


def ranked(parts: list[DataFrame], limit: int | None, episode_weight: float = 0.55) -> DataFrame:
    """All-terms hits if any passed, else any-term hits; ranked per kind to [-weight, 0].

    The inputs hold at most 2 n rows per scope and part, so the windows over all of them are small.
    """
    hits = reduce(DataFrame.unionByName, parts)
    kept = hits.withColumn("_any", F.max("strict").over(Window.partitionBy(F.lit(1)))).where("strict = _any")
    best = F.max(F.abs("bm25")).over(Window.partitionBy("kind"))
    weight = F.when(F.col("kind") == "episode", F.lit(float(episode_weight))).otherwise(F.lit(1.0))
    rank = F.when(best > 0, F.round(-(F.abs("bm25") / best) * weight, 6)).otherwise(F.lit(0.0))
    out = kept.withColumn("rank", rank).select("kind", "id", "scope", "title", "source_path", "owner", "scope_index", "rank")
    if limit is None:
        return out
    return out.orderBy("rank", "scope_index", F.when(F.col("kind") == "memory", 0).otherwise(1), "id").limit(limit)


Indexes = dict[str, TextIndex]  # by kind: memory, episode, lock


def search(memories: DataFrame, episodes: DataFrame, acl: DataFrame, query: str, scope: str = "os", reader: str = "agent:builder", limit: int = 10, owner: str | None = None, archived: bool = False, config: EngineConfig = EngineConfig(), indexes: Indexes | None = None) -> DataFrame:
    """``kind, id, scope, title, source_path, owner, scope_index, rank`` of the best ``limit`` hits.

    Reading is pure: a caller that wants the recalls logged appends :func:`recalls_of` the result.
    A query without terms, a limit of 0 and empty tables give no rows.
    """
    terms = search_terms(query)
    n = limit if terms else 0
    known = indexes or {}
    parts = [memory_hits(memories, acl, terms, scope, reader, n, config.match_floor, owner, archived, known.get("memory")), episode_hits(episodes, terms, scope, n, config.match_floor, known.get("episode"))]
    return ranked(parts, n, config.episode_weight)


def ask(memories: DataFrame, episodes: DataFrame, acl: DataFrame, agent: str, query: str, asker: str, scope: str = "company", limit: int = 10, archived: bool = False, config: EngineConfig = EngineConfig(), indexes: Indexes | None = None) -> DataFrame:
    """A search in one agent's notes, empty if the agent does not let the asker read."""
    gate = readable(memories.sparkSession.createDataFrame([(agent,)], "owner string"), acl, asker).select(F.lit(True).alias("_open"))
    return search(memories, episodes, acl, query, scope, asker, limit, agent, archived, config, indexes).join(F.broadcast(gate)).drop("_open")  # gate: one row at most


def relevance_scores(hits: DataFrame) -> DataFrame:
    """``id, score``: a hit's rank as a positive share of the best, its largest over scopes."""
    return ranked([hits], None).groupBy("id").agg(F.max(-F.col("rank")).alias("score"))


def recalls_of(hits: DataFrame, reader: str, scope: str, now: str, next_id: int) -> DataFrame:
    """The recall events of a search's memory hits, to be appended to the log."""
    w = Window.orderBy("rank", "scope_index", "id")  # at most ``limit`` rows
    return hits.where("kind = 'memory'").select(
        (F.row_number().over(w) + F.lit(next_id - 1)).cast("bigint").alias("id"), F.col("id").alias("memory_id"), F.lit(reader).alias("queried_by"), F.lit(scope).alias("query_scope"), F.lit(now).alias("ts")
    )
