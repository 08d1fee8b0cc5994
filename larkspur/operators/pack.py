"""Context packs and briefs: bounded, explained lists of what matters for a task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.config import EngineConfig
from larkspur.functions.relevance import is_core, lexical, matches_any, passes_floor, prepared, tail_strong
from larkspur.functions.text import agent_name, marks, search_terms, task_terms
from larkspur.operators.activation import instant, is_hot, with_activation
from larkspur.operators.episodes import timeline, upcoming
from larkspur.operators.search import Indexes, lock_hits, memory_hits, readable, relevance_scores
from larkspur.session import once, written

LINE = ["section", "title", "body", "source_path", "scope", "owner", "reason", "activation", "confidence"]
SCORE_HITS = 128
PRECEDENTS = 500


def visible(scope: Column) -> Column:
    return scope.isin("company", "os") | scope.startswith("product:")


def memory_rows(memories: DataFrame) -> DataFrame:
    """Memories as pack candidates; only the first 320 characters of a body are looked at."""
    cols = ["id", "name", "title", "owner", "scope", "is_lock", "status"]
    return memories.select(*cols, F.substring(F.coalesce("body", F.lit("")), 1, 320).alias("body"), F.coalesce("source_path", F.lit("")).alias("source_path"))


def store_rows(locks: DataFrame) -> DataFrame:
    """Active locks of the store as pack candidates, ids negated."""
    one = once(locks.where("status = 'active'").select("id", "slug", "title", "body", "scope"))
    return one.select(
        (-F.col("id")).alias("id"), F.col("slug").alias("name"), "title", F.lit("shared").alias("owner"), "scope", F.lit(1).alias("is_lock"), F.lit("hot").alias("status"),
        F.substring(F.coalesce("body", F.lit("")), 1, 320).alias("body"), F.lit("locks").alias("source_path"),
    )


def standing(tables: dict[str, DataFrame], reader: str, now: str, locks: int, hot: int, terms: list[str] | None = None, scores: DataFrame | None = None, floor: float | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The best ``locks`` active locks (house rules always) and ``hot`` warm memories, those that fit
    the task if there are ``terms``: one pass over both, ranked per section with its place.
    """
    live = memory_rows(tables["memories"]).where("status <> 'archived'").withColumn("own", F.lit(True))
    enough = passes_floor(terms, floor) if floor is not None and terms is not None else "true"
    strong = tail_strong(terms) if floor is not None and terms is not None else "true"

    def fitting(rows: DataFrame) -> DataFrame:
        rows = prepared(rows.where(visible(F.col("scope")))).withColumn("core", F.expr(f"is_lock = 1 AND {is_core()}"))
        return rows.where(f"if(is_lock = 1, core OR {enough}, {enough} AND {strong})")

    share = F.expr(lexical(terms) if terms is not None else "0D").alias("share")
    kept = ["id", "title", "body", "source_path", "scope", "owner", "is_lock", "core", "own", share]
    stored = fitting(store_rows(tables["locks"]).withColumn("own", F.lit(False)))
    rows = readable(fitting(live).select(*kept).unionByName(stored.select(*kept)), tables["node_acl"], reader)
    recalls = tables["recall_events"]
    if terms is not None:  # few rows are left: they are written once, and only their recalls are added up
        rows = written(rows)
        recalls = recalls.join(rows.select(F.col("id").alias("_wanted")), F.col("memory_id") == F.col("_wanted"), "left_semi")
    rows = with_activation(rows, recalls, now, config.decay).withColumn("activation", F.expr("if(own, activation, null)")).where(f"is_lock = 1 OR activation >= {config.hot_threshold}D")
    if scores is None:
        rows = rows.withColumn("relevance", F.col("share"))
    else:
        rows = rows.join(scores.select(F.col("id").alias("_s_id"), F.col("score").alias("_hit")), F.col("id") == F.col("_s_id"), "left")
        rows = rows.withColumn("relevance", F.expr("if(coalesce(_hit, 0D) > 0, _hit * greatest(share, 0.1D), share)"))
    if terms is not None:
        rows = rows.where("relevance > 0 OR core")
    rows = rows.withColumn("score", F.expr("round(relevance * 100D + greatest(least(coalesce(activation, -10D), 0D), -10D) + if(core, 0.1D, 0D), 6)"))
    rows = rows.withColumn("section", F.expr("if(is_lock = 1, 'active-lock', 'hot-memory')"))
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("score"), "title", F.col("id") < 0, F.abs(F.col("id"))))
    best = rows.withColumn("place", place).where(F.col("place") <= max(locks, hot)).where(f"place <= if(is_lock = 1, {locks}, {hot})")
    reason = F.expr("CASE WHEN core THEN 'house-rule-core' WHEN relevance > 0 THEN 'matched-task' ELSE 'hot' END")
    return best.select("section", "title", "body", "source_path", "scope", "owner", reason.alias("reason"), "activation", marks(F.concat_ws("\n", "title", "body")).alias("confidence"), "place")


def _plain(rows: DataFrame, section: str, order: list[Column], limit: int, **cols: Column) -> DataFrame:
    place = F.row_number().over(Window.orderBy(*order))  # at most ``limit`` rows
    best = rows.orderBy(*order).limit(limit).withColumn("place", place)
    return best.select(F.lit(section).alias("section"), *[c.alias(n) for n, c in cols.items()], F.lit(None).cast("double").alias("activation"), "place")


def future_lines(future, today, days, limit, terms=None, floor=None) -> DataFrame:
    """Due items; with terms those that fit the task."""
    rows = upcoming(future, today, days)
    if terms is not None:
        rows = prepared(rows, "'future'", "due", "body").where(f"{passes_floor(terms, floor)} AND {tail_strong(terms)}")
    return _plain(
        rows, "due-future", [F.col("due"), F.col("id")], limit, title=F.col("due"), body=F.col("body"), source_path=F.concat(F.lit("future_items:"), F.col("id").cast("string")), scope=F.lit("company"),
        owner=F.col("created_by"), reason=F.lit("due-future" if terms is None else "matched-task"), confidence=F.array().cast("array<string>"),
    ).select(*LINE, "place")


def precedent_lines(episodes, terms, floor, limit) -> DataFrame:
    """Among the newest 500 episodes that are no misses, those that fit the task.

    The newest are found on ids and times alone; texts are read for those only.
    """
    order = [F.desc_nulls_last("at"), F.col("id")]
    newest = episodes.where("kind <> 'miss'").select("id", instant(F.col("ts")).alias("at")).distinct().orderBy(*order).limit(PRECEDENTS)
    cols = episodes.where("kind <> 'miss'").select("id", "summary", F.coalesce("body", F.lit("")).alias("body"), F.coalesce("source_path", F.lit("")).alias("source_path"), "scope", "actor")
    rows = cols.join(F.broadcast(newest), "id").dropDuplicates(["id"])  # PRECEDENTS rows
    rows = prepared(rows, "summary", "''", "body").where(matches_any(terms)).drop("_text", "_frame", "_head")
    if floor is not None:
        rows = prepared(rows, "'episode'", "summary", "body").where(f"{passes_floor(terms, floor)} AND {tail_strong(terms)}")
    return _plain(
        rows, "episodic-precedent", order, limit, title=F.col("summary"), body=F.substring("body", 1, 240), source_path=F.col("source_path"), scope=F.col("scope"), owner=F.col("actor"),
        reason=F.lit("matched-task"), confidence=marks(F.col("body")),
    ).select(*LINE, "place")


def yesterday_lines(episodes, yesterday, limit) -> DataFrame:
    rows = timeline(episodes, yesterday, yesterday, None).withColumn("at", instant(F.col("ts")))
    return _plain(
        rows, "yesterday", [F.desc("at"), F.col("id")], limit, title=F.col("summary"), body=F.coalesce("body", F.lit("")), source_path=F.coalesce("source_path", F.lit("")), scope=F.col("scope"), owner=F.col("actor"),
        reason=F.lit("yesterday"), confidence=marks(F.coalesce("body", F.lit(""))),
    ).select(*LINE, "place")


def no_match_line(like: DataFrame) -> DataFrame:
    """The line of a pack that found nothing for the task."""
    row = ("nothing-specific", "No task match", "No task match above the relevance floor -- standing rules only.", "", "company", "shared", "no-task-match", None, [], 1)
    return like.sparkSession.createDataFrame([row], ", ".join(f"{c} string" for c in LINE[:7]) + ", activation double, confidence array<string>, place int")


def assemble(sections: list[tuple[int, DataFrame]], budget: int, conditional: bool) -> DataFrame:
    """The lines of all sections in order, at most ``budget``.

    With ``conditional``, section 2 (precedents) stays only if no line kept of the sections before
    is specific to the task, and section 4 (the marker) only if none is in the end. Every section
    holds at most ``budget`` rows, so the windows over all of them are small.
    """
    lines = reduce(DataFrame.unionByName, [s.select(*LINE, "place").withColumn("sec", F.when(F.col("section") == "hot-memory", 1).otherwise(k)) for k, s in sections])
    everything = Window.partitionBy(F.lit(1))
    order = everything.orderBy("sec", "place")
    specific = (F.col("reason") != "house-rule-core") & (F.col("section") != "nothing-specific")
    lines = lines.withColumn("rn", F.row_number().over(order))
    if conditional:
        found = F.max(F.when((F.col("sec") <= 1) & (F.col("rn") <= budget), specific).otherwise(F.lit(False))).over(everything)
        lines = lines.withColumn("found", found).where((F.col("sec") != 2) | ~F.col("found")).withColumn("rn", F.row_number().over(order))
        found = F.max(F.when((F.col("sec") <= 3) & (F.col("rn") <= budget), specific).otherwise(F.lit(False))).over(everything)
        lines = lines.withColumn("found", found).where((F.col("sec") != 4) | ~F.col("found")).withColumn("rn", F.row_number().over(order))
    return lines.where(F.col("rn") <= budget).select(F.col("rn").cast("bigint").alias("line"), *LINE)


def context(tables: dict[str, DataFrame], agent: str, task: str, now: str, budget: int | None = None, config: EngineConfig = EngineConfig(), indexes: Indexes | None = None) -> DataFrame:
    """``line`` and the pack columns for a task: locks, warm memories, precedents, due items.

    A task of stop words only has no floor and lists all due items instead. A budget of 0 is empty.
    """
    n = config.context_budget if budget is None else budget
    reader, terms = agent_name(agent), task_terms(task)
    fut = tables["future_items"]
    if not terms:
        return assemble([(0, standing(tables, reader, now, n, n, config=config)), (3, future_lines(fut, now[:10], None, n))], n, False)
    floor = config.context_floor
    parts = [
        (0, standing(tables, reader, now, n, n, terms, task_scores(tables, task, reader, config, indexes), floor, config)),
        (2, precedent_lines(tables["episodes"], terms, floor, n)),
        (3, future_lines(fut, now[:10], None, n, terms, floor)),
        (4, no_match_line(tables["memories"])),
    ]
    return assemble(parts, n, True)


def task_scores(tables: dict[str, DataFrame], task: str, reader: str, config: EngineConfig = EngineConfig(), indexes: Indexes | None = None) -> DataFrame:
    """``id, score``: how well a search for the task finds memories, and locks by their negated id."""
    words, known = search_terms(task), indexes or {}
    memory = memory_hits(tables["memories"], tables["node_acl"], words, "company", reader, SCORE_HITS, config.match_floor, index=known.get("memory"))
    lock = lock_hits(tables["locks"], words, "company", SCORE_HITS, config.match_floor, known.get("lock"))
    return relevance_scores(memory).unionByName(relevance_scores(lock))


def brief(tables: dict[str, DataFrame], agent: str, now: str, yesterday: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The standing brief: 5 locks, 8 warm memories, 5 items due in 30 days, then yesterday, 20 lines in all."""
    parts = [
        (0, standing(tables, agent_name(agent), now, 5, 8, config=config)),
        (2, future_lines(tables["future_items"], now[:10], 30, 5)),
        (3, yesterday_lines(tables["episodes"], yesterday, 20)),
    ]
    return assemble(parts, 20, False)


def prune_report(memories: DataFrame, recalls: DataFrame, now: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Memories that pruning spares (locks) or would take (cold), by title."""
    rows = with_activation(memory_rows(memories).where("status <> 'archived'"), recalls, now, config.decay)
    lock = F.col("is_lock") == 1
    section = F.when(lock, "lock-exempt").when(~is_hot(F.lit(False), F.col("activation"), config.hot_threshold), "cooling-candidate")
    return rows.withColumn("section", section).where("section is not null").select("section", "id", "title", "scope", "owner", "source_path", "activation", marks(F.concat_ws("\n", "title", "body")).alias("confidence"))
