"""Queries of the recall engine over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.config import EngineConfig
from larkspur.functions.relevance import floor_relevance, lexical, prepared, tail_strong
from larkspur.functions.text import content_hash, index_tokens, search_terms, slugify, task_terms
from larkspur.functions.text import wiki_targets as targets_of
from larkspur.functions.timestamps import with_utc
from larkspur.operators import activation, mutate, pack, parse, report
from larkspur.operators import episodes as ep
from larkspur.operators import locks as lk
from larkspur.operators import search as se
from larkspur.operators.bm25 import TextIndex, bm25, postings
from larkspur.plans.recall_sql import ORACLES  # noqa: F401
from larkspur.sources import ingest
from larkspur.session import fingerprint, once, table, written

Query = Callable[[SparkSession, str], DataFrame]

NOW = "2026-06-10 00:00:00"
TODAY = "2026-03-01"
DAY = "2025-03-12"
READER = "agent:builder"
AND_QUERY, OR_QUERY, ONE_TERM = "heartbeat lease", "rotation heartbeat zzzz", "supersession"
TASK, SIGNAL_TASK, NO_TASK = "release ticket command folder", "test and review the heartbeat request", "zzzqq xxyyq"


def _t(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in ("memories", "episodes", "locks", "recall_events", "node_acl", "future_items", "links")}


_STORED: dict[tuple, TextIndex] = {}


def _indexes(spark: SparkSession, d: str) -> se.Indexes:
    """The stored text indexes of a data directory, built by the first query of a session that asks for
    one and as long as the table's files stay the same."""
    return {kind: _index(spark, d, kind) for kind in ("memory", "episode", "lock")}


def _index(spark: SparkSession, d: str, kind: str) -> TextIndex:
    name, weights = {"memory": ("memories", se.MEMORY), "episode": ("episodes", se.EPISODE), "lock": ("locks", se.LOCK)}[kind]
    key = fingerprint(spark, f"{d}/{name}.parquet")
    if key not in _STORED:
        _STORED[key] = TextIndex.over(once(table(spark, d, name).select("id", *weights)), weights, written)
    return _STORED[key]


def _search(query: str, scope: str = "company", owner: str | None = None, archived: bool = False, limit: int = 10) -> Query:
    def run(spark, d):
        t = _t(spark, d)
        return se.search(t["memories"], t["episodes"], t["node_acl"], query, scope, READER, limit, owner, archived, indexes=_indexes(spark, d))

    return run


def search_episodes_ranked(spark, d):
    words = search_terms(AND_QUERY)
    return se.ranked([se.episode_hits(table(spark, d, "episodes"), words, "company", 20, 0.5, _index(spark, d, "episode"))], 20, 0.55)


def search_locks_ranked(spark, d):
    words = search_terms("rule cooling")
    return se.ranked([se.lock_hits(table(spark, d, "locks"), words, "company", 20, 0.5, _index(spark, d, "lock"))], 20)


def ask_agent(spark, d):
    t = _t(spark, d)
    return se.ask(t["memories"], t["episodes"], t["node_acl"], "agent:planner", AND_QUERY, "agent:curator", "company", indexes=_indexes(spark, d))


def search_recall_log(spark, d):
    hits = _search(AND_QUERY)(spark, d)
    return se.recalls_of(hits, READER, "company", "2026-06-10T00:00:00+00:00", 1_000_000)


def _memory_scores(spark, d, task):
    t = _t(spark, d)
    return se.relevance_scores(se.memory_hits(t["memories"], t["node_acl"], search_terms(task), "company", READER, pack.SCORE_HITS, 0.5, index=_index(spark, d, "memory")))


def memory_relevance(spark, d):
    return _memory_scores(spark, d, TASK)


def bm25_raw(spark, d):
    m = table(spark, d, "memories").select("id", "title", "body")
    return bm25(m, se.MEMORY, search_terms(OR_QUERY)).select("id", "bm25", "all_terms")


def postings_size(spark, d):
    p = postings(table(spark, d, "memories"), "id", ["title", "body"])
    return p.groupBy("field").agg(F.count("*").alias("n_postings"), F.sum("tf").alias("n_tokens"), F.countDistinct("term").alias("n_terms"))


def match_floor(spark, d):
    m = table(spark, d, "memories")
    text = F.concat_ws(" ", "name", "title", "body")
    matched, ratio = se.match_ratio(text, search_terms("rule heartbeat supersession café"))
    return m.select("id", matched.cast("bigint").alias("matched"), F.round(ratio, 6).alias("ratio"))


def acl_visible_memories(spark, d):
    return se.readable(table(spark, d, "memories"), table(spark, d, "node_acl"), "agent:curator").select("id", "owner")


def activation_scores(spark, d):
    return activation.activation_scores(table(spark, d, "recall_events"), NOW)


def hot_cold_counts(spark, d):
    return activation.hot_cold_counts(table(spark, d, "memories"), table(spark, d, "recall_events"), NOW)


def stats_scalars(spark, d):
    t = _t(spark, d)
    return report.stats_scalars(t["memories"], t["episodes"], t["recall_events"], t["locks"])


def _counts(name: str, column: str, keys: list[str]) -> Query:
    return lambda spark, d: report.grouped_counts(table(spark, d, name), column, keys)


def _timeline(start, end, limit=100) -> Query:
    return lambda spark, d: ep.timeline(table(spark, d, "episodes"), start, end, limit).select("id", "ts", "actor", "kind", "scope")


def timeline_all_forms(spark, d):
    """The day's episodes whatever form their stamps have."""
    e = with_utc(table(spark, d, "episodes").select(*ep.EPISODE).distinct(), "ts", "source_path", table(spark, d, "source_roots"))
    return ep.timeline(e, DAY, DAY, None, F.timestamp_micros("utc_us"))[["id", "ts", "actor", "kind", "scope"]]


def upcoming_all(spark, d):
    return ep.upcoming(table(spark, d, "future_items"), TODAY)


def upcoming_30_days(spark, d):
    return ep.upcoming(table(spark, d, "future_items"), TODAY, 30)


def related_walk(spark, d):
    t = _t(spark, d)
    return ep.related_to(t["links"], t["memories"], t["episodes"])


def related_by_name(spark, d):
    t = _t(spark, d)
    return ep.related(t["links"], t["memories"], t["episodes"], "stistbrurk-calendar-supersession-8")


def wiki_links_resolved(spark, d):
    """Links by name; the test texts name no note, so each body gets a link to its own note and one to the note named like its title."""
    own = F.concat(F.lit(" [["), F.replace("name", F.lit("-"), F.lit(" ")), F.lit("|see]] [["), F.upper("title"), F.lit("]]"))
    return ep.wiki_links(table(spark, d, "memories").withColumn("body", F.concat(F.coalesce("body", F.lit("")), own)))


def wiki_targets(spark, d):
    return table(spark, d, "memories").select("id", F.explode(targets_of(F.col("body"))).alias("target"))


def locks_active(spark, d):
    return lk.list_locks(table(spark, d, "locks"))


def locks_all_with_supersedes(spark, d):
    return lk.list_locks(table(spark, d, "locks"), superseded=True)


def locks_render_order(spark, d):
    return lk.render_order(table(spark, d, "locks")).select("scope_group", "scope", "locked_on", "slug", "supersedes_slug")


def locks_restatus(spark, d):
    return lk.restatus(table(spark, d, "locks"))


def prune_report(spark, d):
    return pack.prune_report(table(spark, d, "memories"), table(spark, d, "recall_events"), NOW).transform(_said)


def consolidation_candidates(spark, d):
    return report.consolidation(table(spark, d, "memories"), table(spark, d, "recall_events"), NOW)


def higher_scope_counts(spark, d):
    return report.recall_scopes(table(spark, d, "memories"), table(spark, d, "recall_events")).select("id", "higher")


def suggested_scope(spark, d):
    return report.recall_scopes(table(spark, d, "memories"), table(spark, d, "recall_events")).select("id", "suggested_scope")


def recalls_per_scope(spark, d):
    said = report.recall_scopes(table(spark, d, "memories"), table(spark, d, "recall_events"))
    return said.select("id", F.explode("recalls_by_scope").alias("query_scope", "n"))


def consolidation_first(spark, d):
    """The report's first 40 lines with their place."""
    rows = report.consolidation(table(spark, d, "memories"), table(spark, d, "recall_events"), NOW).orderBy(*report.report_order()).limit(40)
    return rows.select("kind", "id", F.row_number().over(Window.orderBy(*report.report_order())).cast("bigint").alias("place"))


def prune_first(spark, d):
    """The pruning report's first 40 lines with their place."""
    rows = pack.prune_report(table(spark, d, "memories"), table(spark, d, "recall_events"), NOW).orderBy("title", "id").limit(40)
    return rows.select("section", "id", F.row_number().over(Window.orderBy("title", "id")).cast("bigint").alias("place"))


def last_recall(spark, d):
    return report.last_recalls(table(spark, d, "recall_events"))


def promotion_tiers(spark, d):
    m = table(spark, d, "memories").select(F.col("scope").alias("from_scope")).distinct()
    to = table(spark, d, "locks").select(F.col("scope").alias("to_scope")).distinct()
    # a table of every pair of the few scope names is the feature here
    pairs = m.join(to).join(spark.createDataFrame([("operator",), ("curator",), ("builder",)], "who string"))
    f, t, b = F.col("from_scope"), F.col("to_scope"), F.col("who")
    return pairs.select("from_scope", "to_scope", "who", report.tier_allows(f, t, b).alias("allowed"), report.required_tier(f, t, F.lit(False)).alias("tier"))


def _said(df: DataFrame) -> DataFrame:
    """The marks of confidence as one text, so that results can be compared."""
    return df.withColumn("confidence", F.array_join("confidence", " "))


def _section(task: str, section: str) -> Query:
    def run(spark, d):
        t = _t(spark, d)
        rows = pack.standing(t, READER, NOW, 15, 15, task_terms(task), pack.task_scores(t, task, READER, indexes=_indexes(spark, d)), 0.66)
        return _said(rows.where(F.col("section") == section).drop("place"))

    return run


def context_precedent(spark, d):
    return pack.precedent_lines(table(spark, d, "episodes"), task_terms(TASK), 0.66, 15).drop("place", "activation").transform(_said)


def _context(task: str, budget: int | None = None) -> Query:
    return lambda spark, d: pack.context(_t(spark, d), "builder", task, NOW, budget, indexes=_indexes(spark, d)).transform(_said)


def brief_pack(spark, d):
    return pack.brief(_t(spark, d), "@builder", NOW, DAY).transform(_said)


def lexical_relevance(spark, d):
    m = prepared(pack.memory_rows(table(spark, d, "memories")))
    return m.selectExpr("id", f"round({lexical(task_terms(SIGNAL_TASK))}, 6) AS lexical")


def floor_and_tail(spark, d):
    m = prepared(pack.memory_rows(table(spark, d, "memories")))
    signal, plain = task_terms(SIGNAL_TASK), task_terms(TASK)
    return m.selectExpr("id", f"round({floor_relevance(signal)}, 6) AS signal_floor", f"round({floor_relevance(plain)}, 6) AS plain_floor", f"{tail_strong(signal)} AS strong")


def _snapshots(spark, d):
    """Memories as the older snapshot, and the documents of a new read of all files: some titles are
    new, and some notes have another name."""
    hashed = content_hash(F.col("title"), F.col("body"), F.col("source_path"))
    old = table(spark, d, "memories").withColumn("content_hash", hashed)
    new = old.withColumns({
        "title": F.when(F.length("body") % 5 == 0, F.concat("title", F.lit(" (new)"))).otherwise(F.col("title")),
        "name": F.when(F.length("body") % 7 == 0, F.concat("name", F.lit("-moved"))).otherwise(F.col("name")),
    })
    docs = new.select("name", "title", "body", "owner", "scope", "source_path", hashed.alias("content_hash"), "is_lock", F.lit(0).alias("ordinal"))
    return old, docs


def upsert_snapshot(spark, d):
    old, docs = _snapshots(spark, d)
    return mutate.upsert_memories(old, docs, "2026-06-10T00:00:00+00:00").select("id", "name", "title", "status", "created_at", "updated_at")


def archive_absent(spark, d):
    old, docs = _snapshots(spark, d)
    return mutate.archive_absent(old, docs.where("source_path is not null"), docs.select("source_path")).select("id", "status")


def episodes_dedup(spark, d):
    e = table(spark, d, "episodes")
    again = e.withColumn("summary", F.when(F.length("summary") % 2 == 0, F.concat("summary", F.lit(" (again)"))).otherwise(F.col("summary")))
    return mutate.insert_new_episodes(e, again).select("id", "ts", "actor", "kind", "summary")


def seed_recalls(spark, d):
    return mutate.seed_recalls(table(spark, d, "recall_events"), table(spark, d, "memories")).select("memory_id", "queried_by", "query_scope", "ts")


def promote_snapshot(spark, d):
    m, _ = mutate.promote(table(spark, d, "memories"), table(spark, d, "episodes"), 8, "os", "operator", "2026-06-10T00:00:00+00:00")
    return m.select("id", "scope", "updated_at")


def promote_audit(spark, d):
    _, audit = mutate.promote(table(spark, d, "memories"), table(spark, d, "episodes"), 8, "os", "operator", "2026-06-10T00:00:00+00:00")
    return audit


def slugify_titles(spark, d):
    return table(spark, d, "memories").select("id", slugify(F.col("title")).alias("slug"))


def title_tokens(spark, d):
    m = table(spark, d, "memories").select("id", F.explode(index_tokens(F.col("title"))).alias("token"))
    return m.groupBy("token").agg(F.countDistinct("id").alias("n_memories"))


def content_hashes(spark, d):
    return table(spark, d, "memories").select("id", content_hash(F.col("title"), F.col("body"), F.col("source_path")).alias("hash"))


def markdown_sections(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("text"))
    return parse.sections(docs).select("key", "ordinal", "title", F.length("body").cast("bigint").alias("n_body"), "is_lock")


def frontmatter_notes(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    return parse.frontmatter(docs).select("key", "name", "title", F.length("body").cast("bigint").alias("n_body"))


def episode_lines(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    return parse.first_lines(docs).select("key", F.col("ordinal").cast("bigint").alias("ordinal"), "line")


def team_log_lines(spark, d):
    docs = table(spark, d, "documents").where("source = 'team-log'").select(F.col("doc_id").alias("key"), "text")
    return parse.log_lines(docs).select("key", F.col("ordinal").cast("bigint").alias("ordinal"), "actor", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), "line")


def dated_notes(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    return parse.headers(docs)


def scope_classification(spark, d):
    m = table(spark, d, "memories")
    return m.select("id", parse.scope_of(F.lower("name"), F.col("body")).alias("guess"))


def owner_of_path(spark, d):
    return table(spark, d, "memories").select("id", parse.owner_of(F.col("source_path"), ["planner", "engineer", "archivist"]).alias("guess"))


STAMP = "2026-06-10T00:00:00+00:00"


def _files(spark, d, place):
    """The documents as files that were just read: a path (SQL) and a time for each."""
    return table(spark, d, "documents").where("text is not null").selectExpr(f"{place} AS key", "timestamp_seconds(1767225600 + doc_id) AS at", "text")


def handoff_lines(spark, d):
    """Episodes of dated files; a third each has its time in the name, its day in the name, and neither."""
    files = _files(spark, d, "concat('/w/handoffs/', CASE doc_id % 3 WHEN 0 THEN '20250614T0910Z-' WHEN 1 THEN '20250615-' ELSE '' END, 'note-', doc_id, '.md')")
    return ingest.episode_rows(files, "handoff", EngineConfig()).select("source_path", "ts", "actor", "kind", "summary", "scope")


def agent_notes(spark, d):
    """Memory documents of agents' folders."""
    files = _files(spark, d, "concat('/w/memory/', coalesce(lang, 'none'), '/note_', doc_id, '.md')")
    return ingest.note_docs(files, EngineConfig(), True).select("source_path", "name", "title", "owner", "scope", "content_hash", "seen_at")


def latest_documents(spark, d):
    """The last note of each owner and scope, in order of path and place."""
    m = table(spark, d, "memories").select("id", F.concat_ws("/", "owner", "scope").alias("name"), "source_path", F.col("id").alias("ordinal"))
    return mutate.latest_docs(m).select("name", "id")


def remember_row(spark, d):
    return mutate.remember(table(spark, d, "future_items"), "renew the key", "2026-07-01", READER, STAMP)


def finished_items(spark, d):
    return mutate.finish(table(spark, d, "future_items"), 1).select("id", "status")


def missed_row(spark, d):
    return mutate.missed(table(spark, d, "episodes"), "where is the almanac", READER, STAMP)


def reset_counts(spark, d):
    return mutate.reset_counts(_t(spark, d))


def reset_kept(spark, d):
    """What survives a reset, by table."""
    kept = mutate.kept_on_reset(_t(spark, d))
    rows = [kept[n].select(F.lit(n).alias("tbl"), F.to_json(F.struct("*")).alias("_row")).distinct() for n in sorted(kept)]
    return reduce(DataFrame.unionByName, rows).groupBy("tbl").agg(F.count("*").alias("n"))


def scopes_map(spark, d):
    """The counts per scope in their one-row form, entry by entry."""
    return report.counts_map(table(spark, d, "memories"), "scope").select(F.explode("by_scope").alias("scope", "n"))


def bm25_appended(spark, d):
    """Scores from an index whose archived memories were appended to the others."""
    m = table(spark, d, "memories").select("id", *se.MEMORY, "status")
    parts = [TextIndex.over(m.where(w), se.MEMORY, written) for w in ("status <> 'archived'", "status = 'archived'")]
    both = TextIndex(parts[0].terms.unionByName(parts[1].terms), parts[0].sizes.unionByName(parts[1].sizes), se.MEMORY)
    return both.hits(search_terms(OR_QUERY))


QUERIES: dict[str, Query] = {
    "search_ranked_and": _search(AND_QUERY),
    "search_ranked_or": _search(OR_QUERY),
    "search_single_term": _search(ONE_TERM),
    "search_owner_filter": _search(ONE_TERM, owner="agent:planner"),
    "search_include_archived": _search(ONE_TERM, archived=True, limit=50),
    "search_product_scope": _search("cooling release", "product:notebook"),
    "search_os_scope": _search("cooling release", "os"),
    "search_company_scope": _search("cooling release", "company", limit=40),
    "context_locks": _section(TASK, "active-lock"),
    "context_hot": _section(TASK, "hot-memory"),
    "context_pack": _context(TASK),
    "context_signal_pack": _context(SIGNAL_TASK, 40),
    "context_no_match": _context(NO_TASK),
    "context_no_terms": _context("what is the", 30),
    "timeline_range": _timeline("2025-03-01", "2025-03-31"),
    "timeline_day": _timeline(DAY, DAY),
    "timeline_open_end": _timeline("2026-01-01", None),
    "memories_by_scope": _counts("memories", "scope", ["id"]),
    "memories_by_owner": _counts("memories", "owner", ["id"]),
    "memories_by_status": _counts("memories", "status", ["id"]),
    "episodes_by_kind": _counts("episodes", "kind", ["id"]),
} | {
    f.__name__: f
    for f in (
        search_episodes_ranked, search_locks_ranked, ask_agent, search_recall_log, memory_relevance, bm25_raw, postings_size, match_floor, acl_visible_memories, activation_scores, hot_cold_counts, stats_scalars,
        timeline_all_forms, upcoming_all, upcoming_30_days, related_walk, related_by_name, wiki_targets, wiki_links_resolved, locks_active, locks_all_with_supersedes, locks_render_order, locks_restatus, prune_report,
        consolidation_candidates, higher_scope_counts, suggested_scope, last_recall, promotion_tiers, context_precedent, brief_pack, lexical_relevance, floor_and_tail, upsert_snapshot, archive_absent, episodes_dedup,
        seed_recalls, promote_snapshot, promote_audit, recalls_per_scope, consolidation_first, prune_first,
        handoff_lines, agent_notes, latest_documents, remember_row, finished_items, missed_row, reset_counts, reset_kept, scopes_map, bm25_appended, slugify_titles, title_tokens, content_hashes, markdown_sections, frontmatter_notes, episode_lines, team_log_lines, dated_notes, scope_classification, owner_of_path,
    )
}
