"""Queries of the general data problems (2 to 5) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.timestamps import ABBREVIATIONS, normalised_tables, restamp_tables
from larkspur.functions.zones import database_version
from larkspur.operators.hierarchy import descendant_rows, hierarchy
from larkspur.operators.orphans import orphan_counts, orphan_references
from larkspur.operators.sessions import instant_ms, sessionise
from larkspur.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _tables(spark: SparkSession, d: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in names}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "locks"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """One row per lock and descendant."""
    return descendant_rows(table(spark, d, "locks"))


def p2_back_edges(spark: SparkSession, d: str) -> DataFrame:
    """``circle_id, n_back_edges``: circles by their smallest id, with the back edges met in the walk."""
    full = hierarchy(table(spark, d, "locks"), full=True)
    return full.where("shape = 'cycle'").groupBy(F.col("root_id").alias("circle_id")).agg(F.count("back_edge_to").alias("n_back_edges"), F.count("*").alias("n_nodes"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return restamp_tables(_tables(spark, d, "episodes", "memories", "locks", "source_roots"))


def p3_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its instant (null if unreadable) and the release of the zone tables."""
    return normalised_tables(_tables(spark, d, "episodes", "memories", "locks", "source_roots")).withColumn("zone_tables", F.lit(database_version()))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "recall_events").select("id", "queried_by", "query_scope", instant_ms(F.col("ts")).alias("ms"))
    return sessionise(e, ["queried_by", "query_scope"], "id", "ms")


def p4_durations(spark: SparkSession, d: str) -> DataFrame:
    """Sessions per agent: number, events, and total and longest duration in milliseconds."""
    s = p4_found(spark, d).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
    return s.groupBy("queried_by").agg(F.count("*").alias("n_sessions"), F.sum("n_events").alias("n_events"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("longest_ms"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(_tables(spark, d, "recall_events", "locks", "links", "memories", "episodes"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(_tables(spark, d, "recall_events", "locks", "links", "memories", "episodes"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_descendants, p2_back_edges, p3_found, p3_normalised, p4_found, p4_durations, p5_found, p5_counts)}

_TREE = """
WITH RECURSIVE n AS (SELECT DISTINCT id, supersedes, slug FROM locks WHERE id IS NOT NULL),
e AS (SELECT a.id, b.id AS parent, a.slug FROM n a LEFT JOIN n b ON a.supersedes = b.id),
t AS (SELECT id, id AS root_id, 0::BIGINT AS depth, slug AS slug_path FROM e WHERE parent IS NULL
      UNION ALL SELECT e.id, t.root_id, t.depth + 1, t.slug_path || '/' || e.slug FROM e JOIN t ON e.parent = t.id)"""
_ANC = """,
anc AS (SELECT id, parent AS a FROM e WHERE parent IS NOT NULL
        UNION SELECT anc.id, e.parent FROM anc JOIN e ON anc.a = e.id WHERE e.parent IS NOT NULL)"""
_RING = """,
ring AS (SELECT id FROM anc WHERE id = a),
ringmin AS (SELECT x.id, min(y.a) AS m FROM ring x JOIN anc y ON y.id = x.id GROUP BY x.id)"""
_SESSIONS = r"""
WITH e AS (SELECT DISTINCT id, queried_by, query_scope, epoch_ms(TRY_CAST(ts AS TIMESTAMPTZ)) AS ms FROM recall_events
           WHERE queried_by IS NOT NULL AND query_scope IS NOT NULL AND regexp_full_match(ts, '\d{4}-\d{2}-\d{2}T.*')),
f AS (SELECT *, CASE WHEN ms - lag(ms) OVER w < 1800000 THEN 0 ELSE 1 END AS new_one FROM e WHERE ms IS NOT NULL
      WINDOW w AS (PARTITION BY queried_by, query_scope ORDER BY ms, id)),
g AS (SELECT *, sum(new_one) OVER (PARTITION BY queried_by, query_scope ORDER BY ms, id ROWS UNBOUNDED PRECEDING) AS k FROM f),
s AS (SELECT queried_by, query_scope, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS n_events FROM g GROUP BY queried_by, query_scope, k)"""
_ORPHANS = """
SELECT DISTINCT 'recall_events' AS tbl, CAST(id AS VARCHAR) AS ref_key, memory_id AS missing_id FROM recall_events
WHERE memory_id IS NOT NULL AND memory_id NOT IN (SELECT id FROM memories)
UNION SELECT 'locks', CAST(id AS VARCHAR), supersedes FROM locks WHERE supersedes IS NOT NULL AND supersedes NOT IN (SELECT id FROM locks)
UNION SELECT 'links', concat_ws(':', from_kind, from_id, to_kind, to_id, kind), to_id FROM links
WHERE to_id IS NOT NULL AND ((to_kind = 'memory' AND to_id NOT IN (SELECT id FROM memories)) OR (to_kind = 'episode' AND to_id NOT IN (SELECT id FROM episodes))
                             OR (to_kind = 'lock' AND to_id NOT IN (SELECT id FROM locks)))"""

_LOCAL = ["%Y-%m-%d", "%Y%m%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d %I:%M %p", "%Y%m%dT%H%M%SZ", "%Y/%m/%d", "%Y/%m/%d %H:%M:%S", "%B %d, %Y", "%B %d, %Y %H:%M:%S", "%d %b %Y", "%d %b %Y %H:%M:%S", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S UTC"]
_OFFSET = ["%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%d %H:%M:%S%z", "%Y-%m-%dT%H:%M:%S,%g %z", "%Y-%m-%dT%H:%M:%S.%g%z", "%Y-%m-%d %H:%M %z", "%Y-%m-%d %H:%M:%S %z", "%Y-%m-%dT%H:%M:%S %z"]
_STAMP = "upper(trim(locked_on))"
for _name, _minutes in ABBREVIATIONS.items():
    _STAMP = f"regexp_replace({_STAMP}, ' {_name.upper()}$', ' {'-' if _minutes < 0 else '+'}{abs(_minutes) // 60:02}{abs(_minutes) % 60:02}')"

ORACLES: dict[str, str] = {
    "p2_found": _TREE + _ANC + _RING + """
SELECT id, 'tree' AS shape, root_id, depth, slug_path, (SELECT count(*) FROM anc WHERE anc.a = t.id) AS n_desc FROM t
UNION ALL SELECT id, 'cycle', m, -1, '', -1 FROM ringmin
UNION ALL SELECT anc.id, 'tail', min(r.m), -1, '', -1 FROM anc JOIN ringmin r ON anc.a = r.id WHERE anc.id NOT IN (SELECT id FROM ring) GROUP BY anc.id""",
    "p2_descendants": _TREE + _ANC + " SELECT anc.a AS id, anc.id AS descendant_id FROM anc JOIN t ON t.id = anc.a",
    "p2_back_edges": _TREE + _ANC + _RING + " SELECT m AS circle_id, 1::BIGINT AS n_back_edges, count(*) AS n_nodes FROM ringmin GROUP BY m",
    "p4_found": _SESSIONS + " SELECT * FROM s",
    "p4_durations": _SESSIONS + """ SELECT queried_by, count(*) AS n_sessions, CAST(sum(n_events) AS BIGINT) AS n_events,
CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms, max(end_ms - start_ms) AS longest_ms FROM s GROUP BY queried_by""",
    "p5_found": _ORPHANS,
    # lock stamps of the written forms, all in UTC unless they name an offset
    "p5_counts": f"""WITH o AS ({_ORPHANS}),
t AS (SELECT 'recall_events' AS tbl, CAST(id AS VARCHAR) AS ref_key, CASE WHEN regexp_full_match(ts, '\\d{{4}}-\\d{{2}}-\\d{{2}}T.*') THEN TRY_CAST(ts AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END AS stamp FROM recall_events
      UNION SELECT 'locks', CAST(id AS VARCHAR), coalesce(try_strptime({_STAMP}, {_LOCAL}), try_strptime({_STAMP}, {_OFFSET}) AT TIME ZONE 'UTC') FROM locks)
SELECT tbl, strftime(stamp, '%Y-%m') AS period, count(*) AS n_orphans FROM o LEFT JOIN t USING (tbl, ref_key) GROUP BY ALL""",
}
