"""References whose target does not exist, by a skew-aware split.

References are pre-aggregated per (table, target, key, period), with partial sums before the
shuffle, so a key named by a third of all rows is a few rows afterwards. The keys named most often
(``HEAVY`` of them, an exact size bound) are checked apart with a broadcast list, the rest by a
shuffled anti-join of the aggregates; the counts are sums over both, and the single records are
found by a semi-join with the dead keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.timestamps import month_of
from larkspur.session import cut

#: Most keys that are treated as heavy, so the longest broadcast list.
HEAVY = 1000


def references(rows: DataFrame, tbl: str, key_col, target, ref_key, period) -> DataFrame:
    """``tbl, target, ref_key, missing_id, period`` of the rows whose key is not null."""
    return rows.select(F.lit(tbl).alias("tbl"), target.alias("target"), ref_key.cast("string").alias("ref_key"), key_col.cast("bigint").alias("missing_id"), period.alias("period")).where("missing_id is not null and target is not null")


KEY = ["target", "missing_id"]


def dead_references(counted: DataFrame, targets: DataFrame, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``counted`` (target, missing_id, n, ...: references per key and whatever else)
    whose key names no row of ``targets`` (target, id): those of heavy keys and
    the others; and the list of all heavy keys, h_target and h_id, at most ``heavy`` rows.

    Null ids in ``targets`` match nothing; nothing is dropped for being heavy.
    """
    there = targets.select(F.col("target").alias("t_target"), F.col("id").alias("t_id"))
    named = [F.col("target") == F.col("t_target"), F.col("missing_id") == F.col("t_id")]
    top = cut(counted.groupBy(*KEY).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), *KEY).limit(heavy).select(F.col("target").alias("h_target"), F.col("missing_id").alias("h_id")))
    is_heavy = [F.col("target") == F.col("h_target"), F.col("missing_id") == F.col("h_id")]
    # heavy keys: find those that exist by passing the targets by the list
    alive = there.join(F.broadcast(top), [F.col("t_target") == F.col("h_target"), F.col("t_id") == F.col("h_id")], "left_semi").distinct()
    dead = cut(top.join(alive, [F.col("h_target") == F.col("t_target"), F.col("h_id") == F.col("t_id")], "left_anti"))
    lost_heavy = counted.join(F.broadcast(dead), is_heavy, "left_semi")
    lost_light = counted.join(F.broadcast(top), is_heavy, "left_anti").join(there, named, "left_anti")
    return lost_heavy, lost_light, top


def table_references(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """References and targets of recall_events.memory_id, locks.supersedes and links.to_id.

    A link's target table is the one its to_kind names; a null or unknown to_kind names no table
    of ours, so such a link is not judged.
    """
    ev, lo, li = tables["recall_events"], tables["locks"], tables["links"]
    none = F.lit(None).cast("string")
    kinds = {"memory": "memories", "episode": "episodes", "lock": "locks"}
    to_table = reduce(lambda c, kv: c.when(F.col("to_kind") == kv[0], F.lit(kv[1])), list(kinds.items())[1:], F.when(F.col("to_kind") == "memory", F.lit("memories")))
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("from_kind", "from_id", "to_kind", "to_id", "kind")]
    refs = (
        references(ev, "recall_events", F.col("memory_id"), F.lit("memories"), F.col("id"), month_of("ts"))
        .unionByName(references(lo, "locks", F.col("supersedes"), F.lit("locks"), F.col("id"), month_of("locked_on")))
        .unionByName(references(li, "links", F.col("to_id"), to_table, F.concat_ws(":", *shown), none))
    )
    ids = [tables[t].select(F.lit(t).alias("target"), F.col("id").cast("bigint").alias("id")).where("id is not null") for t in ("memories", "episodes", "locks")]
    return refs, reduce(DataFrame.unionByName, ids)


def orphan_references(tables: dict[str, DataFrame], heavy: int = HEAVY) -> DataFrame:
    """``tbl, ref_key, missing_id``: one row per record with an orphan reference, repeated rows once."""
    refs, targets = table_references(tables)
    refs = refs.drop("period")
    counted = cut(refs.groupBy(*KEY).agg(F.count("*").alias("n")))
    lost_heavy, lost_light, top = dead_references(counted, targets, heavy)
    of_heavy = refs.join(F.broadcast(lost_heavy.select(*KEY)), KEY, "left_semi")
    light = refs.join(F.broadcast(top), [F.col("target") == F.col("h_target"), F.col("missing_id") == F.col("h_id")], "left_anti")
    of_light = light.join(lost_light.select(*KEY), KEY, "left_semi")
    return of_heavy.unionByName(of_light.select(*of_heavy.columns)).select("tbl", "ref_key", "missing_id").distinct()


def orphan_counts(tables: dict[str, DataFrame], heavy: int = HEAVY) -> DataFrame:
    """``tbl, period, n_orphans``: orphan references per table and month (UTC, ``yyyy-MM``).

    ``period`` is null where the table has no time (links) or the row's time is not readable.
    Records delivered twice count once.
    """
    refs, targets = table_references(tables)
    counted = cut(refs.distinct().groupBy("tbl", *KEY, "period").agg(F.count("*").alias("n")))
    lost_heavy, lost_light, _ = dead_references(counted, targets, heavy)
    return lost_heavy.unionByName(lost_light).groupBy("tbl", "period").agg(F.sum("n").alias("n_orphans"))
