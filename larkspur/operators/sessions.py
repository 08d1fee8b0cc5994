"""Gap-based sessions by pointer doubling over events, without a window or a sort over a key.

Time is cut into cells as wide as the gap, so two events of one key and cell are always in one
session: they are contracted to a node by a hash aggregate, with partial sums before the shuffle,
whether a cell holds one event or a burst of a third of all rows. The predecessor of a node within
the gap can only lie in the cell before. These links are the pointers; they double by self-joins
until every node points at the first node of its session, and the session aggregates its nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import cut

#: RFC 3339 with an explicit offset, whole seconds or a fraction.
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def instant_ms(ts):
    """Milliseconds since 1970 UTC of an RFC 3339 string column; null where unreadable."""
    return F.when(ts.rlike(RFC3339), F.unix_millis(F.try_to_timestamp(F.upper(ts))))


def nodes(events: DataFrame, keys: list[str], id_col: str, ms_col: str, gap_ms: int) -> DataFrame:
    """``keys, cell, lo, hi, n``: the events of a key in a cell of ``gap_ms``, each event once."""
    one = events.select(*keys, F.col(id_col).alias("eid"), F.col(ms_col).alias("ms")).dropna(subset=[*keys, "ms"]).distinct()
    cell = F.floor(F.col("ms") / F.lit(gap_ms)).cast("bigint")
    return one.groupBy(*keys, cell.alias("cell")).agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"), F.count("*").alias("n"))


def _with_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def roots_of(linked: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, cell, root``: the first cell reached from each linked node (keys, cell), whose pointer
    is the cell before; nodes that are not in ``linked`` are roots.

    After round k a pointer spans 2**k links. A node whose pointer is a root is settled and takes
    part in later rounds only as a target.
    """
    state = cut(linked.select(*keys, "cell", (F.col("cell") - 1).alias("ptr")))
    settled, active = [], state
    while True:
        jump = _with_prefix(state, "j_")
        moved = active.join(jump, [*[F.col(k) == F.col(f"j_{k}") for k in keys], F.col("ptr") == F.col("j_cell")], "left")
        new = cut(moved.select(*keys, "cell", F.coalesce("j_ptr", "ptr").alias("ptr"), F.col("j_ptr").isNotNull().alias("went")))
        settled.append(new.where("not went").select(*keys, "cell", "ptr"))
        active = new.where("went").select(*keys, "cell", "ptr")
        if active.isEmpty():
            break
        state = active
        for part in settled:
            state = state.unionByName(part)
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("ptr", "root")


def sessionise(events: DataFrame, keys: list[str], id_col: str, ms_col: str, gap_ms: int = 30 * 60_000) -> DataFrame:
    """``keys, start_ms, end_ms, n_events``: one row per session of a key.

    Neighbours of one key ``gap_ms`` or more apart belong to different sessions. Rows with a null
    in a key or in the time belong to none. Rows equal in key, time and id are one event delivered
    again (null ids compare as equal); different ids at one time all count. An empty input gives no
    rows. Other columns are ignored, whatever their names.
    """
    if gap_ms <= 0:
        raise ValueError("a gap is a positive number of milliseconds")
    node = cut(nodes(events, keys, id_col, ms_col, gap_ms))
    prev = node.select(*[F.col(k).alias(f"p_{k}") for k in keys], (F.col("cell") + 1).alias("p_next"), F.col("hi").alias("p_hi"))
    linked = node.join(prev, [*[F.col(k) == F.col(f"p_{k}") for k in keys], F.col("cell") == F.col("p_next"), F.col("lo") - F.col("p_hi") < gap_ms], "left_semi")
    found = _with_prefix(roots_of(linked, keys), "r_")
    rooted = node.join(found, [*[F.col(k) == F.col(f"r_{k}") for k in keys], F.col("cell") == F.col("r_cell")], "left")
    return (
        rooted.select(*keys, F.coalesce("r_root", "cell").alias("root"), "lo", "hi", "n")
        .groupBy(*keys, "root")
        .agg(F.min("lo").alias("start_ms"), F.max("hi").alias("end_ms"), F.sum("n").alias("n_events"))
        .select(*keys, "start_ms", "end_ms", "n_events")
    )
