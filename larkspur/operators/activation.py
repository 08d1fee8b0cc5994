"""Power-law decay of recalls, and the warm / cold split it gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.sessions import RFC3339


def instant(ts: Column) -> Column:
    """The timestamp of an RFC 3339 string, null where unreadable."""
    return F.when(ts.rlike(RFC3339), F.try_to_timestamp(F.upper(ts)))


def clean_recalls(recalls: DataFrame, *columns: str) -> DataFrame:
    """``id, memory_id, ts`` and the named columns, each recall once; a delivery again has the same id,
    memory and time."""
    return recalls.select("id", "memory_id", "ts", *columns).distinct()


def decayed(ts: Column, now: str, decay: float) -> Column:
    """age_days ** -decay of a recall, null where its time is not readable. Ages count whole seconds,
    one at least."""
    age = F.greatest(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(instant(ts)), F.lit(1)) / F.lit(86400.0)
    return F.when(instant(ts).isNotNull(), F.pow(age, F.lit(-decay)))


def activation_scores(recalls: DataFrame, now: str, decay: float = 0.5) -> DataFrame:
    """``memory_id, activation``: ln of the sum of age_days ** -decay, to 6 digits.

    Recalls without a readable time or memory are skipped; a memory without any recall has no row
    (never join before aggregating: the age of nothing is not one second). Times are read before
    recalls are compared, so only numbers are shuffled; the sums are partial before their shuffle,
    whatever share of the recalls one memory has.
    """
    each = recalls.where("memory_id is not null").select("id", "memory_id", decayed(F.col("ts"), now, decay).alias("part")).where("part is not null").distinct()
    return each.groupBy("memory_id").agg(F.round(F.ln(F.sum("part")), 6).alias("activation"))


def with_activation(memories: DataFrame, recalls: DataFrame, now: str, decay: float = 0.5) -> DataFrame:
    scores = activation_scores(recalls, now, decay).withColumnRenamed("memory_id", "_recalled")
    return memories.join(scores, F.col("id") == F.col("_recalled"), "left").drop("_recalled")


def is_hot(lock: Column, activation: Column, threshold: float = -1.6) -> Column:
    return lock | F.coalesce(activation >= threshold, F.lit(False))


def hot_cold_counts(memories: DataFrame, recalls: DataFrame, now: str, decay: float = 0.5, threshold: float = -1.6) -> DataFrame:
    """``hot, cold``: one row over the memories that are not archived."""
    m = with_activation(memories.where("status <> 'archived'").select("id", "is_lock"), recalls, now, decay)
    hot = is_hot(F.col("is_lock") == 1, F.col("activation"), threshold)
    return m.agg(F.count_if(hot).alias("hot"), F.count_if(~hot).alias("cold"))
