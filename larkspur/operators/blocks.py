"""All pairs of a group's members as tasks of bounded size, however large the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of a group that meet in one task.
BLOCK = 1000


def block_of(member: Column, n: Column, block: int = BLOCK) -> Column:
    """The block (from 0) of a member of a group of ``n``."""
    return F.pmod(F.xxhash64(member), F.ceil(n / block))


def pairs_within(rows: DataFrame, group: list[str], member: str, n: str, block: int = BLOCK) -> DataFrame:
    """``group, x, y``: every two different members (x < y) of each group; ``n`` is the group's size.

    A group is cut into blocks and each pair of blocks is a join key of its own. Rows are distinct.
    """
    last = F.ceil(F.col(n) / block) - 1
    each = rows.select(*group, F.col(member).alias("m"), block_of(F.col(member), F.col(n), block).alias("k"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("o"))
    left = each.where("k <= o").select(*group, F.col("k").alias("bx"), F.col("o").alias("by"), F.col("m").alias("p"))
    right = each.where("k >= o").select(*group, F.col("o").alias("bx"), F.col("k").alias("by"), F.col("m").alias("q"))
    met = left.join(right, [*group, "bx", "by"]).where("p <> q and (bx < by or p < q)")
    return met.select(*group, F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))
