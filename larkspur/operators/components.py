"""Connected components of an undirected edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import cut


def _to_roots(step: DataFrame, keys: list[str]) -> DataFrame:
    """Follows labels to their end by doubling; a label is a node with a smaller id, so there are no circles."""
    while True:
        up = step.select(*[F.col(k).alias(f"u_{k}") for k in keys], F.col("id").alias("u_id"), F.col("component").alias("u_to"))
        j = step.join(up, [*[F.col(k) == F.col(f"u_{k}") for k in keys], F.col("component") == F.col("u_id")], "left")
        new = cut(j.select(*keys, "id", F.coalesce("u_to", "component").alias("component"), (F.col("u_to") != F.col("component")).alias("moved")))
        if new.where("moved").isEmpty():
            return new.drop("moved")
        step = new.drop("moved")


def connected_components(edges: DataFrame, keys: list[str] | None = None, rounds: int = 100) -> DataFrame:
    """``keys, id, component``: for each node of ``edges`` (keys, src, dst) the smallest id it is linked to.

    ``keys`` keep graphs apart. Each round contracts the graph: every node takes the smallest label
    of its neighbours, labels are followed to their roots by doubling, and the edges move to the
    roots, so each round at least halves a component and a chain needs one. Edges with a null end are ignored, loops keep their node, repeated edges count once.
    """
    keys = keys or []
    link = edges.select(*keys, "src", "dst").where("src is not null and dst is not null").distinct()
    both = link.unionByName(link.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")))
    label = _to_roots(both.groupBy(*keys, F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("component")), keys)
    work = cut(link.where("src <> dst"))
    step = label
    for _ in range(rounds):
        # edges between labels; nodes of the contracted graph are labels
        s = step.select(*[F.col(k).alias(f"s_{k}") for k in keys], F.col("id").alias("s_id"), F.col("component").alias("s_to"))
        d = step.select(*[F.col(k).alias(f"d_{k}") for k in keys], F.col("id").alias("d_id"), F.col("component").alias("d_to"))
        moved = (
            work.join(s, [*[F.col(k) == F.col(f"s_{k}") for k in keys], F.col("src") == F.col("s_id")])
            .join(d, [*[F.col(k) == F.col(f"d_{k}") for k in keys], F.col("dst") == F.col("d_id")])
            .select(*keys, F.col("s_to").alias("src"), F.col("d_to").alias("dst"))
        )
        work = cut(moved.where("src <> dst").distinct())
        if work.isEmpty():
            break
        both = work.unionByName(work.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")))
        step = _to_roots(both.groupBy(*keys, F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("component")), keys)
        up = step.select(*[F.col(k).alias(f"u_{k}") for k in keys], F.col("id").alias("u_id"), F.col("component").alias("u_to"))
        label = cut(
            label.join(up, [*[F.col(k) == F.col(f"u_{k}") for k in keys], F.col("component") == F.col("u_id")], "left").select(*keys, "id", F.coalesce("u_to", "component").alias("component"))
        )
    return label
