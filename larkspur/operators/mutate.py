"""Changes of state as pure functions from an old snapshot to a new one.

File tables have no row updates, so each change returns the frame of the next snapshot; the store
writes it as a new version. New ids follow the largest old one in a deterministic order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.locks import valid_scope

MEMORY = ["id", "name", "title", "body", "owner", "scope", "source_path", "content_hash", "is_lock", "status", "created_at", "updated_at"]
EPISODE_KEY = ["ts", "actor", "kind", "summary", "source_path"]


def numbered(rows: DataFrame, order: list[str], start: DataFrame, out: str = "id") -> DataFrame:
    """``rows`` with ids after ``start.top``, in ``order``.

    Numbers are given without one task seeing all rows: range-partition by the order, count per
    partition, and add each partition's offset (one row per partition) to its own row number.
    """
    from larkspur.session import cut

    parts = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # one row per partition
    offsets = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    top = start.select(F.coalesce(F.col("top"), F.lit(0)).alias("_top"))
    return parts.withColumn("_k", own).join(F.broadcast(offsets), "_p").crossJoin(F.broadcast(top)).withColumn(out, (F.col("_top") + F.col("_before") + F.col("_k")).cast("bigint")).drop("_p", "_k", "_before", "_top")


def latest_docs(docs: DataFrame) -> DataFrame:
    """The last document of each name in order of path and place: what a sequential read would leave."""
    w = Window.partitionBy("name").orderBy(F.desc_nulls_last("source_path"), F.desc("ordinal"))
    return docs.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert_memories(old: DataFrame, docs: DataFrame, now: str) -> DataFrame:
    """The memories after reading ``docs`` (name, title, body, owner, scope, source_path, content_hash,
    is_lock, ordinal).

    A name that is not stored is added. A stored one changes, all but id and created_at, if its
    hash differs or it was archived, and becomes hot; else its row stays as it is.
    """
    new = latest_docs(docs).select(*[F.col(c).alias(f"n_{c}") for c in ("name", "title", "body", "owner", "scope", "source_path", "content_hash", "is_lock")])
    j = old.select(*MEMORY).join(new, F.col("name") == F.col("n_name"), "left")
    change = F.col("n_name").isNotNull() & (~F.col("content_hash").eqNullSafe(F.col("n_content_hash")) | (F.col("status") == "archived"))
    take = lambda c: F.when(change, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    kept = j.select(
        "id", "name", *[take(c) for c in ("title", "body", "owner", "scope", "source_path", "content_hash", "is_lock")], F.when(change, "hot").otherwise(F.col("status")).alias("status"), "created_at",
        F.when(change, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    names = old.select(F.col("name").alias("o_name"))
    fresh = new.join(names, F.col("n_name") == F.col("o_name"), "left_anti").select(*[F.col(f"n_{c}").alias(c) for c in ("name", "title", "body", "owner", "scope", "source_path", "content_hash", "is_lock")])
    added = numbered(fresh, ["source_path", "name"], old.agg(F.max("id").alias("top"))).select(
        "id", "name", "title", "body", "owner", "scope", "source_path", "content_hash", "is_lock", F.lit("hot").alias("status"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at")
    )
    return kept.unionByName(added)


def archive_absent(memories: DataFrame, docs: DataFrame, read_paths: DataFrame) -> DataFrame:
    """Archives what a file that was read again no longer holds. Files not read touch nothing."""
    paths = read_paths.where("source_path is not null").select(F.col("source_path").alias("r_path")).distinct()
    there = docs.select(F.col("source_path").alias("d_path"), F.col("name").alias("d_name")).distinct()
    gone = memories.join(paths, F.col("source_path") == F.col("r_path"), "left_semi").join(there, (F.col("source_path") == F.col("d_path")) & (F.col("name") == F.col("d_name")), "left_anti")
    ids = gone.where("status <> 'archived'").select(F.col("id").alias("g_id"))
    return memories.join(ids, F.col("id") == F.col("g_id"), "left").withColumn("status", F.when(F.col("g_id").isNotNull(), "archived").otherwise(F.col("status"))).drop("g_id")


def insert_new_episodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` rows whose (ts, actor, kind, summary, source_path) is neither stored nor an earlier row
    of ``new``. As in a unique index, rows with a null in the key never clash; of exact deliveries of
    one row one is kept."""
    rows = new.dropDuplicates()
    keyed = rows.dropna(subset=EPISODE_KEY)
    loose = rows.where(" OR ".join(f"{k} is null" for k in EPISODE_KEY))
    first = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy(*EPISODE_KEY).orderBy("id"))).where("_rn = 1").drop("_rn")
    known = old.select(*[F.col(k).alias(f"o_{k}") for k in EPISODE_KEY]).distinct()
    fresh = first.join(known, [F.col(k) == F.col(f"o_{k}") for k in EPISODE_KEY], "left_anti")
    return fresh.unionByName(loose)


def seed_recalls(recalls: DataFrame, memories: DataFrame, at: Column | None = None) -> DataFrame:
    """A first recall for each memory that has none: by the ingest, in its own scope, at its file's time."""
    known = recalls.where("memory_id is not null").select(F.col("memory_id").alias("k_id")).distinct()
    return memories.join(known, F.col("id") == F.col("k_id"), "left_anti").select(
        F.col("id").alias("memory_id"), F.lit("system:ingest").alias("queried_by"), F.col("scope").alias("query_scope"), (F.col("updated_at") if at is None else at).alias("ts")
    )


def promote(memories: DataFrame, episodes: DataFrame, memory_id: int, to_scope: str, by: str, now: str) -> tuple[DataFrame, DataFrame | None]:
    """The memories with one moved to another scope, and the audit row to append (None if it was there).

    Refuses unknown ids, bad scopes, locks, and moves the mover's tier does not allow.
    """
    by = by.strip().lower()
    if not valid_scope(to_scope):
        raise ValueError("a scope is os, company or product:<slug>")
    row = memories.where(F.col("id") == memory_id).select("id", "name", "title", "owner", "scope", "is_lock", "source_path").first()
    if row is None:
        raise ValueError(f"there is no memory {memory_id}")
    if row.scope == to_scope:
        return memories, None
    if row.is_lock:
        raise ValueError(f"memory {memory_id} is a lock; locks are superseded, not promoted")
    swap = (row.scope == "company" and to_scope.startswith("product:")) or (row.scope.startswith("product:") and to_scope == "company")
    if by != "operator" and not (by == "curator" and swap):
        raise ValueError(f"{by} may not move memory {memory_id} from {row.scope} to {to_scope}")
    here = F.col("id") == memory_id
    moved = memories.withColumn("scope", F.when(here, F.lit(to_scope)).otherwise(F.col("scope"))).withColumn("updated_at", F.when(here, F.lit(now)).otherwise(F.col("updated_at")))
    said = f"memory_id={row.id} owner={row.owner} title={row.title} from_scope={row.scope} to_scope={to_scope}"
    audit = memories.sparkSession.createDataFrame(
        [(now, by, "promotion", f"{row.scope} -> {to_scope}: {row.name}", said, to_scope, row.source_path)], "ts string, actor string, kind string, summary string, body string, scope string, source_path string"
    )
    return moved, audit


def remember(future: DataFrame, text: str, due: str, by: str, now: str) -> DataFrame:
    """The row to append for a new open item."""
    top = future.agg(F.max("id").alias("top"))
    return top.select((F.coalesce("top", F.lit(0)) + 1).alias("id"), F.lit(text).alias("body"), F.lit(due).alias("due"), F.lit(by).alias("created_by"), F.lit("open").alias("status"), F.lit(now).alias("created_at"))


def finish(future: DataFrame, item: int, drop: bool = False) -> DataFrame:
    """The items with one closed; only an open one changes, an unknown id is an error."""
    if future.where(F.col("id") == item).isEmpty():
        raise ValueError(f"there is no item {item}")
    state = F.when((F.col("id") == item) & (F.col("status") == "open"), F.lit("dropped" if drop else "done")).otherwise(F.col("status"))
    return future.withColumn("status", state)


def missed(episodes: DataFrame, what: str, by: str, now: str) -> DataFrame:
    """The episode row to append for something the engine did not find."""
    top = episodes.agg(F.max("id").alias("top"))
    return top.select(
        (F.coalesce("top", F.lit(0)) + 1).alias("id"), F.lit(now).alias("ts"), F.lit(by).alias("actor"), F.lit("miss").alias("kind"), F.lit(what).alias("summary"), F.lit(what).alias("body"), F.lit("company").alias("scope"), F.lit("").alias("source_path")
    )


def kept_on_reset(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What survives a reset, ids included: due items, misses and the access list; the rest is empty."""
    keep = {"future_items": None, "node_acl": None, "episodes": "kind = 'miss'"}
    return {n: (df if keep[n] is None else df.where(keep[n])) if n in keep else df.limit(0) for n, df in tables.items()}


def reset_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: what a reset keeps, and how many audits of promotions it drops: these are nowhere else."""
    kinds = tables["episodes"].select("id", "kind").distinct()
    parts = [
        tables["future_items"].agg(F.count("*").alias("future_items_kept")),
        tables["node_acl"].agg(F.count("*").alias("access_rows_kept")),
        kinds.agg(F.count_if(F.col("kind") == "miss").alias("misses_kept"), F.count_if(F.col("kind") == "promotion").alias("promotion_audits_dropped")),
    ]
    return parts[0].crossJoin(F.broadcast(parts[1])).crossJoin(F.broadcast(parts[2]))  # one row each
