"""The engine's verbs over a store: what the command line calls."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from larkspur.config import EngineConfig
from larkspur.functions.text import agent_name
from larkspur.operators import episodes as ep
from larkspur.operators import locks as lk
from larkspur.operators import mutate, pack, report
from larkspur.operators import search as se
from larkspur.operators.bm25 import TextIndex, index_sizes, index_terms
from larkspur.sources import ingest as ing
from larkspur.sources.guard import Guard
from larkspur.sources.roster import discover
from larkspur.sources.store import SCHEMAS, Change, Store


class Engine:
    """Reads are pure plans; every verb that changes something writes one new snapshot.

    ``now`` (RFC 3339, UTC) is given by the caller, so a run can be repeated.
    """

    def __init__(self, spark: SparkSession, root: str | Path, store: str | Path, guard: Guard, now: str, config: EngineConfig | None = None, extra: str | None = None, curator: str | None = None, read_only: bool = False):
        """Without a ``config`` the tunables are those the store was last ingested with."""
        self.spark, self.root, self.guard, self.now = spark, Path(root), guard, now
        self.store = Store(spark, str(store), read_only)
        self.config = config or EngineConfig().with_settings(self.store.manifest.get("settings", {}))
        self.extra, self.curator = extra, curator
        self.at = now[:19].replace("T", " ")

    @property
    def tables(self) -> dict[str, DataFrame]:
        return self.store.load()

    @property
    def lock_path(self) -> Path:
        return self.root / "system" / "locks.yaml"

    def indexes(self, t: dict[str, DataFrame]) -> se.Indexes:
        """The stored text indexes; a store from before them has none and searches the rows."""
        kinds = {"memory": se.MEMORY, "episode": se.EPISODE, "lock": se.LOCK}
        known = self.store.manifest["tables"]
        return {k: TextIndex(t[f"{k}_terms"], t["text_sizes"].where(F.col("kind") == k), w) for k, w in kinds.items() if f"{k}_terms" in known}

    def _index(self, change: Change, kind: str, rows: DataFrame, add: bool = False) -> DataFrame:
        """Stores the terms of ``rows``, all of a kind's or added ones, and gives the row for the sizes."""
        columns = list({"memory": se.MEMORY, "episode": se.EPISODE, "lock": se.LOCK}[kind])
        terms = (change.append if add else change.replace)(f"{kind}_terms", index_terms(rows, columns))
        return index_sizes(rows, terms, len(columns)).withColumn("kind", F.lit(kind))

    def _add_episodes(self, change: Change, rows: DataFrame) -> DataFrame:
        """Appends episodes and their terms."""
        added = change.append("episodes", rows)
        change.append("text_sizes", self._index(change, "episode", added, True))
        return added

    def ingest(self, source: str | None = None, reset: bool = False) -> dict:
        """Reads the workspace into one new version: upserts, archives, seeds, links, locks and indexes.

        With ``reset`` only due items, misses and the access list are kept first; the report says
        what else that drops. A file that can't be read is skipped and named in the report.
        """
        files, skipped = ing.readable_files(discover(self.root, self.guard, self.config, source, self.extra, self.curator))
        if not files and source != "lock-store":
            raise ValueError("no source file was found")
        before = self.tables
        t = mutate.kept_on_reset(before) if reset else before
        entries = ing.read_locks(self.lock_path) if self.guard.allows(self.lock_path) else []
        locks = self._locks(entries, t["locks"])
        docs, new = ing.parse_sources(self.spark, files, self.config)
        docs = docs.cache()
        change = self.store.begin()
        paths = self.spark.createDataFrame([(str(p.resolve()),) for p, s in ((p, s) for s, p in files) if s.kind in ("sections", "notes", "mixed")], "source_path string")
        memories = change.replace("memories", mutate.archive_absent(mutate.upsert_memories(t["memories"], docs, self.now), docs, paths))
        if reset:
            for n in ("future_items", "node_acl", "recall_events", "episodes"):
                change.replace(n, t[n])
        lines = new.withColumn("id", F.monotonically_increasing_id())
        fresh = mutate.insert_new_episodes(t["episodes"], lines).drop("id")
        sizes = t["text_sizes"].where("kind = 'episode'")
        if reset or "episode_terms" not in self.store.manifest["tables"]:
            sizes = self._index(change, "episode", t["episodes"])
        added = change.append("episodes", mutate.numbered(fresh, ["source_path", "ts", "summary"], t["episodes"].agg(F.max("id").alias("top"))))
        sizes = sizes.unionByName(self._index(change, "episode", added, True)).unionByName(self._index(change, "memory", memories)).unionByName(self._index(change, "lock", change.replace("locks", locks)))
        change.replace("text_sizes", sizes)
        seen = docs.select(F.col("name").alias("d_name"), "seen_at").dropDuplicates(["d_name"])
        first = mutate.seed_recalls(t["recall_events"], memories.join(seen, F.col("name") == F.col("d_name")), F.col("seen_at"))
        change.append("recall_events", mutate.numbered(first, ["memory_id"], t["recall_events"].agg(F.max("id").alias("top"))))
        change.replace("links", t["links"].where("kind <> 'wiki'").unionByName(ep.wiki_links(memories)))
        out = {"files": len(files), "skipped": skipped, "memories": docs.count(), "episodes": new.count(), "locks": len(entries)}
        if reset:
            out["reset"] = mutate.reset_counts(before).first().asDict()
        out["version"] = change.commit(self.now, self.config.settings())
        docs.unpersist()
        self.store.compact()
        return out

    def _locks(self, entries: list[dict], stored: DataFrame) -> DataFrame:
        """The lock table of the file's entries; refuses a file that rewords a stored lock."""
        read = ing.lock_table(self.spark, entries)
        changed = [r.slug for r in ing.drifted(stored, read).limit(10).collect()]
        if changed:
            raise ValueError(f"locks are written once, but the file changes {', '.join(sorted(changed))}")
        return read

    def _log(self, hits: DataFrame, rows: list, reader: str, scope: str, recalls: DataFrame) -> None:
        """Appends the recalls of a search's memory hits."""
        if any(r.kind == "memory" for r in rows):
            top = (recalls.agg(F.max("id")).first()[0] or 0) + 1
            kept = self.spark.createDataFrame(rows, hits.schema)
            self.store.append({"recall_events": se.recalls_of(kept, reader, scope, self.now, top)})

    def search(self, query: str, scope: str = "os", reader: str = "agent:builder", limit: int = 10, archived: bool = False, log: bool = True) -> list:
        t = self.tables
        hits = se.search(t["memories"], t["episodes"], t["node_acl"], query, scope, agent_name(reader), limit, None, archived, self.config, self.indexes(t))
        rows = hits.collect()  # at most ``limit``
        if log:
            self._log(hits, rows, agent_name(reader), scope, t["recall_events"])
        return rows

    def ask(self, agent: str, query: str, asker: str = "agent:curator", scope: str = "company", limit: int = 10, archived: bool = False, log: bool = True) -> list:
        t = self.tables
        hits = se.ask(t["memories"], t["episodes"], t["node_acl"], agent_name(agent), query, agent_name(asker), scope, limit, archived, self.config, self.indexes(t))
        rows = hits.collect()  # at most ``limit``
        if log:
            self._log(hits, rows, agent_name(asker), scope, t["recall_events"])
        return rows

    def stale(self, path: str) -> bool:
        """Whether a source changed after the last ingest; a missing file did not, and without an
        ingest everything is stale."""
        if not path:
            return False
        try:
            last = datetime.fromisoformat(self.store.manifest["stamp"])
        except (TypeError, ValueError):
            return True
        try:
            return Path(path).stat().st_mtime > last.timestamp()
        except OSError:
            return False

    def _marked(self, lines: list) -> list:
        """Pack lines (a budget's worth) with ``stale``, which only lines of memories can be."""
        return [Row(**r.asDict(), stale=r.section in ("active-lock", "hot-memory") and r.source_path != "locks" and self.stale(r.source_path)) for r in lines]

    def context(self, agent: str, task: str, budget: int | None = None) -> list:
        t = self.tables
        return self._marked(pack.context(t, agent, task, self.at, budget, self.config, self.indexes(t)).orderBy("line").collect())

    def brief(self, agent: str, yesterday: str) -> list:
        return self._marked(pack.brief(self.tables, agent, self.at, yesterday, self.config).orderBy("line").collect())

    def timeline(self, start: str | None, end: str | None, limit: int = 100) -> list:
        return ep.timeline(self.tables["episodes"], start, end, limit).collect()

    def upcoming(self, days: int | None = None) -> list:
        return ep.upcoming(self.tables["future_items"], self.at[:10], days).collect()

    def related(self, name: str) -> list:
        t = self.tables
        return ep.related(t["links"], t["memories"], t["episodes"], name).collect()

    def stats(self) -> dict:
        t = self.tables
        out = report.stats_scalars(t["memories"], t["episodes"], t["recall_events"], t["locks"]).first().asDict()
        for name, column in (("memories", "scope"), ("memories", "owner"), ("memories", "status"), ("episodes", "kind")):
            out[f"{name}_by_{column}"] = report.counts_map(t[name], column).first()[0]
        from larkspur.operators.activation import hot_cold_counts

        return out | hot_cold_counts(t["memories"], t["recall_events"], self.at, self.config.decay, self.config.hot_threshold).first().asDict() | {
            "last_ingest": self.store.manifest["stamp"],
            "stale": self.store.manifest["stamp"] is None or any(self.stale(str(p)) for p in self.source_paths()),
        }

    def source_paths(self) -> list[Path]:
        return [p for _, p in discover(self.root, self.guard, self.config, None, self.extra, self.curator)]

    def consolidate(self) -> list:
        t = self.tables
        return report.consolidation(t["memories"], t["recall_events"], self.at, self.config).orderBy(*report.report_order()).collect()

    def prune_report(self) -> list:
        t = self.tables
        return pack.prune_report(t["memories"], t["recall_events"], self.at, self.config).orderBy("title", "id").collect()

    def remember(self, text: str, due: str, by: str) -> int:
        if not lk.valid_day(due):
            raise ValueError("a due day is written YYYY-MM-DD")
        f = self.tables["future_items"]
        row = mutate.remember(f, text, due, by, self.now)
        change = self.store.begin()
        added = change.append("future_items", row)
        change.commit()
        return added.first().id

    def done(self, item: int, drop: bool = False) -> None:
        self.store.write({"future_items": mutate.finish(self.tables["future_items"], item, drop)})

    def missed(self, what: str, by: str) -> None:
        change = self.store.begin()
        self._add_episodes(change, mutate.missed(self.tables["episodes"], what, by, self.now))
        change.commit()

    def promote(self, memory: int, to: str, by: str) -> bool:
        t = self.tables
        moved, audit = mutate.promote(t["memories"], t["episodes"], memory, to, by, self.now)
        if audit is None:
            return False
        rows = mutate.numbered(audit, ["ts"], t["episodes"].agg(F.max("id").alias("top")))
        change = self.store.begin()
        change.replace("memories", moved)
        self._add_episodes(change, rows)
        change.commit()
        return True

    def add_locks(self, proposed: list[dict], dry_run: bool = False) -> list[tuple[str, str, str]]:
        """Judges proposals; unless it is a dry run, appends the accepted ones to the store's file and
        reads it again."""
        self.guard.check(self.lock_path)
        known = {e["slug"]: e for e in ing.read_locks(self.lock_path)}
        verdicts = lk.judge(known, proposed)
        good = [e for e, (_, verdict, _) in zip(proposed, verdicts) if verdict == "accepted"]
        if good and not dry_run:
            keys = ("slug", "title", "scope", "locked_on", "supersedes", "body")
            self.lock_path.parent.mkdir(parents=True, exist_ok=True)
            ing.append_locks(self.lock_path, [{k: e.get(k) or None for k in keys} for e in good])
            change = self.store.begin()
            locks = change.replace("locks", self._locks(ing.read_locks(self.lock_path), self.tables["locks"]))
            sizes = self.tables["text_sizes"].where("kind <> 'lock'")
            change.replace("text_sizes", sizes.unionByName(self._index(change, "lock", locks)))
            change.commit()
        return verdicts

    def locks(self, scope: str | None = None, superseded: bool = False) -> list:
        return lk.list_locks(self.tables["locks"], scope, superseded).collect()

    def render_locks(self) -> tuple[str, str]:
        return lk.render(lk.render_order(self.tables["locks"]).collect())


__all__ = ["Engine", "SCHEMAS"]
