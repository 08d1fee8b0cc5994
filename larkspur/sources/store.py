"""Versioned Parquet snapshots with a manifest that changes in one rename, on any Hadoop file system."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "memories": "id bigint, name string, title string, body string, owner string, scope string, source_path string, content_hash string, is_lock int, status string, created_at string, updated_at string",
    "episodes": "id bigint, ts string, actor string, kind string, summary string, body string, scope string, source_path string",
    "recall_events": "id bigint, memory_id bigint, queried_by string, query_scope string, ts string",
    "future_items": "id bigint, body string, due string, created_by string, status string, created_at string",
    "links": "from_kind string, from_id bigint, to_kind string, to_id bigint, kind string",
    "locks": "id bigint, slug string, title string, body string, scope string, locked_on string, status string, supersedes bigint",
    "node_acl": "owner_node string, reader string, granted int",
    # the text indexes of memories, episodes and locks, and the rows that add up to their sizes
    "memory_terms": "term string, id bigint, dl bigint, t0 bigint, t1 bigint",
    "episode_terms": "term string, id bigint, dl bigint, t0 bigint, t1 bigint",
    "lock_terms": "term string, id bigint, dl bigint, t0 bigint, t1 bigint, t2 bigint",
    "text_sizes": "kind string, n bigint, tokens bigint",
}


class Store:
    """Tables under one directory; a version names the folders of each table, and unchanged ones are
    shared between versions. An append writes one folder more and leaves the others alone.

    One writer at a time; readers keep the version they opened. A failed write leaves the manifest,
    and so the current version, as it was. Opened ``read_only``, nothing is made or changed.
    """

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.root, self.read_only = spark, str(root).rstrip("/"), read_only
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path().getFileSystem(self._conf)
        if not read_only:
            self._files.mkdirs(self._path())

    def _path(self, *parts: str):
        return self._fs.Path("/".join([self.root, *parts]))

    @property
    def manifest(self) -> dict:
        """``version``, ``stamp`` (of the last ingest), ``settings`` and the folders of each table."""
        at = self._path("manifest.json")
        if not self._files.exists(at):
            return {"version": 0, "stamp": None, "settings": {}, "tables": {}}
        stream = self._files.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        schema = SCHEMAS[name]
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def load(self) -> dict[str, DataFrame]:
        """Every table of the current version; one never written is empty."""
        known = self.manifest["tables"]
        return {n: self._read(n, known.get(n, [])) for n in SCHEMAS}

    def begin(self) -> Change:
        if self.read_only:
            raise PermissionError("the store is open for reading only")
        return Change(self)

    def write(self, changed: dict[str, DataFrame], stamp: str | None = None) -> int:
        """Replaces tables as a new version."""
        change = self.begin()
        for name, df in changed.items():
            change.replace(name, df)
        return change.commit(stamp)

    def append(self, added: dict[str, DataFrame]) -> int:
        """Adds rows to tables as a new version."""
        change = self.begin()
        for name, df in added.items():
            change.append(name, df)
        return change.commit()

    def compact(self, most: int = 32) -> list[str]:
        """Rewrites tables that have grown to more than ``most`` folders."""
        many = [n for n, folders in self.manifest["tables"].items() if len(folders) > most]
        if many:
            t = self.load()
            self.write({n: t[n] for n in many})
        return many

    def vacuum(self) -> list[str]:
        """Removes folders the current version does not name; nobody may be reading older ones."""
        live = {f for folders in self.manifest["tables"].values() for f in folders}
        here = [f"{t.getPath().getName()}/{v.getPath().getName()}" for t in self._files.listStatus(self._path()) if t.isDirectory() for v in self._files.listStatus(t.getPath())]
        gone = [f for f in here if f not in live]
        for f in gone:
            self._files.delete(self._path(f), True)
        return gone


class Change:
    """A version in the making: folders are written at once, and become current together or never."""

    def __init__(self, store: Store):
        self.store, self.old = store, store.manifest
        self.tables = {n: list(f) for n, f in self.old["tables"].items()}

    def _written(self, name: str, df: DataFrame) -> tuple[str, DataFrame]:
        folder = f"{name}/{uuid.uuid4().hex}"
        rows = df.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")])
        if name.endswith("_terms"):  # a query reads the ranges of its prefixes only
            rows = rows.repartitionByRange("term").sortWithinPartitions("term")
        rows.write.parquet(f"{self.store.root}/{folder}")
        return folder, self.store._read(name, [folder])

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """The table's new rows, as written."""
        folder, rows = self._written(name, df)
        self.tables[name] = [folder]
        return rows

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """The added rows, as written."""
        folder, rows = self._written(name, df)
        self.tables.setdefault(name, []).append(folder)
        return rows

    def commit(self, stamp: str | None = None, settings: dict | None = None) -> int:
        new = {"version": self.old["version"] + 1, "stamp": stamp or self.old["stamp"], "settings": self.old.get("settings", {}) | (settings or {}), "tables": self.tables}
        s = self.store
        draft = s._path(f"manifest-{uuid.uuid4().hex}.json")
        out = s._files.create(draft, False)
        try:
            out.write(bytearray(json.dumps(new, indent=1).encode()))
        finally:
            out.close()
        overwrite = s.spark.sparkContext._gateway.new_array(s._fs.Options.Rename, 1)
        overwrite[0] = s._fs.Options.Rename.OVERWRITE
        s._fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else s._files.getUri(), s._conf).rename(draft, s._path("manifest.json"), overwrite)
        return new["version"]
