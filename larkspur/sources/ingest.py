"""Files to memories, episodes and locks: one scan and one parser plan per kind of source."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.config import EngineConfig
from larkspur.functions.text import content_hash, slugify
from larkspur.operators import parse
from larkspur.sources.roster import Source

DOC = "name string, title string, body string, owner string, scope string, source_path string, content_hash string, is_lock int, ordinal bigint, seen_at string"
EPISODE = "ts string, actor string, kind string, summary string, body string, scope string, source_path string"


def read_files(spark: SparkSession, files: list[Path]) -> DataFrame:
    """``key`` (the path), ``at`` (its time) and ``text``; bytes that are no UTF-8 are replaced."""
    full = [p.resolve() for p in files]
    path = F.regexp_replace("path", "^file:/+", "/")
    bare = [(str(p), datetime.fromtimestamp(int(p.stat().st_mtime), UTC).replace(tzinfo=None), "") for p in full if not p.stat().st_size]  # the scan skips empty files
    out = spark.createDataFrame(bare, "key string, at timestamp_ntz, text string").withColumn("at", F.col("at").cast("timestamp"))
    if len(bare) < len(full):
        rows = spark.read.format("binaryFile").load([f"file://{p}" for p in full])
        out = out.unionByName(rows.where("length > 0").select(path.alias("key"), F.col("modificationTime").alias("at"), F.decode("content", "UTF-8").alias("text")))
    return out


def stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def dated(path: Column, day: Column, at: Column) -> Column:
    """When a file's lines happened: by its name's stamp, its header's day, else its own time."""
    name = F.substring_index(path, "/", -1)
    full, short, plain = r"^(\d{8}T\d{6}Z)", r"^(\d{8}T\d{4}Z)", r"^(\d{8})"
    pick = lambda p, f: F.try_to_timestamp(F.regexp_extract(name, p, 1), F.lit(f))
    said = F.coalesce(F.try_to_timestamp(day), F.try_to_timestamp(F.regexp_extract(day, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.regexp_extract(day, r"^(\d{8})", 1), F.lit("yyyyMMdd")))
    return F.coalesce(pick(full, "yyyyMMdd'T'HHmmss'Z'"), pick(short, "yyyyMMdd'T'HHmm'Z'"), pick(plain, "yyyyMMdd"), said, at)


def _docs(rows: DataFrame, config: EngineConfig) -> DataFrame:
    """Rows (name, title, body, key, at, is_lock, ordinal, scope) as memory documents."""
    owner = parse.owner_of(F.col("key"), list(config.agent_hints))
    return rows.select(
        "name", "title", "body", owner.alias("owner"), "scope", F.col("key").alias("source_path"), content_hash(F.col("title"), F.col("body"), F.col("key")).alias("content_hash"), F.col("is_lock").cast("int").alias("is_lock"),
        F.col("ordinal").cast("bigint").alias("ordinal"), stamp(F.col("at")).alias("seen_at"),
    )


def section_docs(files: DataFrame, config: EngineConfig) -> DataFrame:
    """A memory per ``## `` section."""
    s = parse.sections(files).join(files.select("key", "at"), "key").withColumn("name", slugify(F.col("title")))
    scope = F.when(F.lower("title") == "active files", "os").otherwise(parse.scope_of(F.lit(""), F.col("body"), F.col("title"), config))
    return _docs(s.withColumn("scope", scope), config)


def note_docs(files: DataFrame, config: EngineConfig, agent: bool) -> DataFrame:
    """A memory per file; its head may give name and title, else its file name does."""
    _, body, field = parse.front(F.col("text"))
    rows = files.select("key", "at", F.trim(body).alias("body"), field("name").alias("n"), field("title").alias("t"), field("description").alias("ds"), stem(F.col("key")).alias("stem"))
    rows = rows.select("key", "at", "body", "stem", F.coalesce("n", slugify(F.col("stem"))).alias("name"), F.coalesce("t", "ds", F.replace("stem", F.lit("_"), F.lit(" "))).alias("title"), F.lit(0).alias("is_lock"), F.lit(0).alias("ordinal"))
    scope = parse.scope_of(F.col("stem"), F.col("body"), F.col("title"), config)
    if agent:
        scope = F.when(~F.lower("body").contains("product:"), "company").otherwise(scope)
    scope = F.when((F.substring_index("key", "/", -1) == "MEMORY.md") | (F.lower("title") == "active files"), "os").otherwise(scope)
    return _docs(rows.withColumn("scope", scope), config)


def episode_rows(files: DataFrame, kind: str, config: EngineConfig) -> DataFrame:
    """An episode per line (the first 50 that are not blank), one second apart; an empty file gives one
    named after it."""
    meta = files.join(parse.headers(files), "key", "left")
    lines = parse.first_lines(files)
    both = meta.join(lines, "key", "left").withColumn("line", F.coalesce("line", stem(F.col("key")))).withColumn("ordinal", F.coalesce("ordinal", F.lit(0)))
    hint = F.lit("system")
    for h in reversed(config.agent_hints):
        hint = F.when(F.lower("key").contains(h), f"agent:{h}").otherwise(hint)
    said = F.replace(F.lower(F.trim("sender")), F.lit("-"), F.lit("_"))
    actor = F.when(F.col("sender").isNull(), hint).when(said.startswith("agent:"), said).otherwise(F.concat(F.lit("agent:"), said))
    when = dated(F.col("key"), F.col("day"), F.col("at")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("ordinal").cast("decimal(18,6)"))
    scope = parse.scope_of(stem(F.col("key")), F.col("text"), None, config)
    return both.select(stamp(when).alias("ts"), actor.alias("actor"), F.lit(kind).alias("kind"), F.substring("line", 1, 240).alias("summary"), F.col("line").alias("body"), scope.alias("scope"), F.col("key").alias("source_path"))


def log_rows(files: DataFrame) -> DataFrame:
    """An episode per line of the team log, at its own time or the file's plus its place in seconds."""
    lines = parse.log_lines(files).join(files.select("key", "at"), "key")
    when = F.coalesce("ts", F.col("at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("ordinal").cast("decimal(18,6)")))
    return lines.select(stamp(when).alias("ts"), "actor", F.lit("team-log").alias("kind"), F.col("line").alias("summary"), F.col("line").alias("body"), F.lit("os").alias("scope"), F.col("key").alias("source_path"))


def parse_sources(spark: SparkSession, files: list[tuple[Source, Path]], config: EngineConfig = EngineConfig()) -> tuple[DataFrame, DataFrame]:
    """The memory documents and episodes of a list of files."""
    docs, episodes = [spark.createDataFrame([], DOC)], [spark.createDataFrame([], EPISODE)]
    for s in dict.fromkeys(x for x, _ in files):
        if s.kind == "locks":
            continue
        f = read_files(spark, [p for x, p in files if x == s])
        if s.kind == "sections":
            docs.append(section_docs(f, config))
        elif s.kind == "notes":
            docs.append(note_docs(f, config, s.name == "agent-memory"))
        elif s.kind == "log":
            episodes.append(log_rows(f))
        elif s.kind == "mixed":
            headed = F.ltrim("text").startswith("---")
            docs.append(note_docs(f.where(headed), config, False))
            episodes.append(episode_rows(f.where(~headed), "ticket", config))
        else:
            episodes.append(episode_rows(f, s.episode_kind, config))
    return reduce(DataFrame.unionByName, docs), reduce(DataFrame.unionByName, episodes)


def read_locks(path: Path) -> list[dict]:
    """The entries of a YAML decision store; a missing or comment-only file has none."""
    if not path.is_file():
        return []
    got = yaml.safe_load(path.read_text()) or []
    if not isinstance(got, list):
        raise ValueError("a decision store is a list of entries")
    return [{k: ("" if v is None else str(v)) for k, v in e.items()} for e in got]


def append_locks(path: Path, entries: list[dict]) -> None:
    """Appends entries through a temporary file that then takes the store's place."""
    old = path.read_text() if path.exists() else "# Decisions, written once. Supersede, do not edit.\n"
    tail = yaml.safe_dump(entries, sort_keys=False, allow_unicode=True) if entries else ""
    new = path.with_suffix(path.suffix + ".new")
    new.write_text(old + ("" if old.endswith("\n") else "\n") + tail)
    new.replace(path)


def lock_table(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Stored locks with ids in order of the file, supersedes resolved, status by who is superseded."""
    ids = {e["slug"]: k for k, e in enumerate(entries, 1)}
    gone = {e.get("supersedes") for e in entries}
    rows = [(ids[e["slug"]], e["slug"], e["title"], e["body"], e["scope"], e["locked_on"], "superseded" if e["slug"] in gone else "active", ids.get(e.get("supersedes") or "")) for e in entries]
    return spark.createDataFrame(rows, "id bigint, slug string, title string, body string, scope string, locked_on string, status string, supersedes bigint")


def drifted(stored: DataFrame, read: DataFrame) -> DataFrame:
    """``slug``: stored locks that the file now words otherwise, though a lock is written once."""
    parts = ("title", "body", "scope", "locked_on")
    now = read.select(F.col("slug").alias("_slug"), *[F.col(c).alias(f"_{c}") for c in parts])
    other = reduce(lambda a, b: a | b, [~F.coalesce(F.trim(c), F.lit("")).eqNullSafe(F.coalesce(F.trim(f"_{c}"), F.lit(""))) for c in parts])
    return stored.join(now, F.col("slug") == F.col("_slug")).where(other).select("slug").distinct()


def readable_files(files: list[tuple[Source, Path]]) -> tuple[list[tuple[Source, Path]], list[str]]:
    """The files that can be opened, and the paths of those that can't; the lock store must be readable."""
    good, skipped = [], []
    for s, p in files:
        try:
            with open(p, "rb"):
                good.append((s, p))
        except OSError:
            if s.kind == "locks":
                raise
            skipped.append(str(p))
    return good, skipped
