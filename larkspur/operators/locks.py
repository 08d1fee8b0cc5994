"""Write-once decisions: lists, order of rendering, supersession, and the checks on new ones."""

from __future__ import annotations

import difflib
import hashlib
import re
from collections import Counter
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.episodes import each_once

LOCK = ["id", "slug", "title", "body", "scope", "locked_on", "status", "supersedes"]
SLUG = re.compile(r"[a-z0-9]+(-[a-z0-9]+)*")


def with_superseded(locks: DataFrame) -> DataFrame:
    """Each lock once, with the slug of the lock it supersedes (null if there is none)."""
    one = each_once(locks, *LOCK)
    old = one.select(F.col("id").alias("_old"), F.col("slug").alias("supersedes_slug"))
    return one.join(old, F.col("supersedes") == F.col("_old"), "left").drop("_old", "supersedes")


def list_locks(locks: DataFrame, scope: str | None = None, superseded: bool = False) -> DataFrame:
    rows = with_superseded(locks)
    if scope is not None:
        rows = rows.where(F.col("scope") == scope)
    if not superseded:
        rows = rows.where("status = 'active'")
    return rows.orderBy(F.desc("locked_on"), "slug")


def show_lock(locks: DataFrame, slug: str) -> DataFrame:
    return with_superseded(locks).where(F.col("slug") == slug)


def render_order(locks: DataFrame) -> DataFrame:
    """Active locks in the order they are rendered: os, company, products, others; scope, day, slug."""
    s = F.col("scope")
    group = F.when(s == "os", 0).when(s == "company", 1).when(s.startswith("product:"), 2).otherwise(3)
    return with_superseded(locks).where("status = 'active'").withColumn("scope_group", group).orderBy("scope_group", "scope", "locked_on", "slug")


def restatus(locks: DataFrame) -> DataFrame:
    """``id, slug, status``: superseded exactly if another lock names it, whatever is stored."""
    one = each_once(locks, *LOCK)
    named = one.where("supersedes is not null").select(F.col("supersedes").alias("_named")).distinct()
    j = one.join(named, F.col("id") == F.col("_named"), "left")
    return j.select("id", "slug", F.when(F.col("_named").isNotNull(), "superseded").otherwise("active").alias("status"))


def valid_slug(text: str) -> bool:
    return bool(SLUG.fullmatch(text))


def valid_scope(text: str) -> bool:
    return text in ("os", "company") or (text.startswith("product:") and valid_slug(text[8:]))


def valid_day(text: str) -> bool:
    try:
        return bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", text)) and bool(date.fromisoformat(text))
    except ValueError:
        return False


def _fault(e: dict) -> str | None:
    checks = [("bad-slug", valid_slug(e["slug"])), ("bad-title", e["title"].strip()), ("bad-scope", valid_scope(e["scope"])), ("bad-date", valid_day(e["locked_on"])), ("bad-body", e["body"].strip())]
    return next((name for name, good in checks if not good), None)


def judge(known: dict[str, dict], proposed: list[dict]) -> list[tuple[str, str, str]]:
    """``(slug, accepted / skipped / rejected, reason)`` of proposed locks, in their order.

    ``known`` maps slugs to stored entries. A proposal equal to a known lock is skipped; a known
    slug with other content is rejected, for a lock is written once. A superseded slug must be
    known or accepted earlier in the list. Order matters, so this runs on the driver.
    """
    seen, out = dict(known), []
    for e in proposed:
        e = {k: str(e.get(k) or "") for k in ("slug", "title", "scope", "locked_on", "supersedes", "body")}
        old = seen.get(e["slug"])
        if fault := _fault(e):
            out.append((e["slug"], "rejected", fault))
        elif old is not None:
            same = all(str(old.get(k) or "").strip() == e[k].strip() for k in ("title", "scope", "locked_on", "supersedes", "body"))
            out.append((e["slug"], "skipped" if same else "rejected", "already-locked" if same else "duplicate-slug"))
        elif e["supersedes"] and e["supersedes"] not in seen:
            out.append((e["slug"], "rejected", "missing-supersede-target"))
        else:
            seen[e["slug"]] = e
            out.append((e["slug"], "accepted", "ok"))
    return out


# The frame of the rendered text.
HEADER = "# Active decisions\n\nGenerated from the decision store; do not edit by hand.\n"
BEGIN, END = "<!-- decisions:begin -->", "<!-- decisions:end -->"


def render(rows: list) -> tuple[str, str]:
    """Markdown of locks in render order, and its SHA-256; the same rows give the same bytes."""
    out, scope = [HEADER], None
    for r in rows:
        if r["scope"] != scope:
            scope = r["scope"]
            out.append(f"\n## {scope}\n")
        out.append(f"\n### {r['title']}\n\n- slug: `{r['slug']}`\n- locked on: {r['locked_on']}\n")
        if r["supersedes_slug"]:
            out.append(f"- supersedes: `{r['supersedes_slug']}`\n")
        out.append(f"\n{r['body'].strip()}\n")
    text = "".join(out)
    return text, hashlib.sha256(text.encode()).hexdigest()


def into_section(document: str, content: str) -> str:
    """The document with what stands between its two marks replaced; each must stand there once."""
    if document.count(BEGIN) != 1 or document.count(END) != 1 or document.index(BEGIN) > document.index(END):
        raise ValueError("the document needs one begin mark and, after it, one end mark")
    head, _, rest = document.partition(BEGIN)
    return f"{head}{BEGIN}\n{content.strip()}\n{END}{rest.partition(END)[2]}"


def section_diff(path: str, old: str, new: str) -> str:
    """A unified diff of two versions of a document, empty if they are the same."""
    return "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), f"{path} (as it is)", f"{path} (as rendered)"))


def verdict_counts(verdicts: list[tuple[str, str, str]]) -> dict[str, int]:
    said = Counter(v for _, v, _ in verdicts)
    return {k: said[k] for k in ("accepted", "skipped", "rejected")}
