"""Command line: one verb per engine operation, text or ``--json``.

Settings come from options, else from LARKSPUR_ROOT, LARKSPUR_STORE, LARKSPUR_PROTECTED_ROOT,
LARKSPUR_EXTRA_DIR, LARKSPUR_CURATOR_DIR or LARKSPUR_CURATOR_HOME, and those that
``EngineConfig.from_environment`` reads (sources, agents, products, company words, tunables). A store
remembers the tunables of its last ingest.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, date, datetime, timedelta
from pathlib import Path

import yaml

from larkspur.config import EngineConfig
from larkspur.functions.text import single_line, slug
from larkspur.sources.guard import Guard


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("larkspur", description=__doc__)
    env = os.environ.get
    p.add_argument("--root", default=env("LARKSPUR_ROOT"))
    p.add_argument("--store", default=env("LARKSPUR_STORE"))
    p.add_argument("--protected-root", default=env("LARKSPUR_PROTECTED_ROOT"))
    p.add_argument("--now")
    p.add_argument("--json", action="store_true")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: tuple, of=verbs):
        v = of.add_parser(name)
        for names, kw in args:
            v.add_argument(*names.split(), **kw)
        return v

    day = {"help": "YYYY-MM-DD"}
    verb("ingest", ("--source", {}), ("--reset", {"action": "store_true"}), ("--force", {"action": "store_true"}))
    verb("search", ("query", {}), ("--scope", {"default": "os"}), ("--as", {"dest": "reader", "default": "agent:builder"}), ("--limit", {"type": int, "default": 10}), ("--include-archived", {"action": "store_true"}))
    verb("ask", ("agent", {}), ("query", {}), ("--as", {"dest": "reader", "default": "agent:curator"}), ("--scope", {"default": "company"}), ("--limit", {"type": int, "default": 10}), ("--include-archived", {"action": "store_true"}))
    verb("timeline", ("--from", {"dest": "start", **day}), ("--to", {"dest": "end", **day}))
    verb("today")
    verb("yesterday")
    verb("upcoming", ("--days", {"type": int}))
    verb("remember", ("text", {}), ("--due", {"required": True}), ("--by", {"default": "agent:builder"}))
    verb("done", ("id", {"type": int}), ("--drop", {"action": "store_true"}))
    verb("related", ("name", {}))
    verb("brief", ("agent", {}))
    verb("missed", ("what", {}), ("--by", {"default": "agent:builder"}))
    verb("context", ("agent", {}), ("task", {}), ("--budget", {"type": int}))
    verb("consolidate", ("--report", {}))
    verb("promote", ("id", {"type": int}), ("--to", {"required": True}), ("--by", {"required": True}))
    verb("prune-report")
    verb("stats")
    verb("guard-check", ("path", {}))
    lock = verbs.add_parser("lock").add_subparsers(dest="lock_verb", required=True)
    verb("add", ("slug", {}), ("--title", {"required": True}), ("--scope", {"required": True}), ("--body", {"required": True}), ("--locked-on", {"default": None}), ("--supersedes", {}), of=lock)
    verb("import", ("file", {}), ("--dry-run", {"action": "store_true"}), of=lock)
    verb("list", ("--scope", {}), ("--all", {"action": "store_true"}), of=lock)
    verb("show", ("slug", {}), of=lock)
    verb("render", ("--into", {}), ("--check", {"action": "store_true"}), of=lock)
    return p


def _pack_line(r: dict) -> str:
    notes = [f"source {r['source_path'] or '-'}", f"owner {r['owner']}", f"scope {r['scope']}"]
    if r["activation"] is not None:
        notes.append(f"activation {r['activation']:.3f}")
    if r.get("stale"):
        notes.append("stale")
    if r["confidence"]:
        notes.append("marks " + "".join(r["confidence"]))
    return f"{r['line']} [{r['section']}] {r['title']} | {r['body']} ({', '.join(notes)})"


#: A line of text per row, by verb; other results are written field by field.
LINES = {
    **dict.fromkeys(("search", "ask"), lambda r: f"{r['kind']} {r['id']} [{r['scope']}] {r['title']} (rank {r['rank']:.3f}, owner {r['owner']}, source {r['source_path'] or '-'})"),
    **dict.fromkeys(("timeline", "today", "yesterday"), lambda r: f"{r['ts']} {r['kind']} {r['actor']} [{r['scope']}] {r['summary']}"),
    **dict.fromkeys(("context", "brief"), _pack_line),
    "upcoming": lambda r: f"{r['due']} item {r['id']} by {r['created_by']}: {r['body']}",
    "related": lambda r: f"{r['link_kind']} -> {r['to_kind']} {r['to_id']}: {r['title']} | {r['body']}",
    "consolidate": lambda r: f"{r['kind']} {r['id']} {r['title']} [{r['current_scope']} -> {r['suggested_scope'] or '-'}] (recalls from broader scopes {r['higher']}, decided by {r['required_tier']})",
    "prune-report": lambda r: f"{r['section']} {r['id']} {r['title']} [{r['scope']}] (owner {r['owner']}, activation {'-' if r['activation'] is None else format(r['activation'], '.3f')})",
    "list": lambda r: f"{r['locked_on']} {r['slug']} [{r['scope']}, {r['status']}] {r['title']}" + (f" (supersedes {r['supersedes_slug']})" if r["supersedes_slug"] else ""),
}


def shown(value, as_json: bool, verb: str | None = None) -> str:
    plain = lambda r: r.asDict(True) if hasattr(r, "asDict") else r
    value = [plain(r) for r in value] if isinstance(value, list) else plain(value)
    if as_json:
        return json.dumps(value, ensure_ascii=False, indent=2, default=str)
    if value == []:
        return "nothing found"
    if verb == "render" and "text" in value:
        return value["text"]
    if isinstance(value, dict):  # one field a line; lists of rows below their name
        field = lambda k, v: "\n".join([f"{k}:", *("  " + ", ".join(f"{a} {b}" for a, b in x.items()) for x in v)]) if v and isinstance(v, list) and isinstance(v[0], dict) else f"{k}: {v}"
        return "\n".join(field(k, v) for k, v in value.items())
    line = LINES.get(verb, lambda r: "\t".join(f"{k}={v}" for k, v in r.items()))
    return "\n".join(single_line(line(r), 600) for r in value)


def run(args: argparse.Namespace, spark=None) -> tuple[int, object]:
    """Exit code and result of a parsed command."""
    guard = Guard(args.protected_root)
    if args.verb == "guard-check":
        said = guard.verdict(args.path)
        return (0 if said["allowed"] else 1), said
    if not (args.root or "").strip():
        raise SystemExit("a workspace root is needed: --root or LARKSPUR_ROOT")
    from larkspur.engine import Engine
    from larkspur.session import build_session

    now = args.now or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S+00:00")
    config = EngineConfig.from_environment(os.environ)
    default_store = Path(args.root, "system", "larkspur")
    store = args.store or default_store
    curator = os.environ.get("LARKSPUR_CURATOR_DIR") or curator_folder(args.root, os.environ.get("LARKSPUR_CURATOR_HOME"))
    reads = args.verb in ("timeline", "today", "yesterday", "upcoming", "related", "brief", "context", "consolidate", "prune-report", "stats") or (args.verb == "lock" and args.lock_verb in ("list", "show", "render"))
    e = Engine(spark or build_session("larkspur", os.environ.get("LARKSPUR_MASTER", "local[*]")), args.root, store, guard, now, config, os.environ.get("LARKSPUR_EXTRA_DIR"), curator, reads)
    if args.verb != "ingest":
        set_here = {n for n in config.STORED if os.environ.get(f"LARKSPUR_{n.upper()}")}
        e.config = config.with_settings({k: v for k, v in e.store.manifest.get("settings", {}).items() if k not in set_here})
    today = now[:10]
    before = str(date.fromisoformat(today) - timedelta(days=1))
    v = args.verb
    if v == "ingest":
        if args.reset and Path(store) == default_store and not args.force:
            raise SystemExit("resetting the default store needs --force")
        done = e.ingest(args.source, args.reset)
        for path in done["skipped"]:
            print(f"skipped {path}: it can't be read", file=sys.stderr)
        if done.get("reset", {}).get("promotion_audits_dropped"):
            print(f"the reset dropped {done['reset']['promotion_audits_dropped']} audits of promotions", file=sys.stderr)
        return 0, done
    if v == "search":
        return 0, e.search(args.query, args.scope, args.reader, args.limit, args.include_archived)
    if v == "lock":
        return _lock(args, e, today)
    simple = {
        "ask": lambda: e.ask(args.agent, args.query, args.reader, args.scope, args.limit, args.include_archived),
        "timeline": lambda: e.timeline(args.start, args.end),
        "today": lambda: e.timeline(today, today),
        "yesterday": lambda: e.timeline(before, before),
        "upcoming": lambda: e.upcoming(args.days),
        "remember": lambda: {"id": e.remember(args.text, args.due, args.by)},
        "done": lambda: e.done(args.id, args.drop) or {"id": args.id},
        "related": lambda: e.related(args.name),
        "brief": lambda: e.brief(args.agent, before),
        "missed": lambda: e.missed(args.what, args.by) or {"missed": args.what},
        "context": lambda: e.context(args.agent, args.task, args.budget),
        "consolidate": lambda: _report(e.consolidate(), args.report, now),
        "promote": lambda: {"id": args.id, "changed": e.promote(args.id, args.to, args.by)},
        "prune-report": e.prune_report,
        "stats": e.stats,
    }
    return 0, simple[v]()


def curator_folder(root: str, home: str | None) -> str | None:
    """The curator's notes on a workspace: a folder below ``home`` named after the workspace's path."""
    return None if not home else str(Path(home, "-" + slug("-".join(x for x in Path(root).parts if x != "/")), "memory"))


def _put(at: Path, text: str) -> None:
    """Writes a file through a temporary one that then takes its place."""
    tmp = at.with_suffix(at.suffix + ".new")
    tmp.write_text(text)
    tmp.replace(at)


def _report(rows: list, path: str | None, now: str) -> list:
    if path:
        cell = lambda x: "-" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
        heads = ["kind", "id", "title", "current_scope", "suggested_scope", "owner", "required_tier", "higher", "activation", "last_recall"]
        lines = ["# Consolidation report", "", f"DATE: {now}", "", "| " + " | ".join(heads) + " |", "|" + "---|" * len(heads)]
        _put(Path(path), "\n".join(lines + ["| " + " | ".join(cell(r[h]) for h in heads) + " |" for r in rows]) + "\n")
    return rows


def _lock(args, e, today: str) -> tuple[int, object]:
    from larkspur.operators import locks as lk

    if args.lock_verb in ("add", "import"):
        if args.lock_verb == "add":
            new = [{"slug": args.slug, "title": args.title, "scope": args.scope, "body": args.body, "locked_on": args.locked_on or today, "supersedes": args.supersedes or ""}]
        else:
            new = yaml.safe_load(e.guard.check(args.file).read_text()) or []
        said = e.add_locks(new, getattr(args, "dry_run", False))
        counts = lk.verdict_counts(said)
        return int(counts["rejected"] > 0), counts | {"verdicts": [{"slug": s, "verdict": v, "reason": r} for s, v, r in said]}
    if args.lock_verb == "list":
        return 0, e.locks(args.scope, args.all)
    if args.lock_verb == "show":
        got = lk.show_lock(e.tables["locks"], args.slug).collect()
        return int(not got), got
    text, digest = e.render_locks()
    if not args.into:
        return 0, {"sha256": digest, "text": text}
    at = e.guard.check(args.into)
    old = at.read_text()
    new = lk.into_section(old, text)
    if args.check:
        return int(old != new), {"sha256": digest, "changed": old != new, "diff": lk.section_diff(str(at), old, new)}
    _put(at, new)
    return 0, {"sha256": digest, "changed": old != new}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    code, value = run(args)
    try:
        print(shown(value, args.json, args.lock_verb if args.verb == "lock" else args.verb))
    except BrokenPipeError:
        sys.stderr.close()
    return code


if __name__ == "__main__":
    sys.exit(main())
