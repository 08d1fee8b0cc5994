import json
import os
from datetime import datetime
from pathlib import Path

import pytest

from larkspur import cli
from larkspur.config import EngineConfig
from larkspur.engine import Engine
from larkspur.operators import locks as lk
from larkspur.operators import search as se
from larkspur.sources.guard import Guard, PathRefused

NOW = "2026-06-20T12:00:00+00:00"


def write(root, path, text):
    at = root / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(text)
    return at


@pytest.fixture(scope="module")
def workspace(tmp_path_factory):
    root = tmp_path_factory.mktemp("ws")
    write(root, "system/memory.md", "preface is dropped\n## Retry Policy\nLOCKED: payment retries must be idempotent.\n\n## Empty\n\n## Active files\nplain text of our team\n")
    write(root, "memory/planner/parser_note.md", "---\nname: parser_note\ntitle: Parser note\n---\nScope: product:notebook\nSee [[retry policy]] for tests.\n")
    write(root, "memory/planner/loose-end.md", "No head here.\r\nJust text.\n")
    write(root, "system/TEAM_LOG.md", "[PLANNER] 2026-06-19 08:57 AM | shipped the parser\n[SCRIBE] not dated\n\n]odd line\n")
    write(root, "system/handoffs/20260618-closeout.md", "DATE: 2026-06-18\nFROM: planner\nclosed the release ✅\n")
    write(root, "system/handoffs/20260617T0910Z-empty.md", "")
    write(root, "extra/deep/er/head.md", "---\ntitle: Extra head\n---\nbody")
    write(root, "extra/deep/lines.md", "one\ntwo\n")
    write(root, "private/system.md", "## Secret\nnever read")
    write(root, "system/locks.yaml", "# comment\n- slug: first-rule\n  title: First rule\n  scope: os\n  locked_on: 2026-01-01\n  supersedes: null\n  body: Keep it small.\n- slug: second-rule\n  title: Second rule\n  scope: company\n  locked_on: 2026-01-02\n  supersedes: first-rule\n  body: Keep it tested.\n")
    return root


@pytest.fixture(scope="module")
def engine(spark, workspace):
    e = Engine(spark, workspace, workspace / "store", Guard(workspace / "private"), NOW, extra=str(workspace / "extra"))
    e.report = e.ingest()
    return e


def names(e, where="true"):
    return sorted(r.name for r in e.tables["memories"].where(where).collect())


def test_ingest(engine):
    assert engine.report["locks"] == 2
    assert names(engine) == ["active-files", "head", "loose-end", "parser_note", "retry-policy"]
    m = {r.name: r for r in engine.tables["memories"].collect()}
    assert m["retry-policy"].is_lock == 1 and m["active-files"].scope == "os" and m["loose-end"].title == "loose-end"
    assert m["parser_note"].scope == "product:notebook" and m["parser_note"].owner == "agent:planner" and m["loose-end"].scope == "company"
    e = {(r.kind, r.summary): r for r in engine.tables["episodes"].collect()}
    assert e[("team-log", "[PLANNER] 2026-06-19 08:57 AM | shipped the parser")].ts == "2026-06-19T08:57:00+00:00"
    assert e[("team-log", "]odd line")].actor == "system"
    assert e[("handoff", "closed the release ✅")].ts == "2026-06-18T00:00:02+00:00" and e[("handoff", "closed the release ✅")].actor == "agent:planner"
    assert e[("handoff", "20260617T0910Z-empty")].ts == "2026-06-17T09:10:00+00:00"
    assert ("ticket", "one") in e
    links = engine.tables["links"].collect()
    assert [(r.from_id, r.to_id) for r in links] == [(m["parser_note"].id, m["retry-policy"].id)]
    assert engine.tables["recall_events"].count() == 5


def test_second_ingest_changes_nothing_but_what_changed(engine, workspace):
    before = {r.name: r for r in engine.tables["memories"].collect()}
    n = engine.tables["episodes"].count()
    write(workspace, "system/memory.md", "## Retry Policy\nLOCKED: payment retries must be idempotent and logged.\n")
    engine.ingest("system-memory")
    after = {r.name: r for r in engine.tables["memories"].collect()}
    assert after["retry-policy"].id == before["retry-policy"].id and "logged" in after["retry-policy"].body
    assert after["active-files"].status == "archived" and after["parser_note"] == before["parser_note"]
    assert engine.tables["episodes"].count() == n and engine.tables["recall_events"].count() == 5
    engine.ingest(reset=True)
    assert names(engine) == ["head", "loose-end", "parser_note", "retry-policy"]


def test_search_logs_recalls(engine):
    n = engine.tables["recall_events"].count()
    hits = engine.search("payment retries", "company")
    assert hits[0].title == "Retry Policy" and hits[0].rank == -1.0
    assert engine.tables["recall_events"].count() == n + 1
    assert engine.search("the of", "company") == [] and engine.search("payment", "company", limit=0) == []


def files(engine, table):
    at = Path(engine.store.root) / table
    return {p: p.stat().st_mtime_ns for p in at.rglob("*.parquet")}


def test_appends_leave_other_files_alone(engine):
    before = {t: files(engine, t) for t in ("recall_events", "episodes", "memories", "future_items", "episode_terms")}
    version, n = engine.store.manifest["version"], len(engine.store.manifest["tables"]["recall_events"])
    assert engine.search("payment retries", "company") and engine.ask("shared", "payment retries", "planner", "company")
    engine.missed("where is the almanac", "agent:planner")
    after = {t: files(engine, t) for t in before}
    assert all(before[t].items() <= after[t].items() for t in before) and before["memories"] == after["memories"]
    assert engine.store.manifest["version"] == version + 3 and len(engine.store.manifest["tables"]["recall_events"]) == n + 2
    assert [(r.kind, r.title) for r in engine.search("almanac", "company")] == [("episode", "where is the almanac")]  # found by the appended terms
    assert engine.tables["recall_events"].where("queried_by = 'agent:planner'").count() == 1


def test_the_stored_index_finds_what_the_rows_do(engine):
    t = engine.tables
    for query in ("payment retries", "parser note", "closed release", "rule small", "zzz"):
        with_, without = (se.search(t["memories"], t["episodes"], t["node_acl"], query, "company", "agent:planner", 10, indexes=i).collect() for i in (engine.indexes(t), None))
        assert with_ == without
    assert set(engine.indexes(t)) == {"memory", "episode", "lock"}


def test_failed_changes_and_read_only_stores(engine, spark, workspace):
    old = engine.store.manifest
    change = engine.store.begin()
    change.replace("node_acl", spark.createDataFrame([("a", "b", 1)], "owner_node string, reader string, granted int"))
    assert engine.store.manifest == old and engine.tables["node_acl"].count() == 0  # never committed
    assert engine.store.vacuum() and engine.store.manifest == old
    reader = Engine(spark, workspace, workspace / "store", Guard(workspace / "private"), NOW, read_only=True)
    assert reader.search("payment", "company", log=False)
    with pytest.raises(PermissionError):
        reader.missed("x", "agent:a")
    assert Engine(spark, workspace, workspace / "none", Guard(workspace / "private"), NOW, read_only=True).tables["memories"].count() == 0
    assert not (workspace / "none").exists()
    n = engine.tables["recall_events"].count()
    assert engine.store.compact(1) and engine.tables["recall_events"].count() == n and engine.store.compact(1) == []


def test_staleness(engine, workspace):
    old = datetime.fromisoformat(NOW).timestamp() - 60
    for p in workspace.rglob("*"):
        os.utime(p, (old, old))
    assert engine.stats()["stale"] is False and not any(r.stale for r in engine.brief("planner", "2026-06-19"))
    os.utime(workspace / "system/memory.md", (old + 120, old + 120))
    assert engine.stats()["stale"] is True
    assert {r.title for r in engine.brief("planner", "2026-06-19") if r.stale} == {"Retry Policy"}
    os.utime(workspace / "system/memory.md", (old, old))
    assert not engine.stale("") and not engine.stale("/no/such/file")


def test_unreadable_files_are_skipped(engine, workspace, monkeypatch):
    real = open
    monkeypatch.setattr("builtins.open", lambda p, *a, **k: (_ for _ in ()).throw(PermissionError()) if str(p).endswith("loose-end.md") else real(p, *a, **k))
    said = engine.ingest("agent-memory")
    assert [Path(p).name for p in said["skipped"]] == ["loose-end.md"] and said["files"] == 1
    assert "loose-end" in names(engine, "status = 'hot'")


def test_a_reworded_lock_is_refused(engine, workspace):
    at = workspace / "system/locks.yaml"
    good, version = at.read_text(), engine.store.manifest["version"]
    at.write_text(good.replace("Keep it small.", "Keep it large."))
    with pytest.raises(ValueError, match="first-rule"):
        engine.ingest("lock-store")
    assert engine.store.manifest["version"] == version
    at.write_text(good)
    engine.ingest("lock-store")
    assert engine.tables["locks"].where("body = 'Keep it small.'").count() == 1


def test_settings_from_the_environment_and_the_store(engine, spark, workspace, tmp_path):
    roster = tmp_path / "roster.txt"
    roster.write_text("# people\nScribe-Two\nagent:planner\n")
    c = EngineConfig.from_environment({"LARKSPUR_PRODUCTS": "Notebook=nb|notes,desk", "LARKSPUR_COMPANY_TOKENS": "firm", "LARKSPUR_ROSTER": str(roster), "LARKSPUR_AGENTS": "x", "LARKSPUR_DECAY": "0.7", "LARKSPUR_CONTEXT_BUDGET": "many"})
    assert c.products == {"notebook": ("nb", "notes"), "desk": ()} and c.company_tokens == ("firm",) and c.company_prefixes == ("feedback-",)
    assert c.agent_hints == ("planner", "scribe_two", "x") and c.decay == 0.7 and c.context_budget == 15
    e = Engine(spark, workspace, tmp_path / "store", Guard(workspace / "private"), NOW, c)
    e.ingest("team-log")
    again = Engine(spark, workspace, tmp_path / "store", Guard(workspace / "private"), NOW)
    assert again.config.decay == 0.7 and again.config.promotion_recalls == 2
    assert cli.curator_folder("/home/x/Work Space", "/notes") == "/notes/-home-x-work-space/memory" and cli.curator_folder("/w", None) is None


def test_context_items_and_promotion(engine):
    lines = engine.context("planner", "review payment retries")
    assert "Retry Policy" in [r.title for r in lines] or lines[-1].section == "nothing-specific"
    assert engine.context("planner", "zzz qqq", 5)[-1].reason in ("no-task-match", "matched-task")
    item = engine.remember("renew the key", "2026-06-25", "agent:planner")
    assert [r.id for r in engine.upcoming(30)] == [item] and engine.upcoming(1) == []
    engine.done(item)
    engine.done(item, drop=True)
    assert engine.tables["future_items"].first().status == "done"
    with pytest.raises(ValueError):
        engine.done(999)
    with pytest.raises(ValueError):
        engine.remember("x", "2026-02-30", "a")
    note = next(r.id for r in engine.tables["memories"].collect() if r.name == "parser_note")
    with pytest.raises(ValueError):
        engine.promote(note, "os", "curator")
    assert engine.promote(note, "company", "curator") and not engine.promote(note, "company", "nobody")
    audit = engine.tables["episodes"].where("kind = 'promotion'").collect()
    assert [r.summary for r in audit] == ["product:notebook -> company: parser_note"]
    engine.missed("asked for the map", "agent:planner")
    s = engine.stats()
    assert s["misses"] == 2 and s["active_locks"] == 1 and s["superseded_locks"] == 1 and s["hot"] + s["cold"] == 4
    assert len(engine.brief("planner", "2026-06-19")) > 0 and engine.timeline("2026-06-18", "2026-06-18")
    assert engine.consolidate() is not None and engine.prune_report() is not None


def test_locks(engine, workspace):
    said = engine.add_locks(
        [
            {"slug": "third-rule", "title": "Third", "scope": "product:notebook", "locked_on": "2026-02-01", "supersedes": "second-rule", "body": "b"},
            {"slug": "third-rule", "title": "Other", "scope": "os", "locked_on": "2026-02-01", "body": "b"},
            {"slug": "first-rule", "title": "First rule", "scope": "os", "locked_on": "2026-01-01", "body": "Keep it small."},
            {"slug": "Bad Slug", "title": "x", "scope": "os", "locked_on": "2026-02-01", "body": "b"},
            {"slug": "bad-day", "title": "x", "scope": "os", "locked_on": "2026-02-31", "body": "b"},
            {"slug": "bad-scope", "title": "x", "scope": "team", "locked_on": "2026-02-01", "body": "b"},
            {"slug": "no-target", "title": "x", "scope": "os", "locked_on": "2026-02-01", "supersedes": "nope", "body": "b"},
        ]
    )
    assert [(v, r) for _, v, r in said] == [
        ("accepted", "ok"), ("rejected", "duplicate-slug"), ("skipped", "already-locked"), ("rejected", "bad-slug"), ("rejected", "bad-date"), ("rejected", "bad-scope"), ("rejected", "missing-supersede-target"),
    ]
    assert lk.verdict_counts(said) == {"accepted": 1, "skipped": 1, "rejected": 5}
    assert [r.slug for r in engine.locks()] == ["third-rule"] and len(engine.locks(superseded=True)) == 3
    text, digest = engine.render_locks()
    assert "supersedes: `second-rule`" in text and engine.render_locks() == (text, digest)
    doc = f"top\n{lk.BEGIN}\nold\n{lk.END}\nend"
    assert lk.into_section(lk.into_section(doc, text), text) == lk.into_section(doc, text)
    with pytest.raises(ValueError):
        lk.into_section("no marks", text)
    assert lk.section_diff("d.md", doc, doc) == "" and "-old\n" in lk.section_diff("d.md", doc, lk.into_section(doc, text))
    assert engine.add_locks([{"slug": "fourth", "title": "F", "scope": "os", "locked_on": "2026-02-01", "body": "b"}], dry_run=True)[0][1] == "accepted"
    assert len(engine.locks(superseded=True)) == 3


def test_guard(tmp_path):
    wall = tmp_path / "private"
    wall.mkdir()
    (tmp_path / "link").symlink_to(wall)
    g = Guard(wall)
    assert g.allows(tmp_path / "notes" / "missing.md") and g.allows(tmp_path / "private-not")
    for p in (wall, wall / "a" / "b", tmp_path / "x" / ".." / "private" / "a", tmp_path / "link" / "a"):
        assert not g.allows(p)
    with pytest.raises(PathRefused):
        Guard("  ").check(tmp_path)


def test_command_line(spark, workspace, capsys, monkeypatch):
    monkeypatch.setattr("larkspur.session.build_session", lambda *a, **k: spark)
    base = ["--root", str(workspace), "--store", str(workspace / "store"), "--protected-root", str(workspace / "private"), "--now", NOW, "--json"]

    def call(*args):
        code = cli.main([*base, *args])
        return code, json.loads(capsys.readouterr().out)

    assert call("stats")[1]["memories"] == 4
    assert call("search", "payment", "--scope", "company")[1][0]["title"] == "Retry Policy"
    assert call("guard-check", str(workspace / "private/x"))[0] == 1
    assert call("lock", "list", "--all")[1][0]["slug"] == "third-rule"
    assert call("lock", "show", "nope")[0] == 1
    assert call("related", "parser_note")[1] == []
    assert call("lock", "render")[1]["sha256"]
    note = write(workspace, "system/decisions.md", f"top\n{lk.BEGIN}\nold\n{lk.END}\nend\n")
    code, said = call("lock", "render", "--into", str(note), "--check")
    assert code == 1 and "-old" in said["diff"] and call("lock", "render", "--into", str(note))[1]["changed"]
    assert call("lock", "render", "--into", str(note), "--check") == (0, {"sha256": said["sha256"], "changed": False, "diff": ""})

    def text(*args):
        assert cli.main([x for x in base if x != "--json"] + list(args)) == 0
        return capsys.readouterr().out.splitlines()

    assert text("search", "payment", "--scope", "company")[0].startswith("memory ") and "rank -1.000" in text("ask", "shared", "payment")[0]
    assert any(x.endswith("(supersedes second-rule)") for x in text("lock", "list", "--all")) and text("related", "parser_note") == ["nothing found"]
    assert "memories: 4" in text("stats") and text("lock", "render")[0] == "# Active decisions"
    assert all(x.split()[1].startswith("[") and "scope" in x for x in text("context", "planner", "payment retries")) and "[active-lock]" in text("brief", "planner")[0]
    for line in ("timeline --from 2026-06-18", "upcoming", "consolidate", "prune-report", "lock show third-rule"):
        assert text(*line.split())
    reset = call("ingest", "--reset")[1]["reset"]
    assert reset["promotion_audits_dropped"] == 1 and reset["misses_kept"] == 2
    for line in ("today", "yesterday", "upcoming", "brief planner", "consolidate", "prune-report", "timeline --from 2026-06-18", "ask planner parser"):
        assert call(*line.split())[0] == 0
    assert cli.parser().parse_args(["--root", "x", "ingest", "--reset", "--force"]).force
    with pytest.raises(SystemExit):
        cli.run(cli.parser().parse_args(["--protected-root", "/p", "--root", "", "stats"]))
    assert os.path.exists(workspace / "store" / "manifest.json")
