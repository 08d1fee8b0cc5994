"""Where a workspace keeps its notes and logs, and the guarded list of files to read."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from larkspur.config import EngineConfig
from larkspur.sources.guard import Guard


@dataclass(frozen=True)
class Source:
    """A named place: a file, or the Markdown files of a directory (``deep``: and below it)."""

    name: str
    place: str
    deep: bool = False
    kind: str = "episodes"
    episode_kind: str = "ticket"


# The places of a workspace.
ROSTER = [
    Source("system-memory", "system/memory.md", kind="sections"),
    Source("team-log", "system/TEAM_LOG.md", kind="log", episode_kind="team-log"),
    Source("handoffs", "system/handoffs", episode_kind="handoff"),
    Source("archivist-reports", "system/inbox/archivist-reports", True, episode_kind="archivist-report"),
    Source("agent-to-agent", "system/inbox/agent-to-agent", True, episode_kind="agent-to-agent"),
    Source("processed-tickets", "system/inbox/builder-code/processed", True, episode_kind="ticket"),
    Source("agent-memory", "memory", kind="notes"),
    Source("lock-store", "system/locks.yaml", kind="locks"),
]


def _markdown(folder: Path, deep: bool) -> list[Path]:
    return [p for p in folder.glob("**/*.md" if deep else "*.md") if p.is_file()] if folder.is_dir() else []


def discover(root: str | Path, guard: Guard, config: EngineConfig = EngineConfig(), only: str | None = None, extra: str | Path | None = None, curator: str | Path | None = None) -> list[tuple[Source, Path]]:
    """The files to read, by path: those of the roster that exist, of an extra directory (all Markdown
    below it) and of a curator directory. The guard is asked about every place before it is listed
    and about every file found."""
    root = Path(root)
    places = list(ROSTER)
    if extra is not None:
        places.append(Source("extra", str(extra), True, kind="mixed"))
    if curator is not None:
        places.append(Source("curator-memory", str(curator), kind="notes"))
    out: list[tuple[Source, Path]] = []
    for s in places:
        if (config.sources and s.name not in config.sources and s.name != "extra") or (only and s.name != only):
            continue
        at = root / s.place
        if not guard.allows(at):
            continue
        if s.name == "agent-memory":
            found = [p for p in at.glob("*/*.md") if p.is_file()] if at.is_dir() else []
        elif at.suffix:
            found = [at] if at.is_file() else []
        else:
            found = _markdown(at, s.deep)
        out += [(s, p) for p in found if guard.allows(p)]
    return sorted(out, key=lambda x: str(x[1]))
