"""The wall around private paths, checked on the driver before anything is read."""

from __future__ import annotations

import os
from pathlib import Path


class PathRefused(PermissionError):
    """A path lies under a protected root, or no root was named at all."""


class Guard:
    """Refuses protected roots and all below them, by the path as written and as resolved.

    Without a root every access is refused: a missing setting must not open the wall.
    """

    def __init__(self, protected: str | os.PathLike | None):
        text = str(protected or "").strip()
        self.root = Path(os.path.abspath(text)) if text else None

    @property
    def roots(self) -> list[Path]:
        return [] if self.root is None else list(dict.fromkeys([self.root, self.root.resolve()]))

    def check(self, path: str | os.PathLike) -> Path:
        """The resolved path (a missing tail kept as written), or PathRefused."""
        if self.root is None:
            raise PathRefused("no protected root is set; every file access is refused")
        written = Path(os.path.abspath(path))  # resolves .. in the text only
        resolved = written.resolve(strict=False)  # follows links of the part that exists
        for p in (written, resolved):
            for r in self.roots:
                if p == r or r in p.parents:
                    raise PathRefused(f"{p} is under the protected root {r}")
        return resolved

    def allows(self, path: str | os.PathLike) -> bool:
        try:
            self.check(path)
        except PathRefused:
            return False
        return True

    def verdict(self, path: str | os.PathLike) -> dict:
        try:
            return {"path": str(path), "allowed": True, "resolved": str(self.check(path)), "reason": None}
        except PathRefused as e:
            return {"path": str(path), "allowed": False, "resolved": None, "reason": str(e)}
