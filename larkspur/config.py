"""Engine settings: one immutable value handed to every operator that needs it."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import ClassVar


@dataclass(frozen=True)
class EngineConfig:
    """Tunables with their defaults. Weights outside (0, 1] fall back to the default."""

    decay: float = 0.5
    hot_threshold: float = -1.6
    episode_weight: float = 0.55
    match_floor: float = 0.50
    context_budget: int = 15
    context_floor: float = 0.66
    promotion_recalls: int = 2
    products: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"notebook": (), "console": (), "voice": ()})
    company_tokens: tuple[str, ...] = ("company", "organization", "team")
    company_prefixes: tuple[str, ...] = ("feedback-",)
    agent_hints: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()

    def __post_init__(self):
        for name in ("episode_weight", "match_floor"):
            if not 0 < getattr(self, name) <= 1:
                object.__setattr__(self, name, type(self).__dataclass_fields__[name].default)

    #: What a store keeps with its data and gives back when it is opened.
    STORED: ClassVar = ("decay", "hot_threshold", "episode_weight", "match_floor", "context_budget", "context_floor", "promotion_recalls")

    def settings(self) -> dict[str, float]:
        return {n: getattr(self, n) for n in self.STORED}

    def with_settings(self, stored: Mapping) -> EngineConfig:
        """These settings with the stored tunables; one that can't be read as its type keeps its value."""
        read = {}
        for n in self.STORED:
            try:
                read[n] = type(getattr(self, n))(stored[n])
            except (KeyError, TypeError, ValueError):
                pass
        return replace(self, **read)

    @classmethod
    def from_environment(cls, env: Mapping[str, str]) -> EngineConfig:
        """Lists are written with commas; LARKSPUR_PRODUCTS as ``name=alias|alias,name``; LARKSPUR_ROSTER
        names a file of agents, a JSON list or a name per line."""
        listed = lambda key: tuple(x.strip() for x in env.get(key, "").split(",") if x.strip())
        known = {"sources": listed("LARKSPUR_SOURCES")}
        if listed("LARKSPUR_PRODUCTS"):
            parts = [x.partition("=") for x in listed("LARKSPUR_PRODUCTS")]
            known["products"] = {p.strip().lower(): tuple(a.strip().lower() for a in aliases.split("|") if a.strip()) for p, _, aliases in parts}
        for name, key in (("company_tokens", "LARKSPUR_COMPANY_TOKENS"), ("company_prefixes", "LARKSPUR_COMPANY_PREFIXES")):
            if listed(key):
                known[name] = tuple(x.lower() for x in listed(key))
        agents = list(listed("LARKSPUR_AGENTS"))
        if env.get("LARKSPUR_ROSTER"):
            text = Path(env["LARKSPUR_ROSTER"]).read_text()
            agents += json.loads(text) if text.lstrip().startswith("[") else [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
        known["agent_hints"] = tuple(sorted({a.strip().removeprefix("agent:").lower().replace("-", "_") for a in agents}))
        for n in cls.STORED:
            if env.get(f"LARKSPUR_{n.upper()}"):
                known |= {n: getattr(cls().with_settings({n: env[f"LARKSPUR_{n.upper()}"]}), n)}
        return cls(**known)
