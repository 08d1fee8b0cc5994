"""Versioned transition tables of time zones.

A table is derived from the public zone database by a rule: probe the offset day by day, bisect
each change to the second. It is built once per zone and process and applied to whole arrays.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from functools import lru_cache
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo, available_timezones

import numpy as np

#: First and last year of the tables; local times outside are converted one by one.
YEARS = (1960, 2080)
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


@lru_cache(1)
def database_version() -> str:
    """The release of the zone database in use (``unknown`` if it does not say)."""
    for root in TZPATH:
        for name in ("tzdata.zi", "+VERSION", "version"):
            p = Path(root, name)
            if p.is_file():
                return p.open(errors="replace").readline().replace("# version", "").strip()
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@lru_cache(1)
def zone_names() -> dict[str, str]:
    """Lower-case zone name to its IANA spelling."""
    return {n.lower(): n for n in available_timezones()}


def _offset(zone: ZoneInfo, t: int) -> int:
    return int((EPOCH + timedelta(seconds=t)).astimezone(zone).utcoffset().total_seconds())


@lru_cache(700)
def transitions(name: str) -> tuple[np.ndarray, np.ndarray]:
    """``(switch, offset)``: a local wall second w (as if it were UTC) has the offset
    ``offset[searchsorted(switch, w, "right")]``.

    At a change at T from offset a to b the new offset holds from wall time T + max(a, b) on, so
    skipped and repeated wall times are both read with the offset before the change.
    """
    zone = ZoneInfo(name)
    day = 86400
    first, last = (int((datetime(y, 1, 1, tzinfo=UTC) - EPOCH).total_seconds()) for y in YEARS)
    switch, offsets = [], [_offset(zone, first)]
    t = first
    while t < last:
        if (b := _offset(zone, t + day)) != (a := offsets[-1]):
            lo, hi = t, t + day
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if _offset(zone, mid) == a else (lo, mid)
            switch.append(hi + max(a, b))
            offsets.append(b)
        t += day
    return np.array(switch, np.int64), np.array(offsets, np.int64)


def wall_to_utc(wall: np.ndarray, name: str) -> np.ndarray:
    """UTC seconds of local wall seconds in zone ``name``."""
    switch, offsets = transitions(name)
    out = wall - offsets[np.searchsorted(switch, wall, "right")]
    lo, hi = (int((datetime(y, 1, 2, tzinfo=UTC) - EPOCH).total_seconds()) for y in YEARS)
    for k in np.flatnonzero((wall < lo) | (wall > hi - 3 * 86400)):
        naive = EPOCH.replace(tzinfo=None) + timedelta(seconds=int(wall[k]))
        out[k] = wall[k] - int(naive.replace(tzinfo=ZoneInfo(name)).utcoffset().total_seconds())
    return out
