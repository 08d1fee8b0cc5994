"""A plain, row-at-a-time reading of stamps, to hold the vectorised one against."""

import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, available_timezones

ZONES = {z.lower(): z for z in available_timezones()}
HOURS = {"utc": 0, "gmt": 0, "z": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7, "cet": 1, "cest": 2, "bst": 1, "eet": 2, "eest": 3, "jst": 9, "aest": 10, "aedt": 11}
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
DATES = ["%d %b %Y", "%d %B %Y", "%b %d, %Y", "%B %d, %Y", "%a, %d %b %Y"]


def read(stamp, order="ymd", zone="UTC"):
    """Microseconds since 1970 UTC, or None."""
    if stamp is None:
        return None
    s = stamp.strip().lower()
    if re.fullmatch(r"[0-9]{10}(\.[0-9]+)?", s):
        sec, _, frac = s.partition(".")
        return int(sec) * 10**6 + int((frac + "000000")[:6])
    if re.fullmatch(r"[0-9]{13}", s):
        return int(s) * 1000
    offset = None
    if m := re.search(r"\s*\[([a-z_/]+)\]$", s):
        zone, s = ZONES.get(m[1]), s[: m.start()]
    elif (m := re.search(r"\s([a-z_]+/[a-z_/]+)$", s)):
        zone, s = ZONES.get(m[1]), s[: m.start()]
    if zone is None:
        return None
    if m := re.search(r"(?<=[0-9:m])\s*([+-])([0-9]{2}):?([0-9]{2})?$", s):
        if ":" in s[: m.start()]:
            offset = timedelta(hours=int(m[2]), minutes=int(m[3] or 0)) * (-1 if m[1] == "-" else 1)
            s = s[: m.start()]
    if offset is None and (m := re.search(r"(?:(?<=[0-9])\s?|(?<=[ap]m)\s)(z|[a-z]{3,4})$", s)):
        if m[1] not in HOURS:
            return None
        offset, s = timedelta(hours=HOURS[m[1]]), s[: m.start()]
    micro = 0
    if m := re.search(r"(?<=:[0-9]{2})[.,]([0-9]+)", s):
        micro = int((m[1] + "000000")[:6])
        s = s[: m.start()] + s[m.end() :]
    time = timedelta(0)
    if m := re.search(r"[t ]([0-9]{1,2}):([0-9]{2})(:([0-9]{2}))?\s?(am|pm)?$", s):
        h, mi, sec = int(m[1]), int(m[2]), int(m[4] or 0)
        if m[5]:
            if not 1 <= h <= 12:
                return None
            h = h % 12 + 12 * (m[5] == "pm")
        if h > 23 or mi > 59 or sec > 59:
            return None
        time, s = timedelta(hours=h, minutes=mi, seconds=sec), s[: m.start()]
    elif m := re.fullmatch(r"([0-9]{8})t([0-9]{2})([0-9]{2})([0-9]{2})?", s):
        h, mi, sec = int(m[2]), int(m[3]), int(m[4] or 0)
        if h > 23 or mi > 59 or sec > 59:
            return None
        time, s = timedelta(hours=h, minutes=mi, seconds=sec), m[1]
    day = None
    if m := re.fullmatch(r"([0-9]{4})-([0-9]{2})-([0-9]{2})|([0-9]{4})([0-9]{2})([0-9]{2})", s):
        parts = [int(x) for x in m.groups() if x]
    elif m := re.fullmatch(r"([0-9]{4})[/.]([0-9]{1,2})[/.]([0-9]{1,2})", s):
        parts = [int(x) for x in m.groups()]
    elif m := re.fullmatch(r"([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{4})", s):
        if order == "ymd":
            return None
        a, b, y = (int(x) for x in m.groups())
        parts = [y, a, b] if order == "mdy" else [y, b, a]
    else:
        parts = None
        for f in DATES:
            try:
                day = datetime.strptime(s, f)
                break
            except ValueError:
                pass
    try:
        day = day or datetime(*parts)
    except (ValueError, TypeError):
        return None
    wall = day + time
    at = wall.replace(tzinfo=UTC) - offset if offset is not None else wall.replace(tzinfo=ZoneInfo(zone)).astimezone(UTC)
    return round((at - EPOCH).total_seconds()) * 10**6 + micro
