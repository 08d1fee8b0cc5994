"""Stamps of mixed forms, precisions and zones to one instant in UTC.

Each distinct stamp is reduced to its shape mask (digits to ``9``, letters to ``a``). A mask is
mapped to a parser once; the parser then converts all stamps of that mask together: fields are cut
at fixed places out of a code-point matrix, dates and offsets are computed on arrays, and local
times go through transition tables (:mod:`larkspur.functions.zones`).
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.zones import wall_to_utc, zone_names

# English month and weekday names; the offsets of zone abbreviations in minutes.
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "ist": 330, "sgt": 480, "hkt": 480, "awst": 480, "jst": 540, "kst": 540, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
    "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}

MONTH_OF = {n[:k]: i + 1 for i, n in enumerate(MONTHS) for k in (3, len(n))} | {"sept": 9}
WEEKDAY_OF = {n[:k]: i for i, n in enumerate(WEEKDAYS) for k in (3, len(n))}

_TIME = r"(?P<h>99?):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?(?P<mer> ?aa(?![a/_]))?"
_ZONE = r"(?: ?(?:(?P<off>[+-](?:99:?99|99))|(?P<abbr>a+)(?![a/_])|(?P<name>a+(?:[/_+-][a9]+)+)))?(?: ?\[(?P<br>[a9/_+-]+)\])?"
_FORMS = [
    r"(?P<y>9999)-(?P<m>99)-(?P<d>99)(?:(?P<sep>[a ]) ?" + _TIME + _ZONE + ")?",
    r"(?P<n1>9{1,4})(?P<dl>[/.])(?P<n2>99?)(?P=dl)(?P<n3>9{1,4})(?:(?P<sep>[a ]) ?" + _TIME + _ZONE + ")?",
    r"(?P<y>9999)(?P<m>99)(?P<d>99)(?:(?P<sep>[a ])(?P<h>99)(?P<mi>99)(?:(?P<s>99)(?:[.,](?P<f>9+))?)?" + _ZONE + ")?",
    r"(?P<sec>9{10})(?:\.(?P<f>9+))?",
    r"(?P<ms>9{13})",
    r"(?:(?P<wd>a+), ?)?(?P<d>99?) (?P<mon>a+) (?P<y>9999)(?:(?P<sep>[a ]) ?" + _TIME + _ZONE + ")?",
    r"(?:(?P<wd>a+), ?)?(?P<mon>a+) (?P<d>99?), ?(?P<y>9999)(?:(?P<sep>[a ]) ?" + _TIME + _ZONE + ")?",
]
FORMS = [re.compile(x) for x in _FORMS]
_MASK = {c: "9" for c in range(48, 58)} | {c: "a" for c in range(97, 123)}


def mask_of(stamp: str) -> str:
    """The shape of a stripped, lower-case stamp."""
    return stamp.translate(_MASK)


@lru_cache(20_000)
def parser_of(mask: str) -> dict[str, tuple[int, int]] | None:
    """Field name to its place, or None for a shape that names no date and time."""
    for form in FORMS:
        if m := form.fullmatch(mask):
            return {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of proleptic Gregorian dates."""
    months = (y - 1970) * 12 + m - 1
    return months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + d - 1


def _month_length(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    one = np.ones_like(y)
    return _days(y + m // 12, m % 12 + 1, one) - _days(y, m, one)


def convert(stamps: list[str], fields: dict[str, tuple[int, int]], orders: np.ndarray, zones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(microseconds since 1970 UTC, readable)`` of stamps of one shape.

    ``orders`` (ymd / mdy / dmy) and ``zones`` (IANA names) say how a numeric date and a time
    without zone are to be read, stamp by stamp.
    """
    n = len(stamps)
    text = np.array(stamps)
    codes = np.ascontiguousarray(text).view(np.uint32).reshape(n, -1)
    ok = np.ones(n, bool)
    zero = np.zeros(n, np.int64)

    def number(name: str, digits: int | None = None) -> np.ndarray:
        if name not in fields:
            return zero
        a, b = fields[name]
        b = min(b, a + digits) if digits else b
        v = zero.copy()
        for k in range(a, b):
            v = v * 10 + (codes[:, k].astype(np.int64) - 48)
        return v * 10 ** (digits - (b - a)) if digits else v

    def looked_up(name: str, values: dict[str, int], clean=str) -> np.ndarray:
        a, b = fields[name]
        part = np.array([s[a:b] for s in stamps])
        kinds, at = np.unique(part, return_inverse=True)
        got = [values.get(clean(k)) for k in kinds]
        ok[:] &= np.array([g is not None for g in got])[at]
        return np.array([0 if g is None else g for g in got], np.int64)[at]

    micro = number("f", 6)
    if "sec" in fields:
        return number("sec") * 1_000_000 + micro, ok
    if "ms" in fields:
        return number("ms") * 1000, ok
    if "n1" in fields:
        n1, n2, n3 = number("n1"), number("n2"), number("n3")
        width = [fields[k][1] - fields[k][0] for k in ("n1", "n2", "n3")]
        order = np.full(n, "ymd") if width[0] == 4 else orders
        ymd, mdy, dmy = (order == k for k in ("ymd", "mdy", "dmy"))
        ok &= (ymd & (width[0] == 4) & (width[2] <= 2)) | ((mdy | dmy) & (width[0] <= 2) & (width[2] == 4))
        y, m, d = np.where(ymd, n1, n3), np.where(mdy, n1, n2), np.where(ymd, n3, np.where(mdy, n2, n1))
    else:
        y, d = number("y"), number("d")
        m = looked_up("mon", MONTH_OF) if "mon" in fields else number("m")
        if "wd" in fields:
            looked_up("wd", WEEKDAY_OF)
    if "sep" in fields:
        a = fields["sep"][0]
        ok &= (codes[:, a] == ord("t")) | (codes[:, a] == ord(" "))
    ok &= (y >= 1) & (m >= 1) & (m <= 12)
    y, m = np.where(ok, y, 1970), np.where(ok, m, 1)
    ok &= (d >= 1) & (d <= _month_length(y, m))
    h, mi, s = number("h"), number("mi"), number("s")
    off, given = zero, np.zeros(n, bool)
    if "mer" in fields:
        pm = looked_up("mer", {"am": 0, "pm": 1}, str.strip)
        ok &= (h >= 1) & (h <= 12)
        h = h % 12 + 12 * pm
    ok &= (h <= 23) & (mi <= 59) & (s <= 59)
    if "off" in fields:
        a, b = fields["off"]
        digits = [k for k in range(a + 1, b) if not (codes[:, k] == 58).all()]
        v = [codes[:, k].astype(np.int64) - 48 for k in digits]
        hours, minutes = v[0] * 10 + v[1], v[2] * 10 + v[3] if len(v) == 4 else zero
        ok &= (hours <= 18) & (minutes <= 59)
        off = (hours * 60 + minutes) * np.where(codes[:, a] == 45, -1, 1)
        given[:] = True
    elif "abbr" in fields:
        off = looked_up("abbr", ABBREVIATIONS)
        given[:] = True
    wall = _days(y, m, np.where(ok, d, 1)) * 86400 + h * 3600 + mi * 60 + s
    named = zones
    place = "name" if "name" in fields else "br" if "br" in fields else None
    if place:
        a, b = fields[place]
        known = {k: v for k in {s[a:b] for s in stamps} if (v := zone_names().get(k))}
        ok &= np.array([s[a:b] in known for s in stamps])
        named = np.array([known.get(s[a:b], "UTC") for s in stamps], object)
    utc = wall - off * 60
    if not given.all():
        for z in pd.unique(named):
            k = np.flatnonzero((named == z) & ok)
            if len(k) and z != "UTC":
                utc[k] = wall_to_utc(wall[k], z)
    return utc * 1_000_000 + micro, ok


def to_utc_us(stamps: list[str | None], orders: list[str], zones: list[str]) -> list[int | None]:
    """Microseconds since 1970 UTC of each stamp; None where it is null or not readable."""
    out: list[int | None] = [None] * len(stamps)
    groups: dict[str, list[int]] = {}
    tidy = [None if s is None else s.strip().lower() for s in stamps]
    for k, s in enumerate(tidy):
        if s:
            groups.setdefault(mask_of(s), []).append(k)
    for mask, at in groups.items():
        fields = parser_of(mask)
        if fields is None:
            continue
        us, ok = convert([tidy[k] for k in at], fields, np.array([orders[k] for k in at], object), np.array([zones[k] for k in at], object))
        for k, v, good in zip(at, us.tolist(), ok.tolist()):
            if good:
                out[k] = v
    return out


def normaliser(roots: list[tuple[str, str]]):
    """A vectorised UDF (stamp, root number) -> microseconds; ``roots[i]`` is (zone, date order)
    and -1 stands for UTC and year first."""

    @F.pandas_udf("bigint")
    def utc_us(stamp: pd.Series, root: pd.Series) -> pd.Series:
        # one conversion per distinct (stamp, root) of the batch
        pairs = pd.MultiIndex.from_arrays([stamp.fillna("").astype(object), root.fillna(-1).astype("int64")])
        codes, kinds = pairs.factorize()
        s = [k[0] for k in kinds]
        where = [roots[k[1]] if k[1] >= 0 else ("UTC", "ymd") for k in kinds]
        got = pd.array(to_utc_us(s, [w[1] for w in where], [w[0] for w in where]), dtype="Int64")
        return pd.Series(got[codes])

    return utc_us


def root_number(path: Column, prefixes: list[str]) -> Column:
    """Number of the longest prefix that ``path`` starts with, -1 without one or for a null path."""
    out = F.lit(-1)
    for k, p in sorted(enumerate(prefixes), key=lambda x: len(x[1])):
        out = F.when(path.startswith(p), F.lit(k)).otherwise(out)
    return out


def read_roots(source_roots: DataFrame, most: int = 1000) -> tuple[list[str], list[tuple[str, str]]]:
    """Prefixes and their (zone, date order). The table describes sources and is small and fixed;
    more than ``most`` rows is an error rather than a silent cut."""
    rows = source_roots.select("root_path", "zone_name", "date_order").dropna().distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} source roots")
    rows.sort(key=lambda r: r.root_path)
    return [r.root_path for r in rows], [(r.zone_name, r.date_order) for r in rows]


def with_utc(rows: DataFrame, stamp: str, path: str | None, source_roots: DataFrame | None, out: str = "utc_us") -> DataFrame:
    """``rows`` with ``out``, the instant of column ``stamp`` in microseconds since 1970 UTC.

    Null, empty and unreadable stamps give null; the row stays. Without ``path`` or a matching root
    a stamp without zone is read as UTC and an all-numeric date year first.
    """
    prefixes, roots = read_roots(source_roots) if path and source_roots is not None else ([], [])
    number = root_number(F.col(path), prefixes) if path else F.lit(-1)
    return rows.withColumn(out, normaliser(roots)(F.col(stamp), number.cast("bigint")))


def month_of(stamp: str) -> Column:
    """``yyyy-MM`` (UTC) of a stamp column of any form, null where not readable."""
    us = normaliser([])(F.col(stamp), F.lit(-1).cast("bigint"))
    return F.date_format(F.timestamp_micros(us), "yyyy-MM")


#: How a stamp that needs no work is written, by table.
CLEAN = {"instant": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\+00:00$", "date": r"^\d{4}-\d{2}-\d{2}$"}


def restamped(rows: DataFrame, tbl: str, stamp: str, path: str | None, source_roots: DataFrame | None, clean: str) -> DataFrame:
    """``tbl, rec_id, utc_us`` of the records whose stamp is readable but not written as ``clean`` says."""
    odd = rows.select(F.col("id").alias("rec_id"), F.col(stamp).alias("stamp"), (F.col(path) if path else F.lit(None).cast("string")).alias("path")).where(~F.col("stamp").rlike(CLEAN[clean]))
    got = with_utc(odd, "stamp", "path" if path else None, source_roots)
    return got.where("utc_us is not null").select(F.lit(tbl).alias("tbl"), F.col("rec_id").cast("bigint").alias("rec_id"), "utc_us")


def restamp_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Problem 3 over episodes.ts, memories.created_at and locks.locked_on; repeated rows once."""
    roots = tables["source_roots"]
    parts = [
        restamped(tables["episodes"], "episodes", "ts", "source_path", roots, "instant"),
        restamped(tables["memories"], "memories", "created_at", "source_path", roots, "instant"),
        restamped(tables["locks"], "locks", "locked_on", None, None, "date"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def normalised_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """``tbl, rec_id, stamp, utc_us`` of every record of the three tables, repeated rows once.

    A null or unreadable stamp has a null instant; stamps already written as wanted count too.
    """
    roots = tables["source_roots"]
    parts = []
    for tbl, stamp, path in (("episodes", "ts", "source_path"), ("memories", "created_at", "source_path"), ("locks", "locked_on", None)):
        rows = tables[tbl].select(F.lit(tbl).alias("tbl"), F.col("id").cast("bigint").alias("rec_id"), F.col(stamp).alias("stamp"), (F.col(path) if path else F.lit(None).cast("string")).alias("path")).distinct()
        parts.append(with_utc(rows, "stamp", "path" if path else None, roots).drop("path"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
