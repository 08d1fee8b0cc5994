"""Terms, tokens, slugs and other text rules, for driver-side strings and for columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no search terms, words that mark a kind of work, their synonyms, the
# rules every reader sees, and the marks of confidence.
STOPWORDS = frozenset("a an and are as at for from how in is of on or the to was what with write".split())
SIGNALS = frozenset("add build clean debug deploy fix implement launch python review ship test testing tests tweet write".split())
TESTING = frozenset("test testing tests".split())
SYNONYMS = {
    "launch": ("pitch", "public", "opening", "grand"),
    "python": ("pytest", "ruff"),
    "test": ("tests", "testing", "pytest", "coverage"),
    "testing": ("tests", "testing", "pytest", "coverage"),
    "tests": ("tests", "testing", "pytest", "coverage"),
    "tweet": ("social", "copy", "ads", "email"),
}
CORE_RULES = ("actor-lanes", "ground-rule-no-hallucination", "memory-security-boundaries", "zero-manual-cli", "quality-bar-language-parity")
MARKS = ("✅", "🤔", "❓")

#: Letters with a diacritic and their plain letter, position by position.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def _parts(c: Column, separator: str) -> Column:
    return F.filter(F.split(c, separator), lambda t: t != "")


def index_tokens(c: Column) -> Column:
    """Full-text tokens: runs of letters and digits, case-folded, without diacritics."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(c, F.lit(""))), ACCENTED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def ascii_tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits, lower case."""
    return _parts(ascii_lower(c), "[^a-z0-9]+")


def search_terms(query: str) -> list[str]:
    """Terms of a search: at most 8 runs of ASCII letters and digits that are no stop words, once each."""
    kept = [t for t in re.split("[^A-Za-z0-9]+", query) if len(t) >= 2 and t.lower() not in STOPWORDS]
    return list(dict.fromkeys(t.lower() for t in kept[:8]))


def task_terms(task: str) -> list[str]:
    """Terms of a task: as for a search, but with inner ``-`` and ``_``, at most 12, repeats kept."""
    kept = [t for t in re.split("[^A-Za-z0-9_-]+", task) if len(t) >= 2 and t.lower() not in STOPWORDS]
    return [t.lower() for t in kept[:12]]


def slug(text: str) -> str:
    return re.sub("[^a-z0-9]+", "-", text.lower()).strip("-") or "untitled"


def slugify(c: Column) -> Column:
    s = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", "untitled").otherwise(s)


def wiki_targets(c: Column) -> Column:
    """Sorted distinct slugs of ``[[target|label]]`` links; links without a target give none."""
    inner = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[\[([^\]|]+)[^\]]*\]\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(inner, slugify)))


def single_line(text: str, most: int = 260) -> str:
    return " ".join(text.split())[:most]


def marks(c: Column) -> Column:
    """The confidence marks a text shows, in their fixed order."""
    return F.filter(F.array(*[F.lit(m) for m in MARKS]), lambda m: c.contains(m))


def agent_name(name: str) -> str:
    bare = name.strip().removeprefix("@").lower()
    return bare if bare.startswith("agent:") else f"agent:{bare}"


def content_hash(title: Column, body: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *[F.coalesce(x, F.lit("")) for x in (title, body, path)]), 256)


def any_of(values, test) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | test(v)
    return out


def count_of(values, test) -> Column:
    """How many of the driver-side ``values`` pass a column test."""
    out = F.lit(0)
    for v in values:
        out = out + F.when(test(v), 1).otherwise(0)
    return out
