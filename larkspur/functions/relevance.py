"""How well a row fits a task: share of terms, and the stricter rules of the relevance floor.

Rules are SQL texts over the columns that :func:`prepared` adds once per row, with a task's terms as
literals, so that a plan is built from a few expressions however many terms a task has, and all of
them stay inside generated code. Terms consist of ASCII letters, digits, ``-`` and ``_``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import CORE_RULES, SIGNALS, SYNONYMS, TESTING

#: What a task without signal terms scores from half of its terms on, and a lone test signal in a title.
LEVEL = 0.66


def prepared(rows: DataFrame, name: str = "name", title: str = "title", body: str = "body") -> DataFrame:
    """``rows`` with the texts that the rules look into: ``_text`` (all), ``_frame`` (name and body) and
    ``_head`` (name and title). The arguments are SQL expressions."""
    put = lambda *parts: F.expr("concat_ws(chr(10), " + ", ".join(f"coalesce({p}, '')" for p in parts) + ")")
    return rows.withColumns({"_text": put(name, title, body), "_frame": put(name, body), "_head": put(name, title)})


def _holds(text: str, words) -> str:
    """Whether one of the words stands in the text, in any (ASCII) case, also inside a longer word."""
    return f"{text} rlike '(?i){'|'.join(words)}'" if words else "false"


def _has(text: str, words) -> str:
    """Whether one of the words is a whole run of ASCII letters and digits of the text, in any (ASCII) case."""
    whole = [w for w in words if re.fullmatch("[a-z0-9]+", w)]
    return f"{text} rlike '(?i)(?<![a-z0-9])(?:{'|'.join(whole)})(?![a-z0-9])'" if whole else "false"


def _count(tests: list[str]) -> str:
    return "(" + (" + ".join(f"if({t}, 1, 0)" for t in tests) or "0") + ")"


def _any(tests: list[str]) -> str:
    return "(" + (" OR ".join(tests) or "false") + ")"


def lexical(terms: list[str]) -> str:
    """Share of terms that the text holds anywhere, themselves or a synonym."""
    if not terms:
        return "0D"
    return f"{_count([_holds('_text', (t, *SYNONYMS.get(t, ()))) for t in terms])} / {len(terms)}D"


def _accepted(term: str) -> tuple[str, ...]:
    own = () if term == "test" else (term,)
    return (*own, *SYNONYMS.get(term, ()))


def _in_title(term: str) -> tuple[str, ...]:
    return ("tests", "testing", "pytest") if term in TESTING else _accepted(term)


def floor_relevance(terms: list[str]) -> str:
    """What is held against the relevance floor: whole tokens count, not parts of words.

    With signal terms (kinds of work) only these count: two or more give their share; exactly one
    gives LEVEL if a testing term stands in name or title, else nothing.
    """
    if not terms:
        return "0D"
    signals = [t for t in terms if t in SIGNALS]
    matched = _count([_has('_text', _accepted(t)) for t in signals or terms])
    share = f"{matched} / {len(signals or terms)}D"
    if not signals:
        return f"if({share} >= 0.5D, {LEVEL}D, {share})"
    test = _any([_has('_head', _in_title(t)) for t in signals if t in TESTING])
    return f"CASE WHEN {matched} >= 2 THEN {share} WHEN {matched} = 1 AND {test} THEN {LEVEL}D ELSE 0D END"


def passes_floor(terms: list[str], floor: float) -> str:
    """Whether :func:`floor_relevance` is at least ``floor`` (above 0), with each term looked for once."""
    signals = [t for t in terms if t in SIGNALS]
    n = len(signals or terms)
    matched = _count([_has("_text", _accepted(t)) for t in signals or terms])
    enough = lambda value, least: next((m for m in range(least, n + 1) if value(m) >= floor), n + 1)
    if not signals:
        return f"{matched} >= {enough(lambda m: LEVEL if m / n >= 0.5 else m / n, 1)}"
    least = enough(lambda m: m / n, 2)
    if least == 2 and floor <= LEVEL:
        lone = _any([_has("_head", _in_title(t)) for t in signals if t in TESTING])
        return f"{matched} >= if({lone}, 1, 2)"
    lone = _any([_has("_head", _in_title(t)) for t in signals if t in TESTING]) if floor <= LEVEL else "false"
    return f"({matched} >= {least} OR ({matched} = 1 AND {lone}))"


def tail_strong(terms: list[str]) -> str:
    """Whether a row without a rule's standing may enter a pack: no signal terms in the task, or two
    of them in the row and one in its name or title."""
    signals = [t for t in terms if t in SIGNALS]
    if not signals:
        return "true"
    return f"({_count([_has('_text', _accepted(t)) for t in signals])} >= 2 AND {_any([_has('_head', _in_title(t)) for t in signals])})"


def is_core() -> str:
    """Whether a row is one of the rules every reader sees: its name or text holds the rule's slug."""
    return _holds("_frame", CORE_RULES)


def matches_any(terms: list[str]) -> str:
    return _holds("_text", terms) if terms else "true"
