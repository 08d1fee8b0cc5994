"""Markdown notes, logs and headers to rows, in column expressions.

Inputs have ``key`` and ``text``. Null texts give no rows. Windows line ends count as line ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.config import EngineConfig
from larkspur.functions.text import any_of, ascii_lower, ascii_tokens, slugify

# What marks a section as a decision.
LOCK_WORDS = ("LOCKED", "non-negotiable", "NON-NEGOTIABLE")
DEFAULTS = EngineConfig()


def _unix(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def _text_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(_unix(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def sections(docs: DataFrame) -> DataFrame:
    """``key, ordinal, title, body, is_lock``: the ``## `` sections with a body; what stands before the
    first heading is no section."""
    parts = F.split(F.concat(F.lit("\n"), _unix(F.col("text"))), "\n## ")
    each = docs.select("key", F.posexplode(parts).alias("ordinal", "part")).where("ordinal > 0")
    title = F.trim(F.substring_index("part", "\n", 1))
    body = F.regexp_replace(F.expr("substr(part, length(substring_index(part, '\\n', 1)) + 2)"), r"^\s+|\s+$", "")
    out = each.select("key", F.col("ordinal").cast("bigint").alias("ordinal"), title.alias("title"), body.alias("body")).where("body <> ''")
    lock = any_of(LOCK_WORDS, lambda w: F.col("title").contains(w) | F.col("body").contains(w)) | F.col("title").contains("locked")
    return out.withColumn("is_lock", lock.cast("int"))


BLOCK = r"(?s)\A---\n(.*?)\n---\n*(.*)\z"


def front(text: Column) -> tuple[Column, Column, Callable[[str], Column]]:
    """Whether a text begins with a ``---`` block, the text without it, and a field of the block by its
    name (without quotes; null where it is missing or empty)."""
    text = _unix(text)
    has = text.rlike(BLOCK)
    head = F.regexp_extract(text, BLOCK, 1)

    def field(name: str) -> Column:
        return F.nullif(F.trim(F.regexp_replace(F.trim(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.*)$", 1)), "^[\"']|[\"']$", "")), F.lit(""))

    return has, F.when(has, F.regexp_extract(text, BLOCK, 2)).otherwise(text), field


def frontmatter(docs: DataFrame) -> DataFrame:
    """``key, name, title, body`` of texts that begin with a ``---`` block."""
    has, body, field = front(F.col("text"))
    title = F.coalesce(field("title"), field("description"), F.lit("untitled"))
    return docs.where(has).select("key", F.coalesce(field("name"), slugify(title)).alias("name"), title.alias("title"), body.alias("body"))


def first_lines(docs: DataFrame, most: int = 50) -> DataFrame:
    """``key, ordinal, line``: the first ``most`` lines that are not blank (the reference form's own limit)."""
    return docs.where("text is not null").select("key", F.posexplode(F.slice(_text_lines(F.col("text")), 1, most)).alias("ordinal", "line"))


def log_lines(docs: DataFrame) -> DataFrame:
    """``key, ordinal, actor, ts, line``: one row per line of a log; the actor in brackets, the time up to ``|``.

    A line without a leading bracket belongs to ``system``; a time that is not readable is null.
    """
    each = docs.where("text is not null").select("key", F.posexplode(_text_lines(F.col("text"))).alias("ordinal", "line"))
    who = F.regexp_extract("line", r"^\[([^\]]*)\]", 1)
    rest = F.trim(F.regexp_replace("line", r"^\[[^\]]*\]", ""))
    stamp = F.trim(F.substring_index(rest, "|", 1))
    ts = F.coalesce(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd hh:mm a")), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm")))
    actor = F.when(who == "", "system").otherwise(F.concat(F.lit("agent:"), F.replace(ascii_lower(who), F.lit("-"), F.lit("_"))))
    return each.select("key", "ordinal", actor.alias("actor"), ts.alias("ts"), F.substring("line", 1, 240).alias("line"))


def headers(docs: DataFrame) -> DataFrame:
    """``key, day, sender``: the ``DATE:`` and ``FROM:`` (or ``- Date:``, ``- Tool:``) of the first 20 lines."""
    top = F.slice(_text_lines(F.col("text")), 1, 20)

    def value(pattern: str) -> Column:
        hit = F.filter(top, lambda x: x.rlike(pattern))
        return F.when(F.size(hit) > 0, F.trim(F.regexp_replace(F.get(hit, F.lit(0)), pattern, "")))

    return docs.where("text is not null").select("key", value(r"^(DATE:|- Date:)").alias("day"), value(r"^(FROM:|- Tool:)").alias("sender")).where("day is not null or sender is not null")


def scope_of(stem: Column, body: Column, title: Column | None = None, config: EngineConfig = DEFAULTS) -> Column:
    """The scope a note speaks about, from its file name, title and text.

    A company prefix wins, then the first product named in the text or, by an alias, in the slugs;
    then a company word anywhere in the text; else the operating scope.
    """
    slugs = [slugify(F.coalesce(s, F.lit(""))) for s in (stem, *([title] if title is not None else []))]
    low = ascii_lower(F.coalesce(body, F.lit("")))
    out = F.when(any_of(config.company_tokens, lambda w: F.instr(low, w) > 0), "company").otherwise("os")
    for product, aliases in reversed(list(config.products.items())):

        def named(a: str) -> Column:
            return any_of(slugs, lambda s: (s == a) | s.startswith(f"{a}-") | s.startswith(f"project-{a}") | s.startswith(f"product-{a}") | s.endswith(f"-{a}"))

        hit = (F.instr(low, f"product:{product}") > 0) | any_of(aliases or (product,), named)
        out = F.when(hit, F.lit(f"product:{product}")).otherwise(out)
    return F.when(any_of(config.company_prefixes, lambda p: any_of(slugs, lambda s: s.startswith(p))), "company").otherwise(out)


def owner_of(path: Column, hints: list[str] | None = None) -> Column:
    """``agent:x`` for files under ``memory/x/``, else the first hint among the path's words, else shared."""
    folder = F.regexp_extract(F.coalesce(ascii_lower(path), F.lit("")), r"(?:^|/)memory/([^/.]+)/", 1)
    words = ascii_tokens(F.coalesce(path, F.lit("")))
    out = F.lit("shared")
    for h in reversed(hints or []):
        out = F.when(F.array_contains(words, h), F.lit(f"agent:{h}")).otherwise(out)
    return F.when(folder != "", F.concat(F.lit("agent:"), F.replace(slugify(folder), F.lit("-"), F.lit("_")))).otherwise(out)
