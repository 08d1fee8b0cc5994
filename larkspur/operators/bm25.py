"""Prefix BM25 over weighted text columns, from a stored index of terms or straight from the rows.

The index has a row per term and record (term, id, dl: the record's tokens, t0.. : the term's tokens
in each column) and is stored sorted by term, so a query reads the ranges of its prefixes only. Its
sizes (records, tokens) are rows that add up, so records can be appended to both. Statistics are
taken over the whole table before any filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import index_tokens

K1, B = 1.2, 0.75


def _hits(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t.startswith(term))).cast("double")


def with_counts(rows: DataFrame, weights: dict[str, float], terms: list[str]) -> DataFrame:
    """``rows`` with ``dl`` (tokens of all columns) and ``h0..`` (weighted prefix hits per term)."""
    names = {c: f"_tok_{k}" for k, c in enumerate(weights)}
    out = rows.withColumns({n: index_tokens(F.col(c)) for c, n in names.items()})
    cols = {"dl": sum((F.size(n) for n in names.values()), F.lit(0)).cast("double")}
    for k, t in enumerate(terms):
        h = F.lit(0.0)
        for c, w in weights.items():
            h = h + F.lit(float(w)) * _hits(F.col(names[c]), t)
        cols[f"h{k}"] = h
    return out.withColumns(cols).drop(*names.values())


def bm25(rows: DataFrame, weights: dict[str, float], terms: list[str]) -> DataFrame:
    """``rows`` that match a term, with ``bm25`` (lower is better, to 6 digits) and ``all_terms``.

    A token matches a term it starts with. Null columns count as empty. No terms or an empty table
    give no rows.
    """
    if not terms:
        return rows.withColumns({"bm25": F.lit(0.0), "all_terms": F.lit(False)}).limit(0)
    counted = with_counts(rows, weights, terms)
    totals = counted.agg(F.count("*").cast("double").alias("_n"), F.avg("dl").alias("_avg"), *[F.count_if(F.col(f"h{k}") > 0).cast("double").alias(f"_n{k}") for k in range(len(terms))])
    j = counted.where(" OR ".join(f"h{k} > 0" for k in range(len(terms)))).crossJoin(F.broadcast(totals))  # totals is one row
    score = F.lit(0.0)
    for k in range(len(terms)):
        h = F.col(f"h{k}")
        raw = F.ln((F.col("_n") - F.col(f"_n{k}") + 0.5) / (F.col(f"_n{k}") + 0.5))
        idf = F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)
        score = score + idf * h * (K1 + 1) / (h + K1 * (1 - B + B * F.col("dl") / F.col("_avg")))
    flags = F.lit(True)
    for k in range(len(terms)):
        flags = flags & (F.col(f"h{k}") > 0)
    return j.withColumns({"bm25": F.round(-score, 6), "all_terms": flags}).drop("dl", "_n", "_avg", *[f"h{k}" for k in range(len(terms))], *[f"_n{k}" for k in range(len(terms))])


def postings(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``id, field, term, tf``: the index by column, for statistics."""
    parts = F.array(*[F.struct(F.lit(c).alias("field"), index_tokens(F.col(c)).alias("tokens")) for c in columns])
    each = rows.select(F.col(id_col).alias("id"), F.explode(parts).alias("p")).select("id", "p.field", F.explode("p.tokens").alias("term"))
    return each.groupBy("id", "field", "term").agg(F.count("*").alias("tf"))


def index_terms(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``term, id, dl, t0..`` of rows with unique ids; null columns count as empty."""
    cut_ = rows.select("id", *[index_tokens(F.col(c)).alias(f"w{k}") for k, c in enumerate(columns)])
    every = ", ".join(f"transform(w{k}, x -> struct(x AS term, {k} AS f))" for k in range(len(columns)))
    length = " + ".join(f"size(w{k})" for k in range(len(columns)))
    each = cut_.selectExpr("id", f"cast({length} AS bigint) AS dl", f"explode(concat({every})) AS p").select("id", "dl", "p.term", "p.f")
    return each.groupBy("term", "id").agg(F.max("dl").alias("dl"), *[F.count_if(F.col("f") == k).alias(f"t{k}") for k in range(len(columns))])


def index_sizes(rows: DataFrame, terms: DataFrame, columns: int) -> DataFrame:
    """``n, tokens``: one row for the records and the tokens of their ``terms``."""
    tokens = terms.agg(F.coalesce(F.sum(sum((F.col(f"t{k}") for k in range(1, columns)), F.col("t0"))), F.lit(0)).alias("tokens"))
    return rows.agg(F.count("*").alias("n")).crossJoin(F.broadcast(tokens))  # one row each


class TextIndex:
    """An index of one table's texts: ``terms``, ``sizes`` and the columns' weights."""

    def __init__(self, terms: DataFrame, sizes: DataFrame, weights: dict[str, float]):
        self.terms, self.sizes, self.weights = terms, sizes, weights

    @classmethod
    def over(cls, rows: DataFrame, weights: dict[str, float], keep=lambda df: df) -> TextIndex:
        """The index of ``rows``; ``keep`` stores a frame and gives it back."""
        terms = keep(index_terms(rows, list(weights)).repartitionByRange("term").sortWithinPartitions("term")) if keep is not None else index_terms(rows, list(weights))
        return cls(terms, (keep or (lambda df: df))(index_sizes(rows.select("id"), terms, len(weights))), weights)

    def hits(self, terms: list[str]) -> DataFrame:
        """``id, bm25, all_terms`` of the records with a token that starts with a term (letters and
        digits); lower is better, to 6 digits. No terms give no rows."""
        if not terms:
            return self.terms.selectExpr("id", "0D AS bm25", "false AS all_terms").limit(0)
        ks = range(len(terms))
        tf = " + ".join(f"{float(w)}D * t{k}" for k, w in enumerate(self.weights.values()))
        own = self.terms.where(" OR ".join(f"startswith(term, '{t}')" for t in terms))
        found = own.groupBy("id").agg(F.expr("cast(max(dl) AS double)").alias("dl"), *[F.expr(f"sum(if(startswith(term, '{t}'), {tf}, 0D))").alias(f"h{k}") for k, t in enumerate(terms)])
        rare = found.agg(*[F.expr(f"cast(count_if(h{k} > 0) AS double)").alias(f"n{k}") for k in ks])
        whole = self.sizes.agg(F.expr("cast(sum(n) AS double)").alias("n"), F.expr("try_divide(sum(tokens), sum(n))").alias("avg"))
        j = found.crossJoin(F.broadcast(rare)).crossJoin(F.broadcast(whole))  # one row each
        idf = lambda k: f"if(ln((n - n{k} + 0.5D) / (n{k} + 0.5D)) <= 0, 1e-6D, ln((n - n{k} + 0.5D) / (n{k} + 0.5D)))"
        score = " + ".join(f"{idf(k)} * h{k} * {K1 + 1}D / (h{k} + {K1}D * ({1 - B}D + {B}D * dl / avg))" for k in ks)
        return j.selectExpr("id", f"round(-({score}), 6) AS bm25", " AND ".join(f"h{k} > 0" for k in ks) + " AS all_terms")
