"""One consistent form for texts that look the same, and the documents that differ only in looks.

The form of a text: compatibility decomposition, then one table applied to its characters (default-
ignorable characters go, every kind of space becomes a plain space, Cyrillic and Greek letters of
the shape of a Latin letter become that letter), then canonical composition, and full case folding
where asked for. It is computed once per distinct text of a batch, and the table is a rule over
Unicode properties filled in per distinct character.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.blocks import BLOCK, block_of, pairs_within
from larkspur.session import written

# Letters of the shape of a Latin letter, and that letter.
LOOKALIKES = dict(
    zip(
        # Cyrillic capitals, Cyrillic small letters, Greek capitals, Greek small letters
        "АВЕЅІЈКМНОРСТУХҮԌԚԜӀ" "аеѕіјорсухһԁԛԝүӏ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϜϹϳ" "αικνορυχγϲ",
        "ABESIJKMHOPCTYXYGQWI" "aesijopcyxhdqwyl" "ABEZHIKMNOPTYXFCj" "aikvopuxyc",
        strict=True,
    )
)
#: Default-ignorable code points that are not of category Cf, by range.
IGNORABLE = [(0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF)]
#: Format characters that are seen or that take part in layout, so are not ignorable.
VISIBLE_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0xFFF9, 0xFFFA, 0xFFFB, 0x110BD, 0x110CD, *range(0x13430, 0x13440)}


class Table(dict):
    """Code point to its replacement, found by rule when a character is first met."""

    def __missing__(self, point: int):
        c = chr(point)
        kind = unicodedata.category(c)
        if (kind == "Cf" and point not in VISIBLE_FORMAT) or any(a <= point <= b for a, b in IGNORABLE):
            new = None
        elif kind == "Zs":
            new = " "
        else:
            new = LOOKALIKES.get(c, c)
        self[point] = new
        return new


TABLE = Table()


def one_form(text: str, fold: bool = False) -> str:
    """The consistent form of a text; with ``fold`` also without differences of case."""
    if text.isascii():
        return text.casefold() if fold else text
    out = unicodedata.normalize("NFC", unicodedata.normalize("NFKD", text).translate(TABLE))
    if fold:
        out = unicodedata.normalize("NFC", unicodedata.normalize("NFKD", out.casefold()).translate(TABLE))
    return out


def normalised(text: Column, fold: bool = True) -> Column:
    """The consistent form of a text column, one computation per distinct text; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        codes, kinds = pd.factorize(s)
        forms = pd.Series([one_form(t, fold) for t in kinds], dtype=object)
        return pd.Series([None if c < 0 else forms[c] for c in codes], dtype=object)

    return run(text)


def _digests(batches):
    """(id, text) -> (id, form, raw): 128-bit digests of the form and of the text; blank forms go."""
    for b in batches:
        out: dict[str, tuple[bytes, bytes] | None] = {}
        rows = []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if t is None:
                continue
            if t not in out:
                form = one_form(t)
                out[t] = (hashlib.blake2b(form.encode(), digest_size=16).digest(), hashlib.blake2b(t.encode(), digest_size=16).digest()) if form.strip() else None
            if out[t]:
                rows.append((i, *out[t]))
        if rows:
            i, f, r = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(f, pa.binary()), pa.array(r, pa.binary())], names=["id", "form", "raw"])


def lookalike_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, form, raw, n_texts`` of the documents whose form is shared by several different texts."""
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    seen = rows.mapInArrow(_digests, "id bigint, form binary, raw binary")
    # copies are pre-aggregated to one row per text before texts of one form meet
    texts = seen.groupBy("form", "raw").agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    forms = texts.groupBy("form").agg(F.count("*").alias("n_texts")).where("n_texts > 1")
    return seen.join(forms, "form").distinct()


def lookalike_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``a_id, b_id`` (a_id < b_id): documents whose texts differ but look the same.

    Null and blank texts count for nothing, null keys are left out, repeated rows count once.
    Every pair is listed: the copies of a text are cut into parts of at most some ``block``
    documents, a form's parts into blocks of as many parts, and blocks and parts meet in tasks of
    their own.
    """
    rows = written(lookalike_groups(docs, key, text))
    copies = rows.groupBy("form", "raw").agg(F.count("*").alias("n"))
    parts = copies.select("form", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / block) - 1), lambda k: F.struct("raw", k.alias("k")))).alias("part"))
    sized = parts.join(parts.groupBy("form").agg(F.count("*").alias("n")), "form")
    met = pairs_within(sized, ["form"], "part", "n", block).where("x.raw <> y.raw")
    ids = rows.join(copies.where(F.col("n") > block), ["form", "raw"], "left")
    ids = ids.select("form", "raw", F.coalesce(block_of(F.col("id"), F.col("n"), block), F.lit(0).cast("bigint")).alias("k"), "id")
    xs = ids.select("form", F.struct("raw", "k").alias("x"), F.col("id").alias("p"))
    ys = ids.select("form", F.struct("raw", "k").alias("y"), F.col("id").alias("q"))
    both = met.join(xs, ["form", "x"]).join(ys, ["form", "y"])
    return both.select(F.least("p", "q").alias("a_id"), F.greatest("p", "q").alias("b_id")).where("a_id <> b_id").distinct()
