"""Queries of the corpus problems (1, 6, 7 and 8) and their SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.bpe import encode_corpus, tokenizer_file
from larkspur.llm.leakage import Index, build_index, leaked_items, leaked_spans, proximity_matches
from larkspur.llm.lookalikes import TABLE, lookalike_pairs, normalised
from larkspur.llm.near_duplicates import link_counts, near_duplicate_classes, near_duplicates
from larkspur.operators.components import connected_components
from larkspur.session import cut, table

Query = Callable[[SparkSession, str], DataFrame]


def notes(spark: SparkSession, d: str) -> DataFrame:
    """``tbl, id, text``: memories (title, a space, body; a null part is empty) and episodes (summary)."""
    m, e = table(spark, d, "memories"), table(spark, d, "episodes")
    none = F.lit("")
    return m.select(F.lit("memories").alias("tbl"), "id", F.concat(F.coalesce("title", none), F.lit(" "), F.coalesce("body", none)).alias("text")).unionByName(
        e.select(F.lit("episodes").alias("tbl"), "id", F.col("summary").alias("text"))
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates(notes(spark, d), threshold=0.7, shingle=1)


def near_duplicate_groups(docs: DataFrame, threshold: float, shingle: int) -> DataFrame:
    counts, links = link_counts(*near_duplicate_classes(docs, threshold, shingle))
    counts = cut(counts)
    groups = connected_components(links, ["tbl"]).select("tbl", F.col("id").alias("rep"), "component")
    return counts.join(groups, ["tbl", "rep"]).select("tbl", "id", F.col("component").alias("group_id"), "n_links")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """``tbl, id, group_id, n_links``: each record with links, the smallest id of its group and its links."""
    return near_duplicate_groups(notes(spark, d), threshold=0.7, shingle=1)


def p6_ids(spark: SparkSession, d: str, name: str = "byte_bpe_50k", folder: str = "/opt/tokenizers") -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text", *tokenizer_file(name, folder))


def p6_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Token counts per source: documents, tokens, and the most in one document."""
    ids = p6_ids(spark, d).withColumn("n", F.size("ids").cast("bigint"))
    docs = table(spark, d, "documents").select("doc_id", "source")
    return ids.select("doc_id", "n").join(docs, "doc_id").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.max("n").alias("most_tokens"))


_INDEXES: dict[tuple, Index] = {}


def corpus_index(spark: SparkSession, d: str) -> Index:
    """The positional index of the documents of ``d``, built by the first query of a session that asks
    for it and as long as the table's files stay the same."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    key = (spark.sparkContext.applicationId, d, files.getContentSummary(at).getLength(), files.getFileStatus(at).getModificationTime())
    if key not in _INDEXES:
        _INDEXES[key] = build_index(table(spark, d, "documents"), "doc_id", "text")
    return _INDEXES[key]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(corpus_index(spark, d), table(spark, d, "eval_items"))


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaked_spans(corpus_index(spark, d), table(spark, d, "eval_items"))


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    return proximity_matches(corpus_index(spark, d), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_pairs(table(spark, d, "documents"))


def p8_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in its one form, case folded."""
    return table(spark, d, "documents").select("doc_id", normalised(F.col("text"), True).alias("text"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_groups, p6_ids, p6_lengths, p7_found, p7_spans, p7_near, p8_found, p8_normalised)}

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_P1 = """
WITH t AS (SELECT DISTINCT 'memories' AS tbl, id, list_distinct(""" + _WORDS.format("coalesce(title,'') || ' ' || coalesce(body,'')") + """) AS w FROM memories
           UNION ALL SELECT DISTINCT 'episodes', id, list_distinct(""" + _WORDS.format("summary") + """) FROM episodes),
s AS (SELECT tbl, id, len(w) AS n, unnest(w) AS w FROM t),
p AS (SELECT a.tbl, a.id AS a_id, b.id AS b_id, any_value(a.n) AS x, any_value(b.n) AS y, count(*) AS k
      FROM s a JOIN s b ON a.tbl = b.tbl AND a.w = b.w AND a.id < b.id GROUP BY ALL)"""  # fmt: skip
_P7 = """
WITH d AS (SELECT doc_id, """ + _WORDS.format("text") + """ AS w FROM documents),
i AS (SELECT item_id, """ + _WORDS.format("text") + """ AS w FROM eval_items),
dw AS (SELECT doc_id, k AS start, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12)),
h AS (SELECT DISTINCT doc_id, item_id, start FROM dw JOIN iw USING (g))"""  # fmt: skip



def _forms(fold: bool) -> str:
    """CTEs ending in ``f`` (doc_id, text, form): texts put together from their characters' forms, by a
    table over all of Unicode made from its own properties, then composed."""
    rows = []
    for point in range(0x110000):
        if not 0xD800 <= point <= 0xDFFF:
            new = unicodedata.normalize("NFKD", chr(point)).translate(TABLE)
            if fold:
                new = unicodedata.normalize("NFKD", new.casefold()).translate(TABLE)
            if unicodedata.normalize("NFC", new) != unicodedata.normalize("NFC", chr(point)):
                rows.append(f"({point},'{new.replace(chr(39), chr(39) * 2)}')")
    return f"""
WITH m(point, new) AS (VALUES {",".join(rows)}),
c AS (SELECT doc_id, k, chars[k] AS x FROM (SELECT doc_id, chars, unnest(range(1, len(chars) + 1)) AS k FROM (SELECT doc_id, string_split(text, '') AS chars FROM documents WHERE text <> ''))),
g AS (SELECT doc_id, nfc_normalize(string_agg(coalesce(m.new, x), '' ORDER BY k)) AS form FROM c LEFT JOIN m ON m.point = unicode(x) GROUP BY doc_id),
f AS (SELECT doc_id, text, CASE WHEN text = '' THEN '' ELSE form END AS form FROM documents LEFT JOIN g USING (doc_id))"""


ORACLES: dict[str, str] = {
    "p1_found": _P1 + " SELECT tbl, a_id, b_id FROM p WHERE CAST(k AS DOUBLE) / (x + y - k) >= 0.7",
    "p1_groups": _P1.replace("WITH t", "WITH RECURSIVE t", 1) + """,
u AS (SELECT tbl, a_id AS a, b_id AS b FROM p WHERE CAST(k AS DOUBLE) / (x + y - k) >= 0.7), l AS (SELECT * FROM u UNION ALL SELECT tbl, b, a FROM u),
r AS (SELECT tbl, a, b FROM l UNION SELECT r.tbl, r.a, l.b FROM r JOIN l ON l.tbl = r.tbl AND l.a = r.b)
SELECT r.tbl, r.a AS id, min(r.b) AS group_id, (SELECT count(*) FROM l WHERE l.tbl = r.tbl AND l.a = r.a) AS n_links FROM r GROUP BY r.tbl, r.a""",
    "p8_found": _forms(False) + r""" SELECT DISTINCT a.doc_id AS a_id, b.doc_id AS b_id FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text WHERE regexp_matches(a.form, '\S')""",
    "p8_normalised": _forms(True) + " SELECT doc_id, form AS text FROM f",
    "p7_found": _P7 + " SELECT DISTINCT doc_id, item_id FROM h",
    "p7_spans": _P7 + """, g AS (SELECT *, start - row_number() OVER (PARTITION BY doc_id, item_id ORDER BY start) AS isle FROM h)
SELECT doc_id, item_id, min(start) - 1 AS first_word, max(start) - min(start) + 12 AS n_words FROM g GROUP BY doc_id, item_id, isle""",
    "p7_near": """
WITH t AS (SELECT DISTINCT doc_id, pos, w[pos] AS w FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT doc_id, """ + _WORDS.format("text") + """ AS w FROM documents))),
i AS (SELECT DISTINCT item_id, unnest(""" + _WORDS.format("text") + """) AS w FROM eval_items),
c AS (SELECT w, count(*) AS n FROM t GROUP BY w),
r AS (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY n, w) AS turn FROM i JOIN c USING (w)),
k AS (SELECT item_id, count(*) AS k FROM r WHERE turn <= 5 GROUP BY item_id),
p AS (SELECT doc_id, item_id, pos, w FROM t JOIN r USING (w) WHERE turn <= 5)
SELECT a.doc_id, a.item_id, a.pos - 1 AS at_word FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.pos BETWEEN a.pos AND a.pos + 39
JOIN k ON k.item_id = a.item_id GROUP BY a.doc_id, a.item_id, a.pos, k.k HAVING count(DISTINCT b.w) = k.k""",
}
