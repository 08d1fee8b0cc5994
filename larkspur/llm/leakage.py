"""Evaluation passages inside training text, by a distributed positional inverted index.

The index holds the postings of every term of the corpus, whatever the test material, so it is
stored once and read by every query. A map task turns a slice of documents into one block of
postings per term (documents and positions side by side), so a term that stands in every document
is many blocks and never one group. Blocks are stored by term: a directory per range of term ids,
sorted inside; a bucket that outgrows a task's share is split on the way. New documents are added
beside the postings that are there.

A query is a window of ``n`` words of an item. Its terms are ordered by their number of postings.
The list of the rarest, set back by the term's place in the item, gives candidate alignments of the
item with documents; the lists of the next rarer terms, set back by theirs, are intersected with
them, and what is left is checked against all other words of the window. Windows that begin with
the same rarest terms share these steps.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.session import checkpoint_dir, cut

#: Most rows of a side that is broadcast.
BROADCAST_ROWS = 200_000
#: Directories of the index, each a range of term ids (hashes), and documents of a block.
BUCKETS, SLICE = 32, 2000


def words(text: Column) -> Column:
    """The unbroken runs of letters and digits, in lower case, in order; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, as it is otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bucket_of(tid: Column) -> Column:
    return F.shiftrightunsigned(tid, 64 - BUCKETS.bit_length() + 1).cast("int")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, h: hashes of the words in order) -> (tid, n, docs, at), a row per term and slice."""
    for whole in batches:
        for a in range(0, whole.num_rows, SLICE):
            b = whole.slice(a, SLICE)
            lists = b.column("h")
            ends = lists.offsets.to_numpy()
            ends = ends - ends[0]
            h = lists.flatten().to_numpy()
            if not len(h):
                continue
            doc = np.repeat(np.arange(b.num_rows), np.diff(ends))
            place = (np.arange(len(h)) - ends[doc]).astype(np.int32)
            by = np.argsort(h, kind="stable")
            tid = h[by]
            starts = np.flatnonzero(np.r_[True, tid[1:] != tid[:-1]])
            offsets = pa.array(np.r_[starts, len(tid)].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(tid[starts]),
                    pa.array(np.diff(np.r_[starts, len(tid)]).astype(np.int32)),
                    pa.ListArray.from_arrays(offsets, b.column("doc").take(pa.array(doc[by]))),
                    pa.ListArray.from_arrays(offsets, pa.array(place[by])),
                ],
                names=["tid", "n", "docs", "at"],
            )


class Index:
    """A stored positional index: ``postings`` (bucket, tid, n, docs, at) and ``weights`` (tid, df:
    rows that add up to a term's number of postings)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        form = spark.read.parquet(f"{path}/form").schema  # a table without rows may have no file
        self.postings = spark.read.schema(form).parquet(f"{path}/postings")
        self.weights = spark.read.parquet(f"{path}/weights")

    def of(self, tids: DataFrame) -> DataFrame:
        """``tid, doc, pos``: the postings of the terms in ``tids`` (tid); only their buckets are read."""
        tids = tids.select("tid").distinct()
        at = [r.b for r in tids.select(bucket_of(F.col("tid")).alias("b")).distinct().collect()]  # at most BUCKETS
        blocks = self.postings.where(F.col("bucket").isin(at)).join(small(tids), "tid", "left_semi")
        return blocks.select("tid", F.explode(F.arrays_zip("docs", "at")).alias("p")).select("tid", F.col("p.docs").alias("doc"), F.col("p.at").alias("pos"))


def _add(docs: DataFrame, doc: str, text: str, path: str) -> None:
    """Writes the postings and weights of ``docs`` to those under ``path``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).alias("doc"), F.transform(words(F.col(text)), lambda x: F.xxhash64(x)).alias("h")).where("doc is not null and size(h) > 0")
    kind = dict(rows.dtypes)["doc"]
    blocks = rows.mapInArrow(_blocks, f"tid bigint, n int, docs array<{kind}>, at array<int>").withColumn("bucket", bucket_of(F.col("tid")))
    form = blocks.select("tid", "n", "docs", "at", "bucket").schema
    spark.createDataFrame([], form).write.mode("overwrite").parquet(f"{path}/form")
    new = f"{path}/postings/part={uuid.uuid4().hex}"
    blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", "tid").write.partitionBy("bucket").parquet(new)
    spark.read.schema(form).parquet(new).groupBy("tid").agg(F.sum("n").alias("df")).write.mode("append").parquet(f"{path}/weights")


def build_index(docs: DataFrame, doc: str, text: str, path: str | None = None) -> Index:
    """Stores the index of all terms of ``docs`` under ``path``, or in the shared checkpoint folder,
    where it goes when the session ends.

    Rows with a null key and texts without a word have no postings. Keys are unique but for
    repeated rows, whose postings stand twice and match as one.
    """
    spark = docs.sparkSession
    if path is None:
        path = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    _add(docs, doc, text, path)
    return Index(spark, path)


def extend_index(index: Index, docs: DataFrame, doc: str, text: str) -> Index:
    """The index with new documents: their postings are written beside those it has, which stay as they
    are. One writer at a time."""
    _add(docs, doc, text, index.path)
    return Index(index.spark, index.path)


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """``it, item, pos, term, tid`` of the test material; ``it`` names an item's text, repeated rows
    are one."""
    one = items.select(F.col(item).alias("item"), F.col(text).alias("text")).where("item is not null").distinct()
    return one.select(F.xxhash64("item", "text").alias("it"), "item", F.posexplode(words(F.col("text"))).alias("pos", "term")).withColumn("tid", F.xxhash64("term"))


def _weights(index: Index, terms: DataFrame) -> DataFrame:
    own = index.weights.join(small(terms.select("tid").distinct()), "tid", "left_semi")
    return small(cut(own.groupBy("tid").agg(F.sum("df").alias("df"))))


def window_plan(index: Index, terms: DataFrame, n: int) -> DataFrame:
    """``it, s, o``: each window of n words (s: its first) of which every term occurs in the corpus, and
    its places ``o`` (q, tid) in the item, rarest term first."""
    weighed = terms.join(_weights(index, terms), "tid", "left").select("it", "pos", F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("pos").alias("q"), "tid").alias("x"))
    listed = weighed.groupBy("it").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("l"))  # one item's words
    each = listed.where(F.size("l") >= n).select("it", "l", F.explode(F.sequence(F.lit(0), F.size("l") - n)).alias("s"))
    slots = each.select("it", "s", F.array_sort(F.slice("l", F.col("s") + 1, n)).alias("o")).where(F.col("o")[0]["df"] > 0)
    return slots.select("it", "s", F.transform("o", lambda x: F.struct(x["q"].alias("q"), x["tid"].alias("tid"))).alias("o"))


def phrase_matches(index: Index, items: DataFrame, item: str, item_text: str, n: int = 12, lists: int = 3) -> DataFrame:
    """``doc, item, start``: each place where ``n`` words in a row of an item stand in a document.

    Null and empty texts and texts of under ``n`` words match nothing, null keys are left out,
    repeated rows count once. ``lists`` says how many of the rarest lists are intersected one by
    one before the rest is checked at once.
    """
    lists = min(lists, n - 1)
    terms = cut(item_terms(items, item, item_text))
    plan = cut(window_plan(index, terms, n))
    q = lambda k: F.col("o")[k]["q"]

    def turn(k: int) -> DataFrame:
        """The distinct beginnings q0..qk of the windows' places, with the tid of the last."""
        return cut(plan.select("it", *[q(i).alias(f"q{i}") for i in range(k + 1)], F.col("o")[k]["tid"].alias("tid")).distinct())

    first = turn(0)
    # shift: the document's word on which the item's first word would fall
    found = index.of(first).join(small(first), "tid").select("it", "q0", "doc", (F.col("pos") - F.col("q0")).alias("shift"))
    for k in range(1, lists):
        step = turn(k)
        need = found.join(small(step), ["it", *[f"q{i}" for i in range(k)]]).withColumn("pos", F.col("shift") + F.col(f"q{k}")).where("pos >= 0")
        found = need.join(index.of(step), ["tid", "doc", "pos"], "left_semi").drop("tid", "pos")
    found = cut(found)
    begun = [f"q{i}" for i in range(lists)]
    left = small(plan.select("it", "s", *[q(i).alias(f"q{i}") for i in range(lists)], F.slice("o", lists + 1, n).alias("o")))
    open_ = found.join(left, ["it", *begun]).where("shift + s >= 0").select("it", "doc", "shift", "s", "o")
    need = open_.select("it", "doc", "shift", F.explode("o").alias("x")).select("it", "doc", "shift", "x.q", "x.tid", (F.col("shift") + F.col("x.q")).alias("pos")).distinct()
    rest = index.of(plan.select(F.explode(F.slice("o", lists + 1, n)).alias("x")).select("x.tid")).join(small(found.select("doc").distinct()), "doc", "left_semi")
    met = need.join(rest, ["tid", "doc", "pos"], "left_semi").groupBy("it", "doc", "shift").agg(F.collect_set("q").alias("there"))  # places of one item
    whole = open_.join(met, ["it", "doc", "shift"]).where(F.forall("o", lambda x: F.array_contains("there", x["q"])))
    names = small(terms.select("it", "item").distinct())
    return whole.join(names, "it").select("doc", "item", (F.col("shift") + F.col("s")).alias("start")).distinct()


def leaked_items(index: Index, items: DataFrame, n: int = 12) -> DataFrame:
    """``doc_id, item_id``: documents with ``n`` or more words in a row in common with an item."""
    hits = phrase_matches(index, items, "item_id", "text", n)
    return hits.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def leaked_spans(index: Index, items: DataFrame, n: int = 12) -> DataFrame:
    """``doc_id, item_id, first_word, n_words``: the longest unbroken runs of leaked windows, so
    whole and partial leaks of an item can be told apart."""
    hits = phrase_matches(index, items, "item_id", "text", n)
    w = Window.partitionBy("doc", "item").orderBy("start")
    island = hits.withColumn("isle", F.col("start") - F.row_number().over(w))
    return (
        island.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "isle")
        .agg(F.min("start").cast("bigint").alias("first_word"), (F.max("start") - F.min("start") + n).cast("bigint").alias("n_words"))
        .drop("isle")
    )


def proximity_matches(index: Index, items: DataFrame, lists: int = 5, within: int = 40) -> DataFrame:
    """``doc_id, item_id, at_word``: every stretch of ``within`` words of a document that begins with
    one of an item's ``lists`` rarest distinct terms and holds them all, in any order.

    Ties of rarity go by the term. An item with fewer distinct terms in the corpus is looked for by
    those it has; one without any matches nothing.
    """
    terms = cut(item_terms(items, "item_id", "text"))
    own = terms.select("item", "term", "tid").distinct().join(_weights(index, terms), "tid")
    rare = cut(own.withColumn("turn", F.row_number().over(Window.partitionBy("item").orderBy("df", "term"))).where(F.col("turn") <= lists).select("item", "tid"))
    wanted = small(rare.groupBy("item").agg(F.count("*").alias("wanted")))
    at = index.of(rare).distinct().join(small(rare), "tid").select("doc", "item", "tid", "pos")
    # every stretch of ``within`` words lies inside one of two overlapping grids' cells
    cells = at.withColumn("cell", F.explode(F.array(F.floor(F.col("pos") / within), F.floor(F.col("pos") / within) - 1)))
    full = cells.groupBy("doc", "item", "cell").agg(F.countDistinct("tid").alias("k")).join(wanted, "item").where("k = wanted").select("doc", "item", "cell", "wanted")
    w = Window.partitionBy("doc", "item", "cell").orderBy("pos").rangeBetween(0, within - 1)
    near = cells.join(full, ["doc", "item", "cell"]).withColumn("k", F.size(F.collect_set("tid").over(w)))
    return near.where("k = wanted").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("pos").cast("bigint").alias("at_word")).distinct()
