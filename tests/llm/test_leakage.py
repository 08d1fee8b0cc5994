import random
import re

import pytest

from larkspur.llm.leakage import Index, build_index, extend_index, leaked_items, leaked_spans, phrase_matches, proximity_matches


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def data():
    rnd = random.Random(6)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in ("an", "or", "é", "1")]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([5, 11, 12, 13, 30])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, items[4][1]), (items[4][0], items[4][1])]
    docs = []
    for d in range(200):
        w = rnd.choices(vocabulary, k=rnd.randint(0, 40))
        if rnd.random() < 0.5:
            src = words(rnd.choice(items)[1])
            a = rnd.randint(0, max(0, len(src) - 11))
            k = rnd.randint(0, len(w))
            w[k:k] = src[a : a + rnd.choice([11, 12, 14, 30])]
        docs.append((d, rnd.choice([" ", "\n- ", "_", " ... "]).join(w).upper()))
    return items, docs + [(900, None), (901, ""), (None, items[0][1]), (902, ("x " * 20_000) + " ".join(words(items[9][1])))]


def brute(items, docs, n):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i, k) for d, t in docs if d is not None for w in [words(t)] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}


@pytest.mark.parametrize("lists", [1, 3, 20])
def test_against_all_windows(spark, lists):
    items, docs = data()
    i = spark.createDataFrame(items, "item_id bigint, text string")
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {tuple(r) for r in phrase_matches(build_index(d, "doc_id", "text"), i, "item_id", "text", 12, lists).collect()}
    want = brute(items, docs, 12)
    assert got == want and len(want) > 50


def test_pairs_and_spans(spark):
    items = [(1, " ".join(f"w{k}" for k in range(20)))]
    docs = [(1, "x " + items[0][1]), (2, " ".join(f"w{k}" for k in range(3, 15))), (3, " ".join(f"w{k}" for k in range(11)))]
    i, d = spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {tuple(r) for r in leaked_items(build_index(d, "doc_id", "text"), i).collect()} == {(1, 1), (2, 1)}
    assert {tuple(r) for r in leaked_spans(build_index(d, "doc_id", "text"), i).collect()} == {(1, 1, 1, 20), (2, 1, 0, 12)}


def test_empty_tables(spark):
    i, d = spark.createDataFrame([], "item_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, text string")
    full = spark.createDataFrame([(1, " ".join("abcdefghijklmnop"))], "item_id bigint, text string")
    assert leaked_items(build_index(d, "doc_id", "text"), i).collect() == [] and leaked_items(build_index(d, "doc_id", "text"), full).collect() == []
    assert leaked_items(build_index(full.toDF("doc_id", "text"), "doc_id", "text"), i).collect() == []


def near_brute(items, docs, lists, within):
    at = {d: words(t) for d, t in docs if d is not None}
    n = {}
    for w in at.values():
        for x in w:
            n[x] = n.get(x, 0) + 1
    out = set()
    for i, t in items:
        rare = sorted({w for w in words(t) if w in n}, key=lambda w: (n[w], w.encode()))[:lists]
        for d, w in at.items():
            out |= {(d, i, k) for k, x in enumerate(w) if x in rare and set(rare) <= set(w[k : k + within])}
    return out


def test_proximity(spark):
    items = [(1, "alpha beta gamma delta epsilon the the"), (2, "alpha zeta unseen"), (3, "nowhere"), (4, None)]
    near, far = "the epsilon x gamma beta y delta alpha", "alpha beta gamma delta " + "the " * 60 + "epsilon"
    docs = [(1, near), (2, far), (3, "alpha"), (4, "q " * 39 + near), (5, "zeta alpha zeta " + near), (6, None), (None, near)]
    index = build_index(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text")
    got = {tuple(r) for r in proximity_matches(index, spark.createDataFrame(items, "item_id bigint, text string"), 5, 40).collect()}
    assert got == near_brute(items, docs, 5, 40) and {(1, 1, 1), (4, 1, 40), (5, 2, 0), (5, 2, 1)} <= got


def test_another_test_set_reads_the_same_index(spark, tmp_path):
    items, docs = data()
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    path = f"file://{tmp_path}/index"
    build_index(d, "doc_id", "text", path)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    for part in (items[:12], items[12:]):  # the terms of neither were known when the index was made
        got = {tuple(r) for r in phrase_matches(Index(spark, path), spark.createDataFrame(part, "item_id bigint, text string"), "item_id", "text").collect()}
        assert got == brute(part, docs, 12)
    assert before == {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}


def test_an_extended_index_equals_one_of_all_documents(spark, tmp_path):
    items, docs = data()
    i = spark.createDataFrame(items, "item_id bigint, text string")
    parts = [spark.createDataFrame(x, "doc_id bigint, text string") for x in (docs[:120], [], docs[120:])]
    index = build_index(parts[0], "doc_id", "text", f"file://{tmp_path}/index")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "index/postings").rglob("*.parquet")}
    for part in parts[1:]:
        index = extend_index(index, part, "doc_id", "text")
    assert {tuple(r) for r in phrase_matches(index, i, "item_id", "text").collect()} == brute(items, docs, 12)
    assert before.items() <= {p: p.stat().st_mtime_ns for p in (tmp_path / "index/postings").rglob("*.parquet")}.items()
    got = {tuple(r) for r in proximity_matches(index, i, 5, 40).collect()}
    assert got == near_brute(sorted(set(items), key=str), docs, 5, 40)


def test_a_term_of_every_document_is_many_blocks(spark):
    d = spark.createDataFrame([(k, "common word" if k % 2 else "common") for k in range(9000)], "doc_id bigint, text string").repartition(3)
    index = build_index(d, "doc_id", "text")
    assert index.postings.agg({"n": "max"}).first()[0] <= 2000 and index.weights.groupBy("tid").sum("df").agg({"sum(df)": "max"}).first()[0] == 9000
