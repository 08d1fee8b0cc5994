import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import near_duplicates as nd
from larkspur.llm.queries import near_duplicate_groups
from larkspur.operators.blocks import pairs_within

SCHEMA = "tbl string, id bigint, text string, c string"


def jaccard(a, b, shingle):
    a, b = nd.terms_of(a, shingle), nd.terms_of(b, shingle)
    return len(a & b) / len(a | b) if a and b else 0


def corpus(n, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}é" for k in range(400)]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.5:
            words = rnd.choice(rows)[2].split()
            for _ in range(rnd.randint(0, 5)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            if rnd.random() < 0.3:
                rnd.shuffle(words)
        else:
            words = ["the", "of", "and"] + rnd.choices(vocabulary, k=rnd.randint(12, 40))
        rows.append((rnd.choice("mn"), i, " ".join(words), "x"))
    return rows


def brute(rows, threshold, shingle):
    rows = sorted({(t, i, x) for t, i, x, _ in rows if i is not None and x})
    return {(t, i, j) for k, (t, i, x) in enumerate(rows) for u, j, y in rows[k + 1 :] if t == u and i < j and jaccard(x, y, shingle) >= threshold}


@pytest.mark.parametrize("threshold,shingle,bands,recall", [(0.7, 1, nd.BANDS, 0.94), (0.7, 1, 80, 0.99), (0.8, 5, nd.BANDS, 0.98)])
def test_against_all_pairs(spark, threshold, shingle, bands, recall):
    rows = corpus(220, 3)
    rows += rows[:20] + [("m", 900, None, "x"), ("m", 901, "", "x"), ("m", 902, " -- ", "x"), ("m", None, rows[0][2], "x"), ("m", 903, "one", "x"), ("m", 904, "ONE!", "x"), ("m", 905, "z " * 30_000 + "one", "x")]
    got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), threshold, shingle, bands=bands).collect()
    want = brute(rows, threshold, shingle)
    found = {tuple(r) for r in got}
    assert len(found) == len(got) and found <= want
    assert len(found) >= recall * len(want) and len(want) > 10


def test_hot_buckets_give_the_same_pairs(spark):
    rows = [("m", i, "a b c d e f g h i j k l m n o p q r s t " + " ".join(f"u{i}x{k}" for k in range(i % 3)), "x") for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = {tuple(r) for r in nd.near_duplicates(df, 0.7, 1).collect()}
    split = {tuple(r) for r in nd.near_duplicates(df, 0.7, 1, hot=16).collect()}
    assert plain == split == brute(rows, 0.7, 1)


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA), 0.7, 1).collect() == []


def signed(sketch, sets, small):
    out = []
    for a in range(0, len(sets), 200):
        sketch.take(sets[a : a + 200])
        every = np.arange(len(sets[a : a + 200]))
        out.append((sketch.parities(every) if small else sketch.signatures(every)).view(np.uint32))
    return np.concatenate(out)


@pytest.mark.parametrize("words,small", [(8, True), (40, True), (120, True), (120, False), (600, False)])
def test_bounds_keep_true_pairs_and_prune_others(words, small):
    most, least = nd.most_differences(0.7, 0.0005), Fraction("0.7")
    rnd = random.Random(words)

    def kept(s):
        """Share of pairs of sets of that size and similarity s, in equal halves of additions and removals, that stay."""
        own = round(words * (1 - s) / (1 + s))
        sets = []
        for i in range(300):
            w = [f"{i}x{rnd.random()}" for _ in range(words + own)]
            sets += [set(w[:words]), set(w[own:])]
        assert (len(sets[0] & sets[1]) / len(sets[0] | sets[1]) >= 0.7) == (s >= 0.7)
        size = np.full(len(sets), words if small else -words)
        at = np.arange(0, len(sets), 2)
        return len(nd.prune(at, at + 1, signed(nd.Sketcher(), sets, small), size, most, least)[0]) / 300

    assert kept(0.75 if words == 8 else 0.71) >= 0.995
    assert kept(0.35) <= 0.1
    i, _ = nd.prune(np.array([0]), np.array([1]), np.zeros((2, 4), np.uint32), np.array([60, 100]), most, least)
    assert not len(i)  # sizes alone


def test_sets_about_the_border_of_the_two_signatures(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(120):
        w = [f"r{i}x{k}" for k in range(rnd.randint(60, 190))]
        cut_ = len(w) - rnd.randint(0, len(w) // 4)
        rows += [("m", 2 * i, " ".join(w), "x"), ("m", 2 * i + 1, " ".join(w[:cut_]), "x")]
    found = {tuple(r) for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.7, 1, bands=60).collect()}
    assert len(found) >= 0.98 * len(brute(rows, 0.7, 1)) and found <= brute(rows, 0.7, 1)


def test_pieces_of_a_very_long_text_hash_as_the_whole(monkeypatch):
    sets = [{f"w{k}" for k in range(9000)}, {"a", "b"}]
    whole = nd.Sketcher()
    whole.take(sets)
    monkeypatch.setattr(nd, "CHUNK", 100)
    pieces = nd.Sketcher()
    pieces.take(sets)
    salt = np.zeros(2, np.uint64)
    assert (whole.band_keys(salt) == pieces.band_keys(salt)).all()
    assert all((x == y).all() for x, y in zip(whole.classes(salt), pieces.classes(salt)))


@pytest.mark.parametrize("common,share", [(0, 0), (10, 0.25), (20, 0.5), (24, 0.6), (27, 0.68)])
def test_recall_at_the_threshold_by_share_of_common_words(spark, common, share):
    """400 planted pairs of plain similarity exactly 28 / 40, of which ``common`` of the 28 shared words are in a tenth of all texts or more."""
    rnd = random.Random(common)
    frame = [f"the{k}" for k in range(max(common, 1) * 2)]
    rows = []
    for i in range(400):
        shared = rnd.sample(frame, common) + [f"r{i}x{k}" for k in range(28 - common)]
        for side in (0, 1):
            words = shared + [f"o{i}s{side}x{k}" for k in range(6)]
            rnd.shuffle(words)
            rows.append(("m", 2 * i + side, " ".join(words), "x"))
    assert jaccard(rows[0][2], rows[1][2], 1) == 0.7 and abs(common / 40 - share) < 0.01
    found = {tuple(r) for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.7, 1).collect()}
    recall = len(found & {("m", 2 * i, 2 * i + 1) for i in range(400)}) / 400
    print(f"share {share}: recall {recall}")
    assert recall >= 0.97


@pytest.mark.parametrize("frame,own,changed", [(13, 7, 3), (20, 10, 5), (27, 13, 7)])
def test_recall_of_plain_jaccard_where_rare_words_differ(spark, frame, own, changed):
    rnd = random.Random(frame)
    rows = []
    for i in range(300):
        common = rnd.sample([f"frame{k}" for k in range(60)], frame)
        rare = [f"r{i}x{k}" for k in range(own + changed)]
        rows += [("m", 2 * i, " ".join(common + rare[:own]), "x"), ("m", 2 * i + 1, " ".join(common + rare[changed:]), "x")]
    assert 0.7 <= jaccard(rows[0][2], rows[1][2], 1) < 0.75
    found = {tuple(r) for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.7, 1).collect()}
    assert len(found & {("m", 2 * i, 2 * i + 1) for i in range(300)}) >= 0.97 * 300


def test_every_pair_of_a_large_class_is_listed_and_counted(spark):
    rnd = random.Random(9)
    words = "a b c d e f g h i j".split()
    rows = [("m", i, " ".join(rnd.sample(words, 10)), "x") for i in range(160)] + [("m", 1000 + i, " ".join(rnd.sample([*words, "k"], 11)), "x") for i in range(70)]
    rows += [("n", 5, "one two", "x"), ("n", 6, "two one one", "x"), ("n", 7, "else", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 0.7, 1)
    got = nd.near_duplicates(df, 0.7, 1).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) == 230 * 229 // 2 + 1
    groups = {(r.tbl, r.id): (r.group_id, r.n_links) for r in near_duplicate_groups(df, 0.7, 1).collect()}
    assert groups == {(t, i): (0, 229) if t == "m" else (5, 1) for t, i, x, _ in rows if x != "else"}


def test_blocks_give_every_pair_once(spark):
    df = spark.createDataFrame([(g, i, 30) for g in "ab" for i in range(30)], "g string, id bigint, n bigint")
    got = [tuple(r) for r in pairs_within(df, ["g"], "id", "n", 7).collect()]
    assert sorted(got) == [(g, i, j) for g in "ab" for i in range(30) for j in range(i + 1, 30)]


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_buckets_across_batches(monkeypatch, size):
    """Whatever the batches, each bucket up to ``hot`` is compared whole and a larger one comes out in blocks, row for row."""
    monkeypatch.setattr(nd, "HELD", 40)
    rnd = random.Random(size)
    rows, c = [], 0
    for key in range(60):
        for _ in range(rnd.choice([1, 2, 3, 9, 10, 11, 45, 120]) if key % 7 else 1):
            rows.append((key, c, 1, 2, 5, None))
            c += 1
        rows += [(key, 10_000 + key, 3, key, 0, "m")] * rnd.choice([0, 1, 2])  # a record, perhaps delivered twice
    rows.sort(key=lambda r: r[:2])
    schema = pa.schema([(n, pa.string() if n == "tbl" else pa.int64()) for n in ("key", "c", "s0", "s1", "n", "tbl")])
    whole = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
    out = [r for b in nd.bucket_pairs(lambda i, j, sig, size: (i, j), 10)(whole.to_batches(max_chunksize=size)) for r in b.to_pylist()]
    buckets = {}
    for r in rows:
        if r[4]:
            buckets.setdefault(r[0], []).append(r[1])
    small = {(a, b) for m in buckets.values() if len(m) <= 10 for a in m for b in m if a < b}
    pairs = [(r["a"], r["b"]) for r in out if r["n"] is None]
    assert set(pairs) == small and len(pairs) == len(small)
    spilled = {}
    for r in out:
        if r["n"]:
            spilled.setdefault(r["key"], []).append((r["a"], r["b"]))
    assert spilled == {k: [(x, i // 10) for i, x in enumerate(m)] for k, m in buckets.items() if len(m) > 10}
    assert [(r["a"], r["b"], r["tbl"]) for r in out if r["n"] == 0] == sorted({(r[1], r[3], "m") for r in rows if not r[4]})
