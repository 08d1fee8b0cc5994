import random

import pytest

from larkspur.llm.lookalikes import lookalike_pairs, normalised, one_form
from pyspark.sql import functions as F

SAME = [
    ("Ｆｕｌｌ－ｗｉｄｔｈ １", "Full-width 1"),
    ("café", "café"),
    ("ﬁne ﬂow", "fine flow"),
    ("a​b⁠c﻿­", "abc"),
    ("a b c　d e", "a b c d e"),
    ("раsswоrd һеrе", "password here"),
    ("Ηello Οmega", "Hello Omega"),
    ("e‍́", "é"),
    ("한", "한"),
    ("ё", "ë"),
    ("⚠️", "⚠"),
]
DIFFERENT = [("Abc", "abc"), ("cafe", "café"), ("a  b", "a b"), ("a\r\nb", "a\nb"), ("1", "2"), ("a.", "a"), ("и", "u")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert one_form(a) == one_form(b) == one_form(one_form(a))


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_real_differences(a, b):
    assert one_form(a) != one_form(b)


def test_folding():
    assert one_form("STRASSE ﬁ", True) == one_form("straße FI", True)


def test_column(spark):
    rows = [(1, "Ｃａｆｅ́"), (2, None), (3, ""), (4, "Ｃａｆｅ́"), (5, "x​" * 50_000)]
    got = {r.id: r.f for r in spark.createDataFrame(rows, "id bigint, text string").select("id", normalised(F.col("text")).alias("f")).collect()}
    assert got == {1: "café", 2: None, 3: "", 4: "café", 5: "x" * 50_000}


def brute(rows):
    rows = sorted({(i, t) for i, t, _ in rows if i is not None and t is not None and one_form(t).strip()})
    return {(i, j) for k, (i, t) in enumerate(rows) for j, u in rows[k + 1 :] if t != u and i < j and one_form(t) == one_form(u)}


def test_pairs(spark):
    rnd = random.Random(8)
    plain = ["same old text", "peace of cake", "TODO"]
    swap = {"e": "е", "o": "ο", " ": " ", "a": "ａ"}
    rows = [(i, "".join(swap.get(c, c) if rnd.random() < 0.15 else c for c in rnd.choice(plain)), "f") for i in range(80)]
    rows += rows[:9] + [(900, None, "f"), (901, "", "f"), (902, "​", "f"), (903, " ", "f"), (904, " ", "f"), (None, "TODO", "f")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, form string")
    got = lookalike_pairs(df).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(brute(rows))
    assert lookalike_pairs(df.limit(0)).collect() == []


def test_an_invisible_character_between_a_letter_and_its_accent(spark):
    rows = [(1, "caf\u00e9 ok"), (2, "cafe\u200d\u0301 ok"), (3, "cafe\u0301 ok"), (4, "cafe ok"), (5, "\u0441af\u0435\u2060\u0301\u00a0ok")]
    got = lookalike_pairs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {tuple(r) for r in got} == {(1, 2), (1, 3), (1, 5), (2, 3), (2, 5), (3, 5)}


@pytest.mark.parametrize("block", [1000, 7])
def test_every_pair_of_a_form_of_many_texts(spark, block):
    marks = ["\u200b", "\u2060", "\ufeff"]
    rows = [(i, "OK" + "".join(marks[i // 3**k % 3] for k in range(7)), "f") for i in range(1050)]
    found = lookalike_pairs(spark.createDataFrame(rows, "doc_id bigint, text string, form string"), block=block) if block == 1000 else None
    if found is not None:
        assert found.count() == found.distinct().count() == 1050 * 1049 // 2
    few = rows[:20] + [(2000 + i, "OK", "f") for i in range(30)] + [(3000 + i, "same", "f") for i in range(9)]
    got = lookalike_pairs(spark.createDataFrame(few, "doc_id bigint, text string, form string"), block=block).collect()
    assert {tuple(r) for r in got} == brute(few) and len(got) == len(brute(few)) == 190 + 600


def test_every_pair_of_two_texts_with_many_copies(spark):
    rows = [(i, "TODO") for i in range(2000)] + [(5000 + i, "TОDO") for i in range(60)]
    got = lookalike_pairs(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got.count() == 120_000 and got.where("a_id >= 2000 or b_id < 5000").isEmpty()
