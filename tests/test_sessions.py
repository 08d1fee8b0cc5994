import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators.sessions import instant_ms, nodes, sessionise

GAP = 30 * 60_000


def brute(rows):
    by = {}
    for i, a, s, ms in set(rows):
        if None not in (a, s, ms):
            by.setdefault((a, s), set()).add((ms, i))
    out = []
    for (a, s), ev in by.items():
        ev = sorted(ev, key=lambda x: (x[0], str(x[1])))
        first, last, n = ev[0][0], ev[0][0], 1
        for ms, _ in ev[1:]:
            if ms - last >= GAP:
                out.append((a, s, first, last, n))
                first, n = ms, 0
            last, n = ms, n + 1
        out.append((a, s, first, last, n))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, a string, s string, ms bigint")
    return sorted(tuple(r) for r in sessionise(df, ["a", "s"], "id", "ms", GAP).collect())


@pytest.mark.parametrize("shift", [0, 1, GAP // 2, GAP - 1])
def test_against_one_pass_over_each_key(spark, shift):
    rnd = random.Random(2)
    rows = []
    for i in range(600):
        key = rnd.choice(["hot", "hot", "hot", "b", None])
        rows.append((i, key, rnd.choice(["x", "y", None]) if key != "hot" else "x", rnd.choice([None, rnd.randint(-5 * GAP, 300 * GAP), rnd.randint(0, 10) * GAP])))
    rows += [(900 + k, "long", "x", k * (GAP - 1)) for k in range(120)]  # one session over many cells
    rows += [(2000, "edge", "x", 0), (2001, "edge", "x", GAP), (2002, "edge", "x", 2 * GAP - 1)]
    rows += [(3000 + k, "burst", "x", 10 * GAP + k % 7) for k in range(500)]  # one cell holds a third of all
    rows += rows[:50]
    rows = [(i, a, s, None if ms is None else ms + shift) for i, a, s, ms in rows]
    assert run(spark, rows) == brute(rows)


def test_no_window_over_a_key(spark):
    df = spark.createDataFrame([(1, "a", "s", 5)], "id bigint, a string, s string, ms bigint")
    plan = nodes(df, ["a", "s"], "id", "ms", GAP)._jdf.queryExecution().toString()
    assert "Window" not in plan and "partial_count" in plan


def test_empty_and_ties(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "a", "s", 5), (2, "a", "s", 5), (1, "a", "s", 5), (None, "a", "s", 5), (None, "a", "s", 5)]) == [("a", "s", 5, 5, 3)]


def test_a_gap_is_positive(spark):
    with pytest.raises(ValueError):
        sessionise(spark.createDataFrame([], "id bigint, a string, ms bigint"), ["a"], "id", "ms", 0)


def test_instants(spark):
    rows = [("2026-05-01T00:00:01Z",), ("2026-05-01T01:00:01.250+01:00",), ("pending",), ("",), (None,), ("2026-05-01",), ("2026-13-01T00:00:00Z",)]
    got = [r.ms for r in spark.createDataFrame(rows, "ts string").select(instant_ms(F.col("ts")).alias("ms")).collect()]
    assert got == [1777593601000, 1777593601250, None, None, None, None, None]
