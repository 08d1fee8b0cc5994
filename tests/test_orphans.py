import random

import pytest

from larkspur.operators.orphans import orphan_counts, orphan_references

SCHEMAS = {
    "recall_events": "id bigint, memory_id bigint, ts string, target string",
    "locks": "id bigint, supersedes bigint, locked_on string",
    "links": "from_kind string, from_id bigint, to_kind string, to_id bigint, kind string",
    "memories": "id bigint, target string",
    "episodes": "id bigint",
}


def frames(spark, **rows):
    return {n: spark.createDataFrame(rows.get(n, []), s) for n, s in SCHEMAS.items()}


@pytest.mark.parametrize("heavy", [1000, 2])
def test_against_sets(spark, heavy):
    rnd = random.Random(1)
    mem, epi = [(i, "t") for i in range(40)] + [(None, "t")], [(i,) for i in range(100, 130)]
    ev = [(i, rnd.choice([7, 7, 7, 999, 999, 999, None, rnd.randint(0, 60)]), rnd.choice(["2026-05-01T00:00:00Z", "n/a", None]), "z") for i in range(400)]
    lo = [(i, rnd.choice([None, i - 1, 555]), "2025-01-02") for i in range(30)]
    li = [(rnd.choice(["memory", None]), rnd.randint(0, 5), rnd.choice(["memory", "episode", "lock", "other", None]), rnd.choice([None, 3, 110, 888, rnd.randint(0, 200)]), "wiki") for _ in range(200)]
    t = frames(spark, memories=mem, episodes=epi, recall_events=ev + ev[:40], locks=lo + lo[:3], links=li)
    ids = {"memory": {i for i, _ in mem}, "episode": {i for (i,) in epi}, "lock": {i for i, _, _ in lo}}
    want = {("recall_events", str(i), m) for i, m, _, _ in ev if m is not None and m not in ids["memory"]}
    want |= {("locks", str(i), s) for i, s, _ in lo if s is not None and s not in ids["lock"]}
    want |= {("links", ":".join("" if x is None else str(x) for x in r), r[3]) for r in li if r[3] is not None and r[2] in ids and r[3] not in ids[r[2]]}
    got = orphan_references(t, heavy).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    counts = {(r.tbl, r.period): r.n_orphans for r in orphan_counts(t, heavy).collect()}
    assert sum(counts.values()) == len(want)
    assert counts[("recall_events", "2026-05")] == len({i for i, m, ts, _ in ev if ts and ts[0] == "2" and m is not None and m not in ids["memory"]})


def test_empty_tables(spark):
    assert orphan_references(frames(spark)).collect() == []
    one = frames(spark, recall_events=[(1, 5, None, "x")])
    assert [tuple(r) for r in orphan_counts(one).collect()] == [("recall_events", None, 1)]
