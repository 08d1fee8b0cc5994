import random

import pytest

from larkspur.operators.hierarchy import descendant_rows, hierarchy

SCHEMA = "id bigint, supersedes bigint, slug string"


def brute(rows):
    """id -> (shape, root, depth, path, number of descendants), one node at a time."""
    par = {i: p for i, p, _ in rows}
    slug = {i: s for i, _, s in rows}
    par = {i: p if p in par else None for i, p in par.items()}
    out, chain = {}, {}
    for i in par:
        seen, x = [], i
        while x is not None and x not in seen:
            seen.append(x)
            x = par[x]
        chain[i] = seen
        if x is None:
            out[i] = ["tree", seen[-1], len(seen) - 1, "/".join(slug[k] for k in reversed(seen)), 0]
        else:
            ring = seen[seen.index(x) :]
            out[i] = ["cycle" if i in ring else "tail", min(ring), -1, "", -1]
    for i, seen in chain.items():
        if out[i][0] == "tree":
            for a in seen[1:]:
                out[a][4] += 1
    return {i: tuple(v) for i, v in out.items()}


def got(df):
    return {r.id: (r.shape, r.root_id, r.depth, r.slug_path, r.n_desc) for r in df.collect()}


@pytest.mark.parametrize("limit", [50_000, 2])
def test_random_forests_with_circles(spark, limit):
    rnd = random.Random(5)
    rows = []
    for i in range(1, 160):
        p = rnd.choice([None, i - 1, rnd.randint(1, 159), rnd.randint(1, 20), 9999])
        rows.append((i, p, f"s{i}"))
    df = spark.createDataFrame(rows + rows[:10], SCHEMA)
    assert got(hierarchy(df, max_component=limit)) == brute(rows)


@pytest.mark.parametrize("limit", [50_000, 5])
def test_long_chain_star_and_tail_into_circle(spark, limit):
    chain = [(i, i - 1 if i > 1 else None, f"c{i}") for i in range(1, 70)]
    star = [(1000 + i, 1000 if i else None, f"x{i}") for i in range(60)]
    loop = [(2000, 2002, "a"), (2001, 2000, "b"), (2002, 2001, "c")] + [(2003 + k, 2002 + k, f"t{k}") for k in range(20)] + [(3000, 3000, "self")]
    rows = chain + star + loop
    assert got(hierarchy(spark.createDataFrame(rows, SCHEMA), max_component=limit)) == brute(rows)


def test_nulls_empty_and_clashing_columns(spark):
    assert hierarchy(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None, None, "l"), (None, 1, "x", "l"), (2, 1, "b", None)]
    df = spark.createDataFrame(rows, "id bigint, supersedes bigint, slug string, label string")
    assert got(hierarchy(df)) == {1: ("tree", 1, 0, "", 1), 2: ("tree", 1, 1, "/b", 0)}


def test_descendants_and_back_edges(spark):
    rows = [(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 1, "d"), (7, 8, "e"), (8, 7, "f")]
    full = {r.id: r for r in hierarchy(spark.createDataFrame(rows, SCHEMA), full=True).collect()}
    assert full[1].descendants == [2, 3, 4] and full[2].descendants == [3]
    edges = [(r.id, r.back_edge_to) for r in full.values() if r.back_edge_to is not None]
    assert len(edges) == 1 and set(edges[0]) == {7, 8}


@pytest.mark.parametrize("limit", [50_000, 3])
def test_descendants_and_back_edges_at_any_size(spark, limit):
    chain = [(i, i - 1 if i > 1 else None, f"c{i}") for i in range(1, 30)]
    loop = [(50, 52, "a"), (51, 50, "b"), (52, 51, "c"), (53, 50, "t"), (54, 53, "t")]
    self_loop = [(60, 60, "s")] + [(61 + k, 60, "t") for k in range(4)]
    df = spark.createDataFrame(chain + loop + self_loop, SCHEMA)
    below = [(a, b) for a in range(1, 30) for b in range(a + 1, 30)]
    assert sorted(tuple(r) for r in descendant_rows(df, max_component=limit).collect()) == below
    full = hierarchy(df, max_component=limit, full=True).collect()
    assert sorted((r.id, x) for r in full for x in r.descendants) == below
    back = sorted((r.root_id, r.shape, {50: 52, 51: 50, 52: 51, 60: 60}[r.id] == r.back_edge_to) for r in full if r.back_edge_to is not None)
    assert back == [(50, "cycle", True), (60, "cycle", True)]
