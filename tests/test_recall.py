import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from larkspur.config import EngineConfig
from larkspur.functions.relevance import floor_relevance, passes_floor, prepared
from larkspur.functions.text import agent_name, search_terms, slug, task_terms
from larkspur.operators import mutate, pack, report
from larkspur.operators import search as se
from larkspur.operators.activation import activation_scores, hot_cold_counts
from larkspur.operators.bm25 import TextIndex, bm25
from larkspur.operators.components import connected_components
from larkspur.session import once, written

MEMORY = "id bigint, name string, title string, body string, owner string, scope string, source_path string, content_hash string, is_lock int, status string, created_at string, updated_at string"
EPISODE = "id bigint, ts string, actor string, kind string, summary string, body string, scope string, source_path string"
RECALL = "id bigint, memory_id bigint, queried_by string, query_scope string, ts string"
LOCK = "id bigint, slug string, title string, body string, scope string, locked_on string, status string, supersedes bigint"
ACL = "owner_node string, reader string, granted int"
FUTURE = "id bigint, body string, due string, created_by string, status string, created_at string"


def mem(i, title, body, owner="shared", scope="company", lock=0, status="hot"):
    return (i, slug(title or "x"), title, body, owner, scope, None, None, lock, status, None, None)


def test_terms():
    assert search_terms("Write the Checkout-retry TESTS for café") == ["checkout", "retry", "tests", "caf"]
    assert task_terms("fix the log-in log-in a_b x") == ["fix", "log-in", "log-in", "a_b"]
    assert slug("Ünder Score_x!") == "nder-score-x" and slug("--") == "untitled"
    assert agent_name(" @Planner ") == "agent:planner" and agent_name("agent:x") == "agent:x"
    assert EngineConfig(match_floor=7).match_floor == 0.5


@pytest.mark.parametrize("query", ["red", "red blue", "gre yel blu", "zzz red"])
def test_bm25_equals_sqlite(spark, query):
    rnd = random.Random(3)
    words = ["red", "reddish", "blue", "green", "yellow", "Café", "the", "x1"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 5))), " ".join(rnd.choices(words, k=rnd.randint(0, 30)))) for i in range(80)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(title, body)")
    db.executemany("insert into f(rowid, title, body) values (?, ?, ?)", rows)
    terms = query.split()
    want = {i: s for i, s in db.execute("select rowid, bm25(f, 5, 1) from f where f match ?", (" OR ".join(f"{t}*" for t in terms),))}
    got = {r.id: r.bm25 for r in bm25(spark.createDataFrame(rows, "id bigint, title string, body string"), {"title": 5, "body": 1}, terms).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)


def test_an_appended_index_equals_one_pass_over_the_rows(spark):
    rnd = random.Random(5)
    words = ["red", "reddish", "blue", "green", "yellow", "Café", "the", "x1"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 5))) or None, " ".join(rnd.choices(words, k=rnd.randint(0, 30)))) for i in range(90)]
    df = spark.createDataFrame(rows, "id bigint, title string, body string")
    weights = {"title": 5, "body": 1}
    a, b = (TextIndex.over(df.where(w), weights, written) for w in ("id < 60", "id >= 60"))
    both = TextIndex(a.terms.unionByName(b.terms), a.sizes.unionByName(b.sizes), weights)
    for terms in (["red"], ["red", "blu"], ["caf", "zzz"], ["zzz"], []):
        want = {(r.id, r.bm25, r.all_terms) for r in bm25(df, weights, terms).select("id", "bm25", "all_terms").collect()}
        for index in (both, TextIndex.over(df, weights, None)):
            got = {tuple(r) for r in index.hits(terms).collect()}
            assert {x[::2] for x in got} == {x[::2] for x in want} and all(abs(x[1] - y[1]) < 2e-6 for x, y in zip(sorted(got), sorted(want)))
    assert TextIndex.over(df.limit(0), weights, written).hits(["red"]).collect() == []
    plan = both.hits(["red"])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,red)" in plan
    plan = se.best_of(both.hits(["red"]).withColumn("scope_index", F.col("id") % 3), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_once(spark):
    rows = [(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "c"), (3, None)]
    df = spark.createDataFrame(rows, "id bigint, x string")
    assert sorted(map(str, once(df).collect())) == sorted(map(str, df.distinct().collect())) and once(df.limit(0)).collect() == []


def test_activation(spark):
    now = "2026-01-10 00:00:00"
    rows = [(1, 1, "a", "os", "2026-01-09T00:00:00Z"), (1, 1, "a", "os", "2026-01-09T00:00:00Z"), (2, 1, "a", "os", "2026-01-06T00:00:00+00:00"), (3, 2, "a", "os", "2026-01-06T00:00:00Z"), (4, 3, "a", "os", "later"), (5, None, "a", "os", "2026-01-06T00:00:00Z")]
    r = spark.createDataFrame(rows, RECALL)
    assert {x.memory_id: x.activation for x in activation_scores(r, now).collect()} == {1: round(math.log(1.5), 6), 2: round(-math.log(2), 6)}
    m = spark.createDataFrame([mem(1, "a", ""), mem(3, "b", ""), mem(4, "c", "", lock=1), mem(5, "d", "", status="archived")], MEMORY)
    assert tuple(hot_cold_counts(m, r, now).first()) == (2, 1)


def test_limit_comes_before_access(spark):
    m = [mem(i, "topic topic", "topic", "agent:closed") for i in range(5)] + [mem(10, "topic", "topic and more words here", "agent:open")]
    acl = spark.createDataFrame([("agent:closed", "*", 0), ("agent:closed", "agent:friend", 1)], ACL)
    e = spark.createDataFrame([], EPISODE)
    df = spark.createDataFrame(m, MEMORY)
    assert se.search(df, e, acl, "topic", "company", "agent:me", 3).collect() == []
    assert [r.id for r in se.search(df, e, acl, "topic", "company", "agent:me", 6).collect()] == [10]
    assert len(se.search(df, e, acl, "topic", "company", "agent:friend", 3).collect()) == 3


def test_all_terms_before_any_and_scopes(spark):
    acl = spark.createDataFrame([], ACL)
    m = spark.createDataFrame([mem(1, "alpha beta", "x", scope="os"), mem(2, "alpha", "alpha gamma", scope="company"), mem(3, "alpha beta gamma", None, scope="product:n"), mem(4, None, None)], MEMORY)
    e = spark.createDataFrame([(7, None, "x", "ticket", "alpha beta", None, "company", None)], EPISODE)
    got = se.search(m, e, acl, "alpha beta", "company").collect()
    assert {(r.kind, r.id) for r in got} == {("memory", 1), ("memory", 3), ("episode", 7)}
    assert [r.rank for r in got if r.kind == "episode"] == [-0.55]
    got = se.search(m, e, acl, "alpha gamma zzzz", "product:n").collect()
    assert [(r.id, r.scope_index) for r in got] in ([(3, 0), (2, 1)], [(2, 1), (3, 0)])
    assert se.search(m.limit(0), e.limit(0), acl, "alpha", "os").collect() == []


def test_packs(spark, tmp_path):
    t = {
        "memories": spark.createDataFrame([mem(1, "Testing standard", "run tests first ✅", lock=1), mem(2, "Zero rule", "zero-manual-cli always", lock=1), mem(3, "Other", "nothing")], MEMORY),
        "episodes": spark.createDataFrame([(1, "2026-01-09T10:00:00Z", "agent:a", "ticket", "espresso repair", None, "os", None)], EPISODE),
        "locks": spark.createDataFrame([(5, "store-rule", "Store rule", "espresso only", "os", "2026-01-01", "active", None)], LOCK),
        "recall_events": spark.createDataFrame([(1, 3, "a", "os", "2026-01-09T00:00:00Z")], RECALL),
        "node_acl": spark.createDataFrame([], ACL),
        "future_items": spark.createDataFrame([(1, "espresso filter", "2026-01-20", "a", "open", None), (2, "x", "bad", "a", "open", None)], FUTURE),
    }
    for n, df in t.items():  # as in use: tables are read from files
        df.coalesce(1).write.parquet(str(tmp_path / n))
    t = {n: spark.read.parquet(str(tmp_path / n)) for n in t}
    now = "2026-01-10 00:00:00"
    titles = lambda df: [r.title for r in df.orderBy("line").collect()]
    assert titles(pack.context(t, "me", "espresso", now)) == ["Store rule", "Zero rule", "2026-01-20"]
    assert titles(pack.context(t, "me", "qqqq", now)) == ["Zero rule", "No task match"]
    assert set(titles(pack.brief(t, "me", now, "2026-01-09"))) == {"Zero rule", "Store rule", "Testing standard", "Other", "2026-01-20", "bad", "espresso repair"}
    assert {r.section for r in pack.prune_report(t["memories"], t["recall_events"], now).collect()} == {"lock-exempt"}


def test_the_floor_test_equals_the_floor_value(spark):
    bodies = ["", "test", "Tests for review", "log-in add", "review the launch", "pytest coverage", "public opening", "ADD review ship", "xtest addx"]
    rows = spark.createDataFrame([(f"n{i}-{a}", a, b) for i, a in enumerate(["", "Testing", "review", None]) for b in bodies], "name string, title string, body string")
    for task in ("test review", "add review launch ship", "log-in folder", "test", "launch alpha", "alpha beta gamma", "add"):
        terms = task_terms(task)
        for floor in (0.3, 0.5, 0.66, 0.9):
            got = prepared(rows).selectExpr(f"{floor_relevance(terms)} >= {floor}D AS a", f"{passes_floor(terms, floor)} AS b").collect()
            assert all(r.a == r.b for r in got), (task, floor)


def test_consolidation(spark):
    m = spark.createDataFrame([mem(1, "p", "", scope="product:n"), mem(2, "l", "", lock=1), mem(3, "z", "", status="archived")], MEMORY)
    rows = [(i, 1, "a", s, "2026-01-09T00:00:00Z") for i, s in enumerate(["os", "company", "company", "product:n"])] + [(9, 3, "a", "os", None), (10, 3, "a", "os", "x")]
    got = {(r.kind, r.id): r for r in report.consolidation(m, spark.createDataFrame(rows, RECALL), "2026-01-10 00:00:00").collect()}
    assert set(got) == {("promotion-candidate", 1), ("promotion-candidate", 3), ("lock-exempt", 2)}
    assert got[("promotion-candidate", 1)].suggested_scope == "company" and got[("promotion-candidate", 1)].required_tier == "curator" and got[("promotion-candidate", 1)].higher == 3


def test_numbering_is_dense(spark):
    rows = spark.createDataFrame([(f"k{i:03}",) for i in range(50)], "k string").repartition(7)
    top = spark.createDataFrame([(None,)], "top bigint")
    assert [r.id for r in mutate.numbered(rows, ["k"], top).orderBy("k").collect()] == list(range(1, 51))


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 500), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {x: find(x) for x in parent}
