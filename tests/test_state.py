"""State graphs against plain Python: deep chains, forests, cycles, empty tables."""

import random
import re

import pytest

from lumenvec import shared
from lumenvec.operators import state

SCHEMA = "id bigint, parent bigint, released boolean"


def graph(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_deep_chain(spark):
    n = 10_000
    chain = graph(spark, [(i, i - 1 if i else None, i != 17) for i in range(n)])
    assert sorted(r.id for r in state.reachable(chain).collect()) == list(range(17, n))
    walk = state.first_children(chain)
    assert walk.where("root = 0 and id = step").count() == n
    top = state.replayed(chain, chain.where(f"id = {n - 1}").select("id"))
    assert top.where(f"first_session = {n - 1} and deepest = {n - 1} - id").count() == n
    pages = chain.selectExpr("id", "id div 3 as page")
    assert sorted(r.page for r in state.collectable(chain, pages).collect()) == list(range(5))


def test_ancestors_of_a_chain(spark):
    chain = graph(spark, [(i, i - 1 if i else None, False) for i in range(300)])
    assert {tuple(r) for r in state.ancestors(chain).collect()} == {(i, j, i - j) for i in range(300) for j in range(i)}


def test_forest(spark):
    rng = random.Random(3)
    parent = {i: (rng.randrange(i) if i and rng.random() < 0.9 else None) for i in range(200)}
    released = {i: rng.random() < 0.8 for i in parent}
    g = graph(spark, [(i, p, released[i]) for i, p in parent.items()])

    def up(i):
        out = []
        while (i := parent[i]) is not None:
            out.append(i)
        return out

    assert {tuple(r) for r in state.ancestors(g).collect()} == {(i, a, d) for i in parent for d, a in enumerate(up(i), 1)}
    assert {r.id for r in state.reachable(g).collect()} == {i for i in parent if not all(released[x] for x in [i, *up(i)])}
    first = {}
    for i, p in parent.items():
        if p is not None:
            first[p] = min(i, first.get(p, i))
    walks = set()
    for r in (i for i, p in parent.items() if p is None):
        i, step = r, 0
        while i is not None:
            walks.add((r, i, step))
            i, step = first.get(i), step + 1
    assert {tuple(r) for r in state.first_children(g).collect()} == walks
    sessions = [i for i in parent if i % 7 == 1]
    want = {}
    for s in sessions:
        for d, a in enumerate([s, *up(s)]):
            f, m = want.get(a, (s, 0))
            want[a] = (min(f, s), max(m, d))
    got = state.replayed(g, spark.createDataFrame([(s,) for s in sessions], "id bigint")).collect()
    assert {r.id: (r.first_session, r.deepest) for r in got} == want


def test_cycles_and_empty_tables(spark):
    cycle = graph(spark, [(1, 3, True), (2, 1, True), (3, 2, True), (4, 5, False), (5, 4, True), (6, None, True)])
    assert {r.id for r in state.reachable(cycle).collect()} == {4, 5}
    assert [tuple(r) for r in state.first_children(cycle).collect()] == [(6, 6, 0)]
    with pytest.raises(ValueError):
        state.ancestors(cycle)
    none = graph(spark, [])
    assert state.ancestors(none).count() == state.reachable(none).count() == state.first_children(none).count() == 0
    assert state.replayed(none, none.select("id")).count() == 0


def test_tasks_of_deltas_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 500, raising=False)
    n = 4000
    own = {i: {i % 7, i % 11 + 1, i % 13 + 2} for i in range(n)}
    pages = spark.createDataFrame([(i, p) for i, ps in own.items() for p in ps], "id bigint, page bigint")
    edges = spark.createDataFrame([(i, i // 4) for i in range(4, n)], "id bigint, parent bigint")
    found = state.delta(edges, pages)
    want = {(i, p, "added") for i in range(4, n) for p in own[i] - own[i // 4]} | {(i, p, "removed") for i in range(4, n) for p in own[i // 4] - own[i]}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    graph_ = edges.selectExpr("id", "parent", "true as released")
    for df in (found, state.similarity(graph_, pages, 0.8), state.collectable(graph_, pages)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        dealt = [int(n) for n in re.findall(r"RepartitionByExpression \[[^]]*\], (\d+)", plan)]
        assert len(dealt) >= 2 and min(dealt) >= 20, plan
