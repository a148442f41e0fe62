"""Connected components of chains, which few steps must do."""

import numpy as np
import pytest

from pagewright.operators import assets, graph


@pytest.mark.parametrize("local", [0, 10_000])
def test_a_chain_takes_few_steps(spark, monkeypatch, local):
    steps, cut = [], graph.cut
    monkeypatch.setattr(graph, "MOST_LOCAL", local, raising=False)
    monkeypatch.setattr(graph, "cut", lambda df: steps.append(1) or cut(df))
    n, rng = 60, np.random.default_rng(5)
    shuffled = rng.permutation(n).tolist()
    edges = [(1, i, i + 1) for i in range(n - 1)] + [(2, a, b) for a, b in zip(shuffled, shuffled[1:], strict=False)] + [(3, 5, 5), (3, 8, 9)]
    got = {(r["page_id"], r["node"]): r["root"] for r in graph.components(spark.createDataFrame(edges, "page_id long, a long, b long")).collect()}
    assert got == {(p, i): 0 for p in (1, 2) for i in range(n)} | {(3, 5): 5, (3, 8): 8, (3, 9): 8}
    assert len(steps) <= 40


def test_best_members_of_a_chain(spark):
    rows = [(1, i, "image", [], None, False, f"v{i // 2}", f"s{(i + 1) // 2}", float(i % 50)) for i in range(200)]
    members = spark.createDataFrame(rows, "page_id long, idx long, kind string, groups array<long>, preferred_group long, art_directed boolean, variant_key string, sha1 string, size_score double")
    got = assets.best_members(members, assets.variant_groups(members)).collect()
    assert [(r["root"], r["best"], r["members"]) for r in got] == [(0, 49, 200)]


def test_random_graphs_take_the_least_node_by_steps_alone(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_LOCAL", 0)
    rng = np.random.default_rng(11)
    edges = [(p, f"n{a:03}", f"n{b:03}") for p in (1, 2) for a, b in rng.integers(0, 150, (120, 2)).tolist()] + [(3, f"n{i:03}", f"n{i + 1:03}") for i in range(149)]
    root = {(p, n): (p, n) for p, a, b in edges for n in (a, b)}
    for _ in range(150):
        for p, a, b in edges:
            root[p, a] = root[p, b] = min(root[p, a], root[p, b])
    got = {(r["page_id"], r["node"]): (r["page_id"], r["root"]) for r in graph.components(spark.createDataFrame(edges, "page_id long, a string, b string")).collect()}
    assert got == root


def test_no_side_of_guessed_size_is_broadcast(spark, monkeypatch):
    plans, cut = [], graph.cut
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(graph, "MOST_LOCAL", 0)
    monkeypatch.setattr(graph, "cut", lambda df: cut(plan(df)))
    members = spark.range(60).selectExpr("id % 2 AS page_id", "id AS idx", "'image' AS kind", "array() :: array<bigint> AS groups", "NULL :: bigint AS preferred_group", "false AS art_directed", "concat('v', id div 4) AS variant_key", "concat('s', (id + 2) div 4) AS sha1", "double(id) AS size_score")
    got = plan(assets.best_members(members, assets.variant_groups(members))).collect()
    assert {(r["page_id"], r["root"], r["best"], r["members"]) for r in got} == {(0, 0, 58, 30), (1, 1, 59, 30)}
    assert not [p for p in plans if "Broadcast" in p]
