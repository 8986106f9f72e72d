"""Communities by modularity."""

import random
from collections import Counter

import pytest

from riskloom.operators import communities as C
from riskloom.operators import graph as G


def frames(spark, nodes, edges, parts=4):
    return (spark.createDataFrame([(i,) for i in nodes], "id long").repartition(parts),
            spark.createDataFrame(edges, "src long, dst long").repartition(parts))


def value(edges, label):
    """Modularity from its definition."""
    m, degree = len(edges), Counter(x for e in edges for x in e)
    inside = Counter(label[a] for a, b in edges if label[a] == label[b])
    total = Counter()
    for x, d in degree.items():
        total[label[x]] += d
    return sum(inside[c] / m - (total[c] / (2 * m)) ** 2 for c in set(label.values()))


def planted(groups=5, size=8, between=6, seed=3):
    rng = random.Random(seed)
    edges = {(g * size + a, g * size + b) for g in range(groups) for a in range(size) for b in range(a) if rng.random() < 0.8}
    edges = {(min(e), max(e)) for e in edges}
    while between:
        a, b = sorted(rng.sample(range(groups * size), 2))
        if a // size != b // size and (a, b) not in edges:
            edges.add((a, b))
            between -= 1
    return list(range(groups * size)), sorted(edges)


def test_modularity_is_its_definition(spark):
    nodes, edges = planted()
    rng = random.Random(1)
    for k in (1, 3, 40):
        label = {i: rng.randrange(k) for i in nodes}
        v, e = frames(spark, nodes, edges)
        got = C.modularity(e, spark.createDataFrame(list(label.items()), "id long, community long"))
        assert abs(got - value(edges, label)) < 1e-12
    assert C.modularity(e.limit(0), v.selectExpr("id", "id AS community")) == 0


def test_planted_groups_are_found_on_any_partitioning(spark):
    nodes, edges = planted()
    nodes = [*nodes, 99, 100]                                    # two without edges
    want = {i: i // 8 * 8 if i < 40 else i for i in nodes}
    for parts in (1, 8):
        got = C.modularity_communities(*frames(spark, [*nodes, 99], edges, parts)).collect()
        assert {r.id: r.community for r in got} == want and len(got) == len(nodes)


def test_peer_chain(spark):
    """One tier of the account graph: each node tied to the next four."""
    nodes, edges = list(range(40)), [(i, j) for i in range(40) for j in range(i + 1, min(40, i + 5))]
    label = {r.id: r.community for r in C.modularity_communities(*frames(spark, nodes, edges)).collect()}
    members = {}
    for x, c in label.items():
        members.setdefault(c, []).append(x)
    assert all(min(m) == c for c, m in members.items())
    assert value(edges, label) > value(edges, {i: i // 20 for i in nodes})   # better than two halves


def test_a_round_is_a_few_small_jobs(spark, monkeypatch):
    """Small sides are not shuffled: most of a round's time is its number of Spark jobs."""
    nodes, edges = list(range(24)), [(i, j) for i in range(24) for j in range(i + 1, min(24, i + 4))]
    v, e = frames(spark, nodes, edges)
    move, rounds, sc = C._moved, [], spark.sparkContext
    monkeypatch.setattr(C, "_moved", lambda *a: rounds.append(1) or move(*a))
    sc.setJobGroup("rounds", "communities")
    try:
        got = {r.id: r.community for r in C.modularity_communities(v, e).collect()}
        jobs = len(sc.statusTracker().getJobIdsForGroup("rounds"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert value(edges, got) > 0.3
    assert jobs <= 16 * len(rounds), (jobs, len(rounds))


def test_nodes_without_name_or_edges(spark):
    nodes, edges = planted(groups=2, size=6, between=1)
    got = [tuple(r) for r in C.modularity_communities(*frames(spark, [*nodes, 70, 70, None], edges)).collect()]
    assert sorted(got) == [(i, i // 6 * 6 if i < 12 else i) for i in [*nodes, 70]]


def test_empty_graph(spark):
    v, e = frames(spark, [], [])
    assert C.modularity_communities(v, e).count() == 0
    v, _ = frames(spark, [4, 2, 2], [])
    assert sorted(map(tuple, C.modularity_communities(v, e).collect())) == [(2, 2), (4, 4)]


def test_label_propagation_ends_or_raises(spark):
    edges = [(10 * g + a, 10 * g + b) for g in range(3) for b in range(4) for a in range(b)]
    nodes = sorted({x for e in edges for x in e} | {99})
    got = {r.id: r.community for r in G.label_propagation(*frames(spark, nodes, edges)).collect()}
    assert got == {i: i // 10 * 10 if i < 99 else i for i in nodes}
    with pytest.raises(RuntimeError):                            # two nodes swap their labels for ever
        G.label_propagation(*frames(spark, [1, 2], [(1, 2)]), max_rounds=6)
