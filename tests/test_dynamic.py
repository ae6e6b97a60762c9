"""Graphs under changes: known values, and equality with working all out anew after each batch."""

import itertools
import random
from collections import Counter

import pytest

NAMES = ["size", "order", "max_degree", "num_triangles", "scan1"]


def plain(edges):
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    triangles = [t for t in itertools.combinations(sorted(near), 3) if t[1] in near[t[0]] and t[2] in near[t[0]] and t[2] in near[t[1]]]
    at = Counter(n for t in triangles for n in t)
    return len(edges), len(near), max(map(len, near.values()), default=0), len(triangles), max((len(x) + at[n] for n, x in near.items()), default=0)


def densest(edges):
    best = 0.0
    nodes = sorted({n for e in edges for n in e})
    for k in range(1, len(nodes) + 1):
        for part in itertools.combinations(nodes, k):
            best = max(best, sum(u in part and v in part for u, v in edges) / k)
    return best


def changes(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"u {kind}, v {kind}, delta int")


def test_known_values(spark):
    from framelake.graphs.dynamic import DynamicGraph

    g = DynamicGraph(spark, "string")
    state = lambda: (*g.invariants().first(), g.mad_lower_k())
    assert state() == (0, 0, 0, 0, 0, 0)
    first = [("0", "1"), ("0", "2"), ("1", "3"), ("2", "3"), ("2", "4"), ("3", "4"), ("1", "x")]
    g.apply(changes(spark, [(u, v, 1) for u, v in first], "string"))
    assert state() == (7, 6, 3, 1, 4, 2400)
    g.apply(changes(spark, [("0", "3", 1)], "string"))
    assert state() == (8, 6, 4, 3, 7, 2800)
    g.apply(changes(spark, [("3", "0", 1), ("0", "3", 1)], "string"))
    assert state() == (8, 6, 4, 3, 7, 2800) and g.edges.where("u = '0' and v = '3'").first()["k"] == 3
    other = g.copy()
    for left in (2, 1):
        g.apply(changes(spark, [("0", "3", -1)], "string"))
        assert state()[0] == 8
    g.apply(changes(spark, [("3", "0", -1)], "string"))
    assert state() == (7, 6, 3, 1, 4, 2400)
    with pytest.raises(ValueError, match="not there"):
        g.apply(changes(spark, [("0", "3", -1)], "string"))
    with pytest.raises(ValueError, match="different"):
        g.apply(changes(spark, [("3", "3", 1)], "string"))
    g.apply(changes(spark, [(v, u, -1) for u, v in first], "string"))
    assert state() == (0, 0, 0, 0, 0, 0) and g.nodes.count() == 0
    assert tuple(other.invariants().first()) == (8, 6, 4, 3, 7)


def test_a_complete_graph(spark):
    from framelake.graphs.dynamic import DynamicGraph

    g = DynamicGraph(spark)
    g.apply(changes(spark, [(a, b, 1) for a in range(8) for b in range(8) if a != b]))
    assert (*g.invariants().first(), g.mad_lower_k(), g.mad_lower_k(small=0)) == (28, 8, 7, 56, 28, 7000, 7000)


def test_batches_equal_working_all_out(spark):
    from framelake.graphs.dynamic import DynamicGraph

    r, g, held = random.Random(6), DynamicGraph(spark), Counter()
    for batch in range(5):
        rows = []
        for _ in range(60):
            u, v = r.choice([(0, r.randrange(1, 25)), tuple(r.sample(range(25), 2))])  # 0 is a hub
            rows.append((u, v, 1))
            held[min(u, v), max(u, v)] += 1
        if batch:
            for e in r.sample(sorted(held.elements()), 55):
                rows.append((*e, -1))
                held[e] -= 1
        held = +held
        g.apply(changes(spark, rows).repartition(3))
        assert tuple(g.invariants().select(*NAMES).first()) == plain(list(held))
        assert {(x["u"], x["v"]): x["k"] for x in g.edges.collect()} == held


def test_bounds_of_the_average_degree(spark):
    """Never above the densest part, never below half of it, whether peeled in rounds or in one task."""
    from framelake.graphs.dynamic import mad_lower_k

    for seed in range(4):
        r = random.Random(seed)
        edges = sorted({tuple(sorted(r.sample(range(11), 2))) for _ in range(18)} | {(20, 21), (21, 22)})
        df, most = spark.createDataFrame(edges, "u long, v long"), 2000 * densest(edges)
        for small in (0, 10, 10**6):
            assert most / 2 - 1 <= mad_lower_k(df, small) <= most + 1
        assert mad_lower_k(df) >= 0.9 * most
    assert mad_lower_k(spark.createDataFrame([(i, i + 1) for i in range(5)], "u long, v long")) == 1667
