"""Orders of graphs against plain walks over small ones."""

import random

import pytest

ARCS = "id long, src long, dst long, label string"


def random_dag(n, m, seed):
    r = random.Random(seed)
    name = r.sample(range(1000), n)
    pairs = [sorted(r.sample(range(n), 2)) for _ in range(m)]
    return [(i, name[a], name[b], r.choice("xyz")) for i, (a, b) in enumerate(pairs)]


def depths(arcs):
    nodes = {n for _, a, b, _ in arcs for n in (a, b)}
    depth = dict.fromkeys(nodes, 0)
    for _ in nodes:
        for _, a, b, _ in arcs:
            depth[b] = max(depth[b], depth[a] + 1)
    return depth


@pytest.mark.parametrize("small", [0, 40, 10**6])
def test_canonical_dag(spark, small):
    """Round by round, with the last arcs in one task, and all in one task."""
    from framelake.graphs.orders import canonical_dag

    arcs = random_dag(60, 150, 4)
    nodes, placed = canonical_dag(spark.createDataFrame(arcs, ARCS).repartition(3), small)
    depth = depths(arcs)
    order = sorted(depth, key=lambda n: (depth[n], n))
    number = {n: k for k, n in enumerate(order)}
    assert sorted(map(tuple, nodes.select("id", "depth", "node").collect())) == sorted((n, depth[n], number[n]) for n in depth)
    want = sorted(((number[b], i, number[a], x) for i, a, b, x in arcs))
    assert sorted(map(tuple, placed.collect()), key=lambda x: x[1]) == [(i, k, a, b, x) for k, (b, i, a, x) in enumerate(want)]
    assert all(r["src"] < r["dst"] for r in placed.collect())


def test_canonical_dag_of_three_nodes(spark):
    """Nodes 0, 1, 2 become 2, 0, 1; the arcs into the last come last."""
    from framelake.graphs.orders import canonical_dag

    nodes, arcs = canonical_dag(spark.createDataFrame([(0, 2, 0, "-20"), (1, 1, 2, "-21"), (2, 1, 0, "-22")], ARCS))
    assert {r["id"]: r["node"] for r in nodes.collect()} == {0: 2, 1: 0, 2: 1}
    assert [tuple(r)[2:] for r in arcs.orderBy("arc").collect()] == [(0, 1, "-21"), (1, 2, "-20"), (0, 2, "-22")]


@pytest.mark.parametrize("small", [0, 10**6])
def test_cycles_raise_and_long_chains_do_not(spark, small):
    from framelake.graphs.orders import topological_depth

    for arcs in ([(0, 1), (1, 0)], [(5, 6), (6, 7), (7, 6), (7, 8)], [(3, 3)]):
        with pytest.raises(ValueError, match="cycle"):
            topological_depth(spark.createDataFrame(arcs, "src long, dst long"), small)
    n = 12 if small == 0 else 5000
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(0, n)], "src long, dst long")
    assert topological_depth(chain, small).where("id = depth").count() == n + 1
    assert topological_depth(chain.limit(0), small).count() == 0


def test_rows_are_numbered_by_ranges(spark):
    from framelake.plans.lineage import numbered

    r = random.Random(2)
    rows = [(r.randrange(4), k) for k in r.sample(range(10_000), 3000)]  # a quarter of all rows has one first key
    got = numbered(spark.createDataFrame(rows, "a int, b int").repartition(7), ["a", "b"], "k")
    assert [(x["a"], x["b"]) for x in got.orderBy("k").collect()] == sorted(rows)
    assert sorted(x["k"] for x in got.collect()) == list(range(3000))


def reach(pairs, starts):
    seen, todo = set(starts), list(starts)
    while todo:
        n = todo.pop()
        for a, b in pairs:
            if a == n and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_closure_lattice(spark):
    from framelake.graphs.orders import closure_lattice

    r = random.Random(7)
    arcs = [(i, r.randrange(40), r.randrange(40), "x") for i in range(60)]
    pairs = [(a, b) for _, a, b, _ in arcs]
    for starts, ends in ([1, 2, 3], [30, 31]), ([0], [0]), ([], [1]), ([99], [99]):
        keep = reach(pairs, starts) & reach([(b, a) for a, b in pairs], ends)
        ids = lambda x: spark.createDataFrame([(n,) for n in x], "id long")
        nodes, kept = closure_lattice(spark.createDataFrame(arcs, ARCS), ids(starts), ids(ends))
        assert {x["id"] for x in nodes.collect()} == keep
        assert sorted(map(tuple, kept.collect())) == sorted(a for a in arcs if a[1] in keep and a[2] in keep)


def test_without_cycles(spark):
    from framelake.graphs.orders import topological_depth, without_cycles

    r = random.Random(3)
    arcs = [(i, r.randrange(15), r.randrange(15), "x") for i in range(40)] + [(90, 60, 50, "y"), (91, 50, 3, "y"), (92, 4, 4, "z")]
    df = spark.createDataFrame(arcs, ARCS)
    left = without_cycles(df)
    kept = {x["id"] for x in left.collect()}
    topological_depth(left)  # raises if a cycle is left
    assert {90, 91} <= kept and 92 not in kept  # nothing outside cycles goes, whatever its direction
    assert all(a > b or a == b for i, a, b, _ in arcs if i not in kept)
    dag = spark.createDataFrame(random_dag(20, 40, 5), ARCS)
    assert without_cycles(dag).count() == 40


def test_composition_joins_labels_far_apart(spark, tmp_path):
    """Labels repeat every 5000 orders, so the composition has the square of the repeats."""
    import datetime

    import __spark_entry__ as e

    ids = [k + 5000 * r for r in range(4) for k in (0, 1, 7)]
    rows = [(k, k % 13, "O", 1.0, datetime.datetime(2020, 1, 1), f"{k % 5}-X") for k in ids]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    place = lambda k: (k % 13 + 1, (k % 13 + 1) // (2 + k % 3), str(k % 5))
    pairs = [(place(a), place(b)) for a in ids for b in ids if a % 5000 == (b + 1) % 5000]
    want = sorted((a[0], b[0], a[1], b[1], a[2], b[2]) for a, b in pairs)
    got = e.queries()["j14_compose"](spark, str(tmp_path)).select("s1", "s2", "d1", "d2", "ilabel", "olabel").collect()
    assert sorted(map(tuple, got)) == want and len(want) == 16


def test_composition_is_dealt_by_its_rows(spark):
    """A few kilobytes of arcs make millions of rows; no task makes most of them."""
    from pyspark.sql import functions as F

    from framelake.graphs.tables import compose

    arcs = spark.range(14000).select("id", (F.col("id") % 40).alias("k"))
    a = arcs.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("x").alias("ilabel"), F.col("k").alias("olabel"))
    b = arcs.select((-F.col("id")).alias("src"), F.col("id").alias("dst"), F.col("k").alias("ilabel"), F.lit("y").alias("olabel"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for larger tables
    try:
        made = [r["count"] for r in compose(a, b).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert sum(made) == 40 * 350**2 and max(made) < 0.6 * sum(made)
    few = compose(a.where("src < 80"), b.where("dst < 120"), pairs=20)
    got = few.select("src.s1", "src.s2", "dst.d1", "dst.d2", "ilabel", "olabel").collect()
    assert sorted(map(tuple, got)) == sorted((i, -j, i + 1, j, "x", "y") for i in range(80) for j in range(120) if (i - j) % 40 == 0)
    # a label that has most rows is not dealt by number
    assert compose(a.withColumn("olabel", F.lit(1)).where("src < 30"), b.withColumn("ilabel", F.lit(1)).where("dst < 30"), pairs=20).count() == 900


def test_closure_keeps_no_shuffles(spark):
    """Equal to brute force on trees, chains longer than the steps and cycles; what the rounds shuffled is deleted."""
    import os
    import time

    from framelake.graphs.tables import closure

    def stored():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return sum(os.path.getsize(os.path.join(at, f)) for d in dirs for at, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data"))

    tree = [(n, n // k) for n in range(2, 1500) for k in (2, 3, 4)]
    odd = [(k, k + 1) for k in range(40)] + [(40, 37), (5, 5), (50, 51), (51, 50), (50, 51)]
    for arcs, steps in ((odd, {}), (odd, {"steps": 2}), (tree, {})):
        reach = {a: {b for x, b in arcs if x == a} for a, _ in arcs}
        while True:
            more = {a: to | {c for b in to for c in reach.get(b, ())} for a, to in reach.items()}
            if more == reach:
                break
            reach = more
        held = stored()
        got = [tuple(r) for r in closure(spark.createDataFrame(arcs, "src long, dst long"), **steps).collect()]
        assert sorted(got) == sorted((a, b) for a, to in reach.items() for b in to)
    for _ in range(20):
        if stored() - held < 20_000:
            break
        time.sleep(0.5)
    assert stored() - held < 20_000  # of the tree: rounds of 33,000 pairs
