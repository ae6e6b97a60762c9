"""Directed multigraphs as node and arc tables: ``nodes(id)``, ``arcs(src, dst, label)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage, drop_cut


def degrees(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """id, n_in, n_out."""
    ends = arcs.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    sums = ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def terminals(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """Start nodes (nothing arrives) and end nodes (nothing leaves), with flags."""
    return degrees(nodes, arcs).where("n_in = 0 or n_out = 0").select("id", (F.col("n_in") == 0).alias("is_start"), (F.col("n_out") == 0).alias("is_end"))


def reverse(arcs: DataFrame) -> DataFrame:
    return arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label")


def line_graph(arcs: DataFrame) -> DataFrame:
    """Arcs between arcs (by id) that follow each other."""
    a, b = arcs.select(F.col("id").alias("src"), F.col("dst").alias("_k")), arcs.select(F.col("id").alias("dst"), F.col("src").alias("_k"))
    return a.join(b, "_k").select("src", "dst")


def arc_ngrams(arcs: DataFrame, n: int) -> DataFrame:
    """Label sequences of all paths of n arcs, with first and last node."""
    out = arcs.select("src", "dst", F.array("label").alias("labels"))
    for _ in range(n - 1):
        step = arcs.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), "label")
        out = out.join(step, F.col("dst") == F.col("_s")).select("src", F.col("_d").alias("dst"), F.concat("labels", F.array("label")).alias("labels"))
    return out


def closure(arcs: DataFrame, most: int = 64, steps: int = 24) -> DataFrame:
    """(src, dst) reachable by one arc or more.

    For ``steps`` rounds arcs are put before the pairs that the round before found, so a
    pair is made once for each arc that leads to it and kept in the round that finds it;
    paths still longer then double in each of ``most`` rounds.  What a round shuffled is
    deleted after it.  All pairs are the result, so its size is that of the output.
    """
    base = cut_lineage(arcs.select("src", "dst").distinct(), once=True)
    before, found = base.select("src", F.col("dst").alias("_k")), [base]
    reach = base
    for _ in range(steps):
        longer = before.join(found[-1].select(F.col("src").alias("_k"), "dst"), "_k").select("src", "dst").distinct()
        new = cut_lineage(longer.join(reach, ["src", "dst"], "left_anti"), once=True)
        if not new.limit(1).count():
            drop_cut(new)
            return reach
        found.append(new)
        reach = reach.union(new)
    count = reach.count()
    for _ in range(most):
        a, b = reach.select("src", F.col("dst").alias("_k")), reach.select(F.col("src").alias("_k"), "dst")
        after = cut_lineage(reach.union(a.join(b, "_k").select("src", "dst")).distinct(), once=True)
        for old in found:
            drop_cut(old)
        reach, found, now = after, [after], after.count()
        if now == count:
            return reach
        count = now
    raise RuntimeError("closure did not settle")


def components(arcs: DataFrame, most: int = 100) -> DataFrame:
    """(id, component): the smallest node that each node with an arc is connected with, whatever the arcs' direction.

    Each round every node points to the smallest node that it or a neighbour
    points to, and then to what that one points to; rows are those of the arcs.
    """
    both = arcs.select("src", "dst").union(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    now = cut_lineage(both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("component")).withColumnRenamed("src", "id"))
    for _ in range(most):
        heard = both.join(now.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("_m"))
        # a node's old root hears of the smaller one as well
        least = now.join(heard, "id").select("id", "component", F.least("component", "_m").alias("_m"))
        told = least.select("id", "_m").union(least.select(F.col("component").alias("id"), "_m")).groupBy("id").agg(F.min("_m").alias("_m"))
        jump = told.select(F.col("id").alias("_m"), F.col("_m").alias("component"))
        after = cut_lineage(told.join(jump, "_m").select("id", "component"))
        moved = after.join(now, ["id", "component"], "left_anti").limit(1).count()
        drop_cut(now)
        now = after
        if not moved:
            return now
    raise RuntimeError("components did not settle")


def cyclic_core(arcs: DataFrame, most: int = 10_000) -> DataFrame:
    """Arcs between different nodes that are left once nodes without arcs in or out have gone, again and again; none without a cycle of two nodes or more."""
    now = cut_lineage(arcs.where("src <> dst").select("src", "dst").distinct())
    count = now.count()
    for _ in range(most):
        if not count:
            break
        after = cut_lineage(now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        drop_cut(now)
        now, left = after, after.count()
        if left == count:
            break
        count = left
    else:
        raise RuntimeError("nodes were still leaving")
    return now


def predicates(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """One row of facts: self_loop, multiarcs, cycle, starts, ends, join, connected, tree, lattice."""
    deg = degrees(nodes, arcs)
    loops = arcs.agg(F.coalesce(F.bool_or(F.col("src") == F.col("dst")), F.lit(False)).alias("self_loop"))
    multi = arcs.groupBy("src", "dst").count().agg(F.coalesce(F.max("count") > 1, F.lit(False)).alias("multiarcs"))
    wide = cyclic_core(arcs).agg((F.count(F.lit(1)) > 0).alias("wide_cycle"))
    ends = deg.agg(F.count_if(F.col("n_in") == 0).alias("starts"), F.count_if(F.col("n_out") == 0).alias("ends"), F.coalesce(F.bool_or(F.col("n_in") > 1), F.lit(False)).alias("join"), F.count(F.lit(1)).alias("nodes"))
    parts = components(arcs).agg(F.count_if(F.col("id") != F.col("component")).alias("followers"))
    one = loops.crossJoin(multi).crossJoin(wide).crossJoin(ends).crossJoin(parts)  # single rows
    cycle = F.col("self_loop") | F.col("wide_cycle")
    return one.select("self_loop", "multiarcs", cycle.alias("cycle"), "starts", "ends", F.col("join").alias("has_join"), (F.col("nodes") - F.col("followers") <= 1).alias("connected"), ((F.col("starts") == 1) & ~F.col("join") & ~cycle).alias("tree"), (~F.col("wide_cycle") & (F.col("starts") == 1) & (F.col("ends") == 1)).alias("lattice"))


def best_paths(arcs: DataFrame, start, end, n: int, most: int = 100) -> DataFrame:
    """The n cheapest paths of a DAG: rank, cost, path (node ids); ``arcs`` has src, dst, cost.

    Extends all paths an arc at a time, keeping the n cheapest at each node: they hold the n cheapest to any node beyond.
    """
    kind = dict(arcs.dtypes)["src"]
    paths = arcs.sparkSession.range(1).select(F.lit(start).cast(kind).alias("at"), F.lit(0.0).alias("cost"), F.array(F.lit(start).cast(kind)).alias("path"))
    done, order = None, Window.partitionBy("at").orderBy(F.round("cost", 9), "path")
    for _ in range(most):
        here = paths.where(F.col("at") == F.lit(end))
        done = here if done is None else done.union(here)
        step = arcs.select(F.col("src").alias("at"), F.col("dst").alias("_d"), F.col("cost").alias("_c"))
        paths = paths.join(step, "at").select(F.col("_d").alias("at"), (F.col("cost") + F.col("_c")).alias("cost"), F.concat("path", F.array("_d")).alias("path"))
        paths = cut_lineage(paths.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r"))
        if not paths.limit(1).count():
            break
    else:
        raise RuntimeError(f"there are paths of more than {most - 1} arcs")
    ranked = done.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n).select("rank", "cost", "path")


def disjoint_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Arcs of both, the second's node ids moved behind the first's."""
    top = a.agg((F.coalesce(F.greatest(F.max("src"), F.max("dst")), F.lit(-1)) + 1).alias("_o"))
    moved = b.crossJoin(F.broadcast(top)).select((F.col("src") + F.col("_o")).alias("src"), (F.col("dst") + F.col("_o")).alias("dst"), "label")
    return a.select("src", "dst", "label").union(moved)


def set_graph(arcs: DataFrame) -> DataFrame:
    return arcs.dropDuplicates(["src", "dst", "label"])


def compose(a: DataFrame, b: DataFrame, pairs: int = 1 << 22) -> DataFrame:
    """Arcs of the composition: output label of a = input label of b; nodes are pairs.

    ``a``, ``b``: src, dst, ilabel, olabel.  The rows of labels are counted first, as they
    can be the square of the arcs' few bytes; labels are dealt to tasks of about ``pairs``
    rows, or of more where that would be over 64 tasks a core (a task streams its rows).
    Where one label alone has 16 times ``pairs``, the join is left to split it.
    """
    x = a.select(F.col("src").alias("s1"), F.col("dst").alias("d1"), "ilabel", F.col("olabel").alias("_m"))
    y = b.select(F.col("src").alias("s2"), F.col("dst").alias("d2"), F.col("ilabel").alias("_m"), "olabel")
    count = lambda rows, name: rows.groupBy("_m").agg(F.count(F.lit(1)).alias(name))
    of_label = count(x, "_x").join(count(y, "_y"), "_m").select((F.col("_x") * F.col("_y")).alias("_n"))
    total, most = of_label.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    if total > pairs and most <= 16 * pairs:
        cores = a.sparkSession.sparkContext.defaultParallelism
        n = max(cores, min(-(-total // pairs), 64 * cores))
        x, y = x.repartition(n, "_m"), y.repartition(n, "_m")
    return x.join(y, "_m").select(F.struct("s1", "s2").alias("src"), F.struct("d1", "d2").alias("dst"), "ilabel", "olabel")


def compose_reachable(a: DataFrame, b: DataFrame, start: tuple, epsilon: str, most: int = 10_000) -> DataFrame:
    """Arcs of the composition that a pair of start nodes reaches: s1, s2, d1, d2, ilabel, olabel.

    ``a``, ``b``: src, dst, ilabel, olabel.  An arc of a that puts out epsilon, and one of b
    that takes it in, is taken without the other machine moving.  Each round
    extends the pairs found in the round before, so what no path reaches is never made.
    """
    kinds = dict(a.dtypes)["src"], dict(b.dtypes)["src"]
    left = a.select(F.col("src").alias("s1"), F.col("dst").alias("_d1"), F.col("ilabel").alias("_i"), F.col("olabel").alias("_m"))
    right = b.select(F.col("src").alias("s2"), F.col("dst").alias("_d2"), F.col("ilabel").alias("_m"), F.col("olabel").alias("_o"))
    seen = cut_lineage(a.sparkSession.range(1).select(F.lit(start[0]).cast(kinds[0]).alias("s1"), F.lit(start[1]).cast(kinds[1]).alias("s2")))
    new, out = seen, None
    for _ in range(most):
        moves = new.join(left, "s1")
        both = moves.where(F.col("_m") != epsilon).join(right.where(F.col("_m") != epsilon), ["s2", "_m"]).select("s1", "s2", F.col("_d1").alias("d1"), F.col("_d2").alias("d2"), F.col("_i").alias("ilabel"), F.col("_o").alias("olabel"))
        first = moves.where(F.col("_m") == epsilon).select("s1", "s2", F.col("_d1").alias("d1"), F.col("s2").alias("d2"), F.col("_i").alias("ilabel"), F.lit(epsilon).alias("olabel"))
        second = new.join(right.where(F.col("_m") == epsilon), "s2").select("s1", "s2", F.col("s1").alias("d1"), F.col("_d2").alias("d2"), F.lit(epsilon).alias("ilabel"), F.col("_o").alias("olabel"))
        found = cut_lineage(both.unionByName(first).unionByName(second))
        out = found if out is None else out.unionByName(found)
        new = cut_lineage(found.select(F.col("d1").alias("s1"), F.col("d2").alias("s2")).distinct().join(seen, ["s1", "s2"], "left_anti"))
        if not new.limit(1).count():
            return out
        seen = seen.unionByName(new)
    raise RuntimeError("pairs were still being reached")


def product_sizes(n1: int, arcs1: DataFrame, n2: int, arcs2: DataFrame) -> dict[str, int]:
    """Arc counts of five products of simple graphs of n1 and n2 nodes."""
    e1, e2 = arcs1.select("src", "dst").distinct().count(), arcs2.select("src", "dst").distinct().count()
    return {"tensor": e1 * e2, "cartesian": e1 * n2 + e2 * n1, "normal": e1 * n2 + e2 * n1 + e1 * e2, "lexicographic": e1 * n2 * n2 + e2 * n1, "conormal": e1 * n2 * n2 + e2 * n1 * n1 - e1 * e2}


def invariants(edges: DataFrame) -> DataFrame:
    """One row of an undirected graph: size (edges), order (nodes), max_degree, triangles, scan1.

    ``edges``: u, v; repeats and self-loops change nothing. Triangles follow edges
    from the smaller to the larger by (degree, id), so a hub's neighbours are not paired.
    """
    e = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().persist()
    ends = e.select(F.explode(F.array("u", "v")).alias("n"))
    deg = ends.groupBy("n").agg(F.count(F.lit(1)).alias("d"))
    rank = e.join(deg.select(F.col("n").alias("u"), F.col("d").alias("du")), "u").join(deg.select(F.col("n").alias("v"), F.col("d").alias("dv")), "v")
    up = F.struct("du", "u") < F.struct("dv", "v")
    o = rank.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("b"))
    wedge = o.alias("x").join(o.alias("y"), (F.col("x.a") == F.col("y.a")) & (F.col("x.b") != F.col("y.b"))).select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("y.b").alias("c"))
    tri = wedge.join(o.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"]).persist()
    per = tri.select(F.explode(F.array("a", "b", "c")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("t"))
    scan = deg.join(per, "n", "left").agg(F.count(F.lit(1)).alias("order"), F.max("d").alias("max_degree"), F.max(F.col("d") + F.coalesce("t", F.lit(0))).alias("scan1"))
    return e.agg(F.count(F.lit(1)).alias("size")).crossJoin(scan).crossJoin(tri.agg(F.count(F.lit(1)).alias("triangles"))).select("size", "order", "max_degree", "triangles", "scan1")


def random_arcs(spark, nodes: int, arcs: int, seed: int, acyclic: bool = False) -> DataFrame:
    """Random arcs, by a hash of their number: equal under recomputation."""
    r = spark.range(arcs).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(nodes)).alias("a"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(nodes)).alias("b"), F.col("id").cast("string").alias("label"))
    if acyclic:
        return r.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "label")
    return r.select(F.col("a").alias("src"), F.col("b").alias("dst"), "label")
