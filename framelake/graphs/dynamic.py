"""Undirected graphs whose edges come and go, with invariants that are kept and not worked out anew.

The state is two tables: edges with how often each was added, and nodes with
their degree and the triangles that they are in.  A batch of changes touches the
triangles of the edges that appear or vanish only: the neighbours of the end of
smaller degree are met with those of the other, so a hub's neighbours are never
paired.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage, drop_cut

#: Edges that one task peels.
SMALL = 500_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _triangles(edges: DataFrame, some: DataFrame, degrees: DataFrame) -> DataFrame:
    """Distinct (a, b, c), a < b < c, of the triangles of ``edges`` that have an edge in ``some``."""
    of = lambda end: degrees.select(F.col("n").alias(end), F.col("d").alias(f"d{end}"))
    ranked = some.select("u", "v").join(of("u"), "u").join(of("v"), "v")
    less = F.struct("du", "u") < F.struct("dv", "v")
    ends = ranked.select(F.when(less, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(less, F.col("v")).otherwise(F.col("u")).alias("o"))
    near = ends.join(_both_ways(edges).withColumnRenamed("v", "w"), "u").where("w <> o")
    third = near.select("u", "o", "w", F.least("o", "w").alias("x"), F.greatest("o", "w").alias("y"))
    found = third.join(edges.select(F.col("u").alias("x"), F.col("v").alias("y")), ["x", "y"], "left_semi")
    order = F.sort_array(F.array("u", "o", "w"))
    return found.select(order[0].alias("a"), order[1].alias("b"), order[2].alias("c")).distinct()


class DynamicGraph:
    """A graph under batches of ``changes(u, v, delta)``, delta 1 for an edge that comes and -1 for one that goes."""

    def __init__(self, spark: SparkSession, node: str = "long"):
        self.edges = cut_lineage(spark.createDataFrame([], f"u {node}, v {node}, k long"))
        self.nodes = cut_lineage(spark.createDataFrame([], f"n {node}, d long, t long"))

    def copy(self) -> "DynamicGraph":
        other = object.__new__(DynamicGraph)
        other.edges, other.nodes = cut_lineage(self.edges), cut_lineage(self.nodes)
        return other

    def apply(self, changes: DataFrame) -> None:
        """Add and remove edges; a loop raises, and so does the removal of more copies than there are."""
        net = cut_lineage(changes.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "delta").groupBy("u", "v").agg(F.sum("delta").alias("delta")))
        if net.where("u = v or u is null or v is null").limit(1).count():
            raise ValueError("an edge needs two different nodes")
        after = self.edges.join(net, ["u", "v"], "full").select("u", "v", F.coalesce("k", F.lit(0)).alias("was"), (F.coalesce("k", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("k"))
        after = cut_lineage(after)
        if after.where("k < 0").limit(1).count():
            raise ValueError("an edge was removed that is not there")
        edges = cut_lineage(after.where("k > 0").select("u", "v", "k"))
        gone, come = after.where("was > 0 and k = 0"), after.where("was = 0 and k > 0")
        ends = lambda df, by: df.select(F.explode(F.array("u", "v")).alias("n")).select("n", F.lit(by).alias("d"), F.lit(0).alias("t"))
        moved = ends(gone, -1).unionByName(ends(come, 1)).groupBy("n").agg(F.sum("d").alias("d"))
        degrees = cut_lineage(self.nodes.select("n", "d").unionByName(moved.select("n", F.col("d").cast("long"))).groupBy("n").agg(F.sum("d").alias("d")))
        corners = lambda df, by: df.select(F.explode(F.array("a", "b", "c")).alias("n")).select("n", F.lit(by).alias("t"))
        lost, found = _triangles(self.edges, gone, self.nodes), _triangles(edges, come, degrees)
        turned = corners(lost, -1).unionByName(corners(found, 1)).groupBy("n").agg(F.sum("t").alias("more"))
        nodes = degrees.where("d > 0").join(self.nodes.select("n", "t"), "n", "left").join(turned, "n", "left")
        nodes = cut_lineage(nodes.select("n", "d", (F.coalesce("t", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("t")))
        for old in (net, after, degrees, self.edges, self.nodes):
            drop_cut(old)
        self.edges, self.nodes = edges, nodes

    def invariants(self) -> DataFrame:
        """One row: size, order, max_degree, num_triangles, scan1 (edges within a node and its neighbours, at most)."""
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        held = self.nodes.agg(F.count(F.lit(1)).alias("order"), zero(F.sum("d") / 2).alias("size"), zero(F.max("d")).alias("max_degree"), zero(F.sum("t") / 3).alias("num_triangles"), zero(F.max(F.col("d") + F.col("t"))).alias("scan1"))
        return held.select("size", "order", "max_degree", "num_triangles", "scan1")

    def mad_lower_k(self, small: int = SMALL) -> int:
        return mad_lower_k(self.edges, small)


def _peeled(edges: DataFrame) -> DataFrame:
    """The largest edges over nodes while the node of smallest degree is taken off, again and again, in one task."""

    def work(batches):
        import numpy as np
        import pandas as pd

        held = [b.to_numpy() for b in batches]
        if held:
            names, flat = np.unique(np.concatenate(held), return_inverse=True)
            u, v = flat.reshape(-1, 2).T
            src, dst = np.concatenate([u, v]), np.concatenate([v, u])
            by = np.argsort(src, kind="stable")
            dst, degree = dst[by], np.bincount(src, minlength=len(names))
            first = np.cumsum(degree) - degree
            ends, live, bucket = (first + degree).tolist(), np.ones(len(names), bool).tolist(), [[] for _ in range(int(degree.max()) + 1)]
            left, first, dst = degree.tolist(), first.tolist(), dst.tolist()
            for n, d in enumerate(left):
                bucket[d].append(n)
            m, count, low, best = len(u), len(names), 0, 0.0
            while count:
                best = max(best, m / count)
                while True:  # entries of a bucket whose node has gone on to another are passed over
                    while not bucket[low]:
                        low += 1
                    n = bucket[low].pop()
                    if live[n] and left[n] == low:
                        break
                live[n] = False
                m, count = m - low, count - 1
                for o in dst[first[n] : ends[n]]:
                    if live[o]:
                        left[o] -= 1
                        bucket[left[o]].append(o)
                low = max(low - 1, 0)
            yield pd.DataFrame({"density": [best]})

    return edges.select("u", "v").coalesce(1).mapInPandas(work, "density double")


def mad_lower_k(edges: DataFrame, small: int = SMALL) -> int:
    """1000 times a lower bound of the largest average degree of any part, rounded; ``edges(u, v)`` without repeats.

    Nodes of a degree below edges over nodes are in no densest part: they go, all
    at once, again and again.  Where more than ``small`` edges stay, nodes below
    the average degree go as well; the rest is peeled node by node in one task.
    """
    now, best = cut_lineage(edges.select("u", "v")), 0.0
    while True:
        degrees = now.select(F.explode(F.array("u", "v")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
        nodes, ends = degrees.agg(F.count(F.lit(1)), F.sum("d")).first()
        if not nodes:
            break
        density = ends / 2 / nodes
        best = max(best, density)
        if ends // 2 <= small:
            best = max(best, *(r["density"] for r in _peeled(now).collect()))
            break
        keep = degrees.where(F.col("d") >= density)
        if keep.count() == nodes:
            keep = degrees.where(F.col("d") > 2 * density)  # a regular part ends here, as no part of it is denser
        ids = keep.select("n")
        after = cut_lineage(now.join(ids.withColumnRenamed("n", "u"), "u", "left_semi").join(ids.withColumnRenamed("n", "v"), "v", "left_semi"))
        drop_cut(now)
        now = after
    drop_cut(now)
    return int(1000 * 2 * best + 0.5)
