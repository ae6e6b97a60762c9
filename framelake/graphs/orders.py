"""Orders of directed graphs: depths, canonical numbering, lattices between nodes, acyclic parts.

Large graphs are worked on in rounds over arc tables, each written to the
shared folder; of a depth, once at most ``SMALL`` arcs are left, one task does the
rest, so that long thin ends cost no round each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage, drop_cut, numbered
from .tables import cyclic_core

#: Arcs that one task works on.
SMALL = 500_000
#: Tables of levels that are united before they are written as one.
LEVELS = 40


def _united(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _depths_in_task(arcs: DataFrame, level: int) -> DataFrame:
    """(id, depth) of the nodes that arcs lead to, where nodes that none leads to are at ``level``; none of those behind a cycle."""

    def work(batches):
        import numpy as np
        import pandas as pd

        held = [b.to_numpy() for b in batches]
        pairs = np.concatenate(held) if held else np.zeros((0, 2), np.int64)
        names, flat = np.unique(pairs, return_inverse=True)
        src, dst = flat.reshape(-1, 2).T if len(pairs) else (flat, flat)
        by = np.argsort(src, kind="stable")
        src, dst = src[by], dst[by]
        count = np.bincount(src, minlength=len(names))
        first, left = np.cumsum(count) - count, np.bincount(dst, minlength=len(names))
        depth, now, k = np.full(len(names), -1), np.flatnonzero(left == 0), level
        while len(now):
            depth[now] = k
            sizes = count[now]
            to = dst[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - first[now], sizes)]
            np.subtract.at(left, to, 1)
            to = np.unique(to)
            now, k = to[left[to] == 0], k + 1
        later = depth > level
        yield pd.DataFrame({"id": names[later], "depth": depth[later].astype("int32")})

    return arcs.select(F.col("src").cast("long"), F.col("dst").cast("long")).coalesce(1).mapInPandas(work, "id long, depth int")


def topological_depth(arcs: DataFrame, small: int | None = None) -> DataFrame:
    """(id, depth): the longest path to each node from the nodes that none leads to; a cycle raises.

    A round takes off the nodes that nothing left leads to, with their arcs.
    """
    small = SMALL if small is None else small
    nodes = cut_lineage(arcs.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    now = cut_lineage(arcs.select("src", "dst").distinct())
    front = cut_lineage(nodes.join(now.select(F.col("dst").alias("id")), "id", "left_anti"))
    parts, level, left = [front.withColumn("depth", F.lit(0))], 0, now.count()
    while left > small:
        step = now.join(front.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        after = cut_lineage(now.join(front.withColumnRenamed("id", "src"), "src", "left_anti"))
        front = cut_lineage(step.join(after.select(F.col("dst").alias("id")), "id", "left_anti"))
        count = after.count()
        if count == left:
            raise ValueError("the graph has a cycle")
        drop_cut(now)
        now, left, level = after, count, level + 1
        parts.append(front.withColumn("depth", F.lit(level)))
        if len(parts) > LEVELS:
            parts = [cut_lineage(_united(parts))]
    if left:
        parts.append(cut_lineage(_depths_in_task(now, level)))
    depth = _united(parts)
    if depth.count() < nodes.count():
        raise ValueError("the graph has a cycle")
    return depth


def canonical_dag(arcs: DataFrame, small: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, depth, node) and arcs (id, arc, src, dst, label) numbered in a topological order.

    Nodes go by depth and id, arcs (``id, src, dst, label``) by the number of the node that they lead
    to and their id; a cycle raises.
    """
    nodes = cut_lineage(numbered(topological_depth(arcs, small), ["depth", "id"], "node"))
    of = lambda end: nodes.select(F.col("id").alias(end), F.col("node").alias(f"_{end}"))
    placed = arcs.select("id", "src", "dst", "label").join(of("src"), "src").join(of("dst"), "dst")
    placed = placed.select("id", F.col("_src").alias("src"), F.col("_dst").alias("dst"), "label")
    return nodes, numbered(placed, ["dst", "id"], "arc").select("id", "arc", "src", "dst", "label")


def reached(arcs: DataFrame, starts: DataFrame) -> DataFrame:
    """(id): ``starts(id)`` and all nodes that paths from them lead to; a round sends only what the one before found."""
    new = cut_lineage(starts.select("id").distinct())
    seen = new
    while True:
        step = arcs.join(new.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        new = cut_lineage(step.join(seen, "id", "left_anti"))
        if not new.limit(1).count():
            return seen
        seen = cut_lineage(seen.unionByName(new))


def closure_lattice(arcs: DataFrame, starts: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and arcs on the paths from ``starts(id)`` to ``ends(id)``: reached from the ones, and reaching the others."""
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    nodes = cut_lineage(reached(arcs, starts).join(reached(back, ends), "id", "left_semi"))
    kept = arcs.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, kept.select(*arcs.columns)


def without_cycles(arcs: DataFrame) -> DataFrame:
    """``arcs`` without those that complete a cycle, in the order of the nodes' ids: arcs of the cyclic part that lead to the same or a smaller id.

    Every cycle lies in that part and has such an arc; arcs elsewhere all stay.
    """
    core = cyclic_core(arcs).where("src > dst").unionByName(arcs.where("src = dst").select("src", "dst").distinct())
    return arcs.join(core, ["src", "dst"], "left_anti").select(*arcs.columns)
