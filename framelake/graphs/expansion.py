"""Decoder graphs: a grammar of subgraphs expanded into one arc table.

``arcs(graph, src, dst, label)`` holds all subgraphs, each with its own nodes;
``ends(graph, start, end)`` their first and last node.  An arc whose label names
a subgraph stands for a copy of it.  A round replaces all such arcs at once: the
copies of a subgraph get ranges of fresh nodes, each range where the one before
ends, and are tied in by arcs without a label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.metrics import places
from ..plans.lineage import cut_lineage, drop_cut
from .tables import cyclic_core


def _check(arcs: DataFrame, ends: DataFrame) -> None:
    names = ends.select(F.col("graph").alias("label"))
    uses = cut_lineage(arcs.join(names, "label", "left_semi").select(F.col("graph").alias("src"), F.col("label").alias("dst")).distinct())
    if uses.where("src = dst").limit(1).count() or cyclic_core(uses).limit(1).count():
        raise ValueError("a subgraph holds itself")
    if ends.groupBy("graph").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError("a subgraph has two pairs of ends")


def expanded(arcs: DataFrame, ends: DataFrame, root: str) -> tuple[DataFrame, int, int]:
    """Arcs (src, dst, label) of ``root`` with all subgraphs in their places, its first node and its last.

    Nodes of the root come first, from 0; labels are null where copies are tied
    in. A subgraph that holds itself, through whatever others, raises.
    """
    _check(arcs, ends)
    nodes = arcs.select("graph", F.explode(F.array("src", "dst")).alias("id")).unionByName(ends.select("graph", F.explode(F.array("start", "end")).alias("id"))).distinct()
    local = cut_lineage(places(nodes, ["graph"], ["id"], "k"))
    of = lambda end, to: local.select("graph", F.col("id").alias(end), F.col("k").alias(to))
    parts = cut_lineage(arcs.join(of("src", "s"), ["graph", "src"]).join(of("dst", "d"), ["graph", "dst"]).select("graph", "s", "d", "label"))
    size = local.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    doors = cut_lineage(ends.join(of("start", "a"), ["graph", "start"]).join(of("end", "z"), ["graph", "end"]).join(size, "graph").select("graph", "a", "z", "n"))
    top = doors.where(F.col("graph") == root).first()
    if top is None:
        raise ValueError(f"no ends of {root}")
    whole = cut_lineage(parts.where(F.col("graph") == root).select(F.col("s").alias("src"), F.col("d").alias("dst"), "label"))
    have = top["n"]
    while True:
        calls = whole.join(doors.select(F.col("graph").alias("label")), "label", "left_semi")
        counts = calls.groupBy("label").agg(F.count(F.lit(1)).alias("calls")).join(doors.withColumnRenamed("graph", "label"), "label")
        before = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
        # a row for each subgraph that is called
        bases = cut_lineage(counts.withColumn("base", F.lit(have) + F.coalesce(F.sum(F.col("calls") * F.col("n")).over(before), F.lit(0))))
        added = bases.agg(F.sum(F.col("calls") * F.col("n"))).first()[0]
        if not added:
            return whole, top["a"], top["z"]
        placed = places(calls.select("label", "src", "dst"), ["label"], ["src", "dst"], "k").join(bases, "label")
        placed = cut_lineage(placed.select("label", "src", "dst", (F.col("base") + F.col("k") * F.col("n")).alias("base"), "a", "z"))
        inner = placed.select(F.col("label").alias("graph"), "base").join(parts, "graph").select((F.col("base") + F.col("s")).alias("src"), (F.col("base") + F.col("d")).alias("dst"), "label")
        tie = F.explode(F.array(F.struct(F.col("src"), (F.col("base") + F.col("a")).alias("dst")), F.struct((F.col("base") + F.col("z")).alias("src"), F.col("dst")))).alias("t")
        ties = placed.select(tie).select("t.src", "t.dst", F.lit(None).cast("string").alias("label"))
        kept = whole.join(doors.select(F.col("graph").alias("label")), "label", "left_anti").select("src", "dst", "label")
        after = cut_lineage(kept.unionByName(inner).unionByName(ties))
        for old in (whole, placed, bases):
            drop_cut(old)
        whole, have = after, have + added
