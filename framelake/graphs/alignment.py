"""Alignment of two lattices: the cheapest pair of paths, one of each, and how they are aligned.

The product of two lattices is never made: rounds start at the pair of first
nodes and send only the pairs whose cost became less.  Many pairs of lattices,
told apart by ``part``, are aligned in the same rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage, drop_cut

#: Steps that are united before they are written as one table.
STEPS = 30


def _moves(front: DataFrame, a: DataFrame, b: DataFrame, part: list[str], sub: float, gap: float) -> DataFrame:
    """(part, i, j, cost, pi, pj, la, lb): the pairs next to those of ``front(part, i, j, cost)``."""
    x = a.select(*part, F.col("src").alias("i"), F.col("dst").alias("i2"), F.col("label").alias("la"))
    y = b.select(*part, F.col("src").alias("j"), F.col("dst").alias("j2"), F.col("label").alias("lb"))
    here = lambda i, j, cost, la, lb: [*part, F.col(i).alias("i2"), F.col(j).alias("j2"), cost.alias("cost2"), F.col("i").alias("pi"), F.col("j").alias("pj"), la.alias("la"), lb.alias("lb")]
    none = F.lit(None).cast("string")
    free = lambda c: F.when(F.col(c).isNull(), 0.0).otherwise(gap)
    down = front.join(x, [*part, "i"])
    both = down.where("la is not null").join(y.where("lb is not null"), [*part, "j"])
    moves = [
        both.select(*here("i2", "j2", F.col("cost") + F.when(F.col("la") == F.col("lb"), 0.0).otherwise(sub), F.col("la"), F.col("lb"))),
        down.select(*here("i2", "j", F.col("cost") + free("la"), F.col("la"), none)),
        front.join(y, [*part, "j"]).select(*here("i", "j2", F.col("cost") + free("lb"), none, F.col("lb"))),
    ]
    return reduce(DataFrame.unionByName, moves).select(*part, F.col("i2").alias("i"), F.col("j2").alias("j"), F.col("cost2").alias("cost"), "pi", "pj", "la", "lb")


def align_lattices(a: DataFrame, b: DataFrame, ends: DataFrame, part: list[str], sub: float = 1.0, gap: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(part, cost) of each pair of lattices, and the steps (part, step, a, b) of one cheapest alignment.

    a, b: part, src, dst, label, acyclic, label null for arcs that cost nothing;
    ends: part, a_start, a_end, b_start, b_end. Labels that differ cost ``sub``, a
    label against none ``gap``. Of equally cheap ways the one with smaller
    nodes before is taken. Pairs without a path have no row.
    """
    why = ["pi", "pj", "la", "lb"]
    first = ends.select(*part, F.col("a_start").alias("i"), F.col("b_start").alias("j"), F.lit(0.0).alias("cost"))
    best = cut_lineage(first.select("*", *(F.lit(None).cast(k).alias(c) for c, k in zip(why, ["long", "long", "string", "string"]))))
    front = cut_lineage(first)
    while front.limit(1).count():
        came = _moves(front, a, b, part, sub, gap).groupBy(*part, "i", "j").agg(F.min(F.struct("cost", *why)).alias("m")).select(*part, "i", "j", "m.*")
        was = best.select(*part, "i", "j", F.col("cost").alias("_was"))
        better = cut_lineage(came.join(was, [*part, "i", "j"], "left").where("_was is null or cost < _was").drop("_was"))
        after = cut_lineage(best.join(better.select(*part, "i", "j"), [*part, "i", "j"], "left_anti").unionByName(better))
        drop_cut(best)
        drop_cut(front)
        best, front = after, better.select(*part, "i", "j", "cost")
        front = cut_lineage(front)
        drop_cut(better)
    done = ends.select(*part, F.col("a_end").alias("i"), F.col("b_end").alias("j"))
    at = cut_lineage(best.join(done, [*part, "i", "j"]))
    costs = cut_lineage(at.select(*part, "cost"))
    parts, k = [], 0
    while True:  # back from the ends, one step a round, of all pairs together
        moved = at.where("pi is not null")
        if not moved.limit(1).count():
            break
        parts.append(moved.where("la is not null or lb is not null").select(*part, F.lit(k).alias("_k"), F.col("la").alias("a"), F.col("lb").alias("b")))
        if len(parts) > STEPS:
            parts = [cut_lineage(reduce(DataFrame.unionByName, parts))]
        at, k = cut_lineage(best.join(moved.select(*part, F.col("pi").alias("i"), F.col("pj").alias("j")), [*part, "i", "j"])), k + 1
    if not parts:
        parts = [at.where("false").select(*part, F.lit(0).alias("_k"), F.col("la").alias("a"), F.col("lb").alias("b"))]
    steps = reduce(DataFrame.unionByName, parts)
    return costs, steps.withColumn("step", F.row_number().over(Window.partitionBy(*part).orderBy(F.col("_k").desc())) - 1).select(*part, "step", "a", "b")
