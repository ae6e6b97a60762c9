"""Stream operators in batch form: decimation, windows, joins by position, adjacent duplicates.

Every operator takes the columns that part the data (one stream each) and those that
order it; nothing is ordered globally.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, part: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """Position from 0 within each part."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1)


def decimate(df: DataFrame, part: list[str], order: list[str], n: int) -> DataFrame:
    """The first row of each part, then each n-th after it."""
    if n < 1:
        raise ValueError("n must be 1 or more")
    return numbered(df, part, order, "_pos").where(F.col("_pos") % n == 0).drop("_pos")


def flat_map(df: DataFrame, items: Column, out: str) -> DataFrame:
    """One row an item of an array, with its place."""
    return df.select("*", F.posexplode(items).alias(f"{out}_pos", out))


def drop_parts_with_nan(df: DataFrame, part: list[str], values: Column) -> DataFrame:
    """Parts none of whose rows hold a NaN in the array ``values``."""
    bad = df.where(F.exists(values, lambda v: F.isnan(v))).select(*part).distinct()
    return df.join(bad, part, "left_anti")


def map_labels(df: DataFrame, label: str, mapping: DataFrame, source: str, target: str, strict: bool = True) -> DataFrame:
    """``label`` replaced by the table's target; unknown labels raise, or leave if not strict."""
    joined = df.join(mapping.select(F.col(source).alias("_s"), F.col(target).alias("_t")), F.col(label) == F.col("_s"), "left" if strict else "inner")
    value = F.coalesce(F.col("_t"), F.raise_error(F.concat(F.lit("no mapping for label "), F.coalesce(F.col(label).cast("string"), F.lit("null")))).cast(dict(mapping.dtypes)[target])) if strict else F.col("_t")
    return joined.withColumn(label, value).drop("_s", "_t")


def sliding_windows(df: DataFrame, part: list[str], order: list[str], length: int, hop: int) -> DataFrame:
    """Rows with their window number; only full windows of ``length`` rows, one each ``hop``.

    A row is copied to the windows that hold it, at most ceil(length / hop).
    """
    if length < 1 or hop < 1:
        raise ValueError("length and hop must be 1 or more")
    rows = numbered(df, part, order, "_pos").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*part)))
    first = F.greatest(F.lit(0), F.ceil((F.col("_pos") - length + 1) / hop)).cast("int")
    last = F.least(F.floor(F.col("_pos") / hop), F.floor((F.col("_n") - length) / hop)).cast("int")
    held = rows.withColumns({"_a": first, "_b": last}).where("_n >= {} and _b >= _a".format(length))
    return held.withColumn("window", F.explode(F.sequence("_a", "_b"))).withColumn("offset", (F.col("_pos") - F.col("window") * hop).cast("int")).drop("_pos", "_n", "_a", "_b")


def merge_streams(*streams: DataFrame) -> DataFrame:
    """Bag union by name: the undifferentiated join of streams."""
    return reduce(DataFrame.unionByName, streams)


def round_robin(df: DataFrame, part: list[str], source: str, order: list[str]) -> DataFrame:
    """Items in strict turns of the sources, in the sources' order; ends at the first turn that a source misses."""
    rows = numbered(df, [*part, source], order, "turn")
    sizes = rows.groupBy(*part, source).agg(F.count(F.lit(1)).alias("_n"))
    place = sizes.withColumn("_place", F.row_number().over(Window.partitionBy(*part).orderBy(source)) - 1)
    # the first missing turn is that of the shortest source, the earliest of them
    stop = place.groupBy(*part).agg(F.min(F.struct("_n", "_place")).alias("_stop"), F.count(F.lit(1)).alias("_k"))
    rows = rows.join(place.drop("_n"), [*part, source]).join(stop, part) if part else rows.join(place.drop("_n"), [source]).crossJoin(F.broadcast(stop))
    at = F.struct(F.col("turn").cast("long"), F.col("_place"))
    kept = rows.where(at < F.struct(F.col("_stop._n").cast("long"), F.col("_stop._place")))
    return kept.withColumn("seq", F.col("turn") * F.col("_k") + F.col("_place")).drop("_place", "_stop", "_k")


def slot_join(df: DataFrame, part: list[str], tag: str, order: list[str], value: str, tags: list) -> DataFrame:
    """The n-th item of every tag as one row (columns slot_<tag> in sorted order); incomplete rows are left out."""
    rows = numbered(df.where(F.col(tag).isin(*tags)), [*part, tag], order, "slot")
    wide = rows.groupBy(*part, "slot").agg(*(F.max(F.when(F.col(tag) == t, F.struct(value))).alias(f"_{t}") for t in sorted(tags)))
    whole = reduce(lambda a, b: a & b, (F.col(f"_{t}").isNotNull() for t in tags))
    return wide.where(whole).select(*part, "slot", *(F.col(f"_{t}").getField(value).alias(f"slot_{t}") for t in sorted(tags)))


def zip_positions(a: DataFrame, b: DataFrame, part: list[str], order_a: list[str], order_b: list[str], how: str = "inner") -> DataFrame:
    """Rows of both by position: inner cuts to the shorter, full pads the shorter with nulls."""
    return numbered(a, part, order_a).join(numbered(b, part, order_b), [*part, "pos"], how)


def zip_strict(a: DataFrame, b: DataFrame, part: list[str], order_a: list[str], order_b: list[str]) -> DataFrame:
    """zip_positions for streams of equal length; raises where a position has one side only."""
    left, right = numbered(a, part, order_a).withColumn("_l", F.lit(True)), numbered(b, part, order_b).withColumn("_r", F.lit(True))
    both = left.join(right, [*part, "pos"], "full")
    whole = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.where(F.when(whole, True).otherwise(F.raise_error(F.lit("streams differ in length")).cast("boolean"))).drop("_l", "_r")


def accumulate_slots(df: DataFrame, part: list[str], tag: str, order: str, value: str, tags: list) -> DataFrame:
    """Bundles that close when every tag has an item: part, bundle, tag, items since the last close.

    Arrival order decides, so each part is folded in order in one task.
    """
    fields = ", ".join(f"{p} {dict(df.dtypes)[p]}" for p in part)

    def fold(pdf):
        import pandas as pd

        out, held, bundle = [], {t: [] for t in tags}, 0
        for t, v in zip(pdf[tag], pdf["_v"]):
            if t in held:
                held[t].append(v)
                if all(held.values()):
                    out += [(*(pdf[p].iloc[0] for p in part), bundle, k, held[k]) for k in sorted(held)]
                    held, bundle = {k: [] for k in tags}, bundle + 1
        return pd.DataFrame(out, columns=[*part, "bundle", tag, "items"])

    kind = dict(df.dtypes)
    schema = f"{fields}, bundle int, {tag} {kind[tag]}, items array<{kind[value]}>"
    return df.select(*part, tag, F.col(order).alias("_o"), F.col(value).alias("_v")).groupBy(*part).applyInPandas(lambda p: fold(p.sort_values("_o")), schema)


def first_match(left: DataFrame, right: DataFrame, key: str, order: str, value: str, default=" ") -> DataFrame:
    """Every left row with the first right value of its key and the number of matches."""
    best = right.groupBy(key).agg(F.min_by(value, order).alias(value), F.count(F.lit(1)).alias("matches"))
    return left.join(best, key, "left").withColumns({value: F.coalesce(value, F.lit(default)), "matches": F.coalesce("matches", F.lit(0))})


def keep_existing(left: DataFrame, right: DataFrame, key: Column | str) -> DataFrame:
    """Left rows whose key exists on the right."""
    return left.join(right, key, "left_semi")


def uniq(df: DataFrame, part: list[str], order: list[str], keys: list[str], keep: str = "first") -> DataFrame:
    """Of adjacent rows equal in ``keys``, the first or the last."""
    w = Window.partitionBy(*part).orderBy(*order)
    other = F.lag if keep == "first" else F.lead
    edge = F.row_number().over(w) == 1 if keep == "first" else F.lead(F.lit(1)).over(w).isNull()
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(other(k).over(w)) for k in keys))
    return df.withColumn("_keep", edge | ~same).where("_keep").drop("_keep")


def flip_first(df: DataFrame, part: list[str], order: list[str], label: str, rate: float) -> DataFrame:
    """0/1 labels of the first int(rate * n + 0.5) rows of each part flipped."""
    rows = numbered(df, part, order, "_pos").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*part)))
    return rows.withColumn(label, F.when(F.col("_pos") < F.floor(rate * F.col("_n") + 0.5), 1 - F.col(label)).otherwise(F.col(label))).drop("_pos", "_n")


def flip_random(df: DataFrame, label: str, permil: int, key: Column, seed: int = 0) -> DataFrame:
    """0/1 labels flipped for permil of rows, by a hash of their key: repeatable under recomputation."""
    return df.withColumn(label, F.when(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1000)) < permil, 1 - F.col(label)).otherwise(F.col(label)))


def _widen(rows: Column, held: list[str], name: str):
    return lambda v: F.transform(rows, lambda s: F.struct(*(s[h].alias(h) for h in held), v.alias(name)))


def feature_space(**values: list) -> Column:
    """All combinations of a few listed values, as an array of structs (dimension-sized)."""
    out = F.array(F.struct(F.lit(0).alias("_")))
    for k, (name, vs) in enumerate(values.items()):
        held = list(values)[:k]
        out = F.flatten(F.transform(F.array(*map(F.lit, vs)), _widen(out, held, name)))
    return out


def text_bits(df: DataFrame, text: Column) -> DataFrame:
    """Characters of whitespace tokens as MSB-first bits: token_pos, char_pos, char, bit_pos, bit."""
    tokens = df.select("*", F.posexplode(F.filter(F.split(text, r"\s+"), lambda t: t != "")).alias("token_pos", "token"))
    chars = tokens.select("*", F.posexplode(F.split("token", "")).alias("char_pos", "char"))
    return chars.select("*", F.posexplode(F.sequence(F.lit(7), F.lit(0), F.lit(-1))).alias("bit_pos", "_s")).withColumn("bit", F.expr("shiftright(ascii(char), _s) & 1")).drop("_s", "token")
