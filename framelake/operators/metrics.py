"""Evaluation and grouped statistics: confusion, accuracy, DET/ROC, n-grams, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import numbered

from ..plans.lineage import cut_lineage


def confusion(df: DataFrame, ref: str, hyp: str, part: list[str] = ()) -> DataFrame:
    """Counts of (ref, hyp)."""
    return df.groupBy(*part, F.col(ref).alias("ref"), F.col(hyp).alias("hyp")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, ref: str, hyp: str, labels: list) -> DataFrame:
    """confusion with one column a hypothesis (hyp_<label>)."""
    return df.groupBy(F.col(ref).alias("ref")).agg(*(F.count_if(F.col(hyp) == v).alias(f"hyp_{v}") for v in labels))


def accuracy(df: DataFrame, ref: str, hyp: str, part: list[str] = ()) -> DataFrame:
    """Share of rows with ref = hyp: trace over sum, with the counts."""
    return df.groupBy(*part).agg(F.count_if(F.col(ref) == F.col(hyp)).alias("right"), F.count(F.lit(1)).alias("n")).withColumn("accuracy", F.col("right") / F.col("n"))


def best_parameter(scores: DataFrame, part: list[str], parameter: str, value: str) -> DataFrame:
    """The parameter with the largest value in each part, the smallest of equals."""
    return scores.groupBy(*part).agg(F.max(F.struct(F.col(value), (-F.col(parameter)).alias("_p"))).alias("_m")).select(*part, (-F.col("_m._p")).alias(parameter), F.col(f"_m.{value}").alias(value))


def simple_stats(df: DataFrame, part: list[str], value: str) -> DataFrame:
    x = F.col(value).cast("double")
    return df.groupBy(*part).agg(F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.sum(x).alias("sum"), F.sum(x * x).alias("sumsq"))


def det_points(df: DataFrame, ref: Column, value: str, part: list[str] = ()) -> DataFrame:
    """(fp, miss, threshold) in percent at each distinct threshold, descending.

    At t: fp is the share of negatives above t, miss that of positives not above t.
    Of adjacent rows with equal fp the first stays, then of those with equal miss the last.
    Values are counted before any ordering and dealt by ranges; running sums are taken
    within a range, and those of the ranges before it (one row a range) are added.
    """
    by = df.groupBy(*part, F.col(value).alias("threshold")).agg(F.count_if(ref).alias("_p"), F.count_if(~ref).alias("_n"))
    dealt = cut_lineage(by.repartitionByRange(*part, F.desc("threshold")).withColumn("_range", F.spark_partition_id()))
    key, inside = [*part, "_range"], Window.partitionBy(*part, "_range").orderBy(F.desc("threshold"))
    ranges = Window.partitionBy(*part).orderBy("_range")
    before, whole = ranges.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*part)
    sums = dealt.groupBy(*key).agg(F.sum("_p").alias("_sp"), F.sum("_n").alias("_sn"), F.min_by("_n", "threshold").alias("_end"))
    sums = sums.select(*key, F.sum("_sp").over(whole).alias("_all_p"), F.sum("_sn").over(whole).alias("_all_n"), F.coalesce(F.sum("_sp").over(before), F.lit(0)).alias("_bp"), F.coalesce(F.sum("_sn").over(before), F.lit(0)).alias("_bn"), F.lag("_end").over(ranges).alias("_prev"))
    above = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.join(sums, key)
    rows = rows.withColumns({"_p": F.col("_bp") + F.coalesce(F.sum("_p").over(above), F.lit(0)), "_up": F.coalesce(F.lag("_n").over(inside), F.col("_prev")), "_n": F.col("_bn") + F.coalesce(F.sum("_n").over(above), F.lit(0))})
    rows = rows.where("_up is null or _up > 0")  # fp is not that of the row above
    heads = rows.groupBy(*key).agg(F.max_by("_p", "threshold").alias("_head"))
    heads = heads.select(*key, F.lead("_head").over(ranges).alias("_after"))
    rows = rows.join(heads, key).withColumn("_down", F.coalesce(F.lead("_p").over(inside), F.col("_after")))
    kept = rows.where("_down is null or _down <> _p")
    return kept.select(*part, "threshold", (100.0 * F.col("_n") / F.col("_all_n")).alias("fp"), (100.0 * (1 - F.col("_p") / F.col("_all_p"))).alias("miss"))


def roc_points(df: DataFrame, ref: Column, value: str, part: list[str] = ()) -> DataFrame:
    """(fp, hit, threshold): det_points with 100 - miss."""
    return det_points(df, ref, value, part).select(*part, "threshold", "fp", (100.0 - F.col("miss")).alias("hit"))


def miss_false_alarm(df: DataFrame, part: list[str], order: str, ref: str, hyp: str, collar: int) -> DataFrame:
    """Pmiss and Pfa over frames, without ``collar`` frames on either side of each change of ref.

    An approximation of collared scoring: frames stand for time.
    """
    w = Window.partitionBy(*part).orderBy(order)
    change = (F.col(ref) != F.lag(ref).over(w)).cast("int")
    near = F.coalesce(F.max("_change").over(w.rowsBetween(-(collar - 1), collar)), F.lit(0)) if collar else F.lit(0)
    rows = df.withColumn("_change", change).withColumn("_near", near).where("_near = 0")
    speech, wrong = F.col(ref) == 1, F.col(ref) != F.col(hyp)
    return rows.agg(F.count_if(speech).alias("speech"), F.count_if(~speech).alias("other"), F.count_if(speech & wrong).alias("missed"), F.count_if(~speech & wrong).alias("false_alarms")).withColumns({"pmiss": F.col("missed") / F.col("speech"), "pfa": F.col("false_alarms") / F.col("other")})


def running_accuracy(df: DataFrame, part: list[str], order: str, label: str, top: str) -> DataFrame:
    """Cumulative accuracy after each labelled row; rows without a label are passed over."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    known = F.col(label).isNotNull()
    return df.withColumns({"seen": F.count_if(known).over(w), "right": F.count_if(known & (F.col(label) == F.col(top))).over(w)}).withColumn("accuracy", F.when(F.col("seen") > 0, F.col("right") / F.col("seen")))


def ngram_counts(tokens: DataFrame, doc: str, pos: str, token: str, n: int, begin: str = "<s>", end: str = "</s>") -> DataFrame:
    """(ngram, n): n-grams over each document's tokens between begin and end marks."""
    lists = tokens.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, token))), lambda s: s[token]).alias("_t"))
    return ngrams_of(lists, F.col("_t"), n, begin, end).groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))


def ngrams_of(df: DataFrame, tokens: Column, n: int, begin: str = "<s>", end: str = "</s>") -> DataFrame:
    """``df`` with one row an n-gram (joined by spaces) of an array of tokens, which holds all marks."""
    padded = F.concat(F.array_repeat(F.lit(begin), max(1, n - 1)), tokens, F.array(F.lit(end)))
    return df.withColumn("_p", padded).select("*", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_p") - (n - 1))), lambda i: F.array_join(F.slice("_p", i, n), " "))).alias("start", "ngram")).drop("_p")


def ngram_index(df: DataFrame, doc: str, tokens: Column, n: int) -> DataFrame:
    """Inverted index: ngram, number of documents, places as [(doc, start)] in order."""
    rows = df.select(F.col(doc).alias("doc"), F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - (n - 1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).alias("start", "ngram"))
    return rows.groupBy("ngram").agg(F.count_distinct("doc").alias("docs"), F.array_sort(F.collect_list(F.struct("doc", "start"))).alias("places"))


def ngram_places(df: DataFrame, doc: str, tokens: Column, n: int) -> DataFrame:
    """The inverted index with a row for each place: ngram, k (from 0, in the order of doc and start), doc, start.

    However frequent an n-gram is, no row and no task holds all its places.
    """
    rows = df.select(F.col(doc).alias("doc"), F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - (n - 1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).alias("start", "ngram"))
    return places(rows, ["ngram"], ["doc", "start"], "k")


def bit_majority(bits: DataFrame, context: list[str], bit: str) -> DataFrame:
    """The majority bit of each context, 1 when 2 * ones >= total."""
    return bits.groupBy(*context).agg(F.sum(bit).alias("ones"), F.count(F.lit(1)).alias("n")).withColumn("bit", (2 * F.col("ones") >= F.col("n")).cast("int"))


def check_classes(df: DataFrame, label: str, expected: list) -> DataFrame:
    """Rows a class; raises if an expected class has none."""
    spark = df.sparkSession
    want = spark.createDataFrame([(v,) for v in expected], f"{label} {dict(df.dtypes)[label]}")
    counts = want.join(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label, "left")
    return counts.withColumn("n", F.coalesce("n", F.raise_error(F.concat(F.lit("no rows of class "), F.col(label).cast("string"))).cast("long")))


def collate(df: DataFrame, key: str, value: str) -> DataFrame:
    """Values by key: the list in order, the set, its size."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("all"), F.sort_array(F.collect_set(value)).alias("distinct"), F.count_distinct(value).alias("n"))


def places(df: DataFrame, key: list[str], by: list[str], name: str) -> DataFrame:
    """``df`` with the place, from 0, of each row among those of its key; a key's rows are dealt over many tasks."""
    rows = numbered(df, [*key, *by], "_place")
    first = rows.groupBy(*key).agg(F.min("_place").alias("_first"))
    return rows.join(first, key).select(*df.columns, (F.col("_place") - F.col("_first")).alias(name))


def collated(df: DataFrame, key: str, value: str) -> DataFrame:
    """Values by key in order, as rows: key, k (from 0), value, first (whether it is the first of equal ones)."""
    rows = numbered(df.select(key, value), [key, value], "_place")
    first, new = rows.groupBy(key).agg(F.min("_place").alias("_first")), rows.groupBy(key, value).agg(F.min("_place").alias("_new"))
    both = rows.join(first, key).join(new, [key, value])
    return both.select(key, (F.col("_place") - F.col("_first")).alias("k"), value, (F.col("_place") == F.col("_new")).alias("first"))


def label_ids(df: DataFrame, label: str) -> DataFrame:
    """A number from 0 for each distinct label, in their order (one row a label)."""
    return numbered(df.select(label).distinct(), [label], "id").withColumn("id", F.col("id").cast("int"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Density over ``bins`` cells of low..high; the last cell holds its upper edge."""
    width = (high - low) / bins
    cell = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).between(low, high)).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select("cell", "n", (F.col("n") / (F.col("_all") * width)).alias("density"))


def moments(df: DataFrame, part: list[str], x: Column) -> DataFrame:
    """Per dimension of the array ``x``: n, mean and population variance, as (part, dim, n, mean, var).

    Sums are partial before the shuffle; only dims rows a part and task are dealt.
    """
    rows = df.select(*part, F.posexplode(x).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    return rows.groupBy(*part, "dim").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))


def variance_floor(df: DataFrame, x: Column, factor: float = 0.01, least: float = 0.001) -> DataFrame:
    """max(factor * global variance, least) of each dimension."""
    return moments(df, [], x).select("dim", F.greatest(factor * F.col("var"), F.lit(least)).alias("floor"))


def log_spaced_sums(df: DataFrame, part: list[str], order: str, value: str) -> DataFrame:
    """Binary-counter sums: after n values one (sum, sum of squares) for each bit set in n, the oldest the largest."""
    rows = df.withColumn("_i", F.row_number().over(Window.partitionBy(*part).orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*part)))
    # value i is in the block of the highest bit where i and n differ
    bit = F.floor(F.log2(F.expr("_i ^ _n").cast("double")) + 1e-12).cast("int")
    return rows.withColumn("bit", bit).groupBy(*part, "bit").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("sum"), F.sum(F.col(value) * F.col(value)).alias("sumsq"))
