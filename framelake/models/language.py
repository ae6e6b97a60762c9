"""n-gram language models: counts, add-lambda and back-off probabilities, ARPA scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import ngrams_of


def train(docs: DataFrame, tokens: Column, order: int) -> dict[int, DataFrame]:
    """Counts by n of 1..order: (context, token, n, context_n), marks included."""
    out = {}
    for n in range(1, order + 1):
        rows = ngrams_of(docs, tokens, n).select(F.split("ngram", " ").alias("g"))
        pairs = rows.select(F.array_join(F.slice("g", 1, n - 1), " ").alias("context") if n > 1 else F.lit("").alias("context"), F.element_at("g", n).alias("token"))
        if n == 1:
            pairs = pairs.where("token <> '<s>'")
        counts = pairs.groupBy("context", "token").agg(F.count(F.lit(1)).alias("n"))
        out[n] = counts.join(counts.groupBy("context").agg(F.sum("n").alias("context_n")), "context")
    return out


def add_lambda(n: Column, context_n: Column, vocab: Column, lam: float) -> Column:
    """(c + l) / (ctx + l V)."""
    return (n + lam) / (context_n + lam * vocab)


def probabilities(counts: dict[int, DataFrame], vocab: int, lam: float, back_off: bool) -> DataFrame:
    """p(token | context) of the highest order's n-grams.

    Add-lambda, or with back-off recursively (c + l V p_lower) / (ctx + l V), from 1 / V.
    """
    order = max(counts)
    rows = counts[order].withColumn("p", F.lit(1.0 / vocab))
    if not back_off:
        return rows.withColumn("p", add_lambda(F.col("n"), F.col("context_n"), F.lit(float(vocab)), lam))
    words = F.split("context", " ")
    for n in range(1, order + 1):
        low = counts[n].select(F.col("context").alias("_c"), F.col("token").alias("_t"), F.col("n").alias("_n"), F.col("context_n").alias("_cn"))
        tail = F.array_join(F.slice(words, order - n + 1, n - 1), " ") if n > 1 else F.lit("")
        rows = rows.withColumn("_k", tail).join(low, (F.col("_k") == F.col("_c")) & (F.col("token") == F.col("_t")), "left")
        rows = rows.withColumn("p", (F.coalesce("_n", F.lit(0)) + lam * vocab * F.col("p")) / (F.coalesce("_cn", F.lit(0)) + lam * vocab)).drop("_k", "_c", "_t", "_n", "_cn")
    return rows


def document_scores(docs: DataFrame, doc: str, tokens: Column, model: DataFrame, order: int, unseen: float) -> DataFrame:
    """Sum of log2 p over each document's n-grams, end mark included; n-grams without a row have ``unseen``."""
    rows = ngrams_of(docs.select(doc, tokens.alias("_t")), F.col("_t"), order).select(doc, "ngram")
    table = model.select(F.when(F.col("context") == "", F.col("token")).otherwise(F.concat_ws(" ", "context", "token")).alias("ngram"), "p")
    return rows.join(table, "ngram", "left").groupBy(doc).agg(F.count(F.lit(1)).alias("n"), F.sum(F.log2(F.coalesce("p", F.lit(unseen)))).alias("log2p"))


def parse_arpa(text: str) -> list[tuple[str, int, float, float]]:
    """(ngram, n, cost, back-off) from ARPA text, natural-log costs (negated)."""
    import math

    out, n = [], 0
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("\\") and line.endswith("-grams:"):
            n = int(line[1:].split("-")[0])
        elif line.startswith("\\"):
            n = 0
        elif n and line:
            f = line.split()
            back = float(f[n + 1]) if len(f) > n + 1 else 0.0
            out.append((" ".join(f[1 : n + 1]), n, -float(f[0]) * math.log(10), -back * math.log(10)))
    return out


def cost(lm: dict[str, tuple[float, float]], history: list[str], token: str) -> float:
    """Cost of a token after a history: the longest entry, plus the back-offs of the longer histories."""
    spent = 0.0
    for k in range(len(history) + 1):
        h = history[k:]
        hit = lm.get(" ".join([*h, token]))
        if hit is not None:
            return spent + hit[0]
        if h:
            spent += lm.get(" ".join(h), (0.0, 0.0))[1]
    return float("inf")
