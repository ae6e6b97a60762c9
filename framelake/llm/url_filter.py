"""URL filter by the ratio of two character language models.

Rules judge what they fit; the URLs that rules accept and reject are the
examples from which two variable-order Markov models learn how the others
should be judged.  Both models count, over all examples, what follows each
context of up to ``ORDER`` characters (host and path, digits as one class), and
interpolate the orders by Witten-Bell smoothing.  The filter's figure is the
log-likelihood of the accepting model less that of the rejecting one, divided
by the URL's length.  A cutoff is calibrated on examples that counting left
out, where the balanced error is least; URLs at or above it are allowed.

Every gram and context is counted by a 64-bit hash of its own, in distributed
sums, so the models grow with the examples.  While their tables (16 bytes a
distinct gram, 24 a distinct context of each class) are within ``MODEL_BYTES``
they are sent to all tasks; beyond, URLs are scored by joins of their grams with
the tables, to the same figures.

Defined cases: a null URL or one without ``://`` has an empty host and path and
no rule, and is scored as the empty string; each row is judged by its own URL,
so repeated rows and rows of one id or none are judged alike; each row is an
example of its own; with examples of only one class the verdict is that class's,
without any it is allow; an empty table gives an empty one; a URL of any length
is read whole; columns other than the id and the URL are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, join_spread, write_stage

ORDER = 5
#: What models may be sent to all tasks, in bytes of their tables.
MODEL_BYTES = 1 << 26


def split_url(url: Column) -> tuple[Column, Column]:
    """(host in lower case, path); both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A([^?#]*)", 1)
    return ascii_lower(host), path


def judge_by_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does. rules: (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):  # longer rules come last and so outside
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _codes(texts):
    """Characters as small integers: UTF-8 bytes, digits as one, 1 before and 2 behind each text."""
    import numpy as np

    table = np.arange(256, dtype=np.int64)
    table[48:58] = 48
    data = [b"\x01" + t.encode("utf-8", "replace") + b"\x02" for t in texts]
    sizes = np.array([len(d) for d in data])
    return table[np.frombuffer(b"".join(data), np.uint8)], sizes


def _grams(codes, sizes):
    """For each character but the first of its text and each order: 64-bit hashes of (context, character) and of the context, and where they count.

    A context never reaches beyond its text's start; where it would, they do not count.
    """
    import numpy as np

    from .minhash import _fmix

    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    out, context = [], np.zeros(len(codes), np.uint64)
    for order in range(ORDER + 1):
        if order:
            back = np.zeros(len(codes), np.uint64)
            back[order:] = codes[:-order].astype(np.uint64)
            context = (context + back + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        seed = np.uint64((order + 1) * 0xC2B2AE3D27D4EB4F & (2**64 - 1))
        c = _fmix(context ^ seed)
        g = _fmix(c + (codes.astype(np.uint64) + np.uint64(7)) * np.uint64(0x165667B19E3779F9))
        ok = place > max(order - 1, 0)
        out.append((g.view(np.int64), c.view(np.int64), ok))
    return out, place > 0


def count(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(y, g, n) of all grams of both classes, and (y, c, seen, kinds) of all contexts with their number of successors.

    examples: (text, label 0 or 1).  A task sends each (gram, context) of a batch once.
    """

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            texts = batch.column(0).to_pylist()
            for y in (0, 1):
                mine = [t for t, v in zip(texts, label) if v == y]
                for g, c, ok in _grams(*_codes(mine))[0] if mine else ():
                    found, first, n = np.unique(g[ok], return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), y, np.int32)), pa.array(found), pa.array(c[ok][first]), pa.array(n.astype(np.int64))], names=["y", "g", "c", "n"])

    sent = examples.select("text", F.col("label").cast("int")).mapInArrow(work, "y int, g long, c long, n long")
    grams = write_stage(sent.groupBy("y", "g").agg(F.first("c").alias("c"), F.sum("n").alias("n")), "grams")  # a gram has one context
    return grams, grams.groupBy("y", "c").agg(F.sum("n").alias("seen"), F.count(F.lit(1)).alias("kinds"))


def fit(examples: DataFrame) -> dict:
    """Of both classes, the sorted distinct grams with their counts, and contexts with theirs and the number of successors."""
    return _gathered(*count(examples))


def _gathered(grams: DataFrame, contexts: DataFrame) -> dict:
    model = {}
    for y in (0, 1):
        for kind, rows in (("grams", grams.where(F.col("y") == y).select("g", "n")), ("contexts", contexts.where(F.col("y") == y).select("c", "seen", "kinds"))):
            table = rows.toArrow()
            key, *values = (table.column(k).to_numpy() for k in range(table.num_columns))
            order = key.argsort()
            model[y, kind] = (key[order], *(v[order] for v in values))
    return model


def _look_up(keys, table):
    """The table's values at ``keys``, 0 where it has none."""
    import numpy as np

    known, *values = table
    if not len(known):
        return [np.zeros(len(keys), np.int64) for _ in values]
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return [np.where(known[at] == keys, v[at], 0) for v in values]


def _mixed(part, ok, n, seen, kinds):
    """Witten-Bell: the next order's probabilities from those of the order below."""
    import numpy as np

    total = seen + kinds
    return np.where(ok & (total > 0), (n + kinds * part) / np.maximum(total, 1), part)


def _over_length(parts, real, sizes):
    import numpy as np

    logs = [np.where(real, np.log(np.maximum(p, 1e-12)), 0.0) for p in parts]
    starts = np.cumsum(sizes) - sizes
    return np.add.reduceat(logs[1] - logs[0], starts) / (sizes - 1)


def ratios(texts, model: dict):
    """Log-likelihood difference over length of each text."""
    import numpy as np

    codes, sizes = _codes(texts)
    grams, real = _grams(codes, sizes)
    parts = [np.full(len(codes), 1 / 256) for _ in (0, 1)]
    for g, c, ok in grams:
        (gram, at_gram), (context, at_context) = (np.unique(x, return_inverse=True) for x in (g, c))
        for y in (0, 1):
            (n,), (seen, kinds) = _look_up(gram, model[y, "grams"]), _look_up(context, model[y, "contexts"])
            parts[y] = _mixed(parts[y], ok, n[at_gram], seen[at_context], kinds[at_context])
    return _over_length(parts, real, sizes)


def _scored_by_tasks(rows: DataFrame, model: dict) -> DataFrame:
    """``rows`` with the ratio r of the column text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # at most about MODEL_BYTES

    @F.pandas_udf("double")
    def ratio(texts):
        import pandas as pd

        return pd.Series(ratios(texts.tolist(), shared.value)) if len(texts) else pd.Series([], dtype="float64")

    return rows.withColumn("r", ratio("text"))


def _scored_by_joins(rows: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """As _scored_by_tasks, of each distinct text once, by joins of its distinct grams with the tables."""

    def ask(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                seen = {}
                for g, c, ok in _grams(*_codes([text]))[0]:
                    found, first = np.unique(g[ok], return_index=True)
                    seen.update(zip(found.tolist(), c[ok][first].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([text] * len(seen)), pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["text", "g", "c"])

    def wide(table, key, columns):
        return table.groupBy(key).agg(*(F.sum(F.when(F.col("y") == y, F.col(x)).otherwise(0)).alias(f"{x}{y}") for y in (0, 1) for x in columns))

    texts = rows.select("text").distinct()
    asked = texts.mapInArrow(ask, "text string, g long, c long").withColumns({"u1": F.xxhash64("text"), "u2": F.xxhash64(F.lit(1), "text")}).drop("text")
    asked = write_stage(asked, "asked")
    count = asked.count()
    often = lambda key: asked.groupBy(key).agg(F.count(F.lit(1)).alias("k"))  # noqa: E731  the low orders' are in nearly every URL
    told = join_spread(asked, often("g").join(wide(grams, "g", ["n"]), "g", "left"), ["g"], count)
    told = join_spread(told, often("c").join(wide(contexts, "c", ["seen", "kinds"]), "c", "left"), ["c"], count)
    names = ["n0", "n1", "seen0", "kinds0", "seen1", "kinds1"]
    facts = told.groupBy("u1", "u2").agg(F.collect_list(F.struct("g", *(F.coalesce(x, F.lit(0)).alias(x) for x in names))).alias("facts"))
    keyed = texts.withColumns({"u1": F.xxhash64("text"), "u2": F.xxhash64(F.lit(1), "text")}).join(facts, ["u1", "u2"]).select("text", "facts")

    def score(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, facts in zip(batch.column(0), batch.column(1)):
                f = facts.values
                key = f.field(0).to_numpy()
                order = key.argsort()
                of = {x: f.field(k + 1).to_numpy()[order] for k, x in enumerate(names)}
                codes, sizes = _codes([text.as_py()])
                listed, real = _grams(codes, sizes)
                parts = [np.full(len(codes), 1 / 256) for _ in (0, 1)]
                for g, _, ok in listed:
                    at = np.minimum(np.searchsorted(key[order], g), len(key) - 1)
                    for y in (0, 1):
                        parts[y] = _mixed(parts[y], ok, of[f"n{y}"][at], of[f"seen{y}"][at], of[f"kinds{y}"][at])
                out.append(float(_over_length(parts, real, sizes)[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["text", "r"])

    found = write_stage(keyed.mapInArrow(score, "text string, r double"), "scored")
    held = rows.groupBy("text").agg(F.count(F.lit(1)).alias("k"))  # of URLs without host and path the text is empty
    return join_spread(rows, held.join(found, "text", "left"), ["text"], rows.count())


def calibrate(scored: DataFrame, bins: int = 4096) -> float:
    """The cutoff on (r, label) with the least balanced error, from a histogram of ``bins`` cells over -4 to 4."""
    import numpy as np

    cell = F.least(F.greatest(F.floor((F.col("r") + 4) / 8 * bins), F.lit(0)), F.lit(bins - 1)).cast("int").alias("cell")
    rows = scored.groupBy(cell, "label").count().collect()
    counts = np.zeros((2, bins))
    for r in rows:
        counts[r["label"], r["cell"]] += r["count"]
    n0, n1 = counts.sum(axis=1)
    if not n0 or not n1:
        return 0.0 if n0 == n1 else -1e9 if n1 else 1e9
    # error of the cutoff at the lower edge of each cell: rejected 1s below it, accepted 0s from it on
    error = (np.cumsum(counts[1]) - counts[1]) / n1 + (n0 - np.cumsum(counts[0]) + counts[0]) / n0
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(best[len(best) // 2] / bins * 8 - 4)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], hold: int = 5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and ratio of every row.

    Examples whose crc32 is divisible by ``hold`` calibrate; the others are counted.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col(f"`{url_col}`").cast("string"))
    cut = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = judge_by_rules(F.col("host"), F.col("path"), rules)
    judged = cut.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"), F.concat("host", "path").alias("text"))
    examples = judged.where("said is not null").select("text", (F.col("said") == "allow").cast("int").alias("label"))
    counted = F.pmod(F.crc32("text"), F.lit(hold)) != 0
    grams, contexts = count(examples.where(counted))
    sizes = grams.agg(F.count(F.lit(1))).first()[0], contexts.agg(F.count(F.lit(1))).first()[0]
    if 16 * sizes[0] + 24 * sizes[1] <= MODEL_BYTES:
        model = _gathered(grams, contexts)
        scored = lambda rows: _scored_by_tasks(rows, model)
    else:
        scored = lambda rows: _scored_by_joins(rows, grams, contexts)
    cutoff = calibrate(scored(examples.where(~counted)))
    verdict = F.coalesce("said", F.when(F.col("r") >= cutoff, "allow").otherwise("block"))
    return scored(judged).select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("r").alias("ratio"))
