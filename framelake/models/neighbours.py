"""K-nearest neighbours, k-means steps and principal components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dsp import distance_sq, doubles

#: Bytes of queries that are sent to all tasks at once, and queries compared with a batch of points at once.
SLICE_BYTES, AT_ONCE = 1 << 25, 512


def nearest(queries: DataFrame, points: DataFrame, k: int, id_col: str, x: str, label: str, leave_self: bool = False) -> DataFrame:
    """The k nearest points of each query: query, rank, id, distance squared, label; ties to the smaller id.

    Points stay where they are read; queries go to them in slices of bounded
    size.  A task keeps k points a query, and the tasks' lists are merged.
    """
    kinds = {**dict(points.dtypes), "query": dict(queries.dtypes)[id_col]}
    asks = queries.select(F.col(id_col).alias("query"), F.col(x).cast("array<double>").alias("qx"))
    held = points.select(F.col(id_col).alias("id"), F.col(x).cast("array<double>").alias("px"), F.col(label).alias("label"))
    size = asks.agg(F.sum(8 * F.size("qx"))).first()[0] or 0
    slices = max(1, -(-size // SLICE_BYTES))
    found = None
    for s in range(slices):
        mine = asks.where(F.pmod(F.xxhash64("query", "qx"), F.lit(slices)) == s) if slices > 1 else asks
        some = _nearest_of(mine.toArrow(), held, k, kinds, id_col, label, leave_self)
        found = some if found is None else found.unionByName(some)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.round("d", 9), "id")))
    return ranked.where(F.col("rank") <= k).select("query", "rank", "id", "d", "label")


def _nearest_of(table, points: DataFrame, k: int, kinds: dict, id_col: str, label: str, leave_self: bool) -> DataFrame:
    """The k nearest of each task for the queries of one slice."""
    import numpy as np

    names = table.column("query").to_numpy()
    vectors = np.array(table.column("qx").to_pylist(), float).reshape(len(names), -1)
    shared = points.sparkSession.sparkContext.broadcast((names, vectors))  # at most about SLICE_BYTES

    def work(batches):
        import numpy as np
        import pyarrow as pa

        asked, u = shared.value
        best = None  # (query's place, rounded distance, id, distance, label) of the k nearest so far

        def kept(parts):
            q, r, i, d, y = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((i, r, q))
            q, r, i, d, y = (c[order] for c in (q, r, i, d, y))
            few = np.arange(len(q)) - np.searchsorted(q, q) < k
            return tuple(c[few] for c in (q, r, i, d, y))

        for batch in batches:
            if not batch.num_rows or not len(asked):
                continue
            ids, labels = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            for lo in range(0, len(asked), AT_ONCE):
                w = u[lo : lo + AT_ONCE]
                d = np.maximum((w * w).sum(1)[:, None] + (v * v).sum(1) - 2 * w @ v.T, 0)
                if leave_self:
                    d[asked[lo : lo + AT_ONCE][:, None] == ids[None, :]] = np.inf
                least = min(k, len(ids)) - 1
                cut = np.partition(d, least, axis=1)[:, least]
                q, j = np.nonzero((d <= cut[:, None] + 1e-9 * (1 + cut[:, None])) & np.isfinite(d))
                exact = ((w[q] - v[j]) ** 2).sum(axis=1)
                new = (q + lo, np.round(exact, 9), ids[j], exact, labels[j])
                best = kept([new] if best is None else [best, new])
        if best is not None:
            q, _, i, d, y = best
            yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(i), pa.array(d), pa.array(y)], names=["query", "id", "d", "label"])

    return points.select("id", "px", "label").mapInArrow(work, f"query {kinds['query']}, id {kinds[id_col]}, d double, label {kinds[label]}")


def vote_shares(neighbours: DataFrame, sizes: list[int], labels: list) -> DataFrame:
    """For each query, size n and class: votes among the first n and their share."""
    rows = neighbours.withColumn("n", F.explode(F.array(*map(F.lit, sizes)))).where("rank <= n")
    counts = rows.groupBy("query", "n").agg(*(F.count_if(F.col("label") == v).alias(f"votes_{v}") for v in labels))
    return counts.select("query", "n", *(F.col(f"votes_{v}") for v in labels), *((F.col(f"votes_{v}") / F.col("n")).alias(f"share_{v}") for v in labels))


def majority(neighbours: DataFrame, k: int) -> DataFrame:
    """The label with most votes among k, ties to the smaller label."""
    votes = neighbours.where(F.col("rank") <= k).groupBy("query", "label").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("query").agg(F.max(F.struct("votes", (-F.col("label")).alias("neg"))).alias("m")).select("query", (-F.col("m.neg")).alias("hyp"), F.col("m.votes").alias("votes"))


def whitening(df: DataFrame, x: str) -> list[list[float]]:
    """Cholesky factor of the inverse covariance: distances after it are Mahalanobis'."""
    import numpy as np

    mean, cov = covariance(df, x)
    return np.linalg.cholesky(np.linalg.inv(cov + 1e-9 * np.eye(len(mean)))).T.tolist()


def covariance(df: DataFrame, x: str):
    """(mean, population covariance), from partial sums of products."""
    import numpy as np

    def work(batches):
        import numpy as np
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                m = np.array(batch.column(0).to_pylist(), float)
                part = np.concatenate([[len(m)], m.sum(axis=0), (m.T @ m).ravel()])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    v = np.array([r["v"] for r in df.select(x).mapInArrow(work, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()])  # dims squared
    d = int(round((-1 + (1 + 4 * (len(v) - 1)) ** 0.5) / 2))
    mean = v[1 : 1 + d] / v[0]
    return mean, v[1 + d :].reshape(d, d) / v[0] - np.outer(mean, mean)


def principal_components(df: DataFrame, x: str, n: int):
    """(values, vectors as rows) of the n largest, signs fixed by the largest entry."""
    import numpy as np

    values, vectors = np.linalg.eigh(covariance(df, x)[1])
    values, vectors = values[::-1][:n], vectors[:, ::-1][:, :n].T
    sign = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
    return values, vectors * sign[:, None]


def probabilistic_pca(df: DataFrame, x: str, n: int):
    """(noise variance, weights as columns): the n leading directions and the mean of the rest."""
    import numpy as np

    values, vectors = np.linalg.eigh(covariance(df, x)[1])
    values, vectors = values[::-1], vectors[:, ::-1]
    noise = float(values[n:].mean())
    return noise, vectors[:, :n] * np.sqrt(np.maximum(values[:n] - noise, 0))


def assign(x: Column, centres: list[list[float]]) -> Column:
    """Index of the nearest centre, ties to the first."""
    d = F.array(*(F.round(distance_sq(x, doubles(c)), 9) for c in centres))
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def kmeans_step(df: DataFrame, x: str, centres: list[list[float]]) -> tuple[list[list[float]], float]:
    """One Lloyd step: (centres, sum of squared distances); an empty cluster keeps its centre."""
    rows = df.select(F.col(x).alias("_x")).withColumn("_c", assign(F.col("_x"), centres))
    table = F.array(*(doubles(c) for c in centres))
    error = rows.select(distance_sq(F.col("_x"), F.element_at(table, F.col("_c") + 1)).alias("e")).agg(F.sum("e")).first()[0]
    sums = rows.select("_c", F.posexplode("_x").alias("i", "v")).groupBy("_c", "i").agg(F.avg(F.col("v").cast("double")).alias("m")).collect()  # centres x dims
    out = [list(c) for c in centres]
    for r in sums:
        out[r["_c"]][r["i"]] = r["m"]
    return out, float(error or 0.0)


def kmeans(df: DataFrame, x: str, centres: list[list[float]], iterations: int = 20, tolerance: float = 1e-6) -> list[list[float]]:
    """Lloyd steps until centres and error settle."""
    last = None
    for _ in range(iterations):
        new, error = kmeans_step(df, x, centres)
        moved = max(abs(a - b) for p, q in zip(new, centres) for a, b in zip(p, q))
        centres = new
        if moved < tolerance and last is not None and abs(last - error) < tolerance:
            break
        last = error
    return centres
