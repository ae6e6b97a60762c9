"""Further models: discriminant transforms, statistical activity detection, linear and radial-basis networks, maps, optimisers, samplers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gaussian import Mixture
from .neighbours import covariance


def _sums(df: DataFrame, columns: list[str], part) -> "object":
    """Sum of ``part(*arrays)`` (one vector) over all batches: a task sends one vector."""
    import numpy as np

    def work(batches):
        import numpy as np
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                v = np.asarray(part(*(np.array(batch.column(k).to_pylist(), float) for k in range(len(columns)))), float).ravel()
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    rows = df.select(*columns).mapInArrow(work, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # model-sized
    return np.array([r["v"] for r in rows])


def class_scatter(df: DataFrame, label: str, x: str) -> dict:
    """label (as a string) -> (n, mean, population covariance), from one pass of all classes."""
    import numpy as np

    from .gaussian import summed_parts

    sums = summed_parts(df, F.col(label), [x], lambda _, m: np.concatenate([[len(m)], m.sum(axis=0), (m.T @ m).ravel()]))
    out = {}
    for k, v in sums.items():
        d = int(round((-1 + (1 + 4 * (len(v) - 1)) ** 0.5) / 2))
        mean = v[1 : 1 + d] / v[0]
        out[k] = (int(v[0]), mean, v[1 + d :].reshape(d, d) / v[0] - np.outer(mean, mean))
    return out


def discriminant_transform(df: DataFrame, label: str, x: str, nuisance: int, iterations: int = 10):
    """Heteroscedastic linear discriminant transform: rows of A, the last ``nuisance`` of which see the global statistics.

    Class statistics come from Spark; the rows are then updated in turn on the
    driver, a_i = c_i G_i^-1 sqrt(N / (c_i G_i^-1 c_i')), which never lowers the likelihood.
    """
    import numpy as np

    stats = class_scatter(df, label, x)
    n = sum(s[0] for s in stats.values())
    mean, total = covariance(df, x)
    d, keep = len(mean), len(mean) - nuisance
    a = np.eye(d)
    for _ in range(iterations):
        for i in range(d):
            groups = [(c, w) for c, _, w in stats.values()] if i < keep else [(n, total)]
            g = sum(c / max(a[i] @ w @ a[i], 1e-12) * w for c, w in groups)
            inverse = np.linalg.inv(g + 1e-9 * np.eye(d))
            cofactor = np.linalg.inv(a).T[i] * np.linalg.det(a)
            a[i] = cofactor @ inverse * math.sqrt(n / (cofactor @ inverse @ cofactor))
    return a


def transform_likelihood(df: DataFrame, label: str, x: str, a, nuisance: int) -> float:
    """What discriminant_transform raises: N log|det A| less half the logs of the diagonal variances."""
    import numpy as np

    stats, (_, total) = class_scatter(df, label, x), covariance(df, x)
    n, keep = sum(s[0] for s in stats.values()), len(a) - nuisance
    out = n * math.log(abs(np.linalg.det(a)))
    for i, row in enumerate(a):
        out -= 0.5 * (sum(c * math.log(row @ w @ row) for c, _, w in stats.values()) if i < keep else n * math.log(row @ total @ row))
    return out


def activity_ratio(power: list, noise_frames: int = 6, alpha: float = 0.98, gain: float = 0.99):
    """Log likelihood ratio of speech a frame, from power spectra: decision-directed a priori ratios, noise from the first frames."""
    import numpy as np

    p = np.asarray(power, float)
    noise = np.maximum(p[:noise_frames].mean(axis=0), 1e-12)
    out, before = [], None
    for frame in p:
        post = np.minimum(frame / noise, 1e3)
        prior = np.maximum(post - 1, 0) if before is None else alpha * before + (1 - alpha) * np.maximum(post - 1, 0)
        prior = np.maximum(prior, 10**-2.5)
        ratio = float(np.mean(post * prior / (1 + prior) - np.log1p(prior)))
        before = (prior / (1 + prior)) ** 2 * post
        if ratio < 0.15:
            noise = gain * noise + (1 - gain) * frame
        out.append(ratio)
    return out


def detect_activity(df: DataFrame, part: list[str], order: str, power: str, threshold: float = 0.15) -> DataFrame:
    """Frames with their ratio and decision; an utterance is one group."""
    kinds = dict(df.dtypes)

    def run(pdf):
        pdf = pdf.sort_values(order)
        ratio = activity_ratio(pdf[power].tolist())
        return pdf[[*part, order]].assign(ratio=ratio, speech=[int(r > threshold) for r in ratio])

    return df.select(*part, order, power).groupBy(*part).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*part, order]) + ", ratio double, speech int")


def linear_fit(df: DataFrame, x: str, y: str, ridge: float = 1e-6):
    """Least squares with a constant, from summed products."""
    import numpy as np

    def part(m, t):
        m = np.c_[m, np.ones(len(m))]
        return np.concatenate([[m.shape[1]], (m.T @ m).ravel(), m.T @ t])

    v = _sums(df, [x, y], lambda m, t: part(m, t)[1:])
    d = int((math.isqrt(1 + 4 * len(v)) - 1) // 2)
    return np.linalg.solve(v[: d * d].reshape(d, d) + ridge * np.eye(d), v[d * d :])


def logistic_fit(df: DataFrame, x: str, y: str, iterations: int = 8, ridge: float = 1e-4):
    """Logistic regression by reweighted least squares, one aggregation a step."""
    import numpy as np

    d = len(df.select(x).first()[0]) + 1
    w = np.zeros(d)
    for _ in range(iterations):

        def part(m, t, w=w):
            m = np.c_[m, np.ones(len(m))]
            p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
            return np.concatenate([(m.T @ (m * (p * (1 - p))[:, None])).ravel(), m.T @ (t - p)])

        v = _sums(df, [x, y], part)
        w = w + np.linalg.solve(v[: d * d].reshape(d, d) + ridge * np.eye(d), v[d * d :] - ridge * w)
    return w


def radial_fit(df: DataFrame, x: str, y: str, centres, width: float, ridge: float = 1e-6):
    """Weights of a radial-basis network with given centres."""
    import numpy as np

    c = np.asarray(centres, float)
    k = len(c) + 1

    def part(m, t):
        h = np.c_[np.exp(-((m[:, None] - c) ** 2).sum(axis=2) / (2 * width * width)), np.ones(len(m))]
        return np.concatenate([(h.T @ h).ravel(), h.T @ t])

    v = _sums(df, [x, y], part)
    return np.linalg.solve(v[: k * k].reshape(k, k) + ridge * np.eye(k), v[k * k :])


def perceptron(df: DataFrame, x: str, y: str, layers: list[int], seed: int = 1):
    """A multilayer perceptron classifier by the library's own trainer."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    return MultilayerPerceptronClassifier(layers=layers, seed=seed, featuresCol="_v", labelCol=y).fit(df.withColumn("_v", array_to_vector(x)))


def organising_map(df: DataFrame, x: str, grid: int, iterations: int = 8, seed: int = 1):
    """A batch self-organising map on a grid x grid sheet: each step is one aggregation."""
    import numpy as np

    mean, cov = covariance(df, x)
    rng = np.random.default_rng(seed)
    nodes = mean + rng.standard_normal((grid * grid, len(mean))) * np.sqrt(np.maximum(np.diag(cov), 1e-12))
    place = np.array([(i, j) for i in range(grid) for j in range(grid)], float)
    gap = ((place[:, None] - place) ** 2).sum(axis=2)
    for step in range(iterations):
        near = np.exp(-gap / (2 * max(0.5, grid / 2 * (1 - step / iterations)) ** 2))

        def part(m, nodes=nodes, near=near):
            best = ((m[:, None] - nodes) ** 2).sum(axis=2).argmin(axis=1)
            h = near[best]
            return np.concatenate([h.sum(axis=0), (h.T @ m).ravel()])

        v = _sums(df, [x], part)
        n = grid * grid
        nodes = v[n:].reshape(n, -1) / np.maximum(v[:n], 1e-12)[:, None]
    return nodes


def regress_process(train_x, train_y, points, width: float, noise: float):
    """Gaussian-process means and variances at ``points``; the training set is model-sized."""
    import numpy as np

    a, b = np.atleast_2d(train_x), np.atleast_2d(points)
    kernel = lambda p, q: np.exp(-((p[:, None] - q) ** 2).sum(axis=2) / (2 * width * width))
    chol = np.linalg.cholesky(kernel(a, a) + noise * np.eye(len(a)))
    cross = np.linalg.solve(chol, kernel(a, b))
    return cross.T @ np.linalg.solve(chol, np.asarray(train_y, float)), 1 + noise - (cross * cross).sum(axis=0)


def minimise(f, gradient, x, iterations: int = 200, tolerance: float = 1e-8):
    """Conjugate gradients (Polak-Ribiere, restarted) with backtracking."""
    import numpy as np

    x = np.asarray(x, float)
    g = gradient(x)
    d, fx = -g, f(x)
    for _ in range(iterations):
        if g @ g < tolerance**2:
            break
        if g @ d >= 0:
            d = -g
        t = 1.0
        while f(x + t * d) > fx + 1e-4 * t * (g @ d) and t > 1e-14:
            t /= 2
        x = x + t * d
        new, fx = gradient(x), f(x)
        d = -new + max(0.0, new @ (new - g) / (g @ g)) * d
        g = new
    return x


def metropolis(log_p, x, n: int, step: float, seed: int = 1):
    """Random-walk samples of a density."""
    import numpy as np

    rng, x = np.random.default_rng(seed), np.asarray(x, float)
    out, lp = [], log_p(x)
    for _ in range(n):
        y = x + step * rng.standard_normal(x.shape)
        lq = log_p(y)
        if math.log(rng.random() + 1e-300) < lq - lp:
            x, lp = y, lq
        out.append(x)
    return np.array(out)


def hamiltonian(log_p, gradient, x, n: int, step: float, leaps: int = 10, seed: int = 1):
    """Hybrid Monte Carlo samples."""
    import numpy as np

    rng, x = np.random.default_rng(seed), np.asarray(x, float)
    out = []
    for _ in range(n):
        p = rng.standard_normal(x.shape)
        y, q = x, p + step / 2 * gradient(x)
        for k in range(leaps):
            y = y + step * q
            q = q + (step if k < leaps - 1 else step / 2) * gradient(y)
        if math.log(rng.random() + 1e-300) < log_p(y) - log_p(x) + (p @ p - q @ q) / 2:
            x = y
        out.append(x)
    return np.array(out)


def labelled_segments(spark, models: dict[str, Mixture], utterances: int, segments: int, length: int, seed: int = 1) -> DataFrame:
    """Synthetic frames: utterances of segments, each drawn from the mixture of its label; equal under recomputation."""
    names = sorted(models)

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for u in pdf["id"]:
                rng, out, t = np.random.default_rng([seed, int(u)]), [], 0
                for s in range(segments):
                    k = names[int(rng.integers(len(names)))]
                    for v in models[k].sample(length, int(rng.integers(1 << 31))):
                        t += 1
                        out.append((int(u), t, s, k, v.tolist()))
                yield pd.DataFrame(out, columns=["utt", "frame", "seg", "label", "x"])

    return spark.range(utterances).mapInPandas(run, "utt long, frame int, seg int, label string, x array<double>")
