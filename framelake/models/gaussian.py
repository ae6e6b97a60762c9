"""Gaussians and mixtures with spherical, diagonal or full covariance; EM as one aggregation a step."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dsp import doubles
from ..operators.metrics import moments

CLIP = (2e-20, 2e20)


def class_gaussians(df: DataFrame, label: str, x: Column, floor: float = 1e-6) -> DataFrame:
    """Diagonal Gaussian of each class: label, n, mean, var (arrays). One partial aggregation."""
    by = moments(df, [label], x).groupBy(label)
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("dim", c))), lambda s: s[c])
    return by.agg(F.max("n").alias("n"), order("mean").alias("mean"), F.transform(order("var"), lambda v: F.greatest(v, F.lit(floor))).alias("var"))


def log_density(x: Column, mean: Column, var: Column) -> Column:
    """Log density of a diagonal Gaussian."""
    quad = F.aggregate(F.zip_with(F.zip_with(x, mean, lambda a, m: (a - m) * (a - m)), var, lambda q, v: q / v + F.ln(v)), F.lit(0.0), lambda s, t: s + t)
    return -0.5 * (quad + F.size(x) * math.log(2 * math.pi))


def adapt(old: Column, estimate: Column, relevance: float, count: Column | None = None) -> Column:
    """Relevance adaptation: f = 1 / (1 + r), or n / (n + r) with a count; f * new + (1 - f) * old."""
    f = F.lit(1 / (1 + relevance)) if count is None else count / (count + relevance)
    return f * estimate + (1 - f) * old


def classify(df: DataFrame, models: DataFrame, key: list[str], label: str, x: str) -> DataFrame:
    """Each row's class by largest log density, ties to the smaller label; ``models`` is (label, mean, var), a row a class.

    The model table is gathered to one row and joined to every frame; its size is classes x dims, checked.
    """
    count = models.count()
    if count > 10_000:
        raise ValueError("too many classes for a model table of this kind")
    table = models.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "mean", "var"))).alias("_m"))
    joined = df.crossJoin(F.broadcast(table))
    scored = joined.withColumn("scores", F.transform("_m", lambda m: F.struct(F.round(log_density(F.col(x), m["mean"], m["var"]), 6).alias("score"), m["label"].alias("label"))))
    top = F.array_max(F.transform("scores", lambda s: s["score"]))
    best = F.array_min(F.transform(F.filter("scores", lambda s: s["score"] == top), lambda s: s["label"]))
    return scored.withColumns({"hyp": best, "ranked": F.sort_array("scores", False)}).drop("_m")


@dataclass
class Mixture:
    """Weights, means and covariances of a mixture. kind: spherical, diag or full."""

    weights: list[float]
    means: list[list[float]]
    covs: list = field(repr=False)
    kind: str = "diag"

    @property
    def size(self) -> int:
        return len(self.weights)

    def log_parts(self, x):
        """(rows, components) log of weight times density, in numpy."""
        import numpy as np

        x = np.atleast_2d(np.asarray(x, float))
        d, out = x.shape[1], []
        for w, m, c in zip(self.weights, self.means, self.covs):
            z = x - np.asarray(m)
            if self.kind == "full":
                chol = np.linalg.cholesky(np.asarray(c))
                q = np.linalg.solve(chol, z.T)
                quad, logdet = (q * q).sum(axis=0), 2 * np.log(np.diag(chol)).sum()
            else:
                var = np.full(d, float(c)) if self.kind == "spherical" else np.asarray(c, float)
                quad, logdet = (z * z / var).sum(axis=1), np.log(var).sum()
            out.append((math.log(w) if w > 0 else -math.inf) - 0.5 * (quad + logdet + d * math.log(2 * math.pi)))
        return np.array(out).T

    def log_prob(self, x):
        import numpy as np

        parts = self.log_parts(x)
        top = parts.max(axis=1, keepdims=True)
        return (top + np.log(np.exp(parts - top).sum(axis=1, keepdims=True))).ravel()

    def posteriors(self, x):
        """Rows of responsibilities; rows without any density are uniform."""
        import numpy as np

        parts = self.log_parts(x)
        top = parts.max(axis=1, keepdims=True)
        p = np.exp(parts - np.where(np.isfinite(top), top, 0))
        total = p.sum(axis=1, keepdims=True)
        return np.where(total > 0, p / np.where(total > 0, total, 1), 1 / self.size)

    def sample(self, n: int, seed: int):
        import numpy as np

        rng, d = np.random.default_rng(seed), len(self.means[0])
        at = rng.choice(self.size, n, p=np.asarray(self.weights) / sum(self.weights))
        out = np.empty((n, d))
        for k in range(self.size):
            mine = np.flatnonzero(at == k)
            z = rng.standard_normal((len(mine), d))
            c = self.covs[k]
            out[mine] = np.asarray(self.means[k]) + (z @ np.linalg.cholesky(np.asarray(c)).T if self.kind == "full" else z * np.sqrt(np.asarray(c)))
        return out

    def split(self, to: int) -> "Mixture":
        """Grow to ``to`` components: the heaviest is halved, its means set 0.2 deviations apart."""
        import numpy as np

        w, m, c = list(self.weights), [list(x) for x in self.means], list(self.covs)
        while len(w) < to:
            k = int(np.argmax(w))
            dev = np.sqrt(np.diag(np.asarray(c[k])) if self.kind == "full" else np.broadcast_to(np.asarray(c[k], float), len(m[k])))
            w[k] /= 2
            w.append(w[k])
            m.append((np.asarray(m[k]) + 0.2 * dev).tolist())
            m[k] = (np.asarray(m[k]) - 0.2 * dev).tolist()
            c.append(c[k])
        return Mixture(w, m, c, self.kind)


@dataclass
class Accumulators:
    """What one pass gathers of a class: rows, log likelihood, and the zeroth, first and second order sums of each component."""

    n: float
    loglik: float
    zeroth: object
    first: object
    second: object

    def __add__(self, other: "Accumulators") -> "Accumulators":
        return Accumulators(*(getattr(self, k) + getattr(other, k) for k in ("n", "loglik", "zeroth", "first", "second")))

    @classmethod
    def of(cls, model: Mixture, x) -> "Accumulators":
        import numpy as np

        p = model.posteriors(x)
        s2 = np.einsum("nk,ni,nj->kij", p, x, x, optimize=True).reshape(model.size, -1) if model.kind == "full" else p.T @ (x * x)
        return cls(len(x), model.log_prob(x).sum(), p.sum(axis=0), p.T @ x, s2)

    def vector(self):
        import numpy as np

        return np.concatenate([[self.n, self.loglik], self.zeroth, self.first.ravel(), self.second.ravel()])

    @classmethod
    def from_vector(cls, v, model: Mixture) -> "Accumulators":
        k, d = model.size, len(model.means[0])
        return cls(v[0], v[1], v[2 : 2 + k], v[2 + k : 2 + k + k * d].reshape(k, d), v[2 + k + k * d :].reshape(k, -1))

    def apply(self, model: Mixture, floor=None) -> Mixture:
        """The mixture of these sums; a component without occupation keeps its mean and covariance."""
        import numpy as np

        k, d, occ = model.size, len(model.means[0]), self.zeroth
        safe = np.maximum(occ, 1e-300)[:, None]
        mean = np.where(occ[:, None] > 1e-10, self.first / safe, np.array(model.means))
        if model.kind == "full":
            covs = []
            for j in range(k):
                c = (self.second[j].reshape(d, d) / safe[j] - np.outer(mean[j], mean[j])) if occ[j] > 1e-10 else np.asarray(model.covs[j])
                covs.append(c + np.eye(d) * (0 if np.linalg.eigvalsh(c)[0] > 1e-10 else 1e-6))
            covs = [c.tolist() for c in covs]
        else:
            var = self.second / safe - mean * mean
            low = np.maximum(CLIP[0], 0 if floor is None else np.asarray(floor))
            var = np.clip(var, low, CLIP[1])
            var = np.where(occ[:, None] > 1e-10, var, np.array([np.broadcast_to(c, d) for c in model.covs], float))
            covs = var.mean(axis=1).tolist() if model.kind == "spherical" else var.tolist()
        return Mixture((occ / self.n).tolist(), mean.tolist(), covs, model.kind)


def summed_parts(df: DataFrame, label: Column, columns: list[str], part) -> dict[str, object]:
    """label -> sum of ``part(label, arrays)`` over all rows, in one pass; a task sends one vector a label. Labels that ``part`` gives None are passed over."""
    import numpy as np

    def work(batches):
        import numpy as np
        import pyarrow as pa

        total: dict = {}
        for batch in batches:
            names = np.array([str(v) for v in batch.column(0).to_pylist()], object)
            cols = [batch.column(k + 1).to_pylist() for k in range(len(columns))]
            for name in sorted(set(names.tolist())):
                mine = np.flatnonzero(names == name)
                v = part(name, *(np.array([c[i] for i in mine], float) for c in cols))
                if v is not None:
                    total[name] = v if name not in total else total[name] + v
        for name, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(v)), pa.array(np.arange(len(v))), pa.array(np.asarray(v, float))], names=["label", "i", "v"])

    rows = df.select(label.cast("string").alias("_label"), *columns).where("_label is not null").mapInArrow(work, "label string, i long, v double")
    out: dict = {}
    for r in rows.groupBy("label", "i").agg(F.sum("v").alias("v")).orderBy("label", "i").collect():  # models' sizes
        out.setdefault(r["label"], []).append(r["v"])
    return {k: np.array(v) for k, v in out.items()}


def accumulate(df: DataFrame, label: str | None, x: str, models: dict[str, Mixture]) -> dict[str, Accumulators]:
    """Accumulators of every class from one pass of its rows; without ``label`` all rows are those of the only model."""
    of = F.lit(next(iter(models))) if label is None else F.col(label)
    found = summed_parts(df, of, [x], lambda name, m: Accumulators.of(models[name], m).vector() if name in models else None)
    return {k: Accumulators.from_vector(v, models[k]) for k, v in found.items()}


def accumulator_rows(spark, accumulators: dict[str, Accumulators]) -> DataFrame:
    """(label, comp, dim, zeroth, first, second) of diagonal accumulators."""
    rows = [(k, c, i, float(a.zeroth[c]), float(a.first[c, i]), float(a.second[c, i])) for k, a in sorted(accumulators.items()) for c in range(len(a.zeroth)) for i in range(a.first.shape[1])]
    return spark.createDataFrame(rows, "label string, comp int, dim int, zeroth double, first double, second double")


def em_step_classes(df: DataFrame, label: str | None, x: str, models: dict[str, Mixture], floor=None) -> tuple[dict[str, Mixture], dict[str, Accumulators]]:
    """One EM step of all classes in one pass: (new mixtures, what was gathered); classes without rows keep theirs."""
    found = accumulate(df, label, x, models)
    return {k: found[k].apply(m, floor) if k in found else m for k, m in models.items()}, found


def em_step(df: DataFrame, x: str, model: Mixture, floor=None) -> tuple[Mixture, float, int]:
    """One EM step: (new mixture, log likelihood under the old one, rows).

    Responsibilities become partial sums inside each batch, so a task sends
    components x dims numbers, whatever its rows. Diagonal variances are clipped.
    """
    models, found = em_step_classes(df, None, x, {"": model}, floor)
    if not found:
        raise ValueError("no rows to train on")
    return models[""], float(found[""].loglik), int(found[""].n)


class MixtureSet:
    """Named mixtures that are trained together: begin, accumulate over any number of tables, apply.

    A call out of that order raises.
    """

    def __init__(self, models: dict[str, Mixture], floor=None):
        self.models, self.floor, self.state, self.held = dict(models), floor, "idle", {}

    def _need(self, *states: str):
        if self.state not in states:
            raise RuntimeError(f"the set is {self.state}, not {' or '.join(states)}")

    def begin(self):
        self._need("idle")
        self.state, self.held = "accumulating", {}

    def accumulate(self, df: DataFrame, label: str, x: str):
        self._need("accumulating")
        for k, a in accumulate(df, label, x, self.models).items():
            self.held[k] = self.held[k] + a if k in self.held else a

    def apply(self, relevance: float | None = None) -> dict[str, float]:
        """New models from the sums, with a relevance drawn towards them from the old ones; the log likelihood of each class before."""
        self._need("accumulating")
        for k, a in self.held.items():
            new = a.apply(self.models[k], self.floor)
            self.models[k] = new if relevance is None else adapted(self.models[k], new, a.n / (a.n + relevance))
        self.state = "idle"
        return {k: float(a.loglik) for k, a in self.held.items()}

    def scores(self, df: DataFrame, x: str) -> DataFrame:
        self._need("idle")
        return score_mixtures(df, x, self.models)


def adapted(old: Mixture, new: Mixture, share: float) -> Mixture:
    """share * new + (1 - share) * old, of weights, means and variances."""
    import numpy as np

    mix = lambda a, b: (share * np.asarray(b, float) + (1 - share) * np.asarray(a, float)).tolist()
    return Mixture(mix(old.weights, new.weights), mix(old.means, new.means), mix(old.covs, new.covs), old.kind)


def fit_mixture(df: DataFrame, x: str, model: Mixture, iterations: int = 10, floor=None) -> tuple[Mixture, list[float]]:
    """A fixed number of EM steps: (mixture, log likelihood before each step)."""
    df, trace = df.select(x).persist(), []
    try:
        for _ in range(iterations):
            model, loglik, _ = em_step(df, x, model, floor)
            trace.append(loglik)
    finally:
        df.unpersist()
    return model, trace


def grow_mixture(df: DataFrame, x: str, start: Mixture, to: int, iterations: int = 4, floor=None) -> Mixture:
    """Doubling: fit, split 2, 4, 8, ... up to ``to`` components, fit after each."""
    model, _ = fit_mixture(df, x, start, iterations, floor)
    while model.size < to:
        model, _ = fit_mixture(df, x, model.split(min(2 * model.size, to)), iterations, floor)
    return model


def one_gaussian(df: DataFrame, x: str, kind: str = "diag") -> Mixture:
    """The single Gaussian of all rows, as a mixture of one."""
    import numpy as np

    d = len(df.select(x).first()[0])
    wide = Mixture([1.0], [[0.0] * d], [np.eye(d).tolist() if kind == "full" else [1.0] * d if kind == "diag" else 1.0], kind)
    return em_step(df, x, wide)[0]


def score_mixtures(df: DataFrame, x: str, models: dict[str, Mixture], out: str = "scores") -> DataFrame:
    """Array of (label, log likelihood) of each row under every model, labels in order."""
    names = sorted(models)

    @F.pandas_udf("array<struct<label:string,score:double>>")
    def score(rows):
        import numpy as np
        import pandas as pd

        if not len(rows):
            return pd.Series([], dtype=object)
        m = np.array(rows.tolist(), float)
        table = np.array([models[k].log_prob(m) for k in names]).T
        return pd.Series([[{"label": k, "score": float(v)} for k, v in zip(names, r)] for r in table])

    return df.withColumn(out, score(x))


def one_gaussian_classes(df: DataFrame, label: str, x: str) -> dict[str, Mixture]:
    """The single diagonal Gaussian of each class, from one pass."""
    import numpy as np

    sums = summed_parts(df, F.col(label), [x], lambda _, m: np.concatenate([[len(m)], m.sum(axis=0), (m * m).sum(axis=0)]))
    out = {}
    for k, v in sums.items():
        n, s1, s2 = v[0], *v[1:].reshape(2, -1)
        out[k] = Mixture([1.0], [(s1 / n).tolist()], [np.clip(s2 / n - (s1 / n) ** 2, *CLIP).tolist()])
    return out


def fit_classes(df: DataFrame, label: str, x: str, models: dict[str, Mixture], iterations: int = 4, floor=None) -> dict[str, Mixture]:
    """A fixed number of EM steps of all classes together, one pass a step."""
    for _ in range(iterations):
        models, _ = em_step_classes(df, label, x, models, floor)
    return models


def train_classes(df: DataFrame, label: str, x: str, size: int, iterations: int = 4, start: dict[str, Mixture] | None = None) -> dict[str, Mixture]:
    """A mixture of ``size`` components for each class, labels as strings.

    All classes are fitted together, one pass a step, and doubled 2, 4, 8, ... together.
    """
    df = df.select(label, x).persist()
    try:
        models = fit_classes(df, label, x, start or one_gaussian_classes(df, label, x), iterations)
        while (have := max((m.size for m in models.values()), default=size)) < size:
            models = fit_classes(df, label, x, {k: m.split(min(2 * have, size)) for k, m in models.items()}, iterations)
    finally:
        df.unpersist()
    return models


def initial_classes(df: DataFrame, label: str, x: str, size: int, iterations: int = 5) -> dict[str, Mixture]:
    """A mixture for each class from k-means on its rows: shares, centres and variances of ``size`` clusters.

    Starts from the rows whose hashes are smallest in each class; every step is
    one pass of all classes. A cluster without rows keeps its centre and has the class's variances.
    """
    import numpy as np

    rows = df.select(F.col(label).cast("string").alias("_l"), F.col(x).cast("array<double>").alias("_x")).where("_l is not null")

    def least(batches):
        import pyarrow as pa

        held: dict = {}
        for batch in batches:
            for name, h, v in zip(*(batch.column(k).to_pylist() for k in range(3))):
                mine = held.setdefault(name, {})
                mine[h] = v
                if len(mine) > 4 * size:
                    held[name] = dict(sorted(mine.items())[:size])
        for name, mine in held.items():
            some = sorted(mine.items())[:size]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array([h for h, _ in some], pa.int64()), pa.array([v for _, v in some], pa.list_(pa.float64()))], names=["l", "h", "x"])

    best: dict = {}
    for r in rows.select("_l", F.xxhash64("_x").alias("h"), "_x").mapInArrow(least, "l string, h long, x array<double>").collect():  # size rows a task and class
        best.setdefault(r["l"], {})[r["h"]] = r["x"]
    centres = {k: np.array([v for _, v in sorted(m.items())[:size]]) for k, m in best.items()}

    def gathered(name, m):
        c = centres[name]
        at = ((m[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        one = (at[:, None] == np.arange(len(c))).astype(float)
        return np.concatenate([one.sum(axis=0), (one.T @ m).ravel(), (one.T @ (m * m)).ravel()])

    for step in range(iterations + 1):
        sums, out = summed_parts(rows, F.col("_l"), ["_x"], gathered), {}
        for name, v in sums.items():
            k, d = centres[name].shape
            n, s1, s2 = v[:k], v[k : k + k * d].reshape(k, d), v[k + k * d :].reshape(k, d)
            full, safe = n > 0, np.maximum(n, 1)[:, None]
            mean = np.where(full[:, None], s1 / safe, centres[name])
            whole = s2.sum(axis=0) / n.sum() - (s1.sum(axis=0) / n.sum()) ** 2
            var = np.clip(np.where(full[:, None] & (n[:, None] > 1), s2 / safe - mean * mean, whole), 1e-6, CLIP[1])
            out[name] = Mixture((n / n.sum()).tolist(), mean.tolist(), var.tolist())
            centres[name] = mean
    return out


def frame_scores(df: DataFrame, models: DataFrame, label: str, x: str, keep: list[str]) -> DataFrame:
    """(keep, model, score): the log density of each row under every class, a row a class."""
    rows = classify(df, models, keep, label, x)
    return rows.select(*keep, F.explode("scores").alias("_s")).select(*keep, F.col("_s.label").alias("model"), F.col("_s.score").alias("score"))


def speech_decision(classified: DataFrame, part: list[str], order: str, hyp: str, speech, length: int = 5) -> DataFrame:
    """(part, order, decision, smoothed): 1 where the class is ``speech``, else 0, and its running median."""
    from ..operators.segments import median_filter

    rows = classified.select(*part, order, (F.col(hyp) == speech).cast("int").alias("decision"))
    return median_filter(rows, part, order, "decision", length)


def noise_sweep(df: DataFrame, label: str, x: str, order: str, classes: int, tenths: list[int]) -> DataFrame:
    """(tenths, right, n, accuracy): classes learned from labels of which so many tenths are moved to the next class, judged by the true ones.

    ``order`` is an integer column that tells which labels are moved; labels are 0 .. classes - 1.
    """
    out = None
    for k in tenths:
        moved = F.when(F.col(order) % 10 < k, (F.col(label) + 1) % classes).otherwise(F.col(label))
        models = class_gaussians(df.withColumn("_noisy", moved), "_noisy", F.col(x)).withColumnRenamed("_noisy", label)
        rows = classify(df, models, [order], label, x)
        one = rows.agg(F.count_if(F.col("hyp") == F.col(label)).alias("right"), F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("tenths"), "right", "n", (F.col("right") / F.col("n")).alias("accuracy"))
        out = one if out is None else out.unionByName(one)
    return out


def posterior_columns(x: Column, model: Mixture) -> Column:
    """Responsibilities of a diagonal mixture as one array expression, inside the generated code."""
    parts = F.array(*(F.lit(math.log(w)) + log_density(x, doubles(m), doubles(c)) for w, m, c in zip(model.weights, model.means, model.covs)))
    top = F.array_max(parts)
    e = F.transform(parts, lambda p: F.exp(p - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, w: s + w))


def pairwise_distances(models: DataFrame, label: str) -> DataFrame:
    """Euclidean distances of the class means: min, max and mean over pairs (classes only)."""
    from ..functions.dsp import distance

    a, b = models.select(F.col(label).alias("a"), F.col("mean").alias("p")), models.select(F.col(label).alias("b"), F.col("mean").alias("q"))
    return a.join(b, F.col("a") < F.col("b")).select(distance(F.col("p"), F.col("q")).alias("d")).agg(F.min("d").alias("min"), F.max("d").alias("max"), F.avg("d").alias("mean"))
