"""Models with latent spaces: low-rank mixtures, topographic mapping, and mixture density networks.

Every training step is one aggregation whose rows are model-sized sums; the
algebra on those is done on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toolbox import _sums


def _log_sum(parts):
    import numpy as np

    top = parts.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(parts - top).sum(axis=1, keepdims=True))).ravel()


# ---- mixtures of low-rank Gaussians ----------------------------------------------------------


@dataclass
class LowRankMixture:
    """Components of covariance ``noise * I + factors @ factors.T``; weights (k), means (k, d), factors (k, d, q), noise (k)."""

    weights: object
    means: object
    factors: object
    noise: object

    def log_parts(self, x):
        """(rows, components) log of weight times density; only q by q matrices are inverted."""
        import numpy as np

        x, out = np.atleast_2d(np.asarray(x, float)), []
        d = x.shape[1]
        for w, m, f, s in zip(self.weights, self.means, self.factors, self.noise):
            z, small = x - m, s * np.eye(f.shape[1]) + f.T @ f
            y = z @ f
            quad = ((z * z).sum(axis=1) - (y * np.linalg.solve(small, y.T).T).sum(axis=1)) / s
            logdet = (d - f.shape[1]) * math.log(s) + np.linalg.slogdet(small)[1]
            out.append((math.log(w) if w > 0 else -math.inf) - 0.5 * (quad + logdet + d * math.log(2 * math.pi)))
        return np.array(out).T

    def log_prob(self, x):
        return _log_sum(self.log_parts(x))

    def posteriors(self, x):
        import numpy as np

        parts = self.log_parts(x)
        return np.exp(parts - _log_sum(parts)[:, None])


def low_rank_step(df: DataFrame, x: str, model: LowRankMixture, floor: float = 1e-6) -> tuple[LowRankMixture, float]:
    """One step of all components: (new mixture, log likelihood before). A component's sums are d by q, never d by d."""
    import numpy as np

    k, d, q = np.shape(model.factors)

    def part(m):
        p = model.posteriors(m)
        held = [[len(m), model.log_prob(m).sum()]]
        for j in range(k):
            r = p[:, j]
            y = m @ model.factors[j]
            held += [[r.sum(), r @ (m * m).sum(axis=1)], r @ m, (m.T @ (r[:, None] * y)).ravel()]
        return np.concatenate([np.asarray(v, float) for v in held])

    v = _sums(df, [x], part)
    n, loglik, rows = v[0], v[1], v[2:].reshape(k, -1)
    weights, means, factors, noise = [], [], [], []
    for j in range(k):
        occ, square, first, second = rows[j, 0], rows[j, 1], rows[j, 2 : 2 + d], rows[j, 2 + d :].reshape(d, q)
        weights.append(occ / n)
        if occ < 1e-8:
            for held, old in ((means, model.means), (factors, model.factors), (noise, model.noise)):
                held.append(old[j])
            continue
        mean, f, s = first / occ, np.asarray(model.factors[j]), model.noise[j]
        spread = second / occ - np.outer(mean, mean @ f)  # the covariance times the factors
        small = np.linalg.inv(s * np.eye(q) + f.T @ f)
        new = spread @ np.linalg.inv(s * np.eye(q) + small @ f.T @ spread)
        left = (square / occ - mean @ mean - np.trace(spread @ small @ new.T)) / d
        means.append(mean)
        factors.append(new)
        noise.append(max(float(left), floor))
    return LowRankMixture(np.array(weights), np.array(means), np.array(factors), np.array(noise)), float(loglik)


def fit_low_rank(df: DataFrame, x: str, size: int, rank: int, iterations: int = 10, seed: int = 0) -> tuple[LowRankMixture, list[float]]:
    """A mixture of ``size`` components of ``rank`` factors, from seeded directions about the mean: (mixture, log likelihood before each step)."""
    import numpy as np

    moments = _sums(df, [x], lambda m: np.concatenate([[len(m)], m.sum(axis=0), (m * m).sum(axis=0)]))
    d = (len(moments) - 1) // 2
    mean, var = moments[1 : 1 + d] / moments[0], moments[1 + d :] / moments[0]
    var = np.maximum(var - mean * mean, 1e-6)
    r = np.random.default_rng(seed)
    model = LowRankMixture(np.full(size, 1 / size), mean + r.standard_normal((size, d)) * np.sqrt(var), r.standard_normal((size, d, rank)) * np.sqrt(var)[:, None] / math.sqrt(rank), np.full(size, float(var.mean())))
    trace = []
    for _ in range(iterations):
        model, loglik = low_rank_step(df, x, model)
        trace.append(loglik)
    return model, trace


# ---- generative topographic mapping ----------------------------------------------------------


@dataclass
class Topographic:
    """A latent grid (k, l) mapped by basis functions (k, m) and weights (m, d) to centres that share one precision."""

    grid: object
    basis: object
    weights: object
    precision: float

    @property
    def centres(self):
        return self.basis @ self.weights

    def log_parts(self, x):
        import numpy as np

        c = self.centres
        square = (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)
        d = x.shape[1]
        return -0.5 * self.precision * np.maximum(square, 0) + 0.5 * d * math.log(self.precision / (2 * math.pi)) - math.log(len(c))

    def log_prob(self, x):
        return _log_sum(self.log_parts(x))

    def posteriors(self, x):
        import numpy as np

        parts = self.log_parts(x)
        return np.exp(parts - _log_sum(parts)[:, None])


def square_grid(side: int, dims: int):
    """Points of a regular grid over -1 to 1 in each of ``dims`` dimensions."""
    import numpy as np

    return np.stack(np.meshgrid(*[np.linspace(-1, 1, side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)


def topographic_start(df: DataFrame, x: str, side: int = 8, basis: int = 3, dims: int = 2) -> Topographic:
    """A mapping whose centres lie on the plane of the first principal components."""
    import numpy as np

    d = len(df.select(x).first()[0])
    v = _sums(df, [x], lambda m: np.concatenate([[len(m)], m.sum(axis=0), (m.T @ m).ravel()]))
    mean = v[1 : 1 + d] / v[0]
    values, vectors = np.linalg.eigh(v[1 + d :].reshape(d, d) / v[0] - np.outer(mean, mean))
    grid, at = square_grid(side, dims), square_grid(basis, dims)
    width = 2 / max(basis - 1, 1)
    phi = np.exp(-((grid[:, None] - at) ** 2).sum(axis=2) / (2 * width * width))
    phi = np.c_[phi, np.ones(len(grid))]
    plane = grid / grid.std(axis=0) @ (np.sqrt(np.maximum(values[-dims:], 0))[:, None] * vectors[:, -dims:].T)
    weights = np.linalg.lstsq(phi, plane, rcond=None)[0]
    weights[-1] += mean
    rest = values[-dims - 1] if d > dims else 0.0
    apart = min(((plane[i] - plane[j]) ** 2).sum() for i, j in ((0, 1), (0, side) if dims > 1 else (0, 1))) / 4
    return Topographic(grid, phi, weights, 1 / max(rest, apart, 1e-6))


def topographic_step(df: DataFrame, x: str, model: Topographic, ridge: float = 0.0) -> tuple[Topographic, float]:
    """One step: (new mapping, log likelihood before). What rows give is a number and a sum for each point of the grid."""
    import numpy as np

    def part(m):
        p = model.posteriors(m)
        return np.concatenate([[len(m), model.log_prob(m).sum(), (m * m).sum()], p.sum(axis=0), (p.T @ m).ravel()])

    v = _sums(df, [x], part)
    k, d = len(model.grid), model.weights.shape[1]
    n, loglik, square, occ, first = v[0], v[1], v[2], v[3 : 3 + k], v[3 + k :].reshape(k, d)
    phi = model.basis
    keep = np.eye(phi.shape[1]) * ridge / model.precision
    keep[-1, -1] = 0.0
    weights = np.linalg.lstsq(phi.T @ (occ[:, None] * phi) + keep, phi.T @ first, rcond=None)[0]
    c = phi @ weights
    left = square - 2 * (first * c).sum() + occ @ (c * c).sum(axis=1)
    return Topographic(model.grid, phi, weights, n * d / max(left, 1e-12)), float(loglik)


def fit_topographic(df: DataFrame, x: str, iterations: int = 10, ridge: float = 0.0, **start) -> tuple[Topographic, list[float]]:
    model, trace = topographic_start(df, x, **start), []
    for _ in range(iterations):
        model, loglik = topographic_step(df, x, model, ridge)
        trace.append(loglik)
    return model, trace


def latent_places(df: DataFrame, x: str, model: Topographic) -> DataFrame:
    """``df`` with ``mean``, the mean place of each row in the latent space, and ``mode``, the likeliest point of the grid."""

    def place(batches):
        import numpy as np
        import pandas as pd

        for m in batches:
            p = model.posteriors(np.array(m.tolist(), float)) if len(m) else np.zeros((0, len(model.grid)))
            yield pd.DataFrame({"mean": (p @ model.grid).tolist(), "mode": model.grid[p.argmax(axis=1)].tolist()})

    from collections.abc import Iterator

    import pandas as pd

    place.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    found = F.pandas_udf(place, "mean array<double>, mode array<double>")
    return df.withColumn("_place", found(x)).select("*", "_place.mean", "_place.mode").drop("_place")


# ---- scaled conjugate gradients and mixture density networks ---------------------------------


def conjugate_gradients(error, start, iterations: int = 20):
    """Scaled conjugate gradients: (weights, errors after each step, never rising).

    ``error(w)`` gives the error and its gradient, in one pass over the data; a
    step takes two such passes: one for the curvature along the direction and
    one at the new weights.
    """
    import numpy as np

    w = np.asarray(start, float)
    now, g = error(w)
    way, trust, since, trace = -g, 1.0, 0, [float(now)]
    for _ in range(iterations):
        slope = way @ g
        if slope >= 0:
            way, slope = -g, -(g @ g)
        size = way @ way
        if size < 1e-20:
            break
        small = 1e-5 / math.sqrt(size)
        curve = way @ (error(w + small * way)[1] - g) / small
        bent = curve + trust * size
        if bent <= 0:  # not convex here: trust less
            bent, trust = trust * size, trust - curve / size
        step = -slope / bent
        there, h = error(w + step * way)
        gain = 2 * (there - now) / (step * slope)
        if there <= now:
            w, old, since = w + step * way, g, since + 1
            now, g = there, h
            if since == len(w):  # begin anew
                way, trust, since = -g, 1.0, 0
            else:
                way = -g + max(0.0, (g @ g - g @ old) / max(old @ old, 1e-300)) * way
        trace.append(float(now))
        if gain < 0.25:
            trust = min(4 * trust, 1e100)
        elif gain > 0.75:
            trust = max(0.5 * trust, 1e-15)
    return w, trace


@dataclass
class DensityNetwork:
    """A network of one hidden layer whose outputs are, for each input, a mixture of ``size`` spherical Gaussians over ``d`` targets."""

    inputs: int
    hidden: int
    size: int
    d: int

    @property
    def shapes(self):
        out = self.size * (2 + self.d)
        return [(self.inputs + 1, self.hidden), (self.hidden + 1, out)]

    def start(self, seed: int = 0, centres=None):
        """Seeded weights; ``centres`` (size, d) are the means at first."""
        import numpy as np

        r, layers = np.random.default_rng(seed), []
        for a, b in self.shapes:
            layers.append(r.standard_normal((a, b)) / math.sqrt(a))
        if centres is not None:
            layers[1][-1, self.size : self.size * (1 + self.d)] = np.ravel(centres)
        return np.concatenate([m.ravel() for m in layers])

    def _parts(self, w, x):
        import numpy as np

        a, b = self.shapes
        one, two = w[: a[0] * a[1]].reshape(a), w[a[0] * a[1] :].reshape(b)
        h = np.tanh(np.c_[x, np.ones(len(x))] @ one)
        out = np.c_[h, np.ones(len(h))] @ two
        k = self.size
        logits, centres, logvar = out[:, :k], out[:, k : k * (1 + self.d)].reshape(len(x), k, self.d), out[:, k * (1 + self.d) :]
        logits = logits - _log_sum(logits)[:, None]
        return one, two, h, logits, centres, logvar

    def mixture(self, w, x):
        """(weights, centres, variances) of each row of x."""
        import numpy as np

        *_, logits, centres, logvar = self._parts(w, x)
        return np.exp(logits), centres, np.exp(logvar)

    def error(self, w, x, t):
        """(summed negative log likelihood, its gradient) of rows."""
        import numpy as np

        one, two, h, logits, centres, logvar = self._parts(w, x)
        z = t[:, None, :] - centres
        square = (z * z).sum(axis=2)
        parts = logits - 0.5 * (square * np.exp(-logvar) + self.d * (logvar + math.log(2 * math.pi)))
        total = _log_sum(parts)
        p = np.exp(parts - total[:, None])
        d_logits = np.exp(logits) - p
        d_centres = -(p * np.exp(-logvar))[:, :, None] * z
        d_logvar = -0.5 * p * (square * np.exp(-logvar) - self.d)
        out = np.concatenate([d_logits, d_centres.reshape(len(x), -1), d_logvar], axis=1)
        back = (out @ two[:-1].T) * (1 - h * h)
        return -total.sum(), np.concatenate([(np.c_[x, np.ones(len(x))].T @ back).ravel(), (np.c_[h, np.ones(len(h))].T @ out).ravel()])


def fit_density_network(df: DataFrame, x: str, y: str, net: DensityNetwork, iterations: int = 10, seed: int = 0):
    """Weights after steps of scaled conjugate gradients and the mean error after each; targets are arrays. A gradient is one aggregation."""
    import numpy as np

    def error(w):
        def part(m, t):
            e, g = net.error(w, m, t)
            return np.concatenate([[len(m), e], g])

        v = _sums(df, [x, y], part)
        return v[1] / v[0], v[2:] / v[0]

    v = _sums(df, [y], lambda t: np.concatenate([[len(t)], t.sum(axis=0), (t * t).sum(axis=0)]))
    mean = v[1 : 1 + net.d] / v[0]
    dev = np.sqrt(np.maximum(v[1 + net.d :] / v[0] - mean * mean, 1e-12))
    spread = np.linspace(-1, 1, net.size)[:, None] if net.size > 1 else np.zeros((1, 1))
    return conjugate_gradients(error, net.start(seed, mean + spread * dev), iterations)
