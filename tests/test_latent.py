"""Low-rank mixtures, topographic mapping and density networks against dense algebra and finite differences."""

import itertools

import numpy as np
import pytest


def vectors(spark, m, **more):
    rows = [(i, [float(v) for v in x], *(y[i] for y in more.values())) for i, x in enumerate(m)]
    return spark.createDataFrame(rows, ["i", "x", *more]).repartition(3)


def low_rank(r, k=3, d=6, q=2):
    from framelake.models.latent import LowRankMixture

    w = r.uniform(0.5, 1, k)
    return LowRankMixture(w / w.sum(), r.normal(size=(k, d)) * 3, r.normal(size=(k, d, q)), r.uniform(0.2, 0.6, k))


def test_low_rank_densities_are_those_of_the_full_covariance():
    from framelake.models.gaussian import Mixture
    from framelake.models.latent import LowRankMixture

    r = np.random.default_rng(1)
    for d, q in ((6, 2), (3, 3), (5, 0), (4, 6)):
        m = low_rank(r, 3, d, q)
        covs = [s * np.eye(d) + f @ f.T for s, f in zip(m.noise, m.factors)]
        full = Mixture(m.weights.tolist(), m.means.tolist(), [c.tolist() for c in covs], "full")
        x = r.normal(size=(50, d)) * 4
        assert np.allclose(m.log_parts(x), full.log_parts(x)) and np.allclose(m.posteriors(x).sum(axis=1), 1)
    assert np.isneginf(LowRankMixture([0.0], m.means[:1], m.factors[:1], m.noise[:1]).log_parts(x)).all()


def test_low_rank_training(spark):
    from framelake.models.latent import fit_low_rank, low_rank_step

    r = np.random.default_rng(2)
    true = low_rank(r, 2, 6, 2)
    at = r.choice(2, 600)
    x = true.means[at] + np.einsum("ndq,nq->nd", true.factors[at], r.normal(size=(600, 2))) + r.normal(size=(600, 6)) * np.sqrt(true.noise[at])[:, None]
    df = vectors(spark, x)
    model, trace = fit_low_rank(df, "x", 2, 2, iterations=12)
    assert trace[0] < trace[-1] and all(b >= a - 1e-6 for a, b in itertools.pairwise(trace))
    one, _ = fit_low_rank(df, "x", 1, 2, iterations=1)
    for _ in range(25):
        one, _ = low_rank_step(df, "x", one)
    values, vectors_ = np.linalg.eigh(np.cov(x.T, bias=True))  # where the steps end is known
    want = values[:-2].mean() * np.eye(6) + (vectors_[:, -2:] * (values[-2:] - values[:-2].mean())) @ vectors_[:, -2:].T
    assert np.allclose(one.noise[0] * np.eye(6) + one.factors[0] @ one.factors[0].T, want, atol=0.05 * values[-1])
    empty = low_rank(r, 2, 6, 2)
    empty.weights, empty.means = np.array([1.0, 0.0]), np.stack([x.mean(axis=0), np.full(6, 1e6)])
    after, _ = low_rank_step(df, "x", empty)
    assert (after.means[1] == empty.means[1]).all() and after.weights[1] == 0


def test_topographic_mapping(spark):
    from framelake.models.latent import fit_topographic, latent_places, topographic_step

    r = np.random.default_rng(3)
    u = r.uniform(-1, 1, (500, 2))
    x = np.c_[u, u[:, 0] ** 2, u[:, 0] * u[:, 1]] + r.normal(size=(500, 4)) * 0.05
    df = vectors(spark, x)
    model, trace = fit_topographic(df, "x", iterations=8)
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(trace)) and trace[-1] > trace[0] + 50
    # a step against dense sums
    p = model.posteriors(x)
    weights = np.linalg.lstsq(model.basis.T @ np.diag(p.sum(axis=0)) @ model.basis, model.basis.T @ p.T @ x, rcond=None)[0]
    apart = sum(p[n, k] * ((x[n] - (model.basis @ weights)[k]) ** 2).sum() for n in range(500) for k in range(64))
    after, loglik = topographic_step(df, "x", model)
    assert np.allclose(after.centres, model.basis @ weights) and after.precision == pytest.approx(2000 / apart) and loglik == pytest.approx(model.log_prob(x).sum())
    places = {row["i"]: row for row in latent_places(df, "x", after).collect()}
    q = after.posteriors(x)
    assert all(np.allclose(places[i]["mean"], q[i] @ after.grid) and np.allclose(places[i]["mode"], after.grid[q[i].argmax()]) for i in range(500))
    mean = np.array([places[i]["mean"] for i in range(500)])
    assert max(abs(np.corrcoef(mean[:, k], u[:, 0])[0, 1]) for k in range(2)) > 0.6  # the plane is found, perhaps turned


def test_gradients_of_density_networks_are_finite_differences():
    from framelake.models.latent import DensityNetwork

    r = np.random.default_rng(4)
    net = DensityNetwork(3, 4, 2, 2)
    w, x, t = net.start(1) + r.normal(size=len(net.start(1))) * 0.3, r.normal(size=(20, 3)), r.normal(size=(20, 2))
    error, g = net.error(w, x, t)
    for k in range(len(w)):
        step = np.zeros(len(w))
        step[k] = 1e-6
        assert (net.error(w + step, x, t)[0] - net.error(w - step, x, t)[0]) / 2e-6 == pytest.approx(g[k], abs=1e-4)
    weights, centres, variances = net.mixture(w, x)
    dens = (weights * np.exp(-((t[:, None] - centres) ** 2).sum(axis=2) / (2 * variances)) / (2 * np.pi * variances)).sum(axis=1)
    assert error == pytest.approx(-np.log(dens).sum())


def test_conjugate_gradients_find_a_minimum():
    from framelake.models.latent import conjugate_gradients

    r = np.random.default_rng(5)
    a = r.normal(size=(6, 6))
    a, b = a @ a.T + np.eye(6), r.normal(size=6)
    w, trace = conjugate_gradients(lambda w: (0.5 * w @ a @ w - b @ w, a @ w - b), np.zeros(6), 60)
    assert np.allclose(w, np.linalg.solve(a, b), atol=1e-4) and all(y <= x for x, y in itertools.pairwise(trace))
    rosen = lambda w: (100 * (w[1] - w[0] ** 2) ** 2 + (1 - w[0]) ** 2, np.array([-400 * w[0] * (w[1] - w[0] ** 2) - 2 * (1 - w[0]), 200 * (w[1] - w[0] ** 2)]))
    w, trace = conjugate_gradients(rosen, np.array([-1.0, 1.0]), 300)
    assert trace[-1] < 1e-4 and all(y <= x for x, y in itertools.pairwise(trace))


def test_density_network_learns_a_map_of_two_branches(spark):
    from framelake.models.latent import DensityNetwork, fit_density_network

    r = np.random.default_rng(6)
    x = r.uniform(-1, 1, 300)
    t = np.where(r.random(300) < 0.5, 1, -1) * (1.5 + x) + r.normal(size=300) * 0.1
    df = vectors(spark, x[:, None], y=[[float(v)] for v in t])
    net = DensityNetwork(1, 5, 2, 1)
    w, trace = fit_density_network(df, "x", "y", net, iterations=25)
    assert all(b <= a + 1e-12 for a, b in itertools.pairwise(trace)) and trace[-1] < trace[0] - 0.7
    weights, centres, _ = net.mixture(w, np.array([[0.5]]))
    assert sorted(np.sign(centres[0, :, 0])) == [-1, 1] and weights[0].min() > 0.2
