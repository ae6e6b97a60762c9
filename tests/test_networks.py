"""Token passing and training over networks, against all paths and flat models."""

import itertools
import math
import random

import numpy as np
import pytest


def random_network(r, words=5, states=3):
    """Words of left-to-right states that meet in hubs without emission, with arcs that skip."""
    from framelake.models.networks import Network

    emits, arcs = [-1, -1, -1, -1], [(0, 2, 0.0), (2, 3, math.log(0.7))]  # start, end, hub, second hub
    column = 0
    for w in range(words):
        base = len(emits)
        n = r.randint(1, states)
        emits += [column + k for k in range(n)]
        column += n
        arcs.append((r.choice([2, 3]), base, math.log(r.uniform(0.1, 0.5))))
        for k in range(n):
            arcs.append((base + k, base + k, math.log(r.uniform(0.2, 0.8))))
            if k + 1 < n:
                arcs.append((base + k, base + k + 1, math.log(r.uniform(0.2, 0.8))))
            if k + 2 < n:
                arcs.append((base + k, base + k + 2, math.log(0.1)))
        arcs.append((base + n - 1, r.choice([2, 3]), math.log(r.uniform(0.1, 0.5))))
        if r.random() < 0.5:
            arcs.append((base + n - 1, 1, math.log(0.3)))
    arcs.append((3, 1, math.log(0.2)))
    r.shuffle(arcs)
    return Network(emits, *(list(v) for v in zip(*arcs)), 0, 1), column


def paths(net, frames):
    """(weights, emitting nodes, arcs) of every complete path of so many frames."""
    out = {}
    for a, s in enumerate(net.src):
        out.setdefault(int(s), []).append(a)
    todo = [(net.start, 0.0, (), ())]
    while todo:
        node, w, seen, used = todo.pop()
        if node == net.end and len(seen) == frames:
            yield w, seen, used
        for a in out.get(node, []):
            to = int(net.dst[a])
            more = net.emits[to] >= 0
            if len(seen) + more <= frames:
                todo.append((to, w + float(net.weight[a]), seen + (to,) * bool(more), used + (a,)))


@pytest.mark.parametrize("seed", range(6))
def test_tokens_find_the_best_of_all_paths_and_sums_are_over_all(seed):
    from framelake.models.networks import forward_backward, pass_tokens

    r = random.Random(seed)
    net, columns = random_network(r)
    emit = np.array([[r.uniform(-4, 0) for _ in range(columns)] for _ in range(6)])
    scored = [(w + sum(emit[t][net.emits[k]] for t, k in enumerate(seen)), seen, used) for w, seen, used in paths(net, 6)]
    assert len(scored) > 50
    best = max(s for s, _, _ in scored)
    score, path, counts = pass_tokens(net, emit)
    assert score == pytest.approx(best) and any(p == tuple(path) and s == pytest.approx(best) for s, p, _ in scored)
    assert len(counts) == 6 and max(counts) > 3
    total, posts, uses = forward_backward(net, emit)
    whole = np.logaddexp.reduce([s for s, _, _ in scored])
    assert total == pytest.approx(whole)
    want, used_want = np.zeros((6, len(net.emits))), np.zeros(len(net.src))
    for s, seen, used in scored:
        for t, k in enumerate(seen):
            want[t][k] += math.exp(s - whole)
        for a in used:
            used_want[a] += math.exp(s - whole)
    assert np.allclose(posts, want) and np.allclose(uses, used_want)


def test_tokens_equal_viterbi_on_the_flat_model():
    """A loop of words over many frames; arcs through the hub are multiplied out for the flat one."""
    from framelake.models.hidden import viterbi
    from framelake.models.networks import pass_tokens

    r = random.Random(9)
    net, columns = random_network(r, words=12, states=4)
    n = len(net.emits)
    quiet = np.full((n, n), -np.inf)  # best weight over nodes without emission
    loud = [k for k in range(n) if net.emits[k] >= 0]
    for s, d, w in zip(net.src, net.dst, net.weight):
        quiet[s, d] = max(quiet[s, d], w)
    for k in range(4):
        quiet = np.maximum(quiet, quiet[:, [k]] + quiet[[k], :])
    trans = quiet[np.ix_(loud, loud)]
    emit = np.random.default_rng(3).normal(-2, 2, (80, columns))
    flat = emit[:, [net.emits[k] for k in loud]]
    want, states = viterbi(quiet[0, loud], trans, quiet[loud, 1], flat)
    score, path, counts = pass_tokens(net, emit)
    assert score == pytest.approx(want) and path == [loud[s] for s in states]
    narrow = pass_tokens(net, emit, beam=8.0)
    assert narrow[0] == pytest.approx(want) and sum(narrow[2]) < 0.92 * sum(counts)  # tokens were dropped
    for most in (1, 3, 8):
        found, _, held = pass_tokens(net, emit, most=most)
        assert max(held) <= most and (found is None or found <= want + 1e-9)
    assert pass_tokens(net, emit, most=len(loud))[:2] == (score, path)


def test_histogram_pruning_keeps_the_best():
    from framelake.models.networks import _kept

    r = np.random.default_rng(1)
    for n in (5, 100, 1000):
        score = r.normal(size=n).round(1)  # ties
        for most in (1, 3, 50, 2000):
            kept = _kept(score, None, most)
            assert len(kept) == min(n, most) and 0 <= score[kept].min() - np.sort(score)[::-1][len(kept) - 1] < 1e-9
    assert _kept(np.zeros(10), None, 4).tolist() == [0, 1, 2, 3]
    assert _kept(np.array([0.0, -3, -1]), 2.0, None).tolist() == [0, 2]


def test_networks_that_cannot_be_passed():
    from framelake.models.networks import Network, forward_backward, pass_tokens

    with pytest.raises(ValueError, match="cycle"):
        Network([-1, -1, -1, -1, 0], [0, 1, 2, 4], [1, 2, 1, 3], [0.0] * 4, 0, 3)
    with pytest.raises(ValueError, match="without emission"):
        Network([0, -1], [0], [1], [0.0], 0, 1)
    net = Network([-1, 0, 0, -1], [0, 1, 2], [1, 2, 3], [0.0] * 3, 0, 3)
    assert pass_tokens(net, np.zeros((3, 1)))[0] is None and pass_tokens(net, np.zeros((1, 1)))[0] is None
    assert forward_backward(net, np.zeros((3, 1)))[0] == -np.inf
    assert pass_tokens(net, np.zeros((2, 1))) == (0.0, [1, 2], [1, 1])
    assert pass_tokens(net, np.full((2, 1), -np.inf))[0] is None


def models(r, d=2):
    from framelake.models.gaussian import Mixture
    from framelake.models.hidden import Hmm

    state = lambda: Mixture([0.4, 0.6], [[r.uniform(-2, 2) for _ in range(d)] for _ in range(2)], [[r.uniform(0.5, 2) for _ in range(d)] for _ in range(2)])
    return {"x": Hmm([0.7, 0.3], [[0.5, 0.4], [0.0, 0.8]], [0.1, 0.2], [state(), state()]), "y": Hmm([1.0], [[0.6]], [0.4], [state()]), "unused": Hmm([1.0], [[0.6]], [0.4], [state()])}


LATTICE = [(0, 1, "x", 0.6), (0, 1, "y", 0.4), (1, 2, "y", 0.5), (1, 2, None, 0.3), (1, 3, "x", 0.2), (2, 3, "y", 0.9), (2, 3, None, 0.1)]


def test_lattice_sums_equal_those_over_all_paths():
    """Word sequences times state sequences, each weighed by its likelihood."""
    from framelake.models.networks import _lattice_sums, lattice_network

    r = random.Random(5)
    hmms = models(r)
    m = np.random.default_rng(2).normal(size=(5, 2))
    total, sums = _lattice_sums(LATTICE, hmms, m, 0, 3)
    net, columns, tags = lattice_network(LATTICE, hmms, 0, 3)
    emit = np.array([hmms[k].states[s].log_prob(m) for k, s in columns]).T
    scored = [(w + sum(emit[t][net.emits[k]] for t, k in enumerate(seen)), seen, used) for w, seen, used in paths(net, 5)]
    whole = np.logaddexp.reduce([s for s, _, _ in scored])
    assert total == pytest.approx(whole)
    for name in ("x", "y"):
        k = len(hmms[name].states)
        first, last, xi, occ = np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros((5, k))
        for s, seen, used in scored:
            p = math.exp(s - whole)
            for a in used:
                model, kind, i, j = tags[a]
                if model == name:
                    first[i] += p * (kind == 1)
                    xi[i, j] += p * (kind == 2)
                    last[i] += p * (kind == 3)
            for t, node in enumerate(seen):
                model, state = columns[net.emits[node]]
                if model == name:
                    occ[t, state] += p
        v = sums[name]
        assert np.allclose(v[2 : 2 + k], first) and np.allclose(v[2 + k : 2 + 2 * k], last) and np.allclose(v[2 + 2 * k : 2 + 2 * k + k * k], xi.ravel())
        got, at = [], 2 + 2 * k + k * k
        for _ in range(k):
            got.append(v[at : at + 2].sum())
            at += 2 + 2 * 2 * 2
        assert np.allclose(got, occ.sum(axis=0)) and v[1] == pytest.approx(occ.sum())
    assert set(sums) == {"x", "y"}


def test_training_on_lattices_never_lowers_the_likelihood(spark):
    from framelake.models.networks import lattice_scores, train_on_lattices

    r, g = random.Random(8), np.random.default_rng(7)
    hmms = models(r)
    rows = [(u, t, g.normal(r.choice([-1, 1]), 1, 2).tolist()) for u in range(12) for t in range(r.randint(4, 9))] + [(90, 0, [0.0, 0.0]), (91, 0, [0.0, 0.0])]
    lattices = [(u, *a) for u in range(12) for a in LATTICE[: 7 if u % 2 else 6]] + [(91, 0, 1, "x", 1.0), (91, 1, 2, "x", 1.0), (91, 2, 3, "x", 1.0), (92, *LATTICE[0])]
    df = spark.createDataFrame(rows, "u int, t int, x array<double>")
    arcs = spark.createDataFrame(lattices, "u int, src long, dst long, model string, prob double")
    scores = {r["u"]: r["score"] for r in lattice_scores(df, arcs, ["u"], "t", "x", hmms, 0, 3).collect()}
    assert set(scores) == {*range(12), 91} and scores[91] == -math.inf  # no path of one frame
    new, trace = train_on_lattices(df, arcs, ["u"], "t", "x", hmms, 0, 3, iterations=5)
    assert trace[0] == pytest.approx(sum(v for k, v in scores.items() if k < 90))
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(trace)) and trace[-1] > trace[0] + 1
    assert new["unused"] is hmms["unused"] and new["x"].start != hmms["x"].start
    for h in (new["x"], new["y"]):
        assert np.allclose(np.sum(h.trans, axis=1) + h.stop, 1)


def test_network_tables_and_decoded_utterances(spark):
    from framelake.models.gaussian import Mixture
    from framelake.models.networks import decode_network, network_from_tables, pass_tokens

    nodes = spark.createDataFrame([(10, None), (20, "a"), (30, "b"), (40, None), (50, None)], "node long, model string")
    arcs = spark.createDataFrame([(10, 40, 0.0), (40, 20, -1.0), (40, 30, -1.0), (20, 20, -0.5), (30, 30, -0.5), (20, 40, -1.0), (30, 40, -1.0), (40, 50, 0.0)], "src long, dst long, weight double")
    net, names = network_from_tables(nodes, arcs, 10, 50, ["b", "a"])
    with pytest.raises(ValueError, match="more than 3"):
        network_from_tables(nodes, arcs, 10, 50, ["b", "a"], most=3)
    mixtures = [Mixture([1.0], [[1.0]], [[0.5]]), Mixture([1.0], [[-1.0]], [[0.5]])]
    g = np.random.default_rng(0)
    rows = [(u, t, [float(g.normal([1, -1][t // 4 % 2], 0.6))]) for u in range(5) for t in range(12)]
    df = spark.createDataFrame(rows[::-1], "u int, t int, x array<double>")
    got = {(r["u"], r["t"]): r for r in decode_network(df, ["u"], "t", "x", net, mixtures, names, beam=20.0, most=2).collect()}
    for u in range(5):
        m = np.array([x for v, _, x in rows if v == u])
        score, path, counts = pass_tokens(net, np.array([s.log_prob(m) for s in mixtures]).T, 20.0, 2)
        assert [got[u, t]["node"] for t in range(12)] == [names[k] for k in path] and got[u, 0]["score"] == pytest.approx(score)
        assert [got[u, t]["tokens"] for t in range(12)] == counts
    dead = network_from_tables(nodes, arcs.where("src <> 40 or dst <> 50"), 10, 50, ["b", "a"])[0]
    assert all(r["node"] is None and r["score"] is None for r in decode_network(df, ["u"], "t", "x", dead, mixtures).collect())


def test_utterances_without_a_model_are_left_out(spark):
    from framelake.models.hidden import accumulate

    r = random.Random(1)
    df = spark.createDataFrame([(u, t, [0.5 * u, 0.1 * t], "x" if u else "other") for u in range(3) for t in range(4)], "u int, t int, x array<double>, label string")
    found = accumulate(df, ["u"], "t", "x", {"x": models(r)["x"]}, "label")
    assert list(found) == ["x"] and found["x"][1] == 8


def test_exact_beams_find_what_they_would_lose():
    from framelake.models.networks import pass_tokens

    lost = 0
    for seed in range(12):
        net, columns = random_network(random.Random(seed), words=8, states=3)
        emit = np.random.default_rng(seed).normal(-2, 2, (40, columns))
        want = pass_tokens(net, emit)[:2]
        for beam, most in ((2.0, None), (None, 2), (6.0, 3), (60.0, None)):
            assert pass_tokens(net, emit, beam, most, exact=True)[:2] == want
            lost += pass_tokens(net, emit, beam, most)[:2] != want
    assert lost > 5


def test_beam_query_finds_the_best_way(spark, tmp_path):
    """Noisy utterances, of some of which the two best tokens of a frame are not those of the best way."""
    import __spark_entry__ as e

    x = np.random.default_rng(5).normal(0, 0.125, (6000, 64))
    rows = [(k, [float(v) for v in row], 0) for k, row in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    way = {name: sorted(map(tuple, e.queries()[name](spark, str(tmp_path)).collect())) for name in ("m27_network", "m27_network_beam")}
    assert way["m27_network"] == way["m27_network_beam"] and len(way["m27_network"]) == 6000
