"""Hidden Markov models: forward-backward, Viterbi and embedded training, one utterance a group."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gaussian import Mixture


@dataclass
class Hmm:
    """start: probabilities; trans: rows from, columns to; stop: leaving probabilities; states: one mixture each."""

    start: list[float]
    trans: list[list[float]]
    stop: list[float]
    states: list[Mixture]

    def logs(self):
        import numpy as np

        with np.errstate(divide="ignore"):
            return np.log(self.start), np.log(self.trans), np.log(self.stop)

    def emissions(self, x):
        import numpy as np

        return np.array([s.log_prob(x) for s in self.states]).T


def _lse(x, axis):
    import numpy as np

    top = x.max(axis=axis, keepdims=True)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return (safe + np.log(np.exp(x - safe).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(hmm: Hmm, emit):
    """(log likelihood, state posteriors, summed transition posteriors) of one utterance."""
    import numpy as np

    start, trans, stop = hmm.logs()
    n, k = emit.shape
    a, b = np.empty((n, k)), np.empty((n, k))
    a[0] = start + emit[0]
    for t in range(1, n):
        a[t] = _lse(a[t - 1][:, None] + trans, 0) + emit[t]
    b[-1] = stop
    for t in range(n - 2, -1, -1):
        b[t] = _lse(trans + (emit[t + 1] + b[t + 1])[None, :], 1)
    total = float(_lse(a[-1] + stop, 0))
    post = np.exp(a + b - total)
    xi = np.zeros((k, k))
    for t in range(n - 1):
        xi += np.exp(a[t][:, None] + trans + (emit[t + 1] + b[t + 1])[None, :] - total)
    return total, post, xi


def viterbi(start, trans, stop, emit):
    """(score, path) in the log domain; ties to the smaller state."""
    import numpy as np

    n, k = emit.shape
    score, back = start + emit[0], np.zeros((n, k), int)
    for t in range(1, n):
        step = score[:, None] + trans
        back[t] = step.argmax(axis=0)
        score = step.max(axis=0) + emit[t]
    score = score + stop
    path = [int(score.argmax())]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t][path[-1]]))
    return float(score.max()), path[::-1]


def beam_decode(start, trans, stop, emit, beam: float):
    """Frame-synchronous token passing: tokens more than ``beam`` below the best are dropped at each frame."""
    import numpy as np

    k = emit.shape[1]
    tokens = {s: (start[s] + emit[0][s], (s,)) for s in range(k) if np.isfinite(start[s])}
    for t in range(1, len(emit)):
        best = max(v for v, _ in tokens.values())
        new: dict = {}
        for s, (v, path) in sorted(tokens.items()):
            if v >= best - beam:
                for r in range(k):
                    w = v + trans[s][r] + emit[t][r]
                    if np.isfinite(w) and (r not in new or w > new[r][0]):
                        new[r] = (w, (*path, r))
        tokens = new
    return max((v + stop[s], p) for s, (v, p) in tokens.items())


def decode_utterances(df: DataFrame, part: list[str], order: str, x: str, hmm: Hmm, beam: float | None = None) -> DataFrame:
    """The best state of each frame: part, order, state, utterance score. An utterance is one group."""
    kinds = dict(df.dtypes)

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values(order)
        emit = hmm.emissions(np.array(pdf[x].tolist(), float))
        start, trans, stop = hmm.logs()
        score, path = viterbi(start, trans, stop, emit) if beam is None else beam_decode(start, trans, stop, emit, beam)
        return pdf[[*part, order]].assign(state=path, score=score)

    return df.select(*part, order, x).groupBy(*part).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*part, order]) + ", state int, score double")


def empty_frame(schema: str):
    """An empty frame with the columns of a schema."""
    import numpy as np
    import pandas as pd

    kinds = {"long": "int64", "bigint": "int64", "int": "int32", "double": "float64"}
    return pd.DataFrame({c: np.zeros(0, kinds.get(k, "object")) for c, k in (x.split(" ") for x in schema.split(", "))})


def _gather(hmm: Hmm, m):
    """Accumulators of one utterance as a vector; None if it has no likelihood."""
    import numpy as np

    total, post, xi = forward_backward(hmm, hmm.emissions(m))
    if not np.isfinite(total):
        return None
    acc = [[total, len(m)], post[0], post[-1], xi.ravel()]
    for s, state in enumerate(hmm.states):
        g = state.posteriors(m) * post[:, s][:, None]
        acc += [g.sum(axis=0), (g.T @ m).ravel(), (g.T @ (m * m)).ravel()]
    return np.concatenate([np.asarray(a, float) for a in acc])


def _updated(hmm: Hmm, v) -> Hmm:
    """The model of the summed accumulators."""
    import numpy as np

    k, at = len(hmm.states), 2
    first, last, xi = v[at : at + k], v[at + k : at + 2 * k], v[at + 2 * k : at + 2 * k + k * k].reshape(k, k)
    at += 2 * k + k * k
    out = xi.sum(axis=1) + last
    safe = np.maximum(out, 1e-300)
    states = []
    for s in hmm.states:
        c, d = s.size, len(s.means[0])
        occ = v[at : at + c]
        s1, s2 = v[at + c : at + c + c * d].reshape(c, d), v[at + c + c * d : at + c + 2 * c * d].reshape(c, d)
        at += c + 2 * c * d
        w = np.maximum(occ, 1e-10)[:, None]
        mean = np.where(occ[:, None] > 1e-8, s1 / w, np.array(s.means))
        var = np.where(occ[:, None] > 1e-8, np.maximum(s2 / w - mean * mean, 1e-6), np.array(s.covs))
        states.append(Mixture((occ / max(occ.sum(), 1e-10)).tolist(), mean.tolist(), var.tolist()))
    return Hmm((first / first.sum()).tolist(), (xi / safe[:, None]).tolist(), (last / safe).tolist(), states)


def accumulate(df: DataFrame, part: list[str], order: str, x: str, hmms: dict[str, Hmm], label: str | None = None) -> dict[str, object]:
    """label -> summed accumulators, each utterance (a group) under the model of its label; one pass of all classes."""
    import numpy as np

    of = F.lit(next(iter(hmms))) if label is None else F.col(label).cast("string")

    def run(pdf):
        import numpy as np
        import pandas as pd

        name = pdf["_label"].iloc[0]
        v = _gather(hmms[name], np.array(pdf.sort_values(order)[x].tolist(), float)) if name in hmms else None
        return empty_frame("label string, i long, v double") if v is None else pd.DataFrame({"label": name, "i": np.arange(len(v)), "v": v})

    parts = df.select(*part, order, x, of.alias("_label")).where("_label is not null").groupBy(*part, "_label").applyInPandas(run, "label string, i long, v double")
    out: dict = {}
    for r in parts.groupBy("label", "i").agg(F.sum("v").alias("v")).orderBy("label", "i").collect():  # models' sizes
        out.setdefault(r["label"], []).append(r["v"])
    return {k: np.array(v) for k, v in out.items()}


def train_step(df: DataFrame, part: list[str], order: str, x: str, hmm: Hmm) -> tuple[Hmm, float]:
    """One Baum-Welch step: each utterance returns its accumulators, Spark sums them."""
    v = accumulate(df, part, order, x, {"": hmm})[""]
    return _updated(hmm, v), float(v[0])


class HmmSet:
    """Named hidden Markov models that are trained together and classify utterances.

    Training goes begin, accumulate over any number of tables, apply; a call out of that order raises.
    """

    def __init__(self, hmms: dict[str, Hmm]):
        self.hmms, self.state, self.held = dict(hmms), "idle", {}

    def _need(self, state: str):
        if self.state != state:
            raise RuntimeError(f"the set is {self.state}, not {state}")

    def begin(self):
        self._need("idle")
        self.state, self.held = "accumulating", {}

    def accumulate(self, df: DataFrame, part: list[str], order: str, x: str, label: str):
        self._need("accumulating")
        for k, v in accumulate(df, part, order, x, self.hmms, label).items():
            self.held[k] = self.held[k] + v if k in self.held else v

    def apply(self) -> dict[str, float]:
        """New models from the sums; the log likelihood of each class before."""
        self._need("accumulating")
        self.hmms.update({k: _updated(self.hmms[k], v) for k, v in self.held.items()})
        self.state = "idle"
        return {k: float(v[0]) for k, v in self.held.items()}

    def train(self, df: DataFrame, part: list[str], order: str, x: str, label: str, iterations: int = 1) -> list[dict[str, float]]:
        trace = []
        for _ in range(iterations):
            self.begin()
            self.accumulate(df, part, order, x, label)
            trace.append(self.apply())
        return trace

    def classify(self, df: DataFrame, part: list[str], order: str, x: str) -> DataFrame:
        """(part, hyp, score, scores) of each utterance: the label of largest likelihood, ties to the smaller, and all in order."""
        self._need("idle")
        hmms, names, kinds = self.hmms, sorted(self.hmms), dict(df.dtypes)

        def run(pdf):
            import numpy as np

            m = np.array(pdf.sort_values(order)[x].tolist(), float)
            score = [forward_backward(hmms[k], hmms[k].emissions(m))[0] for k in names]
            best = int(np.argmax(score))
            return pdf[part].head(1).assign(hyp=names[best], score=score[best], scores=[score])

        return df.select(*part, order, x).groupBy(*part).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in part) + ", hyp string, score double, scores array<double>")


def train_classes(df: DataFrame, part: list[str], order: str, x: str, label: str, states: int, size: int, iterations: int = 2) -> HmmSet:
    """An ergodic model of ``states`` states for each class, its mixtures doubled 2, 4, 8, ... up to ``size``, all classes in one pass a step.

    States start from the clusters of the class's rows.
    """
    from .gaussian import initial_classes

    df = df.select(*part, order, x, label).persist()
    try:
        starts = initial_classes(df, label, x, states)
        found = HmmSet({k: ergodic([Mixture([1.0], [m.means[i]], [m.covs[i]]) for i in range(m.size)]) for k, m in starts.items()})
        found.train(df, part, order, x, label, iterations)
        have = 1
        while have < size:
            have = min(2 * have, size)
            found.hmms = {k: Hmm(h.start, h.trans, h.stop, [s.split(have) for s in h.states]) for k, h in found.hmms.items()}
            found.train(df, part, order, x, label, iterations)
    finally:
        df.unpersist()
    return found


def ergodic(states: list[Mixture], stay: float = 0.9) -> Hmm:
    """Every state follows every other; ``stay`` is the self-loop's share."""
    k = len(states)
    move = (1 - stay) / k
    return Hmm([1 / k] * k, [[stay if i == j else move for j in range(k)] for i in range(k)], [move] * k, states)


def ngram_viterbi(df: DataFrame, part: list[str], order: str, costs: str, labels: list[str], lm: dict[str, tuple[float, float]], n: int, use_lm: bool = True) -> DataFrame:
    """Least-cost label path of per-frame costs plus n-gram costs; a state is a history of n - 1 labels."""
    from .language import cost

    kinds = dict(df.dtypes)

    def run(pdf):
        pdf = pdf.sort_values(order)
        best, back = {(): 0.0}, []
        for row in pdf[costs]:
            new: dict = {}
            for h, v in sorted(best.items()):
                for k, name in enumerate(labels):
                    w = v + row[k] + (cost(lm, list(h), name) if use_lm else 0.0)
                    to = (*h, name)[-(n - 1) :] if n > 1 else ()
                    if to not in new or w < new[to][0]:
                        new[to] = (w, h, k)
            best = {to: w for to, (w, _, _) in new.items()}
            back.append({to: (h, k) for to, (_, h, k) in new.items()})
        v, at = min((w, to) for to, w in best.items())
        path = []
        for step in reversed(back):  # from each history to the one before
            at, k = step[at]
            path.append(k)
        path.reverse()
        return pdf[[*part, order]].assign(label=[labels[k] for k in path], cost=v)

    return df.select(*part, order, costs).groupBy(*part).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*part, order]) + ", label string, cost double")
