"""Networks of models: token passing over nodes with and without emission, and training on lattices.

A network has nodes that emit (each a column of the frame's scores) and nodes
that do not; the latter are passed through within a frame, in the order of their
arcs, so a hub that joins many words to many words costs the sum of its arcs
and not their product.  Weights are natural logarithms.  A network is a table
of nodes and one of arcs, read whole by each task, so its size is checked.

An utterance is decoded or trained on in one group, as each frame needs the one
before; utterances are dealt over tasks, and what training returns are
model-sized sums that Spark adds up.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gaussian import Mixture
from .hidden import Hmm, _updated, empty_frame

#: Nodes and arcs that a network may have, as every task holds it.
MOST_ROWS = 2_000_000


@dataclass
class Network:
    """``emits[k]`` is the column that node k emits, -1 for none; arcs ``src[a]`` to ``dst[a]`` of weight ``weight[a]``."""

    emits: list[int]
    src: list[int]
    dst: list[int]
    weight: list[float]
    start: int
    end: int
    phases: list = field(default_factory=list, repr=False)

    def __post_init__(self):
        import numpy as np

        self.emits, self.src, self.dst = (np.asarray(v, np.int64) for v in (self.emits, self.src, self.dst))
        self.weight = np.asarray(self.weight, float)
        if self.emits[self.start] >= 0 or self.emits[self.end] >= 0:
            raise ValueError("start and end must be nodes without emission")
        level = self._levels()
        for k in range(-1, int(level.max(initial=-1)) + 1):  # arcs from emitting nodes, then from each level of the others
            arcs = np.flatnonzero((self.emits[self.src] >= 0) if k < 0 else (level[self.src] == k))
            arcs = arcs[np.lexsort((arcs, self.dst[arcs]))]
            to, first = np.unique(self.dst[arcs], return_index=True)
            by = arcs[np.lexsort((arcs, self.src[arcs]))]
            count = np.bincount(self.src[by], minlength=len(self.emits))
            self.phases.append((arcs, to, first, by, np.cumsum(count) - count, count))

    def _levels(self):
        """Of each node without emission the longest way to it over such nodes; -1 of those that emit."""
        import numpy as np

        quiet = self.emits < 0
        inner = quiet[self.src] & quiet[self.dst]
        level, left = np.where(quiet, 0, -1), np.bincount(self.dst[inner], minlength=len(self.emits))
        now, seen = np.flatnonzero(quiet & (left == 0)), 0
        order = np.flatnonzero(inner)
        order = order[np.argsort(self.src[order], kind="stable")]
        count = np.bincount(self.src[order], minlength=len(self.emits))
        first = np.cumsum(count) - count
        while len(now):
            seen += len(now)
            arcs = order[_spread(first[now], count[now])]
            np.maximum.at(level, self.dst[arcs], level[self.src[arcs]] + 1)
            np.subtract.at(left, self.dst[arcs], 1)
            now = np.unique(self.dst[arcs])
            now = now[left[now] == 0]
        if seen < quiet.sum():
            raise ValueError("nodes without emission form a cycle")
        return level

    def arrive(self, leaving, combine, begin: bool = False):
        """What reaches each node within a frame; ``leaving``: of the nodes that emit, at the frame before."""
        import numpy as np

        at = np.full(len(self.emits), -np.inf)
        if begin:
            at[self.start] = 0.0
        for k, (arcs, to, first, *_) in enumerate(self.phases):
            if len(arcs) and not (k == 0 and begin):
                got = (leaving if k == 0 else at)[self.src[arcs]] + self.weight[arcs]
                at[to] = combine(at[to], combine.reduceat(got, first))
        return at

    def before(self, at, combine):
        """The reverse of ``arrive``: of each node what follows it, from ``at``, what follows an arrival at the nodes that emit and the end."""
        import numpy as np

        at = at.copy()
        out = np.full(len(self.emits), -np.inf)
        for k in range(len(self.phases) - 1, -1, -1):
            *_, by, first, count = self.phases[k]
            if len(by):
                own = np.flatnonzero(count)
                got = combine.reduceat(at[self.dst[by]] + self.weight[by], first[own])
                if k == 0:
                    out[own] = got
                else:
                    at[own] = combine(at[own], got)
        return at, out


def _spread(first, count):
    import numpy as np

    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - first, count)


def network_from_tables(nodes: DataFrame, arcs: DataFrame, start: int, end: int, columns: list[str], most: int = MOST_ROWS) -> tuple[Network, list[int]]:
    """The network of ``nodes(node, model)``, model null without emission, and ``arcs(src, dst, weight)``; and its node ids.

    Models are named in ``columns`` by what they emit.  More than ``most`` rows raise.
    """
    if nodes.count() + arcs.count() > most:
        raise ValueError(f"the network has more than {most} nodes and arcs")
    found = sorted((r["node"], r["model"]) for r in nodes.select("node", "model").collect())
    number, column = {n: k for k, (n, _) in enumerate(found)}, {c: k for k, c in enumerate(columns)}
    rows = sorted((number[r["src"]], number[r["dst"]], float(r["weight"])) for r in arcs.select("src", "dst", "weight").collect())
    net = Network([-1 if m is None else column[m] for _, m in found], *(list(x) for x in zip(*rows)) if rows else ([], [], []), number[start], number[end])
    return net, [n for n, _ in found]


# ---- token passing ---------------------------------------------------------------------------


def _kept(score, beam: float | None, most: int | None):
    """Which tokens stay: those within ``beam`` of the best, and of more than ``most`` those in the upper bins of a histogram."""
    import numpy as np

    below = score.max() - score
    keep = np.ones(len(score), bool) if beam is None else below <= beam
    if most is not None and keep.sum() > most:
        width = max(float(below[keep].max()) / 64, 1e-300)
        cell = np.minimum((below / width).astype(np.int64), 63)
        full = np.cumsum(np.bincount(cell[keep], minlength=64))
        last = int(np.searchsorted(full, most, side="right"))  # the first bin that does not go in whole
        keep &= cell <= last
        over = np.flatnonzero(keep & (cell == last))  # of which the best go in, equal ones by node
        over = over[np.argsort(below[over], kind="stable")]
        keep[over[most - (full[last - 1] if last else 0) :]] = False
    return np.flatnonzero(keep)


def _rest(net: Network, emit):
    """Of each frame a bound of what any token may gain after it: the best step and the best score of each later frame."""
    import numpy as np

    loud = net.emits >= 0
    at = np.full(len(net.emits), -np.inf)
    at[loud], at[net.end] = 0.0, 0.0
    step = net.before(at, np.maximum)[1][loud].max(initial=-np.inf)
    best = emit[:, np.unique(net.emits[loud])].max(axis=1, initial=-np.inf)
    return np.cumsum((np.append(best[1:], 0.0) + step)[::-1])[::-1]


def pass_tokens(net: Network, emit, beam: float | None = None, most: int | None = None, exact: bool = False):
    """(score, node of each frame, tokens kept of each frame) of the best path; (None, None, counts) if none is complete.

    emit: (frames, columns) log scores.  Each frame keeps a table of the tokens'
    nodes and of the place of each one's predecessor in the table before; equal
    scores go to the predecessor of the smaller node.  ``exact``: where a token that
    ``beam`` or ``most`` dropped could have come to the score found, tokens are passed
    again, and only those are dropped that cannot come to it.
    """
    if not exact or beam is None and most is None:
        return _passed(net, emit, beam, most)[:3]
    rest = _rest(net, emit)
    *found, lost = _passed(net, emit, beam, most, rest)
    if found[0] is None:
        return _passed(net, emit)[:3]
    floor = found[0] - 1e-9 * max(1.0, abs(found[0]))  # above the rounding of sums in another order
    return tuple(found) if lost < floor else _passed(net, emit, rest=rest, floor=floor)[:3]


def _passed(net: Network, emit, beam: float | None = None, most: int | None = None, rest=None, floor: float | None = None):
    """The three of ``pass_tokens``, and the largest bound of a token dropped; with ``floor`` tokens whose bound is below it are dropped."""
    import numpy as np

    n, lost = len(net.emits), -np.inf
    best, origin = np.full(n, -np.inf), np.full(n, -1)
    tables, counts = [], []
    score, node = np.zeros(1), np.array([net.start])

    def offer(phase, nodes, values, origins):
        *_, by, first, count = phase
        arcs = by[_spread(first[nodes], count[nodes])]
        value, to = np.repeat(values, count[nodes]) + net.weight[arcs], net.dst[arcs]
        come = np.repeat(origins, count[nodes])
        by = np.lexsort((come, -value, to))
        to, at = np.unique(to[by], return_index=True)
        value, come = value[by][at], come[by][at]
        better = (value > best[to]) | ((value == best[to]) & (come < origin[to]) & (value > -np.inf))
        best[to[better]], origin[to[better]] = value[better], come[better]
        return to

    def move(nodes, values, origins, begin):
        """Pass tokens on; the nodes touched."""
        touched = [] if begin else [offer(net.phases[0], nodes, values, origins)]
        if begin:
            best[net.start], origin[net.start] = 0.0, 0
            touched.append(np.array([net.start]))
        for phase in net.phases[1:]:
            *_, count = phase
            own = np.unique(np.concatenate(touched))
            own = own[(count[own] > 0) & (best[own] > -np.inf)]
            if len(own):
                touched.append(offer(phase, own, best[own], origin[own]))
        return np.unique(np.concatenate(touched))

    for t in range(len(emit) + 1):
        touched = move(node, score, np.arange(len(node)), t == 0)
        if t == len(emit):
            total, last = float(best[net.end]), int(origin[net.end])
            break
        live = touched[(net.emits[touched] >= 0) & (best[touched] > -np.inf)]
        score, back = best[live] + emit[t][net.emits[live]], origin[live]
        best[touched], origin[touched] = -np.inf, -1
        good = np.flatnonzero(score > -np.inf)
        if not len(good):
            return None, None, counts + [0] * (len(emit) - t), lost
        stay = _kept(score[good], beam, most) if floor is None else np.flatnonzero(score[good] + rest[t] >= floor)
        if rest is not None and len(stay) < len(good):
            lost = max(lost, float(np.delete(score[good], stay).max() + rest[t]))
        good = good[stay]
        node, score = live[good], score[good]
        tables.append((node, back[good]))
        counts.append(len(node))
    if total == -np.inf or not tables:
        return None, None, counts, lost
    path = []
    for nodes, back in reversed(tables):
        path.append(int(nodes[last]))
        last = int(back[last])
    return total, path[::-1], counts, lost


def decode_network(df: DataFrame, part: list[str], order: str, x: str, net: Network, models: list[Mixture], names: list | None = None, beam: float | None = None, most: int | None = None, exact: bool = False) -> DataFrame:
    """The node of each frame on the best path: part, order, node, score of the utterance, tokens kept at the frame.

    ``models`` are by column, ``names`` the ids of nodes; ``beam``, ``most`` and ``exact``: see ``pass_tokens``.  Utterances without a
    complete path have null nodes and scores.
    """
    kinds = dict(df.dtypes)

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(order)
        m = np.array(pdf[x].tolist(), float)
        score, path, counts = pass_tokens(net, np.array([s.log_prob(m) for s in models]).T, beam, most, exact)
        ids = path if path is None or names is None else [names[k] for k in path]
        return pdf[[*part, order]].assign(node=pd.array([None] * len(pdf) if ids is None else ids, dtype="Int64"), score=score, tokens=counts)

    return df.select(*part, order, x).groupBy(*part).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*part, order]) + ", node long, score double, tokens int")


# ---- sums over all paths ---------------------------------------------------------------------


def forward_backward(net: Network, emit):
    """(log likelihood, posteriors of (frame, node), expected uses of each arc) over all complete paths."""
    import numpy as np

    frames, n = len(emit), len(net.emits)
    loud = net.emits >= 0
    told = lambda t: np.where(loud, emit[t][np.where(loud, net.emits, 0)], -np.inf)
    with np.errstate(invalid="ignore"):
        come, left = [], None
        for t in range(frames + 1):
            at = net.arrive(left, np.logaddexp, begin=t == 0)
            come.append(at)
            if t < frames:
                left = at + told(t)
        total = float(come[frames][net.end])
        if not np.isfinite(total):
            return total, None, None
        uses, posts = np.zeros(len(net.src)), np.zeros((frames, n))
        after = np.full(n, -np.inf)
        after[net.end] = 0.0
        for t in range(frames, -1, -1):
            after[~loud & (np.arange(n) != net.end)] = -np.inf
            if t < frames:
                after[net.end] = -np.inf
            after, left = net.before(after, np.logaddexp)
            if t < frames:
                posts[t] = np.where(loud, np.exp(come[t] + after - total), 0)
            # an arc is used after frame t - 1: from nodes that emitted then, or from those without emission
            value = come[t].copy()
            value[loud] = (come[t - 1] + told(t - 1))[loud] if t else -np.inf
            uses += np.exp(value[net.src] + net.weight + after[net.dst] - total)
            if t:
                after = np.where(loud, left + told(t - 1), -np.inf)
    return total, posts, uses


def lattice_network(arcs: list[tuple], hmms: dict[str, Hmm], start, end):
    """The network of lattice arcs (src, dst, model or None, probability) with the models in their places.

    Returns it with the (model, state) of each column and, of each arc, (model, kind, state, state):
    kind 0 none, 1 into a model, 2 within, 3 out of it.
    """
    import numpy as np

    points = {p: k for k, p in enumerate(sorted({p for a in arcs for p in a[:2]} | {start, end}))}
    columns = {c: k for k, c in enumerate((m, s) for m in sorted({a[2] for a in arcs if a[2] is not None}) for s in range(len(hmms[m].states)))}
    emits, rows, tags = [-1] * len(points), [], []
    with np.errstate(divide="ignore"):
        for src, dst, model, p in arcs:
            a, b, w = points[src], points[dst], float(np.log(p))
            if model is None:
                rows.append((a, b, w))
                tags.append((None, 0, 0, 0))
                continue
            first, move, leave = hmms[model].logs()
            base = len(emits)
            emits += [columns[model, s] for s in range(len(first))]
            inner = [(a, base + s, w + first[s], 1, s, s) for s in range(len(first))]
            inner += [(base + s, base + r, move[s][r], 2, s, r) for s in range(len(first)) for r in range(len(first))]
            inner += [(base + s, b, leave[s], 3, s, s) for s in range(len(first))]
            inner = [i for i in inner if i[2] > -np.inf]
            rows += [i[:3] for i in inner]
            tags += [(model, *i[3:]) for i in inner]
    return Network(emits, *(list(v) for v in zip(*rows)), points[start], points[end]), list(columns), tags


def _lattice_sums(arcs, hmms, m, start, end):
    """(log likelihood, accumulators of each model in the layout of ``hidden``) of one utterance on its lattice."""
    import numpy as np

    net, columns, tags = lattice_network(arcs, hmms, start, end)
    emit = np.array([hmms[k].states[s].log_prob(m) for k, s in columns]).T.reshape(len(m), len(columns))
    total, posts, uses = forward_backward(net, emit)
    if posts is None:
        return total, {}
    held = np.zeros((len(m), len(columns)))
    loud = np.flatnonzero(net.emits >= 0)
    np.add.at(held.T, net.emits[loud], posts.T[loud])
    out = {}
    for name in sorted({k for k, _ in columns}):
        hmm = hmms[name]
        k = len(hmm.states)
        sums = {1: np.zeros((k, k)), 2: np.zeros((k, k)), 3: np.zeros((k, k))}
        for (model, kind, s, r), u in zip(tags, uses):
            if model == name:
                sums[kind][s, r] += u
        own = held[:, [columns.index((name, s)) for s in range(k)]]
        acc = [[0.0, own.sum()], sums[1].diagonal(), sums[3].diagonal(), sums[2].ravel()]
        for s, state in enumerate(hmm.states):
            g = state.posteriors(m) * own[:, s][:, None]
            acc += [g.sum(axis=0), (g.T @ m).ravel(), (g.T @ (m * m)).ravel()]
        out[name] = np.concatenate([np.asarray(a, float) for a in acc])
    return total, out


SUMS = "model string, i long, v double"


def _by_utterance(df: DataFrame, lattices: DataFrame, part: list[str], order: str, x: str, run, schema: str) -> DataFrame:
    """``run(key, arcs, frames in order)`` of each utterance that has frames and a lattice."""

    def both(key, frames, arcs):
        import numpy as np
        import pandas as pd

        if not len(frames) or not len(arcs):
            return empty_frame(schema)
        rows = [(s, d, None if pd.isna(m) else m, p) for s, d, m, p in zip(arcs["src"], arcs["dst"], arcs["model"], arcs["prob"])]
        return run(key, sorted(rows, key=str), np.array(frames.sort_values(order)[x].tolist(), float))

    return df.select(*part, order, x).groupBy(*part).cogroup(lattices.select(*part, "src", "dst", "model", "prob").groupBy(*part)).applyInPandas(both, schema)


def lattice_scores(df: DataFrame, lattices: DataFrame, part: list[str], order: str, x: str, hmms: dict[str, Hmm], start: int, end: int) -> DataFrame:
    """(part, score): the log likelihood of each utterance summed over the paths of its lattice; without one no row.

    lattices: part, src, dst, model (null: no frames pass), prob.
    """
    kinds = dict(df.dtypes)

    def run(key, arcs, m):
        import pandas as pd

        return pd.DataFrame([(*key, _lattice_sums(arcs, hmms, m, start, end)[0])], columns=[*part, "score"])

    return _by_utterance(df, lattices, part, order, x, run, ", ".join(f"{c} {kinds[c]}" for c in part) + ", score double")


def train_on_lattices(df: DataFrame, lattices: DataFrame, part: list[str], order: str, x: str, hmms: dict[str, Hmm], start: int, end: int, iterations: int = 1) -> tuple[dict[str, Hmm], list[float]]:
    """Embedded training: models of the summed accumulators after each pass, and the log likelihood before each.

    The probabilities of lattices' arcs are kept; models that no path uses stay
    as they are; utterances without a path that fits their frames are left out.
    """
    import numpy as np

    trace = []
    for _ in range(iterations):
        now = hmms

        def run(key, arcs, m, now=now):
            import pandas as pd

            total, sums = _lattice_sums(arcs, now, m, start, end)
            if not sums:
                return empty_frame(SUMS)
            sums = {"": [total], **sums}
            return pd.DataFrame({"model": [k for k, v in sums.items() for _ in v], "i": [i for v in sums.values() for i in range(len(v))], "v": np.concatenate(list(sums.values()))})

        found: dict = {}
        sums = _by_utterance(df, lattices, part, order, x, run, SUMS)
        for r in sums.groupBy("model", "i").agg(F.sum("v").alias("v")).orderBy("model", "i").collect():  # the models' sizes
            found.setdefault(r["model"], []).append(r["v"])
        trace.append(found.pop("", [0.0])[0])
        hmms = {k: _updated(h, np.array(found[k])) if k in found and found[k][1] > 1e-8 else h for k, h in hmms.items()}
    return hmms, trace
