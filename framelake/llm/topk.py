"""Exact top-k search by a three-phase uniform threshold.

A score is an inner product of integers, the sum of its partial products over
``LISTS`` slices of the components.  Candidates stay in the parts that they are
read in: a node is a block of them with all its slices, written once, and so one
list of partial scores a slice for each query.  No vector is sent anywhere.

1. Every task gathers, over its nodes, the k best partial scores of each list and
   query, and scores exactly what is among them.  The k-th best of these
   scores over all tasks is a cutoff t that no true answer is below.
2. The cutoffs go to all tasks.  A total of at least t has a partial score of
   at least t / LISTS in some list, so each node collects just its entries at
   or above that uniform threshold; a block whose longest slices cannot reach t
   with a query's is passed over.  An entry's bound takes the threshold for the
   lists that did not collect it; those whose bound falls short leave.
3. The totals of the remaining entries are worked out exactly, and each task
   sends each query's k best; those are ranked, ties to the smaller id.

Queries are a stated set.  They go to the tasks in slices of about
``SLICE_BYTES`` with their results, so what is broadcast and what a task holds is
bounded; a slice is one round of the three phases.  Of equal candidates in a
block only the k + 1 with the smallest ids can be answers, and only they are kept.

Defined cases: vectors that are null or hold null or non-finite components take
no part, nor do null ids; vectors meet only others of their length (empty ones
score 0); a query meets no row of its own id; rows that share an id are queries
and candidates of their own, each with ranks from 1; an empty table gives an
empty result; columns other than the id and the vector are read only by
``is_query``; components or scores that might not fit 64 bits raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import hold, write_stage

LISTS, BLOCK, CHUNK, SLICE_BYTES = 2, 4096, 64, 1 << 25
#: Queries whose partial scores a worker holds at once.
AT_ONCE = 512
_BEST = "n int, chunk int, q binary, ids binary, part binary"


def _cuts(n: int) -> list[int]:
    return [n * i // LISTS for i in range(LISTS + 1)]


def _integers(values, scale: float):
    import numpy as np

    x = np.floor(scale * values)
    if len(x) and np.abs(x).max() >= 2.0**62:
        raise ValueError("a component does not fit 64 bits")
    return x.astype(np.int64)


def _nodes(rows: DataFrame, scale: float, k: int) -> DataFrame:
    """(n, ids, ints): blocks of candidates of one length, in the parts they are read in."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        held = {}

        def done(n):
            ids, m = (np.concatenate(x) for x in zip(*held.pop(n)))
            order = np.lexsort((ids, *m.T)) if n else np.argsort(ids, kind="stable")
            ids, m = ids[order], m[order]
            new = np.ones(len(ids), bool)
            new[1:] = (m[1:] != m[:-1]).any(axis=1)
            start = np.flatnonzero(new)
            few = np.arange(len(ids)) - start[np.cumsum(new) - 1] <= k
            cols = (n, ids[few].astype("<i8").tobytes(), np.ascontiguousarray(m[few]).astype("<i8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary()))], names=["n", "ids", "ints"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column(0).to_numpy(), batch.column(1)
            sizes, flat = np.diff(v.offsets.to_numpy()), _integers(v.flatten().to_numpy(zero_copy_only=False), scale)
            first = np.cumsum(sizes) - sizes
            for n in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == n)
                for lo in range(0, len(mine), BLOCK):
                    some = mine[lo : lo + BLOCK]
                    held.setdefault(n, []).append((ids[some], flat[first[some][:, None] + np.arange(n)]))
                    if sum(len(x) for x, _ in held[n]) >= BLOCK:
                        yield done(n)
        for n in list(held):
            yield done(n)

    return write_stage(rows.select("id", "v").mapInArrow(work, "n int, ids binary, ints binary"), "nodes")


class Queries:
    """A slice of the queries: of each length the ids, integers and cutoffs, in chunks of CHUNK with numbers of their own."""

    def __init__(self, table, scale: float):
        import numpy as np

        v = table.column("v").combine_chunks()
        ids, sizes = table.column("id").to_numpy(), np.diff(v.offsets.to_numpy())
        flat = _integers(v.flatten().to_numpy(zero_copy_only=False), scale)
        first, self.by, chunk = np.cumsum(sizes) - sizes, {}, 0
        for n in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == n)
            self.by[n] = (chunk, ids[mine], flat[first[mine][:, None] + np.arange(n)])
            chunk += -(-len(mine) // CHUNK)
        self.cut = {n: None for n in self.by}

    def rows(self, n: int, chunk: int, q):
        """Places among the queries of length n of the places q in a chunk."""
        return (chunk - self.by[n][0]) * CHUNK + q


def _partials(q, c, n: int, lists: int = LISTS):
    """Partial scores as exact integers, in doubles while they fit."""
    import numpy as np

    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(n, 1)
    if most >= 2.0**62:
        raise ValueError("scores might not fit 64 bits")
    return q.astype(np.float64) @ c.astype(np.float64).T if most < 2.0**52 else q @ c.T


def _ints(blobs, kind: str = "<i4"):
    import numpy as np

    return np.frombuffer(b"".join(blobs), kind)


class _Best:
    """The k best (score, id) of some queries, equal scores by id."""

    def __init__(self, count: int, k: int):
        import numpy as np

        self.k, self.score = k, np.full((count, k), np.iinfo(np.int64).min)
        self.ids, self.size = np.zeros((count, k), np.int64), np.zeros(count, np.int64)

    def add(self, row, ids, score):
        import numpy as np

        if not len(row):
            return
        who = np.unique(row)
        held = np.arange(self.k) < self.size[who][:, None]
        row, ids, score = (np.concatenate(x) for x in ((np.repeat(who, self.size[who]), row), (self.ids[who][held], ids), (self.score[who][held], score)))
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        few = place < self.k
        self.ids[row[few], place[few]], self.score[row[few], place[few]] = ids[few], score[few]
        self.size[who] = np.minimum(np.bincount(row, minlength=len(self.size))[who], self.k)

    def chunks(self, n: int, chunk: int):
        """Batches of _BEST, one for each CHUNK queries."""
        import numpy as np
        import pyarrow as pa

        for k, lo in enumerate(range(0, len(self.size), CHUNK)):
            size = self.size[lo : lo + CHUNK]
            held = np.arange(self.k) < size[:, None]
            if size.any():
                cols = (n, chunk + k, np.repeat(np.arange(len(size)), size).astype("<i4").tobytes(), self.ids[lo : lo + CHUNK][held].astype("<i8").tobytes(), self.score[lo : lo + CHUNK][held].astype("<i8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cols, (pa.int32(), pa.int32(), *[pa.binary()] * 3))], names=["n", "chunk", "q", "ids", "part"])


def _scan(nodes: DataFrame, shared, k: int, scored) -> DataFrame:
    """(n, chunk, q, ids, part): the k best totals that a task finds for each query, in phase 1, or with cutoffs in phases 2 and 3."""

    def work(batches):
        import numpy as np

        queries, best, tops = shared.value, {}, {}
        low = np.iinfo(np.int64).min
        for batch in batches:
            for n, ids, ints in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if n not in queries.by:
                    continue
                _, qids, full = queries.by[n]
                cids = np.frombuffer(ids, "<i8")
                c, cuts = np.frombuffer(ints, "<i8").reshape(len(cids), n), _cuts(n)
                found = best.setdefault(n, _Best(len(qids), k))
                longest = [np.sqrt((c[:, a:b].astype(float) ** 2).sum(axis=1).max(initial=0)) for a, b in zip(cuts, cuts[1:])]
                for lo in range(0, len(qids), AT_ONCE):
                    mine = np.arange(lo, min(lo + AT_ONCE, len(qids)))
                    t = None if queries.cut[n] is None else queries.cut[n][mine]
                    if t is not None:  # what a query and the longest slices of the block can reach
                        reach = sum(np.sqrt((full[mine, a:b].astype(float) ** 2).sum(axis=1)) * most for a, b, most in zip(cuts, cuts[1:], longest))
                        mine = mine[reach * (1 + 1e-9) + 1 >= t]
                        t = queries.cut[n][mine]
                    if not len(mine):
                        continue
                    parts = [_partials(full[mine, a:b], c[:, a:b], n) for a, b in zip(cuts, cuts[1:])]
                    hit = np.zeros(parts[0].shape, bool)
                    own = np.isin(qids[mine], cids)
                    hit[own] = qids[mine][own][:, None] == cids[None, :]
                    if t is None:
                        chosen = np.zeros(hit.shape, bool)
                        for which, p in enumerate(parts):
                            p = np.where(hit, -np.inf if p.dtype == float else low, p)
                            few = min(k, p.shape[1])
                            at = np.argpartition(p, p.shape[1] - few, axis=1)[:, p.shape[1] - few :]
                            value = np.take_along_axis(p, at, axis=1)
                            # the k best of this list so far, over the task's nodes
                            top = tops.setdefault((n, which), {}).get(lo)
                            top = value if top is None else np.concatenate([top, value], axis=1)
                            top = np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k :] if top.shape[1] > k else top
                            tops[n, which][lo] = top
                            least = top.min(axis=1) if top.shape[1] == k else np.full(len(top), -np.inf if p.dtype == float else low)
                            r, j = np.nonzero(value >= least[:, None])
                            chosen[r, at[r, j]] = True
                        r, at = np.nonzero(chosen & ~hit)
                    else:
                        none = t == low
                        floor = -(-np.where(none, 0, t) // LISTS)
                        seen, sure = np.zeros(hit.shape, np.int8), 0.0
                        for p in parts:
                            over = p >= floor[:, None]
                            seen += over
                            sure = sure + np.where(over, p, (floor - 1)[:, None])
                        r, at = np.nonzero(((seen > 0) & (sure >= t[:, None]) | none[:, None]) & ~hit)
                    value = sum(p[r, at].astype(np.int64) for p in parts)
                    if scored is not None:
                        scored.add(len(r))
                    if t is not None:
                        good = value >= t[r]
                        r, at, value = r[good], at[good], value[good]
                    found.add(mine[r], cids[at], value)
        for n, held in best.items():
            yield from held.chunks(n, queries.by[n][0])

    return nodes.select("n", "ids", "ints").mapInArrow(work, _BEST)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all tasks, a row for each chunk of queries."""

    def work(batches):
        now, best = None, None
        for batch in batches:
            for n, chunk, q, ids, part in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if now != (n, chunk):
                    if now is not None:
                        yield from best.chunks(*now)
                    now, best = (n, chunk), _Best(CHUNK, k)
                best.add(_ints([q]).astype("int64"), _ints([ids], "<i8"), _ints([part], "<i8"))
        if now is not None:
            yield from best.chunks(*now)

    return found.repartition("n", "chunk").sortWithinPartitions("n", "chunk").mapInArrow(work, _BEST)


def _round(nodes: DataFrame, queries: Queries, k: int, scored) -> DataFrame:
    import numpy as np

    sc = nodes.sparkSession.sparkContext
    first = _merged(_scan(nodes, sc.broadcast(queries), k, scored), k)  # at most about SLICE_BYTES
    cut = {n: np.full(len(ids), np.iinfo(np.int64).min) for n, (_, ids, _) in queries.by.items()}
    for r in first.select("n", "chunk", "q", "part").collect():  # k scores a query of the slice
        q, value = np.frombuffer(r["q"], "<i4"), np.frombuffer(r["part"], "<i8")
        at, count = np.unique(q, return_counts=True)
        full = at[count == k]
        cut[r["n"]][queries.rows(r["n"], r["chunk"], full)] = value[np.searchsorted(q, full, "right") - 1]
    queries.cut = cut
    shared = sc.broadcast(queries)
    found = _merged(_scan(nodes, shared, k, scored), k)

    def ranks(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for n, chunk, q, ids, value in zip(*(batch.column(i).to_pylist() for i in range(5))):
                q = _ints([q])
                mine = shared.value.by[n][1][shared.value.rows(n, chunk, q)]
                place = (np.arange(len(q)) - np.searchsorted(q, q) + 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(place), pa.array(_ints([ids], "<i8")), pa.array(_ints([value], "<i8"))], names=["query_id", "rank", "vec_id", "score"])

    return found.mapInArrow(ranks, "query_id long, rank int, vec_id long, score long")


def top_scores(rows: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", scored=None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query among all other rows.

    Components are turned into floor(scale * x).  scored: an accumulator for the
    number of pairs that are scored exactly.
    """
    x = F.col(f"`{vector_col}`").cast("array<double>")
    fit = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.col(f"`{id_col}`").isNotNull()
    usable = rows.where(fit).select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    nodes = _nodes(usable, scale, k)
    asks = hold(usable.where("asks").select("id", "v"))
    size = asks.agg(F.sum(8 * (F.size("v") + 1) + 32 * k)).first()[0] or 0  # with its results, and the best of its lists
    slices, out = max(1, -(-size // SLICE_BYTES)), None
    for s in range(slices):
        mine = asks.where(F.pmod(F.xxhash64("id", "v"), F.lit(slices)) == s) if slices > 1 else asks
        table = mine.toArrow()
        if table.num_rows:
            found = write_stage(_round(nodes, Queries(table, scale), k, scored), "answers")
            out = found if out is None else out.unionByName(found)
    asks.unpersist()
    return out if out is not None else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
