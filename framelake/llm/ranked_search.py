"""Ranked lexical search over documents reordered by recursive graph bisection.

Documents and the terms that are asked form a graph.  Bisection halves the
documents again and again and swaps those between halves that lower the cost of
the terms' lists, so that neighbours in the order share terms.  The upper levels
run over all documents: a task adds up the degrees of terms and a histogram of
gains, Spark merges them, and what is kept of a step is a table of gains and a cutoff
for each half, from which any task can tell where a document stands.  The
lower levels run in a task each, down to clusters of ``LEAF`` documents.

A cluster holds its terms' lists and, for each term, its largest impact; an
item's bound for it is the sum of weight times that impact.  Each item first visits
the ``FIRST`` clusters with the largest bounds; its k-th score there is a safe
cutoff.  Then all clusters are gone through: those whose bound is below the
cutoff, or below the k-th score that the task has found since, are passed over, the
others visited by falling bounds.  A bound equal to the cutoff is visited, as a
smaller doc_id may stand behind it.  Scores are integers and every cluster that could
hold a result is scored exactly, so the order of documents never changes a result,
only how much is skipped; results carry the ids of the documents.

Items are asked in blocks of about ``TERMS`` terms, so what goes to the driver and
to tasks (a block's terms, weights, cutoffs) is bounded; tables of upper levels end
at ``CELLS`` numbers, and parts of more than ``LOCAL`` documents or ``POSTINGS`` of their
terms are dealt to tasks by a hash of the id.

Defined cases: a null or empty text has no terms, is in no result and does not
count in N; documents without an id count in the statistics and are not
returned; rows that share an id are documents of their own; rows of items that
share an id, null included, are one item with the terms of all; items without terms
found anywhere have no rows; empty tables give an empty result; columns other
than ids and texts are not read, whatever their names.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bound_batches, write_stage

#: Documents of a cluster, of a task that bisects, and rounds of swaps within a task and over all documents.
LEAF, LOCAL, ROUNDS, UPPER = 512, 1 << 16, 6, 2
#: Terms of documents, each counted in every document, that a task bisects, and that it works out gains for at a time.
POSTINGS, AT_ONCE = 1 << 21, 1 << 18
#: Terms of a block of items, numbers in the table of an upper level, clusters that an item visits first.
TERMS, CELLS, FIRST = 1_000_000, 1 << 20, 8
#: Clusters that a task orders by their bounds at a time.
VISITED = 64
#: Histogram of gains: steps of a quarter, so many to each side.
BINS = 2048


def _table() -> bytes:
    """Bytes of terms stay, A-Z lowered; others are blanks."""
    keep = lambda b: b > 127 or chr(b).isalnum()
    return bytes((b + 32 if 65 <= b <= 90 else b) if keep(b) else 32 for b in range(256))


_BYTES = _table()


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats."""
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split() if text else []


def _mix(x):
    """A 64-bit hash of integers (finaliser of splitmix64)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _read(batch, *columns):
    """Arrays of binary columns joined, and the row of each number of the first."""
    import numpy as np

    blobs = [batch.column(c).to_pylist() for c, _ in columns]
    row = np.repeat(np.arange(batch.num_rows), [len(b) // 4 for b in blobs[0]])
    return [np.frombuffer(b"".join(b), kind) for b, (_, kind) in zip(blobs, columns)] + [row]


# ---- statistics ------------------------------------------------------------------------------


def _item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item, term) of ``items(item, t)``."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            found = [sorted(set(terms_of(t.as_py()))) for t in batch.column(1)]
            at = pa.array([k for k, x in enumerate(found) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([y for x in found for y in x], pa.binary())], names=["item", "term"])

    return items.mapInArrow(work, T.StructType([T.StructField("item", items.schema["item"].dataType), T.StructField("term", T.BinaryType())])).distinct()


def _counted(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(d, n, terms, tfs) of each document: number of terms; numbers and frequencies of those asked."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        get = number.get
        for batch in batches:
            n, terms, tfs = [], [], []
            for t in batch.column(1):
                words = terms_of(t.as_py())
                found = np.array([k for k in map(get, words) if k is not None], np.uint32)
                found, tf = np.unique(found, return_counts=True)
                n.append(len(words))
                terms.append(found.tobytes())
                tfs.append(tf.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], names=["d", "n", "terms", "tfs"])

    return docs.mapInArrow(work, "d long, n long, terms binary, tfs binary")


def _merged(rows: DataFrame, count) -> dict[int, int]:
    """Sums of the counts that ``count`` finds in each batch, by key; of a bounded number of keys."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys, at = np.unique(np.concatenate([keys, k := count(batch)]), return_inverse=True)
            sums = np.bincount(at, weights=np.concatenate([sums, np.ones(len(k))]), minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["k", "n"])

    return {r["k"]: r["n"] for r in rows.mapInArrow(work, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}


# ---- bisection -------------------------------------------------------------------------------


def _gains(left, right, n_left, n_right):
    """What a document gains, for each of its terms, by going from left to right; degrees are given."""
    import numpy as np

    cost = lambda d, n: d * np.log2(n / (d + 1))
    now = cost(left, n_left) + cost(right, n_right)
    return np.where(left > 0, now - cost(np.maximum(left - 1, 0), n_left) - cost(right + 1, n_right), 0)


class Upper:
    """The steps of the upper levels: at each, gains of (node, side, term) and cutoffs of (node, side)."""

    def __init__(self, levels: int, terms: int):
        self.levels, self.terms, self.steps = levels, terms, []

    def place(self, ids, terms, row):
        """(node, side) of documents after the steps so far; the side is that within the level under way."""
        import numpy as np

        node, side = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for level in range(len(self.steps) // UPPER + 1):
            side = (_mix(ids.view(np.uint64) + np.uint64(level + 1)) & np.uint64(1)).astype(np.int64)
            for step in self.steps[level * UPPER : (level + 1) * UPPER]:
                side ^= self.gain(step[0], node, side, terms, row) >= step[1][node, side]
            if len(self.steps) >= (level + 1) * UPPER:
                node, side = 2 * node + side, np.zeros_like(side)
            if level == self.levels - 1:
                break
        return node, side

    def gain(self, table, node, side, terms, row):
        import numpy as np

        return np.bincount(row, weights=table[node[row], side[row], terms], minlength=len(node))


def _cutoffs(left, right):
    """Least gains, on both sides, of those that are swapped: by rank, while two together gain."""
    import numpy as np

    value = np.arange(BINS, -BINS - 1, -1) / 4  # of bins by falling gain
    a, b = np.cumsum(left[::-1]), np.cumsum(right[::-1])
    ranks = np.unique(np.concatenate([a, b]))
    ranks = ranks[(ranks > 0) & (ranks <= min(a[-1], b[-1]))]
    ranks = ranks[value[np.searchsorted(a, ranks)] + value[np.searchsorted(b, ranks)] > 0]
    if not len(ranks):
        return np.inf, np.inf
    reached = [x[x <= ranks[-1]].max(initial=0) for x in (a, b)]
    return tuple(value[np.searchsorted(x, n)] if n else np.inf for x, n in zip((a, b), reached))


def _upper(docs: DataFrame, total: int, terms: int) -> Upper:
    import numpy as np

    levels = max(0, min(math.ceil(math.log2(max(1, total) / LOCAL)), int(math.log2(max(1, CELLS / max(1, terms))))))
    own = Upper(levels, terms)
    for step in range(levels * UPPER):
        nodes = 1 << step // UPPER

        def degrees(batch):
            t, row = _read(batch, (1, np.uint32))
            node, side = own.place(batch.column(0).to_numpy(), t, row)
            return np.concatenate([(2 * node + side)[row] * (terms + 1) + t, (2 * node + side) * (terms + 1) + terms])

        found = _merged(docs.select("d", "terms"), degrees)
        deg = np.zeros(nodes * 2 * (terms + 1))
        deg[list(found)] = list(found.values())
        deg = deg.reshape(nodes, 2, terms + 1)
        size = np.maximum(deg[:, :, terms:], 1)
        table = np.stack([_gains(deg[:, s, :terms], deg[:, 1 - s, :terms], size[:, s], size[:, 1 - s]) for s in (0, 1)], axis=1).astype(np.float32)

        def histogram(batch):
            t, row = _read(batch, (1, np.uint32))
            node, side = own.place(batch.column(0).to_numpy(), t, row)
            bins = np.clip(np.floor(4 * own.gain(table, node, side, t, row)), -BINS, BINS).astype(np.int64) + BINS
            return (2 * node + side) * (2 * BINS + 1) + bins

        found = _merged(docs.select("d", "terms"), histogram)
        counts = np.zeros(nodes * 2 * (2 * BINS + 1))
        counts[list(found)] = list(found.values())
        counts = counts.reshape(nodes, 2, 2 * BINS + 1)
        own.steps.append((table, np.array([_cutoffs(x[0], x[1]) for x in counts])))
    return own


def ranges(first, sizes):
    """Indices first[k], first[k] + 1, ... of each k in turn."""
    import numpy as np

    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - first, sizes)


def _renamed(terms, first, sizes):
    """Terms of documents, numbered anew from 0; how many; and slices (documents x to y, terms p to q) of about AT_ONCE terms."""
    import numpy as np

    ends = np.cumsum(sizes)
    cuts = [0, *(np.flatnonzero(np.diff(ends // AT_ONCE)) + 1).tolist(), len(sizes)]
    starts = np.append(0, ends)[cuts].tolist()
    of = list(zip(cuts, cuts[1:], starts, starts[1:]))
    flat = np.empty(starts[-1], np.uint32)
    for x, y, p, q in of:
        flat[p:q] = terms[ranges(first[x:y], sizes[x:y])]
    top = int(flat.max()) + 1 if len(flat) else 0
    if top > len(flat):
        names, flat = np.unique(flat, return_inverse=True)
        return flat, len(names), of
    seen = np.zeros(top, bool)
    seen[flat] = True
    number = (np.cumsum(seen) - 1).astype(np.uint32)
    for _, _, p, q in of:
        flat[p:q] = number[flat[p:q]]
    return flat, int(seen.sum()), of


def bisect(first, sizes, terms, leaf: int = LEAF, rounds: int = ROUNDS):
    """An order of documents, and where its clusters begin; document k holds terms[first[k] : first[k] + sizes[k]]."""
    import numpy as np

    order, starts, todo = np.arange(len(sizes)), [], [(0, len(sizes))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= leaf:
            starts.append(lo)
            continue
        half = (hi - lo) // 2
        ids = order[lo:hi]
        flat, count, of = _renamed(terms, first[ids], sizes[ids])
        right = np.arange(hi - lo) >= half
        degree = np.bincount(flat, minlength=count)
        for _ in range(rounds):
            b = np.zeros(count, np.int64)
            for x, y, p, q in of:
                b += np.bincount(flat[p:q][np.repeat(right[x:y], sizes[ids[x:y]])], minlength=count)
            a = degree - b
            table = np.stack([_gains(a, b, half, hi - lo - half), _gains(b, a, hi - lo - half, half)])
            gain = np.zeros(hi - lo)
            for x, y, p, q in of:
                row = np.repeat(np.arange(y - x), sizes[ids[x:y]])
                gain[x:y] = np.bincount(row, weights=table[right[x:y][row].astype(np.int8), flat[p:q]], minlength=y - x)
            x, y = np.flatnonzero(~right), np.flatnonzero(right)
            x, y = x[np.argsort(-gain[x], kind="stable")], y[np.argsort(-gain[y], kind="stable")]
            n = min(len(x), len(y))
            n = int((gain[x[:n]] + gain[y[:n]] > 1e-9).sum())
            if not n:
                break
            right[x[:n]], right[y[:n]] = True, False
        order[lo:hi] = np.concatenate([ids[~right], ids[right]])
        todo += [(lo, lo + half), (lo + half, hi)]
    return order, sorted(starts)


def _clusters(docs: DataFrame, upper: Upper, impacts) -> DataFrame:
    """A row for each cluster: its number, terms, largest impacts, lists of documents with impacts, and ids.

    docs: (d, n, terms, tfs); ``impacts`` makes the impacts, 32 bits each, of a batch of them.
    """

    def place(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            t, row = _read(batch, (2, np.uint32))
            node, _ = upper.place(batch.column(0).to_numpy(), t, row)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(impacts(batch), pa.binary()), pa.array(node)], names=["d", "terms", "impacts", "node"])

    def measured(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            t, row = _read(batch, (2, np.uint32))
            node, _ = upper.place(batch.column(0).to_numpy(), t, row)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.bincount(row, minlength=len(node)))], names=["node", "terms"])

    placed = docs.mapInArrow(place, "d long, terms binary, impacts binary, node long")
    sizes = docs.mapInArrow(measured, "node long, terms long").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("terms").alias("p")).collect()  # at most 2 ** levels
    sizes = {0: 1} | {r["node"]: max(1, round(r["n"] / LOCAL), math.ceil(r["p"] / POSTINGS)) for r in sizes}
    blocks = F.create_map(*[F.lit(x).cast("long") for k in sizes.items() for x in k])
    leaf = LEAF

    def work(key, group):
        import numpy as np

        size = np.fromiter(map(len, group["terms"]), np.int64, len(group)) // 4
        terms, impacts = (np.frombuffer(b"".join(group[c]), np.uint32) for c in ("terms", "impacts"))
        first, ids, out = np.cumsum(size) - size, group["d"].to_numpy(), []
        del group
        order, starts = bisect(first, size, terms, leaf)
        for k, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(order)])):
            some = order[lo:hi]
            at = ranges(first[some], size[some])
            by = np.argsort(terms[at], kind="stable")
            t, where = np.unique(terms[at][by], return_index=True)
            doc, impact = np.repeat(np.arange(hi - lo), size[some])[by], impacts[at][by]
            out.append((int(key[0]), int(key[1]), k, t.astype(np.uint32).tobytes(), np.maximum.reduceat(impact, where).astype(np.uint32).tobytes(), np.append(where, len(at)).astype(np.uint32).tobytes(), doc.astype(np.uint32).tobytes(), impact.astype(np.uint32).tobytes(), ids[some].astype(np.int64).tobytes()))
        return pd.DataFrame(out, columns=["node", "block", "k", "terms", "most", "starts", "docs", "impacts", "ids"])

    dealt = placed.withColumn("block", F.pmod(F.xxhash64("d"), blocks[F.col("node")]))
    made = dealt.groupBy("node", "block").applyInPandas(work, "node long, block long, k long, terms binary, most binary, starts binary, docs binary, impacts binary, ids binary")
    return made.select(F.concat_ws(".", "node", "block", "k").alias("cluster"), "terms", "most", "starts", "docs", "impacts", "ids")


# ---- search ----------------------------------------------------------------------------------


class Asked:
    """A block of items: flat arrays of term numbers and weights by item."""

    def __init__(self, items: list[dict[int, int]], terms: int):
        import numpy as np

        self.count, self.terms = len(items), terms
        self.first = np.cumsum([0, *map(len, items)])
        self.term = np.array([t for x in items for t in x], np.int64)
        self.weight = np.array([w for x in items for w in x.values()], np.int64)
        self.item = np.repeat(np.arange(len(items)), np.diff(self.first))

    def bounds(self, terms, most):
        """Each item's bound for a cluster, and the place in it of each of the terms asked (-1: none)."""
        import numpy as np

        place = np.full(self.terms, -1, np.int64)
        place[terms] = np.arange(len(terms))
        at = place[self.term]
        gain = np.where(at >= 0, self.weight * most[at].astype(np.int64), 0)
        return np.bincount(self.item, weights=gain, minlength=self.count).astype(np.int64), at

    def scores(self, q: int, at, starts, docs, impacts, n: int):
        """Scores of a cluster's documents for an item."""
        import numpy as np

        total = np.zeros(n, np.int64)
        for k in range(self.first[q], self.first[q + 1]):
            if at[k] >= 0:
                lo, hi = starts[at[k]], starts[at[k] + 1]
                total[docs[lo:hi]] += self.weight[k] * impacts[lo:hi].astype(np.int64)
        return total


def _visits(clusters: DataFrame, asked: Asked, k: int, cutoff, chosen: dict[str, list[int]] | None = None) -> DataFrame:
    """(q, d, score): each task's best of the clusters that it visits.

    ``cutoff`` has a score for each item that results reach.  With ``chosen``,
    only the items listed for a cluster visit it, and whatever its bound.
    """

    def work(batches):
        import numpy as np
        import pyarrow as pa

        none = np.zeros(0, np.int64)
        best = [(none, none) for _ in range(asked.count)]
        floor = cutoff.copy()
        for batch in (b.slice(x, VISITED) for b in batches for x in range(0, b.num_rows, VISITED)):
            todo = []
            for c in range(batch.num_rows):
                name, terms, most = (batch.column(x)[c].as_py() for x in range(3))
                bound, at = asked.bounds(np.frombuffer(terms, np.uint32), np.frombuffer(most, np.uint32))
                found = chosen.get(name, []) if chosen is not None else np.flatnonzero((bound > 0) & (bound >= floor)).tolist()
                if found:
                    lists = *(np.frombuffer(batch.column(x)[c].as_buffer(), np.uint32) for x in (3, 4, 5)), np.frombuffer(batch.column(6)[c].as_buffer(), np.int64)
                    todo += [(int(bound[q]), q, at, *lists) for q in found]
            todo.sort(key=lambda x: (-x[0], x[1]))
            for bound, q, at, starts, docs, impacts, ids in todo:
                if bound < floor[q]:
                    continue  # and all after it of this item
                score = asked.scores(q, at, starts, docs, impacts, len(ids))
                good = np.flatnonzero(score >= max(1, floor[q]))
                if len(good):
                    s, d = np.concatenate([best[q][0], score[good]]), np.concatenate([best[q][1], ids[good]])
                    top = np.lexsort((d, -s))[:k]
                    best[q] = s[top], d[top]
                    if len(top) == k:
                        floor[q] = max(floor[q], best[q][0][-1])
        q = np.repeat(np.arange(asked.count), [len(s) for s, _ in best])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([d for _, d in best] or [none])), pa.array(np.concatenate([s for s, _ in best] or [none]))], names=["q", "d", "score"])

    return clusters.mapInArrow(work, "q long, d long, score long")


def _first_clusters(clusters: DataFrame, asked: Asked) -> dict[str, list[int]]:
    """The items of each cluster that is among the FIRST of an item."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        bounds, names = np.zeros((asked.count, 0), np.int64), np.zeros(0, object)
        rows = np.arange(asked.count)[:, None]
        held = np.zeros((asked.count, 0), object)
        for batch in batches:
            new = [asked.bounds(*(np.frombuffer(batch.column(x)[c].as_py(), np.uint32) for x in (1, 2)))[0] for c in range(batch.num_rows)]
            names = np.array(batch.column(0).to_pylist(), object)
            bounds = np.concatenate([bounds, np.array(new, np.int64).reshape(-1, asked.count).T], axis=1)
            held = np.concatenate([held, np.broadcast_to(names, (asked.count, len(names)))], axis=1)
            top = np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST]
            bounds, held = bounds[rows, top], held[rows, top]
        q, c = np.nonzero(bounds)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(held[q, c].tolist(), pa.string()), pa.array(bounds[q, c])], names=["q", "cluster", "bound"])

    found = clusters.select("cluster", "terms", "most").mapInArrow(work, "q long, cluster string, bound long")
    best = Window.partitionBy("q").orderBy(F.col("bound").desc(), "cluster")
    chosen: dict[str, list[int]] = {}
    for r in found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= FIRST).collect():
        chosen.setdefault(r["cluster"], []).append(r["q"])
    return chosen


def _search(docs: DataFrame, terms: list, k: int) -> DataFrame | None:
    """(q, d, score) of the best k of each item of a block; terms: (item's number, term)."""
    import numpy as np

    spark = docs.sparkSession
    number = {t: i for i, t in enumerate(sorted({bytes(t) for _, t in terms}))}
    counted = write_stage(_counted(docs, number), "counted")
    n_docs, n_terms = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    if not n_terms:
        return None
    df = _merged(counted.select("terms"), lambda batch: _read(batch, (0, np.uint32))[0].astype(np.int64))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    items: list[dict[int, int]] = [{} for _ in range(1 + max(q for q, _ in terms))]
    for q, t in terms:
        if weight.get(number[bytes(t)], 0) > 0:
            items[q][number[bytes(t)]] = weight[number[bytes(t)]]
    asked = Asked(items, len(number))

    def impacts(batch):
        tf, row = _read(batch, (3, np.uint32))
        m = 50 + 50 * batch.column(1).to_numpy() * n_docs // n_terms
        tf = tf.astype(np.int64)
        value = (1_000_000_000 * tf // (1000 * tf + 20 * m[row])).astype(np.uint32)
        at = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
        return [value[a:b].tobytes() for a, b in zip(at, at[1:])]

    held = counted.where("d is not null and length(terms) > 0")
    clusters = write_stage(_clusters(held, _upper(held, held.count(), len(number)), impacts), "clusters")
    chosen = _first_clusters(clusters, asked)
    first = clusters.join(F.broadcast(spark.createDataFrame([(c,) for c in chosen], "cluster string")), "cluster", "left_semi")
    cutoff = np.zeros(asked.count, np.int64)
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "d")
    seen = _visits(first.select(clusters.columns), asked, k, cutoff, chosen)
    for r in seen.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("q", "score").collect():
        cutoff[r["q"]] = r["score"]
    return _visits(clusters, asked, k, cutoff).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item, rank, doc, score): the k best documents of each item, equal scores by ascending id."""
    bound_batches(docs)
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.col(f"`{text_col}`").cast("string").alias("t"))
    kind = items.schema[item_col].dataType
    terms = write_stage(_item_terms(items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("t"))), "asked")
    blocks = max(1, -(-terms.count() // TERMS))
    out = spark.createDataFrame([], T.StructType([T.StructField(item_col, kind), T.StructField("rank", T.IntegerType()), T.StructField(id_col, T.LongType()), T.StructField("score", T.LongType())]))
    for b in range(blocks):
        some = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect() if blocks > 1 else terms.collect()
        names = {x: q for q, x in enumerate(dict.fromkeys(r["item"] for r in some))}
        found = _search(rows, [(names[r["item"]], r["term"]) for r in some], k) if names else None
        if found is not None:
            of = spark.createDataFrame([(x, q) for x, q in names.items()], T.StructType([T.StructField("item", kind), T.StructField("q", T.LongType())]))
            out = out.unionByName(found.join(F.broadcast(of), "q").select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("d").alias(id_col), "score"))
    return out
