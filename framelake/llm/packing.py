"""Order-preserving packing of documents into windows of at most ``size`` tokens.

The token stream of the documents, in order, is cut into windows.  Cuts are
wanted at document ends (free) and sentence ends (``sentence_cost``); where
neither comes within ``HARD_EVERY`` tokens, and in the last window's worth of a run, hard
cuts are offered at ``hard_cost``.  A window of a power-of-two length needs no
padding, any other is padded to ``size``.  With positions p and cheapest cost f,

    f[j] = cost(j) + min( min_{p[j]-p[i] <= size} f[i] + size - (p[j]-p[i]),
                          min_{p[j]-p[i] = 2^k}  f[i] )

The first minimum is that of f[i] + p[i] over a sliding window, kept in a
monotone queue, so each cut enters and leaves once.

Defined cases: null and empty texts hold only the end id; null ids come first;
rows with equal ids, repeated ones too, are documents of their own, in the order
of their texts' hashes; an empty table gives no pieces; a text of any length is
a run of its own if it is longer than one; columns other than the id and the
text are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, tidy

SIZE = 2048
#: Tokens a worker plans at once; a run ends with a document.
RUN = 1 << 20
HARD_EVERY = 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(2)
def sentence_ends(path: str):
    """Which ids end a sentence: the token ends in . ! ? or holds a line break."""
    import numpy as np

    from .byte_bpe import load

    bpe = load(path)
    table = np.zeros(1 << 16, bool)
    for i, surface in bpe.surface.items():
        table[i] = surface[-1:] in (b".", b"!", b"?") or b"\n" in surface
    return table


def cut_points(ends, sentence, size: int, sentence_cost: float, hard_cost: float):
    """Positions and costs of the cuts on offer: 0 first, the last document end last."""
    import numpy as np

    n = int(ends[-1])
    cost = np.full(n + 1, np.inf)
    cost[max(0, n - size) :] = hard_cost
    cost[np.flatnonzero(sentence[:n]) + 1] = sentence_cost
    cost[ends] = 0
    cost[0] = 0
    at = np.flatnonzero(np.isfinite(cost))
    gap = np.diff(at)
    wide = np.flatnonzero(gap > HARD_EVERY)
    if len(wide):
        more = np.concatenate([np.arange(at[i] + HARD_EVERY, at[i + 1], HARD_EVERY) for i in wide])
        cost[more] = hard_cost
        at = np.flatnonzero(np.isfinite(cost))
    return at, cost[at]


def plan(at, cost, size: int = SIZE) -> tuple[list[int], float]:
    """Chosen cuts (positions, without 0) and their total cost."""
    import numpy as np

    m = len(at)
    if m == 1:
        return [], 0.0
    where = np.full(int(at[-1]) + 1, -1, np.int64)
    where[at] = np.arange(m)
    to, frm = [np.array([m])], [np.array([0])]
    k = 1
    while k <= size:
        j = np.arange(int(np.searchsorted(at, k)), m)
        i = where[at[j] - k]
        to.append(j[i >= 0])
        frm.append(i[i >= 0])
        k *= 2
    to, frm = np.concatenate(to), np.concatenate(frm)
    order = np.argsort(to, kind="stable")
    to, frm, h = to[order].tolist(), frm[order].tolist(), 0
    p, c = at.tolist(), cost.tolist()
    f, back, queue, key, head = [0.0] * m, [0] * m, [0], [0.0], 0
    for j in range(1, m):
        low = p[j] - size
        while p[queue[head]] < low:
            head += 1
        best, arg = key[head] + size - p[j], queue[head]
        while to[h] == j:
            i = frm[h]
            if f[i] < best:
                best, arg = f[i], i
            h += 1
        f[j], back[j] = best + c[j], arg
        v = f[j] + p[j]
        while len(key) > head and key[-1] >= v:
            key.pop()
            queue.pop()
        key.append(v)
        queue.append(j)
    chosen, j = [], m - 1
    while j:
        chosen.append(p[j])
        j = back[j]
    return chosen[::-1], f[-1]


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE, sentence_cost: float = 2.0, hard_cost: float = 16.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece of a document in a window.

    Documents are dealt by ranges of their id (null first, equal ids by text)
    and planned in runs of about ``RUN`` tokens; a longer document is its own
    run.  Null and empty texts hold only ``end_id``.  ``sequence_id`` is unique
    and ascends with the documents; it is dense within a task.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    bound_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t"))
    rows = rows.repartitionByRange(F.col("d").asc_nulls_first()).sortWithinPartitions(F.col("d").asc_nulls_first(), F.xxhash64("t"), "t")
    rows = rows.withColumn("p", F.spark_partition_id())  # not the task's, which may take several partitions

    def work(batches):
        import numpy as np
        import pyarrow as pa

        from .byte_bpe import load

        bpe, stops = load(tokenizer), sentence_ends(tokenizer)
        end = np.array([end_id], "<u2").tobytes()
        number, names, parts, held = None, [], [], 0

        def flush(number):
            ids = np.frombuffer(b"".join(parts), "<u2")
            counts = np.array([len(x) // 2 for x in parts], np.int64)
            ends = np.cumsum(counts)
            chosen, _ = plan(*cut_points(ends, stops[ids], size, sentence_cost, hard_cost), size)
            cuts = np.array(chosen, np.int64)
            b = np.union1d(ends, cuts)
            a = np.concatenate([[0], b[:-1]])
            doc, seq = np.searchsorted(ends, a, "right"), np.searchsorted(cuts, a, "right")
            first, opened = ends - counts, np.concatenate([[0], cuts])
            data = memoryview(ids.astype("<u4").tobytes())
            crcs = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist())]
            names_ = pa.array(names, pa.int64()).take(pa.array(doc))
            cols = [names_, *(pa.array(x, pa.int64()) for x in (a - first[doc], b - a, crcs, counts[doc], seq + number, a - opened[seq]))]
            return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in PIECES.split(", ")]), number + len(cuts)

        for batch in batches:
            if number is None and batch.num_rows:
                number = batch.column(2)[0].as_py() << 36
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = bpe.encode(t.as_py()) + end
                if held and held + len(ids) // 2 > RUN:
                    out, number = flush(number)
                    yield out
                    names, parts, held = [], [], 0
                names.append(d)
                parts.append(ids)
                held += len(ids) // 2
        if names:
            yield flush(number)[0]
        bpe.forget()

    return rows.mapInArrow(tidy(work), PIECES)
