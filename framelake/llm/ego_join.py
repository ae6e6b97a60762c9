"""Near-duplicate vectors by an epsilon grid order join.

For unit vectors, cosine >= c means a distance of at most eps = sqrt(2 - 2c).
Vectors are turned onto their principal axes (from a 64 x 64 matrix of summed
products), sorted within their label by the grid cells of side eps on the
leading axes, and cut into intervals of at most INTERVAL rows.  The sequence of
intervals is joined with itself recursively: from the whole sequence down, each
part has up to FAN parts, and pairs of parts whose boxes are more than eps apart
are left out before their own parts are looked at.  A pair of intervals goes on
in one task, halving the longer sequence and leaving out halves that are
provably distant, down to LEAF rows, which one matrix product compares in double
precision.

Equal vectors of a label are one class, compared once; counts give the copies'
links.  A pair of intervals returns link counts and a spanning forest, never
its pairs.

Vectors are scaled by the power of two that takes their largest component to
between 1/2 and 1, which no cosine notices, so neither huge nor tiny components
overflow or vanish in a norm.

Defined cases: a null label, and a vector that is null, empty, zero or holds null
or non-finite components, link with nothing; vectors of different lengths do
not link; rows repeated with the same id are counted as rows; rows without an id
link with nothing and have no component; an empty table gives an empty one;
columns other than the three named are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, join_spread, write_stage

AXES, LEAF, INTERVAL = 8, 256, 4096
#: Bits of an interval's number that one step of the recursion over intervals adds.
STEP = 4
FAN = 1 << STEP
#: Slack of distances against rounding; boxes and cells are only used to leave out.
SLACK = 1e-9


def _axes(rows: DataFrame) -> dict:
    """Leading principal axes by vector length, from partial sums of products."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        sums = {}
        for batch in batches:
            x = [np.frombuffer(b.as_py(), "<f8") for b in batch.column(0)]
            for n in {len(v) for v in x}:
                m = np.array([v for v in x if len(v) == n])
                m = m / np.linalg.norm(m, axis=1, keepdims=True)
                old = sums.get(n)
                sums[n] = (len(m) + (old[0] if old else 0), m.sum(axis=0) + (old[1] if old else 0), m.T @ m + (old[2] if old else 0))
        for n, (count, s, ss) in sums.items():
            at = np.triu_indices(n)
            value = np.concatenate([[count], s, ss[at]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), n)), pa.array(np.arange(len(value))), pa.array(value)], names=["n", "k", "v"])

    import numpy as np

    found = rows.select("x").mapInArrow(work, "n long, k long, v double").groupBy("n", "k").agg(F.sum("v").alias("v")).collect()  # dims^2 / 2 values a length
    out = {}
    for n in {r["n"] for r in found}:
        v = np.zeros(1 + n + n * (n + 1) // 2)
        for r in found:
            if r["n"] == n:
                v[r["k"]] = r["v"]
        ss = np.zeros((n, n))
        ss[np.triu_indices(n)] = v[1 + n :]
        ss = ss + np.triu(ss, 1).T
        mean = v[1 : 1 + n] / v[0]
        values, vectors = np.linalg.eigh(ss / v[0] - np.outer(mean, mean))
        out[int(n)] = np.ascontiguousarray(vectors[:, ::-1][:, : min(AXES, n)])
    return out


def _intervals(classes: DataFrame, axes: dict, eps: float) -> DataFrame:
    """(label, n, part, seq, lo, hi, ids, vectors): intervals of the grid order of each label and length.

    part and seq, the task and the place in it, ascend with the order.
    """

    def cells(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keys, first = [], []
            for b in batch.column(2):
                v = np.frombuffer(b.as_py(), "<f8")
                c = np.floor((v / np.linalg.norm(v)) @ axes[len(v)] / eps).astype(np.int64) + (1 << 20)
                keys.append(c.astype(">u4").tobytes())
                first.append(len(v))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int64()), pa.array(keys, pa.binary())], names=["label", "id", "x", "w", "n", "cell"])

    keyed = classes.select("label", "id", "x", "w").mapInArrow(cells, "label long, id long, x binary, w long, n long, cell binary")
    dealt = keyed.repartitionByRange("label", "n", "cell", "id").sortWithinPartitions("label", "n", "cell", "id").withColumn("p", F.spark_partition_id())

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        task, seq = None, 0

        def done(label, n, ids, xs, ws):
            m = np.frombuffer(b"".join(xs), "<f8").reshape(len(ids), n)
            p = (m / np.linalg.norm(m, axis=1, keepdims=True)) @ axes[n]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary())
            row = (label, n, task, seq, p.min(axis=0).tolist(), p.max(axis=0).tolist(), np.array(ids, "<i8").tobytes(), m.tobytes(), np.array(ws, "<i8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["label", "n", "part", "seq", "lo", "hi", "ids", "xs", "ws"])

        now, ids, xs, ws = None, [], [], []
        for batch in batches:
            if task is None and batch.num_rows:
                task = batch.column(6)[0].as_py()
            for label, i, x, w, n in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if ids and ((label, n) != now or len(ids) >= INTERVAL):
                    yield done(*now, ids, xs, ws)
                    ids, xs, ws, seq = [], [], [], seq + 1
                now = (label, n)
                ids.append(i)
                xs.append(x)
                ws.append(w)
        if ids:
            yield done(*now, ids, xs, ws)

    return dealt.mapInArrow(cut, "label long, n long, part long, seq long, lo array<double>, hi array<double>, ids binary, xs binary, ws binary")


def _pairs_of_intervals(boxes: DataFrame, eps: float) -> DataFrame:
    """(label, n, a, b) with a < b: numbers of intervals that are not provably distant.

    boxes: (label, n, number, lo, hi).  A part of the sequence holds the numbers
    that are equal but for their last bits.
    """
    top = boxes.agg(F.max("number")).first()[0] or 0
    steps = -(-top.bit_length() // STEP)

    def parts(step):
        of = boxes.select("label", "n", F.shiftright("number", STEP * step).alias("p"), "lo", "hi")
        if not step:
            return of
        each = lambda f, c: F.filter(F.array(*(f(F.get(c, F.lit(k))) for k in range(AXES))), lambda v: v.isNotNull())
        return of.groupBy("label", "n", "p").agg(each(F.min, "lo").alias("lo"), each(F.max, "hi").alias("hi"))

    zipped = F.arrays_zip(F.col("alo").alias("p"), F.col("ahi").alias("q"), F.col("blo").alias("r"), F.col("bhi").alias("s"))
    far = F.aggregate(zipped, F.lit(0.0), lambda acc, v: acc + F.pow(F.greatest(F.lit(0.0), v["p"] - v["s"], v["r"] - v["q"]), F.lit(2.0)))
    pairs = boxes.select("label", "n", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).distinct()
    for step in range(steps - 1, -1, -1):
        below = parts(step)
        a, b = (below.select("label", "n", F.shiftright("p", STEP).alias(x), F.col("p").alias(x + "p"), F.col("lo").alias(x + "lo"), F.col("hi").alias(x + "hi")) for x in "ab")
        pairs = pairs.join(a, ["label", "n", "a"]).join(b, ["label", "n", "b"]).where((F.col("ap") <= F.col("bp")) & (far <= eps * eps + SLACK))
        pairs = pairs.select("label", "n", F.col("ap").alias("a"), F.col("bp").alias("b"))
    return pairs.where("a < b")


def join_sequences(a, b, pa_, pb, eps: float, found, same: bool) -> None:
    """Call ``found(a0, a1, b0, b1)`` for block pairs that are not provably distant.

    a, b: (start, stop) in grid order; pa_, pb: their places on the leading axes.
    same: both are one sequence, and only pairs with a before b count.
    """
    import numpy as np

    stack = [(*a, *b)]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        x, y = pa_[a0:a1], pb[b0:b1]
        gap = np.maximum(0, np.maximum(x.min(axis=0) - y.max(axis=0), y.min(axis=0) - x.max(axis=0)))
        if float(gap @ gap) > eps * eps + SLACK:
            continue
        if max(a1 - a0, b1 - b0) <= LEAF:
            found(a0, a1, b0, b1)
        elif same and (a0, a1) == (b0, b1):
            mid = (a0 + a1) // 2
            stack += [(a0, mid, a0, mid), (a0, mid, mid, a1), (mid, a1, mid, a1)]
        elif a1 - a0 >= b1 - b0:
            mid = (a0 + a1) // 2
            stack += [(a0, mid, b0, b1), (mid, a1, b0, b1)]
        else:
            mid = (b0 + b1) // 2
            stack += [(a0, a1, b0, mid), (a0, a1, mid, b1)]


def _join(pairs: DataFrame, axes: dict, cosine: float, eps: float) -> DataFrame:
    """(id, other, links): link counts by copies (other null), and forest edges (links null)."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for n, ids1, xs1, w1, ids2, xs2, w2 in zip(*(batch.column(k).to_pylist() for k in range(7))):
                same = ids2 is None
                ids = [np.frombuffer(ids1, "<i8")]
                m = [np.frombuffer(xs1, "<f8").reshape(-1, n)]
                w = [np.frombuffer(w1, "<i8")]
                if not same:
                    ids, m, w = ids + [np.frombuffer(ids2, "<i8")], m + [np.frombuffer(xs2, "<f8").reshape(-1, n)], w + [np.frombuffer(w2, "<i8")]
                norm = [np.linalg.norm(x, axis=1) for x in m]
                unit = [x / v[:, None] for x, v in zip(m, norm)]
                place = [x @ axes[n] for x in unit]
                k, off = (0, 0) if same else (1, len(ids[0]))
                links = [np.zeros(len(x), np.int64) for x in ids]
                root = list(range(sum(map(len, ids))))

                def top(i):
                    while root[i] != i:
                        root[i] = root[root[i]]
                        i = root[i]
                    return i

                def found(a0, a1, b0, b1):
                    near = (m[0][a0:a1] @ m[k][b0:b1].T) >= cosine * np.outer(norm[0][a0:a1], norm[k][b0:b1])
                    if same and a0 == b0:
                        near = np.triu(near, 1)
                    if near.any():
                        links[0][a0:a1] += near @ w[k][b0:b1]
                        links[k][b0:b1] += near.T @ w[0][a0:a1]
                        # the smallest place that each reaches within the block
                        x, y, most = np.arange(a0, a1), np.arange(off + b0, off + b1), len(root)
                        while True:
                            x2 = np.minimum(x, np.where(near, y, most).min(axis=1))
                            y2 = np.minimum(y, np.where(near, x2[:, None], most).min(axis=0))
                            if (x2 == x).all() and (y2 == y).all():
                                break
                            x, y = x2, y2
                        for i, j in [*zip(range(a0, a1), x.tolist()), *zip(range(off + b0, off + b1), y.tolist())]:
                            if i != j:
                                i, j = top(i), top(j)
                                root[max(i, j)] = min(i, j)

                join_sequences((0, len(ids[0])), (0, len(ids[k])), place[0], place[k], eps, found, same)
                every, count = np.concatenate(ids), np.concatenate(links)
                tops = np.array([top(i) for i in range(len(root))])
                hit, tied = np.flatnonzero(count), np.flatnonzero(tops != np.arange(len(root)))
                out = [pa.array(np.concatenate([every[hit], every[tied]])), pa.array([*[None] * len(hit), *every[tops[tied]].tolist()], pa.int64()), pa.array([*count[hit].tolist(), *[None] * len(tied)], pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=["id", "other", "links"])

    return pairs.mapInArrow(work, "id long, other long, links long")


def near_vectors(rows: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    eps = (2 - 2 * cosine) ** 0.5 + 1e-6
    x = F.col(f"`{vector_col}`").cast("array<double>")
    fit = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    fit = fit & F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()
    base = rows.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{label_col}`").cast("long").alias("label"), x.alias("a"), fit.alias("fit"))

    def raw(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for v, f in zip(batch.column(2), batch.column(3).to_pylist()):
                x = np.array(v.as_py(), "<f8") if f else None
                out.append((np.ldexp(x, -np.frexp(np.abs(x).max())[1]) + 0.0).tobytes() if f else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["i", "label", "x"])

    named = write_stage(base.mapInArrow(raw, "i long, label long, x binary"), "vectors")
    usable = named.where("x is not null")
    classes = write_stage(usable.groupBy("label", "x").agg(F.min("i").alias("id"), F.count(F.lit(1)).alias("w")), "classes")
    if not classes.limit(1).count():
        return named.select(F.col("i").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("i").alias("component_id"), F.lit(True).alias("kept"))
    axes = _axes(classes)
    parts = write_stage(_intervals(classes, axes, eps), "intervals")
    most = parts.agg(F.max("seq")).first()[0]
    parts = parts.withColumn("number", F.shiftleft("part", most.bit_length()) + F.col("seq"))
    near = _pairs_of_intervals(parts.select("label", "n", "number", "lo", "hi"), eps)
    one, two = (parts.select("label", "n", F.col("number").alias(x), F.col("ids").alias(f"ids{k}"), F.col("xs").alias(f"xs{k}"), F.col("ws").alias(f"w{k}")) for k, x in ((1, "a"), (2, "b")))
    cross = near.join(one, ["label", "n", "a"]).join(two, ["label", "n", "b"]).select("n", "ids1", "xs1", "w1", "ids2", "xs2", "w2")
    own = one.select("n", "ids1", "xs1", "w1", *(F.lit(None).cast("binary").alias(c) for c in ("ids2", "xs2", "w2")))
    joined = write_stage(_join(cross.unionByName(own).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), axes, cosine, eps), "joined")
    counts = joined.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(joined.where("other is not null").select(F.col("id").alias("u"), F.col("other").alias("v"))).withColumnRenamed("node", "id")
    named_by = [F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2")]  # 128 bits stand for a vector
    facts = classes.join(counts, "id", "left").join(comp, "id", "left").select("label", *named_by, (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"), F.coalesce("component", "id").alias("component"), F.col("w").alias("k"))
    out = join_spread(usable.select("i", "label", *named_by), facts, ["label", "h1", "h2"], classes.agg(F.sum("w")).first()[0], "inner").select("i", "links", "component")
    out = out.unionByName(named.where("x is null").select("i", F.lit(None).cast("long").alias("links"), F.lit(None).cast("long").alias("component")))
    component = F.coalesce("component", "i")
    return out.select(F.col("i").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("i").eqNullSafe(component).alias("kept"))
