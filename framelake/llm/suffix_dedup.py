"""Removal of byte strings that a document with a smaller id also holds.

Matching strings of ``width`` bytes share the smallest hash among their
``GRAM``-byte grams, at the same place.  Such grams are each document's anchors
(about one in eighteen bytes), and the bytes of all ``width``-strings around one
are its context.  Only contexts can match as a whole or in part:

* Contexts of one anchor and one 80-bit name are a class.  Its smallest
  document goes on, at all places there; the others' contexts are repeats.
* A string that two classes of an anchor share reaches over the anchor and at
  least half of the rest to the left or to the right of it.  So classes go on to
  be sorted only where another of their anchor has the same such half.
* The contexts of each anchor are concatenated and sorted by a difference cover:
  triples at two of three positions are sorted and named, their names recursed
  on until no two are equal, the remaining suffixes ordered by symbol and rank
  and merged in; adjacent suffixes whose prefixes of ``width`` bytes are equal
  form a class, and only its smallest document keeps them.

Nothing is sampled: a string in two documents has an anchor that both hold.
Spark deals anchors to buckets and then to tasks; suffixes around different
anchors never need to be told apart, so each anchor's are sorted by themselves,
in one task, and no suffix array of all texts is made.  A batch of
documents sends each class for one document only, with all its places there, so
what a frequent passage brings to a task is bounded by the number of batches and
the places in one document of each.

Defined cases: null texts are empty; texts shorter than ``width`` stay whole;
rows with equal ids do not remove each other's bytes, and each loses what
smaller ids hold of its own text; rows without an id neither lose bytes nor take
them from others; an empty table gives an empty one; a text of any length is
read whole, by one task; columns may have any names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import bound_batches, tidy, write_stage

WIDTH, GRAM = 50, 16
#: Bytes of contexts that one sort takes; an anchor's own are not split.
CHUNK = 1 << 18
#: Bytes of text whose anchors a bucket holds, and documents that send them together.
BUCKET, BATCH = 1 << 24, 2048
#: Tasks at least that sort surroundings.
TASKS = 16
_BASE = 0x9E3779B97F4A7C15
#: bytes of an anchor in a blob: document, text's hash, position, anchor, context, halves
_FIELDS = {"d": 8, "v": 8, "pos": 4, "h": 3, "c": 6, "lr": 3}


class Anchors:
    """Anchor positions and the hashes of anchors, contexts and halves of byte strings."""

    def __init__(self, width: int, gram: int = GRAM):
        import numpy as np

        from .minhash import _fmix

        if width < gram:
            raise ValueError("width is below the gram's")
        self.width, self.gram, self.mix = width, gram, _fmix
        self.half = (width - gram + 1) // 2
        self.table = _fmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int):
        import numpy as np

        if len(self.powers) < n:
            for name, b in (("powers", _BASE | 1), ("inverse", pow(_BASE | 1, -1, 2**64))):
                x, have = np.ones(1, np.uint64), 1
                while have < n:
                    x = np.concatenate([x, x * np.uint64(pow(b, have, 2**64))])
                    have *= 2
                setattr(self, name, x)

    @staticmethod
    def _slide(x, w: int, best):
        """best over x[i : i + w]."""
        have = 1
        while have < w:
            more = min(have, w - have)
            x = best(x[:-more], x[more:])
            have += more
        return x

    def of(self, data: bytes):
        """(positions, anchor hashes, context hashes, halves); nothing for short data.

        halves: 12 bits for the half to the left and 12 for that to the right, 0 where the text ends before.
        """
        import numpy as np
        import xxhash

        n, w = len(data), self.width - self.gram + 1
        if n < self.width:
            return None
        self._grow(n + 1)
        raw = np.frombuffer(data, np.uint8)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[raw] * self.powers[:n], out=total[1:])
        grams = self.mix((total[self.gram :] - total[: -self.gram]) * self.inverse[: n - self.gram + 1])
        low = self._slide(grams, w, np.minimum)
        edge = np.zeros(w - 1, np.uint64)
        at = np.flatnonzero(self._slide(np.concatenate([edge, low, edge]), w, np.maximum) == grams)
        a, b = np.maximum(at - (w - 1), 0), np.minimum(at + self.width, n)
        digest = xxhash.xxh3_64_intdigest
        context = np.fromiter((digest(data[x:y]) for x, y in zip(a.tolist(), b.tolist())), np.uint64, len(at))
        context = self.mix(context + (at - a).astype(np.uint64) * np.uint64(_BASE))

        def half(a, b):
            inside = (a >= 0) & (b <= n)
            a, b = np.maximum(a, 0), np.minimum(b, n)
            return np.where(inside, self.mix((total[b] - total[a]) * self.inverse[a]) % np.uint64(4095) + np.uint64(1), np.uint64(0))

        halves = half(at - self.half, at + self.gram) | half(at, at + self.gram + self.half) << np.uint64(12)
        return at, grams[at], context, halves


def _paired(x, y, top: int):
    """One integer for (x, y) that keeps their order; y is below ``top``."""
    import numpy as np

    if (int(x.max(initial=0)) + 1) * top >= 1 << 62:
        x = np.unique(x, return_inverse=True)[1]
    return x * top + y


def suffix_order(s):
    """Order of the suffixes of ``s`` (integers from 1), by a difference cover modulo 3."""
    import numpy as np

    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    k = int(s.max()) + 1
    pairs = _paired(s[:-1], s[1:], k)
    sampled = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    found, names = np.unique(_paired(pairs[sampled], s[sampled + 2], k), return_inverse=True)
    names = names + 1
    if len(found) < len(sampled):
        order = suffix_order(names)
        names = np.empty(len(sampled), np.int64)
        names[order] = np.arange(1, len(sampled) + 1)
    top = len(sampled) + 2
    rank = np.zeros(n + 3, np.int64)
    rank[sampled] = names
    by = np.empty(len(sampled), np.int64)
    by[names - 1] = sampled
    by = by[by < n]  # without the filler
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(_paired(s[zeros], rank[zeros + 1], top), kind="stable")]
    smaller, ahead = np.zeros(len(by), np.int64), np.zeros(len(zeros), np.int64)
    for mod, lead in ((1, s), (2, pairs)):
        mine = np.flatnonzero(by % 3 == mod)
        both = np.concatenate([zeros, by[mine]])
        key = _paired(lead[both], rank[both + mod], top)
        a, b = key[: len(zeros)], key[len(zeros) :]
        before = np.searchsorted(b, a)  # no two are equal
        ahead += before
        smaller[mine] = np.cumsum(np.bincount(before, minlength=len(b) + 1))[: len(b)]
    out = np.empty(n, np.int64)
    out[np.arange(len(zeros)) + ahead] = zeros
    out[np.arange(len(by)) + smaller] = by
    return out


def repeats(contexts: list[bytes], owners, width: int):
    """(context, start) of each ``width``-string that a context of a smaller owner also holds."""
    import numpy as np

    sizes = np.array([len(c) for c in contexts], np.int64)
    raw = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int64) + 2
    first = np.cumsum(sizes + 1) - (sizes + 1)
    raw[first + sizes] = 1  # ends
    order = suffix_order(raw)
    which = np.searchsorted(first, order, "right") - 1
    fits = order - first[which] + width <= sizes[which]
    order, which = order[fits], which[fits]
    if not len(order):
        return which, order
    new = np.ones(len(order), bool)
    same = np.ones(len(order) - 1, bool)
    step = min(4, width)
    packed = raw[: len(raw) - step + 1].copy()  # symbols at each place and behind it, 16 bits each
    for k in range(1, step):
        packed |= raw[k : len(raw) - step + 1 + k] << 16 * k
    for k in {*range(0, width - step, step), width - step}:  # adjacent prefixes
        x = packed[order + k]
        same &= x[1:] == x[:-1]
    new[1:] = ~same
    least = np.minimum.reduceat(owners[which], np.flatnonzero(new))[np.cumsum(new) - 1]
    late = owners[which] > least
    return which[late], (order - first[which])[late]


def _pack(**cols) -> bytes:
    """Columns of unsigned integers, each as planes of its low bytes, which pack well."""
    import numpy as np

    return b"".join(np.ascontiguousarray(np.ascontiguousarray(cols[k]).astype("<i8" if k in "dv" else "<u8").view("u1").reshape(-1, 8)[:, :size].T).tobytes() for k, size in _FIELDS.items() if k in cols)


def _unpack(blobs: list[bytes], names) -> dict:
    import numpy as np

    width, parts = sum(_FIELDS[k] for k in names), {k: [] for k in names}
    for blob in blobs:
        planes, at = np.frombuffer(blob, np.uint8).reshape(width, -1), 0
        for k in names:
            full = np.zeros((planes.shape[1], 8), np.uint8)
            full[:, : _FIELDS[k]] = planes[at : at + _FIELDS[k]].T
            parts[k].append(full.view("<i8").ravel())
            at += _FIELDS[k]
    return {k: np.concatenate(x) for k, x in parts.items()}


def _anchor_blobs(rows: DataFrame, width: int, buckets: int) -> DataFrame:
    """(bucket, blob): each class of a batch at all places in its smallest document; bucket -1: (d, v, pos) of the others, which are repeats."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        own = Anchors(width)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                some = batch.slice(lo, BATCH)
                d, v = some.column(0).to_numpy(), some.column(1).to_numpy()
                parts = []
                for k, t in enumerate(some.column(2)):
                    if got := own.of(t.as_py().encode("utf-8", "surrogatepass")):
                        parts.append((np.full(len(got[0]), k, np.uint32), got[0].astype(np.uint32), *got[1:]))
                if not parts:
                    continue
                doc, pos, h, c, lr = (np.concatenate(x) for x in zip(*parts))
                order = np.lexsort((d[doc], c, h))
                doc, pos, h, c, lr = (x[order] for x in (doc, pos, h, c, lr))
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
                lead = d[doc[first]][np.cumsum(first) - 1]
                gone = d[doc] > lead
                out = []
                if gone.any():
                    out.append((-1, _pack(d=d[doc[gone]], v=v[doc[gone]], pos=pos[gone])))
                doc, pos, h, c, lr = (x[~gone] for x in (doc, pos, h, c, lr))
                at = (h >> np.uint64(32)) % np.uint64(buckets)
                order = np.lexsort((pos, doc, at))  # ids and places in order pack well
                ends = np.searchsorted(at[order], np.arange(buckets + 1)) if buckets < len(at) else None
                found = range(buckets) if ends is not None else np.unique(at).astype(np.int64).tolist()
                for b in found:
                    x = order[ends[b] : ends[b + 1]] if ends is not None else order[slice(*np.searchsorted(at[order], [b, b + 1]))]
                    if len(x):
                        out.append((b, _pack(d=d[doc[x]], v=v[doc[x]], pos=pos[x], h=h[x], c=c[x] >> np.uint64(16), lr=lr[x])))
                yield pa.RecordBatch.from_arrays([pa.array(v_, t) for v_, t in zip(zip(*out), (pa.int64(), pa.binary()))], names=["bucket", "blob"])

    return rows.select("d", "v", "t").mapInArrow(tidy(work), "bucket long, blob binary")


def _settle(blobs: DataFrame, lead: int, width: int) -> DataFrame:
    """(d, v, a, b, g): byte range a..b of a text; g null: a repeat; else a context to compare with those of the anchor g."""
    dealt = blobs.withColumn("salt", F.when(F.col("bucket") < 0, F.xxhash64("blob"))).repartition("bucket", "salt").sortWithinPartitions("bucket")

    def shared(h, side, ok):
        """Which classes have their half in common with another of their anchor."""
        import numpy as np

        _, at, n = np.unique(np.where(ok, h << 12 | side, -1), return_inverse=True, return_counts=True)
        return ok & (n[at] > 1)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        def rows(x, which, group=None):
            g = pa.nulls(len(which), pa.int64()) if group is None else pa.array(group)
            pos = x["pos"][which]
            return pa.RecordBatch.from_arrays([pa.array(x["d"][which]), pa.array(x["v"][which]), pa.array(np.maximum(pos - lead, 0)), pa.array(pos + width), g], names=["d", "v", "a", "b", "g"])

        def done(bucket, held):
            if bucket < 0:
                x = _unpack(held, ("d", "v", "pos"))
                yield rows(x, np.arange(len(x["d"])))
                return
            x = _unpack(held, tuple(_FIELDS))
            order = np.lexsort((x["d"], x["c"], x["h"]))
            x = {k: y[order] for k, y in x.items()}
            h, c = x["h"], x["c"]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            number = np.cumsum(first) - 1
            gone = x["d"] > x["d"][first][number]
            yield rows(x, np.flatnonzero(gone))
            sides = [(x["lr"][first] >> shift) & 4095 for shift in (0, 12)]
            ask = shared(h[first], sides[0], sides[0] > 0) | shared(h[first], sides[1], sides[1] > 0)
            which = np.flatnonzero(~gone & ask[number])  # at every place in the smallest document
            if len(which):
                yield rows(x, which, np.int64(bucket) << 24 | h[which])

        now, held = None, []
        for batch in batches:
            for bucket, blob in zip(*(batch.column(k).to_pylist() for k in range(2))):
                if held and (bucket != now or now < 0):
                    yield from done(now, held)
                    held = []
                now = bucket
                held.append(blob)
        if held:
            yield from done(now, held)

    return dealt.select("bucket", "blob").mapInArrow(tidy(work), "d long, v long, a long, b long, g long")


def _compare(asked: DataFrame, texts: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(d, v, a, b): repeats found by sorting the contexts of each anchor; a text's equal ones go as one, with ``more`` places."""
    lists = asked.groupBy(*keys).agg(F.collect_list(F.struct("g", "a", "b")).alias("asked"))
    joined = texts.join(lists, keys).select("row", "d", "v", "t", "asked")

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for d, v, t, asked in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                data, flat = t.as_py().encode("utf-8", "surrogatepass"), asked.values
                g, a, b = (flat.field(k).to_numpy() for k in range(3))
                order = np.argsort(g, kind="stable")
                g, a, b = g[order], a[order], b[order]
                again = np.zeros(len(g) + 1, bool)
                again[1:-1] = g[1:] == g[:-1]
                keep, more = np.ones(len(g), bool), {}
                head: dict = {}
                several = np.flatnonzero(again[1:] | again[:-1])  # anchors with several places here
                for k, anchor, x, y in zip(*(z.tolist() for z in (several, g[several], a[several], b[several]))):
                    at = head.setdefault((anchor, data[x:y]), k)
                    if at != k:
                        keep[k] = False
                        more.setdefault(at, []).append(x)
                also = [np.array(more[k], "<i8").tobytes() if k in more else None for k in np.flatnonzero(keep).tolist()] if more else [None] * len(g)
                g, a, b = g[keep], a[keep], b[keep]
                for lo in range(0, len(g), 8192):
                    s = slice(lo, lo + 8192)
                    text = [data[x:y] for x, y in zip(a[s].tolist(), b[s].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(g[s]), pa.array(np.full(len(text), d)), pa.array(np.full(len(text), v)), pa.array(a[s]), pa.array(text, pa.binary()), pa.array(also[s], pa.binary())], names=["g", "d", "v", "a", "x", "more"])

    contexts = joined.mapInArrow(tidy(cut), "g long, d long, v long, a long, x binary, more binary").repartition("g").sortWithinPartitions("g")

    def work(batches):
        import numpy as np
        import pyarrow as pa

        def done(held):
            x, more = ([y for h in held for y in h[k]] for k in (3, 4))
            d, v, a = (np.concatenate([h[k] for h in held]) for k in range(3))
            which, start = repeats(x, d, width)
            order = np.lexsort((start, which))
            which, start = which[order], start[order]
            if len(which):  # runs of adjacent starts
                new = np.ones(len(which), bool)
                new[1:] = (which[1:] != which[:-1]) | (start[1:] != start[:-1] + 1)
                i = np.flatnonzero(new)
                j = np.append(i[1:], len(which)) - 1
                w, lo, hi = which[i], start[i], start[j] + width
                places = [np.frombuffer(more[k], "<i8") if more[k] else () for k in w.tolist()]
                times = np.array([len(p) for p in places])
                at = np.concatenate([a[w], *(p for p in places if len(p))])
                w, lo, hi = (np.concatenate([y, np.repeat(y, times)]) for y in (w, lo, hi))
                return pa.RecordBatch.from_arrays([pa.array(d[w]), pa.array(v[w]), pa.array(at + lo), pa.array(at + hi)], names=["d", "v", "a", "b"])

        def taken(batch, i, j):
            return (*(batch.column(k).to_numpy()[i:j] for k in (1, 2, 3)), *(batch.column(k).slice(i, j - i).to_pylist() for k in (4, 5)))

        held, size, last = [], 0, None
        for batch in batches:
            g = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)] if len(g) else [0]
            lo = 0
            for i, j in zip(cuts[:-1], cuts[1:]):
                if size + (i - lo) * 2 * width > CHUNK and g[i] != last:
                    if i > lo:
                        held.append(taken(batch, lo, i))
                    if held and (out := done(held)):
                        yield out
                    held, size, lo = [], 0, i
                last = g[i]
            if len(g) > lo:
                held.append(taken(batch, lo, len(g)))
                size += (len(g) - lo) * 2 * width
        if held and (out := done(held)):
            yield out

    return contexts.mapInArrow(tidy(work), "d long, v long, a long, b long")


def cut_ranges(data: bytes, ranges) -> tuple[bytes, int, int]:
    """(remaining bytes, bytes removed, maximal removed runs). ranges: (starts, ends), which may overlap."""
    import numpy as np

    a, b = ranges
    order = np.argsort(a, kind="stable")
    a, top = a[order], np.maximum.accumulate(np.minimum(b[order], len(data)))
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > top[:-1]
    start, end = a[new], top[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]
    keep = [data[x:y] for x, y in zip([0, *end.tolist()], [*start.tolist(), len(data)])]
    return b"".join(keep), int((end - start).sum()), len(start)


def _apply(docs: DataFrame, width: int, id_col: str, text_col: str, others: list[str], schema: str, value) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, and what ``value`` makes of the remaining bytes) of every row; row holds the columns ``others``."""
    bound_batches(docs)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("d"), F.col(f"`{text_col}`").cast("string").alias("t"))
    part = rows.where("d is not null and t is not null")
    # one pass over the texts: their size, and whether an id names several
    hashed = part.select("d", F.xxhash64("t").alias("v"), F.octet_length("t").alias("n")).groupBy("d").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("n"))
    size, several = hashed.agg(F.sum("n"), F.max((F.col("lo") != F.col("hi")).cast("int"))).first()
    keys = ["d", "v"] if several else ["d"]
    part = part.select("row", "d", (F.xxhash64("t") if several else F.lit(0).cast("long")).alias("v"), "t")
    found = write_stage(_settle(_anchor_blobs(part, width, max(256, (size or 0) // BUCKET)), width - GRAM, width), "anchors", max(TASKS, (size or 0) // (2 * BUCKET)))
    # both joins read the texts from one exchange
    compared = _compare(found.where("g is not null").distinct(), part, keys, width)
    every = found.where("g is null").select(*keys, "a", "b").unionByName(compared.select(*keys, "a", "b"))
    ranges = every.groupBy(*keys).agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    joined = part.join(ranges, keys, "left").select("row", "d", "v", "t", "ranges")
    kind = StructType([rows.schema["row"], *StructType.fromDDL(f"n_bytes long, n_removed long, n_spans long, {schema}")])

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some, out = batch.slice(lo, 256), []
                for t, r in zip(some.column(3), some.column(4)):
                    data = t.as_py().encode("utf-8", "surrogatepass") if t.is_valid else b""
                    if r.is_valid and len(r.values):
                        kept, gone, runs = cut_ranges(data, tuple(r.values.field(k).to_numpy() for k in range(2)))
                        out.append((len(data), gone, runs, value(kept)))
                    else:
                        out.append((len(data), 0, 0, value(data) if t.is_valid else value(None)))
                cols = [pa.array(np.array(x, np.int64)) for x in list(zip(*out))[:3]]
                yield pa.RecordBatch.from_arrays([some.column(0), *cols, pa.array([x[3] for x in out], pa.string())], names=[f.name for f in kind])

    rest = rows.where("d is null or t is null").select("row", "d", F.lit(0).cast("long").alias("v"), "t", F.lit(None).cast("array<struct<a:bigint,b:bigint>>").alias("ranges"))
    return joined.unionByName(rest).mapInArrow(tidy(cut), kind)


def digests(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is left."""
    out = _apply(docs, width, id_col, text_col, [id_col], "kept_sha256 string", lambda b: hashlib.sha256(b or b"").hexdigest())
    return out.select(F.col(f"row.`{id_col}`").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated strings cut out of the texts; null texts stay null.

    A character that is left without some of its bytes goes with them.
    """
    others = [c for c in docs.columns if c != text_col]
    out = _apply(docs, width, id_col, text_col, others, "kept string", lambda b: None if b is None else b.decode("utf-8", "ignore"))
    return out.select(*(F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
